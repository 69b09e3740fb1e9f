import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import keyword_index
from tessera.sources import files

WORDS = ["the", "of", "and"] + [f"w{i}" for i in range(60)] + ["été", "x_1", "a", "và"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    weight = [60, 50, 40] + [3] * (len(WORDS) - 3)
    joined = lambda n: "".join(w.capitalize() + rng.choice([" ", " ", " ", ", ", ". ", "\n", "-"]) for w in rng.choices(WORDS, weight, k=n))
    out = [joined(rng.choice([3, 10, 40, 150])) for _ in range(400)]
    return out + [None, "", "...", "the " * 80, "tail w1 w2 w3!", "xw1 w2 w3y", "w1  w2 w3", '"w5" w6', "of the and of the and"]


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    return files.persist_index(spark, str(tmp_path_factory.mktemp("index")), "t", keyword_index.tables(docs, "id", "text", per_range=4))


def words(text, least=2):
    return [w for w in re.findall(r"\w+", (text or "").lower()) if len(w) >= least]


def brute(texts, query, k):
    tokens = {i: [w for w in words(t) if w not in T.STOPWORDS] for i, t in enumerate(texts)}
    n, mean = len(texts), sum(map(len, tokens.values())) / sum(t is not None for t in texts)
    df = Counter(w for t in tokens.values() for w in set(t))
    scores = {}
    for i, t in tokens.items():
        tf = Counter(t)
        found = [w for w in query if w in tf]
        if found:
            scores[i] = round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in found), 6)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


QUERIES = ["w1 w2 w3", "and and w7", "été x_1", "nowhere", "of the", "w10 w11 w12 w13 w14 and w15", "and", ""]


@pytest.mark.parametrize(("k", "share"), [(1, 0.5), (10, 0.5), (500, 0.5), (3, 1.0), (3, 0.0)])
def test_best_equals_scoring_all(spark, texts, index, k, share):
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "q long, text string")
    got = keyword_index.best(index, asked, "q", T.tokens(F.col("text")), k, seed_postings=20, most_share=share).collect()
    for q, text in enumerate(QUERIES):
        want = brute(texts, [w for w in words(text) if w not in T.STOPWORDS], k)
        mine = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["q" if "q" in r else "query_id"] == q)
        assert [m[2] for m in mine] == pytest.approx([s for _, s in want], abs=2e-6)
        assert {m[1] for m in mine if m[2] > (want[-1][1] + 1e-5 if want else 0)} == {i for i, s in want if s > want[-1][1] + 1e-5}


def test_frequent_words_are_hardly_scored(spark, tmp_path):
    """A rare word beside words of every document: a tenth of the postings at most is scored."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(20, 60))) + (" needle thread" if i % 200 == 0 else "")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "id long, text string")
    index = files.persist_index(spark, str(tmp_path), "t", keyword_index.tables(docs, "id", "text", per_range=16))
    asked = spark.createDataFrame([(1, "alpha beta gamma needle"), (2, "needle thread alpha")], "q long, text string")
    tokens = T.tokens(F.col("text"))
    for r in keyword_index.best(index, asked, "q", tokens, 5, work=True).collect():
        assert r["postings"] > 3000 and r["scored"] < r["postings"] / 10
    got = [(r["query_id"], r["doc_id"], r["score"]) for r in keyword_index.best(index, asked, "q", tokens, 5).orderBy("query_id", "rank").collect()]
    every = keyword_index.score_all(index, asked, "q", tokens).orderBy("query_id", F.desc("score"), "doc_id").collect()
    want = [x for q in (1, 2) for x in [(r["query_id"], r["doc_id"], r["score"]) for r in every if r["query_id"] == q][:5]]
    assert got == want


PHRASES = ["w1 w2 w3", "W1 W2", "w1", "1 w2 w", '"w5" w6', '"w5', "w6", "of the and", "the the the", "...", "", "w1  w2", "tail w1 w2 w3!", "été", "t", "zzz w1", "w3!", "the, of", "x_1-w4", "5\" w"]


def test_phrases_equal_brute_force(spark, texts, index):
    asked = spark.createDataFrame([*enumerate(PHRASES), (99, None)], "p long, text string")
    got = {(r["phrase_id"], r["doc_id"]) for r in keyword_index.phrases(index, asked, "p", "text").collect()}
    want = {(p, i) for p, x in enumerate(PHRASES) if words(x) for i, t in enumerate(texts) if t is not None and x.lower() in t.lower()}
    assert got == want and len({p for p, _ in got}) > 12


def test_index_is_replaced_whole(spark, tmp_path):
    made = []

    def broken(_):
        made.append(1)
        return spark.range(3).select(F.raise_error(F.lit("lost")).alias("x"))

    with pytest.raises(Exception, match="lost"):
        files.persist_index(spark, f"{tmp_path}/i", "a", {"t": broken})
    assert not (tmp_path / "i/a/t").exists()
    for _ in range(2):
        found = files.persist_index(spark, f"{tmp_path}/i", "a", {"t": lambda _: (made.append(2), spark.range(3))[1], "u": lambda x: x["t"].selectExpr("id * 2 as y")})
    assert made == [1, 2] and found["u"].count() == 3
    files.persist_index(spark, f"{tmp_path}/i", "b", {"t": lambda _: spark.range(1)})
    assert files.drop_indexes(spark, f"{tmp_path}/i", {"b"}) == ["a"] and (tmp_path / "i/b/t").exists()
    one = files.version_of(spark, f"{tmp_path}/i/b/t")
    assert one == files.version_of(spark, f"{tmp_path}/i/b/t")
    spark.range(2).write.mode("append").parquet(f"{tmp_path}/i/b/t")
    assert one != files.version_of(spark, f"{tmp_path}/i/b/t")


def test_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, "")], "id long, text string")
    index = files.persist_index(spark, str(tmp_path), "t", keyword_index.tables(docs, "id", "text"))
    asked = spark.createDataFrame([(1, "w1 w2"), (2, None)], "q long, text string")
    assert keyword_index.best(index, asked, "q", T.tokens(F.col("text")), 3).count() == 0
    assert keyword_index.phrases(index, asked, "q", "text").count() == 0
    assert keyword_index.shared_tokens(index, asked, "q", T.tokens(F.col("text"))).count() == 0
