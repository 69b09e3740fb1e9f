import collections
import math
import random
import zlib

import numpy as np
import pytest

from tessera.llm import language_id, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = queries.op11_language_id(spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    # what is said with more confidence is right more often
    wrong, right = [[r["score"] for r in rows if (r["lang"] == r["lang_pred"]) == ok] for ok in (False, True)]
    assert not wrong or np.mean(wrong) < np.mean(right)


def brute(counts, order):
    """Probability of a symbol after others by interpolated Kneser-Ney, from dictionaries of strings; \\2 begins and \\3 ends a word."""
    plain = [collections.Counter() for _ in range(order + 1)]
    for w, c in counts.items():
        s = "\2" + w + "\3"
        for i in range(1, len(s)):
            for n in range(1, order + 1):
                if i - n + 1 >= 0:
                    plain[n][s[i - n + 1 : i + 1]] += c
    levels = []
    for n in range(1, order + 1):
        count = dict(plain[n])
        if n < order:
            for g in count:
                if g[0] != "\2":
                    count[g] = sum(1 for x in plain[n + 1] if x[1:] == g)
        one, two = sum(c == 1 for c in count.values()), sum(c == 2 for c in count.values())
        levels.append((count, min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.05))

    def p(symbol, context):
        context = context[-(order - 1) :] if order > 1 else ""
        n = len(context) + 1
        count, discount = levels[n - 1]
        after = [c for g, c in count.items() if g[:-1] == context]
        below = p(symbol, context[1:]) if context else 1 / 0x110000
        if not after:
            return below
        return max(count.get(context + symbol, 0) - discount, 0) / sum(after) + discount * len(after) / sum(after) * below

    return lambda w: sum(math.log(p(s[i], s[:i])) for s in ["\2" + w + "\3"] for i in range(1, len(s)))


@pytest.mark.parametrize("order", [1, 2, 5])
def test_model_equals_brute_force(order):
    rng = random.Random(order)
    counts = {"".join(rng.choice("abcé日") for _ in range(rng.randint(1, 7))): rng.randint(1, 5) for _ in range(40)}
    words = [*list(counts)[:15], "abc", "é", "z", "aza", "abcabcabcabc", "日日日", "\U00010330a"]
    got = language_id.log_probabilities(language_id.fit(counts, order), words)
    want = brute(counts, order)
    assert np.allclose(got, [want(w) for w in words], atol=1e-5)


def test_model_is_a_distribution():
    model = language_id.fit({"ab": 3, "aab": 2, "b": 1, "abba": 1}, 3)
    codes = "".join(map(chr, range(97, 123)))
    # all words of one letter, by their first symbol: the mass that is left goes to other code points and to an end at once
    total = sum(math.exp(x) for x in language_id.log_probabilities(model, [c + d for c in "ab" for d in codes]) if x)
    assert total < 1


def test_rejects_what_it_has_not_learnt(spark):
    rng = random.Random(4)
    syllables = {"xx": ["ba", "bo", "lu", "mi"], "yy": ["kra", "sto", "gri", "pel"]}
    text = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(lang, rng.randint(1, 80)), lang) for i, lang in enumerate(["xx", "yy"] * 150)]
    odd = [(1000, " ".join("".join(rng.choices("qwzvj", k=6)) for _ in range(40)), None), (1001, text("yy", 40), None)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert sum(got[i]["rejected"] for i, _, _ in rows) <= 12
    assert got[1000]["rejected"] and not got[1001]["rejected"] and got[1001]["lang_pred"] == "yy"


def test_odd_input(spark, documents, messy, nothing):
    docs = documents.drop("score").selectExpr("*", "case when doc_id % 7 = 0 then null when doc_id % 2 = 0 then 'aa' else 'bb' end as lang", "'z' as lang_pred", "1.5 as bits", "'z' as size")
    found = language_id.identify(docs)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score", "bits", "rejected"]
    rows = found.collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(i for i, _ in messy)
    texts = dict(messy)
    for r in rows:
        if r["doc_id"] is not None:
            letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert (r["lang_pred"] != "und") == letters and (r["bits"] is not None) == letters
            assert letters or (r["score"] == 0 and r["rejected"])
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    unlabelled = language_id.identify(docs.withColumn("lang", docs["lang_pred"].substr(5, 1)).where("false").unionByName(docs.selectExpr("*").withColumn("lang", docs["lang"].substr(9, 0))).where("lang is null"))
    assert {r["lang_pred"] for r in unlabelled.collect()} <= {"und"}
    assert language_id.identify(nothing.selectExpr("*", "'x' as lang")).count() == 0


def test_sample_is_bounded(spark):
    rows = [(i, "word " * (i % 9 + 1), ["aa", "aa", "bb", "bb", "bb", "cc"][i % 6]) for i in range(600)] + [(9999, "long " * 5000, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen = language_id.sample(docs, "doc_id", "text", "lang", 4, 2, max_langs=2, max_docs=50, max_chars=700).collect()
    by = collections.defaultdict(list)
    for r in chosen:
        by[r["lang"]].append(r["text"])
    assert set(by) == {"aa", "bb"}
    assert all(len(t) <= 50 and 0 < sum(map(len, t)) <= 700 for t in by.values())
    assert not any("long" in t for t in by["bb"])
