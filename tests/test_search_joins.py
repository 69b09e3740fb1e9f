"""Vector lists, similarity joins and aliases against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aliases, similarity, vector_index, vectors
from tessera.plans import ranking

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def cloud(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 16))
    points = middles[rng.integers(0, 12, 600)] + 0.4 * rng.normal(size=(600, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(points)] + [(700, points[3].tolist()), (701, points[3].tolist()), (702, [0.0] * 16), (703, [1.0, 2.0]), (704, None), (None, points[1].tolist()), (705, [float("nan")] * 16)]
    docs = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    path = f"{tmp_path_factory.mktemp('lists')}/ivf"
    vector_index.write(docs, "id", "v", path, lists=12)
    return docs, path


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_every_row_is_in_one_list(spark, cloud):
    docs, path = cloud
    stored = vector_index.read_vectors(spark, path)
    assert sorted(r["id"] for r in stored.collect()) == sorted(r["id"] for r in docs.where("id is not null and v is not null").collect())
    heads = {r["list"]: r for r in spark.read.parquet(f"{path}/lists").collect()}
    assert {r["id"] for r in stored.where("list = -1").collect()} == {702, 703, 705}
    assert sum(h["n"] for h in heads.values()) == stored.count()


@pytest.mark.parametrize("block", [4096, 7])
def test_exact_search_equals_all_rows(spark, cloud, block):
    docs, path = cloud
    asked = docs.where("id % 20 = 0 or id in (703, 702)")
    mine = ranked(vector_index.search(spark, path, asked, "id", "v", 10, probes=2, exact=True, block=block))
    assert mine == ranked(vectors.compare(docs, asked, "id", "id", "v", 10, None, block=block))


def test_recall_of_probed_lists(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = e.where("vec_id % 20 = 0")
    want = {(q, v) for q, _, v, _ in ranked(vectors.compare(e, asked, "vec_id", "vec_id", "embedding", 10, None))}
    got = {(q, v) for q, _, v, _ in ranked(ranking.knn_lists(spark, SF))}
    assert len(got & want) >= 0.9 * len(want)


def test_search_reads_probed_folders_only(spark, cloud):
    _, path = cloud
    plan = vector_index.read_vectors(spark, path).where(F.col("list").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_scores_that_round_up_to_the_threshold(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.2999997, (1 - 0.2999997**2) ** 0.5]), (2, [0.2999994, (1 - 0.2999994**2) ** 0.5])], "id long, v array<double>")
    got = vectors.compare(e, e.where("id = 0"), "id", "id", "v", None, 0.3).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 0.3)]


def test_no_vectors(spark, tmp_path):
    vector_index.write(spark.createDataFrame([], "id long, v array<double>"), "id", "v", f"{tmp_path}/e")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    assert vector_index.search(spark, f"{tmp_path}/e", asked, "id", "v").count() == 0


@pytest.mark.parametrize("threshold", [0.25, 0.5, 0.8, 1.0])
def test_jaccard_pairs_equal_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 100))
    sets = [["common", *(f"t{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(0, 12)))] for _ in range(120)]
    sets += [s[:-1] if len(s) > 2 else s for s in sets[:30]] + [["common"]] * 5 + [[], None, ["x", "x"], ["x"]]
    left, right = [(i, s) for i, s in enumerate(sets)], [(f"r{i}", s) for i, s in enumerate(sets[::2])]
    a, b = spark.createDataFrame(left, "id long, w array<string>"), spark.createDataFrame(right, "k string, w array<string>")
    got = sorted((r["left_id"], r["right_id"], r["jaccard"]) for r in similarity.jaccard_pairs(a, b, "id", "k", F.col("w"), F.col("w"), threshold).collect())
    alike = lambda x, y: round(len(set(x) & set(y)) / len(set(x) | set(y)), 6) if x and y else 0
    assert got == sorted((i, k, alike(x, y)) for i, x in left for k, y in right if alike(x, y) >= threshold)


def test_frequent_tokens_do_not_meet(spark):
    """Every set has one common token; only sets that share a rarer one are compared."""
    rows = spark.range(400).select("id", F.array(F.lit("common"), F.concat(F.lit("a"), F.col("id") % 200), F.concat(F.lit("b"), F.col("id") % 200), F.concat(F.lit("c"), F.col("id"))).alias("w"))
    got = similarity.jaccard_pairs(rows, rows, "id", "id", F.col("w"), F.col("w"), 0.6).where("left_id < right_id")
    assert sorted((r["left_id"], r["right_id"]) for r in got.collect()) == [(i, i + 200) for i in range(200)]
    with pytest.raises(ValueError, match="threshold"):
        similarity.jaccard_pairs(rows, rows, "id", "id", F.col("w"), F.col("w"), 0)


def test_copies_are_counted_and_frequent_heads_end_where_they_meet(spark):
    """3,000 copies of a set are nine million pairs that no plan makes; sets without rare tokens are told apart by their bits."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(150)]
    sets = [rng.sample(words, 60) for _ in range(150)]
    sets += [[*s[:-2], "x", "y"] for s in sets[:20]]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, w array<string>").unionByName(spark.range(1000, 4000).select("id", F.array(*map(F.lit, sets[0])).alias("w")))
    table = similarity.jaccard_counts(rows, "id", F.col("w"), 0.8)
    plain = [(a, b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8]
    assert len(plain) == 40
    assert {r["jaccard"]: r["pairs"] for r in table.collect()} == {1.0: 3001 * 3000, round(58 / 62, 6): 38 + 2 * 3001}


def test_aliases_equal_brute_force(spark):
    rng = random.Random(6)
    names = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(40)})
    texts = ["".join(rng.choice("abéc ") for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    table = spark.createDataFrame([(a, i % 7, f"n{i}") for i, a in enumerate(names)] + [("", 0, "none"), (None, 0, "none"), (names[0], 99, "later")], "alias string, o int, name string")
    order = [a for _, a in sorted((i % 7, a) for i, a in enumerate(names))]
    for block in (50_000, 9):
        numbers = aliases.numbered(table, "alias", "o")
        assert [r["alias"] for r in numbers.orderBy("alias_no").collect()] == order
        found = aliases.matches(df, "id", "t", numbers, block)
        every = {(i, order.index(a), k, k + len(a)) for i, t in enumerate(texts) for a in names for k in range(len(t or "")) if (t or "").startswith(a, k)}
        assert {tuple(r) for r in found.collect()} == every and found.count() == len(every)
        want = set()
        for i, t in enumerate(texts):
            at = 0
            while at < len(t or ""):
                fits = [a for a in names if t.startswith(a, at)]
                if fits:
                    a = max(fits, key=len)
                    want.add((i, order.index(a), at, at + len(a)))
                    at += len(a)
                else:
                    at += 1
        assert {tuple(r) for r in aliases.leftmost_longest(found, "id").collect()} == want
        called = {a: f"n{i}" for i, a in enumerate(names)}
        looked = {r["id"]: r["name"] for r in aliases.lookup(df, "id", "t", table, "alias", "name", "o", "other", block).collect()}
        assert looked == {i: next((called[a] for a in order if t and a in t), "other") for i, t in enumerate(texts)}


def test_many_aliases_do_not_grow_the_plan(spark):
    table = spark.range(50_000).select(F.concat(F.lit("name "), "id", F.lit(";")).alias("alias"), "id", F.col("id").cast("string").alias("name"))
    df = spark.createDataFrame([(1, "so name 49999; and name 7;"), (2, "name 50000;"), (3, None)], "k int, t string")
    found = aliases.lookup(df, "k", "t", table, "alias", "name", "id", "none", block=20_000)
    assert {r["k"]: r["name"] for r in found.collect()} == {1: "7", 2: "none", 3: "none"}
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert aliases.lookup(df, "k", "t", table.limit(0), "alias", "name", "id", "none").where("name = 'none'").count() == 3
