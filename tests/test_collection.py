"""Versions of a collection: crashes between steps, writers at once, lookups that skip files and row groups."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors
from tessera.sources.collection import Collection, Conflict

ROW = "point_id long, vector array<double>, payload struct<id: string, lang: string>"


def points(spark, *rows):
    return spark.createDataFrame([(i, v, (str(i), lang)) for i, v, lang in rows], ROW)


def held(c, number=None):
    return sorted((r["point_id"], r["vector"], r["payload"]["lang"]) for r in c.read(number).collect())


def test_versions(spark, tmp_path):
    c = Collection(spark, f"{tmp_path}/c")
    assert not c.exists()
    with pytest.raises(LookupError):
        c.read()
    c.ensure()
    assert c.ensure().number == 1 and c.count() == 0
    assert c.upsert(points(spark, (1, [1.0, 2.0], "a"), (2, [3.0, 4.0], "b"), (2, [3.0, 4.0], "b"), (None, [1.0, 1.0], "z"))) == 2
    assert c.upsert(points(spark, (2, [5.0, 6.0], "c"), (3, [7.0, 8.0], "d"))) == 2
    c.delete(spark.createDataFrame([(1,), (99,)], "point_id long"))
    assert held(c) == [(2, [5.0, 6.0], "c"), (3, [7.0, 8.0], "d")]
    assert held(c, 2) == [(1, [1.0, 2.0], "a"), (2, [3.0, 4.0], "b")]
    assert c.upsert(points(spark, (1, [0.0, 1.0], "again"))) == 1 and c.update(F.col("payload.lang") == "d", lang=F.lit("D")) == 1
    now = [(1, [0.0, 1.0], "again"), (2, [5.0, 6.0], "c"), (3, [7.0, 8.0], "D")]
    assert held(c) == now
    c.compact()
    assert held(c) == now and len(c.version().steps) == 1
    gone = c.vacuum(keep=1)
    assert held(c) == now and len(c.numbers()) == 1 and any(g.startswith("gone/") for g in gone)
    c.recreate()
    assert c.count() == 0 and held(c, c.numbers()[0]) == now


def test_wrong_points_change_nothing(spark, tmp_path):
    c = Collection(spark, f"{tmp_path}/c")
    c.upsert(points(spark, (1, [1.0, 2.0], "a")))
    with pytest.raises(ValueError, match="components"):
        c.upsert(points(spark, (2, [1.0], "b")))
    with pytest.raises(ValueError, match="differ"):
        c.upsert(points(spark, (2, [1.0], "b"), (3, [1.0, 2.0], "b")))
    with pytest.raises(ValueError, match="schema"):
        c.upsert(spark.createDataFrame([(2, [1.0, 2.0])], "point_id long, vector array<double>"))
    assert c.upsert(points(spark).limit(0)) == 0
    assert held(c) == [(1, [1.0, 2.0], "a")] and c.numbers() == [1]


def test_a_crash_leaves_the_last_version(spark, tmp_path, monkeypatch):
    """Every change is broken off at each of its steps; the version before stays whole and readable, and the change can be made again."""
    c = Collection(spark, f"{tmp_path}/c")
    c.upsert(points(spark, (1, [1.0], "a"), (2, [2.0], "b")))
    want = held(c)
    ids = spark.createDataFrame([(1,)], "point_id long")
    changes = {"upsert": (lambda: c.upsert(points(spark, (1, [9.0], "z"))), 3), "delete": (lambda: c.delete(ids), 2), "compact": (lambda: c.compact(), 2), "recreate": (lambda: c.recreate(), 1)}
    for change, steps in changes.values():
        for last in range(steps):
            calls = []

            def broken(name, good, calls=calls, last=last):
                def step(self, *args, **kw):
                    calls.append(name)
                    if len(calls) > last:
                        raise OSError("lost")
                    return good(self, *args, **kw)

                return step

            with monkeypatch.context() as m:
                for name in ("_write", "_commit"):
                    m.setattr(Collection, name, broken(name, getattr(Collection, name)))
                with pytest.raises(OSError, match="lost"):
                    change()
            assert held(Collection(spark, c.path)) == want and c.numbers() == [1] and len(calls) == last + 1
    changes["upsert"][0]()
    assert held(c) == [(1, [9.0], "z"), (2, [2.0], "b")]
    c.vacuum()
    assert held(c) == [(1, [9.0], "z"), (2, [2.0], "b")]


def test_writers_at_once(spark, tmp_path, monkeypatch):
    c, other = Collection(spark, f"{tmp_path}/c"), Collection(spark, f"{tmp_path}/c")
    c.upsert(points(spark, (1, [1.0], "a")))
    good, first = Collection._commit, []

    def slower(self, v):
        if self is c and not first:
            first.append(1)
            other.upsert(points(spark, (2, [2.0], "b")))  # takes the number that c is about to take
        return good(self, v)

    monkeypatch.setattr(Collection, "_commit", slower)
    c.upsert(points(spark, (3, [3.0], "c")))
    assert [i for i, _, _ in held(c)] == [1, 2, 3] and c.numbers() == [1, 2, 3]
    with pytest.raises(Conflict):
        good(c, c.version())


def scanned(df):
    """Rows that left the scans of a frame, once it has run."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            p = p.executedPlan()
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            found += p.metrics().get("numOutputRows").get().value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_lookups_skip_what_they_do_not_need(spark, tmp_path):
    """By range of the clustered column, and by bloom filter of one that is in no order."""
    c = Collection(spark, f"{tmp_path}/c")
    n = 40_000
    rows = spark.range(n).select(F.col("id").alias("point_id"), F.array(F.rand(1), F.rand(2)).alias("vector"), F.struct(F.format_string("doc-%06d", F.col("id")).alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("chunk_id"), F.when(F.col("id") % 2 == 0, "active").otherwise("expired").alias("status")).alias("payload"))
    c.upsert(rows)
    c.compact(cluster=["payload.doc_id"], bloom=["payload.chunk_id"], distinct=n, row_group=128 << 10)
    one = c.read().where("payload.doc_id = 'doc-012345'")
    assert scanned(one) < n / 4 and one.count() == 1
    key = c.read().where("point_id = 777").select("payload.chunk_id").first()[0]
    by_value = c.read().where(F.col("payload.chunk_id") == key)
    assert scanned(by_value) < n / 4 and by_value.first()["point_id"] == 777
    assert scanned(c.read().where(F.col("payload.chunk_id") == "0" * 64)) < n / 4


def test_edges_as_points(spark):
    e = spark.createDataFrame([("a", "b", "X", None), ("a", "b", "X", None), ("a", None, "X", 0.5), ("c", "d", "Y", 0.5)], "source_id string, target_id string, relation_type string, confidence double")
    got = sorted(((r["payload"]["source_id"], r["payload"]["confidence"]), r["vector"]) for r in vectors.edge_points(e, 3).collect())
    assert got == [(("a", 1.0), [1e-6] * 3), (("c", 0.5), [1e-6] * 3)]
