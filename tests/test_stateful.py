"""Breakers and answer caches: hand-worked sequences; streams with late and unordered rows and a restart equal the batch."""

import datetime as dt
import random

import pytest

from tessera.streaming import stateful

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def spans(df):
    return sorted((r["service"], r["start"], r["state"], r["end"], r["attempts"], r["rejected"]) for r in df.collect())


def test_breaker_by_hand(spark):
    events = [(1, 0, True), (2, 10, False), (3, 20, False), (4, 30, False), (5, 40, True), (6, 200, False), (7, 330, False), (8, 340, False), (9, 350, True), (10, 360, False), (11, 430, False), (12, 440, False), (13, 441, False), (14, 2000, True)]
    df = spark.createDataFrame([("s", i, at(t), ok) for i, t, ok in events] + [("t", 1, at(0), None), ("t", 2, at(61), False), ("t", 3, at(62), False), ("t", 4, at(63), False), (None, 5, at(1), True), ("u", 6, None, True)], "s string, id long, at timestamp, ok boolean")
    assert spans(stateful.breaker(df, "s", "id", "at", "ok")) == [
        # three failures within 60 s of the first; two attempts are rejected; at 330 the cooldown is over: half open for no time
        ("s", at(0), "closed", at(30), 4, 0), ("s", at(30), "open", at(330), 2, 2), ("s", at(330), "closed", at(441), 7, 0), ("s", at(330), "half_open", at(330), 0, 0),
        ("s", at(441), "open", at(741), 0, 0), ("s", at(741), "half_open", at(2000), 0, 0),
        # the first failure's window is over at 61: that one begins another
        ("t", at(0), "closed", at(63), 4, 0),
    ]


def test_breaker_reopens_within_the_window():
    b = stateful.Breaker(2, 100_000, 10_000)
    got = [s for now, ok in ((0, False), (1000, False), (5000, True), (11_000, False)) for s in b.attempt(now, ok)]
    assert got == [("closed", 0, 1000, 2, 0), ("open", 1000, 11_000, 1, 1), ("half_open", 11_000, 11_000, 0, 0), ("closed", 11_000, 11_000, 1, 0)]
    assert b.state == "open" and b.open_until == 21_000


def streamed(spark, tmp_path, schema, parts, make):
    """What a stream over files gives that stops and restarts from its checkpoint after each of them."""
    stateful.needs_rocksdb(spark)
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = make(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    return spark.read.parquet(out)


def test_breaker_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"s{rng.randrange(3)}", i, at(rng.randrange(4000)), rng.random() < 0.4) for i in range(250)]
    order = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rng.randrange(250)))  # out of order, within the delay
    late = [("s0", 9000, at(1), False)]  # behind the watermark of the second part: dropped
    end = [(f"s{k}", 9001 + k, at(90_000), True) for k in range(3)]
    schema = "s string, id long, at timestamp, ok boolean"
    make = lambda df: stateful.breaker(df, "s", "id", "at", "ok", delay="300 seconds")
    got = streamed(spark, tmp_path, schema, [order[:100], order[100:], late + end, [("s9", 1, at(200_000), True)]], make)
    assert spans(got) == spans(make(spark.createDataFrame(rows + end, schema))) and got.count() > 20


def test_cache_by_hand(spark):
    rows = [("u", 1, 0, "a", [1.0, 0.0], "A"), ("u", 2, 10, "b", [0.99, 0.01], "B"), ("u", 3, 20, "c", [0.0, 1.0], None), ("u", 4, 30, "d", [0.0, 1.0], "D"), ("u", 5, 3600, "e", [1.0, 0.0], "E"), ("u", 6, 3601, "f", [1.0, 0.0], "F"), ("u", 7, 3602, "g", [2.0, 0.0], "G"), ("v", 8, 3602, "h", [1.0, 0.0], "H"), ("v", 9, 3603, "i", [0.0, 0.0], "I")]
    df = spark.createDataFrame([(s, i, at(t), q, v, a) for s, i, t, q, v, a in rows], "s string, id long, at timestamp, q string, v array<double>, a string")
    got = {r["id"]: (r["hit"], r["question"], r["answer"]) for r in stateful.answers(df, "s", "id", "at", "q", "v", "a").collect()}
    assert got == {1: (False, None, "A"), 2: (True, "a", "A"), 3: (False, None, None), 4: (False, None, "D"), 5: (True, "a", "A"), 6: (False, None, "F"), 7: (True, "f", "F"), 8: (False, None, "H"), 9: (False, None, "I")}


@pytest.mark.parametrize("ttl", [400])
def test_cache_stream_equals_batch(spark, tmp_path, ttl):
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(8)]
    rows = [(f"u{rng.randrange(2)}", i, at(rng.randrange(3000)), f"q{i}", vectors[rng.randrange(8)], f"A{i}") for i in range(120)]
    order = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rng.randrange(250)))
    schema = "s string, id long, at timestamp, q string, v array<double>, a string"
    make = lambda df: stateful.answers(df, "s", "id", "at", "q", "v", "a", ttl=ttl, delay="300 seconds")
    late = [("u0", 9000, at(1), "late", vectors[0], "L")]
    got = streamed(spark, tmp_path, schema, [order[:60], order[60:], [*late, ("z", 9001, at(90_000), "end", vectors[0], "E")], [("z", 9002, at(200_000), "end", vectors[0], "E")]], make)
    mine = {(r["id"], r["hit"], r["question"], r["similarity"], r["answer"]) for r in got.where("scope <> 'z'").collect()}
    batch = make(spark.createDataFrame(rows, schema)).collect()
    assert mine == {(r["id"], r["hit"], r["question"], r["similarity"], r["answer"]) for r in batch}
    assert {h for _, h, *_ in mine} == {True, False}
