import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from tessera.llm import periodic, queries
from tests import oracle

SF = "/root/testdata/sf0.01"


def brute(s, least):
    """Every stretch that repeats with each period, but those within one of a smaller period."""
    found = []
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.append((i, j - i + q, q))
            i = j + 1
    return sorted((r for r in found if not any(o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in found)), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(250):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.choice([0, 1, 2, 7, 13, 25, 60, 90]), rng.choice([1, 2, 2, 3, 6])
            s = [rng.randint(1, k) for _ in range(n)]
            if n > 4 and rng.random() < 0.4:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(2, 6)
                s = [s[i if i < a else a + (i - a) % p] for i in range(n)]
            texts.append(s)
        got = periodic.find_runs([np.array(s, np.int64) for s in texts], least)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(s, least) for s in texts]


def test_long_texts():
    rng = np.random.default_rng(1)
    block = rng.integers(1, 50, 3000)
    tail = np.tile(block, 20)
    text = np.concatenate((rng.integers(1, 5000, 50_000), tail, [9999], np.full(40_000, 7)))
    runs = periodic.find_runs([text, np.zeros(0, np.int64), np.full(30_000, 3)])
    assert (50_000, 60_000, 3000) in {tuple(r) for r in runs[0].tolist()}
    assert (110_001, 40_000, 1) in {tuple(r) for r in runs[0].tolist()}
    assert runs[1].shape == (0, 3) and runs[2].tolist() == [[0, 30_000, 1]]


def test_next_smaller():
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 10, 40, 300):
        v = rng.permutation(n)
        want = [next((j for j in range(i + 1, n) if v[j] < v[i]), n) for i in range(n)]
        assert periodic.next_smaller(v, n).tolist() == want
    assert periodic.next_smaller(np.arange(100), 100).tolist() == [100] * 100


def expected(number, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(number).encode()) if number is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(w, 12)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    digests = [sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{length},{q}\n" for s, length, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (number, len(runs), *top, 1000 * top[1] // top[2] if runs else None, *digests)


def test_odd_input(spark, documents, messy, nothing):
    more = [(10 * i + 7, ("a b\tc \n" * i + "x ") * 3) for i in range(30)] + [(900 + i, "z " * i) for i in range(20)]
    docs = documents.select("doc_id", "text", "start", "id", "rest").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = periodic.digest(periodic.detect(periodic.repeat_tails(docs)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    as_key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=as_key) == sorted((expected(i, t) for i, t in messy + more), key=as_key)
    assert periodic.digest(periodic.detect(periodic.repeat_tails(nothing))).count() == 0


def test_query_equals_sql(spark):
    oracle.same(queries.op13_periodic_runs(spark, SF), queries.ORACLE["op13_periodic_runs"], oracle.connect(SF))
