import numpy as np
import pytest

from tessera.llm import embeddings, queries
from tests import oracle
from tests.llm.test_neardup import components


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = []
    for k in range(12):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 9)):
            out.append((len(out), (base + rng.standard_normal(16) * rng.choice([0, 0.05, 0.15])).astype(np.float32).tolist(), int(k % 3)))
    same = out[5]
    out += [(len(out) + k, same[1], same[2]) for k in range(5)] + [(200, same[1], 99), (201, same[1], None), (202, None, 1), (203, [], 1), (204, [0.0] * 16, 1), (205, [float("nan")] * 16, 1), (206, [None] + same[1][1:], 1), (207, same[1][:8], same[2])]
    return out


def ok(v):
    return v and all(x is not None and np.isfinite(x) for x in v) and any(v)


def close(x, y):
    if x[1] is None or x[1] != y[1] or not ok(x[0]) or not ok(y[0]) or len(x[0]) != len(y[0]):
        return False
    a, b = np.array(x[0], float), np.array(y[0], float)
    return a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98


@pytest.mark.parametrize("block", [2048, 2])
def test_against_all_pairs(spark, rows, block):
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "vec_id long, embedding array<float>, label int, rep string, copies string").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df, block=block).collect()}
    known = {r[0]: (r[1], r[2]) for r in rows}
    of = components(known, close)
    assert got == {i: (sum(close(known[i], known[j]) for j in known if j != i), of[i], of[i] == i) for i in known}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    oracle.same(queries.op10_embedding_dups(spark, sf), queries.ORACLE["op10_embedding_dups"], oracle.connect(sf))
