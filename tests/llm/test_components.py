import random

import pytest

from tessera.llm.components import components


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_components(spark, bound):
    rng = random.Random(bound)
    edges = [(a, a + 1) for a in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)]
    edges += [(7, 7), (None, 3)] + [(500, k) for k in range(501, 560)]
    parent: dict[int, int] = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long"), local_edges=bound).collect()}
    assert got == {a: find(a) for a in list(parent)}


def test_none(spark):
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
