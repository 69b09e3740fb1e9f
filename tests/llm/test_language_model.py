import collections
import math
import re
import zlib

import numpy as np
import pytest

from tessera.llm import language_model as lm
from tessera.llm import succinct


@pytest.mark.parametrize(("n", "universe"), [(1, 1), (10, 5), (1000, 100_000), (5000, 3000), (1000, 1 << 40)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    values, i = np.sort(rng.integers(0, universe, n)), rng.integers(0, n, 500)
    assert (succinct.access(succinct.elias_fano(values, universe), i) == values[i]).all()


@pytest.mark.parametrize("width", [1, 7, 23, 33, 63])
def test_packed(width):
    rng = np.random.default_rng(width)
    values, i = rng.integers(0, 1 << width, 1000), rng.integers(0, 1000, 500)
    assert (succinct.unpack(succinct.pack(values, width), width, i) == values[i]).all()


def test_blocks():
    keys, n = np.array([-5, 0, 3, 1 << 60]), np.array([1, 2, 3, 4])
    k, m = lm.from_block(lm.to_block(keys, n))
    assert (k == keys).all() and (m == n).all()


@pytest.mark.parametrize(("segment", "least"), [(200_000, (1, 2)), (40, (2, 2)), (200_000, (1, 1))])
def test_scores_against_dictionaries(documents, messy, nothing, monkeypatch, segment, least):
    monkeypatch.setattr(lm, "SEGMENT", segment)
    docs = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b"\n"]) for i, t in messy]
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    train = [s for i, s in docs if not out(i)]
    c1 = collections.Counter(w for s in train for w in s)
    total, kinds = sum(c1.values()), len(c1)
    marked = [[b"\r", *s] for s in train]
    c2 = {k: n for k, n in collections.Counter(p for s in marked for p in zip(s, s[1:])).items() if n >= least[0]}
    c3 = {k: n for k, n in collections.Counter(p for s in marked for p in zip(s, s[1:], s[2:])).items() if n >= least[1]}
    kept2, kept3 = collections.defaultdict(float), collections.defaultdict(float)
    for k, n in c2.items():
        kept2[k[0]] += n - 0.75
    for k, n in c3.items():
        kept3[k[:2]] += n - 0.75
    context = {**c1, b"\r": len(train)}

    def p1(w):
        return (c1.get(w, 0) + 0.1) / (total + 0.1 * (kinds + 1))

    def p2(a, w):
        rest = 1 - kept2[a] / context[a] if a in kept2 else 1
        return ((c2[a, w] - 0.75) / context[a] if (a, w) in c2 else 0) + rest * p1(w)

    def p3(a, b, w):
        if (a, b) not in c2:
            return p2(b, w)
        rest = 1 - kept3[a, b] / c2[a, b] if (a, b) in kept3 else 1
        return ((c3[a, b, w] - 0.75) / c2[a, b] if (a, b, w) in c3 else 0) + rest * p2(b, w)

    # probabilities after a context add up to 1
    assert abs(sum(p2(docs[0][1][0], w) for w in c1) + p2(docs[0][1][0], b"unknown") - 1) < 1e-9
    rows = lm.score(documents, least=least).collect()
    assert len(rows) == len(messy)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for i, s in docs:
        if i is not None:
            r, f = by_id[i], [b"\r", *s]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(i), len(s), sum(w in c1 for w in s), total)
            assert abs(r["base_score"] - sum(math.log10(p1(w)) for w in s)) < 1e-6
            want = sum(math.log10(p2(f[0], f[1]) if k == 1 else p3(f[k - 2], f[k - 1], f[k])) for k in range(1, len(f)))
            assert abs(r["score"] - want) < 2e-4 * len(s) + 1e-9
    assert lm.score(nothing).count() == 0


def test_without_training_texts(spark):
    r = lm.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (3, 0, 0, 0.0)


def test_counts_are_added_up_into_shards(spark, monkeypatch):
    """No single count goes through a sort or an aggregate of Spark; a context that fills several shards leaves one mass."""
    texts = [" ".join(f"the x{(7 * i + k) % 500}" for k in range(20)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("id", "text", "id < 0 as held_out").repartition(3)

    def refuse(*_, **__):
        raise AssertionError("counts pass through Spark row by row")

    for name in ("repartitionByRange", "groupBy", "agg"):
        monkeypatch.setattr(type(docs), name, refuse)
    model, _ = lm.train(docs)
    pairs = collections.Counter(p for t in texts for p in zip(["\r", *t.split()], [*t.split(), "\n"]))
    assert int(model.pairs.offset[-1]) == len(pairs) and len(model.pairs.paths) > 1
    the = model.numbers(lm.hashes("the")[1:2])
    assert the[0] in model.pairs.split
    n = sum(c for (a, _), c in pairs.items() if a == "the")
    kinds = sum(a == "the" for a, _ in pairs)
    rest = lm.mass_left(model.pairs.rest(the, model.size))[0]
    assert abs(math.log10(rest) - math.log10(0.75 * kinds / n)) <= lm.STEP
