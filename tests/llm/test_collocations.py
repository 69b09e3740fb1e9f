import collections
import random
import re

import numpy as np
import pytest

from tessera.llm import collocations, queries
from tests import oracle

SF = "/root/testdata/sf0.01"


def brute(rows, least=10, most=2000):
    """Rows (lang, text) to rows of top(), by counters."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        kept = []
        for p, a in count.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in count.items()):
                continue
            cuts = [(1000000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:most], 1)]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = ["the", "of", "a", "été", "x\x00y", "\x1f", "New", "york", "new", "City", "Ünder", "ß"] + [f"w{i}" for i in range(25)]
    weight = [30, 20, 15] + [4] * (len(vocabulary) - 3)
    out = []
    for i in range(150):
        w = rng.choices(vocabulary, weight, k=rng.randint(0, 120))
        out.append((rng.choice(["en", "fr", None, "und", "en"]), "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n"]) for x in w)))
    return out + [("en", None), (None, ""), ("de", "in the new york"), ("en", "in new york city " * 400), ("en", "...,,, \n"), out[3], out[3]]


@pytest.mark.parametrize("bounds", [{}, {"shard_words": 50, "range_words": 60}, {"shard_words": 300, "range_words": 20}])
def test_top_equals_brute_force(spark, rows, bounds):
    docs = spark.createDataFrame([(t, lang, "z", "z", 1) for lang, t in rows], "text string, lang string, phrase string, depth string, a int").repartition(3)
    got = sorted(tuple(r) for r in collocations.top(docs, **bounds).collect())
    assert got == sorted(brute(rows)) and len(got) > 40
    assert [tuple(r) for r in collocations.top(docs, min_count=40, most=5, **bounds).orderBy("lang", "rank").collect()] == sorted(brute(rows, 40, 5))


def test_nothing(spark, nothing):
    assert collocations.top(nothing.selectExpr("text", "'en' as lang")).count() == 0
    rare = spark.createDataFrame([("a b c", "en"), (None, None), ("", "en")], "text string, lang string")
    assert collocations.top(rare).count() == 0


def test_packed_tries_round_trip():
    shard = collocations.Shard()
    for text in (b"a b c. a b, a", b"b b b b", b"", b"c a b\x00 a b c"):
        shard.add(collocations.tokens(text))
    words, paths, counts = shard.paths()
    got = collocations.unpack(collocations.pack(words, paths, counts))
    assert got[0] == words and np.array_equal(got[1], paths) and np.array_equal(got[2], counts)
    every = [tuple(words[i - 1] if i else b"" for i in p) for p in paths.tolist()]
    assert every == sorted(every)
    for path in [*every, (b"", b"", b""), (b"a", b"", b""), (b"a", b"bb", b""), (b"aa", b"b", b""), (b"zz", b"", b""), (b"b", b"b", b"zz")]:
        assert collocations.lower_bound(words, paths, path) == sum(e < path for e in every)
    both = collocations.merge([got, collocations.unpack(collocations.pack(words, paths[3:5], counts[3:5]))])
    assert counts.sum() + counts[3:5].sum() == both[2].sum() and len(both[1]) == len(paths)


def test_scores_are_exact(spark):
    big = 10**13 + 7
    found = spark.createDataFrame([("en", "p q", 2, big, False, big + 3, False, 0, False), ("en", "p", 1, big + 3, False, 0, False, 0, False), ("en", "q", 1, 3 * big, False, 0, False, 0, False)], collocations.NODES_DDL)
    assert collocations.scored(found).first()["score"] == 1000000 * big * big // ((big + 3) * 3 * big)


def test_query_equals_sql(spark):
    oracle.same(queries.op12_collocations(spark, SF), queries.ORACLE["op12_collocations"], oracle.connect(SF))


def test_tries_of_more_words_than_fit_a_key(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(30)] + ["."], k=200)).encode() for _ in range(6)]

    def tries():
        out = []
        for part in (texts[:3], texts[3:]):
            shard = collocations.Shard()
            for t in part:
                shard.add(collocations.tokens(t))
            out.append(shard.paths())
        return [*out, collocations.merge(out)]

    want = tries()
    monkeypatch.setattr(collocations, "KEYS", 100)
    for a, b in zip(want, tries()):
        assert a[0] == b[0] and np.array_equal(a[1], b[1]) and np.array_equal(a[2], b[2])
