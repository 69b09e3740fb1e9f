import collections
import re
import zlib

import numpy as np

from tessera.llm import queries, quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op8_quality(spark, SF).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    good, bad = [r["score"] for r in held if r["quality"]], [r["score"] for r in held if not r["quality"]]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9


def test_odd_input(spark, documents, messy, nothing):
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(60)] + [(1, 0, "z"), (2, None, "z"), (None, 1, "z"), (3, 7, "z")], "doc_id long, quality int, score string")
    out = quality.score(documents, labels)
    assert out.columns == [c for c in documents.columns if c not in ("held_out", "score")] + ["held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == len(messy) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    empty = {r["score"] for r in rows if not r["text"]}
    assert len(empty) == 1
    assert {r["score"] for r in quality.score(documents, labels.limit(0)).collect()} == {0.5}
    assert quality.score(nothing, labels).count() == 0


def test_ftrl_learns_signs():
    model = quality.Ftrl(4, 1.0, 1.0, 0.0, 1.0)
    for _ in range(50):
        model.learn(np.array([1, 16]), np.array([1.0, 1.0]), 1)
        model.learn(np.array([2, 16]), np.array([1.0, 1.0]), 0)
    w = model.weights(slice(None))
    assert w[1] > 0.5 > -0.5 > w[2] and w[3] == 0


def brute(docs, labels, bits=20, passes=3, alpha=1.0, beta=1.0, l1=0.05, l2=1.0):
    """Scores of (id, text) rows by plain loops over dictionaries: the same tokens, hashes and order of learning."""
    wide = (1 << 64) - 1

    def features(text):
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+", (text or "").encode())
        codes, before = [], None
        for t in tokens:
            code = zlib.crc32(t)
            if code == before:
                codes.append(0x9E3779B1)
            elif t.isupper() and len(t) > 2:
                codes += [0x85EBCA6B, zlib.crc32(t.lower())]
            else:
                codes.append(code)
            before = code
        every = [c * 0xD6E8FEB86659FD93 & wide for c in codes] + [(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & wide for a, b in zip(codes, codes[1:])]
        return collections.Counter(((x ^ x >> 29) * 0xBF58476D1CE4E5B9 & wide) >> (64 - bits) for x in every)

    def vector(text):
        f = features(text)
        return {k: float(np.float32(n / np.sqrt(max(1, sum(f.values()))))) for k, n in f.items()} | {-1: 1.0}

    crc = lambda i: zlib.crc32(str(i).encode())
    known = {}
    for i, label in labels:
        if i is not None and label in (0, 1) and crc(i) % 5:
            known[i] = max(label, known.get(i, 0))
    texts = {}
    for i, t in docs:
        if i in known:
            texts[i] = min((x for x in (t, texts.get(i)) if x is not None), default=None)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - np.sign(z[k]) * l1) / ((beta + np.sqrt(n[k])) / alpha + l2)

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))

    for _ in range(passes):
        for i in sorted(texts, key=lambda i: (crc(i), i)):
            x = vector(texts[i])
            w = {k: weight(k) for k in x}
            p = sigmoid(sum(w[k] * v for k, v in x.items()))
            for k, v in x.items():
                g = (p - known[i]) * v
                z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
    out = []
    for _, t in docs:
        f = features(t)
        out.append(sigmoid(sum(weight(k) * c for k, c in f.items()) / np.sqrt(max(1, sum(f.values()))) + weight(-1)))
    return out


def test_scores_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()]
    want = {i: p for (i, _), p in zip(docs, brute(docs, labels))}
    got = {r["doc_id"]: r["score"] for r in queries.op8_quality(spark, sf).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_accepted_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 7.5), (2, None, 8.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [tuple(r) for r in quality.accepted(docs, labels).orderBy("doc_id").collect()] == [(1, "a b", 7.5), (2, None, 8.5)]
