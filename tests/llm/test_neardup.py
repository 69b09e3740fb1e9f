import collections
import re

import numpy as np
import pytest

from tessera.llm import neardup


def bag(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def components(rows, linked):
    parent = {i: i for i in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linked(rows[a], rows[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {a: find(a) for a in ids}


def similar(x, y):
    if x is None or y is None:
        return False
    both = sum((x & y).values())
    return both >= 0.8 * (sum(x.values()) + sum(y.values()) - both) - 1e-9


@pytest.mark.parametrize("most", [1, 3, 20])
def test_signature_is_unbiased(most):
    rng = np.random.default_rng(most)
    a, b = {}, {}
    for h in rng.integers(1, 1 << 62, 300).tolist():
        a[h] = int(rng.integers(1, most + 1))
        b[h] = a[h] if rng.random() < 0.7 else int(rng.integers(0, most + 1))
    both = sum(min(a[h], b[h]) for h in a) / sum(max(a[h], b[h]) for h in a)
    as_bag = lambda d: (np.array(sorted(h for h in d if d[h]), np.uint64), np.array([d[h] for h in sorted(d) if d[h]]))
    s = neardup.signatures([as_bag(a), as_bag(b)], 4096)
    assert abs((s[0] == s[1]).mean() - both) < 0.03


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_classes(documents, messy, block):
    want = components({i: bag(t) for i, t in messy if i is not None}, similar)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(documents, block_words=block).where("doc_id is not null").collect()}
    assert got == want


def test_many_in_one_cluster():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 62, 100).astype(np.uint64)
    bags = []
    for k in range(60):
        h = base.copy()
        h[rng.choice(100, k % 14, False)] = rng.integers(1, 1 << 62, k % 14).astype(np.uint64)
        bags.append((np.sort(h), np.ones(100, np.int64)))
    sets = [set(h.tolist()) for h, _ in bags]
    want = components(dict(enumerate(sets)), lambda x, y: len(x & y) >= 0.8 * len(x | y))
    links = neardup.verify(bags, None, 0.8)
    assert components({i: i for i in range(60)}, lambda x, y: (x, y) in {(min(p), max(p)) for p in links}) == want
    assert len(links) == 60 - len(set(want.values()))


def test_keep_one(documents, nothing, messy):
    want = components({i: bag(t) for i, t in messy if i is not None}, similar)
    kept = [r["doc_id"] for r in neardup.keep_one(documents).select("doc_id").collect()]
    assert sorted(i for i in kept if i is not None) == sorted(i for i, _ in messy if i is not None and want[i] == i)
    assert kept.count(None) == 2
    assert neardup.classes(nothing).count() == 0


def test_ids_of_several_texts(spark):
    """Rows of one id are one document: a link of any of its texts is the document's."""
    rng = np.random.default_rng(9)
    text = lambda: " ".join(f"w{i}" for i in rng.integers(0, 1000, 60))
    a, b, c, d = text(), text(), text(), text()
    near = lambda t, k: " ".join([*t.split()[:-1], f"changed{k}"])
    for rows in (
        [(1, a), (5, a), (5, b), (7, b)],
        [(5, b), (5, c), (5, c), (7, near(c, 1)), (8, near(b, 2)), (3, near(d, 3)), (8, d), (9, None), (9, ""), (10, text())],
        [(2, a), (4, a), (4, b), (6, b), (6, c), (8, c), (8, d), (9, d), (None, a)],
    ):
        bags = collections.defaultdict(list)
        for i, t in rows:
            if i is not None:
                bags[i].append(bag(t))
        want = components(bags, lambda x, y: any(similar(p, q) for p in x for q in y))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect() if r["doc_id"] is not None} == want
        kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in neardup.keep_one(docs).collect())
        assert kept == sorted((i or 0, t or "") for i, t in rows if i is None or want[i] == i)
