import hashlib
import random
import re

import pytest

from tessera.llm import decontaminate, queries
from tests import oracle


def brute(items, doc, window):
    hit, found = set(), set()
    for name, w in items:
        for x in [w] if 0 < len(w) < window else [w[k : k + window] for k in range(len(w) - window + 1)]:
            for k in range(len(doc) - len(x) + 1):
                if x and doc[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    found.add(name)
    return hit, found


@pytest.mark.parametrize("seed", range(150))
def test_automaton(seed):
    rng = random.Random(seed)
    alphabet = [bytes([97 + i]) for i in range(rng.choice([2, 3, 5]))]
    window = rng.choice([3, 4, 10])
    items = [(str(i), [rng.choice(alphabet) for _ in range(rng.randint(0 if seed % 3 == 0 else 3, 14))]) for i in range(rng.randint(1, 5))]
    doc = [rng.choice([*alphabet, b"z"]) for _ in range(rng.randint(0, 60))]
    spans, found = decontaminate.Automaton(items, window).scan(doc)
    assert ({k for s, e in spans for k in range(s, e)}, found) == brute(items, doc, window)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("block", [100_000, 12])
def test_whole_operator(spark, documents, messy, block):
    source = [t for _, t in messy if t and len(t.split()) > 40]
    items = [(1, " ".join(source[0].split()[5:30])), (2, "ONE"), (3, None), (4, ""), (5, " ".join(source[3].split()[2:14]).upper()), (6, "never seen at all"), (6, "never seen at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.digest(decontaminate.find(documents, bench, window=10, block_words=block)).collect())
    want = []
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for i, t in messy:
        hit, found = brute([(str(k), words(x)) for k, x in items], words(t), 10)
        want.append((-1 if i is None else i, len(words(t)), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    assert got == sorted(want)


def test_removal_keeps_clean_documents(spark, documents, nothing):
    bench = spark.createDataFrame([(1, "p q r s t u v w x y")], "item_id long, text string")
    rows = [(1, "lead in words here and more of them, so it stays. P q r, s t u v w x y! The end"), (2, "p q r s t u v w x y"), (3, None), (4, "clean")]
    out = {r["doc_id"]: r["text"] for r in decontaminate.remove(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert out == {1: "lead in words here and more of them, so it stays. ! The end", 3: None, 4: "clean"}
    assert decontaminate.remove(documents, nothing, item_id="doc_id").count() == documents.count()
    assert decontaminate.digest(decontaminate.find(nothing, bench)).count() == 0


@pytest.mark.parametrize("turn", [1, -1])
@pytest.mark.parametrize("block", [100_000, 12, 1])
def test_removal_whatever_the_blocks(spark, block, turn):
    w = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(w[:12])), (2, " ".join(w[20:32])), (3, " ".join(w[6:18])), (4, " ".join(w[40:46] + w[48:54]))][::turn]
    rest = [f"r{i}" for i in range(40)]
    docs = {
        1: w[:12] + rest[:6] + w[20:32] + rest[6:12],  # each item hits a third, both hit more than half
        2: rest[:20] + w[:18] + rest[20:],  # overlapping windows of two items
        3: rest[:20] + w[40:46] + w[:12] + w[48:54] + rest[20:],  # words around a cut are no window
        4: rest[:30],
        5: rest[:20] + w[:12] + w[20:32] + rest[20:],
    }
    rows = [(i, "x", " ".join(t)) for i, t in docs.items()] + [(2, "y", " ".join(docs[2])), (None, "x", " ".join(docs[5])), (6, "x", None), (7, "x", "")]
    want = []
    for i, spans, text in rows:
        t = (text or "").split()
        hit, _ = brute([(str(k), x.split()) for k, x in items], t, 10)
        if len(hit) <= 0.5 * len(t):
            want.append((i or -1, spans, text and " ".join(x for k, x in enumerate(t) if k not in hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.remove(spark.createDataFrame(rows, "doc_id long, spans string, text string"), bench, block_words=block)
    assert out.columns == ["doc_id", "spans", "text"]
    assert sorted((r["doc_id"] or -1, r["spans"], r["text"] and " ".join(r["text"].split())) for r in out.collect()) == sorted(want)
    assert {1} == {i for i in docs if i not in {x for x, _, _ in want}}


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    oracle.same(queries.op1_decontaminate(spark, sf), queries.ORACLE["op1_decontaminate"], oracle.connect(sf))
