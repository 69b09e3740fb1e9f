import collections
import hashlib

import pytest

from tessera.llm import substrings


def brute(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "hot"), [(33, 10_000), (60, 1), (400, 10_000), (33, 3), (150, 1)])
def test_against_brute_force(documents, messy, length, hot):
    want = sorted((-1 if i is None else i, *x) for (i, _), x in zip(messy, brute([(t or "").encode() for _, t in messy], length)))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.duplicates(documents, length=length, hot_group=hot).collect())
    assert got == want


def test_rows_stay_whole(documents, nothing, messy):
    out = substrings.remove_repeats(documents, length=60)
    assert out.columns == documents.columns
    kept = {r["doc_id"]: r for r in out.where("doc_id is not null").collect()}
    assert kept[21]["text"] == dict(messy)[21] and kept[21]["gram"] == "z"  # nothing repeats here
    assert 3 not in kept  # all of it repeats
    assert [r["text"] for r in out.where("text is null").collect()] == [None, None]
    assert substrings.remove_repeats(nothing, length=60).count() == 0


def test_runs_of_few_words_stay(spark):
    """Only runs of at least min_words whole words are removed; the shorter passage is longer in bytes."""
    many, few = " ".join(f"w{i}" for i in range(60)), " ".join(f"longerword{i:03d}" for i in range(30))
    texts = [f"first one {many} then {few} end", f"second {few} and {many} over", "nothing here repeats " * 1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(docs, length=100, min_words=51).collect()}
    assert left[2] == texts[2]
    assert all(few in left[i] and many[10:-10] not in left[i] for i in (0, 1))


def test_whole_words():
    data = b"one two three four"
    assert substrings.whole_words(data, 0, 18) == 4 and substrings.whole_words(data, 1, 18) == 3
    assert substrings.whole_words(data, 3, 9) == 1 and substrings.whole_words(data, 4, 7) == 1 and substrings.whole_words(data, 5, 6) == 0


def test_bytes_decide_where_keys_collide():
    import numpy as np

    data = np.frombuffer(b"abcdefghabcdxyz!", np.uint8)
    at = np.array([0, 8, 4, 12])
    assert substrings.equals(data, at, np.zeros(4, np.uint64), 4).tolist() == [True, True, False, False]
    assert substrings.equals(data, at, np.array([7, 7, 9, 9], np.uint64), 4).tolist() == [True, True, False, False]


def test_runs_of_one_character(spark):
    """A constant or periodic text is a few rows of anchors, not one for each byte."""
    found = substrings.anchors(b"a" * 20_000 + b"xyz" * 5_000, 60, 15, 1)
    assert sum(len(f[0]) for f in found) < 200
    assert sum(int((f[1] * f[5]).sum()) for f in found) == 35_000 - 59


def test_long_texts_are_parted(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 128)
    import random

    rng = random.Random(1)
    a = "".join(rng.choice("abcdef") for _ in range(900))
    b = "".join(rng.choice("ghijkl") for _ in range(333)) + a[100:700]
    for x in (a, b):
        starts = [(int(s), int(n)) for f in substrings.anchors(x.encode(), 60, 15) for s, n in zip(f[0], f[1])]
        assert starts[0][0] == 0 and all(s + n == t for (s, n), (t, _) in zip(starts, starts[1:])) and sum(starts[-1]) == len(x) - 59
