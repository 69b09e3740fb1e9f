import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("capacity", [1024, 64])
def test_pieces_are_the_documents(documents, messy, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for i, t in messy:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    rows = packing.pack(documents, PATH, capacity=capacity).collect()
    assert collections.Counter(tuple(r[:5]) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= capacity
    assert len(sequences) <= 1.1 * -(-sum(r["length"] for r in rows) // capacity) + 1


def test_plan_is_tight():
    rng = np.random.default_rng(0)
    lengths = np.minimum(256, rng.lognormal(4, 0.9, 50_000).astype(int) + 1)
    histogram = np.bincount(lengths, minlength=257)
    p = packing.plan(histogram, 256)
    used = {}
    for x in range(1, 257):
        rows = slice(p.bounds[x], p.bounds[x + 1])
        for rank, first, offset, end in zip(p.rank[rows], p.first[rows], p.offset[rows], [*p.rank[rows][1:], histogram[x]]):
            for k in range(end - rank):
                used.setdefault(first + k, []).append((offset, x))
    assert sum(map(len, used.values())) == len(lengths)
    assert all(sum(x for _, x in s) <= 256 for s in used.values())
    assert len(used) <= 1.01 * lengths.sum() / 256 + 1


def test_new_chunks_encode_as_the_library_does():
    tokenizer, encoder = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    assert encoder.twin
    texts = ["", " ", "a  b", " lead", "trail ", "tab\tx", "foo <|endoftext|> bar<|endoftext|>baz", "don't I'LL", "x" * 3000, "é ñ 日本語 😀 ½ ١٢٣", "a b", "l\n\n m \n n"]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.texts(texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_texts_encode_as_the_library_does():
    """Ids of invented texts of awkward characters, and of the test table's own, equal the library's."""
    tokenizer, encoder = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    rng = random.Random(4)
    pool = ["a", "é", " ", "\n", "  ", "'s", "'", "1", "½", "日", "\x85", "\x1c", "\u180e", "\u2028", "<|endoftext|>", "<|end", "!", "..", "Z", "\U0001f600", "\U00020001", "\U0001e030", "ß", "\u0378", "\t", "\r\n", "'LL", "\u0301"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x250, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(1000)]
    assert list(encoder.texts(texts)) == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder.hard = re.compile(".")  # as if no character's class were agreed on
    assert list(encoder.texts(texts[:500])) == encoder.raw(texts[:500])


def test_nothing(nothing):
    assert packing.pack(nothing, PATH).count() == 0
