"""Token counts by heap-and-linked-list byte-pair merging.

For every pre-token the adjacent pairs go on a heap by merge rank; the lowest pair is
popped and merged in a doubly linked list until no ranked pair is left. The count is the
number of initial symbols less the number of merges, so no identifiers are built.

Counts of white-space separated chunks are kept in a bounded two-generation cache of the
Python worker; texts are never joined, sorted or shuffled.

Defined results: null and empty texts have no tokens; repeated rows each get their row;
an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, encoded, sliced

#: The Unicode White_Space characters, and separators that str.split takes besides them.
WHITE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")

OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
CACHE_ENTRIES, CACHE_CHARS = 250_000, 48


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges byte-pair encoding makes of these symbols."""
    n = len(symbols)
    if n < 2:
        return 0
    get = ranks.get
    heap = [(rank, i) for i in range(n - 1) if (rank := get((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return 0
    heapq.heapify(heap)
    after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    symbols = symbols[:]
    while heap:
        rank, i = heapq.heappop(heap)
        left = symbols[i]
        j = after[i]
        if left is None or j >= n or get((left, symbols[j])) != rank:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = left + symbols[j], None
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return merges


class Cache:
    """What a function gives for strings, for the last CACHE_ENTRIES to twice as many short ones."""

    def __init__(self, of):
        self.of, self.young, self.old = of, {}, {}

    def get(self, key: str) -> int:
        n = self.young.get(key)
        if n is None:
            n = self.old.get(key)
            if n is None:
                n = self.of(key)
            if len(key) <= CACHE_CHARS:
                if len(self.young) >= CACHE_ENTRIES:
                    self.old, self.young = self.young, {}
                self.young[key] = n
        return n


class Counter:
    """Counts tokens as the vocabulary file says: its normaliser, pre-tokeniser, merges and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        assert model["type"] == "BPE" and not model.get("continuing_subword_prefix"), "a BPE vocabulary is needed"
        self.end = model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.lower, self.pattern = False, None
        for x in (spec["normalizer"] or {}).get("normalizers", []):
            assert x["type"] in ("NFC", "Replace", "Lowercase"), x["type"]
            self.lower |= x["type"] == "Lowercase"
        for x in spec["pre_tokenizer"]["pretokenizers"]:
            if x["type"] == "Split":
                self.pattern = regex.compile(x["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.alphabet = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.chunks, self.tokens = Cache(self.chunk), Cache(self.pretoken)

    def pretoken(self, token: str) -> int:
        symbols = [self.alphabet[b] for b in token.encode()]
        symbols[-1] += self.end
        return len(symbols) - merge_count(symbols, self.ranks)

    def plain(self, chunk: str) -> int:
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        if self.lower:
            chunk = chunk.lower() if chunk.isascii() else "".join(c.lower() for c in chunk)
        return sum(map(self.tokens.get, self.pattern.findall(chunk)))

    def chunk(self, chunk: str) -> int:
        if self.marks is None or "<" not in chunk or not (found := self.marks.findall(chunk)):
            return self.plain(chunk)
        return len(found) + sum(self.plain(x) for x in self.marks.split(chunk) if x)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        chunks = WHITE.split(text) if ODD_SPACE.search(text) else text.split()
        found = list(map(self.chunks.young.get, chunks))
        if None in found:
            get = self.chunks.get
            return sum(get(chunk) if n is None else n for chunk, n in zip(chunks, found) if chunk)
        return sum(found)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for b in batches:
            texts = b.column(1).to_pylist()
            yield batch(OUT, id=b.column(0), n_bytes=[len(encoded(t)) for t in texts], n_tokens=[count(t) for t in texts])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
