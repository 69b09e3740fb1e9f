"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Items are normalised to words and put, in blocks of bounded size, into one suffix automaton
each. Every document is streamed past it while the state and the length of the longest match
that ends at each word are tracked. A match of at least ``window`` words is an occurrence of
windows; an item shorter than that is one window as a whole. Runs of words whose adjacent
pairs do not all occur in items cannot hold a window and are skipped beforehand.

Defined results: null and empty texts have no words and no hits; items without words have no
window; repeated item ids count once; an empty item table leaves every document clean; other
columns of the input are ignored. Documents are never shuffled unless the items need more than
one block, and then only their hits are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, encoded, sliced, words
from tessera.llm.substrings import merged

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
OUT = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("block", pa.int32()), ("n_words", pa.int64()), ("spans", SPANS), ("items", pa.list_(pa.string()))])
DDL = "id long, text_hash long, block int, n_words long, spans array<struct<start: long, end: long>>, items array<string>"
CUT = pa.schema([("row", pa.int64()), ("text", pa.string())])
WORD = regex.compile(rb"[0-9A-Za-z\x80-\xff]+")
BITS = 1 << 22


class Automaton:
    """Generalised suffix automaton over word numbers, with the items behind each window."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        numbered = []
        pairs: list[int] = []
        self.least = window
        for name, item in items:
            if item:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in item]
                numbered.append((name, ids))
                self.least = min(self.least, len(ids))
                pairs += [self.pair(a, b) for a, b in zip(ids, ids[1:])]
                self.add(ids)
        self.pairs = np.zeros(BITS, bool)
        self.pairs[np.array(pairs, np.int64)] = True
        n = len(self.next)
        order = sorted(range(n), key=self.len.__getitem__)
        #: the state of the last ``window`` words of a match in each state
        self.base = [0] * n
        for v in order[1:]:
            self.base[v] = v if self.len[self.link[v]] < window else self.base[self.link[v]]
        held: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for name, ids in numbered:
            v = 0
            for k, c in enumerate(ids):
                v = self.next[v][c]
                if k + 1 >= window:
                    held.setdefault(self.base[v], set()).add(name)
            if len(ids) < window:
                short.setdefault(v, []).append((len(ids), name))
        self.held = {v: frozenset(s) for v, s in held.items()}
        self.short: list[tuple] = [()] * n
        if short:
            for v in order[1:]:
                self.short[v] = (*short.get(v, ()), *self.short[self.link[v]])

    @staticmethod
    def pair(a, b):
        return (a * 2654435761 + b * 40503) % BITS

    def copy(self, v: int, length: int) -> int:
        self.next.append(dict(self.next[v]) if v >= 0 else {})
        self.link.append(self.link[v] if v >= 0 else 0)
        self.len.append(length)
        return len(self.next) - 1

    def add(self, ids: list[int]) -> None:
        last = 0
        for c in ids:
            last = self.extend(last, c)

    def split(self, p: int, c: int, q: int) -> int:
        """The state of the words of p and c when q also holds longer ones."""
        new = self.copy(q, self.len[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def extend(self, p: int, c: int) -> int:
        q = self.next[p].get(c)
        if q is not None:
            return q if self.len[q] == self.len[p] + 1 else self.split(p, c, q)
        new = self.copy(-1, self.len[p] + 1)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self.split(p, c, q)
        return new

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words that may hold a window."""
        if len(ids) < self.least:
            return []
        known = ids >= 0
        if self.least > 1:
            a, b = ids[:-1], ids[1:]
            good = known[:-1] & known[1:]
            good &= self.pairs[self.pair(a, b)]
            need = self.least - 1
        else:
            good, need = known, 1
        edges = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        keep = ends - starts >= need
        return list(zip(starts[keep].tolist(), (ends[keep] + (self.least > 1)).tolist()))

    def scan(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal hit spans of a document's words, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        ids = np.fromiter(map(self.vocabulary.get, doc, repeat(-1)), np.int64, len(doc))
        follow, link, length, window, short = self.next, self.link, self.len, self.window, self.short
        for start, end in self.runs(ids):
            v = n = 0
            for k, c in enumerate(ids[start:end].tolist(), start):
                to = follow[v].get(c)
                while to is None and v:
                    v = link[v]
                    n = length[v]
                    to = follow[v].get(c)
                if to is None:
                    n = 0
                    continue
                v, n = to, n + 1
                hit = 0
                if n >= window:
                    hit = n
                    items |= self.held[self.base[v]]
                for m, name in short[v]:
                    if m <= n:
                        hit = max(hit, m)
                        items.add(name)
                if hit:
                    a = k + 1 - hit
                    while spans and spans[-1][1] >= a:
                        a = min(a, spans.pop()[0])
                    spans.append((a, k + 1))
        return spans, items


def blocks(items: DataFrame, item_id: str, item_text: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Item words in blocks of at most block_words (or one item), read one after another."""
    block, size = [], 0
    for row in items.select(F.col(item_id).cast("string"), F.col(item_text).cast("string")).toLocalIterator():
        w = words(row[1])
        if row[0] is None or not w:
            continue
        if block and size + len(w) > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], w))
        size += len(w)
    if block:
        yield block


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = 100_000) -> DataFrame:
    """One row per document: id, n_words, spans (hit words, from and to), items (ids as sorted strings).

    At most block_words words of items are in an automaton, which is what a task holds; more
    items make more passes over the documents, whose hits are merged by document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    context = docs.sparkSession.sparkContext
    passes = []
    for block in blocks(items, item_id, item_text, block_words) if window > 0 else ():
        shared = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, block=len(passes)) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(shared.value, window)
            for b in sliced(batches):
                found = [(len(w := words(t)), *automaton.scan(w)) for t in b.column(1).to_pylist()]
                yield batch(OUT, id=b.column(0), text_hash=b.column(2), block=[block] * b.num_rows, n_words=[n for n, _, _ in found], spans=[[{"start": s, "end": e} for s, e in x] for _, x, _ in found], items=[sorted(x) for _, _, x in found])

        passes.append(rows.mapInArrow(run, DDL))
    if not passes:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                n = [len(words(t)) for t in b.column(1).to_pylist()]
                yield batch(OUT, id=b.column(0), text_hash=b.column(2), block=[0] * b.num_rows, n_words=n, spans=[[]] * len(n), items=[[]] * len(n))

        return rows.mapInArrow(count, DDL).drop("text_hash", "block")
    if len(passes) == 1:
        return passes[0].drop("text_hash", "block")
    # hits of several blocks: the lists of a text are bounded by its own words and the blocks; copies of a row are counted
    every = passes[0]
    for x in passes[1:]:
        every = every.unionByName(x)
    found = F.collect_set(F.struct("block", "spans", "items"))
    by_text = every.groupBy("id", "text_hash").agg(F.max("n_words").alias("n_words"), found.alias("found"), (F.count(F.lit(1)) / len(passes)).cast("int").alias("rows"))
    by_text = by_text.select("id", "n_words", F.flatten("found.spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten("found.items"))).alias("items"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row"))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            spans = [[{"start": s, "end": e} for s, e in merged([(s["start"], s["end"]) for s in x])] for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, SPANS), b.column(3)], names=["id", "n_words", "spans", "items"])

    return by_text.drop("row").mapInArrow(grown, "id long, n_words long, spans array<struct<start: long, end: long>>, items array<string>")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of what find() gives: n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each span."""
    data = encoded(text)
    ends = [m.span() for m in WORD.finditer(data)]
    out, at = [], 0
    for start, end in spans:
        out.append(data[at : ends[start][0]])
        at = ends[end - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, min_span: int = 1, max_coverage: float = 0.5, block_words: int = 100_000) -> DataFrame:
    """Documents without what is contaminated: hit spans of at least min_span words are cut out of the text, and a
    document of which more than max_coverage of the words are hit goes. All columns of docs stay. One pass where items are
    one block; more blocks are each scanned against the whole text, and their hits are merged before anything is judged or cut."""
    context = docs.sparkSession.sparkContext
    at = docs.columns.index(text_col)
    shared = [context.broadcast(block) for block in blocks(items, item_id, item_text, block_words)]
    if not shared:
        return docs

    def cleaned(columns: list[pa.Array], schema: pa.Schema, found: Iterable[list[tuple[int, int]]]) -> pa.RecordBatch:
        texts, keep = columns[at].to_pylist(), []
        for k, spans in enumerate(found):
            spans = [s for s in spans if s[1] - s[0] >= min_span]
            keep.append(not spans or sum(e - s for s, e in spans) <= max_coverage * len(words(texts[k])))
            if spans and keep[-1]:
                texts[k] = cut_words(texts[k], spans)
        columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays(columns, schema=schema).filter(pa.array(keep, pa.bool_()))

    if len(shared) == 1:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(shared[0].value, window)
            for b in sliced(batches):
                yield cleaned(b.columns, b.schema, [automaton.scan(words(t))[0] for t in b.column(at).to_pylist()])

        # numbers as names meanwhile, for mapInArrow() takes columns by unquoted names
        plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
        return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.select(F.sha2(text, 256).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = docs.select(F.sha2(text, 256).alias("key"), text.alias("text")).where("text is not null")

    def scans(block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(block.value, window)
            for b in sliced(batches):
                found = [automaton.scan(words(t))[0] for t in b.column(1).to_pylist()]
                spans = pa.array([[{"start": s, "end": e} for s, e in x] for x in found], SPANS)
                yield pa.RecordBatch.from_arrays([b.column(0), spans], names=["key", "spans"]).filter(pa.array([bool(x) for x in found], pa.bool_()))

        return rows.mapInArrow(run, "key string, spans array<struct<start: long, end: long>>")

    hits = reduce(DataFrame.unionByName, map(scans, shared))
    # equal texts have equal hits, so a text's lists are bounded by its own words and the blocks
    hits = hits.groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("spans"))

    def run_merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [merged([(s["start"], s["end"]) for s in x or ()]) for x in b.column(1).to_pylist()]
            columns = b.column(0).flatten()
            yield cleaned(columns, pa.schema([pa.field(f.name, f.type, f.nullable) for f in b.column(0).type]), found)

    return keyed.join(hits, "key", "left").select("row", "spans").mapInArrow(run_merged, docs.schema)
