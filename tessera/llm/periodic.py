"""Periodic runs of words by the runs theorem.

Words of a document become numbers, and its suffixes are ordered (many documents at once, each for itself) by prefix
doubling. Under an order of the words the longest Lyndon word at a place ends before the next smaller value of the inverse
suffix array, and under the opposite order before the next greater one. Every run has, under one of the two orders, a
Lyndon root that is such a longest Lyndon word; so each of these words, at most two a place, is extended to both sides, and
is a run's root if the stretch with its period is at least twice as long. Extensions are longest common prefixes: minima
of the LCP array between two ranks, from a sparse table; to the left the same on reversed words, built only for documents
with a root that may still be one after a few words have been compared.

A run is (start, length, period): a stretch of words with smallest period ``period``, of at least ``min_length`` words and
two periods, that neither neighbour extends. The collapsed text keeps, of each run, the first period.

Memory is bounded by ``BATCH_WORDS`` or the words of one document, whichever is more: some 200 bytes a word.

Defined results: null and empty texts, and texts of white space, have no words, no runs and an empty collapsed text; runs of
one text may overlap or lie within each other, a word goes if any of them repeats it; null ids and repeated rows each get
their row; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import sliced

BATCH_WORDS = 400_000
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND_DDL = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Suffixes:
    """Order of the suffixes of several sequences of positive numbers, laid out one after another with a 0 behind each.

    ``rank`` is the inverse suffix array; suffixes of earlier sequences come first, a sequence's end is its smallest."""

    def __init__(self, numbers: np.ndarray, of: np.ndarray):
        self.numbers, n = numbers, len(numbers)
        width = int(numbers.max(initial=1)).bit_length()
        depth = max(1, min(4, (63 - int(of[-1] if n else 0).bit_length()) // width))
        key, here, open_ = of.astype(np.int64) << width | numbers, numbers, numbers > 0
        for _ in range(depth - 1):
            here = np.append(here[1:], 0)
            open_ = np.append(open_[1:], False) & open_ if _ else open_
            key = key << width | np.where(open_, here, 0)
            open_ = open_ & (here > 0)
        suffix = np.argsort(key)
        sorted_key = key[suffix]
        first = np.append(True, sorted_key[1:] != sorted_key[:-1])
        rank = np.empty(n, np.int64)
        rank[suffix] = np.flatnonzero(first)[np.cumsum(first) - 1]
        self.depth, self.levels = depth, []
        slots, length = _unresolved(np.arange(n), first), depth
        while len(slots):
            self.levels.append((length, rank.astype(np.int32)))
            at = suffix[slots]
            key = rank[at] * (n + 1) + rank[at + length]
            by = np.argsort(key)
            key = key[by]
            suffix[slots] = at[by]
            first = np.append(True, key[1:] != key[:-1])
            rank[at[by]] = slots[np.flatnonzero(first)[np.cumsum(first) - 1]]
            slots, length = slots[_unresolved(np.arange(len(slots)), first)], length * 2
        self.suffix, self.rank = suffix, rank
        self._table(of)

    def _table(self, of: np.ndarray) -> None:
        """Minima of the LCP array over stretches of 1, 2, 4, ... ranks."""
        n = len(self.suffix)
        lcp = np.zeros(n, np.int32)
        slot = np.arange(1, n)
        slot = slot[of[self.suffix[slot]] == of[self.suffix[slot - 1]]]
        a, b = self.suffix[slot - 1], self.suffix[slot]
        for length, rank in reversed(self.levels):
            more = np.flatnonzero(rank[a] == rank[b])
            a[more] += length
            b[more] += length
        going = np.arange(len(slot))
        for _ in range(self.depth):
            going = going[(self.numbers[a[going]] == self.numbers[b[going]]) & (self.numbers[a[going]] > 0)]
            a[going] += 1
            b[going] += 1
        lcp[slot] = a - self.suffix[slot - 1]
        self.levels = []
        self.minima = [lcp]
        longest = int(np.bincount(of).max(initial=1))
        while 2 << len(self.minima) - 1 <= longest:
            half, low = 1 << len(self.minima) - 1, self.minima[-1]
            self.minima.append(np.minimum(low, np.append(low[half:], np.zeros(min(half, n), np.int32))))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at two different places of one sequence."""
        low, high = np.minimum(self.rank[i], self.rank[j]) + 1, np.maximum(self.rank[i], self.rank[j])
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level).tolist():
            m = np.flatnonzero(level == k)
            out[m] = np.minimum(self.minima[k][low[m]], self.minima[k][high[m] - (1 << k) + 1])
        return out


def _unresolved(slots: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Slots whose group has more than one member; first: where a group begins."""
    return slots[~(first & np.append(first[1:], True))]


def next_smaller(values: np.ndarray, longest: int) -> np.ndarray:
    """For each place, the first later one with a smaller value; the length of the array if none. Values are not
    negative, and the next smaller one is within ``longest`` places or there is none."""
    n = len(values)
    levels = max(1, int(longest + 1).bit_length())
    values = np.concatenate((values, np.full(2 << levels, -1, values.dtype)))
    out, going = np.full(n, n), np.arange(n)
    for step in range(1, 9):
        done = values[going + step] < values[going]
        out[going[done]] = going[done] + step
        going = going[~done]
    minima = [values]
    for k in range(levels):
        half = 1 << k
        minima.append(np.minimum(minima[-1], np.append(minima[-1][half:], np.full(half, -1, values.dtype))))
    at, value = going + 9, values[going]
    for k in reversed(range(levels + 1)):
        on = minima[k][np.minimum(at, n)] > value
        at = np.where(on, at + (1 << k), at)
    out[going] = np.minimum(at, n)
    return out


def find_runs(sequences: list[np.ndarray], min_length: int = 12) -> list[np.ndarray]:
    """Runs of each sequence of positive numbers: rows of start, length, period, sorted by start, then period."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    if not lengths.sum():
        return [np.zeros((0, 3), np.int64) for _ in sequences]
    begin = np.cumsum(lengths + 1) - lengths - 1
    of = np.repeat(np.arange(len(sequences)), lengths + 1)
    numbers = np.zeros(len(of), np.int64)
    numbers[np.arange(len(of)) != (begin + lengths)[of]] = np.concatenate(sequences)
    order = Suffixes(numbers, of)
    end, longest = (begin + lengths)[of], int(lengths.max()) + 1
    place = np.flatnonzero(numbers)
    smaller = next_smaller(order.rank, longest)[place]
    greater = next_smaller(len(of) - order.rank, longest)[place]
    inner = greater < end[place]  # without a greater one, the word is no longest Lyndon word of a run
    i, j = np.concatenate((place, place[inner])), np.concatenate((smaller, greater[inner]))
    period = j - i
    need = np.maximum(period, min_length - period)  # words that both extensions must have together
    before = np.where(i > begin[of[i]], numbers[i - 1], -1)
    fits = (2 * period <= lengths[of[i]]) & ((numbers[i] == numbers[j]) | (before == numbers[j - 1]))
    i, j, period, need = i[fits], j[fits], period[fits], need[fits]
    right = np.zeros(len(i), np.int64)
    same = np.flatnonzero(numbers[i] == numbers[j])
    right[same] = order.common(i[same], j[same])
    del order
    for step in range(1, 6):  # most roots end after few words
        back = i - step
        equal = (back >= begin[of[i]]) & (numbers[np.maximum(back, 0)] == numbers[np.maximum(j - step, 0)])
        fits = equal | (right + step - 1 >= need)
        i, j, period, need, right = i[fits], j[fits], period[fits], need[fits], right[fits]
    left = np.zeros(len(i), np.int64)
    if len(i):
        some = np.unique(of[i])
        mirrored = [numbers[begin[d] : begin[d] + lengths[d]][::-1] for d in some.tolist()]
        shift = np.zeros(len(sequences), np.int64)
        sizes = lengths[some] + 1
        shift[some] = np.cumsum(sizes) - sizes
        back = Suffixes(np.concatenate([np.append(m, 0) for m in mirrored]), np.repeat(np.arange(len(some)), sizes))
        inside = np.flatnonzero(i > begin[of[i]])
        # the word before place x of document d stands at this place of the mirrored ones
        mirror = lambda x: shift[of[x]] + begin[of[x]] + lengths[of[x]] - x
        jj = np.minimum(j[inside], end[i[inside]])
        left[inside] = back.common(mirror(i[inside]), shift[of[i[inside]]] + end[i[inside]] - jj)
    fits = left + right >= need
    i, period, left, right = i[fits], period[fits], left[fits], right[fits]
    rows = np.unique(np.stack((of[i], i - left - begin[of[i]], period, left + period + right), 1), axis=0)
    cut = np.searchsorted(rows[:, 0], np.arange(len(sequences) + 1))
    return [rows[cut[d] : cut[d + 1]][:, [1, 3, 2]] for d in range(len(sequences))]


def repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth)[:n] > 0


class _Numbers(defaultdict):
    """Numbers of words, from 1, in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 12) -> DataFrame:
    """Per row: the id, n_words, runs (start, length, period; sorted by start, then period) and collapsed (the kept words,
    joined by a blank). Words are what white space (0x20, 0x09 to 0x0D) parts."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [(t or b"").split() for t in b.column(1).cast(pa.binary()).to_pylist()]
            start, size = 0, 0
            for k, w in enumerate(texts):
                if size and size + len(w) > BATCH_WORDS:
                    yield found(b.column(0).slice(start, k - start), texts[start:k])
                    start, size = k, 0
                size += len(w)
            yield found(b.column(0).slice(start), texts[start:])

    def found(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        number = _Numbers()
        runs = find_runs([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in texts], min_length)
        kept = [b" ".join(compress(w, (~repeated(r, len(w))).tolist()) if len(r) else w) for w, r in zip(texts, runs)]
        every = np.concatenate(runs)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in runs])), pa.int32()), pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], fields=list(RUN)))
        return pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in texts], pa.int64()), lists, pa.array(kept, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string(FOUND_DDL)])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_runs; start, length, period and exponent_milli of the longest run (ties: smallest start, then period; nulls without
    a run); SHA-256 of all runs as lines ``start,length,period`` and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), lines.alias("lines"), "collapsed")
    start, length, period = -F.col("top.start"), F.col("top.length"), -F.col("top.period")
    exponent = F.floor(length * 1000 / period).cast("long")
    return out.select(id_col, "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text, where in one of ten documents (h = crc32 of the id as text, h % 10 = 0) the words from place g % n on
    (g = h / 10) repeat their first 1 + (n - g % n) / (3 + g % 8), so that many texts have long runs."""
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col), h.alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    a: Column = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    planted = F.array_join(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.get("words", F.when(i < a, i.cast("long")).otherwise(a + (i - a) % p).cast("int"))), " ")
    return rows.select(id_col, F.when((F.col("h") % 10 == 0) & (F.size("words") > 0), planted).otherwise(F.col(text_col)).alias(text_col))
