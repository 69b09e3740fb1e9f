"""Sequence packing by patterns: non-negative least squares over few-piece length patterns.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. The histogram of
piece lengths (at most ``capacity`` numbers) goes to the driver, where patterns of one to three
lengths that fill a sequence are enumerated, repeat counts are fitted to the histogram by
non-negative least squares, and rounded down. What they leave is packed best fit, longest
first, on the histogram as well. Pieces then take their places by their rank among the pieces
of their length, which follows from counts by task and length; no length, and no document,
gathers in one task.

Defined results: null and empty texts are one end token; repeated rows are packed each by
itself; an empty table gives no pieces; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import batch, sliced, written

PIECES = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
PIECES_DDL = "id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACED_DDL = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: The byte-level pre-tokeniser's pattern, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same where no two white spaces are adjacent; without the look-ahead it is searched faster.
SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
ADJACENT = re.compile(r"\s\s")
#: Characters beyond these two planes go to the library untested.
PLANES = 0x20000


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, as the tokenizers library gives them.

    Where the vocabulary allows it, texts are encoded by the same vocabulary as ranks, several times faster. Both engines
    split by letters, numbers and white space; when the encoder is built, the characters on whose class they do not agree
    are found by asking both about every character of two planes. Texts with such a character, with a later one or with
    a special token go to the library itself, and the encoder refuses ranks that do not give the library's ids on a probe."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = self.ranks(path)
        self.twin = self.any = None
        if ranks:
            self.twin, self.any = (tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) for name, pattern in (("single", SINGLE), ("any", PATTERN)))
            odd = "".join(f"\\U{c:08x}" for c in disputed())
            self.hard = re.compile(f"[{odd}\U00020000-\U0010ffff\ud800-\udfff]")
            if any(self.raw([x])[0] != self.ids(x) for x in PROBES):
                self.twin = self.any = None

    @staticmethod
    def ranks(path: str) -> dict[bytes, int] | None:
        """The vocabulary as ranks, where ids are merge ranks and nothing is normalised; None where the file is of another kind."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or spec["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            return None
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = [ranks[bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        return ranks if merged == sorted(merged) else None

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, text: str) -> bytes:
        """Ids of a text that holds nothing hard."""
        return np.array((self.any if ADJACENT.search(text) else self.twin).encode_ordinary(text), "<u4").tobytes()

    def texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its ids; null is empty."""
        for t in texts:
            if not t:
                yield b""
            elif self.twin is None or any(x in t for x in self.special) or not t.isascii() and self.hard.search(t):
                yield self.raw([t])[0]
            else:
                yield self.ids(t)


#: Texts on which ranks and library must agree before ranks are used.
PROBES = ("It's 12:30, don't  wait!\n\n\tWe'll   \r\n go", " lead and trail ", "naïve Ünïcode ½ ٣ 日本語 \u00a0\u3000x\u2028y", "a1b2 c--d ...'re 'S 's", "\x00\x1c\x85 \u200b\ufeffz", "aaaa" * 60)


def disputed() -> list[int]:
    """Code points of two planes that the two engines do not class alike as letter, number or white space."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(chr(c) for c in range(PLANES) if not 0xD800 <= c < 0xE000)
    bytes_only = {bytes([b]): b for b in range(256)}
    odd: set[str] = set()
    for kind, other in ((r"\p{L}", r"\P{L}"), (r"\p{N}", r"\P{N}"), (r"\s", r"\S")):
        mine = bytes(tiktoken.Encoding("kind", pat_str=f"{kind}+", mergeable_ranks=bytes_only, special_tokens={}).encode_ordinary(every)).decode()
        theirs = pre_tokenizers.Split(Regex(f"{other}+"), "removed").pre_tokenize_str(every)
        odd |= set(mine) ^ set("".join(x for x, _ in theirs))
    return sorted(map(ord, odd))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of at most capacity tokens. Only longer documents are cut, and only their first piece may be shorter.
    part and nth: the task that made the piece, and its number among the task's pieces of its length."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for b in sliced(batches):
            out: list[list] = [[] for _ in PIECES]
            for doc, ids in zip(b.column(0).to_pylist(), encode.texts(b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    length = (n - 1) % capacity + 1 if at == 0 else capacity
                    for column, x in zip(out, (doc, piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), part, seen[length])):
                        column.append(x)
                    seen[length] += 1
                    at, piece = at + length, piece + 1
            yield batch(PIECES, **{f.name: x for f, x in zip(PIECES, out)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES_DDL)


def patterns(lengths: np.ndarray, capacity: int, slack: int = 0) -> np.ndarray:
    """Patterns of up to three lengths that occur and fill a sequence but for ``slack`` tokens, one by row, padded with 0."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    rows = []
    for a in lengths[::-1].tolist():
        for total in range(capacity, capacity - slack - 1, -1):
            rest = total - a
            if rest == 0:
                rows.append(np.array([[a, 0, 0]]))
            elif rest > 0:
                if rest <= a and there[rest]:
                    rows.append(np.array([[a, rest, 0]]))
                b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
                b = b[there[b] & there[rest - b]]
                if len(b):
                    rows.append(np.stack([np.full(len(b), a), b, rest - b], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def fit(found: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts x that minimise |A x - histogram|, A's columns the patterns: multiplicative updates,
    which keep x non-negative and need only sums over patterns and over lengths."""
    target = histogram.astype(float).copy()
    target[0] = 0
    size = len(histogram)

    def made(x: np.ndarray) -> np.ndarray:
        y = np.bincount(found.ravel(), np.repeat(x, 3), size)
        y[0] = 0
        return y

    def gathered(y: np.ndarray) -> np.ndarray:
        return y[found].sum(1)

    x = np.full(len(found), max(target.sum() / max(1, 3 * len(found)), 1e-9))
    aim = gathered(target)
    for _ in range(rounds):
        x *= aim / np.maximum(gathered(made(x)), 1e-12)
    return x


@dataclass
class Plan:
    """Where the pieces of each length go. Sorted by (length, rank): from that rank on, pieces of that length go to
    sequences first + (rank - from) at offset."""

    bounds: np.ndarray  # of each length's rows below
    rank: np.ndarray
    first: np.ndarray
    offset: np.ndarray


def plan(histogram: np.ndarray, capacity: int) -> Plan:
    """A packing of so many pieces of each length (index 0 is unused)."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    made: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        made.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    found = patterns(np.flatnonzero(left), capacity)
    if len(found):
        repeat = fit(found, left)
        # rounded, the largest first, and never beyond what there is
        for k in np.argsort(-repeat, kind="stable"):
            n = int(round(repeat[k]))
            if n < 1:
                break
            lengths = [int(x) for x in found[k] if x]
            for x in set(lengths):
                n = min(n, int(left[x]) // lengths.count(x))
            if n:
                for x in lengths:
                    left[x] -= n
                made.append((tuple(lengths), n))
    made += best_fit(left, capacity)
    at: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    rank, sequence = [0] * (capacity + 1), 0
    for lengths, n in made:
        offset = 0
        for x in lengths:
            at[x].append((rank[x], sequence, offset))
            rank[x] += n
            offset += x
        sequence += n
    rows = np.array([r for a in at for r in a], np.int64).reshape(-1, 3)
    return Plan(np.cumsum([0, *map(len, at)]), rows[:, 0].copy(), rows[:, 1].copy(), rows[:, 2].copy())


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, for many pieces of a length at once: (lengths, so many sequences of them)."""
    room: dict[int, list[list]] = {}  # free tokens -> [lengths, count]
    for x in range(capacity, 0, -1):
        n = int(left[x])
        if not n:
            continue
        for free in sorted(r for r in room if r >= x):
            while n and room.get(free):
                lengths, count = room[free].pop()
                take = min(n, count * (free // x))
                each, odd = divmod(take, free // x)
                for copies, k in ((free // x, each), (odd, 1 if odd else 0)):
                    if k:
                        room.setdefault(free - copies * x, []).append([(*lengths, *[x] * copies), k])
                        count -= k
                if count:
                    room[free].append([lengths, count])
                n -= take
            if free in room and not room[free]:
                del room[free]
        if n:
            each, odd = divmod(n, capacity // x)
            for copies, k in ((capacity // x, each), (odd, 1 if odd else 0)):
                if k:
                    room.setdefault(capacity - copies * x, []).append([(x,) * copies, k])
    return [(tuple(lengths), count) for rows in room.values() for lengths, count in rows]


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    table = written(pieces(docs, vocabulary, end_id, capacity, id_col, text_col), "pieces")
    counts = table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        histogram[length] = n
    places = spark.sparkContext.broadcast(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = table.join(base, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        # one sorted key for (length, rank): ranks are below 2**48
        key = np.repeat(np.arange(capacity + 1), np.diff(p.bounds)) << 48 | p.rank
        for b in batches:
            rank = b.column(5).to_numpy()
            row = np.searchsorted(key, b.column(3).to_numpy() << 48 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(p.first[row] + rank - p.rank[row]), pa.array(p.offset[row])], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = ranked.mapInArrow(place, PLACED_DDL)
    return placed.withColumnRenamed("id", id_col)
