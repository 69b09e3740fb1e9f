"""Suffix-array de-duplication: removes every byte that a long repeated string covers.

A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same text or
another one. Sorting every suffix of the corpus is not needed for that. Each start of a long string
is owned by the smallest quarter-length gram's hash inside its string (winnowing, leftmost of equals), so equal strings are owned
by equal anchors at equal distance, and one anchor owns up to three quarters of that many neighbouring starts, its slice:

1. anchors are counted by gram; a gram that occurs once owns no repeated string, and ends here;
2. slices that occur twice as a whole are repeated throughout, by the count of a 128-bit digest of their bytes, whose seed
   each run draws anew. Equal slices that follow one another in a text (runs of one character, tables) are one row;
3. the other slices of repeated grams are range-partitioned by their anchor suffix's leading bytes,
   with Spark's sampled splitters; buckets sort the suffixes by multikey quicksort over 8-byte words,
   neighbours' common prefixes bound the starts that can be repeated at all, fingerprints of their whole strings
   propose equals, and their bytes are compared before any start counts as repeated. As a slice owns fewer starts than a
   string is long, what its repeated starts cover is one run, from the first to the last of them;
4. slices of grams with more than ``hot_group`` slices are parted first, into runs of a few starts each, and dealt by the
   bytes that all strings of a run have in common: of a line that many texts share, what follows and precedes it parts them. Runs
   that are alone end here, the others go to the buckets; only what still has more than ``hot_group`` members is never
   gathered in one bucket: its starts are counted by fingerprint with map-side combine. Fingerprints are polynomials modulo
   2**31-1 at two bases drawn anew by each run, beside the gram's hash and the anchor's distance: two different strings
   of n bytes agree with probability (n / 2**31)**2 at most, whatever the texts are.

Texts are shuffled once, by document.

Defined results: null and empty texts have no bytes and lose none; texts shorter than ``length``
lose none; repeated rows are each other's copies, so long ones lose everything; a null id is kept;
an empty table gives an empty table; other columns of the input are ignored. Removal cuts bytes: a
rest of a character that straddles a cut is left out of the text.
"""

from __future__ import annotations

import hashlib
import secrets
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WORD_TABLE, batch, encoded, sliced, written

BLOCK, PLACES = 1 << 17, 1 << 18
U = np.uint64
BASE, MIX, SALT = 0x9E3779B97F4A7C15, U(0xD6E8FEB86659FD93), U(0xBF58476D1CE4E5B9)
PRIME = U((1 << 31) - 1)
NO_ID = -(2**63)

ANCHORS = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("anchor", pa.int32()), ("gram", pa.int64()), ("slice", pa.binary()), ("times", pa.int64())])
ANCHORS_DDL = "id long, text_hash long, start long, n int, anchor int, gram long, slice binary, times long"
RUNS = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
RUNS_DDL = "id long, text_hash long, first long, last long"


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = np.full(n + 1, BASE, U), np.full(n + 1, pow(BASE, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=U)


def prefix_hashes(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTES[data] * up[: len(data)], out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * MIX
    return x ^ (x >> U(29))


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31-1, for x below 2**62."""
    x = (x & PRIME) + (x >> U(31))
    x = (x & PRIME) + (x >> U(31))
    return np.where(x >= PRIME, x - PRIME, x)


@dataclass
class Secret:
    """What a run draws anew, so that no text can be made to collide: the seed of digests, and two bases and byte values of fingerprints."""

    seed: int
    bases: tuple[int, int]
    values: int

    @classmethod
    def drawn(cls) -> Secret:
        return cls(secrets.randbits(64), (secrets.randbelow(1 << 30) + (1 << 29), secrets.randbelow(1 << 30) + (1 << 29)), secrets.randbits(64))

    def tables(self, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each base the byte values, its powers and those of its inverse modulo 2**31-1."""
        return _tables(self.bases, self.values, n)

    def fingerprints(self, data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """62-bit fingerprints of the strings of this length that start at these places of the data, which has at most 2 * BLOCK bytes."""
        out = np.zeros(len(at), U)
        for values, up, down in self.tables(2 * BLOCK):
            h = np.zeros(len(data) + 1, U)
            np.cumsum(reduced(values[data] * up[: len(data)]), out=h[1:])
            out = out << U(31) | reduced(reduced(h[at + length] - h[at]) * down[at])
        return out


@lru_cache(maxsize=1)
def _tables(bases: tuple[int, int], values: int, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    def grown(base: int) -> np.ndarray:
        out = np.ones(1, U)
        while len(out) < n:
            out = np.concatenate((out, reduced(out * U(pow(base, len(out), int(PRIME))))))
        return out[:n]

    rng = np.random.default_rng(values)
    return [(rng.integers(1, int(PRIME), 256).astype(U), grown(b), grown(pow(b, -1, int(PRIME)))) for b in bases]


def anchors(data: bytes, length: int, gram: int, seed: int = 0) -> list[tuple]:
    """For blocks of starts: start of each slice, starts in it, offset of its anchor, gram hash, digest of the slice's bytes, how many
    equal slices follow one another from there."""
    up, down = powers(BLOCK + 2 * length)
    out = []
    for at in range(0, len(data) - length + 1, BLOCK):
        text = np.frombuffer(data, np.uint8, min(BLOCK + length - 1, len(data) - at), at)
        h = prefix_hashes(text, up)
        starts = len(text) - length + 1
        grams = mixed((h[gram:] - h[:-gram]) * down[: len(text) - gram + 1])
        width = length - gram + 1
        # smallest gram of each width-window, the leftmost of equals: the place in the block is the hash's low bits
        places = np.arange(len(grams)).astype(U)
        ranked = grams & ~U(PLACES - 1) | places
        padded = np.concatenate((ranked, np.full(-len(ranked) % width, np.iinfo(U).max, U))).reshape(-1, width)
        left = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
        right = np.minimum.accumulate(padded, 1).ravel()
        least = np.minimum(left[:starts], right[width - 1 : width - 1 + starts])
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        n = np.diff(np.append(first, starts))
        where = (least[first] & U(PLACES - 1)).astype(np.int64)
        begin = (first + at).tolist()
        digests = np.array([xxhash.xxh3_128_digest(data[s:e], seed) for s, e in zip(begin, (first + at + n + length - 1).tolist())], "V16")
        same = (digests[1:] == digests[:-1]) & (n[1:] == n[:-1])
        head = np.flatnonzero(np.concatenate(([True], ~same)))
        out.append((first[head] + at, n[head], (where - first)[head], grams[where[head]], digests[head], np.diff(np.append(head, len(first)))))
    return out


def find_anchors(docs: DataFrame, length: int, gram: int, secret: Secret) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            columns: list[list] = [[] for _ in ANCHORS]
            for number, text_hash, text in zip(*(c.to_pylist() for c in b.columns)):
                if text and len(data := encoded(text)) >= length:
                    for found in anchors(data, length, gram, secret.seed):
                        k = len(found[0])
                        for column, x in zip(columns, (np.full(k, number), np.full(k, text_hash), *found)):
                            column.append(x)
            if columns[0]:
                parts = [np.concatenate(c) for c in columns]
                yield batch(ANCHORS, **{f.name: x.view(np.int64) if x.dtype == U else x.tolist() if x.dtype.kind == "V" else x for f, x in zip(ANCHORS, parts)})

    return docs.mapInArrow(run, ANCHORS_DDL)


def word_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte words of the padded buffer at these places: the characters of the multikey sort."""
    out = np.zeros(len(at), U)
    for k in range(8):
        out = (out << U(8)) | data[at + k]
    return out


def suffix_sort(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[start:end], and for each the longest common prefix with another one, rounded up to
    8 bytes; infinite where a suffix ends within it. Multikey quicksort with 8-byte characters: suffixes that
    agree so far are one segment, sorted by their next character; a suffix alone in its segment is in its place."""
    order, common = np.arange(len(start)), np.zeros(len(start))
    live, segment, depth = order.copy(), np.zeros(len(start), np.int64), 0
    place = order.copy()  # place of live[k] in the order
    while len(live):
        over = start[live] + depth >= end[live]
        at = np.where(over, 0, start[live] + depth)
        char = np.where(over, U(0), word_at(data, at))
        by = np.lexsort((char, segment))
        live, segment, char, over = live[by], segment[by], char[by], over[by]
        order[place] = live
        depth += 8
        same = (segment[1:] == segment[:-1]) & (char[1:] == char[:-1])
        twin = np.zeros(len(live), bool)
        twin[1:] |= same
        twin[:-1] |= same
        # whoever shared the segment agrees up to the last character, and maybe in part of this one
        common[live] = np.maximum(common[live], depth)
        common[live[over]] = np.inf
        going = twin & ~over
        segment = np.cumsum(np.concatenate(([True], ~same)))[going] if len(live) else segment
        place, live = place[going], live[going]
    return order, common


def window_keys(data: np.ndarray, place: np.ndarray, n: np.ndarray, length: int, secret: Secret) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slice, start in it, fingerprint of the string there) of the first n starts of every slice; slices lie one after another in the data."""
    which = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    at = place[which] + within
    out = np.zeros(len(which), U)
    k = 0
    while k < len(n):
        # slices that fit a block; one has fewer than 2 * length bytes
        end = max(k + 1, int(np.searchsorted(place, place[k] + BLOCK, "right")) - 1) if place[-1] > place[k] + BLOCK else len(n)
        lo, hi = np.searchsorted(which, [k, end])
        base = int(place[k])
        part = data[base : int(place[end]) if end < len(n) else len(data)]
        out[lo:hi] = secret.fingerprints(part, at[lo:hi] - base, length)
        k = end
    return which, within, out


def equals(data: np.ndarray, at: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """Whether the string at each place stands at another place with its key too: keys propose, bytes decide."""
    dup = np.zeros(len(key), bool)
    if not len(key):
        return dup
    by = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[by][1:] != key[by][:-1]))
    head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]  # the first place of each key
    member, of = by[~new], head[~new]
    order = np.argsort(at[member], kind="stable")
    member, of = member[order], of[order]
    p, q = at[member], at[of]
    # neighbours whose firsts are neighbours too are compared at once
    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(p)), bool), (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1))))
    size = np.diff(np.append(edge, len(p)))
    text = data.tobytes()
    wrong = [k for k, (a, b, m) in enumerate(zip(p[edge].tolist(), q[edge].tolist(), (size + length - 1).tolist())) if text[a : a + m] != text[b : b + m]]
    dup[member] = dup[of] = True
    if wrong:  # different strings of one key
        bad = np.isin(key, np.unique(key[member[np.concatenate([np.arange(edge[k], edge[k] + size[k]) for k in wrong])]]))
        strings = [(k, text[a : a + length]) for k, a in zip(key[bad].tolist(), at[bad].tolist())]
        count = Counter(strings)
        dup[bad] = [count[x] > 1 for x in strings]
    return dup


def repeated(data: np.ndarray, place: np.ndarray, n: np.ndarray, anchor: np.ndarray, gram: np.ndarray, length: int, secret: Secret) -> tuple[np.ndarray, np.ndarray]:
    """First and last repeated start of each slice of whole groups; the first is -1 where there is none."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    _, common = suffix_sort(padded, place + anchor, place + n + length - 1)
    # a repeated string that starts s bytes into the slice reaches length - (anchor - s) bytes beyond the anchor
    most = np.maximum(np.minimum(n, np.where(np.isinf(common), n, common - length + anchor + 1)), 0).astype(np.int64)
    which, within, print_ = window_keys(data, place, most, length, secret)
    key = mixed(print_ + gram[which].view(U) * SALT + (anchor[which] - within).astype(U) * MIX)
    dup = equals(data, place[which] + within, key, length)
    first, last = np.full(len(n), -1), np.full(len(n), -1)
    at, s = which[dup], within[dup]
    last[at] = s  # ascending, so the last one stays
    first[at[::-1]] = s[::-1]
    return first, last


def finer(cuts: DataFrame, length: int, secret: Secret) -> DataFrame:
    """Slices in runs of starts that are equally far from the anchor, a sixteenth of the length each: gram becomes a hash of gram,
    distance and the bytes that all strings of the run share. Equal strings are in runs of one hash."""
    most = max(8, length // 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in CUT_NAMES[:-1]]
        size = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, CUT_TYPES)], names=CUT_NAMES[:-1])

        for b in sliced(batches, 512):
            for gram, number, text_hash, start, n, anchor, content in zip(*(b.column(i).to_pylist() for i in range(7))):
                for k in range((anchor - n + 1) // most, anchor // most + 1):
                    lo, hi = max(0, anchor - (k + 1) * most + 1), min(n - 1, anchor - k * most)
                    shared = content[anchor - k * most : anchor - (k + 1) * most + 1 + length]
                    key = xxhash.xxh3_64_intdigest(shared, (secret.seed + gram * 31 + k) & 0xFFFFFFFFFFFFFFFF)
                    for column, x in zip(out, (key - (1 << 63), number, text_hash, start + lo, hi - lo + 1, anchor - lo, content[lo : hi + length])):
                        column.append(x)
                    size += hi - lo + length
                if size > 2 << 20:
                    yield made()
                    out, size = [[] for _ in CUT_NAMES[:-1]], 0
        yield made()

    return cuts.select(*CUT_NAMES).mapInArrow(run, CUT_DDL.removesuffix(", hot boolean"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot_group: int = 2_000, min_words: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes; null where nothing is removed and
    nothing is carried), text (kept without the rests of cut characters), spans,
    and as struct ``rest.row`` the columns to carry along. Runs that hold fewer than min_words whole words stay."""
    if not 32 <= length < BLOCK // 2:
        raise ValueError("length must be from 32 to 65535 bytes")
    gram = length // 4
    secret = Secret.drawn()
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.struct(F.col(f"`{text_col}`").isNull().alias("null_text"), (F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(0)).alias("row")).alias("rest"))
    rows = rows.select("id", F.xxhash64("text").alias("text_hash"), "text", "rest")
    found = written(find_anchors(rows.drop("rest"), length, gram, secret), "anchors")
    # counts are tables of their own: joins then read both sides from exchanges that can be split where a gram is hot
    grams = written(found.groupBy("gram").agg(F.sum("times").alias("all")).where("all > 1").select("gram"), "grams")
    repeats = written(found.join(grams, "gram"), "repeats")
    slices = written(repeats.groupBy("gram", "slice").agg(F.sum("times").alias("whole"), F.min(F.struct("id", "text_hash", "start")).alias("one")), "wholes")
    hot = written(slices.groupBy("gram").agg(F.count(F.lit(1)).alias("slices")).where(F.col("slices") > hot_group), "hot")
    # a slice that occurs once needs a closer look; of one that occurs more often, one goes along for the others
    looked = repeats.join(slices, ["gram", "slice"]).join(F.broadcast(hot) if hot.count() < 10_000 else hot, "gram", "left")
    looked = looked.select("id", "text_hash", "start", "n", "anchor", "gram", "times", (F.col("whole") > 1).alias("full"), (F.struct("id", "text_hash", "start") == F.col("one")).alias("one"), F.col("slices").isNotNull().alias("hot"))
    marks = looked.groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "n", "anchor", "gram", "times", "full", "one", "hot")).alias("marks"))
    # the only shuffle of texts; copies of a row have one row here and are counted
    joined = rows.join(marks, ["id", "text_hash"], "left")
    n_bytes = F.octet_length("text").cast("long")
    joined = joined.select("id", "text_hash", n_bytes.alias("n_bytes"), F.when(F.col("marks").isNull(), F.sha2("text", 256)).alias("sha"), F.when(F.col("marks").isNotNull(), F.col("text")).alias("text"), "marks", "rest", F.when(F.col("marks").isNull() & F.lit(bool(carry)), F.col("text")).alias("same"))
    table = written(joined, "marked")
    marked = table.where("marks is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in CUT_NAMES]
        size = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, CUT_TYPES)], names=CUT_NAMES)

        for b in sliced(batches, 64):
            for number, text_hash, text, marks_ in zip(*(c.to_pylist() for c in b.columns)):
                data = encoded(text)
                for m in marks_:
                    if m["one"] or not m["full"]:
                        s, e = m["start"], m["start"] + m["n"] + length - 1
                        for column, x in zip(out, (m["gram"], number, text_hash, s, m["n"], m["anchor"], data[s:e], m["hot"])):
                            column.append(x)
                        size += e - s
                        if size > 2 << 20:
                            yield made()
                            out, size = [[] for _ in CUT_NAMES], 0
        yield made()

    cuts = marked.select("id", "text_hash", "text", "marks").mapInArrow(cut, CUT_DDL)
    cuts = written(cuts, "slices")
    lead = F.substring("content", F.col("anchor") + 1, F.lit(gram))
    plain, hotter = cuts.where("not hot").select(*CUT_NAMES[:-1]), None
    if hot.take(1):
        runs_ = written(finer(cuts.where("hot"), length, secret), "finer")
        members = written(runs_.groupBy("gram").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "members")
        again = runs_.join(members, "gram")
        plain = plain.unionByName(again.where(F.col("members") <= hot_group).select(*CUT_NAMES[:-1]))
        hotter = again.where(F.col("members") > hot_group).select(*CUT_NAMES[:-1])
    buckets = plain.repartitionByRange(lead, F.col("gram")).sortWithinPartitions(lead, F.col("gram"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, 1 << 20):
            gram, number, text_hash, start, n, anchor = (t.column(i).to_numpy() for i in range(6))
            data, place = contents(t.column(6))
            first, last = repeated(data, place, n, anchor, gram, length, secret)
            there = first >= 0
            yield batch(RUNS, id=number[there], text_hash=text_hash[there], first=(start + first)[there], last=(start + last)[there])

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 512):
            gram, number, text_hash, start, n, anchor = (part.column(i).to_numpy() for i in range(6))
            data, place = contents(part.column(6))
            which, within, key = window_keys(data, place, n, length, secret)
            owner = mixed(gram[which].view(U) * SALT + (anchor[which] - within).astype(U) * MIX)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), owner.view(np.int64), number[which], text_hash[which], start[which], (start[which] + within))], names=["key", "owner", "id", "text_hash", "start", "at"])

    full = marked.select("id", "text_hash", F.explode("marks").alias("m")).where("m.full").select("id", "text_hash", F.col("m.start").alias("first"), (F.col("m.start") + F.col("m.n") * F.col("m.times") - 1).alias("last"))
    runs = full.unionByName(buckets.mapInArrow(compare, RUNS_DDL))
    if hotter is not None:
        prints = written(hotter.mapInArrow(fingerprints, "key long, owner long, id long, text_hash long, start long, at long"), "fingerprints")
        twice = prints.groupBy("key", "owner").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "owner")
        runs = runs.unionByName(prints.join(twice, ["key", "owner"]).groupBy("id", "text_hash", "start").agg(F.min("at").alias("first"), F.max("at").alias("last")).drop("start"))
    runs = runs.groupBy("id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("runs"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 64):
            out: list[list] = [[] for _ in RESULT]
            for number, size, text, found_ in zip(*(c.to_pylist() for c in b.columns[:4])):
                spans = merged([(r["first"], r["last"] + length) for r in found_ or ()])
                data = encoded(text)
                if min_words:
                    spans = [s for s in spans if whole_words(data, *s) >= min_words]
                kept = without(data, spans)
                for column, x in zip(out, (number, size, size - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, kept.decode("utf-8", "ignore"), [{"start": s, "end": e} for s, e in spans])):
                    column.append(x)
            done = batch(RESULT, **{f.name: x for f, x in zip(RESULT, out)})
            yield pa.RecordBatch.from_arrays([*done.columns, b.column(4)], names=[*RESULT.names, "rest"])

    schema = T.StructType([*T._parse_datatype_string(RESULT_DDL).fields, table.schema["rest"]])
    changed = marked.join(runs, ["id", "text_hash"], "left").select("id", "n_bytes", "text", "runs", "rest").mapInArrow(remove, schema)
    same = table.where("marks is null").select("id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.encode("same", "utf-8").alias("kept"), F.col("same").alias("text"), F.expr("cast(array() as array<struct<start: long, end: long>>)").alias("spans"), "rest")
    out = changed.unionByName(same)
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot_group: int = 2_000, min_words: int = 0) -> DataFrame:
    """All columns of docs, the text without its repeated bytes. Documents of which only white space is left go; null texts stay null."""
    others = [c for c in docs.columns if c != text_col]
    found = duplicates(docs, id_col, text_col, length, hot_group, min_words, tuple(others))
    found = found.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    text = F.when(~F.col("rest.null_text"), F.col("text"))
    return found.select(*(text.alias(c) if c == text_col else F.col(f"rest.row.`{c}`").alias(c) for c in docs.columns))


CUT_NAMES = ["gram", "id", "text_hash", "start", "n", "anchor", "content", "hot"]
CUT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
CUT_DDL = "gram long, id long, text_hash long, start long, n int, anchor int, content binary, hot boolean"
RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
RESULT_DDL = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, text string, spans array<struct<start: long, end: long>>"


def contents(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column one after another, and where each value starts."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    sizes = np.array([len(x) for x in column.to_pylist()], np.int64)
    return data, np.cumsum(sizes) - sizes


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows in record batches that hold whole groups of the first column, of about so many bytes or one group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        gram = b.column(0).to_numpy()
        if held and size >= most:
            # rows up to the first change of group complete what is held
            before = held[-1].column(0)[held[-1].num_rows - 1].as_py()
            change = np.flatnonzero(gram != before)
            cut = int(change[0]) if len(change) else b.num_rows
            if cut < b.num_rows:
                yield one(held + ([b.slice(0, cut)] if cut else []))
                held, size, b = [], 0, b.slice(cut)
        held.append(b)
        size += b.nbytes
    if held:
        yield one(held)


def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in these spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def whole_words(data: bytes, start: int, end: int) -> int:
    """Words of the run that do not go on before or after it."""
    around = data[max(0, start - 1) : end + 1].translate(WORD_TABLE)
    return max(0, len(around.split()) - (start > 0 and around[0] != 32) - (end < len(data) and around[-1] != 32))


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for s, e in spans:
        kept.append(data[at:s])
        at = e
    return b"".join([*kept, data[at:]])
