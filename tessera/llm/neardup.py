"""Near-duplicate documents by BagMinHash over word shingles.

A document is the multiset of its five-word shingles. Its signature samples a Poisson process over
(shingle, weight): the discretised weight of a shingle is parted into (0,1], (1,2], (2,4], (4,8], ...;
each part has its own process with the part's rate, split down to unit weights by each point's place in
the part, and a point counts where its unit lies within the document's weight. Every point falls to one
of the signature's components; a component keeps the identity of its earliest point, so two documents
agree in a component with probability equal to their weighted Jaccard similarity. Only points before a
time that the total weight gives are made; where a component stays empty the time is doubled.

Documents with equal multisets are one class. Signatures are banded. Each class of a bucket (equal band) is
first compared with the bucket's smallest class by exact multiset overlap, a pair at a time: a hot group of copies
of one text is linked by this alone, without meeting in a task. Only buckets of three or more classes that are not
one component by then need more: by distributed connected components their classes form candidate clusters, so a
bucket's pairs are never listed. Members of a cluster meet once (large clusters in pairs of blocks of bounded
size), where all pairs that are not connected already are compared exactly. With 32
bands of 5 rows a pair at similarity 0.8 is missed with probability 3e-6.

Defined results: null texts and texts without words are nobody's duplicate; a text of fewer than five
words has one shingle, all its words; null ids are not matched; rows that share an id count as one document, linked
by each of their texts, so that what is like any of them is in its class; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Union, batch, groups, sliced, words, written
from tessera.llm.components import components

U = np.uint64
C1, C2, C3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
SIGNED = pa.schema([("id", pa.int64()), ("bag", pa.binary()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])
SIGNED_DDL = "id long, bag binary, size long, bands array<long>"
LINKS = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a pseudo-random 64-bit number for each."""
    x = (x ^ (x >> U(30))) * C1
    x = (x ^ (x >> U(27))) * C2
    return x ^ (x >> U(31))


def bag(text: str | None, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the k-word shingles of a text, and how often each occurs."""
    w = words(text)
    if not w:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), U, len(w))
    n = max(1, len(w) - k + 1)
    out = np.zeros(n, U)
    for j in range(min(k, len(w))):
        out = mix(out * C3 + h[j : j + n])
    return np.unique(out, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """Identities of the earliest points, one row of m per bag; bags must not be empty."""
    out = np.zeros((len(bags), m), U)
    todo, factor = np.arange(len(bags)), 5.0
    while len(todo):
        which = np.repeat(np.arange(len(todo)), [len(bags[i][0]) for i in todo])
        shingle = np.concatenate([bags[i][0] for i in todo])
        weight = np.concatenate([bags[i][1] for i in todo])
        total = np.bincount(which, weight, len(todo))
        until = (np.log(m) + factor) * m / total
        # parts of the weight: level 0 is (0,1], level l is (2**(l-1), 2**l]
        level = np.zeros(len(which), np.int64)
        deeper, at = [(which, shingle, weight, level)], 1
        heavy = weight > 1
        while heavy.any():
            deeper.append((which[heavy], shingle[heavy], weight[heavy], level[heavy] + at))
            at += 1
            heavy = weight > (1 << (at - 1))
        which, shingle, weight, level = (np.concatenate(x) for x in zip(*deeper))
        rate = np.where(level > 0, 2.0 ** (level - 1), 1.0)
        seed = mix(shingle + level.astype(U) * C3)
        time, limit = np.zeros(len(which)), until[which]
        cells, times, points = [], [], []
        step = 0
        while len(which):
            step += 1
            seed = mix(seed + C3)
            time = time - np.log((seed >> U(11)).astype(float) * 2.0**-53 + 2.0**-54) / rate
            going = time < limit
            which, weight, level, rate, seed, time, limit = (x[going] for x in (which, weight, level, rate, seed, time, limit))
            if not len(which):
                break
            place = mix(seed ^ C1)
            # the unit of weight the point falls into, for parts of more than one
            unit = np.where(level > 1, rate + np.floor((mix(seed ^ C2) >> U(11)).astype(float) * 2.0**-53 * rate), level)
            inside = unit < weight
            cells.append((which * m + (place % U(m)).astype(np.int64))[inside])
            times.append(time[inside])
            points.append(seed[inside])
        cell, time, point = (np.concatenate(x) if x else np.zeros(0) for x in (cells, times, points))
        by = np.lexsort((point, time, cell))
        cell = cell[by]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(cell)), bool), cell[1:] != cell[:-1])))
        rows = np.zeros(len(todo) * m, U)
        rows[cell[first].astype(np.int64)] = point[by][first]
        full = np.bincount(cell[first].astype(np.int64) // m, minlength=len(todo)) == m
        out[todo[full]] = rows.reshape(-1, m)[full]
        todo, factor = todo[~full], factor * 2 + np.log(m)
    return out


def signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """For each document with words: its bag's digest and size, and a 64-bit key of each band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [(number, x) for number, text in zip(*(c.to_pylist() for c in b.columns)) if number is not None and len((x := bag(text, shingle))[0])]
            if not found:
                continue
            s = signatures([x for _, x in found], bands * rows).reshape(len(found), bands, rows)
            key = np.zeros((len(found), bands), U) + np.arange(bands, dtype=U) * C1
            for j in range(rows):
                key = mix(key * C3 + s[:, :, j])
            yield batch(SIGNED, id=[n for n, _ in found], bag=[hashlib.blake2b(h.tobytes() + c.tobytes(), digest_size=16).digest() for _, (h, c) in found], size=[int(c.sum()) for _, (_, c) in found], bands=list(key.view(np.int64)))

    return docs.mapInArrow(run, SIGNED_DDL)


def alike(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], threshold: float) -> bool:
    """Whether two bags have at least this similarity: weighted Jaccard, by exact overlap."""
    a, b = int(x[1].sum()), int(y[1].sum())
    if not a or not b or min(a, b) < threshold * max(a, b) - 1e-9:
        return False
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(x[1][i], y[1][j]).sum())
    return both >= threshold * (a + b - both) - 1e-9


def verify(bags: list[tuple[np.ndarray, np.ndarray]], side: np.ndarray | None, threshold: float, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what similarity of at least threshold connects: every pair (of two sides, where given) that is
    not connected by earlier links, or by being of one known component, is compared exactly."""
    n = len(bags)
    size = np.array([c.sum() for _, c in bags], np.int64)
    union, links = Union(n), []
    first: dict[int, int] = {}
    for i, k in enumerate(known or ()):
        union.join(i, first.setdefault(k, i))

    def test(i: int, j: np.ndarray, overlap: np.ndarray) -> None:
        for k in j[overlap >= threshold * (size[i] + size[j] - overlap) - 1e-9].tolist():
            if union.join(i, k):
                links.append((i, k))

    if n <= 8:
        for i in range(n):
            for j in range(i + 1, n):
                if (side is None or side[i] != side[j]) and union.find(i) != union.find(j) and alike(bags[i], bags[j], threshold):
                    union.join(i, j)
                    links.append((i, j))
        return links
    token = np.unique(np.concatenate([h for h, _ in bags]), return_inverse=True)[1]
    count = np.concatenate([c for _, c in bags])
    lengths = np.array([len(h) for h, _ in bags])
    owner, begin = np.repeat(np.arange(n), lengths), np.cumsum(lengths) - lengths
    by = np.argsort(token, kind="stable")
    posting, posted = owner[by], count[by]
    starts = np.searchsorted(token[by], np.arange(token.max() + 2))
    for i in range(n):
        root = union.roots()
        other = root != root[i]
        if side is not None:
            other &= side != side[i]
        other &= np.minimum(size, size[i]) >= threshold * np.maximum(size, size[i]) - 1e-9
        other[: i + 1] = False  # pairs with earlier ones have been compared, or were connected
        if not other.any():
            continue
        t = token[begin[i] : begin[i] + lengths[i]]
        c = count[begin[i] : begin[i] + lengths[i]]
        many = starts[t + 1] - starts[t]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - starts[t], many)
        overlap = np.bincount(posting[at], np.minimum(posted[at], np.repeat(c, many)), n)
        j = np.flatnonzero(other)
        test(i, j, overlap[j])
    return links


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 5, block_words: int = 250_000) -> DataFrame:
    """One row per distinct id: id, class_id (smallest id that links reach, itself included)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = written(signed(texts, shingle, bands, rows), "signatures")
    bags = written(marks.groupBy("bag").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands")), "bags")
    keys = bags.select(F.col("rep").alias("id"), F.explode("bands").alias("band"))
    buckets = written(keys.groupBy("band").agg(F.min("id").alias("head"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("head < last").select("band", "head", "n"), "buckets")
    shared = written(keys.join(buckets, "band").select("id", "band", "head", "n"), "shared")
    pairs = shared.where("id > head").select(F.col("id").alias("src"), F.col("head").alias("dst")).distinct()

    def compare_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = None, (np.zeros(0, U), np.zeros(0, np.int64))
        for b in sliced(batches):
            src, dst = [], []
            for i, j, text, other in zip(*(c.to_pylist() for c in b.columns)):
                if other != held:  # rows of a head come one after another
                    held, head = other, bag(other, shingle)
                if alike(bag(text, shingle), head, threshold):
                    src.append(i)
                    dst.append(j)
            yield batch(LINKS, src=src, dst=dst)

    met = pairs.join(texts.withColumnRenamed("id", "src"), "src").join(texts.select(F.col("id").alias("dst"), F.col("text").alias("other")), "dst").select("src", "dst", "text", "other")
    star = written(met.mapInArrow(compare_pairs, "src long, dst long"), "star")
    known = written(components(star).withColumnRenamed("node", "id"), "known")
    # buckets that are not one component yet; of two classes, all pairs have been compared
    of = shared.where("n > 2").join(known, "id", "left").select("id", "band", "head", F.coalesce("component", "id").alias("component"))
    mixed = of.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    near = of.join(mixed, "band").where("id > head").select(F.col("id").alias("src"), F.col("head").alias("dst"))
    clusters = written(components(near).withColumnRenamed("component", "cluster"), "clusters")
    sizes = clusters.join(bags.select(F.col("rep").alias("node"), "size"), "node").groupBy("cluster").agg(F.sum("size").alias("weight"))
    blocks = F.ceil(F.col("weight") / block_words).cast("int")
    placed = clusters.join(sizes, "cluster").select(F.col("node").alias("id"), "cluster", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"), blocks.alias("blocks"))
    placed = placed.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    members = texts.join(placed, "id")
    dealt = members.select("id", "cluster", "own", "text", "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "text", "component")
    dealt = dealt.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = [], []
        for g in groups(batches, 3):
            number, own = g.column(4).to_numpy(), g.column(3).to_numpy()
            side = own if g.column(1)[0].as_py() != g.column(2)[0].as_py() else None
            if g.num_rows > 1:
                for i, j in verify([bag(t, shingle) for t in g.column(5).to_pylist()], side, threshold, g.column(6).to_pylist()):
                    src.append(number[i])
                    dst.append(number[j])
            if len(src) > 50_000:
                yield batch(LINKS, src=src, dst=dst)
                src, dst = [], []
        if src:
            yield batch(LINKS, src=src, dst=dst)

    # bags of one id are one document
    several = marks.groupBy("id").agg(F.min("bag").alias("low"), F.max("bag").alias("high")).where("low < high").select("id")
    reps = written(marks.select("id", "bag").join(several, "id").join(bags.select("bag", "rep"), "bag").select("id", "rep").distinct(), "reps")
    same = reps.join(reps.groupBy("id").agg(F.min("rep").alias("dst")), "id").where("rep > dst").select(F.col("rep").alias("src"), "dst")
    links = written(star.unionByName(same).unionByName(dealt.mapInArrow(compare, "src long, dst long")), "links")
    joined = components(links).withColumnRenamed("node", "rep")
    of = bags.join(joined, "rep", "left").select("bag", F.coalesce("component", "rep").alias("class_id"))
    found = marks.select("id", "bag").join(of, "bag").groupBy("id").agg(F.min("class_id").alias("class_id"))
    every = texts.select("id").distinct().join(found, "id", "left")
    return every.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Documents whose id is their class's smallest; rows without id stay. Rows that share an id are one document of several texts: all of
    them stay or all go, so that a text goes with its document where another text of that document has a copy of a smaller id."""
    gone = classes(docs, id_col, text_col, **options).where(F.col("class_id") != F.col(id_col)).select(id_col)
    return docs.join(gone, id_col, "left_anti")
