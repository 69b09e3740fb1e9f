"""Collocations: phrases of two and three words, scored against the parts they can be cut into.

Each task counts its documents in tries of depth three, one per language: a path for every place of a word, as far as the
piece goes, so that a node's count is the sum of the counts below it. A trie is kept as its sorted paths and written in levels
(words, numbers of children, counts), cut into ranges of paths by splitters from a bounded sample. A range's blocks meet in one task,
which merges their sorted paths and walks the merged trie: a node's count, and those of its ancestors, which are the left parts of
its phrase. Only nodes on the first and the last path of a range may go on in other ranges; their counts are summed up
afterwards. Right parts are suffix links: a phrase of two words is linked to its second word, one of three to
its last two, and through that node's link to its last. Hot prefixes are split, for splitters are whole paths.

``shard_words`` bounds a task's trie (or one document, if that is longer), ``range_words`` the words a range gets.

Defined results: null and empty texts have no words; null languages are ``und``; phrases do not reach over pieces; repeated rows
count each; an empty table, or one without a phrase that occurs ``min_count`` times, gives an empty table; ids and other columns
are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import groups, lowest, sliced, written

#: Fixed values. Lower-case A-Z; the marks .,;:!? and 0x0A to 0x0D end a piece (0xFF, which UTF-8 has not); blanks and tabs part words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\v\f\r" else b for b in range(256))
END = b"\xff"
#: Paths of up to so many words' numbers fit into one 63-bit key; tries with more (of one very long text) are sorted by their columns.
MOST_WORDS, KEYS = (1 << 21) - 2, 1 << 63
SHARDS_DDL = "range int, lang string, block binary"
NODES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("depth", pa.int32()), ("a", pa.int64()), ("open", pa.bool_()), ("left1", pa.int64()), ("open1", pa.bool_()), ("left2", pa.int64()), ("open2", pa.bool_())])
NODES_DDL = "lang string, phrase string, depth int, a long, open boolean, left1 long, open1 boolean, left2 long, open2 boolean"
Path = tuple[bytes, bytes, bytes]


def tokens(text: bytes) -> list[bytes]:
    """Words, and END between pieces."""
    return text.translate(TABLE).replace(END, b" \xff ").split()


class Shard:
    """Words of one language on their way to a trie."""

    def __init__(self):
        self.number, self.texts = {END: 0}, []

    def add(self, words: list[bytes]) -> None:
        number = self.number
        for w in set(words).difference(number):
            number[w] = len(number)
        self.texts += [np.fromiter(map(number.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]

    def paths(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words, sorted, and the trie's paths as sorted rows of three word numbers (from 1; 0: the piece ended), with counts."""
        del self.number[END]
        words = sorted(self.number)
        place = np.zeros(len(words) + 1, np.int64)
        place[[self.number[w] for w in words]] = np.arange(1, len(words) + 1)
        at = place[np.concatenate([*self.texts, np.zeros(2, np.int32)])]
        self.texts = []
        base = len(words) + 1
        two, three = at[1:-1], np.where(at[1:-1] > 0, at[2:], 0)
        if base**3 > KEYS:
            rows = np.stack((at[:-2], two, three), 1)[at[:-2] > 0]
            rows = rows[np.lexsort(rows.T[::-1])]
            first = starts(*rows.T)
            return words, rows[first], np.diff(np.append(first, len(rows)))
        keys, counts = np.unique(((at[:-2] * base + two) * base + three)[at[:-2] > 0], return_counts=True)
        return words, np.stack((keys // base // base, keys // base % base, keys % base), 1), counts


def lower_bound(words: list[bytes], paths: np.ndarray, path: Path) -> int:
    """How many of the sorted paths come before this one."""
    low, high = 0, len(paths)
    for depth, word in enumerate(path):
        number = bisect.bisect_left(words, word) + 1 if word else 0
        column = paths[low:high, depth]
        low, high = low + int(np.searchsorted(column, number)), low + int(np.searchsorted(column, number, "right"))
        if low == high or word and (number > len(words) or words[number - 1] != word):
            return low
    return low


def pack(words: list[bytes], paths: np.ndarray, counts: np.ndarray) -> bytes:
    """A trie in levels: its words, the words and numbers of children of levels one and two, the words and counts of level three."""
    used = np.unique(paths)
    used = used[used > 0]
    local = np.searchsorted(used, paths) + (paths > 0)
    one, two = starts(local[:, 0]), starts(local[:, 0], local[:, 1])
    text = b" ".join([words[i - 1] for i in used.tolist()])
    levels = [local[one, 0], np.diff(np.append(np.searchsorted(two, one), len(two))), local[two, 1], np.diff(np.append(two, len(local))), local[:, 2], counts]
    head = np.array([len(text), len(one), len(two), len(local)], "<i8")
    return zstandard.compress(head.tobytes() + text + b"".join(x.astype("<u4").tobytes() for x in levels), 1)


def unpack(block: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, paths and counts of a packed trie."""
    raw = zstandard.decompress(block)
    size, n1, n2, n3 = np.frombuffer(raw, "<i8", 4).tolist()
    levels = np.split(np.frombuffer(raw, "<u4", offset=32 + size).astype(np.int64), np.cumsum([n1, n1, n2, n2, n3]))
    two = np.repeat(np.arange(n2), levels[3])
    paths = np.stack((np.repeat(levels[0], levels[1])[two], levels[2][two], levels[4]), 1)
    return raw[32 : 32 + size].split(b" "), paths, levels[5]


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows of sorted columns begin."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def merge(tries: list[tuple[list[bytes], np.ndarray, np.ndarray]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """One trie of many: their sorted paths merged, counts of equal ones added."""
    if len(tries) == 1:
        return tries[0]
    words = sorted(set().union(*(w for w, _, _ in tries)))
    number = dict(zip(words, range(1, len(words) + 1)))
    parts = []
    for w, paths, _ in tries:
        place = np.zeros(len(w) + 1, np.int64)
        place[1:] = [number[x] for x in w]
        parts.append(place[paths])
    paths, counts = np.concatenate(parts), np.concatenate([c for _, _, c in tries])
    # each column's numbers are made dense, so that the three of a path fit into one key (else columns are sorted one by one)
    dense = [np.unique(c, return_inverse=True)[1] for c in paths.T]
    widths = [int(d.max()) + 1 for d in dense]
    if widths[0] * widths[1] * widths[2] < KEYS:
        by = np.argsort((dense[0] * widths[1] + dense[1]) * widths[2] + dense[2], kind="stable")  # merges the sorted runs
    else:
        by = np.lexsort(dense[::-1])
    paths = paths[by]
    first = starts(*paths.T)
    return words, paths[first], np.add.reduceat(counts[by], first)


def walk(lang: str, words: list[bytes], paths: np.ndarray, counts: np.ndarray, min_count: int) -> pa.RecordBatch:
    """Nodes of the merged trie of a range that occur min_count times, with the counts of their ancestors (left1: of the first
    word, left2: of the first two), and the nodes that may go on in other ranges (open), the root among them."""
    one, two = starts(paths[:, 0]), starts(paths[:, 0], paths[:, 1])
    f1, f2 = np.add.reduceat(counts, one), np.add.reduceat(counts, two)
    n1, n2, n3 = len(one), len(two), len(paths)
    up1 = np.repeat(np.arange(n1), np.diff(np.append(one, n3)))  # of each path, its nodes of levels one and two
    up2 = np.repeat(np.arange(n2), np.diff(np.append(two, n3)))
    edge1, edge2 = np.zeros(n1, bool), np.zeros(n2, bool)
    edge1[[0, -1]] = edge2[[0, -1]] = True
    s1 = np.flatnonzero(edge1 | (f1 >= min_count))
    s2 = np.flatnonzero((edge2 | (f2 >= min_count)) & (paths[two, 1] > 0))
    s3 = np.flatnonzero((counts >= min_count) & (paths[:, 2] > 0))
    name = lambda row: b" ".join([words[i - 1] for i in row]).decode()
    phrases = [""] + [name(r) for r in paths[one[s1], :1].tolist()] + [name(r) for r in paths[two[s2], :2].tolist()] + [name(r) for r in paths[s3].tolist()]
    t1, t2, t3 = up1[two[s2]], up1[s3], up2[s3]
    none = np.zeros(1 + len(s1), np.int64)
    no = np.zeros(1 + len(s1), bool)
    sizes = [1, len(s1), len(s2), len(s3)]
    columns = {
        "lang": [lang] * sum(sizes), "phrase": phrases, "depth": np.repeat(np.arange(4, dtype=np.int32), sizes), "a": np.concatenate(([counts.sum()], f1[s1], f2[s2], counts[s3])), "open": np.concatenate(([True], edge1[s1], edge2[s2], np.zeros(len(s3), bool))),
        "left1": np.concatenate((none, f1[t1], f1[t2])), "open1": np.concatenate((no, edge1[t1], edge1[t2])), "left2": np.concatenate((none, np.zeros(len(s2), np.int64), f2[t3])), "open2": np.concatenate((no, np.zeros(len(s2), bool), edge2[t3])),
    }
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in NODES], schema=NODES)


def splitters(rows: DataFrame, range_words: int, sample_docs: int, least_ranges: int) -> list[tuple[str, *Path]]:
    """Paths (with their language) that part the corpus into ranges of about range_words words, from one of 32 places of about sample_docs documents."""
    total = rows.count()
    part = min(1.0, sample_docs / max(1, total))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            lang, path, size = [], [], 0
            for text, name in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
                w = tokens(text) + [END, END]
                size += len(w) - w.count(END)
                for i in range(len(w) % 32, len(w) - 2, 32):
                    if w[i] != END:
                        lang.append(name)
                        path.append([w[i], b"" if w[i + 1] == END else w[i + 1], b"" if END in w[i + 1 : i + 3] else w[i + 2]])
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([lang], pa.list_(pa.string())), pa.array([path], pa.list_(pa.list_(pa.binary())))], names=["size", "lang", "path"])

    sample = rows if part == 1.0 else rows.sample(part, 1)
    found = sample.mapInArrow(pick, "size long, lang array<string>, path array<array<binary>>").collect()
    ranges = max(least_ranges, round(sum(r["size"] for r in found) / part / range_words))
    keys = sorted((lang.encode(), *map(bytes, path)) for r in found for lang, path in zip(r["lang"], r["path"]))
    chosen = sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []
    return [(k[0].decode(), *k[1:]) for k in chosen]


def nodes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 10, shard_words: int = 4_000_000, range_words: int = 8_000_000, sample_docs: int = 5000) -> DataFrame:
    """Nodes of the merged tries, as walk() gives them, in a table of the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang")).where("text is not null")
    cuts = splitters(rows, range_words, sample_docs, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(cuts)

    def blocks(lang: str, shard: Shard) -> Iterator[pa.RecordBatch]:
        words, paths, counts = shard.paths()
        name = lang.encode()
        begin = sum(c[0].encode() < name for c in shared.value)
        own = [c[1:] for c in shared.value if c[0] == lang]
        at = [0, *(lower_bound(words, paths, c) for c in own), len(paths)]
        for k, (low, high) in enumerate(zip(at, at[1:])):
            if low < high:
                yield pa.RecordBatch.from_arrays([pa.array([begin + k], pa.int32()), pa.array([lang]), pa.array([pack(words, paths[low:high], counts[low:high])])], names=["range", "lang", "block"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        held = 0
        for b in sliced(batches):
            for text, lang in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
                words = tokens(text)
                shard = shards.setdefault(lang, Shard())
                if len(shard.number) + len(words) > MOST_WORDS and shard.texts:
                    held -= sum(map(len, shard.texts))
                    yield from blocks(lang, shards.pop(lang))
                    shard = shards.setdefault(lang, Shard())
                shard.add(words)
                held += len(words) + 1
                if held > shard_words:
                    for name in list(shards):
                        yield from blocks(name, shards.pop(name))
                    held = 0
        for name in list(shards):
            yield from blocks(name, shards.pop(name))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 1):
            of: dict[str, list[bytes]] = {}
            for lang, block in zip(g.column(1).to_pylist(), g.column(2).to_pylist()):
                of.setdefault(lang, []).append(block)
            for lang, packed in of.items():
                yield walk(lang, *merge([unpack(x) for x in packed]), min_count)

    met = rows.mapInArrow(count, SHARDS_DDL).repartition(len(cuts) + 1, "range").sortWithinPartitions("range")
    return written(met.mapInArrow(merged, NODES_DDL), "nodes")


def scored(found: DataFrame, min_count: int = 10) -> DataFrame:
    """Candidates (lang, phrase, depth, a) with l, r and score of their lowest-scoring cut."""
    opened = found.where("open").groupBy("lang", "phrase").agg(F.first("depth").alias("depth"), F.sum("a").alias("a"))
    opened = written(opened.where("depth > 0"), "opened")
    whole = found.where("not open").drop("open")
    across = opened.where((F.col("a") >= min_count) & (F.col("depth") == 2)).select("lang", "phrase", "depth", "a", F.lit(0).cast("long").alias("left1"), F.lit(True).alias("open1"), F.lit(0).cast("long").alias("left2"), F.lit(False).alias("open2"))
    every = whole.where("depth > 1").unionByName(across)
    # left parts of which some count is in other ranges
    part = every.where("open1 or open2").withColumns({"first1": F.substring_index("phrase", " ", 1), "first2": F.substring_index("phrase", " ", 2)})
    one = opened.where("depth = 1").select("lang", F.col("phrase").alias("first1"), F.col("a").alias("all1"))
    two = opened.where("depth = 2").select("lang", F.col("phrase").alias("first2"), F.col("a").alias("all2"))
    part = part.join(one, ["lang", "first1"], "left").join(two, ["lang", "first2"], "left")
    part = part.withColumns({"left1": F.when(F.col("open1"), F.col("all1")).otherwise(F.col("left1")), "left2": F.when(F.col("open2"), F.col("all2")).otherwise(F.col("left2"))})
    columns = ["lang", "phrase", "depth", "a", "left1", "left2"]
    candidates = every.where("not (open1 or open2)").select(columns).unionByName(part.select(columns))
    # suffix links
    words = whole.where("depth = 1").select("lang", "phrase", "a").unionByName(opened.where((F.col("depth") == 1) & (F.col("a") >= min_count)).select("lang", "phrase", "a"))
    last = words.select("lang", F.col("phrase").alias("suffix"), F.col("a").alias("r1"))
    pairs = candidates.where("depth = 2").withColumn("suffix", F.substring_index("phrase", " ", -1)).join(last, ["lang", "suffix"]).drop("suffix")
    pairs = written(pairs, "pairs")
    link = pairs.select("lang", F.col("phrase").alias("suffix"), F.col("a").alias("r1"), F.col("r1").alias("r2"))
    triples = candidates.where("depth = 3").withColumn("suffix", F.substring_index("phrase", " ", -2)).join(link, ["lang", "suffix"]).drop("suffix")
    linked = pairs.withColumn("r2", F.lit(None).cast("long")).unionByName(triples)
    square = "1000000bd * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0))"
    cut = lambda k: F.expr(f"({square}) div (cast(left{k} as decimal(18, 0)) * cast(r{k} as decimal(18, 0)))")
    linked = linked.withColumns({"score1": cut(1), "score2": F.when(F.col("depth") == 3, cut(2))})
    second = F.coalesce(F.col("score2") < F.col("score1"), F.lit(False))
    pick = lambda x, y: F.when(second, F.col(y)).otherwise(F.col(x))
    return linked.select("lang", "phrase", "depth", "a", pick("left1", "left2").alias("l"), pick("r1", "r2").alias("r"), pick("score1", "score2").alias("score"))


def top(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 10, most: int = 2000, within: int = 50, **bounds: int) -> DataFrame:
    """The first ``most`` phrases of each language by score, count and phrase (descending, descending, by bytes): lang, rank, phrase, a (how
    often it occurs), l and r (how often the parts of its lowest-scoring cut do; ties: the earliest), n (words of the language), score:
    1,000,000 a a / (l r), whole number. A pair goes if a candidate of three words holds it and has ``within`` percent of its count."""
    found = nodes(docs, text_col, lang_col, min_count, **bounds)
    every = written(scored(found, min_count), "scored")
    parts = every.where("depth = 3").select("lang", "a", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"))
    longer = parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = every.where("depth = 3").drop("depth").unionByName(every.where("depth = 2").join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * within, F.lit(True))).drop("depth", "longer"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = lowest(kept, most, "lang", order, F.col("phrase"))
    sizes = found.where("depth = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    return kept.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
