"""Language-model scoring with an Elias-Fano n-gram trie.

Counts are taken over all training texts: words, then pairs of word numbers, then triples whose two
pairs are both kept (a triple is never more frequent than its pairs). Pairs and triples that occur less
than ``least`` times are pruned, as is usual, after their counts are complete. Tasks count in sorted
arrays and exchange them as compressed blocks, so hot n-grams are one entry of each task. Blocks are dealt by ranges of keys, with
bounds from the counts of the contexts, so that the tasks that add them up write the shards of the trie themselves; a frequent context
may be split over shards. By default all pairs stay, and triples that occur twice.

Probabilities are interpolated with absolute discounting: p(w | c) = (n(cw) - d) / n(c) for kept cw,
plus g(c) p(w | shorter c), where g(c) is the mass that kept n-grams leave; words are smoothed by
adding 0.1, with a share for unknown ones.

Texts are read twice, to count words and to number them; later passes read numbers. The
trie is memory-mapped from the shared folder, in shards of sorted keys that many tasks write. In a
level, a context's children are a range that an Elias-Fano sequence of monotone pointers gives; word
numbers are 32-bit, and a child is found by successor search within its context's range. Level 1
maps word hashes to numbers. Logarithms of (n(cw) - d) / n(c) and of g are quantised to 1/4096; they are put together when a token is scored.

Defined results: null and empty texts are one end token; a null id is held out; without training
texts every probability is that of an unknown word; repeated rows each count and each get their row;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_bytes, batch, delete_dir, encoded, fresh_dir, groups, sliced, write_to, written
from tessera.llm.quality import held_out
from tessera.llm.succinct import access, elias_fano, load, save

END, START = xxhash.xxh3_64_intdigest(b"\n"), xxhash.xxh3_64_intdigest(b"\r")  # no word holds a line break
STEP = 1 / 4096
SEGMENT, FLUSH = 200_000, 1_000_000
POWER = 10.0 ** (-STEP * np.arange(1 << 16))  # of quantised logarithms

BLOCKS = pa.schema([("file", pa.int32()), ("part", pa.int32()), ("block", pa.binary())])
BLOCKS_DDL = "file int, part int, block binary"
NUMBERS = pa.schema([("numbers", pa.binary()), ("lengths", pa.binary()), ("docs", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("pairs", pa.binary())])
NUMBERS_DDL = "numbers binary, lengths binary, docs array<long>, held_out array<boolean>, pairs binary"
SHARDS = pa.schema([("path", pa.string()), ("first", pa.int64()), ("rows", pa.int64()), ("total", pa.int64()), ("ends", pa.int64()), ("places", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64())), ("edges", pa.list_(pa.int64()))])
SHARDS_DDL = "path string, first long, rows long, total long, ends long, places array<long>, weights array<long>, edges array<long>"
SCORES = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES_DDL = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def hashes(text: str | None) -> np.ndarray:
    """The start mark, word hashes of a text, A-Z in lower case, and the end."""
    w = encoded(text).lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, [b"\r", *w, b"\n"]), np.uint64, len(w) + 2).view(np.int64)


@dataclass
class Stretch:
    """Tokens of several texts one after another. Each piece begins with the start mark or with two tokens of context;
    last holds where a token is not context, so that n-grams that end there count."""

    tokens: np.ndarray
    begin: np.ndarray  # of each token's piece
    new: np.ndarray
    text: np.ndarray


def stretches(texts: Iterable[np.ndarray]) -> Iterator[Stretch]:
    """Token arrays, each led by a start mark, in stretches of bounded length; long ones are parted, with two tokens of context."""
    held: list[tuple[np.ndarray, int, int]] = []
    size = 0

    def flush() -> Stretch:
        lengths = np.array([len(t) for t, _, _ in held])
        begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
        tokens = np.concatenate([t for t, _, _ in held])
        skip = np.repeat([s for _, s, _ in held], lengths)
        return Stretch(tokens, begin, np.arange(len(tokens)) - begin >= skip, np.repeat([k for _, _, k in held], lengths))

    for k, tokens in enumerate(texts):
        for a in range(1, len(tokens), SEGMENT):
            context = max(0, a - 2)
            piece = tokens[context : a + SEGMENT]
            held.append((piece, a - context, k))
            size += len(piece)
            if size >= SEGMENT:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


@dataclass
class Row:
    """Texts of one row of the table of numbers: word numbers of all of them one after another, each led by the start mark and
    closed by the end, where each begins, and for each token the row of the pair that ends there."""

    numbers: np.ndarray
    edges: np.ndarray
    docs: list
    held_out: np.ndarray
    pairs: np.ndarray | None

    def stretches(self) -> Iterator[Stretch]:
        """Stretches whose tokens are places in numbers and pairs."""
        return stretches(np.arange(a, b) for a, b in zip(self.edges, self.edges[1:]))


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    for b in batches:
        for k in range(b.num_rows):
            numbers, lengths, pairs = (from_planes(x, t) if (x := b.column(c)[k].as_py()) is not None else None for c, t in ((0, "<i4"), (1, "<i8"), (4, "<i8")))
            yield Row(numbers.astype(np.int64), np.concatenate(([0], np.cumsum(lengths))), b.column(2)[k].as_py(), np.array(b.column(3)[k].as_py(), bool), pairs)


class Tally:
    """Counts of integer keys in sorted arrays; what it holds is emitted when it gets too large."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.more: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> bool:
        self.more.append(keys)
        self.size += len(keys)
        if self.size >= FLUSH:
            self.settle()
        return len(self.keys) >= 2 * FLUSH

    def settle(self) -> None:
        keys, n = np.unique(np.concatenate(self.more), return_counts=True) if self.more else (self.keys[:0], self.n[:0])
        self.keys, self.n = summed(np.concatenate((self.keys, keys)), np.concatenate((self.n, n)))
        self.more, self.size = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.settle()
        out = self.keys, self.n
        self.keys, self.n = self.keys[:0], self.n[:0]
        return out


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(keys)
    keys, n = keys[by], n[by]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones: high bytes that are alike lie together and compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def from_planes(data, kind: str) -> np.ndarray:
    data = np.frombuffer(data, np.uint8)
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def fitting(x: np.ndarray) -> np.ndarray:
    """Non-negative numbers in the smallest of 16, 32 and 64 bits."""
    most = int(x.max(initial=0))
    return x.astype(np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64)


def to_block(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts, by byte planes and compressed."""
    return zstandard.ZstdCompressor(level=3).compress(planes(np.diff(keys, prepend=0)) + planes(n))


def from_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    k = len(data) // 2
    return np.cumsum(from_planes(data[:k], "<i8")), from_planes(data[k:], "<i8")


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(x, return_inverse=True)


def runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))


@dataclass
class Shards:
    """A sorted table in files: what is looked up, sorted and each once, goes to the file whose range of keys it is in. Contexts that are
    split over files have what they leave here."""

    paths: list[str] = field(default_factory=list)
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offset: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    split: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    split_rest: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint16))

    @classmethod
    def of(cls, rows: list, discount: float) -> Shards:
        """Rows of the manifest, one for each file, sorted by key."""
        out = cls([r["path"] for r in rows], np.array([r["first"] for r in rows], np.int64), np.cumsum([0, *(r["rows"] for r in rows)]))
        edges = np.array([x for r in rows for x in r["edges"]], np.int64).reshape(-1, 4)
        contexts, which, times = np.unique(edges[:, 0], return_inverse=True, return_counts=True)
        mass, kinds, of = (np.zeros(len(contexts), np.int64) for _ in range(3))
        np.add.at(mass, which, edges[:, 1])
        np.add.at(kinds, which, edges[:, 2])
        of[which] = edges[:, 3]
        out.split, out.split_rest = contexts[times > 1], left(mass, kinds, of, discount)[times > 1]
        return out

    def parts(self, keys: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[dict, slice, int]]:
        """For sorted keys: each shard that some fall into, these, and the shard's first row."""
        cut = np.append(np.searchsorted(keys, bounds), len(keys)).tolist()
        for k, path in enumerate(self.paths):
            if cut[k] < cut[k + 1]:
                yield load(path), slice(cut[k], cut[k + 1]), int(self.offset[k])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of keys in tables that hold their keys themselves, -1 where missing."""
        out = np.full(len(keys), -1)
        for shard, at, offset in self.parts(keys, self.first):
            row = np.minimum(np.searchsorted(shard["key"], keys[at]), len(shard["key"]) - 1)
            out[at] = np.where(shard["key"][row] == keys[at], row + offset, -1)
        return out

    def child(self, keys: np.ndarray, size: int) -> np.ndarray:
        """Rows of n-grams (context * size + word), -1 where missing: successor search for the word in the range of its context."""
        out = np.full(len(keys), -1)
        for shard, at, offset in self.parts(keys, self.first):
            c = keys[at] // size
            w = keys[at] - c * size
            base, pointers = int(shard["base"][0]), {k[4:]: x for k, x in shard.items() if k.startswith("ptr_")}
            begin = runs(c)
            some = c[begin] - base
            inside = some < int(shard["contexts"][0])
            lo, hi = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
            lo[inside], hi[inside] = access(pointers, some[inside]), access(pointers, some[inside] + 1)
            each = np.diff(np.append(begin, len(c)))
            lo, hi = np.repeat(lo, each), np.repeat(hi, each)
            end, words = hi.copy(), shard["word"]
            live = np.flatnonzero(lo < hi)
            while len(live):
                a, b = lo[live], hi[live]
                mid = (a + b) >> 1
                less = words[mid] < w[live]
                a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
                lo[live], hi[live] = a, b
                live = live[a < b]
            hit = np.flatnonzero(lo < end)
            hit = hit[words[lo[hit]] == w[hit]]
            out[at.start + hit] = lo[hit] + offset
        return out

    def rest(self, contexts: np.ndarray, size: int) -> np.ndarray:
        """What contexts leave, as left gives it: 0 for those without n-grams."""
        out = np.zeros(len(contexts), np.uint16)
        for shard, at, _ in self.parts(contexts * size + (size - 1), self.first):
            place = contexts[at] - int(shard["base"][0])
            inside = np.flatnonzero(place < len(shard["rest"]))
            out[at.start + inside] = shard["rest"][place[inside]]
        if len(contexts) and len(self.split):
            place = np.minimum(np.searchsorted(contexts, self.split), len(contexts) - 1)
            there = contexts[place] == self.split
            out[place[there]] = self.split_rest[there]
        return out

    def get(self, rows: np.ndarray, name: str) -> np.ndarray:
        """Values of an array of the table at rows (all of them present)."""
        out = np.zeros(len(rows), np.int64)
        for shard, at, offset in self.parts(rows, self.offset[:-1]):
            out[at] = shard[name][rows[at] - offset]
        return out


@dataclass
class Model:
    """Levels of the trie and what they leave to shorter contexts. Word numbers are rows of level 1; the start mark comes after them."""

    total: int = 0
    texts: int = 0
    discount: float = 0.75
    words: Shards = field(default_factory=Shards)
    pairs: Shards = field(default_factory=Shards)
    triples: Shards = field(default_factory=Shards)

    @property
    def vocabulary(self) -> int:
        return int(self.words.offset[-1])

    @property
    def size(self) -> int:
        return self.vocabulary + 1

    def numbers(self, tokens: np.ndarray) -> np.ndarray:
        words, back = distinct(tokens)
        out = self.words.find(words)
        out[words == np.array([START], np.uint64).view(np.int64)[0]] = self.vocabulary
        return out[back]

    def word_counts(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of words (sorted, each once) as tokens and, for the start mark, of texts."""
        out = np.where(numbers == self.vocabulary, self.texts, 0)
        known = (numbers >= 0) & (numbers < self.vocabulary)
        out[known] = self.words.get(numbers[known], "count")
        return out

    def pair_rows(self, s: Stretch, numbers: np.ndarray) -> np.ndarray:
        """For each token the row of the pair that ends there, -1 without one."""
        out = np.full(len(numbers), -1)
        at = np.flatnonzero((np.arange(len(numbers)) > s.begin) & (numbers >= 0))
        at = at[numbers[at - 1] >= 0]
        keys, back = distinct(numbers[at - 1] * self.size + numbers[at])
        out[at] = self.pairs.child(keys, self.size)[back]
        return out

    def log_probs(self, s: Stretch, numbers: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token its count, log10 of its own probability, and log10 of its probability after its context."""
        words, word = distinct(numbers)
        counts = self.word_counts(words)
        own = (counts + 0.1) / (self.total + 0.1 * (self.vocabulary + 1))
        p = own[word]
        second = np.flatnonzero(np.arange(len(numbers)) > s.begin)
        p[second] *= mass_left(self.pairs.rest(words, self.size))[word[second - 1]]
        rows, row = distinct(pair)
        there = rows >= 0
        kept = np.zeros(len(rows))
        kept[there] = POWER[self.pairs.get(rows[there], "log")]
        p += kept[row]
        third = second[second - 1 > s.begin[second]]
        rest, before = self.triples.rest(rows, self.size), row[third - 1]
        third, before = third[rest[before] > 0], before[rest[before] > 0]
        p[third] *= mass_left(rest)[before]
        at = third[pair[third] >= 0]
        keys, key = distinct(pair[at - 1] * self.size + numbers[at])
        found = self.triples.child(keys, self.size)
        kept = np.zeros(len(keys))
        kept[found >= 0] = POWER[self.triples.get(found[found >= 0], "log")]
        p[at] += kept[key]
        return counts[word], np.log10(own)[word], np.log10(p)


def quantised(log: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-log / STEP), 65535).astype(np.uint16)


def left(mass: np.ndarray, kinds: np.ndarray, of: np.ndarray, discount: float) -> np.ndarray:
    """What the kept n-grams of contexts leave: one more than its quantised logarithm, as 0 says that there are none."""
    return np.minimum(quantised(np.log10(np.maximum(1 - (mass - discount * kinds) / of, 1e-12))), 65534) + np.uint16(1)


def mass_left(rest: np.ndarray) -> np.ndarray:
    return np.where(rest > 0, POWER[np.maximum(rest, 1) - np.uint16(1)], 1.0)


def heavy(n: np.ndarray, points: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Places in a table of counts and the sums up to them, before and after the rows in which shares of the whole are reached."""
    sums = np.cumsum(n)
    at = np.unique(np.searchsorted(sums, sums[-1] * (np.arange(points) + 1.0) / points).clip(max=len(n) - 1))
    return np.stack((at, at + 1), 1).ravel(), np.stack((sums[at] - n[at], sums[at]), 1).ravel()


def bounds_of(rows: list, size: int, parts: int, more: int = 0) -> np.ndarray:
    """Keys that part n-grams whose contexts are the rows of a table into ranges of about as many tokens: by the counts of these rows, and of
    more for a context after them. Word numbers are in the order of hashes, so a context's n-grams are taken to lie evenly."""
    places, sums = [np.zeros(1)], [np.zeros(1)]
    offset, total = 0, 0
    for r in rows:
        places.append(np.array(r["places"], float) + offset)
        sums.append(np.array(r["weights"], float) + total)
        offset, total = offset + r["rows"], total + r["total"]
    places.append(np.array([offset, offset + 1.0]))
    sums.append(np.array([total, total + more], float))
    at = np.interp((total + more) * (np.arange(parts - 1) + 1.0) / parts, np.concatenate(sums), np.concatenate(places))
    return at.astype(np.int64) * size + ((at % 1) * size).astype(np.int64)


def counted(table: DataFrame, keys, name: str, bounds: np.ndarray, least: int, arrays) -> list:
    """Rows of the manifest of a table of keys that occur at least so often, sorted, where keys(batches) gives arrays of integer keys.
    Bounds part the keys into ranges that are added up one at a time; a file has some ranges, and arrays(key, n) gives its arrays and what is
    to be known of its first and last context."""
    spark = table.sparkSession
    folder = fresh_dir(spark, name)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    per = max(1, min(8, (len(bounds) + 1) // (8 * spark.sparkContext.defaultParallelism)))
    end = int(np.array([END], np.uint64).view(np.int64)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def out() -> pa.RecordBatch:
            k, n = tally.take()
            cut = [0, *np.searchsorted(k, bounds).tolist(), len(k)]
            there = [p for p in range(len(bounds) + 1) if cut[p] < cut[p + 1]]
            return batch(BLOCKS, file=[p // per for p in there], part=there, block=[to_block(k[cut[p] : cut[p + 1]], n[cut[p] : cut[p + 1]]) for p in there])

        for some in keys(batches):
            if tally.add(some):
                yield out()
        yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def file() -> pa.RecordBatch:
            k, n = (np.concatenate(x) for x in zip(*held))
            path = f"{folder}/{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}-{number}"
            found, edges = arrays(k, n)
            save(path, found)
            places, weights = heavy(n)
            return batch(SHARDS, path=[path], first=[k[0]], rows=[len(k)], total=[n.sum()], ends=[n[k == end].sum()], places=[places], weights=[weights], edges=[edges])

        number = -1
        for g in groups(batches, 2):
            if held and g.column(0)[0].as_py() != number:
                yield file()
                held = []
            number = g.column(0)[0].as_py()
            k, n = summed(*(np.concatenate(x) for x in zip(*map(from_block, g.column(2).to_pylist()))))
            if (n >= least).any():
                held.append((k[n >= least], n[n >= least]))
        if held:
            yield file()

    blocks = table.mapInArrow(run, BLOCKS_DDL).repartition("file").sortWithinPartitions("file", "part")
    return sorted(written(blocks.mapInArrow(merge, SHARDS_DDL), f"{name}-shards").collect(), key=lambda r: r["first"])


def level(keys: np.ndarray, n: np.ndarray, size: int, counts, discount: float, **more: np.ndarray) -> tuple[dict[str, np.ndarray], list[int]]:
    """Arrays of a level's shard: pointers to the children of each context from the first to the last one and what it leaves, word numbers and
    probabilities, where counts(contexts) gives how often contexts occur; and number, sum, kinds and count of the first and last context."""
    context = keys // size
    begin = runs(context)
    some, kinds, mass = context[begin], np.diff(np.append(begin, len(keys))), np.add.reduceat(n, begin)
    of = counts(some)
    base, contexts = int(some[0]), int(some[-1] - some[0]) + 1
    pointers, rest = np.zeros(contexts + 1, np.int64), np.zeros(contexts, np.uint16)
    pointers[some - base + 1] = kinds
    rest[some - base] = left(mass, kinds, of, discount)
    packed = {f"ptr_{k}": x for k, x in elias_fano(np.cumsum(pointers), len(keys) + 1).items()}
    log = quantised(np.log10((n - discount) / np.repeat(of, kinds)))
    edges = [int(x[k]) for k in sorted({0, len(some) - 1}) for x in (some, mass, kinds, of)]
    return packed | {"word": (keys - context * size).astype(np.uint32), "log": log, "rest": rest, "base": np.array([base]), "contexts": np.array([contexts])} | more, edges


def word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Words of training texts: (id, text, held_out) rows."""
    for b in sliced(batches):
        for text, out in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            if not out:
                yield hashes(text)[1:]


def numbers_table(texts: DataFrame, model: Model) -> str:
    """Path of a table of word numbers of all texts (-1 for unknown words), some texts in a row, so that later passes need not read texts again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, docs, out, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            flat = np.concatenate(h)
            found = np.concatenate([model.numbers(flat[a : a + SEGMENT]) for a in range(0, len(flat), SEGMENT)])
            return batch(NUMBERS, numbers=[planes(found.astype("<i4"))], lengths=[planes(np.array([len(x) for x in h], "<i8"))], docs=[docs], held_out=[out], pairs=[None])

        for b in sliced(batches):
            for number, text, held in zip(*(c.to_pylist() for c in b.columns)):
                h.append(hashes(text))
                docs.append(number)
                out.append(held)
                size += len(h[-1])
                if size >= SEGMENT:
                    yield row()
                    h, docs, out, size = [], [], [], 0
        if h:
            yield row()

    return write_to(texts.mapInArrow(run, NUMBERS_DDL), "numbers")


def pairs_table(path: str, spark: SparkSession, model: Model) -> DataFrame:
    """The same rows with the row of the pair that ends at each token; they take the place of the table at the path."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, row in enumerate(numbered(iter([b]))):
                pairs = np.full(len(row.numbers), -1, "<i8")
                for s in row.stretches():
                    pairs[s.tokens[s.new]] = model.pair_rows(s, row.numbers[s.tokens])[s.new]
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in b.columns[:4]), pa.array([planes(pairs)], pa.binary())], names=NUMBERS.names)

    out = written(spark.read.schema(NUMBERS_DDL).parquet(path).mapInArrow(run, NUMBERS_DDL), "pair-rows")
    delete_dir(spark, path)
    return out


def train(texts: DataFrame, least: tuple[int, int] = (1, 2), discount: float = 0.75) -> tuple[Model, DataFrame]:
    """A model of the texts that are not held out, from (id, text, held_out) rows, and the table of numbers and pairs of all of them.
    Pairs and triples that occur less often than least says are left out after all are counted."""
    spark = texts.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = Model(discount=discount)
    even = np.array([(k << 64) // parts - (1 << 63) for k in range(1, parts)], np.int64)  # of hashes
    words = counted(texts, word_keys, "level1", even, 1, lambda key, n: ({"key": key, "count": fitting(n)}, []))
    if not words:
        return model, pairs_table(numbers_table(texts, model), spark, model)
    model.total, model.texts = sum(r["total"] for r in words), sum(r["ends"] for r in words)
    model.words = Shards.of(words, discount)
    size = model.size
    if size >= 1 << 31:
        raise ValueError("more than 2**31 distinct words")
    path = numbers_table(texts, model)
    first = spark.read.schema(NUMBERS_DDL).parquet(path)

    def pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for row in numbered(batches):
            for s in row.stretches():
                numbers = row.numbers[s.tokens]
                at = np.flatnonzero(s.new & (np.arange(len(numbers)) > s.begin) & ~row.held_out[s.text])
                yield numbers[at - 1] * size + numbers[at]

    pairs = counted(first, pair_keys, "level2", bounds_of(words, size, parts, model.texts), least[0], lambda key, n: level(key, n, size, model.word_counts, discount, count=fitting(n)))
    model.pairs = Shards.of(pairs, discount)
    if int(model.pairs.offset[-1]) * size >= 1 << 63:
        raise ValueError("numbers of triples exceed 63 bits")
    table = pairs_table(path, spark, model)

    def triple_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for row in numbered(batches):
            for s in row.stretches():
                numbers, pair = row.numbers[s.tokens], row.pairs[s.tokens]
                at = np.flatnonzero(s.new & (np.arange(len(numbers)) > s.begin + 1) & (pair >= 0) & ~row.held_out[s.text])
                at = at[pair[at - 1] >= 0]
                yield pair[at - 1] * size + numbers[at]

    triples = counted(table, triple_keys, "level3", bounds_of(pairs, size, parts), least[1], lambda key, n: level(key, n, size, lambda rows: model.pairs.get(rows, "count"), discount))
    model.triples = Shards.of(triples, discount)
    return model, table


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, least: tuple[int, int] = (1, 2), discount: float = 0.75) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the text).
    Documents whose id's crc32 is divisible by folds are held out of training."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), held_out(id_col, folds).alias("held_out"))
    with arrow_bytes(spark, "4m"):  # a row of the table of numbers is a few megabytes
        model, table = train(rows, least, discount)
        out = written(table.mapInArrow(scorer(model), SCORES_DDL), "scores")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def scorer(model: Model):
    """Scores of the rows of a table of numbers and pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in numbered(batches):
            n = len(row.docs)
            tokens, known, base, full = (np.zeros(n) for _ in range(4))
            for s in row.stretches():
                counts, own, after = model.log_probs(s, row.numbers[s.tokens], row.pairs[s.tokens])
                text = s.text[s.new]
                tokens += np.bincount(text, minlength=n)
                known += np.bincount(text, counts[s.new] > 0, n)
                base += np.bincount(text, own[s.new], n)
                full += np.bincount(text, after[s.new], n)
            yield batch(SCORES, id=row.docs, held_out=row.held_out, n_tokens=tokens.astype(np.int64), n_known=known.astype(np.int64), base_score=base, score=full)

    return run
