"""Language of a text, by interpolated Kneser-Ney models of characters, one for each language.

A text is its words, runs of letters in lower case. A model gives the probability of each character, and of a word's end, after up to
``order - 1`` characters before it in the word, its beginning included. Counts of the highest order, and of what begins a word, are
plain; those of lower orders say after how many different characters a sequence occurs. Each order discounts its counts by
n1 / (n1 + 2 n2) and leaves that mass to the next lower one; the last leaves it to all code points alike. A model is held in arrays of
64-bit hashes, sorted, beside interpolated log probabilities (by n-gram) and weights of lower orders (by context); lookups
are binary searches. A text's language is that of the lowest cross-entropy per character, ties by name.

What is learnt comes from a bounded sample: of the ``max_langs`` languages of most rows, each one's ``max_docs`` rows of lowest hash, as
long as they have ``max_chars`` characters together; longer texts are not learnt from. A fifth of it is not counted but calibrates:
the score is the softmax of all cross-entropies, by number of characters and a temperature that fits pieces of those texts of several lengths; and a
language rejects texts whose cross-entropy lies above what all but ``reject`` of its own pieces of such length have.

Defined results: null texts and texts without a letter, and all texts where nothing could be learnt, are ``und`` with score 0
and rejected; null languages are not learnt from; rows with null ids are held out; rows that share an id and a language
count as their smallest text; repeated rows each get their row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import lowest, sliced
from tessera.llm.neardup import C3, U, mix

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Numbers of a word's beginning and end; characters come after them. Code points that a model has to allow for.
BEGIN, END, CODE_POINTS = 1, 2, 0x110000
UNKNOWN = "und"
PIECES = (1, 3, 8, 20, 60)
MODEL_DDL = "lang string, level int, grams binary, logs binary, contexts binary, weights binary"
MODEL = pa.schema([("lang", pa.string()), ("level", pa.int32()), *((c, pa.binary()) for c in ("grams", "logs", "contexts", "weights"))])
CACHED_WORDS, CACHED_LENGTH = 200_000, 40


def words(text: str | None) -> list[str]:
    """Runs of letters (and their marks), in lower case."""
    return WORD.findall(text.lower()) if text else []


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves ``fold`` when divided by folds, and for null ids."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % folds == fold, F.lit(True))


def symbols(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' characters as numbers, each word with its beginning and end; place in the word; where words begin."""
    lengths = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary)) + 2
    begin = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(begin, lengths)
    codes = np.full(len(place), BEGIN, np.int64)
    codes[begin + lengths - 1] = END
    inner = np.ones(len(place), bool)
    inner[begin] = inner[begin + lengths - 1] = False
    codes[inner] = np.frombuffer("".join(vocabulary).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 3
    return codes, place, begin


def hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Of each n up to order, the hash of the n symbols that end at each place (beginnings of words are not heeded)."""
    out = [np.zeros(len(codes), U)]
    for n in range(order):
        out.append(mix(out[-1] * C3 + np.concatenate((np.zeros(min(n, len(codes)), U), codes[: max(0, len(codes) - n)].astype(U)))))
    return out


def at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted hashes stand among sorted ones, and which of them do."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return found, keys[found] == wanted


def fit(counts: dict[str, int], order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n from 1: n-gram hashes, sorted, and their log probabilities; hashes of their contexts, sorted, and the logs of what
    these leave to the lower order."""
    codes, place, begin = symbols(list(counts))
    weight = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), np.diff(np.append(begin, len(codes))))
    h = hashes(codes, order)
    levels = []
    for n in range(1, order + 1):
        ends = np.flatnonzero(place >= max(1, n - 1))
        grams, first, inverse = np.unique(h[n][ends], return_index=True, return_inverse=True)
        where = ends[first]
        levels.append([grams, where, np.bincount(inverse, weight[ends], len(grams))])
    for n in range(1, order):
        grams, where, count = levels[n - 1]
        later = np.bincount(at(grams, h[n][levels[n][1]])[0], minlength=len(grams))
        inside = place[where] >= n  # does not begin a word
        count[inside] = later[inside]
    out, lower = [], None
    for n, (grams, where, count) in enumerate(levels, 1):
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.05
        contexts, of = np.unique(h[n - 1][where - 1] if n > 1 else np.zeros(len(grams), U), return_inverse=True)
        total, kinds = np.bincount(of, count), np.bincount(of)
        left = discount * kinds / total
        below = 1 / CODE_POINTS if n == 1 else lower[at(levels[n - 2][0], h[n - 1][where])[0]]
        lower = np.maximum(count - discount, 0) / total[of] + left[of] * below
        out.append((grams, np.log(lower).astype(np.float32), contexts, np.log(left).astype(np.float32)))
    return out


def log_probabilities(model: list, vocabulary: list[str]) -> np.ndarray:
    """Of each word, the log probability of its characters and its end."""
    codes, place, begin = symbols(vocabulary)
    order = len(model)
    h = hashes(codes, order)
    out = np.zeros(len(codes))
    going = np.flatnonzero(place > 0)
    for n in range(order, 0, -1):
        grams, logs, contexts, weights = model[n - 1]
        tried = going[place[going] >= n - 1]
        found, there = at(grams, h[n][tried])
        out[tried[there]] += logs[found[there]]
        missed = tried[~there]
        found, known = at(contexts, h[n - 1][missed - 1] if n > 1 else np.zeros(len(missed), U))
        out[missed[known]] += weights[found[known]]
        going = np.concatenate((missed, going[place[going] < n - 1]))
    out[going] -= np.log(CODE_POINTS)
    return np.add.reduceat(out, begin) if len(begin) else np.zeros(0)


class Scorer:
    """Scores texts with all models; words met before are looked up."""

    def __init__(self, models: dict[str, list]):
        self.langs = sorted(models)
        self.models = [models[x] for x in self.langs]
        self.cache: dict[str, int] = {}
        self.table = np.zeros((0, len(self.langs)))

    def sums(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text (its words), the number of symbols and the log probability in each language."""
        if len(self.cache) > CACHED_WORDS:
            self.cache, self.table = {}, self.table[:0]
        new = sorted(set().union(*texts).difference(self.cache))
        number = dict(zip(new, range(len(self.table), len(self.table) + len(new))))
        table = np.concatenate((self.table, np.stack([log_probabilities(m, new) for m in self.models], 1))) if new else self.table
        short = sum(len(w) <= CACHED_LENGTH for w in new)
        if short == len(new):
            self.cache |= number
            self.table, number = table, self.cache
        else:
            number |= self.cache
        size, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)))
        for k, w in enumerate(texts):
            size[k] = sum(map(len, w)) + len(w)
            out[k] = table[np.fromiter(map(number.__getitem__, w), np.int64, len(w))].sum(0)
        return size, out


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, fold: int, max_langs: int, max_docs: int, max_chars: int) -> DataFrame:
    """lang, id, text: what is learnt from."""
    known = docs.where(~held_out(id_col, folds, fold)).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = known.where("lang is not null and text is not null")
    often = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).select("lang")
    sizes = known.select("lang", "id", F.length("text").alias("size"), F.xxhash64("id").alias("key")).where(f"size between 1 and {max_chars}").join(F.broadcast(often), "lang")
    sizes = lowest(sizes.groupBy("lang", "id", "key").agg(F.min("size").alias("size")), max_docs, "lang", [F.asc("key"), F.asc("id")], F.col("key")).withColumnRenamed("rank", "nth")
    until = F.sum("size").over(W.partitionBy("lang").orderBy("nth").rowsBetween(W.unboundedPreceding, 0))
    # at most max_langs * max_docs ids
    chosen = F.broadcast(sizes.withColumn("until", until).where(F.col("until") <= max_chars).select("lang", "id"))
    return known.where(F.length("text").between(1, max_chars)).join(chosen, ["lang", "id"]).groupBy("lang", "id").agg(F.min("text").alias("text"))


def calibrates(number: str) -> bool:
    """Whether a document of the sample is kept from counting."""
    return zlib.crc32(number.encode()) // 7 % 5 == 0


def train(chosen: DataFrame, order: int) -> dict[str, list]:
    """The models of a sample, fitted by one task for each language (a bounded number of characters)."""

    def learn(table: pa.Table) -> pa.Table:
        lang, ids, texts = (table.column(c).to_pylist() for c in ("lang", "id", "text"))
        own = [t for i, t in zip(ids, texts) if not calibrates(i)] or texts
        counts: Counter[str] = Counter()
        for t in own:
            counts.update(words(t))
        model = fit(dict(sorted(counts.items())), order) if counts else []
        rows = [(lang[0], n, *(x.tobytes() for x in level)) for n, level in enumerate(model, 1)]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(MODEL)], schema=MODEL)

    models: dict[str, list] = {}
    for r in sorted(chosen.groupBy("lang").applyInArrow(learn, MODEL_DDL).collect(), key=lambda r: (r["lang"], r["level"])):
        models.setdefault(r["lang"], []).append(tuple(np.frombuffer(bytes(r[c]), kind) for c, kind in (("grams", U), ("logs", np.float32), ("contexts", U), ("weights", np.float32))))
    return models


def pieces(w: list[str]) -> list[list[str]]:
    """The first words of a text in pieces of each of the lengths, and the text itself."""
    return [w[:n] for n in PIECES if n < len(w)] + [w]


def calibrate(chosen: DataFrame, models: dict[str, list], reject: float) -> tuple[float, np.ndarray]:
    """The temperature of the softmax; and for each language the cross-entropy that texts may have, and how much more, over the
    root of their length, short ones may."""
    shared = chosen.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in sliced(batches):
            of, every = [], []
            for lang, number, text in zip(*(c.to_pylist() for c in b.columns)):
                if lang in shared.value and calibrates(number) and (w := words(text)):
                    found = pieces(w)
                    of += [lang] * len(found)
                    every += found
            size, sums = scorer.sums(every)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(size), pa.array(list(sums), pa.list_(pa.float64()))], names=["lang", "size", "sums"])

    langs = sorted(models)
    # some pieces of at most a fifth of the sample's texts
    rows = chosen.select("lang", "id", "text").mapInArrow(measure, "lang string, size long, sums array<double>").collect()
    limits = np.tile([np.inf, 0.0], (len(langs), 1))
    if not rows:
        return 0.25, limits
    own, size, sums = np.array([langs.index(r["lang"]) for r in rows]), np.array([r["size"] for r in rows]), np.array([r["sums"] for r in rows])
    losses = {}
    for beta in np.geomspace(0.01, 1, 25).tolist():
        logits = beta * sums
        logits -= logits.max(1, keepdims=True)
        losses[beta] = float((np.log(np.exp(logits).sum(1)) - logits[np.arange(len(own)), own]).mean())
    entropy = -sums[np.arange(len(own)), own] / size
    for k in range(len(langs)):
        if (own == k).any():
            long = (own == k) & (size >= np.median(size[own == k]))
            limits[k, 0] = np.quantile(entropy[long], 1 - reject)
            limits[k, 1] = np.quantile(np.maximum(0, entropy[own == k] - limits[k, 0]) * np.sqrt(size[own == k]), 1 - reject)
    return min(losses, key=losses.get), limits


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, order: int = 5, max_langs: int = 200, max_docs: int = 2000, max_chars: int = 500_000, reject: float = 0.005) -> DataFrame:
    """Per row: the id, held_out (not learnt from), lang_pred, score (0 to 1), bits (cross-entropy per character, null for ``und``) and rejected
    (likely in none of the languages that were learnt)."""
    chosen = sample(docs, id_col, text_col, lang_col, folds, fold, max_langs, max_docs, max_chars)
    models = train(chosen, order)
    fitted = (models, *calibrate(chosen, models, reject)) if models else ({}, 1.0, None)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), held_out(id_col, folds, fold).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, beta, limits = shared.value
        scorer = Scorer(models)
        for b in sliced(batches):
            lang, score, bits, rejected = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), np.full(b.num_rows, np.nan), np.ones(b.num_rows, bool)
            split = [words(t) for t in b.column(1).to_pylist()]
            there = [k for k, w in enumerate(split) if w and models]
            if there:
                size, sums = scorer.sums([split[k] for k in there])
                best = sums.argmax(1)  # all have one length: the highest sum is the lowest entropy
                top = sums[np.arange(len(there)), best]
                score[there] = 1 / np.exp(beta * (sums - top[:, None])).sum(1)
                bits[there] = -top / size / np.log(2)
                rejected[there] = -top / size > limits[best, 0] + limits[best, 1] / np.sqrt(size)
                for k, i in zip(there, best.tolist()):
                    lang[k] = scorer.langs[i]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang), pa.array(score), pa.array(bits, from_pandas=True), pa.array(rejected)], names=["id", "held_out", "lang_pred", "score", "bits", "rejected"])

    more = "lang_pred string, score double, bits double, rejected boolean"
    schema = T.StructType([rows.schema["id"], rows.schema["held_out"], *T._parse_datatype_string(more)])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def entropies(models: dict[str, list], texts: Iterable[str]) -> tuple[list[str], np.ndarray]:
    """The languages, and the cross-entropy per character (nats) of each text in each of them."""
    scorer = Scorer(models)
    size, sums = scorer.sums([words(t) for t in texts])
    return scorer.langs, -sums / np.maximum(1, size)[:, None]
