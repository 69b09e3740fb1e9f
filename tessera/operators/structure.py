"""Cleaning texts, parsing their structure, and cutting them into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Headings of legal texts, outermost first.
LEVELS = (
    ("chapter", r"(?iu)^\**\s*Chương\s+([IVXLCDM0-9]+)\b.*$"),
    ("section", r"(?iu)^\**\s*Mục\s+(\d+)\b.*$"),
    ("article", r"(?iu)^\**\s*Điều\s+(\d+[A-Za-z]?)\.\s*(.*)$"),
    ("clause", r"^\s*(\d+)\.\s+(.*)$"),
    ("point", r"(?iu)^\s*([a-zđ])\)\s+(.*)$"),
)


def clean_lines(c: Column, drop: str, unwrap: str = r"^\s*(?:[-*+]\s+|#+\s*)") -> Column:
    """Lines without those that match ``drop``, list marks and heading marks removed, blanks squashed."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, unwrap, ""), r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~F.regexp_like(x, F.lit(drop))), "\n")


def repeated(c: Column, pattern: str, least: int) -> Column:
    """A pattern occurs at least so often: user-interface texts, link lists, footers."""
    return F.regexp_count(c, F.lit(pattern)) >= least


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, start_char): offsets are sums of the lengths of the lines before."""
    split = df.select(F.col(key), F.split(text, "\n").alias("l"))
    # offsets are folded within the row, a document's lines need no shuffle
    ends = F.aggregate("l", F.expr("cast(array(0) as array<bigint>)"), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x) + 1)))
    return split.select(key, F.posexplode(F.arrays_zip(F.col("l").alias("line"), F.slice(ends, 1, F.size("l")).alias("start_char"))).alias("line_no", "z")).select(key, "line_no", F.col("z.line").alias("line"), F.col("z.start_char").alias("start_char"))


def parse(df: DataFrame, key: str, text: str, levels: tuple[tuple[str, str], ...] = LEVELS) -> DataFrame:
    """One row per node: key, node_id, level, number, path of ancestors, content, start_char, end_char. A line belongs to the
    deepest open node; a heading closes what is deeper. Nodes without content go."""
    all_lines = lines(df, key, text)
    level = F.coalesce(*(F.when(F.regexp_like("line", F.lit(p)), k) for k, (_, p) in enumerate(levels)), F.lit(len(levels)))
    number = F.coalesce(*(F.when(F.regexp_like("line", F.lit(p)), F.regexp_extract("line", p, 1)) for _, p in levels))
    marked = all_lines.withColumn("lv", level).withColumn("number", number)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(len(levels)):
        # the last heading of this level, void once a heading further out follows
        opened = F.last(F.when(F.col("lv") == k, F.col("line_no")), True).over(w)
        outer = F.coalesce(F.max(F.when(F.col("lv") < k, F.col("line_no"))).over(w), F.lit(-1))
        marked = marked.withColumn(f"o{k}", F.when(opened > outer, opened))
    node = F.greatest(*(F.col(f"o{k}") for k in range(len(levels))))
    marked = marked.withColumn("node", node).where("node is not null")
    head = F.struct("lv", "number")
    grouped = marked.groupBy(key, "node").agg(
        F.min_by(head, "line_no").alias("head"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"), F.min("start_char").alias("start_char"), F.max(F.col("start_char") + F.length("line")).alias("end_char"),
        *(F.min_by(f"o{k}", "line_no").alias(f"o{k}") for k in range(len(levels))),
    )
    path = F.array_join(F.filter(F.array(*(F.when(F.col("head.lv") > k, F.col(f"o{k}").cast("string")) for k in range(len(levels)))), lambda x: x.isNotNull()), ">")
    names = F.array(*(F.lit(n) for n, _ in levels))
    content = T.strip(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    return grouped.select(key, F.col("node").alias("node_id"), F.get(names, F.col("head.lv")).alias("level"), F.col("head.number").alias("number"), path.alias("path"), content.alias("content"), "start_char", "end_char").where("content <> ''")


def neighbours(df: DataFrame, doc: str, chunk: str, position: str) -> DataFrame:
    """previous and next chunk of the same document."""
    w = Window.partitionBy(doc).orderBy(position, chunk)
    return df.withColumn("prev_id", F.lag(chunk).over(w)).withColumn("next_id", F.lead(chunk).over(w))


def paragraphs(df: DataFrame, key: str, text: str, least: int = 1) -> DataFrame:
    """(key, chunk_no, chunk_id, content, n_words): the paragraphs of at least so many characters."""
    parts = F.filter(F.transform(F.split(text, "\n"), T.trim), lambda x: F.length(x) >= least)
    out = df.select(F.col(key), F.posexplode(parts).alias("chunk_no", "content"))
    return out.select(key, "chunk_no", F.concat_ws("_", F.col(key).cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"), "content", T.word_count(F.col("content")).alias("n_words"))


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters, parted at the widest separator that serves, each led by the last ``overlap`` ones before it."""
    def parted(t: str, k: int) -> list[str]:
        if len(t) <= size or k == len(separators):
            return [t]
        if separators[k] == "":
            return [t[i : i + size] for i in range(0, len(t), size)]
        bits = t.split(separators[k])
        whole = [b + separators[k] for b in bits[:-1]] + [bits[-1]]
        return [p for b in whole if b for p in parted(b, k + 1)]

    packed, held = [], ""
    for bit in parted(text, 0):
        if held and len(held) + len(bit) > size:
            packed.append(held)
            held = ""
        held += bit
    if held:
        packed.append(held)
    return [packed[i] if i == 0 else packed[i - 1][-overlap:] + packed[i] if overlap else packed[i] for i in range(len(packed))]


def split_stripped(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces as above, but without their separators and blanks, packed with a blank between, each led by the end of the one before it, lead included."""
    overlap = max(0, min(overlap, size - 1))

    def parted(t: str, k: int) -> list[str]:
        if len(t) <= size:
            return [t]
        if k == len(separators) or separators[k] == "":
            return [t[i : i + size] for i in range(0, len(t), size)]
        bits = [b for b in map(str.strip, t.split(separators[k])) if b]
        return parted(t, k + 1) if len(bits) <= 1 else [p for b in bits for p in parted(b, k + 1)]

    packed: list[str] = []
    for bit in filter(None, map(str.strip, parted(text.strip(), 0))):
        if packed and len(packed[-1]) + 1 + len(bit) <= size:
            packed[-1] += " " + bit
        else:
            packed.append(bit)
    for i in range(1, len(packed) if overlap else 0):
        packed[i] = f"{packed[i - 1][-overlap:].strip()} {packed[i]}".strip()
    return packed


def recursive_chunks(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200, lossless: bool = False) -> DataFrame:
    """(key, chunk_no, content): packing is sequential, so it runs in Python on Arrow batches, document by document.
    Lossless chunks keep separators and blanks and join to the text."""
    split_ = split_text if lossless else split_stripped

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, n, c) for k, t in zip(f["k"], f["t"]) for n, c in enumerate(split_(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "content"])

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} long, chunk_no int, content string")


def emit_chunks(nodes: DataFrame, key: str, most_words: int = 1200) -> DataFrame:
    """Nodes that become chunks: points always; clauses without points unless too long; articles without clauses; and articles of which nothing else was taken."""
    child = nodes.select(F.col(key), F.explode(F.split("path", ">")).alias("ancestor"), F.col("level").alias("below")).where("ancestor <> ''").groupBy(key, F.col("ancestor").cast("long").alias("node_id")).agg(F.collect_set("below").alias("below"))
    n = nodes.join(child, [key, "node_id"], "left").withColumn("below", F.coalesce("below", F.expr("cast(array() as array<string>)")))
    words = T.word_count(F.col("content"))
    take = F.when(F.col("level") == "point", True).when(F.col("level") == "clause", (words <= most_words) & ~F.array_contains("below", "point")).when(F.col("level") == "article", ~F.array_contains("below", "clause")).otherwise(False)
    marked = n.withColumn("take", take)
    taken = marked.where("take").select(F.col(key), F.explode(F.split("path", ">")).alias("a")).where("a <> ''").select(F.col(key), F.col("a").cast("long").alias("node_id")).distinct().withColumn("has", F.lit(True))
    out = marked.join(taken, [key, "node_id"], "left")
    return out.where(F.col("take") | ((F.col("level") == "article") & F.col("has").isNull())).drop("take", "has", "below")
