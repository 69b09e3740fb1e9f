"""Text functions as column expressions: folding, tokens, slugs, overlaps. All stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keyword search leaves out.
STOPWORDS = ("và", "là", "của", "cho", "với", "the", "is", "are", "of", "to", "a", "an")
WORD = r"[\p{L}\p{N}_]+"
#: Whole numbers of legal documents are one token.
LEGAL_REF = r"(?iu)\d+(?:/\d+)*(?:-[A-Z]+)*/[A-Z0-9À-ỴĂÂĐÊÔƠƯ\-]+"


@lru_cache
def _marks() -> tuple[str, str]:
    """Characters below U+10000 that decompose to one base letter and marks, and their base letters."""
    src, dst = [], []
    for code in range(0xC0, 0x10000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        base = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(base) == 1 and base[0] != c and len(c.lower()) == 1:
            src.append(c)
            dst.append(base[0])
    return "".join(src), "".join(dst)


def strip_accents(c: Column, stroke_d: bool = True) -> Column:
    """Letters without their marks, case kept; đ becomes d unless stroke_d is false."""
    src, dst = _marks()
    if stroke_d:
        src, dst = src + "đĐ", dst + "dD"
    return F.regexp_replace(F.translate(c, src, dst), r"\p{Mn}", "")


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return strip_accents(F.lower(c))


def folded(text: str) -> str:
    """A constant in the form of fold()."""
    lowered = text.lower().replace("đ", "d")
    return "".join(x for x in unicodedata.normalize("NFD", lowered) if unicodedata.category(x) != "Mn")


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def trim(c: Column) -> Column:
    """Without spaces, of whatever width, at the ends; tabs and line breaks stay."""
    return F.regexp_replace(c, r"^\p{Zs}+|\p{Zs}+$", "")


def squash(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def match_text(c: Column) -> Column:
    """Folded, with letters, digits and / . - alone."""
    return squash(F.regexp_replace(fold(c), r"[^0-9a-z\s/.\-]+", " "))


def clean_space(c: Column) -> Column:
    """BOM and carriage returns go, trailing blanks go, runs of blanks become one, of line breaks two."""
    c = F.regexp_replace(F.regexp_replace(c, "﻿", ""), r"\r\n?", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" ?\n", "\n")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def slug(c: Column, length: int = 160) -> Column:
    """Folded words joined by underscores. A slug that is cut ends in a hash of the whole, so that long ones stay apart."""
    whole = F.regexp_replace(F.regexp_replace(fold(c), r"[^a-z0-9]+", "_"), "^_+|_+$", "")
    cut = F.concat(F.rtrim(F.substring(whole, 1, length - 9), F.lit("_")), F.lit("_"), F.substring(F.md5(whole), 1, 8))
    return F.when(F.length(whole) <= length, whole).otherwise(cut)


def tokens(c: Column, stopwords: tuple[str, ...] = STOPWORDS, least: int = 2) -> Column:
    """Words in lower case, without stopwords and without short ones."""
    found = F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(*stopwords)) if stopwords else F.filter(found, lambda t: F.length(t) >= least)


def bigrams(t: Column) -> Column:
    """Adjacent tokens joined by an underscore."""
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat(a, F.lit("_"), b))


def index_tokens(c: Column, with_bigrams: bool = True) -> Column:
    """Tokens of keyword search: words, whole legal numbers, and bigrams of the words."""
    words = tokens(c)
    refs = F.regexp_extract_all(squash(F.lower(c)), F.lit(LEGAL_REF), F.lit(0))
    return F.concat(words, refs, bigrams(words)) if with_bigrams else F.concat(words, refs)


def word_count(c: Column) -> Column:
    return F.when(squash(c) == "", 0).otherwise(F.size(F.split(squash(c), " ")))


def token_estimate(c: Column) -> Column:
    return F.floor(word_count(c) * 1.3).cast("int")


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has."""
    q = F.array_distinct(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, text)) / F.size(q))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def density(t: Column) -> Column:
    """Distinct tokens over all."""
    return F.when(F.size(t) == 0, 0.0).otherwise(F.size(F.array_distinct(t)) / F.size(t))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?\n]"), strip), lambda s: s != "")


def int_like(c: Column) -> Column:
    """An integer, or the digits of a mixed string; null without digits."""
    return F.coalesce(F.trim(c).try_cast("long"), F.nullif(F.regexp_replace(c, r"\D", ""), F.lit("")).try_cast("long"))


def stable_id(c: Column) -> Column:
    """A non-negative number of 63 bits: the first 8 bytes of the text's SHA-256 without their highest bit."""
    digest = F.sha2(c, 256)
    first = F.conv(F.substring(digest, 1, 1), 16, 10).cast("int") % 8
    return F.conv(F.concat(first.cast("string"), F.substring(digest, 2, 15)), 16, 10).cast("long")


def article_number(c: Column) -> Column:
    """The number of an article heading, without its word."""
    return F.nullif(F.regexp_extract(c, r"(?iu)(?:điều\s+)?(\d+[a-zđ]?)", 1), F.lit(""))


def legal_code(*columns: Column) -> Column:
    """The first legal number over several columns."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, r"\d+/\d{4}/[A-ZĐ0-9\-]+", 0), F.lit("")) for c in columns))


def joined_text(*columns: Column) -> Column:
    """Parts that are not blank, by line."""
    return F.concat_ws("\n", *(F.nullif(F.trim(c), F.lit("")) for c in columns))


def abbreviations(c: Column, rules: dict[str, str]) -> Column:
    """Each abbreviation (a pattern) is followed by its full form."""
    for pattern, full in rules.items():
        c = F.regexp_replace(c, f"({pattern})", f"$1 {full}")
    return c


def contained(c: Column, phrases: list[str]) -> Column:
    """The phrases that occur in a text, in their order."""
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(c, p)) if phrases else F.array().cast("array<string>")
