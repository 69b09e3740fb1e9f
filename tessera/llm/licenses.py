"""Licence scans by canonical digest.

A text is canonicalised line by line: lower case, copyright statements dropped, equivalent spellings made
one, everything but letters and digits made a space. SHA-256 digests of the result, of the whole text and of its
single lines, are hash-joined to the digests of known licence texts and statements. All of it is
DataFrame expressions; a document's lines meet the known digests only if they are no longer than the
longest known text, which no match can be beyond.

Defined results: null and empty texts match nothing; known texts that are empty once canonicalised are
left out; several known licences of one digest are all given; repeated rows each get their row; an empty
table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Lines that begin with a copyright mark.
COPYRIGHT = r"^\W*(copyright|copr\.|©|\(c\)).*$"
#: Words that follow "copyright" in licence texts and are nobody's name.
_NO_OWNER = (
    r"(?!(?i:notices?|holders?|owners?|ownership|licen[cs]es?|licensors?|licensed|laws?|statements?|interests?|disclaimers?|permissions?|treat(?:y|ies)|conventions?|acts?|protections?|protected|rights?|patents?|trademarks?|information|messages?|attributions?"
    r"|assign\w*|claims?|infring\w*|material|works?|terms?|files?|lines?|headers?|status|legends?|policy|exceptions?|doctrines?|registration|legislation|subsists|relinquish\w*|dedication|related|the\s+(?:software|program|library|works?|document)"
    r"|also|means?|and|or|in|on|is|to|of|for|from|with|without|that|which|this|these|those|as|at|if|under|over|are|was|were|has|have|had|may|must|shall|will|can|cannot|does|not|nor|but|it|its|any|than|then|your?|we|our|they|their|such|applies|resulting|where|when)(?![\p{L}\p{N}]))"
)
_GAP = r"[^\p{L}\p{N}©<\[{]*"
_OWNED = rf"(?i:copyright(?![\p{{L}}_\"”])|copr\.){_GAP}(?:©|\d\d|[<\[{{]|{_NO_OWNER}\p{{L}})"
_NAME = r"(?:[\p{Lu}\p{N}\"'&<(\[]\S*|(?i:and|of|the|by|for|at|de|der|van|von|et|al|all|rights|reserved|others|contributors|authors)[.,;]?)"
_NAMES = rf"(?=\p{{Lu}}|by\s)(?!.*\b(?i:your?|must|shall|may|will|is|are|be|not|any|this|that|if|it|to|or|with|without|such)\b){_NAME}(?:\s+{_NAME}){{0,11}}\s*$"
#: Of those, the lines that only say whose the copyright is, by a year, a second mark, a place for a name, or a name.
#: Others are licence text that a line break has put there: "copyright notice and ...", "(c) You must ...".
OWNERSHIP = rf"^\W*(?:©|{_OWNED}|(?i:\(c\)){_GAP}(?:(?:19|20)\d\d|©|[<\[{{]|{_OWNED}|{_NAMES}))"
#: Spellings that licence matching holds to be equal, and what they become.
EQUIVALENT = (
    ("https://", "http://"), ("sub-licen[cs]e", "sublicense"), ("licence", "license"), ("organisation", "organization"), ("favour", "favor"), ("wilful", "willful"), ("fulfilment", "fulfillment"),
    ("judgement", "judgment"), ("merchantibility", "merchantability"), ("analog(ue)?", "analogue"), ("centre", "center"), ("per cent", "percent"), ("non-?commercial", "noncommercial"), ("&", " and "), ("[‘’]", "'"),
)
STATEMENTS = (
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("ARR", "All rights reserved."),
)
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


#: Whole licence texts, by name, without the title and the copyright lines of their own that copies differ in.
TEXTS = Path(__file__).parent / "license_texts"
#: Titles that copies of a text have or lack.
TITLES = {
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License"), "Unlicense": ("The Unlicense",),
}


def editions(name: str, text: str) -> list[str]:
    """The forms in which a text is commonly distributed."""
    forms = [text]
    if "END OF TERMS AND CONDITIONS" in text:
        # what follows tells how to apply the licence; copies end with the terms, with that line or without
        before = text.partition("END OF TERMS AND CONDITIONS")[0]
        forms += [before, before + "END OF TERMS AND CONDITIONS"]
    if name == "Unlicense":
        forms.append(text.partition("For more information")[0])
    if name.startswith("BSD"):
        forms += [x.replace("COPYRIGHT\nHOLDER OR", "COPYRIGHT OWNER OR") for x in forms]
        forms += [re.sub(r"(?m)^\d\. ", "* ", x) for x in forms]
        forms += ["All rights reserved.\n\n" + x for x in forms]
    return forms + [f"{title}\n\n{x}" for title in TITLES.get(name, ()) for x in forms]


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of short statements and whole texts, in their common editions."""
    rows = [*STATEMENTS, ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC)]
    rows += [(file.stem, x) for file in sorted(TEXTS.glob("*.txt")) for x in editions(file.stem, file.read_text())]
    return spark.createDataFrame(rows, "license_id string, text string")


def canonical_line(line: Column) -> Column:
    low = F.lower(line)
    c = F.when(low.rlike(COPYRIGHT) & line.rlike(OWNERSHIP), F.lit("")).otherwise(low)
    for pattern, to in EQUIVALENT:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text, without empty ones. A file's wrapping into lines does not matter to the whole."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), canonical_line), lambda x: x != "")


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", known_id: str = "license_id", known_text: str = "text") -> DataFrame:
    """One row per document: id, digest (of the canonical text), license (known licences of that digest, comma-joined, or null),
    statements (known ones that a line of it is, sorted and comma-joined), n_statements, licensed."""
    lines = known.select(F.col(known_id).cast("string").alias("license"), canonical_lines(F.col(known_text).cast("string")).alias("lines"))
    digests = lines.select("license", F.array_join("lines", " ").alias("c")).where("c <> '' and license is not null")
    digests = written(digests.select(F.sha2("c", 256).alias("digest"), "license", F.length("c").alias("n")).distinct(), "licenses")
    longest = digests.agg(F.max("n")).first()[0] or 0
    names = digests.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("license"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), canonical_lines(F.col(text_col).cast("string")).alias("lines"))
    short = F.array_distinct(F.transform(F.filter("lines", lambda x: F.length(x) <= longest), lambda x: F.sha2(x, 256)))
    rows = written(rows.select("id", F.sha2(F.array_join("lines", " "), 256).alias("digest"), short.alias("short")), "digests")
    hits = rows.select("id", F.col("digest").alias("whole"), F.explode("short").alias("digest")).join(digests.select("digest", "license"), "digest")
    stated = hits.groupBy("id", "whole").agg(F.array_sort(F.collect_set("license")).alias("names"))
    out = rows.select(F.coalesce("id", F.lit(-(2**63))).alias("i"), "id", "digest").join(names, "digest", "left")
    stated = stated.select(F.coalesce("id", F.lit(-(2**63))).alias("i"), F.col("whole").alias("digest"), "names")
    out = out.join(stated, ["i", "digest"], "left")
    count = F.coalesce(F.size("names"), F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), "digest", "license", F.coalesce(F.array_join("names", ","), F.lit("")).alias("statements"), F.when(F.col("names").isNull(), F.lit(0).cast("long")).otherwise(count).alias("n_statements"), (F.col("license").isNotNull() | F.col("names").isNotNull()).alias("licensed"))
