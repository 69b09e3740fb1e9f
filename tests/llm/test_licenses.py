import re
import textwrap

import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses, queries
from tests import oracle


def test_equivalent_texts(spark, nothing):
    mit = licenses.MIT
    rows = [
        (1, mit, "z"), (2, "Copyright (c) 2020 Someone\n\n" + mit.replace("sublicense", "sub-licence").upper(), "z"), (3, "MIT Licence\r\n(c) 1999 X\r\n" + " ".join(mit.split()), "z"), (4, mit + " and more", "z"),
        (5, "prose\nReleased under the MIT Licence!\nall rights   reserved\nmore", "z"), (6, None, "z"), (7, "", "z"), (8, "!!!", "z"), (1, mit, "z"), (None, "All rights reserved.", "z"), (9, licenses.ISC, "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["license"] or "", r["statements"], r["n_statements"], r["licensed"]) for r in licenses.scan(docs, licenses.known_licenses(spark)).collect())
    want = [(-1, "ARR", "ARR", 1, True), (1, "MIT", "", 0, True), (1, "MIT", "", 0, True), (2, "MIT", "", 0, True), (3, "MIT", "MIT", 1, True), (4, "", "", 0, False), (5, "", "ARR,MIT", 2, True), (6, "", "", 0, False), (7, "", "", 0, False), (8, "", "", 0, False), (9, "ISC", "", 0, True)]
    assert got == want
    assert licenses.scan(nothing, licenses.known_licenses(spark)).count() == 0
    assert licenses.scan(docs, licenses.known_licenses(spark).limit(0)).where("licensed").count() == 0


def wrapped(text, width):
    """The text with its paragraphs in lines of this width, but for those with a line that states a copyright."""
    return "\n\n".join(p if re.search(r"(?mi)^\W*copyright (\(c\)|\[)", p) else "\n".join(textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False)) for p in text.split("\n\n"))


def test_wrapping_loses_nothing(spark):
    isc = wrapped(licenses.ISC, 74).replace("the above copyright", "the above\ncopyright")
    assert "\ncopyright notice" in isc
    rows = [("ISC", "Copyright (c) 2020 Someone <a@b.c>\n\n" + isc)]
    rows += [(name, case(wrapped(text, width))) for name, text in (("MIT", licenses.MIT), ("ISC", licenses.ISC)) for width in range(8, 121) for case in (str, str.upper)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    assert got == {i: name for i, (name, _) in enumerate(rows)}


@pytest.mark.parametrize(
    "kept,lines",
    [
        (False, ["Copyright 2020", "Copyright (c) 2020 X", "(c) 1999 X", "(C) 1999-2003 by X", "# Copyright (C) The Authors", "© X", "Copr. 1999 X", "copyright someone", "Copyright: John Smith", "Copyright <YEAR> <OWNER>", "Copyright [yyyy] [name of copyright owner]"]),
        (False, ["(c) Copyright 2001 X", "(c) Microsoft Corporation. All rights reserved.", "Copyright (c) <year> <holders>", "Copyright, 1998, X", "Copyright &copy; 2020 X", "Copyright by X", "COPYRIGHT (C) 2020 X", " * Copyright The libuv project contributors"]),
        (True, ["copyright notice and this permission notice", "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM", "copyright owner or by an individual", "copyright license to reproduce, prepare", "copyright, patent, trademark, and", "copyright law.", "copyright", "copyrighted by the Free Software Foundation"]),
        (True, ["(c) You must retain, in the Source form", "(C) YOU MUST RETAIN, IN THE SOURCE FORM", "(c) Accompany it with the information", "(c) copyright notices must stay", "\"Copyright\" also means copyright-like laws", "copyright the software, and", "(c) in any way"]),
    ],
)
def test_copyright_lines(spark, kept, lines):
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", (licenses.canonical_line(F.col("x")) != "").alias("kept")).collect()
    assert [r["x"] for r in got if r["kept"] != kept] == []


def test_common_licenses(spark):
    text = {f.stem: f.read_text() for f in licenses.TEXTS.glob("*.txt")}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "Zlib"} <= set(text)
    rows = [(name, x) for name, t in text.items() for x in (t, t.replace("\n", "\r\n"), *(wrapped(t, w) for w in (40, 60, 72, 80, 100)))]
    for name in ("BSD-2-Clause", "BSD-3-Clause"):
        rows.append((name, f"{name[:5].replace('-', ' ')}-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n{text[name]}"))
        rows.append((name, "Copyright 2020 Someone. All rights reserved.\n\n" + text[name].replace("1. ", " * ").replace("2. ", " * ").replace("3. ", " * ").replace("HOLDER OR", "OWNER OR")))
    rows.append(("Apache-2.0", text["Apache-2.0"].partition("   APPENDIX")[0]))
    rows.append(("Apache-2.0", text["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 Someone")))
    rows.append(("Zlib", "Copyright (c) 2019 X\n\n" + text["Zlib"]))
    rows.append((None, text["GPL-3.0"].replace("freedom", "liberty")))
    docs = spark.createDataFrame(list(enumerate(x for _, x in rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    assert [(rows[i][0], got[i], rows[i][1][:60]) for i in got if got[i] != rows[i][0]] == []


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    oracle.same(queries.op3_licenses(spark, sf), queries.ORACLE["op3_licenses"], oracle.connect(sf))
