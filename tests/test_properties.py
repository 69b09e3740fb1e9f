"""Functions against Python on generated texts."""

import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.structure import split_text

LETTERS = st.text(st.characters(codec="utf-8", max_codepoint=0x24F, exclude_categories=("Cs", "Cc")), max_size=40)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LETTERS, min_size=30, max_size=60))
def test_text_functions(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", text.squash(F.col("t")).alias("s"), text.word_count(F.col("t")).alias("n"), text.slug(F.col("t")).alias("slug"), text.bigrams(F.split("t", " ")).alias("b")).orderBy("i").collect()
    for r, t in zip(got, texts):
        plain = re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ")
        assert r["s"] == plain and r["n"] == (len(plain.split(" ")) if plain else 0)
        folded = "".join(c for c in unicodedata.normalize("NFD", t.lower().replace("đ", "d")) if unicodedata.category(c) != "Mn")
        assert r["slug"] == re.sub("[^a-z0-9]+", "_", folded).strip("_")
        words = t.split(" ")
        assert r["b"] == [f"{a}_{b}" for a, b in zip(words, words[1:])]


@settings(max_examples=200, deadline=None)
@given(st.text("ab .\n", max_size=300), st.integers(5, 50), st.integers(0, 4))
def test_splitter_loses_nothing(t, size, overlap):
    plain, led = split_text(t, size, 0), split_text(t, size, overlap)
    assert "".join(plain) == t and len(led) == len(plain)
    assert all(p == (q[-overlap:] if overlap else "") + r for p, q, r in zip(led[1:], plain, plain[1:])) and led[:1] == plain[:1]
    assert all(len(p) <= size for p in split_text(t, size, 0))
