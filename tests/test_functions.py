import re
import unicodedata

from pyspark.sql import functions as F

from tessera.functions import scores, text, web


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_fold_matches_unicode_decomposition(spark):
    letters = "".join(chr(c) for c in range(0xC0, 0x250)) + "ếộữĐđẮ"
    want = "".join(c for c in unicodedata.normalize("NFD", letters.lower().replace("đ", "d")) if unicodedata.category(c) != "Mn")
    assert one(spark, text.fold(F.col("t")), t=letters) == want


def test_slug_keeps_long_ones_apart(spark):
    a, b = "Điều lệ " * 40 + "a", "Điều lệ " * 40 + "b"
    x, y = one(spark, text.slug(F.col("t")), t=a), one(spark, text.slug(F.col("t")), t=b)
    assert x != y and len(x) <= 160 and re.fullmatch("[a-z0-9_]+", x)
    assert one(spark, text.slug(F.col("t")), t="Luật Doanh nghiệp 2020!") == "luat_doanh_nghiep_2020"


def test_index_tokens(spark):
    got = one(spark, text.index_tokens(F.col("t")), t="Theo 45/2026/NĐ-CP của a Luật")
    assert "45/2026/nđ-cp" in got and "của" not in got and "theo_45" in got


def test_int_like_and_counts(spark):
    assert one(spark, text.int_like(F.col("t")), t="question 17b") == 17
    assert one(spark, text.int_like(F.col("t")), t="none") is None
    assert one(spark, text.word_count(F.col("t")), t="  ") == 0
    assert one(spark, text.token_estimate(F.col("t")), t="a b c") == 3


def test_dates(spark):
    for written, iso in (("2020-06-17", "2020-06-17"), ("17/06/2020", "2020-06-17"), ("ngày 7 tháng 6 năm 2020", "2020-06-07"), ("31/02/2020", None), ("có hiệu lực từ 1-1-2021.", "2021-01-01")):
        got = one(spark, web.date_of(F.col("t")), t=written)
        assert (got and got.isoformat()) == iso


def test_urls(spark):
    assert one(spark, web.canonical(F.col("u")), u="https://a.b/c?utm_source=x&p=1&gclid=2#top") == "https://a.b/c?p=1"
    assert one(spark, web.canonical(F.col("u")), u="https://a.b/c?fbclid=x") == "https://a.b/c"
    assert one(spark, web.host(F.col("u")), u="https://u@A.b:80/c") == "a.b"
    assert one(spark, web.same_host(F.col("u"), F.col("v")), u="/x", v="https://a.b") is True
    assert one(spark, web.pagination(F.col("u"), F.lit(2)), u="https://a.b/?page=9") == ["https://a.b/?page=1", "https://a.b/?page=2"]


def test_html(spark):
    html = '<html><head><title> A  b </title><style>x</style><script type="application/ld+json">{"@type": "Legislation", "name": "n"}</script></head><body>1 &lt; 2<!-- no --><table><tr><td>K</td><td>v</td></tr><tr><td>K</td><td>w</td></tr></table><a class="q" href="/z">z</a></body></html>'
    assert one(spark, web.title(F.col("h")), h=html) == "A b"
    assert one(spark, web.visible_text(F.col("h")), h=html) == "A b 1 < 2 K v K w z"
    assert one(spark, web.table_pairs(F.col("h")), h=html) == {"K": "v"}
    assert one(spark, web.links(F.col("h")), h=html) == ["/z"]
    assert '"name": "n"' in one(spark, web.json_ld(F.col("h"), "legislation"), h=html)
    assert one(spark, web.labelled(F.col("t"), "Số hiệu"), t="Số hiệu:\n59/2020/QH14\nx") == "59/2020/QH14"


def test_validity(spark):
    rows = [("2020-01-01", None, "active", True), ("2020-01-01", None, "void", False), ("2030-01-01", None, "active", False), ("2020-01-01", "2021-01-01", "active", False), (None, "2031-01-01", None, True)]
    df = spark.createDataFrame(rows, "a string, b string, s string, want boolean")
    got = df.select("want", web.valid_on(F.col("a").cast("date"), F.col("b").cast("date"), F.col("s"), F.lit("2026-03-01").cast("date")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_scores(spark):
    df = spark.createDataFrame([(1, 2.0, [1.0, 0.0], [0.0, 0.0]), (1, 4.0, [3.0, 4.0], [3.0, 4.0]), (2, 1.0, [1.0], [1.0])], "g int, x double, a array<double>, b array<double>")
    got = df.select("g", "x", scores.minmax(F.col("x"), ["g"], 0.5).alias("m"), scores.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert {(r["g"], r["x"]): (r["m"], r["c"]) for r in got} == {(1, 2.0): (0.0, 0.0), (1, 4.0): (1.0, 1.0), (2, 1.0): (0.5, 1.0)}
    assert spark.range(1).select(scores.f_beta(F.lit(0.5), F.lit(0.5)).alias("f")).first()["f"] == 0.5
