"""Expected rows are worked by hand from the rules as surveyed."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessera.operators import relations, routing, rules, validity


def one(spark, column, **columns):
    names = list(columns) or ["x"]
    return spark.createDataFrame([tuple(columns.values()) or (1,)], ", ".join(f"{n} string" if columns else f"{n} int" for n in names)).select(column).first()[0]


def found(spark, text, number="5/2020/NĐ-CP", **options):
    docs = spark.createDataFrame([("d", number, text)], "doc_id string, doc_number string, text string")
    return [(r["relation"], r["target_number"], r["confidence"], r["zone"], r["start"], r["note"]) for r in relations.documents(docs, **options).orderBy("start", "zone").collect()]


def test_zones(spark):
    middle = "x " * 5000
    assert found(spark, "Căn cứ Luật số 59/2020/QH14; " + middle) == [("GUIDED_BY", "59/2020/QH14", 1.0, "preamble", 15, None)]
    assert found(spark, middle + "Căn cứ Luật số 59/2020/QH14; ") == []
    assert found(spark, "thay thế 1/2019/NĐ-CP " + middle) == []
    assert found(spark, middle + "thay thế 1/2019/NĐ-CP") == [("REPLACES", "1/2019/NĐ-CP", 1.0, "ending", 10009, None)]
    # a short text is both beginning and end
    assert found(spark, "Căn cứ 59/2020/QH14. Bãi bỏ 1/2019/NĐ-CP.") == [("GUIDED_BY", "59/2020/QH14", 1.0, "preamble", 7, None), ("REPLACES", "1/2019/NĐ-CP", 1.0, "ending", 28, None), ("GUIDED_BY", "1/2019/NĐ-CP", 1.0, "preamble", 28, None)]


def test_context_is_of_600_characters(spark):
    for gap, there in ((590, True), (620, False)):
        assert bool(found(spark, "y " * 3000 + "thay thế" + " " + "z" * gap + " 1/2019/NĐ-CP", before=600)) == there
    assert found(spark, "Căn cứ " + "z" * 40 + " 1/2019/NĐ-CP", before=20) == []


def test_guards(spark):
    pad = "y " * 3000
    assert found(spark, pad + "hướng dẫn thực hiện, thay thế 1/2019/NĐ-CP") == []
    assert found(spark, pad + "có liên quan, sửa đổi 1/2019/NĐ-CP") == []
    assert found(spark, pad + "sửa đổi 1/2019/QH14 ") == []  # a decree changes no law
    assert found(spark, pad + "sửa đổi 1/2021/NĐ-CP ") == []  # nor a later one
    assert found(spark, pad + "sửa đổi 1/2021/NĐ-CP ", number=None) == [("AMENDS", "1/2021/NĐ-CP", 1.0, "ending", 6008, None)]
    assert found(spark, "năm 2015 " + pad + "sửa đổi 1/2021/XX ", number="khác") == []  # the year comes from the text
    assert found(spark, "Nội dung hợp nhất. Yêu cầu hỗ trợ. thay thế 1/2019/NĐ-CP") == []
    assert found(spark, "thay thế [1/2018/NĐ-CP](https://a.b) 1/2019/NĐ-CP Chú thích màu chỉ dẫn thay thế 1/2017/NĐ-CP") == [("REPLACES", "1/2019/NĐ-CP", 1.0, "ending", 10, None)]
    assert found(spark, None) == [] and found(spark, "") == []


def test_verdicts(spark):
    pad = "y " * 3000
    assert found(spark, pad + "sửa đổi 5/2018/NĐ-CP") == [("REPLACES", "5/2018/NĐ-CP", 0.9, "ending", 6008, "same_law_different_year_is_replacement_not_amendment")]
    got = found(spark, pad + "bổ sung 1/2001/AA, 2/2002/BB, 3/2003/CC, 4/2004/DD")
    assert [(r[1], r[2], r[5]) for r in got] == [("1/2001/AA", 1.0, None), ("2/2002/BB", 1.0, None), ("3/2003/CC", 1.0, None), ("4/2004/DD", 0.9, "multiple_docs_in_context_ambiguous")]


def test_nearest_word_is_of_all_words(spark):
    verdict = lambda context, relation: tuple(one(spark, validity.by_words(F.col("c"), F.lit(relation), F.lit("5/2020/NĐ-CP"), F.lit("45/2019/NĐ-CP")), c=context))
    far = "x" * 800
    assert verdict(f"bổ sung {far} sửa đổi 45/2019/NĐ-CP", "AMENDS") == (True, "AMENDS", "")
    assert verdict(f"sửa đổi {far} 45/2019/NĐ-CP", "AMENDS") == (False, "AMENDS", "target_too_far_from_relation_keyword")
    # the first place of each word counts, not its nearest
    assert verdict(f"sửa đổi {far} sửa đổi 45/2019/NĐ-CP", "AMENDS")[2] == "target_too_far_from_relation_keyword"
    assert verdict("THEO QUY ĐỊNH TẠI 45/2019/NĐ-CP", "REPLACES") == (False, "GUIDED_BY", "context_shows_guided_by_not_amends")
    assert verdict("bãi bỏ 45/2019/NĐ-CP", "AMENDS") == (False, "REPLACES", "context_shows_replaces_not_amends")
    assert verdict("sửa đổi 45/2019/NĐ-CP", "GUIDED_BY") == (False, "AMENDS", "context_shows_amends_not_guided")


def test_resolution(spark):
    docs = spark.createDataFrame([("a", "1/2019/NĐ-CP", "thay thế 2/2018/NĐ-CP, 1/2019/NĐ-CP"), ("b", "2/2018/NĐ-CP", "Căn cứ 7/2001/QH"), ("c", "2/2018/NĐ-CP", None), (None, "7/2001/QH", "x"), ("e", None, "y")], "doc_id string, doc_number string, text string")
    r = relations.resolved(relations.documents(docs), docs)
    assert sorted(map(tuple, relations.edges(r).collect())) == [("a", "c", "REPLACES", 1.0)]
    assert tuple(relations.counts(r).first()) == (1, 0, 1, 0, 2)
    nobody = relations.resolved(relations.documents(docs.limit(0)), docs)
    assert tuple(relations.counts(nobody).first()) == (0, 0, 0, 0, 0)


def test_mentions_in_sql(spark):
    relations.register(spark)
    spark.createDataFrame([(1, "Điều 3 và điều 14"), (2, None), (3, "")], "id int, t string").createOrReplaceTempView("told")
    rows = spark.sql("select id, m.* from told, lateral mentions(t, '(?i)(?<kind>điều) (?<no>\\\\d+)', 4) m order by start").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "Điều 3", "", "Điều", "3"), (1, 10, "điều 14", " và ", "điều", "14")]
    assert rows[0].asDict().keys() == {"id", "start", "ref", "context", "kind", "no"}
    with pytest.raises(AnalysisException, match="constant"):
        spark.sql("select * from told, lateral mentions(t, t, 4)").collect()


def test_accented_taxonomy(spark):
    taxonomy = {"business_law": ["đất"], "land_law": ["đất đai", "Quy hoạch"], "bid_law": ["đấu thầu"]}
    named = lambda q: one(spark, routing.domains(F.col("q"), None, taxonomy), q=q)
    assert named("quy hoạch đất đai ở quận 1") == ["land_law"]
    assert named("QUY HOACH") == ["land_law"] and named("Đấu thầu và đất đai") == ["land_law", "bid_law"] and named("gì") == ["business_law"]
    questions = spark.createDataFrame([("q", "quy hoạch đất đai ở đâu", "PARENT_CONTEXT")], "query_id string, question string, route string")
    seed = "query_id string, rank int, score double, content string, doc_title string, citation string, article string, source_url string"
    for text, reasons in (("Điều 5 luật ĐẤT ĐAI", ""), ("điều 5 luật khác", "satellite_domain_mismatch")):
        seeds = spark.createDataFrame([("q", 1, 0.9, text, "t", "c", "Điều 5", "u"), ("q", 2, 0.7, "x", "t", "c", "a", "u")], seed)
        assert routing.check(questions, seeds, taxonomy).first()["reasons"] == reasons


def test_edge_confidence(spark):
    long = " y" * 60
    score = lambda c, kind="REFERS_TO": tuple(one(spark, rules.edge_confidence(F.col("c"), F.lit(kind)), c=c))
    assert score("Điều 5 Luật 1/2020/QH14" + long) == (1.0, "simple_explicit_ref")
    assert score("1/2020/QH14") == (0.9, "short_context") and score(None, None) == (0.9, "short_context")
    assert score("1/2020/QH14 2/2020/QH14" + long, "EXCLUDED_REF") == (0.85, "two_doc_numbers; excluded_ref")
    assert score("1/2020/QH14 2/2020/QH14 2/2020/QH14 HOẶC  KHOẢN", "EXCLUDED_REF") == (0.0, "multiple_doc_numbers(3); complex_context; branching_structure; excluded_ref; short_context")
    assert score("theo quy định tại khoản 1 và khoản 2" + long) == (0.65, "branching_structure")
