from hashlib import sha256

from pyspark.sql import functions as F

from tessera.operators import corpus


def test_record_takes_the_first_given_value(spark):
    a = spark.createDataFrame([(1, "", "x"), (2, "A", None)], "id long, title string, number string")
    b = spark.createDataFrame([(1, "B", "y"), (3, "C", "z")], "id long, title string, number string")
    got = sorted(tuple(r) for r in corpus.record([a, b.drop("number")], "id", ["title", "number"]).collect())
    assert got == [(1, "B", "x"), (2, "A", None), (3, "C", None)]


def test_html_metadata(spark):
    html = "<title>T</title><h1>Luật <b>mới</b></h1><table><tr><td>Số hiệu</td><td>59/2020/QH14</td></tr></table><p>Cơ quan: Quốc hội</p><p>ngày 17/06/2020</p>"
    df = spark.createDataFrame([(1, html)], "id long, html string")
    r = corpus.html_metadata(df, "id", "html", {"number": "Số hiệu", "issuer": "Cơ quan", "signer": "Người ký"}).first()
    assert (r["title"], r["number"], r["signer"], str(r["first_date"])) == ("Luật mới", "59/2020/QH14", None, "2020-06-17") and r["issuer"].startswith("Quốc hội")


def test_document_id(spark):
    rows = [("1/2020/X", "Luật A", "https://h/p/q?x"), (None, "Luật A", "u"), (None, " ", "https://h/p/q?x")]
    df = spark.createDataFrame(rows, "n string, t string, u string")
    got = [r["i"] for r in df.select(corpus.document_id(F.col("n"), F.col("t"), F.col("u")).alias("i")).collect()]
    assert got[0] == "luat_a_1_2020_x" and got[1] == "luat_a" and got[2].startswith("p_q_") and len(got[2]) == 12


def test_incremental(spark):
    index = spark.createDataFrame([("a", "1", True), ("b", "1", True), ("c", "1", True), ("b", "0", False)], "f string, h string, is_active boolean")
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "f string, h string")
    got = sorted(tuple(r) for r in corpus.incremental(index, files, "f", "h").collect())
    assert got == [("a", "1", True), ("b", "0", False), ("b", "1", False), ("b", "2", True), ("c", "1", False), ("d", "1", True)]


def test_cache_lives_so_long(spark):
    asked = spark.createDataFrame([(1, "Điều 5 là gì?", 5000), (2, "other", 5000)], "question_id long, question string, at long")
    cache = spark.createDataFrame([("dieu 5  la gi", "old", 1000), ("ĐIỀU 5 LÀ GÌ", "new", 2000), ("điều 5 là gì", "later", 6000), ("other", "stale", 1)], "question string, answer string, at long")
    assert [tuple(r) for r in corpus.cached(asked, cache, 3600).collect()] == [(1, "new")]


def test_exports(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, " ", "y")], "id long, text string, lang string")
    assert [tuple(r) for r in corpus.for_embedding(df, "id", "text").collect()] == [(1, "a", ("x",))]
    got = spark.createDataFrame([("<b>n/a</b>",), ("<i>v</i> 1",)], "c string").select(corpus.provider_value(F.col("c"), ("n/a",)).alias("v")).collect()
    assert [r["v"] for r in got] == [None, "v 1"]
    q = spark.createDataFrame([("q7", None, " ask  me "), (None, "t", None), ("x", " ", None)], "id string, question string, text string")
    assert sorted(r["question"] for r in corpus.questions(q, ["question", "text"], ["id"]).collect()) == ["ask me", "t"]


def test_chunks_lose_spaces_alone(spark):
    """Digits that equal a line's number stay, spaces of any width at the ends go."""
    from tessera.operators import legal, structure

    texts = spark.createDataFrame([(1, "0 ends in 0\n \n  one 1　\n2"), (2, "0\n1")], "id long, t string")
    want = {(1, 0): "0 ends in 0", (1, 1): "one 1", (1, 2): "2", (2, 0): "0", (2, 1): "1"}
    got = {(r["id"], r["chunk_index"]): r["content_hash"] for r in legal.chunk_rows(texts, "id", "t").collect()}
    assert got == {k: sha256(v.encode()).hexdigest() for k, v in want.items()}
    assert {(r["id"], r["chunk_no"]): r["content"] for r in structure.paragraphs(texts, "id", "t").collect()} == want
