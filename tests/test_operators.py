import gzip
import json

import pytest

from pyspark.sql import functions as F

from tessera.operators import bm25, dedupe, evaluation, fusion, graph, history, rules, selection, structure
from tessera.sources import files
from tessera.streaming import events


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_difference(spark):
    old = spark.createDataFrame([("b", "1"), ("c", "1"), ("d", None)], "k string, c string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", None)], "k string, c string")
    assert rows(dedupe.difference(old, new, "k", "c")) == [("a", "added"), ("b", "changed"), ("c", "removed"), ("d", "same")]


def test_dedupe_orders(spark):
    df = spark.createDataFrame([("x", 1, 0.5, "a"), ("x", 2, 0.9, "b"), (None, 3, 0.1, "a"), (None, 4, 0.1, "a")], "k string, p int, s double, src string")
    assert [r[1] for r in rows(dedupe.first_wins(df, ["k"], ["p"]).where("k is not null"))] == [1]
    assert dedupe.first_wins(df, ["k"], ["p"]).count() == 3 and dedupe.first_wins(df, ["k"], ["p"], drop_null=True).count() == 1
    assert dedupe.last_wins(df.where("k = 'x'"), ["k"], ["p"]).first()["p"] == 2
    assert dedupe.merge_sources(df.where("k = 'x'"), ["k"], "s", "src", ["p"]).first()["sources"] == ["a", "b"]


def test_precision_recall(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"])], "p array<string>, g array<string>")
    r = df.select(*evaluation.precision_recall(F.col("p"), F.col("g"))).first()
    assert (r["precision"], r["recall"], r["f"], r["tp"], r["fp"], r["fn"]) == (0.5, 0.5, 0.5, 1, 1, 1)
    gold = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "id int, items array<string>")
    out = {r["id"]: r["recall"] for r in evaluation.evaluate(gold, gold.where("id = 1"), "id", "items").collect()}
    assert out == {1: 1.0, 2: 0.0}


def test_bm25_by_hand(spark):
    import math

    docs = spark.createDataFrame([(1, "xx yy"), (2, "xx xx zz"), (3, "ww")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "xx xx")], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in bm25.search(docs, q, "doc_id", "item_id", "text", "text").collect()}
    idf = math.log(1 + 1.5 / 2.5)
    want = {d: 2 * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / 2)) for d, f, n in ((1, 1, 2), (2, 2, 3))}
    assert got == {d: round(x, 6) for d, x in want.items()}


def test_fusion_without_candidates(spark):
    none = spark.createDataFrame([], "query_id long, doc_id long, score double")
    assert fusion.rrf([none, none]).count() == 0 and fusion.weighted(none, none, 0.5).count() == 0
    assert fusion.linear(none.withColumnRenamed("score", "bm25"), {"bm25": 1.0}).count() == 0


def test_token_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, 10, 1, 50), (1, 11, 2, 60), (1, 12, 3, 40)], "query_id long, doc_id long, rank int, cost int")
    assert [r[1] for r in rows(selection.token_budget(df, 100))] == [10, 12]


def test_dynamic_contexts(spark):
    c = [(1, 1, "document", "A", None, 0.9), (1, 2, "document", "A", None, 0.8), (1, 3, "article", "A", "1", 0.8), (1, 4, "article", "B", "2", 0.7), (1, 5, "chunk", "C", None, 0.7), (1, 6, "chunk", "A", None, 0.6)]
    df = spark.createDataFrame(c, "query_id long, rank int, level string, doc string, article string, score double")
    assert [r[1] for r in rows(selection.dynamic_contexts(df))] == [1, 3, 4, 6]


def test_structure(spark):
    text = "Chương I\nĐiều 1. Phạm vi\n1. Một\na) Điểm\n2. Hai\nĐiều 2. Khác\nthân"
    n = structure.parse(spark.createDataFrame([(7, text)], "doc long, text string"), "doc", "text")
    got = [(r["level"], r["number"], r["content"]) for r in n.orderBy("node_id").collect()]
    assert got == [("chapter", "I", "Chương I"), ("article", "1", "Điều 1. Phạm vi"), ("clause", "1", "1. Một"), ("point", "a", "a) Điểm"), ("clause", "2", "2. Hai"), ("article", "2", "Điều 2. Khác\nthân")]
    assert [r["path"] for r in n.orderBy("node_id").collect()] == ["", "0", "0>1", "0>1>2", "0>1", "0"]
    assert [r["number"] for r in structure.emit_chunks(n, "doc").orderBy("node_id").collect()] == ["a", "2", "2"]
    assert all(text[r["start_char"] : r["end_char"]].startswith(r["content"][:5]) for r in n.collect())


def test_split_text():
    text = "\n\n".join("word " * n for n in (30, 80, 300, 5))
    parts = structure.split_text(text, 200, 20)
    assert len(parts[0]) <= 200 and all(len(p) <= 220 for p in parts)
    assert parts[0] + "".join(p[20:] for p in parts[1:]) == text
    assert structure.split_text("", 10, 2) == []


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "X"), ("b", "c", "X"), ("d", "c", "Y")], "src string, dst string, relation string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert rows(graph.k_hop(e, seeds, 3)) == [("a", "b", 1, "a", "b", "X"), ("a", "c", 2, "b", "c", "X"), ("a", "d", 3, "d", "c", "Y")]
    assert rows(graph.k_hop(e, seeds, 3, ("X",))) == [("a", "b", 1, "a", "b", "X"), ("a", "c", 2, "b", "c", "X")]
    # a cycle, two ways to a node, a node of many edges, a depth beyond the graph's
    cycle = spark.createDataFrame([("a", "b", "Z"), ("b", "a", "A"), ("a", "c", "A"), ("b", "d", "B"), ("c", "d", "A"), *((f"x{i}", "d", "M") for i in range(50)), (None, "a", "A")], "src string, dst string, relation string")
    got = {r["node"]: (r["hops"], r["via_src"], r["via_dst"], r["via_relation"]) for r in graph.k_hop(cycle, seeds, 9).collect()}
    assert got == {"b": (1, "a", "b", "Z"), "c": (1, "a", "c", "A"), "d": (2, "c", "d", "A")} | {f"x{i}": (3, f"x{i}", "d", "M") for i in range(50)}
    plan = lambda k: len(graph.k_hop(cycle, seeds, k)._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert plan(3) - plan(2) <= 3


def test_domain_filter(spark):
    g = [rules.Group("tax", ("thue tndn",), ("thue", "hoa don"), ("tax",))]
    df = spark.createDataFrame([("thue tndn", "x", True), ("x", "thue hoa don", True), ("x", "thue hoa don", False), ("x", "thue", True)], "t string, c string, n boolean")
    got = rules.domain_filter(df, F.col("t"), F.col("c"), g, F.col("n"), F.lit(False), F.lit(False), F.lit(False)).collect()
    assert [r["include"] for r in got] == [True, True, False, False] and got[0]["candidate_domains"] == ["tax"]


def test_history(spark):
    df = spark.createDataFrame([(1, 1, "ok", 0.9), (1, 2, "what about article 5", 0.1), (1, 3, "thanks", 0.1), (1, 4, "a longer turn here", 0.8)], "c long, t long, text string, l double")
    assert [r["m"] for r in df.select(history.meaningful(F.col("text")).alias("m")).collect()] == [False, True, False, True]
    assert [r["t"] for r in history.hybrid(df, "c", "t", "l", 2).orderBy("t").collect()] == [1, 4]
    assert df.select(history.rewrite_valid(F.lit("article 5"), F.lit("the article")).alias("v")).first()["v"] is False


def test_sources(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"id": 1, "t": "x"}\n\n{"id": 2, "t": "y"}\n')
    assert files.read_jsonl(spark, f"{tmp_path}/*.gz", "id long, t string").count() == 2
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n{bad\n{"id": 3}\n')
    good, bad = files.read_quarantined(spark, f"{tmp_path}/b.jsonl", "id long")
    assert [r["id"] for r in good.orderBy("id").collect()] == [1, 3] and [(r["line_no"], r["raw"]) for r in bad.collect()] == [(2, "{bad")]
    (tmp_path / "c.json").write_text(json.dumps({"questions": [{"id": 1}, {"id": 2}]}))
    assert files.read_nested(spark, f"{tmp_path}/c.json", "struct<id: long>").count() == 2
    assert files.detect_fields(["Title", "BODY"], {"title": ("name", "title"), "text": ("content", "body"), "x": ("y",)}) == {"title": "Title", "text": "BODY"}
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    assert files.append_new(df.where("id = 1"), f"{tmp_path}/out", "id") == 1 and files.append_new(df, f"{tmp_path}/out", "id") == 1
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert files.fingerprint(df, "id", "t") == files.fingerprint(df.orderBy(F.desc("id")), "id", "t") != files.fingerprint(df.limit(1), "id", "t")


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events.file_stream(spark, f"{tmp_path}/in", e.schema, per_trigger=1)
    out = f"{tmp_path}/out"

    def merge(batch, _):
        new = batch.select("user_id").distinct()
        files.append_new(new, out, "user_id")

    q = events.merge_batches(stream, merge, f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert rows(spark.read.parquet(out)) == rows(e.select("user_id").distinct())


def test_articles(spark):
    from tessera.operators import legal

    df = spark.createDataFrame([(1, "mở đầu\nĐiều 1. Một\nhai\nĐiều 2. Ba")], "doc long, text string")
    assert [r["content"] for r in legal.articles(df, "doc", "text").orderBy("article_no").collect()] == ["Điều 1. Một\nhai", "Điều 2. Ba"]


def test_exact_search(spark):
    row = "row_id long, level string, doc_number string, article string, title string, citation string, content string"
    rows_ = [(1, "doc", "59/2020/QH14", None, "luật doanh nghiệp", None, None), (2, "article", "59/2020/QH14", "Điều 5", "luật doanh nghiệp", "", "Điều 5 Luật Doanh nghiệp"), (3, "chunk", "1/2010/X", "Điều 5", "khác", "c", "gì"), (4, "chunk", "2/2011/Y", "Điều 50", "gì", None, "x")]
    docs = spark.createDataFrame(rows_, row)
    q = spark.createDataFrame([(1, "Điều 5 của 59/2020/QH14"), (2, "điều 7"), (3, "59/2020/qh14"), (4, None), (5, "luật doanh nghiệp")], "query_id long, question string")
    got = {(r["query_id"], r["row_id"]): r["score"] for r in bm25.exact_search(docs, q).collect()}
    # tokens of 1: dieu cua 59 2020 qh14 (5 is too short) and its number, and four pairs: dieu_cua cua_59 59_2020 2020_qh14
    assert set(got) == {(1, 1), (1, 2), (1, 3), (3, 1), (3, 2)}
    assert got[1, 1] == pytest.approx(0.6 + 0.1 * 6 / 10)  # 59 2020 qh14, the number, 59_2020 2020_qh14
    assert got[1, 2] == pytest.approx(0.6 + 0.2 + 0.15 * 1 / 10 + 0.1 * 7 / 10 + 0.05)  # dieu too, in the title's tokens as well
    assert got[1, 3] == pytest.approx(0.2 + 0.15 * 1 / 10 + 0.1 * 1 / 10)
    # a number in another case finds its rows, but does not stand in the question as it is
    assert got[3, 1] == pytest.approx(0.1 * 6 / 6) and got[3, 2] == pytest.approx(0.1 * 6 / 6 + 0.05)
    assert [(r["row_id"], r["rank"]) for r in bm25.exact_search(docs, q, 1).orderBy("query_id").collect()] == [(2, 1), (2, 1)]


def test_confident(spark):
    df = spark.createDataFrame([(1, 5, 5, 5, 0.9, 0.2, 0.8), (2, 1, 1, 1, 0.2, 0.2, 0.5)], "query_id long, n long, n_distinct long, n_texts long, top double, gap double, confidence double")
    got = {r["query_id"]: (r["confident"], r["reasons"]) for r in fusion.confident(df).collect()}
    assert got == {1: (True, ""), 2: (False, "few_results,low_top_score")}


def test_upsert_and_limits(spark):
    from tessera.operators import legal, vectors

    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, v long, t string")
    new = spark.createDataFrame([(2, 2, "c"), (3, 1, "d")], "k long, v long, t string")
    assert [r["t"] for r in vectors.upsert(old, new, "k", "v").orderBy("k").collect()] == ["a", "c", "d"]
    s = spark.createDataFrame([("x", 5), ("y", 50)], "route string, n int").select("route", legal.limits(F.col("route"), {"y": 1}, [F.col("n") > 10], [{"docs": 1}, {"docs": 2}, {"docs": 3}]).alias("s")).collect()
    assert {r["route"]: r["s"]["docs"] for r in s} == {"x": 1, "y": 3}


def test_hash_embeddings(spark):
    from tessera.operators import vectors

    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma"), (3, ""), (4, "alpha beta")], "id long, text string")
    v = {r["id"]: r["vector"] for r in vectors.hash_embedding(df, "id", "text").collect()}
    product = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    assert abs(product(1, 4) - 1) < 1e-9 and 0 < product(1, 2) < 1 and not any(v[3])
    w = {r["id"]: r["vector"] for r in vectors.hash_embedding(df, "id", "text", whole_text="passage: ").collect()}
    assert w[1] == w[4] and w[1] != v[1]
