"""A keyword index in blocks, with positions: exact best-k search by BM25 that scores few postings, and phrase search without texts.

Documents are dealt to ranges by their length (and a hash of their id), about ``per_range`` to each, by the row itself: no document is moved.
A block holds the postings of one token in one range: documents, counts, lengths, places, and what stands between the token and its
neighbours. Blocks are sorted by token and range in files, so that both are skipped by statistics; headers (how many postings, the highest count,
the smallest length) are columns of their own and read without the rest. As documents of a range are about equally long, the BM25 part of
a header's values is close above those of its postings.

Best-k search goes in four steps for all queries at once. (1) Each query's strongest token, and rare ones, are scored: the k-th best sum is a
bound that the k-th best score reaches. (2) A query's weakest tokens, as long as their bounds together stay below it, need not be
looked up to find candidates. (3) Ranges whose headers cannot reach the bound are left out; in the others the remaining tokens are scored,
and documents that the rest of their range's headers could not lift to the bound are left out. (4) The weakest tokens are looked up for
the documents that are left. Nothing that could be among the best k is left out, so results are those of scoring everything. A query of
many tokens of like weight leaves too much to be looked at; where its weights tell so at once, all its postings are scored and the steps saved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import scratch

#: Names the tables' form and default settings; changes with them, so that an index of another form is not read.
FORMAT = "blocks1-64"
K1, B = 1.5, 0.75
#: Scores are rounded to six places; bounds keep what could still round up.
SLACK = 1e-6


def part(tf, dl, avgdl, k1: float = K1, b: float = B) -> Column:
    """What a posting adds to a score, without its token's weight; grows with tf and falls with dl."""
    tf, dl = F.col(tf), F.col(dl)
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col(avgdl)))


def build(docs: DataFrame, doc_id: str, text: str, stopwords: tuple[str, ...] = T.STOPWORDS, least: int = 2, per_range: int = 64) -> dict[str, DataFrame]:
    """Tables of an index: blocks (all words, with places), terms (token, df, max_tf, min_dl), stats (n_docs, avgdl).

    Lengths count the tokens that searches look for (without stopwords and words shorter than ``least``); documents without words are counted
    and in no block. Ids are to be unique."""
    low = F.lower(text)
    searched = F.size(T.tokens(F.col(text), stopwords, least))
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(searched).alias("avgdl"), F.percentile_approx(searched, [i / 256 for i in range(1, 256)], 2000).alias("cuts")).first()
    # at most 255 lengths that part the documents evenly
    cuts = sorted(set(stats["cuts"] or []))
    parts = max(1, round(stats["n_docs"] / (len(cuts) + 1) / per_range))
    slot = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("dl"))) if cuts else F.lit(0)
    d = docs.select(F.col(doc_id).alias("doc_id"), searched.alias("dl"), F.size(F.array_distinct(T.tokens(F.col(text), stopwords, least))).alias("kinds"), F.regexp_extract_all(low, F.lit(T.WORD), F.lit(0)).alias("w"), F.split(low, T.WORD, -1).alias("s"))
    d = d.withColumn("range", slot.cast("long") * parts + F.pmod(F.xxhash64("doc_id"), F.lit(parts))).where(F.size("w") > 0)
    n = F.size("w")
    each = d.select("doc_id", "dl", "kinds", "range", F.posexplode(F.arrays_zip(F.col("w").alias("token"), F.slice("s", F.lit(1), n).alias("before"), F.slice("s", F.lit(2), n).alias("after"))).alias("pos", "z"))
    each = each.select("doc_id", "dl", "kinds", "range", F.col("z.token").alias("token"), F.struct("pos", F.col("z.before").alias("before"), F.col("z.after").alias("after")).alias("place"))
    # one exchange: both aggregations are by keys that hold (token, range)
    each = each.repartition("token", "range")
    per_doc = each.groupBy("token", "range", "doc_id", "dl", "kinds").agg(F.array_sort(F.collect_list("place")).alias("places"))
    blocks = per_doc.groupBy("token", "range").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.max(F.size("places")).alias("max_tf"), F.min("dl").alias("min_dl"),
        F.array_sort(F.collect_list(F.struct("doc_id", F.size("places").alias("tf"), "dl", "kinds", "places"))).alias("postings"),
    )
    blocks = blocks.select("token", "range", "n", "max_tf", "min_dl", F.transform("postings", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["tf"].alias("tf"), p["dl"].alias("dl"), p["kinds"].alias("kinds"))).alias("postings"), F.transform("postings", lambda p: p["places"]).alias("places"))
    return {
        "blocks": blocks.repartitionByRange("token", "range").sortWithinPartitions("token", "range"),
        "stats": docs.sparkSession.createDataFrame([(stats["n_docs"], stats["avgdl"])], "n_docs long, avgdl double"),
    }


def terms(blocks: DataFrame) -> DataFrame:
    """(token, df, max_tf, min_dl), from headers; the third table of an index."""
    return blocks.groupBy("token").agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")).repartitionByRange("token").sortWithinPartitions("token")


def tables(docs: DataFrame, doc_id: str, text: str, **options) -> dict[str, Callable[[dict[str, DataFrame]], DataFrame]]:
    """The tables of an index as functions of those before them, for files.persist_index: nothing is computed before it is called."""
    made: dict[str, DataFrame] = {}

    def part_of(name: str) -> DataFrame:
        if not made:
            made.update(build(docs, doc_id, text, **options))
        return made[name]

    return {"blocks": lambda _: part_of("blocks"), "stats": lambda _: part_of("stats"), "terms": lambda t: terms(t["blocks"])}


def weights(index: dict[str, DataFrame], queries: DataFrame, query_id: str, tokens: Column, k1: float, b: float) -> DataFrame:
    """(query_id, token, weight, df, most, avgdl): a query's tokens, what one part of each counts for, and the most it can add."""
    wanted = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    w = wanted.join(index["terms"], "token").crossJoin(index["stats"])  # one row of statistics
    weight = F.col("times") * F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return w.select("query_id", "token", weight.alias("weight"), "df", (weight * part("max_tf", "min_dl", "avgdl", k1, b)).alias("most"), "avgdl")


def _scored(rows: DataFrame, k1: float, b: float) -> DataFrame:
    """Blocks with a query's weight to (query_id, range, doc_id, value)."""
    p = rows.select("query_id", "range", "weight", "avgdl", F.explode("postings").alias("p")).select("query_id", "range", "weight", "avgdl", F.col("p.doc_id").alias("doc_id"), F.col("p.tf").alias("tf"), F.col("p.dl").alias("dl"))
    return p.select("query_id", "range", "doc_id", (F.col("weight") * part("tf", "dl", "avgdl", k1, b)).alias("value"))


def best(index: dict[str, DataFrame], queries: DataFrame, query_id: str, tokens: Column, k: int = 10, seed_postings: int = 2000, most_share: float = 0.2, k1: float = K1, b: float = B, work: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the best k documents of each query, ties by smallest id, as scoring all of them would give. With ``work``,
    (query_id, postings, scored) instead: how many postings the query's tokens have, and how many were scored."""
    blocks = index["blocks"]
    body = blocks.select("token", "range", "n", "postings")
    per_query = Window.partitionBy("query_id")
    strongest, rarest = per_query.orderBy(F.desc("most"), "token"), per_query.orderBy("df", "token").rowsBetween(Window.unboundedPreceding, 0)
    weakest = per_query.orderBy("most", "token").rowsBetween(Window.unboundedPreceding, 0)
    w = weights(index, queries, query_id, tokens, k1, b)
    w = w.withColumn("seed", (F.row_number().over(strongest) == 1) | (F.sum("df").over(rarest) <= seed_postings)).withColumn("together", F.sum("most").over(weakest))
    # no bound is above what the seeds can add; where even that one would leave most postings, a query is scored whole
    highest = F.sum(F.when(F.col("seed"), F.col("most"))).over(per_query)
    share = F.sum(F.when(F.col("together") >= F.col("highest"), F.col("df"))).over(per_query) / F.sum("df").over(per_query)
    w = scratch(w.withColumn("highest", highest).withColumn("whole", share > most_share).drop("highest"), "weights")
    whole = _scored(body.join(w.where("whole"), "token"), k1, b).select("query_id", "doc_id", "value")
    w = w.where("not whole")
    if not w.take(1):
        return _work(index, whole, None, queries, query_id, tokens) if work else _ranked(whole, k)
    first = _scored(body.join(w.where("seed"), "token"), k1, b).groupBy("query_id", "doc_id").agg(F.sum("value").alias("value"))
    reached = first.withColumn("nth", F.row_number().over(per_query.orderBy(F.desc("value")))).where(F.col("nth") == k).select("query_id", (F.col("value") - SLACK).alias("bound"))
    w = w.join(reached, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    w = w.withColumn("leads", F.col("together") >= F.col("bound"))
    # now that bounds are known, the same for what they leave
    share = F.sum(F.when(F.col("leads"), F.col("df"))).over(per_query) / F.sum("df").over(per_query)
    w = scratch(w.withColumn("whole", share > most_share), "bounds")
    few = w.agg(F.sum(F.when(~F.col("whole"), F.col("df"))) / F.sum("df")).first()[0] or 0.0
    if few < most_share:  # the steps cost more than what they could save
        w = w.withColumn("whole", F.lit(True))
    whole = whole.unionByName(_scored(body.join(w.where("whole"), "token"), k1, b).select("query_id", "doc_id", "value"))
    seeded = w.where("seed").groupBy("query_id").agg(F.sum("df").alias("n"))
    if few < most_share:
        return _work(index, whole, seeded, queries, query_id, tokens) if work else _ranked(whole, k)
    w = w.where("not whole")
    head = blocks.select("token", "range", "n", "max_tf", "min_dl").join(w, "token").withColumn("most", F.col("weight") * part("max_tf", "min_dl", "avgdl", k1, b))
    sums = head.groupBy("query_id", "range").agg(F.sum("most").alias("all"), F.sum(F.when(~F.col("leads"), F.col("most"))).alias("rest"), F.bool_or("leads").alias("led"), F.first("bound").alias("bound"))
    ranges = scratch(sums.where(F.col("led") & (F.col("all") >= F.col("bound"))).select("query_id", "range", "bound", F.coalesce("rest", F.lit(0.0)).alias("rest")), "ranges")
    leading = body.join(w.where("leads").drop("bound"), "token").join(ranges.select("query_id", "range"), ["query_id", "range"])
    partly = _scored(leading, k1, b).groupBy("query_id", "range", "doc_id").agg(F.sum("value").alias("value"))
    hopeful = partly.join(ranges, ["query_id", "range"]).where(F.col("value") + F.col("rest") >= F.col("bound"))
    hopeful = scratch(hopeful.select("query_id", "range", "doc_id", "value"), "hopeful")
    places = hopeful.select("query_id", "range").distinct()
    trailing = _scored(body.join(w.where("not leads"), "token").join(places, ["query_id", "range"]), k1, b).join(hopeful.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    if work:
        led = leading.groupBy("query_id").agg(F.sum("n").alias("n"))
        looked = trailing.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        return _work(index, whole, seeded.unionByName(led).unionByName(looked), queries, query_id, tokens)
    return _ranked(whole.unionByName(hopeful.select("query_id", "doc_id", "value")).unionByName(trailing.select("query_id", "doc_id", "value")), k)


def _ranked(parts: DataFrame, k: int) -> DataFrame:
    scored = parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("value"), 6).alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", nth).where(F.col("rank") <= k)


def _work(index: dict[str, DataFrame], whole: DataFrame, some: DataFrame | None, queries: DataFrame, query_id: str, tokens: Column) -> DataFrame:
    every = whole.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    every = (every if some is None else every.unionByName(some)).groupBy("query_id").agg(F.sum("n").alias("scored"))
    there = weights(index, queries, query_id, tokens, K1, B).groupBy("query_id").agg(F.sum("df").alias("postings"))
    return there.join(every, "query_id", "left").select("query_id", "postings", F.coalesce("scored", F.lit(0)).alias("scored"))


def score_all(index: dict[str, DataFrame], queries: DataFrame, query_id: str, tokens: Column, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) of every document that has a token of the query."""
    rows = index["blocks"].select("token", "range", "postings").join(weights(index, queries, query_id, tokens, k1, b), "token")
    return _scored(rows, k1, b).groupBy("query_id", "doc_id").agg(F.round(F.sum("value"), 6).alias("score"))


def shared_tokens(index: dict[str, DataFrame], queries: DataFrame, query_id: str, tokens: Column) -> DataFrame:
    """(query_id, doc_id, shared, n_query, n_doc): distinct tokens that a query and a document share."""
    q = queries.select(F.col(query_id).alias("query_id"), F.array_distinct(tokens).alias("t")).select("query_id", F.size("t").alias("n_query"), F.explode("t").alias("token"))
    met = q.join(index["blocks"].select("token", F.col("postings.doc_id").alias("d"), F.col("postings.kinds").alias("k")), "token")
    pairs = met.select("query_id", "n_query", F.explode(F.arrays_zip("d", "k")).alias("z")).select("query_id", "n_query", F.col("z.d").alias("doc_id"), F.col("z.k").alias("kinds"))
    return pairs.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"), F.max("n_query").alias("n_query"), F.max("kinds").alias("n_doc"))


def phrases(index: dict[str, DataFrame], asked: DataFrame, phrase_id: str, text: str) -> DataFrame:
    """(phrase_id, doc_id): documents whose text, in lower case, holds the phrase, in lower case, as it stands. A phrase's inner words are whole
    words of the document; its first may end a longer one, its last may begin one. Places of the word with the fewest
    postings are met with those of the others, at the distance the phrase has; what stands between words is compared too. No text is read.
    Phrases without a word of two characters are not looked for."""
    low = F.lower(text)
    p = asked.where(F.size(T.tokens(F.col(text), ())) > 0).select(F.col(phrase_id).alias("phrase_id"), F.regexp_extract_all(low, F.lit(T.WORD), F.lit(0)).alias("w"), F.split(low, T.WORD, -1).alias("s"))
    p = p.select("phrase_id", F.size("w").alias("n"), F.posexplode(F.arrays_zip(F.col("w").alias("word"), F.slice("s", F.lit(1), F.size("w")).alias("lead"), F.slice("s", F.lit(2), F.size("w")).alias("trail"))).alias("at", "z"))
    p = p.select("phrase_id", "n", "at", F.col("z.word").alias("word"), F.col("z.lead").alias("lead"), F.col("z.trail").alias("trail"))
    # a first or last word without anything beside it may be a part of the document's
    p = p.withColumn("loose_left", (F.col("at") == 0) & (F.col("lead") == "")).withColumn("loose_right", (F.col("at") == F.col("n") - 1) & (F.col("trail") == ""))
    p = scratch(p, "phrases")
    known = index["terms"].select("token", "df")
    whole = p.join(known, F.col("token") == F.col("word")).where("not loose_left and not loose_right")
    # words of the vocabulary that end with, begin with or hold a loose word: by equality of their parts of the lengths that are asked for
    loose = p.where("loose_left or loose_right")
    sizes = [r[0] for r in loose.select(F.length("word")).distinct().collect()]
    cut = known.withColumn("size", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.expr("cast(array() as array<int>)"))).where(F.length("token") >= F.col("size"))
    n = F.length("token") - F.col("size")
    ends = cut.select("token", "df", F.substr("token", n + 1, F.col("size")).alias("word")).join(loose.where("loose_left and not loose_right"), "word")
    begins = cut.select("token", "df", F.substr("token", F.lit(1), F.col("size")).alias("word")).join(loose.where("loose_right and not loose_left"), "word")
    inner = cut.select("token", "df", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: F.substr("token", i + 1, F.col("size"))))).alias("word")).join(loose.where("loose_left and loose_right"), "word")
    columns = ["phrase_id", "n", "at", "lead", "trail", "token", "df"]
    words = scratch(whole.select(columns).unionByName(ends.select(columns)).unionByName(begins.select(columns)).unionByName(inner.select(columns)), "phrase_words")
    of = Window.partitionBy("phrase_id").orderBy("df", "at")
    pivot = words.groupBy("phrase_id", "at").agg(F.sum("df").alias("df")).withColumn("nth", F.row_number().over(of)).where("nth = 1").select("phrase_id", F.col("at").alias("pivot"))
    # phrases of which a word is nowhere are in no document
    there = words.groupBy("phrase_id").agg(F.count_distinct("at").alias("found"), F.first("n").alias("n")).where("found = n").select("phrase_id")
    words = words.join(pivot, "phrase_id").join(there, "phrase_id", "left_semi")
    blocks = index["blocks"].select("token", "range", F.col("postings.doc_id").alias("d"), "places")

    def fits(rows: DataFrame) -> DataFrame:
        """Places of a word where what stands beside it is what the phrase has: (phrase_id, range, doc_id, start of the phrase, at)."""
        each = rows.select("phrase_id", "n", "at", "lead", "trail", "range", F.explode(F.arrays_zip("d", "places")).alias("z")).select("phrase_id", "n", "at", "lead", "trail", "range", F.col("z.d").alias("doc_id"), F.explode("z.places").alias("p"))
        left = F.when(F.col("at") == 0, F.endswith("p.before", F.col("lead"))).otherwise(F.col("p.before") == F.col("lead"))
        right = F.when(F.col("at") == F.col("n") - 1, F.startswith("p.after", F.col("trail"))).otherwise(F.col("p.after") == F.col("trail"))
        return each.where(left & right).select("phrase_id", "n", "range", "doc_id", (F.col("p.pos") - F.col("at")).alias("start"), "at")

    seeds = scratch(fits(blocks.join(words.where("at = pivot"), "token")), "phrase_seeds")
    others = blocks.join(words.where("at <> pivot"), "token").join(seeds.select("phrase_id", "range").distinct(), ["phrase_id", "range"])
    met = fits(others).join(seeds.select("phrase_id", "doc_id", "start").distinct(), ["phrase_id", "doc_id", "start"], "left_semi")
    every = seeds.unionByName(met).groupBy("phrase_id", "doc_id", "start").agg(F.count_distinct("at").alias("hits"), F.first("n").alias("n"))
    return every.where("hits = n").select("phrase_id", "doc_id").distinct()
