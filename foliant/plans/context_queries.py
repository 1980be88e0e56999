"""Queries on the context of hits: distances, nearby ranks, anchors, reranking, whole searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import context as cx
from foliant.operators import reports as rp
from foliant.operators import retrieval as rt
from foliant.plans.retrieval_queries import ENTRIES, GROUPS, NEAR, QUERY, SCORE, SEEDS, VEC, entries, placed, scored, seeds, vectors
from foliant.plans.store_queries import CHUNKS, chunks
from foliant.registry import query, table

#: Pairs of chunks that the rules of distance decide in different ways: by order, by order on the page, by box, not at all.
STEP = "CASE WHEN id % 4 = 0 THEN CASE WHEN abs(ord - ord2) <= 2 THEN abs(ord - ord2) END WHEN page <> page2 THEN NULL WHEN id % 4 = 1 THEN CASE WHEN abs(op - op2) <= 2 THEN abs(op - op2) END WHEN id % 4 = 2 THEN CASE WHEN sqrt(power((x0 + x1 - x02 - x12) / 2 / 700, 2) + power((y0 + y1 - y02 - y12) / 2 / 900, 2)) <= 0.12 THEN 1 END END"
PAIRS = f"{CHUNKS}, o AS (SELECT *, ord % 11 AS op FROM chunks), pairs AS (SELECT id, page, ord, op, x0, x1, y0, y1, lead(id) OVER w AS id2, lead(page) OVER w AS page2, lead(ord) OVER w AS ord2, lead(op) OVER w AS op2, lead(x0) OVER w AS x02, lead(x1) OVER w AS x12, lead(y0) OVER w AS y02, lead(y1) OVER w AS y12 FROM o WINDOW w AS (PARTITION BY paper_id ORDER BY ord))"


@query(f"WITH {PAIRS} SELECT id, ({STEP})::INT AS steps FROM pairs WHERE id2 IS NOT NULL")
def r15_neighbor_distance(spark, d):
    w = Window.partitionBy("paper_id").orderBy("ord")
    rows = chunks(spark, d).withColumn("both", F.struct("id", "ord", "page", "box")).withColumn("next", F.lead("both").over(w)).filter("next IS NOT NULL")
    rule = (F.col("id") % 4).cast("int")
    of = lambda c: cx.place(global_order=F.when(rule == 0, c["ord"]), page=c["page"], order_in_page=F.when(rule == 1, c["ord"] % 11), box=F.when(rule == 2, c["box"]), page_width=F.lit(700.0), page_height=F.lit(900.0))
    return rows.select("id", cx.distance(of(F.col("both")), of(F.col("next")), 2).alias("steps"))


@query(f"WITH {CHUNKS} SELECT a.id, b.id AS other FROM chunks a JOIN chunks b ON a.paper_id = b.paper_id AND a.page = b.page AND a.id < b.id WHERE sqrt(power((a.x0 + a.x1 - b.x0 - b.x1) / 2 / 700, 2) + power((a.y0 + a.y1 - b.y0 - b.y1) / 2 / 900, 2)) <= 0.12")
def j3_close_boxes(spark, d):
    """Every pair of chunks of a page whose centres are close."""
    return cx.close_boxes(chunks(spark, d).select("id", "paper_id", "page", "box"), 700.0, 900.0)


HITS = f"{SEEDS}, cases AS (SELECT id % 5 AS case_id, id, paper_id, ord, row_number() OVER (PARTITION BY id % 5 ORDER BY rank) AS rank FROM seeds), expected AS (SELECT id % 5 AS case_id, id, paper_id, ord FROM entries WHERE id % 7 = 0)"


def case_hits(spark, d):
    s = seeds(spark, d).withColumn("case_id", F.col("id") % 5)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("rank")))


def expected(spark, d):
    return entries(spark, d).filter("id % 7 = 0").select((F.col("id") % 5).alias("case_id"), "id", "paper_id", "ord")


@query(f"WITH {HITS} SELECT c.case_id, min(rank) AS rank FROM cases c JOIN expected e ON c.case_id = e.case_id AND c.id = e.id GROUP BY c.case_id")
def w3_first_rank(spark, d):
    return cx.first_rank(case_hits(spark, d), expected(spark, d))


@query(f"WITH {HITS} SELECT c.case_id, min(rank) AS rank FROM cases c JOIN expected e ON c.case_id = e.case_id AND c.paper_id = e.paper_id WHERE abs(c.ord - e.ord) <= 30 GROUP BY c.case_id")
def j17_nearby_rank(spark, d):
    at = cx.place(chunk_id=F.col("id").cast("string"), global_order=F.col("ord")).alias("place")
    return cx.nearby_rank(case_hits(spark, d).select("case_id", "rank", "paper_id", at), expected(spark, d).select("case_id", "paper_id", at), 30)


@query("SELECT doc_id, source AS paper_id, doc_id AS global_order, n_chars > 500 AS long FROM documents")
def p14_locations(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars", cx.place(chunk_id=F.col("doc_id").cast("string"), global_order=F.col("doc_id")).alias("at"))
    return rows.select("doc_id", F.col("source").alias("paper_id"), "at.global_order", (F.col("n_chars") > 500).alias("long"))


@query(f"WITH {SEEDS}, papers AS (SELECT paper_id, row_number() OVER (ORDER BY min(rank)) AS paper_rank FROM seeds GROUP BY paper_id QUALIFY paper_rank <= 4) SELECT id, paper_id, paper_rank FROM entries JOIN papers USING (paper_id)")
def j4_entries_of_papers(spark, d):
    return entries(spark, d).join(F.broadcast(rt.ranked_papers(seeds(spark, d), 4)), "paper_id").select("id", "paper_id", "paper_rank")  # four rows


ANSWER = "answer AS (SELECT * FROM (VALUES (0, 3, 0.9::DOUBLE), (1, 0, 0.8::DOUBLE), (2, 3, 0.7::DOUBLE), (3, 600, 0.6::DOUBLE), (4, 7, 0.5::DOUBLE)) AS t(place, index, relevance) WHERE place NOT IN (2, 3))"


@query(f"WITH {SEEDS}, {ANSWER} SELECT id, row_number() OVER (ORDER BY place IS NULL, place, rank) AS rank, round(coalesce(relevance, score), 6) AS score, place IS NOT NULL AS reranked FROM seeds LEFT JOIN answer ON index + 1 = rank")
def j12_reranked(spark, d):
    answer = spark.createDataFrame([(0, 3, 0.9), (1, 0, 0.8), (2, 3, 0.7), (3, 600, 0.6), (4, 7, 0.5)], "place int, index int, relevance double")
    return cx.reranked(seeds(spark, d).select("id", "rank", "score"), answer).withColumn("score", F.round("score", 6))


#: Seven results and the first four hits before them as anchors, for eight places: one finds room, three push out the last.
@query(f"WITH {SEEDS}, m AS (SELECT id, rank AS turn FROM seeds WHERE rank <= 4) SELECT id, rank - 4 AS rank, false AS anchor_restored FROM seeds WHERE rank BETWEEN 5 AND 8 UNION ALL SELECT id, 9 - turn, true FROM m")
def d2_restored_anchors(spark, d):
    s = seeds(spark, d).select("id", "rank")
    results = s.filter("rank BETWEEN 5 AND 11").withColumn("rank", F.col("rank") - 4)
    return cx.restored(results, s.filter("rank <= 4"), 8).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {ENTRIES} SELECT id, round(0.5 + least(round({SCORE}, 6) * 0.1, 1.5), 6) AS score FROM entries WHERE {SCORE} > 0")
def r11_fielded_boost(spark, d):
    hits = scored(spark, d).select("id", F.col("score").alias("lexical"), F.lit(0.5).alias("score"))
    return cx.fielded(hits, F.col("lexical"), 0.1).filter("fielded > 0").select("id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {VEC}), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 80")
def t2_overfetched(spark, d):
    hits = vectors(spark, d).select("id", F.round(rt.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return rt.top(hits, 10 * cx.fetch_factor(False, True))


@query("SELECT * FROM (VALUES (10, 80, 5), (3, 24, 3), (40, 320, 20)) AS t(limit_, pool, anchors)")
def t6_limits(spark, d):
    """Sizes of pools and of protected heads."""
    return spark.createDataFrame([(n, cx.pool_limit(n, 5, 2, 4), rt.anchors_kept(n)) for n in (10, 3, 40)], "limit_ int, pool int, anchors int")


@query(f"WITH {NEAR}, u AS (SELECT id, round(score, 6) AS s FROM seeds UNION ALL SELECT id, score FROM near WHERE id NOT IN (SELECT id FROM seeds)), b AS (SELECT u.id, round(s + least(round({SCORE}, 6), 0.35), 6) AS score FROM u JOIN entries USING (id)), r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 10) SELECT id, rank, false AS anchor_restored FROM r")
def r21_search_pipeline(spark, d):
    pool = seeds(spark, d)
    near = rt.neighbors(pool, entries(spark, d), 60)
    words = scored(spark, d).select("id", F.col("score").alias("lexical"))
    pool, near = (x.join(words, "id") for x in (pool.select("id", "rank", "score"), near.select("id", "score")))
    return cx.searched(pool, near, F.col("lexical"), 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {GROUPS}, near AS (SELECT e.id, max(s.score * greatest(0.55::DOUBLE, 0.98::DOUBLE - 0.08::DOUBLE * abs(e.ord - s.ord))) AS score FROM entries e JOIN seeds s ON e.paper_id = s.paper_id WHERE e.id <> s.id AND abs(e.ord - s.ord) <= 60 GROUP BY e.id), b AS (SELECT id, score, 0 AS origin FROM placed UNION ALL SELECT id, score, 1 FROM near), f AS (SELECT id, score, origin FROM b WHERE id NOT IN (SELECT id FROM seeds) QUALIFY row_number() OVER (PARTITION BY id ORDER BY origin, score DESC) = 1) SELECT id, origin, row_number() OVER (ORDER BY origin, score DESC, id) AS rank FROM f QUALIFY rank <= 10")
def r25_expanded_context(spark, d):
    s = seeds(spark, d)
    return cx.expanded(placed(spark, d), rt.neighbors(s, entries(spark, d), 60), s, 10)


@query(f"SELECT {cx.asks_for_evidence('which evidence', 20, 10)} AS evidence_query, false AS other")
def r22_rerank_trigger(spark, d):
    from foliant.functions import text as tx

    return spark.createDataFrame([(cx.asks_for_evidence(tx.normalize_query(QUERY), 20, 10), cx.asks_for_evidence("strain yield", 20, 10))], "evidence_query boolean, other boolean")


#: A seeded order can't be the same in SQL, but its size and the papers it draws from can.
@query("SELECT least(count(*), 25) AS n, true AS known FROM documents")
def t9_seeded_sample(spark, d):
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    picked = rp.sampled(ids, 25, 7)
    return picked.agg(F.count("*").alias("n"), (F.count("*") == F.count_distinct("id")).alias("known"))
