"""Retrieval queries over the test tables: documents stand for chunks (source is the paper, doc_id the order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import evaluation as ev
from foliant.operators import retrieval as rt
from foliant.operators import search_index as si
from foliant.registry import query, table

QUERY = "Which evidence reports the stupid worthless result of thread ii"

#: The normal form in DuckDB; aliases with lookahead have no counterpart there and no match in the test data.
NORM = r"trim(regexp_replace(replace(lower(coalesce(text, '')), chr(173), ''), '[^a-z0-9\x{4e00}-\x{9fff}]+', ' ', 'g'))"
ENTRIES = f"entries AS (SELECT doc_id AS id, source AS paper_id, doc_id AS ord, {NORM} AS normalized FROM documents)"
TERMS = ", ".join(f"('{t}', {w}::DOUBLE)" for t, w in tx.query_terms(QUERY).items())
SCORE = " + ".join(f"CASE WHEN contains(normalized, '{t}') THEN {w}::DOUBLE ELSE 0 END" for t, w in tx.query_terms(QUERY).items()) + " + CASE WHEN contains(normalized, 'fermentation experiment') THEN 0.12::DOUBLE ELSE 0 END"
STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
TOKENS = rf"list_filter(list_distinct(regexp_extract_all(normalized, '[a-z0-9]+|[\x{{4e00}}-\x{{9fff}}]+')), lambda x: length(x) >= 2 AND x NOT IN ({STOP}))"


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("paper_id"), F.col("doc_id").alias("ord"), "text")


def index(spark: SparkSession, d: str) -> si.SearchIndex:
    return si.of_table(spark, f"{d}/documents.parquet", chunk_rows(spark, d))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """The stored entries: normalised when the index was built, not by every query."""
    return index(spark, d).entries


def scored(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("*", tx.once(F.round(rt.lexical_score(F.col("normalized"), QUERY), 6)).alias("score"))


@query(f"WITH {ENTRIES} SELECT id, md5(normalized) AS h FROM entries")
def x2_normalize(spark, d):
    return si.normalized(chunk_rows(spark, d)).select("id", F.md5("normalized").alias("h"))


@query("SELECT doc_id, (('0x' || substr(md5(source || ':' || doc_id), 1, 16))::UBIGINT::HUGEINT % 9223372036854775808::HUGEINT)::BIGINT AS point_id FROM documents")
def x21_point_id(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.point_id(F.col("source"), F.col("doc_id").cast("string")).alias("point_id"))


@query(f"WITH {ENTRIES} SELECT id, round(score, 6) AS score FROM (SELECT id, {SCORE} AS score FROM entries) WHERE round(score, 6) > 0 ORDER BY round(score, 6) DESC, id LIMIT 20")
def r8_lexical_search(spark, d):
    return rt.top(scored(spark, d).filter("score > 0").select("id", "score"), 20)


@query(f"WITH {ENTRIES} SELECT id, round({SCORE}, 6) AS score FROM entries")
def r4_lexical_score(spark, d):
    return scored(spark, d).select("id", "score")


@query(f"WITH {ENTRIES} SELECT term, count(*) AS df FROM (SELECT unnest({TOKENS}) AS term FROM entries) GROUP BY term")
def g10_document_frequency(spark, d):
    return rt.term_frequencies(entries(spark, d))


@query(f"WITH {ENTRIES}, p AS (SELECT id, unnest({TOKENS}) AS term FROM entries) SELECT (SELECT count(*) FROM entries) AS entries, count(*) AS postings, count(DISTINCT term) AS terms, (SELECT max(n) FROM (SELECT count(*) AS n FROM p GROUP BY term)) AS longest FROM p")
def k13_search_index(spark, d):
    """Builds the stored search text, its postings and their counts anew."""
    i = si.built(chunk_rows(spark, d), f"{si.scratch(spark)}/search-new")
    counts = i.frequencies.agg(F.sum("df").alias("postings"), F.count("*").alias("terms"), F.max("df").alias("longest"))
    return i.entries.agg(F.count("*").alias("entries")).join(counts)


IDF = (
    f"{ENTRIES}, tok AS (SELECT id, unnest({TOKENS}) AS tok FROM entries), df AS (SELECT tok, count(*) AS n FROM tok GROUP BY tok), q(term, w) AS (VALUES {TERMS}), "
    "parts AS (SELECT term, w, unnest(string_split(term, ' ')) AS tok FROM q), "
    f"idf AS (SELECT term, any_value(w) AS w, 1 + ln((SELECT count(*) + 1 FROM entries) / (coalesce(min(n), (SELECT count(*) FROM entries)) + 1)) AS idf FROM parts LEFT JOIN df USING (tok) WHERE length(tok) >= 2 AND tok NOT IN ({STOP}) GROUP BY term)"
)


@query(f"WITH {IDF} SELECT id, round(sum(CASE WHEN contains(normalized, term) THEN w * idf ELSE 0 END), 6) AS score FROM entries, idf GROUP BY id, normalized")
def r5_idf_score(spark, d):
    i = index(spark, d)
    idf = rt.idf_of_query(i.frequencies, i.entries.count(), QUERY)
    return i.entries.select("id", F.round(rt.lexical_score(F.col("normalized"), QUERY, idf), 6).alias("score"))


@query(f"WITH {IDF} SELECT term, round(idf, 6) AS idf FROM idf")
def r6_term_idf(spark, d):
    i = index(spark, d)
    idf = rt.idf_of_query(i.frequencies, i.entries.count(), QUERY)
    return spark.createDataFrame([(t, round(v, 6)) for t, v in idf.items()], "term string, idf double")


POOL = (
    f"{ENTRIES}, tok AS (SELECT id, paper_id, unnest({TOKENS}) AS tok FROM entries), df AS (SELECT tok, count(*) AS n FROM tok GROUP BY tok), "
    f"ranked AS (SELECT tok, row_number() OVER (ORDER BY n, tok) AS pos FROM df WHERE tok IN ({', '.join(repr(x) for x in sorted({x for t in tx.query_terms(QUERY) for x in tx.query_index_terms(t)}))}) AND n <= 2000 QUALIFY pos <= 12), "
    "firsts AS (SELECT id, paper_id, min(pos) AS pos FROM tok JOIN ranked USING (tok) GROUP BY ALL), cum AS (SELECT pos, (SELECT count(*) FROM firsts f WHERE f.pos <= r.pos) AS seen FROM ranked r), "
    "stop AS (SELECT coalesce(min(pos) FILTER (seen >= 1000 AND pos >= 3), 12) AS k FROM cum)"
)


@query(f"WITH {POOL} SELECT id, paper_id FROM firsts, stop WHERE pos <= k")
def r7_candidate_pool(spark, d):
    i = index(spark, d)
    return i.entries.join(rt.candidate_pool(i.postings, i.frequencies, QUERY, 10), "id", "left_semi").select("id", "paper_id")


#: A query with a strict anchor, over texts of which every seventh holds it.
ANCHORED = "LNT II titer of the pathway"
ANCHOR_TEXT = "normalized || CASE WHEN id % 7 = 0 THEN ' lnt ii ' ELSE '' END"
ANCHOR_TERMS = {t: w for t, w in tx.query_terms(ANCHORED).items() if t != "lnt"}
ANCHOR_SCORE = " + ".join(f"CASE WHEN contains(t, '{t}') THEN {w}::DOUBLE ELSE 0 END" for t, w in ANCHOR_TERMS.items()) + " + CASE WHEN contains(t, 'fermentation experiment') THEN 0.12::DOUBLE ELSE 0 END"
HAS_ANCHOR = "(contains(t, 'lnt ii') OR contains(t, 'lacto n triose ii'))"
ANCHOR_ENTRIES = f"{ENTRIES}, a AS (SELECT id, paper_id, {ANCHOR_TEXT} AS t FROM entries)"


def anchored(spark, d) -> DataFrame:
    return entries(spark, d).select("id", "paper_id", F.expr(ANCHOR_TEXT).alias("t"))


@query(f"WITH {ANCHOR_ENTRIES} SELECT id, round(CASE WHEN {HAS_ANCHOR} THEN {ANCHOR_SCORE} ELSE 0 END, 6) AS score FROM a")
def r4_anchored_score(spark, d):
    return anchored(spark, d).select("id", F.round(rt.lexical_score(F.col("t"), ANCHORED), 6).alias("score"))


@query(f"WITH {ANCHOR_ENTRIES} SELECT id, round(CASE WHEN {HAS_ANCHOR} THEN {' + '.join(f'CASE WHEN contains(t, {t!r}) THEN {w}::DOUBLE * 1.5 ELSE 0 END' for t, w in ANCHOR_TERMS.items())} + CASE WHEN contains(t, 'fermentation experiment') THEN 0.12::DOUBLE ELSE 0 END ELSE 0 END, 6) AS score FROM a")
def r5_anchored_idf(spark, d):
    return anchored(spark, d).select("id", F.round(rt.lexical_score(F.col("t"), ANCHORED, dict.fromkeys(tx.query_terms(ANCHORED), 1.5)), 6).alias("score"))


@query(f"WITH {ANCHOR_ENTRIES} SELECT id, round(0.5 + least(CASE WHEN {HAS_ANCHOR} THEN {ANCHOR_SCORE} ELSE 0 END, 1.35), 6) AS score FROM a")
def r9_anchored_boost(spark, d):
    return rt.boosted(anchored(spark, d).withColumn("score", F.lit(0.5)), F.col("t"), ANCHORED).select("id", F.round("score", 6).alias("score"))


OCC = "least((length(f) - length(replace(f, term, ''))) / length(term), 3)"


@query(
    f"WITH {ENTRIES}, q(term, w) AS (VALUES {TERMS}), fields AS (SELECT id, unnest([{{'f': normalized, 'fw': 1.0}}, {{'f': paper_id, 'fw': 6.0}}], recursive := true) FROM entries) "
    f"SELECT id, round(sum(CASE WHEN contains(f, term) THEN fw * w * (1 + 0.25 * ({OCC} - 1)) ELSE 0 END), 6) AS score FROM fields, q GROUP BY id"
)
def r10_fielded_score(spark, d):
    return entries(spark, d).select("id", F.round(rt.fielded_score({"content": F.col("normalized"), "title": F.col("paper_id")}, QUERY), 6).alias("score"))


@query(
    f"WITH {ANCHOR_ENTRIES}, q(term, w) AS (VALUES {', '.join(f'({t!r}, {w}::DOUBLE)' for t, w in ANCHOR_TERMS.items())}), fields AS (SELECT id, {HAS_ANCHOR} AS ok, unnest([{{'f': t, 'fw': 1.0}}, {{'f': paper_id, 'fw': 6.0}}], recursive := true) FROM a) "
    f"SELECT id, round(sum(CASE WHEN ok AND contains(f, term) THEN fw * w * (1 + 0.25 * ({OCC} - 1)) ELSE 0 END), 6) AS score FROM fields, q GROUP BY id"
)
def r10_anchored_fields(spark, d):
    return anchored(spark, d).select("id", F.round(rt.fielded_score({"content": F.col("t"), "title": F.col("paper_id")}, ANCHORED), 6).alias("score"))


@query(f"WITH {ENTRIES} SELECT id, round(0.5 + least({SCORE}, 0.35), 6) AS score FROM entries WHERE {SCORE} > 0")
def r9_relevance_boost(spark, d):
    hits = entries(spark, d).withColumn("score", F.lit(0.5))
    return rt.boosted(hits, F.col("normalized"), QUERY).filter("lexical_score > 0").select("id", F.round("score", 6).alias("score"))


VEC = "(SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 7)"


def vectors(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 7").select(F.col("embedding").alias("q"))
    return e.select(F.col("vec_id").alias("id"), "embedding", "label").crossJoin(F.broadcast(q))


@query(f"SELECT vec_id AS id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {VEC}), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 10")
def r1_cosine_topk(spark, d):
    return rt.top(vectors(spark, d).select("id", F.round(rt.cosine(F.col("embedding"), F.col("q")), 6).alias("score")), 10)


@query(f"SELECT * FROM (SELECT vec_id AS id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {VEC}), 6) AS score FROM embeddings) WHERE score >= 0.1")
def f2_score_threshold(spark, d):
    return vectors(spark, d).select("id", F.round(rt.cosine(F.col("embedding"), F.col("q")), 6).alias("score")).filter("score >= 0.1")


@query(f"SELECT vec_id AS id, round(pow(list_distance(list_transform(embedding, lambda x: x::DOUBLE), {VEC}), 2), 6) AS score FROM embeddings ORDER BY score, id LIMIT 10")
def r27_l2_topk(spark, d):
    return vectors(spark, d).select("id", F.round(rt.l2(F.col("embedding"), F.col("q")), 6).alias("score")).orderBy("score", "id").limit(10)


@query("SELECT vec_id AS id, round(1.5 * embedding[1]::DOUBLE - 0.5 * embedding[9]::DOUBLE, 6) AS score FROM embeddings WHERE round(1.5 * embedding[1]::DOUBLE - 0.5 * embedding[9]::DOUBLE, 6) <> 0")
def r2_sparse_dot(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.map_from_arrays(F.sequence(F.lit(0), F.size("embedding") - 1), "embedding").alias("sparse"))
    return rt.sparse_dot(e, {0: 1.5, 8: -0.5}).withColumn("score", F.round("score", 6)).filter("score <> 0")


LISTS = (
    f"{ENTRIES}, a AS (SELECT 'raw' AS route, 1.0 AS weight, id, paper_id, score AS raw_score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, paper_id, round({SCORE}, 6) AS score FROM entries) WHERE score > 0 QUALIFY rank <= 30), "
    "b AS (SELECT 'entity' AS route, 0.7 AS weight, id, paper_id, length(normalized) AS raw_score, row_number() OVER (ORDER BY length(normalized) DESC, id) AS rank FROM entries QUALIFY rank <= 30), "
    "lists AS (SELECT * FROM a UNION ALL BY NAME SELECT * FROM b)"
)


def lists(spark, d):
    e = scored(spark, d)
    by = lambda c: Window.orderBy(F.desc(c), "id")
    a = rt.top(e.filter("score > 0"), 30).select("id", "paper_id", F.col("score").alias("raw_score"))
    b = rt.top(e.withColumn("raw_score", F.length("normalized").cast("double")), 30, "raw_score").select("id", "paper_id", "raw_score")
    return a.select(F.lit("raw").alias("route"), F.lit(1.0).alias("weight"), "*", F.row_number().over(by("raw_score")).alias("rank")).unionByName(b.select(F.lit("entity").alias("route"), F.lit(0.7).alias("weight"), "*", F.row_number().over(by("raw_score")).alias("rank")))


@query(f"WITH {LISTS} SELECT id, round(sum(weight / (60 + rank)), 9) AS score FROM lists GROUP BY id")
def r3_reciprocal_rank_fusion(spark, d):
    return rt.reciprocal_rank(lists(spark, d)).withColumn("score", F.round("score", 9))


@query(
    f"WITH {LISTS}, m AS (SELECT id, paper_id, sum(weight / (60 + rank) * CASE WHEN route = 'raw' THEN 1.05 ELSE 1 END) AS score, max(raw_score) AS raw_score, min(CASE WHEN route = 'raw' THEN rank END) AS raw_rank, count(DISTINCT route) AS routes FROM lists GROUP BY id, paper_id), "
    "p AS (SELECT *, coalesce(raw_rank <= 5, false) AS protected, CASE WHEN raw_rank IS NOT NULL THEN 3 WHEN routes >= 2 THEN 2 ELSE 1 END AS priority FROM m) "
    "SELECT id, paper_id, round(score, 9) AS score, protected, priority FROM p WHERE raw_rank IS NOT NULL OR routes >= 2 OR (SELECT count(raw_rank) FROM m) < 5 OR paper_id IN (SELECT paper_id FROM p WHERE protected) "
    "ORDER BY protected DESC, CASE WHEN protected THEN raw_rank END, priority DESC, p.score DESC, raw_score DESC, id LIMIT 10"
)
def r12_multi_query_fusion(spark, d):
    return rt.multi_query(lists(spark, d), 10).select("id", "paper_id", F.round("score", 9).alias("score"), "protected", "priority")


SEEDS = f"{ENTRIES}, seeds AS (SELECT id, paper_id, ord, round({SCORE}, 6) AS score, row_number() OVER (ORDER BY round({SCORE}, 6) DESC, id) AS rank FROM entries QUALIFY rank <= 20)"
NEAR = f"{SEEDS}, near AS (SELECT e.id, e.paper_id, e.ord, s.id AS seed, abs(e.ord - s.ord) AS distance, s.score * greatest(0.55::DOUBLE, 0.98::DOUBLE - 0.08::DOUBLE * abs(e.ord - s.ord)) AS score FROM entries e JOIN seeds s ON e.paper_id = s.paper_id WHERE e.id <> s.id AND abs(e.ord - s.ord) <= 60 QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY s.score * greatest(0.55::DOUBLE, 0.98::DOUBLE - 0.08::DOUBLE * abs(e.ord - s.ord)) DESC, s.id) = 1)"


def seeds(spark, d):
    s = rt.top(scored(spark, d), 20).select("id", "paper_id", "ord", "score")
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


@query(f"WITH {NEAR} SELECT id, distance, round(score, 6) AS score FROM near")
def r16_neighbors(spark, d):
    return rt.neighbors(seeds(spark, d), entries(spark, d), 60).select("id", "distance", F.round("score", 6).alias("score"))


@query(f"WITH {NEAR} SELECT id, paper_id, round(score, 6) AS score FROM near WHERE id NOT IN (SELECT id FROM seeds)")
def r17_neighbor_context(spark, d):
    s = seeds(spark, d)
    return rt.not_seen(rt.neighbors(s, entries(spark, d), 60), s).select("id", "paper_id", F.round("score", 6).alias("score"))


PAPERS = f"{SEEDS}, papers AS (SELECT paper_id, row_number() OVER (ORDER BY min(rank)) AS paper_rank FROM seeds GROUP BY paper_id QUALIFY paper_rank <= 4)"
GROUPS = f"{PAPERS}, g AS (SELECT e.id, e.paper_id, paper_rank, round({SCORE} + 0.03 / paper_rank, 6) AS score, round({SCORE}, 6) AS lexical_score FROM entries e JOIN papers USING (paper_id)), placed AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, id) AS place FROM g QUALIFY place <= CASE WHEN paper_rank = 1 THEN 4 ELSE 2 END)"


def placed(spark, d):
    papers = rt.ranked_papers(seeds(spark, d), 4)
    g = scored(spark, d).withColumn("lexical_score", F.col("score")).join(F.broadcast(papers), "paper_id")  # four rows
    return rt.top_per_paper(g.withColumn("score", F.round(F.col("lexical_score") + 0.03 / F.col("paper_rank"), 6)), 2, 4)


@query(f"WITH {PAPERS} SELECT * FROM papers")
def w6_rank_papers(spark, d):
    return rt.ranked_papers(seeds(spark, d), 4)


@query(f"WITH {GROUPS} SELECT id, paper_id, place FROM placed")
def w8_topk_per_paper(spark, d):
    return placed(spark, d).select("id", "paper_id", "place")


@query(f"WITH {GROUPS} SELECT id, row_number() OVER (ORDER BY place, paper_rank) AS rank FROM placed")
def w10_interleave(spark, d):
    return rt.interleaved(placed(spark, d)).select("id", "rank")


@query(f"WITH {GROUPS} SELECT id, row_number() OVER (ORDER BY CASE WHEN place = 1 THEN 0 WHEN paper_rank = 1 THEN 1 ELSE 2 END, CASE WHEN place = 1 THEN paper_rank ELSE place END, paper_rank) AS rank FROM placed")
def w11_prioritize(spark, d):
    return rt.prioritized(placed(spark, d)).select("id", "rank")


@query(f"WITH {GROUPS} SELECT id, score, row_number() OVER (ORDER BY score DESC, lexical_score DESC, paper_rank, id) AS rank FROM placed")
def w12_score_rank(spark, d):
    return rt.score_ranked(placed(spark, d)).select("id", "score", "rank")


@query(f"WITH {GROUPS} SELECT id, paper_id, score FROM placed WHERE id NOT IN (SELECT id FROM seeds) AND lexical_score > 0")
def r18_paper_local_context(spark, d):
    return placed(spark, d).filter("lexical_score > 0").join(seeds(spark, d).select("id"), "id", "left_anti").select("id", "paper_id", "score")


@query(f"WITH {GROUPS}, u AS (SELECT id, score, 0 AS f FROM placed UNION ALL SELECT id, score, 1 FROM seeds) SELECT id, score FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY f, score DESC) = 1")
def r19_evidence_search(spark, d):
    """Best papers by first hits, their best chunks first, then the other hits."""
    return rt.append_unique(placed(spark, d).select("id", "score"), seeds(spark, d).select("id", "score"))


@query(f"WITH {SEEDS}, p AS (SELECT id, r AS rank FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM seeds) WHERE r <= 3) SELECT id, row_number() OVER (ORDER BY part, rank) AS new_rank FROM (SELECT id, rank, 0 AS part FROM p UNION ALL SELECT id, rank, 1 FROM seeds WHERE id NOT IN (SELECT id FROM p)) QUALIFY new_rank <= 10")
def d3_protect_prefix(spark, d):
    s = seeds(spark, d).select("id", "rank")
    p = s.select("id").orderBy("id").limit(3).select("id", F.row_number().over(Window.orderBy("id")).alias("rank"))
    return rt.protected_prefix(s, p, 10).select("id", "new_rank")


OFFLINE = list(tx.query_terms(QUERY))


@query(
    f"WITH {ENTRIES}, f AS (SELECT id, unnest([{{'t': normalized, 'w': 1.0::DOUBLE}}, {{'t': coalesce(paper_id, ''), 'w': 6.0::DOUBLE}}], recursive := true) FROM entries), "
    "df AS (SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest(string_split(t, ' ')) AS term FROM f) GROUP BY term), "
    f"q AS (SELECT v.term, ln((1 + (SELECT count(*) FROM entries)) / (1 + coalesce(df, 0))) + 1 AS idf FROM (VALUES {', '.join(f'({t!r})' for t in OFFLINE)}) v(term) LEFT JOIN df USING (term)), "
    "n AS (SELECT id, w, idf, (length(t) - length(replace(t, term, ''))) / length(term) AS n FROM f, q), "
    f"s AS (SELECT id, sum(CASE WHEN n > 0 THEN least(3, 1 + 0.25 * (n - 1)) * w * idf ELSE 0 END) AS s FROM n GROUP BY id), p AS (SELECT id, sum(CASE WHEN contains(t, '{' '.join(OFFLINE[:4])}') THEN 2 * w ELSE 0 END) AS p FROM f GROUP BY id) "
    "SELECT id, round(s + p, 6) AS score FROM s JOIN p USING (id) WHERE s + p > 0"
)
def v4_offline_fielded(spark, d):
    rows = entries(spark, d)
    fields = {"content": F.col("normalized"), "title": F.col("paper_id")}
    scores = rows.select("id", tx.once(ev.offline_score(fields, ev.offline_idf(rows, fields, OFFLINE))).alias("score"))
    return scores.filter("score > 0").select("id", F.round("score", 6).alias("score"))


EXPECTED = ["Wher", "report", "ingly"]


@query(
    f"WITH h AS (SELECT conv_id, turn, list_filter({[e.lower() for e in EXPECTED]}, lambda e: contains(lower(text), e))[1] AS term FROM conversations) "
    "SELECT conv_id, count(*) AS hit_count, min(turn) FILTER (term IS NOT NULL) AS matched_rank, arg_min(term, (turn, term)) FILTER (term IS NOT NULL) AS matched_term FROM h GROUP BY conv_id"
)
def v7_first_match(spark, d):
    """Turns of a conversation stand for the ranked hits of a case."""
    return ev.first_match(table(spark, d, "conversations"), "conv_id", "turn", "text", EXPECTED)
