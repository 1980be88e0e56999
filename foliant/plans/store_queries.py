"""Layout and storage queries: documents stand for chunks with a made-up place on a page, labels for verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import geometry as geo
from foliant.functions import text as tx
from foliant.operators import layout as lo
from foliant.operators import retrieval as rt
from foliant.operators import storage as st
from foliant.registry import query, table

#: One row for each document, in SQL that both engines read.
FIELDS = [
    "doc_id AS id", "source AS paper_id", "CAST(floor(doc_id / 200.0) AS INT) AS page", "doc_id AS ord",
    "CASE doc_id % 7 WHEN 0 THEN 'table' WHEN 1 THEN 'image' ELSE 'text' END AS content_type",
    "CAST(doc_id * 37 % 300 AS DOUBLE) AS x0", "CAST(doc_id * 53 % 700 AS DOUBLE) AS y0",
    "CAST(doc_id * 37 % 300 + 50 + doc_id * 17 % 350 AS DOUBLE) AS x1", "CAST(doc_id * 53 % 700 + 10 + doc_id * 7 % 160 AS DOUBLE) AS y1", "text",
]
CHUNKS = f"chunks AS (SELECT *, CASE WHEN x1 - x0 > 360 THEN 2 WHEN x0 < 300 / 2 THEN 0 ELSE 1 END AS col FROM (SELECT {', '.join(FIELDS)} FROM documents))"
INTER = "CASE WHEN least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) THEN (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) ELSE 0 END"


def chunks(spark, d):
    c = table(spark, d, "documents").selectExpr(*FIELDS).withColumn("box", geo.box("x0", "y0", "x1", "y1"))
    return c.withColumn("col", F.when(F.col("x1") - F.col("x0") > 360, 2).when(F.col("x0") < 150, 0).otherwise(1))


def verdicts(spark, d):
    v = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("passed"), F.when(F.col("toxic") == 1, "false_positive").otherwise("").alias("issue_type"))
    return v


ROUTED = f"{CHUNKS}, routed AS (SELECT c.*, CASE WHEN quality IS NULL THEN 'missing_verdict' WHEN quality = 1 THEN 'stored' WHEN content_type = 'table' AND toxic = 1 THEN 'excluded' WHEN content_type = 'table' THEN 'degraded' ELSE 'rejected' END AS outcome FROM chunks c LEFT JOIN labels ON id = doc_id)"


def routed(spark, d):
    return st.routed(chunks(spark, d), verdicts(spark, d))


@query("SELECT doc_id, source FROM documents WHERE source = 'src0'")
def s2_scan_by_paper(spark, d):
    return st.filtered(table(spark, d, "documents"), source="src0").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL")
def s4_eval_payloads(spark, d):
    return table(spark, d, "documents").filter("doc_id IS NOT NULL AND source IS NOT NULL").select("doc_id", "source")


@query(f"WITH {CHUNKS} SELECT paper_id, page, max(x1) AS width, max(y1) AS height FROM chunks GROUP BY ALL")
def s7_page_sizes(spark, d):
    return lo.page_sizes(chunks(spark, d))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' AND n_chars >= 500 AND n_chars <= 2000")
def f1_filter_dsl(spark, d):
    return st.filtered(table(spark, d, "documents"), lang="en", n_chars_gte=500, n_chars_lte=2000).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE length(trim(text)) < 40 OR NOT regexp_matches(text, '[A-Za-z]')")
def f3_noise(spark, d):
    return table(spark, d, "documents").filter(lo.is_noise(F.col("text"))).select("doc_id")


@query(f"WITH {ROUTED} SELECT id, outcome FROM routed")
def k6_store_outcome(spark, d):
    return routed(spark, d).select("id", "outcome")


@query(f"WITH {CHUNKS} SELECT id, quality = 1 AS passed FROM chunks LEFT JOIN labels ON id = doc_id")
def j1_chunks_with_verdicts(spark, d):
    return chunks(spark, d).join(verdicts(spark, d), "id", "left").select("id", "passed")


@query(f"WITH {ROUTED} SELECT paper_id, count(*) FILTER (outcome = 'stored') AS stored, count(*) FILTER (outcome = 'degraded') AS degraded, count(*) FILTER (outcome = 'excluded') AS excluded, count(*) FILTER (outcome = 'missing_verdict') AS missing_verdicts, count(*) FILTER (outcome IN ('stored', 'degraded')) AS attempted, count(*) FILTER (outcome = 'excluded') AS excluded_tables FROM routed GROUP BY paper_id")
def g1_storage_stats(spark, d):
    return st.stats(routed(spark, d), "paper_id")


@query(f"WITH {ROUTED} SELECT count(*) AS attemptable FROM routed WHERE outcome IN ('stored', 'degraded')")
def k7_attemptable(spark, d):
    return routed(spark, d).agg(F.count_if(F.col("outcome").isin("stored", "degraded")).alias("attemptable"))


POINTS = "points AS (SELECT d.doc_id AS id, source AS paper_id, CASE d.doc_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'pending' END AS status, quality, d.text FROM documents d LEFT JOIN labels USING (doc_id))"


def points(spark, d):
    p = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    status = F.when(F.col("doc_id") % 5 == 0, "done").when(F.col("doc_id") % 5 == 1, "pending")
    return p.select(F.col("doc_id").alias("id"), F.col("source").alias("paper_id"), status.alias("status"), "quality", "text")


@query(f"WITH {POINTS} SELECT paper_id, count(*) AS chunk_count, CASE WHEN bool_or(coalesce(status = 'pending', false)) THEN 'pending' WHEN bool_or(coalesce(status = 'done', false) OR quality IS NOT NULL) THEN 'done' ELSE 'pending' END AS enrichment_status, NOT bool_or(coalesce(status = 'pending', false)) AND NOT bool_or(coalesce(status = 'done', false) OR quality IS NOT NULL) AS lacks_marker FROM points GROUP BY paper_id")
def g2_paper_catalogue(spark, d):
    return st.catalogue(points(spark, d).withColumn("has_quality", st.has_any("quality")))


@query("SELECT doc_id, quality IS NOT NULL OR (lang IS NOT NULL AND lang <> '') AS has_quality FROM documents LEFT JOIN labels USING (doc_id)")
def g3_has_quality(spark, d):
    p = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return p.select("doc_id", st.has_any("quality", "lang").alias("has_quality"))


@query("SELECT source AS paper_id, count(*) AS n FROM documents GROUP BY source")
def g4_count_per_paper(spark, d):
    return points(spark, d).groupBy("paper_id").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS}, i AS (SELECT id, paper_id, 'new' AS status FROM points WHERE id % 3 <> 0) SELECT id, paper_id, status FROM points WHERE id % 3 <> 1 AND id NOT IN (SELECT id FROM i) UNION ALL SELECT * FROM i")
def k1_upsert(spark, d):
    p = points(spark, d).select("id", "paper_id", "status")
    return st.upserted(p.filter("id % 3 <> 1"), p.filter("id % 3 <> 0").withColumn("status", F.lit("new")))


@query(f"WITH {POINTS} SELECT id, CASE WHEN id % 4 = 0 THEN 'done' ELSE status END AS status FROM points")
def k3_patch(spark, d):
    p = points(spark, d).select("id", "status")
    return st.patched(p, p.filter("id % 4 = 0").select("id", F.lit("done").alias("status")), "id", "status")


@query(f"WITH {POINTS} SELECT id, paper_id FROM points WHERE paper_id NOT IN (SELECT paper_id FROM points WHERE id % 97 = 0)")
def k4_delete_papers(spark, d):
    p = points(spark, d).select("id", "paper_id")
    return st.without_papers(p, p.filter("id % 97 = 0"))


@query(f"WITH {POINTS} SELECT id FROM points WHERE paper_id IN (SELECT paper_id FROM points WHERE id % 97 = 0)")
def j20_papers_already_stored(spark, d):
    p = points(spark, d)
    return p.join(p.filter("id % 97 = 0").select("paper_id").distinct(), "paper_id", "left_semi").select("id")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def d11_batch_duplicates(spark, d):
    from pyspark.sql import Window

    p = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    w = Window.partitionBy("h")
    return p.select("doc_id", F.min("doc_id").over(w).alias("first_id"), (F.row_number().over(w.orderBy("doc_id")) > 1).alias("is_duplicate"))


@query(f"WITH {CHUNKS} SELECT paper_id, page, i, j, round(iou, 6) AS iou FROM (SELECT a.paper_id, a.page, a.id AS i, b.id AS j, {INTER} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {INTER}) AS iou FROM chunks a JOIN chunks b ON a.paper_id = b.paper_id AND a.page = b.page AND a.id < b.id) WHERE iou > 0.5")
def j11_overlapping_pairs(spark, d):
    return lo.overlapping_pairs(chunks(spark, d)).withColumn("iou", F.round("iou", 6))


@query(f"WITH {CHUNKS} SELECT DISTINCT a.paper_id, a.page, a.id FROM chunks a JOIN chunks b ON a.paper_id = b.paper_id AND a.page = b.page WHERE a.content_type = 'text' AND b.content_type = 'table' AND ({INTER} / ((a.x1 - a.x0) * (a.y1 - a.y0)) >= 0.7 OR ((a.x0 + a.x1) / 2 BETWEEN b.x0 - 20 AND b.x1 + 20 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 - 20 AND b.y1 + 20))")
def j10_text_in_tables(spark, d):
    return lo.text_in_tables(chunks(spark, d))


@query()
def d4_deduplicated(spark, d):
    return lo.deduplicated(chunks(spark, d))


ORDER = (
    f"{CHUNKS}, m AS (SELECT *, min(CASE WHEN col < 2 THEN y0 END) OVER p AS lo, max(CASE WHEN col < 2 THEN y1 END) OVER p AS hi FROM chunks WINDOW p AS (PARTITION BY paper_id, page)), "
    "b AS (SELECT *, CASE WHEN y0 >= 860 * 0.85::DOUBLE THEN 3 WHEN col = 2 AND (lo IS NULL OR y0 < lo) THEN 0 WHEN col = 2 AND y1 > hi THEN 3 WHEN col <> 1 THEN 1 WHEN NOT EXISTS (SELECT 1 FROM chunks l WHERE l.paper_id = m.paper_id AND l.page = m.page AND l.col = 0 AND (abs(l.y0 - m.y0) < 30 OR m.y0 BETWEEN l.y0 AND l.y1)) THEN 1 ELSE 2 END AS bucket FROM m), "
    "s AS (SELECT *, CASE WHEN y0 < 860 * 0.85::DOUBLE AND bucket = 1 AND col > 0 THEN 1 ELSE 0 END AS sub FROM b)"
)


@query(f"WITH {ORDER} SELECT id, bucket, row_number() OVER (PARTITION BY paper_id, page ORDER BY bucket, y0, sub, x0, id) - 1 AS order_in_page, row_number() OVER (PARTITION BY paper_id ORDER BY page, bucket, y0, sub, x0, id) - 1 AS global_order FROM s")
def w1_reading_order(spark, d):
    return lo.reading_order(chunks(spark, d), 860.0).select("id", "bucket", "order_in_page", "global_order")


@query(f"WITH {CHUNKS} SELECT id, substr(coalesce(lag(text) OVER w, ''), 1, 100) AS before, substr(coalesce(lead(text) OVER w, ''), 1, 100) AS behind FROM chunks WINDOW w AS (PARTITION BY paper_id ORDER BY ord)")
def w4_nearby_context(spark, d):
    return lo.nearby_context(chunks(spark, d)).select("id", "before", "behind")


@query("SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations")
def w5_sections(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("ord"), "role")
    return lo.sections(c, F.col("role") == "user").select(F.col("paper_id").alias("conv_id"), F.col("ord").alias("turn"), "section")


@query(f"WITH {CHUNKS} SELECT id, x1 - x0 > 360 AS is_wide, col FROM chunks")
def x26_infer_column(spark, d):
    c = chunks(spark, d)
    return c.select("id", (F.col("x1") - F.col("x0") > 360).alias("is_wide"), geo.column_of(F.when(F.col("x0") < 0, 0).otherwise(F.lit(600.0)), F.col("x0"), F.col("x1")).alias("wide")).join(c.select("id", "col"), "id").select("id", "is_wide", "col")


@query(f"WITH {CHUNKS}, p AS (SELECT a.id, b.id AS region, {INTER} / ((a.x1 - a.x0) * (a.y1 - a.y0)) AS share FROM chunks a JOIN chunks b ON a.paper_id = b.paper_id AND a.page = b.page AND a.id <> b.id WHERE a.content_type = 'table') SELECT id, region, round(share, 6) AS share FROM p WHERE share >= 0.1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY p.share DESC, region) = 1")
def j6_best_region(spark, d):
    c = chunks(spark, d)
    return lo.best_region(c.filter("content_type = 'table'"), c).withColumn("share", F.round("share", 6))


@query(f"WITH {CHUNKS} SELECT a.id, b.id AS text_id, row_number() OVER (PARTITION BY a.id ORDER BY b.y0 - a.y1, b.id) AS n FROM chunks a JOIN chunks b ON a.paper_id = b.paper_id AND a.page = b.page WHERE a.content_type = 'image' AND b.content_type = 'text' AND b.y0 - a.y1 BETWEEN 0 AND 80 QUALIFY n <= 2")
def j9_image_captions(spark, d):
    c = chunks(spark, d)
    return lo.captions(c.filter("content_type = 'image'"), c.filter("content_type = 'text'"))


@query(f"WITH {CHUNKS}, o AS (SELECT *, max(x1) OVER (PARTITION BY paper_id, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM chunks), g AS (SELECT *, sum((far IS NULL OR x0 - far >= 8)::INT) OVER (PARTITION BY paper_id, page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS range FROM o) SELECT paper_id, page, range, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY ALL")
def w15_column_ranges(spark, d):
    return lo.column_ranges(chunks(spark, d))


@query(f"WITH {CHUNKS} SELECT paper_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM chunks GROUP BY ALL")
def g27_box_union(spark, d):
    return chunks(spark, d).groupBy("paper_id", "page").agg(geo.union_all("box").alias("u")).select("paper_id", "page", "u.*")


METRICS = " , ".join(f"regexp_extract_all(text, '{p}', 0, 'i')" for p in tx.METRICS)


@query(f"SELECT doc_id, list_concat({METRICS}) AS metrics FROM (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 9 = 0 THEN ' Titer 2.5 g/L after 30 h, OD600 of 12' ELSE '' END AS text FROM documents)")
def x10_metrics(spark, d):
    more = F.when(F.col("doc_id") % 9 == 0, " Titer 2.5 g/L after 30 h, OD600 of 12").otherwise("")
    return table(spark, d, "documents").select("doc_id", tx.metrics(F.concat(F.coalesce("text", F.lit("")), more)).alias("metrics"))


MADE = "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'text' ELSE 'table' END AS content_type, doc_id % 11 = 0 AS excluded, CASE WHEN doc_id % 22 = 0 THEN 'body_heavy_low_column_candidate' ELSE '' END AS prior_source, doc_id % 4 = 0 AS has_caption, CASE WHEN doc_id % 13 = 0 THEN 'cut' ELSE ' ' END AS unparseable, CASE doc_id % 17 WHEN 0 THEN 'drop_candidate' WHEN 1 THEN 'mark_unparseable' WHEN 2 THEN 'expand_bbox' END AS llm_action, CASE WHEN doc_id % 8 = 3 THEN 'shrink_bbox' ELSE '' END AS rule_action, '' AS auto_action, CASE doc_id % 19 WHEN 0 THEN 'candidate_false_positive' WHEN 1 THEN 'fragmented_text_layer' ELSE '' END AS llm_category, '' AS rule_category, CAST(doc_id % 7 AS INT) AS `rows`, CAST(doc_id % 5 AS INT) AS cols, doc_id % 23 = 0 AS unparsed, CAST(doc_id * 7 % 101 AS DOUBLE) / 103 AS prose, CAST(doc_id * 13 % 101 AS DOUBLE) / 107 AS consistency, CAST(doc_id * 29 % 101 AS DOUBLE) / 109 AS fill, CAST(doc_id % 30 AS DOUBLE) / 10 AS area_ratio, CAST(doc_id % 40 AS INT) AS words, CAST(doc_id % 9 AS INT) AS numbers, CAST(doc_id % 4 AS INT) AS long_lines, CAST(doc_id % 12 AS INT) AS body_words FROM documents"
MADE_DUCK = MADE.replace("`rows`", '"rows"')
U = "least(1, greatest(0, {}))"
RAW = (
    'CASE WHEN "rows" > 0 AND cols > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN "rows" >= 3 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN cols >= 2 THEN 0.15::DOUBLE ELSE 0 END + 0.25::DOUBLE * consistency + 0.20::DOUBLE * fill + 0.10::DOUBLE * (1 - prose)'
    ' - CASE WHEN prose >= 0.25 THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN "rows" >= 3 AND cols >= 2 AND consistency < 0.55 THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN "rows" >= 3 AND cols >= 2 AND fill < 0.40 THEN 0.05::DOUBLE ELSE 0 END'
    " - CASE WHEN area_ratio < 0.35 OR area_ratio > 1.80 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN words > 0 AND numbers / greatest(words, 1) >= 0.18 THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN words > 0 AND (long_lines >= 2 OR body_words >= 8) THEN 0.08::DOUBLE ELSE 0 END"
)
SCORED = f"made AS ({MADE_DUCK}), scored AS (SELECT *, least(1, greatest(0, {RAW})) AS raw FROM made), tiered AS (SELECT *, round_even(raw, 3) AS score, CASE WHEN round_even(raw, 3) >= 0.78 THEN 'strong' WHEN round_even(raw, 3) >= 0.58 THEN 'usable' WHEN round_even(raw, 3) >= 0.35 THEN 'suspicious' ELSE 'failed' END AS tier FROM scored)"


def made(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("foliant_documents")
    m = spark.sql(MADE.replace("FROM documents", "FROM foliant_documents")).withColumn("score", st.candidate_score())
    return m.withColumn("tier", st.tier(F.col("score"))).withColumn("body_heavy", (F.col("words") > 0) & ((F.col("long_lines") >= 2) | (F.col("body_words") >= 8)))


@query(f"WITH {SCORED} SELECT doc_id, score, tier FROM tiered")
def m26_candidate_score(spark, d):
    return made(spark, d).select("doc_id", "score", "tier")


DECISION = (
    "CASE WHEN content_type <> 'table' THEN 'not_table' WHEN excluded AND prior_source = 'body_heavy_low_column_candidate' AND has_caption THEN 'captioned_table_overrides_body_heavy_low_column' WHEN excluded THEN 'existing_marker' WHEN trim(unparseable) <> '' THEN 'unparseable_marker' "
    "WHEN llm_action = 'drop_candidate' THEN 'judge_drop_candidate' WHEN llm_action = 'mark_unparseable' THEN 'judge_mark_unparseable' WHEN llm_category = 'candidate_false_positive' THEN 'judge_false_positive' WHEN llm_category = 'fragmented_text_layer' AND tier = 'failed' THEN 'failed_fragmented_text_layer' "
    "WHEN tier = 'failed' AND score < 0.35 AND (unparsed OR \"rows\" < 2 OR cols < 2) THEN 'failed_self_check_no_structure' WHEN tier = 'failed' AND score < 0.35 AND coalesce(llm_action, rule_action) NOT IN ('expand_bbox', 'shrink_bbox') THEN 'failed_self_check_no_repair' WHEN tier = 'failed' AND prose >= 0.35 THEN 'failed_body_text_contamination' "
    "WHEN words > 0 AND (long_lines >= 2 OR body_words >= 8) AND cols <= 2 AND score < 0.78 AND NOT has_caption THEN 'body_heavy_low_column_candidate' ELSE 'table_self_check_passed_or_repairable' END"
)


@query(f"WITH {SCORED} SELECT doc_id, decision, decision NOT IN ('not_table', 'captioned_table_overrides_body_heavy_low_column', 'table_self_check_passed_or_repairable') AS excluded FROM (SELECT doc_id, {DECISION} AS decision FROM tiered)")
def m30_storage_decision(spark, d):
    m = made(spark, d).select("doc_id", st.storage_decision().alias("decision"))
    return m.withColumn("excluded", st.excludes(F.col("decision")))


@query("SELECT doc_id, CASE WHEN c >= 0.65 THEN 'strong' WHEN c >= 0.40 THEN 'gray' ELSE 'weak' END AS band FROM (SELECT doc_id, (doc_id % 100)::DOUBLE / 100 AS c FROM documents)")
def m6_band(spark, d):
    return table(spark, d, "documents").select("doc_id", st.band((F.col("doc_id") % 100) / 100).alias("band"))


@query("SELECT doc_id, CASE WHEN delta >= 0.08 THEN 'improved' WHEN delta <= -0.08 THEN 'regressed' ELSE 'unchanged' END AS verdict FROM (SELECT doc_id, round_even((doc_id * 7 % 100)::DOUBLE / 100 - (doc_id % 100)::DOUBLE / 100, 3) AS delta FROM documents)")
def m27_compare_scores(spark, d):
    return table(spark, d, "documents").select("doc_id", st.comparison((F.col("doc_id") % 100) / 100, (F.col("doc_id") * 7 % 100) / 100).alias("verdict"))


@query("SELECT doc_id, trim(substr(concat_ws(chr(10), source, lang, trim(text)), 1, 6000)) AS search_text FROM documents WHERE text NOT IN (source, lang)")
def x6_search_text(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", st.search_text(F.col("source"), F.upper("lang"), F.col("lang"), F.col("text")).alias("search_text")).withColumn("search_text", F.expr("regexp_replace(search_text, '^(src[0-9]+)\n([A-Z]{2})\n', concat('$1', '\n', lower(regexp_extract(search_text, '\n([A-Z]{2})\n', 1)), '\n'))"))


@query("SELECT count(*) AS scanned, count(*) FILTER (doc_id % 3 <> 0) AS changed, count(*) FILTER (doc_id % 3 = 0) AS unchanged FROM documents")
def k13_backfill_counters(spark, d):
    """A backfill that would change two rows of three: the stored value of the third already is the new one."""
    t = table(spark, d, "documents").withColumn("new", tx.normalize_search(F.col("source"))).withColumn("old", F.when(F.col("doc_id") % 3 == 0, F.col("new")))
    same = F.col("old").eqNullSafe(F.col("new"))
    return t.agg(F.count("*").alias("scanned"), F.count_if(~same).alias("changed"), F.count_if(same).alias("unchanged"))


@query("SELECT a.conv_id, a.turn, b.turn AS other FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND abs(a.turn - b.turn) <= 2")
def j2_band_join(spark, d):
    c = table(spark, d, "conversations")
    o = c.select("conv_id", F.col("turn").alias("other"))
    return c.select("conv_id", "turn").join(o, "conv_id").filter((F.col("turn") != F.col("other")) & (F.abs(F.col("turn") - F.col("other")) <= 2))


@query("SELECT id, score FROM (SELECT vec_id AS id, 1 AS f, label::DOUBLE AS score FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, 0, -label::DOUBLE FROM embeddings WHERE vec_id % 3 <> 1) QUALIFY row_number() OVER (PARTITION BY id ORDER BY f) = 1")
def d1_append_unique(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("score"))
    return rt.append_unique(e.filter("id % 3 <> 1").withColumn("score", -F.col("score")), e.filter("id % 3 <> 0"))
