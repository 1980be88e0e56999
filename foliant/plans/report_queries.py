"""Queries on reports, verdicts, cases and the steps around a paper's judges."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import evaluation as ev
from foliant.operators import layout as lo
from foliant.operators import literature as li
from foliant.operators import reports as rp
from foliant.operators import storage as st
from foliant.plans.literature_queries import CASES, cases
from foliant.plans.retrieval_queries import ANCHOR_ENTRIES, HAS_ANCHOR, anchored
from foliant.plans.store_queries import CHUNKS, chunks, verdicts
from foliant.registry import query, table

SCORES = "round_even(avg(coalesce(1.0::DOUBLE / rank, 0)), 4) AS mrr, round_even(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_at_10"


def number():
    return F.col("doc_id")


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source", "lang", "n_chars")


def pick(n: int, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number() % n + 1).cast("int"))


def checks(spark, d):
    """Table checks made up from documents."""
    return docs(spark, d).select(
        number().alias("ord"), F.col("source").alias("pdf"), (number() % 50).cast("string").alias("region"), (number() % 3 == 0).alias("succeeded"), pick(4, "strong", "usable", "suspicious", "failed").alias("tier"),
        pick(3, "prose_heavy", "low_consistency", "").alias("reasons"), pick(3, "candidate_false_positive", "no_parser_output", "fine").alias("category"), pick(2, "store", "retry").alias("action"),
        pick(3, "trim | pad", "trim", "").alias("repairs"), pick(2, "regressed", "improved").alias("verdict"), (number() % 5 == 0).alias("retried"), (number() % 7 == 0).alias("judge"), (number() % 2 == 0).alias("excluded"),
        F.lit("not_table").alias("exclusion_reason"), pick(2, "", "llm").alias("decision_source"), (number() % 14 == 0).alias("retry_succeeded"),
    )


CHECKS = [
    ("candidate_tiers", "CASE doc_id % 4 WHEN 0 THEN 'strong' WHEN 1 THEN 'usable' WHEN 2 THEN 'suspicious' ELSE 'failed' END"),
    ("rule_categories", "CASE doc_id % 3 WHEN 0 THEN 'candidate_false_positive' WHEN 1 THEN 'no_parser_output' ELSE 'fine' END"),
    ("recommended_actions", "CASE doc_id % 2 WHEN 0 THEN 'store' ELSE 'retry' END"),
    ("repair_actions", "CASE WHEN doc_id % 3 < 2 THEN 'trim' END"),
    ("repair_actions", "CASE WHEN doc_id % 3 = 0 THEN 'pad' END"),
    ("retry_verdicts", "CASE WHEN doc_id % 5 = 0 THEN CASE doc_id % 2 WHEN 0 THEN 'regressed' ELSE 'improved' END END"),
    ("risk_flags", "CASE WHEN doc_id % 3 = 0 THEN 'body_text_contamination' END"),
    ("risk_flags", "CASE WHEN doc_id % 3 = 1 THEN 'low_consistency' END"),
    ("risk_flags", "CASE WHEN doc_id % 3 = 0 THEN 'candidate_false_positive' END"),
    ("risk_flags", "CASE WHEN doc_id % 7 = 0 THEN 'needs_llm_judge' END"),
    ("risk_flags", "CASE WHEN doc_id % 2 = 0 THEN 'retry_regressed' END"),
    ("risk_flags", "CASE WHEN doc_id % 2 = 0 THEN 'excluded_from_storage' END"),
    ("succeeded", "CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END"),
    ("excluded_reasons", "CASE WHEN doc_id % 2 = 0 THEN 'not_table' END"),
    ("decision_sources", "CASE WHEN doc_id % 2 = 1 THEN 'llm' END"),
]


@query(" UNION ALL ".join(f"SELECT '{s}' AS section, {k} AS key, count(*) AS n FROM documents WHERE {k} IS NOT NULL GROUP BY ALL" for s, k in CHECKS))
def g21_self_check(spark, d):
    return rp.self_check(checks(spark, d))


@query("WITH p AS (SELECT source AS pdf, (doc_id % 50)::VARCHAR AS region, doc_id AS ord, CASE WHEN doc_id % 7 = 0 AND doc_id % 14 > 0 THEN 0 WHEN doc_id % 3 = 1 THEN 1 END AS priority FROM documents), f AS (SELECT pdf, region, min(priority * 1000000000 + ord) AS first FROM p WHERE priority IS NOT NULL GROUP BY pdf, region ORDER BY first, pdf, region LIMIT 15) SELECT pdf, region, (first // 1000000000)::INT AS priority FROM f")
def f20_judge_sample(spark, d):
    return rp.judge_sample(checks(spark, d), 15)


@query("SELECT doc_id AS id, n_chars AS duration FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def t8_slowest(spark, d):
    return docs(spark, d).select(number().alias("id"), F.col("n_chars").alias("duration")).orderBy(F.desc("duration"), "id").limit(10)


@query("SELECT doc_id AS id, lang, source AS title FROM documents ORDER BY lang DESC NULLS LAST, source DESC NULLS LAST, doc_id")
def t5_candidate_file_order(spark, d):
    return docs(spark, d).orderBy(F.desc_nulls_last("lang"), F.desc_nulls_last("source"), "doc_id").select(number().alias("id"), "lang", F.col("source").alias("title"))


@query("SELECT user_id, max(ts) AS created FROM events GROUP BY user_id ORDER BY created DESC, user_id")
def t10_newest_first(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("created")).orderBy(F.desc("created"), "user_id")


@query(f"WITH {CASES} SELECT case_type, {SCORES} FROM r GROUP BY case_type")
def g15_by_type(spark, d):
    s = ev.summary(cases(spark, d).withColumn("case_type", F.coalesce("case_type", F.lit("")))).filter("case_type IS NOT NULL")
    return s.select(tx.filled(F.col("case_type")).alias("case_type"), F.bround("mrr", 4).alias("mrr"), F.bround("hit_at_10", 4).alias("hit_at_10"))


@query(f"WITH {CASES}, b AS (SELECT case_type, avg(coalesce(1.0::DOUBLE / rank, 0)) AS m FROM r WHERE case_type IS NOT NULL GROUP BY case_type), c AS (SELECT case_type, avg(CASE WHEN rank > 1 THEN 1.0::DOUBLE / (rank - 1) WHEN rank = 1 THEN 1 ELSE 0 END) AS m FROM r WHERE case_type IS NOT NULL GROUP BY case_type) SELECT case_type, round_even(c.m - b.m, 4) AS mrr FROM b JOIN c USING (case_type)")
def g19_report_deltas(spark, d):
    known = cases(spark, d).filter("case_type IS NOT NULL")
    better = known.withColumn("rank", F.greatest(F.col("rank") - 1, F.when(F.col("rank").isNotNull(), 1)))
    return rp.deltas(*[ev.summary(x).filter("case_type IS NOT NULL") for x in (known, better)], "case_type", "mrr")


@query("SELECT 'policy' AS section, lang AS key, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', 'raw', count(*) FROM documents UNION ALL SELECT 'source', 'entity', count(*) FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'triggered', CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END, count(*) FROM documents GROUP BY ALL")
def g17_route_counts(spark, d):
    routes = F.array(F.lit("raw"), F.when(number() % 2 == 0, "entity"))
    return rp.counted(docs(spark, d), policy=F.array("lang"), source=routes, triggered=F.array(number() % 3 == 0))


@query(f"WITH {CASES} SELECT {SCORES}, round_even(avg(CASE WHEN rank <= 12 THEN 1.0::DOUBLE ELSE 0 END) - avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END), 4) AS gained FROM r")
def g20_context_summary(spark, d):
    """Hits in the first ten before context is added, and what two more places of context add."""
    s = cases(spark, d).agg(*ev.metrics((10, 12)))
    return s.select(F.bround("mrr", 4).alias("mrr"), F.bround("hit_at_10", 4).alias("hit_at_10"), F.bround(F.col("hit_at_12") - F.col("hit_at_10"), 4).alias("gained"))


@query(f"WITH {CHUNKS} SELECT 'types' AS section, content_type AS key, count(*) AS n FROM chunks GROUP BY content_type UNION ALL SELECT 'pages', page::VARCHAR, count(*) FROM chunks GROUP BY page UNION ALL SELECT 'boxed', 'true', count(*) FROM chunks")
def g23_archive_summary(spark, d):
    return rp.counted(chunks(spark, d), types=F.array("content_type"), pages=F.array("page"), boxed=F.array(F.col("box").isNotNull()))


@query(f"WITH {CHUNKS} SELECT paper_id, count(*) AS total, count(DISTINCT content_type) AS types, count(DISTINCT page) AS pages, bool_and(text <> '') AS filled FROM chunks GROUP BY paper_id")
def g24_chunk_summary(spark, d):
    return chunks(spark, d).groupBy("paper_id").agg(F.count("*").alias("total"), F.count_distinct("content_type").alias("types"), F.count_distinct("page").alias("pages"), F.every(F.col("text") != "").alias("filled"))


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'skip' WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'fail' ELSE 'partial' END WHEN doc_id % 3 = 0 AND doc_id % 11 > 0 THEN 'no_store' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY status")
def g30_batch_counters(spark, d):
    zero = F.lit(0)
    status = rp.job_outcome(number() % 5 == 0, number() % 2, zero, (number() % 7 == 0).cast("int"), (number() % 3 != 0).cast("int"), (number() % 11 == 0).cast("int"))
    return docs(spark, d).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {CHUNKS} SELECT paper_id, count(*) AS total, count(*) FILTER (content_type = 'text') AS text, count(*) FILTER (content_type = 'table') AS 'table', count(*) FILTER (content_type = 'image') AS image, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality <> 1) AS failed FROM chunks LEFT JOIN labels ON id = doc_id GROUP BY paper_id")
def p16_snapshot_stats(spark, d):
    return rp.snapshot_stats(chunks(spark, d).join(verdicts(spark, d), "id", "left"), "paper_id")


@query("WITH i AS (SELECT doc_id, n_chars > 1000 AS high, doc_id % 3 AS pdf FROM documents) SELECT 0 AS place, '本次窗口内共有 500 条候选，纳入简报 ' || count(*) || ' 条。' AS line FROM i UNION ALL SELECT 1, count(*) FILTER (high) || ' 条被标为高优先级，建议优先查看。' FROM i UNION ALL SELECT 2, count(*) FILTER (pdf = 0) || ' 条已有可访问 PDF，可直接进入导入前处理。' FROM i UNION ALL SELECT 3, count(*) FILTER (pdf = 1) || ' 条 PDF 暂不可访问，可先作为元数据候选保留。' FROM i UNION ALL SELECT 4, '主要主题集中在：' || (SELECT string_agg(topic || '(' || n || ')', '、' ORDER BY n DESC, topic) FROM (SELECT 't' || doc_id % 5 AS topic, count(*) AS n FROM documents GROUP BY topic ORDER BY n DESC, topic LIMIT 3)) || '。'")
def g8_highlights(spark, d):
    items = docs(spark, d).select(F.when(F.col("n_chars") > 1000, "high").otherwise("low").alias("priority"), pick(3, "verified", "unavailable", "unknown").alias("pdf_status"), F.array(F.concat(F.lit("t"), (number() % 5).cast("string"))).alias("topics"))
    return rp.highlights(items, 500)


@query(f"WITH {CHUNKS}, h AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY y0, id) AS n FROM chunks WHERE page = 1 AND content_type = 'text' QUALIFY n <= 3) SELECT paper_id, md5(substr(string_agg(trim(text), ' ' ORDER BY n), 1, 200)) AS h FROM h GROUP BY paper_id")
def u4_paper_titles(spark, d):
    return rp.paper_titles(chunks(spark, d)).select("paper_id", F.md5("title").alias("h"))


#: Every seventh short-numbered chunk opens an abstract, every ninth an introduction.
OPENED = "CASE WHEN ord % 7 = 3 THEN 'ABSTRACT ' WHEN ord % 9 = 5 THEN 'INTRODUCTION ' ELSE '' END"
WORDS = r"len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> ''))"


@query(
    f"WITH {CHUNKS}, t AS (SELECT paper_id, ord, trim({OPENED} || coalesce(text, '')) AS t FROM chunks WHERE content_type = 'text'), g AS (SELECT *, {WORDS} >= 20 AS good, ord >= min(CASE WHEN regexp_matches(t, '^(ABSTRACT|Abstract|摘要)') THEN ord END) OVER (PARTITION BY paper_id) AS inside FROM t), "
    "got AS (SELECT *, coalesce(count(*) FILTER (inside AND good) OVER (PARTITION BY paper_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS got FROM g), "
    r"closed AS (SELECT *, coalesce(bool_or(inside AND got > 0 AND regexp_matches(t, '(?i)^(INTRODUCTION|KEYWORDS|关键词|1\.)')) OVER (PARTITION BY paper_id ORDER BY ord), false) AS closed FROM got), "
    "a AS (SELECT paper_id, string_agg(t, ' ' ORDER BY ord) AS text FROM closed WHERE good AND inside AND NOT closed GROUP BY paper_id), b AS (SELECT paper_id, string_agg(t, ' ' ORDER BY ord) AS text FROM (SELECT * FROM g WHERE good QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY ord) <= 25) GROUP BY paper_id) "
    "SELECT paper_id, md5(substr(coalesce(a.text, b.text), 1, 4000)) AS h FROM b LEFT JOIN a USING (paper_id)"
)
def u5_classification_text(spark, d):
    c = chunks(spark, d).withColumn("text", F.concat(F.expr(OPENED), F.coalesce("text", F.lit(""))))
    return rp.classification_texts(c.filter("paper_id IS NOT NULL")).select("paper_id", F.md5("text").alias("h"))


@query(f"WITH {CHUNKS} SELECT id, '[标题] ' || paper_id || chr(10) || '[分类] other | 发酵相关性: 0.5 | 可信度: 0.6' || chr(10) || '[产物] a, b' || chr(10) || '[菌株] ' || chr(10) || '[摘要] s' || chr(10) || '[判断依据] ' || chr(10) || '[位置] ' || content_type || ' | chunk ' || ord || '/9' AS context FROM chunks WHERE paper_id IS NOT NULL")
def u8_context_prefix(spark, d):
    none = F.lit(None).cast("string")
    context = rp.context_prefix(F.col("paper_id"), F.lit("other"), F.lit(0.5), F.lit(0.6), F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>"), F.lit("s"), none, F.col("content_type"), F.col("ord"), F.lit(9))
    return chunks(spark, d).filter("paper_id IS NOT NULL").select("id", context.alias("context"))


@query("SELECT doc_id AS id, true AS passed, 1.0::DOUBLE AS score, 'mineru_parser_trusted' AS issue_type FROM documents")
def u10_trusted_verdicts(spark, d):
    return rp.trusted_verdicts(chunks(spark, d))


@query("SELECT doc_id AS id FROM documents WHERE NOT (length(trim(text)) < 40 OR NOT regexp_matches(text, '[A-Za-z]')) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def u2_still_to_judge(spark, d):
    return rp.judged_once(chunks(spark, d), verdicts(spark, d), lo.is_noise(F.col("text"))).select("id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'skipped' WHEN doc_id % 2 = 0 THEN 'candidate' ELSE 'imported' END AS status FROM documents")
def e8_filter_applied(spark, d):
    return docs(spark, d).select("doc_id", rp.brief_filter(pick(3, "other", "01", "02"), pick(2, "skipped", "imported"), False).alias("status"))


@query("SELECT 'title:' || source AS id, 'title' AS case_type, 'Report of paper ' || source AS query, source AS paper_id FROM documents WHERE source IS NOT NULL GROUP BY source")
def v1_title_cases(spark, d):
    papers = docs(spark, d).filter("source IS NOT NULL").select(F.col("source").alias("paper_id"), F.concat(F.lit("Report of paper "), "source").alias("title")).distinct()
    return rp.title_cases(papers)


ASK = "CASE WHEN m <> '' THEN 'Which evidence passage reports ' || m || ' for ' || lang || '?' WHEN content_type = 'table' THEN 'Which table summarizes experimental evidence for ' || lang || '?' WHEN content_type = 'image' THEN 'Which figure or image describes experimental evidence for ' || lang || '?' WHEN regexp_matches(lower(text), 'yield|titer|productivity|concentration|activity') THEN 'Find the result evidence about yield, titer, or activity for ' || lang || '.' ELSE 'Find the evidence passage about ' || lang || '.' END"
METRIC = r"\b\d+(?:\.\d+)?\s*(?:g\s*/\s*l|mg\s*/\s*l|g/l|mg/l|h|hr|hours?|%|fold|mmol|mol|od600|rpm)\b"


@query(
    rf"WITH c AS (SELECT doc_id AS id, source AS paper_id, coalesce(lang, 'x') AS lang, CASE doc_id % 7 WHEN 0 THEN 'table' WHEN 1 THEN 'image' ELSE 'text' END AS content_type, CASE WHEN doc_id % 13 = 0 THEN 'About 12.5 g / L. ' ELSE '' END || text AS text FROM documents), m AS (SELECT *, trim(regexp_replace(regexp_extract(text, '{METRIC}', 0, 'i'), '\s+', ' ', 'g')) AS m FROM c WHERE length(text) >= 180), q AS (SELECT *, {ASK} AS query FROM m) "
    "SELECT paper_id, id, query, row_number() OVER (PARTITION BY paper_id ORDER BY (CASE WHEN m <> '' THEN 5 ELSE 0 END + CASE content_type WHEN 'table' THEN 4 WHEN 'image' THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(query), 'yield|titer|activity|concentration') THEN 2 ELSE 0 END) DESC, id) AS place FROM q QUALIFY place <= 3"
)
def v2_hard_cases(spark, d):
    c = chunks(spark, d).join(docs(spark, d).select(number().alias("id"), F.coalesce("lang", F.lit("x")).alias("subject")), "id")
    return rp.hard_cases(c.withColumn("text", F.concat(F.when(F.col("id") % 13 == 0, "About 12.5 g / L. ").otherwise(""), "text")))


@query(f"WITH {CHUNKS} SELECT DISTINCT paper_id, page FROM chunks WHERE page NOT IN (SELECT page FROM chunks WHERE content_type = 'table' AND page % 2 = 0) AND paper_id IS NOT NULL")
def v12_captions_without_region(spark, d):
    c = chunks(spark, d).filter("paper_id IS NOT NULL")
    pages = c.filter("content_type = 'table' AND page % 2 = 0").select("page").distinct()
    return rp.missing_regions(c, c.join(pages, "page").select("paper_id", "page"))


@query(f"WITH {CHUNKS}, r AS (SELECT *, ord % 14 AS region FROM chunks WHERE content_type = 'table'), w AS (SELECT id, id % 2 = 0 AS needs, min(x0) OVER w AS x0, max(y1) OVER w AS y1, count(*) OVER w AS fragments FROM r WINDOW w AS (PARTITION BY paper_id, page, region)) SELECT id, x0, y1, fragments FROM w WHERE needs AND fragments >= 2")
def m33_clip_by_region(spark, d):
    c = chunks(spark, d).filter("content_type = 'table'").withColumns({"region": F.col("ord") % 14, "needs_vision": F.col("id") % 2 == 0})
    return rp.clip_by_region(c).select("id", "clip.x0", "clip.y1", "fragments")


@query(f"WITH {CHUNKS} SELECT content_type, count(*) AS n FROM chunks GROUP BY content_type")
def d6_merged_streams(spark, d):
    kinds = [chunks(spark, d).filter(F.col("content_type") == k) for k in ("text", "table", "image")]
    both = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return both.groupBy("content_type").agg(F.count("*").alias("n"))


@query(f"WITH {CHUNKS} SELECT id, paper_id, parser FROM chunks, (VALUES ('region_guided'), ('pdfplumber'), ('camelot')) AS p(parser) WHERE content_type = 'table' AND NOT (parser = 'camelot' AND id % 2 = 0)")
def j16_attempts_left(spark, d):
    regions = chunks(spark, d).filter("content_type = 'table'")
    done = regions.filter("id % 2 = 0").select("id", F.lit("camelot").alias("parser"))
    families = F.explode(F.array(*[F.lit(p) for p in ("region_guided", "pdfplumber", "camelot")]))
    return regions.select("id", "paper_id", families.alias("parser")).join(done, ["id", "parser"], "left_anti").select("id", "paper_id", "parser")


@query("SELECT d.doc_id, d.source, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def j19_contexts(spark, d):
    return docs(spark, d).join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left").select("doc_id", "source", "toxic")


@query("SELECT doc_id, md5(text) AS h, CASE WHEN doc_id % 2 = 0 THEN 'described' END AS description FROM documents WHERE text IS NOT NULL AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 1 AND text IS NOT NULL)")
def k15_cached_descriptions(spark, d):
    """Contents whose hash no odd document has, with their cached description: a join to the cache by hash."""
    rows = docs(spark, d).filter("text IS NOT NULL").select("doc_id", F.md5("text").alias("h"))
    odd = rows.filter("doc_id % 2 = 1").select("h").distinct()
    left = rows.join(odd, "h", "left_anti")
    cache = left.filter("doc_id % 2 = 0").select("h", F.lit("described").alias("description")).distinct()
    return left.join(cache, "h", "left").select("doc_id", "h", "description")


@query()
def k2_split_and_added(spark, d):
    """Texts stored by the piece; an id held before is replaced."""
    from foliant.functions import splitting as sp

    pieces = sp.split(docs(spark, d).select("doc_id", "source", "text"), "text")
    return pieces.groupBy(F.col("source").alias("paper_id")).agg(F.count("*").alias("pieces"))


@query(f"WITH {ANCHOR_ENTRIES} SELECT id AS doc_id, {HAS_ANCHOR} AS anchored FROM a")
def f14_strict_anchor(spark, d):
    from foliant.operators import retrieval as rt

    return anchored(spark, d).select(F.col("id").alias("doc_id"), rt.has_anchor(F.col("t")).alias("anchored"))


@query("SELECT doc_id, source AS paper_id, coalesce(quality, 0) AS quality, false AS reranked FROM documents LEFT JOIN labels USING (doc_id)")
def p1_formatted_hits(spark, d):
    rows = docs(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", F.col("source").alias("paper_id"), F.coalesce("quality", F.lit(0)).alias("quality"), F.lit(False).alias("reranked"))


@query(f"WITH {CHUNKS} SELECT id, page, CASE WHEN content_type = 'table' THEN 'clean' ELSE '' END AS table_quality, 'pending' AS enrichment_status, CASE WHEN id % 2 = 0 THEN 'chunk' ELSE 'seo' END AS section FROM chunks")
def p3_store_metadata(spark, d):
    """Fields set by the store win over annotations, and these over what the chunk brought."""
    own, seo = F.when(F.col("id") % 2 == 0, "chunk"), F.when(F.col("id") % 2 == 1, "seo")
    return chunks(spark, d).select("id", "page", F.when(F.col("content_type") == "table", "clean").otherwise("").alias("table_quality"), F.lit("pending").alias("enrichment_status"), tx.first_filled(seo, own).alias("section"))


@query("SELECT count(*) AS monitors FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 <> 0")
def o10_monitors(spark, d):
    """Monitors after some were deleted."""
    held = table(spark, d, "events").select(F.col("user_id").alias("paper_id")).distinct()
    return st.without_papers(held, held.filter("paper_id % 3 = 0")).agg(F.count("*").alias("monitors"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '05' ELSE 'other' END AS category_id FROM documents")
def o9_stored_classification(spark, d):
    """A stored classification is used again, a missing one computed: the texts name no host and no protein."""
    low = F.lower(F.coalesce("text", F.lit("")))
    return docs(spark, d).select("doc_id", F.coalesce(F.when(number() % 2 == 0, "05"), li.classified(low)["category_id"]).alias("category_id"))


@query(f"WITH {CHUNKS}, l AS (SELECT id, CASE WHEN content_type = 'table' THEN CASE WHEN id % 2 = 0 THEN 'excluded' ELSE 'stored' END ELSE 'other' END AS status, CASE WHEN x0 / 300 >= 0.65 THEN 'strong' WHEN x0 / 300 >= 0.40 THEN 'gray' ELSE 'weak' END AS band, page FROM chunks) SELECT id FROM l WHERE page = 1 AND status = 'excluded' AND band = 'gray'")
def f18_debug_filter(spark, d):
    status = F.when(F.col("content_type") != "table", "other").when(F.col("id") % 2 == 0, "excluded").otherwise("stored")
    rows = chunks(spark, d).withColumns({"status": status, "band": st.band(F.col("x0") / 300)})
    return st.filtered(rows, page=1, status="excluded", band="gray").select("id")
