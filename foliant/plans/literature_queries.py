"""Literature, evaluation and monitor queries: documents stand for candidates and cases, events for the run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import evaluation as ev
from foliant.operators import literature as li
from foliant.registry import query, table
from foliant.streaming import monitor as mo

#: One candidate for each document, in SQL that both engines read.
FIELDS = [
    "doc_id AS id", "CASE doc_id % 5 WHEN 0 THEN 'pubmed' WHEN 1 THEN 'europe_pmc' WHEN 2 THEN 'openalex' WHEN 3 THEN 'biorxiv' ELSE 'crossref' END AS source",
    "CASE WHEN doc_id % 3 = 0 THEN concat('https://doi.org/10.1101/ABC.', CAST(doc_id % 200 AS STRING), '.') ELSE '' END AS doi", "CASE WHEN doc_id % 4 = 0 THEN concat('PMID ', CAST(doc_id % 300 AS STRING)) ELSE '' END AS pmid",
    "'' AS pmcid", "'' AS openalex", "split_part(text, chr(10), 1) AS title", "CASE WHEN doc_id % 6 = 0 THEN '' ELSE substr(text, length(split_part(text, chr(10), 1)) + 2) END AS abstract", "CAST(2015 + doc_id % 12 AS INT) AS year",
    "CASE WHEN doc_id % 7 = 0 THEN 'http://x/y.pdf' ELSE '' END AS pdf_url", "CASE doc_id % 8 WHEN 0 THEN 'verified' WHEN 1 THEN 'unavailable' ELSE 'unknown' END AS pdf_access_status", "doc_id % 9 = 0 AS is_open_access",
]
PRIO = "CASE source WHEN 'pubmed' THEN 10 WHEN 'europe_pmc' THEN 20 WHEN 'openalex' THEN 30 WHEN 'biorxiv' THEN 40 ELSE 50 END"
CAND = f"c AS (SELECT *, {PRIO} AS priority FROM (SELECT {', '.join(FIELDS).replace('AS STRING', 'AS VARCHAR')} FROM documents))"
KEYS = (
    f"{CAND}, k AS (SELECT *, list_filter([CASE WHEN doi <> '' THEN 'doi:' || rtrim(lower(replace(doi, 'https://doi.org/', '')), '.') END, CASE WHEN pmid <> '' THEN 'pmid:' || replace(pmid, 'PMID ', '') END, "
    r"CASE WHEN title_key <> '' THEN 'title:' || title_key || '|' || year END], lambda x: x IS NOT NULL) AS keys FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(title), '<[^>]+>', ' ', 'g'), '[^a-z0-9\x{4e00}-\x{9fff}]+', ' ', 'g')) AS title_key FROM c))"
)
SCORE = "CASE WHEN pdf_access_status = 'verified' THEN 30 WHEN pdf_url <> '' THEN 16 ELSE 0 END + CASE WHEN is_open_access THEN 10 ELSE 0 END + CASE WHEN trim(abstract) <> '' THEN 8 ELSE 0 END + CASE WHEN pmid <> '' THEN 6 ELSE 0 END + CASE WHEN doi <> '' THEN 4 ELSE 0 END + CASE WHEN year >= 2025 THEN 5 ELSE 0 END"


def candidates(spark, d):
    return table(spark, d, "documents").selectExpr(*FIELDS).withColumn("priority", li.source_priority(F.col("source")))


def keyed(spark, d):
    c = F.col
    return candidates(spark, d).withColumn("keys", li.identity_keys(c("doi"), c("pmid"), c("pmcid"), c("openalex"), c("title"), c("year")))


@query(f"WITH {KEYS} SELECT id, keys FROM k")
def x14_identity_keys(spark, d):
    return keyed(spark, d).select("id", "keys")


@query(f"WITH {KEYS} SELECT id, 'ext_' || substr(sha1(keys[1]), 1, 16) AS candidate_id FROM k WHERE len(keys) > 0")
def e1_candidate_id(spark, d):
    return keyed(spark, d).filter(F.size("keys") > 0).select("id", li.candidate_id(F.col("keys")).alias("candidate_id"))


@query(f"WITH {CAND} SELECT id, priority FROM c")
def e2_source_priority(spark, d):
    return candidates(spark, d).select("id", "priority")


@query(f"WITH {KEYS}, i AS (SELECT id, unnest(keys) AS key, generate_subscripts(keys, 1) AS place FROM k WHERE id % 7 < 3), o AS (SELECT key, min(id) AS existing_id FROM (SELECT id, unnest(keys) AS key FROM k WHERE id % 7 >= 3) GROUP BY key) SELECT id, existing_id FROM i JOIN o USING (key) QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, existing_id) = 1")
def j8_identity_match(spark, d):
    k = keyed(spark, d)
    return li.matched(k.filter("id % 7 < 3"), k.filter("id % 7 >= 3"))


@query(f"WITH {CAND}, g AS (SELECT *, id % 200 AS grp FROM c) SELECT grp, arg_min(title, (priority, id)) FILTER (trim(title) <> '') AS title, arg_min(abstract, (priority, id)) FILTER (trim(abstract) <> '') AS abstract, min(priority) AS priority, list_sort(list(DISTINCT source)) AS sources, bool_or(is_open_access) AS is_open_access FROM g GROUP BY grp")
def e3_merge_by_priority(spark, d):
    return li.merged(candidates(spark, d).withColumn("grp", F.col("id") % 200), "grp", "title", "abstract")


@query(f"WITH {CAND} SELECT id, {SCORE} AS score, CASE WHEN {SCORE} >= 38 THEN 'high' WHEN {SCORE} >= 18 THEN 'medium' ELSE 'low' END AS priority_label FROM c")
def e10_priority(spark, d):
    return candidates(spark, d).select("id", li.priority_score(2026).alias("score")).withColumn("priority_label", li.priority_label(F.col("score")))


@query(f"WITH {CAND} SELECT CASE WHEN pdf_access_status IN ('verified', 'unavailable') THEN pdf_access_status WHEN pdf_url <> '' THEN 'unchecked' ELSE 'none' END AS value, count(*) AS n FROM c GROUP BY 1")
def g6_pdf_buckets(spark, d):
    return li.counted(candidates(spark, d).select(li.pdf_bucket(F.col("pdf_url"), F.col("pdf_access_status")).alias("b")), "b")


@query("SELECT source AS value, count(*) AS n FROM documents WHERE trim(source) <> '' GROUP BY 1")
def g5_count_values(spark, d):
    return li.counted(table(spark, d, "documents"), "source")


@query(f"WITH {CAND}, s AS (SELECT *, {SCORE} AS score FROM c) SELECT id, score, row_number() OVER (ORDER BY score DESC, year DESC, title DESC, id) AS rank FROM s QUALIFY rank <= 20")
def t4_brief_rank(spark, d):
    return li.ranked_brief(candidates(spark, d).withColumn("score", li.priority_score(2026)), 20).select("id", "score", "rank")


@query("SELECT event_id FROM events WHERE ts::DATE BETWEEN (SELECT max(ts)::DATE - 14 FROM events) AND (SELECT max(ts)::DATE FROM events)")
def f7_date_window(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max(F.col("ts").cast("date")).alias("until"))
    return e.crossJoin(F.broadcast(last)).filter(li.in_window(F.col("ts").cast("date"), F.col("until"), 14)).select("event_id")


@query("SELECT doc_id FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(text), 'ing')) AND contains(lower(text), 'tion')")
def f9_boolean_query(spark, d):
    return table(spark, d, "documents").filter(tx.boolean_query(F.col("text"), "the OR ing AND tion")).select("doc_id")


@query("SELECT doc_id, CASE WHEN len(t) > 0 THEN t ELSE ['other'] END AS topics FROM (SELECT doc_id, list_filter([CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'moron') THEN 'insult' END, CASE WHEN contains(lower(text), 'license') THEN 'license' END], lambda x: x IS NOT NULL) AS t FROM documents)")
def e12_topics(spark, d):
    return table(spark, d, "documents").select("doc_id", li.topics(F.lower("text"), {"insult": ["idiot", "moron"], "license": ["license"]}).alias("topics"))


@query("SELECT user_id, arg_max(event_type, (ts, event_type)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def w9_latest_row(spark, d):
    return li.latest(table(spark, d, "events"), "user_id", "ts", "event_type")


CASES = "r AS (SELECT doc_id AS case_id, lang AS case_type, CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 23 + 1 AS INT) END AS rank, CAST(n_chars AS DOUBLE) AS elapsed_ms FROM documents)"


def cases(spark, d):
    rank = F.when(F.col("doc_id") % 4 > 0, (F.col("doc_id") % 23 + 1).cast("int"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("case_type"), rank.alias("rank"), F.col("n_chars").cast("double").alias("elapsed_ms"))


HITS = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_{k}" for k in (1, 5, 10))


@query(f"WITH {CASES} SELECT case_type, count(*) AS cases, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, {HITS}, round(avg(elapsed_ms), 6) AS avg_ms, quantile_disc(elapsed_ms, 0.5) AS p50, quantile_disc(elapsed_ms, 0.95) AS p95 FROM r GROUP BY ROLLUP (case_type)")
def g14_retrieval_summary(spark, d):
    s = ev.summary(cases(spark, d))
    return s.withColumns({c: F.round(c, 6) for c in ("mrr", "hit_at_1", "hit_at_5", "hit_at_10", "avg_ms")})


@query(f"WITH {CASES} SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN rank <= 10 THEN 'hit' WHEN rank IS NOT NULL THEN 'below_cut' WHEN case_id % 3 = 0 THEN 'nearby_only' WHEN case_id % 5 = 0 THEN 'paper_only' ELSE 'paper_missed' END AS bucket FROM r) GROUP BY bucket")
def g18_failure_buckets(spark, d):
    c = cases(spark, d).withColumn("nearby_rank", F.when(F.col("case_id") % 3 == 0, 2)).withColumn("paper_rank", F.when(F.col("case_id") % 5 == 0, 1))
    return c.select(ev.failure().alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def events(spark, d, stream=False):
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    e = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet").load(d) if stream else spark.read.parquet(path)
    return e.withColumn("at", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q2_stream_windowed_counts(spark, d):
    """Complete mode: the whole table as a stream, also its last, still open windows."""
    return mo.drained(mo.windowed(events(spark, d, stream=True)), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE)::INT, 1) AS new FROM events)) GROUP BY user_id, s")
def q3_sessions(spark, d):
    return mo.sessions(events(spark, d)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY user_id) = 1")
def q2_stream_dedup(spark, d):
    return mo.drained(mo.deduplicated(events(spark, d, stream=True)).select("event_id", "user_id"), "append")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS at FROM events GROUP BY user_id")
def q4_latest_activity(spark, d):
    return mo.latest_activity(events(spark, d)).withColumn("at", F.col("at").cast("timestamp_ntz"))


def _sql_word(w: str) -> str:
    import re

    quoted = w.replace("'", "''")
    return f"regexp_matches(t, '(^|[^a-z0-9''-]){quoted}([^a-z0-9''-]|$)')::INT" if re.fullmatch(r"[a-z0-9'-]+", w) else f"contains(t, '{quoted}')::INT"


def _sql_score(topic: str, words: list[str]) -> str:
    one = lambda ws: "(" + " OR ".join(f"contains(t, '{w}')" for w in ws) + ")"
    total = " + ".join(_sql_word(w) for w in words if w not in li.HOSTS)
    total += " + CASE WHEN list_has_any(regexp_split_to_array(t, '\\s+'), ['pichia', 'pastoris']) AND " + one(li.PROTEINS) + " THEN 4 ELSE 0 END" if topic == "03" else ""
    total += " + CASE WHEN " + one(li.EXPRESSED) + " THEN 2 ELSE 0 END" if topic == "13" else ""
    gate = one(li.PROTEINS) + " AND " + " + ".join(_sql_word(w) for w in li.ASKED[topic]) + " > 0" if topic in li.ASKED else one(li.HOSTS)
    gate += " AND " + one(li.HOSTS) if topic == "03" else ""
    return f"{{'score': CASE WHEN {gate} THEN {total} ELSE 0 END, 'id': '{topic}'}}"


def _word_lists():
    """What the made-up titles of the classifier's query are built from: each topic's words, as one text."""
    return [" ".join(ws) for _, _, ws in li.TOPICS]


@query(
    "WITH t AS (SELECT doc_id, lower(text || ' ' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ([" + ", ".join("'" + w.replace("'", "''") + "'" for w in _word_lists()) + "])[1 + doc_id % 16] END) AS t FROM documents WHERE text IS NOT NULL), "
    "b AS (SELECT doc_id, list_max([" + ", ".join(_sql_score(i, ws) for i, _, ws in li.TOPICS) + "]) AS b FROM t) "
    "SELECT doc_id, CASE WHEN b.score > 0 THEN b.id ELSE 'other' END AS category_id, CASE WHEN b.score > 0 THEN round_even(least(0.9::DOUBLE, 0.45::DOUBLE + b.score * 0.12::DOUBLE), 2) ELSE 0.25 END::DOUBLE AS confidence FROM b"
)
def e6_classified(spark, d):
    words = F.get(F.array(*[F.lit(w) for w in _word_lists()]), (F.col("doc_id") % 16).cast("int"))
    made = F.lower(F.concat(F.col("text"), F.lit(" "), F.when(F.col("doc_id") % 3 == 0, "").otherwise(words)))
    rows = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", tx.once(made).alias("t"))
    c = rows.select("doc_id", tx.once(li.classified(F.col("t"))).alias("c"))
    return c.select("doc_id", "c.category_id", "c.confidence")
