"""Queries on query rewriting, topic groups and saved tables. Documents stand for logged queries: the last line of a text, with
one of a few phrases behind it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliant.operators import literature as li
from foliant.operators import rewriting as rw
from foliant.operators import search_index as si
from foliant.plans.literature_queries import _sql_word, _word_lists
from foliant.registry import query, table
from foliant.sources import saved as sv

PHRASES = [
    "why does LNTII accumulate in E. coli", "Which table reports the yield of 2'-FL", "lnt  versus lnnt production", "engineering strategy for the pathway", "lnt ii", "route of Escherichia coli", "what is this",
    "为什么 3-FL 产量", "compare", "LNT and lacto-N-tetraose",
]
_list = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
RAW = f"q AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), -1) || ' ' || ({_list(PHRASES)})[1 + doc_id % {len(PHRASES)}] AS raw FROM documents)"
LOW = "lower(raw)"


def logged(spark, d):
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % len(PHRASES)).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(-1)), F.lit(" "), phrase).alias("raw"))


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


def _alias(alias: str) -> str:
    import re

    key = re.sub(r"[^a-z0-9]+", " ", alias.lower()).strip()
    # No lookahead in DuckDB: `lnt` before `ii` is taken out first.
    text = "regexp_replace(s, ' lnt +ii', ' ', 'g')" if key == "lnt" else "s"
    return f"contains({text}, ' {key} ')"


ALIASES = "list_concat(" * (len(rw.ALIAS_GROUPS) - 1)
ALIASES += f"CASE WHEN {' OR '.join(_alias(a) for a in rw.ALIAS_GROUPS[0])} THEN {_list(rw.ALIAS_GROUPS[0])} ELSE [] END"
ALIASES += "".join(f", CASE WHEN {' OR '.join(_alias(a) for a in g)} THEN {_list(g)} ELSE [] END)" for g in rw.ALIAS_GROUPS[1:])
INTENTS = "list_filter([" + ", ".join(f"CASE WHEN {_any(LOW, ws)} THEN '{n}' END" for n, ws in rw.INTENTS.items()) + "], lambda x: x IS NOT NULL)"
RULES = f"{RAW}, r AS (SELECT doc_id, raw, ' ' || regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g') || ' ' AS s FROM q), x AS (SELECT doc_id, trim(raw) AS raw, {ALIASES} AS aliases, {INTENTS} AS intents, CASE WHEN {_any(LOW, rw.FOR_TABLES)} THEN 'table' ELSE 'any' END AS evidence_preference FROM r)"


@query(f"WITH {RULES} SELECT doc_id, aliases, intents, evidence_preference FROM x")
def x32_query_rules(spark, d):
    raw = F.col("raw")
    return logged(spark, d).select("doc_id", rw.aliases_in(raw).alias("aliases"), rw.intents_in(raw).alias("intents"), rw.evidence_wanted(raw).alias("evidence_preference"))


N_PRODUCTS = "len(list_filter(aliases, lambda a: a NOT IN ('E. coli', 'Escherichia coli')))"
BUILT = "list_concat(list_filter(aliases, lambda a: a NOT IN ('E. coli', 'Escherichia coli')), list_concat(list_filter(aliases, lambda a: a IN ('E. coli', 'Escherichia coli')), intents))"
REWRITTEN = f"{RULES}, n AS (SELECT *, CASE WHEN len({BUILT}) > 0 THEN array_to_string({BUILT}, ' ') ELSE raw END AS normalized_query FROM x)"


@query(f"WITH {REWRITTEN} SELECT doc_id, regexp_replace(normalized_query, '\\s+', ' ', 'g') AS normalized_query, {N_PRODUCTS} AS products, len(aliases) - {N_PRODUCTS} AS organisms FROM n")
def o15_rewritten(spark, d):
    r = rw.rewritten(logged(spark, d))
    return r.select("doc_id", F.regexp_replace("normalized_query", r"\s+", " ").alias("normalized_query"), F.size("products").alias("products"), F.size("organisms").alias("organisms"))


@query()
def x33_context_queries(spark, d):
    return rw.rewritten(logged(spark, d)).select("doc_id", rw.context_query(F.col("raw"), 6, 60).alias("query"), "variants")


@query(
    f"WITH {REWRITTEN} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 4 WHEN doc_id % 7 = 0 THEN 2 WHEN rich THEN 4 ELSE 2 END AS most, CASE WHEN doc_id % 5 = 0 THEN 'fixed' WHEN doc_id % 7 = 0 THEN 'already_compact' WHEN rich THEN 'evidence_or_structured_query' ELSE 'compact_generic_query' END AS reason "
    f"FROM (SELECT *, {_any(LOW, rw.FOR_EVIDENCE)} OR evidence_preference = 'table' OR len(aliases) > 0 AS rich FROM n)"
)
def r14_route_limit(spark, d):
    r = rw.rewritten(logged(spark, d))
    i = F.col("doc_id")
    limit = rw.route_limit(F.col("raw"), F.when(i % 5 == 0, 4).when(i % 7 == 0, 2).otherwise(4), i % 5 != 0)
    return r.select("doc_id", limit["limit"].alias("most"), limit["reason"].alias("reason"))


ITEMS = "items AS (SELECT doc_id, lower(coalesce(text, '') || ' ' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE (" + _list(_word_lists()) + ")[1 + doc_id % 16] END || CASE WHEN doc_id % 5 = 0 THEN ' lactoferrin 综述 production' ELSE '' END) AS t, CASE doc_id % 4 WHEN 0 THEN 'other' WHEN 1 THEN '05' ELSE 'new' END AS category_id, CASE WHEN doc_id % 6 = 0 THEN 'high' ELSE 'low' END AS priority FROM documents)"


def _some(words: list[str]) -> str:
    return "(" + " + ".join(_sql_word(w) for w in words) + " > 0)"


def _topic(topic: str, words: list[str]) -> str:
    signals = "(" + " + ".join(_sql_word(w) for w in words if w not in li.HOSTS) + ")"
    host, protein = _any("t", li.SHOWN_HOSTS), _any("t", li.SHOWN_PROTEINS)
    gate = f"{host} AND {protein}" if topic == "03" else f"{protein} AND {_some(li.SHOWN_ASKED[topic])}" if topic in li.SHOWN_ASKED else host
    enough = f"{signals} >= {1 if topic in ('01', '02') else 2}" + (f" AND {_some(li.SHOWN_MADE)}" if topic == "03" else "")
    if topic == "13":
        enough = f"({_some(li.SHOWN_STRONG)} OR ({signals} >= 1 AND {_some(li.SHOWN_EXPRESSED)}))"
    return f"CASE WHEN category_id = '{topic}' OR (category_id <> 'other' AND {gate} AND {enough}) THEN '{topic}' END"


TOPICS = f"{ITEMS}, tp AS (SELECT doc_id, priority, list_filter([{', '.join(_topic(i, ws) for i, _, ws in li.TOPICS)}], lambda x: x IS NOT NULL) AS topics FROM items)"


def items(spark, d):
    i = F.col("doc_id")
    words = F.get(F.array(*[F.lit(w) for w in _word_lists()]), (i % 16).cast("int"))
    text = F.lower(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.when(i % 3 == 0, "").otherwise(words), F.when(i % 5 == 0, " lactoferrin 综述 production").otherwise("")))
    rows = table(spark, d, "documents").select("doc_id", text.alias("t"), F.when(i % 4 == 0, "other").when(i % 4 == 1, "05").otherwise("new").alias("category_id"), F.when(i % 6 == 0, "high").otherwise("low").alias("priority"))
    return rows.select("doc_id", F.col("doc_id").cast("string").alias("candidate_id"), "priority", li.topic_ids(F.col("t"), F.col("category_id")).alias("topics"))


@query(f"WITH {TOPICS} SELECT doc_id, topics FROM tp")
def f12_topics_of_items(spark, d):
    return items(spark, d).select("doc_id", "topics")


@query(f"WITH {TOPICS}, s AS (SELECT priority, unnest(topics) AS topic_id FROM tp) SELECT topic_id, count(*) FILTER (priority IS NOT NULL) AS hit_count, count(*) FILTER (priority = 'high') AS high_count FROM (SELECT unnest({_list([i for i, _, _ in li.TOPICS])}) AS topic_id) LEFT JOIN s USING (topic_id) GROUP BY topic_id")
def j7_topic_groups(spark, d):
    return li.topic_groups(items(spark, d))


@query(f"WITH {TOPICS}, s AS (SELECT doc_id, unnest(topics) AS topic_id FROM tp) SELECT count(*) AS display_count, count(DISTINCT doc_id) AS unique_count, count(DISTINCT topic_id) AS hit_category_count, greatest(count(*) - count(DISTINCT doc_id), 0) AS duplicate_count FROM s")
def g7_brief_summary(spark, d):
    return li.topic_summary(items(spark, d))


def _folder(spark) -> str:
    return f"{si.scratch(spark)}/saved-{uuid.uuid4().hex}"


@query("SELECT s_suppkey, s_name, s_acctbal, CASE WHEN s_suppkey % 3 = 0 THEN 'seen' ELSE 'new' END AS status FROM supplier")
def k9_replaced_table(spark, d):
    """A table written, read, changed and written in its own place."""
    at = f"{_folder(spark)}/candidates"
    sv.replaced(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal", F.lit("new").alias("status")), at)
    schema = "s_suppkey long, s_name string, s_acctbal double, status string"
    sv.replaced(sv.lines(spark, at, schema).withColumn("status", F.when(F.col("s_suppkey") % 3 == 0, "seen").otherwise(F.col("status"))), at)
    return sv.lines(spark, at, schema)


@query("SELECT event_type, count(*) AS n, 'first' AS run FROM events GROUP BY event_type UNION ALL SELECT event_type, count(*), 'second' FROM events WHERE value > 50 GROUP BY event_type")
def k10_run_log(spark, d):
    """Two runs append their summaries to one log; a torn and a blank line are left out."""
    at, e = f"{_folder(spark)}/runs", table(spark, d, "events")
    for run, rows in (("first", e), ("second", e.filter("value > 50"))):
        sv.appended(rows.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("run", F.lit(run)), at)
    spark.createDataFrame([('{"event_type": "torn", "n": ',), ("",)], "value string").write.mode("append").text(at)
    return sv.lines(spark, at, "event_type string, n long, run string")


@query("SELECT r_name AS file_stem, r_name || '.pdf' AS filename, '2024' AS saved_at, 'Paper ' || r_regionkey AS paper_title, '?' AS category, CAST(r_regionkey AS DOUBLE) AS credibility, n AS total_chunks, n AS passed, 0 AS failed FROM region JOIN (SELECT n_regionkey AS r_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) USING (r_regionkey)")
def s21_snapshots(spark, d):
    """A snapshot for each region, saved once: a second save under the name of the first changes nothing."""
    at = _folder(spark)
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"))
    rows = table(spark, d, "region").join(n, "r_regionkey")
    quality = F.struct(F.concat(F.lit("Paper "), F.col("r_regionkey").cast("string")).alias("paper_title"), F.col("r_regionkey").cast("double").alias("credibility"))
    made = rows.select("r_name", F.concat("r_name", F.lit(".pdf")).alias("filename"), F.lit("2024").alias("saved_at"), quality.alias("quality"), F.struct(F.col("n").alias("total"), F.col("n").alias("passed")).alias("stats"))
    for r in rows.select("r_name").collect():  # five regions, a snapshot each
        one = made.filter(F.col("r_name") == r["r_name"]).drop("r_name")
        sv.snapshot_saved(one.coalesce(1), at, r["r_name"])
        sv.snapshot_saved(one.coalesce(1).withColumn("saved_at", F.lit("later")), at, r["r_name"])
    sv.snapshot_saved(rows.limit(1).select(F.lit("x").alias("filename")), at, "gone")
    sv.deleted(spark, f"{at}/gone.json")
    spark.createDataFrame([("not json",)], "value string").coalesce(1).write.text(f"{at}/broken.json")
    return sv.snapshots(spark, at).drop("classify_status", "paper_summary", "target_products", "organisms")


@query("SELECT conv_id, turn, role FROM conversations")
def s19_document_table(spark, d):
    """Monitors as one JSON document, read by an explicit schema; a missing document is an empty table."""
    at = f"{_folder(spark)}/monitors.json"
    rows = table(spark, d, "conversations").select(F.struct("conv_id", "turn", "role").alias("x"))
    rows.coalesce(1).agg(F.to_json(F.struct(F.collect_list("x").alias("monitors"))).alias("value")).write.text(at)
    schema = "conv_id long, turn long, role string"
    return sv.document_table(spark, at, "monitors", schema).unionByName(sv.document_table(spark, f"{at}.none", "monitors", schema))


@query("SELECT event_type, count(*)::VARCHAR AS n, to_json({'least': round(min(value), 3), 'most': round(max(value), 3)})::VARCHAR AS bounds FROM events GROUP BY event_type")
def k14_report_files(spark, d):
    """A report written as JSON and as CSV, read back from the CSV."""
    at = _folder(spark)
    bounds = F.struct(F.round(F.min("value"), 3).alias("least"), F.round(F.max("value"), 3).alias("most")).alias("bounds")
    sv.report_written(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), bounds), at)
    return spark.read.option("header", "true").option("escape", "\\").csv(f"{at}/csv").select("event_type", "n", "bounds")
