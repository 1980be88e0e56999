"""Queries about functions, projections, counts and orders: documents stand for chunks, hits and papers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import splitting as sp
from foliant.functions import text as tx
from foliant.operators import layout as lo
from foliant.operators import literature as li
from foliant.operators import retrieval as rt
from foliant.operators import search_index as si
from foliant.plans.retrieval_queries import ENTRIES, NORM, TOKENS, index
from foliant.registry import query, table

SPACED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def docs(spark, d, *columns):
    return table(spark, d, "documents").select("doc_id", *(columns or ("text", "source", "lang", "n_chars")))


def labelled(spark, d):
    return docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")


@query(r"SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(substr(text, 1, 120), '\s\S*$', '') END AS clipped FROM documents")
def x11_clipped(spark, d):
    return docs(spark, d).select("doc_id", tx.clip(F.col("text"), 120).alias("clipped"))


@query(f"SELECT doc_id, CASE WHEN s <> '' THEN trim(s) ELSE trim(substr(t, 1, 260)) END AS sentence FROM (SELECT doc_id, t, regexp_extract(t, '(.{{20,260}}?[。.!?])(?:\\s|$)', 1) AS s FROM (SELECT doc_id, {SPACED} AS t FROM documents))")
def x12_first_sentence(spark, d):
    return docs(spark, d).select("doc_id", tx.first_sentence(F.col("text")).alias("sentence"))


@query("SELECT doc_id, '10.1101/abc.' || doc_id AS doi, CAST(doc_id AS VARCHAR) AS pmid, 'PMC' || doc_id AS pmcid, 'W' || doc_id AS openalex_id, CASE WHEN doc_id % 2 = 0 THEN 2000 + doc_id % 20 END::INT AS year FROM documents")
def x13_identifiers(spark, d):
    n = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://doi.org/10.1101/ABC."), n, F.lit("."))).otherwise(F.concat(F.lit("doi: 10.1101/abc."), n))
    year = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Spring "), (2000 + F.col("doc_id") % 20).cast("string"))).otherwise("no year")
    return docs(spark, d).select("doc_id", tx.doi(raw).alias("doi"), tx.digits(F.concat(F.lit("PMID:"), n)).alias("pmid"), tx.pmcid(F.concat(F.lit("pmc"), n)).alias("pmcid"), tx.openalex_id(F.concat(F.lit("https://x.org/w"), n)).alias("openalex_id"), tx.year(year).alias("year"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS content FROM pages")
def x15_stripped_tags(spark, d):
    return table(spark, d, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("content"))


@query("SELECT doc_id, list_filter(list_transform(regexp_split_to_array(source || ' and ' || lang || '; ' || doc_id, ';|\\band\\b'), lambda x: trim(x)), lambda x: x <> '') AS authors FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def x18_authors(spark, d):
    t = docs(spark, d).filter("lang IS NOT NULL AND source IS NOT NULL")
    return t.select("doc_id", tx.authors(F.concat(F.col("source"), F.lit(" and "), F.col("lang"), F.lit("; "), F.col("doc_id").cast("string"))).alias("authors"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '-' WHEN n_chars < 60 THEN printf('%.1fs', n_chars::DOUBLE) ELSE printf('%dm%02ds', n_chars // 60, n_chars % 60) END AS took FROM documents WHERE n_chars > 0")
def x20_duration(spark, d):
    seconds = F.when(F.col("doc_id") % 9 != 0, F.col("n_chars").cast("double"))
    return docs(spark, d).filter("n_chars > 0").select("doc_id", tx.duration(seconds).alias("took"))


@query("SELECT page_id, substr(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), 1, 80) || '_' || substr(sha256(url), 1, 12) AS name FROM pages")
def x22_safe_name(spark, d):
    return table(spark, d, "pages").select("page_id", F.concat(tx.safe_name(F.col("url")), F.lit("_"), F.substring(F.sha2("url", 256), 1, 12)).alias("name"))


@query("SELECT doc_id, '{\"id\": ' || doc_id || '}' AS answer FROM documents")
def x28_json_object(spark, d):
    answer = F.concat(F.lit('Sure:\n```json\n{"id": '), F.col("doc_id").cast("string"), F.lit("}\n```"))
    return docs(spark, d).select("doc_id", tx.json_object(answer).alias("answer"))


@query()
def x30_split_texts(spark, d):
    return sp.split(docs(spark, d, "text"), "text").drop("text")


@query("WITH s AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY term) SELECT term, df, round(1 + ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)), 6) AS idf FROM s")
def x35_log_idf(spark, d):
    t = docs(spark, d)
    n = t.agg(F.count("*").alias("n"))
    df = t.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # One row: the corpus size, which the plan sends along without a collect.
    return df.join(F.broadcast(n)).select("term", "df", F.round(1 + F.log((F.col("n") + 1) / (F.col("df") + 1)), 6).alias("idf"))


@query("SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9''-])the([^A-Za-z0-9''-]|$)') AS has_word, contains(text, 'der die') AS has_phrase FROM documents")
def f10_word_in_text(spark, d):
    return docs(spark, d).select("doc_id", tx.word_in(F.col("text"), "the").alias("has_word"), tx.word_in(F.col("text"), "der die").alias("has_phrase"))


@query("SELECT doc_id FROM documents WHERE source IN ('src0', 'src1') AND coalesce(lang, '') <> 'de' AND contains(lower(text), 'the')")
def f6_library_filter(spark, d):
    return docs(spark, d).filter(F.arrays_overlap(F.array("source"), F.array(F.lit("src0"), F.lit("src1"))) & (F.coalesce("lang", F.lit("")) != "de") & F.contains(F.lower("text"), F.lit("the"))).select("doc_id")


@query("SELECT doc_id, doc_id % 3 = 0 OR doc_id % 4 = 0 OR doc_id % 5 <> 0 AS due FROM documents")
def f8_due_monitors(spark, d):
    at = F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 4 == 0, "soon").when(F.col("doc_id") % 5 != 0, "2024-01-01T00:00:00").otherwise("2031-01-01T00:00:00")
    return docs(spark, d).select("doc_id", li.due(at, F.lit("2025-01-01 00:00:00").cast("timestamp")).alias("due"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 3 = 2 OR text IS NULL")
def f13_needs_translation(spark, d):
    """Never translated, translated from another text, or translated from this one."""
    stored = F.when(F.col("doc_id") % 3 == 1, li.source_hash(F.col("text"))).when(F.col("doc_id") % 3 == 2, li.source_hash(F.concat("text", F.lit(" once"))))
    return docs(spark, d).filter(li.needs_translation(stored, F.col("text"))).select("doc_id")


@query("SELECT doc_id, score FROM (SELECT doc_id, n_chars % 1000 / 1000.0::DOUBLE AS score FROM documents) ORDER BY score DESC, doc_id LIMIT 20")
def t1_top_by_score(spark, d):
    return docs(spark, d).select("doc_id", (F.col("n_chars") % 1000 / 1000).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query("SELECT doc_id, row_number() OVER (ORDER BY (lang IS NULL OR lang <> 'en')::INT, n_chars DESC, doc_id) AS place FROM documents ORDER BY place LIMIT 100")
def t3_candidate_order(spark, d):
    order = [(F.col("lang").isNull() | (F.col("lang") != "en")).cast("int"), F.desc("n_chars"), F.col("doc_id")]
    top = docs(spark, d).orderBy(*order).limit(100)
    return top.select("doc_id", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("SELECT conv_id, turn, row_number() OVER w - 1 AS chunk_index, count(*) OVER (PARTITION BY conv_id) AS chunk_count, round((row_number() OVER w - 1) / greatest(count(*) OVER (PARTITION BY conv_id) - 1, 1)::DOUBLE, 6) AS relative_position FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def w13_relative_position(spark, d):
    w = Window.partitionBy("conv_id")
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy("turn")) - 1
    return table(spark, d, "conversations").select("conv_id", "turn", i.alias("chunk_index"), n.alias("chunk_count")).withColumn("relative_position", F.round(F.col("chunk_index") / F.greatest(F.col("chunk_count") - 1, F.lit(1)), 6))


@query("SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def w7_distinct_first(spark, d):
    return docs(spark, d, "source", "lang").groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id")
def w21_latest_wins(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn"))


@query("SELECT source, count(*) AS shown, count(DISTINCT md5(text)) AS distinct_texts, count(*) - count(DISTINCT md5(text)) AS duplicates FROM documents GROUP BY source")
def g7_topic_summary(spark, d):
    g = docs(spark, d).groupBy("source").agg(F.count("*").alias("shown"), F.countDistinct(F.md5("text")).alias("distinct_texts"))
    return g.withColumn("duplicates", F.col("shown") - F.col("distinct_texts"))


@query("SELECT source, count(*) FILTER (quality = 1) AS kept, count(*) FILTER (quality IS DISTINCT FROM 1) AS skipped FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def g9_filter_summary(spark, d):
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    return labelled(spark, d).groupBy("source").agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("skipped"))


@query("SELECT count(*) AS n, count(DISTINCT source) AS papers FROM documents")
def g11_corpus_size(spark, d):
    return docs(spark, d).agg(F.count("*").alias("n"), F.countDistinct("source").alias("papers"))


@query("SELECT source, round(avg(n_chars), 4) AS mean, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95 FROM documents GROUP BY source")
def g16_latencies(spark, d):
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n_chars)")
    return docs(spark, d).groupBy("source").agg(F.round(F.avg("n_chars"), 4).alias("mean"), disc(0.5).cast("long").alias("p50"), disc(0.95).cast("long").alias("p95"))


@query("SELECT quality, toxic, count(*) AS n, round_even(avg((quality = toxic)::INT), 4) AS agreement FROM labels GROUP BY quality, toxic")
def g22_judge_agreement(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.bround(F.avg((F.col("quality") == F.col("toxic")).cast("int")), 4).alias("agreement"))


@query("SELECT user_id, event_type, max(value) AS most FROM events GROUP BY user_id, event_type")
def g28_largest_per_key(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("most"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 50")
def g29_keyword_counts(spark, d):
    words = docs(spark, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query("SELECT source, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality = 0) AS failed, count(*) FILTER (quality IS NULL) AS missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def g31_verdict_counts(spark, d):
    q = F.col("quality")
    return labelled(spark, d).groupBy("source").agg(F.count_if(q == 1).alias("passed"), F.count_if(q == 0).alias("failed"), F.count_if(q.isNull()).alias("missing"))


@query("SELECT doc_id, round_even(n_chars / 7.0::DOUBLE, 4) AS score, coalesce(lang, 'unknown') AS lang FROM documents")
def p2_result_rows(spark, d):
    return docs(spark, d).select("doc_id", F.bround(F.col("n_chars") / 7, 4).alias("score"), F.coalesce("lang", F.lit("unknown")).alias("lang"))


@query("SELECT doc_id, 'Chapter ' || (doc_id // 200) || ' (' || source || ', ' || doc_id || ')' AS citation FROM documents")
def p13_citations(spark, d):
    return docs(spark, d).select("doc_id", F.concat(F.lit("Chapter "), F.floor(F.col("doc_id") / 200).cast("string"), F.lit(" ("), F.col("source"), F.lit(", "), F.col("doc_id").cast("string"), F.lit(")")).alias("citation"))


@query("SELECT doc_id, list_sort(list_distinct([source, coalesce(lang, 'none')] || [source])) AS sources FROM documents WHERE source IS NOT NULL")
def d8_merged_sets(spark, d):
    return docs(spark, d).filter("source IS NOT NULL").select("doc_id", F.array_sort(F.array_union(F.array("source", F.coalesce("lang", F.lit("none"))), F.array("source"))).alias("sources"))


@query("SELECT doc_id, len(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda w: w <> ''), lambda w: lower(w)))) AS n FROM documents")
def d7_distinct_words(spark, d):
    return docs(spark, d).select("doc_id", F.size(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1), lambda w: F.lower(w)))).alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)")
def j5_context_minus_returned(spark, d):
    t = docs(spark, d)
    got = t.join(table(spark, d, "labels").select("doc_id"), "doc_id").select(F.col("doc_id").alias("got"), F.md5("text").alias("h"))
    rest = t.join(got.select("got"), F.col("doc_id") == F.col("got"), "left_anti").withColumn("key", F.md5("text"))
    return rest.filter("key IS NOT NULL").join(got.select("h").filter("h IS NOT NULL").distinct(), F.col("key") == F.col("h"), "left_anti").select("doc_id")


@query(
    f"WITH {ENTRIES}, t AS (SELECT id, unnest({TOKENS}) AS term FROM entries), f AS (SELECT term, count(*) AS df FROM t GROUP BY term), "
    f"q AS (SELECT item_id, unnest({TOKENS}) AS term FROM (SELECT item_id, {NORM} AS normalized FROM benchmark)) SELECT item_id, term, df FROM q JOIN f USING (term)"
)
def j13_postings(spark, d):
    """Each item's terms with the documents that hold them."""
    items = si.normalized(table(spark, d, "benchmark"))
    return rt.matched_terms(items, index(spark, d).postings, "item_id")


@query("SELECT doc_id, coalesce(quality, -1) AS quality, CASE WHEN toxic = 1 THEN 'skipped' WHEN quality = 1 THEN 'restored' ELSE 'candidate' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def j14_decisions_back(spark, d):
    status = F.when(F.col("toxic") == 1, "skipped").when(F.col("quality") == 1, "restored").otherwise("candidate")
    return labelled(spark, d).select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), status.alias("status"))


@query("SELECT a.doc_id, min(b.doc_id) AS earlier FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) AND b.doc_id < a.doc_id GROUP BY a.doc_id")
def j18_same_hash_earlier(spark, d):
    # The first of a group is earlier than all others: an aggregate in a window instead of pairs within the group.
    t = docs(spark, d).filter("text IS NOT NULL").select("doc_id", F.md5("text").alias("h"))
    return t.withColumn("earlier", F.min("doc_id").over(Window.partitionBy("h"))).filter("earlier < doc_id").select("doc_id", "earlier")


@query("WITH c AS (SELECT doc_id % 200 AS id, doc_id, text FROM documents) SELECT id, max(doc_id) AS doc_id, count(DISTINCT sha1(text)) > 1 AS changed FROM c GROUP BY id")
def e4_changed(spark, d):
    t = docs(spark, d).select((F.col("doc_id") % 200).alias("id"), "doc_id", F.sha1(F.col("text").cast("binary")).alias("h"))
    return t.groupBy("id").agg(F.max("doc_id").alias("doc_id"), (F.min("h") < F.max("h")).alias("changed")).withColumn("changed", F.coalesce("changed", F.lit(False)))


@query("SELECT doc_id, CASE WHEN s >= 38 THEN 'high' WHEN s >= 18 THEN 'medium' ELSE 'low' END AS priority FROM (SELECT doc_id, doc_id % 60 AS s FROM documents)")
def e11_priority_label(spark, d):
    return docs(spark, d).select("doc_id", li.priority_label(F.col("doc_id") % 60).alias("priority"))


@query("SELECT max(ts) AS latest, date_trunc('day', max(ts) + INTERVAL 8 HOUR) = date_trunc('day', TIMESTAMP '2024-01-02 00:00:00') AS is_today FROM events")
def e17_fetched_today(spark, d):
    e = table(spark, d, "events").agg(F.max("ts").alias("latest"))
    return e.withColumn("is_today", F.expr("date_trunc('day', latest + INTERVAL 8 HOUR) = TIMESTAMP_NTZ '2024-01-02 00:00:00'"))


@query("SELECT doc_id, source AS paper_id, lang FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT doc_id, source, 'xx' FROM documents WHERE doc_id % 10 = 3")
def k11_replaced_by_id(spark, d):
    t = docs(spark, d).select("doc_id", F.col("source").alias("paper_id"), "lang")
    new = t.filter("doc_id % 10 = 3").withColumn("lang", F.lit("xx"))
    return t.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)


@query("SELECT doc_id, n, upper(line) = line AND regexp_matches(line, '[A-Z]') AND length(line) <= 80 OR regexp_matches(line, '^[0-9]+(\\.[0-9]+)*\\.?\\s+\\S') AS is_heading FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)")
def f4_headings(spark, d):
    line = F.col("line")
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)
    capital = (F.upper(line) == line) & line.rlike("[A-Z]") & (F.length(line) <= 80)
    return lines.select("doc_id", "n", (capital | line.rlike(r"^[0-9]+(\.[0-9]+)*\.?\s+\S")).alias("is_heading"))


GRAMS = "list_distinct(CASE WHEN short THEN CASE WHEN length({0}) < 3 THEN list_filter(string_split(trim({0}), ''), lambda x: x <> '') ELSE list_transform(range(1, length({0})), lambda i: substr(' ' || {0} || ' ', i, 3)) END ELSE w{0} END)"


@query(
    r"WITH c AS (SELECT conv_id, turn, lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS a, lower(coalesce(text, '')) AS b FROM conversations), "
    r"w AS (SELECT *, list_filter(regexp_split_to_array(a, '\s+'), lambda x: x <> '') AS wa, list_filter(regexp_split_to_array(b, '\s+'), lambda x: x <> '') AS wb FROM c WHERE a IS NOT NULL), "
    f"g AS (SELECT *, {GRAMS.format('a')} AS x, {GRAMS.format('b')} AS y FROM (SELECT *, len(wa) < 10 OR len(wb) < 10 AS short FROM w)) "
    "SELECT conv_id, turn, round(CASE WHEN a = '' OR b = '' THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END, 6) AS similarity FROM g"
)
def x27_similarity(spark, d):
    """Texts of neighbours in a conversation, by words or character 3-grams."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("before", F.lag("text").over(w)).filter("before IS NOT NULL")
    return c.select("conv_id", "turn", F.round(lo.similarity(F.col("before"), F.col("text")), 6).alias("similarity"))
