"""Queries on the fields of stored chunks and on landed answers of literature services."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import payload as pl
from foliant.functions import text as tx
from foliant.operators import reports as rp
from foliant.plans.retrieval_queries import ENTRIES, QUERY, TERMS, TOKENS, entries
from foliant.plans.store_queries import CHUNKS, chunks
from foliant.registry import query, table
from foliant.sources import literature as so



def key():
    return F.col("doc_id").cast("string")


def docs(spark, d, *columns):
    return table(spark, d, "documents").select("doc_id", *(columns or ("text", "source", "lang", "n_chars")))


@query("SELECT doc_id, source, lang, n_chars FROM documents")
def s1_full_scan(spark, d):
    return docs(spark, d, "source", "lang", "n_chars")


@query(f"WITH {ENTRIES} SELECT id, paper_id, length(normalized) AS n FROM entries WHERE normalized <> ''")
def s3_document_entries(spark, d):
    return entries(spark, d).filter("normalized <> ''").select("id", "paper_id", F.length("normalized").alias("n"))


@query(f"WITH {CHUNKS} SELECT id, page, 'image placeholder on page ' || page AS content FROM chunks WHERE content_type = 'image'")
def s12_image_placeholders(spark, d):
    return chunks(spark, d).filter("content_type = 'image'").select("id", "page", F.concat(F.lit("image placeholder on page "), F.col("page").cast("string")).alias("content"))


def landed(spark, d, **fields):
    return docs(spark, d).select(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("value"))


COMMON = ("external_id", "title", "doi", "published_date", "is_open_access")


@query("SELECT doc_id::VARCHAR AS external_id, 'Paper ' || doc_id AS title, '10.1101/abc.' || doc_id AS doi, '2024-01-05' AS published_date, doc_id % 2 = 0 AS is_open_access FROM documents")
def s14_europe_pmc(spark, d):
    return so.europe_pmc(landed(spark, d, id=key(), title=F.concat(F.lit("<b>Paper</b> "), key()), doi=F.concat(F.lit("https://doi.org/10.1101/ABC."), key()), firstPublicationDate=F.lit("2024-01-05"), isOpenAccess=F.when(F.col("doc_id") % 2 == 0, "Y").otherwise("N"))).select(*COMMON)


@query("SELECT 'https://x.org/W' || doc_id AS external_id, 'Paper ' || doc_id AS title, 'alpha beta alpha' AS abstract, 'W' || doc_id AS openalex_id FROM documents")
def s15_openalex(spark, d):
    index = F.from_json(F.lit('{"beta": [1], "alpha": [0, 2]}'), "map<string,array<int>>")
    return so.openalex(landed(spark, d, id=F.concat(F.lit("https://x.org/W"), key()), display_name=F.concat(F.lit("Paper "), key()), abstract_inverted_index=index)).select("external_id", "title", "abstract", "openalex_id")


@query("SELECT '10.1101/' || doc_id AS external_id, 'https://www.biorxiv.org/content/10.1101/' || doc_id || 'v2' AS landing_url, ['Ann A', 'Bob B'] AS authors FROM documents")
def s16_preprints(spark, d):
    return so.preprints(landed(spark, d, doi=F.concat(F.lit("10.1101/"), key()), title=F.lit("T"), version=F.lit("2"), authors=F.lit("Ann A; Bob B")), "biorxiv").select("external_id", "landing_url", "authors")


@query("SELECT '10.1/x' || doc_id AS external_id, 'Paper ' || doc_id AS title, CASE doc_id % 3 WHEN 0 THEN '2021-03-04' WHEN 1 THEN '2021-03' ELSE '2021' END AS published_date FROM documents")
def s17_crossref(spark, d):
    day = F.struct(F.array(F.slice(F.array(F.lit(2021), F.lit(3), F.lit(4)), F.lit(1), (3 - F.col("doc_id") % 3).cast("int"))).alias("date-parts"))
    return so.crossref(landed(spark, d, DOI=F.concat(F.lit("10.1/x"), key()), title=F.array(F.concat(F.lit("Paper "), key())), issued=day)).select("external_id", "title", "published_date")


@query("SELECT 'europe_pmc' AS source, count(*) AS n FROM documents UNION ALL SELECT 'biorxiv', count(*) FROM documents")
def s18_united_sources(spark, d):
    a = so.europe_pmc(landed(spark, d, id=key(), title=F.lit("T")))
    b = so.preprints(landed(spark, d, doi=F.concat(F.lit("10.1101/"), key()), title=F.lit("T")), "biorxiv")
    return so.united(a, b).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'word' || doc_id || ' then word' || doc_id AS abstract FROM documents")
def x16_inverted_index(spark, d):
    index = F.map_from_arrays(F.array(F.concat(F.lit("word"), key()), F.lit("then")), F.array(F.array(F.lit(0), F.lit(2)), F.array(F.lit(1))))
    return docs(spark, d).select("doc_id", tx.from_inverted_index(index).alias("abstract"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '03' WHEN 1 THEN '11' WHEN 2 THEN '07' ELSE '' END AS month FROM documents")
def x17_month_number(spark, d):
    value = F.element_at(F.array(F.lit("March"), F.lit("nov"), F.lit("7"), F.lit("Spring")), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, d).select("doc_id", so.month_number(value).alias("month"))


@query("SELECT event_id, ((ts + INTERVAL 8 HOUR)::DATE = (TIMESTAMP '2024-01-03 20:00:00' + INTERVAL 8 HOUR)::DATE) AS same FROM events")
def x19_same_day(spark, d):
    return table(spark, d, "events").select("event_id", pl.same_day(F.col("ts"), F.lit("2024-01-03 20:00:00").cast("timestamp_ntz")).alias("same"))


@query(r"SELECT doc_id, doc_id % 9 AS page, CASE WHEN doc_id % 2 = 0 THEN 1 END AS col, -doc_id / 4 AS y, 12.5::DOUBLE AS x FROM documents WHERE doc_id % 5 > 0")
def x23_chunk_location(spark, d):
    n = F.col("doc_id")
    y = F.format_string("%.2f", -n / 4)
    name = F.concat(F.lit("paper_p"), (n % 9).cast("string"), F.when(n % 2 == 0, "_col1").otherwise(""), F.lit("_y"), y, F.lit("_x12.5"))
    rows = docs(spark, d).select("doc_id", pl.chunk_location(F.when(n % 5 == 0, "no place").otherwise(name)).alias("at"))
    return rows.filter("at IS NOT NULL").select("doc_id", F.col("at.page").cast("long").alias("page"), F.col("at.col").alias("col"), "at.y", "at.x")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id WHEN 1 THEN -doc_id END AS whole, CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id > 0 THEN doc_id::DOUBLE END WHEN 2 THEN doc_id + 0.5::DOUBLE END AS positive FROM documents")
def x24_numbers(spark, d):
    n = F.col("doc_id")
    value = F.when(n % 4 == 0, key()).when(n % 4 == 1, (-n).cast("string")).when(n % 4 == 2, F.concat(key(), F.lit(".5"))).otherwise("none")
    return docs(spark, d).select("doc_id", pl.whole_number(value).alias("whole"), pl.positive_number(value).alias("positive"))


@query("SELECT doc_id, ['E. coli', 'lacto', CAST(doc_id AS VARCHAR)] AS items FROM documents")
def x7_list(spark, d):
    return docs(spark, d).select("doc_id", tx.split_list(F.concat(F.lit("E. coli, lacto;|"), key())).alias("items"))


@query("SELECT doc_id, ['Alpha', 'Beta', 'n' || doc_id] AS items FROM documents")
def x3_distinct_text(spark, d):
    items = F.array(F.lit("Alpha "), F.lit("Beta"), F.lit("alpha"), F.lit(" "), F.concat(F.lit("n"), key()), F.concat(F.lit("N"), key()))
    return docs(spark, d).select("doc_id", tx.distinct_text(items).alias("items"))


@query("SELECT doc_id, 'E. coli Escherichia coli makes LNnT lacto-N-neotetraose ' || doc_id AS spelt FROM documents")
def x1_aliases(spark, d):
    return docs(spark, d).select("doc_id", tx.expand_aliases(F.concat(F.lit("e. coli makes lnnt "), key())).alias("spelt"))


@query(f"SELECT term, weight FROM (VALUES {TERMS}) AS t(term, weight)")
def x8_query_terms(spark, d):
    return spark.createDataFrame(sorted(tx.query_terms(QUERY).items()), "term string, weight double")


@query(f"WITH {ENTRIES} SELECT id, list_sort({TOKENS}) AS terms FROM entries")
def x9_index_terms(spark, d):
    return entries(spark, d).select("id", F.array_sort(tx.index_terms(F.col("normalized"))).alias("terms"))


@query("SELECT doc_id, 'Strain report ' || doc_id || ' final' AS title FROM documents")
def x4_clean_title(spark, d):
    return docs(spark, d).select("doc_id", pl.rerank_title(F.concat(F.lit("/data/Strain_report_"), key(), F.lit("(from ablesci.com)_final.pdf"))).alias("title"))


CLEANED = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\[[^\]]+\]', ' ', 'g'), '\b(text|table|image)\s*\|\s*chunk\s+\d+(/\d+)?|\b(biosynthesis_review|fermentation_experiment)\b', ' ', 'gi'), '\b(pdf|text|chunk)\b', ' ', 'gi'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5(concat_ws(chr(10), 'P ' || doc_id, nullif(source, ''), nullif({CLEANED}, ''))) AS h FROM documents")
def x5_rerank_text(spark, d):
    text = pl.rerank_text(F.lit(""), F.concat(F.lit("P_"), key(), F.lit(".pdf")), [F.array("source")], [F.col("text")])
    return docs(spark, d).select("doc_id", F.md5(text).alias("h"))


@query(r"SELECT doc_id, '| a | b\|c |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' |  |' AS md FROM documents")
def x29_html_markdown(spark, d):
    html = F.concat(F.lit("<table><TR><th>a</th><th> b|c </th></tr><tr><td> </td></tr><tr class='x'><td><i>"), key(), F.lit("</i></td></tr></table>"))
    return docs(spark, d).select("doc_id", pl.html_markdown(html).alias("md"))


@query("SELECT doc_id, [['a', 'b'], ['1', doc_id::VARCHAR]] AS m FROM documents")
def u15_markdown_rows(spark, d):
    return docs(spark, d).select("doc_id", pl.markdown_matrix(F.concat(F.lit("Here:\n| a | b |\n|---|:--|\n| 1 | "), key(), F.lit(" |\nend"))).alias("m"))


@query("SELECT doc_id, 'Table ' || doc_id || chr(10) || 'Yields' || chr(10) || 'a; b' || chr(10) || '1; 2 ± 3' AS t FROM documents")
def x31_table_text(spark, d):
    return docs(spark, d).select("doc_id", pl.table_text(F.lit("| a | b |\n| --- | :--- |\n| 1 | 2 (cid:8) 3 |\n| - | |\n| a | b |"), F.lit("Yields"), F.concat(F.lit("Table "), key())).alias("t"))


@query("SELECT doc_id, 'a-b-' || doc_id AS slug, 'My paper ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'Supplementary Table S' ELSE 'Table ' END || doc_id AS number FROM documents")
def x34_slug_title_number(spark, d):
    caption = F.concat(F.when(F.col("doc_id") % 2 == 0, "supplementary  table s").otherwise("see tab. "), key(), F.lit(" shows"))
    return docs(spark, d).select("doc_id", pl.slug(F.concat(F.lit("--A b/"), key(), F.lit("!"))).alias("slug"), pl.clean_title(F.concat(F.lit("x/My_paper-"), key(), F.lit(".pdf"))).alias("title"), pl.table_label(caption).alias("number"))


@query("SELECT doc_id, coalesce(NULL, source) AS paper_title, CASE WHEN toxic = 1 THEN 'x' END AS category, 'done' AS enrichment_status FROM documents LEFT JOIN labels USING (doc_id)")
def p5_paper_payload(spark, d):
    rows = docs(spark, d).join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.select("doc_id", tx.first_filled(F.lit(None).cast("string"), F.col("source")).alias("paper_title"), F.when(F.col("toxic") == 1, "x").alias("category"), F.lit("done").alias("enrichment_status"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN md5('ctx' || chr(10) || chr(10) || coalesce(text, '')) ELSE md5(coalesce(text, '')) END AS h FROM documents")
def p6_content_with_context(spark, d):
    context = F.when(F.col("doc_id") % 2 == 0, "ctx")
    return docs(spark, d).select("doc_id", F.md5(F.concat_ws("\n\n", context, F.coalesce("text", F.lit("")))).alias("h"))


@query(f"WITH {CHUNKS} SELECT id, md5(CASE content_type WHEN 'image' THEN 'A figure' || chr(10) || chr(10) || 'Figure ' || id || CASE WHEN text <> '' THEN chr(10) || chr(10) || text ELSE '' END WHEN 'table' THEN 'tab' ELSE coalesce(text, '') END) AS h FROM chunks")
def p7_embedding_text(spark, d):
    text = pl.embedding_text(F.col("content_type"), F.coalesce("text", F.lit("")), F.lit(" A figure "), F.concat(F.lit("Figure "), F.col("id").cast("string")), F.lit(" "), F.lit("tab"))
    return chunks(spark, d).select("id", F.md5(text).alias("h"))


@query(f"WITH {CHUNKS} SELECT id, CASE content_type WHEN 'table' THEN 'table numeric evidence' WHEN 'image' THEN CASE WHEN id % 2 = 0 THEN 'figure chart evidence' ELSE 'figure visual evidence' END ELSE 'text evidence' END AS evidence_type, 'Results' AS section, 'Results | Cap | ' || CASE content_type WHEN 'table' THEN 'table numeric evidence' WHEN 'image' THEN CASE WHEN id % 2 = 0 THEN 'figure chart evidence' ELSE 'figure visual evidence' END ELSE 'text evidence' END AS anchor_text FROM chunks")
def p4_annotations(spark, d):
    none = F.lit("")
    kind = F.when(F.col("id") % 2 == 0, "chart")
    a = pl.annotations(F.col("paper_id"), F.col("content_type"), kind, F.col("text"), [none, F.lit("Results ")], [none, none, F.lit("Cap"), none], F.array(F.lit("Cap")), F.array(none))
    return chunks(spark, d).select("id", tx.once(a).alias("a")).select("id", "a.evidence_type", "a.section", "a.anchor_text")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '高' WHEN 1 THEN '中' WHEN 2 THEN '低' ELSE 'none' END AS priority, CASE doc_id % 3 WHEN 0 THEN '规则初判' WHEN 1 THEN '未分类' ELSE 'other' END AS classified, CASE doc_id % 3 WHEN 0 THEN '否' WHEN 1 THEN '是' ELSE '可尝试' END AS importable, CASE doc_id % 3 WHEN 0 THEN '已翻译' WHEN 1 THEN '待翻译' ELSE '无摘要' END AS translated FROM documents")
def p10_labels(spark, d):
    pick = lambda n, *vs: F.element_at(F.array(*[F.lit(v) for v in vs]), (F.col("doc_id") % n + 1).cast("int"))
    return docs(spark, d).select(
        "doc_id", pl.label(pick(4, "high", "medium", "low", "none"), pl.PRIORITY).alias("priority"), pl.label(pick(3, "rule_only", "", "other"), pl.CLASSIFICATION, "未分类").alias("classified"),
        pl.importable_label(pick(3, "", "u", "u"), pick(3, "verified", "verified", "unknown")).alias("importable"), pl.translation_label(F.lit(""), pick(3, "t", "", ""), pick(3, "a", "a", "")).alias("translated"),
    )


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '未执行' WHEN n_chars > 0 AND n_chars / 7001 < 0.1 THEN '<0.1s' ELSE printf('%.1fs', n_chars / 7001) END AS shown, round_even(greatest(n_chars / 7001 - 0.25, 0), 3) AS parse FROM documents")
def p12_batch_rows(spark, d):
    s = F.col("n_chars") / 7001  # never half way between two decimals
    return docs(spark, d).select("doc_id", pl.elapsed(s, F.col("doc_id") % 5 == 0).alias("shown"), rp.timing(s, F.lit(0.25)).alias("parse"))


@query("SELECT doc_id, CASE WHEN toxic = 1 OR doc_id % 7 = 0 THEN '不入库候选' WHEN doc_id % 3 = 0 THEN '未解析候选' WHEN doc_id % 5 = 0 THEN '结构需处理' ELSE '可用表格' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def p15_table_state(spark, d):
    rows = docs(spark, d).join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    n = F.col("doc_id")
    return rows.select("doc_id", pl.table_state(F.col("toxic") == 1, n % 7 == 0, n % 3 == 0, n % 5 == 0).alias("status"))


@query(f"WITH {CHUNKS} SELECT id FROM chunks WHERE content_type = 'image' AND (x1 - x0) * (y1 - y0) >= 5000 AND (id % 4 = 0 OR id % 3 = 0 OR (x1 - x0) * (y1 - y0) >= 20000)")
def f15_kept_visuals(spark, d):
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    kind = F.when(F.col("id") % 4 == 0, "chart").otherwise("image")
    return chunks(spark, d).filter((F.col("content_type") == "image") & pl.keeps_visual(kind, area, F.col("id") % 3 == 0)).select("id")


@query("SELECT doc_id, source FROM documents WHERE doc_id % 5 = 1")
def f17_pending(spark, d):
    status = F.when(F.col("doc_id") % 5 == 1, "pending").when(F.col("doc_id") % 5 == 0, "done")
    return docs(spark, d).filter(F.coalesce(status, F.lit("done")) == "pending").select("doc_id", "source")


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def f19_actionable(spark, d):
    return docs(spark, d).join(table(spark, d, "labels").filter("quality = 1").select("doc_id"), "doc_id").select("doc_id")


@query("SELECT vec_id, [embedding[1], embedding[2], embedding[3]] AS head FROM embeddings")
def u17_cut_dimensions(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("head"))
