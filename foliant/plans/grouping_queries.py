"""Queries on order: headings, page heads, runs, lines, figures, batches, boxes. Documents stand for chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import geometry as geo
from foliant.operators import grouping as gr
from foliant.plans.store_queries import CHUNKS, chunks
from foliant.registry import query, table

LEVEL = "CASE WHEN ord % 5 < 2 THEN 1 ELSE 0 END"
#: Chunks with a parser's heading level.
LEVELLED = f"{CHUNKS}, h AS (SELECT id, paper_id, ord, page, col, content_type, x0, y0, x1, y1, {LEVEL} AS level, text FROM chunks)"


def levelled(spark, d):
    return chunks(spark, d).withColumn("level", F.expr(LEVEL))


def paired(takes: str, source: str) -> str:
    """CTEs in SQL: which rows take the one behind them."""
    return (
        f"could AS (SELECT *, coalesce({takes}, false) AS could FROM {source} WINDOW w AS (PARTITION BY paper_id ORDER BY ord)), "
        "run AS (SELECT *, coalesce(sum((NOT could)::INT) OVER (PARTITION BY paper_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM could), "
        "took AS (SELECT *, could AND row_number() OVER (PARTITION BY paper_id, run ORDER BY ord) % 2 = 1 AS takes FROM run), "
        "pairs AS (SELECT *, coalesce(lag(takes) OVER w, false) AS taken FROM took WINDOW w AS (PARTITION BY paper_id ORDER BY ord))"
    )


HEADING = r"(content_type = 'text' AND trim(text) <> '' AND NOT (trim(text) LIKE '%:' AND len(regexp_split_to_array(trim(text), '\s+')) > 4) AND CASE WHEN level >= 1 THEN length(trim(text)) <= 120 ELSE len(regexp_extract_all(trim(text), '[A-Za-z][A-Za-z-]*')) BETWEEN 1 AND 8 AND length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) >= 4 AND upper(regexp_replace(text, '[^A-Za-z]+', '', 'g')) = regexp_replace(text, '[^A-Za-z]+', '', 'g') END)"
WITH_HEADINGS = f"{LEVELLED}, {paired(HEADING + ' AND lead(content_type) OVER w = ' + chr(39) + 'text' + chr(39) + ' AND lead(page) OVER w = page', 'h')}"


@query(f"WITH {WITH_HEADINGS}, m AS (SELECT *, lag(trim(text)) OVER w AS head, lag(x0) OVER w AS px, lag(y1) OVER w AS py FROM pairs WINDOW w AS (PARTITION BY paper_id ORDER BY ord)) SELECT id, CASE WHEN taken THEN head END AS attached_heading, md5(CASE WHEN taken THEN head || chr(10) || chr(10) || trim(text) ELSE text END) AS h, CASE WHEN taken THEN least(x0, px) ELSE x0 END AS x0, CASE WHEN taken THEN greatest(y1, py) ELSE y1 END AS y1 FROM m WHERE NOT takes")
def w17_attached_headings(spark, d):
    return gr.with_headings(levelled(spark, d)).select("id", "attached_heading", F.md5("text").alias("h"), "box.x0", "box.y1")


@query(f"WITH {WITH_HEADINGS} SELECT id, row_number() OVER (PARTITION BY paper_id, page ORDER BY ord) - 1 AS order_in_page, row_number() OVER (PARTITION BY paper_id ORDER BY ord) - 1 AS global_order FROM pairs WHERE NOT takes")
def w2_orders(spark, d):
    return gr.with_headings(levelled(spark, d)).select("id", F.col("order_in_page").cast("long"), F.col("global_order").cast("long"))


@query(f"WITH {LEVELLED} SELECT id, {HEADING} AS heading FROM h")
def o4_heading_rule(spark, d):
    return levelled(spark, d).select("id", (F.col("content_type") == "text").__and__(gr.is_heading(F.col("text"), F.col("level"))).alias("heading"))


#: Blocks one below the other, so that neighbours stand close.
STACKED = f"{CHUNKS}, s AS (SELECT id, paper_id, ord, page, col, CASE WHEN ord % 6 = 0 THEN 'image' ELSE 'text' END AS content_type, text, x0, CAST(ord % 40 * 12 AS DOUBLE) AS y0, x1, CAST(ord % 40 * 12 + 10 AS DOUBLE) AS y1 FROM chunks)"
FIRST = r"upper(rtrim(split_part(regexp_replace(trim(text), '\s+', ' ', 'g'), ' ', 1), ':.'))"
HEADS = (
    r"content_type = 'text' AND lead(content_type) OVER w = 'text' AND page = lead(page) OVER w AND y0 < 280 AND lead(y0) OVER w < 280 AND lead(y0) OVER w - y1 BETWEEN 0 AND 20 "
    r"AND (col = lead(col) OVER w OR greatest(col, lead(col) OVER w) = 2) AND len(regexp_split_to_array(trim(text), '\s+')) >= 12 AND NOT lead(opens) OVER w"
)
OPENED = f"{STACKED}, o AS (SELECT *, {FIRST} IN ({', '.join(repr(x) for x in gr.SECTIONS)}) AS opens FROM s)"


def stacked(spark, d):
    c = chunks(spark, d).withColumn("content_type", F.expr("CASE WHEN ord % 6 = 0 THEN 'image' ELSE 'text' END"))
    top = (F.col("ord") % 40 * 12).cast("double")
    return c.withColumn("box", geo.box(F.col("x0"), top, F.col("x1"), top + 10))


@query(f"WITH {OPENED}, {paired(HEADS, 'o')}, m AS (SELECT *, lead(text) OVER w AS lower_text, lead(y1) OVER w AS bottom, lead(col) OVER w AS next_col FROM pairs WINDOW w AS (PARTITION BY paper_id ORDER BY ord)) SELECT id, CASE WHEN takes THEN greatest(col, next_col) ELSE col END AS col, md5(CASE WHEN takes THEN text || chr(10) || lower_text ELSE text END) AS h, CASE WHEN takes THEN bottom ELSE y1 END AS y1 FROM m WHERE NOT taken")
def w18_page_heads(spark, d):
    return gr.with_page_heads(stacked(spark, d), 800.0).select("id", "col", F.md5("text").alias("h"), "box.y1")


@query(f"WITH {OPENED} SELECT id, opens FROM o")
def f5_section_start(spark, d):
    return chunks(spark, d).select("id", gr.starts_section(F.col("text")).alias("opens"))


@query("WITH l AS (SELECT *, sum((turn % 4 = 3)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations) SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n FROM l WHERE turn % 4 <> 3 GROUP BY conv_id, run HAVING count(*) >= 3")
def w16_runs(spark, d):
    return gr.runs(table(spark, d, "conversations"), F.col("turn") % 4 != 3, ["conv_id"], "turn")


def words(spark, d):
    """Words of each document on a page, twelve a line, lines a little uneven."""
    w = table(spark, d, "documents").select(F.col("source").alias("paper_id"), F.col("doc_id").cast("int").alias("page"), F.posexplode(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")).alias("i", "text"))
    x, y = F.col("i") % 12 * 40.0, F.floor(F.col("i") / 12) * 14.0 + F.col("i") % 3
    return w.select("paper_id", "page", "text", x.alias("x0"), y.alias("top"), (x + 30).alias("x1"), (y + 10).alias("bottom"))


@query(r"WITH t AS (SELECT source AS paper_id, doc_id::INT AS page, unnest(regexp_split_to_array(trim(coalesce(text, '')), '\s+')) AS text, generate_subscripts(regexp_split_to_array(trim(coalesce(text, '')), '\s+'), 1) - 1 AS i FROM documents) SELECT paper_id, page, i // 12 AS line, md5(trim(string_agg(text, ' ' ORDER BY i))) AS h, max(i % 12) * 40.0::DOUBLE + 30 AS x1 FROM t GROUP BY ALL HAVING trim(string_agg(text, ' ')) <> ''")
def w14_text_lines(spark, d):
    return gr.text_lines(words(spark, d)).select("paper_id", "page", "line", F.md5("text").alias("h"), "x1")


@query("WITH c AS (SELECT source AS paper_id, doc_id AS ord, coalesce(length(text), 0) AS chars FROM documents) SELECT paper_id, count(*) AS chunks, sum(chars)::BIGINT AS chars, true AS bounded FROM c GROUP BY paper_id")
def w20_map_batches(spark, d):
    """Batches hold every chunk of a paper once and keep to their bounds."""
    c = chunks(spark, d)
    b = gr.batches(c).join(c.select("id", F.coalesce(F.length("text"), F.lit(0)).alias("chars")), "id")
    each = b.groupBy("paper_id", "batch").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    kept = (F.col("n") <= gr.BATCH_CHUNKS) & ((F.col("n") == 1) | (F.col("chars") <= gr.BATCH_CHARS))
    return each.groupBy("paper_id").agg(F.sum("n").alias("chunks"), F.sum("chars").alias("chars"), F.every(kept).alias("bounded"))


@query(r"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Figure ' || doc_id || 'a' ELSE '' END AS label FROM documents")
def x36_figure_label(spark, d):
    caption = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("See fig. "), F.col("doc_id").cast("string"), F.lit("a for more"))).otherwise(F.lit("no number here"))
    return table(spark, d, "documents").select("doc_id", gr.figure_label(caption).alias("label"))


@query()
def w19_figure_groups(spark, d):
    """Images of a page in figures: each image once."""
    caption = F.when(F.col("ord") % 21 == 1, F.concat(F.lit("Figure "), F.col("ord").cast("string")))
    images = chunks(spark, d).filter("content_type = 'image'").withColumn("caption", caption)
    return gr.figure_groups(images)


@query(f"WITH {CHUNKS} SELECT id FROM chunks QUALIFY row_number() OVER (PARTITION BY paper_id, page, round_even(x0 / 30, 1), round_even(y0 / 30, 1), round_even(x1 / 30, 1), round_even(y1 / 30, 1) ORDER BY ord) = 1")
def d12_distinct_boxes(spark, d):
    c = chunks(spark, d)
    return gr.distinct_boxes(c.withColumn("box", geo.box(*[F.col(x) / 30 for x in ("x0", "y0", "x1", "y1")])), ["paper_id", "page"], "ord").select("id")


def regions(spark, d):
    caption = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("Table "), (F.col("ord") % 4).cast("string"), F.lit(". Yields of the strains")))
    c = chunks(spark, d).withColumns({"caption": caption, "captioned": caption.isNotNull(), "ruled": F.col("ord") % 2 == 0, "confidence": (F.col("ord") % 10).cast("double") / 10, "evidence": (F.col("ord") % 4).cast("int")})
    # A few places on a page, so that many boxes cover each other.
    return c.withColumn("box", geo.box(*[F.floor(F.col(x) / 250) * 250 + F.col("ord") % 5 + off for x, off in (("x0", 0), ("y0", 0), ("x1", 260), ("y1", 260))]))


@query()
def d9_merged_boxes(spark, d):
    return gr.merged_boxes(regions(spark, d))


@query()
def w22_without_overlaps(spark, d):
    return gr.without_overlaps(regions(spark, d))


@query()
def d10_without_repeated_captions(spark, d):
    return gr.without_repeated_captions(regions(spark, d))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 's' || doc_id WHEN 1 THEN 'yields of strains' ELSE '' END AS key FROM documents")
def x34_caption_key(spark, d):
    n = F.col("doc_id").cast("string")
    caption = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" Supplementary Table S"), n, F.lit(": Yields"))).when(F.col("doc_id") % 3 == 1, F.lit("Yields   of strains"))
    return table(spark, d, "documents").select("doc_id", gr.caption_key(caption).alias("key"))
