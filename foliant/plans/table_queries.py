"""Queries about table matrices and regions: the lines of documents stand for rows, their clauses for cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import geometry as geo
from foliant.operators import judging as ju
from foliant.operators import layout as lo
from foliant.operators import matrices as mx
from foliant.plans.store_queries import CHUNKS, chunks
from foliant.registry import query, table

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
HEADERS, PROSE = ("[" + ", ".join(f"'{w}'" for w in words) + "]" for words in (mx.HEADER_WORDS, mx.PROSE_WORDS))
COUNT = "list_sum(list_transform(" + PROSE + ", lambda w: (length({0}) - length(replace(lower({0}), w, ''))) // length(w)))"
MATRIX = (
    "raw AS (SELECT doc_id, list_concat(list_concat(CASE WHEN doc_id % 3 = 0 THEN [['Table 1'], ['Product', 'Yield', 'Host', '', 'Strain', 'Brand']] ELSE [] END, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: string_split(x, ', '))), "
    "CASE WHEN doc_id % 4 = 0 THEN [['that the yield was increasing with the metabolic pathway and more'], ['* see text']] ELSE [] END) AS mat FROM documents), "
    f"n AS (SELECT doc_id, list_filter(list_transform(mat, lambda r: list_transform(list_resize(r, width, ''), lambda c: trim(c, {WS}))), lambda r: list_max(list_transform(r, lambda c: length(c))) > 0) AS m "
    "FROM (SELECT *, list_max(list_transform(mat, lambda r: len(r))) AS width FROM raw)), "
    "counts AS (SELECT doc_id, m, list_transform(m, lambda r: len(list_filter(r, lambda c: c <> ''))) AS k, list_transform(m, lambda r: lower(array_to_string(r, ' '))) AS said FROM n), "
    f"flags AS (SELECT *, coalesce(list_position(list_transform(list_zip(k, said), lambda z: z[1] >= 2 AND list_bool_or(list_transform({HEADERS}, lambda w: contains(z[2], w)))), true), 0) AS named, coalesce(list_position(list_transform(said, lambda s: contains(s, 'table ')), true), 0) AS titled FROM counts), "
    "h AS (SELECT *, CASE WHEN named > 0 THEN named - 1 WHEN titled = 0 THEN 0 WHEN titled < len(m) AND k[titled + 1] >= 2 THEN titled ELSE titled - 1 END AS header FROM flags), "
    "usual AS (SELECT *, list_max(list_transform(list_distinct(k), lambda c: {'n': len(list_filter(k, lambda x: x = c)), 'first': -list_position(k, c), 'width': c})) AS u FROM h)"
)


def matrices(spark, d):
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.split(x, ", ", -1))
    row = lambda *cells: F.array(*[F.lit(c) for c in cells])
    none = F.array().cast("array<array<string>>")
    top = F.when(F.col("doc_id") % 3 == 0, F.array(row("Table 1"), row("Product", "Yield", "Host", "", "Strain", "Brand"))).otherwise(none)
    end = F.when(F.col("doc_id") % 4 == 0, F.array(row("that the yield was increasing with the metabolic pathway and more"), row("* see text"))).otherwise(none)
    m = table(spark, d, "documents").select("doc_id", mx.normalized(F.concat(top, lines, end)).alias("m"))
    return m.withColumn("header", mx.header_row(F.col("m")))


@query(f"WITH {MATRIX} SELECT doc_id, len(m) AS n_rows, coalesce(len(m[1]), 0) AS n_cols, md5(array_to_string(list_transform(m, lambda r: array_to_string(r, '|')), chr(10))) AS digest FROM h")
def m15_normalized_matrix(spark, d):
    text = F.array_join(F.transform("m", lambda r: F.array_join(r, "|")), "\n")
    return matrices(spark, d).select("doc_id", F.size("m").alias("n_rows"), F.coalesce(F.size(F.get("m", F.lit(0))), F.lit(0)).alias("n_cols"), F.md5(text).alias("digest"))


@query(f"WITH {MATRIX} SELECT doc_id, header, CASE WHEN len(m) = 0 THEN '' ELSE array_to_string(list_transform(list_concat(list_concat([m[header + 1]], [list_transform(m[1], lambda c: '---')]), m[header + 2:]), lambda r: '| ' || array_to_string(r, ' | ') || ' |'), chr(10)) END AS markdown FROM h")
def m16_markdown(spark, d):
    return matrices(spark, d).select("doc_id", "header", mx.markdown(F.col("m"), F.col("header")).alias("markdown"))


@query()
def m17_valid_matrix(spark, d):
    return matrices(spark, d).select("doc_id", mx.is_valid(F.col("m"), F.col("header")).alias("valid"))


QUALITY = (
    f"{MATRIX}, cells AS (SELECT *, list_filter(flatten(m), lambda c: c <> '') AS cs, list_max(k) AS most FROM usual), "
    f"shares AS (SELECT *, u.n / len(m)::DOUBLE AS consistency, 1 - (len(flatten(m)) - len(cs)) / (len(m) * most)::DOUBLE AS fill, len(list_filter(cs, lambda c: length(c) >= 50 AND {COUNT.format('c')} >= 3)) AS pc FROM cells), "
    "kinds AS (SELECT *, CASE WHEN len(m) < 2 THEN 1 WHEN most < 2 THEN 2 WHEN len(m) < 4 THEN 3 ELSE 4 END AS kind, consistency >= 0.9 AND fill >= 0.7 AND len(m) >= 4 AND most >= 3 AS wide, pc / greatest(len(cs), 1)::DOUBLE AS prose_share FROM shares)"
)


@query(
    f"WITH {QUALITY} SELECT doc_id, CASE kind WHEN 4 THEN round_even(consistency, 2) WHEN 3 THEN 1 ELSE 0 END::DOUBLE AS consistency, CASE kind WHEN 4 THEN round_even(fill, 2) WHEN 3 THEN 1 ELSE 0 END::DOUBLE AS fill, CASE kind WHEN 4 THEN round_even(prose_share, 2) ELSE 0 END::DOUBLE AS prose, "
    "kind = 4 AND wide AS descriptive, CASE kind WHEN 1 THEN 'empty_or_too_short' WHEN 2 THEN 'too_few_columns' WHEN 3 THEN 'too_few_data_rows' "
    "ELSE array_to_string(list_filter([CASE WHEN consistency < 0.8 THEN 'low_consistency' END, CASE WHEN fill < 0.4 THEN 'low_fill_rate' END, CASE WHEN NOT wide AND (pc >= 3 OR prose_share >= 0.3) THEN 'prose_like_cells' END], lambda x: x IS NOT NULL), ',') END AS reasons FROM kinds"
)
def m18_structural_quality(spark, d):
    q = matrices(spark, d).withColumn("q", mx.quality(F.col("m")))
    return q.select("doc_id", "q.consistency", "q.fill", "q.prose", "q.descriptive", F.array_join("q.reasons", ",").alias("reasons"))


@query(f"WITH {MATRIX} SELECT doc_id, u.width AS usual, u.n AS n FROM usual WHERE len(m) > 0")
def g25_usual_width(spark, d):
    m = matrices(spark, d).withColumn("u", mx.mode_width(F.col("m"))).filter(F.size("m") > 0)
    return m.select("doc_id", F.col("u.width").alias("usual"), F.col("u.n").alias("n"))


@query()
def m19_without_body_text(spark, d):
    m = matrices(spark, d).withColumn("kept", mx.before_prose(F.col("m")))
    return m.select("doc_id", F.size("m").alias("n_rows"), F.size("kept").alias("n_kept"))


@query()
def m20_repaired(spark, d):
    m = matrices(spark, d).withColumn("r", mx.repaired(F.col("m")))
    return m.select("doc_id", F.coalesce(F.size(F.get("m", F.lit(0))), F.lit(0)).alias("before"), F.coalesce(F.size(F.get("r", F.lit(0))), F.lit(0)).alias("after"))


@query()
def m21_unfolded(spark, d):
    m = matrices(spark, d).withColumn("u", mx.unfolded(F.col("m")))
    return m.select("doc_id", F.size("m").alias("n_rows"), F.size("u").alias("n_unfolded"))


@query(r"SELECT doc_id, n, regexp_matches(trim(line), '(?i)^(?:\d+\s+)?(?:table|tab\.)\s*s?\d+(\b|[A-Z])') AS is_caption FROM (SELECT doc_id, n, CASE WHEN (doc_id + n) % 5 = 0 THEN 'Table ' || doc_id || '. ' || line ELSE line END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents))")
def m1_captions(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)
    line = F.when((F.col("doc_id") + F.col("n")) % 5 == 0, F.concat(F.lit("Table "), F.col("doc_id").cast("string"), F.lit(". "), F.col("line"))).otherwise(F.col("line"))
    return lines.select("doc_id", "n", ju.is_caption(line).alias("is_caption"))


LINES = "l AS (SELECT doc_id, n, line, list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '') AS ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents))"


@query(f"WITH {LINES} SELECT doc_id, n, (doc_id + n) % 4 >= 2 OR numeric >= 0.2 OR (short >= 0.7 AND len(ws) >= 3) AS table_like FROM (SELECT *, CASE WHEN len(ws) = 0 THEN 0 ELSE len(list_filter(ws, lambda w: regexp_matches(w, '[0-9]'))) / len(ws)::DOUBLE END AS numeric, CASE WHEN len(ws) = 0 THEN 0 ELSE len(list_filter(ws, lambda w: length(trim(w, '.,;:()[]')) <= 12)) / len(ws)::DOUBLE END AS short FROM l)")
def m7_table_like_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)
    return lines.select("doc_id", "n", ju.like_a_table(F.col("line"), ((F.col("doc_id") + F.col("n")) % 4).cast("int")).alias("table_like"))


@query("SELECT doc_id, round(greatest(0, least(1, CASE WHEN doc_id % 3 = 0 THEN 0.35 ELSE 0 END + CASE WHEN doc_id % 5 >= 3 THEN 0.3 WHEN doc_id % 5 = 2 THEN 0.2 ELSE 0 END + CASE WHEN doc_id % 7 >= 3 THEN 0.3 WHEN doc_id % 7 = 2 THEN 0.15 ELSE 0 END + CASE WHEN n_chars > 0 AND doc_id % 10 >= 2 THEN 0.15 ELSE 0 END + CASE WHEN doc_id % 11 >= 7 AND n_chars >= 8 THEN 0.1 ELSE 0 END - CASE WHEN doc_id % 4 >= 3 THEN 0.3 ELSE 0 END - CASE WHEN doc_id % 6 = 0 THEN 0.2 ELSE 0 END)), 6)::DOUBLE AS score FROM documents")
def m5_region_evidence(spark, d):
    i = F.col("doc_id")
    score = ju.evidence(i % 3 == 0, i % 5, i % 7, (i % 10) / 10, (i % 11) / 10, F.col("n_chars"), i % 4, i % 6 == 0)
    return table(spark, d, "documents").select("doc_id", score.alias("score"))


#: Each line of a text is one line of words, twelve points below the one before; every fifth line is close to its neighbour.
CONTEXT = (
    "tl AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS ln FROM documents), "
    "tw AS (SELECT doc_id, ln, unnest(string_split(line, ' ')) AS w, generate_subscripts(string_split(line, ' '), 1) - 1 AS p FROM tl), "
    f"ww AS (SELECT doc_id, round_even((12 * ln - CASE WHEN ln % 5 = 4 THEN 11 ELSE 0 END) / 4.0::DOUBLE, 0) AS bin, ln, p, trim(w, {WS}) AS w FROM tw WHERE trim(w, {WS}) <> ''), "
    "wl AS (SELECT doc_id, bin, string_agg(w, ' ' ORDER BY ln, p) AS line, count(*) AS words, count(*) FILTER (regexp_matches(w, '[0-9]')) AS numbers, count(*) FILTER (length(trim(w, '.,;:()[]')) <= 1) AS singles, sum(length(w)) AS letters FROM ww GROUP BY ALL), "
    f"ctx AS (SELECT d.doc_id, {{'words': coalesce(sum(words), 0), 'lines': count(line), 'long_lines': count(line) FILTER (len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) >= 14 OR length(line) >= 100), 'prose': coalesce(sum({COUNT.format('line')}), 0), "
    "'numbers': coalesce(sum(numbers), 0), 'singles': coalesce(sum(singles), 0), 'mean_length': coalesce(round_even(sum(letters) / sum(words)::DOUBLE, 2), 0)} AS c FROM documents d LEFT JOIN wl USING (doc_id) GROUP BY d.doc_id)"
)


def contexts(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("ln", "line"))
    top = 12 * F.col("ln") - F.when(F.col("ln") % 5 == 4, 11).otherwise(0)
    words = lines.select("doc_id", top.cast("double").alias("top"), "ln", F.posexplode(F.split("line", " ", -1)).alias("p", "text"))
    return mx.word_counts(words.withColumn("place", F.struct("ln", "p")), ["doc_id"])


@query(f"WITH {CONTEXT} SELECT doc_id, c.words, c.lines, c.long_lines, c.prose, c.numbers, c.singles, c.mean_length FROM ctx WHERE c.words > 0")
def g26_word_statistics(spark, d):
    return contexts(spark, d).select("doc_id", "context.*")


@query(
    f"WITH {CONTEXT} SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'unknown' WHEN doc_id % 2 = 0 THEN CASE WHEN conf < 0.5 AND doc_id % 5 = 0 THEN 'candidate_false_positive' WHEN c.words <= 4 THEN 'bbox_too_small' WHEN c.words >= 12 AND (c.singles >= 0.35::DOUBLE * c.words OR (c.mean_length > 0 AND c.mean_length <= 2.4)) THEN 'fragmented_text_layer' "
    "WHEN c.words >= 20 AND (c.long_lines >= 2 OR c.prose >= 8) THEN 'body_text_contamination' WHEN conf >= 0.65 THEN 'no_parser_output' ELSE 'unknown' END WHEN doc_id % 7 < 3 OR doc_id % 9 < 2 THEN 'low_rows_or_cols' WHEN doc_id % 11 = 1 THEN 'body_text_contamination' WHEN doc_id % 11 = 2 THEN 'header_or_span_complexity' WHEN doc_id % 11 = 3 THEN 'fragmented_text_layer' "
    "WHEN doc_id % 10 > 0 AND doc_id % 10 < 4 THEN 'bbox_too_large' ELSE 'ok' END AS category FROM (SELECT *, (doc_id % 100)::DOUBLE / 100 AS conf FROM ctx)"
)
def m28_rule_judge(spark, d):
    i = F.col("doc_id")
    t = table(spark, d, "documents").select("doc_id").join(contexts(spark, d), "doc_id", "left").select("doc_id", F.coalesce("context", F.expr(mx.NO_WORDS)).alias("c"))
    reasons = F.when(i % 11 == 1, F.array(F.lit("prose_like_cells"))).when(i % 11 == 2, F.array(F.lit("low_consistency"))).when(i % 11 == 3, F.array(F.lit("low_fill_rate"))).otherwise(F.array().cast("array<string>"))
    v = ju.judged(i % 2 == 1, F.when(i % 13 == 0, "failed").otherwise(""), (i % 100) / 100, i % 5 == 0, F.lit(True), F.col("c"), i % 7, i % 9, reasons, (i % 10) / 10)
    return t.select("doc_id", v["category"].alias("category"))


ACTIONS = ["accept", "retry_text_strategy", "drop_candidate", "needs_llm_judge", "expand_bbox", "shrink_bbox", "mark_unparseable"]
SAFE = ["retry_text_strategy", "mark_unparseable", "drop_candidate", "expand_bbox", "shrink_bbox"]


@query(f"SELECT doc_id, doc_id % 13 <> 0 AND (doc_id % 100)::DOUBLE / 100 >= 0.65 AND a IN ({', '.join(repr(x) for x in SAFE)}) AS allowed, doc_id % 13 = 0 OR a = 'needs_llm_judge' AS review FROM (SELECT doc_id, ([{', '.join(repr(x) for x in ACTIONS)}])[1 + doc_id % 7] AS a FROM documents)")
def m29_automatic_decision(spark, d):
    i = F.col("doc_id")
    action = F.get(F.array(*[F.lit(a) for a in ACTIONS]), (i % 7).cast("int"))
    got = table(spark, d, "documents").select("doc_id", ju.automatic(action, (i % 100) / 100, F.when(i % 13 == 0, "failed").otherwise(""), SAFE).alias("v"))
    return got.select("doc_id", "v.allowed", "v.review")


@query(
    f"WITH {CHUNKS}, b AS (SELECT id, x0, y0, x1, y1, greatest(1, x1 - x0) AS w, greatest(1, y1 - y0) AS h FROM chunks WHERE content_type = 'table') "
    "SELECT id, name, round(bx1, 4) AS x1, round(by1, 4) AS y1 FROM (SELECT id, 'expand_down' AS name, x1 AS bx1, least(860, y1 + greatest(60, h * 0.25::DOUBLE)) AS by1 FROM b UNION ALL SELECT id, 'expand_margin', least(600, x1 + w * 0.05::DOUBLE), least(860, y1 + h * 0.15::DOUBLE) FROM b) WHERE id % 2 = 0 "
    "UNION ALL SELECT id, 'shrink_bottom', round(x1, 4), round(greatest(y0 + 24, y1 - greatest(40, h * 0.2::DOUBLE)), 4) FROM b WHERE id % 2 = 1"
)
def m31_box_variants(spark, d):
    c = chunks(spark, d).filter("content_type = 'table'")
    action = F.when(F.col("id") % 2 == 0, "expand_bbox").otherwise("shrink_bbox")
    v = c.select("id", F.explode(ju.variants(F.col("box"), action, F.lit(600.0), F.lit(860.0))).alias("v"))
    shown = v.filter(F.col("v.name").isin("expand_down", "expand_margin", "shrink_bottom"))
    return shown.select("id", "v.name", F.round("v.box.x1", 4).alias("x1"), F.round("v.box.y1", 4).alias("y1"))


NAMES = ["region_guided_geometry_x", "pdfplumber_region_text", "region_guided_text", "keyword_guided", "pdfplumber", "table_region_detector", "other"]


@query(f"SELECT doc_id, round(([40.0, 38.0, 36.0, 34.0, 30.0, 0.0, 10.0])[1 + doc_id % 7] + (doc_id % 10) / 10.0 * 5 + (doc_id % 4) / 4.0 * 3 + least(doc_id % 20, 12) * 0.25 + least(doc_id % 13, 8) * 0.2 - CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 0 END - CASE WHEN doc_id % 17 = 0 THEN 30 ELSE 0 END, 4)::DOUBLE AS score FROM documents")
def m32_chunk_quality(spark, d):
    i = F.col("doc_id")
    parser = F.get(F.array(*[F.lit(n) for n in NAMES]), (i % 7).cast("int"))
    s = ju.chunk_quality(parser, (i % 10) / 10, (i % 4) / 4, i % 20, i % 13, i % 3 == 0, i % 17 == 0)
    return table(spark, d, "documents").select("doc_id", F.round(s, 4).alias("score"))


def _parsed(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("region"))
    return t, t.filter("region % 3 <> 0").withColumn("family", F.when(F.col("region") % 2 == 0, "lines").otherwise("text"))


@query("SELECT doc_id AS region, family, CASE WHEN doc_id % 3 <> 0 AND family = CASE WHEN doc_id % 2 = 0 THEN 'lines' ELSE 'text' END THEN 'success' ELSE 'failure' END AS outcome FROM documents, (SELECT unnest(['lines', 'text', 'caption']) AS family)")
def m24_region_attempts(spark, d):
    return ju.attempts(*_parsed(spark, d), ["lines", "text", "caption"])


@query("SELECT doc_id AS region, 'table' AS content_type, true AS table_region_unparsed FROM documents WHERE doc_id % 3 = 0")
def m25_unparsed_regions(spark, d):
    return ju.unparsed(*_parsed(spark, d))


RANGES = "o AS (SELECT *, max(x1) OVER (PARTITION BY paper_id, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM small), g AS (SELECT *, sum((far IS NULL OR x0 - far >= 8)::INT) OVER (PARTITION BY paper_id, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rng FROM o), r AS (SELECT paper_id, page, rng, min(x0) AS lo, max(x1) AS hi FROM g GROUP BY ALL)"


@query(f"WITH {CHUNKS}, small AS (SELECT * FROM chunks WHERE id % 4 = 1), {RANGES} SELECT c.paper_id, c.page, c.id, arg_min(r.rng, {'{'}'far': greatest(lo - (x0 + x1) / 2, (x0 + x1) / 2 - hi, 0), 'rng': r.rng{'}'}) AS range FROM chunks c JOIN r USING (paper_id, page) GROUP BY ALL")
def m9_nearest_column(spark, d):
    c = chunks(spark, d).select("paper_id", "page", "id", "x0", "x1")
    return ju.nearest_column(c, lo.column_ranges(c.filter("id % 4 = 1")), ["paper_id", "page"])


@query(
    f"WITH {CHUNKS}, y AS (SELECT *, count(*) OVER (PARTITION BY paper_id, page) AS total FROM (SELECT DISTINCT paper_id, page, y0 AS y FROM chunks)) SELECT a.paper_id, a.page, a.y AS top, b.y AS middle, c.y AS bottom, c.y - b.y - abs(b.y - a.y - 14) * 2 AS score FROM y a JOIN y b ON a.paper_id = b.paper_id AND a.page = b.page JOIN y c ON a.paper_id = c.paper_id AND a.page = c.page "
    "WHERE CASE WHEN a.total = 3 THEN a.y < b.y AND b.y < c.y ELSE b.y - a.y BETWEEN 6 AND 45 AND c.y - b.y >= 45 END QUALIFY row_number() OVER (PARTITION BY a.paper_id, a.page ORDER BY c.y - b.y - abs(b.y - a.y - 14) * 2 DESC, a.y, b.y) = 1"
)
def m13_three_lines(spark, d):
    rules = chunks(spark, d).select("paper_id", "page", F.col("y0").alias("y"))
    return ju.three_lines(rules, ["paper_id", "page"])


@query(f"WITH {CHUNKS} SELECT id, round((x0 + x1) / 2, 4) AS x, round((y0 + y1) / 2, 4) AS y, round((x1 - x0) * (y1 - y0), 4) AS area FROM chunks")
def x25_box_center(spark, d):
    x, y = geo.center(F.col("box"))
    return chunks(spark, d).select("id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(geo.area(F.col("box")), 4).alias("area"))
