"""Regions of tables and the rules about them: captions, evidence, judgements, automatic decisions, variants, attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: how a table's caption begins.
CAPTION = r"(?i)^(?:\d+\s+)?(?:table|tab\.)\s*s?\d+(?=\b|[A-Z])|^(?:\d+\s+)?supplementary\s*table\s*s?\d+(?=\b|[A-Z])|^(?:\d+\s+)?table\s*\d+[.:]|^(?:\d+\s+)?表\s*[S号]?\s*\d+\b|^(?:\d+\s+)?附表\s*[S号]?\s*\d+\b"
# Fixed value: what counts as a number in a line.
NUMBER = r"(?i)[-+]?\d+(?:\.\d+)?%?|[<>]=?\s*\d+|p\s*[<=>]\s*0?\.\d+"
# Trust in what a parser yields, by the beginning of its name.
PARSERS = [("region_guided_geometry", 40.0), ("pdfplumber_region", 38.0), ("region_guided_text", 36.0), ("keyword_guided", 34.0), ("pdfplumber", 30.0)]
SAFE_CONFIDENCE = 0.65


def is_caption(line: Column) -> Column:
    return F.trim(line).rlike(CAPTION)


def _words(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def _bare(words: Column) -> Column:
    return F.transform(words, lambda w: F.btrim(w, F.lit(".,;:()[]")))


def _share(words: Column, of) -> Column:
    return F.when(F.size(words) > 0, F.size(F.filter(words, of)) / F.size(words)).otherwise(0.0)


def numeric_share(line: Column) -> Column:
    return _share(_words(line), lambda w: w.rlike(NUMBER))


def short_share(line: Column) -> Column:
    return _share(_bare(_words(line)), lambda w: F.length(w) <= 12)


def like_a_table(line: Column, bins: Column) -> Column:
    """Words at two places at least (bins of 12 points), a fifth of numbers, or three words, most of them short."""
    return (bins >= 2) | (numeric_share(line) >= 0.2) | ((short_share(line) >= 0.7) & (F.size(_words(line)) >= 3))


def is_data_row(line: Column) -> Column:
    """A label like `A12`, then two numbers at least."""
    bare = F.filter(_bare(_words(line)), lambda w: w != "")
    return F.coalesce(F.get(bare, F.lit(0)).rlike(r"^[A-Za-z]{0,4}\d+[A-Za-z]?$") & (F.size(F.filter(F.slice(bare, F.lit(2), F.size(bare)), lambda w: w.rlike(NUMBER))) >= 2), F.lit(False))


def evidence(caption: Column, rules: Column, aligned: Column, numeric: Column, short: Column, words: Column, long_lines: Column, section: Column) -> Column:
    """A region's score, between 0 and 1, from what was counted in it."""
    s = F.when(caption, 0.35).otherwise(0.0) + F.when(rules >= 3, 0.30).when(rules >= 2, 0.20).otherwise(0.0) + F.when(aligned >= 3, 0.30).when(aligned >= 2, 0.15).otherwise(0.0)
    s = s + F.when((words > 0) & (numeric >= 0.2), 0.15).otherwise(0.0) + F.when((short >= 0.7) & (words >= 8), 0.10).otherwise(0.0)
    s = s - F.when(long_lines >= 3, 0.30).otherwise(0.0) - F.when(section, 0.20).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 6)


def judged(succeeded: Column, error: Column, confidence: Column, only_caption: Column, captioned: Column, context: Column, rows: Column, cols: Column, reasons: Column, overlap: Column) -> Column:
    """struct(category, action, needs_llm, confidence): the first rule that fits.

    context is that of word_counts(); reasons are those of quality(); overlap 0 means unknown."""
    verdict = lambda category, action, sure, ask=True: F.struct(F.lit(category).alias("category"), F.lit(action).alias("action"), F.lit(ask).alias("needs_llm"), F.lit(sure).alias("confidence"))
    words = context["words"]
    has = lambda why: F.array_contains(reasons, why)
    fragmented = (words >= 12) & ((context["singles"] >= 0.35 * words) | ((context["mean_length"] > 0) & (context["mean_length"] <= 2.4)))
    prose = (words >= 20) & ((context["long_lines"] >= 2) | (context["prose"] >= 8))
    silent = (
        F.when((confidence < 0.5) & only_caption, verdict("candidate_false_positive", "drop_candidate", 0.65))
        .when(words <= 4, verdict("bbox_too_small", "expand_bbox", 0.70))
        .when(fragmented, verdict("fragmented_text_layer", "mark_unparseable", 0.65))
        .when(prose, verdict("body_text_contamination", "shrink_bbox", 0.65))
        .when(captioned & (confidence >= 0.65), verdict("no_parser_output", "retry_text_strategy", 0.60))
        .otherwise(verdict("unknown", "needs_llm_judge", 0.40))
    )
    return (
        F.when(error != "", verdict("unknown", "needs_llm_judge", 0.35))
        .when(~succeeded, silent)
        .when((rows < 3) | (cols < 2), verdict("low_rows_or_cols", "retry_text_strategy", 0.70))
        .when(has("prose_like_cells"), verdict("body_text_contamination", "shrink_bbox", 0.75))
        .when(has("low_consistency"), verdict("header_or_span_complexity", "retry_text_strategy", 0.65))
        .when(has("low_fill_rate"), verdict("fragmented_text_layer", "needs_llm_judge", 0.55))
        .when((overlap > 0) & (overlap < 0.35), verdict("bbox_too_large", "shrink_bbox", 0.55))
        .otherwise(verdict("ok", "accept", 0.90, False))
    )


def automatic(action: Column, confidence: Column, error: Column, safe: list[str], enabled: bool = True, threshold: float = SAFE_CONFIDENCE) -> Column:
    """struct(safe, allowed, review): may an action that a model proposes be taken without a person."""
    action, error = F.coalesce(action, F.lit("")), F.coalesce(error, F.lit(""))
    fit = (error == "") & (F.coalesce(confidence, F.lit(0.0)) >= threshold) & action.isin(safe)
    return F.struct(fit.alias("safe"), (fit & F.lit(enabled)).alias("allowed"), ((error != "") | action.isin("needs_llm_judge", "retry_line_strategy")).alias("review"))


def variants(box: Column, action: Column, page_width: Column, page_height: Column) -> Column:
    """array of struct(name, box): other bounds to try, six to shrink and five to expand; boxes that agree to a tenth of
    a point count once, empty ones not at all."""
    x0, y0, x1, y1 = (box[k] for k in ("x0", "y0", "x1", "y1"))
    w, h = F.greatest(F.lit(1.0), x1 - x0), F.greatest(F.lit(1.0), y1 - y0)
    lo, hi = (lambda v: F.greatest(F.lit(0.0), v)), F.least
    one = lambda name, a, b, c, d: F.struct(F.lit(name).alias("name"), F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")).alias("box"))
    most = F.greatest
    shrink = F.array(
        one("shrink_bottom", x0, y0, x1, most(y0 + 24, y1 - most(F.lit(40.0), h * 0.2))),
        one("shrink_vertical_margin", x0, hi(y1, y0 + h * 0.05), x1, most(y0 + 24, y1 - h * 0.1)),
        one("shrink_to_caption_band", x0, y0, x1, most(y0 + 80, y1 - h * 0.3)),
        one("trim_body_text_tail", x0, y0, x1, most(y0 + 72, y1 - h * 0.4)),
        one("shrink_to_upper_dense_band", x0, y0, x1, most(y0 + 96, y0 + h * 0.58)),
        one("shrink_lower_margin_only", x0, y0, x1, most(y0 + 96, y1 - h * 0.28)),
    )
    expand = F.array(
        one("expand_down", x0, y0, x1, hi(page_height, y1 + most(F.lit(60.0), h * 0.25))),
        one("expand_margin", lo(x0 - w * 0.05), lo(y0 - h * 0.05), hi(page_width, x1 + w * 0.05), hi(page_height, y1 + h * 0.15)),
        one("expand_to_nearby_lines", lo(x0 - 8), lo(y0 - 8), hi(page_width, x1 + 8), hi(page_height, y1 + 96)),
        one("expand_down_large", x0, y0, x1, hi(page_height, y1 + most(F.lit(100.0), h * 0.45))),
        one("expand_width_preserve_y", lo(x0 - w * 0.12), y0, hi(page_width, x1 + w * 0.12), y1),
    )
    found = F.when(action == "shrink_bbox", shrink).when(action == "expand_bbox", expand).otherwise(F.slice(shrink, 1, 0))
    good = F.filter(found, lambda v: (v["box"]["x1"] > v["box"]["x0"]) & (v["box"]["y1"] > v["box"]["y0"]))
    keys = F.transform(good, lambda v: F.concat_ws("|", *[F.round(v["box"][k], 1).cast("string") for k in ("x0", "y0", "x1", "y1")]))
    return F.filter(good, lambda v, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def parser_trust(parser: Column) -> Column:
    found = F.when(parser == "table_region_detector", 0.0)
    for prefix, value in PARSERS:
        found = found.when(parser.startswith(prefix), value)
    return found.otherwise(10.0)


def chunk_quality(parser: Column, consistency: Column, fill: Column, rows: Column, cols: Column, vision: Column, unparsed: Column) -> Column:
    s = parser_trust(parser) + consistency * 5 + fill * 3 + F.least(rows, F.lit(12)) * 0.25 + F.least(cols, F.lit(8)) * 0.2
    return s - F.when(vision, 4.0).otherwise(0.0) - F.when(unparsed, 30.0).otherwise(0.0)


def attempts(regions: DataFrame, chunks: DataFrame, families: list[str]) -> DataFrame:
    """(region, family, outcome): for every region and family whether a chunk of it came from the region."""
    got = chunks.select("region", "family", F.lit("success").alias("outcome")).distinct()
    every = regions.select("region", F.explode(F.array(*[F.lit(f) for f in families])).alias("family"))
    return every.join(got, ["region", "family"], "left").fillna("failure", ["outcome"])


def unparsed(regions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Regions of which no chunk came, as placeholder rows."""
    return regions.join(chunks.select("region"), "region", "left_anti").withColumn("content_type", F.lit("table")).withColumn("table_region_unparsed", F.lit(True))


def nearest_column(words: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """words with range: the column range of their page that holds a word's centre, else the nearest, ties to the left.

    Joins on the page, which is small by nature, and keeps one row per word in the aggregation."""
    middle = (F.col("x0") + F.col("x1")) / 2
    r = ranges.select(*keys, "range", F.col("x0").alias("lo"), F.col("x1").alias("hi"))
    far = F.greatest(F.col("lo") - middle, middle - F.col("hi"), F.lit(0.0))
    both = words.join(r, keys).withColumn("far", far)
    return both.groupBy(*keys, "id").agg(F.min_by("range", F.struct("far", "range")).alias("range"))


def three_lines(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Per region the three rules of a table (top, middle, bottom): its own, where it has just three; of more the best, by
    the body's height less twice what the header's height is off 14 points, ties to the upper ones. Headers are 6 to
    45 points high, bodies 45 at least; a region without such rules is left out."""
    ys = rules.select(*keys, "y").distinct()
    placed = ys.withColumns({"n": F.row_number().over(Window.partitionBy(*keys).orderBy("y")), "all": F.count("*").over(Window.partitionBy(*keys)), "bottom": F.max("y").over(Window.partitionBy(*keys))})
    head, body = F.col("middle") - F.col("top"), F.col("bottom") - F.col("middle")
    score = (body - F.abs(head - 14) * 2).alias("score")
    # The lowest rule makes the highest body, so it is the bottom of every best triple and no third join is needed.
    top = placed.select(*keys, F.col("y").alias("top"), F.col("n").alias("i"), "all")
    pairs = top.join(placed.select(*keys, F.col("y").alias("middle"), F.col("n").alias("j"), "bottom"), keys)
    fit = F.when(F.col("all") == 3, (F.col("i") == 1) & (F.col("j") == 2)).otherwise((F.col("all") > 3) & (F.col("i") < F.col("j")) & head.between(6, 45) & (body >= 45))
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "top", "middle")
    return pairs.filter(fit).select(*keys, "top", "middle", "bottom", score).withColumn("rank", F.row_number().over(best)).filter("rank = 1").drop("rank")
