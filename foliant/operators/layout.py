"""Page layout: duplicates among chunks, reading order, sections, neighbours in order.

Chunks are rows with paper_id, page, id, content_type, box (struct of x0, y0, x1, y1), col and text. All windows and
self-joins are within one page of one paper, or within one paper.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import geometry as geo

# Fixed values of the layout rules.
IOU = 0.5
SIMILARITY = 0.8
CONTAINED = 0.7
PRIORITY = {"table": 0, "text": 1, "image": 2}
FOOTER = 0.85
SIDEBAR = 30.0


def _grams(text: Column) -> Column:
    """Character 3-grams of the padded text; the characters themselves where it is very short."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    n = F.length(padded)
    grams = F.transform(F.sequence(F.lit(1), n - 3), lambda i: F.substring(padded, i, F.lit(3)))
    chars = F.filter(F.split(F.trim(padded), ""), lambda c: c != "")
    return F.array_distinct(F.when(n < 5, chars).otherwise(grams))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of words, or of character 3-grams where either text has fewer than ten words."""
    a, b = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    short = (F.size(words(a)) < 10) | (F.size(words(b)) < 10)
    x, y = (F.when(short, _grams(c)).otherwise(F.array_distinct(words(c))) for c in (a, b))
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when((a == "") | (b == "") | (either == 0), 0.0).otherwise(both / either)


def overlapping_pairs(chunks: DataFrame) -> DataFrame:
    """(paper_id, page, i, j, iou): pairs of a page, i before j, that overlap by more than IOU."""
    a = chunks.select("paper_id", "page", F.col("id").alias("i"), F.col("box").alias("a"))
    b = chunks.select("paper_id", "page", F.col("id").alias("j"), F.col("box").alias("b"))
    return a.join(b, ["paper_id", "page"]).filter(F.col("i") < F.col("j")).withColumn("iou", geo.iou(F.col("a"), F.col("b"))).filter(F.col("iou") > IOU).select("paper_id", "page", "i", "j", "iou")


def text_in_tables(chunks: DataFrame) -> DataFrame:
    """Text chunks that lie in a table of their page: contained by CONTAINED, or with their centre inside."""
    t = chunks.filter("content_type = 'table'").select("paper_id", "page", F.col("box").alias("t"))
    inside = (geo.contained(F.col("box"), F.col("t")) >= CONTAINED) | geo.center_inside(F.col("box"), F.col("t"))
    return chunks.filter("content_type = 'text'").join(t, ["paper_id", "page"]).filter(inside).select("paper_id", "page", "id").distinct()


def conflicts(chunks: DataFrame) -> DataFrame:
    """(paper_id, page, i, j, loser): pairs of a page, i before j, of which one has to go. A text in or near a table goes; of
    two that overlap with like texts the one of lower priority goes, the later of equals."""
    own = chunks.select("paper_id", "page", "id", "content_type", "box", "text")
    a = own.select("paper_id", "page", *[F.col(c).alias(f"{c}_i") for c in ("id", "content_type", "box", "text")])
    b = own.select("paper_id", "page", *[F.col(c).alias(f"{c}_j") for c in ("id", "content_type", "box", "text")])
    kinds, text_first = F.concat_ws(" ", "content_type_i", "content_type_j"), F.col("content_type_i") == "text"
    inside = lambda t, o: (geo.contained(t, o) >= CONTAINED) | geo.center_inside(t, o)
    mixed = kinds.isin("text table", "table text")
    in_table = F.when(text_first, inside(F.col("box_i"), F.col("box_j"))).otherwise(inside(F.col("box_j"), F.col("box_i")))
    alike = (geo.iou(F.col("box_i"), F.col("box_j")) > IOU) & (similarity(F.col("text_i"), F.col("text_j")) > SIMILARITY)
    rank = lambda c: F.when(F.col(c) == "table", PRIORITY["table"]).when(F.col(c) == "text", PRIORITY["text"]).when(F.col(c) == "image", PRIORITY["image"]).otherwise(99)
    loser = F.when(mixed, F.when(text_first, F.col("id_i")).otherwise(F.col("id_j"))).when(rank("content_type_i") <= rank("content_type_j"), F.col("id_j")).otherwise(F.col("id_i"))
    pairs = a.join(b, ["paper_id", "page"]).filter((F.col("id_i") < F.col("id_j")) & F.when(mixed, in_table).otherwise(alike))
    return pairs.select("paper_id", "page", F.col("id_i").alias("i"), F.col("id_j").alias("j"), loser.alias("loser"))


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    gone: set = set()
    for p in pdf.sort_values(["i", "j"]).itertuples():
        if p.i not in gone and p.j not in gone:
            gone.add(p.loser)
    return pd.DataFrame({"id": sorted(gone)})


def deduplicated(chunks: DataFrame) -> DataFrame:
    """(id, paper_id, page) of the chunks that stay when conflicts() are settled in order, a chunk that is gone having none.

    Pairs are found without their order, in the JVM; only the ids of a page's conflicts go through the ordered pass."""
    gone = conflicts(chunks).groupBy("paper_id", "page").applyInPandas(_greedy, "id long")
    return chunks.select("id", "paper_id", "page").join(gone, "id", "left_anti")


def reading_order(chunks: DataFrame, page_height: float) -> DataFrame:
    """Adds bucket, order_in_page and global_order: wide heads, body with left column, right column, feet."""
    page = Window.partitionBy("paper_id", "page")
    y0, y1 = F.col("box.y0"), F.col("box.y1")
    twin = F.col("col") < 2
    left = F.collect_list(F.when(F.col("col") == 0, F.struct(y0.alias("a"), y1.alias("b")))).over(page)
    c = chunks.withColumns({"lo": F.min(F.when(twin, y0)).over(page), "hi": F.max(F.when(twin, y1)).over(page), "lefts": left})
    beside = F.exists("lefts", lambda r: (F.abs(r["a"] - F.col("box.y0")) < SIDEBAR) | F.col("box.y0").between(r["a"], r["b"]))
    foot = y0 >= page_height * FOOTER
    bucket = (
        F.when(foot, 3)
        .when((F.col("col") == 2) & (F.col("lo").isNull() | (y0 < F.col("lo"))), 0)
        .when((F.col("col") == 2) & (y1 > F.col("hi")), 3)
        .when(F.col("col") < 1, 1)
        .when(F.col("col") == 2, 1)
        .when(~beside, 1)
        .otherwise(2)
    )
    sub = F.when(~foot & (F.col("bucket") == 1) & (F.col("col") > 0), 1).otherwise(0)
    c = c.withColumn("bucket", bucket).withColumn("sub", sub)
    key = ["bucket", "box.y0", "sub", "box.x0", "id"]
    c = c.withColumn("order_in_page", F.row_number().over(page.orderBy(*key)) - 1)
    return c.withColumn("global_order", F.row_number().over(Window.partitionBy("paper_id").orderBy("page", *key)) - 1).drop("lo", "hi", "lefts", "sub")


def nearby_context(chunks: DataFrame, most: int = 100) -> DataFrame:
    """The first characters of the chunks before and behind, within a paper."""
    w = Window.partitionBy("paper_id").orderBy("ord")
    head = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, most)
    return chunks.withColumns({"before": head(F.lag("text").over(w)), "behind": head(F.lead("text").over(w))})


def sections(chunks: DataFrame, is_heading: Column) -> DataFrame:
    """Adds section: how many headings stand up to here in the paper."""
    w = Window.partitionBy("paper_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chunks.withColumn("section", F.sum(is_heading.cast("int")).over(w))


def is_noise(text: Column) -> Column:
    """Blank, under 40 characters, without a letter, or a running head."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(t) < 40) | ~t.rlike("[A-Za-z]")


def page_sizes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("paper_id", "page").agg(F.max("box.x1").alias("width"), F.max("box.y1").alias("height"))


def best_region(tables: DataFrame, regions: DataFrame, least: float = 0.1) -> DataFrame:
    """(id, region, share): the region of its page that covers most of a table, ties to the smaller region."""
    r = regions.select("paper_id", "page", F.col("id").alias("region"), F.col("box").alias("r"))
    both = tables.join(r, ["paper_id", "page"]).withColumn("share", geo.contained(F.col("box"), F.col("r"))).filter((F.col("share") >= least) & (F.col("id") != F.col("region")))
    w = Window.partitionBy("id").orderBy(F.desc("share"), "region")
    return both.withColumn("n", F.row_number().over(w)).filter("n = 1").select("id", "region", "share")


def captions(images: DataFrame, texts: DataFrame, reach: float = 80.0, most: int = 2) -> DataFrame:
    """(id, caption): up to `most` text chunks that start within reach below an image, nearest first."""
    t = texts.select("paper_id", "page", F.col("id").alias("text_id"), F.col("box.y0").alias("top"))
    gap = F.col("top") - F.col("box.y1")
    near = images.join(t, ["paper_id", "page"]).withColumn("gap", gap).filter(F.col("gap").between(0, reach))
    w = Window.partitionBy("id").orderBy("gap", "text_id")
    return near.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("id", "text_id", "n")


def column_ranges(words: DataFrame, gap: float = 8.0) -> DataFrame:
    """(paper_id, page, range, x0, x1): spans of words merged where the gap between them is smaller than `gap`."""
    w = Window.partitionBy("paper_id", "page").orderBy("x0", "x1")
    far = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = words.withColumn("new", (far.isNull() | (F.col("x0") - far >= gap)).cast("int"))
    own = starts.withColumn("range", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return own.groupBy("paper_id", "page", "range").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
