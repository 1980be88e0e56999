"""Merging and grouping of neighbours in reading order: headings, page heads, runs of lines, figures, batches, regions.

Pairs that consume each other need no loop: in a run of rows that could each take their successor, every other one
does. Folds over words and chunks let sorted rows stream by; grouped pandas functions see no more than the figures or
regions of one page, or the regions of one caption.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import geometry as geo

# How a page's head, a figure's parts and a batch are bounded.
HEAD_ZONE, HEAD_GAP, TITLE_WORDS = 0.35, 20.0, 12
FIGURE_GAP = 80.0
BATCH_CHUNKS, BATCH_CHARS = 4, 9000
SAME_BOX = 0.80
LINE_SNAP = 3.0
FIGURE = r"(?i)\b(?:Figure|Fig\.)\s*([0-9]+[A-Za-z]?)"
# Words that open a section.
SECTIONS = [
    "ABSTRACT", "KEYWORDS", "INTRODUCTION", "METHODS", "RESULTS", "DISCUSSION", "CONCLUSION", "CONCLUSIONS", "REFERENCES", "BACKGROUND",
    "ACKNOWLEDGEMENTS", "ACKNOWLEDGMENTS", "FUNDING", "DISCLOSURE", "摘要", "关键词", "参考文献", "致谢", "基金",
]
TABLE_NUMBER = r"(?:supplementary\s+table|table|tab\.)\s*(s?\d+)"
CONTINUED = r"\bcontinued\b|\bcontinuation\b|\bcont\.\b"


def starts_section(text: Column) -> Column:
    """The first word, without colon and stop, opens a section; a blank text does not."""
    first = F.get(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), F.lit(0))
    return F.upper(F.rtrim(first, F.lit(":."))).isin(SECTIONS)


def is_heading(text: Column, level: Column) -> Column:
    """A short text that its parser calls a heading, or up to eight words in capitals; no sentence that ends in a colon."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n = F.size(F.regexp_extract_all(t, F.lit(r"([A-Za-z][A-Za-z-]*)"), 1))
    letters = F.regexp_replace(t, "[^A-Za-z]+", "")
    capitals = n.between(1, 8) & (F.length(letters) >= 4) & (F.upper(letters) == letters)
    leads_in = t.endswith(":") & (F.size(F.split(t, r"\s+")) > 4)
    return (t != "") & ~leads_in & F.when(level >= 1, F.length(t) <= 120).otherwise(capitals)


def _next(c: str, w) -> Column:
    return F.lead(c).over(w)


def _paired(chunks: DataFrame, takes: Column, keys: list[str], order: str) -> DataFrame:
    """Adds takes (merges with the row behind it) and taken (merged into the row before it).

    A row that is taken takes none: of consecutive rows that could take their successor the first, third, ... do.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = chunks.withColumn("could", F.coalesce(takes, F.lit(False)))
    rows = rows.withColumn("run", F.sum((~F.col("could")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.coalesce("run", F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*keys, "run").orderBy(order))
    rows = rows.withColumn("takes", F.col("could") & (place % 2 == 1))
    return rows.withColumn("taken", F.coalesce(F.lag("takes").over(w), F.lit(False))).drop("could", "run")


def _ordered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds global_order within the paper and order_in_page, both from 0."""
    page = Window.partitionBy(*keys, "page").orderBy(order)
    return rows.withColumns({"global_order": F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1, "order_in_page": F.row_number().over(page) - 1})


def with_headings(chunks: DataFrame) -> DataFrame:
    """Headings joined to the text chunk behind them on their page: chunks(paper_id, ord, page, content_type, text, level, box).

    Adds attached_heading; the merged chunk has the box around both and the id of the text. Orders count anew.
    """
    w = Window.partitionBy("paper_id").orderBy("ord")
    follows = (_next("content_type", w) == "text") & (_next("page", w) == F.col("page"))
    rows = _paired(chunks, (F.col("content_type") == "text") & is_heading(F.col("text"), F.col("level")) & follows, ["paper_id"], "ord")
    head = F.lag(F.struct(F.trim("text").alias("text"), "box")).over(w)
    rows = rows.withColumn("head", F.when(F.col("taken"), head)).filter(~F.col("takes"))
    merged = rows.withColumn("attached_heading", F.col("head.text"))
    merged = merged.withColumn("text", F.when(F.col("taken"), F.concat_ws("\n\n", "head.text", F.trim("text"))).otherwise(F.col("text")))
    merged = merged.withColumn("box", F.when(F.col("taken"), geo.union(F.col("box"), F.col("head.box"))).otherwise(F.col("box")))
    return _ordered(merged.drop("head", "takes", "taken"), ["paper_id"], "ord")


def with_page_heads(chunks: DataFrame, page_height: float) -> DataFrame:
    """Neighbouring text blocks in the top of a page made one: chunks(paper_id, ord, page, col, content_type, text, box).

    The upper block has twelve words or more, the lower one starts at most 20 points below and opens no section, and
    both stand in one column or one of them across the page. The merged chunk keeps the upper one's id.
    """
    w = Window.partitionBy("paper_id").orderBy("ord")
    zone = page_height * HEAD_ZONE
    gap = _next("box", w)["y0"] - F.col("box.y1")
    text = (F.col("content_type") == "text") & (_next("content_type", w) == "text")
    place = (F.col("page") == _next("page", w)) & (F.col("box.y0") < zone) & (_next("box", w)["y0"] < zone) & gap.between(0.0, HEAD_GAP)
    column = (F.col("col") == _next("col", w)) | (F.greatest(F.col("col"), _next("col", w)) == 2)
    long = F.size(F.split(F.trim("text"), r"\s+")) >= TITLE_WORDS
    rows = chunks.withColumn("opens", starts_section(F.col("text")))
    rows = _paired(rows, text & place & column & long & ~_next("opens", w), ["paper_id"], "ord")
    low = F.lead(F.struct("text", "box", "col")).over(w)
    rows = rows.withColumn("low", F.when(F.col("takes"), low)).filter(~F.col("taken"))
    b, n = F.col("box"), F.col("low.box")
    box = F.struct(F.least(b["x0"], n["x0"]).alias("x0"), b["y0"].alias("y0"), F.greatest(b["x1"], n["x1"]).alias("x1"), n["y1"].alias("y1"))
    merged = rows.withColumn("text", F.concat_ws("\n", "text", "low.text")).withColumn("col", F.greatest("col", "low.col")).withColumn("box", F.when(F.col("takes"), box).otherwise(b))
    return merged.drop("low", "takes", "taken", "opens")


def runs(lines: DataFrame, good: Column, keys: list[str], order: str, least: int = 3) -> DataFrame:
    """(keys, first, last, n): unbroken runs of at least `least` good lines."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = lines.withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("run", F.sum((~F.col("good")).cast("int")).over(w)).filter("good")
    return rows.groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("run")


def text_lines(words: DataFrame, snap: float = LINE_SNAP) -> DataFrame:
    """(paper_id, page, line, text, x0, top, x1, bottom): words of a page put into lines.

    From top to bottom a word joins the lowest line whose first word stands within `snap`, else it begins a line.
    Sorted by top, that is always the line begun last, but compared to its first word: hence a fold, in which rows stream
    by in order. A null paper or page counts as empty or 0; words without a place are left out.
    """

    def put(parts):
        at, line, start = None, -1, 0.0
        for p in parts:
            out = []
            for paper, page, top in zip(p["paper_id"], p["page"], p["top"]):
                if (paper, page) != at:
                    at, line, start = (paper, page), 0, top
                elif top - start > snap:
                    line, start = line + 1, top
                out.append(line)
            yield p.assign(line=out)

    rows = words.filter("top IS NOT NULL AND x0 IS NOT NULL").select(
        F.coalesce("paper_id", F.lit("")).alias("paper_id"), F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("text", F.lit("")).alias("text"), "x0", "top", "x1", "bottom"
    )
    rows = rows.repartition("paper_id", "page").sortWithinPartitions("paper_id", "page", "top", "x0", "text")
    put_in = rows.mapInPandas(put, "paper_id string, page int, text string, x0 double, top double, x1 double, bottom double, line long")
    joined = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " "))
    lines = put_in.groupBy("paper_id", "page", "line").agg(joined.alias("text"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    return lines.filter("text <> ''")


def figure_label(caption: Column) -> Column:
    """`Figure 2a`, or the empty text."""
    number = F.regexp_extract(F.coalesce(caption, F.lit("")), FIGURE, 1)
    return F.when(number != "", F.concat(F.lit("Figure "), number)).otherwise("")


def figure_groups(visuals: DataFrame) -> DataFrame:
    """(id, group_id, label, role) for visuals(paper_id, page, ord, id, caption, y0, y1), in order on their page.

    A captioned part takes the open parts before it; a part without caption joins the last figure where it overlaps it
    in height or stands within 80 points of it, else it stays open. Parts that stay open are single.
    """

    def put(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["ord", "id"])
        number, figures, waiting, top, low, out = page["page"].iloc[0], 0, [], 0.0, 0.0, []
        name = label = ""
        for r in page.itertuples():
            if r.label:
                figures, label = figures + 1, r.label
                name = f"figure_p{number}_{figures:03d}"
                top, low = min([r.y0, *(w.y0 for w in waiting)]), max([r.y1, *(w.y1 for w in waiting)])
                out += [(w.id, name, label, "part") for w in waiting] + [(r.id, name, label, "caption_owner")]
                waiting = []
            elif figures and (min(r.y1, low) > max(r.y0, top) or min(abs(r.y0 - low), abs(top - r.y1)) <= FIGURE_GAP):
                top, low = min(top, r.y0), max(low, r.y1)
                out.append((r.id, name, label, "part"))
            else:
                waiting.append(r)
        out += [(w.id, f"figure_p{number}_ungrouped_{w.id}", "", "single") for w in waiting]
        return pd.DataFrame(out, columns=["id", "group_id", "label", "role"])

    rows = visuals.select("paper_id", "page", "ord", "id", "y0", "y1", figure_label(F.col("caption")).alias("label"))
    return rows.groupBy("paper_id", "page").applyInPandas(put, "id long, group_id string, label string, role string")


def batches(chunks: DataFrame, most: int = BATCH_CHUNKS, chars: int = BATCH_CHARS) -> DataFrame:
    """(paper_id, ord, id, batch): consecutive chunks of a paper, at most `most` and `chars` characters each; a longer
    chunk stands alone. Rows stream by in order, so that a paper of any length needs no more memory than a batch of rows."""

    def put(parts):
        paper, batch, held, size = None, -1, 0, 0
        for p in parts:
            out = []
            for r in p.itertuples():
                if (r.paper_id or "") != paper:
                    paper, batch, held, size = r.paper_id or "", 0, 0, 0
                elif held >= most or (held and size + r.chars > chars):
                    batch, held, size = batch + 1, 0, 0
                held, size = held + 1, size + r.chars
                out.append(batch)
            yield p[["paper_id", "ord", "id"]].assign(batch=out)

    rows = chunks.select("paper_id", "ord", "id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    rows = rows.repartition("paper_id").sortWithinPartitions("paper_id", "ord", "id")
    return rows.mapInPandas(put, "paper_id string, ord long, id long, batch long")


def distinct_boxes(boxes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first of the boxes of a key that are equal to a tenth of a point."""
    tenth = [F.bround(F.col(f"box.{c}"), 1) for c in ("x0", "y0", "x1", "y1")]
    w = Window.partitionBy(*keys, *tenth).orderBy(order)
    return boxes.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def _area(b):
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def _shared(a, b):
    return _area((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])))


def _shares(a, b):
    """IoU and the shares of each box that both cover."""
    both, p, q = _shared(a, b), _area(a), _area(b)
    return (both / (p + q - both) if both else 0.0, both / p if p else 0.0, both / q if q else 0.0)


def merged_boxes(boxes: DataFrame) -> DataFrame:
    """(paper_id, page, place, x0, y0, x1, y1): candidate boxes of a page, in order of ord, each merged into the first one that
    it matches (IoU, or the smaller share of the two, 0.8 or more); empty boxes are left out."""

    def put(page: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for r in page.sort_values(["ord", "x0", "y0", "x1", "y1"]).itertuples():
            b = (r.x0, r.y0, r.x1, r.y1)
            if not (b[0] < b[2] and b[1] < b[3]):
                continue
            same = (i for i, k in enumerate(kept) for u, p, q in [_shares(b, k)] if max(u, min(p, q)) >= SAME_BOX)
            at = next(same, None)
            if at is None:
                kept.append(b)
            else:
                k = kept[at]
                kept[at] = (min(k[0], b[0]), min(k[1], b[1]), max(k[2], b[2]), max(k[3], b[3]))
        out = pd.DataFrame(kept, columns=["x0", "y0", "x1", "y1"])
        return out.assign(paper_id=page["paper_id"].iloc[0], page=page["page"].iloc[0], place=range(len(out)))

    rows = boxes.select("paper_id", "page", "ord", "box.*")
    return rows.groupBy("paper_id", "page").applyInPandas(put, "paper_id string, page int, place long, x0 double, y0 double, x1 double, y1 double")


def _ranked(page: pd.DataFrame) -> pd.DataFrame:
    """Ruled regions first, then captioned ones, then by confidence, evidence and height; narrow and high ones first."""
    by = page.assign(height=page["y1"] - page["y0"], width=page["x1"] - page["x0"])
    down = ["ruled", "captioned", "confidence", "evidence", "height"]
    return by.sort_values([*down, "width", "y0", "id"], ascending=[False] * 5 + [True] * 3, kind="stable")


def caption_key(caption: Column) -> Column:
    """The number of the table that a caption names, else its first 80 characters in lower case; empty without caption."""
    low = F.lower(F.trim(F.coalesce(caption, F.lit(""))))
    number = F.regexp_extract(low, TABLE_NUMBER, 1)
    return F.when(number != "", number).otherwise(F.substring(F.regexp_replace(low, r"\s+", " "), 1, 80))


def caption_title(caption: Column) -> Column:
    """What a caption says behind the table's number, in lower-case words."""
    rest = F.regexp_replace(F.lower(F.trim(F.coalesce(caption, F.lit("")))), rf"^{TABLE_NUMBER}[.:]?\s*", "")
    return F.trim(F.regexp_replace(rest, "[^a-z0-9]+", " "))


def _nested(a, b) -> bool:
    """The smaller one lies in the other: 0.9 of its height and 0.85 of its width."""
    heights, widths = (a[3] - a[1], b[3] - b[1]), (a[2] - a[0], b[2] - b[0])
    if min(*heights, *widths) <= 0:
        return False
    return max(0.0, min(a[3], b[3]) - max(a[1], b[1])) / min(heights) >= 0.90 and max(0.0, min(a[2], b[2]) - max(a[0], b[0])) / min(widths) >= 0.85


def _stacked(a, b) -> bool:
    """One above the other: 0.6 of the smaller width shared, at most 120 points between them."""
    width = min(a[2] - a[0], b[2] - b[0])
    return width > 0 and max(0.0, min(a[2], b[2]) - max(a[0], b[0])) / width >= 0.60 and max(a[1], b[1]) - min(a[3], b[3]) <= 120.0


def without_overlaps(regions: DataFrame) -> DataFrame:
    """(id) of the regions that stay, judged from the best down.

    regions(paper_id, page, id, caption, ruled, captioned, confidence, evidence, box). A region goes where a kept one of
    its page is the same table (covers to 0.8, nested, or stacked under the same caption), unless their confidences
    differ by more than 0.3 and their areas by less than a fifth.
    """

    def put(page: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for r in _ranked(page).itertuples():
            b = (r.x0, r.y0, r.x1, r.y1)

            def same(k, confidence, key, r=r, b=b):
                one = max(_shares(b, k)) >= SAME_BOX or _nested(b, k) or (r.key != "" and r.key == key and _stacked(b, k))
                small, large = sorted((_area(b), _area(k)))
                return one and (abs(r.confidence - confidence) <= 0.30 or small <= large * 0.80)

            if not any(same(*k[:3]) for k in kept):
                kept.append((b, r.confidence, r.key, r.id))
        return pd.DataFrame({"id": [k[3] for k in kept]})

    rows = regions.select("paper_id", "page", "id", caption_key(F.col("caption")).alias("key"), "box.*", "ruled", "captioned", "confidence", "evidence")
    return rows.groupBy("paper_id", "page").applyInPandas(put, "id long")


def without_repeated_captions(regions: DataFrame) -> DataFrame:
    """(id) of the regions whose caption no better region of another page of the paper has.

    Captions are the same where their keys are and their titles agree: one empty, equal, or the shorter one, of twelve
    characters or more, begins the longer. Continuations stay, and so do regions without caption.
    """

    def put(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for r in _ranked(group).itertuples():

            def agrees(page, title, r=r):
                short, long = sorted((r.title, title), key=len)
                return r.page != page and (short in ("", long) or (len(short) >= 12 and long.startswith(short)))

            if not any(agrees(*k[:2]) for k in kept):
                kept.append((r.page, r.title, r.id))
        return pd.DataFrame({"id": [k[2] for k in kept]})

    rows = regions.withColumns({"key": caption_key(F.col("caption")), "title": caption_title(F.col("caption"))})
    open_ = (F.col("key") == "") | F.col("caption").rlike(f"(?i){CONTINUED}")
    judged = rows.filter(~F.coalesce(open_, F.lit(True))).select("paper_id", "key", "title", "page", "id", "box.*", "ruled", "captioned", "confidence", "evidence")
    return rows.filter(F.coalesce(open_, F.lit(True))).select("id").unionByName(judged.groupBy("paper_id", "key").applyInPandas(put, "id long"))
