"""Context around hits: distances between chunks, nearby ranks, restored anchors, reranker answers, expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import geometry as geo
from foliant.functions import payload as pl
from foliant.operators import retrieval as rt

# Words in a query that ask for evidence.
ASKING = ["which", "what", "find", "evidence", "passage", "reports", "report", "table", "figure", "image", "g l", "mg l"]


def place(**fields) -> Column:
    """struct(chunk_id, global_order, page, order_in_page, col, box, page_width, page_height), null where not given."""
    types = {"chunk_id": "string", "global_order": "long", "page": "int", "order_in_page": "long", "col": "int", "box": "struct<x0:double,y0:double,x1:double,y1:double>", "page_width": "double", "page_height": "double"}
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def _by_id(a: Column, b: Column, window: int) -> Column:
    p, q = pl.chunk_location(a["chunk_id"]), pl.chunk_location(b["chunk_id"])
    far = F.abs(p["y"] - q["y"])
    apart = F.coalesce(p["col"] != q["col"], F.lit(False))
    steps = F.when(far <= 120, 1).when((far <= 240) & F.lit(window >= 2), 2)
    return F.when((p["page"] == q["page"]) & ~apart, steps)


def _close(a: Column, b: Column, share: float = 0.12) -> Column:
    width = F.coalesce(F.when(a["page_width"] > 0, a["page_width"]), F.when(b["page_width"] > 0, b["page_width"]))
    height = F.coalesce(F.when(a["page_height"] > 0, a["page_height"]), F.when(b["page_height"] > 0, b["page_height"]))
    (ax, ay), (bx, by) = geo.center(a["box"]), geo.center(b["box"])
    return F.coalesce(F.hypot((ax - bx) / width, (ay - by) / height) <= share, F.lit(False))


def distance(a: Column, b: Column, window: int, by_column: bool = False) -> Column:
    """Steps between two places of a paper, null beyond `window`; the first rule with both values decides.

    Order in the paper, else, on one page, order there, else centres within 0.12 of the page (one step), else the
    places that the chunk ids name. With by_column, chunks of different columns are apart before their boxes are asked.
    """
    within = lambda x, y: F.when(F.abs(x - y) <= window, F.abs(x - y))
    both = lambda f: a[f].isNotNull() & b[f].isNotNull()
    last = F.when(_close(a, b), F.lit(1)).otherwise(_by_id(a, b, window))
    if by_column:
        last = F.when(both("col") & (a["col"] != b["col"]), F.lit(None).cast("int")).otherwise(last)
    on_page = F.when(both("order_in_page"), within(a["order_in_page"], b["order_in_page"])).otherwise(last)
    paged = F.when(~both("page"), _by_id(a, b, window)).when(a["page"] == b["page"], on_page)
    return F.when(both("global_order"), within(a["global_order"], b["global_order"])).otherwise(paged).cast("int")


def close_boxes(chunks: DataFrame, width: float, height: float, share: float = 0.12) -> DataFrame:
    """(id, other), id the smaller: the chunks(id, paper_id, page, box) of a page whose centres are within a share of it.

    Centres lie in a grid of that reach; a chunk meets those of its own and the eight cells around, not its whole page.
    """
    at = place(page=F.col("page"), box=F.col("box"), page_width=F.lit(width), page_height=F.lit(height)).alias("at")
    cell = lambda v, size: F.floor(v / (share * size)).cast("long")
    x, y = geo.center(F.col("box"))
    c = chunks.select("id", "paper_id", "page", at, cell(x, width).alias("cx"), cell(y, height).alias("cy"))
    around = lambda v: F.explode(F.sequence(F.col(v) - 1, F.col(v) + 1)).alias(v)
    left = c.select("id", "paper_id", "page", "at", around("cx"), "cy").select("id", "paper_id", "page", "at", "cx", around("cy"))
    right = c.select(F.col("id").alias("other"), "paper_id", "page", F.col("at").alias("there"), "cx", "cy")
    return left.join(right, ["paper_id", "page", "cx", "cy"]).filter((F.col("id") < F.col("other")) & _close(F.col("at"), F.col("there"), share)).select("id", "other")


def nearby_rank(hits: DataFrame, expected: DataFrame, window: int = 2) -> DataFrame:
    """(case_id, rank): first hit at or near an expected place, for hits(case_id, rank, paper_id, place) and
    expected(case_id, paper_id, place). Joins on case and paper, so what is compared stays small."""
    e = expected.select("case_id", "paper_id", F.col("place").alias("wanted"))
    near = (F.col("place.chunk_id") == F.col("wanted.chunk_id")) | distance(F.col("wanted"), F.col("place"), window, by_column=True).isNotNull()
    return hits.join(e, ["case_id", "paper_id"]).filter(near).groupBy("case_id").agg(F.min("rank").alias("rank"))


def first_rank(hits: DataFrame, expected: DataFrame, key: str = "id") -> DataFrame:
    """(case_id, rank) of the first hit that is expected."""
    return hits.join(expected.select("case_id", key), ["case_id", key]).groupBy("case_id").agg(F.min("rank").alias("rank"))


def restored(results: DataFrame, anchors: DataFrame, limit: int) -> DataFrame:
    """(id, rank, anchor_restored): the first `limit` results with every anchor among them, frames of (id, rank).

    Missing anchors, in order, fill the places left, then replace other results from the last upwards.
    """
    if limit <= 0:
        return results.filter(F.lit(False)).withColumn("anchor_restored", F.lit(False))
    kept = results.filter(F.col("rank") <= limit).join(anchors.select("id", F.lit(True).alias("anchor")), "id", "left")
    missing = anchors.join(kept.select("id"), "id", "left_anti").withColumn("turn", F.row_number().over(Window.orderBy("rank"))).select(F.col("id").alias("new"), "turn")
    whole = Window.partitionBy()  # `limit` rows
    kept = kept.withColumn("n", F.count("*").over(whole)).withColumn("turn", F.when(F.col("anchor").isNull(), F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("rank"))) + limit - F.col("n")))
    filled = kept.select(F.max("n").alias("n")).select(F.explode(F.sequence(F.coalesce("n", F.lit(0)) + 1, F.lit(limit))).alias("rank"), "n")
    free = filled.filter(F.coalesce("n", F.lit(0)) < limit).select(F.lit(None).cast("long").alias("id"), "rank", (F.col("rank") - F.coalesce("n", F.lit(0))).alias("turn"))
    slots = kept.select("id", "rank", "turn").unionByName(free).join(missing, "turn", "left")
    out = slots.select(F.coalesce("new", "id").alias("id"), "rank", F.col("new").isNotNull().alias("anchor_restored"))
    return out.filter("id IS NOT NULL")


def reranked(hits: DataFrame, answer: DataFrame, most: int = 500) -> DataFrame:
    """(id, rank, score, reranked) for hits(id, rank, score) and a reranker's answer(place, index, relevance).

    index counts the first `most` hits from 0. Named hits come first in the answer's order with its score, each once;
    all others follow in theirs. An empty answer leaves the order as it was.
    """
    named = answer.filter((F.col("index") >= 0) & (F.col("index") < most)).groupBy("index").agg(F.min(F.struct("place", "relevance")).alias("a"))
    both = hits.join(F.broadcast(named.select((F.col("index") + 1).alias("rank"), "a")), "rank", "left")  # `most` rows
    order = Window.orderBy(F.col("a").isNull(), "a.place", "rank")
    return both.select("id", F.row_number().over(order).alias("rank"), F.coalesce("a.relevance", "score").alias("score"), F.col("a").isNotNull().alias("reranked"))


def fielded(hits: DataFrame, score: Column, weight: float) -> DataFrame:
    """Adds weight times a fielded score, at most 1.5, to the scores of hits that have one."""
    s = hits.withColumn("fielded", score)
    return s.withColumn("score", F.when(F.col("fielded") > 0, F.col("score") + F.least(F.col("fielded") * weight, F.lit(1.5))).otherwise(F.col("score")))


def expanded(local: DataFrame, near: DataFrame, hits: DataFrame, total: int) -> DataFrame:
    """(id, rank, origin): chunks of the hits' papers first, then neighbours, up to `total`; neither repeats a hit."""
    both = local.select("id", "score", F.lit(0).alias("origin")).unionByName(near.select("id", "score", F.lit(1).alias("origin")))
    rows = rt.distinct_first(both.join(hits.select("id"), "id", "left_anti"), ["id"], ["origin", F.desc("score")])
    cut = rows.orderBy("origin", F.desc("score"), "id").limit(total)
    return cut.select("id", F.row_number().over(Window.orderBy("origin", F.desc("score"), "id")).alias("rank"), "origin")


def fetch_factor(*backfills: bool) -> int:
    """How many times the wanted hits are read first: 8 where a later step reorders or adds, else 2."""
    return 8 if any(backfills) else 2


def pool_limit(limit: int, papers: int, per_paper: int, lead: int) -> int:
    return max(limit * 8, papers * max(per_paper, lead))


def asks_for_evidence(normalized_query: str, hits: int, limit: int) -> bool:
    """A reranker is worth its call: two hits or more, and a word that asks for evidence."""
    return hits >= 2 and limit > 0 and any(w in normalized_query for w in ASKING)


def searched(pool: DataFrame, near: DataFrame, lexical: Column, limit: int) -> DataFrame:
    """Hits after every step: pool(id, rank, score, ...) widened by neighbours, boosted by the lexical score, and the
    first hits of the pool put back where the boost pushed them out."""
    both = rt.append_unique(pool.drop("rank"), near.select(*pool.drop("rank").columns))
    score = F.col("score") + F.when(lexical > 0, F.least(lexical, F.lit(0.35))).otherwise(0.0)
    best = both.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "id").limit(limit)
    ranked = best.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))
    return restored(ranked, pool.filter(F.col("rank") <= rt.anchors_kept(limit)).select("id", "rank"), limit)
