"""Retrieval: lexical, vector and sparse scoring, fusion of ranked lists, evidence groups.

Hits are rows with id, score and whatever else they carry. Every ranking is by score, largest first, ties by id.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx


def top(df: DataFrame, n: int, score: str = "score", *ties: str) -> DataFrame:
    return df.orderBy(F.desc(score), *(ties or ("id",))).limit(n)


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def has_anchor(normalized: Column) -> Column:
    return F.contains(normalized, F.lit("lnt ii")) | F.contains(normalized, F.lit("lacto n triose ii"))


def needs_anchor(query: str) -> bool:
    return "lnt ii" in tx.normalize_query(query)


def lexical_score(normalized: Column, query: str, idf: dict[str, float] | None = None) -> Column:
    """Weights of the query's terms that stand in the text (times their idf), and 0.12 for an experiment report; 0
    where the query names a strict anchor that the text lacks."""
    parts = [F.when(F.contains(normalized, F.lit(t)), w * (idf or {}).get(t, 1.0)).otherwise(0.0) for t, w in tx.query_terms(query).items() if t != "lnt"]
    parts.append(F.when(F.contains(normalized, F.lit("fermentation experiment")), 0.12).otherwise(0.0))
    score = total(parts)
    return F.when(has_anchor(normalized), score).otherwise(0.0) if needs_anchor(query) else score


def term_frequencies(entries: DataFrame) -> DataFrame:
    """(term, df): documents that hold a term, over entries(id, normalized)."""
    return entries.select(F.explode(tx.index_terms(F.col("normalized"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf_of_query(frequencies: DataFrame, documents: int, query: str) -> dict[str, float]:
    """idf of each query term: that of its rarest indexed token, 1 where none is indexed. Only the query's tokens are read
    of frequencies(term, df)."""
    tokens = {t: tx.query_index_terms(t) for t in tx.query_terms(query)}
    wanted = sorted({x for ts in tokens.values() for x in ts})
    df = {r["term"]: r["df"] for r in frequencies.filter(F.col("term").isin(wanted)).collect()}
    n = max(documents, 1)
    return {t: (1.0 + math.log((n + 1) / (min([df[x] for x in ts if x in df], default=n) + 1)) if ts else 1.0) for t, ts in tokens.items()}


def candidate_pool(postings: DataFrame, frequencies: DataFrame, query: str, limit: int) -> DataFrame:
    """(id) of the entries that hold one of the query's rarest tokens: tokens are taken from the rarest on, none that is
    too common, until their postings hold enough different entries (three tokens at least, twelve at most).

    Only the postings of at most twelve tokens are read. An entry counts for the first of them that it holds, so
    twelve counts tell where to stop.
    """
    pool = max(limit * 8, 1000)
    wanted = sorted({x for t in tx.query_terms(query) for x in tx.query_index_terms(t)})
    rare = frequencies.filter(F.col("term").isin(wanted) & (F.col("df") <= max(2 * pool, 2000))).orderBy("df", "term").limit(12).collect()
    if not rare:
        return postings.select("id").limit(0)
    place = F.lit(len(rare))
    for k, r in reversed(list(enumerate(rare))):
        place = F.when(F.col("term") == r["term"], k).otherwise(place)
    first = postings.filter(F.col("term").isin([r["term"] for r in rare])).groupBy("id").agg(F.min(place).alias("place"))
    new = {r["place"]: r["count"] for r in first.groupBy("place").count().collect()}
    seen, last = 0, len(rare) - 1
    for k in range(len(rare)):
        seen += new.get(k, 0)
        if seen >= pool and k >= 2:
            last = k
            break
    return first.filter(F.col("place") <= last).select("id")


def matched_terms(items: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """(key, term, df): the indexed terms of items(key, normalized) and how many documents hold them. Postings are counted
    by term before they meet the items, so a common term brings one row for each item."""
    wanted = items.select(key, F.explode(tx.index_terms(F.col("normalized"))).alias("term"))
    return wanted.join(postings.groupBy("term").agg(F.count("*").alias("df")), "term").select(key, "term", "df")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda p, q: F.pow(p.cast("double") - q.cast("double"), F.lit(2.0)))
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v)


def sparse_dot(points: DataFrame, query: dict[int, float]) -> DataFrame:
    """(id, score) for points(id, sparse: map<int,float>): only the query's dimensions are read of each map."""
    parts = [F.coalesce(F.element_at("sparse", F.lit(k)).cast("double"), F.lit(0.0)) * F.lit(float(v)) for k, v in sorted(query.items())]
    return points.select("id", total(parts).alias("score")).filter(F.col("score") != 0)


def reciprocal_rank(lists: DataFrame, k: float = 60.0) -> DataFrame:
    """(id, score) from lists(route, id, rank, weight): the sum of weight / (k + rank)."""
    return lists.groupBy("id").agg(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))).alias("score"))


def anchors_kept(limit: int) -> int:
    """How many of the first hits a later step may not push out."""
    return 0 if limit <= 0 else min(limit, 3) if limit <= 5 else min(limit, max(5, limit // 2))


def multi_query(lists: DataFrame, limit: int, raw: str = "raw") -> DataFrame:
    """Weighted reciprocal-rank fusion of lists(route, weight, id, paper_id, rank, raw_score); the raw route counts 1.05-fold.

    The first hits of the raw route stay in front. Behind them come hits of the raw route, then those of two routes
    or more, then others; a hit of one other route is admitted only from a paper that the protected hits name, or
    where the raw route has too few hits.
    """
    keep = anchors_kept(limit)
    own = F.col("route") == raw
    fused = F.col("weight") / (60.0 + F.col("rank")) * F.when(own, 1.05).otherwise(1.0)
    merged = lists.groupBy("id", "paper_id").agg(
        F.sum(fused).alias("score"), F.max("raw_score").alias("raw_score"), F.min(F.when(own, F.col("rank"))).alias("raw_rank"),
        F.array_sort(F.collect_set("route")).alias("matched_routes"),
    )
    merged = merged.withColumn("protected", F.coalesce(F.col("raw_rank") <= keep, F.lit(False)))
    whole = Window.partitionBy()  # as many rows as the lists hold, which are cut already
    merged = merged.withColumns({"n_raw": F.count("raw_rank").over(whole), "papers": F.collect_set(F.when(F.col("protected"), F.col("paper_id"))).over(whole)})
    routes = F.size("matched_routes")
    admitted = F.col("raw_rank").isNotNull() | (F.col("n_raw") < keep) | (routes >= 2) | F.array_contains("papers", F.col("paper_id"))
    priority = F.when(F.col("raw_rank").isNotNull(), 3).when(routes >= 2, 2).otherwise(1)
    merged = merged.filter(admitted).withColumn("priority", priority)
    order = [F.desc("protected"), F.when(F.col("protected"), F.col("raw_rank")), F.desc("priority"), F.desc("score"), F.desc("raw_score"), F.asc("id")]
    return merged.orderBy(*order).limit(limit).select("id", "paper_id", "score", "raw_score", "raw_rank", "matched_routes", "protected", "priority")


def boosted(hits: DataFrame, normalized: Column, query: str) -> DataFrame:
    """Adds the lexical score to a hit's score, at most 0.35, or 1.35 where the query has a strict anchor."""
    lexical = lexical_score(normalized, query)
    most = 1.35 if needs_anchor(query) else 0.35
    return hits.withColumn("lexical_score", lexical).withColumn("rerank_score", F.when(F.col("lexical_score") > 0, F.col("score"))).withColumn("score", F.col("score") + F.least(F.col("lexical_score"), F.lit(most)))


# How much a match in a field counts.
FIELD_WEIGHTS = {"entities": 12.0, "seo": 10.0, "visual": 8.0, "title": 6.0, "summary": 4.0, "context": 3.0, "content": 1.0}


def fielded_score(fields: dict[str, Column], query: str, idf: dict[str, float] | None = None) -> Column:
    """Sum over fields and terms: field weight, term weight, idf, and a quarter more for a second and a third occurrence;
    0 where the query names a strict anchor that no field holds."""
    parts = []
    for name, value in fields.items():
        for term, weight in tx.query_terms(query).items():
            if term != "lnt":
                n = F.least(tx.occurrences(value, term), F.lit(3))
                parts.append(F.when(n > 0, FIELD_WEIGHTS.get(name, 1.0) * weight * (idf or {}).get(term, 1.0) * (1.0 + 0.25 * (n - 1))).otherwise(0.0))
    score = total(parts)
    return F.when(has_anchor(F.concat_ws(" ", *fields.values())), score).otherwise(0.0) if needs_anchor(query) else score


def distinct_first(hits: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return hits.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def ranked_papers(hits: DataFrame, limit: int) -> DataFrame:
    """(paper_id, paper_rank) by first appearance among hits(paper_id, rank)."""
    first = hits.filter(F.coalesce(F.col("paper_id"), F.lit("")) != "").groupBy("paper_id").agg(F.min("rank").alias("first")).orderBy("first").limit(limit)
    return first.select("paper_id", F.row_number().over(Window.orderBy("first")).alias("paper_rank"))


def top_per_paper(hits: DataFrame, most: int, lead_most: int) -> DataFrame:
    """The best rows of each paper, more of the first paper: hits(paper_id, paper_rank, score, id)."""
    w = Window.partitionBy("paper_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= F.when(F.col("paper_rank") == 1, lead_most).otherwise(most))


def interleaved(hits: DataFrame) -> DataFrame:
    """Round-robin over groups: position in the group, then group."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy("place", "paper_rank")))


def prioritized(hits: DataFrame) -> DataFrame:
    """One row of each group, then the rest of the first group, then the rest of the others round-robin."""
    phase = F.when(F.col("place") == 1, 0).when(F.col("paper_rank") == 1, 1).otherwise(2)
    first = F.when(phase == 0, F.col("paper_rank")).otherwise(F.col("place"))
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(phase, first, "paper_rank")))


def score_ranked(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("lexical_score"), "paper_rank", "id")))


def append_unique(first: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """Union in which the first frame's rows win."""
    both = first.withColumn("__from", F.lit(0)).unionByName(more.withColumn("__from", F.lit(1)))
    return distinct_first(both, [key], ["__from", F.desc("score")]).drop("__from")


def protected_prefix(hits: DataFrame, protected: DataFrame, limit: int) -> DataFrame:
    """Protected rows in their order, then the others in theirs: frames of (id, rank)."""
    tail = hits.join(protected.select("id"), "id", "left_anti").withColumn("part", F.lit(1))
    both = protected.withColumn("part", F.lit(0)).unionByName(tail)
    return both.withColumn("new_rank", F.row_number().over(Window.orderBy("part", "rank"))).filter(F.col("new_rank") <= limit).drop("part")


def neighbors(seeds: DataFrame, chunks: DataFrame, window: int = 2) -> DataFrame:
    """Chunks within `window` places of a hit in the same paper, each by its best score.

    seeds(id, paper_id, ord, score), chunks(id, paper_id, ord). A seed asks for each place of its window, so a chunk
    meets only the seeds that are close to it, however long a paper is.
    """
    reach = F.explode(F.sequence(F.col("ord") - window, F.col("ord") + window)).alias("ord")
    s = seeds.select(F.col("id").alias("seed"), "paper_id", F.col("ord").alias("at"), F.col("score").alias("base"), reach)
    near = chunks.join(s, ["paper_id", "ord"]).filter(F.col("id") != F.col("seed")).withColumn("distance", F.abs(F.col("ord") - F.col("at")))
    near = near.withColumn("score", F.col("base") * F.greatest(F.lit(0.55), 0.98 - 0.08 * F.col("distance")))
    return distinct_first(near.select("id", "paper_id", "ord", "distance", "score", "seed"), ["id"], [F.desc("score"), "seed"])


def not_seen(context: DataFrame, hits: DataFrame) -> DataFrame:
    """Context rows whose id no hit has, nor whose (paper, chunk)."""
    return context.join(hits.select("id"), "id", "left_anti").join(hits.select("paper_id", "ord"), ["paper_id", "ord"], "left_anti")
