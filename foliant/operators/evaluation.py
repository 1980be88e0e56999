"""Retrieval metrics over cases (case_id, case_type, rank of the first right hit or null, elapsed_ms)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators.retrieval import FIELD_WEIGHTS, total


def metrics(ks: tuple[int, ...] = (1, 5, 10)) -> list[Column]:
    rank = F.col("rank")
    hits = [F.avg(F.when(rank <= k, 1.0).otherwise(0.0)).alias(f"hit_at_{k}") for k in ks]
    p = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY elapsed_ms)").alias(f"p{int(q * 100)}") for q in (0.5, 0.95)]
    return [F.count("*").alias("cases"), F.avg(F.coalesce(1.0 / rank, F.lit(0.0))).alias("mrr"), *hits, F.avg("elapsed_ms").alias("avg_ms"), *p]


def summary(results: DataFrame) -> DataFrame:
    """Metrics over all cases (case_type null) and for each type."""
    return results.rollup("case_type").agg(*metrics())


def failure(k: int = 10) -> Column:
    """Why a case failed, the first that applies; over paper_rank, nearby_rank and rank."""
    hit = lambda c: F.coalesce(F.col(c) <= k, F.lit(False))
    return F.when(hit("rank"), "hit").when(F.col("rank").isNotNull(), "below_cut").when(hit("nearby_rank"), "nearby_only").when(hit("paper_rank"), "paper_only").otherwise("paper_missed")


def word_frequencies(entries: DataFrame, fields: dict[str, Column], words: list[str]) -> DataFrame:
    """(term, df): entries that hold each of words, between blanks in any of the fields. Only these words are shuffled."""
    held = F.array_intersect(F.split(F.concat_ws(" ", *fields.values()), " "), F.array(*[F.lit(w) for w in words]))
    return entries.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def offline_idf(entries: DataFrame, fields: dict[str, Column], words: list[str]) -> dict[str, float]:
    """idf of each of a query's words; one that stands nowhere by itself, as a phrase, counts as held by no entry."""
    df = {r["term"]: r["df"] for r in word_frequencies(entries, fields, words).collect()}
    n = entries.count()
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1.0 for w in words}


def offline_score(fields: dict[str, Column], idf: dict[str, float]) -> Column:
    """Sum over fields and terms: field weight, idf, and a quarter more for each further occurrence, three times at most;
    twice the weight of a field that holds the first four terms as a phrase."""
    parts = []
    for name, value in fields.items():
        weight, text = FIELD_WEIGHTS.get(name, 1.0), F.coalesce(value, F.lit(""))
        for term, rarity in idf.items():
            n = tx.occurrences(text, term)
            parts.append(F.when(n > 0, F.least(F.lit(3.0), 1.0 + 0.25 * (n - 1)) * weight * rarity).otherwise(0.0))
        if len(idf) > 1:
            parts.append(F.when(F.contains(text, F.lit(" ".join(list(idf)[:4]))), 2.0 * weight).otherwise(0.0))
    return total(parts)


def first_match(hits: DataFrame, key: str, rank: str, text: str, expected: list[str]) -> DataFrame:
    """key, hit_count, matched_rank and matched_term of each case: the first of its hits whose text holds an expected term in
    any case, and the first such term; null where none does."""
    term = F.get(F.filter(F.array(*[F.lit(e.lower()) for e in expected]), lambda e: F.contains(F.lower(F.col(text)), e)), 0)
    found = hits.select(F.col(key), F.col(rank).alias("matched_rank"), term.alias("matched_term"))
    best = F.min(F.when(F.col("matched_term").isNotNull(), F.struct("matched_rank", "matched_term"))).alias("best")
    return found.groupBy(key).agg(F.count("*").alias("hit_count"), best).select(key, "hit_count", "best.matched_rank", "best.matched_term")
