"""Judged chunks on their way into the store, and changes to the store as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as tx


def outcome(content_type: Column, passed: Column, issue_type: Column) -> Column:
    """What becomes of a chunk: passed is null where it was not judged."""
    is_table = content_type == "table"
    wrong = F.coalesce(issue_type == "false_positive", F.lit(False))
    return F.when(passed.isNull(), "missing_verdict").when(passed, "stored").when(is_table & wrong, "excluded").when(is_table, "degraded").otherwise("rejected")


def routed(chunks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Left join of chunks(id, content_type) with verdicts(id, passed, issue_type), with the outcome of each chunk."""
    return chunks.join(verdicts, "id", "left").withColumn("outcome", outcome(F.col("content_type"), F.col("passed"), F.col("issue_type")))


def stats(routed_chunks: DataFrame, *by: str) -> DataFrame:
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return routed_chunks.groupBy(*by).agg(
        n("stored").alias("stored"), n("degraded").alias("degraded"), n("excluded").alias("excluded"), n("missing_verdict").alias("missing_verdicts"),
        n("stored", "degraded").alias("attempted"), F.count_if((F.col("outcome") == "excluded") & (F.col("content_type") == "table")).alias("excluded_tables"),
    )


def catalogue(points: DataFrame) -> DataFrame:
    """Papers with their number of chunks and enrichment state: pending while any chunk is, done where one is done or
    carries quality fields, else pending. points(paper_id, status, has_quality)."""
    pending, done = F.bool_or(F.coalesce(F.col("status") == "pending", F.lit(False))), F.bool_or(F.coalesce(F.col("status") == "done", F.lit(False)) | F.col("has_quality"))
    return points.groupBy("paper_id").agg(F.count("*").alias("chunk_count"), F.when(pending, "pending").when(done, "done").otherwise("pending").alias("enrichment_status"), (~pending & ~done).alias("lacks_marker"))


def has_any(*columns: str) -> Column:
    """Any column neither null nor an empty text; zero and false count as present."""
    out = F.lit(False)
    for c in columns:
        out = out | (F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    return out


def upserted(store: DataFrame, incoming: DataFrame, key: str = "id", vector: str | None = None) -> DataFrame:
    """The store with incoming rows in place of those of the same key. Vectors of another length than the store's, or of
    several lengths, are an error: nothing of the store is given up for them."""
    if vector:
        lengths = [r[0] for r in store.select(F.size(vector).alias("n")).union(incoming.select(F.size(vector))).filter("n >= 0").distinct().limit(2).collect()]
        if len(lengths) > 1:
            raise ValueError(f"vectors of different lengths: {sorted(lengths)}")
    return store.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def patched(store: DataFrame, patch: DataFrame, key: str, *columns: str) -> DataFrame:
    """Patch values where they are given, the store's otherwise."""
    p = patch.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    return store.join(p, key, "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in columns}).drop(*[f"new_{c}" for c in columns])


def without_papers(store: DataFrame, papers: DataFrame) -> DataFrame:
    return store.join(papers.select("paper_id").distinct(), "paper_id", "left_anti")


def filtered(df: DataFrame, **conditions) -> DataFrame:
    """All of name=value, name_gte=value and name_lte=value."""
    for name, value in conditions.items():
        if name.endswith("_gte"):
            df = df.filter(F.col(name[:-4]) >= value)
        elif name.endswith("_lte"):
            df = df.filter(F.col(name[:-4]) <= value)
        else:
            df = df.filter(F.col(name) == value)
    return df


# Actions that leave a failed table a chance.
IMPROVABLE = ["expand_bbox", "shrink_bbox", "retry_text_strategy", "retry_line_strategy", "needs_llm_judge"]


def storage_decision() -> Column:
    """Why a table may or may not be stored, the first rule that applies; over the columns content_type, excluded,
    prior_source, has_caption, unparseable, llm_action, rule_action, auto_action, llm_category, rule_category, tier,
    score, rows, cols, unparsed, prose, body_heavy. Null actions and categories count as none."""
    c = F.col
    any_is = lambda value, *names: F.array_contains(F.array(*[F.coalesce(c(n), F.lit("")) for n in names]), value)
    actions, categories = ("llm_action", "rule_action", "auto_action"), ("llm_category", "rule_category")
    failed, weak = c("tier") == "failed", c("score") < 0.35
    action = tx.first_filled(c("llm_action"), c("rule_action"))
    return (
        F.when(c("content_type") != "table", "not_table")
        .when(c("excluded") & (c("prior_source") == "body_heavy_low_column_candidate") & c("has_caption"), "captioned_table_overrides_body_heavy_low_column")
        .when(c("excluded"), "existing_marker")
        .when(tx.filled(c("unparseable")).isNotNull(), "unparseable_marker")
        .when(any_is("drop_candidate", *actions), "judge_drop_candidate")
        .when(any_is("mark_unparseable", *actions), "judge_mark_unparseable")
        .when(any_is("candidate_false_positive", *categories), "judge_false_positive")
        .when(any_is("fragmented_text_layer", *categories) & failed, "failed_fragmented_text_layer")
        .when(failed & weak & (c("unparsed") | (c("rows") < 2) | (c("cols") < 2)), "failed_self_check_no_structure")
        .when(failed & weak & ~action.isin(IMPROVABLE), "failed_self_check_no_repair")
        .when(failed & (c("prose") >= 0.35), "failed_body_text_contamination")
        .when(c("body_heavy") & (c("cols") <= 2) & (c("score") < 0.78) & ~c("has_caption"), "body_heavy_low_column_candidate")
        .otherwise("table_self_check_passed_or_repairable")
    )


def excludes(decision: Column) -> Column:
    return ~decision.isin("not_table", "captioned_table_overrides_body_heavy_low_column", "table_self_check_passed_or_repairable")


def candidate_score() -> Column:
    """Structure of a table in [0, 1] over rows, cols, consistency, fill, prose, area_ratio, words, numbers, long_lines,
    body_words; rounded half to even at three places."""
    c = F.col
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    when = lambda cond, v: F.when(cond, F.lit(v)).otherwise(0.0)
    big = (c("rows") >= 3) & (c("cols") >= 2)
    s = when((c("rows") > 0) & (c("cols") > 0), 0.15) + when(c("rows") >= 3, 0.15) + when(c("cols") >= 2, 0.15)
    s = s + 0.25 * unit(c("consistency")) + 0.20 * unit(c("fill")) + 0.10 * (1.0 - unit(c("prose")))
    s = s - when(c("prose") >= 0.25, 0.15) - when(big & (c("consistency") < 0.55), 0.08) - when(big & (c("fill") < 0.40), 0.05)
    s = s - when((c("area_ratio") < 0.35) | (c("area_ratio") > 1.80), 0.08)
    s = s + when((c("words") > 0) & (c("numbers") / F.greatest(c("words"), F.lit(1)) >= 0.18), 0.05)
    s = s - when((c("words") > 0) & ((c("long_lines") >= 2) | (c("body_words") >= 8)), 0.08)
    return F.bround(unit(s), 3)


def tier(score: Column) -> Column:
    return F.when(score >= 0.78, "strong").when(score >= 0.58, "usable").when(score >= 0.35, "suspicious").otherwise("failed")


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.65, "strong").when(confidence >= 0.40, "gray").otherwise("weak")


def region_confidence() -> Column:
    """Evidence of a table region over caption, lines, alignment, numeric, short_cells, long_lines, section_words."""
    c = F.col
    when = lambda cond, v: F.when(cond, F.lit(v)).otherwise(0.0)
    s = when(c("caption"), 0.35) + F.when(c("lines") >= 3, 0.30).when(c("lines") >= 2, 0.20).otherwise(0.0)
    s = s + F.when(c("alignment") >= 4, 0.30).when(c("alignment") >= 3, 0.15).otherwise(0.0) + when(c("numeric") >= 4, 0.15) + when(c("short_cells") >= 6, 0.10)
    s = s - when(c("long_lines") >= 3, 0.30) - when(c("section_words") > 0, 0.20)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 3)


def comparison(original: Column, candidate: Column, least: float = 0.08) -> Column:
    delta = F.bround(candidate - original, 3)
    return F.when(delta >= least, "improved").when(delta <= -least, "regressed").otherwise("unchanged")


def evidence_weight(content_type: Column, has_description: Column, text: Column, section: Column) -> Column:
    """1 and more for tables, described images, metrics in the text and result sections; at most 1.5."""
    metric = F.size(tx.metrics(text)) > 0
    result = F.lower(F.coalesce(section, F.lit(""))).rlike("result|discussion|fermentation|production")
    w = F.lit(1.0) + F.when(content_type == "table", 0.18).when(content_type == "image", F.when(has_description, 0.20).otherwise(0.08)).otherwise(0.0)
    return F.bround(F.least(w + F.when(metric, 0.12).otherwise(0.0) + F.when(result, 0.08).otherwise(0.0), F.lit(1.5)), 3)


def search_text(*parts: Column, most: int = 6000) -> Column:
    """Fields in order, one a line, equal ones once, cut to `most` characters."""
    return F.trim(F.substring(F.array_join(tx.distinct_text(F.array(*parts)), "\n"), 1, most))
