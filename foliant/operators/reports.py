"""Reports over stored papers, batches, table checks and retrieval runs, and the texts built for a paper's judges.

Counts of several kinds come as rows (section, key, n), so that one aggregation makes them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx

# What a text for classification holds.
LEAST_WORDS, MOST_CHUNKS, MOST_CHARS = 20, 25, 4000
OPENING = r"^(?:ABSTRACT|Abstract|摘要)"
CLOSING = r"(?i)^(?:INTRODUCTION|KEYWORDS|关键词|1\.)"
# Rule categories that a judge looks at after those that ask for it.
SECOND_CHOICE = ["body_text_contamination", "no_parser_output", "header_or_span_complexity"]
# What a metric in a question's chunk looks like, and how hard cases are ranked.
METRIC = r"(?i)\b\d+(?:\.\d+)?\s*(?:g\s*/\s*l|mg\s*/\s*l|g/l|mg/l|h|hr|hours?|%|fold|mmol|mol|od600|rpm)\b"


def counted(rows: DataFrame, **sections: Column) -> DataFrame:
    """(section, key, n): how often each value of each section's column or array stands in the rows; nulls don't count."""
    entry = lambda name, c: F.transform(c, lambda k: F.struct(F.lit(name).alias("section"), k.cast("string").alias("key")))
    entries = F.concat(*[F.coalesce(entry(n, c), F.array().cast("array<struct<section:string,key:string>>")) for n, c in sections.items()])
    return rows.select(F.explode(entries).alias("e")).filter("e.key IS NOT NULL").groupBy("e.section", "e.key").agg(F.count("*").alias("n"))


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _only(cond: Column, value) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(value) if isinstance(value, str) else value)


def self_check(rows: DataFrame) -> DataFrame:
    """(section, key, n) for rows(succeeded, tier, reasons, category, action, repairs, verdict, retried, judge, excluded,
    exclusion_reason, decision_source): tiers, categories, actions, repairs, retry verdicts, risks, storage."""
    c = F.col
    risks = F.array(
        _only(c("reasons").rlike("prose|body"), "body_text_contamination"),
        _only(F.contains(c("reasons"), F.lit("low_consistency")), "low_consistency"),
        _only(c("category") == "candidate_false_positive", "candidate_false_positive"),
        _only(c("judge"), "needs_llm_judge"),
        _only(c("verdict") == "regressed", "retry_regressed"),
        _only(c("excluded"), "excluded_from_storage"),
    )
    return counted(
        rows, candidate_tiers=F.array("tier"), rule_categories=F.array("category"), recommended_actions=F.array("action"),
        repair_actions=F.filter(F.split("repairs", r" \| "), lambda x: x != ""), retry_verdicts=F.array(_only(c("retried"), c("verdict"))), risk_flags=risks,
        succeeded=F.array(c("succeeded")), excluded_reasons=F.array(_only(c("excluded"), c("exclusion_reason"))), decision_sources=F.array(tx.filled(c("decision_source"))),
    )


def judge_sample(rows: DataFrame, most: int) -> DataFrame:
    """(pdf, region, priority): regions for a judge, each once: those that ask for it and did not succeed in a second try,
    then those of SECOND_CHOICE, in order of ord; `most` of them."""
    priority = F.when(F.col("judge") & ~F.coalesce("retry_succeeded", F.lit(False)), 0).when(F.col("category").isin(SECOND_CHOICE), 1)
    wanted = rows.withColumn("priority", priority).filter("priority IS NOT NULL")
    first = wanted.groupBy("pdf", "region").agg(F.min(F.struct("priority", "ord")).alias("at"))
    return first.orderBy("at.priority", "at.ord", "pdf", "region").limit(most).select("pdf", "region", "at.priority")


def deltas(baseline: DataFrame, candidate: DataFrame, key: str, *metrics: str) -> DataFrame:
    """Differences of two summaries by key, to four places."""
    a = baseline.select(key, *[F.col(m).alias(f"__{m}") for m in metrics])
    return candidate.join(a, key).select(key, *[F.bround(F.col(m) - F.col(f"__{m}"), 4).alias(m) for m in metrics])


def snapshot_stats(chunks: DataFrame, *by: str) -> DataFrame:
    """Chunks by type and by verdict: chunks(content_type, passed)."""
    kinds = [F.count_if(F.col("content_type") == k).alias(k) for k in ("text", "table", "image")]
    return chunks.groupBy(*by).agg(F.count("*").alias("total"), *kinds, F.count_if(F.col("passed")).alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def job_outcome(duplicate: Column, stored: Column, degraded: Column, failed: Column, attempted: Column, excluded: Column) -> Column:
    """skip, partial, fail, no_store or ok, the first that applies."""
    return F.when(duplicate, "skip").when(failed > 0, F.when(stored + degraded > 0, "partial").otherwise("fail")).when((attempted == 0) & (excluded == 0), "no_store").otherwise("ok")


def timing(total: Column, store: Column) -> Column:
    """Seconds of parsing: what storing leaves of the total, never below zero, to three places."""
    return F.bround(F.greatest(total - F.coalesce(store, F.lit(0.0)), F.lit(0.0)), 3)


def highlights(items: DataFrame, total: int) -> DataFrame:
    """(place, line) of a brief over items(priority, pdf_status, topics): size, high priorities, PDFs at hand or not, and
    the three topics named most often, ties by name."""
    n = items.agg(F.count("*").alias("n"), F.count_if(F.col("priority") == "high").alias("high"), F.count_if(F.col("pdf_status") == "verified").alias("verified"), F.count_if(F.col("pdf_status") == "unavailable").alias("unavailable"))
    named = items.select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(3)
    top = named.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "topic"))), lambda x: F.concat(x["topic"], F.lit("("), (-x["k"]).cast("string"), F.lit(")"))), "、").alias("top"))
    say = lambda c, t: F.when(F.col(c) > 0, F.format_string(t, F.col(c)))
    lines = F.array(
        F.format_string(f"本次窗口内共有 {total} 条候选，纳入简报 %d 条。", F.col("n")),
        say("high", "%d 条被标为高优先级，建议优先查看。"),
        say("verified", "%d 条已有可访问 PDF，可直接进入导入前处理。"),
        say("unavailable", "%d 条 PDF 暂不可访问，可先作为元数据候选保留。"),
        F.when(F.col("top") != "", F.format_string("主要主题集中在：%s。", F.col("top"))),
    )
    return n.crossJoin(top).select(F.posexplode(F.array_compact(lines)).alias("place", "line"))  # one row each


def paper_titles(chunks: DataFrame) -> DataFrame:
    """(paper_id, title): the three topmost text chunks of page 1, joined, 200 characters."""
    w = Window.partitionBy("paper_id").orderBy("box.y0", "id")
    head = chunks.filter((F.col("page") == 1) & (F.col("content_type") == "text")).withColumn("n", F.row_number().over(w)).filter("n <= 3")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.substring(F.trim("text"), 1, 200).alias("t")))), lambda x: x["t"]), " ")
    return head.groupBy("paper_id").agg(F.substring(joined, 1, 200).alias("title"))


def classification_texts(chunks: DataFrame) -> DataFrame:
    """(paper_id, text) that a paper is classified by, from chunks(paper_id, ord, content_type, text); 4000 characters.

    From the chunk that opens the abstract to the one that opens the next part, chunks of 20 words and more; where
    there is none, the first 25 such chunks. Running lengths cut long papers before anything is collected.
    """
    w = Window.partitionBy("paper_id").orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    t = chunks.filter(F.col("content_type") == "text").select("paper_id", "ord", tx.once(F.trim(F.coalesce("text", F.lit("")))).alias("text"))
    t = t.withColumn("words", F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))).withColumn("good", F.col("words") >= LEAST_WORDS)
    start = F.min(F.when(F.col("text").rlike(OPENING), F.col("ord"))).over(Window.partitionBy("paper_id"))
    t = t.withColumn("inside", F.coalesce(F.col("ord") >= start, F.lit(False)))
    t = t.withColumn("got", F.coalesce(F.count_if(F.col("inside") & F.col("good")).over(before), F.lit(0)))
    t = t.withColumn("closed", F.coalesce(F.max(F.col("inside") & (F.col("got") > 0) & F.col("text").rlike(CLOSING)).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    t = t.filter("good").withColumn("abstract", F.col("inside") & ~F.col("closed"))
    t = t.withColumn("has", F.max("abstract").over(Window.partitionBy("paper_id"))).filter("NOT has OR abstract")
    # A space stands between chunks; a chunk that begins beyond the limit adds nothing.
    t = t.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).withColumn("n", F.row_number().over(w))
    t = t.filter((F.col("start") < MOST_CHARS) & (F.col("has") | (F.col("n") <= MOST_CHUNKS)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.substring("text", 1, MOST_CHARS).alias("t")))), lambda x: x["t"]), " ")
    return t.groupBy("paper_id").agg(F.substring(joined, 1, MOST_CHARS).alias("text"))


def context_prefix(title: Column, category: Column, relevance: Column, credibility: Column, products: Column, organisms: Column, summary: Column, reason: Column, content_type: Column, order: Column, chunks: Column) -> Column:
    """What a chunk is told about its paper and its place, a field a line."""
    line = lambda name, c: F.concat(F.lit(f"[{name}] "), F.coalesce(c.cast("string"), F.lit("")))
    return F.concat_ws(
        "\n", line("标题", title), F.concat(line("分类", category), F.lit(" | 发酵相关性: "), relevance.cast("string"), F.lit(" | 可信度: "), credibility.cast("string")),
        line("产物", F.array_join(products, ", ")), line("菌株", F.array_join(organisms, ", ")), line("摘要", summary), line("判断依据", reason),
        F.concat(line("位置", content_type), F.lit(" | chunk "), order.cast("string"), F.lit("/"), chunks.cast("string")),
    )


def trusted_verdicts(chunks: DataFrame) -> DataFrame:
    """A passing verdict for every chunk of a parser that is trusted."""
    return chunks.filter(tx.filled(F.col("id").cast("string")).isNotNull()).select("id", F.lit(True).alias("passed"), F.lit(1.0).alias("score"), F.lit("mineru_parser_trusted").alias("issue_type"))


def judged_once(chunks: DataFrame, earlier: DataFrame, noise: Column) -> DataFrame:
    """Chunks a judge still has to see: no noise, and not passed in an earlier round."""
    return chunks.filter(~noise).join(earlier.filter("passed").select("id"), "id", "left_anti")


def brief_filter(category: Column, status: Column, include_other: bool) -> Column:
    """The import status after the topic filter: others are skipped, what was skipped and fits is a candidate again."""
    out = (category == "other") & F.lit(not include_other)
    return F.when(out, "skipped").when(status == "skipped", "candidate").otherwise(status)


def title_cases(papers: DataFrame, least: int = 12) -> DataFrame:
    """(id, case_type, query, paper_id) for papers(paper_id, title) whose title is long enough."""
    return papers.filter(F.length("title") >= least).select(F.concat(F.lit("title:"), "paper_id").alias("id"), F.lit("title").alias("case_type"), F.col("title").alias("query"), "paper_id")


def sampled(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows in an order that the seed and the key fix, whatever the partitions."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def hard_cases(chunks: DataFrame, per_paper: int = 3, least: int = 180) -> DataFrame:
    """(paper_id, id, query, place) from chunks(paper_id, id, content_type, text, subject): a paper's best chunks.

    The question asks for the first metric, a table, a figure or a result, whichever the chunk has first. Metrics count
    5, tables 4, images 2, and questions about yields, titers, activities or concentrations 2 more.
    """
    metric = _spaced(F.regexp_extract("text", METRIC, 0))
    result = F.lower("text").rlike("yield|titer|productivity|concentration|activity")
    ask = lambda t: F.concat(F.lit(t), F.col("subject"))
    query = (
        F.when(F.col("metric") != "", F.concat(F.lit("Which evidence passage reports "), F.col("metric"), F.lit(" for "), F.col("subject"), F.lit("?")))
        .when(F.col("content_type") == "table", F.concat(ask("Which table summarizes experimental evidence for "), F.lit("?")))
        .when(F.col("content_type") == "image", F.concat(ask("Which figure or image describes experimental evidence for "), F.lit("?")))
        .when(result, F.concat(ask("Find the result evidence about yield, titer, or activity for "), F.lit(".")))
        .otherwise(F.concat(ask("Find the evidence passage about "), F.lit(".")))
    )
    one = lambda cond, v: F.when(cond, v).otherwise(0)
    weight = one(F.col("metric") != "", 5) + one(F.col("content_type") == "table", 4) + one(F.col("content_type") == "image", 2) + one(F.lower("query").rlike("yield|titer|activity|concentration"), 2)
    rows = chunks.filter(F.length("text") >= least).select("paper_id", "id", "content_type", "subject", "text", tx.once(metric).alias("metric")).withColumn("query", query)
    w = Window.partitionBy("paper_id").orderBy(weight.desc(), "id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_paper).select("paper_id", "id", "query", "place")


def missing_regions(captions: DataFrame, regions: DataFrame) -> DataFrame:
    """Captions(paper_id, page) on whose page no region was found."""
    return captions.select("paper_id", "page").distinct().join(regions.select("paper_id", "page"), ["paper_id", "page"], "left_anti")


def clip_by_region(chunks: DataFrame) -> DataFrame:
    """(id, clip, fragments): the box around all chunks of a region for those that need another look at it."""
    w = Window.partitionBy("paper_id", "page", "region")
    b = F.col("box")
    clip = F.struct(F.min(b["x0"]).over(w).alias("x0"), F.min(b["y0"]).over(w).alias("y0"), F.max(b["x1"]).over(w).alias("x1"), F.max(b["y1"]).over(w).alias("y1"))
    rows = chunks.filter("region IS NOT NULL").withColumns({"fragments": F.count("*").over(w), "clip": clip})
    return rows.filter("fragments >= 2 AND needs_vision").select("id", "clip", "fragments")
