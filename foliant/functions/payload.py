"""Fields of stored chunks: cleaning for a reranker, annotations, tables as text, places in chunk ids, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import matrices as mx

# Labels shown for a state.
PRIORITY = {"high": "高", "medium": "中", "low": "低"}
CLASSIFICATION = {
    "rule_only": "规则初判",
    "small_only": "小模型初判",
    "judge_confirmed": "Judge确认",
    "judge_revised": "Judge修正",
    "small_failed_fallback_rule": "小模型失败-规则兜底",
    "judge_failed_small_only": "Judge失败-小模型结果",
    "failed_fallback_rule": "失败-规则兜底",
}
PDF_CHECK = {"verified": "可访问", "failed": "失败", "missing_pdf_url": "无PDF链接"}
# Glyphs that PDF fonts leave as numbers, and entities of HTML.
GLYPHS = [("(cid:8)", "±"), ("(cid:2)", "-"), ("(cid:3)", "-")]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
# Visual items smaller than this (square points) are dropped; without words four times that.
VISUAL_AREA = 5000.0


def _replaced(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def label(c: Column, labels: dict[str, str], default: str | None = None) -> Column:
    """The label of a state; an unknown state stands for itself, an empty one for the default."""
    found = F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), c)
    return F.coalesce(found, tx.filled(c), F.lit(default or "")) if default else F.coalesce(found, c)


def translation_label(error: Column, translated: Column, abstract: Column) -> Column:
    return F.when(tx.filled(error).isNotNull(), "失败").when(tx.filled(translated).isNotNull(), "已翻译").when(tx.filled(abstract).isNotNull(), "待翻译").otherwise("无摘要")


def importable_label(pdf_url: Column, status: Column) -> Column:
    return F.when(tx.filled(pdf_url).isNull(), "否").when(status == "verified", "是").when(status == "unavailable", "否").otherwise("可尝试")


def stem(path: Column) -> Column:
    """A file's name without directories and without its last suffix."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"^.*/", ""), r"(?<=.)\.[^.]+$", "")


def clean_title(path: Column) -> Column:
    """A file's stem with underscores and hyphens as spaces."""
    return _spaced(F.regexp_replace(stem(path), "[_-]+", " "))


def slug(c: Column) -> Column:
    """Lower-case ASCII words joined by hyphens; `topic` where there is none."""
    found = F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(found != "", found).otherwise("topic")


def table_label(caption: Column) -> Column:
    """`Table 2` or `Supplementary Table S2`, or the empty text."""
    pattern = r"(?i)\b(supplementary\s+table|table|tab\.)\s*(s?\d+)\b"
    kind, number = (F.regexp_extract(F.coalesce(caption, F.lit("")), pattern, i) for i in (1, 2))
    prefix = F.when(F.lower(kind).startswith("supplementary"), "Supplementary Table ").otherwise("Table ")
    return F.when(number != "", F.concat(prefix, F.upper(number))).otherwise("")


def rerank_title(path: Column) -> Column:
    """A file's stem without the mark of a download site, underscores as spaces, abbreviations spelt out."""
    named = F.regexp_replace(stem(path), r"(?i)\([^)]*ablesci\.com\)", " ")
    return tx.expand_aliases(_spaced(F.replace(named, F.lit("_"), F.lit(" "))))


def rerank_field(c: Column) -> Column:
    """Text without bracketed tags, places and category codes, abbreviations spelt out."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\[[^\]]+\]", " ")
    c = F.regexp_replace(c, r"(?i)\b(?:text|table|image)\s*\|\s*chunk\s+\d+(?:/\d+)?", " ")
    c = F.regexp_replace(c, r"(?i)\bbiosynthesis_review\b|\bfermentation_experiment\b", " ")
    return tx.expand_aliases(_spaced(F.regexp_replace(c, r"(?i)\b(?:pdf|text|chunk)\b", " ")))


def rerank_list(items: Column) -> Column:
    """Cleaned items, equal ones once, joined by commas. Abbreviations are spelt out twice, as the rule has it."""
    cleaned = F.transform(F.filter(items, lambda x: F.trim(x) != ""), lambda x: tx.expand_aliases(rerank_field(x)))
    return F.coalesce(F.array_join(F.array_distinct(F.filter(cleaned, lambda x: x != "")), ", "), F.lit(""))


def rerank_text(search_text: Column, title: Column, lists: list[Column], fields: list[Column]) -> Column:
    """The stored search text, else title, lists and fields, cleaned, one a line, blank ones left out."""
    parts = F.array(rerank_title(title), *[rerank_list(x) for x in lists], *[rerank_field(x) for x in fields])
    return F.coalesce(tx.filled(F.trim(search_text)), F.array_join(F.filter(parts, lambda x: F.trim(x) != ""), "\n"))


def evidence_type(content_type: Column, kind: Column) -> Column:
    return F.when(content_type == "table", "table numeric evidence").when(content_type == "image", F.when(kind == "chart", "figure chart evidence").otherwise("figure visual evidence")).otherwise("text evidence")


def annotations(title: Column, content_type: Column, kind: Column, text: Column, headings: list[Column], figure: list[Column], captions: Column, visuals: Column) -> Column:
    """struct(section, evidence_type, terms, metric_terms, anchor_text) that a chunk is found by.

    figure is its label, its group, its caption and the table's caption; captions and visuals are arrays of texts.
    """
    filled = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")
    captions, visuals = filled(captions), filled(visuals)
    section, evidence = tx.first_filled(*headings), evidence_type(content_type, kind)
    found = F.concat(tx.metrics(text), tx.metrics(F.array_join(F.concat(captions, visuals), " ")))
    anchor = F.array_join(filled(F.array(section, figure[0], figure[2], figure[3], evidence)), " | ")
    terms = tx.distinct_text(F.concat(F.array(title, section, figure[0], figure[1], evidence), captions, visuals, found))
    return F.struct(section.alias("section"), evidence.alias("evidence_type"), terms.alias("terms"), tx.distinct_text(found).alias("metric_terms"), anchor.alias("anchor_text"))


def html_matrix(html: Column) -> Column:
    """Cells of the rows of an HTML table as array<array<string>>: no tags, entities resolved, rows without text left out."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), 1)
    cell = lambda c: _spaced(_replaced(F.regexp_replace(c, "<[^>]+>", ""), ENTITIES))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), 1), cell))
    return F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))


def html_markdown(html: Column) -> Column:
    """An HTML table as markdown, rows padded to the widest, bars escaped; the text itself where it has no rows."""
    escaped = F.transform(html_matrix(html), lambda r: F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))))
    return F.when(F.size(escaped) > 0, mx.markdown(mx.normalized(escaped), F.lit(0))).otherwise(_spaced(html))


def markdown_matrix(text: Column) -> Column:
    """Rows of a markdown table: lines that begin with a bar, rules left out, outer empty cells off."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\r", ""))), lambda x: x.startswith("|"))
    lines = F.filter(lines, lambda x: ~x.rlike(r"^[|:\- ]*$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.regexp_replace(x, r"^\s*\|", ""), r"\|\s*$", ""), r"\|"), lambda c: F.trim(c)))


def table_text(text: Column, caption: Column, number: Column, most: int = 5000) -> Column:
    """A markdown table for an embedding: its number where the caption lacks it, caption, cells joined by semicolons,
    other lines as they are; rules and lone dashes left out, equal lines once."""
    clean = lambda c: F.regexp_replace(_replaced(_spaced(c), GLYPHS), "^(?:---|-)$", "")
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    lines = F.filter(lines, lambda x: ~F.forall(F.split(F.btrim(x, F.lit("|")), r"\|"), lambda c: F.trim(c).rlike("^$|^:?-{3,}:?$")))
    row = lambda x: F.array_join(F.filter(F.transform(F.split(F.btrim(x, F.lit("|")), r"\|"), clean), lambda c: c != ""), "; ")
    body = F.transform(lines, lambda x: F.when(F.contains(x, F.lit("|")), row(x)).otherwise(clean(x)))
    caption, number = tx.first_filled(caption), tx.first_filled(number)
    named = F.when((number != "") & (caption != "") & ~F.contains(F.lower(caption), F.lower(number)), number).otherwise("")
    return F.trim(F.substring(F.array_join(tx.distinct_text(F.concat(F.array(named, caption), body)), "\n"), 1, most))


def embedding_text(content_type: Column, text: Column, described: Column, figure_caption: Column, visual: Column, table: Column) -> Column:
    """What a chunk is embedded by: an image by its description, caption and content, a table by table_text()."""
    image = F.array_join(F.filter(F.array(F.trim(described), F.trim(figure_caption), F.trim(visual), text), lambda x: x != ""), "\n\n")
    return F.when(content_type == "image", image).when(content_type == "table", F.coalesce(tx.filled(table), text)).otherwise(text)


def chunk_location(chunk_id: Column) -> Column:
    """struct(page, col, y, x) that a chunk id names; null where it names none."""
    pattern = r"_p(\d+)(?:_col(\d+))?_y(-?\d+(?:\.\d+)?)_x(-?\d+(?:\.\d+)?)"
    part = [F.regexp_extract(F.coalesce(chunk_id, F.lit("")), pattern, i) for i in (1, 2, 3, 4)]
    place = F.struct(part[0].cast("int").alias("page"), F.when(part[1] != "", part[1].cast("int")).alias("col"), part[2].cast("double").alias("y"), part[3].cast("double").alias("x"))
    return F.when(part[0] != "", place)


def whole_number(c: Column) -> Column:
    """The integer that a text is; null for anything else."""
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("long"))


def positive_number(c: Column) -> Column:
    """The number that a text is, if above zero."""
    n = F.trim(c).try_cast("double")
    return F.when((n > 0) & ~F.isnan(n), n)


def same_day(value: Column, now: Column, offset_hours: int = 8) -> Column:
    """Both timestamps fall on one day at a fixed offset from UTC; false where the value is no timestamp."""
    shift = F.expr(f"INTERVAL {offset_hours} HOURS")
    return F.coalesce(F.to_date(value + shift) == F.to_date(now + shift), F.lit(False))


def keeps_visual(kind: Column, area: Column, worded: Column) -> Column:
    """A visual item is large enough, and a chart, or with words, or four times as large."""
    return F.coalesce((area >= VISUAL_AREA) & ((kind == "chart") | worded | (area >= 4 * VISUAL_AREA)), F.lit(False))


def table_state(false_positive: Column, excluded: Column, unparsed: Column, needs_work: Column) -> Column:
    """Status shown for a table, the first that applies."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(false_positive) | yes(excluded), "不入库候选").when(yes(unparsed), "未解析候选").when(yes(needs_work), "结构需处理").otherwise("可用表格")


def elapsed(seconds: Column, skipped: Column) -> Column:
    """`<0.1s`, one decimal, or that the step was skipped."""
    s = F.coalesce(seconds, F.lit(0.0))
    return F.when(skipped, "未执行").when((s > 0) & (s < 0.1), "<0.1s").otherwise(F.format_string("%.1fs", s))
