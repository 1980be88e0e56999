"""Candidate papers from several sources: identity, merging, priority, topics, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx

# The smaller, the more a source is trusted.
SOURCE_PRIORITY = {"pubmed": 10, "europe_pmc": 20, "openalex": 30, "biorxiv": 40, "crossref": 50}


def source_priority(source: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv]), source), F.lit(999))


def identity_keys(doi: Column, pmid: Column, pmcid: Column, openalex: Column, title: Column, year: Column) -> Column:
    """Keys in order of trust; those without a value are left out."""
    key = lambda name, v: F.when(v != "", F.concat(F.lit(f"{name}:"), v))
    t = tx.title_key(title)
    parts = [key("doi", tx.doi(doi)), key("pmid", tx.digits(pmid)), key("pmcid", tx.pmcid(pmcid)), key("openalex", tx.openalex_id(openalex))]
    return F.array_compact(F.array(*parts, F.when(t != "", F.concat(F.lit("title:"), t, F.lit("|"), F.coalesce(year.cast("string"), F.lit(""))))))


def candidate_id(keys: Column) -> Column:
    return F.concat(F.lit("ext_"), F.substring(F.sha1(F.get(keys, F.lit(0)).cast("binary")), 1, 16))


def matched(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, existing_id): the row of existing that shares the first of an incoming row's keys that any row has."""
    own = incoming.select("id", F.posexplode("keys").alias("place", "key"))
    old = existing.select(F.col("id").alias("existing_id"), F.explode("keys").alias("key")).groupBy("key").agg(F.min("existing_id").alias("existing_id"))
    return own.join(old, "key").groupBy("id").agg(F.min_by("existing_id", F.struct("place", "existing_id")).alias("existing_id"))


def merged(rows: DataFrame, group: str, *fields: str) -> DataFrame:
    """One row for each group: of every field the filled value of the most trusted source, ties to the smaller id."""
    best = [F.min_by(F.when(tx.filled(F.col(f)).isNotNull(), F.col(f)), F.when(tx.filled(F.col(f)).isNotNull(), F.struct("priority", "id"))).alias(f) for f in fields]
    return rows.groupBy(group).agg(*best, F.min("priority").alias("priority"), F.array_sort(F.collect_set("source")).alias("sources"), F.bool_or("is_open_access").alias("is_open_access"))


def priority_score(as_of_year: int) -> Column:
    c = F.col
    has = lambda *n: F.coalesce(*[tx.filled(c(x)) for x in n]).isNotNull()
    s = F.when(c("pdf_access_status") == "verified", 30).when(has("pdf_url"), 16).otherwise(0)
    s = s + F.when(c("is_open_access"), 10).otherwise(0) + F.when(has("abstract"), 8).otherwise(0) + F.when(has("pmid", "pmcid"), 6).otherwise(0)
    return s + F.when(has("doi"), 4).otherwise(0) + F.when(F.coalesce(c("year"), F.lit(0)) >= as_of_year - 1, 5).otherwise(0)


def priority_label(score: Column) -> Column:
    return F.when(score >= 38, "high").when(score >= 18, "medium").otherwise("low")


def pdf_bucket(url: Column, status: Column) -> Column:
    return F.when(status.isin("verified", "unavailable"), status).when(tx.filled(url).isNotNull(), "unchecked").otherwise("none")


def in_window(day: Column, until: Column, lookback_days: int) -> Column:
    """A closed window; what has no date always passes."""
    return day.isNull() | day.between(F.date_sub(until, lookback_days), until)


def source_hash(text: Column) -> Column:
    """What is kept of the text that a translation was made from."""
    return F.sha1(F.coalesce(text, F.lit("")).cast("binary"))


def needs_translation(stored: Column, text: Column) -> Column:
    """No translation yet, no text, or a text other than the one translated."""
    return stored.isNull() | text.isNull() | (stored != source_hash(text))


def due(next_run: Column, now: Column) -> Column:
    """A monitor without a readable time is due."""
    at = F.try_to_timestamp(next_run)
    return at.isNull() | (at <= now)


def counted(values: DataFrame, column: str) -> DataFrame:
    """Counts of filled values, the most frequent first, then by value."""
    v = values.select(F.trim(F.col(column).cast("string")).alias("value")).filter("value <> ''")
    return v.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def latest(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, F.struct(at, value)).alias(value), F.max(at).alias(at))


def topics(text: Column, keywords: dict[str, list[str]]) -> Column:
    """Names of the topics of which a keyword stands in the text, else `other`."""
    found = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(k) for k in ks]), lambda k: F.contains(text, k)), F.lit(name)) for name, ks in keywords.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def ranked_brief(rows: DataFrame, limit: int) -> DataFrame:
    """All keys descending, the title too."""
    order = [F.desc("score"), F.desc("year"), F.desc("title"), F.asc("id")]
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


# The topics, their names and what speaks for them.
TOPICS = [
    ("01", "毕赤酵母（综述）", ["pichia", "komagataella", "pastoris", "review", "overview", "expression system", "synthetic biology"]),
    ("02", "乳铁蛋白/骨桥蛋白（综述）", ["lactoferrin", "osteopontin", "review", "overview", "milk protein", "bioactive protein"]),
    ("03", "毕赤酵母（乳铁蛋白/骨桥蛋白）", ["pichia", "komagataella", "pastoris", "lactoferrin", "osteopontin", "heterologous", "recombinant"]),
    ("04", "乳铁蛋白/骨桥蛋白（翻译后修饰）", ["lactoferrin", "osteopontin", "glycosylation", "phosphorylation", "post-translational", "ptm"]),
    ("05", "毕赤酵母（蛋白转运全过程）", ["pichia", "pastoris", "secretion", "secretory pathway", "er", "golgi", "vesicle", "transport"]),
    ("06", "毕赤酵母（氧化应激-氧化还原/ER应激）", ["pichia", "pastoris", "oxidative stress", "redox", "methanol", "upr", "hac1", "ire1", "ero1", "pdi"]),
    ("07", "毕赤酵母细胞壁相关", ["pichia", "pastoris", "cell wall", "cell-wall", "wall integrity", "mannan", "glucan"]),
    ("08", "毕赤酵母（碳源代谢）", ["pichia", "pastoris", "carbon source", "methanol", "glycerol", "glucose", "metabolism", "aox"]),
    ("09", "毕赤酵母（表达元件）", ["pichia", "pastoris", "promoter", "terminator", "aox1", "gap", "5'utr", "expression element"]),
    ("10", "毕赤酵母（信号肽）", ["pichia", "pastoris", "signal peptide", "alpha-factor", "α-mf", "secretion signal"]),
    ("11", "毕赤酵母（密码子优化）", ["pichia", "pastoris", "codon", "codon optimization", "codon usage", "synonymous"]),
    ("12", "毕赤酵母（转录因子）", ["pichia", "pastoris", "transcription factor", "mxr1", "mit1", "prm1", "transcriptional regulator"]),
    ("13", "毕赤酵母（蛋白表达）", ["pichia", "pastoris", "recombinant protein", "protein expression", "antibody", "enzyme", "antimicrobial peptide"]),
    ("14", "毕赤酵母（氨基酸合成）", ["pichia", "pastoris", "amino acid", "biosynthesis", "amino-acid", "translation material"]),
    ("15", "乳铁蛋白/骨桥蛋白（分离纯化）", ["lactoferrin", "osteopontin", "purification", "separation", "chromatography", "fermentation broth"]),
    ("16", "毕赤酵母（间接检测方法）", ["pichia", "pastoris", "indirect detection", "indirect assay", "biomarker", "physiological state"]),
]
OTHER = ("other", "其他/不纳入Y103")
# Names of the host and of the proteins; words a topic asks for besides; words that don't count as signals.
HOSTS, PROTEINS = ["pichia", "komagataella", "pastoris"], ["lactoferrin", "osteopontin"]
ASKED = {
    "02": ["review", "overview", "meta-analysis", "systematic review"],
    "03": ["recombinant", "heterologous", "expression", "expressing", "secretion", "strain", "production"],
    "04": ["glycosylation", "phosphorylation", "post-translational", "ptm"],
    "15": ["purification", "separation", "chromatography", "fermentation broth"],
}
EXPRESSED = ["recombinant", "heterologous", "expression", "expressing", "expressed"]


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _catalogue() -> Column:
    """TOPICS as an array of structs, a constant: single words apart from phrases, as words are compared with tokens."""
    import re

    word = lambda w: re.fullmatch(r"[a-z0-9'-]+", w) is not None
    parted = lambda ws: (_texts([w for w in ws if word(w)]), _texts([w for w in ws if not word(w)]))
    rows = []
    for i, name, ws in TOPICS:
        (words, phrases), (asked, asked_phrases) = parted([w for w in ws if w not in HOSTS]), parted(ASKED.get(i, []))
        rows.append(F.struct(F.lit(i).alias("id"), F.lit(name).alias("name"), words.alias("words"), phrases.alias("phrases"), asked.alias("asked"), asked_phrases.alias("asked_phrases"), F.lit(i in ASKED).alias("gated")))
    return F.array(*rows)


def classified(text: Column) -> Column:
    """struct(category_id, category_name, confidence) of the topic with most signals, ties to the larger id.

    text is in lower case. A topic needs its gate: the host, or, for topics about proteins, a protein and one of the
    words in ASKED (topic 03: the host too). Names of the host are no signals; topic 03 gains 4 where the host and a
    protein meet as words, topic 13 gains 2 where something is expressed. A keyword of one word is compared with the
    text's tokens, read once; the catalogue is a constant in the plan, so there is no join."""
    within = lambda ws: F.exists(ws, lambda w: F.contains(text, w))

    def score(t: Column, s: Column) -> Column:
        signals = F.size(F.array_intersect(s["tokens"], t["words"])) + F.size(F.filter(t["phrases"], lambda w: F.contains(text, w)))
        signals = signals + F.when((t["id"] == "03") & s["host_word"] & s["protein"], 4).when((t["id"] == "13") & s["expressed"], 2).otherwise(0)
        asked = F.arrays_overlap(s["tokens"], t["asked"]) | within(t["asked_phrases"])
        gate = F.when(t["gated"], s["protein"] & asked & ((t["id"] != "03") | s["host"])).otherwise(s["host"])
        return F.struct(F.when(gate, signals).otherwise(0).alias("score"), t["id"].alias("category_id"), t["name"].alias("category_name"))

    seen = F.struct(
        F.array_distinct(F.regexp_extract_all(text, F.lit("([a-z0-9'-]+)"), 1)).alias("tokens"),
        within(_texts(HOSTS)).alias("host"),
        within(_texts(PROTEINS)).alias("protein"),
        F.arrays_overlap(F.split(text, r"\s+"), _texts(["pichia", "pastoris"])).alias("host_word"),
        within(_texts(EXPRESSED)).alias("expressed"),
    )
    best = lambda s: F.array_max(F.transform(_catalogue(), lambda t: score(t, s)))
    kind = lambda i, name, c: F.struct(i.alias("category_id"), name.alias("category_name"), c.alias("confidence"))
    sure = lambda b: F.bround(F.least(F.lit(0.9), 0.45 + b["score"] * 0.12), 2)
    chosen = lambda b: F.when(b["score"] > 0, kind(b["category_id"], b["category_name"], sure(b))).otherwise(kind(F.lit(OTHER[0]), F.lit(OTHER[1]), F.lit(0.25)))
    # Each transform over an array of one binds a value that is used more than once.
    return F.get(F.transform(F.transform(F.array(seen), best), chosen), F.lit(0))


# What a brief's topics ask of an item's text besides their keywords.
SHOWN_HOSTS, SHOWN_PROTEINS = ["pichia", "komagataella", "pastoris", "毕赤", "毕赤酵母"], ["lactoferrin", "osteopontin", "乳铁蛋白", "骨桥蛋白"]
SHOWN_ASKED = {
    "02": ["review", "overview", "meta-analysis", "systematic review", "综述"],
    "04": ["glycosylation", "phosphorylation", "post-translational", "ptm", "糖基化", "磷酸化"],
    "15": ["purification", "separation", "chromatography", "fermentation broth", "纯化", "分离"],
}
SHOWN_MADE = ["recombinant", "heterologous", "expression", "expressing", "secretion", "production"]
SHOWN_EXPRESSED = ["recombinant", "heterologous", "expression", "expressing", "expressed", "production", "secretion"]
SHOWN_STRONG = ["protein expression", "recombinant protein", "heterologous protein"]


def topic_ids(text: Column, category_id: Column) -> Column:
    """The topics of a brief that an item belongs to, in order: the one it is classified as and, unless it is classified as none,
    those whose gate its text passes with enough signals (one for topics 01, 02 and 13, two for others)."""
    import re

    def ids(s: Column) -> Column:
        stands = lambda w: F.array_contains(s["tokens"], w) if re.fullmatch(r"[a-z0-9'-]+", w) else F.contains(s["text"], F.lit(w))
        some = lambda ws: F.array_max(F.array(*[stands(w).cast("int") for w in ws])) == 1
        out = []
        for topic, _, words in TOPICS:
            signals = sum((stands(w).cast("int") for w in words if w not in HOSTS), F.lit(0))
            gate = s["host"] & s["protein"] if topic == "03" else s["protein"] & some(SHOWN_ASKED[topic]) if topic in SHOWN_ASKED else s["host"]
            enough = signals >= (1 if topic in ("01", "02") else 2)
            if topic == "03":
                enough = enough & some(SHOWN_MADE)
            if topic == "13":
                enough = some(SHOWN_STRONG) | ((signals >= 1) & some(SHOWN_EXPRESSED))
            free = ~category_id.isin("", OTHER[0])
            out.append(F.when((category_id == topic) | (free & gate & enough), F.lit(topic)))
        return F.array_compact(F.array(*out))

    within = lambda ws: F.exists(_texts(ws), lambda w: F.contains(text, w))
    seen = F.struct(text.alias("text"), F.array_distinct(F.regexp_extract_all(text, F.lit("([a-z0-9'-]+)"), 1)).alias("tokens"), within(SHOWN_HOSTS).alias("host"), within(SHOWN_PROTEINS).alias("protein"))
    return tx.bound(seen, ids)


def topic_groups(items: DataFrame) -> DataFrame:
    """(topic_id, hit_count, high_count) of every topic, with none too, over items(candidate_id, priority, topics)."""
    names = items.sparkSession.createDataFrame([(i,) for i, _, _ in TOPICS], "topic_id string")
    n = items.select("priority", F.explode("topics").alias("topic_id")).groupBy("topic_id").agg(F.count("*").alias("hit_count"), F.count_if(F.col("priority") == "high").alias("high_count"))
    return names.join(n, "topic_id", "left").select("topic_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hit_count", "high_count")])


def topic_summary(items: DataFrame) -> DataFrame:
    """One row: places shown, different candidates, repeats, topics with a hit, over items(candidate_id, topics)."""
    shown = items.select("candidate_id", F.explode("topics").alias("topic_id"))
    s = shown.agg(F.count("*").alias("display_count"), F.count_distinct(F.when(F.col("candidate_id") != "", F.col("candidate_id"))).alias("unique_count"), F.count_distinct("topic_id").alias("hit_category_count"))
    return s.withColumn("duplicate_count", F.greatest(F.col("display_count") - F.col("unique_count"), F.lit(0)))
