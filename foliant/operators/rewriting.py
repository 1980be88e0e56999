"""Query rewriting by rule: aliases, intents, evidence wanted, variants, the query that looks for context, the route limit.

A query is a row with its text in `raw` and, where a model has answered, any of the columns in ANSWERED; what is missing
counts as empty. All of it is column expressions, so a log of queries is rewritten like one query.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as tx

# Names that stand for one another; the last group names an organism, the others products.
ALIAS_GROUPS = [
    ["LNT II", "LNTII", "lacto-N-triose II"],
    ["LNT", "lacto-N-tetraose"],
    ["LNnT", "lacto-N-neotetraose"],
    ["2'-FL", "2-FL", "2-fucosyllactose"],
    ["3-FL", "3-fucosyllactose"],
    ["E. coli", "Escherichia coli"],
]
# What shows an intent, a wish for tables, a wish for evidence.
INTENTS = {
    "mechanism": ["why", "mechanism", "原因", "为什么", "机理", "机制"],
    "engineering_strategy": ["strategy", "engineering", "改造", "策略", "逻辑"],
    "pathway": ["pathway", "route", "通路", "路径", "途径"],
    "production": ["production", "yield", "titer", "产量", "滴度", "提高"],
    "comparison": ["compare", "versus", "vs", "对比", "比较"],
}
FOR_TABLES = ["table", "表格", "titer", "yield", "产量", "滴度"]
FOR_EVIDENCE = ["which", "evidence", "passage", "report", "reports", "table", "figure", "g/l", "mg/l", "yield", "titer"]
PREFERENCES = ["any", "text", "table"]

LISTS = ["products", "organisms", "genes", "enzymes", "metrics", "intents", "aliases", "variants"]
ANSWERED = ["normalized_query", "evidence_preference", *LISTS]
MOST_VARIANTS = 4


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _none() -> Column:
    return F.array().cast("array<string>")


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(_texts(words), lambda w: F.contains(text, w))


def distinct(items: Column) -> Column:
    """White space made single, blanks dropped, the first of those equal but for case."""
    return tx.distinct_text(F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))))


def _stands(spaced: Column, alias: str) -> Column:
    key = re.sub(r"[^a-z0-9]+", " ", alias.lower()).strip()
    behind = r"(?!\s+ii)" if key == "lnt" else ""
    return spaced.rlike(rf"(?<![a-z0-9]){re.escape(key)}{behind}(?![a-z0-9])")


def aliases_in(text: Column) -> Column:
    """All names of the groups of which one stands in the text."""
    spaced = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")

    def found(s: Column) -> Column:
        groups = []
        for group in ALIAS_GROUPS:
            hit = F.lit(False)
            for alias in group:
                hit = hit | _stands(s, alias)
            groups.append(F.when(hit, _texts(group)))
        return F.flatten(F.array_compact(F.array(*groups)))

    return tx.bound(spaced, found)


def intents_in(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(_any(low, words), F.lit(name)) for name, words in INTENTS.items()]))


def evidence_wanted(text: Column) -> Column:
    return F.when(_any(F.lower(text), FOR_TABLES), "table").otherwise("any")


def _groups_named(aliases: Column, groups: list[list[str]]) -> Column:
    low = F.transform(aliases, lambda a: F.lower(a))
    return F.flatten(F.array_compact(F.array(*[F.when(F.arrays_overlap(low, _texts([a.lower() for a in g])), _texts(g)) for g in groups])))


def rewritten(queries: DataFrame) -> DataFrame:
    """queries with every column of ANSWERED filled: what a model has answered, completed by rule. variants are four at most."""
    given = lambda c, empty: F.coalesce(F.col(c), empty) if c in queries.columns else empty
    raw = F.trim(F.coalesce("raw", F.lit("")))
    q = queries.withColumns({"raw": raw, **{c: given(c, _none()) for c in LISTS}, **{c: F.trim(given(c, F.lit(""))) for c in ("normalized_query", "evidence_preference")}})
    said = F.concat_ws(" ", "raw", "normalized_query", "evidence_preference", *[F.array_join(c, " ") for c in LISTS])
    q = q.withColumn("aliases", distinct(F.concat("aliases", aliases_in(said))))
    q = q.withColumns(
        {
            "products": distinct(F.concat("products", _groups_named(F.col("aliases"), ALIAS_GROUPS[:-1]))),
            "organisms": distinct(F.concat("organisms", _groups_named(F.col("aliases"), ALIAS_GROUPS[-1:]))),
            "intents": distinct(F.concat("intents", intents_in(F.col("raw")))),
            **{c: distinct(F.col(c)) for c in ("genes", "enzymes", "metrics")},
            "evidence_preference": F.when(F.lower("evidence_preference").isin(PREFERENCES), F.lower("evidence_preference")).otherwise(evidence_wanted(F.col("raw"))),
        }
    )
    parts = distinct(F.concat("products", "organisms", "genes", "enzymes", "metrics", "intents", "aliases"))
    built = F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(F.col("raw"))
    q = q.withColumn("normalized_query", F.when(F.col("normalized_query") != "", F.col("normalized_query")).otherwise(built))
    return q.withColumn("variants", F.slice(distinct(F.concat(F.array("normalized_query"), "variants", rule_variants())), 1, MOST_VARIANTS))


def rule_variants() -> Column:
    """Entities alone, then entities with the mechanism, the strategy or the metrics asked for; over the columns of rewritten()."""
    first = lambda c, n: F.slice(c, 1, n)
    joined = lambda *arrays: F.array_join(F.concat(*arrays), " ")
    some = F.size("products") > 0
    wants = lambda *names: F.arrays_overlap("intents", _texts(list(names)))
    return F.array_compact(
        F.array(
            joined(first("products", 2), first("organisms", 1), first("genes", 3)),
            F.when(some & wants("mechanism", "pathway"), joined(first("products", 2), _texts(["biosynthesis pathway mechanism"]))),
            F.when(some & wants("engineering_strategy"), joined(first("products", 2), first("genes", 2), _texts(["metabolic engineering strategy"]))),
            F.when(some & (F.size("metrics") > 0), joined(first("products", 2), first("metrics", 3))),
        )
    )


def _clipped(text: Column, most: int) -> Column:
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.substring(text, 1, most)
    whole = F.trim(F.regexp_replace(cut, " [^ ]*$", ""))
    return F.when(F.length(text) <= most, text).when(whole != "", whole).otherwise(F.trim(cut))


def context_query(fallback: Column, most_terms: int = 20, most_chars: int = 360) -> Column:
    """A compact query over the columns of rewritten(): a term whose words an earlier term holds is left out, terms are
    taken as long as they fit; the fallback where there is no term."""
    first = lambda c, n: F.slice(c, 1, n)
    terms = distinct(F.concat(F.array("normalized_query"), first("products", 4), first("organisms", 2), first("genes", 4), first("enzymes", 3), first("metrics", 4), first("aliases", 4), first("variants", 2)))
    key = lambda t: F.trim(F.regexp_replace(F.lower(t), tx.NOT_SEARCHED, " "))
    within = lambda k, keys: (k != "") & F.exists(keys, lambda e: F.contains(F.concat(F.lit(" "), e, F.lit(" ")), F.concat(F.lit(" "), k, F.lit(" "))))
    state = lambda a, b: F.struct(a.alias("terms"), b.alias("keys"))
    add = lambda s, t: F.when(within(key(t), s["keys"]), s).otherwise(state(F.concat(s["terms"], F.array(t)), F.concat(s["keys"], F.array(key(t)))))
    kept = F.slice(F.aggregate(terms, state(_none(), _none()), add)["terms"], 1, max(1, most_terms))

    def joined(ts: Column) -> Column:
        upto = lambda i: F.array_join(F.slice(ts, F.lit(1), i), " ")
        n = F.size(F.filter(F.sequence(F.lit(1), F.size(ts)), lambda i: F.length(upto(i)) <= most_chars))
        return F.when(F.size(ts) == 0, _clipped(fallback, most_chars)).when(n == 0, _clipped(F.get(ts, F.lit(0)), most_chars)).otherwise(_clipped(upto(n), most_chars))

    return tx.bound(kept, joined)


def route_limit(query: Column, requested: Column, adaptive: Column) -> Column:
    """struct(limit, reason): two routes for a short generic query, all for one that asks for evidence, metrics, known names or
    three entities or more; over the columns of rewritten()."""
    entities = F.size("products") + F.size("organisms") + F.size("genes") + F.size("enzymes")
    rich = _any(F.lower(query), FOR_EVIDENCE) | (F.col("evidence_preference") == "table") | (F.size("metrics") > 0) | (F.size("aliases") > 0) | (entities >= 3)
    out = lambda n, why: F.struct(n.cast("int").alias("limit"), F.lit(why).alias("reason"))
    return (
        F.when(~adaptive, out(requested, "fixed"))
        .when(requested <= 2, out(requested, "already_compact"))
        .when(rich, out(requested, "evidence_or_structured_query"))
        .otherwise(out(F.least(requested, F.lit(2)), "compact_generic_query"))
    )
