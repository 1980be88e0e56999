"""Text functions: search normalisation, identifiers, metrics, formatting. All are column expressions, unless they
prepare a query on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alias rewrites, in order. Results depend on both the order and the exact wording.
ALIASES = [
    (r"2\s*[′’']?\s*-?\s*fl\b", "2'-FL 2-FL 2-fucosyllactose"),
    (r"3\s*[′’']?\s*-?\s*fl\b", "3-FL 3-fucosyllactose"),
    (r"\blnt\s*ii\b|\blntii\b", "LNT II lacto-N-triose II"),
    (r"\blnnt\b", "LNnT lacto-N-neotetraose"),
    (r"\blnt\b(?!\s*ii)", "LNT lacto-N-tetraose"),
    (r"\be\.\s*coli\b", "E. coli Escherichia coli"),
    (r"\budp\s*-\s*gal\b", "UDP-Gal UDP-galactose"),
    (r"\budp\s*-\s*glcnac\b", "UDP-GlcNAc UDP-N-acetylglucosamine"),
    (r"\bhmos?\b", "HMO human milk oligosaccharide human milk oligosaccharides"),
]
# Words that never become search terms.
STOPWORDS = ["the", "and", "for", "with", "from", "that", "this", "what", "how", "are", "was", "were", "into", "over", "high", "problem", "pdf", "text", "chunk"]
# What counts as a metric in a text.
METRICS = [
    r"\b\d+(?:\.\d+)?\s*(?:g/L|mg/L|g l-1|mg l-1|mM|uM|µM|OD600|h|hr|hours?)\b",
    r"\b(?:titer|titre|yield|productivity|conversion|concentration|OD600|optical density)\b",
]
TOKEN = r"[a-z0-9]+|[一-鿿]+"
NOT_SEARCHED = r"[^a-z0-9一-鿿]+"


def filled(c: Column) -> Column:
    """Null where the text is null or blank: the empty text counts as missing."""
    return F.when(F.trim(c) != "", c)


def first_filled(*cs: Column) -> Column:
    """The first text that is not blank, trimmed, or the empty text."""
    return F.coalesce(*[filled(F.trim(c)) for c in cs], F.lit(""))


#: What a text in lower case has to hold for the aliases (first, end) to match at all.
ALIAS_HINTS = [(("fl",), 0, 2), (("lnt", "lnnt"), 2, 5), (("col",), 5, 6), (("udp",), 6, 8), (("hmo",), 8, 9)]


def bound(c: Column, f) -> Column:
    """f(c) with c computed once, however often f uses it: a lambda's variable isn't inlined."""
    return F.element_at(F.transform(F.array(c), f), 1)


def expand_aliases(c: Column, lower: bool = False) -> Column:
    """Spells out abbreviations; a second pass expands again, so apply it once. Cheap tests spare most texts most of the
    patterns. lower: the text is in lower case, and so are the replacements."""
    for hints, first, end in ALIAS_HINTS:
        c = bound(c, _expansion(hints, ALIASES[first:end], lower))
    return c


def _expansion(hints: tuple[str, ...], aliases: list[tuple[str, str]], lower: bool):
    def step(t):
        out, low, hit = t, t if lower else F.lower(t), F.lit(False)
        for pattern, to in aliases:
            out = F.regexp_replace(out, f"(?iU){pattern}", to.lower() if lower else to)
        for h in hints:
            hit = hit | F.contains(low, F.lit(h))
        return F.when(hit, out).otherwise(t)

    return step


def normalize_search(c: Column) -> Column:
    """Lower-case tokens of ASCII letters, digits and CJK, one space apart; null is the empty text."""
    c = F.replace(expand_aliases(F.lower(F.coalesce(c, F.lit(""))), lower=True), F.lit("­"), F.lit(""))
    # Two patterns that rarely match are faster than one that matches every single space.
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^a-z0-9一-鿿 ]+", " "), " {2,}", " "))


def once(c: Column) -> Column:
    """c, computed once a row: a generator is a barrier to inlining, which would repeat c in every use and filter."""
    return F.explode(F.array(c))


def normalize_query(text: str) -> str:
    """normalize_search() for a query, on the driver."""
    for pattern, to in ALIASES:
        text = re.sub(pattern, to, text, flags=re.IGNORECASE)
    return re.sub(NOT_SEARCHED, " ", text.lower().replace("­", "")).strip()


def index_terms(normalized: Column) -> Column:
    """Distinct terms of a normalised text: two characters at least, no stopwords."""
    found = F.array_distinct(F.regexp_extract_all(normalized, F.lit(f"({TOKEN})"), 1))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS))


def query_index_terms(text: str) -> list[str]:
    return sorted({t for t in re.findall(TOKEN, normalize_query(text)) if len(t) >= 2 and t not in STOPWORDS})


# Terms that a query gains when it holds one of the triggers, with their weights.
TRIGGERED = [
    (("lnt ii", "lnt-ii"), [("lnt ii", 0.30), ("lacto-n-triose ii", 0.30), ("lgtA", 0.20), ("RBS", 0.18)]),
    (("e coli", "escherichia coli"), [("escherichia coli", 0.16), ("e. coli", 0.16)]),
    (("metabolic", "carbon flux"), [("metabolic", 0.08), ("carbon flux", 0.12)]),
    (("pathway", "biosynthesis"), [("pathway", 0.08), ("biosynthesis pathway", 0.10)]),
    (("intermediate",), [("intermediate", 0.10)]),
    (("accumulation", "accumulated"), [("accumulation", 0.10), ("accumulated", 0.10)]),
    (("engineering", "strategy"), [("engineering", 0.08), ("strategy", 0.08)]),
]


def query_terms(query: str) -> dict[str, float]:
    """Weighted search terms of a query; the largest weight of a term counts."""
    text = normalize_query(query)
    weighted = [(t, 0.04) for t in re.findall(r"[a-z0-9][a-z0-9']{2,}", text) if t not in STOPWORDS]
    weighted += [(t, 0.18) for t in re.findall(r"\b[a-z0-9][a-z0-9']*\s+(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)\b", text)]
    weighted += [pair for triggers, pairs in TRIGGERED if any(t in text for t in triggers) for pair in pairs]
    out: dict[str, float] = {}
    for term, weight in weighted:
        key = normalize_query(term)
        if key:
            out[key] = max(out.get(key, 0.0), weight)
    return out


def distinct_text(items: Column) -> Column:
    """Texts of an array trimmed, blanks dropped, the first of those equal but for case kept, order kept."""
    trimmed = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    keys = F.transform(trimmed, lambda x: F.lower(x))
    return F.filter(trimmed, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def metrics(c: Column) -> Column:
    """Quantities with units, then metric words, as they stand in the text."""
    c = F.coalesce(c, F.lit(""))
    return F.concat(*[F.regexp_extract_all(c, F.lit(f"(?i)({p})"), 1) for p in METRICS])


def split_list(c: Column) -> Column:
    """Items of a text list, parted by comma, semicolon, bar or slash."""
    return F.filter(F.transform(F.split(c, r"[,;|/]\s*"), lambda x: F.trim(x)), lambda x: x != "")


def strip_tags(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def doi(c: Column) -> Column:
    c = F.trim(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)^https?://(?:dx\.)?doi\.org/", ""), r"(?i)^doi:\s*", "")
    c = F.lower(F.btrim(F.trim(c), F.lit(".")))
    found = F.regexp_extract(c, r"(10\.\d{4,9}/\S+)", 1)
    return F.when(found != "", F.rtrim(found, F.lit(").,;"))).otherwise(c)


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\D+", "")


def pmcid(c: Column) -> Column:
    return F.when(digits(c) != "", F.concat(F.lit("PMC"), digits(c))).otherwise("")


def openalex_id(c: Column) -> Column:
    return F.upper(F.substring_index(F.rtrim(F.trim(F.coalesce(c, F.lit(""))), F.lit("/")), "/", -1))


def title_key(c: Column) -> Column:
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(c, NOT_SEARCHED, " "))


def year(c: Column) -> Column:
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"\b((?:19|20)\d{2})\b", 1)
    return F.when(found != "", found.cast("int"))


def partial_date(c: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD, missing parts 01; null where it is no date."""
    y, m, d = (F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", i) for i in (1, 2, 3))
    whole = F.concat_ws("-", y, F.lpad(F.when(m == "", "1").otherwise(m), 2, "0"), F.lpad(F.when(d == "", "1").otherwise(d), 2, "0"))
    return F.when(y != "", F.try_to_timestamp(whole, F.lit("yyyy-MM-dd")).cast("date"))


def point_id(paper_id: Column, chunk_id: Column) -> Column:
    """63-bit id: the first 16 hexadecimal digits of an MD5, modulo 2^63."""
    whole = F.conv(F.substring(F.md5(F.concat(paper_id, F.lit(":"), chunk_id)), 1, 16), 16, 10).cast("decimal(20,0)")
    return (whole % F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")


def clip(c: Column, most: int) -> Column:
    """At most `most` characters, cut behind the last whole word."""
    cut = F.regexp_replace(F.substring(c, 1, most), r"\s\S*\z", "")
    return F.when(F.length(c) <= most, c).otherwise(cut)


def first_sentence(c: Column) -> Column:
    """The first sentence of 20 to 260 characters and its stop, else the first 260 characters."""
    c = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    found = F.regexp_extract(c, r"(.{20,260}?[。.!?])(?:\s|$)", 1)
    return F.when(found != "", F.trim(found)).otherwise(F.trim(F.substring(c, 1, 260)))


def authors(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r";|\band\b"), lambda x: F.trim(x)), lambda x: x != "")


def from_inverted_index(index: Column) -> Column:
    """The text that a map of word to positions describes."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def json_object(c: Column) -> Column:
    """The JSON object inside a model's answer: fences off, else from the first brace to the last."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)(\{.*\})", 1)


def safe_name(c: Column, most: int = 80) -> Column:
    return F.substring(F.btrim(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), F.lit("_")), 1, most)


def duration(seconds: Column) -> Column:
    return F.when(seconds.isNull(), "-").when(seconds < 0.1, "<0.1s").when(seconds < 60, F.format_string("%.1fs", seconds)).otherwise(F.format_string("%dm%02ds", F.floor(seconds / 60).cast("int"), F.floor(seconds % 60).cast("int")))


def occurrences(text: Column, term: str) -> Column:
    """Times a term stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def word_in(text: Column, keyword: str) -> Column:
    """A keyword of ASCII letters stands as a word of its own, any other keyword anywhere. The keyword is lowered, the text isn't:
    letters of either case border on a word."""
    k = keyword.strip().lower()
    if not k:
        return F.lit(False)
    if re.fullmatch(r"[a-z0-9'-]+", k):
        return text.rlike(rf"(?<![A-Za-z0-9'-]){re.escape(k)}(?![A-Za-z0-9'-])")
    return F.contains(text, F.lit(k))


def boolean_query(text: Column, query: str) -> Column:
    """AND of OR-groups: a group's tokens of three characters at least, any of which may stand in the text; six groups at most.
    Without an operator every token must stand there."""
    raw = query.strip()
    parts = re.split(r"\s+AND\s+", raw, flags=re.IGNORECASE) if re.search(r"\b(?:AND|OR)\b", raw) else re.findall(r"\S+", raw)
    keep = F.lit(True)
    for part in parts[:6]:
        tokens = [t for t in re.findall(r"[a-z0-9][a-z0-9'-]{2,}", part.lower()) if t not in ("and", "not")]
        if tokens:
            any_of = F.lit(False)
            for t in tokens:
                any_of = any_of | F.contains(F.lower(text), F.lit(t))
            keep = keep & any_of
    return keep
