"""Table matrices as array<array<string>>: padding, headers, validity, quality, trimming, repair, unfolding.

Everything is a column expression over one row's matrix: nothing shuffles and nothing leaves the JVM. Functions that
take a matrix expect the output of normalized(): rows of equal width, cells trimmed, empty cells ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that mark a header row.
HEADER_WORDS = ["product", "yield", "reference", "substrate", "enzyme", "key enzyme", "reaction", "host", "strain", "characteristic", "cultivation", "company", "brand", "brands", "country"]
# Words that mark running text. They count wherever they stand, inside of words too.
PROSE_WORDS = [
    "the", "of", "and", "was", "were", "that", "this", "from", "with", "for", "are", "not", "but", "had", "has", "have", "been", "which", "their", "also", "between", "after", "during", "over",
    "into", "than", "about", "more", "some", "these", "those", "each", "both", "such", "only", "other", "they", "them", "then", "there", "therefore", "however", "although", "because", "while", "where",
    "when", "upon", "within", "without", "through", "under", "significantly", "respectively", "additionally", "interestingly",
    "pathway", "synthesis", "enzymes", "increasing", "yield", "metabolic", "genes", "effects", "production", "introduced", "strengthened",
]
# Limits of the rules.
LONG_CELL, HUGE_CELL, PROSE_CELL = 50, 200, 30
SPACE = " \t\n\r\f\x0b"
FOOTNOTE = r"[+\-*†‡§¶#−‐‑‒–—―]|^[a-z]\)|^[a-z]\s"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: as an expression it would be computed anew wherever body uses it, in
    lambdas once an element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _any(cells: Column) -> Column:
    return F.exists(cells, lambda c: c != "")


def _filled(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: c != ""))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def normalized(matrix: Column) -> Column:
    """Rows padded to the widest, line breaks made spaces, cells trimmed, rows without any text left out."""
    width = F.array_max(F.transform(matrix, lambda r: F.coalesce(F.size(r), F.lit(0))))
    clean = lambda r: F.transform(r, lambda c: F.btrim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(SPACE)))
    rows = F.transform(F.filter(matrix, lambda r: r.isNotNull()), lambda r: F.concat(clean(r), F.array_repeat(F.lit(""), width - F.size(r))))
    none = F.array().cast("array<array<string>>")
    return F.when(F.coalesce(width, F.lit(0)) < 1, none).otherwise(F.filter(rows, _any))


def prose_words(text: Column) -> Column:
    """How often the words of running text stand in a text; occurrences of one word don't overlap."""
    times = lambda low, w: ((F.length(low) - F.length(F.replace(low, w, F.lit("")))) / F.length(w)).cast("int")
    return _let(F.lower(text), lambda low: _total(F.transform(F.array(*[F.lit(w) for w in PROSE_WORDS]), lambda w: times(low, w))))


def _holds_header(text: Column) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in HEADER_WORDS]), lambda w: F.contains(text, w))


def _line(row: Column) -> Column:
    return F.lower(F.array_join(row, " "))


def header_row(m: Column) -> Column:
    """Index from 0 of the first row of two cells that holds a header word; else of the row behind the first that
    says `table `, where that one has two cells, or of that row itself; else 0."""
    named = F.transform(m, lambda r: (_filled(r) >= 2) & _holds_header(_line(r)))
    said = F.array_position(F.transform(m, lambda r: F.contains(_line(r), F.lit("table "))), True).cast("int")
    behind = F.get(m, said)
    by_title = F.when(said == 0, 0).when(behind.isNotNull() & (_filled(behind) >= 2), said).otherwise(said - 1)
    return F.when(F.array_contains(named, True), F.array_position(named, True).cast("int") - 1).otherwise(by_title)


def rotated(m: Column, header: Column) -> Column:
    """The header row first, the rows before it last."""
    return F.concat(F.slice(m, header + 1, F.size(m)), F.slice(m, F.lit(1), header))


def markdown(m: Column, header: Column) -> Column:
    """Header, rule and the rows behind the header."""
    rows = F.concat(F.slice(m, header + 1, F.lit(1)), F.array(F.transform(F.get(m, header), lambda _: F.lit("---"))), F.slice(m, header + 2, F.size(m)))
    text = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))), "\n")
    return F.when(F.size(m) > 0, text).otherwise("")


def garbled(cell: Column) -> Column:
    """Five letters or more, no vowel anywhere, and not a mix of upper and lower case."""
    letters = F.regexp_replace(cell, r"[^\p{L}]", "")
    return (F.length(letters) >= 5) & ~cell.rlike("[aeiouyAEIOUY]") & ~(cell.rlike(r"\p{Lu}") & cell.rlike(r"\p{Ll}"))


def mixed_prose(row: Column) -> Column:
    """Three cells or more, two with digits, that read as running text of 70 characters or more."""
    cells = F.filter(row, lambda c: c != "")
    text = F.array_join(cells, " ")
    return (F.size(cells) >= 3) & (F.length(text) >= 70) & (F.size(F.filter(cells, lambda c: c.rlike(r"\d"))) >= 2) & (prose_words(text) >= 4)


def is_valid(m: Column, header: Column) -> Column:
    """Three rows, two columns and data behind the header; not garbled, not running text cut into cells."""
    head, data, before = F.get(m, header), F.slice(m, header + 2, F.size(m)), F.slice(m, F.lit(1), header)

    def good(data: Column, sample: Column) -> Column:
        bad = F.size(F.filter(sample, garbled)) / F.greatest(F.size(sample), F.lit(1)) > 0.4
        signal = (_holds_header(_line(head)) | F.contains(_line(head), F.lit("table "))) & ~mixed_prose(head)
        pseudo = _let(F.size(F.filter(data, mixed_prose)), lambda n: ~signal & (n >= 2) & (n / F.greatest(F.size(data), F.lit(1)) >= 0.25))
        body = (_filled(head) <= 2) & (F.size(F.filter(sample, lambda c: F.length(c) >= LONG_CELL)) >= 3)
        return (F.size(data) >= 2) & F.exists(data, _any) & ~bad & ~pseudo & ~body

    sample = F.filter(F.flatten(F.concat(before, F.array(head), F.slice(data, 1, 3))), lambda c: c != "")
    fit = _let(data, lambda data: _let(sample, lambda sample: good(data, sample)))
    return F.coalesce((F.size(m) >= 3) & (F.size(head) >= 2) & fit, F.lit(False))


def mode_width(m: Column) -> Column:
    """struct(n, first, width): the most frequent count of filled cells; of equally frequent ones the first to come."""
    one = lambda counts, c: F.struct(F.size(F.filter(counts, lambda x: x == c)).alias("n"), (-F.array_position(counts, c)).alias("first"), c.alias("width"))
    return _let(F.transform(m, _filled), lambda counts: F.array_max(F.transform(F.array_distinct(counts), lambda c: one(counts, c))))


def quality(m: Column) -> Column:
    """struct(consistency, fill, prose, descriptive, reasons): shares rounded to two places."""
    measured = lambda cells: F.struct(
        F.size(m).alias("n"),
        F.array_max(F.transform(m, _filled)).alias("most"),
        mode_width(m)["n"].alias("usual"),
        F.size(cells).alias("filled"),
        F.aggregate(m, F.lit(0), lambda a, r: a + F.size(r)).alias("cells"),
        F.size(F.filter(cells, lambda c: (F.length(c) >= LONG_CELL) & (prose_words(c) >= 3))).alias("prose"),
    )
    return _let(F.filter(F.flatten(m), lambda c: c != ""), lambda cells: _let(measured(cells), _graded))


def _graded(s: Column) -> Column:
    n, most, prose_cells = s["n"], s["most"], s["prose"]
    consistency, fill = s["usual"] / n, 1 - (s["cells"] - s["filled"]) / (n * most)
    prose = F.when(s["filled"] > 0, prose_cells / s["filled"]).otherwise(0.0)
    descriptive = (consistency >= 0.9) & (fill >= 0.7) & (n >= 4) & (most >= 3)
    reasons = F.array_compact(F.array(F.when(consistency < 0.8, "low_consistency"), F.when(fill < 0.4, "low_fill_rate"), F.when(~descriptive & ((prose_cells >= 3) | (prose >= 0.3)), "prose_like_cells")))
    full = lambda a, b, c, d, e: F.struct(a.alias("consistency"), b.alias("fill"), c.alias("prose"), d.alias("descriptive"), e.alias("reasons"))
    short = lambda x, why: full(F.lit(x), F.lit(x), F.lit(0.0), F.lit(False), F.array(F.lit(why)))
    return (
        F.when(n < 2, short(0.0, "empty_or_too_short"))
        .when(most < 2, short(0.0, "too_few_columns"))
        .when(n < 4, short(1.0, "too_few_data_rows"))
        .otherwise(full(F.bround(consistency, 2), F.bround(fill, 2), F.bround(prose, 2), descriptive, reasons))
    )


def without_tail(m: Column) -> Column:
    """Drops the rows at the end that are sparse against the usual row and read as text or have two cells at most.

    The last row that is no such row decides, so no loop is needed; two rows always stay."""

    def cut(m: Column, usual: Column) -> Column:
        loose = lambda r: (_filled(r) <= usual * 0.5) & ((_filled(r) <= 2) | F.exists(r, lambda c: (F.length(c) >= LONG_CELL) & (prose_words(c) >= 3)))
        firm = F.array_max(F.transform(m, lambda r, i: F.when(loose(r), 0).otherwise(i + 1)))
        return F.when((F.size(m) < 3) | (usual < 3), m).otherwise(F.slice(m, F.lit(1), F.greatest(firm, F.lit(2))))

    return _let(m, lambda m: F.when(F.size(m) > 0, _let(mode_width(m)["width"], lambda usual: cut(m, usual))).otherwise(m))


def before_prose(m: Column) -> Column:
    """The rows before the first that is running text: a huge cell, a sparse row in a wide table that is no footnote,
    or a cell of running text; then without_tail()."""

    def breaks(counts: Column, r: Column, i: Column) -> Column:
        sparse = (F.array_max(F.slice(counts, F.lit(1), i + 1)) >= 5) & (_filled(r) <= 2) & (i >= 2)
        note = F.array_join(F.filter(r, lambda c: c != ""), " ").rlike(FOOTNOTE)
        text = F.exists(r, lambda c: (F.length(c) >= PROSE_CELL) & (prose_words(c) >= 4))
        return F.exists(r, lambda c: F.length(c) > HUGE_CELL) | F.when(sparse, ~note).otherwise(text)

    at = _let(F.transform(m, _filled), lambda counts: F.array_position(F.transform(m, lambda r, i: breaks(counts, r, i)), True).cast("int"))
    return without_tail(_let(at, lambda at: F.when(at > 0, F.slice(m, F.lit(1), at - 1)).otherwise(m)))


def transposed(m: Column) -> Column:
    """Columns as rows; the matrix has rows of equal width."""
    none = F.array().cast("array<array<string>>")

    def turned(m: Column) -> Column:
        width = F.coalesce(F.size(F.get(m, F.lit(0))), F.lit(0))
        return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(m, lambda r: F.get(r, j)))).otherwise(none)

    return _let(m, turned)


def without_empty_columns(m: Column) -> Column:
    return transposed(F.filter(transposed(m), _any))


def _fragment(cell: Column) -> Column:
    t = F.btrim(cell, F.lit(".,;:()[]"))
    return (t != "") & (F.length(t) <= 6) & t.rlike(r"\p{L}") & ~t.rlike(r"\d") & ~F.lower(t).isin(sorted({*PROSE_WORDS, *HEADER_WORDS}))


def _worded(cell: Column) -> Column:
    return cell.rlike(r"\p{L}")


def _joined(left: Column, right: Column, compact: bool) -> Column:
    close = F.concat(left, right) if compact else F.concat_ws(" ", left, right)
    apart = F.concat_ws(" ", left, right)
    return F.when(left == "", right).when(right == "", left).when(F.lit(compact) & _worded(left) & _fragment(right), close).otherwise(apart)


def _folded(cols: Column, least: int, merges, compact: bool) -> Column:
    """Columns folded from the left: one that merges() joins the last one kept."""
    last = lambda acc: F.element_at(acc, -1)
    join = lambda acc, c: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.zip_with(last(acc), c, lambda a, b: _joined(a, b, compact))))
    step = lambda acc, c: F.when(merges(acc, last(acc), c), join(acc, c)).otherwise(F.concat(acc, F.array(c)))
    whole = lambda cols: F.aggregate(F.slice(cols, F.lit(2), F.size(cols)), F.slice(cols, 1, 1), step)
    return _let(cols, lambda cols: F.when(F.size(cols) >= least, whole(cols)).otherwise(cols))


def repaired(m: Column) -> Column:
    """Empty columns dropped, columns of ± values joined to the values before them, columns of word fragments joined to
    the words before them. No text is lost."""
    error = lambda c: c.rlike(r"^(?:±|\+/-|\+|−|-)\s*\d")

    def of_errors(acc: Column, left: Column, right: Column) -> Column:
        cells = F.filter(right, lambda c: c != "")
        return (F.size(cells) > 0) & (F.size(F.filter(cells, error)) >= 0.45 * F.size(cells))

    def of_fragments(acc: Column, left: Column, right: Column) -> Column:
        cells = F.filter(right, lambda c: c != "")
        paired = F.filter(F.arrays_zip(left.alias("l"), right.alias("r")), lambda p: (p["l"] != "") & (p["r"] != ""))
        n, pairs = F.size(cells), F.size(paired)
        broken = (n >= 2) & (F.size(F.filter(cells, _fragment)) >= 0.6 * n) & (F.size(F.filter(cells, lambda c: c.rlike(r"\d"))) <= 0.2 * n)
        worded = F.size(F.filter(paired, lambda p: _worded(p["l"]))) >= 0.5 * pairs
        return (F.size(acc) >= 2) & broken & (pairs >= F.greatest(F.lit(2), F.floor(n / 2))) & worded

    cols = F.filter(transposed(m), _any)
    cols = _folded(cols, 3, of_errors, False)
    return transposed(_folded(cols, 5, of_fragments, True))


def _run(flags: Column) -> Column:
    """How many of the first flags are true."""
    return F.when(F.array_contains(flags, False), F.array_position(flags, False).cast("int") - 1).otherwise(F.size(flags))


def unfolded(m: Column) -> Column:
    """A table printed as two halves side by side, as one of half the width: header, rows of the left, rows of the right.

    The header is what both halves repeat in the first rows; else the left of the first row, if only this holds header
    words; else, where three of the first eight rows fill both halves, invented names."""
    width = F.size(F.get(m, F.lit(0)))
    half = F.floor(width / 2).cast("int")
    left, right = (lambda r: F.slice(r, F.lit(1), half)), (lambda r: F.slice(r, half + 1, half))
    skip = _run(F.transform(F.slice(m, 1, 2), lambda r: ~_any(right(r)) & (_filled(left(r)) == 1)))
    twins = _run(F.transform(F.slice(m, skip + 1, F.lit(4)), lambda r: (left(r) == right(r)) & _any(left(r))))
    heads = F.transform(F.slice(m, skip + 1, twins), left)
    shared = _let(heads, lambda heads: F.transform(F.sequence(F.lit(0), half - 1), lambda j: F.array_join(F.filter(F.transform(heads, lambda r: F.get(r, j)), lambda c: c != ""), " ")))
    first = F.get(m, F.lit(0))
    lone = _holds_header(_line(left(first))) & _any(right(first)) & ~_holds_header(_line(right(first)))
    paired = F.size(F.filter(F.slice(m, 1, 8), lambda r: (F.get(r, F.lit(0)) != "") & (F.get(r, half) != ""))) >= 3
    invented = F.transform(F.sequence(F.lit(1), half), lambda j: F.concat(F.lit("column "), j.cast("string")))

    def built(head: Column, start: Column, seed: Column | None = None) -> Column:
        rest = F.slice(m, start + 1, F.size(m))
        halves = [F.filter(F.transform(rest, left), _any), *([F.array(seed)] if seed is not None else []), F.filter(F.transform(rest, right), _any)]
        return F.concat(F.array(head), *halves)

    start = skip + twins
    found = F.when(twins > 0, F.when(start < F.size(m), built(shared, start)).otherwise(m)).when(lone, built(left(first), F.lit(1), right(first))).when(paired, built(invented, F.lit(0))).otherwise(m)
    return F.when((width >= 4) & (width % 2 == 0), found).otherwise(m)


def word_counts(words: DataFrame, by: list[str]) -> DataFrame:
    """by and context: struct(words, lines, long_lines, prose, numbers, singles, mean_length), what the rules ask of a region,
    from its words(by, text, top, place).

    Words whose tops round to the same step of 4 points are one line, in order of place. Words are counted before lines
    are joined, so that what meets in one task is a line.
    """
    w = words.withColumn("text", F.btrim(F.col("text"), F.lit(SPACE))).filter(F.col("text") != "")
    at = F.bround(F.coalesce(F.col("top"), F.lit(0.0)).cast("double") / 4).cast("long").alias("__line")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ")
    lines = w.groupBy(*by, at).agg(
        joined.alias("line"),
        F.count("*").alias("words"),
        F.count_if(F.col("text").rlike(r"\d")).alias("numbers"),
        F.count_if(F.length(F.btrim(F.col("text"), F.lit(".,;:()[]"))) <= 1).alias("singles"),
        F.sum(F.length("text")).alias("letters"),
    )
    parts = F.size(F.filter(F.split("line", r"\s+"), lambda x: x != ""))
    lines = lines.withColumns({"long": (parts >= 14) | (F.length("line") >= 100), "prose": prose_words(F.col("line"))})
    sums = lines.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("words", "numbers", "singles", "letters", "prose")], F.count("*").alias("lines"), F.count_if("long").alias("long_lines"))
    mean = F.bround(F.col("letters") / F.col("words"), 2).alias("mean_length")
    return sums.select(*by, F.struct("words", "lines", "long_lines", "prose", "numbers", "singles", mean).alias("context"))


#: The context of a region without words.
NO_WORDS = "named_struct('words', 0L, 'lines', 0L, 'long_lines', 0L, 'prose', 0L, 'numbers', 0L, 'singles', 0L, 'mean_length', 0D)"
