"""Matrix rules against small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import matrices as mx

SCHEMA = "m array<array<string>>"


@pytest.fixture(scope="module")
def apply(spark):
    def one(matrix, f):
        return spark.createDataFrame([(matrix,)], SCHEMA).select(mx.normalized(F.col("m")).alias("m")).select(f(F.col("m")).alias("x")).first()["x"]

    return one


def rows(x):
    return [list(r) for r in x]


def test_normalized(apply):
    assert rows(apply([[" a\nb ", None], ["", "  "], ["c"], ["d", "e", "f"]], lambda m: m)) == [["a b", "", ""], ["c", "", ""], ["d", "e", "f"]]
    assert apply([], lambda m: m) == [] and apply([[None]], lambda m: m) == []


def test_header_and_markdown(apply):
    m = [["Table 1", ""], ["Host", "Yield"], ["x", "1"]]
    assert apply(m, mx.header_row) == 1
    assert apply(m, lambda m: mx.markdown(m, mx.header_row(m))) == "| Host | Yield |\n| --- | --- |\n| x | 1 |"
    assert rows(apply(m, lambda m: mx.rotated(m, mx.header_row(m)))) == [["Host", "Yield"], ["x", "1"], ["Table 1", ""]]
    assert apply([["a", "b"], ["Table 2", ""], ["c", "d"]], mx.header_row) == 2
    assert apply([["a", "b"], ["Table 2", ""]], mx.header_row) == 1


def test_validity(apply):
    valid = lambda m: mx.is_valid(m, mx.header_row(m))
    assert apply([["Host", "Yield"], ["x", "1"], ["y", "2"]], valid)
    assert not apply([["Host", "Yield"], ["x", "1"]], valid)
    assert not apply([["bcdfg", "hjklm"], ["npqrst", "vwxzb"], ["x", "1"]], valid)
    assert not apply([["a", ""], ["b" * 60, "c" * 60], ["d" * 60, ""], ["e", "f"]], valid)
    assert not apply([], valid)


def test_tail(apply):
    body = [["h1", "h2", "h3", "h4"], ["1", "2", "3", "4"], ["5", "6", "7", "8"]]
    assert rows(apply([*body, ["note", "", "", ""], ["more", "", "", ""]], mx.without_tail)) == body
    firm = [*body, ["note", "", "", ""], ["9", "8", "7", "6"]]
    assert rows(apply(firm, mx.without_tail)) == firm
    assert rows(apply([["a", "b"], ["c", "d"], ["e", ""]], mx.without_tail)) == [["a", "b"], ["c", "d"], ["e", ""]]


def test_before_prose(apply):
    body = [["h1", "h2", "h3"], ["1", "2", "3"], ["4", "5", "6"]]
    text = "that the yield was increasing with the metabolic pathway"
    assert rows(apply([*body, [text, "", ""], ["7", "8", "9"]], mx.before_prose)) == body
    assert rows(apply([*body, ["x" * 201, "1", "2"]], mx.before_prose)) == body
    wide = [list("abcde"), list("fghij"), list("klmno")]
    assert rows(apply([*wide, ["Results", "", "", "", ""], list("pqrst")], mx.before_prose)) == wide
    assert rows(apply([*wide, ["* see text", "", "", "", ""], list("pqrst")], mx.before_prose)) == [*wide, ["* see text", "", "", "", ""], list("pqrst")]
    assert apply([], mx.before_prose) == []


def test_repair(apply):
    assert rows(apply([["n", "", "v"], ["a", "", "1"]], mx.repaired)) == [["n", "v"], ["a", "1"]]
    assert rows(apply([["n", "v", ""], ["a", "1.5", "±0.2"], ["b", "2.5", "± 0.1"]], mx.repaired)) == [["n", "v"], ["a", "1.5 ±0.2"], ["b", "2.5 ± 0.1"]]
    m = [["id", "1.5", "glucuro", "nate", "x1"], ["1", "2.5", "galactu", "nate", "2"], ["3", "4.5", "mannuro", "nate", "4"]]
    assert rows(apply(m, mx.repaired)) == [["id", "1.5", "glucuronate", "x1"], ["1", "2.5", "galactunate", "2"], ["3", "4.5", "mannuronate", "4"]]
    assert apply([], mx.repaired) == []


def test_unfold(apply):
    twin = [["Host", "Yield", "Host", "Yield"], ["a", "1", "c", "3"], ["b", "2", "", ""]]
    assert rows(apply(twin, mx.unfolded)) == [["Host", "Yield"], ["a", "1"], ["b", "2"], ["c", "3"]]
    lone = [["Host", "Yield", "x", "9"], ["a", "1", "c", "3"]]
    assert rows(apply(lone, mx.unfolded)) == [["Host", "Yield"], ["a", "1"], ["x", "9"], ["c", "3"]]
    pairs = [["a", "1", "c", "3"], ["b", "2", "d", "4"], ["e", "5", "f", "6"]]
    assert rows(apply(pairs, mx.unfolded))[0] == ["column 1", "column 2"]
    assert rows(apply([["a", "b", "c"], ["d", "e", "f"]], mx.unfolded)) == [["a", "b", "c"], ["d", "e", "f"]]


def test_quality(apply):
    assert apply([["a", "b"]], mx.quality)["reasons"] == ["empty_or_too_short"]
    assert apply([["a"], ["b"], ["c"]], mx.quality)["reasons"] == ["too_few_columns"]
    q = apply([["a", "b"], ["c", "d"], ["e", "f"], ["g", ""]], mx.quality)
    assert (q["consistency"], q["fill"], q["reasons"]) == (0.75, 0.88, ["low_consistency"])
