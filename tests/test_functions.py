import math

import pandas as pd
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import evaluation as ev
from foliant.operators import retrieval as rt


def one(spark, column, **values):
    return spark.createDataFrame(pd.DataFrame([values])).select(column.alias("x")).first()["x"]


def test_doi_forms(spark):
    for form in ("https://doi.org/10.1101/ABC.123", "doi: 10.1101/abc.123.", "10.1101/abc.123);", "http://dx.doi.org/10.1101/abc.123"):
        assert one(spark, tx.doi(F.col("c")), c=form) == "10.1101/abc.123"


def test_aliases_and_normal_form(spark):
    assert one(spark, tx.normalize_search(F.col("c")), c="LNT II in E. coli") == tx.normalize_query("LNT II in E. coli") == "lnt ii lacto n triose ii in e coli escherichia coli"
    assert one(spark, tx.normalize_search(F.col("c")), c="soft­hyphen  –  2′-FL") == "softhyphen 2 fl 2 fl 2 fucosyllactose"


def test_distinct_text_keeps_the_first(spark):
    assert one(spark, tx.distinct_text(F.array(F.lit("A "), F.lit("b"), F.lit("a"), F.lit(" "), F.lit(None).cast("string"))), c="x") == ["A", "b"]


def test_inverted_index(spark):
    m = F.map_from_arrays(F.array(F.lit("to"), F.lit("be")), F.array(F.array(F.lit(0), F.lit(2)), F.array(F.lit(1))))
    assert one(spark, tx.from_inverted_index(m), c="x") == "to be to"


def test_word_in(spark):
    for text, hit in (("a strain of", True), ("strained", False), ("pre-strain", False)):
        assert one(spark, tx.word_in(F.col("c"), "strain"), c=text) is hit


def test_word_in_borders_on_capitals(spark):
    for text, hit in (("Athe", False), ("theA", False), ("The the", True), ("THEthe", False), ("\nthe\n", True)):
        assert one(spark, tx.word_in(F.col("c"), "the"), c=text) is hit


def test_query_terms_keep_the_larger_weight():
    t = tx.query_terms("LNT II accumulation in metabolic pathway")
    assert t["lnt ii lacto n triose ii"] == 0.30 and t["accumulation"] == 0.10 and t["metabolic"] == 0.08


def test_anchors_kept():
    assert [rt.anchors_kept(n) for n in (0, 2, 5, 6, 20)] == [0, 2, 3, 5, 10]


def test_fusion_protects_the_first_raw_hits(spark):
    rows = [("raw", 1.0, i, "p1", i, 1.0 - i / 10) for i in range(1, 4)] + [("alias", 0.55, i, "p2" if i == 8 else "p1", r, 0.9) for r, i in enumerate((9, 8, 3), 1)]
    got = rt.multi_query(spark.createDataFrame(rows, "route string, weight double, id long, paper_id string, rank int, raw_score double"), 4).collect()
    assert [r["id"] for r in got] == [1, 2, 3, 9] and got[2]["matched_routes"] == ["alias", "raw"]


def test_offline_score(spark):
    rows = spark.createDataFrame([(1, "gene yield gene", "gene yield"), (2, "genetic gene gene gene gene gene gene gene gene gene", None), (3, "", "other")], "id long, content string, title string")
    fields = {"content": F.col("content"), "title": F.col("title")}
    idf = ev.offline_idf(rows, fields, ["gene", "yield"])
    assert idf == {"gene": math.log(4 / 3) + 1, "yield": math.log(4 / 2) + 1}
    found = {r["id"]: r["s"] for r in rows.select("id", ev.offline_score(fields, idf).alias("s")).collect()}
    phrase = 2 * 1 + 2 * 6
    assert math.isclose(found[1], idf["gene"] * (1.25 + 6) + idf["yield"] * (1 + 6) + phrase)
    # Ten occurrences, one of them inside of a word, count three times at most.
    assert math.isclose(found[2], idf["gene"] * 3) and found[3] == 0


def test_first_match(spark):
    hits = spark.createDataFrame([("a", 1, "nothing"), ("a", 2, "a YIELD of titer"), ("a", 3, "titer"), ("b", 1, None)], "case string, rank int, text string")
    found = sorted(map(tuple, ev.first_match(hits, "case", "rank", "text", ["Titer", "yield"]).collect()))
    assert found == [("a", 3, 2, "titer"), ("b", 1, None, None)]
