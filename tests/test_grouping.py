"""Folds in reading order, places and reports on small cases worked out by hand."""

from pyspark.sql import functions as F

from foliant.functions import geometry as geo
from foliant.functions import payload as pl
from foliant.operators import context as cx
from foliant.operators import grouping as gr
from foliant.operators import reports as rp


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_headings_in_a_row_pair_up(spark):
    rows = [("p", 0, 1, "text", "METHODS", 0), ("p", 1, 1, "text", "STRAINS", 0), ("p", 2, 1, "text", "Cells grew.", 0), ("p", 3, 1, "text", "RESULTS", 0), ("p", 4, 2, "text", "Next page", 0)]
    c = spark.createDataFrame(rows, "paper_id string, ord long, page int, content_type string, text string, level int").withColumn("id", F.col("ord"))
    c = c.withColumn("box", geo.box(F.lit(0), F.col("ord") * 10, F.lit(5), F.col("ord") * 10 + 5))
    got = {r["id"]: (r["text"], r["attached_heading"], r["global_order"], r["order_in_page"], r["box"]["y0"]) for r in gr.with_headings(c).collect()}
    assert got == {1: ("METHODS\n\nSTRAINS", "METHODS", 0, 0, 0.0), 2: ("Cells grew.", None, 1, 1, 20.0), 3: ("RESULTS", None, 2, 2, 30.0), 4: ("Next page", None, 3, 0, 40.0)}


def test_lines_compare_with_their_first_word(spark):
    rows = [("p", 1, "b", 20.0, 2.0), ("p", 1, "a", 0.0, 0.0), ("p", 1, "c", 0.0, 4.0), ("p", 1, "d", 9.0, 7.0), ("p", 1, None, 0.0, 50.0), ("p", 2, "e", None, 1.0)]
    w = spark.createDataFrame(rows, "paper_id string, page int, text string, x0 double, top double").withColumns({"x1": F.col("x0") + 5, "bottom": F.col("top") + 5})
    assert [r["text"] for r in gr.text_lines(w).orderBy("line").collect()] == ["a b", "c d"]
    assert gr.text_lines(w.limit(0)).count() == 0


def test_figures(spark):
    rows = [("p", 1, 0, None, 0.0, 10.0), ("p", 1, 1, "Fig. 2a shows", 100.0, 110.0), ("p", 1, 2, "", 180.0, 190.0), ("p", 1, 3, None, 400.0, 410.0), ("p", 1, 4, "Figure 3", 500.0, 510.0), ("p", 1, 5, None, 700.0, 710.0)]
    v = spark.createDataFrame(rows, "paper_id string, page int, ord long, caption string, y0 double, y1 double").withColumn("id", F.col("ord"))
    got = {r["id"]: (r["group_id"], r["label"], r["role"]) for r in gr.figure_groups(v).collect()}
    assert [got[i][0] for i in range(5)] == ["figure_p1_001"] * 3 + ["figure_p1_002"] * 2
    assert got[0][1:] == ("Figure 2a", "part") and got[1][2] == got[4][2] == "caption_owner"
    assert got[5] == ("figure_p1_ungrouped_5", "", "single")


def test_batches(spark):
    rows = [("p", i, i, "x" * n) for i, n in enumerate([10, 10, 9500, 10, 10, 10, 10, 10])] + [("q", 0, 99, None)]
    b = gr.batches(spark.createDataFrame(rows, "paper_id string, ord long, id long, text string"))
    got = {r["id"]: r["batch"] for r in b.collect()}
    assert [got[i] for i in range(8)] == [0, 0, 1, 2, 2, 2, 2, 3] and got[99] == 0


def regions(spark, rows):
    schema = "id long, page int, caption string, confidence double, x0 double, y0 double, x1 double, y1 double"
    r = spark.createDataFrame(rows, schema).withColumns({"paper_id": F.lit("p"), "ruled": F.lit(False), "captioned": F.col("caption").isNotNull(), "evidence": F.lit(1), "ord": F.col("id")})
    return r.withColumn("box", geo.box("x0", "y0", "x1", "y1"))


def test_overlaps(spark):
    r = regions(spark, [
        (1, 1, "Table 1. Yields", 0.9, 0.0, 0.0, 100.0, 100.0), (2, 1, None, 0.8, 1.0, 1.0, 99.0, 99.0), (3, 1, "Table 1", 0.7, 0.0, 200.0, 100.0, 300.0),
        (4, 1, "Table 2", 0.6, 0.0, 210.0, 100.0, 400.0), (5, 1, None, 0.1, 0.0, 1.0, 100.0, 100.0), (6, 2, None, 0.1, 0.0, 0.0, 100.0, 100.0),
    ])
    # 2 is the same as 1; 3 stands below 1 under the same number; 5 is as large as 1, but far less sure.
    assert ids(gr.without_overlaps(r)) == [1, 4, 5, 6]


def test_repeated_captions(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    r = regions(spark, [
        (1, 1, "Table 1. Yields of all strains", 0.9, *box), (2, 2, "Table 1: Yields of all", 0.8, *box), (3, 3, "Table 1 (continued)", 0.7, *box), (4, 4, "Table 1. Primers", 0.6, *box), (5, 5, None, 0.5, *box), (6, 1, "Table 1. Yields of all strains", 0.1, *box),
    ])
    assert ids(gr.without_repeated_captions(r)) == [1, 3, 4, 5, 6]


def test_merged_boxes(spark):
    r = regions(spark, [(1, 1, None, 0.0, 0.0, 0.0, 100.0, 100.0), (2, 1, None, 0.0, 0.0, 5.0, 100.0, 105.0), (3, 1, None, 0.0, 0.0, 0.0, 10.0, 10.0), (4, 1, None, 0.0, 5.0, 5.0, 5.0, 9.0)])
    got = [(x["place"], x["x0"], x["y0"], x["x1"], x["y1"]) for x in gr.merged_boxes(r).orderBy("place").collect()]
    assert got == [(0, 0.0, 0.0, 100.0, 105.0), (1, 0.0, 0.0, 10.0, 10.0)]


def test_distance_by_chunk_ids(spark):
    rows = [("a_p1_col0_y10_x0", "a_p1_col0_y100_x5", 1), ("a_p1_y10_x0", "a_p1_col1_y200_x5", 2), ("a_p1_col0_y10_x0", "a_p1_col1_y20_x5", None), ("a_p1_y10_x0", "a_p2_y10_x0", None), ("a", "a_p2_y10_x0", None), (None, None, None)]
    at = lambda c: cx.place(chunk_id=F.col(c))
    got = spark.createDataFrame(rows, "a string, b string, want int").select(cx.distance(at("a"), at("b"), 2).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_restored_fills_free_places_first(spark):
    rows = lambda xs: spark.createDataFrame(list(xs), "id long, rank int")
    got = cx.restored(rows([(1, 1), (2, 2), (3, 3)]), rows([(8, 1), (2, 2), (9, 3)]), 4)
    assert [(r["id"], r["anchor_restored"]) for r in got.orderBy("rank").collect()] == [(1, False), (2, False), (9, True), (8, True)]
    assert [r["id"] for r in cx.restored(rows([]), rows([(7, 1)]), 2).collect()] == [7]
    assert cx.restored(rows([(1, 1)]), rows([(7, 1)]), 0).count() == 0


def test_empty_answer_keeps_the_order(spark):
    hits = spark.createDataFrame([(5, 1, 0.1), (6, 2, 0.2)], "id long, rank int, score double")
    none = spark.createDataFrame([], "place int, index int, relevance double")
    assert [(r["id"], r["score"], r["reranked"]) for r in cx.reranked(hits, none).orderBy("rank").collect()] == [(5, 0.1, False), (6, 0.2, False)]


def test_html_and_markdown(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(pl.html_markdown(F.lit("no  table"))) == "no table"
    assert one(pl.html_matrix(F.lit("<tr><td>a&amp;b</td><td>&nbsp;</td></tr>"))) == [["a&b", ""]]
    assert one(pl.table_text(F.lit("|---|\n| - |\nplain (cid:2) line\n| x |  |"), F.lit(None).cast("string"), F.lit(""))) == "plain - line\nx"
    assert one(pl.markdown_matrix(F.lit(None).cast("string"))) == []
    assert one(pl.stem(F.lit("a/b.c/d.e.pdf"))) == "d.e"


def test_no_topics_no_line(spark):
    empty = spark.createDataFrame([], "priority string, pdf_status string, topics array<string>")
    assert [r["line"] for r in rp.highlights(empty, 3).collect()] == ["本次窗口内共有 3 条候选，纳入简报 0 条。"]
