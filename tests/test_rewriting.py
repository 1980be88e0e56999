"""Query rewriting, the search index, upserts and layout conflicts on cases worked out by hand or by plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import geometry as geo
from foliant.operators import layout as lo
from foliant.operators import retrieval as rt
from foliant.operators import rewriting as rw
from foliant.operators import search_index as si
from foliant.operators import storage as st

QUERY = "raw string, products array<string>, genes array<string>, metrics array<string>, variants array<string>, evidence_preference string"


def test_rewrite_completes_an_answer(spark):
    q = spark.createDataFrame([("Why does LNTII titer drop in E.  coli", ["LNT II", " lnt ii "], ["lgtA"], ["titer"], None, "nothing"), (None, None, None, None, ["a b", "A  B"], None)], QUERY)
    a, b = (r.asDict() for r in rw.rewritten(q).collect())
    assert a["aliases"] == ["LNT II", "LNTII", "lacto-N-triose II", "E. coli", "Escherichia coli"]
    assert a["products"] == ["LNT II", "LNTII", "lacto-N-triose II"] and a["organisms"] == ["E. coli", "Escherichia coli"]
    assert a["intents"] == ["mechanism", "production"] and a["evidence_preference"] == "table"
    assert a["normalized_query"] == "LNT II LNTII lacto-N-triose II E. coli Escherichia coli lgtA titer mechanism production"
    assert a["variants"] == [a["normalized_query"], "LNT II LNTII E. coli lgtA", "LNT II LNTII biosynthesis pathway mechanism", "LNT II LNTII titer"]
    assert (b["normalized_query"], b["variants"], b["evidence_preference"], b["aliases"]) == ("", ["a b"], "any", [])


def test_lnt_before_ii_is_another_sugar(spark):
    q = spark.createDataFrame([("lnt ii",), ("lnt and lnt ii",), ("LNnT",), ("slnt",)], "q string")
    assert [r[0] for r in q.select(rw.aliases_in(F.col("q"))).collect()] == [rw.ALIAS_GROUPS[0], rw.ALIAS_GROUPS[0] + rw.ALIAS_GROUPS[1], rw.ALIAS_GROUPS[2], []]


def test_context_query_drops_contained_terms_and_stops_in_time(spark):
    q = rw.rewritten(spark.createDataFrame([("x", ["alpha beta", "beta", "gamma"], ["alpha"], None, None, None)], QUERY).withColumn("normalized_query", F.lit("alpha beta delta")))
    said = lambda *limits: q.select(rw.context_query(F.lit("back  up"), *limits)).first()[0]
    # "alpha beta", "beta" and "alpha" stand in the first term; the variants are the entities.
    assert said() == "alpha beta delta gamma alpha beta beta alpha"
    assert said(2, 360) == "alpha beta delta gamma" and said(20, 18) == "alpha beta delta" and said(20, 12) == "alpha beta"
    none = rw.rewritten(spark.createDataFrame([("",)], "raw string"))
    assert none.select(rw.context_query(F.lit("back  up"))).first()[0] == "back up"


def test_pool_counts_entries_once(spark):
    docs = [(i, f"alpha beta filler{i}") for i in range(600)] + [(i, "gamma") for i in range(600, 1100)] + [(i, "delta") for i in range(1100, 2200)]
    e = spark.createDataFrame(docs, "id long, normalized string")
    postings = e.select(F.explode(F.split("normalized", " ")).alias("term"), "id")
    found = rt.candidate_pool(postings, rt.term_frequencies(e), "alpha beta gamma delta", 1)
    # Rarest first: gamma (500), alpha and beta (600, the same entries), delta (1100). Counted twice, 500 + 600 + 600 would end the pool one term later than the 1100 different entries do.
    assert sorted(r["id"] for r in found.collect()) == list(range(1100))
    assert rt.candidate_pool(postings, rt.term_frequencies(e), "nothing here", 1).count() == 0


def test_search_index_follows_its_table(spark, tmp_path):
    at = str(tmp_path / "t.parquet")
    read = lambda: spark.read.parquet(at)
    spark.createDataFrame([(1, "LNTII of it")], "id long, text string").write.parquet(at)
    first = si.of_table(spark, at, read())
    assert first is si.of_table(spark, at, read()) and first.entries.first()["normalized"] == "lnt ii lacto n triose ii of it"
    spark.createDataFrame([(1, "one two"), (2, "two")], "id long, text string").write.mode("overwrite").parquet(at)
    assert {(r["term"], r["df"]) for r in si.of_table(spark, at, read()).frequencies.collect()} == {("one", 1), ("two", 2)}


def test_vectors_of_another_length_are_an_error(spark):
    s = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id long, v array<double>")
    assert st.upserted(s, spark.createDataFrame([(2, [0.0, 1.0])], "id long, v array<double>"), vector="v").count() == 2
    with pytest.raises(ValueError, match="lengths"):
        st.upserted(s, spark.createDataFrame([(3, [1.0])], "id long, v array<double>"), vector="v")


def test_layout_conflicts_as_a_plain_pass(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        x, y = rng.randint(0, 60), rng.randint(0, 60)
        rows.append((i, f"p{i % 3}", i % 4, rng.choice(["text", "table", "image", "chart"]), rng.choice(["one two three", "one two threes", "other"]), float(x), float(y), float(x + rng.randint(5, 60)), float(y + rng.randint(5, 60))))
    c = spark.createDataFrame(rows, "id long, paper_id string, page int, content_type string, text string, x0 double, y0 double, x1 double, y1 double").withColumn("box", geo.box(*[F.col(k) for k in ("x0", "y0", "x1", "y1")]))
    rank = {"table": 0, "text": 1, "image": 2}
    grams = lambda t: {f" {t} "[k : k + 3] for k in range(len(t) - 1)}
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    both = lambda a, b: max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    gone = set()
    for k, a in enumerate(rows):
        for b in rows[k + 1 :]:
            if a[0] in gone or b[0] in gone or a[1:3] != b[1:3]:
                continue
            p, q = a[5:], b[5:]
            if {a[3], b[3]} == {"text", "table"}:
                t, o = (a, b) if a[3] == "text" else (b, a)
                x, y = (t[5] + t[7]) / 2, (t[6] + t[8]) / 2
                if (o[5] - 20 <= x <= o[7] + 20 and o[6] - 20 <= y <= o[8] + 20) or both(p, q) / area(t[5:]) >= 0.7:
                    gone.add(t[0])
            elif both(p, q) / (area(p) + area(q) - both(p, q)) > 0.5 and len(grams(a[4]) & grams(b[4])) / len(grams(a[4]) | grams(b[4])) > 0.8:
                gone.add(b[0] if rank.get(a[3], 99) <= rank.get(b[3], 99) else a[0])
    assert gone and {r["id"] for r in lo.deduplicated(c).collect()} == {r[0] for r in rows} - gone
