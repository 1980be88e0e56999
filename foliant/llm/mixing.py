"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source offers its documents in a shuffled order, REPEATS times over. A document's virtual finish time is the
number of its source's words up to and with it, divided by the source's target. All documents of all sources stand in
one line, range-sorted by finish time, and the line is cut where the running sum of words reaches the total budget; the
document at the cut is taken in part. Nothing else limits a source: that its words come near its target is what fair
queueing gives, to within the documents that are in service at the cut.

As in networks, fairness is that of the largest packet: a document longer than a share 1 / PACKETS of its source's
target stands in line as several packets, so that also in small tables a long document doesn't throw its source off.
In large tables no document is that long.

No source, however large, meets in one task: running sums are made in two levels, over BUCKETS slices of the shuffled
order of each source (or of the virtual time line) and inside each slice.

Edge cases: null text has size 0; documents of size 0 take nothing. A null source is a source of its own, the last
in order. Equal rows are separate documents. An empty table gives an empty result; where all sizes are 0 so are the
targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BUCKETS = 4096
PACKETS = 1000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: the budget shared by weight under caps of REPEATS times the size.

    sizes has one row for each source. The level at which weights are served is found in closed form: with sources
    in order of cap over weight, the first one whose cap is not below the level that is left for it and its
    followers, and its followers, are served at that level; those before it get their caps.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    s = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", F.element_at(kinds, ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("cap", REPEATS * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    on = Window.orderBy("ratio", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("order", F.row_number().over(Window.orderBy("ratio", "place"))).withColumn("budget", SHARE * F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("weight").over(on))
    s = s.withColumn("first", F.min(F.when(F.col("level") <= F.col("ratio"), F.col("order"))).over(everything))
    s = s.withColumn("served", F.max(F.when(F.col("order") == F.col("first"), F.col("level"))).over(everything))
    target = F.when(F.col("first").isNull() | (F.col("order") < F.col("first")), F.col("cap")).otherwise(F.least("cap", F.col("served") * F.col("weight")))
    return s.select("source", F.col("source_size"), target.alias("target"), "budget")


def _running(rows: DataFrame, group: str, order: list, value: str) -> Column:
    """Sum of value over the rows before this one in order, inside of group."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def offers(sized: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The packets of sized(doc_id, source, size, shuffled, *carry) in no order: for each document, turn and packet its
    words and its virtual finish time.

    shuffled is a hash in hexadecimal, the first four digits of which deal the documents of a source to slices.
    """
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    slot = F.floor(F.conv(F.substring("shuffled", 1, 4), 16, 10).cast("long") * BUCKETS / 65536).cast("int")
    rows = sized.withColumn("slot", slot)
    slots = rows.groupBy("source", "slot").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("source", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = slots.join(goal, slots["source"].eqNullSafe(goal["source"])).select(slots["source"].alias("s"), F.col("slot").alias("b"), "base", "source_size", "target", "budget")
    inside = Window.partitionBy("source", "slot").orderBy("shuffled", "doc_id", "size")
    rows = rows.withColumn("row", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.join(bases, rows["source"].eqNullSafe(bases["s"]) & (rows["slot"] == bases["b"])).drop("s", "b")
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    start = F.col("turn") * F.col("source_size") + F.col("base") + F.col("upto") - F.col("size")
    rows = rows.withColumn("start", start).withColumn("most", F.greatest(F.lit(1), F.floor(F.col("target") / PACKETS)).cast("long"))
    packets = F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("most"))).cast("long")
    rows = rows.withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), packets - 1)))
    to = F.least(F.col("size"), (F.col("packet") + 1) * F.col("most"))
    finish = F.when(F.col("target") > 0, (F.col("start") + to) / F.col("target")).otherwise(F.lit(0.0))
    own = ("source", "slot", "row", "turn", "doc_id", "size", "source_size", "target", "budget", "shuffled", "packet")
    return rows.select(*dict.fromkeys((*own, *carry)), (to - F.col("packet") * F.col("most")).alias("words"), finish.alias("finish"))


def queue(sized: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The entries of the queue: for each document of sized and each turn its finish time, the words taken and, where it
    takes any, the offset of its first word in the mix. The order of the mix is that of offset."""
    packets = offers(sized, carry)
    # The line in slices of virtual time, even up to time 1, ever longer behind it. Only the sums of the slices meet in one task.
    time = F.col("finish")
    packets = packets.withColumn("tick", F.floor(F.when(time <= 1, time).otherwise(F.log2(F.greatest(time, F.lit(1.0))) + 1) * BUCKETS).cast("long"))
    ticks = packets.groupBy("tick").agg(F.sum("words").alias("n"))
    ticks = ticks.select(F.col("tick").alias("t"), F.coalesce(F.sum("n").over(Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("from"))
    placed = packets.join(ticks, F.col("tick") == F.col("t"))
    cut = F.floor("budget").cast("long")
    # Slices that start behind the cut take nothing, in whatever order.
    line = ["finish", F.col("source").asc_nulls_last(), "turn", "shuffled", "doc_id", "size", "row", "packet"]
    inside = placed.filter(F.col("from") < cut)
    inside = inside.withColumn("offset", F.col("from") + _running(inside, "tick", line, "words"))
    behind = placed.filter(F.col("from") >= cut).withColumn("offset", F.col("from"))
    both = inside.unionByName(behind).withColumn("got", F.greatest(F.lit(0), F.least(F.col("words"), cut - F.col("offset"))).cast("long"))
    by = list(dict.fromkeys(("source", "slot", "row", "turn", *carry, "size", "source_size", "target")))
    return both.groupBy(*by).agg(F.max("finish").alias("finish"), F.sum("got").alias("taken"), F.min(F.when(F.col("got") > 0, F.col("offset"))).alias("offset"))


def sized(df: DataFrame, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, shuffled and the columns keep."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return df.select("doc_id", "source", words(F.col("text")).alias("size"), key.alias("shuffled"), *(keep or []))


def mix(df: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target and taken (over all turns) for every row of df."""
    entries = queue(common.written(sized(df, seed), "sized"))
    return entries.groupBy("source", "slot", "row", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).select("doc_id", "source", "size", "source_size", "target", "taken")


#: The rows of mix() in DuckDB, from a view docs(doc_id, source, text).
SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                      md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS shuffled FROM docs),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s2 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s1),
s3 AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2 * source_size::DOUBLE AS cap FROM s2),
s4 AS (SELECT *, row_number() OVER (ORDER BY cap / weight, place) AS ord, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget FROM s3),
s5 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s4),
s6 AS (SELECT *, min(CASE WHEN level <= cap / weight THEN ord END) OVER () AS first FROM s5),
s7 AS (SELECT *, max(CASE WHEN ord = first THEN level END) OVER () AS served FROM s6),
goal AS (SELECT source, source_size, budget, CASE WHEN first IS NULL OR ord < first THEN cap ELSE least(cap, served * weight) END AS target FROM s7),
run AS (SELECT doc_id, d.source, size, source_size, target, budget, shuffled, row_number() OVER () AS rid, greatest(1, floor(target / 1000))::BIGINT AS most,
               (sum(size) OVER (PARTITION BY d.source ORDER BY shuffled, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - size AS start
        FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
turns AS (SELECT *, unnest([0, 1]) AS turn FROM run),
packets AS (SELECT *, unnest(range(greatest(1, ceil(size / most)::BIGINT))) AS packet FROM turns),
line AS (SELECT *, least(size, (packet + 1) * most) - packet * most AS words,
                CASE WHEN target > 0 THEN (turn * source_size + start + least(size, (packet + 1) * most))::DOUBLE / target ELSE 0 END AS finish FROM packets),
queue AS (SELECT *, (sum(words) OVER (ORDER BY finish, source NULLS LAST, turn, shuffled, doc_id NULLS FIRST, size, rid, packet ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - words AS ahead FROM line)
SELECT doc_id, size, source_size, target, sum(greatest(0, least(words, floor(budget) - ahead)))::BIGINT AS taken
FROM queue GROUP BY rid, doc_id, size, source_size, target
"""
