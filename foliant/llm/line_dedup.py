"""Line dedup over levelled sorted runs of line hashes.

Lines are hashed in one pass over the texts, written in batches. A batch's line keys are hashed to 128 bits, counted per key, and merge-joined with the
runs: keys that no run holds (an anti-join) become a new sorted run of level 0, keys that a run holds go to the table
of repeats. When FANOUT runs of a level exist they are compacted into one run of the next level; runs never share a
key, so compaction is a union and a sort. Runs are bucketed and sorted by the hash in the shared folder: a later batch
is shuffled to their buckets once and the runs themselves are never shuffled again.

When all batches are in, a key's total is its run row plus its repeats. Keys held by at least MIN_DOCS documents lose
their lines everywhere but in the largest doc_id. Only the documents' own doomed keys travel back to them.

Edge cases: null or empty text is one empty line, which is never long enough to be dropped. A null doc_id is smaller
than any other; rows without one still part by the hash of their text. Rows that share a doc_id are separate documents in the count, and are all kept where that doc_id is
the largest. Lines are split at \\n alone. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import common

MIN_POINTS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2
#: Most keys that are broadcast, of 16 bytes each and two numbers; rows from which on a key may be one of them.
BROADCAST = 100_000
HOT = 100_000
SPACE = b" \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)


def line_keys(text: bytes) -> list[bytes]:
    return [x.strip(SPACE).lower() for x in text.split(b"\n")]


def _long(key: bytes) -> bool:
    """At least MIN_POINTS code points, without decoding: continuation bytes don't start one."""
    return len(key) >= MIN_POINTS and (key.isascii() or len(key.decode("utf-8", "replace")) >= MIN_POINTS)


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _doc(df: DataFrame):
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")


def _same():
    """Rows of one doc_id and one hash of the text lose the same lines; so rows that share an id, or have none, part."""
    return F.coalesce(F.xxhash64("text"), F.lit(0)).alias("same")


def hashed_lines(df: DataFrame) -> DataFrame:
    """(key, doc, same) for the distinct long keys of each row."""

    def part(batches):
        common.common_cache().clear()
        for b in batches:
            docs, same, keys = [], [], []
            for doc, own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = {digest(k) for k in line_keys(text) if _long(k)}
                docs += [doc] * len(found)
                same += [own] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(docs, pa.int64()), pa.array(same, pa.int64())], ["key", "doc", "same"])

    return df.select(_doc(df), _same(), common.utf8(F.col("text")).alias("utf8")).mapInArrow(part, "key binary, doc long, same long")


def in_batches(lines: DataFrame, n: int = BATCHES) -> DataFrame:
    """lines, written once, in n batches by document: one folder for each, so that a batch is read without the others."""
    return common.written(lines.withColumn("batch", F.pmod(F.xxhash64("doc", "same"), F.lit(n)).cast("int")), "lines", by="batch")


class Runs:
    """The levelled runs of one dedup: (key, n documents, largest doc), disjoint in key, bucketed and sorted by key."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels = spark, {}
        self.tables: list[str] = []
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.at = f"{common.shared_dir(spark)}/lines-{uuid.uuid4().hex}"
        self.repeats: list[DataFrame] = []

    def _store(self, df: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        df.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").option("path", f"{self.at}/{name}").saveAsTable(name)
        self.tables.append(name)
        return name

    def _union(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for x in names[1:]:
            out = out.unionByName(self.spark.table(x))
        return out

    def add(self, lines: DataFrame) -> None:
        """Takes in a batch of hashed_lines(): anti-joins the runs one by one, adds what is new, keeps what is not apart."""
        new = common.written(lines.groupBy("key").agg(F.count("*").alias("n"), F.max("doc").alias("top")), "batch")
        held = [x for level in sorted(self.levels) for x in self.levels[level]]
        fresh = new
        for name in held:
            run = self.spark.table(name).select("key")
            fresh = fresh.join(run.hint("merge"), "key", "left_anti")
            self.repeats.append(new.join(run.hint("merge"), "key", "left_semi"))
        self.levels.setdefault(0, []).append(self._store(fresh))
        level = 0
        while len(self.levels[level]) >= FANOUT:
            self.levels.setdefault(level + 1, []).append(self._store(self._union(self.levels[level])))
            self.levels[level] = []
            level += 1

    def totals(self) -> DataFrame:
        """(key, n, top) of every key that more than one row holds."""
        held = [x for level in sorted(self.levels) for x in self.levels[level]]
        runs = self._union(held)
        if not self.repeats:
            return runs.filter("n > 1")
        again = self.repeats[0]
        for x in self.repeats[1:]:
            again = again.unionByName(x)
        again = common.written(again.groupBy("key").agg(F.sum("n").alias("n"), F.max("top").alias("top")), "repeats")
        first = runs.filter("n > 1").unionByName(runs.filter("n = 1").join(again.select("key"), "key", "left_semi"))
        return first.unionByName(again).groupBy("key").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def close(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # external: the files stay for whatever still reads them


def doomed(lines: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """(doc, same, keys): the keys whose lines a row loses, of in_batches() lines; rows that lose none are absent.

    A key of very many rows is one hot key of the join that finds them. Keys of more than HOT rows, or more than a
    BROADCAST-th of all lines, are therefore broadcast: there are BROADCAST of them at most. All other keys meet in a shuffle.
    """
    runs = Runs(lines.sparkSession)
    try:
        for i in range(batches):
            runs.add(lines.filter(F.col("batch") == i).select("key", "doc"))
        often = common.written(runs.totals().filter(F.col("n") >= min_docs).select("key", "top", "n"), "often")
    finally:
        runs.close()
    total, keys = often.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = 0 if keys <= BROADCAST else max(HOT, total // BROADCAST)
    hot = lines.join(F.broadcast(often.filter(F.col("n") > least)), "key")
    own = hot if not least else hot.unionByName(lines.join(often.filter(F.col("n") <= least), "key"))
    return own.filter(F.col("doc") != F.col("top")).select("doc", "same", "key").distinct().groupBy("doc", "same").agg(F.collect_list("key").alias("keys"))


def _dropped(lines: list[bytes], gone: set[bytes]) -> list[bool]:
    return [_long(k) and digest(k) in gone for k in (x.strip(SPACE).lower() for x in lines)]


def dedup(df: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """row (df's columns), lines (kept text as UTF-8), n_lines, n_dropped for every row of df."""
    gone = doomed(in_batches(hashed_lines(df), batches), min_docs, batches)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "text"]).alias("row"), _doc(df), _same(), common.utf8(F.col("text")).alias("utf8"))
    both = rows.join(gone, ["doc", "same"], "left").select("row", "utf8", "keys")
    schema = both.select("row").schema.add("kept", "binary").add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")

    def part(batches):
        for b in batches:
            kept, n, dropped, sha = [], [], [], []
            for text, keys in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                lines = text.split(b"\n")
                if keys:
                    out = _dropped(lines, set(keys))
                    text = b"\n".join([x for x, gone in zip(lines, out) if not gone])
                    dropped.append(sum(out))
                else:
                    dropped.append(0)
                kept.append(text)
                n.append(len(lines))
                sha.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], ["row", "kept", "n_lines", "n_dropped", "kept_sha256"])

    return both.mapInArrow(part, schema)
