"""What the operators of this subpackage share: tables, shared folder, held-out rule, bounded samples."""

from __future__ import annotations

import ctypes
import pickle
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


#: What a Python worker keeps from one task to the next; map_texts() empties it, so that it serves one operator at a time.
WORKER_CACHE: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, spark.checkpoint.dir; where it is unset and all runs in one JVM, a folder of the
    warehouse, which is local then."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/foliant-scratch"
    return at.rstrip("/")


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder, in one folder for each value of by. It cuts lineage and, unlike a cache, outlives
    the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text.cast("binary"), F.lit(bytearray()))


def unit_hash(key: str, seed: int = 17) -> Column:
    """A number in [0, 1) from a hash of key, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 31)) / float(1 << 31)


def stratified(df: DataFrame, stratum: str, key: str, per_stratum: int | dict, seed: int = 17) -> DataFrame:
    """About per_stratum rows of each stratum (a dict: of those that it names), picked by a hash of key.

    Two passes without a shuffle of rows: a count per stratum, then a filter by hash against the rate that the
    count gives. Unlike a sort with a limit, no task sends more than its share to the driver. The rates travel as
    literals, so the number of strata should be small (labels, languages).
    """
    most = lambda v: per_stratum.get(v, 0) if isinstance(per_stratum, dict) else per_stratum
    rates = {r[0]: min(1.0, most(r[0]) / max(1, r[1])) for r in df.groupBy(stratum).count().collect() if r[0] is not None}
    unit = unit_hash(key, seed)
    keep = F.lit(False)
    for value, rate in sorted(rates.items(), key=lambda x: str(x[0])):
        keep = keep | ((F.col(stratum) == F.lit(value)) & (unit < F.lit(rate)))
    return df.filter(keep)


def one_of_each(df: DataFrame, key: str, label: str, text: str) -> DataFrame:
    """label, utf8 and an order (a hash) of df: of rows that share a key the smallest text, so that a key that many rows
    share (a null one, too) brings one."""
    own = df.select(F.col(key).alias("key"), F.col(label).alias("label"), utf8(F.col(text)).alias("utf8"))
    one = own.groupBy("key").agg(F.min(F.struct("utf8", "label")).alias("x"))
    return one.select("x.label", "x.utf8", F.xxhash64(F.lit(23), "key").alias("order"))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, train: Column, per_class: dict[int, int]) -> DataFrame:
    """label, utf8 and order of a bounded sample of training documents with a label: about per_class rows of each.

    The ids are picked from the narrow labels table, so that texts are read only for the few that were picked; their
    number bounds what is broadcast. Of documents that share a doc_id one is taken.
    """
    ids = labels.filter(train & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = stratified(ids, "label", "doc_id", per_class).select(F.col("doc_id").cast("long").alias("__id"), F.col("label").alias("__label"))
    texts = documents.select(F.col("doc_id").cast("long").alias("__doc"), F.col("text").alias("__text"))
    return one_of_each(texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")), "__doc", "__label", "__text")


def fitted(sample: DataFrame, fit: Callable, label_bytes: int):
    """fit(rows) of the (UTF-8 text, label) rows of a bounded sample, run in one task; only the model comes to the driver.

    In the order of their hashes a label's texts are taken as long as they fit into label_bytes; its first text is always
    taken. So memory is bounded in bytes as well as in rows.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_cache().clear()
        rows, used = [], {}
        for b in batches:
            for k, label in enumerate(b.column(0).to_pylist()):
                n = len(b.column(1)[k].as_buffer() or b"")
                if label not in used or used[label] + n <= label_bytes:
                    used[label] = used.get(label, 0) + n
                    rows.append((b.column(1)[k].as_py(), label))
        model = pickle.dumps(fit(rows), protocol=pickle.HIGHEST_PROTOCOL)
        del rows
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    one = sample.select("label", "utf8", "order").repartition(1).sortWithinPartitions("order", "label", "utf8")
    found = one.select("label", "utf8").mapInArrow(part, "model binary").collect()
    return pickle.loads(bytes(found[0][0])) if found else fit([])


def trim() -> None:
    """Gives memory that is free inside of the process back to the system, where the platform can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def common_cache() -> dict:
    """The worker's cache: functions are shipped by value, so they look it up in the module where they run."""
    from foliant.llm import common

    return common.WORKER_CACHE


#: Texts that a function of map_texts() gets at a time.
SLICE = 1024


def map_texts(df: DataFrame, text: str, fields: str, make: Callable, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all where None), untouched, with fields computed from the UTF-8 bytes of column text.

    make() runs once in each partition and returns a function from a list of bytes (empty for null) to one sequence per
    field. Kept columns travel as one struct, so their names and types can't clash with anything here; a kept column
    that has the name of a field gives way to it. A kept string column text travels once, as the bytes that are read.
    """
    names = list(T._parse_datatype_string(fields).names) if isinstance(fields, str) else fields.names
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]
    same = [c for c in kept if c == text and df.schema[c].dataType == T.StringType()]
    rows = df.select(F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in kept if c not in same]).alias("row"), F.col(f"`{text}`").cast("binary").alias("utf8"))
    front = ["row", "utf8"] if same else ["row"]
    schema = T.StructType([*[rows.schema[c] for c in front], *T._parse_datatype_string(fields).fields])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[len(front) :]]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_cache().clear()
        f = make()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                b = batch.slice(i, SLICE)
                found = f([t or b"" for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(front))], *[pa.array(x, type=k) for x, k in zip(found, kinds)]], [*front, *names])
        del f
        trim()

    got = rows.mapInArrow(part, schema)
    own = lambda c: F.col("utf8").cast("string") if c in same else F.col("row").getField(c)
    return got.select(*[own(c).alias(c) for c in kept], *[F.col(n) for n in names])
