"""Saved tables, snapshots and reports as JSON, read with explicit schemas and written by Spark's commit protocol.

A replaced table appears as a whole: it is written beside the old one, which gives way by a rename. What can't be read is
left out, as a missing table is empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT = (
    "filename string, saved_at string, quality struct<paper_title: string, category: string, credibility: double, classify_status: string, paper_summary: string, target_products: array<string>, organisms: array<string>>, "
    "stats struct<total: long, passed: long, failed: long>"
)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def deleted(spark: SparkSession, path: str) -> bool:
    """Whether there was something to delete."""
    fs, at = _fs(spark, path)
    return fs.delete(at, True) if fs.exists(at) else False


def document_table(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The rows under `key` of a JSON document {key: [row, ...]}; no rows where the document is missing or malformed."""
    kind = T._parse_datatype_string(schema)
    if not exists(spark, path):
        return spark.createDataFrame([], kind)
    whole = spark.read.text(path, wholetext=True)
    rows = F.from_json("value", T.StructType([T.StructField(key, T.ArrayType(kind))]))[key]
    return whole.select(F.explode(rows).alias("x")).filter("x IS NOT NULL").select("x.*")


def replaced(rows: DataFrame, path: str) -> None:
    """Writes rows as lines of JSON in place of what is at path, which rows may be read from."""
    spark, beside = rows.sparkSession, f"{path}.{uuid.uuid4().hex}"
    rows.write.json(beside)
    deleted(spark, path)
    fs, at = _fs(spark, beside)
    if not fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"{beside} could not take the place of {path}")


def appended(rows: DataFrame, path: str) -> None:
    """Adds lines to a log of JSON lines."""
    rows.write.mode("append").json(path)


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def snapshot_saved(rows: DataFrame, folder: str, name: str, overwrite: bool = False) -> bool:
    """Saves rows as the snapshot of that name; without overwrite only where there is none. Whether it was saved."""
    at = f"{folder}/{name}.json"
    if exists(rows.sparkSession, at) and not overwrite:
        return False
    replaced(rows, at)
    return True


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each readable snapshot *.json of a folder, a file or the folder of one, with defaults for what it lacks."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "file_stem string, filename string, saved_at string, paper_title string, category string, credibility double, classify_status string, paper_summary string, total_chunks long, passed long, failed long, target_products array<string>, organisms array<string>")
    texts = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    stem = F.url_decode(F.replace(F.regexp_extract("path", r"([^/]+)\.json(?:/[^/]*)?$", 1), F.lit("+"), F.lit("%2B")))
    found = texts.select(stem.alias("file_stem"), F.from_json("value", SNAPSHOT, {"mode": "PERMISSIVE"}).alias("s"), F.try_parse_json("value").alias("j"))
    found = found.filter((F.col("file_stem") != "") & F.col("j").isNotNull() & F.col("s").isNotNull())
    q, n = F.col("s.quality"), F.col("s.stats")
    none = F.array().cast("array<string>")
    return found.select(
        "file_stem", F.coalesce("s.filename", "file_stem").alias("filename"), F.coalesce("s.saved_at", F.lit("")).alias("saved_at"),
        *[F.coalesce(q[c], F.lit("?")).alias(c) for c in ("paper_title", "category")], F.coalesce(q["credibility"], F.lit(0.0)).alias("credibility"),
        F.coalesce(q["classify_status"], F.lit("?")).alias("classify_status"), F.coalesce(q["paper_summary"], F.lit("")).alias("paper_summary"),
        F.coalesce(n["total"], F.lit(0)).alias("total_chunks"), *[F.coalesce(n[c], F.lit(0)).alias(c) for c in ("passed", "failed")],
        *[F.coalesce(q[c], none).alias(c) for c in ("target_products", "organisms")],
    ).orderBy(F.desc("file_stem"))


def pdf_paths(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    """(path) of the PDF files of folders, each once, in order; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", str(recursive).lower()).load(list(paths))
    return found.select("path").distinct().orderBy("path")


def report_written(rows: DataFrame, at: str) -> None:
    """A report as JSON lines and as CSV with a header; arrays and structs stand in the CSV as JSON."""
    rows.write.mode("overwrite").json(f"{at}/json")
    flat = [F.to_json(c).alias(c) if isinstance(rows.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c in rows.columns]
    rows.select(*flat).write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(f"{at}/csv")
