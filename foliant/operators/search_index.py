"""The search text and its postings, written when a corpus is stored, so that a query reads what was prepared.

entries: the rows with their normalised text; postings: (term, id), sorted by term, so that a scan for a query's terms
reads few row groups; frequencies: (term, df), sorted alike. Retrieval never normalises a text twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as tx


@dataclass(frozen=True)
class SearchIndex:
    entries: DataFrame
    postings: DataFrame
    frequencies: DataFrame


def scratch(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or the warehouse where the session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    return (at or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/foliant-scratch").rstrip("/")


def normalized(rows: DataFrame, text: str = "text", out: str = "normalized") -> DataFrame:
    """rows with the normal form of text in place of it."""
    return rows.withColumn(out, tx.once(tx.normalize_search(F.col(text)))).drop(*({text} - {out}))


def built(rows: DataFrame, at: str, text: str = "text") -> SearchIndex:
    """Writes the index of rows(id, ..., text) to the folder at, replacing what is there."""
    spark = rows.sparkSession
    normalized(rows, text).write.mode("overwrite").parquet(f"{at}/entries")
    entries = spark.read.parquet(f"{at}/entries")
    terms = entries.select(F.explode(tx.index_terms(F.col("normalized"))).alias("term"), "id")
    terms.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{at}/postings")
    postings = spark.read.parquet(f"{at}/postings")
    frequencies = postings.groupBy("term").agg(F.count("*").alias("df"))
    frequencies.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{at}/frequencies")
    return SearchIndex(entries, postings, spark.read.parquet(f"{at}/frequencies"))


_BUILT: dict[tuple, SearchIndex] = {}


def of_table(spark: SparkSession, path: str, rows: DataFrame, text: str = "text") -> SearchIndex:
    """The index of the table at path, built by the first query of a session and again once the table has changed."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
    seen = fs.getContentSummary(file)
    stamp = (spark.sparkContext.applicationId, path, seen.getLength(), seen.getFileCount(), fs.getFileStatus(file).getModificationTime())
    if stamp not in _BUILT:
        for old in [k for k in _BUILT if k[:2] == stamp[:2]]:
            del _BUILT[old]
        _BUILT[stamp] = built(rows, f"{scratch(spark)}/search-{abs(hash(stamp)):x}", text)
    return _BUILT[stamp]
