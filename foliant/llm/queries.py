"""The thin queries of the ten operators over the whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import ann, common, langid, line_dedup, lm, media, mixing, packing, quality, simhash, toxicity


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return common.table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "lang")
    held_out = common.remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs, ~held_out)
    return langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir, "source")).select("doc_id", "size", "source_size", "target", "taken")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_documents(spark, sf_dir), keep=["doc_id"])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_documents(spark, sf_dir)).select("row.doc_id", "n_lines", "n_dropped", "kept_sha256")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = common.remainder(F.col("doc_id"), 5) == 1
    got = lm.score(_documents(spark, sf_dir), ~held_out, keep=["doc_id"])
    return got.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), common.table(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = common.remainder(F.col("doc_id"), 3) == 1
    model = quality.train(docs, labels, ~held_out)
    return quality.score(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = common.remainder(F.col("doc_id"), 4) == 2
    model = toxicity.train(spark, docs, labels, ~held_out)
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_language_id, op2_mixing, op3_media, op4_line_dedup, op5_lm_scoring, op6_nearest, op7_quality, op8_packing, op9_toxicity, op10_simhash, pipeline)
    return {f.__name__: f for f in own}


SQL_LINES = r"""
WITH docs AS (SELECT coalesce(doc_id, -9223372036854775808) AS doc, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, row_number() OVER () AS rid FROM documents),
lines AS (SELECT rid, doc, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key, max(doc) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT rid) >= 3),
marked AS (SELECT k.*, o.key IS NOT NULL AND k.doc <> o.top AS gone FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""


def oracle_sql() -> dict[str, str]:
    mix = mixing.SQL.replace("FROM docs)", "FROM documents)")
    return {"op2_mixing": mix, "op4_line_dedup": SQL_LINES}
