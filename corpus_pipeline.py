"""A training corpus from documents: languages, near duplicates, benchmark passages, personal data, and the mix.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``, written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steplake.llm.decontaminate import contamination
from steplake.llm.jaccard_join import jaccard_components
from steplake.llm.language_id import keep_identified, learn
from steplake.llm.mix_sources import Mix
from steplake.llm.pseudonyms import replace_values
from steplake.llm.queries import PSEUDONYM_KEY, held_out
from steplake.llm.shared import written

NEAR_WORDS, NEAR_PERCENT = 5, 80  # near copies: shingles of so many words, shared in at least so much of the union

# Learned scores, pseudonyms and drawn blocks are not SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters go; mixed languages stay."""
    return keep_identified(docs, learn(docs.where(~held_out(4, 2))))


ROW = "_pipeline_row"


def _marked(docs: DataFrame) -> DataFrame:
    """docs with a key of doc_id and text: decisions are joined by it, so NULL and repeated ids are judged by their own text."""
    return docs.withColumn(ROW, F.xxhash64("doc_id", "text"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows connected by links (NEAR_WORDS, NEAR_PERCENT) the one with the smallest doc_id stays, NULL being the largest, and
    one of rows that repeat doc_id and text. Rows that share a doc_id but not the text are different rows. Rows without words stay."""
    marked = _marked(docs)
    texts = marked.select(F.col(ROW).alias("doc_id"), "text")
    found = written(jaccard_components(texts, NEAR_WORDS, NEAR_PERCENT).withColumnRenamed("doc_id", ROW), "pipeline-groups")
    worded = found.where("n_shingles > 0")
    ids = marked.select(ROW, F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", ROW).alias("place"))
    stays = (worded.select(ROW, "component_id").distinct().join(ids, ROW).groupBy("component_id").agg(F.min("place").alias("place"))
             .select(F.col(f"place.{ROW}").alias(ROW)))
    kept = marked.join(stays.unionByName(found.where("n_shingles = 0").select(ROW)), ROW, "left_semi")
    again = worded.groupBy(ROW).count().where("count > 1").select(ROW)
    if not again.isEmpty():
        kept = kept.join(again, ROW, "left_anti").select(*kept.columns).unionByName(
            kept.join(again, ROW, "left_semi").select(*kept.columns).dropDuplicates([ROW]))
    return kept.select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated rows go, whatever their doc_id; documents with a few hit words stay as they are."""
    marked = _marked(docs)
    found = contamination(marked.select(F.col(ROW).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    goes = found.where("contaminated").select(F.col("doc_id").alias(ROW)).distinct()
    return marked.join(goes, ROW, "left_anti").select(*docs.columns)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars is counted again where a text has changed."""
    out = replace_values(docs, PSEUDONYM_KEY)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_values") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the words that the mix takes of it."""
    return Mix(docs).summary()


STAGES = [("language_id", known_language), ("jaccard_join", one_of_each_group), ("decontamination", without_benchmarks),
          ("pseudonyms", with_pseudonyms), ("source_mix", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
