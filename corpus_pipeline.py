"""The corpus pipeline: five stages, each on all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet in the shared folder and rereads it as the next one's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, decontaminate, jaccard_join, language_id, quality
from corpusloom.llm.common import cut, without_ids
from corpusloom.llm.queries import vocabulary_path
from corpusloom.session import ship_code


#: Benchmark items of fewer tokens are no passage: a word or two would take clean documents.
LEAST_TOKENS = 7


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised.

    Null texts, texts without a letter and texts so far from every profile that
    no labelled text is half as far (another script, say) go.  Labels are those
    of all rows that aren't held out, for the profiles and for that least score; a null doc_id is never learned from.
    """
    ship_code(spark)
    profiles = language_id.fit_profiles(docs.filter(~language_id.held_out()))
    judged = cut(language_id.identify(docs.select(F.struct("*").alias("row"), "text"), profiles).drop("text"))
    labelled = judged.filter("row.text is not null and row.lang is not null").filter(~language_id.held_out("row.doc_id"))
    least = language_id.least_score(labelled)
    return judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= least)).select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality model predicts as good; null and empty texts are judged as texts without words."""
    ship_code(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs.filter(~quality.held_out()), labels.filter(~quality.held_out()))
    scored = quality.score_quality(docs.select(F.struct("*").alias("row"), "text"), model)
    return scored.filter("predicted = 1").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component of similar documents, with all its rows; rows with a null doc_id stay."""
    ship_code(spark)
    found = cut(jaccard_join.join_components(docs))
    return without_ids(docs, "doc_id", found.filter("component_id != doc_id").select("doc_id").distinct())


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a passage with a benchmark item of LEAST_TOKENS or more; null ids and texts stay."""
    ship_code(spark)
    leaks = cut(decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), LEAST_TOKENS).select("doc_id").distinct())
    return without_ids(docs, "doc_id", leaks)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every kept document."""
    ship_code(spark)
    return bpe.round_trip(docs, bpe.read_vocabulary(vocabulary_path()))


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", encode),
]

#: Rank-order profiles, a fitted linear model, 64-bit hashes and BPE can't be stated in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
