"""The corpus pipeline: language, quality, near duplicates, benchmark leaks, token ids.

Each stage takes what the stage before it kept and returns the columns of ``documents``; the
last returns token ids. ``run`` writes what a stage returns as Parquet in the shared folder
and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, decontam, jaccard, langid, quality
from tidemill.llm.common import held_out, table, written
from tidemill.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is kept if one language wrote at least this part of it.
LEAST_LANGUAGE = 0.5

#: Learned models and byte-level ids cannot be said in SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no determined language and those that no language dominates.

    So null and empty texts and texts without letters go; repeated rows, null ids and rows with nulls elsewhere are judged by their
    texts like all others. An empty table stays empty.
    """
    model = langid.train(docs, ~held_out("doc_id", 4, 2))
    named = langid.identify(docs.select(*COLUMNS), model, keep=COLUMNS)
    return named.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier predicts to be of label 0.

    A null text counts as empty and gets a score like all others; repeated rows and null ids are judged by their texts. Without
    labels the net is untrained. An empty table stays empty.
    """
    net = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    return quality.score(docs.select(*COLUMNS), net, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest id stays.

    Texts that are null or without words are like nothing and stay. Of rows that repeat an id and its text one stays. Rows
    without an id have no place in a group: those with one text count as one, which stays. An empty table stays empty.
    """
    rows = docs.select(*COLUMNS)
    groups = jaccard.near_duplicates(rows.select("doc_id", "text"), width=5, num=80, den=100)
    of_id = groups.groupBy(F.col("doc_id").alias("id")).agg(F.bool_or(F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(False))).alias("gone"), ((F.count("*") > 1) | F.col("doc_id").isNull()).alias("again"))
    judged = rows.join(of_id.where("gone or again"), F.col("doc_id").eqNullSafe(F.col("id")), "left").where("gone is null or not gone")
    once, again = judged.where("again is null or not again"), judged.where("again").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents into which a benchmark item has leaked.

    Null and empty texts and rows without an id stay; of an id with several rows all go if one holds a leak. Without items
    nothing goes.
    """
    return decontam.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), common=True)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the hashes of the ids and of the decoded text; one row each, a null text counting as empty."""
    return bpe.encode_documents(docs, vocabulary("byte_bpe_50k.json"), keep_ids=True, keep_decoded=False)


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
