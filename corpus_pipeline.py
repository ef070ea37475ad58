"""Training-text pipeline: five stages over documents, each written and read again before the next one.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of documents; the last
returns the mixture: the drawn blocks' words by shard and position, with the document that each piece comes from.

For every stage: null texts count as empty, very long texts are read whole, rows that repeat are rows like others, null
ids and other nulls pass, an empty table gives no rows, and further columns pass as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import minhash, mixing, suffixes, toxicity, winnowing
from tracewarden.llm.work import staged


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the classifier does not call toxic.

    Equal texts are judged alike; null and empty texts score as texts without words, which stay unless toxic texts are
    the rule.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id; of rows of one id, one text.

    Texts without words are linked with nothing, so all of them stay.
    """
    return minhash.drop_near_duplicates(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that start earlier too; n_chars follows the text.

    No row goes, even if nothing of its text is left; earlier is by id, null last, then by text digest.
    """
    kept = suffixes.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Documents without words are never contaminated.
    """
    return winnowing.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of the mixture: as often as they are drawn, and none of what is not drawn.

    Documents without words give none.  Shard, position and start order the rows; equal rows are different documents.
    """
    return mixing.emitted(mixing.mix_sources(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("repeats", repeats_stage),
    ("contamination", contamination_stage),
    ("mixing", mixing_stage),
]

#: Classifier, sketches and byte digests cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
