"""From raw documents to packed training sequences, stage by stage.

Each stage takes all documents that the one before has kept and is written as
Parquet in the folder that all machines share before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthmatch.llm.common import new_folder, saved, table
from monthmatch.llm.jaccard import jaccard_classes, word_digest
from monthmatch.llm.mixing import BUDGET_SHARE, mix_sources
from monthmatch.llm.packing import pack_documents
from monthmatch.llm.quality import score_quality
from monthmatch.llm.secret_scan import redact_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = score_quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Null ids come after all others. Of rows that agree in id and words one stays.
    """
    docs = docs.select(*COLUMNS)
    kept = jaccard_classes(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), "digest").distinct()
    marked = docs.withColumn("digest", word_digest(F.col("text")))
    # Which of the rows that agree in id and words stays does not depend on their order.
    first = (
        marked.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (marked["digest"] == kept["digest"]))
        .groupBy("doc_id", marked["digest"])
        .agg(F.min(F.struct(*COLUMNS[1:])).alias("first"))
    )
    return first.select("doc_id", "first.*").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""
    return (
        redact_secrets(docs.select(*COLUMNS))
        .withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")))
        .withColumn("n_chars", F.col("n_chars").cast("long"))
        .select(*COLUMNS)
    )


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to a budget of tokens, towards the target shares of sources, languages and topics.

    None is taken twice: cells with too few tokens for their share are kept whole.
    """
    mixed = mix_sources(docs.select(*COLUMNS), budget_share=BUDGET_SHARE, repeats=False)
    return mixed.filter("sampled").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("secret scan", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: The classifier, the join and the tokenizer are beyond SQL; tests compare the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    folder = new_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return docs
