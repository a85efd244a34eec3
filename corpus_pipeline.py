"""From raw documents to packed sequences: each stage reads what its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docproof.llm.common import shared_dir, table
from docproof.llm.exact_dedup import drop_exact_copies
from docproof.llm.packing import pack
from docproof.llm.language_id import keep_known_languages
from docproof.llm.language_id import train as train_languages
from docproof.llm.queries import _tokenizer
from docproof.llm.similar import drop_similar
from docproof.llm.toxicity import score_toxicity
from docproof.llm.toxicity import train as train_toxicity


#: Rows that a Python worker is sent at a time. Documents are long: at Spark's 10,000 a batch takes tens of megabytes in the
#: executor and again in its worker.
BATCH_ROWS = "1000"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the evidence leaves open. Null and empty texts rest on their source's habit; repeated
    rows are kept; null ids and sources are values like others; an empty table stays empty."""
    _small_batches(spark)
    return keep_known_languages(docs, train_languages(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic. Null and empty texts stay; repeated rows go or stay alike; without labels of both
    kinds nothing goes."""
    _small_batches(spark)
    scored = score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")), name="__score")
    return scored.where("__score < 0.5").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays; null counts as empty; rows equal in id and text stay together."""
    _small_batches(spark)
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (found by SimHash with Golay keys, then counted: five-word runs, similarity 0.8 or more)
    the row with the smallest doc_id stays, of rows that share it one text; rows without an id stay."""
    _small_batches(spark)
    return drop_similar(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; one row a piece. Null and empty texts are one piece, the end id alone."""
    _small_batches(spark)
    return pack(docs, _tokenizer("word_bpe_49k.json")).drop("ids")


STAGES = [("language_id", languages), ("toxicity", toxicity), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("packing", packing)]

#: Language posteriors, a trained classifier and tokenizers cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/docproof/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
