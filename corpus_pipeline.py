"""The corpus pipeline: quality rules, near-dedup, secret scans, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.  Columns besides those of
documents are dropped, whatever their names; an empty table gives an empty one at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import mixing, neardup, packing, quality, secrets
from tabulon.llm.common import DOCUMENT_COLUMNS, checkpoint_folder, table
from tabulon.llm.queries import SOURCE_WEIGHTS


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*DOCUMENT_COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the model reject go.  The model is trained on the labelled documents
    among ``docs``.  Null, empty and blank texts have too few words and go; repeated rows go or stay together; a
    null in another column makes no difference; very long texts are judged whole."""
    return _documents(quality.score(_documents(docs), table(spark, sf_dir, "labels")).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that of the smallest doc_id, ids being smaller than null.
    Of repeated rows one stays, and of a class whose smallest doc_id has several texts, or that has no doc_id, the
    text of the least digest.  Texts without words (null, empty, blank) have no copies but rows equal in doc_id and
    text, null being equal to empty here."""
    return _documents(neardup.drop_near_duplicates(_documents(docs)))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets replaced by a mark; n_chars follows the text.  Null text stays null, with
    its n_chars; repeated rows stay, each changed alike."""
    clean = secrets.scan(_documents(docs), redacted=True)
    return _documents(clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, by Poisson draws to the sources' target weights, and shuffled.  A null
    source shares the weight of those not listed; rows of one doc_id, null included, draw the same count each."""
    return _documents(mixing.mix(_documents(docs), SOURCE_WEIGHTS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents' tokens, a sequence each, with their ids.  Null and empty texts are an end mark
    alone; repeated rows have sequences of their own; a null doc_id stays null."""
    import public_tokenizers

    return packing.pack(_documents(docs), str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scans", secret_scans),
    ("mix_sources", mix_sources), ("pack_sequences", pack_sequences),
]

#: SQL can't express the model, the sampling and the tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet to the shared folder and read again.

    What a stage wrote is deleted once the next one is written; the last folder stays, for the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            _delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
