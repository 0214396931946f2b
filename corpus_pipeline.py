"""The corpus pipeline: quality, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that the next one reads from Parquet;
all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm.common import shared_dir, table
from quaver.llm.lines import dedup_lines
from quaver.llm.neardup import one_of_each
from quaver.llm.packing import pack
from quaver.llm.quality import CLEAN, grade_documents, ratings_of, train
from quaver.llm.registry import tokenizer_file
from quaver.llm.substring import dedup_substrings


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good and not toxic, unchanged.

    A null or empty text is graded as an empty one, repeated rows alike; a row without a doc_id is
    graded too. Without ratings of two grades all stay. The columns of docs stay, whatever their names.
    """
    model = train(docs, ratings_of(table(spark, sf_dir, "labels")))
    return grade_documents(docs, model, CLEAN).where("keep").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the line blocks that one with a smaller doc_id has.

    A null text stays null, one that loses all its lines becomes empty, rows without a doc_id stay
    as they are, and rows with the same doc_id take nothing from each other.
    """
    return _counted(dedup_lines(docs), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near copies, unchanged.

    Of rows that repeat a doc_id one stays, by text and then by the other columns. Null and blank
    texts are nobody's copies (but equal blank ones are each other's); rows without a doc_id stay.
    """
    return one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the words of passages that one with a smaller doc_id has; the words that
    stay are joined by single blanks.

    A null or empty text becomes empty. A row without a doc_id loses nothing and none loses by it.
    """
    return _counted(dedup_substrings(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. A null or empty text is one piece, its end id; repeated rows are pieces each;
    an empty table has none.
    """
    return pack(docs, tokenizer_file())


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars of the new text."""
    own = out.select(*docs.columns)
    return own.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else own


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("substrings", substrings), ("packing", packing)]

#: Hashing, classification and tokenisation aren't SQL; the tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
