"""The corpus pipeline: which documents stay, with what text, and how they are packed into sequences.

Stages, each on all that its predecessor kept: language ID (documents without a language go), SimHash
near-duplicates (one document of each group stays), benchmark decontamination (documents that hold
benchmark passages go), personal data (spans are replaced by their kind), best-fit packing (pieces).

All but the last stage return the columns of ``documents``.  Columns beyond those of ``documents`` pass
through, whatever their names: no stage's own columns meet them.  Rows are told apart by all their values, not by
their doc_id, so that rows that share a doc_id or have none stay or go each by its own text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.lineage import remove, shared_folder
from waymark.llm import decontaminate, langid, packing, pii, simhash
from waymark.llm._common import keep_rows, row_keys, settle, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(docs: DataFrame) -> DataFrame:
    """(text, aside): all other columns in one struct, out of the way of an operator's own."""
    return docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("aside"))


def _back(rows: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The columns of before from what :func:`_aside` made."""
    return rows.select(*(changed.get(c, F.col("text") if c == "text" else F.col(f"aside.`{c}`")).alias(c) for c in columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents for which a language is found; it learns from the labels of its own input.

    Null and empty texts, and those without a letter, have no language and go.  Repeated rows are judged
    alike; null doc_ids and labels pass.  Where no row has a label nothing is learned and nothing is rejected.
    """
    model = langid.train(docs.select("doc_id", "text", "lang"))
    if not model.languages:
        return docs
    judged = langid.identify(_aside(docs), model)
    return _back(judged.where(F.col("lang_pred") != langid.UNKNOWN), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: the one with the smallest doc_id, or by hash where none has one.

    Null and empty texts are alike and form one group.  Of repeated rows one stays.  Ties of doc_id are
    decided by a hash of the row.
    """
    return simhash.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold passages of the benchmark.

    Null and empty texts hold none and stay.  Repeated rows stay or go together.  An empty benchmark drops nothing.
    Items of under four words drop only the documents that they are the whole of.
    """
    keyed, keys = row_keys(docs)
    hits = decontaminate.overlaps(keyed.select(F.struct(*keys).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("not brief")
    gone = settle(hits.select(*(F.col(f"doc_id.{k}").alias(k) for k in keys)).distinct())
    return keep_rows(keyed, gone, keys, "left_anti").drop(*keys)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind; ``n_chars`` follows the text.

    Null texts stay null (with null n_chars), empty ones empty.  Repeated rows are changed alike; every row stays.
    """
    found = pii.find(_aside(docs), pii.train(docs), redact=True)
    text = F.when(F.col("text").isNull(), None).otherwise(F.col("redacted"))
    return _back(found, docs.columns, text=text, n_chars=F.char_length(text).cast("bigint"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens.

    A null or empty text is the single id 0.  Repeated rows are packed each; a null doc_id stays null.
    """
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language id", language_id),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal data", personal_data),
    ("packing", packed),
]

#: SQL can't express trained models, fingerprints of words, or the tokenizer: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written as Parquet in the shared folder and read again, and the one before it removed.

    If a stage fails, nothing stays behind.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    except BaseException:
        remove(spark, folder)
        raise
    return docs
