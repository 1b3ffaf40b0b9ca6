"""A corpus pipeline of four stages: toxicity, near-duplicates, benchmark passages, segmentation.

Every stage takes whole documents (doc_id, text and any other columns) and hands on the rows that it keeps, with the
columns that came in; the last one hands on piece ids.  In all stages a null text is an empty one, which is neither toxic
nor a duplicate nor contaminated, and has no pieces; texts are taken whole, however long; no rows give no rows.
Documents without a doc_id are told apart by their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import decontaminate, minhash, sentencepiece_nbest, toxicity
from skyloom.llm.common import discard, materialise, settled
from skyloom.llm.queries import TOKENIZER, table


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null doc_id becomes a large number by the text."""
    return docs.select(document_key().alias("doc_id"), "text")


def document_key() -> Column:
    by_text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    return F.coalesce(F.col("doc_id").cast("long"), by_text)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of all documents but those of ``gone`` (doc_id as ``keyed`` has it)."""
    left = docs.withColumn("_document", document_key())
    return left.join(gone.select(F.col("doc_id").alias("_document")).distinct(), "_document", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go, row by row: repeated rows and rows without a doc_id are judged by
    their own text; equal texts fare alike.  Without labels of both kinds nothing goes."""
    others = tuple(c for c in docs.columns if c != "doc_id")
    scored = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"), keep=others)
    return scored.where("predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest id stays, one without an id only if none has one.
    Rows that repeat a doc_id are one document: all stay or all go."""
    classes = minhash.near_duplicates(keyed(docs))
    return without(docs, settled(classes.where("NOT kept").select("doc_id"), classes, "copies"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, with all rows of their doc_id.  Without items nothing goes."""
    report = decontaminate.find_contamination(keyed(docs), table(spark, sf_dir, "benchmark"), near_terms=0)
    return without(docs, settled(report.where("size(hits) > 0").select("doc_id"), report, "contaminated"))


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row that is left as piece ids, with the scores of its best segmentations; null ids and repeated rows stay
    row by row.  Of segmentations of equal scores always the same one comes first."""
    return sentencepiece_nbest.encode_n_best(docs, TOKENIZER, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("segmentation", segment),
]

#: The models of the first and the search of the last stage are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        discard(before)
    return docs
