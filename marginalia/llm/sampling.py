"""A bounded sample of labelled documents, for fitting the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.storage import pick

#: Labelled rows that a classifier is fitted on at most: those with the least hash of doc_id.
FIT_ROWS = 20_000
FOLDS = 5


def fold(doc_id):
    """crc32 of the doc_id as text, modulo FOLDS; fold 0 is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled documents outside the held-out fold.

    Rows with a null doc_id or label take no part; a doc_id labelled twice has
    the label most rows give it, 1 at a tie; a doc_id that several documents
    carry gives the least of their texts.  So there are ``limit`` rows at most,
    also if one doc_id holds a third of all rows.  The chosen ids are at most
    ``limit`` rows of two numbers, which is why they may be broadcast.
    """
    known = pick(labels, **{"doc_id": "long", label: "double"}).withColumnRenamed(label, "y")
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold("doc_id") != 0))
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = pick(docs, doc_id="long", text="string")
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
