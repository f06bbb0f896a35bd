"""A corpus pipeline: drop junk, exact copies and near copies, mix the sources, pack the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import exact, mixture, packing, quality, simhash
from marginalia.storage import cut, new_folder, remove_folder


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    It is fitted on the labelled ones of ``docs`` outside the held-out fold; with
    none it scores all alike and keeps them.  Null and empty texts have statistics
    of zero and are scored by them; equal texts and repeated rows share a score;
    a very long text is read whole.  Null doc_ids are never fitted on.  Columns
    of any names come through as they are; an empty table stays empty.
    """
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, blanks not counting.

    The longest stays, at a tie the smallest doc_id, a null one last, then the
    first row.  Null texts count as empty; of rows repeated whole one stays.
    Columns of any names come through; an empty table stays empty.
    """
    return exact.drop_exact_copies(docs)


def sparse(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash fingerprints, as ``op1_simhash`` has them: links at 4 or fewer differing bits.

    No such link is lost, and a component of any size costs no more than its
    cells do.  The smallest doc_id stays, a null one last, then the first row.
    Null, empty and blank texts have the fingerprint zero and are copies of one
    another; a text of fewer than four words is one shingle.  Columns of any
    names come through; an empty table stays empty.
    """
    return simhash.drop_near_fingerprints(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents mixed to target weights, some repeated or cut into drawn blocks, shuffled within shards.

    Documents without a word are not drawn; a null source is a source of its
    own; null doc_ids and repeated rows are documents like others; a very long
    text is drawn by blocks.  Columns of any names come through (n_chars counts
    what is left of a text); an empty table stays empty.
    """
    return mixture.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences.

    Null and empty texts have the end id alone; a very long text fills sequences
    of its own; null doc_ids stay null; repeated rows are packed each; further
    columns are ignored; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", sparse), ("mixture", mixed), ("packing", packed)]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table goes as soon as the next one has been written, so two are on disk at most."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"pipeline-{name}")
        docs = cut(stage(spark, docs, sf_dir), name, folder)
        if before:
            remove_folder(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
