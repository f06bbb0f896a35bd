"""Exact dedup against a persistent digest index.

The index is a Spark table bucketed and sorted by digest, in a folder of its own
below the shared one or where its user says.  A batch of new documents is reduced
to one winner a digest (partial aggregates, so a group holding a third of all
rows is summed where it is read), winners already known are removed by a
sort-merge anti-join against the bucketed table, and the rest is appended.  Every
row is then told which document stands for it, by the index's rows for the
batch's digests: another merge with the bucketed table, which is never shuffled.

One writer at a time: a batch is added under a lock file in the index's folder,
and a second writer fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.storage import Rows, cut, new_folder, shared_root

#: The characters that do not count, code points 0x20 and 0x09-0x0D.
BLANKS = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def digest_of(text: Column) -> Column:
    """SHA-256 of the text without blanks, as lower-case hex; a null text counts as empty."""
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


class DigestIndex:
    """Digests seen so far, one row each: digest, keep_id, keep_chars, keep_key, group_size (in its first batch).

    ``path`` is the index's folder, by default one named by ``table`` below the
    shared folder, or without ``table`` a passing one that goes when the driver
    ends.  A folder that holds an index already is opened, also in a new session.
    ``buckets`` is fixed when the index is made; about one for each 200 MB of
    index (2 million digests) is right, and a later rebuild may change it.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int = 16, path: str | None = None):
        self.spark, self.buckets, self.passing = spark, buckets, table is None
        self.table = table or f"digest_index_{uuid.uuid4().hex[:12]}"
        self.path = (path or (new_folder(spark, "digest-index") if self.passing else f"{shared_root(spark)}/marginalia/digest-index/{self.table}")).rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self.passing and self._fs.exists(self._at("_buckets")) and not self.exists():
            self.buckets = self._fs.getFileStatus(self._at("_buckets")).getLen()  # the file has a byte a bucket
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(self.path).schema.fields)
            spark.sql(f"CREATE TABLE {self.table} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def rows(self) -> DataFrame:
        """The index as plain files, so that a join may split a hot digest among tasks."""
        return self.spark.read.schema(self.spark.table(self.table).schema).parquet(self.path)

    def of(self, digests: DataFrame) -> DataFrame:
        """The index's rows for these distinct digests, by a merge with the bucketed table."""
        return self.spark.table(self.table).join(digests.hint("merge"), "digest", "left_semi")

    def _append(self, fresh: DataFrame) -> None:
        spread = fresh.select("digest", "keep_id", "keep_chars", "group_size", "keep_key").repartition(self.buckets, "digest")
        spread.write.format("parquet").mode("append").option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        if not self.passing and not self._fs.exists(self._at("_buckets")):
            out = self._fs.create(self._at("_buckets"))
            out.write(bytearray(self.buckets))
            out.close()

    def add(self, rows: DataFrame, order: list[str], key: Column) -> DataFrame:
        """Add a batch of (digest, n_chars, <order columns>); returns the index's rows for the batch's digests.

        Of equal digests in the batch the row with most characters stays, then
        the least by ``order`` (nulls last); a digest that the index holds
        already keeps its row.  ``key`` names the row that stays.
        """
        rank = F.struct(F.col("n_chars").alias("a"), *[x for i, c in enumerate(order) for x in (F.col(c).isNotNull().alias(f"b{i}"), F.bitwise_not(F.col(c)).alias(f"c{i}"))])
        best = F.max_by(F.struct(F.col(order[0]).alias("keep_id"), F.col("n_chars").alias("keep_chars"), key.alias("keep_key")), rank)
        winners = rows.groupBy("digest").agg(best.alias("w"), F.count("*").alias("group_size"))
        winners = winners.select("digest", "w.keep_id", "w.keep_chars", "group_size", "w.keep_key")
        if not self._fs.createNewFile(self._at("_lock")):
            raise RuntimeError(f"another writer adds to {self.path}; if it is gone, remove {self.path}/_lock")
        try:
            if not self.exists():
                self._append(winners)
                return self.rows()
            winners = cut(winners, "winners")
            known = self.spark.table(self.table).select("digest").hint("merge")
            self._append(cut(winners.join(known, "digest", "left_anti"), "fresh"))
            return cut(self.of(winners.select("digest")), "known")
        finally:
            self._fs.delete(self._at("_lock"), False)

    def forget(self) -> None:
        """Take the table from the catalogue; its folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_groups(docs: DataFrame | Rows, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters 0x20 and 0x09-0x0D.
    Of equal texts in a batch the one with most code points stays, then the
    smallest doc_id (a null doc_id comes last).  With an index that holds
    earlier batches, a digest found there keeps its earlier row.  Null texts
    count as empty, an empty table gives no rows, rows repeated whole: one of
    them is kept.  Further columns are ignored.
    """
    given = Rows.of(docs)
    spark, key = given.frame.sparkSession, given.key
    rows = given.pick(doc_id="long", text="string")
    rows = rows.select(*key, "doc_id", digest_of(F.col("text")).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    rows = cut(rows, "digests")
    own = index or DigestIndex(spark)
    known = own.add(rows, ["doc_id", *key], F.struct(*key))
    if index is None:
        own.forget()
    found = rows.join(known.select("digest", "keep_id", "keep_key", "group_size"), "digest")
    return found.select(
        "doc_id", "keep_id", "group_size",
        (F.struct(*key) == F.col("keep_key")).alias("kept"),
        F.col("digest").alias("text_sha256"), *key,
    )


def drop_exact_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Which row stays, and what null, empty and repeated rows do, is as in
    ``exact_groups``; columns of any names are carried along, an empty table
    stays empty.
    """
    rows = Rows.of(docs)
    return rows.only(exact_groups(rows, index).where("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: The same result in DuckDB's SQL; repeated rows get their place in the file as last tie-break.
SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256,
         length(coalesce(text, '')) AS n
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST) AS k,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""
