"""Upserts, overlays, set differences and non-regression checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.plans.records import records, sql, table


def upsert(old: DataFrame, new: DataFrame, key: str, keep) -> DataFrame:
    """Replace by key; old rows for which ``keep`` holds stay.  One full outer join, an ``action`` per row."""
    cols = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*cols).alias("a"), keep.alias("kept"))
    b = new.select(key, F.struct(*cols).alias("b"))
    j = a.join(b, key, "full_outer")
    action = F.when(F.col("b").isNull(), "unchanged").when(F.col("a").isNull(), "inserted").when(F.col("kept"), "skipped").otherwise("updated")
    row = F.when(F.col("b").isNull() | F.coalesce("kept", F.lit(False)), F.col("a")).otherwise(F.col("b"))
    return j.select(key, row.alias("r"), action.alias("action")).select(key, "r.*", "action")


def conflicts(old: DataFrame, new: DataFrame, key: str, text: str, confirmed) -> DataFrame:
    """Keys whose confirmed text an incoming row would change, and keys that come twice with different texts."""
    changed = old.where(confirmed).select(key, F.col(text).alias("was")).join(new.select(key, F.col(text).alias("now")), key).where(~F.col("was").eqNullSafe(F.col("now"))).select(key, F.lit("confirmed_text_differs").alias("reason"))
    twice = new.groupBy(key).agg(F.countDistinct(text).alias("n")).where("n > 1").select(key, F.lit("incoming_differ").alias("reason"))
    return changed.unionByName(twice).distinct()


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(key).join(old, key, "left_anti").select(*old.columns))


def overlay(df: DataFrame, decisions: DataFrame, key: str, column: str, decision: str) -> DataFrame:
    """A person's decision takes the place of the stored value."""
    return df.join(decisions, key, "left").withColumn(column, F.coalesce(F.col(decision), F.col(column))).drop(decision)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two snapshots has, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after")))


def delete_cascade(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def completeness(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Expected without being found, and found without being expected."""
    lost = expected.select(key).distinct().join(found, key, "left_anti").select(key, F.lit("missing").alias("state"))
    extra = found.select(key).distinct().join(expected, key, "left_anti").select(key, F.lit("unexpected").alias("state"))
    return lost.unionByName(extra)


def confirmed_pairs(df: DataFrame, answers: DataFrame) -> DataFrame:
    """Records with their response, where the link is confirmed."""
    return df.join(answers, "response_id", "left").withColumn("response", F.when(F.col("link_status") == "confirmed", F.col("response")))


def sole_matches(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Equi-join on a printed number, only where one candidate is there."""
    one = b.groupBy(key).agg(F.count("*").alias("n"), F.min("response_id").alias("response_id")).where("n = 1").drop("n")
    return a.join(one, key)


def greedy_rank_match(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One-to-one: the k-th of a key on either side belong together."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy("id"))
    left, right = a.withColumn("n", n).select(key, "n", F.col("id").alias("left_id")), b.withColumn("n", n).select(key, "n", F.col("id").alias("right_id"))
    return left.join(right, [key, "n"]).select(key, "left_id", "right_id")


def _halves(s, d):
    r = records(s, d).select("comment_id", "city", "trust", "link_status")
    old = r.where("comment_id % 5 < 3")
    new = r.where("comment_id % 5 >= 2").withColumn("city", F.concat("city", F.lit("+")))
    return old, new


QUERIES = {
    "upsert": (
        lambda s, d: upsert(*_halves(s, d), "comment_id", F.col("trust") == "verified").select("comment_id", "city", "action"),
        sql(
            "SELECT comment_id, CASE WHEN n IS NULL OR (o IS NOT NULL AND trust = 'verified') THEN city ELSE city || '+' END AS city, CASE WHEN n IS NULL THEN 'unchanged' WHEN o IS NULL THEN 'inserted' WHEN trust = 'verified' THEN 'skipped' ELSE 'updated' END AS action FROM h",
            "h AS (SELECT *, CASE WHEN comment_id % 5 < 3 THEN 1 END AS o, CASE WHEN comment_id % 5 >= 2 THEN 1 END AS n FROM records)",
        ),
    ),
    "snapshot_difference": (
        lambda s, d: same_rows(*_halves(s, d)).select("comment_id", "city", "side"),
        sql("SELECT comment_id, city, 'before' AS side FROM records WHERE comment_id % 5 < 3 UNION ALL SELECT comment_id, city || '+', 'after' FROM records WHERE comment_id % 5 >= 2"),
    ),
    "completeness": (
        lambda s, d: completeness(table(s, d, "documents"), table(s, d, "labels"), "doc_id"),
        "SELECT doc_id, 'missing' AS state FROM (SELECT DISTINCT doc_id FROM documents) a WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.doc_id) UNION ALL SELECT doc_id, 'unexpected' FROM (SELECT DISTINCT doc_id FROM labels) a WHERE NOT EXISTS (SELECT 1 FROM documents l WHERE l.doc_id = a.doc_id)",
    ),
    "overlaid_decisions": (
        lambda s, d: overlay(records(s, d).select("comment_id", "link_status"), table(s, d, "labels").where("toxic = 0").select(F.col("doc_id").alias("comment_id"), F.lit("confirmed").alias("decision")), "comment_id", "link_status", "decision").groupBy("link_status").agg(F.count("*").alias("n")),
        sql("SELECT CASE WHEN l.toxic = 0 THEN 'confirmed' ELSE link_status END AS link_status, count(*) AS n FROM records r LEFT JOIN labels l ON l.doc_id = r.comment_id GROUP BY 1"),
    ),
    "rank_matches": (
        lambda s, d: greedy_rank_match(table(s, d, "orders").where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("id")), table(s, d, "orders").where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("id")), "o_custkey"),
        """WITH n AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders)
        SELECT a.o_custkey, a.o_orderkey AS left_id, b.o_orderkey AS right_id FROM n a JOIN n b ON a.o_custkey = b.o_custkey AND a.n = b.n WHERE a.o_orderstatus = 'O' AND b.o_orderstatus = 'F'""",
    ),
}
