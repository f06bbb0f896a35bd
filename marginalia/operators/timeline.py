"""Events: splitting cumulative histories, ordering threads, relations, rounds and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.plans.records import records, sql, table

def relations(df: DataFrame, thread: str, order: list, text: str) -> DataFrame:
    """Each event's place in its thread and its relation to the last event before it that has a text."""
    w = Window.partitionBy(thread).orderBy(*order)
    plain = F.lower(X.collapse(F.col(text)))
    said = F.when(plain != "", plain)
    before = F.last(said, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    kind = F.when(before.isNull(), "initial").when(said == before, "exact_reissue").when(said.rlike("not accepted|rejected|insufficient"), "response_rejected").otherwise("reissued_with_clarification")
    return df.withColumn("place", F.row_number().over(w)).withColumn("relation", kind)


def recurring(df: DataFrame) -> DataFrame:
    """Threads with two rounds or more: rounds, events, first and last, how long they ran, whether they ended confirmed."""
    last = F.max_by("link_status", F.struct("review_round", "comment_id"))
    found = df.groupBy("issue_id").agg(F.countDistinct("review_round").alias("rounds"), F.count("*").alias("events"), F.countDistinct("project_id").alias("projects"), F.min("review_round").alias("first_round"), F.max("review_round").alias("last_round"), last.alias("last_status"))
    found = found.where("rounds >= 2").withColumn("span", F.col("last_round") - F.col("first_round") + 1)
    return found.withColumn("status", F.when(F.col("last_status") == "confirmed", "resolved").otherwise("open")).drop("last_status")


def recurrence_stats(df: DataFrame) -> DataFrame:
    r = recurring(df)
    return r.agg(F.count("*").alias("threads"), F.max("events").alias("longest"), F.round(F.avg(F.when(F.col("status") == "resolved", F.col("span"))), 4).alias("average_rounds_to_resolution"), F.sum((F.col("status") == "open").cast("long")).alias("open_threads"))


def merge_duplicate_events(df: DataFrame) -> DataFrame:
    """Events equal in role and text within a conversation are one, with all their places."""
    key = F.lower(X.collapse(F.col("text")))
    return df.groupBy("conv_id", X.role_family(F.col("role"), F.lit(None)).alias("family"), F.sha2(key, 256).alias("k")).agg(F.min("turn").alias("first_turn"), F.count("*").alias("occurrences")).drop("k")


def compatible(a: Column, b: Column) -> Column:
    """Null-tolerant equality: unknown fits anything."""
    return a.isNull() | b.isNull() | (a == b)


def numbered_groups(df: DataFrame, key: str, order: str, is_parent: Column) -> DataFrame:
    """Items after a parent belong to its group: a running count of parents."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("group_no", F.sum(is_parent.cast("int")).over(w))


def islands(df: DataFrame, key: str, order: str, flag: Column, gap: int = 3) -> DataFrame:
    """Runs of flagged rows, a run going on over fewer than ``gap`` rows without the flag."""
    w = Window.partitionBy(key).orderBy(order)
    hits = df.where(flag).withColumn("before", F.lag(order).over(w))
    fresh = F.col("before").isNull() | (F.col(order) - F.col("before") > gap)
    runs = hits.withColumn("run", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("hits"))


def page_batches(n: Column, size: int, overlap: int) -> Column:
    """Overlapping batches of pages 1 to n, as struct(first, last)."""
    step = size - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - overlap), F.lit(step))
    return F.transform(starts, lambda a: F.struct(a.cast("long").alias("first"), F.least(a + size - 1, n).cast("long").alias("last")))


QUERIES = {
    "thread_relations": (
        lambda s, d: relations(table(s, d, "conversations"), "conv_id", ["turn"], "text").select("conv_id", "turn", "place", "relation"),
        """WITH c AS (SELECT *, nullif(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '') AS t FROM conversations),
        b AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM c)
        SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place,
          CASE WHEN p IS NULL THEN 'initial' WHEN t = p THEN 'exact_reissue' WHEN regexp_matches(t, 'not accepted|rejected|insufficient') THEN 'response_rejected' ELSE 'reissued_with_clarification' END AS relation FROM b""",
    ),
    "recurring_issues": (
        lambda s, d: recurring(records(s, d)),
        sql("SELECT issue_id, count(DISTINCT review_round) AS rounds, count(*) AS events, count(DISTINCT project_id) AS projects, min(review_round) AS first_round, max(review_round) AS last_round, max(review_round) - min(review_round) + 1 AS span, CASE WHEN last(link_status ORDER BY review_round, comment_id) = 'confirmed' THEN 'resolved' ELSE 'open' END AS status FROM records GROUP BY issue_id HAVING count(DISTINCT review_round) >= 2"),
    ),
    "recurrence_stats": (
        lambda s, d: recurrence_stats(records(s, d)),
        sql(
            "SELECT count(*) AS threads, max(events) AS longest, round(avg(CASE WHEN status = 'resolved' THEN span END), 4) AS average_rounds_to_resolution, CAST(sum(CASE WHEN status = 'open' THEN 1 ELSE 0 END) AS BIGINT) AS open_threads FROM r",
            "r AS (SELECT issue_id, count(*) AS events, max(review_round) - min(review_round) + 1 AS span, CASE WHEN last(link_status ORDER BY review_round, comment_id) = 'confirmed' THEN 'resolved' ELSE 'open' END AS status FROM records GROUP BY issue_id HAVING count(DISTINCT review_round) >= 2)",
        ),
    ),
    "merged_events": (
        lambda s, d: merge_duplicate_events(table(s, d, "conversations")),
        """SELECT conv_id, CASE WHEN lower(role) IN ('company', 'applicant', 'applicant_response') THEN 'company' WHEN lower(role) IN ('government', 'reviewer', 'city') THEN 'government' ELSE lower(role) END AS family,
        min(turn) AS first_turn, count(*) AS occurrences FROM conversations GROUP BY conv_id, family, lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))""",
    ),
    "numbered_groups": (
        lambda s, d: numbered_groups(table(s, d, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "group_no"),
        "SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS group_no FROM conversations",
    ),
    "event_runs": (
        lambda s, d: islands(table(s, d, "events"), "user_id", "event_id", F.col("event_type") == "click", 200),
        """WITH h AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events WHERE event_type = 'click'),
        r AS (SELECT *, sum(CASE WHEN p IS NULL OR event_id - p > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM h)
        SELECT user_id, CAST(run AS BIGINT) AS run, min(event_id) AS first, max(event_id) AS last, count(*) AS hits FROM r GROUP BY user_id, run""",
    ),
}
