"""The evidence model: canonical events, occurrences, packets, citations, reviews and their audits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import taxonomy as C
from marginalia.functions import text as X
from marginalia.functions.identity import provenance, stable_id
from marginalia.plans.records import records, sql, table


def canonical_events(df: DataFrame) -> DataFrame:
    """Records equal in city, project, round and text are one event with its occurrences counted."""
    text = F.sha2(F.lower(X.collapse(F.col("text"))), 256)
    keyed = df.withColumn("canonical_event_id", stable_id("CE", F.col("city"), F.col("project_id"), F.col("review_round"), text))
    return keyed.groupBy("canonical_event_id").agg(F.min("comment_id").alias("canonical_comment_id"), F.count("*").alias("occurrences"), F.min("review_round").alias("first_round"), F.max("review_round").alias("last_round"), F.sum((F.col("trust") == "verified").cast("long")).alias("verified"))


def timelines(df: DataFrame) -> DataFrame:
    """Per issue and project: rounds seen, first and last, and the records in order of round and id."""
    return df.groupBy("issue_id", "project_id").agg(F.countDistinct("review_round").alias("rounds"), F.min("review_round").alias("first_round"), F.max("review_round").alias("last_round"), F.count("*").alias("events"))


def relationship_snapshot(df: DataFrame) -> DataFrame:
    """One row that is equal for two data sets with equal relations, however they are ordered."""
    row = F.xxhash64("comment_id", "response_id", "link_status", "issue_id").cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(row).alias("digest"))


def occurrences(df: DataFrame) -> DataFrame:
    """Source occurrences of records with the provenance of their round."""
    found = provenance(("reviewed_round", F.col("review_round").cast("string"), 0.95), ("issue", F.col("issue_id"), 0.5))
    return df.select(stable_id("SO", F.col("comment_id"), F.col("city"), F.lit("comment")).alias("occurrence_id"), "comment_id", found.alias("round")).select("occurrence_id", "comment_id", F.col("round.value").alias("round_value"), F.col("round.source").alias("round_source"))


def _batches(records_most: int, characters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, batch_no, n, total = object(), 0, 0, 0
        for batch in batches:
            out = []
            for g, size in zip(batch.column("group").to_pylist(), batch.column("size").to_pylist()):
                if g != group:
                    group, batch_no, n, total = g, 0, 0, 0
                elif n and (n >= records_most or total + size > characters):
                    batch_no, n, total = batch_no + 1, 0, 0
                n, total = n + 1, total + size
                out.append(batch_no)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "batch"])

    return run


def evidence_batches(df: DataFrame, group: str, order: str, size: Column, records_most: int = 6, characters: int = 24_000) -> DataFrame:
    """Greedy packets of a group's records in order: so many records and characters at most, a long record alone.

    Groups are read as a stream in order, so none is held in memory.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(group).alias("group"), F.col(order).alias("id"), size.cast("long").alias("size"))
    sort = rows.repartition(parts, "group").sortWithinPartitions("group", "id")
    return sort.mapInArrow(_batches(records_most, characters), f"group {rows.schema['group'].dataType.simpleString()}, id long, size long, batch long")


def top_evidence(df: DataFrame, per_project: int = 2, most: int = 5) -> DataFrame:
    """The strongest records, few of one project: a rank in each project, then a limit."""
    level = C.evidence_level(F.when(F.col("link_status") == "confirmed", F.col("text")), F.lit(None).cast("string"))
    ranked = df.withColumn("level", level).withColumn("n", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("level"), "comment_id")))
    return ranked.where(F.col("n") <= per_project).orderBy(F.desc("level"), "comment_id").limit(most).select("comment_id", "project_id", "level")


def citations(ids: DataFrame, sources: DataFrame, most: int = 5) -> DataFrame:
    """The first source of each of the first records."""
    first = ids.orderBy("comment_id").limit(most)
    one = sources.groupBy("comment_id").agg(F.min("source_id").alias("source_id"))
    return first.join(one, "comment_id")


def response_patterns(df: DataFrame, top: int = 5) -> DataFrame:
    """Classes of action with the events and projects that support them."""
    found = df.groupBy(C.response_pattern(F.col("response")).alias("title")).agg(F.countDistinct("event").alias("events"), F.countDistinct("project").alias("projects"))
    return found.withColumn("support_level", C.support_level(F.col("projects"), F.col("events"))).orderBy(F.desc("events"), "title").limit(top)


def review_queue(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def estimate(rows: Column) -> Column:
    """Closed-form token and time estimate of a spreadsheet's intake."""
    return F.struct(F.greatest(F.lit(4000), 2500 + 500 * rows).alias("tokens"), F.greatest(F.lit(30.0), 18 + 1.4 * rows).alias("seconds"))


def confirm_tags(suggested: DataFrame, verified: DataFrame) -> DataFrame:
    """Suggested tags, confirmed where the second look accepts or corrects with enough confidence; tags stay on the allowed list."""
    fine = F.col("decision").isin("accept", "correct") & (F.col("confidence") >= 0.70)
    return suggested.join(verified, "record").withColumn("status", F.when(fine, "confirmed").otherwise("suggested"))


def grouped_notes(df: DataFrame) -> DataFrame:
    """A broad note answers the unmatched records of its group that share a word of note with it."""
    notes = df.where("broad").select("grp", F.col("id").alias("note"), F.explode(F.array_distinct("topics")).alias("topic"))
    open_ = df.where("not broad and response is null").select("grp", "id", F.explode(F.array_distinct("topics")).alias("topic"))
    return open_.join(notes, ["grp", "topic"]).groupBy("grp", "id").agg(F.min("note").alias("note"))


def propagate_city(df: DataFrame, least: float = 0.82) -> DataFrame:
    """The one strongly inferred city of a site goes to its files without one."""
    strong = F.when(F.col("confidence") >= least, F.col("city"))
    per = df.groupBy("site").agg(F.count_distinct(strong).alias("n"), F.min(strong).alias("one"))
    return df.join(per, "site").withColumn("city", F.when(F.col("confidence") >= least, F.col("city")).when(F.col("n") == 1, F.col("one")).otherwise(F.col("city"))).drop("n", "one")


def classify_pages(chars: Column, images: Column, markers: Column) -> Column:
    """What a page is: comments, text, drawing or blank."""
    return F.when(markers >= 2, "comment_page").when((chars < 120) & (images > 0), "drawing_page").when(chars < 20, "blank_page").otherwise("text_page")


def drawing_heavy(pages: DataFrame, key: str, chars: str) -> DataFrame:
    """Documents most of whose pages have little text."""
    share = F.avg((F.col(chars) < 120).cast("int"))
    return pages.groupBy(key).agg(F.round(share, 4).alias("low_share"), F.median(chars).alias("median_chars")).withColumn("drawing_heavy", (F.col("low_share") >= 0.7) | (F.col("median_chars") < 120))


def _packets(s, d):
    found = evidence_batches(records(s, d), "project_id", "comment_id", F.length("text"))
    return found.groupBy(F.col("group").alias("project_id")).agg(F.count_distinct("batch").alias("batches"), F.max("size").alias("longest"))


def _responses(s, d):
    chats = table(s, d, "conversations").where("role = 'assistant'")
    return response_patterns(chats.select(F.col("text").alias("response"), F.concat_ws("-", "conv_id", "turn").alias("event"), (F.col("conv_id") % 7).alias("project")))


def _response_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(lower(text), '{w}') THEN '{n}'" for n, w in C.RESPONSE_RULES)
    return f"""WITH p AS (SELECT CASE {cases} ELSE '{C.OTHER_RESPONSE}' END AS title, conv_id || '-' || turn AS event, conv_id % 7 AS project FROM conversations WHERE role = 'assistant'),
    g AS (SELECT title, count(DISTINCT event) AS events, count(DISTINCT project) AS projects FROM p GROUP BY title)
    SELECT *, CASE WHEN projects > 1 THEN 'cross_project' WHEN events > 1 AND projects > 0 THEN 'single_project' WHEN events > 1 THEN 'multiple_records' ELSE 'single_record' END AS support_level FROM g ORDER BY events DESC, title LIMIT 5"""


QUERIES = {
    "canonical_events": (
        lambda s, d: canonical_events(records(s, d)).drop("canonical_event_id"),
        sql("SELECT min(comment_id) AS canonical_comment_id, count(*) AS occurrences, min(review_round) AS first_round, max(review_round) AS last_round, count(*) FILTER (trust = 'verified') AS verified FROM records GROUP BY city, project_id, review_round, lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"),
    ),
    "timelines": (
        lambda s, d: timelines(records(s, d)),
        sql("SELECT issue_id, project_id, count(DISTINCT review_round) AS rounds, min(review_round) AS first_round, max(review_round) AS last_round, count(*) AS events FROM records GROUP BY ALL"),
    ),
    "occurrences": (
        lambda s, d: occurrences(records(s, d)),
        sql("SELECT 'SO-' || substr(sha256(comment_id || '|' || city || '|comment'), 1, 20) AS occurrence_id, comment_id, CAST(review_round AS VARCHAR) AS round_value, 'reviewed_round' AS round_source FROM records"),
    ),
    "evidence_packets": (_packets, None),
    "top_evidence": (
        lambda s, d: top_evidence(records(s, d)),
        sql(
            "SELECT comment_id, project_id, level FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY level DESC, comment_id) AS n FROM l) WHERE n <= 2 ORDER BY level DESC, comment_id LIMIT 5",
            f"l AS (SELECT *, CASE WHEN link_status <> 'confirmed' OR trim(text) = '' THEN 1 WHEN regexp_matches(lower(text), '{C.CONCRETE}') THEN 3 ELSE 2 END AS level FROM records)",
        ),
    ),
    "response_patterns": (_responses, _response_sql()),
    "review_queue": (
        lambda s, d: review_queue(records(s, d), "link_status"),
        sql("SELECT link_status, count(*) AS n FROM records GROUP BY 1"),
    ),
    "intake_estimate": (
        lambda s, d: records(s, d).groupBy("project_id").agg(F.count("*").alias("n")).select("project_id", estimate(F.col("n")).alias("e")).select("project_id", F.col("e.tokens").alias("tokens"), F.round("e.seconds", 4).alias("seconds")),
        sql("SELECT project_id, greatest(4000, 2500 + 500 * count(*)) AS tokens, round(greatest(30.0, 18 + 1.4 * count(*)), 4) AS seconds FROM records GROUP BY project_id"),
    ),
    "confirmed_tags": (
        lambda s, d: confirm_tags(table(s, d, "events").select(F.col("event_id").alias("record"), "event_type"), table(s, d, "events").select(F.col("event_id").alias("record"), F.when(F.col("user_id") % 2 == 0, "accept").otherwise("reject").alias("decision"), (F.col("value") / 100).alias("confidence"))).groupBy("event_type", "status").agg(F.count("*").alias("n")),
        "SELECT event_type, CASE WHEN user_id % 2 = 0 AND value / 100 >= 0.70 THEN 'confirmed' ELSE 'suggested' END AS status, count(*) AS n FROM events GROUP BY 1, 2",
    ),
    "propagated_cities": (
        lambda s, d: propagate_city(table(s, d, "supplier").select(F.col("s_suppkey").alias("file"), F.col("s_nationkey").alias("site"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("city"), F.col("s_nationkey") % 4)).alias("city"), F.when(F.col("s_suppkey") % 3 == 0, 0.9).otherwise(0.1).alias("confidence"))).select("file", "site", "city"),
        """WITH f AS (SELECT s_suppkey AS file, s_nationkey AS site, CASE WHEN s_suppkey % 3 = 0 THEN 'city' || (s_nationkey % 4) END AS city FROM supplier)
        SELECT file, site, CASE WHEN city IS NOT NULL THEN city WHEN count(DISTINCT city) OVER (PARTITION BY site) = 1 THEN min(city) OVER (PARTITION BY site) END AS city FROM f""",
    ),
    "drawing_heavy": (
        lambda s, d: drawing_heavy(table(s, d, "documents"), "source", "n_chars"),
        "SELECT source, round(avg(CASE WHEN n_chars < 120 THEN 1 ELSE 0 END), 4) AS low_share, median(n_chars) AS median_chars, round(avg(CASE WHEN n_chars < 120 THEN 1 ELSE 0 END), 4) >= 0.7 OR median(n_chars) < 120 AS drawing_heavy FROM documents GROUP BY source",
    ),
}
