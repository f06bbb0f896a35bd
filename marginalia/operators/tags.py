"""The index of confirmed tags, coverage, and retrieval in stages: exact tag, related tags, all verified records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import keys as K
from marginalia.functions import relevance as R
from marginalia.plans.records import RECORDS, complete, records, sql_over
from marginalia.storage import cut

_COLUMNS = {
    "canonical_event_id": "string", "canonical_comment_id": "string", "issue_timeline_id": "string", "canonical_issue_id": "string", "issue_thread_id": "string", "project_id": "string", "property_project": "string", "site_id": "string",
    "city": "string", "discipline": "string", "review_round": "string", "category": "string", "text": "string", "verification_status": "string", "search_eligible": "boolean", "duplicate_of": "string", "text_trust_status": "string", "verification_conflict": "boolean",
    "event_tags": "array<string>", "issue_tags": "array<string>", "event_tag_status": "string", "issue_tag_status": "string", "tag_status": "string", "response_id": "string", "match_status": "string", "event_type": "string", "source_document": "string",
}


def is_verified() -> Column:
    """Explicit failures keep a record out; a record without any sign is taken as it was before there were signs."""
    low = lambda c: F.lower(F.trim(K.blank(F.col(c))))
    return (
        low("verification_status").isin("", "confirmed") & F.coalesce(F.col("search_eligible"), F.lit(True)) & (low("duplicate_of") == "")
        & ~low("text_trust_status").isin("needs_review", "rejected", "unverified") & ~F.coalesce(F.col("verification_conflict"), F.lit(False))
    )


def described(df: DataFrame) -> DataFrame:
    """The verified records with event, issue and project names and their tags."""
    d = complete(df, **_COLUMNS)
    c = lambda *names: K.given(*[F.col(n) for n in names])
    tags = R.infer_tags(F.col("text"), F.col("discipline"), F.col("event_tags"), F.col("issue_tags"), F.col("event_tag_status"), F.col("issue_tag_status"), F.col("tag_status"))
    d = d.where(is_verified()).withColumns({"event": K.given(F.col("canonical_event_id"), F.col("canonical_comment_id"), F.col("comment_id").cast("string")), "issue": c("issue_timeline_id", "canonical_issue_id", "issue_thread_id"), "project": c("project_id", "property_project", "site_id"), "tags": tags})
    return d.where("event <> ''")


def tag_entries(rows: DataFrame) -> DataFrame:
    """(tag, target_type, target_id): issues by their issue tags, events by their event tags."""
    issues = rows.select(F.explode("tags.issue_tags").alias("tag"), F.lit("issue_timeline").alias("target_type"), F.when(F.col("issue") != "", F.col("issue")).otherwise(F.col("event")).alias("target_id"))
    events = rows.select(F.explode("tags.event_tags").alias("tag"), F.lit("canonical_event").alias("target_type"), F.col("event").alias("target_id"))
    return issues.unionByName(events).distinct()


def tag_rows(rows: DataFrame) -> DataFrame:
    """(tag, event): the inverted index."""
    return rows.select(F.explode(F.array_distinct(F.concat("tags.event_tags", "tags.issue_tags"))).alias("tag"), "event").distinct()


def index_digest(rows: DataFrame) -> DataFrame:
    """Events and a digest of all their tags, whatever their order."""
    line = F.concat_ws("|", "event", F.array_join("tags.event_tags", ","), F.array_join("tags.issue_tags", ","))
    return rows.select("event", line.alias("line")).distinct().agg(F.count_distinct("event").alias("events"), F.sum(F.xxhash64("line").cast("decimal(38,0)")).alias("digest"))


def one_per_event(rows: DataFrame) -> DataFrame:
    """The first record of each event, with the number of its source occurrences."""
    n = F.count("*").alias("occurrences")
    best = rows.groupBy("event").agg(F.min("comment_id").alias("__id"), n)
    return rows.join(best.withColumnRenamed("event", "__event"), (F.col("event") == F.col("__event")) & (F.col("comment_id") == F.col("__id"))).drop("__event", "__id").dropDuplicates(["event"])


def coverage(rows: DataFrame) -> DataFrame:
    """One row of counts: what a set of events covers."""
    distinct = lambda c: F.count_distinct(F.when(F.col(c) != "", F.col(c)))
    low = lambda c: F.lower(K.blank(F.col(c)))
    answered = (K.blank(F.col("response_id")) != "") & low("match_status").isin("confirmed", "matched")
    some = rows.agg(
        F.count_distinct("event").alias("event_count"), distinct("issue").alias("issues"), distinct("project").alias("project_count"), F.count_distinct(F.when(K.blank(F.col("city")) != "", F.col("city"))).alias("city_count"),
        F.count_distinct(F.concat_ws("|", "project", K.blank(F.col("review_round")))).alias("review_round_count"), F.coalesce(F.sum(answered.cast("long")), F.lit(0)).alias("confirmed_response_count"),
        F.coalesce(F.sum(low("event_type").isin("", "government_comment", "comment").cast("long")), F.lit(0)).alias("government_comment_count"),
    )
    issues = F.when(F.col("issues") > 0, F.col("issues")).otherwise(F.col("event_count"))
    return some.select("event_count", issues.alias("issue_count"), "project_count", "city_count", "review_round_count", issues.alias("timeline_count"), "confirmed_response_count", "government_comment_count")


def covered_enough(intent: str, c: dict) -> bool:
    """Whether a stage's coverage is enough for what is asked."""
    intent = (intent or "").casefold()
    if intent in ("compare_groups", "comparison", "compare"):
        return c["project_count"] >= 2
    if intent in ("historical_response_summary", "how_handled", "response_analysis"):
        return c["event_count"] >= 1 and c["confirmed_response_count"] >= 1
    if intent in ("topic_summary", "summary", "analysis"):
        return c["issue_count"] >= 2 or (c["event_count"] >= 3 and c["project_count"] >= 2)
    return c["event_count"] >= (2 if intent in ("timeline", "timeline_analysis") else 1)


def retrieve(df: DataFrame, query: str, intent: str = "precedent_search", filters: dict[str, str] | None = None, everything: bool = False) -> DataFrame:
    """Events for a question: comment_id, event, stage, keyword_score, matched_tags, relevant, excluded reason, suggested_tag.

    Stage 1 takes events that carry the topic's tag, stage 2 also those of
    related tags, stage 3 all verified records in scope; a stage is used if its
    coverage (one small row) is enough for the intent.  Every stage passes the
    topic's gate; what fails it is returned with the reason.
    """
    rows = described(df)
    scope = {"city": F.col("city"), "site_id": F.col("site_id"), "project_id": F.col("project"), "discipline": F.col("discipline"), "review_round": F.col("review_round"), "category": F.col("category")}
    for key, value in (filters or {}).items():
        if (value or "").strip():
            rows = rows.where(F.lower(F.trim(K.blank(scope[key]))) == value.casefold().strip())
    rows, topic = cut(rows, "verified"), R.topic_from_query(query)
    every = one_per_event(rows)
    tags, stage, found = F.array_distinct(F.concat("tags.event_tags", "tags.issue_tags")), 3, None
    if topic and not everything:
        carries = F.array_contains(tags, topic)
        related = F.array(*map(F.lit, R.TAG_GRAPH.get(topic) or [""]))
        for k, condition in ((1, carries), (2, carries | F.arrays_overlap(tags, related))):
            chosen = cut(one_per_event(rows.where(condition)), "stage")
            if covered_enough(intent, coverage(chosen).first().asDict()):
                stage, found = k, chosen
                break
    found = found if found is not None else every
    gate = R.topic_relevance(query, F.concat_ws(" ", F.col("text"), F.col("discipline")), topic)
    words = sorted(set(re.findall("[a-z0-9]+(?:[-/][a-z0-9]+)?", query.casefold())))
    score = F.size(F.array_intersect(F.array(*map(F.lit, words)), F.regexp_extract_all(F.lower(F.concat_ws(" ", F.col("text"), F.col("discipline"))), F.lit("[a-z0-9]+(?:[-/][a-z0-9]+)?"), F.lit(0))))
    wanted = F.array(*map(F.lit, [topic or "", *(R.TAG_GRAPH.get(topic, []) if stage == 2 else [])]))
    matched = F.array_sort(F.array_intersect(tags, wanted)) if stage < 3 else F.array().cast("array<string>")
    out = found.withColumn("gate", gate)
    keep = F.col("gate.is_relevant") if topic else F.lit(True)
    suggested = F.when(keep & F.lit(stage == 3 and topic is not None) & ~F.array_contains(tags, topic or ""), F.lit(topic or ""))
    return out.select("comment_id", "event", F.lit(stage).alias("stage"), score.alias("keyword_score"), matched.alias("matched_tags"), keep.alias("relevant"), F.when(~keep, F.col("gate.exclude_reason")).alias("exclude_reason"), suggested.alias("suggested_tag"))


def add_confirmed(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """Records with their tags and those that a person confirmed for them (comment_id, tag, status)."""
    yes = decisions.where("status = 'confirmed'").groupBy("comment_id").agg(F.array_sort(F.collect_set("tag")).alias("__more"))  # tags of one record
    d = complete(df, event_tags="array<string>").join(yes, "comment_id", "left")
    none = F.array().cast("array<string>")
    return d.withColumn("event_tags", F.array_sort(F.array_union(F.coalesce("event_tags", none), F.coalesce("__more", none)))).drop("__more")


def _tagged(s, d) -> DataFrame:
    r = records(s, d)
    i = F.col("comment_id")
    topics = F.element_at(F.array(*map(F.lit, ["Tree Protection", "drainage", "root protection", "grading"])), (i % 4 + 1).cast("int"))
    return r.select("comment_id", "city", "discipline", "project_id", F.col("issue_id").alias("issue_thread_id"), F.col("review_round").cast("string").alias("review_round"), "text", "response_id", F.col("link_status").alias("match_status"), F.when(F.col("trust") == "quarantined", "rejected").alias("text_trust_status"), F.when(i % 3 != 2, F.array(topics)).alias("event_tags"), F.when(i % 7 == 0, "pending").alias("event_tag_status"), F.array(F.lit("none")).alias("issue_tags"))


_TAGGED = """
tagged AS (SELECT comment_id, city, project_id, issue_id, review_round, response_id, link_status,
  CASE WHEN comment_id % 3 <> 2 AND comment_id % 7 <> 0 THEN ['tree_protection', 'drainage', 'root_protection', 'grading'][comment_id % 4 + 1] END AS tag
  FROM records WHERE trust <> 'quarantined')
"""

QUERIES = {
    "tag_entries": (
        lambda s, d: tag_entries(described(_tagged(s, d))).groupBy("tag", "target_type").agg(F.count("*").alias("targets")),
        sql_over(RECORDS, "SELECT tag, 'canonical_event' AS target_type, count(*) AS targets FROM tagged WHERE tag IS NOT NULL GROUP BY 1 UNION ALL SELECT 'none', 'issue_timeline', count(DISTINCT issue_id) FROM tagged", _TAGGED),
    ),
    "tag_coverage": (
        lambda s, d: coverage(described(_tagged(s, d))),
        sql_over(
            RECORDS,
            "SELECT count(*) AS event_count, count(DISTINCT issue_id) AS issue_count, count(DISTINCT project_id) AS project_count, count(DISTINCT city) AS city_count, count(DISTINCT project_id || '|' || review_round) AS review_round_count, count(DISTINCT issue_id) AS timeline_count, "
            "CAST(count(*) FILTER (response_id IS NOT NULL AND link_status = 'confirmed') AS BIGINT) AS confirmed_response_count, count(*) AS government_comment_count FROM tagged",
            _TAGGED,
        ),
    ),
    "staged_tags": (
        lambda s, d: retrieve(_tagged(s, d), "how was drainage handled", "compare").select("comment_id", "stage", "matched_tags", "relevant"),
        sql_over(RECORDS, "SELECT t.comment_id, 1 AS stage, ['drainage'] AS matched_tags, regexp_matches(lower(r.text || ' ' || r.discipline), 'drain|runoff|stormwater|swale|infiltration|detention|downspout|discharge|grading') AS relevant FROM tagged t JOIN records r USING (comment_id) WHERE tag = 'drainage'", _TAGGED),
    ),
}
