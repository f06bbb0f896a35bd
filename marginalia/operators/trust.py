"""Trust gates: which records may be searched, counted or cited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import collapse
from marginalia.plans.records import records, sql

# Whole texts that are no issue.
BOILERPLATE = ["noted", "noted.", "no changes, comment remains", "this comment to remain open until all other comments are resolved", "please see comments at special inspection and testing form"]


def is_reference_note(c: Column) -> Column:
    t = F.lower(collapse(F.coalesce(c, F.lit(""))))
    has = lambda s: F.contains(t, F.lit(s))
    directory = has("building dept reviewers") & (has("please contact reviewers") | has("office phone"))
    reference = has("for reference use only") & (has("don't copy") | has("do not copy"))
    fee = has("plan check fee") & (has("official notification") | ((has("permit payment") | has("payment option")) & has("permit specialist")))
    return directory | reference | fee


def is_malformed_rollup(text: Column, source: Column) -> Column:
    """Rounds run together in a response letter's one cell."""
    t = F.lower(collapse(F.coalesce(text, F.lit(""))))
    return t.rlike("^a\\.?\\s*pc\\s*1\\b") & F.contains(F.lower(F.coalesce(source, F.lit(""))), F.lit("response")) & (F.regexp_count(t, F.lit("\\bpc\\s*[2-9]\\s*:")) >= 2)


def is_general_review_text(c: Column) -> Column:
    t = F.regexp_replace(F.lower(collapse(F.coalesce(c, F.lit("")))), "^[ \\-*_:]+|[ \\-*_:]+$", "")
    bare = F.regexp_replace(t, "\\.$", "")
    reserved = F.contains(t, F.lit("planning reserves the right to provide additional comments")) & (F.length(t) < 260)
    limited = F.contains(t, F.lit("building division review is limited to general compliance")) & F.contains(t, F.lit("not be construed as a comprehensive plan check"))
    return (t == "") | t.isin(BOILERPLATE) | bare.isin(BOILERPLATE) | reserved | limited


def searchable(df: DataFrame) -> DataFrame:
    """Records that may be searched: not quarantined; rematched and two-pass ones only when verified or confirmed."""
    return df.where((F.col("trust") != "quarantined") & ~is_malformed_rollup(F.col("text"), F.col("city")) & ~is_reference_note(F.col("text")))


def chat_eligible(df: DataFrame) -> DataFrame:
    """The stricter gate of answers: verified text, and a link that isn't waiting for review."""
    return df.where((F.col("trust") == "verified") & (F.col("link_status") != "needs_review"))


def confirmation_gate(df: DataFrame) -> DataFrame:
    """All checks of a record, and whether all of them hold."""
    checks = {"has_text": F.length(F.trim("text")) > 0, "has_city": F.col("city").isNotNull(), "trusted": F.col("trust") == "verified", "has_round": F.col("review_round").isNotNull(), "has_project": F.col("project_id").isNotNull(), "link_settled": F.col("link_status").isin("confirmed", "unmatched"), "has_issue": F.col("issue_id").isNotNull()}
    whole = F.struct(*[c.alias(n) for n, c in checks.items()])
    passed = F.aggregate(F.array(*checks.values()), F.lit(True), lambda a, x: a & x)
    return df.withColumn("checks", whole).withColumn("confirmed", passed)


def matches_filters(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Equality without case on the allowed keys; response_status is confirmed, missing or unconfirmed."""
    allowed = {"city", "discipline", "project_id", "review_round", "issue_id", "trust"}
    for key, value in filters.items():
        if key == "response_status":
            status = F.when(F.col("link_status") == "confirmed", "confirmed").when(F.col("response_id").isNull(), "missing").otherwise("unconfirmed")
            df = df.where(status == value)
        elif key in allowed:
            df = df.where(F.lower(F.col(key).cast("string")) == value.lower())
        else:
            raise ValueError(f"filter {key!r} is not allowed")
    return df


QUERIES = {
    "searchable_records": (
        lambda s, d: searchable(records(s, d)).select("comment_id", "city", "trust"),
        sql("SELECT comment_id, city, trust FROM records WHERE trust <> 'quarantined'"),
    ),
    "confirmation_gate": (
        lambda s, d: confirmation_gate(records(s, d)).groupBy("city", "confirmed").agg(F.count("*").alias("n")),
        sql("SELECT city, trust = 'verified' AND link_status IN ('confirmed', 'unmatched') AND length(trim(text)) > 0 AS confirmed, count(*) AS n FROM records GROUP BY 1, 2"),
    ),
    "filtered_records": (
        lambda s, d: matches_filters(chat_eligible(records(s, d)), {"discipline": "EN", "response_status": "confirmed"}).select("comment_id", "project_id"),
        sql("SELECT comment_id, project_id FROM records WHERE trust = 'verified' AND lower(discipline) = 'en' AND link_status = 'confirmed'"),
    ),
    "general_texts": (
        lambda s, d: records(s, d).select("comment_id", is_general_review_text(F.col("text")).alias("general"), is_malformed_rollup(F.col("text"), F.col("city")).alias("rollup")),
        sql("SELECT comment_id, trim(text) = '' AS general, false AS rollup FROM records"),
    ),
}
