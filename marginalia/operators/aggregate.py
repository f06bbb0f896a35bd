"""Counts, breakdowns, coverage and latency figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.functions.taxonomy import classify_topic
from marginalia.operators.textops import TOPIC_CASE
from marginalia.plans.records import records, sql, table

TOP = 12


def response_status() -> Column:
    return F.when(F.col("link_status") == "confirmed", "confirmed").when(F.col("response_id").isNotNull(), "unconfirmed").otherwise("missing")


def overview(df: DataFrame) -> DataFrame:
    """Per city: comments, distinct texts, projects, (project, round) cycles, trusted ones, confirmed responses."""
    plain = F.lower(X.collapse(F.col("text")))
    return df.groupBy("city").agg(
        F.count("*").alias("comments"), F.countDistinct(F.sha2(plain, 256)).alias("distinct_texts"), F.countDistinct("project_id").alias("projects"),
        F.countDistinct("project_id", "review_round").alias("cycles"), F.sum((F.col("trust") == "verified").cast("long")).alias("verified"),
        F.sum((F.col("link_status") == "confirmed").cast("long")).alias("confirmed_responses"),
    )


def metrics(df: DataFrame) -> DataFrame:
    """The figures of an answer, in one pass."""
    status = response_status()
    of = lambda v: F.sum((status == v).cast("long"))
    return df.agg(
        F.countDistinct("comment_id").alias("parent_comments"), F.countDistinct("project_id").alias("projects"), F.countDistinct("project_id", "review_round").alias("review_rounds"),
        of("confirmed").alias("confirmed_responses"), of("missing").alias("missing_responses"), of("unconfirmed").alias("unconfirmed_responses"), F.countDistinct("issue_id").alias("canonical_issues"),
    )


def breakdowns(df: DataFrame, top: int = TOP) -> DataFrame:
    """(kind, key, n, place): the most frequent values of each grouping, ties by key without case.

    All groupings come from one pass over exploded (kind, key) pairs, summed
    where they are read.
    """
    kinds = {"city": F.col("city"), "discipline": F.col("discipline"), "project": F.col("project_id"), "review_round": F.col("review_round").cast("string"), "response_status": response_status(), "canonical_issue": F.col("issue_id")}
    single = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(c, F.lit("unknown")).alias("key")) for k, c in kinds.items()])
    codes = F.transform(X.code_sections(F.col("text")), lambda c: F.struct(F.lit("code_section").alias("kind"), c.alias("key")))
    pairs = df.select(F.explode(F.concat(single, codes)).alias("p")).select("p.kind", "p.key").groupBy("kind", "key").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), F.lower("key"), "key"))
    return pairs.withColumn("place", place).where(F.col("place") <= top)


def coverage(df: DataFrame) -> DataFrame:
    """How much of the corpus a result covers; no issues counts as one for each event."""
    events = F.countDistinct("comment_id")
    issues = F.countDistinct("issue_id")
    return df.agg(events.alias("events"), F.when(issues == 0, events).otherwise(issues).alias("issues"), F.countDistinct("project_id").alias("projects"), F.countDistinct("city").alias("cities"), F.countDistinct("review_round").alias("rounds"))


def dedupe_rows(df: DataFrame) -> DataFrame:
    """One row per issue: the first record stands for it, its records are its occurrences."""
    return df.groupBy("issue_id").agg(F.min_by("project_id", "comment_id").alias("project_id"), F.min("comment_id").alias("first_comment"), F.greatest(F.count("*"), F.lit(1)).alias("occurrences"), F.countDistinct("city").alias("cities"))


def topics(df: DataFrame) -> DataFrame:
    """Topics with two projects or more, after one record (the first) per issue and project."""
    first = df.groupBy("issue_id", "project_id").agg(F.min_by(F.struct("text", "discipline"), "comment_id").alias("r"))
    t = first.withColumn("t", classify_topic(F.col("r.text"), F.col("r.discipline"))).select("t.*", "project_id", "issue_id")
    found = t.groupBy("topic_id", "parent", "aspect").agg(F.count("*").alias("threads"), F.countDistinct("project_id").alias("projects"), F.countDistinct("issue_id").alias("issues"))
    return found.where("projects >= 2")


def quantiles(df: DataFrame, key: str, value: str, fractions: dict[str, float], between: bool = True) -> DataFrame:
    """Per key the values at the fractions: linear between neighbours, or the one at the nearest rank (half to even).

    Equal values are counted where they are read; a running sum over the distinct
    ones finds the ranks, so nothing is held but a key's sorted stream.
    """
    counts = df.groupBy(key, value).agg(F.count("*").alias("c"))
    total = counts.groupBy(key).agg(F.sum("c").alias("n"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("upto", upto).join(total, key)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col(value)))
    sums = []
    for name, f in fractions.items():
        place = (F.col("n") - 1) * F.lit(float(f))
        sums += [at(F.floor(place)).alias(f"{name}_a"), at(F.ceil(place)).alias(f"{name}_b")] if between else [at(F.bround(place)).alias(f"{name}_a")]
    got = ranked.groupBy(key, "n").agg(*sums)
    share = lambda f: (F.col("n") - 1) * F.lit(float(f)) - F.floor((F.col("n") - 1) * F.lit(float(f)))
    one = lambda name, f: F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * share(f) if between else F.col(f"{name}_a")
    return got.select(key, F.col("n").alias("samples"), *[one(n, f).alias(n) for n, f in fractions.items()])


def latency_by(df: DataFrame, stage: str, value: str) -> DataFrame:
    """Samples, median, 95th percentile (linear interpolation, finite values only) and maximum."""
    fine = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    found = quantiles(fine, stage, value, {"p50": 0.5, "p95": 0.95, "max_value": 1.0})
    return found.select(stage, "samples", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "max_value")])


def straggler_reasons(df: DataFrame, value: str, first: float, total: float) -> DataFrame:
    """Requests with the reasons why they count as stragglers."""
    reasons = F.array_compact(F.array(F.when(F.col(value) >= first, "long_first_token"), F.when(F.col(value) >= total, "long_total_latency"), F.when(F.col("event_type") == "error", "retried")))
    return df.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def missing_fields(df: DataFrame) -> DataFrame:
    """Per field, how many records lack it."""
    sums = [F.sum((F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("long")).alias(c) for c in df.columns]
    one = df.agg(*sums)
    return one.select(F.expr("stack(" + str(len(df.columns)) + ", " + ", ".join(f"'{c}', `{c}`" for c in df.columns) + ") AS (field, missing)"))


def integrity(df: DataFrame) -> DataFrame:
    """Violations: repeated comment ids, responses without link, links without response."""
    twice = df.groupBy("comment_id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_comment_id").alias("rule"), "n")
    loose = df.where("response_id is null and link_status <> 'unmatched'").agg(F.count("*").alias("n")).select(F.lit("link_without_response").alias("rule"), "n")
    lost = df.where("response_id is not null and link_status = 'unmatched'").agg(F.count("*").alias("n")).select(F.lit("response_without_link").alias("rule"), "n")
    return twice.unionByName(loose).unionByName(lost)


def round_summary(df: DataFrame) -> DataFrame:
    """Per (city, project, round): records by kind, and the primary one: verified first, then with a response, then the first."""
    score = F.struct((F.col("trust") == "verified").cast("int"), F.col("response_id").isNotNull().cast("int"), -F.col("comment_id"))
    return df.groupBy("city", "project_id", "review_round").agg(F.count("*").alias("records"), F.sum((F.col("trust") == "verified").cast("long")).alias("verified"), F.sum(F.col("response_id").isNotNull().cast("long")).alias("with_response"), F.max_by("comment_id", score).alias("primary_comment"))


_STATUS = "CASE WHEN link_status = 'confirmed' THEN 'confirmed' WHEN response_id IS NOT NULL THEN 'unconfirmed' ELSE 'missing' END"
_SPACES = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"

QUERIES = {
    "overview": (
        lambda s, d: overview(records(s, d)),
        sql(f"SELECT city, count(*) AS comments, count(DISTINCT sha256(lower({_SPACES}))) AS distinct_texts, count(DISTINCT project_id) AS projects, count(DISTINCT project_id || '#' || review_round) AS cycles, CAST(sum(CASE WHEN trust = 'verified' THEN 1 ELSE 0 END) AS BIGINT) AS verified, CAST(sum(CASE WHEN link_status = 'confirmed' THEN 1 ELSE 0 END) AS BIGINT) AS confirmed_responses FROM records GROUP BY city"),
    ),
    "metrics": (
        lambda s, d: metrics(records(s, d)),
        sql(f"SELECT count(DISTINCT comment_id) AS parent_comments, count(DISTINCT project_id) AS projects, count(DISTINCT project_id || '#' || review_round) AS review_rounds, count(*) FILTER ({_STATUS} = 'confirmed') AS confirmed_responses, count(*) FILTER ({_STATUS} = 'missing') AS missing_responses, count(*) FILTER ({_STATUS} = 'unconfirmed') AS unconfirmed_responses, count(DISTINCT issue_id) AS canonical_issues FROM records"),
    ),
    "breakdowns": (
        lambda s, d: breakdowns(records(s, d)),
        sql(
            "SELECT kind, key, n, place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, lower(key), key) AS place FROM (SELECT kind, key, count(*) AS n FROM pairs GROUP BY kind, key)) WHERE place <= 12",
            f"pairs AS (SELECT 'city' AS kind, city AS key FROM records UNION ALL SELECT 'discipline', discipline FROM records UNION ALL SELECT 'project', project_id FROM records UNION ALL SELECT 'review_round', CAST(review_round AS VARCHAR) FROM records UNION ALL SELECT 'response_status', {_STATUS} FROM records UNION ALL SELECT 'canonical_issue', issue_id FROM records UNION ALL SELECT 'code_section', unnest(regexp_extract_all(text, '\\b[A-Z]{{2,6}}\\s+[A-Z]?\\d+(?:\\.\\d+)+\\b')) FROM records)",
        ),
    ),
    "coverage": (
        lambda s, d: coverage(records(s, d)),
        sql("SELECT count(DISTINCT comment_id) AS events, count(DISTINCT issue_id) AS issues, count(DISTINCT project_id) AS projects, count(DISTINCT city) AS cities, count(DISTINCT review_round) AS rounds FROM records"),
    ),
    "issue_rows": (
        lambda s, d: dedupe_rows(records(s, d)),
        sql("SELECT issue_id, arg_min(project_id, comment_id) AS project_id, min(comment_id) AS first_comment, count(*) AS occurrences, count(DISTINCT city) AS cities FROM records GROUP BY issue_id"),
    ),
    "latency_by_stage": (
        lambda s, d: latency_by(table(s, d, "events"), "event_type", "value"),
        "SELECT event_type, count(*) AS samples, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(max(value), 4) AS max_value FROM events WHERE value IS NOT NULL GROUP BY event_type",
    ),
    "missing_fields": (
        lambda s, d: missing_fields(records(s, d).select("comment_id", "city", "discipline", "response_id", "text")),
        sql("SELECT 'comment_id' AS field, count(*) FILTER (comment_id IS NULL) AS missing FROM records UNION ALL SELECT 'city', count(*) FILTER (city IS NULL) FROM records UNION ALL SELECT 'discipline', count(*) FILTER (discipline IS NULL) FROM records UNION ALL SELECT 'response_id', count(*) FILTER (response_id IS NULL) FROM records UNION ALL SELECT 'text', count(*) FILTER (text IS NULL OR trim(text) = '') FROM records"),
    ),
    "integrity": (
        lambda s, d: integrity(records(s, d)),
        sql("SELECT 'duplicate_comment_id' AS rule, count(*) AS n FROM (SELECT comment_id FROM records GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'link_without_response', count(*) FROM records WHERE response_id IS NULL AND link_status <> 'unmatched' UNION ALL SELECT 'response_without_link', count(*) FROM records WHERE response_id IS NOT NULL AND link_status = 'unmatched'"),
    ),
    "round_summary": (
        lambda s, d: round_summary(records(s, d)),
        sql("SELECT city, project_id, review_round, count(*) AS records, count(*) FILTER (trust = 'verified') AS verified, count(response_id) AS with_response, first(comment_id ORDER BY (trust = 'verified') DESC, (response_id IS NOT NULL) DESC, comment_id) AS primary_comment FROM records GROUP BY ALL"),
    ),
    "topic_counts": (
        lambda s, d: topics(records(s, d)).select("topic_id", "threads", "projects", "issues"),
        sql(
            "SELECT topic_id, count(*) AS threads, count(DISTINCT project_id) AS projects, count(DISTINCT issue_id) AS issues FROM c GROUP BY topic_id HAVING count(DISTINCT project_id) >= 2",
            "f AS (SELECT issue_id, project_id, arg_min(text, comment_id) AS text, arg_min(discipline, comment_id) AS discipline FROM records GROUP BY issue_id, project_id)",
            f"c AS (SELECT issue_id, project_id, {TOPIC_CASE} AS topic_id FROM (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS b, lower(trim(regexp_replace(discipline || ' ' || text, '\\s+', ' ', 'g'))) AS v FROM f))",
        ),
    ),
    "nearest_rank": (
        lambda s, d: quantiles(table(s, d, "events").where("value is not null"), "event_type", "value", {"p95": 0.95}, between=False).drop("samples"),
        "SELECT event_type, list_sort(list(value))[CAST(round_even((count(value) - 1) * 0.95, 0) AS BIGINT) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type",
    ),
}
