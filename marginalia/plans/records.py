"""Review records over the given tables.

documents are comments (source is the city, lang the discipline), labels say
what is trusted, every third comment has a response whose link is confirmed
unless its label says toxic.  Fields that the tables lack follow from doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = docs.join(labels, "doc_id", "left")
    i = F.col("doc_id")
    trust = F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "quarantined").otherwise("unverified")
    response = F.when(i % 3 == 0, F.concat(F.lit("R-"), i))
    link = F.when(i % 3 != 0, "unmatched").when(F.coalesce("toxic", F.lit(0)) == 1, "needs_review").otherwise("confirmed")
    return d.select(
        i.alias("comment_id"), F.col("source").alias("city"), F.col("lang").alias("discipline"), F.concat("source", F.lit("-P"), i % 7).alias("project_id"),
        (i % 4 + 1).alias("review_round"), F.concat(F.lit("T-"), i % 97).alias("issue_id"), F.col("text"), trust.alias("trust"), response.alias("response_id"), link.alias("link_status"),
    )


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ``records`` what their documents say alone: id, city and text, without the join to labels that would move every text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("comment_id"), F.col("source").alias("city"), "text")


#: The same as a common table expression.
RECORDS = """
records AS (
  SELECT d.doc_id AS comment_id, d.source AS city, d.lang AS discipline, d.source || '-P' || (d.doc_id % 7) AS project_id,
    d.doc_id % 4 + 1 AS review_round, 'T-' || (d.doc_id % 97) AS issue_id, d.text,
    CASE WHEN l.quality = 1 THEN 'verified' WHEN l.quality = 0 THEN 'quarantined' ELSE 'unverified' END AS trust,
    CASE WHEN d.doc_id % 3 = 0 THEN 'R-' || d.doc_id END AS response_id,
    CASE WHEN d.doc_id % 3 <> 0 THEN 'unmatched' WHEN coalesce(l.toxic, 0) = 1 THEN 'needs_review' ELSE 'confirmed' END AS link_status
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def sql(body: str, *more: str) -> str:
    return "WITH " + ", ".join([RECORDS.strip(), *more]) + "\n" + body


def complete(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with the named columns that it lacks, as nulls of the given types."""
    ship(df.sparkSession)  # before Python functions over the frame are made
    have = {c.lower() for c in df.columns}
    return df.withColumns({n: F.lit(None).cast(kind) for n, kind in columns.items() if n.lower() not in have})


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review comments as a collection of files has them: one per document, with places, dates and states that follow from doc_id."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d, i = docs.join(labels, "doc_id", "left"), F.col("doc_id")
    text = lambda c: c.cast("string")
    return d.select(
        i.alias("comment_id"), F.col("source").alias("city"), F.concat(F.lit("Project "), "source").alias("property_project"), F.lit("").alias("project_id"),
        F.concat(F.lit("comments&response/"), "source", F.lit("/"), "lang", F.lit("/set "), text(i % 4), F.when(i % 16 == 5, " 2nd Submission").otherwise(""), F.lit(".pdf")).alias("source_document"),
        F.col("lang").alias("discipline"), text(i % 2).alias("comment_number"), F.concat(F.lit("Round "), text(i % 2 + 1)).alias("review_round"),
        F.when(i % 5 == 0, F.concat(F.lit("Reviewer "), text(i % 3), F.lit(" 3/"), text(i % 2 + 14), F.lit("/2024"))).alias("reviewer"),
        F.when(i % 3 == 0, "merged_parent").alias("hierarchy_status"), F.when(i % 97 == 1, "hierarchical_subpoint").alias("duplicate_status"),
        F.concat(F.lit("CD-"), "source", "lang").alias("canonical_document_id"), (i % 2 + 1).cast("int").alias("canonical_document_duplicate_group_size"),
        F.when(i % 3 == 0, F.concat(F.lit("R-"), text(i))).alias("response_id"), F.when((i % 3 == 0) & (F.coalesce("toxic", F.lit(0)) == 0), "confirmed").alias("link_review_status"),
        F.when(F.col("quality") == 1, "confirmed").alias("human_review_status"), F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "quarantined").alias("text_trust_status"),
        F.col("text").alias("original_text"), F.lit(None).cast("string").alias("verified_text"),
    )


COMMENTS = """
comments AS (
  SELECT d.doc_id AS comment_id, d.source AS city, 'Project ' || d.source AS property_project, '' AS project_id,
    'comments&response/' || d.source || '/' || d.lang || '/set ' || (d.doc_id % 4) || CASE WHEN d.doc_id % 16 = 5 THEN ' 2nd Submission' ELSE '' END || '.pdf' AS source_document,
    d.lang AS discipline, CAST(d.doc_id % 2 AS VARCHAR) AS comment_number, 'Round ' || (d.doc_id % 2 + 1) AS review_round,
    CASE WHEN d.doc_id % 5 = 0 THEN 'Reviewer ' || (d.doc_id % 3) || ' 3/' || (d.doc_id % 2 + 14) || '/2024' END AS reviewer,
    CASE WHEN d.doc_id % 3 = 0 THEN 'merged_parent' END AS hierarchy_status, CASE WHEN d.doc_id % 97 = 1 THEN 'hierarchical_subpoint' END AS duplicate_status,
    'CD-' || d.source || d.lang AS canonical_document_id, CAST(d.doc_id % 2 + 1 AS INT) AS canonical_document_duplicate_group_size,
    CASE WHEN d.doc_id % 3 = 0 THEN 'R-' || d.doc_id END AS response_id,
    CASE WHEN d.doc_id % 3 = 0 AND coalesce(l.toxic, 0) = 0 THEN 'confirmed' END AS link_review_status,
    CASE WHEN l.quality = 1 THEN 'confirmed' END AS human_review_status,
    CASE WHEN l.quality = 1 THEN 'verified' WHEN l.quality = 0 THEN 'quarantined' END AS text_trust_status, d.text AS original_text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def normal_sql(text: str) -> str:
    """SQL of the identity text (``functions.text.identity_form``) for texts that Unicode folding leaves as they are but for case."""
    prefixes = [
        r"(?i)^\s*(?:markup|comment)\s+.*?\bv\s*\d+\s*[-/]?\s*c\s*\d+\s+\d+(?:\.\d+)?\s*", r"(?i)^\s*\(?[a-z]\)?\s*pc\s*\d+\s*[-:]\s*",
        r"(?i)^\s*pc\s*\d+\s*[-:]\s*", r"^\s*\(?[a-z]\)?\s*[.:]\s*", r"^\s*\d+\s*[.)]\s+",
    ]
    out = f"trim(regexp_replace(regexp_replace({text}, '_x000[dDaA]_|\\*x000[dDaA]\\*|[\\r\\n\\t]|-{{8,}}', ' ', 'g'), '[\\s\\x0b]+', ' ', 'g'))"
    for _ in range(8):
        for p in prefixes:
            out = f"regexp_replace({out}, '{p}', '')"
    return f"array_to_string(regexp_extract_all(replace(lower({out}), 'ß', 'ss'), '[a-z0-9]+(?:[./''’\"-][a-z0-9]+)*'), ' ')"


def sql_over(base: str, body: str, *more: str) -> str:
    return "WITH " + ", ".join([base.strip(), *more]) + "\n" + body
