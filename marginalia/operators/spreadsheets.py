"""Review spreadsheets: which columns hold what, evidence rows with their units, and discussions split into events.

Cells come as rows (source, sheet, row, column, value), as the parsers of
``sources.cells`` give them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import keys as K
from marginalia.functions import labels as L
from marginalia.functions import text as X
from marginalia.plans.records import table
from marginalia.storage import cut

# The headers of one export's columns, and those that tables in general use.
EXPORT = {"A": "ref #", "B": "reviewed by", "C": "type", "D": "view", "E": "enter your comment response here", "F": "discussion", "G": "cycle", "H": "status"}
EXPORT_COLUMNS = {"ref": "A", "reviewer": "B", "comment": "C", "view": "D", "response": "E", "discussion": "F", "cycle": "G", "status": "H"}
GENERIC = {
    "comment": ["government comment", "city comment", "review comment", "comment", "correction", "requirement"], "response": ["applicant response", "company response", "response", "resolution"],
    "ref": ["ref #", "comment #", "comment number", "id"], "reviewer": ["reviewed by", "reviewer", "department"], "cycle": ["cycle", "round", "review round"], "status": ["status"],
}
HEADER_ROWS = 10
EVENT_HEAD = "(?im)^[ \\t]*(Reviewer Response|Responded by)[ \\t]*:[ \\t]*(.*?)[ \\t]*-[ \\t]*([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}(?:[ \\t]+[0-9]{1,2}:[0-9]{2}(?:[ \\t]*[AP]M)?)?)"
RULE = "(?m)^[ \\t]*-{8,}[ \\t]*$"


def visible(c: Column) -> Column:
    """A cell's text in one line."""
    return X.collapse(X.unescaped(K.blank(c)))


def detect_schemas(cells: DataFrame) -> DataFrame:
    """(source, sheet, template, confidence, header_row, ref, reviewer, comment, view, response, discussion, cycle, status) of each sheet.

    The first of the leading rows that has all of the export's headers, or
    exactly one comment and at most one response column; no row for other sheets.
    """
    heads = cells.where(F.col("row") <= HEADER_ROWS).select("source", "sheet", "row", F.upper("column").alias("column"), F.lower(visible(F.col("value"))).alias("label")).where("label <> ''")
    heads = cut(heads, "heads")
    export = F.create_map(*[F.lit(x) for kv in EXPORT.items() for x in kv])
    hits = lambda name: F.sort_array(F.collect_set(F.when(F.col("label").isin(GENERIC[name]), F.struct(F.length("column").alias("n"), F.col("column").alias("c"))))).alias(name)
    rows = heads.groupBy("source", "sheet", "row").agg(F.sum((F.try_element_at(export, F.col("column")) == F.col("label")).cast("int")).alias("exact"), *map(hits, GENERIC))
    first = lambda name: F.coalesce(F.get(name, 0)["c"], F.lit(""))
    whole, generic = F.coalesce("exact", F.lit(0)) == len(EXPORT), (F.size("comment") == 1) & (F.size("response") <= 1)
    made = rows.where(whole | generic).withColumn("export", whole)
    pick = lambda name: F.when(F.col("export"), EXPORT_COLUMNS.get(name, "")).otherwise(first(name) if name in GENERIC else F.lit("")).alias(name)
    named = made.select("source", "sheet", F.when(F.col("export"), "projectdox_review_comments_v1").otherwise("generic_comment_response_table_v1").alias("template"), F.when(F.col("export"), 1.0).otherwise(0.98).alias("confidence"), F.col("row").alias("header_row"), *map(pick, EXPORT_COLUMNS))
    best = named.groupBy("source", "sheet").agg(F.min("header_row").alias("header_row"))
    return named.join(best, ["source", "sheet", "header_row"])


def evidence_rows(cells: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per spreadsheet row below its header that has a comment: values by role, unit ids, department, date, and what pairs.

    A response pairs with the comment of its own row only.  Rows without a
    comment but with other text are context.
    """
    roles = F.explode(F.array(*[F.struct(F.lit(n).alias("role"), F.col(n).alias("column")) for n in EXPORT_COLUMNS]))
    where = schemas.select("source", "sheet", "template", "header_row", roles.alias("r")).select("source", "sheet", "template", "header_row", "r.role", "r.column").where("column <> ''")
    held = cells.withColumn("column", F.upper("column")).join(where, ["source", "sheet", "column"]).where(F.col("row") > F.col("header_row"))
    value = lambda role: F.coalesce(F.max(F.when(F.col("role") == role, F.col("value"))), F.lit(""))
    unit = lambda role: F.max(F.when((F.col("role") == role) & (F.trim(K.blank(F.col("value"))) != ""), F.concat(F.lit("XLSX:"), "sheet", F.lit(":"), "column", F.col("row").cast("string"))))
    rows = held.groupBy("source", "sheet", "row", "template").agg(*[value(n).alias(n) for n in EXPORT_COLUMNS], unit("comment").alias("comment_unit"), unit("response").alias("response_unit"), unit("discussion").alias("discussion_unit"))
    date = L.event_time(F.regexp_extract(visible(F.col("reviewer")), "(?i)\\b([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}(?:\\s+[0-9]{1,2}:[0-9]{2}(?:\\s*[AP]M)?)?)\\b", 1))
    out = rows.withColumns({"printed_id": L.normalized_identifier(F.col("ref")), "department": K.department(visible(F.col("reviewer"))), "event_date": F.date_format(date, "yyyy-MM-dd"), "is_comment": F.trim("comment") != "", "paired": (F.trim("comment") != "") & (F.trim("response") != "")})
    return out.where("is_comment or trim(response) <> '' or trim(discussion) <> ''")


def discussion_events(c: Column) -> Column:
    """array(struct(event_type, actor_role, actor, occurred_at, occurred_label, exact_text, source_order, parsed)): a discussion cell's entries.

    Entries start with who responded and when; a cell without such a line is one
    note.  Run-together exports are laid out in lines first.
    """
    t = F.regexp_replace(F.regexp_replace(X.unescaped(K.blank(c)), "_x000[dD]_|\\*x000[dD]\\*|\\r\\n?", "\n"), "-{8,}", "\n--------------------\n")
    t = F.regexp_replace(t, "(?i)(?<!\\n)[ \\t]*(?=(?:Reviewer Response|Responded by)[ \\t]*:)", "\n")

    def split(text: Column) -> Column:
        labels, actors, stamps = (F.regexp_extract_all(text, F.lit(EVENT_HEAD), F.lit(g)) for g in (1, 2, 3))
        bodies = F.transform(F.split(text, EVENT_HEAD), lambda b: F.regexp_replace(F.regexp_replace(b, RULE, ""), "^\\s+|\\s+$", ""))
        shape = lambda kind, role, actor, at, label, body, n, parsed: F.struct(kind.alias("event_type"), role.alias("actor_role"), actor.alias("actor"), at.alias("occurred_at"), label.alias("occurred_label"), body.alias("exact_text"), n.alias("source_order"), parsed.alias("parsed"))
        none = F.lit("")
        note = shape(F.lit("discussion_note"), F.lit("unknown"), none, none, none, F.get(bodies, 0), F.lit(1), F.lit(False))

        def entry(label: Column, i: Column) -> Column:
            office = F.lower(label) == "reviewer response"
            at = F.coalesce(F.date_format(L.event_time(F.get(stamps, i)), "yyyy-MM-dd'T'HH:mm"), none)
            return shape(F.when(office, "reviewer_follow_up").otherwise("applicant_response"), F.when(office, "government").otherwise("company"), X.collapse(F.get(actors, i)), at, X.collapse(F.get(stamps, i)), F.get(bodies, i + 1), i + 1, F.lit(True))

        return F.when(F.size(labels) > 0, F.transform(labels, entry)).when(F.get(bodies, 0) != "", F.array(note)).otherwise(F.array().cast("array<struct<event_type:string,actor_role:string,actor:string,occurred_at:string,occurred_label:string,exact_text:string,source_order:int,parsed:boolean>>"))

    return X.let(t, split)


def verify_locally(rows: DataFrame) -> DataFrame:
    """Per source and sheet: comments, responses, whether every comment has one unit and every response its row's comment, and what misses one."""
    lone = (~F.col("is_comment")) & (F.trim("response") != "")
    return rows.groupBy("source", "sheet").agg(
        F.sum(F.col("is_comment").cast("long")).alias("comments"), F.sum((F.trim("response") != "").cast("long")).alias("responses"), F.sum(F.col("paired").cast("long")).alias("pairs"),
        F.sum(lone.cast("long")).alias("orphans"), (F.sum(F.col("is_comment").cast("long")) == F.count_distinct(F.when(F.col("is_comment"), F.col("comment_unit")))).alias("every_comment_has_a_unit"), (F.sum(lone.cast("long")) == 0).alias("same_row_links_correct"),
    )


def _book(s, d) -> DataFrame:
    """Conversations as sheets: a header, then a row per two turns with comment and response."""
    c = table(s, d, "conversations").select(F.concat(F.lit("book "), "conv_id").alias("source"), F.lit("Log").alias("sheet"), (F.floor(F.col("turn") / 2) + 3).cast("int").alias("row"), F.when(F.col("turn") % 2 == 0, "B").otherwise("C").alias("column"), F.col("text").alias("value"))
    head = c.select("source", "sheet").distinct().select("source", "sheet", F.lit(2).alias("row"), F.explode(F.create_map(F.lit("A"), F.lit("ID"), F.lit("B"), F.lit("City  Comment"), F.lit("C"), F.lit("Response"))).alias("column", "value"))
    return c.unionByName(head)


_ROWS = "r AS (SELECT conv_id, turn // 2 AS k, max(CASE WHEN turn % 2 = 0 THEN text END) AS a, max(CASE WHEN turn % 2 = 1 THEN text END) AS b FROM conversations GROUP BY 1, 2)"

QUERIES = {
    "sheet_schemas": (
        lambda s, d: detect_schemas(_book(s, d)).select("source", "template", "header_row", "ref", "comment", "response"),
        "SELECT DISTINCT 'book ' || conv_id AS source, 'generic_comment_response_table_v1' AS template, 2 AS header_row, 'A' AS ref, 'B' AS comment, 'C' AS response FROM conversations",
    ),
    "sheet_rows": (
        lambda s, d: verify_locally(evidence_rows(cut(_book(s, d), "cells"), detect_schemas(_book(s, d)))).select("source", "comments", "responses", "pairs", "orphans", "same_row_links_correct"),
        f"""WITH {_ROWS} SELECT 'book ' || conv_id AS source, count(*) FILTER (trim(coalesce(a, '')) <> '') AS comments, count(*) FILTER (trim(coalesce(b, '')) <> '') AS responses,
        count(*) FILTER (trim(coalesce(a, '')) <> '' AND trim(coalesce(b, '')) <> '') AS pairs, count(*) FILTER (trim(coalesce(a, '')) = '' AND trim(coalesce(b, '')) <> '') AS orphans,
        count(*) FILTER (trim(coalesce(a, '')) = '' AND trim(coalesce(b, '')) <> '') = 0 AS same_row_links_correct FROM r WHERE trim(coalesce(a, '')) <> '' OR trim(coalesce(b, '')) <> '' GROUP BY conv_id""",
    ),
}
