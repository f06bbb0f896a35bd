"""Queries that show the text and identity columns over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import identity as I
from marginalia.functions import labels as L
from marginalia.functions import similarity as S
from marginalia.functions import taxonomy as C
from marginalia.functions import text as X
from marginalia.plans.records import normal_sql, records, sql, table

_NEGATIONS = ", ".join("'" + w.replace("'", "''") + "'" for w in X.NEGATIONS)
_STOPS = ", ".join(f"'{w}'" for w in X.SEARCH_STOPS)
_TOPIC = lambda col, words: f"regexp_matches({col}, '\\b({words.replace(chr(39), chr(39) * 2)})\\b')"


_ITEM = "regexp_matches(p, '(?is)^(?:(?:PC|ITEM|COMMENT|CORRECTION)\\s*)?[0-9]{1,3}\\s*[:.)-]\\s')"
_UNITS = f"CASE WHEN len(list_filter(parts, lambda p: {_ITEM})) < 2 OR len(list_filter(parts, lambda p: {_ITEM} AND length(p) >= 20)) = 0 THEN 1 ELSE len(list_filter(parts, lambda p: {_ITEM} AND length(p) >= 20)) END"


def _topic_case() -> str:
    """SQL of a topic's id, over the folded text b, the same after its discipline v, and the discipline."""
    cases = [f"WHEN {_TOPIC('v', C.TREE_WORDS)} THEN CASE " + " ".join(f"WHEN {_TOPIC('b', w)} THEN 'TREES_{C._slug(a)}'" for a, w in C.TREES) + " ELSE 'TREES_TREE_REVIEW' END"]
    cases.append(f"WHEN {_TOPIC('v', C.DOOR_WORDS)} THEN CASE " + " ".join(f"WHEN {_TOPIC('b', w)} THEN 'DOORS_{C._slug(a)}'" for a, w in C.DOORS) + " ELSE 'DOORS_DOOR_SCHEDULE_AND_LABELING' END")
    cases += [f"WHEN {_TOPIC('v', w)} THEN '{i}'" for i, _, _, w in C.RULES]
    return f"CASE {' '.join(cases)} ELSE 'GENERAL_' || upper(discipline) || '_REVIEW' END"


TOPIC_CASE = _topic_case()


def _topic_sql() -> str:
    body = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
    return sql(f"SELECT comment_id, {TOPIC_CASE} AS topic_id FROM t", f"t AS (SELECT comment_id, discipline, {body.format('text')} AS b, {body.format(chr(100) + 'iscipline || chr(32) || text')} AS v FROM records)")


def _title_sql() -> str:
    v = "text"
    for p in ("^\\s*\\(?[A-Z]\\)?(?:[.:]|\\s+)\\s*", "(?i)^\\s*PC[0-9]+\\s*[-:]\\s*", "(?i)^\\s*#[0-9]+\\s*(?:continue)?\\s*", "^\\s*[0-9]+\\s*[.)]\\s+"):
        v = f"regexp_replace({v}, '{p}', '')"
    v = f"regexp_replace(trim(regexp_replace({v}, '\\s+', ' ', 'g')), '^[ .:\\-]+|[ .:\\-]+$', '', 'g')"
    first = "trim(CASE WHEN regexp_extract(v, '^(.*?[.!?])(?:\\s|$)', 1) <> '' THEN regexp_extract(v, '^(.*?[.!?])(?:\\s|$)', 1) ELSE v END)"
    return sql(
        "SELECT comment_id, CASE WHEN t = '' THEN 'Recurring review issue' WHEN length(t) > 110 THEN regexp_replace(left(t, 107), ' [^ ]*$', '') || '…' ELSE t END AS title FROM c",
        f"f AS (SELECT comment_id, {first} AS s FROM (SELECT comment_id, {v} AS v FROM records))",
        "c AS (SELECT comment_id, CASE WHEN instr(s, ':') BETWEEN 1 AND 43 THEN trim(substr(s, instr(s, ':') + 1)) ELSE s END AS t FROM f)",
    )


def _excerpt_sql(limit: int = 200) -> str:
    return sql(
        f"SELECT comment_id, CASE WHEN length(t) <= {limit} THEN t WHEN length(s) >= 50 THEN trim(s) WHEN length(w) >= 66 THEN regexp_replace(w, '[ ,;:-]+$', '') || '…' ELSE '' END AS text, length(t) <= {limit} OR length(s) >= 50 AS complete FROM e",
        "t AS (SELECT comment_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM records)",
        f"e AS (SELECT comment_id, t, regexp_extract(left(t, {limit}), '^(.*[.!?])(?:\\s|$)', 1) AS s, regexp_extract(left(t, {limit}), '^(.*) ', 1) AS w FROM t)",
    )


QUERIES = {
    "identity_text": (
        lambda s, d: records(s, d).select("comment_id", F.sha2(X.normalize_event_text("text"), 256).alias("fingerprint")),
        sql(f"SELECT comment_id, sha256({normal_sql('text')}) AS fingerprint FROM records"),
    ),
    "search_tokens": (
        lambda s, d: records(s, d).select("comment_id", X.search_tokens(F.col("text")).alias("t")).select("comment_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("n_distinct")),
        sql(f"SELECT comment_id, len(t) AS n, len(list_distinct(t)) AS n_distinct FROM (SELECT comment_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.\\-/][a-z0-9]+)*'), lambda x: length(x) > 1 AND x NOT IN ({_STOPS})) AS t FROM records)"),
    ),
    "searchable_text": (
        lambda s, d: records(s, d).select("comment_id", F.sha2(X.searchable_text(F.col("city"), F.col("discipline"), F.col("text")), 256).alias("input_hash")),
        sql("SELECT comment_id, sha256('City: ' || city || chr(10) || 'Discipline: ' || discipline || chr(10) || 'Comment: ' || text || CASE WHEN len(c) > 0 THEN chr(10) || 'Code sections: ' || array_to_string(list_sort(list_distinct(c)), ', ') ELSE '' END) AS input_hash FROM (SELECT *, regexp_extract_all(text, '\\b[A-Z]{2,6}\\s+[A-Z]?\\d+(?:\\.\\d+)+\\b') AS c FROM records)"),
    ),
    "truncations": (
        lambda s, d: records(s, d).groupBy(X.truncation_reason(F.col("text")).alias("reason")).agg(F.count("*").alias("n")),
        sql("SELECT CASE WHEN regexp_matches(trim(text), '(\\.\\.\\.|…)$') THEN 'ends_with_ellipsis' WHEN regexp_matches(lower(trim(text)), '\\b(and|or|the|to|of|for|with|per|see|refer to)$') THEN 'ends_mid_phrase' ELSE '' END AS reason, count(*) AS n FROM records GROUP BY 1"),
    ),
    "topics": (lambda s, d: records(s, d).select("comment_id", C.classify_topic(F.col("text"), F.col("discipline"))["topic_id"].alias("topic_id")), _topic_sql()),
    "stable_ids": (
        lambda s, d: table(s, d, "customer").select("c_custkey", I.stable_id("C", F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")).alias("id")),
        "SELECT c_custkey, 'C-' || substr(sha256(c_name || '|' || c_nationkey || '|' || c_mktsegment), 1, 20) AS id FROM customer",
    ),
    "event_dates": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", I.event_date(F.concat(F.lit("letter "), F.date_format("o_orderdate", "M/d/yyyy"), F.lit(" final"))).cast("string").alias("date"), I.date_label(F.col("o_orderdate")).alias("label")),
        "SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, strftime(o_orderdate, '%m/%d/%Y') AS label FROM orders",
    ),
    "rounds": (
        lambda s, d: records(s, d).select("comment_id", I.round_number(F.concat(F.lit("Review Round "), F.col("review_round"))).alias("n"), I.round_identity(F.concat(F.lit("Round "), F.col("review_round"))).alias("label")),
        sql("SELECT comment_id, CAST(review_round AS INT) AS n, CAST(review_round AS VARCHAR) AS label FROM records"),
    ),
    "vector_norms": (
        lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("embedding")), 6).alias("self")),
        "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS self FROM embeddings",
    ),
    "json_props": (
        lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")),
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    ),
    "units": (
        lambda s, d: records(s, d).select("comment_id", F.size(X.coherent_units(F.col("text"))).alias("units")).groupBy("units").agg(F.count("*").alias("n")),
        sql(f"SELECT CAST(CASE WHEN trim(text) = '' THEN 0 ELSE {_UNITS} END AS INT) AS units, count(*) AS n FROM (SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(trim(text), '(?im)^([ \t]*(?:(?:PC|ITEM|COMMENT|CORRECTION)[ \t]*)?[0-9]{{1,3}}[ \t]*[:.)-][ \t]+)', chr(1) || '\1', 'g'), chr(1)), lambda p: trim(p, chr(10) || chr(32) || chr(9))), lambda p: p <> '') AS parts FROM records) GROUP BY 1"),
    ),
    "titles": (lambda s, d: records(s, d).select("comment_id", X.recurring_title(F.col("text")).alias("title")), _title_sql()),
    "readable_texts": (
        lambda s, d: records(s, d).select("comment_id", F.sha2(L.readable(F.col("text")), 256).alias("shown")),
        sql("SELECT comment_id, sha256(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(text, '_x000[DA]_|[\\r\\n\\t\\x{00a0}]', ' ', 'g'), '\\s+', ' ', 'g')), '^(?i:(?:response\\s*[_:-]\\s*)+)', ''), '\\s+([,.;:!?])', '\\1', 'g')) AS shown FROM records"),
    ),
    "excerpts": (
        lambda s, d: records(s, d).select("comment_id", L.excerpt(F.col("text"), 200).alias("e")).select("comment_id", "e.text", "e.complete"),
        _excerpt_sql(),
    ),
    "submission_labels": (
        lambda s, d: table(s, d, "part").select("p_partkey", L.submission_label(F.concat(F.lit("set "), F.col("p_partkey") % 130, F.lit("th submission.pdf"))).alias("label"), L.normalized_identifier(F.concat("p_size", F.lit(".0"))).alias("id")),
        "SELECT p_partkey, k || CASE WHEN k % 100 BETWEEN 10 AND 20 THEN 'th' WHEN k % 10 = 1 THEN 'st' WHEN k % 10 = 2 THEN 'nd' WHEN k % 10 = 3 THEN 'rd' ELSE 'th' END || ' submission' AS label, CAST(p_size AS VARCHAR) AS id FROM (SELECT *, p_partkey % 130 AS k FROM part)",
    ),
    "filename_dates": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", L.filename_date(F.concat(F.lit("RS_"), F.date_format("o_orderdate", "MM-dd-yyyy"), F.lit("_2024_01_02.xlsx"))).cast("string").alias("date")),
        "SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2024-01-02' END AS date FROM orders",
    ),
    "event_fingerprints": (
        lambda s, d: records(s, d).select("comment_id", F.sha2(L.fingerprint(F.col("city"), F.lit("reviewer_comment"), F.lit(None), F.col("issue_id"), F.col("review_round"), F.lit(None), X.normalize_event_text("text")), 256).alias("fingerprint")),
        sql(
            f"SELECT comment_id, sha256(lower(city) || '|government_comment||' || lower(issue_id) || '|' || review_round || '|unknown|' || normal || '|' || array_to_string(list_sort(list_distinct(list_filter(string_split(normal, ' '), lambda x: regexp_matches(x, '[0-9]')))), ',') || '|' "
            f"|| array_to_string(list_sort(list_distinct(list_filter(string_split(normal, ' '), lambda x: x IN ({_NEGATIONS})))), ',')) AS fingerprint FROM (SELECT *, {normal_sql('text')} AS normal FROM records)"
        ),
    ),
    "cell_ranges": (
        lambda s, d: table(s, d, "lineitem").select("l_linenumber", F.pmod("l_partkey", F.lit(700)).alias("c")).distinct().select("l_linenumber", "c", X.parse_cell_range(F.concat(X.column_letters(F.col("c") + 1), F.col("l_linenumber"))).alias("r")).select("l_linenumber", "c", F.col("r.first_row").alias("row"), F.col("r.first_column").alias("col")),
        "SELECT DISTINCT l_linenumber, l_partkey % 700 AS c, l_linenumber AS row, CAST(l_partkey % 700 + 1 AS INT) AS col FROM lineitem",
    ),
}
