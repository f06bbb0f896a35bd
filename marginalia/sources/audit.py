"""What an inventoried file is: its city, project, round and kind from path and text, what a person should look at, and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import dates as D
from marginalia.functions import keys as K
from marginalia.functions import text as X
from marginalia.plans.records import complete, table
from marginalia.storage import cut

# Words of documents' kinds.
COMMENT_TERMS = ["comment", "comments", "city comment", "review comment", "plan check", "plan review", "correction", "corrections", "correction notice", "review notes", "markups", "checker comment", "disposition"]
RESPONSE_TERMS = ["response", "responses", "applicant response", "consultant response", "response letter", "resubmittal response", "our response", "reply", "addressed", "resolved"]
DRAWING_TERMS = ["plan set", "planset", "drawing", "drawings", "sheet set", "map", "grading plan", "architectural", "diagram", "detail sheet", "civil plan"]
SUPPORTING_TERMS = ["calculation", "calculations", "report", "study", "specification", "geotechnical", "survey", "application", "form", "worksheet"]
DEDICATED_TEXT = "(?s)our comments follow|comments are as follows|plan review comments|completed.{0,120}review.{0,240}comments|corrections required"
DEDICATED = ["city_comments", "company_response", "combined_comment_response", "correction_notice", "review_letter"]
SHEETS = ["xlsx", "xls", "csv", "tsv", "ods"]
# Cities, and what only their own documents say.
CITIES = ["San Jose", "Palo Alto", "Sunnyvale", "Santa Clara", "Fremont", "Milpitas", "Cupertino", "Mountain View", "Redwood City", "Menlo Park"]
JOINED = ["San Jose", "Palo Alto", "Santa Clara", "Mountain View", "Redwood City", "Menlo Park"]
AUTHORITIES = {
    "San Jose": ["sanjoseca.gov", "sjpermits.org", "sjeplans", "san jose municipal code"], "Palo Alto": ["cityofpaloalto.org", "palo alto municipal code"], "Sunnyvale": ["sunnyvale.ca.gov", "sunnyvale.gov", "sunnyvale municipal code"],
    "Santa Clara": ["santaclaraca.gov", "santa clara city code"], "Fremont": ["fremont.gov", "fremont municipal code"], "Milpitas": ["milpitas.gov", "milpitas municipal code"], "Cupertino": ["cupertino.gov", "cupertino.org", "cupertino municipal code"],
    "Mountain View": ["mountainview.gov", "mountain view city code"], "Redwood City": ["redwoodcity.org", "redwood city municipal code"], "Menlo Park": ["menlopark.gov", "menlopark.org", "menlo park municipal code"],
}
TEXT_SEEN, KIND_SEEN = 20_000, 40_000


def infer_city(path: Column, text: Column) -> Column:
    """struct(city, confidence, conflicts): the city with the best evidence; an address or authority beats a name, a name in the path one in the text.

    Only the first 20,000 characters are read: that is the rule, a letter's head
    says where it comes from.
    """
    where = F.lower(F.regexp_replace(K.blank(path), "[/_-]", " "))
    seen = F.lower(X.collapse(F.substring(K.blank(text), 1, TEXT_SEEN)))
    options = []
    for city in CITIES:
        names = [city.lower()] + ([city.lower().replace(" ", "")] if city in JOINED else [])
        alias = "(?:" + "|".join(map(re.escape, names)) + ")"
        address = seen.rlike(rf"\b(?:city\s+of\s+)?{alias}\b.{{0,60}}\bca\s+\d{{5}}(?:-\d{{4}})?\b")
        office = seen.rlike("|".join(map(re.escape, AUTHORITIES[city])))
        score = F.when(address | office, 0.99).when(seen.rlike(rf"\bcity\s+of\s+{alias}\b"), 0.97).when(where.rlike(alias), 0.82).when(seen.rlike(alias), 0.64)
        options.append(F.struct((-score).alias("s"), F.lit(city).alias("city")))
    ranked = F.array_sort(F.filter(F.array(*options), lambda x: x["s"].isNotNull()))
    best = F.get(ranked, 0)
    others = F.transform(F.filter(F.slice(ranked, 2, len(CITIES)), lambda x: x["s"] <= -0.82), lambda x: x["city"])
    return F.when(best.isNotNull(), F.struct(best["city"].alias("city"), (-best["s"]).alias("confidence"), others.alias("conflicts"))).otherwise(F.struct(F.lit("unknown").alias("city"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("conflicts")))


def _pretty(c: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(c, "[_-]+", " "), "\\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.lower(w).rlike("^(?:sb|ip|gr|rs)[0-9]*$"), F.upper(w)).otherwise(F.initcap(F.lower(w)))), " ")


def infer_project(path: Column) -> Column:
    """struct(project, confidence): the top folder without its city, and the folders below it up to the round's; lots that disagree cost belief."""
    cities = "|".join(sorted(c.lower().replace(" ", "[_ ]?") for c in CITIES))
    parts = F.split(K.blank(path), "/")
    root = _pretty(F.regexp_replace(F.get(parts, 0), f"(?i)_(?:{cities})$", ""))
    folders = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    stop = "(?i)\\b(?:1st|2nd|3rd|4th|5th|first|second|third|fourth|fifth)\\b.*\\b(?:comment|review|round|submission|submitt?al)"
    at = F.array_position(F.transform(folders, lambda f: f.rlike(stop)), True).cast("int")
    scope = F.filter(F.when(at > 0, F.slice(folders, 1, at - 1)).otherwise(folders), lambda f: ~F.lower(f).isin("deliverable and submittals", "deliverables and submittals"))
    name = F.when(F.size(scope) > 0, F.concat(root, F.lit(" — "), F.array_join(F.transform(scope, _pretty), " / "))).otherwise(root)
    lot = lambda c: F.regexp_extract(c, "(?i)\\blot[ _-]*([0-9]+)\\b", 1)
    above, own = lot(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " ")), lot(F.element_at(parts, -1))
    sure = F.when((above != "") & (own != "") & (above != own), 0.55).when(root.rlike("[0-9]"), 0.92).otherwise(0.76)
    return F.when(root == "", F.struct(F.lit("unknown").alias("project"), F.lit(0.0).alias("confidence"))).otherwise(F.struct(name.alias("project"), sure.alias("confidence")))


def classify(path: Column, text: Column, comment_columns: Column, response_columns: Column, page_chars: Column, pages: Column) -> Column:
    """struct(document_type, table_source, comments, responses, both, drawing_heavy, confidence) of a file.

    Headers, name and text each add to a comment's and a response's score; the
    kind is decided in a fixed order.  Only the first 40,000 characters count.
    """
    file = F.element_at(F.split(K.blank(path), "/"), -1)
    name = F.lower(F.regexp_replace(file, "[_-]", " "))
    suffix = F.lower(F.regexp_extract(file, "\\.([A-Za-z0-9]+)$", 1))
    seen = F.concat_ws(" ", name, F.lower(F.substring(K.blank(text), 1, KIND_SEEN)))
    count = lambda c, terms: F.size(X.keyword_hits(c, terms))
    any_ = lambda terms: count(name, terms) > 0
    some = lambda c: F.when(F.coalesce(c, F.lit(0)) > 0, 0.58).otherwise(0.0)
    comments = F.least(F.lit(1.0), some(comment_columns) + F.when(any_(COMMENT_TERMS), 0.55).otherwise(0.0) + F.when(F.lower(F.substring(K.blank(text), 1, KIND_SEEN)).rlike(DEDICATED_TEXT), 0.62).otherwise(0.0) + F.least(count(seen, COMMENT_TERMS), F.lit(3)) * 0.08)
    responses = F.least(F.lit(1.0), some(response_columns) + F.when(any_(RESPONSE_TERMS), 0.55).otherwise(0.0) + F.least(count(seen, RESPONSE_TERMS), F.lit(3)) * 0.08)
    n = F.size(F.coalesce(page_chars, F.array().cast("array<int>")))
    low = F.when(n > 0, F.size(F.filter(page_chars, lambda c: c < 80)) / n).otherwise(0.0)
    sorted_ = F.array_sort(page_chars)
    median = F.when(n > 0, (F.get(sorted_, ((n - 1) / 2).cast("int")) + F.get(sorted_, (n / 2).cast("int"))) / 2).otherwise(0.0)
    thin = (suffix == "pdf") & (F.coalesce(pages, F.lit(0)) > 0) & ((low >= 0.7) | ((F.coalesce(pages, F.lit(0)) >= 8) & (median < 120))) & ~any_(COMMENT_TERMS + RESPONSE_TERMS)
    drawing = any_(DRAWING_TERMS) | thin
    told = lambda kind, sure: F.struct(F.lit(kind).alias("kind"), sure.alias("sure"))

    def decide(s: Column) -> Column:
        c, r = s["c"], s["r"]
        kind = (
            F.when((c >= 0.5) & (r >= 0.5), told("combined_comment_response", F.greatest(c, r))).when(r >= 0.5, told("company_response", r))
            .when(seen.rlike("corrections? notice"), told("correction_notice", F.greatest(F.lit(0.7), c))).when(drawing, told("drawing_or_plan", F.when(any_(DRAWING_TERMS), 0.82).otherwise(0.66)))
            .when(c >= 0.5, told("city_comments", c)).when(any_(SUPPORTING_TERMS), told("supporting_document", F.lit(0.72)))
            .when(suffix.isin("pdf", "docx", "doc", "eml") & name.rlike("review|letter"), told("review_letter", F.lit(0.55))).otherwise(told("unknown", F.lit(0.25)))
        )
        return F.struct(kind["kind"].alias("document_type"), (suffix.isin(SHEETS) & ((c >= 0.5) | (r >= 0.5))).alias("table_source"), (c >= 0.5).alias("comments"), (r >= 0.5).alias("responses"), ((c >= 0.5) & (r >= 0.5)).alias("both"), drawing.alias("drawing_heavy"), F.round(kind["sure"], 2).alias("confidence"))

    return X.let(F.struct(comments.alias("c"), responses.alias("r")), decide)


_FILE = {"path": "string", "text": "string", "comment_columns": "int", "response_columns": "int", "page_chars": "array<int>", "pages": "int", "processing_error": "string"}


def describe(files: DataFrame) -> DataFrame:
    """The inventory's files with city, project, round, kind and how sure each is."""
    d = complete(files, **_FILE)
    found = d.withColumns({
        "__city": infer_city(F.col("path"), F.col("text")), "__project": infer_project(F.col("path")), "__round": D.infer_round(F.col("path")),
        "__kind": classify(F.col("path"), F.col("text"), F.col("comment_columns"), F.col("response_columns"), F.col("page_chars"), F.col("pages")),
    })
    return found.select(
        "path", F.col("__city.city").alias("likely_city"), F.col("__city.confidence").alias("city_confidence"), F.col("__project.project").alias("likely_property_project"), F.col("__project.confidence").alias("property_confidence"),
        F.col("__round.round").alias("likely_review_round"), F.col("__round.confidence").alias("round_confidence"), "__kind.*", K.blank(F.col("processing_error")).alias("processing_error"), (F.trim(K.blank(F.col("text"))) != "").alias("text_found"),
    )


def apply_overrides(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """A person's values (path and any of the fields, text) in place of inferred ones, empty ones not; ``overridden`` and the note."""
    fields = [c for c in files.columns if c in overrides.columns and c != "path"]
    o = overrides.select("path", *[F.trim(F.col(c).cast("string")).alias(f"__{c}") for c in fields], *([F.col("note").alias("__note")] if "note" in overrides.columns else []), F.lit(True).alias("__set"))
    j = files.join(o, "path", "left")
    kinds = dict(files.dtypes)
    for c in fields:
        j = j.withColumn(c, F.when(K.blank(F.col(f"__{c}")) != "", F.col(f"__{c}").cast(kinds[c])).otherwise(F.col(c)))
    note = F.coalesce("__note", F.lit("")) if "note" in overrides.columns else F.lit("")
    return j.withColumn("overridden", F.coalesce("__set", F.lit(False))).withColumn("override_note", note).drop(*[f"__{c}" for c in fields], "__note", "__set")


def review_rows(files: DataFrame) -> DataFrame:
    """(path, reasons) of files that a person should look at."""
    suffix = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
    when = lambda c, why: F.when(c, why)
    reasons = F.array_compact(F.array(
        when((F.col("confidence") < 0.58) | (F.col("document_type") == "unknown"), "ambiguous document classification"), when(F.col("likely_city") == "unknown", "unknown city"),
        when(F.col("likely_property_project") == "unknown", "unknown property/project"), when(F.col("likely_review_round") == "unknown", "unknown review round"),
        when((F.col("property_confidence") < 0.58) & (F.col("likely_property_project") != "unknown"), "low-confidence property/project inference or folder/filename conflict"),
        when(F.col("processing_error") != "", "processing warning/error"), when((suffix == "pdf") & ~F.col("text_found"), "possible scanned/drawing PDF or unsupported PDF text encoding"),
        when(suffix.isin(SHEETS) & ~F.col("table_source"), "spreadsheet lacks clear comment/response signals"),
    ))
    return files.withColumn("__r", reasons).where(F.size("__r") > 0).select("path", F.array_join("__r", " | ").alias("reasons"))


def round_summary(files: DataFrame) -> DataFrame:
    """Per city, project and round: counts of kinds, the primary source and the discovery status."""
    key = ["likely_city", "likely_property_project", "likely_review_round"]
    n = lambda c: F.sum(c.cast("long"))
    best = lambda c, *order: F.max_by("path", F.when(c, F.struct(*order, F.col("path")))).alias
    sure, short = F.col("confidence").alias("a"), (-F.length("path")).alias("b")
    kind = F.col("document_type")
    book, joint = F.col("table_source") & F.col("both"), kind == "combined_comment_response"
    said, answered = F.col("comments") & kind.isin(DEDICATED), F.col("responses") & kind.isin(DEDICATED)
    only = lambda c, name: F.max(F.when(c, F.struct(sure, short, F.col("path").alias("path"), F.col("table_source").alias("sheet")))).alias(name)
    rows = files.groupBy(*key).agg(
        F.count("*").alias("files"), n(F.col("table_source")).alias("spreadsheets"), n(kind.isin("city_comments", "correction_notice", "review_letter") & F.col("comments")).alias("comment_documents"), n(kind == "company_response").alias("response_documents"),
        n(joint).alias("combined_documents"), n(F.col("drawing_heavy")).alias("drawing_heavy_files"), only(book, "book"), only(joint, "joint"), only(said, "said"), only(answered, "answered"),
        n(~F.col("drawing_heavy") & ~kind.isin("drawing_or_plan", "supporting_document")).alias("__open"),
    )
    has = lambda c: F.col(c).isNotNull()
    source = F.when(has("book"), F.col("book.path")).when(has("joint"), F.col("joint.path")).when(has("said") & has("answered"), F.concat_ws(" | ", "said.path", "answered.path")).when(has("said"), F.col("said.path")).when(has("answered"), F.col("answered.path")).otherwise("")
    status = (
        F.when(has("book"), "spreadsheet_source_found").when(has("joint"), F.when(F.col("joint.sheet"), "spreadsheet_source_found").otherwise("dedicated_comment_response_source_found"))
        .when(has("said") & has("answered"), "separate_comment_and_response_sources_found").when(has("said"), "comments_found_response_missing").when(has("answered"), "response_found_comments_missing")
        .when(F.col("__open") == 0, "no_structured_source_drawings_only").otherwise("ambiguous_needs_review")
    )
    return rows.withColumn("primary_source", source).withColumn("discovery_status", status).drop("book", "joint", "said", "answered", "__open")


def report(files: DataFrame, rounds: DataFrame) -> str:
    """A short summary in Markdown, from counts by kind, city and status."""
    out = ["# Inventory", "", f"Files: {files.count()}", ""]
    for title, frame, column in (("Kinds", files, "document_type"), ("Cities", files, "likely_city"), ("Rounds", rounds, "discovery_status")):
        counts = frame.groupBy(column).count().orderBy(F.desc("count"), column).limit(100).collect()
        out += [f"## {title}", "", "| Name | Number |", "| --- | --- |", *[f"| {r[0]} | {r[1]} |" for r in counts], ""]
    return "\n".join(out)


def checkpoint(path: str, stage: str, status: str, spark, **more) -> None:
    """Append a stage's state to a table; the last one by time is what holds."""
    row = [(stage, status, {k: str(v) for k, v in more.items()})]
    spark.createDataFrame(row, "stage string, status string, details map<string,string>").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def checkpoints(spark, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy("stage").agg(F.max_by(F.struct("status", "details", "at"), "at").alias("r")).select("stage", "r.*")


def ingestion_report(sources: DataFrame) -> DataFrame:
    """One row of totals over processed sources: files by state, records, pages, tokens, seconds, failures."""
    d = complete(sources, processing_status="string", comment_count="long", response_count="long", pages_screened="long", pages_analysed="long", input_tokens="long", output_tokens="long", elapsed_seconds="double", processing_error="string")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    state = lambda *v: F.coalesce(F.sum(F.lower(K.blank(F.col("processing_status"))).isin(*v).cast("long")), F.lit(0))
    return d.agg(F.count("*").alias("files"), state("complete", "verified", "confirmed").alias("complete"), state("failed", "error").alias("failed"), state("skipped", "unchanged").alias("skipped"), *map(total, ("comment_count", "response_count", "pages_screened", "pages_analysed", "input_tokens", "output_tokens")), F.round(F.coalesce(F.sum("elapsed_seconds"), F.lit(0.0)), 4).alias("elapsed_seconds"), F.coalesce(F.sum((K.blank(F.col("processing_error")) != "").cast("long")), F.lit(0)).alias("errors"))


def _pages(s, d) -> DataFrame:
    """Web pages as files of a collection."""
    p, i = table(s, d, "pages"), F.col("page_id")
    city = F.element_at(F.array(*map(F.lit, ["san_jose", "menlo-park", "elsewhere"])), (i % 3 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ["Plan Check Comments.docx", "Response Letter.pdf", "drawing set.pdf", "soil report.pdf", "x.txt"])), (i % 5 + 1).cast("int"))
    return p.select(F.concat(F.lit("10 Main "), i.cast("string"), F.lit("_"), city, F.lit("/Building/"), (i % 2 + 2).cast("string"), F.when(i % 2 == 0, "nd").otherwise("rd"), F.lit(" Round of Comments/"), kind).alias("path"), F.lit("").alias("text"))


_KINDS = "['city_comments', 'company_response', 'drawing_or_plan', 'supporting_document', 'unknown'][page_id % 5 + 1]"

QUERIES = {
    "file_kinds": (
        lambda s, d: describe(_pages(s, d)).select("path", "likely_city", "city_confidence", "likely_review_round", "document_type", "confidence"),
        f"""SELECT '10 Main ' || page_id || '_' || ['san_jose', 'menlo-park', 'elsewhere'][page_id % 3 + 1] || '/Building/' || (page_id % 2 + 2) || CASE WHEN page_id % 2 = 0 THEN 'nd' ELSE 'rd' END || ' Round of Comments/' || ['Plan Check Comments.docx', 'Response Letter.pdf', 'drawing set.pdf', 'soil report.pdf', 'x.txt'][page_id % 5 + 1] AS path,
        ['San Jose', 'Menlo Park', 'unknown'][page_id % 3 + 1] AS likely_city, CAST(CASE WHEN page_id % 3 < 2 THEN 0.82 ELSE 0.0 END AS DOUBLE) AS city_confidence, CAST(page_id % 2 + 2 AS VARCHAR) AS likely_review_round, {_KINDS} AS document_type,
        CAST([0.71, 0.71, 0.82, 0.72, 0.25][page_id % 5 + 1] AS DOUBLE) AS confidence FROM pages""",
    ),
    "file_rounds": (
        lambda s, d: round_summary(describe(_pages(s, d))).groupBy("discovery_status").agg(F.count("*").alias("rounds"), F.sum("files").alias("files")),
        f"SELECT CASE {_KINDS} WHEN 'city_comments' THEN 'comments_found_response_missing' WHEN 'company_response' THEN 'response_found_comments_missing' WHEN 'unknown' THEN 'ambiguous_needs_review' ELSE 'no_structured_source_drawings_only' END AS discovery_status, count(*) AS rounds, CAST(count(*) AS BIGINT) AS files FROM pages GROUP BY 1",
    ),
    "files_to_review": (
        lambda s, d: review_rows(describe(_pages(s, d))).groupBy("reasons").agg(F.count("*").alias("n")),
        "SELECT concat_ws(' | ', CASE WHEN page_id % 5 = 4 THEN 'ambiguous document classification' END, CASE WHEN page_id % 3 = 2 THEN 'unknown city' END, CASE WHEN page_id % 5 IN (1, 2, 3) THEN 'possible scanned/drawing PDF or unsupported PDF text encoding' END) AS reasons, count(*) AS n FROM pages WHERE page_id % 5 IN (1, 2, 3, 4) OR page_id % 3 = 2 GROUP BY 1",
    ),
}
