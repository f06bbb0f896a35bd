"""Rules, sources, sinks, plans and streams of the library proper."""

import io
import random
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from compare import duck, spark_rows
from marginalia import catalog
from marginalia.functions import identity as I
from marginalia.functions import relevance
from marginalia.functions import similarity as S
from marginalia.functions import taxonomy as C
from marginalia.functions import text as X
from marginalia.operators import retrieval, sets, spreadsheets, tags, timeline, trust
from marginalia.operators.components import connected_components
from marginalia.plans import analysis
from marginalia.plans.records import records
from marginalia.sources import audit, files, models, sinks
from marginalia.storage import Rows, cut, new_folder, pick
from marginalia.streaming import ledger

DIR = "/root/testdata/sf0.001"


def one(spark, build, *values):
    df = spark.createDataFrame([values], ", ".join(f"v{i} string" for i in range(len(values))))
    return df.select(build(*[F.col(f"v{i}") for i in range(len(values))]).alias("r")).first().r


def test_identity_form():
    assert X.identity_form("PC1: PC1: Provide  A3.04 &amp; 1/2\r\nslope_x000D_ --------- no") == "provide a3.04 1/2 slope no"
    assert X.identity_form("(b) pc 2 - Ünder 5'-0\"") == "nder 5 0"
    assert X.identity_form(None) == ""


def test_text_columns(spark):
    assert one(spark, X.parameter_tokens, "door 3'-0 a3.04 wide") == ["3'-0", "a3.04"]
    assert one(spark, X.negation_tokens, "not without a door") == ["not", "without"]
    assert one(spark, X.term_root, "entries") == "entry" and one(spark, X.term_root, "glass") == "glass"
    assert one(spark, X.coherent_units, "Head\n1. First item is long enough here\n2. Second item is long enough") == ["Head\n1. First item is long enough here", "Head\n2. Second item is long enough"]
    assert one(spark, X.coherent_units, "no items") == ["no items"]
    assert one(spark, X.recurring_title, "PC2: 3. Provide a door. And more.") == "Provide a door."
    assert one(spark, X.compact_path, "a/b/c.pdf | d/e.xlsx") == "c.pdf + e.xlsx"
    assert one(spark, X.normalize_event_type, "Follow-Up") == "reviewer_follow_up"
    assert one(spark, X.reconstruct_verbatim, "pro-\nvide a\nlong line\n1. item") == "provide a long line\n1. item"
    assert one(spark, X.parse_cell_range, "B2:AA9").asDict() == {"first_row": 2, "first_column": 2, "last_row": 9, "last_column": 27}
    assert one(spark, X.split_reviewer, "Planning - Jo Doe").asDict() == {"discipline": "Planning", "reviewer": "Jo Doe"}
    assert one(spark, X.accent_free, " San José, ") == "san jose"


def test_dates_and_rounds(spark):
    d = lambda v: str(one(spark, I.event_date, v))
    assert d("x 2024-3-5 y") == "2024-03-05" and d("3/16/2026: done") == "2026-03-16" and d("1.2.24") == "2024-01-02" and d("25-033-701") == "None"
    assert str(one(spark, I.named_date, "Issued May 4, 2026")) == "2026-05-04"
    r = lambda v: one(spark, I.round_number, v)
    assert r("May 4, 2026") is None and r("Initial review") == 1 and r("PC3") == 3 and r("round #2") == 2 and r("7") == 7 and r("file 9") is None
    assert one(spark, I.address_key, "100 First Street, San Jose, CA 95112") == "100 1st st san jose"


def test_match_classes(spark):
    pairs = [("a b c", "a b c", "EXACT_DUPLICATE"), ("door 3", "door 4", "DISTINCT"), ("not a door", "a door", "DISTINCT"), ("the comment remains open", "the comment open", "DISTINCT"), ("", "a", "DISTINCT")]
    long = "provide the clear width of every door on the plan and show the swing of each leaf in the schedule with hardware"
    pairs += [(long, long.replace("leaf", "leafs"), "HIGH_CONFIDENCE_DUPLICATE" if False else None)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").withColumn("s", S.signals(F.col("a"), F.col("b"))).withColumn("q", S.sequence_ratio("a", "b"))
    got = [(r.a, r.m, r.q) for r in df.withColumn("m", S.match_class(F.col("a"), F.col("b"), F.col("s"), F.col("q"))).collect()]
    for (a, b, want), (_, m, q) in zip(pairs, got):
        assert want is None or m == want
        assert abs(q - (SequenceMatcher(None, a, b).ratio() if a and b else 0)) < 1e-12
    ext = spark.createDataFrame([("revised as asked", "revised as asked see sheet a2"), ("revised", "changed see sheet")], "a string, b string")
    assert [r.x for r in ext.select(S.is_extension(F.col("a"), F.col("b"), F.lit(0.7)).alias("x")).collect()] == [True, False]


def test_topics(spark):
    t = lambda text, d="Planning": one(spark, C.classify_topic, text, d).topic_id
    assert t("Protect tree roots") == "TREES_TREE_PROTECTION_AND_IMPACT_MITIGATION"
    assert t("door clear width") == "DOORS_DOOR_DIMENSIONS_AND_CLEAR_WIDTH"
    assert t("provide drain") == "DRAINAGE_STORMWATER" and t("hello") == "GENERAL_PLANNING_REVIEW"


def test_topics_of_a_word_at_any_place(spark):
    """A topic's word counts where it is whole, wherever it stands, also across the discipline's end."""
    t = lambda text, d="Planning": one(spark, C.classify_topic, text, d).topic_id
    for n in range(30, 45):
        assert t("x" * n + " treen and so on") == "GENERAL_PLANNING_REVIEW" and t("x" * n + " tree and so on") == "TREES_TREE_REVIEW"
    assert t("plan of it", "Site") == "GRADING_SITE_WORK" and t("planned", "Site") == "GENERAL_SITE_REVIEW"


def test_topic_queries_at_a_word_cut_anywhere(spark, tmp_path):
    rows = [(i, "x" * i + " treen and so on", f"s{i % 3}", "en") for i in range(25, 50)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("topic_counts", "topics"):
        assert spark_rows(catalog.queries()[name](spark, str(tmp_path))) == duck(catalog.oracle_sql()[name], str(tmp_path))


def test_trust(spark):
    assert one(spark, trust.is_general_review_text, " - Noted. ") and not one(spark, trust.is_general_review_text, "Provide brace at ridge")
    assert one(spark, trust.is_malformed_rollup, "A. PC1 x pc2: y PC3: z", "Response.pdf")
    assert one(spark, trust.is_reference_note, "Building Dept Reviewers, office phone 1")


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_rows_and_pick(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x")], "id long, text string, Text string")
    rows = Rows(df)
    assert rows.at("text") == "__c1" and rows.restored(rows.frame).columns == df.columns
    assert rows.frame.select(*rows.key).distinct().count() == 2
    assert pick(df, text="string").first().text == "a"
    with pytest.raises(ValueError):
        pick(df, other="string")


def test_timeline(spark):
    pages = spark.createDataFrame([(1, p, p in (1, 2, 5, 9)) for p in range(1, 10)], "d long, p long, hit boolean")
    assert sorted((r["first"], r["last"]) for r in timeline.islands(pages, "d", "p", F.col("hit")).collect()) == [(1, 5), (9, 9)]
    b = spark.range(1).select(timeline.page_batches(F.lit(10), 4, 1).alias("b")).first().b
    assert [(x["first"], x["last"]) for x in b] == [(1, 4), (4, 7), (7, 10)]


def test_sets(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id long, t string, ok boolean")
    new = spark.createDataFrame([(1, "x", False), (2, "y", False), (3, "z", False)], "id long, t string, ok boolean")
    got = {r.id: (r.t, r.action) for r in sets.upsert(old, new, "id", F.col("ok")).collect()}
    assert got == {1: ("a", "skipped"), 2: ("y", "updated"), 3: ("z", "inserted")}
    assert [tuple(r) for r in sets.conflicts(old, new, "id", "t", F.col("ok")).collect()] == [(1, "confirmed_text_differs")]
    assert sets.insert_absent(old, new, ["id"]).count() == 3 and sets.same_rows(old, old).count() == 0


def test_plans(spark):
    for raw in ({"intent": "hack"}, {"operations": ["drop"]}, {"subject": "select a from b"}, {"filters": {"city": "x; delete from t"}}):
        with pytest.raises(ValueError):
            analysis.validate(raw)
    assert analysis.route("How many comments in src1?").intent == "count"
    assert analysis.route("breakdown by city").operations == ["group_by_city"]
    assert analysis.route("history of doors").operations == ["load_issue_timelines"]
    df = records(spark, DIR)
    out = analysis.run(df, analysis.validate({"subject": "the", "operations": ["load_previous_result_set", "group_by_city"]}), df.limit(5))
    assert out["rows"].count() == 5 and out["breakdowns"].where("kind <> 'city'").count() == 0
    with pytest.raises(ValueError):
        trust.matches_filters(df, {"text": "x"})


def workbook(rows):
    cells = lambda r, row: "".join(f'<c r="{chr(65 + i)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(row))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="Comments"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>" + "".join(f'<row r="{i}">{cells(i, r)}</row>' for i, r in enumerate(rows, 1)) + "</sheetData></worksheet>")
    return out.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["Log"], ["Number", "Comment", "Response"], ["1", "Fix door", "Done"], ["2", "Fix wall"]]))
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>One</w:t></w:p><w:p><w:t>Two</w:t></w:p></w:document>')
    (tmp_path / "b.docx").write_bytes(word.getvalue())
    (tmp_path / "c.eml").write_bytes(b"Subject: Hi\nContent-Type: text/plain\n\nBody")
    (tmp_path / "d.pdf").write_bytes(b"%PDF /Type /Page\nstream\n(Hello) Tj\nendstream")
    (tmp_path / "e.txt").write_bytes("grün".encode("cp1252"))
    (tmp_path / "f.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.inventory(spark, str(tmp_path)).collect()}
    assert got["b.docx"].text == "One\nTwo" and got["c.eml"].text == "Subject: Hi\nBody" and (got["d.pdf"].text, got["d.pdf"].pages) == ("Hello", 1)
    assert got["e.txt"].text == "grün" and got["f.docx"].error and got["a.xlsx"].sheets == ["Comments"]
    rows = files.comments_of_sheets(files.worksheet_rows(spark, str(tmp_path))).orderBy("row").collect()
    assert [(r.number, r.comment, r.response) for r in rows] == [("1", "Fix door", "Done"), ("2", "Fix wall", None)]
    known = spark.read.format("binaryFile").load(str(tmp_path / "e.txt")).select("path", F.col("length").alias("size"), "modificationTime")
    assert files.inventory(spark, str(tmp_path), known).count() == 5
    (tmp_path / "data.json").write_text('{"comments": [{"id": "1", "t": ""}, {"id": "2", "t": "x"}]}')
    assert [tuple(r) for r in files.dataset(spark, str(tmp_path / "data.json"), "comments").collect()] == [("1", None), ("2", "x")]
    assert files.number_items("1. a\nb\n2) c\nSincerely\n3. d") == [(1, "a b"), (2, "c")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [1, 2]), (2, 'a "b"\nc', None)], "id long, t string, l array<int>")
    sinks.write_csv(df, str(tmp_path / "csv"), ["id", "t", "l", "gone"])
    back = files.delimited(spark, str(tmp_path / "csv")).orderBy("id").collect()
    assert [r.id for r in back] == ["1", "2"] and back[1].t == 'a "b"\nc' and back[0].l == "[1,2]"
    for n in (1, 2):
        sinks.replace_table(df.limit(n), str(tmp_path / "table"))
        assert spark.read.parquet(str(tmp_path / "table")).count() == n
    sinks.append_ledger(df.select("id"), str(tmp_path / "ledger"))
    sinks.append_ledger(df.select("id"), str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "ledger")).count() == 4


def test_streams(spark):
    stream = ledger.drain(ledger.new_documents(ledger.follow(spark, DIR, "labels"), "doc_id"), "append")
    assert stream.count() == spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id").distinct().count()
    results = spark.sql("SELECT 1 AS id, timestamp'2026-01-01 00:00:00' AS created_at UNION ALL SELECT 2, timestamp'2026-01-01 00:40:00'")
    import datetime

    assert [r.id for r in ledger.live_results(results, datetime.datetime(2026, 1, 1, 0, 45)).collect()] == [2]


def test_retrieval(spark):
    df = records(spark, DIR)
    assert retrieval.tfidf(df, "the of").count() == 0
    rows = tags.described(df)
    assert tags.index_digest(rows).collect() == tags.index_digest(rows.repartition(3)).collect()
    texts = [(1, "a", "p1", "Provide tree protection fencing and root pruning"), (2, "b", "p2", "Tree protection zone on the plan"), (3, "c", "p3", "Grading and drainage only"), (4, "d", "p4", "fire-rated wall at the property line")]
    few = spark.createDataFrame(texts, "comment_id long, city string, project_id string, text string")
    got = {r.comment_id: (r.stage, r.relevant) for r in tags.retrieve(few, "how were tree protection measures handled", "compare").collect()}
    assert got == {1: (1, True), 2: (1, True)}
    late = {r.comment_id: (r.stage, r.relevant, r.suggested_tag) for r in tags.retrieve(few, "opening protection").collect()}
    assert {k: v[:2] for k, v in late.items()} == {1: (3, False), 2: (3, False), 3: (3, False), 4: (3, False)}
    assert tags.add_confirmed(few, spark.createDataFrame([(3, "drainage", "confirmed"), (4, "x", "pending")], "comment_id long, tag string, status string")).where("size(event_tags) > 0").count() == 1


def test_questions_and_evidence(spark):
    assert [relevance.topic_from_query(q) for q in ("fire separation?", "tree impact rules", "trees", "door clear width", "beam", "hello")] == ["fire_separation", "tree_impact_mitigation", "tree_related", "clear_width", "structural_calculations", None]
    assert [relevance.controlled_topic(q) for q in ("garage", "fire garage", "door size and rating", "door rating", "window", "tree roots protection")] == [None, "fire_separation", "door_attributes", "door_rating", None, "tree_protection"]
    judge = lambda subject, text: one(spark, lambda t, d: relevance.local_relevance(subject, t, d), text, "Planning")
    assert judge("fire separation", "Grading and drainage plan").is_relevant is False and judge("fire separation", "Grading and drainage plan").record_topic == "grading and drainage permit"
    assert judge("fire separation", "Provide a rated assembly").confidence == 0.96 and judge("drainage", "show the swale and runoff").confidence == 0.9
    assert judge("door size", "bird-safe glass near the door").is_relevant is False and judge("door size", "door shall be 36 inches wide").is_relevant
    assert judge("tree protection", "list each tree").record_topic == "tree inventory, location, or removal" and judge("beam sizes", "check the girder").is_relevant
    t = one(spark, lambda a, d: relevance.infer_tags(a, d, F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")), "Protect tree roots; submit arborist report", "Planning")
    assert t.issue_tags == ["tree_protection", "tree_related"] and t.event_tags == ["arborist_documentation", "tree_impact_mitigation"]


def test_spreadsheets(spark):
    head = {c: v for c, v in zip("ABCDEFGH", ["Ref #", "Reviewed By", "Type", "View", "Enter your Comment Response here", "Discussion", "Cycle", "Status"])}
    cells = [("s", "Log", 2, c, v) for c, v in head.items()] + [("s", "Log", 3, "A", "12.0"), ("s", "Log", 3, "B", "Building Plan Review Al 7/11/25 3:50 PM"), ("s", "Log", 3, "C", "Fix door"), ("s", "Log", 3, "E", "Done"), ("s", "Log", 4, "E", "no comment here"), ("t", "X", 1, "A", "nothing")]
    df = spark.createDataFrame(cells, "source string, sheet string, row int, column string, value string")
    schemas = spreadsheets.detect_schemas(df)
    assert [(r.source, r.template, r.header_row) for r in schemas.collect()] == [("s", "projectdox_review_comments_v1", 2)]
    rows = {r.row: r for r in spreadsheets.evidence_rows(df, schemas).collect()}
    assert rows[3].printed_id == "12" and rows[3].department == "Building Plan Review" and rows[3].event_date == "2025-07-11" and rows[3].comment_unit == "XLSX:Log:C3" and rows[3].paired and not rows[4].is_comment
    check = spreadsheets.verify_locally(spreadsheets.evidence_rows(df, schemas)).first()
    assert (check.comments, check.orphans, check.same_row_links_correct) == (1, 1, False)
    said = one(spark, spreadsheets.discussion_events, "Reviewer Response: Al B - 7/11/25 3:50 PM not shown -------------------- Responded by: Cy - 7/1/2025 added")
    assert [(e.event_type, e.actor, e.occurred_at, e.exact_text) for e in said] == [("reviewer_follow_up", "Al B", "2025-07-11T15:50", "not shown"), ("applicant_response", "Cy", "2025-07-01T00:00", "added")]
    assert [e.event_type for e in one(spark, spreadsheets.discussion_events, "just a note")] == ["discussion_note"] and one(spark, spreadsheets.discussion_events, " ") == []


def test_model_steps(spark):
    units = spark.createDataFrame([("1:1", "ab"), ("1:2", "c")], "unit_id string, text string")
    none = spark.createDataFrame([], "unit_id string, input_hash string, version string, embedding array<double>")
    size = lambda texts: [[float(len(t))] for t in texts]
    index = cut(models.sync(units, none, size, "m1"), "index")
    assert {r.unit_id: r.embedding for r in index.collect()} == {"1:1": [2.0], "1:2": [1.0]}

    def fails(texts):
        raise AssertionError("nothing is to be embedded again")

    assert models.sync(units, index, fails, "m1").count() == 2 and models.sync(units.limit(1), index, fails, "m1").count() == 1
    with pytest.raises(Exception, match="vectors for"):
        models.sync(units, none, lambda t: [[1.0]] * (len(t) + 1), "m1").collect()
    asked = spark.createDataFrame([("a",), ("b",)], "id string")
    answers = spark.createDataFrame([("a", "1.7"), ("b", "0.1"), ("x", "0.9"), ("a", "oops")], "id string, score string")
    assert [tuple(r) for r in models.ranked(answers, asked).collect()] == [("a", 1.0)]
    said = spark.createDataFrame([("a", True, "Fix  the DOOR", 0.9), ("b", True, "made up", 0.9)], "id string, is_relevant boolean, supporting_excerpt string, confidence double")
    texts = spark.createDataFrame([("a", "please fix the door now"), ("b", "other")], "id string, text string")
    assert {r.id: r.accepted for r in models.supported(said, texts).collect()} == {"a": True, "b": False}
    assert models.rewrites("q", [{"query": "Q", "preserves_meaning": True}, {"query": "r", "preserves_meaning": True}, {"query": "s"}]) == ["r"]
    assert models.analysis({"subject": "door", "technical_terms": "x"}, "per CBC 10.2")["code_sections"] == ["CBC 10.2"] and models.analysis(None, " q ")["semantic_query"] == "q"
    assert models.display({"blocks": [{"kind": "list", "items": []}], "secondary_references": [{"sheet": "a1", "confidence": "0.6"}, {"sheet": "a2", "confidence": 0.1}]}, "t")["secondary_references"][0]["sheet"] == "A1"
    made = models.enrich(units.withColumn("input_hash", F.lit("h")), "unit_id", lambda t: {"display_text": t.upper()})
    assert {r.unit_id for r in made.where("result like '%AB%'").collect()} == {"1:1"}


def test_audit(spark, tmp_path):
    city = lambda p, t: one(spark, audit.infer_city, p, t)
    assert (city("a_sanjose/x.pdf", "").city, city("a_sanjose/x.pdf", "City of Fremont").city) == ("San Jose", "Fremont") and city("x", "y").city == "unknown"
    assert city("x", "1 Main St, Palo Alto, CA 94301").confidence == 0.99 and city("menlo-park/x", "sjpermits.org").conflicts == ["Menlo Park"]
    p = one(spark, audit.infer_project, "12_main_st_san_jose/Building/lot 2/1st Round Comments/lot 3.pdf")
    assert p.project == "12 Main St — Building / Lot 2" and p.confidence == 0.55
    rows = [("p/2nd Review/Plan Check Comments.xlsx", "", 1, 1, None, None), ("p/2nd Review/map.pdf", "", 0, 0, [1, 2], 2), ("q/x.txt", "", 0, 0, None, None)]
    files_ = audit.describe(spark.createDataFrame(rows, "path string, text string, comment_columns int, response_columns int, page_chars array<int>, pages int"))
    got = {r.path: r for r in files_.collect()}
    assert got["p/2nd Review/Plan Check Comments.xlsx"].document_type == "combined_comment_response" and got["p/2nd Review/map.pdf"].drawing_heavy and got["q/x.txt"].document_type == "unknown"
    rounds = {r.likely_review_round: r for r in audit.round_summary(files_).collect()}
    assert rounds["2"].discovery_status == "spreadsheet_source_found" and rounds["unknown"].discovery_status == "ambiguous_needs_review"
    fixed = audit.apply_overrides(files_, spark.createDataFrame([("q/x.txt", "Fremont", "", "seen")], "path string, likely_city string, document_type string, note string"))
    assert [(r.likely_city, r.document_type, r.override_note) for r in fixed.where("overridden").collect()] == [("Fremont", "unknown", "seen")]
    assert {r.path for r in audit.review_rows(files_).collect()} >= {"q/x.txt", "p/2nd Review/map.pdf"} and "| unknown | 1 |" in audit.report(files_, audit.round_summary(files_))
    for status in ("running", "complete"):
        audit.checkpoint(str(tmp_path / "stages"), "extract", status, spark, files=3)
    assert [(r.stage, r.status, r.details["files"]) for r in audit.checkpoints(spark, str(tmp_path / "stages")).collect()] == [("extract", "complete", "3")]
    one_row = audit.ingestion_report(spark.createDataFrame([("complete", 2), ("failed", 1)], "processing_status string, comment_count long")).first()
    assert (one_row.files, one_row.complete, one_row.failed, one_row.comment_count) == (2, 1, 1, 3)


def test_cut_is_shared(spark):
    assert new_folder(spark, "x").startswith("file:///")
    assert cut(spark.range(3), "x").count() == 3


def test_entry_without_llm(spark, monkeypatch):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    monkeypatch.setattr(e, "_llm", lambda: ({}, {}))
    assert "overview" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_nearest_vectors_in_blocks(spark):
    rows = [(i, [float(i % 7), float(i % 11), 1.0]) for i in range(1100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = retrieval.nearest_vectors(df, df, 2).collect()
    assert len(got) == 2 * len(rows) and len({r.query_id for r in got}) == len(rows)
    some = df.where("vec_id % 20 = 0")
    whole = {tuple(r) for r in retrieval.nearest_vectors(df, some, 3).collect()}
    assert whole == {tuple(r) for r in retrieval.nearest_vectors(df, some, 3, block=10).collect()} and len(whole) == 3 * 55


def test_search_evaluation_asks_every_twentieth(spark, monkeypatch):
    asked = []
    true = retrieval.nearest_vectors
    monkeypatch.setattr(retrieval, "nearest_vectors", lambda v, q, k: asked.extend(r.vec_id for r in q.select("vec_id").collect()) or true(v, q, k))
    retrieval.QUERIES["search_evaluation"][0](spark, "/root/testdata/sf0.001").collect()
    assert sorted(asked) == sorted(r.vec_id for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id % 20 = 0").collect())


def test_without_both_llm_folders(tmp_path):
    """A copy without the subpackage, its tests and the pipeline imports and has the library's queries, all with runnable names."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'overview' in q and set(o) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) > 100, out.stderr
