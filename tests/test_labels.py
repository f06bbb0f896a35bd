"""Display forms, labels and cell-level sources."""

import io
import zipfile

from pyspark.sql import functions as F

from marginalia.functions import labels as L
from marginalia.sources import cells
from test_library import one, workbook


def test_labels(spark):
    assert one(spark, L.readable, "Response: a_x000D_ b ,\n c") == "a b, c"
    assert one(spark, L.readable_evidence, "a\nb\n\n----------\n c") == "a b\n\nc"
    assert str(one(spark, L.filename_date, "RS_09-24-2025_v 2024-01-02.xlsx")) == "2025-09-24"
    assert str(one(spark, L.filename_date, "x 20250515155401.pdf")) == "2025-05-15" and one(spark, L.filename_date, "2025-01057") is None
    assert str(one(spark, L.filename_date, "log_02-20-2026_5_04_PM.xlsx")) == "2026-02-20"
    assert one(spark, L.document_date_label, "a 2024-03-05") == "03/05/2024" and one(spark, L.document_date_label, "a") == ""
    assert one(spark, L.submission_label, "x 11th submission") == "11th submission" and one(spark, L.submission_label, "2nd Submission y") == "2nd submission"
    assert one(spark, L.trailing_date_note, "Fix door 3/16/2026: complete.").asDict() == {"body": "Fix door", "date": "03/16/2026", "note": "complete"}
    assert one(spark, L.reviewer_event, "Jo Doe\n1/2/2024 3:04 PM").asDict() == {"actor": "Jo Doe", "timestamp": "1/2/2024 3:04 PM"}
    assert one(spark, L.sheet_references, "see sheet A-2.1 & A3.04, on A9, sheet a2.1") == ["A.2.1", "A2.1", "A9", "A3.04"]
    assert one(spark, L.path_proximity, "a/b/c/x.pdf", "A/b/d/y.pdf") == 2
    long = "First sentence is long enough to stand. " + "word " * 200
    assert one(spark, lambda c: L.excerpt(c, 100), long).asDict() == {"text": "First sentence is long enough to stand.", "complete": True}
    assert one(spark, lambda c: L.excerpt(c, 60), "word " * 50).complete is False
    blocks = one(spark, L.display_blocks, "TITLE:\n\n1. item\n\nplain text")
    assert [(b.kind, b.start, b.end) for b in blocks] == [("heading", 0, 6), ("list_item", 8, 15), ("paragraph", 17, 27)]
    assert one(spark, L.normalized_identifier, " 12.0 ") == "12"
    assert str(one(spark, L.event_time, "1/2/2024 3:04 pm")) == "2024-01-02 15:04:00"
    assert one(spark, L.response_identity, "RESPONSE_ Door 3 wide") == "door 3 wide"
    got = one(spark, lambda a, b: L.fingerprint(a, F.lit("applicant"), F.lit(None), F.lit("I1"), F.lit(2), b, F.lit("door 3 not wide")), "S1", "2024-01-02")
    assert got == "s1|applicant_response||i1||2024-01-02|door 3 not wide|3|not"


def test_cells(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["h1", "h2"], ["1", "x"]]))
    got = {r.address: r.value for r in cells.xlsx_cells(spark, str(tmp_path)).collect()}
    assert got == {"A1": "h1", "B1": "h2", "A2": "1", "B2": "x"}
    assert cells.sheet_window(cells.xlsx_cells(spark, str(tmp_path)), "Comments", 1).count() == 4
    item = lambda level, t: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/></w:numPr></w:pPr><w:t>{t}</w:t></w:p>'
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>Intro</w:t></w:p>' + item(0, "A") + item(1, "a") + item(1, "b") + item(0, "B") + "</w:document>")
    (tmp_path / "b.docx").write_bytes(word.getvalue())
    rows = cells.docx_paragraphs(spark, str(tmp_path))
    assert [(r.label, r.text) for r in rows.orderBy("position").collect()] == [(None, "Intro"), ("1", "A"), ("1.1", "a"), ("1.2", "b"), ("2", "B")]
    assert [(r.text, r.children) for r in cells.merged_hierarchy(rows).orderBy("item").collect()] == [("A\na\nb", 2), ("B", 0)]
    (tmp_path / "c.csv").write_text('a,"b\nc"\n')
    assert [(r.column, r.value) for r in cells.csv_cells(spark, str(tmp_path / "c.csv")).collect()] == [("A", "a"), ("B", "b\nc")]
    base = spark.createDataFrame([("p", "x", "y")], "path string, city string, kind string")
    more = spark.createDataFrame([("p", "z", "")], "path string, city string, kind string")
    assert cells.override(base, more).first().asDict() == {"path": "p", "city": "z", "kind": "y", "overridden": ["city"]}


def test_register(spark):
    from marginalia.functions.register import register

    register(spark)
    row = spark.sql("SELECT norm_event_text('PC1: A  door') a, seq_ratio('abc', 'abd') b, token_jaccard('a b', 'b c') c, accent_free('José') d, collapse_text(' a  b ') e").first()
    assert tuple(row) == ("a door", 2 / 3, 1 / 3, "jose", "a b")
