"""Files as rows: an inventory of a folder, light inspection by kind, and delimited or JSON tables.

Binary documents are read by Spark's ``binaryFile`` source, so any file system
will do and files are spread over tasks; a file is parsed where it is read.
"""

from __future__ import annotations

import csv
import email
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.plans.records import table

# What counts as a header, and name spaces of office files.
HEADER_WORDS = {"comment", "comments", "response", "responses", "discipline", "number", "no", "reviewer", "sheet", "date", "status", "ref", "item"}
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path string, extension string, size long, sha256 string, text string, sheets array<string>, pages int, error string"
CELLS = "path string, sheet string, row int, cells map<string,string>"


def safe_text(raw: bytes) -> str:
    """The first of UTF-8, UTF-16 with its mark, cp1252 and latin-1 that decodes."""
    marked = raw[:2] in (b"\xff\xfe", b"\xfe\xff")
    for name in (["utf-16"] if marked else []) + ["utf-8-sig", "cp1252", "latin-1"]:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def xlsx_rows(raw: bytes) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(sheet, row number, letter -> text) of each row with a cell."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        parts = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for title, part in zip(titles, parts):
            for row in ElementTree.fromstring(z.read(part)).iter(f"{_MAIN}row"):
                cells = {}
                for c in row.iter(f"{_MAIN}c"):
                    value = c.find(f"{_MAIN}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else (value.text if value is not None else "")
                    if c.get("t") == "s" and text:
                        text = shared[int(text)]
                    if text:
                        cells[re.match("[A-Z]+", c.get("r"))[0]] = text
                if cells:
                    yield title, int(row.get("r")), cells


def docx_text(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))


def ods_text(raw: bytes) -> tuple[str, list[str]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    tables = [e for e in root.iter() if e.tag.endswith("}table")]
    names = [next((v for k, v in t.attrib.items() if k.endswith("}name")), "") for t in tables]
    rows = ["\t".join("".join(c.itertext()) for c in r if c.tag.endswith("}table-cell")) for t in tables for r in t.iter() if r.tag.endswith("}table-row")]
    return "\n".join(rows), names


def pdf_text(raw: bytes) -> tuple[str, int]:
    """Strings shown by the page streams, and the number of pages; no layout."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)endstream", raw, re.S):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        for s in re.finditer(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|')|\[((?:[^\]\\]|\\.)*)\]\s*TJ", data, re.S):
            whole = s[1] if s[1] is not None else b"".join(re.findall(rb"\(((?:[^()\\]|\\.)*)\)", s[2]))
            out.append(re.sub(rb"\\([()\\])", rb"\1", whole).decode("latin-1"))
    return "\n".join(out), len(re.findall(rb"/Type\s*/Page\b", raw))


def eml_text(raw: bytes) -> str:
    message = email.message_from_bytes(raw)
    bodies = [p.get_payload(decode=True) or b"" for p in message.walk() if p.get_content_type() == "text/plain"]
    heads = [f"{h}: {message[h]}" for h in ("From", "To", "Date", "Subject") if message[h]]
    return "\n".join(heads + [safe_text(b) for b in bodies])


def choose_header(rows: list[list[str]], first: int = 10) -> int:
    """Of the first rows the one with most header words; the first of equals."""
    score = lambda r: sum(w in HEADER_WORDS for c in r for w in re.findall("[a-z]+", c.lower()))
    return max(range(min(first, len(rows))), key=lambda i: (score(rows[i]), -i), default=0)


def inspect(path: str, raw: bytes) -> dict:
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    out = {"path": path, "extension": kind, "size": len(raw), "text": "", "sheets": [], "pages": None, "error": None}
    try:
        if kind == "xlsx":
            rows = list(xlsx_rows(raw))
            out |= {"text": "\n".join("\t".join(c.values()) for _, _, c in rows), "sheets": list(dict.fromkeys(s for s, _, _ in rows))}
        elif kind == "docx":
            out["text"] = docx_text(raw)
        elif kind == "ods":
            out["text"], out["sheets"] = ods_text(raw)
        elif kind == "pdf":
            out["text"], out["pages"] = pdf_text(raw)
        elif kind == "eml":
            out["text"] = eml_text(raw)
        else:
            out["text"] = safe_text(raw)
    except Exception as e:  # a broken file is a row that says so
        out["error"] = f"{type(e).__name__}: {e}"[:200]
    return out


def inventory(spark: SparkSession, folder: str, known: DataFrame | None = None, pattern: str = "*") -> DataFrame:
    """A row per file below ``folder``; files that ``known`` has with equal size and time are not read again."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    if known is not None:
        found = found.join(known.select("path", F.col("size").alias("length"), "modificationTime"), ["path", "length", "modificationTime"], "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for frame in frames:
            rows = [inspect(p, bytes(c)) | {"sha256": hashlib.sha256(c).hexdigest()} for p, c in zip(frame.path, frame.content)]
            yield pd.DataFrame(rows, columns=names)

    return found.mapInPandas(run, SCHEMA)


def worksheet_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sheet, row, letter -> text) of all workbooks below a folder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, s, r, c) for p, raw in zip(frame.path, frame.content) for s, r, c in xlsx_rows(bytes(raw))]
            yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(folder)
    return found.mapInPandas(run, CELLS)


def comments_of_sheets(rows: DataFrame, header_rows: int = 10) -> DataFrame:
    """Rows below a sheet's header as (path, sheet, row, number, comment, response), columns found by the header's words."""
    from pyspark.sql import Window

    entries = F.map_entries("cells")
    score = F.aggregate(entries, F.lit(0), lambda a, e: a + F.lower(e["value"]).rlike("\\b(" + "|".join(sorted(HEADER_WORDS)) + ")\\b").cast("int"))
    heads = rows.where(F.col("row") <= header_rows).withColumn("score", score)
    first = Window.partitionBy("path", "sheet").orderBy(F.desc("score"), "row")
    head = heads.withColumn("n", F.row_number().over(first)).where("n = 1 and score > 0").select("path", "sheet", F.col("row").alias("head"), F.col("cells").alias("names"))
    column = lambda words: F.get(F.filter(F.map_entries("names"), lambda e: F.lower(e["value"]).rlike(f"\\b({words})\\b")), 0)["key"]
    joined = rows.join(head, ["path", "sheet"]).where(F.col("row") > F.col("head"))
    value = lambda words: F.try_element_at("cells", column(words))
    return joined.select("path", "sheet", "row", value("number|no|ref|item").alias("number"), value("comments?").alias("comment"), value("responses?").alias("response")).where("comment is not null")


def dataset(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """The rows of one collection of a JSON dataset file; empty strings are nulls."""
    rows = spark.read.option("multiLine", "true").json(path).select(F.explode(collection).alias("r")).select("r.*")
    strings = {n for n, t in rows.dtypes if t == "string"}
    return rows.select(*[F.when(F.trim(n) != "", F.col(n)).alias(n) if n in strings else F.col(n) for n in rows.columns])


def delimited(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("sep", separator).csv(path)


def pages_text(pages: DataFrame) -> DataFrame:
    """url parts and the visible length of raw pages, by expressions."""
    bare = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</\\1>", " "), "(?s)<[^>]*>", " ")
    return pages.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.length(F.trim(F.regexp_replace(bare, "\\s+", " "))).alias("visible_chars"))


def number_items(text: str) -> list[tuple[int, str]]:
    """Numbered items of OCR lines: an item goes on until the next number; a stop line ends the section."""
    out: list[tuple[int, str]] = []
    for line in csv.reader(io.StringIO(text), delimiter="\0", quoting=csv.QUOTE_NONE):
        line = " ".join(line).strip()
        if re.match(r"(?i)^(end of comments|sincerely|cc:)", line):
            break
        if m := re.match(r"^(\d{1,3})[.)]\s+(.*)", line):
            out.append((int(m[1]), m[2]))
        elif out and line:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line}")
    return out


QUERIES = {
    "page_hosts": (
        lambda s, d: pages_text(table(s, d, "pages")).groupBy("host").agg(F.count("*").alias("pages")),
        "SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1",
    ),
    "page_text": (lambda s, d: pages_text(table(s, d, "pages")), None),
    "file_identity": (
        lambda s, d: table(s, d, "pages").groupBy(F.sha2(F.encode("html", "UTF-8"), 256).alias("sha")).agg(F.min("page_id").alias("canonical"), F.count("*").alias("copies")),
        "SELECT sha256(html) AS sha, min(page_id) AS canonical, count(*) AS copies FROM pages GROUP BY 1",
    ),
}
