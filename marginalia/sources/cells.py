"""Cell and paragraph level sources: addresses, formulas, merged ranges, list numbering, sheet windows, overrides."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.sources.files import _MAIN, _WORD

CELL = "path string, sheet string, address string, row int, value string, formula string, merged string"
PARAGRAPH = "path string, position int, level int, label string, text string"


def _cells(path: str, raw: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        parts = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for title, part in zip(titles, parts):
            root = ElementTree.fromstring(z.read(part))
            merged = {m.get("ref").split(":")[0]: m.get("ref") for m in root.iter(f"{_MAIN}mergeCell")}
            for c in root.iter(f"{_MAIN}c"):
                value, formula = c.find(f"{_MAIN}v"), c.find(f"{_MAIN}f")
                text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else value.text if value is not None else None
                if c.get("t") == "s" and text:
                    text = shared[int(text)]
                if text or formula is not None:
                    at = c.get("r")
                    yield path, title, at, int(re.search(r"\d+", at)[0]), text, formula.text if formula is not None else None, merged.get(at)


def _paragraphs(path: str, raw: bytes) -> Iterator[tuple]:
    """Paragraphs with the running number of their list level; deeper levels start anew under each item."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    counts: dict[int, int] = {}
    for i, p in enumerate(root.iter(f"{_WORD}p")):
        level = p.find(f".//{_WORD}ilvl")
        label, depth = None, None
        if level is not None:
            depth = int(level.get(f"{_WORD}val"))
            counts = {k: v for k, v in counts.items() if k <= depth}
            counts[depth] = counts.get(depth, 0) + 1
            label = ".".join(str(counts.get(k, 1)) for k in range(depth + 1))
        yield path, i, depth, label, "".join(t.text or "" for t in p.iter(f"{_WORD}t"))


def _parsed(spark: SparkSession, folder: str, pattern: str, parse, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, raw in zip(frame.path, frame.content) for r in parse(p, bytes(raw))]
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).mapInPandas(run, schema)


def xlsx_cells(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder, "*.xlsx", _cells, CELL)


def docx_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder, "*.docx", _paragraphs, PARAGRAPH)


def csv_cells(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A delimited file in the cell model: row number and letter to text."""
    rows = spark.read.option("multiLine", "true").option("escape", '"').option("sep", separator).csv(path)
    place = F.monotonically_increasing_id()
    return rows.select(place.alias("row"), F.posexplode(F.array(*[F.col(c) for c in rows.columns])).alias("i", "value")).select("row", X.column_letters(F.col("i") + 1).alias("column"), "value").where("value is not null")


def sheet_window(cells: DataFrame, sheet: str, focus: int, size: int = 50, above: int = 12) -> DataFrame:
    """The rows of a sheet about a row in focus; sizes from 10 to 250."""
    first = max(1, focus - above)
    return cells.where((F.col("sheet") == sheet) & F.col("row").between(first, first + min(max(size, 10), 250) - 1))


def merged_hierarchy(paragraphs: DataFrame) -> DataFrame:
    """Items below a top-level item belong to it: one row per top-level item with its text and how many follow."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = paragraphs.withColumn("item", F.sum((F.col("level") == 0).cast("int")).over(w)).where("item > 0")
    texts = F.array_sort(F.collect_list(F.struct("position", "text")))  # of one item of one document
    return grouped.groupBy("path", "item").agg(F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("text"), (F.count("*") - 1).alias("children"))


def override(inventory: DataFrame, overrides: DataFrame, key: str = "path") -> DataFrame:
    """A person's values take the place of inferred ones, with a note."""
    fields = [c for c in overrides.columns if c != key and c in inventory.columns]
    other = overrides.select(key, *[F.when(F.trim(c) != "", F.col(c)).alias(f"__{c}") for c in fields])
    joined = inventory.join(other, key, "left")
    changed = F.array_compact(F.array(*[F.when(F.col(f"__{c}").isNotNull(), F.lit(c)) for c in fields]))
    out = joined.withColumn("overridden", changed).withColumns({c: F.coalesce(f"__{c}", c) for c in fields})
    return out.drop(*[f"__{c}" for c in fields])


def finished(trace: DataFrame) -> DataFrame:
    return trace.where(F.col("status").isin("completed", "failed", "status_unknown"))
