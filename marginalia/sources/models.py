"""Model steps as plug-ins: the caller brings a function, this module batches, checks and keeps what it returns.

No model is called from here.  A step takes a Python function over a batch and
runs it in Arrow batches on the executors; what it returns is checked the way
results of a model must be: only ids that were asked, scores from 0 to 1, whole
vectors, quotations that are in the text.  Digests of inputs tell what has been
done before, so only new and changed rows are sent.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import keys as K
from marginalia.functions import text as X
from marginalia.plans.records import records, sql
from marginalia.shipping import ship

# Least scores and confidences, and classes a judge may give.
LEAST_SCORE, LEAST_REFERENCE, LEAST_EVIDENCE = 0.2, 0.55, 0.7
CLASSES = ["direct", "related", "unrelated", "uncertain"]


def unit(value) -> float | None:
    """A number in 0 to 1, clamped; None if it is none."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(number) else max(0.0, min(1.0, number))


def input_digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def pending(rows: DataFrame, done: DataFrame, key: str, version: str) -> DataFrame:
    """Rows whose key, input_hash and model version aren't in ``done``."""
    return rows.join(done.where(F.col("version") == version).select(key, "input_hash"), [key, "input_hash"], "left_anti")


def _batched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict]:
    for batch in batches:
        rows = batch.to_pylist()
        for at in range(0, len(rows), size):
            yield rows[at : at + size]


def embed(rows: DataFrame, key: str, model: Callable[[list[str]], list[list[float]]], size: int = 20) -> DataFrame:
    """(key, input_hash, embedding) of rows with text and input_hash; a batch with a wrong number of vectors, or uneven ones, fails."""
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batched(batches, size):
            vectors = model([r["text"] or "" for r in part])
            if len(vectors) != len(part) or len({len(v) for v in vectors}) > 1 or not all(math.isfinite(x) for v in vectors for x in v):
                raise ValueError(f"{len(vectors)} vectors for {len(part)} texts, or uneven ones")
            yield pa.RecordBatch.from_arrays([pa.array([r[key] for r in part]), pa.array([r["input_hash"] for r in part], pa.string()), pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float64()))], names=[key, "input_hash", "embedding"])

    return rows.select(key, "input_hash", "text").mapInArrow(run, f"{key} {kind}, input_hash string, embedding array<double>")


def sync(units: DataFrame, index: DataFrame, model: Callable, version: str, size: int = 20) -> DataFrame:
    """The index (unit_id, input_hash, version, embedding) after units (unit_id, text) came, changed or went: only new inputs are embedded."""
    wanted = units.withColumn("input_hash", input_digest(F.col("text")))
    have = index.where(F.col("version") == version).dropDuplicates(["unit_id", "input_hash"])
    kept = wanted.select("unit_id", "input_hash").join(have.select("unit_id", "input_hash", "embedding"), ["unit_id", "input_hash"])
    fresh = embed(pending(wanted, have, "unit_id", version), "unit_id", model, size)
    return kept.unionByName(fresh).withColumn("version", F.lit(version))


def search_units(df: DataFrame) -> DataFrame:
    """(unit_id, comment_id, text): the units of each record's text, with its city and discipline before them."""
    units = df.select("comment_id", "city", "discipline", F.posexplode(X.coherent_units(F.col("text"))).alias("n", "unit"))
    head = F.concat(F.lit("City: "), F.coalesce("city", F.lit("")), F.lit("\nDiscipline: "), F.coalesce("discipline", F.lit("")), F.lit("\nComment: "))
    return units.select(F.concat_ws(":", "comment_id", F.col("n") + 1).alias("unit_id"), "comment_id", F.concat(head, "unit").alias("text"))


def ranked(answers: DataFrame, candidates: DataFrame, limit: int = 5) -> DataFrame:
    """A model's ranking (id, score, …) made safe: asked ids, each once, scores 0 to 1 and 0.2 at least, best first, ten at most."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score").try_cast("double")))
    known = answers.join(candidates.select("id").distinct(), "id", "left_semi").withColumn("score", F.round(score, 4)).where(F.col("score") >= LEAST_SCORE)
    best = known.groupBy("id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(max(1, min(limit, 10)))


def judged(answers: DataFrame, candidates: DataFrame, only: list[str] | None = None) -> DataFrame:
    """A judge's classes (id, match_class, relevance_score): asked ids and known classes, direct before related, then by score."""
    known = answers.join(candidates.select("id").distinct(), "id", "left_semi").where(F.col("match_class").isin(only or CLASSES))
    return known.orderBy(F.array_position(F.array(*map(F.lit, CLASSES)), F.col("match_class")), F.desc("relevance_score"), "id")


def supported(answers: DataFrame, texts: DataFrame, least: float = LEAST_EVIDENCE) -> DataFrame:
    """Evidence decisions (id, is_relevant, supporting_excerpt, confidence) with ``accepted``: sure enough, and the excerpt is in the text (id, text)."""
    plain = lambda c: K.normalize_quote(F.coalesce(c, F.lit("")))
    said = answers.join(texts.select("id", "text"), "id")
    quoted = (F.trim(F.coalesce("supporting_excerpt", F.lit(""))) != "") & F.contains(plain(F.col("text")), plain(F.col("supporting_excerpt")))
    fine = F.coalesce(F.col("is_relevant"), F.lit(False)) & quoted & (F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)) >= least)
    return said.withColumn("accepted", fine).drop("text")


def rewrites(query: str, offered: list[dict], most: int = 8) -> list[str]:
    """Rewritten queries that keep the meaning, each once, the query itself left out."""
    seen, out = {(query or "").casefold().strip()}, []
    for item in offered:
        value = str(item.get("query") or "").strip()
        if item.get("preserves_meaning") is True and value and value.casefold() not in seen:
            seen.add(value.casefold())
            out.append(value)
    return out[:most]


# Fields of a query's analysis, texts and lists.
ANALYSIS_TEXTS = ["search_goal", "city", "discipline", "condition_or_problem", "issue_type", "direct_match_definition", "related_match_definition", "category"]
ANALYSIS_LISTS = ["secondary_subjects", "requested_actions", "technical_terms", "required_concepts", "optional_concepts", "excluded_concepts", "ambiguities"]


def analysis(raw, query: str) -> dict:
    """A query's analysis with every field there and of its kind; codes are found in the query where none are given."""
    import re

    raw = raw if isinstance(raw, dict) else {}
    text = lambda *names: next((str(raw[n]).strip() for n in names if n in raw and raw[n] is not None), "")
    listed = lambda n: [str(x).strip() for x in raw[n] if str(x).strip()] if isinstance(raw.get(n), list) else []
    out = {n: text(n) for n in ANALYSIS_TEXTS} | {n: listed(n) for n in ANALYSIS_LISTS}
    out["code_sections"] = [c.upper() for c in listed("code_sections")] if isinstance(raw.get("code_sections", []), list) and "code_sections" in raw else sorted({c.upper() for c in re.findall(X.CODE_SECTION, query)})
    out["primary_subject"], out["regulatory_concern"] = text("primary_subject", "subject"), text("regulatory_concern", "requirement")
    out["subject"], out["requirement"] = out["primary_subject"], out["regulatory_concern"]
    out["semantic_query"] = text("semantic_query") or (query or "").strip()
    return out


def display(raw, original: str) -> dict:
    """An organised text with blocks that have content and references sure enough to follow."""
    raw = raw if isinstance(raw, dict) else {}
    shown = str(raw.get("display_text") or "").strip() or (original or "").strip()
    blocks, references = [], []
    for b in raw.get("blocks") or []:
        if isinstance(b, dict) and b.get("kind") in ("paragraph", "list"):
            items, text = [str(x).strip() for x in b.get("items") or [] if str(x).strip()], str(b.get("text") or "").strip()
            if text if b["kind"] == "paragraph" else items:
                blocks.append({"kind": b["kind"], "title": str(b.get("title") or "").strip(), "text": text, "items": items})
    for r in raw.get("secondary_references") or []:
        if isinstance(r, dict):
            one = {"kind": str(r.get("kind", "other")), "sheet": str(r.get("sheet") or "").strip().upper(), "document_hint": str(r.get("document_hint") or "").strip(), "evidence_query": str(r.get("evidence_query") or "").strip(), "reason": str(r.get("reason") or "").strip(), "confidence": unit(r.get("confidence", 0)) or 0.0}
            if one["confidence"] >= LEAST_REFERENCE and (one["sheet"] or one["document_hint"]):
                references.append(one)
    return {"display_text": shown, "blocks": blocks or [{"kind": "paragraph", "title": "", "text": shown, "items": []}], "secondary_references": references}


def enrich(rows: DataFrame, key: str, model: Callable[[str], dict]) -> DataFrame:
    """(key, input_hash, result): a model's organisation of each text as checked JSON; a row that fails is left out and asked again next time."""
    import json

    ship(rows.sparkSession)
    kind, arrow = rows.schema[key].dataType.simpleString(), batch_type(rows, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batched(batches, 64):
            out = []
            for r in part:
                try:
                    out.append((r[key], r["input_hash"], json.dumps(display(model(r["text"] or ""), r["text"] or ""), ensure_ascii=False, sort_keys=True)))
                except RuntimeError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], arrow), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())], names=[key, "input_hash", "result"])

    return rows.select(key, "input_hash", "text").mapInArrow(run, f"{key} {kind}, input_hash string, result string")


def batch_type(rows: DataFrame, key: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[rows.schema[key].dataType.simpleString()]


def _letters(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: how often each of a few letters is in a text."""
    return [[float(t.count(c)) for c in "aeinr"] for t in texts]


QUERIES = {
    "unit_embeddings": (
        lambda s, d: sync(search_units(records(s, d)), s.createDataFrame([], "unit_id string, input_hash string, version string, embedding array<double>"), _letters, "letters-1").select("unit_id", "input_hash", F.element_at("embedding", 1).alias("a"), F.size("embedding").alias("n")),
        sql("SELECT comment_id || ':1' AS unit_id, sha256(t) AS input_hash, CAST(length(t) - length(replace(t, 'a', '')) AS DOUBLE) AS a, 5 AS n FROM (SELECT comment_id, 'City: ' || city || chr(10) || 'Discipline: ' || discipline || chr(10) || 'Comment: ' || trim(text) AS t FROM records WHERE trim(text) <> '')"),
    ),
}
