"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed over whole texts, in Arrow batches.  Trees are grown on
a bounded sample of labelled documents (``sampling.FIT_ROWS``) with features cut
into at most 64 bins, and flattened into complete binary trees held in arrays,
so that a batch goes down all trees at once in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.sampling import FIT_ROWS, fold, labelled
from marginalia.storage import pick, place_of

THRESHOLD = 0.3
BINS, DEPTH, TREES, RATE, LAMBDA, LEAST_LEAF = 64, 4, 60, 0.15, 1.0, 8

NAMES = [
    "log_chars", "log_words", "log_lines", "mean_word", "long_words", "short_words", "upper", "lower", "digit", "blank",
    "newline", "symbols", "bars", "stops", "commas", "exclaims", "other_ascii", "beyond_ascii", "distinct_words", "top_word", "top_pair",
    "same_next", "distinct_lines", "top_line", "mean_line", "ends_full", "symbol_words", "upper_words", "bar_lines",
    "worst_symbols", "worst_upper", "worst_distinct", "log_sentences",
]

_KIND = np.zeros(256, np.int64)
for _c in range(256):
    _KIND[_c] = (
        0 if 65 <= _c <= 90 else 1 if 97 <= _c <= 122 else 2 if 48 <= _c <= 57 else 4 if _c == 10 else 3 if _c == 32 or 9 <= _c <= 13
        else 10 if _c >= 128 else 6 if _c == 124 else 7 if _c == 46 else 8 if _c in (44, 59, 58) else 9 if _c in (33, 63) else 5
    )
_WINDOW = 100
_MARKS = b".,;:!?\"'()-"


def statistics(text: str | None) -> np.ndarray:
    """The figures of NAMES for one text; all zero for a null or empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    out = np.zeros(len(NAMES))
    if not words:
        return out
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=11) / len(raw)
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in map(bytes.strip, raw.split(b"\n")) if x]
    bare = [w.strip(_MARKS).lower() for w in words]
    counts = Counter(bare)
    same = sum(map(bytes.__eq__, bare, bare[1:]))
    pairs = Counter(zip(bare[::2], bare[1::2]))
    line_counts = Counter(lines)
    odd = np.fromiter((not w.isalnum() and w.isascii() for w in bare), bool, n)
    upper = np.fromiter(map(bytes.isupper, words), bool, n)
    worst = [0.0, 0.0, 1.0]
    for a in range(0, max(1, n - _WINDOW // 2), _WINDOW):
        b = min(a + _WINDOW, n)
        worst = [max(worst[0], odd[a:b].mean()), max(worst[1], upper[a:b].mean()), min(worst[2], len(set(bare[a:b])) / (b - a))]
    out[:] = [
        np.log1p(len(raw)), np.log1p(n), np.log1p(len(lines)), sizes.mean(), (sizes > 20).mean(), (sizes < 3).mean(), kinds[0], kinds[1], kinds[2], kinds[3],
        kinds[4], kinds[5], kinds[6], kinds[7], kinds[8], kinds[9], kinds[5] + kinds[6], kinds[10], len(counts) / n, max(counts.values()) / n,
        max(pairs.values(), default=0) / max(1, n // 2), same / n, len(line_counts) / len(lines), max(line_counts.values()) / len(lines),
        np.log1p(len(raw) / len(lines)), sum(x[-1] in b".!?" for x in lines) / len(lines), odd.mean(), upper.mean(), sum(b"|" in x for x in lines) / len(lines),
        *worst, np.log1p(raw.count(b". ") + raw.count(b".\n")),
    ]
    return out


class Trees:
    """Boosted trees in arrays: feature and threshold of each inner node, value of each leaf.

    Node i of a tree has the children 2i+1 and 2i+2.  A node that is not split
    sends everything left, where its leaf is.
    """

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(self.feature.shape[0])
        at = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(self.feature.shape[1] + 1))):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        return self.base + self.value[trees, at - self.feature.shape[1]].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Logistic boosting on histograms.  With no rows, or one class only, the prior alone is learnt."""
    p = (y.sum() + 1) / (len(y) + 2)
    base, inner = float(np.log(p / (1 - p))), 2**depth - 1
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    if len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return Trees(base, feature, threshold, value)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = q - y, q * (1 - q)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            here = at - first
            best = np.full(width, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell = here * BINS + binned[:, f]
                gs, hs, ns = (np.bincount(cell, w, width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (g, h, None))
                gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                ga, ha, na = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gl**2 / (hl + LAMBDA) + (ga - gl) ** 2 / (ha - hl + LAMBDA) - ga**2 / (ha + LAMBDA)
                gain[(nl < LEAST_LEAF) | (na - nl < LEAST_LEAF)] = 0
                gain = gain[:, : len(e)]
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                for node in np.flatnonzero(top > best):
                    best[node] = top[node]
                    feature[t, first + node], threshold[t, first + node] = f, e[k[node]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > threshold[t, at])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value[t] = -RATE * gs / (hs + LAMBDA)
        raw += value[t][leaf]
    return Trees(base, feature, threshold, value)


def _matrix(texts: list) -> np.ndarray:
    return np.stack([statistics(t) for t in texts]) if texts else np.zeros((0, len(NAMES)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Trees:
    """Trees for ``labels.quality``, from at most ``limit`` labelled documents outside the held-out fold."""
    sample = labelled(docs, labels, "quality", limit).select("text", "y").mapInArrow(_features, "y int, x array<double>")
    got = sample.toArrow()  # at most ``limit`` rows of len(NAMES) numbers
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    y = np.array(got.column("y").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # rows come in any order; the trees shall not depend on it
    return fit_trees(x[order], y[order])


def _scores(trees: Trees, rest: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            score = np.concatenate([trees.score(_matrix(texts[a : a + 512])) for a in range(0, len(texts), 512)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(score)], names=names)

    return run


def score_documents(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id and score of every document.

    Null and empty texts get the score of all-zero statistics.  Null doc_ids
    stay null, rows repeated whole are scored each, an empty table gives no
    rows, and further columns are ignored.
    """
    rows = pick(docs, doc_id="long", text="string").withColumnRenamed("text", "__text")
    return rows.mapInArrow(_scores(trees, ["doc_id"], ["doc_id", "score"]), "doc_id long, score double")


def keep_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those scored below ``threshold``, all columns as they were.

    Null and empty texts get the score of all-zero statistics and go if that is
    low; equal texts, and rows repeated whole, stay or go together; null doc_ids
    don't matter.  The column ``text`` is found by exact name, else ignoring
    case; columns of any other names, repeated ones too, are carried along.  An
    empty table stays empty.
    """
    names = docs.columns
    plain = [f"__c{i}" for i in range(len(names))]
    flat = docs.toDF(*plain).withColumn("__text", F.col(plain[place_of(names, "text")]).cast("string"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in flat.schema.fields[:-1]] + ["__score double"])
    scored = flat.mapInArrow(_scores(trees, plain, [*plain, "__score"]), schema)
    return scored.where(F.col("__score") >= threshold).select(*plain).toDF(*names)


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit, then doc_id, held_out, score and predicted of every document; a null doc_id is not held out."""
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
