"""Counterfactual-regularised toxicity classifier.

A logistic model over the distinct words of a text.  Its vocabulary is the
words that tell the classes apart most in the labelled sample, counted by their
different neighbours, and all identity terms.  Every labelled text that names a group is written again with other
groups named; the square of the change in its logit is a penalty beside the
usual loss, so naming one group or another shall not move the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.sampling import FIT_ROWS, fold, labelled
from marginalia.storage import cut, pick

THRESHOLD = 0.5
#: Bounds of what is learnt: words of the vocabulary, and texts a word must be in.
WORDS, LEAST_TEXTS, LEAST_G2 = 4096, 4, 12.0
L2, PAIRING, STEPS, RATE = 2e-5, 1.0, 600, 0.1
WORD = re.compile(r"[^\W_]+")

# Identity terms by kind; terms of a kind are swapped for one another.
IDENTITY = {
    "gender_en": ["woman", "man", "female", "male", "transgender", "nonbinary"],
    "genders_en": ["women", "men", "females", "males", "girls", "boys"],
    "faith_en": ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"],
    "faiths_en": ["christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"],
    "origin_en": ["african", "asian", "european", "american", "arab", "latino", "mexican", "chinese", "indian"],
    "colour_en": ["black", "white", "brown"],
    "love_en": ["gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer"],
    "state_en": ["immigrant", "refugee", "disabled", "blind", "deaf", "elderly"],
    "states_en": ["immigrants", "refugees", "foreigners", "natives"],
    "people_de": ["frauen", "männer", "christen", "muslime", "juden", "ausländer", "flüchtlinge"],
    "people_fr": ["femmes", "hommes", "chrétiens", "musulmans", "juifs", "étrangers", "réfugiés"],
    "people_es": ["mujeres", "hombres", "cristianos", "musulmanes", "judíos", "extranjeros", "refugiados"],
}
SWAPS = {w: [v for v in group if v != w] for group in IDENTITY.values() for w in group}
#: Counterfactuals of a text: how many other terms take the place of those it has.
VERSIONS = 2


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def counterfactuals(words: set[str]) -> list[set[str]]:
    """The word sets of a text with its identity terms swapped; none if it names no group."""
    named = sorted(words & SWAPS.keys())
    if not named:
        return []
    out = []
    for k in range(VERSIONS):
        swapped = words - set(named) | {SWAPS[w][(k + len(w)) % len(SWAPS[w])] for w in named}
        out.append(swapped)
    return out


class Model:
    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights

    def logit(self, text: str | None) -> float:
        w = self.weights
        return self.bias + sum(sorted(map(w.__getitem__, words_of(text) & w.keys())))

    def score(self, texts: list) -> np.ndarray:
        z = np.fromiter(map(self.logit, texts), float, len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Problem:
    """Labelled word sets as arrays: which words each text has, and what changes in each of its counterfactuals."""

    def __init__(self, rows: list[tuple[float, set[str]]], place: dict[str, int]):
        at, col, pair, pcol, sign = [], [], [], [], []
        self.pairs = 0
        for i, (_, words) in enumerate(rows):
            here = sorted(words & place.keys())
            at += [i] * len(here)
            col += [place[w] for w in here]
            for other in counterfactuals(words):
                for extra, s in ((words - other, 1.0), (other - words, -1.0)):
                    known = sorted(extra & place.keys())
                    pair += [self.pairs] * len(known)
                    pcol += [place[w] for w in known]
                    sign += [s] * len(known)
                self.pairs += 1
        self.at, self.col, self.pair, self.pcol, self.sign = np.array(at, int), np.array(col, int), np.array(pair, int), np.array(pcol, int), np.array(sign, float)
        self.y = np.array([r[0] for r in rows], float)
        self.n, self.v = len(rows), len(place)
        self.weight = np.where(self.y == 1, 0.5 / self.y.mean(), 0.5 / (1 - self.y.mean()))  # the classes count alike

    def objective(self, w: np.ndarray, pairing: float) -> tuple[float, np.ndarray]:
        """Loss, L2 and the mean squared change of the logits under counterfactuals, and their gradient; the bias is the last weight."""
        z = np.clip(w[self.v] + np.bincount(self.at, w[self.col], self.n), -40, 40)
        q = 1 / (1 + np.exp(-z))
        r = self.weight * (q - self.y) / self.n
        loss = float((self.weight * (np.logaddexp(0, z) - self.y * z)).sum() / self.n + 0.5 * L2 * (w[: self.v] ** 2).sum())
        g = np.append(np.bincount(self.col, r[self.at], self.v) + L2 * w[: self.v], r.sum())
        if self.pairs:
            gap = np.bincount(self.pair, self.sign * w[self.pcol], self.pairs)
            loss += pairing / self.pairs * float((gap**2).sum())
            g[: self.v] += 2 * pairing / self.pairs * np.bincount(self.pcol, self.sign * gap[self.pair], self.v)
        return loss, g


def fit_weights(rows: list[tuple[float, set[str]]], vocabulary: list[str], pairing: float = PAIRING) -> Model:
    """Full-batch descent (Adam) on ``Problem.objective``.  One class alone: the prior."""
    y = np.array([r[0] for r in rows], float)
    prior = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return Model(bias, {})
    place = {w: i for i, w in enumerate(vocabulary)}
    problem = Problem(rows, place)
    w = np.zeros(problem.v + 1)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        g = problem.objective(w, pairing)[1]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Model(float(w[problem.v]), {x: float(w[i]) for x, i in place.items() if abs(w[i]) > 1e-6})


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
            found = sorted(words_of(text))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(found), pa.int32()), pa.array(found)], names=["y", "word"])


def _contexts(candidates: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                words = ["", *WORD.findall((text or "").lower()), ""]
                rows.update((y, w, f"{words[i]} {words[i + 2]}") for i, w in enumerate(words[1:-1]) if w in candidates)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*sorted(rows)), (pa.int32(), pa.string(), pa.string()))], names=["y", "word", "context"])

    return run


def keyness(a: Column, b: Column, toxic: float, clean: float) -> Column:
    """Log-likelihood ratio of a word met ``a`` times of ``toxic`` and ``b`` times of ``clean``."""
    share = lambda x, n: F.when((x > 0) & F.lit(n > 0), x * F.log(x * (toxic + clean) / (F.lit(float(max(n, 1))) * (a + b)))).otherwise(0.0)
    return 2 * (share(a, toxic) + share(b, clean))


def _known(vocabulary: list[str]):
    known = set(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [sorted(words_of(t) & known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(kept, pa.list_(pa.string()))], names=["y", "words"])

    return run


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Model:
    """The model for ``labels.toxic``, from at most ``limit`` labelled documents outside the held-out fold.

    Word counts are summed by the cluster; the driver gets at most WORDS words,
    and each labelled document's words among those.
    """
    sample = cut(labelled(docs, labels, "toxic", limit).select("y", "text"), "labelled")
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    sums = (F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    often = F.col("a") + F.col("b") >= LEAST_TEXTS
    texts = sample.mapInArrow(_words, "y int, word string").groupBy("word").agg(*sums).where(often).withColumn("g2", keyness(F.col("a"), F.col("b"), toxic, total - toxic))
    candidates = {r[0] for r in texts.where(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "word").limit(4 * WORDS).select("word").collect()}
    # copies of one text make all its words look telling: what counts is how many different neighbours a word has
    met = sample.mapInArrow(_contexts(candidates), "y int, word string, context string").distinct().groupBy("word").agg(*sums)
    best = met.where(often).withColumn("g2", keyness(F.col("a"), F.col("b"), toxic, total - toxic)).where((F.col("g2") >= LEAST_G2) & (F.col("a") * (total - toxic) > F.col("b") * toxic))
    chosen = {r[0] for r in best.orderBy(F.desc("g2"), "word").limit(WORDS).select("word").collect()}
    vocabulary = sorted(chosen | SWAPS.keys())
    rows = [(float(r[0]), set(r[1])) for r in sample.mapInArrow(_known(vocabulary), "y int, words array<string>").collect()]
    rows.sort(key=lambda r: (r[0], sorted(r[1])))  # rows come in any order; the weights shall not depend on it
    return fit_weights(rows, vocabulary)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document.

    Null and empty texts get the score of a text without words.  Null doc_ids
    stay null, rows repeated whole are scored each, an empty table gives no
    rows, and further columns are ignored.
    """
    return pick(docs, doc_id="long", text="string").mapInArrow(_scores(model), "doc_id long, score double")


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit, then doc_id, held_out, score and predicted of every document; a null doc_id is not held out."""
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
