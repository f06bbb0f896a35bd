"""Ranking: TF-IDF over query terms, hybrid scores, literal and staged retrieval, tag index, evaluation."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.plans.records import records, sql, table
from marginalia.shipping import ship
from marginalia.storage import cut, empty

WEIGHTS = {"semantic": 0.55, "keyword": 0.20, "city": 0.10, "discipline": 0.05, "code": 0.05, "accepted": 0.05}
QUERY = "de la der die"


def query_tokens(query: str, pattern: str = X.PLAIN_TOKEN) -> list[str]:
    return [t for t in re.findall(pattern, query.casefold()) if len(t) > 1 and t not in X.SEARCH_STOPS]


def _times(tokens: Column, word: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == word))


def tfidf(df: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """comment_id and score: cosine over the query's terms, and 0.35 more where the text has the query as a phrase.

    Document frequencies come first, in one aggregate of a column per term; the
    scores are then plain expressions over each text, so ranking shuffles only
    the best rows of each task.
    """
    terms = Counter(query_tokens(query))
    if not terms:
        return df.sparkSession.createDataFrame([], "comment_id long, score double")
    words = list(terms)
    toks = X.tokens(F.col("text"), X.PLAIN_TOKEN)
    counted = df.select("comment_id", "text", F.filter(toks, lambda t: t.isin(words)).alias("t"))
    tf = {w: _times(F.col("t"), w) for w in words}
    counted = counted.select("comment_id", "text", *[c.alias(f"tf{i}") for i, c in enumerate(tf.values())])
    n, *dfs = counted.agg(F.count("*"), *[F.coalesce(F.sum((F.col(f"tf{i}") > 0).cast("long")), F.lit(0)) for i in range(len(words))]).first()
    idf = [math.log((n + 1) / (d + 0.5)) + 1 for d in dfs]
    q = [terms[w] * v for w, v in zip(words, idf)]
    norm = math.sqrt(sum(v * v for v in q)) or 1.0
    weight = [F.col(f"tf{i}") * F.lit(v) for i, v in enumerate(idf)]
    dot = sum((w * F.lit(v) for w, v in zip(weight, q)), F.lit(0.0))
    own = F.sqrt(sum((w * w for w in weight), F.lit(0.0)))
    some = sum((F.col(f"tf{i}") for i in range(len(words))), F.lit(0)) > 0
    phrase = " ".join(query.casefold().split())
    score = dot / (own * norm) + F.when(F.contains(F.lower("text"), F.lit(phrase)), 0.35).otherwise(0.0)
    found = counted.where(some).select("comment_id", F.round(score, 4).alias("score"))
    return found.orderBy(F.desc("score"), "comment_id").limit(max(1, min(limit, 100)))


def hybrid(df: DataFrame, query: str, city: str = "", discipline: str = "", limits: tuple[int, int, int] = (30, 30, 20)) -> DataFrame:
    """Weighted scores by words, token sets, city, discipline, code sections and trust: the best by either signal, then the best of those.

    Texts are tokenised once: the few numbers of each record are written, and
    both rankings read those.
    """
    counts, codes = Counter(query_tokens(query, X.SEARCH_TOKEN)), sorted({c.upper() for c in re.findall(X.CODE_SECTION, query)})
    if not counts:
        return df.sparkSession.createDataFrame([], "comment_id long, score double, keyword_score double, semantic_score double")
    phrase = " ".join(query.casefold().split())

    def scores(t: Column) -> Column:
        shared = sum((F.least(F.lit(c), _times(t, w)) for w, c in counts.items()), F.lit(0))
        own = F.array(*map(F.lit, counts))
        bag = F.array_distinct(t)
        both = F.size(F.array_intersect(bag, own))
        return F.struct((shared / float(sum(counts.values()))).alias("keyword"), (both / F.greatest(F.lit(1), F.size(bag) + len(counts) - both)).alias("semantic"))

    said = F.contains(F.lower("text"), F.lit(phrase))
    coded = F.size(F.array_intersect(F.array(*map(F.lit, codes)), X.code_sections(F.upper("text")))) / float(len(codes)) if codes else F.lit(0.0)
    rows = df.where(F.lower("city") == city.lower()) if city else df
    told = rows.select("comment_id", (F.lower("city") == city.lower()).alias("here"), (F.lower("discipline") == discipline.lower()).alias("field"), (F.col("trust") == "verified").alias("good"), said.alias("said"), coded.alias("coded"), X.let(X.search_tokens(F.col("text")), scores).alias("s"))
    keyword = F.when(F.col("said"), F.least(F.lit(1.0), F.col("s.keyword") + 0.35)).otherwise(F.col("s.keyword"))
    told = cut(told.select("comment_id", "here", "field", "good", "coded", keyword.alias("keyword_score"), F.col("s.semantic").alias("semantic_score")).where("keyword_score > 0 or semantic_score > 0"), "scores")
    plus = lambda c, w: F.when(F.col(c), WEIGHTS[w]).otherwise(0.0)
    score = WEIGHTS["semantic"] * F.col("semantic_score") + WEIGHTS["keyword"] * F.col("keyword_score") + plus("here", "city") + plus("field", "discipline") + WEIGHTS["code"] * F.col("coded") + plus("good", "accepted")
    rows = told.select("comment_id", F.round(F.least(F.lit(1.0), score), 4).alias("score"), "keyword_score", "semantic_score")
    by_vector = rows.orderBy(F.desc("semantic_score"), "comment_id").limit(limits[0])
    by_word = rows.orderBy(F.desc("keyword_score"), "comment_id").limit(limits[1])
    return by_vector.union(by_word).distinct().orderBy(F.desc("score"), "comment_id").limit(limits[2])


def keyword_ids(df: DataFrame, subject: str) -> DataFrame:
    """Records that have every root of the subject's words."""
    roots = {r for r in (_root(p) for w in re.findall("[a-z0-9]+(?:-[a-z0-9]+)?", subject.casefold()) for p in w.split("-")) if len(r) > 1 and r not in X.SEARCH_STOPS}
    if not roots:
        return df.limit(0).select("comment_id")
    have = F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+(?:-[a-z0-9]+)?"), F.lit(0)), X.term_root)
    return df.where(F.size(F.array_intersect(F.array(*map(F.lit, sorted(roots))), have)) == len(roots)).select("comment_id")


def _root(w: str) -> str:
    return w[:-3] + "y" if len(w) > 4 and w.endswith("ies") else w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w


def _nearest(ids: np.ndarray, asked: np.ndarray, k: int):
    """Over batches of (vec_id, embedding): the best k of a batch for each query, by rounded cosine, then id."""
    size = np.sqrt((asked**2).sum(axis=1))
    unit = asked / np.where(size > 0, size, 1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                column, own = part.column("embedding"), part.column("vec_id").to_numpy(zero_copy_only=False)
                fits = np.array([len(v) if v is not None else -1 for v in column.to_pylist()]) == asked.shape[1]
                x = np.zeros((part.num_rows, asked.shape[1]))
                if fits.any():
                    x[fits] = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, asked.shape[1])
                norm = np.sqrt((x**2).sum(axis=1))
                score = np.round(unit @ (x / np.where(norm > 0, norm, 1)[:, None]).T, 4) + 0.0
                score[ids[:, None] == own] = -np.inf
                order = np.argsort(own, kind="stable")
                best = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, :k]]
                found = np.take_along_axis(score, best, 1)
                row, col = np.nonzero(np.isfinite(found))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(own[best[row, col]]), pa.array(found[row, col])], names=["query_id", "vec_id", "score"])

    return run


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 500) -> DataFrame:
    """Cosine of each query with every vector, the best k: query_id, vec_id, score, place.

    Exact, by blocks of about ``block`` queries of one length, which go to the
    tasks as one array; a task gives the best of each of its batches.  Vectors of
    another length, and zero ones, score zero, as cosine does.
    """
    ship(vectors.sparkSession)
    asked = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0").withColumn("d", F.size("embedding"))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    found = None
    for d, n in sorted((r[0], r[1]) for r in asked.groupBy("d").count().collect()):  # a row a length
        blocks = max(1, -(-n // block))
        for i in range(blocks):
            q = asked.where((F.col("d") == d) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)).toArrow()
            if q.num_rows:
                held = q.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                best = rows.mapInArrow(_nearest(q.column("vec_id").to_numpy(), held, k), "query_id long, vec_id long, score double")
                if blocks > 1:
                    best = cut(best, "nearest")
                found = best if found is None else found.unionByName(best)
    if found is None:
        found = empty(vectors.sparkSession, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def evaluate(results: DataFrame, expected: DataFrame) -> DataFrame:
    """results (case, id, rank), expected (case, id): precision and recall at cut-offs and the mean reciprocal rank."""
    hits = results.join(expected.withColumn("hit", F.lit(1)), ["case", "id"], "left")
    per = hits.groupBy("case").agg(F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.when((F.col("rank") <= 5) & (F.col("hit") == 1), 1).otherwise(0)).alias("top5"), F.sum((F.col("rank") <= 5).cast("int")).alias("shown"))
    all_cases = expected.select("case").distinct().join(per, "case", "left")
    at = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 4)
    return all_cases.agg(F.round(F.avg(F.coalesce(F.col("top5") / F.greatest(F.lit(1), F.col("shown")), F.lit(0.0))), 4).alias("precision_at_5"), at(1).alias("recall_at_1"), at(5).alias("recall_at_5"), at(10).alias("recall_at_10"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mean_reciprocal_rank"))


def _evaluate_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 20 = 0")
    found = nearest_vectors(v, asked, 10).select(F.col("query_id").alias("case"), F.col("vec_id").alias("id"), F.col("place").alias("rank"))
    label = v.select(F.col("vec_id").alias("id"), "label")
    wanted = asked.select(F.col("vec_id").alias("case"), F.col("label")).join(label, "label").where("case <> id").select("case", "id")
    return evaluate(found, wanted)


def interval_merge(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Overlapping intervals of a key as one: a running maximum of ends starts a new one where it is passed."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = before.isNull() | (F.col(start) > before)
    runs = df.withColumn("run", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(key, "run").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("run")


_TF = "len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:[-''][a-z0-9]+)?'), lambda x: x = '{w}'))"


def _tfidf_sql() -> str:
    words = Counter(query_tokens(QUERY))
    cols = ", ".join(f"{_TF.format(w=w)} AS tf{i}" for i, w in enumerate(words))
    n = len(words)
    idf = ", ".join(f"ln((count(*) + 1) / (count(*) FILTER (tf{i} > 0) + 0.5)) + 1 AS i{i}" for i in range(n))
    q = [f"{c} * i{i}" for i, c in enumerate(words.values())]
    dot = " + ".join(f"tf{i} * i{i} * {q[i]}" for i in range(n))
    own = " + ".join(f"(tf{i} * i{i}) * (tf{i} * i{i})" for i in range(n))
    norm = " + ".join(f"({x}) * ({x})" for x in q)
    some = " + ".join(f"tf{i}" for i in range(n))
    return sql(f"SELECT comment_id, round(({dot}) / (sqrt({own}) * sqrt({norm})) + CASE WHEN contains(lower(text), '{QUERY}') THEN 0.35 ELSE 0 END, 4) AS score FROM c, f WHERE {some} > 0 ORDER BY score DESC, comment_id LIMIT 30", f"c AS (SELECT comment_id, text, {cols} FROM records)", f"f AS (SELECT {idf} FROM c)")


def _hybrid_sql() -> str:
    counts = Counter(query_tokens(QUERY, X.SEARCH_TOKEN))
    stops = ", ".join(f"'{w}'" for w in X.SEARCH_STOPS)
    shared = " + ".join(f"least({c}, len(list_filter(t, lambda x: x = '{w}')))" for w, c in counts.items())
    both = " + ".join(f"CAST(list_contains(t, '{w}') AS INT)" for w in counts)
    phrase = " ".join(QUERY.casefold().split())
    return sql(
        "SELECT * FROM (SELECT * FROM (SELECT * FROM f ORDER BY semantic_score DESC, comment_id LIMIT 30) UNION SELECT * FROM (SELECT * FROM f ORDER BY keyword_score DESC, comment_id LIMIT 30)) ORDER BY score DESC, comment_id LIMIT 20",
        f"t AS (SELECT *, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.\\-/][a-z0-9]+)*'), lambda x: length(x) > 1 AND x NOT IN ({stops})) AS t FROM records)",
        f"k AS (SELECT comment_id, trust, ({shared}) / {float(sum(counts.values()))} + CASE WHEN contains(lower(text), '{phrase}') THEN 0.35 ELSE 0 END AS k, ({both}) AS n, len(list_distinct(t)) AS m FROM t)",
        f"f AS (SELECT comment_id, round(least(1.0, 0.55 * semantic_score + 0.2 * keyword_score + CASE WHEN trust = 'verified' THEN 0.05 ELSE 0 END), 4) AS score, keyword_score, semantic_score FROM (SELECT comment_id, trust, least(k, CASE WHEN k > 1 THEN 1.0 ELSE k END) AS keyword_score, n / greatest(1, m + {len(counts)} - n) AS semantic_score FROM k) WHERE keyword_score > 0 OR semantic_score > 0)",
    )


_PAIRS = """p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM p)"""

QUERIES = {
    "tfidf_search": (lambda s, d: tfidf(records(s, d), QUERY), _tfidf_sql()),
    "hybrid_search": (lambda s, d: hybrid(records(s, d), QUERY), _hybrid_sql()),
    "keyword_search": (
        lambda s, d: keyword_ids(records(s, d), "de la"),
        sql("SELECT comment_id FROM records WHERE list_contains(roots, 'de') AND list_contains(roots, 'la')").replace("FROM records WHERE", "FROM (SELECT *, list_transform(regexp_extract_all(lower(text), '[a-z0-9]+(?:-[a-z0-9]+)?'), lambda w: CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END) AS roots FROM records) WHERE"),
    ),
    "vector_search": (
        lambda s, d: nearest_vectors(table(s, d, "embeddings"), table(s, d, "embeddings").where("vec_id % 20 = 0")),
        f"WITH {_PAIRS} SELECT * FROM r WHERE place <= 5",
    ),
    "search_evaluation": (
        _evaluate_vectors,
        f"""WITH {_PAIRS}, hits AS (SELECT r.query_id, r.place, a.label = b.label AS hit FROM r JOIN embeddings a ON a.vec_id = r.query_id JOIN embeddings b ON b.vec_id = r.vec_id WHERE place <= 10),
        per AS (SELECT query_id, min(place) FILTER (hit) AS first, count(*) FILTER (hit AND place <= 5) AS top5, count(*) FILTER (place <= 5) AS shown FROM hits GROUP BY 1),
        cases AS (SELECT a.vec_id FROM embeddings a WHERE a.vec_id % 20 = 0 AND EXISTS (SELECT 1 FROM embeddings b WHERE b.label = a.label AND b.vec_id <> a.vec_id))
        SELECT round(avg(coalesce(top5 / greatest(1, shown), 0.0)), 4) AS precision_at_5, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_5,
          round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 4) AS recall_at_10, round(avg(coalesce(1 / first, 0.0)), 4) AS mean_reciprocal_rank FROM cases LEFT JOIN per ON per.query_id = cases.vec_id""",
    ),
    "merged_intervals": (
        lambda s, d: interval_merge(table(s, d, "events").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + F.floor("value").cast("long") % 300).alias("b")), "user_id", "a", "b"),
        """WITH e AS (SELECT user_id, event_id AS a, event_id + CAST(floor(value) AS BIGINT) % 300 AS b FROM events),
        m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e),
        r AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m)
        SELECT user_id, min(a) AS start, max(b) AS "end" FROM r GROUP BY user_id, run""",
    ),
}
