"""Approximate nearest neighbours by balanced posting lists.

1. Centroids: a bounded sample is bisected again and again, each part into two
   halves of equal size, until parts are small; parts' means are refined by a
   few rounds of k-means.
2. The centroids, bounded in number, are searched by an in-memory graph: each is
   linked to its nearest, and a beam goes from some entry points to the nearest
   ones found, for a batch of vectors at once.
3. A vector is put on the list of its nearest centroid and, being near a
   boundary, on up to ``REPLICAS`` lists whose centroid is at most
   ``BOUNDARY`` times as far.  Lists longer than ``LIST_ROWS`` are cut.
4. A query reads the lists whose centroid is at most ``RATIO`` times as far as
   the nearest, of those its beam found.  Distances there are exact.

Equal vectors are one entry with the k + 1 smallest ids, all that a result of k
can show, so a vector that fills a third of the table is on a list once.  The
entries of a list and the queries that read it meet by a shuffle on the list;
long lists, and lists that many queries read, are cut into parts that meet each
other, so a task holds at most ``LIST_ROWS`` of either.

Vectors of each length are searched among their own.  The commonest length, and
each with more than ``LIST_ROWS`` entries, has an index of its own; the entries
of each rarer one are a single list, read by all its queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.storage import cut, pick

K = 10
#: Bounds of what the driver fits and every worker holds: sample rows and their floats, centroids.
SAMPLE_ROWS, SAMPLE_FLOATS, CENTROIDS = 65_536, 1 << 23, 16_384
#: Vectors a list shall have about, and most entries of a list, or queries of it, that one task reads.
LIST_MEAN, LIST_ROWS = 96, 8192
REPLICAS, BOUNDARY, RATIO = 8, 1.08, 1.5
BEAM, DEGREE = 64, 24


def usable(v: Column) -> Column:
    """Neither null nor zero, and no component null or not finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def bisect(x: np.ndarray, leaves: int, seed: int = 0) -> np.ndarray:
    """Means of ``leaves`` parts of equal size (to a row), refined."""
    rng = np.random.default_rng(seed)
    parts, means = [(np.arange(len(x)), leaves)], []
    while parts:
        rows, n = parts.pop()
        if n <= 1 or len(rows) < 4:
            means.append(x[rows].mean(axis=0))
            continue
        own = x[rows]
        two = own[rng.choice(len(rows), 2, replace=False)]
        for _ in range(4):
            gap = ((own - two[0]) ** 2).sum(1) - ((own - two[1]) ** 2).sum(1)
            near = np.argsort(gap, kind="stable")
            half = len(rows) * (n // 2) // n
            two = np.stack([own[near[:half]].mean(axis=0), own[near[half:]].mean(axis=0)])
        parts += [(rows[near[:half]], n // 2), (rows[near[half:]], n - n // 2)]
    means = np.array(means)
    for _ in range(2):
        of = np.concatenate([nearest(x[a : a + 1024], means) for a in range(0, len(x), 1024)])
        sums, counts = np.zeros_like(means), np.bincount(of, minlength=len(means))
        np.add.at(sums, of, x)
        means = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], means)
    return means


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * x @ c.T).argmin(axis=1)


class Graph:
    """Centroids linked to their nearest, searched by a beam."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE, seed: int = 0):
        self.c = np.ascontiguousarray(centroids, np.float32)
        n = len(self.c)
        degree = min(degree, max(1, n - 1))
        norm = (self.c**2).sum(1)
        links = []
        for a in range(0, n, 512):
            d = norm - 2 * self.c[a : a + 512] @ self.c.T
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            links.append(np.argpartition(d, degree - 1, axis=1)[:, :degree] if n > 1 else np.zeros((1, 1), int))
        rng = np.random.default_rng(seed)
        far = rng.integers(0, n, (n, 4))  # a few long links keep the graph in one piece
        self.links = np.concatenate([np.concatenate(links), far], axis=1).astype(np.int32)
        self.entries = rng.choice(n, min(n, 32), replace=False)

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the nearest centroids found, nearest first."""
        x = np.asarray(x, np.float32)
        m, n = len(x), len(self.c)
        beam = min(beam, n)
        seen = np.zeros((m, n), bool)
        rows = np.arange(m)[:, None]
        ids = np.broadcast_to(self.entries, (m, len(self.entries))).copy()
        dist = ((x[:, None, :] - self.c[ids]) ** 2).sum(2)
        seen[rows, ids] = True
        ids, dist, open_ = self._best(ids, dist, np.ones_like(ids, bool), beam)
        while True:
            # the two nearest not looked from yet
            wait = np.where(open_, dist, np.inf)
            at = np.argsort(wait, axis=1)[:, :2]
            live = np.isfinite(np.take_along_axis(wait, at, 1))
            if not live.any():
                break
            np.put_along_axis(open_, at, False, 1)
            there = self.links[np.take_along_axis(ids, at, 1)].reshape(m, -1)
            fresh = ~seen[rows, there] & np.repeat(live, self.links.shape[1], axis=1)
            first = np.argsort(there, axis=1, kind="stable")
            ordered = np.take_along_axis(there, first, 1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, first[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            fresh &= ~twice
            row, k = np.nonzero(fresh)
            seen[row, there[row, k]] = True
            d = np.where(fresh, ((x[:, None, :] - self.c[there]) ** 2).sum(2), np.inf)
            ids, dist, open_ = self._best(np.concatenate([ids, there], 1), np.concatenate([dist, d], 1), np.concatenate([open_, fresh], 1), beam)
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(dist, order, 1))

    @staticmethod
    def _best(ids, dist, open_, beam):
        if ids.shape[1] <= beam:
            return ids, dist, open_
        keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
        return tuple(np.take_along_axis(a, keep, 1) for a in (ids, dist, open_))


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _assign(graph: Graph):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column("v"))
            for a in range(0, len(x), 256):
                ids, dist = graph.search(x[a : a + 256], 32)
                on = dist <= BOUNDARY * dist[:, :1]
                on[:, REPLICAS:] = False
                row, k = np.nonzero(on)
                take = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, k].astype(np.int32)), *[batch.column(c).take(take) for c in ("g", "ids", "v")]], names=["list", "g", "ids", "v"])

    return run


def _probe(graph: Graph, sizes: np.ndarray, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column("v"))
            for a in range(0, len(x), 256):
                ids, dist = graph.search(x[a : a + 256])
                on = dist <= RATIO * dist[:, :1]
                # never fewer lists than hold enough entries, even if each is on REPLICAS of them
                got = sizes[ids].cumsum(axis=1)
                on |= got - sizes[ids] < least * REPLICAS
                row, k = np.nonzero(on)
                take = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, k].astype(np.int32)), *[batch.column(c).take(take) for c in ("g", "v")]], names=["list", "g", "v"])

    return run


def _meet(k: int):
    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["q", "vec_id", "score"]
        if not entries.num_rows or not queries.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        x, y = (_vectors(t.column("v").combine_chunks()) for t in (entries, queries))
        ids = entries.column("ids").to_pylist()
        of, found, score = [], [], []
        for q, vector in zip(queries.column("g").to_pylist(), y):
            d = np.sqrt(((x - vector) ** 2).sum(axis=1))
            near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
            rows = sorted((d[i], v) for i in near for v in ids[i])[:k]
            of += [q] * len(rows)
            found += [v for _, v in rows]
            score += [float(s) for s, _ in rows]
        return pa.Table.from_arrays([pa.array(of, pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64())], names=names)

    return run


def entries_of(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct vectors (g, v, ids) with their k + 1 smallest ids."""
    rows = vectors.dropDuplicates(["v", "vec_id"])
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    own = ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    return cut(own.select(F.monotonically_increasing_id().alias("g"), "v", "ids"), "entries")


def _index(entries: DataFrame, asked: DataFrame, length: int, n: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Postings (list, g, ids, v) of the entries of one length, and probes (list, g, v) of its queries."""
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_FLOATS // length))
    part = entries if n <= rows else entries.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    sample = _vectors(part.select("v").limit(2 * rows).toArrow().column("v").combine_chunks())
    sample = sample[np.lexsort(sample.T[::-1])]  # rows come in any order
    graph = Graph(bisect(sample, max(1, min(CENTROIDS, n // LIST_MEAN, len(sample) // 4))))
    postings = cut(entries.mapInArrow(_assign(graph), "list int, g long, ids array<long>, v array<double>"), "postings")
    sizes = np.zeros(len(graph.c), np.int64)
    for r in postings.groupBy("list").count().collect():  # a row a centroid at most
        sizes[r[0]] = r[1]
    return postings, cut(asked.mapInArrow(_probe(graph, sizes, k + 1), "list int, g long, v array<double>"), "probes")


def _parts(postings: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and probes with the parts in which they meet: each part of a list's entries meets each part of its queries."""
    of = ["length", "list"]
    cuts = lambda df, name: df.groupBy(*of).agg(F.ceil(F.count("*") / F.lit(LIST_ROWS)).cast("int").alias(name))
    both = cut(cuts(postings, "rows").join(cuts(probes, "asks"), of), "cuts")  # a row a list
    mine = lambda n: F.pmod(F.xxhash64("g"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = postings.join(both, of).withColumn("row", mine("rows")).withColumn("ask", every("asks"))
    right = probes.join(both, of).withColumn("ask", mine("asks")).withColumn("row", every("rows"))
    return left.drop("rows", "asks"), right.drop("rows", "asks")


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Each query's k nearest found: query_id, rank, vec_id, score (Euclidean distance), nearest first, ties to the smaller vec_id.

    Both frames have vec_id and embedding; a query never finds its own id, and
    is compared with vectors of its own length.  Vectors that are null or zero,
    or hold a null or a component that isn't finite, take no part, nor do rows
    without vec_id.  Rows repeated whole count once; a vec_id that has several
    vectors is asked for with each.  Fewer candidates than k are all found.
    Empty tables give no rows.  Further columns are ignored.
    """
    spark = vectors.sparkSession
    clean = lambda df: pick(df, vec_id="long", embedding="array<double>").withColumnRenamed("embedding", "v").where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    every, asked = clean(vectors), clean(queries).distinct()
    entries = entries_of(every, k)
    counts = cut(entries.groupBy(F.size("v").alias("length")).count(), "lengths")
    # lengths with an index: the commonest, and those with very many, of which there are few
    large = {r[0]: r[1] for r in counts.orderBy(F.desc("count"), "length").limit(1).union(counts.where(F.col("count") > LIST_ROWS)).collect()}
    if vectors is queries or entries.isEmpty():
        own = entries.select("g", "v")
    else:
        own = cut(asked.select("v").distinct().select((-1 - F.monotonically_increasing_id()).alias("g"), "v"), "asked")
    wanted = cut(asked.join(own, "v"), "wanted")
    probing = wanted.groupBy("g").agg(F.first("v").alias("v"))
    few = ~F.size("v").isin(*large) if large else F.lit(True)
    named = lambda df, n: df.select(n.alias("length"), *df.columns)
    short = lambda df: named(df.where(few).select(F.lit(0).alias("list"), "*"), F.size("v"))
    postings, probes = short(entries), short(probing)
    for length, n in sorted(large.items()):
        own_postings, own_probes = _index(entries.where(F.size("v") == length), probing.where(F.size("v") == length), length, n, k)
        postings, probes = postings.unionByName(named(own_postings, F.lit(length))), probes.unionByName(named(own_probes, F.lit(length)))
    lists, probes = _parts(postings, probes)
    meet = ["length", "list", "row", "ask"]
    found = lists.groupBy(*meet).cogroup(probes.groupBy(*meet)).applyInArrow(_meet(k + 1), "q long, vec_id long, score double")
    found = found.groupBy("q", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    found = cut(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n"), "found")
    each = wanted.select(F.col("vec_id").alias("query_id"), F.col("g").alias("q")).join(found, "q").where("query_id <> vec_id")
    place = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("score", "vec_id"))
    return each.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
