"""Line dedup: a suffix array over line ids by distributed prefix doubling.

1. Lines (blank ones left out, outer blanks off) that occur once in all texts
   end every repeated run; the others get ids in sorted order.
2. Prefix doubling: the rank of the 2**k lines from a place on is the sorted
   order of the pairs of ranks at level k-1.  Places whose rank nobody shares
   leave: they are leaves of the suffix array already.  Ranks come from a range
   sort of the distinct pairs, so a frequent line never fills a task.
3. Places that share at least ``min_words`` words from there on are a
   longest-common-prefix interval of the suffix array.  As lines have a word at
   least, levels up to log2(min_words) tell all such intervals: the shortest
   stretch of lines with ``min_words`` words has its class from two overlapping
   ranks.  Stretches are taken forwards from each line and backwards from each
   line; the union of those in one maximal repeated run is the whole run.
4. Of the places of a class the first in the order of (doc_id, place) stays,
   the stretches at all others are deleted.  A later copy in the same document
   that overlaps the first stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.storage import Rows, cut

#: A run is deleted from its later places if it has this many words.
MIN_WORDS = 50
_BLANK = " \t\n\x0b\x0c\r"


def lines_of(text: str | None) -> tuple[list[int], list[str]]:
    """Numbers and texts of the lines that aren't blank."""
    found = [(i, s) for i, s in enumerate(x.strip(_BLANK) for x in (text or "").split("\n")) if s]
    return [i for i, _ in found], [s for _, s in found]


def stretches(words: np.ndarray, least: int) -> np.ndarray:
    """Shortest stretches (start, length) with ``least`` words, from each line on and up to each line."""
    total = np.concatenate(([0], np.cumsum(words)))
    n = len(words)
    ends = np.searchsorted(total, total[:-1] + least, side="left")  # total[end] - total[start] >= least
    ahead = np.flatnonzero(ends <= n)
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1
    back = np.flatnonzero(starts >= 0)
    both = np.concatenate([np.stack([ahead, ends[ahead] - ahead], 1), np.stack([starts[back], back + 1 - starts[back]], 1)])
    return np.unique(both, axis=0)


def _split(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, h1, h2, length, back = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                _, lines = lines_of(text)
                if not lines:
                    continue
                words = np.fromiter((len(s.encode("utf-8", "replace").split()) for s in lines), np.int64, len(lines))
                found = stretches(np.maximum(words, 1), least)
                by = {}
                for s, n in found.tolist():
                    by.setdefault(s, []).append(n)
                for p, line in enumerate(lines):
                    d = xxhash.xxh3_128_digest(line.encode("utf-8", "replace"))
                    at.append(i)
                    pos.append(p)
                    h1.append(int.from_bytes(d[:8], "little", signed=True))
                    h2.append(int.from_bytes(d[8:], "little", signed=True))
                    length.append(by.get(p, []))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in ("__file", "__row", "doc_id")] + [pa.array(pos, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(length, pa.list_(pa.int32()))],
                names=["__file", "__row", "doc_id", "pos", "h1", "h2", "lengths"],
            )

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        k = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(k, part, np.int32)), pa.array(np.arange(n, n + k))], names=[*batch.schema.names, "part", "place"])
        n += k


def ranked(keys: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs (a, b) with ``rank``, their place in sorted order: a range sort, then offsets of its partitions."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.select(a, b).repartitionByRange(parts, a, b).sortWithinPartitions(a, b)
    placed = cut(ordered.mapInArrow(_number, f"{a} long, {b} long, part int, place long"), "ranks")
    sizes = {r[0]: r[1] for r in placed.groupBy("part").count().collect()}  # one row a partition
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    starts = F.lit(0).cast("long")
    if offsets:
        starts = F.element_at(F.create_map(*[F.lit(x) for o in offsets for x in (o[0], o[1])]), F.col("part")).cast("long")
    return placed.select(a, b, (F.col("place") + starts).alias("rank"))


def repeated_runs(docs: DataFrame | Rows, min_words: int = MIN_WORDS) -> DataFrame:
    """(__file, __row, start, length): stretches of non-blank lines that are later copies."""
    given = Rows.of(docs)
    place = list(given.key)
    texts = given.pick(doc_id="long", text="string")
    lines = cut(texts.mapInArrow(_split(min_words), "__file long, __row long, doc_id long, pos int, h1 long, h2 long, lengths array<int>"), "lines")
    names = cut(ranked(lines.groupBy("h1", "h2").count().where("count > 1"), "h1", "h2"), "names")
    level = cut(lines.join(names, ["h1", "h2"]).select(*place, "doc_id", "pos", "rank", "lengths"), "level")
    windows = cut(level.select(*place, "doc_id", F.col("pos").alias("start"), F.explode("lengths").alias("length")), "windows")
    level = level.select(*place, "pos", "rank")
    copies = None
    k = 0
    while (1 << k) <= min_words:
        size = 1 << k
        own = windows.where((F.col("length") >= size) & (F.col("length") < 2 * size))
        left = level.select(*place, F.col("pos").alias("start"), F.col("rank").alias("ra"))
        right = level.select(*place, F.col("pos").alias("tail"), F.col("rank").alias("rb"))
        classed = own.join(left, [*place, "start"]).withColumn("tail", F.col("start") + F.col("length") - size).join(right, [*place, "tail"])
        classed = cut(classed.select(*place, "doc_id", "start", "length", "ra", "rb"), "intervals")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *place, "start")
        heads = cut(classed.groupBy("length", "ra", "rb").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "heads")
        found = classed.join(heads, ["length", "ra", "rb"])
        same = (F.col("first.__file") == F.col("__file")) & (F.col("first.__row") == F.col("__row"))
        found = found.where(~same | (F.col("start") - F.col("first.start") >= F.col("length"))).select(*place, "start", "length")
        copies = found if copies is None else copies.unionByName(found)
        k += 1
        if (1 << k) > min_words:
            break
        after = level.select(*place, (F.col("pos") - size).alias("pos"), F.col("rank").alias("next"))
        pairs = cut(level.join(after, [*place, "pos"]), "pairs")
        names = cut(ranked(pairs.groupBy("rank", "next").count().where("count > 1").select(F.col("rank").alias("x"), F.col("next").alias("y")), "x", "y"), "names")
        level = cut(pairs.withColumnsRenamed({"rank": "x", "next": "y"}).join(names, ["x", "y"]).select(*place, "pos", "rank"), "level")
    return copies


def delete_lines(text: str | None, spans: list[tuple[int, int]] | None) -> tuple[str | None, int, int]:
    """The text without the lines of ``spans`` and blank lines inside runs of them; lines deleted; runs."""
    if not spans:
        return text, 0, 0
    numbers, _ = lines_of(text)
    gone, merged = set(), []
    for start, n in sorted(map(tuple, spans)):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], start + n)
        else:
            merged.append([start, start + n])
    for a, b in merged:
        gone.update(range(numbers[a], numbers[b - 1] + 1))
    kept = [s for i, s in enumerate((text or "").split("\n")) if i not in gone]
    return "\n".join(kept), sum(b - a for a, b in merged), len(merged)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [None if s is None else [(x["start"], x["length"]) for x in s] for s in batch.column("spans").to_pylist()]
        texts = batch.column("text").to_pylist()
        done = [delete_lines(t, s) for t, s in zip(texts, spans)]
        counts = [len(lines_of(t)[0]) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("__file", "__row", "doc_id")] + [pa.array([d[0] for d in done], pa.string()), pa.array(counts, pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
            names=["__file", "__row", "doc_id", "text", "n_lines", "deleted_lines", "deleted_runs"],
        )


def dedup_lines(docs: DataFrame | Rows, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, text without later copies, n_lines, deleted_lines, deleted_runs.

    Runs of lines with ``min_words`` words or more that occur before, in the
    order of (doc_id, nulls last, place in the files, line), are deleted.  Lines are
    compared without outer blanks; blank lines don't count, those inside a
    deleted run go with it.  A null text stays null and has no lines; of rows
    repeated whole the later ones lose what is long enough.  An empty table
    gives no rows.  Further columns are ignored.
    """
    given = Rows.of(docs)
    key = list(given.key)
    rows = given.pick(doc_id="long", text="string")
    spans = repeated_runs(given, min_words).groupBy(*key).agg(F.collect_set(F.struct("start", "length")).alias("spans"))  # within one document
    joined = rows.join(spans, key, "left")
    return joined.mapInArrow(_clean, "__file long, __row long, doc_id long, text string, n_lines long, deleted_lines long, deleted_runs long").drop(*key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "deleted_lines", "deleted_runs", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"))
