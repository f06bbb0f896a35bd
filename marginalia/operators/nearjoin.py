"""Candidates for pairs of near equal bags of words: an exact filter, in Arrow batches.

A bag is a set of numbered words (the second ``the`` is a word of its own), by
64-bit keys whose order is the same everywhere and puts rare words first.  Two
bags of sizes x <= y that agree share at least ``needed(x, y)`` words, so the
first word that they share has at least that many from it on in both.  Rows of
equal words meet sorted by size; those in reach by size and by the words left
are compared by a sketch: 128 parities of the bag, of which two bags differ in
no more than in words.  Large bags, in which so few parities tell nothing, have
a longer sketch, by which the pairs found are compared once more.  Keys that
clash make pairs only, they lose none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import similarity as S
from marginalia.functions import text as X

_SKETCH = [f"s{i}" for i in range(2)]
_PLAIN, _LONG = 128, 384  # parities of each bag; words from which a bag has more of them
_CHARS = 1 << 20  # of texts taken at once
_ORDER = 22  # bits of a word's key that look up how frequent it is
_STEP, _BASE = np.uint64(0x9E3779B97F4A7C15), 0x9FB21C651E98DF25
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True
_powers: list[np.ndarray] = []


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def _powered(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, _CHARS), by, np.uint64)])) for by in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64)))]
    return _powers


def bags(normals: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the numbered words of normal texts, and where each text's begin (and the last ends)."""
    data = np.frombuffer("\n".join(["", *normals, ""]).encode("latin-1", "replace"), np.uint8)
    word = _WORD[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    power, inverse = _powered(len(data))
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * power[: len(data)])])
    words = (summed[end] - summed[start]) * inverse[start]
    first = np.cumsum([1, *[len(t) + 1 for t in normals]])  # a character is a byte
    bound = np.searchsorted(start, first)
    text = np.repeat(np.arange(len(normals), dtype=np.uint64), np.diff(bound))
    key = np.sort((text << np.uint64(48)) | (_mixed(words) >> np.uint64(16)))  # 2 ** 16 texts at most
    n = len(key)
    new = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), key[1:] != key[:-1]]))
    k = np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))
    return _mixed((key & np.uint64((1 << 48) - 1)) + (k + 1).astype(np.uint64) * _STEP), bound


def needed(x, y):
    """Words that bags of these sizes share at least if they agree."""
    return np.maximum(np.ceil(S.JACCARD / (1 + S.JACCARD) * (x + y) - 1e-9), np.ceil(S.CONTAINMENT * np.minimum(x, y) - 1e-9))


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and (size + len(t) > _CHARS or i - at >= 4096):
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def _texts(batch: pa.RecordBatch) -> list[str]:
    if "normal" in batch.schema.names:
        return batch.column("normal").to_pylist()
    return X.identity_forms(batch.column("text").to_pylist())


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _texts(batch)
        for at, end in _slices(texts):
            yield pa.RecordBatch.from_arrays([pa.array(bags(texts[at:end])[0].view(np.int64))], names=["w"])


def frequent(rows: DataFrame, sample: int = 4096, most: int = 1 << 16) -> np.ndarray:
    """Words met three times or more in a sample of ``rows`` by id, most frequent last: only an order, on which no result depends."""
    share = min(1.0, sample / max(1, rows.count()))
    text = "normal" if "normal" in rows.columns else "text"
    seen = rows.where(F.pmod(F.xxhash64("comment_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select(text).mapInArrow(_keys, "w long")
    found = seen.groupBy("w").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "w").limit(most)
    return np.array([r.w for r in found.collect()][::-1], np.int64).view(np.uint64)


def parities(n: int) -> int:
    """Length of the longer sketch of a bag of n words: a power of two, n at least; 0 if it has none."""
    return 1 << (n - 1).bit_length() if n > _LONG else 0


def _featured(common: np.ndarray, raw: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a word that shares its slot with a frequent one counts as frequent, in every text
        order = np.zeros(1 << _ORDER, np.uint32)
        order[common >> np.uint64(64 - _ORDER)] = np.arange(1, len(common) + 1)
        low = np.uint64((1 << 47) - 1)
        for whole in batches:
            every = _texts(whole)
            for at, end in _slices(every):
                batch, texts = whole.slice(at, end - at), every[at:end]
                if raw:
                    some = [bool(t) for t in texts]
                    batch, texts = batch.filter(pa.array(some)), [t for t in texts if t]
                if not texts:
                    continue
                w, bound = bags(texts)
                n = np.diff(bound)
                keys = (order[w >> np.uint64(64 - _ORDER)].astype(np.uint64) << np.uint64(47)) | (w & low)
                text = np.repeat(np.arange(len(texts)), n)
                odd = np.bincount(text * _PLAIN + (w & np.uint64(_PLAIN - 1)).astype(np.int64), minlength=len(texts) * _PLAIN) & 1
                sketch = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, len(_SKETCH))
                first, long = [], []
                for i, (b, e) in enumerate(zip(bound[:-1], bound[1:])):
                    size = int(e - b)
                    mine = np.sort(keys[b:e])
                    if size < 9:  # such bags agree only if they are equal
                        first.append(np.array([xxhash.xxh3_64_intdigest(mine.tobytes())], np.uint64).view(np.int64))
                    else:  # the larger of two bags shares JACCARD of its words at least
                        first.append(mine[: size - int(np.ceil(S.JACCARD * size - 1e-9)) + 1].view(np.int64))
                    m = parities(size)
                    long.append(np.packbits((np.bincount((w[b:e] & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)).tobytes() if m else b"")
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in first])]).astype(np.int32)
                flat = np.concatenate(first) if first else np.zeros(0, np.int64)
                made = {"n": pa.array(n, pa.int32()), "first": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), "long": pa.array(long, pa.binary()), **{s: pa.array(sketch[:, i].copy()) for i, s in enumerate(_SKETCH)}}
                if raw:
                    made["digest"] = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
                    made["marks"] = pa.array(np.array([xxhash.xxh3_64_intdigest(repr(X.marks(t))) for t in texts], np.uint64).view(np.int64))
                rest = [c for c in whole.schema.names if c not in ("normal", "text")]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *made.values()], names=[*rest, *made])

    return run


def features(rows: DataFrame) -> DataFrame:
    """Replace ``normal`` by the bag's size n, its first words that any agreeing bag shares one of, and its sketches.

    Where ``rows`` have no ``normal`` it is made of ``text``; rows without any
    are left out, and the normal text's digest and hashed marks come along.
    """
    raw = "normal" not in rows.columns
    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("normal", "text")]
    made = ["n int", "first array<long>", "long binary", *[f"{s} long" for s in _SKETCH], *["digest binary", "marks long"][: 2 * raw]]
    return rows.mapInArrow(_featured(frequent(rows), raw), ", ".join([*rest, *made]))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, n): ids of those in reach of each other, by sizes, places and sketches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        new = [column("cell"), column("id"), column("n").astype(np.int64), column("place").astype(np.int64), np.stack([column(s) for s in _SKETCH], axis=1)]
        old = 0 if held is None else len(held[0])
        cell, name, n, place, sketch = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        left_over, total = n - place, len(cell)
        alive, d, a, b = np.arange(total - 1), 1, [], []
        while True:
            alive = alive[alive + d < total]
            alive = alive[(cell[alive + d] == cell[alive]) & (n[alive] >= S.JACCARD * n[alive + d] - 1e-9)]
            if not len(alive):
                break
            x = alive[alive + d >= old]
            y = x + d
            least = needed(n[x], n[y])
            ok = np.minimum(left_over[x], left_over[y]) >= least
            x, y, least = x[ok], y[ok], least[ok]
            if len(x):
                near = np.bitwise_count((sketch[x] ^ sketch[y]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= n[x] + n[y] - 2 * least
                a.append(name[x[near]])
                b.append(name[y[near]])
            d += 1
        keep = (cell == cell[-1]) & (n >= S.JACCARD * n[-1] - 1e-9)
        held = [v[keep] for v in (cell, name, n, place, sketch)]
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["left", "right"])


def _in_reach(x: bytes, y: bytes, n: int, m: int) -> bool:
    """Whether bags with these long sketches may agree; the longer sketch is folded to the other's length."""
    if not x or not y:
        return True
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(a) < len(b):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) <= n + m - 2 * int(needed(n, m))


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left_long, right_long, left_n, right_n = (batch.column(c).to_pylist() for c in ("left_long", "right_long", "left_n", "right_n"))
        ok = pa.array([_in_reach(*x) for x in zip(left_long, right_long, left_n, right_n)], pa.bool_())
        yield batch.select(["left", "right"]).filter(ok)


def candidates(rows: DataFrame, block: list[str], sketches: DataFrame | None = None) -> DataFrame:
    """(left, right), distinct: all pairs of rows of ``features`` that may agree, with equal values of ``block``.

    ``sketches`` has n and long of all ids; by default ``rows`` have them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.select(*block, F.col("comment_id").cast("long").alias("id"), "n", *_SKETCH, F.posexplode("first").alias("place", "w"))
    each = each.select(F.xxhash64(*block, "w").alias("cell"), "id", "n", "place", *_SKETCH)
    met = each.repartition(parts, "cell").sortWithinPartitions("cell", "n").mapInArrow(_meet, "left long, right long").where("left < right").distinct()
    side = lambda s: (sketches or rows).select(F.col("comment_id").alias(s), F.col("long").alias(f"{s}_long"), F.col("n").alias(f"{s}_n"))
    return met.join(side("left"), "left").join(side("right"), "right").mapInArrow(_reached, "left long, right long").distinct()
