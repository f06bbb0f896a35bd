"""Cost-balanced packing of documents into sequences of a fixed capacity.

A piece of n tokens is estimated to cost ``linear * n + quadratic * n * n``.
Documents are taken in descending length; each goes to the sequence of lowest
cost that has room for it.  As many sequences are opened as the tokens fill.
A document that fits nowhere whole is cut to fill what room there is, and one
longer than a sequence fills sequences of its own first.  The tokens that do
not fill a last sequence go to sequences of a power of two, which need no
padding.

Packing runs within a task over groups of documents as they come, so no text is
shuffled and memory is bounded by a group's ids (a group closes by tokens or by
documents) and one text; a group leaves at most twelve short sequences.  A sequence's id holds its task's partition, so ids are unique
and the same when a task is run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.tokens import encoder, text_batches, vocabulary_path
from marginalia.storage import pick

CAPACITY = 4096
#: Tokens that a task gathers before it packs them: 1,024 full sequences, 8 MB of ids; and documents, which may be empty.
GROUP_TOKENS, GROUP_DOCS = 1 << 22, 1 << 16
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def powers_of_two(n: int) -> list[int]:
    """The powers of two that add up to ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def plan(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths."""
    pieces: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []  # (tokens left, document, start)
    sequences = 0
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            pieces.append((doc, at, capacity, sequences, 0))
            sequences += 1
            at += capacity
        if n > at:
            rest.append((n - at, doc, at))
    total = sum(r[0] for r in rest)
    rooms = np.array([capacity] * (total // capacity) + powers_of_two(total % capacity), np.int64)
    free, cost = rooms.copy(), np.zeros(len(rooms))

    def put(s: int, n: int, doc: int, start: int) -> None:
        pieces.append((doc, start, n, sequences + s, int(rooms[s] - free[s])))
        free[s] -= n
        cost[s] += LINEAR * n + QUADRATIC * n * n

    uncut = []
    for n, doc, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        fitting = np.where(free >= n, cost, np.inf)
        s = int(fitting.argmin())
        if fitting[s] < np.inf:
            put(s, n, doc, start)
        else:
            uncut.append((n, doc, start))
    # what fits nowhere whole fills the rooms left, the largest first; they add up to the same
    left = iter(np.argsort(-free, kind="stable").tolist())
    s = next(left, None)
    for n, doc, start in uncut:
        while n:
            if not free[s]:
                s = next(left)
                continue
            take = min(n, int(free[s]))
            put(s, take, doc, start)
            n, start = n - take, start + take
    return pieces


def _pack(path: str, group_tokens: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, encode = TaskContext.get().partitionId() << 40, encoder(path)
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        held = sequences = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, doc_ids, held, sequences
            found = plan([len(x) // 2 for x in ids], capacity)
            rows = [
                (doc_ids[d], start, n, zlib.crc32(np.frombuffer(ids[d], "<u2", n, 2 * start).astype("<u4").tobytes()), len(ids[d]) // 2, base + sequences + s, offset)
                for d, start, n, s, offset in found
            ]
            sequences += 1 + max(f[3] for f in found)
            ids, doc_ids, held = [], [], 0
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=names)

        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in text_batches(texts):
                for key, found in zip(keys[a:b], encode.encode(texts[a:b])):
                    ids.append(found)
                    doc_ids.append(key)
                    held += len(found) // 2
                    if held >= group_tokens or len(ids) >= GROUP_DOCS:
                        yield close()
        if ids:
            yield close()

    return run


def pack(docs: DataFrame, path: str | None = None, group_tokens: int = GROUP_TOKENS, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty and has the end id alone; a null doc_id stays
    null; rows repeated whole are packed each.  Every id of every document lies
    in exactly one piece.  Offsets of a sequence's pieces have no gaps.  An
    empty table gives no rows.  Further columns are ignored.
    """
    rows = pick(docs, doc_id="long", text="string")
    return rows.mapInArrow(_pack(path or vocabulary_path(), group_tokens, capacity), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
