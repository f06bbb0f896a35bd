"""Token ids in binary files by bit-plane shuffling.

A shard file holds the ids of a run of documents in ascending doc_id order:

    header   8 bytes: the magic ``MGPLANE1``
    chunks   one after another; a chunk is a block of up to BLOCK ids cut into
             planes (2 byte planes or 16 bit planes), each compressed by zstandard
    tail     zstandard over: the documents' ids and token counts, 64-bit little-endian
    index    JSON: plane kind, ids in all, for each chunk its first byte, its ids
             and the sizes of its planes, and where the tail lies
    footer   8 bytes: the index's length, little-endian

Texts are encoded where they are read, and their ids alone (16 bits each) are
shuffled: to shards by ranges of (doc_id, row), so that a doc_id which a third of
the rows carry is split among shards.  The ranges come from a sample of the keys.  A reader seeks to the footer, then the index, then only the chunks it wants.
Shards are written through ``pyarrow.fs`` below the shared folder under a name
of the attempt and renamed when whole, so a task may be run again or twice.
"""

from __future__ import annotations

import bisect
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.tokens import encoder, text_batches, vocabulary_path
from marginalia.storage import Rows, cut, new_folder

MAGIC = b"MGPLANE1"
BLOCK = 1 << 16
LEVEL = 3
#: A null doc_id is kept in the file as this value.
NO_ID = -(1 << 63)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of 16-bit ids: ``byte`` gives 2, low byte first; ``bit`` gives 16, bit 0 first."""
    raw = np.ascontiguousarray(ids, "<u2").view(np.uint8).reshape(-1, 2)
    if kind == "byte":
        return [raw[:, b].tobytes() for b in (0, 1)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, b], bitorder="little").tobytes() for b in range(16)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u2")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u2")


class ShardWriter:
    def __init__(self, out, kind: str):
        import zstandard

        self.out, self.kind, self.press = out, kind, zstandard.ZstdCompressor(LEVEL).compress
        self.at, self.total, self.chunks = len(MAGIC), 0, []
        self.held: list[bytes] = []
        self.held_n = 0
        self.doc_ids: list[int] = []
        self.counts: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)
        self.counts.append(len(ids) // 2)
        self.held.append(ids)
        self.held_n += len(ids) // 2
        if self.held_n >= BLOCK:
            whole = np.frombuffer(b"".join(self.held), "<u2")
            full = len(whole) // BLOCK * BLOCK
            for k in range(0, full, BLOCK):
                self._chunk(whole[k : k + BLOCK])
            self.held, self.held_n = [whole[full:].tobytes()], len(whole) - full

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.press(p) for p in to_planes(ids, self.kind)]
        for p in planes:
            self.out.write(p)
        self.chunks.append([self.at, len(ids), [len(p) for p in planes]])
        self.at += sum(map(len, planes))
        self.total += len(ids)

    def close(self) -> None:
        if self.held_n:
            self._chunk(np.frombuffer(b"".join(self.held), "<u2"))
        tail = self.press(np.array(self.doc_ids, "<i8").tobytes() + np.array(self.counts, "<i8").tobytes())
        self.out.write(tail)
        index = json.dumps({"kind": self.kind, "ids": self.total, "docs": len(self.counts), "chunks": self.chunks, "tail": [self.at, len(tail)]}).encode()
        self.out.write(index)
        self.out.write(len(index).to_bytes(8, "little"))


class ShardReader:
    """Reads a shard by its chunk index; ``source`` is an open random-access file."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpress = source, zstandard.ZstdDecompressor().decompress
        size = source.size()
        n = int.from_bytes(self._at(size - 8, 8), "little")
        if self._at(0, 8) != MAGIC:
            raise ValueError("not a shard of token ids")
        self.index = json.loads(self._at(size - 8 - n, n))

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(self.unpress(self._at(*self.index["tail"])), "<i8")
        return raw[: len(raw) // 2], raw[len(raw) // 2 :]

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.index["chunks"][k]
        raw, planes = self._at(at, sum(sizes)), []
        for size in sizes:
            planes.append(self.unpress(raw[:size]))
            raw = raw[size:]
        return from_planes(planes, n, self.index["kind"])

    def read(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from the place ``first`` on; touches only the chunks that hold them."""
        out, at = [], 0
        for k, (_, size, _) in enumerate(self.index["chunks"]):
            if at < first + n and first < at + size:
                out.append(self.chunk(k)[max(0, first - at) : first + n - at])
            at += size
        return np.concatenate(out) if out else np.empty(0, "<u2")


#: Keys sampled a shard, for the ranges.
KEYS = 100


def ranges(keys: DataFrame, shards: int) -> list[tuple]:
    """First keys (doc_id, __file, __row) of all shards but the first, nulls first; at most ``shards * KEYS`` keys, or twice that, come to the driver."""
    part = "__part"
    rows = keys.withColumn(part, F.pmod(F.xxhash64("__file", "__row"), F.lit(1 << 30)))
    share = min(1.0, shards * KEYS / max(1, rows.count()))
    found = rows.where(F.col(part) < int(share * (1 << 30))).limit(2 * shards * KEYS).select("doc_id", "__file", "__row").collect() if share < 1 else rows.select("doc_id", "__file", "__row").collect()
    ordered = sorted(((r[0] is not None, r[0] or 0, r[1], r[2]) for r in found))
    return sorted({ordered[len(ordered) * k // shards] for k in range(1, shards)}) if ordered else []


def _encode(path: str, bounds: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in text_batches(texts):
                part = batch.slice(a, b - a)
                keys = zip(*(part.column(c).to_pylist() for c in ("doc_id", "__file", "__row")))
                shard = [bisect.bisect_right(bounds, (d is not None, d or 0, f, r)) for d, f, r in keys]
                ids = pa.array(encoder(path).encode(texts[a:b]), pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("__file", "__row", "doc_id")], pa.array(shard, pa.int32()), ids], names=["__file", "__row", "doc_id", "shard", "ids"])

    return run


def _write(folder: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part, writer, sink = TaskContext.get().partitionId(), None, None
        store, root = fs.FileSystem.from_uri(folder)
        name, passing = f"{root}/shard-{part:06d}.mgp", f"{root}/_attempt-{part:06d}-{uuid.uuid4().hex[:8]}"
        for batch in batches:
            if writer is None and batch.num_rows:
                sink = store.open_output_stream(passing)
                writer = ShardWriter(sink, kind)
            for key, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                writer.add(key, ids.as_py())
        if writer is not None:
            writer.close()
            sink.close()
            store.move(passing, name)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "name": [name.removeprefix(root)], "n_docs": [len(writer.counts)], "n_ids": [writer.total]})

    return run


def write_shards(docs: DataFrame | Rows, folder: str, path: str | None = None, kind: str = "byte", shards: int | None = None) -> DataFrame:
    """Encode every text and write the shards; returns the manifest (shard, name, n_docs, n_ids, first_id)."""
    given = Rows.of(docs)
    spark, key = given.frame.sparkSession, given.key
    rows = given.pick(doc_id="long", text="string")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = ranges(rows.drop("text"), shards)
    encoded = rows.mapInArrow(_encode(path or vocabulary_path(), bounds), "__file long, __row long, doc_id long, shard int, ids binary")
    ordered = encoded.repartitionById(shards, F.col("shard")).sortWithinPartitions("doc_id", *key).select("doc_id", "ids")
    made = cut(ordered.mapInArrow(_write(folder, kind), "shard int, name string, n_docs long, n_ids long"), "manifest", f"{folder}/manifest")
    # one row a shard, so a window over all of them is small
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("first_id").to_pylist()):
                with store.open_input_file(root + name) as source:
                    reader = ShardReader(source)
                    keys, counts = reader.documents()
                    starts = np.cumsum(counts) - counts
                    sums, held, k = [], np.empty(0, "<u2"), 0
                    for n in counts.tolist():
                        crc = 0  # goes on from chunk to chunk, so a document of any length takes one chunk's memory
                        while n:
                            if not len(held):
                                held, k = reader.chunk(k), k + 1
                            crc = zlib.crc32(held[:n].astype("<u4").tobytes(), crc)
                            n, held = n - min(n, len(held)), held[n:]
                        sums.append(crc)
                for a in range(0, len(sums), 10_000):
                    part = slice(a, a + 10_000)
                    ids = pa.array(keys[part], mask=keys[part] == NO_ID)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(starts[part] + base), pa.array(counts[part]), pa.array(sums[part], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    names = manifest.select("name", "first_id").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name")
    return names.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame | Rows, folder: str | None = None, path: str | None = None, kind: str = "byte") -> DataFrame:
    """Write all documents' ids to shards and read them back: doc_id, start, n_tokens, ids_crc32.

    Null texts are empty and have the end id alone.  Null doc_ids come first;
    rows of equal doc_id, repeated whole or not, follow in the order of their
    place in the files.  An empty table gives no file and no rows.  Further
    columns are ignored.
    """
    folder = folder or new_folder(docs.sparkSession if isinstance(docs, DataFrame) else docs.frame.sparkSession, "token-ids")
    return read_documents(write_shards(docs, folder, path, kind), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
