"""SimHash near-dedup by a segment-popcount embedding.

1. A document's fingerprint has bit b set if more than half of its shingles'
   XXH64 values have it set.  Equal fingerprints are one node from here on.
2. The 64 bits are cut into 32 segments of two; the vector of bits set in each
   segment (0, 1 or 2) embeds the fingerprint so that the Manhattan distance of
   two vectors never exceeds the Hamming distance of the fingerprints.
3. Range join on the grid of such vectors: of two bands of 16 segments, one
   holds at most half of the distance, so with at most 4 differing bits two
   fingerprints lie within Manhattan distance 2 of each other in one band.
   Each fingerprint goes to its own cell of each band and to all cells one step
   off; two within distance 2 then share a cell.  That loses no pair.
4. Within a cell the exact Hamming distance decides.  A cell gives a spanning
   forest of its links, not all pairs: a search that takes linked fingerprints
   off the list of those still to be reached, so a dense group of n costs about
   n comparisons a layer.  Cells of more than ``block`` members are cut into
   blocks, and each pair of blocks is a group of its own.
5. Components of the links; the smallest doc_id names a component.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.components import connected_components
from marginalia.storage import Rows, cut, empty, new_folder, remove_folder

SEED = 42
#: Differing bits that the two-band grid of ``cells`` covers.
MAX_BITS = 4
PAIRS = np.uint64(0x5555555555555555)


def fingerprint(text: str | None, width: int) -> int:
    """Fingerprint of one text; zero if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
        one = xxhash.xxh64_intdigest
        hashes = [one(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits to 4 MB
        part = np.array(hashes[at : at + (1 << 16)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column("text")), np.uint64, batch.num_rows)
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(found.view(np.int64))], names=[*rest, "fp"])

    return run


def fingerprints(rows: DataFrame, width: int) -> DataFrame:
    """Replace the column ``text`` by ``fp``, the fingerprint as a signed long."""
    rest = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rest] + ["fp long"])
    return rows.mapInArrow(_fingerprints(width), schema)


def cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each fingerprint: arrays of cell and of the fingerprint's place.

    A cell is a band (bit 32) and the band's 16 counts of two bits each.
    """
    counts = (fp & PAIRS) + ((fp >> np.uint64(1)) & PAIRS)
    cell, of = [], []
    for band in (0, 1):
        own = ((counts >> np.uint64(32 * band)) & np.uint64(0xFFFFFFFF)) | np.uint64(band << 32)
        cell.append(own)
        of.append(np.arange(len(fp)))
        for segment in range(16):
            step = np.uint64(1 << (2 * segment))
            here = (own >> np.uint64(2 * segment)) & np.uint64(3)
            up, down = np.flatnonzero(here < 2), np.flatnonzero(here > 0)
            cell += [own[up] + step, own[down] - step]
            of += [up, down]
    return np.concatenate(cell).astype(np.int64), np.concatenate(of)


def _explode_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, more = batch.column("fp").to_numpy(zero_copy_only=False), "id" in batch.schema.names
        for at in range(0, len(fp), 2048):
            cell, of = cells(fp[at : at + 2048].view(np.uint64))
            take = lambda c: batch.column(c).to_numpy(zero_copy_only=False)[at : at + 2048][of]  # noqa: B023, E731
            if more:
                cell |= take("space").astype(np.int64) << 33
            names = ["fp", "id"] if more else ["fp"]
            yield pa.RecordBatch.from_arrays([pa.array(cell), *[pa.array(take(n)) for n in names]], names=["cell", *names])


def forest(fp: np.ndarray, names: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges, by name, of a spanning forest of the graph that links fingerprints at ``bits`` or fewer differing bits.

    The search starts from the least name, and takes the nearest first.
    """
    order = np.argsort(names, kind="stable")
    rest, names = fp[order].view(np.uint64), names[order]
    left, right = [], []
    if len(rest) <= 256 and np.count_nonzero(np.bitwise_count(rest[:, None] ^ rest) <= bits) == len(rest):
        rest = rest[:0]  # no links, as in most cells
    queue: deque = deque()
    while len(rest):
        if queue:
            at, name = queue.popleft()
        else:
            at, name, rest, names = rest[0], names[0], rest[1:], names[1:]
        near = np.bitwise_count(rest ^ at) <= bits
        if near.any():
            got, found = rest[near], names[near]
            rest, names = rest[~near], names[~near]
            queue.extend(zip(got, found))
            left.append(np.full(len(got), name, np.int64))
            right.append(found)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _link(bits: int, block: int, dense: int = 0):
    """Over rows sorted by group: the links of each group, or the group's name alone if it has more than ``block`` rows.

    Groups of up to ``dense`` give all their links, larger ones a spanning forest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_key, held_n, out = None, 0, []

        def emit(kind: int, a: np.ndarray, b: np.ndarray) -> None:
            out.append((np.full(len(a), kind, np.int32), a, b))

        def close() -> None:
            nonlocal held, held_n
            if held_n > block:
                emit(1, np.array([held_key[0]]), np.array([held_n]))
            elif held_n > 1:
                fp, names = np.concatenate(held, axis=1)
                if held_n <= dense:
                    i, j = np.nonzero(np.triu(np.bitwise_count(fp.view(np.uint64)[:, None] ^ fp.view(np.uint64)) <= bits, 1))
                    a, b = names[i], names[j]
                else:
                    a, b = forest(fp, names, bits)
                if len(a):
                    emit(0, a, b)
            held, held_n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["kind", "a", "b"])
                out.clear()

        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            fp = column("fp")
            names = column("id") if "id" in batch.schema.names else fp
            group = np.stack([column("cell"), column("part")])
            if not len(fp):
                continue
            starts = np.concatenate(([0], np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1))
            sizes = np.diff(np.append(starts, len(fp)))
            # pairs inside the batch go together; the first and last group may go on elsewhere
            inner = np.arange(len(starts)) > 0
            inner[-1] = False
            two = starts[inner & (sizes == 2)]
            if len(two):
                close_enough = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= bits
                if close_enough.any():
                    emit(0, names[two][close_enough], names[two + 1][close_enough])
            for k in [0, *np.flatnonzero(inner & (sizes > 2)).tolist(), *([len(starts) - 1] if len(starts) > 1 else [])]:
                key = tuple(group[:, starts[k]].tolist())
                if key != held_key:
                    close()
                    held_key = key
                if held_n <= block:
                    part = slice(starts[k], starts[k] + sizes[k])
                    held.append(np.stack([fp[part], names[part]]))
                held_n += int(sizes[k])
                if held_n > block:
                    held = []
            yield from flush()
        close()
        yield from flush()

    return run


def links(nodes: DataFrame, bits: int = MAX_BITS, block: int = 100_000, dense: int = 0) -> DataFrame:
    """(a, b): links that connect all fingerprints of ``nodes`` at ``bits`` or fewer differing bits.

    ``nodes`` has distinct ``fp``, which then name the links; or fp, a ``space``
    within which fingerprints are compared, and an ``id`` that names the links.
    """
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the grid covers 0 to {MAX_BITS} differing bits")
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = [c for c in ("space", "id") if c in nodes.columns]
    spread = nodes.select("fp", *named).mapInArrow(_explode_cells, "cell long, fp long" + ", id long" * bool(named))
    grouped = spread.withColumn("part", F.lit(0)).repartition(parts, "cell").sortWithinPartitions("cell")
    found = cut(grouped.mapInArrow(_link(bits, block, dense), "kind int, a long, b long"), "links")
    out = found.where("kind = 0").select("a", "b")
    large = found.where("kind = 1").select(F.col("a").alias("cell"), F.ceil(F.col("b") / F.lit(block // 2)).cast("int").alias("k"))
    if not large.isEmpty():
        # block i of a large cell meets each block j: parts are the pairs (i, j), i <= j, numbered i * k + j
        mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.least(F.col("i"), j) * F.col("k") + F.greatest(F.col("i"), j))
        again = spread.join(large, "cell").withColumn("i", mine).withColumn("part", F.explode(pairs)).drop("k", "i")
        again = again.repartition(parts, "cell", "part").sortWithinPartitions("cell", "part")
        out = out.unionByName(again.mapInArrow(_link(bits, 1 << 62), "kind int, a long, b long").select("a", "b"))
    return out


def near_groups(docs: DataFrame | Rows, width: int = 4, bits: int = MAX_BITS, block: int = 100_000) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, kept, and the row's key.

    Words are lower-cased in A-Z only and separated by 0x20 and 0x09-0x0D.
    Texts of fewer than ``width`` words have one shingle, null and empty texts
    the fingerprint zero, linked like any other.  component_id is the smallest
    doc_id of the component (null if none has one); ``kept`` marks one row of
    each component, that with the smallest doc_id, nulls last, then the first
    in the files.  Rows repeated whole share a component.  Further columns are
    ignored; an empty table gives no rows.
    """
    given = Rows.of(docs)
    key = given.key
    rows = cut(fingerprints(given.pick(doc_id="long", text="string"), width), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *key)
    nodes = cut(rows.groupBy("fp").agg(F.min(first).alias("first")), "nodes")
    parts = connected_components(links(nodes, bits, block), "a", "b")
    own = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    own = cut(own, "roots")
    least = own.groupBy("root").agg(F.min("first").alias("least"))
    of = cut(own.join(least, "root").select("fp", "least"), "classes")
    found = rows.join(of, "fp")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), F.col("least.doc_id").alias("component_id"), (F.struct(*key) == F.struct(*[F.col(f"least.{k}").alias(k) for k in key])).alias("kept"), *key)


def drop_near_fingerprints(docs: DataFrame, width: int = 4, bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each of ``near_groups``' components, all columns as they were."""
    rows = Rows.of(docs)
    return rows.only(near_groups(rows, width, bits).where("kept"))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = {xxhash.xxh32_intdigest(b" ".join(words[i : i + width])) for i in range(max(1, len(words) - width + 1))} if words else set()
    return np.sort(np.array(list(grams), np.uint32)).view(np.int32)


def _shingled(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
                digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                rest = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], digests, pa.array(sets, pa.list_(pa.int32()))], names=[*rest, "digest", "s"])

    return run


def prefixes(s: np.ndarray, common: np.ndarray, ranks: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The shingles of a set that any similar set shares one of, rarest first, and how many of them lead.

    ``common`` has the frequent shingles, sorted, and ``ranks`` their places from
    1 on, most frequent last; all others come before them by value.  Sets x and
    y, x not the larger, of Jaccard similarity t have t * |y| and
    2 * t / (1 + t) * |x| shingles in common at least.  So the first that they
    share is among the first |y| - t * |y| + 1 of y and the first
    |x| - 2 * t / (1 + t) * |x| + 1 of x, which lead.
    """
    n = len(s)
    least = lambda share: n - int(np.ceil(share * n - 1e-9)) + 1
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rank = np.where(common[at] == s, ranks[at], 0)
    return s[np.lexsort((s, rank))[: min(n, least(similarity))]], least(2 * similarity / (1 + similarity))


def _prefixed(common: np.ndarray, similarity: float):
    ranks = np.argsort(common, kind="stable") + 1
    common = np.sort(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                w, sizes, leads, ns = [np.empty(0, np.int32)], [], [np.empty(0, bool)], []
                for x in batch.column("s"):
                    s = x.values.to_numpy(zero_copy_only=False)
                    found, lead = prefixes(s, common, ranks, similarity) if len(s) else (s, 0)
                    w.append(found)
                    leads.append(np.arange(len(found)) < lead)
                    sizes.append(len(found))
                    ns.append(len(s))
                each = lambda v: pa.array(np.repeat(v, sizes))  # noqa: B023, E731
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(w)), each(ids), each(np.array(ns, np.int32)), pa.array(np.concatenate(leads))], names=["w", "id", "n", "lead"])

    return run


def _common(rows: DataFrame, sample: int = 32768, most: int = 1 << 17) -> np.ndarray:
    """Shingles met three times or more in a sample, most frequent last: only an order, on which no result depends.

    At most ``most`` numbers of four bytes go to the workers.
    """
    share = min(1.0, sample / max(1, rows.count()))
    seen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).select(F.explode("s").alias("w"))
    found = seen.groupBy("w").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "w").limit(most)
    return np.array([r.w for r in found.collect()][::-1], np.int32)


#: Members that a large group's rest is compared with in each round, all at once.
PIVOTS = 4


def similar_links(rows: DataFrame, copies: DataFrame, similarity: float, dense: int = 256, rounds: int = 2) -> DataFrame:
    """(a, b): links with the components of the graph of all pairs of sets ``s`` (named ``id``, all but ``copies`` distinct) that have the similarity.

    Pairs that share a prefix shingle are the candidates, and lose none.  Of
    the sets with one shingle all are compared with the first, the root; those
    similar to it are linked, and need no more tests with each other.  The rest
    must meet every set of the group in the end, but for linked ones so near the
    root that, by the triangle inequality of the Jaccard distance, they can't be
    similar.  Before that, in groups of more than ``dense`` sets, the rest is
    compared with ``PIVOTS`` linked members, ``rounds`` times: of a large group
    of near copies next to none is left then.
    """
    every = empty(rows.sparkSession, "a long, b long")
    at = new_folder(rows.sparkSession, "near")
    put = lambda df, name: cut(df, name, f"{at}/{name}")
    drop = lambda *names: [remove_folder(rows.sparkSession, f"{at}/{n}") for n in names]
    ratio = lambda x, y: F.least(x, y) / F.greatest(x, y)
    shape = "w int, id long, n int, lead boolean, found double, linked boolean, m long"

    def score(pairs: DataFrame, k: str) -> DataFrame:
        """(a, b, found) of pairs (a, b), and their links put to the others."""
        nonlocal every
        pairs = put(pairs.distinct(), f"candidates-{k}")
        sets = put(rows.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").select("id", "s"), f"shingles-{k}")
        joined = pairs.join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        scored = cut(joined.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("found")), "scored")
        every = every.unionByName(scored.where(F.col("found") >= similarity).select("a", "b"))
        drop(f"candidates-{k}", f"shingles-{k}")
        return scored

    def open_(judged: DataFrame) -> DataFrame:
        """Groups that have a rest, without the linked members out of its reach.

        ``found`` of the rest is an upper bound of its similarity to the root.
        """
        nearest = judged.where("not linked").groupBy("w").agg(F.max("found").alias("nearest"))
        kept = judged.join(nearest, "w").where(~F.col("linked") | (F.col("found") <= F.col("nearest") + (1 - similarity + 1e-9)))
        return kept.select(*[c.split()[0] for c in shape.split(", ")])

    held = put(rows.join(copies, "id", "left_anti").select("id", "s").mapInArrow(_prefixed(_common(rows), similarity), "w int, id long, n int, lead boolean"), "prefixes")
    tops = held.groupBy("w").agg(F.count("*").alias("m"), F.min(F.when(F.col("lead"), F.struct("id", "n"))).alias("root")).where("m > 1 and root is not null")
    star = held.join(tops, "w").withColumn("a", F.least("id", "root.id")).withColumn("b", F.greatest("id", "root.id")).withColumn("most", ratio(F.col("n"), F.col("root.n")))
    star = put(star, "stars")
    drop("prefixes")
    scored = score(star.where((F.col("a") < F.col("b")) & (F.col("most") >= similarity)).select("a", "b"), "root")
    judged = star.join(scored, ["a", "b"], "left").withColumn("found", F.coalesce("found", "most"))
    judged = put(judged.select("w", "id", "n", "lead", "found", (F.col("found") >= similarity).alias("linked"), "m"), "judged")
    held = put(open_(judged), "open")
    drop("stars", "judged")
    for k in range(rounds):
        large = held.where(F.col("m") > dense)
        if large.isEmpty():
            break
        chosen = [F.min(F.when(F.col("linked"), F.struct(F.xxhash64(F.lit(k * PIVOTS + j), "id").alias("h"), "id", "n"))).alias(f"p{j}") for j in range(PIVOTS)]
        pivots = large.groupBy("w").agg(*chosen)
        asked = large.where("not linked").join(pivots, "w").select("w", "id", "n", "found", F.explode(F.array(*[f"p{j}" for j in range(PIVOTS)])).alias("p")).where("p is not null")
        asked = put(asked.select("w", "id", F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"), ratio(F.col("n"), F.col("p.n")).alias("most")).where(F.col("most") >= similarity), f"asked-{k}")
        near = asked.join(score(asked.select("a", "b"), f"pivots-{k}"), ["a", "b"]).where(F.col("found") >= similarity).select("w", "id").distinct().withColumn("now", F.lit(True))
        # a member linked by a pivot keeps its bound to the root as it was: no linked member is dropped by it
        later = held.join(near, ["w", "id"], "left").withColumn("found", F.when(F.col("now"), 0.0).otherwise(F.col("found"))).withColumn("linked", F.col("linked") | F.coalesce("now", F.lit(False)))
        held = put(open_(later.drop("now")), f"open-{k}")
        drop(f"asked-{k}", "open" if k == 0 else f"open-{k - 1}")
    x = held.where("not linked").select("w", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("lead").alias("lx"), F.col("found").alias("fx"))
    y = held.select("w", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("lead").alias("ly"), F.col("found").alias("fy"), F.col("linked").alias("ky"))
    both = x.join(y, "w").where("x <> y and (ky or x < y) and ((nx <= ny and lx) or (ny <= nx and ly))").where(ratio(F.col("nx"), F.col("ny")) >= similarity)
    both = both.where(~F.col("ky") | (F.col("fy") <= F.col("fx") + (1 - similarity + 1e-9)))
    score(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "rest")
    remove_folder(rows.sparkSession, at)
    return every


def similar_groups(docs: DataFrame | Rows, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: its key, component (a row number) and ``kept``, by the Jaccard similarity of word shingles.

    Documents whose sets of ``width``-word shingles have the similarity are
    linked; no pair is missed, see ``similar_links``.  Documents of equal sets
    are one from the start.  Of a component the row with the smallest doc_id
    stays, nulls last, then the first in the files.  Nulls and empty texts
    are equal to each other; further columns are ignored.
    """
    given = Rows.of(docs)
    key = list(given.key)
    made = given.pick(doc_id="long", text="string").mapInArrow(_shingled(width), "__file long, __row long, doc_id long, digest binary, s array<int>")
    rows = cut(made.withColumn("id", F.monotonically_increasing_id()), "sets")
    first = cut(rows.groupBy("digest").agg(F.min("id").alias("first")), "nodes")
    copies = cut(rows.select("id", "digest").join(first, "digest").where("id <> first").select("id"), "copies")
    linked = similar_links(rows.select("id", "s"), copies, similarity)
    parts = connected_components(linked, "a", "b")
    nodes = cut(first.join(parts, F.col("first") == F.col("node"), "left").select("digest", F.coalesce("component", "first").alias("component")), "classes")
    own = cut(rows.select("digest", "doc_id", *key).join(nodes, "digest"), "roots")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *key)
    least = own.groupBy("component").agg(F.min(order).alias("least"))
    return own.join(least, "component").select(*key, "doc_id", "component", (F.struct(*key) == F.struct(*[f"least.{k}" for k in key])).alias("kept"), F.col("least.doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies, all columns as they were."""
    rows = Rows.of(docs)
    return rows.only(similar_groups(rows, width, similarity).where("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
