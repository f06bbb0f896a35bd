"""Mixing sources to target weights, with DataFrame functions only.

1. A source's target words: weights are shared out, no source above twice its
   size, the excess reshared by weight (filling to a common level).
2. A document is a run of cells of ``CELL_WORDS`` words, in blocks of up to
   ``BLOCK_CELLS`` cells.  A source's target is so many whole passes and a quota
   of cells for one more.
3. Documents fall to shards by hash.  A splitting tree deals each source's quota
   out to the shards: a node's quota goes to its (up to 16) children by a
   multivariate hypergeometric draw, as a uniform draw of cells without
   replacement would, and the quotas of the children add up exactly.
4. In a shard, the blocks of a source are permuted by hash and drawn in that
   order until the shard's quota is met: draws are disjoint, blocks stay whole
   but for one a source and shard, which gives its first cells.
5. A second hash shuffles what a shard has drawn: ``position`` is a document's
   place in its shard, and the mix is written in that order.

A window holds the blocks of one source in one shard, about ``SHARD_ROWS``
documents in all sources together, so no source is ever in one task.  Documents
that share doc_id, size and source, however many, are told apart by their row
and so fall to many shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.storage import Rows, cut

# Fixed values of the default mix.
WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
CELL_WORDS, BLOCK_CELLS = 16, 32
SHARD_ROWS = 1024
FANOUT_BITS = 4
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _walk(steps: Column, ratio, goal: Column) -> Column:
    """Running weights from 1 on by ``ratio``: struct(w, s, hit), hit being the number of steps after which the sum reaches goal."""
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("hit"))

    def step(acc: Column, k: Column) -> Column:
        w = acc["w"] * ratio(k)
        return _let(w, lambda x: F.struct(x.alias("w"), (acc["s"] + x).alias("s"), F.when(acc["s"] + x < goal, acc["hit"] + 1).otherwise(acc["hit"]).alias("hit")))

    return F.aggregate(steps, start, step)


def hypergeometric(left: Column, right: Column, quota: Column, u: Column) -> Column:
    """How many of ``quota`` draws without replacement fall to the ``left`` ones: the inverse of the distribution at ``u``.

    Probabilities are walked from the mode outwards by their ratios, to 9
    standard deviations on either side; beyond lies less than a double tells
    from none.
    """
    none = F.array().cast("array<bigint>")

    def ranged(a: dict) -> Column:
        m, lo, hi = a["m"], a["lo"], a["hi"]
        nl, nr, q = a["nl"], a["nr"], a["q"]
        n = (nl + nr).cast("double")
        sd = F.sqrt(F.greatest(q * (nl / n) * (nr / n) * ((n - q) / F.greatest(n - 1, F.lit(1.0))), F.lit(0.0)))
        reach = F.ceil(9 * sd).cast("long") + 2
        top, low = F.least(hi, m + reach), F.greatest(lo, m - reach)
        ups = F.when(top > m, F.sequence(m, top - 1)).otherwise(none)
        downs = F.when(low < m, F.sequence(m, low + 1, F.lit(-1).cast("long"))).otherwise(none)
        up = lambda k: ((nl - k) * (q - k)).cast("double") / ((k + 1) * (nr - q + k + 1))
        down = lambda k: (k * (nr - q + k)).cast("double") / ((nl - k + 1) * (q - k + 1))
        endless = F.lit(float("inf"))
        sums = F.struct(_walk(ups, up, endless)["s"].alias("above"), _walk(downs, down, endless)["s"].alias("below"))

        def choose(s: Column) -> Column:
            goal = u * (1 + s["above"] + s["below"])
            higher = m + 1 + _walk(ups, up, goal - 1)["hit"]
            lower = m - 1 - _walk(downs, down, goal - 1 - s["above"])["hit"]
            return F.when(goal <= 1, m).when(goal <= 1 + s["above"], F.least(higher, top)).otherwise(F.greatest(lower, low))

        return _let(sums, choose)

    lo, hi = F.greatest(F.lit(0).cast("long"), quota - right), F.least(quota, left)
    mode = F.floor((quota + 1).cast("double") * (left + 1) / (left + right + 2)).cast("long")
    known = F.struct(left.alias("nl"), right.alias("nr"), quota.alias("q"), lo.alias("lo"), hi.alias("hi"), F.least(F.greatest(mode, lo), hi).alias("m"))
    return F.when(lo >= hi, lo).otherwise(_let(known, ranged))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: sk, source_size, cells, target, passes, quota.  Windows here run over one row per source."""
    by = sized.groupBy("sk", "source").agg(F.sum("size").alias("source_size"), F.sum("cells").alias("cells"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place - 1, F.lit(len(weights))))
    by = by.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")).withColumn("goal", share * F.sum("source_size").over(Window.partitionBy()))
    by = by.withColumn("level", F.col("most") / F.col("weight"))
    upto = Window.orderBy("level", "sk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.orderBy("level", "sk").rowsBetween(1, Window.unboundedFollowing)
    by = by.withColumn("full", F.sum("most").over(upto)).withColumn("open", F.coalesce(F.sum("weight").over(after), F.lit(0.0)))
    by = by.withColumn("sated", F.col("full") + F.col("level") * F.col("open") <= F.col("goal"))
    everywhere = Window.partitionBy()
    by = by.withColumn("spent", F.coalesce(F.max(F.when(F.col("sated"), F.col("full"))).over(everywhere), F.lit(0.0)))
    by = by.withColumn("open_weight", F.sum(F.when(~F.col("sated"), F.col("weight"))).over(everywhere))
    target = F.when(F.col("sated"), F.col("most")).otherwise(F.least("most", F.col("weight") * (F.col("goal") - F.col("spent")) / F.col("open_weight")))
    by = by.withColumn("target", target)
    size = F.greatest("source_size", F.lit(1))
    passes = F.least(F.floor(F.col("target") / size), F.lit(int(cap))).cast("long")
    quota = F.round((F.col("target") - F.col("passes") * F.col("source_size")) / size * F.col("cells")).cast("long")
    return by.withColumn("passes", passes).select("sk", "source_size", "cells", "target", "passes", F.least(F.greatest(quota, F.lit(0)), "cells").alias("quota"))


def split_quotas(leaves: DataFrame, sources: DataFrame, bits: int, seed: int) -> DataFrame:
    """(sk, shard, quota): each source's quota dealt out to ``2**bits`` shards.  leaves: (sk, shard, cells)."""
    level = sources.select("sk", F.lit(0).cast("long").alias("node"), "quota")
    done = 0
    while done < bits:
        step = min(FANOUT_BITS, bits - done)
        below = bits - done - step
        node = F.shiftright("shard", below)
        counts = leaves.groupBy("sk", node.alias("child")).agg(F.sum("cells").alias("n"))
        fans = counts.groupBy("sk", F.shiftright("child", step).alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "n"))).alias("children"), F.sum("n").alias("rest"))
        start = lambda: F.struct(F.col("rest").alias("rest"), F.col("quota").alias("left"), F.array().cast("array<struct<child:bigint,quota:bigint>>").alias("dealt"))

        mark = F.lit(done)

        def deal(acc: Column, x: Column) -> Column:
            u = (F.pmod(F.xxhash64(F.lit(seed), mark, F.col("sk"), x["child"]), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
            drawn = hypergeometric(x["n"], acc["rest"] - x["n"], acc["left"], u)
            return _let(drawn, lambda q: F.struct((acc["rest"] - x["n"]).alias("rest"), (acc["left"] - q).alias("left"), F.concat(acc["dealt"], F.array(F.struct(x["child"].alias("child"), q.alias("quota")))).alias("dealt")))

        level = level.join(fans, ["sk", "node"]).select("sk", F.explode(F.aggregate("children", start(), deal)["dealt"]).alias("d")).select("sk", F.col("d.child").alias("node"), F.col("d.quota").alias("quota"))
        done += step
    return level.withColumnRenamed("node", "shard")


def spread(sized: DataFrame, seed: int) -> DataFrame:
    """``sized`` with ``h``, a hash that is the same wherever the table lies, but that many equal rows don't share.

    It is that of doc_id, size and source; rows which have it in common (counted
    by partial sums) are told apart by their row number.
    """
    first = sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "sk"))
    shared = first.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("__h"))
    joined = first.join(shared, F.col("h") == F.col("__h"), "left")
    return joined.withColumn("h", F.when(F.col("__h").isNull(), F.col("h")).otherwise(F.xxhash64("h", "__row"))).drop("__h")


def draw(docs: DataFrame | Rows, seed: int = 0, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per document: key, doc_id, source, size, source_size, target, passes, pieces, taken, shard, h.

    ``pieces`` are the drawn blocks as struct(start, n) in words.  The rows of a
    shard are in one partition.
    """
    given = Rows.of(docs)
    key = given.key
    spark = given.frame.sparkSession
    sized = given.pick(doc_id="long", source="string", text="string").withColumn("size", word_count(F.col("text"))).drop("text")
    sized = sized.withColumn("cells", F.ceil(F.col("size") / CELL_WORDS).cast("long")).withColumn("sk", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    sized = cut(spread(cut(sized, "counted"), seed), "sized")
    bits = max(1, math.ceil(math.log2(max(1, sized.count()) / SHARD_ROWS)))
    sized = sized.withColumn("shard", F.shiftrightunsigned("h", 64 - bits))
    sources = cut(targets(sized, weights, share, cap), "sources")
    leaves = cut(sized.groupBy("sk", "shard").agg(F.sum("cells").alias("cells")), "leaves")
    quotas = split_quotas(leaves, sources, bits, seed).join(sources.drop("quota", "cells"), "sk")
    quotas = cut(quotas, "quotas")
    # a document without a word has one block without a cell
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("cells") / BLOCK_CELLS) - 1, F.lit(0).cast("long")))
    each = sized.join(quotas, ["sk", "shard"]).withColumn("block", F.explode(blocks))
    each = each.withColumn("n", F.least(F.lit(BLOCK_CELLS).cast("long"), F.col("cells") - F.col("block") * BLOCK_CELLS))
    each = each.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    order = [F.xxhash64(F.lit(seed + 2), "h", "block"), "h", "block", *key]
    before = Window.partitionBy("sk", "shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cells = F.least("n", F.greatest(F.lit(0), F.col("quota") - F.coalesce(F.sum("n").over(before), F.lit(0))))
    start = F.col("block") * (BLOCK_CELLS * CELL_WORDS)
    each = each.withColumn("start", start).withColumn("words", F.least(F.col("size") - F.col("start"), cells * CELL_WORDS))
    piece = F.when(F.col("words") > 0, F.struct("start", F.col("words").alias("n")))
    # a document's blocks lie in one partition already
    drawn = each.groupBy("shard", "sk", "h", *key, "doc_id", "source", "size", "source_size", "target", "passes").agg(F.sum("words").alias("extra"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    return drawn.withColumn("taken", (F.col("passes") * F.col("size") + F.col("extra")).cast("long"))


def mix(docs: DataFrame | Rows, seed: int = 0, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, shard, position, and the row's key.

    ``position`` is the document's place, from 0 on, in the shuffled order of its
    shard.  A null text has no words and gives none; a null source is a source of
    its own, the last; null doc_ids are documents like others.  Documents equal
    in doc_id, size and source are told apart by their row.  An empty table gives
    no rows.  Further columns are ignored.
    """
    given = Rows.of(docs)
    drawn = draw(given, seed, weights, share, cap)
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "h"), "h", *given.key)
    return drawn.select("doc_id", "source", "size", "source_size", "target", "taken", "shard", (F.row_number().over(shuffled) - 1).alias("position"), *given.key)


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself, in the columns of ``docs``, a shard's rows together and in shuffled order.

    A document is there once for each whole pass over it, once more if the draw
    took all of its blocks, else once with the words of each block drawn
    (n_chars, where there is such a column, then counts those).  Documents of
    which nothing is taken, as those of null, empty or blank text, are not there.
    Null doc_ids and sources, equal rows, and columns of any names are carried
    along; an empty table stays empty.
    """
    given = Rows.of(docs)
    whole = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n"))  # no words asked for: all of them
    again = F.when(F.col("extra") == F.col("size"), F.array(whole)).otherwise(F.col("pieces"))
    takes = draw(given, seed).where("taken > 0").withColumn("copies", F.concat(F.array_repeat(whole, F.col("passes").cast("int")), again))
    takes = takes.select(*given.key, "shard", "h", F.posexplode("copies").alias("__copy", "__piece"))
    takes = cut(takes.withColumn("__place", F.xxhash64(F.lit(seed + 1), "h", "__copy")).withColumnRenamed("shard", "__shard").drop("h", "__copy"), "takes")
    rows = given.frame.join(takes, list(given.key))
    text, cut_short = given.at("text"), F.col("__piece.n") > 0
    found = F.regexp_extract_all(F.col(text).cast("string"), F.lit("[\\x20\\x09-\\x0D]*" + WORD), F.lit(0))
    part = F.array_join(F.slice(found, (F.col("__piece.start") + 1).cast("int"), F.col("__piece.n").cast("int")), "")
    part = F.when(F.col("__piece.start") > 0, F.regexp_replace(part, "^[\\x20\\x09-\\x0D]+", "")).otherwise(part)
    rows = rows.withColumn(text, F.when(cut_short, part).otherwise(F.col(text)))
    if "n_chars" in given.names:
        n = given.at("n_chars")
        rows = rows.withColumn(n, F.when(cut_short, F.length(text).cast(rows.schema[n].dataType)).otherwise(F.col(n)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return given.restored(rows.repartition(parts, "__shard").sortWithinPartitions("__shard", "__place"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "shard", "position")
