"""Deduplication of records without losing the audit trail: winners, copies, near pairs and document identity."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import similarity as S
from marginalia.functions import text as X
from marginalia.operators import nearjoin
from marginalia.operators.components import connected_components
from marginalia.plans.records import normal_sql, record_texts, records, sql, table
from marginalia.storage import cut


def winner_order(df: DataFrame) -> list[Column]:
    """Confirmed link first, then a response, verified text, position and id."""
    return [F.when(F.col("link_status") == "confirmed", 0).otherwise(1), F.when(F.col("response_id").isNotNull(), 0).otherwise(1), F.when(F.col("trust") == "verified", 0).otherwise(1), F.col("comment_id")]


def mark_duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Winner of each group of equal keys, by partial aggregates: duplicate_of (null for winners), group_size.

    The winner is the least struct of the order, found by a sum-like aggregate
    and joined back, so a group of any size is spread over tasks.
    """
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(winner_order(df))])
    best = df.groupBy(*key).agg(F.min(order).alias("__best"), F.count("*").alias("group_size"))
    joined = df.join(best, key)
    winner = F.col("__best.o3")
    return joined.withColumn("duplicate_of", F.when(F.col("comment_id") != winner, winner)).drop("__best")


def exact_repeats(df: DataFrame) -> DataFrame:
    """Same city, same text without case and blanks: one stays."""
    keyed = df.withColumn("key", F.sha2(F.lower(X.collapse(F.col("text"))), 256))
    return mark_duplicates(keyed, ["city", "key"]).drop("key")


def event_key_repeats(df: DataFrame) -> DataFrame:
    """Same site, round, and identity text without fillers, with equal parameters and negations."""
    normal = cut(df.withColumn("normal", X.normalize_event_text("text")), "normal")
    n = F.col("normal")
    key = F.sha2(F.concat_ws("|", X.extraction_fingerprint(n), F.array_join(X.row_parameters(n), ","), F.array_join(X.row_negations(n), ",")), 256)
    return mark_duplicates(normal.where("normal <> ''").withColumn("key", key), ["project_id", "review_round", "key"]).drop("key", "normal")


def near_pairs(df: DataFrame, block: list[str]) -> DataFrame:
    """Pairs of records of a block that are high-confidence duplicates: left, right, signals, sequence, match.

    Such pairs have bags of words whose Jaccard similarity is 0.90 at least, and
    equal numbers, negations and progression.  ``nearjoin`` finds all that may,
    from narrow rows; only their texts are fetched, for the exact tests.
    Records of equal normal text are told by their least id, ``text_members``
    says by which.
    """
    plain = df.select(*block, "comment_id", "text").dropna(subset=[*block, "comment_id"])
    rows = cut(nearjoin.features(plain), "bags")
    least = rows.groupBy(*block, "digest").agg(F.min("comment_id").alias("comment_id")).select("comment_id")
    copies = cut(rows.select("comment_id").join(least, "comment_id", "left_anti"), "copies")
    pairs = cut(nearjoin.candidates(rows.join(copies, "comment_id", "left_anti"), [*block, "marks"], rows), "pairs")
    ids = pairs.select(F.explode(F.array("left", "right")).alias("comment_id")).distinct()
    texts = cut(plain.select("comment_id", "text").join(ids, "comment_id", "left_semi").mapInArrow(_normals, f"id {df.schema['comment_id'].dataType.simpleString()}, normal string"), "texts", compression="zstd")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    half = pairs.join(texts.select(F.col("id").alias("left"), F.col("normal").alias("left_text")), "left").repartition(parts, "right")
    other = texts.select(F.col("id").alias("right"), F.col("normal").alias("right_text")).repartition(parts, "right")
    kept = half.join(other, "right").select("left", "right", "left_text", "right_text").mapInArrow(_tested, f"left long, right long, signals {S.SIGNALS.simpleString()}, sequence double")
    return kept.select("left", "right", "signals", "sequence", F.lit("HIGH_CONFIDENCE_DUPLICATE").alias("match"))


def _normals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([some.column("comment_id"), pa.array(X.identity_forms(some.column("text").to_pylist()), pa.string())], names=["id", "normal"])


def _tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their texts: those that are high-confidence duplicates. A text's part is made once where its pairs follow each other."""
    bag = lambda t: Counter(re.findall("[a-z0-9]+", t))
    held = None
    for batch in batches:
        out = []
        for left, right, a, b in zip(*(batch.column(c).to_pylist() for c in ("left", "right", "left_text", "right_text"))):
            if held is None or held[0] != b:
                held = b, S.Sequence(b), X.marks(b), bag(b)
            _, sequence, marks, words = held
            ratio = sequence.ratio(a, S.SEQUENCE)
            if ratio is None or X.marks(a) != marks:
                continue
            signals = S.counted_signals(bag(a), words)
            if signals[0] >= S.CONTAINMENT and signals[1] >= S.JACCARD and signals[2] >= S.LENGTH_RATIO:
                out.append((left, right, dict(zip(S.SIGNALS.names, signals)), ratio))
        lefts, rights, signals, ratios = zip(*out) if out else ([], [], [], [])
        kinds = pa.int64(), pa.int64(), pa.struct([(c, pa.float64()) for c in S.SIGNALS.names]), pa.float64()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((lefts, rights, signals, ratios), kinds)], names=["left", "right", "signals", "sequence"])


def _normal(df: DataFrame, block: list[str]) -> DataFrame:
    """Each record with a normal text, and the text's digest, written to the shared folder."""
    base = cut(df.select(*block, "comment_id", X.normalize_event_text("text").alias("normal")).where("normal <> ''"), "members")
    return base.withColumn("digest", F.unhex(F.sha2("normal", 256)))


def text_members(df: DataFrame, block: list[str]) -> DataFrame:
    """Each record with a normal text, and the least id of its block's records of that text (of)."""
    base = _normal(df, block)
    least = base.groupBy(*block, "digest").agg(F.min("comment_id").alias("of"), F.count("*").alias("copies"))
    return base.join(least, [*block, "digest"]).drop("digest")


def possible_pairs(df: DataFrame, block: list[str]) -> DataFrame:
    """Pairs of a block's distinct texts of equal numbers, negations and progression whose sequences agree at 0.90, for a person to compare.

    The ratio is of characters, which no shared word bounds; so these are all
    pairs of a block that its numbers leave, and a block is to be an issue's
    thread.  Lengths and counts of characters rule pairs out before the ratio.
    """
    base = cut(text_members(df, block).where("comment_id = of"), "texts")
    n = F.col("normal")
    marks = F.concat_ws("|", F.array_join(X.parameter_tokens(n), ","), F.array_join(X.negation_tokens(n), ","), X.has_progression_language(n).cast("string"))
    keyed = base.select(*block, F.md5(marks).alias("marks"), "comment_id", "normal", F.length("normal").alias("size"))
    a, b = (keyed.select(*block, "marks", F.col("comment_id").alias(side), F.col("normal").alias(f"{side}_text"), F.col("size").alias(f"{side}_size")) for side in ("left", "right"))
    met = a.join(b, [*block, "marks"]).where("left < right").where(2 * F.least("left_size", "right_size") >= S.POSSIBLE * (F.col("left_size") + F.col("right_size")))
    return met.withColumn("sequence", S.possible_ratio("left_text", "right_text")).where(F.col("sequence") >= S.POSSIBLE).select(*block, "left", "right", "sequence")


def fuzzy_repeats(df: DataFrame, block: list[str]) -> DataFrame:
    """Components of high-confidence pairs: comment_id, duplicate_of for all but the least of each."""
    pairs = near_pairs(df, block).where(F.col("match").isin("HIGH_CONFIDENCE_DUPLICATE", "EXACT_DUPLICATE"))
    return connected_components(pairs, "left", "right").withColumnsRenamed({"node": "comment_id", "component": "duplicate_of"})


def content_signature(df: DataFrame, file: str, text: str) -> DataFrame:
    """Per file, a digest of the set of texts in it: sums of their hashes, whatever their order and number."""
    one = F.sha2(F.lower(X.collapse(F.col(text))), 256)
    rows = df.groupBy(file, one.alias("k")).agg(F.count("*").alias("m"))
    sums = [F.sum(F.xxhash64(F.lit(i), "k").cast("decimal(38,0)")).cast("string") for i in (1, 2)]
    return rows.groupBy(file).agg(F.concat_ws(":", F.count("*").cast("string"), *sums).alias("signature"), F.sum("m").alias("rows"))


def copied_sources(df: DataFrame, file: str, text: str) -> DataFrame:
    """Files whose content another file has: canonical is the first by name."""
    signed = content_signature(df, file, text)
    first = signed.groupBy("signature").agg(F.min(file).alias("canonical"), F.count("*").alias("copies"))
    return signed.join(first, "signature").select(file, "canonical", "copies", "rows")


def best_label(df: DataFrame, key: str, label: str) -> DataFrame:
    """Per key the best label: starts with a number, more words, longer, then the least."""
    c = F.col(label)
    score = F.struct(c.rlike("^[0-9]").cast("int").alias("a"), F.size(F.split(c, " ")).alias("b"), F.length(c).alias("c"))
    best = df.groupBy(key, label).agg(F.max(score).alias("s")).groupBy(key).agg(F.max("s").alias("s"))
    return df.select(key, label, score.alias("s")).join(best, [key, "s"]).groupBy(key).agg(F.min(label).alias("label"))


def alias_chain(pairs: DataFrame, item: str, of: str) -> DataFrame:
    """Each item with the end of its chain of ``duplicate of`` links (which have no cycle)."""
    return connected_components(pairs, item, of)


_NUMBERS = "list_sort(list_distinct(regexp_extract_all(normal, '[a-z]*[0-9]+(?:[./''’-][a-z0-9]+)*')))"
_NEGATIONS = f"list_sort(list_distinct(list_filter(regexp_extract_all(normal, '[a-z]+'), lambda x: x IN ({', '.join(repr(w) for w in X.ROW_NEGATIONS)}))))"
_FINGERPRINT = "array_to_string(list_filter(regexp_extract_all(normal, '[a-z0-9]+(?:[./''’-][a-z0-9]+)*'), lambda x: x NOT IN ('a', 'an', 'at', 'the', 'to')), ' ')"

QUERIES = {
    "exact_repeats": (
        lambda s, d: exact_repeats(records(s, d)).select("comment_id", "duplicate_of", "group_size"),
        sql(
            "SELECT comment_id, CASE WHEN comment_id <> w THEN w END AS duplicate_of, group_size FROM k",
            "k AS (SELECT comment_id, first_value(comment_id) OVER (PARTITION BY city, t ORDER BY (link_status = 'confirmed') DESC, (response_id IS NOT NULL) DESC, (trust = 'verified') DESC, comment_id) AS w, count(*) OVER (PARTITION BY city, t) AS group_size FROM (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM records))",
        ),
    ),
    "event_key_repeats": (
        lambda s, d: event_key_repeats(records(s, d)).select("comment_id", "duplicate_of", "group_size"),
        sql(
            "SELECT comment_id, CASE WHEN comment_id <> w THEN w END AS duplicate_of, group_size FROM k",
            f"n AS (SELECT *, {normal_sql('text')} AS normal FROM records)",
            f"f AS (SELECT *, {_FINGERPRINT} AS fingerprint, {_NUMBERS} AS p, {_NEGATIONS} AS g FROM n WHERE normal <> '')",
            "k AS (SELECT comment_id, first_value(comment_id) OVER (PARTITION BY project_id, review_round, fingerprint, p, g ORDER BY (link_status = 'confirmed') DESC, (response_id IS NOT NULL) DESC, (trust = 'verified') DESC, comment_id) AS w, count(*) OVER (PARTITION BY project_id, review_round, fingerprint, p, g) AS group_size FROM f)",
        ),
    ),
    "near_pairs": (lambda s, d: near_pairs(record_texts(s, d), ["city"]).select("left", "right", F.round("sequence", 6).alias("sequence"), "match"), None),
    "text_members": (
        lambda s, d: text_members(records(s, d), ["city"]).select("comment_id", "of", "copies"),
        sql(f"SELECT comment_id, min(comment_id) OVER (PARTITION BY city, normal) AS of, count(*) OVER (PARTITION BY city, normal) AS copies FROM (SELECT *, {normal_sql('text')} AS normal FROM records) WHERE normal <> ''"),
    ),
    "possible_pairs": (lambda s, d: possible_pairs(records(s, d), ["issue_id", "city", "discipline"]).select("left", "right", F.round("sequence", 6).alias("sequence")), None),
    "copied_sources": (
        lambda s, d: copied_sources(table(s, d, "conversations"), "conv_id", "text"),
        """WITH c AS (SELECT conv_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS h FROM conversations),
        g AS (SELECT conv_id, sha256(string_agg(DISTINCT h, '' ORDER BY h)) AS signature, count(*) AS rows FROM c GROUP BY conv_id)
        SELECT conv_id, min(conv_id) OVER (PARTITION BY signature) AS canonical, count(*) OVER (PARTITION BY signature) AS copies, rows FROM g""",
    ),
    "best_labels": (
        lambda s, d: best_label(table(s, d, "part"), "p_brand", "p_name"),
        "SELECT p_brand, first(p_name ORDER BY CAST(regexp_matches(p_name, '^[0-9]') AS INT) DESC, len(string_split(p_name, ' ')) DESC, length(p_name) DESC, p_name) AS label FROM part GROUP BY p_brand",
    ),
}
