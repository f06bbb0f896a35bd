"""Documents behind files: equal bytes, equal content, or nearly all texts in common; comments of a document told once.

A file is its set of normal texts.  Files of equal bytes or equal sets are one.
Files that have 0.98 of their texts in common are one too, from 0.90 a person
looks.  Pairs come from a prefix filter over texts by rarity: of two files that
share ``least`` of the larger one's texts, the first ``n - ceil(least * n) + 1``
texts of each, rarest first, have one in common; so no pair is missed, and a
text that very many files hold makes pairs only of files with nothing rarer.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from marginalia.functions import keys as K
from marginalia.functions import text as X
from marginalia.operators.components import connected_components
from marginalia.plans.records import COMMENTS, comments, complete, sql_over, table
from marginalia.storage import cut

# Shares of texts in common.
MERGE, REVIEW, ALIKE = 0.98, 0.90, 0.80


def overlap(texts: DataFrame, file: str, least: float = REVIEW, block: list[str] | None = None) -> DataFrame:
    """(left, right, shared, overlap): pairs of files, of one block, with ``least`` or more of the larger one's texts in common.

    texts: the file, its block's columns, ``k`` (a text's key), each once a file.
    Files of equal sets are one (their least name) before pairs are made.
    """
    block = block or []
    sizes = texts.groupBy(*block, file).agg(F.count("*").alias("n"), F.sum(F.xxhash64("k").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64(F.lit(7), "k").cast("decimal(38,0)")).alias("s2"))
    same = sizes.groupBy(*block, "n", "s1", "s2").agg(F.min(file).alias(file))
    kept = cut(texts.join(same.select(*block, file, "n"), [*block, file]), "sets")
    often = kept.groupBy(*block, "k").agg(F.count("*").alias("df")).where("df > 1")
    ranked = kept.join(often, [*block, "k"], "left").withColumn("df", F.coalesce("df", F.lit(1)))
    turn = F.row_number().over(Window.partitionBy(*block, file).orderBy("df", "k"))
    heads = ranked.withColumn("__turn", turn).where((F.col("__turn") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1) & (F.col("df") > 1))
    a, b = (heads.select(*block, "k", F.col(file).alias(side), F.col("n").alias(f"{side}_n")) for side in ("left", "right"))
    met = a.join(b, [*block, "k"]).where(F.col("left") < F.col("right")).where(F.least("left_n", "right_n") >= least * F.greatest("left_n", "right_n"))
    met = cut(met.select(*block, "left", "right", "left_n", "right_n").distinct(), "met")
    one, two = (kept.select(*block, "k", F.col(file).alias(side)) for side in ("left", "right"))
    shared = met.join(one, [*block, "left"]).join(two, [*block, "right", "k"]).groupBy(*block, "left", "right", "left_n", "right_n").agg(F.count("*").alias("shared"))
    share = F.col("shared") / F.greatest("left_n", "right_n")
    return shared.where(share >= least).select(*block, "left", "right", "shared", share.alias("overlap"))


@pandas_udf(DoubleType())
def greedy_overlap(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of texts of two files (arrays) matched one to one: each of the left, in order, with the nearest of the right that is left, at 0.80 or more."""

    def one(a: list, b: list) -> float:
        if not len(a) or not len(b):
            return 0.0
        rest, total = list(b), 0.0
        for text in a:
            best, at = 0.0, -1
            for i, other in enumerate(rest):
                if text == other:
                    best, at = 1.0, i
                    break
                m = SequenceMatcher(None, text, other)
                if m.real_quick_ratio() > best and m.quick_ratio() > best and (r := m.ratio()) > best:
                    best, at = r, i
            if best >= ALIKE:
                total += best
                rest.pop(at)
        return total / max(len(a), len(b))

    return pd.Series([one(sorted(x), sorted(y)) for x, y in zip(left, right)], dtype=float)


def near_overlap(texts: DataFrame, file: str, block: list[str], text: str, known: float = 0.5) -> DataFrame:
    """(left, right, overlap) by ``greedy_overlap`` of files that share ``known`` of their texts at least, or more.

    For files whose other texts differ in spelling.  A share of ``known`` equal
    texts is asked for, which a copy with some texts misread has.
    """
    keyed = cut(texts.select(*block, file, text, F.sha2(text, 256).alias("k")).distinct(), "texts")
    pairs = overlap(keyed.drop(text), file, known, block).select("left", "right")
    held = keyed.groupBy(file).agg(F.array_sort(F.collect_set(text)).alias("texts"))  # texts of one file
    joined = pairs.join(held.withColumnsRenamed({file: "left", "texts": "lt"}), "left").join(held.withColumnsRenamed({file: "right", "texts": "rt"}), "right")
    return joined.withColumn("overlap", greedy_overlap("lt", "rt")).select("left", "right", "overlap")


def decided(share: Column) -> Column:
    return F.when(share >= MERGE, "merge").when(share >= REVIEW, "review").otherwise("distinct")


_COLUMNS = {"source_document": "string", "source_sha256": "string", "city": "string", "property_project": "string", "review_round": "string", "duplicate_status": "string", "original_text": "string", "verified_text": "string", "text_trust_status": "string", "response_id": "string", "occurrence_type": "string", "search_eligible": "boolean"}


def _rows(df: DataFrame) -> DataFrame:
    d = complete(df, **_COLUMNS)
    text = F.when(K.blank(F.col("verified_text")) != "", F.col("verified_text")).otherwise(K.blank(F.col("original_text")))
    path = K.first_path(F.col("source_document"))
    folder = K.folder_after(F.col("source_document"), "comments&response")
    place = F.concat(K.normalize_document_text(K.blank(F.col("city"))), F.lit("|"), F.when(folder != "", F.lower(folder)).otherwise(K.normalize_document_text(K.blank(F.col("property_project")))))
    d = d.select("*", path.alias("path"), K.normalize_document_text(text).alias("normal"), place.alias("place"), F.coalesce(F.col("duplicate_status") == "hierarchical_subpoint", F.lit(False)).alias("child"))
    best = F.struct(
        F.when(F.coalesce(F.col("search_eligible"), F.lit(True)), 0).otherwise(1).alias("a"), F.when(F.coalesce(F.col("text_trust_status") == "verified", F.lit(False)), 0).otherwise(1).alias("b"),
        F.when(K.blank(F.col("response_id")) != "", 0).otherwise(1).alias("c"), K.blank(F.col("source_document")).alias("d"), F.col("comment_id").alias("id"),
    )
    return d.withColumn("best", best)


def canonical_documents(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, pairs, comments).

    files: path, source_file_id, canonical_document_id, canonical_path,
    duplicate_group_size, review.  pairs: files a person should compare.
    comments: comment_id, canonical_document_id, canonical_comment_id,
    occurrence_type, carried_forward_from, eligible (false where another row
    stands for it).  A file's place and bytes are those of its best row; a
    response letter's repeat of an earlier document's comment is a quotation.
    """
    rows = cut(_rows(df).select("comment_id", "path", "normal", "place", "child", "best", "source_sha256", "review_round", "occurrence_type", "search_eligible"), "rows")
    told = rows.where("path <> '' and not child and normal <> ''")
    texts = cut(told.select("path", F.sha2("normal", 256).alias("k")).distinct(), "texts")
    files = told.groupBy("path").agg(F.min_by(F.struct(F.lower(F.trim(K.blank(F.col("source_sha256")))).alias("sha"), "place"), "best").alias("r"))
    content = texts.groupBy("path").agg(F.sum(F.xxhash64("k").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64(F.lit(7), "k").cast("decimal(38,0)")).alias("s2"), F.count("*").alias("n"))
    files = cut(files.join(content, "path").select("path", "r.sha", "r.place", "s1", "s2", "n"), "files")
    star = lambda d, *key: d.join(d.groupBy(*key).agg(F.min("path").alias("left"), F.count("*").alias("m")).where("m > 1"), list(key)).where(F.col("path") != F.col("left")).select("left", F.col("path").alias("right"))
    near = cut(overlap(texts.join(files.select("path", "place"), "path"), "path", REVIEW, ["place"]), "overlaps")
    links = star(files.where("sha <> ''"), "sha").unionByName(star(files, "s1", "s2", "n")).unionByName(near.where(F.col("overlap") >= MERGE).select("left", "right"))
    groups = _named_components(links)
    own = files.join(groups, "path", "left").withColumn("root", F.coalesce("root", "path"))
    first = own.where("path = root").select("root", F.concat(F.lit("CD-"), F.substring(F.sha2(F.concat("place", F.lit("|"), F.when(F.col("sha") != "", F.col("sha")).otherwise(F.concat_ws(":", "s1", "s2", "n"))), 256), 1, 20)).alias("canonical_document_id"))
    sizes = own.groupBy("root").agg(F.count("*").alias("duplicate_group_size"))
    review = near.where((F.col("overlap") < MERGE)).select("left", "right", F.round("overlap", 4).alias("similarity"))
    waiting = review.select(F.explode(F.array("left", "right")).alias("path")).distinct().withColumn("waits", F.lit(True))
    out = own.join(first, "root").join(sizes, "root").join(waiting, "path", "left")
    state = F.when(F.coalesce("waits", F.lit(False)), "needs_review").when(F.col("duplicate_group_size") > 1, "confirmed").otherwise("not_reviewed")
    out = cut(out.select("path", F.concat(F.lit("SF-"), F.substring(F.sha2(F.lower("path"), 256), 1, 20)).alias("source_file_id"), "canonical_document_id", F.col("root").alias("canonical_path"), "duplicate_group_size", state.alias("review")), "documents")
    return out, review, _canonical_comments(rows, out)


def _named_components(links: DataFrame) -> DataFrame:
    """(path, root): components of links between names, the least name being the root; names get numbers for it."""
    names = cut(links.select(F.explode(F.array("left", "right")).alias("path")).distinct().withColumn("id", F.monotonically_increasing_id()), "names")
    a, b = (names.select(F.col("path").alias(side), F.col("id").alias(f"{side}_id")) for side in ("left", "right"))
    parts = connected_components(links.join(a, "left").join(b, "right"), "left_id", "right_id")
    grouped = names.join(parts, F.col("id") == F.col("node"), "left").withColumn("group", F.coalesce("component", "id"))
    return grouped.join(grouped.groupBy("group").agg(F.min("path").alias("root")), "group").select("path", "root")


def _canonical_comments(rows: DataFrame, files: DataFrame) -> DataFrame:
    d = rows.join(files.select("path", "canonical_document_id", "canonical_path"), "path")
    d = d.withColumn("canonical_comment_id", F.concat(F.lit("CC-"), F.substring(F.sha2(F.concat_ws("|", "canonical_document_id", "normal"), 256), 1, 20)))
    main = d.where("not child").groupBy("canonical_comment_id").agg(F.min("best").alias("main")).select("canonical_comment_id", F.col("main.id").alias("main"))
    d = d.join(main, "canonical_comment_id", "left")
    copy = F.col("child") | (F.col("main") != F.col("comment_id")) | (F.col("path") != F.col("canonical_path"))
    kind = F.when(copy, "copied_duplicate").when(F.col("occurrence_type").isin("reissued_unresolved", "historical_quote"), F.col("occurrence_type")).otherwise("newly_issued")
    d = d.withColumns({"kind": kind, "from": F.when(F.col("main") != F.col("comment_id"), F.col("main")), "open": ~copy & F.coalesce(F.col("search_eligible"), F.lit(True))})
    d = cut(d.drop("best"), "comments")
    # the first document of a place that has a text is its source; a later response letter quotes it
    turn = F.regexp_extract(K.blank(F.col("review_round")), "([0-9]+)", 1)
    order = F.struct(F.when(turn != "", turn.cast("int")).otherwise(10**9).alias("turn"), "path", "comment_id", F.col("canonical_document_id").alias("document"), F.col("canonical_comment_id").alias("comment"))
    origin = d.where("open and normal <> ''").groupBy("place", "normal").agg(F.min(order).alias("origin"))
    j = d.join(origin, ["place", "normal"], "left")
    letter = F.contains(F.lower(F.regexp_extract("path", "([^/]*)$", 1)), F.lit("response"))
    quote = F.col("open") & letter & (F.col("kind") != "reissued_unresolved") & (F.col("origin.document") != F.col("canonical_document_id"))
    quote = F.coalesce(quote, F.lit(False))
    pick = lambda a, b: F.when(quote, F.col(a)).otherwise(F.col(b))
    return j.select("comment_id", pick("origin.document", "canonical_document_id").alias("canonical_document_id"), pick("origin.comment", "canonical_comment_id").alias("canonical_comment_id"), F.when(quote, "historical_quote").otherwise(F.col("kind")).alias("occurrence_type"), pick("origin.comment_id", "from").alias("carried_forward_from"), (F.col("open") & ~quote).alias("eligible"))


def hierarchy(df: DataFrame) -> DataFrame:
    """comment_id with city, site and project ids, names and scope; a project's name is the fullest of its sites' spellings."""
    d = complete(df, application_number="string", property_project="string", source_document="string", city="string", discipline="string")
    ids = K.hierarchy(F.col("source_document"), F.col("application_number"), F.col("property_project"), F.col("city"), F.col("discipline"))
    named = cut(d.select("comment_id", ids.alias("h")).select("comment_id", "h.*"), "hierarchy")
    score = F.struct(F.col("site_name").rlike("^\\s*[0-9]+\\b").cast("int").alias("a"), F.lower("site_name").rlike(K.SUFFIX).cast("int").alias("b"), F.size(F.split("site_name", "\\s+")).alias("c"), F.length("site_name").alias("d"), F.col("site_name").alias("n"))
    best = named.groupBy("project_id").agg(F.max(score).alias("best")).select("project_id", F.col("best.n").alias("project_name"))
    return named.join(best, "project_id")


def _windows(s, d) -> DataFrame:
    """Files of forty documents each, the next one two documents on: (file, k)."""
    docs = table(s, d, "documents")
    files = F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("doc_id") - 38) / 2)), F.floor(F.col("doc_id") / 2)))
    return docs.select(files.alias("file"), F.sha2(F.lower(X.collapse(F.col("text"))), 256).alias("k")).distinct()


_NORMAL = "regexp_replace(trim(regexp_replace(replace(lower(original_text), 'ß', 'ss'), '[\\s\\x0b]+', ' ', 'g')), '\\s+([,.;:!?])', '\\1', 'g')"
_FILES = f"""
t AS (SELECT comment_id, source_document AS path, {_NORMAL} AS normal, text_trust_status, response_id, review_round FROM comments WHERE duplicate_status IS NULL),
f AS (SELECT path, min(path) OVER (PARTITION BY content) AS root, count(*) OVER (PARTITION BY content) AS members FROM (SELECT path, string_agg(DISTINCT sha256(normal), '' ORDER BY sha256(normal)) AS content FROM t WHERE normal <> '' GROUP BY path))
"""

QUERIES = {
    "document_overlap": (
        lambda s, d: overlap(_windows(s, d), "file").select("left", "right", "shared", F.round("overlap", 6).alias("overlap"), decided(F.col("overlap")).alias("decision")),
        """WITH w AS (SELECT DISTINCT unnest(range(greatest(0, CAST(floor((doc_id - 38) / 2) AS BIGINT)), doc_id // 2 + 1)) AS file, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k FROM documents),
        sizes AS (SELECT file, count(*) AS n, string_agg(sha256(k), '' ORDER BY k) AS content FROM w GROUP BY file),
        f AS (SELECT min(file) AS file, n FROM sizes GROUP BY n, content),
        p AS (SELECT a.file AS "left", b.file AS "right", count(*) AS shared FROM w a JOIN w b ON a.k = b.k AND a.file < b.file GROUP BY 1, 2)
        SELECT "left", "right", shared, round(shared / greatest(x.n, y.n), 6) AS overlap,
          CASE WHEN shared / greatest(x.n, y.n) >= 0.98 THEN 'merge' ELSE 'review' END AS decision
        FROM p JOIN f x ON x.file = "left" JOIN f y ON y.file = "right" WHERE shared / greatest(x.n, y.n) >= 0.9""",
    ),
    "canonical_comments": (
        lambda s, d: canonical_documents(comments(s, d))[2].groupBy("occurrence_type", "eligible").agg(F.count("*").alias("n")),
        sql_over(
            COMMENTS,
            "SELECT CASE WHEN copy THEN 'copied_duplicate' ELSE 'newly_issued' END AS occurrence_type, NOT copy AS eligible, count(*) AS n "
            "FROM (SELECT c.duplicate_status IS NOT NULL OR r.k > 1 OR r.path <> r.root AS copy FROM comments c LEFT JOIN r ON r.comment_id = c.comment_id) GROUP BY 1, 2",
            _FILES,
            "r AS (SELECT comment_id, t.path, root, row_number() OVER (PARTITION BY root, normal ORDER BY (text_trust_status = 'verified') IS NOT TRUE, response_id IS NULL, t.path, comment_id) AS k FROM t JOIN f ON f.path = t.path)",
        ),
    ),
    "canonical_files": (
        lambda s, d: canonical_documents(comments(s, d))[0].select("path", "source_file_id", "duplicate_group_size"),
        sql_over(COMMENTS, "SELECT path, 'SF-' || substr(sha256(lower(path)), 1, 20) AS source_file_id, members AS duplicate_group_size FROM f", _FILES),
    ),
    "hierarchy": (
        lambda s, d: hierarchy(comments(s, d)).select("comment_id", "city_id", "project_id", "project_scope", "project_name"),
        sql_over(
            COMMENTS,
            "SELECT comment_id, c AS city_id, 'PROJECT-' || substr(sha256(lower(c) || '|folder:' || city), 1, 20) AS project_id, discipline AS project_scope, 'Project' AS project_name FROM (SELECT *, 'CITY-' || substr(sha256(city), 1, 20) AS c FROM comments)",
        ),
    ),
}
