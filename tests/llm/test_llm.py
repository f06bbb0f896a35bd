"""The llm operators against brute force, round trips, held-out accuracy and odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marginalia.llm import ann, chat, exact, linedup, mixture, packing, planes, quality, simhash, tokens, toxicity
from marginalia.operators.components import connected_components
from marginalia.storage import cut

DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "one two three", "en", "b", 13), (3, " \t\n", "en", None, 3), (4, "word " * 30_000, "en", "a", 150_000), (5, "one two three", "en", "b", 13), (5, "one two three", "en", "b", 13), (6, "é ü\x0b�", "fr", "c", 5)]
    return spark.createDataFrame(rows, DOCS)


def extra(df):
    """With further columns named like those operators make."""
    names = ["fp", "digest", "kept", "score", "component_id", "__row", "TEXT", "text_sha256", "size", "shard"]
    return df.select("*", *[F.lit("x").alias(n) for n in names])


def sql(query, **frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame)
    return con.sql(query).fetchall()


def python_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def python_components(fps):
    ids = list(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    near = np.bitwise_count(values[:, None] ^ values) <= 4
    label = np.arange(len(ids))
    while True:
        new = np.where(near, label, len(ids)).min(axis=1)
        if (new == label).all():
            break
        label = new
    least = {}
    for i, l in zip(ids, label):
        least[l] = min(least.get(l, i), i)
    return {i: least[l] for i, l in zip(ids, label)}


def test_fingerprint():
    for text in ["", None, "A b", "The quick brown fox jumps over the lazy dog É " * 3, "x\x0by\x1cz w v u"]:
        assert simhash.fingerprint(text, 4) == python_fingerprint(text)


def test_cells_lose_no_pair():
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 1 << 64, 200, np.uint64)
    for bits in range(5):
        other = fp.copy()
        for i in range(len(fp)):
            for b in rng.choice(64, bits, replace=False):
                other[i] ^= np.uint64(1 << int(b))
        (c, of), (d, od) = simhash.cells(fp), simhash.cells(other)
        mine, theirs = collections.defaultdict(set), collections.defaultdict(set)
        for x, i in zip(c, of):
            mine[i].add(x)
        for x, i in zip(d, od):
            theirs[i].add(x)
        assert all(mine[i] & theirs[i] for i in range(len(fp)))


def test_simhash_against_brute_force(spark, texts):
    got = simhash.query(spark, DIR).collect()
    fps = {i: python_fingerprint(t) for i, t in texts.items()}
    want = python_components(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in texts}


def test_simhash_large_cells_are_cut(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < 300:
        values.add(rng.choice(sorted(values)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values |= {rng.getrandbits(64) for _ in range(200)}
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long").persist()
    want = python_components({v: v for v in values})
    for block in (10, 100_000):
        found = {r.node: r.component for r in connected_components(simhash.links(nodes, 4, block), "a", "b").collect()}
        groups, wanted = collections.defaultdict(set), collections.defaultdict(set)
        for v in values:
            s = v - (1 << 64) if v >> 63 else v
            groups[found.get(s, s)].add(v)
            wanted[want[v]].add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_simhash_odd(odd):
    rows = simhash.near_groups(extra(odd)).collect()
    assert len(rows) == 8 and sum(r.kept for r in rows) == len({r.component_id for r in rows})
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_groups(odd.limit(0)).count() == 0
    assert simhash.drop_near_copies(extra(odd)).columns == extra(odd).columns


def test_ann_recall_and_scores(spark):
    got = ann.query(spark, DIR).collect()
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found, hits = collections.defaultdict(dict), 0
    for r in got:
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    asked = [i for i in ids if i % 100 == 0]
    assert sorted(found) == sorted(asked)
    for q in asked:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        near = [(d[i], ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert sorted(found[q]) == list(range(1, 11))
        assert all(abs(d[ids == v][0] - s) < 1e-12 for v, s in found[q].values())
        hits += len({v for _, v in near} & {v for v, _ in found[q].values()})
    assert hits / (10 * len(asked)) >= 0.9


def test_ann_large_graph():
    rng = np.random.default_rng(3)
    c, x = rng.normal(size=(3000, 32)), rng.normal(size=(100, 32))
    ids, dist = ann.Graph(c).search(x)
    true = ((x[:, None] - c) ** 2).sum(2).argsort(axis=1)[:, :10]
    assert np.mean([len(set(a[:20]) & set(b)) / 10 for a, b in zip(ids, true)]) > 0.9
    assert (np.diff(dist, axis=1) >= 0).all() and all(len(set(a)) == len(a) for a in ids.tolist())


def test_ann_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (8, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.search(df, df.where("vec_id = 0")).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 7, math.sqrt(2))]
    assert ann.search(extra(df), df.limit(0)).count() == 0
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    many = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, [float(i), 1.0]) for i in range(1, 300)], "vec_id long, embedding array<float>")
    got = ann.search(many, many.where("vec_id % 100 = 0")).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(10))


@pytest.mark.parametrize("rows", [16, 8192])
def test_ann_lengths_and_long_lists(spark, monkeypatch, rows):
    """Vectors of several lengths, each searched among its own; lists and their queries cut into parts."""
    monkeypatch.setattr(ann, "LIST_ROWS", rows)
    rng = np.random.default_rng(4)
    vectors = [(i, rng.integers(1, 20, d).astype(float).tolist()) for d, n in ((3, 150), (5, 60), (1, 10), (2, 1)) for i in range(1000 * d, 1000 * d + n)]
    vectors += [(9000 + i, [1.0, 2.0, 3.0]) for i in range(80)]  # one vector in a fourth of the rows
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got, hits, wanted = collections.defaultdict(list), 0, 0
    for r in ann.search(df, df.where("vec_id % 2 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    for q, v in vectors:
        if q % 2 == 0:
            want = sorted((math.dist(v, w), i) for i, w in vectors if len(w) == len(v) and i != q)[:10]
            if rows == 8192 or len(v) in (1, 2):
                assert [i for _, i in got[q]] == [i for _, i in want] and all(abs(a - b) < 1e-9 for (a, _), (b, _) in zip(got[q], want))
            hits += len({i for _, i in got[q]} & {i for _, i in want})
            wanted += len(want)
    assert hits >= 0.9 * wanted


def token_ids(text):
    t = tokens.Encoder(tokens.vocabulary_path()).tokenizer
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_encoder_equals_whole_texts(texts):
    mixed = [*list(texts.values())[:100], None, "", "a\x1cb\x85c\xa0d e\x0bf", "ΣΑΣ Σ ıİ é ́x ﬁ", "don't we'll <|endoftext|> x<|startoftext|>y", "12345 ½ ٣", "\U0001f600‍ a"]
    got = tokens.Encoder(tokens.vocabulary_path()).encode(mixed)
    for text, ids in zip(mixed, got):
        assert np.array_equal(np.frombuffer(ids, "<u2"), token_ids(text)), text


def test_encoder_new_plain_words_by_model_alone():
    """Words not met before go through the library's normalizer and pattern only if they aren't plain; ids are the whole tokenizer's all the same."""
    e = tokens.Encoder(tokens.vocabulary_path())
    whole, asked = e.tokenizer, []

    class Watched:
        def encode_batch_fast(self, words, **more):
            asked.extend(words)
            return whole.encode_batch_fast(words, **more)

    e.tokenizer = Watched()
    plain = ["Ndretion,", "ciónja###", "ÈEUX'S", "Привет!'ll", "a1b22c", "don't", "'re'Rex", "(x)"]
    rng = random.Random(5)
    signs = [chr(c) for c in range(0x21, 0x7F)] + list("éÖßñжЁ") + ["'s", "'LL", "'"]
    plain += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    other = ["e\u0301x", "İx", "\u212ax", "ΣΑΣ", "中文", "a…b", "x½", "<|endoftext|>", "a<|ENDOFTEXT|>", "a\x1cb", "é" * 40]
    for text, ids in zip(plain + other, e.encode(plain + other)):
        assert np.array_equal(np.frombuffer(ids, "<u2"), np.array(whole.encode(text, add_special_tokens=False).ids + [2])), text
    assert set(asked) == set(other)
    for c in e.plain.letters:
        for text in (f"{c}", f"a{c}{c}b.{c}", f"1{c}'{c}"):
            assert e.plain.encode([text.encode()])[1] == [np.array(whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()], text


def test_planes_round_trip(tmp_path):
    rng = np.random.default_rng(0)
    for kind in ("byte", "bit"):
        for n in (0, 1, 7, 65_536):
            ids = rng.integers(0, 1 << 16, n).astype("<u2")
            assert np.array_equal(planes.from_planes(planes.to_planes(ids, kind), n, kind), ids)
        docs = [rng.integers(0, 49_408, k).astype("<u2") for k in (1, 200_000, 5, 65_536)]
        with open(tmp_path / kind, "wb") as f:
            writer = planes.ShardWriter(f, kind)
            for i, d in enumerate(docs):
                writer.add(i, d.tobytes())
            writer.close()
        import pyarrow as pa

        reader = planes.ShardReader(pa.OSFile(str(tmp_path / kind)))
        assert reader.documents()[1].tolist() == [len(d) for d in docs]
        whole = np.concatenate(docs)
        assert np.array_equal(reader.read(0, len(whole)), whole)
        assert np.array_equal(reader.read(199_990, 50), whole[199_990:200_040])


def test_planes_query(spark, texts):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in planes.query(spark, DIR).collect()}
    at, want = 0, {}
    t = tokens.Encoder(tokens.vocabulary_path()).tokenizer
    for i in sorted(texts):
        ids = np.array(t.encode(texts[i], add_special_tokens=False).ids + [2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want


def test_planes_odd(odd):
    rows = planes.encode_documents(extra(odd), kind="bit").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6] and rows[1].n_tokens == 1
    assert planes.encode_documents(odd.limit(0)).count() == 0
    # a doc_id that all rows carry is split among shards, and order holds over them
    same = odd.sparkSession.createDataFrame([(7, f"w{i}") for i in range(400)], "doc_id long, text string")
    folder = planes.new_folder(odd.sparkSession, "same")
    manifest = planes.write_shards(same, folder, shards=4)
    assert [r.shard for r in manifest.orderBy("shard").collect()] == [0, 1, 2, 3] and sorted(r.start for r in planes.read_documents(manifest, folder).collect())[0] == 0


def brute_lines(rows, least):
    """Texts after deletion of every stretch of lines that occurs before, by comparing all stretches."""
    seqs = [(linedup.lines_of(t)[1]) for _, t in rows]
    first, spans = {}, collections.defaultdict(set)
    for d in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0], i)):
        s = seqs[d]
        words = [len(x.split()) for x in s]
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                if sum(words[a:b]) < least:
                    continue
                key = tuple(s[a:b])
                if key not in first:
                    first[key] = (d, a)
                elif first[key][0] != d or a - first[key][1] >= b - a:
                    spans[d].add((a, b - a))
    return {d: linedup.delete_lines(rows[d][1], list(spans[d]))[1:] + (linedup.delete_lines(rows[d][1], list(spans[d]))[0],) for d in range(len(rows))}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choices(pool + [""], k=rng.randint(0, 14)))) for i in range(60)]
    got = {r.doc_id: (r.deleted_lines, r.deleted_runs, r.text) for r in linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()}
    assert got == brute_lines(rows, 8)


def test_line_dedup_odd(odd, spark):
    rows = {(r.doc_id, r.text): r for r in linedup.dedup_lines(extra(odd)).collect()}
    assert len(rows) == 7 and (1, None) in rows
    assert linedup.dedup_lines(odd.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "\n".join(["a b c d e"] * 30))], "doc_id long, text string")
    assert linedup.dedup_lines(same, 50).first().text == "\n".join(["a b c d e"] * 10)


def test_chat_round_trip():
    rng = random.Random(2)
    for _ in range(300):
        parts = ["\\", "###", "</turn>", "# ", "n", "\n", "x", "</", "é"]
        turns = [("".join(rng.choices(parts, k=rng.randint(0, 4))), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for _ in range(3)]
        whole = "".join(chat.render(*t)[0] for t in turns)
        assert chat.parse(whole) == turns
        rendered, a, b = chat.render(*turns[0])
        assert chat.unescape(rendered[a:b]) == turns[0][1]


def test_chat_query(spark):
    rows = spark.read.parquet(f"{DIR}/conversations.parquet").orderBy("conv_id", "turn").collect()
    talks = collections.defaultdict(list)
    for r in rows:
        talks[r.conv_id].append((r.role, r.text))
    talks[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {c: (len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), sum(len(b) for a, b in t if a == "assistant"), sha("".join(b for a, b in t if a == "assistant"))) for c, t in talks.items()}
    got = chat.query(spark, DIR).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    formatted = chat.format_chats(spark.read.parquet(f"{DIR}/conversations.parquet").where("conv_id < 5"))
    seen = collections.Counter()
    for r in chat.expand(formatted, chat.explode_examples(formatted)).collect():
        turns = chat.parse(r.text)
        assert turns == talks[r.conv_id][: len(turns)] and chat.unescape(r.text[r.loss_start : r.loss_end]) == turns[-1][1]
        seen[r.conv_id] += 1
    assert seen == {c: n for c in range(5) if (n := sum(a == "assistant" for a, _ in talks[c]))}
    assert {r.conv_id: r.n_examples for r in got} == {c: sum(a == "assistant" for a, _ in t) for c, t in talks.items()}


def test_chat_odd(spark):
    rows = [(1, None, "assistant", None), (1, 1, None, "x"), (None, 0, "assistant", "y"), (2, 0, "user", "z"), (2, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).withColumn("start", F.lit("x"))
    both = lambda d: (t := chat.format_chats(d), chat.explode_examples(t))
    got = {r.conv_id: (r.n_turns, r.loss_chars, r.n_examples) for r in chat.digests(*both(df)).collect()}
    assert got == {1: (2, 0, 1), None: (1, 1, 1), 2: (2, 0, 0)}
    assert chat.digests(*both(df.limit(0))).count() == 0
    assert {(r.conv_id, r.text) for r in chat.expand(*both(df)).collect()} == {(1, "### assistant\n</turn>\n"), (None, "### assistant\ny</turn>\n")}
    long = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", "x" * 50_000) for i in range(40)], "conv_id long, turn long, role string, text string")
    row = chat.digests(*both(long)).first()
    assert (row.n_examples, row.loss_chars) == (20, 1_000_000)
    wrong = chat.explode_examples(chat.format_chats(long)).withColumn("context_end", F.lit(1).cast("long"))
    with pytest.raises(Exception, match="doesn't meet its turn"):
        chat.digests(chat.format_chats(long), wrong).collect()


def python_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not full:
            out |= share
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_mixture(spark, texts, docs):
    got = mixture.mix(docs).collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    assert {r.doc_id: r["size"] for r in got} == sizes
    total = collections.Counter()
    for r in got:
        total[r.source] += r["size"]
    want = python_targets(total)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == total[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 64 for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixture.mix(docs).collect()))


def test_mixture_draws_permuted_blocks(spark):
    """Against plain Python: blocks of a source and shard in hash order until the shard's quota is met."""
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 500, 512, 513, 1500, 4000])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)] + [(7000, "again and again", "a")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn = mixture.draw(docs).collect()
    assert len(drawn) == 400 and len({r.shard for r in drawn if r.doc_id == 7000}) == len({r.shard for r in drawn})
    for r in drawn:
        spans = [(p.start, p.start + p.n) for p in r.pieces]
        assert all(a % 512 == 0 and b <= r["size"] and b - a <= 512 for a, b in spans) and len(set(spans)) == len(spans)
        assert r.extra == sum(b - a for a, b in spans) and r.taken == r.passes * r["size"] + r.extra
    by = collections.defaultdict(list)
    for r in drawn:
        by[r.source, r.shard].append(r)
    # in a source's shard one block at most is cut short, all others are whole or not drawn
    for group in by.values():
        short = sum(p.n < min(512, r["size"] - p.start) for r in group for p in r.pieces)
        assert short <= 1
    some = [r for r in drawn if 0 < r.extra < r["size"]]
    assert any(p.start > 0 and r.pieces[0].start > 0 for r in some for p in r.pieces)  # not prefixes alone
    places = collections.defaultdict(list)
    for r in mixture.mix(docs).collect():
        places[r.shard].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_mixed_documents(docs, texts):
    takes = {r.doc_id: (r.taken, r["size"]) for r in mixture.mix(docs).collect()}
    out = collections.defaultdict(list)
    rows = mixture.mixed_documents(extra(docs)).collect()
    for r in rows:
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
        out[r.doc_id].append(r.text)
    for i, (taken, _) in takes.items():
        assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in out[i]) == taken
    ids = [r.doc_id for r in rows]
    assert ids != sorted(ids) and [r.doc_id for r in mixture.mixed_documents(docs).collect()] == ids


def test_hypergeometric(spark):
    cases = spark.createDataFrame([(left, right, q, (k + 0.5) / 400) for left, right, q in ((5, 7, 4), (0, 9, 3), (300, 500, 200), (4, 4, 8)) for k in range(400)], "l long, r long, q long, u double")
    got = collections.defaultdict(collections.Counter)
    for r in cases.withColumn("x", mixture.hypergeometric(F.col("l"), F.col("r"), F.col("q"), F.col("u"))).collect():
        assert max(0, r.q - r.r) <= r.x <= min(r.q, r.l)
        got[r.l, r.r, r.q][r.x] += 1
    for (left, right, q), counts in got.items():
        for k in range(max(0, q - right), min(q, left) + 1):
            p = math.comb(left, k) * math.comb(right, q - k) / math.comb(left + right, q)
            assert abs(counts[k] / 400 - p) < 0.006


def test_split_quotas_add_up(spark):
    rng = random.Random(4)
    leaves = [(s, h, rng.randint(0, 50)) for s in "abc" for h in range(64) if rng.random() < 0.8]
    total = collections.Counter()
    for s, _, n in leaves:
        total[s] += n
    quotas = {"a": total["a"] // 3, "b": 0, "c": total["c"]}
    got = mixture.split_quotas(spark.createDataFrame(leaves, "sk string, shard long, cells long"), spark.createDataFrame(list(quotas.items()), "sk string, quota long"), 6, 9).collect()
    of = {(s, h): n for s, h, n in leaves}
    sums = collections.Counter()
    for r in got:
        assert 0 <= r.quota <= of[r.sk, r.shard]
        sums[r.sk] += r.quota
    assert all(sums[s] == q for s, q in quotas.items())


def test_mixture_odd(odd):
    rows = mixture.mix(extra(odd)).collect()
    assert len(rows) == 8 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert mixture.mix(odd.limit(0)).count() == 0 and mixture.mixed_documents(odd).columns == odd.columns
    out = mixture.mixed_documents(extra(odd))
    assert out.columns == extra(odd).columns and all(len(r[1].split()) for r in out.collect()) and mixture.mixed_documents(odd.limit(0)).count() == 0


def held_out(spark, got, label):
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", label).collect()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    pairs = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_quality(spark):
    got = quality.query(spark, DIR).collect()
    assert len(got) == 1000 and held_out(spark, got, "quality") >= 0.93
    assert sorted(map(tuple, got)) == sorted(map(tuple, quality.query(spark, DIR).collect()))


def test_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, len(quality.NAMES)))
    y = ((x[:, 3] > 0) ^ (x[:, 7] > 0.5)).astype(float)
    assert ((quality.fit_trees(x, y).score(x) > 0.5) == y).mean() > 0.97
    assert np.allclose(quality.fit_trees(x[:0], y[:0]).score(x), 0.5)


def test_classifiers_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None), (4, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        rows = module.predict(extra(odd), extra(labels)).collect()
        assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
        assert module.predict(odd.limit(0), labels.limit(0)).count() == 0
    trees = quality.fit(odd, labels)
    assert quality.keep_good(extra(odd), trees, 0.0).columns == extra(odd).columns and quality.keep_good(odd, trees, 0.0).count() == 8


def test_trees_against_a_walk():
    """Array traversal against a walk node by node in plain Python."""
    rng = np.random.default_rng(2)
    trees, depth, width = 7, 3, 5
    model = quality.Trees(0.3, rng.integers(0, width, (trees, 7)), rng.choice([-0.5, 0.0, 0.5, np.inf], (trees, 7)), rng.normal(size=(trees, 8)))
    x = rng.normal(size=(200, width)).round(1)
    for row, got in zip(x, model.raw(x)):
        total = 0.3
        for t in range(trees):
            node = 0
            for _ in range(depth):
                node = 2 * node + (2 if row[model.feature[t, node]] > model.threshold[t, node] else 1)
            total += model.value[t, node - 7]
        assert abs(total - got) < 1e-9


def test_first_split_against_exhaustive_search():
    """The root of the first tree has the best gain of all splits between values, and leaves are Newton steps."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 6, (120, 4)).astype(float)  # few values: every split between them is at a bin's edge
    y = ((x[:, 2] > 2) ^ (rng.random(120) < 0.1)).astype(float)
    got = quality.fit_trees(x, y, 1, 1)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = p - y, np.full(len(y), p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.LAMBDA)
    gains = {}
    for f in range(4):
        for cut_at in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut_at
            if left.sum() >= quality.LEAST_LEAF and (~left).sum() >= quality.LEAST_LEAF:
                gains[f, cut_at] = score(left) + score(~left) - score(left | ~left)
    f, threshold = got.feature[0, 0], got.threshold[0, 0]
    left = x[:, f] <= threshold
    best = max(gains, key=gains.get)
    assert f == best[0] == 2 and (left == (x[:, f] <= best[1])).all()
    want = [-quality.RATE * g[m].sum() / (h[m].sum() + quality.LAMBDA) for m in (left, ~left)]
    assert np.allclose(got.value[0], want)


def test_toxicity(spark):
    got = toxicity.query(spark, DIR).collect()
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", "toxic").collect()}
    assert len(got) == 1000 and held_out(spark, got, "toxic") >= 0.9
    pairs = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    caught = [p for p, y in pairs if y == 1]
    alarms = [p for p, y in pairs if y == 0]
    assert caught and sum(caught) >= 0.6 * len(caught) and sum(alarms) <= 0.03 * len(alarms)


def neutral_rows():
    """A group is named in most toxic texts, others in clean ones: what a plain model learns from the names."""
    rows = [(1.0, {"muslim", "awful"})] * 30 + [(0.0, {"christian", "fine"})] * 30 + [(1.0, {"awful"})] * 20 + [(0.0, {"fine"})] * 20 + [(1.0, {"muslim", "odd"})] * 10 + [(0.0, set())] * 4
    return rows, sorted({"awful", "fine", "odd"} | toxicity.SWAPS.keys())


def test_toxicity_gradient():
    """The gradient against finite differences, with and without the penalty."""
    rows, vocabulary = neutral_rows()
    problem = toxicity.Problem(rows, {w: i for i, w in enumerate(vocabulary)})
    rng = np.random.default_rng(0)
    w = rng.normal(size=len(vocabulary) + 1)
    assert problem.pairs == 2 * 70
    for pairing in (0.0, 1.0, 3.0):
        g = problem.objective(w, pairing)[1]
        for i in [len(vocabulary), *rng.choice(len(vocabulary), 25, replace=False).tolist(), vocabulary.index("muslim"), vocabulary.index("christian")]:
            step = np.zeros_like(w)
            step[i] = 1e-5
            want = (problem.objective(w + step, pairing)[0] - problem.objective(w - step, pairing)[0]) / 2e-5
            assert abs(g[i] - want) < 1e-6


def test_toxicity_counterfactuals():
    """The penalty narrows the gap between groups and clears neutral mentions; what is toxic stays so."""
    rows, vocabulary = neutral_rows()
    plain, paired = toxicity.fit_weights(rows, vocabulary, 0.0), toxicity.fit_weights(rows, vocabulary)
    gap = lambda m: abs(m.logit("a muslim here") - m.logit("a christian here"))
    assert gap(plain) > 2 > 0.3 > gap(paired)
    neutral = ["muslim neighbours", "our muslim friends came", "a muslim here"]
    assert (plain.score(neutral) > 0.5).all() and (paired.score(neutral) < 0.2).all()
    assert paired.score(["awful"])[0] > 0.9 > 0.1 > paired.score(["fine"])[0]


def test_toxicity_counterfactual_words():
    for w, others in toxicity.SWAPS.items():
        swapped = toxicity.counterfactuals({w, "plain"})
        assert len(swapped) == toxicity.VERSIONS and all(w not in s and "plain" in s and s - {"plain"} <= set(others) for s in swapped)
    assert toxicity.counterfactuals({"plain"}) == []


def check_pieces(pieces, capacity):
    rows = collections.defaultdict(list)
    for r in pieces:
        rows[r[3]].append((r[4], r[2]))
    for s in rows.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at and n > 0
            at += n
        assert at <= capacity


def test_plan():
    rng = random.Random(0)
    for lengths in ([1], [4096, 4097, 8192], [rng.randint(1, 9000) for _ in range(500)], [rng.randint(1, 40) for _ in range(2000)]):
        pieces = packing.plan(lengths)
        check_pieces(pieces, 4096)
        for d, n in enumerate(lengths):
            own = sorted((p[1], p[2]) for p in pieces if p[0] == d)
            assert own[0][0] == 0 and sum(x[1] for x in own) == n and all(a + b == c for (a, b), (c, _) in zip(own, own[1:]))
        used = collections.Counter()
        for p in pieces:
            used[p[3]] += p[2]
        assert sum(0 if u & (u - 1) == 0 else 4096 - u for u in used.values()) == 0


def test_packing_query(spark, texts):
    got = packing.query(spark, DIR).collect()
    check_pieces([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got], 4096)
    t = tokens.Encoder(tokens.vocabulary_path()).tokenizer
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert set(by) == set(texts)
    for i, text in texts.items():
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_new_plain_words_by_model_alone(monkeypatch):
    """A packing task gives no plain word to the whole tokenizer; blanks at either end, empty and null texts keep their places."""
    import pyarrow as pa
    import pyspark

    e, asked = tokens.Encoder(tokens.vocabulary_path()), []
    whole = e.tokenizer

    class Watched:
        def encode_batch_fast(self, words, **more):
            asked.extend(words)
            return whole.encode_batch_fast(words, **more)

    class Context:
        get = staticmethod(lambda: type("", (), {"partitionId": lambda self: 0})())

    e.tokenizer = Watched()
    monkeypatch.setattr(packing, "encoder", lambda path: e)
    monkeypatch.setattr(pyspark, "TaskContext", Context)
    rng = random.Random(6)
    made = [None, "", "  ", "\tÑandú, \x0b don't\r\n", *(" ".join("".join(rng.choices("abcdeé,3'", k=9)) for _ in range(rng.randint(0, 60))) + " " * (i % 3) for i in range(300)), None]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(made))), "text": made})
    got = collections.defaultdict(list)
    for out in packing._pack("", 1 << 14, 4096)(iter([batch])):
        for r in out.to_pylist():
            got[r["doc_id"]].append(r)
    for i, text in enumerate(made):
        ids, at = np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for r in sorted(got[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not asked


def test_packing_odd(odd):
    rows = packing.pack(extra(odd)).collect()
    assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6} and sum(r.length for r in rows) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens for r in rows}.values()) + next(r.doc_tokens for r in rows if r.doc_id == 5)
    assert packing.pack(odd.limit(0)).count() == 0


def test_exact_query(spark, docs):
    frame = docs.select("doc_id", "text").toPandas()
    assert sorted(map(tuple, exact.query(spark, DIR).collect())) == sorted(sql(exact.SQL, documents=frame))


def test_exact_odd(odd):
    rows = exact.exact_groups(extra(odd)).collect()
    assert len(rows) == 8
    blank = {r.doc_id: r for r in rows if r.doc_id in (1, 2, 3)}
    assert all(r.keep_id == 3 and r.group_size == 3 and r.kept == (r.doc_id == 3) for r in blank.values())
    threes = [r for r in rows if r.group_size == 3 and r.doc_id not in (1, 2, 3)]
    assert {r.keep_id for r in threes} == {5} and sum(r.kept for r in threes) == 1
    kept = exact.drop_exact_copies(extra(odd))
    assert kept.columns == extra(odd).columns and kept.count() == 4
    assert exact.exact_groups(odd.limit(0)).count() == 0


def test_exact_index_grows(spark):
    index = exact.DigestIndex(spark, buckets=3)
    one = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "ab"), (4, "d"), (5, " d")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in exact.exact_groups(one, index).collect()} == {1: True, 2: True}
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact.exact_groups(two, index).collect()}
    assert got == {3: (1, False), 4: (5, False), 5: (5, True)}
    assert index.rows().count() == 3
    plan = two.select(exact.digest_of(F.col("text")).alias("digest")).join(spark.table(index.table).select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    plan = index.of(cut(two.select(exact.digest_of(F.col("text")).alias("digest")).distinct(), "digests"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("hashpartitioning(digest") == 1  # the index itself is not shuffled
    tables = [t.name for t in spark.catalog.listTables()]
    assert exact.exact_groups(two).count() == 3 and [t.name for t in spark.catalog.listTables()] == tables


def test_exact_index_is_kept_and_locked(spark, tmp_path):
    """An index in a folder is opened again; a second writer fails and changes nothing."""
    path = f"file://{tmp_path}/index"
    one = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "ab"), (4, "d")], "doc_id long, text string")
    first = exact.DigestIndex(spark, "kept_index", 5, path)
    exact.exact_groups(one, first).collect()
    first.forget()
    again = exact.DigestIndex(spark, "kept_index", path=path)
    assert again.buckets == 5
    (tmp_path / "index" / "_lock").touch()
    with pytest.raises(RuntimeError, match="another writer"):
        exact.exact_groups(two, again)
    (tmp_path / "index" / "_lock").unlink()
    assert {r.doc_id: r.keep_id for r in exact.exact_groups(two, again).collect()} == {3: 1, 4: 4}
    assert again.rows().count() == 3 and not (tmp_path / "index" / "_lock").exists()
    again.forget()


def test_pipeline(spark, texts):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, DIR).collect()
    check_pieces([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows], 4096)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    good = corpus_pipeline.good(spark, docs, DIR)
    assert good.columns == docs.columns
    scores = {r.doc_id: r.score for r in quality.query(spark, DIR).collect()}
    assert {r.doc_id for r in good.select("doc_id").collect()} == {i for i, s in scores.items() if s >= 0.3}
    assert {r.doc_id for r in rows} <= {i for i, s in scores.items() if s >= 0.3}


def test_pipeline_odd(spark, odd, tmp_path):
    """Each stage, and all in turn, over nulls, empty and long texts, ties, repeated rows, clashing names and empty tables."""
    import corpus_pipeline

    spark.createDataFrame([(4, 1, 0), (5, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = f"file://{tmp_path}"
    for table in (odd, extra(odd), odd.limit(0)):
        given, n = table, table.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, d)
            rows = out.collect()
            if name == "packing":
                check_pieces([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows], 4096)
                assert sum(r.start == 0 for r in rows) == n
            else:
                assert out.columns == given.columns and (n or not rows)
            if name in ("exact_dedup", "near_dedup"):
                assert len(rows) == (4 if n else 0)  # blank texts, both spellings of one, the long one and the last
        if "TEXT" not in given.columns:  # such a table has no file
            given.write.parquet(f"{tmp_path}/documents.parquet", mode="overwrite")
            out = corpus_pipeline.run(spark, d)
            assert out.columns == packing.pack(given).columns and (out.count() > 0) == (n > 0)


def test_pipeline_near_copies_are_those_of_op1(spark):
    """The stage keeps the least doc_id of each of op1's components, whatever the size of a group."""
    import corpus_pipeline

    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = {0: None, 1: " \n", 2: "one two"}
    for i in range(3, 120):
        near = list(base)
        near[rng.randrange(400)] = f"x{i}"
        texts[i] = " ".join(near)
    for i in range(120, 150):  # the second of two has a word more, which may be too much for 4 bits
        texts[i] = texts[i - 1] + " end" if i % 2 else " ".join(f"y{rng.randrange(500)}" for _ in range(60))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = python_components({i: python_fingerprint(t or "") for i, t in texts.items()})
    kept = {r.doc_id for r in corpus_pipeline.sparse(spark, docs, DIR).collect()}
    assert kept == set(want.values()) and 5 < len(kept) < 60


def test_pipeline_keeps_no_table_of_earlier_stages(spark, monkeypatch):
    """Of the stages' tables the last alone is there when the packing begins."""
    import corpus_pipeline
    from marginalia import storage

    folders = []

    def noted(*args):
        df = storage.cut(*args)
        folders.append(Path(df.inputFiles()[0].removeprefix("file://")).parent)
        return df

    monkeypatch.setattr(corpus_pipeline, "cut", noted)
    whole = [(name, lambda s, docs, d: docs.where("doc_id is not null")) for name, _ in corpus_pipeline.STAGES[:-1]]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*whole, corpus_pipeline.STAGES[-1]])
    out = corpus_pipeline.run(spark, DIR)
    assert len(set(folders)) == 4 and [f.exists() for f in folders] == [False] * 3 + [True]
    assert out.select("doc_id").distinct().count() == spark.read.parquet(f"{DIR}/documents.parquet").count()


def test_near_copies_odd(odd):
    """Null, empty and blank texts are copies of one another; a long text, ties and clashing names do no harm."""
    rows = simhash.similar_groups(extra(odd)).collect()
    assert len(rows) == 8 and sum(r.kept for r in rows) == 4
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in rows if r.doc_id in (5, None)} == {5}
    out = simhash.drop_near_copies(extra(odd))
    assert out.columns == extra(odd).columns and {r[0] for r in out.collect()} == {1, 4, 5, 6}
    assert simhash.drop_near_copies(odd.limit(0)).count() == 0


def test_similar_groups(spark):
    rng = random.Random(8)
    rows = []
    for g in range(30):
        words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(150)]
        rows.append((len(rows), " ".join(words)))
        for _ in range(g % 4):
            near = list(words)
            near[rng.randrange(150)] = "changed"
            rows.append((len(rows), " ".join(near)))
    rows += [(len(rows), None), (len(rows) + 1, " "), (None, "x y"), (1000, "x  y")]
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [frozenset(simhash.shingles(t, 5).tolist()) for _, t in rows]
    ids = list(range(len(rows)))
    near = lambda a, b: not (a | b) or len(a & b) >= 0.8 * len(a | b)
    label = {i: i for i in ids}
    for _ in range(5):
        for i in ids:
            for j in ids:
                if near(sets[i], sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    first = {}
    for i in ids:
        first.setdefault(label[i], []).append(rows[i][0])
    want = {i: min((x for x in first[label[k]] if x is not None), default=None) for k, i in enumerate(r[0] for r in rows)}
    assert {r.doc_id: r.component_id for r in got} == want
    assert sum(r.kept for r in got) == len(first)


def test_similar_groups_dense(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(120)]
    rows = [(0, " ".join(words))]
    for i in range(1, 300):
        near = list(words)
        near[rng.randrange(120)] = f"w{i}"
        rows.append((i, " ".join(near)))
    kept = [r.doc_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").collect()]
    assert kept == [0]


def near_components(rows):
    """component_id of each row by comparing all pairs of shingle sets."""
    sets = [frozenset(simhash.shingles(t, 5).tolist()) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for j in range(len(rows)):
        for i in range(j):
            if not (sets[i] | sets[j]) or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def got_components(spark, rows):
    return {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def made_words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    for n in list(range(1, 40)) + [200, 999]:
        common = rng.permutation(3 * n)[:n].astype(np.int32)
        ranks, order = np.argsort(common, kind="stable") + 1, np.sort(common)
        for _ in range(20):
            whole = rng.permutation(3 * n)[: n + n // 4].astype(np.int32)
            a, b = np.sort(whole[:n]), np.sort(rng.permutation(whole)[: rng.integers(n, len(whole) + 1)])
            if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                (x, lead), (y, _) = (simhash.prefixes(s, order, ranks, 0.8) for s in sorted((a, b), key=len))
                assert set(x[:lead].tolist()) & set(y.tolist())


def test_similar_groups_appended_and_cut(spark):
    rng, rows = random.Random(10), []
    for g in range(60):
        words = made_words(rng, 50 + 5 * g)
        n = int((len(words) - 4) * 0.22)
        middle = len(words) // 2
        for near in (words, words + made_words(rng, n), words[: len(words) - n * 4 // 5 + 1], words[:middle] + made_words(rng, n // 2) + words[middle:], words[:20]):
            rows.append((len(rows), " ".join(near)))
    want = near_components(rows)
    assert sum(want[i] != i for i in want) > 100
    assert got_components(spark, rows) == want


def test_similar_groups_of_shuffled_words(spark):
    rng, rows = random.Random(11), []
    for g in range(20):
        words = made_words(rng, 100)
        shuffled = rng.sample(words, len(words))
        for near in (shuffled, words, [*words[:50], words[3], *words[51:]], rng.sample(words, len(words)), shuffled[1:] + shuffled[:1]):
            rows.append((len(rows), " ".join(near)))
    want = near_components(rows)
    assert all(want[5 * g + 2] == 5 * g + 1 for g in range(20))
    assert got_components(spark, rows) == want


def test_similar_groups_large_cells(spark):
    # all documents have 84 of 100 words in common with the first; few are near copies of one another
    rng, words = random.Random(13), made_words(random.Random(12), 100)
    rows = [(0, " ".join(words))]
    for i in range(1, 240, 2):
        own = words[:84] + made_words(rng, 16)
        rows += [(i, " ".join(own)), (i + 1, " ".join([*own[:-1], "other"]))]
    rows += [(300 + i, " ".join([*words[:80], *made_words(rng, 20)])) for i in range(60)]
    rows += [(400 + i, " ".join(words[:j] + ["x"] + words[j + 1 :])) for i, j in enumerate(range(5, 95))]
    want = near_components(rows)
    assert len(set(want.values())) > 100
    assert got_components(spark, rows) == want


def test_similar_groups_in_a_cell_of_shuffled_words(spark):
    rng, rows = random.Random(14), []
    words = made_words(rng, 100)
    for i in range(100):
        own = rng.sample(words, len(words))
        rows += [(2 * i, " ".join([f"a{i}", *own[1:]])), (2 * i + 1, " ".join([*own[:-1], f"b{i}"]))]
    assert got_components(spark, rows) == {i: i - i % 2 for i in range(200)}
