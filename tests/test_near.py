"""The exact tests and the filters of near pairs against the plain ways they stand for."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from marginalia.functions import similarity as S
from marginalia.functions import text as X
from marginalia.operators import dedup, nearjoin


def edited(rng, text, alphabet, times):
    out = list(text)
    for _ in range(times):
        k = rng.randrange(len(out) + 1)
        out[k : k + rng.choice([0, 1, 1, 9])] = rng.choices(alphabet, k=rng.choice([0, 1, 1, 9]))
    return "".join(out)


def test_sequence_is_sequence_matchers():
    """Few and many letters, seldom runs of any length, texts below and above the 200 characters from which frequent ones count less."""
    rng, kept = random.Random(7), 0
    for n in range(300):
        alphabet = rng.choice(["ab", "abcdefghij ", "etaoinshrdlu " * 4 + "jqxzvkw0123456789", "".join(map(chr, range(33, 120)))])
        b = "".join(rng.choices(alphabet, k=rng.choice([0, 1, 40, 199, 200, 201, 500, 1500])))
        b = b[:90] + "jqxzvkw0123456789" * (n % 3) + b[90:]
        a = edited(rng, b, alphabet, rng.choice([0, 1, 3, 20]))
        want = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
        for least in (0.0001, 0.5, 0.965):
            got = S.Sequence(b).ratio(a, least)
            assert got == (want if want >= least else None)
        kept += want >= 0.965
    assert 50 < kept < 290


def test_identity_forms_and_marks():
    rng = random.Random(3)
    bits = [*"aAbz09 .-/'\"’()&:,_\t\n\x0b\x80\0ßéИK", "pc ", "PC1: ", "1. ", "Comment ", "comment v1-c2 3.4 ", "_x000d_", "*x000D*", "--------", "&amp;", "&rsquo;", "ﬁ", " no ", " can't ", "comment remains", "2.5", "x-ray"]
    values = [None, *("".join(rng.choices(bits, k=rng.choice([0, 1, 2, 4, 9, 60]))) for _ in range(4000))]
    forms = X.identity_forms(values)
    assert forms == [X.identity_form(v) for v in values]
    for form in forms:
        tokens = set(form.split(" "))
        assert X.marks(form) == (sorted(t for t in tokens if re.search("[0-9]", t)), sorted(tokens & set(X.NEGATIONS)), any(p in form for p in X.PROGRESSION))


def test_bags_count_words():
    texts = ["a b a a", "b", "", "x-y x y don’t", "the " * 300 + "end"]
    w, bound = nearjoin.bags(texts)
    each = [set(w[b:e].tolist()) for b, e in zip(bound[:-1], bound[1:])]
    bags = [Counter(re.findall("[a-z0-9]+", t)) for t in texts]
    assert [len(x) for x in each] == [x.total() for x in bags]
    assert all(len(x & y) == (p & q).total() for x, p in zip(each, bags) for y, q in zip(each, bags))


def test_large_bags_that_share_rare_words_are_no_candidates(spark):
    """Of thousands of words 256 parities tell nothing: the longer sketches do, also of bags whose sketches differ in length."""
    rng = random.Random(5)
    pool = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(30000)]
    texts = ["zebra quagga " + " ".join(rng.sample(pool, n)) for n in [1900] * 12 + [2040] * 12]
    texts += [texts[0] + " more", " ".join(texts[12].split()[:2000]), texts[13] + " " + " ".join(rng.sample(pool, 60))]
    df = spark.createDataFrame([(i, "c", t) for i, t in enumerate(texts)], "comment_id long, city string, normal string")
    want = {(0, 24), (12, 25), (13, 26)}
    assert {(r.left, r.right) for r in nearjoin.candidates(nearjoin.features(df), ["city"]).collect()} == want


def test_near_pairs_of_long_and_of_short_texts(spark):
    """Against all pairs: words changed, moved and repeated, numbers, negations, copies, no city, no text."""
    rng, rows = random.Random(11), []
    pool = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(400)]
    for g in range(20):
        base = rng.choices(pool, k=rng.choice([3, 9, 60, 100, 200, 900])) + ["the"] * rng.choice([0, 4])
        for _ in range(5):
            near, k = list(base), rng.randrange(len(base))
            near[k] = rng.choice([pool[0], "not", "v2", near[k], near[k] + "s", near[k] + "ed"])
            if rng.random() < 0.15:
                near = near[k:] + near[:k]
            rows.append((len(rows), "c" if g % 4 else "d", ("PC 1: " if g % 3 else "") + " ".join(near)))
    rows += [(900, "c", None), (901, None, rows[0][2]), (902, "c", rows[0][2] + ".")]
    first = {}
    for i, c, t in rows:
        if t and c:
            first.setdefault((c, X.identity_form(t)), i)
    want = set()
    for (c, t), i in first.items():
        for (d, u), j in first.items():
            if i < j and c == d and X.marks(t) == X.marks(u):
                signals = S.counted_signals(*(Counter(re.findall("[a-z0-9]+", x)) for x in (t, u)))
                ratio = SequenceMatcher(None, t, u).ratio()
                if signals[0] >= 0.96 and signals[1] >= 0.9 and signals[2] >= 0.84 and ratio >= 0.965:
                    want.add((i, j, ratio, *signals))
    df = spark.createDataFrame(rows, "comment_id int, city string, text string")
    got = dedup.near_pairs(df, ["city"]).select("left", "right", "sequence", F.col("signals.*")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 8
