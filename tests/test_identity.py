"""Duplicates, documents, threads and events against plain Python that compares all pairs."""

import random
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from marginalia.functions import dates as D
from marginalia.functions import keys as K
from marginalia.functions import text as X
from marginalia.operators import dedup, documents, duplicates, nearjoin, threads


def one(spark, build, *values):
    df = spark.createDataFrame([values], ", ".join(f"v{i} string" for i in range(len(values))))
    return df.select(build(*[F.col(f"v{i}") for i in range(len(values))]).alias("r")).first().r


def words(rng, n, size=5):
    return ["".join(rng.choices("abcdefghij", k=size)) for _ in range(n)]


def components(ids, linked):
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: root(i) for i in ids}


def test_near_candidates_of_a_shared_word(spark):
    """Texts that share rare words but are not near are no candidates, however many; near ones are, also across batches."""
    rng = random.Random(5)
    pool = words(rng, 3000)
    texts = ["zebra quagga " + " ".join(rng.sample(pool, 60)) for _ in range(300)]
    texts += [t + " more" for t in texts[:40]]
    df = spark.createDataFrame([(i, "c", t) for i, t in enumerate(texts)], "comment_id long, city string, normal string")
    want = {(i, i + 300) for i in range(40)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        rows = nearjoin.features(df)
        assert {(r.left, r.right) for r in nearjoin.candidates(rows, ["city"]).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_near_pairs_lose_none(spark):
    """Random bags of few and of very frequent words, against all pairs."""
    rng, rows = random.Random(3), []
    pool = words(rng, 30)
    for g in range(25):
        base = rng.choices(pool, k=rng.randint(1, 30)) + ["the"] * rng.choice([0, 0, 40, 90])
        for _ in range(rng.randint(1, 4)):
            near = list(base)
            for _ in range(rng.randint(0, 2)):
                near[rng.randrange(len(near))] = rng.choice(pool)
            rows.append((len(rows), "c" if g % 5 else "d", " ".join(near)))
    rows += [(900, "c", ""), (901, "c", None)]
    want, first = set(), {}
    for i, c, t in rows:
        if t:
            first.setdefault((c, t), i)
    kept = [(i, c, t) for (c, t), i in first.items()]
    for i, c, t in kept:
        for j, d, u in kept:
            if i < j and c == d:
                a, b = Counter(t.split()), Counter(u.split())
                shared, small = (a & b).total(), min(a.total(), b.total())
                if shared >= 0.96 * small and shared >= 0.9 * (a | b).total() and small >= 0.84 * max(a.total(), b.total()) and SequenceMatcher(None, t, u).ratio() >= 0.965:
                    negatives = [set(x.split()) & set(X.NEGATIONS) for x in (t, u)]
                    if negatives[0] == negatives[1]:
                        want.add((i, j))
    df = spark.createDataFrame(rows, "comment_id long, city string, text string")
    assert {(r.left, r.right) for r in dedup.near_pairs(df, ["city"]).collect()} == want and len(want) > 1
    assert {(r.comment_id, r.of) for r in dedup.text_members(df, ["city"]).collect()} == {(i, first[c, t]) for i, c, t in rows if t}
    assert dedup.near_pairs(df.limit(0), ["city"]).count() == 0
    possible = {(r.left, r.right) for r in dedup.possible_pairs(df, ["city"]).collect()}
    assert possible == {(i, j) for i, c, t in kept for j, d, u in kept if i < j and c == d and SequenceMatcher(None, t, u).ratio() >= 0.9}


def test_containing_pairs_lose_none(spark):
    rng = random.Random(4)
    pool = words(rng, 40)
    rows = [(i, rng.choice("ab"), " ".join(rng.sample(pool, rng.choice([1, 2, 3, 30, 36])))) for i in range(150)]
    got = {(r.left, r.right) for r in duplicates.containing_pairs(spark.createDataFrame(rows, "id long, site string, t string"), ["site"], F.split("t", " "), 0.9).collect()}
    sets = {i: (s, set(t.split())) for i, s, t in rows}
    want = {(i, j) for i in sets for j in sets if i < j and sets[i][0] == sets[j][0] and len(sets[i][1] & sets[j][1]) >= 0.9 * min(len(sets[i][1]), len(sets[j][1]))}
    assert got == want and len(want) > 50


BASE = "provide the clear width of every exit door and show the swing of each leaf in the hardware schedule on sheet a2.1 with all closers"
FORM = "provide clear width for every exit door and show its swing on sheet a2.1 with all closers listed"


def comment(i, text, **more):
    return {"comment_id": i, "original_text": text, "city": "Town", "property_project": "12 First Street", "source_document": f"f{i}.pdf", "review_round": "Round 1", "discipline": "Fire", "comment_number": str(i), **more}


FIELDS = "comment_id long, original_text string, city string, property_project string, source_document string, review_round string, discipline string, comment_number string, hierarchy_status string, duplicate_status string, canonical_document_id string, canonical_document_duplicate_group_size int, response_id string, link_review_status string, human_review_status string, text_trust_status string, reviewer string, issue_thread_id string, lineage_duplicate_of long"


def frame(spark, rows):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], FIELDS)


def test_four_passes(spark):
    longer = BASE.replace("every exit door", "every exit door as marked")
    rows = [
        comment(1, BASE), comment(2, "The " + BASE.upper(), link_review_status="confirmed", response_id="R"), comment(3, BASE, review_round="Round 2"), comment(4, BASE, reviewer="Jo 3/4/2024"),
        comment(5, BASE.replace("2.1", "2.2")), comment(6, "not " + BASE),
        # one document as two files: dates differ
        comment(11, "short text one", canonical_document_id="D", canonical_document_duplicate_group_size=2, comment_number="9", reviewer="A 1/2/2024"), comment(12, "short text one", canonical_document_id="D", canonical_document_duplicate_group_size=2, comment_number="9"),
        # numbered requirements that differ in a word
        comment(21, longer + " p", hierarchy_status="merged_parent", property_project="x"), comment(22, longer + " p and", hierarchy_status="merged_parent", property_project="x"), comment(23, longer + " 9 p", hierarchy_status="merged_parent", property_project="x"),
        # a form's row in two files
        comment(31, "Item: " + FORM, comment_number="7", city="Other"), comment(32, FORM + " please", comment_number="7", city="Other"), comment(33, FORM + " please now", comment_number="8", city="Other"),
        comment(41, BASE, duplicate_status="hierarchical_subpoint"), comment(42, None), comment(43, "  "),
    ]
    got = {(r.comment_id, r.duplicate_of, r["pass"]) for r in duplicates.find_duplicates(frame(spark, rows)).collect()}
    assert got == {(1, 2, "exact"), (12, 11, "document_copy"), (22, 21, "parent"), (32, 31, "form_row")} or got == {(1, 2, "exact"), (11, 12, "document_copy"), (22, 21, "parent"), (32, 31, "form_row")}
    marks = {r.comment_id: r for r in duplicates.mark_duplicates(frame(spark, rows)).collect()}
    assert marks[1].duplicate_status == "same_site_round_extraction_variant" and marks[1].search_eligible is False and marks[2].dedup_decision == "DISTINCT"
    assert marks[22].duplicate_status == "same_site_round_hierarchical_repeat" and marks[32].duplicate_status == "same_site_round_form_row_repeat" and marks[41].search_eligible is False
    lost = duplicates.find_duplicates(frame(spark, rows), 1)
    places = {(r.owner, r.comment_id) for r in duplicates.source_occurrences(frame(spark, rows), lost).collect()}
    assert {(2, 1), (2, 2)} <= places
    assert duplicates.find_duplicates(frame(spark, [])).count() == 0


def test_parent_and_form_passes_against_all_pairs(spark):
    rng, rows = random.Random(6), []
    for g in range(14):
        base = words(rng, 40)
        for _ in range(rng.randint(1, 4)):
            near = list(base)
            for _ in range(rng.randint(0, 2)):
                near.insert(rng.randrange(len(near)), rng.choice(base))
            if rng.random() < 0.3:
                near[rng.randrange(len(near))] = "changed"
            rows.append(comment(len(rows), " ".join(near), property_project=rng.choice(["a", "b"]), hierarchy_status="merged_parent" if g % 2 else None, comment_number="1"))
    parents = [r for r in rows if r["hierarchy_status"]]

    def parent(i, j):
        a, b = rows[i], rows[j]
        x, y = a["original_text"], b["original_text"]
        p, q = set(x.split()), set(y.split())
        return a["property_project"] == b["property_project"] and len(p & q) >= 0.96 * min(len(p), len(q)) and SequenceMatcher(None, x, y).ratio() >= 0.94

    def form(i, j):
        a, b = rows[i], rows[j]
        x, y = a["original_text"].split(), b["original_text"].split()
        run = max(m.size for m in SequenceMatcher(None, x, y).get_matching_blocks())
        small, large = sorted((len(x), len(y)))
        return a["property_project"] == b["property_project"] and len(set(x) & set(y)) >= 0.9 * small and run >= 8 and (large > 1.35 * small or run >= max(8, int(0.55 * small)))

    prepared = duplicates.prepared(frame(spark, rows))
    for step, pool, linked in ((duplicates.parent_losers, parents, parent), (duplicates.form_losers, [r for r in rows if not r["hierarchy_status"]], form)):
        groups = components([r["comment_id"] for r in pool], linked)
        least = {}
        for i, g in groups.items():
            least[g] = min(least.get(g, i), i)
        want = {(i, least[g]) for i, g in groups.items() if least[g] != i}
        assert {(r.comment_id, r.duplicate_of) for r in step(prepared).collect()} == want and want


def test_responses_by_root(spark):
    of = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "comment_id long, duplicate_of long")
    assert {(r.node, r.root) for r in duplicates.parent_roots(of).collect()} == {(1, 3), (2, 3), (7, 8)}
    rows = [("a", 1, "Response: noted as 3", "1"), ("b", 3, "noted as 3", "1"), ("c", 3, "noted as 4", "1"), ("d", 3, "noted as 3", "2"), ("e", 9, "noted as 3", "1"), ("f", 3, "", "1")]
    df = spark.createDataFrame(rows, "response_id string, comment_id long, original_text string, review_round string")
    assert {(r.response_id, r.duplicate_of) for r in duplicates.response_losers(df, of).collect()} == {("b", "a")}


def test_document_overlap_loses_none(spark):
    rng = random.Random(5)
    texts = [f"t{i}" for i in range(120)]
    base = [set(rng.sample(texts, rng.choice([1, 10, 40, 100]))) for _ in range(12)]
    files = {}
    for i, b in enumerate(base * 3):
        own = set(b)
        for _ in range(rng.randint(0, 3)):
            own.discard(rng.choice(sorted(own))) if rng.random() < 0.5 and len(own) > 1 else own.add(rng.choice(texts))
        files[i] = frozenset(own)
    files[90], files[91], files[92] = frozenset(texts[:50]), frozenset(texts[:100]), frozenset(texts[:99])
    df = spark.createDataFrame([(f, k) for f, s in files.items() for k in s], "file long, k string")
    kept = {min(f for f in files if files[f] == s): s for s in files.values()}
    want = {(a, b): len(kept[a] & kept[b]) / max(len(kept[a]), len(kept[b])) for a in kept for b in kept if a < b}
    got = {(r.left, r.right): r.overlap for r in documents.overlap(df, "file").collect()}
    assert got == {p: v for p, v in want.items() if v >= 0.9} and (91, 92) in got
    assert documents.overlap(df.limit(0), "file").count() == 0


def test_greedy_overlap(spark):
    a, b = ["the first text here", "second one there"], ["the first text hers", "nothing alike", "second one there"]
    df = spark.createDataFrame([(a, b), ([], b)], "a array<string>, b array<string>")
    got = [r.r for r in df.select(documents.greedy_overlap("a", "b").alias("r")).collect()]
    assert abs(got[0] - (1 + SequenceMatcher(None, a[0], b[0]).ratio()) / 3) < 1e-9 and got[1] == 0
    texts = spark.createDataFrame([("x", "s", t) for t in a] + [("y", "s", t) for t in b[::2]], "f string, site string, t string")
    assert [(r.left, r.right, round(r.overlap, 3)) for r in documents.near_overlap(texts, "f", ["site"], "t").collect()] == [("x", "y", round((1 + SequenceMatcher(None, a[0], b[0]).ratio()) / 2, 3))]


def test_canonical_documents(spark):
    place = {"city": "Town", "property_project": "p", "review_round": "1"}
    rows = [
        {"comment_id": 1, "original_text": "One  text", "source_document": "a/plan.pdf", **place}, {"comment_id": 2, "original_text": "one text", "source_document": "b/plan.docx", **place},
        {"comment_id": 3, "original_text": "other", "source_document": "c/x.pdf", "source_sha256": "AB", **place}, {"comment_id": 4, "original_text": "more", "source_document": "d/y.pdf", "source_sha256": "ab", **place},
        {"comment_id": 5, "original_text": "ONE text", "source_document": "z/response letter.pdf", **place}, {"comment_id": 6, "original_text": "its own", "source_document": "z/response letter.pdf", **place},
    ]
    schema = "comment_id long, original_text string, source_document string, source_sha256 string, city string, property_project string, review_round string"
    names = [f.split()[0] for f in schema.split(", ")]
    files, pairs, told = documents.canonical_documents(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema))
    by = {r.path: r for r in files.collect()}
    assert by["a/plan.pdf"].canonical_document_id == by["b/plan.docx"].canonical_document_id and by["b/plan.docx"].canonical_path == "a/plan.pdf" and by["c/x.pdf"].duplicate_group_size == 2
    kinds = {r.comment_id: (r.occurrence_type, r.carried_forward_from, r.eligible) for r in told.collect()}
    assert kinds[1] == ("newly_issued", None, True) and kinds[2] == ("copied_duplicate", 1, False) and kinds[5] == ("historical_quote", 1, False) and kinds[6][2] and pairs.count() == 0


def test_progression(spark):
    p = lambda t: [tuple(e) for e in one(spark, threads.progression, t, "2")]
    assert p("A. PC1- first one PC2 & 3: second") == [("PC1", "government_comment", "1", "first one"), ("PC2&PC3", "reviewer_follow_up", "2", "second")]
    assert p("see note (b) PC2: more") == [("PC2", "reviewer_follow_up", "2", "see note more")]
    assert p(" plain ") == [("", "government_comment", "2", "plain")] and p("") == [] and p("PC1:") == [("", "government_comment", "2", "PC1:")]


def thread_rows():
    rng, rows = random.Random(7), []
    for g in range(16):
        base = words(rng, 30)
        for _ in range(rng.randint(1, 4)):
            near = list(base)
            if rng.random() < 0.4:
                near.insert(rng.randrange(30), rng.choice(base))
            if rng.random() < 0.2:
                near = words(rng, 30)
            rows.append(comment(len(rows), " ".join(near), discipline=rng.choice(["Fire", "Building", "unknown"]), comment_number=rng.choice(["", "", "4", "5"]), property_project=rng.choice(["a", "b"]), text_trust_status="verified", issue_thread_id=rng.choice(["", "", "", f"old{g % 3}"])))
    return rows


def test_threads_against_all_pairs(spark):
    rows = thread_rows()

    def linked(i, j):
        a, b = rows[i], rows[j]
        if a["property_project"] != b["property_project"]:
            return False
        if a["issue_thread_id"] and a["issue_thread_id"] == b["issue_thread_id"]:
            return True
        x, y, f, g = a["original_text"], b["original_text"], a["discipline"], b["discipline"]
        fits = "unknown" in (f, g) or f == g
        if x == y and fits:
            return True
        block = [r["comment_number"] or "d:" + r["discipline"] for r in (a, b)]
        if block[0] != block[1]:
            return False
        p, q = set(x.split()), set(y.split())
        return x == y or (max(len(x), len(y)) <= 1.35 * min(len(x), len(y)) and len(p & q) >= 0.96 * min(len(p), len(q)) and SequenceMatcher(None, x, y).ratio() >= 0.94)

    groups = components(range(len(rows)), linked)
    got = {r.comment_id: r for r in threads.assign_threads(frame(spark, rows)).collect()}
    sizes = Counter(groups.values())
    assert len(got) == len(rows)
    named = defaultdict(set)
    for i, g in groups.items():
        assert got[i].members == sizes[g]
        if sizes[g] > 1:
            named[g].add(got[i].issue_thread_id)
            assert got[i].issue_grouping_status == "cross_document_progression"
    assert all(len(n) == 1 for n in named.values()) and len({min(n) for n in named.values()}) == len(named)


def test_thread_aliases(spark):
    text = "show the new wall on the plan"
    rows = [comment(1, text, text_trust_status="verified", issue_thread_id="T1", reviewer="Al"), comment(2, text), comment(3, "Noted", issue_thread_id="")]
    df = frame(spark, rows).withColumn("event_date", F.when(F.col("comment_id") == 1, "2024-05-06"))
    got = {r.comment_id: (r.issue_thread_id, r.issue_grouping_status) for r in threads.assign_threads(df).collect()}
    assert got == {1: ("T1", None), 2: ("T1", "source_occurrence_alias"), 3: ("", None)}


def events(spark, rows):
    """Rows (thread, comment, file, text, extra fields of the event)."""
    names = [f.split(":")[0] for f in threads.EVENT[len("struct<") : -1].split(",")]
    made = [(c, t, f, [tuple({"exact_text": x, **e}.get(n, "") for n in names)]) for t, c, f, x, e in rows]
    df = spark.createDataFrame(made, f"comment_id long, issue_thread_id string, source_document string, issue_thread_events array<{threads.EVENT}>")
    return threads.thread_events(threads.raw_events(threads._described(df))).orderBy("thread", "place").collect()


def test_cumulative_history(spark):
    """Cumulative exports: four events, seen 2, 2, 1 and 1 times."""
    first, second = "PC1- Show the door width. PC2: Door width is not shown.", "PC1- Show the door width. PC2: Door width is not shown. PC3: Provide the schedule of doors. PC4: Add hardware to it."
    rows = [comment(1, first, issue_thread_id="T", text_trust_status="verified"), comment(2, second, issue_thread_id="T", text_trust_status="verified", review_round="Round 4")]
    got = threads.index_threads(frame(spark, rows)).orderBy("place").collect()
    assert [(r.marker, r.occurrences, r.places) for r in got] == [("PC1", 2, 2), ("PC2", 2, 2), ("PC3", 1, 1), ("PC4", 1, 1)]


def test_event_merging(spark):
    text = "provide the clear width of every exit door on the plan and the schedule"
    say = {"event_type": "reviewer_comment", "actor_role": "city"}
    rows = [
        ("a", 1, "f1", text, say), ("a", 2, "f2", text.upper() + " _x000D_", say),
        ("b", 3, "f1", text, {**say, "event_date": "2024-01-02"}), ("b", 4, "f2", text, {**say, "event_date": "2024-02-03"}), ("b", 5, "f3", text, {**say, "event_date": "2024-05-05", "event_date_source": "filename"}),
        ("c", 6, "f1", "Noted", say), ("c", 7, "f2", "Noted", say),
        ("d", 8, "f1", text, {**say, "actor": "Al"}), ("d", 9, "f2", text, {**say, "actor": "Bo"}), ("d", 10, "f3", text, {"actor_role": "applicant", "event_type": "response"}),
        ("e", 11, "f1", "revised as asked", {"actor_role": "applicant", "event_date": "2024-01-02"}), ("e", 12, "f2", "Revised as asked, see sheet A2", {"actor_role": "applicant", "event_date": "1/2/2024"}),
        ("g", 13, "f1", text + " at door 3", say), ("g", 14, "f2", text + " at door 4", say),
    ]
    got = defaultdict(list)
    for r in events(spark, rows):
        got[r.thread].append((r.occurrences, r.date, r.decision))
    assert got["a"] == [(2, "", "EXACT_DUPLICATE")]
    # an undated copy may not choose between two dates
    assert [g[:2] for g in got["b"]] == [(1, "2024-01-02"), (1, "2024-02-03"), (1, "")]
    assert [g[0] for g in got["c"]] == [1, 1] and {g[2] for g in got["c"]} == {"DISTINCT"}
    assert len(got["d"]) == 3 and got["e"] == [(2, "2024-01-02", "HIGH_CONFIDENCE_DUPLICATE")] and len(got["g"]) == 2
    queue = threads.review_queue(spark.createDataFrame([("t", "E1", ["E2"], [0.95]), ("t", "E2", ["E1"], [0.95])], "thread string, event_id string, review_with array<string>, similarity array<double>"))
    assert [tuple(r) for r in queue.collect()] == [("t", "E1", "E2", 0.95)]


def test_keys(spark):
    path = "comments&response/25-001-2311 Warner Range_Ave/Building/a.pdf"
    assert K.address_form("25-001-2311 Warner-Range Avenue, Menlo Park, CA 94025", "Menlo Park") == "2311 warner range ave" and K.address_form(None, None) == ""
    assert one(spark, K.site_name, "2311 Warner", path, "Menlo Park") == "2311 warner range ave"
    assert one(spark, K.case_marker, "new", "25 - 001 - 2311") == "25-001-2311" and one(spark, K.city_name, " San José,") == "San Jose" and one(spark, K.city_name, None) == "Unknown"
    same = [one(spark, K.project_id, p, "", "", "Menlo Park") for p in (path, "new/25-001-2311 Warner/x.pdf")]
    assert same[0] == same[1] and one(spark, K.project_folder, path) == "25-001-2311 Warner Range_Ave" and one(spark, K.scope_folder, path, "x") == "building"
    assert one(spark, K.discipline_key, "BPC WC3 1 : Building") == "building" and one(spark, K.discipline_key, "Unknown") == ""
    assert one(spark, K.submission_round, "Round 2", "a/3rd Submission/x.pdf", "") == "2|submission:3" and one(spark, K.submission_round, "Round 2", "a/3rd Submission/x.pdf", "2024-01-01") == "2"
    shown = one(spark, K.display_parts, "Markup plan.pdf Building V1 - C1 39 Provide a rated wall at the line", "39")
    assert shown.body == "Provide a rated wall at the line" and shown.label == "Markup · V1-C1 39"
    assert one(spark, K.display_parts, "Provide a wall", "").label == ""
    assert one(spark, K.topic_label, "Comment markup a.pdf Fire review 2 Provide") == "Provide" and one(spark, K.department, "Building Plan Review Kia 7/11/25 3:50 PM") == "Building Plan Review"
    assert one(spark, K.reference_tokens, "RevisedSoilReports_2.pdf") == ["geotech", "geotechnical", "report", "soil"]
    assert one(spark, K.significant_terms, "How many fire-rated entries?") == ["entry", "fire", "rated"] and {"width", "dimension", "size"} <= set(one(spark, K.topic_terms, "door size"))
    assert one(spark, K.normalize_quote, " A_x000D_B\n c ") == "a b c" and one(spark, K.identity_words, "Ünder 5'-0") == "ünder 5 0"


def test_dates(spark):
    d = lambda f, *v: str(one(spark, f, *v))
    assert d(D.label_date, "x 2024-01-02 y 2025-3-4") == "2025-03-04" and d(D.label_date, "2024-13-02 and 1/2/24") == "None" and d(D.label_date, "Sept. 5, 2025") == "2025-09-05"
    assert d(D.last_date, "2024-13-02 and 1/2/24") == "2024-01-02" and d(D.loose_date, "on 1 / 2 / 2024") == "2024-01-02"
    seen = one(spark, D.visible_date, "Plans 99/99/2024 of March 3, 2024 and 1/1/2023")
    assert (str(seen.date), seen.evidence) == ("2024-03-03", "March 3, 2024")
    event = lambda *v: one(spark, lambda a, b, c: D.event_date_key([a], [b], c), *v)
    assert event("2025-09-11T17:54", "9/24/2025", "filename") == "" or event("2025-09-11 17:54", "9/24/2025", "filename") == "2025-09-11"
    assert event("", "9/24/2025", "filename") == "" and event("", "9/24/25", "reviewer") == "2025-09-24"
    said = one(spark, lambda r, p, s, v: D.comment_date(r, p, [s], [v]), "R", "x/Response Letter.pdf", "1/2/2024", "Al 3/4/2024")
    assert str(said) == "2024-03-04" and one(spark, D.source_round, "a/3rd Round of Comments/x.pdf") == 3 and one(spark, D.canonical_round, "", "a/PC2 x.pdf") == 2
    r = one(spark, D.infer_round, "p/2nd Round of Comments/3rd Submission/x.pdf")
    assert (r.round, r.confidence) == ("2", 0.96) and one(spark, D.infer_round, "p/third submission/x.pdf").round == "2" and one(spark, D.infer_round, "x.pdf").round == "unknown"
    made = spark.sql("select named_struct('raw','May 4, 2026','value','','iso','','source','','evidence','','page','3','confidence','2') as c, 'plan.pdf' as p, '' as b").select(D.date_metadata(F.col("c"), F.col("p"), F.col("b")).alias("m"), D.round_metadata(F.lit("2"), F.lit(None).cast("struct<raw:string,value:string,source:string,confidence:string>")).alias("r")).first()
    assert made.m.iso == "2026-05-04" and made.m.confidence == 1.0 and made.r.source == "document_content_unattributed"
    whole = one(spark, lambda a, b, c: D.document_date({"report_date": a}, b, c), "", "Letter of January 2, 2024", "")
    assert (str(whole.date), whole.method) == ("2024-01-02", "visible_document_date")
    source = one(spark, lambda a, m, p, b: D.source_date({"report_date": a}, m, p, b), "1/2/2024", "filename_iso", "x 02-03-2024.pdf", "")
    assert (str(source.date), source.method) == ("2024-02-03", "filename")
