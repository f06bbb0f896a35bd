"""Issue threads over cumulative review records, and the events of each thread.

Threads are components: records of a site that share a thread already, an
opening event's text, or nearly that text under one printed number or
discipline.  Links of equal keys are stars, near texts are found by words they
must share, so no block is compared pair by pair.

Events of a thread come from the marked rounds of each record's text and from
events it brings along.  Copies equal in all that matters are summed where they
are read; what is left of a thread, its distinct events, is merged in order by
one task, which looks only at events that numbers, negations or opening word
allow.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import dates as D
from marginalia.functions import identity as I
from marginalia.functions import keys as K
from marginalia.functions import labels as L
from marginalia.functions import similarity as S
from marginalia.functions import text as X
from marginalia.operators.components import connected_components
from marginalia.operators.duplicates import containing_pairs, folded_pairs
from marginalia.plans.records import COMMENTS, comments, complete, normal_sql, sql_over, table
from marginalia.storage import cut

# The marker of a round within a text, and thresholds of near anchors.
MARKER = "(?i)(?<![A-Za-z0-9])(?:\\([A-Za-z]\\)\\s*)?(PC\\s*[0-9]+(?:\\s*(?:&|and|,)\\s*(?:PC\\s*)?[0-9]+)*)\\s*[-:]\\s*"
ANCHOR_WORDS, ANCHOR_SEQUENCE, ANCHOR_LENGTH = 0.96, 0.94, 1.35
EVENT = "struct<event_id:string,event_type:string,actor_role:string,actor:string,occurred_at:string,occurred_at_label:string,event_date:string,event_date_source:string,event_round_marker:string,effective_round:string,printed_comment_id:string,exact_text:string>"
_COLUMNS = {
    "city": "string", "project_id": "string", "property_project": "string", "source_document": "string", "discipline": "string", "comment_number": "string", "review_round": "string", "document_round": "string",
    "reviewer": "string", "original_text": "string", "verified_text": "string", "issue_thread_id": "string", "duplicate_status": "string", "text_trust_status": "string", "source_status": "string",
    "verification_status": "string", "human_review_status": "string", "event_date": "string", "event_date_iso": "string", "event_date_source": "string", "response_id": "string", "issue_thread_events": f"array<{EVENT}>",
}


def progression(text: Column, review_round: Column) -> Column:
    """array(struct(marker, event_type, effective_round, exact_text)): the marked segments of a text, else the whole of it.

    What stands before the first mark goes with the first segment unless it is a
    list's number; segments without text are left out.
    """
    t, turn = F.regexp_replace(K.blank(text), "^\\s+|\\s+$", ""), K.blank(review_round)
    event = lambda m, kind, r, body: F.struct(m.alias("marker"), kind.alias("event_type"), r.alias("effective_round"), body.alias("exact_text"))
    whole = F.array(event(F.lit(""), F.lit("government_comment"), turn, t))
    marks, parts = F.regexp_extract_all(t, F.lit(MARKER), F.lit(1)), F.split(t, MARKER)
    lead = F.regexp_replace(F.regexp_replace(F.get(parts, 0), "^\\s+|\\s+$", ""), "^(?:[A-Za-z]|[0-9]+)[.)]\\s*$", "")

    def one(mark: Column, i: Column) -> Column:
        body = F.regexp_replace(F.get(parts, i + 1), "^[ \\t\\r\\n\\-:;]+|[ \\t\\r\\n\\-:;]+$", "")
        body = F.when((i == 0) & (lead != ""), F.trim(F.concat_ws(" ", lead, body))).otherwise(body)
        numbers = F.transform(F.regexp_extract_all(mark, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
        kind = F.when(F.array_contains(numbers, 1), "government_comment").otherwise("reviewer_follow_up")
        return event(F.concat(F.lit("PC"), F.array_join(F.regexp_extract_all(mark, F.lit("[0-9]+"), F.lit(0)), "&PC")), kind, F.array_min(numbers).cast("string"), body)

    split = F.filter(F.transform(marks, one), lambda e: e["exact_text"] != "")
    return F.when(t == "", F.array().cast("array<struct<marker:string,event_type:string,effective_round:string,exact_text:string>>")).when(F.size(split) > 0, split).otherwise(whole)


def trusted(df: DataFrame) -> Column:
    """Any of the signs that a person or a check stands behind a record."""
    is_ = lambda c, *v: F.coalesce(F.col(c).isin(*v), F.lit(False))
    return is_("text_trust_status", "verified") | (K.blank(F.col("verified_text")) != "") | is_("source_status", "confirmed", "verified") | is_("verification_status", "confirmed") | is_("human_review_status", "confirmed")


def is_generic(normal: Column) -> Column:
    """Short answers that fit any issue."""
    return normal.isin(X.GENERIC_EVENTS) | (F.size(F.filter(F.split(normal, " "), lambda w: w != "")) <= 2)


def _described(df: DataFrame) -> DataFrame:
    """The records with site, discipline, number, the opening event's text (anchor) and whether they may form threads."""
    d = complete(df, **_COLUMNS)
    text = F.when(K.blank(F.col("verified_text")) != "", F.col("verified_text")).otherwise(K.blank(F.col("original_text")))
    d = d.withColumn("text", text).withColumn("segments", progression(F.col("text"), F.col("review_round")))
    site = K.thread_site(F.col("city"), F.col("project_id"), F.col("source_document"), F.col("property_project"))
    candidate = (F.trim("text") != "") & ~F.coalesce(F.col("duplicate_status") == "hierarchical_subpoint", F.lit(False)) & trusted(d)
    anchor = X.normalize_event_text(F.coalesce(F.get("segments", 0)["exact_text"], F.col("text")))
    turn = F.regexp_extract(K.blank(F.col("review_round")), "([0-9]+)", 1)
    return d.withColumns({"site": site, "field": K.discipline_key(F.col("discipline")), "number": X.fold(K.blank(F.col("comment_number"))), "anchor": anchor, "candidate": candidate, "thread": K.blank(F.col("issue_thread_id")), "turn": F.when(turn != "", turn.cast("int")).otherwise(10**9)})


def _stars(rows: DataFrame, *key: str) -> DataFrame:
    """Links of rows of equal key with the least of them."""
    least = rows.groupBy(*key).agg(F.min("comment_id").alias("left"), F.count("*").alias("n")).where("n > 1")
    return rows.join(least, list(key)).where(F.col("comment_id") != F.col("left")).select("left", F.col("comment_id").alias("right"))


def thread_links(rows: DataFrame, near: bool = True) -> DataFrame:
    """(left, right): links whose components are the threads; rows: comment_id, site, thread, anchor, field, number."""
    known = rows.where("thread <> ''")
    links = _stars(known, "site", "thread")
    said = rows.where("anchor <> ''")
    # unnamed disciplines go with all: with one such row an anchor's records are one, else those of a discipline are
    open_ = said.groupBy("site", "anchor").agg(F.max(F.col("field") == "").alias("open"))
    links = links.unionByName(_stars(said.join(open_, ["site", "anchor"]).withColumn("field", F.when(F.col("open"), "").otherwise(F.col("field"))), "site", "anchor", "field"))
    block = F.when(F.col("number") != "", F.concat(F.lit("number:"), F.col("number"))).otherwise(F.concat(F.lit("discipline:"), F.col("field")))
    blocked = said.where("site <> ''").withColumn("block", block)
    links = links.unionByName(_stars(blocked, "site", "block", "anchor"))
    if near:
        first = blocked.groupBy("site", "block", "anchor").agg(F.min("comment_id").alias("id")).withColumn("marks", F.array_join(X.parameter_tokens(F.col("anchor")), ",")).withColumn("size", F.length("anchor"))
        first = cut(first, "anchors")
        met = containing_pairs(first, ["site", "block", "marks"], F.split("anchor", " "), ANCHOR_WORDS, ANCHOR_LENGTH)
        links = links.unionByName(folded_pairs(first, met, "anchor", lambda x, y: S.sequence_ratio(x, y) >= ANCHOR_SEQUENCE))
    return links


def assign_threads(df: DataFrame, near: bool = True) -> DataFrame:
    """comment_id, issue_thread_id, issue_grouping_status, members of every record.

    Trusted records with a text form threads; a thread of two or more keeps its
    first record's id where that id belongs to one site, else gets one from
    site, discipline and opening text.  Other records join the one thread that
    an event of theirs with a date, or one that needs none, points to.  The rest
    keep what they had.
    """
    rows = cut(_described(df), "described")
    base = cut(rows.where("candidate").select("comment_id", "site", "field", "number", "anchor", "thread", "turn", "source_document"), "candidates")
    parts = connected_components(thread_links(base, near), "left", "right")
    grouped = base.join(parts, F.col("comment_id") == F.col("node"), "left").withColumn("group", F.coalesce("component", "comment_id"))
    first = F.min(F.struct("turn", K.blank(F.col("source_document")).alias("s"), "comment_id", "site", "field", "anchor", "thread")).alias("first")
    sites = F.count_distinct(F.when(F.col("thread") != "", F.col("site"))).alias("sites")
    groups = grouped.groupBy("group").agg(F.count("*").alias("members"), first, sites).where("members > 1")
    homes = base.where("thread <> ''").groupBy(F.col("thread").alias("own")).agg(F.count_distinct("site").alias("homes"))
    groups = groups.join(homes, F.col("first.thread") == F.col("own"), "left")
    made = F.concat(F.lit("T-"), F.substring(F.sha2(F.concat_ws("|", "first.site", "first.field", "first.anchor"), 256), 1, 20))
    named = groups.select("group", "members", F.when((F.col("first.thread") != "") & (F.col("sites") == 1) & (F.col("homes") == 1), F.col("first.thread")).otherwise(made).alias("made"))
    done = cut(grouped.join(named, "group", "left").select("comment_id", F.coalesce("made", "thread").alias("issue_thread_id"), F.when(F.col("made").isNotNull(), "cross_document_progression").alias("issue_grouping_status"), F.coalesce("members", F.lit(1)).alias("members")), "threads")
    rest = _aliases(rows, done)
    return done.unionByName(rest)


def _aliases(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Threads of records that form none themselves, by an event they share with just one."""
    others = rows.where("not candidate")
    events = raw_events(rows)
    strong = events.where("candidate").join(done.select("comment_id", F.col("issue_thread_id").alias("to")), "comment_id").where("to <> '' and date <> '' and not generic")
    owners = strong.select("site", "role", "normal", F.col("to"), F.col("date").alias("owner_date"), F.col("actor").alias("owner_actor")).distinct()
    asked = events.where("not candidate and not generic and normal <> ''").select("comment_id", "source_order", "site", "role", "normal", "date", "actor")
    fits = asked.join(owners, ["site", "role", "normal"]).where("(date = '' or date = owner_date) and (actor = '' or owner_actor = '' or actor = owner_actor)")
    each = fits.groupBy("comment_id", "source_order", "date").agg(F.count_distinct("to").alias("threads"), F.min("to").alias("to"), F.count_distinct("owner_date").alias("dates"))
    sure = each.where("threads = 1 and (date <> '' or dates = 1)")
    one = sure.groupBy("comment_id").agg(F.count_distinct("to").alias("n"), F.min("to").alias("to")).where("n = 1")
    joined = others.select("comment_id", "thread").join(one, "comment_id", "left")
    return joined.select("comment_id", F.coalesce("to", "thread").alias("issue_thread_id"), F.when(F.col("to").isNotNull(), "source_occurrence_alias").alias("issue_grouping_status"), F.lit(1).cast("long").alias("members"))


def raw_events(rows: DataFrame, thread: str = "thread") -> DataFrame:
    """One row per event a record shows: segments of its text, then the events it brings; ``rows`` as ``_described`` gives them."""
    text = lambda c: K.blank(c)
    turn = text(F.coalesce(F.col("document_round"), F.col("review_round")))
    given = F.filter(F.coalesce(F.col("issue_thread_events"), F.array().cast(f"array<{EVENT}>")), lambda e: F.trim(text(e["exact_text"])) != "")
    shape = lambda marker, kind, role, actor, occurred, labelled, dated, source, effective, printed, body, order, given_id: F.struct(
        marker.alias("marker"), kind.alias("event_type"), role.alias("actor_role"), actor.alias("actor_raw"), occurred.alias("occurred_at"), labelled.alias("occurred_label"), dated.alias("event_date"),
        source.alias("date_source"), effective.alias("effective_round"), printed.alias("printed"), body.alias("exact_text"), order.alias("source_order"), given_id.alias("given_id"),
    )
    none = F.lit("")
    own_date = F.when(text(F.col("event_date")) != "", F.col("event_date")).otherwise(text(F.col("event_date_iso")))
    segments = F.transform("segments", lambda e, i: shape(e["marker"], e["event_type"], F.lit("government"), text(F.col("reviewer")), none, none, own_date, text(F.col("event_date_source")), e["effective_round"], F.trim(text(F.col("comment_number"))), e["exact_text"], i + 1, none))
    brought = F.transform(given, lambda e, i: shape(text(e["event_round_marker"]), text(e["event_type"]), text(e["actor_role"]), text(e["actor"]), text(e["occurred_at"]), text(e["occurred_at_label"]), text(e["event_date"]), text(e["event_date_source"]), F.when(text(e["effective_round"]) != "", e["effective_round"]).otherwise(text(F.col("review_round"))), F.when(text(e["printed_comment_id"]) != "", e["printed_comment_id"]).otherwise(F.trim(text(F.col("comment_number")))), e["exact_text"], i + 1001, text(e["event_id"])))
    shown = rows.withColumn("__events", F.concat(segments, brought)).withColumns({"__thread": F.col(thread), "__turn": turn})
    flat = shown.select(F.col("__thread").alias("thread"), "comment_id", "candidate", "site", text(F.col("source_document")).alias("source_document"), F.col("__turn").alias("review_round"), "text_trust_status", "human_review_status", text(F.col("response_id")).alias("response_id"), F.explode("__events").alias("e")).select("thread", "comment_id", "candidate", "site", "source_document", "review_round", "text_trust_status", "human_review_status", "response_id", "e.*")
    date = D.event_date_key([F.col("occurred_at"), F.col("occurred_label")], [F.col("event_date")], F.col("date_source"))
    marker = F.when(F.trim("marker") != "", K.marker(F.col("marker"))).otherwise("")
    effective = F.when(marker != "", marker).otherwise(K.marker(F.coalesce(F.when(F.col("effective_round") != "", F.col("effective_round")), F.col("review_round"))))
    role = X.role_family(F.col("actor_role"), F.col("event_type"))
    kind = X.normalize_event_type(F.col("event_type"))
    kind = F.when((kind == "unknown") & (role == "company"), "applicant_response").when((kind == "unknown") & (role == "government"), "government_comment").otherwise(kind)
    out = flat.withColumns({"date": date, "marker": marker, "round": effective, "role": role, "kind": kind, "actor": X.fold(F.col("actor_raw")), "normal": X.normalize_event_text("exact_text")})
    return out.withColumn("generic", is_generic(F.col("normal")))


def event_identity(kind: Column, role: Column, date: Column, marker: Column, round_: Column, actor: Column, printed: Column, normal: Column) -> Column:
    """What makes two events one within a thread: ``type|occurrence|text``, else null where nothing tells when it was."""
    by = F.when(actor != "", F.concat(F.lit("|actor:"), actor)).otherwise("")
    known = X.normalize_event_text(printed)
    dated = (date != "") & ((role == "company") | (kind == "reviewer_follow_up") | ((role == "government") & (printed == "")))
    marked = F.concat(F.lit("round:"), marker, F.when(dated, F.concat(F.lit("|date:"), date)).otherwise(""), by)
    turned = F.concat(F.lit("round:"), round_, by, F.when(printed != "", F.concat(F.lit("|printed_id:"), known)).otherwise(""))
    when = F.when(marker != "", marked).when(date != "", F.concat(F.lit("date:"), date, by)).when(round_ != "", turned).when(printed != "", F.concat(F.lit("printed_id:"), known))
    return F.when((normal != "") & when.isNotNull(), F.concat(kind, F.lit("|"), when, F.lit("|"), normal))


def _digits(tokens: list[str]) -> frozenset:
    return frozenset(t for t in tokens if re.search("[0-9]", t))


class _Merger:
    """Distinct events of one thread, merged in order."""

    def __init__(self):
        self.events: list[dict] = []
        self.near, self.opening, self.same = defaultdict(list), defaultdict(list), defaultdict(list)

    @staticmethod
    def _prepare(e: dict) -> dict:
        tokens = e["normal"].split()
        e["tokens"], e["digits"], e["no"] = tokens, _digits(tokens), frozenset(tokens) & frozenset(X.NEGATIONS)
        e["going"] = any(p in e["normal"] for p in X.PROGRESSION)
        e["contexts"] = {("date", e["date"])} if e["date"] else set()
        if e["marker"] or e["round"]:
            e["contexts"].add(("round", e["marker"] or e["round"]))
        e["identities"] = {e["identity"]} if e["identity"] else set()
        return e

    def decide(self, a: dict, b: dict) -> str:
        """How event b goes with canonical event a: EXACT, HIGH, POSSIBLE, REISSUE or DISTINCT."""
        if a["role"] != b["role"] or (a["kind"] != b["kind"] and a["role"] != "government") or (a["actor"] and b["actor"] and a["actor"] != b["actor"]) or (a["date"] and b["date"] and a["date"] != b["date"]):
            return "DISTINCT"
        left, right = a["marker"] or a["round"], b["marker"] or b["round"]
        if left and right and left != right and not (a["date"] and a["date"] == b["date"]):
            return "REISSUE"
        equal = a["normal"] == b["normal"]
        if not a["date"] and not b["date"] and not (left and left == right) and not (equal and not a["generic"]):
            return "DISTINCT"
        if equal:
            return "POSSIBLE" if a["generic"] and not a["parents"] & b["parents"] else "EXACT"
        dated = a["date"] or b["date"]
        found = self._match(a, b)
        if found == "HIGH" and dated:
            return "POSSIBLE" if a["generic"] or b["generic"] else "HIGH"
        if dated and self._extends(a, b):
            return "HIGH"
        return found if found in ("POSSIBLE", "REISSUE") else "DISTINCT"

    @staticmethod
    def _match(a: dict, b: dict) -> str:
        if a["digits"] != b["digits"] or a["no"] != b["no"]:
            return "DISTINCT"
        if a["going"] != b["going"]:
            return "REISSUE"
        m = SequenceMatcher(None, a["normal"], b["normal"])
        if m.real_quick_ratio() < S.POSSIBLE or m.quick_ratio() < S.POSSIBLE or (ratio := m.ratio()) < S.POSSIBLE:
            return "DISTINCT"
        x, y = (Counter(re.findall("[a-z0-9]+", e["normal"])) for e in (a, b))
        nx, ny, shared = x.total(), y.total(), (x & y).total()
        small, large = sorted((nx, ny))
        high = small and ratio >= S.SEQUENCE and shared >= S.CONTAINMENT * small and shared >= S.JACCARD * (x | y).total() and small >= S.LENGTH_RATIO * large
        return "HIGH" if high else "POSSIBLE"

    @staticmethod
    def _extends(a: dict, b: dict) -> bool:
        short, long = sorted((a, b), key=lambda e: len(e["tokens"]))
        n = len(short["tokens"])
        if not n or n == len(long["tokens"]) or long["tokens"][:n] != short["tokens"] or not short["digits"] <= long["digits"] or not short["no"] <= long["no"]:
            return False
        return not set(S.ENRICHMENT).isdisjoint(long["tokens"][n:]) and SequenceMatcher(None, short["normal"], long["normal"]).ratio() >= 0.65

    def _candidates(self, e: dict) -> list[int]:
        """Canonical events that may be e: equal text, equal numbers and negations, or equal opening word; of a context in common, or with none."""
        at = {*self.same[e["role"], e["normal"]], *self.near[e["role"], e["digits"], e["no"]], *self.opening[e["role"], e["tokens"][0] if e["tokens"] else ""]}
        fits = lambda c: not c["contexts"] or not e["contexts"] or c["contexts"] & e["contexts"] or c["identities"] & e["identities"]
        return [i for i in sorted(at) if fits(self.events[i])]

    def _file(self, i: int, e: dict) -> None:
        for table_, key in ((self.same, (e["role"], e["normal"])), (self.near, (e["role"], e["digits"], e["no"])), (self.opening, (e["role"], e["tokens"][0] if e["tokens"] else ""))):
            if i not in table_[key]:
                table_[key].append(i)

    @staticmethod
    def _quality(e: dict) -> tuple:
        numbers = [int(x) for x in re.findall("[0-9]+", e["marker"])]
        seen = re.search("[0-9]+", e["review_round"])
        turn = int(seen.group()) if seen else 10**9
        first = min(numbers) if numbers else turn
        return (0 if e["trusted"] else 1, 0 if e["date"] else 1, 0 if e["actor"] else 1, 0 if turn == first else 1, 1 if e["exact_text"].lstrip().casefold().startswith(("markup ", "comment ")) else 0, -len(e["normal"]), e["source_document"])

    def add(self, raw: dict) -> None:
        e = self._prepare(raw)
        fits = [(i, d) for i in self._candidates(e) if (d := self.decide(self.events[i], e)) in ("EXACT", "HIGH")]
        dates = {self.events[i]["date"] for i, _ in fits if self.events[i]["date"]}
        if not fits or (not e["contexts"] and len(dates) > 1):
            e["decision"] = "POSSIBLE_DUPLICATE" if fits else "DISTINCT"
            self.events.append(e)
            self._file(len(self.events) - 1, e)
            return
        i, decision = fits[0]
        a = self.events[i]
        keep, other = (e, a) if self._quality(e) < self._quality(a) else (a, e)
        merged = dict(keep)
        for field in ("actor", "date", "marker", "round", "printed", "effective_round"):
            merged[field] = keep[field] or other[field]
        for field in ("contexts", "identities", "parents", "ids", "places", "kinds", "rounds"):
            merged[field] = a[field] | e[field]
        merged["copies"] = a["copies"] + e["copies"]
        merged["source_order"] = min(a["source_order"], e["source_order"]) if keep is a else e["source_order"]
        merged["decision"] = {"EXACT": "EXACT_DUPLICATE", "HIGH": "HIGH_CONFIDENCE_DUPLICATE"}[decision]
        self.events[i] = merged
        self._file(i, merged)

    def possible(self) -> list[tuple[int, int, float]]:
        """Pairs of canonical events that a person should look at."""
        out = []
        for j, e in enumerate(self.events):
            for i in self._candidates(e):
                if i < j and self.decide(self.events[i], e) == "POSSIBLE":
                    out.append((i, j, round(SequenceMatcher(None, self.events[i]["normal"], e["normal"]).ratio(), 4)))
        return out


EVENTS = "thread string, event_id string, place int, kind string, role string, actor string, date string, round string, marker string, normal string, exact_text string, occurrences long, places int, merged_ids array<string>, rounds array<string>, decision string, review_with array<string>, similarity array<double>"


def _merge_thread(frame: pd.DataFrame) -> pd.DataFrame:
    rows = frame.to_dict("records")
    for r in rows:
        r["contextless"] = not r["date"] and not (r["marker"] or r["round"])
        r["parents"], r["ids"], r["kinds"] = frozenset(r["parents"]), frozenset(r["ids"]), frozenset([r["kind"]])
        r["places"], r["rounds"] = frozenset(r["places"]), frozenset(x for x in r["rounds"] if x)
        r["identity"] = r["identity"] if isinstance(r["identity"], str) else ""
    merger = _Merger()
    for r in sorted(rows, key=lambda r: (r["contextless"], r["source_document"], r["source_order"], r["normal"])):
        merger.add(r)
    order = sorted(range(len(merger.events)), key=lambda i: _event_order(merger.events[i]))
    names = {}
    for place, i in enumerate(order):
        names[i] = _event_name(merger.events[i], place)
    looks = defaultdict(list)
    for i, j, ratio in merger.possible():
        looks[i].append((names[j], ratio))
        looks[j].append((names[i], ratio))
    out = []
    for place, i in enumerate(order):
        e, also = merger.events[i], sorted(looks[i])
        out.append((e["thread"], names[i], place, e["kind"], e["role"], e["actor"], e["date"], e["marker"] or e["round"], e["marker"], e["normal"], e["exact_text"], e["copies"], len(e["places"]), sorted(e["ids"]), sorted(e["rounds"]), "POSSIBLE_DUPLICATE" if also else e["decision"] if e["decision"] != "DISTINCT" or e["copies"] == 1 else "EXACT_DUPLICATE", [a for a, _ in also], [b for _, b in also]))
    return pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])


def _event_order(e: dict) -> tuple:
    numbers = [int(x) for x in re.findall("[0-9]+", e["marker"])]
    if numbers:
        return 0, min(numbers), e["date"], e["source_order"], e["normal"]
    if e["date"]:
        return 1, 0, e["date"], e["source_order"], e["normal"]
    turn = re.search("[0-9]+", e["review_round"])
    return 2, int(turn.group()) if turn else 10**9, "", e["source_order"], e["normal"]


def _event_name(e: dict, place: int) -> str:
    key = min(e["identities"]) if e["identities"] else f"{e['kind']}|undated|{min(e['places'], default='')}|{e['source_order'] or place}|{e['normal']}"
    if e["generic"]:
        key += "|parent:" + ",".join(sorted(e["parents"]))
    return "E-" + hashlib.sha256(f"{e['thread']}|{key}".encode()).hexdigest()[:20]


def thread_events(events: DataFrame) -> DataFrame:
    """The canonical events of each thread, in order, from ``raw_events`` with their thread: see EVENTS.

    Equal events (all that decides on them) are one before a thread's task sees
    them.  An event without date and round never chooses among several dates.
    ``review_with`` names the events that a person should compare it with.
    """
    parents = F.filter(F.array(F.col("response_id"), F.lower(F.col("printed"))), lambda x: x != "")
    told = events.where("normal <> ''").withColumn("identity", event_identity(F.col("kind"), F.col("role"), F.col("date"), F.col("marker"), F.col("round"), F.col("actor"), F.col("printed"), F.col("normal")))
    sure = F.coalesce(F.lower("text_trust_status").isin("verified", "confirmed"), F.lit(False)) | F.coalesce(F.lower("human_review_status") == "confirmed", F.lit(False))
    raw_id = F.when(F.col("given_id") != "", F.col("given_id")).otherwise(I.stable_id("E", F.col("thread"), F.lit("progression"), F.when(F.col("marker") != "", F.col("marker")).otherwise(F.concat(F.lit("round:"), "effective_round")), F.col("normal")))
    place = F.concat_ws("|", "source_document", "comment_id")
    # parents only matter for short answers, so longer texts are summed over them; a short one without any stands alone
    told = told.withColumn("own", F.when(~F.col("generic"), "").when(F.size(parents) > 0, F.array_join(F.array_sort(parents), ",")).otherwise(F.concat_ws("#", F.lit(""), "comment_id", "source_order"))).withColumn("first", F.struct("source_document", "source_order", "exact_text"))
    by = ["thread", "kind", "role", "actor", "date", "marker", "round", "effective_round", "printed", "normal", "generic", "identity", "review_round", "own"]
    summed = told.groupBy(*by).agg(
        F.count("*").cast("long").alias("copies"), F.min("first").alias("first"), F.max(sure).alias("trusted"),
        F.array_sort(F.collect_set(raw_id)).alias("ids"), F.array_sort(F.collect_set(place)).alias("places"), F.array_sort(F.collect_set("review_round")).alias("rounds"), F.array_sort(F.flatten(F.collect_set(parents))).alias("parents"),
    )
    summed = summed.select(*by[:-1], "copies", "trusted", "ids", "places", "rounds", "parents", "first.*")
    return summed.groupBy("thread").applyInPandas(_merge_thread, EVENTS)


def review_queue(events: DataFrame) -> DataFrame:
    """Pairs of canonical events for a person to compare, by thread and ids."""
    pairs = events.where(F.size("review_with") > 0).select(F.col("thread").alias("issue_thread_id"), F.col("event_id").alias("left_event_id"), F.explode(F.arrays_zip("review_with", "similarity")).alias("r"))
    return pairs.select("issue_thread_id", "left_event_id", F.col("r.review_with").alias("right_event_id"), F.col("r.similarity").alias("similarity")).where("left_event_id < right_event_id").orderBy("issue_thread_id", "left_event_id", "right_event_id")


def index_threads(df: DataFrame, near: bool = True) -> DataFrame:
    """Threads and their events in one go: canonical events of all records that have a text or bring events."""
    named = assign_threads(df, near).select("comment_id", F.col("issue_thread_id").alias("__to"))
    joined = df.join(named, "comment_id").withColumn("issue_thread_id", F.when(F.col("__to") != "", F.col("__to")).otherwise(F.col("comment_id").cast("string"))).drop("__to")
    return thread_events(raw_events(_described(joined)))


def _chats(s, d) -> DataFrame:
    """Conversations as records that bring one event each."""
    c = table(s, d, "conversations")
    fields = {"event_id": F.lit(""), "event_type": F.lit("note"), "actor_role": F.when(F.col("role") == "user", "reviewer").otherwise("applicant"), "actor": F.lit(""), "occurred_at": F.lit(""), "occurred_at_label": F.lit(""), "event_date": F.lit(""), "event_date_source": F.lit(""), "event_round_marker": F.lit(""), "effective_round": F.lit("1"), "printed_comment_id": F.lit(""), "exact_text": F.col("text")}
    event = F.struct(*[v.alias(k) for k, v in fields.items()]).cast(EVENT)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("comment_id"), F.col("conv_id").cast("string").alias("issue_thread_id"), F.lit("a").alias("city"), F.lit("p").alias("project_id"), F.lit("").alias("original_text"), F.lit("chat").alias("source_document"), F.array(event).alias("issue_thread_events"))


_THREADS = f"""
cand AS (SELECT comment_id, city || '|folder:' || city AS site, discipline AS field, comment_number AS number, {normal_sql('original_text')} AS anchor, review_round, source_document FROM comments
  WHERE (text_trust_status = 'verified' OR human_review_status = 'confirmed') AND duplicate_status IS NULL AND trim(original_text) <> ''),
linked AS (SELECT a.comment_id AS x, b.comment_id AS y FROM cand a JOIN cand b ON a.site = b.site AND a.anchor = b.anchor AND a.anchor <> '' AND (a.field = b.field OR a.number = b.number)),
reach AS (SELECT x, min(y) AS c FROM (SELECT a.x, d.y FROM linked a JOIN linked b ON a.y = b.x JOIN linked d ON b.y = d.x UNION SELECT comment_id, comment_id FROM cand) GROUP BY x),
grp AS (SELECT k.*, r.c, count(*) OVER (PARTITION BY r.c) AS members,
  first_value(k.site || '|' || k.field || '|' || k.anchor) OVER (PARTITION BY r.c ORDER BY review_round, source_document, comment_id) AS head FROM cand k JOIN reach r ON r.x = k.comment_id)
"""

QUERIES = {
    "issue_threads": (
        lambda s, d: assign_threads(comments(s, d), near=False).select("comment_id", "issue_thread_id", "members"),
        sql_over(COMMENTS, "SELECT c.comment_id, coalesce(CASE WHEN g.members > 1 THEN 'T-' || substr(sha256(g.head), 1, 20) END, '') AS issue_thread_id, coalesce(g.members, 1) AS members FROM comments c LEFT JOIN grp g ON g.comment_id = c.comment_id", _THREADS),
    ),
    "near_threads": (lambda s, d: assign_threads(comments(s, d)).groupBy("issue_grouping_status").agg(F.count("*").alias("records"), F.countDistinct("issue_thread_id").alias("threads")), None),
    "raw_events": (
        lambda s, d: raw_events(_described(comments(s, d))).select("comment_id", "source_order", "role", "kind", "date", "round", "generic", event_identity(F.col("kind"), F.col("role"), F.col("date"), F.col("marker"), F.col("round"), F.col("actor"), F.col("printed"), F.col("normal")).alias("i")).withColumn("identity", F.sha2("i", 256)).drop("i"),
        sql_over(
            COMMENTS,
            "SELECT comment_id, 1 AS source_order, 'government' AS role, 'government_comment' AS kind, '' AS date, 'PC' || regexp_extract(review_round, '[0-9]+') AS round, len(list_filter(string_split(normal, ' '), lambda x: x <> '')) <= 2 AS generic, "
            "CASE WHEN normal <> '' THEN sha256('government_comment|round:PC' || regexp_extract(review_round, '[0-9]+') || CASE WHEN reviewer IS NULL THEN '' ELSE '|actor:' || lower(reviewer) END || '|printed_id:' || comment_number || '|' || normal) END AS identity FROM n",
            f"n AS (SELECT *, {normal_sql('original_text')} AS normal FROM comments WHERE trim(original_text) <> '')",
        ),
    ),
    "thread_events": (
        lambda s, d: thread_events(raw_events(_described(_chats(s, d)))).groupBy("thread").agg(F.count("*").alias("events"), F.sum("occurrences").alias("occurrences")),
        # of texts as different as these conversations hold, only equal ones of a role are one event
        f"SELECT CAST(conv_id AS VARCHAR) AS thread, count(DISTINCT role || normal) FILTER (NOT short) + count(*) FILTER (short) AS events, CAST(count(*) AS BIGINT) AS occurrences FROM (SELECT conv_id, role, normal, len(string_split(normal, ' ')) <= 2 AS short FROM (SELECT conv_id, CASE WHEN role = 'user' THEN 'u' ELSE 'a' END AS role, {normal_sql('text')} AS normal FROM conversations) WHERE normal <> '') GROUP BY conv_id",
    ),
    "event_review_queue": (lambda s, d: review_queue(thread_events(raw_events(_described(_chats(s, d))))), None),
}
