"""Topics of questions, and whether a record is evidence for one: controlled words and patterns, no model."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions import keys as K
from marginalia.functions import taxonomy as C
from marginalia.functions import text as X

# Tags a topic contains or is related to, and how much a related one counts.
TAG_GRAPH = {
    "fire_separation": ["rated_wall", "rated_assembly", "opening_protection", "exterior_wall_rating", "garage_separation", "dwelling_unit_separation", "floor_ceiling_assembly", "penetration_protection", "eave_projection"],
    "tree_protection": ["root_protection", "arborist_documentation", "tree_impact_mitigation", "tree_removal", "heritage_tree"],
    "tree_related": ["tree_protection", "root_protection", "arborist_documentation", "tree_impact_mitigation", "tree_removal", "heritage_tree"],
    "drainage": ["stormwater", "runoff", "grading", "infiltration", "downspout"],
    "structural_calculations": ["framing", "shear", "foundation", "load_path", "connection_detail"],
    "door_size": ["clear_width", "door_opening", "egress_clearance"],
    "door_rating": ["rated_door", "door_assembly", "opening_protection"],
}
RELATED_TOPICS = ["tree_related", "drainage"]
CONTAINS_WEIGHT, RELATED_WEIGHT = 0.9, 0.75
# Words that a record of a topic has.
TAG_ALIASES = {
    "fire_separation": ["fire separation", "fire-rated separation", "fire resistance", "fire resistant", "fire rated", "rated wall", "one-hour wall", "1-hour wall", "property line wall", "opening protection", "protected opening", "exterior wall rating", "eave projection", "garage separation", "dwelling unit separation", "rated assembly", "penetration protection", "fire", "rated", "rating", "separation", "gypsum", "r302", "ul", "sprinkler"],
    "tree_protection": ["tree protection", "tree", "trees", "arborist", "root zone", "root protection", "heritage tree", "tree impact", "preservation", "tree removal"],
    "tree_related": ["tree", "trees", "arborist", "arborist report", "root zone", "root protection", "heritage tree", "tree impact", "preservation", "tree removal", "tree inventory", "tree location", "canopy"],
    "drainage": ["drainage", "drain", "runoff", "stormwater", "swale", "infiltration", "detention", "downspout", "discharge", "grading"],
    "structural_calculations": ["structural", "calculation", "calculations", "framing", "beam", "joist", "shear", "foundation", "load", "hanger", "ledger"],
    "door_size": ["door size", "door width", "door height", "door dimension", "clear width", "door opening", "egress clearance"],
    "door_rating": ["door rating", "rated door", "fire-rated door", "door assembly", "door label"],
}
EVENT_ALIASES = {"opening protection": "opening_protection", "protected opening": "opening_protection", "rated wall": "rated_wall", "rated assembly": "rated_assembly", "eave": "eave_projection", "root protection": "root_protection", "tree impact": "tree_impact_mitigation", "clear width": "clear_width"}
# Phrases and patterns by which a question names a tag or topic, first match wins.
EVENT_PHRASES = {
    "opening protection": "opening_protection", "protected opening": "opening_protection", "rated wall": "rated_wall", "rated assembly": "rated_assembly", "eave projection": "eave_projection", "garage separation": "garage_separation",
    "dwelling unit separation": "dwelling_unit_separation", "floor ceiling": "floor_ceiling_assembly", "penetration protection": "penetration_protection", "root protection": "root_protection", "tree impact": "tree_impact_mitigation",
    "arborist documentation": "arborist_documentation", "clear width": "clear_width",
}
TREE_QUESTION, TREE_CARE = r"\b(?:tree|trees|arborist|heritage tree)\b", r"\b(?:protect|protection|impact|root|preserv)\w*\b"
QUESTION_TOPICS = [
    ("drainage", [r"\b(?:drainage|stormwater|runoff|swale|infiltration)\b"]), ("door_size", [r"\bdoor\b", r"\b(?:size|width|height|dimension|clear)\b"]),
    ("door_rating", [r"\bdoor\b", r"\b(?:rating|rated|assembly|label)\b"]), ("structural_calculations", [r"\b(?:structural|framing|beam|joist|foundation|shear|calculation)\b"]),
]
FIRE_QUESTION = r"\bfire\b.*\bseparation\b|\bfire[- ]?(?:rated|resistance)\b|\brated wall\b"
FIRE_CONCEPT = r"\b(?:fire[- ]?(?:separation|rated|rating|resistance)|(?:one|1)[- ]hour(?:[- ]rated)?|rated\s+(?:wall|assembly|opening|door|floor|ceiling)|(?:opening|penetration)\s+protection|property[- ]line\s+wall|(?:crc|r302|ul)\s*[a-z0-9.-]*)\b"
# Patterns by which a record gets event tags.
TREE_EVENTS = {"tree_impact_mitigation": r"\b(?:root|fenc|mulch|protect|impact|excavat|prun|preserv)\w*\b", "arborist_documentation": r"\barborist\b|\breport\b|\bmonitor\w*\b", "tree_removal": r"\bremov\w*\b"}
FIRE_EVENTS = {
    "rated_wall": r"\b(?:rated wall|one[- ]hour wall|1[- ]hour wall)\b", "rated_assembly": r"\brated assembly\b|\bassembly\b", "opening_protection": r"\b(?:opening protection|protected opening|opening)\b", "exterior_wall_rating": r"\bexterior wall\b",
    "garage_separation": r"\bgarage\b", "dwelling_unit_separation": r"\b(?:dwelling unit|adu|main dwelling)\b", "floor_ceiling_assembly": r"\bfloor[/ -]?ceiling\b", "penetration_protection": r"\bpenetration\b|\bpenetrations\b", "eave_projection": r"\beave\b|\bprojection\b",
}
DOOR_EVENTS = {"door_size": r"\b(?:door|opening)s?\b[^.\n]{0,80}\b(?:width|height|dimension|size|clear)\b", "door_rating": r"\b(?:fire[- ]?rated|rated|rating|assembly|label)\b[^.\n]{0,60}\bdoors?\b"}
# What is evidence in an answer.
FIRE_PHRASES = ["fire separation", "fire resistance rated", "fire rated wall", "one hour wall", "1 hour wall", "property line wall", "opening protection", "protected opening", "exterior wall rating", "eave projection", "garage separation", "dwelling unit separation", "rated assembly", "penetration protection"]
FIRE_STRONG = ["fire", "rated", "rating", "separation", "r302", "one-hour", "1-hour"]
WATER = ["detention", "discharge", "downspout", "drain", "drainage", "infiltration", "runoff", "stormwater", "swale"]
TREE_MEASURES = [
    r"\btree protection\b", r"\bprotection (?:measure|zone|fenc|plan)", r"\b(?:fenc|mulch|plywood|trunk protection|soil compaction protection)\w*\b", r"\broot (?:prun|protection|impact|zone)",
    r"\b(?:tree|arborist)\b[^.\n]{0,100}\b(?:impact mitigation|monitoring inspection|protect(?:ion|ed|ing)?)\b", r"\b(?:heritage|protected) trees?\b[^.\n]{0,120}\b(?:impact|proximity|mitigat|protect)", r"\bproject arborist\b[^.\n]{0,100}\b(?:verify|monitor|inspection|root pruning|excavation)",
]
TREE_ANY = ["tree", "trees", "arborist", "root", "canopy", "heritage", "removal", "preservation", "inventory"]
MEASURE = r"\d+(?:\.\d+)?\s*(?:inches?|\"|feet|ft|')"
DOOR_SIZE = rf"(?:\bdoors?\s+(?:size|width|height|dimension|opening\s+width|clear(?:ance)?\s+width)\b)|(?:\b(?:size|width|height|dimension|clear(?:ance)?\s+width)\s+(?:of|for)\s+(?:the\s+)?doors?\b)|(?:\b(?:doors?|openings?)\b[^.\n]{{0,70}}\b{MEASURE}\s*(?:wide|high|width|height)\b)|(?:\b{MEASURE}\s+(?:wide|high)\s+doors?\b)"
DOOR_RATING = r"(?:\b(?:fire[- ]?rated|rated|rating)\s+doors?\b)|(?:\bdoors?\s+(?:rating|label|assembly|fire[- ]?rating)\b)|(?:\b(?:doors?|openings?)\b[^.\n]{0,70}\b(?:fire[- ]?rating|rated\s+assembly|label)\b)"


def topic_from_query(query: str) -> str | None:
    """The tag or topic a question names."""
    low = (query or "").casefold().replace("-", " ")
    for phrase, tag in EVENT_PHRASES.items():
        if phrase in low:
            return tag
    if re.search(FIRE_QUESTION, low):
        return "fire_separation"
    if re.search(TREE_QUESTION, low):
        return "tree_protection" if re.search(TREE_CARE, low) else "tree_related"
    return next((topic for topic, patterns in QUESTION_TOPICS if all(re.search(p, low) for p in patterns)), None)


def controlled_topic(subject: str) -> str | None:
    """The topic whose evidence is checked by rules, if the subject names one."""
    low = (subject or "").casefold().replace("-", " ")
    words = set(low.split())
    if any(p in low for p in ("fire separation", "fire rated", "fire rating", "fire resistance", "fire wall")) or (words & {"fire", "rated", "separation", "eave", "garage"} and ("fire" in low or "separation" in low)):
        return "fire_separation"
    if words & {"drainage", "drain", "runoff", "stormwater", "grading"}:
        return "drainage"
    if words & {"tree", "trees", "arborist", "heritage"}:
        return "tree_protection" if re.search(TREE_CARE, low) else "tree_related"
    if not re.search(r"\bdoors?\b", low):
        return None
    size, rating = re.search(r"\b(?:size|width|height|dimension|clear(?:ance)?\s+width|narrow)\b", low), re.search(r"\b(?:rating|rated|fire[- ]?rated|assembly|label)\b", low)
    return "door_attributes" if size and rating else "door_size" if size else "door_rating" if rating else None


def _any(c: Column, words: list[str]) -> Column:
    return c.rlike("\\b(?:" + "|".join(map(re.escape, words)) + ")\\b")


def door_signals(c: Column) -> Column:
    """struct(size, rating): a door's measure or rating is named, not the door alone."""
    t = F.lower(F.translate(K.blank(c), "–—", "--"))
    return F.struct(t.rlike(DOOR_SIZE).alias("size"), t.rlike(DOOR_RATING).alias("rating"))


def _judged(relevant: Column, matched: Column, sure: Column, text: Column, reason: str, topic: Column) -> Column:
    excerpt = F.substring(X.collapse(K.blank(text)), 1, 280)
    return F.struct(relevant.alias("is_relevant"), F.when(relevant, matched).otherwise("").alias("matched_concept"), F.when(relevant, sure).otherwise(0.0).alias("confidence"), excerpt.alias("supporting_excerpt"), F.when(relevant, "").otherwise(F.lit(reason)).alias("exclude_reason"), topic.alias("record_topic"))


def local_relevance(subject: str, text: Column, discipline: Column) -> Column:
    """Whether a record's own text is evidence for a subject: struct(is_relevant, matched_concept, confidence, supporting_excerpt, exclude_reason, record_topic)."""
    topic, low = controlled_topic(subject), F.lower(K.blank(text))
    plain, field = F.replace(low, F.lit("-"), F.lit(" ")), F.when(K.blank(discipline) == "", "unknown").otherwise(discipline)
    count = lambda c, words: sum((_any(c, [w]).cast("int") for w in words), F.lit(0))
    if topic == "fire_separation":
        phrases = F.filter(F.array(*map(F.lit, FIRE_PHRASES)), lambda p: F.contains(plain, p))
        tokens = count(low, FIRE_STRONG)
        asked = "setback" in subject.casefold() and "fire separation" in subject.casefold().replace("-", " ")
        setback = low.rlike("\\bsetback\\b") & F.lit(asked)
        wet = low.rlike("grading|drainage|stormwater|runoff") & ~low.rlike("fire|rated|rating|separation|r302")
        relevant = ((F.size(phrases) > 0) | (tokens > 0) | setback) & ~wet
        first = F.coalesce(*[F.when(_any(low, [w]), w) for w in FIRE_STRONG], F.lit("setback"))
        sure = F.when((F.size(phrases) > 0) | (tokens >= 2), 0.96).when(tokens > 0, 0.82).otherwise(0.0)
        return _judged(relevant, F.coalesce(F.get(phrases, 0), first), sure, text, "Evidence does not concern fire separation.", F.when(wet, "grading and drainage permit").otherwise(field))
    if topic == "drainage":
        n = count(low, WATER)
        return _judged(n > 0, F.coalesce(*[F.when(_any(low, [w]), w) for w in WATER]), F.when(n >= 2, 0.9).otherwise(0.8), text, "Evidence may concern grading, but it does not explicitly concern drainage.", F.when((n == 0) & _any(low, ["grading", "slope"]), "grading without explicit drainage evidence").otherwise(field))
    if topic == "tree_protection":
        n = sum((plain.rlike(p).cast("int") for p in TREE_MEASURES), F.lit(0))
        return _judged(n > 0, F.lit("tree protection measures"), F.when(n >= 2, 0.96).otherwise(0.88), text, "Evidence concerns tree inventory, location, or removal, but not tree-protection measures.", F.when((n == 0) & _any(low, ["tree", "trees", "arborist", "removal"]), "tree inventory, location, or removal").otherwise(field))
    if topic == "tree_related":
        n = count(low, TREE_ANY)
        return _judged(n > 0, F.lit("tree-related review requirement"), F.when(n >= 2, 0.94).otherwise(0.86), text, "Evidence does not concern a tree-related review requirement.", field)
    if topic:
        found = door_signals(text)
        relevant = {"door_size": found["size"], "door_rating": found["rating"], "door_attributes": found["size"] | found["rating"]}[topic]
        matched = F.when(found["size"] & F.lit(topic != "door_rating"), "door size/dimension").otherwise("door rating/assembly")
        label = {"door_size": "door size", "door_rating": "door rating", "door_attributes": "door size or rating"}[topic]
        return _judged(relevant, matched, F.when(found["size"] & found["rating"] & F.lit(topic == "door_attributes"), 0.94).otherwise(0.9), text, f"Evidence mentions doors but does not contain an explicit {label} requirement.", field)
    wanted, have = K.topic_terms(F.lit(subject)), F.transform(F.regexp_extract_all(F.lower(F.concat_ws(" ", K.blank(text), K.blank(discipline))), F.lit("[a-z0-9]+(?:-[a-z0-9]+)?"), F.lit(0)), X.term_root)
    own = F.array_intersect(wanted, K.significant_terms(K.blank(text)))
    return _judged((F.size(wanted) == 0) | F.arrays_overlap(wanted, have), F.coalesce(F.get(own, 0), F.lit("")), F.lit(0.8), text, "Evidence has no observable connection to the requested topic.", field)


def topic_relevance(query: str, text: Column, topic: str | None = None) -> Column:
    """The hard gate of staged retrieval: struct(is_relevant, matched_concept, confidence, supporting_excerpt, exclude_reason)."""
    topic, low = topic or topic_from_query(query), F.replace(F.lower(K.blank(text)), F.lit("-"), F.lit(" "))
    shape = lambda ok, word, sure, why: F.struct(ok.alias("is_relevant"), word.alias("matched_concept"), sure.alias("confidence"), F.substring(K.blank(text), 1, 280).alias("supporting_excerpt"), F.when(ok, "").otherwise(F.lit(why)).alias("exclude_reason"))
    tokens = "[a-z0-9]+(?:[-/][a-z0-9]+)?"
    if not topic:
        asked = sorted(set(re.findall(tokens, query.casefold())) - {"comment", "comments", "history", "handled", "across", "projects"})
        met = F.array_intersect(F.array(*map(F.lit, asked)) if asked else F.array().cast("array<string>"), F.regexp_extract_all(low, F.lit(tokens), F.lit(0)))
        ok = F.lit(True) if not asked else F.size(met) > 0
        return shape(ok, F.coalesce(F.get(met, 0), F.lit("")), F.when(ok, 0.8).otherwise(0.0), "Evidence has no observable connection to the requested topic.")
    words = sorted(TAG_ALIASES.get(topic) or {topic.replace("_", " ")} | {a for a, t in EVENT_ALIASES.items() if t == topic})
    hits = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    n = F.size(hits)
    if topic == "fire_separation":
        n = F.when(low.rlike(FIRE_CONCEPT), n).otherwise(0)
    return shape(n > 0, F.when(n > 0, F.get(hits, 0)).otherwise(""), F.when(n >= 2, 0.96).when(n > 0, 0.86).otherwise(0.0), "Evidence does not concern the requested topic.")


def infer_tags(text: Column, discipline: Column, event_tags: Column, issue_tags: Column, event_status: Column, issue_status: Column, tag_status: Column) -> Column:
    """struct(event_tags, issue_tags), sorted: confirmed explicit tags, else those that rules find.

    Explicit tags are arrays of names, null where none were given.  A status
    other than confirmed takes its tags out, and rules never replace it.
    """
    status = lambda c: F.lower(F.trim(K.blank(c)))
    none = F.array().cast("array<string>")
    fine = status(tag_status).isin("", "confirmed")
    own = lambda tags, s: F.when(F.when(status(s) != "", status(s)).otherwise(status(tag_status)).isin("", "confirmed"), F.filter(F.transform(F.coalesce(tags, none), C.tag_slug), lambda t: t != "")).otherwise(none)
    free = lambda tags, s: fine & (F.size(F.coalesce(tags, none)) == 0) & status(s).isin("", "confirmed")
    whole = F.concat_ws(" ", K.blank(text), K.blank(discipline))
    low, topic = F.lower(whole), C.classify_topic(whole, discipline)
    parent = F.lower(topic["parent"])
    guess = F.when(parent == "fire", F.array(F.lit("fire_separation"))).when(parent == "trees", F.array(F.lit("tree_protection"), F.lit("tree_related"))).when(parent == "drainage", F.array(F.lit("drainage"))).when(parent == "structural", F.array(F.lit("structural_calculations"))).otherwise(none)
    issues = F.concat(own(issue_tags, issue_status), F.when(free(issue_tags, issue_status), guess).otherwise(none))

    def found(rules: dict[str, str], when: Column) -> Column:
        return F.when(when, F.array_compact(F.array(*[F.when(low.rlike(p), t) for t, p in rules.items()]))).otherwise(none)

    open_ = free(event_tags, event_status)
    events = F.concat(
        own(event_tags, event_status), found(TREE_EVENTS, open_ & F.array_contains(issues, "tree_protection")), found(FIRE_EVENTS, open_ & F.array_contains(issues, "fire_separation")),
        found(DOOR_EVENTS, open_ & (F.contains(low, F.lit("door")) | F.contains(topic["aspect"], F.lit("door")))),
    )
    return F.struct(F.array_sort(F.array_distinct(events)).alias("event_tags"), F.array_sort(F.array_distinct(issues)).alias("issue_tags"))
