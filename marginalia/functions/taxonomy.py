"""Topics by an ordered cascade of patterns, tags and response classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.keys import identity_fold

# The rules in their order, first match wins.
TREES = [("arborist documentation", "arborist|report|monitor|inspection|documentation|submit"), ("tree protection and impact mitigation", "protect|protection|fenc|root|excavat|impact|prun|preserv"), ("tree removal and inventory", "remov|circumference|inventory|tree id|label|size|classification")]
DOORS = [("door fire rating", "fire[- ]?rated|fire[- ]?resistance|assembly|smoke"), ("door swing and egress", "swing|egress|exit|landing|clearance"), ("door dimensions and clear width", "width|height|dimension|size|clear|\\d+['\"]|minimum"), ("door hardware", "hardware|hinge|latch|handle|closer")]
RULES = [
    ("DRAINAGE_STORMWATER", "Drainage", "drainage and stormwater", "drain|stormwater|runoff|retention|infiltration|swale"),
    ("STRUCTURAL_CALCULATIONS", "Structural", "structural calculations and framing", "structur|seismic|shear|beam|joist|foundation|hanger|ledger|load"),
    ("FIRE_SEPARATION", "Fire", "fire separation and rated assemblies", "fire|rated|sprinkler|smoke|carbon monoxide|separation"),
    ("ACCESSIBILITY", "Accessibility", "accessibility and clearances", "accessible|ada|accessibility|grab bar|clearance|reach range"),
    ("GRADING_SITE_WORK", "Site work", "grading and site work", "grading|slope|retaining|site plan|earthwork"),
    ("SETBACKS_ZONING", "Zoning", "setbacks and zoning compliance", "setback|zoning|lot coverage|floor area|height limit|property line"),
    ("ENERGY_COMPLIANCE", "Energy", "energy compliance", "energy|calgreen|hers|insulation|resnet|title 24"),
    ("PARKING_ACCESS", "Planning", "parking and vehicle access", "parking|driveway|garage|vehicle access|stall"),
]
TREE_WORDS, DOOR_WORDS = "tree|trees|arbor|arborist|heritage tree", "door|doors|opening"


def _slug(c: str) -> str:
    import re

    return re.sub("[^A-Z0-9]+", "_", c.upper()).strip("_")


def _whole(c: Column, words: str) -> Column:
    return c.rlike(f"\\b({words})\\b")


def classify_topic(text: Column, discipline: Column) -> Column:
    """struct(topic_id, parent, aspect), from the folded text alone for aspects and with the discipline before it for topics.

    The folding is one Arrow function, so each pattern reads a column that is
    there already.  One pattern over all topics' words comes first: most texts
    have none, and need no other.
    """
    body, field = identity_fold(F.coalesce(text, F.lit(""))), F.coalesce(discipline, F.lit(""))
    value = F.concat_ws(" ", identity_fold(field), body)
    either = lambda words: _whole(value, words)
    topic = lambda i, p, a: F.struct(F.lit(i).alias("topic_id"), F.lit(p).alias("parent"), F.lit(a).alias("aspect"))

    def aspects(prefix: str, parent: str, rules: list, last: str) -> Column:
        out = F.when(F.lit(False), topic("", "", ""))
        for aspect, words in rules:
            out = out.when(_whole(body, words), topic(f"{prefix}_{_slug(aspect)}", parent, aspect))
        return out.otherwise(topic(f"{prefix}_{_slug(last)}", parent, last))

    parent = F.initcap(F.trim(field))
    parent = F.when(parent == "", "General").otherwise(parent)
    aspect = F.concat(F.lower(parent), F.lit(" review"))
    slug = F.regexp_replace(F.regexp_replace(F.upper(aspect), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    general = F.struct(F.concat(F.lit("GENERAL_"), slug).alias("topic_id"), parent.alias("parent"), aspect.alias("aspect"))
    found = F.when(~either("|".join([TREE_WORDS, DOOR_WORDS, *(r[3] for r in RULES)])), general)
    found = found.when(either(TREE_WORDS), aspects("TREES", "Trees", TREES, "tree review")).when(either(DOOR_WORDS), aspects("DOORS", "Doors", DOORS, "door schedule and labeling"))
    for i, name, aspect_, words in RULES:
        found = found.when(either(words), topic(i, name, aspect_))
    return found.otherwise(general)


def classify_words(tokens: Column, technical: list[str], administrative: list[str]) -> Column:
    """``nontechnical`` if more administrative than technical words are there, else ``technical``."""
    hits = lambda words: F.size(F.array_intersect(tokens, F.array(*map(F.lit, words))))
    return F.when(hits(administrative) > hits(technical), "nontechnical").otherwise("technical")


def tag_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


# What a response says was done, in the order of the tests.
RESPONSE_RULES = [
    ("Specific drawing or document revision", "\\b(?:sheet|detail|page|drawing|plan set|calculation|report|schedule)\\b"),
    ("Separate supporting submittal", "\\b(?:permit|application|submitt(?:ed|al)|upload(?:ed)?)\\b"),
    ("Design changed to remove the conflict", "\\b(?:removed|deleted|relocated|redesigned|reconfigured|replaced)\\b"),
    ("Requested information or feature added", "\\b(?:added|provided|installed|included|shown|labeled|labelled|identified)\\b"),
    ("Acknowledged without a traceable revision", "^[\\s\\W]*(?:noted|acknowledged|ok|will comply)[\\s\\W]*$"),
]
OTHER_RESPONSE = "Recorded applicant response"
CONCRETE = "\\b(?:sheet|page|detail|plan|drawing|calculation|revision|revised|updated|added|replaced|removed|installed|provided|dimension|elevation|schedule)\\b"
CLOSED = "\\b(?:resolved|complete|completed|approved|addressed|satisfied|no further comments|closed)\\b"


def response_pattern(c: Column) -> Column:
    """The class of action that a response records."""
    t = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(F.lit(False), "")
    for name, words in RESPONSE_RULES:
        out = out.when(t.rlike(words), name)
    return out.otherwise(OTHER_RESPONSE)


def support_level(projects: Column, events: Column) -> Column:
    return F.when(projects > 1, "cross_project").when((events > 1) & (projects > 0), "single_project").when(events > 1, "multiple_records").otherwise("single_record")


def evidence_level(response: Column, later: Column) -> Column:
    """1 no response, 2 a response, 3 one that names a revision, 4 a later record that closes the issue."""
    none = response.isNull() | (F.trim(response) == "")
    return F.when(none, 1).when(F.lower(F.coalesce(later, F.lit(""))).rlike(CLOSED), 4).when(F.lower(response).rlike(CONCRETE), 3).otherwise(2)
