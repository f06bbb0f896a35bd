"""Identity keys of cities, sites, projects, documents, comments and occurrences as columns.

Paths are those of the collection: a project's folder follows ``comments&response``
or ``new``, the folder after it is the discipline's.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from marginalia.functions import identity as I
from marginalia.functions import labels as L
from marginalia.functions import text as X

# City names for display, ordinal words and street suffixes in their short spelling.
CITY_NAMES = {"atherton": "Atherton", "cupertino": "Cupertino", "los altos": "Los Altos", "menlo park": "Menlo Park", "san jose": "San Jose", "saratoga": "Saratoga", "sunnyvale": "Sunnyvale"}
ORDINAL_WORDS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth"]
STREETS = {"avenue": "ave", "street": "st", "road": "rd", "drive": "dr", "boulevard": "blvd", "lane": "ln", "court": "ct", "place": "pl", "parkway": "pkwy", "highway": "hwy", "circle": "cir", "terrace": "ter", "trail": "trl", "way": "way"}
KNOWN_DISCIPLINES = ["architectural", "building", "civil", "electrical", "fire", "mechanical", "planning", "plumbing", "public works", "structural", "zoning"]
CASE = "(?<![A-Za-z0-9])([0-9]{2})\\s*[- ]\\s*([0-9]{3})\\s*[- ]\\s*([0-9]{2,6})(?![0-9])"
SUFFIX = "\\b(?:ave|st|rd|dr|blvd|ln|ct|pl|pkwy|hwy|cir|ter|trl|way)\\b"
_SPELLING = {word: f"{n}{'th' if 10 < n < 14 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}" for n, word in enumerate(ORDINAL_WORDS, 1)} | STREETS
_SHORT = re.compile(rf"\b(?:{'|'.join(_SPELLING)})\b")
OCCURRENCE_TYPES = ["newly_issued", "reissued_unresolved"]
MARKUP = "(?is)^\\s*(markup|comment)\\s+[^\\s|]+\\.(?:pdf|docx?|xlsx?|csv)\\s+(.+)$"
IDENTIFIER = "(?is)^.*?\\b(V\\s*[0-9]+\\s*[-/]?\\s*C\\s*[0-9]+)\\s+([0-9]+(?:\\.[0-9]+)?)\\b(.*)$"
# Words of file names that say nothing, and those that mean each other.
NAME_STOPS = ["a", "added", "and", "attached", "document", "file", "for", "in", "included", "is", "of", "on", "please", "refer", "reference", "revised", "see", "sheet", "submission", "system", "the", "to", "under", "csv", "doc", "docx", "pdf", "version", "xls", "xlsx"]
NAME_SYNONYMS = {
    "geotech": ["soil", "geotechnical"], "geotechnical": ["soil", "geotech"], "soil": ["geotech", "geotechnical"],
    "calc": ["calculation", "structural"], "calculation": ["calc", "structural"], "foundation": ["footing", "structural"], "footing": ["foundation", "structural"],
}
# Generic words of questions, equivalent words, and the words of topics.
GENERIC_WORDS = [
    "a", "about", "all", "and", "are", "comment", "comments", "concern", "concerning", "count", "did", "do", "does", "find", "handled", "have", "has", "historical", "history",
    "i", "me", "we", "you", "was", "were", "been", "can", "could", "would", "should", "how", "in", "involving", "many", "of", "our", "permit", "please", "previously",
    "mention", "mentioned", "mentioning", "record", "records", "response", "responses", "show", "summarize", "the", "there", "these", "those", "to", "what", "with",
    "across", "between", "versus", "vs", "compare", "different", "first", "second", "most", "least", "more", "less", "than", "usually", "typically", "often", "project", "projects",
    "which", "received", "contains", "review", "round", "city", "cities", "related", "confirmed", "examples", "example", "three", "resolutions", "resolution", "later",
    "reviewers", "reviewer", "new", "team", "learn", "recurring", "historically", "from", "for", "by", "or", "as", "at", "on", "issue", "issues", "plan", "plans",
]
EQUIVALENT_WORDS = {
    "size": ["size", "dimension", "width"], "dimension": ["dimension", "size", "width"], "width": ["width", "dimension", "size"],
    "protection": ["protection", "protect", "removal", "arborist", "fencing"], "protect": ["protection", "protect", "removal", "arborist", "fencing"],
    "rating": ["rating", "rated"], "rated": ["rating", "rated"],
}
TOPIC_WORDS = {
    "drainage": ["drainage", "drain", "runoff", "stormwater", "swale", "infiltration", "detention", "downspout", "grading", "slope", "discharge"],
    "fire": ["fire", "rated", "rating", "separation", "assembly", "gypsum", "ul", "crc", "r302"],
    "tree": ["tree", "trees", "arborist", "root", "canopy", "removal", "preservation", "fencing"],
    "door": ["door", "doors", "opening", "openings", "width", "height", "dimension", "size"],
    "beam": ["beam", "beams", "framing", "joist", "structural", "load", "header", "girder"],
}


def document_form(value: str | None) -> str:
    """A visible text folded, in one line, no blank before punctuation; numbers and codes stay."""
    text = value or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = " ".join(text.replace("_x000D_", " ").replace("_x000A_", " ").casefold().split())
    return re.sub(r"\s+([,.;:!?])", r"\1", text)


@pandas_udf(StringType())
def normalize_document_text(values: pd.Series) -> pd.Series:
    return values.map(document_form)


@pandas_udf(StringType())
def identity_fold(values: pd.Series) -> pd.Series:
    """NFKC, blanks collapsed, case folded; a null is empty."""
    return values.map(lambda v: " ".join((unicodedata.normalize("NFKC", v) if v and not v.isascii() else v or "").split()).casefold())


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def given(*columns: Column) -> Column:
    """The first that isn't empty, else empty."""
    return F.coalesce(*[F.when(F.trim(blank(c)) != "", F.trim(c.cast("string"))) for c in columns], F.lit(""))


def first_path(c: Column) -> Column:
    return F.trim(F.get(F.split(blank(c), " \\| "), 0))


def city_key(c: Column) -> Column:
    key = X.accent_free(blank(c))
    return F.when(key == "", "unknown").otherwise(key)


def city_name(c: Column) -> Column:
    """The spelling for filters and summaries."""
    key = city_key(c)
    names = F.create_map(*[F.lit(x) for kv in CITY_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, key), F.initcap(key))


def folder_after(path: Column, *markers: str) -> Column:
    """The path's part after the first of the markers that it has, else empty."""
    parts = F.split(first_path(path), "/")
    found = [F.when(F.array_contains(parts, m), blank(F.get(parts, F.array_position(parts, m).cast("int")))) for m in markers]
    return F.coalesce(*[F.when(f != "", f) for f in found], F.lit(""))


def project_folder(path: Column) -> Column:
    return folder_after(path, "comments&response", "new")


def scope_folder(path: Column, discipline: Column) -> Column:
    """The folder below the project's, else the discipline."""
    parts = F.split(first_path(path), "/")
    at = F.array_position(parts, "comments&response").cast("int")
    below = F.when(at > 0, F.get(parts, at + 1))
    return normalize_document_text(F.coalesce(below, F.when(blank(discipline) != "", discipline), F.lit("unknown")))


def address_form(value: str | None, city: str | None) -> str:
    """An address in one spelling: permit marker, city and what follows it, state and postal code off, words short."""
    t = re.sub(r"^\s*\d{2}\s*[- ]\s*\d{3}\s*[-_]*", "", document_form(value).replace("_", " ")).strip()
    t = re.split(r"\s+[—–|]\s+", re.sub(r"(?<=[a-z])-(?=[a-z])", " ", t), maxsplit=1)[0]
    if place := document_form(city):
        t = re.sub(rf",?\s*{re.escape(place)}\b.*$", "", t)
    t = re.sub(r",?\s*(?:ca|california)\s+\d{5}(?:-\d{4})?$", "", t)
    t = re.sub(r"\s*,\s*", ", ", t).strip(" ,.")
    return " ".join(_SHORT.sub(lambda m: _SPELLING[m.group()], t).split()).strip(" ,.")


@pandas_udf(StringType())
def address(values: pd.Series, cities: pd.Series) -> pd.Series:
    return pd.Series([address_form(v, c) for v, c in zip(values, cities)], dtype=object)


def site_name(project: Column, path: Column, city: Column) -> Column:
    """The physical address: the declared one, or the folder's where that is fuller or has another number."""
    declared, folder = address(blank(project), blank(city)), address(project_folder(path), blank(city))
    number = lambda c: F.regexp_extract(c, "^\\s*([0-9]+)", 1)
    other = (number(folder) != "") & (number(declared) != "") & (number(folder) != number(declared))
    fuller = (folder != "") & folder.rlike(SUFFIX) & ((declared == "") | ~declared.rlike(SUFFIX) | other)
    known = F.when(fuller, folder).otherwise(declared)
    return F.coalesce(*[F.when(c != "", c) for c in (known, folder)], normalize_document_text(given(project, F.lit("unknown"))))


def display_name(name: Column) -> Column:
    """Title case, ordinals small."""
    return F.when(name == "", "Unknown site").otherwise(F.regexp_replace(F.initcap(name), "\\b([0-9]+)([A-Za-z])", "$1$2"))


def hierarchy_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and 20 digits of the hash of the parts in their document form."""
    return I.stable_id(prefix, *[normalize_document_text(blank(p)) for p in parts])


def city_id(city: Column) -> Column:
    return hierarchy_id("CITY", city_key(city))


def case_marker(*candidates: Column) -> Column:
    """The permit case in the first of the columns that has one, as dd-ddd-dd."""
    plain = [normalize_document_text(blank(c)) for c in candidates]
    return F.coalesce(*[F.when(F.regexp_extract(p, CASE, 1) != "", F.concat_ws("-", *[F.regexp_extract(p, CASE, g) for g in (1, 2, 3)])) for p in plain], F.lit(""))


def project_key(path: Column, application: Column, project: Column, city: Column) -> Column:
    """A permit case of the folder or application, else the folder, else the site."""
    folder, case = project_folder(path), case_marker(project_folder(path), application)
    return F.when(case != "", F.concat(F.lit("case:"), case)).when(folder != "", F.concat(F.lit("folder:"), normalize_document_text(folder))).otherwise(F.concat(F.lit("site:"), site_name(project, path, city)))


def project_id(path: Column, application: Column, project: Column, city: Column) -> Column:
    return hierarchy_id("PROJECT", city_id(city), project_key(path, application, project, city))


def hierarchy(path: Column, application: Column, project: Column, city: Column, discipline: Column) -> Column:
    """struct of city, site and project ids, names and scope of a record."""
    name, city_ = site_name(project, path, city), city_id(city)
    return F.struct(
        city_.alias("city_id"), hierarchy_id("SITE", city_, name).alias("site_id"), display_name(name).alias("site_name"),
        project_id(path, application, project, city).alias("project_id"), scope_folder(path, discipline).alias("project_scope"), blank(project).alias("project_alias"),
    )


def site_identity(city: Column, project: Column, site: Column) -> Column:
    """``city|project:id``, else ``city|site``, else empty; the ids are folded."""
    where, known = identity_fold(blank(city)), identity_fold(blank(site))
    return F.when(given(project) != "", F.concat(where, F.lit("|project:"), F.lower(given(project)))).when(known != "", F.concat(where, F.lit("|"), known)).otherwise("")


def submission_round(round_: Column, path: Column, date: Column) -> Column:
    """A round's last number, or its label; a numbered submission counts where no date is known."""
    base, n = I.round_identity(round_), F.regexp_extract(blank(path), L.SUBMISSION, 1)
    return F.when((n != "") & (blank(date) == ""), F.concat(base, F.lit("|submission:"), n.cast("int").cast("string"))).otherwise(base)


def discipline_key(c: Column) -> Column:
    """A discipline's name without a workflow label before it; unknown ones are empty."""
    value = X.fold(blank(c))
    known = F.coalesce(*[F.when(value.rlike(f"(?:^|\\b|:)\\s*{d}\\s*$"), F.lit(d)) for d in KNOWN_DISCIPLINES], value)
    return F.when(value.isin("", "unknown", "uncategorized"), "").otherwise(known)


def thread_site(city: Column, project: Column, path: Column, label: Column) -> Column:
    """Where threads are looked for: city and project, else folder, else project label."""
    where, folder = X.fold(blank(city)), folder_after(path, "comments&response")
    return (
        F.when(given(project) != "", F.concat(where, F.lit("|project:"), given(project)))
        .when(folder != "", F.concat(where, F.lit("|folder:"), F.lower(folder)))
        .when(X.fold(blank(label)) != "", F.concat(where, F.lit("|project:"), X.fold(blank(label))))
        .otherwise("")
    )


def marker(c: Column) -> Column:
    """``PC 1 and 2`` to ``PC1&PC2``; a label without a number is folded."""
    numbers = F.regexp_extract_all(blank(c), F.lit("[0-9]+"), F.lit(0))
    return F.when(F.size(numbers) > 0, F.concat(F.lit("PC"), F.array_join(numbers, "&PC"))).otherwise(X.fold(blank(c)))


def submission_number(declared: Column, path: Column) -> Column:
    """A submission's number from its field, else from the path."""
    first = F.regexp_extract(blank(declared), "([0-9]+)", 1)
    return F.when(first != "", first).when(given(declared) != "", given(declared)).otherwise(F.regexp_extract(blank(path), L.SUBMISSION, 1))


def copy_key(site: Column, round_: Column, document: Column, group_size: Column, discipline: Column, number: Column, content: Column) -> Column:
    """What rows of one document in several files share; null unless the document has two files or more."""
    parts = F.struct(site.alias("site"), identity_fold(blank(round_)).alias("round"), F.lower(given(document)).alias("document"), identity_fold(blank(discipline)).alias("discipline"), identity_fold(blank(number)).alias("number"), content.alias("content"))
    return F.when((given(document) != "") & (F.coalesce(group_size, F.lit(0)) >= 2) & (content != ""), parts)


def topic_occurrence(document: Column, comment: Column, comment_id: Column) -> Column:
    """struct(document, comment) that counts once for a topic; rows without identities stand for themselves."""
    own = blank(comment_id)
    return F.struct(F.when(blank(document) != "", document).otherwise(F.concat(F.lit("legacy:"), own)).alias("document"), F.when(blank(comment) != "", comment).otherwise(own).alias("comment"))


def topic_occurrence_allowed(kind: Column) -> Column:
    return F.when(blank(kind) == "", F.lit("newly_issued")).otherwise(kind).isin(OCCURRENCE_TYPES)


def projection_key(city: Column, site: Column, round_: Column, date: Column, path: Column, normal: Column) -> Column:
    """struct(city, site, scope, text) of rows that show one event; null without a text.

    The scope is round and date, or where no round is known the source's path.
    """
    named = lambda c: F.when(X.collapse(blank(c)) == "", "unknown").otherwise(F.lower(X.collapse(blank(c))))
    turn, when = F.lower(X.collapse(blank(round_))), F.lower(given(date))
    scope = F.when(turn == "", F.lower(first_path(path))).otherwise(F.concat(turn, F.lit("|"), F.when(when == "", "unknown").otherwise(when)))
    return F.when(normal != "", F.struct(named(city).alias("city"), named(site).alias("site"), scope.alias("scope"), normal.alias("text")))


def display_parts(c: Column, number: Column) -> Column:
    """struct(body, label): the file name and identifier that lead a markup go to the label if 20 characters of text are left.

    The identifier is a version and number, or else the comment's own number
    within the first 160 characters.
    """
    t = L.readable_evidence(c)
    kind, rest = F.regexp_extract(t, MARKUP, 1), F.regexp_extract(t, MARKUP, 2)
    version = F.regexp_replace(F.regexp_extract(rest, IDENTIFIER, 1), "\\s+", "")
    at = F.regexp_instr(F.substring(rest, 1, 160), F.concat(F.lit("(?i)\\b\\Q"), given(number), F.lit("\\E\\b")))
    after_number = F.when((given(number) != "") & (at > 0), F.substring(rest, at + F.length(given(number)), F.length(rest)))
    tail = F.when(version != "", F.regexp_extract(rest, IDENTIFIER, 3)).otherwise(F.coalesce(after_number, F.lit("")))
    body = F.regexp_replace(tail, "^[ \\-:;|\\n]+", "")
    split = (kind != "") & (F.length(body) >= 20)
    label = F.trim(F.concat(F.initcap(kind), F.lit(" · "), version, F.lit(" "), F.regexp_extract(rest, IDENTIFIER, 2)))
    return F.struct(F.when(split, L.readable_evidence(body)).otherwise(t).alias("body"), F.when(split, label).otherwise("").alias("label"))


def topic_label(c: Column) -> Column:
    """A text without a leading ``Comment`` or the file name of a markup."""
    t = F.regexp_replace(L.readable(c), "(?i)^comment\\s+", "")
    return F.regexp_replace(t, "(?i)^markup\\s+\\S+\\.(?:pdf|docx?|xlsx?)(?:\\s+\\w+\\s+review\\s+[0-9]+)?\\s*", "")


def department(c: Column) -> Column:
    """The department that leads a reviewer's cell: up to the first word that ends one, before a date; else ``unknown``."""
    t = X.collapse(blank(c))
    before = F.regexp_replace(t, "(?s)\\s+[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\\b.*$", "")
    found = F.regexp_extract(before, "(?i)^(.+?\\b(?:Review|Conformance|Division|Department))\\b", 1)
    return F.when(found == "", "unknown").otherwise(X.collapse(found))


@pandas_udf(StringType())
def normalize_quote(values: pd.Series) -> pd.Series:
    """A quotation to be found again: folded, line-break marks and blanks collapsed."""
    return values.map(lambda v: " ".join(unicodedata.normalize("NFKC", v or "").replace("_x000D_", " ").replace("_x000A_", " ").split()).casefold())


def identity_words(c: Column) -> Column:
    """Folded words of a text, letters and digits only, joined by blanks: equal for texts equal in what they say."""
    return F.array_join(F.regexp_extract_all(X.fold(blank(c)), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)), " ")


def reference_tokens(c: Column) -> Column:
    """The set of words of a file's name: camel case split, stop words and numbers off, endings off, synonyms added."""
    t = identity_fold(F.regexp_replace(blank(c), "([a-z])(?=[A-Z])", "$1 "))
    words = F.filter(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(NAME_STOPS) & ~w.rlike("^[0-9]+$") & (F.length(w) >= 3))
    less = lambda w, n: F.substring(w, F.lit(1), F.length(w) - n)
    bare = lambda w: F.when(w.endswith("ing") & (F.length(w) > 6), less(w, 3)).when(w.endswith("ed") & (F.length(w) > 5), less(w, 2)).when(w.endswith("s") & (F.length(w) > 4), less(w, 1)).otherwise(w)
    stem = lambda w: F.when(w.endswith("e") & (F.length(w) > 5), less(w, 1)).otherwise(w)
    stems = F.transform(F.transform(words, bare), stem)
    alike = F.create_map(*[x for k, v in NAME_SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = F.transform(stems, lambda w: F.coalesce(F.try_element_at(alike, w), F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.concat(stems, F.flatten(more))))


def significant_terms(c: Column) -> Column:
    """The set of roots of a question's words, hyphens splitting, without generic ones."""
    words = F.flatten(F.transform(F.regexp_extract_all(F.lower(blank(c)), F.lit("[a-z0-9]+(?:-[a-z0-9]+)?"), F.lit(0)), lambda w: F.split(w, "-")))
    return F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(GENERIC_WORDS)), X.term_root)))


def topic_terms(c: Column) -> Column:
    """``significant_terms`` with the words of each topic they touch and the equivalents of each."""
    terms = significant_terms(c)
    groups = [F.when(F.array_contains(terms, k) | F.arrays_overlap(terms, F.array(*map(F.lit, v))), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in TOPIC_WORDS.items()]
    alike = F.create_map(*[x for k, v in EQUIVALENT_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    same = F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(alike, t), F.array(t))))
    return F.array_sort(F.array_distinct(F.concat(terms, *groups, same)))
