"""Text normal forms, tokens and small string rules as columns.

Unicode folding (NFKC, entities, case folding) has no built-in expression, so
one Arrow function does it and what is tied to it; all else is expressions.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Word lists and phrases that results must agree with.
NEGATIONS = ["no", "not", "without", "except", "exclude", "excluded", "prohibit", "prohibited", "remain", "remains", "missing", "cannot", "can't"]
ROW_NEGATIONS = ["no", "not", "without", "except", "exclude", "prohibit", "prohibited"]
PROGRESSION = ["comment remains", "still required", "not addressed", "not resolved", "previous response", "does not address", "did not address", "provide clarification", "remains unsatisfied", "remain unsatisfied"]
FILLERS = ["a", "an", "at", "the", "to"]
SEARCH_STOPS = ["a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from", "has", "have", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with", "your", "you", "please", "provide", "show"]
GENERIC_EVENTS = ["noted", "revised", "done", "addressed", "complete", "completed", "see plans", "see revised", "see updated", "ok", "okay"]
EVENT_ALIASES = {
    "current_applicant_response": "applicant_response", "company_response": "applicant_response", "applicant": "applicant_response",
    "government": "government_comment", "reviewer_comment": "government_comment",
    "reviewer_followup": "reviewer_follow_up", "follow_up": "reviewer_follow_up", "note": "discussion_note",
}

# Patterns.
IDENTITY_TOKEN = "[a-z0-9]+(?:[./'’\"-][a-z0-9]+)*"
SEARCH_TOKEN = "[a-z0-9]+(?:[.\\-/][a-z0-9]+)*"
PLAIN_TOKEN = "[a-z0-9]+(?:[-'][a-z0-9]+)?"
CODE_SECTION = "\\b[A-Z]{2,6}\\s+[A-Z]?\\d+(?:\\.\\d+)+\\b"
_PREFIXES = [
    (re.compile(r"^\s*(?:markup|comment)\s+.*?\bv\s*\d+\s*[-/]?\s*c\s*\d+\s+\d+(?:\.\d+)?\s*", re.I)),
    (re.compile(r"^\s*\(?[a-z]\)?\s*pc\s*\d+\s*[-:]\s*", re.I)),
    (re.compile(r"^\s*pc\s*\d+\s*[-:]\s*", re.I)),
    (re.compile(r"^\s*\(?[a-z]\)?\s*[.:]\s*")),
    (re.compile(r"^\s*\d+\s*[.)]\s+")),
]
_NOISE = re.compile(r"_x000[dDaA]_|\*x000[dDaA]\*|[\r\n\t]|-{8,}")
_IDENTITY = re.compile(IDENTITY_TOKEN)


def identity_form(value: str | None) -> str:
    """The stable identity text of one value: folded, export prefixes off, tokens joined by a space."""
    text = value or ""
    if not text.isascii() or "&" in text:
        text = html.unescape(unicodedata.normalize("NFKC", text))
    text = " ".join(_NOISE.sub(" ", text).split())
    for _ in range(8):  # cumulative exports repeat their prefixes
        shorter = text
        for prefix in _PREFIXES:
            shorter = prefix.sub("", shorter)
        if shorter == text:
            break
        text = shorter
    return " ".join(_IDENTITY.findall(text.casefold()))


# Text that may begin with a prefix or hold other noise than blanks and hyphens.
_HEAD = re.compile(r"\s*(?:markup|comment|\(?[a-z]\)?\s*(?:pc|[.:])|pc\s*\d|\d+\s*[.)])", re.I)
_KIND = np.zeros(256, np.uint8)  # 1: letters and digits, 2: what joins them; 0x80 stands for the curly apostrophe
_KIND[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = 1
_KIND[[*map(ord, "./'\"-"), 0x80]] = 2


def identity_forms(values: list[str | None]) -> list[str]:
    """``identity_form`` of many values: what its last pattern finds is found in their bytes together."""
    folded = []
    for value in values:
        text = value or ""
        if "x000" in text or "--------" in text or _HEAD.match(text):
            text = identity_form(text)
        elif text.isascii() and "&" not in text:
            text = text.lower()
        else:
            text = html.unescape(unicodedata.normalize("NFKC", text))
            text = identity_form(value) if "x000" in text or "--------" in text or _HEAD.match(text) else text.casefold()
        folded.append(text if text.isascii() else text.replace("\x80", " ").replace("’", "\x80"))
    out: list[str] = []
    for at in range(0, len(folded), 256):
        some = folded[at : at + 256]
        data = np.frombuffer("\0".join(["", *some, ""]).encode("latin-1", "replace"), np.uint8)
        kind = _KIND[data]
        kept = kind == 1
        kept[1:-1] |= (kind[1:-1] == 2) & kept[:-2] & kept[2:]
        bounds = np.cumsum([0, *[len(t) + 1 for t in some]])
        clean = np.where(kept, data, np.uint8(32))
        clean[bounds] = 0
        stays = kept.copy()
        stays[1:] |= kept[:-1]  # the first blank after a token
        stays[bounds] = True
        made = clean[stays].tobytes().decode("latin-1").split("\0")[1:-1]
        out += [t.strip(" ").replace("\x80", "’") for t in made]
    return out


_DIGIT = re.compile("[0-9]")


def marks(normal: str) -> tuple:
    """Of a normal text its ``parameter_tokens``, ``negation_tokens`` and ``has_progression_language``, as lists and a truth value."""
    found, at = set(), 0
    while m := _DIGIT.search(normal, at):
        at = normal.find(" ", m.end())
        at = len(normal) if at < 0 else at
        found.add(normal[normal.rfind(" ", 0, m.start()) + 1 : at])
    padded = f" {normal} "
    return sorted(found), sorted(w for w in NEGATIONS if f" {w} " in padded), any(p in normal for p in PROGRESSION)


@pandas_udf(StringType())
def normalize_event_text(values: pd.Series) -> pd.Series:
    return values.map(identity_form)


@pandas_udf(StringType())
def fold(values: pd.Series) -> pd.Series:
    """NFKC, entities, no-break spaces, blanks and case."""
    return values.map(lambda v: " ".join(html.unescape(unicodedata.normalize("NFKC", v or "")).split()).casefold())


@pandas_udf(StringType())
def unescaped(values: pd.Series) -> pd.Series:
    """NFKC and entities, for display: blanks and case stay."""
    return values.map(lambda v: v if not v or (v.isascii() and "&" not in v) else html.unescape(unicodedata.normalize("NFKC", v)))


@pandas_udf(StringType())
def accent_free(values: pd.Series) -> pd.Series:
    """Case-folded without accents, outer blanks, commas and stops: the key of a city's name."""

    def key(v: str | None) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", v or "") if not unicodedata.combining(c))
        return " ".join(plain.split()).casefold().strip(" ,.")

    return values.map(key)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def tokens(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def sorted_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def identity_tokens(normal: Column) -> Column:
    return F.split(normal, " ")


def parameter_tokens(normal: Column) -> Column:
    """Tokens with a digit, sorted and distinct, of a normal text."""
    return sorted_set(F.filter(identity_tokens(normal), lambda t: t.rlike("[0-9]")))


def negation_tokens(normal: Column) -> Column:
    return sorted_set(F.array_intersect(identity_tokens(normal), F.array(*map(F.lit, NEGATIONS))))


def has_progression_language(normal: Column) -> Column:
    return normal.rlike("|".join(PROGRESSION))


def extraction_fingerprint(normal: Column) -> Column:
    """The normal text without filler words; order and repetitions stay."""
    return F.array_join(F.filter(F.regexp_extract_all(normal, F.lit("[a-z0-9]+(?:[./'’-][a-z0-9]+)*"), F.lit(0)), lambda t: ~t.isin(FILLERS)), " ")


def row_parameters(normal: Column) -> Column:
    return sorted_set(F.regexp_extract_all(normal, F.lit("[a-z]*[0-9]+(?:[./'’-][a-z0-9]+)*"), F.lit(0)))


def row_negations(normal: Column) -> Column:
    return sorted_set(F.array_intersect(F.regexp_extract_all(normal, F.lit("[a-z]+"), F.lit(0)), F.array(*map(F.lit, ROW_NEGATIONS))))


def search_tokens(c: Column) -> Column:
    return F.filter(tokens(c, SEARCH_TOKEN), lambda t: (F.length(t) > 1) & ~t.isin(SEARCH_STOPS))


def plain_tokens(c: Column) -> Column:
    return F.filter(tokens(c, PLAIN_TOKEN), lambda t: (F.length(t) > 1) & ~t.isin(SEARCH_STOPS))


def topic_tokens(c: Column) -> Column:
    """Words of a text with its addresses gone and numbers as the word ``number``."""
    plain = F.regexp_replace(F.lower(collapse(c)), "https?://\\S+", " ")
    plain = F.regexp_replace(plain, "\\b[0-9]+(?:[./'-][0-9]+)*\\b", " number ")
    return F.filter(F.regexp_extract_all(plain, F.lit("[a-z]+(?:-[a-z]+)?"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(SEARCH_STOPS))


def code_sections(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(CODE_SECTION), F.lit(0))


def term_root(t: Column) -> Column:
    n = F.length(t)
    return F.when((n > 4) & t.endswith("ies"), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y"))).when((n > 3) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, F.lit(1), n - 1)).otherwise(t)


def truncation_reason(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike("(\\.\\.\\.|…)$"), "ends_with_ellipsis").when(t.rlike("(?i)\\b(and|or|the|to|of|for|with|per|see|refer to)$"), "ends_mid_phrase").otherwise("")


def searchable_text(city: Column, discipline: Column, text: Column) -> Column:
    codes = sorted_set(code_sections(text))
    head = F.concat(F.lit("City: "), F.coalesce(city, F.lit("")), F.lit("\nDiscipline: "), F.coalesce(discipline, F.lit("")), F.lit("\nComment: "), F.coalesce(text, F.lit("")))
    return F.when(F.size(codes) > 0, F.concat(head, F.lit("\nCode sections: "), F.array_join(codes, ", "))).otherwise(head)


def coherent_units(c: Column) -> Column:
    """A text's units: its numbered items of 20 characters or more, each after what precedes the first; else the text."""
    value = F.trim(F.regexp_replace(c, "\r\n?", "\n"))
    parts = F.split(value, "(?im)(?=^[ \\t]*(?:(?:PC|ITEM|COMMENT|CORRECTION)[ \\t]*)?[0-9]{1,3}[ \\t]*[:.)-][ \\t]+)")
    parts = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^\\s+|\\s+$", "")), lambda p: p != "")
    item = "(?is)^(?:(?:PC|ITEM|COMMENT|CORRECTION)\\s*)?[0-9]{1,3}\\s*[:.)-]\\s.*"
    items = F.filter(parts, lambda p: p.rlike(item))
    long = F.filter(items, lambda p: F.length(p) >= 20)
    first = F.get(parts, 0)
    headed = F.when(~first.rlike(item), F.transform(long, lambda p: F.concat(first, F.lit("\n"), p))).otherwise(long)
    return F.when(value == "", F.array().cast("array<string>")).when((F.size(items) < 2) | (F.size(long) == 0), F.array(value)).otherwise(headed)


def normalize_event_type(c: Column) -> Column:
    plain = F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("-"), F.lit("_"))
    alias = F.create_map(*[F.lit(x) for kv in EVENT_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(alias, plain), F.when(plain != "", plain), F.lit("unknown"))


def role_family(role: Column, event_type: Column) -> Column:
    r, t = F.lower(collapse(F.coalesce(role, F.lit("")))), F.lower(F.trim(F.coalesce(event_type, F.lit(""))))
    company = r.isin("company", "applicant", "applicant_response") | t.isin("applicant_response", "current_applicant_response")
    office = r.isin("government", "reviewer", "city") | t.isin("government_comment", "reviewer_follow_up", "discussion_note")
    return F.when(company, "company").when(office, "government").otherwise(F.coalesce(F.when(r != "", r), F.when(t != "", t), F.lit("unknown")))


def recurring_title(c: Column) -> Column:
    """A card's title from a text fit for display: prefixes off, the first sentence, 110 characters at most, cut at a word."""
    v = F.regexp_replace(c, "^\\s*\\(?[A-Z]\\)?(?:[.:]|\\s+)\\s*", "")
    v = F.regexp_replace(v, "(?i)^\\s*PC[0-9]+\\s*[-:]\\s*", "")
    v = F.regexp_replace(v, "(?i)^\\s*#[0-9]+\\s*(?:continue)?\\s*", "")
    v = F.regexp_replace(v, "^\\s*[0-9]+\\s*[.)]\\s+", "")
    v = F.regexp_replace(collapse(v), "^[ .:\\-]+|[ .:\\-]+$", "")

    def shorten(first: Column) -> Column:
        cut = F.concat(F.regexp_replace(F.substring(first, 1, 107), " [^ ]*$", ""), F.lit("…"))
        return F.when(first == "", "Recurring review issue").when(F.length(first) > 110, cut).otherwise(first)

    def after_colon(first: Column) -> Column:
        colon = F.instr(first, ":")
        return let(F.when((colon > 0) & (colon <= 43), F.trim(F.substring(first, colon + 1, F.length(first)))).otherwise(first), shorten)

    return let(F.trim(F.regexp_extract(v, "^(.*?)(?:(?<=[.!?])\\s|$)", 1)), after_colon)


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.82, "high").when(c >= 0.58, "medium").otherwise("low")


def compact_path(c: Column) -> Column:
    parts = F.filter(F.split(c, "\\s+\\|\\s+"), lambda p: F.trim(p) != "")
    return F.array_join(F.transform(parts, lambda p: F.regexp_extract(F.trim(p), "([^/]*)/*$", 1)), " + ")


def column_number(letters: Column) -> Column:
    """Spreadsheet letters to a number, A being 1."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda a, ch: F.when(ch == "", a).otherwise(a * 26 + F.ascii(ch) - 64))


def column_letters(n: Column) -> Column:
    """The inverse of ``column_number`` up to ZZZ."""
    letter = lambda k: F.chr(F.lit(65).cast("long") + F.pmod(k, F.lit(26)))
    a, b, c = n - 1, F.floor((n - 27) / 26), F.floor((n - 703) / 676)
    return F.concat(F.when(n > 702, letter(c)).otherwise(""), F.when(n > 26, letter(b)).otherwise(""), letter(a))


def parse_cell_range(c: Column) -> Column:
    """``B2:D9`` to struct(first_row, first_column, last_row, last_column); one cell is a range of its own."""
    m = lambda g: F.regexp_extract(F.upper(F.trim(c)), "^\\$?([A-Z]{1,3})\\$?([0-9]+)(?::\\$?([A-Z]{1,3})\\$?([0-9]+))?$", g)
    last = lambda g, d: F.when(m(g) != "", m(g)).otherwise(m(d))
    whole = F.struct(m(2).cast("int").alias("first_row"), column_number(m(1)).alias("first_column"), last(4, 2).cast("int").alias("last_row"), column_number(last(3, 1)).alias("last_column"))
    return F.when(m(1) != "", whole)


@pandas_udf(StringType())
def reconstruct_verbatim(values: pd.Series) -> pd.Series:
    """Wrapped lines joined and hyphens at line ends undone; list items and headings start lines of their own."""
    starts = re.compile(r"\s*(?:[-*•]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])\s+")

    def one(v: str | None) -> str:
        out: list[str] = []
        for line in (v or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            line = " ".join(line.split())
            heading = bool(line) and (line.isupper() or line.endswith(":"))
            if not line or not out or not out[-1] or heading or starts.match(line) or out[-1].endswith(":") or out[-1].isupper():
                out.append(line)
            elif re.search(r"[A-Za-z]-$", out[-1]) and line[0].islower():
                out[-1] = out[-1][:-1] + line
            else:
                out[-1] += " " + line
        return "\n".join(out).strip()

    return values.map(one)


def lexically_safe(raw: Column, rebuilt: Column) -> Column:
    """A reconstruction keeps the sequence of letters and digits."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", "")
    return bare(raw) == bare(rebuilt)


def keyword_hits(c: Column, phrases: list[str]) -> Column:
    """Those of the phrases that are in the text as whole words, sorted."""
    found = [F.when(F.lower(c).rlike(f"(?<![a-z0-9]){re.escape(p)}(?![a-z0-9])"), F.lit(p)) for p in sorted(phrases)]
    return F.array_compact(F.array(*found))


def split_reviewer(c: Column) -> Column:
    """A reviewer cell to struct(discipline, reviewer): ``Discipline - Name``, ``Discipline: Name``, ``Name (Discipline)``."""
    t = collapse(F.coalesce(c, F.lit("")))
    paired = F.regexp_extract(t, "^([^:(]+?)\\s*(?: - |: )\\s*(.+)$", 1)
    named = F.regexp_extract(t, "^(.+?)\\s*\\(([^)]+)\\)$", 2)
    return (
        F.when(paired != "", F.struct(paired.alias("discipline"), F.regexp_extract(t, "^([^:(]+?)\\s*(?: - |: )\\s*(.+)$", 2).alias("reviewer")))
        .when(named != "", F.struct(named.alias("discipline"), F.regexp_extract(t, "^(.+?)\\s*\\(([^)]+)\\)$", 1).alias("reviewer")))
        .otherwise(F.struct(F.lit("").alias("discipline"), t.alias("reviewer")))
    )
