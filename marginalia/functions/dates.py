"""Which date and which round belong to a comment, a response, an event or a document, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions import identity as I
from marginalia.functions import labels as L
from marginalia.functions.keys import blank, first_path
from marginalia.functions.text import collapse

# Places a date may come from that date the container, not the event.
CONTAINER_SOURCES = ["source_document_date", "document_date", "pdf_metadata", "file_date", "filename", "workbook_export", "filesystem_mtime"]
ROUND_FOLDER = "(?i)(?<![A-Za-z0-9])([0-9]+)(?:st|nd|rd|th)\\s+round(?:\\s+of\\s+comments?)?\\b"
PC_ROUND = "(?i)(?<![A-Za-z0-9])PC\\s*-?\\s*([0-9]+)\\b"
MONTH_NAME = "(?i)\\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
WORDED = f"{MONTH_NAME}\\.?\\s+([0-9]{{1,2}})(?:,|\\s)\\s*(20[0-9]{{2}})\\b"
VISIBLE_WORDED = "(?i)\\b((?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)\\s+[0-9]{1,2}\\s*,?\\s+20[0-9]{2})\\b"
VISIBLE_NUMERIC = "\\b([0-9]{1,2}\\s*[/.-]\\s*[0-9]{1,2}\\s*[/.-]\\s*20[0-9]{2})\\b"

def _month(name: Column) -> Column:
    at = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(name, 1, 3)))
    return F.ceil(at / 3).cast("int").cast("string")


def _year(y: Column) -> Column:
    return F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)


def _last(c: Column, pattern: str, groups: tuple[int, int, int], worded: bool = False) -> Column:
    """(found, date) of the last match: year, month and day groups."""
    parts = [F.regexp_extract_all(c, F.lit(pattern), F.lit(g)) for g in groups]
    y, m, d = [F.when(F.size(p) > 0, F.element_at(p, -1)) for p in parts]
    return F.struct((F.size(parts[0]) > 0).alias("found"), I._padded(_year(y), _month(m) if worded else m, d).alias("date"))


def label_date(c: Column) -> Column:
    """The date of a label: the last ISO date, else the last numeric, else the last with a month's name; an invalid one is none."""
    t = F.trim(blank(c))
    iso = _last(t, "\\b(20[0-9]{2})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})\\b", (1, 2, 3))
    numeric = _last(t, "(?<![0-9])([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})(?![0-9])", (3, 1, 2))
    worded = _last(t, WORDED, (3, 1, 2), True)
    return F.when(iso["found"], iso["date"]).when(numeric["found"], numeric["date"]).otherwise(worded["date"])


def last_date(c: Column) -> Column:
    """The last ISO date, or where it is none the last numeric, or the last with a month's name."""
    t = collapse(blank(c))
    iso = _last(t, "(?<![0-9])(20[0-9]{2})[-/._]([0-9]{1,2})[-/._]([0-9]{1,2})(?![0-9])", (1, 2, 3))
    numeric = _last(t, "(?<![0-9])([0-9]{1,2})[-_/.]([0-9]{1,2})[-_/.]((?:20)?[0-9]{2})(?![0-9])", (3, 1, 2))
    return F.coalesce(iso["date"], numeric["date"], _last(t, WORDED, (3, 1, 2), True)["date"])


def loose_date(c: Column) -> Column:
    """The first ISO date, else the first numeric one, else the first after a month's name; the next kind where one is invalid."""
    t = collapse(blank(c))
    part = lambda p, g: F.regexp_extract(t, p, g)
    iso, numeric, worded = "\\b(20[0-9]{2})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})\\b", "\\b([0-9]{1,2})\\s*[/.-]\\s*([0-9]{1,2})\\s*[/.-]\\s*([0-9]{2,4})\\b", "\\b([A-Za-z]{3,9})\\s+([0-9]{1,2})\\s*,?\\s+(20[0-9]{2})\\b"
    named = F.when(part(worded, 1).rlike(f"{MONTH_NAME}$"), I._padded(part(worded, 3), _month(part(worded, 1)), part(worded, 2)))
    return F.coalesce(
        F.when(part(iso, 1) != "", I._padded(part(iso, 1), part(iso, 2), part(iso, 3))),
        F.when(part(numeric, 1) != "", I._padded(_year(part(numeric, 3)), part(numeric, 1), part(numeric, 2))),
        named,
    )


def visible_date(c: Column) -> Column:
    """struct(date, evidence): the first valid date in reading order of a document's text."""
    t = collapse(blank(c))

    def found(pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda v: F.struct(F.instr(t, v).alias("at"), v.alias("evidence")))

    every = F.array_sort(F.concat(found(VISIBLE_WORDED), found(VISIBLE_NUMERIC)))
    dated = F.filter(F.transform(every, lambda x: F.struct(loose_date(x["evidence"]).alias("date"), x["evidence"].alias("evidence"))), lambda x: x["date"].isNotNull())
    return F.get(dated, 0)


def comment_date(response_id: Column, path: Column, stated: list[Column], reviewer: list[Column]) -> Column:
    """The date of a comment: one its source states, else its reviewer's cell, else its path.

    A response letter's own dates say nothing of the comment that it repeats.
    """
    name = F.regexp_extract(F.lower(first_path(path)), "([^/]*)$", 1)
    letter = (blank(response_id) != "") & name.rlike("\\bresponse(?:\\s+letter)?\\b")
    said = F.coalesce(*[I.event_date(c) for c in stated], F.lit(None).cast("date"))
    seen = F.coalesce(*[I.event_date(c) for c in reviewer], F.lit(None).cast("date"))
    return F.coalesce(F.when(~letter, said), seen, F.when(~letter, I.event_date(path)))


def response_date(fields: list[Column], path: Column) -> Column:
    """The first date of the fields in order, else the path's."""
    return F.coalesce(*[I.event_date(c) for c in fields], I.event_date(path))


def event_date_key(occurred: list[Column], stated: list[Column], source: Column) -> Column:
    """An event's date as yyyy-MM-dd, else empty: what dates the event; what dates its container only if that is not where it comes from."""
    weak = F.lower(F.trim(blank(source))).isin(CONTAINER_SOURCES)

    def one(c: Column) -> Column:
        t = blank(c)
        iso, slash = "(?<![0-9])(20[0-9]{2})[-/]([0-9]{1,2})[-/]([0-9]{1,2})(?![0-9])", "(?<![0-9])([0-9]{1,2})/([0-9]{1,2})/([0-9]{2,4})(?![0-9])"
        part = lambda p, g: F.regexp_extract(t, p, g)
        written = lambda y, m, d: F.concat_ws("-", F.lpad(_year(y), 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        return F.when(part(iso, 1) != "", written(part(iso, 1), part(iso, 2), part(iso, 3))).when(part(slash, 1) != "", written(part(slash, 3), part(slash, 1), part(slash, 2)))

    return F.coalesce(*[one(c) for c in occurred], *[F.when(~weak, one(c)) for c in stated], F.lit(""))


def document_date(fields: dict[str, Column], body: Column, properties: Column) -> Column:
    """struct(date, evidence, method): a field that states it, else the visible text, else the file's properties; never its time stamp."""
    kinds = "struct<date:date,evidence:string,method:string>"
    said = [F.when(loose_date(c).isNotNull(), F.struct(loose_date(c).alias("date"), blank(c).alias("evidence"), F.lit(f"record.{n}").alias("method"))) for n, c in fields.items()]
    shown = lambda c, m: F.when(visible_date(c).isNotNull(), F.struct(visible_date(c)["date"].alias("date"), visible_date(c)["evidence"].alias("evidence"), F.lit(m).alias("method")))
    missing = F.struct(F.lit(None).cast("date").alias("date"), F.lit("").alias("evidence"), F.lit("missing").alias("method")).cast(kinds)
    return F.coalesce(*said, shown(body, "visible_document_date"), shown(properties, "docx_core_metadata"), missing)


def source_date(fields: dict[str, Column], method: Column, path: Column, body: Column) -> Column:
    """struct(date, method) of a file: what is stored and printed in it, its name's, what is stored from a name, its visible text."""
    option = lambda d, s: F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(s).alias("method")))
    stored = F.coalesce(*[option(last_date(c), f"existing_{n}") for n, c in fields.items()])
    none = F.struct(F.lit(None).cast("date").alias("date"), F.lit("").alias("method"))
    named = F.contains(F.lower(blank(method)), F.lit("filename"))
    return F.coalesce(F.when(~named, stored), option(L.filename_date(blank(path)), "filename"), stored, option(visible_date(body)["date"], "docx_visible_document_date"), none)


def event_document_date(own: list[Column], occurrences: Column, path: Column) -> Column:
    """An event's label date: its own fields in order, else the first dated occurrence, else its path's; MM/dd/yyyy or empty."""
    dated = F.filter(F.transform(occurrences, lambda o: label_date(o)), lambda d: d.isNotNull())
    found = F.coalesce(*[label_date(c) for c in own], F.get(dated, 0))
    return F.coalesce(I.date_label(found), L.document_date_label(blank(path)), F.lit(""))


def source_round(path: Column) -> Column:
    """The round of a folder such as ``3rd Round of Comments``, else of a file name with ``PC2``."""
    folder, name = F.regexp_extract(blank(path), ROUND_FOLDER, 1), F.regexp_extract(F.regexp_extract(blank(path), "([^/]*)$", 1), PC_ROUND, 1)
    return F.when(folder != "", folder.cast("int")).when(name != "", name.cast("int"))


def canonical_round(value: Column, path: Column) -> Column:
    return F.coalesce(I.round_number(value), source_round(path))


# What a folder may say of its round, in the order of belief: pattern after the ordinal, rounds to take off, confidence.
ROUND_WORDS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5}
ROUND_RULES = [
    ("(?:round\\s+of\\s+comments|round\\s+comments|comments?|review)", 0, 0.96), ("round\\s+submission\\s+package", 0, 0.94),
    ("(?:submission|submitt?al)\\s+package", 1, 0.9), ("(?:submission|submitt?al)", 1, 0.82),
]


def ordinal_before(c: Column, phrase: str) -> Column:
    """The number, or number word, that stands before a phrase; null if none does."""
    digits, word = F.regexp_extract(c, f"(?i)\\b([0-9]+)(?:st|nd|rd|th)?\\s+{phrase}", 1), F.regexp_extract(c, f"(?i)\\b({'|'.join(ROUND_WORDS)})\\s+{phrase}", 1)
    words = F.create_map(*[F.lit(x) for kv in ROUND_WORDS.items() for x in kv])
    return F.coalesce(F.when(digits != "", digits.cast("int")), F.try_element_at(words, F.lower(word)))


def infer_round(path: Column) -> Column:
    """struct(round, confidence, evidence) of a path: the nearest folder that a rule fits, rules in their order, then the file's name."""
    parts = F.split(blank(path), "/")
    folders, name = F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))), F.element_at(parts, -1)

    def fitting(phrase: str, less: int, sure: float) -> Column:
        hit = F.get(F.filter(F.transform(folders, lambda f: F.struct(ordinal_before(f, phrase).alias("n"), f.alias("evidence"))), lambda x: x["n"].isNotNull()), 0)
        return F.when(hit.isNotNull(), F.struct(F.greatest(F.lit(1 if less else 0), hit["n"] - less).cast("string").alias("round"), F.lit(sure).alias("confidence"), hit["evidence"].alias("evidence")))

    options = [fitting(*rule) for rule in ROUND_RULES]
    named = F.regexp_extract(name, "(?i)\\b([0-9]+)(?:st|nd|rd|th)\\s+(?:review|round|comment)", 1)
    options.append(F.when(named != "", F.struct(named.alias("round"), F.lit(0.68).alias("confidence"), name.alias("evidence"))))
    return F.coalesce(*options, F.struct(F.lit("unknown").alias("round"), F.lit(0.0).alias("confidence"), F.lit("").alias("evidence")))


def _unit(c: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c.try_cast("double"))), F.lit(0.0))


def date_metadata(candidate: Column, path: Column, body: Column) -> Column:
    """struct(raw, iso, source, page, evidence, confidence) of a document's date.

    ``candidate`` is what a model gave, a struct of strings raw, value, iso,
    source, evidence, page and confidence.  A date that can't be read gives way
    to the document's visible one, then its file name's.
    """
    part = lambda n: F.trim(blank(candidate[n]))
    raw = F.when(part("raw") != "", part("raw")).otherwise(part("value"))
    own = loose_date(F.when(part("iso") != "", part("iso")).otherwise(raw))
    seen = visible_date(body)
    name = F.regexp_extract(blank(path), "([^/]*)$", 1)
    day = F.coalesce(own, seen["date"], loose_date(name))
    source = F.when(part("source") == "", "unknown").otherwise(part("source"))
    way = F.when(own.isNotNull(), "").when(seen.isNotNull(), "visible_document_date").otherwise("filename_date_fallback")
    evidence = F.when(own.isNotNull(), part("evidence")).when(seen.isNotNull(), seen["evidence"]).when(day.isNotNull(), name).otherwise("")
    fallen = day.isNotNull() & (source == "unknown")
    trust = F.when(fallen, F.greatest(_unit(candidate["confidence"]), F.lit(0.75))).otherwise(_unit(candidate["confidence"]))
    return F.struct(
        F.when(fallen & (raw == ""), evidence).otherwise(raw).alias("raw"), F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("")).alias("iso"),
        F.when(day.isNull(), "unknown").when(fallen, F.concat(F.lit("fallback_"), way)).otherwise(source).alias("source"),
        F.when(fallen, 0).otherwise(F.greatest(F.lit(0), F.coalesce(candidate["page"].try_cast("int"), F.lit(0)))).alias("page"),
        evidence.alias("evidence"), F.when(day.isNull(), 0.0).otherwise(trust).alias("confidence"),
    )


def round_metadata(value: Column, candidate: Column) -> Column:
    """struct(value, raw, source, confidence) of a round; ``candidate`` is what a model gave: raw, value, source, confidence."""
    part = lambda n: F.trim(blank(candidate[n]))
    own = F.trim(blank(value))
    raw = F.when(part("raw") != "", part("raw")).when(part("value") != "", part("value")).otherwise(own)
    made = lambda v, r, s, c: F.struct(v.alias("value"), r.alias("raw"), s.alias("source"), c.alias("confidence"))
    given_ = made(F.when(own != "", own).otherwise(raw), raw, F.when(part("source") == "", "unknown").otherwise(part("source")), _unit(candidate["confidence"]))
    return F.when(candidate.isNotNull(), given_).when(own != "", made(own, own, F.lit("document_content_unattributed"), F.lit(0.7))).otherwise(made(F.lit(""), F.lit(""), F.lit("unknown"), F.lit(0.0)))


def event_order(marker: Column, date: Column, round_: Column, order: Column, event_id: Column) -> Column:
    """Sort key of a thread's events: marked ones by least marker and date, dated ones by date, the rest by round; then order and id."""
    numbers = F.transform(F.regexp_extract_all(blank(marker), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    turn = F.regexp_extract(blank(round_), "([0-9]+)", 1)
    kind = F.when(F.size(numbers) > 0, 0).when(blank(date) != "", 1).otherwise(2)
    n = F.when(kind == 0, F.array_min(numbers)).when((kind == 2) & (turn != ""), turn.cast("int")).when(kind == 2, 10**9).otherwise(0)
    return F.struct(kind.alias("kind"), n.alias("n"), F.when(kind < 2, blank(date)).otherwise("").alias("date"), F.coalesce(order, F.lit(0)).alias("order"), blank(event_id).alias("id"))
