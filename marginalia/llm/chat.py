"""Chat formatting by prefix-target expansion.

A turn is rendered as ``### role``, a newline, the text, ``</turn>`` and a
newline.  Inside roles and texts a backslash goes before every backslash and
every control string, so a rendering can be read back exactly.

Each assistant turn is exploded into an example of its own: all turns before it
are its context, its own text alone is under the loss mask.  The output is two
tables.  ``turns`` holds each rendered turn once; ``examples`` has a row per
assistant turn with its context's turns and end, its loss span and its end, as
places in the conversation's rendering.  Examples of a conversation share their
prefix, so both tables together are as long as the input, also where one
conversation holds a third of all rows; ``expand`` writes the examples out in
full, whose length grows with the square of a conversation's.

A conversation is read as a stream of rows in turn order and never held whole.
Its digests run over all of its turns in order, so one task reads it: its memory
doesn't grow with the conversation, its time does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.storage import cut, pick

# Fixed values of the template.
OPEN, CLOSE, TARGET = "### ", "</turn>", "assistant"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_TURN = re.compile(r"### ((?:[^\\\n]|\\.)*)\n((?:[^\\<]++|\\\\|\\###|\\</turn>|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m.group(1), text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(n|\\|###|</turn>)", lambda m: "\n" if m.group(1) == "n" else m.group(1), role)


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn's rendering, and where its text starts and ends in it."""
    head = f"{OPEN}{escape_role(role or '')}\n"
    body = escape(text or "")
    return head + body + CLOSE + "\n", len(head), len(head) + len(body)


def parse(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendering; raises if it isn't one."""
    out, at = [], 0
    while at < len(rendered):
        m = _TURN.match(rendered, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape_role(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return out


_FORMATTED = "conv_id long, seq long, rendered string, start long, example long, loss_start long, loss_end long, text_end long"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, seq, start, example = object(), 0, 0, 0
    for batch in batches:
        rows = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if conv != now:
                now, seq, start, example = conv, 0, 0, 0
            rendered, a, b = render(role, text)
            end = start + len(rendered)
            hit = role == TARGET
            rows.append((conv, seq, rendered, start, example if hit else None, start + a if hit else None, start + b if hit else None, end))
            seq, start, example = seq + 1, end, example + hit
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _FORMATTED.split(", ")])


def format_chats(chats: DataFrame) -> DataFrame:
    """One row per turn: conv_id, seq, rendered, start, and of an assistant's turn example, loss_start, loss_end; text_end.

    Rows go by turn (nulls first), then role and text; rows repeated whole are
    turns each.  A null text or role is empty.  Rows without conv_id form one
    conversation.  An empty table gives no rows.  Further columns are ignored.
    Places count code points from the start of the conversation's rendering.
    """
    parts = int(chats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pick(chats, conv_id="long", turn="long", role="string", text="string")
    return rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format, _FORMATTED)


def explode_examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn of ``turns``: conv_id, example, context_turns, context_end, loss_start, loss_end, text_end.

    The context is the rendering before ``context_end``, all of the turns before
    the reply; ``loss_start`` to ``loss_end`` is the reply's escaped text, alone
    trainable.  A conversation without an assistant turn has no example.
    """
    return turns.where("example is not null").select("conv_id", "example", F.col("seq").alias("context_turns"), F.col("start").alias("context_end"), "loss_start", "loss_end", "text_end")


def expand(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """The examples in full: conv_id, example, text, loss_start, loss_end.

    Rows without conv_id are one conversation.  The output is quadratic in a
    conversation's length, and a text is held whole by a task.
    """
    parts = turns.select(F.col("conv_id").alias("of"), "seq", "rendered")
    joined = examples.join(parts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("seq") <= F.col("context_turns")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "rendered"))), lambda x: x["rendered"]), "")
    return joined.groupBy("conv_id", "example", "loss_start", "loss_end").agg(text.alias("text")).select("conv_id", "example", "text", "loss_start", "loss_end")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, some, turns, loss, counts, last = None, False, None, None, None, None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]

    def row() -> tuple:
        return now, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2], counts[3]

    def record(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        rows = []
        for conv, seq, rendered, start, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seq", "rendered", "start", "loss_start", "loss_end"))):
            if not some or conv != now:
                if some:
                    rows.append(row())
                now, some, turns, loss, counts, last = conv, True, hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0], None
            if rendered is not None:
                for role, text in parse(rendered):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    counts[0] += 1
                counts[2] += len(rendered)
                last = seq, start, rendered
                continue
            # an example: its context ends where the turn that it closes starts
            if last is None or last[:2] != (seq, start):
                raise ValueError(f"example at turn {seq} of conversation {conv} doesn't meet its turn")
            masked = unescape(last[2][a - start : b - start])
            loss.update(masked.encode("utf-8", "surrogatepass"))
            counts[1] += len(masked)
            counts[3] += 1
        if rows:
            yield record(rows)
    if some:
        yield record([row()])


def digests(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """Per conversation, read back from both tables: turns, digests of turns and of what is under the examples' loss masks.

    Tables without rows give none; rows without conv_id are one conversation.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nothing = lambda kind: F.lit(None).cast(kind)
    said = turns.select("conv_id", "seq", F.lit(0).alias("kind"), "rendered", "start", nothing("long").alias("loss_start"), nothing("long").alias("loss_end"))
    asked = examples.select("conv_id", F.col("context_turns").alias("seq"), F.lit(1).alias("kind"), nothing("string").alias("rendered"), F.col("context_end").alias("start"), "loss_start", "loss_end")
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
    return said.unionByName(asked).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "seq", "kind").mapInArrow(_digest, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = pick(spark.read.parquet(f"{sf_dir}/conversations.parquet"), conv_id="long", turn="long", role="string", text="string")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], chats.schema)
    turns = cut(format_chats(chats.unionByName(extra)), "chats")
    return digests(turns, cut(explode_examples(turns), "examples"))


#: DuckDB's SQL for all columns; formatted_chars counts the template and the backslashes put in.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  count(*) FILTER (role = 'assistant') AS n_examples,
  CAST(sum(13 + length(regexp_replace(role, '\\|###|</turn>', 'x\0', 'g')) + length(regexp_replace(text, '\\|###|</turn>', 'x\0', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
