r"""Chat formatting with a grammar round trip.

    conversation = { turn }        turn = "[INST]" role "[/INST]" text "</s>"

A role or text is first written as it is. The rendered turn is parsed again; where what comes back differs, the
field is written with a backslash before every backslash and control string, which the parser always reads back.
Turns are rendered, parsed and digested one at a time, so a conversation of any length needs bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
CONTROL = re.compile(r"\\|\[INST\]|\[/INST\]|</s>")
TOKEN = re.compile(r"\\(?:\\|\[INST\]|\[/INST\]|</s>)|\[INST\]|\[/INST\]|</s>")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def field(source: str, at: int, closing: str) -> tuple[str, int] | None:
    """The field that starts at a place and the place after its closing string; None if the grammar breaks."""
    parts, last = [], at
    for m in TOKEN.finditer(source, at):
        if m[0][0] != "\\":
            return ("".join(parts) + source[last : m.start()], m.end()) if m[0] == closing else None
        parts.append(source[last : m.start()] + m[0][1:])
        last = m.end()
    return None


def parse(source: str) -> list[tuple[str, str]] | None:
    """(role, text) of each turn; None if source isn't in the grammar."""
    turns, at = [], 0
    while at < len(source):
        if not source.startswith(OPEN, at) or not (role := field(source, at + len(OPEN), CLOSE)) or not (text := field(source, role[1], END)):
            return None
        turns.append((role[0], text[0]))
        at = text[1]
    return turns


def render(role: str, text: str) -> tuple[str, int]:
    """A turn and where its text starts, escaped until it reads back as it was."""
    for a, b in ((role, text), (role, escape(text)), (escape(role), text), (escape(role), escape(text))):
        made = OPEN + a + CLOSE + b + END
        if parse(made) == [(role, text)]:
            return made, len(OPEN + a + CLOSE)
    raise AssertionError("the grammar escapes every text")


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Conversation:
    def __init__(self, conv_id):
        self.id, self.n, self.loss, self.chars = conv_id, 0, 0, 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, learn: str) -> tuple[str, int, int]:
        made, at = render(role, text)
        ((role, text),) = parse(made)  # digests are of what the output says
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        start, end = self.chars + at, self.chars + len(made) - len(END)
        if role == learn:
            (read, _) = field(made[at:], 0, END)
            self.masked.update(read.encode("utf-8", "surrogatepass"))
            self.loss += len(read)
        self.n, self.chars = self.n + 1, self.chars + len(made)
        return made, start, end

    def row(self) -> tuple:
        return self.id, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows by conversation and turn in each partition. Ties of a turn go by role, then text; null turns come first."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def digest(rows: DataFrame, learn: str = "assistant") -> DataFrame:
    """A row for each conversation, read back from its rendered form. Null conv_ids form one conversation; null roles
    and texts are empty; repeated rows are turns of their own; no rows give no conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for b in batches:
            for conv, _, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now.id != conv:
                    done += [now.row()] if now else []
                    now = _Conversation(conv)
                now.add(role, text, learn)
            if done:
                yield _batch(done)
                done = []
        if now:
            yield _batch([now.row()])

    return _ordered(rows).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


def format_turns(rows: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, position, formatted, loss_start, loss_end): the rendered turns in order; joined by position they are the
    conversation, and the loss mask covers code points loss_start to loss_end of it (null for turns not learned)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            out = []
            for conv, _, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now.id != conv:
                    now = _Conversation(conv)
                made, start, end = now.add(role, text, learn)
                out.append((conv, now.n - 1, made, *((start, end) if role == learn else (None, None))))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["conv_id", "position", "formatted", "loss_start", "loss_end"])

    return _ordered(rows).mapInArrow(run, "conv_id long, position long, formatted string, loss_start long, loss_end long")


HARD = "</s>[INST] ok [/INST]"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.createDataFrame([(-1, 0, "user", HARD), (-1, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    return digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (SELECT *, length(role) + 17 + CASE WHEN regexp_matches(text, '\\\\|\[INST\]|\[/INST\]|</s>|\\$')
      THEN length(regexp_replace(text, '(\\|\[INST\]|\[/INST\]|</s>)', '\\\1', 'g')) ELSE length(text) END AS chars FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""
