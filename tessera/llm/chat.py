"""Chat formatting by schema fingerprints.

A fingerprint is the hash of a record's nested field paths. It selects a
declarative mapping that names where the turns, their roles and their texts
are; so prompt, instruction and message layouts all become canonical turns
(conversation, position, role, text). The template marks turns, and breaks up
control strings inside texts reversibly; a mask says which characters of the
output count for the loss (assistant texts).

Turns are formatted row by row and conversations are streamed in order, so that
a conversation of any length takes bounded memory.

Defined results: null texts and roles count as empty; turns with the same
number are ordered by role, then text; null turn numbers come first; rows with
a null conversation form one conversation; repeated rows are turns of their
own; a record of unknown fingerprint is left out of the turns and listed by
``unknown_records``; fields that no mapping names don't change a fingerprint;
empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, rows_of, table

TURN, END = "<|turn|>", "<|end|>\n"
#: Control strings of common templates; each is broken up where it occurs in a text.
_CONTROL = re.compile(r"\\|<\|[^|<>\s]{1,40}\|>|</?s>|\[/?INST\]|<</?SYS>>|</?(?:bos|eos|pad|unk)>|<(?:start|end)_of_turn>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    turns: path of the list of turns, or empty; role and text: fields of a turn. Without a list, ``fields`` gives
    pairs of role and field in order; fields joined by + are parts of one text. roles: this layout's names of roles.
    """

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> frozenset[str]:
        if self.turns:
            return frozenset({f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"})
        if self.role:
            return frozenset({"conv_id", "turn", self.role, self.text})
        return frozenset(p for _, f in self.fields for p in f.split("+"))


#: The layouts that are known.
MAPPINGS = (
    Mapping("rows", role="role", text="text"),
    Mapping("messages", turns="messages", role="role", text="content"),
    Mapping("from-value", turns="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))),
    Mapping("dialog", turns="dialog", role="speaker", text="utterance"),
    Mapping("instruction-input", fields=(("user", "instruction+input"), ("assistant", "output"))),
    Mapping("instruction", fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("system-instruction", fields=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction-response", fields=(("user", "instruction"), ("assistant", "response"))),
    Mapping("prompt-completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt-response", fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("question-answer", fields=(("user", "question"), ("assistant", "answer"))),
    Mapping("prompt", fields=(("user", "prompt"),)),
    Mapping("completion", fields=(("assistant", "completion"),)),
    Mapping("instruction-alone", fields=(("user", "instruction"),)),
    Mapping("output", fields=(("assistant", "output"),)),
    Mapping("system", fields=(("system", "system"),)),
)
_PATHS = frozenset().union(*(m.paths() for m in MAPPINGS))


def field_paths(value, at: str = "") -> set[str]:
    """Nested field paths of a record; list elements share the path of their list."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) or {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    """Hash of the paths that any mapping knows."""
    return hashlib.sha256("\n".join(sorted(set(paths) & _PATHS)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(m.paths()): m for m in MAPPINGS}


def _turns(record: dict, m: Mapping) -> list[tuple[str, str]]:
    if m.turns:
        found = [(str(t.get(m.role) or ""), t.get(m.text)) for t in record.get(m.turns) or [] if isinstance(t, dict)]
    elif m.role:
        found = [(str(record.get(m.role) or ""), record.get(m.text))]
    else:
        found = [(r, "\n\n".join(str(record[p]) for p in f.split("+") if record.get(p))) for r, f in m.fields]
    named = dict(m.roles)
    return [(named.get(r, r), "" if t is None else t if isinstance(t, str) else json.dumps(t, ensure_ascii=False)) for r, t in found]


def turns_of_records(records: DataFrame, key: str = "conv_id", column: str = "record", turn: str | None = None) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of JSON records of any known layout.

    A record is a conversation, or, if ``turn`` names a column, a part of one whose first turn has that number.
    """
    spread = records.select(F.col(key).alias("conv_id"), (F.lit(0) if turn is None else F.col(turn)).cast("long").alias("turn"), F.col(column).alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = []
            for k, first, text in rows_of(batch, "conv_id", "turn", "record"):
                record = _parsed(text)
                m = BY_FINGERPRINT.get(fingerprint(field_paths(record))) if record is not None else None
                if m:
                    out += [(k, None if first is None else first + i, *t) for i, t in enumerate(_turns(record, m))]
            if out:
                yield dict(zip(("conv_id", "turn", "role", "text"), zip(*out, strict=True), strict=True))

    return map_arrow(spread, run, "conv_id long, turn long, role string, text string")


def _parsed(text: str | None) -> dict | None:
    try:
        record = json.loads(text or "")
    except ValueError:
        return None
    return record if isinstance(record, dict) else None


def unknown_records(records: DataFrame, key: str = "conv_id", column: str = "record") -> DataFrame:
    """(conv_id, fingerprint) of the records that no mapping covers; a null fingerprint if it is no JSON object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            keys, prints = [], []
            for k, text in rows_of(batch, key, column):
                record = _parsed(text)
                f = None if record is None else fingerprint(field_paths(record))
                if f not in BY_FINGERPRINT:
                    keys.append(k)
                    prints.append(f)
            yield {"conv_id": keys, "fingerprint": prints}

    return map_arrow(records.select(key, column), run, "conv_id long, fingerprint string")


def records_of_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, record): each row of a table of turns as a JSON record, in one of several layouts by conversation.

    No conversation is gathered. Roles that a layout has no name for are written as messages.
    """
    role, text = F.col("role"), F.col("text")
    one = lambda name, r, t: F.to_json(F.struct(F.array(F.struct(r.alias(t[0]), text.alias(t[1]))).alias(name)), {"ignoreNullFields": "false"})
    field = lambda name: F.to_json(F.struct(text.alias(name)), {"ignoreNullFields": "false"})
    messages = one("messages", role, ("role", "content"))
    layouts = [
        F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}),
        messages,
        F.when(role.isin("user", "assistant", "system"), one("conversations", F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role), ("from", "value"))),
        one("dialog", role, ("speaker", "utterance")),
        F.when(role == "user", field("prompt")).when(role == "assistant", field("completion")),
        F.when(role == "user", field("instruction")).when(role == "assistant", field("output")).when(role == "system", field("system")),
    ]
    which = F.pmod(F.coalesce(F.col("conv_id"), F.lit(0)), F.lit(len(layouts)))
    record = F.lit(None).cast("string")
    for k, layout in enumerate(layouts):
        record = F.when(which == k, layout).otherwise(record)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(record, messages).alias("record"))


def escape(text: str) -> str:
    """The text with a backslash inside each control string, and backslashes doubled."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and the span of its text that counts for the loss (empty for other roles)."""
    head = f"{TURN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
    body = escape(text)
    out = head + body + END
    return (out, len(head), len(head) + len(body)) if role == "assistant" else (out, 0, 0)


def parse(chunk: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    i = len(TURN)
    while chunk[i] != "\n":
        i += 2 if chunk[i] == "\\" else 1
    return unescape(chunk[len(TURN) : i]), unescape(chunk[i + 1 : len(chunk) - len(END)])


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, loss_start, loss_end): the rendered turns, each conversation in order in one partition.

    Chunks of a conversation, joined, are its formatted text; spans are code points within the chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            made = [render(r, t) for r, t in rows_of(batch, "role", "text")]
            yield {"conv_id": batch.column("conv_id"), "chunk": [m[0] for m in made], "loss_start": [m[1] for m in made], "loss_end": [m[2] for m in made]}

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_arrow(ordered, run, "conv_id long, chunk string, loss_start long, loss_end long")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted chunks: counts and digests of turns and loss text."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for conv, chunk, start, end in rows_of(batch, "conv_id", "chunk", "loss_start", "loss_end"):
                if state is None or conv != now:
                    if state:
                        done.append(_closed(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(chunk)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(chunk[start:end])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(chunk)
            if done:
                yield dict(zip(names, zip(*done, strict=True), strict=True))
                done = []
        if state:
            yield dict(zip(names, zip(_closed(now, state), strict=True), strict=True))

    return map_arrow(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _closed(conv, state: list) -> tuple:
    return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts are control strings; as records of mixed layouts, told apart by fingerprint."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-1, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    records = records_of_turns(rows.unionByName(odd))
    return digests(format_turns(turns_of_records(records, turn="turn")))


#: What doesn't depend on the template, in SQL; formatted_chars is the template's own.
SQL_WITHOUT_FORMAT = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256
FROM c GROUP BY conv_id
"""
#: The template's own characters, marks and escapes, in SQL.
SQL = SQL_WITHOUT_FORMAT.replace(
    "AS loss_sha256",
    r"""AS loss_sha256,
  sum(length(role) + length(text) + 17
    + len(regexp_extract_all(text, '\\|<\|[^|<>\s]{1,40}\|>|</?s>|\[/?INST\]|<</?SYS>>|</?(?:bos|eos|pad|unk)>|<(?:start|end)_of_turn>'))
    + len(regexp_extract_all(role, '\\|\n|<\|[^|<>\s]{1,40}\|>|</?s>|\[/?INST\]|<</?SYS>>|</?(?:bos|eos|pad|unk)>|<(?:start|end)_of_turn>')))::BIGINT AS formatted_chars""",
)
