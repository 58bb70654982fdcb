r"""Chat formatting with typed content parts.

A message has a role and ordered parts: text, image, audio or document.  A visitor flattens the parts
into the template's text; each attachment becomes a numbered placeholder, and its reference and the
number of tokens it expands to are recorded.  The template of a turn is

    <turn>ROLE\nCONTENT</turn>\n

In roles and texts ``\`` becomes ``\\`` and ``<`` becomes ``\<`` (in roles also a line feed ``\n``),
so that a bare ``<`` is always the template's own and every text can be read back.

The output holds conversations in fragments of at most ``turns`` turns, ordered by ``(part, seq)``.
A fragment's loss spans are the contents of assistant turns, in code points of the fragment.

Scale: rows are dealt by ranges of (conversation, turn), so one huge conversation is formatted by many
tasks.  Only its digest, which is sequential by nature, streams through one task, fragment by fragment.

Turns are ordered by ``turn`` (null first), then role, then a hash of the content, so ties and repeated
rows have one result; null roles and texts count as empty, null parts are skipped, an unknown kind of
part raises.  Null conversation ids form a conversation of their own.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.reduce import task_number

OPEN, CLOSE = "<turn>", "</turn>\n"
TURN = re.compile(r"<turn>((?:[^\\<\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?:image|audio|document) \d+>)*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_TEMPLATE = re.compile(r"\\(.)|<(?:image|audio|document) \d+>", re.S)

PART = "struct<kind: string, text: string, uri: string, width: int, height: int, seconds: double, pages: int>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(content: str) -> str:
    """The text of a turn's content, without placeholders."""
    return _TEMPLATE.sub(lambda m: m[1] or "", content)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


@dataclass
class Flattener:
    """Visits the parts of one message; attachments are numbered on from ``first``."""

    first: int = 0
    patch: int = 14
    audio_rate: float = 25.0
    page_tokens: int = 256
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part['kind']}", self.unknown)(part)

    def unknown(self, part: dict) -> None:
        raise ValueError(f"unknown kind of content part: {part['kind']!r}")

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil((part["width"] or 0) / self.patch) * math.ceil((part["height"] or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part["seconds"] or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part["pages"] or 0) * self.page_tokens)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        number = self.first + len(self.attachments)
        self.pieces.append(f"<{kind} {number}>")
        self.attachments.append({"number": number, "kind": kind, "uri": part["uri"], "tokens": tokens})

    @property
    def content(self) -> str:
        return "".join(self.pieces)


FRAGMENTS = "conv_id long, part int, seq int, n_turns int, formatted string, loss array<struct<start: int, stop: int>>, attachments array<struct<number: int, kind: string, uri: string, tokens: int>>"
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_ATTACHMENT = pa.struct([("number", pa.int32()), ("kind", pa.string()), ("uri", pa.string()), ("tokens", pa.int32())])
_FRAGMENTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("n_turns", pa.int32()), ("formatted", pa.string()), ("loss", pa.list_(_SPAN)), ("attachments", pa.list_(_ATTACHMENT))])


def text_parts(text_col: str = "text") -> F.Column:
    """One text part from a string column."""
    null = {"uri": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(k) for k, t in null.items())))


def format_chat(messages: DataFrame, turns: int = 64, learn_role: str = "assistant") -> DataFrame:
    """Fragments of ``messages``: conv_id, turn, role and ``parts``, an array of ``PART``.

    Attachments are numbered within a fragment.
    """
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("content_hash").asc()]
    picked = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "parts", F.xxhash64("parts").alias("content_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = task_number(), 0
        held: dict = {}

        def close() -> pa.RecordBatch:
            row = {"conv_id": held["conv_id"], "part": part, "seq": seq, "n_turns": held["n"], "formatted": "".join(held["text"]), "loss": held["loss"], "attachments": held["attachments"]}
            return pa.RecordBatch.from_pylist([row], schema=_FRAGMENTS)

        for batch in batches:
            for conv_id, role, parts in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "parts")), strict=True):
                if held and (held["conv_id"] != conv_id or held["n"] == turns):
                    yield close()
                    seq, held = seq + 1, {}
                if not held:
                    held = {"conv_id": conv_id, "n": 0, "length": 0, "text": [], "loss": [], "attachments": []}
                visitor = Flattener(first=len(held["attachments"]))
                for p in parts or ():
                    visitor.visit(p)
                head = f"{OPEN}{escape_role(role or '')}\n"
                start = held["length"] + len(head)
                if role == learn_role:
                    held["loss"].append({"start": start, "stop": start + len(visitor.content)})
                held["text"] += [head, visitor.content, CLOSE]
                held["length"] = start + len(visitor.content) + len(CLOSE)
                held["attachments"] += visitor.attachments
                held["n"] += 1
        if held:
            yield close()

    return picked.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "role", "parts").mapInArrow(run, FRAGMENTS)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted fragment; placeholders are no text."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def digests(fragments: DataFrame) -> DataFrame:
    """Per conversation, from its fragments: turn and loss digests and lengths."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("attachment_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def close() -> pa.RecordBatch:
            row = {k: v.hexdigest() if k.endswith("sha256") else v for k, v in state.items()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for conv_id, formatted, loss, attachments in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss", "attachments")), strict=True):
                if state and state["conv_id"] != conv_id:
                    yield close()
                    state = {}
                if not state:
                    state = {"conv_id": conv_id, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0, "n_attachments": 0, "attachment_tokens": 0}
                for role, text in parse(formatted):
                    state["n_turns"] += 1
                    state["turns_sha256"].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescape(formatted[span["start"] : span["stop"]])
                    state["loss_chars"] += len(text)
                    state["loss_sha256"].update(text.encode())
                state["formatted_chars"] += len(formatted)
                state["n_attachments"] += len(attachments)
                state["attachment_tokens"] += sum(a["tokens"] for a in attachments)
        if state:
            yield close()

    keys = [F.col("conv_id").asc_nulls_first(), "part", "seq"]
    ordered = fragments.select("conv_id", "part", "seq", "formatted", "loss", "attachments").repartition("conv_id").sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long")


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(replace(replace(replace(role, '\', '\\'), '<', '\<'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<', '\<'))) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens
FROM rows GROUP BY conv_id
"""
