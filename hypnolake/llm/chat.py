"""Chat formatting with typed content parts.

A turn holds parts: text, image, audio or document. A visitor flattens them, in order, into one string: text is escaped, every
other part becomes a placeholder, and its reference, place and the number of tokens that the placeholder stands for are
recorded. Control strings inside texts and roles are broken up by a backslash, reversibly, so the markers of the
template are the only ones a tokenizer can see.

Turns are dealt by conversation and sorted inside the partitions; formatting and reading back stream over them with the running
offset (or digest) of one conversation as their only state, so neither a long conversation nor a frequent one is gathered.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
_CONTROL = re.compile(r"\\|<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])")
_BROKEN = re.compile(r"\\(\\?)")
_BROKEN_ROLE = re.compile(r"\\([\\n]?)")
_TURN = re.compile(re.escape(START) + "(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
PARTS = "array<struct<type:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>>"
ATTACHMENTS = "array<struct<kind:string,ref:string,position:long,tokens:long>>"
FORMATTED = f"conv_id long, turn long, role string, formatted string, position long, loss_start long, loss_chars long, attachments {ATTACHMENTS}"
_ATTACHMENT = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("position", pa.int64()), ("tokens", pa.int64())]))
_FORMATTED = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("position", pa.int64()),
    ("loss_start", pa.int64()), ("loss_chars", pa.int64()), ("attachments", _ATTACHMENT),
])
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"
FLUSH_CHARS = 4_000_000


def escape(text: str) -> str:
    """Break up control strings: a backslash after their first character; own backslashes are doubled."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _BROKEN.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _BROKEN_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


class PartVisitor:
    """Renders the parts of one turn; ``attachments`` are (kind, ref, place in the rendered text, tokens)."""

    def __init__(self, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 256):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens

    def render(self, parts: list[dict]) -> tuple[str, list[tuple]]:
        out: list[str] = []
        attachments: list[tuple] = []
        at = 0
        for part in parts:
            kind = (part or {}).get("type") or "text"
            if kind in PLACEHOLDERS:
                piece = PLACEHOLDERS[kind]
                attachments.append((kind, part.get("ref"), at, getattr(self, f"visit_{kind}")(part)))
            else:
                piece = self.visit_text(part or {})
            out.append(piece)
            at += len(piece)
        return "".join(out), attachments

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> int:
        return math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch)

    def visit_audio(self, part: dict) -> int:
        return math.ceil((part.get("seconds") or 0.0) * self.audio_rate)

    def visit_document(self, part: dict) -> int:
        return (part.get("pages") or 0) * self.page_tokens


def format_chat(turns: DataFrame, parts_col: str | None = None, visitor: PartVisitor | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, text; typed parts in ``parts_col`` where given), in order.

    ``formatted`` pieces of a conversation, joined in order of ``position`` (code points before), are its text. The span
    (loss_start, loss_chars) of the conversation is under the loss mask. Attachments carry kind, reference, place, expanded tokens.
    Null text, role or parts are empty; rows with null conv_id form one conversation; null turns come first; rows of the same turn are
    ordered by role and text, equal rows stay; an empty table gives none; other columns are not read.
    """
    visit = visitor or PartVisitor()
    parts = F.col(parts_col).cast(PARTS) if parts_col else F.lit(None).cast(PARTS)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), parts.alias("parts"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at = object(), 0
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for conv, turn, role, text, given in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != current:
                    current, at = conv, 0
                body, attachments = visit.render(given if given is not None else [{"type": "text", "text": text}])
                head = f"{START}{escape_role(role)}\n"
                piece = f"{head}{body}{END}\n"
                first = at + len(head)
                masked = len(body) if role == loss_role else 0
                found = [{"kind": k, "ref": r, "position": first + p, "tokens": n} for k, r, p, n in attachments]
                out.append((conv, turn, role, piece, at, first, masked, found))
                at += len(piece)
                held += len(piece)
                if held >= FLUSH_CHARS:
                    yield _batch(out, _FORMATTED)
                    out, held = [], 0
        if out:
            yield _batch(out, _FORMATTED)

    return rows.mapInArrow(run, FORMATTED)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says: turns, masked text and their digests.

    ``formatted`` is what ``format_chat`` returns, as it is dealt and sorted. Only the text and the mask are read: role, turn text and
    masked text are parsed from them.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("expanded_tokens", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def done():
            conv, n, turns, chars, loss, size, count, tokens = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, count, tokens)

        for batch in batches:
            out = []
            for conv, piece, at, first, masked, found in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(done())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                turn = _TURN.fullmatch(piece)
                state[1] += 1
                state[2].update(f"{unescape_role(turn[1])}\n{unescape(turn[2])}\n".encode())
                text = unescape(piece[first - at : first - at + masked])
                state[3] += len(text)
                state[4].update(text.encode())
                state[5] += len(piece)
                state[6] += len(found)
                state[7] += sum(x["tokens"] for x in found)
            if out:
                yield _batch(out, schema)
        if state is not None:
            yield _batch([done()], schema)

    return formatted.select("conv_id", "formatted", "position", "loss_start", "loss_chars", "attachments").mapInArrow(run, READ)


_ESCAPED = (
    r"replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), "
    r"'<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"
)
SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length({_ESCAPED}) + length(role) + {len(START) + len(END) + 2}) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM turns GROUP BY conv_id
"""


@query("op10_chat", SQL)
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings alone, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chat(turns.unionByName(extra)))
