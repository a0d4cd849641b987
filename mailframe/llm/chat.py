"""Chat formatting: typed content parts become one training string per conversation, with a loss mask.

A visitor flattens the parts of a turn in order: text is escaped, an image, audio clip or document leaves a
placeholder, an attachment reference and the number of tokens that a model expands it to. The rows of a
conversation are dealt to one task and streamed in turn order, so memory is bounded by a single turn; the
formatted string of a conversation is the concatenation of its segments in order.

Defined cases: a null text is empty; a null role is empty; turns with equal number go by role, then text;
repeated rows are turns of their own; a null conversation id is a conversation; an unknown part type is text;
an empty table gives no rows; other columns are ignored.
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

OPEN, CLOSE = "### ", "</turn>\n"
_ESCAPE = re.compile(r"[\\#<]")
_ESCAPE_ROLE = re.compile(r"[\\#<:]")
_HEAD = re.compile(r"((?:\\.|[^\\:])*):\n", re.S)
_UNESCAPE = re.compile(r"\\(.)", re.S)
_SPECIAL = re.compile(r"\\.|### |</turn>\n|<\|([a-z]+):(\d+)\|>", re.S)


def escape(text: str) -> str:
    """Every backslash, # and < gets a backslash before it, so no control string can occur in a text."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


@dataclass
class Flattener:
    """Visitor over typed parts; attachments are numbered through the conversation."""

    patch: int = 28
    audio_rate: int = 25
    page_tokens: int = 512
    seen: int = 0
    attachments: list[tuple[int, str, str, int]] = field(default_factory=list)
    tokens: int = 0

    def visit(self, part: dict) -> str:
        return getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        n = math.ceil((part.get("width") or 1) / self.patch) * math.ceil((part.get("height") or 1) / self.patch)
        return self._placeholder("image", part, n)

    def visit_audio(self, part: dict) -> str:
        return self._placeholder("audio", part, max(1, math.ceil((part.get("seconds") or 0) * self.audio_rate)))

    def visit_document(self, part: dict) -> str:
        return self._placeholder("document", part, max(1, part.get("pages") or 1) * self.page_tokens)

    def _placeholder(self, kind: str, part: dict, n: int) -> str:
        i = self.seen
        self.seen += 1
        self.tokens += n
        self.attachments.append((i, kind, part.get("ref") or "", n))
        return f"<|{kind}:{i}|>"


PART = "type string, text string, ref string, width int, height int, seconds double, pages int"
SEGMENTS = (
    "conv_id long, seq long, segment string, loss_start long, loss_end long, "
    "attachments array<struct<position: long, kind: string, ref: string, tokens: long>>, expanded_tokens long"
)


def text_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """Each text as a turn of one text part."""
    null = {k: F.lit(None).cast(t) for k, t in (x.strip().split(" ") for x in PART.split(",")[2:])}
    part = F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(v.alias(k) for k, v in null.items()))
    return df.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def _dealt(df: DataFrame) -> DataFrame:
    order = [F.col("turn"), F.coalesce(F.col("role"), F.lit("")), F.to_json("parts")]
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, int | None, str, list[dict]]]:
    last: object = _turns
    for b in batches:
        for conv, role, parts in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["parts"].to_pylist(), strict=True):
            yield conv != last, conv, role or "", parts or []
            last = conv


def _segment(flat: Flattener, role: str, parts: list[dict], trained: frozenset[str]) -> tuple[str, int, int]:
    """The string of one turn, and the span in it under the loss mask (empty: equal ends)."""
    head = f"{OPEN}{_ESCAPE_ROLE.sub(lambda m: chr(92) + m[0], role)}:\n"
    body = "".join(map(flat.visit, parts))
    at = len(head)
    return head + body + CLOSE, at, at + len(body) if role in trained else at


def format_chat(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn (conv_id, turn, role, parts) to one segment per turn, in order by seq."""
    roles = frozenset(trained)

    def run(batches):
        flat, seq, out = Flattener(), 0, []
        schema = pa.schema([
            ("conv_id", pa.int64()), ("seq", pa.int64()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()),
            ("attachments", pa.list_(pa.struct([("position", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))), ("expanded_tokens", pa.int64()),
        ])
        for new, conv, role, parts in _turns(batches):
            if new:
                flat, seq = Flattener(), 0
            flat.attachments, flat.tokens = [], 0
            text, a, b = _segment(flat, role, parts, roles)
            out.append({"conv_id": conv, "seq": seq, "segment": text, "loss_start": a, "loss_end": b, "attachments": [dict(zip(("position", "kind", "ref", "tokens"), x, strict=True)) for x in flat.attachments], "expanded_tokens": flat.tokens})
            seq += 1
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return _dealt(turns).mapInArrow(run, SEGMENTS)


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn, unescaped; placeholders stay as they are."""
    if not segment.startswith(OPEN) or not segment.endswith(CLOSE):
        raise ValueError("not a formatted turn")
    for m in _SPECIAL.finditer(segment, len(OPEN)):
        if m[0] == CLOSE and m.end() != len(segment) or m[0] == OPEN:
            raise ValueError("a control string inside a turn")
    body = segment[len(OPEN) : -len(CLOSE)]
    head = _HEAD.match(body)
    if not head:
        raise ValueError("a turn without a role")
    return unescape(head[1]), unescape(body[head.end() :])


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long, n_attachments long"


def digest(segments: DataFrame) -> DataFrame:
    """Read formatted conversations back: parse every segment, undo the escapes, follow the loss mask.

    Takes the output of format_chat as it is dealt: a conversation in one partition, segments in order.
    """

    def run(batches):
        state: dict = {}

        def close():
            return {"conv_id": state["conv"], "n_turns": state["n"], "turns_sha256": state["t"].hexdigest(), "loss_chars": state["lc"], "loss_sha256": state["l"].hexdigest(), "formatted_chars": state["fc"], "expanded_tokens": state["x"], "n_attachments": state["a"]}

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("expanded_tokens", pa.int64()), ("n_attachments", pa.int64())])
        out = []
        for b in batches:
            for r in b.to_pylist():
                if r["seq"] == 0:
                    if state:
                        out.append(close())
                    state = {"conv": r["conv_id"], "n": 0, "t": hashlib.sha256(), "l": hashlib.sha256(), "lc": 0, "fc": 0, "x": 0, "a": 0}
                role, text = parse_segment(r["segment"])
                masked = unescape(r["segment"][r["loss_start"] : r["loss_end"]])
                state["n"] += 1
                state["t"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state["l"].update(masked.encode("utf-8", "surrogatepass"))
                state["lc"] += len(masked)
                state["fc"] += len(r["segment"])
                state["x"] += r["expanded_tokens"]
                state["a"] += len(r["attachments"])
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if state:
            out.append(close())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return segments.mapInArrow(run, DIGEST)
