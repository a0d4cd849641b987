"""Message by message: the same pipeline for a few messages at hand, with plain Python records.

Tables and streams are what the engine is for (operators.preprocess); this is for scripts and for trying things out.
"""

from __future__ import annotations

import enum
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Row, SparkSession

from mailframe.operators import preprocess as table
from mailframe.schema import PARSE_FAILED, PERMISSIVE, THREAD_HISTORY, ParseError, PreprocessOptions, render_mode

__all__ = ["Address", "CallToAction", "LlmContextOptions", "ParseError", "PreprocessOptions", "ProcessedEmail", "RenderMode", "ThreadMessage", "preprocess", "preprocess_many", "preprocess_string", "preprocess_with_options", "to_llm_context", "to_llm_context_with_options"]


class RenderMode(enum.IntEnum):
    LatestOnly = 0
    ThreadHistory = 1


@dataclass
class LlmContextOptions:
    render_mode: RenderMode | str = RenderMode.LatestOnly

    def __repr__(self) -> str:
        chosen = RenderMode.ThreadHistory if render_mode(self.render_mode) == THREAD_HISTORY else RenderMode.LatestOnly
        return f"LlmContextOptions(render_mode={chosen.name})"


@dataclass(frozen=True)
class Address:
    name: str | None
    email: str

    def __str__(self) -> str:
        return self.email if self.name is None else f"{self.name} <{self.email}>"

    def __repr__(self) -> str:
        name = "" if self.name is None else f"name='{self.name}', "
        return f"Address({name}email='{self.email}')"


@dataclass(frozen=True)
class CallToAction:
    url: str
    text: str
    confidence: float

    def __repr__(self) -> str:
        return f"CallToAction(url='{self.url}', text='{self.text}', confidence={self.confidence:.2f})"


@dataclass(frozen=True)
class ThreadMessage:
    sender: str
    timestamp: str | None
    body: str

    def __repr__(self) -> str:
        when = "None" if self.timestamp is None else f'Some("{self.timestamp}")'
        return f"ThreadMessage(sender='{self.sender}', timestamp={when}, body=({len(self.body.encode())} chars))"


@dataclass(frozen=True)
class ProcessedEmail:
    body: str
    subject: str | None
    from_address: Address | None
    to: list[Address]
    cc: list[Address]
    date: str | None
    rfc_message_id: str | None
    in_reply_to: list[str] | None
    references: list[str] | None
    signature: str | None
    raw_body_length: int
    clean_body_length: int
    primary_cta: CallToAction | None
    thread_messages: list[ThreadMessage] = field(default_factory=list)

    def __repr__(self) -> str:
        return f"ProcessedEmail(subject='{self.subject or ''}', body=({self.clean_body_length} chars))"


def _record(r: Row) -> ProcessedEmail:
    person = lambda a: Address(a["name"], a["email"])
    plain = {k: r[k] for k in ("body", "subject", "date", "rfc_message_id", "in_reply_to", "references", "signature", "raw_body_length", "clean_body_length")}
    return ProcessedEmail(
        **plain,
        from_address=person(r["from"]) if r["from"] else None,
        to=[person(a) for a in r["to"]],
        cc=[person(a) for a in r["cc"]],
        primary_cta=CallToAction(*r["primary_cta"]) if r["primary_cta"] else None,
        thread_messages=[ThreadMessage(*m) for m in r["thread_messages"]],
    )


def preprocess_many(messages: Iterable[bytes], options: PreprocessOptions | None = None, spark: SparkSession | None = None) -> list[ProcessedEmail | ParseError]:
    """Records in the order of the messages; an error object stands for a message that does not parse."""
    spark = spark or SparkSession.builder.getOrCreate()
    rows = spark.createDataFrame(list(enumerate(messages)), "i long, content binary")
    done = table.preprocess(rows, options=options, mode=PERMISSIVE, keep=("i",)).collect()
    return [ParseError(r["_corrupt"]) if r["_corrupt"] else _record(r) for r in sorted(done, key=lambda r: r.i)]


def preprocess_with_options(raw: bytes, options: PreprocessOptions | None = None) -> ProcessedEmail:
    [found] = preprocess_many([raw], options)
    if isinstance(found, ParseError):
        raise ParseError(PARSE_FAILED)
    return found


def preprocess(raw: bytes) -> ProcessedEmail:
    return preprocess_with_options(raw)


def preprocess_string(raw: str) -> ProcessedEmail:
    return preprocess_with_options(raw.encode())


def to_llm_context_with_options(email: ProcessedEmail, options: LlmContextOptions | None = None) -> str:
    """The text that operators.render makes of a record's columns."""
    out = [f"FROM: {email.from_address}"] if email.from_address else []
    if email.to:
        out.append("TO: " + ", ".join(map(str, email.to)))
    out += [f"{label}: {v}" for label, v in (("SUBJECT", email.subject), ("DATE", email.date)) if v is not None]
    text = "\n".join([*out, "CONTENT:", email.body])
    if email.thread_messages and render_mode((options or LlmContextOptions()).render_mode) == THREAD_HISTORY:
        turns = (f"[{m.timestamp or '?'}] {m.sender}\n{m.body}" for m in email.thread_messages)
        text += "\n\n---\n\nTHREAD HISTORY:\n\n" + "\n\n---\n\n".join(turns)
    return text


def to_llm_context(email: ProcessedEmail) -> str:
    return to_llm_context_with_options(email)
