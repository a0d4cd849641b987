"""The whole way from raw messages to records, and on to prompt text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailframe import schema
from mailframe.functions import text as t
from mailframe.operators.cta import primary_cta
from mailframe.operators.html import FIELDS, read_html
from mailframe.operators.mime import decode_message
from mailframe.operators.quotes import strip_quotes
from mailframe.operators.render import to_llm_context
from mailframe.operators.signature import extract_signature
from mailframe.operators.thread import thread_messages
from mailframe.schema import PreprocessOptions


def _checked(df: DataFrame, mode: str) -> DataFrame:
    """df with a MIME struct _m, after the mode's treatment of messages that did not parse."""
    if mode == schema.FAILFAST:
        return df.filter(F.when(F.col("_m.error").isNull(), True).otherwise(F.raise_error(F.col("_m.error"))))
    if mode == schema.DROPMALFORMED:
        return df.filter(F.col("_m.error").isNull())
    if mode == schema.PERMISSIVE:
        return df
    raise ValueError(f"no such mode: {mode}")


def preprocess(df: DataFrame, content: str | Column = "content", options: PreprocessOptions | None = None, mode: str = schema.FAILFAST, fields: tuple[str, ...] = schema.RECORD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of the messages in a binary or string column of df, batch or stream.

    keep: columns of df to carry along. fields: the record's columns to make; what only others need is not computed.
    mode FAILFAST raises at a message without headers, DROPMALFORMED leaves it out, and PERMISSIVE gives a row
    of nulls with column _corrupt saying why.
    """
    options = options or PreprocessOptions()
    raw = F.col(f"`{content}`") if isinstance(content, str) else content
    column = df.select(raw.alias("c")).schema["c"].dataType.typeName()
    if column == "string":
        raw = F.encode(raw, "UTF-8")
    rows = _checked(df.select(*[F.col(f"`{k}`") for k in keep], decode_message(raw).alias("_m")), mode)

    wanted = set(fields)
    needs = {"markdown": {"body", "signature", "raw_body_length", "clean_body_length"}, "links": {"primary_cta"}, "jsonld": {"primary_cta"}, "quotes": {"thread_messages"}}
    ask = tuple(f for f in FIELDS if needs[f] & wanted)
    if ask:
        rows = rows.select("*", read_html(t.clean_invisible(F.col("_m.html")), ask).alias("_h"))
    made: dict[str, Column] = {k: F.col(f"_m.{k}") for k in ("subject", "from", "to", "cc", "date", "rfc_message_id", "in_reply_to", "references")}
    if "markdown" in ask:
        rows = rows.select("*", t.clean_invisible(F.coalesce(F.col("_h.markdown"), F.col("_m.text"), F.lit(""))).alias("_raw"))
        rows = rows.select("*", (strip_quotes(F.col("_raw")) if options.strip_quotes else F.col("_raw")).alias("_body"))
        if options.strip_signature:
            rows = rows.select("*", extract_signature(F.col("_body")).alias("_s"))
        else:
            rows = rows.select("*", F.struct(F.col("_body").alias("text"), F.lit(None).cast("string").alias("signature")).alias("_s"))
        rows = rows.select("*", t.truncate(t.tidy(F.col("_s.text")), options.max_body_length).alias("_clean"))
        made |= {"body": F.col("_clean"), "signature": F.col("_s.signature"), "raw_body_length": t.byte_length(F.col("_raw")), "clean_body_length": t.byte_length(F.col("_clean"))}
    if "links" in ask:
        made["primary_cta"] = primary_cta(F.col("_h"))
    if "quotes" in ask:
        made["thread_messages"] = F.coalesce(thread_messages(F.col("_h.quotes")), F.array().cast(f"array<{schema.THREAD_MESSAGE.simpleString()}>"))
    out = [*(F.col(f"`{k}`") for k in keep), *(made[f].alias(f) for f in fields)]
    if mode == schema.PERMISSIVE:
        good = F.col("_m.error").isNull()
        out = [*(F.col(f"`{k}`") for k in keep), *(F.when(good, made[f]).alias(f) for f in fields), F.col("_m.error").alias("_corrupt")]
    return rows.select(*out)


def with_llm_context(records: DataFrame, mode: str | int = schema.LATEST_ONLY, name: str = "llm_context") -> DataFrame:
    return records.withColumn(name, to_llm_context(mode=mode))


#: Names of record columns in the camelCase form of the JSON output.
def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.title() for x in rest)


def to_json(fields: tuple[str, ...] = schema.RECORD) -> Column:
    """The record in top-level columns as JSON in camelCase; thread messages are left out when there are none."""
    value = {f: F.col(f"`{f}`") for f in fields}
    if "thread_messages" in value:
        value["thread_messages"] = F.when(F.size("thread_messages") > 0, F.col("thread_messages"))
    return F.to_json(F.struct(*(c.alias(_camel(f)) for f, c in value.items())))
