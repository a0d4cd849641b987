"""Records from a stream of messages: every operator works row by row, so streams run the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mailframe.operators.preprocess import preprocess
from mailframe.schema import DROPMALFORMED, PreprocessOptions


def records(messages: DataFrame, content: str = "content", options: PreprocessOptions | None = None, mode: str = DROPMALFORMED, keep: tuple[str, ...] = ()) -> DataFrame:
    """A stream must outlive one bad message, so by default such messages are left out."""
    return preprocess(messages, content, options, mode, keep=keep)


def write(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append records as Parquet, exactly once; once: all that is there, then stop."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
