"""Slices of documents, and questions that slices ask the owners of ranges of hash values, all as packed binary columns.

Every slice asks nearly every range, so the messages are as many as slices times ranges. So that they stay long, slices and ranges
grow with the square root of the corpus (growth) once a message would hold fewer than MESSAGE values; the most that a task holds grows alike.

Defined cases: no rows give no slices and no questions; a slice without values asks nothing; null ids and repeated rows stay as they are in a
slice; texts must not be null.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from mailframe.llm import textops
from mailframe.llm.common import sorted_groups


MESSAGE = 32


def growth(total: float, of_slice: float, of_range: float, message: int = MESSAGE) -> float:
    """By how much slices and ranges, that hold so many of total values, must grow for messages of that many values on average; 1 at least."""
    return max(1.0, (message * total / (of_slice * of_range)) ** 0.5)


def dealt(df: DataFrame, key: str, tasks: float) -> DataFrame:
    """df by key, to the session's number of partitions, or to as many as there must be tasks if these are more."""
    most = int(tasks)
    return df.repartition(most, key) if most > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(key)


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values, byte planes apart, compressed."""
    planes = np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def slices(docs: DataFrame, slice_bytes: int, row_bytes: int | None = None) -> DataFrame:
    """slice, n_bytes, packed: documents in slices of about slice_bytes, as compressed Arrow.

    A slice is named by its task and its place there, so a task that runs again makes the same slices. With row_bytes
    a slice comes in rows of about that many bytes, as large rows weigh on the JVM's heap; else in one.
    """
    row_bytes = min(row_bytes or slice_bytes, slice_bytes)

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        size = whole = made = 0
        task = TaskContext.get().partitionId()

        def told():
            table = pa.Table.from_batches(held)
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table.combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([f"{task}-{made}"]), pa.array([size], pa.int64()), pa.array([zstandard.compress(sink.getvalue(), 9)], pa.binary())], names=["slice", "n_bytes", "packed"])

        for batch in batches:
            for b in textops.slices(batch, most=max(1, row_bytes // 8)):
                held.append(b)
                size += b["text"].nbytes
                if size >= row_bytes:
                    yield told()
                    held, size, whole = [], 0, whole + size
                if whole >= slice_bytes:
                    whole, made = 0, made + 1
        if held:
            yield told()

    return docs.mapInArrow(run, "slice string, n_bytes long, packed binary")


def count_words(docs: DataFrame) -> int:
    """Words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]):
        n = sum(int(textops.words(b["text"])[1][-1]) for batch in batches for b in textops.slices(batch))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return docs.select("text").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0


def opened(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(packed)).read_all().combine_chunks()


def bounds(ranges: int) -> np.ndarray:
    """The values that part all hashes in ranges of equal width."""
    return np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)


def segments(values: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of sorted values, for the ranges that have some."""
    cuts = [0, *np.searchsorted(values, bounds(ranges)).tolist(), len(values)]
    for r, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if hi > lo:
            yield r, lo, hi


def question(name: str, r: int, values: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One slice's question to one range: sorted values and how often the slice has each."""
    step = np.diff(values, prepend=np.uint64(0))
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([r], pa.int32()), pa.array([pack(step)], pa.binary()), pa.array([pack(counts)], pa.binary())], names=["slice", "range", "values", "counts"])


QUESTION = "slice string, range int, values binary, counts binary"
QUESTION_SCHEMA = pa.schema([("slice", pa.string()), ("range", pa.int32()), ("values", pa.binary()), ("counts", pa.binary())])


def totals(questions: DataFrame, tasks: float = 0) -> DataFrame:
    """slice, range, totals: the corpus counts of what each slice asked, in the order it asked; tasks as for dealt.

    A task holds the values that slices asked of one range, which the number of ranges bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for group in sorted_groups(batches, ["range"]):
            values = [np.cumsum(unpack(x), dtype=np.uint64) for x in group["values"].to_pylist()]
            counts = np.concatenate([unpack(x) for x in group["counts"].to_pylist()])
            size = np.cumsum([len(v) for v in values])[:-1]
            flat = np.concatenate(values)
            del values
            order = np.argsort(flat)
            flat = flat[order]
            new = np.concatenate([[True], flat[1:] != flat[:-1]])
            total = np.add.reduceat(counts[order], np.flatnonzero(new))
            back = np.empty_like(counts)
            back[order] = total[np.cumsum(new) - 1]
            for name, r, part in zip(group["slice"].to_pylist(), group["range"].to_pylist(), np.split(back, size), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([r], pa.int32()), pa.array([pack(part)], pa.binary())], names=["slice", "range", "totals"])

    return dealt(questions, "range", tasks).sortWithinPartitions("range").mapInArrow(run, "slice string, range int, totals binary")
