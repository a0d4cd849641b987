"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_HOT, LEAST_HOT = 1000, 200


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that driver and executors share.

    The cluster names it in spark.checkpoint.dir; only where that is unset and all runs in this process (tests) is one made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="mailframe-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: survives the loss of executors and cuts lineage."""
    path = path or shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing will read again."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case of letters."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def hot_join(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """left join right on a key that many rows of left may have; right: a row for each key, n of them the rows of left with it.

    Keys with more than 2 * total / MOST_HOT rows, total being the sum of n, are fewer than MOST_HOT: those rows of right are
    broadcast, and the rows of left stay where they are. All others meet by a shuffle in which no key is hot.
    """
    bound = max(LEAST_HOT, 2 * total // MOST_HOT)
    hot = F.broadcast(right.filter(F.col("n") > bound).drop("n"))
    rest = left.join(F.broadcast(right.filter(F.col("n") > bound).select(key)), key, "left_anti").join(right.drop("n"), key, how)
    return left.join(hot, key).unionByName(rest)


def release_memory() -> None:
    """Give memory that freed arrays left in the allocators back to the system; a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys from batches that come sorted by them; only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None

    def key_at(b: pa.RecordBatch, i: int):
        return tuple(b.column(b.schema.get_field_index(k))[i].as_py() for k in keys)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for k in keys:
            v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), n]
        first = key_at(batch, 0)
        for a, b in zip(starts, starts[1:], strict=False):
            if a or (held and first != last):
                if held:
                    yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = key_at(batch, n - 1)
    if held:
        yield pa.Table.from_batches(held)
