"""Sources of raw messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_eml(spark: SparkSession, path: str, glob: str = "*.eml") -> DataFrame:
    """path, modificationTime, length, content of message files below path.

    Many small files are best read once and written as Parquet; what follows takes any table with such a column.
    """
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def stream_eml(spark: SparkSession, path: str, glob: str = "*.eml", per_trigger: int = 1000) -> DataFrame:
    """The same as a stream of files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(path)


def from_strings(df: DataFrame, column: str) -> DataFrame:
    """df with column content: the UTF-8 bytes of a text column."""
    return df.withColumn("content", F.encode(F.col(column), "UTF-8"))
