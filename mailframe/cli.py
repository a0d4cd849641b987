"""Anonymize one message file: python -m mailframe.cli input.eml [output.eml].

Without an output the file is named by operators.anonymize.output_path (name.anon.eml) beside the input. Exit code 1, and a line on the
standard error, where the argument or the file is missing. Trees of messages go through operators.anonymize.anonymize_files instead.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mailframe.operators.anonymize import anonymize_eml, output_path

USAGE = "Usage: python -m mailframe.cli <input.eml> [output.eml]"


def anonymize_file(spark: SparkSession, source: Path, target: Path | None = None) -> Path:
    """Write the anonymized message, and give the path of its file. Bytes that are no UTF-8 are read as replacement characters."""
    rows = spark.createDataFrame([(str(source), source.read_bytes().decode("utf-8", "replace"))], "path string, raw string")
    [done] = anonymize_eml(rows.withColumn("path", output_path(F.col("path"))), F.col("raw"), ("path",)).collect()
    target = target or Path(done["path"])
    target.write_bytes(done["anonymized"].encode())
    return target


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    if not args:
        print(USAGE, file=sys.stderr)
        return 1
    source, target = Path(args[0]).resolve(), Path(args[1]).resolve() if len(args) > 1 else None
    if not source.is_file():
        print(f"Error: file not found: {source}", file=sys.stderr)
        return 1
    spark = SparkSession.getActiveSession() or SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    target = anonymize_file(spark, source, target)
    print(f"Anonymized: {source.name} -> {target.name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
