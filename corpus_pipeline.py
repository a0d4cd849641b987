"""A training corpus from documents in five stages; each takes all that the stage before it kept.

1. language_id: documents without a language, or with a score under MIN_SCORE, go.
2. ngram_jaccard_join: one document of each near-duplicate class stays.
3. benchmark_decontamination: documents that hold a benchmark item within its error budget go.
4. mixing_weights: documents get places in an order in which sources follow their target weights, as columns; all stay.
5. sharding: documents are sorted by these places, appended as small shards and compacted by neighbours: shards by `first` of the
   manifest, and rows in them, are in the mixed order. The rows that the committed version holds, with the shard of each.

Defined cases: null, empty and letterless texts go in stage 1; documents of null id or source stay as any others; of rows that repeat id and
text, and of copies, one stays (the smallest id, null ids last); an empty table gives no rows; an empty benchmark removes nothing; other columns
stay, whatever their names, but the two of mixing.POSITION, which a table of documents must not have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailframe.llm import decontaminate, langid, mixing, neardup, sharding
from mailframe.llm.common import materialize, shared_dir, table

MIN_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep(docs, langid.train(langid.training_rows(docs)), MIN_SCORE)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.placed(docs)


def sharding_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "corpus")
    docs = mixing.in_order(docs)
    sharding.append(docs, path)
    sharding.compact(spark, path, docs.schema, ordered=True)
    return sharding.read(spark, path, docs.schema)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_weights", mixing_weights),
    ("sharding", sharding_),
]

#: SQL has neither the field of stage 1 nor the banding of stage 2; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
