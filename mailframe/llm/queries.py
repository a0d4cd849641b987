"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailframe.llm import chat, decontaminate, langid, lmscore, media, mixing, neardup, pii, sharding, suffix
from mailframe.llm.common import shared_dir, table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a lossless image in an archive directory, read back through the data source."""
    path = shared_dir(spark, "media")
    docs = table(spark, sf_dir, "documents")
    media.write_media(docs.select(F.col("doc_id").alias("id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload")), path)
    return media.features(media.read_media(spark, path))


CHAT_CONTROL = r"\### Assistant: </turn> ok"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, then read back from the formatted segments."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CHAT_CONTROL), (-7, 1, "assistant", CHAT_CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_chat(chat.text_parts(turns.unionByName(extra))))


def op9_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix; targets in proportion to the square roots of the sources' sizes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", "block", "slot", "place")


OP9_SQL = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (
  SELECT source, greatest(1, round(sqrt(n) / sum(sqrt(n)) OVER () * {mixing.PERIOD}))::BIGINT AS units,
         row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i
  FROM n),
p AS (SELECT sum(units)::BIGINT AS l, list(units ORDER BY i) AS u FROM w),
s(t, had, pick) AS (
  SELECT 0::BIGINT, list_transform(u, lambda x: 0::BIGINT), NULL::BIGINT FROM p
  UNION ALL
  SELECT t + 1, list_transform(range(len(had)), lambda k: had[k + 1] + (k = c)::BIGINT), c
  FROM (
    SELECT t, had, list_min(list_transform(
             list_filter(range(len(u)), lambda k: had[k + 1] * l // u[k + 1] <= t),
             lambda k: ((had[k + 1] + 1) * l + u[k + 1] - 1) // u[k + 1] * 100000 + k)) % 100000 AS c
    FROM s, p WHERE t < l)),
plan AS (SELECT pick AS i, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM s WHERE t > 0),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS nth FROM documents)
SELECT d.doc_id, d.source, nth // {mixing.BLOCK} AS block, nth // {mixing.BLOCK} // units * l + slot AS slot, nth % {mixing.BLOCK} AS place
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source CROSS JOIN p
JOIN plan ON plan.i = w.i AND plan.turn = nth // {mixing.BLOCK} % units
"""


ARRIVALS = 4


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents appended in four arrivals, by ranges of ids, and compacted after every second; where the last version holds each document."""
    docs = table(spark, sf_dir, "documents")
    path = shared_dir(spark, "shards")
    bounds = docs.agg(F.percentile_approx("doc_id", [i / ARRIVALS for i in range(1, ARRIVALS)], 1000)).first()[0] or []
    for i, (lo, hi) in enumerate(zip([None, *bounds], [*bounds, None], strict=True)):
        rest = F.lit(True) if hi is None else F.col("doc_id") <= hi
        own = rest if lo is None else rest & (F.col("doc_id") > lo)
        sharding.append(docs.filter(own | F.col("doc_id").isNull() if lo is None else own), path)
        if i % 2:
            sharding.compact(spark, path, docs.schema)
            sharding.vacuum(spark, path)
    return sharding.read(spark, path, docs.schema).select("doc_id", "source", "n_chars", "shard", "shard_tier", "shard_version")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds within the item's error budget."""
    return decontaminate.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's trigram score with stupid backoff, counts from all other documents; rounded for comparison."""
    found = lmscore.score(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_log_score")})


OP4_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, i, least(i, 3) AS reach, w[i] AS w1, w[i - 1] AS w2, w[i - 2] AS w3 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
g AS (
  SELECT doc_id, i, 1 AS n, w1 AS g FROM t
  UNION ALL SELECT doc_id, i, 2, w2 || ' ' || w1 FROM t WHERE i > 1
  UNION ALL SELECT doc_id, i, 3, w3 || ' ' || w2 || ' ' || w1 FROM t WHERE i > 2),
own AS (SELECT doc_id, n, g, count(*) AS c FROM g GROUP BY ALL),
total AS (SELECT n, g, sum(c) AS c FROM own GROUP BY ALL),
size AS (SELECT doc_id, sum(c) FILTER (n = 1) AS own, (SELECT sum(c) FROM total WHERE n = 1) AS total FROM own GROUP BY doc_id),
c AS (SELECT g.doc_id, g.i, g.n, (total.c - own.c)::DOUBLE AS c FROM g JOIN own USING (doc_id, n, g) JOIN total USING (n, g)),
k AS (
  SELECT t.doc_id, t.i, t.reach, (size.total - size.own)::DOUBLE AS words,
         max(c.c) FILTER (c.i = t.i AND c.n = 1) AS c1, max(c.c) FILTER (c.i = t.i AND c.n = 2) AS c2, max(c.c) FILTER (c.i = t.i AND c.n = 3) AS c3,
         max(c.c) FILTER (c.i = t.i - 1 AND c.n = 1) AS p1, max(c.c) FILTER (c.i = t.i - 1 AND c.n = 2) AS p2
  FROM t JOIN size USING (doc_id) JOIN c ON c.doc_id = t.doc_id AND c.i IN (t.i, t.i - 1)
  GROUP BY ALL),
s AS (
  SELECT doc_id, reach,
         CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS used,
         CASE WHEN c3 > 0 THEN ln(c3) - ln(p2)
              WHEN c2 > 0 THEN ln(c2) - ln(p1) + (reach - 2) * ln({lmscore.ALPHA})
              WHEN c1 > 0 THEN ln(c1) - ln(words) + (reach - 1) * ln({lmscore.ALPHA})
              ELSE 3 * ln({lmscore.ALPHA}) - ln(words + 1) END AS l
  FROM k),
r AS (SELECT doc_id, count(*) AS n, sum(l) AS l, count(*) FILTER (used = reach) AS top, count(*) FILTER (used BETWEEN 1 AND reach - 1) AS back, count(*) FILTER (used = 0) AS unseen FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, round(coalesce(l, 0.0), 4) AS log_score, round(l / n, 4) AS mean_log_score,
       coalesce(top, 0) AS n_top, coalesce(back, 0) AS n_backoff, coalesce(unseen, 0) AS n_unseen
FROM d LEFT JOIN r USING (doc_id)
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from labelled documents that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text without the bytes that repeated strings of 200 bytes cover."""
    return suffix.deduplicate(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: base patterns, and what the field adds."""
    return pii.detect(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's near-duplicate class and number of links, five words and a similarity of 0.8."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_language_id": op5_language_id,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_pii": op7_pii,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_mixing_weights": op9_mixing_weights,
    "op10_sharding": op10_sharding,
}
ORACLES: dict[str, str] = {"op4_lm_scoring": OP4_SQL, "op9_mixing_weights": OP9_SQL}
