"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

The documents of a source, in order of id, form blocks. With weights in whole units that sum to a period of
L slots, block j of a source of u units gets release time floor(j*L/u) and deadline ceil((j+1)*L/u); in each
slot the released block of earliest deadline goes, ties by source. Windows repeat each period, so one period
is scheduled, of a size that depends on the parameters and the number of sources alone (up to FOLD_SOURCES by
SQL functions, above that by the driver with a heap, to the same slots), and every block
finds its slot by arithmetic and a join with that table. While no source has run out, after any number of
slots each source has within less than one block of its share. A source that has run out leaves its slots
empty; nothing is dropped or repeated. The order of documents is (slot, place).

Numbering needs no task that holds a source: ids are cut into ranges at their quantiles, counts of ranges are summed up per
source, and rows are numbered within (source, range).

Defined cases: a null source is a source of its own, before all others at ties; null ids come first; rows of
equal id are ordered by the other columns given in `ties`; an empty table gives no rows; other columns stay, whatever their names.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailframe.llm.common import fresh

BLOCK, PERIOD, MEAN_UNITS = 32, 1000, 10
FOLD_SOURCES, BROADCAST_SOURCES, CHUNK, BINS = 1_000, 50_000, 100, 256
#: Columns that store the mixed order in tables: Spark reads files by falling size, so the order of rows in files is no order.
POSITION = ("_mix_slot", "_mix_place")


def natural_weights(docs: DataFrame, period: int = PERIOD) -> DataFrame:
    """Default targets: units in proportion to the square root of a source's documents, at least one each.

    The period grows with the sources to MEAN_UNITS each, so that rounding and the least unit do not flatten the targets.
    """
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    roots, sources = n.agg(F.coalesce(F.sum(F.sqrt("n")), F.lit(1.0)), F.count(F.lit(1))).first()
    share = F.sqrt("n") / F.lit(roots)
    return n.select("source", F.greatest(F.lit(1), F.round(share * max(period, MEAN_UNITS * sources))).cast("long").alias("units"))


def _schedule_many(weights: DataFrame) -> DataFrame:
    """schedule() with a heap: a period of L slots takes L log n steps; the driver holds names and slots."""
    names, units = [], []
    for r in weights.select("source", F.col("units").cast("long").alias("units")).orderBy(F.col("source").asc_nulls_first(), "units").toLocalIterator():
        names.append(r.source)
        units.append(r.units)
    total, had = sum(units), [0] * len(units)
    who, turn = np.empty(total, np.int64), np.empty(total, np.int64)
    waiting, ready = [(0, i) for i in range(len(units))], []  # (release, source), (deadline, source)
    for at in range(total):
        while waiting and waiting[0][0] <= at:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(had[i] + 1) * total // units[i]), i))
        i = heapq.heappop(ready)[1]
        who[at], turn[at] = i, had[i]
        had[i] += 1
        heapq.heappush(waiting, (had[i] * total // units[i], i))
    columns = {
        "source": pa.array(names, pa.string()).take(pa.array(who)), "units": np.array(units, np.int64)[who], "period": np.full(total, total, np.int64),
        "slot": np.arange(total, dtype=np.int64), "turn": turn,
    }
    return weights.sparkSession.createDataFrame(pa.table(columns), "source string, units long, period long, slot long, turn long")


def schedule(weights: DataFrame, fold_sources: int = FOLD_SOURCES) -> DataFrame:
    """One period, earliest deadline first: (source, units, period, turn, slot); weights: (source, units > 0)."""
    if weights.count() > fold_sources:
        return _schedule_many(weights)
    one = weights.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", F.col("units").cast("long").alias("units")))).alias("w"))
    one = one.withColumn("l", F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["units"]))

    def step(state: Column, t: Column) -> Column:
        """state: how many blocks each source has had, and the source (by number) of each slot so far."""
        due = F.transform(
            F.col("w"),
            lambda x, i: F.when(
                F.floor(F.get(state["had"], i) * F.col("l") / x["units"]) <= t,
                F.struct(F.ceil((F.get(state["had"], i) + 1) * F.col("l") / x["units"]).alias("d"), i.cast("long").alias("i")),
            ),
        )
        return F.transform(F.array(F.array_min(F.filter(due, lambda x: x.isNotNull()))["i"]), lambda p: F.struct(F.transform(state["had"], lambda h, i: F.when(i == p, h + 1).otherwise(h)).alias("had"), F.concat(state["slots"], F.array(p)).alias("slots")))[0]

    def chunk(state: Column, c: Column) -> Column:
        """A row of slots begun anew, so that what is appended to stays short; state has the finished ones as a list of lists."""
        last = F.least((c + 1) * CHUNK, F.col("l")) - 1
        done = F.aggregate(F.sequence(c * CHUNK, last), F.struct(state["had"].alias("had"), F.array().cast("array<bigint>").alias("slots")), step)
        return F.transform(F.array(done), lambda d: F.struct(d["had"].alias("had"), F.concat(state["chunks"], F.array(d["slots"])).alias("chunks")))[0]

    start = F.struct(F.transform("w", lambda _: F.lit(0).cast("long")).alias("had"), F.array().cast("array<array<bigint>>").alias("chunks"))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("l") - 1) / CHUNK))
    slots = one.select("w", "l", F.flatten(F.aggregate(chunks, start, chunk)["chunks"]).alias("slots")).filter("l > 0")
    each = slots.select("w", "l", F.posexplode("slots").alias("slot", "i"))
    each = each.select(F.get("w", F.col("i").cast("int")).alias("x"), "l", F.col("slot").cast("long").alias("slot"))
    turn = F.row_number().over(Window.partitionBy("source").orderBy("slot")).cast("long") - 1
    return each.select("x.source", "x.units", F.col("l").alias("period"), "slot").withColumn("turn", turn)


def _ranges(docs: DataFrame, range_rows: int | None, bins: int) -> Column:
    """The number of the range of ids that a row is in: ids are parted at quantiles, and between two of them into equal widths.

    A range holds about range_rows ids (the square root of all, by default) where ids are spread evenly between quantiles, and never
    more than a share of 1 / bins, whatever the ids are (but those of equal id). Null ids have a range of their own.
    """
    lo, hi, n, cuts = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.percentile_approx("doc_id", [i / bins for i in range(1, bins)], 20 * bins)).first()
    if not n:
        return F.lit(0).cast("long")
    cuts = sorted(set(cuts))
    pieces = max(1, math.ceil(n / bins / (range_rows or max(100, math.isqrt(n)))))
    step = math.isqrt(len(cuts)) + 1
    at = F.col("doc_id")
    literal = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    # of sorted cuts, those below the id: first every step-th, then those between
    rough = F.size(F.filter(literal(cuts[step - 1 :: step]), lambda c: c < at))
    bin_ = rough * step + F.size(F.filter(F.slice(literal(cuts), rough * step + 1, F.lit(step)), lambda c: c < at))
    edge = F.get(literal([lo, *cuts]), bin_).cast("double")
    end = F.get(literal([*cuts, hi]), bin_).cast("double")
    piece = F.least(F.lit(pieces - 1), F.floor((at.cast("double") - edge) / (end - edge + 1) * pieces))
    return F.coalesce(bin_.cast("long") * pieces + F.greatest(F.lit(0), piece), F.lit(-1).cast("long"))


def _numbered(docs: DataFrame, ties: list[str], nth: str, range_rows: int | None, bins: int) -> DataFrame:
    key, part, n, start, k = fresh(docs, "_key", "_range", "_n", "_start", "_k")
    # keys that are never null, so that grouping, numbering and join share one partitioning
    docs = docs.withColumn(key, F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))).withColumn(part, _ranges(docs, range_rows, bins))
    counts = docs.groupBy(key, part).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(key, part).orderBy(F.col("doc_id").asc_nulls_first(), *ties)
    docs = docs.withColumn(k, F.row_number().over(within) - 1)
    return docs.join(starts, [key, part]).withColumn(nth, F.col(start) + F.col(k)).drop(key, part, start, k)


def numbered(docs: DataFrame, ties: list[str], range_rows: int | None = None, bins: int = BINS) -> DataFrame:
    """Number the documents of each source from 0 in order of id, as column nth; no task holds a source: see _ranges()."""
    return _numbered(docs, ties, "nth", range_rows, bins)


def _mixed(docs: DataFrame, weights: DataFrame | None, block: int, period: int, ties: list[str]) -> tuple[DataFrame, list[str]]:
    """docs with its block, slot and place, and the names of these columns."""
    weights = natural_weights(docs, period) if weights is None else weights
    names = fresh(docs, "block", "slot", "place", "_nth", "_of", "_units", "_period", "_slots")
    block_, slot_, place_, nth, of, units, length, slots = names
    sizes = schedule(weights).groupBy(F.col("source").alias(of)).agg(F.first("units").alias(units), F.first("period").alias(length), F.array_sort(F.collect_list(F.struct("turn", "slot"))).alias(slots))
    rows = _numbered(docs, ties, nth, None, BINS).withColumn(block_, F.floor(F.col(nth) / block)).withColumn(place_, F.col(nth) % block)
    # few sources, with some MEAN_UNITS slots each, or else a shuffled join
    sizes = F.broadcast(sizes) if weights.count() <= BROADCAST_SOURCES else sizes
    rows = rows.join(sizes, rows["source"].eqNullSafe(sizes[of]), "left")
    rows = rows.filter(F.when(F.col(units).isNotNull(), True).otherwise(F.raise_error(F.lit("a source has no weight"))))
    slot = F.floor(F.col(block_) / F.col(units)) * F.col(length) + F.get(slots, (F.col(block_) % F.col(units)).cast("int"))["slot"]
    return rows.withColumn(slot_, slot).drop(of, units, length, slots, nth), names[:3]


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, period: int = PERIOD, ties: list[str] | None = None) -> DataFrame:
    """docs with columns block, slot and place (led by underscores where docs has such columns); (slot, place) is the mixed order.

    weights: (source, units), every source of docs among them; None for natural_weights.
    """
    return _mixed(docs, weights, block, period, ties or [])[0]


def placed(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """docs, all columns, with the columns of POSITION, by which in_order() sorts them."""
    rows, (_, slot, place) = _mixed(docs, weights, block, period, [c for c in ("text",) if c in docs.columns])
    return rows.select(*docs.columns, F.col(slot).alias(POSITION[0]), F.col(place).alias(POSITION[1]))


def in_order(docs: DataFrame) -> DataFrame:
    """What placed() gave, whatever files it has been in, sorted into the mixed order and without POSITION."""
    return docs.orderBy(*POSITION).drop(*POSITION)


def mixed(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """docs, all columns, sorted into the mixed order."""
    return in_order(placed(docs, weights, block, period))
