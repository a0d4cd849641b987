"""Connected components of an edge table, in rounds of joins cut by written tables.

Defined cases: a loop is no edge; repeated edges, in either direction, count once; an edge with a null end is left out; an empty
table has no components; columns other than a and b are ignored. Nodes are told apart by their numbers alone, so there are no ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailframe.llm.common import drop, hot_join, materialize, shared_dir


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b: long) to (id, root): the smallest id of each component, for every id with an edge.

    A round is a large-star step (a node's larger neighbours point to the least of its neighbours and itself) and a small-star step (its
    smaller neighbours and itself point to the least of them). The number of edges never grows beyond the input's, and a
    round that changes no edge leaves a star for each component. A hub's edges are not moved: see hot_join().
    """
    spark, path = edges.sparkSession, shared_dir(edges.sparkSession, "edges")
    start = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(start.withColumn("changed", F.lit(1)), "edges", path)
    for _ in range(max_rounds):
        n_edges, changed = now.agg(F.count(F.lit(1)), F.max("changed")).first()
        if not changed:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        one = now.select("u", "v")
        both = one.unionAll(one.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = hot_join(one, least, "v", 2 * n_edges)
        own = F.min("m").over(Window.partitionBy("u"))
        small = large.select("u", "v", "m", own.alias("root"))
        to = F.array(F.struct("u", F.col("root").alias("v"), (F.col("root") != F.col("v")).cast("int").alias("changed")), F.struct(F.col("m").alias("u"), F.col("root").alias("v"), (F.col("m") != F.col("root")).cast("int").alias("changed")))
        told = small.select(F.explode(to).alias("e")).select("e.*").filter("u != v").groupBy("u", "v").agg(F.max("changed").alias("changed"))
        last, path = path, shared_dir(spark, "edges")
        now = materialize(told, "edges", path)
        drop(spark, last)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
