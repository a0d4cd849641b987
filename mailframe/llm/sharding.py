"""Sharding by size-tiered compaction, with DataFrame functions only.

append() writes arrivals as small immutable shards: each task puts its rows into files of bounded row
counts, without a shuffle. compact() plans on the manifest alone: in each lane of shards, `fanout` pending
shards of one size tier become a shard of the next tier, tier by tier, until shards reach the target
size; then one job reads the files of the shards that are part of a merge, and writes each straight into its final shard (what an
incremental compaction would have written in between is planned, not written). Lanes bound the length of a plan and are no part of
a shard's fate: shards get one anew for each plan, so that shards of all appends meet. Where order counts (ordered=True) lanes are ranges
of the order and only neighbours merge, so that shards by `first` and rows in them stay as appended.

commit() publishes a manifest of the next version: the manifest's rows are written aside, and a file that names them appears under the
version's name by an operation that fails if there is one already. So of two writers one wins, the other raises and leaves
nothing that counts; readers see the old list of shards or the new one, and no file is changed once it is listed.

Defined cases: every row is in one live shard of every version. A single document larger than the target is a large row of
its shard; nothing is cut or dropped. An empty table gives a version with no shards. Nulls, repeated rows
and other columns are kept as they are, columns called like this module's own among them: read() names its own apart from those.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailframe.llm.common import fresh

ARRIVAL_ROWS, TARGET_BYTES, FANOUT, LANE_SHARDS = 1_000, 16 << 20, 4, 4_096
MANIFEST = "shard string, files array<string>, version long, tier int, n_rows long, n_bytes long, place long, first string"
FIELDS = [c.split(" ")[0] for c in MANIFEST.split(", ")]


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, make = _fs(spark, path)
    if not fs.exists(make(f"{path}/_manifest")):
        return []
    names = (x.getPath().getName() for x in fs.listStatus(make(f"{path}/_manifest")))
    return sorted(int(n[1:]) for n in names if n.startswith("v"))


def _listed_at(spark: SparkSession, path: str, version: int) -> str:
    """Where the rows of a version's manifest are."""
    fs, make = _fs(spark, path)
    stream = fs.open(make(f"{path}/_manifest/v{version:08d}"))
    try:
        return f"{path}/{spark._jvm.java.util.Scanner(stream, 'UTF-8').next()}"
    finally:
        stream.close()


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The shards of a version, the latest by default."""
    version = version or max(versions(spark, path), default=0)
    if not version:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(_listed_at(spark, path, version))


def _publish(spark: SparkSession, staged: str, final: str) -> None:
    """Give a finished file its name, unless there is a file of that name: a hard link locally, else a rename without overwriting."""
    if urlparse(staged).scheme in ("", "file"):
        local = lambda p: unquote(urlparse(p).path)
        try:
            os.link(local(staged), local(final))
        except FileExistsError as e:
            raise Conflict(f"{final} was committed by another writer") from e
        return
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    make = jvm.org.apache.hadoop.fs.Path
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(make(staged).toUri(), spark._jsc.hadoopConfiguration()).rename(make(staged), make(final), none)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"{final} was committed by another writer") from e
        raise


def commit(spark: SparkSession, path: str, shards: DataFrame, version: int) -> int:
    """Publish shards as the given version; raises Conflict if that version is there."""
    fs, make = _fs(spark, path)
    rows, name = f"_rows/{version:08d}-{uuid.uuid4().hex}", f"{path}/_manifest/v{version:08d}"
    if fs.exists(make(name)):
        raise Conflict(f"{name} was committed by another writer")
    shards.select(*FIELDS).write.parquet(f"{path}/{rows}")
    fs.mkdirs(make(f"{path}/_manifest"))
    staged = f"{path}/_rows/{uuid.uuid4().hex}.name"
    stream = fs.create(make(staged), False)
    stream.write(bytearray(rows.encode()))
    stream.close()
    _publish(spark, staged, name)
    return version


def _files(spark: SparkSession, files: DataFrame, schema) -> DataFrame:
    """Rows of the files named in the one column of a table, and of no others. As for every scan, the driver plans over the names."""
    names = [r[0] for r in files.toLocalIterator()]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def _listed(spark: SparkSession, folder: str, schema, shard: Column) -> DataFrame:
    """Files of a folder with rows and bytes, from Parquet footers and file metadata, not from the rows' columns."""
    rows = spark.read.schema(schema).parquet(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    return rows.groupBy("file", "size").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("shard", shard)


def append(docs: DataFrame, path: str, arrival_rows: int = ARRIVAL_ROWS) -> int:
    """Write docs as small immutable shards and commit them beside those that are there; gives the new version."""
    spark = docs.sparkSession
    version = max(versions(spark, path), default=0) + 1
    now = manifest(spark, path)
    folder = f"{path}/data/a{version:08d}-{uuid.uuid4().hex[:8]}"
    docs.write.option("maxRecordsPerFile", arrival_rows).option("compression", "zstd").parquet(folder)
    task, part = F.regexp_extract("file", r"part-(\d+)-", 1).cast("long"), F.regexp_extract("file", r"-c(\d+)\.", 1).cast("long")
    # a name and a number that order as the rows arrived: version, task, file of the task
    new = _listed(spark, folder, docs.schema, F.format_string("a%08d-%06d-%06d", F.lit(version), task, part))
    new = new.select(
        "shard", F.array("file").alias("files"), F.lit(version).cast("long").alias("version"), F.lit(0).alias("tier"), F.col("n_rows"),
        F.col("size").alias("n_bytes"), (F.lit(version << 40) + task * (1 << 20) + part).alias("place"), F.col("shard").alias("first"),
    )
    return commit(spark, path, now.unionByName(new), version)


def _lanes(shards: DataFrame, ordered: bool, lane_shards: int) -> DataFrame:
    """shards with a lane of some lane_shards each: ranges of the order, or else by hash."""
    n = max(1, -(-shards.count() // lane_shards))
    if n == 1:
        return shards.withColumn("lane", F.lit(0))
    if not ordered:
        return shards.withColumn("lane", F.pmod(F.xxhash64("first"), F.lit(n)))
    bounds = shards.agg(F.percentile_approx("place", [i / n for i in range(1, n)], 100 * n).alias("bounds"))
    return shards.join(F.broadcast(bounds)).withColumn("lane", F.size(F.filter("bounds", lambda b: b < F.col("place")))).drop("bounds")


def plan(shards: DataFrame, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, ordered: bool = False, lane_shards: int = LANE_SHARDS) -> DataFrame:
    """Which final shard each live shard goes to: columns shard, goal, goal_tier, members, place.

    A lane's shards arrive in order. Those below the target are pending in a tier, by size: tier k holds sizes
    from base*fanout**k. When a tier has fanout pending, they merge into one, which is pending in the
    tier of its own size or, from the target size on, done. Lanes are bounded, so a lane's list is a bounded array.
    With ordered, those that merge are the newest and the unbroken row of pending ones before it in its tier or lower ones.
    """
    base, most = 1 << 14, 1
    while base * fanout**most < target_bytes:
        most += 1
    tier = lambda n: F.greatest(F.lit(0), F.floor(F.log(float(fanout), n / base) + 1e-9)).cast("int")
    run = F.struct(F.col("first"), F.col("n_bytes"), F.array("shard").alias("members"), F.col("tier").alias("rank"), "place")
    # shards of the target size are done; they count where they part neighbours
    open_ = shards if ordered else shards.filter(F.col("n_bytes") < target_bytes)
    lanes = _lanes(open_, ordered, lane_shards).groupBy("lane").agg(F.array_sort(F.collect_list(run)).alias("runs"))

    def merge(runs: Column, _: Column) -> Column:
        """The pending tier that the newest run is in becomes one run, if it is full."""
        last = F.element_at(runs, -1)
        pending = lambda x: (x["n_bytes"] < target_bytes) & (last["n_bytes"] < target_bytes)
        if ordered:
            low = lambda x: pending(x) & (tier(x["n_bytes"]) <= tier(last["n_bytes"]))
            before = F.array_max(F.transform(runs, lambda x, i: F.when(low(x), 0).otherwise(i + 1)))
            full, rest = F.slice(runs, before + 1, F.size(runs)), F.slice(runs, F.lit(1), before)
        else:
            alike = lambda x: pending(x) & (tier(x["n_bytes"]) == tier(last["n_bytes"]))
            full, rest = F.filter(runs, alike), F.filter(runs, lambda x: ~alike(x))
        one = F.struct(
            F.array_min(F.transform(full, lambda x: x["first"])).alias("first"),
            F.aggregate(full, F.lit(0).cast("long"), lambda n, x: n + x["n_bytes"]).alias("n_bytes"),
            F.flatten(F.transform(full, lambda x: x["members"])).alias("members"),
            (F.array_max(F.transform(full, lambda x: x["rank"])) + 1).alias("rank"),
            F.array_min(F.transform(full, lambda x: x["place"])).alias("place"),
        )
        return F.when(F.size(full) >= fanout, F.concat(rest, F.array(one))).otherwise(runs)

    none = F.filter("runs", lambda x: F.lit(False))
    push = lambda held, x: F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.concat(held, F.array(x)), merge)
    final = lanes.select(F.explode(F.aggregate("runs", none, push)).alias("r"))
    out = final.select(F.col("r.first").alias("goal"), F.col("r.rank").alias("goal_tier"), F.size("r.members").alias("members"), F.col("r.place").alias("place"), F.explode("r.members").alias("shard"))
    if ordered:
        return out
    done = shards.filter(F.col("n_bytes") >= target_bytes)
    return out.unionByName(done.select(F.col("first").alias("goal"), F.col("tier").alias("goal_tier"), F.lit(1).alias("members"), "place", "shard"))


BROADCAST_ROWS = 50_000


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint only for a table whose rows, of some 300 bytes, were counted and found few; else a shuffled join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def compact(spark: SparkSession, path: str, schema, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, ordered: bool = False, lane_shards: int = LANE_SHARDS) -> int:
    """Merge shards of the latest version by plan(), rewrite what is merged, and commit the next version; the version as it is if nothing merges."""
    version = max(versions(spark, path), default=0) + 1
    now = manifest(spark, path)
    staged = f"{path}/_rows/plan-{uuid.uuid4().hex}"
    plan(now, target_bytes, fanout, ordered, lane_shards).join(now.select("shard", "files", "first"), "shard").write.parquet(staged)  # the plan is fixed before data move
    planned = spark.read.parquet(staged)
    moved = planned.filter("members > 1")
    goals = moved.agg(F.countDistinct("goal")).first()[0]
    if not goals:
        return version - 1
    kept = now.join(planned.filter("members = 1").select("shard"), "shard")
    folder = f"{path}/data/m{version:08d}-{uuid.uuid4().hex[:8]}"
    rows = _files(spark, moved.select(F.explode("files")), schema)
    file, row, goal, since = fresh(rows, "_shard_file", "_shard_row", "_shard", "_shard_from")
    where = moved.select(F.explode("files").alias(file), F.col("goal").alias(goal), F.col("first").alias(since))
    rows = rows.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    # more tasks than goals, so that hashes seldom put two goals into one
    rows = rows.join(_small(where), file).repartition(3 * goals, goal).sortWithinPartitions(goal, since, file, row)
    rows.drop(file, since, row).write.partitionBy(goal).option("compression", "zstd").parquet(folder)
    made = _listed(spark, folder, schema, F.regexp_extract("file", f"/{goal}=([^/]+)/", 1))
    made = made.groupBy("shard").agg(F.array_sort(F.collect_list("file")).alias("files"), F.sum("n_rows").alias("n_rows"), F.sum("size").alias("n_bytes"))
    of = moved.groupBy(F.col("goal").alias("_g")).agg(F.first("goal_tier").alias("tier"), F.first("place").alias("place"), F.min("first").alias("first"))
    made = made.join(of, made["shard"] == of["_g"]).select(
        F.concat(F.lit(f"m{version:08d}-"), "shard").alias("shard"), "files", F.lit(version).cast("long").alias("version"), "tier", "n_rows", "n_bytes", "place", "first"
    )
    return commit(spark, path, kept.unionByName(made), version)


def read(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a version, with columns shard, shard_tier and shard_version (led by underscores where the data has such columns)."""
    live = manifest(spark, path, version)
    rows = _files(spark, live.select(F.explode("files")), schema)
    shard, tier, since, file = fresh(rows, "shard", "shard_tier", "shard_version", "_shard_file")
    live = live.select(F.explode("files").alias(file), F.col("shard").alias(shard), F.col("tier").alias(tier), F.col("version").alias(since))
    if live.isEmpty():
        return rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in ((shard, "string"), (tier, "int"), (since, "long"))))
    return rows.select("*", F.col("_metadata.file_path").alias(file)).join(_small(live), file).drop(file)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete the versions before the last `keep`, and the files that no version lists any more; gives the number of files."""
    fs, make = _fs(spark, path)
    old, new = versions(spark, path)[:-keep], versions(spark, path)[-keep:]
    if not old:
        return 0
    files = lambda vs: spark.read.schema(MANIFEST).parquet(*(_listed_at(spark, path, v) for v in vs)).select(F.explode("files").alias("f"))
    gone = 0
    for r in files(old).distinct().join(files(new), "f", "left_anti").toLocalIterator():  # a partition of names at a time
        fs.delete(make(r.f), False)
        gone += 1
    for v in old:
        fs.delete(make(f"{path}/_manifest/v{v:08d}"), False)
    return gone
