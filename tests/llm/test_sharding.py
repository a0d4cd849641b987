from collections import Counter

import pytest
from pyspark.sql import functions as F

from mailframe.llm import sharding

MB = 1 << 20


def lsm(sizes, target, fanout, base=1 << 14):
    """Brute-force size-tiered compaction of one lane: the list of (members, bytes)."""
    runs = []

    def tier(n):
        k = 0
        while base * fanout ** (k + 1) <= n:
            k += 1
        return k

    for i, n in enumerate(sizes):
        runs.append(([i], n))
        while True:
            last = runs[-1][1]
            alike = [r for r in runs if r[1] < target and last < target and tier(r[1]) == tier(last)]
            if len(alike) < fanout:
                break
            runs = [r for r in runs if r not in alike] + [([m for r in alike for m in r[0]], sum(r[1] for r in alike))]
    return sorted(sorted(m) for m, _ in runs)


@pytest.mark.parametrize("sizes", [[], [MB], [MB] * 4, [MB] * 21, [MB, 3 * MB, 100 * MB, MB, 7000, 2 * MB, MB, 3 * MB, 3 * MB] * 3, [20000 + 997 * i for i in range(70)]])
def test_plan_against_brute_force(spark, sizes):
    rows = [(f"a{i:04d}", ["f"], 1, 0, 1, n, i, f"a{i:04d}") for i, n in enumerate(sizes)]
    got = sharding.plan(spark.createDataFrame(rows, sharding.MANIFEST), 16 * MB, 4).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in got:
        groups.setdefault(r.goal, []).append(int(r.shard[1:]))
    assert sorted(map(sorted, groups.values())) == lsm(sizes, 16 * MB, 4)


def test_ordered_plan_merges_neighbours_only(spark):
    sizes = [3 * MB, MB // 2, 2 * MB, 7000, 20 * MB, MB, MB // 2, MB, 3 * MB, 2 * MB, 2 * MB, MB // 2] * 4
    df = spark.createDataFrame([(f"a{i:04d}", ["f"], 1, 0, 1, n, i, f"a{i:04d}") for i, n in enumerate(sizes)], sharding.MANIFEST)
    for lane_shards in (1000, 20):
        groups = {}
        for r in sharding.plan(df, 16 * MB, 4, ordered=True, lane_shards=lane_shards).collect():
            groups.setdefault(r.goal, []).append(int(r.shard[1:]))
        assert sorted(i for g in groups.values() for i in g) == list(range(len(sizes)))
        assert all(sorted(g) == list(range(min(g), max(g) + 1)) for g in groups.values())
        assert max(map(len, groups.values())) >= 4


def test_append_compact_read(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    docs = [(i if i % 50 else None, f"text {i}" * (i % 7), "s", "x") for i in range(500)] + [(3, None, None, "x"), (3, None, None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, shard_x string").repartition(3).sortWithinPartitions("doc_id")
    assert sharding.append(df, path, arrival_rows=20) == 1
    before = sharding.manifest(spark, path, 1)
    assert before.agg(F.max("n_rows")).first()[0] == 20
    assert sharding.compact(spark, path, df.schema) == 2
    assert sharding.append(df.limit(30), path, arrival_rows=20) == 3
    after = sharding.manifest(spark, path, 2)
    assert after.count() < before.count()
    assert after.agg(F.sum("n_rows")).first()[0] == len(docs)
    for v, extra in ((1, 0), (2, 0), (3, 30)):  # an old version stays readable
        got = Counter(tuple(r) for r in sharding.read(spark, path, df.schema, v).select("doc_id", "text", "source", "shard_x").collect())
        assert sum(got.values()) == len(docs) + extra
        assert not Counter(docs) - got
    assert sharding.vacuum(spark, path) > 0
    assert sharding.read(spark, path, df.schema).count() == len(docs) + 30


def test_a_version_is_committed_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    sharding.append(df, path)
    with pytest.raises(RuntimeError):
        sharding.commit(spark, path, sharding.manifest(spark, path), 1)


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/u"
    df = spark.createDataFrame([], "doc_id long, text string")
    sharding.append(df, path)
    sharding.compact(spark, path, df.schema)
    assert sharding.read(spark, path, df.schema).count() == 0


def test_eight_small_appends_end_in_fewer_shards(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    df = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string").coalesce(1)
    for i in range(8):
        sharding.append(df.filter(f"doc_id div 50 = {i}"), path)
        if i % 3 == 2:
            sharding.compact(spark, path, df.schema)
    sharding.compact(spark, path, df.schema)
    assert sharding.manifest(spark, path).count() < 4
    assert sorted(r.doc_id for r in sharding.read(spark, path, df.schema).collect()) == list(range(400))


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/w"
    df = spark.createDataFrame([(i, "a") for i in range(10)], "doc_id long, text string")
    sharding.append(df, path)
    real, late = sharding._publish, []

    def publish(spark, staged, final):
        if not late:  # a second writer commits between this one's look and its commit
            late.append(1)
            sharding.append(df, path)
        real(spark, staged, final)

    monkeypatch.setattr(sharding, "_publish", publish)
    with pytest.raises(sharding.Conflict):
        sharding.append(df, path)
    assert sharding.versions(spark, path) == [1, 2]
    assert sharding.read(spark, path, df.schema).count() == 20


def test_only_live_files_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    df = spark.createDataFrame([(i, "a" * i) for i in range(200)], "doc_id long, text string").repartition(4)
    sharding.append(df, path, arrival_rows=10)
    sharding.compact(spark, path, df.schema)
    live = {f for r in sharding.manifest(spark, path).collect() for f in r.files}
    seen = {f.replace("file:///", "file:/") for f in sharding.read(spark, path, df.schema).inputFiles()}
    assert {f for f in seen if "/data/" in f} == live


def test_columns_of_like_names_long_texts_and_repeated_rows(spark, tmp_path):
    path = f"file://{tmp_path}/y"
    rows = [(1, "x" * 300_000, "a", "b", 3, "c")] * 2 + [(None, None, None, None, None, None)] * 6
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, _shard string, shard_version int, _shard_file string").repartition(4)
    sharding.append(df, path, arrival_rows=1)
    sharding.compact(spark, path, df.schema)
    got = sharding.read(spark, path, df.schema)
    assert set(df.columns) < set(got.columns) and len(got.columns) == len({c.lower() for c in got.columns})
    assert Counter(map(tuple, got.select(df.columns).collect())) == Counter(rows)
