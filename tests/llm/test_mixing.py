import math

import pytest

from mailframe.llm import mixing


def brute_schedule(units):
    total, had, slots = sum(units), [0] * len(units), []
    for t in range(total):
        due = [(math.ceil((had[i] + 1) * total / u), i) for i, u in enumerate(units) if had[i] * total // u <= t]
        i = min(due)[1]
        had[i] += 1
        slots.append(i)
    return slots


@pytest.mark.parametrize("units", [[1], [1, 1], [7, 2, 1], [50, 30, 11, 5, 3, 1], [97, 1, 1, 1]])
def test_schedule_meets_windows_and_stays_within_a_block(spark, units):
    names = [None, *"abcdefgh"][: len(units)]
    plan = mixing.schedule(spark.createDataFrame(list(zip(names, units, strict=True)), "source string, units long"))
    rows = sorted(plan.collect(), key=lambda r: r.slot)
    assert [names.index(r.source) for r in rows] == brute_schedule(units)
    had, total = dict.fromkeys(names, 0), sum(units)
    for t, r in enumerate(rows):
        assert r.turn == had[r.source]
        had[r.source] += 1
        for n, u in zip(names, units, strict=True):
            assert abs(had[n] - (t + 1) * u / total) < 1


def test_mix_against_brute_force(spark):
    docs = [(i, "a") for i in range(40)] + [(i, "b") for i in range(100, 110)] + [(None, None), (None, None), (7, "a"), (5, None)]
    df = spark.createDataFrame([(i, s, "t", 1) for i, s in docs], "doc_id long, source string, block2 string, n long")
    weights = spark.createDataFrame([("a", 3), ("b", 1), (None, 1), ("unused", 2)], "source string, units long")
    got = mixing.mix(df, weights, block=4).collect()
    assert len(got) == len(docs)
    names, units = [None, "a", "b", "unused"], [1, 3, 1, 2]
    slots = brute_schedule(units)
    for i, s in enumerate(names):
        own = sorted((d for d in docs if d[1] == s), key=lambda d: (d[0] is not None, d[0]))
        mine = sorted(((r.slot, r.place, r.doc_id) for r in got if r.source == s))
        at = [t for t, x in enumerate(slots) if x == i]
        want = [(k // 4 // units[i] * sum(units) + at[k // 4 % units[i]], k % 4, d[0]) for k, d in enumerate(own)]
        assert mine == want


def test_numbering_by_small_ranges(spark):
    ids = [3, 1, 10**12, -5, 7, 7, None, 2]
    df = spark.createDataFrame([(i, "s") for i in ids], "doc_id long, source string")
    got = sorted(mixing.numbered(df, [], range_rows=2).collect(), key=lambda r: r.nth)
    assert [r.nth for r in got] == list(range(len(ids)))
    assert [r.doc_id for r in got] == sorted(ids, key=lambda i: (i is not None, i))


def test_empty_and_missing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string")
    assert mixing.mix(empty).count() == 0
    with pytest.raises(Exception, match="no weight"):
        mixing.mix(spark.createDataFrame([(1, "x")], "doc_id long, source string"), spark.createDataFrame([("y", 1)], "source string, units long")).collect()


@pytest.mark.parametrize("units", [[1], [1, 1], [7, 2, 1], [50, 30, 11, 5, 3, 1], [97, 1, 1, 1], [3] * 40])
def test_many_sources_are_scheduled_to_the_same_slots(spark, units):
    names = [None, *(f"s{i:02d}" for i in range(1, len(units)))]
    weights = spark.createDataFrame(list(zip(names, units, strict=True)), "source string, units long")
    few, many = (sorted(mixing.schedule(weights, n).select("slot", "source", "units", "period", "turn").collect(), key=lambda r: r.slot) for n in (len(units), 0))
    assert few == many and [names.index(r.source) for r in many] == brute_schedule(units)


def test_more_sources_than_a_period_keep_their_targets(spark):
    n = 12_000
    docs = spark.range(4 * n + 396).selectExpr("id AS doc_id", f"IF(id < {4 * n}, concat('s', id % {n}), 's0') AS source")
    units = {r.source: r.units for r in mixing.natural_weights(docs).collect()}
    assert len(units) == n and units["s0"] == 100 and units["s1"] == 10  # 400 documents and 4
    rows = mixing.mix(docs, block=1).select("source", "slot", "place").collect()
    assert len(rows) == 4 * n + 396 == len({(r.slot, r.place) for r in rows})


def test_outlying_ids_of_one_source_do_not_make_a_large_range(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "'s' AS source").unionAll(spark.createDataFrame([(2**62, "s"), (-(2**62), "s"), (None, "s")], "doc_id long, source string"))
    sizes = sorted(r["count"] for r in df.select(mixing._ranges(df, None, mixing.BINS).alias("r")).groupBy("r").count().collect())
    assert len(sizes) > 100 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got = sorted(mixing.numbered(df, []).collect(), key=lambda r: r.nth)
    assert [r.nth for r in got] == list(range(20_003))
    assert [r.doc_id for r in got] == [None, -(2**62), *range(20_000), 2**62]


def test_columns_of_like_names_stay(spark):
    rows = [(i, "ab"[i % 2], i * 7, -i, "p", "k") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, block int, Slot int, place string, _key string")
    got = mixing.mix(df, block=4)
    assert len({c.lower() for c in got.columns}) == len(got.columns) == 9
    assert sorted(map(tuple, got.select(df.columns).collect())) == rows
    assert mixing.placed(df).columns == [*df.columns, *mixing.POSITION]


def test_a_long_text_and_repeated_rows_keep_their_places(spark):
    df = spark.createDataFrame([(1, "s", "x" * 200_000), (1, "s", None), (1, "s", None)], "doc_id long, source string, text string")
    assert sorted(r._mix_place for r in mixing.placed(df).collect()) == [0, 1, 2]
