import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailframe.llm import components, neardup, textops


def shingle_set(text, k=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows):
    """doc position -> (class by position, links), over all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * 10 >= 8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))], links


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n　\u0085\U0001f389ß", max_size=30)), max_size=6))
def test_words_and_shingles_against_python(texts):
    column = pa.array(texts, pa.string())
    w, at = textops.words(column)
    split = [(t or "").lower().split() for t in texts]
    assert np.diff(at).tolist() == [len(x) for x in split]
    by_hash = {}
    for h, word in zip(w.tolist(), [x for s in split for x in s], strict=True):
        assert by_hash.setdefault(h, word) == word
    assert len(set(by_hash.values())) == len(by_hash)
    _, offsets = textops.shingles(column)
    assert np.diff(offsets).tolist() == [len(shingle_set(t)) for t in texts]


def test_bands_reach_the_recall():
    bands, rows = neardup.choose_bands(0.8, 0.9999)
    assert bands * rows <= neardup.MOST_HASHES
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 60, 200])))) for i in range(60)]
    passage = " ".join(word() for _ in range(60))
    rows += [(100 + i, f"{passage} " + " ".join(word() for _ in range(40))) for i in range(30)]
    base = [word() for _ in range(150)]
    for i in range(90):  # near copies, most of them different from each other
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = word()
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, rows[5][1]) for i in range(20)] + [(400, None), (401, ""), (402, " \n"), (403, "x " * 30000), (404, "x " * 20000 + "y"), (405, rows[7][1].upper())]
    return rows


@pytest.mark.parametrize("side", [8, 256])
def test_against_brute_force(spark, side):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class_id string, root int").repartition(3)
    got = {r.doc_id: r for r in neardup.near_duplicates(df, side=side).collect()}
    cls, links = brute(rows)
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (rows[c][0], n) for (i, _), c, n in zip(rows, cls, links, strict=True)}
    assert max(links) > 50


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (None, text), (7, text + " more"), (7, "other words are here now"), (7, "other words are here now")]
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 7, 2, 2), (None, 7, 2, 2), (7, 7, 2, 1), (7, 7, 1, 2), (7, 7, 1, 2)], key=str)


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def test_one_id_with_many_texts_and_a_group_in_many_blocks(spark):
    rows = [(7, t) for _, t in corpus(4)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), side=8).collect()
    _, links = brute(rows)
    assert sorted(r.n_links for r in got) == sorted(links)


def test_hot_join_against_a_plain_join(spark, monkeypatch):
    from mailframe.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 5)
    left = spark.createDataFrame([(i, 1 if i % 3 == 0 else i) for i in range(3000)], "x long, k long")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").filter("k % 2 = 1").withColumn("y", common.F.col("k") * 2)
    want = left.join(right.drop("n"), "k")
    assert sorted(map(tuple, common.hot_join(left, right, "k", 3000).select("x", "k", "y").collect())) == sorted(map(tuple, want.select("x", "k", "y").collect()))
