import math
from collections import Counter

import numpy as np
import pytest

from mailframe.llm import lmscore, packed


def brute(texts, order, alpha, leave_one_out):
    docs = [(t or "").lower().split() for t in texts]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum((grams(w) for w in docs), Counter())
    words = sum(map(len, docs))
    out = []
    for w in docs:
        own = grams(w) if leave_one_out else Counter()
        c = lambda g: total[g] - own[g]  # noqa: B023, E731
        n_all = words - (len(w) if leave_one_out else 0)
        log, kinds = 0.0, [0, 0, 0]
        for i in range(len(w)):
            reach = min(order, i + 1)
            for n in range(reach, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if c(g) > 0:
                    log += math.log(c(g) / (c(g[:-1]) if n > 1 else n_all) * alpha ** (reach - n))
                    kinds[n < reach] += 1
                    break
            else:
                log += math.log(alpha**order / (n_all + 1))
                kinds[2] += 1
        out.append((len(w), log, *kinds))
    return out


TEXTS = ["the cat sat on the mat", "the cat ran", "The  cat sat on the mat", None, "", " \n", "zzz", "a a a a a b", "on the mat the cat sat", "w " * 3000 + "x", "the cat sat on the mat"]


@pytest.mark.parametrize(("order", "leave", "message"), [(1, True, 0), (2, False, 0), (3, True, 0), (3, False, 0), (4, True, 0), (3, True, 5)])
def test_scores_against_brute_force(spark, order, leave, message):
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(TEXTS)], "doc_id long, text string, slice string, log_score double").repartition(3)
    rows = {r.doc_id: r for r in lmscore.score(df, order=order, leave_one_out=leave, slice_bytes=40, range_bytes=3000, message=message).collect()}
    assert len(rows) == len(TEXTS)
    for i, (n, log, top, back, unseen) in enumerate(brute(TEXTS, order, lmscore.ALPHA, leave)):
        r = rows[i]
        assert (r.n_words, r.n_top, r.n_backoff, r.n_unseen) == (n, top, back, unseen)
        assert r.log_score == pytest.approx(log)
        assert r.mean_log_score == (pytest.approx(log / n) if n else None)


def test_null_and_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    rows = lmscore.score(df).collect()
    assert sorted((r.doc_id for r in rows), key=str) == [1, 1, None] and len({r.log_score for r in rows}) == 1
    assert lmscore.score(df.limit(0)).count() == 0


def test_slices_are_dealt_once(spark):
    df = lmscore.score(spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string"))
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_more_tasks_than_the_session_asks_for(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"a b c {i % 7} d e") for i in range(200)], "doc_id long, text string")
    want = sorted(map(str, lmscore.score(df, message=0).collect()))
    monkeypatch.setattr(lmscore, "TASK_BYTES", 500)
    found = lmscore.score(df, slice_bytes=100, range_bytes=400, message=0)
    assert sorted(map(str, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(slice" in plan and "REPARTITION_BY_NUM" in plan and "ReusedExchange" in plan


def test_messages_stay_long_as_the_corpus_grows():
    of_slice, of_range = 3e6, 3e6
    assert packed.growth(1e10, of_slice, of_range) == 1
    for total in (1e12, 1e14):
        f = packed.growth(total, of_slice, of_range)
        assert of_slice * f * of_range * f / total == pytest.approx(packed.MESSAGE)
        assert of_slice * f < 1e8


def test_packing():
    values = np.array([0, 1, 2**64 - 1, 77], np.uint64)
    assert packed.unpack(packed.pack(values)).tolist() == values.tolist()
    assert packed.unpack(packed.pack(values[:0])).tolist() == []
