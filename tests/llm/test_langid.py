import itertools
import random
import zlib

import numpy as np
import pytest

from mailframe.llm import crf, langid


def tiny(seed, tokens=5, k=3):
    rng = np.random.default_rng(seed)
    return crf.Model(list("abc")[:k], np.zeros((1, k)), rng.normal(size=(k, k)), rng.normal(size=k)), rng.normal(size=(tokens, k))


def path_score(model, scores, path):
    return model.start[path[0]] + sum(scores[t, y] for t, y in enumerate(path)) + sum(model.transitions[a, b] for a, b in zip(path, path[1:], strict=False))


@pytest.mark.parametrize("seed", range(4))
def test_forward_backward_and_viterbi_against_all_paths(seed):
    model, scores = tiny(seed, 9)
    offsets = np.array([0, 5, 5, 6, 9])  # four sequences, one empty
    p, best = crf.marginals(model, scores, offsets), crf.viterbi(model, scores, offsets)
    for a, b in zip(offsets, offsets[1:], strict=False):
        if a == b:
            continue
        paths = list(itertools.product(range(3), repeat=b - a))
        weight = np.exp([path_score(model, scores[a:b], y) for y in paths])
        for t in range(b - a):
            for y in range(3):
                assert p[a + t, y] == pytest.approx(sum(w for w, x in zip(weight, paths, strict=True) if x[t] == y) / weight.sum())
        assert tuple(best[a:b]) == paths[int(np.argmax(weight))]


def test_training_gradient_learns_transitions():
    tags = np.array([0, 1] * 30)
    model = crf.train(np.zeros(60, np.int64), np.arange(61), tags, np.arange(0, 61, 6), ["x", "y"], 1, epochs=40)
    assert crf.viterbi(model, np.zeros((6, 2)), np.array([0, 6])).tolist() == [0, 1, 0, 1, 0, 1]


WORDS = {"aa": "shoru theng wick thash ending", "bb": "lopez quion señor ciónar delas", "cc": "schön über kraft münd scheit"}


def text(rng, lang, n=30):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "ti", "en"]) for _ in range(n))


def test_held_out_accuracy_and_code_switching(spark):
    rng = random.Random(3)
    docs = [(i, text(rng, lang), lang) for i, lang in enumerate(rng.choices(sorted(WORDS), k=300))]
    extra = [(1000, None, "aa"), (1001, "", None), (1002, "12 34 !?", "bb"), (1006, "² ½ ① Ⅷ ٣", None), (1003, "x" * 100_000, None), (None, docs[0][1], None), (1004, docs[0][1], None), (1004, docs[0][1], None), (1005, text(rng, "aa") + " " + text(rng, "bb"), None)]
    df = spark.createDataFrame([(*d, "s") for d in docs + extra], "doc_id long, text string, lang string, score string").repartition(3)
    rows = langid.identify(df, per_language=50).collect()
    assert len(rows) == len(docs) + len(extra)
    got = {r.doc_id: r for r in rows}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [d for d in docs if got[d[0]].held_out]
    assert len(unseen) > 30 and sum(got[i].lang_pred == lang for i, _, lang in unseen) >= 0.95 * len(unseen)
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002, 1006)] == [("und", 0.0)] * 4
    assert got[1003].lang_pred in WORDS and 0 <= got[1003].score <= 1
    assert got[None].lang_pred == got[1004].lang_pred == got[0].lang_pred and got[1004].score == pytest.approx(got[0].score)
    assert 1 <= got[1005].n_switches <= 6
    labels = langid.fit([(t, lang) for _, t, lang in docs[:150]])
    words, p, _ = labels.words([text(rng, "aa", 15) + " " + text(rng, "cc", 15)])
    called = [labels.model.labels[i] for i in p.argmax(1)]
    assert sum(a == b for a, b in zip(called, ["aa"] * 15 + ["cc"] * 15, strict=True)) >= 27


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    [row] = langid.identify(df).collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)
    assert langid.identify(df.limit(0)).count() == 0


def test_words_are_runs_of_letters():
    assert langid.split("x² ab½cd l’été don't ①② 漢字 Ⅷ") == ["x", "ab", "cd", "l’été", "don't", "漢字"]
