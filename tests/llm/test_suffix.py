import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from mailframe.llm import suffix


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, length, n=60):
    rng = random.Random(seed)
    say = lambda k: "".join(rng.choice("abé \0") for _ in range(k))
    passages = [say(rng.randint(length - 3, 3 * length)) for _ in range(4)]
    base = say(6 * length)
    texts = []
    for _ in range(n):
        t = say(rng.randint(0, 2 * length))
        for _ in range(rng.randint(0, 3)):
            t += rng.choice(passages) + say(rng.randint(0, 5))
        texts.append(t)
    for _ in range(n // 2):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        texts.append("".join(w))
    p = passages[0]
    texts += [texts[3]] * 6 + [None, "", "a" * length, "b" * (3 * length), "ab" * length, "a" * (length - 1), p, p[1:], p[:-1] + "q", "é" * length, "x" * 5000]
    return texts


@pytest.mark.parametrize(("seed", "length", "options"), [(1, 40, {}), (2, 40, {"slice_bytes": 3000, "batches": 7, "shard_rows": 60, "range_rows": 50, "message": 0}), (3, 40, {"slice_bytes": 3000, "hot": 3, "range_rows": 50, "message": 0}), (4, 200, {"slice_bytes": 20_000, "batches": 1}), (5, 25, {"slice_bytes": 2000, "hot": 0, "batches": 2}), (6, 40, {"slice_bytes": 500, "range_rows": 50, "message": 20})])
def test_against_brute_force(spark, seed, length, options):
    texts = corpus(seed, length)
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, slice string, range int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.deduplicate(df, length=length, **options).collect()}
    want = dict(enumerate(brute(texts, length)))
    wrong = [i for i in want if got.get(i) != want[i]]
    assert not wrong, [(i, got.get(i), want[i]) for i in wrong[:3]]
    assert sum(w[1] for w in want.values()) > 1000


def test_equal_windows_have_equal_anchors():
    rng = random.Random(9)
    a = "".join(rng.choice("ab") for _ in range(300)).encode()
    b = b"xx" + a[50:250] + b"yy"
    length, gram = 60, 12
    data = np.frombuffer(a + b, np.uint8)
    found = suffix.anchors(data, np.array([0, len(a), len(a) + len(b)]), length, gram)
    anchor = {s: at - s for at, lo, hi in zip(found["at"], found["first"], found["last"], strict=True) for s in range(lo, hi + 1)}
    assert sorted(anchor) == [*range(len(a) - length + 1), *range(len(a), len(a) + len(b) - length + 1)]
    assert all(anchor[50 + i] == anchor[len(a) + 2 + i] for i in range(200 - length + 1))


def test_kept_bytes_and_empty_table(spark):
    df = spark.createDataFrame([(1, "ab" * 30 + "cd"), (None, "cd" + "ab" * 30)], "doc_id long, text string")
    rows = {r.doc_id: r for r in suffix.deduplicate(df, length=60, texts=True).collect()}
    assert bytes(rows[1].kept) == b"cd" and bytes(rows[None].kept) == b"cd"
    assert suffix.deduplicate(df.limit(0)).count() == 0


def array_of(rows, at=0):
    after, before = (np.array([list(r) for r in part], np.uint8).reshape(len(part), w) for part, w in zip(rows, (6, 4), strict=True))
    n = len(after)
    return suffix.SuffixArray(after, before, np.zeros(n, np.int64), np.full(n, 3), np.arange(at, at + n))


def test_merged_arrays_are_what_sorting_anew_gives():
    rng = random.Random(2)
    rows = lambda n: [[bytes(rng.choice(b"\0ab") for _ in range(w)) for _ in range(n)] for w in (6, 4)]
    for n, m in ((0, 1), (1, 0), (5, 9), (60, 40)):
        a, b = rows(n), rows(m)
        a = [np.zeros((0, w), np.uint8) if not n else a[i] for i, w in enumerate((6, 4))]
        b = [np.zeros((0, w), np.uint8) if not m else b[i] for i, w in enumerate((6, 4))]
        both = suffix.SuffixArray.merged(array_of(a), array_of(b, n))
        new = array_of([[*map(bytes, x), *map(bytes, y)] for x, y in zip(a, b, strict=True)])
        for k in ("after", "common", "left_common"):
            assert (getattr(both, k) == getattr(new, k)).all()
        assert (both.before[both.left] == new.before[new.left]).all()
        assert sorted(both.names) == list(range(n + m))


def test_levels_carry_as_in_counting():
    levels, sizes = set(), []
    for _ in range(12):
        rank = suffix.carry(levels)
        levels = {k for k in levels if k > rank} | {rank}
        sizes.append(sum(2**k for k in levels))
    assert sizes == list(range(1, 13))


def test_a_long_text_and_a_passage_in_every_batch(spark):
    rng = random.Random(5)
    say = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = say(300)
    texts = [say(60_000) + passage + say(40_000), *(say(100) + passage + say(100) for _ in range(30)), say(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.deduplicate(df, slice_bytes=2000, batches=5, message=0).collect()}
    assert got == dict(enumerate(brute(texts, 200)))
