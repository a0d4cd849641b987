import random

from hypothesis import given, settings
from hypothesis import strategies as st

from mailframe.llm import decontaminate as dc


def semiglobal(p, t):
    """Least edit distance of p to a substring of t, and the first end, by the plain recurrence."""
    col = list(range(len(p) + 1))
    best = (len(p), 0)
    for at, c in enumerate(t, 1):
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(col[i] + 1, new[i - 1] + 1, col[i - 1] + (x != c)))
        col = new
        if col[-1] < best[0]:
            best = (col[-1], at)
    return best


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=80), st.text(alphabet="abc", max_size=120))
def test_myers_against_the_recurrence(p, t):
    assert dc.myers(dc.masks(p), len(p), t) == semiglobal(p, t)


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(5, 30))) for i in range(25)] + [(30, None), (31, "short"), (32, ""), (None, say(20))]
    items.append((33, items[0][1]))
    docs = []
    for i in range(150):
        t = say(rng.randint(0, 60))
        if i % 2:
            item = list(rng.choice(items[:25])[1])
            for _ in range(rng.randint(0, 14)):
                k = rng.randrange(len(item))
                item[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "a", " "])
            t += rng.choice([" ", ". ", " - "]) + "".join(item).upper() + " " + say(rng.randint(0, 30))
        docs.append((i, t))
    docs += [(200, None), (201, ""), (202, "z " * 60000 + items[3][1]), (None, items[4][1]), (250, items[5][1]), (250, items[5][1])]
    return docs, items


def expected(docs, items):
    out = []
    for d, t in docs:
        for i, x in items:
            p, n = dc.normalize(x), dc.normalize(t)
            e = int(dc.RATE * len(p))
            if len(p) >= dc.MIN_CHARS and n:
                n = n[-1500:] if len(n) > 5000 else n  # the long text holds its item at the end
                if (r := semiglobal(p, n))[0] <= e:
                    out.append((d, i, r[0], e))
    return sorted(out, key=str)


def test_match_and_clean_against_brute_force(spark):
    docs, items = corpus()
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, item_id string, distance int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = expected(docs, items)
    assert len(want) > 40
    for size in (dc.BLOCK_CHARS, 300):
        got = sorted((tuple(r)[:4] for r in dc.match(df, bench, block_chars=size).collect()), key=str)
        assert got == want
    bad = {d for d, *_ in want}
    kept = dc.clean(df, bench, block_chars=1000)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)


def test_empty(spark):
    docs, bench = spark.createDataFrame([(1, "text")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dc.match(docs, bench).count() == 0 and dc.clean(docs, bench).count() == 1
    assert dc.match(docs.limit(0), spark.createDataFrame([(1, "a" * 30)], "item_id long, text string")).count() == 0


def test_short_items_occur_exactly_on_word_bounds(spark):
    items = [(1, "Who won?"), (2, "水的沸点"), (3, "?!"), (4, None), (5, "7 x 8")]
    texts = ["So WHO, won: the cup", "who wons it", "awho won", "who wan", "who won", "who wonx, who won", "问水的沸点是多少", "水的沸 点", "17 x 8", "7 x 8", "?!", "", None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in dc.match(docs, bench).collect()}
    assert got == {(0, 1, 0, 0, 10), (4, 1, 0, 0, 7), (5, 1, 0, 0, 16), (6, 2, 0, 0, 5), (9, 5, 0, 0, 5)}
    assert {r.doc_id for r in dc.clean(docs, bench).collect()} == set(range(len(texts))) - {0, 4, 5, 6, 9}
