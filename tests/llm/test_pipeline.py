import random

import corpus_pipeline
from mailframe.llm import decontaminate, mixing, neardup, sharding
from mailframe.llm.common import materialize
from tests.llm.test_mixing import brute_schedule
from tests.llm.test_neardup import corpus, shingle_set


def test_deduplicate_keeps_one_of_each_class(spark):
    rows = corpus(3) + [(None, "only here and without any id at all"), (None, "only here and without any id at all"), (100, corpus(3)[60][1])]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, rep int, nth string")
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    classes = {}
    found = {r.rep: r for r in neardup.classify(df).collect()}
    for r in found.values():
        classes.setdefault(r.root if r.root is not None else r.rep, []).append(r)
    assert len(got) == len(classes)
    assert sorted((min(x.doc_id for x in c) for c in classes.values() if c[0].doc_id is not None), key=str) == sorted((i for i, _ in got if i is not None), key=str)
    sets = [shingle_set(t) for _, t in got]
    for i, a in enumerate(sets):
        assert not any(a & b and 10 * len(a & b) >= 8 * len(a | b) for b in sets[:i])


def test_mixed_order_of_rows(spark):
    docs = [(i, "ab"[i % 3 == 0], f"t{i}") for i in range(200)]
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, source string, text string, slot int")
    weights = spark.createDataFrame([("a", 1), ("b", 2)], "source string, units long")
    got = [(r.source, r.doc_id) for r in mixing.mixed(df, weights, block=4).collect()]
    assert sorted(i for _, i in got) == list(range(200))
    slots = ["ab"[i] for i in brute_schedule([1, 2])]
    blocks = [got[i][0] for i in range(0, 60, 4)]
    assert blocks == (slots * 6)[: len(blocks)]


def test_run_against_stages_by_hand(spark, tmp_path):
    rng = random.Random(8)
    words = {"aa": "shoru theng wick thash ending wher".split(), "bb": "lopez quion señor ciónar delas unos".split()}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "a", "st", "o"]) for _ in range(n))
    items = [(i, say("aa", 12)) for i in range(4)]
    docs = []
    for i in range(240):
        lang = rng.choice(["aa", "bb"])
        docs.append([i, say(lang, rng.randint(20, 60)), lang, f"s{i % 3}"])
    for i in range(0, 30, 3):
        docs[i][1] = docs[100][1]
    for i in range(40, 60, 5):
        docs[i][1] += " " + items[i % 4][1].upper()
    docs[70][1], docs[71][1], docs[72][1] = None, "", "12 34 --"
    rows = [(*d, len(d[1] or "")) for d in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    gone = {70, 71, 72} | set(range(3, 30, 3)) | {100}
    gone |= {d[0] for d in docs if any(decontaminate.normalize(x) in decontaminate.normalize(d[1]) for _, x in items)}
    assert sorted(r.doc_id for r in got) == sorted(d[0] for d in docs if d[0] not in gone)
    assert {(r.doc_id, r.text) for r in got} <= {(d[0], d[1]) for d in docs}
    assert all(r.shard for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "mixing_weights", "sharding"]


def test_shards_follow_the_mixed_order_over_unequal_files(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.randbytes(20 + i // 4).hex(), "abcd"[min(3, i % 7)]) for i in range(6000)]  # later files are larger
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = [r.doc_id for r in mixing.mix(df).orderBy("slot", "place").collect()]
    path = f"file://{tmp_path}/corpus"
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda *_: path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = materialize(corpus_pipeline.mixing_weights(spark, df, ""), "mixed", f"{tmp_path}/mixed")
        assert len(list((tmp_path / "mixed").glob("*.parquet"))) > 1
        out = corpus_pipeline.sharding_(spark, docs, "")
        assert out.columns == [*df.columns, "shard", "shard_tier", "shard_version"] and out.count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    shards = sharding.manifest(spark, path).orderBy("first").collect()
    assert 1 < len(shards) < sharding.manifest(spark, path, 1).count()
    got = []
    for s in shards:
        for f in s.files:
            got += [r.doc_id for r in spark.read.parquet(f).select("doc_id", "_metadata.row_index").orderBy("row_index").collect()]
    assert got == want
