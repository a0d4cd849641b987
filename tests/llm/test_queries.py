"""Each registered query over the driver's smallest tables, against brute force."""

import hashlib
import os
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from mailframe.llm import decontaminate, media, pii, queries
from mailframe.llm import sharding as sh
from tests.llm.test_decontaminate import semiglobal
from tests.llm.test_neardup import brute as brute_near
from tests.llm.test_pii import brute as brute_pii
from tests.llm.test_suffix import brute as brute_suffix

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{DATA}/documents.parquet").sort_by("doc_id").to_pylist()


def run(spark, name, key="doc_id"):
    rows = __spark_entry__.queries()[name](spark, DATA).collect()
    return sorted(rows, key=lambda r: r[key])


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}


def test_op1(spark, docs):
    rows = run(spark, "op1_media_columns")
    assert len(rows) == len(docs)
    for r, d in zip(rows, docs, strict=True):
        p = media.pad((d["text"] or "").encode())
        image = media.encode_png(p)
        want = (d["doc_id"], len((d["text"] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(image), hashlib.sha256(image).hexdigest(), media.feature(p))
        assert tuple(r) == want


def test_op2(spark):
    turns = sorted(pq.read_table(f"{DATA}/conversations.parquet").to_pylist(), key=lambda t: (t["conv_id"], t["turn"]))
    turns += [{"conv_id": -7, "role": r, "text": queries.CHAT_CONTROL} for r in ("user", "assistant")]
    rows = {r.conv_id: r for r in run(spark, "op2_chat_formatting", "conv_id")}
    assert set(rows) == {t["conv_id"] for t in turns}
    for c, r in rows.items():
        own = [(t["role"], t["text"] or "") for t in turns if t["conv_id"] == c]
        loss = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= sum(len(t) for _, t in own)


def test_op3(spark, docs):
    items = pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()
    got = {(r.doc_id, r.item_id): r.distance for r in run(spark, "op3_benchmark_decontamination")}
    exact = {(d["doc_id"], i["item_id"]) for d in docs for i in items if decontaminate.normalize(i["text"]) in decontaminate.normalize(d["text"])}
    assert {k for k, v in got.items() if v == 0} == exact and exact
    short = [d for d in docs if len(d["text"]) < 1200][:25]
    for d in short:
        for i in items[:10]:
            p = decontaminate.normalize(i["text"])
            best = semiglobal(p, decontaminate.normalize(d["text"]))[0]
            assert got.get((d["doc_id"], i["item_id"])) == (best if best <= int(decontaminate.RATE * len(p)) else None)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_oracles(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = __spark_entry__.queries()[name](spark, DATA)
    want = con.execute(queries.ORACLES[name])
    order = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(order)
    assert sorted(map(str, (tuple(r) for r in df.select(order).collect()))) == sorted(map(str, want.fetchall()))


def test_op5(spark, docs):
    rows = run(spark, "op5_language_id")
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    unseen = [(r, d) for r, d in zip(rows, docs, strict=True) if r.held_out and d["lang"]]
    assert sum(r.lang_pred == d["lang"] for r, d in unseen) >= 0.9 * len(unseen)


def test_op6(spark, docs):
    rows = run(spark, "op6_suffix_array_dedup")
    assert [tuple(r)[1:] for r in rows] == brute_suffix([d["text"] for d in docs], 200)
    assert sum(r.n_removed for r in rows) > 0


def test_op7(spark, docs):
    rows = run(spark, "op7_pii")
    assert len(rows) == len(docs)
    for r, d in zip(rows, docs, strict=True):
        base = sorted(brute_pii(d["text"] or ""), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        spans = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        assert set(spans) <= set(r.spans.split(","))


def test_op8(spark, docs):
    rows = run(spark, "op8_ngram_jaccard_join")
    cls, links = brute_near([(d["doc_id"], d["text"]) for d in docs])
    assert [(r.class_id, r.n_links) for r in rows] == [(docs[c]["doc_id"], n) for c, n in zip(cls, links, strict=True)]


def test_op10(spark, docs):
    rows = run(spark, "op10_sharding")
    assert [(r.doc_id, r.source, r.n_chars) for r in rows] == [(d["doc_id"], d["source"], d["n_chars"]) for d in docs]
    assert all(r.shard and r.shard_version >= 1 for r in rows) and sh.FANOUT > 1


def test_pipeline_keeps_clean_documents(spark, docs):
    rows = run(spark, "pipeline")
    items = [decontaminate.normalize(i["text"]) for i in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()]
    cls, _ = brute_near([(d["doc_id"], d["text"]) for d in docs])
    leaks = {d["doc_id"] for d in docs if any(i in decontaminate.normalize(d["text"]) for i in items)}
    wordless = {d["doc_id"] for d in docs if not any(c.isalpha() for c in d["text"] or "")}
    want = {d["doc_id"] for i, d in enumerate(docs) if cls[i] == i} - leaks - wordless
    got = {r.doc_id for r in rows}
    assert got <= want and len(got) == len(rows) and len(got) >= 0.95 * len(want)
