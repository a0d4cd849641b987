import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from mailframe.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_against_its_oracle(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in catalogue.ORACLES:
        result = db.execute(catalogue.ORACLES[name])
        assert got == table([d[0] for d in result.description], result.fetchall())


def test_null_texts_stay_in_the_dirty_corpus(spark, tmp_path):
    spark.createDataFrame([(i, None if i % 2 else f"text {i}") for i in range(16)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("clean_invisible", "trim_lines", "collapse_newlines", "tidy_body", "truncate_body", "body_lengths"):
        rows = catalogue.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(r.msg_id for r in rows) == list(range(16))
        assert all((v is None) == (r.msg_id % 2 == 1) for r in rows for v in tuple(r)[1:])


def test_every_branch_of_the_corpora_fires(spark):
    from pyspark.sql import functions as F

    kinds = catalogue.QUERIES["quote_header_kind"](spark, DATA).agg(*(F.max(f"q{i}").alias(f"q{i}") for i in range(1, 10))).first()
    assert all(kinds)
    assert catalogue.QUERIES["thread_messages"](spark, DATA).agg(F.countDistinct("sender")).first()[0] > 6
    assert catalogue.QUERIES["cta_from_html"](spark, DATA).agg(F.countDistinct("confidence")).first()[0] >= 4


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("left_over", [True, False])
def test_the_rest_does_not_need_the_llm_subpackage(tmp_path, left_over):
    """On a copy without the folders, with corpus_pipeline.py still there or gone."""
    here = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for name in ("mailframe", "__spark_entry__.py", *(["corpus_pipeline.py"] if left_over else [])):
        copy = shutil.copytree if os.path.isdir(f"{here}/{name}") else shutil.copy
        copy(f"{here}/{name}", f"{tmp_path}/{name}")
    shutil.rmtree(f"{tmp_path}/mailframe/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; from mailframe.plans import catalogue as c; assert set(e.queries()) == set(c.QUERIES) and set(e.oracle_sql()) == set(c.ORACLES)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
