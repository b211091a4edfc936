"""The registered queries: shape, and agreement with their SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from docloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.ORACLE) == set(catalogue.QUERIES)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_agrees_with_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cur = db.execute(catalogue.ORACLE[name])
    order = [d[0] for d in cur.description]
    assert sorted(order) == columns
    theirs = sorted((tuple(r[order.index(c)] for c in columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == theirs


def test_without_the_training_data_operators(tmp_path):
    """The entry module and the rest of the library do without the subpackage and its tests."""
    top = os.path.dirname(entry.__file__)
    shutil.copytree(f"{top}/docloom", tmp_path / "docloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{top}/{name}"):
            shutil.copy(f"{top}/{name}", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) <= set(q), 'pipeline' in q)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(catalogue.queries())), "True", "False"], said.stderr


def test_subscription(spark):
    n = spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'purchase'").count()
    assert catalogue.QUERIES["subscription_batch"](spark, SF).count() == n


def test_registered_over_whole_collections(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert catalogue.QUERIES["join_self_fk_whole"](spark, SF).count() == orders.count()
    assert catalogue.QUERIES["group_inner_filter_scaled"](spark, SF).count() == orders.where("o_totalprice > 250000").count()


def test_registered_average_is_computed(spark):
    assert catalogue.QUERIES["array_avg_all"](spark, SF).select("s").distinct().count() > 1
