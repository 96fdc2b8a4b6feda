import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from busloom.operators import pairing
from busloom.plans.queries import QUERIES, SQL

from .oracle import connect, compare

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert not df.isEmpty()
    compare(df, duck, SQL[name])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("span", [1, 7])
def test_pairs_across_spans(spark, duck, monkeypatch, span):
    """A file is no group of its own: spans of its records are, and what stands before the first of each is known."""
    monkeypatch.setattr(pairing, "SPAN", span)
    compare(QUERIES["continuation_pairing"](spark, SF), duck, SQL["continuation_pairing"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("first", [3_355_200, 33_554_400])
def test_counters_that_wrap(spark, tmp_path, first):
    """Events so late that a counter of 32 bits wraps inside a file, or has done so several times."""
    import duckdb

    spark.read.parquet(f"{SF}/events.parquet").withColumn("event_id", F.col("event_id") + first).write.parquet(f"{tmp_path}/events.parquet")
    own = duckdb.connect()
    own.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    compare(QUERIES["counter_times"](spark, str(tmp_path)), own, SQL["counter_times"])


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 50 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Functions are shipped whole: the driver alone has the package on its path."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
import __spark_entry__ as e
for q in ('collapse_window', 'frame_records', 'dump_limit', 'pieces_filtered'):
    assert e.queries()[q](spark, {SF!r}).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300)
