import __spark_entry__ as E


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 40


def test_oracle_smoke_sf0001(spark):
    import duckdb

    from grainset.session import DRIVER_TABLES

    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name in ("monthly_mean", "weekly_by_author", "dnf_filter", "batches", "ngram_overlap", "weighted_mix"):
        a = E.queries()[name](spark, "/root/testdata/sf0.001")
        b = con.execute(E.oracle_sql()[name]).fetchall()
        assert a.count() == len(b), name


def test_python_worker_queries_from_foreign_cwd(tmp_path):
    """Queries with Python on executors must work when Spark is driven from another
    directory (workers get the package through addPyFile)."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
for name in ("transform_batch", "rowgroup_catalog", "ngram_no_overlap", "buffer_shuffle_rows", "rowgroup_scan_select"):
    print(name, E.queries()[name](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=str(tmp_path), env=env, capture_output=True,
                         text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.count("\n") == 5
