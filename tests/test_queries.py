"""Every query with a DuckDB form against it, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from emberline.queries import ORACLE_SQL, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DIR}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(frame):
    """Rows as sorted tuples over columns by name, numbers to five decimals."""
    rows = []
    for row in frame[sorted(frame.columns)].itertuples(index=False):
        rows.append(tuple(None if pd.isna(v) else round(float(v), 5) if not isinstance(v, str) else v for v in row))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["jid", "cpuuser_cnt", "cpuuser_mean", "cpuuser_std", "cpuuser_trend"] and df.count() > 0


def test_trees_score_between_0_and_1(spark):
    rows = QUERIES["gbt_fit_predict"](spark, "/root/testdata/sf0.01").collect()
    assert rows and all(0 <= r.score <= 1 for r in rows)


def test_trees_score_the_late_jobs_of_every_cluster(spark):
    from emberline.queries import matrix_of

    late = matrix_of(spark, "/root/testdata/sf0.01").filter("month >= '1999-01'").select("jid", "cluster").collect()
    scored = {r.jid for r in QUERIES["gbt_fit_predict"](spark, "/root/testdata/sf0.01").select("jid").collect()}
    assert len({r.cluster for r in late}) == 5 and scored == {r.jid for r in late}


def test_registry_without_the_training_data_operators(tmp_path):
    """The entry imports, and keeps its other queries, where that subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/emberline", f"{tmp_path}/emberline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'te_expanding' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
