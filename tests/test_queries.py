"""Every query with SQL against DuckDB, on whole small tables; the others give rows with a stable schema."""

import os

import duckdb
import pandas as pd
import pytest

from folia.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


def plain(df: pd.DataFrame) -> list:
    def one(x):
        if x is None or x is pd.NA or isinstance(x, float) and x != x:
            return ""
        return repr(round(float(x), 9)) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, db, name):
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), db.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_without_llm(tmp_path):
    """The entry module works where the subpackage llm is not there."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/folia", tmp_path / "folia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'render_markdown' in q, q; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
