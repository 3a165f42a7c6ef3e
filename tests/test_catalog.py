import os
import subprocess
import sys
from datetime import date, datetime

import duckdb
import pytest

from karst.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if isinstance(v, (date, datetime)) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    sql = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    cols = sorted(df.columns)
    mine = sorted(tuple(map(repr, (plain(r[c]) for c in cols))) for r in df.collect())
    theirs = sorted(tuple(map(repr, (plain(r[sql.columns.index(c)]) for c in cols))) for r in sql.fetchall())
    assert mine == theirs and mine


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry_without_the_optional_subpackage(tmp_path):
    """The entry module and the catalogue work in a copy without it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run(["cp", "-r", f"{root}/karst", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "karst/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) == len(catalog.QUERIES), out.stderr
