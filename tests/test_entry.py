import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
OWN = sorted(n for n in contract.queries() if not n.startswith("op") and n != "pipeline")


def _value(v):
    return float(f"{v:.9g}") if isinstance(v, float) else None if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, con, name):
    df = contract.queries()[name](spark, SF)
    rows = df.collect()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(_value(r[columns.index(c)]) for c in sorted(columns)) for r in got.fetchall()), key=repr)
    assert sorted((tuple(_value(r[c]) for c in sorted(columns)) for r in rows), key=repr) == want


def test_sample_cap_keeps_all_clicks_of_a_large_table(spark, con, tmp_path):
    """Over half a million clicks, each of which the SQL counts."""
    kind = F.when(F.col("id") % 7 == 0, "view").when(F.col("id") % 7 == 1, None).otherwise("click")
    events = spark.range(840_000).select(F.col("id").alias("event_id"), kind.alias("event_type"), (F.col("id") % 97 / 100).alias("value"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = contract.queries()["sample_cap"](spark, str(tmp_path)).collect()
    sql = contract.oracle_sql()["sample_cap"].replace("from events", f"from '{tmp_path}/events.parquet/*.parquet'")
    assert [tuple(r) for r in got] == con.execute(sql).fetchall()
    assert got[0].kept == 600_000 and got[0].sampled == 1000


def test_entry_and_names(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("broken", (False, True))
def test_without_the_corpus_modules(tmp_path, broken):
    """Deleted modules are left out; modules that lack a dependency are an error."""
    root = os.path.dirname(contract.__file__)
    shutil.copytree(f"{root}/quadrille", tmp_path / "quadrille", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    if broken:
        (tmp_path / "quadrille/llm").mkdir()
        (tmp_path / "quadrille/llm/__init__.py").write_text("")
        (tmp_path / "quadrille/llm/registry.py").write_text("import a_module_that_is_not_there")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import __spark_entry__ as c; print(*c.queries(), *c.oracle_sql())"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=60)
    if broken:
        assert run.returncode and "a_module_that_is_not_there" in run.stderr
    else:
        assert set(run.stdout.split()) == set(OWN) | set(contract.oracle_sql()) - {n for n in contract.oracle_sql() if n.startswith("op")}
