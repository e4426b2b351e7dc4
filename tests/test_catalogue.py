"""Every query with SQL equals it on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tidemark.operators import bloom
from tidemark.plans import catalogue, stored  # noqa: F401, they register their queries
from tidemark.plans.registry import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, str(DATA)).toPandas()
    want = db.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")
def test_bloom_fp_rate_compares_no_key_with_every_table(spark, monkeypatch):
    monkeypatch.setattr(bloom, "RANGE", 50, raising=False)  # with one range, its one row of sizes is joined without a key
    plan = QUERIES["bloom_fp_rate"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["bloom_probe", "bloom_fp_rate"])
def test_bloom_tables_of_one_number_are_one_table(spark, tmp_path, name):
    """From part 128,000,000 on, tables of level 1 have numbers that level 0 has as well: the filter and the range are of both."""
    keys = [*range(130), *range(5000, 5400), *range(128_000_000, 128_000_128)]
    part = spark.createDataFrame([(k, f"n{k}", f"b{k}") for k in keys], "p_partkey bigint, p_name string, p_brand string")
    part.write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(f'SELECT "{'", "'.join(got.columns)}" FROM ({ORACLE_SQL[name]})').fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("broken", [False, True])
def test_entry_imports_without_the_other_folder(tmp_path, broken):
    """In a copy without the llm folders and the pipeline, or where what they import is missing, the rest is there."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=None if broken else shutil.ignore_patterns("llm"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if broken else [])):
        shutil.copy(root / name, tmp_path / name)
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))]
