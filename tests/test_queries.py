"""Every registered query of the engine against its SQL on the smallest tables."""

import datetime

import duckdb
import pytest

from tripleframe import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(cell, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, tables, name):
    df = queries.QUERIES[name](spark, SF)
    got = sorted((tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name not in queries.ORACLE:
        return
    want = tables.sql(queries.ORACLE[name])
    order = [want.columns.index(c) for c in sorted(df.columns)]
    assert got == sorted((tuple(cell(r[i]) for i in order) for r in want.fetchall()), key=repr)


def test_star_is_one_scan_with_pushed_filter(spark):
    import re

    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")  # else the plan's text is cut
    try:
        plan = queries.QUERIES["bgp_star"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert plan.count("FileScan") == 1 and "Join" not in plan
    pushed = set(re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan)[1].split(", "))
    assert {"IsNotNull(c_acctbal)", "IsNotNull(c_custkey)"} <= pushed and any(x.startswith("GreaterThan(c_acctbal") for x in pushed)


def test_exists_is_a_semi_join(spark):
    for name, kind in (("exists_corr", "LeftSemi"), ("not_exists_corr", "LeftAnti"), ("minus_basic", "LeftAnti"), ("optional_basic", "LeftOuter")):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert kind in plan and "BroadcastNestedLoop" not in plan


def test_joins_on_variables_that_may_be_unbound_are_equi_joins(spark):
    for name in ("values_undef", "optional_reused"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" in plan


def test_top_k_takes_ordered(spark):
    assert "TakeOrderedAndProject" in queries.QUERIES["flagship"](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("gone", [["tripleframe/llm", "tests/llm"], ["tripleframe/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_works_without_the_optional_part(tmp_path, gone):
    """A copy of the tree without those files, in a process of its own."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "tree", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *(Path(g).name for g in gone)))
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
from tripleframe import queries
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
assert set(e.queries()) == set(queries.QUERIES) and set(e.oracle_sql()) == set(queries.ORACLE)
assert e.entry(spark).count() == 10
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "tree", check=True, timeout=180)
