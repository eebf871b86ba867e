"""Every registered query against its SQL, and the shape of the plans."""

import importlib
import re
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import connect, differences

from stratalake.queries import all_queries, all_sql

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, SMALL)
    sql = all_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(df, duck, sql) == []
        assert _kinds(df) == _kinds_of(duck, sql)


KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "float": "float", "double": "double",
    "string": "text", "boolean": "bool", "timestamp_ntz": "time", "timestamp": "time", "date": "date",
    "INTEGER": "int", "BIGINT": "long", "FLOAT": "float", "DOUBLE": "double", "VARCHAR": "text",
    "BOOLEAN": "bool", "TIMESTAMP": "time", "DATE": "date",
}


def _kinds(df):
    return {n: KINDS.get(t, t) for n, t in df.dtypes}


def _kinds_of(con, sql):
    return {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in con.execute(sql).description}


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


LAZY = sorted(n for n in all_queries() if n != "gold_incremental" and re.match("gold_|join_|silver_(snake|cast|pk|step)|sql_(join|window|cte|topk|set)", n))


@pytest.mark.parametrize("name", LAZY)
def test_plan_has_no_cross_join_and_no_python(spark, name):
    df = all_queries()[name](spark, SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "MapInPandas"):
        assert bad not in text


def test_projection_and_filter_reach_the_scan(spark):
    text = all_queries()["gold_filter_after_join"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Not(EqualTo(o_orderstatus,F))" in text and "GreaterThan(c_acctbal,0.0)" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_totalprice:double>" in text


def test_ranking_limits_groups_before_the_shuffle(spark):
    text = all_queries()["sql_window_rank"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    partial = [l for l in text.splitlines() if "WindowGroupLimit" in l and "Partial" in l]
    assert partial


@pytest.mark.parametrize("absent", ["zstandard", "tokenizers", "regex", "stratalake.llm"])
def test_entry_without_the_training_data_operators(absent):
    """A library that only those need may be absent."""
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; from stratalake.queries import all_queries; assert set(e.queries()) >= set(all_queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
