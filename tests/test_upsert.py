"""Tables kept by key."""

import random

import pytest
from pyspark.sql import functions as F

from stratalake import Lake, build_silver, load_bronze
from stratalake.operators.upsert import latest_rows, upsert

SCHEMA = "k long, at int, v string"


def _rows(lake, layer="silver", table="t"):
    return sorted(map(tuple, lake.read(layer, table).collect()), key=str)


def test_late_changes_against_a_dictionary(spark, lake):
    """Batches with repeats, changes out of order, ties and rows without a key or an order."""
    rng, kept = random.Random(4), {}
    for step in range(6):
        batch = [(rng.choice([None, *range(12)]), rng.choice([None, *range(5)]), f"{step}-{i}") for i in range(25)]
        upsert(lake, "silver", "t", spark.createDataFrame(batch, SCHEMA).repartition(3), "k", "at", n_buckets=8)
        for k, at, v in batch:
            rank = (-1 if at is None else at, step, v)
            if k is not None and (k not in kept or rank > kept[k][0]):
                kept[k] = (rank, (k, at, v))
        assert _rows(lake) == sorted((r for _, r in kept.values()), key=str)
        assert lake.latest("silver", "t").table_rows == len(kept)


def test_untouched_buckets_keep_their_files(spark, lake, tmp_path):
    first = upsert(lake, "silver", "t", spark.range(1000).selectExpr("id k", "1 at", "'a' v"), "k", "at", n_buckets=16)
    assert len(first.segments[0].buckets) == 16
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "lake" / "silver" / "t").rglob("*.parquet")}
    second = upsert(lake, "silver", "t", spark.createDataFrame([(5, 2, "b")], SCHEMA), "k", "at")
    assert second.n_buckets == 16 and second.rows == 1
    old, new = second.segments
    assert len(old.buckets) == 15 and len(new.buckets) == 1 and second.table_rows == 1000
    assert {p: p.stat().st_mtime_ns for p in files} == files
    written = [p for p in (tmp_path / "lake" / "silver" / "t").rglob("*.parquet") if p not in files]
    assert written and {p.parent.name for p in written} == {f"_bucket={b}" for b in new.buckets}
    plan = lake.read("silver", "t", buckets={int(b) for b in new.buckets})
    assert len(plan.inputFiles()) == len(written)
    assert lake.read("silver", "t").where("v = 'b'").count() == 1 and lake.read("silver", "t").count() == 1000


def test_columns_and_types_grow_but_not_the_kind_of_key(spark, lake):
    upsert(lake, "silver", "t", spark.createDataFrame([(1, 1, 1.5), (2, 1, 2.5)], "k int, at int, x float"), "k", "at", n_buckets=4)
    upsert(lake, "silver", "t", spark.createDataFrame([(2, 2, 9.0, "n")], "k long, at int, x double, note string"), "k", "at")
    assert _rows(lake) == [(1, 1, 1.5, None), (2, 2, 9.0, "n")]
    assert dict(lake.read("silver", "t").dtypes)["k"] == "bigint"
    with pytest.raises(ValueError, match="key k"):
        upsert(lake, "silver", "t", spark.createDataFrame([(1,)], "k int").selectExpr("cast(k as decimal(30,1)) k", "1 at"), "k", "at")


def test_two_writers_and_empty_batches(spark, lake, monkeypatch):
    upsert(lake, "silver", "t", spark.createDataFrame([], SCHEMA), "k", "at", n_buckets=4)
    assert _rows(lake) == []
    upsert(lake, "silver", "t", spark.createDataFrame([(1, 1, "a")], SCHEMA), "k", "at")
    commit, done = lake._commit, []

    def late(*args):
        if not done:
            done.append(1)
            upsert(Lake(spark, lake.root), "silver", "t", spark.createDataFrame([(1, 5, "late"), (2, 1, "b")], SCHEMA), "k", "at")
        return commit(*args)

    monkeypatch.setattr(lake, "_commit", late)
    upsert(lake, "silver", "t", spark.createDataFrame([(1, 3, "c"), (3, 1, "d")], SCHEMA), "k", "at")
    assert _rows(lake) == [(1, 5, "late"), (2, 1, "b"), (3, 1, "d")]


def test_plain_and_keyed_tables_do_not_mix(spark, lake):
    rows = spark.createDataFrame([(1, 1, "a")], SCHEMA)
    lake.write_load("silver", "t", rows, "incremental")
    with pytest.raises(ValueError, match="replace_all"):
        upsert(lake, "silver", "t", rows, "k", "at")
    upsert(lake, "silver", "t", rows, "k", "at", replace_all=True)
    with pytest.raises(ValueError, match="by key"):
        lake.write_load("silver", "t", rows, "incremental")
    lake.write_load("silver", "t", rows, "full")
    assert _rows(lake) == [(1, 1, "a")]


def test_silver_keeps_the_latest_row_of_each_key(spark, lake):
    for batch in ([(1, 1, "a"), (2, 1, "b")], [(2, 0, "late"), (1, 2, "c"), (None, 1, "x")], [(3, 1, "d"), (3, 4, "e"), (1, 1, "old")]):
        load_bronze(lake, "t_bronze", spark.createDataFrame(batch, "row_id long, at int, v string"), "s", "incremental")
        load = build_silver(lake, "t_bronze", incremental=True, latest_by="at")
        assert load.source_load_id == lake.latest("bronze", "t_bronze").load_id
    silver = lake.read("silver", "t_silver").select("row_id", "at", "v")
    assert sorted(map(tuple, silver.collect())) == [(1, 2, "c"), (2, 1, "b"), (3, 4, "e")]
    assert build_silver(lake, "t_bronze", latest_by="at").table_rows == 3


def test_latest_rows_combine_before_the_shuffle(spark):
    text = latest_rows(spark.range(9).selectExpr("id % 2 k", "id at"), "k", "at")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "partial_max" in text
    assert latest_rows(spark.range(9).selectExpr("id % 2 k", "id at"), "k", None).agg(F.sum("at")).first()[0] == 8 + 7
