"""Gold tables that follow their Silver table load by load."""

import random

import pytest
from pyspark.sql import functions as F

from stratalake import Lake, build_gold, build_silver, load_bronze
from stratalake.plans import incremental
from stratalake.plans.incremental import refresh_gold, state_name

PLAN = {
    "source_tables": ["sales_silver", "shops_silver"],
    "joins": [{"fact": "sales_silver", "dim": "shops_silver", "on": "shop_id", "type": "left"}],
    "pre_columns": [{"column": "size", "expression": "CASE WHEN amount > 50 THEN 'large' ELSE 'small' END"}],
    "filters": ["coalesce(amount, 0) < 95"],
    "group_by": ["region", "size"],
    "aggregations": [
        {"func": "COUNT", "col": "*", "alias": "n"}, {"func": "COUNT", "col": "amount", "alias": "n_amount"}, {"func": "SUM", "col": "amount", "alias": "total"},
        {"func": "AVG", "col": "amount", "alias": "mean"}, {"func": "MIN", "col": "day", "alias": "first_day"}, {"func": "MAX", "col": "amount", "alias": "top"},
        {"func": "COUNT DISTINCT", "col": "buyer", "alias": "buyers"}, {"func": "COUNT DISTINCT", "col": "shop_id", "alias": "shops"},
        {"func": "RATE", "col": "amount > 20", "alias": "over", "den": "amount"}, {"func": "RATIO", "col": "amount", "den": "day", "alias": "per_day"},
    ],
    "derived_columns": [{"column": "busy", "expression": "n > 30", "type": "boolean"}],
    "destination": "regions",
}


def _sales(spark, seed, n=40):
    rng = random.Random(seed)
    rows = [(seed * 1000 + i, rng.choice([1, 1, 1, 2, 3, 9, None]), rng.choice([None, *range(0, 100, 7)]), rng.randint(0, 30), rng.choice("abcde")) for i in range(n)]
    return spark.createDataFrame(rows, "sale_id int, shop_id int, amount int, day int, buyer string")


def _load(spark, lake, seed, mode="incremental"):
    load_bronze(lake, "sales_bronze", _sales(spark, seed), "s", mode)
    return build_silver(lake, "sales_bronze", pk="sale_id", incremental=True)


def _shops(spark, lake, *regions):
    rows = [(i, r) for i, r in enumerate(regions, 1)]
    load_bronze(lake, "shops_bronze", spark.createDataFrame(rows, "shop_id int, region string"), "s")
    build_silver(lake, "shops_bronze", pk="shop_id")


def _rebuilt(lake, plan):
    return build_gold({n: lake.read("silver", n) for n in ("sales_silver", "shops_silver")}, plan)


def _same(lake, plan):
    got, want = lake.read("gold", plan["destination"]), _rebuilt(lake, plan)
    assert got.dtypes == want.dtypes
    short = [sorted((tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in df.collect()), key=str) for df in (got, want)]
    assert short[0] == short[1] and short[0]


@pytest.fixture
def opened(monkeypatch):
    """The loads of the fact table that runs read."""
    calls, read = [], Lake.read

    def noted(self, layer, table, after_load=None, **more):
        calls.append((table, after_load))
        return read(self, layer, table, after_load, **more)

    monkeypatch.setattr(Lake, "read", noted)
    return calls


def test_each_run_reads_the_new_load_only(spark, lake, opened, monkeypatch):
    monkeypatch.setattr(incremental, "MOST_LOADS", 3)  # so that states are merged on the way
    _shops(spark, lake, "north", "south", "north")
    for seed in range(1, 7):
        load = _load(spark, lake, seed)
        opened.clear()
        rows = refresh_gold(lake, PLAN)
        assert ("sales_silver", load.load_id - 1 if seed > 1 else None) in opened
        state = lake.latest("gold", state_name("regions"))
        assert state.source_load_id == load.load_id and state.load_id - state.first_load_id < 3
        _same(lake, PLAN)
        assert rows == lake.read("gold", "regions").count()
    version = lake.latest("gold", state_name("regions")).version
    refresh_gold(lake, PLAN)  # nothing new: the state stays
    assert lake.latest("gold", state_name("regions")).version == version
    _same(lake, PLAN)


def test_the_scan_of_a_run_has_the_files_of_the_new_load_only(spark, lake, monkeypatch):
    _shops(spark, lake, "north")
    for seed in (1, 2):
        load = _load(spark, lake, seed)
        files, write = [], Lake.write_load
        monkeypatch.setattr(Lake, "write_load", lambda self, layer, table, df, *a, files=files, write=write, **k: files.append((table, df.inputFiles())) or write(self, layer, table, df, *a, **k))
        refresh_gold(lake, PLAN)
        monkeypatch.setattr(Lake, "write_load", write)
    read = dict(files)[state_name("regions")]
    assert [f for f in read if "sales_silver" in f] and all(load.segments[-1].name in f for f in read if "sales_silver" in f)


def test_what_was_replaced_is_retracted(spark, lake):
    _shops(spark, lake, "north", "south")
    for seed in (1, 2):
        _load(spark, lake, seed)
        refresh_gold(lake, PLAN)
    _load(spark, lake, 3, mode="full")
    refresh_gold(lake, PLAN)
    _same(lake, PLAN)
    assert lake.read("gold", "regions").agg(F.sum("n")).first()[0] <= 40
    _shops(spark, lake, "east", "west")  # another dimension
    refresh_gold(lake, PLAN)
    _same(lake, PLAN)
    changed = {**PLAN, "filters": ["amount > 10"]}
    refresh_gold(lake, changed)
    _same(lake, changed)


def test_plans_that_are_built_in_full(spark, lake):
    _shops(spark, lake, "north", "south")
    _load(spark, lake, 1)
    full = {**PLAN, "joins": [{**PLAN["joins"][0], "type": "full"}]}
    refresh_gold(lake, full)
    _same(lake, full)
    assert state_name("regions") not in lake.tables("gold")
    ages = {**PLAN, "pre_columns": [], "group_by": ["region"], "aggregations": [{"func": "MAX", "col": "datediff(current_date(), date'2020-01-01') + day", "alias": "age"}], "derived_columns": []}
    for seed in (1, 2):
        _load(spark, lake, seed)
        refresh_gold(lake, ages)
        _same(lake, ages)
        state = lake.latest("gold", state_name("regions"))
        assert state.load_id == state.first_load_id


def test_global_groups_and_empty_tables(spark, lake):
    plan = {"source_tables": ["sales_silver"], "group_by": [], "aggregations": PLAN["aggregations"][:7], "destination": "all_sales"}
    load_bronze(lake, "sales_bronze", _sales(spark, 1, 0), "s", "incremental")
    build_silver(lake, "sales_bronze", pk="sale_id", incremental=True)
    refresh_gold(lake, plan)
    assert tuple(lake.read("gold", "all_sales").first())[:3] == (0, 0, None)
    _load(spark, lake, 2)
    refresh_gold(lake, plan)
    want = build_gold({"sales_silver": lake.read("silver", "sales_silver")}, plan)
    assert tuple(lake.read("gold", "all_sales").first()) == tuple(want.first())
