import math
import re

import pytest
from fixtures import (
    LEAVE_CSV,
    ROUTES_CSV,
    TICKETS_JSON,
    TRANSACTIONS_JSON,
    agents,
    customers,
    employees,
    silver_of,
    vehicles,
)
from pyspark.sql import functions as F

from stratalake import PlanError, build_gold, to_silver
from stratalake.operators import joins as J
from stratalake.plans import gold
from stratalake.plans.spec import GoldPlan, plans_of
from stratalake.queries.gold import _LINES

STRATEGIES = ["plain", "two_step", "eager", "spread", "auto"]


def _agg(func, col, alias, **more):
    return {"func": func, "col": col, "alias": alias, **more}


def _rows(df, key):
    return {r[key]: r for r in df.collect()}


# -- recorded plans ---------------------------------------------------------------


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_customer_revenue(spark, tmp_path, strategy):
    _, transactions, _ = silver_of(spark, tmp_path, "transactions.json", TRANSACTIONS_JSON)
    plan = {
        "source_tables": ["pg_customers_silver", "transactions_silver"],
        "joins": [{"fact": "pg_customers_silver", "dim": "transactions_silver", "on": "customer_id", "type": "left"}],
        "group_by": ["customer_id", "first_name", "tier"],
        "aggregations": [
            _agg("COUNT", "*", "total_transactions_count"),
            _agg("SUM", "amount", "total_spend"),
            _agg("AVG", "amount", "average_order_value"),
            _agg("MAX", "txn_timestamp", "last_active_at"),
        ],
        "column_aliases": [{"from": "first_name", "to": "customer_name"}, {"from": "tier", "to": "membership_tier"}],
        "derived_columns": [{"column": "is_premium_customer", "expression": "total_spend > 300", "type": "boolean"}],
        "destination": "gold_customer_revenue_summary",
    }
    source = {"pg_customers_silver": customers(spark), "transactions_silver": transactions}
    out = build_gold(source, plan, strategy=strategy)
    assert out.columns[:3] == ["customer_id", "customer_name", "membership_tier"]
    assert dict(out.dtypes)["total_spend"] == "double" and dict(out.dtypes)["last_active_at"] == "string"
    got = {k: tuple(r)[3:] for k, r in _rows(out, "customer_id").items()}
    assert got == {
        51: (1, 310.0, 310.0, "2025-02-02T09:00:00Z", True),
        52: (2, 32.5, 16.25, "2025-02-03T12:30:00Z", False),
        53: (1, None, None, None, False),  # the unmatched row counts; a flag is never NULL
    }


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_fleet_efficiency(spark, tmp_path, strategy):
    _, routes, _ = silver_of(spark, tmp_path, "route_telemetry.csv", ROUTES_CSV)
    plan = {
        "source_tables": ["vehicles", "routes"],
        "joins": [{"fact": "vehicles", "dim": "routes", "on": "vehicle_id", "type": "left"}],
        "filters": ["status <> 'Cancelled'"],
        "group_by": ["vehicle_id", "plate_number", "model", "status"],
        "aggregations": [
            _agg("SUM", "distance_miles", "total_distance_covered"),
            _agg("SUM", "distance_miles)/sum(hours_taken", "average_speed_mph"),
            _agg("RATIO", "distance_miles", "fuel_efficiency_mpg", den="fuel_consumed_gallons"),
        ],
        "destination": "gold_fleet_fuel_efficiency_metrics",
    }
    if strategy == "auto":
        spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        rows = _rows(build_gold({"vehicles": vehicles(spark), "routes": routes}, plan, strategy=strategy), "vehicle_id")
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert sorted(rows) == [41, 42, 43]
    assert rows[43].fuel_efficiency_mpg is None
    want = {41: (50.0, 12.5), 42: (55.5, 11.0)}
    for k, (mph, mpg) in want.items():
        assert math.isclose(rows[k].average_speed_mph, mph, rel_tol=1e-5)
        assert math.isclose(rows[k].fuel_efficiency_mpg, mpg, rel_tol=1e-5)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_leave_by_department(spark, tmp_path, strategy):
    _, leave, _ = silver_of(spark, tmp_path, "leave_logs.csv", LEAVE_CSV)
    plan = {
        "source_tables": ["leave", "employees"],
        "joins": [{"fact": "leave", "dim": "employees", "on": "leave.employee_id = employees.employee_id", "type": "left"}],
        "filters": ["status='Active'", "approval_status = 'Approved'"],
        "group_by": ["department"],
        "aggregations": [
            _agg("COUNT", "*", "active_employees_count"),
            _agg("SUM", "datediff(end_date, start_date)", "total_approved_leave_days"),
            _agg("SUM", "datediff(end_date, current_date())", "total_pending_leave_days"),
            _agg("AVG", "salary_usd", "average_salary"),
        ],
        "destination": "gold_departmental_leave_utilization",
    }
    source = {"leave": leave, "employees": employees(spark)}
    if strategy == "two_step":  # measures of two tables: only the other strategies apply
        with pytest.raises(PlanError, match="two_step"):
            build_gold(source, plan, strategy=strategy)
        return
    rows = _rows(build_gold(source, plan, as_of="2025-03-10", strategy=strategy), "department")
    assert {k: tuple(r)[1:] for k, r in rows.items()} == {"X": (1, 10, 3, 110.0), "Y": (1, 2, 58, 220.0)}


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_team_workload(spark, tmp_path, strategy):
    """Points and speed per team: pre-columns of either side, a full join, a rate and a distinct count."""
    _, tickets, _ = silver_of(spark, tmp_path, "ticket_events.json", TICKETS_JSON)
    plan = {
        "source_tables": ["tickets", "agents"],
        "joins": [{"fact": "tickets", "dim": "agents", "on": "agent_id", "type": "full"}],
        "pre_columns": [
            {"column": "team", "expression": "coalesce(agents.tier_level, 'none')"},
            {"column": "points", "expression": "element_at(map('Low', 1, 'High', 5, 'Critical', 8), priority)"},
        ],
        "group_by": ["team"],
        "aggregations": [
            _agg("COUNT", "ticket_id", "n"),
            _agg("SUM", "points", "sum_points"),
            _agg("RATE", "response_time_minutes <= 20", "quick", den="ticket_id"),
            _agg("MAX", "response_time_minutes", "slowest"),
            _agg("COUNT DISTINCT", "agent_id", "people"),
        ],
        "destination": "team_workload",
    }
    rows = _rows(build_gold({"tickets": tickets, "agents": agents(spark)}, plan, strategy=strategy), "team")
    assert {k: tuple(r)[1:] for k, r in rows.items()} == {
        "T1": (1, 8, 100.0, 9, 2),  # 23 has no ticket and counts as one of the people
        "T2": (2, 13, 50.0, 50, 1),
        "none": (1, 1, 0.0, 121, 1),
    }


# -- plans against plain SQL, on crowded keys ---------------------------------------


@pytest.fixture(autouse=True)
def small_parts(monkeypatch):
    """Keys count as crowded, and are cut, at test size."""
    monkeypatch.setattr(J, "SHARE", 0.01)
    monkeypatch.setattr(J, "MIN_ROWS", 20)


@pytest.fixture(scope="module")
def crowded(spark):
    """A third of the facts share one key, a tenth have none, some keys have no dimension row; a
    dimension key comes twice."""
    n = 6000
    key = F.expr(f"CASE WHEN id < {n // 3} THEN 7 WHEN id < {n // 3 + n // 10} THEN NULL ELSE id % 50 END")
    facts = spark.range(0, n, 1, 3).select(
        key.cast("int").alias("k"),
        (F.col("id") % 13).cast("int").alias("x"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 5).alias("y"),
        F.concat(F.lit("t"), F.col("id") % 3).alias("t"),
        F.expr("cast(id % 7 as decimal(8,2))").alias("d"),
    )
    dims = spark.range(5, 60, 1, 1).select(
        F.col("id").cast("int").alias("k"), F.concat(F.lit("g"), F.col("id") % 4).alias("g"), F.col("id").alias("w")
    )
    dims = dims.unionByName(spark.createDataFrame([(7, "g1", 1), (None, "g2", 2)], "k int, g string, w long"))
    return {"facts": facts, "dims": dims}


CHECKS = [
    _agg("COUNT", "*", "n"),
    _agg("COUNT", "y", "ny"),
    _agg("SUM", "x", "sx"),
    _agg("AVG", "y", "ay"),
    _agg("AVG", "d", "ad"),
    _agg("SUM", "d", "sd"),
    _agg("MIN", "x", "lo"),
    _agg("MAX", "coalesce(y, 99)", "hi"),
    _agg("SUM", "CASE WHEN x > 3 THEN 1 ELSE 0 END", "big"),
    _agg("COUNT_IF", "y IS NULL", "no_y"),
    _agg("RATE", "x > 3", "pct", den="y"),
    _agg("RATIO", "x", "r", den="y"),
    _agg("COUNT DISTINCT", "x", "dx"),
]
CHECK_SQL = """count(*) n, count(y) ny, sum(x) sx, avg(y) ay, avg(d) ad, sum(d) sd, min(x) lo,
    max(coalesce(y, 99)) hi, sum(CASE WHEN x > 3 THEN 1 ELSE 0 END) big, count_if(y IS NULL) no_y,
    try_divide(sum(CASE WHEN x > 3 THEN 1 ELSE 0 END), count(y)) * 100 pct, try_divide(sum(x), sum(y)) r,
    count(DISTINCT x) dx"""


def _plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("strategy", ["plain", "two_step", "eager", "spread"])
@pytest.mark.parametrize("first, second", [("facts", "dims"), ("dims", "facts")])
@pytest.mark.parametrize("kind", ["left", "full"])
@pytest.mark.parametrize("group", [["g"], ["k", "t"], []])
def test_strategies_agree_with_sql(spark, crowded, strategy, first, second, kind, group):
    plan = {
        "source_tables": [first, second],
        "joins": [{"fact": first, "dim": second, "on": "k", "type": kind}],
        "filters": ["coalesce(t, 'none') <> 't2'"],
        "group_by": group,
        "aggregations": CHECKS,
    }
    for name, df in crowded.items():
        df.createOrReplaceTempView(name)
    got = build_gold(crowded, plan, strategy=strategy)
    names = ", ".join(group)
    # a plan's unmatched left row has the left key; USING gives the same
    sql = f"""SELECT {names + ', ' if group else ''}{CHECK_SQL} FROM {first} {kind} JOIN {second} USING (k)
              WHERE coalesce(t, 'none') <> 't2' {'GROUP BY ' + names if group else ''}"""
    want = spark.sql(sql)
    assert got.dtypes == want.dtypes
    assert _plain(got.collect()) == _plain(want.collect())


def test_two_step_combines_before_the_join(spark, crowded, tmp_path):
    for name, df in crowded.items():
        df.write.parquet(str(tmp_path / name))
    source = {n: spark.read.parquet(str(tmp_path / n)) for n in crowded}
    plan = {
        "source_tables": ["dims", "facts"],
        "joins": [{"dim": "facts", "on": "k", "type": "left"}],
        "group_by": ["g"],
        "aggregations": [_agg("SUM", "x", "sx")],
    }
    text = build_gold(source, plan, strategy="two_step")._jdf.queryExecution().executedPlan().toString()
    below_join = text[text.index("Join") :]
    assert "partial_sum(x" in below_join and "ReadSchema: struct<k:int,x:int>" in below_join


def test_auto_leaves_broadcast_joins_alone_and_combines_large_ones(spark, crowded):
    plan = {
        "source_tables": ["dims", "facts"],
        "joins": [{"dim": "facts", "on": "k", "type": "left"}],
        "group_by": ["k"],
        "aggregations": [_agg("SUM", "x", "sx")],
    }

    def has_partials():
        return "_p0_0" in build_gold(crowded, plan)._jdf.queryExecution().analyzed().toString()

    assert not has_partials()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        assert has_partials()
        mixed = {**plan, "aggregations": [_agg("SUM", "x * w", "s")]}
        assert "_rows0" in build_gold(crowded, mixed)._jdf.queryExecution().analyzed().toString()
        rounded = {**plan, "aggregations": [_agg("SUM", "x * cast(w as decimal(20, 8))", "s")]}
        assert "_part" in build_gold(crowded, rounded)._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_eager_plan_reads_each_table_once_and_moves_partials_only(spark):
    """Broadcasting is off, and the aggregates read both tables."""
    source = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("lineitem", "orders")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        auto = build_gold(source, _LINES)
        lines = auto._jdf.queryExecution().executedPlan().toString().splitlines()
        assert sum("FileScan" in line for line in lines) == 2
        below = [lines[i + 1].lstrip(" :+-") for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
        assert len(below) >= 3 and all(re.match(r"(Project|\*?\(?\d*\)? ?(Hash|Sort|ObjectHash)Aggregate|Filter)", b) for b in below)
        assert "_rows0" in auto._jdf.queryExecution().analyzed().toString() and "AS _part#" not in auto._jdf.queryExecution().analyzed().toString()
        plain = build_gold(source, _LINES, strategy="plain")
        short = [[tuple(float(f"{v:.10g}") if isinstance(v, float) else v for v in r) for r in df.collect()] for df in (auto, plain)]
        assert sorted(short[0], key=str) == sorted(short[1], key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_eager_makes_no_product_of_rows(spark):
    """Two dimensions with 3,000 rows each of one key: nine million joined rows, counted from three."""
    fact = spark.createDataFrame([(1, "a"), (2, "b")], "k int, g string")
    dims = {n: spark.range(3000).select(F.lit(1).alias("k"), F.col("id").alias(n)) for n in ("p", "q")}
    plan = {
        "source_tables": ["fact", "p", "q"],
        "joins": [{"fact": "fact", "dim": d, "on": "k", "type": "left"} for d in ("p", "q")],
        "group_by": ["g"],
        "aggregations": [_agg("COUNT", "*", "n"), _agg("SUM", "p", "sp"), _agg("MAX", "q", "hi"), _agg("COUNT", "q", "nq")],
    }
    out = build_gold({"fact": fact, **dims}, plan, strategy="eager")
    assert sorted(map(tuple, out.collect())) == [("a", 9_000_000, 3000 * sum(range(3000)), 2999, 9_000_000), ("b", 1, None, None, 0)]


def test_distinct_values_of_a_crowded_group_are_cut(spark):
    """Half of all rows share a join key, and so a group: its set travels in parts, none of them large, and the count is exact."""
    n = 20_000
    fact = spark.range(0, n, 1, 4).selectExpr("CASE WHEN id % 2 = 0 THEN 1 WHEN id % 10 = 1 THEN NULL ELSE id END AS k", "id % 7000 AS v", "id % 3 AS w")
    dim = spark.range(0, n, 1, 2).selectExpr("id AS k", "id % 2 AS g")
    plan = {
        "source_tables": ["fact", "dim"],
        "joins": [{"fact": "fact", "dim": "dim", "on": "k", "type": "left"}],
        "group_by": ["g"],
        "aggregations": [_agg("COUNT DISTINCT", "v", "dv"), _agg("COUNT DISTINCT", "w", "dw"), _agg("SUM", "v", "sv"), _agg("COUNT", "*", "n")],
    }
    source = {"fact": fact, "dim": dim}
    want = sorted(map(tuple, build_gold(source, plan, strategy="plain").collect()), key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for strategy in ("two_step", "eager"):
            assert sorted(map(tuple, build_gold(source, plan, strategy=strategy).collect()), key=str) == want
        ((_, parts),) = J.crowded_keys(fact, "k")
        assert parts >= 50
        slots = gold._slotted(fact, ["k"], [F.col("v"), F.col("w")]).groupBy("k", "_slot").agg(F.size(F.collect_set("v")).alias("n"))
        assert slots.agg(F.max("n")).first()[0] < n // 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_eager_refuses_what_it_cannot_multiply(spark, crowded):
    plan = {"source_tables": ["facts", "dims"], "joins": [{"dim": "dims", "on": "k", "type": "left"}], "group_by": ["g"]}
    with pytest.raises(PlanError, match="multiplied"):
        build_gold(crowded, {**plan, "aggregations": [_agg("SUM", "cast(x as decimal(20, 8))", "s")]}, strategy="eager")


@pytest.mark.parametrize("share, min_rows", [(0.001, 1), (0.02, 30), (0.3, 1), (1.0, 10**9)])
def test_spread_join_is_a_left_join(spark, crowded, share, min_rows):
    facts, dims = crowded["facts"], crowded["dims"]
    for left, right in ((facts, dims), (dims, facts)):
        got = J.spread_left_join(left, right, "k", share, min_rows)
        want = left.join(right, "k", "left")
        assert got.columns == want.columns
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_crowded_on_both_sides(spark):
    left = spark.range(0, 400, 1, 2).select(F.expr("CASE WHEN id < 200 THEN 1 ELSE id END").alias("k"), "id")
    right = spark.range(0, 300, 1, 2).select(F.expr("CASE WHEN id < 250 THEN 1 ELSE id END").alias("k"), F.lit("r").alias("r"))
    for a, b in ((left, right), (right.withColumnRenamed("r", "x"), left)):
        got, want = J.spread_left_join(a, b, "k", 0.01, 5), a.join(b, "k", "left")
        assert got.count() == want.count()
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_crowded_key_is_cut_by_its_size(spark, crowded, monkeypatch):
    """A third of the rows in one key: its parts hold no more than the share, or than the bytes of a part."""
    facts = crowded["facts"]
    total, of_key = facts.where("k is not null").count(), facts.where("k = 7").count()
    (found,) = J.crowded_keys(facts, "k", 0.05, 1)
    assert found == (7, math.ceil(of_key / (total * 0.05)))
    place = F.pmod(F.col("_deal"), F.lit(found[1]))
    sizes = [r["count"] for r in J.dealt(facts).where("k = 7").groupBy(place).count().collect()]
    assert len(sizes) == found[1] and max(sizes) <= total * 0.05 * 1.1
    monkeypatch.setattr(J, "PART_BYTES", J.estimated_bytes(facts) // 100)
    assert J.crowded_keys(facts, "k", 0.05, 1)[0][1] == pytest.approx(of_key / (total / 100), abs=1.01)
    assert J.crowded_keys(facts, "k", 0.05, 10**6) == []
    assert J.crowded_keys(facts.where("k is null"), "k") == []


@pytest.mark.parametrize("kind", ["long", "string", "date", "decimal(12,2)", "timestamp_ntz"])
def test_heavy_keys_are_those_of_an_exact_count(spark, kind):
    """A million rows, most of different keys: every key over the share is found with a count that is little too high."""
    shifted = "timestamp_seconds(k)" if kind == "timestamp_ntz" else "date_from_unix_date(int(k))" if kind == "date" else "k"
    keys = spark.range(0, 300_000, 1, 4).selectExpr("CASE WHEN id % 10 < 3 THEN 1 WHEN id % 100 = 55 THEN 2 WHEN id % 1000 = 777 THEN 3 ELSE id + 10 END AS k")
    keys = keys.selectExpr(f"cast({shifted} as {kind}) AS k")
    exact = {r.k: r["count"] for r in keys.groupBy("k").count().where("count > 1").collect()}
    assert len(exact) == 3
    items, rows = J.heavy_keys(keys, "k", 0.005)
    assert rows == 300_000
    found = {i["item"]: i["count"] for i in items}
    assert {k for k, n in exact.items() if n >= rows * 0.005} <= set(found) <= set(exact)
    assert all(exact[k] <= n <= exact[k] + rows * 0.0025 for k, n in found.items())


def test_search_for_crowded_keys_moves_sketches_only(spark, tmp_path):
    """No exchange by the key, whatever the number of keys; without a crowded key the join is a plain one."""
    spark.range(0, 50_000, 1, 4).selectExpr("id AS k", "id AS w").write.parquet(str(tmp_path / "dim"))
    dim = spark.read.parquet(str(tmp_path / "dim"))
    written = []
    tracker = spark.sparkContext._jsc.sc().statusStore()
    before = tracker.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).size()
    assert J.crowded_keys(dim, "k", 0.01, 1) == []
    stages = tracker.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    written = [stages.apply(i).shuffleWriteRecords() for i in range(stages.size() - before)]
    assert sum(written) <= 2 * J.SKETCHES
    joined = J.spread_left_join(dim, dim.withColumnRenamed("w", "v"), "k", 0.01, 1)
    text = joined._jdf.queryExecution().analyzed().toString()
    assert "_parts" not in text and text.count("Join") == 1


def test_a_key_with_a_third_of_the_dimension_is_split(spark):
    dim = spark.range(0, 30_000, 1, 4).selectExpr("CASE WHEN id % 10 < 3 THEN 7 ELSE id END AS k", "id AS w")
    fact = spark.range(0, 40, 1, 2).selectExpr("id AS k", "id AS f")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        joined = J.spread_left_join(fact, dim, "k", 0.01, 20)
        sizes = [len(p) for p in joined.select("w").rdd.glom().collect()]
        assert joined.exceptAll(fact.join(dim, "k", "left")).count() == 0 and sum(sizes) == fact.join(dim, "k", "left").count()
        assert max(sizes) < 0.25 * sum(sizes)
    finally:
        for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(c)
        spark.conf.set("spark.sql.shuffle.partitions", "3")


def test_full_join(spark, crowded):
    facts, dims = crowded["facts"], crowded["dims"]
    for a, b in ((facts, dims), (dims, facts)):
        got, want = J.full_join(a, b, "k"), a.join(b, "k", "full")
        assert got.columns == want.columns
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_full_join_broadcasts_a_small_dimension(spark, crowded):
    text = J.full_join(crowded["facts"], crowded["dims"], "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "FullOuter" not in text


# -- collisions and order -----------------------------------------------------------


def test_colliding_columns_come_from_the_fact(spark):
    fact = spark.createDataFrame([(1, 5, "fact")], "cust int, id int, status string")
    dim = spark.createDataFrame([(1, "dim", "x")], "id int, status string, cust string")
    plan = {
        "source_tables": ["fact", "dim"],
        "joins": [{"fact": "fact", "dim": "dim", "on": "fact.cust = dim.id", "type": "left"}],
        "group_by": ["cust", "id", "status"],
        "aggregations": [_agg("COUNT", "*", "n")],
    }
    assert [tuple(r) for r in build_gold({"fact": fact, "dim": dim}, plan).collect()] == [(1, 5, "fact", 1)]
    with pytest.raises(PlanError, match="dim.status"):
        build_gold({"fact": fact, "dim": dim}, {**plan, "filters": ["dim.status = 'dim'"]})


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_odd_column_names(spark, strategy):
    fact = spark.createDataFrame([(1, "x", 2), (1, "x", 3), (2, "y", 4)], "k int, `my group` string, `unit price` int")
    dim = spark.createDataFrame([(1, "p")], "k int, `a.b` string")
    plan = {
        "source_tables": ["fact", "dim"],
        "joins": [{"dim": "dim", "on": "k"}],
        "group_by": ["my group", "a.b"],
        "aggregations": [_agg("SUM", "unit price", "total"), _agg("MAX", "`unit price` + 1", "top")],
    }
    rows = build_gold({"fact": fact, "dim": dim}, plan, strategy=strategy).collect()
    assert sorted(tuple(r) for r in rows) == [("x", "p", 5, 4), ("y", None, 4, 5)]


def test_count_of_everything(spark):
    plan = {"source_tables": ["t"], "group_by": [], "aggregations": [_agg("COUNT", "*", "n")]}
    assert build_gold({"t": spark.range(5)}, plan).collect()[0].n == 5


def test_same_dimension_twice(spark):
    fact = spark.createDataFrame([(1, 2, 10)], "a int, b int, v int")
    dim = spark.createDataFrame([(1, "one"), (2, "two")], "k int, name string")
    plan = {
        "source_tables": ["fact", "dim"],
        "joins": [{"fact": "fact", "dim": "dim", "on": "a = k"}, {"dim": "dim", "on": "b = k"}],
        "group_by": ["name"],
        "aggregations": [_agg("SUM", "v", "v")],
    }
    assert [tuple(r) for r in build_gold({"fact": fact, "dim": dim}, plan).collect()] == [("one", 10)]


def test_literals_are_left_alone(spark):
    df = spark.createDataFrame([("t.current_date()", 1)], "s string, v int")
    plan = {
        "source_tables": ["t"],
        "filters": ["t.s = 't.current_date()'"],
        "group_by": ["s"],
        "aggregations": [_agg("SUM", "v", "v")],
    }
    assert build_gold({"t": df}, plan, as_of="2024-01-01").collect()[0].v == 1


# -- refusals -----------------------------------------------------------------------


@pytest.fixture
def simple(spark):
    return {
        "a": spark.createDataFrame([(1, "x", 2)], "k int, s string, v int"),
        "b": spark.createDataFrame([(1, "y")], "k int, z string"),
    }


PLAN = {"source_tables": ["a"], "group_by": ["s"], "aggregations": [_agg("SUM", "v", "v_sum")], "destination": "d"}


@pytest.mark.parametrize(
    "change, message",
    [
        ({"joins": [{"dim": "b", "on": "k", "type": "inner"}]}, "inner"),
        ({"joins": [{"dim": "nothing", "on": "k"}]}, "unknown table"),
        ({"joins": [{"dim": "b", "on": "q"}]}, "join key 'q'"),
        ({"joins": [{"dim": "b", "on": "a.k = b.q"}]}, "join key 'q'"),
        ({"joins": [{"dim": "b", "on": "a.k = b.z"}]}, "join key 'k' is int"),
        ({"group_by": ["nothing"]}, "unknown columns"),
        ({"aggregations": [_agg("SUM", "nothing", "n")]}, "unknown columns"),
        ({"aggregations": [_agg("MEDIAN", "v", "n")]}, "unknown function"),
        ({"aggregations": [_agg("SUM", "*", "n")]}, "only COUNT"),
        ({"aggregations": [_agg("RATIO", "v", "n")]}, "needs den"),
        ({"aggregations": [_agg("SUM", "v", "s")]}, "used twice"),
        ({"aggregations": [_agg("SUM", "nofunc(v)", "n")]}, "aggregates"),
        ({"filters": ["nothing > 1"]}, "filter"),
        ({"pre_columns": [{"column": "p", "expression": "nothing + 1"}]}, "pre column"),
        ({"derived_columns": [{"column": "p", "expression": "v"}]}, "derived column"),
        ({"destination": "../d"}, "destination"),
    ],
)
def test_bad_plans_are_refused_before_any_job(simple, change, message):
    with pytest.raises(PlanError, match=message):
        build_gold(simple, {**PLAN, **change})


def test_incomplete_plan_and_bad_strategy(simple):
    with pytest.raises(PlanError, match="lacks"):
        build_gold(simple, {"source_tables": ["a"]})
    with pytest.raises(ValueError):
        build_gold(simple, PLAN, strategy="fast")


def test_lenient_mode_skips(simple):
    plan = {**PLAN, "aggregations": [_agg("SUM", "nothing", "n"), _agg("COUNT DISTINCT", "v", "u")]}
    assert build_gold(simple, plan, strict=False).columns == ["s", "u"]
    assert build_gold(simple, {**plan, "aggregations": []}, strict=False).columns == ["s", "record_count"]
    with pytest.raises(PlanError, match="none of the group-by"):
        build_gold(simple, {**plan, "group_by": ["nothing"]}, strict=False)


def test_join_type_spellings():
    for text, kind in [("LEFT", "left"), ("full outer", "full"), ("left_outer", "left"), (None, "left"), ("FULL OUTER JOIN", "full"), ("inner join", "inner")]:
        plan = GoldPlan.from_dict({**PLAN, "joins": [{"dim": "b", "on": "k", "type": text}]})
        assert plan.joins[0].type == kind


def test_derived_null_stays_null_unless_boolean(simple):
    plan = {
        **PLAN,
        "derived_columns": [
            {"column": "plain", "expression": "CAST(NULL AS INT) > v_sum"},
            {"column": "flag", "expression": "CAST(NULL AS INT) > v_sum", "type": "boolean"},
        ],
    }
    row = build_gold(simple, plan).collect()[0]
    assert (row.plain, row.flag) == (None, False)


# -- joined hint --------------------------------------------------------------------


def _hint(**change):
    hint = {"join_confirmed": True, "tables": ["a", "b"], "suggested_join_key": "k", "destination": "d", **change}
    tables = [
        {"group_by": ["s", "gone"], "aggregations": [_agg("COUNT", "v", "n")]},
        {"group_by": ["z", "s"], "aggregations": [_agg("SUM", "v", "n"), _agg("MAX", "v", "m")]},
    ]
    return {"cross_table_hint": hint, "tables": tables}


def test_joined_hint(simple):
    out = build_gold(simple, _hint(), strict=False)
    assert [tuple(r) for r in out.collect()] == [("x", "y", 1, 2)]
    assert out.columns == ["s", "z", "n", "m"]
    plan = _hint()
    plan["tables"][0]["joins"] = [{"fact": "a", "dim": "b", "on": "v"}]
    with pytest.raises(PlanError):
        build_gold(simple, plan, strict=False)
    for change in ({"join_confirmed": False}, {"tables": ["a"]}, {"destination": None}, {"suggested_join_key": None}):
        with pytest.raises(PlanError):
            build_gold(simple, _hint(**change), strict=False)


def test_planning_documents(simple):
    single = {"source_silver": "a", "group_by": ["s"], "aggregations": [_agg("SUM", "v", "v_sum")], "destination": "a_summary"}
    document = {"tables": [single, {**single, "source_silver": "a + b"}], "cross_table_hint": None}
    plans = plans_of(document)
    assert [p.source_tables for p in plans] == [["a"], ["a", "b"]]
    assert build_gold(simple, plans[0]).collect()[0].v_sum == 2
    assert [p.destination for p in plans_of(_hint())] == ["d"]
    assert plans_of(PLAN)[0].destination == "d"


def test_silver_feeds_gold(spark):
    items = spark.createDataFrame([(1, 5, 2.0), (2, 5, 3.0)], "OrderItemID int, OrderID int, UnitPrice double")
    plan = {"source_tables": ["i"], "group_by": ["order_id"], "aggregations": [_agg("SUM", "unit_price", "p")]}
    assert build_gold({"i": to_silver(items)}, plan).collect()[0].p == 5.0
