import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake import PlanError, auto_summary, gold_from_columns, plan_from_columns, shared_keys, summary_plan
from stratalake.operators.catalog import columns_of
from stratalake.plans.resolve import resolve_column, shared_columns

COLUMNS = {
    "customer_id": T.LongType(),
    "tier": T.StringType(),
    "amount": T.DoubleType(),
    "unit_price": T.DoubleType(),
    "list_price": T.DoubleType(),
    "txn_timestamp": T.StringType(),
    "signup_date": T.DateType(),
    "visit_count": T.LongType(),
}


@pytest.mark.parametrize(
    "name, kind, func, column",
    [
        ("tier", "group", None, "tier"),
        ("TIER", "group", None, "tier"),
        ("visit_count", "group", None, "visit_count"),  # an existing column beats the count rule
        ("record_count", "aggregate", "COUNT", "*"),
        ("order_count", "aggregate", "COUNT", "*"),
        ("total_transactions_count", "aggregate", "COUNT", "*"),
        ("customer_transactions", "aggregate", "COUNT", "*"),
        ("num_records", "aggregate", "COUNT", "*"),
        ("num_tier", "aggregate", "COUNT", "tier"),
        ("cnt_anything", "aggregate", "COUNT", "*"),
        ("total_amount", "aggregate", "SUM", "amount"),
        ("amount_total", "aggregate", "SUM", "amount"),
        ("mean_amount", "aggregate", "AVG", "amount"),
        ("amount_average", "aggregate", "AVG", "amount"),
        ("sum_list", "aggregate", "SUM", "list_price"),
        ("max_amount", "aggregate", "MAX", "amount"),
        ("max_signup_date", "aggregate", "MAX", "signup_date"),
        ("last_txn", "aggregate", "MAX", "txn_timestamp"),
        ("earliest_signup", "aggregate", "MIN", "signup_date"),
        ("is_premium", "flag", None, None),
    ],
)
def test_names(name, kind, func, column):
    got = resolve_column(name, COLUMNS, {"is_premium": "total_amount > 300"})
    assert (got.kind, got.func, got.column) == (kind, func, column)


@pytest.mark.parametrize(
    "name, hint",
    [
        ("sum_price", "unit_price"),  # two candidates: none is guessed
        ("total_tier", "tier"),  # no number
        ("has_orders", "condition"),
        ("nonsense", "customer_id"),
    ],
)
def test_unresolved_names_raise_with_candidates(name, hint):
    with pytest.raises(PlanError, match=hint):
        resolve_column(name, COLUMNS)


def _inputs(spark):
    return {
        "customers": spark.createDataFrame([(1, "g", 9), (2, "s", 9)], "customer_id int, tier string, region_id int"),
        "orders": spark.createDataFrame(
            [(1, 10.0, 9, "a"), (1, 20.0, 9, "b")], "customer_id int, amount double, region_id int, note string"
        ),
    }


def test_shared_keys(spark):
    inputs = _inputs(spark)
    assert shared_keys(inputs) == ["customer_id", "region_id"]
    rows = shared_columns(columns_of(spark, inputs)).collect()
    assert {(r.column_name, r.tables, r.is_id) for r in rows} == {("customer_id", 2, True), ("region_id", 2, True)}


def test_gold_from_columns(spark):
    wanted = ["is_premium", "tier", "total_amount", "record_count"]
    out = gold_from_columns(_inputs(spark), wanted, conditions={"is_premium": "total_amount > 25"})
    assert out.columns == wanted
    assert sorted(tuple(r) for r in out.collect()) == [(False, "s", None, 1), (True, "g", 30.0, 2)]


def test_plan_from_columns(spark):
    inputs = _inputs(spark)
    plan = plan_from_columns(inputs, ["TIER"])
    assert plan.group_by == ["tier"] and plan.column_aliases == [{"from": "tier", "to": "TIER"}]
    assert [a.alias for a in plan.aggregations] == ["record_count"]
    assert plan.joins[0].on == "customer_id" and plan.destination == "customers_orders_gold"
    assert plan_from_columns(inputs, ["tier"], on={"orders": "region_id"}).joins[0].on == "region_id"
    lonely = {**inputs, "x": spark.createDataFrame([(1,)], "z int")}
    with pytest.raises(PlanError, match="share no column"):
        plan_from_columns(lonely, ["tier"])


def _summary_input(spark):
    schema = """sale_id int, shop string, shop_name string, contact_email string, kind string, third string,
        day date, later date, amount double, pieces int, buyer_id int, _load_mode string, _ingestion_timestamp timestamp"""
    return spark.createDataFrame([], schema)


def test_summary_plan(spark):
    plan = summary_plan(_summary_input(spark).schema, "sales_silver")
    assert plan.group_by == ["shop", "kind", "day"] and plan.destination == "sales_summary"
    assert [(a.func, a.col, a.alias) for a in plan.aggregations] == [
        ("COUNT", "*", "record_count"),
        ("SUM", "amount", "total_amount"),
        ("AVG", "amount", "avg_amount"),
        ("SUM", "pieces", "total_pieces"),
        ("AVG", "pieces", "avg_pieces"),
    ]


def test_summary_arguments(spark):
    schema = _summary_input(spark).schema
    plan = summary_plan(schema, "s", group_by=["third"], measures=["pieces", "max(day) as newest", "COUNT DISTINCT(buyer_id)"])
    assert plan.group_by == ["third"]
    assert [(a.func, a.alias) for a in plan.aggregations[1:]] == [
        ("SUM", "total_pieces"), ("AVG", "avg_pieces"), ("MAX", "newest"), ("COUNT_DISTINCT", "count_distinct_buyer_id"),
    ]
    for bad in ({"group_by": ["nothing"]}, {"measures": ["nothing"]}, {"measures": ["SUM(nothing)"]}):
        with pytest.raises(PlanError):
            summary_plan(schema, "s", **bad)


def test_summary_falls_back_to_an_id_or_refuses(spark):
    ids = spark.createDataFrame([(1, 2)], "a_id int, v int")
    assert summary_plan(ids.schema, "s").group_by == ["a_id"]
    with pytest.raises(PlanError, match="group by"):
        summary_plan(spark.createDataFrame([(1, 2)], "a int, v int").schema, "s")


def test_summary_is_ordered(spark):
    df = spark.range(0, 30, 1, 3).select(F.col("id").alias("row_id"), F.when(F.col("id") < 20, "x").otherwise("y").alias("g"))
    rows = auto_summary(df, "s").collect()
    assert [(r.g, r.record_count) for r in rows] == [("x", 20), ("y", 10)]
