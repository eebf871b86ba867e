import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from stratalake.functions import names as N
from stratalake.functions import schema as S


@pytest.mark.parametrize(
    "name, snake",
    [
        ("CustomerID", "customer_id"),
        ("HTTPResponseCode", "http_response_code"),
        ("OrderItemID", "order_item_id"),
        ("already_snake", "already_snake"),
        ("UnitPrice2Usd", "unit_price2_usd"),
        ("two words", "two words"),
        ("Two Words", "two _words"),
        ("Foo_Bar", "foo__bar"),
        ("ID", "id"),
        ("aB", "a_b"),
        ("_ingestion_timestamp", "_ingestion_timestamp"),
    ],
)
def test_snake_case(name, snake):
    assert N.to_snake_case(name) == snake


@given(st.text(alphabet="abcXYZ019_ ", max_size=20))
def test_snake_case_is_lower_and_stable(name):
    once = N.to_snake_case(name)
    assert once == once.lower() == N.to_snake_case(once)
    assert once.replace("_", "") == name.lower().replace("_", "")


def test_layer_names():
    assert N.bronze_name("public.orders", "jdbc") == "orders_bronze"
    assert N.bronze_name("orders", "jdbc") == "orders_bronze"
    assert N.bronze_name("/data/x/leave_logs.csv") == "leave_logs_bronze"
    assert N.bronze_name("ticket_events.json") == "ticket_events_bronze"
    assert N.silver_name("orders_bronze") == "orders_silver"
    assert N.silver_name("orders") == "orders_silver"
    assert N.summary_name("orders_silver") == N.summary_name("orders_bronze") == "orders_summary"
    assert N.view_name("a-b") == "a_b"
    for bad in ("../x", "a/b", "", "a b"):
        with pytest.raises(ValueError):
            N.check_table_name(bad)


def _schema(*names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def test_key_inference():
    assert S.infer_key(_schema("name", "foreign_x_id", "ref_id", "OrderID", "other_id")) == "order_id"
    assert S.infer_key(_schema("name", "ID")) == "id"
    assert S.infer_key(_schema("FirstName", "x")) == "first_name"
    # alphabetical JSON columns: the first id wins, right or wrong
    assert S.infer_key(_schema("amount", "customer_id", "transaction_id")) == "customer_id"


def test_roles():
    role = S.column_role
    assert role("_load_mode", T.StringType()) == "audit"
    assert role("customer_id", T.LongType()) == "id"
    assert role("response_time_minutes", T.LongType()) == "measure"
    assert role("update_count", T.IntegerType()) == "measure"
    assert role("txn_timestamp", T.StringType()) == "date"
    assert role("seen", T.TimestampNTZType()) == "date"
    assert role("tier", T.StringType()) == "dimension"
    assert role("resolved", T.BooleanType()) == "dimension"


def test_wider_type():
    w = S.wider_type
    assert w(T.IntegerType(), T.LongType()) == T.LongType()
    assert w(T.LongType(), T.ShortType()) == T.LongType()
    assert w(T.FloatType(), T.DoubleType()) == T.DoubleType()
    assert w(T.DecimalType(10, 2), T.DecimalType(8, 4)) == T.DecimalType(12, 4)
    assert w(T.DecimalType(38, 0), T.DecimalType(10, 5)) is None
    assert w(T.LongType(), T.DoubleType()) is None
    assert w(T.LongType(), T.StringType()) is None
