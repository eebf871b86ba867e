"""Silver queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.operators.bronze import data_columns, load_bronze
from stratalake.operators.silver import build_silver, snake_case_columns, to_silver
from stratalake.queries.base import Registry, new_lake, table

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query("""
    SELECT c_custkey AS customer_id, c_name AS customer_name, c_nationkey AS http_nation_code,
           c_acctbal AS acct_bal2_usd, c_mktsegment AS "mkt segment"
    FROM customer
""")
def silver_snake_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["CustomerID", "CustomerName", "HTTPNationCode", "AcctBal2Usd", "mkt segment"]
    return snake_case_columns(table(spark, sf_dir, "customer").toDF(*names))


@R.query("""
    SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_brand, p_type, p_size,
           CAST(p_retailprice AS FLOAT) AS p_retailprice,
           CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS is_large,
           CAST(p_size AS INTEGER) AS size_short, CAST(p_size AS FLOAT) AS size_decimal
    FROM part
""")
def silver_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumns(
        {
            "isLarge": F.col("p_size") > 25,
            "SizeShort": F.col("p_size").cast("short"),
            "SizeDecimal": F.col("p_size").cast("decimal(10,2)"),
        }
    )
    return to_silver(part)


@R.query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, c_acctbal > 0 AS in_credit FROM customer")
def silver_cast_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").withColumn("InCredit", F.col("c_acctbal") > 0)
    return to_silver(customer, widen=True, keep_boolean=True)


@R.query("""
    SELECT CAST(event_id AS INTEGER) AS event_id, ts, CAST(user_id AS INTEGER) AS user_id, event_type,
           CAST(value AS FLOAT) AS value, props
    FROM events WHERE event_type <> 'error'
""")
def silver_pk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors lose their id; rows without a key do not reach Silver."""
    key = F.when(F.col("event_type") != "error", F.col("event_id"))
    return to_silver(table(spark, sf_dir, "events").withColumn("event_id", key))


@R.query("""
    SELECT CAST(conv_id AS INTEGER) AS conv_id, true AS is_a_row, count(*) AS n
    FROM (SELECT DISTINCT conv_id FROM conversations) GROUP BY conv_id
""")
def silver_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation; whichever it is, all its columns come from one turn."""
    turns = to_silver(table(spark, sf_dir, "conversations"))
    one = to_silver(table(spark, sf_dir, "conversations"), dedupe=True)
    found = one.join(turns.distinct().withColumn("is_a_row", F.lit(True)), ["conv_id", "turn", "role", "text"], "left")
    return found.groupBy("conv_id").agg(F.coalesce(F.bool_and("is_a_row"), F.lit(False)).alias("is_a_row"), F.count(F.lit(1)).alias("n"))


@R.query("""
    SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey,
           o_orderstatus, CAST(o_totalprice AS FLOAT) AS o_totalprice, o_orderdate, o_orderpriority
    FROM orders
""")
def silver_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_silver(table(spark, sf_dir, "orders"))


@R.query("""
    SELECT CAST(vec_id AS INTEGER) AS vec_id, label, '[' || array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(x * 100) AS INTEGER) AS VARCHAR)), ', ') || ']' AS embedding,
           '{' || label || ', ' || vec_id || '}' AS pair
    FROM embeddings
""")
def silver_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays and structs become text; whole numbers here, as engines print floats differently."""
    whole = F.transform("embedding", lambda x: F.floor(x * 100).cast("int"))
    source = table(spark, sf_dir, "embeddings").withColumns({"embedding": whole, "pair": F.struct("label", "vec_id")})
    return to_silver(source).select("vec_id", "label", "embedding", "pair")


@R.query("""
    SELECT CAST(event_id AS INTEGER) AS event_id, ts, CAST(user_id AS INTEGER) AS user_id, event_type,
           CAST(value AS FLOAT) AS value, props, 'incremental' AS load_mode
    FROM events
""")
def silver_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two Bronze loads, each followed by a Silver run that takes only the new one."""
    lake = new_lake(spark, "silver")
    events = table(spark, sf_dir, "events")
    early = events.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    for source in (early, events):
        load_bronze(lake, "events_bronze", source, "events", "incremental", watermark_col="event_id")
        build_silver(lake, "events_bronze", incremental=True)
    silver = lake.read("silver", "events_silver")
    return silver.drop("_ingestion_timestamp", "_source_name").withColumnRenamed("_load_mode", "load_mode")


@R.query("""
    SELECT o_orderkey, o_custkey,
           CASE WHEN o_orderkey % 5 = 0 THEN 'X' WHEN o_orderkey % 3 = 0 THEN 'Y' ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 3 = 0 THEN o_totalprice - 1 ELSE o_totalprice END AS o_totalprice,
           o_orderdate, o_orderpriority,
           CAST(CASE WHEN o_orderkey % 5 = 0 THEN 3 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS revision
    FROM orders
""")
def silver_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, a third change, and an older change that comes after it: the latest revision of each order stays."""
    lake = new_lake(spark, "upsert")
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    changes = [
        orders.withColumn("revision", F.lit(1)),
        orders.where(key % 5 == 0).withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1, "revision": F.lit(3)}),
        orders.where(key % 3 == 0).withColumns({"o_orderstatus": F.lit("Y"), "o_totalprice": F.col("o_totalprice") - 1, "revision": F.lit(2)}),
    ]
    for batch in changes:
        load_bronze(lake, "orders_bronze", batch, "orders", "incremental")
        build_silver(lake, "orders_bronze", pk="o_orderkey", widen=True, incremental=True, latest_by="revision")
    return data_columns(lake.read("silver", "orders_silver"))
