"""Sources, Bronze loads, load state, streaming ingest and whole runs."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.functions.names import BAD_RECORD, LOAD_ID
from stratalake.operators.bronze import data_columns, load_bronze, newer_than, with_audit
from stratalake.operators.catalog import load_overview, row_counts
from stratalake.operators.quality import split_bad_records
from stratalake.operators.silver import build_silver
from stratalake.queries.base import Registry, new_lake, table
from stratalake.runs import SourceSpec, run_layers
from stratalake.sources.files import files_exist, format_of, read_source
from stratalake.sources.lake import Lake
from stratalake.sources.storage import path_exists, scratch_dir
from stratalake.streaming.files import ingest_new_files

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query("""
    SELECT event_id, ts, user_id, event_type, value, props,
           true AS has_timestamp, true AS from_events, 'full' AS load_mode
    FROM events
""")
def bronze_parquet_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    bronze = with_audit(read_source(spark, path), path, "full")
    return bronze.select(
        *data_columns(bronze).columns,
        F.col("_ingestion_timestamp").isNotNull().alias("has_timestamp"),
        F.col("_source_name").endswith("events.parquet").alias("from_events"),
        F.col("_load_mode").alias("load_mode"),
    )


@R.query("""
    SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
    FROM customer
""")
def bronze_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "csv") + "/customer.csv"
    table(spark, sf_dir, "customer").write.csv(path, header=True)
    lake = new_lake(spark, "bronze-csv")
    load_bronze(lake, "customer_bronze", read_source(spark, path), path)
    return data_columns(lake.read("bronze", "customer_bronze"))


@R.query("""
    SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice
    FROM part
""")
def bronze_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "tsv") + "/part.tsv"
    table(spark, sf_dir, "part").write.csv(path, header=True, sep="\t")
    return read_source(spark, path)


@R.query("""
    SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_orderstatus, o_totalprice,
           CAST(o_orderdate AS DATE) AS o_orderdate
    FROM orders
""")
def bronze_csv_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "dat") + "/orders.dat"
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date")
    )
    orders.write.csv(path, header=True)
    return read_source(spark, path)


@R.query("SELECT s_acctbal, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_suppkey FROM supplier")
def bronze_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "json") + "/supplier.json"
    table(spark, sf_dir, "supplier").write.json(path)
    return read_source(spark, path)


@R.query("SELECT s_acctbal, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_suppkey FROM supplier")
def bronze_json_gz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as compressed JSON lines, whose format is told by the suffix below that of the codec."""
    path = scratch_dir(spark, "json-gz") + "/supplier.json"
    table(spark, sf_dir, "supplier").write.json(path, compression="gzip")
    lake = new_lake(spark, "bronze-gz")
    ingest_new_files(lake, path, "supplier_bronze", fmt=format_of("supplier.json.gz"))
    return data_columns(lake.read("bronze", "supplier_bronze"))


@R.query("""
    SELECT 'good' AS kind, c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment
    UNION ALL
    SELECT 'bad', NULL, count(*) FROM customer WHERE c_acctbal < 0
""")
def bronze_json_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON lines; each one in debt is preceded by a comment line."""
    path = scratch_dir(spark, "corrupt") + "/customer.json"
    row = F.to_json(F.struct("*"))
    note = F.concat(F.lit("/* in debt: "), "c_name", F.lit(" */"))
    lines = F.when(F.col("c_acctbal") < 0, F.array(note, row)).otherwise(F.array(row))
    table(spark, sf_dir, "customer").select(F.explode(lines).alias("value")).write.text(path)

    lake = new_lake(spark, "bronze-corrupt")
    load_bronze(lake, "customer_bronze", read_source(spark, path), path)
    good, bad = split_bad_records(lake.read("bronze", "customer_bronze"))
    segment = F.lit(None).cast("string").alias("c_mktsegment")
    return (
        good.groupBy("c_mktsegment")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("good").alias("kind"), "c_mktsegment", "n")
        .unionByName(bad.agg(F.count(BAD_RECORD).alias("n")).select(F.lit("bad").alias("kind"), segment, "n"))
    )


@R.query("""
    SELECT 'orders_bronze' AS table_name, 'success' AS status, count(*) AS n FROM orders
    UNION ALL SELECT 'nowhere_bronze', 'failed', NULL
""")
def bronze_missing_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source is missing: it is reported, its neighbour is loaded all the same."""
    sources = [SourceSpec(f"{sf_dir}/nowhere.csv"), SourceSpec(f"{sf_dir}/orders.parquet")]
    report = run_layers(new_lake(spark, "missing"), sources)
    return report.where(F.col("layer") == "bronze").select("table_name", "status", F.col("rows").alias("n"))


@R.query("SELECT * FROM orders")
def bronze_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two full loads: the second replaces the first."""
    lake = new_lake(spark, "overwrite")
    orders = table(spark, sf_dir, "orders")
    load_bronze(lake, "orders_bronze", orders.where("o_orderstatus = 'F'"), "orders")
    load_bronze(lake, "orders_bronze", orders, "orders")
    return data_columns(lake.read("bronze", "orders_bronze"))


_SPLIT = "1998-01-01"


@R.query(f"""
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
           NULL AS channel
    FROM orders WHERE o_orderdate < '{_SPLIT}'
    UNION ALL
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, NULL, 'web'
    FROM orders WHERE o_orderdate >= '{_SPLIT}'
""")
def bronze_append_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second batch lacks a column and brings a new one."""
    lake = new_lake(spark, "evolve")
    orders = table(spark, sf_dir, "orders")
    late = F.col("o_orderdate") >= F.lit(_SPLIT).cast("timestamp_ntz")
    load_bronze(lake, "orders_bronze", orders.where(~late), "orders")
    second = orders.where(late).drop("o_orderpriority").withColumn("channel", F.lit("web"))
    load_bronze(lake, "orders_bronze", second, "orders", "incremental")
    return data_columns(lake.read("bronze", "orders_bronze"))


@R.query(f"""
    SELECT o_orderkey, CASE WHEN o_orderdate < '{_SPLIT}' THEN floor(o_totalprice) ELSE o_totalprice END AS price,
           CASE WHEN o_orderdate < '{_SPLIT}' THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) ELSE o_orderdate END AS seen_at,
           CAST(CASE WHEN o_orderdate < '{_SPLIT}' THEN o_custkey ELSE o_custkey + 0.25 END AS DOUBLE) AS owner, 'decimal(21,2)' AS owner_type
    FROM orders
""")
def bronze_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types grow between two loads: int to double, date to timestamp, bigint to decimal."""
    lake = new_lake(spark, "widen")
    orders = table(spark, sf_dir, "orders")
    late = F.col("o_orderdate") >= F.lit(_SPLIT).cast("timestamp_ntz")
    first = orders.where(~late).selectExpr("o_orderkey", "cast(floor(o_totalprice) as int) price", "cast(o_orderdate as date) seen_at", "o_custkey owner")
    second = orders.where(late).selectExpr("o_orderkey", "o_totalprice price", "o_orderdate seen_at", "cast(o_custkey + 0.25 as decimal(12, 2)) owner")
    for part in (first, second):
        load_bronze(lake, "orders_bronze", part, "orders", "incremental")
    grown = data_columns(lake.read("bronze", "orders_bronze"))
    return grown.withColumns({"owner": F.col("owner").cast("double"), "owner_type": F.typeof("owner")})


@R.query("SELECT event_id, ts, user_id, event_type, value, props, CAST(1 + event_id % 12 AS BIGINT) AS load_id FROM events")
def bronze_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in twelve small loads, merged on the way; every row keeps the number of its load."""
    lake = new_lake(spark, "compaction")
    events = table(spark, sf_dir, "events")
    for i in range(12):
        load_bronze(lake, "events_bronze", events.where(F.col("event_id") % 12 == i), "events", "incremental")
    if len(lake.latest("bronze", "events_bronze").segments) >= 12:
        raise RuntimeError("the loads were not merged")
    return data_columns(lake.read("bronze", "events_bronze", with_load_id=True)).withColumnRenamed(LOAD_ID, "load_id")


@R.query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def bronze_two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs load halves of the orders into one table at the same time; both stay."""
    root = scratch_dir(spark, "writers")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")

    def run(half: int) -> None:
        load_bronze(Lake(spark, root), "orders_bronze", orders.where(F.col("o_orderkey") % 2 == half), f"half {half}", "incremental")

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(inheritable_thread_target(spark)(run), (0, 1)))
    return data_columns(Lake(spark, root).read("bronze", "orders_bronze"))


@R.query("""
    SELECT load_id, mode, n, CAST(high AS VARCHAR) AS high FROM (
        SELECT CAST(1 AS BIGINT) AS load_id, 'incremental' AS mode, count(*) AS n, max(event_id) AS high
        FROM events WHERE ts < '2024-01-16'
        UNION ALL
        SELECT 2, 'incremental', count(*) FILTER (ts >= '2024-01-16'), max(event_id) FROM events
        UNION ALL
        SELECT 3, 'incremental', 0, max(event_id) FROM events)
""")
def bronze_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source grows between loads 1 and 2 and stands still before load 3; every load reads
    only rows above the stored watermark, and an empty one keeps it."""
    lake = new_lake(spark, "incremental")
    events = table(spark, sf_dir, "events")
    first_half = events.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    for source in (first_half, events, events):
        load_bronze(lake, "events_bronze", source, "events", "incremental", watermark_col="event_id")
    log = lake.load_log("bronze")
    return log.select("load_id", "mode", F.col("rows").alias("n"), F.col("last_watermark_value").alias("high"))


@R.query("SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'error')")
def bronze_newer_than(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows the next incremental load would read, after one that stored the errors only."""
    lake = new_lake(spark, "newer")
    events = table(spark, sf_dir, "events")
    load = load_bronze(
        lake, "events_bronze", events.where("event_type = 'error'"), "events", watermark_col="ts"
    )
    return newer_than(events, "ts", load)


@R.query("""
    SELECT 'customer_bronze' AS table_name, count(*) AS n, 8 AS n_columns, 'full' AS mode,
           NULL AS watermark_col, NULL AS last_value FROM customer
    UNION ALL
    SELECT 'orders_bronze', count(*), 9, 'incremental', 'o_orderkey', CAST(max(o_orderkey) AS VARCHAR)
    FROM orders
""")
def load_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = new_lake(spark, "state")
    load_bronze(lake, "customer_bronze", table(spark, sf_dir, "customer"), "customer")
    orders = table(spark, sf_dir, "orders")
    for _ in range(2):
        load_bronze(lake, "orders_bronze", orders, "orders", "incremental", watermark_col="o_orderkey")
    return load_overview(lake).select(
        "table_name",
        F.col("rows").alias("n"),
        F.col("columns").alias("n_columns"),
        "mode",
        "watermark_col",
        F.col("last_watermark_value").alias("last_value"),
    )


@R.query(
    " UNION ALL ".join(
        f"SELECT '{t}.parquet' AS source, true AS found, count(*) AS n FROM {t}"
        for t in ("customer", "orders", "lineitem")
    )
    + " UNION ALL SELECT 'nowhere.parquet', false, NULL"
)
def source_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of four wanted sources are there, and how many rows those have."""
    names = ("customer", "orders", "lineitem", "nowhere")
    found = files_exist(spark, [f"{sf_dir}/{n}.parquet" for n in names])
    present = [n for n in names if path_exists(spark, f"{sf_dir}/{n}.parquet")]
    counts = row_counts({f"{n}.parquet": table(spark, sf_dir, n) for n in present})
    return found.select(
        F.element_at(F.split("source", "/"), -1).alias("source"), F.col("exists").alias("found")
    ).join(counts.select(F.col("table_name").alias("source"), F.col("rows").alias("n")), "source", "left")


@R.query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as several files, ingested twice: every file is taken once."""
    folder = scratch_dir(spark, "landing") + "/events"
    lake = new_lake(spark, "stream")
    events = table(spark, sf_dir, "events")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    events.where(early).write.mode("append").parquet(folder)
    ingest_new_files(lake, folder, "events_bronze", events.schema)
    events.where(~early).write.mode("append").parquet(folder)
    for _ in range(2):
        ingest_new_files(lake, folder, "events_bronze", events.schema, max_files_per_trigger=2)
    return data_columns(lake.read("bronze", "events_bronze"))


@R.query("""
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus,
        CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS o_orderpriority
    FROM orders
""")
def stream_schema_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in two ingests; the files of the second lack a column and bring another one."""
    folder = scratch_dir(spark, "landing") + "/orders"
    lake = new_lake(spark, "growth")
    orders = table(spark, sf_dir, "orders")
    odd = F.col("o_orderkey") % 2 == 1
    orders.where(~odd).select("o_orderkey", "o_custkey", "o_orderstatus").write.mode("append").parquet(folder)
    ingest_new_files(lake, folder, "orders_bronze")
    orders.where(odd).select("o_orderkey", "o_orderpriority", "o_custkey").write.mode("append").parquet(folder)
    for _ in range(2):
        ingest_new_files(lake, folder, "orders_bronze")
    return data_columns(lake.read("bronze", "orders_bronze"))


@R.query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def stream_csv_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as CSV files whose columns come in two orders, ingested by their headers."""
    folder = scratch_dir(spark, "landing") + "/orders"
    lake = new_lake(spark, "reordered")
    orders = table(spark, sf_dir, "orders")
    odd = F.col("o_orderkey") % 2 == 1
    orders.where(~odd).select("o_orderkey", "o_custkey", "o_orderpriority").write.mode("append").csv(folder, header=True)
    orders.where(odd).select("o_custkey", "o_orderpriority", "o_orderkey").write.mode("append").csv(folder, header=True)
    given = orders.select("o_orderkey", "o_custkey", "o_orderpriority").schema
    for _ in range(2):
        ingest_new_files(lake, folder, "orders_bronze", given, "csv")
    return data_columns(lake.read("bronze", "orders_bronze"))


@R.query("""
    SELECT event_id, user_id, CASE WHEN event_id % 2 = 1 THEN event_id + 1 END AS seq FROM events
""")
def bronze_watermark_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events watched by event_id, then by a column that only the second batch has."""
    lake = new_lake(spark, "watched")
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    odd = F.col("event_id") % 2 == 1
    load_bronze(lake, "events_bronze", events.where(~odd), "events", "incremental", watermark_col="event_id")
    later = events.where(odd).withColumn("seq", F.col("event_id") + 1)
    for _ in range(2):
        load_bronze(lake, "events_bronze", later, "events", "incremental", watermark_col="seq")
    return data_columns(lake.read("bronze", "events_bronze"))


@R.query("SELECT o_orderkey, o_custkey FROM orders")
def silver_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in two incremental steps through Silver, then rebuilt in full."""
    lake = new_lake(spark, "rebuild")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    odd = F.col("o_orderkey") % 2 == 1
    for part in (orders.where(~odd), orders.where(odd)):
        load_bronze(lake, "orders_bronze", part, "orders", "incremental")
        build_silver(lake, "orders_bronze", pk="o_orderkey", widen=True, incremental=True)
    build_silver(lake, "orders_bronze", pk="o_orderkey", widen=True)
    return data_columns(lake.read("silver", "orders_silver"))


@R.query("""
    SELECT 'bronze' AS layer, 'orders_bronze' AS table_name, 'success' AS status, count(*) AS n FROM orders
    UNION ALL SELECT 'bronze', 'customer_bronze', 'success', count(*) FROM customer
    UNION ALL SELECT 'silver', 'orders_silver', 'success', count(*) FROM orders
    UNION ALL SELECT 'silver', 'customer_silver', 'success', count(*) FROM customer
    UNION ALL SELECT 'gold', 'segment_revenue', 'success', count(DISTINCT c_mktsegment) FROM customer
""")
def medallion_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [SourceSpec(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer")]
    plan = {
        "source_tables": ["customer_silver", "orders_silver"],
        "joins": [
            {
                "fact": "customer_silver",
                "dim": "orders_silver",
                "on": "customer_silver.c_custkey = orders_silver.o_custkey",
                "type": "left",
            }
        ],
        "group_by": ["c_mktsegment"],
        "aggregations": [{"func": "SUM", "col": "o_totalprice", "alias": "total_spend"}],
        "destination": "segment_revenue",
    }
    report = run_layers(new_lake(spark, "run"), sources, [plan])
    return report.select("layer", "table_name", "status", F.col("rows").alias("n"))
