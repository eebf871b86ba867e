"""Catalog, checks, preview and SQL across tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.operators.bronze import load_bronze
from stratalake.operators.catalog import (
    columns_of,
    default_query,
    file_profile,
    layer_catalog,
    preview,
    row_counts,
    run_sql,
    table_statistics,
)
from stratalake.operators.follow import followed_key_audit, followed_key_coverage
from stratalake.operators.quality import key_audit, key_coverage, orphans
from stratalake.operators.silver import build_silver
from stratalake.plans.gold import build_gold, write_gold
from stratalake.plans.resolve import shared_columns, shared_keys
from stratalake.queries.base import TABLES, Registry, new_lake, table, tables
from stratalake.queries.gold import REVENUE
from stratalake.sources.lake import Lake
from stratalake.sources.storage import scratch_dir

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query("""
    SELECT 'labels' AS table_name, count(*) AS n, CAST(count(*) - count(doc_id) AS BIGINT) AS null_keys,
           count(DISTINCT doc_id) AS distinct_keys,
           (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1)) AS duplicate_keys,
           count(doc_id) - count(DISTINCT doc_id) AS surplus_rows FROM labels
    UNION ALL
    SELECT 'conversations', count(*), CAST(count(*) - count(conv_id) AS BIGINT), count(DISTINCT conv_id),
           (SELECT count(*) FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 1)),
           count(conv_id) - count(DISTINCT conv_id) FROM conversations
""", name="key_audit")
def key_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        key_audit(table(spark, sf_dir, name), key).select(F.lit(name).alias("table_name"), "*")
        for name, key in (("labels", "doc_id"), ("conversations", "conv_id"))
    ]
    return parts[0].unionByName(parts[1]).withColumnRenamed("rows", "n")


_COVERAGE_SQL = """
    SELECT count(user_id) AS rows_with_key,
           count(*) FILTER (user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS matched_rows,
           count(*) FILTER (user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS orphan_rows,
           count(DISTINCT user_id) FILTER (user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
               AS orphan_keys
    FROM events
"""


@R.query(_COVERAGE_SQL, name="key_coverage")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return key_coverage(table(spark, sf_dir, "events"), known, "user_id", "c_custkey")


def _followed_lake(spark: SparkSession, sf_dir: str):
    """Events in two loads and customers, asked after each load."""
    lake = new_lake(spark, "followed")
    events = table(spark, sf_dir, "events")
    load_bronze(lake, "customer_bronze", table(spark, sf_dir, "customer").where("c_acctbal > 0"), "customer")
    for half in (0, 1):
        load_bronze(lake, "events_bronze", events.where(F.col("event_id") % 2 == half), "events", "incremental")
        yield lake


@R.query(_COVERAGE_SQL)
def key_coverage_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage after each of two loads of events; the second time only the new load and its buckets are read."""
    sides = ("bronze", "events_bronze", "user_id"), ("bronze", "customer_bronze", "c_custkey")
    return [followed_key_coverage(lake, *sides, n_buckets=8) for lake in _followed_lake(spark, sf_dir)][-1]


@R.query("""
    SELECT count(*) AS n, CAST(count(*) - count(user_id) AS BIGINT) AS null_keys, count(DISTINCT user_id) AS distinct_keys,
           (SELECT count(*) FROM (SELECT user_id FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) > 1)) AS duplicate_keys,
           count(user_id) - count(DISTINCT user_id) AS surplus_rows FROM events
""")
def key_audit_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits = [followed_key_audit(lake, "bronze", "events_bronze", "user_id", n_buckets=8) for lake in _followed_lake(spark, sf_dir)]
    return audits[-1].withColumnRenamed("rows", "n")


@R.query("""
    SELECT event_id, user_id, event_type FROM events
    WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal > 0)
      AND user_id IS NOT NULL
""")
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    lost = orphans(table(spark, sf_dir, "events"), known, "user_id", "c_custkey")
    return lost.select("event_id", "user_id", "event_type")


@R.query("""
    SELECT 'doc_id' AS key, count(doc_id) AS rows_with_key,
           count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS matched_rows,
           count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS orphan_rows,
           count(DISTINCT doc_id) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS orphan_keys
    FROM documents
""")
def shared_key_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best shared key of two tables, and how well it joins them."""
    pair = tables(spark, sf_dir, "documents", "labels")
    key = shared_keys(pair)[0]
    return key_coverage(pair["documents"], pair["labels"], key).select(F.lit(key).alias("key"), "*")


@R.query("""
    SELECT 'doc_id' AS column_name, CAST(2 AS BIGINT) AS tables, true AS is_id,
           CAST((SELECT count(*) FROM documents) + (SELECT count(*) FROM labels) AS BIGINT) AS n
    UNION ALL
    SELECT 'text', 3, false, CAST((SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark)
                                  + (SELECT count(*) FROM conversations) AS BIGINT)
""", name="shared_keys")
def shared_column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that several tables have, with the rows of those tables."""
    source = tables(spark, sf_dir, *TABLES)
    columns = columns_of(spark, source)
    rows = columns.join(row_counts(source), "table_name").groupBy("column_name").agg(F.sum("rows").alias("n"))
    return shared_columns(columns).join(rows, "column_name")


@R.query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n, "
        f"(SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE {t})) AS n_columns"
        for t in TABLES
    )
)
def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = row_counts(tables(spark, sf_dir, *TABLES))
    return counts.select("table_name", F.col("rows").alias("n"), F.col("columns").alias("n_columns"))


# One row per column: its role follows from name and type.
_ROLE_SQL = """
    CASE WHEN column_name LIKE '%\\_id' ESCAPE '\\' THEN 'id' WHEN column_type LIKE 'TIMESTAMP%' THEN 'date'
         WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'measure' ELSE 'dimension' END
"""


@R.query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, column_name, {_ROLE_SQL} AS role, false AS is_audit, "
        f"(SELECT count(*) FROM {t}) AS n FROM (DESCRIBE {t})"
        for t in TABLES
    )
)
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = tables(spark, sf_dir, *TABLES)
    counts = row_counts(source).select("table_name", F.col("rows").alias("n"))
    return columns_of(spark, source).drop("data_type").join(counts, "table_name")


@R.query("""
    SELECT 'bronze' AS layer, 'customer_bronze' AS table_name, count(*) AS n FROM customer
    UNION ALL SELECT 'bronze', 'orders_bronze', count(*) FROM orders
    UNION ALL SELECT 'silver', 'customer_silver', count(*) FROM customer
    UNION ALL SELECT 'silver', 'orders_silver', count(*) FROM orders
    UNION ALL SELECT 'gold', 'segment_revenue', count(DISTINCT c_mktsegment) FROM customer
""")
def catalog_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = layer_catalog(_small_lake(spark, sf_dir))
    return catalog.select("layer", "table_name", F.col("rows").alias("n"))


_STATISTICS = {"orders": ("o_orderkey", "o_orderstatus", "o_orderdate"), "customer": ("c_custkey", "c_name")}


@R.query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n, count({c}) AS non_null, "
        f"CAST(min({c}) AS VARCHAR) AS low, CAST(max({c}) AS VARCHAR) AS high, true AS distinct_is_near FROM {t}"
        for t, columns in _STATISTICS.items()
        for c in columns
    )
)
def catalog_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifests tell of columns after two loads each; the estimate of distinct values beside their number."""
    lake = Lake(spark, scratch_dir(spark, "statistics"), statistics=True)
    exact = None
    for t, columns in _STATISTICS.items():
        rows = table(spark, sf_dir, t).select(*columns)
        for half in (0, 1):
            lake.write_load("bronze", t, rows.where(F.col(columns[0]) % 2 == half), "incremental")
        counts = rows.agg(*[F.count_distinct(c).alias(c) for c in columns])
        counts = counts.unpivot([], list(columns), "column_name", "n_distinct").withColumn("table_name", F.lit(t))
        exact = counts if exact is None else exact.unionByName(counts)
    near = F.abs(F.col("distinct_estimate") - F.col("n_distinct")) <= 0.15 * F.col("n_distinct") + 1
    told = table_statistics(lake, ("bronze",)).join(exact, ["table_name", "column_name"])
    return told.select("table_name", "column_name", F.col("rows").alias("n"), "non_null", F.col("min").alias("low"), F.col("max").alias("high"), near.alias("distinct_is_near"))


@R.query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST(1 AS BIGINT) AS files, true AS has_size, true AS is_dated, "
        f"count(*) AS n FROM {t}"
        for t in TABLES
    ),
    name="file_profile",
)
def file_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each table beside its rows."""
    stem = F.regexp_extract("path", r"([^/]+)\.parquet", 1)
    files = (
        file_profile(spark, sf_dir)
        .groupBy(stem.alias("table_name"))
        .agg(
            F.count(F.lit(1)).alias("files"),
            (F.min("size") > 0).alias("has_size"),
            F.min("modified").isNotNull().alias("is_dated"),
        )
    )
    counts = row_counts(tables(spark, sf_dir, *TABLES))
    return counts.select("table_name", F.col("rows").alias("n")).join(files, "table_name", "left")


@R.query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 50", name="preview")
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(table(spark, sf_dir, "orders").orderBy("o_orderkey"), 50)


def _small_lake(spark: SparkSession, sf_dir: str):
    """Customers and orders in Bronze and Silver, and one Gold table."""
    lake = new_lake(spark, "explore")
    for name in ("customer", "orders"):
        load_bronze(lake, f"{name}_bronze", table(spark, sf_dir, name), name)
        build_silver(lake, f"{name}_bronze", widen=True)
    silver = {n: lake.read("silver", f"{n}_silver") for n in ("customer", "orders")}
    write_gold(lake, build_gold(silver, REVENUE), "segment_revenue")
    return lake


@R.query("""
    SELECT c_mktsegment AS segment, count(*) AS n,
           count(*) FILTER (o_totalprice > 0.4 * t / c) AS above
    FROM customer JOIN orders ON c_custkey = o_custkey
    JOIN (SELECT c_mktsegment AS s, sum(o_totalprice) AS t, count(*) AS c
          FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) ON s = c_mktsegment
    GROUP BY 1
""")
def sql_across_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze, Silver and Gold tables in one statement."""
    return run_sql(
        _small_lake(spark, sf_dir),
        """
        SELECT c.c_mktsegment AS segment, count(*) AS n,
               count_if(o.o_totalprice > 0.4 * g.average_order_value) AS above
        FROM customer_bronze c
        JOIN orders_silver o ON c.c_custkey = o.o_custkey
        JOIN segment_revenue g ON g.c_mktsegment = c.c_mktsegment
        GROUP BY c.c_mktsegment
        """,
    )


@R.query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_orders, count(*) AS n_known FROM (SELECT * FROM orders LIMIT 20)")
def sql_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement the explorer starts with; which rows come is open, but not how many, that they differ, and that all their columns are a row's."""
    _views(spark, sf_dir, "orders")
    orders = table(spark, sf_dir, "orders")
    known = orders.withColumn("known", F.lit(True))
    found = spark.sql(default_query("orders")).join(known, orders.columns, "left")
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_orders"), F.count("known").alias("n_known"))


def _views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def _sql_query(name: str, sources: tuple[str, ...], spark_sql: str, other_sql: str | None = None) -> None:
    """Register a statement that both engines run, or a pair where the dialects differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _views(spark, sf_dir, *sources)
        return spark.sql(spark_sql)

    R.query(other_sql or spark_sql, name)(run)


# Keys of large tables are made distinct before they are joined or intersected: that happens in
# each task first, so a crowded key does not crowd the join.
_sql_query(
    "sql_join_semi_anti",
    ("customer", "orders", "events"),
    """
    SELECT c_mktsegment, count(*) AS n, sum(c_acctbal) AS balance FROM customer
    WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') e
                  WHERE user_id = c_custkey)
      AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 490000) o
                      WHERE o_custkey = c_custkey)
    GROUP BY c_mktsegment
    """,
)

_sql_query(
    "sql_window_rank",
    ("orders",),
    """
    SELECT o_orderstatus, o_orderkey, o_totalprice, CAST(place AS BIGINT) AS place FROM (
        SELECT o_orderstatus, o_orderkey, o_totalprice,
               row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place
        FROM orders) ranked
    WHERE place <= 10
    """,
)

_sql_query(
    "sql_window_frame",
    ("events",),
    """
    SELECT event_type, day, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS running,
           avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS week_avg,
           lag(n) OVER (PARTITION BY event_type ORDER BY day) AS day_before
    FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) daily
    """,
)

_sql_query(
    "sql_setops",
    ("customer", "orders", "events"),
    """
    SELECT 'both' AS part, count(*) AS n
    FROM (SELECT DISTINCT o_custkey FROM orders INTERSECT SELECT DISTINCT user_id FROM events) a
    UNION ALL
    SELECT 'orders only', count(*)
    FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT DISTINCT user_id FROM events) b
    UNION ALL
    SELECT 'either', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT user_id FROM events) c
    UNION ALL
    SELECT 'all', count(*) FROM (SELECT o_custkey FROM orders UNION ALL SELECT user_id FROM events) d
    """,
)

_sql_query(
    "sql_cube",
    ("orders",),
    """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_totalprice) AS total,
           CAST(grouping(o_orderstatus) AS INTEGER) AS no_status
    FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
    """,
)

_sql_query(
    "sql_rollup_sets",
    ("lineitem",),
    """
    SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem
    GROUP BY ROLLUP (l_returnflag, l_linestatus), GROUPING SETS ((l_linenumber), ())
    """,
)

_sql_query(
    "sql_cte_subquery",
    ("customer", "orders", "nation"),
    """
    WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
    SELECT n_name, count(*) AS n, max(total) AS best
    FROM spend JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    WHERE total > (SELECT avg(total) FROM spend) GROUP BY n_name
    """,
)

_sql_query(
    "sql_topk",
    ("lineitem",),
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100
    """,
)
