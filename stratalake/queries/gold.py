"""Gold queries: joins, aggregates, plans, summaries and name-driven plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.operators.bronze import load_bronze
from stratalake.operators.joins import full_join, spread_left_join
from stratalake.operators.silver import build_silver
from stratalake.plans.gold import build_gold
from stratalake.plans.incremental import refresh_gold
from stratalake.plans.resolve import gold_from_columns
from stratalake.plans.spec import PlanError
from stratalake.plans.summary import auto_summary
from stratalake.queries.base import Registry, new_lake, table, tables

R = Registry()
QUERIES, SQL = R.queries, R.sql


def agg(func: str, col: str, alias: str, **more) -> dict:
    return {"func": func, "col": col, "alias": alias, **more}


def join(fact: str, dim: str, on: str, kind: str = "left") -> dict:
    return {"fact": fact, "dim": dim, "on": on, "type": kind}


CUSTOMER_ORDERS = join("customer", "orders", "customer.c_custkey = orders.o_custkey")

REVENUE = {
    "source_tables": ["customer", "orders"],
    "joins": [CUSTOMER_ORDERS],
    "group_by": ["c_mktsegment"],
    "aggregations": [
        agg("COUNT", "*", "order_count"),
        agg("SUM", "o_totalprice", "total_spend"),
        agg("AVG", "o_totalprice", "average_order_value"),
        agg("MAX", "o_orderdate", "last_order_at"),
    ],
    "derived_columns": [
        {"column": "is_large", "expression": "total_spend > 500000000", "type": "boolean"}
    ],
    "destination": "segment_revenue",
}


@R.query("""
    SELECT c_mktsegment, count(*) AS order_count, sum(o_totalprice) AS total_spend,
           avg(o_totalprice) AS average_order_value, max(o_orderdate) AS last_order_at,
           coalesce(sum(o_totalprice) > 500000000, false) AS is_large
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey
    GROUP BY c_mktsegment
""")
def gold_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_gold(tables(spark, sf_dir, "customer", "orders"), REVENUE)


def _users(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as users of the events, under the events' key name."""
    users = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "user_id")
    return {"users": users, "events": table(spark, sf_dir, "events")}


_USER_AGGS = [
    agg("COUNT", "*", "row_count"),
    agg("COUNT", "event_id", "event_count"),
    agg("SUM", "value", "total_value"),
    agg("AVG", "value", "avg_value"),
    agg("MIN", "ts", "first_at"),
    agg("MAX", "ts", "last_at"),
]
_USER_SQL = """count(*) AS row_count, count(event_id) AS event_count, sum(value) AS total_value,
           avg(value) AS avg_value, min(ts) AS first_at, max(ts) AS last_at"""


@R.query(f"""
    SELECT c_custkey AS user_id, c_mktsegment, {_USER_SQL}
    FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY 1, 2
""")
def gold_left_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key name on both sides; users without events count one row but no event."""
    plan = {
        "source_tables": ["users", "events"],
        "joins": [join("users", "events", "user_id")],
        "group_by": ["user_id", "c_mktsegment"],
        "aggregations": _USER_AGGS,
        "destination": "user_activity",
    }
    return build_gold(_users(spark, sf_dir), plan)


_LEFT_EXPR = {
    "source_tables": ["customer", "events"],
    "joins": [join("customer", "events", "customer.c_custkey = events.user_id")],
    "group_by": ["c_mktsegment"],
    "aggregations": _USER_AGGS + [agg("SUM", "CASE WHEN value > 50 THEN 1 ELSE 0 END", "big_events")],
    "destination": "segment_activity",
}
_LEFT_EXPR_SQL = f"""
    SELECT c_mktsegment, {_USER_SQL},
           CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS big_events
    FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY 1
"""


@R.query(_LEFT_EXPR_SQL)
def gold_left_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_gold(tables(spark, sf_dir, "customer", "events"), _LEFT_EXPR)


@R.query(_LEFT_EXPR_SQL)
def gold_two_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are combined per user before they meet the customers."""
    return build_gold(tables(spark, sf_dir, "customer", "events"), _LEFT_EXPR, strategy="two_step")


@R.query(_LEFT_EXPR_SQL)
def gold_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crowded users are cut in parts for the join."""
    return build_gold(tables(spark, sf_dir, "customer", "events"), _LEFT_EXPR, strategy="spread")


@R.query("""
    SELECT user_id, event_id, event_type, c_name
    FROM events LEFT JOIN customer ON user_id = c_custkey
""")
def join_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _users(spark, sf_dir)
    joined = spread_left_join(users["events"], users["users"], "user_id", min_rows=20)
    return joined.select("user_id", "event_id", "event_type", "c_name")


def _some_users(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Events by users outside the dimension exist, and so do users without events."""
    pair = _users(spark, sf_dir)
    return {**pair, "users": pair["users"].where("c_acctbal > 0")}


@R.query("""
    SELECT coalesce(user_id, c_custkey) AS user_id, event_id, event_type, c_name
    FROM events FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON user_id = c_custkey
""")
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = _some_users(spark, sf_dir)
    joined = full_join(pair["events"], pair["users"], "user_id")
    return joined.select("user_id", "event_id", "event_type", "c_name")


_FULL = {
    "source_tables": ["events", "users"],
    "joins": [join("events", "users", "user_id", "full")],
    "group_by": ["user_id", "c_mktsegment"],
    "aggregations": _USER_AGGS,
    "destination": "user_activity",
}
_FULL_SQL = f"""
    SELECT coalesce(user_id, c_custkey) AS user_id, c_mktsegment, {_USER_SQL}
    FROM events FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON user_id = c_custkey
    GROUP BY 1, 2
"""


@R.query(_FULL_SQL)
def gold_full_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_gold(_some_users(spark, sf_dir), _FULL)


@R.query(_FULL_SQL)
def gold_full_two_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_gold(_some_users(spark, sf_dir), _FULL, strategy="two_step")


_STAR_SQL = """
    SELECT n_name, o_orderpriority, count(*) AS line_count, sum(l_extendedprice) AS total_price,
           max(l_shipdate) AS last_shipped, count(DISTINCT l_suppkey) AS suppliers
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    GROUP BY 1, 2
"""

_STAR = {
    "source_tables": ["lineitem", "orders", "customer", "nation"],
    "joins": [
        join("lineitem", "orders", "lineitem.l_orderkey = orders.o_orderkey"),
        join("orders", "customer", "orders.o_custkey = customer.c_custkey"),
        join("customer", "nation", "customer.c_nationkey = nation.n_nationkey"),
    ],
    "group_by": ["n_name", "o_orderpriority"],
    "aggregations": [
        agg("COUNT", "*", "line_count"),
        agg("SUM", "l_extendedprice", "total_price"),
        agg("MAX", "l_shipdate", "last_shipped"),
        agg("COUNT DISTINCT", "l_suppkey", "suppliers"),
    ],
    "destination": "nation_lines",
}
_STAR_TABLES = ("lineitem", "orders", "customer", "nation")


@R.query(_STAR_SQL)
def gold_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    # joins[0].fact names the table all others are joined to, step by step
    return build_gold(tables(spark, sf_dir, *_STAR_TABLES), _STAR)


@R.query(_STAR_SQL)
def gold_distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are combined per order before the joins; the suppliers of an order travel as a set."""
    return build_gold(tables(spark, sf_dir, *_STAR_TABLES), _STAR, strategy="two_step")



@R.query("""
    SELECT 'left' AS join_type, true AS accepted, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey
    UNION ALL
    SELECT 'full', true, count(*) FROM customer FULL JOIN orders ON c_custkey = o_custkey
    UNION ALL SELECT 'inner', false, NULL
""")
def gold_inner_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan may keep all fact rows or all rows of both sides; an inner join is refused."""
    source = tables(spark, sf_dir, "customer", "orders")
    parts = []
    for kind in ("left", "full", "inner"):
        plan = {
            "source_tables": ["customer", "orders"],
            "joins": [{**CUSTOMER_ORDERS, "type": kind}],
            "group_by": [],
            "aggregations": [agg("COUNT", "*", "n")],
        }
        name = F.lit(kind).alias("join_type")
        try:
            parts.append(build_gold(source, plan).select(name, F.lit(True).alias("accepted"), "n"))
        except PlanError:
            refused = spark.range(1).select(
                name, F.lit(False).alias("accepted"), F.lit(None).cast("long").alias("n")
            )
            parts.append(refused)
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.query("""
    SELECT c_mktsegment, count(*) AS n, sum(o_totalprice) AS total_spend
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey
    WHERE o_orderstatus <> 'F' AND c_acctbal > 0 GROUP BY 1
""")
def gold_filter_after_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = {
        **REVENUE,
        "aggregations": [agg("COUNT", "*", "n"), agg("SUM", "o_totalprice", "total_spend")],
        "filters": ["o_orderstatus <> 'F'", "c_acctbal > 0"],
        "derived_columns": [],
    }
    return build_gold(tables(spark, sf_dir, "customer", "orders"), plan)


@R.query("""
    SELECT event_type, count(DISTINCT user_id) AS users, count(user_id) AS n, min(value) AS low
    FROM events GROUP BY 1
""")
def gold_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = {
        "source_tables": ["events"],
        "group_by": ["event_type"],
        "aggregations": [
            agg("COUNT DISTINCT", "user_id", "users"),
            agg("COUNT", "user_id", "n"),
            agg("MIN", "value", "low"),
        ],
        "destination": "event_users",
    }
    return build_gold(tables(spark, sf_dir, "events"), plan)


@R.query("""
    SELECT o_orderpriority,
           CAST(sum(date_diff('day', o_orderdate, DATE '2002-01-01')) AS BIGINT) AS total_age_days,
           CAST(max(date_diff('day', o_orderdate, DATE '2002-01-01')) AS INTEGER) AS oldest_days
    FROM orders GROUP BY 1
""")
def gold_expr_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = {
        "source_tables": ["orders"],
        "group_by": ["o_orderpriority"],
        "aggregations": [
            agg("SUM", "datediff(current_date(), o_orderdate)", "total_age_days"),
            agg("MAX", "datediff(current_date(), o_orderdate)", "oldest_days"),
        ],
        "destination": "order_age",
    }
    return build_gold(tables(spark, sf_dir, "orders"), plan, as_of="2002-01-01")


@R.query("""
    SELECT l_returnflag, sum(l_extendedprice) / nullif(sum(l_quantity), 0) AS unit_price,
           sum(l_tax) / nullif(sum(l_discount - l_discount), 0) AS no_ratio,
           sum(l_tax) / nullif(sum(l_discount), 0) AS tax_share
    FROM lineitem GROUP BY 1
""")
def gold_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of sums, one of them by zero; the last is written the way split text leaves it."""
    plan = {
        "source_tables": ["lineitem"],
        "group_by": ["l_returnflag"],
        "aggregations": [
            agg("RATIO", "l_extendedprice", "unit_price", den="l_quantity"),
            agg("RATIO", "l_tax", "no_ratio", den="l_discount - l_discount"),
            agg("SUM", "l_tax)/sum(l_discount", "tax_share"),
        ],
        "destination": "line_ratios",
    }
    return build_gold(tables(spark, sf_dir, "lineitem"), plan)


@R.query("SELECT count(*) AS n, sum(o_totalprice) AS total, min(o_orderdate) AS first_at FROM orders")
def gold_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = {
        "source_tables": ["orders"],
        "group_by": [],
        "aggregations": [
            agg("COUNT", "*", "n"),
            agg("SUM", "o_totalprice", "total"),
            agg("MIN", "o_orderdate", "first_at"),
        ],
        "destination": "all_orders",
    }
    return build_gold(tables(spark, sf_dir, "orders"), plan)


@R.query("""
    SELECT segment, total, total * 2 AS twice, total * 2 > 1000000000 AS is_top FROM (
        SELECT c_mktsegment AS segment, sum(o_totalprice) AS total
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
""")
def gold_rename_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = {
        **REVENUE,
        "aggregations": [agg("SUM", "o_totalprice", "total")],
        "column_aliases": [{"from": "c_mktsegment", "to": "segment"}],
        "derived_columns": [
            {"column": "twice", "expression": "total * 2"},
            {"column": "is_top", "expression": "twice > 1000000000", "type": "boolean"},
        ],
    }
    return build_gold(tables(spark, sf_dir, "customer", "orders"), plan)


_BREACH = (
    "(event_type = 'error' AND value > 15) OR (event_type = 'click' AND value > 30) "
    "OR (event_type = 'view' AND value > 120)"
)

_SLA = {
    "source_tables": ["events", "users"],
    "joins": [join("events", "users", "user_id", "full")],
    "pre_columns": [
        {
            "column": "label",
            "expression": "CASE WHEN c_name IS NULL THEN 'UNLISTED' "
            "ELSE concat_ws(' ', c_name, c_mktsegment) END",
        },
        {"column": "breach", "expression": f"CASE WHEN {_BREACH} THEN 1 ELSE 0 END"},
    ],
    "group_by": ["user_id", "label"],
    "aggregations": [
        agg("COUNT", "event_id", "total_events"),
        agg("AVG", "value", "average_value"),
        agg("SUM", "breach", "breach_count"),
        agg("COUNT_IF", "event_type = 'purchase'", "purchases"),
        agg("RATE", "event_type = 'click'", "click_percent", den="event_id"),
    ],
    "destination": "user_sla",
}
_SLA_SQL = f"""
    SELECT coalesce(user_id, c_custkey) AS user_id,
           CASE WHEN c_name IS NULL THEN 'UNLISTED' ELSE c_name || ' ' || c_mktsegment END AS label,
           count(event_id) AS total_events, avg(value) AS average_value,
           CAST(sum(CASE WHEN {_BREACH} THEN 1 ELSE 0 END) AS BIGINT) AS breach_count,
           CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases,
           CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT)
               / nullif(count(event_id), 0) * 100 AS click_percent
    FROM events FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON user_id = c_custkey
    GROUP BY 1, 2
"""


def _sla_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    pair = _some_users(spark, sf_dir)
    # The leftover of a permissive JSON read never reaches Gold.
    events = pair["events"].withColumn("_corrupt_record", F.lit(None).cast("string"))
    return {**pair, "events": events}


@R.query(_SLA_SQL)
def gold_case_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_gold(_sla_tables(spark, sf_dir), _SLA)


@R.query(_SLA_SQL)
def gold_case_rate_two_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_gold(_sla_tables(spark, sf_dir), _SLA, strategy="two_step")


@R.query("""
    SELECT o_orderstatus, o_orderpriority, o_orderdate, count(*) AS record_count,
           CAST(sum(o_custkey) AS BIGINT) AS total_o_custkey, avg(o_custkey) AS avg_o_custkey,
           sum(o_totalprice) AS total_o_totalprice, avg(o_totalprice) AS avg_o_totalprice
    FROM orders GROUP BY 1, 2, 3
""")
def gold_auto_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auto_summary(table(spark, sf_dir, "orders"), "orders", ordered=False)


@R.query("""
    SELECT event_type, count(*) AS record_count, sum(value) AS total_value, avg(value) AS avg_value,
           count(DISTINCT user_id) AS users, max(ts) AS max_ts
    FROM events GROUP BY 1
""")
def gold_auto_summary_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auto_summary(
        table(spark, sf_dir, "events"),
        "events",
        group_by=["event_type"],
        measures=["value", "COUNT DISTINCT(user_id) as users", "MAX(ts)"],
    )


@R.query("""
    SELECT c_mktsegment, o_orderpriority, count(*) AS record_count, sum(c_acctbal) AS total_c_acctbal,
           avg(o_totalprice) AS avg_o_totalprice
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2
""")
def gold_joined_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two table plans and a confirmed hint; the aggregate of an unknown column is left out."""
    plan = {
        "cross_table_hint": {
            "join_confirmed": True,
            "tables": ["customer_silver", "orders_silver"],
            "suggested_join_key": "custkey",
            "destination": "customer_orders",
        },
        "tables": [
            {
                "group_by": ["c_mktsegment"],
                "aggregations": [
                    agg("COUNT", "*", "record_count"),
                    agg("SUM", "c_acctbal", "total_c_acctbal"),
                ],
            },
            {
                "group_by": ["o_orderpriority", "c_mktsegment"],
                "aggregations": [
                    agg("COUNT", "o_orderkey", "record_count"),
                    agg("AVG", "o_totalprice", "avg_o_totalprice"),
                    agg("MAX", "o_nothing", "max_o_nothing"),
                ],
            },
        ],
    }
    source = {
        "customer_silver": table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "custkey"),
        "orders_silver": table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey"),
    }
    return build_gold(source, plan, strict=False)


_LINES_SQL = """
    SELECT status, flag_and_line, line_count, revenue, average_discount, charge_per_unit, first_at, late_count,
           revenue > 500000000 AS is_large FROM (
        SELECT o_orderstatus AS status, l_returnflag || l_linestatus AS flag_and_line, count(*) AS line_count,
               sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_discount) AS average_discount,
               sum(l_extendedprice) / nullif(sum(l_quantity), 0) AS charge_per_unit,
               min(o_orderdate) AS first_at,
               CAST(sum(CASE WHEN l_shipdate > o_orderdate THEN 1 ELSE 0 END) AS BIGINT) AS late_count
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
        WHERE l_quantity > 5 AND o_orderpriority <> '5-LOW' GROUP BY 1, 2)
"""

_LINES = {
    "source_tables": ["lineitem", "orders"],
    "joins": [join("lineitem", "orders", "lineitem.l_orderkey = orders.o_orderkey")],
    "pre_columns": [{"column": "flag_and_line", "expression": "concat(l_returnflag, l_linestatus)"}],
    "filters": ["l_quantity > 5", "orders.o_orderpriority <> '5-LOW'"],
    "group_by": ["o_orderstatus", "flag_and_line"],
    "aggregations": [
        agg("COUNT", "*", "line_count"),
        agg("SUM", "l_extendedprice * (1 - l_discount)", "revenue"),
        agg("AVG", "l_discount", "average_discount"),
        agg("RATIO", "l_extendedprice", "charge_per_unit", den="l_quantity"),
        agg("MIN", "o_orderdate", "first_at"),
        agg("COUNT_IF", "l_shipdate > o_orderdate", "late_count"),
    ],
    "column_aliases": [{"from": "o_orderstatus", "to": "status"}],
    "derived_columns": [
        {"column": "is_large", "expression": "revenue > 500000000", "type": "boolean"}
    ],
    "destination": "line_status",
}


@R.query(_LINES_SQL)
def gold_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_gold(tables(spark, sf_dir, "lineitem", "orders"), _LINES)


@R.query(_LINES_SQL)
def gold_plan_eager(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and orders are combined per order before they meet, though the aggregates read both."""
    return build_gold(tables(spark, sf_dir, "lineitem", "orders"), _LINES, strategy="eager")


_MANY_SQL = """
    SELECT c_mktsegment, label, count(*) AS row_count, count(o_orderkey) AS order_rows, count(event_id) AS event_rows,
           sum(o_totalprice) AS total_price, avg(value) AS average_value, max(o_orderdate) AS last_order_at, min(ts) AS first_event_at,
           sum(value) / nullif(sum(o_totalprice), 0) AS value_per_price,
           CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished, sum(c_acctbal) AS balance
    FROM (SELECT *, CASE WHEN event_type IS NULL THEN 'none' ELSE event_type END AS label
          FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN events ON c_custkey = user_id)
    WHERE coalesce(o_orderpriority, 'x') <> '5-LOW' GROUP BY 1, 2
"""


@R.query(_MANY_SQL)
def gold_many_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of a customer beside every event of theirs, without making these rows: counts multiply."""
    plan = {
        "source_tables": ["customer", "orders", "events"],
        "joins": [CUSTOMER_ORDERS, join("customer", "events", "customer.c_custkey = events.user_id")],
        "pre_columns": [{"column": "label", "expression": "CASE WHEN event_type IS NULL THEN 'none' ELSE event_type END"}],
        "filters": ["coalesce(o_orderpriority, 'x') <> '5-LOW'"],
        "group_by": ["c_mktsegment", "label"],
        "aggregations": [
            agg("COUNT", "*", "row_count"),
            agg("COUNT", "o_orderkey", "order_rows"),
            agg("COUNT", "event_id", "event_rows"),
            agg("SUM", "o_totalprice", "total_price"),
            agg("AVG", "value", "average_value"),
            agg("MAX", "o_orderdate", "last_order_at"),
            agg("MIN", "ts", "first_event_at"),
            agg("RATIO", "value", "value_per_price", den="o_totalprice"),
            agg("COUNT_IF", "o_orderstatus = 'F'", "finished"),
            agg("SUM", "c_acctbal", "balance"),
        ],
        "destination": "orders_and_events",
    }
    return build_gold(tables(spark, sf_dir, "customer", "orders", "events"), plan, strategy="eager")



@R.query("""
    SELECT c_mktsegment, sum(o_totalprice) AS total_o_totalprice, avg(o_totalprice) AS avg_o_totalprice,
           count(*) AS record_count, max(o_orderdate) AS last_o_orderdate,
           min(c_acctbal) AS min_acctbal, count(o_orderkey) AS num_o_orderkey,
           sum(o_totalprice) > 500000000 AS is_large
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1
""")
def gold_from_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [
        "c_mktsegment",
        "total_o_totalprice",
        "avg_o_totalprice",
        "record_count",
        "last_o_orderdate",
        "min_acctbal",
        "num_o_orderkey",
        "is_large",
    ]
    return gold_from_columns(
        tables(spark, sf_dir, "customer", "orders"),
        wanted,
        on="c_custkey = o_custkey",
        conditions={"is_large": "total_o_totalprice > 500000000"},
    )


@R.query("""
    SELECT event_type, is_big, count(*) AS n, count(value) AS n_values, sum(value) AS total_value, avg(value) AS average_value, min(ts) AS first_at,
           max(value) AS top, count(DISTINCT user_id) AS users, count(c_name) AS n_named
    FROM (SELECT *, CASE WHEN value > 50 THEN 'yes' ELSE 'no' END AS is_big FROM events LEFT JOIN customer ON user_id = c_custkey)
    WHERE event_type <> 'error' GROUP BY 1, 2
""")
def gold_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in three loads, each followed by a Gold run that reads only the new one."""
    lake = new_lake(spark, "incremental-gold")
    events = table(spark, sf_dir, "events")
    plan = {
        "source_tables": ["events_silver", "users_silver"],
        "joins": [join("events_silver", "users_silver", "user_id")],
        "pre_columns": [{"column": "is_big", "expression": "CASE WHEN value > 50 THEN 'yes' ELSE 'no' END"}],
        "filters": ["event_type <> 'error'"],
        "group_by": ["event_type", "is_big"],
        "aggregations": [
            agg("COUNT", "*", "n"),
            agg("COUNT", "value", "n_values"),
            agg("SUM", "value", "total_value"),
            agg("AVG", "value", "average_value"),
            agg("MIN", "ts", "first_at"),
            agg("MAX", "value", "top"),
            agg("COUNT DISTINCT", "user_id", "users"),
            agg("COUNT", "c_name", "n_named"),
        ],
        "destination": "event_types",
    }
    load_bronze(lake, "users_bronze", table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "user_id"), "customer")
    build_silver(lake, "users_bronze", pk="user_id", widen=True)
    for i in range(3):
        load_bronze(lake, "events_bronze", events.where(F.col("event_id") % 3 == i), "events", "incremental")
        build_silver(lake, "events_bronze", pk="event_id", widen=True, incremental=True)
        refresh_gold(lake, plan)
    return lake.read("gold", "event_types")
