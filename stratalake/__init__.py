"""Layered (Bronze / Silver / Gold) analytics on Spark DataFrames."""

from stratalake.operators.bronze import load_bronze, with_audit
from stratalake.operators.silver import build_silver, to_silver
from stratalake.operators.upsert import latest_rows, upsert
from stratalake.plans.gold import build_gold, run_gold, write_gold
from stratalake.plans.incremental import refresh_gold
from stratalake.plans.resolve import gold_from_columns, plan_from_columns, shared_keys
from stratalake.plans.spec import GoldPlan, PlanError, plans_of
from stratalake.plans.summary import auto_summary, run_summary, summary_plan
from stratalake.runs import SourceSpec, run_layers
from stratalake.sources.files import read_source
from stratalake.sources.jdbc import JdbcTable, read_jdbc, tables_exist
from stratalake.sources.lake import Lake
from stratalake.streaming.files import ingest_new_files

__all__ = [
    "GoldPlan",
    "JdbcTable",
    "Lake",
    "PlanError",
    "SourceSpec",
    "auto_summary",
    "build_gold",
    "build_silver",
    "gold_from_columns",
    "ingest_new_files",
    "latest_rows",
    "load_bronze",
    "plan_from_columns",
    "plans_of",
    "read_jdbc",
    "read_source",
    "refresh_gold",
    "run_gold",
    "run_layers",
    "run_summary",
    "shared_keys",
    "summary_plan",
    "tables_exist",
    "to_silver",
    "upsert",
    "with_audit",
    "write_gold",
]
