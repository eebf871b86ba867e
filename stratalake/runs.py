"""Runs sources through Bronze and Silver, then the Gold plans, and reports per table."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from stratalake.functions.names import bronze_name, silver_name, summary_name
from stratalake.operators.bronze import load_bronze
from stratalake.operators.silver import build_silver
from stratalake.plans.gold import run_gold
from stratalake.plans.spec import plans_of
from stratalake.plans.summary import run_summary
from stratalake.sources.files import FORMATS, MissingSource, format_of, read_source
from stratalake.sources.jdbc import JdbcTable, read_jdbc
from stratalake.sources.lake import Lake
from stratalake.sources.storage import path_exists
from stratalake.streaming.files import ingest_new_files

log = logging.getLogger(__name__)

RESULT = "layer string, table_name string, status string, rows long, error string"


@dataclass(frozen=True)
class SourceSpec:
    """One source: a file path or a JDBC table, and how to load it.

    An incremental load takes the rows above the stored ``watermark_col``. Without one, a file
    source takes the files it has not seen before; a JDBC source is appended whole.
    ``options`` are reader options of ``read_source``, of a JDBC table ``bounds``, ``predicates`` and ``fetch_size`` of ``read_jdbc``.
    """

    source: str | JdbcTable
    mode: str = "full"
    fmt: str | None = None
    schema: object = None
    watermark_col: str | None = None
    lookback: str | None = None
    partition_column: str | None = None
    num_partitions: int = 64
    pk: str | None = None
    widen: bool = False
    name: str | None = None
    options: dict | None = None

    @property
    def is_jdbc(self) -> bool:
        return isinstance(self.source, JdbcTable)

    @property
    def label(self) -> str:
        return self.source.table if self.is_jdbc else self.source

    @property
    def bronze_table(self) -> str:
        return self.name or bronze_name(self.label, "jdbc" if self.is_jdbc else "file")

    @property
    def silver_table(self) -> str:
        return silver_name(self.bronze_table)

    def read(self, lake: Lake) -> DataFrame:
        if not self.is_jdbc:
            return read_source(lake.spark, self.source, self.fmt, self.schema, **(self.options or {}))
        return read_jdbc(
            lake.spark,
            self.source,
            partition_column=self.partition_column,
            num_partitions=self.num_partitions,
            lower=self._stored_watermark(lake),
            **(self.options or {}),
        )

    def _stored_watermark(self, lake: Lake) -> str | None:
        """Where the new rows start, to split only their range. (Time-zone dependent values are
        kept as numbers in the load state and cannot serve.)"""
        if self.mode != "incremental" or self.lookback or self.watermark_col != self.partition_column:
            return None
        load = lake.latest("bronze", self.bronze_table) if self.watermark_col else None
        kinds = ("int", "bigint", "smallint", "date", "timestamp_ntz")
        if load is None or self.watermark_col not in load.schema.names or load.schema[self.watermark_col].dataType.simpleString() not in kinds:
            return None
        return load.last_watermark_value


def run_layers(
    lake: Lake,
    sources: Sequence[SourceSpec],
    plans: Sequence[dict] = (),
    summaries: bool = False,
    stop_on_failure: bool = True,
    incremental_silver: bool = False,
    concurrent: int = 4,
) -> DataFrame:
    """Load every source into Bronze, make Silver of them, then build the Gold plans (and, with
    ``summaries``, the default summary of every Silver table).

    Tables of a layer do not depend on each other; up to ``concurrent`` of them run at a time so
    that small ones do not leave the cluster idle. A failed table does not stop its
    neighbours. With ``stop_on_failure`` the next layer starts only if this one is whole; without,
    tables that lack their input are skipped. The result has one row per table and layer.
    """
    results: list[tuple] = []
    for name, names in (("bronze", [s.bronze_table for s in sources]), ("silver", [s.silver_table for s in sources])):
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise ValueError(f"several sources make the same {name} table: {twice}")
    parsed: list = []
    for d in plans:
        try:
            parsed += plans_of(d)
        except Exception as e:  # a plan that cannot be read is a failed row, like any other
            parsed.append((str(d.get("destination")), e))

    def layer(name: str, jobs: list[tuple[str, Callable[[], int]]], go: bool) -> set[str]:
        """Run a layer's jobs; gives the tables that are done."""
        if not go:
            results.extend((name, table, "skipped", None, None) for table, _ in jobs)
            return set()
        with ThreadPoolExecutor(max(1, concurrent)) as pool:
            target = inheritable_thread_target(lake.spark)(_attempt)
            done = list(pool.map(lambda job: target(name, *job), jobs))
        results.extend(done)
        return {table for _, table, status, _, _ in done if status == "success"}

    bronze = [(s.bronze_table, lambda s=s: _bronze(lake, s)) for s in sources]
    loaded = layer("bronze", bronze, True)
    whole = len(loaded) == len(bronze)

    go = whole or not stop_on_failure
    ready = [s for s in sources if s.bronze_table in loaded] if go else sources
    silver = [(s.silver_table, lambda s=s: _silver(lake, s, incremental_silver)) for s in ready]
    made = layer("silver", silver, go)
    whole = whole and len(made) == len(silver)

    go = whole or not stop_on_failure
    gold = [(p[0], lambda p=p: _refuse(p[1])) if isinstance(p, tuple) else (p.destination, lambda p=p: run_gold(lake, p)) for p in parsed]
    if summaries:
        gold += [
            (summary_name(s.silver_table), lambda s=s: run_summary(lake, s.silver_table))
            for s in (ready if go else sources)
            if s.silver_table in made or not go
        ]
    layer("gold", gold, go)
    return lake.spark.createDataFrame(results, RESULT)


def _refuse(error: Exception) -> int:
    raise error


def _attempt(layer: str, table: str, job: Callable[[], int]) -> tuple:
    try:
        return layer, table, "success", job(), None
    except Exception as e:  # one table's failure is a row of the report
        log.exception("%s %s failed", layer, table)
        return layer, table, "failed", None, f"{type(e).__name__}: {e}".split("\n")[0]


def _bronze(lake: Lake, spec: SourceSpec) -> int:
    if spec.mode == "incremental" and not spec.is_jdbc and not spec.watermark_col:
        fmt, options = (spec.fmt or format_of(spec.source)).lower(), dict(spec.options or {})
        if fmt not in FORMATS:  # as ``read_source`` does
            log.warning("format %r is not known, reading %s as CSV", fmt, spec.source)
            fmt, options = "csv", {**options, "comment": None}
        if not path_exists(lake.spark, spec.source):
            raise MissingSource(f"no such source: {spec.source}")
        return ingest_new_files(lake, spec.source, spec.bronze_table, spec.schema, fmt, **options)
    return load_bronze(
        lake,
        spec.bronze_table,
        spec.read(lake),
        spec.label,
        spec.mode,
        source_type="jdbc" if spec.is_jdbc else "file",
        watermark_col=spec.watermark_col,
        lookback=spec.lookback,
        key=spec.pk,
    ).rows


def _silver(lake: Lake, spec: SourceSpec, incremental: bool) -> int:
    return build_silver(
        lake, spec.bronze_table, pk=spec.pk, widen=spec.widen, incremental=incremental
    ).rows
