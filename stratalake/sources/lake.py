"""Layer tables on shared storage, and the record of what was loaded into them.

A table is a set of segments, folders of Parquet files that are never changed once written. Its state is a manifest, a small JSON file that names the
segments, the schema, the latest load and statistics of every segment. A load writes a segment under a name of its own and is committed by
creating the manifest of the next version if there is none yet, so
 - a load that failed half way leaves a folder that nobody reads,
 - of two writers at the same time one loses and is put on top of the other's state, or repeats,
 - readers see committed loads only, and go on reading what they opened: replaced segments are deleted by age,
 - schema, row counts and statistics of a table are known from one small file.
Many small segments are merged into larger ones after a commit; every row keeps the number of its load.
"""

from __future__ import annotations

import datetime as dt
import json
import logging
import uuid
from collections.abc import Callable, Collection, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.names import LOAD_ID, check_table_name
from stratalake.functions.schema import merge_schemas
from stratalake.sources.statistics import collected, merge_statistics, metrics
from stratalake.sources.storage import child_dirs, children, create_new, delete_dir, dir_times, path_exists, read_text, size_of

log = logging.getLogger(__name__)

LAYERS = ("bronze", "silver", "gold")

#: Source type of a table that a file stream fills.
STREAM = "stream"

SEGMENT = "_segment"
BUCKET = "_bucket"

#: So many of a table's latest segments are merged at the least, and none of so many bytes or more.
MERGE_AT_LEAST = 8
MERGE_BELOW_BYTES = 64 << 30
#: Folders that no manifest names, of loads that failed or still run, are deleted after this time at the earliest.
ORPHAN_AGE = dt.timedelta(days=1)

_LOAD_SCHEMA = T.StructType(
    [
        T.StructField("load_id", T.LongType()),
        T.StructField("first_load_id", T.LongType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("watermark_col", T.StringType()),
        T.StructField("last_watermark_value", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("partition_by", T.StringType()),
        T.StructField("source_load_id", T.LongType()),
        T.StructField("batch", T.LongType()),
    ]
)
_LOG_SCHEMA = T.StructType(_LOAD_SCHEMA.fields + [T.StructField("last_ingested", T.TimestampType())])


class ConcurrentLoad(RuntimeError):
    """Another load of the table was committed meanwhile, and what this one read or skipped depends on it."""


def again_if_late(load: Callable[[], Load], attempts: int = 5) -> Load:
    """Run a load, anew while other writers commit first."""
    for _ in range(attempts - 1):
        try:
            return load()
        except ConcurrentLoad as e:
            log.info("%s; again", e)
    return load()


@dataclass(frozen=True)
class Segment:
    """A folder with the rows of the loads ``first`` to ``last``; ``types`` has those of columns that the table has widened since."""

    name: str
    first: int
    last: int
    rows: int
    bytes: int
    columns: dict = field(default_factory=dict)
    types: dict = field(default_factory=dict)
    #: Of a keyed table: the buckets that still count, and their rows.
    buckets: dict[str, int] | None = None


@dataclass(frozen=True)
class Load:
    """One committed load of a table, and the table as of then: its segments hold the loads ``first_load_id..load_id``."""

    load_id: int
    first_load_id: int
    source_type: str | None
    source_name: str | None
    mode: str
    rows: int
    watermark_col: str | None
    last_watermark_value: str | None
    schema: T.StructType
    partition_by: tuple[str, ...] = ()
    #: The load of the layer before that this one covers, and the number of a stream's batch.
    source_load_id: int | None = None
    batch: int | None = None
    last_ingested: dt.datetime | None = field(default=None, compare=False)
    version: int = field(default=0, compare=False)
    segments: tuple[Segment, ...] = field(default=(), compare=False)
    #: Segments that the table no longer has, and since when.
    dropped: tuple[tuple[str, dt.datetime], ...] = field(default=(), compare=False)
    #: Of a keyed table: into how many buckets its keys are hashed.
    n_buckets: int | None = field(default=None, compare=False)

    @property
    def table_rows(self) -> int:
        return sum(s.rows for s in self.segments)

    def statistics(self) -> dict[str, dict]:
        """Column -> non-null values, least, greatest and a sketch of the distinct ones, over all segments."""
        types = {f.name: f.dataType for f in self.schema.fields}
        return merge_statistics([s.columns for s in self.segments], types)


class Lake:
    """Tables of all layers below one root folder.

    Replaced segments stay for ``keep``, for readers that opened the table before. ``statistics`` are taken of all columns (True) or those of the given
    names while a load is written, which about doubles the time of writing if taken of all; without, catalogs know row counts only.
    """

    def __init__(
        self, spark: SparkSession, root: str, keep: dt.timedelta = dt.timedelta(days=7), statistics: bool | Collection[str] = False
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.keep = keep
        self.statistics = statistics

    # -- names ---------------------------------------------------------------

    def layer_path(self, layer: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"layer must be one of {LAYERS}, not {layer!r}")
        return f"{self.root}/{layer}"

    def path(self, layer: str, table: str) -> str:
        return f"{self.layer_path(layer)}/{check_table_name(table)}"

    def tables(self, layer: str) -> list[str]:
        return [t for t in child_dirs(self.spark, self.layer_path(layer)) if t[0] not in "._"]

    def _log_path(self, layer: str, table: str | None = None) -> str:
        # One directory per table: loads of different tables can commit at the same time.
        base = f"{self.root}/_loads/layer={layer}"
        return f"{base}/table_name={check_table_name(table)}" if table else base

    # -- load log ------------------------------------------------------------

    def load_log(self, layer: str = "bronze") -> DataFrame:
        """Every committed load of a layer, one row each."""
        path = self._log_path(layer)
        schema = T.StructType(_LOG_SCHEMA.fields + [T.StructField("table_name", T.StringType())])
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        stored = T.StructType([*schema.fields, T.StructField("kind", T.StringType())])
        return self.spark.read.schema(stored).json(path).where("kind = 'load'").select(*schema.names)

    def load_state(self, layer: str = "bronze") -> DataFrame:
        """The latest load per table; opens one small file for each."""
        rows = []
        for table, load in self.latest_loads(layer).items():
            values = json.loads(_manifest(load, "load"))
            rows.append((*(values[f.name] for f in _LOAD_SCHEMA.fields), load.last_ingested, table))
        return self.spark.createDataFrame(rows, T.StructType(_LOG_SCHEMA.fields + [T.StructField("table_name", T.StringType())]))

    def latest(self, layer: str, table: str) -> Load | None:
        """The latest committed load of a table; opens one small file however many loads there were."""
        path = self._log_path(layer, table)
        versions = [n for n in children(self.spark, path) if n.endswith(".json") and n[0] != "."]
        return _load_of(read_text(self.spark, f"{path}/{max(versions)}")) if versions else None

    def latest_loads(self, layer: str) -> dict[str, Load]:
        """The same for all tables of a layer that have one."""
        names = [n.partition("=")[2] for n in child_dirs(self.spark, self._log_path(layer))]
        with ThreadPoolExecutor(16) as pool:
            return {n: load for n, load in zip(names, pool.map(lambda n: self.latest(layer, n), names), strict=True) if load}

    def _commit(self, layer: str, table: str, load: Load, kind: str = "load") -> bool:
        """Make the load's manifest the table's state; False if its version is there already."""
        return create_new(self.spark, f"{self._log_path(layer, table)}/{load.version:012d}.json", _manifest(load, kind))

    # -- read ----------------------------------------------------------------

    def read(
        self,
        layer: str,
        table: str,
        after_load: int | None = None,
        with_load_id: bool = False,
        load: Load | None = None,
        buckets: Collection[int] | None = None,
    ) -> DataFrame:
        """A layer table as of its latest committed load (or the given one); with ``after_load``
        only rows of later loads, for which no other segment is opened; of a keyed table with ``buckets`` only those."""
        path = self.path(layer, table)
        load = load or self.latest(layer, table)
        if load is None:  # files put there by hand
            merge = "true" if layer == "bronze" else "false"
            return self.spark.read.option("mergeSchema", merge).parquet(path)
        wanted = [s for s in load.segments if after_load is None or s.last > after_load]
        schema = T.StructType([*load.schema.fields, T.StructField(LOAD_ID, T.LongType()), T.StructField(SEGMENT, T.StringType())])
        alike: dict[str, list[Segment]] = {}
        for s in wanted:
            alike.setdefault(json.dumps(s.types, sort_keys=True), []).append(s)
        df = None
        for segments in alike.values():
            written = T.StructType([T.StructField(f.name, T._parse_datatype_string(segments[0].types[f.name])) if f.name in segments[0].types else f for f in schema.fields])
            places = [place for s in segments for place in _places(path, s, buckets)]
            if not places:
                continue
            part = self.spark.read.schema(written).option("basePath", path).parquet(*places).drop(BUCKET)
            part = part.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields]) if written != schema else part
            df = part if df is None else df.unionByName(part)
        if df is None:
            df = self.spark.createDataFrame([], schema)
        if after_load is not None and any(s.first <= after_load for s in wanted):
            # Only merged segments, which store the number, have older rows.
            df = df.where(F.col(LOAD_ID).isNull() | (F.col(LOAD_ID) > after_load))
        if with_load_id:
            own = [F.lit(x) for s in wanted if s.first == s.last for x in (s.name, s.last)]
            known = F.element_at(F.create_map(*own), F.col(SEGMENT)) if own else F.lit(None)
            return df.withColumn(LOAD_ID, F.coalesce(F.col(LOAD_ID), known.cast("long"))).drop(SEGMENT)
        return df.drop(LOAD_ID, SEGMENT)

    def read_all(self, layer: str) -> dict[str, DataFrame]:
        """Every table of a layer."""
        loads = self.latest_loads(layer)
        return {t: self.read(layer, t, load=loads.get(t)) for t in self.tables(layer)}

    # -- write ---------------------------------------------------------------

    def write_load(
        self,
        layer: str,
        table: str,
        df: DataFrame,
        mode: str,
        *,
        schema: T.StructType | None = None,
        source_type: str | None = None,
        source_name: str | None = None,
        watermark_col: str | None = None,
        partition_by: Sequence[str] = (),
        source_load_id: int | None = None,
        batch: int | None = None,
        previous: Load | None = None,
    ) -> Load:
        """Store one load and commit it.

        Row count, highest watermark and statistics are observed while the rows are written: the
        source is read once. ``observe`` sits right under the write, in the last stage,
        where a retried task is counted once. ``mode='full'`` replaces the table.

        When another writer commits first, a load without a watermark, batch or source load is put on top of that state; one that
        has them must be made anew and raises ``ConcurrentLoad``.
        """
        previous = previous or self.latest(layer, table)
        keep = mode == "incremental" and previous is not None
        if keep and previous.n_buckets:
            raise ValueError(f"{table} is kept by key; upsert into it")
        path = self.path(layer, table)
        if previous is None:
            self._clear_unlogged(path, mode)
        if keep:  # all loads of a table share one folder layout
            if partition_by and tuple(partition_by) != previous.partition_by:
                raise ValueError(f"{table} is partitioned by {list(previous.partition_by)}")
            partition_by = previous.partition_by

        high = [watermark_text(df, watermark_col).alias("high")] if watermark_col else []
        written, seen = self._write_segment(path, df, partition_by, high)
        high = seen.get("high")
        if keep and watermark_col and high is None:
            high = previous.last_watermark_value  # an empty increment never moves it back

        load = Load(
            load_id=0,
            first_load_id=0,
            source_type=source_type,
            source_name=source_name,
            mode=mode,
            rows=written.rows,
            watermark_col=watermark_col,
            last_watermark_value=high,
            schema=schema or df.schema,
            partition_by=tuple(partition_by),
            source_load_id=source_load_id,
            batch=batch,
        )
        state = previous
        while True:
            load = self._on_top(load, written, state, mode)
            load, expired = self._without_expired(load)
            if self._commit(layer, table, load):
                break
            state = self.latest(layer, table)
            if mode == "incremental" and (watermark_col or batch is not None or source_load_id is not None):
                raise ConcurrentLoad(f"{layer} table {table} has a new load {state.load_id}")
        self._delete(path, load, expired)
        if mode == "incremental":
            self.compact(layer, table, load)
        return load

    def _write_segment(
        self, path: str, df: DataFrame, partition_by: Sequence[str], more: Sequence = (), statistics: bool = True
    ) -> tuple[Segment, dict]:
        name = f"s{uuid.uuid4().hex}"
        seen = Observation(name)
        taken = metrics(df.schema, self.statistics) if statistics else []
        if partition_by:
            # Cuts a crowded partition value over several tasks and merges small ones.
            df = df.hint("rebalance", *partition_by)
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows"), *more, *taken).write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{path}/{SEGMENT}={name}")
        found = seen.get
        size = size_of(self.spark, f"{path}/{SEGMENT}={name}")
        return Segment(name, 0, 0, found["rows"], size, collected(df.schema, found)), found

    def _on_top(self, load: Load, written: Segment, state: Load | None, mode: str) -> Load:
        """The load as the one after ``state``."""
        load_id = state.load_id + 1 if state else 1
        written = replace(written, first=load_id, last=load_id)
        if state is None or mode != "incremental":
            gone = [(s.name, _now()) for s in state.segments] if state else []
            kept, first, schema = (), load_id, load.schema
            dropped = (*(state.dropped if state else ()), *gone)
        else:
            if load.partition_by != state.partition_by:
                raise ValueError(f"the table is partitioned by {list(state.partition_by)}")
            schema = merge_schemas(load.schema, state.schema)
            kept, first, dropped = _as_written(state, schema), state.first_load_id, state.dropped
            written = replace(written, types=_changed(load.schema, schema))
        return replace(
            load,
            load_id=load_id,
            first_load_id=first,
            schema=schema,
            last_ingested=_now(),
            version=state.version + 1 if state else 1,
            segments=(*kept, written),
            dropped=dropped,
        )

    def write_upsert(
        self,
        layer: str,
        table: str,
        rows: DataFrame,
        touched: Collection[int],
        n_buckets: int,
        changes: int,
        previous: Load | None,
        replace_all: bool = False,
        **details,
    ) -> Load:
        """Commit the new rows (with ``_bucket``) of the touched buckets of a keyed table; all other buckets keep their files."""
        path = self.path(layer, table)
        if previous is None:
            self._clear_unlogged(path, "full")
        written, _ = self._write_segment(path, rows, [BUCKET], statistics=False)
        schema = T.StructType([f for f in rows.schema.fields if f.name != BUCKET])
        load_id = previous.load_id + 1 if previous else 1
        counts = self.spark.read.parquet(f"{path}/{SEGMENT}={written.name}").groupBy(BUCKET).count().collect() if written.rows else []
        written = replace(written, first=load_id, last=load_id, buckets={str(r[BUCKET]): r["count"] for r in counts})
        kept, gone = [], []
        for s in _as_written(previous, schema) if previous else ():
            left = {} if replace_all else {b: n for b, n in s.buckets.items() if int(b) not in touched}
            if left:
                kept.append(replace(s, buckets=left, rows=sum(left.values())))
            else:
                gone.append((s.name, _now()))
        load = Load(
            load_id=load_id,
            first_load_id=load_id,
            mode="upsert",
            rows=changes,
            schema=schema,
            partition_by=(BUCKET,),
            last_ingested=_now(),
            version=previous.version + 1 if previous else 1,
            segments=(*kept, written),
            dropped=(*(previous.dropped if previous else ()), *gone),
            n_buckets=n_buckets,
            **{"source_type": None, "source_name": None, "watermark_col": None, "last_watermark_value": None, **details},
        )
        load, expired = self._without_expired(load)
        if not self._commit(layer, table, load):
            raise ConcurrentLoad(f"{layer} table {table} has a new load")
        self._delete(path, load, expired)
        return load

    # -- segments ------------------------------------------------------------

    def compact(self, layer: str, table: str, load: Load | None = None, at_least: int = MERGE_AT_LEAST) -> Load | None:
        """Merge a table's latest small segments into one, if there are enough of them; gives the new state.

        Going back from the latest segment, each one is taken in that is at most twice as large as all later ones together: n loads of one size leave
        at most about ``at_least`` + log2(n) segments, and a row is rewritten that often at most. The rows keep the numbers of their loads. A commit in between
        wins over the merge.
        """
        load = load or self.latest(layer, table)
        if load is None or load.n_buckets:
            return None
        taken, size = 0, 0
        for n, segment in enumerate(reversed(load.segments), 1):
            if segment.bytes >= MERGE_BELOW_BYTES:
                break
            if n == 1 or segment.bytes <= 2 * size:
                taken = n
            size += segment.bytes
        if taken < max(2, at_least):
            return None
        old = load.segments[-taken:]
        path = self.path(layer, table)
        try:
            rows = self.read(layer, table, with_load_id=True, load=replace(load, segments=old))
            writer = rows.hint("rebalance", *load.partition_by).write.partitionBy(*load.partition_by) if load.partition_by else rows.write
            name = f"s{uuid.uuid4().hex}"
            writer.parquet(f"{path}/{SEGMENT}={name}")
        except Exception:  # the load itself is committed; the next one tries again
            log.exception("%s %s could not be compacted", layer, table)
            return None
        columns = merge_statistics([s.columns for s in old], {f.name: f.dataType for f in load.schema.fields})
        merged = Segment(name, old[0].first, old[-1].last, sum(s.rows for s in old), size_of(self.spark, f"{path}/{SEGMENT}={name}"), columns)
        gone = tuple((s.name, _now()) for s in old)
        state = replace(load, version=load.version + 1, segments=(*load.segments[:-taken], merged), dropped=(*load.dropped, *gone))
        state, expired = self._without_expired(state)
        if not self._commit(layer, table, state, "compaction"):
            delete_dir(self.spark, f"{path}/{SEGMENT}={name}")
            return None
        self._delete(path, state, expired)
        return state

    def _without_expired(self, load: Load) -> tuple[Load, list[str]]:
        """The load without the dropped segments that were kept long enough, and their names."""
        limit = _now() - self.keep
        expired = [name for name, since in load.dropped if since <= limit]
        return replace(load, dropped=tuple(d for d in load.dropped if d[1] > limit)), expired

    def _delete(self, path: str, load: Load, expired: list[str]) -> None:
        """Delete expired segments, and old folders that no manifest names."""
        named = {s.name for s in load.segments} | {name for name, _ in load.dropped}
        limit = (_now() - max(self.keep, ORPHAN_AGE)).timestamp()
        old = [n.partition("=")[2] for n, t in dir_times(self.spark, path).items() if n.startswith(SEGMENT + "=") and t < limit]
        for name in {*expired, *old} - named:
            delete_dir(self.spark, f"{path}/{SEGMENT}={name}")

    def _clear_unlogged(self, path: str, mode: str) -> None:
        """Files from before the load log: a full load replaces them, others must not mix in."""
        if all(n.startswith((SEGMENT + "=", "_SUCCESS", ".")) for n in children(self.spark, path)):
            return
        if mode != "full":
            raise ValueError(f"{path} holds files without a load log; load it in full mode first")
        delete_dir(self.spark, path)

    def overwrite(
        self, layer: str, table: str, df: DataFrame, partition_by: Sequence[str] = ()
    ) -> int:
        """Replace a table (Gold) by a full load; returns its row count.

        Until the commit readers see the former rows, also after a crash. The file count follows the
        plan's own partitions; adaptive execution merges the small ones.
        """
        return self.write_load(layer, table, df, "full", partition_by=partition_by).rows


def _places(path: str, segment: Segment, buckets: Collection[int] | None) -> list[str]:
    folder = f"{path}/{SEGMENT}={segment.name}"
    if segment.buckets is None:
        return [folder]
    return [f"{folder}/{BUCKET}={b}" for b in segment.buckets if buckets is None or int(b) in buckets]


def _changed(before: T.StructType, after: T.StructType) -> dict[str, str]:
    """The former types, by the column's name now, where they differ."""
    old = {f.name.lower(): f.dataType for f in before.fields}
    return {f.name: old[f.name.lower()].simpleString() for f in after.fields if old.get(f.name.lower(), f.dataType) != f.dataType}


def _as_written(state: Load, schema: T.StructType) -> tuple[Segment, ...]:
    """The segments of a table that takes ``schema``, with the types that they were written with."""
    changed = _changed(state.schema, schema)
    return tuple(replace(s, types={**changed, **s.types}) for s in state.segments) if changed else state.segments


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


def _manifest(load: Load, kind: str) -> str:
    values = {
        **{f.name: getattr(load, f.name) for f in _LOAD_SCHEMA.fields},
        "schema": load.schema.json(),
        "partition_by": json.dumps(load.partition_by),
        "last_ingested": load.last_ingested.isoformat() if load.last_ingested else None,
        "version": load.version,
        "segments": [asdict(s) for s in load.segments],
        "dropped": [(name, since.isoformat()) for name, since in load.dropped],
        "n_buckets": load.n_buckets,
        "kind": kind,
    }
    return json.dumps(values)


def _load_of(text: str) -> Load:
    stored = json.loads(text)
    values = {f: stored[f] for f in _LOAD_SCHEMA.names}
    values["schema"] = T.StructType.fromJson(json.loads(values["schema"]))
    values["partition_by"] = tuple(json.loads(values["partition_by"]))
    return Load(
        **values,
        last_ingested=dt.datetime.fromisoformat(stored["last_ingested"]),
        version=stored["version"],
        n_buckets=stored["n_buckets"],
        segments=tuple(Segment(**s) for s in stored["segments"]),
        dropped=tuple((name, dt.datetime.fromisoformat(since)) for name, since in stored["dropped"]),
    )


def watermark_text(df: DataFrame, column: str):
    """``max(column)`` as text that reads back the same in any session time zone."""
    high = F.max(F.col(column))
    if isinstance(df.schema[column].dataType, T.TimestampType):
        high = F.unix_micros(high)
    return high.cast("string")


def watermark_value(text: str, dtype: T.DataType):
    """The stored text as a typed literal, so the comparison is pushed to the source."""
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(F.lit(int(text)))
    return F.lit(text).cast(dtype)
