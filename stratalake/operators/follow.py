"""Key audits and key coverage that follow tables load by load.

Beside a followed table stands the number of rows of each of its keys, in hash buckets; a new load is counted and added to the buckets that its keys fall
into. The answers are kept per bucket, so that only buckets that changed are counted again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.functions.schema import is_whole
from stratalake.operators.upsert import BUCKETS
from stratalake.sources.lake import BUCKET, Lake, Load, again_if_late

_AUDIT = ("rows", "null_keys", "distinct_keys", "duplicate_keys", "surplus_rows")
_COVERAGE = ("rows_with_key", "matched_rows", "orphan_rows", "orphan_keys")


def _bucket_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def follow_keys(lake: Lake, layer: str, table: str, key: str, n_buckets: int = BUCKETS) -> Load:
    """Count the keys of the table's new loads into its key state and give that state, a table of (k, n), k the key as text.

    Only loads that came since the last time are read; a table that was replaced or is kept by key is counted anew.
    """
    return again_if_late(lambda: _follow_once(lake, layer, table, key, n_buckets))


def _follow_once(lake: Lake, layer: str, table: str, key: str, n_buckets: int) -> Load:
    name = f"{layer}_{table}_{key}_keys"
    source, state = lake.latest(layer, table), lake.latest("gold", name)
    if source is None:
        raise ValueError(f"no loads of {layer} table {table}")
    covered = state.source_load_id if state else None
    add = covered is not None and covered >= source.first_load_id
    if add and covered == source.load_id:
        return state
    n = state.n_buckets if add else n_buckets
    rows = lake.read(layer, table, covered if add else None, load=source)
    counts = rows.groupBy(F.col(f"`{key}`").cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    touched = {r[0] for r in counts.select(_bucket_of(F.col("k"), n)).distinct().collect()}  # a row for each bucket at most
    if add:
        counts = counts.unionByName(lake.read("gold", name, load=state, buckets=touched)).groupBy("k").agg(F.sum("n").alias("n"))
    made_of = json.dumps({"table": f"{layer}/{table}", "first": source.first_load_id})
    return lake.write_upsert(
        *("gold", name, counts.withColumn(BUCKET, _bucket_of(F.col("k"), n)), touched, n, sum(s.rows for s in source.segments if not add or s.last > covered), state),
        replace_all=not add,
        source_type="keys",
        source_name=made_of,
        source_load_id=source.load_id,
    )


def changed_buckets(state: Load, since: int) -> set[int]:
    """The buckets that loads after ``since`` have written."""
    return {int(b) for s in state.segments if s.last > since for b in s.buckets}


def _per_bucket(lake: Lake, name: str, states: list[Load], answer: Callable[[Collection[int] | None], DataFrame]) -> DataFrame:
    """Answers by bucket as of the states: those of changed buckets made anew by ``answer``, the others as they were."""
    done = lake.latest("gold", name)
    made_of = {"states": [s.source_name for s in states], "loads": [s.load_id for s in states], "buckets": [s.n_buckets for s in states]}
    before = json.loads(done.source_name) if done else {}
    same = before.get("states") == made_of["states"] and before.get("buckets") == made_of["buckets"]
    changed = set().union(*(changed_buckets(s, since) for s, since in zip(states, before["loads"], strict=True))) if same else None
    if changed == set():
        return lake.read("gold", name, load=done)
    rows = answer(changed)
    if changed is not None:
        rows = rows.unionByName(lake.read("gold", name, load=done).where(~F.col("bucket").isin(list(changed))))
    return lake.read("gold", name, load=lake.write_load("gold", name, rows, "full", source_type="answers", source_name=json.dumps(made_of)))


def followed_key_audit(lake: Lake, layer: str, table: str, key: str, n_buckets: int = BUCKETS) -> DataFrame:
    """The row of ``key_audit`` for a layer table, from its new loads and the buckets that they touch."""
    state = follow_keys(lake, layer, table, key, n_buckets)
    known, n = F.col("k").isNotNull(), F.col("n")

    def answer(buckets: Collection[int] | None) -> DataFrame:
        counts = lake.read("gold", f"{layer}_{table}_{key}_keys", load=state, buckets=buckets)
        return counts.groupBy(_bucket_of(F.col("k"), state.n_buckets).alias("bucket")).agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(~known, n)), F.lit(0)).alias("null_keys"),
            F.count_if(known).alias("distinct_keys"),
            F.count_if(known & (n > 1)).alias("duplicate_keys"),
            F.coalesce(F.sum(F.when(known, n - 1)), F.lit(0)).alias("surplus_rows"),
        )

    buckets = _per_bucket(lake, f"{layer}_{table}_{key}_audit", [state], answer)
    return buckets.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _AUDIT])


def followed_key_coverage(lake: Lake, fact: tuple[str, str, str], dim: tuple[str, str, str], n_buckets: int = BUCKETS) -> DataFrame:
    """The row of ``key_coverage`` for two (layer, table, key), from new loads of either and the buckets that they touch."""
    types = [lake.latest(layer, table).schema[key].dataType for layer, table, key in (fact, dim)]
    if types[0] != types[1] and not all(map(is_whole, types)):
        raise ValueError(f"keys of different types: {types[0].simpleString()} and {types[1].simpleString()}")
    states = [follow_keys(lake, *side, n_buckets) for side in (fact, dim)]
    if states[0].n_buckets != states[1].n_buckets:
        raise ValueError(f"the keys were counted into {states[0].n_buckets} and {states[1].n_buckets} buckets")
    found = F.coalesce("found", F.lit(False))

    def answer(buckets: Collection[int] | None) -> DataFrame:
        counts, known = (lake.read("gold", "_".join((*side, "keys")), load=state, buckets=buckets).where("k IS NOT NULL") for side, state in zip((fact, dim), states, strict=True))
        joined = counts.join(known.select("k", F.lit(True).alias("found")), "k", "left")
        return joined.groupBy(_bucket_of(F.col("k"), states[0].n_buckets).alias("bucket")).agg(
            F.sum("n").alias("rows_with_key"),
            F.coalesce(F.sum(F.when(found, F.col("n"))), F.lit(0)).alias("matched_rows"),
            F.coalesce(F.sum(F.when(~found, F.col("n"))), F.lit(0)).alias("orphan_rows"),
            F.count_if(~found).alias("orphan_keys"),
        )

    buckets = _per_bucket(lake, "_".join((*fact, "in", *dim[1:])), states, answer)
    return buckets.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COVERAGE])
