"""Key audits and coverage that follow tables load by load."""

import random

import pytest

from stratalake import Lake, load_bronze, upsert
from stratalake.operators.follow import changed_buckets, follow_keys, followed_key_audit, followed_key_coverage
from stratalake.operators.quality import key_audit, key_coverage


def _load(spark, lake, table, seed, mode="incremental", n=40, kind="int"):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, 1, *range(2, 30)]), i) for i in range(n)]
    load_bronze(lake, f"{table}_bronze", spark.createDataFrame(rows, f"k {kind}, v int"), "s", mode)


def _check(lake):
    fact, dim = lake.read("bronze", "fact_bronze"), lake.read("bronze", "dim_bronze")
    assert followed_key_audit(lake, "bronze", "fact_bronze", "k", 8).collect() == key_audit(fact, "k").collect()
    got = followed_key_coverage(lake, ("bronze", "fact_bronze", "k"), ("bronze", "dim_bronze", "k"), 8)
    assert got.collect() == key_coverage(fact, dim, "k").collect()


def test_answers_follow_both_tables(spark, lake):
    _load(spark, lake, "fact", 1)
    _load(spark, lake, "dim", 2, n=6, kind="long")
    _check(lake)
    _check(lake)  # nothing new
    for seed, table in ((3, "fact"), (4, "dim"), (5, "fact")):
        _load(spark, lake, table, seed, n=9, kind="int" if table == "fact" else "long")
        _check(lake)
    _load(spark, lake, "fact", 6, mode="full", n=5)  # replaced: what was counted goes
    _check(lake)
    _load(spark, lake, "dim", 7, mode="full", n=3, kind="long")
    _check(lake)


def test_only_the_new_load_and_touched_buckets_are_read(spark, lake, monkeypatch):
    _load(spark, lake, "fact", 1, n=200)
    _load(spark, lake, "dim", 2, n=200)
    pair = ("bronze", "fact_bronze", "k"), ("bronze", "dim_bronze", "k")
    followed_key_coverage(lake, *pair, 16)
    before = lake.latest("gold", "bronze_fact_bronze_k_keys")
    load_bronze(lake, "fact_bronze", spark.createDataFrame([(7, 1), (7, 2), (500, 3)], "k int, v int"), "s", "incremental")
    files, read = [], Lake.read

    def noted(self, layer, table, *args, **more):
        df = read(self, layer, table, *args, **more)
        files.extend((table, f) for f in df.inputFiles())
        return df

    monkeypatch.setattr(Lake, "read", noted)
    row = followed_key_coverage(lake, *pair, 16).first()
    monkeypatch.undo()
    touched = changed_buckets(lake.latest("gold", "bronze_fact_bronze_k_keys"), before.load_id)
    assert 1 <= len(touched) <= 2
    new = lake.latest("bronze", "fact_bronze").segments[-1].name
    assert {f for t, f in files if t == "fact_bronze"} and all(new in f for t, f in files if t == "fact_bronze")
    assert not [f for t, f in files if t == "dim_bronze"]
    states = [f for t, f in files if t.endswith("_keys")]
    assert states and all(any(f"_bucket={b}/" in f for b in touched) for f in states)
    assert tuple(row) == tuple(key_coverage(lake.read("bronze", "fact_bronze"), lake.read("bronze", "dim_bronze"), "k").first())


def test_empty_keyed_and_odd_tables(spark, lake):
    for table in ("fact", "dim"):
        _load(spark, lake, table, 1, n=0)
    _check(lake)
    _load(spark, lake, "fact", 1, n=10)
    _check(lake)
    rows = "k int, at int"
    upsert(lake, "silver", "t", spark.createDataFrame([(1, 1), (2, 1)], rows), "k", "at", n_buckets=4)
    assert followed_key_audit(lake, "silver", "t", "k").first().rows == 2
    upsert(lake, "silver", "t", spark.createDataFrame([(2, 2), (3, 1)], rows), "k", "at")
    assert tuple(followed_key_audit(lake, "silver", "t", "k").first()) == (3, 0, 3, 0, 0)
    load_bronze(lake, "text_bronze", spark.createDataFrame([("1", 1)], "k string, v int"), "s")
    with pytest.raises(ValueError, match="different types"):
        followed_key_coverage(lake, ("bronze", "fact_bronze", "k"), ("bronze", "text_bronze", "k"))
    with pytest.raises(ValueError, match="no loads"):
        follow_keys(lake, "bronze", "nothing_bronze", "k")
