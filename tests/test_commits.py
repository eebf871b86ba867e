"""Concurrent loads, kept segments, compaction, statistics in manifests."""

import datetime as dt
import gzip
import json
import math
import threading

import pytest
from pyspark.sql import functions as F

from stratalake import Lake, SourceSpec, build_silver, load_bronze, run_layers
from stratalake.operators import catalog as C
from stratalake.sources import lake as lake_module
from stratalake.sources import storage
from stratalake.sources.lake import LOAD_ID, ConcurrentLoad
from stratalake.streaming.files import ingest_new_files


def _keys(lake, layer="bronze", table="t_bronze", key="k"):
    return sorted(r[0] for r in lake.read(layer, table).select(key).collect())


# -- writers --------------------------------------------------------------------------


def test_a_manifest_is_created_once(spark, tmp_path):
    path, won = str(tmp_path / "log" / "1.json"), []
    threads = [threading.Thread(target=lambda i=i: won.append((storage.create_new(spark, path, f"text {i}" * 1000), i))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (winner,) = [i for done, i in won if done]
    assert storage.read_text(spark, path) == f"text {winner}" * 1000
    assert [p.name for p in (tmp_path / "log").iterdir()] == ["1.json"]


@pytest.mark.parametrize("watermark", [None, "k"])
def test_a_load_that_comes_late_is_put_on_top(spark, lake, monkeypatch, watermark):
    """Another writer commits between this one's look at the table and its commit."""
    load_bronze(lake, "t_bronze", spark.range(0, 10).toDF("k"), "s", "incremental", watermark_col=watermark)
    other, commit, done = Lake(spark, lake.root), lake._commit, []

    def late(layer, table, load, *more):
        if not done:
            done.append(1)
            load_bronze(other, "t_bronze", spark.range(0, 15).toDF("k").where("k >= 10"), "s", "incremental", watermark_col=watermark)
        return commit(layer, table, load, *more)

    monkeypatch.setattr(lake, "_commit", late)
    source = spark.range(0, 20).toDF("k") if watermark else spark.range(15, 20).toDF("k")
    load = load_bronze(lake, "t_bronze", source, "s", "incremental", watermark_col=watermark)
    assert load.load_id == 3 and load.rows == 5
    assert _keys(lake) == list(range(20))  # nothing lost, nothing twice
    assert [r.load_id for r in lake.load_log().orderBy("load_id").collect()] == [1, 2, 3]


def test_writers_at_the_same_time_lose_no_rows(spark, lake):
    """Twelve loads of four threads into a table that does not exist yet, appending and with columns of their own."""
    lakes = [Lake(spark, lake.root) for _ in range(4)]
    errors = []

    def run(i):
        try:
            for j in range(3):
                n = 10 * (3 * i + j)
                load_bronze(lakes[i], "t_bronze", spark.range(n, n + 10, 1, 1).select(F.col("id").alias("k"), F.lit(i).alias(f"c{i}")), "s", "incremental")
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert errors == []
    assert _keys(lake) == list(range(120))
    state = lake.latest("bronze", "t_bronze")
    assert state.load_id == 12 and state.table_rows == 120
    by_id = lake.read("bronze", "t_bronze", with_load_id=True).groupBy(LOAD_ID).count().collect()
    assert {r[LOAD_ID]: r["count"] for r in by_id} == dict.fromkeys(range(1, 13), 10)
    assert {c for c in lake.read("bronze", "t_bronze").columns if c[0] == "c"} == {"c0", "c1", "c2", "c3"}


def test_a_late_load_may_widen_or_be_refused(spark, lake, monkeypatch):
    load_bronze(lake, "t_bronze", spark.createDataFrame([(1,)], "k int"), "s", "incremental")
    commit = lake._commit

    def after(other):
        done = []

        def late(layer, table, load, *more):
            if not done:
                done.append(1)
                load_bronze(Lake(spark, lake.root), "t_bronze", other, "s", "incremental")
            return commit(layer, table, load, *more)

        return late

    monkeypatch.setattr(lake, "_commit", after(spark.createDataFrame([(2,)], "k long")))
    load_bronze(lake, "t_bronze", spark.createDataFrame([(3,)], "k int"), "s", "incremental")
    assert dict(lake.read("bronze", "t_bronze").dtypes)["k"] == "bigint" and _keys(lake) == [1, 2, 3]
    monkeypatch.setattr(lake, "_commit", after(spark.createDataFrame([(4, "x")], "k long, v string")))
    with pytest.raises(ValueError, match="types differ: v"):
        load_bronze(lake, "t_bronze", spark.createDataFrame([(5, 1.0)], "k int, v double"), "s", "incremental")
    assert _keys(lake) == [1, 2, 3, 4]


def test_silver_that_comes_late_takes_each_load_once(spark, lake, monkeypatch):
    for lo, hi in ((0, 5), (5, 9)):
        load_bronze(lake, "t_bronze", spark.range(lo, hi).toDF("row_id"), "s", "incremental")
        if lo == 0:
            build_silver(lake, "t_bronze", incremental=True)
    commit, done = lake._commit, []

    def late(*args):
        if not done:
            done.append(1)
            build_silver(Lake(spark, lake.root), "t_bronze", incremental=True)
        return commit(*args)

    monkeypatch.setattr(lake, "_commit", late)
    build_silver(lake, "t_bronze", incremental=True)
    assert _keys(lake, "silver", "t_silver", "row_id") == list(range(9))


def test_gives_up_after_some_attempts():
    calls = []

    def always_late():
        calls.append(1)
        raise ConcurrentLoad("late")

    with pytest.raises(ConcurrentLoad):
        lake_module.again_if_late(always_late, 3)
    assert len(calls) == 3


# -- readers --------------------------------------------------------------------------


def test_a_reader_opened_before_a_rebuild_finishes(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.overwrite("gold", "t", spark.range(100))
    opened = lake.read("gold", "t")
    for _ in range(3):
        lake.overwrite("gold", "t", spark.range(7).toDF("other"))
    assert opened.count() == 100 and opened.agg(F.max("id")).first()[0] == 99
    state = lake.latest("gold", "t")
    assert len(state.segments) == 1 and len(state.dropped) == 3


def test_replaced_segments_go_by_age(spark, tmp_path, monkeypatch):
    lake, now = Lake(spark, str(tmp_path), keep=dt.timedelta(hours=2)), dt.datetime.now(dt.UTC)
    (tmp_path / "gold" / "t" / "_segment=lost").mkdir(parents=True)  # of a load that failed
    for hours in (0, 1, 4, 30):
        monkeypatch.setattr(lake_module, "_now", lambda h=hours: now + dt.timedelta(hours=h))
        lake.overwrite("gold", "t", spark.range(hours + 1))
        folders = {p.name for p in (tmp_path / "gold" / "t").iterdir()}
        state = lake.latest("gold", "t")
        assert folders - {"_segment=lost"} == {f"_segment={s.name}" for s in state.segments} | {f"_segment={n}" for n, _ in state.dropped}
        assert len(state.dropped) == {0: 0, 1: 1, 4: 1, 30: 1}[hours]
        assert ("_segment=lost" in folders) == (hours < 24)
    assert lake.read("gold", "t").count() == 31


# -- compaction -----------------------------------------------------------------------


def test_many_small_loads_leave_few_segments(spark, tmp_path):
    """Silver follows every few loads and takes new ones only, also out of merged segments."""
    lake, n, silver_rows = Lake(spark, str(tmp_path), keep=dt.timedelta(0)), 60, 0
    for i in range(n):
        load_bronze(lake, "t_bronze", spark.range(3 * i, 3 * i + 3, 1, 1).toDF("row_id"), "s", "incremental", watermark_col="row_id")
        if i % 7 == 6:
            load = build_silver(lake, "t_bronze", incremental=True)
            assert (load.rows, load.mode) == (21, "incremental" if i > 6 else "full")
            silver_rows += load.rows
    state = lake.latest("bronze", "t_bronze")
    assert len(state.segments) <= 8 + math.log2(n) and state.load_id == n and state.table_rows == 3 * n
    assert len(list((tmp_path / "bronze" / "t_bronze").glob("_segment=*"))) == len(state.segments)
    assert _keys(lake, key="row_id") == list(range(3 * n))
    ids = {r.row_id: r[LOAD_ID] for r in lake.read("bronze", "t_bronze", with_load_id=True).collect()}
    assert ids == {k: k // 3 + 1 for k in range(3 * n)}
    for after in (0, 17, n - 3, n):
        assert lake.read("bronze", "t_bronze", after_load=after).count() == 3 * (n - after)
    assert _keys(lake, "silver", "t_silver", "row_id") == list(range(silver_rows))
    assert lake.load_log().count() == n


def test_compaction_of_partitioned_and_widened_tables(spark, lake):
    for i in range(3):
        rows = spark.createDataFrame([(i, f"p{i % 2}", 1.5)], "k int, p string, v float")
        load_bronze(lake, "t_bronze", rows, "s", "incremental", partition_by=["p"])
    load_bronze(lake, "t_bronze", spark.createDataFrame([(3, "p0", 2.5, 9)], "k long, p string, v double, w int"), "s", "incremental")
    before = sorted(map(tuple, lake.read("bronze", "t_bronze").select("k", "p", "v", "w").collect()))
    assert lake.compact("bronze", "t_bronze", at_least=5) is None
    assert len(lake.compact("bronze", "t_bronze", at_least=2).segments) == 1
    after = lake.read("bronze", "t_bronze")
    assert sorted(map(tuple, after.select("k", "p", "v", "w").collect())) == before
    assert dict(after.dtypes)["k"] == "bigint" and after.where("p = 'p1'").count() == 1


def test_a_commit_wins_over_a_merge(spark, lake, monkeypatch):
    for i in range(4):
        load_bronze(lake, "t_bronze", spark.range(i, i + 1).toDF("k"), "s", "incremental")
    commit, done = lake._commit, []

    def late(layer, table, load, *more):
        if not done:
            done.append(1)
            load_bronze(Lake(spark, lake.root), "t_bronze", spark.range(4, 5).toDF("k"), "s", "incremental")
        return commit(layer, table, load, *more)

    monkeypatch.setattr(lake, "_commit", late)
    assert lake.compact("bronze", "t_bronze", at_least=2) is None
    assert _keys(lake) == list(range(5))


# -- statistics -----------------------------------------------------------------------


def test_catalog_opens_one_small_file_for_each_table(spark, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path), statistics=["k"])
    for t in ("a", "b", "c"):
        for i in range(4):
            load_bronze(lake, f"{t}_bronze", spark.range(10 * i, 10 * i + 10).toDF("k"), "s", "incremental")
    opened = []
    monkeypatch.setattr(lake_module, "read_text", lambda s, path: opened.append(path) or storage.read_text(s, path))
    monkeypatch.setattr(lake, "read", lambda *a, **k: pytest.fail("a table was opened"))
    rows = {r.table_name: (r["rows"], r.columns) for r in C.layer_catalog(lake).collect()}
    assert rows == {f"{t}_bronze": (40, 4) for t in "abc"}
    assert len(opened) == 3 and all(p.endswith("000000000004.json") for p in opened)
    assert {r.table_name: r.load_id for r in lake.load_state().collect()} == {f"{t}_bronze": 4 for t in "abc"}
    assert len(opened) == 6
    assert {(r.table_name, r.column_name, r.max) for r in C.table_statistics(lake).collect()} == {(f"{t}_bronze", "k", "39") for t in "abc"}
    assert len(opened) == 9


def test_statistics_are_those_of_the_rows(spark, tmp_path):
    lake = Lake(spark, str(tmp_path), statistics=True)
    schema = "i int, l long, d double, m decimal(12,2), s string, b boolean, t timestamp, n timestamp_ntz, y date, a array<int>"
    t = dt.datetime(2024, 5, 6, 7, 8, 9, 123456)
    first = [(5, None, float("nan"), None, "x" * 100, True, t, t, t.date(), [1]), (-5, 10**12, 2.5, None, "Ä", False, t, t, t.date(), None)]
    second = [(None, 10**12, -1.0, None, "", None, None, t + dt.timedelta(days=1), None, None), (40, 9, 1e300, None, "zz", None, None, None, dt.date(1999, 1, 1), None)]
    for rows in (first, second):
        lake.write_load("gold", "t", spark.createDataFrame(rows, schema), "incremental")
    got = {r.column_name: (r["rows"], r.non_null, r.min, r.max, r.distinct_estimate) for r in C.table_statistics(lake).collect()}
    day = str(t + dt.timedelta(days=1))
    assert got == {
        "i": (4, 3, "-5", "40", 3), "l": (4, 3, "9", str(10**12), 2), "d": (4, 4, "-1.0", "1.0E300", 3), "m": (4, 0, None, None, 0), "s": (4, 4, "", "Ä", 4),
        "b": (4, 2, "false", "true", 2), "t": (4, 2, str(t), str(t), 1), "n": (4, 3, str(t), day, 2), "y": (4, 3, "1999-01-01", "2024-05-06", 2),
    }


def test_colliding_views_are_refused(spark, lake):
    lake.overwrite("gold", "a-b", spark.range(1))
    lake.overwrite("gold", "a_b", spark.range(2))
    with pytest.raises(ValueError, match="a_b"):
        C.run_sql(lake, "SELECT * FROM a_b")
    lake.overwrite("silver", "same", spark.range(1))
    lake.overwrite("gold", "same", spark.range(2))
    with pytest.raises(ValueError, match="silver/same"):
        C.register_views(lake, layers=("silver", "gold"), text="same")


# -- growth of types, options, headers -------------------------------------------------


def test_types_grow_without_loss(spark, lake):
    day, time = dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4)
    load_bronze(lake, "t_bronze", spark.createDataFrame([(1, 7, 2**62, day, day)], "k int, i int, l long, y date, z date"), "s", "incremental")
    grown = spark.createDataFrame([(2, 8, 1, time, time)], "k int, i int, l int, y timestamp, z timestamp_ntz")
    load_bronze(lake, "t_bronze", grown.selectExpr("k", "cast(i + 0.25 as decimal(6,2)) i", "cast(l as decimal(4,1)) l", "y", "z"), "s", "incremental")
    load_bronze(lake, "t_bronze", spark.createDataFrame([(3, 9, 5, day, day)], "k int, i int, l long, y date, z date"), "s", "incremental")
    df = lake.read("bronze", "t_bronze").select("k", "i", "l", "y", "z")
    assert dict(df.dtypes) == {"k": "int", "i": "decimal(12,2)", "l": "decimal(20,1)", "y": "timestamp", "z": "timestamp_ntz"}
    midnight = dt.datetime(2024, 1, 2)
    rows = {r.k: (float(r.i), int(r.l), r.y, r.z) for r in df.collect()}
    assert rows == {1: (7.0, 2**62, midnight, midnight), 2: (8.25, 1, time, time), 3: (9.0, 5, midnight, midnight)}


def test_reader_options_hold_in_increments(spark, tmp_path):
    """A JSON array over several lines has the same rows in both modes; unknown options are refused."""
    (tmp_path / "list.json").write_text('[\n {"id": 1},\n {"id": 2} // two\n]\n')
    for mode in ("full", "incremental"):
        lake = Lake(spark, str(tmp_path / mode))
        spec = SourceSpec(str(tmp_path / "list.json"), mode, pk="id", options={"multi_line": True, "allow_comments": True})
        assert {(r.layer, r.status, r["rows"]) for r in run_layers(lake, [spec]).collect()} == {("bronze", "success", 2), ("silver", "success", 2)}
    with pytest.raises(ValueError, match="no such options"):
        ingest_new_files(lake, str(tmp_path), "u_bronze", fmt="json", quote="'")


def test_headers_are_read_from_the_first_block(spark, tmp_path, lake, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("/ note\n\nid,v\n" + "1,x\n" * 200_000)
    (folder / "b c.csv").write_text("v,id\r\ny,2\r\n")
    with gzip.open(folder / "d.csv.gz", "wt") as out:
        out.write("id,v\n" + "3,z\n" * 1000)
    (folder / "empty.csv").write_text("")
    lines = []
    from stratalake.streaming import files

    monkeypatch.setattr(files, "first_lines", lambda s, p: (lines.append(line) or line for line in storage.first_lines(s, p)))
    assert ingest_new_files(lake, str(folder), "t_bronze", fmt="csv") == 201_001
    assert len(lines) == 5  # note, blank and header; header; header
    rows = {(r.id, r.v): r["count"] for r in lake.read("bronze", "t_bronze").groupBy("id", "v").count().collect()}
    assert rows == {(1, "x"): 200_000, (2, "y"): 1, (3, "z"): 1000}


def test_manifest_is_plain_json(spark, lake, tmp_path):
    load = load_bronze(lake, "t_bronze", spark.range(3).toDF("k"), "s", "incremental", watermark_col="k")
    (path,) = (tmp_path / "lake" / "_loads" / "layer=bronze" / "table_name=t_bronze").glob("*.json")
    stored = json.loads(path.read_text())
    assert (stored["version"], stored["rows"], stored["last_watermark_value"], stored["kind"]) == (1, 3, "2", "load")
    assert lake.latest("bronze", "t_bronze") == load and len(stored["segments"]) == 1
