"""Loads whose files, columns or watermark change, and loads that fail half way."""

import gzip

import pytest
from pyspark.sql import functions as F

from stratalake import Lake, SourceSpec, build_silver, ingest_new_files, load_bronze, run_layers
from stratalake.operators.bronze import SchemaConflict, data_columns


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


def _rows(lake, table="t_bronze"):
    return sorted(map(tuple, data_columns(lake.read("bronze", table)).collect()), key=str)


def test_csv_columns_are_read_by_name_and_grow(spark, tmp_path, lake):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("/ note\nid,price,qty\n1,10,1\n2,20,2\n")
    assert ingest_new_files(lake, str(folder), "t_bronze", fmt="csv") == 2
    (folder / "b [x].csv").write_text("id,qty,price,extra\n3,3,30.5,x\n")
    (folder / "c.csv").write_text("qty,id\n4,4\n")
    (folder / "d.csv").write_text("id,price,qty\n")
    assert ingest_new_files(lake, str(folder), "t_bronze", fmt="csv") == 2
    assert _rows(lake) == [(1, 10.0, 1, None), (2, 20.0, 2, None), (3, 30.5, 3, "x"), (4, None, 4, None)]
    assert ingest_new_files(lake, str(folder), "t_bronze", fmt="csv") == 0
    state = lake.latest("bronze", "t_bronze")
    assert (state.load_id, state.rows) == (2, 2)


def test_parquet_columns_grow(spark, tmp_path, lake):
    folder = str(tmp_path / "in")
    spark.range(2).write.mode("append").parquet(folder)
    ingest_new_files(lake, folder, "t_bronze")
    spark.range(2, 3).withColumn("extra", F.lit("x")).write.mode("append").parquet(folder)
    assert ingest_new_files(lake, folder, "t_bronze") == 1
    assert _rows(lake) == [(0, None), (1, None), (2, "x")]


def test_a_file_named_twice_by_the_stream_is_taken_once(spark, tmp_path, lake):
    """Beside a name with pattern characters Spark lists the others again."""
    folder = tmp_path / "in"
    for i, name in enumerate(("a [x]", "b", "c")):
        spark.range(i, i + 1, 1, 1).write.parquet(str(tmp_path / name))
        (part,) = (tmp_path / name).glob("*.parquet")
        folder.mkdir(exist_ok=True)
        part.rename(folder / f"{name}.parquet")
    assert ingest_new_files(lake, str(folder), "t_bronze") == 3
    assert _rows(lake) == [(0,), (1,), (2,)]


def test_streamed_count_covers_all_batches(spark, tmp_path, lake):
    folder = str(tmp_path / "in")
    spark.range(0, 60, 1, 6).write.parquet(folder)
    assert ingest_new_files(lake, folder, "t_bronze", max_files_per_trigger=1) == 60
    assert lake.latest("bronze", "t_bronze").batch == 5


def test_batch_that_fails_before_or_after_its_commit_adds_nothing_twice(spark, tmp_path, lake, monkeypatch):
    folder = str(tmp_path / "in")
    spark.range(3).write.parquet(folder)
    commit = Lake._commit

    def fails_before(self, *args):
        raise OSError("lost")

    def fails_after(self, *args):
        commit(self, *args)
        raise OSError("lost")

    for broken, seen in ((fails_before, None), (fails_after, 3)):
        monkeypatch.setattr(Lake, "_commit", broken)
        with pytest.raises(Exception, match="lost"):
            ingest_new_files(lake, folder, "t_bronze")
        load = lake.latest("bronze", "t_bronze")
        assert (load and load.rows) == seen
    monkeypatch.setattr(Lake, "_commit", commit)
    assert ingest_new_files(lake, folder, "t_bronze") == 0
    assert lake.read("bronze", "t_bronze").count() == 3


def test_silver_takes_only_new_files(spark, tmp_path, lake):
    folder = str(tmp_path / "in")
    for lo, hi in ((0, 3), (3, 5)):
        spark.range(lo, hi).toDF("row_id").write.mode("append").parquet(folder)
        ingest_new_files(lake, folder, "t_bronze")
        assert build_silver(lake, "t_bronze", incremental=True).rows == hi - lo
    assert lake.read("silver", "t_silver").count() == 5


def test_no_watermark_is_carried_to_another_column(spark, lake):
    load_bronze(lake, "t_bronze", spark.range(1, 201).toDF("id"), "s", "incremental", watermark_col="id")
    new = spark.createDataFrame([(201, 5), (202, 6)], "id long, seq long")
    load = load_bronze(lake, "t_bronze", new, "s", "incremental", watermark_col="seq")
    assert (load.rows, load.last_watermark_value) == (2, "6")
    empty = load_bronze(lake, "t_bronze", new.where("id < 0").withColumn("at", F.lit(1)), "s", "incremental", watermark_col="at")
    assert empty.last_watermark_value is None


def test_silver_rebuild_that_fails_leaves_the_old_rows(spark, lake, monkeypatch):
    for lo, hi in ((0, 3), (3, 5)):
        load_bronze(lake, "t_bronze", spark.range(lo, hi).toDF("row_id"), "s", "incremental")
        build_silver(lake, "t_bronze", incremental=True)

    def fails(self, *args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Lake, "_commit", fails)
        with pytest.raises(OSError):
            build_silver(lake, "t_bronze")
    assert lake.read("silver", "t_silver").count() == 5
    assert build_silver(lake, "t_bronze").rows == 5
    assert lake.read("silver", "t_silver").count() == 5
    load_bronze(lake, "t_bronze", spark.range(5, 6).toDF("row_id"), "s", "incremental")
    assert build_silver(lake, "t_bronze", incremental=True).rows == 1
    assert lake.read("silver", "t_silver").count() == 6


def test_types_widen_and_empty_batches_fit(spark, lake):
    load_bronze(lake, "t_bronze", spark.createDataFrame([(1, 2)], "id int, x int"), "s", "incremental")
    load_bronze(lake, "t_bronze", spark.createDataFrame([(2, 2.5)], "id int, x double"), "s", "incremental")
    load_bronze(lake, "t_bronze", spark.createDataFrame([], "id string, x string"), "s", "incremental")
    assert _rows(lake) == [(1, 2.0), (2, 2.5)]
    with pytest.raises(SchemaConflict):
        load_bronze(lake, "t_bronze", spark.createDataFrame([("a",)], "id string"), "s", "incremental")


def test_options_suffixes_and_unknown_formats_in_runs(spark, tmp_path, lake):
    (tmp_path / "paths.csv").write_text("p,id\n/a,1\nb,2\n")
    (tmp_path / "things.dat").write_text("id,v\n1,x\n")
    with gzip.open(tmp_path / "packed.json.gz", "wt") as out:
        out.write('{"id": 1}\n{"id": 2}\n')
    for mode in ("full", "incremental"):
        own = Lake(spark, str(tmp_path / mode))
        specs = [
            SourceSpec(str(tmp_path / "paths.csv"), mode, options={"comment": None}, pk="id", name="paths_bronze"),
            SourceSpec(str(tmp_path / "things.dat"), mode, pk="id"),
            SourceSpec(str(tmp_path / "packed.json.gz"), mode, pk="id", name="packed_bronze"),
        ]
        report = {(r.layer, r.table_name): (r.status, r["rows"]) for r in run_layers(own, specs).collect()}
        assert report[("bronze", "paths_bronze")] == ("success", 2)
        assert report[("bronze", "things_bronze")] == ("success", 1)
        assert report[("bronze", "packed_bronze")] == ("success", 2)


def test_csv_folder_of_differing_headers_is_refused(spark, tmp_path, lake):
    folder = tmp_path / "in.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("id,price,qty\n1,10,1\n")
    (folder / "b.csv").write_text("id,qty,price\n3,3,30\n")
    report = run_layers(lake, [SourceSpec(str(folder))]).collect()
    assert [r.status for r in report if r.layer == "bronze"] == ["failed"]


def test_bad_plan_is_a_failed_row_and_equal_names_are_refused(spark, tmp_path, lake):
    (tmp_path / "orders.csv").write_text("order_id\n1\n")
    spec = SourceSpec(str(tmp_path / "orders.csv"))
    report = {(r.layer, r.table_name): r.status for r in run_layers(lake, [spec], [{"destination": "broken"}]).collect()}
    assert report == {("bronze", "orders_bronze"): "success", ("silver", "orders_silver"): "success", ("gold", "broken"): "failed"}
    with pytest.raises(ValueError, match="same bronze table"):
        run_layers(lake, [spec, spec])
