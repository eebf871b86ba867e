import pytest
from fixtures import LEAVE_CSV, TICKETS_JSON, employees
from pyspark.sql import functions as F

from stratalake import JdbcTable, Lake, SourceSpec, build_silver, ingest_new_files, load_bronze, run_layers
from stratalake.operators import catalog as C
from stratalake.operators import quality as Q

# -- checks -------------------------------------------------------------------------


@pytest.fixture
def keyed(spark):
    """A third of the rows share a key; some have none; some keys have no dimension row."""
    key = F.expr("CASE WHEN id < 100 THEN 1 WHEN id < 110 THEN NULL ELSE id % 40 END")
    facts = spark.range(0, 300, 1, 3).select(key.alias("k"), "id")
    dims = spark.range(0, 30, 1, 1).toDF("key")
    return facts, dims.unionByName(dims.limit(5))


def test_key_audit(keyed, spark):
    facts, _ = keyed
    per_key = facts.where("k is not null").groupBy("k").count().collect()
    got = Q.key_audit(facts, "k").collect()[0]
    assert (got["rows"], got.null_keys, got.distinct_keys) == (300, 10, len(per_key))
    assert got.duplicate_keys == sum(r["count"] > 1 for r in per_key)
    assert got.surplus_rows == 290 - len(per_key)
    assert tuple(Q.key_audit(spark.range(0), "id").collect()[0]) == (0, 0, 0, 0, 0)


def test_coverage_adds_up(keyed):
    facts, dims = keyed
    got = Q.key_coverage(facts, dims, "k", "key").collect()[0]
    lost = Q.orphans(facts, dims, "k", "key")
    assert got.rows_with_key == 290 == got.matched_rows + got.orphan_rows
    assert got.orphan_rows == lost.count() == facts.where("k >= 30").count()
    assert got.orphan_keys == lost.select("k").distinct().count() == 10


def test_orphans_of_the_samples(spark, tmp_path, lake):
    path = tmp_path / "leave_logs.csv"
    path.write_text(LEAVE_CSV)
    from stratalake import read_source

    lost = Q.orphans(read_source(spark, str(path)), employees(spark), "employee_id").collect()
    assert [r.employee_id for r in lost] == [77]


def test_bad_records(spark, tmp_path, lake):
    path = tmp_path / "ticket_events.json"
    path.write_text(TICKETS_JSON)
    from stratalake import read_source

    load_bronze(lake, "t_bronze", read_source(spark, str(path)), "t")
    good, bad = Q.split_bad_records(lake.read("bronze", "t_bronze"))
    assert (good.count(), bad.count()) == (4, 2)
    assert "_corrupt_record" not in good.columns
    good, bad = Q.split_bad_records(spark.range(3))
    assert (good.count(), bad.count()) == (3, 0)


# -- catalog ------------------------------------------------------------------------


def test_sql_opens_only_the_tables_it_names(spark, lake, monkeypatch):
    for n in (1, 2, 3):
        lake.overwrite("gold", f"named-{n}", spark.range(n))
    opened, read = [], lake.read
    monkeypatch.setattr(lake, "read", lambda layer, table, **more: opened.append(table) or read(layer, table, **more))
    assert C.run_sql(lake, "SELECT count(*) AS n FROM NAMED_2 JOIN `named_3` USING (id)").first().n == 2
    assert sorted(opened) == ["named-2", "named-3"]


def test_catalog_sees_every_load(spark, lake):
    assert C.layer_catalog(lake).count() == 0
    for n in (5, 8):
        load_bronze(lake, "t-x_bronze", spark.range(n).toDF("row_id"), "s", "incremental", watermark_col="row_id")
    build_silver(lake, "t-x_bronze")
    lake.overwrite("gold", "g", spark.range(3))
    rows = {(r.layer, r.table_name): (r["rows"], r.columns) for r in C.layer_catalog(lake).collect()}
    assert rows == {("bronze", "t-x_bronze"): (8, 4), ("silver", "t-x_silver"): (8, 4), ("gold", "g"): (3, 1)}

    assert set(C.register_views(lake)) == {"t_x_bronze", "t_x_silver", "g"}
    assert C.run_sql(lake, "SELECT count(*) AS n FROM t_x_silver JOIN g ON row_id = id").collect()[0].n == 3
    assert spark.sql(C.default_query("t-x_bronze")).count() == 8
    assert C.preview(lake.read("bronze", "t-x_bronze"), 3).count() == 3

    files = C.file_profile(spark, lake.layer_path("bronze")).collect()
    assert files and all(r.size > 0 and r.modified is not None for r in files)

    view = C.load_overview(lake).collect()[0]
    assert (view.mode, view.last_watermark_value, view.source_name) == ("incremental", "7", "s")


def test_counts_read_no_columns(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    text = C.row_counts({"t": spark.read.parquet(str(tmp_path / "t"))})._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in text


def test_file_profile_opens_no_file(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    plan = C.file_profile(spark, str(tmp_path))
    assert "content" not in plan._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_columns_of(spark):
    df = spark.createDataFrame([], "order_id int, price double, _load_mode string")
    rows = {r.column_name: (r.data_type, r.role, r.is_audit) for r in C.columns_of(spark, {"t": df}).collect()}
    assert rows == {
        "order_id": ("int", "id", False),
        "price": ("double", "measure", False),
        "_load_mode": ("string", "audit", True),
    }


# -- streaming ----------------------------------------------------------------------


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_each_file_once(spark, tmp_path, lake, fmt):
    folder = tmp_path / "landing"
    schema = "k bigint, v string"

    def drop(lo, hi):
        df = spark.range(lo, hi, 1, 1).select(F.col("id").alias("k"), F.lit("x").alias("v"))
        writer = df.write.mode("append")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(str(folder))

    counts = []
    for step in ((0, 1), (1, 3), None):
        if step:
            drop(*step)
        ingest_new_files(lake, str(folder), "t_bronze", schema, fmt, max_files_per_trigger=1)
        counts.append(lake.read("bronze", "t_bronze").count())
    assert counts == [1, 3, 3]
    rows = lake.read("bronze", "t_bronze").collect()
    assert sorted(r.k for r in rows) == [0, 1, 2]
    assert all(str(folder) in r._source_name and r._load_mode == "incremental" for r in rows)
    with pytest.raises(ValueError):
        ingest_new_files(lake, str(folder), "t_bronze", schema, "xml")


def test_streamed_table_goes_on_to_silver(spark, tmp_path, lake):
    spark.range(0, 5, 1, 1).toDF("RowID").write.parquet(str(tmp_path / "landing"))
    ingest_new_files(lake, str(tmp_path / "landing"), "t_bronze", "RowID bigint")
    assert build_silver(lake, "t_bronze").rows == 5
    assert build_silver(lake, "t_bronze").rows == 5
    assert lake.read("silver", "t_silver").columns[0] == "row_id"


# -- runs ---------------------------------------------------------------------------


def _sources(tmp_path):
    (tmp_path / "leave_logs.csv").write_text(LEAVE_CSV)
    (tmp_path / "ticket_events.json").write_text(TICKETS_JSON)
    return [SourceSpec(str(tmp_path / n)) for n in ("leave_logs.csv", "ticket_events.json")]


PLAN = {
    "source_tables": ["leave_logs_silver"],
    "group_by": ["approval_status"],
    "aggregations": [{"func": "COUNT", "col": "*", "alias": "n"}],
    "destination": "leave_status",
}


def _report(df):
    return {(r.layer, r.table_name): (r.status, r["rows"]) for r in df.collect()}


def test_run(spark, tmp_path, lake):
    report = _report(run_layers(lake, _sources(tmp_path), [PLAN]))
    assert report == {
        ("bronze", "leave_logs_bronze"): ("success", 4),
        ("bronze", "ticket_events_bronze"): ("success", 6),
        ("silver", "leave_logs_silver"): ("success", 4),
        ("silver", "ticket_events_silver"): ("success", 4),
        ("gold", "leave_status"): ("success", 2),
    }
    assert {r.approval_status: r.n for r in lake.read("gold", "leave_status").collect()} == {"Approved": 3, "Pending": 1}


def test_run_stops_after_a_failed_layer(spark, tmp_path, lake):
    sources = [*_sources(tmp_path), SourceSpec(str(tmp_path / "nowhere.csv"))]
    report = _report(run_layers(lake, sources, [PLAN]))
    assert report[("bronze", "nowhere_bronze")] == ("failed", None)
    assert report[("bronze", "leave_logs_bronze")] == ("success", 4)
    assert {v[0] for k, v in report.items() if k[0] != "bronze"} == {"skipped"}


def test_run_can_go_on(spark, tmp_path, lake):
    sources = [*_sources(tmp_path), SourceSpec(str(tmp_path / "nowhere.csv"))]
    broken = {**PLAN, "group_by": ["nothing"], "destination": "broken"}
    out = run_layers(lake, sources, [PLAN, broken], stop_on_failure=False, concurrent=1)
    report = _report(out)
    assert report[("silver", "leave_logs_silver")] == ("success", 4)
    assert ("silver", "nowhere_silver") not in report
    assert report[("gold", "leave_status")][0] == "success"
    assert report[("gold", "broken")][0] == "failed"
    assert "unknown columns" in out.where("table_name = 'broken'").collect()[0].error


def test_incremental_run(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    folder = str(tmp_path / "rows.parquet")
    for n, added in ((10, 10), (10, 0), (25, 15)):
        spark.range(n).toDF("row_id").write.mode("overwrite").parquet(folder)
        spec = SourceSpec(folder, "incremental", watermark_col="row_id")
        report = _report(run_layers(lake, [spec], incremental_silver=True))
        assert report[("bronze", "rows_bronze")] == ("success", added)
    assert lake.read("silver", "rows_silver").count() == 25


def test_incremental_files_without_watermark_are_taken_once(spark, tmp_path, lake):
    path = tmp_path / "leave_logs.csv"
    path.write_text(LEAVE_CSV)
    for want in (4, 0):
        report = _report(run_layers(lake, [SourceSpec(str(path), "incremental")]))
        assert report[("bronze", "leave_logs_bronze")] == ("success", want)
        assert report[("silver", "leave_logs_silver")] == ("success", 4)


def test_streams_and_batches_do_not_mix(spark, tmp_path, lake):
    spark.range(0, 5, 1, 1).write.parquet(str(tmp_path / "landing"))
    load_bronze(lake, "t_bronze", spark.range(3), "s")
    with pytest.raises(ValueError, match="batches"):
        ingest_new_files(lake, str(tmp_path / "landing"), "t_bronze", "id bigint")


def test_run_with_summaries(spark, tmp_path, lake):
    report = _report(run_layers(lake, _sources(tmp_path), summaries=True))
    assert report[("gold", "leave_logs_summary")] == ("success", 4)
    assert report[("gold", "ticket_events_summary")] == ("success", 4)  # distinct (priority, resolved)
    assert lake.read("gold", "leave_logs_summary").columns == [
        "leave_type", "approval_status", "start_date", "record_count",
    ]


def test_jdbc_increment_splits_only_the_new_range(spark, lake):
    table = JdbcTable("jdbc:x", "public.t")
    load_bronze(lake, "t_bronze", spark.range(50).toDF("k"), "t", "incremental", watermark_col="k")
    spec = SourceSpec(table, "incremental", watermark_col="k", partition_column="k")
    assert spec._stored_watermark(lake) == "49"
    assert SourceSpec(table, "full", watermark_col="k", partition_column="k")._stored_watermark(lake) is None
    assert SourceSpec(table, "incremental", watermark_col="k")._stored_watermark(lake) is None
