"""No database is started: a stand-in records what Spark's reader would be asked."""

from types import SimpleNamespace

import pytest

from stratalake import SourceSpec
from stratalake.sources import jdbc
from stratalake.sources.jdbc import JdbcTable, match_tables, read_jdbc


class Reader:
    """Takes the calls of ``spark.read`` and answers a bounds query with a one-row table."""

    def __init__(self, bounds):
        self.calls = []
        self.bounds = bounds

    def format(self, name):
        assert name == "jdbc"
        return self

    def options(self, **options):
        self.calls.append(options)
        return self

    def load(self):
        return self.bounds

    def jdbc(self, url, table, **options):
        self.calls.append({"url": url, "dbtable": table, **options})


@pytest.fixture
def session(spark):
    def make(lo="1", hi="1000", kind="int"):
        bounds = spark.range(1).selectExpr(f"cast({lo} as {kind}) as lo", f"cast({hi} as {kind}) as hi")
        return SimpleNamespace(read=Reader(bounds))

    return make


SOURCE = JdbcTable.postgresql("public.orders", "db.example", 5433, "shop", "me", "secret")


def test_postgresql_url_and_properties(monkeypatch):
    assert SOURCE.url == "jdbc:postgresql://db.example:5433/shop"
    assert SOURCE.properties["driver"] == jdbc.POSTGRES_DRIVER
    assert "secret" not in repr(SOURCE)
    monkeypatch.setenv("PG_USERNAME", "someone")
    monkeypatch.setenv("PG_PASSWORD", "pw")
    assert JdbcTable.postgresql("t").properties["user"] == "someone"
    assert JdbcTable.postgresql("t").properties["password"] == "pw"


def test_full_read_is_one_call(session):
    s = session()
    read_jdbc(s, SOURCE)
    (call,) = s.read.calls
    assert (call["url"], call["dbtable"], call["user"]) == (SOURCE.url, "public.orders", "me")
    assert call["fetchsize"] == "10000" and "partitionColumn" not in call


@pytest.mark.parametrize(
    "lo, hi, kind, want",
    [
        ("1", "1000", "int", ("1", "1000")),
        ("1.5", "9.25", "decimal(10,2)", ("1", "10")),
        ("'2024-01-01'", "'2024-02-01'", "date", ("2024-01-01", "2024-02-01")),
        ("'2024-01-01 10:00:00'", "'2024-02-01'", "timestamp", ("2024-01-01 10:00:00", "2024-02-01 00:00:00")),
    ],
)
def test_partitioned_read_asks_for_bounds_once(session, lo, hi, kind, want):
    s = session(lo, hi, kind)
    read_jdbc(s, SOURCE, partition_column="c", num_partitions=12)
    bounds, scan = s.read.calls
    assert "MIN(c)" in bounds["dbtable"] and "public.orders" in bounds["dbtable"]
    assert (scan["lowerBound"], scan["upperBound"]) == want
    assert (scan["partitionColumn"], scan["numPartitions"]) == ("c", "12")


def test_given_bounds_and_empty_table(session):
    s = session()
    read_jdbc(s, SOURCE, partition_column="c", bounds=(5, 6))
    (call,) = s.read.calls
    assert (call["lowerBound"], call["upperBound"]) == ("5", "6")
    s = session()
    read_jdbc(s, SOURCE, partition_column="c", lower="400")
    assert (s.read.calls[1]["lowerBound"], s.read.calls[1]["upperBound"]) == ("400", "1000")
    empty = session("NULL", "NULL")
    read_jdbc(empty, SOURCE, partition_column="c", lower="400")
    assert "partitionColumn" not in empty.read.calls[-1]


@pytest.mark.parametrize("lower, hi, kind", [("1001", "1000", "int"), ("10.5", "9.5", "double"), ("2024-05-02", "'2024-05-01'", "date")])
def test_a_watermark_above_the_source_asks_for_no_split(session, lower, hi, kind):
    """Spark refuses bounds the wrong way round; the filter from the watermark on finds nothing."""
    s = session(hi if kind == "date" else "1", hi, kind)
    read_jdbc(s, SOURCE, partition_column="c", lower=lower)
    assert "partitionColumn" not in s.read.calls[-1] and "lowerBound" not in s.read.calls[-1]


def test_options_reach_the_scan_from_a_source_spec(session, spark):
    s = session()
    spec = SourceSpec(SOURCE, options={"predicates": ["c < 5", "c >= 5"], "fetch_size": 7})
    spec.read(SimpleNamespace(spark=s))
    (call,) = s.read.calls
    assert call["predicates"] == ["c < 5", "c >= 5"] and call["properties"]["fetchsize"] == "7"
    with pytest.raises(TypeError):
        SourceSpec(SOURCE, options={"multi_line": True}).read(SimpleNamespace(spark=s))


def test_predicates(session):
    s = session()
    read_jdbc(s, SOURCE, predicates=["mod(id, 2) = 0", "mod(id, 2) = 1"])
    assert s.read.calls[0]["predicates"] == ["mod(id, 2) = 0", "mod(id, 2) = 1"]


def test_match_tables(spark):
    asked = spark.createDataFrame(
        [("public.a", "public", "a"), ("b", "public", "b")],
        "source string, table_schema string, table_name string",
    )
    known = spark.createDataFrame(
        [("public", "a", 1), ("other", "b", 2)], "table_schema string, table_name string, x int"
    )
    assert {r.source: r["exists"] for r in match_tables(asked, known).collect()} == {
        "public.a": True,
        "b": False,
    }
