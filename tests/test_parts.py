"""Imports in parts: rows are numbered, and repeated ones found, over the whole import."""

import datetime
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from chronolake.operators import captures
from chronolake.plans import registry
from chronolake.sources import parts_of
from tests.test_queries import spark  # noqa: F401

AT = datetime.datetime(2024, 1, 5, 15)


def same_as_sql(spark, name, path, table, schema, rows):  # noqa: F811
    """The query's rows over a table of these rows, after they were held against its SQL."""
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{table}.parquet")
    got, con = registry.QUERIES[name](spark, str(path)), duckdb.connect()
    want = con.sql(f"WITH {table} AS (FROM '{path}/{table}.parquet/*.parquet') SELECT {', '.join(sorted(got.columns))} FROM ({registry.SQL[name]})").fetchall()
    found = got.select(*sorted(got.columns)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    return found


def events(spec):
    """Event numbers by user and type, each with how many days after AT it is."""
    return [(i, AT + datetime.timedelta(days), user, kind, 5.0, "{}") for i, user, kind, days in spec]


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_parts_are_bounded_and_follow_each_other(spark):  # noqa: F811
    rows = spark.createDataFrame([(k, n) for k in ("a", None) for n in [*range(0, 90, 2), *range(500, 505), None]], "k string, n long")
    cut = parts_of(rows, ["k"], "n", 10).groupBy("k", "offset").agg(F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high")).orderBy("k", "offset").collect()
    for k in ("a", None):
        mine = [r for r in cut if r.k == k]
        assert sum(r.size for r in mine) == 51 and max(r.size for r in mine) < 20 and len(mine) > 3
        assert [r.offset for r in mine] == [sum(x.size for x in mine[:i]) for i in range(len(mine))]
        assert all(a.high < b.low for a, b in zip(mine, mine[1:]) if b.low is not None)


def test_bars_repeat_over_a_whole_import(spark, tmp_path):  # noqa: F811
    """Bars of one day are ambiguous however far their numbers are apart, and a symbol without a listing is told once."""
    spec = [(1, 1, "view", 0), (20002, 1, "view", 0), (40003, 1, "view", 1), (3, 1, "error", 0), (30003, 1, "error", 0), (5, 2, "view", 0)]
    spec += [(50000 + n, 3, "click", n % 30) for n in range(25000)] + [(80000 + n, 3, "error", 0) for n in range(25000)]
    found = same_as_sql(spark, "bar_import", tmp_path, "events", EVENTS, events(spec))
    assert {r.row_path: r.reason for r in found if r.import_id == 1} == {"bars/view~1US/0": "ambiguous_daily_bar", "bars/view~1US/1": "ambiguous_daily_bar", "bars/view~1US/2": "accepted", "bars/error~1US": "unmapped_symbol"}
    assert Counter(r.reason for r in found)["unmapped_symbol"] == 2 and len(found) == 3 + 1 + 1 + 25000 + 1
    bar = '{"t":"2024-01-05T15:00:00Z","o":1,"h":1,"l":1,"c":1,"v":1}'
    pages = spark.createDataFrame([(1, 0, '{"bars":{"A":[%s,{}],"X":[]}}' % bar), (1, 2, '{"bars":{"A":[%s],"X":[]}}' % bar), (1, 3, "{"), (1, 4, "{"), (2, 0, '{"bars":{"A":[%s]}}' % bar)], "import_id int, offset long, payload string")
    got = captures.bars(pages.withColumn("received_at", F.lit("2024-02-01").cast("timestamp")), spark.createDataFrame([("A", "a")], "symbol string, listing_id string"), "UTC")
    assert sorted((r.import_id, r.row_path, r.reason or "accepted") for r in got.collect()) == [(1, "$", "bars_object_required"), (1, "bars/A/0", "ambiguous_daily_bar"), (1, "bars/A/1", "required_bar_fields_missing"), (1, "bars/A/2", "ambiguous_daily_bar"), (1, "bars/X", "unmapped_symbol"), (2, "bars/A/0", "accepted")]


def test_days_repeat_over_a_whole_calendar(spark, tmp_path):  # noqa: F811
    """A day that stands twice is a duplicate however far the numbers of its rows are apart."""
    spec = [(1, 1, "view", 0), (20002, 1, "view", 0), (40001, 1, "view", 1), (5, 2, "view", 0)] + [(50000 + n, 3, "view", n % 15) for n in range(25000)]
    found = same_as_sql(spark, "calendar_import", tmp_path, "events", EVENTS, events(spec))
    assert {r.row_path: r.reason for r in found if r.import_id == 1} == {"/0": "duplicate_calendar_date", "/1": "duplicate_calendar_date", "/2": "accepted"}
    assert {r.row_path for r in found if r.import_id == 3} == {f"/{n}" for n in range(25000)}
    row = '[{"date":"2024-01-05","open":"09:30","close":"16:00"}]'
    pages = spark.createDataFrame([(1, 0, row), (1, 1, row), (1, 2, "{"), (1, 3, "{"), (2, 0, row)], "import_id int, offset long, payload string")
    got = captures.sessions(pages, "UTC", "2024-01-01", "2024-12-31").collect()
    assert sorted((r.import_id, r.row_path, r.reason or "accepted") for r in got) == [(1, "$", "calendar_array_required"), (1, "/0", "duplicate_calendar_date"), (1, "/1", "duplicate_calendar_date"), (2, "/0", "accepted")]


def test_accessions_repeat_over_a_whole_import(spark, tmp_path):  # noqa: F811
    """Accession numbers of a customer are duplicates however far their orders are apart, and a payload of another filer is told once."""
    order = lambda i, who, day: (i, who, "F", 1.0, datetime.datetime(1995, 1, 1) + datetime.timedelta(day), "1-URGENT")
    rows = [order(1, 1, 0), order(20002, 1, 1), order(40003, 1, 200), order(5, 50, 0), order(30001, 50, 0), order(6, 2, 0)]
    rows += [order(50000 + n, 3, n % 700) for n in range(25000)] + [order(80000 + n, 100, 0) for n in range(25000)]
    found = same_as_sql(spark, "filings_import", tmp_path, "orders", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string", rows)
    assert {r.row_index: r.reason for r in found if r.import_id == 1} == {0: "duplicate_accession", 1: "duplicate_accession", 2: "accepted"}
    assert [(r.row_index, r.reason) for r in found if r.import_id in (50, 100)] == [(None, "invalid_submissions_envelope")] * 2
    assert {r.row_index for r in found if r.import_id == 3} == set(range(25000))
