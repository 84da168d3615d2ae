"""Every query with SQL gives the rows of DuckDB; goldens of the folds."""

import os
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chronolake.operators import ledger
from chronolake.plans import registry
from chronolake.streaming import receipts

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def rows(frame):
    return sorted(map(str, frame[sorted(frame.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", registry.QUERIES)
def test_as_in_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS FROM '{DATA}/{file}'")
    got, want = registry.QUERIES[name](spark, DATA), con.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = sorted(map(repr, (tuple(r[c] for c in order) for r in got.collect())))
    b = sorted(map(repr, want.select(*order).fetchall()))
    assert a == b


AT = "cast('2024-01-01' as timestamp)"
EVENT = "account string, sequence int, kind string, instrument_id string, amount string, quantity string, price string, fee string, numerator string, denominator string, recorded int"


def events(spark, rows):
    frame = spark.createDataFrame([(*r, None)[:11] if len(r) == 10 else r for r in rows], EVENT)
    return frame.selectExpr("*", f"{AT} + make_interval(0,0,0,sequence) AS occurred_at", f"{AT} + make_interval(0,0,0,90) AS observed_at", "'USD' AS currency", "'synthetic_fixture' AS origin", "concat(account, sequence) AS event_id", "'s' AS source_ref")


def opened(account, amount="1000"):
    return (account, 1, "opening_cash", None, amount, None, None, None, None, None)


def trade(account, n, kind, quantity, price, fee="0", instrument="i"):
    return (account, n, kind, instrument, None, quantity, price, fee, None, None)


def split(account, n, new, old):
    return (account, n, "split", "i", None, None, None, None, new, old)


def test_ledger_goldens(spark):
    """Open 1000, buy 2 at 100 with fee 1, split 2:1, dividend 4, sell 1 at 60 with fee 1: cash 862, position 3; and what must not fold."""
    rows = [opened("a"), trade("a", 2, "buy", "2", "100", "1"), split("a", 3, "2", "1"), ("a", 4, "dividend", "i", "4", None, None, None, None, None), trade("a", 5, "sell", "1", "60", "1")]
    rows += [opened("b", "1"), trade("b", 2, "buy", "1", "5"), ("b", 3, "dividend", "i", "4", None, None, None, None, None)]
    rows += [opened("c"), trade("c", 2, "buy", "1", "10.1234")]
    rows += [opened("d"), trade("d", 2, "buy", "10", "1"), split("d", 3, "1.5", "1"), split("d", 4, "1", "7")]
    rows += [trade("e", 1, "buy", "1", "1"), opened("f"), opened("f")[:1] + (2, *opened("f")[2:])]
    rows += [opened("g", "1" + "0" * 24), trade("g", 2, "buy", "0.000000000000000001", "0.000000000000000001"), trade("g", 3, "sell", "1", "1")]
    rows += [opened("h"), trade("h", 2, "buy", "1", "1", "0", "x"), trade("h", 3, "buy", "2", "1", "0", "y"), trade("h", 4, "sell", "2", "1", "0", "x")]
    got = {(r.account, r.sequence): r for r in ledger.fold(events(spark, rows), "account").collect()}
    assert len(got) == len(rows)
    assert (got["a", 5].cash, got["a", 5].position, got["a", 5].error) == ("862", "3", None)
    assert (got["b", 3].cash, got["b", 3].error, got["c", 2].cash) == ("1", "negative_cash", "989.8766")
    assert (got["d", 3].position, got["d", 4].position, got["d", 4].error) == ("15", "15", "split_is_no_short_decimal")
    assert (got["e", 1].error, got["f", 2].error) == ("opening_cash_required", "one_opening_currency_and_origin")
    assert (got["g", 2].cash, got["g", 3].error) == ("9" * 24 + "." + "9" * 36, "short_position")
    assert (got["h", 3].position, got["h", 4].error) == ("2", "short_position")
    assert ledger.fold(events(spark, rows).limit(0), "account").count() == 0
    valid = {(r.account, r.sequence): r.reason for r in ledger.validate(events(spark, [*rows[:5], ("z", 1, "buy", "i", "1", "2", "3", "0", None, None), trade("z", 2, "buy", "0", "1"), trade("z", 3, "buy", "1", "1e2"), trade("z", 4, "sell", "1", "1", "0", " ")])).collect()}
    assert {k: v for k, v in valid.items() if v} == {("z", 1): "unsupported_kind_or_fields", ("z", 2): "invalid_amount", ("z", 3): "invalid_amount", ("z", 4): "instrument_required"}


def test_ledger_states_reports_and_reconciliation(spark):
    rows = [opened("a"), trade("a", 2, "buy", "2", "100", "1"), opened("b"), opened("b")[:1] + (3, *trade("b", 3, "buy", "1", "1")[2:])]
    journal = events(spark, rows).selectExpr("*", f"{AT} + make_interval(0,0,0,sequence) AS recorded_at")
    got = {r.account: r for r in ledger.state_as_of(journal, "account", F.expr(f"{AT} + make_interval(0,0,0,5)")).collect()}
    assert (got["a"].cash, got["a"].positions, got["a"].error, got["b"].error, got["b"].cash) == ("799", {"i": "2"}, None, "journal_order", None)
    good = '{"format":"offline-cash-events-v1","events":[{"n":1.50},{"n":2}]}'
    reports = spark.createDataFrame([(1, good), (2, good.replace("v1", "v2")), (3, "{"), (4, good[:-1] + ',"format":"x"}'), (5, good.replace('{"n":1.50},{"n":2}', "")), (6, None), (7, good + " " * 99)], "report int, payload string")
    assert sorted((r.report, r.nth, r.reason) for r in ledger.declared_report(reports, most_bytes=120).collect() if r.report == 1) == [(1, 0, None), (1, 1, None)]
    assert {r.report: r.reason for r in ledger.declared_report(reports, most_bytes=120).collect() if r.report > 1} == {2: "declared_format_required", 3: "invalid_json", 4: "invalid_json", 5: "declared_format_required", 6: "invalid_json", 7: "report_too_large"}
    d = Decimal
    mine = spark.createDataFrame([("a", None, "USD", d("799.0000009")), ("a", "i", "USD", d(2)), ("b", None, "EUR", d(1))], "account string, instrument_id string, currency string, amount decimal(28,12)")
    theirs = spark.createDataFrame([("a", None, "USD", d("799")), ("a", "j", "USD", d("0.5")), ("b", None, "USD", d(1))], "account string, instrument_id string, currency string, amount decimal(28,12)")
    agrees = {(r.account, r.instrument_id): (r.agrees, r.difference) for r in ledger.reconcile(mine, theirs, "account", "0.000001", "0").collect()}
    assert agrees == {("a", None): (True, d("0.0000009")), ("a", "i"): (False, d(2)), ("a", "j"): (False, d("-0.5")), ("b", None): (False, d(0))}


def test_first_receipts_of_a_stream(spark, tmp_path):
    """Retries within the delay are dropped, in one micro-batch or over two."""
    at = "cast('2024-01-01' as timestamp) + make_dt_interval(0, 0, id)"
    spark.range(40).selectExpr("id % 10 AS record", f"{at} AS received_at").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    spark.range(40, 60).selectExpr("id % 20 AS record", f"{at} AS received_at").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema("record long, received_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = receipts.first_receipts(stream, ["record"], "received_at", "2 hours").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    assert run.awaitTermination(100)
    assert sorted(r.record for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(20))
