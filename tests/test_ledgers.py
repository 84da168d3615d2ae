"""Ledgers as in SQL, however Spark deals their events out."""

import datetime

from chronolake.operators import ledger
from tests.test_parts import same_as_sql
from tests.test_queries import events, opened, spark, trade  # noqa: F401

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def cut_apart(spark):  # noqa: F811
    """From now on small shuffles become few partitions and larger ones stay as they are; gives what undoes it."""
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    return lambda: [spark.conf.unset(k) for k in small]


def test_an_opening_meets_its_events_however_both_are_dealt(spark, tmp_path):  # noqa: F811
    """Openings are few and orders many, so Spark cuts their shuffles differently; every ledger still has its opening."""
    rows = [(n, n % 300, "F", 1000.0 + n % 7000, datetime.datetime(1995, 1, 1) + datetime.timedelta(n % 900), "1-URGENT") for n in range(12000)]
    undo = cut_apart(spark)
    try:
        found = same_as_sql(spark, "ledger_fold", tmp_path, "orders", ORDERS, rows)
        few = events(spark, [opened(f"a{n}") for n in range(50)])
        many = events(spark, [trade(f"a{n % 50}", 2 + n // 50, "buy", "1", "1") for n in range(5000)])
        got = ledger.fold(few.repartition("account").unionByName(many.repartition("account")), "account").collect()
    finally:
        undo()
    assert len(got) == 5050 and {r.error for r in got} == {None}
    assert not any(r.error == "opening_cash_required" for r in found)


def test_prices_at_a_tie_round_as_in_sql(spark, tmp_path):  # noqa: F811
    """A price of half a ten-thousandth too much goes the way of the double that it is in SQL."""
    rows = [(7 * n, n, "F", 1000.5 + n, datetime.datetime(1995, 1, 1), "1-URGENT") for n in range(20000)]
    found = same_as_sql(spark, "ledger_fold", tmp_path, "orders", ORDERS, rows)
    assert len(found) == 40000 and sum(r.sequence == 2 and r.error is None for r in found) == 20000
