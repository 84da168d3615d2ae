"""Snapshots put once and captures read back: each reason, ties, nulls and empty tables."""

import hashlib
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chronolake.operators import ledger, rules, stores
from tests.test_queries import spark  # noqa: F401

T = datetime(2024, 1, 10)
SHA = hashlib.sha256(b"x").hexdigest()
SNAPSHOT = "seq long, kind string, target_id string, body string, valid_from timestamp, valid_to timestamp, known_at timestamp, evidence_id string"
CAPTURE = "source_id string, import_id string, input_json string, raw_sha string, available_at timestamp, result_json string"


def world(spark):  # noqa: F811
    grants = spark.createDataFrame([("s", datetime(2024, 1, 1), ["research"]), ("t", datetime(2024, 1, 1), ["storage"]), ("s", datetime(2024, 3, 1), [])], "source_id string, known_at timestamp, uses array<string>")
    raw = spark.createDataFrame([(SHA, bytearray(b"x")), ("0" * 64, bytearray(b"y"))], "sha256 string, payload binary")
    evidence = spark.createDataFrame([("e", "s", SHA, datetime(2024, 1, 2)), ("bad", "s", "0" * 64, datetime(2024, 1, 2)), ("lost", "s", "1" * 64, datetime(2024, 1, 2)), ("other", "t", SHA, datetime(2024, 1, 2)), ("late", "s", SHA, datetime(2024, 2, 2))], "evidence_id string, source_id string, sha256 string, received_at timestamp")
    return grants, raw, evidence


def snapshot(seq, *, kind="session", target="L", body="{}", start=T, days=1, known=T, evidence="e"):
    return (seq, kind, target, body, start, start and start + timedelta(days=days), known, evidence)


def test_snapshots_are_put_once(spark):  # noqa: F811
    grants, raw, evidence = world(spark)
    rows = [
        snapshot(1), snapshot(2), snapshot(3, body='{"a":1}'), snapshot(4, days=2), snapshot(5, kind="bar"), snapshot(6, target="held"), snapshot(7, target="held", body="x"),
        snapshot(8, kind=""), snapshot(9, target=None), snapshot(10, days=0), snapshot(11, start=None), snapshot(12, known=None), snapshot(13, evidence="nobody"), snapshot(14, evidence="late"),
        snapshot(15, evidence="other"), snapshot(16, evidence="bad"), snapshot(17, evidence="lost"), snapshot(18, known=datetime(2024, 3, 1)), snapshot(19, target="M", evidence="bad"), snapshot(20, target="M", body="y"), snapshot(21, body=None),
    ]
    frame = spark.createDataFrame(rows, SNAPSHOT)
    held = spark.createDataFrame([snapshot(0, target="held")], SNAPSHOT).drop("seq")
    got = {r.seq: (r.outcome, r.reason) for r in stores.put_snapshots(frame, held, evidence, raw, grants).collect()}
    refused = {3: "revision_conflict", 4: "revision_conflict", 7: "revision_conflict", 8: "required_text_missing", 9: "required_text_missing", 10: "empty_interval", 11: "empty_interval", 12: "evidence_not_known", 13: "evidence_not_known", 14: "evidence_not_known", 15: "use_not_allowed", 16: "payload_corrupt", 17: "payload_corrupt", 18: "use_not_allowed", 19: "payload_corrupt", 21: "required_text_missing"}
    want = {k: ("refused", v) for k, v in refused.items()} | {1: ("new", None), 2: ("seen_again", None), 5: ("new", None), 6: ("seen_again", None), 20: ("new", None)}
    assert got == want
    again = stores.put_snapshots(frame, frame.where("seq in (1, 5, 20)").drop("seq"), evidence, raw, grants).collect()
    assert {r.seq for r in again if r.outcome == "new"} == {6} and {r.seq for r in again if r.outcome == "seen_again"} == {1, 2, 5, 20}
    assert stores.put_snapshots(frame.limit(0), held, evidence, raw, grants).count() == 0
    ids = [r.snapshot_id for r in stores.put_snapshots(frame, held.limit(0), evidence, raw, grants).where("seq in (1, 2, 3, 4, 5)").orderBy("seq").collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 4


def test_one_key_may_hold_many_snapshots(spark):  # noqa: F811
    grants, raw, evidence = world(spark)
    many = spark.range(1, 20_001).select(F.col("id").alias("seq"), F.lit("bar").alias("kind"), F.lit("hot").alias("target_id"), (F.col("id") % 4).cast("string").alias("body"), F.lit(T).alias("valid_from"), F.lit(T + timedelta(days=1)).alias("valid_to"), F.lit(T).alias("known_at"), F.lit("e").alias("evidence_id"))
    got = stores.put_snapshots(many, many.drop("seq").limit(0), evidence, raw, grants).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in got} == {"new": 1, "seen_again": 4_999, "refused": 15_000}


def test_captures_are_checked_when_read(spark):  # noqa: F811
    grants, raw, _ = world(spark)
    result = '{"quarantined":[{"row_path":"$[0]","reason":"r"},{"row_path":"$[1]","reason":"r"}]}'
    rows = [("s", "good", "{}", SHA, T, result), ("s", "none", "{}", SHA, T, "{}"), ("s", "edited", "{}", SHA, T, result), ("s", "bytes", "{}", "0" * 64, T, "{}"), ("s", "lost", "{}", "1" * 64, T, "{}"), ("s", "short", "{}", SHA, T, result), ("s", "more", "{}", SHA, T, "{}"), ("s", "twice", "{}", SHA, T, result), ("t", "good", "{}", SHA, T, "{}")]
    captures = spark.createDataFrame(rows, CAPTURE).withColumn("integrity_sha", stores.manifest_sha256())
    captures = captures.withColumn("input_json", F.when(F.col("import_id") == "edited", "[]").otherwise(F.col("input_json")))
    journal = [("s", i, f"$[{n}]", "r") for i in ("good", "edited", "twice") for n in (0, 1)] + [("s", "short", "$[0]", "r"), ("s", "more", "$[9]", "r"), ("s", "twice", "$[1]", "r")]
    journal = spark.createDataFrame(journal, "source_id string, import_id string, row_path string, reason string")
    asked = [(i, s, i, T + timedelta(days=1)) for s, i, *_ in rows if s == "s"] + [("denied", "t", "good", T), ("early", "s", "good", T - timedelta(seconds=1)), ("back", "s", "good", datetime(2024, 3, 1)), ("unknown", "s", "?", T), ("no_id", "s", None, T), ("no_source", None, "good", T), ("no_time", "s", "good", None), ("again", "s", "good", T)]
    requests = spark.createDataFrame(asked, "request string, source_id string, import_id string, as_of timestamp")
    got = {r.request: r for r in stores.captures_as_of(requests, captures, raw, journal, grants).collect()}
    want = {"good": "available", "none": "available", "edited": "manifest_changed", "bytes": "payload_corrupt", "lost": "payload_corrupt", "short": "journal_changed", "more": "journal_changed", "twice": "journal_changed", "denied": "use_not_allowed", "early": "unavailable", "back": "use_not_allowed", "unknown": "unavailable", "no_id": "unavailable", "no_source": "use_not_allowed", "no_time": "use_not_allowed", "again": "available"}
    assert {k: r.status for k, r in got.items()} == want
    assert (got["good"].quarantined, got["good"].result_json, got["none"].quarantined, got["early"].result_json) == (2, result, 0, None)
    assert stores.captures_as_of(requests, captures.limit(0), raw, journal, grants).where("status = 'available'").count() == 0


def test_fills_have_costs(spark):  # noqa: F811
    days = [date(2024, 1, k) for k in range(1, 8)]
    targets = [0, 1, None, 1, 0, 1, 1]
    opens = ["10.00", "20.00", "30.00", "40.00", "33.333333", None, "50.00"]
    rows = [("a", day, t, datetime(2024, 1, 1 + k), o and Decimal(o)) for k, (day, t, o) in enumerate(zip(days, targets, opens, strict=True))] + [("b", days[0], None, None, None), (None, days[0], 1, None, Decimal(8))]
    frame = spark.createDataFrame(rows, "k string, day date, target int, intended_at timestamp, open decimal(18,6)")
    got = [(r.k, r.day.day, r.quantity, r.price, r.fee) for r in rules.expected_fills(frame, "k", 5, "1.5", "0.25", "2").orderBy("k", "day").collect()]
    up, down = Decimal("1.0001"), Decimal("0.9999")
    assert got == [(None, 1, 5, 8 * up, 2), ("a", 2, 5, 20 * up, 2), ("a", 5, -5, Decimal("33.333333") * down, 2), ("a", 7, 5, 50 * up, 2)]
    assert rules.expected_fills(frame.limit(0), "k", 5, "0", "0", "0").count() == 0
    with pytest.raises(ValueError):
        rules.expected_fills(frame, "k", 5, "-1", "0", "0")


def test_accounts_are_reconciled_whole(spark):  # noqa: F811
    schema = "k string, instrument_id string, currency string, amount decimal(18,6)"
    d = Decimal
    states = [("same", None, "USD", d(10)), ("same", "X", "USD", d(1)), ("cash", None, "USD", d(10)), ("near", None, "USD", d("10.01")), ("held", None, "USD", d(10)), ("held", "X", "USD", d(1)), ("euro", None, "USD", d(10)), ("alone", None, "USD", d(10)), (None, None, "USD", d(1)), ("nil", None, None, d(1))]
    stated = [("same", None, "USD", d(10)), ("same", "X", "USD", d(1)), ("cash", None, "USD", d(12)), ("near", None, "USD", d(10)), ("held", None, "USD", d(10)), ("held", "Y", "USD", d(1)), ("euro", None, "EUR", d(10)), ("new", "X", "USD", d(3)), (None, None, "USD", d(1)), ("nil", None, None, d(1))]
    a, b = spark.createDataFrame(states, schema), spark.createDataFrame(stated, schema)
    got = {r.k: (r.status, r.cash_difference, r.instruments, r.off) for r in ledger.reconciliation(a, b, "k", "0.01", "0").collect()}
    assert got == {"same": ("matches", 0, 1, 0), "cash": ("mismatch", -2, 0, 0), "near": ("matches", d("0.01"), 0, 0), "held": ("mismatch", 0, 2, 2), "euro": ("currency_differs", None, 0, None), "alone": ("not_declared", None, 0, None), "new": ("not_opened", None, 1, None), None: ("matches", 0, 0, 0), "nil": ("currency_differs", None, 0, None)}
    assert ledger.reconciliation(a.limit(0), b.limit(0), "k", "0", "0").count() == 0
