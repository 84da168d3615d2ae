"""Streams: decisions and fills by instrument, maturing labels, groups of one instant."""

from datetime import date, datetime
from decimal import Decimal

import pytest

from chronolake.streaming import decisions
from tests.test_queries import spark  # noqa: F401


@pytest.fixture
def feed(spark, tmp_path):  # noqa: F811
    """Runs a function over batches, one micro-batch each, and gives the rows it put out."""

    def run(schema, batches, function):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        out = function(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        assert query.awaitTermination(100)
        return spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()

    return run


def test_decisions_and_fills(feed):
    """Lookback 3, two units: warm-up, a purchase at the next open, a sale, and no session after the last."""
    events = []
    for k, price in enumerate([100, 101, 102, 99, 98, 103]):
        day = lambda n: date(2026, 1, n)
        events.append(("a", day(5 + k), "open", datetime(2026, 1, 5 + k, 14, 30), Decimal(price), None))
        events.append(("a", day(5 + k), "close", datetime(2026, 1, 5 + k, 21), Decimal(price), day(6 + k) if k < 5 else None))
    gone = [("b", *e[1:]) for e in events[:6]] + [("b", date(2026, 1, 9), "open", datetime(2026, 1, 9, 14, 30), Decimal(7), None)]
    rows = feed("sym string, day date, kind string, available_at timestamp, price decimal(18,2), next_day date", [events[:5] + gone, events[5:], [events[2]]], lambda s: decisions.decide(s, "sym", 3, 2, "1.001"))
    got = sorted((r.at, r.kind, r.target, r.reason, r.quantity, r.price, r.position) for r in rows if r.sym == "a" and r.reason != "late_event")
    assert [x[1:] for x in got] == [
        ("decision", None, "warmup", None, None, 0),
        ("decision", None, "warmup", None, None, 0),
        ("decision", 1, None, None, None, 0),
        ("fill", 1, None, 2, Decimal("99.099000"), 2),
        ("decision", 0, None, None, None, 2),
        ("fill", 0, None, -2, Decimal("97.902098"), 0),
        ("decision", 0, None, None, None, 0),
        ("decision", None, "no_next_declared_session", None, None, 0),
    ]
    assert [(r.sym, r.at.day) for r in rows if r.reason == "late_event"] == [("a", 6)]
    assert [(r.target, r.position) for r in rows if r.reason == "missed_next_session_open"] == [(1, 0)]


def test_labels_mature(feed):
    t = lambda h, d=1: datetime(2026, 1, d, h)
    batches = [
        [(1, "prediction", t(1), t(5), None), (2, "prediction", t(1), t(5), None), (3, "outcome", t(2), None, "validated"), (4, "outcome", t(1), None, "unavailable"), (4, "prediction", t(1), t(3), None)],
        [(2, "outcome", t(4), None, "validated"), (2, "outcome", t(6), None, "validated"), (9, "prediction", t(8), t(9), None)],
        [(1, "outcome", t(9), None, "quarantined"), (2, "outcome", t(9), None, "quarantined"), (9, "prediction", t(9), t(20), None)],
        [(8, "prediction", t(0, 3), t(0, 9), None)],
        [(2, "outcome", t(1, 3), None, "validated"), (7, "prediction", t(0, 9), t(0, 30), None)],
    ]
    rows = feed("id int, kind string, event_at timestamp, label_end timestamp, status string", batches, lambda s: decisions.mature(s, "id", "1 hour", keep_days=1))
    want = [(1, t(5), "awaiting_outcome"), (1, t(9), "quarantined"), (2, t(4), "not_matured"), (2, t(6), "validated"), (2, t(9), "quarantined"), (2, t(1, 3), "unknown_prediction"), (3, t(2), "unknown_prediction"), (4, t(1), "unavailable"), (9, t(9), "awaiting_outcome")]
    got = sorted((r.id, r.at, r.state) for r in rows)
    assert got == sorted(want), got


def test_rows_of_instants(feed):
    t = lambda h: datetime(2026, 1, 1, h)
    batches = [[(1, 1, t(1)), (1, 2, t(1)), (1, 3, t(2)), (None, 9, t(2))], [(2, 4, t(2)), (1, 5, t(2)), (1, 6, t(5))], [(1, 7, t(10))], [(1, 8, t(11))]]
    rows = feed("g int, v int, at timestamp", batches, lambda s: decisions.rows_of_instants(s, ["g"], "at", "1 hour"))
    assert {r.v: (r.g, r.group_rows) for r in rows} == {1: (1, 2), 2: (1, 2), 3: (1, 2), 9: (None, 1), 4: (2, 1), 5: (1, 2), 6: (1, 1)} and len(rows) == 7
