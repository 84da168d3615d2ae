"""Daily bars and a frozen rule without look-ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators.actions import usable_lookback


def daily_bars(ticks: DataFrame, key: str, at: str, value: str, tie: str) -> DataFrame:
    """key, day, open, high, low, close, volume."""
    v, order = F.col(value).cast("decimal(18,2)"), F.struct(at, tie)
    return ticks.groupBy(key, F.to_date(at).alias("day")).agg(F.min_by(v, order).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, order).alias("close"), F.count("*").alias("volume"))


def close_above_mean(bars: DataFrame, key: str, lookback: int) -> DataFrame:
    """bars with decision: warmup, no_next_session, target_1 or target_0 (close * n > sum of n closes)."""
    by = Window.partitionBy(key).orderBy("day")
    last = by.rowsBetween(-(lookback - 1), 0)
    above = F.col("close") * lookback > F.sum("close").over(last)
    decision = F.when(F.count("*").over(last) < lookback, "warmup").when(F.lead("day").over(by).isNull(), "no_next_session").when(above, "target_1").otherwise("target_0")
    return bars.withColumn("decision", decision)


def decisions(bars: DataFrame, calendar: DataFrame, key: str, lookback: int, latency_seconds: int, first: str, last: str, actions: DataFrame | None = None) -> DataFrame:
    """key, day, reason (null: a decision), target, intended_at for the days from ``first`` to ``last``.

    bars: key, day, start, close, available_at; calendar: key, day, known_at (of the session); actions: key, day, known_at.  A decision
    is made when a bar is available, for the open of the next declared session.  Reasons in order: fewer bars than ``lookback`` since the
    last known action; one of them was not available yet; a newer one was; no next session; it was not known yet; it opens
    before the latency is over; it lies after ``last``."""
    by = Window.partitionBy(key).orderBy("day")
    window, after = by.rowsBetween(-(lookback - 1), 0), by.rowsBetween(1, Window.unboundedFollowing)
    rows = bars.select(key, "day", "start", "close", "available_at").withColumns({"_n": F.count("*").over(window), "_sum": F.sum("close").over(window), "_seen": F.max("available_at").over(window), "_newer": F.min("available_at").over(after), "_next": F.lead("day").over(by), "_open": F.lead("start").over(by)})
    if actions is not None:
        usable = usable_lookback(bars, actions, key, lookback).select(F.col(key).alias("_k"), F.col("day").alias("_d"), "usable")
        rows = rows.join(usable, (F.col(key) == F.col("_k")) & (F.col("day") == F.col("_d")), "left").withColumn("_n", F.coalesce("usable", "_n"))
    sessions = calendar.select(F.col(key).alias("_key"), F.col("day").alias("_session"), F.col("known_at").alias("_known"))
    rows = rows.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).join(sessions, (F.col(key) == F.col("_key")) & (F.col("_next") == F.col("_session")), "left")
    at = F.col("available_at")
    checks = [
        ("warmup", F.col("_n") < lookback),
        ("lookback_unavailable_at_decision", F.col("_seen") > at),
        ("superseded_by_newer_available_bar", F.col("_newer") <= at),
        ("no_next_declared_session", F.col("_next").isNull()),
        ("next_session_calendar_unavailable", ~F.coalesce(F.col("_known") <= at, F.lit(False))),
        ("missed_next_session_open", F.col("_open") < at + F.make_dt_interval(secs=F.lit(latency_seconds))),
        ("outside_evaluation_partition", F.col("_next") > F.lit(last).cast("date")),
    ]
    reason = F.coalesce(*[F.when(c, name) for name, c in checks])
    target = F.when(F.col("close") * lookback > F.col("_sum"), 1).otherwise(0)
    return rows.select(key, "day", reason.alias("reason"), F.when(reason.isNull(), target).alias("target"), F.when(reason.isNull(), F.col("_open")).alias("intended_at"))


def next_open_fill(bars: DataFrame, key: str, cost: str) -> DataFrame:
    """key, day, fill: the next open times ``cost``; days without a next session give no row."""
    following = F.lead("open").over(Window.partitionBy(key).orderBy("day"))
    return bars.select(key, "day", (following * F.lit(cost).cast("decimal(8,4)")).cast("decimal(18,6)").alias("fill")).where("fill is not null")


def expected_fills(decided: DataFrame, key: str, units: int, spread_bps: str, slippage_bps: str, fee: str) -> DataFrame:
    """key, day, intended_at, quantity, price, fee: the orders that a frozen rule's targets ask for, filled at the next open with costs.

    decided: key, day (unique together), target (0 or 1; null where no decision was made), intended_at, open (decimal, at most 6 digits after the point, of the session at
    intended_at).  A row without target, or without an open, is no decision and leaves the position as it was.  The position starts at zero; where a target
    changes it, ``units`` are bought or sold at the open plus, or minus, half the spread and the slippage (basis points, up to 4 digits after the point).  Prices are exact
    decimals.  A key has at most one row a day, so its window is as long as its calendar."""
    from decimal import Decimal

    adverse = (Decimal(spread_bps) / 2 + Decimal(slippage_bps)) / 10000
    if adverse < 0 or adverse >= 1 or Decimal(fee) < 0:
        raise ValueError("costs must not be negative, nor take the whole price")
    rate = lambda x: F.lit(format(x, "f")).cast("decimal(14,9)")
    rows = decided.where(F.col("target").isNotNull() & F.col("open").isNotNull())
    before = F.coalesce(F.lag("target").over(Window.partitionBy(key).orderBy("day")), F.lit(0))
    rows = rows.withColumn("quantity", ((F.col("target") - before) * units).cast("long")).where("quantity <> 0")
    price = F.col("open").cast("decimal(18,6)") * F.when(F.col("quantity") > 0, rate(1 + adverse)).otherwise(rate(1 - adverse))
    return rows.select(key, "day", "intended_at", "quantity", price.alias("price"), F.lit(fee).cast("decimal(18,6)").alias("fee"))


def partition_of(at: Column, bounds: list[tuple[str, str, str]], horizon_days: int) -> Column:
    """The name of the partition [start, end] of a day; ``embargo`` where its label ends after the partition, else null.

    The bounds are given in time order, and each must start after the labels of the one before have ended."""
    from datetime import date, timedelta

    for (_, _, end), (name, start, _) in zip(bounds, bounds[1:]):
        if date.fromisoformat(end) + timedelta(horizon_days) >= date.fromisoformat(start):
            raise ValueError(f"partition {name} starts before earlier labels have ended")
    day = lambda d: F.lit(d).cast("date")
    within = [F.when(at.between(day(s), day(e)), F.when(F.date_add(at, horizon_days) <= day(e), name).otherwise("embargo")) for name, s, e in bounds]
    return F.coalesce(*within)
