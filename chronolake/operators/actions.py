"""What a known corporate action does to a lookback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable_lookback(bars: DataFrame, actions: DataFrame, key: str, lookback: int) -> DataFrame:
    """key, day, usable: bars of the last ``lookback`` that no known action makes incomparable.

    bars: key, day, available_at.  actions: key, day, known_at.  An action after the first bar of the lookback, known when
    the bar is, drops the bars before its day.  Actions are put on the first bar at or after their day, so
    that a row carries only the actions between two sessions and the lookback bounds what a window holds."""
    both = bars.select(key, "day", F.lit(True).alias("_bar"), F.lit(None).cast("timestamp").alias("_known")).unionByName(actions.select(key, "day", F.lit(False).alias("_bar"), F.col("known_at").cast("timestamp").alias("_known")))
    onward = Window.partitionBy(key).orderBy("day", "_bar").rowsBetween(0, Window.unboundedFollowing)
    placed = both.withColumn("_session", F.first(F.when(F.col("_bar"), F.col("day")), ignorenulls=True).over(onward)).where("NOT _bar AND _session IS NOT NULL")
    held = placed.groupBy(key, F.col("_session").alias("day")).agg(F.collect_set(F.struct(F.col("day").alias("on"), F.col("_known").alias("known"))).alias("_actions"))
    last = Window.partitionBy(key).orderBy("day").rowsBetween(-(lookback - 1), 0)
    rows = bars.select(key, "day", F.col("available_at").cast("timestamp").alias("_at")).join(held, [key, "day"], "left")
    rows = rows.withColumns({"_days": F.collect_list("day").over(last), "_recent": F.flatten(F.collect_list("_actions").over(last))})
    known = F.filter("_recent", lambda a: (a["known"] <= F.col("_at")) & (a["on"] > F.col("_days")[0]) & (a["on"] <= F.col("day")))
    reset = F.array_max(F.transform(known, lambda a: a["on"]))
    rows = rows.withColumn("_reset", reset)
    usable = F.size(F.filter("_days", lambda d: F.col("_reset").isNull() | (d >= F.col("_reset"))))
    return rows.select(key, "day", usable.cast("long").alias("usable"))
