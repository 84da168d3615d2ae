"""Declared reviews: what may be used, by the rules of a past cutoff and of now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assess(reviews: DataFrame, scope: str, axes: list[str], as_of: Column, now: Column) -> DataFrame:
    """scope, eligible, reasons of every scope that has a review.

    reviews: scope, axis, known_at, review_id, decision, expires_at.  On each axis the latest review at both cutoffs must
    allow and not have expired by that cutoff: a later denial hides an earlier consent, and a consent given or
    withdrawn after ``as_of`` counts too.  reasons are in the order of the axes' names."""
    body, order = F.struct("decision", "expires_at"), F.struct("known_at", "review_id")
    at = lambda t: F.max_by(F.when(F.col("known_at") <= t, body), F.when(F.col("known_at") <= t, order))
    latest = reviews.where(F.col("axis").isin(axes)).groupBy(scope, "axis").agg(at(as_of).alias("then"), at(now).alias("today"))
    allows = lambda r, t: F.coalesce((F.col(r)["decision"] == "allow") & (F.col(r)["expires_at"] > t), F.lit(False))
    granted = latest.select(scope, F.when(allows("then", as_of) & allows("today", now), F.col("axis")).alias("axis"))
    missing = F.array_except(F.array(*[F.lit(a) for a in sorted(axes)]), F.collect_set("axis"))
    found = reviews.select(scope).distinct().join(granted, scope, "left").groupBy(scope).agg(missing.alias("missing"))
    return found.select(scope, (F.size("missing") == 0).alias("eligible"), F.transform("missing", lambda a: F.concat(a, F.lit("_review_missing_denied_or_expired"))).alias("reasons"))
