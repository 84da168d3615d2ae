"""Delayed labels: what is known of locked predictions at a cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def queue_as_of(predictions: DataFrame, outcomes: DataFrame, key: str, as_of: Column) -> DataFrame:
    """key, state, eligible of every prediction known at ``as_of``.

    predictions: key, known_at, label_end.  outcomes: key, known_at, revision, status.  The latest outcome up to the cutoff
    counts, whatever its status: a quarantined correction hides the validated label before it.  Without one a
    prediction is pending until its label_end, then awaiting_outcome.  Only matured validated labels are eligible.
    A null known_at is unknown and never taken."""
    known = outcomes.where(F.col("known_at") <= as_of)
    latest = known.groupBy(key).agg(F.max_by("status", F.struct("known_at", "revision")).alias("status"))
    rows = predictions.where(F.col("known_at") <= as_of).join(latest, key, "left")
    matured = F.col("label_end") <= as_of
    waiting = F.when(matured, "awaiting_outcome").otherwise("pending")
    eligible = F.coalesce((F.col("status") == "validated") & matured, F.lit(False))
    return rows.select(key, F.coalesce("status", waiting).alias("state"), eligible.alias("eligible"))


def evaluation_labels(predictions: DataFrame, outcomes: DataFrame, key: str, as_of: Column) -> DataFrame:
    """The keys whose label may be evaluated at ``as_of``."""
    return queue_as_of(predictions, outcomes, key, as_of).where("eligible").select(key)


def check_outcomes(outcomes: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """key, outcome_id, reason (null: admissible) of each outcome.

    outcomes: key, outcome_id, known_at, status, value, correction_of; predictions: key, label_end.  In order of reasons: the
    prediction is unknown; a status other than validated has a value; a validated label came before label_end; a
    correction does not name the outcome before it, or the first names one; it is not later than that."""
    by = Window.partitionBy(key).orderBy("known_at", "outcome_id")
    rows = outcomes.withColumns({"_last": F.lag("outcome_id").over(by), "_at": F.lag("known_at").over(by)}).join(predictions.select(key, "label_end", F.lit(True).alias("_known")), key, "left")
    reason = F.when(F.col("_known").isNull(), "unknown_prediction").when(~F.col("status").isin("validated", "unavailable", "quarantined"), "unknown_status").when((F.col("status") != "validated") & F.col("value").isNotNull(), "value_without_validation")
    reason = reason.when((F.col("status") == "validated") & (F.col("known_at") < F.col("label_end")), "not_matured").when(~F.col("correction_of").eqNullSafe(F.col("_last")), "not_the_latest_corrected").when(F.col("_at") >= F.col("known_at"), "not_later")
    return rows.select(key, "outcome_id", reason.alias("reason"))
