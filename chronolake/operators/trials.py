"""Frozen protocols: outcome definitions, locked predictions, trials, and periods that may be tested once."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.times import horizon
from chronolake.operators.evidence import first_reason, required
from chronolake.operators.journals import append_once

# Where an outcome may come from.
ORIGINS = ("synthetic_fixture", "provider_reported", "verified_broker_fills", "hypothetical_strategy", "paper_fills")


def check_definitions(definitions: DataFrame) -> DataFrame:
    """definition_id, version_id, reason (null: admissible) of outcome definitions.

    Texts are required; the horizon is a whole number of elapsed seconds up to ten years; the origin is a known one."""
    texts = [c for c in ("definition_id", "version_id", "target", "unit", "benchmark", "price_convention", "cost_convention")]
    missing = F.exists(F.array(*[required(F.col(c)) for c in texts]), lambda x: ~x)
    seconds = F.col("horizon_seconds")
    reason = first_reason(
        ("required_text_missing", missing),
        ("positive_horizon_required", ~F.coalesce((seconds > 0) & (seconds <= 315_360_000), F.lit(False))),
        ("unknown_origin", ~F.coalesce(F.col("outcome_origin").isin(*ORIGINS), F.lit(False))),
    )
    return definitions.select("definition_id", "version_id", reason.alias("reason"))


def lock_predictions(locked: DataFrame, incoming: DataFrame, definitions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """prediction_id, outcome (new, same, conflict or refused), reason (of refused ones), label_end (of new ones).

    locked and incoming: prediction_id, definition_id, version_id, artifact_id, artifact_sha256, action (forecast or abstain), value; incoming
    also known_at.  definitions: definition_id, version_id, known_at, horizon_seconds.  artifacts: artifact_id, artifact_sha256, known_at.  What a
    prediction names must be known when it is made; its label ends a horizon of elapsed seconds later.  A prediction once
    locked never changes: another input under its id is a conflict, as are two in one batch."""
    inputs = ["prediction_id", "definition_id", "version_id", "artifact_id", "artifact_sha256", "action", "value"]
    met = append_once(locked.select(*inputs), incoming.select(*inputs), ["prediction_id"]).withColumnRenamed("outcome", "_met")
    defined = definitions.groupBy("definition_id", "version_id").agg(F.min_by(F.struct("known_at", "horizon_seconds"), F.struct("known_at", "horizon_seconds")).alias("d")).select("definition_id", "version_id", F.col("d.known_at").alias("_defined"), "d.horizon_seconds")
    made = artifacts.groupBy("artifact_id", "artifact_sha256").agg(F.min("known_at").alias("_made"))  # repeated ones count from their first time
    rows = incoming.groupBy(*inputs).agg(F.min("known_at").alias("known_at"))  # a retry is the same prediction
    rows = rows.join(defined, ["definition_id", "version_id"], "left").join(made, ["artifact_id", "artifact_sha256"], "left")
    rows = rows.join(met.withColumnRenamed("prediction_id", "_id"), F.col("prediction_id").eqNullSafe(F.col("_id"))).drop("_id")
    known = lambda c: F.coalesce(F.col(c) <= F.col("known_at"), F.lit(False))
    reason = first_reason(
        ("required_text_missing", ~required(F.col("prediction_id").cast("string"))),
        ("forecast_with_value_or_abstain_without", ~F.coalesce(((F.col("action") == "forecast") & F.col("value").isNotNull()) | ((F.col("action") == "abstain") & F.col("value").isNull()), F.lit(False))),
        ("unknown_definition", ~known("_defined")),
        ("unknown_artifact", ~known("_made")),
    )
    outcome = F.when(F.col("_met") != "new", F.col("_met")).when(reason.isNotNull(), "refused").otherwise("new")
    return rows.select("prediction_id", outcome.alias("outcome"), F.when(outcome == "refused", reason).alias("reason"), F.when(outcome == "new", horizon(F.col("known_at"), F.col("horizon_seconds"))).alias("label_end"))


def consume(requests: DataFrame, instrument: str, order: list[str], start: str, end: str) -> DataFrame:
    """requests with consumed: whether the period [start, end] (days) of the instrument was untouched, and now is taken.

    Requests are met in ``order``; one that overlaps a period taken before takes nothing itself.  The rows of an instrument pass
    through one task in order, and what is held is the periods taken, which never overlap: no group is collected."""

    def take(batches):
        at, starts, ends = None, [], []
        for batch in batches:
            found = []
            for who, a, b in zip(batch["_who"], batch["_from"], batch["_to"], strict=True):
                if who != at:
                    at, starts, ends = who, [], []
                k = bisect_left(ends, a)  # the first period that ends no earlier than this begins
                free = a <= b and (k == len(ends) or starts[k] > b)
                if free:
                    insort(starts, a)
                    insort(ends, b)
                found.append(free)
            yield batch.drop(columns=["_who", "_from", "_to"]).assign(consumed=pd.Series(found, index=batch.index, dtype=bool))

    number = lambda c: F.coalesce(F.unix_date(F.col(c)), F.lit(0 if c == end else 1))  # a null bound is an empty period
    empty = F.col(start).isNull() | F.col(end).isNull()
    rows = requests.withColumns({"_who": F.coalesce(F.col(instrument).cast("string"), F.lit("")), "_from": F.when(empty, 1).otherwise(number(start)), "_to": F.when(empty, 0).otherwise(number(end))})
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields] + ["consumed boolean"])
    return rows.repartition("_who").sortWithinPartitions("_who", *order).mapInPandas(take, schema)


def evaluations(requests: DataFrame, trials: DataFrame, experiments: DataFrame, baselines: DataFrame) -> DataFrame:
    """request_id, reason (null: may be evaluated), consumed, start, end of requests to evaluate a trial on a partition.

    requests: request_id, trial_id, partition, dataset_sha256, at.  trials: trial_id, experiment_id, experiment_sha256, registered_at.  experiments:
    experiment_id, sha256, baseline_id, baseline_sha256, dataset_sha256, instrument_id, partitions (map of name to struct start, end), registered_at.
    baselines: baseline_id, sha256, registered_at.  Ids are unique.  Digests must be those that were frozen, and a final test takes its period
    for good before anything is computed (see ``consume``); the same trial may ask for its own period again."""
    e = experiments.select("experiment_id", F.col("sha256").alias("_e"), "baseline_id", "baseline_sha256", F.col("dataset_sha256").alias("_data"), "instrument_id", "partitions", F.col("registered_at").alias("_e_at"))
    b = baselines.select("baseline_id", F.col("sha256").alias("_b"), F.col("registered_at").alias("_b_at"))
    t = trials.select("trial_id", "experiment_id", "experiment_sha256", F.col("registered_at").alias("_t_at"))
    rows = requests.join(t, "trial_id", "left").join(e, "experiment_id", "left").join(b, "baseline_id", "left").withColumn("_p", F.try_element_at("partitions", F.col("partition")))
    known = F.greatest("_t_at", "_e_at", "_b_at") <= F.col("at")
    reason = first_reason(
        ("unknown_protocol_record", F.col("_t_at").isNull() | F.col("_e").isNull() | F.col("_b").isNull()),
        ("not_available_yet", ~F.coalesce(known, F.lit(False))),
        ("unknown_partition", F.col("_p").isNull()),
        ("protocol_binding_changed", ~(F.col("experiment_sha256").eqNullSafe(F.col("_e")) & F.col("baseline_sha256").eqNullSafe(F.col("_b")))),
        ("dataset_differs", ~F.col("dataset_sha256").eqNullSafe(F.col("_data"))),
    )
    rows = rows.select("request_id", "trial_id", "instrument_id", "at", "partition", F.col("_p.start").alias("start"), F.col("_p.end").alias("end"), reason.alias("reason"))
    final = rows.where("reason IS NULL AND partition = 'final_test'")
    firsts = final.groupBy("instrument_id", "trial_id", "start", "end").agg(F.min(F.struct("at", "request_id")).alias("_first")).select("*", "_first.*").drop("_first")
    took = consume(firsts, "instrument_id", ["at", "request_id"], "start", "end").select("trial_id", F.col("consumed").alias("_mine"), F.col("request_id").alias("_by"))
    out = rows.join(took, "trial_id", "left")
    final = F.col("reason").isNull() & (F.col("partition") == "final_test")
    why = F.when(final & ~F.col("_mine"), "final_test_period_consumed").otherwise(F.col("reason"))
    return out.select("request_id", why.alias("reason"), F.coalesce(final & F.col("_mine") & (F.col("_by") == F.col("request_id")), F.lit(False)).alias("consumed"), "start", "end")


def increasing(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, faults: places where ``value`` is not larger than that of the row before, or is null; strict order has none."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    later = F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1
    fault = F.col(value).isNull() | (later & ~F.coalesce(F.col(value) > before, F.lit(False)))
    return rows.select(key, fault.alias("_fault")).groupBy(key).agg(F.count_if("_fault").alias("faults"))


def observed_order(rows: DataFrame, key: str, order: str, observed_at: str, available_at: str) -> DataFrame:
    """rows with reason: seen before it was available, or out of order.

    Rows that became available at one instant are seen at one instant; otherwise each is seen later than the one before."""
    by = Window.partitionBy(key).orderBy(order)
    seen, known = F.lag(observed_at).over(by), F.lag(available_at).over(by)
    one = F.col(available_at) == known
    fine = F.when(one, F.col(observed_at) == seen).otherwise(F.col(observed_at) > seen)
    return rows.withColumn("reason", first_reason(("observed_early", ~F.coalesce(F.col(observed_at) >= F.col(available_at), F.lit(False))), ("not_increasing", seen.isNotNull() & ~F.coalesce(fine, F.lit(False)))))


def attributed_costs(fills: DataFrame, key: str, spread_bps: str, slippage_bps: str) -> DataFrame:
    """key, fills, commission, half_spread, slippage: exact sums over fills (quantity, open, fee) of what trading cost.

    Costs are shares of the session's open, whatever the fill's own price; sums are decimal(38,10)."""
    paid = F.abs(F.col("quantity").cast("decimal(12,2)")) * F.col("open").cast("decimal(12,2)")
    share = lambda bps, parts: (paid * F.lit(bps).cast("decimal(6,2)") * F.lit(parts).cast("decimal(6,5)")).cast("decimal(38,10)")
    return fills.groupBy(key).agg(
        F.count("*").alias("fills"),
        F.sum(F.col("fee").cast("decimal(18,4)")).alias("commission"),
        F.sum(share(spread_bps, "0.00005")).alias("half_spread"),
        F.sum(share(slippage_bps, "0.0001")).alias("slippage"),
    )


def execution_model(kind: Column) -> Column:
    """How an instrument of a kind is dealt in."""
    return F.when(kind == "mutual_fund", "nav_subscription_redemption").when(kind == "index", "reference_only").otherwise("exchange_orderbook")
