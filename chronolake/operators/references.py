"""Intents and drafts with their references looked up: what held at the time of the decision, as known at that time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.operators.bitemporal import snapshots_for
from chronolake.operators.evidence import first_reason
from chronolake.operators.futures import drafts, opening_preview
from chronolake.sources.shared import stored

_TERMS = "tick_size string, multiplier string, settlement string, last_trade_at timestamp, entry_cutoff_at timestamp"
_SCHEDULE = "sessions array<struct<opens_at: timestamp, closes_at: timestamp>>"
_MARGIN = "initial string, maintenance string, currency string"
_RULES = "prepare_enabled boolean, rules array<struct<asset_kind: string, time_in_force: string, session: string, fractional_quantity: boolean>>"
_NATIVE = "native_id string, symbol string, venue_mic string, currency string, price_tick string, quantity_step string, minimum_quantity string"


def target(*parts: str | Column) -> Column:
    """The text that names a target by its parts, as snapshots carry it; null where a part is."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    known = F.lit(True)
    for c in columns:
        known = known & c.isNotNull()
    return F.when(known, F.to_json(F.array(*[c.cast("string") for c in columns])))


def references(requests: DataFrame, snapshots: DataFrame, request: str, at: Column, lookups: dict[str, Column]) -> DataFrame:
    """request and, for each kind of ``lookups``, a struct of status (resolved, unknown, ambiguous), body and snapshot_id.

    requests: request (unique).  snapshots: kind, target, valid_from, valid_to, known_at, snapshot_id, body (JSON).  lookups: kind -> the target asked for.
    Every look-up of a request is a row of its kind, so all kinds are resolved by one pass over the snapshots, and one more shuffle
    brings them back to a row a request; a null target is unknown."""
    ask = F.array(*[F.struct(F.lit(kind).alias("kind"), name.alias("target")) for kind, name in lookups.items()])
    asked = requests.select(F.col(request).alias("_of"), at.alias("effective_at"), at.alias("as_of"), F.explode(ask).alias("_ask"))
    asked = asked.select(F.struct("_of", "_ask.kind").alias("_id"), "_ask.kind", "_ask.target", "effective_at", "as_of")
    said = snapshots.where(F.col("kind").isin(*lookups)).select("kind", "target", "valid_from", "valid_to", "known_at", F.struct("snapshot_id", "body").alias("_said"))
    found = snapshots_for(asked, said, "_id", ["kind", "target"], "_said")
    told = F.struct("status", F.col("_said.body").alias("body"), F.col("_said.snapshot_id").alias("snapshot_id"))
    return found.groupBy(F.col("_id._of").alias(request)).agg(*[F.max(F.when(F.col("_id.kind") == kind, told)).alias(kind) for kind in lookups])


def previewed(intents: DataFrame, contracts: DataFrame, snapshots: DataFrame, max_contracts: int, max_notional: str, margin_buffer: str, allow_short: bool) -> DataFrame:
    """intent_id, contract_id, notional, initial_margin, maintenance_margin, snapshot_ids, reason of opening intents; ``futures.opening_preview`` with its four look-ups.

    intents: intent_id (unique), broker, account, identifier, decision_at, quantity, price, price_kind, collateral_account, observed_at, expires_at, available, currency.
    contracts: contract_id (unique), product_id, quote_currency.  snapshots: see ``references``; kinds binding, by broker and identifier, terms, by contract, schedule, by
    product, and margin, by broker, account and contract.  Whatever is not exactly one snapshot, or no registered contract, is a reason
    of its own, in the order in which the look-ups depend on each other; amounts are null then.

    A binding names the contract that the other look-ups need, so there are two passes, not four."""
    bound = references(intents, snapshots, "intent_id", F.col("decision_at"), {"binding": target("broker", "identifier")})
    rows = intents.join(bound, "intent_id", "left").withColumn("contract_id", F.get_json_object("binding.body", "$.contract_id"))
    rows = rows.join(contracts.select("contract_id", "product_id", "quote_currency", F.lit(True).alias("_registered")), "contract_id", "left")
    rows = stored(rows, "bound")
    rest = references(rows, snapshots, "intent_id", F.col("decision_at"), {"terms": target("contract_id"), "schedule": target("product_id"), "margin": target("broker", "account", "contract_id")})
    rows = rows.join(rest, "intent_id", "left")
    terms, schedule, margin = F.from_json("terms.body", _TERMS), F.from_json("schedule.body", _SCHEDULE), F.from_json("margin.body", _MARGIN)
    rows = rows.withColumns({"_terms": terms, "_schedule": schedule, "_margin": margin})
    at = F.col("decision_at")
    rows = rows.select("*", F.col("_terms.multiplier").alias("multiplier"), F.col("_terms.tick_size").alias("tick"), F.col("_terms.settlement").alias("settlement"), F.col("_terms.entry_cutoff_at").alias("entry_cutoff_at"), F.col("_terms.last_trade_at").alias("last_trade_at"),
                       F.col("_margin.initial").alias("initial"), F.col("_margin.maintenance").alias("maintenance"), F.col("_margin.currency").alias("margin_currency"),
                       F.exists("_schedule.sessions", lambda s: (s["opens_at"] <= at) & (at < s["closes_at"])).alias("is_open"))
    judged = opening_preview(rows, max_contracts, max_notional, margin_buffer, allow_short)
    missing = lambda kind: ~F.coalesce(F.col(f"{kind}.status") == "resolved", F.lit(False))
    status = lambda kind: F.concat(F.lit(f"{kind}_"), F.coalesce(f"{kind}.status", F.lit("unknown")))
    # The checks of the intent alone come first; what they need of a look-up comes as soon as it is known to be missing.
    own = F.when(F.col("reason").isin("invalid_quantity", "adjusted_price", "collateral_of_another_account", "collateral_stale"), F.col("reason"))
    found = F.coalesce(F.when(missing("binding"), status("binding")), F.when(F.col("_registered").isNull(), F.lit("contract_unknown")), F.when(missing("terms"), status("terms")))
    dated = F.when(F.col("reason").isin("past_entry_cutoff", "physical_delivery", "off_tick"), F.col("reason"))
    final = F.coalesce(own, found, dated, F.when(missing("schedule"), status("schedule")), F.when(F.col("reason") == "session_closed", F.col("reason")), F.when(missing("margin"), status("margin")), F.col("reason"))
    judged = judged.withColumn("_final", final)
    fine = F.col("_final").isNull()
    ids = F.array("binding.snapshot_id", "terms.snapshot_id", "schedule.snapshot_id", "margin.snapshot_id")
    return judged.select("intent_id", "contract_id", *[F.when(fine, F.col(c)).alias(c) for c in ("notional", "initial_margin", "maintenance_margin")], F.when(fine, ids).alias("snapshot_ids"), F.col("_final").alias("reason"))


def _alike(intents: DataFrame, snapshots: DataFrame) -> DataFrame:
    """intent_id of intents whose instrument shares, when they are prepared, a native identity with another instrument of their account.

    Only identities that two instruments of an account ever had can clash; the other instruments of such an identity are looked up
    at the intent's time like any reference."""
    native = F.from_json("body", _NATIVE)
    said = snapshots.where("kind = 'instrument'").select("target", native.alias("n")).withColumn("account", F.from_json("target", "array<string>")[0])
    names = F.array(F.to_json(F.array(F.lit("id"), "n.native_id")), F.to_json(F.array("n.symbol", "n.venue_mic", "n.currency")))
    held = said.select("account", "target", F.explode(names).alias("_name")).distinct()
    shared = held.groupBy("account", "_name").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    held = held.join(shared, ["account", "_name"], "left_semi")
    own = intents.select("intent_id", "account", target("account", "asset_kind", "internal_id").alias("target"), "prepared_at")
    pairs = own.join(held, ["account", "target"]).join(held.withColumnRenamed("target", "_other"), ["account", "_name"]).where("target <> _other")
    pairs = pairs.select(F.struct("intent_id", "_other", "_name").alias("_pair"), "intent_id", "target", "_other", "_name", "prepared_at")
    mine = references(pairs, snapshots.where("kind = 'instrument'"), "_pair", F.col("prepared_at"), {"instrument": F.col("target")})
    other = references(pairs, snapshots.where("kind = 'instrument'"), "_pair", F.col("prepared_at"), {"instrument": F.col("_other")}).withColumnRenamed("instrument", "other")
    told = mine.join(other, "_pair").select("_pair", F.from_json("instrument.body", _NATIVE).alias("a"), F.from_json("other.body", _NATIVE).alias("b"))
    place = lambda s: F.struct(f"{s}.symbol", f"{s}.venue_mic", f"{s}.currency")
    return told.where((F.col("a.native_id") == F.col("b.native_id")) | (place("a") == place("b"))).select(F.col("_pair.intent_id").alias("intent_id")).distinct()


def prepared(intents: DataFrame, snapshots: DataFrame) -> DataFrame:
    """intent_id, client_id, snapshot_ids, reason (null: can be prepared) of limit orders; ``futures.drafts`` with its look-ups at prepared_at.

    intents: intent_id (unique), account, environment, asset_kind, internal_id, decision_at, valid_until, prepared_at, price_kind, time_in_force, session, quantity,
    price.  snapshots: see ``references``; kinds capabilities, by account, instrument, by account, asset kind and internal id, and terms of futures, by internal id,
    all in one pass.  An instrument that shares its native id, or symbol, venue and currency, with another one its account
    holds then is ambiguous; a look-up that is not exactly one snapshot is a reason."""
    kind = F.col("asset_kind")
    asked = {"capabilities": target("account"), "instrument": target("account", "asset_kind", "internal_id"), "terms": F.when(kind == "future", target("internal_id"))}
    rows = intents.join(references(intents, snapshots, "intent_id", F.col("prepared_at"), asked), "intent_id", "left")
    rows = stored(rows, "looked_up").join(_alike(intents, snapshots).withColumn("_alike", F.lit(True)), "intent_id", "left")
    caps, native, terms = F.from_json("capabilities.body", _RULES), F.from_json("instrument.body", _NATIVE), F.from_json("terms.body", _TERMS)
    rows = rows.withColumns({"_caps": caps, "_native": native, "_terms": terms})
    rule = F.filter("_caps.rules", lambda r: (r["asset_kind"] == F.col("asset_kind")) & (r["time_in_force"] == F.col("time_in_force")) & (r["session"] == F.col("session")))
    rows = rows.withColumn("_rule", F.try_element_at(rule, F.lit(1)))
    rows = rows.select("*", F.col("_caps.prepare_enabled").alias("enabled"), F.col("_rule.asset_kind").alias("rule_kind"), F.col("_rule.fractional_quantity").alias("fractional"), F.col("_native.minimum_quantity").cast("decimal(18,6)").alias("minimum"), F.col("_native.quantity_step").alias("step"), F.col("_native.price_tick").alias("price_tick"))
    texts = {c: F.col(c).cast("string") for c in ("account", "intent_id")}  # a client id is made of texts
    judged = drafts(rows.drop("capabilities", "instrument", "terms").withColumns(texts)).select(F.col("intent_id").alias("_intent"), "client_id", F.col("reason").alias("_reason"))
    rows = rows.join(judged, texts["intent_id"] == F.col("_intent"))
    missing = lambda k: F.when(~F.coalesce(F.col(f"{k}.status") == "resolved", F.lit(False)), F.concat(F.lit(f"{k}_"), F.coalesce(f"{k}.status", F.lit("unknown"))))
    among = lambda *names: F.when(F.col("_reason").isin(*names), F.col("_reason"))
    future, at = kind == "future", F.col("prepared_at")
    dated = first_reason(
        ("off_tick_of_terms", F.coalesce(F.col("price").cast("decimal(18,6)") % F.col("_terms.tick_size").cast("decimal(18,6)") != 0, F.lit(True))),
        ("outside_settlement_or_entry", ~F.coalesce((F.col("_terms.settlement") == "cash") & (at < F.col("_terms.entry_cutoff_at")) & (at < F.col("_terms.last_trade_at")), F.lit(False))),
    )
    final = F.coalesce(
        among("live_disabled", "not_known_or_expired", "adjusted_price"), missing("capabilities"), among("preparation_disabled", "unsupported_combination"), missing("instrument"),
        F.when(F.col("_alike"), F.lit("ambiguous_native_identity")), among("lot_or_fraction", "off_tick", "whole_contracts"), F.when(future, F.coalesce(missing("terms"), dated)), F.col("_reason"))
    rows = rows.withColumn("reason", final)
    ids = F.array_compact(F.array("capabilities.snapshot_id", "instrument.snapshot_id", "terms.snapshot_id"))
    return rows.select("intent_id", "client_id", F.when(F.col("reason").isNull(), ids).alias("snapshot_ids"), "reason")
