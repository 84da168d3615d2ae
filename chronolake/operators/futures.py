"""Exact price arithmetic of futures contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.operators.bitemporal import containing, overlaps_earlier, snapshots_for


def on_grid(price: Column, tick: str | Column) -> Column:
    """Whether a price, negative ones too, is a whole number of ticks; null stays null."""
    return price.cast("decimal(18,6)") % F.lit(tick).cast("decimal(18,6)") == 0  # lit leaves a column as it is


def gross_pnl(entry: Column, exit_: Column, multiplier: str, quantity: Column) -> Column:
    """(exit - entry) * multiplier * quantity as an exact decimal(38,8); a short position has a negative quantity."""
    moved = exit_.cast("decimal(15,6)") - entry.cast("decimal(15,6)")
    return moved * F.lit(multiplier).cast("decimal(11,2)") * quantity.cast("int").cast("decimal(10,0)")


def opening_preview(intents: DataFrame, max_contracts: int, max_notional: str, margin_buffer: str, allow_short: bool) -> DataFrame:
    """Intents with notional, initial_margin, maintenance_margin and reason (null: passes), by the first check that fails.

    intents have the snapshots that hold at their decision_at beside them, null where none was resolved: quantity, price,
    price_kind, decision_at, account, collateral_account, observed_at, expires_at, available, currency, quote_currency,
    margin_currency, initial, maintenance, multiplier, tick, settlement, entry_cutoff_at, last_trade_at, is_open."""
    q, at = F.col("quantity").cast("decimal(9,0)"), F.col("decision_at")
    notional = F.abs(F.col("price").cast("decimal(15,6)") * F.col("multiplier").cast("decimal(11,2)") * q)
    initial = F.col("initial").cast("decimal(16,4)") * F.abs(q) * F.lit(margin_buffer).cast("decimal(8,4)")
    rows = intents.withColumns({"notional": notional, "initial_margin": initial, "maintenance_margin": F.col("maintenance").cast("decimal(16,4)") * F.abs(q)})
    holds = lambda c: F.coalesce(c, F.lit(False))
    checks = [
        ("invalid_quantity", holds((q != 0) & (q == F.col("quantity")))),
        ("adjusted_price", holds(F.col("price_kind") == "raw_contract")),
        ("collateral_of_another_account", holds(F.col("collateral_account") == F.col("account"))),
        ("collateral_stale", holds((F.col("observed_at") <= at) & (at < F.col("expires_at")))),
        ("terms_unresolved", F.col("multiplier").isNotNull() & F.col("tick").isNotNull()),
        ("past_entry_cutoff", holds((at < F.col("entry_cutoff_at")) & (at < F.col("last_trade_at")))),
        ("physical_delivery", holds(F.col("settlement") != "physical")),
        ("off_tick", holds(on_grid(F.col("price"), F.col("tick")))),
        ("session_closed", holds(F.col("is_open"))),
        ("margin_unresolved", F.col("initial").isNotNull() & F.col("maintenance").isNotNull()),
        ("cross_currency", holds((F.col("currency") == F.col("quote_currency")) & (F.col("margin_currency") == F.col("currency")))),
        ("intent_limit", holds((F.abs(q) <= max_contracts) & ((q > 0) | F.lit(allow_short)))),
        ("notional_or_collateral", holds((F.col("notional") <= F.lit(max_notional).cast("decimal(24,4)")) & (F.col("initial_margin") <= F.col("available")))),
    ]
    return rows.withColumn("reason", F.coalesce(*[F.when(~passes, name) for name, passes in checks]))


def drafts(intents: DataFrame) -> DataFrame:
    """intent_id, client_id, reason (null: can be prepared) of limit orders beside their capability rule and binding.

    intents: account, intent_id, environment, decision_at, valid_until, prepared_at, price_kind, enabled, rule_kind (null: no
    rule for this asset, time in force and session), fractional, quantity, minimum, step, price, price_tick.  The client id
    depends on account and intent alone, so a retry has the same one."""
    at, q = F.col("prepared_at"), F.col("quantity").cast("decimal(18,6)")
    holds = lambda c: F.coalesce(c, F.lit(False))
    checks = [
        ("live_disabled", holds(F.col("environment") == "paper")),
        ("not_known_or_expired", holds((F.col("decision_at") <= at) & (at < F.col("valid_until")))),
        ("adjusted_price", holds(F.col("price_kind") == "raw_contract")),
        ("preparation_disabled", holds(F.col("enabled"))),
        ("unsupported_combination", F.col("rule_kind").isNotNull()),
        ("lot_or_fraction", holds((q >= F.col("minimum")) & on_grid(q, F.col("step")) & (F.col("fractional") | (q == F.floor(q))))),
        ("off_tick", holds(on_grid(F.col("price"), F.col("price_tick")))),
        ("whole_contracts", (F.col("rule_kind") != "future") | (q == F.floor(q))),
        ("price_not_positive", (F.col("rule_kind") == "future") | (F.col("price") > 0)),
    ]
    client = F.substring(F.sha2(F.to_json(F.array("account", "intent_id")), 256), 1, 32)
    return intents.select("intent_id", client.alias("client_id"), F.coalesce(*[F.when(~passes, name) for name, passes in checks]).alias("reason"))


def session_of(points: DataFrame, sessions: DataFrame, key: str, at: str) -> DataFrame:
    """points with session (the start of the declared session [opens_at, closes_at) that holds them, or null) and is_open.

    sessions: key, opens_at, closes_at, in order and without overlaps (see ``session_faults``).  Breaks between sessions are closed."""
    spans = sessions.select(key, "opens_at", "closes_at")
    found = containing(points, spans.withColumn("_start", F.col("opens_at")), key, at, "opens_at", "closes_at", "_start", "session")
    return found.withColumn("is_open", F.col("session").isNotNull())


def session_faults(sessions: DataFrame, key: str) -> DataFrame:
    """Sessions that are empty or begin before an earlier one has ended; touching ones are fine."""
    last = sessions.withColumn("_last", F.col("closes_at") - F.expr("INTERVAL 1 MICROSECOND"))
    marked = overlaps_earlier(last, key, "opens_at", "_last", "closes_at").drop("_last")
    return marked.where(F.col("overlaps") | ~F.coalesce(F.col("opens_at") < F.col("closes_at"), F.lit(False))).drop("overlaps")


def terms_for(requests: DataFrame, contracts: DataFrame, products: DataFrame, snapshots: DataFrame) -> DataFrame:
    """request, root, venue_mic, quote_currency, status, tick_size, multiplier, settlement, last_trade_at, entry_cutoff_at.

    requests: request, contract_id, effective_at, as_of.  contracts: contract_id, product_id.  products: product_id, root, venue_mic, quote_currency.
    snapshots: contract_id, valid_from, valid_to, known_at and the terms.  status is that of the terms as known at as_of for
    effective_at: resolved, unknown or ambiguous; unknown_contract where the contract or its product is not registered."""
    terms = ("tick_size", "multiplier", "settlement", "last_trade_at", "entry_cutoff_at")
    known = contracts.select("contract_id", "product_id").join(products.select("product_id", "root", "venue_mic", "quote_currency"), "product_id")
    found = snapshots_for(requests, snapshots.withColumn("_terms", F.struct(*terms)), "request", ["contract_id"], "_terms")
    rows = requests.select("request", "contract_id").join(known, "contract_id", "left").join(found, "request")
    unknown = F.col("root").isNull()
    return rows.select("request", "root", "venue_mic", "quote_currency", F.when(unknown, "unknown_contract").otherwise(F.col("status")).alias("status"), *[F.when(~unknown, F.col("_terms")[t]).alias(t) for t in terms])
