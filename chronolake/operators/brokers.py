"""Captured broker references: an account and its assets, normalised or quarantined; nothing here is an authorisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions import times
from chronolake.operators.captures import uuid_text
from chronolake.operators.evidence import currency, first_reason, required

ACCOUNT_FLAGS = ("trading_blocked", "account_blocked", "trade_suspended_by_user", "shorting_enabled")
ASSET_FLAGS = ("tradable", "marginable", "shortable", "easy_to_borrow", "fractionable")
AMOUNTS = ("cash", "buying_power", "equity")
INCREMENTS = ("min_order_size", "min_trade_increment", "price_increment")


def _text(value: str, name: str) -> Column:
    """The field as text where it is a JSON text, else null."""
    field = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(field, "$", "string"))


def _kind(value: str, name: str) -> Column:
    """The type of the field; VOID where it is null or not there."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")), F.lit("VOID"))


def _flags(value: str, names: tuple[str, ...]) -> tuple[dict[str, Column], Column]:
    wrong = F.lit(False)
    for n in names:
        wrong = wrong | ~_kind(value, n).isin("BOOLEAN", "VOID")
    return {n: F.try_variant_get(value, f"$.{n}", "boolean") for n in names}, wrong


def accounts(bundles: DataFrame) -> DataFrame:
    """import_id, native_id, account_number, status, currency, the amounts and flags, review_reasons, reason of each bundle.

    bundles: import_id, account (JSON), expected_native_id, expected_number.  A wrong account quarantines its whole bundle; a flag
    that is true or not known, a status that is not ACTIVE, or a missing currency is to be reviewed, in this order of reasons."""
    rows = bundles.select("import_id", uuid_text(F.col("expected_native_id")).alias("_id"), F.col("expected_number").alias("_number"), F.try_parse_json("account").alias("v"))
    flags, wrong = _flags("v", ACCOUNT_FLAGS)
    amounts = {n: times.number(_text("v", n)) for n in AMOUNTS}
    bad_amount = F.lit(False)
    for n in AMOUNTS:
        bad_amount = bad_amount | ((_kind("v", n) != "VOID") & (amounts[n].isNull() | (amounts[n] < 0)))
    native, number, status, unit = uuid_text(_text("v", "id")), _text("v", "account_number"), _text("v", "status"), _text("v", "currency")
    reason = first_reason(
        ("invalid_json", F.col("v").isNull()),
        ("account_object_required", ~F.schema_of_variant("v").startswith("OBJECT")),
        ("invalid_native_uuid", native.isNull()),
        ("invalid_required_text", ~required(number)),
        ("account_identity_mismatch", ~(native.eqNullSafe(F.col("_id")) & number.eqNullSafe(F.col("_number")))),
        ("invalid_currency", (_kind("v", "currency") != "VOID") & ~currency(unit)),
        ("invalid_boolean", wrong),
        ("invalid_required_text", ~required(status)),
        ("invalid_decimal", bad_amount),
    )
    doubts = [F.when(status != "ACTIVE", "account_not_active")]
    for n in ACCOUNT_FLAGS[:3]:
        doubts.append(F.when(flags[n].isNull(), f"{n}_unknown").when(flags[n], f"{n}_reported"))
    doubts.append(F.when(unit.isNull(), "currency_unknown"))
    good = reason.isNull()
    columns = {"native_id": native, "account_number": number, "status": status, "currency": unit, **amounts, **flags}
    return rows.select("import_id", *[F.when(good, c).alias(n) for n, c in columns.items()], F.when(good, F.array_compact(F.array(*doubts))).alias("review_reasons"), reason.alias("reason"))


def assets(bundles: DataFrame) -> DataFrame:
    """import_id, nth, native_id, symbol, exchange, status, the flags and increments, state, reason of each asset of each bundle.

    bundles: import_id, assets (JSON array).  A payload that is no array gives one row without nth.  Assets that share an id, or symbol and
    exchange, with another right one of the bundle are quarantined all.  The state of a right one is unmapped_reference if it is
    active and tradable, else restricted_reference: no asset is mapped to a listing here."""
    fields = ("id", "class", "asset_class", "exchange", "symbol", "status", *ASSET_FLAGS, *INCREMENTS)
    item = f"struct<{', '.join(f'{n}: variant' for n in fields)}>"
    # By bundle once, as all that is counted below is counted inside a bundle.  Fields are taken out once, as paths in each rule would be read for each; an item that is no object is null, and only then are items read one by one.
    read = bundles.select("import_id", "assets").repartition("import_id").select("import_id", F.try_parse_json("assets").alias("b"))
    read = read.withColumn("items", F.coalesce(F.try_variant_get("b", "$", f"array<{item}>"), F.transform(F.try_variant_get("b", "$", "array<variant>"), lambda v: F.try_variant_get(v, "$", item))))
    whole = F.when(F.col("b").isNull(), "invalid_json").when(F.col("items").isNull(), "assets_array_required")
    rows = read.select("import_id", whole.alias("_whole"), F.posexplode_outer("items").alias("nth", "f")).where("nth IS NOT NULL OR _whole IS NOT NULL")
    of = lambda n: F.col("f")[n]
    given = lambda n: F.coalesce(F.schema_of_variant(of(n)), F.lit("VOID")) != "VOID"
    text = lambda n: F.when(F.schema_of_variant(of(n)) == "STRING", F.try_variant_get(of(n), "$", "string"))
    wrong = F.exists(F.array(*[F.schema_of_variant(of(n)) for n in ASSET_FLAGS]), lambda kind: ~F.coalesce(kind, F.lit("VOID")).isin("BOOLEAN", "VOID"))
    flags, numbers = {n: F.try_variant_get(of(n), "$", "boolean") for n in ASSET_FLAGS}, {n: times.exact(of(n)) for n in INCREMENTS}
    texts = {"_id": text("id"), "_one": text("class"), "_other": text("asset_class"), "exchange": text("exchange"), "symbol": text("symbol"), "status": text("status")}
    rows = rows.select("import_id", "nth", F.coalesce("_whole", F.when(F.col("f").isNull(), "asset_object_required")).alias("_shape"), *[c.alias(n) for n, c in (texts | flags | numbers).items()], wrong.alias("_wrong"), (given("class") & given("asset_class")).alias("_both"), F.array(*map(given, INCREMENTS)).alias("_given"))
    bad, low = F.lit(False), F.lit(False)
    for i, n in enumerate(INCREMENTS):
        bad, low = bad | (F.col("_given")[i] & (F.col(n).isNull() | (F.col(n) < 0))), low | (F.col(n) <= 0)
    rows = rows.withColumns({"native_id": uuid_text(F.col("_id")), "_kind": F.coalesce("_one", "_other")})
    reason = F.coalesce("_shape", first_reason(
        ("conflicting_asset_class", F.col("_both") & ~F.col("_one").eqNullSafe(F.col("_other"))),
        ("invalid_required_text", ~required(F.col("_kind"))),
        ("unsupported_asset_class", F.col("_kind") != "us_equity"),
        ("invalid_native_uuid", F.col("native_id").isNull()),
        ("invalid_required_text", ~(required(F.col("exchange")) & required(F.col("symbol")) & required(F.col("status")))),
        ("invalid_boolean", F.col("_wrong")),
        ("invalid_decimal", bad),
        ("nonpositive_increment", low),
    ))
    columns = ("native_id", "symbol", "exchange", "status", *flags, *numbers)
    each = rows.select("import_id", "nth", reason.alias("_reason"), *columns)
    right = F.when(F.col("_reason").isNull(), 1)
    again = (F.count(right).over(Window.partitionBy("import_id", "native_id")) > 1) | (F.count(right).over(Window.partitionBy("import_id", "symbol", "exchange")) > 1)
    final = F.coalesce("_reason", F.when(again, "ambiguous_asset_identity"))
    state = F.when((F.col("status") == "active") & F.col("tradable"), "unmapped_reference").otherwise("restricted_reference")
    return each.select("import_id", "nth", *columns, F.when(final.isNull(), state).alias("state"), final.alias("reason"))


def bundle_states(bundles: DataFrame) -> DataFrame:
    """import_id, state, accepted, quarantined: an account that is wrong, or assets that are no array, quarantine a bundle; a
    quarantined asset or an account to review asks for review; else it is a normalized_reference."""
    account = accounts(bundles).select("import_id", F.col("reason").alias("_account"), F.size("review_reasons").alias("_doubts"))
    found = assets(bundles).groupBy("import_id").agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("quarantined"), F.bool_or(F.col("nth").isNull()).alias("_none"))
    rows = account.join(found, "import_id", "left").na.fill(0, ["accepted", "quarantined"])
    bad = F.col("_account").isNotNull()
    state = F.when(bad | F.coalesce("_none", F.lit(False)), "quarantined").when((F.col("quarantined") > 0) | (F.col("_doubts") > 0), "review_required").otherwise("normalized_reference")
    zero = F.lit(0).cast("long")
    return rows.select("import_id", state.alias("state"), F.when(bad, zero).otherwise(F.col("accepted")).alias("accepted"), F.when(bad, zero + 1).otherwise(F.col("quarantined")).alias("quarantined"))


#: Offline formats of a limit order: name of each field, and what it holds.
FORMATS = {
    "synthetic-symbol-paper": {"account": "account", "symbol": "symbol", "venue": "venue", "side": "side", "quantity": "quantity", "limit": "price", "order_type": "='limit'", "time_in_force": "tif", "session": "session", "client_order_id": "client_id"},
    "synthetic-contract-paper": {"account": "account", "contract_id": "native_id", "exchange": "venue", "action": "^side", "units": "quantity", "limit_price": "price", "order_type": "='LIMIT'", "duration": "^tif", "session": "session", "reference": "client_id"},
}


def encode(drafts: DataFrame, adapters: DataFrame) -> DataFrame:
    """intent_id, adapter_id, payload (JSON), reason of drafts, in the format of the one adapter of their account.

    drafts: intent_id, account, symbol, native_id, venue, side, quantity, price (texts), tif, session, client_id; adapters: account,
    environment, adapter_id.  An account with no adapter, several, one that is not of the paper environment or of no known format
    has a reason and no payload."""
    known = adapters.groupBy("account").agg(F.count("*").alias("_n"), F.max("adapter_id").alias("adapter_id"), F.max("environment").alias("_env"))
    rows = drafts.join(known, "account", "left")
    reason = first_reason(("no_adapter", F.col("_n").isNull()), ("several_adapters", F.col("_n") > 1), ("paper_only", ~F.col("_env").eqNullSafe("paper")), ("unknown_format", ~F.coalesce(F.col("adapter_id").isin(*FORMATS), F.lit(False))))
    value = lambda x: F.lit(x[2:-1]) if x[0] == "=" else F.upper(x[1:]) if x[0] == "^" else F.col(x)
    payload = F.coalesce(*[F.when(F.col("adapter_id") == name, F.to_json(F.struct(*[value(x).cast("string").alias(k) for k, x in sorted(fields.items())]))) for name, fields in FORMATS.items()])
    return rows.select("intent_id", "adapter_id", F.when(reason.isNull(), payload).alias("payload"), reason.alias("reason"))
