"""Normalised daily records, and days replayed from what was known of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.functions import times
from chronolake.operators.evidence import currency, first_reason, required

KINDS = ("session", "bar", "split", "cash_dividend")
FIELDS = ("currency", "date", "end", "kind", "listing_id", "start", "values")
VALUES = {"session": ("timezone",), "bar": ("close", "high", "low", "open", "price_kind", "volume"), "split": ("new_shares", "old_shares"), "cash_dividend": ("amount", "payment_date")}


def records(raw: DataFrame, listings: DataFrame) -> DataFrame:
    """record_id, kind, listing_id, day, valid_from, valid_to, known_at, body (values, VARIANT), reason of one JSON object a row.

    raw: record_id, payload, published_at, received_at, processed_at; listings: listing_id, trading_currency.  Numbers are plain decimal
    texts.  In order: times out of order, no JSON object (repeated keys are none), other fields than the record's, an unknown kind, a
    listing that is unknown or trades in another currency, no canonical day, an empty interval, then the rules of the kind."""
    v = F.try_parse_json("payload")
    rows = raw.select("record_id", "published_at", "received_at", F.col("processed_at").alias("known_at"), v.alias("v"), F.array_sort(F.json_object_keys("payload")).alias("_keys"))
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "STRING", F.try_variant_get("v", path, "string"))
    rows = rows.withColumns({"kind": text("$.kind"), "listing_id": text("$.listing_id"), "_currency": text("$.currency"), "_date": text("$.date"), "valid_from": times.instant(text("$.start")), "valid_to": times.instant(text("$.end")), "body": F.try_variant_get("v", "$.values", "variant")})
    rows = rows.withColumns({"day": F.when(F.col("_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("_date").try_cast("date")), "_fields": F.array_sort(F.map_keys(F.try_variant_get("body", "$", "map<string,variant>")))})
    rows = rows.join(listings.select("listing_id", F.col("trading_currency").alias("_trades")), "listing_id", "left")
    n = lambda c: times.number(text(f"$.values.{c}"))
    is_ = lambda k: F.col("kind") == k
    no = lambda c: ~F.coalesce(c, F.lit(False))
    shape = F.lit(False)
    for kind, fields in VALUES.items():
        shape = shape | (is_(kind) & (F.col("_fields") == F.array(*map(F.lit, fields))))
    zone = text("$.values.timezone")
    there = F.when(times.known_zone(zone), zone)
    local = (F.to_date(F.from_utc_timestamp("valid_from", there)) == F.col("day")) & (F.to_date(F.from_utc_timestamp("valid_to", there)) == F.col("day"))
    prices = [n(c) for c in ("open", "close", "low", "high")]
    positive = F.forall(F.array(*prices), lambda x: x > 0) & (n("volume") >= 0)
    paid = text("$.values.payment_date")
    reason = first_reason(
        ("times_out_of_order", no((F.col("published_at") <= F.col("received_at")) & (F.col("received_at") <= F.col("known_at")))),
        ("invalid_json_object", F.col("v").isNull() | F.col("_keys").isNull()),
        ("unexpected_fields", no((F.col("_keys") == F.array(*map(F.lit, FIELDS))) & F.col("_fields").isNotNull())),
        ("unsupported_kind", no(F.col("kind").isin(*KINDS))),
        ("listing_or_currency", no(required(F.col("listing_id")) & currency(F.col("_currency")) & (F.col("_trades") == F.col("_currency")))),
        ("invalid_date", F.col("day").isNull()),
        ("empty_interval", no(F.col("valid_from") < F.col("valid_to"))),
        ("unexpected_values", no(shape)),
        ("unknown_timezone", is_("session") & there.isNull()),
        ("session_not_on_its_day", is_("session") & no(local)),
        ("adjusted_price", is_("bar") & no(text("$.values.price_kind") == "raw")),
        ("invalid_amount", (is_("bar") & no(positive)) | (is_("split") & no((n("new_shares") > 0) & (n("old_shares") > 0))) | (is_("cash_dividend") & no(n("amount") >= 0))),
        ("invalid_ohlc_bounds", is_("bar") & no((prices[2] <= F.least(*prices[:2])) & (F.greatest(*prices[:2]) <= prices[3]))),
        ("published_before_end", is_("bar") & (F.col("valid_to") > F.col("published_at"))),
        ("invalid_payment_date", is_("cash_dividend") & no(paid.rlike(r"^\d{4}-\d{2}-\d{2}$") & (paid.try_cast("date") >= F.col("day")))),
    )
    return rows.select("record_id", "kind", "listing_id", "day", "valid_from", "valid_to", "known_at", "body", reason.alias("reason"))


def snapshot_id(kind: str, target: str, valid_from: str, known_at: str, evidence: str, body: Column) -> Column:
    """A deterministic id of a snapshot's fields."""
    parts = times.canonical_json(kind=F.col(kind), target=F.col(target).cast("string"), valid_from=F.unix_micros(valid_from), known_at=F.unix_micros(known_at), evidence=F.col(evidence).cast("string"), body=body)
    return F.sha2(parts, 256)


def days(snapshots: DataFrame, expected: DataFrame, as_of: Column) -> DataFrame:
    """listing_id, day, state, missing, valid_from, valid_to, records of every expected day (listing_id, day).

    snapshots: listing_id, day, kind, valid_from, valid_to, known_at, record.  Of each start the version last known at ``as_of``
    counts.  state: ambiguous (a kind has several starts), gap (session or bar is missing; ``missing`` names them), mismatch (bar and
    session differ in start or end), or complete.  Splits and dividends are optional; records has those of the day by kind."""
    known = snapshots.where((F.col("known_at") <= as_of) & F.col("kind").isin(*KINDS))
    last = known.groupBy("listing_id", "day", "kind", "valid_from").agg(F.max_by(F.struct("valid_to", "record"), F.struct("known_at", "record")).alias("v"))
    of = lambda k: F.when(F.col("kind") == k, F.struct("valid_from", F.col("v.valid_to").alias("valid_to"), F.col("v.record").alias("record")))
    found = last.groupBy("listing_id", "day").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS], *[F.max(of(k)).alias(k) for k in KINDS])
    rows = expected.select("listing_id", "day").join(found, ["listing_id", "day"], "left").na.fill(0, [f"n_{k}" for k in KINDS])
    several = F.lit(False)
    for k in KINDS:
        several = several | (F.col(f"n_{k}") > 1)
    missing = F.array_compact(F.array(*[F.when(F.col(f"n_{k}") == 0, k) for k in KINDS[:2]]))
    same = (F.col("session.valid_from") == F.col("bar.valid_from")) & (F.col("session.valid_to") == F.col("bar.valid_to"))
    state = F.when(several, "ambiguous").when(F.size(missing) > 0, "gap").when(~same, "mismatch").otherwise("complete")
    held = F.when(state == "complete", F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}.record").alias("record")) for k in KINDS]), lambda e: e["record"].isNotNull())))
    return rows.select("listing_id", "day", state.alias("state"), missing.alias("missing"), F.when(state == "complete", F.col("bar.valid_from")).alias("valid_from"), F.when(state == "complete", F.col("bar.valid_to")).alias("valid_to"), held.alias("records"))


def omitted_events(snapshots: DataFrame, declared: DataFrame, first: Column, last: Column, as_of: Column) -> DataFrame:
    """listing_id, day, kind of the splits and dividends known at ``as_of`` on days from ``first`` to ``last`` that are not declared.

    declared: listing_id, day.  A valuation over the declared days would leave them out, so it must not be made while there are any."""
    known = snapshots.where((F.col("known_at") <= as_of) & F.col("kind").isin("split", "cash_dividend") & F.col("day").between(first, last))
    return known.select("listing_id", "day", "kind").distinct().join(declared.select("listing_id", "day"), ["listing_id", "day"], "left_anti")
