"""Exact cash and position ledgers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Context, Decimal, localcontext
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators.bitemporal import by_day

AMOUNT = r"^(0|[1-9][0-9]{0,24})(\.[0-9]{1,18})?$"
#: What each kind of event has besides event_id, kind, occurred_at, observed_at, currency, origin and source_ref.
FIELDS = {"opening_cash": ("amount",), "buy": ("instrument_id", "quantity", "price", "fee"), "sell": ("instrument_id", "quantity", "price", "fee"), "split": ("instrument_id", "numerator", "denominator"), "dividend": ("instrument_id", "amount")}
POSITIVE = ("quantity", "price", "numerator", "denominator")
ORIGINS = ("synthetic_fixture", "externally_supplied_simulation")
_FOLDED = ["sequence", "kind", "occurred_at", "currency", "origin", "instrument_id", "amount", "quantity", "price", "fee", "numerator", "denominator"]


def running_cash(events: DataFrame, account: str, order: list[str], amount: Column) -> DataFrame:
    """Events with cash: the decimal running sum of the signed amounts of an account; null amounts add nothing.

    Events are sorted inside an account's day, and earlier days are one sum each, so an account with most events is dealt to many tasks."""
    rows = events.withColumns({"_amount": amount, "_part": by_day(F.col(order[0]), dict(events.dtypes)[order[0]])})
    days = rows.groupBy(account, "_part").agg(F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy(account).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(F.col(account).alias("_a"), F.col("_part").alias("_p"), F.sum("_sum").over(earlier).alias("_before"))
    inside = Window.partitionBy(account, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.sum("_amount").over(inside)).join(carried, F.col(account).eqNullSafe(F.col("_a")) & F.col("_part").eqNullSafe(F.col("_p")), "left")
    return rows.withColumn("cash", F.coalesce(F.col("_before") + F.col("_in"), "_before", "_in")).drop("_amount", "_part", "_before", "_in", "_a", "_p")


def validate(events: DataFrame) -> DataFrame:
    """events with reason (null: valid), each row by itself.

    events have all fields as columns, texts and (occurred_at, observed_at) timestamps, null where an event has none.  Amounts
    are plain decimal texts of up to 25 digits before the point and 18 after it."""
    extra = sorted({f for fields in FIELDS.values() for f in fields})
    shape = F.lit(False)
    for kind, fields in FIELDS.items():
        fits = F.col("kind") == kind
        for f in extra:
            fits = fits & (F.col(f).isNotNull() if f in fields else F.col(f).isNull())
        shape = shape | F.coalesce(fits, F.lit(False))
    text = lambda c: F.coalesce(F.col(c).rlike(r"\S"), F.lit(False))
    wrong = F.lit(False)
    for f in extra:
        if f != "instrument_id":
            plain = F.col(f).rlike(AMOUNT)
            wrong = wrong | (F.col(f).isNotNull() & ~(plain & F.col(f).rlike("[1-9]") if f in POSITIVE else plain))
    checks = [
        ("unsupported_kind_or_fields", ~shape),
        ("identity_required", ~(text("event_id") & text("source_ref"))),
        ("unsupported_origin", ~F.coalesce(F.col("origin").isin(*ORIGINS), F.lit(False))),
        ("invalid_currency", ~F.coalesce(F.col("currency").rlike("^[A-Z]{3}$"), F.lit(False))),
        ("observed_before_event", ~F.coalesce(F.col("occurred_at") <= F.col("observed_at"), F.lit(False))),
        ("instrument_required", F.col("instrument_id").isNotNull() & ~text("instrument_id")),
        ("invalid_amount", wrong),
    ]
    return events.withColumn("reason", F.coalesce(*[F.when(c, name) for name, c in checks]))


class _Account:
    """The state of one ledger; it stops at the first event that does not fit."""

    def __init__(self):
        self.cash, self.positions = Decimal(0), {}
        self.opened = self.last = self.error = None

    def apply(self, e: dict) -> None:
        kind, who = e["kind"], (e["currency"], e["origin"])
        held = self.positions.get(e["instrument_id"], Decimal(0))
        n = {f: Decimal(e[f]) for f in ("amount", "quantity", "price", "fee", "numerator", "denominator") if e[f] is not None}
        if self.opened is None and kind != "opening_cash":
            self.error = "opening_cash_required"
        elif self.opened is not None and (kind == "opening_cash" or who != self.opened):
            self.error = "one_opening_currency_and_origin"
        elif self.last is not None and e["occurred_at"] < self.last:
            self.error = "not_chronological"
        elif kind == "sell" and n["quantity"] > held:
            self.error = "short_position"
        elif kind in ("split", "dividend") and held <= 0:
            self.error = "position_required"
        if self.error:
            return
        cash, position = self.cash, held
        if kind in ("opening_cash", "dividend"):
            cash += n["amount"]
        elif kind == "buy":
            cash, position = cash - n["quantity"] * n["price"] - n["fee"], held + n["quantity"]
        elif kind == "sell":
            cash, position = cash + n["quantity"] * n["price"] - n["fee"], held - n["quantity"]
        else:
            after = Fraction(held) * Fraction(n["numerator"]) / Fraction(n["denominator"])
            if after.denominator % 1 or 10**18 % after.denominator:  # not a decimal of 18 places
                self.error = "split_is_no_short_decimal"
                return
            position = Decimal(after.numerator) / Decimal(after.denominator)
        if cash < 0:
            self.error = "negative_cash"
            return
        self.opened, self.last, self.cash = who, e["occurred_at"], cash
        if e["instrument_id"] is not None:
            self.positions[e["instrument_id"]] = position


def plain(x: Decimal) -> str:
    """Text of a decimal without exponent and without zeros at its end."""
    text = format(x, "f")
    return re.sub(r"\.?0+$", "", text) if "." in text else text


def fold(events: DataFrame, account: str) -> DataFrame:
    """account, sequence, kind, instrument_id, cash, position (of that instrument), error after each event, in order of ``sequence``.

    events: account, sequence and the fields of ``validate``, which they have passed.  Amounts are exact, however many digits: cash and
    positions are texts of plain decimals.  A ledger stops at its first error, its last good cash and position stand beside it, and
    later events have the error too.  Events are sorted within partitions and streamed: a task holds the positions of one account,
    not its events; the events of an account depend on each other, so they pass one task in order."""
    id_type = events.schema[account].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, begun = _Account(), None, False
        with localcontext(Context(prec=200)):
            for batch in batches:
                out = []
                for e in batch.to_pylist():
                    if not begun or e[account] != current:
                        state, current, begun = _Account(), e[account], True
                    if state.error is None:
                        state.apply(e)
                    held = state.positions.get(e["instrument_id"])
                    out.append((plain(state.cash), None if held is None else plain(held), state.error))
                columns = [batch.column(c) for c in (account, "sequence", "kind", "instrument_id")]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.string()) for x in zip(*out, strict=True))] if out else [*columns, *[pa.array([], pa.string())] * 3], names=[account, "sequence", "kind", "instrument_id", "cash", "position", "error"])

    # By a hash of its own: a shuffle by the account is left out where events seem to be so dealt, as after a union, whose sides Spark may yet cut differently.
    rows = events.select(account, F.col("sequence").cast("long").alias("sequence"), *_FOLDED[1:]).repartition(F.xxhash64(account)).sortWithinPartitions(account, "sequence")
    return rows.mapInArrow(run, f"`{account}` {id_type}, sequence long, kind string, instrument_id string, cash string, position string, error string")


def state_as_of(journal: DataFrame, account: str, cutoff: Column) -> DataFrame:
    """account, cash, events, error, positions (instrument -> text, none of zero) of the events recorded up to ``cutoff``.

    A journal whose sequence is not dense or whose recorded_at goes back is not folded: its error is journal_order, at any cutoff."""
    by = Window.partitionBy(account).orderBy("sequence")
    checked = journal.withColumn("_broken", ~((F.row_number().over(by) == F.col("sequence")) & F.coalesce(F.lag("recorded_at").over(by) <= F.col("recorded_at"), F.lit(True))))
    broken = checked.groupBy(account).agg(F.bool_or("_broken").alias("_broken"))
    after = fold(journal.where(F.col("recorded_at") <= cutoff), account)
    whole = after.groupBy(account).agg(F.max_by("cash", "sequence").alias("cash"), F.count("*").alias("events"), F.max_by("error", "sequence").alias("error"))
    held = after.where("instrument_id IS NOT NULL AND position IS NOT NULL").groupBy(account, "instrument_id").agg(F.max_by("position", "sequence").alias("position")).where("position <> '0'")
    positions = held.groupBy(account).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("instrument_id", "position")))).alias("positions"))
    rows = whole.join(positions, account, "left").join(broken, account)
    none = F.create_map().cast("map<string,string>")
    return rows.select(account, F.when(~F.col("_broken"), F.col("cash")).alias("cash"), "events", F.when(F.col("_broken"), "journal_order").otherwise(F.col("error")).alias("error"), F.when(F.col("_broken"), none).otherwise(F.coalesce("positions", none)).alias("positions"))


def declared_report(reports: DataFrame, most_bytes: int = 2_000_000, most_events: int = 10_000) -> DataFrame:
    """report, nth, event (VARIANT), reason of the events of JSON reports (report, payload): all of a report, or none.

    A report is {"format": "offline-cash-events-v1", "events": [...]} and no more; one that is not, is too large, repeats a key, or
    has no event or too many gives one row with a reason."""
    body = F.when(F.octet_length("payload") <= most_bytes, F.try_parse_json("payload"))
    read = reports.select("report", (F.octet_length("payload") > most_bytes).alias("_large"), body.alias("b"), F.array_sort(F.json_object_keys("payload")).alias("_keys"))
    read = read.withColumn("e", F.try_variant_get("b", "$.events", "array<variant>"))
    shape = (F.col("_keys") == F.array(F.lit("events"), F.lit("format"))) & (F.try_variant_get("b", "$.format", "string") == "offline-cash-events-v1") & F.size("e").between(1, most_events)
    reason = F.when(F.coalesce("_large", F.lit(False)), "report_too_large").when(F.col("b").isNull(), "invalid_json").when(~F.coalesce(shape, F.lit(False)), "declared_format_required")
    rows = read.select("report", reason.alias("reason"), F.posexplode_outer(F.when(reason.isNull(), F.col("e"))).alias("nth", "event"))
    return rows.select("report", "nth", "event", "reason")


def reconcile(states: DataFrame, expected: DataFrame, key: str, cash_tolerance: str, quantity_tolerance: str) -> DataFrame:
    """key, instrument_id (null: cash), actual, declared, difference, agrees of every cash and position of either side.

    states and expected: key, currency, instrument_id (null: cash), amount (decimals).  What is absent counts as zero; another
    currency agrees with nothing.  Tolerances are decimals, compared exactly."""
    side = lambda df, name: df.select(key, "instrument_id", F.col("currency").alias(f"_{name}_currency"), F.col("amount").cast("decimal(37,12)").alias(name))
    a, b = side(states, "actual"), side(expected, "declared").withColumnsRenamed({key: "_key", "instrument_id": "_instrument"})
    both = a.join(b, F.col(key).eqNullSafe(F.col("_key")) & F.col("instrument_id").eqNullSafe(F.col("_instrument")), "full_outer")
    zero = F.lit(0).cast("decimal(37,12)")
    both = both.withColumns({"actual": F.coalesce("actual", zero), "declared": F.coalesce("declared", zero)})
    instrument = F.coalesce("instrument_id", "_instrument")
    off = F.col("actual") - F.col("declared")
    tolerance = F.when(instrument.isNull(), F.lit(cash_tolerance).cast("decimal(37,12)")).otherwise(F.lit(quantity_tolerance).cast("decimal(37,12)"))
    same = F.coalesce(F.col("_actual_currency") == F.col("_declared_currency"), F.lit(True))
    return both.select(F.coalesce(key, "_key").alias(key), instrument.alias("instrument_id"), "actual", "declared", off.alias("difference"), (same & (F.abs(off) <= tolerance)).alias("agrees"))


def reconciliation(states: DataFrame, expected: DataFrame, key: str, cash_tolerance: str, quantity_tolerance: str) -> DataFrame:
    """key, status, cash_difference, instruments, off of every account of either side: whether a declared snapshot agrees with the ledger.

    Inputs as in ``reconcile``.  status in order: not_opened (the ledger has no row), not_declared, currency_differs (the sides name other or
    several currencies; nothing is compared then), mismatch, or matches.  instruments counts the instruments of either side, off those
    beyond the tolerance; an account agrees only if its cash and all of them do.  All sums are partial ones, so an account of any size is no single task's list."""
    each = reconcile(states, expected, key, cash_tolerance, quantity_tolerance).groupBy(key).agg(
        F.bool_and("agrees").alias("_agrees"),
        F.coalesce(F.max(F.when(F.col("instrument_id").isNull(), F.col("difference"))), F.lit(0).cast("decimal(38,12)")).alias("cash_difference"),
        F.count("instrument_id").alias("instruments"),
        F.count_if(F.col("instrument_id").isNotNull() & ~F.col("agrees")).alias("off"),
    )
    named = states.select(key, F.lit("a").alias("_side"), "currency").unionByName(expected.select(key, F.lit("b").alias("_side"), "currency"))
    of = lambda s, c: F.when(F.col("_side") == s, c)
    sides = named.groupBy(F.col(key).alias("_key")).agg(F.count(of("a", F.lit(1))).alias("_a"), F.count(of("b", F.lit(1))).alias("_b"), F.min("currency").alias("_low"), F.max("currency").alias("_high"))
    rows = each.join(sides, F.col(key).eqNullSafe(F.col("_key")))
    status = F.when(F.col("_a") == 0, "not_opened").when(F.col("_b") == 0, "not_declared").when(F.col("_low").isNull() | (F.col("_low") != F.col("_high")), "currency_differs").when(F.col("_agrees"), "matches").otherwise("mismatch")
    compared = lambda c: F.when(status.isin("matches", "mismatch"), F.col(c))
    return rows.select(key, status.alias("status"), compared("cash_difference").alias("cash_difference"), "instruments", compared("off").alias("off"))
