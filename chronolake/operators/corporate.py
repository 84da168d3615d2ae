"""What a holding is worth through splits and dividends."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal, DecimalException, DivisionByZero, Inexact, InvalidOperation, Overflow, localcontext

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.operators.ledger import plain

MONEY = "decimal(38,6)"
#: Digits that a step's result may have; one that needs more is refused, never rounded.
DIGITS = 50
_ACTION = ("close", "new_shares", "old_shares", "dividend")
_GIVEN = ("shares", "cash", "paid", "receivable", "wealth", "error")


class _Holding:
    """A holding from day to day: what it has, what is owed to it, and the first fault, after which it stands still."""

    def __init__(self, cash: str, shares: str):
        self.cash, self.shares = Decimal(cash), Decimal(shares)
        self.owed: list[tuple] = []
        self.last = self.error = None

    def on(self, day, close, new, old, dividend, payment_date) -> tuple:
        """The day's texts: split, entitlement on the shares after it, payments due, value at the close."""
        if self.error is None:
            try:
                return self._on(day, close, new, old, dividend, payment_date)
            except DecimalException:
                self.error = "no_exact_result"
        return None, None, None, None, None, self.error

    def _on(self, day, close, new, old, dividend, payment_date) -> tuple:
        wrong = "day_required" if day is None else "repeated_day" if day == self.last else "close_required" if close is None else "split_needs_both_sides" if (new is None) != (old is None) else None
        if wrong is None and new is not None and (Decimal(new) <= 0 or Decimal(old) <= 0):
            wrong = "split_needs_both_sides"
        if wrong is None and dividend is not None and payment_date is None:
            wrong = "payment_date_required"
        if wrong:
            self.error = wrong
            return None, None, None, None, None, wrong
        shares = self.shares if new is None else self.shares * Decimal(new) / Decimal(old)
        owed = [*self.owed, (payment_date, shares * Decimal(dividend))] if dividend is not None else self.owed
        paid = sum((amount for due, amount in owed if due <= day), Decimal(0))
        pending = sum((amount for due, amount in owed if due > day), Decimal(0))
        cash = self.cash + paid
        wealth = cash + pending + shares * Decimal(close)
        self.cash, self.shares, self.last, self.owed = cash, shares, day, [x for x in owed if x[0] > day]
        return plain(shares), plain(cash), plain(paid), plain(pending), plain(wealth), None


def exact_valuation(days: DataFrame, key: str, cash: str, shares: str) -> DataFrame:
    """key, day, shares, cash, paid, receivable, wealth (texts of plain decimals), error for each day of ``days``.

    days: key, day (unique with it), close, new_shares, old_shares (a split, or null), dividend (a share, or null), payment_date; amounts are decimals of any
    scale, or texts of them.  A day's split comes first, then the entitlement on the shares after it, then payments due on the first day at or
    after their date, then the value at the close.  Every step is exact to ``DIGITS`` digits: ratios of any decimals are taken, and only what does
    not end within them is refused.  A holding stops at its first error, which its later days have too.

    The days of a key are a chain and at most one a date, so they pass one task as a sorted stream, which holds the dividends not yet paid.
    Rows of a null key are one holding; days that are null or repeated are errors; no rows give no rows."""
    types = {c: days.schema[c].dataType for c in (key, "day")}
    rows = days.select(key, "day", *[F.col(c).cast("string").alias(c) for c in _ACTION], F.col("payment_date").cast(types["day"]).alias("payment_date"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, current, begun = None, None, False
        with localcontext(Context(prec=DIGITS, traps=[Inexact, InvalidOperation, DivisionByZero, Overflow])):
            for batch in batches:
                out = []
                for of, *day in zip(*(batch.column(n).to_pylist() for n in range(batch.num_columns)), strict=True):
                    if not begun or of != current:
                        holding, current, begun = _Holding(cash, shares), of, True
                    out.append(holding.on(*day))
                given = [pa.array([r[n] for r in out], pa.string()) for n in range(len(_GIVEN))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *given], names=[key, "day", *_GIVEN])

    schema = f"`{key}` {types[key].simpleString()}, day {types['day'].simpleString()}, " + ", ".join(f"{c} string" for c in _GIVEN)
    return rows.repartition(key).sortWithinPartitions(key, "day").mapInArrow(run, schema)


def valuation(days: DataFrame, key: str, cash: str, shares: str) -> DataFrame:
    """key, day, shares, cash, receivable, wealth, exact: ``exact_valuation`` as decimals of six places.

    exact is false, and the amounts null, from a day on that has an error; a result of more than six places is rounded, and not exact either."""
    found = exact_valuation(days, key, cash, shares)
    amounts = {c: F.col(c).cast(MONEY) for c in ("shares", "cash", "receivable", "wealth")}
    kept = F.col("error").isNull()
    for c, amount in amounts.items():
        kept = kept & F.coalesce(F.length(F.regexp_extract(c, r"\.(\d+)$", 1)) <= 6, F.lit(False)) & amount.isNotNull()
    return found.select(key, "day", *[a.alias(c) for c, a in amounts.items()], kept.alias("exact"))
