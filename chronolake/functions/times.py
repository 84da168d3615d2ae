"""Instants, local days and exact numbers from text; what is not valid becomes null."""

from __future__ import annotations

import json
import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"
NUMBER = r"^-?(0|[1-9]\d{0,19})(\.\d{1,18})?$"
SYMBOL = r"^[A-Z0-9][A-Z0-9./-]{0,31}$"


def instant(text: Column) -> Column:
    """A timestamp from text with an offset; text without one, or with digits past microseconds, is null."""
    return F.when(text.rlike(INSTANT), F.try_to_timestamp(text))


def number(text: Column) -> Column:
    """An exact decimal(38,18) from plain number text; text that would be rounded is null."""
    return F.when(text.rlike(NUMBER), text.try_cast("decimal(38,18)"))


def exact(value: Column) -> Column:
    """An exact decimal(38,18) from a VARIANT number or number text; what would be rounded, and what is no number, is null.

    JSON numbers keep their digits in a VARIANT, except that one written with an exponent is a double."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    return F.when(kind == "DOUBLE", text.try_cast("decimal(38,18)")).when(kind.startswith("DECIMAL") | kind.isin("BIGINT", "STRING"), number(text))


def local_date(at: Column, zone: str) -> Column:
    """The day of an instant in a zone."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def strict_utc(local: Column, zone: str) -> Column:
    """The instant of a local time; null where a clock change skips that time or gives it twice."""
    at = F.to_utc_timestamp(local, zone)
    once = (F.from_utc_timestamp(at, zone) == local) & (F.from_utc_timestamp(at + F.expr("INTERVAL 1 HOUR"), zone) != local)
    return F.when(once, at)


def ceil_millis(at: Column) -> Column:
    """The first whole millisecond at or after an instant."""
    micros = F.unix_micros(at)
    return F.timestamp_micros(micros + F.pmod(-micros, F.lit(1000)))


def delivery_windows(rows: DataFrame, key: str, at: str, today: Column) -> DataFrame:
    """key, collides, first_day, last_day, replayable: instants that are delivered in whole milliseconds, rounded up.

    collides: distinct instants share a millisecond, so their groups could not be told apart.  The window runs from the day before the
    earliest instant to the day of the last delivery, and may be replayed once that day is over.  Null instants are left out."""
    each = rows.where(F.col(at).isNotNull()).groupBy(key, ceil_millis(F.col(at)).alias("_sent")).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    whole = each.groupBy(key).agg(F.bool_or(F.col("_a") < F.col("_b")).alias("collides"), F.date_sub(F.to_date(F.min("_a")), 1).alias("first_day"), F.to_date(F.max("_sent")).alias("last_day"))
    return whole.withColumn("replayable", F.col("last_day") < today)


def day_bounds(first: Column, last: Column, zone: str) -> tuple[Column, Column]:
    """The instants at which the local day ``first`` begins and the local day ``last`` is over."""
    midnight = lambda day: F.to_utc_timestamp(day.cast("timestamp"), zone)
    return midnight(first), midnight(F.date_add(last, 1))


def known_zone(name: Column) -> Column:
    """Whether a text names a zone of the time zone database; null does not."""
    return F.coalesce(name.isin(*sorted(zoneinfo.available_timezones())), F.lit(False))


def horizon(at: Column, seconds: Column) -> Column:
    """The instant so many elapsed seconds later, whatever clocks do meanwhile."""
    return F.timestamp_micros(F.unix_micros(at) + seconds.cast("long") * 1_000_000)


def symbol_list(symbols: Column, most: int = 50) -> Column:
    """Symbols of an array, sorted and joined by commas; null where one is no symbol, one is twice, or there are none or too many."""
    fine = F.forall(symbols, lambda s: F.coalesce(s.rlike(SYMBOL), F.lit(False))) & F.size(symbols).between(1, most) & (F.size(F.array_distinct(symbols)) == F.size(symbols))
    return F.when(fine, F.array_join(F.array_sort(symbols), ","))


def canonical_json(**fields: Column) -> Column:
    """JSON of the fields with sorted keys, no blanks, and nulls written out: equal values have equal text."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical_text(text: Column, ascii_only: bool = True) -> Column:
    """The canonical form of a JSON text of any depth: sorted keys, no blanks, one spelling of strings and numbers; null where it is no JSON, or an object names a key twice.

    Numbers without an exponent lose zeros at their end and keep every other digit (38 at most); others become the shortest text of the double they name.  With
    ``ascii_only`` characters beyond ``~`` are written as escapes of UTF-16 units, else as themselves; control characters are lower-case escapes in both."""
    plain = F.to_json(F.try_parse_json(text))
    parts = F.split(plain, r"\\\\")  # between escaped backslashes, so that what follows a backslash is an escape

    def lowered(part: Column) -> Column:
        for c in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
            part = F.replace(part, F.lit(f"\\u{c:04X}"), F.lit(f"\\u{c:04x}"))
        return part

    whole = F.array_join(F.transform(parts, lowered), "\\\\")
    if not ascii_only:
        return whole
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    code = F.ascii
    escaped = lambda c: F.when(code(c) < 127, c).when(code(c) < 65536, unit(code(c))).otherwise(F.concat(unit(F.lit(0xD7C0) + F.shiftright(code(c), 10)), unit(F.lit(0xDC00) + code(c) % 1024)))
    return F.when(whole.rlike(r"[^\x00-\x7e]"), F.array_join(F.transform(F.split(whole, ""), escaped), "")).otherwise(whole)


def key_text(*parts: str) -> str:
    """The canonical JSON array of texts, as keys are hashed."""
    return json.dumps(parts, separators=(",", ":"), ensure_ascii=False)
