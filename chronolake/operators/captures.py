"""Captured JSON pages to rows: each row is accepted (reason null) or quarantined with its path and reason.

Where a column offset is given, the pages of an import are parts of it, and offset is how many rows (of a symbol, where a page has
several arrays) stand before the part: rows are numbered, and repeated ones found, over the whole import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions import times


def _first(*reasons: tuple[str, Column]) -> Column:
    """The name of the first condition that holds; an unknown condition does not."""
    return F.coalesce(*[F.when(c, name) for name, c in reasons])


def _pointer(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _parts(pages: DataFrame) -> DataFrame:
    return pages if "offset" in pages.columns else pages.withColumn("offset", F.lit(0))


def _told(fault: Column, *keys: str) -> Column:
    """Whether a fault (null: none) of whole parts with these keys stands on another row, which is kept; it shares a shuffle with windows over the keys."""
    return F.coalesce(F.lag(fault).over(Window.partitionBy(*keys).orderBy(fault.asc_nulls_last())) == fault, F.lit(False))


def bars(pages: DataFrame, listings: DataFrame, zone: str) -> DataFrame:
    """import_id, row_path, listing_id, day, at, open, high, low, close, volume, reason of each bar of each import.

    pages: import_id, payload, received_at, perhaps offset; listings: symbol, listing_id.  Pages that are no JSON (repeated keys are
    none) or have no object ``bars`` give one row of their import with path ``$``; a symbol without a listing, or without an array,
    gives one row.  Days that an import gives twice for a listing are quarantined all, counted over rows right so far."""
    body = F.try_variant_get(F.try_parse_json("payload"), "$.bars", "map<string,variant>")
    read = _parts(pages).select("import_id", "received_at", "offset", body.alias("bars"))
    groups = read.select("import_id", "received_at", "offset", F.col("bars").isNotNull().alias("read"), F.explode_outer("bars").alias("symbol", "rows")).where("symbol IS NOT NULL OR NOT read")
    groups = groups.join(listings.select("symbol", "listing_id"), "symbol", "left").withColumn("items", F.try_variant_get("rows", "$", "array<variant>"))
    groups = groups.withColumn("_whole", _first(("bars_object_required", ~F.col("read")), ("unmapped_symbol", F.col("listing_id").isNull()), ("bar_array_required", F.col("items").isNull())))
    each = groups.select("import_id", "received_at", "offset", "listing_id", "symbol", "_whole", F.posexplode_outer(F.when(F.col("_whole").isNull(), F.col("items"))).alias("nth", "item")).where("nth IS NOT NULL OR _whole IS NOT NULL")
    path = F.when(F.col("symbol").isNull(), "$").otherwise(F.concat_ws("/", F.lit("bars"), _pointer(F.col("symbol")), F.col("nth") + F.col("offset")))
    get = lambda c: F.try_variant_get("item", f"$.{c}", "variant")
    n = lambda c: times.exact(get(c))
    given = F.forall(F.array(*[F.try_variant_get("item", f"$.{c}", "string") for c in "tohlcv"]), lambda x: x.isNotNull())
    each = each.select("import_id", "received_at", "listing_id", path.alias("row_path"), "_whole", times.instant(F.try_variant_get("item", "$.t", "string")).alias("at"), n("o").alias("open"), n("h").alias("high"), n("l").alias("low"), n("c").alias("close"), n("v").alias("volume"), given.alias("whole"))
    amounts = ["open", "high", "low", "close", "volume"]
    valid = F.forall(F.array(*amounts), lambda x: x.isNotNull() & (x >= 0)) & (F.least(*amounts[:4]) > 0)
    each = each.withColumns({"day": times.local_date(F.col("at"), zone), "reason": F.coalesce("_whole", _first(
        ("required_bar_fields_missing", ~F.coalesce("whole", F.lit(False))),
        ("invalid_bar_record", F.col("at").isNull()),
        ("bar_timestamp_after_receipt", F.col("at") > F.col("received_at")),
        ("invalid_amount", ~F.coalesce(valid, F.lit(False))),
        ("nonintegral_share_volume", F.col("volume") != F.floor("volume")),
        ("invalid_ohlc_bounds", (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close")))))})
    same = Window.partitionBy("import_id", "listing_id", "day")
    again = F.count(F.when(F.col("reason").isNull(), 1)).over(same) > 1
    told = _told(F.when(F.col("_whole").isNotNull(), F.concat_ws(" ", "_whole", "row_path")), "import_id", "listing_id", "day")
    each = each.withColumns({"reason": F.coalesce("reason", F.when(again, "ambiguous_daily_bar")), "_told": told}).where("NOT _told")
    return each.drop("received_at", "whole", "_whole", "_told")


def page_tokens(pages: DataFrame) -> DataFrame:
    """import_id, token, state of each page (import_id, payload): more_pages with a next token, terminal_page with a null one, unknown
    without one, with one that is no text or blank, or in a page that is no JSON object."""
    body = F.try_parse_json("payload")
    read = pages.select("import_id", body.alias("b"), F.json_object_keys("payload").alias("keys"))
    kind, token = F.schema_of_variant(F.try_variant_get("b", "$.next_page_token", "variant")), F.try_variant_get("b", "$.next_page_token", "string")
    there = F.coalesce(F.col("b").isNotNull() & F.array_contains("keys", "next_page_token"), F.lit(False))
    more = F.coalesce((kind == "STRING") & token.rlike(r"\S"), F.lit(False))
    state = F.when(there & more, "more_pages").when(there & F.coalesce(kind == "VOID", F.lit(True)), "terminal_page").otherwise("unknown")
    return read.select("import_id", F.when(there & more, token).alias("token"), state.alias("state"))


def sessions(pages: DataFrame, zone: str, first: str, last: str) -> DataFrame:
    """import_id, row_path, day, opens_at, closes_at, reason of each row of calendar pages (import_id, payload, perhaps offset).

    Days outside ``first``..``last``, local times that a clock change skips or repeats, and sessions that do not open before
    they close are quarantined; so is each day that stands twice in an import, counted over wrong rows too.  Pages that are no
    array of rows give one row of their import with path ``$``."""
    rows = F.when(F.try_parse_json("payload").isNotNull(), F.from_json("payload", "array<struct<date:string,open:string,close:string>>"))
    read = _parts(pages).select("import_id", "offset", rows.alias("rows"))
    each = read.select("import_id", "offset", F.col("rows").isNotNull().alias("read"), F.posexplode_outer("rows").alias("nth", "row")).where("nth IS NOT NULL OR NOT read")
    at = lambda c: times.strict_utc(F.when(F.col("row")[c].rlike(r"^\d{2}:\d{2}$"), F.try_to_timestamp(F.concat_ws(" ", F.col("row.date"), F.col("row")[c]))), zone)
    each = each.select("import_id", "read", F.coalesce(F.concat(F.lit("/"), F.col("nth") + F.col("offset")), F.lit("$")).alias("row_path"), F.col("row.date").alias("_text"), F.when(F.col("row.date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("row.date").try_cast("date")).alias("day"), at("open").alias("opens_at"), at("close").alias("closes_at"))
    twice = F.count("_text").over(Window.partitionBy("import_id", "_text")) > 1
    each = each.withColumn("reason", _first(
        ("calendar_array_required", ~F.col("read")),
        ("date_outside_requested_range", ~F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))),
        ("invalid_calendar_record", F.col("day").isNull() | F.col("opens_at").isNull() | F.col("closes_at").isNull()),
        ("session_must_open_before_close", F.col("opens_at") >= F.col("closes_at")),
        ("duplicate_calendar_date", twice)))
    told = _told(F.when(~F.col("read"), F.col("row_path")), "import_id", "_text")
    return each.withColumn("_told", told).where("NOT _told").drop("_text", "read", "_told")


PATH_SEGMENT = r"^[A-Za-z0-9_.-]{1,255}$"


def relative_path(text: Column) -> Column:
    """Whether a text is a plain relative path: up to 16 segments, none empty or of dots only; null is not."""
    parts = F.split(text, "/")
    fine = F.forall(parts, lambda p: p.rlike(PATH_SEGMENT) & ~p.isin(".", "..")) & (F.size(parts) <= 16) & (F.length(text) <= 1024)
    return F.coalesce(fine, F.lit(False))


def _day(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


FILING_COLUMNS = ["accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "form", "primaryDocument"]


def filings(pages: DataFrame) -> DataFrame:
    """import_id, row_index, accession, form, filed, reported, accepted_at, document, issues, reason of each filing.

    pages: import_id, cik (ten digits), payload, received_at, perhaps offset; the payload has a filer's filings as aligned column
    arrays.  Payloads of another filer, or with arrays missing or not aligned, give one row of their import without an index.  issues
    names every fault of a row, reason the first; accession numbers that right rows of an import share are quarantined all."""
    body = F.from_json("payload", "cik string, filings struct<recent:map<string,array<string>>,files:array<string>>")
    read = _parts(pages).select("import_id", "cik", "received_at", "offset", F.when(F.try_parse_json("payload").isNotNull(), body).alias("b"))
    recent = F.col("b.filings.recent")
    length = F.size(recent["accessionNumber"])
    aligned = F.forall(F.map_values(recent), lambda v: F.size(v) == length) & F.col("b.filings.files").isNotNull()
    for c in FILING_COLUMNS:
        aligned = aligned & recent[c].isNotNull()
    whole = F.coalesce((F.lpad("b.cik", 10, "0") == F.col("cik")) & aligned, F.lit(False))
    read = read.withColumn("whole", whole)
    rows = F.arrays_zip(*[recent[c].alias(c) for c in FILING_COLUMNS])
    each = read.select("import_id", "received_at", "offset", "whole", F.posexplode_outer(F.when(F.col("whole"), rows)).alias("nth", "r")).where("nth IS NOT NULL OR NOT whole")
    each = each.select("import_id", "received_at", "whole", (F.col("nth") + F.col("offset")).alias("row_index"), *[F.col("r").getField(c).alias(c) for c in FILING_COLUMNS])
    each = each.withColumns({"filed": _day(F.col("filingDate")), "reported": _day(F.col("reportDate")), "accepted_at": times.instant(F.col("acceptanceDateTime"))})
    no = lambda c: ~F.coalesce(c, F.lit(False))
    faults = [
        ("invalid_accession", no(F.col("accessionNumber").rlike(r"^\d{10}-\d{2}-\d{6}$"))),
        ("invalid_form", no(F.trim("form") != "")),
        ("invalid_primary_document_path", ~relative_path(F.col("primaryDocument"))),
        ("invalid_acceptance_datetime", F.col("accepted_at").isNull()),
        ("acceptance_after_receipt", F.coalesce(F.col("accepted_at") > F.col("received_at"), F.lit(False))),
        ("invalid_filing_date", F.col("filed").isNull()),
        ("invalid_report_date", no(F.col("reported").isNotNull() | (F.col("reportDate") == ""))),
    ]
    each = each.withColumn("issues", F.when(F.col("whole"), F.array_compact(F.array(*[F.when(c, name) for name, c in faults]))))
    right = F.when(F.size("issues") == 0, 1)
    twice = F.count(right).over(Window.partitionBy("import_id", "accessionNumber")) > 1
    each = each.withColumn("reason", F.coalesce(F.when(~F.col("whole"), "invalid_submissions_envelope"), F.get("issues", F.lit(0)), F.when(twice, "duplicate_accession")))
    each = each.withColumn("_told", _told(F.when(~F.col("whole"), F.col("reason")), "import_id", "accessionNumber")).where("NOT _told")
    return each.select("import_id", "row_index", F.col("accessionNumber").alias("accession"), "form", "filed", "reported", "accepted_at", F.col("primaryDocument").alias("document"), "issues", "reason")


IDENTITY = ("cusip", "old_cusip", "new_cusip", "isin")


def uuid_text(text: Column) -> Column:
    """A UUID in lower case with hyphens, from any of its usual forms; null where a text is none."""
    low = F.lower(text)
    bare = F.replace(F.regexp_replace(low, r"^(urn:uuid:)?\{?([0-9a-f-]+)\}?$", "$2"), F.lit("-"), F.lit(""))
    usual = low.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z")  # is its own result, and spares the rest
    return F.when(usual, low).when(bare.rlike("^[0-9a-f]{32}$"), F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def actions(pages: DataFrame) -> DataFrame:
    """import_id, row_path, kind, native_id, process_date, ex_date, payable_date, amount, new_shares, old_shares, blockers, the
    names of IDENTITY, row_sha256, reason.

    pages: import_id, payload, symbol, first, last (days of the request).  The payload groups splits and cash dividends by
    kind; other kinds, other symbols, days outside the request, special or foreign dividends and splits against their
    direction are quarantined.  A currency that is not given blocks accounting, but not the row."""
    keys = F.array_except(F.json_object_keys("payload"), F.array(F.lit("corporate_actions"), F.lit("next_page_token")))
    body = F.try_variant_get(F.try_parse_json("payload"), "$.corporate_actions", "map<string,variant>")
    read = pages.select("import_id", "symbol", "first", "last", F.when(F.size(keys) == 0, body).alias("groups"))
    groups = read.select("import_id", F.col("symbol").alias("asked"), "first", "last", F.col("groups").isNotNull().alias("read"), F.explode_outer("groups").alias("kind", "rows")).where("kind IS NOT NULL OR NOT read")
    groups = groups.withColumn("items", F.try_variant_get("rows", "$", "array<variant>")).withColumn("listed", F.col("items").isNotNull())
    each = groups.select("import_id", "asked", "first", "last", "read", "kind", "listed", F.posexplode_outer("items").alias("nth", "item")).where("nth IS NOT NULL OR NOT listed")
    path = F.coalesce(F.concat("kind", F.lit("["), "nth", F.lit("]")), "kind", F.lit("$"))
    f = lambda c: F.try_variant_get("item", f"$.{c}", "string")
    positive = lambda c: F.when(times.exact(F.try_variant_get("item", f"$.{c}", "variant")) > 0, times.exact(F.try_variant_get("item", f"$.{c}", "variant")))
    due = F.exists(F.map_keys(F.try_variant_get("item", "$", "map<string,variant>")), lambda k: k.startswith("due_bill_"))
    each = each.withColumns({"row_path": path, "native_id": uuid_text(f("id")), "process_date": _day(f("process_date")), "ex_date": _day(f("ex_date")), "payable_date": _day(f("payable_date")), "amount": positive("rate"), "new_shares": positive("new_rate"), "old_shares": positive("old_rate"), "_due": due})
    pays, ratio = F.col("kind") == "cash_dividends", F.col("new_shares") - F.col("old_shares")
    each = each.withColumn("reason", _first(
        ("invalid_action_envelope", ~F.col("read")),
        ("invalid_action_group", ~F.col("listed")),
        ("unsupported_action_type", ~F.col("kind").isin("forward_splits", "reverse_splits", "cash_dividends")),
        ("invalid_native_id", F.col("native_id").isNull()),
        ("symbol_binding_mismatch", ~f("symbol").eqNullSafe(F.col("asked"))),
        ("invalid_action_field", F.col("process_date").isNull() | F.col("ex_date").isNull() | (F.col("payable_date").isNull() & f("payable_date").isNotNull()) | (_day(f("record_date")).isNull() & f("record_date").isNotNull())),
        ("process_date_outside_request", ~F.col("process_date").between(F.col("first"), F.col("last"))),
        ("unsupported_action_currency", f("currency") != "USD"),
        ("special_foreign_or_incomplete_dividend_unsupported", pays & ~(f("special").eqNullSafe("false") & f("foreign").eqNullSafe("false"))),
        ("unsupported_dividend_payment_date", pays & (F.col("payable_date").isNull() | (F.col("payable_date") < F.col("ex_date")))),
        ("invalid_action_field", F.when(pays, F.col("amount").isNull()).otherwise(ratio.isNull())),
        ("split_direction_ratio_mismatch", ((F.col("kind") == "forward_splits") & (ratio <= 0)) | ((F.col("kind") == "reverse_splits") & (ratio >= 0)))))
    blockers = F.array_compact(F.array(F.when(f("currency").isNull(), "provider_currency_unknown"), F.when(F.col("_due"), "due_bill_terms_unreviewed")))
    each = each.withColumns({"blockers": blockers, "row_sha256": F.sha2(F.to_json("item"), 256), **{c: f(c) for c in IDENTITY}})
    return each.select("import_id", "row_path", "kind", "native_id", "process_date", "ex_date", "payable_date", "amount", "new_shares", "old_shares", "blockers", *IDENTITY, "row_sha256", "reason")
