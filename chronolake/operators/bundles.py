"""Bundles of daily bars and frozen reports: what may go into one, whether one is as it was written, and which lines belong to it.

Nothing gathers a bundle: its digests are rows beside its bars, so a bundle of any size is compared by shuffles on bundle and day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake import sources
from chronolake.functions import times
from chronolake.operators.evidence import first_reason

# The columns of a bundle's file, and the flags a frozen report must carry.
FIELDS = ("date", "start", "end", "currency", "open", "high", "low", "close", "volume", "available_at")
PRICES = ("open", "high", "low", "close")
UNVERIFIED = ("dataset_admitted", "training_ready", "full_history_verified", "live_trading", "historical_availability_verified", "publication_verified", "calendar_applies_to_listing_verified", "authenticated_account_verified")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _day(text: Column) -> Column:
    """Whether a text is a day as it is written canonically; null is not."""
    return _yes(F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd") == text)


def price_fault(of: dict[str, Column]) -> Column:
    """The first fault of a bar's number texts: not a plain number, a price that is not positive, or out of the bar's range; null for none."""
    n = {k: times.number(c) for k, c in of.items()}
    whole = reduce(lambda a, b: a & b, [n[k].isNotNull() for k in (*PRICES, "volume")])
    low, high = F.least(n["open"], n["close"]), F.greatest(n["open"], n["close"])
    return first_reason(
        ("invalid_decimal", ~whole),
        ("price_not_positive", ~_yes((F.least(*[n[k] for k in PRICES]) > 0) & (n["volume"] >= 0))),
        ("price_outside_range", ~_yes((n["low"] <= low) & (high <= n["high"]))),
    )


def digests(bars: DataFrame) -> DataFrame:
    """bundle, date, sha256 of each bar (bundle and ``FIELDS``, texts): the manifest that is frozen with a bundle."""
    return bars.select("bundle", "date", F.sha2(times.canonical_json(**{c: F.col(c) for c in FIELDS}), 256).alias("sha256"))


def prepare(prices: DataFrame, sessions: DataFrame, expected: DataFrame, as_of: Column) -> DataFrame:
    """bundle, date, reason and the other ``FIELDS`` of each day that is expected or there: a bundle is whole where no day has a reason.

    prices: bundle, date (text), known_at, currency, open, high, low, close, volume (texts).  sessions: bundle, date, known_at, start, end (instants).
    expected: bundle, date, currency.  Only what was known at as_of counts, the last known of each side; available_at is when both were
    there.  Ties in time go to the larger values; a repeated expected day is one day."""
    last = lambda df, name, *columns: df.where(F.col("known_at") <= as_of).select("bundle", "date", F.struct("known_at", *columns).alias(name))
    wanted = expected.select("bundle", "date", F.struct("currency").alias("wanted"))
    sides = last(prices, "price", "currency", *PRICES, "volume").unionByName(last(sessions, "session", "start", "end"), allowMissingColumns=True).unionByName(wanted, allowMissingColumns=True)
    days = sides.groupBy("bundle", "date").agg(*[F.max(c).alias(c) for c in ("price", "session", "wanted")])
    known = F.greatest("price.known_at", "session.known_at")
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    reason = F.coalesce(first_reason(
        ("date_not_canonical", ~_day(F.col("date"))),
        ("not_expected", F.col("wanted").isNull()),
        ("price_missing", F.col("price").isNull()),
        ("session_missing", F.col("session").isNull()),
        ("currency_differs", ~_yes(F.col("price.currency") == F.col("wanted.currency"))),
        ("empty_session", ~_yes(F.col("session.start") < F.col("session.end"))),
        ("available_before_end", ~_yes(known >= F.col("session.end"))),
    ), price_fault({k: F.col("price")[k] for k in (*PRICES, "volume")}))
    utc = {"start": text(F.col("session.start")), "end": text(F.col("session.end")), "available_at": text(known)}
    return days.select("bundle", "date", *[(utc[c] if c in utc else F.col("price")[c]).alias(c) for c in FIELDS[1:]], reason.alias("reason"))


def freeze(days: DataFrame, inputs: dict[str, DataFrame], path: str) -> None:
    """Writes the bars of ``prepare`` below ``path``: rows, then their digests, and a manifest of the inputs' digests last of all.

    All or nothing: a day with a reason, or no day, writes nothing and raises ValueError; a path that is taken is refused.  What has no
    manifest of inputs was not finished and is no bundle (see ``is_frozen``).  inputs: name -> the rows that the bars were made of."""
    spark = days.sparkSession
    faults = {r.reason: r.n for r in days.groupBy("reason").agg(F.count("*").alias("n")).collect()}  # as many rows as there are reasons
    if set(faults) != {None}:
        raise ValueError(f"no whole bundle: {sorted((k, n) for k, n in faults.items() if k)}")
    bars = days.select("bundle", *FIELDS)
    sources.export(bars, ["bundle", "date"], path)
    chunk = lambda n: F.sum(F.conv(F.substring("_sha", 1 + 15 * n, 15), 16, 10).cast("decimal(38,0)"))
    parts = []
    for name, rows in sorted(inputs.items()):
        sha = rows.select(F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}), 256).alias("_sha"))
        parts.append(sha.agg(F.lit(name).alias("input"), F.count("*").alias("rows"), F.sha2(F.concat_ws(",", F.count("*").cast("string"), *[F.coalesce(chunk(n), F.lit(0)).cast("string") for n in range(4)]), 256).alias("sha256")))
    manifest = reduce(lambda a, b: a.unionByName(b), parts) if parts else spark.createDataFrame([], "input string, rows long, sha256 string")
    manifest.write.mode("errorifexists").parquet(f"{path}/inputs")


def is_frozen(spark, path: str) -> bool:
    """Whether the last step of ``freeze`` was finished at ``path``."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/inputs/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def faults(bars: DataFrame, manifest: DataFrame, listings: DataFrame) -> DataFrame:
    """bundle, date, reason of every day of a bundle or its manifest that is not as it should be; a bundle without any is verified.

    bars: bundle and ``FIELDS`` (texts).  manifest: bundle, date, sha256, as ``digests`` gave it.  listings: bundle, currency.  Reasons in order: the day is
    twice, is not in the manifest, is missing, has another digest, is not canonical, currency, session, availability, numbers."""
    here = digests(bars).withColumnRenamed("sha256", "is").join(bars.groupBy("bundle", "date").agg(F.count("*").alias("_n"), *[F.max(c).alias(c) for c in FIELDS[1:]]), ["bundle", "date"]).dropDuplicates(["bundle", "date"])
    said = manifest.select("bundle", "date", "sha256").groupBy("bundle", "date").agg(F.max("sha256").alias("said"))
    rows = here.join(said, ["bundle", "date"], "full_outer").join(listings.select("bundle", F.col("currency").alias("_currency")), "bundle", "left")
    instant = {c: times.instant(F.col(c)) for c in ("start", "end", "available_at")}
    reason = F.coalesce(first_reason(
        ("repeated_day", F.col("_n") > 1),
        ("not_in_manifest", F.col("said").isNull()),
        ("missing_day", F.col("is").isNull()),
        ("digest_differs", F.col("is") != F.col("said")),
        ("date_not_canonical", ~_day(F.col("date"))),
        ("currency_differs", ~_yes(F.col("currency") == F.col("_currency"))),
        ("empty_session", ~_yes(instant["start"] < instant["end"])),
        ("available_before_end", ~_yes(instant["available_at"] >= instant["end"])),
    ), price_fault({k: F.col(k) for k in (*PRICES, "volume")}))
    return rows.select("bundle", "date", reason.alias("reason")).where("reason IS NOT NULL")


def read_lines(lines: DataFrame, bars: DataFrame, manifest: DataFrame, listings: DataFrame) -> DataFrame:
    """lines with header, date, event_time, economic_start, economic_end, value, reason: only rows of a verified bundle are read.

    lines: bundle, line (CSV text).  Reasons: the bundle has a fault (see ``faults``) or no bar, other fields than ``FIELDS``, no such row in it, availability before
    the end.  A header has no reason and no values.  Null lines have no fields.  event_time is when the row was available, rounded up to a millisecond for transport."""
    cells = F.from_csv("line", ", ".join(f"`{c}` string" for c in FIELDS) + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE"})
    read = lines.withColumn("_c", cells)
    own = F.struct(*[F.col(f"_c.{c}").alias(c) for c in FIELDS])
    sha = F.when(F.col("_c._bad").isNull() & F.col("line").isNotNull(), F.sha2(times.canonical_json(**{c: F.col(f"_c.{c}") for c in FIELDS}), 256))
    wrong = faults(bars, manifest, listings).select("bundle").distinct().withColumn("_wrong", F.lit(True))
    state = bars.select("bundle").distinct().join(wrong, "bundle", "left").select(F.col("bundle").alias("_bundle"), (F.col("_wrong").isNull()).alias("_verified"))
    there = digests(bars).select(F.col("bundle").alias("_of"), F.col("sha256").alias("_sha256"), F.lit(True).alias("_row")).distinct()
    rows = read.withColumns({"_sha": sha, "_own": own}).join(state, F.col("bundle") == F.col("_bundle"), "left")
    rows = rows.join(there, (F.col("bundle") == F.col("_of")) & (F.col("_sha") == F.col("_sha256")), "left")
    header = _yes(F.col("line") == ",".join(FIELDS))
    available, start, end = (times.instant(F.col(f"_own.{c}")) for c in ("available_at", "start", "end"))
    reason = F.when(~header, first_reason(
        ("bundle_not_verified", ~_yes(F.col("_verified"))),
        ("unexpected_fields", F.col("_sha").isNull()),
        ("not_in_bundle", F.col("_row").isNull()),
        ("available_before_end", ~_yes(available >= end)),
    ))
    fine = ~header & reason.isNull()
    values = {"date": F.col("_own.date"), "event_time": times.ceil_millis(available), "economic_start": start, "economic_end": end, "value": times.number(F.col("_own.close"))}
    return rows.select(*lines.columns, header.alias("header"), *[F.when(fine, c).alias(n) for n, c in values.items()], reason.alias("reason"))


_ROW = ("index", "economic_date", "listing_id", "currency", "calendar_start", "calendar_end", "published_at", "available_at", "price_received_at", "price_processed_at", "calendar_processed_at", *PRICES, "volume")


def report_digest(observations: DataFrame) -> DataFrame:
    """report, sha256 over all observations of each report: their count with the sums of the parts of their digests, so that no report is gathered."""
    sha = observations.select("report", F.sha2(times.canonical_json(**{c: F.col(c).cast("string") for c in _ROW}), 256).alias("_sha"))
    parts = [F.sum(F.conv(F.substring("_sha", 1 + 15 * n, 15), 16, 10).cast("decimal(38,0)")).cast("string") for n in range(4)]
    return sha.groupBy("report").agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *parts), 256).alias("sha256"))


def report_faults(reports: DataFrame, observations: DataFrame, groups: DataFrame) -> DataFrame:
    """report, faults (sorted, none twice) of each frozen inspection; one without faults is as it was made.

    reports: report (unique), listing_id, currency, checked_at, inspection_only, the flags of ``UNVERIFIED``, sha256 (as ``report_digest`` gave it).  observations: report and
    ``_ROW``; instants are timestamps, index a whole number from 0, days and prices texts.  groups: report, available_at, index: the rows said to be available at an instant, one a row.

    A row is held against the next one by its index, so nothing sorts a report.  A report with no observation has index_not_dense."""
    head = reports.select("report", F.col("listing_id").alias("_listing"), F.col("currency").alias("_currency"), "checked_at")
    seen = observations.join(head, "report")
    following = observations.select("report", (F.col("index") - 1).alias("index"), F.col("economic_date").alias("_next"), F.lit(1).alias("_follows"))
    seen = seen.join(following, ["report", "index"], "left")
    row = [
        ("date_not_canonical", ~_day(F.col("economic_date"))),
        ("dates_not_increasing", ~F.coalesce(F.col("economic_date") < F.col("_next"), F.col("_follows").isNull())),
        ("publication_claimed", F.col("published_at").isNotNull()),
        ("listing_or_currency_differs", ~_yes((F.col("listing_id") == F.col("_listing")) & (F.col("currency") == F.col("_currency")))),
        ("empty_session", ~_yes(F.col("calendar_start") < F.col("calendar_end"))),
        ("received_before_close", ~_yes(F.col("price_received_at") >= F.col("calendar_end"))),
        ("available_after_check", ~_yes(F.col("available_at") <= F.col("checked_at"))),
        ("availability_differs", ~_yes((F.col("available_at") == F.greatest("price_processed_at", "calendar_processed_at")) & F.col("price_processed_at").isNotNull() & F.col("calendar_processed_at").isNotNull())),
        ("processed_before_receipt", ~_yes(F.col("price_received_at") <= F.col("price_processed_at"))),
    ]
    number = price_fault({k: F.col(k) for k in (*PRICES, "volume")})
    found = [seen.select("report", F.explode(F.array_compact(F.array(number, *[F.when(c, name) for name, c in row]))).alias("fault"))]
    shape = observations.groupBy("report").agg(F.count("*").alias("_n"), F.count_distinct("index").alias("_d"), F.min("index").alias("_a"), F.max("index").alias("_b"))
    dense = reports.select("report").join(shape, "report", "left")
    found.append(dense.where(~_yes((F.col("_n") == F.col("_d")) & (F.col("_a") == 0) & (F.col("_b") == F.col("_n") - 1))).select("report", F.lit("index_not_dense").alias("fault")))
    flags = _yes(F.col("inspection_only"))
    for name in UNVERIFIED:
        flags = flags & _yes(~F.col(name))
    found.append(reports.where(~flags).select("report", F.lit("flags_differ").alias("fault")))
    digest = reports.select("report", "sha256").join(report_digest(observations).withColumnRenamed("sha256", "_is"), "report", "left")
    found.append(digest.where(~_yes(F.col("sha256") == F.col("_is"))).select("report", F.lit("digest_differs").alias("fault")))
    side = lambda df, n: df.select("report", "available_at", "index", F.lit(n).alias("_side"))
    apart = side(observations, 1).unionByName(side(groups, -1)).groupBy("report", "available_at", "index").agg(F.sum("_side").alias("_n"), F.count("*").alias("_c")).where("_n <> 0 OR _c <> 2")
    found.append(apart.join(reports.select("report"), "report", "left_semi").select("report", F.lit("groups_differ").alias("fault")))
    every = reduce(lambda a, b: a.unionByName(b), found).distinct().groupBy("report").agg(F.array_sort(F.collect_list("fault")).alias("faults"))  # a fault at most once each
    return reports.select("report").join(every, "report", "left").select("report", F.coalesce("faults", F.array().cast("array<string>")).alias("faults"))
