"""Paged capture jobs and what they captured: how each ended, what may be used of it, and for what."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators.evidence import first_reason

# The axes a source is reviewed on, the basis of time a purpose needs, and what a binding never verifies.
AXES = ("rights", "provenance", "temporal", "coverage")
BASES = {"forward_observation": "observed_receipt_and_processing", "historical_replay": "documented_publication_vintage"}
UNVERIFIED = ("corporate_action_effective_date_coverage_unverified", "corporate_action_source_reviews_missing", "corporate_action_identity_and_accounting_policy_unverified")


def results(jobs: DataFrame, pages: DataFrame, rows: DataFrame) -> DataFrame:
    """job_id, pages, bytes, state, reason: how far each job was read, and why it ended there.

    jobs: job_id, max_pages, max_bytes, first_day, last_day.  pages: job_id, page (from 0), sent_token (null on the first), next_token,
    token_state (more_pages, terminal_page or unknown), bytes, quarantined.  rows: job_id, page, listing_id, day.

    Pages count in order until one ends the job.  One that would pass max_bytes is not taken: byte_limit.  Then, in this order: it was
    asked for with another token than the page before gave; a row lies outside the days asked for; a listing's day was on an
    earlier page; rows are quarantined (all these quarantine the job); its token is unknown; it is the last page (the
    only complete end); its token was given before; it is the last page allowed.  Where none holds, or a page number is
    missing, the run was interrupted.  Null counts are zero; a job without pages has none; pages of no job are left out."""
    first = F.min("page").over(Window.partitionBy("job_id", "listing_id", "day"))
    kept = rows.select("job_id", "page", "listing_id", "day").distinct().withColumn("_again", F.col("page") > first)
    spans = jobs.select("job_id", "max_pages", "max_bytes", "first_day", "last_day")
    outside = ~F.coalesce(F.col("day").between(F.col("first_day"), F.col("last_day")), F.lit(False))
    faults = kept.join(spans, "job_id").groupBy("job_id", "page").agg(F.bool_or("_again").alias("_again"), F.bool_or(outside).alias("_outside"))
    by = Window.partitionBy("job_id").orderBy("page")
    seen = Window.partitionBy("job_id", "next_token").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    at = pages.join(spans.select("job_id", "max_pages", "max_bytes"), "job_id").join(faults, ["job_id", "page"], "left")
    at = at.withColumns({"_used": F.sum(F.coalesce("bytes", F.lit(0))).over(by), "_nth": F.row_number().over(by) - 1, "_given": F.lag("next_token").over(by), "_cycle": F.count("*").over(seen) > 0})
    reason = first_reason(
        ("interrupted_previous_run", F.col("_nth") != F.col("page")),
        ("byte_limit", F.col("_used") > F.col("max_bytes")),
        ("page_token_mismatch", ~F.col("sent_token").eqNullSafe(F.col("_given"))),
        ("response_outside_request", F.col("_outside")),
        ("duplicate_cross_page_bar", F.col("_again")),
        ("invalid_page_records", F.col("quarantined") > 0),
        ("pagination_unknown", ~F.coalesce(F.col("token_state").isin("more_pages", "terminal_page"), F.lit(False))),
        ("terminal_page", F.col("token_state") == "terminal_page"),
        ("pagination_cycle", F.col("_cycle")),
        ("page_limit", F.col("_nth") + 1 >= F.col("max_pages")),
    )
    ends = at.select("job_id", "page", "bytes", reason.alias("_reason"))
    before = F.count("_reason").over(by.rowsBetween(Window.unboundedPreceding, -1)) == 0
    taken = F.coalesce(~F.col("_reason").isin("byte_limit", "interrupted_previous_run"), F.lit(True))
    read = ends.withColumn("_read", before).where("_read").groupBy("job_id").agg(F.count_if(taken).alias("pages"), F.sum(F.when(taken, F.col("bytes"))).alias("bytes"), F.max("_reason").alias("_reason"))  # one reason at most
    why = F.coalesce("_reason", F.lit("interrupted_previous_run"))
    quarantined = why.isin("page_token_mismatch", "response_outside_request", "duplicate_cross_page_bar", "invalid_page_records")
    state = F.when(why == "terminal_page", "complete_pages").when(quarantined, "quarantined").otherwise("incomplete")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    return spans.select("job_id").join(read, "job_id", "left").select("job_id", zero("pages"), zero("bytes"), state.alias("state"), why.alias("reason"))


def inspect(prices: DataFrame, sessions: DataFrame, expected: DataFrame) -> DataFrame:
    """listing_id, day, available_at, reason of every day of any side; a capture is whole where no day has a reason.

    prices: listing_id, day, currency, received_at, available_at.  sessions: listing_id, day, end, available_at.  expected: listing_id, day,
    currency.  available_at (null with a reason) is when price and session were both there; rows of one instant form one group.
    All three sides are grouped once, so no side is joined and a hot listing is spread over its days."""
    side = lambda frame, name, *columns: frame.select("listing_id", "day", F.lit(name).alias("_side"), F.struct(*columns).alias(name))
    sides = [side(prices, "price", "currency", "received_at", "available_at"), side(sessions, "session", "end", "available_at"), side(expected, "wanted", "currency")]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    count = lambda name: F.count_if(F.col("_side") == name).alias(f"_{name}")
    day = rows.groupBy("listing_id", "day").agg(*[f(n) for n in ("price", "session", "wanted") for f in (count, lambda n: F.max(n).alias(n))])
    reason = first_reason(
        ("duplicate_price", F.col("_price") > 1),
        ("duplicate_session", F.col("_session") > 1),
        ("price_missing", F.col("_price") == 0),
        ("session_missing", F.col("_session") == 0),
        ("not_expected", F.col("_wanted") == 0),
        ("currency_differs", ~F.coalesce(F.col("price.currency") == F.col("wanted.currency"), F.lit(False))),
        ("received_before_close", ~F.coalesce(F.col("price.received_at") >= F.col("session.end"), F.lit(False))),
    )
    both = F.greatest("price.available_at", "session.available_at")
    return day.withColumn("reason", reason).select("listing_id", "day", F.when(F.col("reason").isNull(), both).alias("available_at"), "reason")


def scope_reason(scope: dict[str, Column]) -> Column:
    """The first fault of a review's scope: source ids, first and last day (text), feed, and a lower-case SHA-256; null for none."""
    day = lambda c: F.coalesce(F.date_format(F.try_to_date(c, "yyyy-MM-dd"), "yyyy-MM-dd") == c, F.lit(False))
    texts = reduce(lambda a, b: a & b, [F.coalesce(c.rlike(r"(?s)^\S(.*\S)?$"), F.lit(False)) for c in scope.values()])
    return first_reason(
        ("required_text_missing", ~texts),
        ("distinct_sources_required", scope["price_source_id"] == scope["calendar_source_id"]),
        ("canonical_dates_required", ~(day(scope["start_date"]) & day(scope["end_date"]))),
        ("invalid_interval_or_feed", (scope["start_date"] > scope["end_date"]) | ~scope["feed"].isin("iex", "sip")),
        ("exact_sha256_required", ~scope["capture_snapshot_sha256"].rlike("^[0-9a-f]{64}$")),
    )


def assess(packets: DataFrame, reviews: DataFrame, purpose: str, at: Column) -> DataFrame:
    """scope, eligible, reasons (sorted) of every captured packet under the declared reviews known at ``at``.

    packets: scope (unique), price_source, calendar_source, price_origin, calendar_origin, venue, mic.  reviews: scope, source_id, axis, purpose, known_at,
    review_id, decision, expires_at, declared_rights (array), temporal_basis.  Both sources need, on each of four axes, that the
    latest review allows and has not expired; on rights it must name storage and research, on time the purpose's basis.  A
    historical purpose is never met, as a capture does not know when it was published."""
    source = lambda s: F.struct(F.col(f"{s}_source").alias("source_id"), F.col(f"{s}_origin").alias("origin"))
    asked = packets.select("scope", "venue", "mic", F.explode(F.array(source("price"), source("calendar"))).alias("_s")).select("scope", "venue", "mic", "_s.*")
    asked = asked.withColumn("axis", F.explode(F.array(*map(F.lit, AXES))))
    told = reviews.where((F.col("purpose") == purpose) & (F.col("known_at") <= at)).groupBy("scope", "source_id", "axis").agg(F.max_by(F.struct("decision", "expires_at", "declared_rights", "temporal_basis"), F.struct("known_at", "review_id")).alias("_r"))
    found = asked.join(told, ["scope", "source_id", "axis"], "left")
    rights = (F.col("axis") != "rights") | (F.array_contains("_r.declared_rights", "storage") & F.array_contains("_r.declared_rights", "research"))
    basis = (F.col("axis") != "temporal") | (F.col("_r.temporal_basis") == BASES[purpose])
    allows = F.coalesce((F.col("_r.decision") == "allow") & (F.col("_r.expires_at") > at) & rights & basis, F.lit(False))
    each = F.array_compact(F.array(
        F.when(~allows, F.concat_ws(":", "source_id", F.concat("axis", F.lit("_review_missing_denied_expired_or_inapplicable")))),
        F.when(~F.coalesce(F.col("origin") == "provider_reported", F.lit(False)), F.concat_ws(":", "source_id", F.lit("provider_origin_required"))),
        F.when(~F.coalesce(F.col("venue") == F.col("mic"), F.lit(False)), F.lit("calendar_listing_venue_mismatch")),
        F.lit("historical_publication_or_vintage_unknown" if purpose == "historical_replay" else None).cast("string"),
    ))
    reasons = found.groupBy("scope").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(each)))).alias("reasons"))  # eight rows a scope
    return reasons.select("scope", (F.size("reasons") == 0).alias("eligible"), "reasons")


def bind_actions(jobs: DataFrame, packets: DataFrame, key: str, scope: list[str], at: Column) -> DataFrame:
    """job_id, outcome (bound, other_scope or no_packet), reasons (sorted; null unless bound) of action jobs beside the latest packet of their key.

    jobs: job_id, key, the scope's columns, state.  packets: key, known_at, packet_id, the scope's columns, blockers (array).  Scopes are
    compared null-safely and whole: a job is bound to exactly what was captured, or not at all."""
    names = {c: f"_p{k}" for k, c in enumerate(scope)}
    body = F.struct(*[F.col(c).alias(n) for c, n in names.items()], F.col("blockers").alias("_blockers"))
    last = packets.where(F.col("known_at") <= at).groupBy(key).agg(F.max_by(body, F.struct("known_at", "packet_id")).alias("_p"))
    rows = jobs.join(last, key, "left")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col("_p")[n]) for c, n in names.items()])
    outcome = F.when(F.col("_p").isNull(), "no_packet").when(same, "bound").otherwise("other_scope")
    partial = F.when(~F.col("state").eqNullSafe(F.lit("complete_pages")), F.lit("corporate_action_capture_incomplete_failed_or_quarantined"))
    reasons = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce("_p._blockers", F.array().cast("array<string>")), F.array(partial, *map(F.lit, UNVERIFIED))))))
    return rows.select("job_id", outcome.alias("outcome"), F.when(outcome == "bound", reasons).alias("reasons"))


def diagnostic(wanted: DataFrame, sources: DataFrame, permissions: DataFrame, captures: dict[str, DataFrame], at: Column) -> DataFrame:
    """source_id, declared, origin, uses, a count of rows of each capture table, and blockers of every source asked for.

    wanted: source_id.  sources: source_id, origin.  permissions: source_id, known_at, uses.  Capture tables have a source_id; they are counted
    before they are joined.  Nothing here says that a source may be used: only what stands in its way."""
    rights = permissions.where(F.col("known_at") <= at).groupBy("source_id").agg(F.array_sort(F.array_distinct(F.max_by("uses", "known_at"))).alias("uses"))
    rows = wanted.select("source_id").distinct().join(sources.select("source_id", "origin", F.lit(True).alias("declared")), "source_id", "left").join(rights, "source_id", "left")
    for name, table in captures.items():
        rows = rows.join(table.groupBy("source_id").agg(F.count("*").alias(name)), "source_id", "left")
    may = F.coalesce(F.array_contains("uses", "storage") & F.array_contains("uses", "research"), F.lit(False))
    declared = F.coalesce("declared", F.lit(False))
    blockers = F.array_compact(F.array(
        F.when(~declared, "declare_source"),
        F.when(declared & ~may, "review_storage_and_research"),
        F.when(declared & ~F.coalesce(F.col("origin") == "provider_reported", F.lit(False)), "not_provider_reported"),
    ))
    uses = F.when(declared, F.coalesce("uses", F.array().cast("array<string>")))
    return rows.select("source_id", declared.alias("declared"), "origin", uses.alias("uses"), *[F.coalesce(n, F.lit(0)).alias(n) for n in captures], blockers.alias("blockers"))


def collection_counts(journal: DataFrame, pilot: str, collection: str, kind: str) -> DataFrame:
    """pilot, completed, failed, incomplete: collections by how they ended; one that only started is incomplete."""
    is_ = lambda name: F.bool_or(F.col(kind) == name)
    each = journal.groupBy(pilot, collection).agg(is_("collection_recorded").alias("a"), is_("collection_failed").alias("b"), is_("collection_started").alias("c"))
    count = lambda c: F.count_if(F.expr(c))
    return each.groupBy(pilot).agg(count("a").alias("completed"), count("b").alias("failed"), count("c AND NOT coalesce(a OR b, false)").alias("incomplete"))
