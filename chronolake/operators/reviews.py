"""Reviews of captures: what may be recorded, and whether the captures themselves still bear a declared purpose.

A review is an assertion about one scope: the exact captures, listing, days and feed it names.  Scopes are compared by a digest of all
their fields, and captures by the digest of their payload, which is taken again here; what a capture states about itself is not trusted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.functions import times
from chronolake.operators.bitemporal import as_of_join
from chronolake.operators.evidence import first_reason, required
from chronolake.operators.jobs import AXES
from chronolake.sources.shared import stored

# Names that reviews and their reasons have.
SCOPE = ("bar_import_id", "calendar_import_id", "bar_raw_sha", "calendar_raw_sha", "listing_id", "venue", "start_date", "end_date", "feed")
PURPOSES = {"synthetic_validation": "synthetic_fixture_only", "forward_observation": "observed_receipt_and_processing", "historical_replay": "documented_publication_vintage"}
USES = ("storage", "research", "training")
FEEDS = ("iex", "sip")

_REVIEW = ("review_id", "source_id", "axis", "purpose", "scope_sha256", "known_at")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def scope_digest(scope: str) -> Column:
    """The digest of a scope (a struct of texts), by the canonical JSON of its fields."""
    return F.sha2(times.canonical_json(**{k: F.col(scope)[k] for k in SCOPE}), 256)


def scope_fault(scope: str) -> Column:
    """The first fault of a scope: texts, canonical days in order, feed, digests; null for none."""
    of = {k: F.col(scope)[k] for k in SCOPE}
    day = lambda c: _yes(F.date_format(F.try_to_date(c, "yyyy-MM-dd"), "yyyy-MM-dd") == c)
    sha = lambda c: _yes(c.rlike("^[0-9a-f]{64}$"))
    return first_reason(
        ("scope_text_missing", ~reduce(lambda a, b: a & b, [required(c) for c in of.values()])),
        ("canonical_scope_dates_required", ~(day(of["start_date"]) & day(of["end_date"]))),
        ("invalid_scope_interval_or_feed", (of["start_date"] > of["end_date"]) | ~of["feed"].isin(*FEEDS)),
        ("exact_capture_hashes_required", ~(sha(of["bar_raw_sha"]) & sha(of["calendar_raw_sha"]))),
    )


def _with_uses(rows: DataFrame, permissions: DataFrame, at: str) -> DataFrame:
    """rows with _permitted: the last permission of their source up to ``at`` names storage and research."""
    said = permissions.select("source_id", F.col("known_at").alias("_known"), F.coalesce("uses", F.array().cast("array<string>")).alias("_uses"))
    found = as_of_join(rows, said, "source_id", at, "_known", "_uses", "_found")
    both = F.col("source_id").isNotNull() & F.array_contains("_found", "storage") & F.array_contains("_found", "research")
    return found.select(*rows.columns, _yes(both).alias("_permitted"))


def record(existing: DataFrame, incoming: DataFrame, permissions: DataFrame, evidence: DataFrame) -> DataFrame:
    """incoming with scope_sha256, review_sha256, outcome (new, same or refused) and reason, null unless it is refused.

    incoming: review_id, source_id, axis, purpose, decision, scope (struct of ``SCOPE``, texts), known_at, recorded_at, expires_at, reviewer, evidence_refs (array),
    temporal_basis, declared_rights (array).  existing: those columns of the rows taken before, with both digests.  permissions: source_id, known_at, uses (array); the last one counts.
    evidence: evidence_id (unique), source_id, received_at, sha256, payload (binary), whose digest is taken again.

    A review is known when it is recorded, expires after that, names evidence its source had by then, and never changes; equal rows
    of a batch are each new.  Nulls in any column are refused by the rule for it."""
    rights = F.col("declared_rights")
    known_rights = _yes(F.forall(rights, lambda r: _yes(r.isin(*USES))) & (F.size(F.array_distinct(rights)) == F.size(rights)))
    refs = F.col("evidence_refs")
    body = {c: F.col(c).cast("string") for c in ("review_id", "source_id", "axis", "purpose", "decision", "reviewer", "temporal_basis")}
    body |= {c: F.unix_micros(c).cast("string") for c in ("known_at", "expires_at")} | {"scope_sha256": F.col("scope_sha256"), "evidence_refs": F.array_sort(refs), "declared_rights": F.array_sort(rights)}
    rows = incoming.withColumn("scope_sha256", scope_digest("scope")).withColumn("review_sha256", F.sha2(times.canonical_json(**body), 256))
    shape = first_reason(
        ("required_text_missing", ~(required(F.col("review_id")) & required(F.col("source_id")) & required(F.col("reviewer")))),
        ("unknown_axis_purpose_or_decision", ~_yes(F.col("axis").isin(*AXES) & F.col("purpose").isin(*PURPOSES) & F.col("decision").isin("allow", "deny"))),
        ("declared_rights_of_rights_reviews_only", F.when(F.col("axis") == "rights", ~known_rights).otherwise(rights.isNotNull())),
    )
    shape = F.coalesce(shape, scope_fault("scope"))
    shape = F.coalesce(shape, first_reason(
        ("availability_is_not_recording_time", ~_yes(F.col("known_at") == F.col("recorded_at"))),
        ("expiry_not_after_availability", ~_yes(F.col("known_at") < F.col("expires_at"))),
        ("temporal_basis_of_temporal_reviews_only", F.when(F.col("axis") == "temporal", ~_yes(F.col("temporal_basis").isin(*PURPOSES.values()))).otherwise(F.col("temporal_basis").isNotNull())),
        ("unique_evidence_required", ~_yes((F.size(refs) > 0) & F.forall(refs, required) & (F.size(F.array_distinct(refs)) == F.size(refs)))),
    ))
    rows = rows.withColumns({"_shape": shape, "_key": F.unhex("review_sha256")})
    # The digest covers all that the rules below ask for, so a review is its digest from here on and only ids and digests are shuffled and
    # stored; a refused one has no id and no place any more.
    place = F.unhex(F.sha2(times.canonical_json(**{c: F.col(c).cast("string") for c in _REVIEW[1:]}), 256))
    asked = _with_uses(rows.where("_shape IS NULL").select("_key", "review_id", place.alias("_place"), "source_id", "known_at", "evidence_refs"), permissions, "known_at")
    named = asked.select("_key", "source_id", "known_at", "_permitted", F.explode("evidence_refs").alias("evidence_id"), *[F.when(F.col("_permitted"), F.col(c)).alias(c) for c in ("review_id", "_place")])
    kept = evidence.select("evidence_id", F.col("source_id").alias("_of"), "received_at", _yes(F.sha2("payload", 256) == F.col("sha256")).alias("_whole"))
    there = _yes((F.col("_of") == F.col("source_id")) & (F.col("received_at") <= F.col("known_at")))
    found = named.join(kept, "evidence_id", "left").select("_key", "review_id", "_place", "_permitted", there.alias("_there"), (~there | F.col("_whole")).alias("_intact"), F.lit(False).alias("_taken"))
    flag = F.lit(None).cast("boolean")
    taken = existing.select(F.unhex("review_sha256").alias("_key"), "review_id", place.alias("_place"), flag.alias("_permitted"), flag.alias("_there"), flag.alias("_intact"), F.lit(True).alias("_taken"))
    judged = found.unionByName(taken).groupBy("_key", "review_id", "_place").agg(*[F.bool_and(c).alias(c) for c in ("_permitted", "_there", "_intact")], F.bool_or("_taken").alias("_old"), F.bool_or(~F.col("_taken")).alias("_asked"))
    why = first_reason(("use_not_permitted", ~F.col("_permitted")), ("evidence_unknown_or_late", ~F.col("_there")), ("evidence_digest_differs", ~F.col("_intact")))
    judged = stored(judged.select("_key", "review_id", "_place", "_old", "_asked", why.alias("_why")), "judged")
    # What was taken before stands; of a batch, all that would differ under one id, or under one place, are refused.  A digest is one row here.
    standing = judged.where("_old OR _why IS NULL")
    several = lambda c: stored(standing.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(c, F.lit(True).alias(f"_d{c}")), f"several{c}")
    judged = judged.where("_asked").drop("_asked")
    fit = judged.where("_why IS NULL").join(several("review_id"), "review_id", "left").join(several("_place"), "_place", "left")
    clash = first_reason(("review_changed", F.col("_dreview_id") & ~F.col("_old")), ("another_review_at_this_time", F.col("_d_place") & ~F.col("_old")))
    decided = fit.select("_key", "_old", clash.alias("_why")).unionByName(judged.where("_why IS NOT NULL").select("_key", "_old", "_why"))
    rows = rows.join(decided, "_key", "left")
    final = F.coalesce("_shape", "_why")
    outcome = F.when(final.isNotNull(), "refused").when(_yes(F.col("_old")), "same").otherwise("new")
    return rows.select(*incoming.columns, "scope_sha256", "review_sha256", outcome.alias("outcome"), final.alias("reason"))


def _declared(requests: DataFrame, reviews: DataFrame) -> DataFrame:
    """request, _missing (axes in order of name), _basis (both temporal reviews have the purpose's basis) of every request.

    A request asks on four axes at two cutoffs; each of the eight looks the latest review up by days of one key, with no pairs."""
    key = lambda axis: F.sha2(times.canonical_json(source=F.col("source_id"), axis=axis, purpose=F.col("purpose"), scope=F.col("scope_sha256")), 256)
    ask = requests.withColumn("axis", F.explode(F.array(*map(F.lit, AXES)))).withColumn("_at", F.explode(F.array("as_of", "now")))
    ask = ask.select("request", "purpose", "axis", F.col("_at").alias("_when"), key(F.col("axis")).alias("_key"))
    said = reviews.select(key(F.col("axis")).alias("_key"), "known_at", F.struct("review_id", "decision", "expires_at", "declared_rights", "temporal_basis").alias("_review"))
    found = as_of_join(ask, said, "_key", "_when", "known_at", "_review", "_r")
    right = (F.col("axis") != "rights") | _yes(F.array_contains("_r.declared_rights", "storage") & F.array_contains("_r.declared_rights", "research"))
    allows = _yes((F.col("_r.decision") == "allow") & (F.col("_r.expires_at") > F.col("_when"))) & right
    basis = F.coalesce(*[F.when(F.col("purpose") == p, F.lit(b)) for p, b in PURPOSES.items()])
    axes = found.groupBy("request", "axis").agg(F.bool_and(allows).alias("_ok"), F.bool_and((F.col("axis") != "temporal") | _yes(F.col("_r.temporal_basis") == basis)).alias("_basis"))
    return axes.groupBy("request").agg(F.array_sort(F.collect_list(F.when(~F.col("_ok"), F.col("axis")))).alias("_missing"), F.bool_and("_basis").alias("_basis"))


def _capture(requests: DataFrame, captures: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """requests with the capture of their scope as ``name``, where it was available at as_of, its digest taken again."""
    kept = captures.select(F.col("source_id").alias("_s"), F.col("import_id").alias("_i"), "available_at", F.struct(F.sha2("payload", 256).alias("sha256"), *fields).alias(name))
    found = requests.join(kept, (F.col("source_id") == F.col("_s")) & (F.col(f"scope.{name}_import_id") == F.col("_i")) & (F.col("available_at") <= F.col("as_of")), "left")
    return found.drop("_s", "_i", "available_at")


def assess(requests: DataFrame, reviews: DataFrame, permissions: DataFrame, sources: DataFrame, listings: DataFrame, bar_captures: DataFrame, bar_rows: DataFrame, calendar_captures: DataFrame, calendar_rows: DataFrame) -> DataFrame:
    """request, scope_sha256, eligible, reasons (sorted) of each request to use captures for a declared purpose, as of as_of and of now.

    requests: request (unique), source_id, purpose, as_of, now, scope (struct of ``SCOPE``).  reviews: recorded rows of ``record``.  sources: source_id, origin.
    listings: listing_id, mic.  bar_captures: source_id, import_id (unique with it), payload, available_at, received_at, quarantined (rows), page_complete, pagination_state, feed,
    adjustment, timeframe, market_timezone; bar_rows: source_id, import_id, listing_id, date (text), published_at.  calendar_captures: source_id, import_id, payload,
    available_at, quarantined, calendar_kind, venue, start_date, end_date, market_timezone; calendar_rows: source_id, import_id, date (text), end, published_at.

    On each axis the last review at both cutoffs has to allow, and not to have expired at its cutoff; a review that came after as_of
    and one that was withdrawn by now both count.  Captures are taken as of as_of only.  A scope that is wrong, or a now before as_of, is no
    request: its only reason says so.  Bars meet sessions by day, so rows grow with the bars of the scopes that are asked for."""
    asked = requests.withColumn("scope_sha256", scope_digest("scope"))
    wrong = F.coalesce(scope_fault("scope"), first_reason(("unknown_purpose", ~_yes(F.col("purpose").isin(*PURPOSES))), ("current_cutoff_before_historical_cutoff", ~_yes(F.col("as_of") <= F.col("now")))))
    asked = stored(asked.withColumn("_wrong", wrong), "asked")
    rows = asked.join(_declared(asked, reviews), "request")
    points = asked.select("request", "source_id", F.explode(F.array("as_of", "now")).alias("_moment"))
    uses = _with_uses(points, permissions, "_moment").groupBy("request").agg(F.bool_and("_permitted").alias("_permitted"))
    rows = rows.join(uses, "request")
    rows = _capture(rows, bar_captures, "bar", ["received_at", "quarantined", "page_complete", "pagination_state", "feed", "adjustment", "timeframe", "market_timezone"])
    rows = _capture(rows, calendar_captures, "calendar", ["quarantined", "calendar_kind", "venue", "start_date", "end_date", "market_timezone"])
    rows = rows.join(sources.select("source_id", "origin"), "source_id", "left")
    rows = rows.join(listings.select(F.col("listing_id").alias("_listing"), "mic"), F.col("scope.listing_id") == F.col("_listing"), "left")
    # Sessions once a day of a calendar, then the bars of each request beside them.
    day = calendar_rows.groupBy(F.col("source_id").alias("_s"), F.col("import_id").alias("_i"), F.col("date").alias("_day")).agg(F.max("end").alias("_end"), F.bool_or(F.col("published_at").isNull()).alias("_unknown"))
    whole = day.groupBy("_s", "_i").agg(F.count("*").alias("_sessions"), F.min("_day").alias("_first"), F.max("_day").alias("_last"), F.bool_or("_unknown").alias("_calendar_unknown"))
    wanted = asked.select("request", F.col("source_id").alias("_s"), F.col("scope.bar_import_id").alias("_b"), F.col("scope.calendar_import_id").alias("_i"), F.col("scope.listing_id").alias("_l"))
    bars = bar_rows.select(F.col("source_id").alias("_s"), F.col("import_id").alias("_b"), F.col("listing_id").alias("_l"), F.col("date").alias("_day"), "published_at")
    received = bar_captures.select(F.col("source_id").alias("_s"), F.col("import_id").alias("_b"), F.col("received_at").alias("_received"))
    beside = wanted.join(bars, ["_s", "_b", "_l"]).join(received, ["_s", "_b"], "left").join(day.drop("_unknown"), ["_s", "_i", "_day"], "left")
    daily = beside.groupBy("request", "_day").agg(F.count("*").alias("_n"), F.bool_or(F.col("published_at").isNull()).alias("_null"), F.bool_and(F.col("_end").isNotNull()).alias("_met"), F.bool_or(_yes(F.col("_received") < F.col("_end"))).alias("_early"))
    covered = daily.groupBy("request").agg(F.count("*").alias("_days"), F.bool_and((F.col("_n") == 1) & F.col("_met")).alias("_once"), F.bool_or("_early").alias("_early"), F.bool_or("_null").alias("_bar_unknown"))
    rows = rows.join(covered, "request", "left").join(whole.withColumnsRenamed({"_s": "_cs", "_i": "_ci"}), (F.col("source_id") == F.col("_cs")) & (F.col("scope.calendar_import_id") == F.col("_ci")), "left")
    scope = lambda f: F.col("scope")[f]
    there = F.col("bar").isNotNull() & F.col("calendar").isNotNull()
    same_days = (F.col("_sessions") == F.col("_days")) & F.col("_once") & (F.col("_first") >= scope("start_date")) & (F.col("_last") <= scope("end_date"))
    request = (F.col("calendar.calendar_kind") == "TRADING") & (F.col("calendar.venue") == scope("venue")) & (F.col("calendar.start_date") == scope("start_date")) & (F.col("calendar.end_date") == scope("end_date")) & (F.col("calendar.market_timezone") == F.col("bar.market_timezone"))
    identity = (F.col("mic") == scope("venue")) & (F.col("bar.feed") == scope("feed")) & (F.col("bar.adjustment") == "raw") & (F.col("bar.timeframe") == "1Day")
    synthetic = F.col("purpose") == "synthetic_validation"
    unknown = _yes(F.col("_calendar_unknown")) | _yes(F.col("_bar_unknown"))
    reasons = [
        (~there, "capture_unavailable_at_cutoff"),
        (there & ~_yes((F.col("bar.sha256") == scope("bar_raw_sha")) & (F.col("calendar.sha256") == scope("calendar_raw_sha"))), "capture_hash_mismatch"),
        (there & ~_yes((F.col("bar.quarantined") == 0) & (F.col("calendar.quarantined") == 0)), "quarantined_capture_rows"),
        (there & ~_yes(F.col("bar.page_complete") & (F.col("bar.pagination_state") == "terminal_page")), "unresolved_price_pages"),
        (there & ~_yes(identity), "identity_or_feed_scope_mismatch"),
        (there & ~_yes(request), "calendar_request_scope_mismatch"),
        (there & ~_yes(same_days), "price_calendar_date_coverage_mismatch"),
        (there & _yes(F.col("_early")), "daily_bar_not_complete_at_observation"),
        (there & unknown & (F.col("purpose") == "historical_replay"), "historical_publication_or_vintage_unknown"),
        (there & ~F.col("_basis"), "temporal_review_basis_mismatch"),
        (~synthetic & ~_yes(F.col("origin") == "provider_reported"), "provider_origin_required_for_real_use"),
        (synthetic & ~_yes(F.col("origin") == "synthetic_fixture"), "synthetic_origin_required_for_fixture_validation"),
    ]
    told = F.concat(F.transform("_missing", lambda a: F.concat(a, F.lit("_review_missing_denied_or_expired"))), F.array_compact(F.array(*[F.when(c, name) for c, name in reasons])))
    final = F.when(F.col("_wrong").isNotNull(), F.array("_wrong")).when(~F.col("_permitted"), F.array(F.lit("use_not_permitted"))).otherwise(F.array_sort(told))
    return rows.withColumn("reasons", final).select("request", "scope_sha256", (F.size("reasons") == 0).alias("eligible"), "reasons")
