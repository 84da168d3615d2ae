"""What becomes of an import that is tried again, of a job that was broken off, and of the references that imports bring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.functions import times
from chronolake.operators.bitemporal import as_of_join
from chronolake.operators.evidence import first_reason, required
from chronolake.sources.shared import stored


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def attempts(existing: DataFrame, incoming: DataFrame, permissions: DataFrame, supported: list[str]) -> DataFrame:
    """incoming with raw_sha256, kept_version, outcome (new, retried or refused) and reason.

    incoming: source_id, import_id, version (of the normaliser), payload (binary), received_at, processed_at, request (canonical JSON of what was asked).  existing: those
    columns of imports taken before, without payload, and raw_sha256; one a (source_id, import_id).  permissions: source_id, known_at, uses (array).

    A retry is answered by the version that read it at first (kept_version), never by the present one; every other input has to be the
    same.  Attempts of one batch that differ under one id are all refused.  Storage has to be permitted at receipt and at processing,
    research at processing, for retries too.  Nulls in any column are refused, each by its own reason."""
    rows = incoming.withColumn("raw_sha256", F.sha2("payload", 256))
    shape = first_reason(
        ("required_text_missing", ~(required(F.col("source_id")) & required(F.col("import_id")) & required(F.col("version")) & F.col("request").isNotNull())),
        ("payload_required", ~_yes(F.octet_length("payload") > 0)),
        ("processed_before_receipt", ~_yes(F.col("received_at") <= F.col("processed_at"))),
    )
    said = permissions.select("source_id", F.col("known_at").alias("_known"), F.coalesce("uses", F.array().cast("array<string>")).alias("_uses"))
    rows = stored(rows.withColumn("_shape", shape), "attempts")
    asked = rows.select("source_id", F.explode(F.array("received_at", "processed_at")).alias("_moment")).distinct()
    granted = stored(as_of_join(asked, said, "source_id", "_moment", "_known", "_uses", "_found"), "granted")
    for side, at in (("_r", "received_at"), ("_p", "processed_at")):
        found = granted.select(F.col("source_id").alias(f"{side}s"), F.col("_moment").alias(f"{side}m"), F.col("_found").alias(side))
        rows = rows.join(found, (F.col("source_id") == F.col(f"{side}s")) & (F.col(at) == F.col(f"{side}m")), "left")
    fine = F.array_contains("_r", "storage") & F.array_contains("_p", "storage") & F.array_contains("_p", "research")
    rows = rows.withColumn("_reason", F.coalesce("_shape", F.when(~_yes(fine), F.lit("use_not_permitted"))))
    inputs = lambda version: F.sha2(times.canonical_json(raw=F.col("raw_sha256"), received=F.unix_micros("received_at"), processed=F.unix_micros("processed_at"), request=F.col("request"), version=version), 256)
    kept = existing.select(F.col("source_id").alias("_es"), F.col("import_id").alias("_ei"), F.col("version").alias("_version"), inputs(F.lit("")).alias("_inputs"))
    rows = rows.join(kept, (F.col("source_id") == F.col("_es")) & (F.col("import_id") == F.col("_ei")), "left")
    own = rows.where("_reason IS NULL AND _ei IS NULL").groupBy(F.col("source_id").alias("_bs"), F.col("import_id").alias("_bi")).agg((F.min(inputs(F.col("version"))) != F.max(inputs(F.col("version")))).alias("_differ"))
    rows = rows.join(own, (F.col("source_id") == F.col("_bs")) & (F.col("import_id") == F.col("_bi")), "left")
    old = F.col("_ei").isNotNull()
    reason = F.coalesce("_reason", first_reason(
        ("unsupported_archived_version", old & ~_yes(F.col("_version").isin(*supported))),
        ("import_id_of_changed_input", (old & ~_yes(F.col("_inputs") == inputs(F.lit("")))) | _yes(F.col("_differ"))),
    ))
    outcome = F.when(reason.isNotNull(), "refused").when(old, "retried").otherwise("new")
    version = F.when(reason.isNull(), F.coalesce("_version", "version"))
    return rows.select(*incoming.columns, "raw_sha256", version.alias("kept_version"), outcome.alias("outcome"), reason.alias("reason"))


def binding_faults(bindings: DataFrame, listings: DataFrame) -> DataFrame:
    """import_id, reasons (sorted) of imports whose symbols are not bound to listings one to one.

    bindings: import_id, symbol, listing_id, currency (of the request).  listings: listing_id (unique), trading_currency.  Reasons: a text is missing, the
    listing is unknown or of another currency, two symbols mean one listing, a symbol means two."""
    rows = bindings.join(listings.select("listing_id", "trading_currency"), "listing_id", "left")
    each = [
        ("required_text_missing", ~(required(F.col("symbol")) & required(F.col("listing_id")))),
        ("unknown_listing", F.col("listing_id").isNotNull() & F.col("trading_currency").isNull()),
        ("currency_differs", F.col("trading_currency") != F.col("currency")),
    ]
    found = rows.select("import_id", F.explode(F.array_compact(F.array(*[F.when(c, name) for name, c in each]))).alias("reason"))
    for one, other, name in (("listing_id", "symbol", "symbols_share_a_listing"), ("symbol", "listing_id", "symbol_of_several_listings")):
        shared = bindings.groupBy("import_id", one).agg((F.min(other) != F.max(other)).alias("_several")).where("_several")
        found = found.unionByName(shared.select("import_id", F.lit(name).alias("reason")))
    return found.distinct().groupBy("import_id").agg(F.array_sort(F.collect_list("reason")).alias("reasons"))  # a reason once an import


def resumption(requests: DataFrame, jobs: DataFrame, pages: DataFrame, results: DataFrame, result_pages: DataFrame, now: Column) -> DataFrame:
    """job_id, action, next_page, token of each request for a job: what a job that is asked for again goes on with.

    requests: job_id (unique), request (canonical JSON).  jobs: job_id (unique), request, created_at.  pages: job_id, page (from 0), body, sha256 (of the body), next_token, all that
    the journal holds.  results: job_id (unique), available_at.  result_pages: job_id, page, sha256, as the result states them.

    action, in order: start (nothing is there), request_changed, not_yet_available, journal_altered (a body has another digest, a page is missing or twice), result_differs (result and
    journal hold other pages), finished (the result stands), ended (the last page has no next one, only the result is missing), resume at next_page with the
    token of the page before.  Pages are compared a page a row, so no job is gathered."""
    journal = pages.groupBy("job_id").agg(F.count("*").alias("_n"), F.count_distinct("page").alias("_d"), F.min("page").alias("_a"), F.max("page").alias("_b"), F.bool_and(_yes(F.sha2("body", 256) == F.col("sha256"))).alias("_whole"), F.max_by(F.struct("next_token"), "page").alias("_last"))
    side = lambda df, n: df.select("job_id", "page", "sha256", F.lit(n).alias("_side"))
    apart = side(pages, 1).unionByName(side(result_pages, -1)).groupBy("job_id", "page", "sha256").agg(F.sum("_side").alias("_s")).where("_s <> 0").select("job_id").distinct().withColumn("_apart", F.lit(True))
    rows = requests.select("job_id", F.col("request").alias("_asked")).join(jobs.select("job_id", "request", "created_at", F.lit(True).alias("_job")), "job_id", "left").join(journal, "job_id", "left").join(results.select("job_id", "available_at", F.lit(True).alias("_result")), "job_id", "left").join(apart, "job_id", "left")
    dense = (F.col("_n") == F.col("_d")) & (F.col("_a") == 0) & (F.col("_b") == F.col("_n") - 1) & F.col("_whole")
    ended = F.col("_n").isNotNull() & F.col("_last.next_token").isNull()
    action = F.coalesce(first_reason(
        ("start", F.col("_job").isNull()),
        ("request_changed", ~_yes(F.col("_asked") == F.col("request"))),
        ("not_yet_available", ~_yes(F.col("created_at") <= now) | (F.col("_result").isNotNull() & ~_yes(F.col("available_at") <= now))),
        ("journal_altered", F.col("_n").isNotNull() & ~_yes(dense)),
        ("result_differs", F.col("_result").isNotNull() & F.col("_apart").isNotNull()),
        ("finished", F.col("_result").isNotNull()),
        ("ended", ended),
    ), F.lit("resume"))
    goes = action.isin("start", "resume")
    return rows.select("job_id", action.alias("action"), F.when(goes, F.coalesce(F.when(F.col("_job"), F.col("_n")), F.lit(0)).cast("long")).alias("next_page"), F.when(action == "resume", F.col("_last.next_token")).alias("token"))


def native_faults(bindings: DataFrame, targets: DataFrame) -> DataFrame:
    """bindings with reason (null: may be put): a broker's name for an instrument may not change what the instrument is.

    bindings: asset_kind, internal_id, native_id, symbol, currency, venue_mic, price_tick, quantity_step, minimum_quantity (decimals or texts of them).  targets: asset_kind, internal_id (unique
    with it), currency, venue_mic of all registered listings and futures."""
    known = targets.select(F.col("asset_kind").alias("_kind"), F.col("internal_id").alias("_id"), F.col("currency").alias("_currency"), F.col("venue_mic").alias("_venue"), F.lit(True).alias("_known"))
    rows = bindings.join(known, (F.col("asset_kind") == F.col("_kind")) & (F.col("internal_id") == F.col("_id")), "left")
    n = {c: times.number(F.col(c).cast("string")) for c in ("price_tick", "quantity_step", "minimum_quantity")}
    positive = reduce(lambda a, b: a & b, [_yes(x > 0) for x in n.values()])
    whole = (n["quantity_step"] == F.floor(n["quantity_step"])) & (n["minimum_quantity"] == F.floor(n["minimum_quantity"]))
    reason = first_reason(
        ("required_text_missing", ~(required(F.col("native_id")) & required(F.col("symbol")))),
        ("unknown_target", F.col("_known").isNull()),
        ("currency_or_venue_differs", ~_yes((F.col("currency") == F.col("_currency")) & (F.col("venue_mic") == F.col("_venue")))),
        ("amounts_not_positive", ~positive),
        ("fractional_lots_of_a_future", (F.col("asset_kind") == "future") & ~_yes(whole)),
    )
    return rows.select(*bindings.columns, reason.alias("reason"))


def beside_evidence(snapshots: DataFrame, evidence: DataFrame) -> DataFrame:
    """snapshots with evidence_source, raw_sha256, reason: the evidence each rests on is there, of the snapshot's source, and was received by the time the snapshot was known.

    snapshots: evidence_id, source_id, known_at.  evidence: evidence_id (unique), source_id, received_at, sha256."""
    kept = evidence.select(F.col("evidence_id").alias("_e"), F.col("source_id").alias("evidence_source"), F.col("received_at").alias("_received"), F.col("sha256").alias("raw_sha256"))
    rows = snapshots.join(kept, F.col("evidence_id") == F.col("_e"), "left")
    reason = first_reason(("evidence_unknown", F.col("_e").isNull()), ("evidence_of_another_source", ~_yes(F.col("source_id") == F.col("evidence_source"))), ("known_before_receipt", ~_yes(F.col("_received") <= F.col("known_at"))))
    return rows.select(*snapshots.columns, "evidence_source", "raw_sha256", reason.alias("reason"))


def set_relations(left: DataFrame, right: DataFrame, group: str, member: str) -> DataFrame:
    """group, only_left, only_right, both, relation (equal, subset, superset, disjoint, overlapping) of the sets of members that two sides have.

    A repeated member counts once; a null one is a member; a group that a side lacks has the empty set there, which is a subset.  Members meet
    by a shuffle on group and member, partial sums do the rest: no set is gathered."""
    side = lambda df, a, b: df.select(group, member, F.lit(a).alias("_l"), F.lit(b).alias("_r"))
    each = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(group, member).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    sums = each.groupBy(group).agg(F.count_if((F.col("_l") == 1) & (F.col("_r") == 0)).alias("only_left"), F.count_if((F.col("_l") == 0) & (F.col("_r") == 1)).alias("only_right"), F.count_if((F.col("_l") == 1) & (F.col("_r") == 1)).alias("both"))
    none = lambda c: F.col(c) == 0
    relation = F.when(none("only_left") & none("only_right"), "equal").when(none("only_left"), "subset").when(none("only_right"), "superset").when(none("both"), "disjoint").otherwise("overlapping")
    return sums.withColumn("relation", relation)
