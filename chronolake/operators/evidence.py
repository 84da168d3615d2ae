"""Sources, rights, dimensions and versions of evidence: what may enter, and what is known of it.

Every function takes batches and gives each row a reason, null where it is admitted; nothing is written here.  Rows that are
admitted are appended by the caller; ids depend on content alone, so a retried batch has the same ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.operators.bitemporal import as_of_join, live_nodes, until_next
from chronolake.sources.shared import stored


def required(text: Column) -> Column:
    """Whether a text is not empty and has no blank at its ends; null is not."""
    return F.coalesce(text.rlike(r"(?s)^\S(.*\S)?$"), F.lit(False))


def currency(text: Column) -> Column:
    """Whether a text is a three-letter code in capitals; null is not."""
    return F.coalesce(text.rlike("^[A-Z]{3}$"), F.lit(False))


def venue(text: Column) -> Column:
    """Whether a text is a four-character market identifier; null is not."""
    return F.coalesce(text.rlike("^[A-Z0-9]{4}$"), F.lit(False))


def first_reason(*reasons: tuple[str, Column]) -> Column:
    """The name of the first condition that holds; an unknown condition does not."""
    return F.coalesce(*[F.when(c, name) for name, c in reasons])


def evidence_id(*parts: str) -> Column:
    """A deterministic id of the parts; nulls differ from empty texts."""
    return F.substring(F.sha2(F.to_json(F.array(*[F.col(p).cast("string") for p in parts])), 256), 1, 32)


def allowed(requests: DataFrame, permissions: DataFrame, source: str = "source_id", use: str = "use", at: str = "as_of") -> DataFrame:
    """requests with allowed: the latest permission row of the source up to the request's time names its use.

    permissions: source, known_at, uses (array).  A source without any row yet, or a null one, is denied; an empty or null array
    takes back what was allowed before.  One pass over the days of each source, no pairs of requests and permissions."""
    said = permissions.select(F.col(source), F.col("known_at").alias("_known"), F.coalesce("uses", F.array().cast("array<string>")).alias("_uses"))
    found = as_of_join(requests, said, source, at, "_known", "_uses", "_found")
    yes = F.col(source).isNotNull() & F.array_contains("_found", F.col(use))
    return found.withColumn("allowed", F.coalesce(yes, F.lit(False))).select(*requests.columns, "allowed")


def register(existing: DataFrame, incoming: DataFrame, keys: list[str], references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """incoming with outcome: new, same, conflict, or unknown_<column> where a value of ``references`` is not registered.

    references: column -> (table, its key column); only keys are looked up, each once.  Rows of a batch that differ under one key are
    all conflicts, as are those that differ from the stored row."""
    fields = [c for c in incoming.columns if c not in keys]
    body = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(fields)]), {"ignoreNullFields": "false"}), 256)
    both = incoming.select(*keys, body.alias("_sha"), F.lit(True).alias("_new")).unionByName(existing.select(*keys, body.alias("_sha"), F.lit(False).alias("_new")))
    found = both.groupBy(*keys).agg(F.min("_sha").alias("_a"), F.max("_sha").alias("_b"), F.bool_and("_new").alias("_fresh"))
    found = found.withColumnsRenamed({k: f"_k{n}" for n, k in enumerate(keys)})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)])
    rows = incoming.join(found, same)
    unknown = []
    for n, (column, (table, key)) in enumerate((references or {}).items()):
        rows = rows.join(table.select(F.col(key).alias(f"_r{n}")).distinct(), F.col(column) == F.col(f"_r{n}"), "left")
        unknown.append((f"unknown_{column}", F.col(f"_r{n}").isNull()))
    outcome = F.coalesce(first_reason(*unknown, ("conflict", F.col("_a") != F.col("_b")), ("new", F.col("_fresh"))), F.lit("same"))
    return rows.withColumn("outcome", outcome).select(*incoming.columns, "outcome")


def ingest(existing: DataFrame, incoming: DataFrame, permissions: DataFrame) -> DataFrame:
    """evidence_id, source_id, record_id, revision_id, sha256, published_at, received_at, correction_of, outcome, reason of ``incoming``.

    incoming: source_id, record_id, revision_id, payload (binary), published_at, received_at, correction_of (an evidence_id).
    existing: what this gave as new before.  The first receipt of a revision is its version, later ones with the same content are
    observations (outcome seen_again); reasons in order: a required text or the payload is missing, publication after receipt,
    storage is not permitted at receipt, the revision has other content or would be dated back, the corrected version is not
    an earlier one of the same record, another revision of the record has the same receipt time."""
    ids = ["source_id", "record_id", "revision_id"]
    new = incoming.select(*ids, F.sha2("payload", 256).alias("sha256"), "published_at", "received_at", "correction_of", F.coalesce(F.octet_length("payload") > 0, F.lit(False)).alias("_payload"))
    new = allowed(new.withColumn("_use", F.lit("storage")), permissions, use="_use", at="received_at").withColumnRenamed("allowed", "_allowed").drop("_use")
    start = first_reason(
        ("required_text_missing", ~(required(F.col("record_id")) & required(F.col("revision_id")))),
        ("payload_required", ~F.col("_payload")),
        ("published_after_receipt", F.col("published_at").isNull() | F.col("received_at").isNull() | (F.col("published_at") > F.col("received_at"))),
        ("storage_not_permitted", ~F.col("_allowed")),
    )
    new = new.withColumns({"_reason": start, "evidence_id": evidence_id(*ids)})
    content = F.struct("sha256", "published_at", "correction_of")
    candidates = new.where("_reason IS NULL").select("evidence_id", "source_id", "record_id", "received_at", content.alias("_content"), F.lit(1).alias("_old"))
    known = existing.select("evidence_id", "source_id", "record_id", "received_at", content.alias("_content"), F.lit(0).alias("_old"))
    both = known.unionByName(candidates)
    versions = both.groupBy("evidence_id").agg(F.min_by(F.struct("source_id", "record_id", "received_at", "_content", "_old"), F.struct("_old", "received_at", "_content")).alias("v"))
    versions = versions.select("evidence_id", "v.*")
    clash = versions.groupBy("source_id", "record_id", "received_at").agg(F.count("*").alias("_n"), F.min("_old").alias("_o")).where("_n > 1")
    first = versions.select("evidence_id", F.col("received_at").alias("_first"), F.col("_content").alias("_is"), F.col("_old").alias("_was"))
    corrected = versions.select(F.col("evidence_id").alias("correction_of"), F.struct("source_id", "record_id", "received_at").alias("_before"))
    rows = new.join(first, "evidence_id", "left").join(corrected, "correction_of", "left")
    rows = rows.join(clash.select("source_id", "record_id", F.col("received_at").alias("_first"), F.lit(True).alias("_clash")), ["source_id", "record_id", "_first"], "left")
    fine = F.col("correction_of").isNull() | ((F.col("_before.source_id") == F.col("source_id")) & (F.col("_before.record_id") == F.col("record_id")) & (F.col("_before.received_at") < F.col("received_at")))
    reason = F.coalesce(
        "_reason",
        first_reason(
            ("revision_conflict", ~F.col("_is").eqNullSafe(content) | (F.col("received_at") < F.col("_first"))),
            ("correction_of_no_earlier_version", ~F.coalesce(fine, F.lit(False))),
            ("indistinguishable_receipt", (F.col("_was") == 1) & F.coalesce("_clash", F.lit(False))),
        ),
    )
    seen = F.when(F.col("_was") == 1, F.when(F.col("received_at") == F.col("_first"), "new").otherwise("seen_again")).otherwise("seen_again")
    return rows.select("evidence_id", *ids, "sha256", "published_at", "received_at", "correction_of", F.when(reason.isNull(), seen).otherwise("quarantined").alias("outcome"), reason.alias("reason"))


def evidence_as_of(versions: DataFrame, sources: DataFrame, raw: DataFrame, permissions: DataFrame, requests: DataFrame, use: str = "research") -> DataFrame:
    """request, status, evidence_id, origin of each request (request, source_id, record_id, as_of): what was last received by then.

    versions: evidence_id, source_id, record_id, sha256, received_at; sources: source_id, origin; raw: sha256, payload.  status:
    use_not_allowed, unknown, payload_corrupt (the archived bytes do not have their digest), or known."""
    asked = allowed(requests.withColumn("_use", F.lit(use)), permissions, use="_use").drop("_use")
    record = F.when(F.col("source_id").isNotNull() & F.col("record_id").isNotNull(), F.struct("source_id", "record_id"))
    named = versions.select(record.alias("_record"), F.col("received_at").alias("_received"), F.struct("evidence_id", "sha256").alias("_e")).where("_record IS NOT NULL")
    seen = as_of_join(asked.where("allowed").select("request", record.alias("_record"), "as_of"), named, "_record", "as_of", "_received", "_e", "e")
    last = seen.select("request", "e").distinct()
    whole = raw.select("sha256", (F.sha2("payload", 256) == F.col("sha256")).alias("_whole"))
    rows = asked.join(last, "request", "left").select("request", "source_id", "allowed", F.col("e.evidence_id").alias("evidence_id"), F.col("e.sha256").alias("sha256"))
    rows = rows.join(whole, "sha256", "left").join(sources.select("source_id", "origin"), "source_id", "left")
    status = F.when(~F.col("allowed"), "use_not_allowed").when(F.col("evidence_id").isNull(), "unknown").when(~F.coalesce("_whole", F.lit(False)), "payload_corrupt").otherwise("known")
    return rows.select("request", status.alias("status"), "evidence_id", F.when(status == "known", F.col("origin")).alias("origin"))


def check_identifiers(incoming: DataFrame, versions: DataFrame, permissions: DataFrame) -> DataFrame:
    """incoming identifier versions with reason: what may be put.

    incoming: mapping_id, known_at, provider, value, listing_id, valid_from, valid_to, evidence_id; versions: evidence_id, source_id,
    received_at.  In order: a text is missing, the interval is empty, the evidence is unknown at known_at, its source may not
    be used for research then."""
    texts = reduce(lambda a, b: a & b, [required(F.col(c)) for c in ("mapping_id", "provider", "value", "listing_id")])
    rows = incoming.join(versions.select("evidence_id", F.col("source_id").alias("_of"), F.col("received_at").alias("_received")), "evidence_id", "left")
    rows = allowed(rows.withColumn("_use", F.lit("research")), permissions.withColumnRenamed("source_id", "_of"), source="_of", use="_use", at="known_at")
    reason = first_reason(
        ("required_text_missing", ~texts),
        ("empty_interval", F.col("valid_from").isNull() | (F.col("valid_to") <= F.col("valid_from"))),
        ("evidence_not_known", F.col("_received").isNull() | (F.col("_received") > F.col("known_at"))),
        ("use_not_allowed", ~F.col("allowed")),
    )
    return rows.withColumn("reason", reason).select(*incoming.columns, "reason")


def identifier_matches(requests: DataFrame, versions: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """request, as_of, mapping_id, known_at, listing_id, valid_from, valid_to and ``carried`` columns of every version that answers a request (request, provider, value, effective_at, as_of).

    versions: mapping_id, known_at, provider, value, listing_id, valid_from, valid_to.  Of each mapping the version last known at as_of counts, before provider, value and
    validity are looked at.  One sort gives each version the time up to which it is the last one known; a request then meets, in the binary
    ranges of its identifier's times, only versions that are the last known of their mapping at its own time."""
    body = ["provider", "value", "listing_id", "valid_from", "valid_to", *carried]
    said = versions.where("known_at IS NOT NULL").groupBy("mapping_id", "known_at").agg(F.max(F.struct(*body)).alias("v"))
    spans = until_next(said.select("mapping_id", "known_at", "v.*"), ["mapping_id"], "known_at", "_known_to")
    spans = stored(spans.where("provider IS NOT NULL AND value IS NOT NULL AND (valid_to IS NULL OR valid_to > valid_from)"), "spans")
    points, live = live_nodes(requests.select("request", "provider", "value", "effective_at", "as_of"), spans, ["provider", "value"], "as_of", "known_at", "_known_to")
    met = points.join(live.drop("_known_to"), ["provider", "value", "_level", "_node"])
    return met.where("valid_from <= effective_at AND (valid_to IS NULL OR effective_at < valid_to)").drop("_level", "_node")


def resolve_identifiers(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """request, status, listings, listing_id: what the identifiers of many requests meant, each at its own times.

    The status is resolved, unknown or ambiguous by the number of different listings among the versions of ``identifier_matches``; request is unique."""
    found = identifier_matches(requests, versions).groupBy("request").agg(F.count_distinct("listing_id").alias("listings"), F.max("listing_id").alias("listing_id"))
    n = F.coalesce("listings", F.lit(0))
    status = F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unknown")
    return requests.select("request").join(found, "request", "left").select("request", status.alias("status"), n.alias("listings"), F.when(n == 1, F.col("listing_id")).alias("listing_id"))


def listing_identities(listings: DataFrame, instruments: DataFrame, kinds: tuple[str, ...] = ("equity", "etf")) -> DataFrame:
    """listings with the columns of their instrument and supported: it is there and of one of ``kinds``."""
    found = listings.join(instruments, "instrument_id", "left")
    return found.withColumn("supported", F.coalesce(F.col("kind").isin(*kinds), F.lit(False)))


def identifier_lineage(requests: DataFrame, versions: DataFrame, evidence: DataFrame, raw: DataFrame, permissions: DataFrame, listings: DataFrame, instruments: DataFrame) -> DataFrame:
    """request, status, listing_id, entity_id, versions, manifest_sha256: what an identifier meant, and whether all that says so still holds.

    versions also have evidence_id; evidence: evidence_id, source_id, sha256, published_at, received_at; raw: sha256, payload; permissions as in ``allowed``; listings: listing_id,
    instrument_id; instruments: instrument_id, entity_id, kind.  In order: unknown, ambiguous, evidence_unknown, use_not_allowed (of any source, at as_of), evidence_times
    (received after it was asserted, or published after receipt), payload_corrupt (the archived bytes do not have their digest), unsupported_instrument, or
    verified.  The manifest of a verified request is the digest of the sorted digests of its versions and their payloads.  Every payload is digested once; a
    request's list is as long as the versions that answer it."""
    matches = identifier_matches(requests, versions, ("evidence_id",))
    whole = raw.select("sha256", (F.sha2(F.col("payload").cast("binary"), 256) == F.col("sha256")).alias("_whole"))
    proofs = evidence.select("evidence_id", "source_id", "sha256", "published_at", "received_at").join(whole, "sha256", "left")
    rows = matches.join(proofs, "evidence_id", "left")
    rows = allowed(rows.withColumn("_use", F.lit("research")), permissions, use="_use")
    micros = lambda c: F.unix_micros(c).alias(c)
    mapping = F.to_json(F.struct("evidence_id", micros("known_at"), "listing_id", "mapping_id", "provider", micros("valid_from"), micros("valid_to"), "value"), {"ignoreNullFields": "false"})
    fault = F.when(F.col("received_at").isNull(), 1).when(~F.col("allowed"), 2).when((F.col("received_at") > F.col("known_at")) | ~F.coalesce(F.col("published_at") <= F.col("received_at"), F.lit(False)), 3).when(~F.coalesce("_whole", F.lit(False)), 4)
    digest = F.concat(F.sha2(mapping, 256), F.lit(":"), F.col("sha256"))
    found = rows.groupBy("request").agg(F.count_distinct("listing_id").alias("_listings"), F.max("listing_id").alias("listing_id"), F.count("*").alias("versions"), F.min(fault).alias("_fault"), F.array_sort(F.collect_list(digest)).alias("_digests"))
    known = listing_identities(listings.select("listing_id", "instrument_id"), instruments.select("instrument_id", "entity_id", "kind")).select("listing_id", "entity_id", "supported")
    joined = requests.select("request").join(found, "request", "left").join(known, "listing_id", "left")
    faults = F.element_at(F.array(*map(F.lit, ("evidence_unknown", "use_not_allowed", "evidence_times", "payload_corrupt"))), F.col("_fault"))
    status = F.when(F.col("_listings").isNull(), "unknown").when(F.col("_listings") > 1, "ambiguous").when(F.col("_fault").isNotNull(), faults).when(~F.coalesce("supported", F.lit(False)), "unsupported_instrument").otherwise("verified")
    good = lambda c: F.when(status == "verified", c)
    return joined.select("request", status.alias("status"), good(F.col("listing_id")).alias("listing_id"), good(F.col("entity_id")).alias("entity_id"), F.coalesce("versions", F.lit(0)).cast("long").alias("versions"), good(F.sha2(F.array_join("_digests", "\n"), 256)).alias("manifest_sha256"))


def inventory(**tables: DataFrame) -> DataFrame:
    """name, rows, latest: the number of rows of each table, and its largest known_at or received_at where it has one."""
    counts = []
    for name, df in tables.items():
        at = next((c for c in ("recorded_at", "known_at", "received_at") if c in df.columns), None)
        counts.append(df.agg(F.count("*").alias("rows"), (F.max(at) if at else F.lit(None)).cast("timestamp").alias("latest")).select(F.lit(name).alias("name"), "rows", "latest"))
    return reduce(DataFrame.unionByName, counts)
