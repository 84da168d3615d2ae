"""Writing snapshots once under their digest, and reading captures back with everything about them checked again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.functions import times
from chronolake.operators.evidence import allowed, first_reason, required

KEY = ["kind", "target_id", "valid_from", "known_at"]
FIELDS = [*KEY, "valid_to", "evidence_id", "body"]
CAPTURE = ["source_id", "import_id", "input_json", "raw_sha", "available_at", "result_json"]


def fields_sha256(fields: list[str], at: tuple[str, ...]) -> Column:
    """Digest of the canonical JSON of the columns ``fields``; those in ``at`` are instants, written in microseconds."""
    return F.sha2(times.canonical_json(**{c: F.unix_micros(c) if c in at else F.col(c) for c in fields}), 256)


def snapshot_sha256() -> Column:
    """The id of a snapshot: the digest of all its fields."""
    return fields_sha256(FIELDS, ("valid_from", "valid_to", "known_at"))


def _whole(raw: DataFrame) -> DataFrame:
    """sha256, _whole: whether the archived bytes still have the digest they are filed under; each payload is read once."""
    return raw.groupBy("sha256").agg(F.bool_and(F.sha2(F.col("payload").cast("binary"), 256) == F.col("sha256")).alias("_whole"))


def put_snapshots(incoming: DataFrame, existing: DataFrame, evidence: DataFrame, raw: DataFrame, permissions: DataFrame) -> DataFrame:
    """incoming with snapshot_id, outcome (new, seen_again or refused) and reason: what may be added to ``existing``.

    incoming: seq (unique; a smaller one comes first), kind, target_id, body (canonical text), valid_from, valid_to, known_at, evidence_id; existing: the
    same but seq; evidence: evidence_id, source_id, sha256, received_at; raw: sha256, payload; permissions as in ``allowed``.  Reasons in
    order: a text is missing; the interval is empty or open; the evidence is unknown at known_at; its source may not be used for research
    then; its archived bytes changed; another snapshot has the kind, target, start and known time already, be it stored or earlier in
    the batch.  Refused rows hold no place.  Keys are only compared through one partial minimum, so repeats of one cost nothing further."""
    texts = required(F.col("kind")) & required(F.col("target_id")) & required(F.col("evidence_id")) & F.col("body").isNotNull()
    proofs = evidence.select("evidence_id", F.col("source_id").alias("_of"), F.col("received_at").alias("_received"), "sha256").join(_whole(raw), "sha256", "left").drop("sha256")
    rows = incoming.select("seq", *FIELDS, snapshot_sha256().alias("snapshot_id"), F.lit("research").alias("_use")).join(proofs, "evidence_id", "left")
    rows = allowed(rows, permissions.withColumnRenamed("source_id", "_of"), source="_of", use="_use", at="known_at")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reason = first_reason(
        ("required_text_missing", ~texts),
        ("empty_interval", no(F.col("valid_from") < F.col("valid_to"))),
        ("evidence_not_known", no(F.col("_received") <= F.col("known_at"))),
        ("use_not_allowed", ~F.col("allowed")),
        ("payload_corrupt", no(F.col("_whole"))),
    )
    rows = rows.withColumn("_reason", reason)
    places = rows.where("_reason IS NULL").select(*KEY, F.struct(F.lit(1).alias("tier"), "seq", "snapshot_id").alias("p"))
    held = existing.select(*KEY, F.struct(F.lit(0).alias("tier"), F.lit(None).cast(incoming.schema["seq"].dataType).alias("seq"), snapshot_sha256().alias("snapshot_id")).alias("p"))
    first = places.unionByName(held).groupBy(*KEY).agg(F.min("p").alias("_first"))
    found = rows.join(first, KEY, "left")
    reason = F.coalesce("_reason", F.when(F.col("_first.snapshot_id") != F.col("snapshot_id"), "revision_conflict"))
    is_new = (F.col("_first.tier") == 1) & (F.col("_first.seq") == F.col("seq"))
    return found.select("seq", *FIELDS, "snapshot_id", F.when(reason.isNotNull(), "refused").when(is_new, "new").otherwise("seen_again").alias("outcome"), reason.alias("reason"))


def manifest_sha256() -> Column:
    """The digest that a capture was filed with: of all its fields."""
    return fields_sha256(CAPTURE, ("available_at",))


def captures_as_of(requests: DataFrame, captures: DataFrame, raw: DataFrame, journal: DataFrame, permissions: DataFrame) -> DataFrame:
    """request, status, quarantined, result_json of each request (request, source_id, import_id, as_of): a capture as it could be read then.

    captures: source_id, import_id (unique together), input_json, raw_sha, available_at, result_json (an object whose ``quarantined`` lists row_path and
    reason), integrity_sha; raw: sha256, payload; journal: source_id, import_id, row_path, reason of what was quarantined; permissions as in
    ``allowed``.  status in order: use_not_allowed (for research, at as_of), unavailable (no such capture, or a later one), manifest_changed (its fields do not have
    their digest), payload_corrupt (the archived bytes do not have theirs), journal_changed (the journal does not hold the rows that the result lists, each as
    often), or available, with the result and the number of its quarantined rows.  Each capture is checked once, however many ask for it; lists and journal
    are compared as counted rows, none is gathered."""
    key = ["source_id", "import_id"]
    listed = F.from_json("result_json", "quarantined array<struct<row_path: string, reason: string>>")["quarantined"]
    said = captures.select(*key, F.explode(listed).alias("q")).select(*key, "q.row_path", "q.reason", F.lit(1).alias("n"))
    both = said.unionByName(journal.select(*key, "row_path", "reason", F.lit(-1).alias("n")))
    changed = both.groupBy(*key, "row_path", "reason").agg(F.sum("n").alias("n")).where("n <> 0").select(*key).distinct().withColumn("_changed", F.lit(True))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    checked = captures.join(_whole(raw), F.col("raw_sha") == F.col("sha256"), "left").join(changed, key, "left")
    fault = first_reason(("manifest_changed", no(F.col("integrity_sha") == manifest_sha256())), ("payload_corrupt", no(F.col("_whole"))), ("journal_changed", F.coalesce("_changed", F.lit(False))))
    checked = checked.select(*key, "available_at", "result_json", fault.alias("_fault"), F.coalesce(F.size(listed), F.lit(0)).cast("long").alias("_n"))
    asked = allowed(requests.select("request", *key, "as_of", F.lit("research").alias("_use")), permissions, use="_use")
    rows = asked.join(checked, key, "left")
    status = F.coalesce(F.when(~F.col("allowed"), "use_not_allowed").when(no(F.col("available_at") <= F.col("as_of")), "unavailable"), "_fault", F.lit("available"))
    there = lambda c: F.when(status == "available", F.col(c))
    return rows.select("request", status.alias("status"), there("_n").alias("quarantined"), there("result_json").alias("result_json"))
