"""Artifacts and what they depend on: closures, incidents and what these invalidate.

Closures grow by a frontier: each round joins only what was reached last with the edges, follows ways without branches by doubled jumps, drops what is known, and stores the
rest in the shared folder.  A chain of any length, a cycle and a diamond each end when nothing new is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.sources.shared import stored

#: Categories of incidents; one that is confirmed invalidates unless it is a mere loss of forecast quality.
CATEGORIES = ("data", "extraction", "execution", "policy", "forecast_loss")


def impacted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node: what is reached from each root over edges (source, target), roots included.

    edges with a null end lead nowhere; roots has them in its first column, a null one is left out."""
    steps = stored(edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct(), "edges")
    start = roots.select(F.col(roots.columns[0]).alias("root")).where("root IS NOT NULL").distinct()
    return closure(steps, start.select("root", F.col("root").alias("node")))


def _single(steps: DataFrame) -> DataFrame:
    """node, to: nodes with one way out, and where it leads."""
    return stored(steps.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("n"), F.max("target").alias("to")).where("n = 1").drop("n"), "single")


def jumps(steps: DataFrame) -> list[DataFrame]:
    """Tables (node, to) of 1, 2, 4, .. steps along ways that do not branch; the last is the first one without rows, or long enough to have gone round every cycle."""
    out = [_single(steps)]
    for _ in range(max(out[0].count(), 1).bit_length()):
        if out[-1].isEmpty():
            break
        far = out[-1].select(F.col("node").alias("to"), F.col("to").alias("_to"))
        out.append(stored(out[-1].join(far, "to").select("node", F.col("_to").alias("to")), "jump"))
    return out


def closure(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """root, node: the pairs, and what is reached from their nodes over ``steps`` (source, target).

    A round takes one step from what was reached last, then follows ways that do not branch in jumps of 1, 2, 4, .. steps: rounds
    are as many as branchings on the longest way, and a chain or a cycle of n nodes takes about log n joins."""
    ways = jumps(steps)
    frontier = stored(pairs.select("root", "node").distinct(), "frontier")
    reached = frontier
    while not frontier.isEmpty():
        further = frontier.join(steps, F.col("node") == F.col("source")).select("root", F.col("target").alias("node")).distinct()
        further = stored(further.join(reached, ["root", "node"], "left_anti"), "further")
        if further.isEmpty():
            break
        for jump in ways[:-1]:
            ahead = further.join(jump, "node").select("root", F.col("to").alias("node"))
            further = stored(further.unionByName(ahead).distinct(), "further")
        frontier = stored(further.join(reached, ["root", "node"], "left_anti"), "frontier")
        reached = stored(reached.unionByName(frontier), "reached")
    return reached


def _ends(steps: DataFrame) -> DataFrame:
    """node, to, open: where the way from each node with one way out ends, at a node with none or several; open where it never does, and ``to`` then lies on a cycle."""
    single = _single(steps)
    there = single.select(F.col("node").alias("to"), F.lit(True).alias("open"))
    ends = stored(single.join(there, "to", "left").select("node", "to", F.coalesce("open", F.lit(False)).alias("open")), "ends")
    for _ in range(single.count().bit_length() + 1):
        if ends.where("open").isEmpty():
            break
        further = ends.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("open").alias("_open"))
        going = ends.where("open").join(further, "to").select("node", F.col("_to").alias("to"), F.col("_open").alias("open"))
        ends = stored(ends.where("NOT open").unionByName(going), "ends")
    return ends


def on_cycles(edges: DataFrame) -> DataFrame:
    """node: those that lie on a cycle of edges (source, target).

    Ways that do not branch and end nowhere are taken off at once, in both directions, as are cycles that nothing leaves; each round does so by
    pointers that double.  Only what then still branches and returns is closed over."""
    rest = stored(edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct(), "edges")
    found, count = None, rest.count()
    while count:
        before = count
        for forward in (True, False):
            way = rest if forward else rest.select(F.col("target").alias("source"), F.col("source").alias("target"))
            ends = _ends(way)
            loops = stored(ends.where("open").select(F.col("to").alias("node")).distinct(), "loops")
            found = loops if found is None else found.unionByName(loops)
            sources = way.select(F.col("source").alias("to")).distinct()
            dead = ends.where("NOT open").join(sources, "to", "left_anti").select("node")
            gone = stored(dead.unionByName(loops).distinct(), "gone")
            kept = way.join(way.select(F.col("source").alias("target")).distinct(), "target", "left_semi")  # a node without a way out is on none
            for side in ("source", "target"):
                kept = kept.join(gone.select(F.col("node").alias(side)), side, "left_anti")
            way = stored(kept.select("source", "target"), "core")
            rest = way if forward else way.select(F.col("target").alias("source"), F.col("source").alias("target"))
        count = rest.count()
        if count == before:
            break
    core = closure(rest, rest.select(F.col("source").alias("root"), F.col("target").alias("node"))).where("root = node").select("node")
    return (core if found is None else core.unionByName(found)).distinct()


def register_artifacts(artifacts: DataFrame, dependencies: DataFrame, evidence: DataFrame) -> DataFrame:
    """artifacts with artifact_sha256 and reason (null: may be registered).

    artifacts: artifact_id, kind, payload, known_at, recorded_at; dependencies: artifact_id, kind (evidence, raw or artifact), id,
    evidence_id (of raw ones); evidence: evidence_id, sha256, received_at.  In order: a text or the payload is missing, knowledge
    from the future, no dependency, one twice, one of no kind, one that is unknown at known_at, a raw one that is not its evidence's
    payload, a cycle.  The digest covers content, kind, known_at and the sorted dependencies."""
    proofs = evidence.select(F.col("evidence_id").alias("_e"), F.col("sha256").alias("_sha"), F.col("received_at").alias("_at"))
    others = artifacts.select(F.col("artifact_id").alias("_a"), F.col("recorded_at").alias("_recorded"))
    each = dependencies.join(artifacts.select("artifact_id", "known_at"), "artifact_id")
    proof = F.when(F.col("kind") == "evidence", F.col("id")).when(F.col("kind") == "raw", F.col("evidence_id"))
    each = each.join(proofs, proof == F.col("_e"), "left").join(others, (F.col("kind") == "artifact") & (F.col("id") == F.col("_a")), "left")
    fault = F.when(~F.coalesce(F.col("kind").isin("evidence", "raw", "artifact"), F.lit(False)), 1).when(~F.coalesce(F.coalesce("_at", "_recorded") <= F.col("known_at"), F.lit(False)), 2).when((F.col("kind") == "raw") & (F.col("id") != F.col("_sha")), 3)
    entry = F.to_json(F.struct("evidence_id", "id", "kind"), {"ignoreNullFields": "false"})
    found = each.select("artifact_id", fault.alias("fault"), entry.alias("entry")).groupBy("artifact_id").agg(F.min("fault").alias("_fault"), F.array_sort(F.collect_list("entry")).alias("_entries"), F.count_distinct("entry").alias("_different"))
    cyclic = on_cycles(dependencies.where("kind = 'artifact'").select(F.col("id").alias("source"), F.col("artifact_id").alias("target"))).withColumn("_cycle", F.lit(True))
    rows = artifacts.join(found, "artifact_id", "left").join(cyclic, F.col("artifact_id") == F.col("node"), "left")
    text = lambda c: F.coalesce(F.col(c).rlike(r"\S"), F.lit(False))
    checks = [
        ("required_text_missing", ~(text("artifact_id") & text("kind"))),
        ("payload_required", ~F.coalesce(F.octet_length("payload") > 0, F.lit(False))),
        ("known_after_record", ~F.coalesce(F.col("known_at") <= F.col("recorded_at"), F.lit(False))),
        ("dependency_required", F.col("_entries").isNull()),
        ("duplicate_dependency", F.size("_entries") > F.col("_different")),
        ("unsupported_dependency", F.col("_fault") == 1),
        ("dependency_cycle", F.coalesce("_cycle", F.lit(False))),
        ("dependency_unavailable", F.col("_fault") == 2),
        ("raw_is_not_its_evidence", F.col("_fault") == 3),
    ]
    sha = F.sha2(F.to_json(F.struct("artifact_id", F.sha2(F.col("payload").cast("binary"), 256).alias("content"), F.col("_entries").alias("dependencies"), "kind", F.unix_micros("known_at").alias("known_at"))), 256)
    return rows.select(*artifacts.columns, sha.alias("artifact_sha256"), F.coalesce(*[F.when(c, name) for name, c in checks]).alias("reason"))


def invalidates(category: Column, confirmed: Column) -> Column:
    """Whether an incident invalidates what it affects."""
    return F.coalesce(confirmed & (category != "forecast_loss"), F.lit(False))


def impact_as_of(artifacts: DataFrame, dependencies: DataFrame, incidents: DataFrame, at: Column) -> DataFrame:
    """incident_id, artifact_id, invalidates: what each incident known at ``at`` affects among the artifacts known then.

    artifacts: artifact_id, available_at; dependencies: artifact_id, kind, id, evidence_id, sha256 (of evidence and raw ones);
    incidents: incident_id, category, confirmed, available_at, kind, id (one row for each reference they affect).  An artifact is
    affected as itself; or when it depends on the same reference; on a payload that is affected, raw or as evidence; on the
    raw payload of affected evidence; or on an affected artifact."""
    there = artifacts.where(F.col("available_at") <= at).select("artifact_id")
    now = incidents.where(F.col("available_at") <= at)
    known = dependencies.join(there, "artifact_id", "left_semi")
    ref = now.select("incident_id", F.col("kind").alias("rk"), F.col("id").alias("ri"))
    pick = lambda d: d.select("incident_id", F.col("artifact_id").alias("node"))
    itself = ref.where("rk = 'artifact'").select("incident_id", F.col("ri").alias("node")).join(there.withColumnRenamed("artifact_id", "node"), "node", "left_semi").select("incident_id", "node")
    same = pick(known.join(ref, (F.col("kind") == F.col("rk")) & (F.col("id") == F.col("ri"))))
    payload = pick(known.where("kind IN ('raw', 'evidence')").join(ref.where("rk = 'raw'"), F.col("sha256") == F.col("ri")))
    proof = pick(known.where("kind = 'raw'").join(ref.where("rk = 'evidence'"), F.col("evidence_id") == F.col("ri")))
    roots = itself.unionByName(same).unionByName(payload).unionByName(proof).distinct()
    steps = stored(known.where("kind = 'artifact'").select(F.col("id").alias("source"), F.col("artifact_id").alias("target")).distinct(), "edges")
    reached = closure(steps, roots.select(F.col("incident_id").alias("root"), "node"))
    kinds = now.groupBy("incident_id").agg(F.max(invalidates(F.col("category"), F.col("confirmed"))).alias("invalidates"))
    return reached.select(F.col("root").alias("incident_id"), F.col("node").alias("artifact_id")).join(kinds, "incident_id")


def usable(artifacts: DataFrame, dependencies: DataFrame, incidents: DataFrame, as_of: Column, now: Column) -> DataFrame:
    """artifact_id, usable of the artifacts available at ``as_of``: no incident known ``now`` invalidates them."""
    bad = impact_as_of(artifacts, dependencies, incidents, now).where("invalidates").select("artifact_id").distinct().withColumn("_bad", F.lit(True))
    return artifacts.where(F.col("available_at") <= as_of).select("artifact_id").join(bad, "artifact_id", "left").select("artifact_id", F.col("_bad").isNull().alias("usable"))


def check_corrections(corrections: DataFrame, artifacts: DataFrame, dependencies: DataFrame, incidents: DataFrame, at: Column) -> DataFrame:
    """correction_id, reason (null: stands) of the corrections (correction_id, incident_id, replacement_id, known_at) up to ``at``.

    In order: the incident was not known at the correction, the replacement was not available then, or it is affected by the
    incident itself."""
    known = corrections.where(F.col("known_at") <= at)
    when = incidents.groupBy("incident_id").agg(F.min("available_at").alias("_incident_at"))
    rows = known.join(when, "incident_id", "left").join(artifacts.select(F.col("artifact_id").alias("replacement_id"), F.col("available_at").alias("_artifact_at")), "replacement_id", "left")
    hit = impact_as_of(artifacts, dependencies, incidents, at).select("incident_id", F.col("artifact_id").alias("replacement_id"), F.lit(True).alias("_hit"))
    rows = rows.join(hit, ["incident_id", "replacement_id"], "left")
    reason = F.when(~F.coalesce(F.col("_incident_at") <= F.col("known_at"), F.lit(False)), "incident_not_known").when(~F.coalesce(F.col("_artifact_at") <= F.col("known_at"), F.lit(False)), "replacement_not_available").when(F.col("_hit"), "replacement_is_affected")
    return rows.select("correction_id", reason.alias("reason"))


def origins(dependencies: DataFrame, evidence: DataFrame, roots: DataFrame) -> DataFrame:
    """artifact_id, origins (sorted): where all evidence under each root artifact comes from.

    dependencies: artifact_id, kind, id, evidence_id; evidence: evidence_id, origin."""
    steps = stored(dependencies.where("kind = 'artifact'").select(F.col("artifact_id").alias("source"), F.col("id").alias("target")).distinct(), "edges")
    under = closure(steps, roots.select(F.col(roots.columns[0]).alias("root"), F.col(roots.columns[0]).alias("node")).distinct())
    proof = dependencies.select(F.col("artifact_id").alias("node"), F.when(F.col("kind") == "raw", F.col("evidence_id")).when(F.col("kind") == "evidence", F.col("id")).alias("evidence_id")).where("evidence_id IS NOT NULL").distinct()
    found = under.join(proof, "node").join(evidence.select("evidence_id", "origin"), "evidence_id")
    return found.groupBy(F.col("root").alias("artifact_id")).agg(F.array_sort(F.collect_set("origin")).alias("origins"))
