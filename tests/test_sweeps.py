"""Lookups over two times, held against brute force, with keys that hold most rows."""

import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolake.functions import times
from chronolake.operators import bitemporal, evidence, journals, lineage, trials

from .test_queries import spark  # noqa: F401

T0 = datetime(2024, 1, 1)


def t(n):
    return None if n is None else T0 + timedelta(hours=7 * n)


def brute_snapshots(asks, log):
    out = {}
    for ask, k, eff, at in asks:
        last = {}
        for key, start, end, known, v in log:
            if None not in (k, start, known, eff, at) and key == k and known <= at and start <= eff and (start not in last or (known, v) > last[start][:2]):
                last[start] = (known, v, end)
        held = [v for _, v, end in last.values() if end is None or eff < end]
        out[ask] = ("resolved", held[0]) if len(held) == 1 else ("ambiguous" if held else "unknown", None)
    return out


@pytest.mark.parametrize(("hot", "paired"), [(20, 0), (1 << 20, 100), (1 << 20, 10**6)])
def test_snapshots_are_as_by_hand(spark, monkeypatch, hot, paired):  # noqa: F811
    for f in (bitemporal.running_sums, bitemporal.until_next):
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], hot))
    rng = random.Random(4)
    some = lambda most: None if rng.random() < 0.05 else rng.randrange(most)
    log = [(rng.choice("kkkab"), some(30), some(40), some(25), n) for n in range(400)]
    asks = [(n, rng.choice(["k", "k", "a", "b", "z", None]), some(45), some(30)) for n in range(300)]
    frame = spark.createDataFrame([(k, t(a), t(b), t(c), v) for k, a, b, c, v in log], "k string, valid_from timestamp, valid_to timestamp, known_at timestamp, v int")
    asked = spark.createDataFrame([(n, k, t(a), t(b)) for n, k, a, b in asks], "ask int, k string, effective_at timestamp, as_of timestamp")
    assert {r.ask: (r.status, r.v) for r in bitemporal.snapshots_for(asked, frame, "ask", ["k"], "v", paired).collect()} == brute_snapshots(asks, log)
    assert bitemporal.snapshots_for(asked.limit(0), frame, "ask", ["k"], "v").count() == 0
    assert {r.status for r in bitemporal.snapshots_for(asked, frame.limit(0), "ask", ["k"], "v").collect()} == {"unknown"}


def brute_identifiers(asks, versions):
    out = {}
    for ask, p, v, eff, at in asks:
        last = {}
        for m, known, *rest in versions:
            if known is not None and at is not None and known <= at and (m not in last or known > last[m][0]):
                last[m] = (known, *rest)
        found = {x[3] for x in last.values() if None not in (p, v, eff, x[4]) and (x[1], x[2]) == (p, v) and x[4] <= eff and (x[5] is None or eff < x[5])}
        out[ask] = (len(found), found.pop() if len(found) == 1 else None)
    return out


def test_identifiers_are_as_by_hand(spark):  # noqa: F811
    rng = random.Random(6)
    some = lambda most: None if rng.random() < 0.05 else rng.randrange(most)
    made = {}
    for _ in range(400):
        made.setdefault((rng.choice([1, 1, 1, 2, 3, 4, 5, None]), some(200)), (rng.choice("pq"), rng.choice(["x", "y", None]), rng.randrange(4), some(30), some(60)))
    versions = [(m, k, *rest) for (m, k), rest in made.items()]
    asks = [(n, rng.choice("pqz"), rng.choice(["x", "y", None]), some(60), some(220)) for n in range(300)]
    frame = spark.createDataFrame([(m, t(k), p, v, x, t(a), t(b)) for m, k, p, v, x, a, b in versions], "mapping_id int, known_at timestamp, provider string, value string, listing_id int, valid_from timestamp, valid_to timestamp")
    asked = spark.createDataFrame([(n, p, v, t(a), t(b)) for n, p, v, a, b in asks], "request int, provider string, value string, effective_at timestamp, as_of timestamp")
    got = {r.request: (r.listings, r.listing_id) for r in evidence.resolve_identifiers(asked, frame).collect()}
    assert got == brute_identifiers(asks, versions)


def test_a_mapping_of_thousands_of_versions_meets_each_request_once(spark):  # noqa: F811
    """One mapping and one identifier hold everything: a request meets one version, not all of them."""
    n = 6000
    base = spark.range(n).select(F.lit(1).alias("mapping_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("known_at"), F.lit("p").alias("provider"), F.lit("v").alias("value"), F.col("id").alias("listing_id"), F.lit(None).cast("timestamp").alias("valid_to"))
    versions = base.withColumn("valid_from", F.timestamp_seconds(F.lit(0)))
    asked = base.select(F.col("listing_id").alias("request"), "provider", "value", F.col("known_at").alias("effective_at"), (F.col("known_at") + F.expr("INTERVAL 30 SECONDS")).alias("as_of"))
    spans = bitemporal.until_next(versions, ["mapping_id"], "known_at", "_to")
    points, live = bitemporal.live_nodes(asked, spans, ["provider", "value"], "as_of", "known_at", "_to")
    keys = ["provider", "value", "_level", "_node"]
    assert points.join(live.select(*keys), keys).count() == n and points.count() <= 16 * n and live.count() <= 2 * n
    got = evidence.resolve_identifiers(asked, versions)
    assert got.where("listings = 1 AND listing_id = request").count() == n


def test_running_sums_and_next_times(spark):  # noqa: F811
    rows = spark.createDataFrame([("a", t(0), 1), ("a", t(0), 2), ("a", t(9), 4), ("b", t(3), 8), (None, t(1), 16), ("a", t(20), 32)], "k string, at timestamp, v int")
    for hot in (0, 2, 100):
        got = {(r.k, r.v): (r.s, r.n) for r in bitemporal.running_sums(rows, ["k"], "at", {"s": F.col("v")}, {"n": F.lit(1)}, hot).collect()}
        assert got == {("a", 1): (3, 4), ("a", 2): (3, 4), ("a", 4): (7, 4), ("a", 32): (39, 4), ("b", 8): (8, 1), (None, 16): (16, 1)}
        after = {r.v: r.u for r in bitemporal.until_next(rows.where("v <> 2"), ["k"], "at", "u", hot).collect()}
        assert after == {1: t(9), 4: t(20), 32: None, 8: None, 16: None}


def test_lineage_names_what_failed(spark):  # noqa: F811
    """One corrupt payload, one unknown evidence, one revoked source, one listing of another kind."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    names = ["good", "corrupt", "missing", "revoked", "future", "late"]
    versions = spark.createDataFrame([(f"m{n}", t(1), "p", n, f"l-{n}", t(0), None, f"e-{n}") for n in names] + [("m2", t(1), "p", "two", "l-good", t(0), None, "e-good"), ("m3", t(1), "p", "two", "l-late", t(0), None, "e-late")], "mapping_id string, known_at timestamp, provider string, value string, listing_id string, valid_from timestamp, valid_to timestamp, evidence_id string")
    proofs = spark.createDataFrame([(f"e-{n}", "r" if n == "revoked" else "s", sha(n.encode()), t(1) if n == "late" else t(0), t(0)) for n in names if n != "missing"], "evidence_id string, source_id string, sha256 string, published_at timestamp, received_at timestamp")
    raw = spark.createDataFrame([(sha(n.encode()), b"other" if n == "corrupt" else n.encode()) for n in names], "sha256 string, payload binary")
    grants = spark.createDataFrame([("s", t(0), ["research"]), ("r", t(0), ["research"]), ("r", t(2), [])], "source_id string, known_at timestamp, uses array<string>")
    listings = spark.createDataFrame([(f"l-{n}", "f" if n == "future" else "i") for n in names], "listing_id string, instrument_id string")
    instruments = spark.createDataFrame([("i", "x", "equity"), ("f", "y", "future")], "instrument_id string, entity_id string, kind string")
    asked = spark.createDataFrame([(n, "p", n, t(3), t(3)) for n in [*names, "two", "none"]], "request string, provider string, value string, effective_at timestamp, as_of timestamp")
    got = {r.request: r for r in evidence.identifier_lineage(asked, versions, proofs, raw, grants, listings, instruments).collect()}
    assert {k: r.status for k, r in got.items()} == {"good": "verified", "corrupt": "payload_corrupt", "missing": "evidence_unknown", "revoked": "use_not_allowed", "future": "unsupported_instrument", "late": "evidence_times", "two": "ambiguous", "none": "unknown"}
    at = lambda n: int((t(n) - datetime(1970, 1, 1)).total_seconds()) * 10**6
    mapping = f'{{"evidence_id":"e-good","known_at":{at(1)},"listing_id":"l-good","mapping_id":"mgood","provider":"p","valid_from":{at(0)},"valid_to":null,"value":"good"}}'
    assert got["good"].manifest_sha256 == sha(f"{sha(mapping.encode())}:{sha(b'good')}".encode()) and got["good"].entity_id == "x" and got["corrupt"].manifest_sha256 is None


def chained(key, bodies):
    rows, before = [], None
    for n, body in enumerate(bodies):
        text = json.dumps({"body": hashlib.sha256(body.encode()).hexdigest(), "key": key, "previous": before, "sequence": n}, separators=(",", ":"))
        digest = hashlib.sha256(text.encode()).hexdigest()
        rows.append([key, n, body, digest, before])
        before = digest
    return rows


def test_chains_tell_faults_apart(spark):  # noqa: F811
    """An altered body, a swapped pair, a cut tail, a hole, a second entry and a rewritten tail are not the same."""
    rows, heads = [], []
    for key in ("fine", "altered", "swapped", "cut", "hole", "twice", "rewritten"):
        chain = chained(key, [f"{key}{n}" for n in range(6)])
        heads.append((key, 5, chain[5][3]))
        if key == "altered":
            chain[2][2] = "other"
        if key == "swapped":
            chain[2][1], chain[3][1] = 3, 2
        if key == "cut":
            chain = chain[:4]
        if key == "hole":
            del chain[3]
        if key == "twice":
            chain.append(list(chain[4]))
        if key == "rewritten":
            chain = chained(key, [*[f"{key}{n}" for n in range(5)], "new"])
        rows += chain
    journal = spark.createDataFrame(rows, "k string, n int, body string, digest string, previous string")
    got = {(r.k, r.n): r.fault for r in journals.verify_chain(journal, spark.createDataFrame(heads, "k string, n int, digest string"), "k", "n", "body", "digest", "previous").collect() if r.fault}
    assert got == {("altered", 2): "altered", ("swapped", 2): "swapped", ("swapped", 3): "swapped", ("swapped", 4): "unchained", ("cut", 5): "tail_cut", ("hole", 4): "gap", ("twice", 4): "repeated", ("rewritten", 5): "tail_altered"}


def test_canonical_text_of_nested_values(spark):  # noqa: F811
    """The same text as Python's for nested arrays, escapes, key order, characters beyond ASCII and controls."""
    values = [
        {"b": [1, {"z": None, "a": [True, False, []]}], "a": {"é": "ü 😀", "Z": "q\"\\/\b\f\n\r\t"}, "": {}},
        {"c": "\x00\x0b\x0e\x0f\x1a\x1f\x7f", "d": "\\u000B \\\\u001A", "e": "\\\x0b\\\\\x1f"},
        [1, -2, 0, 12345678901234567890, "1.50", [[["x"]]], "ﬀ中"],
        "just a text", None, 7,
    ]
    texts = [json.dumps(v, indent=2, ensure_ascii=n % 2 == 0) for n, v in enumerate(values)]
    frame = spark.createDataFrame([*enumerate(texts), (90, '{"a":1,"a":2}'), (91, "{"), (92, None), (93, '{"x":1.500,"w":-0.10,"v":3.0}')], "n int, text string")
    got = {r.n: (r.a, r.u) for r in frame.select("n", times.canonical_text(F.col("text")).alias("a"), times.canonical_text(F.col("text"), ascii_only=False).alias("u")).collect()}
    for n, v in enumerate(values):
        want = [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=x) for x in (True, False)]
        assert got[n] == tuple(want), n
    assert got[90] == got[91] == got[92] == (None, None) and got[93][0] == '{"v":3,"w":-0.1,"x":1.5}'


def test_a_prediction_without_an_id_is_refused_not_lost(spark):  # noqa: F811
    row = ("d", "v", "a", "s", "forecast", 1.0)
    schema = "prediction_id string, definition_id string, version_id string, artifact_id string, artifact_sha256 string, action string, value double"
    incoming = spark.createDataFrame([(None, *row, t(5)), ("p", *row, t(5))], schema + ", known_at timestamp")
    definitions = spark.createDataFrame([("d", "v", t(1), 60), ("d", "v", t(1), 60)], "definition_id string, version_id string, known_at timestamp, horizon_seconds int")
    artifacts = spark.createDataFrame([("a", "s", t(1)), ("a", "s", t(2))], "artifact_id string, artifact_sha256 string, known_at timestamp")
    got = sorted((str(r.prediction_id), r.outcome, r.reason) for r in trials.lock_predictions(spark.createDataFrame([], schema), incoming, definitions, artifacts).collect())
    assert got == [("None", "refused", "required_text_missing"), ("p", "new", None)]


def test_chains_and_cycles_of_thousands_in_few_rounds(spark, monkeypatch):  # noqa: F811
    """5000 nodes in a row, 5000 in a ring, and a way into the ring: joins grow with the logarithm, not with the length."""
    made = []
    real = lineage.stored
    monkeypatch.setattr(lineage, "stored", lambda df, name: made.append(name) or real(df, name))
    n = 5000
    line = spark.range(n - 1).selectExpr("concat('c', id) AS source", "concat('c', id + 1) AS target")
    ring = spark.range(n).selectExpr("concat('r', id) AS source", f"concat('r', (id + 1) % {n}) AS target")
    edges = line.unionByName(ring).unionByName(spark.createDataFrame([("in", "r0"), ("in", "c9")], "source string, target string"))
    got = lineage.impacted(edges, spark.createDataFrame([("c0",), ("r7",)], "root string")).groupBy("root").count().collect()
    assert {r.root: r["count"] for r in got} == {"c0": n, "r7": n} and len(made) < 50
    made.clear()
    nodes = lineage.on_cycles(edges)
    assert nodes.count() == n and nodes.where("node LIKE 'r%'").count() == n and len(made) < 80


def test_closures_and_cycles_of_random_graphs(spark):  # noqa: F811
    rng = random.Random(1)
    for size, many in ((12, 20),):
        pairs = {(rng.randrange(size), rng.randrange(size)) for _ in range(many)}
        reach = {a: {b for x, b in pairs if x == a} for a in range(size)}
        for _ in range(size):
            for a in reach:
                reach[a] |= set().union(*[reach[b] for b in reach[a]], set())
        edges = spark.createDataFrame(sorted(pairs), "source int, target int")
        assert {r.node for r in lineage.on_cycles(edges).collect()} == {a for a in reach if a in reach[a]}
        got = {(r.root, r.node) for r in lineage.impacted(edges, spark.createDataFrame([(0,), (1,)], "root int")).collect()}
        assert got == {(a, b) for a in (0, 1) for b in reach[a] | {a}}
