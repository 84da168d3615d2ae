"""Reviews against captures, bundles and their lines, frozen reports, exact valuations, references looked up: goldens and edges."""

import hashlib
from datetime import date, datetime, timedelta
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from chronolake.operators import bundles, corporate, imports, references, reviews
from chronolake.operators.jobs import AXES
from tests.test_queries import spark  # noqa: F401

T = datetime(2024, 1, 10)
SHA = hashlib.sha256(b"bars").hexdigest(), hashlib.sha256(b"days").hexdigest()
SCOPE = ("b1", "c1", *SHA, "L", "XNAS", "2024-01-02", "2024-01-03", "iex")
SCOPE_TYPE = "struct<" + ",".join(f"{c}:string" for c in reviews.SCOPE) + ">"
REVIEW = f"review_id string, source_id string, axis string, purpose string, decision string, scope {SCOPE_TYPE}, known_at timestamp, recorded_at timestamp, expires_at timestamp, reviewer string, evidence_refs array<string>, temporal_basis string, declared_rights array<string>"
BASIS = "observed_receipt_and_processing"


def review(n, axis, *, at=T, until=30, decision="allow", source="s", scope=SCOPE, refs=("e",), basis=BASIS, rights=("storage", "research"), reviewer="r", late=0):
    return (f"{n}", source, axis, "forward_observation", decision, scope, at, at + timedelta(days=late), at + timedelta(days=until), reviewer, list(refs), basis if axis == "temporal" else None, list(rights) if axis == "rights" else None)


def world(spark):  # noqa: F811
    grants = spark.createDataFrame([("s", datetime(2024, 1, 1), ["storage", "research"]), ("t", datetime(2024, 1, 1), ["storage"])], "source_id string, known_at timestamp, uses array<string>")
    sha = hashlib.sha256(b"x").hexdigest()
    evidence = spark.createDataFrame([("e", "s", datetime(2024, 1, 2), sha, bytearray(b"x")), ("bad", "s", datetime(2024, 1, 2), sha, bytearray(b"y")), ("late", "s", datetime(2024, 2, 2), sha, bytearray(b"x")), ("other", "t", datetime(2024, 1, 2), sha, bytearray(b"x"))], "evidence_id string, source_id string, received_at timestamp, sha256 string, payload binary")
    return grants, evidence


def recorded(spark, rows, before=None):  # noqa: F811
    frame = spark.createDataFrame(rows, REVIEW)
    none = frame.limit(0).withColumns({"scope_sha256": F.lit(""), "review_sha256": F.lit("")})
    return reviews.record(none if before is None else before, frame, *world(spark))


def test_what_reviews_may_be_recorded(spark):  # noqa: F811
    swapped = (*SCOPE[:6], SCOPE[7], SCOPE[6], SCOPE[8])
    rows = [review(1, "rights"), review(2, "temporal"), review(3, "rights", rights=("storage", "storage")), review(4, "coverage", reviewer=" r"), review(5, "magic"), review(6, "coverage", scope=swapped), review(7, "coverage", scope=(*SCOPE[:2], "ab", *SCOPE[3:])), review(8, "coverage", late=1), review(9, "coverage", until=0), review(10, "temporal", basis="guess"), review(11, "coverage", refs=()), review(12, "coverage", refs=("e", "e")), review(13, "coverage", source="t"), review(14, "coverage", refs=("late",)), review(15, "coverage", refs=("other",)), review(16, "coverage", refs=("e", "bad")), review(17, "coverage", refs=("gone",)), (None, *review(18, "coverage")[1:]), (*review(19, "coverage")[:5], None, *review(19, "coverage")[6:]), review(20, "provenance"), review(20, "provenance", decision="deny"), review(21, "provenance", at=T + timedelta(1)), review(22, "provenance", at=T + timedelta(1), until=9)]
    got = {}
    for r in recorded(spark, rows).collect():
        got.setdefault(r.review_id, []).append(r.reason)
    want = {"1": None, "2": None, "3": "declared_rights_of_rights_reviews_only", "4": "required_text_missing", "5": "unknown_axis_purpose_or_decision", "6": "invalid_scope_interval_or_feed", "7": "exact_capture_hashes_required", "8": "availability_is_not_recording_time", "9": "expiry_not_after_availability", "10": "temporal_basis_of_temporal_reviews_only", "11": "unique_evidence_required", "12": "unique_evidence_required", "13": "use_not_permitted", "14": "evidence_unknown_or_late", "15": "evidence_unknown_or_late", "16": "evidence_digest_differs", "17": "evidence_unknown_or_late", None: "required_text_missing", "19": "scope_text_missing", "21": "another_review_at_this_time", "22": "another_review_at_this_time"}
    assert got == {k: [v] for k, v in want.items()} | {"20": ["review_changed"] * 2}
    first = recorded(spark, rows[:2])
    again = {(r.review_id, r.decision): (r.outcome, r.reason) for r in recorded(spark, [*rows[:2], review(1, "rights", decision="deny"), review(30, "rights"), review(31, "coverage")], first.drop("outcome", "reason")).collect()}
    assert again == {("1", "allow"): ("same", None), ("2", "allow"): ("same", None), ("1", "deny"): ("refused", "review_changed"), ("30", "allow"): ("refused", "another_review_at_this_time"), ("31", "allow"): ("new", None)}
    assert recorded(spark, rows[:1]).limit(0).count() == 0 and recorded(spark, []).count() == 0


CASE = {"told": None, "bar": b"bars", "available": T, "rows": None, "days": None, "now": datetime(2024, 1, 20), "as_of": datetime(2024, 1, 15), "scope": SCOPE, "origin": "provider_reported", "received": T}


def assessed(spark, cases):  # noqa: F811
    """The answers to one request a case; each case is a source of its own, with its reviews and captures."""
    told, asks, bars, days, bar_rows, day_rows, sources, grants = [], [], [], [], [], [], [], []
    for n, given in enumerate(cases):
        c, s = CASE | given, f"s{n}"
        told += [(*r[:1], s, *r[2:]) for r in ([review(i, a) for i, a in enumerate(AXES)] if c["told"] is None else c["told"])]
        asks.append((n, s, "forward_observation", c["as_of"], c["now"], c["scope"]))
        bars.append((s, "b1", bytearray(c["bar"]), c["available"], c["received"], 0, True, "terminal_page", "iex", "raw", "1Day", "UTC"))
        days.append((s, "c1", bytearray(b"days"), T, 0, "TRADING", "XNAS", "2024-01-02", "2024-01-03", "UTC"))
        both = ["2024-01-02", "2024-01-03"]
        bar_rows += [(s, "b1", "L", d, None) for d in (both if c["rows"] is None else c["rows"])] + [(s, "b1", "M", "2024-01-09", None)]
        day_rows += [(s, "c1", d, datetime(2024, 1, 5), None) for d in (both if c["days"] is None else c["days"])]
        sources.append((s, c["origin"]))
        grants.append((s, datetime(2024, 1, 1), ["storage", "research"]))
    frame = spark.createDataFrame
    found = reviews.assess(
        frame(asks, f"request int, source_id string, purpose string, as_of timestamp, now timestamp, scope {SCOPE_TYPE}"),
        frame(told, REVIEW).withColumn("scope_sha256", reviews.scope_digest("scope")),
        frame(grants, "source_id string, known_at timestamp, uses array<string>"),
        frame(sources, "source_id string, origin string"),
        frame([("L", "XNAS")], "listing_id string, mic string"),
        frame(bars, "source_id string, import_id string, payload binary, available_at timestamp, received_at timestamp, quarantined int, page_complete boolean, pagination_state string, feed string, adjustment string, timeframe string, market_timezone string"),
        frame(bar_rows, "source_id string, import_id string, listing_id string, date string, published_at timestamp"),
        frame(days, "source_id string, import_id string, payload binary, available_at timestamp, quarantined int, calendar_kind string, venue string, start_date string, end_date string, market_timezone string"),
        frame(day_rows, "source_id string, import_id string, date string, end timestamp, published_at timestamp"),
    )
    rows = sorted(found.collect(), key=lambda r: r.request)
    assert [r.request for r in rows] == list(range(len(cases))) and all(r.eligible == (not r.reasons) for r in rows)
    return [r.reasons for r in rows]


def test_captures_are_held_against_their_reviews(spark):  # noqa: F811
    """A changed capture, an expired and a late review each have their reason; nothing else is said of them."""
    every = [review(n, a) for n, a in enumerate(AXES)]
    last, cover = [f"{AXES[3]}_review_missing_denied_or_expired"], ["price_calendar_date_coverage_mismatch"]
    cases = [
        ({}, []),
        ({"bar": b"other"}, ["capture_hash_mismatch"]),
        ({"told": [*every[:3], review(3, AXES[3], until=8)]}, last),
        ({"told": [*every[:3], review(3, AXES[3], at=datetime(2024, 1, 16))]}, last),
        ({"told": [*every, review(9, AXES[3], at=datetime(2024, 1, 18), decision="deny")]}, last),
        ({"told": [review(0, "rights", rights=("storage",)), *every[1:]]}, ["rights_review_missing_denied_or_expired"]),
        ({"told": []}, sorted([*[f"{a}_review_missing_denied_or_expired" for a in AXES], "temporal_review_basis_mismatch"])),
        ({"available": datetime(2024, 1, 16)}, ["capture_unavailable_at_cutoff"]),
        ({"rows": ["2024-01-02"]}, cover),
        ({"rows": ["2024-01-02", "2024-01-02", "2024-01-03"]}, cover),
        ({"days": []}, cover),
        ({"days": ["2024-01-02", "2024-01-03", "2024-01-04"]}, cover),
        ({"rows": []}, cover),
        ({"received": datetime(2024, 1, 4)}, ["daily_bar_not_complete_at_observation"]),
        ({"origin": "synthetic_fixture"}, ["provider_origin_required_for_real_use"]),
        ({"now": datetime(2024, 1, 14)}, ["current_cutoff_before_historical_cutoff"]),
        ({"scope": (*SCOPE[:8], None)}, ["scope_text_missing"]),
    ]
    assert assessed(spark, [c for c, _ in cases]) == [want for _, want in cases]


BAR = ("2024-01-02", "2024-01-02T14:30:00Z", "2024-01-02T21:00:00Z", "USD", "2", "3", "1", "2.5", "10", "2024-01-02T22:00:00.000001Z")
BARS = "bundle string, " + ", ".join(f"`{c}` string" for c in bundles.FIELDS)


def test_bundles_and_their_lines(spark, tmp_path):  # noqa: F811
    early = (*BAR[:9], "2024-01-02T20:00:00Z")
    high = (*BAR[:5], "2.4", *BAR[6:])
    bars = spark.createDataFrame([("good", *BAR), ("early", *early), ("high", *high), ("more", *BAR), ("less", *BAR), ("changed", *BAR), ("twice", *BAR), ("twice", *BAR)], BARS)
    stated = bundles.digests(bars).where("bundle NOT IN ('more', 'changed')").unionByName(spark.createDataFrame([("changed", BAR[0], "0"), ("less", "2024-01-03", "1")], "bundle string, date string, sha256 string"))
    listings = bars.select("bundle").distinct().withColumn("currency", F.lit("USD"))
    got = {(r.bundle, r.date): r.reason for r in bundles.faults(bars, stated, listings).collect()}
    day = BAR[0]
    assert got == {("early", day): "available_before_end", ("high", day): "price_outside_range", ("more", day): "not_in_manifest", ("less", "2024-01-03"): "missing_day", ("changed", day): "digest_differs", ("twice", day): "repeated_day"}
    line = ",".join(BAR)
    texts = [("good", 1, line), ("good", 2, ",".join(bundles.FIELDS)), ("good", 3, line.rpartition(",")[0]), ("good", 4, line + ",x"), ("good", 5, line.replace("2.5", "2.6")), ("good", 6, line.replace("USD", '"USD"')), ("good", 7, None), ("good", 8, ""), ("good", 9, " " + line), ("early", 1, ",".join(early)), ("none", 1, line), (None, 1, line)]
    read = {(r.bundle, r.nth): r for r in bundles.read_lines(spark.createDataFrame(texts, "bundle string, nth int, line string"), bars, stated, listings).collect()}
    assert len(read) == len(texts)
    assert {k: r.reason for k, r in read.items()} == {("good", 1): None, ("good", 2): None, ("good", 3): "unexpected_fields", ("good", 4): "unexpected_fields", ("good", 5): "not_in_bundle", ("good", 6): None, ("good", 7): "unexpected_fields", ("good", 8): read["good", 8].reason, ("good", 9): "not_in_bundle", ("early", 1): "bundle_not_verified", ("none", 1): "bundle_not_verified", (None, 1): "bundle_not_verified"}
    assert read["good", 8].reason in ("unexpected_fields", "not_in_bundle") and read["good", 2].header
    one = read["good", 1]
    assert (one.date, one.event_time, one.value, one.header) == (day, datetime(2024, 1, 2, 22, 0, 0, 1000), Decimal("2.5"), False)


def test_a_bundle_is_frozen_whole_or_not_at_all(spark, tmp_path):  # noqa: F811
    at = lambda h, d=2: datetime(2024, 1, d, h)
    prices = spark.createDataFrame([("b", "2024-01-02", at(22), "USD", "2", "3", "1", "2.5", "10"), ("b", "2024-01-02", at(23), "USD", "2", "3", "1", "2.25", "10"), ("b", "2024-01-02", at(9, 9), "USD", "2", "3", "1", "2", "10")], "bundle string, date string, known_at timestamp, currency string, open string, high string, low string, close string, volume string")
    sessions = spark.createDataFrame([("b", d, at(21), at(14), at(21)) for d in ("2024-01-02", "2024-01-03")], "bundle string, date string, known_at timestamp, start timestamp, end timestamp")
    expected = spark.createDataFrame([("b", "2024-01-02", "USD"), ("b", "2024-01-02", "USD")], "bundle string, date string, currency string")
    cut = F.lit(at(0, 5))
    days = bundles.prepare(prices, sessions.where("date = '2024-01-02'"), expected, cut)
    row = days.first()
    assert (days.count(), row.reason, row.close, row.available_at) == (1, None, "2.25", "2024-01-02T23:00:00.000000Z")
    gap = bundles.prepare(prices, sessions, expected, cut)
    assert {r.date: r.reason for r in gap.collect()} == {"2024-01-02": None, "2024-01-03": "not_expected"}
    for wrong in (gap, days.limit(0)):
        with pytest.raises(ValueError, match="no whole bundle"):
            bundles.freeze(wrong, {"prices": prices}, f"{tmp_path}/gap")
    assert not (tmp_path / "gap").exists() and not bundles.is_frozen(spark, f"{tmp_path}/gap")
    bundles.freeze(days, {"prices": prices, "sessions": sessions}, f"{tmp_path}/ok")
    kept = {r.input: (r.rows, r.sha256) for r in spark.read.parquet(f"{tmp_path}/ok/inputs").collect()}
    assert bundles.is_frozen(spark, f"{tmp_path}/ok") and {k: v[0] for k, v in kept.items()} == {"prices": 3, "sessions": 2}
    with pytest.raises(Exception, match="(?i)exists"):
        bundles.freeze(days, {}, f"{tmp_path}/ok")
    bundles.freeze(days, {"prices": prices.repartition(3), "sessions": sessions.withColumn("end", F.lit(at(20)))}, f"{tmp_path}/other")
    other = {r.input: r.sha256 for r in spark.read.parquet(f"{tmp_path}/other/inputs").collect()}
    assert other["prices"] == kept["prices"][1] and other["sessions"] != kept["sessions"][1]


def test_valuation_takes_any_ratio_that_ends(spark):  # noqa: F811
    """Held against fractions: long ratios are exact, thirds are refused from their day on, even where a later split would mend them."""
    d = lambda n: date(2024, 1, n)
    days = [("a", d(n), "10.000000001", "1.0000000001" if n % 2 else None, "0.5" if n % 2 else None, "0.0000007" if n == 3 else None, d(6) if n == 3 else None) for n in range(1, 6)]
    days += [("b", d(1), "1", "1", "3", None, None), ("b", d(2), "1", "3", "1", None, None), ("c", d(1), "1", None, None, None, None), ("c", d(1), "1", None, None, None, None), ("d", d(1), "1", "2", None, None, None), ("e", d(1), None, None, None, None, None), ("f", d(1), "1", None, None, "1", None), ("g", None, "1", None, None, None, None), (None, d(1), "2", None, None, None, None), ("h", d(1), "1", "0", "1", None, None)]
    frame = spark.createDataFrame(days, "k string, day date, close string, new_shares string, old_shares string, dividend string, payment_date date")
    got = {}
    for r in corporate.exact_valuation(frame, "k", "1000", "100").collect():
        got.setdefault((r.k, r.day), []).append(r)
    held, owed = Fraction(100), Fraction(0)
    for n in range(1, 6):
        held *= Fraction("1.0000000001") / Fraction("0.5") if n % 2 else 1
        owed += held * Fraction("0.0000007") if n == 3 else 0
        r = got["a", d(n)][0]
        assert (Fraction(r.shares), Fraction(r.cash), Fraction(r.receivable), Fraction(r.wealth), r.error) == (held, 1000, owed, 1000 + owed + held * Fraction("10.000000001"), None)
    errors = {k: [r.error for r in rows] for k, rows in got.items() if k[0] != "a"}
    assert errors == {("b", d(1)): ["no_exact_result"], ("b", d(2)): ["no_exact_result"], ("c", d(1)): [None, "repeated_day"], ("d", d(1)): ["split_needs_both_sides"], ("e", d(1)): ["close_required"], ("f", d(1)): ["payment_date_required"], ("g", None): ["day_required"], (None, d(1)): [None], ("h", d(1)): ["split_needs_both_sides"]}
    assert got[None, d(1)][0].wealth == "1200" and corporate.exact_valuation(frame.limit(0), "k", "1", "1").count() == 0


SNAPSHOT = "kind string, target string, valid_from timestamp, valid_to timestamp, known_at timestamp, snapshot_id string, body string"


def test_references_in_one_pass(spark):  # noqa: F811
    t = lambda n: datetime(2024, 1, n)
    rows = [("x", '["a"]', t(1), None, t(1), "x1", "{}"), ("x", '["a"]', t(1), None, t(5), "x2", "{}"), ("y", '["a"]', t(1), None, t(1), "y1", "{}"), ("y", '["a"]', t(2), None, t(1), "y2", "{}"), ("z", '["a"]', t(1), None, t(1), "z1", "{}")]
    asks = spark.createDataFrame([(1, "a", t(4)), (2, "a", t(6)), (3, None, t(6))], "ask int, k string, at timestamp")
    found = references.references(asks, spark.createDataFrame(rows, SNAPSHOT), "ask", F.col("at"), {"x": references.target("k"), "y": references.target("k")})
    got = {r.ask: (r.x.status, r.x.snapshot_id, r.y.status, r.y.snapshot_id) for r in found.collect()}
    assert got == {1: ("resolved", "x1", "ambiguous", None), 2: ("resolved", "x2", "ambiguous", None), 3: ("unknown", None, "unknown", None)}
    assert references.references(asks.limit(0), spark.createDataFrame(rows, SNAPSHOT), "ask", F.col("at"), {"x": references.target("k")}).count() == 0


def test_an_identity_clashes_only_while_both_hold(spark):  # noqa: F811
    t = lambda n: datetime(2024, 1, n)
    body = '{"native_id":"n","symbol":"%s","venue_mic":"XNAS","currency":"USD","price_tick":"0.01","quantity_step":"1","minimum_quantity":"1"}'
    rules = '{"prepare_enabled":true,"rules":[{"asset_kind":"equity","time_in_force":"day","session":"regular","fractional_quantity":false}]}'
    rows = [("capabilities", '["a"]', t(1), None, t(1), "c", rules), ("instrument", '["a","equity","1"]', t(1), None, t(1), "i1", body % "S"), ("instrument", '["a","equity","2"]', t(5), t(8), t(1), "i2", body % "T")]
    order = "intent_id int, account string, environment string, asset_kind string, internal_id string, decision_at timestamp, valid_until timestamp, prepared_at timestamp, price_kind string, time_in_force string, session string, quantity decimal(18,6), price decimal(12,2)"
    intents = spark.createDataFrame([(n, "a", "paper", "equity", "1", t(n), t(n + 1), t(n), "raw_contract", "day", "regular", Decimal(2), Decimal("1.5")) for n in (2, 6, 9)], order)
    got = {r.intent_id: (r.reason, r.snapshot_ids) for r in references.prepared(intents, spark.createDataFrame(rows, SNAPSHOT)).collect()}
    assert got == {2: (None, ["c", "i1"]), 6: ("ambiguous_native_identity", None), 9: (None, ["c", "i1"])}


def test_imports_that_are_tried_again(spark):  # noqa: F811
    """A retry keeps its first version; changed input, lost rights and nulls are refused; attempts of a batch that differ are refused both."""
    grants = world(spark)[0]
    row = lambda n, payload=b"p", version="3", source="s", request="{}", at=T: (source, n, version, None if payload is None else bytearray(payload), at, at, request)
    kind = "source_id string, import_id string, version string, payload binary, received_at timestamp, processed_at timestamp, request string"
    first = imports.attempts(spark.createDataFrame([], kind).withColumn("raw_sha256", F.lit("")).drop("payload"), spark.createDataFrame([row("a", version="2"), row("o", version="1")], kind), grants, ["2", "3"])
    taken = first.select("source_id", "import_id", "version", "received_at", "processed_at", "request", "raw_sha256")
    assert {r.outcome for r in first.collect()} == {"new"}
    again = [row("a"), row("o"), row("b"), row("b"), row("c"), row("c", b"q"), row("n", None), row("t", source="t"), row(None), row("x", request=None), row("y", at=datetime(2023, 1, 1)), row("z", at=None)]
    got = {}
    for r in imports.attempts(taken, spark.createDataFrame(again, kind), grants, ["2", "3"]).collect():
        got.setdefault(r.import_id, []).append((r.outcome, r.kept_version, r.reason))
    no = lambda reason: ("refused", None, reason)
    assert got == {"a": [("retried", "2", None)], "o": [no("unsupported_archived_version")], "b": [("new", "3", None)] * 2, "c": [no("import_id_of_changed_input")] * 2, "n": [no("payload_required")], "t": [no("use_not_permitted")], None: [no("required_text_missing")], "x": [no("required_text_missing")], "y": [no("use_not_permitted")], "z": [no("processed_before_receipt")]}
    changed = imports.attempts(taken, spark.createDataFrame([row("a", b"q"), row("a", request="[]")], kind), grants, ["2"])
    assert {r.reason for r in changed.collect()} == {"import_id_of_changed_input"}


def test_symbols_and_native_names(spark):  # noqa: F811
    listings = spark.createDataFrame([("L", "USD"), ("M", "EUR"), ("N", "USD")], "listing_id string, trading_currency string")
    rows = [(1, "A", "L", "USD"), (2, "A", "L", "USD"), (2, "B", "L", "USD"), (3, "A", "M", "USD"), (4, "A", "Z", "USD"), (5, "A", "L", "USD"), (5, "A", "N", "USD"), (6, None, "L", "USD"), (6, " x", "N", "USD")]
    got = {r.import_id: r.reasons for r in imports.binding_faults(spark.createDataFrame(rows, "import_id int, symbol string, listing_id string, currency string"), listings).collect()}
    assert got == {2: ["symbols_share_a_listing"], 3: ["currency_differs"], 4: ["unknown_listing"], 5: ["symbol_of_several_listings"], 6: ["required_text_missing"]}


def test_jobs_that_were_broken_off(spark):  # noqa: F811
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    asks = spark.createDataFrame([(n, "q") for n in range(1, 11)] + [(None, "q")], "job_id int, request string")
    jobs = spark.createDataFrame([(n, "old" if n == 2 else "q", datetime(2025, 1, 1) if n == 3 else T) for n in range(2, 11)], "job_id int, request string, created_at timestamp")
    page = lambda job, n, token, digest=None: (job, n, f"{job}-{n}", digest or sha(f"{job}-{n}"), token)
    pages = spark.createDataFrame([page(4, 0, "t", "0"), page(5, 0, "t"), page(5, 2, None), page(6, 0, "t"), page(6, 1, "u"), page(7, 0, "t"), page(7, 1, None), page(8, 0, "t"), page(8, 1, None), page(9, 0, None)], "job_id int, page long, body string, sha256 string, next_token string")
    results = spark.createDataFrame([(8, T), (9, T)], "job_id int, available_at timestamp")
    stated = spark.createDataFrame([(8, 0, sha("8-0")), (8, 1, sha("8-1")), (9, 0, sha("9-0")), (9, 1, sha("9-1"))], "job_id int, page long, sha256 string")
    got = {r.job_id: (r.action, r.next_page, r.token) for r in imports.resumption(asks, jobs, pages, results, stated, F.lit(datetime(2024, 2, 1))).collect()}
    still = lambda action: (action, None, None)
    assert got == {1: ("start", 0, None), 2: still("request_changed"), 3: still("not_yet_available"), 4: still("journal_altered"), 5: still("journal_altered"), 6: ("resume", 2, "u"), 7: still("ended"), 8: still("finished"), 9: still("result_differs"), 10: ("resume", 0, None), None: ("start", 0, None)}


def test_sets_of_both_sides(spark):  # noqa: F811
    side = lambda rows: spark.createDataFrame(rows, "g int, m int")
    left, right = side([(1, 1), (1, 1), (1, None), (2, 1), (3, 1), (3, 2), (4, 1), (5, 1), (5, 2)]), side([(1, 1), (1, None), (2, 1), (2, 2), (3, 1), (4, 2), (5, 2), (5, 3), (6, 1)])
    got = {r.g: (r.only_left, r.only_right, r["both"], r.relation) for r in imports.set_relations(left, right, "g", "m").collect()}
    assert got == {1: (0, 0, 2, "equal"), 2: (0, 1, 1, "subset"), 3: (1, 0, 1, "superset"), 4: (1, 1, 0, "disjoint"), 5: (1, 1, 1, "overlapping"), 6: (0, 1, 0, "subset")}


def test_a_frozen_report_that_was_altered(spark):  # noqa: F811
    at = lambda h, d=2: datetime(2024, 1, d, h)
    row = lambda report, n, d, **change: tuple(({"report": report, "index": n, "economic_date": f"2024-01-0{d}", "listing_id": "L", "currency": "USD", "calendar_start": at(14, d), "calendar_end": at(21, d), "published_at": None, "available_at": at(23, d), "price_received_at": at(22, d), "price_processed_at": at(23, d), "calendar_processed_at": at(21, d), "open": "2", "high": "3", "low": "1", "close": "2", "volume": "0"} | change).values())
    kind = "report int, index long, economic_date string, listing_id string, currency string, calendar_start timestamp, calendar_end timestamp, published_at timestamp, available_at timestamp, price_received_at timestamp, price_processed_at timestamp, calendar_processed_at timestamp, open string, high string, low string, close string, volume string"
    frozen = spark.createDataFrame([row(r, n, n + 2) for r in range(1, 8) for n in (0, 1)], kind)
    now = spark.createDataFrame([row(1, 0, 2), row(1, 1, 3), row(2, 0, 2, close="2.5"), row(2, 1, 3), row(3, 0, 3), row(3, 1, 2), row(4, 1, 3), row(5, 0, 2, high="1.5"), row(5, 1, 3), row(6, 0, 2, published_at=at(1)), row(6, 1, 3, price_processed_at=None)], kind)
    heads = bundles.report_digest(frozen).selectExpr("report", "'L' AS listing_id", "'USD' AS currency", "timestamp'2024-02-01' AS checked_at", "true AS inspection_only", *[f"false AS {n}" for n in bundles.UNVERIFIED], "sha256")
    groups = frozen.select("report", "available_at", "index")
    got = {r.report: r.faults for r in bundles.report_faults(heads, now, groups).collect()}
    assert got == {1: [], 2: ["digest_differs"], 3: ["dates_not_increasing", "digest_differs", "groups_differ"], 4: ["digest_differs", "groups_differ", "index_not_dense"], 5: ["digest_differs", "price_outside_range"], 6: ["availability_differs", "digest_differs", "processed_before_receipt", "publication_claimed"], 7: ["digest_differs", "groups_differ", "index_not_dense"]}
