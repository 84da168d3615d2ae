"""Captures, times, exports and streams: wrong pages, empty tables, nulls, ties and late rows."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chronolake import sources
from chronolake.functions import times
from chronolake.operators import admission, bitemporal, brokers, captures, corporate, evidence, futures, jobs, journals, ledger, lineage, outcomes, replay, rules, trials
from chronolake.streaming import receipts
from tests.test_queries import spark  # noqa: F401

NOW = datetime(2024, 1, 25)


def test_wrong_bar_pages(spark):  # noqa: F811
    bar = '{"t":"2024-01-02T05:00:00Z","o":1,"h":2,"l":1,"c":2,"v":3}'
    pages = [(1, None), (2, "{"), (3, '{"bars":{},"bars":{}}'), (4, '{"bars":{"a/b":7,"~":[]}}'), (5, f'{{"bars":{{"a/b":[{bar},{{"t":"2024-01-02"}},{bar.replace("2024-01-02T05:00:00Z", "2024-01-03T05:00:00")}]}}}}')]
    frame = spark.createDataFrame([(i, p, NOW) for i, p in pages], "import_id int, payload string, received_at timestamp")
    listings = spark.createDataFrame([("a/b", "L")], "symbol string, listing_id string")
    got = {(r.import_id, r.row_path): r.reason for r in captures.bars(frame, listings, "America/New_York").collect()}
    assert got == {(1, "$"): "bars_object_required", (2, "$"): "bars_object_required", (3, "$"): "bars_object_required", (4, "bars/a~1b"): "bar_array_required", (4, "bars/~0"): "unmapped_symbol", (5, "bars/a~1b/0"): None, (5, "bars/a~1b/1"): "required_bar_fields_missing", (5, "bars/a~1b/2"): "invalid_bar_record"}
    assert captures.bars(frame.limit(0), listings, "UTC").count() == 0


def test_calendar_pages(spark):  # noqa: F811
    rows = '[{"date":"2024-03-10","open":"02:30","close":"16:00"},{"date":"2024-03-11","open":"09:30","close":"16:00"},{"date":"2024-13-01","open":"09:30","close":"16:00"},{"date":null,"open":"09:30","close":"16:00"}]'
    frame = spark.createDataFrame([(1, rows), (2, "{}")], "import_id int, payload string")
    got = {(r.import_id, r.row_path): (r.reason, r.opens_at) for r in captures.sessions(frame, "America/New_York", "2024-01-01", "2024-12-31").collect()}
    assert {k: v[0] for k, v in got.items() if k[0] == 1} == {(1, "/0"): "invalid_calendar_record", (1, "/1"): None, (1, "/2"): "invalid_calendar_record", (1, "/3"): "invalid_calendar_record"}
    assert got[1, "/1"][1] == datetime(2024, 3, 11, 13, 30)


def test_filing_and_action_envelopes(spark):  # noqa: F811
    frame = spark.createDataFrame([(1, "0000000007", '{"cik":7,"filings":{"recent":{"accessionNumber":["x"]},"files":[]}}', NOW), (2, "0000000007", None, NOW)], "import_id int, cik string, payload string, received_at timestamp")
    assert {r.reason for r in captures.filings(frame).collect()} == {"invalid_submissions_envelope"}
    asked = (date(2024, 1, 1), date(2024, 1, 31))
    frame = spark.createDataFrame([(1, '{"corporate_actions":{"cash_dividends":7},"next_page_token":null}', "S", *asked), (2, '{"corporate_actions":{},"more":1}', "S", *asked), (3, "[", "S", *asked), (4, '{"corporate_actions":{}}', "S", *asked)], "import_id int, payload string, symbol string, first date, last date")
    assert {r.import_id: r.reason for r in captures.actions(frame).collect()} == {1: "invalid_action_group", 2: "invalid_action_envelope", 3: "invalid_action_envelope"}


def test_times_and_numbers(spark):  # noqa: F811
    one = spark.range(1)
    texts = {"2024-01-01T00:00:00Z": True, "2024-01-01T00:00:00": False, "2024-01-01T00:00:00.1234567Z": False, "2024-01-01T00:00:00+01:00": True, "2024-02-30T00:00:00Z": False}
    assert [one.select(times.instant(F.lit(t)).isNotNull()).first()[0] for t in texts] == list(texts.values())
    numbers = {"1.50": True, "1e3": False, "NaN": False, "01": False, "0.1234567": True, "0.1234567890123456789": False, "-3": True}
    assert [one.select(times.number(F.lit(t)).isNotNull()).first()[0] for t in numbers] == list(numbers.values())
    local = {"2024-03-10 02:30:00": False, "2024-11-03 01:30:00": False, "2024-11-03 03:30:00": True}
    assert [one.select(times.strict_utc(F.lit(t).cast("timestamp"), "America/New_York").isNotNull()).first()[0] for t in local] == list(local.values())
    assert one.select(times.ceil_millis(F.lit("1969-12-31 23:59:59.000001").cast("timestamp"))).first()[0] == datetime(1969, 12, 31, 23, 59, 59, 1000)


def test_valuation_golden(spark):  # noqa: F811
    """100 shares, split 2:1 on day 2 with a dividend of 0.5 a share on the shares after it, paid when day 4 is the next day."""
    d = lambda n: date(2024, 1, n)
    days = [("a", d(1), Decimal(10), None, None, None, None), ("a", d(2), Decimal(5), 2, 1, Decimal("0.5"), d(3)), ("a", d(4), Decimal(6), None, None, None, None), ("b", d(1), Decimal(1), 1, 3, None, None)]
    frame = spark.createDataFrame(days, "k string, day date, close decimal(18,2), new_shares int, old_shares int, dividend decimal(12,6), payment_date date")
    got = {(r.k, r.day): r for r in corporate.valuation(frame, "k", "1000", "100").collect()}
    assert [(got["a", d(n)].shares, got["a", d(n)].cash, got["a", d(n)].receivable, got["a", d(n)].wealth) for n in (1, 2, 4)] == [(100, 1000, 0, 2000), (200, 1000, 100, 2100), (200, 1100, 0, 2300)]
    assert got["a", d(4)].exact and not got["b", d(1)].exact
    half = spark.createDataFrame([("c", d(1), Decimal(10), Decimal("1.5"), Decimal(1)), ("d", d(1), Decimal(10), Decimal("1.00001"), Decimal(1))], "k string, day date, close decimal(18,2), new_shares decimal(18,6), old_shares decimal(18,6)").selectExpr("*", "cast(null as decimal(12,6)) AS dividend", "cast(null as date) AS payment_date")
    got = {r.k: r for r in corporate.valuation(half, "k", "0", "10").collect()}
    assert (got["c"].shares, got["c"].wealth, got["c"].exact, got["d"].exact, str(got["d"].shares)) == (15, 150, True, True, "10.000100")


def test_snapshots_and_late_corrections(spark):  # noqa: F811
    """A later version that ends early hides the one before; an older cutoff still sees that."""
    t = lambda n: datetime(2024, 1, n)
    log = spark.createDataFrame([("k", t(1), None, t(1), "old"), ("k", t(1), t(5), t(10), "new"), ("k", t(1), None, None, "never")], "k string, valid_from timestamp, valid_to timestamp, known_at timestamp, v string")
    asks = spark.createDataFrame([(1, "k", t(7), t(9)), (2, "k", t(7), t(11)), (3, "k", t(3), t(11)), (4, "x", t(3), t(11)), (5, None, t(3), t(11))], "ask int, k string, effective_at timestamp, as_of timestamp")
    got = {r.ask: (r.status, r.v) for r in bitemporal.snapshots_for(asks, log, "ask", ["k"], "v").collect()}
    assert got == {1: ("resolved", "old"), 2: ("unknown", None), 3: ("resolved", "new"), 4: ("unknown", None), 5: ("unknown", None)}


def test_reviews_outcomes_and_journals(spark):  # noqa: F811
    t = lambda n: datetime(2024, 1, n)
    reviews = spark.createDataFrame([("s", "rights", t(1), 1, "allow", t(30)), ("s", "rights", t(8), 2, "deny", t(30)), ("u", "rights", t(1), 1, "allow", t(30)), ("w", "rights", t(1), 1, "allow", t(6))], "scope string, axis string, known_at timestamp, review_id int, decision string, expires_at timestamp")
    got = admission.assess(reviews, "scope", ["rights"], F.lit(t(5)), F.lit(t(9))).collect()
    assert {r.scope: r.eligible for r in got} == {"s": False, "u": True, "w": False}
    found = spark.createDataFrame([(1, 10, t(3), "validated", 1.0, None), (1, 11, t(6), "validated", 1.0, 10), (1, 12, t(7), "unavailable", 1.0, 11), (2, 20, t(9), "validated", 1.0, None), (3, 30, t(9), "validated", 1.0, 5)], "k int, outcome_id int, known_at timestamp, status string, value double, correction_of int")
    due = spark.createDataFrame([(1, t(5)), (3, t(5))], "k int, label_end timestamp")
    assert {r.outcome_id: r.reason for r in outcomes.check_outcomes(found, due, "k").collect()} == {10: "not_matured", 11: None, 12: "value_without_validation", 20: "unknown_prediction", 30: "not_the_latest_corrected"}
    stored = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    came = spark.createDataFrame([(1, None), (1, None), (2, "c"), (3, "d"), (4, "e"), (4, None)], "k int, v string")
    assert {r.k: r.outcome for r in journals.append_once(stored, came, ["k"]).collect()} == {1: "same", 2: "conflict", 3: "new", 4: "conflict"}
    with pytest.raises(ValueError):
        rules.partition_of(F.col("day"), [("a", "2024-01-01", "2024-01-05"), ("b", "2024-01-06", "2024-01-09")], 2)


def test_export_is_verified(spark, tmp_path):  # noqa: F811
    rows = spark.createDataFrame([(1, "a,\"b", Decimal("1.50")), (2, None, None), (3, "", Decimal(2))], "k int, t string, v decimal(9,2)")
    path = f"{tmp_path}/bundle"
    sources.export(rows, ["k"], path)
    assert sources.verify(spark, "k int, t string, v decimal(9,2)", ["k"], path).count() == 0
    with pytest.raises(Exception, match="exists"):
        sources.export(rows, ["k"], path)
    rows.withColumn("v", F.lit(9).cast("decimal(9,2)")).where("k < 3").write.mode("overwrite").option("nullValue", "\\N").csv(f"{path}/rows", header=True)
    assert {r.k: (r.stored is None, r.declared is None) for r in sources.verify(spark, "k int, t string, v decimal(9,2)", ["k"], path).collect()} == {"1": (False, False), "2": (False, False), "3": (True, False)}


def test_groups_of_one_instant_in_a_stream(spark, tmp_path):  # noqa: F811
    """Rows of one instant from two files make one group; kept batches are the same when run again."""
    at = "cast('2024-01-01' as timestamp) + make_dt_interval(0, 0, id div 2)"
    for name, first, last in (("a", 0, 9), ("b", 9, 40)):
        spark.range(first, last).selectExpr("id", "'k' AS k", f"{at} AS available_at").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    stream = spark.readStream.schema("id long, k string, available_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    groups = receipts.equal_time_groups(stream, ["k"], "available_at", "id", "2 seconds")
    keep = receipts.keep_batches(f"{tmp_path}/out")
    run = groups.writeStream.option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda b, n: (keep(b, n), keep(b, n)) and None).trigger(availableNow=True).start()
    assert run.awaitTermination(100)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.rows, r.first_id, r.last_id) for r in got) == [(2, n, n + 1) for n in range(0, 2 * len(got), 2)]
    assert len(got) == 19 and max(r.available_at for r in got) == datetime(2024, 1, 1, 0, 18)  # the last instant is still open


def test_lineage_of_long_chains_cycles_and_diamonds(spark):  # noqa: F811
    chain = [(f"c{k}", f"c{k + 1}") for k in range(40)]
    edges = spark.createDataFrame([*chain, ("x", "y"), ("y", "z"), ("z", "x"), ("z", "w"), ("p", "q1"), ("p", "q2"), ("q1", "r"), ("q2", "r"), ("x", "y"), (None, "x"), ("w", None)], "source string, target string")
    roots = spark.createDataFrame([("c0",), ("x",), ("p",), (None,), ("lone",)], "node string")
    got = {}
    for r in lineage.impacted(edges, roots).collect():
        got.setdefault(r.root, []).append(r.node)
    assert {k: sorted(v) for k, v in got.items()} == {"c0": sorted(f"c{k}" for k in range(41)), "x": ["w", "x", "y", "z"], "p": ["p", "q1", "q2", "r"], "lone": ["lone"]}
    assert sorted(r.node for r in lineage.on_cycles(edges.where("source NOT LIKE 'c%'")).collect()) == ["x", "y", "z"]
    assert lineage.impacted(edges.limit(0), roots).count() == 4 and lineage.impacted(edges, roots.limit(0)).count() == 0


def test_artifacts_incidents_and_corrections(spark):  # noqa: F811
    t = lambda n: datetime(2024, 1, n)
    rows = [("a", "model", "1", 2, 2), ("b", "model", "2", 3, 3), ("c", "model", "3", 4, 4), ("d", "model", "", 2, 2), ("e", "model", "5", 5, 4), ("f", "model", "6", 2, 2), ("g", "model", "7", 2, 2), ("h", "model", "8", 2, 2)]
    artifacts = spark.createDataFrame([(a, k, p.encode(), t(n), t(r)) for a, k, p, n, r in rows], "artifact_id string, kind string, payload binary, known_at timestamp, recorded_at timestamp")
    deps = spark.createDataFrame([("a", "evidence", "e1", None), ("b", "artifact", "a", None), ("c", "raw", "s1", "e1"), ("c", "artifact", "b", None), ("d", "evidence", "e1", None), ("e", "evidence", "e1", None), ("g", "evidence", "late", None), ("h", "raw", "s2", "e1")], "artifact_id string, kind string, id string, evidence_id string")
    proof = spark.createDataFrame([("e1", "s1", t(1)), ("late", "s9", t(9))], "evidence_id string, sha256 string, received_at timestamp")
    got = {r.artifact_id: r.reason for r in lineage.register_artifacts(artifacts, deps, proof).collect()}
    assert got == {"a": None, "b": None, "c": None, "d": "payload_required", "e": "known_after_record", "f": "dependency_required", "g": "dependency_unavailable", "h": "raw_is_not_its_evidence"}
    ring = deps.limit(0).union(spark.createDataFrame([("a", "artifact", "b", None), ("b", "artifact", "a", None), ("b", "artifact", "a", None), ("c", "artifact", "b", None)], deps.schema))
    assert {r.artifact_id: r.reason for r in lineage.register_artifacts(artifacts.where("artifact_id IN ('a', 'b', 'c')"), ring, proof).collect()} == {"a": "dependency_cycle", "b": "duplicate_dependency", "c": None}
    known = artifacts.selectExpr("artifact_id", "recorded_at AS available_at")
    bound = deps.withColumn("sha256", F.when(F.col("id") == "e1", "s1").when(F.col("kind") == "raw", F.col("id")))
    incidents = spark.createDataFrame([("i1", "data", True, t(5), "evidence", "e1"), ("i2", "forecast_loss", True, t(5), "artifact", "b"), ("i3", "policy", True, t(9), "artifact", "h"), ("i4", "data", False, t(5), "raw", "s1")], "incident_id string, category string, confirmed boolean, available_at timestamp, kind string, id string")
    hit = {}
    for r in lineage.impact_as_of(known, bound, incidents, F.lit(t(6))).collect():
        hit.setdefault((r.incident_id, r.invalidates), set()).add(r.artifact_id)
    assert hit == {("i1", True): set("abcdeh"), ("i2", False): {"b", "c"}, ("i4", False): set("abcde")}
    assert {r.artifact_id for r in lineage.usable(known, bound, incidents, F.lit(t(3)), F.lit(t(6))).where("usable").collect()} == {"f", "g"}
    fixes = spark.createDataFrame([(1, "i1", "f", t(6)), (2, "i1", "b", t(6)), (3, "i3", "f", t(6)), (4, "i2", "none", t(6)), (5, "i1", "f", t(20))], "correction_id int, incident_id string, replacement_id string, known_at timestamp")
    assert {r.correction_id: r.reason for r in lineage.check_corrections(fixes, known, bound, incidents, F.lit(t(8))).collect()} == {1: None, 2: "replacement_is_affected", 3: "incident_not_known", 4: "replacement_not_available"}
    where_from = lineage.origins(deps, spark.createDataFrame([("e1", "provider"), ("late", "fixture")], "evidence_id string, origin string"), spark.createDataFrame([("c",), ("g",)], "r string"))
    assert {r.artifact_id: r.origins for r in where_from.collect()} == {"c": ["provider"], "g": ["fixture"]}


def test_exact_bar_amounts_and_page_tokens(spark):  # noqa: F811
    bar = lambda n, day: f'{{"t":"2024-01-{day:02d}T05:00:00Z","o":{n},"h":{n},"l":{n},"c":{n},"v":3}}'
    numbers = ["12345678.5", "10000000.25", "123456789012.123456", "0.0005", "0.0001", "1e2", '"7.5"', "true", "0.1234567890123456789", "100000000000000000000", "-1", "0"]
    page = '{"bars":{"a":[' + ",".join(bar(n, k + 1) for k, n in enumerate(numbers)) + "]}}"
    frame = spark.createDataFrame([(1, page, NOW)], "import_id int, payload string, received_at timestamp")
    got = [(r.close if r.reason is None else r.reason) for r in captures.bars(frame, spark.createDataFrame([("a", "L")], "symbol string, listing_id string"), "UTC").orderBy("at").collect()]
    assert got == [Decimal("12345678.5"), Decimal("10000000.25"), Decimal("123456789012.123456"), Decimal("0.0005"), Decimal("0.0001"), Decimal(100), Decimal("7.5"), *["invalid_amount"] * 5]
    pages = spark.createDataFrame([(1, '{"next_page_token":"x"}'), (2, '{"next_page_token":null}'), (3, "{}"), (4, '{"next_page_token":" "}'), (5, '{"next_page_token":7}'), (6, "["), (7, None)], "import_id int, payload string")
    assert {r.import_id: (r.state, r.token) for r in captures.page_tokens(pages).collect()} == {1: ("more_pages", "x"), 2: ("terminal_page", None), **{k: ("unknown", None) for k in range(3, 8)}}


def test_records_rights_and_small_functions(spark):  # noqa: F811
    t = lambda n: datetime(2026, 1, n)
    body = '{{"kind":"{}","listing_id":"l","date":"2026-01-05","start":"2026-01-05T14:30:00Z","end":"2026-01-05T21:00:00Z","currency":"USD","values":{}}}'
    bar = '{"open":"100","high":"105","low":"95","close":"102","volume":"50","price_kind":"raw"}'
    made = [("bar", bar), ("session", '{"timezone":"America/New_York"}'), ("split", '{"new_shares":"3","old_shares":"2"}'), ("cash_dividend", '{"amount":"1","payment_date":"2026-01-20"}'), ("bar", bar.replace("105", "101")), ("bar", bar.replace("raw", "adjusted")), ("session", '{"timezone":"Nowhere/X"}'), ("session", '{"timezone":"Asia/Tokyo"}'), ("split", '{"new_shares":"0","old_shares":"2"}'), ("cash_dividend", '{"amount":"1","payment_date":"2026-01-01"}'), ("merger", "{}"), ("bar", "{}"), ("bar", bar.replace('"50"', "50"))]
    rows = [(k, body.format(*m), t(6), t(6), t(7)) for k, m in enumerate(made)]
    rows += [(20, rows[0][1], t(8), t(7), t(9)), (21, "[1]", t(6), t(6), t(7)), (22, None, t(6), t(6), t(7)), (23, rows[0][1].replace("USD", "EUR"), t(6), t(6), t(7)), (24, rows[0][1], t(5), t(6), t(7)), (25, rows[0][1][:-1] + ',"more":1}', t(6), t(6), t(7))]
    frame = spark.createDataFrame(rows, "record_id int, payload string, published_at timestamp, received_at timestamp, processed_at timestamp")
    got = {r.record_id: r.reason for r in replay.records(frame, spark.createDataFrame([("l", "USD")], "listing_id string, trading_currency string")).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: "invalid_ohlc_bounds", 5: "adjusted_price", 6: "unknown_timezone", 7: "session_not_on_its_day", 8: "invalid_amount", 9: "invalid_payment_date", 10: "unsupported_kind", 11: "unexpected_values", 12: "invalid_amount", 20: "times_out_of_order", 21: "invalid_json_object", 22: "invalid_json_object", 23: "listing_or_currency", 24: "published_before_end", 25: "unexpected_fields"}
    grants = spark.createDataFrame([("s", t(1), ["research"]), ("s", t(5), [])], "source_id string, known_at timestamp, uses array<string>")
    asks = spark.createDataFrame([(1, "s", "research", t(2)), (2, "s", "research", t(5)), (3, "s", "storage", t(2)), (4, "none", "research", t(9)), (5, None, "research", t(9))], "n int, source_id string, use string, as_of timestamp")
    assert {r.n: r.allowed for r in evidence.allowed(asks, grants).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    one = spark.range(1)
    first = lambda c: one.select(c).first()[0]
    ends = times.day_bounds(F.lit("2024-03-10").cast("date"), F.lit("2024-03-10").cast("date"), "America/New_York")
    assert (first(ends[0]), first(ends[1])) == (datetime(2024, 3, 10, 5), datetime(2024, 3, 11, 4))
    assert [first(times.symbol_list(F.lit(x).cast("array<string>"))) for x in (["B", "A.C"], ["a"], ["A", "A"], [])] == ["A.C,B", None, None, None]
    assert first(times.canonical_json(b=F.lit(None).cast("string"), a=F.lit("x"))) == '{"a":"x","b":null}' and first(times.horizon(F.lit(t(1)), F.lit(90))) == datetime(2026, 1, 1, 0, 1, 30)
    assert [first(evidence.required(F.lit(x).cast("string"))) for x in ("a b", " a", "", None)] == [True, False, False, False]
    assert first(captures.uuid_text(F.lit("URN:UUID:{0123456789ABCDEF0123456789abcdef}"))) == "01234567-89ab-cdef-0123-456789abcdef"
    drafts = spark.createDataFrame([("1", "a", "S", "9", "X", "buy", "1.5", "2", "day", "regular", "c"), ("2", "b", "S", "9", "X", "sell", "1", "2", "day", "regular", "c"), ("3", "z", "S", "9", "X", "sell", "1", "2", "day", "regular", "c")], "intent_id string, account string, symbol string, native_id string, venue string, side string, quantity string, price string, tif string, session string, client_id string")
    formats = spark.createDataFrame([("a", "paper", "synthetic-contract-paper"), ("b", "live", "synthetic-symbol-paper")], "account string, environment string, adapter_id string")
    sent = {r.intent_id: (r.reason, r.payload) for r in brokers.encode(drafts, formats).collect()}
    assert sent["1"] == (None, '{"account":"a","action":"BUY","contract_id":"9","duration":"DAY","exchange":"X","limit_price":"2","order_type":"LIMIT","reference":"c","session":"regular","units":"1.5"}') and [sent[k][0] for k in "23"] == ["paper_only", "no_adapter"]


def test_evidence_as_of_identifiers_and_inventory(spark):  # noqa: F811
    t = lambda n: datetime(2026, 1, n)
    one, two = b"one", b"two"
    sha = lambda p: __import__("hashlib").sha256(p).hexdigest()
    versions = spark.createDataFrame([("e1", "s", "r", sha(one), t(2)), ("e2", "s", "r", sha(two), t(5)), ("e3", "s", "q", sha(b"lost"), t(2))], "evidence_id string, source_id string, record_id string, sha256 string, received_at timestamp")
    raw = spark.createDataFrame([(sha(one), one), (sha(two), b"other")], "sha256 string, payload binary")
    sources = spark.createDataFrame([("s", "fixture")], "source_id string, origin string")
    grants = spark.createDataFrame([("s", t(1), ["research"]), ("s", t(8), [])], "source_id string, known_at timestamp, uses array<string>")
    asks = spark.createDataFrame([(1, "s", "r", t(3)), (2, "s", "r", t(6)), (3, "s", "r", t(9)), (4, "s", "r", t(1)), (5, "s", "q", t(3)), (6, "z", "r", t(3))], "request int, source_id string, record_id string, as_of timestamp")
    got = {r.request: (r.status, r.evidence_id, r.origin) for r in evidence.evidence_as_of(versions, sources, raw, grants, asks).collect()}
    assert got == {1: ("known", "e1", "fixture"), 2: ("payload_corrupt", "e2", None), 3: ("use_not_allowed", None, None), 4: ("unknown", None, None), 5: ("payload_corrupt", "e3", None), 6: ("use_not_allowed", None, None)}
    rows = [("m", t(3), "p", "v", "l", t(1), None, "e1"), ("m", t(3), "p", " v", "l", t(1), None, "e1"), ("m", t(3), "p", "v", "l", t(2), t(2), "e1"), ("m", t(3), "p", "v", "l", t(1), None, "e2"), ("m", t(9), "p", "v", "l", t(1), None, "e2"), ("m", t(3), "p", "v", "l", t(1), None, "none")]
    puts = spark.createDataFrame([(str(k), *r[1:]) for k, r in enumerate(rows)], "mapping_id string, known_at timestamp, provider string, value string, listing_id string, valid_from timestamp, valid_to timestamp, evidence_id string")
    assert {r.mapping_id: r.reason for r in evidence.check_identifiers(puts, versions, grants).collect()} == {"0": None, "1": "required_text_missing", "2": "empty_interval", "3": "evidence_not_known", "4": "use_not_allowed", "5": "evidence_not_known"}
    assert {r.name: (r.rows, r.latest) for r in evidence.inventory(versions=versions, sources=sources, none=grants.limit(0)).collect()} == {"versions": (3, t(5)), "sources": (1, None), "none": (0, None)}


def test_lookups_with_nulls_ties_and_hot_keys(spark):  # noqa: F811
    """Days carry over; null times are never taken; nulls are equal as keys of duplicates and collide with nothing."""
    t = lambda d, h=0: datetime(2026, 1, d, h)
    left = spark.createDataFrame([(1, "k", t(5)), (2, "k", t(5, 9)), (3, "k", t(9)), (4, None, t(9)), (5, "k", None), (6, "z", t(1)), (7, "k", t(1))], "n int, key string, at timestamp")
    right = spark.createDataFrame([("k", t(2), 10), ("k", t(5), 20), ("k", t(5), 30), ("k", t(6), None), (None, t(3), 40), ("k", None, 99)], "key string, at timestamp, v int")
    got = {r.n: r.v for r in bitemporal.as_of_join(left, right, "key", "at", "at", "v", "v").collect()}
    assert got == {1: 30, 2: 30, 3: 30, 4: 40, 5: None, 6: None, 7: None}
    log = spark.createDataFrame([("a", t(1), 1, "x"), ("a", t(2), 1, "y"), ("a", t(2), 2, None), ("a", t(9), 3, "w"), (None, t(1), 1, "n"), ("b", None, 1, "q")], "key string, at timestamp, tie int, V string")
    assert sorted(map(str, bitemporal.latest_as_of(log, ["key"], "at", F.lit(t(5)), ["tie"]).select("key", "V", "tie").collect())) == sorted(["Row(key='a', V=None, tie=2)", "Row(key=None, V='n', tie=1)"])
    pairs = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, None, 1), (4, None, 1), (5, "b", 2)], "n int, x string, y int")
    assert {r.n for r in bitemporal.split_duplicates(pairs, ["x", "y"]).collect() if r.reason} == {1, 2, 3, 4}
    assert {r.n for r in bitemporal.colliding(pairs, ["x", "y"]).collect() if r.collides} == {1, 2} and bitemporal.colliding(pairs.limit(0), ["x"]).count() == 0
    spans = spark.createDataFrame([(1, "k", t(1), t(8)), (2, "k", t(3), t(4)), (3, "k", t(8), t(9)), (4, "k", t(10), t(11)), (5, "k", t(10), t(10)), (6, "z", t(3), t(3))], "n int, key string, a timestamp, b timestamp")
    assert {r.n for r in bitemporal.overlaps_earlier(spans, "key", "a", "b", "n").collect() if r.overlaps} == {2, 3, 5}
    cash = spark.createDataFrame([(1, t(1), "5.00"), (2, t(1, 2), None), (3, t(4), "-7.25"), (4, None, "1.00")], "n int, at timestamp, v string").withColumn("who", F.lit(None).cast("string"))
    assert {r.n: str(r.cash) for r in ledger.running_cash(cash, "who", ["at", "n"], F.col("v").cast("decimal(18,2)")).collect()} == {4: "1.00", 1: "6.00", 2: "6.00", 3: "-1.25"}


def test_jobs_and_protocols_with_nulls(spark):  # noqa: F811
    t = lambda d: datetime(2026, 1, d)
    asked = spark.createDataFrame([(k, 3, 100, 1, 9) for k in range(1, 9)], "job_id int, max_pages int, max_bytes int, first_day int, last_day int")
    page = lambda job, n, sent, state, token, size=10, bad=0: (job, n, sent, token, state, size, bad)
    pages = [page(1, 0, None, "more_pages", "a"), page(1, 1, "a", "terminal_page", None), page(1, 2, None, "terminal_page", None), page(2, 0, None, "more_pages", "a"), page(2, 1, "a", "more_pages", "a"), page(3, 0, None, "more_pages", "a", 90), page(3, 1, "a", "terminal_page", None, 11), page(4, 0, None, "more_pages", "a"), page(4, 2, "a", "terminal_page", None), page(5, 0, None, "terminal_page", None, None, None), page(6, 0, "x", "terminal_page", None), page(7, 0, None, "more_pages", "a"), page(7, 1, "a", "terminal_page", None), page(77, 0, None, "terminal_page", None)]
    frame = spark.createDataFrame(pages, "job_id int, page int, sent_token string, next_token string, token_state string, bytes int, quarantined int")
    rows = spark.createDataFrame([(1, 0, "l", 1), (1, 0, "l", 1), (1, 1, "l", 2), (1, 2, "l", 99), (5, 0, "l", None), (7, 0, "l", 3), (7, 1, "l", 3)], "job_id int, page int, listing_id string, day int")
    got = {r.job_id: (r.pages, r.bytes, r.state, r.reason) for r in jobs.results(asked, frame, rows).collect()}
    assert got == {1: (2, 20, "complete_pages", "terminal_page"), 2: (2, 20, "incomplete", "pagination_cycle"), 3: (1, 90, "incomplete", "byte_limit"), 4: (1, 10, "incomplete", "interrupted_previous_run"), 5: (1, 0, "quarantined", "response_outside_request"), 6: (1, 10, "quarantined", "page_token_mismatch"), 7: (2, 20, "quarantined", "duplicate_cross_page_bar"), 8: (0, 0, "incomplete", "interrupted_previous_run")}
    day = date(2026, 1, 1)
    asks = [(1, "i", t(1), day, date(2026, 2, 1)), (2, "i", t(2), date(2026, 2, 1), date(2026, 3, 1)), (3, "i", t(3), date(2026, 2, 2), date(2026, 2, 9)), (4, None, t(1), day, day), (5, "i", t(4), None, day), (6, "i", t(5), date(2026, 5, 2), date(2026, 5, 1)), (7, "i", t(6), date(2025, 1, 1), date(2027, 1, 1))]
    periods = spark.createDataFrame(asks, "n int, instrument string, at timestamp, start date, end date")
    assert {r.n: r.consumed for r in trials.consume(periods, "instrument", ["at", "n"], "start", "end").collect()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False, 7: False}
    assert trials.consume(periods.limit(0), "instrument", ["at"], "start", "end").count() == 0
    good = {"price_source_id": "p", "calendar_source_id": "c", "start_date": "2026-01-05", "end_date": "2026-01-06", "feed": "iex", "capture_snapshot_sha256": "a" * 64}
    reason = lambda **more: spark.range(1).select(jobs.scope_reason({k: F.lit(v).cast("string") for k, v in (good | more).items()})).first()[0]
    assert [reason(), reason(feed=None), reason(calendar_source_id="p"), reason(end_date="2026-1-6"), reason(feed="x"), reason(capture_snapshot_sha256="A" * 64)] == [None, "required_text_missing", "distinct_sources_required", "canonical_dates_required", "invalid_interval_or_feed", "exact_sha256_required"]
    made = spark.createDataFrame([("d", "1", "t", "u", "b", "p", "c", 60, "paper_fills"), ("d", "2", " ", "u", "b", "p", "c", 60, "paper_fills"), ("d", "3", "t", "u", "b", "p", "c", None, "paper_fills"), ("d", "4", "t", "u", "b", "p", "c", 60, None)], "definition_id string, version_id string, target string, unit string, benchmark string, price_convention string, cost_convention string, horizon_seconds long, outcome_origin string")
    assert {r.version_id: r.reason for r in trials.check_definitions(made).collect()} == {"1": None, "2": "required_text_missing", "3": "positive_horizon_required", "4": "unknown_origin"}
    sessions = spark.createDataFrame([("s", t(1), t(2)), ("s", t(2), t(3)), ("s", t(2), t(2)), ("z", t(5), None)], "key string, opens_at timestamp, closes_at timestamp")
    assert sorted((r.key, r.opens_at.day, r.closes_at and r.closes_at.day) for r in futures.session_faults(sessions, "key").collect()) == [("s", 2, 2), ("z", 5, None)]
    assert [r[0] for r in spark.createDataFrame([("mutual_fund",), ("index",), ("equity",)], "k string").select(trials.execution_model(F.col("k"))).collect()] == ["nav_subscription_redemption", "reference_only", "exchange_orderbook"]
