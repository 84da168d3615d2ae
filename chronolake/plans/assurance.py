"""Queries over reviews, bundles, frozen reports, exact valuations and looked-up references, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolake.operators import bundles, corporate, imports, references, reviews, rules
from chronolake.operators.jobs import AXES
from chronolake.sources import read


def _at(text: str):
    return F.lit(text).cast("timestamp")


def _text(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _pick(names, n):
    return F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))


def _uses(*names):
    return F.array(*map(F.lit, names)).cast("array<string>")


def review_record(spark, d):
    """Orders as reviews of their customer's captures; some were taken before, some of these with another decision."""
    o, k, c = read(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    who, sha = _text("o_custkey"), lambda s: F.sha2(F.concat(F.lit(s), _text("o_custkey")), 256)
    scope = {"bar_import_id": F.concat(F.lit("b"), who), "calendar_import_id": F.concat(F.lit("c"), who), "bar_raw_sha": sha("b"), "calendar_raw_sha": sha("c"), "listing_id": who, "venue": F.lit("XNAS"), "start_date": F.lit("2024-01-01"), "end_date": F.lit("2024-01-31"), "feed": F.when(k % 31 == 0, "otc").otherwise("iex")}
    axis = _pick(AXES, k)
    bases = list(reviews.PURPOSES.values())
    refs = F.when(k % 47 == 0, F.array(F.concat(F.lit("e"), who), F.concat(F.lit("e"), who))).when(k % 53 == 0, F.array(F.concat(F.lit("e"), _text(c + 1)))).otherwise(F.array(F.concat(F.lit("e"), who)))
    known = F.col("o_orderdate").cast("timestamp")
    incoming = o.select(_text("o_orderkey").alias("review_id"), who.alias("source_id"), axis.alias("axis"), _pick(list(reviews.PURPOSES), k).alias("purpose"), F.when(k % 5 == 0, "deny").otherwise("allow").alias("decision"), F.struct(*[v.alias(n) for n, v in scope.items()]).alias("scope"),
                        known.alias("known_at"), F.when(k % 37 == 0, known + F.expr("INTERVAL 1 DAY")).otherwise(known).alias("recorded_at"), (known + F.make_dt_interval(days=(k % 41).cast("int"))).alias("expires_at"), F.when(k % 43 == 0, " r").otherwise("r").alias("reviewer"), refs.alias("evidence_refs"),
                        F.when(k % 59 == 0, "other").when(axis == "temporal", _pick(bases, k)).alias("temporal_basis"), F.when(axis == "rights", _uses("storage", "research")).alias("declared_rights"))
    customers = read(spark, d, "customer").select(_text("c_custkey").alias("source_id"), "c_custkey", "c_name")
    grants = customers.select("source_id", _at("1992-01-01").alias("known_at"), F.when(F.col("c_custkey") % 10 == 0, _uses("storage")).otherwise(_uses("storage", "research")).alias("uses"))
    grants = grants.unionByName(customers.where("c_custkey % 10 = 1").select("source_id", _at("1996-01-01").alias("known_at"), _uses().alias("uses")))
    evidence = customers.select(F.concat(F.lit("e"), "source_id").alias("evidence_id"), "source_id", _at("1994-01-01").alias("received_at"), F.sha2(F.when(F.col("c_custkey") % 29 == 0, F.lit("x")).otherwise(F.col("c_name")), 256).alias("sha256"), F.col("c_name").cast("binary").alias("payload"))
    before = incoming.where(F.col("review_id").cast("long") % 61 == 0)
    before = before.withColumn("decision", F.when(F.col("review_id").cast("long") % 122 == 0, F.when(F.col("decision") == "deny", "allow").otherwise("deny")).otherwise(F.col("decision")))
    none = before.limit(0).withColumns({"scope_sha256": F.lit(""), "review_sha256": F.lit("")})
    taken = reviews.record(none, before, grants, evidence).where("reason IS NULL OR reason = 'another_review_at_this_time'").drop("outcome", "reason")
    found = reviews.record(taken, incoming, grants, evidence)
    return found.select("review_id", "outcome", F.coalesce("reason", F.lit("")).alias("reason"))


def capture_review(spark, d):
    """Users as listings with a capture of their clicks and one of a calendar; their events are reviews of just these captures."""
    e, u, n = read(spark, d, "events"), F.col("user_id"), F.col("event_id")
    doc = read(spark, d, "documents").select(F.col("doc_id").alias("user_id"), F.coalesce("text", F.lit("")).alias("text"))
    users = e.select("user_id").distinct().join(doc, "user_id", "left")
    purpose = F.when(u % 5 == 0, "historical_replay").when(u % 5 == 1, "synthetic_validation").otherwise("forward_observation")
    sha = lambda c: F.sha2(F.coalesce(c, F.lit("none")), 256)
    bar, calendar = F.col("text"), F.concat("text", F.lit("c"))
    scope = {"bar_import_id": F.concat(F.lit("b"), _text(u)), "calendar_import_id": F.concat(F.lit("c"), _text(u)), "bar_raw_sha": F.when(u % 11 == 0, sha(F.lit("x"))).otherwise(sha(bar)), "calendar_raw_sha": sha(calendar), "listing_id": _text(u), "venue": F.lit("XNAS"), "start_date": F.lit("2024-01-01"), "end_date": F.lit("2024-01-31"), "feed": F.when(u % 31 == 0, "sip").otherwise("iex")}
    users = users.withColumns({"scope": F.struct(*[v.alias(k) for k, v in scope.items()]), "purpose": purpose})
    requests = users.select(u.alias("request"), _text(u).alias("source_id"), "purpose", _at("2024-01-15").alias("as_of"), F.when(u % 13 == 0, _at("2024-01-14")).otherwise(_at("2024-01-20")).alias("now"), "scope")
    basis = F.coalesce(*[F.when(F.col("purpose") == p, F.lit(b)) for p, b in reviews.PURPOSES.items()])
    axis = _pick(AXES, n)
    told = e.join(users.select("user_id", "purpose", "scope"), "user_id").withColumn("scope", F.when(n % 23 == 0, F.col("scope").withField("feed", F.lit("other"))).otherwise(F.col("scope")))
    told = told.select(n.alias("review_id"), _text(u).alias("source_id"), axis.alias("axis"), "purpose", reviews.scope_digest("scope").alias("scope_sha256"), F.col("ts").alias("known_at"), (F.col("ts") + F.expr("INTERVAL 12 DAYS")).alias("expires_at"), F.when(n % 17 == 0, "deny").otherwise("allow").alias("decision"),
                       F.when(axis == "temporal", F.when(n % 29 == 0, "other").otherwise(basis)).alias("temporal_basis"), F.when(n % 19 == 0, _uses("storage")).otherwise(_uses("storage", "research")).alias("declared_rights"))
    grants = users.select(_text(u).alias("source_id"), _at("2024-01-01").alias("known_at"), _uses("storage", "research").alias("uses")).unionByName(users.where("user_id % 10 = 0").select(_text(u).alias("source_id"), _at("2024-01-18").alias("known_at"), _uses("storage").alias("uses")))
    sources = users.select(_text(u).alias("source_id"), F.when((u % 5 == 1) != (u % 43 == 0), "synthetic_fixture").otherwise("provider_reported").alias("origin"))
    listings = users.select(_text(u).alias("listing_id"), F.when(u % 37 == 0, "XNYS").otherwise("XNAS").alias("mic"))
    captured = users.where("text IS NOT NULL")
    available = F.when(u % 19 == 0, _at("2024-01-16")).otherwise(_at("2024-01-11")).alias("available_at")
    bars = captured.select(_text(u).alias("source_id"), F.concat(F.lit("b"), _text(u)).alias("import_id"), bar.cast("binary").alias("payload"), available, F.when(u % 17 == 0, _at("2024-01-05")).otherwise(_at("2024-01-10 12:00:00")).alias("received_at"), F.when(u % 23 == 0, 1).otherwise(0).alias("quarantined"), (u % 29 != 0).alias("page_complete"), F.lit("terminal_page").alias("pagination_state"), F.lit("iex").alias("feed"), F.lit("raw").alias("adjustment"), F.lit("1Day").alias("timeframe"), F.lit("America/New_York").alias("market_timezone"))
    calendars = captured.select(_text(u).alias("source_id"), F.concat(F.lit("c"), _text(u)).alias("import_id"), calendar.cast("binary").alias("payload"), available, F.lit(0).alias("quarantined"), F.when(u % 41 == 0, "SETTLEMENT").otherwise("TRADING").alias("calendar_kind"), F.lit("XNAS").alias("venue"), F.lit("2024-01-01").alias("start_date"), F.lit("2024-01-31").alias("end_date"), F.lit("America/New_York").alias("market_timezone"))
    day = e.where("event_type = 'click' AND ts < '2024-01-10'").select("user_id", F.to_date("ts").alias("day")).distinct()
    published = F.when(u % 2 == 0, F.col("day").cast("timestamp")).alias("published_at")
    bar_rows = day.select(_text(u).alias("source_id"), F.concat(F.lit("b"), _text(u)).alias("import_id"), _text(u).alias("listing_id"), _text("day").alias("date"), published)
    calendar_rows = day.where("NOT (user_id % 7 = 0 AND day = '2024-01-03')").select(_text(u).alias("source_id"), F.concat(F.lit("c"), _text(u)).alias("import_id"), _text("day").alias("date"), (F.col("day").cast("timestamp") + F.expr("INTERVAL 21 HOURS")).alias("end"), published)
    found = reviews.assess(requests, told, grants, sources, listings, bars, bar_rows, calendars, calendar_rows)
    return found.select("request", "eligible", F.array_join("reasons", ",").alias("reasons"))


def _user_bars(spark, d):
    return rules.daily_bars(read(spark, d, "events"), "user_id", "ts", "value", "event_id")


def bundle_prepare(spark, d):
    """Each user's days as a bundle: prices are those of their events, sessions and expected days leave some out."""
    days, date = _user_bars(spark, d), _text("day").alias("date")
    hours = lambda n: F.col("day").cast("timestamp") + F.expr(f"INTERVAL {n} MINUTES")
    prices = days.select(F.col("user_id").alias("bundle"), date, hours(22 * 60).alias("known_at"), F.lit("USD").alias("currency"), *[_text(c).alias(c) for c in ("open", "high", "low", "close", "volume")])
    sessions = days.where("NOT (user_id % 7 = 0 AND dayofmonth(day) % 5 = 0)").select(F.col("user_id").alias("bundle"), date, hours(21 * 60).alias("known_at"), hours(14 * 60 + 30).alias("start"), hours(21 * 60).alias("end"))
    expected = days.where("NOT (user_id % 11 = 0 AND dayofmonth(day) % 4 = 0)").select(F.col("user_id").alias("bundle"), date, F.when(F.col("user_id") % 13 == 0, "EUR").otherwise("USD").alias("currency"))
    found = bundles.prepare(prices, sessions, expected, _at("2024-01-20 22:00:00"))
    return found.select("bundle", "date", F.coalesce("reason", F.lit("")).alias("reason"), "available_at", "close")


def _bundle(spark, d):
    day = _text("day")
    available = F.concat(day, F.when(F.col("user_id") % 8 == 0, "T20:00:00Z").otherwise("T22:00:00Z"))
    texts = {"date": day, "start": F.concat(day, F.lit("T14:30:00Z")), "end": F.concat(day, F.lit("T21:00:00Z")), "currency": F.lit("USD"), **{c: _text(c) for c in ("open", "high", "low", "close", "volume")}, "available_at": available}
    return _user_bars(spark, d).select(F.col("user_id").alias("bundle"), *[v.alias(k) for k, v in texts.items()])


def bundle_lines(spark, d):
    """Lines of each user's bundle, some cut short or changed, under a header; the manifest of some bundles was changed."""
    bars = _bundle(spark, d).where("low > '0'")
    on = F.dayofmonth(F.col("date").cast("date"))
    manifest = bundles.digests(bars).withColumn("sha256", F.when((F.col("bundle") % 9 == 0) & (on == 5), "x").otherwise(F.col("sha256")))
    cells = [F.when(on % 6 == 1, F.concat(c, F.lit("0"))).otherwise(F.col(c)) if c == "close" else F.col(c) for c in bundles.FIELDS]
    line = F.when(on % 6 == 0, F.concat_ws(",", *cells[:-1])).otherwise(F.concat_ws(",", *cells))
    lines = bars.select("bundle", F.col("date").alias("of"), line.alias("line")).unionByName(bars.select("bundle").distinct().select("bundle", F.lit("").alias("of"), F.lit(",".join(bundles.FIELDS)).alias("line")))
    found = bundles.read_lines(lines, bars, manifest, bars.select("bundle").distinct().withColumn("currency", F.lit("USD")))
    return found.select("bundle", "of", "header", F.unix_seconds("event_time").alias("event_time"), F.coalesce("reason", F.lit("")).alias("reason"))


def frozen_reports(spark, d):
    """Each user's days as a frozen inspection; some were altered after they were frozen."""
    u, on = F.col("report"), F.dayofmonth("day")
    days = _user_bars(spark, d).withColumnRenamed("user_id", "report").withColumn("index", F.row_number().over(Window.partitionBy("report").orderBy("day")) - 1)
    hours = lambda n: F.col("day").cast("timestamp") + F.expr(f"INTERVAL {n} HOURS")
    rows = days.select("report", "day", "index", _text("day").alias("economic_date"), _text("report").alias("listing_id"), F.lit("USD").alias("currency"), hours(14).alias("calendar_start"), hours(21).alias("calendar_end"), F.lit(None).cast("timestamp").alias("published_at"), hours(23).alias("available_at"), hours(22).alias("price_received_at"), hours(23).alias("price_processed_at"), hours(21).alias("calendar_processed_at"), *[_text(c).alias(c) for c in ("open", "high", "low", "close", "volume")])
    frozen = bundles.report_digest(rows)
    altered = {"index": F.when(u % 7 == 0, F.col("index") + 1).otherwise(F.col("index")), "currency": F.when((u % 11 == 0) & (on == 3), "EUR").otherwise(F.col("currency")), "price_received_at": F.when((u % 13 == 0) & (on == 9), hours(20)).otherwise(F.col("price_received_at")), "economic_date": F.when((u % 17 == 0) & (on == 1), "2024-1-1").otherwise(F.col("economic_date"))}
    heads = frozen.select("report", _text("report").alias("listing_id"), F.lit("USD").alias("currency"), F.when(u % 19 == 0, _at("2024-01-20")).otherwise(_at("2030-01-01")).alias("checked_at"), F.lit(True).alias("inspection_only"), *[((u % 23 == 0) if n == "live_trading" else F.lit(False)).alias(n) for n in bundles.UNVERIFIED], "sha256")
    groups = rows.select("report", F.when((u % 29 == 0) & (on == 2), hours(24)).otherwise(F.col("available_at")).alias("available_at"), "index")
    found = bundles.report_faults(heads, rows.withColumns(altered), groups)
    return found.select("report", F.array_join("faults", ",").alias("faults"))


def exact_valuation(spark, d):
    """A holding of each user's bars through a split of five decimals, one of 3 to 2, and two dividends."""
    on = lambda *days: F.col("day").isin(*[F.lit(x).cast("date") for x in days])
    a, b, paid = on("2024-01-10"), on("2024-01-20"), on("2024-01-05", "2024-01-15")
    days = _user_bars(spark, d).select("user_id", "day", "close", F.when(a, "1.00001").when(b, "3").alias("new_shares"), F.when(a, "1").when(b, "2").alias("old_shares"), F.when(paid, "0.125").alias("dividend"), F.when(paid, F.date_add("day", 6)).alias("payment_date"))
    found = corporate.exact_valuation(days, "user_id", "1000", "100")
    return found.select("user_id", "day", *[_text(F.col(c).cast("decimal(38,10)")).alias(c) for c in ("shares", "cash", "receivable", "wealth")], F.coalesce("error", F.lit("")).alias("error"))


def _snapshot(rows, kind, target, body, known="1992-01-01", start="1992-01-01", end=None):
    """Rows as snapshots of a kind, all of one span and time of knowledge."""
    name = F.concat_ws("|", F.lit(kind), target, F.lit(known), F.lit(start))
    return rows.select(F.lit(kind).alias("kind"), target.alias("target"), _at(start).alias("valid_from"), (F.lit(None).cast("timestamp") if end is None else end).alias("valid_to"), _at(known).alias("known_at"), name.alias("snapshot_id"), F.to_json(F.struct(*[v.alias(k) for k, v in body.items()])).alias("body"))


def _terms(nations):
    """Terms of each nation's contract: some are found to be settled physically in 1997."""
    n = F.col("n_nationkey")
    body = lambda settlement: {"tick_size": F.when(n % 5 == 1, "0.25").otherwise("0.01"), "multiplier": F.lit("50"), "settlement": settlement, "last_trade_at": F.lit("1998-06-01T00:00:00Z"), "entry_cutoff_at": F.lit("1998-01-01T00:00:00Z")}
    known = nations.where("n_nationkey <> 7")
    return _snapshot(known, "terms", references.target("n_nationkey"), body(F.lit("cash"))).unionByName(_snapshot(known, "terms", references.target("n_nationkey"), body(F.when(n % 4 == 0, "physical").otherwise("cash")), known="1997-01-01"))


def intent_preview(spark, d):
    """Orders as opening intents of their customer's contract, all four references looked up at the order's date."""
    o, nations, regions = read(spark, d, "orders"), read(spark, d, "nation"), read(spark, d, "region")
    k, c, n = F.col("o_orderkey"), F.col("c_custkey"), F.col("n_nationkey")
    at = F.col("o_orderdate").cast("timestamp")
    customers = read(spark, d, "customer").where("c_custkey % 11 <> 0")
    broker = F.lit("b")
    snapshots = _snapshot(customers, "binding", references.target(broker, "c_custkey"), {"contract_id": _text("c_nationkey")}, end=F.when(c % 13 == 0, _at("1996-01-01")))
    sessions = F.array(*[F.struct(F.lit(a).alias("opens_at"), F.lit(b).alias("closes_at")) for a, b in (("1992-01-01T00:00:00Z", "1995-06-01T00:00:00Z"), ("1996-01-01T00:00:00Z", "1999-01-01T00:00:00Z"))])
    margin = {"initial": F.lit("4000"), "maintenance": F.lit("3500"), "currency": F.when(n % 9 == 0, "EUR").otherwise("USD")}
    name = references.target(broker, F.lit("a"), "n_nationkey")
    for more in (_terms(nations), _snapshot(regions.where("r_regionkey <> 2"), "schedule", references.target("r_regionkey"), {"sessions": sessions}), _snapshot(nations.where("n_nationkey <> 10"), "margin", name, margin), _snapshot(nations.where("n_nationkey % 6 = 5"), "margin", name, margin, start="1992-01-02")):
        snapshots = snapshots.unionByName(more)
    contracts = nations.where("n_nationkey <> 3").select(_text("n_nationkey").alias("contract_id"), F.col("n_regionkey").alias("product_id"), F.lit("USD").alias("quote_currency"))
    intents = o.select(k.alias("intent_id"), broker.alias("broker"), F.lit("a").alias("account"), _text("o_custkey").alias("identifier"), at.alias("decision_at"), (k % 50).alias("quantity"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"), F.when(k % 17 == 0, "continuous").otherwise("raw_contract").alias("price_kind"), F.lit("a").alias("collateral_account"), at.alias("observed_at"), F.when(k % 19 == 0, at).otherwise(at + F.expr("INTERVAL 1 DAY")).alias("expires_at"), F.lit(100000).cast("decimal(18,4)").alias("available"), F.lit("USD").alias("currency"))
    found = references.previewed(intents, contracts, snapshots, 40, "500000000", "1.25", False)
    return found.select("intent_id", F.coalesce("reason", F.lit("accepted")).alias("reason"), _text(F.col("notional").cast("decimal(38,2)")).alias("notional"))


def draft_references(spark, d):
    """Orders as limit orders of their customer's account: what the account may do, its instrument and its terms are looked up."""
    o, k, c = read(spark, d, "orders"), F.col("o_orderkey"), F.col("c_custkey")
    customers, nations = read(spark, d, "customer"), read(spark, d, "nation")
    rule = lambda kind, fractional: F.struct(F.lit(kind).alias("asset_kind"), F.lit("day").alias("time_in_force"), F.lit("regular").alias("session"), fractional.alias("fractional_quantity"))
    equity, future = rule("equity", c % 3 == 0), rule("future", F.lit(False))
    snapshots = _terms(nations).unionByName(_snapshot(customers.where("c_custkey % 17 <> 0"), "capabilities", references.target("c_custkey"), {"prepare_enabled": c % 10 != 0, "rules": F.when(c % 12 == 5, F.array(equity)).otherwise(F.array(equity, future))}))
    held = customers.where("c_custkey % 19 <> 0")
    for kind in ("equity", "future"):
        native = F.concat(F.when(c % 7 == 0, "n").otherwise(kind), _text("c_nationkey"))
        body = {"native_id": native, "symbol": F.concat(F.lit(kind), _text("c_nationkey")), "venue_mic": F.lit("XNAS"), "currency": F.lit("USD"), "price_tick": F.lit("0.05"), "quantity_step": F.lit("0.5"), "minimum_quantity": F.lit("1")}
        snapshots = snapshots.unionByName(_snapshot(held, "instrument", references.target("c_custkey", F.lit(kind), "c_nationkey"), body))
    at = F.col("o_orderdate").cast("timestamp")
    rows = o.join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == c)
    intents = rows.select(k.alias("intent_id"), _text("o_custkey").alias("account"), F.when(k % 13 == 0, "live").otherwise("paper").alias("environment"), F.when(F.col("o_orderpriority").startswith("1"), "future").otherwise("equity").alias("asset_kind"), _text("c_nationkey").alias("internal_id"), at.alias("decision_at"), F.when(k % 7 == 0, at).otherwise(at + F.expr("INTERVAL 1 DAY")).alias("valid_until"), at.alias("prepared_at"), F.lit("raw_contract").alias("price_kind"), F.when(k % 23 == 0, "ioc").otherwise("day").alias("time_in_force"), F.lit("regular").alias("session"), ((k % 9).cast("decimal(18,6)") / 2).alias("quantity"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    return references.prepared(intents, snapshots).select("intent_id", F.coalesce("reason", F.lit("prepared")).alias("reason"), F.coalesce(F.size("snapshot_ids"), F.lit(0)).alias("snapshots"))


def import_retries(spark, d):
    """Orders as imports, two ids an import; every seventh id was taken before, some by an older version or with another request."""
    o, k, c = read(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    received = F.col("o_orderdate").cast("timestamp")
    rows = o.select(_text("o_custkey").alias("source_id"), _text(F.floor(k / 2)).alias("import_id"), F.lit("3").alias("version"), F.when(k % 37 != 0, F.col("o_orderpriority").cast("binary")).otherwise(F.lit(b"")).alias("payload"), received.alias("received_at"), F.when(k % 41 == 0, received - F.expr("INTERVAL 1 DAY")).otherwise(received + F.expr("INTERVAL 1 HOUR")).alias("processed_at"), F.lit("{}").alias("request"), k.alias("k"))
    taken = rows.where("CAST(import_id AS bigint) % 7 = 0").groupBy("source_id", "import_id").agg(F.min(F.struct("k", F.sha2("payload", 256).alias("raw_sha256"), "received_at", "processed_at")).alias("r"))
    taken = taken.select("source_id", "import_id", F.when(F.col("r.k") % 5 == 0, "1").otherwise("2").alias("version"), "r.raw_sha256", "r.received_at", "r.processed_at", F.when(F.col("r.k") % 3 == 0, "[]").otherwise("{}").alias("request"))
    customers = read(spark, d, "customer")
    grants = customers.select(_text("c_custkey").alias("source_id"), _at("1992-06-01").alias("known_at"), F.when(F.col("c_custkey") % 10 == 0, _uses("storage")).otherwise(_uses("storage", "research")).alias("uses"))
    found = imports.attempts(taken, rows, grants, ["2", "3"])
    return found.select("k", "outcome", F.coalesce("kept_version", F.lit("")).alias("version"), F.coalesce("reason", F.lit("")).alias("reason"))


def job_resumption(spark, d):
    """Orders as jobs, their line numbers as journal pages; some journals, results and requests were changed."""
    o, line, k = read(spark, d, "orders"), read(spark, d, "lineitem"), F.col("job_id")
    pages = line.groupBy(F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") - 1).cast("long").alias("page")).agg(F.sum("l_partkey").alias("n")).where("NOT (job_id % 11 = 0 AND page = 1)")
    body = _text("n")
    pages = pages.select("job_id", "page", body.alias("body"), F.when((k % 13 == 0) & (F.col("page") == 0), "x").otherwise(F.sha2(body, 256)).alias("sha256"), F.when(F.col("n") % 4 != 0, body).alias("next_token"))
    jobs = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 17 == 0, "old").otherwise("asked").alias("request"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    results = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).cast("timestamp").alias("available_at"))
    stated = pages.where("job_id % 3 = 0 AND NOT (job_id % 19 = 0 AND page = 0)").select("job_id", "page", "sha256")
    found = imports.resumption(o.select(F.col("o_orderkey").alias("job_id"), F.lit("asked").alias("request")), jobs, pages, results, stated, _at("1998-01-01"))
    return found.select("job_id", "action", "next_page", F.coalesce("token", F.lit("")).alias("token"))


def native_bindings(spark, d):
    """Line items as a broker's names for parts: their currency, venue and lots are held against the part."""
    line, part, n = read(spark, d, "lineitem"), read(spark, d, "part"), F.col("l_partkey")
    kind = lambda key: F.when(key % 3 == 0, "future").otherwise("equity")
    targets = part.where("p_partkey % 13 <> 0").select(kind(F.col("p_partkey")).alias("asset_kind"), _text("p_partkey").alias("internal_id"), F.lit("USD").alias("currency"), F.when(F.col("p_size") % 2 == 0, "XNAS").otherwise("XNYS").alias("venue_mic"))
    venue = line.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey", "left")
    bindings = venue.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", kind(n).alias("asset_kind"), _text("l_partkey").alias("internal_id"), F.when(F.col("l_suppkey") % 23 == 0, " ").otherwise(_text("l_suppkey")).alias("native_id"), F.lit("s").alias("symbol"), F.when(F.col("l_orderkey") % 29 == 0, "EUR").otherwise("USD").alias("currency"), F.when((F.col("p_size") % 2 == 0) != (F.col("l_orderkey") % 31 == 0), "XNAS").otherwise("XNYS").alias("venue_mic"), _text(F.col("l_linenumber") - 1).alias("price_tick"), F.when(F.col("l_linenumber") == 3, "0.5").otherwise("1").alias("quantity_step"), F.lit("1").alias("minimum_quantity"))
    return imports.native_faults(bindings, targets).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("reason", F.lit("")).alias("reason"))


def snapshot_evidence(spark, d):
    """Line items as snapshots that rest on their order, as evidence of the order's customer."""
    line, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    evidence = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("evidence_id"), (F.col("o_custkey") % 5).alias("source_id"), F.col("o_orderdate").cast("timestamp").alias("received_at"), F.sha2(_text("o_totalprice"), 256).alias("sha256"))
    rows = line.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"), "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").alias("evidence_id"), F.when(F.col("l_linenumber") == 5, -1).otherwise(F.col("o_custkey") % 5).alias("source_id"), F.when(F.col("l_partkey") % 9 == 0, F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("l_shipdate")).cast("timestamp").alias("known_at"))
    found = imports.beside_evidence(rows, evidence)
    return found.groupBy(F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("evidence_source", F.lit(-9)).cast("long").alias("source")).agg(F.count("*").alias("n"), F.count_distinct("raw_sha256").alias("payloads"))


def set_relations(spark, d):
    """For each user, the days with views beside the days with clicks."""
    e = read(spark, d, "events").withColumn("day", F.to_date("ts"))
    return imports.set_relations(e.where("event_type = 'view' AND user_id % 3 <> 0"), e.where("event_type = 'click'"), "user_id", "day")


QUERIES = {f.__name__: f for f in (review_record, capture_review, bundle_prepare, bundle_lines, frozen_reports, exact_valuation, intent_preview, draft_references, import_retries, job_resumption, native_bindings, snapshot_evidence, set_relations)}

_BARS = """b AS (SELECT user_id, ts::DATE AS day, arg_min(value::DECIMAL(18,2), (ts, event_id)) AS open, max(value::DECIMAL(18,2)) AS high,
  min(value::DECIMAL(18,2)) AS low, arg_max(value::DECIMAL(18,2), (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL)"""

SQL = {
    "review_record": """WITH o AS (SELECT *, o_orderkey AS k, o_custkey AS c, o_orderkey % 4 AS axis FROM orders),
  r AS (SELECT o.*, CASE WHEN k % 43 = 0 THEN 'required_text_missing' WHEN k % 31 = 0 THEN 'invalid_scope_interval_or_feed' WHEN k % 37 = 0 THEN 'availability_is_not_recording_time' WHEN k % 41 = 0 THEN 'expiry_not_after_availability'
    WHEN k % 59 = 0 THEN 'temporal_basis_of_temporal_reviews_only' WHEN k % 47 = 0 THEN 'unique_evidence_required' WHEN p.c_custkey IS NULL OR c % 10 = 0 OR (c % 10 = 1 AND o_orderdate >= '1996-01-01') THEN 'use_not_permitted'
    WHEN k % 53 = 0 OR o_orderdate < '1994-01-01' THEN 'evidence_unknown_or_late' WHEN c % 29 = 0 THEN 'evidence_digest_differs' END AS reason FROM o LEFT JOIN customer p ON c = p.c_custkey),
  s AS (SELECT *, reason IS NULL AND k % 61 = 0 AND k % 122 <> 0 AS old, count(*) FILTER (reason IS NULL) OVER (PARTITION BY c, axis, k % 3, o_orderdate) AS n FROM r)
  SELECT k::VARCHAR AS review_id, CASE WHEN old THEN 'same' WHEN reason IS NULL AND k % 122 <> 0 AND n = 1 THEN 'new' ELSE 'refused' END AS outcome,
  CASE WHEN reason IS NOT NULL THEN reason WHEN old THEN '' WHEN k % 122 = 0 THEN 'review_changed' WHEN n > 1 THEN 'another_review_at_this_time' ELSE '' END AS reason FROM s""",
    "capture_review": """WITH e AS (SELECT *, ['rights', 'provenance', 'temporal', 'coverage'][event_id % 4 + 1] AS axis FROM events),
  t AS (SELECT unnest(['2024-01-15'::TIMESTAMP, '2024-01-20'::TIMESTAMP]) AS t),
  a AS (SELECT user_id AS u, axis, t, arg_max(event_id % 17 <> 0 AND ts + INTERVAL 12 DAY > t AND (axis <> 'rights' OR event_id % 19 <> 0), (ts, event_id)) AS ok, arg_max(axis <> 'temporal' OR event_id % 29 <> 0, (ts, event_id)) AS basis
    FROM e CROSS JOIN t WHERE ts <= t AND event_id % 23 <> 0 GROUP BY ALL),
  u AS (SELECT DISTINCT user_id AS u FROM events),
  x AS (SELECT u.u, g.axis, count(*) FILTER (a.ok) = 2 AS ok, count(*) FILTER (a.basis OR g.axis <> 'temporal') AS nb FROM u CROSS JOIN (SELECT unnest(['rights', 'provenance', 'temporal', 'coverage']) AS axis) g LEFT JOIN a ON a.u = u.u AND a.axis = g.axis GROUP BY u.u, g.axis),
  m AS (SELECT u, list(axis || '_review_missing_denied_or_expired') FILTER (NOT ok) AS missing, bool_and(axis <> 'temporal' OR nb = 2) AS basis FROM x GROUP BY 1),
  c AS (SELECT user_id AS u, count(DISTINCT ts::DATE) AS bars, count(DISTINCT ts::DATE) FILTER (NOT (user_id % 7 = 0 AND ts::DATE = '2024-01-03')) AS days, max(ts::DATE) FILTER (NOT (user_id % 7 = 0 AND ts::DATE = '2024-01-03')) AS last FROM events WHERE event_type = 'click' AND ts < '2024-01-10' GROUP BY 1),
  f AS (SELECT m.*, c.bars, c.days, c.last, d.doc_id IS NOT NULL AND m.u % 19 <> 0 AS there FROM m LEFT JOIN c USING (u) LEFT JOIN documents d ON d.doc_id = m.u),
  r AS (SELECT u, CASE WHEN u % 13 = 0 THEN ['current_cutoff_before_historical_cutoff'] WHEN u % 10 = 0 THEN ['use_not_permitted'] ELSE list_sort(list_concat(coalesce(missing, []), list_filter([
    CASE WHEN NOT there THEN 'capture_unavailable_at_cutoff' END, CASE WHEN there AND u % 11 = 0 THEN 'capture_hash_mismatch' END, CASE WHEN there AND u % 23 = 0 THEN 'quarantined_capture_rows' END, CASE WHEN there AND u % 29 = 0 THEN 'unresolved_price_pages' END,
    CASE WHEN there AND (u % 37 = 0 OR u % 31 = 0) THEN 'identity_or_feed_scope_mismatch' END, CASE WHEN there AND u % 41 = 0 THEN 'calendar_request_scope_mismatch' END, CASE WHEN there AND NOT coalesce(days > 0 AND days = bars, false) THEN 'price_calendar_date_coverage_mismatch' END,
    CASE WHEN there AND u % 17 = 0 AND last + INTERVAL 21 HOUR > '2024-01-05' THEN 'daily_bar_not_complete_at_observation' END, CASE WHEN there AND u % 17 <> 0 AND last + INTERVAL 21 HOUR > '2024-01-10 12:00:00' THEN 'daily_bar_not_complete_at_observation' END, CASE WHEN there AND u % 5 = 0 AND u % 2 = 1 AND bars > 0 THEN 'historical_publication_or_vintage_unknown' END,
    CASE WHEN there AND NOT basis THEN 'temporal_review_basis_mismatch' END, CASE WHEN u % 5 <> 1 AND u % 43 = 0 THEN 'provider_origin_required_for_real_use' END, CASE WHEN u % 5 = 1 AND u % 43 = 0 THEN 'synthetic_origin_required_for_fixture_validation' END], lambda q: q IS NOT NULL))) END AS reasons FROM f)
  SELECT u AS request, len(reasons) = 0 AS eligible, array_to_string(reasons, ',') AS reasons FROM r""",
    "bundle_prepare": f"""WITH {_BARS}, f AS (SELECT *, day <= '2024-01-20' AS known, NOT (user_id % 7 = 0 AND day(day) % 5 = 0) AS open_, NOT (user_id % 11 = 0 AND day(day) % 4 = 0) AS wanted FROM b)
  SELECT user_id AS bundle, day::VARCHAR AS date, CASE WHEN NOT wanted THEN 'not_expected' WHEN NOT known THEN 'price_missing' WHEN NOT open_ THEN 'session_missing' WHEN user_id % 13 = 0 THEN 'currency_differs' WHEN low <= 0 THEN 'price_not_positive' ELSE '' END AS reason,
  CASE WHEN known THEN strftime(day + INTERVAL 22 HOUR, '%Y-%m-%dT%H:%M:%S.%fZ') WHEN open_ AND day::TIMESTAMP + INTERVAL 21 HOUR <= '2024-01-20 22:00:00' THEN strftime(day + INTERVAL 21 HOUR, '%Y-%m-%dT%H:%M:%S.%fZ') END AS available_at,
  CASE WHEN known THEN close::VARCHAR END AS close FROM f WHERE known OR wanted""",
    "bundle_lines": f"""WITH {_BARS}, f AS (SELECT *, bool_or(user_id % 8 = 0 OR low <= 0 OR (user_id % 9 = 0 AND day(day) = 5)) OVER (PARTITION BY user_id) AS wrong FROM b WHERE low::VARCHAR > '0'),
  r AS (SELECT *, CASE WHEN wrong THEN 'bundle_not_verified' WHEN day(day) % 6 = 0 THEN 'unexpected_fields' WHEN day(day) % 6 = 1 THEN 'not_in_bundle' ELSE '' END AS reason FROM f)
  SELECT user_id AS bundle, day::VARCHAR AS of, false AS header, CASE WHEN reason = '' THEN epoch(day + INTERVAL 22 HOUR)::BIGINT END AS event_time, reason FROM r UNION ALL SELECT DISTINCT user_id, '', true, NULL::BIGINT, '' FROM r""",
    "frozen_reports": f"""WITH {_BARS}, r AS (SELECT *, user_id AS u, day(day) AS d, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS nxt FROM b),
  f AS (SELECT u, bool_or(low <= 0) AS price, bool_or(u % 11 = 0 AND d = 3) AS cur, bool_or(u % 13 = 0 AND d = 9) AS rec, bool_or(u % 17 = 0 AND d = 1) AS dat, bool_or(u % 17 = 0 AND d = 1 AND nxt IS NOT NULL) AS inc, bool_or(u % 19 = 0 AND day + INTERVAL 23 HOUR > '2024-01-20') AS late, bool_or(u % 29 = 0 AND d = 2) AS grp FROM r GROUP BY u)
  SELECT u AS report, array_to_string(list_sort(list_filter([CASE WHEN price THEN 'price_not_positive' END, CASE WHEN cur THEN 'listing_or_currency_differs' END, CASE WHEN rec THEN 'received_before_close' END, CASE WHEN dat THEN 'date_not_canonical' END, CASE WHEN inc THEN 'dates_not_increasing' END, CASE WHEN late THEN 'available_after_check' END,
    CASE WHEN u % 7 = 0 THEN 'index_not_dense' END, CASE WHEN u % 23 = 0 THEN 'flags_differ' END, CASE WHEN u % 7 = 0 OR cur OR rec OR dat THEN 'digest_differs' END, CASE WHEN u % 7 = 0 OR grp THEN 'groups_differ' END], lambda x: x IS NOT NULL)), ',') AS faults FROM f""",
    "exact_valuation": f"""WITH {_BARS}, s AS (SELECT *, (CASE WHEN count(*) FILTER (day = '2024-01-10') OVER w > 0 THEN 100.001 ELSE 100.000 END * CASE WHEN count(*) FILTER (day = '2024-01-20') OVER w > 0 THEN 1.5 ELSE 1.0 END)::DECIMAL(18,6) AS shares, day IN ('2024-01-05', '2024-01-15') AS pays FROM b WINDOW w AS (PARTITION BY user_id ORDER BY day)),
  v AS (SELECT s.user_id, s.day, s.close, s.shares, coalesce(sum((t.shares * 0.125)::DECIMAL(18,9)), 0)::DECIMAL(28,10) AS owed, coalesce(sum((t.shares * 0.125)::DECIMAL(18,9)) FILTER (t.day + 6 <= s.day), 0)::DECIMAL(28,10) AS got FROM s LEFT JOIN s t ON t.user_id = s.user_id AND t.pays AND t.day <= s.day GROUP BY ALL)
  SELECT user_id, day, shares::DECIMAL(38,10)::VARCHAR AS shares, (1000 + got)::DECIMAL(38,10)::VARCHAR AS cash, (owed - got)::DECIMAL(38,10)::VARCHAR AS receivable, (1000 + owed + (shares * close)::DECIMAL(28,10))::DECIMAL(38,10)::VARCHAR AS wealth, '' AS error FROM v""",
    "intent_preview": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, o_orderkey % 50 AS q, o_totalprice::DECIMAL(12,2) AS p, c_nationkey AS n, n_regionkey AS r FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey),
  f AS (SELECT *, CASE WHEN q = 0 THEN 'invalid_quantity' WHEN k % 17 = 0 THEN 'adjusted_price' WHEN k % 19 = 0 THEN 'collateral_stale' WHEN n IS NULL OR c % 11 = 0 OR (c % 13 = 0 AND d >= '1996-01-01') THEN 'binding_unknown' WHEN n = 3 THEN 'contract_unknown' WHEN n = 7 THEN 'terms_unknown'
  WHEN d >= '1998-01-01' THEN 'past_entry_cutoff' WHEN n % 4 = 0 AND d >= '1997-01-01' THEN 'physical_delivery' WHEN n % 5 = 1 AND p % 0.25 <> 0 THEN 'off_tick' WHEN r = 2 THEN 'schedule_unknown' WHEN d >= '1995-06-01' AND d < '1996-01-01' THEN 'session_closed'
  WHEN n % 6 = 5 THEN 'margin_ambiguous' WHEN n = 10 THEN 'margin_unknown' WHEN n % 9 = 0 THEN 'cross_currency' WHEN q > 40 THEN 'intent_limit' WHEN p * 50 * q > 500000000 OR 5000 * q > 100000 THEN 'notional_or_collateral' ELSE 'accepted' END AS reason FROM o)
  SELECT k AS intent_id, reason, CASE WHEN reason = 'accepted' THEN (p * 50 * q)::DECIMAL(38,2)::VARCHAR END AS notional FROM f""",
    "draft_references": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, (o_orderkey % 9)::DECIMAL(18,6) / 2 AS q, o_totalprice::DECIMAL(12,2) AS p, c_nationkey AS n, o_orderpriority[1] = '1' AS fut FROM orders JOIN customer ON c_custkey = o_custkey),
  f AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'live_disabled' WHEN k % 7 = 0 THEN 'not_known_or_expired' WHEN c % 17 = 0 THEN 'capabilities_unknown' WHEN c % 10 = 0 THEN 'preparation_disabled' WHEN k % 23 = 0 OR (fut AND c % 12 = 5) THEN 'unsupported_combination'
  WHEN c % 19 = 0 THEN 'instrument_unknown' WHEN c % 7 = 0 THEN 'ambiguous_native_identity' WHEN q < 1 OR ((fut OR c % 3 <> 0) AND q <> floor(q)) THEN 'lot_or_fraction' WHEN p % 0.05 <> 0 THEN 'off_tick' WHEN fut AND n = 7 THEN 'terms_unknown' WHEN fut AND n % 5 = 1 AND p % 0.25 <> 0 THEN 'off_tick_of_terms'
  WHEN fut AND (d >= '1998-01-01' OR (n % 4 = 0 AND d >= '1997-01-01')) THEN 'outside_settlement_or_entry' ELSE 'prepared' END AS reason FROM o)
  SELECT k AS intent_id, reason, CASE WHEN reason <> 'prepared' THEN 0 WHEN fut THEN 3 ELSE 2 END::INT AS snapshots FROM f""",
    "import_retries": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey // 2 AS i, o_orderdate AS d, CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE o_orderpriority END AS p, o_orderkey % 41 = 0 AS back FROM orders),
  r AS (SELECT o.*, CASE WHEN p = '' THEN 'payload_required' WHEN back THEN 'processed_before_receipt' WHEN c_custkey IS NULL OR c % 10 = 0 OR d < '1992-06-01' THEN 'use_not_permitted' END AS wrong, first_value({'k': k, 'p': p, 'd': d, 'back': back}) OVER (PARTITION BY c, i ORDER BY k) AS f FROM o LEFT JOIN customer ON c_custkey = c),
  g AS (SELECT *, count(DISTINCT (p, d)) FILTER (wrong IS NULL) OVER (PARTITION BY c, i) AS n FROM r),
  h AS (SELECT *, i % 7 = 0 AS old, CASE WHEN wrong IS NOT NULL THEN wrong WHEN i % 7 = 0 AND f.k % 5 = 0 THEN 'unsupported_archived_version' WHEN i % 7 = 0 AND (f.k % 3 = 0 OR f.p <> p OR f.d <> d OR f.back) THEN 'import_id_of_changed_input' WHEN i % 7 <> 0 AND n > 1 THEN 'import_id_of_changed_input' ELSE '' END AS reason FROM g)
  SELECT k, CASE WHEN reason <> '' THEN 'refused' WHEN old THEN 'retried' ELSE 'new' END AS outcome, CASE WHEN reason <> '' THEN '' WHEN old THEN '2' ELSE '3' END AS version, reason FROM h""",
    "job_resumption": """WITH p AS (SELECT l_orderkey AS k, l_linenumber - 1 AS page, sum(l_partkey)::BIGINT AS n FROM lineitem WHERE NOT (l_orderkey % 11 = 0 AND l_linenumber = 2) GROUP BY ALL),
  j AS (SELECT k, count(*) AS c, min(page) AS a, max(page) AS b, arg_max(n, page) AS last, bool_or(page = 0) AS zero FROM p GROUP BY k),
  x AS (SELECT o_orderkey AS k, o_orderdate AS d, c, last, o_orderkey % 3 = 0 AS done, CASE WHEN o_orderkey % 5 = 0 THEN 'start' WHEN o_orderkey % 17 = 0 THEN 'request_changed' WHEN o_orderdate > '1998-01-01' OR (o_orderkey % 3 = 0 AND o_orderdate + INTERVAL 30 DAY > '1998-01-01') THEN 'not_yet_available'
    WHEN c IS NOT NULL AND (a <> 0 OR b <> c - 1 OR (o_orderkey % 13 = 0 AND zero)) THEN 'journal_altered' WHEN o_orderkey % 3 = 0 AND o_orderkey % 19 = 0 AND zero THEN 'result_differs' WHEN o_orderkey % 3 = 0 THEN 'finished' WHEN c IS NOT NULL AND last % 4 = 0 THEN 'ended' ELSE 'resume' END AS action FROM orders LEFT JOIN j ON k = o_orderkey)
  SELECT k AS job_id, action, CASE action WHEN 'start' THEN 0 WHEN 'resume' THEN coalesce(c, 0) END::BIGINT AS next_page, CASE WHEN action = 'resume' THEN coalesce(last::VARCHAR, '') ELSE '' END AS token FROM x""",
    "native_bindings": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 23 = 0 THEN 'required_text_missing' WHEN p_partkey IS NULL OR p_partkey % 13 = 0 THEN 'unknown_target' WHEN l_orderkey % 29 = 0 OR l_orderkey % 31 = 0 THEN 'currency_or_venue_differs'
  WHEN l_linenumber = 1 THEN 'amounts_not_positive' WHEN l_partkey % 3 = 0 AND l_linenumber = 3 THEN 'fractional_lots_of_a_future' ELSE '' END AS reason FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""",
    "snapshot_evidence": """SELECT CASE WHEN l_orderkey % 7 = 0 THEN 'evidence_unknown' WHEN l_linenumber = 5 THEN 'evidence_of_another_source' WHEN l_partkey % 9 = 0 OR l_shipdate < o_orderdate THEN 'known_before_receipt' ELSE '' END AS reason, CASE WHEN l_orderkey % 7 = 0 THEN -9 ELSE o_custkey % 5 END::BIGINT AS source,
  count(*) AS n, count(DISTINCT CASE WHEN l_orderkey % 7 <> 0 THEN o_totalprice END) AS payloads FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""",
    "set_relations": """WITH m AS (SELECT user_id, ts::DATE AS day, bool_or(event_type = 'view' AND user_id % 3 <> 0) AS l, bool_or(event_type = 'click') AS r FROM events GROUP BY ALL),
  s AS (SELECT user_id, count(*) FILTER (l AND NOT r) AS only_left, count(*) FILTER (r AND NOT l) AS only_right, count(*) FILTER (l AND r) AS "both" FROM m WHERE l OR r GROUP BY 1)
  SELECT *, CASE WHEN only_left = 0 AND only_right = 0 THEN 'equal' WHEN only_left = 0 THEN 'subset' WHEN only_right = 0 THEN 'superset' WHEN "both" = 0 THEN 'disjoint' ELSE 'overlapping' END AS relation FROM s""",
}
