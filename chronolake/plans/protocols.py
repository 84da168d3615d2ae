"""Queries over capture jobs, packets, frozen protocols, costs and sessions, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.functions import times
from chronolake.operators import futures, jobs, trials
from chronolake.sources import read

AS_OF = "1998-06-17"


def _at(day: str):
    return F.lit(f"{day} 00:00:00").cast("timestamp")


def paged_jobs(spark, d):
    """Orders as jobs, their line numbers as pages, their lines as captured rows."""
    line = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("page"), "l_partkey", "l_quantity", "l_shipdate", "l_returnflag")
    pages = line.groupBy(F.col("l_orderkey").alias("job_id"), "page").agg(F.sum("l_partkey").alias("n"), F.max(F.col("l_partkey") % 23).alias("own"), F.sum("l_quantity").cast("long").alias("bytes"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 7 == 0)).alias("quarantined"))
    state = F.when(F.col("n") % 5 == 0, "terminal_page").when(F.col("n") % 31 == 1, "unknown").otherwise("more_pages")
    pages = pages.withColumns({"token_state": state, "next_token": F.when(state == "more_pages", F.col("own").cast("string"))})
    given = pages.select("job_id", (F.col("page") + 1).alias("page"), F.col("next_token").alias("given"))
    pages = pages.join(given, ["job_id", "page"], "left").withColumn("sent_token", F.when(F.col("n") % 19 == 2, "other").otherwise(F.col("given")))
    rows = line.select(F.col("l_orderkey").alias("job_id"), "page", (F.col("l_partkey") % 40).alias("listing_id"), F.year("l_shipdate").alias("day"))
    asked = read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 4 + 3).alias("max_pages"), F.lit(170).alias("max_bytes"), F.lit(1992).alias("first_day"), (F.col("o_orderkey") % 6 + 1998).alias("last_day"))
    return jobs.results(asked, pages, rows)


def capture_inspection(spark, d):
    """Clicks as daily prices, views as sessions, and all but signups as days that were expected."""
    e = read(spark, d, "events").withColumn("day", F.to_date("ts"))
    of = lambda kind: e.where(F.col("event_type") == kind)
    currency = F.when(F.col("event_id") % 7 == 0, "EUR").otherwise("USD")
    key = [F.col("user_id").alias("listing_id"), "day"]
    prices = of("click").select(*key, currency.alias("currency"), F.col("ts").alias("received_at"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("available_at"))
    sessions = of("view").select(*key, (F.date_trunc("day", "ts") + F.expr("INTERVAL 8 HOURS")).alias("end"), F.col("ts").alias("available_at"))
    expected = e.where("event_type <> 'signup'").select(*key, F.lit("USD").alias("currency")).distinct()
    found = jobs.inspect(prices, sessions, expected)
    return found.select("listing_id", "day", F.unix_seconds("available_at").alias("available"), F.coalesce("reason", F.lit("")).alias("reason"))


def captured_assessment(spark, d):
    """Customers as captured packets, lines of parts as reviews of a source on an axis."""
    packets = read(spark, d, "customer").select(F.col("c_custkey").alias("scope"), F.lit("p").alias("price_source"), F.lit("c").alias("calendar_source"), F.when(F.col("c_custkey") % 50 != 0, "provider_reported").otherwise("synthetic_fixture").alias("price_origin"), F.lit("provider_reported").alias("calendar_origin"), F.lit("XNAS").alias("venue"), F.when(F.col("c_custkey") % 9 != 0, "XNAS").alias("mic"))
    key = F.col("l_orderkey")
    rights = F.when(key % 11 != 0, F.array(F.lit("storage"), F.lit("research"))).otherwise(F.array(F.lit("storage")))
    basis = F.when(key % 13 != 0, "observed_receipt_and_processing").otherwise("documented_publication_vintage")
    axis = F.element_at(F.array(*map(F.lit, jobs.AXES)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    reviews = read(spark, d, "lineitem").select((F.col("l_partkey") % 1500).alias("scope"), F.when(F.col("l_suppkey") % 2 == 0, "p").otherwise("c").alias("source_id"), axis.alias("axis"), F.when(key % 29 == 0, "historical_replay").otherwise("forward_observation").alias("purpose"), F.col("l_shipdate").alias("known_at"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("review_id"), F.when(F.col("l_quantity") < 5, "deny").otherwise("allow").alias("decision"), (F.col("l_shipdate") + F.expr("INTERVAL 1500 DAYS")).alias("expires_at"), rights.alias("declared_rights"), basis.alias("temporal_basis"))
    found = jobs.assess(packets, reviews, "forward_observation", _at(AS_OF))
    return found.select("scope", "eligible", F.array_join("reasons", ",").alias("reasons"))


def action_binding(spark, d):
    """Line items as action jobs of an order's part, beside the latest packet of the part's brand."""
    line, part = read(spark, d, "lineitem"), read(spark, d, "part")
    asked = line.groupBy("l_orderkey", "l_partkey").agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"))
    key = F.concat_ws("-", "l_orderkey", "l_partkey")
    rows = asked.select(key.alias("job_id"), "l_partkey", F.when(F.col("flag") != "N", F.col("flag")).alias("feed"), F.when(F.col("status") == "F", "complete_pages").otherwise("incomplete").alias("state"))
    packets = line.where("l_linenumber = 1").select("l_partkey", F.col("l_shipdate").alias("known_at"), F.struct("l_orderkey", "l_suppkey", "l_returnflag").alias("packet_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("feed"), F.array(F.concat(F.lit("tax_"), F.col("l_linestatus"))).alias("blockers"))
    found = jobs.bind_actions(rows.join(part.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi"), packets, "l_partkey", ["feed"], _at(AS_OF))
    return found.select("job_id", "outcome", F.coalesce(F.array_join("reasons", ","), F.lit("")).alias("reasons"))


def source_diagnostic(spark, d):
    """Users as sources: what stands in the way of each, and how much of it was captured."""
    e = read(spark, d, "events")
    of = lambda kind: e.where(F.col("event_type") == kind).select(F.col("user_id").alias("source_id"))
    sources = e.where("event_id % 3 = 0").groupBy(F.col("user_id").alias("source_id")).agg(F.min("event_id").alias("n")).select("source_id", F.when(F.col("n") % 4 == 0, "synthetic_fixture").otherwise("provider_reported").alias("origin"))
    uses = F.when(F.col("event_type") == "purchase", F.array(F.lit("storage"), F.lit("research"))).otherwise(F.array(F.lit("storage")))
    grants = e.where("event_type IN ('purchase', 'signup')").select(F.col("user_id").alias("source_id"), F.col("ts").alias("known_at"), uses.alias("uses"))
    found = jobs.diagnostic(e.select(F.col("user_id").alias("source_id")), sources, grants, {"clicks": of("click"), "errors": of("error")}, _at("2024-01-20"))
    return found.select("source_id", "declared", F.coalesce("origin", F.lit("")).alias("origin"), F.coalesce(F.array_join("uses", ","), F.lit("")).alias("uses"), "clicks", "errors", F.array_join("blockers", ",").alias("blockers"))


def forward_counts(spark, d):
    """Suppliers as pilots, orders as collections: a line that was returned failed, one that was accepted is recorded."""
    kind = F.when(F.col("l_returnflag") == "A", "collection_recorded").when(F.col("l_returnflag") == "R", "collection_failed").otherwise("collection_started")
    return jobs.collection_counts(read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", kind.alias("kind")), "l_suppkey", "l_orderkey", "kind")


def prediction_lock(spark, d):
    """Orders as predictions by the definition of their priority, on features of their customer; some locked before."""
    o, key = read(spark, d, "orders"), F.col("o_orderkey")
    action = F.when(key % 13 == 0, "abstain").otherwise("forecast")
    rows = o.select((F.floor(key / 2)).cast("string").alias("prediction_id"), F.col("o_orderpriority").alias("definition_id"), F.when(key % 17 == 0, "2").otherwise("1").alias("version_id"), F.col("o_custkey").cast("string").alias("artifact_id"), F.when(key % 19 == 0, "x").otherwise("y").alias("artifact_sha256"), action.alias("action"), F.when(key % 26 != 0, F.col("o_totalprice").cast("decimal(12,2)").cast("string")).alias("value"), F.col("o_orderdate").alias("known_at"), key.alias("k"))
    definitions = o.select("o_orderpriority").distinct().select(F.col("o_orderpriority").alias("definition_id"), F.lit("1").alias("version_id"), _at("1995-03-01").alias("known_at"), (F.length("o_orderpriority") * 86400).alias("horizon_seconds"))
    artifacts = o.groupBy(F.col("o_custkey").cast("string").alias("artifact_id")).agg((F.min("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("known_at")).withColumn("artifact_sha256", F.lit("y"))
    locked = rows.where("k % 10 = 2").withColumn("value", F.when(F.col("k") % 4 == 0, "7").otherwise(F.col("value")))
    found = trials.lock_predictions(locked, rows.where("k % 2 = 0 OR k % 7 = 0"), definitions, artifacts)
    return found.select("prediction_id", "outcome", F.coalesce("reason", F.lit("")).alias("reason"), F.unix_seconds("label_end").alias("ends"))


def trial_evaluation(spark, d):
    """Orders of customers as requests to evaluate: customers of one nation and segment share an instrument and its final test."""
    o, c, key = read(spark, d, "orders"), read(spark, d, "customer"), F.col("o_orderkey")
    year = F.lit(1990) + F.col("c_custkey") % 37
    span = F.struct(F.make_date(year, F.lit(1), F.lit(1)).alias("start"), F.make_date(year + F.col("c_custkey") % 3, F.lit(6), F.lit(30)).alias("end"))
    early = F.struct(F.make_date(F.lit(1980), F.lit(1), F.lit(1)).alias("start"), F.make_date(F.lit(1980), F.lit(12), F.lit(31)).alias("end"))
    sha = F.concat(F.lit("e"), F.col("c_custkey").cast("string"))
    experiments = c.select(F.col("c_custkey").alias("experiment_id"), sha.alias("sha256"), F.col("c_nationkey").alias("baseline_id"), F.when(F.col("c_custkey") % 31 == 0, "old").otherwise("b").alias("baseline_sha256"), F.lit("data").alias("dataset_sha256"), F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("instrument_id"), F.create_map(F.lit("validation"), early, F.lit("final_test"), span).alias("partitions"), _at("1996-01-01").alias("registered_at"))
    protocols = c.select(F.col("c_custkey").alias("trial_id"), F.col("c_custkey").alias("experiment_id"), F.when(F.col("c_custkey") % 23 == 0, "changed").otherwise(sha).alias("experiment_sha256"), _at("1996-06-01").alias("registered_at"))
    baselines = read(spark, d, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").alias("baseline_id"), F.lit("b").alias("sha256"), _at("1995-01-01").alias("registered_at"))
    partition = F.when(key % 5 == 0, "validation").when(key % 41 == 0, "training").otherwise("final_test")
    requests = o.select(key.alias("request_id"), F.col("o_custkey").alias("trial_id"), partition.alias("partition"), F.when(key % 43 == 0, "other").otherwise("data").alias("dataset_sha256"), F.col("o_orderdate").alias("at"))
    found = trials.evaluations(requests, protocols, experiments, baselines)
    return found.select("request_id", F.coalesce("reason", F.lit("")).alias("reason"), "consumed")


def observed_order(spark, d):
    """Events of a user in order of id, each available when it happened and seen when a whole hour is over; how many are out of order."""
    e = read(spark, d, "events").withColumn("available_at", F.date_trunc("day", "ts"))
    e = e.withColumn("seen_at", F.when(F.col("event_id") % 9 == 0, F.col("ts") - F.expr("INTERVAL 1 DAY")).when(F.col("event_id") % 2 == 0, F.col("ts")).otherwise(F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")))
    found = trials.observed_order(e, "user_id", "event_id", "seen_at", "available_at")
    return found.select("event_id", F.coalesce("reason", F.lit("")).alias("reason"))


def order_faults(spark, d):
    return trials.increasing(read(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderdate")


def cost_attribution(spark, d):
    fills = read(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"), F.col("l_extendedprice").alias("open"), F.col("l_tax").alias("fee"))
    return trials.attributed_costs(fills, "l_suppkey", "2.00", "1.50").withColumns({c: F.col(c).cast("double") for c in ("commission", "half_spread", "slippage")})


def session_membership(spark, d):
    """Each event asks whether its user's session was open: sessions begin at purchases and last six hours, or until the next."""
    from pyspark.sql import Window

    e = read(spark, d, "events")
    opened = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("opens_at"))
    until = F.least(F.col("opens_at") + F.expr("INTERVAL 6 HOURS"), F.lead("opens_at").over(Window.partitionBy("user_id").orderBy("opens_at")))
    found = futures.session_of(e.select("event_id", "user_id", "ts"), opened.withColumn("closes_at", until), "user_id", "ts")
    return found.select("event_id", "is_open", F.unix_seconds("session").alias("session"))


def delivery_windows(spark, d):
    """Events as observations of a user, some a fraction of a millisecond later, delivered in whole milliseconds."""
    e = read(spark, d, "events").withColumn("at", F.date_trunc("hour", "ts") + F.make_dt_interval(secs=(F.col("event_id") % 3).cast("decimal(18,6)") / 10000))
    return times.delivery_windows(e, "user_id", "at", F.lit("2024-01-30").cast("date"))


def futures_terms(spark, d):
    """Parts as contracts of a brand's product, line items as versions of their terms; each order asks for one at its date."""
    line, part, o = read(spark, d, "lineitem"), read(spark, d, "part"), read(spark, d, "orders")
    contracts = part.select(F.col("p_partkey").alias("contract_id"), F.col("p_brand").alias("product_id"))
    products = part.where("p_brand NOT LIKE '%5'").select(F.col("p_brand").alias("product_id")).distinct().select("product_id", F.upper("product_id").alias("root"), F.lit("XCME").alias("venue_mic"), F.lit("USD").alias("quote_currency"))
    month = F.date_trunc("month", "l_shipdate")
    versions = line.groupBy(F.col("l_partkey").alias("contract_id"), month.alias("valid_from"), F.col("l_shipdate").alias("known_at")).agg(F.max("l_quantity").alias("q"), F.max("l_linestatus").alias("settlement"))
    versions = versions.select("contract_id", "valid_from", (F.col("valid_from") + F.expr("INTERVAL 500 DAYS")).alias("valid_to"), "known_at", F.lit("0.25").cast("decimal(9,4)").alias("tick_size"), F.col("q").cast("decimal(9,2)").alias("multiplier"), "settlement", F.col("valid_from").alias("last_trade_at"), F.col("valid_from").alias("entry_cutoff_at"))
    requests = o.select(F.col("o_orderkey").alias("request"), (F.col("o_custkey") % 1900 + 1).alias("contract_id"), (F.col("o_orderdate") + F.expr("INTERVAL 100 DAYS")).alias("effective_at"), F.col("o_orderdate").alias("as_of"))
    found = futures.terms_for(requests, contracts, products, versions)
    return found.select("request", "status", F.coalesce("root", F.lit("")).alias("root"), F.col("multiplier").cast("double").alias("multiplier"), "settlement")


QUERIES = {f.__name__: f for f in (paged_jobs, capture_inspection, captured_assessment, action_binding, source_diagnostic, forward_counts, prediction_lock, trial_evaluation, observed_order, order_faults, cost_attribution, session_membership, delivery_windows, futures_terms)}

_UNVERIFIED = ", ".join(f"'{u}'" for u in jobs.UNVERIFIED)

SQL = {
    "paged_jobs": """WITH l AS (SELECT l_orderkey AS job, l_linenumber - 1 AS page, l_partkey, l_quantity, year(l_shipdate) AS day, l_returnflag FROM lineitem),
  p AS (SELECT job, page, sum(l_partkey)::BIGINT AS n, max(l_partkey % 23) AS own, sum(l_quantity)::BIGINT AS bytes, count(*) FILTER (l_returnflag = 'R' AND l_partkey % 7 = 0) AS bad FROM l GROUP BY ALL),
  t AS (SELECT *, CASE WHEN n % 5 = 0 THEN 'terminal_page' WHEN n % 31 = 1 THEN 'unknown' ELSE 'more_pages' END AS kind, CASE WHEN n % 5 <> 0 AND n % 31 <> 1 THEN own END AS nxt FROM p),
  o AS (SELECT o_orderkey AS job, o_orderkey % 4 + 3 AS most, o_orderkey % 6 + 1998 AS until FROM orders),
  x AS (SELECT t.*, o.most, o.until, CASE WHEN t.n % 19 = 2 THEN -1 ELSE b.nxt END AS sent,
      row_number() OVER w - 1 AS nth, sum(t.bytes) OVER w AS used, lag(t.nxt) OVER w AS given, t.nxt IS NOT NULL AND EXISTS (FROM t y WHERE y.job = t.job AND y.page < t.page AND y.nxt = t.nxt) AS cycle,
      EXISTS (FROM l y WHERE y.job = t.job AND y.page = t.page AND y.day NOT BETWEEN 1992 AND o.until) AS outside,
      EXISTS (FROM l y JOIN l z ON y.job = z.job AND y.l_partkey % 40 = z.l_partkey % 40 AND y.day = z.day AND z.page < y.page WHERE y.job = t.job AND y.page = t.page) AS again
    FROM t JOIN o USING (job) LEFT JOIN t b ON b.job = t.job AND b.page = t.page - 1 WINDOW w AS (PARTITION BY t.job ORDER BY t.page)),
  r AS (SELECT *, CASE WHEN nth <> page THEN 'interrupted_previous_run' WHEN used > 170 THEN 'byte_limit' WHEN sent IS DISTINCT FROM given THEN 'page_token_mismatch' WHEN outside THEN 'response_outside_request'
      WHEN again THEN 'duplicate_cross_page_bar' WHEN bad > 0 THEN 'invalid_page_records' WHEN kind = 'unknown' THEN 'pagination_unknown' WHEN kind = 'terminal_page' THEN kind WHEN cycle THEN 'pagination_cycle' WHEN nth + 1 >= most THEN 'page_limit' END AS reason FROM x),
  e AS (SELECT job, min(page) FILTER (reason IS NOT NULL) AS last, arg_min(reason, page) FILTER (reason IS NOT NULL) AS why FROM r GROUP BY 1),
  g AS (SELECT job, why, count(*) FILTER (page < last OR last IS NULL OR (page = last AND why NOT IN ('byte_limit', 'interrupted_previous_run'))) AS pages,
      sum(bytes) FILTER (page < last OR last IS NULL OR (page = last AND why NOT IN ('byte_limit', 'interrupted_previous_run'))) AS bytes FROM e JOIN r USING (job) GROUP BY ALL)
  SELECT o.job AS job_id, coalesce(pages, 0)::BIGINT AS pages, coalesce(bytes, 0)::BIGINT AS bytes, coalesce(why, 'interrupted_previous_run') AS reason,
    CASE WHEN why = 'terminal_page' THEN 'complete_pages' WHEN why IN ('page_token_mismatch', 'response_outside_request', 'duplicate_cross_page_bar', 'invalid_page_records') THEN 'quarantined' ELSE 'incomplete' END AS state FROM o LEFT JOIN g USING (job)""",
    "capture_inspection": """WITH e AS (SELECT *, ts::DATE AS day FROM events),
  p AS (SELECT user_id, day, count(*) AS n, any_value(CASE WHEN event_id % 7 = 0 THEN 'EUR' ELSE 'USD' END) AS currency, max(ts) AS ts FROM e WHERE event_type = 'click' GROUP BY ALL),
  s AS (SELECT user_id, day, count(*) AS m, max(ts) AS moment FROM e WHERE event_type = 'view' GROUP BY ALL),
  w AS (SELECT DISTINCT user_id, day, true AS wanted FROM e WHERE event_type <> 'signup'),
  a AS (SELECT user_id AS listing_id, day, greatest(ts + INTERVAL 1 HOUR, moment) AS available, CASE WHEN n > 1 THEN 'duplicate_price' WHEN m > 1 THEN 'duplicate_session' WHEN n IS NULL THEN 'price_missing' WHEN m IS NULL THEN 'session_missing'
      WHEN wanted IS NULL THEN 'not_expected' WHEN currency <> 'USD' THEN 'currency_differs' WHEN ts < day + INTERVAL 8 HOUR THEN 'received_before_close' ELSE '' END AS reason
    FROM p FULL JOIN s USING (user_id, day) FULL JOIN w USING (user_id, day))
  SELECT listing_id, day, CASE WHEN reason = '' THEN epoch_us(available) // 1000000 END AS available, reason FROM a""",
    "captured_assessment": f"""WITH v AS (SELECT l_partkey % 1500 AS scope, CASE WHEN l_suppkey % 2 = 0 THEN 'p' ELSE 'c' END AS src, ['rights', 'provenance', 'temporal', 'coverage'][l_linenumber % 4 + 1] AS axis,
    arg_max({{'ok': l_quantity >= 5, 'until': l_shipdate + INTERVAL 1500 DAY, 'o': l_orderkey}}, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS r
    FROM lineitem WHERE l_orderkey % 29 <> 0 AND l_shipdate <= '{AS_OF}' GROUP BY ALL),
  g AS (SELECT c_custkey AS scope, q.src || ':' || q.axis || '_review_missing_denied_expired_or_inapplicable' AS reason
    FROM customer, (SELECT * FROM (SELECT unnest(['p', 'c']) AS src), (SELECT unnest(['rights', 'provenance', 'temporal', 'coverage']) AS axis)) q LEFT JOIN v ON v.scope = c_custkey AND v.src = q.src AND v.axis = q.axis
    WHERE NOT coalesce(r.ok AND r.until > '{AS_OF}' AND (q.axis <> 'rights' OR r.o % 11 <> 0) AND (q.axis <> 'temporal' OR r.o % 13 <> 0), false)
    UNION ALL SELECT c_custkey, 'p:provider_origin_required' FROM customer WHERE c_custkey % 50 = 0
    UNION ALL SELECT c_custkey, 'calendar_listing_venue_mismatch' FROM customer WHERE c_custkey % 9 = 0)
  SELECT c_custkey AS scope, count(reason) = 0 AS eligible, coalesce(string_agg(reason, ',' ORDER BY reason), '') AS reasons FROM customer LEFT JOIN g ON g.scope = c_custkey GROUP BY 1""",
    "action_binding": f"""WITH j AS (SELECT l_orderkey, l_partkey, nullif(max(l_returnflag), 'N') AS feed, max(l_linestatus) = 'F' AS whole FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY ALL),
  p AS (SELECT l_partkey, arg_max({{'feed': nullif(l_returnflag, 'N'), 'b': 'tax_' || l_linestatus}}, (l_shipdate, l_orderkey, l_suppkey, l_returnflag)) AS p FROM lineitem WHERE l_linenumber = 1 AND l_shipdate <= '{AS_OF}' GROUP BY 1),
  b AS (SELECT *, CASE WHEN p IS NULL THEN 'no_packet' WHEN p.feed IS NOT DISTINCT FROM feed THEN 'bound' ELSE 'other_scope' END AS outcome FROM j LEFT JOIN p USING (l_partkey))
  SELECT l_orderkey || '-' || l_partkey AS job_id, outcome, CASE WHEN outcome = 'bound' THEN array_to_string(list_sort(list_concat([p.b, {_UNVERIFIED}], CASE WHEN whole THEN [] ELSE ['corporate_action_capture_incomplete_failed_or_quarantined'] END)), ',') ELSE '' END AS reasons FROM b""",
    "source_diagnostic": """WITH s AS (SELECT user_id, CASE WHEN min(event_id) % 4 = 0 THEN 'synthetic_fixture' ELSE 'provider_reported' END AS origin FROM events WHERE event_id % 3 = 0 GROUP BY 1),
  r AS (SELECT user_id, arg_max(event_type, ts) AS kind FROM events WHERE event_type IN ('purchase', 'signup') AND ts <= '2024-01-20' GROUP BY 1),
  c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
  SELECT user_id AS source_id, origin IS NOT NULL AS declared, coalesce(origin, '') AS origin, CASE WHEN origin IS NULL OR kind IS NULL THEN '' WHEN kind = 'purchase' THEN 'research,storage' ELSE 'storage' END AS uses, clicks, errors,
    array_to_string(list_filter([CASE WHEN origin IS NULL THEN 'declare_source' END, CASE WHEN origin IS NOT NULL AND kind IS DISTINCT FROM 'purchase' THEN 'review_storage_and_research' END, CASE WHEN origin = 'synthetic_fixture' THEN 'not_provider_reported' END], lambda x: x IS NOT NULL), ',') AS blockers
  FROM c LEFT JOIN s USING (user_id) LEFT JOIN r USING (user_id)""",
    "forward_counts": """SELECT l_suppkey, count(*) FILTER (a) AS completed, count(*) FILTER (r) AS failed, count(*) FILTER (n AND NOT a AND NOT r) AS incomplete
  FROM (SELECT l_suppkey, l_orderkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R') AS r, bool_or(l_returnflag NOT IN ('A', 'R')) AS n FROM lineitem GROUP BY ALL) GROUP BY 1""",
    "prediction_lock": """WITH r AS (SELECT o_orderkey AS k, (o_orderkey // 2)::VARCHAR AS id, o_orderpriority AS def, CASE WHEN o_orderkey % 17 = 0 THEN '2' ELSE '1' END AS ver, o_custkey, CASE WHEN o_orderkey % 19 = 0 THEN 'x' ELSE 'y' END AS sha,
    CASE WHEN o_orderkey % 13 = 0 THEN 'abstain' ELSE 'forecast' END AS action, CASE WHEN o_orderkey % 26 <> 0 THEN o_totalprice::DECIMAL(12,2)::VARCHAR END AS value, o_orderdate AS moment FROM orders),
  old AS (SELECT id, (def, ver, o_custkey, sha, action, CASE WHEN k % 4 = 0 THEN '7' ELSE value END) AS v FROM r WHERE k % 10 = 2),
  came AS (SELECT id, def, ver, o_custkey, sha, action, value, (def, ver, o_custkey, sha, action, value) AS v, min(moment) AS moment FROM r WHERE k % 2 = 0 OR k % 7 = 0 GROUP BY ALL),
  met AS (SELECT id, count(DISTINCT v) AS kinds, bool_and(fresh) AS fresh FROM (SELECT id, v::VARCHAR AS v, true AS fresh FROM came UNION ALL SELECT id, v::VARCHAR, false FROM old) GROUP BY 1),
  made AS (SELECT o_custkey, min(o_orderdate) + INTERVAL 30 DAY AS made FROM orders GROUP BY 1),
  f AS (SELECT id, def, moment, kinds, fresh, CASE WHEN (action = 'forecast') <> (value IS NOT NULL) THEN 'forecast_with_value_or_abstain_without' WHEN ver <> '1' OR moment < '1995-03-01' THEN 'unknown_definition' WHEN sha <> 'y' OR moment < made THEN 'unknown_artifact' END AS reason
    FROM came JOIN met USING (id) JOIN made USING (o_custkey)),
  g AS (SELECT *, CASE WHEN kinds > 1 THEN 'conflict' WHEN NOT fresh THEN 'same' WHEN reason IS NOT NULL THEN 'refused' ELSE 'new' END AS outcome FROM f)
  SELECT id AS prediction_id, outcome, CASE WHEN outcome = 'refused' THEN reason ELSE '' END AS reason, CASE WHEN outcome = 'new' THEN epoch_us(moment) // 1000000 + length(def) * 86400 END AS ends FROM g""",
    "trial_evaluation": """WITH RECURSIVE a AS (SELECT o_orderkey AS id, o_custkey AS trial, o_orderdate AS moment, c_nationkey || '-' || c_mktsegment AS inst, CASE WHEN o_orderkey % 5 = 0 THEN 'validation' WHEN o_orderkey % 41 = 0 THEN 'training' ELSE 'final_test' END AS part,
    make_date(1990 + o_custkey % 37, 1, 1) AS s, make_date(1990 + o_custkey % 37 + o_custkey % 3, 6, 30) AS e,
    CASE WHEN c_nationkey IS NULL OR c_nationkey = 3 THEN 'unknown_protocol_record' WHEN o_orderdate < '1996-06-01' THEN 'not_available_yet' WHEN part = 'training' THEN 'unknown_partition' WHEN o_custkey % 23 = 0 OR o_custkey % 31 = 0 THEN 'protocol_binding_changed' WHEN o_orderkey % 43 = 0 THEN 'dataset_differs' ELSE '' END AS reason
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
  f AS (SELECT inst, trial, any_value(s) AS s, any_value(e) AS e, min((moment, id)) AS first FROM a WHERE reason = '' AND part = 'final_test' GROUP BY ALL),
  q AS (SELECT *, row_number() OVER (PARTITION BY inst ORDER BY first) AS n FROM f),
  r AS (SELECT inst, trial, first, n, true AS ok, [{'s': s, 'e': e}] AS taken FROM q WHERE n = 1
    UNION ALL SELECT q.inst, q.trial, q.first, q.n, len(list_filter(taken, lambda x: x.s <= q.e AND x.e >= q.s)) = 0, CASE WHEN len(list_filter(taken, lambda x: x.s <= q.e AND x.e >= q.s)) = 0 THEN list_append(taken, {'s': q.s, 'e': q.e}) ELSE taken END FROM r JOIN q ON q.inst = r.inst AND q.n = r.n + 1)
  SELECT id AS request_id, CASE WHEN reason = '' AND part = 'final_test' AND NOT ok THEN 'final_test_period_consumed' ELSE reason END AS reason, coalesce(reason = '' AND part = 'final_test' AND ok AND first = (moment, id), false) AS consumed FROM a LEFT JOIN r USING (trial)""",
    "observed_order": """WITH e AS (SELECT event_id, user_id, date_trunc('day', ts)::TIMESTAMP AS av, CASE WHEN event_id % 9 = 0 THEN ts - INTERVAL 1 DAY WHEN event_id % 2 = 0 THEN ts ELSE date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY END AS seen FROM events),
  l AS (SELECT *, lag(seen) OVER w AS s0, lag(av) OVER w AS a0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
  SELECT event_id, CASE WHEN seen < av THEN 'observed_early' WHEN s0 IS NOT NULL AND NOT (CASE WHEN av = a0 THEN seen = s0 ELSE seen > s0 END) THEN 'not_increasing' ELSE '' END AS reason FROM l""",
    "order_faults": """SELECT o_custkey, count(*) FILTER (o_orderdate <= before) AS faults FROM (SELECT o_custkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) GROUP BY 1""",
    "cost_attribution": """SELECT l_suppkey, count(*) AS fills, sum(l_tax::DECIMAL(18,4))::DOUBLE AS commission, sum((l_quantity::DECIMAL(12,2) * l_extendedprice::DECIMAL(12,2))::DECIMAL(28,4) * 0.0001::DECIMAL(6,4))::DOUBLE AS half_spread,
  sum((l_quantity::DECIMAL(12,2) * l_extendedprice::DECIMAL(12,2))::DECIMAL(28,4) * 0.00015::DECIMAL(6,5))::DOUBLE AS slippage FROM lineitem GROUP BY 1""",
    "session_membership": """WITH s AS (SELECT user_id, ts AS opens, least(ts + INTERVAL 6 HOUR, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts), ts + INTERVAL 6 HOUR)) AS closes FROM events WHERE event_type = 'purchase')
  SELECT event_id, opens IS NOT NULL AS is_open, epoch_us(opens) // 1000000 AS session FROM events e LEFT JOIN s ON s.user_id = e.user_id AND opens <= ts AND ts < closes""",
    "delivery_windows": """WITH e AS (SELECT user_id, epoch_us(date_trunc('hour', ts)::TIMESTAMP) + event_id % 3 * 100 AS moment FROM events),
  g AS (SELECT user_id, (moment + 999) // 1000 AS ms, min(moment) AS a, max(moment) AS b FROM e GROUP BY ALL)
  SELECT user_id, bool_or(a < b) AS collides, make_timestamp(min(a))::DATE - 1 AS first_day, make_timestamp(max(ms) * 1000)::DATE AS last_day, last_day < DATE '2024-01-30' AS replayable FROM g GROUP BY 1""",
    "futures_terms": """WITH v AS (SELECT l_partkey, date_trunc('month', l_shipdate)::TIMESTAMP AS since, l_shipdate AS known, max(l_quantity) AS q, max(l_linestatus) AS settlement FROM lineitem GROUP BY ALL),
  a AS (SELECT o_orderkey AS request, o_custkey % 1900 + 1 AS contract, o_orderdate + INTERVAL 100 DAY AS moment, o_orderdate AS as_of FROM orders),
  l AS (SELECT request, moment, since, arg_max({'q': q, 's': settlement}, known) AS v FROM a JOIN v ON l_partkey = contract WHERE known <= as_of AND since <= moment GROUP BY ALL),
  f AS (SELECT request, count(*) AS n, max(v) AS v FROM l WHERE moment < since + INTERVAL 500 DAY GROUP BY 1)
  SELECT a.request, CASE WHEN p_brand IS NULL THEN 'unknown_contract' WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS status, coalesce(upper(p_brand), '') AS root,
    CASE WHEN p_brand IS NOT NULL AND n = 1 THEN v.q END AS multiplier, CASE WHEN p_brand IS NOT NULL AND n = 1 THEN v.s END AS settlement FROM a LEFT JOIN part ON p_partkey = contract AND p_brand NOT LIKE '%5' LEFT JOIN f USING (request)""",
}
