"""Queries over captured pages, valuations, reviews, snapshots and range checks, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolake.functions import times
from chronolake.operators import admission, bitemporal, captures, corporate, journals, outcomes, rules
from chronolake.sources import parts_of, read

ZONE = "America/New_York"
PARTITIONS = [("train", "2024-01-01", "2024-01-12"), ("validation", "2024-01-14", "2024-01-20"), ("final_test", "2024-01-22", "2024-01-30")]
AXES = ["click", "purchase", "signup", "view"]


def _at(day: str):
    return F.lit(f"{day} 00:00:00").cast("timestamp")


def bar_import(spark, d):
    """An import of JSON for each user, one symbol for each type, in parts of bounded size, some rows wrong on purpose."""
    v, i = F.col("value").cast("decimal(18,2)"), F.col("event_id")
    row = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), v.alias("o"), F.when(i % 11 == 0, v - F.expr("0.5")).otherwise(v + 1).alias("h"), (v - 1).alias("l"), F.when(i % 13 != 0, v).alias("c"), F.when(i % 7 == 0, i + F.expr("0.5")).otherwise(i).alias("v"))
    e = read(spark, d, "events").withColumn("symbol", F.concat("event_type", F.lit("/US")))
    groups = parts_of(e, ["user_id", "symbol"], "event_id", 10000).groupBy("user_id", "symbol", "offset").agg(F.array_sort(F.collect_list(F.struct(i.isNull(), i, row.alias("row")))).alias("rows"))
    pages = groups.select(F.col("user_id").alias("import_id"), "offset", F.to_json(F.struct(F.create_map("symbol", "rows.row").alias("bars"))).alias("payload"))
    listings = e.where("event_type <> 'error'").select("symbol", F.col("event_type").alias("listing_id")).distinct()
    return captures.bars(pages.withColumn("received_at", _at("2024-01-25")), listings, ZONE).select("import_id", "row_path", F.coalesce("reason", F.lit("accepted")).alias("reason"), F.col("close").cast("double").alias("close"))


def calendar_import(spark, d):
    """A calendar for each user, one row for each event, in parts of bounded size."""
    row = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.lit("09:30").alias("open"), F.when(F.col("event_type") == "click", "09:00").otherwise("16:00").alias("close"))
    rows = F.array_sort(F.collect_list(F.struct(F.isnull("event_id"), "event_id", row.alias("row"))))
    pages = parts_of(read(spark, d, "events"), ["user_id"], "event_id", 10000).groupBy(F.col("user_id").alias("import_id"), "offset").agg(F.to_json(F.transform(rows, lambda x: x["row"])).alias("payload"))
    found = captures.sessions(pages, ZONE, "2024-01-03", "2024-01-28")
    return found.select("import_id", "row_path", F.coalesce("reason", F.lit("accepted")).alias("reason"), F.unix_seconds("opens_at").alias("opens"))


def corporate_valuation(spark, d):
    days = rules.daily_bars(read(spark, d, "events"), "event_type", "ts", "value", "event_id")
    on = F.dayofmonth("day")
    days = days.select("event_type", "day", "close", F.when(on == 10, 2).when(on == 20, 3).alias("new_shares"), F.when(on == 10, 1).when(on == 20, 2).alias("old_shares"), F.when(on.isin(5, 15), F.expr("0.25")).alias("dividend"), F.when(on.isin(5, 15), F.date_add("day", 6)).alias("payment_date"))
    return corporate.valuation(days, "event_type", "1000", "100").select("event_type", "day", "exact", *[F.col(c).cast("double").alias(c) for c in ("shares", "cash", "receivable", "wealth")])


def review_admission(spark, d):
    decision = F.when(F.col("event_id") % 5 == 0, "deny").otherwise("allow")
    reviews = read(spark, d, "events").select("user_id", F.col("event_type").alias("axis"), F.col("ts").alias("known_at"), F.col("event_id").alias("review_id"), decision.alias("decision"), F.expr("ts + INTERVAL 12 DAYS").alias("expires_at"))
    return admission.assess(reviews, "user_id", AXES, _at("2024-01-15"), _at("2024-01-20")).select("user_id", "eligible", F.array_join("reasons", ",").alias("reasons"))


def identity_schedule(spark, d):
    o = read(spark, d, "orders")
    start = F.date_trunc("month", "o_orderdate")
    snapshots = o.select("o_custkey", start.alias("valid_from"), (start + F.expr("INTERVAL 60 DAYS")).alias("valid_to"), F.col("o_orderdate").alias("known_at"), F.col("o_orderkey").alias("target"))
    requests = o.select("o_custkey").distinct().select(F.col("o_custkey").alias("request"), "o_custkey", _at("1996-06-15").alias("effective_at"), _at("1996-07-10").alias("as_of"))
    return bitemporal.snapshots_for(requests, snapshots, "request", ["o_custkey"], "target")


def interval_join(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    views = e.where("event_type = 'view'").withColumn("until", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).withColumn("until", F.least("until", F.col("ts") + F.expr("INTERVAL 1 DAY")))
    return bitemporal.containing(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "ts", "until", "event_id", "view_id").select("event_id", "view_id")


def coverage_join(spark, d):
    e = read(spark, d, "events").withColumn("day", F.to_date("ts"))
    return bitemporal.coverage(e.where("event_type = 'view'"), e.where("event_type = 'error'"), ["user_id", "day"])


def native_collision(spark, d):
    return bitemporal.colliding(read(spark, d, "orders"), ["o_totalprice"], ["o_custkey", "o_orderdate"]).select("o_orderkey", "collides")


def consumed_overlap(spark, d):
    ranges = read(spark, d, "orders").withColumn("until", F.expr("o_orderdate + INTERVAL 30 DAYS"))
    return bitemporal.overlaps_earlier(ranges, "o_custkey", "o_orderdate", "until", "o_orderkey").select("o_orderkey", "overlaps")


def hash_chain(spark, d):
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, d, "conversations").withColumn("sha", F.sha2(F.concat_ws("\n", "role", "text"), 256))
    rows = rows.withColumn("previous", F.when(F.col("turn") % 3 != 2, F.lag("sha").over(by)))
    return journals.chain_breaks(rows, "conv_id", "turn", "sha", "previous").select("conv_id", "turn", "unchained")


def append_once(spark, d):
    o = read(spark, d, "orders")
    changed = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return journals.append_once(o.where("o_orderstatus <> 'O'").select("o_orderkey", "o_totalprice"), o.select("o_orderkey", changed.alias("o_totalprice")), ["o_orderkey"])


def outcome_checks(spark, d):
    line = read(spark, d, "lineitem").withColumn("outcome_id", F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber"))
    before = F.lag("outcome_id").over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "outcome_id"))
    status = F.when(F.col("l_returnflag") == "A", "validated").when(F.col("l_returnflag") == "R", "quarantined").otherwise("unavailable")
    found = line.select(F.col("l_orderkey").alias("o_orderkey"), "outcome_id", F.col("l_shipdate").alias("known_at"), status.alias("status"), F.when((F.col("l_returnflag") == "A") | (F.col("l_linenumber") == 3), F.col("l_quantity")).alias("value"), F.when(F.col("l_linenumber") != 5, before).alias("correction_of"))
    predictions = read(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", F.expr("o_orderdate + INTERVAL 300 DAYS").alias("label_end"))
    return outcomes.check_outcomes(found, predictions, "o_orderkey").select("o_orderkey", "outcome_id", F.coalesce("reason", F.lit("admissible")).alias("reason"))


def partition_assign(spark, d):
    return read(spark, d, "events").select("event_id", rules.partition_of(F.to_date("ts"), PARTITIONS, 1).alias("part"))


def local_times(spark, d):
    """The New York day and the instant in whole milliseconds."""
    return read(spark, d, "events").select("event_id", times.local_date(F.col("ts"), ZONE).alias("day"), F.unix_millis(times.ceil_millis(F.col("ts"))).alias("millis"))


def json_extract(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def gap_report(spark, d):
    days = [f"2024-01-{n:02d}" for n in range(1, 31)]
    known = read(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return journals.missing_kinds(known, ["user_id"], "day", days).select("user_id", F.explode("missing").alias("day"))


QUERIES = {f.__name__: f for f in (bar_import, calendar_import, corporate_valuation, review_admission, identity_schedule, interval_join, coverage_join, native_collision, consumed_overlap, hash_chain, append_once, outcome_checks, partition_assign, local_times, json_extract, gap_report)}

SQL = {
    "bar_import": f"""WITH e AS (SELECT *, value::DECIMAL(18,2) AS v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS n FROM events WHERE event_type <> 'error'),
  r AS (SELECT user_id, event_type, n, CASE WHEN event_id % 13 <> 0 THEN v END AS close, ((date_trunc('second', ts) AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}')::DATE AS day,
    CASE WHEN event_id % 13 = 0 THEN 'required_bar_fields_missing' WHEN date_trunc('second', ts) > '2024-01-25' THEN 'bar_timestamp_after_receipt' WHEN v - 1 <= 0 THEN 'invalid_amount'
    WHEN event_id % 7 = 0 THEN 'nonintegral_share_volume' WHEN event_id % 11 = 0 THEN 'invalid_ohlc_bounds' END AS reason FROM e)
  SELECT user_id AS import_id, 'bars/' || event_type || '~1US/' || n AS row_path, close::DOUBLE AS close,
    coalesce(reason, CASE WHEN count(*) FILTER (reason IS NULL) OVER (PARTITION BY user_id, event_type, day) > 1 THEN 'ambiguous_daily_bar' END, 'accepted') AS reason FROM r
  UNION ALL SELECT DISTINCT user_id, 'bars/error~1US', NULL::DOUBLE, 'unmapped_symbol' FROM events WHERE event_type = 'error'""",
    "calendar_import": f"""SELECT user_id AS import_id, '/' || (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS row_path, epoch((ts::DATE + TIME '09:30') AT TIME ZONE '{ZONE}')::BIGINT AS opens,
  CASE WHEN ts::DATE NOT BETWEEN '2024-01-03' AND '2024-01-28' THEN 'date_outside_requested_range' WHEN event_type = 'click' THEN 'session_must_open_before_close'
  WHEN count(*) OVER (PARTITION BY user_id, ts::DATE) > 1 THEN 'duplicate_calendar_date' ELSE 'accepted' END AS reason FROM events""",
    "corporate_valuation": """WITH b AS (SELECT event_type, ts::DATE AS day, arg_max(value::DECIMAL(18,2), (ts, event_id)) AS close FROM events GROUP BY ALL),
  s AS (SELECT *, 100 * (2 ** count(*) FILTER (day(day) = 10) OVER w) * (1.5 ** count(*) FILTER (day(day) = 20) OVER w) AS shares FROM b WINDOW w AS (PARTITION BY event_type ORDER BY day)),
  v AS (SELECT *, (SELECT coalesce(sum(shares * 0.25), 0) FROM s t WHERE t.event_type = s.event_type AND day(t.day) IN (5, 15) AND t.day <= s.day) AS owed,
    (SELECT coalesce(sum(shares * 0.25), 0) FROM s t WHERE t.event_type = s.event_type AND day(t.day) IN (5, 15) AND t.day + 6 <= s.day) AS got FROM s)
  SELECT event_type, day, true AS exact, shares, 1000 + got AS cash, owed - got AS receivable, ((1000 + owed)::DECIMAL(24,6) + shares::DECIMAL(18,3) * close)::DOUBLE AS wealth FROM v""",
    "review_admission": """WITH r AS (SELECT user_id, event_type AS axis,
    arg_max(event_id % 5 <> 0 AND ts + INTERVAL 12 DAY > '2024-01-15', (ts, event_id)) FILTER (ts <= '2024-01-15') AS a, arg_max(event_id % 5 <> 0 AND ts + INTERVAL 12 DAY > '2024-01-20', (ts, event_id)) FILTER (ts <= '2024-01-20') AS b FROM events GROUP BY ALL),
  m AS (SELECT user_id, axis, coalesce(a AND b, false) AS ok FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT unnest(['click', 'purchase', 'signup', 'view']) AS axis) LEFT JOIN r USING (user_id, axis))
  SELECT user_id, bool_and(ok) AS eligible, coalesce(string_agg(axis || '_review_missing_denied_or_expired', ',' ORDER BY axis) FILTER (NOT ok), '') AS reasons FROM m GROUP BY 1""",
    "identity_schedule": """WITH s AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS f, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS t FROM orders
    WHERE o_orderdate <= '1996-07-10' AND date_trunc('month', o_orderdate) <= '1996-06-15' GROUP BY ALL),
  h AS (SELECT o_custkey, count(*) AS n, max(t) AS t FROM s WHERE f + INTERVAL 60 DAY > '1996-06-15' GROUP BY 1)
  SELECT o_custkey AS request, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS status, CASE WHEN n = 1 THEN t END AS target FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN h USING (o_custkey)""",
    "interval_join": """WITH v AS (SELECT *, least(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts + INTERVAL 1 DAY) AS until FROM events WHERE event_type = 'view')
  SELECT p.event_id, v.event_id AS view_id FROM events p LEFT JOIN v ON v.user_id = p.user_id AND v.ts <= p.ts AND p.ts < v.until WHERE p.event_type = 'purchase'""",
    "coverage_join": """SELECT user_id, day, CASE WHEN a AND b THEN 'both' WHEN a THEN 'left_only' ELSE 'right_only' END AS status
  FROM (SELECT user_id, ts::DATE AS day, bool_or(event_type = 'view') AS a, bool_or(event_type = 'error') AS b FROM events GROUP BY ALL) WHERE a OR b""",
    "native_collision": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_totalprice) > 1 OR count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1 AS collides FROM orders",
    "consumed_overlap": "SELECT o_orderkey, coalesce(max(o_orderdate + INTERVAL 30 DAY) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= o_orderdate, false) AS overlaps FROM orders",
    "hash_chain": "SELECT conv_id, turn, turn % 3 = 2 AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 AS unchained FROM conversations",
    "append_once": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'new' WHEN o_orderkey % 10 = 0 THEN 'conflict' ELSE 'same' END AS outcome FROM orders",
    "outcome_checks": """WITH l AS (SELECT *, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS outcome_id FROM lineitem),
  w AS (SELECT *, lag(outcome_id) OVER v AS last, lag(l_shipdate) OVER v AS before FROM l WINDOW v AS (PARTITION BY l_orderkey ORDER BY l_shipdate, outcome_id))
  SELECT l_orderkey AS o_orderkey, outcome_id, CASE WHEN o_orderkey IS NULL THEN 'unknown_prediction' WHEN l_returnflag <> 'A' AND l_linenumber = 3 THEN 'value_without_validation'
  WHEN l_returnflag = 'A' AND l_shipdate < o_orderdate + INTERVAL 300 DAY THEN 'not_matured' WHEN l_linenumber = 5 AND last IS NOT NULL THEN 'not_the_latest_corrected' WHEN before >= l_shipdate THEN 'not_later' ELSE 'admissible' END AS reason
  FROM w LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey""",
    "partition_assign": """SELECT event_id, CASE WHEN d BETWEEN '2024-01-01' AND '2024-01-11' THEN 'train' WHEN d BETWEEN '2024-01-14' AND '2024-01-19' THEN 'validation' WHEN d BETWEEN '2024-01-22' AND '2024-01-29' THEN 'final_test'
  WHEN d IN ('2024-01-12', '2024-01-20', '2024-01-30') THEN 'embargo' END AS part FROM (SELECT event_id, ts::DATE AS d FROM events)""",
    "local_times": f"SELECT event_id, ((ts AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}')::DATE AS day, (epoch_us(ts) + 999) // 1000 AS millis FROM events",
    "json_extract": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "gap_report": "SELECT user_id, strftime(day, '%Y-%m-%d') AS day FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS day) ANTI JOIN (SELECT user_id, ts::DATE AS day FROM events) USING (user_id, day)",
}
