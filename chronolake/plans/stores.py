"""Queries over snapshots that are put, captures that are read back, fills and declared accounts, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolake.operators import ledger, rules, stores
from chronolake.sources import read


def _grants(o):
    """Sources 0 to 24: those divisible by 6 may not be used for research; from 1996 on those divisible by 4 may not either."""
    n = o.select((F.col("o_custkey") % 25).alias("n")).distinct()
    uses = F.when(F.col("n") % 6 == 0, F.array(F.lit("storage"))).otherwise(F.array(F.lit("storage"), F.lit("research")))
    first = n.select(F.concat(F.lit("s"), "n").alias("source_id"), F.lit("1990-01-01").cast("timestamp").alias("known_at"), uses.alias("uses"))
    later = n.where("n % 4 = 0").select(F.concat(F.lit("s"), "n").alias("source_id"), F.lit("1996-01-01").cast("timestamp").alias("known_at"), F.array().cast("array<string>").alias("uses"))
    return first.unionByName(later)


def _raw(spark, d):
    """One payload a customer; that of every 23rd changed after it was filed."""
    c = F.col("c_custkey")
    return read(spark, d, "customer").select(F.sha2(F.concat(F.lit("p"), c), 256).alias("sha256"), F.when(c % 23 == 0, F.lit("x")).otherwise(F.concat(F.lit("p"), c)).cast("binary").alias("payload"))


def snapshot_put(spark, d):
    """Orders as snapshots of their customers; some are sent again, some of these with another body, and some are stored."""
    o, k, c = read(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("timestamp")
    plus = lambda n: F.timestamp_add("DAY", n, day)
    kind = F.element_at(F.array(F.lit("bar"), F.lit("session"), F.lit("split")), (k % 3 + 1).cast("int"))
    made = lambda rows, seq, body: rows.select(seq.alias("seq"), kind.alias("kind"), c.cast("string").alias("target_id"), body.alias("body"), day.alias("valid_from"), plus(F.when(k % 41 == 0, 0).otherwise(1)).alias("valid_to"), plus((k % 3).cast("int")).alias("known_at"), F.concat(F.lit("e"), c).alias("evidence_id"))
    body = k.cast("string")
    again = made(o.where(k % 6 == 0), k + 10_000_000_000, F.when(k % 12 == 0, "again").otherwise(body))
    held = made(o.where(k % 5 == 0), k, F.when(k % 10 == 0, "stored").otherwise(body)).drop("seq")
    n = F.col("c_custkey")
    evidence = read(spark, d, "customer").where(n % 17 != 0).select(F.concat(F.lit("e"), n).alias("evidence_id"), F.concat(F.lit("s"), n % 25).alias("source_id"), F.sha2(F.concat(F.lit("p"), n), 256).alias("sha256"), F.when(n % 19 == 0, "1996-06-01").otherwise("1990-01-01").cast("timestamp").alias("received_at"))
    found = stores.put_snapshots(made(o, k, body).unionByName(again), held, evidence, _raw(spark, d), _grants(o))
    return found.select("seq", "snapshot_id", "outcome", F.coalesce("reason", F.lit("")).alias("reason"))


def captures_as_of(spark, d):
    """Orders as captures whose quarantined rows are their large lines, read ten days later or, some, a day too early."""
    o, k, c = read(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("timestamp")
    large = read(spark, d, "lineitem").where("l_quantity > 40").select("l_orderkey", F.concat(F.lit("$.rows["), "l_linenumber", F.lit("]")).alias("row_path"))
    lists = large.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("row_path", F.lit("quantity_limit").alias("reason")))).alias("quarantined"))
    rows = o.join(lists, k == F.col("l_orderkey"), "left").select(k.alias("k"), F.concat(F.lit("s"), c % 25).alias("source_id"), k.cast("string").alias("import_id"), F.lit("{}").alias("input_json"), F.sha2(F.concat(F.lit("p"), c), 256).alias("raw_sha"), day.alias("available_at"), F.to_json(F.struct(F.coalesce("quarantined", F.array().cast("array<struct<row_path: string, reason: string>>")).alias("quarantined"))).alias("result_json"))
    captures = rows.withColumn("integrity_sha", F.when(F.col("k") % 31 == 0, "changed").otherwise(stores.manifest_sha256())).drop("k")
    journal = large.join(o, F.col("l_orderkey") == k).select(F.concat(F.lit("s"), c % 25).alias("source_id"), k.cast("string").alias("import_id"), "row_path", F.when(k % 29 == 0, "other").otherwise("quantity_limit").alias("reason"))
    requests = o.select(k.alias("request"), F.concat(F.lit("s"), c % 25).alias("source_id"), k.cast("string").alias("import_id"), F.timestamp_add("DAY", F.when(k % 7 == 0, -1).otherwise(10), day).alias("as_of"))
    found = stores.captures_as_of(requests, captures, _raw(spark, d), journal, _grants(o))
    return found.select("request", "status", "quarantined", F.sha2("result_json", 256).alias("result_sha256"))


def expected_fills(spark, d):
    """Ten units by a rule of three daily closes of each user's events, filled at the next day's first value."""
    by = Window.partitionBy("user_id").orderBy("day")
    bars = rules.close_above_mean(rules.daily_bars(read(spark, d, "events"), "user_id", "ts", "value", "event_id"), "user_id", 3)
    target = F.when(F.col("decision") == "target_1", 1).when(F.col("decision") == "target_0", 0)
    decided = bars.select("user_id", "day", target.alias("target"), F.lead("day").over(by).alias("intended_at"), F.lead("open").over(by).alias("open"))
    found = rules.expected_fills(decided, "user_id", 10, "3", "2", "1.25")
    return found.select("user_id", "day", "intended_at", "quantity", F.col("price").cast("decimal(18,7)").cast("double").alias("price"), F.col("fee").cast("double").alias("fee"))


def account_reconciliation(spark, d):
    """Users' purchases as cash and their events by type as positions, against statements of which some are wrong, in another currency, or missing."""
    e, u = read(spark, d, "events"), F.col("user_id")
    amount = F.col("value").cast("decimal(18,2)")
    cash = e.groupBy("user_id").agg((-F.sum(F.when(F.col("event_type") == "purchase", amount).otherwise(0))).alias("amount")).withColumn("instrument_id", F.lit(None).cast("string"))
    held = e.groupBy("user_id", F.col("event_type").alias("instrument_id")).agg(F.count("*").cast("decimal(18,2)").alias("amount"))
    states = cash.unionByName(held).where(u % 17 != 0).select("user_id", "instrument_id", F.lit("USD").alias("currency"), "amount")
    off = F.when(F.col("instrument_id").isNull() & (u % 7 == 0), 3).when(F.col("instrument_id").isNull() & (u % 3 == 0), F.lit("0.01").cast("decimal(4,2)")).when((F.col("instrument_id") == "view") & (u % 5 == 0), 1).otherwise(0)
    expected = cash.unionByName(held).where(u % 13 != 0).select("user_id", "instrument_id", F.when(u % 11 == 0, "EUR").otherwise("USD").alias("currency"), (F.col("amount") + off).alias("amount"))
    found = ledger.reconciliation(states, expected, "user_id", "0.01", "0")
    return found.select("user_id", "status", F.col("cash_difference").cast("decimal(18,2)").cast("double").alias("cash_difference"), "instruments", "off")


QUERIES = {f.__name__: f for f in (snapshot_put, captures_as_of, expected_fills, account_reconciliation)}

_DENIED = "(c % 25 % 6 = 0 OR (c % 25 % 4 = 0 AND {at} >= '1996-01-01'))"

SQL = {
    "snapshot_put": f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d, o_orderkey::VARCHAR AS body FROM orders),
  a AS (SELECT 1 AS tier, k AS seq, k, c, d, body FROM o UNION ALL SELECT 1, k + 10000000000, k, c, d, CASE WHEN k % 12 = 0 THEN 'again' ELSE body END FROM o WHERE k % 6 = 0
    UNION ALL SELECT 0, NULL, k, c, d, CASE WHEN k % 10 = 0 THEN 'stored' ELSE body END FROM o WHERE k % 5 = 0),
  f AS (SELECT *, ['bar', 'session', 'split'][k % 3 + 1] AS kind, d + to_days((k % 3)::INT) AS known, d + to_days(CASE WHEN k % 41 = 0 THEN 0 ELSE 1 END) AS until FROM a),
  s AS (SELECT *, sha256('{{"body":"' || body || '","evidence_id":"e' || c || '","kind":"' || kind || '","known_at":' || epoch_us(known) || ',"target_id":"' || c || '","valid_from":' || epoch_us(d) || ',"valid_to":' || epoch_us(until) || '}}') AS id,
    CASE WHEN k % 41 = 0 THEN 'empty_interval' WHEN c % 17 = 0 OR c NOT IN (SELECT c_custkey FROM customer) OR known < CASE WHEN c % 19 = 0 THEN TIMESTAMP '1996-06-01' ELSE TIMESTAMP '1990-01-01' END THEN 'evidence_not_known'
      WHEN {_DENIED.format(at="known")} THEN 'use_not_allowed' WHEN c % 23 = 0 THEN 'payload_corrupt' END AS wrong FROM f),
  p AS (SELECT kind, c, d, known, arg_min(id, (tier, coalesce(seq, 0), id)) AS first_id, arg_min(coalesce(seq, -1), (tier, coalesce(seq, 0), id)) AS first_seq FROM s WHERE tier = 0 OR wrong IS NULL GROUP BY ALL),
  r AS (SELECT seq, id, first_seq, CASE WHEN wrong IS NOT NULL THEN wrong WHEN first_id <> id THEN 'revision_conflict' ELSE '' END AS reason FROM s LEFT JOIN p USING (kind, c, d, known) WHERE tier = 1)
  SELECT seq, id AS snapshot_id, CASE WHEN reason <> '' THEN 'refused' WHEN first_seq = seq THEN 'new' ELSE 'seen_again' END AS outcome, reason FROM r""",
    "captures_as_of": f"""WITH l AS (SELECT l_orderkey AS k, string_agg('{{"row_path":"$.rows[' || l_linenumber || ']","reason":"quantity_limit"}}', ',' ORDER BY l_linenumber::VARCHAR) AS q, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1),
  r AS (SELECT o_orderkey AS k, '{{"quarantined":[' || coalesce(q, '') || ']}}' AS result, coalesce(n, 0) AS n, CASE WHEN {_DENIED.format(at="seen").replace("c %", "o_custkey %")} THEN 'use_not_allowed' WHEN o_orderkey % 7 = 0 THEN 'unavailable' WHEN o_orderkey % 31 = 0 THEN 'manifest_changed'
      WHEN o_custkey % 23 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer) THEN 'payload_corrupt' WHEN o_orderkey % 29 = 0 AND n > 0 THEN 'journal_changed' ELSE 'available' END AS status
    FROM (SELECT *, o_orderdate + to_days(CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE 10 END) AS seen FROM orders) LEFT JOIN l ON l.k = o_orderkey)
  SELECT k AS request, status, CASE WHEN status = 'available' THEN n END AS quarantined, CASE WHEN status = 'available' THEN sha256(result) END AS result_sha256 FROM r""",
    "expected_fills": """WITH b AS (SELECT user_id, ts::DATE AS day, arg_min(value::DECIMAL(18,2), (ts, event_id)) AS open, arg_max(value::DECIMAL(18,2), (ts, event_id)) AS close FROM events GROUP BY ALL),
  s AS (SELECT *, lead(day) OVER w AS intended_at, lead(open) OVER w AS nxt, count(*) OVER r AS n, sum(close) OVER r AS total FROM b WINDOW w AS (PARTITION BY user_id ORDER BY day), r AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
  t AS (SELECT *, CASE WHEN close * 3 > total THEN 1 ELSE 0 END AS target FROM s WHERE n = 3 AND nxt IS NOT NULL),
  f AS (SELECT *, 10 * (target - coalesce(lag(target) OVER (PARTITION BY user_id ORDER BY day), 0)) AS quantity FROM t)
  SELECT user_id, day, intended_at, quantity::BIGINT AS quantity, (nxt * CASE WHEN quantity > 0 THEN 1.00035 ELSE 0.99965 END)::DECIMAL(18,7)::DOUBLE AS price, 1.25::DOUBLE AS fee FROM f WHERE quantity <> 0""",
    "account_reconciliation": """WITH c AS (SELECT user_id AS u, -sum(CASE WHEN event_type = 'purchase' THEN value::DECIMAL(18,2) ELSE 0 END) AS cash, count(DISTINCT coalesce(event_type, '')) AS n, bool_or(event_type = 'view') AS views FROM events GROUP BY 1),
  s AS (SELECT *, CASE WHEN u % 17 = 0 THEN 'not_opened' WHEN u % 13 = 0 THEN 'not_declared' WHEN u % 11 = 0 THEN 'currency_differs' WHEN u % 7 = 0 OR (u % 5 = 0 AND views) THEN 'mismatch' ELSE 'matches' END AS status FROM c WHERE NOT (u % 17 = 0 AND u % 13 = 0))
  SELECT u AS user_id, status, CASE WHEN status IN ('matches', 'mismatch') THEN CASE WHEN u % 7 = 0 THEN -3 WHEN u % 3 = 0 THEN -0.01 ELSE 0 END END::DOUBLE AS cash_difference, n AS instruments,
    CASE WHEN status IN ('matches', 'mismatch') THEN CASE WHEN u % 5 = 0 AND views THEN 1 ELSE 0 END END::BIGINT AS off FROM s""",
}
