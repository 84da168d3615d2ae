"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.operators import bitemporal, ledger, lineage, rules
from chronolake.plans import assurance, intents, journals, market, protocols, records, stores
from chronolake.sources import archive, read

CUT, LATE = "2024-01-15", "2024-01-20"


def _at(day: str):
    return F.lit(f"{day} 00:00:00").cast("timestamp")


def asof_latest(spark, d):
    rows = bitemporal.latest_as_of(read(spark, d, "events"), ["user_id", "event_type"], "ts", _at(CUT), ["event_id"])
    return rows.select("user_id", "event_type", "event_id")


def version_trap(spark, d):
    rows = bitemporal.latest_as_of(read(spark, d, "events"), ["user_id"], "ts", _at(CUT), ["event_id"])
    return rows.where("event_type = 'purchase'").select("user_id", "event_id")


def rights_gate(spark, d):
    rows = bitemporal.latest_as_of(read(spark, d, "events"), ["user_id"], "ts", _at(LATE), ["event_id"])
    return rows.select("user_id", F.col("event_type").isin("purchase", "signup").alias("allowed"))


def compare_cutoffs(spark, d):
    return bitemporal.compare_cutoffs(read(spark, d, "events"), ["user_id", "event_type"], "ts", _at(CUT), _at(LATE)).select("user_id", "event_type", "status")


def interval_exactly_one(spark, d):
    from pyspark.sql import Window

    o = read(spark, d, "orders")
    spans = o.withColumn("until", F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return bitemporal.valid_report(spans, "o_custkey", "o_orderdate", "until", _at("1998-06-01"))


def pit_asof_join(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    left, right = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'")
    return bitemporal.as_of_join(left, right, "user_id", "ts", "ts", "event_id", "view_id").select("event_id", "user_id", "view_id")


def fullouter_recon(spark, d):
    e = read(spark, d, "events").withColumn("v", F.col("value").cast("decimal(18,2)"))
    total = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.sum("v").alias("v"))
    return bitemporal.reconcile(total("view"), total("click"), "user_id", "v", 5.0).select("user_id", F.col("left_value").cast("double").alias("left_value"), F.col("right_value").cast("double").alias("right_value"), "agrees")


def dup_quarantine(spark, d):
    return bitemporal.split_duplicates(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey", "o_orderdate"]).select("o_orderkey", F.coalesce("reason", F.lit("accepted")).alias("reason"))


def reason_histogram(spark, d):
    return dup_quarantine(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


def sha_cas(spark, d):
    return archive(read(spark, d, "documents"), "text")


def ledger_window(spark, d):
    e = read(spark, d, "events").withColumn("v", F.col("value").cast("decimal(18,2)"))
    signed = F.when(F.col("event_type") == "purchase", -F.col("v")).otherwise(F.col("v"))
    return ledger.running_cash(e, "user_id", ["ts", "event_id"], signed).select("event_id", F.col("cash").cast("double").alias("cash"))


def _bars(spark, d):
    return rules.daily_bars(read(spark, d, "events"), "event_type", "ts", "value", "event_id")


_PRICES = ("open", "high", "low", "close")


def daily_bar(spark, d):
    return _bars(spark, d).withColumns({c: F.col(c).cast("double") for c in _PRICES})


def sma_rule(spark, d):
    return rules.close_above_mean(_bars(spark, d), "event_type", 5).select("event_type", "day", "decision")


def next_open_fill(spark, d):
    return rules.next_open_fill(_bars(spark, d), "event_type", "1.0002").withColumn("fill", F.col("fill").cast("double"))


def impact_set(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "role")
    node = lambda t: F.concat_ws(":", "conv_id", t)
    edges = c.where("turn > 0").select(node((F.col("turn") - 1).cast("string")).alias("source"), node(F.col("turn").cast("string")).alias("target"))
    roots = c.where("turn = 0").select(node(F.col("turn").cast("string")).alias("node"))
    return lineage.impacted(edges, roots)


def client_id(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 32).alias("client_id"))


def availability_groups(spark, d):
    return read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def notional_margin(spark, d):
    n = F.col("l_quantity").cast("decimal(9,2)") * F.col("l_extendedprice").cast("decimal(12,2)")
    reason = F.when(F.col("l_quantity") > 40, "quantity_limit").when(n > 1000000, "notional_limit").otherwise("accepted")
    return read(spark, d, "lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.sum(n).cast("double").alias("notional"))


QUERIES = {f.__name__: f for f in (asof_latest, version_trap, rights_gate, compare_cutoffs, interval_exactly_one, pit_asof_join, fullouter_recon, dup_quarantine, reason_histogram, sha_cas, ledger_window, daily_bar, sma_rule, next_open_fill, impact_set, client_id, availability_groups, notional_margin)} | journals.QUERIES | market.QUERIES | intents.QUERIES | records.QUERIES | protocols.QUERIES | assurance.QUERIES | stores.QUERIES

_BARS = """bars AS (SELECT event_type, ts::DATE AS day, arg_min(value::DECIMAL(18,2), (ts, event_id)) AS open, max(value::DECIMAL(18,2)) AS high,
  min(value::DECIMAL(18,2)) AS low, arg_max(value::DECIMAL(18,2), (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL)"""
_DUP = "SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1 THEN 'duplicate' ELSE 'accepted' END AS reason FROM orders"

SQL = {
    "asof_latest": f"SELECT user_id, event_type, event_id FROM events WHERE ts <= '{CUT}' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "version_trap": f"SELECT user_id, event_id FROM (SELECT * FROM events WHERE ts <= '{CUT}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type = 'purchase'",
    "rights_gate": f"SELECT user_id, event_type IN ('purchase', 'signup') AS allowed FROM events WHERE ts <= '{LATE}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "compare_cutoffs": f"SELECT user_id, event_type, CASE WHEN a IS NULL THEN 'new' WHEN a < b THEN 'changed' ELSE 'same' END AS status FROM (SELECT user_id, event_type, max(ts) FILTER (ts <= '{CUT}') AS a, max(ts) AS b FROM events WHERE ts <= '{LATE}' GROUP BY ALL)",
    "interval_exactly_one": "SELECT o_custkey, n AS matches, CASE n WHEN 1 THEN 'resolved' WHEN 0 THEN 'unknown' ELSE 'ambiguous' END AS status FROM (SELECT o_custkey, count(*) FILTER (o_orderdate <= '1998-06-01' AND (u IS NULL OR u > '1998-06-01')) AS n FROM (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS u FROM orders) GROUP BY o_custkey)",
    "pit_asof_join": "SELECT p.event_id, p.user_id, (SELECT arg_max(v.event_id, (v.ts, v.event_id)) FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts) AS view_id FROM events p WHERE event_type = 'purchase'",
    "fullouter_recon": "SELECT user_id, coalesce(a.v, 0)::DOUBLE AS left_value, coalesce(b.v, 0)::DOUBLE AS right_value, abs(coalesce(a.v, 0) - coalesce(b.v, 0)) <= 5 AS agrees FROM (SELECT user_id, sum(value::DECIMAL(18,2)) AS v FROM events WHERE event_type = 'view' GROUP BY 1) a FULL JOIN (SELECT user_id, sum(value::DECIMAL(18,2)) AS v FROM events WHERE event_type = 'click' GROUP BY 1) b USING (user_id)",
    "dup_quarantine": _DUP,
    "reason_histogram": f"SELECT reason, count(*) AS n FROM ({_DUP}) GROUP BY reason",
    "sha_cas": "SELECT DISTINCT sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM documents",
    "ledger_window": "SELECT event_id, sum(CASE WHEN event_type = 'purchase' THEN -value::DECIMAL(18,2) ELSE value::DECIMAL(18,2) END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS cash FROM events",
    "daily_bar": f"WITH {_BARS} SELECT event_type, day, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, volume FROM bars",
    "sma_rule": f"WITH {_BARS} SELECT event_type, day, CASE WHEN count(*) OVER w < 5 THEN 'warmup' WHEN lead(day) OVER (PARTITION BY event_type ORDER BY day) IS NULL THEN 'no_next_session' WHEN close * 5 > sum(close) OVER w THEN 'target_1' ELSE 'target_0' END AS decision FROM bars WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    "next_open_fill": f"WITH {_BARS} SELECT event_type, day, (nxt * 1.0002)::DECIMAL(18,6)::DOUBLE AS fill FROM (SELECT event_type, day, lead(open) OVER (PARTITION BY event_type ORDER BY day) AS nxt FROM bars) WHERE nxt IS NOT NULL",
    "impact_set": "WITH RECURSIVE r AS (SELECT conv_id, turn, turn AS t FROM conversations WHERE turn = 0 UNION ALL SELECT r.conv_id, r.turn, c.turn FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.t + 1) SELECT DISTINCT conv_id || ':' || turn AS root, conv_id || ':' || t AS node FROM r",
    "client_id": "SELECT o_orderkey, substr(sha256(o_orderkey::VARCHAR), 1, 32) AS client_id FROM orders",
    "availability_groups": "SELECT ts::DATE AS day, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1",
    "notional_margin": "SELECT CASE WHEN l_quantity > 40 THEN 'quantity_limit' WHEN n > 1000000 THEN 'notional_limit' ELSE 'accepted' END AS reason, count(*) AS n, sum(n)::DOUBLE AS notional FROM (SELECT l_quantity, l_quantity::DECIMAL(9,2) * l_extendedprice::DECIMAL(12,2) AS n FROM lineitem) GROUP BY 1",
} | journals.SQL | market.SQL | intents.SQL | records.SQL | protocols.SQL | assurance.SQL | stores.SQL
