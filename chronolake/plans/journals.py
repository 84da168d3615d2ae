"""Queries over journals, paged captures, delayed labels, action resets and tick grids, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.operators import actions, futures, journals, outcomes
from chronolake.sources import read

AS_OF = "1995-06-17"


def outcome_queue(spark, d):
    at = F.lit(f"{AS_OF} 00:00:00").cast("timestamp")
    predictions = read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("known_at"), F.expr("o_orderdate + INTERVAL 60 DAYS").alias("label_end"))
    status = F.when(F.col("l_returnflag") == "A", "validated").when(F.col("l_returnflag") == "R", "quarantined").otherwise("unavailable")
    found = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("known_at"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("revision"), status.alias("status"))
    return outcomes.queue_as_of(predictions, found, "o_orderkey", at)


def journal_breaks(spark, d):
    return journals.breaks(read(spark, d, "conversations").select("conv_id", "turn", F.octet_length("text").alias("size")), "conv_id", "turn", "size").select("conv_id", "turn", "broken")


def page_states(spark, d):
    pages = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.octet_length("text") % 4 != 0, F.octet_length("text") % 16).alias("token"))
    return journals.page_states(pages, "conv_id", "turn", "token")


def declared_gaps(spark, d):
    known = read(spark, d, "events").select("user_id", "event_type")
    return journals.missing_kinds(known, ["user_id"], "event_type", ["click", "purchase", "signup", "view"]).select("user_id", F.array_join("missing", ",").alias("missing"))


def action_reset(spark, d):
    days = read(spark, d, "events").select("event_type", F.to_date("ts").alias("day")).distinct()
    split = days.where("day(day) IN (9, 18, 27)").select("event_type", "day", F.date_add("day", 1).alias("known_at"))
    return actions.usable_lookback(days.withColumn("available_at", F.col("day")), split, "event_type", 5)


def futures_pnl(spark, d):
    line = read(spark, d, "lineitem")
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    pnl = futures.gross_pnl(F.col("l_tax"), F.col("l_discount"), "50", signed)
    return line.groupBy("l_suppkey").agg(F.count_if(futures.on_grid(F.col("l_extendedprice"), "0.25")).alias("on_grid"), F.sum(pnl.cast("decimal(28,6)")).cast("double").alias("pnl"))


QUERIES = {f.__name__: f for f in (outcome_queue, journal_breaks, page_states, declared_gaps, action_reset, futures_pnl)}

SQL = {
    "outcome_queue": f"""WITH o AS (SELECT l_orderkey, arg_max(CASE l_returnflag WHEN 'A' THEN 'validated' WHEN 'R' THEN 'quarantined' ELSE 'unavailable' END, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS status
  FROM lineitem WHERE l_shipdate <= '{AS_OF}' GROUP BY 1)
  SELECT o_orderkey, coalesce(status, CASE WHEN o_orderdate + INTERVAL 60 DAY <= '{AS_OF}' THEN 'awaiting_outcome' ELSE 'pending' END) AS state,
  coalesce(status = 'validated' AND o_orderdate + INTERVAL 60 DAY <= '{AS_OF}', false) AS eligible FROM orders LEFT JOIN o ON l_orderkey = o_orderkey WHERE o_orderdate <= '{AS_OF}'""",
    "journal_breaks": """SELECT conv_id, turn, coalesce(row_number() OVER w <> turn + 1, true) OR coalesce(lag(strlen(text)) OVER w > strlen(text), false) AS broken
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "page_states": """WITH p AS (SELECT conv_id, turn, CASE WHEN strlen(text) % 4 <> 0 THEN strlen(text) % 16 END AS token FROM conversations),
  s AS (SELECT conv_id, turn, CASE WHEN token IS NULL THEN 'terminal_page' WHEN row_number() OVER (PARTITION BY conv_id, token ORDER BY turn) > 1 THEN 'pagination_cycle' END AS reason FROM p),
  e AS (SELECT conv_id, min(turn) FILTER (reason IS NOT NULL) AS last, arg_min(reason, turn) FILTER (reason IS NOT NULL) AS reason FROM s GROUP BY 1)
  SELECT e.conv_id, count(*) AS pages, coalesce(e.reason, 'page_limit') AS reason, CASE WHEN e.reason = 'terminal_page' THEN 'complete_pages' ELSE 'incomplete' END AS state
  FROM e JOIN s ON s.conv_id = e.conv_id AND (e.last IS NULL OR s.turn <= e.last) GROUP BY e.conv_id, e.reason""",
    "declared_gaps": """SELECT user_id, string_agg(kind, ',' ORDER BY kind) AS missing FROM (SELECT user_id, unnest(['click', 'purchase', 'signup', 'view']) AS kind FROM (SELECT DISTINCT user_id FROM events))
  ANTI JOIN (SELECT user_id, event_type AS kind FROM events) USING (user_id, kind) GROUP BY 1""",
    "action_reset": """WITH b AS (SELECT event_type, day, row_number() OVER (PARTITION BY event_type ORDER BY day) AS rn FROM (SELECT DISTINCT event_type, ts::DATE AS day FROM events)),
  r AS (SELECT x.event_type, x.day, x.rn, max(a.day) AS reset FROM b x LEFT JOIN b a ON a.event_type = x.event_type AND a.rn > greatest(1, x.rn - 4) AND a.rn <= x.rn AND day(a.day) IN (9, 18, 27) AND a.day + 1 <= x.day GROUP BY ALL)
  SELECT r.event_type, r.day, count(*) AS usable FROM r JOIN b y ON y.event_type = r.event_type AND y.rn BETWEEN r.rn - 4 AND r.rn AND (reset IS NULL OR y.day >= reset) GROUP BY ALL""",
    "futures_pnl": """SELECT l_suppkey, count(*) FILTER (l_extendedprice::DECIMAL(18,6) % 0.25 = 0) AS on_grid,
  sum(((l_discount::DECIMAL(15,6) - l_tax::DECIMAL(15,6)) * 50 * CASE l_returnflag WHEN 'R' THEN -l_quantity::INT ELSE l_quantity::INT END)::DECIMAL(28,6))::DOUBLE AS pnl FROM lineitem GROUP BY 1""",
}
