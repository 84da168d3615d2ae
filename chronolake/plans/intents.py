"""Queries over filings, corporate action pages, order intents and drafts, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.operators import captures, futures
from chronolake.sources import page_of, parts_of, read


def filings_import(spark, d):
    """An import of column arrays for each customer, one filing for each order, in parts of bounded size."""
    o, key = read(spark, d, "orders"), F.col("o_orderkey")
    row = F.struct(F.when(key % 7 == 0, "bad").otherwise(F.concat_ws("-", F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.date_format("o_orderdate", "yy"), F.lpad(F.quarter("o_orderdate").cast("string"), 6, "0"))).alias("a"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.col("o_orderstatus").alias("f"), F.when(key % 11 == 0, "../x").otherwise(F.concat(F.lit("a/"), key, F.lit(".htm"))).alias("p"))
    pages = parts_of(o, ["o_custkey"], "o_orderkey", 10000).groupBy("o_custkey", "offset").agg(F.array_sort(F.collect_list(F.struct(key.isNull(), key, row.alias("r")))).alias("r"))
    recent = F.struct(F.col("r.r.a").alias("accessionNumber"), F.col("r.r.d").alias("filingDate"), F.transform("r", lambda _: F.lit("")).alias("reportDate"), F.col("r.r.t").alias("acceptanceDateTime"), F.col("r.r.f").alias("form"), F.col("r.r.p").alias("primaryDocument"))
    body = F.to_json(F.struct(F.col("o_custkey").alias("cik"), F.struct(recent.alias("recent"), F.array().cast("array<string>").alias("files")).alias("filings")))
    asked = F.when(F.col("o_custkey") % 50 == 0, F.lit("9999999999")).otherwise(F.lpad(F.col("o_custkey").cast("string"), 10, "0"))
    pages = pages.select(F.col("o_custkey").alias("import_id"), "offset", asked.alias("cik"), body.alias("payload"), F.lit("1998-01-01 00:00:00").cast("timestamp").alias("received_at"))
    return captures.filings(pages).select("import_id", F.col("row_index").cast("long").alias("row_index"), F.coalesce("reason", F.lit("accepted")).alias("reason"), F.coalesce(F.size("issues"), F.lit(0)).cast("long").alias("n_issues"))


def actions_import(spark, d):
    """Pages for each supplier, of 5000 order numbers each; kinds, ratios and payment days come from line items."""
    line = read(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "N", "cash_dividends").when(F.col("l_returnflag") == "R", "spin_offs").when(F.col("l_linestatus") == "O", "forward_splits").otherwise("reverse_splits")
    day = lambda n: F.date_format(F.date_add(F.to_date("l_shipdate"), n), "yyyy-MM-dd")
    shift = F.when(F.col("l_linenumber") == 2, -1).otherwise(5)
    native = F.regexp_replace(F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    row = F.struct(F.when(F.col("l_linenumber") == 7, "x").otherwise(native).alias("id"), F.lit("S").alias("symbol"), day(0).alias("process_date"), day(0).alias("ex_date"), F.date_format(F.date_add(F.to_date("l_shipdate"), shift), "yyyy-MM-dd").alias("payable_date"), F.when(F.col("l_linenumber") != 3, "USD").alias("currency"), (F.col("l_linenumber") == 4).alias("special"), F.lit(False).alias("foreign"), F.lit(1).alias("rate"), F.col("l_linenumber").alias("new_rate"), F.lit(3).alias("old_rate"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", row.alias("r"))
    groups = line.groupBy(page_of("l_suppkey", "l_orderkey", 5000).alias("import_id"), kind.alias("kind")).agg(F.array_sort(F.collect_list(order)).alias("r"))
    pages = groups.groupBy("import_id").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("kind", "r.r"))).alias("corporate_actions"))).alias("payload"))
    asked = lambda s: F.lit(s).cast("date")
    found = captures.actions(pages.select("import_id", "payload", F.lit("S").alias("symbol"), asked("1993-01-01").alias("first"), asked("1997-12-31").alias("last")))
    return found.select("import_id", "row_path", F.coalesce("reason", F.lit("accepted")).alias("reason"), (F.size("blockers") > 0).alias("blocked"))


def _number(c: str):
    return F.col(c).cast("decimal(12,2)")


def futures_preview(spark, d):
    line = read(spark, d, "lineitem")
    at, n = F.col("l_shipdate"), F.col("l_linenumber")
    intents = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"), _number("l_extendedprice").alias("price"), F.when(F.col("l_partkey") % 17 == 0, "continuous").otherwise("raw_contract").alias("price_kind"), at.alias("decision_at"), F.lit("a").alias("account"), F.lit("a").alias("collateral_account"), at.alias("observed_at"), F.when(n != 6, at + F.expr("INTERVAL 1 DAY")).otherwise(at).alias("expires_at"), F.lit(100000).cast("decimal(18,4)").alias("available"), F.lit("USD").alias("currency"), F.lit("USD").alias("quote_currency"), F.when(F.col("l_suppkey") % 9 == 0, "EUR").otherwise("USD").alias("margin_currency"), F.lit(4000).alias("initial"), F.lit(3500).alias("maintenance"), F.lit(50).alias("multiplier"), F.when(n != 5, F.expr("0.01")).otherwise(F.expr("0.25")).alias("tick"), F.when(F.col("l_suppkey") % 10 == 0, "physical").otherwise("cash").alias("settlement"), F.lit("1998-01-01 00:00:00").cast("timestamp").alias("entry_cutoff_at"), F.lit("1998-02-01 00:00:00").cast("timestamp").alias("last_trade_at"), (F.dayofweek(at) > 1).alias("is_open"))
    found = futures.opening_preview(intents, 40, "50000000", "1.25", False)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("reason", F.lit("accepted")).alias("reason"), F.col("notional").cast("double").alias("notional"))


def draft_prepare(spark, d):
    o, key = read(spark, d, "orders"), F.col("o_orderkey")
    at = F.col("o_orderdate")
    intents = o.select(F.col("o_custkey").cast("string").alias("account"), key.cast("string").alias("intent_id"), F.when(key % 13 == 0, "live").otherwise("paper").alias("environment"), at.alias("decision_at"), F.when(key % 7 == 0, at).otherwise(at + F.expr("INTERVAL 1 DAY")).alias("valid_until"), at.alias("prepared_at"), F.lit("raw_contract").alias("price_kind"), (F.col("o_custkey") % 10 != 0).alias("enabled"), F.when(F.col("o_orderpriority").startswith("1"), "future").when(~F.col("o_orderpriority").startswith("2"), "equity").alias("rule_kind"), F.col("o_orderpriority").startswith("3").alias("fractional"), (key % 9).cast("decimal(18,6)").__truediv__(2).alias("quantity"), F.lit(1).alias("minimum"), F.expr("0.5").alias("step"), _number("o_totalprice").alias("price"), F.expr("0.05").alias("price_tick"))
    return futures.drafts(intents).select(F.col("intent_id").cast("long").alias("o_orderkey"), "client_id", F.coalesce("reason", F.lit("prepared")).alias("reason"))


QUERIES = {f.__name__: f for f in (filings_import, actions_import, futures_preview, draft_prepare)}

SQL = {
    "filings_import": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, (o_orderkey % 7 = 0)::INT + (o_orderkey % 11 = 0)::INT + (o_orderdate > '1998-01-01')::INT AS n_issues FROM orders WHERE o_custkey % 50 <> 0)
  SELECT o_custkey AS import_id, n AS row_index, n_issues::BIGINT AS n_issues, CASE WHEN o_orderkey % 7 = 0 THEN 'invalid_accession' WHEN o_orderkey % 11 = 0 THEN 'invalid_primary_document_path' WHEN o_orderdate > '1998-01-01' THEN 'acceptance_after_receipt'
  WHEN count(*) FILTER (n_issues = 0) OVER (PARTITION BY o_custkey, year(o_orderdate), quarter(o_orderdate)) > 1 THEN 'duplicate_accession' ELSE 'accepted' END AS reason FROM r
  UNION ALL SELECT DISTINCT o_custkey, NULL::BIGINT, 0::BIGINT, 'invalid_submissions_envelope' FROM orders WHERE o_custkey % 50 = 0""",
    "actions_import": """WITH l AS (SELECT *, CASE WHEN l_returnflag = 'N' THEN 'cash_dividends' WHEN l_returnflag = 'R' THEN 'spin_offs' WHEN l_linestatus = 'O' THEN 'forward_splits' ELSE 'reverse_splits' END AS kind FROM lineitem)
  SELECT l_suppkey || '-' || l_orderkey // 5000 AS import_id, kind || '[' || (row_number() OVER (PARTITION BY l_suppkey, l_orderkey // 5000, kind ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate) - 1) || ']' AS row_path, l_linenumber = 3 AS blocked,
  CASE WHEN kind = 'spin_offs' THEN 'unsupported_action_type' WHEN l_linenumber = 7 THEN 'invalid_native_id' WHEN l_shipdate::DATE NOT BETWEEN '1993-01-01' AND '1997-12-31' THEN 'process_date_outside_request'
  WHEN kind = 'cash_dividends' AND l_linenumber = 4 THEN 'special_foreign_or_incomplete_dividend_unsupported' WHEN kind = 'cash_dividends' AND l_linenumber = 2 THEN 'unsupported_dividend_payment_date'
  WHEN (kind = 'forward_splits' AND l_linenumber <= 3) OR (kind = 'reverse_splits' AND l_linenumber >= 3) THEN 'split_direction_ratio_mismatch' ELSE 'accepted' END AS reason FROM l""",
    "futures_preview": """WITH l AS (SELECT *, l_extendedprice::DECIMAL(12,2) AS p, l_quantity::DECIMAL(9,0) AS q FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (p * q * 50)::DOUBLE AS notional, CASE WHEN l_partkey % 17 = 0 THEN 'adjusted_price' WHEN l_linenumber = 6 THEN 'collateral_stale' WHEN l_shipdate >= '1998-01-01' THEN 'past_entry_cutoff'
  WHEN l_suppkey % 10 = 0 THEN 'physical_delivery' WHEN l_linenumber = 5 AND p % 0.25 <> 0 THEN 'off_tick' WHEN dayofweek(l_shipdate) = 0 THEN 'session_closed' WHEN l_suppkey % 9 = 0 THEN 'cross_currency'
  WHEN q > 40 OR l_returnflag = 'R' THEN 'intent_limit' WHEN p * q * 50 > 50000000 OR 4000 * q * 1.25 > 100000 THEN 'notional_or_collateral' ELSE 'accepted' END AS reason FROM l""",
    "draft_prepare": """WITH o AS (SELECT *, (o_orderkey % 9)::DECIMAL(18,6) / 2 AS q, o_totalprice::DECIMAL(12,2) AS p, o_orderpriority[1] AS k FROM orders)
  SELECT o_orderkey, substr(sha256('["' || o_custkey || '","' || o_orderkey || '"]'), 1, 32) AS client_id, CASE WHEN o_orderkey % 13 = 0 THEN 'live_disabled' WHEN o_orderkey % 7 = 0 THEN 'not_known_or_expired' WHEN o_custkey % 10 = 0 THEN 'preparation_disabled'
  WHEN k = '2' THEN 'unsupported_combination' WHEN q < 1 OR (k <> '3' AND q <> floor(q)) THEN 'lot_or_fraction' WHEN p % 0.05 <> 0 THEN 'off_tick' ELSE 'prepared' END AS reason FROM o""",
}
