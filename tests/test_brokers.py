"""Assets of broker bundles: what each item is told, and that items are read and dealt once."""

import json

from chronolake.operators import brokers
from chronolake.plans import registry
from tests.test_queries import DATA, spark  # noqa: F401

ID = "0f8fad5b-d9cb-469f-a165-70867728950e"


def asset(n, **fields):
    return {"id": f"{ID[:-2]}{n:02x}", "class": "us_equity", "exchange": "X", "symbol": f"S{n}", "status": "active", "tradable": True} | fields


def test_items_are_judged_one_by_one(spark):  # noqa: F811
    """Items that are no objects, of either kind of list, and the first fault of those that are."""
    good = [asset(0), asset(1, id="{" + ID.upper() + "}"), asset(2, status="inactive"), asset(3, min_order_size="0.5"), {k: v for k, v in asset(4, asset_class="us_equity").items() if k != "class"}, asset(5, marginable=None)]
    bad = [(asset(6, asset_class="crypto"), "conflicting_asset_class"), (asset(7, **{"class": 1}), "invalid_required_text"), (asset(8, **{"class": "crypto"}), "unsupported_asset_class"), (asset(9, id=5), "invalid_native_uuid"), (asset(10, exchange=" X"), "invalid_required_text"),
           (asset(11, shortable="true"), "invalid_boolean"), (asset(12, price_increment="1,5"), "invalid_decimal"), (asset(13, min_order_size=True), "invalid_decimal"), (asset(14, min_trade_increment=0), "nonpositive_increment"), (asset(15), "ambiguous_asset_identity"), (asset(15, symbol="T"), "ambiguous_asset_identity"), (asset(16, symbol="T"), "ambiguous_asset_identity")]
    mixed = [None, 1, [], "x", {}]
    bundles = [(1, json.dumps([*good, *[b for b, _ in bad]])), (2, json.dumps([*mixed, *good])), (3, "{}"), (4, "["), (5, "[]"), (6, None)]
    got = {(r.import_id, r.nth): (r.reason, r.state, r.native_id) for r in brokers.assets(spark.createDataFrame(bundles, "import_id int, assets string")).collect()}
    of = lambda i: [v for (k, _), v in sorted(got.items(), key=lambda x: (x[0][0], x[0][1] or 0)) if k == i]
    assert [r for r, _, _ in of(1)] == [None] * len(good) + [why for _, why in bad]
    assert [s for _, s, _ in of(1)[:3]] == ["unmapped_reference", "unmapped_reference", "restricted_reference"] and of(1)[1][2] == ID
    assert [r for r, _, _ in of(2)] == ["asset_object_required"] * 4 + ["invalid_required_text"] + [None] * len(good)
    assert [r for r, _, _ in of(3) + of(4) + of(5) + of(6)] == ["assets_array_required", "invalid_json", "invalid_json"]


def test_items_are_dealt_and_taken_apart_once(spark):  # noqa: F811
    """One shuffle by bundle for all that is counted inside one; paths in rules would be read again for each use."""
    bundles = spark.createDataFrame([(1, "[]")], "import_id int, assets string")
    plain, dealt = brokers.assets(bundles), brokers.assets(bundles).groupBy("import_id", "state").count()
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert plain._jdf.queryExecution().executedPlan().toString().count("try_variant_get(") < 60
    lines = registry.QUERIES["broker_import"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert lines.count("Exchange hashpartitioning") == 2
