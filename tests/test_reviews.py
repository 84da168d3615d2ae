"""Reviews are recorded by their digests: what is stored and shuffled does not carry scopes, and equal ids, places and digests meet."""

from datetime import timedelta

from pyspark.sql import functions as F

from chronolake.operators import bitemporal, reviews
from tests.test_assurance import REVIEW, T, recorded, review, world
from tests.test_queries import spark  # noqa: F401


def test_only_ids_and_digests_are_stored(spark, monkeypatch):  # noqa: F811
    """A scope holds two digests and more; each copy of it in a table or a shuffle is several times the review's own digest."""
    kept = []

    def seen(df, name, put=reviews.stored):
        kept.append((name, df.dtypes))
        return put(df, name)

    monkeypatch.setattr(reviews, "stored", seen)
    found = recorded(spark, [review(n, "coverage", at=T + timedelta(n)) for n in range(20)])
    assert {t for _, dtypes in kept for _, t in dtypes} <= {"binary", "string", "boolean"} and all(len(dtypes) <= 6 for _, dtypes in kept)
    assert not {"scope", "reviewer", "review_sha256", "scope_sha256"} & {c for _, dtypes in kept for c, _ in dtypes}
    told = found.select("review_id", "outcome", "reason")
    dealt = [line for line in told._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line or "Aggregate" in line]
    assert dealt and not any("scope#" in line for line in dealt) and {r.outcome for r in told.collect()} == {"new"}


def test_refused_and_repeated_reviews_beside_those_taken(spark):  # noqa: F811
    """A review taken before stays one when its evidence is gone, and a row with a fault of its own does not share the fate of its digest."""
    first = recorded(spark, [review(1, "rights"), review(2, "coverage"), review(3, "provenance")]).drop("outcome", "reason")
    grants, evidence = world(spark)
    none = evidence.limit(0)
    again = reviews.record(first, spark.createDataFrame([review(1, "rights"), review(4, "coverage")], REVIEW), grants, none)
    assert {(r.review_id, r.outcome, r.reason) for r in again.collect()} == {("1", "refused", "evidence_unknown_or_late"), ("4", "refused", "evidence_unknown_or_late")}
    rows = [review(2, "coverage"), review(2, "coverage"), review(2, "coverage", late=1), review(5, "coverage"), review(6, "temporal"), review(6, "temporal"), review(7, "temporal", source="t"), review(7, "temporal", at=T + timedelta(3)), review(3, "provenance", refs=("bad",)), review(3, "provenance", reviewer="q")]
    got = sorted((r.review_id, r.outcome, r.reason or "") for r in recorded(spark, rows, first).collect())
    assert got == [("2", "refused", "availability_is_not_recording_time"), ("2", "same", ""), ("2", "same", ""), ("3", "refused", "evidence_digest_differs"), ("3", "refused", "review_changed"), ("5", "refused", "another_review_at_this_time"), ("6", "new", ""), ("6", "new", ""), ("7", "new", ""), ("7", "refused", "use_not_permitted")]
    sizes = recorded(spark, rows, first).groupBy("review_sha256").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in sizes) == len(rows) and {len(r.review_sha256) for r in sizes} == {64}


def test_as_of_joins_deal_the_left_rows_once(spark):  # noqa: F811
    """Earlier days come as rows beside the others, nulls of key and time included; a join would deal all left rows out again."""
    day = lambda n: T + timedelta(n)
    left = spark.createDataFrame([(k, at, i) for k in ("a", "b", None) for i, at in enumerate((day(0), day(2), day(2.5), day(9), None))], "k string, at timestamp, i int")
    right = spark.createDataFrame([("a", day(1), 1), ("a", day(2.25), 2), ("a", day(2.4), None), (None, day(3), 3), ("c", day(0), 4), ("a", None, 5)], "k string, known timestamp, v int")
    found = bitemporal.as_of_join(left, right, "k", "at", "known", "v", "got")
    assert found.columns == ["k", "at", "i", "got"] and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {"a": [None, 1, 2, 2, None], "b": [None] * 5, None: [None, None, None, 3, None]}
    assert {(r.k, r.i): r.got for r in found.collect()} == {(k, i): v for k, vs in want.items() for i, v in enumerate(vs)}
