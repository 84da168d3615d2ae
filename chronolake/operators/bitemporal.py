"""Lookups over append-only version logs: what was valid at one time, as known at another.

All cutoffs are parameters.  The latest version of a key is taken before anything else is filtered, so that a
superseded row never comes back.  Null cutoff columns are unknown and never taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.sources.shared import stored

#: Rows of a key that one task may sort; a key with more of them is dealt to tasks by day.
HOT = 1 << 20
#: Versions of a key that each of its requests may be joined with; keys with more are swept.
PAIRED = 128


def latest_as_of(log: DataFrame, keys: list[str], known_at: str, cutoff: Column, ties: list[str]) -> DataFrame:
    """The last row of each key with ``known_at`` up to ``cutoff``; ``ties`` decide between equal times."""
    rows = log.where(F.col(known_at) <= cutoff).groupBy(*keys)  # partial maxima: a key that holds most rows is reduced before the shuffle
    return rows.agg(F.max_by(F.struct(*log.columns), F.struct(known_at, *ties)).alias("_row")).select("_row.*")


def valid_report(intervals: DataFrame, key: str, start: str, end: str, at: Column) -> DataFrame:
    """key, matches, status: resolved, unknown or ambiguous, by how many half-open intervals hold the instant."""
    inside = (F.col(start) <= at) & (F.col(end).isNull() | (at < F.col(end)))
    found = intervals.groupBy(key).agg(F.count_if(inside).alias("matches"))
    return found.withColumn("status", F.when(F.col("matches") == 1, "resolved").when(F.col("matches") == 0, "unknown").otherwise("ambiguous"))


def compare_cutoffs(log: DataFrame, keys: list[str], known_at: str, early: Column, late: Column) -> DataFrame:
    """Latest knowledge of each key at two cutoffs: new, changed or same."""
    sums = log.where(F.col(known_at) <= late).groupBy(*keys).agg(F.max(F.when(F.col(known_at) <= early, F.col(known_at))).alias("early"), F.max(known_at).alias("late"))
    return sums.withColumn("status", F.when(F.col("early").isNull(), "new").when(F.col("early") < F.col("late"), "changed").otherwise("same"))


def by_day(at: Column, kind: str) -> Column:
    """The day of an instant, as a part of a key that may hold most rows; other kinds of order have one part."""
    return F.to_date(at) if kind.startswith(("timestamp", "date")) else F.lit(0)


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str, out: str) -> DataFrame:
    """Each left row with the value of the last right row of its key up to its time, null values passed over; no row pairs.

    Rows are sorted inside a key's day; what the days before gave is one row a day, so a key that holds most rows is dealt to many tasks."""
    part = by_day(F.col("_at"), dict(left.dtypes)[left_at])
    both = left.select("*", F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    other = right.where(F.col(right_at).isNotNull()).select(F.col(key), F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"))
    rows = both.unionByName(other, allowMissingColumns=True).withColumn("_part", part)
    order = F.struct("_at", "_value")
    days = rows.select(key, "_part", "_at", "_value").groupBy(key, "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), order)).alias("_last"))
    # What came before is a first row of its day, not a join, which would deal all left rows out once more.
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = days.select(key, "_part", F.lit(None).cast(dict(rows.dtypes)["_at"]).alias("_at"), F.lit(0).alias("_side"), before.alias("_value")).where("_value IS NOT NULL")
    inside = Window.partitionBy(key, "_part").orderBy("_at", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(carried, allowMissingColumns=True).withColumn(out, F.last("_value", ignorenulls=True).over(inside)).where("_side = 1")
    return found.drop("_at", "_side", "_value", "_part")


def reconcile(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Full outer comparison of two totals; what is absent counts as zero."""
    a, b = left.select(key, F.col(value).alias("left_value")), right.select(key, F.col(value).alias("right_value"))
    both = a.join(b, key, "full_outer").na.fill(0, ["left_value", "right_value"])
    return both.withColumn("agrees", F.abs(F.col("left_value") - F.col("right_value")) <= F.lit(tolerance))


def repeated(rows: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """rows with ``mark``: another row has the same keys, nulls being equal.  Keys are counted in tasks first, then joined to the rows."""
    names = {k: f"_{mark}_{n}" for n, k in enumerate(keys)}
    several = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(k).alias(n) for k, n in names.items()], F.lit(True).alias(mark))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return rows.join(several, same, "left").drop(*names.values()).withColumn(mark, F.coalesce(mark, F.lit(False)))


def split_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows with reason: 'duplicate' for every member of a key that occurs more than once, else null."""
    return repeated(rows, keys, "_again").withColumn("reason", F.when(F.col("_again"), "duplicate")).drop("_again")


def _same(keys: list[str], names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])


def parted(rows: DataFrame, keys: list[str], at: str, hot: int) -> tuple[DataFrame, list[str]]:
    """rows with _part, and the names _k0, .. for keys: the day for keys of more than ``hot`` rows, which several tasks may share; null for all others."""
    names = [f"_k{n}" for n in range(len(keys))]
    many = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).withColumn("_hot", F.lit(True)).drop("_n")
    day = by_day(F.col(at), dict(rows.dtypes)[at])
    found = rows.join(F.broadcast(many), _same(keys, names), "left")  # at most one row for each `hot` rows
    return found.withColumn("_part", F.when(F.col("_hot"), day)).drop(*names), names


def running_sums(rows: DataFrame, keys: list[str], at: str, measures: dict[str, Column], totals: dict[str, Column] | None = None, hot: int = HOT) -> DataFrame:
    """rows with the sums of ``measures`` over the rows of the same keys that are not later, and of ``totals`` over all of them.

    A key of more than ``hot`` rows is sorted inside its days, and the days before give one row a day.  Rows without a time come before all."""
    totals = totals or {}
    rows, names = parted(rows.withColumns({f"_m{n}": m for n, m in enumerate([*measures.values(), *totals.values()])}), keys, at, hot)
    count = len(measures)
    every = [f"_m{n}" for n in range(count + len(totals))]
    days = rows.where("_hot").groupBy(*keys, "_part").agg(*[F.sum(m).alias(m) for m in every])
    of = Window.partitionBy(*keys)
    earlier = of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_part").alias("_p"), F.lit(True).alias("_carried"), *[F.sum(m).over(earlier).alias(f"{m}b") for m in every[:count]], *[F.sum(m).over(of).alias(f"{m}t") for m in every[count:]])
    part = Window.partitionBy(*keys, "_part")
    rows = rows.withColumns({f"{m}i": F.sum(m).over(part.orderBy(at)) for m in every[:count]} | {f"{m}i": F.sum(m).over(part) for m in every[count:]})  # rows of one time are counted together
    rows = rows.join(carried, F.col("_hot") & _same([*keys, "_part"], [*names, "_p"]), "left")
    sums = {name: F.coalesce(f"_m{n}i", F.lit(0)) + F.coalesce(f"_m{n}b", F.lit(0)) for n, name in enumerate(measures)}
    sums |= {name: F.coalesce(f"_m{n}t", f"_m{n}i", F.lit(0)) for n, name in enumerate(totals, count)}
    return rows.withColumns(sums).drop("_part", "_p", "_hot", "_carried", *names, *every, *[f"{m}{x}" for m in every for x in "ibt"])


def until_next(rows: DataFrame, keys: list[str], at: str, out: str, hot: int = HOT) -> DataFrame:
    """rows with ``out``: the next later time of the same keys, or null; the times of a key differ.  A key of more than ``hot`` rows is sorted inside its days, with one row a day for what comes after."""
    rows, names = parted(rows, keys, at, hot)
    days = rows.where("_hot").groupBy(*keys, "_part").agg(F.min(at).alias("_first"))
    carried = days.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_part").alias("_p"), F.lead("_first").over(Window.partitionBy(*keys).orderBy("_part")).alias("_after"))
    inside = rows.withColumn("_in", F.lead(at).over(Window.partitionBy(*keys, "_part").orderBy(at)))
    return inside.join(carried, F.col("_hot") & _same([*keys, "_part"], [*names, "_p"]), "left").withColumn(out, F.coalesce("_in", "_after")).drop("_part", "_hot", "_p", "_in", "_after", *names)


def live_nodes(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """points and spans, each with _level and _node: a point meets a span under equal keys, level and node exactly when start <= at < end, and once.

    The times of a key become ranks; a span of ranks is cut into binary ranges, at most two of a level, and a point belongs to one range of each
    level.  Rows grow with the logarithm of what a key holds; nothing is compared that does not meet.  Rows with a null key or
    time, and empty spans, meet nothing and are left out; a span is known by its columns, equal ones are one."""
    there = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    spans = spans.where(there & F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    whole, none = F.struct(*spans.columns), F.lit(None).cast(spans.select(F.struct(*spans.columns).alias("s")).schema["s"].dataType)
    point, nothing = F.struct(*points.columns), F.lit(None).cast(points.select(F.struct(*points.columns).alias("p")).schema["p"].dataType)
    rows = points.where(there & F.col(at).isNotNull()).select(*keys, F.col(at).alias("_t"), F.lit(0).alias("_kind"), point.alias("_point"), none.alias("_span"))
    for kind, time in ((1, start), (2, end)):
        rows = rows.unionByName(spans.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("_t"), F.lit(kind).alias("_kind"), nothing.alias("_point"), whole.alias("_span")))
    edge = F.when(F.col("_kind") > 0, F.lit(1)).otherwise(F.lit(0))
    rows = stored(running_sums(stored(rows, "times"), keys, "_t", {"_rank": edge}, {"_all": edge}), "ranks")
    places = "transform(sequence(0, cast(ceil(log2(_all + 2)) AS int)), n -> named_struct('level', n, 'node', shiftright(_rank, n)))"
    low = rows.where("_kind = 0 AND _rank > 0").select(*keys, "_point", F.explode(F.expr(places)).alias("n"))
    both = rows.where("_kind > 0").groupBy(*keys, "_span").agg(F.max(F.when(F.col("_kind") == 1, F.col("_rank"))).alias("_a"), F.coalesce(F.max(F.when(F.col("_kind") == 2, F.col("_rank"))), F.max("_all") + 1).alias("_b"))
    first, last = "shiftright(_a + shiftleft(1L, n) - 1, n)", "shiftright(_b, n)"
    left = f"CASE WHEN {first} < {last} AND {first} % 2 = 1 THEN named_struct('level', n, 'node', {first}) END"
    right = f"CASE WHEN {first} < {last} AND {last} % 2 = 1 THEN named_struct('level', n, 'node', {last} - 1) END"
    ranges = f"array_compact(flatten(transform(sequence(0, cast(ceil(log2(_b - _a + 1)) AS int)), n -> array({left}, {right}))))"
    high = both.select(*keys, "_span", F.explode(F.expr(ranges)).alias("n"))
    flat = lambda df, s: df.select(f"{s}.*", F.col("n.level").alias("_level"), F.col("n.node").alias("_node"))
    return flat(low, "_point"), flat(high, "_span")


def _number(time: Column, kind: str) -> Column:
    whole = F.unix_micros(time) if kind.startswith("timestamp") else F.unix_date(time) if kind == "date" else time
    return whole.cast("decimal(38,0)")


def snapshots_for(requests: DataFrame, snapshots: DataFrame, request: str, keys: list[str], value: str, paired: int = PAIRED) -> DataFrame:
    """request, status, value: what each request (request, keys, effective_at, as_of) finds among snapshots.

    snapshots: keys, valid_from, valid_to, known_at, value.  Of each valid_from the version last known at as_of counts, before
    its end is looked at; then exactly one has to hold effective_at, else the status is unknown or ambiguous and the value null.

    Keys of at most ``paired`` versions are joined with their requests, so a request meets no more than these; all other keys are swept (``_swept``), so a key
    that holds most rows does not square."""
    names = [f"_l{n}" for n in range(len(keys))]
    large = stored(snapshots.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count("*").alias("_n")).where(F.col("_n") > paired).drop("_n").withColumn("_large", F.lit(True)), "large")
    if large.isEmpty():
        return _answered(requests, _joined(requests, snapshots, keys, value, request), request, value)
    split = lambda df: df.join(large, reduce(lambda a, b: a & b, [F.col(k) == F.col(n) for k, n in zip(keys, names, strict=True)]), "left").drop(*names)
    asked, said = split(requests.select(request, *keys, "effective_at", "as_of")), split(snapshots)
    few = _joined(asked.where("_large IS NULL"), said.where("_large IS NULL").drop("_large"), keys, value, request)
    many = _swept(asked.where("_large").drop("_large"), said.where("_large").drop("_large"), request, keys, value)
    return _answered(requests, few.unionByName(many), request, value)


def _answered(requests: DataFrame, answers: DataFrame, request: str, value: str) -> DataFrame:
    return requests.select(request).join(answers, F.col(request) == F.col("_request"), "left").select(request, F.coalesce("status", F.lit("unknown")).alias("status"), value)


def _joined(requests: DataFrame, snapshots: DataFrame, keys: list[str], value: str, request: str) -> DataFrame:
    """_request, status, value of requests that find something, each joined with the versions of its key."""
    seen = requests.select(F.col(request).alias("_request"), *keys, "effective_at", "as_of").join(snapshots.select(*keys, "valid_from", "valid_to", "known_at", value), keys).where("known_at <= as_of AND valid_from <= effective_at")
    last = seen.groupBy("_request", "effective_at", "valid_from").agg(F.max_by(F.struct("valid_to", value), F.struct("known_at", value)).alias("_v"))
    held = last.where("_v.valid_to IS NULL OR effective_at < _v.valid_to").groupBy("_request").agg(F.count("*").alias("_n"), F.max(F.col("_v")[value]).alias(value))
    return held.select("_request", F.when(F.col("_n") == 1, "resolved").otherwise("ambiguous").alias("status"), F.when(F.col("_n") == 1, F.col(value)).alias(value))


def _swept(requests: DataFrame, snapshots: DataFrame, request: str, keys: list[str], value: str) -> DataFrame:
    """_request, status, value of requests that find something, without a join of requests with versions.

    A version is known from its time to that of the next, so it is a rectangle over both times.  Requests and versions meet in the binary ranges of ``live_nodes`` along knowledge; along
    validity running sums count how many versions begin, less those that end, and add up their times, which name the one that
    is left."""
    kinds = dict(snapshots.dtypes)
    said = snapshots.where("valid_from IS NOT NULL AND known_at IS NOT NULL").groupBy(*keys, "valid_from", "known_at").agg(F.max_by(F.struct("valid_to", value), F.col(value)).alias("_v"))
    spans = until_next(said.select(*keys, "valid_from", "known_at", F.col("_v.valid_to").alias("valid_to"), F.col(f"_v.{value}").alias(value)), [*keys, "valid_from"], "known_at", "_known_to")
    spans = stored(spans.where("valid_to IS NULL OR valid_to > valid_from"), "spans")
    asked = requests.select(F.col(request).alias("_request"), *keys, "effective_at", "as_of").where("effective_at IS NOT NULL")
    points, live = live_nodes(asked, spans.select(*keys, "valid_from", "valid_to", "known_at", "_known_to"), keys, "as_of", "known_at", "_known_to")
    cell, zero = [*keys, "_level", "_node"], F.lit(0).cast("decimal(38,0)")
    sums = {"_n": F.lit(1), "_from": _number(F.col("valid_from"), kinds["valid_from"]), "_known": _number(F.col("known_at"), kinds["known_at"])}
    none = F.lit(None).cast(asked.schema["_request"].dataType)
    ends = F.explode(F.expr("filter(array(named_struct('t', valid_from, 's', 1), named_struct('t', valid_to, 's', -1)), x -> x.t IS NOT NULL)"))
    edges = live.select("*", ends.alias("e")).select(*cell, F.col("e.t").alias("_t"), none.alias("_request"), *[(c.cast("decimal(38,0)") * F.col("e.s")).cast("decimal(38,0)").alias(n) for n, c in sums.items()], F.lit(False).alias("_asks"))
    ask = points.select(*cell, F.col("effective_at").alias("_t"), "_request", *[zero.alias(n) for n in sums], F.lit(True).alias("_asks"))
    rows = stored(ask.unionByName(edges), "edges")
    found = running_sums(rows, cell, "_t", {f"{n}_sum": F.col(n) for n in sums}).where("_asks")
    held = found.groupBy("_request", *keys).agg(*[F.sum(F.col(f"{n}_sum").cast("decimal(38,0)")).cast("decimal(38,0)").alias(n) for n in sums])
    named = spans.select(*[F.col(k).alias(f"_s{n}") for n, k in enumerate(keys)], sums["_from"].alias("_sf"), sums["_known"].alias("_sk"), value)
    one = held.where("_n = 1").join(named, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_s{n}") for n, k in enumerate(keys)]) & (F.col("_from") == F.col("_sf")) & (F.col("_known") == F.col("_sk")), "left")
    answers = held.where("_n > 1").select("_request", F.lit("ambiguous").alias("status"), F.lit(None).cast(spans.schema[value].dataType).alias(value)).unionByName(one.select("_request", F.lit("resolved").alias("status"), value))
    return answers


def containing(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, value: str, out: str) -> DataFrame:
    """Each point with the interval [start, end) of its key that holds it, or null; the intervals of a key do not overlap."""
    spans = intervals.select(key, F.col(start).alias("_from"), F.struct(F.col(value).alias("value"), F.col(end).alias("end")).alias("_span"))
    found = as_of_join(points, spans, key, at, "_from", "_span", "_held")
    inside = F.col("_held.end").isNull() | (F.col(at) < F.col("_held.end"))
    return found.withColumn(out, F.when(inside, F.col("_held.value"))).drop("_held")


def coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status: both, left_only or right_only; exact coverage has only both."""
    sides = left.select(*keys, F.lit(1).alias("_side")).unionByName(right.select(*keys, F.lit(2).alias("_side")))
    found = sides.groupBy(*keys).agg(F.min("_side").alias("a"), F.max("_side").alias("b"))
    return found.select(*keys, F.when(F.col("a") < F.col("b"), "both").when(F.col("a") == 1, "left_only").otherwise("right_only").alias("status"))


def colliding(rows: DataFrame, *identities: list[str]) -> DataFrame:
    """Rows with collides: another row has the same value of any identity (a list of columns); nulls collide with nothing."""
    same = F.lit(False)
    for n, columns in enumerate(identities):
        known = F.forall(F.array(*[F.col(c).isNotNull() for c in columns]), lambda x: x)
        rows = repeated(rows, columns, f"_same{n}")
        same = same | (known & F.col(f"_same{n}"))
    return rows.withColumn("collides", same).drop(*[f"_same{n}" for n in range(len(identities))])


def overlaps_earlier(ranges: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Ranges [start, end] with overlaps: one that starts before, or at once with a smaller tie, reaches into it.

    Ranges are sorted inside a key's day; how far those of earlier days reach is one row a day."""
    rows = ranges.withColumn("_part", by_day(F.col(start), dict(ranges.dtypes)[start]))
    days = rows.groupBy(key, "_part").agg(F.max(end).alias("_last"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), F.max("_last").over(earlier).alias("_reach"))
    before = Window.partitionBy(key, "_part").orderBy(start, tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.max(end).over(before)).join(carried, F.col(key).eqNullSafe(F.col("_k")) & F.col("_part").eqNullSafe(F.col("_p")), "left")
    reaches = F.greatest("_in", "_reach") >= F.col(start)
    return rows.withColumn("overlaps", F.coalesce(reaches, F.lit(False))).drop("_part", "_in", "_reach", "_k", "_p")
