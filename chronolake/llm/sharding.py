"""Minimax contiguous partition into shards, with DataFrame operations only.

Documents with equal texts are one atomic group.  Groups stand in the order of a 60-bit hash of the text; a
shard is a run of groups.  ``smallest_cuts`` binary-searches the smallest capacity with which a greedy pass,
filling one shard after the other, needs no more than the wanted number of shards, and cuts there.  It is exact
without seeing every group: Spark sums the sizes in cells of the hash range, the search brackets the
capacity and the ends of the shards from below and above, and only cells that a bracket touches are summed
again in finer cells.  The driver holds a few thousand sums, however many groups there are.  As the
cuts are hash values, a document finds its shard by comparing; no group is ever moved as a whole, so a group
that holds a third of all rows is spread over tasks like any others.  The hash is the first 60 bits of the text's md5.

Nulls and edges: a null text counts as the empty text, size 8, crc32 0; a null doc_id gets a place like any
other; repeated rows, which are counted before they are dealt slots, are single rows of one group; ties in size need no rule, as the hash decides; other
columns are ignored, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Bits of the hash; bits that the first cells and each finer level resolve.
BITS, FIRST, FINER = 60, 12, 6
SHARDS, ROWS_PER_BUCKET = 24, 100_000
#: Slots that a row with many equal ones lists at a time.
BLOCK = 1 << 16


class _Cells:
    """Sums of group sizes in cells of the hash range, in order."""

    def __init__(self, rows: list[tuple[int, int, int, int]], level: int):
        """rows: smallest and largest hash, bytes, groups of each cell; level: bits not yet resolved."""
        self.rows = [(a, b, size, level if groups > 1 else 0) for a, b, size, groups in sorted(rows)]
        self.refresh()

    def refresh(self) -> None:
        self.ends = list(accumulate(r[2] for r in self.rows))
        self.open = [r[0] != r[1] for r in self.rows]  # more than one group: prefixes inside are unknown
        self.total = self.ends[-1] if self.ends else 0

    def fill(self, capacity: int, shards: int, most: bool) -> list[int]:
        """Ends of the shards that the greedy pass makes at this capacity: at least, or (most) at most."""
        out, start = [], 0
        for _ in range(shards):
            k = bisect_right(self.ends, start + capacity)
            end = self.ends[k - 1] if k else 0
            if most and k < len(self.ends) and self.open[k]:
                end = start + capacity
            start = max(start, end)
            out.append(start)
        return out

    def least(self, shards: int, most: bool) -> int:
        """Smallest capacity at which that pass places all."""
        low, high = 0, self.total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.fill(mid, shards, most)[-1] >= self.total else (mid + 1, high)
        return low

    def unclear(self, shards: int) -> list[int]:
        """The open cells that the answer may depend on; none when it is exact."""
        low, high = self.least(shards, True), self.least(shards, False)
        first, last = self.fill(low, shards, False), self.fill(high, shards, True)
        if low == high and first == last:
            return []
        found = {k for a, b in zip(first, last, strict=True) for k in range(bisect_right(self.ends, a), min(bisect_left(self.ends, b) + 1, len(self.ends)))}
        return sorted(k for k in found if self.open[k])


def smallest_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and the largest hash of each shard.  groups: key (0 to 2^60 - 1), bytes."""

    def sums(part: DataFrame, level: int) -> list[tuple[int, int, int, int]]:
        cells = part.groupBy(F.shiftright("key", level).alias("cell")).agg(F.min("key"), F.max("key"), F.sum("bytes"), F.count("*"))
        return [tuple(r[1:]) for r in cells.collect()]

    level = BITS - FIRST
    cells = _Cells(sums(groups, level), level)
    while todo := cells.unclear(shards):
        level = max(0, level - FINER)
        spans: list[list[int]] = []  # neighbouring cells as one range of hashes
        for k in todo:
            if spans and spans[-1][2] == k - 1:
                spans[-1][1:] = [cells.rows[k][1], k]
            else:
                spans.append([cells.rows[k][0], cells.rows[k][1], k])
        inside = F.lit(False)
        for a, b, _ in spans:
            inside = inside | F.col("key").between(a, b)
        gone = set(todo)
        fine = _Cells(sums(groups.where(inside), level), level)
        cells.rows = sorted([r for k, r in enumerate(cells.rows) if k not in gone] + fine.rows)
        cells.refresh()
    capacity = cells.least(shards, False)
    ends = cells.fill(capacity, shards, False)
    return capacity, [cells.rows[bisect_left(cells.ends, e)][1] if cells.rows else 0 for e in ends]


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET, block: int = BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null) of every row.

    Slots are dealt by buckets of about ``rows_per_bucket`` rows, by the md5 of id and hash: bucket sizes give each bucket of a
    shard its first slot, and rows are numbered inside their bucket only.  Rows that share id and text are one row with a count
    until they have their slots, which are listed ``block`` at a time, so no row grows with its copies."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    start = lambda x, n: F.conv(F.substring(F.md5(x.cast("binary")), 1, n), 16, 10).cast("long")
    each = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), start(text, BITS // 4).alias("key"))
    rows = stored(each.groupBy("doc_id", "key").agg(F.min("size").alias("size"), F.min("text_crc32").alias("text_crc32"), F.count("*").alias("n")), "rows")
    groups = stored(rows.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("n")), "groups")
    count = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    _, cuts = smallest_cuts(groups, shards)
    before = F.size(F.filter(F.array([F.lit(c).cast("long") for c in cuts[:-1]]).cast("array<bigint>"), lambda c: c < F.col("key")))
    bucket = F.pmod(start(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "key"), 8), F.lit(max(1, -(-count // rows_per_bucket))))
    placed = rows.withColumn("shard", before.cast("int")).withColumn("bucket", bucket)
    first = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("m")).withColumn("first", F.sum("m").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("m")).drop("m")
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "key").rowsBetween(Window.unboundedPreceding, 0)
    slots = placed.withColumn("at", F.sum("n").over(inside) - F.col("n")).join(first, ["shard", "bucket"])
    begin = F.col("first") + F.col("at")
    blocks = slots.withColumns({"begin": begin, "until": begin + F.col("n")}).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {block}"))))
    start_of = F.col("begin") + F.col("block") * block
    slot = F.explode(F.sequence(start_of, F.least(start_of + block, F.col("until")) - 1))
    return blocks.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 8 AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS key FROM documents),
g AS (SELECT key, sum(size)::BIGINT AS bytes FROM d GROUP BY key),
ends AS (SELECT list(c ORDER BY c) AS cums FROM (SELECT sum(bytes) OVER (ORDER BY key)::BIGINT AS c FROM g)),
search AS (
  SELECT 0::BIGINT AS low, (SELECT max(c) FROM (SELECT unnest(cums) AS c FROM ends))::BIGINT AS high
  UNION ALL
  SELECT CASE WHEN fits THEN low ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE high END
  FROM (SELECT low, high, mid, list_reduce(list_prepend(0::BIGINT, range({SHARDS})), lambda s, k: greatest(s, coalesce(list_max(list_filter(cums, lambda x: x <= s + mid)), 0))) >= cums[-1] AS fits
    FROM (SELECT low, high, (low + high) // 2 AS mid, cums FROM search, ends WHERE low < high))),
capacity AS (SELECT min(high) AS c FROM search),
cut AS (
  SELECT 0 AS shard, 0::BIGINT AS since, coalesce(list_max(list_filter(cums, lambda x: x <= c)), 0)::BIGINT AS until FROM ends, capacity
  UNION ALL
  SELECT shard + 1, until, greatest(until, coalesce(list_max(list_filter(cums, lambda x: x <= until + c)), 0))::BIGINT FROM cut, ends, capacity WHERE shard < {SHARDS} - 1),
home AS (
  SELECT key, (SELECT min(shard) FROM cut WHERE e <= until) AS shard FROM (SELECT key, sum(bytes) OVER (ORDER BY key)::BIGINT AS e FROM g)),
codes AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS tab FROM (SELECT unnest(range(256)) AS n)),
crc AS (
  SELECT t, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda b: ('0x' || b)::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))::BIGINT AS text_crc32
  FROM (SELECT DISTINCT t FROM d), codes),
dealt AS (
  SELECT doc_id, t, size, shard, key, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || key), 1, 8))::BIGINT % greatest(1, ((SELECT count(*) FROM d) + {ROWS_PER_BUCKET} - 1) // {ROWS_PER_BUCKET}) AS bucket
  FROM d JOIN home USING (key))
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, key) - 1 AS slot, NULL::INT AS grown_shard
FROM dealt JOIN crc USING (t)
"""
