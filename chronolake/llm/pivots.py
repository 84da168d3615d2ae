"""Exact nearest neighbours by inner product: an index keyed by nearest pivot and distance to it, with triangle-inequality bounds.

Vectors become whole numbers, floor(256 x).  Rows of equal numbers are one class, which holds its smallest ids: no more than k + 1 can be
in any answer.  Classes are dealt by range to (nearest pivot, distance) and packed into blocks of neighbouring distances, so a
pivot that holds a third of all vectors is many blocks.  Pivots are a sample of at most PIVOTS classes, those with the smallest hashes: they steer the
order of the search, never its answer.

A class that is also a query looks into its own block first; the score it would need to enter its k + 1 best so far is its threshold.  Queries then
go over all blocks, BLOCK_QUERIES at a time, which is all that the driver and a broadcast hold; in a block each query takes the rings of
distances from its own distance outwards, and stops where the triangle inequality says that no further vector can reach the threshold: with g the least difference between the query's distance to the pivot and the
ring's, a score is at most (|q|^2 + |x|^2 - g^2) / 2.  Bounds are raised by more than rounding can cost; scores are exact.

Nulls and edges: a vector that is null, or holds a null or a component that is not finite (256 times it counted), takes no part; vectors of different lengths are compared as
if the shorter one went on with zeros; repeated rows are rows of their own, and only the query's own row is left out; a row with a null id is no query and comes after all ids (the largest long stands for it on the way);
a score beyond 64 bits is given as the nearest long; vectors with components beyond 2^40 are compared with every other one; other columns are ignored, so names cannot
clash; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

K, EVERY, SCALE = 5, 50, 256
#: Size of the sample that pivots are, vectors of a block, rings of a block, queries of a pass, queries of one product.
PIVOTS, BLOCK, RINGS, BLOCK_QUERIES, SLICE = 256, 4096, 8, 1 << 16, 4096
#: Copies of each answer that its queries are dealt over, as equal queries may be many.
SALTS = 8
FAR, EXACT, NO_ID = float(1 << 40), float(1 << 53), np.iinfo(np.int64).max
#: Candidates a task holds before it keeps the best of each query only.
HELD = 1 << 21
BLOCKS = "pivot int, low double, high double, norm double, top double, size int, width int, vectors binary, distances binary, ids array<array<long>>, keys array<string>, wanted array<boolean>"


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: Column | None = None) -> DataFrame:
    """vec_id, vec (whole numbers, as doubles), key, wanted of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), (F.lit(False) if wanted is None else F.coalesce(wanted, F.lit(False))).alias("wanted"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < float("inf")))
    vec = F.transform("x", lambda c: F.when(F.abs(c) < float(1 << 52), F.floor(c * SCALE).cast("double")).otherwise(c * SCALE) + 0.0)
    kept = rows.where(F.col("x").isNotNull() & finite).select("vec_id", vec.alias("vec"), "wanted")
    return kept.select("vec_id", "vec", F.md5(F.concat_ws(",", F.col("vec").cast("array<string>")).cast("binary")).alias("key"), "wanted")


def classes(rows: DataFrame, k: int = K) -> DataFrame:
    """key, vec, ids (the k + 1 smallest, null ids last), wanted, of the different vectors of ``whole``."""
    order = Window.partitionBy("key").orderBy(F.col("vec_id").asc_nulls_last())
    least = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.coalesce("vec_id", F.lit(int(NO_ID))).alias("id")))), lambda s: s["id"])
    asked = rows.where("wanted").select("key").distinct().withColumn("wanted", F.lit(True))
    return least.groupBy("key").agg(F.first("vec").alias("vec"), ids.alias("ids")).join(asked, "key", "left").select("key", "vec", "ids", F.coalesce("wanted", F.lit(False)).alias("wanted"))


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """The vectors of an Arrow list column as rows, with zeros where one is shorter."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), max(width, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.hstack([m, np.zeros((len(m), width - m.shape[1]))])


def _alike(*ms: np.ndarray) -> list[np.ndarray]:
    width = max(m.shape[1] for m in ms)
    return [_wide(m, width) for m in ms]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to those of ``b``."""
    a, b = _alike(a, b)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def _exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any size, at most the largest and at least the smallest long."""
    q, x = _alike(q, x)
    big = np.array([[int(v) for v in row] for row in q], dtype=object) @ np.array([[int(v) for v in row] for row in x], dtype=object).T
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def build_index(found: DataFrame, pivots: np.ndarray, block: int = BLOCK) -> DataFrame:
    """Blocks of the classes in order of nearest pivot and distance; a pivot of -1 holds vectors too large for distances."""

    def key(batches):
        for batch in batches:
            near, dist = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            x = _matrix(batch.column("vec"))
            far = _tops(x) > FAR
            for start in range(0, len(x), SLICE):
                d = _distances(np.where(far[start : start + SLICE, None], 0, x[start : start + SLICE]), pivots)
                near[start : start + SLICE], dist[start : start + SLICE] = d.argmin(1), d.min(1)
            near[far], dist[far] = -1, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(dist)], [*batch.schema.names, "pivot", "distance"])

    def pack(batches):
        held, size = [], 0

        def blocks(rows: pa.Table):
            pivot = rows["pivot"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for start in range(a, b, block):
                    part = rows.slice(start, min(block, b - start)).combine_chunks()
                    x, dist = _matrix(part["vec"].combine_chunks()), part["distance"].to_numpy()
                    norm = float((x * x).sum(1).max()) if pivot[start] >= 0 else float("inf")
                    yield {"pivot": int(pivot[start]), "low": float(dist[0]), "high": float(dist[-1]), "norm": norm, "top": float(np.abs(x).max(initial=0)), "size": len(x), "width": x.shape[1], "vectors": x.tobytes(), "distances": dist.tobytes(), "ids": part["ids"].to_pylist(), "keys": part["key"].to_pylist(), "wanted": part["wanted"].to_pylist()}

        def flush():
            rows = pa.Table.from_batches(held)
            for b in blocks(rows):
                yield pa.RecordBatch.from_pylist([b], schema=_BLOCKS)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 4 * block:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    keyed = found.mapInArrow(key, "key string, vec array<double>, ids array<long>, wanted boolean, pivot int, distance double")
    dealt = keyed.repartitionByRange("pivot", "distance", "key").sortWithinPartitions("pivot", "distance", "key")
    return dealt.mapInArrow(pack, BLOCKS)


_BLOCKS = pa.schema([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("norm", pa.float64()), ("top", pa.float64()), ("size", pa.int32()), ("width", pa.int32()), ("vectors", pa.binary()), ("distances", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64()))), ("keys", pa.list_(pa.string())), ("wanted", pa.list_(pa.bool_()))])


class _Block:
    """A block as arrays."""

    def __init__(self, batch: pa.RecordBatch, n: int) -> None:
        row = {c: batch.column(c)[n].as_py() for c in ("pivot", "low", "high", "norm", "top", "size", "width", "vectors", "distances")}
        self.pivot, self.low, self.high, self.norm, self.top = (row[c] for c in ("pivot", "low", "high", "norm", "top"))
        self.x = np.frombuffer(row["vectors"]).reshape(row["size"], row["width"])
        self.distances = np.frombuffer(row["distances"])
        ids = batch.column("ids")[n].values
        self.ids, self.lengths = ids.flatten().to_numpy(), ids.value_lengths().to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.keys, self.wanted = batch.column("keys")[n].values, batch.column("wanted")[n].values.to_numpy(zero_copy_only=False).astype(bool)

    def entries(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For classes ``which``: positions in ``which``, repeated for each of their ids, and the ids."""
        lengths = self.lengths[which]
        at = np.repeat(np.arange(len(which)), lengths)
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return at, self.ids[self.starts[which][at] + inside]


def _tops(m: np.ndarray) -> np.ndarray:
    return np.abs(m).max(1, initial=0)


def _plain(tops: np.ndarray, width: int, block: _Block) -> np.ndarray:
    """For which queries, given their largest components, doubles hold every inner product with the block exactly."""
    return tops * block.top * max(width, block.x.shape[1], 1) < EXACT


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    return np.full(len(scores), -np.inf) if scores.shape[1] < k else np.partition(scores, -k, axis=1)[:, -k]


def seeded(index: DataFrame, k: int = K) -> DataFrame:
    """key, vec, threshold of the classes that are queries: the (k + 1)-th best score among the classes of their own block."""

    def look(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                block = _Block(batch, n)
                at = np.flatnonzero(block.wanted)
                for start in range(0, len(at), SLICE):
                    some = at[start : start + SLICE]
                    q = block.x[some]
                    least = np.where(_plain(_tops(q), q.shape[1], block), _kth(q @ block.x.T, k + 1), -np.inf) if block.pivot >= 0 else np.full(len(q), -np.inf)
                    yield pa.RecordBatch.from_arrays([block.keys.take(pa.array(some)), pa.array(list(q), pa.list_(pa.float64())), pa.array(least)], ["key", "vec", "threshold"])

    return index.mapInArrow(look, "key string, vec array<double>, threshold double")


class _Search:
    """The queries of a pass, their thresholds, and the candidates that a task has found."""

    def __init__(self, queries: pa.Table, pivots: np.ndarray, k: int) -> None:
        self.q, self.pivots, self.k = _matrix(queries["vec"].combine_chunks()), pivots, k
        self.keys = queries["key"].combine_chunks()
        self.tops = _tops(self.q)
        self.far = self.tops > FAR
        self.norm = np.where(self.far, np.inf, (np.where(self.far[:, None], 0, self.q) ** 2).sum(1))
        self.least = queries["threshold"].to_numpy().copy()
        self.best = np.full((len(self.q), k + 1), -np.inf)
        self.held, self.size, self.near = [], 0, (None, None)

    def distances(self, pivot: int) -> np.ndarray:
        if self.near[0] != pivot:
            self.near = (pivot, _distances(np.where(self.far[:, None], 0, self.q), self.pivots[pivot : pivot + 1])[:, 0])
        return self.near[1]

    def take(self, queries: np.ndarray, block: _Block, at: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        """Candidates: ``at`` positions in ``queries``, ``rows`` of the block, their scores."""
        entry, ids = block.entries(rows)
        self.held.append((queries[at][entry], scores[entry].astype(np.int64), ids))
        self.size += len(ids)
        if self.size > HELD:
            self.held = [self.compact()]
            self.size = len(self.held[0][0])

    def compact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k + 1 best candidates of each query, ties to smaller ids."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, score, ids = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score.astype(object) if (score == np.iinfo(np.int64).min).any() else -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, bool)
        rank = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
        best = rank <= self.k
        return query[best], score[best], ids[best]

    def visit(self, block: _Block) -> None:
        plain = _plain(self.tops, self.q.shape[1], block) if block.pivot >= 0 else np.zeros(len(self.q), bool)
        plain &= ~self.far
        exact = np.flatnonzero(~plain)
        for start in range(0, len(exact), 64):
            some = exact[start : start + 64]
            scores = _exact_scores(self.q[some], block.x)
            at, rows = np.indices(scores.shape).reshape(2, -1)
            self.take(some, block, at, rows, scores.reshape(-1))
        if not plain.any():
            return
        away = self.distances(block.pivot)
        gap = np.maximum(np.maximum(block.low - away, away - block.high), 0)
        live = np.flatnonzero(plain & (self.bound(gap, block) >= self.least))
        for start in range(0, len(live), SLICE):
            self.rings(live[start : start + SLICE], away, block)

    def bound(self, gap: np.ndarray, block: _Block, which=slice(None)) -> np.ndarray:
        """What no score of a vector at this distance can exceed, raised by more than rounding costs."""
        room = self.norm[which] + block.norm
        gap = np.maximum(gap - 1e-6 * np.sqrt(room), 0)
        return (room - gap * gap) / 2 + 1e-9 * room + 1

    def rings(self, queries: np.ndarray, away: np.ndarray, block: _Block) -> None:
        """From the ring at each query's own distance outwards, until its bound is under its threshold."""
        cuts = np.linspace(0, len(block.x), min(RINGS, len(block.x)) + 1).astype(int)
        low, high = block.distances[cuts[:-1]], block.distances[cuts[1:] - 1]
        own = away[queries, None]
        gaps = np.maximum(np.maximum(low - own, own - high), 0)
        order = np.argsort(gaps, axis=1, kind="stable")
        open_ = np.arange(len(queries))
        for turn in range(len(low)):
            ring = order[open_, turn]
            open_ = open_[self.bound(gaps[open_, ring], block, queries[open_]) >= self.least[queries[open_]]]
            if not len(open_):
                return
            ring = order[open_, turn]
            for r in np.unique(ring):
                some = queries[open_[ring == r]]
                q, x = _alike(self.q[some], block.x[cuts[r] : cuts[r + 1]])
                scores = q @ x.T
                at, rows = np.nonzero(scores >= self.least[some, None])
                if not len(at):
                    continue
                self.take(some, block, at, rows + cuts[r], scores[at, rows])
                hit = np.unique(at)
                top = scores[hit]
                if top.shape[1] > self.k + 1:
                    top = np.partition(top, -(self.k + 1), axis=1)[:, -(self.k + 1) :]
                both = np.hstack([self.best[some[hit]], top])
                self.best[some[hit]] = np.partition(both, -(self.k + 1), axis=1)[:, -(self.k + 1) :]
                self.least[some[hit]] = np.maximum(self.least[some[hit]], self.best[some[hit]].min(1))

    def result(self):
        query, score, ids = self.compact()
        good = score >= self.least[query]
        for start in range(0, int(good.sum()), 1 << 16):
            part = slice(start, start + (1 << 16))
            yield pa.RecordBatch.from_arrays([self.keys.take(pa.array(query[good][part])), pa.array(score[good][part]), pa.array(ids[good][part])], ["key", "score", "vec_id"])


def search(index: DataFrame, queries: DataFrame, pivots: np.ndarray, k: int = K, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """key, score, vec_id: for each query of ``seeded`` candidates that hold its k + 1 best rows, with its own."""
    spark, count, out = index.sparkSession, max(1, -(-queries.count() // block_queries)), None
    for part in range(count):
        asked = spark.sparkContext.broadcast(queries.where(F.pmod(F.xxhash64("key"), F.lit(count)) == part).toArrow())  # about block_queries rows

        def look(batches, asked=asked):
            run = _Search(asked.value, pivots, k)
            for batch in batches:
                for n in range(batch.num_rows):
                    run.visit(_Block(batch, n))
            yield from run.result()

        found = stored(index.mapInArrow(look, "key string, score long, vec_id long"), "candidates")
        asked.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def nearest(vectors: DataFrame, wanted: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for each row that is ``wanted`` and has an id, without itself."""
    rows = whole(vectors, id_col, vector_col, wanted & F.col(id_col).isNotNull())
    found = stored(classes(rows, k), "classes")
    small = found.where(F.aggregate("vec", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c))) <= FAR)
    sample = small.orderBy(F.xxhash64("key"), "key").limit(pivots).select("vec").toArrow()["vec"].combine_chunks()  # at most `pivots` rows
    centres = _matrix(sample) if len(sample) else np.zeros((1, 1))
    index = stored(build_index(found, centres, block), "index")
    best = search(index, stored(seeded(index, k), "queries"), centres, k, block_queries)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    answers = ranked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("best"))
    salted = answers.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    square = F.least(F.aggregate("vec", F.lit(0).cast("decimal(38,0)"), lambda a, c: (a + c.cast("decimal(18,0)") * c.cast("decimal(18,0)")).cast("decimal(38,0)")), F.lit(int(NO_ID)).cast("decimal(38,0)"))
    largest = F.aggregate("vec", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c)))
    own = F.when(largest <= FAR, square.cast("long")).otherwise(F.lit(int(NO_ID)))
    asked = rows.where("wanted").select("key", F.col("vec_id").alias("query_id"), own.alias("own"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("_salt"))
    self_at = F.array_position(F.transform("best", lambda b: F.struct(b["vec_id"].alias("id"), b["score"].alias("s"))), F.struct(F.col("query_id").alias("id"), F.col("own").alias("s")))
    met = asked.join(salted, ["key", "_salt"]).withColumn("_at", self_at - 1)
    others = met.select("query_id", F.slice(F.filter("best", lambda b, n: n != F.col("_at")), 1, k).alias("best")).select("query_id", F.posexplode("best").alias("_p", "b"))
    vec_id = F.when(F.col("b.vec_id") != F.lit(int(NO_ID)), F.col("b.vec_id"))
    return others.select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), vec_id.alias("vec_id"), F.col("b.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, a.row AS query_row, b.vec_id, list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i]::HUGEINT * b.q[i]))::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % {EVERY} = 0 AND a.row <> b.row)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored) WHERE rank <= {K}
"""
