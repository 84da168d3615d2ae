r"""Language-model scoring: cross-entropy difference of a target and a background model.

Both are bigram models over one shared vocabulary, which is every word of the corpus and the boundary that stands before
and after a text.  The target model counts the documents labelled good, the background model all others; order, smoothing
and vocabulary match, and so do sizes: nothing is left out, but all counts of the larger side are scaled down to the mass of the
smaller one, so that smoothing weighs alike in both, and a background that repeats the target scores 0.  A document's score is the
mean over its words and its end of target loss minus background loss: the lower, the closer to the target.  No document is scored
by its own words: what it gave to the model of its side is taken out of every count, and of the mass, first.

Counts are distributed, and grow with the corpus.  Texts become blocks of about ``BLOCK_BYTES``, stored as word numbers and
hashes.  A block sends the counts of its different words and word pairs to buckets of the hash range, as packed
sorted keys; a bucket adds up equal keys over all blocks and sends each block the sums for its keys, in the same order; a
block then scores its documents.  The number of buckets follows from the number of keys, about ``BUCKET_KEYS`` in each, and
hashing spreads them evenly: a frequent word is one key a block.  Words and pairs are told apart by 64-bit hashes.

A word's probability after h is (f * c(h, w) + STRENGTH * P(w)) / (f * c(h) + STRENGTH), with P(w) = (f * c(w) + 1) / (m + V), where
m is the smaller of both sides' words and ends, f is m over the side's own, and V the different words of the corpus and the boundary.
If one side has no words but a document's own, m is 0, both models are uniform, and the score is 0.

Nulls and edges: a text without words has zero losses and score, and is in no model; a null label or id is no target; rows that
repeat an id are counted and scored one by one, each without its own row's words only; very long texts make a block
of their own; other columns are ignored, so names cannot clash; an empty table gives an empty result; without any target
row the target model is the uniform one.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ALNUM, pack, stored, table, unpack, words

#: Text bytes and documents of a block, keys of a bucket, and the weight of P(w) in occurrences.
BLOCK_BYTES, BLOCK_DOCS, BUCKET_KEYS, STRENGTH = 8 << 20, 1 << 16, 2_000_000, 10.0
#: Stands for the boundary, word number 0 of every block.
BOUNDARY = np.uint64(0x243F6A8885A308D3)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    out = (first ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    out = ((out ^ (out >> np.uint64(31))) + second) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, doc_ids, n_words, codes (word numbers, 0 around each text), hashes (of the numbered words), keys; stored."""
    id_type = docs.schema[id_col].dataType
    names, first_type = ["block", "doc_ids", "n_words", "codes", "hashes", "keys"], to_arrow_type(id_type)

    def make(batches):
        task, number = TaskContext.get().partitionId(), 0
        ids, n, parts, known, size = [], [], [], {}, 0

        def row():
            codes = np.concatenate([np.zeros(1, np.uint32), *parts])
            hashes = np.fromiter(chain([BOUNDARY], map(xxhash.xxh64_intdigest, known)), np.uint64, len(known) + 1)
            pairs = len(np.unique(codes[:-1].astype(np.int64) * len(hashes) + codes[1:]))
            values = [(task << 32) + number], [ids], [n], [pack(codes)], [pack(hashes)], [pairs + len(hashes)]
            types = pa.int64(), pa.list_(first_type), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), pa.compute.cast(batch.column(1), pa.binary()), strict=True):
                text = text.as_py() or b""
                found = [np.fromiter((known.setdefault(w, len(known) + 1) for w in part), np.uint32, len(part)) for part in words(text, ALNUM)]
                ids.append(doc_id)
                n.append(sum(map(len, found)))
                if n[-1]:
                    parts += [*found, np.zeros(1, np.uint32)]
                size += len(text)
                if size >= block_bytes or len(ids) >= BLOCK_DOCS:
                    yield row()
                    ids, n, parts, known, size, number = [], [], [], {}, 0, number + 1
        if ids:
            yield row()

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return stored(rows.mapInArrow(make, f"block long, doc_ids array<{id_type.simpleString()}>, n_words array<long>, codes binary, hashes binary, keys long"), "blocks")


class _Block:
    """The predictions of a block: each word after the one before it, and the end of each text."""

    def __init__(self, n_words: np.ndarray, codes: bytes, hashes: bytes, targets: np.ndarray):
        self.s, self.hashes = unpack(codes, np.uint32).astype(np.int64), unpack(hashes, np.uint64)
        self.n_words, self.with_words = n_words, np.flatnonzero(n_words)
        length = n_words[self.with_words] + 1
        self.start = np.cumsum(length) - length
        self.doc = np.repeat(np.arange(len(length)), length)
        is_target = np.zeros(len(n_words), bool)
        is_target[targets] = True
        self.side = is_target[self.with_words]
        pairs, self.pair = np.unique(self.s[:-1] * len(self.hashes) + self.s[1:], return_inverse=True)
        first, second = np.divmod(pairs, len(self.hashes))
        self.keys = self.hashes, pair_keys(self.hashes[first], self.hashes[second])
        self.order = [np.argsort(k, kind="stable") for k in self.keys]

    def counts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted keys, and the counts of target and background at each; of words, then of pairs."""
        out = []
        for seen, keys, order in zip((self.s[1:], self.pair), self.keys, self.order, strict=True):
            each = np.stack([np.bincount(seen[self.side[self.doc] == t], minlength=len(keys)) for t in (True, False)])
            out.append((keys[order], each[:, order]))
        return out


def requests(marked: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, kind (0 words, 1 pairs), keys, target, background: packed counts of a block's keys."""

    def send(batches):
        for batch in batches:
            for r in batch.to_pylist():
                block, out = _Block(np.array(r["n_words"], np.int64), r["codes"], r["hashes"], np.array(r["targets"] or [], np.int64)), []
                for kind, (keys, n) in enumerate(block.counts()):
                    cuts = np.searchsorted(((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))
                    for b in np.flatnonzero(np.diff(cuts)):
                        part = slice(cuts[b], cuts[b + 1])
                        steps = np.diff(keys[part], prepend=np.uint64(0))
                        out.append((int(b), r["block"], kind, pack(steps), *(pack(x[part].astype(np.uint32)) for x in n)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["bucket", "block", "kind", "keys", "target", "background"])

    return marked.select("block", "n_words", "codes", "hashes", "targets").mapInArrow(send, "bucket int, block long, kind int, keys binary, target binary, background binary")


def sums(asked: DataFrame) -> DataFrame:
    """block, bucket, kind, target, background: the corpus's counts at the keys that were sent, in their order; words: how many
    different words the bucket has, in one of its rows; stored."""
    schema = "block long, bucket int, kind int, target binary, background binary, words long"

    def add(part: pa.Table) -> pa.Table:
        out = []
        for kind in (0, 1):
            rows = part.filter(pa.compute.equal(part["kind"], kind)).to_pylist()
            if not rows:
                continue
            keys = [np.cumsum(unpack(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
            different, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = [np.bincount(at, np.concatenate([unpack(r[side], np.uint32) for r in rows]), len(different))[at].astype(np.uint64) for side in ("target", "background")]
            ends = np.cumsum([0, *map(len, keys)])
            out += [(r["block"], r["bucket"], kind, *(pack(t[a:b]) for t in total), len(different) if kind == 0 and a == 0 else 0) for r, a, b in zip(rows, ends, ends[1:], strict=False)]
        types = pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["block", "bucket", "kind", "target", "background", "words"])

    return stored(asked.groupBy("bucket").applyInArrow(add, schema), "sums")


def losses(block: _Block, found: list[np.ndarray], totals: np.ndarray, vocabulary: int, strength: float) -> np.ndarray:
    """Mean losses of the documents with words: target, then background.  found: of words and of pairs, the counts at their
    sorted keys (2 x keys); totals: words and ends of each side."""
    at = []
    for n, order in zip(found, block.order, strict=True):
        put = np.empty_like(n)
        put[:, order] = n
        at.append(put)
    word, begins = block.s[1:], np.zeros(len(block.doc), bool)
    begins[block.start] = True
    own_word, own_pair = (np.unique(block.doc * np.int64(len(k)) + x, return_inverse=True, return_counts=True)[1:] for k, x in zip(block.keys, (word, block.pair), strict=True))
    own_word, own_pair = own_word[1][own_word[0]], own_pair[1][own_pair[0]]
    own_before = np.where(begins, 1, np.concatenate([[0], own_word[:-1]]))
    out = np.empty((2, len(block.start)))
    length = np.diff(np.concatenate([block.start, [len(block.doc)]]))
    rest = np.stack([totals[side] - np.where(block.side == (side == 0), length, 0) for side in (0, 1)])
    mass = rest.min(0)
    for side in (0, 1):
        mine = block.side[block.doc] == (side == 0)
        f = np.divide(mass, rest[side], out=np.zeros(len(mass)), where=rest[side] > 0)[block.doc]
        single = (f * (at[0][side][word] - mine * own_word) + 1) / (mass[block.doc] + vocabulary)
        p = (f * (at[1][side][block.pair] - mine * own_pair) + strength * single) / (f * (at[0][side][block.s[:-1]] - mine * own_before) + strength)
        out[side] = np.add.reduceat(-np.log(p), block.start) / length
    return out


def score(marked: DataFrame, found: DataFrame, totals: tuple[int, int], vocabulary: int, strength: float) -> DataFrame:
    """doc_id, n_words, loss_target, loss_background (means), score of every row."""
    id_type = marked.schema["doc_ids"].dataType.elementType
    first_type, names = to_arrow_type(id_type), ["doc_id", "n_words", "loss_target", "loss_background", "score"]

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        n, mean = np.array(r["n_words"], np.int64), np.zeros((2, len(r["n_words"])))
        block = _Block(n, r["codes"], r["hashes"], np.array(r["targets"] or [], np.int64))
        if len(block.start):
            rows = sorted(right.to_pylist(), key=lambda x: (x["kind"], x["bucket"]))
            sent = [np.stack([np.concatenate([unpack(x[s], np.uint64) for x in rows if x["kind"] == kind]) for s in ("target", "background")]).astype(np.int64) for kind in (0, 1)]
            mean[:, block.with_words] = losses(block, sent, np.array(totals), vocabulary, strength)
        values = pa.array(r["doc_ids"], first_type), *map(pa.array, (n, mean[0], mean[1], mean[0] - mean[1]))
        return pa.Table.from_arrays(list(values), names=names)

    return marked.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(rate, f"doc_id {id_type.simpleString()}, n_words long, loss_target double, loss_background double, score double")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, strength: float = STRENGTH, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Scores of all ``docs``; ``targets`` names in its first column the documents that the target model learns from."""
    made = blocks(docs, id_col, text_col, block_bytes)
    ids = targets.select(F.col(targets.columns[0]).alias("_id")).where("_id is not null").distinct()
    each = made.select("block", F.explode(F.arrays_zip("doc_ids", "n_words", F.sequence(F.lit(0), F.size("n_words") - 1).alias("nth"))).alias("d")).select("block", "d.*")
    chosen = stored(each.join(ids, F.col("doc_ids") == F.col("_id")).groupBy("block").agg(F.collect_list("nth").alias("targets"), F.sum(F.when(F.col("n_words") > 0, F.col("n_words") + 1)).alias("n")), "targets")
    size = made.agg(F.sum("keys").alias("keys"), F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda a, n: a + n + F.when(n > 0, 1).otherwise(0))).alias("n")).first()
    target = chosen.agg(F.sum("n")).first()[0] or 0
    marked = made.join(chosen.select("block", "targets"), "block", "left").drop("keys")
    found = sums(requests(marked, max(1, -(-(size.keys or 0) // bucket_keys))))
    vocabulary = found.agg(F.sum("words")).first()[0] or 1
    return score(marked, found.drop("words"), (target, (size.n or 0) - target), vocabulary, strength)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    found = cross_entropy_difference(table(spark, sf_dir, "documents"), good)
    return found.select("doc_id", "n_words", *(F.round(c, 5).alias(c) for c in ("loss_target", "loss_background", "score")))


SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS target,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
p AS (
  SELECT r, target, CASE WHEN i = 1 THEN '' ELSE ws[i - 1] END AS h, CASE WHEN i > len(ws) THEN '' ELSE ws[i] END AS c
  FROM (SELECT r, coalesce(target, false) AS target, ws, unnest(range(1, len(ws) + 2)) AS i FROM w WHERE len(ws) > 0)),
v AS (SELECT count(DISTINCT c) AS v FROM p),
al AS (SELECT count(*) FILTER (target) AS nt, count(*) FILTER (NOT target) AS nb FROM p),
one AS (SELECT c, count(*) FILTER (target) AS nt, count(*) FILTER (NOT target) AS nb FROM p GROUP BY c),
two AS (SELECT h, c, count(*) FILTER (target) AS nt, count(*) FILTER (NOT target) AS nb FROM p GROUP BY h, c),
own2 AS (SELECT r, target, h, c, count(*) AS n FROM p GROUP BY ALL),
own1 AS (SELECT r, c, count(*) AS n FROM p GROUP BY ALL),
own AS (SELECT r, count(*) AS n FROM p GROUP BY r),
x AS (
  SELECT o.r, o.n, CASE WHEN target THEN 1 ELSE 0 END AS mt, CASE WHEN target THEN 0 ELSE 1 END AS mb,
    two.nt AS hwt, two.nb AS hwb, o.n AS hw, ow.nt AS wt, ow.nb AS wb, w1.n AS w, oh.nt AS ht, oh.nb AS hb, h1.n AS h,
    least(al.nt - mt * own.n, al.nb - mb * own.n) AS m, CASE WHEN al.nt > mt * own.n THEN m::DOUBLE / (al.nt - mt * own.n) ELSE 0 END AS ft, CASE WHEN al.nb > mb * own.n THEN m::DOUBLE / (al.nb - mb * own.n) ELSE 0 END AS fb
  FROM own2 o JOIN two USING (h, c) JOIN one ow ON ow.c = o.c JOIN one oh ON oh.c = o.h JOIN own1 w1 ON w1.r = o.r AND w1.c = o.c
    JOIN own1 h1 ON h1.r = o.r AND h1.c = o.h JOIN own ON own.r = o.r CROSS JOIN al),
loss AS (
  SELECT r, n, -ln((ft * (hwt - mt * hw) + {STRENGTH}::DOUBLE * ((ft * (wt - mt * w) + 1) / (m + v)::DOUBLE)) / (ft * (ht - mt * h) + {STRENGTH}::DOUBLE)) AS lt,
    -ln((fb * (hwb - mb * hw) + {STRENGTH}::DOUBLE * ((fb * (wb - mb * w) + 1) / (m + v)::DOUBLE)) / (fb * (hb - mb * h) + {STRENGTH}::DOUBLE)) AS lb
  FROM x, v),
mean AS (SELECT r, sum(n * lt) / sum(n) AS lt, sum(n * lb) / sum(n) AS lb FROM loss GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(lt, 0), 5) AS loss_target, round(coalesce(lb, 0), 5) AS loss_background, round(coalesce(lt - lb, 0), 5) AS score
FROM w LEFT JOIN mean USING (r)
"""
