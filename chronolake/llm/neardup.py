"""Near duplicates by b-bit MinHash.

``sketch`` takes the set of distinct word shingles of every text, KEYS minima of it under multiplicative hashes, a
hash per band of minima, and the low bits of all minima packed into longs.  Texts with equal sets are one class with
one representative, so copies cost nothing further.  Representatives that share a band are candidates; the packed
bits estimate their similarity, corrected for chance agreement, by counting bits; an odd sketch of the set
bounds the difference from below; what neither rules out is confirmed on the full sets of both texts.

Pairs inside a band's bucket are not written out.  First every member is compared with the smallest one; then,
as links have joined most members, with other members that the buckets pick, where the two are not
connected yet; at last all pairs that are still unconnected and share a bucket of up to BUCKET members, the bit estimate
being part of the join's condition.  Texts of larger buckets meet by their rarest shingles instead (``rare_pairs``): two
sets can only be similar enough if the first few of each, in one order of all shingles, have one in common, so none is
missed, and a family of texts that share a template but not enough of it hardly meets.  What is never
compared is connected already or too different, so components are those of all links.
With BANDS of ROWS, a pair at 0.8 shares no band with a chance of 3e-6; the bits rule one out with less than 1e-6.

Nulls and edges: a text without words has the empty set, is its own component, and is kept; one word is
one shingle; a row with a null doc_id takes no part, has a null component and is kept; rows that repeat an id
are answered one by one: a document is an id with the hash of its text, so different texts of one id are linked by
what they say and not by the id; other columns are ignored, so names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, stored, table, words

BANDS, ROWS, BITS = 32, 5, 2
KEYS = BANDS * ROWS
LONGS = KEYS * BITS // 64
#: Longs of the odd sketch: bit i tells whether an odd number of shingles hash to i.
ODD = 32
#: Standard deviations of the estimate by which a pair may fall short of the threshold and still be confirmed;
#: rounds of picked members before the rest is joined; members of a bucket up to which its pairs are joined there.
SLACK, ROUNDS, BUCKET = 5.0, 3, 256


class _Hashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 19:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: bytes | None, hashes: dict, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; of fewer words, but some, the whole is one."""
    parts = list(words(text or b"", LOWER))
    n = sum(map(len, parts))
    one = np.fromiter(map(hashes.__getitem__, chain.from_iterable(parts)), np.uint64, n)
    if n == 0:
        return one
    size = min(size, n)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ one[k : n - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, KEYS, np.uint64) * np.uint64(2) + np.uint64(1)


def minima(found: np.ndarray, by: np.ndarray) -> np.ndarray:
    """For each multiplier the smallest upper half of the product, over all shingles."""
    best = np.full(len(by), (1 << 64) - 1, np.uint64)
    for k in range(0, len(found), 1024):
        np.minimum(best, (found[k : k + 1024, None] * by).min(0), out=best)
    return best >> np.uint64(32)


def band_hashes(low: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        out = (out ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    bits = (low & np.uint64((1 << BITS) - 1)).reshape(LONGS, 64 // BITS) << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(bits, 1).view(np.int64)


def odd_sketch(found: np.ndarray) -> np.ndarray:
    bits = np.bincount((found & np.uint64(64 * ODD - 1)).astype(np.int64), minlength=64 * ODD) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketch(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (hash of the whole set), bands, low (packed bits), odd (odd sketch) of every
    row, stored."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make(batches):
        hashes, by = _Hashes(), _multipliers()
        for batch in batches:
            n, a, b, bands, low, odd = [], [], [], [], [], []
            for text in pa.compute.cast(batch.column(1), pa.binary()):
                found = shingles(text.as_py(), hashes, size)
                whole = xxhash.xxh128_digest(found.tobytes())
                least = minima(found, by)
                n.append(len(found))
                a.append(int.from_bytes(whole[:8], "little", signed=True))
                b.append(int.from_bytes(whole[8:], "little", signed=True))
                bands.append(band_hashes(least))
                low.append(packed(least))
                odd.append(odd_sketch(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, a, b)), *(pa.array(x, pa.list_(pa.int64())) for x in (bands, low, odd))], names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "low", "odd"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(make, f"doc_id {id_type}, n_shingles long, set_a long, set_b long, bands array<long>, low array<long>, odd array<long>"), "sketches")


def estimate(a: Column, b: Column) -> Column:
    """Similarity that two packed signatures show, corrected for low bits that agree by chance."""
    differ = F.lit(0)
    mask = int("01" * (64 // BITS), 2)
    for k in range(LONGS):
        x = a[k].bitwiseXOR(b[k])
        for shift in range(1, BITS):
            x = x.bitwiseOR(F.shiftrightunsigned(a[k].bitwiseXOR(b[k]), shift))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(mask)))
    chance = 1 / (1 << BITS)
    return (1 - differ / F.lit(float(KEYS)) - chance) / (1 - chance)


def _likely(threshold: float, a: str, b: str) -> Column:
    """Neither the sizes nor the bits rule the pair of signature structs out.

    The odd sketches differ in no more bits than the sets in shingles, so they never rule out a link."""
    chance = 1 / (1 << BITS)
    p = chance + (1 - chance) * threshold
    least = threshold - SLACK * (p * (1 - p) / KEYS) ** 0.5 / (1 - chance)
    share, n_a, n_b = round(100 * threshold), F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * share
    differ = F.lit(0)
    for k in range(ODD):
        differ = differ + F.bit_count(F.col(f"{a}.odd")[k].bitwiseXOR(F.col(f"{b}.odd")[k]))
    return sizes & (estimate(F.col(f"{a}.low"), F.col(f"{b}.low")) >= least) & (differ * (100 + share) <= (n_a + n_b) * (100 - share))


def rare_pairs(members: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """a, b: every pair of ``members`` (doc_id, comp, sign) of different comp that can reach ``threshold``; none that does is missed.

    Shingles are ordered by the number of members that have them.  Of n shingles, similar sets share one of the first
    n - ceil(t n) + 1 of the one and, the other being no larger, of the first m - ceil(2 t m / (1 + t)) + 1 of its m.
    Under a shingle whose members are mostly connected, only those outside the largest component meet all others."""
    share, id_type = round(100 * threshold), members.schema["doc_id"].dataType.simpleString()

    def spread(batches):
        hashes = _Hashes()
        for batch in batches:
            for row in range(batch.num_rows):
                found = shingles(pa.compute.cast(batch.column(1).slice(row, 1), pa.binary())[0].as_py(), hashes, size).view(np.int64)
                for k in range(0, len(found), 1 << 16):
                    part = pa.array(found[k : k + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(part), row))), part], names=["doc_id", "shingle"])

    of_texts = texts.select("doc_id", "text").join(members.select("doc_id"), "doc_id", "left_semi")
    each = stored(of_texts.mapInArrow(spread, f"doc_id {id_type}, shingle long"), "shingles")
    often = each.groupBy("shingle").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("often", "shingle"))
    first = each.join(often, "shingle").withColumn("nth", rank).join(members, "doc_id")
    n = F.col("sign.n")
    first = first.where((F.col("often") > 1) & (F.col("nth") <= n - F.ceil(n * share / 100) + 1))
    first = first.withColumn("small", F.col("nth") <= n - F.ceil(n * (2 * share) / (100 + share)) + 1).select("shingle", "nth", "small", "doc_id", "comp", "sign")
    main = first.groupBy("shingle", "comp").count().groupBy("shingle").agg(F.max(F.struct("count", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("shingle", F.col("m.comp").alias("main"))
    first = stored(first.join(main, "shingle").select("*", (F.col("comp") == F.col("main")).alias("inside")).drop("main"), "first_shingles")

    def meet(large: DataFrame, small: DataFrame) -> DataFrame:
        small = small.where("small").select("shingle", *(F.col(c).alias(f"other_{c}") for c in ("nth", "comp", "sign")), F.col("doc_id").alias("other"))
        n, m = F.col("sign.n"), F.col("other_sign.n")
        ordered = (m < n) | ((m == n) & (F.col("other") < F.col("doc_id")))
        left = 1 + F.least(n - F.col("nth"), m - F.col("other_nth"))
        reach = left * (100 + share) >= (n + m) * share
        return large.join(small, "shingle").where((F.col("comp") != F.col("other_comp")) & ordered & reach & _likely(threshold, "sign", "other_sign"))

    met = meet(first.where("NOT inside"), first).unionByName(meet(first.where("inside"), first.where("NOT inside")))
    return met.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """The pairs a, b whose full shingle sets have a similarity of at least ``threshold``."""
    share, id_type = round(100 * threshold), pairs.schema["a"].dataType.simpleString()
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def verify(batches):
        hashes = _Hashes()
        for batch in batches:
            last, kept, good = None, None, []
            text_b = pa.compute.cast(batch.column("text_b"), pa.binary())
            for a, x, y in zip(batch.column("a"), pa.compute.cast(batch.column("text_a"), pa.binary()), text_b, strict=True):
                if a != last:
                    last, kept = a, shingles(x.as_py(), hashes, size)
                other = shingles(y.as_py(), hashes, size)
                common = len(np.intersect1d(kept, other, assume_unique=True))
                good.append(100 * common >= share * (len(kept) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(verify, f"a {id_type}, b {id_type}")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) for the nodes of ``edges`` (a, b): alternating large and small stars."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    seen = None
    while True:
        mark = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        seen = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), "edges")


def _labelled(rows: DataFrame, column: str, labels: DataFrame, to: str) -> DataFrame:
    """rows with ``to``: the component of ``column``, itself where it has no link."""
    found = labels.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
    return rows.join(found, F.col(column) == F.col("_node"), "left").withColumn(to, F.coalesce("_comp", column)).drop("_node", "_comp")


def _node(id_col: str, text_col: str) -> Column:
    """A document: its id, and the hash of its text; the smallest of a group has the smallest id."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))


def _components_of(docs: DataFrame, threshold: float, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id (see ``_node``), n_shingles, component (the smallest document reachable; null without id) of every row."""
    spark = docs.sparkSession
    text = docs.select(_node(id_col, text_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = sketch(text, size)
    some = rows.where("n_shingles > 0 AND doc_id.id IS NOT NULL")
    classes = stored(some.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    reps = stored(some.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.col("n_shingles").alias("n"), "bands", "low", "odd").dropDuplicates(["doc_id"]), "representatives")
    each = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    several = stored(each.groupBy("band", "key").agg(F.min("doc_id").alias("first"), F.count("*").alias("m")).where("m > 1"), "buckets")
    members = stored(each.join(several, ["band", "key"]), "members")
    ids = stored(members.select("doc_id").distinct(), "member_ids")
    texts = stored(text.join(ids.hint("shuffle_merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    signs = stored(reps.join(ids, "doc_id", "left_semi").select("doc_id", F.struct("n", "low", "odd").alias("sign")), "signs")

    id_type = text.schema["doc_id"].dataType.simpleString()
    labels = spark.createDataFrame([], f"node {id_type}, comp {id_type}")
    tested = spark.createDataFrame([], f"a {id_type}, b {id_type}")
    for step in range(ROUNDS + 2):
        if step == 0:
            met = members.where("doc_id != first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
            for side in "ab":
                met = met.join(signs.select(F.col("doc_id").alias(side), F.col("sign").alias(f"sign_{side}")), side)
            pairs = met.where(_likely(threshold, "sign_a", "sign_b"))
        else:
            at = _labelled(members.where("m > 2"), "doc_id", labels, "comp")  # the one pair of two is tested
            open_ = at.groupBy("band", "key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("band", "key")
            at = stored(at.join(open_, ["band", "key"]).join(signs, "doc_id").select("band", "key", "m", "doc_id", "comp", "sign"), "open")
            if at.isEmpty():
                break
            if step <= ROUNDS:
                picks = at.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("doc_id", "band", F.lit(step)).alias("h"), F.col("doc_id").alias("other"), F.col("comp").alias("other_comp"), F.col("sign").alias("other_sign"))).alias("pick")).select("band", "key", "pick.*")
                met = at.join(picks, ["band", "key"]).where((F.col("comp") != F.col("other_comp")) & _likely(threshold, "sign", "other_sign"))
            else:
                few, many = at.where(F.col("m") <= BUCKET), stored(at.where(F.col("m") > BUCKET).select("doc_id", "comp", "sign").dropDuplicates(["doc_id"]), "in_large")
                other = few.select("band", "key", *(F.col(c).alias(f"other_{c}") for c in ("comp", "sign")), F.col("doc_id").alias("other"))
                met = few.join(other, ["band", "key"]).where((F.col("comp") < F.col("other_comp")) & _likely(threshold, "sign", "other_sign"))
            met = met.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b"))
            if step > ROUNDS and not many.isEmpty():
                met = met.unionByName(rare_pairs(many, texts, threshold, size))
            pairs = met.distinct().join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs.select("a", "b"), "pairs")
        tested = tested.unionByName(pairs)
        links = stored(confirmed(pairs, texts, threshold, size), "links")
        if links.isEmpty():
            continue
        merged = _labelled(_labelled(links, "a", labels, "ca"), "b", labels, "cb")
        joined = components(merged.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        known = labels.select("node", "comp").unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("comp"))).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("comp")))
        # a node's earlier component, or itself, then what that one was joined to
        known = known.groupBy("node").agg(F.min("comp").alias("comp"))
        labels = stored(_labelled(known, "comp", joined, "to").select("node", F.col("to").alias("comp")), "labels")
    found = stored(_labelled(classes, "rep", labels, "component"), "class_components").select("set_a", "set_b", "component")
    out = rows.select("doc_id", "n_shingles", "set_a", "set_b").join(found, ["set_a", "set_b"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id.id").isNotNull(), F.coalesce("component", "doc_id")).alias("component"))


def linked_components(docs: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept (that is the row's own id, or it has none) of every row."""
    found = _components_of(docs, threshold, size, id_col, text_col)
    kept = F.coalesce(F.col("doc_id.id") == F.col("component.id"), F.lit(True))
    return found.select(F.col("doc_id.id").alias("doc_id"), "n_shingles", F.col("component.id").alias("component_id"), kept.alias("kept"))


def unique(docs: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the smallest id, once.

    Different texts of one id are different documents; of those in one component the one with the smallest hash stays."""
    found = stored(_components_of(docs, threshold, size, id_col, text_col).where("doc_id.id IS NOT NULL"), "documents")
    bad = found.where("doc_id != component").select(F.col("doc_id").alias("_bad")).distinct()
    again = stored(found.where("doc_id = component").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")), "repeated")
    left = docs.withColumn("_chronolake_row", _node(id_col, text_col))
    left = left.join(bad, F.col("_chronolake_row") == F.col("_bad"), "left_anti")
    if not again.isEmpty():
        once = left.join(again, F.col("_chronolake_row") == F.col("_again"), "left_semi").dropDuplicates(["_chronolake_row"])
        left = left.join(again, F.col("_chronolake_row") == F.col("_again"), "left_anti").unionByName(once)
    return left.drop("_chronolake_row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"), size=2)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws)))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (sh) WHERE x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT x, b FROM reach JOIN edge ON y = a),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""
