"""Phrase collocations mined per language by hashed bucket counts, bitmaps and the Apriori rule.

A pass over the texts for each length.  Pass n counts phrases of n words and, by a hash, all phrases of n + 1 words in BUCKETS counters; a
counter stops at the support, which changes no answer to the question whether it was reached.  What the next pass counts are the phrases of n + 1 words whose bucket reached the
support and both of whose parts of n words did: these are looked up in a bitmap of the same size that the counted phrases were hashed into.  Bitmaps are
the only thing broadcast, BUCKETS bits each at every size of the input.  They let too much pass, never too little; what passes is counted as text, so counts are exact.

Tasks count in a dictionary that is handed on when it holds FLUSH phrases, OUT at once; Spark adds up the rest, with partial sums before the shuffle.  Scores join
each candidate with the counts of its parts, all of which are frequent themselves.  Products are decimals of 38 digits.

Nulls and edges: a null text is empty, a null language is ``und``; languages with no words have no rows; equal rows count as often as they are there; a piece may run
over many megabytes, it is read in parts that overlap by the words of a phrase; a phrase's words are joined by one blank; other columns are ignored, so names
cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SUPPORT, LONGEST, TOP, COVERED, SCALE = 30, 4, 2000, 80, 2_000_000
#: Counters and bits of each bitmap (a multiple of 8); counters of a row on the way to their sum; phrases that a task holds, and hands on at once; bytes read at once.
BUCKETS, CHUNK, FLUSH, OUT, PART = 1 << 22, 1 << 12, 1 << 17, 1 << 14, 1 << 19
#: A-Z to lower case; tabs become blanks, the marks ``[.,;:!?\x0A-\x0D]`` all become ``.``, which no word can hold.
FOLD = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
COUNTS, SUMS = "lang string, phrase string, a long", "chunk int, counts binary"
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def pieces(texts: list[bytes], longest: int, part: int = PART):
    """(flat, fresh): words of the texts joined by one blank, with a ``.`` between pieces; the first ``fresh`` words were there in the part before and are repeated for the phrases that go over."""
    flat = b" . ".join(texts).translate(FOLD).replace(b".", b" . ")
    while b"  " in flat:
        flat = flat.replace(b"  ", b" ")
    flat = flat.strip(b" ")
    start, fresh, after = 0, 0, 0
    while after < len(flat):
        end = -1 if len(flat) - after <= part else flat.find(b" ", after + part)
        end = len(flat) if end < 0 else end
        yield flat[start:end], fresh
        start, fresh, after = end + 1, 0, end + 1
        while fresh < longest - 1 and start > 0:
            start, fresh = flat.rfind(b" ", 0, start - 1) + 1, fresh + 1


def hashed(flat: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``flat``, and 64 hashed bits of each; 0 of a mark.  Equal words have equal bits wherever they stand."""
    data = np.frombuffer(flat, np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    powers, back = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * powers[: len(data)], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * back[starts]) | np.uint64(1)
    words[data[starts] == 46] = 0
    return starts, ends, words


_LETTERS = np.array([xxhash.xxh64_intdigest(bytes([c]), 7) for c in range(256)], np.uint64)
_tables: dict[str, np.ndarray] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, in 64 bits."""
    if len(_tables.get("powers", ())) < size:
        for name, base in (("powers", _BASE), ("back", _BACK)):
            factors = np.full(max(size, PART + (1 << 16)), base, np.uint64)
            factors[0] = 1
            _tables[name] = np.cumprod(factors, dtype=np.uint64)
    return _tables["powers"], _tables["back"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def grams(words: np.ndarray, lang: int, longest: int) -> list[np.ndarray]:
    """For n from 1 to ``longest``, the hashes of the n words from each place; those that run over an end or a mark are 0."""
    none, out = words == 0, []
    h, bad = _mix(words ^ np.uint64(lang)), none
    out.append(np.where(bad, np.uint64(0), h))
    for n in range(2, longest + 1):
        if len(words) < n:
            out.append(np.zeros(0, np.uint64))
            continue
        h, bad = _mix(h[:-1] * np.uint64(3) + words[n - 1 :]), bad[:-1] | none[n - 1 :]
        out.append(np.where(bad, np.uint64(0), h | np.uint64(1)))
    return out


def bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(20)) % np.uint64(buckets)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    b = bucket(h, 8 * len(bits))
    return ((bits[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1).astype(bool) & (h != 0)


class _Buckets:
    """Counters that stop at ``most``."""

    def __init__(self, most: int, buckets: int) -> None:
        self.most, self.counts = min(most, 255), np.zeros(buckets, np.uint8)

    def add(self, h: np.ndarray) -> None:
        at, n = np.unique(bucket(h[h != 0], len(self.counts)).astype(np.int64), return_counts=True)
        self.counts[at] = np.minimum(self.counts[at].astype(np.int64) + n, self.most)

    def rows(self):
        for chunk in range(-(-len(self.counts) // CHUNK)):
            counts = self.counts[chunk * CHUNK : (chunk + 1) * CHUNK]
            if counts.any():
                yield chunk, counts.tobytes()


def survivors(hashes: list[np.ndarray], n: int, parts: np.ndarray | None, heavy: np.ndarray | None) -> np.ndarray:
    """At which places a phrase of n words may be frequent: both its parts are in ``parts`` and its bucket in ``heavy``."""
    h = hashes[n - 1]
    if n == 1 or not len(h):
        return h != 0
    shorter = _has(parts, hashes[n - 2])
    return shorter[:-1] & shorter[1:] & _has(heavy, h)


def passed(texts: DataFrame, n: int, longest: int, support: int, parts: np.ndarray | None, heavy: np.ndarray | None, buckets: int = BUCKETS) -> DataFrame:
    """Pass n: rows (lang, phrase, a) of counted phrases, and rows (chunk, counts) of the buckets of phrases of n + 1 words."""
    spark = texts.sparkSession
    given = spark.sparkContext.broadcast((parts, heavy))  # BUCKETS bits each

    def count(batches):
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])
        parts, heavy = given.value
        counted, sums = {}, _Buckets(support, buckets) if n < longest else None

        def flush():
            for lang, found in counted.items():
                rows = iter(found.items())
                while some := list(islice(rows, OUT)):
                    phrases = [p.decode("utf-8", "replace") for p, _ in some]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(phrases, pa.string()), pa.array([a for _, a in some], pa.int64()), pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary())], schema=schema)
            counted.clear()

        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, some in by_lang.items():
                seed, found = xxhash.xxh64_intdigest(lang.encode()), counted.setdefault(lang, Counter())
                for flat, fresh in pieces(some, n + 1):
                    starts, ends, words = hashed(flat)
                    hashes = grams(words, seed, min(n + 1, longest))
                    may = survivors(hashes, n, parts, heavy)
                    at = np.flatnonzero(may)
                    at = at[at >= fresh - n + 1] if fresh else at
                    if n == 1:
                        found.update(flat.split(b" ")[fresh:])
                        found.pop(b".", None)
                    else:
                        found.update([flat[i:j] for i, j in zip(starts[at].tolist(), ends[at + n - 1].tolist(), strict=True)])
                    if sums is not None and len(hashes[n]):
                        both = may[:-1] & may[1:]
                        both[: max(fresh - n, 0)] = False
                        sums.add(hashes[n][both])
                if sum(map(len, counted.values())) >= FLUSH:
                    yield from flush()
        yield from flush()
        if sums is not None:
            rows = list(sums.rows())
            for start in range(0, len(rows), 256):
                part = rows[start : start + 256]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.string()), pa.nulls(len(part), pa.string()), pa.nulls(len(part), pa.int64()), pa.array([c for c, _ in part], pa.int32()), pa.array([b for _, b in part], pa.binary())], schema=schema)

    return texts.mapInArrow(count, f"{COUNTS}, {SUMS}")


def bitmap(rows: DataFrame, least: int, buckets: int = BUCKETS) -> np.ndarray:
    """``buckets`` bits: which counters, added up over all rows (chunk, counts), are at least ``least``."""

    def add(batches):
        chunk, total = None, None

        def bits():
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(total >= min(least, 255), bitorder="little").tobytes()], pa.binary())], ["chunk", "counts"])

        for batch in batches:
            for c, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if c != chunk:
                    if chunk is not None:
                        yield bits()
                    chunk, total = c, np.zeros(CHUNK, np.int64)
                total[: len(counts)] += np.frombuffer(counts, np.uint8)
        if chunk is not None:
            yield bits()

    out = np.zeros(buckets // 8, np.uint8)
    found = rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, SUMS).toArrow()  # at most buckets / 8 bytes
    for c, part in zip(found["chunk"].to_pylist(), found["counts"].to_pylist(), strict=True):
        place = out[c * CHUNK // 8 : (c + 1) * CHUNK // 8]
        place[:] = np.frombuffer(part, np.uint8)[: len(place)]
    return out


def members(phrases: DataFrame, n: int, buckets: int = BUCKETS) -> np.ndarray:
    """``buckets`` bits: the buckets that the phrases of n words (lang, phrase) fall into."""

    def mark(batches):
        marked = _Buckets(1, buckets)
        for batch in batches:
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                marked.add(grams(hashed(phrase.encode())[2], xxhash.xxh64_intdigest(lang.encode()), n)[n - 1])
        rows = list(marked.rows())
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["chunk", "counts"])

    return bitmap(phrases.select("lang", "phrase").mapInArrow(mark, SUMS), 1, buckets)


def frequent(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, buckets: int = BUCKETS, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all phrases of up to ``longest`` words that are there ``support`` times (255 at most for the buckets, which then let more pass), and (lang, n) with all words of each language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    parts = heavy = every = sizes = None
    for n in range(1, longest + 1):
        rows = stored(passed(texts, n, longest, support, parts, heavy, buckets), f"pass{n}")
        sums = rows.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
        found = stored(sums.where(F.col("a") >= support).withColumn("words", F.lit(n)), f"frequent{n}")
        if n == 1:
            sizes = stored(rows.where("phrase is not null").groupBy("lang").agg(F.sum("a").alias("n")), "sizes")
        if n < longest:
            parts, heavy = members(found, n, buckets), bitmap(rows.where("chunk is not null").select("chunk", "counts"), support, buckets)
        every = found if every is None else every.unionByName(found)
    return every, sizes


def _span(words, start, count):
    return F.array_join(F.slice(words, start, count), " ")


def scored(every: DataFrame, sizes: DataFrame, covered: int = COVERED, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of two words and more that no longer one covers."""
    big = lambda c: F.col(c).cast("decimal(20,0)")
    candidates = every.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _span("w", F.lit(1), F.col("k")).alias("left"), _span("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    left, right = every.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), every.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    scores = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("_a", big("a")).withColumn("_lr", (big("l") + big("r")).cast("decimal(21,0)"))
    scores = scores.withColumn("score", F.expr(f"({SCALE} * _a) div _lr"))
    best = scores.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inside = candidates.where("words > 2").select("lang", F.col("a").alias("longer"), "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inside = inside.select("lang", "longer", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("s"))
    most = inside.groupBy("lang", _span("w", F.col("s"), F.col("m")).alias("phrase")).agg(F.max("longer").alias("longer"))
    left_over = best.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * big("longer") < covered * big("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    flat = left_over.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score")).withColumn("rank", F.row_number().over(order).cast("long"))
    ranked = flat if top is None else flat.where(F.col("rank") <= top)
    return ranked.join(F.broadcast(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(*frequent(table(spark, sf_dir, "documents")))


SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, phrase, words, count(*) AS a
  FROM (SELECT lang, words, unnest(list_transform(range(1, greatest(len(w) - words + 2, 1)), lambda i: array_to_string(w[i:i + words - 1], ' '))) AS phrase
    FROM w, (SELECT unnest([1, 2, 3, 4]) AS words))
  GROUP BY lang, phrase, words HAVING count(*) >= {SUPPORT}),
c AS (SELECT lang, phrase, words, a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
cuts AS (SELECT lang, phrase, a, w, words, unnest(range(1, words)) AS k FROM c),
scores AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, x.a AS l, y.a AS r, ({SCALE}::HUGEINT * cuts.a // (x.a::HUGEINT + y.a))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.w[1:k], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.w[k + 1:], ' ')),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, w, a, words, m, unnest(range(1, words - m + 2)) AS s FROM (SELECT *, unnest(range(2, words)) AS m FROM c)),
most AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS longer FROM parts GROUP BY ALL)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
  FROM best LEFT JOIN most USING (lang, phrase) WHERE longer IS NULL OR 100 * longer::HUGEINT < {COVERED} * a::HUGEINT) JOIN sizes USING (lang)
WHERE rank <= {TOP}
"""
