"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of the training tokens: one row per shard of whole documents, with the
positions of every term.  The index is partitioned by document, so a posting never leaves the shard that
made it: a frequent term costs each shard its own share and no key is shuffled.  ``build_windows`` cuts the test
items into phrases, a table of its own, and puts the terms of each in order of their number of postings in the whole
corpus.  ``search`` intersects the offset-adjusted lists of each phrase from the rarest term on, and, where a slop is
given, finds the places where all its terms stand close to the rarest one.

Phrases are searched ``BLOCK_WINDOWS`` at a time, each block by one pass over the index, whatever the size of the benchmark: a
block is what the driver and a broadcast hold.  Words longer than LONGEST bytes stand in index and phrases as their 128-bit
hash, so a phrase, and with it a block, has a largest size.

Nulls and edges: a null or empty text has no words and is returned with zeros; rows that repeat an id are
answered one by one; a null doc_id is carried along; a test item without words has no window; the windows
of an item with a null id hit words but are not counted as an item; columns other than the two named ones
are ignored, so their names cannot clash.  An empty table gives an empty result, an empty benchmark zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from .common import ALNUM, pack, row_key, stored, table, unpack, words

#: Text bytes of a shard, phrases of a block, bytes of a word that is posted as it is, candidate places tested in one go.
SHARD_BYTES, BLOCK_WINDOWS, LONGEST, CHUNK = 4 << 20, 1 << 17, 64, 1 << 20
#: Words of a phrase, and how far from its rarest word the others may stand to be near.
LENGTH, SLOP = 10, 20


def _terms(text: bytes | None) -> Iterator[list[bytes]]:
    for part in words(text or b"", ALNUM):
        yield part if max(map(len, part), default=0) <= LONGEST else [w if len(w) <= LONGEST else b"\0" + xxhash.xxh128_digest(w) for w in part]


def _shards(batches, schema: pa.Schema, shard_bytes: int):
    """Rows of the index.  Positions run through a shard, with one free position between documents."""
    task, number = TaskContext.get().partitionId(), 0
    ids: list = []
    vocab: dict[bytes, int] = {}
    starts, codes, places, at, size = [0], [], [], 0, 0

    def row():
        names = list(vocab)
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        counts = np.bincount(code, minlength=len(names))
        place = place[order]
        steps = np.diff(place, prepend=0).astype(np.int32)  # positions of a term grow; a new term may step back
        one = [f"{task}-{number}"], [ids], [starts], [names], [counts], [pack(steps)]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(one, schema, strict=True)], schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), pa.compute.cast(batch.column(1), pa.binary()), strict=True):
            text = text.as_py()
            for part in _terms(text):
                codes.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in part), np.int64, len(part)))
                places.append(np.arange(at, at + len(part)))
                at += len(part)
            at += 1
            ids.append(doc_id)
            starts.append(at)
            size += len(text or b"")
            if size >= shard_bytes or len(ids) >= 1 << 16:
                yield row()
                ids, starts, vocab, codes, places, at, size, number = [], [0], {}, [], [], 0, 0, number + 1
    if ids:
        yield row()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of ``docs``, stored: shard, doc_ids, starts (one more than doc_ids), terms, counts, positions (packed steps)."""
    id_type = docs.schema[id_col].dataType
    first_type = to_arrow_type(id_type)

    def index(batches):
        arrow = pa.schema([("shard", pa.string()), ("doc_ids", pa.list_(first_type)), ("starts", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("positions", pa.binary())])
        return _shards(batches, arrow, shard_bytes)

    schema = f"shard string, doc_ids array<{id_type.simpleString()}>, starts array<int>, terms array<binary>, counts array<int>, positions binary"
    return stored(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(index, schema), "postings")


def windows(tokens: list[bytes], length: int) -> list[list[bytes]]:
    """All runs of ``length`` words; of fewer words, but some, the whole."""
    return [tokens[k : k + length] for k in range(max(1, len(tokens) - length + 1))] if tokens else []


def build_windows(index: DataFrame, items: DataFrame, length: int = LENGTH, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """window, terms (n, term, shift; rarest first) of the different phrases of ``items`` whose words all occur; and window, item."""
    id_type = items.schema[id_col].dataType
    first_type = to_arrow_type(id_type)

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), pa.compute.cast(batch.column(1), pa.binary()), strict=True):
                found = windows([w for part in _terms(text.as_py()) for w in part], length)
                for k in range(0, len(found), 1 << 14):
                    some = found[k : k + (1 << 14)]
                    names = [xxhash.xxh128_digest(b" ".join(x)) for x in some]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([item] * len(some), first_type), pa.array(some, pa.list_(pa.binary()))], names=["window", "item", "terms"])

    rows = items.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(cut, f"window binary, item {id_type.simpleString()}, terms array<binary>")
    rows = stored(rows.dropDuplicates(["window", "item"]), "windows")
    phrases = rows.groupBy("window").agg(F.any_value("terms").alias("terms"))
    each = stored(phrases.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("shift", "term")), "window_terms")
    postings = index.select(F.inline(F.arrays_zip("terms", "counts"))).join(each.select(F.col("term").alias("terms")).distinct(), "terms", "left_semi")
    counts = stored(postings.groupBy("terms").agg(F.sum("counts").alias("n")), "term_counts")
    known = each.join(counts.withColumnRenamed("terms", "term"), "term")
    ordered = known.groupBy("window", "size").agg(F.sort_array(F.collect_list(F.struct("n", "term", "shift"))).alias("terms")).where("size(terms) = size")
    return stored(ordered.select("window", "terms"), "ordered_windows"), rows.select("window", "item")


class _Windows:
    """A block of phrases; of each, the terms from the rarest on and their offsets.

    The vocabulary is one Arrow array, the phrases are matrices: what is broadcast has a few hundred bytes a phrase."""

    def __init__(self, rows: pa.Table):
        terms = pa.concat_arrays(rows["terms"].chunks) if rows.num_rows else pa.array([], pa.list_(pa.struct([("n", pa.int64()), ("term", pa.binary()), ("shift", pa.int32())])))
        self.names = pa.concat_arrays(rows["window"].chunks) if rows.num_rows else pa.array([], pa.binary())
        flat = terms.flatten()
        coded = flat.field("term").dictionary_encode()
        self.vocab = coded.dictionary
        self.size = np.diff(terms.offsets.to_numpy()).astype(np.int32)
        longest = int(self.size.max(initial=1))
        row, column = np.repeat(np.arange(len(terms)), self.size), np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.terms, self.shift = np.zeros((2, len(terms), longest), np.int32)
        self.terms[row, column], self.shift[row, column] = coded.indices.to_numpy(), flat.field("shift").to_numpy()
        self.by_anchor = np.argsort(self.terms[:, 0], kind="stable")
        self.anchor_from = np.searchsorted(self.terms[self.by_anchor, 0], np.arange(len(self.vocab) + 1))


class _Postings:
    """The postings that a shard has for the terms of a block, as sorted keys term * span + position."""

    def __init__(self, row: dict, win: _Windows):
        self.starts = row["starts"].astype(np.int64)
        self.span = int(self.starts[-1]) + 1
        found = pa.compute.index_in(row["terms"], value_set=win.vocab)
        code = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        each = np.repeat(code, row["counts"])
        place = np.cumsum(unpack(row["positions"], np.int32), dtype=np.int64)
        self.keys = np.sort((each * self.span + place)[each >= 0])
        self.codes = np.sort(code[code >= 0])

    def of(self, code: int) -> np.ndarray:
        a, b = np.searchsorted(self.keys, (code * self.span, (code + 1) * self.span))
        return self.keys[a:b] - code * self.span

    def within(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term stands at a place from low to high."""
        at = np.searchsorted(self.keys, codes * self.span + np.maximum(low, 0))
        return (high >= 0) & (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= codes * self.span + np.minimum(high, self.span - 1))


def _candidates(index: _Postings, win: _Windows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows and the places of their rarest terms, some at a time."""
    held, count = [], 0
    for code in index.codes:
        owners = win.by_anchor[win.anchor_from[code] : win.anchor_from[code + 1]]
        if not len(owners):
            continue
        places = index.of(code)
        step = max(1, CHUNK // len(owners))
        for k in range(0, len(places), step):
            part = places[k : k + step]
            held.append((np.repeat(owners, len(part)), np.tile(part, len(owners))))
            count += len(owners) * len(part)
            if count >= CHUNK:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, count = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _intersect(index: _Postings, win: _Windows, w: np.ndarray, at: np.ndarray, slop: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The windows and places that hold: each further term at its own offset, or within ``slop`` words in the same document."""
    doc = np.searchsorted(index.starts, at, "right") - 1
    first, last = index.starts[doc], index.starts[doc + 1] - 1
    for r in range(1, win.terms.shape[1]):
        codes = win.terms[w, r].astype(np.int64)
        if slop is None:
            low = high = at + win.shift[w, r] - win.shift[w, 0]
        else:
            low, high = np.maximum(at - slop, first), np.minimum(at + slop, last)
        keep = (win.size[w] <= r) | index.within(codes, low, high)
        w, at, first, last = w[keep], at[keep], first[keep], last[keep]
        if not len(w):
            break
    return w, at


def _matches(row: dict, win: _Windows, slop: int | None) -> Iterator[dict]:
    """Of each document of a shard with a match: merged hit spans in words, its windows, and its near windows."""
    index = _Postings(row, win)
    found: list[list] = [[], []]
    if len(index.keys):
        for w, at in _candidates(index, win):
            found[0].append(_intersect(index, win, w, at, None))
            if slop is not None:
                found[1].append(_intersect(index, win, w, at, slop))
    (w, at), near = (tuple(map(np.concatenate, zip(*x, strict=True))) if x else (np.zeros(0, np.int64),) * 2 for x in found)
    start = at - win.shift[w, 0]
    change = np.zeros(index.span + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, start + win.size[w], -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc_of = lambda places: np.searchsorted(index.starts, places, "right") - 1
    out: dict[int, dict] = {}
    of = lambda d: out.setdefault(d, {"shard": row["shard"], "ordinal": d, "spans": [], "windows": [], "near": []})
    for d, a, b in zip(doc_of(begin).tolist(), begin.tolist(), end.tolist(), strict=True):
        of(d)["spans"].append({"start": a - int(index.starts[d]), "end": b - int(index.starts[d])})
    for name, (which, places) in (("windows", (w, at)), ("near", near)):
        for d, k in np.unique(np.stack([doc_of(places), which]), axis=1).T.tolist():
            of(d)[name].append(win.names[k].as_py())
    return iter(out.values())


def search(index: DataFrame, ordered: DataFrame, slop: int | None = None, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """shard, ordinal, spans, windows, near of the documents with a match; a row for each block of phrases that matches."""
    spark = index.sparkSession
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("shard", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("spans", span), T.StructField("windows", T.ArrayType(T.BinaryType())), T.StructField("near", T.ArrayType(T.BinaryType()))])
    count, out = max(1, -(-ordered.count() // block_windows)), None
    for k in range(count):
        win = spark.sparkContext.broadcast(_Windows(ordered.where(F.pmod(F.xxhash64("window"), F.lit(count)) == k).toArrow()))  # about block_windows phrases

        def look(batches, win=win):
            arrow = to_arrow_schema(schema)
            for batch in batches:
                for n in range(batch.num_rows):
                    row = {c: batch.column(c)[n].values for c in ("starts", "terms", "counts")} | {c: batch.column(c)[n].as_py() for c in ("shard", "positions")}
                    row |= {c: row[c].to_numpy(zero_copy_only=False) for c in ("starts", "counts")}
                    yield pa.RecordBatch.from_pylist(list(_matches(row, win.value, slop)), schema=arrow)

        found = stored(index.select("shard", "starts", "terms", "counts", "positions").mapInArrow(look, schema), "matches")
        win.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def phrase_matches(docs: DataFrame, items: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slop: int | None = None, block_windows: int = BLOCK_WINDOWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, spans of words inside occurrences of item windows (half-open, in words), the ids of
    the items that have them, and near_items: those with a window whose words all stand within ``slop`` words of its rarest one."""
    index = build_index(docs, id_col, text_col, shard_bytes)
    ordered, owners = build_windows(index, items, length, item_col, item_text)
    found = search(index, ordered, slop, block_windows)
    each = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", F.slice("starts", 2, F.size("doc_ids")).alias("until"), F.slice("starts", 1, F.size("doc_ids")).alias("since"))).alias("ordinal", "d"))
    spans = found.groupBy("shard", "ordinal").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    of = lambda c: found.select("shard", "ordinal", F.explode(c).alias("window")).join(owners, "window").groupBy("shard", "ordinal").agg(F.array_sort(F.collect_set("item")).alias("near_items" if c == "near" else "items"))
    rows = each.join(spans, ["shard", "ordinal"], "left").join(of("windows"), ["shard", "ordinal"], "left").join(of("near"), ["shard", "ordinal"], "left")
    none = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c)
    return rows.select(F.col("d.doc_ids").alias("doc_id"), (F.col("d.until") - F.col("d.since") - 1).cast("long").alias("n_words"), none("spans"), none("items"), none("near_items"))


def near_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP, length: int = LENGTH, **names: str) -> DataFrame:
    """Proximity: doc_id, and the items with a window whose words all stand within ``slop`` words of its rarest one, in any order."""
    return phrase_matches(docs, items, length, slop=slop, **names).select("doc_id", F.col("near_items").alias("items"))


def contamination(matches: DataFrame) -> DataFrame:
    """Counts of ``phrase_matches``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    hit = F.aggregate("spans", start, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["to"], s["start"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")), lambda a: a["n"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return matches.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose text has no window of any item.

    A row is named by its id and its text's hash, so rows with null or repeated ids are kept or left out one by one."""
    keyed = docs.withColumn("_chronolake_row", row_key(id_col))
    bad = contamination(phrase_matches(keyed, items, id_col="_chronolake_row")).where("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return keyed.join(bad, keyed["_chronolake_row"] == bad["_bad"], "left_anti").drop("_chronolake_row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(phrase_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP))


SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0)),
pos AS (
  SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (SELECT DISTINCT n FROM win)
  WHERE i + n - 1 <= len(ws)),
hit AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN win USING (phrase, n)),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
tok AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
cnt AS (SELECT word AS term, count(*) AS c FROM tok GROUP BY 1),
wt AS (SELECT phrase, n, unnest(range(1, n + 1)) AS k, unnest(string_split(phrase, ' ')) AS term FROM (SELECT DISTINCT phrase, n FROM win)),
anchor AS (SELECT phrase, n, arg_min(term, (c, term)) AS anchor FROM wt JOIN cnt USING (term) GROUP BY ALL HAVING count(*) = n),
place AS (SELECT phrase, n, doc_id, i FROM anchor JOIN tok ON word = anchor),
close AS (SELECT place.phrase, place.doc_id FROM place JOIN wt USING (phrase) JOIN tok t ON t.doc_id = place.doc_id AND t.word = wt.term AND t.i BETWEEN place.i - {SLOP} AND place.i + {SLOP}
  GROUP BY place.phrase, place.n, place.doc_id, place.i HAVING count(DISTINCT k) = place.n),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close JOIN win USING (phrase) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM w LEFT JOIN near USING (doc_id) LEFT JOIN n_hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
