"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The classifier is fitted on a bounded sample: per class the EXAMPLES different labelled texts with the smallest hashes, up
to EXAMPLE_BYTES in all; longer texts than EXAMPLE_TEXT bytes are no examples.  Every word of the sample is a term; its weight is
(1 + log tf) * idf, and idf is raised, never lowered, for words that tell the classes apart: by the factor 1 + BOOST * (G - 1)
where the log-likelihood ratio G is over 1.  A document's words that no example has count with the idf of such words in its length.

The index has a posting list per word, in blocks of BLOCK examples, with the largest weight of each block.  Blocks are
taken from the largest bound on, and those whose bound cannot reach the k-th best cosine are skipped, so the k nearest examples
are exact.  Their votes weigh by cosine.  Isotonic regression turns votes into probabilities: it is fitted on votes that
each fifth of the sample gets from the other four, weights of words included, with the classes weighted to their frequencies
among all labelled texts.  Every document is scored whole.  A document that is itself an example meets itself.

Nulls and edges: a null or empty text, or one without a word of any example, has no neighbour and the score of vote 0; ties in
cosine go to the earlier example; labels that are null, without a document, or that differ for one id are not used; a text
with several labelled copies has the label of most of them, toxic if equal; rows that repeat an id are scored one by one; without
examples of both classes every score is the share of toxic ones (0 if none); other columns are ignored, so names
cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ALNUM, crc_of_id, stored, table, words

#: Bounds of the sample: examples of a class, bytes of all and of one, and parts of the sample for the calibration.
EXAMPLES, EXAMPLE_BYTES, EXAMPLE_TEXT, FOLDS = 1500, 16 << 20, 1 << 16, 5
#: Examples of a block, blocks taken first, neighbours asked for, and what a word's log-likelihood ratio adds to its weight.
BLOCK, FIRST_BLOCKS, NEAREST, BOOST = 128, 4, 15, 0.3
THRESHOLD = 0.7


def examples(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = EXAMPLES, most_bytes: int = EXAMPLE_BYTES, most_text: int = EXAMPLE_TEXT) -> tuple[list[tuple], float]:
    """doc_id, text, label of the sample, at most 2 * ``per_class`` different texts; and the share of toxic labelled texts."""
    label = F.col(label_col).cast("int")
    known = labels.where(label.isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other AND doc_id IS NOT NULL")
    text = F.col("text").cast("string")
    hashed = docs.select("doc_id", F.xxhash64(text).alias("h"), F.octet_length(text).alias("size"))
    texts = stored(hashed.join(known, "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id"), (2 * F.sum("label") >= F.count("*")).cast("int").alias("label"), F.max("size").alias("size")), "labelled")
    counts = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    some = [texts.where((F.col("label") == k) & (F.col("size") <= most_text)).orderBy("h").limit(per_class) for k in (0, 1)]
    chosen = stored(some[0].unionByName(some[1]).select("h", F.col("doc_id").alias("_id"), "label"), "examples")
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(chosen), "h").where("doc_id = _id")  # 2 * per_class rows
    out, size = [], 0
    for r in rows.groupBy("h", "doc_id", "label").agg(F.min("text").alias("text")).orderBy("h").toLocalIterator():
        size += len(r.text.encode())
        if size > most_bytes:
            break
        out.append((r.doc_id, r.text, r.label))
    return out, share


def term_counts(text: bytes) -> Counter:
    found: Counter = Counter()
    for part in words(text, ALNUM):
        found.update(part)
    return found


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... up to length[0] of them, then the same of the next ones."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


class Sample:
    """The examples' words as arrays: one entry for each word of each example."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows, key=lambda r: r[2])  # blocks of one class have tighter bounds
        counts = [term_counts(t.encode()) for _, t, _ in rows]
        self.ids, self.labels = [r[0] for r in rows], np.array([r[2] for r in rows], np.int64)
        self.vocab = {w: k for k, w in enumerate(sorted(set().union(*counts)))}
        self.example = np.repeat(np.arange(len(rows)), [len(c) for c in counts])
        self.term = np.fromiter((self.vocab[w] for c in counts for w in c), np.int64, len(self.example))
        self.tf = 1 + np.log(np.fromiter((n for c in counts for n in c.values()), float, len(self.example)))


def term_weights(sample: Sample, used: np.ndarray) -> tuple[np.ndarray, float]:
    """The weight of every word, from the ``used`` examples; and of a word that none of them has."""
    y, size = sample.labels, np.bincount(sample.labels[used], minlength=2).astype(float)
    entry = used[sample.example]
    having = np.stack([np.bincount(sample.term[entry & (y[sample.example] == k)], minlength=len(sample.vocab)) for k in (0, 1)]).astype(float)
    df, total = having.sum(0), size.sum()
    cells = np.stack([having, size[:, None] - having])  # with and without the word, by class
    expected = cells.sum(1, keepdims=True) * size[None, :, None] / max(total, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * np.nan_to_num(cells * np.log(cells / expected), posinf=0, neginf=0).sum((0, 1))
    return (np.log((1 + total) / (1 + df)) + 1) * (1 + BOOST * np.maximum(0, g - 1)), float(np.log(1 + total) + 1)


def build_index(sample: Sample, used: np.ndarray | None = None) -> dict:
    """The block-max index of the ``used`` examples, of all by default."""
    used = np.ones(len(sample.labels), bool) if used is None else used
    weight, other = term_weights(sample, used)
    entry = np.flatnonzero(used[sample.example])
    term, at, value = sample.term[entry], sample.example[entry], sample.tf[entry] * weight[sample.term[entry]]
    value = value / np.sqrt(np.bincount(at, value * value, len(sample.labels)))[at]
    order = np.lexsort((at, term))
    term, at, value = term[order], at[order], value[order]
    cell = term * (len(sample.labels) // BLOCK + 1) + at // BLOCK
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    most = np.maximum.reduceat(value, first) if len(first) else np.zeros(0)
    return {
        "vocab": sample.vocab, "weight": weight, "other": other, "at": at, "value": value, "labels": sample.labels, "ids": sample.ids,
        "cell_start": first, "cell_size": np.diff(first, append=len(at)), "cell_most": most, "cell_block": at[first] // BLOCK,
        "term_cells": np.searchsorted(term[first], np.arange(len(sample.vocab) + 1)),
    }


def vector(index: dict, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Known words and their weights, in a vector of length 1 that has the other words too."""
    term = np.fromiter((index["vocab"].get(w, -1) for w in counts), np.int64, len(counts))
    tf = 1 + np.log(np.fromiter(counts.values(), float, len(counts)))
    value = tf * np.where(term >= 0, index["weight"][term] if len(index["weight"]) else 0, index["other"])
    value = value / max(np.sqrt((value * value).sum()), 1e-12)
    return term[term >= 0], value[term >= 0]


def nearest(index: dict, counts: Counter, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
    """The k examples with the largest cosine over 0, nearest first, and their cosines."""
    term, query = vector(index, counts)
    none = np.zeros(0, np.int64), np.zeros(0)
    cells_of = np.diff(index["term_cells"])[term]
    if not cells_of.sum():
        return none
    cell, by = _ranges(index["term_cells"][term], cells_of), np.repeat(query, cells_of)
    block = index["cell_block"][cell]
    bound = np.bincount(block, by * index["cell_most"][cell])
    rank = np.empty(len(bound), np.int64)
    order = np.argsort(-bound, kind="stable")
    rank[order] = np.arange(len(bound))
    done, step, best, score = 0, FIRST_BLOCKS, *none
    while done < len(order) and bound[order[done]] > 0 and (len(best) < k or bound[order[done]] >= score[-1] - 1e-12):
        now = (rank[block] >= done) & (rank[block] < done + step)
        size = index["cell_size"][cell[now]]
        at = _ranges(index["cell_start"][cell[now]], size)
        sums = np.bincount(index["at"][at], np.repeat(by[now], size) * index["value"][at])
        found = np.flatnonzero(sums > 0)
        best, score = np.concatenate([best, found]), np.concatenate([score, sums[found]])
        top = np.lexsort((best, -np.round(score, 12)))[:k]
        best, score, done, step = best[top], score[top], done + step, 2 * step
    return best, score


def vote(index: dict, best: np.ndarray, score: np.ndarray) -> float:
    """Toxic minus clean votes of the neighbours, each weighing its cosine, over NEAREST."""
    return float((score * (2 * index["labels"][best] - 1)).sum() / NEAREST)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression by pooling neighbours: centres of the pools and their values."""
    pools: list[list[float]] = []
    for value in np.unique(x):
        same = x == value
        pools.append([value * weight[same].sum(), (y * weight)[same].sum(), weight[same].sum()])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def learn(rows: list[tuple], share: float) -> dict:
    """Index and calibration from doc_id, text, label rows."""
    if len({r[2] for r in rows}) < 2:
        return {"share": share}
    sample = Sample(rows)
    y, fold, votes = sample.labels, np.arange(len(rows)) % FOLDS, np.zeros(len(rows))
    counts = [Counter() for _ in rows]
    names = list(sample.vocab)
    for k, t, n in zip(sample.example.tolist(), sample.term.tolist(), np.round(np.exp(sample.tf - 1)).astype(int).tolist(), strict=True):
        counts[k][names[t]] = n
    for f in range(FOLDS):
        index = build_index(sample, fold != f)
        for k in np.flatnonzero(fold == f):
            votes[k] = vote(index, *nearest(index, counts[k]))
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    at, value = isotonic(votes, y.astype(float), weight)
    return {"share": share, "index": build_index(sample), "at": at, "value": value}


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> dict:
    """Index and calibration from the labelled rows given."""
    return learn(*examples(docs, labels, label_col))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", shown: int = 3) -> DataFrame:
    """doc_id, score, evidence (the ``shown`` nearest examples with cosine and label) of every row."""
    id_type = docs.schema[id_col].dataType
    learned, first_type = docs.sparkSession.sparkContext.broadcast(model), to_arrow_type(id_type)  # bounded by EXAMPLE_BYTES

    def rate(batches):
        model = learned.value
        index = model.get("index")
        arrow = pa.list_(pa.struct([("doc_id", first_type), ("cosine", pa.float64()), ("label", pa.int32())]))
        for batch in batches:
            scores, evidence = [], []
            for text in pa.compute.cast(batch.column(1), pa.binary()):
                if index is None:
                    scores.append(model["share"])
                    evidence.append([])
                    continue
                best, cosine = nearest(index, term_counts(text.as_py() or b""))
                scores.append(float(np.interp(vote(index, best, cosine), model["at"], model["value"])))
                evidence.append([{"doc_id": index["ids"][k], "cosine": float(c), "label": int(index["labels"][k])} for k, c in zip(best[:shown], cosine[:shown], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, arrow)], names=["doc_id", "score", "evidence"])

    kind = id_type.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rate, f"doc_id {kind}, score double, evidence array<struct<doc_id: {kind}, cosine: double, label: int>>")


def held_out(doc_id: Column) -> Column:
    """One id in three is not learned from."""
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(3)) == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, fit(docs, labels.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
