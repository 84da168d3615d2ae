"""Quality rules: robust multivariate outliers by the minimum covariance determinant (MCD).

Text statistics are counted for every document, turned into five features, and compared with a robust centre and
scatter of the document's language and source.  The estimate follows the nested FAST-MCD scheme so
that no group, however large, meets in one task: rows of a group are dealt by hash to cells of about
``cell_rows``; each cell runs concentration steps from random starts; the best solutions of a group's cells are then
concentrated over all its rows.  Such a step is an aggregation: distances fall into fine classes, a class table
gives the distance that covers the wanted share of rows, and sums over the rows inside give the next
centre and scatter.  One reweighting step follows; a document whose squared distance exceeds the chi-square
quantile is rejected.  Documents that fail the base rules take no part in the estimates, and a text counts once
in each language and source however many copies it has.

One law holds for groups of every size: the estimate of n texts of a language and source has the weight n / (n + SHRINK) beside that
of its language, which in turn has such a weight beside that of all texts.  The features vary by nature in every kind of text; ``RIDGE``
is a rounding error of one percent that only keeps equal rows from a singular scatter.

Nulls and edges: a null or empty text has zero words and fails the base; null lang or source are groups of their own;
rows that repeat an id are judged one by one; a null doc_id is carried along; other columns are ignored, so
names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, words

#: log(letters per word), log(ASCII punctuation per letter), log(capitals per letter), log(words per different line),
#: log(different words) / log(words).
P, RIDGE = 5, 1e-4
#: Share of rows that an estimate covers, tail of the chi-square law beyond which a document goes, rows that the parent group's
#: estimate weighs, rows of a cell, random starts in a cell, solutions taken over all rows, steps with these and with the best.
COVER, TAIL, SHRINK, CELL_ROWS, STARTS, TAKEN, FIRST_STEPS, STEPS = 0.6, 0.001, 50, 2000, 20, 3, 2, 4
SYMBOLS, CAPITALS, CASED = "#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(256))
PUNCTUATION = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_counts(text: str | None) -> tuple[int, ...]:
    """The five counts of COUNTS, then lines with a word, ASCII capitals, ASCII punctuation, and different words."""
    text = text or ""
    raw = text.encode()
    ids: dict[bytes, int] = {}
    code = np.concatenate([np.fromiter((ids.setdefault(w, len(ids)) for w in part), np.int64, len(part)) for part in words(raw, CASED)])
    n, repeated = len(code), 0
    if n > 2:
        first = code[:-2] * len(ids) + code[1:-1]
        if len(ids) > 1 << 20:  # the product of three would overflow
            first = np.unique(first, return_inverse=True)[1]
        _, window, count = np.unique(first * len(ids) + code[2:], return_inverse=True, return_counts=True)
        twice = count[window] > 1
        inside = np.zeros(n, bool)
        for k in range(3):
            inside[k : n - 2 + k] |= twice
        repeated = int(inside.sum())
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    letters = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return n, letters, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), len(raw) - len(raw.translate(None, CAPITALS)), len(raw) - len(raw.translate(None, PUNCTUATION)), len(ids)


def features(n, letters, symbols, dup, repeated, lines, capitals, punctuation, different) -> tuple[float, ...]:
    n, letters, different = max(n, 2), max(letters, 1), max(different, 1)
    return math.log(letters / n), math.log((punctuation + 1) / (letters + 1)), math.log((capitals + 1) / (letters + 1)), math.log(n / max(lines - dup, 1)), math.log(different) / math.log(n)


def chi2_cdf(x: float, k: float) -> float:
    """Chi-square distribution function with k degrees of freedom (series of the incomplete gamma function)."""
    if x <= 0:
        return 0.0
    a, x = k / 2, x / 2
    if x > 60 + 4 * a:
        return 1.0
    term = total = 1 / a
    for i in range(1, 1000):
        term *= x / (a + i)
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(tail: float, k: float) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - chi2_cdf(mid, k) > tail else (low, mid)
    return high


def consistency(cover: float) -> float:
    """What the scatter of the ``cover`` nearest normal points must be multiplied by."""
    return cover / chi2_cdf(chi2_quantile(1 - cover, P), P + 2)


def _cholesky_inverse(cov: np.ndarray) -> tuple[np.ndarray, float]:
    lower = np.linalg.cholesky(cov)
    return np.linalg.inv(lower), 2 * float(np.log(np.diag(lower)).sum())


def cell_mcd(x: np.ndarray, seed: int, cover: float = COVER, starts: int = STARTS) -> tuple[np.ndarray, np.ndarray, float]:
    """FAST-MCD over one cell: centre, scatter and log determinant of the best of the random starts."""
    rng, floor, best = np.random.default_rng(seed), np.eye(P) * RIDGE, None
    h = math.ceil(cover * len(x))

    def step(centre, cov):
        z = (x - centre) @ _cholesky_inverse(cov)[0].T
        near = x[np.argsort((z * z).sum(1), kind="stable")[:h]]
        return moments(near)

    def moments(part):
        z = part - part.mean(0)
        return part.mean(0), z.T @ z / len(part) + floor

    tried = []
    for _ in range(starts):
        at = moments(x[rng.choice(len(x), min(len(x), P + 1), replace=False)])
        for _ in range(2):
            at = step(*at)
        tried.append((_cholesky_inverse(at[1])[1], len(tried), at))
    for value, _, at in sorted(tried, key=lambda t: t[:2])[:3]:
        for _ in range(20):
            at = step(*at)
            value, last = _cholesky_inverse(at[1])[1], value
            if last - value < 1e-9:
                break
        if best is None or value < best[2]:
            best = (*at, value)
    return best


_X, _M = [f"x{i}" for i in range(P)], [f"m{i}" for i in range(P)]
_L = [(i, j) for i in range(P) for j in range(i + 1)]
_ESTIMATE = "grp string, cand int, logdet double, " + ", ".join(f"{m} double" for m in _M) + ", " + ", ".join(f"l{i}{j} double" for i, j in _L)


def _estimate_row(grp, cand, centre, cov) -> list:
    inverse, logdet = _cholesky_inverse(cov)
    return [grp, cand, logdet, *map(float, centre), *(float(inverse[i, j]) for i, j in _L)]


def _distance() -> Column:
    """Squared Mahalanobis distance: the features times the inverse Cholesky factor."""
    z = [sum((F.col(f"l{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((v * v for v in z), F.lit(0.0))


def _from_sums(scale: float):
    names = ["grp", "cand", "n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in _L)]

    def solve(parts):
        for part in parts:
            out = []
            for r in part[names].itertuples(index=False):
                n, s = r[2], np.array(r[3 : 3 + P])
                cov = np.zeros((P, P))
                for (i, j), q in zip(_L, r[3 + P :], strict=True):
                    cov[i, j] = cov[j, i] = q / n - s[i] * s[j] / n / n
                cov[np.diag_indices(P)] = np.maximum(cov.diagonal(), 0)
                out.append(_estimate_row(r[0], r[1], s / n, cov * scale + np.eye(P) * RIDGE))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _ESTIMATE.split(", ")])

    return solve


def _moments(rows: DataFrame, scale: float = 1.0) -> DataFrame:
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(_X)] + [F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"q{i}{j}") for i, j in _L]
    return stored(rows.groupBy("grp", "cand").agg(F.count("*").alias("n"), *sums).mapInPandas(_from_sums(scale), _ESTIMATE), "estimates")


def _step(rows: DataFrame, estimates: DataFrame, cover: float, scale: float = 1.0) -> DataFrame:
    """A concentration step over all rows: the moments of the ``cover`` nearest rows of each group and candidate.

    Distances count by classes, 64 to a doubling; the class that reaches the share is taken whole, so ties stay together."""
    cls = F.floor(F.log2(F.col("d2") + 2.0**-20) * 64).cast("int")
    at = rows.join(estimates, "grp").withColumn("d2", _distance()).select("grp", "cand", *_X, cls.alias("cls"))
    so_far = F.sum("n").over(Window.partitionBy("grp", "cand").orderBy("cls"))
    total = F.sum("n").over(Window.partitionBy("grp", "cand"))
    reached = at.groupBy("grp", "cand", "cls").agg(F.count("*").alias("n")).withColumn("ok", so_far >= F.ceil(F.lit(cover) * total)).where("ok").groupBy("grp", "cand").agg(F.min("cls").alias("last"))
    return _moments(at.join(stored(reached, "classes"), ["grp", "cand"]).where("cls <= last"), scale)


def _group(level: int) -> Column:
    part = lambda c: F.coalesce(F.col(c), F.lit("\x00"))
    return F.concat_ws("\x01", F.lit(str(level)), *[part(c) for c in ("lang", "source")[: 2 - level]])


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, h (hash of the text), the counts, base_failed and the features of every row, stored."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, lang string, source string, h long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{x} double" for x in _X)

    def count(batches):
        for batch in batches:
            found = [text_counts(t.as_py()) for t in batch.column(4)]
            columns = [pa.array([c[k] for c in found], pa.int64()) for k in range(len(COUNTS))]
            values = [features(*c) for c in found]
            columns += [pa.array([v[k] for v in values], pa.float64()) for k in range(P)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=["doc_id", "lang", "source", "h", *COUNTS, *_X])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(count, schema)
    return stored(rows.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")), "counts")


def estimates(rows: DataFrame, cover: float = COVER, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Centre and inverse Cholesky factor of every group of each level (see ``_group`` for its name), with n, its texts.

    Level 0 is a language and source, level 1 a language, level 2 all."""
    levels = F.array(*[_group(k) for k in range(3)])
    texts = rows.groupBy("lang", "source", "h").agg(*[F.min(x).alias(x) for x in _X])
    members = stored(texts.select("h", *_X, F.explode(levels).alias("grp")), "members")
    sizes = stored(members.groupBy("grp").agg(F.count("*").alias("n")), "sizes")
    cell = F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / F.lit(cell_rows)))

    def solve(key, part):
        centre, cov, _ = cell_mcd(part.sort_values("h")[_X].to_numpy(), 1, cover)
        return pd.DataFrame([_estimate_row(key[0], 0, centre, cov)], columns=[x.split()[0] for x in _ESTIMATE.split(", ")])

    local = members.join(sizes, "grp").select("grp", cell.alias("cell"), "h", *_X).groupBy("grp", "cell").applyInPandas(solve, _ESTIMATE)
    best = Window.partitionBy("grp").orderBy("logdet", *_M)
    found = stored(local.withColumn("cand", F.row_number().over(best).cast("int")).where(F.col("cand") <= TAKEN), "starts")
    vectors = members.select("grp", *_X)
    for k in range(STEPS):
        if k == FIRST_STEPS:
            found = stored(found.withColumn("nth", F.row_number().over(Window.partitionBy("grp").orderBy("logdet", "cand"))).where("nth = 1").drop("nth"), "best")
        found = _step(vectors, found, cover, consistency(cover) if k == STEPS - 1 else 1.0)
    near = vectors.join(found, "grp").where(_distance() <= chi2_quantile(0.025, P)).select("grp", "cand", *_X)
    return _moments(near, consistency(0.975)).join(sizes, "grp")


_SHAPE = [*_M, *(f"l{i}{j}" for i, j in _L)]


def _moments_of(values) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter from the columns _SHAPE."""
    inverse = np.zeros((P, P))
    for (i, j), x in zip(_L, values[P:], strict=True):
        inverse[i, j] = x
    return np.array(values[:P], float), np.linalg.inv(inverse.T @ inverse)


def shrunk(rows: DataFrame, found: DataFrame, shrink: float = SHRINK) -> DataFrame:
    """lang, source and the estimate that judges their rows: their own, their language's and that of all texts, weighed."""
    level = lambda k: F.col("grp").startswith(str(k))
    top = [tuple(r) for r in found.where(level(2)).select(*_SHAPE).collect()]  # one row
    groups = rows.select("lang", "source").distinct().withColumns({"g0": _group(0), "g1": _group(1)})
    own = [found.where(level(k)).select(F.col("grp").alias(f"g{k}"), F.struct("n", *_SHAPE).alias(f"e{k}")) for k in (0, 1)]

    def weigh(parts):
        for part in parts:
            out = []
            for lang, source, *both in part[["lang", "source", "e1", "e0"]].itertuples(index=False):
                centre, cov = _moments_of(top[0])
                for e in both:
                    m, c = _moments_of([e[x] for x in _SHAPE])
                    w = e["n"] / (e["n"] + shrink)
                    centre, cov = w * m + (1 - w) * centre, w * c + (1 - w) * cov
                out.append([lang, source, *_estimate_row("", 0, centre, cov)[3:]])
            yield pd.DataFrame(out, columns=["lang", "source", *_SHAPE])

    schema = "lang string, source string, " + ", ".join(f"{x} double" for x in _SHAPE)
    return stored(groups.join(own[0], "g0").join(own[1], "g1").select("lang", "source", "e0", "e1").mapInPandas(weigh, schema), "shrunk")


def judge(docs: DataFrame, tail: float = TAIL, cover: float = COVER, shrink: float = SHRINK, cell_rows: int = CELL_ROWS, **names: str) -> DataFrame:
    """doc_id, the counts, base_failed, kept, distance2 (null if not judged) of every row."""
    rows = counted(docs, **names)
    passed = rows.where(~F.col("base_failed"))
    found = shrunk(passed, estimates(passed, cover, cell_rows), shrink).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    judged = rows.join(found, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    d2 = F.when(~F.col("base_failed"), _distance())
    kept = ~F.col("base_failed") & (d2 <= F.lit(chi2_quantile(tail, P)))
    return judged.select("doc_id", *COUNTS, "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), d2.alias("distance2"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
