"""Mixing sources to target weights by Poisson replication, with DataFrame operations only.

A source's rate is its share of the target weights, times the bytes wanted, over the bytes it has.  Each document
draws its number of copies from the Poisson distribution with that mean: a number in [0, 1) from the hash of
seed and id is looked up in the cumulative distribution.  A rate over SINGLE, for which exp(-rate) would vanish, is cut into
equal parts of at most PART: the sum of independent draws, one of each part, is the draw of the whole rate.  Copies are then dealt to partitions by the hash
of seed, id and copy, and sorted by it inside: a global shuffle without a sampling pass.  Draws depend
on nothing but seed, id and rate, so they are the same however rows are partitioned or retried.

Nulls and edges: a null source is a source of its own; a null text weighs 1 byte, as an empty one; rows that
repeat an id get the same draw; a row with a null id is known by the hash of its text instead; a document may get no copy, that being the method's
decision; columns of the input named as the added ones (mix_copies, mix_copy, mix_key) give way to
them; an empty table gives an empty result; where all weights that apply are 0 there are no copies, and a negative weight is refused by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Target weights of the sources; every source not named has the weight DEFAULT.
WEIGHTS, DEFAULT, EPOCHS, SEED = {"src0": 4.0, "src1": 2.0}, 1.0, 1.0, "mix-1"
ADDED = ("mix_copies", "mix_copy", "mix_key")
#: Largest rate of a single draw, and of each part of a larger one; copies of a row that are listed at once.
SINGLE, PART, BLOCK = 700.0, 500.0, 1 << 16


def rates(docs: DataFrame, weights: dict[str, float], default: float, epochs: float, source_col: str, text_col: str) -> DataFrame:
    """source, mass (bytes and one per row), rate, parts (draws to add up), cdf: the cumulative Poisson distribution of a part's rate from 0 on, until it is 1."""
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long") + 1
    mass = stored(docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("mass")), "mass")
    if bad := sorted(name for name, w in {**weights, "(default)": default}.items() if not w >= 0):
        raise ValueError(f"weights must not be negative: {', '.join(bad)}")
    weight = F.lit(float(default))
    for name, w in weights.items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    mass = mass.withColumn("weight", weight)
    sums = mass.agg(F.sum("weight").alias("weight"), F.sum("mass").alias("mass")).first()
    share = F.col("weight") / F.lit(sums.weight) if sums.weight else F.lit(0.0)
    rate = share * F.lit(float(epochs)) * F.lit(sums.mass) / F.col("mass")
    parts = F.when(F.col("rate") <= SINGLE, F.lit(1)).otherwise(F.ceil(F.col("rate") / PART).cast("int"))
    part = F.col("rate") / F.col("parts")
    start = F.struct(F.exp(-part).alias("p"), F.array(F.exp(-part)).alias("c"))
    step = lambda a, k: F.struct((a["p"] * part / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * part / k)).alias("c"))
    terms = F.sequence(F.lit(1), F.ceil(part + 12 * F.sqrt(part) + 30).cast("int"))
    return mass.withColumn("rate", rate).withColumn("parts", parts).select("source", "mass", "rate", "parts", F.aggregate(terms, start, step, lambda a: a["c"]).alias("cdf"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, default: float = DEFAULT, epochs: float = EPOCHS, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with mix_copies (drawn for the row), mix_copy (from 1) and mix_key, shuffled."""
    table_of_rates = stored(rates(docs, WEIGHTS if weights is None else weights, default, epochs, source_col, text_col), "rates")
    names = {c: f"_{k}" for k, c in enumerate(docs.columns) if c not in ADDED}  # none clashes with the added ones
    doc_id = F.coalesce(F.col(names[id_col]).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(names[text_col]).cast("string"), F.lit("")).cast("binary"))))
    rows = docs.select(*[F.col(f"`{c}`").alias(to) for c, to in names.items()])
    rates_of = table_of_rates.select(F.col("source").alias("_source"), "parts", "cdf")  # Spark broadcasts it while it is small, and splits skewed partitions otherwise
    drawn = rows.join(rates_of, F.col(names[source_col]).eqNullSafe(F.col("_source"))).withColumn("_u", uniform(F.lit(seed), doc_id))
    draw = lambda u: F.size(F.filter("cdf", lambda c: c <= u))
    several = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, k: n + draw(uniform(F.lit(seed), F.lit("part"), k.cast("string"), doc_id)))
    copies = drawn.withColumn("mix_copies", F.when(F.col("parts") == 1, draw(F.col("_u"))).otherwise(several)).where("mix_copies > 0")
    blocks = copies.select(*names.values(), "mix_copies", F.explode(F.sequence(F.lit(1), F.col("mix_copies"), F.lit(BLOCK))).alias("_from"))
    last = F.least(F.col("mix_copies").cast("long"), F.col("_from").cast("long") + (BLOCK - 1)).cast("int")
    each = blocks.select(*names.values(), "mix_copies", F.explode(F.sequence(F.col("_from"), last)).alias("mix_copy"))
    keyed = each.withColumn("mix_key", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), doc_id, F.col("mix_copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long"))
    return keyed.repartition(F.col("mix_key")).sortWithinPartitions("mix_key").select(*[F.col(to).alias(c) for c, to in names.items()], *ADDED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE mass AS (
  SELECT source, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS mass,
    CASE source {" ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items())} ELSE {DEFAULT}::DOUBLE END AS weight
  FROM documents GROUP BY source),
rates AS (
  SELECT source, weight / (SELECT sum(weight) FROM mass) * {EPOCHS}::DOUBLE * (SELECT sum(mass) FROM mass)::BIGINT / mass AS rate FROM mass),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
named AS (SELECT *, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS name FROM documents),
drawn AS (
  SELECT d.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source
      AND cdf.c <= ('0x' || substr(md5('{SEED}:' || d.name), 1, 13))::BIGINT / {1 << 52}::DOUBLE)::INT AS mix_copies
  FROM named d)
SELECT doc_id, text, lang, source, n_chars, mix_copies, mix_copy::INT AS mix_copy,
  ('0x' || substr(md5('{SEED}:' || name || ':' || mix_copy), 1, 15))::BIGINT AS mix_key
FROM (SELECT *, unnest(range(1, mix_copies + 1)) AS mix_copy FROM drawn)
"""
