"""Tables as Parquet; session times are UTC."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; timestamps without a zone are taken as UTC instants of the session."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}) if any(t == "timestamp_ntz" for _, t in df.dtypes) else df


def page_of(key: str, number: str, size: int) -> Column:
    """The page of a key that a row is on: pages hold the rows of ``size`` numbers in a row, so none grows with the key."""
    return F.concat_ws("-", F.col(key).cast("string"), F.expr(f"{number} div {size}").cast("string"))


def parts_of(rows: DataFrame, keys: list[str], number: str, size: int) -> DataFrame:
    """The rows with offset: each key's rows, in the order of a unique number (nulls last), are cut into parts of under twice ``size``
    rows, and offset, which names the part of its key, is how many rows stand before it.

    Only counts of ``size`` numbers in a row are summed key by key, so the rows of a key are at no time together."""
    span = F.expr(f"{number} div {size}")
    counts = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], span.alias("_span")).agg(F.count(F.lit(1)).alias("_n"))
    of_key = Window.partitionBy(*[f"_{k}" for k in keys])
    earlier = of_key.orderBy(F.asc_nulls_last("_span")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    part = Window.partitionBy(*[f"_{k}" for k in keys], F.expr(f"_before div {size}"))
    starts = counts.withColumn("offset", F.min("_before").over(part)).drop("_n", "_before")
    same = span.eqNullSafe(F.col("_span"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(starts, same).drop("_span", *[f"_{k}" for k in keys])


def archive(rows: DataFrame, payload: str) -> DataFrame:
    """Content-addressed payloads: sha256, size, once each."""
    return rows.select(F.sha2(F.col(payload).cast("binary"), 256).alias("sha256"), F.octet_length(payload).cast("long").alias("size")).dropDuplicates(["sha256"])


def _digest(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*[F.col(k).cast("string").alias(k) for k in keys], F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}), 256).alias("sha256"))


def export(rows: DataFrame, keys: list[str], path: str) -> None:
    """Rows as CSV with a header under ``path``/rows, their digests by key under ``path``/manifest; refuses to overwrite.

    Empty texts and nulls are kept apart; nulls are written as \\\\N, so a text of just that is reported by ``verify``."""
    rows.write.mode("errorifexists").option("nullValue", "\\N").csv(f"{path}/rows", header=True)
    _digest(rows, keys).write.mode("errorifexists").parquet(f"{path}/manifest")


def verify(spark: SparkSession, schema: str, keys: list[str], path: str) -> DataFrame:
    """keys, stored, declared of the exported rows whose content and manifest differ; empty when all is as written."""
    rows = spark.read.schema(schema).option("nullValue", "\\N").option("mode", "FAILFAST").csv(f"{path}/rows", header=True)
    sides = [_digest(rows, keys).withColumn("_side", F.lit(1)), spark.read.parquet(f"{path}/manifest").withColumn("_side", F.lit(-1))]
    left = sides[0].unionByName(sides[1]).groupBy(*keys, "sha256").agg(F.sum("_side").alias("n")).where("n <> 0")
    return left.groupBy(*keys).agg(F.max(F.when(F.col("n") > 0, F.col("sha256"))).alias("stored"), F.max(F.when(F.col("n") < 0, F.col("sha256"))).alias("declared"))
