"""Tables in the folder that driver and executors share: where a job cuts its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and all is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("chronolake.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="chronolake-")
        spark.conf.set("chronolake.shared.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends there, so a lost
    executor costs a reread and nothing that was computed before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronolake-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many tables ``stored`` has written and not dropped; a mark for ``drop_stored``."""
    return len(_made)


def drop_stored(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables that ``stored`` wrote for this session after the mark ``since``, but for the last ``keep`` of them, when
    results that read them are no longer wanted."""
    own = [x for x in _made[since:] if x[0] is spark]
    for item in own[: len(own) - keep]:
        path = spark._jvm.org.apache.hadoop.fs.Path(item[1]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _made.remove(item)
