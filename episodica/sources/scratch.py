"""Tables that jobs write between their steps, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset, a session on one machine, as in tests, takes a temporary folder; a cluster is told to set it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own_dirs[context.applicationId]


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """The tables of this session that materialize() wrote and that are still there."""
    return list(_written.get(spark.sparkContext.applicationId, ()))


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of materialize() once nothing reads them any more."""
    mine = _written.get(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        with suppress(ValueError):
            mine.remove(path)
