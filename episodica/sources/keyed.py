"""Stored tables by key: upserts and deletes that rewrite only the partitions that hold their keys.

A table is Parquet, partitioned by a bucket of its key; its number of buckets is chosen once, when it is saved. A change
is merged with the buckets it touches, in a table of its own first, and then replaces these by Spark's dynamic partition
overwrite: other partitions keep their files, a change that fails before it is committed leaves the table as it was, and
one that runs twice changes nothing more.

Cases: a null key has a bucket of its own; of rows of a change with one key the highest version stays, and the stored row
if it is higher; a change without rows rewrites nothing; a bucket that a delete empties stays without rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .scratch import materialize

BUCKET = "bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def save(rows: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Writes a table anew, each bucket by one task."""
    rows.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def load(spark: SparkSession, path: str, schema) -> DataFrame:
    """The stored rows with this schema, and their bucket."""
    return spark.read.schema(f"{schema}, {BUCKET} int").parquet(path)


def _replace(ready: DataFrame, path: str) -> None:
    ready.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def _touched(stored: DataFrame, change: DataFrame) -> DataFrame:
    return stored.join(F.broadcast(change.select(BUCKET).distinct()), BUCKET, "left_semi")  # one row a bucket


def upsert(spark: SparkSession, path: str, schema: str, rows: DataFrame, keys: list[str], version: list[str], buckets: int) -> None:
    """Rows by key, the highest version each, into a stored table."""
    change = materialize(rows.withColumn(BUCKET, bucket_of(keys, buckets)))
    stored = load(spark, path, schema)
    merged = tables.upsert(_touched(stored, change), change.select(*stored.columns), [*keys, BUCKET], version)
    # complete before the first partition is touched, and read from elsewhere while they are replaced
    _replace(materialize(merged.select(*stored.columns)), path)


def delete(spark: SparkSession, path: str, schema: str, gone: DataFrame, keys: list[str], buckets: int) -> None:
    """The rows whose keys are in gone, out of a stored table."""
    stored = load(spark, path, schema)
    change = materialize(gone.select(*keys).distinct().withColumn(BUCKET, bucket_of(keys, buckets)))
    touched = _touched(stored, change)
    hit = materialize(touched.join(change.select(*keys), keys, "left_semi").select(BUCKET).distinct())
    rows = touched.join(F.broadcast(hit), BUCKET, "left_semi")  # buckets without such a key stay as they are
    kept = materialize(rows.join(change.select(*keys), keys, "left_anti").select(*stored.columns))
    _replace(kept, path)
    _clear_empty(spark, path, hit, kept)


def _clear_empty(spark: SparkSession, path: str, hit: DataFrame, kept: DataFrame) -> None:
    """Deletes the folders of buckets that lost their last row, which dynamic overwrite leaves alone."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    for row in hit.join(kept.select(BUCKET).distinct(), BUCKET, "left_anti").collect():  # one row a bucket
        where = place(f"{path}/{BUCKET}={row[BUCKET]}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): the keys whose rows were created, updated or deleted between two versions of a table, told by their hashes; no others. Null keys are keys."""
    rest = sorted(c for c in before.columns if c not in keys and c != BUCKET)
    sides = [t.select(*keys, F.lit(i).alias("__side"), F.xxhash64(F.lit(0), *rest).alias("__hash")) for i, t in enumerate((before, after))]
    old, new = (F.max(F.when(F.col("__side") == i, F.col("__hash"))) for i in (0, 1))
    both = sides[0].unionByName(sides[1]).groupBy(*keys).agg(old.alias("__old"), new.alias("__new"))
    change = F.when(F.col("__old").isNull(), "created").when(F.col("__new").isNull(), "deleted").when(F.col("__old") != F.col("__new"), "updated")
    return both.select(*keys, change.alias("change")).where("change IS NOT NULL")
