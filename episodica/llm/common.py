"""What the operators share: batches of texts, tables in the shared folder, distributed ranks, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import discard, materialize, shared_dir, written  # noqa: F401  the operators take them from here

#: Bytes of text that a Python worker handles at once, and gets at once; one longer text is a batch of its own.
BATCH_BYTES = 2 << 20
ARROW_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """What make() gives, kept by a Python worker until another key is asked for: the state of one operator at a time."""
    if key not in _held:
        _held.clear()
        tidy()
        _held[key] = make()
    return _held[key]


def tidy() -> None:
    """Gives back what the allocators of a Python worker hold without use."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the batches that Python workers get; a lower bound that is set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > ARROW_BYTES:
        spark.conf.set(key, ARROW_BYTES)


def slices(batch: pa.RecordBatch, text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most limit bytes of text, one row at least."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def per_text(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[list[str | None]], list]], keep: list[str] | None = None) -> DataFrame:
    """df's columns (keep; all by default) and the fields that make()'s function computes from a list of texts, as one list or array for each.

    A field replaces a column of df of the same name, in whatever case."""
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    # by place, as names may clash with the text's and mapInArrow takes none with a dot
    source = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in kept] + fields)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        compute, kinds = make(), [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for part in slices(batch, "text"):
                made = compute(part.column(part.num_columns - 1).to_pylist())
                columns = [part.column(i) for i in range(len(kept))] + [pa.array(v, type=k) for v, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])
        tidy()

    return source.mapInArrow(run, schema)


def bucketed(df: DataFrame, place: Column, rows_per_bucket: int) -> DataFrame:
    """df with __bucket: place (0 to 1, ascending) cut so that a bucket of the whole table holds about rows_per_bucket rows."""
    n = max(1, -(-df.count() // rows_per_bucket))
    return df.withColumn("__bucket", F.least(F.lit(n - 1), F.floor(place * n)).cast("long"))


def offsets(df: DataFrame, group: list[str], amounts: dict[str, Column]) -> DataFrame:
    """For each group and __bucket, what the group's earlier buckets hold of each amount, as __before_<name>, and the group's total, as __all_<name>.

    The window runs over one row a bucket, never over the rows themselves."""
    from pyspark.sql import Window as W

    sums = df.groupBy(*group, "__bucket").agg(*[F.sum(c).alias(f"__sum_{k}") for k, c in amounts.items()])
    whole = W.partitionBy(*group)
    before = whole.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    return sums.select(
        *group,
        "__bucket",
        *[F.coalesce(F.sum(f"__sum_{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in amounts],
        *[F.sum(f"__sum_{k}").over(whole).alias(f"__all_{k}") for k in amounts],
    )


def expanded(df: DataFrame, copies: str, as_: str, at_once: int = 10_000) -> DataFrame:
    """df with each row as often as copies (1 or more) says, numbered from 0 as as_; no array holds all copies of a row."""
    blocks = F.explode(F.sequence(F.lit(0), F.expr(f"(`{copies}` - 1) DIV {at_once}")))
    rows = df.withColumn("__block", blocks)
    end = F.least(F.col(copies), (F.col("__block") + 1) * at_once) - 1
    return rows.withColumn(as_, F.explode(F.sequence(F.col("__block") * at_once, end))).drop("__block")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each id of edges (a, b; long) can reach, for each id but the smallest itself.

    Alternates large-star and small-star steps until nothing changes. A node with very many neighbours is aggregated
    before its shuffle and joined, so Spark can split it; each round's edges go to the shared folder."""
    spark = edges.sparkSession
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state, last = None, written(spark)[-1]
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u's smaller neighbours and u itself all link to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small)
        discard(spark, [last])
        last = written(spark)[-1]
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or tuple(now) == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = tuple(now)
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
