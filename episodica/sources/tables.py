"""Tables of a memory: reading with defaults, writing, upserts, deletes and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The 16 bytes of the DNS name space for version-5 ids, from the public standard.
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def load(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A whole table, however long, with this schema."""
    return spark.read.schema(schema).parquet(path)


def decode(df: DataFrame, payload: str, fields: dict[str, tuple[str, object]], keep: list[str]) -> DataFrame:
    """keep, and each field of a JSON payload as its type, with its default where it is missing or doesn't parse. fields: name to (type, default)."""
    raw = F.from_json(payload, T.StructType([T.StructField(k, T.StringType()) for k in fields]))
    rows = df.select(*keep, raw.alias("__p"))
    return rows.select(*keep, *[F.coalesce(F.col(f"__p.{k}").try_cast(t), F.lit(d).cast(t)).alias(k) for k, (t, d) in fields.items()])


def encode(df: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
    """keep and payload: the fields as JSON; vectors as doubles."""
    kinds = dict(df.dtypes)
    columns = [F.col(c).cast("array<double>").alias(c) if kinds[c] == "array<float>" else F.col(c) for c in fields]
    return df.select(*keep, F.to_json(F.struct(*columns)).alias("payload"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row a key: the one with the highest version. Aggregated before the shuffle, without a sort."""
    both = old.unionByName(new)
    row = F.struct(*both.columns)
    return both.groupBy(*keys).agg(F.max_by(row, F.struct(*version)).alias("__r")).select("__r.*")


def delete(rows: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(tombstones.select(*keys).distinct(), keys, "left_anti")


def point_id(value: Column) -> Column:
    """The version-5 id of a text in the DNS name space, 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS)), F.encode(value, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def dimension_split(rows: DataFrame, vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has this dimension, and the rest."""
    fits = F.coalesce(F.size(vector) == dim, F.lit(False))
    return rows.where(fits), rows.where(~fits)


def repair_members(listed: DataFrame, existing: DataFrame, pointing: DataFrame, keys: list[str]) -> DataFrame:
    """listed without members that don't exist, and with those that point at their owner."""
    alive = listed.join(existing.select(*keys).distinct(), keys, "left_semi")
    return alive.unionByName(pointing.select(*alive.columns), allowMissingColumns=False).distinct()


def repair_order(rows: DataFrame, known: DataFrame, group: str, key: str, place: str, fallback: str) -> DataFrame:
    """(group, key, ord): known places first, then the rest by time."""
    joined = rows.join(known, key, "left")
    w = W.partitionBy(group).orderBy(F.col(place).isNull(), place, fallback, key)
    return joined.select(group, key, F.row_number().over(w).alias("ord"))


def state_document(edges: dict[str, DataFrame], orders: dict[str, DataFrame] | None = None, memory: str = "memory_id") -> DataFrame:
    """(memory, a list of ids in order for each of orders (memory, what they are ordered by, id), a list of edges for each graph): the state of each memory as one row."""
    parts = {}
    for name, o in (orders or {}).items():
        rest = [c for c in o.columns if c not in (memory, "id")]
        parts[name] = o.groupBy(memory).agg(F.transform(F.array_sort(F.collect_list(F.struct(*rest, "id"))), lambda s: s["id"]).alias(name))
    for name, e in edges.items():
        parts[name] = e.groupBy(memory).agg(F.array_sort(F.collect_list(F.struct(*[c for c in e.columns if c != memory]))).alias(name))
    out = None
    for lists in parts.values():
        out = lists if out is None else out.join(lists, memory, "full_outer")
    return out


def write_state(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").json(path)


def read_state(spark: SparkSession, path: str, schema: T.StructType, graph: str) -> DataFrame:
    """The edges of one graph of a state document; a missing list is empty."""
    state = spark.read.schema(schema).json(path)
    return state.select("memory_id", F.explode(graph).alias("__e")).select("memory_id", "__e.*")
