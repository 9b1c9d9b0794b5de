"""Queries over vectors, decay and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vector as V
from ..operators import hooks
from ..profile import Params
from .adapters import sql_tokens, table
from .registry import query

PARAMS = Params(half_life=5 * 86400.0)
AS_OF = 1_706_745_600  # 2024-02-01, after the last event
DIM = 384


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector and the one before it of the same label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))
    return rows.withColumn("u", F.lag("v").over(W.partitionBy("label").orderBy("vec_id"))).where("u IS NOT NULL")


_PAIRS = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT * FROM (SELECT *, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM e) WHERE u IS NOT NULL) "
_NORM = "sqrt(list_inner_product({0}, {0}))"


@query(_PAIRS + f"SELECT vec_id, round(CASE WHEN {_NORM.format('u')} * {_NORM.format('v')} = 0 THEN 0.0 ELSE list_inner_product(u, v) / ({_NORM.format('u')} * {_NORM.format('v')}) END, 6) AS cos FROM p")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("vec_id", F.round(V.cosine(F.col("u"), F.col("v")), 6).alias("cos"))


@query(
    _PAIRS
    + f""", f AS (SELECT vec_id, list_transform(list_zip(v, u), lambda x: (1 - w) * x[1] + w * x[2]) AS m FROM (SELECT *, 0.28 + least(0.32, 0.32 * ((vec_id % 5) / 4.0::DOUBLE)) AS w FROM p))
SELECT vec_id, round(m[1] / {_NORM.format('m')}, 6) AS first, round(m[64] / {_NORM.format('m')}, 6) AS last FROM f"""
)
def fused_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _pairs(spark, sf_dir).select("vec_id", V.fuse(F.col("v"), F.col("u"), (F.col("vec_id") % 5) / 4.0).alias("m"))
    return m.select("vec_id", F.round(F.element_at("m", 1), 6).alias("first"), F.round(F.element_at("m", 64), 6).alias("last"))


def centroids(vectors: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, centre): the mean vector of each cluster at length 1; summed by place before the shuffle."""
    sums = vectors.select(cluster, F.posexplode(vector).alias("i", "x")).groupBy(cluster, "i").agg(F.avg("x").alias("x"))
    centre = sums.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    return centre.select(cluster, V.unit(F.col("centre")).alias("centre"))


@query(
    """WITH x AS (SELECT label, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL),
n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY ALL)
SELECT m.label, m.i AS place, round(m.x / n.n, 6) AS value FROM m JOIN n USING (label)"""
)
def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", V.doubles(F.col("embedding")).alias("v"))
    c = centroids(rows, "label", "v")
    return c.select("label", F.posexplode("centre").alias("place", "value")).select("label", "place", F.round("value", 6).alias("value"))


def sql_embedding(source: str, keys: str, tokens: str, dim: int = DIM) -> str:
    """A query for (keys, idx, w) of source, which has the token lists."""
    return f"""SELECT {keys}, idx, s / n AS w FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY {keys})) AS n FROM (
  SELECT {keys}, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS idx, sum(CASE WHEN ('0x' || substr(md5(t), 9, 1))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS s
  FROM (SELECT {keys}, unnest({tokens}) AS t FROM {source}) GROUP BY ALL)) WHERE n > 0 AND s <> 0"""


@query(f"WITH k AS (SELECT conv_id, turn, {sql_tokens('text')} AS k FROM conversations), e AS ({sql_embedding('k', 'conv_id, turn', 'k')}) SELECT conv_id, turn, idx, round(w, 6) AS w FROM e")
def hash_embedding_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.tokens(F.col("text")).alias("k"))
    return V.hash_embedding(rows, ["conv_id", "turn"], "k", DIM).select("conv_id", "turn", "idx", F.round("w", 6).alias("w"))


@query(f"WITH k AS (SELECT conv_id, turn, {sql_tokens('text')} AS k FROM conversations), e AS ({sql_embedding('k', 'conv_id, turn', 'k')}), s AS (SELECT conv_id, turn, count(*) AS n, round(sum(w * w), 6) AS length, round(sum(w * idx), 4) AS weighted FROM e GROUP BY ALL) SELECT k.conv_id, k.turn, coalesce(n, 0) AS n, coalesce(length, 0.0)::DOUBLE AS length, coalesce(weighted, 0.0)::DOUBLE AS weighted FROM k LEFT JOIN s USING (conv_id, turn)")
def hooked_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding hook with its default: dense vectors, by their places other than 0, their length and a weighted sum."""
    v = table(spark, sf_dir, "conversations").select("conv_id", "turn", hooks.embed(F.col("text")).alias("v"))
    zero = F.lit(0.0)
    weighted = F.aggregate(F.transform("v", lambda x, i: x * i), zero, lambda a, x: a + x)
    return v.select("conv_id", "turn", F.size(F.filter("v", lambda x: x != 0)).alias("n"), F.round(F.aggregate("v", zero, lambda a, x: a + x * x), 6).alias("length"), F.round(weighted, 4).alias("weighted"))


def timed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as timed nodes: age in seconds, access count, importance in [0.05, 1], pinned."""
    e = table(spark, sf_dir, "events")
    age = F.lit(AS_OF) - F.unix_timestamp("ts")
    return e.select("event_id", "user_id", "event_type", "ts", age.alias("age"), (F.col("event_id") % 7).alias("access"), F.least(F.lit(1.0), 0.05 + F.col("value") / 100).alias("importance"), (F.col("event_id") % 50 == 0).alias("pinned"), ((F.col("event_id") % 11) / 10.0).alias("change"))


NODES = f"nodes AS (SELECT event_id, user_id, event_type, ts, {AS_OF} - floor(epoch(ts))::BIGINT AS age, event_id % 7 AS access, least(1.0, 0.05 + value / 100)::DOUBLE AS importance, event_id % 50 = 0 AS pinned, (event_id % 11) / 10.0::DOUBLE AS change FROM events)"
SQL_DECAY = f"exp(-ln(2::DOUBLE) * greatest(0, age) / {PARAMS.half_life}::DOUBLE)"
SQL_WEIGHT = f"CASE WHEN pinned THEN 1.0 ELSE greatest(0.0, least(1.0, 0.35 * {SQL_DECAY} + 0.25 * least(1.0, access / 5.0::DOUBLE) + 0.25 * importance + 0.15 * greatest(0.0, least(1.0, change)))) END"


def weighted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """timed_nodes() with weight: the refresh of all weights at one time, a projection without a shuffle."""
    n = timed_nodes(spark, sf_dir)
    return n.withColumn("weight", V.active_weight(F.col("age"), F.col("access"), F.col("importance"), F.col("change"), F.col("pinned"), PARAMS))


@query(f"WITH {NODES} SELECT event_id, round({SQL_DECAY}, 6) AS fresh FROM nodes")
def half_life_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_nodes(spark, sf_dir).select("event_id", F.round(V.decay(F.col("age"), PARAMS.half_life), 6).alias("fresh"))


@query(f"WITH {NODES} SELECT event_id, round({SQL_WEIGHT}, 6) AS weight FROM nodes")
def active_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_nodes(spark, sf_dir).select("event_id", F.round("weight", 6).alias("weight"))


@query(f"WITH {NODES}, u AS (SELECT user_id, min(age) AS age, count(*) AS n FROM nodes GROUP BY ALL) SELECT user_id, round(least(1.0, {SQL_DECAY} + 0.08 * least(1.0, n / 10.0::DOUBLE)), 6) AS survival FROM u")
def event_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = timed_nodes(spark, sf_dir).groupBy("user_id").agg(F.min("age").alias("age"), F.count("*").alias("n"))
    return u.select("user_id", F.round(V.event_survival(F.col("age"), F.col("n"), PARAMS.half_life), 6).alias("survival"))


@query(f"WITH {NODES} SELECT event_id, round(CASE WHEN pinned THEN 1.0 ELSE least(1.0, {SQL_DECAY} + 0.18 * importance) END, 6) AS survival FROM nodes")
def legacy_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_nodes(spark, sf_dir).select("event_id", F.round(V.legacy_survival(F.col("age"), F.col("importance"), F.col("pinned"), PARAMS.half_life), 6).alias("survival"))
