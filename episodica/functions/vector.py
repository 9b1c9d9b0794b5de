"""Vector and decay rules as column expressions; vectors are arrays, computed in double precision."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..profile import Params

LN2 = math.log(2)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0."""
    return ratio(dot(a, b), norm(a), norm(b))


def ratio(product: Column, norm_a: Column, norm_b: Column) -> Column:
    """The cosine from a product and two norms that are known already."""
    return F.when(norm_a * norm_b == 0, 0.0).otherwise(product / (norm_a * norm_b))


def unit(v: Column) -> Column:
    """v at length 1; a zero vector stays."""
    n = norm(v)
    # the norm goes in as an array, made once; inside a lambda it would be computed for each component
    return F.when(n == 0, v).otherwise(F.zip_with(v, F.array_repeat(n, F.size(v)), lambda x, m: x / m))


def fuse(text: Column, visual: Column, saliency: Column) -> Column:
    """A turn's vector from its text's and, unless null, its image description's."""
    w = 0.28 + F.least(F.lit(0.32), 0.32 * saliency)
    return F.when(visual.isNull(), text).otherwise(unit(F.zip_with(text, visual, lambda t, v: (1 - w) * t + w * v)))


def decay(age: Column, half_life: float) -> Column:
    """Halves each half_life seconds; 1 for a negative age, or a half_life that isn't positive."""
    if half_life <= 0:
        return F.lit(1.0)
    return F.exp(-LN2 * F.greatest(F.lit(0.0), age) / half_life)


def active_weight(age: Column, access: Column, importance: Column, change: Column, pinned: Column, p: Params) -> Column:
    score = p.alpha * decay(age, p.half_life) + p.beta * F.least(F.lit(1.0), access / 5.0) + p.gamma * importance + p.delta * F.greatest(F.lit(0.0), F.least(F.lit(1.0), change))
    return F.when(pinned, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def event_survival(age: Column, nodes: Column, half_life: float) -> Column:
    return F.least(F.lit(1.0), decay(age, half_life) + 0.08 * F.least(F.lit(1.0), nodes / 10.0))


def legacy_survival(age: Column, importance: Column, pinned: Column, half_life: float) -> Column:
    return F.when(pinned, 1.0).otherwise(F.least(F.lit(1.0), decay(age, half_life) + 0.18 * importance))


def node_score(cos: Column, lexical: Column, importance: Column, weight: Column) -> Column:
    return 0.52 * F.greatest(cos, F.lit(0.0)) + 0.18 * lexical + 0.18 * importance + 0.12 * weight


def hashed(token: Column, dim: int = 384) -> tuple[Column, Column]:
    """The place and the sign of a token in the hash embedding, from its md5."""
    h = F.md5(token.cast("binary"))
    place = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim
    sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return place.cast("int"), sign


def place_and_sign(token: str, dim: int = 384) -> tuple[int, float]:
    """hashed() for one token in Python."""
    h = hashlib.md5(token.encode("utf-8", "surrogatepass")).hexdigest()
    return int(h[:8], 16) % dim, 1.0 if int(h[8], 16) % 2 == 0 else -1.0


def hash_embedding(df: DataFrame, keys: list[str], tokens: str, dim: int = 384) -> DataFrame:
    """(keys, idx, w): the hash embedding of each row's token multiset in sparse form, length 1; no rows for a text without tokens.

    Rows are dealt out by their keys once; then a row's equal tokens are counted before they are hashed, and places are
    summed, without another shuffle. No dense vector is built."""
    from pyspark.sql import Window as W

    place, sign = hashed(F.col("__t"), dim)
    counts = df.select(*keys, tokens).repartition(*keys).select(*keys, F.explode(tokens).alias("__t")).groupBy(*keys, "__t").agg(F.count("*").alias("__c"))
    sums = counts.select(*keys, place.alias("idx"), (sign * F.col("__c")).alias("__s")).groupBy(*keys, "idx").agg(F.sum("__s").alias("__w"))
    length = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(W.partitionBy(*keys)))
    return sums.withColumn("__n", length).where("__n > 0 AND __w <> 0").select(*keys, "idx", (F.col("__w") / F.col("__n")).alias("w"))
