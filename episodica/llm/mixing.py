"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources, in code-point order with null last, weigh 1, 2, 3, 1, ... and share as many words as there are; no target is
above 3 times its source's words, and what is above goes to the others by weight. A document's key is exponential with
its quality weight as rate; a source's documents, by key, fill its target: whole epochs first, then the documents whose
words fit below the rest of the budget, the last of them in part.

Rows equal in id, source and size have one key; they are counted before anything is sorted, so ids that repeat, or are
null, are no hot key, and each copy takes what its place in the count gives it. Prefix sums run in two levels: sums of key
ranges, then rows inside a range of about ROWS rows, so a source with any share of all rows is dealt out. All steps are
DataFrame operations.

Cases: a null or empty text has size 0 and takes nothing; a null source is a source; documents without a label weigh
UNLABELLED; ties in the key go by id, then size, and repeated rows are documents of their own; without words all
targets are 0; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import expanded, materialize, offsets

#: Characters of words; the rest are the six white spaces of ASCII.
WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
GOOD, BAD, UNLABELLED = 2.0, 0.5, 1.0
ROWS = 10_000


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size, n_docs, weight, target) from (source, size): one row a source, null included.

    The level is the number L for which the sum of least(cap * size, L * weight) is the sum of all sizes."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by = by.withColumn("weight", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    full = (cap * F.col("source_size")).alias("full")
    by = by.select("*", full, (cap * F.col("source_size") / F.col("weight")).alias("ratio"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0))) / F.sum("weight").over(after)
    by = by.withColumn("level", level)
    settled = F.min(F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everything)
    by = by.withColumn("settled", F.max(F.when(F.col("ratio") == settled, F.col("level"))).over(everything))
    return by.select("source", "source_size", "n_docs", "weight", F.least(F.col("full").cast("double"), F.col("settled") * F.col("weight")).alias("target"))


def plan(docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, rest, taken): what the mix takes of each document, in words.

    labels: (doc_id, quality); 1 weighs GOOD, 0 BAD."""
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    weight = F.lit(UNLABELLED)
    if labels is not None:
        quality = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__of")).agg(F.max("quality").alias("__quality"))
        sizes = sizes.join(quality, sizes.doc_id == quality["__of"], "left")
        weight = F.when(F.col("__quality") >= 1, GOOD).when(F.col("__quality") < 1, BAD).otherwise(UNLABELLED)
    draw = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    uniform = (F.conv(F.substring(draw, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    sizes = sizes.withColumn("weight", weight).groupBy("doc_id", "source", "size", "weight").agg(F.count("*").alias("copies"))
    rows = materialize(sizes.select("doc_id", "source", "size", "copies", (-F.log(uniform) / F.col("weight")).alias("key")))
    to = targets(rows.select("source", (F.col("size") * F.col("copies")).alias("size")))
    joined = rows.join(to.withColumnRenamed("source", "__source"), rows.source.eqNullSafe(F.col("__source"))).drop("__source")
    n = F.ceil(F.col("n_docs") / ROWS)
    dealt = materialize(joined.withColumn("__bucket", F.least(n - 1, F.floor((1 - F.exp(-F.col("key"))) * n)).cast("long")))
    words = F.col("size") * F.col("copies")
    before = offsets(dealt, ["source"], {"size": words}).select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), "__before_size")
    rows = dealt.join(before, dealt.source.eqNullSafe(before["__s"]) & (dealt["__bucket"] == before["__b"]))
    here = W.partitionBy("source", "__bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    budget = F.round("target").cast("long")
    rows = expanded(rows.withColumn("__sum", F.coalesce(F.sum(words).over(here), F.lit(0))), "copies", "__copy")
    rows = rows.withColumn("reach", F.col("__before_size") + F.col("__sum") + F.col("__copy") * F.col("size")).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("CAST(round(target) AS BIGINT) DIV source_size")).otherwise(0))
    rows = rows.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("reach")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", "rest", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with each document as often as the mix takes it, rounded to whole documents; 0 times is dropped.

    Rows that share id, source and size share what they take evenly. A document without words comes once an epoch."""
    p = plan(docs, labels, doc_id, text, source)
    times = F.when(F.col("size") > 0, F.floor(F.col("words") / (F.col("n") * F.col("size")) + 0.5)).otherwise(F.col("epochs"))
    p = p.groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("words"), F.count("*").alias("n"), F.max("epochs").alias("epochs"))
    p = p.select(F.col("doc_id").alias("__id"), F.col("source").alias("__of"), F.col("size").alias("__size"), times.cast("int").alias("__times")).where("__times > 0")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    both = docs.join(p, docs[doc_id].eqNullSafe(p["__id"]) & docs[source].eqNullSafe(p["__of"]) & (size == p["__size"]))
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[docs[c] for c in docs.columns])
