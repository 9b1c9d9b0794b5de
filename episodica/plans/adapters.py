"""The given tables in the shapes that the jobs take, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..profile import ASCII, Profile

#: Seconds since the epoch of turn 0, and between turns: the table has no times.
BASE, STEP = 1_700_000_000, 600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out to all cores where their files make fewer tasks than there are: each text is long work."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def turns(spark: SparkSession, sf_dir: str, profile: Profile = ASCII) -> DataFrame:
    """(memory_id, ord, id, question, answer, text, ts, valid): a user row with the assistant row after it; system rows aren't valid."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    user = F.col("role") == "user"
    question = F.when(user, F.coalesce("text", F.lit(""))).otherwise("")
    answer = F.when(user & (F.col("next_role") == "assistant"), F.coalesce("next_text", F.lit(""))).otherwise("")
    c = c.where("role IN ('user', 'system')").select(F.col("conv_id").cast("string").alias("memory_id"), F.col("turn").alias("ord"), F.concat_ws(":", "conv_id", "turn").alias("id"), question.alias("question"), answer.alias("answer"), (BASE + STEP * F.col("turn")).cast("double").alias("ts"), user.alias("valid"))
    return c.withColumn("text", X.normalize(F.concat(F.lit("Q: "), "question", F.lit(" A: "), "answer", F.lit(" V: "))))


def sql_normalize(x: str) -> str:
    space = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return f"trim(regexp_replace(coalesce({x}, ''), '{space}', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    low = f"lower({sql_normalize(x)})"
    chars = f"regexp_extract_all({low}, '[a-z0-9一-鿿]')"
    return f"(SELECT list_concat(list_concat(list_filter(regexp_extract_all(z.l, '[a-z0-9]+'), lambda w: length(w) > 1), regexp_extract_all(z.l, '[一-鿿]')), CASE WHEN len(z.c) > 1 THEN list_transform(list_zip(z.c[1:len(z.c) - 1], z.c[2:len(z.c)]), lambda p: p[1] || p[2]) ELSE [] END) FROM (SELECT {low} AS l, {chars} AS c) z)"


def sql_hits(x: str, words) -> str:
    return "(" + " + ".join(f"contains({x}, {quote(w)})::INT" for w in words) + ")"


def sql_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(w)})" for w in words) + ")"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def sql_dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


#: turns() in SQL, for a WITH list.
TURNS = f"""
conv AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
turns0 AS (SELECT conv_id::VARCHAR AS memory_id, turn AS ord, conv_id || ':' || turn AS id,
  CASE WHEN role = 'user' THEN coalesce(text, '') ELSE '' END AS question,
  CASE WHEN role = 'user' AND next_role = 'assistant' THEN coalesce(next_text, '') ELSE '' END AS answer,
  ({BASE} + {STEP} * turn)::DOUBLE AS ts, role = 'user' AS valid FROM conv WHERE role IN ('user', 'system')),
turns AS (SELECT *, {sql_normalize("'Q: ' || question || ' A: ' || answer || ' V: '")} AS text FROM turns0)"""
