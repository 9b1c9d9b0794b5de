"""Queries over windows, edges, aggregates and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import edges, events, report
from ..profile import ASCII as P
from ..profile import Params
from ..sources import tables as S
from .adapters import TURNS, quote, sql_any, sql_tokens, table, turns
from .registry import query
from .text_queries import SCORED, STOP, scored_turns
from .vector_queries import NODES, SQL_WEIGHT, centroids, timed_nodes, weighted_nodes

COLD = Params()


@query(
    f"""WITH {SCORED}, r AS (SELECT memory_id, ord, density, avg(density) OVER w AS mean, count(*) OVER w AS n FROM scored WHERE valid WINDOW w AS (PARTITION BY memory_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, CASE WHEN density >= {COLD.density} THEN 'density' WHEN mean >= 0.7 * {COLD.density} AND n >= 2 THEN 'mean' WHEN n >= {COLD.cold_start} THEN 'count' END AS reason FROM r)
SELECT memory_id, ord, n, reason FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY ord) AS k FROM f WHERE reason IS NOT NULL) WHERE k = 1"""
)
def cold_start_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.cold_start(scored_turns(spark, sf_dir), COLD)


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), c0 AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(64)) AS i, unnest(v) AS x FROM e) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM c0 GROUP BY ALL),
s AS (SELECT vec_id, label, list_inner_product(v, c) / sqrt(list_inner_product(v, v) * list_inner_product(c, c)) AS score FROM e JOIN c USING (label))
SELECT vec_id, round(avg(score) OVER w, 6) AS mean8, array_to_string(list(vec_id) OVER w, '|') AS last8 FROM s WINDOW w AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"""
)
def last8_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector's consistency is its cosine with its label's centre; the mean of the last eight."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v")).where("v IS NOT NULL")
    scored = e.join(centroids(e, "label", "v"), "label").withColumn("score", V.cosine(F.col("v"), F.col("centre")))
    return events.consistency(scored, "label", "vec_id", ["vec_id"], "score").select("vec_id", F.round("mean8", 6).alias("mean8"), F.array_join("last8", "|").alias("last8"))


@query(
    f"WITH {TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY ord DESC) AS k FROM turns WHERE valid) SELECT memory_id, list(text ORDER BY ord) FILTER (k <= 4) AS last4, list(id ORDER BY ord) FILTER (k <= 10) AS last10 FROM n GROUP BY memory_id"
)
def recent_turn_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.recent(turns(spark, sf_dir).where("valid"), {"last4": ("text", 4), "last10": ("id", 10)})


@query("SELECT user_id, event_id AS source, next AS target FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL")
def temporal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.follow(table(spark, sf_dir, "events"), "user_id", "event_id", ["ts", "event_id"])


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, (vec_id % 10) / 20.0::DOUBLE AS weight, vec_id % 25 = 0 AS pinned FROM embeddings),
n AS (SELECT *, lead(vec_id) OVER w AS b, lead(v) OVER w AS bv, lead(weight) OVER w AS bw, lead(pinned) OVER w AS bp FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label, vec_id AS source, b AS target FROM n WHERE b IS NOT NULL AND NOT pinned AND NOT bp AND (weight < 0.16 OR bw < 0.16) AND list_inner_product(v, bv) / sqrt(list_inner_product(v, v) * list_inner_product(bv, bv)) >= 0.1"""
)
def adjacent_merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"), ((F.col("vec_id") % 10) / 20.0).alias("weight"), (F.col("vec_id") % 25 == 0).alias("pinned"))
    return events.adjacent_pairs(rows, "label", "vec_id", ["vec_id"], threshold=0.1)


_COOCCUR = "d AS (SELECT DISTINCT user_id, ts::DATE AS day, event_type FROM events), s AS (SELECT user_id, day FROM d GROUP BY ALL HAVING count(*) BETWEEN 2 AND 10), p AS (SELECT a.user_id, a.day, a.event_type AS source, b.event_type AS target FROM d a JOIN d b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type < b.event_type JOIN s ON s.user_id = a.user_id AND s.day = a.day)"


def _cooccurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    return edges.cooccurrence(e, ["user_id", "day"], "event_type")


@query(f"WITH {_COOCCUR} SELECT user_id, day::VARCHAR AS day, source, target FROM p")
def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cooccurring(spark, sf_dir).select("user_id", F.col("day").cast("string").alias("day"), "source", "target")


@query(f"WITH {_COOCCUR} SELECT user_id || '|with|' || source || '|' || target AS edge_id, least(8.0, round(0.7 * count(*), 6))::DOUBLE AS weight, count(*) AS frequency, max(day)::VARCHAR AS last_seen, count(DISTINCT day) AS n_evidence FROM p GROUP BY user_id, source, target")
def edge_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges.accumulate(_cooccurring(spark, sf_dir), ["user_id", "source", "target"], 0.7, "day", "day")
    return e.select(edges.edge_id(F.col("user_id"), F.lit("with"), F.col("source"), F.col("target")).alias("edge_id"), F.round("weight", 6).alias("weight"), "frequency", F.col("last_seen").cast("string").alias("last_seen"), F.size("evidence").alias("n_evidence"))


@query(f"WITH {_COOCCUR}, e AS (SELECT user_id, count(DISTINCT source || '|' || target) AS k FROM p GROUP BY ALL), n AS (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY ALL) SELECT user_id, round(CASE WHEN n < 2 THEN 0.0 ELSE least(1.0, coalesce(k, 0) / (n * (n - 1) / 2::DOUBLE)) END, 6) AS density FROM n LEFT JOIN e USING (user_id)")
def edge_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    return edges.density(_cooccurring(spark, sf_dir), nodes, "user_id").withColumn("density", F.round("density", 6))


@query(f"WITH {NODES}, w AS (SELECT *, {SQL_WEIGHT} AS weight FROM nodes) SELECT event_id, NOT pinned AND weight < 0.16 AND importance < 0.70 AS pruned, NOT pinned AND weight < 0.25 AND importance < 0.70 AS pruned_at_025 FROM w")
def prune_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the default threshold, and by one that more nodes fall under."""
    return weighted_nodes(spark, sf_dir).select("event_id", events.prunable(COLD.compress).alias("pruned"), events.prunable(0.25).alias("pruned_at_025"))


_FORGET = f"WITH {NODES}, f AS (SELECT *, CASE WHEN pinned THEN 1.0 ELSE least(1.0, exp(-ln(2::DOUBLE) * greatest(0, age) / 432000.0::DOUBLE) + 0.18 * importance) END AS survival FROM nodes)"


@query(_FORGET + " SELECT event_id, NOT pinned AND survival < 0.16 AND importance < 0.70 AS forgotten, NOT pinned AND survival < 0.16 AND importance < 0.62 AS skipped, survival < 0.16 AND importance < 0.62 AS skipped_as_neighbour FROM f")
def forget_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nodes forgetting removes, and which a search passes over, met directly or as a neighbour."""
    n = timed_nodes(spark, sf_dir)
    n = n.withColumn("survival", V.legacy_survival(F.col("age"), F.col("importance"), F.col("pinned"), 432000.0))
    faded = F.col("survival") < 0.16
    return n.select("event_id", (~F.col("pinned") & faded & (F.col("importance") < 0.70)).alias("forgotten"), (~F.col("pinned") & faded & (F.col("importance") < 0.62)).alias("skipped"), (faded & (F.col("importance") < 0.62)).alias("skipped_as_neighbour"))


_FOLLOW = "t AS (SELECT user_id, event_id AS source, next AS target FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL)"


@query(_FORGET + f", g AS (SELECT event_id FROM f WHERE NOT pinned AND survival < 0.16 AND importance < 0.70), {_FOLLOW} SELECT user_id, source, target FROM t WHERE source NOT IN (SELECT event_id FROM g) AND target NOT IN (SELECT event_id FROM g)")
def cascade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = forget_legacy(spark, sf_dir).where("forgotten")
    return edges.cascade(temporal_edges(spark, sf_dir), gone, "event_id")


@query(f"WITH {_COOCCUR} SELECT DISTINCT user_id || '/' || day AS event_id FROM d WHERE (user_id, day) NOT IN (SELECT (user_id, day) FROM p)")
def events_without_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a user as events: those without a pair of types."""
    day = F.concat_ws("/", "user_id", F.col("day").cast("string")).alias("event_id")
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).select(day).distinct()
    return edges.without_edges(days, [_cooccurring(spark, sf_dir).select(day)], "event_id")


@query(f"WITH {TURNS} SELECT memory_id, count(*) AS turns, count(*) FILTER (valid) AS valid_turns, count(*) FILTER (answer <> '') AS answered FROM turns GROUP BY ALL")
def turn_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return t.groupBy("memory_id").agg(F.count("*").alias("turns"), F.count_if("valid").alias("valid_turns"), F.count_if(F.col("answer") != "").alias("answered"))


@query(
    """WITH prices(model, price) AS (VALUES ('A', 0.008), ('N', 0.02), ('R', 0.02)), u AS (SELECT l_returnflag AS model, sum(coalesce(l_quantity, 0))::DOUBLE AS i, sum(coalesce(l_linenumber, 0))::DOUBLE AS o FROM lineitem GROUP BY ALL)
SELECT u.model, round(i / 1000 * price, 6)::DOUBLE AS input_cost, round(o / 1000 * price, 6)::DOUBLE AS output_cost, round(i / 1000 * price + o / 1000 * price, 6)::DOUBLE AS total_cost FROM u LEFT JOIN prices USING (model)"""
)
def price_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_quantity").cast("double").alias("input_tokens"), F.col("l_linenumber").cast("double").alias("output_tokens"))
    prices = spark.createDataFrame([("A", 0.008), ("N", 0.02), ("R", 0.02)], "model string, price_per_1k_tokens double")
    return events.price(usage, prices)


@query("SELECT user_id, event_type, epoch_us(max(ts)) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    half = F.col("event_id") % 2 == 0
    out = S.upsert(e.where(half), e.where(~half), ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_id")


@query("SELECT event_id FROM events WHERE event_type <> 'error'")
def delete_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return S.delete(e, e.where("event_type = 'error'"), ["event_id"]).select("event_id")


@query("SELECT vec_id, coalesce(len(embedding), 0) = 64 AND vec_id % 9 <> 0 AS accepted FROM embeddings")
def dimension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"))
    good, bad = S.dimension_split(e, "embedding", 64)
    return good.select("vec_id", F.lit(True).alias("accepted")).unionByName(bad.select("vec_id", F.lit(False).alias("accepted")))


@query("SELECT user_id, event_id FROM events WHERE event_id % 3 <> 0 UNION SELECT user_id, event_id FROM events WHERE event_id % 2 = 0")
def membership_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    listed = e.where("event_id % 3 <> 0").unionByName(e.select("user_id", (-1 - F.col("event_id")).alias("event_id")))
    return S.repair_members(listed, e, e.where("event_id % 2 = 0"), ["event_id"])


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4 = 0, CASE WHEN event_id % 4 <> 0 THEN event_id END, ts, event_id) AS ord FROM events")
def order_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    known = e.where("event_id % 4 <> 0").select("event_id", F.col("event_id").alias("known"))
    return S.repair_order(e, known, "user_id", "event_id", "known", "ts")


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing, 1.0::DOUBLE AS weight FROM events")
def payload_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "props")
    return S.decode(e, "props", {"k": ("long", 0), "missing": ("string", "none"), "weight": ("double", 1.0)}, ["event_id"])


@query("SELECT event_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS payload FROM events")
def payload_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.encode(table(spark, sf_dir, "events"), ["event_id"], ["event_id", "event_type", "user_id"])


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view, count(*) > 0 AS ok FROM events GROUP BY ALL")
def edge_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type IN ('click', 'error', 'view')").groupBy("user_id").pivot("event_type", ["click", "error", "view"]).count()
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    full = users.join(e, "user_id", "left").na.fill(0)
    return full.withColumn("ok", F.lit(True))


@query("SELECT user_id, event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS created, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS before FROM events GROUP BY ALL")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by user and type before an update in the middle of the table's time, and those that came with it."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return report.change_counts(e.where("ts < TIMESTAMP '2024-01-16'"), e, ["user_id", "event_type"], "event_id")


@query("SELECT CASE WHEN user_id % 10 = 3 THEN user_id - 3 ELSE user_id END AS user_id, count(*) AS events, max(value) AS top FROM events GROUP BY 1")
def merge_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "value")
    mapping = e.where("user_id % 10 = 3").select(F.col("user_id").alias("old"), (F.col("user_id") - 3).alias("kept")).distinct()
    return events.rekey(e, mapping, "user_id").groupBy("user_id").agg(F.count("*").alias("events"), F.max("value").alias("top"))


@query("WITH m AS (SELECT user_id, max(event_id) AS newest FROM events GROUP BY ALL) SELECT event_id, event_id = newest AS is_newest FROM events JOIN m USING (user_id)")
def newest_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("event_id") == F.max("event_id").over(W.partitionBy("user_id"))).alias("is_newest"))


@query(f"WITH {TURNS} SELECT memory_id, list(id ORDER BY ord) AS members, min(ts) AS start_time, max(ts) AS end_time, round(least(1.0, 0.3 + 0.3 * max(ord % 3) / 2.0::DOUBLE + 0.4 * max({sql_any('text', P.critical)}::INT)), 4)::DOUBLE AS importance FROM turns WHERE valid GROUP BY ALL")
def event_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).where("valid").withColumn("saliency", (F.col("ord") % 3) / 2.0)
    return events.frame(t, "memory_id", P)


_HEADS = f"v AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY ord) AS n FROM turns WHERE valid), h0 AS (SELECT memory_id, array_to_string(list(text ORDER BY ord) FILTER (n <= 3), ' ') AS head, list(text ORDER BY ord) FILTER (n <= 6) AS six FROM v GROUP BY ALL), h AS (SELECT *, list_sort(list_filter(list_distinct({sql_tokens('head')}), lambda x: length(x) > 1 AND NOT list_contains({STOP}, x)))[1:3] AS words FROM h0)"
_TITLES = f"CASE {' '.join(f'WHEN contains(head, {quote(w)}) THEN {quote(w + P.title_suffix)}' for w in P.critical)} WHEN len(words) > 0 THEN array_to_string(words, ' / ')[1:18] ELSE head[1:18] END AS title"


def _sql_summary(pieces: str) -> str:
    return f"array_to_string(list_transform(list_filter(list_zip(({pieces})[1:6], range(1, len(({pieces})[1:6]) + 1)), lambda x: list_position(({pieces})[1:6], x[1]) = x[2]), lambda x: x[1]), '; ')[1:240]"


@query(f"WITH {TURNS}, {_HEADS} SELECT memory_id, {_TITLES}, {_sql_summary('six')} AS summary FROM h")
def event_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.titles(turns(spark, sf_dir).where("valid"), "memory_id", P)


@query(f"WITH {TURNS}, {_HEADS}, one AS (SELECT *, {_TITLES}, {_sql_summary('six')} AS summary FROM h) SELECT memory_id, title, {_sql_summary('list_prepend(summary, six)')} AS summary FROM one")
def event_titles_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles and summaries of events that have had some before."""
    t = turns(spark, sf_dir).where("valid")
    return events.titles(t, "memory_id", P, events.titles(t, "memory_id", P))
