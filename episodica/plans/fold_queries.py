"""Queries over order-dependent folds and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import edges, events, extract, folds, maintain
from ..profile import ASCII as P
from ..profile import Params
from ..sources import scratch
from ..sources import tables as S
from ..streaming import ingest
from .adapters import TURNS, sql_overlap, sql_tokens, table, turns
from .graph_memory import GRAPH, TOPIC_AS_OF, TOPIC_TALKS, edge_tables, event_table, memory_turns, node_tables, stored, topic_talks, topic_turns
from .memory_queries import _EVENTS, _SPANS, span_events, spans
from .registry import query
from .text_queries import sql_key_match
from .vector_queries import sql_embedding

PARAMS = Params()
#: Invented prose is alike in syllables, so clusters part at a higher score than real turns.
CLUSTER = Params(cluster=0.62)


@query()
def cluster_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.cluster_turns(turns(spark, sf_dir).where("valid"), CLUSTER, P)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = extract.facts(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", P)
    return f.select(F.col("conv_id").cast("string").alias("event_id"), "kind", F.concat_ws(":", "conv_id", "turn", "pos").alias("fact_id"), (F.col("turn") * 100 + F.col("pos")).alias("ord"), F.col("chunk").alias("name"), "turn")


@query()
def resolve_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.resolve_nodes(_facts(spark, sf_dir), 0.35)


@query()
def resolve_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal texts at their nodes: candidates of any class."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("event_id"), "turn", extract.causal(extract.chunks(F.col("text"), P), P).alias("c"))
    rows = rows.select("event_id", F.col("c.causal_type").alias("kind"), F.concat_ws(":", "event_id", "turn").alias("fact_id"), F.col("turn").alias("ord"), F.col("c.text").alias("name"))
    return folds.resolve_nodes(rows.where("name <> ''"), PARAMS.entity_merge, by_class=False)


@query()
def initialise_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From turns to clusters, and from these to events with their frames, titles, and the nodes and edges of three graphs: one row an event."""
    t = turns(spark, sf_dir).where("valid").withColumn("saliency", F.lit(0.0))
    c = folds.cluster_turns(t, CLUSTER, P).select("id", F.concat_ws("/", "memory_id", "cluster").alias("event_id"))
    t = scratch.materialize(t.join(c, "id"))  # read by every branch
    nodes = stored(node_tables(t))
    out = events.frame(t, "event_id", P).join(events.titles(t, "event_id", P), "event_id")
    out = out.select("event_id", "title", "summary", F.size("members").alias("turns"), "start_time", "end_time", "importance")
    counted = {f"{g}_nodes": n for g, n in nodes.items()} | {f"{g}_edges": e for g, e in edge_tables(t, nodes).items()}
    for name, rows in counted.items():
        out = out.join(rows.groupBy("event_id").agg(F.count("*").alias(name)), "event_id", "left")
    return out.na.fill(0, list(counted))


#: The greedy walk over similar pairs in SQL, memory by memory.
_MERGED = TOPIC_TALKS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", si AS (SELECT memory_id, source, target, a_ord, b_ord FROM (SELECT *, round(CASE WHEN {sql_key_match('a_', 'b_')} < 0.3 THEN 0.1 ELSE 1.0 END * (0.76 * cos + 0.24 * lexical), 9) AS score FROM j) WHERE score >= 0.56),
al AS (SELECT target AS id, list(source ORDER BY a_ord) AS near FROM si GROUP BY ALL), nn AS (SELECT ev.memory_id, ev.event_id AS id, row_number() OVER (PARTITION BY ev.memory_id ORDER BY ev.ord) AS place, coalesce(al.near, []) AS near FROM ev LEFT JOIN al ON al.id = ev.event_id),
walk AS (SELECT memory_id, 0::BIGINT AS place, []::VARCHAR[] AS stay, NULL::VARCHAR AS id, NULL::VARCHAR AS head FROM (SELECT DISTINCT memory_id FROM nn)
  UNION ALL SELECT nn.memory_id, nn.place, CASE WHEN len(list_intersect(nn.near, w.stay)) > 0 THEN w.stay ELSE list_append(w.stay, nn.id) END, nn.id, list_filter(nn.near, lambda x: list_contains(w.stay, x))[1] FROM walk w JOIN nn ON nn.memory_id = w.memory_id AND nn.place = w.place + 1),
mg AS (SELECT memory_id, head AS kept, id AS gone FROM walk WHERE head IS NOT NULL)"""


@query(_MERGED + " SELECT * FROM mg")
def merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.merges(topic_talks(spark, sf_dir), P)


@query(_MERGED + ", tm AS (SELECT tt.*, coalesce(kept, event_id) AS to_event FROM tt LEFT JOIN mg ON mg.gone = tt.event_id), n AS (SELECT coalesce(kept, event_id) AS event_id, count(DISTINCT (graph, coalesce(kind, ''), coalesce(label, body))) AS nodes FROM nodes LEFT JOIN mg ON mg.gone = nodes.event_id GROUP BY 1) SELECT to_event AS event_id, count(*) AS turns, coalesce(any_value(n.nodes), 0) AS nodes FROM tm LEFT JOIN n ON n.event_id = to_event GROUP BY to_event")
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar events merged: the turns go to the event that stays, whose graphs are made anew from all of them."""
    t = topic_turns(spark, sf_dir)
    plan = edges.merges(event_table(t, node_tables(t, TOPIC_AS_OF), TOPIC_AS_OF), P).select(F.col("gone").alias("old"), "kept")
    moved = events.rekey(t, plan, "event_id")
    counts = [n.groupBy("event_id").agg(F.count("*").alias("n")) for n in node_tables(moved, TOPIC_AS_OF).values()]
    nodes = counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy("event_id").agg(F.sum("n").alias("nodes"))
    return moved.groupBy("event_id").agg(F.count("*").alias("turns")).join(nodes, "event_id", "left").na.fill(0, ["nodes"])


@query()
def fused_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).where("valid")
    return folds.fuse_summaries(t.select(F.col("memory_id").alias("event_id"), "ord", "text"), P.join)


@query()
def updated_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's summary after its last turn: the one before, the turn's own, and the last three of the last four texts, without pieces alike."""
    t = turns(spark, sf_dir).where("valid").withColumn("event_id", F.col("memory_id"))
    pieces = events.summary_pieces(events.titles(t, "event_id", P), t, P)
    return folds.fuse_summaries(pieces, P.join)


def _replayed(spark: SparkSession, sf_dir: str, rows: DataFrame, start, schema: str, batches: int = 4) -> DataFrame:
    """What a stream makes of rows that come in batches by ord, one after the other."""
    base = f"{scratch.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    names = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    kept = scratch.materialize(rows)
    for i in range(batches):
        last = i == batches - 1
        kept.where(F.col("ord") >= 2 * i if last else (F.col("ord") >= 2 * i) & (F.col("ord") < 2 * i + 2)).write.mode("append").parquet(f"{base}/in")
        ingest.run_once(start(ingest.read_turns(spark, f"{base}/in", names, files_per_batch=1_000)), f"{base}/out", f"{base}/state")
    return spark.read.schema(schema).parquet(f"{base}/out")


@query()
def incremental_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' turns through the stream, in four micro-batches; the rows are those of cluster_turns."""
    source = turns(spark, sf_dir).where("valid").select("memory_id", "id", "ord", "ts", "text")
    return _replayed(spark, sf_dir, source, lambda s: ingest.assign(s, CLUSTER, P), ingest.RESULT)


@query(GRAPH + " SELECT CASE graph WHEN 0 THEN 'entity' WHEN 1 THEN 'temporal' ELSE 'causal' END AS graph, event_id, coalesce(kind, '') AS kind, CASE WHEN graph = 1 THEN label ELSE body END AS name, ord, frequency, first_seen, last_seen FROM nodes")
def incremental_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three graphs' nodes from turns in four micro-batches, each added to what there was."""
    base = f"{scratch.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    t = memory_turns(spark, sf_dir).select("memory_id", "event_id", "id", "ord", "ts", "question", "answer", "text")
    names = ", ".join(f"{n} {k}" for n, k in t.dtypes)
    kept = scratch.materialize(t)
    for i in range(4):
        kept.where(F.col("ord") >= 6 if i == 3 else (F.col("ord") >= 2 * i) & (F.col("ord") < 2 * i + 2)).write.mode("append").parquet(f"{base}/in")
        ingest.apply_turns(ingest.read_turns(spark, f"{base}/in", names, files_per_batch=1_000), node_tables, f"{base}/deltas", f"{base}/state")
    return ingest.current_nodes(spark, f"{base}/deltas").drop("memory_id")


_DRIFT = f"""WITH {TURNS}, {_SPANS}, {_EVENTS}, tk AS (SELECT g.event_id, g.id, g.ord, {sql_tokens('g.text')} AS k FROM g), ids AS (SELECT id, k FROM tk UNION ALL SELECT event_id AS id, k FROM ev), v AS ({sql_embedding('ids', 'id', 'k')}),
cs AS (SELECT t.id, sum(a.w * b.w) AS cos FROM tk t JOIN v a ON a.id = t.id JOIN v b ON b.id = t.event_id AND a.idx = b.idx GROUP BY ALL),
dr AS (SELECT t.event_id, t.id, t.ord, row_number() OVER (PARTITION BY t.event_id ORDER BY t.ord DESC) AS n, 0.70 * greatest(coalesce(cos, 0), 0) + 0.30 * {sql_overlap('list_distinct(t.k)', 'list_distinct(e.k)')} AS score FROM tk t JOIN ev e USING (event_id) LEFT JOIN cs USING (id))"""


def _drifting(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    s = spans(spark, sf_dir)
    e = span_events(s).withColumn("t", F.array_distinct("k"))
    return maintain.drift(s.select("event_id", "id", "ord", X.tokens(F.col("text")).alias("k")), e, least=least)


@query(_DRIFT + " SELECT event_id, id, n <= 10 AND score < 0.20 AS drifts, n <= 10 AND score < 0.66 AS drifts_at_066 FROM dr")
def drift_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns unlike their event, by the default threshold, and by one that invented prose reaches."""
    low = _drifting(spark, sf_dir, 0.66).select("id", F.col("drifts").alias("drifts_at_066"))
    return _drifting(spark, sf_dir, 0.20).join(low, "id")


@query(
    _DRIFT
    + """, d AS (SELECT event_id, id, ord, n <= 10 AND score < 0.66 AS drifts FROM dr), c AS (SELECT event_id, count(*) AS n, count(*) FILTER (drifts) AS d, min(id) FILTER (drifts) AS first FROM d GROUP BY ALL)
SELECT d.event_id, d.id, CASE WHEN drifts AND c.n >= 3 AND c.d >= 3 AND c.d < c.n THEN d.event_id || '+' || c.first ELSE d.event_id END AS new_event FROM d JOIN c USING (event_id)"""
)
def drift_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.split_plan(_drifting(spark, sf_dir, 0.66))


@query(f"WITH {TURNS}, {_SPANS}, gone AS (SELECT id FROM g WHERE ord % 4 = 0), n AS (SELECT event_id, count(*) FILTER (id NOT IN (SELECT id FROM gone)) AS n, count(*) FILTER (id IN (SELECT id FROM gone)) AS d FROM g GROUP BY ALL) SELECT event_id, CASE WHEN n = 0 THEN 'drop' ELSE 'rebuild' END AS action FROM n WHERE d > 0")
def delete_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).select("event_id", "id", "ord")
    return maintain.delete_turns(s, s.where("ord % 4 = 0"))[1]


_DNS_ID = f"""WITH {TURNS}, h AS (SELECT id, sha1(unhex('{S.DNS}') || encode(id)) AS h FROM turns)
SELECT id, h[1:12] || '5' || h[14:16] || substr('89ab', ('0x' || h[17:17])::INTEGER % 4 + 1, 1) || h[18:32] AS point_id FROM h"""


@query(_DNS_ID)
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version-5 ids of the turns."""
    return turns(spark, sf_dir).select("id", S.point_id(F.col("id")).alias("point_id"))


@query("""WITH e AS (SELECT user_id AS memory_id, event_id AS source, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target, event_type FROM events),
f AS (SELECT *, {'source': source, 'target': target} AS edge FROM e WHERE target IS NOT NULL), o AS (SELECT user_id AS memory_id, to_json(list(event_id ORDER BY ts, event_id))::VARCHAR AS event_order FROM events GROUP BY ALL)
SELECT memory_id, event_order, temporal, errors FROM o LEFT JOIN (SELECT memory_id, to_json(list(edge ORDER BY source, target))::VARCHAR AS temporal, to_json(list(edge ORDER BY source, target) FILTER (WHERE event_type = 'error'))::VARCHAR AS errors FROM f GROUP BY memory_id) USING (memory_id)""")
def state_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each memory with its order and its lists of edges, as JSON; written and read back."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("memory_id"), F.col("event_id").alias("source"), F.lead("event_id").over(w).alias("target"), "event_type", "ts")
    follow = e.where("target IS NOT NULL")
    doc = S.state_document({"temporal": follow.select("memory_id", "source", "target"), "errors": follow.where("event_type = 'error'").select("memory_id", "source", "target")}, {"event_order": e.select("memory_id", "ts", F.col("source").alias("id"))})
    path = f"{scratch.shared_dir(spark)}/state-{uuid.uuid4().hex}"
    S.write_state(doc, path)
    back = spark.read.schema(doc.schema).json(path)
    return back.select("memory_id", F.to_json("event_order").alias("event_order"), F.to_json("temporal").alias("temporal"), F.to_json("errors").alias("errors"))
