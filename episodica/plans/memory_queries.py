"""Queries over conversations as memories: routing, resolution, coarse graph, retrieval."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vector as V
from ..operators import edges, extract, resolve, retrieve, route
from ..operators.tiles import Pair
from ..profile import ASCII as P
from ..profile import Params
from .adapters import TURNS, sql_any, sql_hits, sql_overlap, sql_tokens, table, turns
from .graph_memory import GAP, SESSIONS, in_memories
from .registry import query
from .text_queries import _sql_chunks, _sql_class, _sql_key, _sql_map, sql_key_match
from .vector_queries import sql_embedding

PARAMS = Params()
#: Turns of one event, where conversations stand for memories.
SPAN = 4


def _keys_struct(text: str):
    return X.key_entities(F.col(text), P)


_KEY_COLUMNS = ", ".join(f"{_sql_key(k, 'text')} AS k_{k}" for k in P.key_patterns)

# --- questions against earlier turns of the same conversation ---

_ASKED = f"""WITH {TURNS}, q AS (SELECT memory_id, id, ord, question, {sql_tokens('question')} AS k FROM turns WHERE valid), n AS (SELECT memory_id, id, ord, text, {sql_tokens('text')} AS k, {sql_any('text', P.critical)} AS crit FROM turns WHERE valid),
ids AS (SELECT 'q' || id AS id, k FROM q UNION ALL SELECT 'n' || id AS id, k FROM n), v AS ({sql_embedding('ids', 'id', 'k')}),
pairs AS (SELECT q.id AS query_id, n.id AS node_id, q.ord AS q_ord, n.ord AS ord, n.memory_id, list_distinct(q.k) AS qt, list_distinct(n.k) AS nt, crit FROM q JOIN n ON q.memory_id = n.memory_id AND n.ord < q.ord),
cs AS (SELECT p.query_id, p.node_id, sum(a.w * b.w) AS cos FROM pairs p JOIN v a ON a.id = 'q' || p.query_id JOIN v b ON b.id = 'n' || p.node_id AND a.idx = b.idx GROUP BY ALL),
scored AS (SELECT p.*, 0.52 * greatest(coalesce(cos, 0), 0) + 0.18 * {sql_overlap('qt', 'nt')} + 0.18 * CASE WHEN crit THEN 0.7 ELSE 0.5 END + 0.12 * exp(-ln(2::DOUBLE) * (q_ord - ord) * 600 / 21600.0::DOUBLE) AS score FROM pairs p LEFT JOIN cs USING (query_id, node_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM scored WHERE score > 0.16)"""


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions, and turns as nodes."""
    t = turns(spark, sf_dir).where("valid")
    q = t.select("memory_id", "id", "ord", X.tokens(F.col("question")).alias("k"))
    n = t.select("memory_id", "id", "ord", "text", X.tokens(F.col("text")).alias("k"), F.when(X.any_of(F.col("text"), P.critical), 0.7).otherwise(0.5).alias("importance"))
    return q, n


def earlier(p: Pair) -> np.ndarray:
    return p.right.ord[None] < p.left.ord[:, None]


def at_the_question(p: Pair) -> dict[str, np.ndarray]:
    """The node score, with weights that decay until the question comes."""
    weight = np.exp2(-600 * (p.left.ord[:, None] - p.right.ord[None]) / PARAMS.half_life)
    return {"score": 0.52 * np.maximum(p.cos, 0) + 0.18 * p.overlap + 0.18 * p.b("importance") + 0.12 * weight}


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = asked(spark, sf_dir)
    return retrieve.search(q, n, score=at_the_question, where=earlier, numbers=([], ["importance"]))


@query(_ASKED + " SELECT query_id, node_id, rank, round(round(score, 9), 6) AS score FROM ranked WHERE rank <= 8")
def query_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.entries(_hits(spark, sf_dir)).select("query_id", "node_id", "rank", F.round("score", 6).alias("score"))


@query(_ASKED + ", h AS (SELECT node_id, count(*) AS n FROM ranked WHERE rank <= 8 GROUP BY ALL) SELECT t.id AS node_id, coalesce(h.n, 0) AS access FROM turns t LEFT JOIN h ON h.node_id = t.id WHERE t.valid")
def access_reinforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = turns(spark, sf_dir).where("valid").select(F.col("id").alias("node_id"), F.lit(0).alias("access"))
    return retrieve.reinforce(n, retrieve.entries(_hits(spark, sf_dir)))


@query(
    _ASKED
    + """, s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS k FROM scored), seeds AS (SELECT query_id, node_id FROM s WHERE k <= 3 AND (round(score, 9) > 0.16 OR k = 1)),
nx AS (SELECT * FROM (SELECT id AS source, lead(id) OVER (PARTITION BY memory_id ORDER BY ord) AS target FROM turns WHERE valid) WHERE target IS NOT NULL), both_ways AS (SELECT source, target FROM nx UNION ALL SELECT target, source FROM nx)
SELECT DISTINCT s.query_id, b.target AS node FROM seeds s JOIN both_ways b ON b.source = s.node_id WHERE (s.query_id, b.target) NOT IN (SELECT (query_id, node_id) FROM seeds)"""
)
def legacy_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = retrieve.seeds(_hits(spark, sf_dir)).select("query_id", F.col("node_id").alias("node"))
    near = edges.follow(turns(spark, sf_dir).where("valid"), "memory_id", "id", ["ord"]).withColumn("weight", F.lit(1.0))
    return edges.expand(s, near)


_SPANS = f"""g AS (SELECT *, memory_id || '/' || (rank // {SPAN}) AS event_id FROM (SELECT * REPLACE (spot AS ord), row_number() OVER (PARTITION BY memory_id ORDER BY spot) - 1 AS rank FROM (
  SELECT * REPLACE (floor(memory_id::BIGINT / {SESSIONS}::DOUBLE)::BIGINT::VARCHAR AS memory_id, ts + (memory_id::BIGINT % {SESSIONS}) * {GAP} AS ts), (memory_id::BIGINT % {SESSIONS}) * 1000000 + ord AS spot FROM turns WHERE valid)))"""
_EVENTS = f"ev0 AS (SELECT memory_id, event_id, min(ord) AS ord, max(ts) AS updated_at, array_to_string(list(text ORDER BY ord), ' ') AS text FROM g GROUP BY ALL), ev AS (SELECT *, {sql_tokens('text')} AS k, {_KEY_COLUMNS} FROM ev0)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid turns with event_id: four in a row are an event of their memory."""
    from pyspark.sql import Window as W

    t = in_memories(turns(spark, sf_dir).where("valid")).drop("event_id", "ord").withColumnRenamed("at", "ord")
    rank = F.row_number().over(W.partitionBy("memory_id").orderBy("ord")) - 1
    return t.withColumn("event_id", F.concat("memory_id", F.lit("/"), F.floor(rank / SPAN)))


def span_events(s: DataFrame) -> DataFrame:
    e = s.groupBy("memory_id", "event_id").agg(F.min("ord").alias("ord"), F.max("ts").alias("updated_at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"))
    return e.withColumn("k", X.tokens(F.col("text"))).withColumn("keys", _keys_struct("text"))


def _sql_route(score: str, gate: bool) -> str:
    gated = f"CASE WHEN {sql_key_match('t.k_', 'e.k_')} < 0.3 THEN 0.15 * ({score}) ELSE {score} END" if gate else score
    return f"""WITH {TURNS}, {_SPANS}, {_EVENTS}, own AS (SELECT event_id, ord AS own, row_number() OVER w - 1 AS n_events, lag(ord) OVER w AS last FROM ev WINDOW w AS (PARTITION BY memory_id ORDER BY ord)),
tk AS (SELECT memory_id, id, ts, own, n_events, last, {sql_tokens('text')} AS k, {_KEY_COLUMNS} FROM g JOIN own USING (event_id)),
ids AS (SELECT id, k FROM tk UNION ALL SELECT event_id AS id, k FROM ev), v AS ({sql_embedding('ids', 'id', 'k')}),
p0 AS (SELECT t.id, e.event_id FROM tk t JOIN ev e ON e.memory_id = t.memory_id AND e.ord < t.own),
cs AS (SELECT p.id, p.event_id, sum(a.w * b.w) AS cos FROM p0 p JOIN v a ON a.id = p.id JOIN v b ON b.id = p.event_id AND a.idx = b.idx GROUP BY ALL),
sc AS (SELECT t.id, e.event_id, e.ord, t.n_events, {gated} AS score FROM tk t JOIN ev e ON e.memory_id = t.memory_id AND e.ord < t.own LEFT JOIN cs c ON c.id = t.id AND c.event_id = e.event_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, ord) AS k FROM sc)
SELECT id, CASE WHEN score >= CASE WHEN n_events <= 3 THEN 0.55 * {PARAMS.new_event} ELSE {PARAMS.new_event} END THEN event_id END AS event_id, round(round(score, 9), 6) AS score FROM r WHERE k = 1"""


_LEXICAL = sql_overlap("list_distinct(t.k)", "list_distinct(e.k)")
_COS = "greatest(coalesce(c.cos, 0), 0)"


def _routed(spark: SparkSession, sf_dir: str, legacy: bool) -> DataFrame:
    s = spans(spark, sf_dir)
    e = span_events(s)
    t = s.select("memory_id", "event_id", "id", "ord", "ts", X.tokens(F.col("text")).alias("k"), _keys_struct("text").alias("keys"))
    return route.route(t, e, PARAMS, P, legacy).withColumn("score", F.round("score", 6))


@query(_sql_route(f"0.52 * {_COS} + 0.18 * {_LEXICAL} + 0.30 * exp(-ln(2::DOUBLE) * abs(e.updated_at - t.ts) / 21600.0::DOUBLE) + CASE WHEN e.ord = t.last THEN 0.15 ELSE 0.0 END", True))
def route_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the events that had ended before its own began."""
    return _routed(spark, sf_dir, False)


@query(_sql_route(f"0.62 * {_COS} + 0.22 * {_LEXICAL} + 0.16 * exp(-ln(2::DOUBLE) * greatest(0.0, t.ts - e.updated_at) / 21600.0::DOUBLE)", False))
def route_turns_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir, True)


# --- chunks of a conversation as entity nodes ---

_NODES = f"""WITH d AS (SELECT conv_id, turn, {_sql_chunks('text')}[1:18] AS a, least(1.0, {sql_hits("lower(coalesce(text, ''))", P.conflicts)} / 2.0::DOUBLE) >= 0.3 AS told FROM conversations), c AS (SELECT conv_id, turn, told, unnest(range(len(a))) AS pos, unnest(a) AS whole FROM d),
k AS (SELECT conv_id AS event_id, {_sql_class('whole', P.classes, P.other_class)} AS kind, whole[1:48] AS name, min(turn * 100 + pos) AS ord, count(*) AS frequency, list(DISTINCT turn) AS turns, max(CASE WHEN told THEN turn ELSE -1 END) AS told FROM c GROUP BY 1, 2, 3),
nodes AS (SELECT *, event_id || ':' || kind || ':' || ord AS id, {sql_tokens('name')} AS k, ord // 100 AS turn FROM k), v AS ({sql_embedding('nodes', 'id', 'k')}),
p AS (SELECT a.event_id, a.kind, a.id AS a_id, b.id AS b_id, a.ord AS a_ord, b.ord AS b_ord, a.turn AS a_turn, b.turn AS b_turn, a.told AS a_told, b.told AS b_told, len(list_intersect(a.turns, b.turns)) > 0 AS together, a.name AS a_name, b.name AS b_name, a.frequency AS a_frequency, b.frequency AS b_frequency, list_distinct(a.k) AS ta, list_distinct(b.k) AS tb FROM nodes a JOIN nodes b ON a.event_id = b.event_id AND a.kind = b.kind AND a.ord < b.ord),
cs AS (SELECT p.a_id, p.b_id, sum(x.w * y.w) AS cos FROM p JOIN v x ON x.id = p.a_id JOIN v y ON y.id = p.b_id AND x.idx = y.idx GROUP BY ALL),
sc AS (SELECT p.*, coalesce(cos, 0) AS cos, 0.70 * greatest(coalesce(cos, 0), 0) + 0.30 * {sql_overlap('ta', 'tb')} AS score FROM p LEFT JOIN cs USING (a_id, b_id))"""
#: Lower than for real facts: chunks of invented prose are never so alike.
MERGE = 0.35


def entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct chunks of a conversation by class: event_id, kind, name, id, ord, turn, frequency, k, keys (turns: all that say it), told (the last of these with a signal of a conflict, or -1)."""
    t = table(spark, sf_dir, "conversations").withColumn("told", X.conflict_signal(F.coalesce("text", F.lit("")), P) >= 0.3)
    f = extract.facts(t, ["conv_id", "turn", "told"], "text", P)
    told = F.max(F.when(F.col("told"), F.col("turn")).otherwise(-1))
    n = f.groupBy(F.col("conv_id").alias("event_id"), "kind", F.col("chunk").alias("name")).agg(F.min(F.col("turn") * 100 + F.col("pos")).alias("ord"), F.count("*").alias("frequency"), told.alias("told"), F.struct(F.collect_set(F.col("turn").cast("string")).alias("turns")).alias("keys"))
    n = n.withColumn("id", F.concat_ws(":", "event_id", "kind", "ord")).withColumn("turn", F.floor(F.col("ord") / 100))
    return n.withColumn("k", X.tokens(F.col("name")))


@query(_NODES + f", r AS (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY round(score, 9) DESC, a_ord) AS n FROM sc) SELECT b_id AS id, CASE WHEN round(score, 9) >= {MERGE} THEN a_id END AS node, round(round(score, 9), 6) AS score FROM r WHERE n = 1")
def entity_match_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.best_match(entity_nodes(spark, sf_dir), ["event_id", "kind"], MERGE).withColumn("score", F.round("score", 6))


@query(_NODES + f", dd AS (SELECT event_id, count(*) AS pairs FROM sc WHERE score >= {MERGE} GROUP BY ALL), nn AS (SELECT event_id, count(*) AS node_count FROM nodes GROUP BY ALL) SELECT event_id, node_count, round(CASE WHEN node_count < 2 THEN 0.0 ELSE coalesce(pairs, 0) / node_count::DOUBLE END, 4) AS duplicate_ratio FROM nn LEFT JOIN dd USING (event_id)")
def duplicate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = entity_nodes(spark, sf_dir)
    return resolve.duplicate_ratio(resolve.duplicates(n, ["event_id", "kind"], MERGE), n, "event_id")


def _sql_evidence(side: str) -> str:
    return f"least(1.0, (0.3 + 0.2 * least(1.0, {side}_frequency / 5.0::DOUBLE) + 0.2 * 0.5) * (1.0 + {_sql_signal(side)} + CASE WHEN {sql_any(f'{side}_name', P.authority)} THEN 0.3 ELSE 0.0 END) + 0.3 * exp(-ln(2::DOUBLE) * (100 - {side}_turn) * 600 / 21600.0::DOUBLE))"


def _sql_signal(side: str) -> str:
    return f"least(1.0, {sql_hits(f'lower({side}_name)', P.conflicts)} / 2.0::DOUBLE)"


def _sql_corrects(new: str, old: str) -> str:
    return f"SELECT {old}_id AS id, {new}_id AS newer, {new}_ord AS came FROM sc WHERE {new}_told > {old}_turn AND NOT together AND cos < 0.5 AND {_sql_evidence(new)} > 1.3 * {_sql_evidence(old)}"


_CORRECTED = _NODES + f", cp AS ({_sql_corrects('b', 'a')} UNION ALL {_sql_corrects('a', 'b')}), co AS (SELECT id, arg_min(newer, came) AS newer FROM cp GROUP BY ALL)"


@query(_CORRECTED + " SELECT id, newer AS corrected_by FROM co")
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.corrections(evident_nodes(spark, sf_dir), ["event_id", "kind"])


def evident_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_nodes() with evidence and the columns that a correction sets."""
    evidence = X.evidence_weight(F.col("name"), F.col("frequency"), F.lit(0.5), (100 - F.col("turn")) * 600, PARAMS.half_life, P)
    n = entity_nodes(spark, sf_dir).withColumn("evidence", evidence)
    return n.withColumns({"corrected": F.lit(False), "weight": F.lit(1.0), "confidence": F.lit(1.0), "correction_source": F.lit("")})


_NEXT = "nx AS (SELECT * FROM (SELECT event_id, id AS source, lead(id) OVER (PARTITION BY event_id ORDER BY ord, id) AS target FROM nodes) WHERE target IS NOT NULL)"


@query(_CORRECTED + """ SELECT n.id, co.id IS NOT NULL AS corrected, CASE WHEN co.id IS NULL THEN 1.0 ELSE 0.1 END::DOUBLE AS weight, CASE WHEN co.id IS NULL THEN 1.0 ELSE 0.1 END::DOUBLE AS confidence, coalesce(newer, '') AS correction_source FROM nodes n LEFT JOIN co USING (id)""")
def conflict_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node after the newer ones have corrected the older."""
    n = evident_nodes(spark, sf_dir)
    nodes, _, _ = resolve.resolve_conflicts(n, _next(n), ["event_id", "kind"])
    return nodes.select("id", "corrected", F.round("weight", 6).alias("weight"), "confidence", "correction_source")


def _next(nodes: DataFrame) -> DataFrame:
    return edges.follow(nodes, "event_id", "id", ["ord", "id"])


@query(_CORRECTED + f", {_NEXT} SELECT 'edge' AS part, source AS id, target AS other FROM nx WHERE source NOT IN (SELECT id FROM co) AND target NOT IN (SELECT id FROM co) UNION ALL SELECT 'corrected', id, newer FROM co")
def conflict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that stay after corrections, and a log row for each correction."""
    n = evident_nodes(spark, sf_dir)
    _, stay, log = resolve.resolve_conflicts(n, _next(n), ["event_id", "kind"])
    kept = stay.select(F.lit("edge").alias("part"), F.col("source").alias("id"), F.col("target").alias("other"))
    return kept.unionByName(log.select(F.col("event_type").alias("part"), "id", F.col("by").alias("other")))


MONTH = 30 * 86400
_WEAK = f"NOT {sql_any('a_name', P.pins)} AND NOT {sql_any('b_name', P.pins)} AND round(0.35 * exp(-ln(2::DOUBLE) * {MONTH} / 21600.0::DOUBLE) + 0.25 * round(greatest(0.05, least(1.0, 0.50 + {_sql_map('kind', P.boosts, 0.05)})), 4), 4) < 0.16"
#: The greedy walk: a node is gone where an earlier one that stays is like it, and goes into the first of these.
_GREEDY = f""", al AS (SELECT b_id AS id, list(a_id ORDER BY a_ord) AS near FROM sc WHERE {_WEAK} AND score >= {MERGE} GROUP BY ALL),
nn AS (SELECT n.event_id, n.kind, n.id, row_number() OVER (PARTITION BY n.event_id, n.kind ORDER BY n.ord) AS place, coalesce(al.near, []) AS near FROM nodes n LEFT JOIN al USING (id)),
walk AS (SELECT event_id, kind, 0::BIGINT AS place, []::VARCHAR[] AS stay, NULL::VARCHAR AS id, NULL::VARCHAR AS kept FROM (SELECT DISTINCT event_id, kind FROM nn)
  UNION ALL SELECT nn.event_id, nn.kind, nn.place, CASE WHEN len(list_intersect(nn.near, w.stay)) > 0 THEN w.stay ELSE list_append(w.stay, nn.id) END, nn.id, list_filter(nn.near, lambda x: list_contains(w.stay, x))[1]
  FROM walk w JOIN nn ON nn.event_id = w.event_id AND nn.kind = w.kind AND nn.place = w.place + 1),
m AS (SELECT id, kept FROM walk WHERE kept IS NOT NULL)"""
_RECURSIVE = _NODES.replace("WITH ", "WITH RECURSIVE ", 1)


def weak_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_nodes() with their weights a month after they were seen: most are weak by then, but not hazards and those pinned."""
    n = entity_nodes(spark, sf_dir).withColumn("pinned", X.any_of(F.col("name"), P.pins))
    weight = V.active_weight(F.lit(MONTH), F.lit(0), X.importance(F.col("kind"), P), F.lit(0.0), F.col("pinned"), PARAMS)
    return n.withColumn("weight", F.round(weight, 4))


@query(_RECURSIVE + _GREEDY + " SELECT id, kept AS into FROM m")
def compression_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.compression_plan(weak_nodes(spark, sf_dir), ["event_id", "kind"], MERGE)


@query(_RECURSIVE + _GREEDY + " SELECT coalesce(m.kept, n.id) AS id, sum(frequency)::BIGINT AS frequency, min(turn) AS first_seen, max(turn) AS last_seen, array_to_string(list_sort(list_distinct(list(turn))), '|') AS turns FROM nodes n LEFT JOIN m USING (id) GROUP BY 1")
def node_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = weak_nodes(spark, sf_dir)
    plan = resolve.compression_plan(n, ["event_id", "kind"], MERGE)
    rows = n.select("id", "ord", "frequency", F.col("turn").alias("first_seen"), F.col("turn").alias("last_seen"), F.lit(0).alias("access"), F.lit(0.5).alias("importance"), F.array("turn").alias("turns"))
    out = resolve.roll_up(rows, plan)
    return out.select("id", "frequency", "first_seen", "last_seen", F.array_join(F.array_sort("turns"), "|").alias("turns"))


@query(
    _NODES
    + """, f AS (SELECT *, min_by(whole[1:48], pos) FILTER (kind = 'location') OVER (PARTITION BY conv_id, turn) AS place FROM (SELECT conv_id, turn, pos, whole, """
    + _sql_class("whole", P.classes, P.other_class)
    + f""" AS kind FROM c)), r AS (SELECT conv_id AS event_id, whole[1:48] AS s, place AS t, row_number() OVER (PARTITION BY conv_id, turn ORDER BY {'CASE kind ' + ' '.join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(('person', 'location', 'equipment', 'material', 'building_area', 'hazard'))) + ' END'}, pos) AS n FROM f WHERE kind <> 'location' AND place IS NOT NULL),
fn AS (SELECT event_id, name, arg_min(id, ord) AS id FROM nodes GROUP BY ALL)
SELECT r.event_id, a.id AS source, b.id AS target, least(8.0, round(0.9 * count(*), 6))::DOUBLE AS weight, count(*) AS frequency FROM r JOIN fn a ON a.event_id = r.event_id AND a.name = r.s JOIN fn b ON b.event_id = r.event_id AND b.name = r.t WHERE n <= 10 AND a.id <> b.id GROUP BY ALL"""
)
def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = extract.facts(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", P)
    r = extract.relations(facts, ["conv_id", "turn"], P).withColumnRenamed("conv_id", "event_id")
    e = resolve.relation_edges(r, entity_nodes(spark, sf_dir), "event_id", P.location_label)
    e = edges.accumulate(e.withColumn("at", F.lit(0)), ["event_id", "source", "target"], 0.9, "at", "at")
    return e.select("event_id", "source", "target", F.round("weight", 6).alias("weight"), "frequency")
