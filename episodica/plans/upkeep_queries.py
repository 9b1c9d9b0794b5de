"""Queries over the upkeep of a memory's three graphs: corrections, compression, rebuilds, deletions, the one-graph form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vector as V
from ..operators import edges, events, extract, folds, maintain, resolve, retrieve
from ..profile import ASCII as P
from .adapters import quote, sql_any, sql_overlap, sql_tokens, table
from .graph_memory import AS_OF, EDGES, GRAPH, GRAPHS, PARAMS, causal_items, edge_tables, event_table, memory_turns, node_tables, stored
from .memory_queries import _ASKED, MERGE, asked, earlier
from .registry import query
from .text_queries import _sql_chunks, _sql_class, _sql_stage
from .vector_queries import sql_embedding

#: A month later, when no node is fresh.
LATER = AS_OF + 30 * 86400


def _causal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns, causal nodes with the columns that a correction sets, and their edges."""
    t = memory_turns(spark, sf_dir)
    nodes = stored(node_tables(t))
    n = nodes["causal"].withColumns({"corrected": F.lit(False), "confidence": F.lit(1.0), "correction_source": F.lit("")})
    return t, n, edge_tables(t, nodes)["causal"]


_CORRECTING = f"cor AS (SELECT DISTINCT event_id FROM tt WHERE {sql_any('lower(question) || lower(answer)', P.corrections)})"
_MARKED = "SELECT c.id, {0} AS corrected, CASE WHEN {0} THEN 0.1 ELSE 1.0 END::DOUBLE AS confidence, round(CASE WHEN {0} THEN 0.1 * n.weight ELSE n.weight END, 6)::DOUBLE AS weight FROM causal c JOIN nodes n USING (id)"


def _marked(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "corrected", "confidence", F.round("weight", 6).alias("weight"))


@query(f"{GRAPH}, {_CORRECTING} {_MARKED.format('c.event_id IN (SELECT event_id FROM cor)')}")
def causal_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a turn corrects something, all causal nodes of its event are replaced."""
    t, n, e = _causal(spark, sf_dir)
    found = t.where(X.is_correction(F.col("question"), F.col("answer"), P)).select("event_id", F.col("id").alias("by"))
    return _marked(resolve.replaced(n, e, found)[0])


@query(f"{GRAPH}, {EDGES}, {_CORRECTING} SELECT event_id, source, target FROM causal_edges WHERE event_id NOT IN (SELECT event_id FROM cor)")
def causal_replacement_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n, e = _causal(spark, sf_dir)
    found = t.where(X.is_correction(F.col("question"), F.col("answer"), P)).select("event_id", F.col("id").alias("by"))
    return resolve.replaced(n, e, found)[1].select("event_id", "source", "target")


@query(f"{GRAPH}, ins AS (SELECT DISTINCT event_id, unnest([cause, effect]) AS side FROM items WHERE spot = 0), hit AS (SELECT DISTINCT c.id FROM causal c JOIN ins i ON i.event_id = c.event_id WHERE side <> '' AND (contains(c.body, side) OR contains(side, c.body))) {_MARKED.format('c.id IN (SELECT id FROM hit)')}")
def causal_marks_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer names the causes and effects of first turns: the nodes that hold them are corrected."""
    t, n, e = _causal(spark, sf_dir)
    parts = t.select("memory_id", "event_id", "id", "ord", "ts", extract.chunks(F.col("text"), P).alias("parts"))
    return _marked(resolve.mark_by_text(n, e, causal_items(parts).where("at = 0"))[0])


@query(f"{GRAPH}, pl AS (SELECT id, row_number() OVER (PARTITION BY event_id ORDER BY last_seen, id) AS place FROM causal) {_MARKED.format('c.id IN (SELECT id FROM pl WHERE place = 2)')}")
def causal_marks_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer names the second node of each event."""
    t, n, e = _causal(spark, sf_dir)
    places = t.select("event_id", F.lit(2).alias("place")).distinct()
    return _marked(resolve.mark_by_place(n, e, places)[0])


@query(f"{GRAPH}, {_CORRECTING} SELECT id, event_id FROM causal WHERE event_id NOT IN (SELECT event_id FROM cor)")
def living_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n, e = _causal(spark, sf_dir)
    found = t.where(X.is_correction(F.col("question"), F.col("answer"), P)).select("event_id", F.col("id").alias("by"))
    return resolve.living(resolve.replaced(n, e, found)[0]).select("id", "event_id")


# --- reviews before nodes are inserted ---


@query(f"{GRAPH}, st AS (SELECT event_id, ord, {_sql_stage('h')} AS stage FROM (SELECT *, array_to_string(a[1:5], ' ') AS h FROM tt)), old AS (SELECT DISTINCT event_id, lower(stage) AS stage FROM st WHERE ord = 0) SELECT DISTINCT event_id, stage FROM st s WHERE ord > 0 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.event_id = s.event_id AND o.stage = lower(s.stage))")
def new_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of later turns that their event's first turn didn't have."""
    t = memory_turns(spark, sf_dir)
    s = t.select("event_id", "ord", extract.stage(extract.chunks(F.col("text"), P), P).alias("stage"))
    return resolve.new_names(s.where("ord > 0"), s.where("ord = 0"), ["event_id"], "stage").select("event_id", "stage").distinct()


@query(
    f"""{GRAPH}, s0 AS (SELECT event_id, id, ord, {_sql_stage('h')} AS stage, local FROM (SELECT *, array_to_string(a[1:5], ' ') AS h FROM tt)), s1 AS (SELECT *, {sql_tokens('local')} AS k, {sql_tokens("stage || ' ' || local")} AS nk FROM s0),
va AS ({sql_embedding('s1', 'id', 'k')}), vb AS ({sql_embedding('s1', 'id', 'nk')}), pr AS (SELECT a.id, b.id AS node, b.ord FROM s1 a JOIN s1 b ON a.event_id = b.event_id AND a.stage = b.stage AND b.ord < a.ord),
c AS (SELECT pr.id, pr.node, sum(x.w * y.w) AS cos FROM pr JOIN va x ON x.id = pr.id JOIN vb y ON y.id = pr.node AND x.idx = y.idx GROUP BY ALL),
r AS (SELECT pr.id, pr.node, round(coalesce(cos, 0), 9) AS score, row_number() OVER (PARTITION BY pr.id ORDER BY round(coalesce(cos, 0), 9) DESC, pr.ord) AS n FROM pr LEFT JOIN c USING (id, node))
SELECT id, CASE WHEN score >= 0.75 THEN node END AS node, round(score, 6) AS score FROM r WHERE n = 1"""
)
def stage_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's stage against the earlier ones of the same name in its event."""
    t = memory_turns(spark, sf_dir)
    local = X.local_summary(F.col("question"), F.col("answer"), F.lit(""))
    s = t.select("event_id", extract.stage(extract.chunks(F.col("text"), P), P).alias("stage"), "id", "ord", local.alias("local"))
    new = s.select("event_id", "stage", "id", "ord", X.tokens(F.col("local")).alias("k"))
    nodes = s.select("event_id", "stage", "id", "ord", X.tokens(F.concat_ws(" ", "stage", "local")).alias("k"))
    return resolve.stage_match(new, nodes, PARAMS.temporal_merge).withColumn("score", F.round("score", 6))


# --- compression ---


def _aged(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Nodes with their weights a month later, and tokens, and the edges."""
    t = memory_turns(spark, sf_dir)
    nodes = stored(node_tables(t, LATER))
    return {g: n.withColumn("k", X.tokens(F.col("text"))) for g, n in nodes.items()}, edge_tables(t, nodes)


@query()
def compressed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the three graphs after a compression a month later."""
    nodes, links = _aged(spark, sf_dir)
    out, _, _ = maintain.compress(nodes, links, PARAMS, P, MERGE)
    return retrieve.union_nodes({g: n.select("event_id", "id", "ord", "body", "frequency", "first_seen", "last_seen") for g, n in out.items()}).drop("ord", "graph_ord")


@query()
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What that compression did: merged entities and stages, and pruned causes."""
    nodes, links = _aged(spark, sf_dir)
    return maintain.compress(nodes, links, PARAMS, P, MERGE)[2]


_LATE = f"CASE WHEN pinned THEN 1.0 ELSE greatest(0.0, least(1.0, 0.35 * exp(-ln(2::DOUBLE) * ({LATER} - last_seen) / 21600.0::DOUBLE) + 0.25 * importance)) END"


@query(f"{GRAPH}, {EDGES}, gone AS (SELECT id FROM causal WHERE NOT pinned AND round({_LATE}, 4) < 0.16 AND importance < 0.70) SELECT id AS source, '' AS target FROM causal WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT source, target FROM causal_edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)")
def compressed_causal_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The causes that stay, and the edges that pruned ones didn't take along."""
    nodes, links = _aged(spark, sf_dir)
    out, left, _ = maintain.compress(nodes, links, PARAMS, P, MERGE)
    return out["causal"].select(F.col("id").alias("source"), F.lit("").alias("target")).unionByName(left["causal"].select("source", "target"))


# --- rebuilds and deletions ---


def _rebuilt(t: DataFrame, before: DataFrame, touched: DataFrame) -> DataFrame:
    """(event_id, title, summary, turns, entity, temporal, causal, reconstructed) of the touched events, made anew from turns t; before: their titles and summaries until now."""
    t = t.join(touched.select("event_id").distinct(), "event_id", "left_semi")
    out = t.groupBy("event_id").agg(F.count("*").alias("turns")).join(events.titles(t, "event_id", P, before), "event_id")
    for g, n in node_tables(t).items():
        out = out.join(n.groupBy("event_id").agg(F.count("*").alias(g)), "event_id", "left")
    return out.na.fill(0, list(GRAPHS)).withColumn("reconstructed", F.lit(1))


def _sql_rebuilt(where: str, touched: str) -> str:
    """The nodes of events made anew from the turns where, in SQL: counts by graph."""
    kept = GRAPH.replace("WHERE valid),\nfa AS", f"WHERE valid AND {where}),\nfa AS", 1)
    return f"{kept}, n AS (SELECT event_id, count(*) FILTER (graph = 0) AS entity, count(*) FILTER (graph = 1) AS temporal, count(*) FILTER (graph = 2) AS causal FROM nodes GROUP BY ALL) SELECT tt.event_id, count(*) AS turns, coalesce(any_value(entity), 0) AS entity, coalesce(any_value(temporal), 0) AS temporal, coalesce(any_value(causal), 0) AS causal, 1 AS reconstructed FROM tt LEFT JOIN n USING (event_id) WHERE {touched} GROUP BY tt.event_id"


@query(_sql_rebuilt("ord % 4 <> 0", "tt.event_id IN (SELECT memory_id FROM turns WHERE valid AND ord % 4 = 0)"))
def rebuilt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that lost a turn, made anew from those that stay; one without a turn left is gone."""
    t = memory_turns(spark, sf_dir)
    stay, touched = maintain.delete_turns(t, t.where("ord % 4 = 0"))
    before = event_table(t, node_tables(t)).select("event_id", "title", "summary")
    return _rebuilt(stay, before, touched.where("action = 'rebuild'")).drop("title", "summary")


@query(f"{GRAPH}, {EDGES}, gone AS (SELECT event_id FROM tt GROUP BY event_id HAVING count(*) = 1) SELECT id, CASE WHEN event_id IN (SELECT event_id FROM gone) THEN 'buffered' ELSE 'assigned' END AS state, 'turn' AS part FROM tt UNION ALL SELECT id, '', 'node' FROM nodes WHERE event_id NOT IN (SELECT event_id FROM gone) UNION ALL SELECT source || '>' || target, graph, 'edge' FROM all_edges WHERE event_id NOT IN (SELECT event_id FROM gone)")
def delete_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one turn are deleted: their turns wait again, their nodes and edges go."""
    t = memory_turns(spark, sf_dir)
    nodes = stored(node_tables(t))
    links = edge_tables(t, nodes)
    gone = t.groupBy("event_id").agg(F.count("*").alias("n")).where("n = 1")
    tables = [*nodes.values(), *[e.withColumn("graph", F.lit(g)) for g, e in links.items()]]
    turns, left = maintain.delete_events(t.withColumn("status", F.lit("assigned")), tables, gone)
    out = turns.select("id", F.col("status").alias("state"), F.lit("turn").alias("part"))
    for n in left[:3]:
        out = out.unionByName(n.select("id", F.lit("").alias("state"), F.lit("node").alias("part")))
    for e in left[3:]:
        out = out.unionByName(e.select(F.concat_ws(">", "source", "target").alias("id"), F.col("graph").alias("state"), F.lit("edge").alias("part")))
    return out


_ALIKE = f"""e2 AS (SELECT event_id, kind, id, ord, {sql_tokens('text')} AS k FROM entity), v AS ({sql_embedding('e2', 'id', 'k')}), p AS (SELECT a.event_id, a.id AS a, b.id AS b, list_distinct(a.k) AS ta, list_distinct(b.k) AS tb FROM e2 a JOIN e2 b ON a.event_id = b.event_id AND a.kind = b.kind AND a.ord > b.ord),
cs AS (SELECT p.a, p.b, sum(x.w * y.w) AS cos FROM p JOIN v x ON x.id = p.a JOIN v y ON y.id = p.b AND x.idx = y.idx GROUP BY ALL), d AS (SELECT p.event_id, count(*) AS pairs FROM p LEFT JOIN cs USING (a, b) WHERE round(0.70 * greatest(coalesce(cos, 0), 0) + 0.30 * {sql_overlap('ta', 'tb')}, 9) >= {MERGE} GROUP BY ALL),
m AS (SELECT event_id, count(*) AS node_count, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE coalesce(any_value(pairs), 0) / count(*)::DOUBLE END, 4) AS duplicate_ratio FROM entity LEFT JOIN d USING (event_id) GROUP BY event_id)"""


def _metrics(nodes: DataFrame) -> DataFrame:
    n = nodes.withColumn("k", X.tokens(F.col("text")))
    return resolve.duplicate_ratio(resolve.duplicates(n, ["event_id", "kind"], MERGE), n, "event_id")


@query(f"{GRAPH}, {_ALIKE} SELECT event_id, CASE WHEN node_count >= 28 THEN 'size' WHEN node_count >= 10 AND duplicate_ratio >= 0.24 THEN 'duplicates' END AS reason FROM m WHERE node_count >= 28 OR node_count >= 10 AND duplicate_ratio >= 0.24")
def rebuild_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with many entity nodes, or many alike."""
    metrics = _metrics(node_tables(memory_turns(spark, sf_dir))["entity"])
    return maintain.rebuild_trigger(metrics.withColumns({"n_scores": F.lit(0), "mean_score": F.lit(1.0)}))


@query(
    f"""{GRAPH}, {EDGES}, {_ALIKE}, k AS (SELECT event_id, count(DISTINCT list_sort([source, target])) AS k FROM entity_edges GROUP BY ALL), t AS (SELECT event_id, max(ts) AS updated_at FROM tt GROUP BY ALL)
SELECT m.event_id, node_count, duplicate_ratio::DOUBLE AS duplicate_ratio, round(CASE WHEN node_count < 2 THEN 0.0 ELSE least(1.0, coalesce(k, 0) / (node_count * (node_count - 1) / 2::DOUBLE)) END, 6)::DOUBLE AS edge_density, round(exp(-ln(2::DOUBLE) * ({AS_OF} - updated_at) / 21600.0::DOUBLE), 4)::DOUBLE AS survival FROM m JOIN t USING (event_id) LEFT JOIN k USING (event_id)"""
)
def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's counts, the share of nodes alike, how densely they are linked, and how fresh it is."""
    t = memory_turns(spark, sf_dir)
    nodes = stored(node_tables(t))
    dense = edges.density(edge_tables(t, nodes)["entity"], nodes["entity"], "event_id")
    fresh = t.groupBy("event_id").agg(F.round(V.decay(F.lit(AS_OF) - F.max("ts"), PARAMS.half_life), 4).alias("survival"))
    out = _metrics(nodes["entity"]).join(dense, "event_id").join(fresh, "event_id")
    return out.select("event_id", "node_count", "duplicate_ratio", F.round("density", 6).alias("edge_density"), "survival")


# --- the one-graph form ---

CLASSES = [k for k, _ in P.legacy_classes] + [P.legacy_other_class]
_LEGACY_ORDER = "CASE kind " + " ".join(f"WHEN {quote(k)} THEN {i}" for i, k in enumerate(CLASSES)) + f" ELSE {len(CLASSES)} END"
_LEGACY = f"""WITH d AS (SELECT conv_id, turn, {_sql_chunks('text')} AS a FROM conversations), c AS (SELECT conv_id, turn, unnest(range(len(a[1:18]))) AS pos, unnest(a[1:18]) AS whole FROM d), k AS (SELECT conv_id, turn, {_sql_class('whole', P.legacy_classes, P.legacy_other_class)} AS kind, whole[1:48] AS name, min(pos) AS pos FROM c GROUP BY ALL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, kind ORDER BY pos) AS n FROM k) WHERE n <= 8),
p AS (SELECT *, {_LEGACY_ORDER} AS o, min_by(name, pos) FILTER (kind = 'location') OVER w AS place, min_by(name, pos) FILTER (kind = 'hazard') OVER w AS hazard, min_by(name, pos) FILTER (kind = 'incident') OVER w AS incident FROM f WINDOW w AS (PARTITION BY conv_id, turn)),
r0 AS (SELECT conv_id, turn, o, pos, name AS source_text, place AS target_text, 'LOCATED_IN' AS relation_label FROM p WHERE kind <> 'location' AND place IS NOT NULL UNION ALL SELECT DISTINCT conv_id, turn, {len(CLASSES) + 1}, 0, hazard, incident, 'RELATES_TO' FROM p WHERE hazard IS NOT NULL AND incident IS NOT NULL),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY o, pos) AS rank FROM r0) WHERE rank <= 10)"""


def _legacy_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.legacy_facts(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", P)


@query(_LEGACY + " SELECT conv_id, turn, kind, pos, name FROM f")
def legacy_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legacy_facts(spark, sf_dir)


@query(_LEGACY + " SELECT conv_id, turn, rank, source_text, target_text, relation_label FROM r")
def legacy_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.legacy_relations(_legacy_facts(spark, sf_dir), ["conv_id", "turn"], CLASSES)


@query(_LEGACY + f", nd AS (SELECT conv_id AS event_id, kind, name, min(turn * 100 + pos) AS ord FROM f GROUP BY ALL), fn AS (SELECT event_id, name, arg_min(event_id || ':' || kind || ':' || ord, ({_LEGACY_ORDER}, ord)) AS id FROM nd GROUP BY ALL) SELECT r.conv_id AS event_id, a.id AS source, b.id AS target, relation_label, least(8.0, round(1.3 * count(*), 6))::DOUBLE AS weight, count(*) AS frequency FROM r JOIN fn a ON a.event_id = r.conv_id AND a.name = source_text JOIN fn b ON b.event_id = r.conv_id AND b.name = target_text WHERE a.id <> b.id GROUP BY ALL")
def legacy_relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations at the first node of each text, class after class, 1.3 for each time they were found."""
    f = _legacy_facts(spark, sf_dir)
    n = f.groupBy(F.col("conv_id").alias("event_id"), "kind", "name").agg(F.min(F.col("turn") * 100 + F.col("pos")).alias("ord")).withColumn("id", F.concat_ws(":", "event_id", "kind", "ord"))
    r = extract.legacy_relations(f, ["conv_id", "turn"], CLASSES).withColumnRenamed("conv_id", "event_id")
    e = resolve.legacy_relation_edges(r, n, "event_id", CLASSES).withColumn("at", F.lit(0))
    e = edges.accumulate(e, ["event_id", "source", "target", "relation_label"], 1.3, "at", "at")
    return e.select("event_id", "source", "target", "relation_label", F.round("weight", 6).alias("weight"), "frequency")


@query()
def legacy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all classes at their nodes, an event's nodes by class, importance, frequency and text."""
    f = _legacy_facts(spark, sf_dir).select(F.col("conv_id").cast("string").alias("event_id"), "kind", F.concat_ws(":", "conv_id", "turn", "kind", "pos").alias("fact_id"), (F.col("turn") * 100 + F.col("pos")).alias("ord"), "name", "turn")
    at = folds.resolve_nodes(f, PARAMS.entity_merge)
    more = f.select("fact_id", "turn", X.legacy_importance(F.col("name"), F.col("kind"), F.lit(0.0), P).alias("importance"), (F.col("turn") * 600.0).alias("ts"), X.none().alias("images"), F.lit("").alias("visual"))
    n = resolve.fine_nodes(at.join(more, "fact_id"), P.join)
    return n.sortWithinPartitions("event_id", "kind", F.desc("importance"), F.desc("frequency"), "name")


@query(
    _ASKED
    + f""", fi AS (SELECT p.memory_id AS event_id, p.query_id, p.node_id, p.ord, coalesce(cos, 0) AS cos, CASE WHEN crit THEN 0.7 ELSE 0.5 END AS importance FROM pairs p LEFT JOIN cs USING (query_id, node_id)), su AS (SELECT *, least(1.0, exp(-ln(2::DOUBLE) * ord * 600 / {PARAMS.half_life}::DOUBLE) + 0.18 * importance) AS survival FROM fi),
sf AS (SELECT *, round(0.52 * greatest(cos, 0) + 0.18 * importance + 0.18 * survival + 0.12 * 0.2, 4) AS fine_score FROM su WHERE NOT (survival < 0.16 AND importance < 0.62))
SELECT * FROM (SELECT query_id, event_id, node_id, fine_score, row_number() OVER (PARTITION BY query_id ORDER BY fine_score DESC, ord, node_id) AS rank FROM sf) WHERE rank <= 8"""
)
def legacy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier turns for each question by the one-graph fine score: eight of a conversation, then eight of all."""
    q, n = asked(spark, sf_dir)
    survival = V.legacy_survival(F.col("ord") * 600, F.col("importance"), F.lit(False), PARAMS.half_life)
    n = n.withColumns({"survival": survival, "pinned": F.lit(False), "frequency": F.lit(1)})
    hits = retrieve.search(q, retrieve.legacy_skip(n)[0], 8, retrieve.legacy_fine_score, earlier, ([], ["importance", "survival", "frequency"]))
    return retrieve.legacy_fine_results(hits.select(F.col("memory_id").alias("event_id"), "query_id", "node_id", "ord", F.col("score").alias("fine_score")))
