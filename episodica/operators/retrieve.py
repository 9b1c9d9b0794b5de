"""Batched retrieval: queries against the nodes of their memory, then events, then context lines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..profile import Profile
from .tiles import Pair, meet


def node_score(p: Pair) -> dict[str, np.ndarray]:
    """Of a query on the left and a node with importance and weight on the right."""
    return {"score": 0.52 * np.maximum(p.cos, 0) + 0.18 * p.overlap + 0.18 * p.b("importance") + 0.12 * p.b("weight")}


def search(queries: DataFrame, nodes: DataFrame, k: int = 8, score=node_score, where=None, numbers: tuple[list[str], list[str]] = ([], ["importance", "weight"]), columns: list[str] = ("score",), rising: bool = False) -> DataFrame:
    """(memory_id, query_id, node_id, ord, rank, columns): the best k nodes of each query's memory; both sides: memory_id, id, ord, k. rising as in meet().

    Each task keeps k a query and tile, so what meets for the last cut is k a query and tile too."""
    met = meet(queries, nodes, ["memory_id"], score, where=where, top=k, numbers=numbers, columns=list(columns), rising=rising)
    met = met.select("memory_id", F.col("a").alias("query_id"), F.col("b").alias("node_id"), F.col("b_ord").alias("ord"), *columns)
    return top(met, "query_id", k, [F.desc("score"), F.col("ord"), F.col("node_id")])


def top(pairs: DataFrame, key: str, k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each key, with rank. Spark cuts each task's rows to k a key before the shuffle."""
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def entries(hits: DataFrame, least: float = 0.16) -> DataFrame:
    """Hits of search() that are entry nodes: over the threshold."""
    return hits.where(F.col("score") > least)


def event_score(p: Pair) -> dict[str, np.ndarray]:
    """Of a query on the left and an event with survival on the right."""
    return {"score": 0.48 * np.maximum(p.cos, 0) + 0.20 * p.overlap + 0.17 * p.coverage + 0.15 * p.b("survival")}


def anchors(hits: DataFrame, events: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, event_id, score): the best of the events that a query's entry nodes lie in. events: event_id, k, t, survival, ord; queries: id, ord, k."""
    # vectors would be shuffled once a pair, so the tokens meet, event by event
    asked = hits.select(F.col("query_id").alias("id"), "event_id").distinct().join(queries.select("id", "ord", "k"), "id").withColumn("t", F.array_distinct("k"))
    met = meet(asked, events.withColumn("id", F.col("event_id")), ["event_id"], event_score, numbers=([], ["survival"]))
    best = met.groupBy(F.col("a").alias("query_id")).agg(F.max_by(F.struct("event_id", "score"), F.struct("score", -F.col("b_ord"))).alias("b"))
    return best.select("query_id", "b.event_id", "b.score")


def relevance(queries: DataFrame, events: DataFrame) -> DataFrame:
    """(query_id, event, ord, survival, semantic, combined) of each query and each event (id, ord, k, t, survival) of its memory."""

    def score(p: Pair) -> dict[str, np.ndarray]:
        return event_score(p) | {"semantic": p.cos, "survival": p.b("survival")}

    met = meet(queries.withColumn("t", F.array_distinct("k")), events, ["memory_id"], score, numbers=([], ["survival"]), columns=["score", "semantic", "survival"])
    return met.select(F.col("a").alias("query_id"), F.col("b").alias("event"), F.col("b_ord").alias("ord"), "survival", "semantic", F.col("score").alias("combined"))


def union_nodes(nodes: dict[str, DataFrame]) -> DataFrame:
    """The nodes of several graphs in one table, with graph, graph_ord (their ord) and ord: graph after graph."""
    out = None
    for place, (name, n) in enumerate(nodes.items()):
        n = n.withColumn("graph", F.lit(name)).withColumn("graph_ord", F.col("ord").cast("long")).withColumn("ord", F.col("graph_ord") + F.lit(place << 50))
        out = n if out is None else out.unionByName(n, allowMissingColumns=True)
    return out


#: What each graph's nodes must score above, by what they come in order, and how many come at most.
LOCAL = {"entity": (0.16, None), "temporal": (0.08, 20), "causal": (0.08, 15)}


def local_results(anchors: DataFrame, queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, graph, rank, node_id, score) of the anchor's nodes: entities by score, stages by start, causes by importance."""
    q = queries.join(anchors.select(F.col("query_id").alias("id"), "event_id"), "id").select("event_id", "id", "ord", "k")
    met = meet(q, nodes, ["event_id"], node_score, least=min(least for least, _ in LOCAL.values()), numbers=([], ["importance", "weight"]))
    # texts stay out, as each node comes once a question
    own = nodes.select(F.col("id").alias("node_id"), "graph", "graph_ord", "importance", "start_time")
    rows = met.select(F.col("a").alias("query_id"), F.col("b").alias("node_id"), "score").join(own, "node_id")
    bound, most = F.lit(1.0), F.lit(0)
    for name, (least, k) in LOCAL.items():
        bound, most = F.when(F.col("graph") == name, least).otherwise(bound), F.when(F.col("graph") == name, k or 1 << 30).otherwise(most)
    by = F.when(F.col("graph") == "entity", -F.round("score", 4)).when(F.col("graph") == "temporal", F.col("start_time")).otherwise(-F.col("importance"))
    w = W.partitionBy("query_id", "graph").orderBy(by, "graph_ord", "node_id")
    return rows.where(F.col("score") > bound).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "graph", "rank", "node_id", "score")


def lines(anchors: DataFrame, found: DataFrame, nodes: DataFrame, profile: Profile, shown: tuple[int, int, int] = (3, 6, 5)) -> DataFrame:
    """(query_id, section, place, line): the anchor (title, summary), then the first of what local_results() found in its three graphs."""
    event, entity, stage, cause = (F.lit(m + " ") for m in profile.line_marks)
    head = anchors.select("query_id", F.lit(0).alias("section"), F.lit(0).alias("place"), F.concat(event, "title", F.lit(": "), "summary").alias("line"))
    graph = F.col("graph")
    line = F.when(graph == "entity", F.concat(entity, "name", F.lit(" ("), "kind", F.lit("): "), "body")).when(graph == "temporal", F.concat(stage, "stage", F.lit(": "), "body")).otherwise(F.concat(cause, F.lit("("), "kind", F.lit("): "), "body"))
    section = F.when(graph == "entity", 1).when(graph == "temporal", 2).otherwise(3)
    most = F.when(graph == "entity", shown[0]).when(graph == "temporal", shown[1]).otherwise(shown[2])
    said = nodes.select(F.col("id").alias("node_id"), "kind", "name", "stage", "body")
    rest = found.where(F.col("rank") <= most).join(said, "node_id").select("query_id", section.alias("section"), F.col("rank").alias("place"), line.alias("line"))
    return head.unionByName(rest)


def context(lines: DataFrame, k: int = 6) -> DataFrame:
    """(query_id, lines): lines (query_id, section, place, line) by section, then place; the first k."""
    cut = top(lines, "query_id", k, [F.col("section"), F.col("place")])
    return cut.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]).alias("lines"))


def rule_answer(lines: Column, prefix: str, nothing: str, join: str) -> Column:
    return F.when(F.size(lines) == 0, nothing).otherwise(F.concat(F.lit(prefix), F.array_join(F.slice(lines, 1, 3), join)))


def reinforce(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """nodes with access raised by how often they were hit."""
    n = hits.groupBy("node_id").agg(F.count("*").alias("__hits"))
    return nodes.join(n, "node_id", "left").withColumn("access", F.col("access") + F.coalesce("__hits", F.lit(0))).drop("__hits")


def reinforce_events(events: DataFrame, anchors: DataFrame, gain: float = 0.05, last: int = 8) -> DataFrame:
    """events (event_id, survival) after queries were anchored there: survival raised for each, 1 at most, and the last queries."""
    w = W.partitionBy("event_id").orderBy(F.desc("query_id"))
    n = anchors.withColumn("__k", F.row_number().over(w)).groupBy("event_id").agg(F.count("*").alias("__hits"), F.reverse(F.array_sort(F.collect_list(F.when(F.col("__k") <= last, F.col("query_id"))))).alias("recent"))
    joined = events.join(n, "event_id", "left")
    return joined.withColumns({"survival": F.least(F.lit(1.0), F.col("survival") + gain * F.coalesce("__hits", F.lit(0))), "recent": F.coalesce("recent", X.none())}).drop("__hits")


def seeds(hits: DataFrame, k: int = 3, least: float = 0.16) -> DataFrame:
    """The top k hits of a query above least; the single best if there is none."""
    return hits.where((F.col("rank") <= k) & ((F.col("score") > least) | (F.col("rank") == 1)))


def legacy_fine_score(p: Pair) -> dict[str, np.ndarray]:
    """Of a query and a node with importance, survival and frequency, in the one-graph form."""
    return {"score": np.round(0.52 * np.maximum(p.cos, 0) + 0.18 * p.b("importance") + 0.18 * p.b("survival") + 0.12 * np.minimum(1, p.b("frequency") / 5), 4)}


def legacy_fine_results(hits: DataFrame, per_topic: int = 8, k: int = 8) -> DataFrame:
    """(query_id, event_id, node_id, fine_score, rank) of nodes met for a query (fine_score, ord): the first 8 of each topic, then the first k of all."""
    inside = W.partitionBy("query_id", "event_id").orderBy(F.desc("fine_score"), "ord", "node_id")
    rows = hits.withColumn("__n", F.row_number().over(inside)).where(F.col("__n") <= per_topic)
    return top(rows, "query_id", k, [F.desc("fine_score"), F.col("ord"), F.col("node_id")]).select("query_id", "event_id", "node_id", "fine_score", "rank")


def legacy_skip(nodes: DataFrame, seeds: bool = True, weak: float = 0.16, important: float = 0.62) -> tuple[DataFrame, DataFrame]:
    """Nodes that take part in the one-graph search, and those passed over (with a reason): faded and unimportant; a pin saves a node that is met directly, not a neighbour."""
    low = (F.col("survival") < weak) & (F.col("importance") < important)
    if seeds:
        low = low & ~F.col("pinned")
    reason = F.lit("faded" if seeds else "faded neighbour")
    return nodes.where(~low), nodes.where(low).withColumn("reason", reason)
