"""Edges: time order, accumulation, co-occurrence, causes, coarse pairs, and cascades."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..profile import Profile
from ..sources.scratch import materialize
from .tiles import Pair, Score, lead, meet, summed

MAX_WEIGHT = 8.0


def edge_id(event: Column, label: Column, source: Column, target: Column, directed: bool = True) -> Column:
    """A directed edge's id; without direction the ends come sorted."""
    ends = F.array(source.cast("string"), target.cast("string"))
    return F.concat_ws("|", event.cast("string"), label, ends if directed else F.array_sort(ends))


def follow(nodes: DataFrame, event: str, node: str, order: list[str]) -> DataFrame:
    """(event, source, target): each node of an event with the next in order."""
    w = W.partitionBy(event).orderBy(*order)
    return nodes.select(event, F.col(node).alias("source"), F.lead(node).over(w).alias("target")).where("target IS NOT NULL")


def accumulate(found: DataFrame, keys: list[str], delta: float, seen: str, evidence: str) -> DataFrame:
    """One row an edge key: weight (at most 8), frequency, last_seen and the distinct evidence, sorted."""
    return found.groupBy(*keys).agg(F.least(F.lit(MAX_WEIGHT), F.count("*") * delta).alias("weight"), F.count("*").alias("frequency"), F.max(seen).alias("last_seen"), F.array_sort(F.collect_set(evidence)).alias("evidence"))


def insert_once(found: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row an edge key, as it was first found in order, with weight 1: later finds change nothing."""
    rest = [c for c in found.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("__f")
    return found.groupBy(*keys).agg(first).select(*keys, *[f"__f.{c}" for c in [*order, *rest]], F.lit(1.0).alias("weight"), F.lit(1).alias("frequency"))


def cooccurrence(nodes: DataFrame, group: list[str], node: str, most: int = 10) -> DataFrame:
    """(group, source, target): unordered pairs of a group's distinct nodes, where it has 2 to 10 of them."""
    distinct = nodes.select(*group, node).distinct()
    small = distinct.groupBy(*group).agg(F.count("*").alias("__n")).where(F.col("__n").between(2, most)).drop("__n")
    left = distinct.join(small, group, "left_semi")
    right = left.select(*group, F.col(node).alias("target"))
    return left.withColumnRenamed(node, "source").join(right, group).where("source < target")


def density(edges: DataFrame, nodes: DataFrame, event: str) -> DataFrame:
    """(event, density): distinct unordered pairs over those possible, 1 at most."""
    pairs = edges.where("source <> target").groupBy(event).agg(F.countDistinct(F.array_sort(F.array("source", "target"))).alias("pairs"))
    n = nodes.groupBy(event).agg(F.count("*").alias("n"))
    possible = F.col("n") * (F.col("n") - 1) / 2
    return n.join(pairs, event, "left").select(event, F.when(F.col("n") < 2, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce("pairs", F.lit(0)) / possible)).alias("density"))


def _coarse_score(half_life: float) -> Score:
    def score(p: Pair) -> dict[str, np.ndarray]:
        gap = np.abs(p.a("updated_at") - p.b("updated_at"))
        return {"score": 0.62 * np.maximum(p.cos, 0) + 0.22 * p.overlap + 0.16 * np.exp(-gap / half_life)}

    return score


def _compared(events: DataFrame, *more: str) -> DataFrame:
    """What a comparison of events (memory_id, id, ord, k, t) needs of them, written, as it is read for counts, too."""
    if "t" not in events.columns:
        events = events.withColumn("t", F.array_distinct("k"))
    return materialize(summed(events.select("memory_id", "id", "ord", "k", "t", *more)))


def coarse(events: DataFrame, half_life: float, profile: Profile, least: float = 0.24) -> DataFrame:
    """(memory_id, source, target, score, shared_terms) of events (memory_id, id, ord, k, t, updated_at) whose score is at least 0.24."""
    found = meet(_compared(events, "updated_at"), None, ["memory_id"], _coarse_score(half_life), least=least, numbers=(["updated_at"], []), stop=profile.stop, once=True)
    return found.select("memory_id", F.col("a").alias("source"), F.col("b").alias("target"), "score", "shared_terms")


def coarse_scores(events: DataFrame, half_life: float, least: float = 0.24) -> DataFrame:
    """coarse() without shared terms."""
    found = meet(_compared(events, "updated_at"), None, ["memory_id"], _coarse_score(half_life), least=least, numbers=(["updated_at"], []), once=True)
    return found.select("memory_id", F.col("a").alias("source"), F.col("b").alias("target"), "score")


def count_coarse(events: DataFrame, half_life: float, least: float = 0.24) -> DataFrame:
    """(memory_id, n): how many pairs coarse() has; no pair becomes a row."""
    met = meet(_compared(events, "updated_at"), None, ["memory_id"], _coarse_score(half_life), least=least, numbers=(["updated_at"], []), once=True, count=True)
    return met.groupBy("memory_id").agg(F.sum("n").alias("n"))


def _apart(p: Pair) -> np.ndarray:
    return p.left.ord[:, None] != p.right.ord[None]


def _coarse_from(sources: DataFrame, rows: DataFrame, half_life: float, least: float) -> DataFrame:
    """(source, target, score): the coarse pairs of some events (event); rows: _compared() of all."""
    left = rows.join(sources.select(F.col("event").alias("id")).distinct(), "id", "left_semi")
    found = meet(left, rows, ["memory_id"], _coarse_score(half_life), where=_apart, least=least, numbers=(["updated_at"], ["updated_at"]))
    return found.select(F.col("a").alias("source"), F.col("b").alias("target"), "score")


def _alike(gate: bool) -> Score:
    def score(p: Pair) -> dict[str, np.ndarray]:
        s = 0.76 * np.maximum(p.cos, 0) + 0.24 * p.overlap
        return {"score": np.where(p.key_match < 0.3, 0.1 * s, s) if gate else s}

    return score


def similar(events: DataFrame, profile: Profile, least: float = 0.56, gate: bool = True) -> DataFrame:
    """(memory_id, source, target, a_ord, b_ord, score): events (memory_id, id, ord, k, t, keys) alike enough to be merged; a tenth where key entities differ."""
    found = meet(_compared(events, *(["keys"] if gate else [])), None, ["memory_id"], _alike(gate), least=least, keys=list(profile.key_patterns) if gate else [], once=True)
    return found.select("memory_id", F.col("a").alias("source"), F.col("b").alias("target"), "a_ord", "b_ord", "score")


def merges(events: DataFrame, profile: Profile, least: float = 0.56) -> DataFrame:
    """(memory_id, kept, gone): what folds.merge_plan() makes of the pairs of similar(): an event goes to the first one alike before it that stays. The pairs are not listed."""
    return lead(_compared(events, "keys"), ["memory_id"], _alike(True), least, list(profile.key_patterns))


def causal(items: DataFrame, nodes: DataFrame, event: str) -> DataFrame:
    """(event, item, source, target): for each causal item the last node that contains its cause, or is contained in it, and the same for its effect."""
    said = items.where("cause <> '' AND effect <> ''").select(event, "item", "cause", "effect").distinct()

    def last(side: str) -> DataFrame:
        # equal causes of an event are compared with its nodes once
        met = said.select(event, side).distinct().join(nodes.where("text <> ''"), event)
        met = met.where(F.contains(F.col("text"), F.col(side)) | F.contains(F.col(side), F.col("text")))
        return met.groupBy(event, side).agg(F.max_by("node_id", "ord").alias("source" if side == "cause" else "target"))

    out = said.join(last("cause"), [event, "cause"]).join(last("effect"), [event, "effect"])
    return out.where("source <> target").select(event, "item", "source", "target")


def cascade(edges: DataFrame, gone: DataFrame, node: str) -> DataFrame:
    """edges without those that have an end in gone (column node)."""
    dead = gone.select(F.col(node).alias("__dead")).distinct()
    return edges.join(dead, edges["source"] == dead["__dead"], "left_anti").join(dead, edges["target"] == dead["__dead"], "left_anti")


def both_ways(edges: DataFrame) -> DataFrame:
    swapped = {"source": F.col("target").alias("source"), "target": F.col("source").alias("target")}
    return edges.unionByName(edges.select(*[swapped.get(c, F.col(c)) for c in edges.columns]))


def without_edges(events: DataFrame, edges: list[DataFrame], event: str) -> DataFrame:
    """Events that no graph has an edge of."""
    some = reduce(DataFrame.unionByName, [e.select(event) for e in edges]).distinct()
    return events.join(some, event, "left_anti")


def expand(seeds: DataFrame, edges: DataFrame, least: float = 0.75) -> DataFrame:
    """(query_id, node): neighbours one hop from the seeds (query_id, node) over edges of weight 0.75 and more, either way, without the seeds."""
    reach = both_ways(edges.where(F.col("weight") >= least).select("source", "target"))
    near = seeds.join(reach, seeds["node"] == reach["source"]).select("query_id", F.col("target").alias("node")).distinct()
    return near.join(seeds, ["query_id", "node"], "left_anti")


def _walk(starts: DataFrame, edges: DataFrame, relevance: DataFrame, depth: int, prune: float, drift: float, survival: float, combined: float) -> tuple[list[DataFrame], DataFrame]:
    """The events of each hop (query_id, event, depth, path_score), and all events with what may end a path there (query_id, event, drifted, faded, unlike)."""
    step = both_ways(edges.where(F.col("score") >= prune).select("source", "target", "score"))
    anchor = relevance.join(starts.select("query_id", "event"), ["query_id", "event"]).select("query_id", F.col("semantic").alias("__anchor"))
    ends = relevance.join(anchor, "query_id").select("query_id", "event", (F.col("__anchor") - F.col("semantic") > drift).alias("drifted"), (F.col("survival") < survival).alias("faded"), (F.col("combined") < combined).alias("unlike"))
    fit = ends.where("NOT (drifted OR faded OR unlike)").select("query_id", F.col("event").alias("target"))
    here = starts.select("query_id", "event", F.lit(0).alias("depth"), F.lit(1.0).alias("path_score"))
    hops = [here]
    for d in range(1, depth + 1):
        here = here.join(step, here["event"] == step["source"]).join(fit, ["query_id", "target"])
        here = here.select("query_id", F.col("target").alias("event"), F.lit(d).alias("depth"), (F.col("path_score") * F.col("score")).alias("path_score"))
        here = here.groupBy("query_id", "event", "depth").agg(F.max("path_score").alias("path_score"))
        hops.append(here)
    return hops, ends


def _ranked(hops: list[DataFrame]) -> DataFrame:
    best = W.partitionBy("query_id", "event").orderBy("depth", F.desc("path_score"))
    found = reduce(DataFrame.unionByName, hops).withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    rank = W.partitionBy("query_id").orderBy("depth", F.desc(F.round("path_score", 9)), "event")
    return found.withColumn("rank", F.row_number().over(rank))


def bounded_paths(starts: DataFrame, edges: DataFrame, relevance: DataFrame, depth: int = 2, prune: float = 0.26, drift: float = 0.25, survival: float = 0.16, combined: float = 0.10, most: int = 6) -> DataFrame:
    """(query_id, event, depth, path_score, rank): events within two hops over coarse edges, fewest hops first, then the greatest product of scores; 6 at most.

    starts: query_id, event; relevance: query_id, event, semantic, combined, survival. A path ends before an edge below 0.26,
    and before an event that is over 0.25 less like the question than the start, has survived to less than 0.16, or
    scores below 0.10 for the question."""
    hops, _ = _walk(starts, edges, relevance, depth, prune, drift, survival, combined)
    return _ranked(hops).where(F.col("rank") <= most)


def reached_links(starts: DataFrame, events: DataFrame, relevance: DataFrame, half_life: float, prune: float = 0.26, drift: float = 0.25, survival: float = 0.16, combined: float = 0.10, most: int = 6) -> DataFrame:
    """(source, target, score): the coarse edges that bounded_paths() with two hops can need of events: those of the starts, and where a first hop finds fewer than most events with the start, those of what it finds.

    Fewest hops come first, so a second hop changes nothing elsewhere."""
    rows = _compared(events, "updated_at")
    first = materialize(_coarse_from(starts, rows, half_life, prune))
    hops, _ = _walk(starts, first, relevance, 1, prune, drift, survival, combined)
    near = hops[1].select("query_id", "event")
    few = near.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") < most - 1).select("query_id")
    return first.unionByName(_coarse_from(near.join(few, "query_id"), rows, half_life, prune))


def path_trace(starts: DataFrame, edges: DataFrame, relevance: DataFrame, depth: int = 2, seen: float = 0.22, prune: float = 0.26, drift: float = 0.25, survival: float = 0.16, combined: float = 0.10, most: int = 6) -> DataFrame:
    """(query_id, event, depth, status, reason, score): what bounded_paths() visited, with the score of the path, and what it passed over, with the score of the edge and why.

    An edge from 0.22 on is looked at. An event that no path enters is passed over for the first that holds of: edge (below
    0.26), drift, survival, score; where several edges lead to it, the one of fewest hops and then of greatest score
    counts. One that a path enters beyond the sixth place is passed over for limit, with the path's score."""
    hops, ends = _walk(starts, edges, relevance, depth, prune, drift, survival, combined)
    ranked = _ranked(hops)
    out = F.col("rank") > most
    visited = ranked.select("query_id", "event", "depth", F.when(out, "pruned").otherwise("visited").alias("status"), F.when(out, "limit").otherwise("").alias("reason"), F.col("path_score").alias("score"))
    near = both_ways(edges.where(F.col("score") >= seen).select("source", "target", "score"))
    before = reduce(DataFrame.unionByName, hops[:-1])
    met = before.join(near, before["event"] == near["source"]).select("query_id", F.col("target").alias("event"), (F.col("depth") + 1).alias("depth"), "score")
    met = met.join(ranked.select("query_id", "event"), ["query_id", "event"], "left_anti").join(ends, ["query_id", "event"])
    reason = F.when(F.col("score") < prune, "edge").when(F.col("drifted"), "drift").when(F.col("faded"), "survival").when(F.col("unlike"), "score")
    first = met.groupBy("query_id", "event").agg(F.min_by(F.struct("depth", reason.alias("reason"), "score"), F.struct("depth", -F.col("score"))).alias("m"))
    return visited.unionByName(first.select("query_id", "event", "m.depth", F.lit("pruned").alias("status"), "m.reason", "m.score"))
