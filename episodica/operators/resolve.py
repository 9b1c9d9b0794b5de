"""Node resolution: scoring facts against nodes, duplicates, conflicts, and the roll-up of merged nodes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .edges import cascade
from .folds import merge_plan
from .tiles import Pair, meet


def merge_score(p: Pair) -> dict[str, np.ndarray]:
    return {"score": 0.70 * np.maximum(p.cos, 0) + 0.30 * p.overlap}


def _earlier(p: Pair) -> np.ndarray:
    return p.right.ord[None] < p.left.ord[:, None]


def best_match(nodes: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """(id, node, score): for each node (block, id, ord, k) that has an earlier one in its block the one of highest score, the first of equals; node is null below the threshold."""
    met = meet(nodes, None, block, merge_score, where=_earlier, top=1)
    best = met.groupBy(F.col("a").alias("id")).agg(F.max_by(F.struct(F.col("b").alias("node"), "score"), F.struct("score", -F.col("b_ord"))).alias("m"))
    return best.select("id", F.when(F.col("m.score") >= threshold, F.col("m.node")).alias("node"), "m.score")


def duplicates(nodes: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """(block, a, b, ...): pairs of nodes alike, each once."""
    return meet(nodes, None, block, merge_score, where=_earlier, least=threshold)


def duplicate_ratio(pairs: DataFrame, nodes: DataFrame, event: str) -> DataFrame:
    """(event, node_count, duplicate_ratio) from the pairs of duplicates()."""
    n = nodes.groupBy(event).agg(F.count("*").alias("node_count"))
    d = pairs.groupBy(event).agg(F.count("*").alias("pairs"))
    ratio = F.when(F.col("node_count") < 2, 0.0).otherwise(F.coalesce("pairs", F.lit(0)) / F.greatest("node_count", F.lit(1)))
    return n.join(d, event, "left").select(event, "node_count", F.round(ratio, 4).alias("duplicate_ratio"))


def corrections(nodes: DataFrame, block: list[str]) -> DataFrame:
    """(id, corrected_by): each node (turn, told, evidence, corrected, keys.turns) that another one corrects, with the first of these.

    The other is said in a turn with a signal of a conflict (told: the last such turn) after the node was first said (turn),
    shares no turn with it, is unlike in direction, and its evidence is 1.3 times as strong; a node that is corrected already
    stays as it is."""

    def where(p: Pair) -> np.ndarray:
        return (p.a("told") > p.b("turn")) & ~p.shared("turns") & (p.b("corrected") == 0) & (p.a("evidence") > 1.3 * p.b("evidence")) & (p.cos < 0.5)

    met = meet(nodes, None, block, merge_score, where=where, numbers=(["turn", "told", "evidence", "corrected"], []), keys=["turns"])
    return met.groupBy(F.col("b").alias("id")).agg(F.min_by("a", "a_ord").alias("corrected_by"))


def resolve_conflicts(nodes: DataFrame, edges: DataFrame, block: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and log rows after corrections(): a corrected node keeps a tenth of its weight and a confidence of 0.1, and loses its edges."""
    found = corrections(nodes, block)
    joined = nodes.join(found, "id", "left")
    hit = F.col("corrected_by").isNotNull()
    out = joined.withColumns({"corrected": F.col("corrected") | hit, "weight": F.when(hit, 0.1 * F.col("weight")).otherwise(F.col("weight")), "confidence": F.when(hit, 0.1).otherwise(F.col("confidence")), "correction_source": F.when(hit, F.col("corrected_by")).otherwise(F.col("correction_source"))})
    log = found.select(F.lit("corrected").alias("event_type"), "id", F.col("corrected_by").alias("by"))
    return out.drop("corrected_by"), cascade(edges, found, "id"), log


def compression_plan(nodes: DataFrame, block: list[str], threshold: float, weak: float = 0.16) -> DataFrame:
    """(id, into): weak, unpinned nodes (weight, pinned) that fold into an earlier one alike. In order, each node that is still there takes the later ones alike that are still there."""

    def where(p: Pair) -> np.ndarray:
        low = (p.a("pinned") == 0) & (p.b("pinned") == 0) & (p.a("weight") < weak) & (p.b("weight") < weak)
        return low & (p.left.ord[:, None] < p.right.ord[None])

    met = meet(nodes, None, block, merge_score, where=where, least=threshold, numbers=(["pinned", "weight"], []))
    walk = met.select(F.concat_ws("|", *block).alias("memory_id"), F.col("a").alias("source"), F.col("b").alias("target"), "a_ord", "b_ord")
    return merge_plan(walk).select(F.col("gone").alias("id"), F.col("kept").alias("into"))


def roll_up(nodes: DataFrame, into: DataFrame) -> DataFrame:
    """nodes after folds: frequency and access summed, times and importance at their extremes, turns distinct in order."""
    joined = nodes.join(into, "id", "left").withColumn("id", F.coalesce("into", "id")).drop("into")
    turns = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "turns"))), lambda s: s["turns"])))
    return joined.groupBy("id").agg(F.sum("frequency").alias("frequency"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("access").alias("access"), F.max("importance").alias("importance"), turns.alias("turns"))


def new_names(facts: DataFrame, nodes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Facts whose lower-cased name no node of the same keys has."""
    known = nodes.select(*keys, F.lower(name).alias("__name")).distinct()
    return facts.withColumn("__name", F.lower(name)).join(known, [*keys, "__name"], "left_anti").drop("__name")


def relation_edges(relations: DataFrame, nodes: DataFrame, event: str, label: str) -> DataFrame:
    """(event, source, target, label): relations (event, source_text, target_text) at the first node of each text, without loops."""
    first = nodes.groupBy(event, "name").agg(F.min_by("id", "ord").alias("id"))
    a = first.select(event, F.col("name").alias("source_text"), F.col("id").alias("source"))
    b = first.select(event, F.col("name").alias("target_text"), F.col("id").alias("target"))
    joined = relations.join(a, [event, "source_text"]).join(b, [event, "target_text"])
    return joined.where("source <> target").select(event, "source", "target", F.coalesce("relation_label", F.lit(label)).alias("relation_label"))


def living(nodes: DataFrame) -> DataFrame:
    """Nodes that aren't corrected."""
    return nodes.where(~F.col("corrected"))


def _mark(nodes: DataFrame, edges: DataFrame, gone: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of gone (id) as corrected: a tenth of the weight, a confidence of 0.1, no edges."""
    joined = nodes.join(gone.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    marked = joined.withColumns({"weight": F.when(hit, 0.1 * F.col("weight")).otherwise(F.col("weight")), "confidence": F.when(hit, 0.1).otherwise(F.col("confidence")), "correction_source": F.when(hit, source).otherwise(F.col("correction_source")), "corrected": F.col("corrected") | hit})
    return marked.drop("__hit"), cascade(edges, gone, "id")


def mark_by_text(nodes: DataFrame, edges: DataFrame, instructions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Causal nodes (event_id, id, body, ...) that contain a cause or effect of their event's instructions (event_id, cause, effect), or are contained in it, as corrected."""
    sides = instructions.select("event_id", F.explode(F.array("cause", "effect")).alias("side")).where("side <> ''").distinct()
    met = living(nodes).select("event_id", "id", "body").join(sides, "event_id")
    return _mark(nodes, edges, met.where(F.contains("body", "side") | F.contains("side", "body")), "reviewer_replacement")


def mark_by_place(nodes: DataFrame, edges: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Causal nodes at places (event_id, place; the first is 1) of their event's living nodes, by last_seen, as corrected."""
    ranked = by_time(living(nodes), "event_id").select("event_id", "id", "place")
    return _mark(nodes, edges, ranked.join(places.distinct(), ["event_id", "place"], "left_semi"), "reviewer_conflict_resolution")


def stage_match(new: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(id, node, score): for each stage item (event_id, stage, id, ord, k: tokens of its summary) the earlier node of the same stage (k: tokens of stage and summary) of highest cosine; node is null below the threshold."""

    def score(p: Pair) -> dict[str, np.ndarray]:
        return {"score": p.cos}

    met = meet(new, nodes, ["event_id", "stage"], score, where=_earlier, top=1)
    best = met.groupBy(F.col("a").alias("id")).agg(F.max_by(F.struct(F.col("b").alias("node"), "score"), F.struct("score", -F.col("b_ord"))).alias("m"))
    return best.select("id", F.when(F.col("m.score") >= threshold, F.col("m.node")).alias("node"), "m.score")


def fine_nodes(resolved: DataFrame, join: str) -> DataFrame:
    """Nodes of one graph of all classes, from facts at their nodes (event_id, node, created, ord, kind, name, turn, ts, importance, images, visual): counted, times and importance at their extremes, turns and images distinct in order, visual descriptions joined and cut to 260; each merge adds 0.08 of survival, 1 at most."""

    def ordered(column: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct("ord", column))), lambda s: s[column])

    own = F.max(F.when(F.col("created"), F.struct("kind", "name")))
    visuals = F.filter(F.array_distinct(ordered("visual")), lambda v: v != "")
    out = resolved.groupBy("event_id", "node").agg(own.alias("o"), F.count("*").alias("frequency"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("importance").alias("importance"), F.array_distinct(ordered("turn")).alias("turns"), F.array_distinct(F.flatten(ordered("images"))).alias("images"), F.substring(F.array_join(visuals, join), 1, 260).alias("visual"))
    return out.select("event_id", F.col("node").alias("id"), "o.kind", "o.name", "frequency", "first_seen", "last_seen", "importance", F.lit(1.0).alias("survival"), "turns", "images", "visual")


#: The labels that edges of the one-graph form may have; others become the first.
LEGACY_LABELS = ("RELATES_TO", "LOCATED_IN", "CAUSED_BY", "TEMPORAL_NEXT", "SUPPORTS", "CONSTRAINS")


def legacy_relation_edges(relations: DataFrame, nodes: DataFrame, event: str, classes: list[str]) -> DataFrame:
    """(event, source, target, relation_label): relations (event, source_text, target_text, relation_label) at the node of each text whose class comes first, without loops."""
    order = F.lit(len(classes))
    for i, k in enumerate(classes):
        order = F.when(F.col("kind") == k, i).otherwise(order)
    first = nodes.groupBy(event, "name").agg(F.min_by("id", F.struct(order, "ord")).alias("id"))
    a = first.select(event, F.col("name").alias("source_text"), F.col("id").alias("source"))
    b = first.select(event, F.col("name").alias("target_text"), F.col("id").alias("target"))
    label = F.when(F.col("relation_label").isin(*LEGACY_LABELS), F.col("relation_label")).otherwise(LEGACY_LABELS[0])
    return relations.join(a, [event, "source_text"]).join(b, [event, "target_text"]).where("source <> target").select(event, "source", "target", label.alias("relation_label"))


def by_time(nodes: DataFrame, group: str) -> DataFrame:
    """nodes with place: 1 for the first seen."""
    return nodes.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy("last_seen", "id")))


def replaced(nodes: DataFrame, edges: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and log rows after the causal nodes of some events (event_id, by) are replaced: all that aren't corrected yet are, keep a tenth of their weight and a confidence of 0.1, and lose their edges."""
    joined = nodes.join(corrections.groupBy("event_id").agg(F.min("by").alias("by")), "event_id", "left")
    hit = F.col("by").isNotNull() & ~F.col("corrected")
    gone = joined.where(hit).select("id", "by")
    out = joined.withColumns({"weight": F.when(hit, 0.1 * F.col("weight")).otherwise(F.col("weight")), "confidence": F.when(hit, 0.1).otherwise(F.col("confidence")), "corrected": F.col("corrected") | hit}).drop("by")
    return out, cascade(edges, gone, "id"), gone.select(F.lit("corrected").alias("event_type"), "id", "by")
