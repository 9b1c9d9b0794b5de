"""Upkeep of the graph: refresh, compression, rebuilds, splits, merges and deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vector as V
from ..profile import Params, Profile
from .edges import cascade
from .events import rekey, titles
from .folds import fuse_chain
from .resolve import compression_plan
from .tiles import cosines


def refresh(nodes: DataFrame, p: Params) -> DataFrame:
    """nodes with active_weight as of the age column: a projection, no shuffle."""
    return nodes.withColumn("active_weight", F.round(V.active_weight(F.col("age"), F.col("access"), F.col("importance"), F.col("change"), F.col("pinned"), p), 4))


def rebuild_trigger(metrics: DataFrame) -> DataFrame:
    """(event_id, reason): events (node_count, duplicate_ratio, n_scores, mean_score) that need a rebuild."""
    reason = F.when(F.col("node_count") >= 28, "size").when((F.col("node_count") >= 10) & (F.col("duplicate_ratio") >= 0.24), "duplicates").when((F.col("n_scores") >= 5) & (F.col("mean_score") <= 0.24), "drift")
    return metrics.withColumn("reason", reason).where("reason IS NOT NULL").select("event_id", "reason")


def drift(turns: DataFrame, events: DataFrame, last: int = 10, least: float = 0.20) -> DataFrame:
    """(event_id, id, drifts): an event's turns (event_id, id, ord, k; t if its token set is of another text); of its last ten, those unlike it (events: event_id, k; t of its summary) drift."""
    own = F.col("t") if "t" in turns.columns else F.array_distinct("k")
    w = W.partitionBy("event_id").orderBy(F.desc("ord"))
    recent = turns.withColumn("__k", F.row_number().over(w)).join(events.select("event_id", F.col("k").alias("e_k"), F.col("t").alias("e_t")), "event_id")
    scored = cosines(recent, "k", "e_k")
    score = 0.70 * F.greatest(F.col("cos"), F.lit(0.0)) + 0.30 * X.overlap(own, F.col("e_t"))
    return scored.select("event_id", "id", ((F.col("__k") <= last) & (score < least)).alias("drifts"))


def split_plan(drifting: DataFrame) -> DataFrame:
    """(event_id, id, new_event): where three or more, but not all, of an event's turns drift, these get an event of their own; events under three turns stay."""
    n = drifting.groupBy("event_id").agg(F.count("*").alias("n"), F.count_if("drifts").alias("d"), F.min(F.when(F.col("drifts"), F.col("id"))).alias("first"))
    splits = n.where("n >= 3 AND d >= 3 AND d < n").select("event_id", F.concat(F.col("event_id"), F.lit("+"), F.col("first")).alias("__new"))
    joined = drifting.join(splits, "event_id", "left")
    return joined.select("event_id", "id", F.when(F.col("drifts") & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col("event_id")).alias("new_event"))


def rebuild(turns: DataFrame, moves: DataFrame, previous: DataFrame, profile: Profile) -> DataFrame:
    """turns (id, at, text, ...) of the events that moves (event_id, id, new_event) lists, at their events as they will be, with the title and summary that these begin with: previous' (event_id, title, summary) and the texts; a new event's from its texts alone."""
    moved = moves.select("id", F.col("event_id").alias("old"), F.col("new_event").alias("event_id"))
    t = turns.drop("event_id").join(moved, "id").withColumn("ord", F.col("at"))
    fresh = titles(t.where("event_id <> old"), "event_id", profile)
    before = previous.join(moves.select("event_id").distinct(), "event_id", "left_semi").select("event_id", "title", "summary").unionByName(fresh)
    return t.drop("ord", "old").join(titles(t, "event_id", profile, before), "event_id")


def merge(plan: DataFrame, events: DataFrame, turns: DataFrame, nodes: DataFrame, edges: DataFrame, join: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Events, turns, nodes and edges after events were merged (plan: kept, gone).

    The kept event (event_id, ord, title, summary) takes the gone ones' turns and nodes, which keep their ids, and its summary is
    fused with theirs in order; the gone events' edges go with them."""
    moves = plan.select(F.col("gone").alias("old"), "kept")
    told = events.join(moves, events["event_id"] == moves["old"]).select(F.col("kept").alias("event_id"), "ord", F.col("summary").alias("text"))
    own = events.join(plan.select(F.col("kept").alias("event_id")).distinct(), "event_id", "left_semi").select("event_id", F.lit(-1).cast("long").alias("ord"), F.col("summary").alias("text"))
    summaries = fuse_chain(own.unionByName(told), join).withColumnRenamed("summary", "__s")
    stay = events.join(moves.select(F.col("old").alias("event_id")), "event_id", "left_anti").join(summaries, "event_id", "left")
    stay = stay.withColumn("summary", F.coalesce("__s", "summary")).drop("__s")
    left = edges.join(moves.select(F.col("old").alias("event_id")), "event_id", "left_anti")
    return stay, rekey(turns, moves, "event_id"), rekey(nodes, moves, "event_id"), left


def fold_into(nodes: DataFrame, edges: DataFrame, into: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph after some nodes went into others (id, into; a target stays): counts and times are rolled up into the target, its body takes the new ones that say something else, edges follow."""
    joined = nodes.join(into, "id", "left").withColumn("__to", F.coalesce("into", "id"))
    own = F.col("into").isNull()
    texts = F.transform(F.array_sort(F.collect_list(F.when(~own, F.struct("ord", "body")))), lambda s: s["body"])
    rest = [c for c in nodes.columns if c not in ("id", "frequency", "first_seen", "last_seen", "body")]
    kept = F.max(F.when(own, F.struct("body", *rest)))
    sums = joined.groupBy("__to").agg(F.sum("frequency").alias("frequency"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), kept.alias("k"), texts.alias("more"))
    sums = sums.select(F.col("__to").alias("id"), "frequency", "first_seen", "last_seen", "k.*", "more")

    def fuse(body: Column, new: Column) -> Column:
        return X.fuse(body, new, X.overlap(X.token_set(body), X.token_set(new)), profile)

    out = sums.withColumn("body", F.when(F.size("more") == 0, F.col("body")).otherwise(F.aggregate("more", F.col("body"), fuse)))
    moves = into.select(F.col("id").alias("old"), F.col("into").alias("kept"))
    moved = rekey(rekey(edges, moves, "source"), moves, "target").where("source <> target")
    return out.select(*nodes.columns), moved


def runs(pairs: DataFrame, nodes: DataFrame, event: str, order: list[str]) -> DataFrame:
    """(id, into): nodes of a run of adjacent pairs (source, target) go into the first of the run."""
    w = W.partitionBy(event).orderBy(*order)
    linked = nodes.join(pairs.select(F.col("target").alias("id"), F.lit(0).alias("__starts")).distinct(), "id", "left")
    numbered = linked.select(event, "id", *[c for c in order if c != "id"], F.sum(F.coalesce("__starts", F.lit(1))).over(w).alias("__run"))
    head = F.first("id").over(W.partitionBy(event, "__run").orderBy(*order))
    return numbered.withColumn("into", head).where("id <> into").select("id", "into")


def compress(nodes: dict[str, DataFrame], edges: dict[str, DataFrame], p: Params, profile: Profile, merge: float | None = None) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """The three graphs after compression, and a change log: weak entity nodes alike are merged, neighbouring stages alike are merged, weak and unimportant causal nodes go.

    nodes: event_id, id, ord, kind or stage, body, k, pinned, weight, importance, frequency, first_seen, last_seen."""
    entity = compression_plan(nodes["entity"], ["event_id", "kind"], p.entity_merge if merge is None else merge, p.compress)
    order = ["start_time", "ord", "id"]
    temporal = runs(stage_pairs(nodes["temporal"], order, p.temporal_merge if merge is None else merge, p.compress), nodes["temporal"], "event_id", order)
    out, links = {}, {}
    for name, into in (("entity", entity), ("temporal", temporal)):
        out[name], links[name] = fold_into(nodes[name], edges[name], into, profile)
    low = ~F.col("pinned") & (F.col("weight") < p.compress) & (F.col("importance") < 0.70)
    gone = nodes["causal"].where(low).select("id")
    out["causal"], links["causal"] = nodes["causal"].where(~low), cascade(edges["causal"], gone, "id")
    log = entity.select(F.lit("entity_compressed").alias("event_type"), "id").unionByName(temporal.select(F.lit("temporal_compressed").alias("event_type"), "id")).unionByName(gone.select(F.lit("causal_pruned").alias("event_type"), "id"))
    return out, links, log


def stage_pairs(nodes: DataFrame, order: list[str], threshold: float, weak: float) -> DataFrame:
    """(event_id, source, target): neighbouring stages, unpinned, one of them weak, whose token multisets k have a cosine of at least threshold."""
    w = W.partitionBy("event_id").orderBy(*order)
    n = nodes.select("event_id", F.col("id").alias("source"), "k", "weight", "pinned", *[F.lead(c).over(w).alias(f"b_{c}") for c in ("id", "k", "weight", "pinned")])
    n = n.where(F.col("b_id").isNotNull() & ~F.col("pinned") & ~F.col("b_pinned") & ((F.col("weight") < weak) | (F.col("b_weight") < weak)))
    return cosines(n, "k", "b_k").where(F.col("cos") >= threshold).select("event_id", "source", F.col("b_id").alias("target"))


def move_turns(turns: DataFrame, moves: DataFrame) -> DataFrame:
    """turns with the event that moves (id, new_event) gives them."""
    m = moves.select(F.col("id").alias("__id"), "new_event")
    return turns.join(m, turns["id"] == m["__id"], "left").withColumn("event_id", F.coalesce("new_event", "event_id")).drop("__id", "new_event")


def delete_turns(turns: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns that stay, and the events (event_id, action) to rebuild, or to drop as they have no turn left."""
    stay = turns.join(gone.select("id").distinct(), "id", "left_anti")
    touched = turns.join(gone.select("id").distinct(), "id", "left_semi").select("event_id").distinct()
    left = stay.groupBy("event_id").agg(F.count("*").alias("n"))
    return stay, touched.join(left, "event_id", "left").select("event_id", F.when(F.col("n").isNull(), "drop").otherwise("rebuild").alias("action"))


def delete_events(turns: DataFrame, tables: list[DataFrame], gone: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Turns of deleted events back in the buffer, and the other tables without these events' rows."""
    dead = gone.select("event_id").distinct().withColumn("__dead", F.lit(True))
    joined = turns.join(dead, "event_id", "left")
    reset = joined.withColumn("status", F.when(F.col("__dead"), "buffered").otherwise(F.col("status"))).withColumn("event_id", F.when(F.col("__dead"), F.lit(None)).otherwise(F.col("event_id"))).drop("__dead")
    return reset.select(*turns.columns), [t.join(dead, "event_id", "left_anti") for t in tables]
