"""Routing of turns to the events of their memory."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..profile import Params, Profile
from .tiles import Pair, meet


def route(turns: DataFrame, events: DataFrame, p: Params, profile: Profile, legacy: bool = False) -> DataFrame:
    """(id, event_id, score) for each turn that has an earlier event in its memory: the best of the events before its own, the earliest of equals, or null below the threshold.

    turns: memory_id, event_id, id, ord, ts, k, keys; events: memory_id, event_id, ord, updated_at, k, keys. No event takes
    part that holds the turn, or a later one: how many events there were, and which was the newest, is as of the turn's own."""
    w = W.partitionBy("memory_id").orderBy("ord")
    own = events.select("event_id", F.col("ord").alias("own"), (F.row_number().over(w) - 1).alias("n_events"), F.coalesce(F.lag("ord").over(w), F.lit(-1)).alias("last"))
    turns = turns.join(own, "event_id")
    e = events.withColumn("id", F.col("event_id")).withColumn("place", F.col("ord"))

    def decay(age: np.ndarray) -> np.ndarray:
        return np.exp2(-age / p.half_life)

    def score(pair: Pair) -> dict[str, np.ndarray]:
        cos = np.maximum(pair.cos, 0)
        age = pair.a("ts") - pair.b("updated_at")
        if legacy:
            s = 0.62 * cos + 0.22 * pair.overlap + 0.16 * decay(np.maximum(age, 0))
        else:
            s = 0.52 * cos + 0.18 * pair.overlap + 0.30 * decay(np.abs(age)) + 0.15 * (pair.b("place") == pair.a("last"))
            s = np.where(pair.key_match < 0.3, 0.15 * s, s)
        return {"score": s, "n_events": pair.a("n_events")}

    def earlier(pair: Pair) -> np.ndarray:
        return pair.b("place") < pair.a("own")

    met = meet(turns, e, ["memory_id"], score, where=earlier, top=1, numbers=(["ts", "own", "n_events", "last"], ["updated_at", "place"]), keys=[] if legacy else list(profile.key_patterns), columns=["score", "n_events"])
    best = met.groupBy(F.col("a").alias("id")).agg(F.max_by(F.struct(F.col("b").alias("event_id"), "score", "n_events"), F.struct("score", -F.col("b_ord"))).alias("m"))
    threshold = F.when(F.col("m.n_events") <= 3, 0.55 * p.new_event).otherwise(p.new_event)
    return best.select("id", F.when(F.col("m.score") >= threshold, F.col("m.event_id")).alias("event_id"), "m.score")
