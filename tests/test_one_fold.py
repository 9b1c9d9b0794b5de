"""Nodes and how often they came up, from one fold over the turns."""

from pyspark.sql import functions as F

from episodica.operators import live, replay
from episodica.plans.catalog import QUERIES
from episodica.plans.graph_memory import AS_OF, memory_turns
from episodica.profile import ASCII, Params


def test_accesses_and_nodes_come_from_one_fold(spark, data, monkeypatch):
    said = live.prepared(memory_turns(spark, data), ASCII, "question")
    nodes = live.nodes(live.updates(said, Params(), ASCII), AS_OF, Params(), ASCII)
    n = replay.accesses(replay.replay(said, Params(), ASCII)).select(F.col("node").alias("id"), "access")
    want = nodes.join(n, "id", "left").select("memory_id", "id", "event_id", "graph", "name", "last_seen", "importance", F.coalesce("access", F.lit(0)))
    got = replay.touched(said, Params(), ASCII)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    folds, kind = [], type(spark.range(0))
    monkeypatch.setattr(kind, "mapInPandas", lambda df, *args, f=kind.mapInPandas, **kwargs: folds.append(1) or f(df, *args, **kwargs))
    QUERIES["replayed_accesses"](spark, data)
    assert len(folds) == 1
