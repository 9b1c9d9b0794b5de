"""Turns as a stream: clusters as keyed state, and the graphs' nodes as sums of what each micro-batch adds."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import Clusters
from ..operators.retrieve import union_nodes
from ..profile import Params, Profile

RESULT = "memory_id string, id string, ord long, cluster int"


def assign(turns: DataFrame, p: Params, profile: Profile) -> DataFrame:
    """A stream of (memory_id, id, ord, cluster) from a stream of turns (memory_id, id, ord, ts, text).

    Turns are taken as they arrive, in order within a micro-batch; an older turn that comes late joins the clusters as they
    are by then. Replays are for timely() to drop, by id. With turns in order, any cut into micro-batches gives the rows
    of operators.folds.cluster_turns."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clusters = pickle.loads(state.get[0]) if state.exists else Clusters(p, profile)
        rows = pd.concat(list(batches)).sort_values(["ord", "id"])  # one memory's turns of one micro-batch
        out = rows[["memory_id", "id", "ord"]].copy()
        out["cluster"] = [clusters.add(t, s) for t, s in zip(rows["text"], rows["ts"], strict=True)]
        state.update((pickle.dumps(clusters),))
        yield out

    keyed = turns.select("memory_id", "id", "ord", "ts", "text").groupBy("memory_id")
    return keyed.applyInPandasWithState(step, RESULT, "state binary", "append", GroupStateTimeout.NoTimeout)


def timely(turns: DataFrame, event_time: str, delay: str, keys: list[str]) -> DataFrame:
    """A stream without the rows whose keys came before, or that are later than delay."""
    return turns.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def apply_turns(turns: DataFrame, nodes: Callable[[DataFrame], dict[str, DataFrame]], path: str, checkpoint: str) -> None:
    """Adds a stream of turns to the graphs: each micro-batch's nodes go to a partition of its own under path, so a batch that runs twice replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        n = union_nodes(nodes(batch)).withColumn("name", F.when(F.col("graph") == "temporal", F.col("stage")).otherwise(F.col("body")))
        n.select("graph", "memory_id", "event_id", F.coalesce("kind", F.lit("")).alias("kind"), "name", F.col("graph_ord").alias("ord"), "frequency", "first_seen", "last_seen").write.mode("overwrite").parquet(f"{path}/batch={number}")

    turns.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes that all micro-batches make: those of one name of an event and class are one."""
    keys = ["graph", "memory_id", "event_id", "kind", "name"]
    return spark.read.option("basePath", path).parquet(path).groupBy(*keys).agg(F.min("ord").alias("ord"), F.sum("frequency").alias("frequency"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Writes all that is there to out, in micro-batches, and ends."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def read_turns(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
