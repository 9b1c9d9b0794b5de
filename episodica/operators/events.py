"""Events of a memory: triggers, frames, titles, recent turns, weights, merges and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.text import any_of, local_summary, shared, token_set
from ..profile import Params, Profile
from .tiles import cosines


def cold_start(turns: DataFrame, p: Params) -> DataFrame:
    """(memory_id, ord, n, reason): the first valid turn at which a memory's graph is made.

    By p.cold_start turns it fires at the latest, so of a memory of any size only so many are windowed; Spark cuts each
    task's rows to these before the shuffle."""
    first = W.partitionBy("memory_id").orderBy("ord")
    turns = turns.where("valid").withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= p.cold_start)
    w = first.rowsBetween(W.unboundedPreceding, 0)
    rows = turns.select("memory_id", "ord", "density", F.avg("density").over(w).alias("mean"), F.count("*").over(w).alias("n"))
    reason = F.when(F.col("density") >= p.density, "density").when((F.col("mean") >= 0.7 * p.density) & (F.col("n") >= 2), "mean").when(F.col("n") >= p.cold_start, "count")
    fired = rows.withColumn("reason", reason).where("reason IS NOT NULL")
    return fired.groupBy("memory_id").agg(F.min(F.struct("ord", "n", "reason")).alias("f")).select("memory_id", "f.ord", "f.n", "f.reason")


def recent(turns: DataFrame, last: dict[str, tuple[str, int]]) -> DataFrame:
    """For each memory the last n values of a column, oldest first: last maps a result's name to (column, n)."""
    back = W.partitionBy("memory_id").orderBy(F.desc("ord"))
    rows = turns.withColumn("__k", F.row_number().over(back)).where(F.col("__k") <= max(n for _, n in last.values()))

    def values(column: str, n: int) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("__k") <= n, F.struct("ord", column)))), lambda s: s[column])

    sums = [values(c, n).alias(k) for k, (c, n) in last.items()]
    return rows.groupBy("memory_id").agg(*sums)


def consistency(scored: DataFrame, event: str, node: str, order: list[str], score: str, last: int = 8) -> DataFrame:
    """scored with mean8, the mean of an event's last scores up to each row, and last8, their nodes."""
    w = W.partitionBy(event).orderBy(*order).rowsBetween(1 - last, 0)
    return scored.select(event, node, F.avg(score).over(w).alias("mean8"), F.collect_list(node).over(w).alias("last8"))


def assigned(turns: DataFrame, events: DataFrame, profile: Profile, last: int = 8, gain: float = 0.05) -> DataFrame:
    """(event_id, turns, last_hit, survival, recent, scores, consistency, visual): an event (event_id, k, survival) after its turns (event_id, id, ord, ts, k, visual): survival raised for each, the last turns, their cosines with the event and the mean of these, and the distinct visual descriptions, cut to 260."""
    scored = cosines(turns.join(events.select("event_id", F.col("k").alias("e_k"), "survival"), "event_id"), "k", "e_k")
    back = scored.withColumn("__k", F.row_number().over(W.partitionBy("event_id").orderBy(F.desc("ord"))))

    def recent(column: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("__k") <= last, F.struct("ord", column)))), lambda s: s[column])

    seen = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("visual") != "", F.struct("ord", "visual")))), lambda s: s["visual"]))
    survival = F.least(F.lit(1.0), F.max("survival") + gain * F.count("*"))
    return back.groupBy("event_id").agg(F.count("*").alias("turns"), F.max("ts").alias("last_hit"), survival.alias("survival"), recent("id").alias("recent"), recent("cos").alias("scores"), F.avg(F.when(F.col("__k") <= last, F.col("cos"))).alias("consistency"), F.substring(F.array_join(seen, profile.join), 1, 260).alias("visual"))


def adjacent_pairs(nodes: DataFrame, event: str, node: str, order: list[str], threshold: float, weak: float = 0.16) -> DataFrame:
    """(event, source, target): neighbours in order, unpinned, one of them weak, with a cosine of at least threshold. nodes: v, weight, pinned."""
    w = W.partitionBy(event).orderBy(*order)
    n = nodes.select(event, F.col(node).alias("source"), "v", "weight", "pinned", *[F.lead(c).over(w).alias(f"b_{c}") for c in (node, "v", "weight", "pinned")])
    n = n.where(F.col(f"b_{node}").isNotNull() & ~F.col("pinned") & ~F.col("b_pinned") & ((F.col("weight") < weak) | (F.col("b_weight") < weak)))
    return n.where(V.cosine(F.col("v"), F.col("b_v")) >= threshold).select(event, "source", F.col(f"b_{node}").alias("target"))


def prunable(threshold: float) -> Column:
    return ~F.col("pinned") & (F.col("weight") < threshold) & (F.col("importance") < 0.70)


def compression(kept: Column, raw: Column) -> Column:
    return F.when(raw == 0, 1.0).otherwise(kept / raw)


def price(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, input_cost, output_cost, total_cost): usage (model, input_tokens, output_tokens; null as 0) at prices a thousand tokens; null for an unknown model.

    Usage is summed by model before prices are joined."""
    sums = usage.groupBy("model").agg(*[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("input_tokens", "output_tokens")])
    cost = {k: F.col(f"{k}_tokens") / 1000 * F.col("price_per_1k_tokens") for k in ("input", "output")}
    joined = sums.join(prices, "model", "left")
    return joined.select("model", *[F.round(c, 6).alias(f"{k}_cost") for k, c in cost.items()], F.round(cost["input"] + cost["output"], 6).alias("total_cost"))


def rekey(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """rows with key replaced by mapping's (old, kept) where it has one."""
    joined = rows.join(mapping, rows[key] == mapping["old"], "left")
    return joined.withColumn(key, F.coalesce("kept", key)).drop("old", "kept")


def frame(turns: DataFrame, event: str, profile: Profile) -> DataFrame:
    """(event, members, start_time, end_time, importance) of an event's turns (id, ord, ts, text, saliency)."""
    critical = F.max(any_of(F.col("text"), profile.critical).cast("int"))
    importance = F.round(F.least(F.lit(1.0), 0.3 + 0.3 * F.max("saliency") + 0.4 * critical), 4)
    members = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda s: s["id"])
    return turns.groupBy(event).agg(members.alias("members"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), importance.alias("importance"))


def titles(turns: DataFrame, event: str, profile: Profile, previous: DataFrame | None = None, limit: int = 240) -> DataFrame:
    """(event, title, summary) from an event's first turns (text normalised), and from previous (event, title, summary) if there is one.

    Title: the first critical word in the first three texts; else their first three words that count; else the previous
    title; else their first 18 characters. Summary: the previous one and the texts, the first six distinct, cut to 240."""
    first = turns.withColumn("__k", F.row_number().over(W.partitionBy(event).orderBy("ord"))).where("__k <= 6")
    texts = first.groupBy(event).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]).alias("six"))
    texts = texts.withColumn("head", F.array_join(F.slice("six", 1, 3), " ")).withColumn("__t", token_set(F.col("head")))
    if previous is None:
        texts = texts.withColumns({"__title": F.lit(None).cast("string"), "__summary": F.lit(None).cast("string")})
    else:
        texts = texts.join(previous.select(event, F.col("title").alias("__title"), F.col("summary").alias("__summary")), event, "left")
    title = title_of(F.col("head"), F.col("__t"), F.col("__title"), profile)
    return texts.select(event, title.alias("title"), summary_of(F.col("six"), F.col("__summary"), profile, limit).alias("summary"))


def title_of(head: Column, tokens: Column, previous: Column, profile: Profile) -> Column:
    """An event's title from its first three texts in one, their token set, and the title before."""
    title = F.when(F.lit(False), F.lit(None).cast("string"))
    for word in profile.critical:
        title = title.when(F.contains(head, F.lit(word)), word + profile.title_suffix)
    words = shared(tokens, tokens, profile, 3)
    title = title.when(F.size(words) > 0, F.substring(F.array_join(words, " / "), 1, 18)).when(F.coalesce(previous, F.lit("")) != "", previous)
    return title.when(head == "", profile.default_title).otherwise(F.substring(head, 1, 18))


def summary_of(texts: Column, previous: Column, profile: Profile, limit: int = 240) -> Column:
    """The summary before and the texts: the first six distinct, joined and cut."""
    pieces = F.filter(F.concat(F.array(F.coalesce(previous, F.lit(""))), texts), lambda x: x != "")
    return F.substring(F.array_join(F.array_distinct(F.slice(pieces, 1, 6)), profile.join), 1, limit)


def last_texts(nodes: dict[str, DataFrame], k: int, event: str = "event_id") -> DataFrame:
    """(event, last, n_nodes): the bodies of an event's last k nodes (event, ord, id, body), graph after graph, and how many it has."""
    every = None
    for place, n in enumerate(nodes.values()):
        n = n.select(event, F.struct(F.lit(place).alias("graph"), "ord", "id", "body").alias("n"))
        every = n if every is None else every.unionByName(n)
    # the last k before they are gathered, so that an event of any size makes a short list
    ranked = every.withColumn("__k", F.row_number().over(W.partitionBy(event).orderBy(F.desc("n"))))
    last = F.transform(F.array_sort(F.collect_list(F.when(F.col("__k") <= k, F.col("n")))), lambda s: s["body"])
    return ranked.groupBy(event).agg(last.alias("last"), F.count("*").alias("n_nodes"))


def summary_pieces(previous: DataFrame, turns: DataFrame, profile: Profile) -> DataFrame:
    """(event_id, ord, text): what an event's summary is fused from after its last turn: the summary before (event_id, summary), that turn's own, and the last three texts. turns: event_id, ord, question, answer, text."""
    back = turns.withColumn("__k", F.row_number().over(W.partitionBy("event_id").orderBy(F.desc("ord")))).where("__k <= 3")
    before = previous.select("event_id", F.lit(0).cast("long").alias("ord"), F.col("summary").alias("text"))
    own = back.where("__k = 1").select("event_id", F.lit(1).cast("long").alias("ord"), local_summary(F.col("question"), F.col("answer"), F.lit("")).alias("text"))
    return before.unionByName(own).unionByName(back.select("event_id", (5 - F.col("__k")).cast("long").alias("ord"), "text"))
