"""Rule-based extraction: chunks, classes, stages, causes, relations. All map-side but for the relations' window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import any_of, normalize
from ..profile import Profile

CHUNKS, CHUNK_CHARS, SIDE_CHARS, RELATIONS = 18, 48, 60, 10


def chunks(text: Column, profile: Profile) -> Column:
    """The normalised pieces between the profile's delimiters, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), profile.split), normalize), lambda c: c != "")


def chunk_rows(df: DataFrame, keys: list[str], text: str, profile: Profile) -> DataFrame:
    """(keys, pos, whole, chunk): the first 18 chunks, each cut to 48 characters."""
    rows = df.select(*keys, F.posexplode(F.slice(chunks(F.col(text), profile), 1, CHUNKS)).alias("pos", "whole"))
    return rows.withColumn("chunk", F.substring("whole", 1, CHUNK_CHARS))


def classify(chunk: Column, classes: tuple[tuple[str, tuple[str, ...]], ...], other: str) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, words in classes:
        out = out.when(any_of(chunk, words), kind)
    return out.otherwise(other)


def facts(df: DataFrame, keys: list[str], text: str, profile: Profile) -> DataFrame:
    rows = chunk_rows(df, keys, text, profile)
    return rows.withColumn("kind", classify(F.col("whole"), profile.classes, profile.other_class))


def stage(parts: Column, profile: Profile) -> Column:
    text = F.array_join(F.slice(parts, 1, 5), " ")
    out = F.when(any_of(text, profile.day_time) & any_of(text, profile.first_stage[1]), profile.first_stage[0])
    for name, words in profile.stages:
        out = out.when(any_of(text, words), name)
    return out.otherwise(profile.default_stage)


def causal(parts: Column, profile: Profile) -> Column:
    """struct(causal_type, text, cause, effect) of the first 6 chunks."""
    text = F.array_join(F.slice(parts, 1, 6), " ")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    kind = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, name in profile.causal_patterns:
        kind = kind.when(text.rlike(pattern), name)
    effect_cut = F.contains(text, F.lit(profile.cause_word)) & F.contains(text, F.lit(profile.effect_word))
    condition_cut = F.contains(text, F.lit(profile.condition_word)) & any_of(text, profile.condition_needs)
    by_effect = kind.isNotNull() & effect_cut
    by_condition = kind.isNotNull() & ~effect_cut & condition_cut

    def side(before: bool, separator: str) -> Column:
        at = F.instr(text, separator)
        if before:
            return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
        return F.when(at > 0, F.substring(text, at + len(separator), F.length(text))).otherwise("")

    def cut(x: Column) -> Column:
        return F.substring(F.trim(x), 1, SIDE_CHARS)

    empty = F.lit("")
    cause = F.when(by_effect, cut(F.replace(side(True, profile.effect_word), F.lit(profile.cause_word), empty))).when(by_condition, cut(F.replace(side(True, profile.condition_split), F.lit(profile.condition_word), empty))).otherwise("")
    changed = any_of(text, profile.changes)
    effect = F.when(by_effect, cut(side(False, profile.effect_word))).when(by_condition, cut(side(False, profile.condition_split))).when(changed, last).otherwise("")
    found = by_effect | by_condition
    return F.struct(F.when(found, kind).when(changed, "state_change").otherwise("implicit").alias("causal_type"), F.when(found | changed, text).otherwise(last).alias("text"), cause.alias("cause"), effect.alias("effect"))


def relations(facts: DataFrame, keys: list[str], profile: Profile) -> DataFrame:
    """(keys, rank, source_text, target_text, relation_label): facts that aren't places, by class then position, at the first place; 10 at most."""
    place = F.min(F.when(F.col("kind") == "location", F.struct("pos", "chunk"))).over(W.partitionBy(*keys))
    order = F.lit(0)
    for i, k in enumerate(("person", "location", "equipment", "material", "building_area", "hazard")):
        order = F.when(F.col("kind") == k, i).otherwise(order)
    rows = facts.withColumn("place", place["chunk"]).where("kind <> 'location' AND place IS NOT NULL")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(order, "pos")))
    return rows.where(F.col("rank") <= RELATIONS).select(*keys, "rank", F.col("chunk").alias("source_text"), F.col("place").alias("target_text"), F.lit(profile.location_label).alias("relation_label"))


def legacy_facts(df: DataFrame, keys: list[str], text: str, profile: Profile, visual: str | None = None, most: int = 8) -> DataFrame:
    """(keys, kind, pos, name): chunks by the one-graph classes, each once and at most 8 a class; a visual description is one more, of class visual_evidence, cut to 80 characters."""
    rows = chunk_rows(df, keys, text, profile)
    rows = rows.select(*keys, classify(F.col("whole"), profile.legacy_classes, profile.legacy_other_class).alias("kind"), "pos", F.col("chunk").alias("name"))
    if visual:
        seen = df.where(F.col(visual) != "").select(*keys, F.lit("visual_evidence").alias("kind"), F.lit(CHUNKS).alias("pos"), F.substring(visual, 1, 80).alias("name"))
        rows = rows.unionByName(seen)
    first = rows.groupBy(*keys, "kind", "name").agg(F.min("pos").alias("pos"))
    w = W.partitionBy(*keys, "kind").orderBy("pos")
    return first.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def legacy_relations(facts: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """(keys, rank, source_text, target_text, relation_label): facts, class after class, that aren't places LOCATED_IN the first place, and the first hazard RELATES_TO the first incident; 10 at most."""
    order = F.lit(len(classes))
    for i, k in enumerate(classes):
        order = F.when(F.col("kind") == k, i).otherwise(order)
    whole = W.partitionBy(*keys)

    def first(kind: str) -> Column:
        return F.min(F.when(F.col("kind") == kind, F.struct("pos", "name"))).over(whole)["name"]

    rows = facts.withColumns({"__order": order, "__place": first("location"), "__hazard": first("hazard"), "__incident": first("incident")})
    at = rows.where("kind <> 'location' AND __place IS NOT NULL").select(*keys, "__order", "pos", F.col("name").alias("source_text"), F.col("__place").alias("target_text"), F.lit("LOCATED_IN").alias("relation_label"))
    meets = rows.where("__hazard IS NOT NULL AND __incident IS NOT NULL").select(*keys, F.lit(len(classes) + 1).alias("__order"), F.lit(0).alias("pos"), F.col("__hazard").alias("source_text"), F.col("__incident").alias("target_text"), F.lit("RELATES_TO").alias("relation_label")).distinct()
    both = at.unionByName(meets).withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("__order", "pos")))
    return both.where(F.col("rank") <= RELATIONS).select(*keys, "rank", "source_text", "target_text", "relation_label")
