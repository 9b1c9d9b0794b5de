"""Where a model takes the place of a rule. Each hook runs over Arrow batches; its default is the rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import text as X
from ..profile import Profile
from ..sources.scratch import materialize
from . import extract as rules
from .events import summary_of, title_of
from .folds import DIM, token_list, vector


def embed(texts: Column, encode: Callable[[list[str]], list] | None = None) -> Column:
    """A dense vector for each text. encode takes a batch of texts; the default is the hash embedding."""
    work = encode or (lambda batch: [vector(token_list(t), DIM).tolist() for t in batch])

    @pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(work(batch.fillna("").tolist()), dtype=object)

    return run(texts)


def extract(turns: DataFrame, keys: list[str], text: str, profile: Profile, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """(keys, x): what a turn says, as struct(entities, temporal, causal, relations). model takes a batch of texts and gives a JSON text for each; the default is the rules."""
    if model is not None:

        @pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(model(batch.fillna("").tolist()))

        return turns.select(*keys, extract_json(run(text), profile).alias("x"))
    facts = rules.facts(turns, keys, text, profile)
    related = rules.relations(facts, keys, profile)
    parts = turns.select(*keys, rules.chunks(F.col(text), profile).alias("parts"))

    def ordered(column: str, *rest: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(column, *rest))), lambda s: F.struct(*[s[c].alias(c) for c in rest]))

    e = facts.withColumnRenamed("chunk", "name").groupBy(*keys).agg(ordered("pos", "kind", "name").alias("entities"))
    r = related.groupBy(*keys).agg(ordered("rank", "source_text", "target_text", "relation_label").alias("relations"))
    c = rules.causal(F.col("parts"), profile)
    temporal = F.array(F.struct(rules.stage(F.col("parts"), profile).alias("stage_name"), F.lit("").alias("start_time_ref"), F.array_join(F.slice("parts", 1, 5), " ").alias("summary"), F.lit("").alias("sensor_ref")))
    out = parts.select(*keys, temporal.alias("temporal"), F.array(F.struct(c["causal_type"].alias("causal_type"), c["text"].alias("text"), c["cause"].alias("cause"), c["effect"].alias("effect"))).alias("causal"))
    out = out.join(e, keys, "left").join(r, keys, "left")
    fields = ["entities", "temporal", "causal", "relations"]
    return out.select(*keys, F.struct(*[F.coalesce(c, F.array()).alias(c) for c in fields]).alias("x"))


_STAGE = "struct<stage_name: string, start_time_ref: string, summary: string, sensor_ref: string>"
_CAUSE = "struct<causal_type: string, text: string, cause: string, effect: string>"
_RELATION = "array<struct<source_text: string, target_text: string, relation_label: string>>"


def extract_json(raw: Column, profile: Profile, most: int = 8) -> Column:
    """An upstream model's JSON as struct(entities, temporal, causal, relations): known classes only, normalised, without blanks, 8 a class at most; temporal and causal as lists, also where the JSON has one object; relations with both ends."""
    kinds = ", ".join(f"`{k}`: array<string>" for k in profile.entity_types)

    def listed(text: Column, kind: str) -> Column:
        one = F.from_json(text, kind)
        some = F.when(F.substring(F.trim(text), 1, 1) == "[", F.from_json(text, f"array<{kind}>")).when(F.substring(F.trim(text), 1, 1) == "{", F.array(one))
        return F.coalesce(some, F.from_json(F.lit("[]"), f"array<{kind}>"))

    def clean(values: Column) -> Column:
        return F.slice(F.filter(F.transform(F.coalesce(values, X.none()), X.normalize), lambda v: v != ""), 1, most)

    def read(s: Column) -> Column:
        entities = F.flatten(F.array(*[_typed(clean(s["parsed"]["entities"][k]), k) for k in profile.entity_types]))
        relations = _relations(s["parsed"]["relations"], profile.location_label)
        return F.struct(entities.alias("entities"), listed(s["temporal"], _STAGE).alias("temporal"), listed(s["causal"], _CAUSE).alias("causal"), relations.alias("relations"))

    def parse(text: Column) -> Column:
        parsed = F.from_json(text, f"struct<entities: struct<{kinds}>, relations: {_RELATION}>")
        return _once(F.struct(parsed.alias("parsed"), *[F.get_json_object(text, f"$.{n}").alias(n) for n in ("temporal", "causal")]), read)

    return _once(X.strip_fence(raw), parse)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row: an expression that is used in several places is computed in each, and a parser for each field that is read."""
    return F.transform(F.array(value), use)[0]


def legacy_extract_json(raw: Column, profile: Profile, most: int = 8) -> Column:
    """The one-graph form, struct(candidates, relations): a candidate of a class that isn't known is one of the last class, and labels are upper case, RELATES_TO where there is none."""
    known = [k for k, _ in profile.legacy_classes]

    def typed(e: Column) -> Column:
        kind = F.when(e["key"].isin(*known), e["key"]).otherwise(profile.legacy_other_class)
        names = F.slice(F.filter(F.transform(F.coalesce(e["value"], X.none()), X.normalize), lambda v: v != ""), 1, most)
        return F.transform(names, lambda n: F.struct(kind.alias("kind"), n.alias("name")))

    def read(parsed: Column) -> Column:
        entries = F.map_entries(F.coalesce(parsed["candidates"], F.from_json(F.lit("{}"), "map<string, array<string>>")))
        relations = F.transform(_relations(parsed["relations"], "RELATES_TO"), lambda r: F.struct(r["source_text"].alias("source_text"), r["target_text"].alias("target_text"), F.upper(X.normalize(r["relation_label"])).alias("relation_label")))
        return F.struct(F.flatten(F.transform(entries, typed)).alias("candidates"), relations.alias("relations"))

    return _once(F.from_json(X.strip_fence(raw), f"struct<candidates: map<string, array<string>>, relations: {_RELATION}>"), read)


def _relations(found: Column, label: str) -> Column:
    ends = F.filter(F.coalesce(found, F.from_json(F.lit("[]"), _RELATION)), lambda r: (X.normalize(r["source_text"]) != "") & (X.normalize(r["target_text"]) != ""))
    return F.transform(ends, lambda r: F.struct(X.normalize(r["source_text"]).alias("source_text"), X.normalize(r["target_text"]).alias("target_text"), F.coalesce(r["relation_label"], F.lit(label)).alias("relation_label")))


def _typed(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("name")))


def once(df: DataFrame, inputs: list[str], model: Callable[[list[dict]], list], result: str, name: str, tries: int = 3, batch: int = 64) -> DataFrame:
    """df with name, what model makes of a row's inputs, and <name>_tries, how often it was asked for them.

    Rows with equal inputs are asked for once, by a digest, so long texts aren't compared; what comes back is written before
    it is joined, so no later step asks again. model takes up to batch dicts of inputs and gives a value of the SQL type
    result for each; where it raises, its inputs are asked for one by one, tries times in all, and null is the answer if
    all fail."""
    key = F.sha2(F.to_json(F.struct(*inputs)), 256)
    keyed = df.withColumn("__key", key)
    asked = keyed.groupBy("__key").agg(F.any_value(F.struct(*inputs)).alias("__in")).select("__key", "__in.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), batch):
                part = rows.iloc[start : start + batch]
                records, values, times = part[inputs].to_dict("records"), [], []
                try:
                    values, times = list(model(records)), [1] * len(part)
                except Exception:  # whatever the model's client raises
                    for one in records:
                        value, n = None, 1
                        while n < tries:
                            n += 1
                            try:
                                value = model([one])[0]
                                break
                            except Exception:  # the same, for one
                                continue
                        values.append(value)
                        times.append(n)
                yield pd.DataFrame({"__key": part["__key"], name: pd.Series(values, index=part.index, dtype=object), f"{name}_tries": times})

    answers = materialize(asked.mapInPandas(run, f"__key string, `{name}` {result}, `{name}_tries` int"))
    return keyed.join(answers, "__key").drop("__key")


def _fused(pieces: Column, profile: Profile, alike: float = 0.72, limit: int = 240) -> Column:
    """Pieces in order without those like one that is kept, joined and cut."""

    def add(kept: Column, piece: Column) -> Column:
        near = F.exists(kept, lambda k: X.overlap(X.token_set(k), X.token_set(piece)) > alike)
        return F.when((piece == "") | near, kept).otherwise(F.array_append(kept, piece))

    return F.substring(F.array_join(F.aggregate(F.transform(pieces, X.normalize), X.none(), add), profile.join), 1, limit)


def _fuse(alike: bool):
    def rule(c: dict[str, Column], profile: Profile) -> Column:
        before, new = c["previous"], c["new"]
        return X.fuse(before, new, X.overlap(X.token_set(before), X.token_set(new)) if alike else F.lit(0.0), profile)

    return rule


def _title(c: dict[str, Column], profile: Profile) -> Column:
    head = F.array_join(F.slice(c["texts"], 1, 3), " ")
    return title_of(head, X.token_set(head), c["previous"], profile)


#: What a summariser is asked for: its inputs, and the rule that stands in for a model.
SUMMARIES: dict[str, tuple[list[str], Callable[[dict[str, Column], Profile], Column]]] = {
    "turn": (["question", "answer", "visual"], lambda c, p: X.local_summary(c["question"], c["answer"], c["visual"])),
    "event_title": (["texts", "previous"], _title),
    "event_summary": (["texts", "previous"], lambda c, p: summary_of(c["texts"], c["previous"], p)),
    "fuse_summary": (["previous", "local", "texts"], lambda c, p: _fused(F.concat(F.array(F.coalesce(c["previous"], F.lit("")), F.coalesce(c["local"], F.lit(""))), F.slice(F.reverse(F.slice(F.reverse(c["texts"]), 1, 3)), 1, 3)), p)),
    "fuse_entity": (["previous", "new"], _fuse(True)),
    "fuse_temporal": (["previous", "new"], _fuse(False)),
    "fuse_causal": (["previous", "new"], _fuse(True)),
}


def summarise(df: DataFrame, method: str, profile: Profile, model: Callable[[list[dict]], list[str]] | None = None, tries: int = 3, batch: int = 64) -> DataFrame:
    """df (with the inputs of a method of SUMMARIES) with summary: the model's, where it gives one, or the rule's; with a model, summary_tries too."""
    inputs, rule = SUMMARIES[method]
    ruled = rule({c: F.col(c) for c in inputs}, profile)
    if model is None:
        return df.withColumn("summary", ruled)
    asked = once(df, inputs, model, "string", "summary", tries, batch)
    return asked.withColumn("summary", F.coalesce("summary", ruled))


CHAIN = "array<struct<causal_type: string, cause: string, effect: string>>"


def review(turns: DataFrame, model: Callable[[list[dict]], list[str]] | None = None, tries: int = 3, batch: int = 64) -> DataFrame:
    """turns (new, known: CHAIN; text) with chain, correction and reason: what a reviewer makes of a turn's causal items and those that its event has.

    model gives a JSON text for each dict of new, known (as JSON) and text, with new_causal_chain, is_correction and reason;
    a correction's chain is to replace what is known. Without a model, where nothing is new or nothing is known, where it
    fails or its chain is empty, the new items stay as they are. Equal questions are asked once."""
    kept, no, none = F.col("new"), F.lit(False), F.lit("")
    if model is None:
        return turns.withColumns({"chain": kept, "correction": no, "reason": none})
    asks = (F.size("new") > 0) & (F.size("known") > 0)
    rows = turns.withColumns({"__new": F.to_json("new"), "__known": F.to_json("known"), "__text": F.coalesce("text", none)})

    def named(records: list[dict]) -> list[str]:
        return model([{k.removeprefix("__"): v for k, v in r.items()} for r in records])

    asked = once(rows.where(asks), ["__new", "__known", "__text"], named, "string", "__raw", tries, batch).drop("__raw_tries")
    rest = rows.where(~F.coalesce(asks, no)).withColumn("__raw", F.lit(None).cast("string"))
    said = F.from_json(F.col("__raw"), f"struct<is_correction: boolean, reason: string, new_causal_chain: {CHAIN}>")
    out = asked.unionByName(rest).withColumn("__said", said)
    chain = F.col("__said.new_causal_chain")
    out = out.withColumns({"chain": F.when(F.size(chain) > 0, chain).otherwise(kept), "correction": F.coalesce("__said.is_correction", no), "reason": F.coalesce("__said.reason", none)})
    return out.drop("__new", "__known", "__text", "__raw", "__said")


def answer(lines: DataFrame, model: Callable[[list[str], list[list[str]]], list[str]] | None, prefix: str, nothing: str, join: str) -> DataFrame:
    """lines (question, lines) with answer: the model's, or the rule's."""
    from .retrieve import rule_answer

    if model is None:
        return lines.withColumn("answer", rule_answer(F.col("lines"), prefix, nothing, join))

    @pandas_udf("string")
    def run(question: pd.Series, context: pd.Series) -> pd.Series:
        return pd.Series(model(question.fillna("").tolist(), [list(c) for c in context]))

    return lines.withColumn("answer", run("question", "lines"))
