"""Queries over texts: normalising, tokens, scores and rule-based extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extract
from ..profile import ASCII as P
from .adapters import TURNS, documents, quote, sql_any, sql_hits, sql_normalize, sql_overlap, sql_tokens, table, turns
from .registry import query

STOP = "[" + ", ".join(map(quote, P.stop)) + "]"


@query(f"SELECT doc_id, length(n) AS n_chars_clean, md5(n) AS digest FROM (SELECT doc_id, {sql_normalize('text')} AS n FROM documents)")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = documents(spark, sf_dir).select("doc_id", X.normalize(F.col("text")).alias("n"))
    return n.select("doc_id", F.length("n").alias("n_chars_clean"), F.md5("n").alias("digest"))


@query(f"SELECT conv_id, turn, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, '|')) AS digest FROM (SELECT conv_id, turn, {sql_tokens('text')} AS t FROM conversations)")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.tokens(F.col("text")).alias("t"))
    return t.select("conv_id", "turn", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", "|")).alias("digest"))


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = documents(spark, sf_dir).select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sets of each row and of the row before it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.token_set(F.col("text")).alias("t"))
    return rows.withColumn("before", F.lag("t").over(W.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")


_NEIGHBOURS = f"WITH s AS (SELECT conv_id, turn, list_distinct({sql_tokens('text')}) AS t FROM conversations), n AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM s), p AS (SELECT * FROM n WHERE b IS NOT NULL) "


@query(_NEIGHBOURS + f"SELECT conv_id, turn, round({sql_overlap('t', 'b')}, 6) AS overlap FROM p")
def lexical_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("conv_id", "turn", F.round(X.overlap(F.col("t"), F.col("before")), 6).alias("overlap"))


@query(_NEIGHBOURS + f"SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_intersect(t, b), lambda x: length(x) > 1 AND NOT list_contains({STOP}, x)))[1:6], '|') AS terms FROM p")
def shared_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("conv_id", "turn", F.array_join(X.shared(F.col("t"), F.col("before"), P), "|").alias("terms"))


@query(_NEIGHBOURS + "SELECT conv_id, turn, round(len(list_intersect(t, b))::DOUBLE / greatest(len(t), 1), 6) AS coverage FROM p")
def keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("conv_id", "turn", F.round(X.coverage(F.col("t"), F.col("before")), 6).alias("coverage"))


def _density_sql(text: str, question: str, answer: str) -> str:
    return f"""CASE WHEN {text} = '' THEN 0.0 ELSE greatest(0.0, least(1.0,
  0.25 * least(1.0, len(list_filter(list_distinct(k), lambda x: {sql_any('x', P.entity_types)})) / 5.0::DOUBLE)
  + 0.30 * least(1.0, {sql_hits(text, P.critical)} / 4.0::DOUBLE)
  + 0.15 * (len(list_distinct(k))::DOUBLE / greatest(len(k), 1))
  + 0.15 * least(1.0, ln(1 + length(replace({text}, ' ', '')))::DOUBLE / ln(201::DOUBLE))
  + 0.15 * ((({sql_normalize(question)} <> '')::INT + ({sql_normalize(answer)} <> '')::INT + {sql_any(text, P.places)}::INT + {sql_any(text, P.actions)}::INT) / 4.0::DOUBLE))) END"""


#: A WITH list that ends in scored: turns with k (tokens) and density.
SCORED = f"{TURNS}, toks AS (SELECT *, {sql_tokens('text')} AS k FROM turns), scored AS (SELECT *, {_density_sql('text', 'question', 'answer')} AS density FROM toks)"


def scored_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("k", X.tokens(F.col("text")))
    return t.withColumn("density", X.density(F.col("text"), F.col("k"), F.col("question"), F.col("answer"), P))


@query(f"WITH {SCORED} SELECT id, round(density, 6) AS density FROM scored")
def information_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_turns(spark, sf_dir).select("id", F.round("density", 6).alias("density"))


@query(
    f"""WITH {TURNS} SELECT id, {sql_any('text', P.pins)} AS pinned, least(1.0, {sql_hits('lower(text)', P.conflicts)} / 2.0)::DOUBLE AS conflict,
  {sql_any("lower(question) || lower(answer)", P.corrections)} AS is_correction,
  {sql_normalize("question || ' ' || answer || ' '")}[1:120] AS local_summary, text AS turn_text,
  round(least(1.0, (0.3 + 0.2 * least(1.0, (ord + 1) / 5.0::DOUBLE) + 0.2 * 0.5) * (1.0 + least(1.0, {sql_hits('lower(text)', P.conflicts)} / 2.0::DOUBLE) + CASE WHEN {sql_any('text', P.authority)} THEN 0.3 ELSE 0.0 END) + 0.3 * exp(-ln(2.0::DOUBLE) * (ord * 600) / 21600.0::DOUBLE)), 6) AS evidence FROM turns"""
)
def turn_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    text, q, a = F.col("text"), F.col("question"), F.col("answer")
    evidence = X.evidence_weight(text, F.col("ord") + 1, F.lit(0.5), F.col("ord") * 600, 21600.0, P)
    return t.select("id", X.pinned(text, P).alias("pinned"), X.conflict_signal(text, P).alias("conflict"), X.is_correction(q, a, P).alias("is_correction"), X.local_summary(q, a, F.lit("")).alias("local_summary"), text.alias("turn_text"), F.round(evidence, 6).alias("evidence"))


@query(
    """SELECT page_id, CASE WHEN len(p) > 0 AND v <> '' THEN 'text+image' WHEN len(p) > 0 THEN 'image' ELSE 'text' END AS modality,
  array_to_string(list_filter(list_concat([v], list_transform(p, lambda u: 'image:' || string_split(u, '/')[-1])), lambda x: x <> ''), '; ') AS visual
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN [] WHEN url IS NULL THEN [] ELSE [regexp_replace(url, '/+$', '')] END AS p, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'page ' || page_id END AS v FROM pages)"""
)
def visual_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    paths = F.when((F.col("page_id") % 3 == 0) | F.col("url").isNull(), X.none()).otherwise(F.array("url"))
    visual = F.when(F.col("page_id") % 2 == 0, "").otherwise(F.concat(F.lit("page "), F.col("page_id")))
    return pages.select("page_id", X.modality(paths, visual).alias("modality"), X.visual_text(paths, visual, P).alias("visual"))


def _sql_key(k: str, x: str) -> str:
    parts = [f"regexp_extract_all({x}, '{p}')" for p in P.key_patterns[k]]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return f"list_distinct({out})"


_KEYS = ", ".join(f"{_sql_key(k, 'text')} AS {k}" for k in P.key_patterns)


@query("SELECT conv_id, turn, " + ", ".join(f"array_to_string(list_sort({k}), '|') AS {k}" for k in P.key_patterns) + f" FROM (SELECT conv_id, turn, {_KEYS} FROM conversations)")
def key_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.key_entities(F.col("text"), P).alias("k"))
    return rows.select("conv_id", "turn", *[F.array_join(F.array_sort(f"k.{k}"), "|").alias(k) for k in P.key_patterns])


def sql_key_match(a: str, b: str) -> str:
    some = [f"(len({a}{k}) > 0 AND len({b}{k}) > 0)" for k in P.key_patterns]
    score = [f"CASE WHEN {s} THEN len(list_intersect({a}{k}, {b}{k}))::DOUBLE / (len({a}{k}) + len({b}{k}) - len(list_intersect({a}{k}, {b}{k}))) ELSE 0.0 END" for s, k in zip(some, P.key_patterns, strict=True)]
    n = " + ".join(f"{s}::INT" for s in some)
    return f"(CASE WHEN {n} = 0 THEN 1.0 ELSE ({' + '.join(score)}) / ({n}) END)"


@query(
    f"WITH k AS (SELECT conv_id, turn, {_KEYS} FROM conversations), n AS (SELECT *, "
    + ", ".join(f"lag({k}) OVER w AS b_{k}" for k in P.key_patterns)
    + f" FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, round({sql_key_match('', 'b_')}, 6) AS key_match FROM n WHERE b_event IS NOT NULL"
)
def key_entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.key_entities(F.col("text"), P).alias("k"))
    rows = rows.withColumn("b", F.lag("k").over(W.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(X.key_match(F.col("k"), F.col("b"), P), 6).alias("key_match"))


def _sql_chunks(x: str) -> str:
    norm = sql_normalize("c")
    return f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '{P.split}'), lambda c: {norm}), lambda c: c <> '')"


def _sql_class(x: str, classes, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(x, words)} THEN '{k}'" for k, words in classes) + f" ELSE '{other}' END"


def _sql_map(kind: str, boosts: dict, other: float) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in boosts.items()) + f" ELSE {other} END"


_CHUNKS = f"WITH d AS (SELECT doc_id, {_sql_chunks('text')} AS a FROM documents), c AS (SELECT doc_id, unnest(range(len(a[1:18]))) AS pos, unnest(list_transform(a[1:18], lambda x: x[1:48])) AS chunk, unnest(a[1:18]) AS whole FROM d) "


@query(_CHUNKS + "SELECT doc_id, pos, chunk FROM c")
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.chunk_rows(documents(spark, sf_dir), ["doc_id"], "text", P).select("doc_id", "pos", "chunk")


@query(
    _CHUNKS
    + f"SELECT doc_id, pos, {_sql_class('whole', P.classes, P.other_class)} AS kind, {_sql_class('whole', P.legacy_classes, P.legacy_other_class)} AS legacy_kind,"
    + f" round(0.50 + {_sql_map(_sql_class('whole', P.classes, P.other_class), P.boosts, 0.05)}, 4)::DOUBLE AS importance,"
    + f" round(greatest(0.05, least(1.0, 0.30 + least(0.30, 0.06 * {sql_hits('whole', P.critical)}) + {_sql_map(_sql_class('whole', P.legacy_classes, P.legacy_other_class), P.legacy_boosts, 0.04)})), 4)::DOUBLE AS legacy_importance FROM c"
)
def classify_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.chunk_rows(documents(spark, sf_dir), ["doc_id"], "text", P)
    rows = rows.withColumn("kind", extract.classify(F.col("whole"), P.classes, P.other_class)).withColumn("legacy_kind", extract.classify(F.col("whole"), P.legacy_classes, P.legacy_other_class))
    return rows.select("doc_id", "pos", "kind", "legacy_kind", X.importance(F.col("kind"), P).alias("importance"), X.legacy_importance(F.col("whole"), F.col("legacy_kind"), F.lit(0.0), P).alias("legacy_importance"))


def _sql_stage(x: str) -> str:
    first = f"WHEN {sql_any(x, P.day_time)} AND {sql_any(x, P.first_stage[1])} THEN '{P.first_stage[0]}'"
    return f"CASE {first} " + " ".join(f"WHEN {sql_any(x, w)} THEN '{s}'" for s, w in P.stages) + f" ELSE '{P.default_stage}' END"


@query(f"SELECT conv_id, turn, {_sql_stage('h')} AS stage FROM (SELECT conv_id, turn, array_to_string({_sql_chunks('text')}[1:5], ' ') AS h FROM conversations)")
def infer_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", extract.stage(extract.chunks(F.col("text"), P), P).alias("stage"))


def _sql_causal_of(source: str, keys: str) -> str:
    """The causal rule over source, which has h (the first 6 chunks, joined) and tail (the last chunk): keys, causal_type, body, cause, effect."""
    split_effect = f"contains(h, {quote(P.cause_word)}) AND contains(h, {quote(P.effect_word)})"
    split_condition = f"contains(h, {quote(P.condition_word)}) AND {sql_any('h', P.condition_needs)}"
    kind = "CASE " + " ".join(f"WHEN regexp_matches(h, {quote(p)}) THEN '{k}'" for p, k in P.causal_patterns) + " END"
    n = len(P.effect_word)
    cut = f"strpos(h, {quote(P.effect_word)})"
    sep = f"strpos(h, {quote(P.condition_split)})"
    return f"""SELECT {keys}, CASE WHEN how > 0 THEN k WHEN changed THEN 'state_change' ELSE 'implicit' END AS causal_type, CASE WHEN how > 0 OR changed THEN h ELSE tail END AS body,
  CASE WHEN how = 1 THEN trim(replace(h[1:{cut} - 1], {quote(P.cause_word)}, ''))[1:60] WHEN how = 2 THEN trim(replace(CASE WHEN {sep} > 0 THEN h[1:{sep} - 1] ELSE h END, {quote(P.condition_word)}, ''))[1:60] ELSE '' END AS cause,
  CASE WHEN how = 1 THEN trim(h[{cut} + {n}:])[1:60] WHEN how = 2 THEN CASE WHEN {sep} > 0 THEN trim(h[{sep} + {len(P.condition_split)}:])[1:60] ELSE '' END WHEN changed THEN tail ELSE '' END AS effect
FROM (SELECT *, CASE WHEN k IS NULL THEN 0 WHEN {split_effect} THEN 1 WHEN {split_condition} THEN 2 ELSE 0 END AS how, {sql_any('h', P.changes)} AS changed FROM (SELECT *, {kind} AS k FROM {source}))"""


_CAUSAL = _sql_causal_of(f"(SELECT conv_id, turn, array_to_string(a[1:6], ' ') AS h, coalesce(a[-1], '') AS tail FROM (SELECT conv_id, turn, {_sql_chunks('text')} AS a FROM conversations))", "conv_id, turn")


@query(f"SELECT conv_id, turn, causal_type, cause, effect FROM ({_CAUSAL})")
def causal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", extract.causal(extract.chunks(F.col("text"), P), P).alias("c")).select("conv_id", "turn", "c.causal_type", "c.cause", "c.effect")


_ORDER = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(("person", "location", "equipment", "material", "building_area", "hazard"))) + " END"


@query(
    _CHUNKS
    + f""", k AS (SELECT *, {_sql_class('whole', P.classes, P.other_class)} AS kind FROM c),
f AS (SELECT *, min_by(chunk, pos) FILTER (kind = 'location') OVER (PARTITION BY doc_id) AS place FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_ORDER}, pos) AS n FROM f WHERE kind <> 'location' AND place IS NOT NULL)
SELECT doc_id, n AS rank, chunk AS source_text, place AS target_text, 'at' AS relation_label FROM r WHERE n <= 10"""
)
def infer_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = extract.facts(documents(spark, sf_dir), ["doc_id"], "text", P)
    return extract.relations(facts, ["doc_id"], P)


@query("SELECT event_id, props AS body, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, CASE WHEN regexp_matches(event_id::VARCHAR || '.5', '^[0-9.]+$') THEN event_id + 0.5 END::DOUBLE AS time_ref FROM events")
def json_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", X.strip_fence(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).alias("body"))
    when = X.time_or(F.concat(F.col("event_id").cast("string"), F.lit(".5")), F.lit(0.0))
    return rows.select("event_id", "body", F.coalesce(F.get_json_object("body", "$.k").try_cast("long"), F.lit(-1)).alias("k"), when.alias("time_ref"))
