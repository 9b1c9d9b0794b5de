"""Queries for snapshots, exports, rankings, traces and the hooks' defaults."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import events, hooks, report, resolve, retrieve
from ..profile import ASCII as P
from ..sources import scratch
from ..sources import tables as S
from .adapters import TURNS, sql_overlap, sql_tokens, table, turns
from .graph_memory import _LOCAL
from .memory_queries import _ASKED, _EVENTS, _NODES, _SPANS, asked, at_the_question, earlier, entity_nodes, span_events, spans
from .registry import query
from .text_queries import STOP
from .vector_queries import sql_embedding


@query(f"WITH {TURNS} SELECT id, question, answer, text, ts, valid, CASE WHEN ord > 2 THEN 'buffered' ELSE 'assigned' END AS status, CASE WHEN ord <= 2 THEN memory_id END AS event_id, trim(regexp_replace(question || ' ' || answer || ' ', '[\\t-\\r\\x1c-\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))[1:120] AS local_summary, '' AS candidate_node_ids, '' AS image_paths, '' AS visual_description, 'text' AS modality, 0.0::DOUBLE AS saliency_score FROM turns WHERE valid ORDER BY ts, id")
def valid_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid turns that wait for an event, or have one, as the snapshot shows them: fourteen columns."""
    t = turns(spark, sf_dir).withColumn("status", F.when(~F.col("valid"), "rejected").when(F.col("ord") > 2, "buffered").otherwise("assigned"))
    none, empty = F.lit(""), X.none()
    t = t.withColumns({"event_id": F.when(F.col("ord") <= 2, F.col("memory_id")), "local_summary": X.local_summary(F.col("question"), F.col("answer"), none), "candidate_node_ids": F.array_join(empty, "|"), "image_paths": F.array_join(empty, "|"), "visual_description": X.visual_text(empty, none, P), "modality": X.modality(empty, none), "saliency_score": F.lit(0.0)})
    return report.turn_snapshot(report.buffered(t)).orderBy("ts", "id")


_COSINES = f"{_ASKED}, rk AS (SELECT *, round(coalesce(c.cos, 0), 4) AS semantic, round({sql_overlap('qt', 'nt')}, 4) AS lexical, round(0.7 * greatest(coalesce(c.cos, 0), 0) + 0.3 * {sql_overlap('qt', 'nt')}, 4) AS combined FROM pairs p LEFT JOIN cs c USING (query_id, node_id))"


@query(
    _COSINES
    + f""", o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, ord) AS rank FROM rk)
SELECT query_id, node_id, rank, semantic, lexical, combined, array_to_string(list_sort(list_filter(list_intersect(qt, nt), lambda x: length(x) > 1 AND NOT list_contains({STOP}, x)))[1:6], '|') AS shared, contains(t.text, 'thing') AS has_term FROM o JOIN turns t ON t.id = node_id WHERE rank <= 10"""
)
def ranking_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten likest earlier turns of each question, with their common terms, and which of them hold a term."""
    q, n = asked(spark, sf_dir)
    out = report.ranking(q, n, P, where=earlier)
    held = n.select(F.col("id").alias("node_id"), F.contains("text", F.lit("thing")).alias("has_term"))
    return out.withColumn("shared", F.array_join("shared", "|")).join(held, "node_id")


#: JSON fields stand for classes here.
_RAW = "'```json {\"entities\": {\"ing\": [\" ' || event_type || ' \", \"\", \"x\"], \"zzz\": [\"y\"]}, \"temporal\": ' || CASE WHEN event_id % 3 = 0 THEN '[{\"stage_name\": \"a\"}, {\"stage_name\": \"b\"}]' ELSE '{\"stage_name\": \"c\", \"summary\": \"s\"}' END || ', \"causal\": [{\"cause\": \"p\", \"effect\": \"' || CASE WHEN event_id % 5 = 0 THEN '' ELSE 'q' END || '\"}], \"candidates\": {\"person\": [\"m\"], \"zzz\": [\"' || event_type || '\"]}, \"relations\": [{\"source_text\": \"a\", \"target_text\": \"' || CASE WHEN event_id % 2 = 0 THEN 'b' ELSE ' ' END || '\"}]} ```'"


@query(
    """SELECT event_id, 'ing=' || event_type || ',ing=x' AS entities, CASE WHEN event_id % 3 = 0 THEN 'a,b' ELSE 'c' END AS stages, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'p>q' END AS causes, CASE WHEN event_id % 2 = 0 THEN 'a-at-b' ELSE '' END AS relations,
'person=m,status=' || event_type AS candidates, CASE WHEN event_id % 2 = 0 THEN 'a-RELATES_TO-b' ELSE '' END AS legacy_relations FROM events"""
)
def extraction_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's JSON in both forms; causal items need both sides."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_RAW).alias("raw"))
    out = rows.select("event_id", hooks.extract_json(F.col("raw"), P).alias("x"), hooks.legacy_extract_json(F.col("raw"), P).alias("y"))

    def pairs(column: str):
        return F.array_join(F.transform(column, lambda e: F.concat_ws("=", e["kind"], e["name"])), ",")

    def triples(column: str):
        return F.array_join(F.transform(column, lambda r: F.concat_ws("-", r["source_text"], r["relation_label"], r["target_text"])), ",")

    causes = F.transform(F.filter("x.causal", lambda c: (c["cause"] != "") & (c["effect"] != "")), lambda c: F.concat_ws(">", c["cause"], c["effect"]))
    stages = F.transform("x.temporal", lambda t: t["stage_name"])
    return out.select("event_id", pairs("x.entities").alias("entities"), F.array_join(stages, ",").alias("stages"), F.array_join(causes, ",").alias("causes"), triples("x.relations").alias("relations"), pairs("y.candidates").alias("candidates"), triples("y.relations").alias("legacy_relations"))


@query("SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations")
def loaded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table, read with the schema that it should have."""
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return S.load(spark, f"{sf_dir}/conversations.parquet", schema).withColumn("text", F.coalesce("text", F.lit("")))


@query("SELECT user_id AS memory_id, event_id AS source, next AS target FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NOT NULL")
def state_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of a state document that was written and is read back."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("memory_id"), F.col("event_id").alias("source"), F.lead("event_id").over(w).alias("target")).where("target IS NOT NULL")
    doc, path = S.state_document({"temporal": e}), f"{scratch.shared_dir(spark)}/state-{uuid.uuid4().hex}"
    S.write_state(doc, path)
    return S.read_state(spark, path, doc.schema, "temporal")


@query(_ASKED + ", al AS (SELECT t.id AS query_id, coalesce(array_to_string((list(n.text ORDER BY r.rank) FILTER (r.rank <= 3)), '; '), '') AS found FROM turns t LEFT JOIN ranked r ON r.query_id = t.id AND r.rank <= 3 LEFT JOIN turns n ON n.id = r.node_id WHERE t.valid GROUP BY t.id) SELECT query_id, CASE WHEN found = '' THEN 'Nothing known.' ELSE 'Known: ' || found END AS answer FROM al")
def replayed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of questions in order: each is answered from the turns that came before it."""
    q, n = asked(spark, sf_dir)
    hits = retrieve.entries(retrieve.search(q, n, score=at_the_question, where=earlier, numbers=([], ["importance"])))
    lines = hits.join(n.select(F.col("id").alias("node_id"), "text"), "node_id").select("query_id", F.lit(1).alias("section"), F.col("rank").alias("place"), F.col("text").alias("line"))
    found = q.select(F.col("id").alias("query_id")).join(retrieve.context(lines), "query_id", "left").withColumn("lines", F.coalesce("lines", X.none()))
    return hooks.answer(found, None, "Known: ", "Nothing known.", "; ").select("query_id", "answer")


_FUSED = f"WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS x, {sql_tokens('text')} AS k FROM conversations), n AS (SELECT *, lag(x) OVER w AS px, lag(k) OVER w AS pk FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


def _fused(spark: SparkSession, sf_dir: str, alike: float) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("x")).withColumn("k", X.token_set(F.col("x")))
    t = t.withColumn("px", F.lag("x").over(w)).withColumn("pk", F.lag("k").over(w)).where("px IS NOT NULL")
    return t.select("conv_id", "turn", X.fuse(F.col("px"), F.col("x"), X.overlap(F.col("k"), F.col("pk")), P, alike=alike).alias("fused"), X.fuse(F.col("px"), F.col("x"), F.lit(0.0), P).alias("appended"))


@query(_FUSED + f" SELECT conv_id, turn, CASE WHEN {sql_overlap('list_distinct(k)', 'list_distinct(pk)')} > 0.7 THEN px ELSE (px || '; ' || x)[1:240] END AS fused, (px || '; ' || x)[1:240] AS appended FROM n WHERE px IS NOT NULL")
def fuse_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's text fused with the one before it."""
    return _fused(spark, sf_dir, 0.70)


@query(_FUSED + f" SELECT conv_id, turn, CASE WHEN {sql_overlap('list_distinct(k)', 'list_distinct(pk)')} > 0.2 THEN px ELSE (px || '; ' || x)[1:240] END AS fused, (px || '; ' || x)[1:240] AS appended FROM n WHERE px IS NOT NULL")
def fuse_pairs_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at an overlap that invented prose reaches."""
    return _fused(spark, sf_dir, 0.2)


@query(_NODES + ", old AS (SELECT DISTINCT event_id, kind, lower(name) AS name FROM nodes WHERE turn = 0) SELECT id FROM nodes n WHERE turn > 0 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.event_id = n.event_id AND o.kind = n.kind AND o.name = lower(n.name))")
def new_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = entity_nodes(spark, sf_dir).select("event_id", "kind", "id", "name", "turn")
    return resolve.new_names(n.where("turn > 0"), n.where("turn = 0"), ["event_id", "kind"], "name").select("id")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts, event_id) AS n FROM events) WHERE n = 1")
def first_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup of a name over types in a fixed order: the first type's first node."""
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    best = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by(F.struct("event_type", "event_id"), F.struct(rank, "ts", "event_id")).alias("b"))
    return best.select("user_id", "b.event_type", "b.event_id")


@query(
    f"""WITH {TURNS}, {_SPANS}, {_EVENTS}, tk AS (SELECT g.event_id, g.id, {sql_tokens('g.text')} AS k FROM g), ids AS (SELECT id, k FROM tk UNION ALL SELECT event_id AS id, k FROM ev), v AS ({sql_embedding('ids', 'id', 'k')}),
cs AS (SELECT t.id, sum(a.w * b.w) AS cos FROM tk t JOIN v a ON a.id = t.id JOIN v b ON b.id = t.event_id AND a.idx = b.idx GROUP BY ALL), s AS (SELECT g.*, coalesce(cos, 0) AS cos, row_number() OVER (PARTITION BY event_id ORDER BY ord DESC) AS back FROM g LEFT JOIN cs USING (id))
SELECT event_id, count(*) AS turns, max(ts) AS last_hit, least(1.0, round(0.5 + 0.05 * count(*), 6))::DOUBLE AS survival, array_to_string(list(id ORDER BY ord) FILTER (back <= 8), '|') AS recent, round(avg(cos) FILTER (back <= 8), 6) AS consistency FROM s GROUP BY ALL"""
)
def assigned_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What assigning its turns does to an event."""
    s = spans(spark, sf_dir)
    t = s.select("event_id", "id", "ord", "ts", X.tokens(F.col("text")).alias("k"), F.lit("").alias("visual"))
    e = span_events(s).withColumn("survival", F.lit(0.5))
    out = events.assigned(t, e, P)
    return out.select("event_id", "turns", "last_hit", F.round("survival", 6).alias("survival"), F.array_join("recent", "|").alias("recent"), F.round("consistency", 6).alias("consistency"))


def stub(inputs: list[str], fails: dict[str, int]):
    """A model for tests and counts: the first 40 characters of the inputs, with a mark; those whose md5 begins with a digit of fails raise so often first."""
    asked: dict[str, int] = {}

    def model(records: list[dict]) -> list[str]:
        out = []
        for r in records:
            text = "|".join(r[c] for c in inputs)
            digest = hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()
            asked[digest] = asked.get(digest, 0) + 1
            if asked[digest] <= fails.get(digest[0], 0):
                raise RuntimeError("no answer")
            out.append(text[:40] + "!")
        return out

    return model


_ANSWERED = "CASE WHEN md5({0})[1] = '0' THEN {1} ELSE {0}[1:40] || '!' END AS summary, CASE WHEN md5({0})[1] = '0' THEN 3 WHEN md5({0})[1] IN ('1', '2') THEN 2 ELSE 1 END AS tries"


@query(
    f"{_FUSED.replace('WITH t AS', f'WITH {TURNS}, t AS', 1)}, hq AS (SELECT id, question || '|' || answer AS x, {_LOCAL} AS local FROM turns WHERE valid), "
    + f"hn AS (SELECT conv_id || ':' || turn AS id, px || '|' || x AS x, CASE WHEN {sql_overlap('list_distinct(k)', 'list_distinct(pk)')} > 0.7 THEN px ELSE (px || '; ' || x)[1:240] END AS fused FROM n WHERE px IS NOT NULL) "
    + f"SELECT 'turn' AS method, id, {_ANSWERED.format('x', 'local')} FROM hq UNION ALL SELECT 'fuse_entity', id, {_ANSWERED.format('x', 'fused')} FROM hn"
)
def hooked_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the summariser's methods by a stub model that fails at times: each distinct input is asked for once, alone and up to three times, and the rule answers where that fails."""
    fails = {"0": 3, "1": 1, "2": 1}
    t = turns(spark, sf_dir).where("valid").select("id", "question", "answer", F.lit("").alias("visual"))
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("new"))
    c = c.withColumn("previous", F.lag("new").over(w)).where("previous IS NOT NULL")
    made = [hooks.summarise(d, m, P, stub(of, fails), batch=1).select(F.lit(m).alias("method"), "id", "summary", F.col("summary_tries").alias("tries")) for d, m, of in ((t, "turn", ["question", "answer"]), (c, "fuse_entity", ["previous", "new"]))]
    return made[0].unionByName(made[1])
