"""One query for each operator, over its whole table with production parameters, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, filter_audit, importance, lang_id, media, mixing, multi_index, secrets, sharding, simhash, token_counts, vector_dedup
from .common import materialize, read

#: The vocabularies that the queries use; both are parameters of the operators.
RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # three layouts of record: prompts for users, system records, messages for all else; and an instruction record
    role, text = F.col("role"), F.col("text")
    message = chat_format.json_of(messages=F.array(F.struct(role.alias("role"), text.alias("content"))))
    prompt = chat_format.json_of(prompt=F.struct(text.alias("text")))
    record = F.when(role == "user", prompt).when(role == "system", chat_format.json_of(system=text)).otherwise(message)
    ok = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), chat_format.json_of(instruction=ok, output=ok).alias("record"))
    records = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), record.alias("record")).unionByName(extra)
    return chat_format.digests(chat_format.format_records(records, roles={}))


def op2_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = lang_id.identify(docs, keep=["doc_id"])
    return out.select("doc_id", lang_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=["doc_id"])


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=["doc_id"])


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(read(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan(docs, read(spark, sf_dir, "labels").select("doc_id", "quality")).select("doc_id", "size", "source_size", "target", "taken")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents").select("doc_id", "text"), 40, base=40)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), keep=["doc_id"])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(materialize(filter_audit.cells(docs, read(spark, sf_dir, "labels"))))


def op12_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, read(spark, sf_dir, "benchmark").select("text"))


_ALL = (op1_chat_format, op2_lang_id, op3_secrets, op4_byte_bpe, op5_vector_dedup, op6_media, op7_mixing, op8_sharding, op9_token_counts, op10_simhash)
_ALL += (op11_filter_audit, op12_ann_search, op13_importance_resampling)
QUERIES = {f.__name__: f for f in _ALL}

#: The same rules in plain SQL: all draws come from md5, which both engines have.
OP7_SQL = r"""
WITH labelled AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / CASE WHEN l.quality >= 1 THEN 2.0 WHEN l.quality < 1 THEN 0.5 ELSE 1.0 END AS key
  FROM documents d LEFT JOIN labelled l ON d.doc_id = l.doc_id),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * source_size / weight::DOUBLE AS ratio,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM by_source),
chosen AS (SELECT max(level) AS level FROM levels WHERE ratio = (SELECT min(ratio) FROM levels WHERE level <= ratio)),
aims AS (SELECT l.source, l.source_size, least((3 * l.source_size)::DOUBLE, c.level * l.weight) AS target FROM levels l, chosen c),
reached AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, round(a.target)::BIGINT AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS reach
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(size, greatest(0, budget % source_size - reach)) END::BIGINT AS taken
FROM reached
"""

#: The five filters as bits, the cells of part and mask, and the prefixes by recursion.
OP11_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
least AS (SELECT text, min(doc_id) AS least FROM split GROUP BY text),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masked AS (
  SELECT s.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    (len(s.words) < 50)::INT + 2 * (100 * len(list_distinct(s.words)) < 65 * len(s.words))::INT
    + 4 * (100 * len(regexp_replace(s.text, '[^A-Z]', '', 'g')) > 5 * len(s.text))::INT
    + 8 * regexp_matches(s.text, '[#$%&*|]')::INT + 16 * coalesce(s.doc_id > l.least, false)::INT AS mask
  FROM split s JOIN least l ON s.text = l.text LEFT JOIN marks m ON s.doc_id = m.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
grown AS (
  SELECT '' AS prefix, 0 AS step, 0 AS applied, 0 AS before, 0 AS bit
  UNION ALL
  SELECT g.prefix || l.letter, g.step + 1, g.applied | l.bit, g.applied, l.bit FROM grown g JOIN letters l ON g.applied & l.bit = 0),
found AS (
  SELECT c.part, g.prefix, g.step,
    sum(CASE WHEN c.mask & g.applied = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN c.mask & g.bit > 0 AND c.mask & g.before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN c.mask & g.bit > 0 AND c.mask & g.before > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN c.mask = g.bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN c.mask & g.bit > 0 AND c.mask & g.before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN c.mask & g.bit > 0 AND c.mask & g.before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM grown g, cells c WHERE g.step > 0 GROUP BY c.part, g.prefix, g.step),
orders AS (SELECT prefix AS filter_order, unnest(range(1, 6)) AS at FROM grown WHERE step = 5),
placed AS (SELECT f.part, o.filter_order, f.step, substr(o.filter_order, o.at, 1) AS letter, f.* EXCLUDE (part, step, prefix) FROM orders o JOIN found f ON f.prefix = o.filter_order[:o.at])
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM placed
"""

ORACLE_SQL = {"op7_mixing": OP7_SQL, "op11_filter_audit": OP11_SQL}
