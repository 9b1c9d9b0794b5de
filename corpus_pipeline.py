"""The corpus pipeline: documents through five of the operators, each stage on all that the one before kept.

Cases, for every stage: an empty table gives an empty table; null and empty texts, very long ones, repeated rows and null
ids are rows like any other, except as a stage says; columns that documents don't have come through unchanged, whatever
their names, and only the last stage returns columns of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import byte_bpe, lang_id, mixing, secrets, simhash
from episodica.llm.common import discard, materialize, read, written
from episodica.llm.queries import RANKS


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, ambiguous ones too; a null lang becomes the one found, und where none was learned. A null or empty text goes."""
    model = lang_id.fit(lang_id.sample(docs, "doc_id", "text", "lang", lang_id.DOCS_PER_LANG))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text").alias("__body"))
    found = lang_id.predict(rows, model, "__body", ["__row"])
    # und is a text without a letter, unless nothing was learned or a language is named so
    told = model.langs and "und" not in model.langs
    if told:
        found = found.where("lang_pred <> 'und'")
    else:
        found = lang_id.with_letter(found.withColumn("__body", F.col("__row.text")), "__body")
    return found.select(*[(F.coalesce("__row.lang", "lang_pred") if c == "lang" else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near-duplicates; rows that share a doc_id that stays, all stay, and rows without one are of one doc_id."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mark; n_chars follows the text; a null text stays null."""
    clean = secrets.redact(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one without words comes once an epoch of its source. A null source is a source."""
    return mixing.apply_mix(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded documents; a null or empty text has no tokens."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=["doc_id", "source", "lang"])


STAGES = [("language ID", language), ("SimHash near-dedup", near_dedup), ("secret scans", secret_scan), ("mixing", mix), ("byte-level BPE", encode)]

#: SQL has neither the classifiers nor the hashes of the first stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), written(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
            # only the last table is read from here on
            discard(spark, [p for p in written(spark)[:-1] if p not in before])
    return docs
