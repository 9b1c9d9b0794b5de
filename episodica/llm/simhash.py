"""SimHash near-duplicates found through the anchors of a covering code.

A fingerprint has 64 bits; two link when 2 or fewer differ. Then the first 31 bits or the next 31 differ in one place
at most. The anchors for either half are the words of the Hamming code of length 31, whose covering radius is 1:
every half has one anchor within 1 (its home). A fingerprint is replicated to all anchors within covering radius plus
threshold (1 + 1) of either half, 16 at most, and is compared there with the fingerprints at home. So each link is met,
and no anchor gathers more than what lies within 2 of it.

Cases: a null or empty text has no word and so fingerprint zero, which links like any other; texts of any length are
read whole, in pieces; documents with one fingerprint (ties, repeated rows) are one node of the search, never pairs; an empty
table gives an empty table; only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, materialize, per_text

HALF = 31
SHIFTS = (0, HALF)
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 19
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes that end where a word does."""
    start = 0
    while start < len(text):
        end = _GAP.search(text, start + PIECE)
        stop = end.start() if end else len(text)
        yield text[start:stop]
        start = stop


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the word shingles of a text, unsigned; 0 without words."""
    import xxhash

    ones, n, words = np.zeros(64, np.int64), 0, []

    def add(shingles) -> int:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)
        ones[:] += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        return len(hashes)

    for piece in _pieces((text or "").encode("utf-8", "surrogatepass")):
        words = words[len(words) - min(size - 1, len(words)) :] + piece.lower().split()  # bytes: only A-Z, only ASCII white space
        n += add(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
    if not n and words:
        n = add([b" ".join(words)])
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with __fp, the fingerprint as a signed long."""

    def make():
        return lambda texts: [[x - (1 << 64) if x >> 63 else x for x in map(fingerprint, texts)]]

    return per_text(docs, text, [T.StructField("__fp", T.LongType())], make, keep)


def _half(fp: Column, shift: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << HALF) - 1))


def _syndrome(half: Column) -> Column:
    """The Hamming code's syndrome: the exclusive or of the places (1 to 31) of the bits that are set."""
    bits = []
    for k in range(5):
        mask = sum(1 << (place - 1) for place in range(1, HALF + 1) if place >> k & 1)
        bits.append(F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)), k))
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def anchors(fps: DataFrame, replicas: bool) -> DataFrame:
    """(__fp, part, anchor): the home anchor of either half, or all anchors within 2 of it."""
    rows = fps.select("__fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), _half(F.col("__fp"), s).alias("half")) for i, s in enumerate(SHIFTS)])).alias("x"))
    rows = rows.select("__fp", "x.part", "x.half", _syndrome(F.col("x.half")).alias("s"))
    home = "IF(s = 0, half, half ^ shiftleft(1L, s - 1))"
    if not replicas:
        return rows.select("__fp", "part", F.expr(home).alias("anchor"))
    pairs = f"IF(s = 0, array(), transform(filter(sequence(1, {HALF}), i -> i < (i ^ s) ), i -> half ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1)))"
    return rows.select("__fp", "part", F.explode(F.expr(f"array_append({pairs}, {home})")).alias("anchor"))


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Pairs (x < y) of distinct fingerprints that differ in at most 2 bits; a pair can come more than once."""
    if threshold > 2:
        raise ValueError("two halves prove a threshold of 2 at most")
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= threshold
    home = anchors(fps, False).withColumnRenamed("__fp", "x")
    other = anchors(fps, True).withColumnRenamed("__fp", "y")
    return home.join(other, (home.part == other.part) & (home.anchor == other.anchor) & (F.col("x") < F.col("y")) & near).select("x", "y")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hex digits and the smallest doc_id reachable by links."""
    rows = materialize(fingerprints(docs, text, [doc_id]))
    fps = materialize(rows.groupBy("__fp").agg(F.min(doc_id).alias("__least")))
    found = components(links(fps.select("__fp")).select(F.col("x").alias("a"), F.col("y").alias("b")))
    # components() names a component by a fingerprint; the smallest doc_id of it is what is asked for
    named = fps.join(found, fps["__fp"] == found["id"], "left").select("__fp", "__least", F.coalesce("component", "__fp").alias("__root"))
    least = named.groupBy("__root").agg(F.min("__least").alias("component_id"))
    of = named.join(least, "__root").select(F.col("__fp").alias("__key"), "component_id")
    return rows.join(of, rows["__fp"] == of["__key"]).select(doc_id, F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those whose component has a smaller doc_id; of rows with one doc_id that stays, all stay."""
    verdict = near_duplicates(docs, doc_id, text).where(F.col(doc_id).eqNullSafe(F.col("component_id"))).select(F.col(doc_id).alias("__id")).distinct()
    return docs.join(verdict, docs[doc_id].eqNullSafe(verdict["__id"]), "left_semi")
