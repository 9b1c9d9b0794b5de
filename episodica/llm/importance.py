"""Target-distribution importance resampling over hashed word runs.

Features are runs of 1 to 3 words; a feature's bucket is its CRC-32 modulo the number of buckets. CRC-32 is linear up to
a constant of the length: the checksum of a span is the XOR of what each of its bytes adds, which depends on the byte
and its distance from the span's end only, and of the checksum of as many zero bytes. A table holds what each byte adds
at each distance, so the checksums of a batch's spans are one gather and one bitwise_xor.reduceat. A span beyond the
table's reach is cut into blocks of that reach, whose values fold in pairs, each the left one moved on by a power of two.

Counts by bucket of all documents and of the target's texts give each bucket's gain; a document's weight is the sum over
its features, its score that plus Gumbel noise from its id, and the highest scores of those that are long enough are drawn.

Only counts by bucket (one row a bucket) reach the driver, to go out as the array of gains. Ranks come from a range
partitioning by score and a count for each partition; no task sorts more than its share.

Cases: a null or empty text has no features, weight 0 and its noise as score; a null id counts as an empty one in the
noise and comes last among ties; rows equal in id and result are counted and take ranks side by side; an empty target
gives gains against no counts; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import expanded, held, materialize, offsets, per_text, slices, small_batches, tidy

BUCKETS, RUN, MIN_WORDS, PERCENT = 10_000, 3, 20, 5
#: Distances from a span's end that the table holds, as a power of two.
REACH_BITS = 6
REACH = 1 << REACH_BITS
#: Bytes of words whose spans are worked through at once.
PIECE = 1 << 17
#: Rows that a task ranks.
ROWS = 200_000

WORD = np.ones(256, bool)
for low, high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    WORD[low : high + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Checksums:
    """CRC-32 of many spans of a buffer at once."""

    def __init__(self):
        steps = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1).astype(np.uint32)
        #: What a byte adds at a distance from the end, by distance and byte.
        self.adds = np.empty((REACH, 256), np.uint32)
        self.adds[0] = steps
        for d in range(1, REACH):
            self.adds[d] = steps[self.adds[d - 1] & 255] ^ (self.adds[d - 1] >> 8)
        self.flat = self.adds.ravel()
        self.zeros = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)
        #: By power of two: what each byte of a register becomes after so many zero bytes.
        self.moves = [np.stack([self.adds[REACH - 1 - j] for j in range(4)])]

    def _move(self, power: int) -> np.ndarray:
        while len(self.moves) <= power:
            last = self.moves[-1]
            self.moves.append(np.stack([self._moved(row, last) for row in last]))
        return self.moves[power]

    @staticmethod
    def _moved(registers: np.ndarray, move: np.ndarray) -> np.ndarray:
        out = move[0][registers & 255]
        for j in range(1, 4):
            out = out ^ move[j][registers >> (8 * j) & 255]
        return out

    def short(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The XOR of what the bytes of each span add; 1 to REACH bytes a span."""
        offsets = np.zeros(len(lengths), np.int32)
        np.cumsum(lengths[:-1], out=offsets[1:])
        at = np.arange(int(lengths.sum()), dtype=np.int32)
        data = buffer[at + np.repeat(starts - offsets, lengths)]
        distance = np.repeat(offsets + lengths - 1, lengths) - at
        return np.bitwise_xor.reduceat(self.flat[(distance << 8) | data], offsets)

    def long(self, buffer: np.ndarray, start: int, length: int) -> int:
        """The checksum of one span beyond the table's reach."""
        first = (length - 1) % REACH + 1
        values = np.empty((length - first) // REACH + 1, np.uint32)
        values[:1] = self.short(buffer, np.array([start], np.int32), np.array([first], np.int32))
        for low in range(1, len(values), PIECE // REACH):
            n = min(PIECE // REACH, len(values) - low)
            begin = start + first + (low - 1) * REACH
            values[low : low + n] = self.short(buffer[begin : begin + n * REACH], np.arange(n, dtype=np.int32) * REACH, np.full(n, REACH, np.int32))
        # the register starts as all ones, which the constant of the first block's length accounts for but for the last inversion
        values[0] ^= self.zeros[first] ^ np.uint32(0xFFFFFFFF)
        power = 0
        while len(values) > 1:
            if len(values) % 2:
                values = np.concatenate([np.zeros(1, np.uint32), values])
            values, power = self._moved(values[0::2], self._move(power)) ^ values[1::2], power + 1
        return int(values[0]) ^ 0xFFFFFFFF

    def spans(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        within = lengths <= REACH
        if within.all():
            return self.short(buffer, starts, lengths) ^ self.zeros[lengths]
        out = np.empty(len(starts), np.uint32)
        if within.any():
            out[within] = self.short(buffer, starts[within], lengths[within]) ^ self.zeros[lengths[within]]
        for i in np.flatnonzero(~within):
            out[i] = self.long(buffer, int(starts[i]), int(lengths[i]))
        return out


def runs(checksums: Checksums, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the text, checksum) of each feature of texts, in arrays, some at a time."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends_of = np.cumsum([len(p) for p in parts], dtype=np.int64)
    data = LOWER[np.frombuffer(b"".join(parts), np.uint8)]
    del parts
    if not len(data):
        return
    inside = WORD[data]
    # a word neither begins before its text nor ends after it
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    heads = np.concatenate([[0], ends_of[:-1]])
    heads = heads[heads < len(data)]
    opens[heads] = inside[heads]
    tails = ends_of[ends_of > 0] - 1
    closes[tails] = inside[tails]
    starts, lengths = np.flatnonzero(opens).astype(np.int32), np.flatnonzero(closes).astype(np.int32) + 1
    del opens, closes
    lengths -= starts
    n = len(starts)
    if not n:
        return
    of = np.searchsorted(ends_of, starts, "right").astype(np.int32)
    # all words in a row, one space after each
    at = np.zeros(n, np.int32)
    np.cumsum(lengths[:-1] + 1, out=at[1:])
    buffer = np.full(int(at[-1]) + int(lengths[-1]) + 1, ord(" "), np.uint8)
    buffer[np.arange(int(lengths.sum()), dtype=np.int32) + np.repeat(np.arange(n, dtype=np.int32), lengths)] = data[inside]
    del data, inside
    cuts = np.unique(np.concatenate([np.searchsorted(at, np.arange(0, len(buffer), PIECE)), [n]]))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        for k in range(RUN):
            first = np.arange(low, min(high, n - k), dtype=np.int32)
            first = first[of[first] == of[first + k]]
            if len(first):
                yield of[first], checksums.spans(buffer, at[first], at[first + k] + lengths[first + k] - at[first])


def bucket_counts(df: DataFrame, text: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket, repeats counted."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checksums, total = held(("checksums",), Checksums), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for _, sums in runs(checksums, part.column(0).to_pylist()):
                    total += np.bincount(sums % np.uint32(buckets), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["bucket", "n"])
        tidy()

    counts = df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, text: str, target_text: str, buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket adds to a weight, in thousandths of a natural logarithm; one number a bucket."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, df, column in ((s, raw, text), (t, target, target_text)):
        for bucket, n in bucket_counts(df, column, buckets).collect():  # one row a bucket at most
            counts[bucket] = n
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weights(gain: np.ndarray) -> Callable[[], Callable]:
    def make():
        checksums, buckets = held(("checksums",), Checksums), np.uint32(len(gain))

        def compute(texts: list[str | None]) -> list[np.ndarray]:
            n, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for of, sums in runs(checksums, texts):
                # a text's features lie together
                heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                here = of[heads]
                weight[here] += np.add.reduceat(gain[sums % buckets], heads)
                n[here] += np.diff(np.concatenate([heads, [len(of)]]))
            return [n, weight]

        return compute

    return make


def ranked(rows: DataFrame, order: list, copies: str) -> DataFrame:
    """rows with __first: how many rows, each counted copies times, come before in the order of the whole table."""
    n = max(1, -(-rows.count() // ROWS))
    rows = materialize(rows.repartitionByRange(n, *order).withColumn("__bucket", F.spark_partition_id()))
    before = offsets(rows, [], {"n": F.col(copies)}).select(F.col("__bucket").alias("__b"), "__before_n")
    here = W.partitionBy("__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(before), rows["__bucket"] == before["__b"])  # one row a bucket of ROWS rows
    return rows.withColumn("__first", F.col("__before_n") + F.coalesce(F.sum(copies).over(here), F.lit(0))).drop("__bucket", "__b", "__before_n")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): each document, the drawn ones with their rank from 1."""
    gain = gains(docs, target, text, target_text)
    fields = [T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())]
    rows = per_text(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", fields, _weights(gain), ["doc_id"])
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))
    rows = rows.withColumn("score", (F.col("weight") + noise).cast("long"))
    # w words have 3 w - 3 features from two words on
    long_enough = F.col("n_features") >= RUN * MIN_WORDS - RUN * (RUN - 1) // 2
    rows = materialize(rows.groupBy("doc_id", "n_features", "weight", "score").agg(F.count("*").alias("__n")).withColumn("__in", long_enough))
    drawn = percent * (rows.where("__in").agg(F.sum("__n")).first()[0] or 0) // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = ranked(rows.where("__in"), order, "__n")
    rows = placed.unionByName(rows.where(~F.col("__in")).withColumn("__first", F.lit(None).cast("long")))
    rows = expanded(rows, "__n", "__copy")
    place = F.col("__first") + F.col("__copy") + 1
    return rows.select("doc_id", "n_features", "weight", "score", F.when(place <= drawn, place).cast("long").alias("rank"))
