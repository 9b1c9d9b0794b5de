"""Language ID by error-correcting output codes over character n-grams.

Each language has a codeword; for each bit a binary naive Bayes classifier over hashed character bigrams and trigrams
says how far a text's n-grams speak for 1. Decoding weighs each bit's logistic loss by how well that bit's classifier
did on training texts of the codeword's language, and takes the codeword of least loss; where the second is nearly as
near, the text is flagged as ambiguous.

The classifiers are fitted on a bounded sample (docs_per_lang, chosen by a hash of id and text, of the MOST_LANGS
languages with most documents); all texts are predicted, whole and each for itself. What reaches the driver are n-gram
counts: MOST_LANGS times 2**BITS numbers at most.

Cases: a null text, or one without a letter, is "und" with score 0 and not ambiguous; rows without a language are not
learned from; a null id is in training; without any labelled row every text is "und"; with one language every text with a letter is of it;
ties go to the language first in code-point order; repeated rows count and are predicted each; an empty table gives an
empty table; other columns stay out of the prediction, and those named as a result are replaced; a long text is read in
pieces, so its memory is its own and that of a piece.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_text, slices, small_batches

BITS = 15
SIZE = 1 << BITS
#: Labelled documents a language that the classifiers are fitted on, as expected over the hash of the ids.
DOCS_PER_LANG = 2000
#: Least share of the second-best codeword's loss by which the best must be better.
AMBIGUOUS = 0.1
#: Languages that are learned at most: those with most documents in training.
MOST_LANGS = 256
#: Characters that one step of the arithmetic handles.
PIECE = 1 << 17
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str], before: tuple[bool, int, int] | None = None, ends: bool = True) -> tuple[np.ndarray, np.ndarray, tuple[bool, int, int]]:
    """The hashed n-grams of the texts, one after another, how many each text has, and what the next piece of the last one takes as before.

    All but letters counts as one space, after a letter only; two spaces stand before a text. before: for a piece of one
    text, whether a letter precedes it and the last two characters that count; ends: whether the texts end there."""
    lowered = [t.lower() for t in texts]
    mark = "\0" if ends else ""
    points = np.frombuffer((mark.join(lowered) + mark).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) + len(mark) for t in lowered], np.int64)
    word = letters()[points]
    near = word.copy()
    near[1:] |= word[:-1]  # a letter, or what follows one
    after, last, second = before or (False, 0, 0)
    if after and len(near):
        near[0] = True
    chars = np.where(word, points, 0)[near].astype(np.uint32)
    so_far = np.concatenate([[0], np.cumsum(near)])[np.concatenate([[0], np.cumsum(sizes)])]
    counts = np.diff(so_far)
    b, a = np.zeros_like(chars), np.zeros_like(chars)
    b[1:], a[2:] = chars[:-1], chars[:-2]
    first = so_far[:-1][counts > 0]
    b[first], a[first] = last, second
    a[so_far[:-1][counts > 1] + 1] = last
    two = (b * np.uint32(0x9E3779B1) + chars * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
    three = (a * np.uint32(0xC2B2AE35) + b * np.uint32(0x27D4EB2F) + chars * np.uint32(0x165667B1)) >> np.uint32(32 - BITS)
    both = np.concatenate([[second, last], chars[-2:]])[-2:]
    return np.stack([two, three], 1).ravel().astype(np.int32), 2 * counts, (bool(word[-1]) if len(word) else after, int(both[1]), int(both[0]))


def steps(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(places, hashed n-grams, how many each place has) of the texts, PIECE characters at a time; a longer text comes in several steps."""
    run, size = [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if size + len(text) > PIECE and run:
            yield (run, *grams([texts[j] or "" for j in run])[:2])
            run, size = [], 0
        if len(text) <= PIECE:
            run.append(i)
            size += len(text)
            continue
        before = None
        for start in range(0, len(text), PIECE):
            hashed, counts, before = grams([text[start : start + PIECE]], before, start + PIECE >= len(text))
            yield [i], hashed, counts
    if run:
        yield (run, *grams([texts[j] or "" for j in run])[:2])


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1: all splits of up to 5 languages, else the random code of largest least distance out of 300."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        return np.array([[1 if (k >> i) & 1 else -1 for k in range(1, 1 << (n - 1))] for i in range(n)], np.int8)
    rng, width = np.random.default_rng(7), 15 + 4 * int(np.ceil(np.log2(n)))
    best, far = None, -1
    for _ in range(300):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        apart = (width - code.astype(int) @ code.T) // 2 + width * np.eye(n, dtype=int)
        if apart.min() > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, apart.min()
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # n-grams x bits: log odds of 1
    trust: np.ndarray  # languages x bits, rows sum to 1
    sharpness: float = 4.0

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """Each bit's mean log odds over a text's n-grams; nan without a letter."""
        sums, seen = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts))
        for places, hashed, counts in steps(texts):
            some = counts > 0
            rows, cuts = np.array(places)[some], (np.cumsum(counts) - counts)[some]
            if len(rows):
                sums[rows] += np.add.reduceat(self.weights[hashed], cuts, axis=0, dtype=np.float64)
                seen[rows] += counts[some]
        return np.where(seen[:, None] > 0, sums / np.maximum(seen, 1)[:, None], np.nan)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        z = np.clip(self.sharpness * self.margins(texts), -30, 30)
        known = ~np.isnan(z[:, 0])
        loss = np.einsum("lb,nlb->nl", self.trust, np.log1p(np.exp(-self.code[None] * np.nan_to_num(z)[:, None, :])))
        best = loss.argmin(1)
        if len(self.langs) == 1:
            score = np.ones(len(texts))
        else:
            two = np.partition(loss, 1, axis=1)[:, :2]
            score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-12)
        score = np.where(known, np.clip(score, 0, 1), 0.0)
        return [self.langs[i] if k else "und" for i, k in zip(best, known, strict=True)], score.tolist(), (known & (score < AMBIGUOUS)).tolist()


def held_out(doc_id: Column) -> Column:
    """Whether a document stays out of training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, per_lang: int) -> DataFrame:
    """(lang, text) of labelled documents in training: all of a rare language, of others a share that makes per_lang expected."""
    usable = docs.where(F.col(lang).isNotNull() & ~held_out(F.col(doc_id)) & F.col(text).isNotNull())
    usable = usable.select(F.col(doc_id).cast("string").alias("__id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    # one row a language, MOST_LANGS at most
    counts = usable.groupBy(F.col("lang").alias("__lang")).count().orderBy(F.desc("count"), "__lang").limit(MOST_LANGS)
    draw = F.pmod(F.xxhash64("__id", "text", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    return usable.join(F.broadcast(counts), F.col("lang") == F.col("__lang")).where(draw < per_lang / F.col("count")).select("lang", "text")


def fit(labelled: DataFrame, smooth: float = 0.5) -> Model:
    """A model from (lang, text): two passes, one for n-gram counts, one for how often each bit's classifier is right."""

    small_batches(labelled.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                langs = np.array(part.column(0).to_pylist(), object)
                for places, hashed, n in steps(part.column(1).to_pylist()):
                    names, of = np.unique(langs[places], return_inverse=True)
                    found = np.bincount(np.repeat(of, n) * SIZE + hashed, minlength=len(names) * SIZE).reshape(-1, SIZE)
                    for name, v in zip(names, found, strict=True):
                        sums[name] = sums.get(name, 0) + v
        for name, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at], pa.int64())], names=["lang", "gram", "n"])

    rows = labelled.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(rows["lang"]))
    code = codewords(len(langs))
    if not langs:
        return Model([], code, np.zeros((SIZE, 1), np.float32), np.zeros((0, 1)))
    counts = np.zeros((len(langs), SIZE))
    np.add.at(counts, (rows["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(), rows["gram"].to_numpy()), rows["n"].to_numpy())
    p = (counts + smooth) / (counts.sum(1, keepdims=True) + smooth * SIZE)
    weights = np.zeros((SIZE, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        one, zero = code[:, b] > 0, code[:, b] < 0
        if one.any() and zero.any():
            weights[:, b] = np.log(p[one].mean(0) / p[zero].mean(0))
    model = Model(langs, code, weights, np.full(code.shape, 1 / code.shape[1]))
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        right, seen = np.zeros(m.code.shape, np.int64), np.zeros(len(m.langs), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                z = m.margins(part.column(1).to_pylist())
                row = np.array([m.langs.index(x) for x in part.column(0).to_pylist()])
                ok = ~np.isnan(z[:, 0])
                np.add.at(right, row[ok], np.sign(z[ok]) == m.code[row[ok]])
                np.add.at(seen, row[ok], 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, right.shape[1]), pa.int32()), pa.array(np.tile(np.arange(right.shape[1]), len(at)), pa.int32()), pa.array(right[at].ravel(), pa.int64()), pa.array(np.repeat(seen[at], right.shape[1]), pa.int64())], names=["lang", "bit", "good", "seen"])

    trust = np.ones(code.shape)
    for r in labelled.mapInArrow(test, "lang int, bit int, good long, seen long").groupBy("lang", "bit").agg(F.sum("good").alias("good"), F.sum("seen").alias("seen")).collect():
        trust[r["lang"], r["bit"]] = (r["good"] + 1) / (r["seen"] + 2)
    model.trust = trust / trust.sum(1, keepdims=True)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, score (0 to 1: by how much of its loss the second codeword is worse) and ambiguous. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return per_text(docs, text, fields, lambda: shared.value.predict, keep)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def with_letter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter. No shuffle."""
    tested = per_text(docs, text, [T.StructField("__letter", T.BooleanType())], lambda: lambda texts: [[has_letter(t) for t in texts]])
    return tested.where("__letter").drop("__letter")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = DOCS_PER_LANG, keep: list[str] | None = None) -> DataFrame:
    """Fits on docs' own labelled rows that are not held out, then predicts every row of docs."""
    return predict(docs, fit(sample(docs, doc_id, text, lang, per_lang)), text, keep)
