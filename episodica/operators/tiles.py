"""Scores between the rows of two sides of a block, as matrices.

Cosines and overlaps of all pairs of a block are products of matrices. The rows of a block are dealt into tiles, and each
pair of tiles meets in one task: it holds one tile, and the other one streams past it, BATCH rows at a time. A row is
copied once for each tile of the other side, so tiles are large where a block is large (held ones bounded, as a task keeps
them), and small blocks have a few tiles of TILE rows and more, or share tasks, as runs of rows in a sorted partition. No
row is made for a pair that fails.

Where only the best of each left row are asked for and the score rises with the cosine and the overlap, most pairs are
passed over by a bound: the cosine in single precision, and the overlap that the sizes of the two sets allow.

Rows have the columns of block, id (string), ord (long), k (token multiset; hashed to a vector, and its set for overlaps
where there is no column t of its own) and, if asked for, keys (struct of sets of key entities) and numbers (named
columns, as doubles).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import place_and_sign

#: A block that meets itself has up to OWN tiles of TILE rows and more, and where they would pass HELD rows, more tiles. Of two sides, the left one has tiles of LEFT rows; the right one, which only streams, has up to STREAMS tiles, one for WORK pairs, and where they would pass RIGHT rows, more.
OWN, TILE, HELD, LEFT, STREAMS, WORK, RIGHT = 8, 1 << 9, 1 << 12, 1 << 14, 16, 1 << 27, 1 << 16
#: Rows of one side that are compared at a time.
BATCH = 1 << 10
#: Pairs of one batch that a task gives.
PIECE = 1 << 14
DIM = 384
#: More than single precision can be wrong about a score.
SLACK = 1e-5


@lru_cache(1 << 16)
def _hashed(token: str) -> tuple[int, float]:
    return place_and_sign(token, DIM)


#: Between tokens that are shuffled in one string: an array of short strings takes 16 bytes for each.
SEPARATOR = "\x1f"


def _joined(tokens: str) -> Column:
    return F.array_join(tokens, SEPARATOR).alias(tokens)


def _lists(df: DataFrame, texts: list[str]) -> list[Column]:
    """Columns k (as it is, where it has sums by summed()) and texts."""
    return [F.col("k") if df.schema["k"].dataType == T.BinaryType() else _joined("k"), *map(_joined, texts)]


class _Sets:
    """Lists of strings of a table's rows: their distinct members, and which rows have them."""

    def __init__(self, lists: pa.ChunkedArray):
        lists = lists.combine_chunks()
        if pa.types.is_string(lists.type):  # joined by _joined()
            lists = pc.split_pattern(pc.if_else(pc.equal(lists, ""), None, lists), SEPARATOR)
        lengths = np.diff(np.asarray(lists.offsets)) * np.asarray(lists.is_valid())
        flat = lists.flatten().dictionary_encode()
        self.n, self.members = len(lists), flat.dictionary
        row, code = np.repeat(np.arange(self.n), lengths), np.asarray(flat.indices, np.int64)
        pairs, self.counts = np.unique(row * max(1, len(self.members)) + code, return_counts=True)
        self.row, self.code = np.divmod(pairs, max(1, len(self.members)))
        self.sizes = np.bincount(self.row, minlength=self.n).astype(float)

    def cut(self, start: int, stop: int) -> _Sets:
        """Some rows; the members stay."""
        out, (a, b) = object.__new__(_Sets), np.searchsorted(self.row, [start, stop])
        out.n, out.members, out.row, out.code, out.counts, out.sizes = stop - start, self.members, self.row[a:b] - start, self.code[a:b], self.counts[a:b], self.sizes[start:stop]
        out.vectors, out.singles = self.vectors[start:stop], self.singles[start:stop]
        return out

    @cached_property
    def used(self) -> np.ndarray:
        return np.unique(self.code)

    @property
    def sums(self) -> np.ndarray:
        """The signed counts of each row's tokens at their hashed places."""
        hashed = [_hashed(t) for t in self.members.to_pylist()]
        place = np.array([h[0] for h in hashed], np.int64)
        sign = np.array([h[1] for h in hashed])
        if not len(hashed):
            return np.zeros((self.n, DIM))
        return np.bincount(self.row * DIM + place[self.code], sign[self.code] * self.counts, self.n * DIM).reshape(self.n, DIM)

    @cached_property
    def vectors(self) -> np.ndarray:
        """The hash embedding of each row's multiset, at length 1; zeros without tokens."""
        out = self.sums
        norm = np.sqrt(np.einsum("ij,ij->i", out, out))
        return out / np.where(norm > 0, norm, 1)[:, None]

    @cached_property
    def singles(self) -> np.ndarray:
        return self.vectors.astype(np.float32)

    def places_in(self, other: _Sets) -> np.ndarray:
        """For each member its code in other, or -1."""
        if self.members is other.members:
            return np.arange(len(self.members))
        return np.asarray(pc.fill_null(pc.index_in(self.members, value_set=other.members), -1), np.int64)


class _Vectors:
    """Hash embeddings that came as binary sums, one byte a place, or four."""

    def __init__(self, sums: pa.ChunkedArray):
        rows = sums.to_pylist()
        self.n, self.members = len(rows), pa.array([], pa.string())
        out = np.stack([np.frombuffer(r, "i1" if len(r) == DIM else "<i4") for r in rows]).astype(float) if rows else np.zeros((0, DIM))
        norm = np.sqrt(np.einsum("ij,ij->i", out, out))
        self.vectors = out / np.where(norm > 0, norm, 1)[:, None]

    @cached_property
    def singles(self) -> np.ndarray:
        return self.vectors.astype(np.float32)

    def cut(self, start: int, stop: int) -> _Vectors:
        out = object.__new__(_Vectors)
        out.n, out.members, out.vectors, out.singles = stop - start, self.members, self.vectors[start:stop], self.singles[start:stop]
        return out

    def places_in(self, other: _Vectors) -> np.ndarray:
        return np.zeros(0, np.int64)


class _Common:
    """The members that rows of two tables have in common, in order of the right side's codes. to_left: the left side's code of each member of the right one."""

    def __init__(self, left: _Sets, right: _Sets, to_left: np.ndarray):
        self.left, self.right = left, right
        has = np.zeros(len(left.members) + 1, bool)
        has[left.code] = True
        codes = right.used[has[to_left[right.used]]]
        self.n, self.codes = len(codes), codes
        self._right = np.full(len(right.members), -1)
        self._right[codes] = np.arange(len(codes))
        self._left = np.full(len(left.members), -1)
        self._left[to_left[codes]] = np.arange(len(codes))

    def _filled(self, s: _Sets, place: np.ndarray, order: np.ndarray | None, kind: type, width: int) -> np.ndarray:
        out = np.zeros((s.n, width), kind)
        at = place[s.code]
        keep = at >= 0
        row, at = s.row[keep], at[keep]
        if order is not None:
            at = order[at]
            keep = at >= 0
            row, at = row[keep], at[keep]
        out[row, at] = 1
        return out

    @cached_property
    def counts(self) -> np.ndarray:
        """How many members each pair of rows has in common."""
        width = max(1, self.n)
        return self._filled(self.left, self._left, None, np.float32, width) @ self._filled(self.right, self._right, None, np.float32, width).T

    def bits(self, order: np.ndarray | None = None, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Words of 64 bits of each side's rows, a bit a member; order: the bit of each common member, -1 for none, below n."""
        width = max(1, -(-(self.n if n is None else n) // 64)) * 64
        return tuple(np.packbits(self._filled(s, p, order, bool, width), axis=1, bitorder="little").view("<u8") for s, p in ((self.left, self._left), (self.right, self._right)))

    @cached_property
    def _words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.bits()

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many members the left row i and the right row j have in common."""
        a, b = self._words
        return np.bitwise_count(a[i] & b[j]).sum(axis=1, dtype=np.int64).astype(float)


class Side:
    """Rows of one side."""

    def __init__(self, table: pa.Table, numbers: list[str], sets: list[str]):
        self.n, self.id, self.ord = table.num_rows, table["id"].combine_chunks(), np.asarray(table["ord"])
        if self.n and numbers:
            x = np.asarray(table["x"].combine_chunks().flatten()).reshape(self.n, len(numbers))
            self.numbers = dict(zip(numbers, x.T, strict=True))
        else:
            self.numbers = {k: np.zeros(self.n) for k in numbers}
        self.sets = {s: (_Vectors if pa.types.is_binary(table[s].type) else _Sets)(table[s]) for s in sets}

    def cut(self, start: int, stop: int) -> Side:
        out = object.__new__(Side)
        out.n, out.id, out.ord = stop - start, self.id.slice(start, stop - start), self.ord[start:stop]
        out.numbers, out.sets = {k: x[start:stop] for k, x in self.numbers.items()}, {k: s.cut(start, stop) for k, s in self.sets.items()}
        return out

    def cuts(self) -> Iterator[tuple[int, Side]]:
        for start in range(0, self.n, BATCH):
            yield start, self.cut(start, min(start + BATCH, self.n))


class Pair:
    """Two sides, and the matrices between them."""

    def __init__(self, left: Side, right: Side, to_left: dict[str, np.ndarray]):
        self.left, self.right, self.to_left, self.common = left, right, to_left, {}
        self.shape = (left.n, right.n)

    def a(self, name: str) -> np.ndarray:
        return self.left.numbers[name][:, None]

    def b(self, name: str) -> np.ndarray:
        return self.right.numbers[name][None]

    @cached_property
    def cos(self) -> np.ndarray:
        return self.left.sets["k"].vectors @ self.right.sets["k"].vectors.T

    @cached_property
    def single(self) -> np.ndarray:
        """cos in single precision."""
        return self.left.sets["k"].singles @ self.right.sets["k"].singles.T

    def shared_members(self, name: str) -> _Common:
        if name not in self.common:
            self.common[name] = _Common(self.left.sets[name], self.right.sets[name], self.to_left[name])
        return self.common[name]

    def _sizes(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        return self.left.sets[name].sizes[:, None], self.right.sets[name].sizes[None]

    def _both(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.shared_members(name).counts, *self._sizes(name)

    @cached_property
    def overlap(self) -> np.ndarray:
        """Jaccard of the token sets."""
        both, x, y = self._both("t" if "t" in self.left.sets else "k")
        return both / np.maximum(x + y - both, 1)

    @cached_property
    def coverage(self) -> np.ndarray:
        """The share of the left side's tokens that the right side has."""
        both, x, _ = self._both("t" if "t" in self.left.sets else "k")
        return both / np.maximum(x, 1)

    def shared(self, key: str) -> np.ndarray:
        """Whether both sides have a member of a key's sets in common."""
        return self._both(f"key_{key}")[0] > 0

    @cached_property
    def key_match(self) -> np.ndarray:
        """Mean Jaccard over the classes of key entities that both sides have; 1 without any."""
        total, n = 0.0, 0
        for name in self.left.sets:
            if name.startswith("key_"):
                both, x, y = self._both(name)
                some = (x > 0) & (y > 0)
                total, n = total + np.where(some, both / np.maximum(x + y - both, 1), 0.0), n + some
        return np.where(n > 0, total / np.maximum(n, 1), 1.0)


class _Listed(Pair):
    """Some pairs (i, j) of two sides, as arrays in place of matrices. rough: with the cosine in single precision."""

    def __init__(self, of: Pair, i: np.ndarray, j: np.ndarray, rough: float | None = None):
        self.of, self.left, self.right, self.i, self.j, self.rough = of, of.left, of.right, i, j, rough
        self.shape = i.shape

    def a(self, name: str) -> np.ndarray:
        return self.left.numbers[name][self.i]

    def b(self, name: str) -> np.ndarray:
        return self.right.numbers[name][self.j]

    @cached_property
    def cos(self) -> np.ndarray:
        if self.rough is not None:
            return self.of.single[self.i, self.j] + self.rough
        return np.einsum("ij,ij->i", self.left.sets["k"].vectors[self.i], self.right.sets["k"].vectors[self.j])

    def _both(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.of.shared_members(name).of(self.i, self.j), self.left.sets[name].sizes[self.i], self.right.sets[name].sizes[self.j]


class _Bound(Pair):
    """Values of all pairs that none exceeds, or, with least, that none falls below, from cosines in single precision and sizes."""

    def __init__(self, of: Pair, least: bool = False):
        self.left, self.right, self.shape, self.least = of.left, of.right, of.shape, least
        self.cos = of.single - SLACK if least else of.single

    def _number(self, x: np.ndarray) -> np.ndarray:
        short = x.astype(np.float32)
        return short if np.all(np.abs(short - x) < SLACK / 100) else x

    def a(self, name: str) -> np.ndarray:
        return self._number(self.left.numbers[name])[:, None]

    def b(self, name: str) -> np.ndarray:
        return self._number(self.right.numbers[name])[None]

    def _both(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = (s.astype(np.float32) for s in self._sizes(name))
        return np.zeros((1, 1), np.float32) if self.least else np.minimum(x, y), x, y


#: What a task makes of a pair of tiles: names of matrices; score is rounded to 9 digits, ranks and is kept.
Score = Callable[[Pair], dict[str, np.ndarray]]


class _Best:
    """The best k partners of each row of one side so far, the first in order among equals, with the columns of their pairs."""

    def __init__(self, n: int, k: int, columns: list[str]):
        self.k, self.columns = k, columns
        self.score, self.at = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.values = {c: np.zeros((n, k)) for c in columns if c != "score"}

    def add(self, i: np.ndarray, at: np.ndarray, made: dict[str, np.ndarray]) -> None:
        """Pairs of rows i with partners at places, with their values."""
        if not len(i):
            return
        rows, group = np.unique(i, return_inverse=True)
        of = np.concatenate([np.repeat(np.arange(len(rows)), self.k), group])
        score, place = np.concatenate([self.score[rows].ravel(), made["score"]]), np.concatenate([self.at[rows].ravel(), at])
        order = np.lexsort((place, -score, of))
        n = self.k + np.bincount(group)
        keep = order[np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n) < self.k]
        self.score[rows], self.at[rows] = score[keep].reshape(-1, self.k), place[keep].reshape(-1, self.k)
        for c, v in self.values.items():
            v[rows] = np.concatenate([v[rows].ravel(), made[c]])[keep].reshape(-1, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Rows, their partners' places, and the columns."""
        i, rank = np.nonzero(self.score > -np.inf)
        return i, self.at[i, rank], [(self.score if c == "score" else self.values[c])[i, rank] for c in self.columns]


def _terms(pair: Pair, stop: tuple[str, ...], limit: int) -> Callable[[np.ndarray, np.ndarray], pa.ListArray]:
    """Gives the first common tokens of pairs (i, j), sorted, without single characters and stop words."""
    common = pair.shared_members("t" if "t" in pair.left.sets else "k")
    words = common.right.members.take(pa.array(common.codes)).to_pylist()
    use = sorted((w, at) for at, w in enumerate(words) if len(w) > 1 and w not in stop)
    order = np.full(max(1, len(words)), -1)
    order[[at for _, at in use]] = np.arange(len(use))
    left, right = (m.T for m in common.bits(order, len(use)))  # 64 words of all rows at a time
    names = pa.array([w for w, _ in use], pa.string())

    def of(i: np.ndarray, j: np.ndarray) -> pa.ListArray:
        found, n, short = np.full((len(i), limit), -1), np.zeros(len(i), np.int64), np.arange(len(i))
        for k, (x, y) in enumerate(zip(left, right, strict=True)):
            at, both = short, x[i[short]] & y[j[short]]
            while True:
                some = (both != 0) & (n[at] < limit)
                at, both = at[some], both[some]
                if not len(at):
                    break
                lowest = both & (~both + np.uint64(1))
                found[at, n[at]] = 64 * k + np.frexp(lowest.astype(float))[1] - 1
                n[at] += 1
                both ^= lowest
            short = short[n[short] < limit]
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(found[found >= 0])))

    return of


def _scored(made: dict[str, np.ndarray], shape: tuple[int, ...]) -> dict[str, np.ndarray]:
    return {c: np.broadcast_to(v if c != "score" else np.round(v, 9), shape) for c, v in made.items()}


def _emit(pair: Pair, score: Score, mask: np.ndarray | None, least: float | None, columns: list[str], stop: tuple[str, ...] | None, once: bool) -> Iterator[list]:
    """The columns of the pairs that pass, PIECE pairs at a time; once: the earlier row comes as the left one."""
    made = _scored(score(pair), pair.shape)
    keep = np.ones(pair.shape, bool) if mask is None else mask
    if least is not None:
        keep = keep & (made["score"] >= least)
    every_i, every_j = np.nonzero(keep)
    terms = None if stop is None or not len(every_i) else _terms(pair, stop, 6)
    for start in range(0, len(every_i), PIECE):
        i, j = every_i[start : start + PIECE], every_j[start : start + PIECE]
        a, b, x, y = pair.left.id.take(pa.array(i)), pair.right.id.take(pa.array(j)), pair.left.ord[i], pair.right.ord[j]
        if once and (x > y).any():
            back = pa.array(x > y)
            a, b, x, y = pc.if_else(back, b, a), pc.if_else(back, a, b), np.minimum(x, y), np.maximum(x, y)
        yield [a, b, pa.array(x), pa.array(y), *[pa.array(made[c][i, j]) for c in columns], *([] if terms is None else [terms(i, j)])]


def _count(pair: Pair, score: Score, mask: np.ndarray | None, least: float) -> int:
    """How many pairs pass: most are decided by bounds of their scores, the others by the scores."""
    high, low = (np.broadcast_to(score(_Bound(pair, least=b))["score"], pair.shape) for b in (False, True))
    sure, open_ = low >= least + SLACK, high >= least - SLACK
    if mask is not None:
        sure, open_ = sure & mask, open_ & mask
    i, j = np.nonzero(open_ & ~sure)
    n = int(sure.sum())
    for start in range(0, len(i), PIECE):
        some = _Listed(pair, i[start : start + PIECE], j[start : start + PIECE])
        n += int((_scored(score(some), some.shape)["score"] >= least).sum())
    return n


def _take_best(best: _Best, at: int, pair: Pair, places: np.ndarray, score: Score, mask: np.ndarray | None, least: float | None, rising: bool) -> None:
    """Adds what a pair of sides has to the best of the left rows, which are those from at on."""
    bar = best.score[at : at + pair.left.n, -1]  # a view, so it moves
    if not rising:
        made = _scored(score(pair), pair.shape)
        keep = made["score"] >= bar[:, None]
        if mask is not None:
            keep &= mask
        if least is not None:
            keep &= made["score"] >= least
        if pair.right.n > best.k:  # the first k of equals are enough
            order = np.argsort(np.where(keep, -made["score"], np.inf), axis=1, kind="stable")[:, : best.k]
            first = np.zeros(keep.shape, bool)
            np.put_along_axis(first, order, True, axis=1)
            keep &= first
        i, j = np.nonzero(keep)
        best.add(at + i, places[j], {c: v[i, j] for c, v in made.items()})
        return
    high = np.broadcast_to(score(_Bound(pair))["score"], pair.shape) + SLACK
    if mask is not None:
        high = np.where(mask, high, -np.inf)
    if least is not None:
        high = np.where(high >= least, high, -np.inf)

    def add(i: np.ndarray, j: np.ndarray) -> None:
        for start in range(0, len(i), PIECE):
            a, b = i[start : start + PIECE], j[start : start + PIECE]
            rough = _Listed(pair, a, b, SLACK)
            some = np.broadcast_to(score(rough)["score"], rough.shape) + SLACK >= bar[a]
            one = _Listed(pair, a[some], b[some])
            made = _scored(score(one), one.shape)
            keep = made["score"] >= bar[one.i]
            if least is not None:
                keep &= made["score"] >= least
            best.add(at + one.i[keep], places[one.j[keep]], {c: v[keep] for c, v in made.items()})

    new = np.flatnonzero(bar == -np.inf)
    if len(new) and pair.right.n > best.k:  # a bar for rows that have none yet
        j = np.argpartition(-high[new], best.k - 1, axis=1)[:, : best.k].ravel()
        i = np.repeat(new, best.k)
        some = high[i, j] > -np.inf
        add(i[some], j[some])
        high[i, j] = -np.inf
    add(*np.nonzero((high >= bar[:, None]) & (high > -np.inf)))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, int, pa.RecordBatch]]:
    """Sorted batches cut where keys or side change: whether a run of equal keys begins, its side, and the rows."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in [*keys, "side"]:
            codes = np.asarray(pc.fill_null(batch.column(batch.schema.get_field_index(k)).dictionary_encode().indices, -1))
            change[1:] |= codes[1:] != codes[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            part = batch.slice(a, b - a)
            key = tuple(part.column(part.schema.get_field_index(k))[0].as_py() for k in keys)
            yield key != last, part.column(part.schema.get_field_index("side"))[0].as_py(), part
            last = key


def meet(left: DataFrame, right: DataFrame | None, block: list[str], score: Score, *, where: Callable[[Pair], np.ndarray] | None = None, top: int | None = None, least: float | None = None, numbers: tuple[list[str], list[str]] = ((), ()), keys: list[str] = (), columns: list[str] = ("score",), stop: tuple[str, ...] | None = None, tile: int | None = None, rising: bool = False, once: bool = False, count: bool = False) -> DataFrame:
    """(block, a, b, a_ord, b_ord, columns; with stop words, shared_terms: their first 6 common tokens) of the pairs of a left and a right row of one block that pass.

    Without right, the pairs are those of left rows, each in both directions, but not with itself; with once each is scored
    once, for scores that are equal in both directions, and has the row of lower ord on the left (none for equal ord). where
    gives a matrix of the pairs to take; least is a bound of the score; top keeps the best of each left row, the first in
    order among equals, in each task: where a block has several tiles, take the best of what comes once more. rising: the
    score falls with no rise of cosine, overlap or coverage, so that bounds can pass pairs over. With count, for a rising score
    with least, (block, n): how many pairs pass, in one row a task."""
    spark = left.sparkSession
    own = right is None
    names = [list(n) for n in numbers]
    if own:
        names[1] = names[0] = list(dict.fromkeys(names[0] + names[1]))

    texts = ["t"] if "t" in left.columns else []

    def rows(df: DataFrame, side: int) -> DataFrame:
        x = F.array(*[F.col(c).cast("double") for c in names[side]]) if names[side] else F.array().cast("array<double>")
        return df.select(*block, F.lit(side).alias("side"), F.col("id").cast("string").alias("id"), F.col("ord").cast("long").alias("ord"), *_lists(df, texts), x.alias("x"), *[F.col(f"keys.{k}").alias(f"key_{k}") for k in keys])

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*block).agg(F.count("*").alias(name))

    def parts_of(n: str, most: int) -> Column:
        return F.ceil(F.col(n) / F.lit(tile or most))

    def others(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))

    l = rows(left, 0)
    if own:
        few = F.lit(1) if tile else F.least(F.lit(OWN), F.ceil(F.col("p0") / TILE))
        parts = sizes(left, "p0").withColumn("p0", F.greatest(few, parts_of("p0", HELD)))
        dealt = l.join(parts, block).withColumn("tile", F.pmod(F.xxhash64("id"), "p0")).withColumn("other", others("p0"))
        dealt = dealt.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).withColumn("side", (F.col("tile") != F.col("i")).cast("int")).drop("p0", "tile", "other")
    else:
        few = F.lit(1) if tile else F.least(F.lit(STREAMS), F.ceil(F.col("p0") * F.col("p1") / WORK))
        parts = sizes(left, "p0").join(sizes(right, "p1"), block).withColumns({"p0": parts_of("p0", LEFT), "p1": F.greatest(few, parts_of("p1", RIGHT))})

        def spread(df: DataFrame, mine: str, theirs: str, i: str, j: str) -> DataFrame:
            d = df.join(parts, block).withColumn("tile", F.pmod(F.xxhash64("id"), mine)).withColumn("other", others(theirs))
            return d.withColumns({"i": F.col(i), "j": F.col(j)}).drop("p0", "p1", "tile", "other")

        dealt = spread(l, "p0", "p1", "tile", "other").unionByName(spread(rows(right, 1), "p1", "p0", "other", "tile"))
    # a fixed number of partitions: small rows can be long work, so Spark shouldn't join them up by size
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run_keys = [*block, "i", "j"]
    dealt = dealt.repartition(n, *run_keys).sortWithinPartitions(*run_keys, "side", "ord", "id")
    out = T.StructType([left.schema[c] for c in block])
    if count:
        out.add("n", T.LongType())
    else:
        out = T.StructType([*out, *(T.StructField(c, t) for c, t in (("a", T.StringType()), ("b", T.StringType()), ("a_ord", T.LongType()), ("b_ord", T.LongType()))), *(T.StructField(c, T.DoubleType()) for c in columns)])
        if stop is not None:
            out.add("shared_terms", T.ArrayType(T.StringType()))
    columns, set_names = list(columns), ["k", *texts, *[f"key_{k}" for k in keys]]
    names_out = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        state: dict = {}

        def batch_of(found: list) -> pa.RecordBatch:
            first = parts[0]
            fixed = [pa.array([first.column(first.schema.get_field_index(c))[0].as_py()] * len(found[0]), first.schema.field(c).type) for c in block]
            flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in found]
            return pa.RecordBatch.from_arrays([*fixed, *flat], names=names_out)

        def held() -> Side:
            if "held" not in state:
                side = state["held"] = Side(pa.Table.from_batches(parts), names[0], set_names)
                state["cuts"] = list(side.cuts())
                state["best"], state["seen"], state["n"] = top and _Best(side.n, top, columns), [], 0
            return state["held"]

        def ranked(best: _Best, a: Side, ids: pa.Array, ords: np.ndarray) -> Iterator[pa.RecordBatch]:
            i, at, values = best.found()
            for start in range(0, len(i), PIECE):
                x, y = i[start : start + PIECE], at[start : start + PIECE]
                yield batch_of([a.id.take(pa.array(x)), ids.take(pa.array(y)), pa.array(a.ord[x]), pa.array(ords[y]), *[pa.array(v[start : start + PIECE]) for v in values]])

        def masked(pair: Pair, same: bool) -> tuple[bool, np.ndarray | None]:
            """Whether a pair of sides has any pair to take, and which; same: one cut with itself."""
            mask = None if where is None else np.broadcast_to(where(pair), pair.shape)
            if same:
                other = ~np.eye(pair.left.n, dtype=bool)
                mask = other if mask is None else other & mask
            if once:
                first = pair.left.ord[:, None] < pair.right.ord[None] if state["diagonal"] else pair.left.ord[:, None] != pair.right.ord[None]
                mask = first if mask is None else first & mask
            return mask is None or bool(mask.any()), mask

        def pairs(pair: Pair, same: bool) -> Iterator[pa.RecordBatch]:
            some, mask = masked(pair, same)
            if not some:
                return
            if count:
                state["n"] += _count(pair, score, mask, least)
            else:
                yield from map(batch_of, _emit(pair, score, mask, least, columns, stop, once))

        def against(right_side: Side, offset: int, same_table: bool) -> Iterator[pa.RecordBatch]:
            """The rows that are held with others. same_table: these are held rows too, from offset on."""
            side = held()
            to_left = {s: right_side.sets[s].places_in(side.sets[s]) for s in set_names}
            places = offset + np.arange(right_side.n)
            turned = own and not same_table and not once
            back = top and turned and _Best(right_side.n, top, columns)
            from_right = {s: side.sets[s].places_in(right_side.sets[s]) for s in set_names} if turned else None
            for start, cut in state["cuts"]:
                if same_table and once and offset < start:
                    continue  # sorted by ord: all that is right comes before
                pair, same = Pair(cut, right_side, to_left), same_table and start == offset
                turn = turned and Pair(right_side, cut, from_right)
                if top:
                    some, mask = masked(pair, same)
                    if some:
                        _take_best(state["best"], start, pair, places, score, mask, least, rising)
                    if turn:
                        some, mask = masked(turn, False)
                        if some:
                            _take_best(back, 0, turn, start + np.arange(cut.n), score, mask, least, rising)
                else:
                    yield from pairs(pair, same)
                    if turn:
                        yield from pairs(turn, False)
            if back:
                yield from ranked(back, right_side, side.id, side.ord)

        def streamed(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            held()
            state["diagonal"] = False
            for start in range(0, part.num_rows, BATCH):
                other = Side(pa.Table.from_batches([part.slice(start, BATCH)]), names[1], set_names)
                yield from against(other, state.get("offset", 0), False)
                if top:
                    state["seen"].append((other.id, other.ord))
                state["offset"] = state.get("offset", 0) + other.n

        def finished() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            first = parts[0]
            if own and first.column(first.schema.get_field_index("i"))[0].as_py() == first.column(first.schema.get_field_index("j"))[0].as_py():
                side = held()
                state["diagonal"] = True
                for start, cut in state["cuts"]:
                    yield from against(cut, start, True)
                state["seen"] = [(side.id, side.ord)]
            if state.get("best") and state["seen"]:
                yield from ranked(state["best"], state["held"], pa.concat_arrays([x for x, _ in state["seen"]]), np.concatenate([o for _, o in state["seen"]]))
            if count and state.get("n"):
                yield batch_of([pa.array([state["n"]])])

        for begins, side, part in _runs(batches, run_keys):
            if begins:
                yield from finished()
                parts.clear()
                state.clear()
            if side == 0:
                parts.append(part)
            elif parts:
                yield from streamed(part)
        yield from finished()

    return dealt.mapInArrow(run, out)


def lead(df: DataFrame, block: list[str], score: Score, least: float, keys: list[str] = ()) -> DataFrame:
    """(block, kept, gone): the rows of a block (id, ord, k, t, keys) in order; each goes to the first row that stayed, is lower in ord and scores least with it, or stays itself.

    One task walks a block and keeps the rows that stayed; the others stream by, so no pair becomes a row."""
    texts = ["t"] if "t" in df.columns else []
    set_names = ["k", *texts, *[f"key_{k}" for k in keys]]
    rows = df.select(*block, F.col("id").cast("string").alias("id"), F.col("ord").cast("long").alias("ord"), F.lit(0).alias("side"), *_lists(df, texts), F.array().cast("array<double>").alias("x"), *[F.col(f"keys.{k}").alias(f"key_{k}") for k in keys])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, *block).sortWithinPartitions(*block, "ord", "id")
    out = T.StructType([*[df.schema[c] for c in block], T.StructField("kept", T.StringType()), T.StructField("gone", T.StringType())])

    def alike(a: Side, b: Side) -> np.ndarray:
        pair = Pair(a, b, {s: b.sets[s].places_in(a.sets[s]) for s in set_names})
        return (_scored(score(pair), pair.shape)["score"] >= least) & (a.ord[:, None] < b.ord[None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full: list[Side] = []  # of BATCH rows and more
        tail: list[pa.RecordBatch] = []  # rows that stayed since

        def side(parts: list[pa.RecordBatch]) -> Side:
            return Side(pa.Table.from_batches(parts), [], set_names)

        for begins, _, whole in _runs(batches, block):
            if begins:
                full, tail = [], []
            for start in range(0, whole.num_rows, BATCH):
                part = whole.slice(start, BATCH)
                one = side([part])
                head = np.full(one.n, None, object)
                for stayed in [*full, *([side(tail)] if tail else [])]:
                    open_ = np.flatnonzero(head == None)  # noqa: E711
                    found = alike(stayed, one)[:, open_]
                    first, some = found.argmax(axis=0), found.any(axis=0)
                    head[open_[some]] = np.array(stayed.id.take(pa.array(first[some])).to_pylist(), object)
                rest = np.flatnonzero(head == None)  # noqa: E711
                if len(rest):
                    mine = side([part.take(pa.array(rest))])
                    found, stay = alike(mine, mine), np.ones(len(rest), bool)
                    ids = mine.id.to_pylist()
                    for at in range(len(rest)):
                        before = np.flatnonzero(found[:at, at] & stay[:at])
                        if len(before):
                            stay[at], head[rest[at]] = False, ids[before[0]]
                    tail.append(part.take(pa.array(rest[stay])))
                    if sum(x.num_rows for x in tail) >= BATCH:
                        full.append(side(tail))
                        tail = []
                gone = np.flatnonzero(head != None)  # noqa: E711
                if len(gone):
                    fixed = [part.column(part.schema.get_field_index(c)).take(pa.array(gone)) for c in block]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(head[gone].tolist(), pa.string()), one.id.take(pa.array(gone))], names=[f.name for f in out])

    return dealt.mapInArrow(run, out)


def cosines(df: DataFrame, a: str, b: str, rows: int = 512) -> DataFrame:
    """df with cos: the cosine of the hash embeddings of two columns of token multisets, row by row."""
    schema = T.StructType([*df.schema.fields, T.StructField("cos", T.DoubleType())])
    at, to = df.columns.index(a), df.columns.index(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                v = _Sets(pa.chunked_array([batch.column(at), batch.column(to)])).vectors
                cos = np.einsum("ij,ij->i", v[: batch.num_rows], v[batch.num_rows :])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cos)], names=schema.names)

    return df.mapInArrow(run, schema)


def summed(df: DataFrame, rows: int = BATCH) -> DataFrame:
    """df with column k, a multiset of tokens, as the sums of its hash embedding, for rows with a token set t of their own: what is copied for tiles is a few hundred bytes then."""
    schema = T.StructType([T.StructField("k", T.BinaryType()) if f.name == "k" else f for f in df.schema.fields])
    at = df.columns.index("k")

    def packed(sums: np.ndarray) -> bytes:
        return sums.astype("i1" if np.abs(sums).max() < 128 else "<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                columns = list(batch.columns)
                columns[at] = pa.array([packed(x) for x in _Sets(pa.chunked_array([batch.column(at)])).sums], pa.binary())
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)
