"""Order-dependent steps as folds over sorted partitions.

A fold sees the rows of a key in order and keeps only its state (cluster centres, node vectors), never the rows; keys
are dealt out by hash, so memories run side by side. A memory's own fold is serial, as its results depend on order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.vector import place_and_sign
from ..profile import Params, Profile

DIM = 384
_SPACE = re.compile(r"[\t-\r\x1c-\x20\x85\xa0  -     　]+")
_WORDS = re.compile("[a-z0-9]+")
_CHARS = re.compile("[a-z0-9一-鿿]")


def token_list(text: str | None) -> list[str]:
    """The same multiset as functions.text.tokens."""
    low = _SPACE.sub(" ", text or "").strip().lower()
    chars = _CHARS.findall(low)
    return [w for w in _WORDS.findall(low) if len(w) > 1] + [c for c in chars if c >= "一"] + [a + b for a, b in zip(chars, chars[1:], strict=False)]


_hashed = lru_cache(maxsize=1 << 16)(place_and_sign)


def vector(tokens: list[str], dim: int = DIM) -> np.ndarray:
    """The same hash embedding as functions.vector.hash_embedding, dense."""
    sums = [0.0] * dim  # a list, as single items of an array are slow to reach
    for t in tokens:
        place, sign = _hashed(t, dim)
        sums[place] += sign
    v = np.array(sums)
    n = np.linalg.norm(v)
    return v / n if n else v


def keys_of(text: str, profile: Profile) -> dict[str, set[str]]:
    return {k: {m[1] if m.re.groups else m[0] for p in patterns for m in re.finditer(p, text)} for k, patterns in profile.key_patterns.items()}


def key_match(a: dict[str, set], b: dict[str, set]) -> float:
    scores = [len(a[k] & b[k]) / len(a[k] | b[k]) for k in a if a[k] and b[k]]
    return sum(scores) / len(scores) if scores else 1.0


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if both else 0.0


def fold(df: DataFrame, key: str, order: list[str], start: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Runs start() anew for each key and feeds it the key's rows, in order, in batches; what it returns are the result's rows."""
    # a fixed number of partitions: small rows can be long work, so Spark shouldn't join them up by size
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, step = None, None
        for batch in batches:
            for k, rows in batch.groupby(key, sort=False, dropna=False):
                if step is None or k != at:
                    at, step = k, start()
                yield step(rows)

    return dealt.mapInPandas(run, schema)


@dataclass
class Clusters:
    """One-pass leader clustering of a memory's turns."""

    p: Params
    profile: Profile
    n: int = 0
    sums: np.ndarray = field(default_factory=lambda: np.zeros((8, DIM)))  # grows by doubling
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(8))  # tokens of each cluster
    having: dict[str, set[int]] = field(default_factory=dict)  # the clusters that have a token
    keys: list[dict] = field(default_factory=list)
    last: list[float] = field(default_factory=list)
    ends: list[str] = field(default_factory=list)  # each cluster text's last character that counts

    def add(self, text: str, ts: float) -> int:
        """The cluster that the turn joins, or a new one's number."""
        words = token_list(text)
        own, v, keys = set(words), vector(words), keys_of(text, self.profile)
        best, score, n = -1, -1.0, self.n
        if n:
            m = self.sums[:n]
            norms = np.linalg.norm(m, axis=1)
            cos = np.where(norms > 0, m @ v / np.where(norms > 0, norms, 1), 0.0)
            met = np.array([i for t in own for i in self.having.get(t, ())], np.int64)
            both = np.bincount(met, minlength=n)
            lexical = both / np.maximum(len(own) + self.sizes[:n] - both, 1)
            s = 0.68 * np.maximum(cos, 0.0) + 0.22 * lexical + 0.10 * np.exp(-math.log(2) * np.abs(np.array(self.last) - ts) / max(self.p.half_life, 1))
            if any(keys.values()):  # without key entities all match
                s *= np.array([0.2 if key_match(keys, k) < 0.3 else 1.0 for k in self.keys])
            best = int(s.argmax())
            score = float(s[best])
        chars = _CHARS.findall(_SPACE.sub(" ", text).strip().lower())
        if score < self.p.cluster:
            best = self.n
            self.n += 1
            if best == len(self.sums):
                self.sums, self.sizes = np.concatenate([self.sums, np.zeros_like(self.sums)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.keys.append({k: set() for k in keys})
            self.last.append(ts)
            self.ends.append("")
        if self.ends[best] and chars:  # the pair that arises where texts meet
            own = own | {self.ends[best] + chars[0]}
        for t in own:
            of = self.having.setdefault(t, set())
            if best not in of:
                of.add(best)
                self.sizes[best] += 1
        self.sums[best] += v
        for k, found in keys.items():
            self.keys[best][k] |= found
        self.last[best] = max(self.last[best], ts)
        self.ends[best] = chars[-1] if chars else self.ends[best]
        return best


def cluster_turns(turns: DataFrame, p: Params, profile: Profile) -> DataFrame:
    """(memory_id, id, ord, cluster) of turns (memory_id, id, ord, ts, text), in order."""

    def start():
        state = Clusters(p, profile)

        def step(rows: pd.DataFrame) -> pd.DataFrame:
            out = rows[["memory_id", "id", "ord"]].copy()
            out["cluster"] = [state.add(t, s) for t, s in zip(rows["text"], rows["ts"], strict=True)]
            return out

        return step

    return fold(turns.select("memory_id", "id", "ord", "ts", "text"), "memory_id", ["ord", "id"], start, "memory_id string, id string, ord long, cluster int")


class Nodes:
    """The nodes of one block: their vectors in a growing matrix, and for each token the nodes that have it."""

    def __init__(self):
        self.ids: list[str] = []
        self.matrix = np.zeros((8, DIM))
        self.sizes = np.zeros(8)
        self.having: dict[str, list[int]] = {}

    def add(self, node: str, v: np.ndarray, own: set[str]) -> None:
        n = len(self.ids)
        if n == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.matrix[n], self.sizes[n] = v, len(own)
        self.ids.append(node)
        for t in own:
            self.having.setdefault(t, []).append(n)

    def best(self, v: np.ndarray, own: set[str]) -> tuple[int, float]:
        """The first of the nodes of highest score, and its score."""
        n = len(self.ids)
        if not n:
            return -1, -1.0
        met = [i for t in own for i in self.having.get(t, ())]
        both = np.bincount(np.array(met, np.int64), minlength=n)
        lexical = both / np.maximum(len(own) + self.sizes[:n] - both, 1)
        scores = 0.70 * np.maximum(self.matrix[:n] @ v, 0.0) + 0.30 * lexical
        i = int(scores.argmax())
        return i, float(scores[i])


def resolve_nodes(facts: DataFrame, threshold: float, by_class: bool = True) -> DataFrame:
    """(event_id, kind, fact_id, ord, name, node, created, score): each fact at the node it merges into, or makes.

    facts: event_id, kind, fact_id, ord, name, in order of ord. A node keeps the name and vector of its first fact;
    candidates are the event's nodes of the same class (of any class without by_class), the first best wins."""

    def start():
        blocks: dict[str, Nodes] = {}

        def step(rows: pd.DataFrame) -> pd.DataFrame:
            made = []
            for kind, fact, name in zip(rows["kind"], rows["fact_id"], rows["name"], strict=True):
                block = blocks.setdefault(kind if by_class else "", Nodes())
                words = token_list(name)
                own, v = set(words), vector(words)
                best, score = block.best(v, own)
                if best >= 0 and score >= threshold:
                    made.append((block.ids[best], False, score))
                else:
                    made.append((fact, True, score if best >= 0 else None))
                    block.add(fact, v, own)
            out = rows[["event_id", "kind", "fact_id", "ord", "name"]].copy()
            out["node"], out["created"], out["score"] = zip(*made, strict=True)
            return out

        return step

    source = facts.select("event_id", "kind", "fact_id", "ord", "name")
    return fold(source, "event_id", ["ord", "fact_id"], start, "event_id string, kind string, fact_id string, ord long, name string, node string, created boolean, score double")


def merge_plan(pairs: DataFrame) -> DataFrame:
    """(memory_id, kept, gone): a greedy walk over pairs (memory_id, source, target, a_ord, b_ord) in order; a pair with a side that is gone is passed over."""

    def start():
        gone: set[str] = set()

        def step(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for m, a, b in zip(rows["memory_id"], rows["source"], rows["target"], strict=True):
                if a not in gone and b not in gone:
                    gone.add(b)
                    out.append((m, a, b))
            return pd.DataFrame(out, columns=["memory_id", "kept", "gone"])

        return step

    source = pairs.select(pairs["memory_id"].cast("string"), "source", "target", "a_ord", "b_ord")
    return fold(source, "memory_id", ["a_ord", "b_ord"], start, "memory_id string, kept string, gone string")


def fuse_summaries(texts: DataFrame, join: str, limit: int = 240, alike: float = 0.72) -> DataFrame:
    """(event_id, summary): an event's texts (event_id, ord, text) in order, without those like one that is kept, joined and cut."""

    def start():
        kept: list[tuple[str, set]] = []

        def step(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for e, o, t in zip(rows["event_id"], rows["ord"], rows["text"], strict=True):
                piece = _SPACE.sub(" ", t or "").strip()
                own = set(token_list(piece))
                if piece and sum(len(k) for k, _ in kept) < limit and all(jaccard(own, s) <= alike for _, s in kept):
                    kept.append((piece, own))
                    out.append((e, o, piece))
            return pd.DataFrame(out, columns=["event_id", "ord", "piece"])

        return step

    from pyspark.sql import functions as F

    pieces = fold(texts.select("event_id", "ord", "text"), "event_id", ["ord"], start, "event_id string, ord long, piece string")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda s: s["piece"])
    return pieces.groupBy("event_id").agg(F.substring(F.array_join(ordered, join), 1, limit).alias("summary"))


def fuse_chain(texts: DataFrame, join: str, limit: int = 240, alike: float = 0.72) -> DataFrame:
    """(event_id, summary): an event's texts (event_id, ord, text) fused one after the other: each is added to what there is, unless it is like all of that."""
    from pyspark.sql import functions as F

    def start():
        so_far = [""]

        def step(rows: pd.DataFrame) -> pd.DataFrame:
            for t in rows["text"]:
                piece, before = _SPACE.sub(" ", t or "").strip(), so_far[0]
                new = piece and (not before or jaccard(set(token_list(before)), set(token_list(piece))) <= alike)
                so_far[0] = (f"{before}{join}{piece}" if before else piece)[:limit] if new else before
            out = rows[["event_id", "ord"]].tail(1).copy()
            out["summary"] = so_far[0]
            return out

        return step

    steps = fold(texts.select("event_id", "ord", "text"), "event_id", ["ord"], start, "event_id string, ord long, summary string")
    return steps.groupBy("event_id").agg(F.max_by("summary", "ord").alias("summary"))
