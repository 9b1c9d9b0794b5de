"""A memory as it grows: each turn is routed to an event as that event is at the moment, and applied to its three graphs.

What depends on arrival order is a fold over a memory's turns: routing, assignment, node resolution, corrections and the
events' own titles, summaries and vectors. All that a turn says is extracted before, as columns, and everything after is
a query over the fold's only result, a log of typed updates: tables of turns, nodes, edges and events, counts, corrections.
The same fold runs over a table (updates()) and over a stream (streaming.live), with the same updates for any cut.

Not part of the fold, but jobs of their own over its tables: rebuilds and splits of drifting events, merges of events
alike, and compression. A trigger clears an event's consistency scores, as the rebuild that follows makes them anew.

Cases: a turn without text joins events like any other; turns that aren't valid are left out before; of turns that share
a place in the order the smaller id comes first; a memory that never reaches its cold start has no updates.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vector as V
from ..profile import Params, Profile
from . import edges, extract
from .folds import DIM, Clusters, fold, jaccard, key_match, keys_of, token_list, vector

#: The order in which the classes of a turn's entities are applied.
CLASSES = ("person", "location", "equipment", "material", "building_area", "hazard")
TURN = "memory_id string, at long, id string, ts double, said string, text string, local string, density double, signal double, facts array<struct<kind:string,name:string>>, stage string, cause string, effect string"
UPDATE = "memory_id string, at long, seq int, turn string, ts double, event_id string, what string, graph string, node string, other string, kind string, name string, text string, score double, value double, created boolean"
_COLUMNS = [c.split()[0] for c in UPDATE.split(", ")]
_LAST, _RECENT = 8, 4


def prepared(turns: DataFrame, profile: Profile, *more: str) -> DataFrame:
    """Turns (memory_id, at, id, ts, question, answer, text) with all that they say: TURN, and more of their columns. No shuffle."""
    parts = extract.chunks(F.col("text"), profile)
    t = turns.withColumn("parts", parts).withColumn("k", X.tokens(F.col("text")))
    order = F.lit(len(CLASSES))
    rank = {c: i for i, c in enumerate(CLASSES)}

    def fact(chunk, place):
        kind, r = extract.classify(chunk, profile.classes, profile.other_class), order
        for c, i in rank.items():
            r = F.when(kind == c, i).otherwise(r)
        return F.struct(r.alias("rank"), place.alias("place"), kind.alias("kind"), F.substring(chunk, 1, extract.CHUNK_CHARS).alias("name"))

    facts = F.transform(F.array_sort(F.transform(F.slice("parts", 1, extract.CHUNKS), fact)), lambda f: F.struct(f["kind"].alias("kind"), f["name"].alias("name")))
    c = extract.causal(F.col("parts"), profile)
    return t.select(
        F.col("memory_id").cast("string").alias("memory_id"),
        F.col("at").cast("long").alias("at"),
        "id",
        "ts",
        F.concat_ws("\n", "question", "answer").alias("said"),
        "text",
        X.local_summary(F.col("question"), F.col("answer"), F.lit("")).alias("local"),
        X.density(F.col("text"), F.col("k"), F.col("question"), F.col("answer"), profile).alias("density"),
        X.conflict_signal(F.col("text"), profile).alias("signal"),
        facts.alias("facts"),
        extract.stage(F.col("parts"), profile).alias("stage"),
        c["cause"].alias("cause"),
        c["effect"].alias("effect"),
        *more,
    )


@lru_cache(1 << 12)
def parsed(text: str) -> tuple[np.ndarray, frozenset[str]]:
    """A text's vector and token set; a turn's texts are met several times each."""
    words = token_list(text)
    return vector(words), frozenset(words)


def title_of(texts: list[str], profile: Profile, previous: str = "") -> str:
    head = " ".join(texts[:3])
    for word in profile.critical:
        if word in head:
            return word + profile.title_suffix
    words = sorted(t for t in set(token_list(head)) if len(t) > 1 and t not in profile.stop)[:3]
    return " / ".join(words)[:18] if words else previous or (head[:18] if head else profile.default_title)


def fused(pieces: Iterable[str], join: str, alike: float = 0.72, limit: int = 240) -> str:
    """Pieces in order without those like one that is kept, joined and cut."""
    kept: list[tuple[str, set]] = []
    for piece in pieces:
        own = parsed(piece)[1]
        if piece and all(jaccard(own, s) <= alike for _, s in kept):
            kept.append((piece, own))
    return join.join(p for p, _ in kept)[:limit]


def evidence(text: str, frequency: int, importance: float, age: float, half_life: float, profile: Profile) -> float:
    """functions.text.evidence_weight for one text."""
    signal = min(1.0, sum(w in text.lower() for w in profile.conflicts) / 2)
    authority = 0.3 if any(w in text for w in profile.authority) else 0.0
    base = 0.3 + 0.2 * min(1.0, frequency / 5) + 0.2 * importance
    return min(1.0, base * (1 + signal + authority) + 0.3 * math.exp(-math.log(2) * max(0.0, age) / max(half_life, 1)))


@dataclass
class Node:
    id: str
    kind: str
    name: str
    text: str
    frequency: int
    last_seen: float
    importance: float
    turns: list[str]
    corrected: bool = False


class Graph:
    """The nodes of one graph of one event: vectors in a growing matrix, and for each token the nodes that have it."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.matrix = np.zeros((8, DIM))
        self.sizes = np.zeros(8)
        self.kinds = np.zeros(8, np.int64)
        self.codes: dict[str, int] = {}
        self.having: dict[str, set[int]] = {}
        self.tokens: list[frozenset[str]] = []

    def code(self, kind: str) -> int:
        return self.codes.setdefault(kind, len(self.codes))

    def add(self, node: Node, embedded: str, lexical: str) -> None:
        n = len(self.nodes)
        if n == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.sizes, self.kinds = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.kinds))
        self.nodes.append(node)
        self.tokens.append(frozenset())
        self.matrix[n], self.kinds[n] = parsed(embedded)[0], self.code(node.kind)
        self.retoken(n, lexical)

    def retoken(self, n: int, lexical: str) -> None:
        own = parsed(lexical)[1]
        for t in self.tokens[n] - own:
            self.having[t].discard(n)
        for t in own - self.tokens[n]:
            self.having.setdefault(t, set()).add(n)
        self.tokens[n], self.sizes[n] = own, len(own)

    def best(self, text: str, kind: str | None, lexical: float) -> tuple[int, float]:
        """The first of the nodes of highest score, of one kind if given, and its score."""
        n = len(self.nodes)
        of = np.arange(n) if kind is None else np.flatnonzero(self.kinds[:n] == self.code(kind))
        if not len(of):
            return -1, -1.0
        v, own = parsed(text)
        scores = np.maximum(self.matrix[:n] @ v, 0.0)
        if lexical:
            met = np.array([i for t in own for i in self.having.get(t, ())], np.int64)
            both = np.bincount(met, minlength=n)
            scores = (1 - lexical) * scores + lexical * both / np.maximum(len(own) + self.sizes[:n] - both, 1)
        scores = np.round(scores[of], 12)
        i = int(scores.argmax())
        return int(of[i]), float(scores[i])


@dataclass
class Event:
    id: str
    ord: int
    title: str
    summary: str
    source: str
    updated_at: float
    keys: dict[str, set[str]]
    scores: list[float] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    n_nodes: int = 0
    graphs: dict[str, Graph] | None = None
    changed: bool = True

    def __post_init__(self):
        self.look()

    def look(self) -> None:
        self.vector = parsed(self.source)[0]
        self.tokens = parsed(f"{self.title} {self.summary}")[1]


class Memory:
    """The state of one memory, and what a turn does to it. graphs_of loads the graphs of an event that isn't new."""

    def __init__(self, memory_id: str, p: Params, profile: Profile, review: bool = True, legacy: bool = False, drift: float = 0.24, graphs_of=None):
        self.id, self.p, self.profile, self.review, self.legacy, self.drift = memory_id, p, profile, review, legacy, drift
        self.events: dict[str, Event] = {}
        self.buffer: list = []
        self.ready, self.density, self.n = False, 0.0, 0
        self.graphs_of = graphs_of or (lambda event: {g: Graph() for g in ("entity", "temporal", "causal")})

    def add(self, turn) -> list[tuple]:
        """The updates that a turn makes; none while the memory waits for its cold start."""
        self.out, self.seq = [], 0
        if self.ready:
            self._incremental(turn)
            return self.out
        self.buffer.append(turn)
        self.density, self.n = self.density + turn.density, self.n + 1
        p, mean = self.p, self.density / self.n
        if turn.density >= p.density or mean >= 0.7 * p.density and self.n >= 2 or self.n >= p.cold_start:
            self._initialise()
        return self.out

    # --- events ---

    def _initialise(self) -> None:
        clusters, members = Clusters(self.p, self.profile), {}
        for t in self.buffer:
            members.setdefault(clusters.add(t.text, t.ts), []).append(t)
        for turns in members.values():
            event = self._create(turns)
            for t in turns:
                self._assign(t, event, None, "cold", t is turns[0])
                self._apply(t, event)
            self._summarise(turns[-1], event)
        self.buffer, self.ready = [], True

    def _incremental(self, turn) -> None:
        event, score = self.route(turn)
        new = event is None
        if new:
            event = self._create([turn])
        self._assign(turn, event, score, "new" if new else "routed", new)
        self._apply(turn, event)
        self._summarise(turn, event)
        self._trigger(turn, event)

    def _create(self, turns: list) -> Event:
        texts = [t.text for t in turns]
        title, pieces = title_of(texts, self.profile), [t for t in texts[:6] if t]
        summary = self.profile.join.join(dict.fromkeys(pieces))[:240]
        event = Event(f"{self.id}/{len(self.events)}", len(self.events), title, summary, f"{title}\n{summary}\n", turns[-1].ts, keys_of(f"{title} {summary}", self.profile))
        event.graphs = {g: Graph() for g in ("entity", "temporal", "causal")}
        self.events[event.id] = event
        return event

    def route(self, turn) -> tuple[Event | None, float]:
        """The event that suits a turn best as things are, the earliest of equals, or none below the threshold; and its score."""
        v, lexical = parsed(turn.said)[0], parsed(turn.text)[1]
        keys, p = keys_of(turn.text, self.profile), self.p
        best, top = None, -1.0
        for e in self.events.values():
            cos, both = max(float(v @ e.vector), 0.0), jaccard(lexical, e.tokens)
            age = turn.ts - e.updated_at
            if self.legacy:
                score = 0.62 * cos + 0.22 * both + 0.16 * 2 ** (-max(age, 0.0) / p.half_life)
            else:
                score = 0.52 * cos + 0.18 * both + 0.30 * 2 ** (-abs(age) / p.half_life) + (0.15 if e.ord == len(self.events) - 1 else 0.0)
                if key_match(keys, e.keys) < 0.3:
                    score *= 0.15
            score = round(score, 12)
            if score > top:
                best, top = e, score
        least = p.new_event * (0.55 if len(self.events) <= 3 and not self.legacy else 1.0)
        return (best if top >= least else None), top

    def _assign(self, turn, event: Event, score: float | None, how: str, created: bool) -> None:
        consistency = float(parsed(turn.said)[0] @ event.vector)
        event.scores = [*event.scores, consistency][-_LAST:]
        event.texts = [*event.texts, turn.text][-_RECENT:]
        event.updated_at, event.changed = turn.ts, True
        for k, found in keys_of(turn.text, self.profile).items():
            event.keys[k] |= found
        self._put(turn, event, "assigned", kind=how, score=score, value=consistency, created=created, name=str(len(event.scores)))

    def _summarise(self, turn, event: Event) -> None:
        event.summary = fused([event.summary, turn.local, *event.texts[-3:]], self.profile.join)
        last = [n.text for g in ("entity", "temporal", "causal") for n in self._graph(event, g).nodes[-8:]][-8:]
        event.source = f"{event.title}\n{event.summary}\n{' '.join(last)}"
        event.look()
        for k, found in keys_of(event.summary, self.profile).items():
            event.keys[k] |= found
        self._put(turn, event, "event", name=event.title, text=event.summary, other=event.source, value=float(event.n_nodes))

    def _trigger(self, turn, event: Event) -> None:
        mean = sum(event.scores) / len(event.scores)
        drifts = len(event.scores) >= 5 and mean <= self.drift
        if event.n_nodes >= 28 or drifts:
            self._put(turn, event, "trigger", kind="drift" if drifts else "size", score=mean, value=float(event.n_nodes))
            event.scores = []

    # --- graphs ---

    def _graph(self, event: Event, name: str) -> Graph:
        if event.graphs is None:
            event.graphs = self.graphs_of(event)
        return event.graphs[name]

    def _apply(self, turn, event: Event) -> None:
        entity, temporal, causal = (self._graph(event, g) for g in ("entity", "temporal", "causal"))
        known = {(n.kind, n.name.lower()) for n in entity.nodes if not n.corrected} if self.review else ()
        stages = {n.kind.lower() for n in temporal.nodes} if self.review else ()
        touched = {"entity": [], "causal": []}
        for kind, name in turn.facts:
            if (kind, name.lower()) not in known:
                touched["entity"].append(self._resolve(turn, event, "entity", kind, name, 0.30, self.p.entity_merge))
        if turn.stage.lower() not in stages:
            self._resolve(turn, event, "temporal", turn.stage, turn.local, 0.0, self.p.temporal_merge)
        if turn.cause and turn.effect:
            for kind, text in (("cause", turn.cause), ("effect", turn.effect)):
                touched["causal"].append(self._resolve(turn, event, "causal", kind, text, 0.30, self.p.entity_merge))
            ends = [next((n.id for n in reversed(causal.nodes) if side in n.text or n.text in side), None) for side in (turn.cause, turn.effect)]
            if None not in ends and ends[0] != ends[1]:
                self._put(turn, event, "edge", graph="causal", node=ends[0], other=ends[1])
        if turn.signal >= 0.3:
            for name in ("causal", "entity"):
                self._correct(turn, event, name, touched[name])

    def _resolve(self, turn, event: Event, graph: str, kind: str, text: str, lexical: float, threshold: float) -> int:
        """The place of the node that a text merges into, or makes."""
        g, clean = event.graphs[graph], " ".join(text.split())
        i, score = g.best(clean, None if graph == "causal" else kind, lexical)
        weight = 0.5 if graph == "temporal" else round(max(0.05, min(1.0, 0.50 + self.profile.boosts.get(kind, 0.05))), 4)
        created = i < 0 or score < threshold
        if created:
            i = len(g.nodes)
            node = Node(f"{event.id}:{graph[0]}{i}", kind, clean, clean, 0, turn.ts, weight, [])
            g.add(node, f"{kind} {clean}" if graph == "temporal" else clean, clean)
            event.n_nodes += 1
        node = g.nodes[i]
        node.frequency += 1
        node.last_seen, node.importance = turn.ts, max(node.importance, weight)
        if turn.id not in node.turns:
            node.turns.append(turn.id)
        if not created:
            if graph == "temporal" or jaccard(parsed(node.text)[1], parsed(clean)[1]) <= 0.70:
                node.text = f"{node.text}{self.profile.join}{clean}"[:240]
                if graph == "causal":
                    g.retoken(i, node.text)
        self._put(turn, event, "node", graph=graph, node=node.id, kind=node.kind, name=node.name, text=node.text, score=score if i >= 0 and score >= 0 else None, value=weight, created=created)
        return i

    def _correct(self, turn, event: Event, graph: str, touched: list[int]) -> None:
        """Older nodes of a kind that are unlike a new one, and whose evidence is weaker by far, become corrected."""
        g, p = event.graphs[graph], self.p

        def weight(n: Node) -> float:
            return evidence(n.text if graph == "causal" else n.name, n.frequency, n.importance, turn.ts - n.last_seen, p.half_life, self.profile)

        for i in dict.fromkeys(touched):
            new = g.nodes[i]
            unlike = np.flatnonzero((g.matrix[: len(g.nodes)] @ g.matrix[i] < 0.5) & (g.kinds[: len(g.nodes)] == g.kinds[i]))
            for j in unlike:
                old = g.nodes[j]
                if j != i and not old.corrected and not set(old.turns) & set(new.turns) and weight(new) > 1.3 * weight(old):
                    old.corrected = True
                    self._put(turn, event, "corrected", graph=graph, node=old.id, other=new.id)

    def _put(self, turn, event: Event, what: str, **more) -> None:
        row = {"memory_id": self.id, "at": turn.at, "seq": self.seq, "turn": turn.id, "ts": turn.ts, "event_id": event.id, "what": what, **more}
        self.seq += 1
        self.out.append(tuple(row.get(c) for c in _COLUMNS))


def updates(turns: DataFrame, p: Params, profile: Profile, **rules) -> DataFrame:
    """UPDATE: what the turns (TURN) of each memory do, in order. rules: review, legacy and drift of Memory."""

    def start():
        memory: list[Memory] = []

        def step(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            rows = rows.assign(facts=[[(f["kind"], f["name"]) for f in facts] for facts in rows["facts"]])
            for turn in rows.itertuples(index=False):
                if not memory:
                    memory.append(Memory(turn.memory_id, p, profile, **rules))
                out += memory[0].add(turn)
            return pd.DataFrame(out, columns=_COLUMNS)

        return step

    return fold(turns, "memory_id", ["at", "id"], start, UPDATE)


def rebuilt(turns: DataFrame, p: Params, profile: Profile, review: bool = True) -> DataFrame:
    """UPDATE: what the turns (TURN, event_id, title, summary) of each event do to it when it is made anew: it begins with the title and summary given, without nodes and scores, and its turns come in order.

    State is one event's nodes; events are dealt out by hash, whatever their memories."""
    columns = [c.split()[0] for c in TURN.split(", ")]

    def start():
        held: list = []

        def step(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            rows = rows.assign(facts=[[(f["kind"], f["name"]) for f in facts] for facts in rows["facts"]])
            for turn in rows.itertuples(index=False):
                if not held:
                    memory = Memory(turn.memory_id, p, profile, review)
                    event = Event(turn.event_id, 0, turn.title, turn.summary, f"{turn.title}\n{turn.summary}", turn.ts, keys_of(f"{turn.title} {turn.summary}", profile))
                    event.graphs = memory.graphs_of(event)
                    memory.events[event.id] = event
                    held.extend((memory, event))
                memory, event = held
                memory.out, memory.seq = [], 0
                memory._assign(turn, event, None, "rebuilt", turn.first)
                memory._apply(turn, event)
                if turn.last:
                    memory._put(turn, event, "event", name=event.title, text=event.summary, other=event.source, value=float(event.n_nodes))
                out += memory.out
            return pd.DataFrame(out, columns=_COLUMNS)

        return step

    w = W.partitionBy("event_id")
    order = w.orderBy("at", "id")
    marked = turns.select(*columns, "event_id", "title", "summary").withColumn("first", F.row_number().over(order) == 1)
    marked = marked.withColumn("last", F.lead("id").over(order).isNull())
    return fold(marked, "event_id", ["at", "id"], start, UPDATE)


# --- tables from the log of updates ---


def assigned(log: DataFrame) -> DataFrame:
    """(memory_id, turn, at, event_id, how, created, score, consistency, mean8): each turn at its event, with its cosine to the event's vector at that moment, and the mean of the event's last eight since its last trigger."""
    rows = log.where("what = 'assigned'")
    # the number of scores that the event had then says how far the mean reaches back
    w = W.partitionBy("event_id").orderBy("at", "seq").rowsBetween(1 - _LAST, 0)
    values = F.collect_list("value").over(w)
    last = F.slice(values, F.greatest(F.size(values) - F.col("name").cast("int") + 1, F.lit(1)), F.col("name").cast("int"))
    mean = F.aggregate(last, F.lit(0.0), lambda s, x: s + x) / F.size(last)
    return rows.select("memory_id", "turn", "at", "event_id", F.col("kind").alias("how"), "created", "score", F.col("value").alias("consistency"), mean.alias("mean8"))


def nodes(log: DataFrame, as_of: float, p: Params, profile: Profile, change: float = 1.0) -> DataFrame:
    """(memory_id, event_id, graph, id, ord, kind, name, summary, frequency, turns, first_seen, last_seen, importance, pinned, weight, corrected, confidence): the nodes as the log leaves them, weighted as of a time; change: the weights' share of how much a node changed last."""
    place = F.struct("at", "seq")
    rows = log.where("what = 'node'").groupBy("memory_id", "event_id", "graph", F.col("node").alias("id")).agg(
        F.min("at").alias("ord"),
        F.min_by(F.struct("kind", "name"), place).alias("first"),
        F.max_by("text", place).alias("summary"),
        F.count("*").alias("frequency"),
        F.countDistinct("turn").alias("turns"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.max("value").alias("importance"),
    )
    dead = log.where("what = 'corrected'").select(F.col("node").alias("id"), F.lit(True).alias("corrected")).distinct()
    rows = rows.join(dead, "id", "left").withColumn("corrected", F.coalesce("corrected", F.lit(False)))
    rows = rows.withColumns({"kind": F.col("first.kind"), "name": F.col("first.name")}).withColumn("pinned", (F.col("graph") != "temporal") & X.any_of(F.col("name"), profile.pins))
    weight = V.active_weight(F.lit(as_of) - F.col("last_seen"), F.lit(0), F.col("importance"), F.lit(change), F.col("pinned"), p)
    rows = rows.withColumn("weight", F.round(weight, 4)).withColumn("confidence", F.when(F.col("corrected"), 0.1).otherwise(1.0))
    return rows.select("memory_id", "event_id", "graph", "id", "ord", "kind", "name", "summary", "frequency", "turns", "first_seen", "last_seen", "importance", "pinned", "weight", "corrected", "confidence")


def links(log: DataFrame, facts: DataFrame, profile: Profile) -> DataFrame:
    """(event_id, graph, source, target, relation_label, weight, frequency): the edges as the log leaves them.

    facts: (id, pos, kind, chunk) of the turns. Relations link nodes that their turn touched, by name; a correction takes
    the edges that its node has by then, and later turns can link it anew."""
    touched = log.where("what = 'node' AND graph = 'entity'").groupBy("event_id", "turn", "at", "name").agg(F.min_by("node", "seq").alias("node"))
    found = extract.relations(facts, ["id"], profile).withColumnRenamed("id", "turn")
    a = touched.select("event_id", "turn", "at", F.col("name").alias("source_text"), F.col("node").alias("source"))
    b = touched.select("event_id", "turn", F.col("name").alias("target_text"), F.col("node").alias("target"))
    entity = found.join(a, ["turn", "source_text"]).join(b, ["event_id", "turn", "target_text"]).where("source <> target")
    entity = entity.select("event_id", F.lit("entity").alias("graph"), "source", "target", "relation_label", "at", "turn")
    causal = log.where("what = 'edge'").select("event_id", "graph", F.col("node").alias("source"), F.col("other").alias("target"), F.lit("causes").alias("relation_label"), "at", "turn")
    dead = log.where("what = 'corrected'").groupBy("node").agg(F.min("at").alias("gone"))
    rows = entity.unionByName(causal)
    for end in ("source", "target"):
        d = dead.select(F.col("node").alias(end), F.col("gone").alias(f"{end}_gone"))
        rows = rows.join(d, end, "left").where(F.col(f"{end}_gone").isNull() | (F.col("at") > F.col(f"{end}_gone")))
    keys = ["event_id", "graph", "source", "target", "relation_label"]
    out = rows.groupBy(*keys).agg(F.count("*").alias("frequency"))
    # causes are inserted once, relations add up
    more = F.when(F.col("graph") == "entity", F.least(F.lit(edges.MAX_WEIGHT), 0.9 * F.col("frequency"))).otherwise(1.0)
    out = out.select(*keys, F.round(more, 6).alias("weight"), F.when(F.col("graph") == "entity", F.col("frequency")).otherwise(1).cast("long").alias("frequency"))
    stages = log.where("what = 'node' AND graph = 'temporal' AND created").select("event_id", F.col("node").alias("id"), "ts", "at", "seq")
    after = edges.follow(stages, "event_id", "id", ["ts", "at", "seq"])
    return out.unionByName(after.select("event_id", F.lit("temporal").alias("graph"), "source", "target", F.lit("after").alias("relation_label"), F.lit(1.0).alias("weight"), F.lit(1).cast("long").alias("frequency")))


def changes(log: DataFrame) -> DataFrame:
    """(memory_id, at, seq, event_id, change, id, by): the change log: events created and updated, nodes created and merged, corrections, and events due for a rebuild."""
    graph = F.col("graph")
    change = (
        F.when(F.col("what") == "assigned", F.when(F.col("created"), "event_created").otherwise("event_updated"))
        .when(F.col("what") == "node", F.concat(graph, F.when(F.col("created"), F.lit("_created")).otherwise(F.lit("_merged"))))
        .when(F.col("what") == "corrected", F.concat(graph, F.lit("_corrected")))
        .when(F.col("what") == "trigger", F.concat(F.lit("rebuild_"), F.col("kind")))
    )
    rows = log.withColumn("change", change).where("change IS NOT NULL")
    return rows.select("memory_id", "at", "seq", "event_id", "change", F.coalesce("node", "event_id").alias("id"), F.coalesce("other", "turn").alias("by"))
