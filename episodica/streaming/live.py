"""The memory of operators.live over a stream: its state in variables with schemas, of which a batch touches what it needs.

A memory's head, the turns that wait for its cold start and its events are read once a batch; an event's nodes only if a
turn comes to it, and only events that changed are written back. Vectors and token sets aren't stored but made from their
texts again. State that isn't written for as long as idle says expires.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.live import TURN, UPDATE, Event, Graph, Memory, Node
from ..profile import Params, Profile

GRAPHS = ("entity", "temporal", "causal")
_TURN_COLUMNS = [c.split()[0] for c in TURN.split(", ")]
_UPDATE_COLUMNS = [c.split()[0] for c in UPDATE.split(", ")]
Turn = namedtuple("Turn", _TURN_COLUMNS)
HEAD = "ready boolean, density double, n int"
EVENT = "ord int, title string, summary string, source string, updated_at double, keys map<string,array<string>>, scores array<double>, texts array<string>, n_nodes int"
NODES = "nodes array<struct<graph:string,id:string,kind:string,name:string,text:string,frequency:int,last_seen:double,importance:double,turns:array<string>,corrected:boolean>>"


class Live(StatefulProcessor):
    def __init__(self, p: Params, profile: Profile, idle_seconds: int | None, rules: dict):
        self.p, self.profile, self.idle, self.rules = p, profile, idle_seconds, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.idle is None else self.idle * 1000
        self.head = handle.getValueState("head", HEAD, ttl)
        self.waiting = handle.getListState("waiting", TURN, ttl)
        self.events = handle.getMapState("events", "event string", EVENT, ttl)
        self.nodes = handle.getMapState("nodes", "event string", NODES, ttl)

    def _load(self, memory_id: str) -> Memory:
        memory = Memory(memory_id, self.p, self.profile, graphs_of=self._graphs, **self.rules)
        if self.head.exists():
            memory.ready, memory.density, memory.n = self.head.get()
        if not memory.ready and self.waiting.exists():
            memory.buffer = [Turn(*x) for x in self.waiting.get()]
        found = []
        if self.events.exists():
            for (event,), x in self.events.iterator():
                ord_, title, summary, source, updated_at, keys, scores, texts, n_nodes = x
                found.append(Event(event, ord_, title, summary, source, updated_at, {k: set(v) for k, v in keys.items()}, list(scores), list(texts), n_nodes, changed=False))
        memory.events = {e.id: e for e in sorted(found, key=lambda e: e.ord)}
        return memory

    def _graphs(self, event: Event) -> dict[str, Graph]:
        graphs = {g: Graph() for g in GRAPHS}
        if self.nodes.containsKey((event.id,)):
            for graph, id_, kind, name, text, frequency, last_seen, importance, turns, corrected in self.nodes.getValue((event.id,))[0]:
                node = Node(id_, kind, name, text, frequency, last_seen, importance, list(turns), corrected)
                # as operators.live makes them: a node's vector is of its first text, its tokens of what it reads now
                embedded = f"{kind} {name}" if graph == "temporal" else name
                graphs[graph].add(node, embedded, text if graph == "causal" else name)
        return graphs

    def _store(self, memory: Memory) -> None:
        self.head.update((memory.ready, float(memory.density), memory.n))
        if not memory.ready:
            self.waiting.put([tuple(t) for t in memory.buffer])
        elif self.waiting.exists():
            self.waiting.clear()
        for e in memory.events.values():
            if e.changed:
                self.events.updateValue((e.id,), (e.ord, e.title, e.summary, e.source, float(e.updated_at), {k: sorted(v) for k, v in e.keys.items()}, [float(x) for x in e.scores], e.texts, e.n_nodes))
                rows = [(g, n.id, n.kind, n.name, n.text, n.frequency, float(n.last_seen), float(n.importance), n.turns, n.corrected) for g in GRAPHS for n in e.graphs[g].nodes]
                self.nodes.updateValue((e.id,), (rows,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        memory, arrived = self._load(key[0]), []
        for batch in rows:
            for t in batch[_TURN_COLUMNS].itertuples(index=False):
                facts = [(f["kind"], f["name"]) for f in t.facts]
                arrived.append(Turn(*t)._replace(at=int(t.at), ts=float(t.ts), density=float(t.density), signal=float(t.signal), facts=facts))
        out = []
        for t in sorted(arrived, key=lambda t: (t.at, t.id)):
            out += memory.add(t)
        self._store(memory)
        frame = pd.DataFrame(out, columns=_UPDATE_COLUMNS)
        yield frame

    def close(self) -> None:
        pass


def updates(turns: DataFrame, p: Params, profile: Profile, idle_seconds: int | None = None, **rules) -> DataFrame:
    """A stream of UPDATE from a stream of TURN: with turns in order, the rows of operators.live.updates for any cut into micro-batches.

    Turns of a micro-batch are applied in order; one that comes in a later batch than its place is applied as things are
    by then. Needs the RocksDB provider of state stores."""
    mode = "None" if idle_seconds is None else "ProcessingTime"
    keyed = turns.select(_TURN_COLUMNS).groupBy("memory_id")
    return keyed.transformWithStateInPandas(Live(p, profile, idle_seconds, rules), UPDATE, "Append", mode)
