"""The memory as it grows, against a plain loop over its rules, for any cut into micro-batches, and on odd rows."""

import math
import re

import pytest
from pyspark.sql import functions as F

from episodica.functions.vector import place_and_sign
from episodica.operators import extract, live
from episodica.plans import live_queries
from episodica.plans.graph_memory import memory_turns
from episodica.profile import ASCII as P
from episodica.profile import Params

SPACE = re.compile(r"\s+")


def toks(text):
    low = SPACE.sub(" ", text or "").strip().lower()
    chars = [c for c in low if c in "abcdefghijklmnopqrstuvwxyz0123456789" or "一" <= c <= "鿿"]
    return [w for w in re.findall("[a-z0-9]+", low) if len(w) > 1] + [c for c in chars if c >= "一"] + [a + b for a, b in zip(chars, chars[1:])]


def embed(text):
    v = {}
    for t in toks(text):
        place, sign = place_and_sign(t, 384)
        v[place] = v.get(place, 0.0) + sign
    n = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / n for k, x in v.items()} if n else {}


def cos(a, b):
    return sum(x * b.get(k, 0.0) for k, x in a.items())


def jac(a, b):
    a, b = set(toks(a)), set(toks(b))
    return len(a & b) / len(a | b) if a and b else 0.0


def keys(text):
    return {k: {m[1] if m.re.groups else m[0] for p in ps for m in re.finditer(p, text)} for k, ps in P.key_patterns.items()}


def keyed(a, b):
    a, b = keys(a), keys(b)
    s = [len(a[k] & b[k]) / len(a[k] | b[k]) for k in a if a[k] and b[k]]
    return sum(s) / len(s) if s else 1.0


def fuse(pieces, limit=240):
    kept = []
    for p in pieces:
        if p and all(jac(p, k) <= 0.72 for k in kept):
            kept.append(p)
    return P.join.join(kept)[:limit]


def title(texts):
    head = " ".join(texts[:3])
    for w in P.critical:
        if w in head:
            return w + P.title_suffix
    words = sorted(t for t in set(toks(head)) if len(t) > 1 and t not in P.stop)[:3]
    return " / ".join(words)[:18] if words else head[:18] or P.default_title


def clusters(turns, p):
    """Leader clustering from whole texts and lists of vectors."""
    found = []
    for t in turns:
        best, top = None, -1.0
        for c in found:
            centre = {}
            for v in c["vectors"]:
                for k, x in v.items():
                    centre[k] = centre.get(k, 0.0) + x
            size = math.sqrt(sum(x * x for x in centre.values()))
            s = 0.68 * max(cos(embed(t.text), centre) / size if size else 0.0, 0.0) + 0.22 * jac(t.text, c["text"]) + 0.10 * 2 ** (-abs(c["last"] - t.ts) / p.half_life)
            if keyed(t.text, c["text"]) < 0.3:
                s *= 0.2
            if s > top:
                best, top = c, s
        if best and top >= p.cluster:
            best["turns"].append(t)
            best["vectors"].append(embed(t.text))
            best["text"] += " " + t.text
            best["last"] = max(best["last"], t.ts)
        else:
            found.append({"turns": [t], "vectors": [embed(t.text)], "text": t.text, "last": t.ts})
    return [c["turns"] for c in found]


class Plain:
    """One memory, by lists and whole texts."""

    def __init__(self, p, drift=0.24, legacy=False):
        self.p, self.drift, self.legacy = p, drift, legacy
        self.events, self.wait, self.ready, self.log = [], [], False, []

    def add(self, t):
        if not self.ready:
            self.wait.append(t)
            mean = sum(x.density for x in self.wait) / len(self.wait)
            if t.density >= self.p.density or (mean >= 0.7 * self.p.density and len(self.wait) >= 2) or len(self.wait) >= self.p.cold_start:
                for turns in clusters(self.wait, self.p):
                    e = self.create(turns, t)
                    for x in turns:
                        self.assign(x, e, None)
                        self.apply(x, e)
                    self.update(turns[-1], e)
                self.ready = True
            return
        best, top = None, -1.0
        for e in self.events:
            c, o, age = max(cos(embed(t.said), e["vector"]), 0.0), jac(t.text, f"{e['title']} {e['summary']}"), t.ts - e["at"]
            if self.legacy:
                s = 0.62 * c + 0.22 * o + 0.16 * 2 ** (-max(age, 0) / self.p.half_life)
            else:
                s = 0.52 * c + 0.18 * o + 0.30 * 2 ** (-abs(age) / self.p.half_life) + (0.15 if e is self.events[-1] else 0)
                if keyed(t.text, " ".join(e["seen"])) < 0.3:
                    s *= 0.15
            if round(s, 12) > top:
                best, top = e, round(s, 12)
        if top < self.p.new_event * (0.55 if len(self.events) <= 3 and not self.legacy else 1):
            best = self.create([t], t)
        self.assign(t, best, top)
        self.apply(t, best)
        self.update(t, best)
        mean, n = sum(best["scores"]) / len(best["scores"]), sum(map(len, best["nodes"].values()))
        if n >= 28 or (len(best["scores"]) >= 5 and mean <= self.drift):
            self.log.append((t.id, best["id"], "trigger", round(mean, 6)))
            best["scores"] = []

    def create(self, turns, t):
        texts = [x.text for x in turns]
        summary = P.join.join(dict.fromkeys([x for x in texts[:6] if x]))[:240]
        e = {"id": f"{t.memory_id}/{len(self.events)}", "title": title(texts), "summary": summary, "scores": [], "texts": [], "nodes": {"entity": [], "temporal": [], "causal": []}}
        e |= {"vector": embed(f"{e['title']}\n{summary}\n"), "at": turns[-1].ts, "seen": [f"{e['title']} {summary}"]}
        self.events.append(e)
        return e

    def assign(self, t, e, score):
        c = cos(embed(t.said), e["vector"])
        e["scores"] = (e["scores"] + [c])[-8:]
        e["texts"].append(t.text)
        e["seen"].append(t.text)
        e["at"] = t.ts
        self.log.append((t.id, e["id"], "assigned", None if score is None else round(score, 6), round(c, 6), round(sum(e["scores"]) / len(e["scores"]), 6)))

    def update(self, t, e):
        e["summary"] = fuse([e["summary"], t.local, *e["texts"][-3:]])
        texts = [n["text"] for g in e["nodes"].values() for n in g][-8:]
        e["seen"].append(e["summary"])
        e["vector"] = embed(f"{e['title']}\n{e['summary']}\n{' '.join(texts)}")

    def apply(self, t, e):
        known = {(n["kind"], n["name"].lower()) for n in e["nodes"]["entity"] if not n["dead"]}
        stages = {n["kind"].lower() for n in e["nodes"]["temporal"]}
        entities = [self.put(t, e, "entity", f["kind"], f["name"], self.p.entity_merge) for f in t.facts if (f["kind"], f["name"].lower()) not in known]
        if t.stage.lower() not in stages:
            self.put(t, e, "temporal", t.stage, t.local, self.p.temporal_merge)
        causes = []
        if t.cause and t.effect:
            causes = [self.put(t, e, "causal", "cause", t.cause, self.p.entity_merge), self.put(t, e, "causal", "effect", t.effect, self.p.entity_merge)]
            ends = [None, None]
            for n in e["nodes"]["causal"]:
                for i, x in enumerate((t.cause, t.effect)):
                    if x in n["text"] or n["text"] in x:
                        ends[i] = n["id"]
            if all(ends) and ends[0] != ends[1]:
                self.log.append((t.id, e["id"], "edge", *ends))
        if t.signal >= 0.3:
            for g, touched in (("causal", causes), ("entity", entities)):
                done = []
                for new in touched:
                    if new in done:
                        continue
                    done.append(new)
                    for old in e["nodes"][g]:
                        if old is not new and not old["dead"] and old["kind"] == new["kind"] and not set(old["turns"]) & set(new["turns"]) and cos(old["vector"], new["vector"]) < 0.5 and self.weight(g, new, t) > 1.3 * self.weight(g, old, t):
                            old["dead"] = True
                            self.log.append((t.id, e["id"], "corrected", old["id"], new["id"]))

    def weight(self, g, n, t):
        text = n["text"] if g == "causal" else n["name"]
        signal = min(1, sum(w in text.lower() for w in P.conflicts) / 2)
        base = 0.3 + 0.2 * min(1, n["frequency"] / 5) + 0.2 * n["importance"]
        return min(1, base * (1 + signal + (0.3 if any(w in text for w in P.authority) else 0)) + 0.3 * 2 ** (-max(0, t.ts - n["last"]) / self.p.half_life))

    def put(self, t, e, graph, kind, text, least):
        text = " ".join(text.split())
        best, top = None, -1.0
        for n in e["nodes"][graph]:
            if graph != "causal" and n["kind"] != kind:
                continue
            c = max(cos(embed(text), n["vector"]), 0.0)
            s = round(c if graph == "temporal" else 0.7 * c + 0.3 * jac(text, n["text"] if graph == "causal" else n["name"]), 12)
            if s > top:
                best, top = n, s
        new = best is None or top < least
        weight = 0.5 if graph == "temporal" else round(max(0.05, min(1, 0.5 + P.boosts.get(kind, 0.05))), 4)
        if new:
            best = {"id": f"{e['id']}:{graph[0]}{len(e['nodes'][graph])}", "kind": kind, "name": text, "text": text, "frequency": 0, "importance": weight, "turns": [], "dead": False}
            best["vector"] = embed(f"{kind} {text}" if graph == "temporal" else text)
            e["nodes"][graph].append(best)
        elif graph == "temporal" or jac(best["text"], text) <= 0.70:
            best["text"] = f"{best['text']}{P.join}{text}"[:240]
        best["frequency"] += 1
        best["last"], best["importance"] = t.ts, max(best["importance"], weight)
        best["turns"].append(t.id)
        self.log.append((t.id, e["id"], "node", best["id"], best["text"], new))
        return best


def as_plain(r):
    six = lambda x: None if x is None else round(x, 6)
    return {
        "assigned": lambda: (r.turn, r.event_id, "assigned", six(r.score), six(r.value)),
        "node": lambda: (r.turn, r.event_id, "node", r.node, r.text, r.created),
        "edge": lambda: (r.turn, r.event_id, "edge", r.node, r.other),
        "corrected": lambda: (r.turn, r.event_id, "corrected", r.node, r.other),
        "trigger": lambda: (r.turn, r.event_id, "trigger", six(r.score)),
    }[r.what]()


@pytest.fixture(scope="module")
def said(spark, data):
    from episodica.sources.scratch import materialize

    return materialize(live.prepared(memory_turns(spark, data), P))


PARAMS = [Params(cluster=0.62), Params(cluster=0.62, entity_merge=0.35, new_event=0.6), Params(cluster=0.5, entity_merge=0.3, new_event=0.5, cold_start=2)]


@pytest.mark.parametrize("p", PARAMS, ids=["published", "low", "early"])
@pytest.mark.parametrize("legacy", [False, True])
def test_updates_are_those_of_a_plain_loop(said, p, legacy):
    memories, want, means = {}, [], {}
    for t in said.orderBy("memory_id", "at", "id").collect():
        memories.setdefault(t.memory_id, Plain(p, drift=0.75, legacy=legacy)).add(t)
    for m in memories.values():
        for row in m.log:
            want.append(row[:5] if row[2] == "assigned" else row)
            if row[2] == "assigned":
                means[row[0]] = row[5]
    log = live.updates(said.repartition(7), p, P, drift=0.75, legacy=legacy).cache()
    got = [as_plain(r) for r in log.where("what <> 'event'").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and got
    assert {r.turn: pytest.approx(r.mean8, abs=2e-6) for r in live.assigned(log).collect()} == means
    kinds = {r[0] for r in log.select("what").distinct().collect()}
    assert {"assigned", "node", "event"} <= kinds


def test_tables_of_the_log(said, spark, data):
    p = PARAMS[1]
    log = live.updates(said, p, P).cache()
    nodes = live.nodes(log, 1.8e9, p, P).cache()
    facts = extract.facts(memory_turns(spark, data), ["id"], "text", P)
    links = live.links(log, facts, P).cache()
    ids = {r.id: r for r in nodes.collect()}
    assert nodes.agg(F.sum("frequency")).first()[0] == log.where("what = 'node'").count() > len(ids)
    for e in links.collect():
        assert e.source in ids and e.target in ids and e.source != e.target and 0 < e.weight <= 8
        assert ids[e.source].event_id == ids[e.target].event_id == e.event_id
    # a corrected node has no edge of a turn before or at its correction
    assert {r.node for r in log.where("what = 'corrected'").collect()} == {i for i, r in ids.items() if r.corrected}
    assert all(r.confidence == (0.1 if r.corrected else 1.0) for r in ids.values())
    counts = {r.change: r["count"] for r in live.changes(log).groupBy("change").count().collect()}
    assert counts["entity_created"] == sum(r.graph == "entity" for r in ids.values()) and counts["event_created"] == log.select("event_id").distinct().count()
    per_turn = live.assigned(log).groupBy("turn").count().agg(F.max("count")).first()[0]
    assert per_turn == 1


def test_a_correction_takes_the_edges_until_then(spark):
    rows = [(1, 0, "t1", "e", "edge", "causal", "a", "b"), (2, 0, "t2", "e", "corrected", "causal", "a", "c"), (3, 0, "t3", "e", "edge", "causal", "a", "b"), (1, 1, "t1", "e", "edge", "causal", "a", "d"), (2, 1, "t2", "e", "edge", "causal", "d", "a")]
    log = spark.createDataFrame(rows, "at long, seq int, turn string, event_id string, what string, graph string, node string, other string")
    log = log.selectExpr("'m' AS memory_id", "at", "seq", "turn", "at * 1.0D AS ts", "event_id", "what", "graph", "node", "other", "'' AS kind", "'' AS name", "'' AS text", "0.0D AS score", "0.0D AS value", "false AS created")
    facts = spark.createDataFrame([], "id string, pos int, kind string, chunk string")
    assert [(r.source, r.target) for r in live.links(log, facts, P).collect()] == [("a", "b")]


@pytest.mark.parametrize("cuts", [1, 2, 5])
def test_any_cut_into_micro_batches_gives_the_same_updates(spark, said, cuts):
    p = PARAMS[1]
    want = sorted(map(repr, live.updates(said, p, P, drift=0.75).collect()))
    got = live_queries.streamed_log(spark, said, p, cuts, again=cuts > 1, drift=0.75)
    assert sorted(map(repr, got.collect())) == want


def test_odd_turns(spark):
    rows = [("m", i, f"t{i}", float(i * 600), q, a) for i, (q, a) in enumerate([("", ""), ("  ", "x"), ("an fire thing with that", "not this " * 3000), ("", ""), ("a", ""), ("漢字 ß é", "from there"), ("from a place wha", "from a place wha"), ("", "")])]
    rows += [("m", 3, "t3b", 1800.0, "", ""), (None, 0, "n0", 0.0, "who", "me"), ("lone", 0, "l0", 0.0, "who", "me")]
    t = spark.createDataFrame(rows, "memory_id string, at long, id string, ts double, question string, answer string").withColumn("text", F.concat_ws(" ", "question", "answer"))
    t = t.withColumn("what", F.lit("clash")).withColumn("score", F.lit("clash"))
    log = live.updates(live.prepared(t, P), Params(cold_start=2), P).cache()
    assert {r.turn for r in log.where("what = 'assigned'").collect()} >= {f"t{i}" for i in range(8)} | {"t3b"}
    again = live.updates(live.prepared(t, P).repartition(5), Params(cold_start=2), P)
    assert sorted(map(repr, log.collect())) == sorted(map(repr, again.collect()))
    assert live.updates(live.prepared(t.where("false"), P), Params(), P).count() == 0


def test_drift_is_told_and_clears_the_scores(spark):
    texts = ["alpha beta gamma delta"] * 2 + [f"zz{c}{c}q 9{c}8{c} xx{c}{c}" for c in "abcdefghijkl"]
    t = spark.createDataFrame([("m", i, f"t{i:02}", 0.0, x, "") for i, x in enumerate(texts)], "memory_id string, at long, id string, ts double, question string, answer string").withColumn("text", F.col("question"))
    log = live.updates(live.prepared(t, P), Params(cold_start=1, new_event=0.0), P, drift=0.9).cache()
    due = log.where("what = 'trigger' AND kind = 'drift'").orderBy("at").collect()
    assert due and all(b.at - a.at >= 5 for a, b in zip(due, due[1:]))
    assert {r.how for r in live.assigned(log).collect()} == {"cold", "routed"}
