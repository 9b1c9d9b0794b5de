"""Rebuilds, merges and stored tables of memories, against plain loops, and what a failing or repeated change leaves."""

import os

import pytest
from pyspark.sql import functions as F
from test_live import Plain, fuse, title

from episodica.operators import folds, live, maintain
from episodica.plans import live_queries as L
from episodica.profile import ASCII as P
from episodica.sources import keyed
from episodica.sources.scratch import materialize

SCHEMA = "id string, n long, text string"


def files(path):
    return {d: sorted(f for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("bucket=")}


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit(0).cast("long").alias("n"), F.lit("a").alias("text"))
    keyed.save(rows, path, ["id"], 16)
    return path


def content(spark, path):
    return {r.id: (r.n, r.text) for r in keyed.load(spark, path, SCHEMA).collect()}


def test_an_upsert_rewrites_only_what_it_touches(spark, stored):
    before, old = files(stored), content(spark, stored)
    change = spark.createDataFrame([("7", 2, "b"), ("7", 1, "x"), ("new", 1, "c"), ("8", -1, "stale"), (None, 1, "nameless")], SCHEMA)
    for _ in range(2):  # a second run changes nothing
        keyed.upsert(spark, stored, SCHEMA, change, ["id"], ["n"], 16)
        assert content(spark, stored) == old | {"7": (2, "b"), "new": (1, "c"), None: (1, "nameless")}
    after = files(stored)
    touched = {f"bucket={r[0]}" for r in change.select(keyed.bucket_of(["id"], 16)).collect()}
    assert 0 < len(touched) < 8 and all(after[d] == before[d] for d in before if d not in touched) and all(after[d] != before.get(d) for d in touched)


def test_a_delete_rewrites_only_what_it_touches(spark, stored):
    before, old = files(stored), content(spark, stored)
    gone = spark.createDataFrame([("7",), ("7",), ("not there",), (None,)], "id string")
    for _ in range(2):
        keyed.delete(spark, stored, SCHEMA, gone, ["id"], 16)
        assert content(spark, stored) == {k: v for k, v in old.items() if k != "7"}
    after = files(stored)
    (hit,) = {d for d in before if before[d] != after[d]}
    bucket = hit.split("=")[1]
    keyed.delete(spark, stored, SCHEMA, keyed.load(spark, stored, SCHEMA).where(f"bucket = {bucket}").select("id"), ["id"], 16)
    assert hit not in files(stored) and keyed.load(spark, stored, SCHEMA).where(f"bucket = {bucket}").count() == 0


def test_a_change_that_fails_leaves_the_table_as_it_was(spark, stored, monkeypatch):
    before, old = files(stored), content(spark, stored)
    change = spark.createDataFrame([("7", 2, "b")], SCHEMA)

    def fails(*_):
        raise RuntimeError

    monkeypatch.setattr(keyed, "materialize", fails)  # before the merged rows are complete
    with pytest.raises(RuntimeError):
        keyed.upsert(spark, stored, SCHEMA, change, ["id"], ["n"], 16)
    monkeypatch.undo()
    monkeypatch.setattr(keyed, "_replace", fails)  # before they replace the stored ones
    with pytest.raises(RuntimeError):
        keyed.upsert(spark, stored, SCHEMA, change, ["id"], ["n"], 16)
    monkeypatch.undo()
    assert files(stored) == before and content(spark, stored) == old
    bad = change.withColumn("text", F.raise_error(F.lit("lost")).cast("string"))  # while tasks run
    with pytest.raises(Exception, match="lost"):
        keyed.upsert(spark, stored, SCHEMA, bad, ["id"], ["n"], 16)
    assert files(stored) == before and content(spark, stored) == old
    keyed.upsert(spark, stored, SCHEMA, change.where("false"), ["id"], ["n"], 16)
    assert files(stored) == before
    keyed.upsert(spark, stored, SCHEMA, change, ["id"], ["n"], 16)
    assert content(spark, stored) == old | {"7": (2, "b")}


def test_changes_between_versions(spark):
    a = spark.createDataFrame([("1", 1, "a"), ("2", 1, "a"), ("3", 1, None), (None, 1, "a")], SCHEMA)
    b = spark.createDataFrame([("1", 1, "a"), ("2", 2, "a"), ("4", 1, "a"), (None, 2, "a")], SCHEMA)
    assert {(r.id, r.change) for r in keyed.changes(a, b, ["id"]).collect()} == {("2", "updated"), ("3", "deleted"), ("4", "created"), (None, "updated")}
    assert keyed.changes(a, a.repartition(3), ["id"]).count() == 0


@pytest.fixture(scope="module")
def memory(spark, data):
    return L.live_log(spark, data)


def test_rebuilt_events_are_those_of_a_plain_loop(memory):
    t, log = memory
    events = {r.event_id: r for r in L._event_rows(log).collect()}
    moves, made = L.rebuilds(t, log)
    of = {r.id: (r.event_id, r.new_event) for r in moves.collect()}
    due = {r.event_id for r in log.where("what = 'trigger'").select("event_id").distinct().collect()}
    assert due and {o for o, _ in of.values()} == due
    turns = {}
    for r in L.placed(t, log).orderBy("at", "id").collect():
        if r.event_id in due:
            turns.setdefault(of[r.id][1], []).append(r)
    want = []
    for name, mine in turns.items():
        texts = [x.text for x in mine]
        plain = Plain(L.PARAMS)
        plain.events.append(None)  # the event is made by hand
        e = plain.create(mine, mine[0])
        old = events.get(name)
        before = (old.title, old.summary) if old else (title(texts), P.join.join(dict.fromkeys(texts[:6]))[:240])
        e["id"], e["title"] = name, title(texts)
        e["summary"] = P.join.join(dict.fromkeys([x for x in [before[1], *texts[:6]] if x][:6]))[:240]
        from test_live import embed

        e["vector"] = embed(f"{e['title']}\n{e['summary']}")
        for x in mine:
            plain.assign(x, e, None)
            plain.apply(x, e)
        want += [r[:2] + r[2:5] if r[2] == "assigned" else r for r in plain.log]
    from test_live import as_plain

    got = [as_plain(r) for r in made.where("what <> 'event'").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and got
    assert made.where("what = 'event'").count() == len(turns)


def test_a_split_makes_two_events(spark, memory):
    t, log = memory
    turns = L.placed(t, log)
    event, n = turns.groupBy("event_id").count().orderBy(F.desc("count")).first()
    assert n >= 4
    mine = turns.where(F.col("event_id") == event)
    last = [r.id for r in mine.orderBy(F.desc("at")).limit(3).collect()]
    scored = mine.select("event_id", "id", F.col("id").isin(last).alias("drifts"))
    moves = maintain.split_plan(scored)
    assert {r.new_event for r in moves.collect()} == {event, f"{event}+{min(last)}"}
    made = live.rebuilt(maintain.rebuild(mine, moves, L._event_rows(log), P), L.PARAMS, P).cache()
    assert {(r.event_id, r.n) for r in made.where("what = 'assigned'").groupBy("event_id").agg(F.count("*").alias("n")).collect()} == {(event, n - 3), (f"{event}+{min(last)}", 3)}
    # every node belongs to one of the two, and says so in its id
    assert all(r.node.startswith(r.event_id + ":") for r in made.where("what = 'node'").collect())


def test_a_rebuild_changes_only_the_events_that_are_due(spark, data, memory):
    due = {r.event_id for r in memory[1].where("what = 'trigger'").select("event_id").distinct().collect()}
    rows = L.drift_rebuilds(spark, data).collect()
    assert {r.event_id.split("+")[0] for r in rows} == due and all(r.reconstructed == 1 for r in rows)
    assert all(r.change == ("created" if "+" in r.event_id else "updated") for r in rows)


def test_merged_events_are_those_of_a_plain_loop(spark, memory):
    t, log = memory
    events = {r.event_id: r for r in L._event_rows(log).collect()}
    plan, e, turns, nodes, links = L.merges(t, log)
    pairs = [(r.kept, r.gone) for r in plan.collect()]
    assert pairs and not {k for k, _ in pairs} & {g for _, g in pairs} and len({g for _, g in pairs}) == len(pairs)
    told = {k: events[k].summary for k, _ in pairs}
    for kept, gone in sorted(pairs, key=lambda p: int(p[1].split("/")[1])):
        told[kept] = fuse([told[kept], events[gone].summary])
    got = {r.event_id: r.summary for r in e.collect()}
    assert set(got) == set(events) - {g for _, g in pairs}
    assert {k: got[k] for k in told} == told and all(got[k] == events[k].summary for k in got if k not in told)
    to = dict((g, k) for k, g in pairs)
    at = {r.turn: r.event_id for r in log.where("what = 'assigned'").collect()}
    assert {r.id: r.event_id for r in turns.collect()} == {i: to.get(x, x) for i, x in at.items()}
    assert all(r.event_id == to.get(r.id.split(":")[0], r.id.split(":")[0]) for r in nodes.collect())
    assert not {r.event_id for r in links.collect()} & set(to)


def test_summaries_are_fused_one_after_the_other(spark):
    rows = [("a", 2, "one two three four"), ("a", 0, "alpha beta"), ("a", 1, " alpha  beta "), ("a", 3, None), ("b", 0, ""), ("b", 1, "x" * 300), ("c", 0, None)]
    got = {r.event_id: r.summary for r in folds.fuse_chain(spark.createDataFrame(rows, "event_id string, ord long, text string"), "; ").collect()}
    assert got == {"a": "alpha beta; one two three four", "b": "x" * 240, "c": ""}


def test_the_log_counts_what_was_done(spark, data, memory):
    t, log = memory
    counts = {}
    for r in L.upkeep_log(spark, data).collect():
        counts[r.change] = counts.get(r.change, 0) + r.n
    moves, made = L.rebuilds(t, log)
    assert counts["event_rebuilt"] == made.where("what = 'event'").count()
    assert counts["event_merge"] == L.merges(t, log)[0].count()
    assert counts["event_created"] == log.select("event_id").distinct().count()
    assert counts["entity_created"] + counts.get("entity_merged", 0) == log.where("what = 'node' AND graph = 'entity'").count()
    assert sum(v for k, v in counts.items() if k.endswith(("compressed", "pruned"))) > 0
