"""Memories by topic: conversations far apart in id meet, where blocks of ids in a row would keep them apart."""

import pytest

from episodica.plans.catalog import QUERIES

Q = "the kitchen smoke alarm rang and the kitchen smoke spread because the kitchen valve was open"


@pytest.fixture(scope="module")
def far_apart(spark, tmp_path_factory):
    """Conversations 0 and 40 about the kitchen, of which 0 goes on, and 1 about something else."""
    path = str(tmp_path_factory.mktemp("topics"))
    said = [(0, 0, Q), (0, 98, Q), (1, 0, "harbour cranes lift harbour crates"), (40, 0, Q)]
    answers = [(0, 1, "the kitchen sprinkler stopped the kitchen smoke"), (0, 99, "the kitchen sprinkler stopped the kitchen smoke"), (1, 1, "harbour"), (40, 1, "kitchen")]
    rows = [(c, t, "user", x) for c, t, x in said] + [(c, t, "assistant", x) for c, t, x in answers]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="module")
def ask(spark, far_apart):
    return lambda name: QUERIES[name](spark, far_apart).collect()


def test_coarse_edges_join_events_of_a_topic(ask):
    assert [(r.memory_id, r.source, r.target) for r in ask("coarse_edges")] == [("kitchen", "0", "40")]


def test_similar_events_of_a_topic(ask):
    assert [(r.memory_id, r.source, r.target) for r in ask("similar_events")] == [("kitchen", "0", "40")]


def test_paths_lead_to_events_of_a_topic(ask):
    assert {(r.query_id, r.event, r.depth) for r in ask("bounded_paths")} == {("kitchen", "0", 0), ("kitchen", "40", 1), ("harbour", "1", 0)}


def test_the_export_has_edges_of_a_topic(ask):
    got = ask("coarse_export")
    assert [r.id for r in got if r.part == "edge"] == ["0>40"]
    assert {(r.memory_id, r.id) for r in got if r.part == "vertex"} == {("kitchen", "0"), ("kitchen", "40"), ("harbour", "1")}


def test_entries_come_from_all_events_of_a_topic(ask):
    assert {r.node_id.split(":")[1] for r in ask("graph_entries") if r.query_id == "40:0"} == {"0", "40"}


def test_local_results_come_from_an_anchor_far_away(ask):
    assert {r.node_id.split(":")[1] for r in ask("local_results") if r.query_id == "40:0"} == {"0"}


def test_context_comes_from_an_anchor_far_away(ask):
    assert ["sprinkler" in r.lines for r in ask("context_lines") if r.query_id == "40:0"] == [True]


def test_the_trace_names_an_anchor_far_away(ask):
    assert {r.query_id: (r.n_events, r.anchor) for r in ask("retrieval_trace")}["40:0"] == (2, "0")


def test_nodes_are_reinforced_by_questions_far_away(ask):
    access = {r.id: r.access for r in ask("reinforced_nodes")}
    assert max(n for i, n in access.items() if i.split(":")[1] == "0") == 3
    assert all(n == 0 for i, n in access.items() if i.split(":")[1] == "40")


def test_events_are_reinforced_by_questions_far_away(ask):
    assert {r.event_id: r.recent for r in ask("reinforced_events")} == {"0": "40:0|0:98|0:0", "1": "1:0", "40": ""}


def test_snapshots_count_a_topic(ask):
    assert {r.memory_id: (r.turns, r.events, r.coarse_edges) for r in ask("snapshot_counts")} == {"kitchen": (3, 2, 1), "harbour": (1, 1, 0)}


def test_the_report_counts_edges_of_a_topic(ask):
    assert [(r.turns, r.events, r.coarse_edges) for r in ask("batch_report")] == [(4, 3, 1)]


def test_events_of_a_topic_are_planned_to_merge(ask):
    assert [tuple(r) for r in ask("merge_plan")] == [("kitchen", "0", "40")]


def test_events_of_a_topic_merge(ask):
    assert {r.event_id: r.turns for r in ask("merged_events")} == {"0": 3, "1": 1}
