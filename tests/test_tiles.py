"""Tiles against plain loops, and how often a row is copied for them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import edges, folds, retrieve, tiles
from episodica.plans.catalog import QUERIES
from episodica.profile import ASCII

WORDS = "smoke alarm kitchen valve pump hose ladder roof door stair cellar engine water foam".split()


def _texts(n: int, seed: int, words: int = 6) -> list[str]:
    r = np.random.default_rng(seed)
    return [" ".join(r.choice(WORDS, words)) for _ in range(n)]


def _cos(a: str, b: str) -> float:
    return float(folds.vector(folds.token_list(a)) @ folds.vector(folds.token_list(b)))


def _jaccard(a: str, b: str) -> float:
    return folds.jaccard(set(folds.token_list(a)), set(folds.token_list(b)))


@pytest.mark.parametrize("tile", [None, 7])
def test_best_nodes_are_those_of_a_plain_loop(spark, tile):
    q, n = _texts(30, 1), _texts(1500, 2, 3)
    both = [("m", f"q{i}", i, folds.token_list(t)) for i, t in enumerate(q)] if tile is None else [("m", f"q{i}", i, folds.token_list(t)) for i, t in enumerate(q[:12])]
    nodes = [("m", f"n{i}", i // 2, folds.token_list(t), 0.5 + (i % 3) / 10, (i % 7) / 10) for i, t in enumerate(n if tile is None else n[:60])]
    left = spark.createDataFrame(both, "memory_id string, id string, ord long, k array<string>")
    right = spark.createDataFrame(nodes, "memory_id string, id string, ord long, k array<string>, importance double, weight double")
    met = tiles.meet(left, right, ["memory_id"], retrieve.node_score, top=8, numbers=([], ["importance", "weight"]), rising=True, tile=tile)
    got = retrieve.top(met, "a", 8, [F.desc("score"), F.col("b_ord"), F.col("b")])
    want = []
    for (_, a, _, _), text in zip(both, q, strict=False):
        s = [(-round(0.52 * max(_cos(text, t), 0) + 0.18 * _jaccard(text, t) + 0.18 * imp + 0.12 * w, 9), o, b) for (_, b, o, _, imp, w), t in zip(nodes, n, strict=False)]
        want += [(a, b, round(-x, 6)) for x, _, b in sorted(s)[:8]]
    assert sorted((r.a, r.b, round(r.score, 6)) for r in got.collect()) == sorted(want)


#: Conversations of one topic, one question each, whose answers make some 700 nodes.
TALKS = 60


@pytest.fixture(scope="module")
def one_topic(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("one-topic"))
    said = [". ".join(f"kitchen {t}" for t in _texts(14, 100 + c, 4)) for c in range(TALKS)]
    rows = [(c, 0, "user", f"what of the kitchen and the kitchen {WORDS[c % len(WORDS)]}") for c in range(TALKS)] + [(c, 1, "assistant", t) for c, t in enumerate(said)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", ["context_lines", "local_results", "reinforced_events", "reinforced_nodes", "retrieval_trace", "graph_entries"])
def test_no_row_is_copied_for_the_search(name, spark, one_topic, monkeypatch):
    """Each node was copied for 512 questions, and each question for 512 nodes."""
    dealt, kind = [], type(spark.range(0))

    def watched(df, *args, f=kind.mapInArrow, **kwargs):
        if {"i", "j", "side", "memory_id"} <= set(df.columns):
            dealt.append(df)
        return f(df, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    assert QUERIES[name](spark, one_topic).count()
    (search,) = dealt
    sides = {r.side: (r.n, r.different) for r in search.groupBy("side").agg(F.count("*").alias("n"), F.countDistinct("id").alias("different")).collect()}
    assert sides[0] == (TALKS, TALKS) and sides[1][0] == sides[1][1] > 512


@pytest.fixture(scope="module")
def alike(spark):
    """1,300 events of one memory, in more than one batch and tile, and three of another."""
    rows = [("m" if i < 1300 else "n", str(i), i, folds.token_list(t), sorted(set(folds.token_list(t))), float(i * 40)) for i, t in enumerate(_texts(1303, 7, 4))]
    e = spark.createDataFrame(rows, "memory_id string, id string, ord long, k array<string>, t array<string>, updated_at double")
    return e.withColumn("keys", F.struct(*[F.array().cast("array<string>").alias(k) for k in ASCII.key_patterns]))


def test_merges_are_those_of_a_walk_over_all_pairs(alike):
    want = folds.merge_plan(edges.similar(alike, ASCII, 0.75))
    got = edges.merges(alike, ASCII, 0.75).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))
    assert 300 < len(got) < 1280  # some go, and more stay than one batch has leaders for


@pytest.mark.parametrize("name", ["merge_plan", "merged_events"])
def test_merges_list_no_pairs(name, spark, one_topic, monkeypatch):
    monkeypatch.setattr(edges, "similar", None)
    assert QUERIES[name](spark, one_topic).count()


def test_paths_need_few_edges(spark, alike):
    """Two memories: in one the first hop finds enough, in the other both hops count."""
    first = [("m", "5"), ("n", "1301")]
    starts = spark.createDataFrame(first, "query_id string, event string")
    relevance = alike.select(F.col("memory_id").alias("query_id"), F.col("id").alias("event"), F.lit(0.5).alias("semantic"), F.lit(0.9).alias("survival"), F.lit(0.5).alias("combined"))
    every = edges.coarse(alike, 21600.0, ASCII)
    links = edges.reached_links(starts, alike, relevance, 21600.0)
    assert links.where("source <> '5' AND target <> '5'").where("source < '1300' AND length(source) < 4").count() == 0
    got, want = (sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in edges.bounded_paths(starts, e, relevance).collect()) for e in (links, every))
    assert got == want and len(got) > 7


@pytest.mark.parametrize("least", [0.24, 0.6])
def test_coarse_pairs_are_counted_without_rows(alike, least):
    want = {r.memory_id: r["count"] for r in edges.coarse(alike, 21600.0, ASCII, least).groupBy("memory_id").count().collect()}
    assert {r.memory_id: r.n for r in edges.count_coarse(alike, 21600.0, least).collect()} == want


def test_the_report_makes_no_pairs(spark, one_topic, monkeypatch):
    monkeypatch.setattr(edges, "coarse", None)
    assert QUERIES["batch_report"](spark, one_topic).collect()[0].coarse_edges == TALKS * (TALKS - 1) // 2


@pytest.mark.parametrize("name", ["coarse_edges", "coarse_export"])
def test_pairs_are_neither_sorted_nor_made_of_copied_tokens(name, spark, one_topic, monkeypatch):
    dealt, kind = [], type(spark.range(0))

    def watched(df, *args, f=kind.mapInArrow, **kwargs):
        dealt.append(df)
        return f(df, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    plan = QUERIES[name](spark, one_topic)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan[: plan.index("MapInArrow")]
    assert dealt[-1].schema["k"].dataType.typeName() == "binary"
