"""The walk over the coarse graph, with what it passes over and why."""

from episodica.operators import edges


def test_every_reason_to_pass_an_event_over(spark):
    e = [("a", "b", 0.9), ("b", "c", 0.8), ("a", "weak", 0.23), ("weak", "b", 0.24), ("a", "unseen", 0.21), ("a", "drift", 0.5), ("drift", "behind", 0.9), ("b", "faded", 0.4), ("a", "unlike", 0.3), ("b", "unlike", 0.9), ("c", "third", 0.9), ("a", "twice", 0.25), ("b", "twice", 0.5)]
    r = {"a": (0.8, 1.0, 0.9), "b": (0.7, 1.0, 0.9), "c": (0.7, 1.0, 0.9), "weak": (0.8, 1.0, 0.9), "unseen": (0.8, 1.0, 0.9), "drift": (0.54, 0.1, 0.05), "behind": (0.8, 1.0, 0.9), "faded": (0.6, 0.15, 0.05), "unlike": (0.56, 0.16, 0.09), "third": (0.8, 1.0, 0.9), "twice": (0.8, 1.0, 0.9)}
    relevance = spark.createDataFrame([("q", k, *v) for k, v in r.items()], "query_id string, event string, semantic double, survival double, combined double")
    starts, links = spark.createDataFrame([("q", "a")], "query_id string, event string"), spark.createDataFrame(e, "source string, target string, score double")
    got = {x.event: (x.depth, x.status, x.reason, round(x.score, 6)) for x in edges.path_trace(starts, links, relevance).collect()}
    assert got == {
        "a": (0, "visited", "", 1.0),
        "b": (1, "visited", "", 0.9),
        "c": (2, "visited", "", 0.72),
        "twice": (2, "visited", "", 0.45),  # its edge from the start is too weak, the one from b isn't
        "weak": (1, "pruned", "edge", 0.23),
        "drift": (1, "pruned", "drift", 0.5),
        "faded": (2, "pruned", "survival", 0.4),
        "unlike": (1, "pruned", "score", 0.3),
    }
    few = {x.event: x.reason for x in edges.path_trace(starts, links, relevance, most=3).collect()}
    assert few["twice"] == "limit" and few["c"] == ""
    assert {x.event for x in edges.bounded_paths(starts, links, relevance).collect()} == {k for k, v in got.items() if v[1] == "visited"}
    assert edges.path_trace(starts.where("false"), links, relevance).count() == 0
