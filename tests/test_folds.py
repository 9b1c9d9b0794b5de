"""Properties of the order-dependent steps."""

import random

from pyspark.sql import functions as F

from episodica.operators import events, folds, maintain, resolve
from episodica.plans.adapters import turns
from episodica.plans.fold_queries import CLUSTER, _facts
from episodica.profile import ASCII as P
from episodica.streaming import ingest

TURNS = "memory_id string, id string, ord long, ts double, text string"


def some_turns(n=40, memories=3, seed=1):
    rng = random.Random(seed)
    words = ["thing", "water", "north", "gate", "alpha", "omega", "brand", "stone"]
    return [(f"m{i % memories}", f"t{i}", i, 1000.0 + 600 * i, " ".join(rng.choices(words, k=6))) for i in range(n)]


def test_clusters_are_those_of_a_plain_loop_and_of_any_partitioning(spark):
    rows = some_turns()
    want = {}
    for m in {r[0] for r in rows}:
        state = folds.Clusters(CLUSTER, P)
        for r in rows:
            if r[0] == m:
                want[r[1]] = state.add(r[4], r[3])
    for parts in (1, 5):
        df = spark.createDataFrame(random.Random(parts).sample(rows, len(rows)), TURNS).repartition(parts)
        assert {r.id: r.cluster for r in folds.cluster_turns(df, CLUSTER, P).collect()} == want


def test_stream_in_batches_gives_the_batch_fold(spark, tmp_path):
    rows = some_turns(30)
    for i in range(3):
        spark.createDataFrame(rows[10 * i : 10 * i + 10], TURNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.read_turns(spark, str(tmp_path / "in"), TURNS)
        ingest.run_once(ingest.assign(stream, CLUSTER, P), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.id: r.cluster for r in spark.read.schema(ingest.RESULT).parquet(str(tmp_path / "out")).collect()}
    assert got == {r.id: r.cluster for r in folds.cluster_turns(spark.createDataFrame(rows, TURNS), CLUSTER, P).collect()}


def test_every_fact_has_one_living_node(spark, data):
    facts = _facts(spark, data)
    out = folds.resolve_nodes(facts, 0.35).toPandas()
    made = set(out[out.created].node)
    assert len(out) == facts.count() and set(out.node) == made and (out[out.created].node == out[out.created].fact_id).all()
    assert (out[~out.created].score >= 0.35).all()


def test_every_valid_turn_is_in_one_cluster(spark, data):
    t = turns(spark, data).where("valid")
    out = folds.cluster_turns(t, CLUSTER, P)
    assert out.count() == t.count() == out.select("id").distinct().count()


def test_merge_plan_is_greedy(spark):
    pairs = [("m", "a", "b", 1, 2), ("m", "a", "c", 1, 3), ("m", "b", "d", 2, 4), ("m", "c", "d", 3, 4), ("n", "x", "y", 1, 2)]
    df = spark.createDataFrame(pairs, "memory_id string, source string, target string, a_ord long, b_ord long")
    assert sorted(map(tuple, folds.merge_plan(df).collect())) == [("m", "a", "b"), ("m", "a", "c"), ("n", "x", "y")]


def test_roll_up_keeps_the_sum_of_frequencies(spark):
    nodes = spark.createDataFrame([("a", 1, 2, 5, 5, 0, 0.5, [1]), ("b", 2, 3, 4, 9, 1, 0.7, [2, 1])], "id string, ord long, frequency long, first_seen long, last_seen long, access long, importance double, turns array<long>")
    into = spark.createDataFrame([("b", "a")], "id string, into string")
    r = resolve.roll_up(nodes, into).collect()
    assert [tuple(x) for x in r] == [("a", 5, 4, 9, 1, 0.7, [1, 2])]


def test_compression_folds_prunes_and_cascades(spark):
    from episodica.functions import text as X
    from episodica.profile import Params

    schema = "event_id string, id string, ord long, kind string, stage string, body string, pinned boolean, weight double, importance double, frequency long, first_seen double, last_seen double, start_time double"

    def nodes(rows):
        rows = [("e", i, o, "k", "s", body, pin, w, imp, 1, float(o), float(o), float(o)) for i, o, body, pin, w, imp in rows]
        return spark.createDataFrame(rows, schema).withColumn("k", X.tokens(F.col("body")))

    same = "water gate north alpha"
    entity = nodes([("a", 1, same, False, 0.1, 0.5), ("b", 2, same, False, 0.1, 0.5), ("c", 3, "stone", False, 0.1, 0.5), ("d", 4, same, False, 0.9, 0.5), ("p", 5, same, True, 0.1, 0.5)])
    temporal = nodes([("t1", 1, same, False, 0.9, 0.5), ("t2", 2, same, False, 0.1, 0.5), ("t3", 3, same, False, 0.9, 0.5), ("t4", 4, "omega", False, 0.1, 0.5), ("t5", 5, "omega", False, 0.1, 0.5)])
    causal = nodes([("x", 1, "why", False, 0.1, 0.5), ("y", 2, "why", True, 0.1, 0.5), ("z", 3, "why", False, 0.1, 0.7)])
    edge = "event_id string, source string, target string"
    links = {"entity": spark.createDataFrame([("e", "c", "b"), ("e", "a", "b")], edge), "temporal": spark.createDataFrame([("e", "t1", "t2"), ("e", "t3", "t4")], edge), "causal": spark.createDataFrame([("e", "x", "y"), ("e", "y", "z")], edge)}
    out, left, log = maintain.compress({"entity": entity, "temporal": temporal, "causal": causal}, links, Params(), P)
    assert {r.id: (r.frequency, r.last_seen, r.body) for r in out["entity"].collect()} == {"a": (2, 2.0, same), "c": (1, 3.0, "stone"), "d": (1, 4.0, same), "p": (1, 5.0, same)}
    # a run goes into its first: t1 and t2 are alike, t2 and t3 too
    assert {r.id: r.frequency for r in out["temporal"].collect()} == {"t1": 3, "t4": 2}
    assert {r.id for r in out["causal"].collect()} == {"y", "z"}
    ends = {g: sorted((r.source, r.target) for r in e.collect()) for g, e in left.items()}
    assert ends == {"entity": [("c", "a")], "temporal": [("t1", "t4")], "causal": [("y", "z")]}
    assert sorted((r.event_type, r.id) for r in log.collect()) == [("causal_pruned", "x"), ("entity_compressed", "b"), ("temporal_compressed", "t2"), ("temporal_compressed", "t3"), ("temporal_compressed", "t5")]


def test_a_node_that_stays_takes_all_that_are_like_it(spark):
    from episodica.functions import text as X

    # a is like b, b like c, c like d, but no others: b goes into a, c stays and takes d
    texts = ["aa ab ac", "ac ad ae", "ae af ag", "ag ah ai"]
    rows = [("e", "k", i, o, t, False, 0.1) for o, (i, t) in enumerate(zip("abcd", texts))]
    n = spark.createDataFrame(rows, "event_id string, kind string, id string, ord long, text string, pinned boolean, weight double").withColumn("k", X.tokens(F.col("text")))
    near = resolve.duplicates(n, ["event_id", "kind"], 0.0).toPandas()
    least = min(near[near.a.map(ord) - near.b.map(ord) == 1].score)
    assert near[near.a.map(ord) - near.b.map(ord) > 1].score.max() < least
    assert sorted(map(tuple, resolve.compression_plan(n, ["event_id", "kind"], least).collect())) == [("b", "a"), ("d", "c")]


def test_tiles_of_any_size_give_the_same_pairs(spark):
    from episodica.functions import text as X
    from episodica.operators import edges, tiles

    rng = random.Random(5)
    words = ["thing", "water", "north", "gate", "alpha", "omega", "brand", "stone"]
    rows = [("one memory", str(i), i, 600.0 * i, " ".join(rng.choices(words, k=4)) if i % 9 else "") for i in range(60)] + [("two", "x", 1, 0.0, "thing")]
    e = spark.createDataFrame(rows, "memory_id string, id string, ord long, updated_at double, text string").withColumn("k", X.tokens(F.col("text"))).drop("text")
    whole = sorted(map(tuple, edges.coarse(e, 21600.0, P).collect()))
    assert len(whole) > 300
    old, tiles.meet.__kwdefaults__["tile"] = tiles.meet.__kwdefaults__["tile"], 7
    try:
        assert sorted(map(tuple, edges.coarse(e, 21600.0, P).collect())) == whole
        best = {r.id: (r.node, r.score) for r in resolve.best_match(e, ["memory_id"], 0.0).collect()}
    finally:
        tiles.meet.__kwdefaults__["tile"] = old
    assert best == {r.id: (r.node, r.score) for r in resolve.best_match(e, ["memory_id"], 0.0).collect()} and len(best) == 59


def test_the_same_tokens_give_the_same_vector_everywhere(spark):
    from episodica.functions import text as X
    from episodica.functions import vector as V
    from episodica.operators import tiles

    texts = ["Water at the gate", "gate gate", "", "漢字 ab"]
    df = spark.createDataFrame([(i, t, texts[0]) for i, t in enumerate(texts)], "id long, a string, b string").select("id", X.tokens(F.col("a")).alias("a"), X.tokens(F.col("b")).alias("b"))
    cos = {r.id: r.cos for r in tiles.cosines(df, "a", "b").collect()}
    sparse = V.hash_embedding(df, ["id"], "a")
    places = {i: {r.idx: r.w for r in sparse.where(F.col("id") == i).collect()} for i in range(4)}
    for i, t in enumerate(texts):
        dense = folds.vector(folds.token_list(t))
        assert {p: round(w, 9) for p, w in places[i].items()} == {p: round(dense[p], 9) for p in range(len(dense)) if dense[p]}
        assert abs(cos[i] - dense @ folds.vector(folds.token_list(texts[0]))) < 1e-9


def test_replays_are_dropped_and_older_turns_are_taken(spark, tmp_path):
    rows = some_turns(12, memories=1)
    stamped = TURNS + ", at timestamp"

    def send(batch):
        made = spark.createDataFrame(batch, TURNS).withColumn("at", F.timestamp_seconds("ts"))
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.timely(ingest.read_turns(spark, str(tmp_path / "in"), stamped), "at", "1 day", ["memory_id", "id"])
        ingest.run_once(ingest.assign(stream, CLUSTER, P), str(tmp_path / "out"), str(tmp_path / "state"))

    send(rows[:4] + rows[6:9])
    send(rows[7:])  # two come again
    send(rows[4:6])  # older than what there is
    got = [r.id for r in spark.read.schema(ingest.RESULT).parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(r[1] for r in rows)


def test_replay_in_batches_is_the_batch_fold(spark, data):
    from episodica.plans.catalog import QUERIES

    key = lambda r: (r.memory_id, r.id)
    once = {key(r): r.cluster for r in QUERIES["cluster_turns"](spark, data).collect()}
    assert {key(r): r.cluster for r in QUERIES["incremental_replay"](spark, data).collect()} == once


def test_one_node_of_all_images_and_descriptions(spark):
    schema = "event_id string, node string, created boolean, ord long, kind string, name string, turn string, ts double, importance double, images array<string>, visual string"
    rows = [("e", "n", True, 1, "k", "gate", "t1", 1.0, 0.5, ["a"], "red"), ("e", "n", False, 3, "k", "the gate", "t2", 9.0, 0.7, ["b", "a"], ""), ("e", "n", False, 2, "k", "gates", "t1", 4.0, 0.6, [], "red")]
    (r,) = resolve.fine_nodes(spark.createDataFrame(rows, schema), "; ").collect()
    assert (r.name, r.frequency, r.first_seen, r.last_seen, r.importance, r.turns, r.images, r.visual) == ("gate", 3, 1.0, 9.0, 0.7, ["t1", "t2"], ["a", "b"], "red")


def test_snapshot_dump(spark, tmp_path):
    from episodica.operators import report

    report.dump(spark.range(3).withColumn("text", F.lit("ß")), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 3


def test_unknown_model_has_no_price(spark):
    usage = spark.createDataFrame([("a", 1000.0, None), ("b", 5.0, 5.0)], "model string, input_tokens double, output_tokens double")
    prices = spark.createDataFrame([("a", 0.5)], "model string, price_per_1k_tokens double")
    assert {r.model: r.total_cost for r in events.price(usage, prices).collect()} == {"a": 0.5, "b": None}


def test_empty_turns(spark):
    df = spark.createDataFrame([], TURNS)
    assert folds.cluster_turns(df, CLUSTER, P).count() == 0
    assert df.select(F.count("*")).first()[0] == 0


def test_corrections_go_by_the_turns_that_say_a_node(spark):
    # id, ord, name, first turn, told, evidence, corrected, turns
    rows = [
        ("old", 1, "north gate", 1, -1, 0.3, False, ["1"]),
        ("with", 2, "water stone", 1, -1, 0.3, False, ["1", "5"]),  # shares a turn with the new one
        ("done", 3, "brand omega", 2, -1, 0.3, True, ["2"]),  # corrected before
        ("strong", 4, "thing place", 2, -1, 0.8, False, ["2"]),  # not weaker by enough
        ("alike", 5, "alpha water thing brands", 2, -1, 0.3, False, ["2"]),
        ("again", 6, "alpha water thing brand", 0, 5, 0.9, False, ["0", "5"]),  # said first of all, and once more with a signal
        ("late", 7, "omega stones", 6, -1, 0.3, False, ["6"]),  # said after the signal
        ("quiet", 8, "gate stone thing", 7, -1, 1.0, False, ["7"]),
    ]
    n = spark.createDataFrame([("e", "k", i, o, name.split() + [a + b for a, b in zip(name, name[1:])], t, told, x, done, (turns,)) for i, o, name, t, told, x, done, turns in rows], "event_id string, kind string, id string, ord long, k array<string>, turn long, told long, evidence double, corrected boolean, keys struct<turns: array<string>>")
    assert {tuple(r) for r in resolve.corrections(n, ["event_id", "kind"]).collect()} == {("old", "again")}
    other = n.withColumn("kind", F.when(F.col("id") == "again", "other").otherwise("k"))
    assert resolve.corrections(other, ["event_id", "kind"]).count() == 0
