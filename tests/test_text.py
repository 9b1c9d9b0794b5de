"""Golden values of the text rules, with the default profile."""

import math

from pyspark.sql import functions as F

from episodica.functions import text as X
from episodica.functions import vector as V
from episodica.operators import extract, folds
from episodica.profile import DEFAULT as P
from episodica.sources import tables as S


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_tokens(spark):
    r = one(spark, a=X.tokens(F.lit("ab cd")), b=X.token_set(F.lit("东区302 fire A")), c=X.tokens(F.lit("")), d=X.tokens(F.lit("x")), e=X.tokens(F.lit(None).cast("string")))
    assert sorted(r.a) == sorted(["ab", "cd", "ab", "bc", "cd"])
    assert set(r.b) == {"302", "fire", "东", "区", "东区", "区3", "30", "02", "2f", "fi", "ir", "re", "ea"}
    assert r.c == r.d == r.e == []


def test_tokens_of_both_engines_agree(spark):
    texts = ["", "x", "Ab  c\u3000d", "é ü ab", "东 区3", "a" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.tokens(F.col("t")).alias("k")).collect()
    assert all(sorted(r.k) == sorted(folds.token_list(r.t)) for r in got)


def test_overlap_and_importance(spark):
    r = one(
        spark,
        a=X.overlap(X.token_set(F.lit("")), X.token_set(F.lit("ab"))),
        h=X.importance(F.lit("hazard"), P),
        p=X.importance(F.lit("person"), P),
        o=X.importance(F.lit("other"), P),
        d=V.decay(F.lit(21600), 21600),
        n=V.decay(F.lit(-5), 21600),
        z=V.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))),
    )
    assert (r.a, r.h, r.p, r.o, r.z, r.n) == (0.0, 0.65, 0.62, 0.55, 0.0, 1.0)
    assert math.isclose(r.d, 0.5)


def test_modality_and_visual(spark):
    none, path = X.none(), F.array(F.lit("/p/a.jpg"))
    r = one(spark, a=X.modality(none, F.lit("v")), b=X.modality(path, F.lit("")), c=X.modality(path, F.lit("v")), v=X.visual_text(path, F.lit(""), P))
    assert (r.a, r.b, r.c, r.v) == ("text", "image", "text+image", "图像证据:a.jpg")


def test_key_match_and_fence(spark):
    a, b = X.key_entities(F.lit("张某在东区发生火灾"), P), X.key_entities(F.lit("hello"), P)
    r = one(spark, m=X.key_match(a, b, P), s=X.key_match(a, a, P), f=X.strip_fence(F.lit('```json {"a": 1} ```')), t=X.time_or(F.lit("下午"), F.lit(7.0)), n=X.time_or(F.lit("12.5"), F.lit(7.0)))
    assert (r.m, r.s, r.f, r.t, r.n) == (1.0, 1.0, '{"a": 1}', 7.0, 12.5)


def test_density_is_zero_for_blank(spark):
    text = F.lit("起火 疏散 灭火 救援 楼")
    r = one(spark, b=X.density(F.lit(""), X.tokens(F.lit("")), F.lit(""), F.lit(""), P), f=X.density(text, X.tokens(text), F.lit("q"), F.lit("a"), P))
    assert r.b == 0.0 and 0.3 < r.f <= 1.0


def test_extraction(spark):
    text = F.lit("消防员进入东区。因电线老化导致起火；灭火器已用")
    parts = extract.chunks(text, P)
    r = one(spark, c=parts, k=F.transform(parts, lambda c: extract.classify(c, P.classes, P.other_class)), s=extract.stage(parts, P), x=extract.causal(parts, P))
    assert r.c == ["消防员进入东区", "因电线老化导致起火", "灭火器已用"]
    assert r.k == ["person", "material", "equipment"]
    assert r.s == "灭火行动"
    assert (r.x.causal_type, r.x.cause, r.x.effect) == ("direct_cause", "消防员进入东区 电线老化", "起火 灭火器已用")


def test_point_id(spark):
    import uuid

    for t in ("", "a", "turn_东"):
        assert one(spark, i=S.point_id(F.lit(t))).i == uuid.uuid5(uuid.NAMESPACE_DNS, t).hex


def test_hooks(spark):
    from episodica.operators import hooks

    df = spark.createDataFrame([("ab cd", ["x", "y"]), (None, [])], "question string, lines array<string>")
    r = df.select(hooks.embed(F.col("question")).alias("v"), hooks.embed(F.col("question"), lambda b: [[float(len(t))] for t in b]).alias("w")).collect()
    assert abs(sum(x * x for x in r[0].v) - 1) < 1e-9 and not any(r[1].v) and r[0].w == [5.0]
    assert [x.answer for x in hooks.answer(df, None, "K: ", "none", "; ").collect()] == ["K: x; y", "none"]
    assert [x.answer for x in hooks.answer(df, lambda q, c: [f"{a}{len(b)}" for a, b in zip(q, c)], "", "", "").collect()] == ["ab cd2", "0"]


def test_a_reviewer_is_asked_where_something_is_new_and_known(spark):
    import json

    from episodica.operators import hooks

    item = lambda c: {"causal_type": "direct_cause", "cause": c, "effect": "e"}
    rows = [("both", [item("a  x")], [item("b")], "say"), ("again", [item("a")], [item("b")], "say"), ("nothing new", [], [item("b")], "say"), ("nothing known", [item("a")], [], "say"), ("null", None, None, None), ("empty chain", [item("a")], [item("b")], "none"), ("fails", [item("a")], [item("b")], "raise"), ("no json", [item("a")], [item("b")], "what")]
    df = spark.createDataFrame(rows, f"id string, new {hooks.CHAIN}, known {hooks.CHAIN}, text string").withColumn("reason", F.lit("clash"))

    def model(records):
        out = []
        for r in records:
            if r["text"] == "raise":
                raise RuntimeError
            chain = json.loads(r["known"])[::-1] + json.loads(r["new"]) if r["text"] == "say" else []
            out.append(json.dumps({"is_correction": True, "reason": "r", "new_causal_chain": chain}) if r["text"] != "what" else "sorry")
        return out

    got = {r.id: (None if r.chain is None else [c.cause for c in r.chain], r.correction, r.reason) for r in hooks.review(df, model).collect()}
    assert got == {"both": (["b", "a  x"], True, "r"), "again": (["b", "a"], True, "r"), "nothing new": ([], False, ""), "nothing known": (["a"], False, ""), "null": (None, False, ""), "empty chain": (["a"], True, "r"), "fails": (["a"], False, ""), "no json": (["a"], False, "")}
    ruled = {r.id: (r.correction, r.reason) for r in hooks.review(df).collect()}
    assert set(ruled.values()) == {(False, "")} and len(ruled) == len(rows)


def test_state_document_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("m", 1, 2), ("m", 2, 3), ("n", 4, 5)], "memory_id string, source long, target long")
    doc = S.state_document({"temporal": e, "causal": e.where("memory_id = 'n'")})
    doc.write.json(str(tmp_path / "state"))
    back = S.read_state(spark, str(tmp_path / "state"), doc.schema, "temporal")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, e.collect()))
    assert S.read_state(spark, str(tmp_path / "state"), doc.schema, "causal").count() == 1


def test_extraction_by_rules_and_by_a_model(spark):
    import json

    from episodica.operators import hooks
    from episodica.profile import DEFAULT

    turns = spark.createDataFrame([(1, "东区仓库起火，消防员到达。因电线老化导致火势蔓延"), (2, None)], "id long, text string")
    got = {r.id: r.x for r in hooks.extract(turns, ["id"], "text", DEFAULT).collect()}
    assert [(e.kind, e.name) for e in got[1].entities] == [("location", "东区仓库起火"), ("person", "消防员到达"), ("material", "因电线老化导致火势蔓延")]
    assert [(c.causal_type, c.cause[-4:], c.effect) for c in got[1].causal] == [("direct_cause", "电线老化", "火势蔓延")]
    assert {r.source_text: r.target_text for r in got[1].relations} == {"消防员到达": "东区仓库起火", "因电线老化导致火势蔓延": "东区仓库起火"}
    assert got[1].temporal[0].stage_name and got[2].entities == got[2].relations == []

    def model(texts):
        return [json.dumps({"entities": {"person": [t[:2]]}, "temporal": {"stage_name": "s"}, "relations": []}) for t in texts]

    by_model = {r.id: r.x for r in hooks.extract(turns, ["id"], "text", DEFAULT, model).collect()}
    assert [e.name for e in by_model[1].entities] == ["东区"] and by_model[1].temporal[0].stage_name == "s" and by_model[2].entities == []


SUMMARY_ROWS = [
    ("ab  cd", "x", "", ["fire alpha beta", "gamma"], "old", "new one", "local"),
    ("ab  cd", "x", "", ["fire alpha beta", "gamma"], "old", "new one", "local"),
    ("", "", "", [], "", "", ""),
    ("q " * 100, "a", "v", ["one two", "one two", "three", "four", "five", "six", "seven"], "one two", "one two", "one two"),
]


def test_seven_summaries_by_rule_and_by_model(spark):
    from episodica.operators import hooks
    from test_live import fuse, jac, title

    from episodica.profile import ASCII as A

    df = spark.createDataFrame(SUMMARY_ROWS, "question string, answer string, visual string, texts array<string>, previous string, new string, local string")

    def plain(method, r):
        q, a, v, texts, before, new, local = r
        both = lambda: f"{before}{A.join}{new}"[:240]
        head = " ".join(texts[:3])
        return {
            "turn": " ".join(f"{q} {a} {v}".split())[:120],
            "event_title": title(texts) if head or not before else before,
            "event_summary": A.join.join(dict.fromkeys([x for x in [before, *texts] if x][:6]))[:240],
            "fuse_summary": fuse([before, local, *texts[-3:]]),
            "fuse_entity": before if jac(before, new) > 0.7 else both(),
            "fuse_temporal": both(),
            "fuse_causal": before if jac(before, new) > 0.7 else both(),
        }[method]

    assert len(hooks.SUMMARIES) == 7
    for method in hooks.SUMMARIES:
        assert [r.summary for r in hooks.summarise(df, method, A).collect()] == [plain(method, r) for r in SUMMARY_ROWS], method
        got = hooks.summarise(df, method, A, lambda rows: [f"m{len(rows[0])}" for _ in rows]).collect()
        assert [(r.summary, r.summary_tries) for r in got] == [(f"m{len(hooks.SUMMARIES[method][0])}", 1)] * 4


def test_a_model_is_asked_once_for_equal_inputs_and_again_where_it_fails(spark):
    from episodica.operators import hooks
    from episodica.plans.report_queries import stub

    df = spark.createDataFrame([(i, f"t{i % 40}") for i in range(400)], "id long, x string").repartition(3)
    got = hooks.once(df, ["x"], stub(["x"], {"0": 9, "1": 1}), "string", "y", tries=3, batch=4)
    rows = got.collect()
    assert sorted(r.id for r in rows) == list(range(400)) and set(got.columns) == {"id", "x", "y", "y_tries"}
    by = {}
    for r in rows:
        by.setdefault(r.x, set()).add((r.y, r.y_tries))
    assert len(by) == 40 and all(len(v) == 1 for v in by.values())  # one answer for all rows of an input
    import hashlib

    for x, ((y, n),) in by.items():
        digit = hashlib.md5(x.encode()).hexdigest()[0]
        assert (y is None and n == 3) if digit == "0" else y == x + "!" and n <= 3
    assert hooks.once(df.where("false"), ["x"], stub(["x"], {}), "string", "y").count() == 0
