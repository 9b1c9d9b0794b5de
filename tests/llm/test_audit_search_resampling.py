"""Filter audit, multi-index search and importance resampling against brute force, and on odd rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import rows
from pyspark.sql import functions as F

from episodica.llm import filter_audit, importance, multi_index, queries

WORDS, SPACED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "a", "A B C d", "Ünï-x y 12 Z", "x" * 5000 + " q", "one two three four " * 12, "wort " * 60, "w" + " a b" * 30, "ÄÖ" * 200 + " ends", "£ $ 5", "漢字 " * 25]


def strange(spark):
    """Null ids, repeated rows and ids, ties, a very long text, and columns named as results."""
    schema = "doc_id long, text string, source string, part string, n long, mask string, rank int, weight string, `a.b` int"
    more = ("p", 1, "m", 2, "w", 3)
    found = [(i, t, ("s", None, "")[i % 3], *more) for i, t in enumerate(TEXTS)]
    found += [(None, "the cat", "s", *more), (None, "the cat", None, *more), (None, None, None, *more), (3, "a", "s", *more), (3, "a", "s", *more), (70, "a", "t", *more), (71, "a", "t", *more)]
    found += [(99, " ".join(f"wörd{i % 5000}" for i in range(300_000)), "s", *more), (99, "other text", "t", *more)]
    return spark.createDataFrame(found, schema)


# 11


def brute_audit(docs, labels):
    least, table = {}, []
    for i, text, part in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, part in docs:
        t = text or ""
        w = SPACED.findall(t)
        fails = (
            len(w) < 50,
            100 * len(set(w)) < 65 * len(w),
            100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            bool(re.search(r"[#$%&*|]", t)),
            i is not None and i > least[t],
        )
        marks = labels.get(i, ()) if i is not None else ()
        table.append((part or "", {c for c, f in zip("ABCDE", fails) if f}, any(q == 1 for q, _ in marks), any(x == 1 for _, x in marks)))
    out, shapley = [], Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for step, letter in enumerate(order):
            earlier = set(order[:step])
            for part in {r[0] for r in table}:
                mine = [r for r in table if r[0] == part]
                fails = [r for r in mine if letter in r[1]]
                removed = [r for r in fails if not r[1] & earlier]
                shapley[part, letter] += len(removed)
                kept = sum(not r[1] & {*earlier, letter} for r in mine)
                out.append((part, order, step + 1, kept, len(removed), len(fails) - len(removed), sum(r[1] == {letter} for r in mine), sum(r[2] for r in removed), sum(r[3] for r in removed)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_is_the_sql(spark, data, duck):
    df = queries.op11_filter_audit(spark, data)
    want = duck.sql(queries.ORACLE_SQL["op11_filter_audit"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_audit_of_strange_rows(spark):
    docs = strange(spark)
    marks = [(3, 1, 0), (3, None, 1), (4, 0, 1), (None, 1, 1), (99, 1, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    by = {}
    for i, q, t in marks:
        by.setdefault(i, []).append((q, t))
    got = sorted(tuple(r) for r in filter_audit.audit(filter_audit.cells(docs, labels)).select(COLUMNS).collect())
    assert got == brute_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], by)
    assert filter_audit.audit(filter_audit.cells(docs.where("false"), labels)).count() == 0
    assert filter_audit.audit(filter_audit.cells(docs), "AE").count() == 4 * 3


def test_words_by_pieces(monkeypatch):
    monkeypatch.setattr(filter_audit, "PIECE", 7)
    for t in TEXTS:
        w = SPACED.findall(t or "")
        assert filter_audit.words((t or "").encode()) == (len(w), len(set(w)))


# 12


def nearest(ids, vectors, k, every=20):
    want = {}
    for i, q in zip(ids, vectors):
        if i % every == 0:
            found = sorted((-float(q @ v), j) for j, v in zip(ids, vectors) if j != i)
            want[i] = [j for _, j in found[:k]]
    return want


def recall(got, want):
    have = {}
    for r in got:
        have.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(len(have.get(q, set()) & set(v)) for q, v in want.items()) / sum(map(len, want.values()))


def test_search_finds_the_nearest_of_the_table(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = [r.vec_id for r in table], np.array([r.embedding for r in table], np.float64)
    got = queries.op12_ann_search(spark, data).collect()
    want = nearest(ids, vectors, 20)
    assert {(r.query_id, r["rank"]) for r in got} == {(q, i) for q in want for i in range(1, 21)} and len(got) == 20 * len(want)
    assert recall(got, want) >= 0.9
    place = {i: v for i, v in zip(ids, vectors)}
    for r in got:
        assert r.score == pytest.approx(float(place[r.query_id] @ place[r.vec_id]), abs=1e-14)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert all(v == sorted(v) for v in by.values())


def test_search_with_many_copies_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 256)
    monkeypatch.setattr(multi_index, "ASIDE", 40)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 9)) * 3
    vectors = np.concatenate([centres[rng.integers(0, 12, 1400)] + rng.normal(size=(1400, 9)) * 0.4, np.repeat(centres[:1], 700, axis=0)])
    ids = rng.permutation(len(vectors))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    got = multi_index.search(df.repartition(5), k=10).collect()
    want = nearest(ids.tolist(), vectors, 10)
    assert recall(got, want) >= 0.9 and len(got) == 10 * len(want)
    again = multi_index.search(df.repartition(3), k=10).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    # ties among the copies go by the smaller id
    copies = sorted(int(i) for i, v in zip(ids, vectors) if (v == centres[0]).all())
    asked = [c for c in copies if c % 20 == 0]
    for q in asked[:3]:
        equal = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q and r.vec_id in set(copies)]
        assert equal == [c for c in copies if c != q][: len(equal)]


def test_search_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 1.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0])]
    odd += [(7, [1.0, 1.0]), (8, []), (None, [1.0, 1.0, 1.0]), (20, [-1.0, 0.5, 0.0]), (40, [1.0, 0.0, 2.0])]
    df = spark.createDataFrame([(*r, "c", 1) for r in odd], "vec_id long, embedding array<float>, score string, rank int")
    got = sorted(tuple(r) for r in multi_index.search(df).collect())
    assert got == [(0, 1, 1, 5.0), (0, 2, 40, 5.0), (0, 3, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -1.0), (20, 3, 40, -1.0), (40, 1, 0, 5.0), (40, 2, 1, 5.0), (40, 3, 20, -1.0)]
    assert multi_index.search(df.where("false")).count() == 0
    assert multi_index.search(df.where("vec_id = 0")).count() == 0


def test_traversal_is_by_summed_distance():
    rng = np.random.default_rng(1)
    made = multi_index.Index(rng.normal(size=(7, 4)), rng.normal(size=(5, 3)), rng.integers(0, 3, 35))
    q = rng.normal(size=7)
    order = list(made.traverse(q))
    products = [float(made.left[c // 5] @ q[:4] + made.right[c % 5] @ q[4:]) for c in order]
    assert sorted(order) == np.flatnonzero(made.counts).tolist() and all(a >= b - 1e-12 for a, b in zip(products, products[1:]))


# 13


def features(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORDS.findall(lower)
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resampling(docs, target):
    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10_000) / ((s[b] + 1) * (sum(t.values()) + 10_000)))) for b in range(10_000)]
    out, drawn = [], []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= 20:
            drawn.append(out[-1])
    drawn.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(drawn[: 5 * len(drawn) // 100]):
        r[4] = rank + 1
    return sorted(map(repr, out))


def test_resampling_of_the_table(spark, data):
    got = queries.op13_importance_resampling(spark, data)
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    want = brute_resampling(docs, target)
    assert sorted(repr(list(r)) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == want
    assert got.where("rank IS NOT NULL").count() > 0


def test_resampling_of_strange_rows(spark, monkeypatch):
    monkeypatch.setattr(importance, "ROWS", 40)
    docs = strange(spark)
    more = docs.where("doc_id = 7").withColumn("doc_id", F.explode(F.sequence(F.lit(100), F.lit(250)))).unionByName(docs.where("doc_id = 7").withColumn("doc_id", F.explode(F.array_repeat(F.lit(300).cast("long"), 60))))
    docs = docs.select("doc_id", "text", "rank", "weight").unionByName(more.select("doc_id", "text", "rank", "weight"))
    target = spark.createDataFrame([("one two three x",), (None,), ("",)], "text string")
    got = importance.resample(docs, target)
    want = brute_resampling([(r.doc_id, r.text) for r in docs.collect()], ["one two three x", None, ""])
    assert sorted(repr(list(r)) for r in got.collect()) == want
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 5
    assert importance.resample(docs.where("false"), target).count() == 0
    assert importance.resample(docs, target.where("false")).count() == docs.count()


def test_checksums_of_spans():
    checksums, rng = importance.Checksums(), np.random.default_rng(3)
    buffer = rng.integers(0, 256, 70_000).astype(np.uint8)
    data = buffer.tobytes()
    lengths = np.array([1, 2, 3, 4, 5, 63, 64, 65, 127, 128, 129, 191, 1000, 4096, 4097, 65_535], np.int32)
    starts = np.arange(len(lengths), dtype=np.int32) * 7
    assert [int(x) for x in checksums.spans(buffer, starts, lengths)] == [zlib.crc32(data[s : s + n]) for s, n in zip(starts.tolist(), lengths.tolist())]
