"""The pipeline's stages against plain forms of what they do."""

import base64
import hashlib
import struct

import corpus_pipeline
import pytest
import tiktoken
from test_operators import PATTERN, RANKS, plain_base, plain_fingerprint

from episodica.llm import lang_id, queries, secrets


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def groups(prints):
    """The smallest id that each id reaches by links of two bits or fewer."""
    ids, root = sorted(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def mixed(docs, labels, duck):
    """How often the mix takes each document, from the plan's SQL form."""
    duck.register("kept", docs[["doc_id", "text", "source"]])
    duck.register("labels_", labels)
    sql = queries.OP7_SQL.replace("FROM documents d", "FROM kept d").replace("FROM labels WHERE", "FROM labels_ WHERE")
    plan = duck.sql(sql).df()
    epochs = (plan.target.round() // plan.source_size.where(plan.source_size > 0)).fillna(0)
    return {r.doc_id: int(r.taken / r.size + 0.5) if r.size else int(e) for r, e in zip(plan.itertuples(), epochs)}


def test_the_pipeline_by_plain_steps(spark, data, duck, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows, columns = docs.toPandas(), docs.columns
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality").toPandas()
    stages, made = [], docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, made, data)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == columns
            made = corpus_pipeline.materialize(made)
        stages.append(made.toPandas())
    language, deduped, clean, mix, final = stages

    # 1: all with a letter stay; what a document says of its language stays
    want = rows[[t is not None and any(c.isalpha() for c in t) for t in rows.text]]
    assert sorted(language.doc_id) == sorted(want.doc_id)
    given = dict(zip(rows.doc_id, rows.lang))
    assert all(r.lang == given[r.doc_id] if given[r.doc_id] else r.lang for r in language.itertuples())
    # 2: the smallest of each group
    found = groups({r.doc_id: plain_fingerprint(r.text) for r in language.itertuples()})
    assert sorted(deduped.doc_id) == sorted({c for c in found.values()})
    # 3: no secret by the patterns is left, all else of a text stays in its order
    before = dict(zip(deduped.doc_id, deduped.text))
    assert sorted(clean.doc_id) == sorted(before)
    for r in clean.itertuples():
        old, at = before[r.doc_id], 0
        assert not plain_base(r.text) and r.n_chars == len(r.text)
        for piece in r.text.split("[SECRET]"):
            at = old.index(piece, at) + len(piece)
        covered = plain_base(old)
        assert (r.text == old) == (not covered and not secrets.spans(old, library)[1])
    # 4: as often as the plan's SQL says
    times = mixed(clean, labels, duck)
    assert mix.doc_id.value_counts().to_dict() == {i: n for i, n in times.items() if n}
    # 5: the library's ids
    text = dict(zip(clean.doc_id, clean.text))
    assert sorted(final.doc_id) == sorted(mix.doc_id)
    for r in final.drop_duplicates("doc_id").itertuples():
        ids = library.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_keeps_no_tables_but_the_last(spark, data):
    before = set(corpus_pipeline.written(spark))
    out = corpus_pipeline.run(spark, data)
    assert len(set(corpus_pipeline.written(spark)) - before) == 1 and out.count() > 0


def odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, __fp long, size int, key string, N_TOKENS int"
    more = ("x", 0.5, 7, 3, "k", 1)
    rows = [(1, "the house of stone", "en", "a", 18), (2, None, "en", "a", None), (3, "", None, None, 0), (4, "das Haus aus Stein", "de", None, 18), (4, "das Haus aus Stein", "de", None, 18)]
    rows += [(None, "la maison de pierre", None, "b", 19), (6, "12 34", "en", "b", 5), (7, "the river password=abcdef12 " * 3, "en", "b", 84), (8, "wide " * 200_000, "en", "a", 1_000_000)]
    return spark.createDataFrame([(*r, *more) for r in rows], schema)


def test_stages_on_odd_rows_and_clashing_columns(spark, data):
    docs = odd_documents(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        if name != "byte-level BPE":
            assert out.columns == docs.columns
            assert {(r.lang_pred, r.score, r["__fp"], r.size, r.key, r.N_TOKENS) for r in out.collect()} <= {("x", 0.5, 7, 3, "k", 1)}
        kept[name] = sorted((r.doc_id for r in out.select("doc_id").collect()), key=str)
    every = sorted((r.doc_id for r in docs.collect()), key=str)
    assert kept["language ID"] == sorted([1, 4, 4, None, 7, 8], key=str)
    assert kept["SimHash near-dedup"] == sorted([1, 2, 4, 4, 6, 7, 8, None], key=str)  # 2 and 3 have no word
    assert kept["secret scans"] == kept["byte-level BPE"] == every
    assert set(kept["mixing"]) <= set(every)


def test_stages_on_an_empty_table(spark, data):
    docs = odd_documents(spark).where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        assert out.count() == 0 and (name == "byte-level BPE" or out.columns == docs.columns)


def test_language_keeps_ambiguous_documents(spark, monkeypatch):
    plain = lang_id.predict
    monkeypatch.setattr(lang_id, "predict", lambda *a, **k: plain(*a, **k).selectExpr("* EXCEPT (ambiguous)", "true AS ambiguous"))
    schema = "doc_id long, text string, lang string"
    words = {"aa": "the house of the river and the stone", "bb": "der Fluss und das Haus mit dem Stein"}
    rows = [(i, words[k], k) for i, k in enumerate(["aa", "bb"] * 40)]
    rows += [(102, "12 + 3", "aa"), (103, None, "bb"), (104, "zq", None)]
    docs = spark.createDataFrame(rows, schema)
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert set(kept) == {r[0] for r in rows} - {102, 103}
    assert all(kept[i] == k for i, _, k in rows if k and i in kept) and set(kept.values()) == set(words)


def test_language_keeps_documents_when_nothing_was_learned(spark):
    docs = spark.createDataFrame([(1, "a house", None), (2, "1 2", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in corpus_pipeline.language(spark, docs, "").collect()] == [(1, "a house", "und")]
