"""The ten operators against brute force, and on odd rows."""

import base64
import hashlib
import json
import os
import re
import subprocess
import sys
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from episodica.llm import byte_bpe, chat_format, common, lang_id, media, mixing, queries, secrets, sharding, simhash, token_counts, vector_dedup

RANKS, PIECES, PATTERN = public_tokenizers.path(queries.RANKS), public_tokenizers.path(queries.PIECES), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long, N_TOKENS string"
ODD = [None, "", " ", "a", "  a  b\n\n c\t", "\\</s>[INST] ok", "naïve café \u00a0 ß 漢字 😀", "x" * 3000, "word " * 2000, "\n \n x", "''s 's I'll 123 ½"]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "en", None if i % 3 == 0 else "s", None, "clash") for i, t in enumerate(rows)] + [(1, "", "en", "s", None, "clash")] * 2, DOCS)


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("brute", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# 1


def test_chat_format_reads_back(spark, data):
    got = {r.conv_id: r for r in queries.op1_chat_format(spark, data).collect()}
    rows = spark.read.parquet(f"{data}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    for conv, x in rows.groupby("conv_id"):
        turns = "".join(f"{r}\n{t or ''}\n" for r, t in zip(x.role, x.text))
        loss = "".join(t or "" for r, t in zip(x.role, x.text) if r == "assistant")
        r = got.pop(conv)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(x), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    (r,) = got.values()
    ok = "</s>[INST] ok [/INST]"
    assert (r.conv_id, r.n_turns, r.loss_sha256, r.loss_chars) == (-1, 2, hashlib.sha256(ok.encode()).hexdigest(), len(ok))


@pytest.mark.parametrize("text", ["", "\\", "\\\\[INST]\\", "[\\INST]", "</s></s>[/ROLE]<s>", "[[INST]]", "a\nb"])
def test_escape_is_reversible_and_leaves_no_control(text):
    out = chat_format.escape(text)
    assert chat_format.unescape(out) == text and not any(c in out for c in chat_format.CONTROL)


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"instruction": "a", "input": "i", "output": "b"},
        {"prompt": "a", "response": "b"},
        {"other": 1},
    ]
    rows = [(i, 0, json.dumps(r)) for i, r in enumerate(records)] + [(5, 0, "not json"), (6, 0, None), (0, 1, json.dumps({"system": "s"}))]
    df = chat_format.format_records(spark.createDataFrame(rows, "conv_id long, turn long, record string"))
    layouts = {r.conv_id: r.layout for r in df.where("turn = 0").collect()}
    assert layouts == {0: "messages", 1: "share", 2: "instruction_input", 3: "prompt_response", 4: "unknown", 5: "unknown", 6: "unknown"}
    n = {r.conv_id: r.n_turns for r in chat_format.digests(df).collect()}
    assert n == {0: 3, 1: 2, 2: 2, 3: 2, 4: 1, 5: 1, 6: 0}


def test_no_record_is_lost(spark):
    more = json.dumps({"id": 7, "messages": [{"role": "user", "content": "a", "at": 1}, {"role": "gpt", "content": "b"}]})
    assert chat_format.canonical(more)[::2] == ("messages", [("user", "a"), ("assistant", "b")])
    assert chat_format.canonical(more, {})[2][1] == ("gpt", "b")
    assert chat_format.canonical('{"x": 1}')[::2] == ("unknown", [("record", '{"x": 1}')])
    assert chat_format.canonical("not json")[::2] == ("unknown", [("record", "not json")])
    assert chat_format.canonical("[" * 100_000)[0] == "unknown"
    assert chat_format.canonical('{"messages": {"role": 1, "content": 2}, "instruction": "a", "output": null}')[2] == [("user", "a"), ("assistant", "")]


def test_chat_format_of_odd_rows(spark):
    two = [json.dumps({"instruction": a, "output": b}) for a, b in (("A0", "A1"), ("B0", "B1"))]
    rows = [(1, 0, r, "x") for r in two] + [(1, None, json.dumps({"system": "s"}), "x"), (None, 3, two[0], "x"), (None, 1, two[1], "x"), (2, 0, json.dumps({"prompt": {"text": "y" * 3_000_000}}), None), (1, 0, two[0], "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, record string, ROLE string")
    formatted = chat_format.format_records(df)
    turns = [(r.turn, r.record_order, r.part, r.formatted) for r in formatted.where("conv_id = 1").collect()]
    texts = [chat_format._SEGMENT.findall(t[3])[0][1] for t in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, *t[1:3]))]
    pairs = [("".join(texts[i : i + 2])) for i in (1, 3, 5)]
    assert texts[0] == "s" and sorted(pairs) == ["A0A1", "A0A1", "B0B1"]  # a record's turns stay together
    got = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 7, None: 4, 2: 1}
    assert got[None].turns_sha256 == hashlib.sha256(b"user\nB0\nassistant\nB1\nuser\nA0\nassistant\nA1\n").hexdigest()


def test_chat_format_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, record string")
    assert chat_format.digests(chat_format.format_records(df)).count() == 0


# 2


def test_language_is_found(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = queries.op2_lang_id(spark, data).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out & got.lang.notna()]
    assert len(got) == docs.count() and (held.lang_pred == held.lang).mean() > 0.95
    assert got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()


def test_language_of_odd_texts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en")] * 8 + [("der hund und die katze", "de")] * 8 + [(None, "en"), ("", "de"), ("123 !?", None), ("漢字", None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lang_id.identify(df).collect()}
    assert [got[i].lang_pred for i in (0, 8, 16, 17, 18)] == ["en", "de", "und", "und", "und"]
    assert got[16].score == 0 and got[19].lang_pred in ("de", "en")
    unlabelled = lang_id.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    assert lang_id.identify(df.where("false")).count() == 0


def test_codewords_differ():
    for n in (2, 3, 5, 12):
        code = lang_id.codewords(n)
        assert len({tuple(r) for r in code}) == n


def test_a_text_in_pieces_has_the_grams_of_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    model = lang_id.Model(["a", "b"], lang_id.codewords(2), rng.standard_normal((lang_id.SIZE, 1)).astype(np.float32), np.ones((2, 1)))
    texts = ["abc def " * 50, None, "zz", "", "q" * 500, "a . . . . b", "漢字é " * 30]
    whole = model.margins(texts)
    assert np.allclose(whole, np.concatenate([model.margins([t]) for t in texts]), equal_nan=True)
    for piece in (1, 3, 64):
        monkeypatch.setattr(lang_id, "PIECE", piece)
        assert np.allclose(whole, model.margins(texts), equal_nan=True, atol=1e-9)


def plain_margin(text, weights):
    """Mean log odds over hashed bigrams and trigrams, by plain loops."""
    chars = []
    for c in (text or "").lower():
        if c.isalpha():
            chars.append(ord(c))
        elif chars and chars[-1]:
            chars.append(0)
    if chars and chars[-1]:
        chars.append(0)
    if not chars:
        return None
    total, padded, m = np.zeros(weights.shape[1]), [0, 0, *chars], 1 << 32
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        for h in (b * 0x9E3779B1 + c * 0x85EBCA6B, a * 0xC2B2AE35 + b * 0x27D4EB2F + c * 0x165667B1):
            total += weights[h % m >> 32 - lang_id.BITS]
    return total / (2 * len(chars))


def test_language_by_plain_decoding(spark, data, monkeypatch):
    """Counts, classifiers, trust and decoding of the whole table, by plain loops."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").toPandas()
    training = [r for r in docs.itertuples() if r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    langs = sorted({r.lang for r in training})
    counts = np.zeros((len(langs), lang_id.SIZE))
    for i, lang in enumerate(langs):
        for r in training:
            if r.lang == lang:
                for _, hashed, _ in lang_id.steps([r.text]):
                    counts[i] += np.bincount(hashed, minlength=lang_id.SIZE)
    p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * lang_id.SIZE)
    bits = range(1, 1 << (len(langs) - 1))  # all splits, each once
    code = [[1 if k >> i & 1 else -1 for k in bits] for i in range(len(langs))]
    weights = np.zeros((lang_id.SIZE, len(bits)), np.float32)
    for b in range(len(bits)):
        weights[:, b] = np.log(np.mean([p[i] for i in range(len(langs)) if code[i][b] > 0], 0) / np.mean([p[i] for i in range(len(langs)) if code[i][b] < 0], 0))
    margins = {r.doc_id: plain_margin(r.text, weights.astype(float)) for r in docs.itertuples()}
    trust = []
    for i, lang in enumerate(langs):
        mine = [margins[r.doc_id] for r in training if r.lang == lang and margins[r.doc_id] is not None]
        right = [(sum(np.sign(m[b]) == code[i][b] for m in mine) + 1) / (len(mine) + 2) for b in range(len(bits))]
        trust.append([x / sum(right) for x in right])
    got = {r.doc_id: r for r in queries.op2_lang_id(spark, data).collect()}
    for i, m in margins.items():
        if m is None:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        loss = [sum(trust[k][b] * np.log1p(np.exp(-code[k][b] * np.clip(4 * m[b], -30, 30))) for b in range(len(bits))) for k in range(len(langs))]
        order = np.argsort(loss, kind="stable")
        assert got[i].lang_pred == langs[order[0]] and got[i].score == pytest.approx(1 - loss[order[0]] / loss[order[1]], abs=1e-4)


# 3


def plain_base(text):
    """The base spans by walking the characters, without the library's patterns."""
    out, value, low = [], set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"), "".join(c.lower() if c.isascii() else c for c in text)
    i = 0
    while i < len(text):
        end = 0
        for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if not low.startswith(word, i):
                continue
            j = i + len(word)
            j += text[j : j + 1] in ('"', "'") and text[j : j + 1] != ""
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] not in (":", "="):
                continue
            j += 1
            while text[j : j + 1] == " ":
                j += 1
            j += text[j : j + 1] in ('"', "'") and text[j : j + 1] != ""
            k = j
            while k < len(text) and text[k] in value:
                k += 1
            if k > j:
                end = k
                if k - j >= 6:
                    out.append((i, 0, k))
                break
        i = end or i + 1
    for kind, first, letters, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), (2, "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(text):
            j = i + len(first)
            if text.startswith(first, i) and text[j : j + 1] and text[j] in letters:
                while j < len(text) and text[j] in letters:
                    j += 1
                if j - i >= least:
                    out.append((i, kind, j))
                i = j
            else:
                i += 1
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(out)]


def test_base_spans_follow_the_rules():
    text = "Token : 'abcdef' password=abc token=x=yyyyyy AKIA" + "A" * 16 + " AKIA1 " + "f" * 24 + " " + "a" * 23
    assert plain_base(text) == [("assign", 0, 15), ("assign", 30, 44), ("access", 45, 65), ("hex", 72, 96)]
    more = ["", "secrettoken=abcdef", "TOKEN==abcdefg", "apikey'\"=x", "token=tokentoken=abcdefgh", "pa\u017fsword=abcdef \u212ai", "AKIAAKIA" + "B" * 12, "AKIA" * 6, "xAKIA" + "0" * 15 + "-", "f" * 24 + "g" + "0" * 30, "api_key  :  \"aaaaaa password = b"]
    for t in [text, *more, *(x or "" for x in ODD)]:
        assert [(k, s, e) for s, e, k in secrets.base_spans(t)] == plain_base(t), t


def test_base_spans_of_the_table(spark, data, texts):
    got = {r.doc_id: r for r in queries.op3_secrets(spark, data).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        want = plain_base(t or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[0] == k for x in want) for k in ("assign", "access", "hex"))
        assert [x for x in r.spans.split(",") if x and not x.startswith("random:")] == [x for x in joined.split(",") if x]
    assert sum(r.n_tested for r in got.values()) > sum(r.n_known for r in got.values()) > 0


def test_all_runs_are_measured_and_known_ones_excluded(encoding):
    key = "xK9fQ2mZ8vL4pR7tW1yB5nC3"
    text = f"password={key} and {key}q then {'0a' * 16} internationalization"
    _, every, test = secrets.spans(text, encoding)
    assert (test.tested, test.excluded, test.confirmed) == (4, 1, 1) and test.least < secrets.STRICT
    assert [text[s:e] for s, e, k in every if k == "random"] == [key + "q"]
    _, every, test = secrets.spans(text, encoding, frozenset([key + "q"]))
    assert not [1 for *_, k in every if k == "random"] and test.excluded == 2


def plain_random(text, enc):
    """The spans that the test adds, by a plain walk over characters."""
    def signed(c):
        return c.isascii() and (c.isalnum() or c in "+/_=-" or c in secrets.SIGNS)

    def letter(i):
        return 0 <= i < len(text) and (text[i].isalpha() or unicodedata.combining(text[i]) > 0)

    def words(run):
        pieces = re.findall("[A-Za-z0-9]+", run)
        return all(p.isalpha() and (p == p.lower() or p == p.upper() or p == p.capitalize()) for p in pieces), max(map(len, pieces), default=0)

    def bad(run):
        if len(run) < secrets.FLOOR or secrets.KNOWN.match(run):
            return False
        prose, longest = words(run)
        bar = (1.7 if longest >= 24 else 0) if prose else 1.5 if any(c in secrets.SIGNS for c in run) else 1.6 if run.isalpha() else 2.0
        return len(run) / len(enc.encode_ordinary(run)) < bar

    covered = {i for s, e, _ in secrets.base_spans(text) for i in range(s, e)}
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and signed(text[j]):
            j += 1
        a, b = i, j
        i = j + 1
        if b - a < secrets.FLOOR:
            continue
        if letter(a - 1):
            while a < b and text[a].isalpha():
                a += 1
        if letter(b):
            while a < b and text[b - 1].isalpha():
                b -= 1
        if b - a < secrets.FLOOR:
            continue
        k = a
        while k < b:
            m = k
            while m < b and m not in covered:
                m += 1
            s, e = k, m
            while s < e and text[s] in secrets.SIGNS:
                s += 1
            while e > s and text[e - 1] in secrets.SIGNS:
                e -= 1
            run = text[s:e]
            if any(c in secrets.SIGNS for c in run) and any(c.isalpha() for c in run) and bad(run):
                out.append((s, e))
            else:
                for p in re.finditer("[A-Za-z0-9+/_=-]+", run):
                    if bad(p[0]):
                        out.append((s + p.start(), s + p.end()))
            k = m + 1
    return out


SCALES = [d for d in ("sf0.001", "sf0.01", "sf0.1") if os.path.isdir(f"/root/testdata/{d}")]


@pytest.mark.parametrize("scale", SCALES)
def test_no_prose_of_the_tables_is_taken_for_a_secret(spark, encoding, scale):
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    got = secrets.scan(docs, RANKS, PATTERN, keep=["doc_id", "text"])
    assert got.agg(F.sum("n_random")).first()[0] == 0
    for r in got.where("n_tested > 0").limit(400).collect():
        assert plain_random(r.text, encoding) == []


def test_added_spans_are_those_of_a_plain_walk(encoding):
    import random
    import string

    rng = random.Random(4)
    pools = [string.ascii_letters + string.digits, string.ascii_lowercase, string.ascii_letters, string.ascii_letters + string.digits + "!@#$%", "0123456789abcdef", string.ascii_uppercase + string.digits + "+/-="]
    joins = [" ", "-", "é", ": ", "\n", "!", "_", "ß ", " é", "=", "(", "password="]
    some, n = [], 0
    for _ in range(600):
        text = "".join("".join(rng.choice(rng.choice(pools)) if rng.random() < 0.1 else rng.choice(pool) for _ in range(rng.choice([3, 10, 11, 12, 17, 24, 30, 40]))) + rng.choice(joins) for pool in rng.choices(pools, k=4)) + rng.choice(["Internationalisierung", "ÉAUXPAEAUEUX", "einpftzschtzzuein", "xK9fQ2mZ8vL4pR7tW1yB5nC3"])
        got = [(s, e) for s, e, k in secrets.spans(text, encoding)[1] if k == "random"]
        assert got == plain_random(text, encoding), text
        n += len(got)
        some.append(text)
    assert n > 600


def test_letters_next_to_other_letters_are_words(encoding):
    for text in ("!! ÉAUXPAEAUEUX!!", "einpftzschtzzuein", "ONNTANHMDHK", "esthshhbgbm-tiinthhcfdk", "Eahelyhkdbk", "naïvexqzkwvbnmpt", "xqzkwvbnmpté"):
        assert secrets.spans(text, encoding)[1] == [], text
    text = "é=xK9fQ2mZ8vL4pR7tW1yB5nC3"
    assert [text[s:e] for s, e, _ in secrets.spans(text, encoding)[1]] == ["=xK9fQ2mZ8vL4pR7tW1yB5nC3"]


def test_spans_of_a_text_with_thousands_of_secrets(encoding):
    import time

    def took(n):
        text = " ".join(f"password=abc{i:06d} xK9fQ2mZ8vL4pR7t{i}" for i in range(n))
        began = time.perf_counter()
        secrets.spans(text, encoding)
        return time.perf_counter() - began

    took(100)
    assert took(8000) < 40 * max(took(500), 0.005)


def test_random_strings_are_found_and_known_forms_are_not(encoding):
    text = "key xK9fQ2mZ8vL4pR7tW1yB5nC3 and 123e4567-e89b-12d3-a456-426614174000 or internationalization2024 12345678901234567890123"
    base, every, _ = secrets.spans(text, encoding)
    assert base == [] and [(text[s:e], k) for s, e, k in every] == [("xK9fQ2mZ8vL4pR7tW1yB5nC3", "random")]


def test_short_letter_only_and_signed_random_strings_are_found(encoding):
    sixteen, letters, signed, rest = "xK9fQ2mZ8vL4pR7t", "xKqfQbmZhvLwpRjtWcyB", "vR7#kq9Zx!mT2$wLp", "Zq8vXk2LmP9wRt5B"
    text = f"use {sixteen} or {letters} or {signed} with password=abcdef12/+{rest} {'a1' * 12}{rest}!"
    base, every, _ = secrets.spans(text, encoding)
    found = [text[s:e] for s, e, k in every if k == "random"]
    assert found[:3] == [sixteen, letters, signed] and rest in found[-1]
    prose = "Internationalisation, straightforward, Wirtschaftswissenschaft UNDERSTANDING!!! well-known user@mail snake_case_name"
    assert secrets.spans(prose, encoding)[:2] == ([], [])


def test_scan_and_redact_odd_rows(spark):
    df = odd(spark, [*ODD, "password=abcdef12 " + "0" * 40])
    got = secrets.scan(df, RANKS, PATTERN).collect()
    assert len(got) == df.count() and "N_TOKENS" in got[0].asDict()
    clean = {r.doc_id: r.text for r in secrets.redact(df, RANKS, PATTERN).collect()}
    assert clean[0] is None and clean[len(ODD)] == "[SECRET] [SECRET]" and secrets.redact(df, RANKS, PATTERN).columns == df.columns


# 4


def test_bpe_is_the_library_s(spark, texts, encoding):
    tool = byte_bpe.codec(open(RANKS, "rb").read(), PATTERN)
    rows = [*texts.values(), *ODD]
    for t, ids in zip(rows, tool.encode(rows)):
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(t or "")
        assert tool.decode(ids) == (t or "").encode()


def test_bpe_columns(spark, encoding):
    df = odd(spark)
    got = byte_bpe.encode_documents(df, RANKS, PATTERN, ids=True).collect()
    assert len(got) == df.count() and "N_TOKENS" not in got[0].asDict()  # replaced by the result of that name
    for r in got:
        assert r.token_ids == encoding.encode_ordinary(r.text or "") and r.n_tokens == len(r.token_ids)
    assert byte_bpe.encode_documents(df.where("false"), RANKS, PATTERN).count() == 0


def test_bpe_needs_all_ranks():
    with pytest.raises(ValueError):
        byte_bpe.serialise({b"a": 0})


# 5


def brute_links(vectors, labels, threshold=0.98):
    n, part = len(vectors), list(range(len(vectors)))
    links = [0] * n

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if labels[i] is None or labels[i] != labels[j] or a is None or b is None or len(a) != len(b):
                continue
            a, b = np.array([np.nan if x is None else x for x in a], float), np.array([np.nan if x is None else x for x in b], float)
            if not (np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any()):
                continue
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                part[max(x, y)] = min(x, y)
    return links, [find(i) for i in range(n)]


def test_vector_links(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 16))
    vectors = [(centres[i % 6] + 0.03 * (1 + i % 3) * rng.standard_normal(16)).tolist() for i in range(150)]
    vectors += [vectors[0], vectors[0], [0.0] * 16, None, [float("nan")] * 16, [None] * 16, [], [2 * x for x in vectors[1]], [1.0, 0.0], [1.0, 0.001]]
    labels = [i % 2 for i in range(150)] + [0, 1, 0, 0, 0, 0, 0, 1, 0, 0]
    labels[7] = None
    links, part = brute_links(vectors, labels)
    df = spark.createDataFrame(list(zip(range(len(vectors)), vectors, labels)), "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(len(vectors))] == links
    assert [got[i].component_id for i in range(len(vectors))] == part
    assert all(got[i].kept == (part[i] == i) for i in got)
    assert vector_dedup.near_duplicates(df.where("false")).count() == 0


def test_vector_passes_grow_with_the_label():
    sizes = [0, 1, 1_000, 100_000, 10**7, 10**9, 10**11]
    passes = [vector_dedup.passes_for(n, 0.98) for n in sizes]
    assert passes == sorted(passes) and passes[0] == vector_dedup.LEAST_PASSES < passes[-1] < 100
    for n, k in zip(sizes[3:], passes[3:]):
        assert 1 - (1 - (1 - np.arccos(0.98) / np.pi) ** np.log2(n / vector_dedup.WINDOW)) ** k >= vector_dedup.RECALL


def test_vector_links_of_a_label_with_a_common_mean(spark):
    rng = np.random.default_rng(11)
    pole = np.eye(64)[0]

    def about_pole(x):
        x = x - np.outer(x @ pole, pole)
        return np.sqrt(0.9) * pole + np.sqrt(0.1) * x / np.linalg.norm(x, axis=1, keepdims=True)

    single = about_pole(rng.standard_normal((3000, 64)))
    vectors = np.concatenate([single, about_pole(single[:400] + 0.027 * rng.standard_normal((400, 64)))])
    near = vectors @ vectors.T >= 0.98
    np.fill_diagonal(near, False)
    links = near.sum(1)
    pairs = np.argwhere(near[:400, 3000:])
    assert len(pairs) > 300
    df = spark.createDataFrame(list(zip(range(len(vectors)), vectors.tolist(), [1] * len(vectors))), "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(len(vectors))] == links.tolist()


def test_vector_links_of_large_groups(spark, monkeypatch):
    """Groups over BLOCK are counted about their centre."""
    monkeypatch.setattr(vector_dedup, "BLOCK", 64)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((3, 16))
    vectors = [centres[i % 3] + (0.02, 0.05, 0.09)[i // 3 % 3] * rng.standard_normal(16) for i in range(450)]
    links, part = brute_links(vectors, [0] * 450)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(450)] == list(zip(links, part))


def test_vector_ids_that_repeat_or_lack(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, a, 0), (1, b, 0), (1, a, 0), (2, a, 0), (3, b, 0), (None, a, 0), (None, b, 0), (None, a, 0), (4, [2.0, 0.0], 1), (4, None, 0), (5, a, None)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (4, 0, 4, True), (5, 0, 5, True)] + [(None, 0, None, True)] * 3, key=repr)


def test_vector_links_of_the_table(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").toPandas().sort_values("vec_id")
    links, part = brute_links(list(rows.embedding), [None if x != x else x for x in rows.label])
    ids = rows.vec_id.tolist()
    got = {r.vec_id: r for r in queries.op5_vector_dedup(spark, data).collect()}
    assert [(got[v].n_links, got[v].component_id) for v in ids] == [(n, ids[p]) for n, p in zip(links, part)]


def test_vector_runs_longer_than_the_window(spark):
    rng = np.random.default_rng(12)
    # two far clouds, so tight that nearly all of a cloud shares its keys; each vector has one partner, 300 ids away
    cloud = np.eye(8)[[0, 1] * 150] + 1e-4 * rng.standard_normal((300, 8))
    vectors = np.concatenate([cloud, cloud + 1e-6 * rng.standard_normal((300, 8))])
    df = spark.createDataFrame(list(zip(range(600), vectors.tolist(), [1] * 600)), "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df, threshold=1 - 1e-10).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(600)] == [(1, i % 300) for i in range(600)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50, 90)] + [(3, 1), (2, 3), (7, 7), (90, 50), (-5, 4)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {i: got.get(i, i) for i in (1, 2, 3, 4, 7, 75, 90)} == {1: 1, 2: 1, 3: 1, 4: -5, 7: 7, 75: 50, 90: 50}


def test_planted_links_are_found(spark):
    """Pairs planted at cosines of 0.98 to 0.99 among unlike vectors, as the given tables hold no link: all of 1,200."""
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for label in range(3):
        mean = rng.normal(size=64) * (0, 0.5, 1.5)[label]
        x = rng.normal(size=(4000, 64)) + mean
        x /= np.linalg.norm(x, axis=1)[:, None]
        side = rng.normal(size=(400, 64))
        side -= np.einsum("ij,ij->i", side, x[:400])[:, None] * x[:400]
        side /= np.linalg.norm(side, axis=1)[:, None]
        c = rng.uniform(0.9801, 0.99, 400)[:, None]
        every = np.concatenate([x, c * x[:400] + np.sqrt(1 - c * c) * side])
        ids = np.arange(len(every)) + label * 10_000
        near = every @ every.T >= 0.98
        np.fill_diagonal(near, False)
        want |= {int(i): int(n) for i, n in zip(ids, near.sum(1))}
        rows += [(int(i), v.tolist(), label) for i, v in zip(ids, every)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(df).collect()}
    links = sum(want.values())
    assert links >= 2400 and got.keys() == want.keys() and all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.995 * links


# 6


def test_media_reads_back_what_was_written():
    rng = np.random.default_rng(5)
    payloads = [media.padded(rng.integers(0, 256, n, np.uint8).tobytes()) for n in (0, 1, 63, 64, 65, 500, 6000)] + [media.padded(b"\xff" * 900)]
    files = media.write(payloads)
    images = media.read(files)
    assert [media.payload(i) for i in images] == payloads
    assert media.write(payloads[3:4])[0] == files[3]
    for i, p in zip(images, payloads):
        thumb = media.thumbnail(i)
        assert thumb.shape == (i.down, i.across) and i.width * i.height >= len(p)
    assert media.read([b"", None, b"\xff\xd8\xff", files[4][:120], files[5][: len(files[5]) // 2]]) == [None] * 5


def test_media_decodes_other_tables_and_zero_runs():
    """A block of zero runs, an end of block and a negative value, by hand: DC 5, AC[1] = -3, AC[20] = 2, then zeros."""
    dc, ac = {3: 2, 0: 2}, {0x02: 2, 0x22: 3, 0xF0: 3, 0x00: 3}
    codes_dc, codes_ac = media.huffman_codes(*media._spec(dc)), media.huffman_codes(*media._spec(ac))
    bits = ""
    for codes, symbol, extra in ((codes_dc, 3, "101"), (codes_ac, 0x02, "00"), (codes_ac, 0xF0, ""), (codes_ac, 0x22, "10"), (codes_ac, 0x00, "")):
        code, n = codes[symbol]
        bits += format(code, f"0{n}b") + extra
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    tables = b"".join(media._segment(0xC4, bytes([c << 4, *media._spec(t)[0], *media._spec(t)[1]])) for c, t in ((0, dc), (1, ac)))
    frame = media._segment(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0]))
    data = b"\xff\xd8" + media._segment(0xDB, bytes([0] + [2] * 64)) + tables + frame + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (image,) = media.read([data])
    want = np.zeros(64, int)
    want[0], want[1], want[20] = 5, -3, 2
    assert image.blocks[0].tolist() == want.tolist()


def test_media_decodes_colour_with_two_luminance_blocks_a_unit():
    """Two mcus of luminance 2 x 1, blue and red, DC terms only, in intervals of one mcu; the last luminance block lies outside the image."""
    dc, ac = {4: 2, 0: 2, 3: 3}, {0x00: 1}
    codes_dc, codes_ac = media.huffman_codes(*media._spec(dc)), media.huffman_codes(*media._spec(ac))

    def block(diff):
        n = abs(diff).bit_length()
        code, length = codes_dc[n]
        end, end_length = codes_ac[0]
        return format(code, f"0{length}b") + (format(diff if diff > 0 else diff + (1 << n) - 1, f"0{n}b") if n else "") + format(end, f"0{end_length}b")

    scan = b""
    for m, diffs in enumerate(([8, 5, -4, 0], [-9, 12, 0, 7])):
        bits = "".join(map(block, diffs))
        bits += "1" * (-len(bits) % 8)
        scan += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00") + (b"\xff\xd0" if m == 0 else b"\xff\xd9")
    tables = b"".join(media._segment(0xC4, bytes([c << 4, *media._spec(t)[0], *media._spec(t)[1]])) for c, t in ((0, dc), (1, ac)))
    frame = media._segment(0xC0, bytes([8, 0, 8, 0, 24, 3, 1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0]))
    data = b"\xff\xd8" + media._segment(0xDB, bytes([0] + [16] * 64)) + tables + frame + media._segment(0xDD, b"\0\1") + media._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan
    (image,) = media.read([data])
    assert image.coded[:, 0].tolist() == [8, 13, -4, 0, -9, 3, 0, 7]
    assert media.thumbnail(image).tolist() == [[144, 154, 110]]


def test_media_in_pieces_is_the_same_file(monkeypatch):
    rng = np.random.default_rng(6)
    payloads = [media.padded(rng.integers(0, 256, n, np.uint8).tobytes()) for n in (2048, 2049, 9000, 20_000)]
    whole = [(media.write([p])[0], media._store([p.decode("latin-1")], True)) for p in payloads]
    monkeypatch.setattr(media, "STEP", 2048)
    for p, (data, stored) in zip(payloads, whole):
        assert media.write_long(p) == data
        image = media.parse(data)
        coded = np.concatenate(list(media.decode_long(image, 32)))
        assert (coded == media.read([data])[0].coded).all()
        assert media._store([p.decode("latin-1")], True) == stored
    assert list(media.decode_long(media.parse(data[:5000]), 32))[-1] is None


def test_a_long_text_takes_little_memory():
    """A text of 24 MB in operators that once took a large multiple of it."""
    code = """
import resource, sys
from episodica.llm import lang_id, media, simhash
import numpy as np
text = "lorem ipsum dolor sit amet " * (24 * 2**20 // 27)
model = lang_id.Model(list("abcd"), lang_id.codewords(4), np.zeros((lang_id.SIZE, 7), np.float32), np.full((4, 7), 1 / 7))
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
for run in (lambda: model.predict([text]), lambda: simhash.fingerprint(text), lambda: media._store([text], False)):
    before = peak()
    run()
    print(round(peak() - before))
"""
    out = subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    language, print_, stored = map(int, out.stdout.split())
    assert language < 120 and print_ < 120 and stored < 350, out.stdout


def test_media_columns(spark):
    df = odd(spark)
    for r in media.store_texts(df, media=True).collect():
        raw = (r.text or "").encode()
        full = media.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    back = media.read_media(media.store_texts(df, media=True, keep=["doc_id"]).select("doc_id", "media", F.col("feature").alias("was"))).collect()
    assert all(r.feature == r.was for r in back)
    assert media.store_texts(df.where("false")).count() == 0


# 7


def test_targets(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1), ("c", 10), ("d", 79), (None, 0)], "source string, size long")
    got = {r.source: r for r in mixing.targets(df).collect()}
    # weights 1, 2, 3, 1, 2; b and c stop at 3 and 30, the null source at 0; a stops at 30; d takes the rest
    assert {k: round(r.target, 6) for k, r in got.items()} == {"a": 30.0, "b": 3.0, "c": 30.0, "d": 37.0, None: 0.0}


def test_mix_of_odd_rows(spark):
    df = odd(spark)
    p = mixing.plan(df).toPandas()
    assert len(p) == df.count() and (p.taken <= 3 * p["size"]).all() and p.taken.sum() == pytest.approx(p["size"].sum(), abs=2)
    assert mixing.apply_mix(df).columns == df.columns
    assert mixing.plan(df.where("false")).count() == 0 and mixing.apply_mix(df.where("false")).count() == 0


def test_mix_where_all_rows_have_one_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS", 5)
    few = spark.createDataFrame([(1, "w " * 7, "b"), (2, "w", "b")], "doc_id long, text string, source string")
    for one in (None, 7):
        many = spark.range(3000).select(F.lit(one).cast("long").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 3 + 1).cast("int")).alias("text"), F.lit("a").alias("source"))
        p = mixing.plan(many.unionByName(few)).toPandas()
        assert len(p) == 3002 and (p.taken <= 3 * p["size"]).all()
        for s, g in p.groupby("source"):
            assert g.taken.sum() == round(g.target.iloc[0])
        # whole copies but for one
        a = p[p.source == "a"]
        assert ((a.taken % a["size"]) > 0).sum() <= 1


def test_mix_in_many_buckets_is_the_plain_prefix_sum(spark, data, monkeypatch, duck):
    monkeypatch.setattr(mixing, "ROWS", 7)
    from compare import rows

    df, want = queries.op7_mixing(spark, data), duck.sql(queries.OP7_SQL)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


# 8


def plain_draw(i, level, number, weight):
    seed = 42 if i is None else xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42)
    h = xxhash.xxh64_intdigest(number.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(level.encode(), seed))
    return -np.log(((h >> 11) + 0.5) / 2**53) / weight


def plain_descent(i, nodes, levels=("region", "rack", "shard")):
    """The numbers of the nodes on the way, level by level."""
    if not levels:
        return ()
    best = min(nodes, key=lambda n: plain_draw(i, levels[0], n.number, n.weight))
    return best.number, *plain_descent(i, best.children, levels[1:])


def test_shards_by_brute_force(spark, data, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS", 1)
    got = queries.op8_sharding(spark, data).toPandas()
    # 4 regions of 2 racks of 5 shards, by hand
    now = [sharding.Node(r, 10.0, tuple(sharding.Node(2 * r + k, 5.0, tuple(sharding.Node(10 * r + 5 * k + s, 1.0) for s in range(5))) for k in range(2))) for r in range(4)]
    then = [*now, sharding.Node(4, 1.0, (sharding.Node(8, 1.0, (sharding.Node(40, 1.0),)),))]
    assert tuple(now) == sharding.tree(40, base=40)
    for r in got.itertuples():
        assert (r.region, r.rack, r.shard) == plain_descent(r.doc_id, now)
        assert r.grown_shard == plain_descent(r.doc_id, then)[2]
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    assert set(got[got.shard != got.grown_shard].grown_shard) <= {40}
    texts = dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.size == len((texts[r.doc_id] or "").encode()) + 16 for r in got.itertuples())


def test_a_shard_more_takes_rows_only_into_itself(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    one, two = (sharding.assign(docs, n, base=40).toPandas().set_index("doc_id") for n in (41, 42))
    assert (one.grown_shard == two.shard[one.index]).all()
    moved = one[one.shard != one.grown_shard]
    assert set(moved.grown_shard) == {41} and 40 < len(moved) < 160
    share = one.shard.value_counts()
    assert len(share) == 41 and share.min() > 50 and share.max() < 160


def test_growth_adds_one_region_at_every_number_of_shards(spark):
    for base in (1, 7, 10, 40):
        for n in range(base, 121):
            small, large = sharding.tree(n, base=base), sharding.tree(n + 1, base=base)
            assert large[:-1] == small and [k.number for r in large[-1:] for c in r.children for k in c.children] == [n]
    with pytest.raises(ValueError):
        sharding.tree(3, base=4)
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for n in (9, 49, 50):
        one, two = (sharding.assign(docs, k).toPandas().set_index("doc_id") for k in (n, n + 1))
        assert (one.grown_shard == two.shard[one.index]).all() and set(one[one.shard != one.grown_shard].grown_shard) == {n}


def test_a_weight_moves_rows_only_into_its_subtrees(spark):
    ids = spark.range(3000).select(F.col("id").alias("doc_id"))

    def places(**kind):
        return sharding.descend(ids, sharding.tree(20, base=20, **kind)).toPandas().set_index("doc_id")

    a, b = places(), places(weights={7: 3.0})
    moved = a.index[a["shard"] != b["shard"]]
    # into the region of shard 7; inside it into its rack; inside that into itself
    assert set(b.region[moved]) == {0} and set(b["rack"][moved[a.region[moved] == 0]]) == {1}
    assert set(b["shard"][moved[a["rack"][moved] == 1]]) == {7}
    assert 2 < (b["shard"] == 7).sum() / (a["shard"] == 7).sum() < 4
    assert set(places(weights={i: 0.0 for i in range(10)}).region) == {1}


def test_shards_of_odd_rows(spark):
    df = odd(spark).unionByName(odd(spark).limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = sharding.assign(df, 40).toPandas()
    assert len(got) == df.count() and all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    assert sharding.assign(df.where("false"), 40).count() == 0
    assert sharding.assign(df, 3).count() == len(got)


# 9


def brute_count(word, scores, unknown):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        top = (best[end - 1][0] + n * unknown, best[end - 1][1] + n)
        for start in range(end):
            if word[start:end] in scores:
                total, k = best[start][0] + scores[word[start:end]], best[start][1] + 1
                if total > top[0] or total == top[0] and k < top[1]:
                    top = (total, k)
        best.append(top)
    return best[-1][1]


def test_token_counts(spark, texts):
    model = open(PIECES, "rb").read()
    tool = token_counts.Counter(token_counts.zipf_scores(model))
    rows = [*list(texts.values())[:25], *ODD]
    n_pre, n = tool.texts(rows)
    for t, a, b in zip(rows, n_pre, n):
        words = t.split(" ") if t else []
        assert a == len(words) and b == sum(brute_count(token_counts.MARK + w, tool.scores, tool.unknown) for w in words)
    df = odd(spark)
    assert token_counts.count_tokens(df, PIECES).count() == df.count()
    assert token_counts.count_tokens(df.where("false"), PIECES).count() == 0


# 10


def plain_fingerprint(t):
    words = (t or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 50)
    for t in [*ODD, "A b C d", "one two", "ÄB äb c d"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_links_are_all_pairs_within_two_bits(spark):
    rng = np.random.default_rng(9)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)]
    for f in list(fps[:30]):
        for k in (1, 2, 3):
            bits = rng.choice(64, k, replace=False)
            g = (f & (2**64 - 1)) ^ sum(1 << int(b) for b in bits)
            fps.append(g - 2**64 if g >> 63 else g)
    fps = sorted({*fps, 0, 1, -1, -2})
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    df = spark.createDataFrame([(f,) for f in fps], "__fp long")
    assert {(r.x, r.y) for r in simhash.links(df).collect()} == want and want


def test_near_duplicates_of_odd_rows(spark):
    df = odd(spark)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == df.count()
    for r in got:
        if r.doc_id in (0, 1, 2):  # no words: fingerprint zero
            assert r.fingerprint == "0" * 16 and r.component_id == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.component_id for r in got}
    assert simhash.near_duplicates(df.where("false")).count() == 0


# all


def strange(spark):
    """Null ids and languages, repeated rows, a long text, and columns named as results and as what the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, Spans string, __text string, `a.b` int, feature string, n_tokens int, slot int"
    more = (0.5, "s", "t", 1, "f", 2, 3)
    rows = [(i, t, ("en", "de", None)[i % 3], "s", None, *more) for i, t in enumerate(ODD)]
    rows += [(None, "the cat", "en", None, None, *more), (None, None, None, None, None, *more), (1, "", "de", "s", None, *more), (1, "", "de", "s", None, *more), (99, "wörter und worte " * 70_000, "de", "s", None, *more)]
    return spark.createDataFrame(rows, schema)


APPLIED = {
    "lang_id": lambda d: lang_id.identify(d.select("doc_id", "text", "lang", "score", "Spans")),
    "secrets": lambda d: secrets.scan(d, RANKS, PATTERN),
    "byte_bpe": lambda d: byte_bpe.encode_documents(d, RANKS, PATTERN),
    "media": lambda d: media.store_texts(d),
    "mixing": lambda d: mixing.plan(d),
    "sharding": lambda d: sharding.assign(d, 40),
    "token_counts": lambda d: token_counts.count_tokens(d, PIECES),
    "simhash": lambda d: simhash.near_duplicates(d),
}


def test_chat_and_vectors_with_clashing_columns(spark):
    turns = [(1, 0, json.dumps({"prompt": "a"})), (1, 0, json.dumps({"prompt": "a"})), (1, 1, None), (2, 0, "{"), (None, 0, json.dumps({"prompt": "z " * 50_000}))]
    plain = spark.createDataFrame(turns, "conv_id long, turn long, record string")
    more = plain.select("*", *[F.lit("clash").alias(c) for c in ("role", "text", "layout", "formatted", "n_turns", "seq", "a.b")])
    rows = [sorted(map(repr, chat_format.digests(chat_format.format_records(d)).collect())) for d in (plain, more)]
    assert rows[0] == rows[1] and len(rows[0]) == 3
    assert chat_format.digests(chat_format.format_records(more.where("false"))).count() == 0
    vectors = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (2, [1.0, 0.01], 1), (3, None, 1), (None, [1.0, 0.0], 1), (4, [1.0, 0.0], None)]
    plain = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    more = plain.select("*", *[F.lit("clash").alias(c) for c in ("nid", "unit", "n_links", "component_id", "of", "n", "pass", "copies", "a.b")])
    rows = [sorted(map(repr, vector_dedup.near_duplicates(d).collect())) for d in (plain, more)]
    assert rows[0] == rows[1] and any("n_links=1" in r for r in rows[0])


@pytest.mark.parametrize("name", sorted(APPLIED))
def test_operators_on_strange_rows(spark, name):
    docs, apply = strange(spark), APPLIED[name]
    got = apply(docs)
    rows = got.collect()
    assert len(rows) == docs.count() and len({c.lower() for c in got.columns}) == len(got.columns)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    twice = [tuple(r) for r in rows if r.doc_id == 1]
    if name not in ("sharding", "mixing"):  # there a row's place is its own
        assert twice[-1] == twice[-2]
    assert apply(docs.where("false")).count() == 0
    if "n_chars" in got.columns:  # columns that no result is named like come through
        assert {r["a.b"] for r in rows} == {1} and "__text" in got.columns
