"""Byte-level BPE: a sentencepiece BPE model is serialised straight from a rank file, and encodes pre-tokens.

Each byte of a token becomes one letter (U+0100 + byte), so that every piece is plain text without white space;
a piece's score is its negative rank and normalisation is the identity. Sentencepiece then merges, as the rank
file's own library does, the adjacent pair whose union has the lowest rank, leftmost first.

Cases: a null or empty text has no tokens and decodes to no bytes; texts of any length are encoded whole; repeated
rows are encoded each; an empty table gives an empty table; other columns stay, except those named as a result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import held, per_text

FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
#: Bytes, as estimated, of pre-tokens and words that a Python worker remembers before it starts anew.
CACHE_BYTES = 96 << 20
_ENTRY = 190  # of an entry's objects and its place in a dictionary, besides its letters and ids
_LETTERS = [chr(0x100 + b) for b in range(256)]
#: A space beside other white space: only there can a match of the pattern run across the border between a space and what precedes it.
_DOUBLE = re.compile(r" \s|\s ")


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def mapped(token: bytes) -> str:
    return "".join(map(_LETTERS.__getitem__, token))


def unmapped(piece: str) -> bytes:
    """The inverse of mapped()."""
    return bytes(ord(c) - 0x100 for c in piece)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _int(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value & (1 << 64) - 1)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model as sentencepiece reads it: piece 0 is the unknown piece, piece r + 1 the token of rank r."""

    def piece(text: str, score: float, kind: int) -> bytes:
        return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _int(3, kind))

    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("the ranks must be 0, 1, 2 and so on")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a token: {missing}")
    trainer = _int(3, 2) + _int(4, len(order) + 1) + _int(40, 0) + b"".join(_int(f, -1) for f in (41, 42, 43))  # BPE, size, unk 0, no bos, eos, pad
    normaliser = _bytes(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0)
    return b"".join([piece("<unk>", 0.0, 2), *(piece(mapped(t), -float(r), 1) for r, t in enumerate(order)), _bytes(2, trainer), _bytes(3, normaliser)])


class Codec:
    """Encodes and decodes whole texts; remembers at most CACHE_BYTES of distinct pieces of text, besides those of one batch."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex
        import sentencepiece

        self.ranks = parse_ranks(rank_file)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        # what an id stands for: its piece in the model, each letter back to its byte
        self.tokens = [unmapped(self.model.id_to_piece(i + 1)) for i in range(len(self.ranks))]
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.size = 0

    def _pretokens(self, pretokens: set[str]) -> None:
        """Learns the ids of pre-tokens: a whole token at once, else by the model's merges."""
        todo = []
        for p in pretokens:
            rank = self.ranks.get(p.encode())
            if rank is None:
                todo.append(p)
            else:
                self.known[p] = struct.pack("<I", rank)
            self.size += _ENTRY + 2 * len(p)
        coded = self.model.encode([mapped(p.encode()) for p in todo], out_type=int, num_threads=1)
        ids, at = (np.fromiter(chain.from_iterable(coded), "<u4") - 1).astype("<u4").tobytes(), 0
        for p, n in zip(todo, map(len, coded), strict=True):
            self.known[p] = ids[at : at + 4 * n]
            at += 4 * n

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers.

        Text is cut before each single space, where the pattern always starts a match, so that a word seen before
        needs one look-up; a text with other runs of white space goes through the pattern as a whole."""
        if self.size > CACHE_BYTES:
            self.known, self.words, self.size = {}, {}, 0
        known, words = self.known, self.words
        parts: list[tuple[list[str], list[str]]] = []
        for text in texts:
            if not text:
                parts.append(([], []))
            elif _DOUBLE.search(text):
                parts.append((self.split(text), []))
            else:
                first, *rest = text.split(" ")
                parts.append((self.split(first), rest))
        fresh = {w: self.split(" " + w) for w in set(chain.from_iterable(p[1] for p in parts)).difference(words)}
        self._pretokens(set(chain(chain.from_iterable(p[0] for p in parts), chain.from_iterable(fresh.values()))).difference(known))
        for w, pretokens in fresh.items():
            words[w] = b"".join(map(known.__getitem__, pretokens))
            self.size += _ENTRY + 2 * len(w)
        return [b"".join(map(known.__getitem__, a)) + b"".join(map(words.__getitem__, b)) for a, b in parts]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids: the inverse of the byte mapping, token by token."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(rank_file: bytes, pattern: str) -> Codec:
    """One for each Python worker, as the model takes a second to load."""
    return held(("byte_bpe", hashlib.sha256(rank_file).digest(), pattern), lambda: Codec(rank_file, pattern))


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids (array of int). No shuffle.

    The rank file is read here and travels with the tasks (under 1 MB, whatever the input's size)."""
    with open(rank_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        tool = codec(data.value, pattern)

        def compute(texts):
            coded = tool.encode(texts)
            out = [[len(x) // 4 for x in coded], [hashlib.sha256(x).hexdigest() for x in coded], [hashlib.sha256(tool.decode(x)).hexdigest() for x in coded]]
            return out + [[np.frombuffer(x, "<u4").astype("i4") for x in coded]] * ids

        return compute

    return per_text(docs, text, FIELDS + [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * ids, make, keep)
