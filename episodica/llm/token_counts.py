"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is what stands between single spaces, with the mark U+2581 before it. Distinct pre-tokens go into a trie;
a node keeps the forward score of its prefix (the best sum of piece scores, ties to fewer pieces) and the number of
pieces of that best split, computed once from the nodes above it for all pre-tokens that share the prefix; where a
pre-token ends, the count is stored. A character that no piece covers counts as its UTF-8 bytes.

The pieces are those of a public sentencepiece vocabulary. Its merge ranks are no probabilities, so a piece's score is
the logarithm of Zipf's law at its rank.

Cases: a null or empty text has no pre-token and no token; texts of any length are counted whole, and a pre-token of
over LONG characters is counted by the same recursion without being stored; repeated rows are counted each; an empty
table gives an empty table; other columns stay, except those named as a result.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import held, per_text

MARK = "▁"
LONG = 200
#: Nodes, and pre-tokens, that a Python worker keeps before it starts anew: some 200 MB.
NODES = 1_500_000
FIELDS = [T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())]


def zipf_scores(model: bytes) -> dict[str, float]:
    """Log probabilities of the normal pieces of a sentencepiece model, by rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = sum(1 / (i + 1) for i in range(len(pieces)))
    return {p: -math.log((i + 1) * total) for i, p in enumerate(pieces)}


class Counter:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) - 10.0  # of one byte that no piece covers
        found: dict[str, set[int]] = {}
        for p in scores:
            if len(p) > 1:
                found.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {end: sorted(n) for end, n in found.items()}  # of the pieces that end in these two characters
        self.clear()

    def clear(self) -> None:
        self.below: dict[int, int] = {}  # (node << 21 | character) to node; node 0 is the root
        self.score, self.pieces = array("d", [0.0]), array("q", [0])  # of each node
        self.counts: dict[str, int] = {}

    def _forward(self, word: str, end: int, path, score: array, pieces: array) -> None:
        """Appends the forward score and pieces of word[:end] to those of its shorter prefixes, which lie at path."""
        scores = self.scores.get
        c, last = word[end - 1], path[end - 1]
        s = scores(c)
        if s is None:
            n = len(c.encode("utf-8", "surrogatepass"))
            best, least = score[last] + n * self.unknown, pieces[last] + n
        else:  # better than its bytes, each of which is below all pieces
            best, least = score[last] + s, pieces[last] + 1
        if end > 1:
            for n in self.lengths.get(word[end - 2 : end], ()):
                if n > end:
                    break
                s = scores(word[end - n : end])
                if s is not None:
                    at = path[end - n]
                    total, k = score[at] + s, pieces[at] + 1
                    if total > best or total == best and k < least:
                        best, least = total, k
        score.append(best)
        pieces.append(least)

    def count(self, word: str) -> int:
        """Pieces of the best split of a pre-token."""
        if len(word) > LONG:
            score, pieces, path = array("d", [0.0]), array("q", [0]), range(len(word))
            for end in range(1, len(word) + 1):
                self._forward(word, end, path, score, pieces)
            return pieces[-1]
        below, score, pieces, node, path = self.below, self.score, self.pieces, 0, [0]
        for end, c in enumerate(word, 1):
            edge = node << 21 | ord(c)
            node = below.get(edge)
            if node is None:
                node = below[edge] = len(score)
                self._forward(word, end, path, score, pieces)
            path.append(node)
        return pieces[node]

    def texts(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.score) > NODES or len(self.counts) > NODES:
            self.clear()
        words = [t.split(" ") if t else [] for t in texts]
        fresh = set(chain.from_iterable(words)).difference(self.counts)
        counts = self.counts
        for w in fresh:
            counts[w] = self.count(MARK + w)
        out = [[len(w) for w in words], [sum(map(counts.__getitem__, w)) for w in words]]
        for w in fresh:
            if len(w) > LONG:
                del counts[w]
        return out


def counter(model: bytes) -> Counter:
    """One for each Python worker."""
    return held(("token_counts", hashlib.sha256(model).digest()), lambda: Counter(zipf_scores(model)))


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_pretokens and n_tokens. No shuffle. The model file (under 1 MB) travels with the tasks."""
    with open(model_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    return per_text(docs, text, FIELDS, lambda: counter(data.value).texts, keep)
