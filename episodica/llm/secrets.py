"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Prose and names fall into few tokens of a tiktoken vocabulary, random strings into many. So a run of key characters
whose characters per token are below RATIO is a secret of kind "random", unless it is one of the strings given as known,
or has the form of a digest or identifier (hexadecimal digest lengths, UUIDs, dates, plain numbers). A run with other
signs in it must be below STRICT, one of letters in mixed case below MIXED. A run of letters cased like words, between
signs if there are some, is prose: words of invented or rare languages have ratios as low as random letters, so such a
run is a secret only from LONG letters on and below WORDY. Letters that touch a letter outside ASCII belong to its word
and aren't part of any run. Every run of FLOOR characters is
measured: n_tested counts them, n_known those that are excluded, n_confirmed those that are random by this test and met
by a pattern's span too, least_ratio is the lowest ratio of characters per token of a run that isn't excluded. Of a run
that meets spans of the patterns, the rest makes spans of its own if it passes the test.
What the ratio doesn't tell from words is not found: letters of one case below LONG, runs below FLOOR characters, and runs
cut to less by spaces, dots, brackets, quotes, colons, commas or other letters than ASCII.

Cases: a null or empty text has no span; texts of any length are scanned whole; overlapping matches of one kind are
taken leftmost, and kinds don't compete; repeated rows are scanned each; an empty table gives an empty table; other
columns stay, except those named as a result. Places are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .byte_bpe import parse_ranks
from .common import held, per_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is one match, so runs of 24 and more are the matches that stay
KINDS = ("assign", "access", "hex", "random")

SIGNS = "!@#$%^&*~?"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=!@#$%^&*~?-]+")
KEY = re.compile(r"[A-Za-z0-9+/_=-]+")
WORD = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)\Z")
BETWEEN = re.compile(r"[^A-Za-z0-9]+")
LETTERS_FIRST, LETTERS_LAST = re.compile(r"[A-Za-z]*"), re.compile(r"[A-Za-z]*\Z")
#: Characters a token below which a run counts as random. Base64 noise has about 1.4, hexadecimal noise 1.6, words over 2.5.
RATIO = 2.0
#: The same for runs with other signs, for letters in mixed case, and for LONG letters and more cased like a word. Set by
#: the given tables: of 976,000 different runs of letters, those of mixed case have 2.0 and more, those of 23 letters and
#: more 2.09 and more, and shorter ones cased like words as little as 1.1.
STRICT, MIXED, WORDY = 1.5, 1.6, 1.7
LONG = 24
#: The shortest run that the ratio tells from words.
FLOOR = 11
#: Forms of digests and identifiers that are public by nature.
KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+|\d{4}-\d\d-\d\dT?[\d-]*Z?)\Z"
)
def encoding(rank_file: bytes, pattern: str):
    """One for each Python worker."""

    def make():
        import tiktoken

        return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=parse_ranks(rank_file), special_tokens={})

    return held(("secrets", hashlib.sha256(rank_file).digest(), pattern), make)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


def _merged(base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The stretches that base spans, in order of their starts, cover."""
    out: list[tuple[int, int]] = []
    for s, e, _ in base:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


@dataclass
class Test:
    """The token-efficiency test over the runs of one text."""

    enc: object
    known: frozenset[str]
    tested: int = 0
    excluded: int = 0
    confirmed: int = 0
    least: float | None = None
    last: tuple[str, int] = ("", 0)

    def tokens(self, run: str) -> int:
        if run != self.last[0]:
            self.last = (run, len(self.enc.encode_ordinary(run)))
        return self.last[1]

    def bar(self, run: str) -> float:
        """The characters a token that run must be below."""
        pieces = [p for p in BETWEEN.split(run) if p]
        if all(map(WORD.match, pieces)):
            return WORDY if max(map(len, pieces), default=0) >= LONG else 0.0
        if KEY.fullmatch(run) is None:
            return STRICT
        return MIXED if run.isalpha() else RATIO

    def random(self, run: str) -> bool:
        if len(run) < FLOOR or run in self.known or KNOWN.match(run):
            return False
        bar = self.bar(run)
        return bar > 0 and len(run) < bar * self.tokens(run)

    def measure(self, run: str, met: bool) -> None:
        """Counts a whole run, whether or not a pattern's span meets it."""
        self.tested += 1
        if run in self.known or KNOWN.match(run):
            self.excluded += 1
            return
        ratio = len(run) / self.tokens(run)
        self.least = ratio if self.least is None else min(self.least, ratio)
        self.confirmed += met and ratio < self.bar(run)


def letter(text: str, at: int) -> bool:
    """Whether a letter, or a mark on one, is at a place of text; next to a run it is one outside ASCII."""
    return 0 <= at < len(text) and (text[at].isalpha() or unicodedata.combining(text[at]) > 0)


def whole_runs(text: str) -> Iterator[tuple[int, int]]:
    """The places of the runs of FLOOR characters and more, without letters that belong to a word outside ASCII."""
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if end - start >= FLOOR:
            if letter(text, start - 1):
                start = LETTERS_FIRST.match(text, start, end).end()
            if letter(text, end):
                end = start + LETTERS_LAST.search(text[start:end]).start()
            if end - start >= FLOOR:
                yield start, end


def random_spans(text: str, test: Test, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans that the test adds. One walk over the runs and the base spans together."""
    out, covered, at = [], _merged(base), 0
    for begin, stop in whole_runs(text):
        while at < len(covered) and covered[at][1] <= begin:
            at += 1
        free, start, i = [], begin, at
        while i < len(covered) and covered[i][0] < stop:
            if start < covered[i][0]:
                free.append((start, covered[i][0]))
            start = max(start, covered[i][1])
            i += 1
        if start < stop:
            free.append((start, stop))
        test.measure(text[begin:stop], i > at)
        for start, end in free:
            run = text[start:end].rstrip(SIGNS)
            start, run = start + len(run) - len(run.lstrip(SIGNS)), run.lstrip(SIGNS)
            if KEY.fullmatch(run) is None and any(c.isalpha() for c in run) and test.random(run):
                out.append((start, start + len(run), "random"))
                continue
            out += [(start + k.start(), start + k.end(), "random") for k in KEY.finditer(run) if test.random(k[0])]
    return out


def spans(text: str, enc, known: frozenset[str] = frozenset()) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], Test]:
    """The base spans, all spans in the same order, and what the test measured."""
    base, test = base_spans(text), Test(enc, known)
    return base, sorted(base + random_spans(text, test, base), key=lambda x: (x[0], KINDS.index(x[2]))), test


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def scan(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, known: Iterable[str] = ()) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans, n_random, n_tested, n_known, n_confirmed and least_ratio. No shuffle.

    known: digests and identifiers that are no secrets, as the tasks hold them: a list of bounded size."""
    with open(rank_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast((f.read(), frozenset(known)))
    counts = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")]
    texts_ = [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    more = [T.StructField(n, T.LongType()) for n in ("n_random", "n_tested", "n_known", "n_confirmed")]

    def make():
        enc, fixed = encoding(data.value[0], pattern), data.value[1]

        def compute(texts):
            found = [spans(t or "", enc, fixed) for t in texts]
            count = lambda i, kind: [sum(x[2] == kind for x in b[i]) for b in found]
            tests = [b[2] for b in found]
            measured = [[t.tested for t in tests], [t.excluded for t in tests], [t.confirmed for t in tests], [t.least for t in tests]]
            return [count(0, "assign"), count(0, "access"), count(0, "hex"), [hashlib.sha256(joined(b[0]).encode()).hexdigest() for b in found], [joined(b[1]) for b in found], count(1, "random"), *measured]

        return compute

    return per_text(docs, text, [*counts, *texts_, *more, T.StructField("least_ratio", T.DoubleType())], make, keep)


def redact(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", mark: str = "[SECRET]", known: Iterable[str] = ()) -> DataFrame:
    """docs with each secret in text replaced by mark; overlapping spans become one mark. Null stays null. No shuffle."""
    with open(rank_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast((f.read(), frozenset(known)))

    def make():
        enc, fixed = encoding(data.value[0], pattern), data.value[1]

        def clean(t):
            if t is None:
                return None
            out, at = [], 0
            for s, e, _ in spans(t, enc, fixed)[1]:
                if s >= at:
                    out += [t[at:s], mark]
                at = max(at, e)
            return "".join(out) + t[at:]

        return lambda texts: [[clean(t) for t in texts]]

    order = docs.columns
    return per_text(docs, text, [T.StructField(text, T.StringType())], make).select(*[f"`{c}`" for c in order])
