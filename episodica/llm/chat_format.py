"""Chat formatting: the layout of a JSON record is recognised by a hash of its nested field paths.

The fingerprint of a record selects a declarative mapping (a list of turn rules) that turns prompt, instruction and
message layouts into canonical turns; a template then marks the turns:

    <s>[ROLE]user[/ROLE]text</s>          any role but the assistant's
    <s>[ROLE]assistant[/ROLE]text</s>     text lies under the loss mask

Inside roles and texts every backslash is doubled, and a backslash goes into each control string after its first
character, so that no control string is left and unescape() restores the text exactly.

A record with more fields than a layout names takes the layout of most fields that it has all of.

Cases: null texts and roles are empty; a record of no layout, or not JSON, is one turn of role "record" with the record
as its text and layout "unknown"; a null record, or one whose layout finds no turn in it, gives a row without a turn;
records with one position are ordered by their first turn's role, then text's hash, and repeated rows are repeated turns;
null positions come first, and null keys are one conversation; texts of any length are formatted whole; an empty table
gives an empty table; only the named columns are read.
A conversation is never gathered: its turns stream, in order, through one task of constant memory. A digest of all its
text can't be split, so the turns of one conversation do meet in one task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches

CONTROL = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\?)")
_SEGMENT = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>", re.S)
ASSISTANT = "assistant"

#: Layouts: the field paths of a record, and the rules that make its turns. A rule has a fixed role or a role path,
#: and a text path; with "each", for every element of a list. A rule whose "unless_empty" text is empty makes no turn.
LAYOUTS: dict[str, tuple[list[str], list[dict]]] = {
    "messages": (["messages", "messages[].role", "messages[].content"], [{"each": "messages", "role_at": "role", "text_at": "content"}]),
    "share": (["conversations", "conversations[].from", "conversations[].value"], [{"each": "conversations", "role_at": "from", "text_at": "value"}]),
    "instruction": (["instruction", "output"], [{"role": "user", "text_at": "instruction"}, {"role": ASSISTANT, "text_at": "output"}]),
    "instruction_input": (["instruction", "input", "output"], [{"role": "user", "text_at": "instruction", "also": "input"}, {"role": ASSISTANT, "text_at": "output"}]),
    "prompt": (["prompt", "prompt.text"], [{"role": "user", "text_at": "prompt.text"}]),
    "prompt_response": (["prompt", "response"], [{"role": "user", "text_at": "prompt"}, {"role": ASSISTANT, "text_at": "response"}]),
    "question_answer": (["question", "answer"], [{"role": "user", "text_at": "question"}, {"role": ASSISTANT, "text_at": "answer"}]),
    "system": (["system"], [{"role": "system", "text_at": "system"}]),
}
#: The role of a record that no layout fits.
RECORD = "record"
#: Other names for roles, for corpora that have them.
ROLES = {"human": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}


def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a JSON value; [] stands for the elements of a list."""
    if isinstance(value, dict):
        out = set()
        for k, v in value.items():
            here = f"{at}.{k}" if at else k
            out |= {here} | paths(v, here)
        return out
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else set()
    return set()


def fingerprint(field_paths) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()[:16]


REGISTRY = {fingerprint(p): (name, rules) for name, (p, rules) in LAYOUTS.items()}


@lru_cache(4096)
def mapping(field_paths: frozenset[str]) -> tuple[str, list[dict]]:
    """(layout, rules) of a fingerprint's paths: those registered for it, else of the layout of most paths that are all among them."""
    known = REGISTRY.get(fingerprint(field_paths))
    if known:
        return known
    fits = [(-len(p), name) for name, (p, _) in LAYOUTS.items() if set(p) <= field_paths]
    return (min(fits)[1], LAYOUTS[min(fits)[1]][1]) if fits else ("unknown", [])


def _at(value, path: str):
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def canonical(record: str | None, roles: dict[str, str] = ROLES) -> tuple[str, str, list[tuple[str, str]]]:
    """(layout, fingerprint, turns) of a JSON record."""
    try:
        value = json.loads(record) if record is not None else None
    except (ValueError, RecursionError):
        value = None
    found = frozenset(paths(value))
    layout, rules = mapping(found)
    if layout == "unknown":
        return layout, fingerprint(found), [] if record is None else [(RECORD, record)]
    turns = []
    for rule in rules:
        items = _at(value, rule["each"]) if "each" in rule else [value]
        for item in items if isinstance(items, list) else []:
            role = rule["role"] if "role" in rule else _text(_at(item, rule["role_at"]))
            text = _text(_at(item, rule["text_at"]))
            if more := _text(_at(item, rule["also"])) if "also" in rule else "":
                text += "\n\n" + more
            turns.append((roles.get(role, role), text))
    return layout, fingerprint(found), turns


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and the code points, from and to, that lie under the loss mask."""
    head, body = f"<s>[ROLE]{escape(role)}[/ROLE]", escape(text)
    start = len(head)
    return f"{head}{body}</s>", start, start + len(body) if role == ASSISTANT else start


def format_records(records: DataFrame, record: str = "record", key: str = "conv_id", position: str = "turn", roles: dict[str, str] = ROLES) -> DataFrame:
    """(key, position, record_order, part, layout, layout_fingerprint, role, formatted, loss_start, loss_end): a row for each turn of each JSON record. No shuffle."""
    source = records.select(key, position, F.col(record).cast("string").alias("__record"))
    small_batches(records.sparkSession)
    schema = T.StructType([source.schema[key], source.schema[position]] + [T.StructField(n, t) for n, t in (("record_order", T.StringType()), ("part", T.IntegerType()), ("layout", T.StringType()), ("layout_fingerprint", T.StringType()), ("role", T.StringType()), ("formatted", T.StringType()), ("loss_start", T.LongType()), ("loss_end", T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, "__record"):
                index, rows = [], []
                for i, text in enumerate(some.column(2).to_pylist()):
                    layout, print_, turns = canonical(text, roles)
                    serial += 1
                    # what keeps a record's turns together among the records of one position; the last part tells equal records apart
                    first = f"{turns[0][0]} {hashlib.sha256(text.encode('utf-8', 'surrogatepass')).hexdigest()} {task}:{serial}" if turns else ""
                    for part, (role, body) in enumerate(turns):
                        index.append(i)
                        rows.append((first, part, layout, print_, role, *segment(role, body)))
                    if not turns:
                        index.append(i)
                        rows.append((first, 0, layout, print_, None, "", 0, 0))
                take = pa.array(index, pa.int32())
                columns = list(zip(*rows, strict=True))
                kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([some.column(0).take(take), some.column(1).take(take), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


class _Digest:
    """What is read back from the formatted turns of one conversation so far."""

    def __init__(self):
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, formatted: str, loss_start: int, loss_end: int) -> None:
        self.chars += len(formatted)
        for m in _SEGMENT.finditer(formatted):
            role, text = unescape(m[1]), unescape(m[2])
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
        if loss_end > loss_start:
            masked = unescape(formatted[loss_start:loss_end])
            self.loss.update(masked.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(masked)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(formatted: DataFrame, key: str = "conv_id", position: str = "turn") -> DataFrame:
    """One row for each conversation, read back from format_records(): (key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    schema = T.StructType([formatted.schema[key]] + [T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))])
    kind = schema[0].dataType
    dealt = formatted.select(key, position, "record_order", "part", "formatted", "loss_start", "loss_end").repartition(key).sortWithinPartitions(key, position, "record_order", "part")
    small_batches(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        def made(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names=[f.name for f in schema])

        open_, at = None, None
        for batch in batches:
            rows = []
            for k, text, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 4, 5, 6)), strict=True):
                if open_ is None or k != at:
                    if open_ is not None:
                        rows.append((at, *open_.row()))
                    open_, at = _Digest(), k
                open_.add(text, start, end)
            if rows:
                yield made(rows)
        if open_ is not None:
            yield made([(at, *open_.row())])

    return dealt.mapInArrow(run, schema)


def json_of(**fields: Column) -> Column:
    """A JSON record with these fields; nulls stay as nulls, so that they don't change the layout."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})
