"""Chat formatting of records of many layouts.

A record is a JSON object. The hash of its nested field paths (its fingerprint) selects one of the
declared mappings, which turns it into canonical turns (role, text). A template marks the turns; control
strings inside roles and texts are escaped with a backslash, so the output can be read back exactly. The
loss mask covers the text of each assistant turn.

Turns are formatted row by row and never gathered: a conversation is its segments in order, and what
needs that order (digests, offsets) streams over sorted rows with a state of fixed size, so one
conversation may hold any share of all rows.

Defined results: a null role or text counts as empty; a record that is null, no object or of an unknown
layout has no turns and a null layout; a null conversation id is a conversation of its own; equal turn
numbers are ordered by role and text; an empty table gives an empty result; fields beyond those of a
mapping change the fingerprint, so a layout must declare them (``extra``).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``turns``: path of a list of turns, with ``role`` and ``text`` fields in each (or in the record
    itself when the path is empty); or ``fields``: (role, field) pairs in order. ``optional`` fields and
    ``extra`` ones may be absent."""

    name: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()

    def paths(self) -> Iterator[frozenset[str]]:
        """Every set of field paths that records of this layout can have."""
        if self.turns is None:
            fixed = {f for _, f in self.fields if f not in self.optional}
        elif self.turns:
            fixed = {self.turns, f"{self.turns}[]", f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"}
        else:
            fixed = {self.role, self.text}
        free = [*self.optional, *self.extra]
        for n in range(len(free) + 1):
            for chosen in combinations(free, n):
                yield frozenset(fixed | set(chosen))

    def convert(self, record: dict) -> list[tuple[str, str]]:
        if self.turns is None:
            found = [(role, record.get(field)) for role, field in self.fields if field in record]
            return [(role, _text(text)) for role, text in found if text or role != "system"]
        rows = record.get(self.turns) if self.turns else [record]
        return [(ROLES.get(_text(r.get(self.role)), _text(r.get(self.role))), _text(r.get(self.text))) for r in rows or []]


LAYOUTS = (
    Layout("turn", turns="", role="role", text="text"),
    Layout("messages", turns="messages", extra=("id", "source")),
    Layout("conversations", turns="conversations", role="from", text="value", extra=("id", "source")),
    Layout("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
           optional=("system", "input")),
    Layout("prompt_response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("prompt_completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question_answer", fields=(("user", "question"), ("assistant", "answer"))),
)


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def field_paths(value, prefix: str = "") -> set[str]:
    """Nested field paths; the items of a list share the path with ``[]``."""
    if isinstance(value, dict):
        out = set()
        for key, inner in value.items():
            path = f"{prefix}.{key}" if prefix else key
            out |= {path} | field_paths(inner, path)
        return out
    if isinstance(value, list):
        return {f"{prefix}[]"}.union(*(field_paths(v, f"{prefix}[]") for v in value)) if value else set()
    return set()


def fingerprint(paths: frozenset[str] | set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(layouts=LAYOUTS) -> dict[str, Layout]:
    out: dict[str, Layout] = {}
    for layout in layouts:
        for paths in layout.paths():
            out.setdefault(fingerprint(paths), layout)
    return out


TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
# Control strings of this template and of common others; inside a text their first character gets a backslash after it.
_CONTROL = re.compile(r"(<|\[)(\||/?s>|/?INST\]|</?SYS>>)")
_SEGMENT = re.compile(re.escape(TURN) + r"((?:[^<]|<(?!\|))*)" + re.escape(TEXT) + r"((?:[^<]|<(?!\|))*)" + re.escape(END))


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, from, to): the span of the text when it counts for the loss, else an empty one."""
    head, body = TURN + escape(role) + TEXT, escape(text)
    span = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return head + body + END, *span


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of formatted text."""
    out, at = [], 0
    while at < len(formatted):
        found = _SEGMENT.match(formatted, at)
        if not found:
            raise ValueError("not formatted by this template")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


FORMATTED = "conv_id long, turn long, seq int, layout string, segment string, loss_from int, loss_to int"
_FORMATTED_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("seq", pa.int32()), ("layout", pa.string()),
                              ("segment", pa.string()), ("loss_from", pa.int32()), ("loss_to", pa.int32())])


def format_records(records: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """Columns conv_id, turn, record (JSON) to one row per canonical turn; a record without turns gives
    one row with null layout or segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry(layouts)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(at, 1000), []
                for conv, turn, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "record"))):
                    try:
                        record = json.loads(text) if text is not None else None
                    except ValueError:
                        record = None
                    layout = known.get(fingerprint(field_paths(record))) if isinstance(record, dict) else None
                    turns = layout.convert(record) if layout else []
                    for k, (role, said) in enumerate(turns):
                        rows.append((conv, turn, k, layout.name, *segment(role, said)))
                    if not turns:
                        rows.append((conv, turn, 0, layout.name if layout else None, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FORMATTED_ARROW.types)], schema=_FORMATTED_ARROW)
    return records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "record").mapInArrow(run, FORMATTED)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its segments; state: two hashes and three counters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=[f.split()[0] for f in DIGEST.split(", ")])

        def closed():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for conv, text, low, high in zip(*(part.column(c).to_pylist() for c in ("conv_id", "segment", "loss_from", "loss_to"))):
                    if state is None or conv != now:
                        if state is not None:
                            done.append(closed())
                        now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    if text is None:
                        continue
                    for role, said in parse(text):
                        state[0] += 1
                        state[1].update(f"{role}\n{said}\n".encode())
                    learned = unescape(text[low:high])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                    state[4] += len(text)
                if len(done) >= 2000:
                    yield batch_of(done)
                    done = []
        if state is not None:
            done.append(closed())
        if done:
            yield batch_of(done)
    return (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "segment")
            .select("conv_id", "segment", "loss_from", "loss_to").mapInArrow(run, DIGEST))
