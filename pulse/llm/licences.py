"""Licence scans: which licences and notices a text names, and how far they bind its use.

An Aho-Corasick automaton finds notice phrases and identifier tags in the folded words of many texts at
once. What follows a tag, and notices joined by and / or / with, are licence expressions: a shunting-yard
parser puts them into postfix order, and evaluation gives their labels and a degree of restriction from
0 (free) to 1 (all rights reserved). All terms of an `and` bind, so the strictest counts; an `or` leaves
the choice, so the mildest counts; an exception after `with` eases its licence to library terms.

Words are runs of ASCII letters and digits, and of anything beyond ASCII; only A-Z is lower-cased. A scan
reads each text once, in the task that holds it, and shuffles nothing.

Defined results: a null or empty text has no words, no places, no labels and score 0; places may overlap
and all are counted; equal rows give equal results each; an empty table gives an empty result; columns
beyond doc_id and text are ignored. An expression ends where its grammar breaks; operators and
parentheses that then lack a partner are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pulse.llm import texts

# Phrases and labels of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notice phrases (in folded words) and the licence each names.
NOTICES = {
    "mit license": "mit", "permission is hereby granted free of charge": "mit", "apache license": "apache",
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "isc license": "isc",
    "boost software license": "bsl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "gnu gpl": "gpl", "gnu lgpl": "lgpl",
    "gnu agpl": "agpl", "cc0": "cc0", "public domain": "public-domain", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc", "no rights reserved": "public-domain",
    "proprietary and confidential": "proprietary",
}
EXCEPTIONS = ("classpath exception", "linking exception", "runtime library exception")
# Tags whose colon is followed by an expression.
TAGS = ("spdx license identifier", "license expression")

# How far a licence binds; one that is not listed counts as UNKNOWN.
RESTRICTION = {
    "public-domain": 0.0, "cc0": 0.0, "unlicense": 0.0, "0bsd": 0.0, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "bsl": 0.1, "zlib": 0.1,
    "apache": 0.2, "cc-by": 0.2, "mpl": 0.4, "epl": 0.4, "lgpl": 0.4, "cc-by-sa": 0.5, "gpl": 0.6, "agpl": 0.7,
    "cc-by-nc": 0.8, "cc-by-nd": 0.8, "cc-by-nc-sa": 0.8, "cc-by-nc-nd": 0.9, "proprietary": 1.0, "reserved": 1.0,
}
UNKNOWN = 0.5
EASED = 0.4  # the most that a licence with an exception binds

BINDS = {"or": 1, "and": 2, "with": 3}  # precedence
# Words that may stand between two notices of one expression, besides one operator.
FILLERS = frozenset("the a an either both gnu version v license licence clause international".split())
GAP = 6

_TOKEN = re.compile(rb"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")


def family(identifier: str) -> str:
    """The licence of an identifier without its version: ``GPL-2.0-or-later`` is ``gpl``."""
    parts = identifier.lower().rstrip("+.").split("-")
    end = next((i for i, p in enumerate(parts) if i and p[:1].isdigit()), len(parts))
    return "-".join(parts[:end])


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operands and operators of an infix expression in postfix order."""
    out, held = [], []
    for token in tokens:
        if token == "(":
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if held:
                held.pop()
        elif token in BINDS:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[token]:
                out.append(held.pop())
            held.append(token)
        else:
            out.append(token)
    return out + [t for t in reversed(held) if t != "("]


def evaluate(rpn: list[str]) -> tuple[frozenset[str], float]:
    """Labels named by a postfix expression, and how far it binds."""
    stack: list[tuple[frozenset[str], float]] = []
    for token in rpn:
        if token not in BINDS:
            stack.append((frozenset([token]), RESTRICTION.get(token, UNKNOWN)))
            continue
        (right, r), (left, l) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left | {f"{name}-with-exception" for name in left}, min(l, EASED)))
        else:
            stack.append((left | right, min(l, r) if token == "or" else max(l, r)))
    return stack[-1] if stack else (frozenset(), 0.0)


def trimmed(tokens: list[str]) -> list[str]:
    """Without trailing operators and openings, and without parentheses that have no partner."""
    tokens = list(tokens)
    while tokens and (tokens[-1] in BINDS or tokens[-1] == "("):
        tokens.pop()
    out, open_at = [], []
    for token in tokens:
        if token == ")" and not open_at:
            continue
        if token == "(":
            open_at.append(len(out))
        elif token == ")":
            open_at.pop()
        out.append(token)
    return [t for i, t in enumerate(out) if i not in set(open_at)]


def tagged_expression(raw: bytes, at: int) -> list[str]:
    """Tokens of the expression that starts in ``raw`` after the colon at ``at``, up to where its line ends
    or the grammar breaks."""
    colon = re.compile(rb"[ \t]*:").match(raw, at)
    if not colon:
        return []
    tokens, at, operand_next, depth = [], colon.end(), True, 0
    while (found := _TOKEN.match(raw, at)) is not None:
        token = found.group(1).decode()
        word = token.lower()
        if operand_next:
            if token == "(":
                depth += 1
            elif token == ")" or word in BINDS:
                break
            else:
                operand_next = False
                token = family(token)
        elif token == ")":
            if not depth:
                break
            depth -= 1
        elif word in BINDS:
            operand_next, token = True, word
        else:
            break
        tokens.append(token)
        at = found.end()
    return trimmed(tokens)


@dataclass
class Found:
    """What one text holds: base places, spans (label, first word, words), expressions, their labels and score."""

    base: list[tuple[str, int]] = field(default_factory=list)
    spans: list[tuple[str, int, int]] = field(default_factory=list)
    expressions: list[str] = field(default_factory=list)
    labels: set[str] = field(default_factory=set)
    score: float = 0.0

    def add(self, tokens: list[str]) -> None:
        if tokens:
            labels, score = evaluate(postfix(tokens))
            self.expressions.append(" ".join(tokens))
            self.labels |= labels
            self.score = max(self.score, score)


def joined(places: list[tuple[int, int, str, bool]], gap_words) -> Iterator[list[str]]:
    """Expressions of a text's notices. ``places`` are (first word, words, label, whether an exception); of
    those that overlap the earliest and longest counts. Two are one expression when only fillers,
    figures and a single operator lie between them; an exception needs `with` before it."""
    tokens: list[str] = []
    end = 0
    for first, length, label, exception in sorted(places, key=lambda p: (p[0], -p[1])):
        if first < end:
            continue
        between = gap_words(end, first) if tokens and first - end <= GAP else None
        joins = [w for w in between or () if w in BINDS]
        linked = (between is not None and len(joins) == 1 and (joins[0] == "with") == exception
                  and all(w in BINDS or w in FILLERS or w[:1].isdigit() for w in between))
        if linked:
            tokens += [joins[0], label]
        elif exception:
            continue
        else:
            if tokens:
                yield tokens
            tokens = [label]
        end = first + length
    if tokens:
        yield tokens


class Scanner:
    """The automaton over all phrases; built once in a task."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], tags: tuple[str, ...], exceptions: tuple[str, ...]):
        spelled = notices | {p.replace("license", "licence"): label for p, label in (base | notices).items() if "license" in p}
        kinds: dict[str, list] = {}
        for kind, phrases in (("base", base), ("notice", spelled), ("tag", dict.fromkeys(tags, "")), ("exception", dict.fromkeys(exceptions, "exception"))):
            for phrase, label in phrases.items():
                kinds.setdefault(phrase, []).append((kind, label))
        self.automaton = ahocorasick.Automaton()
        for phrase, meaning in kinds.items():
            key = f" {phrase} ".encode().decode("latin-1")
            self.automaton.add_word(key, (len(key), len(phrase.split(" ")), meaning))
        if kinds:
            self.automaton.make_automaton()

    def scan(self, column: pa.Array) -> tuple[np.ndarray, dict[int, Found]]:
        """Words of each text, and what is found in those that hold a phrase."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        # every text ends with a separator, so no word crosses into the next one
        data, offsets = texts.text_bytes(pc.binary_join_element_wise(column, *(pa.scalar(x, pa.large_string()) for x in ("", "\n"))))
        folded = texts.TERMS[data]
        inside = folded != 0x20
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & ~before)
        bounds = np.searchsorted(starts, offsets)
        # single blanks between words, one in front
        line = b" " + folded[inside | before].tobytes()
        hits = list(self.automaton.iter(line.decode("latin-1"))) if len(self.automaton) else []
        found: dict[int, Found] = {}
        if not hits:
            return np.diff(bounds), found
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
        firsts = np.searchsorted(blanks, np.array([end + 1 - size for end, (size, _, _) in hits]))
        owners = np.searchsorted(bounds, firsts, "right") - 1
        ends = np.flatnonzero(~inside & before)
        raw = None
        notices: dict[int, list] = {}
        for (_, (_, length, meaning)), at, doc in zip(hits, firsts.tolist(), owners.tolist()):
            if at + length > bounds[doc + 1]:
                continue  # runs into the next text
            first = at - int(bounds[doc])
            mine = found.setdefault(doc, Found())
            for kind, label in meaning:
                if kind == "base":
                    mine.base.append((label, first))
                if kind == "tag":
                    raw = data.tobytes() if raw is None else raw
                    mine.add(tagged_expression(raw, int(ends[at + length - 1])))
                else:
                    notices.setdefault(doc, []).append((first, length, label, kind == "exception"))
                    if kind != "exception":
                        mine.spans.append((label, first, length))
                        mine.labels.add(label)
        for doc, places in notices.items():
            low = int(bounds[doc])

            def gap_words(a: int, b: int) -> list[str]:
                return line[blanks[low + a] + 1:blanks[low + b]].decode().split(" ") if b > a else []
            for tokens in joined(places, gap_words):
                found[doc].add(tokens)
        return np.diff(bounds), found


SCANNED = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
           "score double, found array<struct<label:string,first:long,words:int>>, expressions array<string>")
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int32())]))


def _row(found: Found | None) -> tuple:
    if found is None:
        return 0, None, None, "", "", 0.0, [], []
    at = [first for _, first in found.base]
    spans = sorted({(label, first, words) for label, first, words in found.spans}, key=lambda s: (s[1], s[2], s[0]))
    return (len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for label, _ in found.base})),
            ",".join(sorted(found.labels)), found.score,
            [{"label": label, "first": first, "words": words} for label, first, words in spans], found.expressions)


def scan(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None,
         tags: tuple[str, ...] = TAGS, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """One row per document: n_words; places of the base phrases (n_base, first_word, last_word, base_labels);
    all labels; the score of the strictest expression; the spans and the expressions found."""
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, tags, exceptions)
        for batch in batches:
            for part in texts.slices(batch, "text"):
                n_words, found = scanner.scan(part.column("text"))
                n_base, first, last, base_labels, labels, score, spans, expressions = zip(
                    *(_row(found.get(d)) for d in range(part.num_rows)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_base, pa.int64()), pa.array(first, pa.int64()),
                     pa.array(last, pa.int64()), pa.array(base_labels), pa.array(labels), pa.array(score, pa.float64()),
                     pa.array(spans, _SPANS), pa.array(expressions, pa.list_(pa.string()))],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found", "expressions"])
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, SCANNED)
