"""Exact deduplication with Patricia-trie owners.

Texts are dealt out by (byte length, content hash). Within such a partition full byte strings go into
a compressed radix trie whose terminal nodes hold the owner (largest or smallest identifier), so two
texts are equal only if all their bytes are. Every input task first builds a trie of its own, which
collapses copies before anything is shuffled: a text held by a third of all rows reaches the exchange
once per task and spill, not once per row. A trie over its byte budget spills its largest subtree:
the subtree's terminals go on to the exchange and their nodes are freed.

Defined results: a null text counts as empty; a null id is smaller than any other (a group of null
ids only has a null owner and is kept); rows that repeat an id and its text are one document, and
``keep_rows`` tells how many rows the owner has; an empty table gives an empty result; other columns
are never read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm import texts
from pulse.session import stored

TRIE_BYTES = 24 << 20
PARTIAL = "size long, content long, body binary, owner long, n long, owners long"
PARTIAL_ARROW = pa.schema([("size", pa.int64()), ("content", pa.int64()), ("body", pa.binary()),
                           ("owner", pa.int64()), ("n", pa.int64()), ("owners", pa.int64())])
OWNERS = "sha string, owner long, n long, owners long"


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by doubling and halving comparisons of slices."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, step = 0, 16
    while a[low:low + step] == b[low:low + step]:
        low += step
        step *= 2
    high = min(n, low + step)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Node:
    __slots__ = ("edge", "children", "payload")

    def __init__(self, edge: bytes, payload=None):
        self.edge, self.children, self.payload = edge, None, payload


class Patricia:
    """Radix trie of byte strings; a terminal's payload is [owner, rows, rows of the owner, key]."""

    NODE_BYTES = 160

    def __init__(self, smallest: bool):
        self.root, self.held, self.smallest = Node(b""), 0, smallest

    def insert(self, body: bytes, owner: int | None, n: int, owners: int, key=None) -> None:
        node, at = self.root, 0
        while True:
            rest = body[at:]
            if not rest:
                self._own(node, owner, n, owners, key)
                return
            child = node.children.get(rest[0]) if node.children else None
            if child is None:
                node.children = node.children or {}
                node.children[rest[0]] = Node(rest, [owner, n, owners, key])
                self.held += len(rest) + self.NODE_BYTES
                return
            shared = common_prefix(rest, child.edge)
            if shared < len(child.edge):  # split the edge
                middle = Node(child.edge[:shared])
                child.edge = child.edge[shared:]
                middle.children = {child.edge[0]: child}
                node.children[rest[0]] = middle
                self.held += self.NODE_BYTES
                child = middle
            node, at = child, at + shared

    def _own(self, node: Node, owner, n, owners, key) -> None:
        if node.payload is None:
            node.payload = [owner, n, owners, key]
            return
        held = node.payload
        if owner == held[0]:
            held[2] += owners
        elif owner is not None and (held[0] is None or (owner < held[0]) == self.smallest):
            held[0], held[2] = owner, owners
        held[1] += n

    @staticmethod
    def terminals(node: Node, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            body = prefix + node.edge
            if node.payload is not None:
                yield body, node.payload
            for child in (node.children or {}).values():
                stack.append((child, body))

    def weight(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.edge) + self.NODE_BYTES
            stack.extend((node.children or {}).values())
        return total

    def spill(self, budget: int) -> Iterator[tuple[bytes, list]]:
        """Give up the largest subtrees below the root until half the budget is free."""
        weights = {k: self.weight(c) for k, c in (self.root.children or {}).items()}
        for key in sorted(weights, key=weights.get, reverse=True):
            if self.held <= budget // 2:
                return
            yield from self.terminals(self.root.children.pop(key), b"")
            self.held -= weights[key]

    def drain(self) -> Iterator[tuple[bytes, list]]:
        yield from self.terminals(self.root, b"")
        self.root, self.held = Node(b""), 0


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch, a few hundred at a time as Python values."""
    for at in range(0, batch.num_rows, 256):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))


def _combine(smallest: bool, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            trie = Patricia(smallest)
            for batch in batches:
                for owner, size, content, body in _columns(batch):
                    trie.insert(body, owner, 1, 1, content)
                    if trie.held > budget:
                        yield from trie.spill(budget)
            yield from trie.drain()
        yield from _batches(((len(body), p[3], body, *p[:3]) for body, p in rows()), PARTIAL_ARROW)
    return run


def _settle(smallest: bool):
    """Owners of each (size, content) run; runs arrive one after the other."""
    schema = pa.schema([("sha", pa.string()), ("owner", pa.int64()), ("n", pa.int64()), ("owners", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            trie, now = Patricia(smallest), None
            for batch in batches:
                for size, content, body, owner, n, owners in _columns(batch):
                    if (size, content) != now:
                        yield from trie.drain()
                        now = (size, content)
                    trie.insert(body, owner, n, owners)
            yield from trie.drain()
        yield from _batches(((hashlib.sha256(body).hexdigest(), *p[:3]) for body, p in rows()), schema)
    return run


def body(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def owners(docs: DataFrame, smallest: bool = True, budget: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: sha, owner, n (rows that hold it), owners (rows with the owner's id)."""
    text = body(docs["text"])
    keyed = docs.select(docs["doc_id"].cast("long").alias("owner"), F.octet_length(text).cast("long").alias("size"),
                        F.xxhash64(text).alias("content"), text.alias("body"))
    partial = keyed.mapInArrow(_combine(smallest, budget), PARTIAL)
    dealt = partial.repartition("size", "content").sortWithinPartitions("size", "content")
    return dealt.mapInArrow(_settle(smallest), OWNERS)


def exact_groups(docs: DataFrame, smallest: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, keep_rows.

    Members meet their owner by the digest of the text. The owner's side has one row per text, so the
    join's hot side is the narrow member side, which adaptive execution splits.
    """
    members = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                          F.sha2(body(docs["text"]), 256).alias("text_sha256"))
    found = owners(docs, smallest)
    return (members.join(found, members["text_sha256"] == found["sha"])
            .select("doc_id", F.col("owner").alias("keep_id"), F.col("n").alias("group_size"),
                    F.col("doc_id").eqNullSafe(F.col("owner")).alias("kept"), "text_sha256",
                    F.col("owners").alias("keep_rows")))


def deduplicate(docs: DataFrame, smallest: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; one row for each distinct text.

    The decisions are narrow and written once, so the planner knows how many rows they drop.
    """
    groups = stored(exact_groups(docs.select("doc_id", "text"), smallest), "exact-groups")
    sha, gone, gone_sha, again = (texts.fresh(n, docs) for n in ("sha", "gone", "gone_sha", "again"))
    dropped = groups.filter(~F.col("kept")).select(F.col("doc_id").alias(gone), F.col("text_sha256").alias(gone_sha)).distinct()
    repeated = stored(groups.filter("kept and keep_rows > 1").select(F.col("text_sha256").alias(again)).distinct(), "exact-repeats")
    keyed = docs.withColumn(sha, F.sha2(body(docs["text"]), 256))
    stay = keyed.join(dropped, F.col("doc_id").cast("long").eqNullSafe(F.col(gone)) & (F.col(sha) == F.col(gone_sha)), "left_anti")
    once = stay.join(repeated, F.col(sha) == F.col(again), "left_anti")
    twice = stay.join(repeated, F.col(sha) == F.col(again), "left_semi").dropDuplicates([sha])
    return once.unionByName(twice).select(*(F.col(f"`{c}`") for c in docs.columns))
