"""Packing documents into fixed-length training sequences by the sum-of-squares rule.

Each document becomes token ids and an end id; only a longer one is cut, its first piece taking the
remainder. A piece goes where the sum over residual gaps of the squared number of open sequences with
that gap becomes smallest (ties: the smallest gap left); a new one is opened when no open one has room.
Longer pieces go first, which brings the number of sequences close to the least. Pieces are packed in groups of about ``GROUP`` documents, dealt out by a hash of the id: each group keeps one
counter per gap and one stack of open sequences, so its state is bounded, and groups are large enough
that the few sequences left open at their ends do not matter.

Ids are those of the ``tokenizers`` library. Where a piece of text holds no special token they are
made with the same vocabulary in ``tiktoken``, chunk by chunk (see ``chunks``), which is faster.

Defined results: a null or empty text is the end id alone; a null doc_id is packed like any other;
rows that repeat an id are told apart only by their text; ties are decided by the order of
(length, doc_id, piece); an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm import chunks, texts

LENGTH, END = 1024, 2  # fixed by the contract
GROUP = 1 << 15
SPECIAL = b"<|endoftext|>"
NEWLINE = 198  # the id of a line end in this vocabulary
# A chunk that keeps its tokens when it stands in a line of its own: one word of ASCII and two-byte letters.
SIMPLE = re.compile(rb"(?![^\n]*<\|endoftext\|>) ?(?:[\x21-\x7e]|[\xc3-\xcb][\x80-\xbf])+")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def chunk_encoder(json_path: str, ranks_path: str):
    """Encode many chunks with one call each: ids of a line end part those of two chunks."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(json_path)
    slow.no_padding()
    slow.no_truncation()

    def encode(names: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        simple = list(filter(SIMPLE.fullmatch, names))
        other = [n for n in names if not SIMPLE.fullmatch(n)] if len(simple) < len(names) else []
        ids, lengths = [], []
        for low in range(0, len(simple), 8192):
            text = b"\n".join(simple[low:low + 8192]).decode() + "\n"
            own = np.array(fast.encode_ordinary(text), np.uint32)
            breaks = np.flatnonzero(own == NEWLINE)
            ids.append(np.delete(own, breaks))
            lengths.append(np.diff(breaks, prepend=-1) - 1)
        for name in other:
            text = name.decode()
            own = slow.encode(text, add_special_tokens=False).ids if SPECIAL in name else fast.encode_ordinary(text)
            ids.append(np.array(own, np.uint32))
            lengths.append([len(own)])
        return simple + other, np.concatenate(ids), np.concatenate(lengths)
    return encode


def token_ids(json_path: str | None = None, ranks_path: str | None = None):
    """A function of one task: (bytes, offsets) of texts to (ids, offsets), without end ids."""
    paths = default_vocabulary() if json_path is None else (json_path, ranks_path)
    encoder = chunks.Encoder(chunk_encoder(*paths))
    return lambda data, offsets: encoder(data, offsets, chunks.safe_gaps(data, offsets))


def cut(n_ids: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n_ids ids; only the first may be shorter."""
    first = n_ids % length or min(n_ids, length)
    return [(0, first)] + [(at, length) for at in range(first, n_ids, length)]


def pieces(docs: DataFrame, length: int = LENGTH, end: int = END, json_path: str | None = None,
           ranks_path: str | None = None) -> DataFrame:
    """The pieces of every document with the checksum of their ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_ids(json_path, ranks_path)
        tail = np.array([end], np.uint32).tobytes()
        for batch in batches:
            for part in texts.slices(batch, "text", 8 << 20):
                ids, offsets = tokens(*texts.text_bytes(part.column("text")))
                raw = ids.astype("<u4").tobytes()
                rows = []
                for doc, low, high in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    own = raw[low * 4:high * 4] + tail
                    for k, (at, n) in enumerate(cut(high - low + 1, length)):
                        rows.append((doc, k, at, n, zlib.crc32(own[at * 4:(at + n) * 4])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECES_ARROW.types)], schema=_PIECES_ARROW)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, placed one after the other by the sum-of-squares rule."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        # what the sum of squares changes by when an open gap g turns into g - size (a gap of 0 is not open)
        delta = 1 - 2 * count[size:]
        delta[1:] += 2 * count[1:capacity + 1 - size] + 1
        delta[count[size:] == 0] = 1 << 40
        best = int(delta.argmin())
        if delta[best] < 1 << 40:
            gap = best + size
            own = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, own, made = capacity, made, made + 1
        sequence[i], offset[i] = own, capacity - gap
        if gap > size:
            stacks[gap - size].append(own)
            count[gap - size] += 1
    return sequence, offset


PACKED = PIECES + ", sequence_id long, offset long"


def pack(found: DataFrame, groups: int, capacity: int = LENGTH) -> DataFrame:
    """``pieces`` with sequence_id and offset; groups are packed apart, by a hash of the id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        # many groups can share a task
        group = table.column("__group").to_numpy()
        for own in np.unique(group):
            part = table.filter(pa.array(group == own)).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
            sequence, offset = pack_lengths(part.column("length").to_numpy(), capacity)
            done = part.drop_columns(["__group"]).append_column("sequence_id", pa.array((int(own) << 36) + sequence)).append_column("offset", pa.array(offset))
            yield from done.combine_chunks().to_batches(10_000)
    grouped = found.withColumn("__group", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))
    return grouped.repartition(groups, "__group").mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, length: int = LENGTH, end: int = END, json_path: str | None = None,
                   ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    groups = max(1, -(-docs.count() // GROUP))
    return pack(pieces(docs, length, end, json_path, ranks_path), groups, length)
