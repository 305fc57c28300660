"""Byte-pair encoding and decoding with reuse of content-defined chunks.

A text is cut at white space where a rolling hash of the bytes before it says so; the same passage thus
falls into the same chunks in every document. Equal chunks are encoded once by each task (see
``chunks``) and a document's ids are put together from its chunks' ids.

A cut between plain characters cannot change the ids (white space ends a word for this tokenizer, and no
normalization reaches across it). Any other cut is repaired: the chunks on both sides are encoded
together, and where the result is not that of the two alone, the cut goes and the wider chunk is tried
against its neighbours, until all agree.

Defined results: a null text counts as empty and has no ids; an id list's decoding is the library's
(the tokens joined by a space for a vocabulary without a decoder); rows are handled each, so repeated
rows and null ids change nothing; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulse.llm import chunks, texts

SLICE = 4 << 20
WIDTH, SKIP = 4, 64  # bytes the rolling hash spans; one gap in SKIP is passed over
MARK = "\x01"
SIMPLE = re.compile(rb"(?![^\n]*<\|) ?(?:[\x21-\x7e]|[\xc3-\xcb][\x80-\xbf])+")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str):
    from tokenizers import Tokenizer
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def chunk_encoder(tokenizer):
    """Encodes many chunks in one call; the id of a control character parts one chunk's from the next's."""
    mark = tokenizer.encode(MARK, add_special_tokens=False).ids
    simple = SIMPLE.fullmatch if len(mark) == 1 else lambda name: None

    def encode(names: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        easy = list(filter(simple, names))
        other = [n for n in names if not simple(n)] if len(easy) < len(names) else []
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for low in range(0, len(easy), 2048):
            text = f" {MARK} ".join([n.decode() for n in easy[low:low + 2048]]) + f" {MARK}"
            own = np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            breaks = np.flatnonzero(own == mark[0])
            ids.append(np.delete(own, breaks))
            lengths.append(np.diff(breaks, prepend=-1) - 1)
        for low in range(0, len(other), 1024):
            found = tokenizer.encode_batch([n.decode() for n in other[low:low + 1024]], add_special_tokens=False)
            ids.extend(np.array(e.ids, np.uint32) for e in found)
            lengths.append(np.array([len(e.ids) for e in found], np.int64))
        return easy + other, np.concatenate(ids), np.concatenate(lengths)
    return encode


def rolling(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the WIDTH bytes before each position."""
    value = np.zeros(len(at), np.uint64)
    for k in range(WIDTH, 0, -1):
        value = value * np.uint64(0x100000001B3) + data[np.maximum(at - k, 0)]
    return texts.mix(value)


def gaps(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cuts that cannot change ids, cuts to be repaired), both chosen by the rolling hash."""
    safe = chunks.safe_gaps(data, offsets)
    at = np.flatnonzero(texts.IS_SPACE[data])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    risky = np.setdiff1d(at[~edge[at]], safe, assume_unique=True)
    return (safe[rolling(data, safe) % np.uint64(SKIP) != 0], risky[rolling(data, risky) % np.uint64(SKIP) != 0])


def repaired(data: np.ndarray, offsets: np.ndarray, safe: np.ndarray, risky: np.ndarray, encode) -> np.ndarray:
    """Cuts that stay; ``encode`` gives the ids of a byte string."""
    if not len(risky):
        return safe
    bounds = np.union1d(offsets, np.union1d(safe, risky)).tolist()
    open_ = set(risky.tolist())
    raw = data.tobytes()
    out = bounds[:1]  # settled bounds; the last one begins the chunk on the left
    for i in range(1, len(bounds) - 1):
        here = bounds[i]
        if here in open_:
            left, right = raw[out[-1]:here], raw[here:bounds[i + 1]]
            if encode(left + right) != encode(left) + encode(right):
                continue  # the wider chunk meets the next bound in its turn
        out.append(here)
    return np.array(out[1:], np.int64)


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.encoder = chunks.Encoder(chunk_encoder(self.tokenizer))
        self.pairs: dict[bytes, list[int]] = {}

    def _ids(self, chunk: bytes) -> list[int]:
        if len(self.pairs) > 100_000:
            self.pairs.clear()
        if chunk not in self.pairs:
            self.pairs[chunk] = self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids
        return self.pairs[chunk]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's ids begin)."""
        safe, risky = gaps(data, offsets)
        return self.encoder(data, offsets, repaired(data, offsets, safe, risky, self._ids))

    def decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    def decode_joined(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """UTF-8 of every decoded text, for a vocabulary whose decoding joins its tokens by a space."""
        if not hasattr(self, "names"):
            size = self.tokenizer.get_vocab_size(with_added_tokens=True)
            self.names = np.array([(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)], object)
        for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            yield b" ".join(self.names[ids[low:high]].tolist())


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path or default_vocabulary())
        plain = codec.tokenizer.decoder is None
        for batch in batches:
            for part in texts.slices(batch, "text", SLICE):
                ids, offsets = codec.encode(*texts.text_bytes(part.column("text")))
                bounds = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
                decoded = codec.decode_joined(ids, offsets) if plain else (codec.decode(ids[a:b]).encode() for a, b in bounds)
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets)),
                     pa.array([hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in bounds]),
                     pa.array([hashlib.sha256(t).hexdigest() for t in decoded])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and its ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path or default_vocabulary())
        for batch in batches:
            for part in texts.slices(batch, "text", SLICE):
                ids, offsets = codec.encode(*texts.text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))],
                    names=["doc_id", "ids"])
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of its ids (null ids: empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path or default_vocabulary())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = codec.tokenizer.decode_batch([i or [] for i in part.column("ids").to_pylist()], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
