"""Vector expressions and the pluggable text embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def truncate(v: Column, dims: int) -> Column:
    """First `dims` components scaled back to unit length; a zero vector is left unchanged."""
    head = F.transform(F.slice(v, 1, dims), lambda x: x.cast("double"))
    size = norm(head)
    return F.when(size == 0, head).otherwise(F.transform(head, lambda x: x / size))


@dataclass(frozen=True)
class Embedder:
    """A text embedder and the provenance its vectors are stored with.

    `embed` maps a list of texts to a (len(texts), dims) array. It runs inside Arrow batches.
    """

    model: str
    dims: int
    embed: Callable[[list[str]], np.ndarray]

    def column(self, text: Column) -> Column:
        embed, dims = self.embed, self.dims

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                got = np.asarray(embed(texts.tolist()), dtype=np.float32)
                if got.shape != (len(texts), dims):
                    raise ValueError(f"embedder returned {got.shape}, wanted {(len(texts), dims)}")
                yield pd.Series(list(got), index=texts.index)

        return run(text)


WINDOW = 1024  # code units of each text hashed at a time


def hash_vectors(texts: list[str], dims: int) -> np.ndarray:
    """Deterministic unit vectors with no meaning: they exercise the plumbing, not relevance.

    A 32-bit FNV-1a hash of the UTF-16 code units seeds a 32-bit xorshift generator. Both are
    sequential, so they are run across the batch, one code unit or one dimension at a time.
    """
    units = [np.frombuffer(t.encode("utf-16-le"), dtype=np.uint16) for t in texts]
    sizes = np.array([len(u) for u in units])
    order = np.argsort(-sizes, kind="stable")
    seeds = np.full(len(texts), 2166136261, dtype=np.uint32)
    longest = int(sizes.max()) if len(texts) else 0
    # rows are sorted by length: at each position only a leading slice is still running
    running = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), side="right")
    for start in range(0, longest, WINDOW):  # so one very long text does not widen all rows
        width = min(WINDOW, longest - start)
        table = np.zeros((running[start], width), dtype=np.uint32)
        for row, i in enumerate(order[:running[start]]):
            part = units[i][start:start + width]
            table[row, :len(part)] = part
        for pos in range(width):
            live = slice(0, running[start + pos])
            seeds[live] = (seeds[live] ^ table[live, pos]) * np.uint32(16777619)
    state = np.where(seeds == 0, np.uint32(1), seeds)
    out = np.empty((len(texts), dims))
    for d in range(dims):
        state = state ^ (state << np.uint32(13))
        state = state ^ (state >> np.uint32(17))
        state = state ^ (state << np.uint32(5))
        out[order, d] = state / 0xFFFFFFFF * 2 - 1
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def hash_embedder(dims: int = 384, model: str = "hash-deterministic") -> Embedder:
    return Embedder(model, dims, lambda texts: hash_vectors(texts, dims))
