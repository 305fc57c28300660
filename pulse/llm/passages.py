"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is described by shares of character
classes, word lengths, repetition and common words, and encoded by one layer; gated attention,
softmax of w . (tanh(V h) * sigmoid(U h)), weighs the encoded passages, and the weighted representation
is scored. Document labels train all of it together.

Defined results: a null or empty text is one passage of zeros; without any label of both kinds every
text scores 0.5; ids, languages and sources are never inputs; rows are scored each; an empty table gives
an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm import labelled, texts

PASSAGE = 64
HIDDEN, GATE = 16, 8
EPOCHS, RATE, DECAY = 100, 0.03, 1e-3
SAMPLE = 3000  # labelled rows to fit on, at most

_CLASSES = np.full(256, 6, np.int64)  # other ASCII
for _i, _letters in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:!?", b"#$%&*|<>@~^_=+", b"\n")):
    _CLASSES[list(_letters)] = _i
_CLASSES[128:] = 7
N_CLASS = 8
WIDTH = N_CLASS + 7


def describe(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of WIDTH numbers for each passage, first passage of each text)."""
    starts, ends, word_offsets = texts.words(data, offsets)
    per_text = np.maximum(1, -(-np.diff(word_offsets) // PASSAGE))
    bounds = np.zeros(len(per_text) + 1, np.int64)
    np.cumsum(per_text, out=bounds[1:])
    out = np.zeros((bounds[-1], WIDTH))
    if not len(starts):
        return out, bounds
    text_of = np.repeat(np.arange(len(per_text)), np.diff(word_offsets))
    owner = bounds[text_of] + (np.arange(len(starts)) - word_offsets[text_of]) // PASSAGE
    n = len(out)
    words = np.maximum(np.bincount(owner, minlength=n), 1)
    # bytes of a passage: from its first word to the next passage's
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    edges = np.append(starts[first], len(data))
    byte_owner = np.repeat(owner[first], np.diff(edges))
    counted = (data[edges[0]:] & 0xC0) != 0x80
    kinds = np.bincount((byte_owner * N_CLASS + _CLASSES[data[edges[0]:]])[counted], minlength=n * N_CLASS).reshape(n, N_CLASS)
    out[:, :N_CLASS] = kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(owner, length, n) / words
    out[:, N_CLASS] = mean / 10
    out[:, N_CLASS + 1] = np.sqrt(np.maximum(np.bincount(owner, length ** 2, n) / words - mean ** 2, 0)) / 10
    hashes = texts.word_hashes(data, starts, ends)
    key = np.sort(texts.mix(hashes + texts.mix(owner.astype(np.uint64) + np.uint64(1))))
    distinct = np.unique(key)
    again = texts.mix(hashes + texts.mix(owner.astype(np.uint64) + np.uint64(1)))
    counts = np.diff(np.append(np.searchsorted(key, distinct), len(key)))
    times = counts[np.searchsorted(distinct, again)]
    out[:, N_CLASS + 2] = np.bincount(owner, 1 / times, n) / words  # distinct words
    out[:, N_CLASS + 3] = np.sqrt(np.bincount(owner, times, n) / words) / 8  # concentration
    out[:, N_CLASS + 4] = np.bincount(owner, length <= 3, n) / words
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out[:, N_CLASS + 5] = np.bincount(owner, same, n) / words
    out[:, N_CLASS + 6] = np.log1p(np.bincount(owner, minlength=n)) / 5
    return out, bounds


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _per_bag(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, bounds[:-1], axis=0)


def forward(model: dict[str, np.ndarray], x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    bag = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    x = (x - model["mean"]) / model["scale"]
    h = np.tanh(x @ model["E"] + model["e"])
    t, g = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    a = (t * g) @ model["w"]
    a = np.exp(a - np.maximum.reduceat(a, bounds[:-1])[bag])
    a /= _per_bag(a, bounds)[bag]
    z = _per_bag(a[:, None] * h, bounds)
    return {"x": x, "bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ model["c"] + model["b"])}


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Encoder, attention and scorer, by gradient steps (Adam) on the documents' log-likelihood."""
    random = np.random.Generator(np.random.PCG64(7))
    parts = [describe(*texts.text_bytes(pa.array([t for t, _ in rows[at:at + 200]], pa.large_string()))) for at in range(0, len(rows), 200)]
    x = np.concatenate([p for p, _ in parts]) if parts else np.zeros((0, WIDTH))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))]) if parts else np.zeros(1, np.int64)
    y = np.array([label for _, label in rows], float)
    model = {"mean": x.mean(axis=0) if len(x) else np.zeros(WIDTH), "scale": x.std(axis=0) + 1e-3 if len(x) else np.ones(WIDTH),
             "E": random.normal(0, 0.3, (WIDTH, HIDDEN)), "e": np.zeros(HIDDEN), "V": random.normal(0, 0.3, (HIDDEN, GATE)),
             "U": random.normal(0, 0.3, (HIDDEN, GATE)), "w": np.zeros(GATE), "c": np.zeros(HIDDEN), "b": np.zeros(1)}
    if not 0 < y.sum() < len(y):
        return model
    learned = ("E", "e", "V", "U", "w", "c", "b")
    m, v = ({k: np.zeros_like(model[k]) for k in learned} for _ in range(2))
    for step in range(1, epochs + 1):
        f = forward(model, x, bounds)
        d = (f["p"] - y) / len(y)
        dz = d[:, None] * model["c"]
        spread = dz[f["bag"]]
        dh = f["a"][:, None] * spread
        da = (f["h"] * spread).sum(axis=1)
        ds = f["a"] * (da - _per_bag(f["a"] * da, bounds)[f["bag"]])
        du = ds[:, None] * model["w"]
        dt, dg = du * f["g"] * (1 - f["t"] ** 2), du * f["t"] * f["g"] * (1 - f["g"])
        dh += dt @ model["V"].T + dg @ model["U"].T
        de = dh * (1 - f["h"] ** 2)
        grads = {"E": f["x"].T @ de, "e": de.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
                 "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ d, "b": d.sum(keepdims=True)}
        for k in learned:
            grad = grads[k] + DECAY * model[k] * (k not in ("e", "b"))
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad ** 2
            model[k] -= RATE * m[k] / (1 - 0.9 ** step) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    return model


SCORED = "doc_id long, score double, passages int, best int, weight double"


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Each text's score, its passages, and the passage with the largest attention weight."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch, "text"):
                x, bounds = describe(*texts.text_bytes(part.column("text")))
                f = forward(model, x, bounds)
                order = np.lexsort((-f["a"], f["bag"]))
                best = order[bounds[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(f["p"]), pa.array(np.diff(bounds).astype(np.int32)),
                     pa.array((best - bounds[:-1]).astype(np.int32)), pa.array(f["a"][best])],
                    names=["doc_id", "score", "passages", "best", "weight"])
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, SCORED)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and the attention's choice of every document."""
    model = fit(labelled.sample(docs, labels, "quality", rows))
    return score(docs, model).select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= threshold).cast("int").alias("predicted"), "passages", "best", "weight")
