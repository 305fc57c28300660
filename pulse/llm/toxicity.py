"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from hashed words and word beginnings;
the document's is their noisy-or, 1 - prod(1 - p). Only documents are labelled: the likelihood of the
document labels trains the sentence weights, so a toxic document teaches through the sentence that
explains it and a clean one through all of its sentences. The fitted sentence scores then locate the
offending sentences.

Defined results: a null or empty text has no sentence and scores ``LEAK``; without any label of both
kinds the weights stay at zero and every text scores by the prior; ids, languages and sources are never
inputs; rows are scored each; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm import labelled, texts

BUCKETS = 1 << 18
BEGINNINGS = (4, 5, 6)  # bytes of a word
LEAK = 1e-3
EPOCHS, RATE, DECAY = 60, 40.0, 1e-6
FEWEST, SURE = 4, 5.0  # documents with a bucket, and standard deviations above chance, to use it

_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?\"'()")] = True


def sentences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_offsets: np.ndarray) -> np.ndarray:
    """Mask of the words that begin a sentence: the first of a text, one after a stop or a line end."""
    first = np.zeros(len(starts), bool)
    if not len(starts):
        return first
    lines = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=lines[1:])
    first[1:] = _STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    heads = word_offsets[:-1][np.diff(word_offsets) > 0]
    first[heads] = True
    return first


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Buckets of each word: itself in lower case without marks around it, and its beginnings."""
    low = starts + _MARK[data[starts]]
    high = np.maximum(low, ends - _MARK[data[ends - 1]])
    columns = [texts.word_hashes(data, low, high, texts.LETTER_LOWER)]
    for n in BEGINNINGS:
        part = texts.word_hashes(data, low, np.minimum(high, low + n), texts.LETTER_LOWER)
        columns.append(texts.mix(part + np.uint64(n)))
    return np.stack([(c % np.uint64(BUCKETS)).astype(np.int64) for c in columns], axis=1)


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets by word, first word of each sentence, first sentence of each text, word offsets)."""
    starts, ends, word_offsets = texts.words(data, offsets)
    heads = np.flatnonzero(sentences(data, starts, ends, word_offsets))
    return features(data, starts, ends), heads, np.searchsorted(heads, word_offsets), word_offsets


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log of the probability that no sentence of each text is toxic."""
    logs = np.zeros(len(p) + 1)
    np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)), out=logs[1:])
    return logs[bounds[1:]] - logs[bounds[:-1]] + np.log1p(-LEAK)


def _some(column: list[str], count: int = 200):
    """(first text, *bags) of a few texts at a time, so that fitting needs little memory."""
    for first in range(0, len(column), count):
        yield first, *bags(*texts.text_bytes(pa.array(column[first:first + count], pa.large_string())))


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights by bucket, bias) that maximise the likelihood of the document labels, by gradient steps with
    momentum: a bucket met in many toxic documents grows fast, one met in few slowly."""
    weights, bias = np.zeros(BUCKETS), -5.0
    rows = list(dict(rows).items())  # equal texts would count a chance word many times
    y = np.array([label for _, label in rows], float)
    if not 0 < y.sum() < len(y):
        return weights.astype(np.float32), bias
    column, n_docs = [text for text, _ in rows], len(rows)
    # a bucket is used if it is met in toxic documents surely more often than by chance
    met, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for first, buckets, heads, bounds, word_offsets in _some(column):
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(word_offsets))
        pairs = np.unique(np.repeat(doc, buckets.shape[1]) * BUCKETS + buckets.ravel())
        met += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
        toxic += np.bincount(pairs % BUCKETS, y[first + pairs // BUCKETS], minlength=BUCKETS)
    rate = y.mean()
    common = (met >= FEWEST) & (toxic - met * rate >= SURE * np.sqrt(met * rate * (1 - rate)))
    at, bucket, per_doc, n = [], [], [], 0
    for _, buckets, heads, bounds, _ in _some(column):
        sentence = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(buckets)))
        live = common[buckets]
        pairs = np.unique(np.broadcast_to(sentence[:, None], buckets.shape)[live] * BUCKETS + buckets[live])
        at.append(pairs // BUCKETS + n)
        bucket.append(pairs % BUCKETS)
        per_doc.append(np.diff(bounds))
        n += len(heads)
    at, bucket, per_doc = np.concatenate(at), np.concatenate(bucket), np.concatenate(per_doc)
    bounds = np.concatenate([[0], np.cumsum(per_doc)])
    used, bucket = np.unique(bucket, return_inverse=True)
    w, of_doc = np.zeros(len(used)), np.repeat(np.arange(n_docs), per_doc)
    step_w, step_b = np.zeros(len(used)), 0.0
    for _ in range(epochs):
        p = _sigmoid(bias + np.bincount(at, w[bucket], minlength=n))
        none = np.exp(noisy_or(p, bounds))
        pull = np.where(y == 1, -none / np.maximum(1 - none, 1e-6), 1.0) / len(rows)
        grad_z = pull[of_doc] * p
        step_w = 0.9 * step_w - RATE * (np.bincount(bucket, grad_z[at], minlength=len(used)) + DECAY * w)
        step_b = 0.9 * step_b - 0.05 * np.clip(grad_z.sum(), -1, 1)
        w = np.clip(w + step_w, 0, 12)  # a word can only add to a sentence's offence
        bias += step_b
    weights[used] = w
    return weights.astype(np.float32), float(bias)


SCORED = "doc_id long, score double, offending array<struct<first:int,words:int,score:double>>"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("score", pa.float64())]))


def score(docs: DataFrame, model: tuple[np.ndarray, float], offence: float = 0.5) -> DataFrame:
    """Each text's score and its offending sentences (first word, words, score)."""
    weights, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch, "text"):
                buckets, heads, bounds, word_offsets = bags(*texts.text_bytes(part.column("text")))
                by_sentence = np.zeros(0)
                if len(heads):
                    # a bucket counts once in a sentence, as in fitting
                    owner = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(buckets)))
                    live = weights[buckets] != 0
                    pairs = np.unique(np.broadcast_to(owner[:, None], buckets.shape)[live] * BUCKETS + buckets[live])
                    by_sentence = _sigmoid(bias + np.bincount(pairs // BUCKETS, weights[pairs % BUCKETS], minlength=len(heads)))
                whole = 1 - np.exp(noisy_or(by_sentence, bounds))
                spans = [[] for _ in range(part.num_rows)]
                lengths = np.diff(heads, append=len(buckets))
                for s in np.flatnonzero(by_sentence >= offence).tolist():
                    d = int(np.searchsorted(bounds, s, "right")) - 1
                    spans[d].append({"first": int(heads[s] - word_offsets[d]), "words": int(lengths[s]), "score": float(by_sentence[s])})
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.clip(whole, 0, 1)), pa.array(spans, _SPANS)],
                                                 names=["doc_id", "score", "offending"])
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, SCORED)


def classify(docs: DataFrame, labels: DataFrame, rows: int = labelled.SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, offending of every document."""
    model = fit(labelled.sample(docs, labels, "toxic", rows))
    return score(docs, model).select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
