"""Quality rules by distribution divergence.

Base rules come first: a text with few words or mostly repeated phrases fails. For the others the
histograms of character classes and of common words are compared with language references by
Jensen-Shannon distance (base 2, so 0 to 1). A reference is the summed histogram of all texts of one
language that pass the base rules; a text is judged against the nearest of its own language's and the
``MOST_SHARED`` largest references, so a wrong tag of one of these does no harm. Short texts have noisy
histograms: each comparison has a minimum length below which it is not made.

A language has a reference when it has ``MIN_LANGUAGE_WORDS`` words of its own, however much of other
languages there is. The largest are collected; texts of any further language meet theirs by a join.

Defined results: a null or empty text has no words and fails the base rules; a null language adds to
no reference; only the base rules decide on a text whose language is null or has no reference; repeated
rows are judged each; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm import texts
from pulse.session import stored

MIN_WORDS, MAX_REPEATED = 50, 50  # fixed by the contract: words, per cent of words
CHAR_LIMIT, WORD_LIMIT = 0.30, 0.35
CHAR_GUARD, WORD_GUARD = 200, 80  # characters, words
MIN_LANGUAGE_WORDS = 2000
MOST_SHARED = 1000

SYMBOLS = b"#*$%&|<>"
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
           "space": b" \t\n\x0b\x0c\r", "mark": b".,;:!?'\"()-"}
# Function words of the languages covered; a word counts in lower case with no mark at its end.
COMMON = sorted(set("""
the of and to in a is that it for on was with as by be are this at from have not or an
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden
le de un et la les des en une que est pour qui dans par sur pas au avec ce il du plus se
el la de que y en un los del se las por con para una su al lo como más o pero sus es
""".split()))

N_CLASS, N_WORD = len(CLASSES) + 2, len(COMMON) + 1
_CLASS_OF = np.full(256, len(CLASSES), np.int64)  # other ASCII
_CLASS_OF[128:] = len(CLASSES) + 1  # beyond ASCII
for _i, _letters in enumerate(CLASSES.values()):
    _CLASS_OF[list(_letters)] = _i
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(b".,;:!?")] = True

STATS = ("doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
         "n_repeat_words long, chars array<int>, words array<int>")
_STATS_ARROW = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((n, pa.int64()) for n in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    ("chars", pa.list_(pa.int32())), ("words", pa.list_(pa.int32()))])


def _common_hashes() -> tuple[np.ndarray, np.ndarray]:
    encoded = [w.encode() for w in COMMON]
    data = np.frombuffer(b" ".join(encoded), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in encoded]) - 1
    hashes = texts.word_hashes(data, ends - [len(w) for w in encoded], ends, texts.LETTER_LOWER)
    order = np.argsort(hashes)
    return hashes[order], order


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is one of two or more equal entries of its owner, has an equal entry before it)."""
    mixed = texts.mix(keys + texts.mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(mixed, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = mixed[order][1:] == mixed[order][:-1]
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return any_, later


def measure(data: np.ndarray, offsets: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, word_offsets = texts.words(data, offsets)
    counts = np.diff(word_offsets)
    owner = np.repeat(np.arange(n), counts)
    first_byte = (data & 0xC0) != 0x80
    solid = ~texts.IS_SPACE[data]

    # lines with a word, compared as whole byte strings
    breaks = np.flatnonzero(data == 10)
    line_starts = np.union1d(offsets[:-1], breaks + 1).astype(np.int64)
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    closed = (line_ends > line_starts) & (data[np.maximum(line_ends - 1, 0)] == 10) if len(data) else np.zeros(0, bool)
    line_ends = line_ends - closed
    solid_sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=solid_sums[1:])
    full = solid_sums[line_ends] > solid_sums[line_starts]
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_owner = np.searchsorted(offsets, line_starts, "right") - 1
    _, later = _repeats(texts.word_hashes(data, line_starts, line_ends), line_owner)

    hashes = texts.word_hashes(data, starts, ends)
    covered = np.zeros(len(hashes), bool)
    inside = np.flatnonzero(texts.whole_windows(word_offsets, 3))
    if len(inside):
        again, _ = _repeats(texts.window_hashes(hashes, 3)[inside], owner[inside])
        for step in range(3):
            covered[inside[again] + step] = True

    byte_owner = np.repeat(np.arange(n), np.diff(offsets))
    chars = np.bincount((byte_owner * N_CLASS + _CLASS_OF[data])[first_byte], minlength=n * N_CLASS)
    bare = ends - _IS_MARK[data[np.maximum(ends - 1, 0)]]
    lower = texts.word_hashes(data, starts, np.maximum(bare, starts), texts.LETTER_LOWER)
    place = np.minimum(np.searchsorted(common[0], lower), len(common[0]) - 1)
    bins = np.where(common[0][place] == lower, common[1][place], N_WORD - 1)
    return {"n_words": counts, "word_chars": _per_text(first_byte & solid, offsets),
            "n_symbols": _per_text(_IS_SYMBOL[data], offsets),
            "n_dup_lines": np.bincount(line_owner[later], minlength=n),
            "n_repeat_words": _per_text(covered, word_offsets), "chars": chars.reshape(n, N_CLASS),
            "words": np.bincount(owner * N_WORD + bins, minlength=n * N_WORD).reshape(n, N_WORD)}


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common = _common_hashes()
    for batch in batches:
        for part in texts.slices(batch, "text"):
            data, offsets = texts.text_bytes(part.column("text"))
            found = measure(data, offsets, common)
            columns = [part.column("doc_id"), part.column("lang")]
            columns += [pa.array(found[f.name].astype(np.int64)) for f in list(_STATS_ARROW)[2:7]]
            for name in ("chars", "words"):
                grid = found[name]
                ends = np.arange(grid.shape[0] + 1, dtype=np.int32) * grid.shape[1]
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(grid.ravel().astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, schema=_STATS_ARROW)


def statistics(docs: DataFrame) -> DataFrame:
    """Counts and histograms of every whole text."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"),
                       docs["text"].cast("string").alias("text")).mapInArrow(_measured, STATS)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


class References(NamedTuple):
    """The ``most`` largest references, and a table of all others (None when there are none)."""
    langs: list[str]
    chars: np.ndarray
    words: np.ndarray
    rest: DataFrame | None


def references(stats: DataFrame, most: int = MOST_SHARED) -> References:
    """Character and word histograms of every language with enough words; ``most`` rows are collected."""
    def total(name: str, width: int):
        return F.array(*(F.sum(F.col(name)[i]) for i in range(width))).alias(name)
    passed = stats.filter(~base_failed() & F.col("lang").isNotNull())
    own = stored(passed.groupBy("lang").agg(F.sum("n_words").alias("size"), total("chars", N_CLASS), total("words", N_WORD))
                 .filter(F.col("size") >= MIN_LANGUAGE_WORDS), "quality-references")  # one row per language
    rows = own.orderBy(F.desc("size"), "lang").limit(most + 1).collect()
    langs = [r["lang"] for r in rows[:most]]
    rest = own.filter(~F.col("lang").isin(langs)) if len(rows) > most else None
    return References(langs, np.array([r["chars"] for r in rows[:most]], float).reshape(-1, N_CLASS),
                      np.array([r["words"] for r in rows[:most]], float).reshape(-1, N_WORD), rest)


def _meet(rows: DataFrame, refs: References, run: Callable, schema) -> DataFrame:
    """``run`` over ``rows``, each with columns ``names``: has a reference, and its own histograms if not shared.

    Only texts of languages that are not shared are joined, so no key of the join is a large one.
    """
    known, chars, words = names = [texts.fresh(n, rows) for n in ("known", "own_chars", "own_words")]
    lang, counts = rows["lang"].cast("string"), "array<bigint>"
    shared = F.coalesce(lang.isin(refs.langs), F.lit(False))
    none = F.lit(None).cast(counts)
    if refs.rest is None:
        return rows.select("*", shared.alias(known), none.alias(chars), none.alias(words)).mapInArrow(run(names), schema)
    key = texts.fresh("own_lang", rows)
    other = refs.rest.select(F.col("lang").alias(key), F.col("chars").alias(chars), F.col("words").alias(words))
    apart = (rows.filter(~shared & lang.isNotNull()).join(other, lang == F.col(key), "left")
             .withColumn(known, F.col(key).isNotNull()).drop(key))
    rows = rows.filter(shared | lang.isNull()).select("*", shared.alias(known), none.alias(chars), none.alias(words))
    return rows.unionByName(apart).mapInArrow(run(names), schema)


def distance(counts: np.ndarray, refs: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to its nearest reference (0 for an empty row).

    ``own`` has one more reference for each row, of zeros where there is none."""
    def share(x):
        total = x.sum(axis=1, keepdims=True)
        return np.divide(x, total, out=np.zeros_like(x, float), where=total > 0)

    def divergence(p, m):
        return np.where(p > 0, p * np.log2(np.where(p > 0, p, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)

    def between(p, q):
        m = (p + q) / 2
        return (divergence(p, m) + divergence(np.broadcast_to(q, p.shape), m)) / 2
    p, best = share(counts.astype(float)), np.full(len(counts), np.inf)
    for q in share(refs):
        best = np.minimum(best, between(p, q))
    if own is not None:
        some = own.sum(axis=1) > 0
        best[some] = np.minimum(best[some], between(p[some], share(own[some])))
    best[counts.sum(axis=1) == 0] = 0
    return np.sqrt(np.clip(best, 0, 1))


VERDICTS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "base_failed boolean, kept boolean, char_distance double, word_distance double")


def _own(column: pa.Array, width: int) -> np.ndarray | None:
    """Histograms of a column of arrays, zeros for nulls; None when all are null."""
    if column.null_count == len(column):
        return None
    grid = np.zeros((len(column), width))
    grid[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy().reshape(-1, width)
    return grid


def divergent(part: pa.RecordBatch, names: list[str], chars: np.ndarray, words: np.ndarray, refs: References,
              char_limit: float, word_limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is too far from every language, character distance, word distance); 0 below a guard or without a reference."""
    known = part.column(names[0]).to_numpy(zero_copy_only=False)
    far = [np.zeros(len(chars)), np.zeros(len(chars))]
    if known.any():
        far = [distance(chars, refs.chars, _own(part.column(names[1]), N_CLASS)),
               distance(words, refs.words, _own(part.column(names[2]), N_WORD))]
        far[0][~known | (chars.sum(axis=1) < CHAR_GUARD)] = 0
        far[1][~known | (words.sum(axis=1) < WORD_GUARD)] = 0
    return (far[0] > char_limit) | (far[1] > word_limit), *far


def verdicts(stats: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT,
             most: int = MOST_SHARED) -> DataFrame:
    """One row per row of ``stats``."""
    refs = references(stats, most)
    shared = refs._replace(rest=None)  # goes to the tasks

    def judging(names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                grids = [batch.column(name).flatten().to_numpy().reshape(n, width)
                         for name, width in (("chars", N_CLASS), ("words", N_WORD))]
                bad, *far = divergent(batch, names, *grids, shared, char_limit, word_limit)
                failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(7)] + [pa.array(~failed & ~bad), *map(pa.array, far)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "base_failed", "kept", "char_distance", "word_distance"])
        return run
    rows = stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        base_failed().alias("base_failed"), "lang", "chars", "words")
    return _meet(rows, refs, judging, VERDICTS)


def judge(docs: DataFrame) -> DataFrame:
    """Statistics are written once: the references need all of them before the first verdict."""
    return verdicts(stored(statistics(docs), "quality-statistics"))


def keep_good(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT,
              most: int = MOST_SHARED) -> DataFrame:
    """The rows of ``docs`` whose text is kept, all columns.

    The second scan measures each text again beside its row, which costs less than shuffling texts to
    meet a verdict and needs no key.
    """
    refs, columns = references(statistics(docs), most), docs.columns
    shared = refs._replace(rest=None)  # goes to the tasks

    def keeping(names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common = _common_hashes()
            for batch in batches:
                for part in texts.slices(batch, "text"):
                    found = measure(*texts.text_bytes(part.column("text")), common)
                    n = found["n_words"]
                    failed = (n < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEATED * n)
                    bad, *_ = divergent(part, names, found["chars"], found["words"], shared, char_limit, word_limit)
                    yield part.select(columns).filter(pa.array(~failed & ~bad))
        return run
    return _meet(docs, refs, keeping, docs.schema)
