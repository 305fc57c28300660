"""N-gram Jaccard join by T-occurrence search, returned as classes of linked documents.

1. Every document becomes the set of hashes of its 4-word shingles. Documents with equal sets are one
   class (a signature of the set), so copies never meet each other again.
2. Counting filter. A linked set misses at most 15 in 100 of its shingles in its partner, so at most so
   many of a fixed third of the hash space too. The shingles of that third are dealt out by range and
   counted; a set with more of them to itself than it may miss has no partner. No link is lost, and
   documents that merely share passages go.
3. Routing. A set in a size band is cut into k parts by the hash of its members, k exceeding the number
   of members by which two linked sets of the band can differ; so two linked sets agree in a whole part.
   The parts' hashes are dealt out by range, and sets that share one are tied to the smallest of them
   (one row a set, never pairs). The ties' components are the candidate groups: every link lies inside
   one. No two sets are compared or paired to find them. Chance agreements chain small sets of a large
   input to one huge group, so a group over ``BLOCK`` shingles is dealt out again: there, sets that share
   a part are tied only if short sketches of them differ by no more than a link allows (``refined``).
4. T-occurrence search inside a group: inverted lists of the group's shingles; for each query set the L
   longest lists are put aside, the short ones are merged (by one sort), and what occurs often enough
   there is probed in the long ones by binary search (DivideSkip), giving up as soon as the threshold is
   out of reach. Sets already connected with the query need no probe. A task holds one group, or two slices
   of a group over ``BLOCK`` shingles (see ``links``).
5. The links' components are the classes.

Hashes have 64 bits: two shingles (or sets) are taken for equal with probability 2^-64 a pair.

Defined results: a null or empty text has no shingles, is linked with nothing and is its own class;
fewer words than four are one shingle; a null id is no class id unless all ids of the class are null;
repeated rows are copies; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm import texts
from pulse.llm.components import Classes, components, forest_edges
from pulse.session import stored

WORDS, SHARE = 4, 85  # words of a shingle; Jaccard similarity in per cent
BLOCK = 1_000_000  # shingles that one search task holds of a group
RANGES_PER_PARTITION = 2
COUNTED = (1 << 64) // 3  # shingle hashes below this are counted by the filter
BAND = 1.2  # ratio of the sizes a band spans
WIDTHS, WIDE_BAND = (128, 1024), 40  # counts of a sketch, in the bands before 1,500 members and from there on
PAIRED, ROUNDS = 512, 1024  # sets of one part hash that sketches compare in pairs; first sets that more are held against

_ONE, _TWO = np.uint64(0x9E6C63D0676A9A99), np.uint64(0xC2B2AE3D27D4EB4F)


def sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; A-Z counts as a-z."""
    starts, ends, word_offsets = texts.words(data, offsets)
    hashes = texts.word_hashes(data, starts, ends, texts.LETTER_LOWER)
    shingles = texts.window_hashes(hashes, words)
    out = []
    for low, high in zip(word_offsets[:-1].tolist(), word_offsets[1:].tolist()):
        n = high - low
        if n >= words:
            own = np.sort(shingles[low:high - words + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif n:
            out.append(texts.window_hashes(hashes[low:high], n) + np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(own: np.ndarray) -> int:
    """A 64-bit value of a set, as a signed integer."""
    value = texts.mix(np.array([texts.mix(own ^ _ONE).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))
    return int(value.view(np.int64)[0])


def _summary(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """`signature` and number of counted shingles of sets that have a member, all at once."""
    sizes = np.array([len(s) for s in found], np.int64)
    heads = np.cumsum(sizes) - sizes
    flat = np.concatenate(found)
    sums = np.add.reduceat(texts.mix(flat ^ _ONE), heads) + sizes.astype(np.uint64)
    return texts.mix(sums).view(np.int64), np.add.reduceat((flat < np.uint64(COUNTED)).astype(np.int64), heads)


SIGNED = "doc_id long, n_shingles long, n_counted long, cls long, key long"


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, n_counted, cls (null without shingles), key (a hash of the text) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch, "text"):
                found = sets(*texts.text_bytes(part.column("text")), words)
                n = np.array([len(s) for s in found], np.int64)
                cls, counted = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                if n.any():
                    cls[n > 0], counted[n > 0] = _summary([s for s in found if len(s)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(counted), pa.array(cls, mask=n == 0), part.column("key")],
                    names=["doc_id", "n_shingles", "n_counted", "cls", "key"])
    return _keyed(docs).mapInArrow(run, SIGNED)


def _key(docs: DataFrame) -> Column:
    """What tells rows with null or reused ids apart: 64 bits of the text."""
    return F.xxhash64(docs["text"].cast("string"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), _key(docs).alias("key"))


def bands(n: int, share: int = SHARE) -> list[int]:
    """Bands in which a set of n members must show itself: its own, and the next if a larger partner can lie there."""
    own = int(math.log(n) / math.log(BAND) + 1e-9)
    largest = 100 * n // share
    top = int(math.log(largest) / math.log(BAND) + 1e-9)
    return list(range(own, top + 1))


def parts(band: int, share: int = SHARE) -> tuple[int, int]:
    """(number of parts, largest symmetric difference of two linked sets) of a band."""
    largest = int(BAND ** (band + 1)) + 1
    differ = 2 * largest * (100 - share) // (100 + share)
    # so many more that few sets have as many empty parts as could all be the ones that agree
    return (1, 0) if differ == 0 else (differ + 4 + differ // 7, differ)


def part_hashes(own: np.ndarray, share: int = SHARE, wide: bool | None = None) -> np.ndarray:
    """Hashes of the parts of a set, over its bands, or over those from ``WIDE_BAND`` on or before it."""
    out = [np.zeros(0, np.uint64)]
    for band in bands(len(own), share):
        if wide is not None and wide != (band >= WIDE_BAND):
            continue
        k, differ = parts(band, share)
        salt = np.uint64(band * 2 + 1)
        spread = texts.mix(own * _TWO + salt)
        part = (spread % np.uint64(k)).astype(np.int64)
        sums = np.zeros(k, np.uint64)
        np.add.at(sums, part, texts.mix(spread ^ _ONE))
        filled = np.bincount(part, minlength=k) > 0
        if k - int(filled.sum()) >= k - differ:  # agreement could lie in empty parts only
            filled[:] = True
        at = np.flatnonzero(filled).astype(np.uint64)
        out.append(texts.mix(sums[filled] + at * _TWO + texts.mix(np.array([salt]))))
    return np.unique(np.concatenate(out))


def _cut(target: np.ndarray) -> tuple[list[int], list[int]]:
    """Bounds of the runs of an ascending array."""
    cuts = (np.flatnonzero(np.diff(target)) + 1).tolist()
    return [0, *cuts], [*cuts, len(target)]


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of the rows that share their first column; rows arrive ordered by it."""
    held = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def shared_counts(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(cls, shared): how many of a set's counted shingles other rows have as well, in one row or more
    for each set.

    40 bits of a hash are compared; a chance agreement only makes the filter let a set pass. A shingle
    travels with the place of its set in its slice of the input, the slice's sets once beside them.
    """
    ranges = max(2, 1 << (RANGES_PER_PARTITION * texts.partitions(docs) - 1).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.uint64(COUNTED // ranges + 1)
        for batch in batches:
            for part in texts.slices(batch, "text", 16 << 20):
                found = [s for s in sets(*texts.text_bytes(part.column("text")), words) if len(s)]
                if not found:
                    continue
                seen = {}
                for name, counted, s in zip(*(x.tolist() for x in _summary(found)), found):
                    seen.setdefault(name, s[:counted])
                cls = np.fromiter(seen, np.int64, len(seen))
                name = signature(cls.view(np.uint64))
                hashes = np.concatenate(list(seen.values()))
                owner = np.repeat(np.arange(len(cls)), [len(s) for s in seen.values()])
                target = (hashes // step).astype(np.uint16 if ranges <= 1 << 16 else np.uint32)
                order = np.argsort(target, kind="stable")  # sets stay in order
                hashes, target, owner = hashes[order], target[order], owner[order]
                short = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
                rows = [(name % ranges, name, b"", b"", cls.tobytes())]
                for i, j in zip(*_cut(target)) if len(target) else ():
                    rows.append((int(target[i]), name, short[i:j].tobytes(), _steps(owner[i:j]), b""))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                                                 names=["part", "slice", "hashes", "owners", "cls"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        waiting = 0

        def flush():
            rows = []
            for name, pieces in found.items():
                own, n = _summed(pieces)
                rows.append((name, _steps(own), n.astype(np.uint32).tobytes(), b""))
            found.clear()
            return rows
        done = []
        for rows in _by_part(batches):
            done += [(r[1], b"", b"", r[4]) for r in rows if r[4]]
            rows = [r for r in rows if r[2]]
            if rows:
                raw = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, 5)
                hashes = np.zeros((len(raw), 8), np.uint8)
                hashes[:, :5] = raw
                hashes = hashes.view("<u8").ravel()
                owners = [_places(r[3], len(r[2]) // 5) for r in rows]
                width = 1 + max(int(o[-1]) for o in owners)
                owner = np.concatenate([o + width * k for k, o in enumerate(owners)])
                order = np.argsort(hashes)
                same = np.zeros(len(hashes) + 1, bool)
                same[1:-1] = hashes[order[1:]] == hashes[order[:-1]]
                own, n = np.unique(owner[order[same[1:] | same[:-1]]], return_counts=True)
                edges = np.searchsorted(own, np.arange(len(rows) + 1) * width)
                for k, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
                    if j > i:
                        found.setdefault(rows[k][1], []).append((own[i:j] - width * k, n[i:j]))
                waiting += len(own)
            if waiting > 1 << 20 or len(done) > 1000:
                yield _pieces(done + flush())
                done, waiting = [], 0
        done += flush()
        if done:
            yield _pieces(done)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches):
            cls = np.frombuffer(next(r[3] for r in rows if r[3]), np.int64)  # a slice read twice is the same slice
            n = np.zeros(len(cls), np.int64)
            for _, owners, counts, _ in rows:
                counts = np.frombuffer(counts, np.uint32)
                if len(counts):
                    n[_places(owners, len(counts))] += counts
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(n)], names=["cls", "shared"])
    dealt = _keyed(docs).mapInArrow(deal, "part int, slice long, hashes binary, owners binary, cls binary")
    counted = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(count, "slice long, owners binary, counts binary, cls binary")
    return counted.repartition("slice").sortWithinPartitions("slice").mapInArrow(total, "cls long, shared long")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                                      names=["slice", "owners", "counts", "cls"])


def _steps(places: np.ndarray) -> bytes:
    """Ascending places as differences of one, two or four bytes."""
    steps = np.diff(places, prepend=0)
    most = int(steps.max()) if len(steps) else 0
    return steps.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _places(steps: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(steps) // n]).astype(np.int64))


def _summed(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(np.concatenate([c for c, _ in pieces]), return_inverse=True)
    return own, np.bincount(at, np.concatenate([n for _, n in pieces])).astype(np.int64)


def candidates(docs: DataFrame, signed: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """(cls, n, members) of the sets that pass the counting filter; members are sorted hashes."""
    # a class in several slices may count its own copies; the largest count lets it pass at worst
    shared = shared_counts(docs, words).groupBy(F.col("cls").alias("__cls")).agg(F.max("shared").alias("shared"))
    reps = (signed.filter("n_shingles > 0").groupBy("cls")
            .agg(F.min(F.struct("doc_id", "key")).alias("who"), F.max("n_shingles").alias("n"), F.max("n_counted").alias("counted"))
            .join(shared, F.col("cls") == F.col("__cls"), "left")
            .filter(F.col("counted") - F.coalesce("shared", F.lit(0)) <= F.floor(F.col("n") * (100 - share) / 100))
            .select(F.col("cls").alias("set"), F.col("who.doc_id").alias("__doc"), F.col("who.key").alias("__key")))
    keyed = _keyed(docs)
    rows = keyed.join(reps, keyed["doc_id"].eqNullSafe(F.col("__doc")) & (keyed["key"] == F.col("__key"))).select("set", "text")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch, "text"):
                found = sets(*texts.text_bytes(part.column("text")), words)
                yield pa.RecordBatch.from_arrays([part.column("set"), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())],
                                                 names=["cls", "n", "members"])
    return rows.mapInArrow(expand, "cls long, n long, members binary")


def ties(found: DataFrame, share: int = SHARE) -> DataFrame:
    """(a, b): set a is tied to set b, by tasks' forests."""
    ranges = max(2, 1 << (4 * texts.partitions(found) - 1).bit_length())
    shift = np.uint64(64 - (ranges - 1).bit_length())
    kind = np.uint16 if ranges <= 1 << 16 else np.uint32

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                own = [part_hashes(np.frombuffer(m, np.uint64), share) for m in part.column("members").to_pylist()]
                hashes = np.concatenate(own)
                cls = np.repeat(part.column("cls").to_numpy(), [len(f) for f in own])
                target = (hashes >> shift).astype(kind)
                order = np.argsort(target, kind="stable")
                hashes, cls, target = hashes[order], cls[order], target[order]
                rows = [(int(target[i]), hashes[i:j].tobytes(), cls[i:j].tobytes()) for i, j in zip(*_cut(target))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                                 names=["part", "hashes", "cls"])

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, waiting = [], [], 0

        def flush():
            node, root = forest_edges(np.concatenate(a), np.concatenate(b))
            a.clear()
            b.clear()
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])
        for rows in _by_part(batches):
            hashes = np.frombuffer(b"".join(r[1] for r in rows), np.uint64)
            cls = np.frombuffer(b"".join(r[2] for r in rows), np.int64)
            order = np.argsort(hashes, kind="stable")
            hashes, cls = hashes[order], cls[order]
            begins = np.concatenate([[0], np.flatnonzero(hashes[1:] != hashes[:-1]) + 1])
            center = np.repeat(np.minimum.reduceat(cls, begins), np.diff(begins, append=len(cls)))
            other = cls != center
            pairs = np.unique(np.stack([cls[other], center[other]]), axis=1)
            a.append(pairs[0])
            b.append(pairs[1])
            waiting += pairs.shape[1]
            if waiting > 500_000:
                yield flush()
                waiting = 0
        if waiting:
            yield flush()
    dealt = found.select("cls", "members").mapInArrow(deal, "part int, hashes binary, cls binary")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(tie, "a long, b long")


def sketches(members: list[np.ndarray], width: int = WIDTHS[0]) -> np.ndarray:
    """How many members of a set fall in each of ``width`` ranges of a hash, 255 at most. The sketches of two
    sets differ by no more than the sets do, so what differs by more than a link allows is not linked."""
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    at = (texts.mix(np.concatenate(members) ^ _TWO) % np.uint64(width)).astype(np.int64)
    counts = np.bincount(owner * width + at, minlength=len(members) * width)
    return np.minimum(counts, 255).astype(np.uint8).reshape(-1, width)


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differences of sketches, row by row."""
    return np.abs(left.astype(np.int16) - right).sum(axis=-1, dtype=np.int64)


def near_ties(hashes: np.ndarray, owner: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, share: int = SHARE) -> np.ndarray:
    """Label of every set: sets that share a hash and may be linked by their sketches have the same.

    Sets of a hash are compared in pairs while they are few. Of many, all that are as near to the first as
    twice what a link allows are tied to it, and those within what a link allows are done: what is linked
    with them is tied by now. After ``ROUNDS`` of this the rest is tied as it is.
    """
    found = Classes(len(sizes))
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    begins = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    lengths = np.diff(begins, append=len(hashes))

    def allowed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (sizes[a] + sizes[b]) * (100 - share) // (100 + share)
    twos = begins[lengths == 2]
    pairs = np.unique(np.stack([owner[twos], owner[twos + 1]]), axis=1) if len(twos) else np.zeros((2, 0), np.int64)
    step = (1 << 22) // sketch.shape[1]
    for at in range(0, pairs.shape[1], step):
        a, b = pairs[:, at:at + step]
        near = _apart(sketch[a], sketch[b]) <= allowed(a, b)
        for x, y in zip(a[near].tolist(), b[near].tolist()):
            found.join(x, y)
    for begin, end in zip(begins[lengths > 2].tolist(), (begins + lengths)[lengths > 2].tolist()):
        pool = owner[begin:end]
        if (found.label[pool] == found.label[pool[0]]).all():
            continue
        pool, rounds = np.unique(pool), 0
        while len(pool) > 1:
            c, rest = pool[0], pool[1:]
            rounds += 1
            if rounds > ROUNDS:
                tied = rest = pool
            elif len(rest) < PAIRED:
                tied = rest[found.label[rest] != found.label[c]]
                tied = tied[_apart(sketch[tied], sketch[c]) <= allowed(tied, c)]
            else:
                far, most = _apart(sketch[rest], sketch[c]), 2 * int(sizes[pool].max()) * (100 - share) // (100 + share)
                tied, rest = rest[far <= 2 * most], rest[far > most]
            for x in tied.tolist():
                found.join(int(c), x)
            pool = rest if rounds <= ROUNDS else rest[:0]
            if len(pool) and (found.label[pool] == found.label[pool[0]]).all():
                break
    return found.label


def refined(found: DataFrame, groups: DataFrame, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """``groups`` (node, root) with those of more than ``block`` shingles dealt out anew by ``near_ties``.

    Sets that share a part by chance chain ever more small sets to one group as the input grows, which has
    no more links for that; sketches break such chains. No link is lost.
    """
    labels = groups.union(groups.select("root", "root").distinct())
    grouped = stored(found.select("cls", "n").join(labels, F.col("cls") == F.col("node")).select("cls", "root", "n"), "jaccard-grouped")
    large = grouped.groupBy(F.col("root").alias("__root")).agg(F.sum("n").alias("n")).filter(F.col("n") > block)
    total = large.agg(F.sum("n")).first()[0]
    if total is None:
        return groups
    large = stored(large.select("__root"), "jaccard-large")
    inside = grouped.join(large, F.col("root") == F.col("__root")).select(F.col("cls").alias("__cls"))
    rows = found.select("cls", "members").join(inside, F.col("cls") == F.col("__cls")).select("cls", "members")
    ranges = 1 << max(1, (total >> 18).bit_length())
    shift = np.uint64(64 - (ranges - 1).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets_ = [np.frombuffer(m, np.uint64) for m in part.column("members").to_pylist()]
                cls, sizes = part.column("cls").to_numpy(), np.array([len(m) for m in sets_], np.int32)
                for wide in (False, True):
                    own = [part_hashes(m, share, wide) for m in sets_]
                    here = np.flatnonzero([len(f) for f in own])  # most sets are small, or large
                    if len(here):
                        sketch = np.zeros((len(sets_), WIDTHS[wide]), np.uint8)
                        sketch[here] = sketches([sets_[i] for i in here], WIDTHS[wide])
                        yield dealt_out(own, cls, sizes, sketch, wide)

    def dealt_out(own: list[np.ndarray], cls: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, wide: bool) -> pa.RecordBatch:
        hashes, owner = np.concatenate(own), np.repeat(np.arange(len(own)), [len(f) for f in own])
        target = hashes >> shift
        order = np.argsort(target, kind="stable")
        hashes, owner, target = hashes[order], owner[order], target[order]
        rows = []
        for i, j in zip(*_cut(target)):
            held, place = np.unique(owner[i:j], return_inverse=True)  # a set once in a range
            rows.append((2 * int(target[i]) + wide, hashes[i:j].tobytes(), place.astype(np.uint16).tobytes(), cls[held].tobytes(),
                         sizes[held].tobytes(), sketch[held].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 5))],
                                          names=["part", "hashes", "owners", "cls", "sizes", "sketches"])

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches):
            cls = [np.frombuffer(r[3], np.int64) for r in rows]
            first = np.cumsum([0, *map(len, cls)])
            owner = np.concatenate([np.frombuffer(r[2], np.uint16) + base for r, base in zip(rows, first.tolist())])
            hashes, sizes, sketch = (np.frombuffer(b"".join(r[i] for r in rows), t) for i, t in ((1, np.uint64), (4, np.int32), (5, np.uint8)))
            names, at = np.concatenate(cls), near_ties(hashes, owner, sizes.astype(np.int64), sketch.reshape(len(sizes), -1), share)
            other = at != np.arange(len(at))
            yield pa.RecordBatch.from_arrays([pa.array(names[other]), pa.array(names[at[other]])], names=["a", "b"])
    dealt = rows.mapInArrow(deal, "part int, hashes binary, owners binary, cls binary, sizes binary, sketches binary")
    ties_ = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(tie, "a long, b long")
    return groups.join(large, F.col("root") == F.col("__root"), "left_anti").union(components(ties_, "jaccard-refined"))


MU = 0.0085  # weight of a merge step against a probe, as the method's authors found
PROBE = 8  # merge steps that a probe costs in arrays


def search(members: list[np.ndarray], share: int = SHARE) -> list[tuple[int, int]]:
    """Links that connect linked sets (a spanning forest of them), by DivideSkip."""
    order = sorted(range(len(members)), key=lambda i: len(members[i]))
    sizes = np.array([len(members[i]) for i in order])
    tokens = np.concatenate([members[i] for i in order])
    owner = np.repeat(np.arange(len(order), dtype=np.int32), sizes)
    by_token = np.argsort(tokens, kind="stable")  # lists ascend by owner
    in_order = tokens[by_token]
    heads = np.flatnonzero(np.append(True, in_order[1:] != in_order[:-1]))
    counts = np.diff(heads, append=len(tokens))
    inverse = np.empty(len(tokens), np.int64)
    inverse[by_token] = np.repeat(np.arange(len(heads)), counts)
    postings = owner[by_token]
    of_query = np.cumsum(sizes) - sizes
    sets_ = [members[i] for i in order]
    classes_, links = Classes(len(order)), []
    for q in range(1, len(order)):
        n = int(sizes[q])
        lists = inverse[of_query[q]:of_query[q] + n]
        lengths = counts[lists]
        least = -(-share * n // 100)  # no partner, smaller or larger, shares fewer
        if int((lengths > 1).sum()) < least:
            continue
        longest = int(lengths.max())
        n_long = min(least - 1, int(least / (MU * math.log2(longest) + 1)))
        rank = np.argsort(lengths, kind="stable")
        short, long_ = lists[rank[:n - n_long]], lists[rank[n - n_long:]]
        merged = postings[texts.ranges(heads[short], counts[short])]
        merged = merged[merged < q]  # partners of the same size or smaller
        occurs = np.bincount(merged)
        found = np.flatnonzero(occurs)
        occurs = occurs[found]
        needed = -(-share * (n + sizes[found]) // (100 + share))
        alive = occurs + n_long >= needed
        found, occurs, needed = found[alive], occurs[alive], needed[alive]
        while len(found):  # a link with the likeliest one settles its whole class
            c = int(found[np.argmax(occurs - needed)])
            both = np.searchsorted(sets_[c], sets_[q])
            both = int((sets_[c][np.minimum(both, len(sets_[c]) - 1)] == sets_[q]).sum())
            if 100 * both < share * (n + len(sets_[c]) - both):
                break
            classes_.join(q, c)
            links.append((order[q], order[c]))
            apart = classes_.label[found] != classes_.label[q]
            found, occurs, needed = found[apart], occurs[apart], needed[apart]
        if len(found) * n_long * PROBE > int(counts[long_].sum()):  # so many probes cost more than to merge the rest
            occurs = occurs + np.bincount(postings[texts.ranges(heads[long_], counts[long_])], minlength=q)[found]
            long_ = long_[:0]
        for k, token in enumerate(long_.tolist()):
            if not len(found):
                break
            holders = postings[heads[token]:heads[token] + counts[token]]
            place = np.minimum(np.searchsorted(holders, found), len(holders) - 1)
            occurs = occurs + (holders[place] == found)
            alive = occurs + (n_long - k - 1) >= needed
            found, occurs, needed = found[alive], occurs[alive], needed[alive]
        for c in found[occurs >= needed].tolist():
            if classes_.join(q, c):
                links.append((order[q], order[c]))
    return links


def _searched(found: DataFrame, placed: DataFrame, share: int) -> DataFrame:
    """(a, b): links found in blocks; ``placed`` has (__cls, root, blocks) with the blocks of each set."""
    rows = (found.select("cls", "members").join(placed, F.col("cls") == F.col("__cls"))
            .select("root", F.explode("blocks").alias("block"), "cls", "members").select("root", "block.low", "block.high", "cls", "members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(held):
            own = {r[3]: r[4] for r in held}  # a repeated row counts once
            names = list(own)
            pairs = search([np.frombuffer(own[c], np.uint64) for c in names], share)
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in pairs], pa.int64()), pa.array([names[j] for _, j in pairs], pa.int64())], names=["a", "b"])
        held = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if held and row[:3] != held[0][:3]:
                        yield settle(held)
                        held = []
                    held.append(row)
        if held:
            yield settle(held)
    return (rows.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "cls")
            .mapInArrow(run, "a long, b long"))


def _slices(rows: DataFrame, block: int, name: str) -> DataFrame:
    """root and ``name``: slices of about ``block`` shingles that the group's rows make."""
    return rows.groupBy("root").agg(F.ceil(F.sum("n") / block).cast("int").alias(name)).withColumnRenamed("root", f"__{name}")


def links(found: DataFrame, groups: DataFrame, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect what is linked; groups has a row (node, root) for each tied set.

    A group of several slices is not searched in all pairs of slices. First each slice is searched with
    itself and with slice 0, which connects most of a large class of near copies. Then only the sets
    outside the group's largest class so far are searched with every slice: two sets of one class need
    no link between them. The blocks grow with the slices times the slices of those others.
    """
    labels = groups.union(groups.select("root", "root").distinct())
    grouped = found.select("cls", "n").join(labels, F.col("cls") == F.col("node")).select("cls", "root", "n")
    grouped = stored(grouped.join(_slices(grouped, block, "slices"), F.col("root") == F.col("__slices"))
                     .select("cls", "root", "n", "slices", F.pmod(F.xxhash64("cls"), F.col("slices")).cast("int").alias("own")), "jaccard-groups")

    def pair(low, high):
        return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
    every = F.sequence(F.lit(0), F.col("slices") - 1)
    star = F.when(F.col("own") == 0, F.transform(every, lambda j: pair(F.lit(0), j))).otherwise(
        F.array(pair(F.lit(0), F.col("own")), pair(F.col("own"), F.col("own"))))
    first = stored(_searched(found, grouped.select(F.col("cls").alias("__cls"), "root", star.alias("blocks")), share), "jaccard-links")

    large = grouped.filter("slices > 2")  # two slices are wholly searched by now
    if large.isEmpty():
        return first
    so_far = components(first, "jaccard-so-far")
    large = large.join(so_far.select("node", F.col("root").alias("class")), F.col("cls") == F.col("node"), "left").withColumn(
        "class", F.coalesce("class", "cls"))
    largest = (large.groupBy("root", "class").agg(F.count(F.lit(1)).alias("size")).groupBy("root")
               .agg(F.max_by("class", F.struct("size", "class")).alias("largest")).withColumnRenamed("root", "__root"))
    large = stored(large.join(largest, F.col("root") == F.col("__root"))
                   .select("cls", "root", "n", "slices", "own", (F.col("class") != F.col("largest")).alias("apart")), "jaccard-apart")
    turns = _slices(large.filter("apart"), block, "turns")
    large = large.join(turns, F.col("root") == F.col("__turns"))
    own_turn = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("turns"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("turns") - 1), lambda k: pair(k, F.col("own")))
    blocks = F.when(F.col("apart"), F.array_union(blocks, F.transform(every, lambda j: pair(own_turn, j)))).otherwise(blocks)
    second = _searched(found, large.select(F.col("cls").alias("__cls"), "root", blocks.alias("blocks")), share)
    return first.union(second)


def _rooted(docs: DataFrame, words: int, share: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows of ``docs`` (doc_id, n_shingles, cls, key, ...), and (cls, root) of every class of equal sets."""
    docs = docs.select("doc_id", "text")
    signed = stored(signatures(docs, words), "jaccard-signatures")
    found = stored(candidates(docs, signed, words, share), "jaccard-candidates")
    groups = refined(found, components(ties(found, share), "jaccard-ties"), share, block)
    linked = components(links(found, groups, share, block), "jaccard-links")
    sets_ = signed.filter("cls is not null").select("cls").distinct()
    return signed, sets_.join(linked, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("root"))


def _best_of_root(signed: DataFrame, rooted: DataFrame, value: Column) -> DataFrame:
    """(__cls, best): the smallest value of all rows whose class has the same root, for every class."""
    per_class = signed.filter("cls is not null").groupBy("cls").agg(F.min(value).alias("least")).join(rooted, "cls")
    per_root = per_class.groupBy("root").agg(F.min("least").alias("best")).withColumnRenamed("root", "__root")
    return rooted.join(per_root, F.col("root") == F.col("__root")).select(F.col("cls").alias("__cls"), "best")


def classes(docs: DataFrame, words: int = WORDS, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    signed, rooted = _rooted(docs, words, share, block)
    named = _best_of_root(signed, rooted, F.col("doc_id"))
    return (signed.join(named, F.col("cls") == F.col("__cls"), "left")
            .select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("best")).alias("component_id")))


def keep_one(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """The rows of ``docs`` without those that are linked, directly or not, to one that comes before them.

    Rows come in the order of doc_id (null last), then of a hash of their text. Both together tell a row,
    so a null or reused id neither keeps a copy nor takes an unlinked row away. Rows equal in id and text
    are one document: all stay or all go. Texts without words stay; so does an empty table.
    """
    signed, rooted = _rooted(docs, words, share, BLOCK)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = _best_of_root(signed, rooted, own)
    beaten = signed.join(first, F.col("cls") == F.col("__cls")).filter(own != F.col("best"))
    name, key = (texts.fresh(n, docs) for n in ("gone", "gone_key"))
    gone = stored(beaten.select(F.col("doc_id").alias(name), F.col("key").alias(key)).distinct(), "jaccard-dropped")
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[name]) & (_key(docs) == gone[key]), "left_anti")
