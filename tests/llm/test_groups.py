"""Candidate groups of the near-copy join: chains by chance are broken, links are not."""

import random

import numpy as np
import pytest

from pulse.llm import jaccard
from pulse.llm.components import Classes, components


def passage(draw, n):
    return [f"w{draw.randrange(10**9)}" for _ in range(n)]


def linked(sets, share=85):
    out = []
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= share * (len(a) + len(b) - both):
                out.append((i, j))
    return out


def test_chains_are_broken_and_links_are_not(spark):
    draw = random.Random(5)
    # documents of three passages each: they share one or two, which links none but ties most
    pool = [passage(draw, 20) for _ in range(25)]
    texts = [sum(draw.sample(pool, 3), []) for _ in range(120)]
    texts += [t[:k] + ["x"] + t[k + 1:] for t in texts[:20] for k in (2, 58)]  # and 20 small classes
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = jaccard.candidates(docs, jaccard.signatures(docs))
    groups = components(jaccard.ties(found))

    def labelled(frame):
        label = {r.node: r.root for r in frame.collect()}
        return {r.cls: label.get(r.cls, r.cls) for r in found.select("cls").collect()}

    def largest(label):
        return max(list(label.values()).count(x) for x in set(label.values()))
    before, after = labelled(groups), labelled(jaccard.refined(found, groups, block=2_000))
    assert largest(before) > 80
    assert largest(after) < 10
    assert labelled(jaccard.refined(found, groups, block=10**6)) == before  # groups of one task stay as they are

    rows = found.collect()
    names, sets = [r.cls for r in rows], [np.frombuffer(r.members, np.uint64) for r in rows]
    links = linked(sets)
    assert len(links) >= 20
    assert all(after[names[i]] == after[names[j]] for i, j in links)


def test_chains_of_long_texts_are_broken(spark):
    draw = random.Random(7)
    # 2,000 words of ten passages each, one of them shared with every other text of its kind
    pool = [passage(draw, 200) for _ in range(100)]
    texts = [sum(draw.sample(pool, 10), []) for _ in range(30)]
    texts += [t[:900] + ["x"] + t[901:] for t in texts[:4]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = jaccard.candidates(docs, jaccard.signatures(docs))
    groups = components(jaccard.ties(found))
    after = {r.node: r.root for r in jaccard.refined(found, groups, block=10_000).collect()}
    assert groups.count() > 20  # nearly all in one group
    assert len(after) == 4  # only the four copies are tied
    rows = found.collect()
    names, sets = [r.cls for r in rows], [np.frombuffer(r.members, np.uint64) for r in rows]
    links = [(names[i], names[j]) for i, j in linked(sets)]
    assert len(links) == 4 and all(after.get(a, a) == after.get(b, b) for a, b in links)


@pytest.mark.parametrize("paired, rounds", [(512, 1024), (4, 1024), (4, 3)])
def test_sketches_lose_no_link(monkeypatch, paired, rounds):
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    draw = np.random.default_rng(11)
    common, sets = draw.integers(0, 1 << 63, 12, dtype=np.uint64), []
    for _ in range(25):
        base = draw.integers(0, 1 << 63, 60, dtype=np.uint64)
        for _ in range(8):
            own = base.copy()
            changed = draw.integers(0, 14)
            own[draw.integers(0, 60, changed)] = draw.integers(0, 1 << 63, changed, dtype=np.uint64)
            sets.append(np.unique(np.concatenate([own, common])))
    own = [jaccard.part_hashes(s) for s in sets]
    label = jaccard.near_ties(np.concatenate(own), np.repeat(np.arange(len(sets)), [len(o) for o in own]),
                              np.array([len(s) for s in sets]), jaccard.sketches(sets))
    links = linked(sets)
    assert len(links) > 100 and all(label[i] == label[j] for i, j in links)
    if rounds > len(sets):
        assert len(set(label.tolist())) >= 25


@pytest.mark.parametrize("n", [0, 9, 30])
def test_search_finds_all_classes_however_it_counts(monkeypatch, n):
    draw, sets = np.random.default_rng(n), []
    common = draw.integers(0, 1 << 63, n, dtype=np.uint64)
    for _ in range(6):
        base = draw.integers(0, 1 << 63, 50, dtype=np.uint64)
        for _ in range(12):
            own = np.concatenate([base, common])
            changed = draw.integers(0, 12)
            own[draw.integers(0, len(own), changed)] = draw.integers(0, 1 << 63, changed, dtype=np.uint64)
            sets.append(np.unique(own))
    want = Classes(len(sets))
    for i, j in linked(sets):
        want.join(i, j)
    for probe in (0, 8, 10**9):
        monkeypatch.setattr(jaccard, "PROBE", probe)
        got = Classes(len(sets))
        for i, j in jaccard.search(sets):
            assert got.join(i, j)  # a forest
        assert len(np.unique(np.stack([want.label, got.label]), axis=1).T) == len(np.unique(want.label)) == len(np.unique(got.label))


def test_summaries_are_signatures():
    found = jaccard.sets(*jaccard.texts.text_bytes(jaccard.pa.array(["a b c d e f", "a", "b a b a b a b a", "q r s t u"])))
    cls, counted = jaccard._summary(found)
    assert cls.tolist() == [jaccard.signature(s) for s in found]
    assert counted.tolist() == [int((s < np.uint64(jaccard.COUNTED)).sum()) for s in found]
    assert len(found[2]) == 2
