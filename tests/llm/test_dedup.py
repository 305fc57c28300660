"""Deduplication operators against brute force, and their defined results."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from pulse.llm import exact, jaccard, substrings
from pulse.llm.components import components

SCHEMA = "doc_id long, text string, gone string, sha long, at int, own string"  # names the operators use inside


def words(text):
    return (text or "").encode().split()


def corpus(seed, n=120):
    """Texts with exact and near copies, shared passages, nulls, empties, one very long text and ties."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choices(vocabulary, k=45))
    rows = [(1000, None), (1001, ""), (1002, "  \n\t "), (1003, "one"), (1004, "ONE"), (1005, "one two"), (None, "one two"), (None, None)]
    base = [" ".join(rnd.choices(vocabulary, k=rnd.choice([3, 10, 40, 90, 200]))) for _ in range(n // 4)]
    for i in range(n):
        text = rnd.choice(base)
        kind = rnd.random()
        if kind < 0.3:
            parts = text.split(" ")
            for _ in range(rnd.randint(0, max(1, len(parts) // 40))):
                parts[rnd.randrange(len(parts))] = rnd.choice(vocabulary)
            text = " ".join(parts)
        elif kind < 0.5:
            text = text + "\n" + passage
        elif kind < 0.6:
            text = " ".join([text] * 3)
        rows.append((i, text))
    rows += [rows[20], rows[20]]  # repeated rows
    rows.append((2000, " ".join(rnd.choices(vocabulary, k=20_000)) + " " + passage))
    rnd.shuffle(rows)
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("smallest", [True, False])
def test_exact_groups(spark, smallest):
    rows = corpus(1)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = exact.exact_groups(frame(spark, rows), smallest).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        keep = (min if smallest else max)(known) if known else None
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)


def test_exact_deduplicate_keeps_one_row_of_each_text(spark):
    rows = corpus(2)
    got = exact.deduplicate(frame(spark, rows), smallest=False)
    assert got.columns == frame(spark, rows).columns
    texts = [r.text or "" for r in got.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in rows})


def test_trie_spills_subtrees_without_losing_rows(spark):
    rows = corpus(3)
    small = exact.owners(frame(spark, rows), smallest=True, budget=2000).collect()
    large = exact.owners(frame(spark, rows), smallest=True).collect()
    assert sorted(small) == sorted(large)


def test_trie_against_a_dict():
    rnd = random.Random(4)
    trie, held = exact.Patricia(True), defaultdict(list)
    for i in range(3000):
        body = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12)))
        trie.insert(body, i % 91, 1, 1)
        held[body].append(i % 91)
    got = {b: p[:3] for b, p in trie.drain()}
    assert got == {b: [min(v), len(v), v.count(min(v))] for b, v in held.items()}


def brute_classes(rows, k, share):
    sets = []
    for _, text in rows:
        own = [w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words(text)]
        sets.append({tuple(own[i:i + k]) for i in range(len(own) - k + 1)} if len(own) >= k else {tuple(own)} if own else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= share * (len(sets[a]) + len(sets[b]) - both):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    members = defaultdict(list)
    for a in range(len(rows)):
        members[root(a)].append(rows[a][0])
    out = []
    for a, (i, _) in enumerate(rows):
        known = [m for m in members[root(a)] if m is not None]
        out.append((i, len(sets[a]), (min(known) if known else None) if sets[a] else i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,share,block", [(4, 85, 1_000_000), (5, 80, 1_000_000), (4, 85, 300), (2, 50, 500)])
def test_jaccard_classes(spark, k, share, block):
    rows = corpus(5 + k)
    got = jaccard.classes(frame(spark, rows), k, share, block).collect()
    assert sorted(map(tuple, got), key=repr) == brute_classes(rows, k, share)


def test_search_finds_the_links_of_a_dense_group():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 62, 300, dtype=np.uint64)
    sets = []
    for _ in range(60):
        own = base.copy()
        own[rnd.integers(0, 300, rnd.integers(0, 40))] = rnd.integers(0, 1 << 62, 1, dtype=np.uint64)[0]
        sets.append(np.unique(own))
    linked = {(a, b) for a in range(60) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    found = jaccard.search(sets)
    assert all((max(p), min(p)) in linked for p in found)

    def parts(edges):
        label = list(range(60))
        for _ in range(60):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label
    assert parts(found) == parts(linked)


def test_linked_sets_share_a_part():
    rnd = np.random.default_rng(2)
    for n in list(range(1, 40)) + [100, 333, 1000, 5000]:
        for _ in range(5):
            a = np.unique(rnd.integers(0, 1 << 62, n, dtype=np.uint64))
            b = a.copy()
            while True:  # change members while the sets stay linked
                c = b.copy()
                c[rnd.integers(0, len(c))] = rnd.integers(0, 1 << 62, 1, dtype=np.uint64)[0]
                c = np.unique(c if rnd.random() < 0.5 else np.append(b, c[-1:] + np.uint64(1)))
                if 100 * len(np.intersect1d(a, c)) < 85 * len(np.union1d(a, c)):
                    break
                b = c
            assert len(np.intersect1d(jaccard.part_hashes(a), jaccard.part_hashes(b)))


def test_keep_one(spark):
    rows = [r for r in corpus(6) if r[0] is not None]
    got = jaccard.keep_one(frame(spark, rows), 5, 80)
    gone = {i for i, _, c in brute_classes(rows, 5, 80) if c != i}
    assert got.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, _ in rows if i not in gone)


def test_keep_one_with_null_and_reused_ids(spark):
    """Ids do not decide alone: one row of each class stays, and no unlinked row goes with a dropped one."""
    rnd = random.Random(8)
    base = [[f"v{rnd.randrange(5000)}" for _ in range(120)] for _ in range(6)]

    def near(k, n):
        return " ".join(base[k][:60] + [f"edit{n}"] + base[k][61:])
    rows = [(None, near(0, n)) for n in range(4)]  # near copies without ids
    rows += [(7, near(1, 0)), (7, near(1, 1)), (7, " ".join(base[2]))]  # two near copies and a stranger under one id
    rows += [(3, near(3, 0)), (9, near(3, 1)), (9, " ".join(base[4]))]  # the stranger shares the id of a dropped row
    rows += [(None, near(5, 0)), (50, near(5, 1)), (None, None), (None, ""), (50, None)]
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(frame(spark, rows), 5, 80).collect()]
    assert len(kept) == len(set(kept))
    by_base = [[(i, t) for i, t in kept if t and t.split(" ")[0] == b[0]] for b in base]
    assert [len(b) for b in by_base] == [1, 1, 1, 1, 1, 1]
    assert by_base[0][0][0] is None and by_base[3] == [(3, near(3, 0))] and by_base[5] == [(50, near(5, 1))]
    assert (9, " ".join(base[4])) in kept and (7, " ".join(base[2])) in kept
    assert sorted((i or -1, t or "") for i, t in kept if not t) == [(-1, ""), (-1, ""), (50, "")]


def test_components_of_one_large_star(spark):
    edges = [(1000 + i, 5) for i in range(3000)] + [(5, 3), (4000, 1)]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()
    assert {r.node: r.root for r in got} == {5: 3, 4000: 1} | {1000 + i: 3 for i in range(3000)}


def test_components(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    label = list(range(500))
    for _ in range(500):
        before = list(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {i: c for i, c in enumerate(label) if i != c}


def brute_cuts(rows, size):
    """(id, words, removed, digest) of distinct (id, text) rows."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for key in order:
        own = words(key[1])
        gone = [False] * len(own)
        for i in range(len(own) - size + 1):
            window = tuple(own[i:i + size])
            if window in seen:
                gone[i:i + size] = [True] * size
            seen.add(window)
        out[key] = (len(own), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(own, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("size", [20, 7])
def test_substring_cuts(spark, size):
    rows = [r for r in corpus(8) if r[0] is not None] + [(None, None), (None, "one two")]
    want = brute_cuts(rows, size)
    got = substrings.digest(frame(spark, rows), size).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got if r.doc_id is not None) == \
        sorted((k[0], *want[k]) for k in rows if k[0] is not None)
    assert len(got) == len(rows)
    for r in got:
        assert sum(b - a for a, b in r.cuts) == r.n_removed
        assert all(x[1] < y[0] for x, y in zip(r.cuts, r.cuts[1:]))


def test_copies_of_a_row_in_several_partitions_are_one_document(spark):
    rnd = random.Random(13)
    long = [" ".join(f"u{k}x{rnd.randrange(10_000)}" for _ in range(200)) for k in range(3)]
    own = [(7, long[0]), (None, long[1]), (9, long[2] + " " + long[2]), (10, "before " + long[0] + " after")]
    rows = own * 6
    want = brute_cuts(rows, 20)
    assert [want[k][1] for k in own] == [0, 0, 200, 200]
    apart = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], SCHEMA).repartition(6)
    got = substrings.digest(apart).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == sorted(((k[0], *want[k]) for k in rows), key=repr)
    kept = sorted((r.text for r in substrings.remove_repeats(apart).collect()))
    assert kept == sorted([long[0], long[1], long[2], "before after"] * 6)


def test_remove_repeats_changes_only_what_repeats(spark):
    rows = [r for r in corpus(9) if r[0] is not None]
    want = brute_cuts(rows, 20)
    got = substrings.remove_repeats(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    for r in got.collect():
        original = [t for i, t in rows if i == r.doc_id]
        removed = want[(r.doc_id, original[0])][1]
        assert r.text == original[0] if removed == 0 else hashlib.sha256(r.text.encode()).hexdigest() == want[(r.doc_id, original[0])][2]


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).filter("doc_id < 0")
    assert exact.exact_groups(none).count() == 0
    assert exact.deduplicate(none).count() == 0
    assert jaccard.classes(none).count() == 0
    assert substrings.digest(none).count() == 0
    assert substrings.remove_repeats(none).count() == 0
