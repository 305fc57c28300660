"""Licence scans, the prefix trie and ranked search against brute force, and their defined results."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pulse.llm import licences, prefixes, ranked

SCHEMA = "doc_id long, text string, found int, id string, score string, row long, labels int"  # names the operators use inside


def docs(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, 3) for i, t in rows], SCHEMA).repartition(parts)


def fold(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


# ---- licences ------------------------------------------------------------------------------------

def climb(tokens, least=1):
    """Precedence climbing, to hold the parser against; takes tokens off the front."""
    token = tokens.pop(0)
    if token == "(":
        left = climb(tokens)
        tokens.pop(0)
    else:
        left = ({token}, licences.RESTRICTION.get(token, licences.UNKNOWN))
    while tokens and tokens[0] != ")" and licences.BINDS[tokens[0]] >= least:
        operator = tokens.pop(0)
        right = climb(tokens, licences.BINDS[operator] + 1)
        if operator == "with":
            left = (left[0] | {f"{x}-with-exception" for x in left[0]}, min(left[1], licences.EASED))
        else:
            left = (left[0] | right[0], (min if operator == "or" else max)(left[1], right[1]))
    return left


def test_parser_against_precedence_climbing():
    rnd = random.Random(5)

    def expression(depth):
        if depth == 0 or rnd.random() < 0.3:
            return [rnd.choice(["mit", "gpl", "apache", "cc-by-nc", "strange"])]
        inside = expression(depth - 1) + [rnd.choice(["and", "or", "with"])] + expression(depth - 1)
        return ["(", *inside, ")"] if rnd.random() < 0.5 else inside
    for _ in range(500):
        tokens = expression(4)
        labels, score = licences.evaluate(licences.postfix(tokens))
        assert (set(labels), score) == climb(list(tokens)), tokens


def naive_places(words, phrases):
    out = []
    for phrase, label in phrases.items():
        want = phrase.split(" ")
        out += [(i, len(want), label) for i in range(len(words)) if words[i:i + len(want)] == want]
    return out


def naive_row(text):
    words = fold(text)
    base = naive_places(words, licences.BASE)
    both = licences.BASE | licences.NOTICES
    both |= {p.replace("license", "licence"): label for p, label in both.items()}
    notices = naive_places(words, both)
    exceptions = naive_places(words, dict.fromkeys(licences.EXCEPTIONS, "exception"))
    labels, score = {label for _, _, label in notices}, 0.0
    runs, end = [], 0
    for first, length, label in sorted(notices + exceptions, key=lambda p: (p[0], -p[1])):
        if first < end:
            continue
        between = words[end:first]
        joins = [w for w in between if w in ("and", "or", "with")]
        near = bool(runs) and len(between) <= licences.GAP and len(joins) == 1 and all(
            w in ("and", "or", "with") or w in licences.FILLERS or w[0] in "0123456789" for w in between)
        if near and (joins[0] == "with") == (label == "exception"):
            runs[-1] += [joins[0], label]
        elif label == "exception":
            continue
        else:
            runs.append([label])
        end = first + length
    for tokens in runs:
        found, degree = climb(tokens)
        labels, score = labels | found, max(score, degree)
    at = [first for first, _, _ in base]
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, _, x in base})),
            ",".join(sorted(labels)), score)


def test_licences_against_brute_force(spark):
    rnd = random.Random(2)
    pieces = ["cc by", "CC-BY", "cc by-nc 4.0", "All rights reserved.", "GNU General Public License, version 3", "the MIT License", "or", "and",
              "with", "or the", "Apache License, Version 2.0", "classpath exception", "é", "by", "cc", "ccby", "rights", "x" * 50, "\n", "3", "licence",
              "BSD Licence", "public domain", "reserved\x00all", "İ", "license", "K"]
    rows = [(i, " ".join(rnd.choices(pieces, k=rnd.choice([0, 3, 12, 60])))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \n."), (None, "cc by"), (None, "cc by"), (5, rows[5][1]), (403, "cc by " * 200_000),
             (404, "general public"), (405, "license")]
    got = licences.scan(docs(spark, rows)).collect()
    want = sorted(((i, *naive_row(t)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got), key=repr) == want


def test_licence_tags_and_spans(spark):
    rows = [(1, "// SPDX-License-Identifier: MIT OR (GPL-2.0-or-later AND Apache-2.0)\ncode"),
            (2, "SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0 */"), (3, "License-Expression: (BSD-3-Clause"),
            (4, "the spdx license identifier is a tag"), (5, "SPDX-License-Identifier: MIT AND"), (6, "SPDX-License-Identifier:"),
            (7, "SPDX-License-Identifier: LicenseRef-Own words"), (8, "the MIT license or the GNU General Public License, and all rights reserved")]
    got = {r.doc_id: r for r in licences.scan(docs(spark, rows)).collect()}
    assert {i: (got[i].expressions, got[i].labels, got[i].score) for i in range(1, 8)} == {
        1: (["mit or ( gpl and apache )"], "apache,gpl,mit", 0.1), 2: (["gpl with classpath-exception"], "gpl,gpl-with-exception", 0.4),
        3: (["bsd"], "bsd", 0.1), 4: ([], "", 0.0), 5: (["mit"], "mit", 0.1), 6: ([], "", 0.0), 7: (["licenseref-own"], "licenseref-own", 0.5)}
    assert got[8].expressions == ["mit or gpl and reserved"] and got[8].score == 0.1
    assert [tuple(s) for s in got[8].found] == [("mit", 1, 2), ("gpl", 6, 3), ("reserved", 10, 3)]
    own = licences.scan(docs(spark, rows), base={"is a": "own"}, notices={}, tags=(), exceptions=()).filter("n_base > 0").collect()
    assert [(r.doc_id, r.first_word, r.labels) for r in own] == [(4, 4, "own")]


# ---- trie ----------------------------------------------------------------------------------------

def naive_trie(members):
    """members: conv_id -> tuple of turns (role, text)."""
    nodes = defaultdict(list)
    for c, turns in members.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, who in nodes.items():
        value = (len(who) - 1) * len((p[-1][1] if p else "").encode().split()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += value
            leaves[p[:d]] += p not in kids
    return sorted((min(who), len(p), min(nodes[p[:-1]]) if p else None, len(who), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in who if len(members[c]) == len(p)))).encode()).hexdigest())
                  for p, who in nodes.items())


def naive_rebuild(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, words int, path string, slot int"


def turns(spark, rows, parts=5):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], TURNS).repartition(parts)


def built(spark, rows):
    return prefixes.trie(*prefixes.share_heads(prefixes.number_turns(turns(spark, rows))))


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    said = [("user", "a b"), ("assistant", "c"), (None, None), ("", ""), ("user", "ab "), ("user", "d\x1ce f g"), ("userx", "")]
    rows = []
    for c in [*range(-25, 90), 2**40]:
        if c in (20, -20):
            continue  # absent bases
        n = rnd.choice([1, 1, 2, 3, 5, 8])
        numbers = [rnd.choice([None, 1, 1, 7]) if rnd.random() < 0.2 else k for k in range(n)]
        rows += [(c, k, *rnd.choice(said[:3] if rnd.random() < 0.7 else said)) for k in numbers]
    rows += [(200, k, "user", "long") for k in range(300)]  # one long conversation, alone below its first turns
    rows += [(c, k, "user", f"same {k}") for c in range(300, 420) for k in range(6)]  # many equal ones
    rows += [(None, 1, "user", "nobody's"), rows[0]]
    got = built(spark, rows)
    assert got.columns == COLUMNS and [t for _, t in got.dtypes[:-1]] == ["bigint"] * 7
    assert sorted(tuple(r) for r in got.collect()) == naive_trie(naive_rebuild(rows))


def test_trie_of_given_conversations(spark):
    rows = [(1, 0, "u", "x y"), (1, 1, "a", "z"), (2, 0, "u", "x y"), (2, 1, "a", "z"), (2, 2, "u", "w"), (3, 0, "u", "q")]
    numbered = prefixes.number_turns(turns(spark, rows))
    lengths = numbered.groupBy("conv_id").count().withColumnRenamed("count", "n")
    members = {1: (("u", "x y"), ("a", "z")), 2: (("u", "x y"), ("a", "z"), ("u", "w")), 3: (("u", "q"),)}
    assert sorted(tuple(r) for r in prefixes.trie(lengths, numbered).collect()) == naive_trie(members)


def test_empty_trie(spark):
    assert built(spark, []).collect() == []
    # a conversation of one turn that gives it up to an absent base has no turns: a root alone
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    ends = hashlib.sha256(str(c).encode()).hexdigest()
    assert [tuple(r) for r in built(spark, [(c, 0, "u", "t")]).collect()] == [(c, 0, None, 1, 0, 1, 0, ends)]


# ---- ranked search -------------------------------------------------------------------------------

def naive_search(rows, items, k):
    held = [(i, Counter(fold(t)), len(fold(t))) for i, t in rows]
    held = [h for h in held if h[2]]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(fold(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, tf, n in held:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in terms if t in tf)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def ranked_rows(seed):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "Äé", "x1"] + [f"w{i}" for i in range(150)]
    rows = [(i, " ".join("the" if rnd.random() < 0.3 else rnd.choice(vocabulary) + rnd.choice(["", ",", "\n", "-"]) for _ in range(rnd.choice([1, 5, 40, 200]))))
            for i in range(400)]
    rows += [(1000 + i, "same text w1 w2") for i in range(70)] + [(None, "same text w1 w2"), (None, None), (2000, ""), (2001, "."), rows[3], (2, "w1")]
    rows += [(3000, "w1 w5 " * 30_000)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 6, 30])))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "SAME w1 same"), (0, "w9 x1"), (None, "w1"), (104, "the the")]
    return rows, items


@pytest.mark.parametrize("block, turn, owners", [(ranked.BLOCK, ranked.TURN, ranked.OWNERS), (60, 5, (20, 3)), (30, 1000, ())])
def test_search_against_brute_force(spark, block, turn, owners):
    rows, items = ranked_rows(9)
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, id int").repartition(3)
    got = ranked.search(docs(spark, rows), asked, block=block, turn=turn, owners=owners)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == naive_search(rows, items, 50)


def test_search_of_nothing(spark):
    rows, items = ranked_rows(1)
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(items, "item_id long, text string")
    assert ranked.search(docs(spark, rows), none).collect() == []
    assert ranked.search(docs(spark, []), some).collect() == []
    assert ranked.search(docs(spark, [(1, None), (2, "..")]), some).collect() == []


def test_scans_of_nothing(spark):
    assert licences.scan(docs(spark, [])).collect() == []


def test_registered_queries(spark):
    """The three queries on the given tables, licences held against brute force."""
    from pulse.llm import queries
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.QUERIES["op11_licence_scan"](spark, folder).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *naive_row(t)) for i, t in rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op13_ranked_search"](spark, folder).collect()), key=repr) == naive_search(rows, items, 50)
    said = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    assert sorted(tuple(r) for r in queries.QUERIES["op12_prefix_trie"](spark, folder).collect()) == naive_trie(naive_rebuild(said))
