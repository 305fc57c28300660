"""Quality, toxicity, chat, tokens, urls and packing: brute force, round trips, held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulse.llm import bpe, chat, hosts, labelled, packing, passages, quality, queries, texts, toxicity

ODD = ["", " ", "\n", "a  b\n c", "x <|endoftext|> y\n\nz", "é è ü  q", "a\x1cb c", "e ́b ó x", " lead", "trail \n",
       "日本 語 a 中 文 字", "it's we'll  don't", "a\u0085 b", "\x01 a \x01b", "ΑΣ Σας x İ i̇", "가 각 ᆨ 나", "<|startoftext|>a", "𝔘 😀 b",
       "the the the the of of of of", "　a　b", "A" * 5000]


def docs(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, "en", "s", 0.5) for i, t in rows], "doc_id long, text string, lang string, score string, held_out double").repartition(parts)


def sample_rows(n=60):
    rnd = random.Random(3)
    vocabulary = "the of and to in is that it for was strength mountain river stone walking hidden ébène straße".split()
    rows = [(i, " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", ",", ".", "\n"]) for _ in range(rnd.choice([2, 60, 300])))) for i in range(n)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(200, None), (None, "null id of the row"), (0, rows[0][1])]
    rows.append((201, " ".join(rnd.choice(vocabulary) for _ in range(60_000))))
    return rows


def base_counts(text):
    text = text or ""
    own = text.encode().split()
    triples = Counter(zip(own, own[1:], own[2:]))
    covered = set()
    for i in range(len(own) - 2):
        if triples[tuple(own[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return (len(own), sum(len(w.decode()) for w in own), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_quality_base_counts(spark):
    rows = sample_rows() + [(300, "a b\na b\n\na b\r\n \nx#|"), (301, "w " * 200), (302, "q r s " + " ".join(map(str, range(100))) + " q r s")]
    got = quality.judge(docs(spark, rows)).collect()
    want = sorted(((i, *base_counts(t)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_distance_against_the_definition():
    rnd = np.random.default_rng(1)
    counts, refs = rnd.integers(0, 20, (30, 9)), rnd.integers(1, 50, (3, 9)).astype(float)
    got = quality.distance(counts, refs)
    for row, value in zip(counts, got):
        p, best = row / row.sum(), 9.0
        for q in refs / refs.sum(axis=1, keepdims=True):
            m = (p + q) / 2
            best = min(best, sum(sum(a * np.log2(a / b) for a, b in zip(x, m) if a) for x in (p, q)) / 2)
        assert abs(value - best ** 0.5) < 1e-9


def test_quality_keeps_prose_and_drops_junk(spark):
    path = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    got = quality.judge(spark.read.parquet(f"{path}/documents.parquet")).filter("not base_failed").collect()
    clean = [r.kept for r in got if labels.get(r.doc_id) == 1]
    junk = [r.kept for r in got if labels.get(r.doc_id) == 0]
    assert len(clean) > 200 and np.mean(clean) > 0.99
    assert np.mean(junk) < 0.4


def test_keep_good_agrees_with_the_verdicts(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("n_chars", "n_words")
    kept = {r.doc_id for r in quality.judge(frame).filter("kept").collect()}
    got = quality.keep_good(frame)
    assert got.columns == frame.columns and {r.doc_id for r in got.collect()} == kept


def rare_languages(spark, n_english):
    """Much English, a little Russian, Greek and junk, a Russian text with a wrong and one without a tag, and one text of a language with no other."""
    rnd = random.Random(12)
    english = "the of and to in is that it for was".split() * 20 + [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    russian, greek, thai = ([chr(at + k) * 2 + chr(at + 30 - k) + chr(at + k // 2) for k in range(24)] for at in (0x430, 0x3B1, 0xE01))
    def text(own, n=120):
        return " ".join(rnd.choice(own) for _ in range(n))
    several = [text(english, 1000) for _ in range(20)]
    rows = [(i, several[i % 20], "en") for i in range(n_english)]
    rows += [(100_000 + i, text(russian), "ru") for i in range(25)] + [(200_000 + i, text(greek), "el") for i in range(25)]
    rows += [(300_000, text(thai), "th"), (300_001, text(russian), "en"), (300_002, text(russian), None)]
    rows += [(400_000, " ".join(w.upper() + "!!$$%%" for w in text(english).split()), "en"),
             (400_001, " ".join(w.upper() + "!!$$%%" for w in text(english).split()), "ru")]
    return spark.createDataFrame([(i, t, g, "s") for i, t, g in rows], "doc_id long, text string, lang string, known string").repartition(4)


@pytest.mark.parametrize("n_english,most", [(100, 1000), (3500, 1000), (3500, 1), (100, 0)])
def test_rare_languages_stay_whatever_the_others_hold(spark, n_english, most):
    frame = rare_languages(spark, n_english)
    found = {r.doc_id: r.kept for r in quality.verdicts(quality.statistics(frame), most=most).collect()}
    assert len(found) == n_english + 55
    junk = {400_000, 400_001} | ({300_001} if most < 2 else set())  # a wrong tag is mended by shared references only
    assert {i for i, kept in found.items() if not kept} == junk
    kept = quality.keep_good(frame, most=most)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(found.keys() - junk)


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_held_out_accuracy(spark, kind):
    path = "/root/testdata/sf0.1"
    frame, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    found = (toxicity if kind == "toxic" else passages).classify(frame, labels)
    rows = found.join(labels, "doc_id").filter("held_out").select("score", "predicted", kind).collect()
    y, s = np.array([r[kind] for r in rows]), np.array([r.score for r in rows])
    assert len(y) > 300 and 0 <= s.min() and s.max() <= 1
    above = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
    assert above > 0.93
    assert np.mean([r.predicted == r[kind] for r in rows]) > 0.95


def test_offending_sentences(spark):
    rows = [(i, f"the day was long. {'you utter gronk. ' if i % 3 == 0 else ''}we went home early. number w{i} said nothing.") for i in range(300)]
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs(spark, rows + [(1000, "fine. utter gronk here.\nall well."), (1001, None)]), labels).collect()
    found = {r.doc_id: r for r in got}
    assert [(o["first"], o["words"]) for o in found[1000].offending] == [(1, 3)]
    assert found[1000].predicted == 1 and found[1001].predicted == 0 and found[1001].offending == []
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in got if r.doc_id < 300)


def test_scores_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (toxicity, passages):
        got = module.classify(docs(spark, sample_rows(5)), none).collect()
        assert len(got) == len(sample_rows(5)) and all(0 <= r.score <= 1 for r in got)


def test_held_out_is_the_contract(spark):
    got = spark.range(50).select("id", labelled.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_bpe_agrees_with_the_library(spark):
    rows = sample_rows()
    library = bpe.load(bpe.default_vocabulary())
    got = bpe.digest(docs(spark, rows)).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_bpe_round_trip_of_frames(spark):
    rows = [(1, "the river ran"), (2, None), (3, "")]
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs(spark, rows))).collect()}
    assert back[1] == "the</w> river</w> ran</w>" and back[2] == back[3] == ""


def test_repair_drops_cuts_that_change_ids():
    data, offsets = texts.text_bytes(pa.array(["ab cd"]))
    joined = lambda b: [1] if b == b"ab cd" else [2]
    assert bpe.repaired(data, offsets, np.zeros(0, np.int64), np.array([2]), joined).tolist() == []
    apart = lambda b: list(b)
    assert bpe.repaired(data, offsets, np.zeros(0, np.int64), np.array([2]), apart).tolist() == [2]


def test_packing(spark):
    from tokenizers import Tokenizer
    rows = sample_rows()
    library = Tokenizer.from_file(packing.default_vocabulary()[0])
    got = packing.pack_documents(docs(spark, rows)).collect()
    want = []
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)] if len(ids) >= 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want.append((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in got) // 1024) * 1.05 + 2


def test_sum_of_squares_placement():
    rnd = np.random.default_rng(5)
    sizes, capacity = rnd.integers(1, 41, 400), 40
    sequence, offset = packing.pack_lengths(sizes, capacity)
    gap = {}
    for i, size in enumerate(sizes.tolist()):
        def cost(s):
            after = Counter(g for k, g in gap.items() if g and k != s)
            if gap[s] > size:
                after[gap[s] - size] += 1
            return sum(v * v for v in after.values())
        fits = [s for s, g in gap.items() if g >= size]
        own = int(sequence[i])
        if not fits:
            assert own not in gap and offset[i] == 0
            gap[own] = capacity
        else:
            assert own in fits and cost(own) == min(map(cost, fits))
        assert offset[i] == capacity - gap[own]
        gap[own] -= size


def test_chat_round_trip(spark):
    said = ODD + ["</s>[INST] ok [/INST]", "\\", "<\\|end|>", "<|turn|>user<|text|>x<|end|>\n", "a\\b<|", "<<SYS>>[\\INST]"]
    for role in ["user", "assistant", "a<|b", ""]:
        for text in said:
            out, low, high = chat.segment(role, text)
            assert chat.parse(out) == [(role, text)]
            assert chat.unescape(out[low:high]) == (text if role == "assistant" else "")
    assert chat.parse("".join(chat.segment("user", t)[0] for t in said)) == [("user", t) for t in said]


def test_chat_layouts(spark):
    import json
    records = [{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 4},
               {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
               {"instruction": "a", "output": "b"}, {"instruction": "a", "input": "i", "output": "b", "system": "s"},
               {"prompt": "a", "response": "b"}, {"question": "a", "answer": "b"}, {"text": "hi", "role": "assistant"}, {"strange": 1}]
    rows = [(i, 0, json.dumps(r)) for i, r in enumerate(records)] + [(50, 0, None), (51, 0, "no json"), (52, 0, "[1]"), (None, 0, json.dumps(records[2]))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, record string")
    got = chat.format_records(frame).orderBy("conv_id", "seq").collect()
    turns = {}
    for r in got:
        if r.segment is not None:
            turns.setdefault(r.conv_id, []).extend(chat.parse(r.segment))
    pair = [("user", "a"), ("assistant", "b")]
    assert turns == {None: pair, 0: pair, 1: pair, 2: pair, 3: [("system", "s"), ("user", "a"), ("user", "i"), ("assistant", "b")],
                     4: pair, 5: pair, 6: [("assistant", "hi")]}
    assert {r.conv_id for r in got if r.layout is None} == {7, 50, 51, 52}
    digest = {r.conv_id: r for r in chat.digests(chat.format_records(frame)).collect()}
    assert digest[0].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest() and digest[0].loss_chars == 1
    assert digest[7].n_turns == 0 and digest[7].formatted_chars == 0


def test_url_rules(spark):
    urls = {"http://WWW.Example.com/en/x?q": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
            "https://a.example.com/en/1#t": ("a.example.com", "/en/1", "example.com/en/", "block"),
            "https://notexample.com/en/1": ("notexample.com", "/en/1", "com/", "allow"),
            "http://b.net/es/": ("b.net", "/es/", "net/es/", "block"), "http://b.net": ("b.net", "", None, "allow"),
            "http://example.com?x": ("example.com", "", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"),
            "http://É.com/": ("É.com", "/", "com/", "allow"), "": ("", "", None, "allow")}
    frame = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.judge(frame, queries.URL_RULES).collect()}
    assert got == dict(enumerate(urls.values()))


def test_reputation_shrinks(spark):
    rows = [(i, f"http://bad{i % 3}.farm.org/x", 0) for i in range(90)] + [(100 + i, f"http://s{i}.fine.org/", 1) for i in range(60)] + \
        [(200, "http://new.farm.org/", 1), (201, "http://one.fine.org/", 0)]
    got = {r.page_id: r.verdict for r in hosts.judge(spark.createDataFrame(rows, "page_id long, url string, good int"), []).collect()}
    assert all(got[i] == "block" for i in range(90))
    assert all(got[i] == "allow" for i in range(100, 160)) and got[201] == "allow"


def test_prior_strengths_are_fitted(spark):
    """Hosts that differ widely get a weak prior, hosts that differ by chance a strong one, as the moments say."""
    rnd = random.Random(6)
    for spread, low, high in ((4.0, 2.5, 6.0), (60.0, 25.0, 200.0)):
        members = []
        for i in range(600):
            rate = rnd.betavariate(0.7 * spread, 0.3 * spread)
            n = rnd.randrange(1, 40)
            members.append((f"h{i}", n, float(sum(rnd.random() < rate for _ in range(n))), 0.7))
        frame = spark.createDataFrame(members, "host string, n long, k double, prior double").repartition(4)
        got = hosts.strength(frame, "n", "k", "prior", "s").first().s
        several = [x for x in members if x[1] > 1]
        seen = sum(n * (k / n - m) ** 2 for _, n, k, m in several)
        chance, room = sum(m * (1 - m) for *_, m in several), sum(m * (1 - m) * (n - 1) for _, n, _, m in several)
        assert got == pytest.approx(room / (seen - chance) - 1) and low < got < high
    single = spark.createDataFrame([("a", 1, 1.0, 0.5), ("b", 1, 0.0, 0.5)], "host string, n long, k double, prior double")
    assert hosts.strength(single, "n", "k", "prior", "s").first().s == hosts.STRENGTH
    alike = spark.createDataFrame([(f"h{i}", 10, 5.0, 0.5) for i in range(9)], "host string, n long, k double, prior double")
    assert hosts.strength(alike, "n", "k", "prior", "s").first().s == hosts.MOST


def test_domains(spark):
    want = {"a.b.co.uk": ("co.uk", "b.co.uk"), "b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.me.github.io": ("github.io", "me.github.io"),
            "www.example.com": ("com", "example.com"), "example.com": ("com", "example.com"), "localhost": ("localhost", "localhost"),
            "notco.uk": ("uk", "notco.uk"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "[::1]": ("[::1]", "[::1]"), "1.2.3.4.com": ("com", "4.com")}
    frame = spark.createDataFrame([(h,) for h in want], "h string").withColumn("z", hosts.suffix(F.col("h")))
    assert {r.h: (r.z, r.d) for r in frame.withColumn("d", hosts.registered(F.col("h"), F.col("z"))).collect()} == want
    names = ["a.com:80", "u:p@a.com", "a.com", "a.com.", "u@a.com:", "[::1]:8"]
    got = spark.createDataFrame([(h,) for h in names], "h string").select(hosts.bare(F.col("h")).alias("b")).collect()
    assert [r.b for r in got] == ["a.com"] * 5 + ["[::1]"]


def test_unrelated_hosts_share_no_prior(spark):
    rows = []
    for end in ("co.uk", "com.au", "github.io"):
        rows += [(f"http://bad{i}.{end}/x", 0) for i in range(300)] + [(f"http://good.{end}/", 1)] * 3
    rows += [(f"http://10.0.3.4:{80 + i}/", 0) for i in range(60)] + [("http://10.1.3.4/", 1)] * 2 + [("http://u@10.0.3.4/", 0)]
    got = hosts.judge(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, good int"), []).collect()
    assert {rows[r.page_id][0] for r in got if rows[r.page_id][1] and r.verdict != "allow"} == set()
    assert {r.verdict for r in got if "10.0.3.4" in rows[r.page_id][0]} == {"block"}


def test_empty_tables(spark):
    none = docs(spark, [(1, "a")]).filter("doc_id < 0")
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    for found in (quality.judge(none), quality.keep_good(none), toxicity.classify(none, labels), passages.classify(none, labels),
                  bpe.digest(none), packing.pack_documents(none),
                  hosts.judge(spark.createDataFrame([], "page_id long, url string, good int"), queries.URL_RULES),
                  chat.digests(chat.format_records(spark.createDataFrame([], "conv_id long, turn long, record string")))):
        assert found.count() == 0
