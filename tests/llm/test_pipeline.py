"""The pipeline against its stages done by brute force, on one small table."""

import hashlib
import random

import pytest
from test_dedup import brute_classes, brute_cuts

import __spark_entry__ as entry
import corpus_pipeline
from pulse.llm import packing, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    common = "the of and to in is that it for was on with as by be".split()
    vocabulary = common + [f"word{i}" for i in range(300)]
    passage = " ".join(rnd.choices(vocabulary, k=60))
    rows = []
    for i in range(60):
        text = " ".join(rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(vocabulary) for _ in range(rnd.choice([70, 150, 400])))
        rows.append((i, text + (" " + passage if i % 4 == 0 else "")))
        if i % 5 == 0:
            rows.append((100 + i, text + (" " + passage if i % 4 == 0 else "")))
        if i % 6 == 0:
            rows.append((200 + i, text + " almost the same"))
        if i % 10 == 0:
            rows.append((300 + i, " ".join(w.upper() + "!!$$%%" for w in text.split())))
    rows += [(400, None), (401, ""), (402, "short"), (403, rows[0][1])]
    path = tmp_path_factory.mktemp("tables")
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(4).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    assert 50 < len(rows) < docs.count() - 5
    best = {}
    for i, t in rows:
        best[t] = max(i, best.get(t, i))
    rows = [(i, t) for i, t in rows if best[t] == i]
    gone = {i for i, _, c in brute_classes(rows, 5, 80) if c != i}
    rows = [(i, t) for i, t in rows if i not in gone]
    cuts = brute_cuts(rows, 20)
    assert gone and any(n for _, n, _ in cuts.values())

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns, name
    found = {r.doc_id: r for r in now.collect()}
    assert set(found) == {i for i, _ in rows}
    for key, (_, removed, digest) in cuts.items():
        text = found[key[0]].text
        assert text == key[1] if not removed else hashlib.sha256(text.encode()).hexdigest() == digest
        assert found[key[0]].n_chars == len(text)

    packed = corpus_pipeline.run(spark, folder).collect()
    pieces = packing.pieces(now).collect()
    assert sorted(tuple(r)[:5] for r in packed) == sorted(map(tuple, pieces))
    assert len({r.sequence_id for r in packed}) <= 1.2 * sum(r.length for r in packed) / 1024 + 2


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "jaccard_join", "substring_dedup", "best_fit_packing"]
