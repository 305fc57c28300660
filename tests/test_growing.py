"""Logs that grow, are cut, rewritten and rotated between batches, against what was written."""

import os
import random

import pytest
from test_streaming import event

from pulse.sources import growing, ingest
from pulse.streaming import ingest as stream


@pytest.fixture
def take(spark, tmp_path):
    """Run the stream over what is there; returns the lines of that batch and keeps the checkpoint."""
    def run(folder, **options):
        got = []
        lines = stream.read_log_stream(spark, str(folder), **options)
        (lines.writeStream.foreachBatch(lambda df, n: got.extend(r.line for r in df.orderBy("path", "position").collect()))
         .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination())
        return got
    return run


def test_append_cut_and_rotate(take, tmp_path):
    logs = tmp_path / "logs"
    assert take(logs) == []  # no log yet
    logs.mkdir()
    a, b = logs / "a.log", logs / "b.log"
    a.write_text("start 1\nx\nhalf")
    (logs / "_hidden").write_text("no\n")
    assert take(logs) == ["start 1", "x"]  # the unfinished line waits
    with a.open("a") as f:
        f.write(" done\r\ny\n")
    b.write_text("no line end yet")
    assert take(logs) == ["half done", "y"]
    assert take(logs) == []
    b.write_text("no line end yet\né\n")
    assert take(logs) == ["no line end yet", "é"]
    a.write_text("start 1\n")  # cut to less than was read
    assert take(logs) == ["start 1"]
    a.write_text("start 2\nlonger than all that was read before\nz\n")  # another file of that name
    assert take(logs) == ["start 2", "longer than all that was read before", "z"]
    a.write_text("start 2\nlonger than all that was READ before\nz\nmore\n")  # same head, written anew
    assert take(logs) == ["start 2", "longer than all that was READ before", "z", "more"]
    b.unlink()
    with a.open("a") as f:
        f.write("last\n")
    assert take(logs) == ["last"]


def test_rotation_by_name(take, tmp_path):
    """A log moved aside is taken for a new file; its successor starts anew."""
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "game.log").write_text("first\n1\n")
    assert take(logs) == ["first", "1"]
    os.rename(logs / "game.log", logs / "game.1.log")
    (logs / "game.log").write_text("second\n")
    assert take(logs) == ["first", "1", "second"]


def test_replaced_while_planned(tmp_path):
    """A range of a file that was replaced gives nothing; the new file is the next batch's."""
    path = tmp_path / "a.log"
    path.write_text("one\ntwo\n")
    reader = growing._Stream({"path": str(tmp_path)})
    first = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), first)
    path.write_text("other\nthree\nfour\n")
    assert [b for p in parts for b in growing.read_range(p)] == []
    after = reader.partitions(first, reader.latestOffset())
    assert [line for p in after for b in growing.read_range(p) for line in b["line"].to_pylist()] == ["other", "three", "four"]
    path.unlink()
    assert [b for p in after for b in growing.read_range(p)] == []


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_hold_every_line_once(tmp_path, size, monkeypatch):
    monkeypatch.setattr(growing, "CHUNK", 50)
    rnd = random.Random(size)
    lines = ["".join(rnd.choices("abé ", k=rnd.choice([0, 1, 5, 300]))) for _ in range(200)]
    path = tmp_path / "a.log"
    path.write_text("\n".join(["head", *lines]) + "\nunfinished")
    reader = growing._Batch({"path": str(path), "range_bytes": str(size)})
    parts = reader.partitions()
    got = [line for p in parts for b in reader.read(p) for line in b["line"].to_pylist()]
    assert got == ["head", *lines] and len(parts) >= 20_000 / max(size, 4_000)


def test_ingest_of_a_growing_log_stores_each_event_once(spark, tmp_path):
    logs, base = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    log = logs / "game.log"

    def run():
        stream.start_ingest(stream.read_log_stream(spark, str(logs)), base, "dev", every=None).awaitTermination()
        return {(r.session_id[-1], r.seq) for r in stream.read_events(spark, base).collect()}
    log.write_text("start\n" + event(0) + event(1)[:-10])
    assert run() == {("1", 0)}
    log.write_text("start\n" + event(0) + event(1) + event(2))
    assert run() == {("1", 0), ("1", 1), ("1", 2)}
    log.write_text("start again\n" + event(2) + event(0, session=2))  # relaunched, repeats one
    assert run() == {("1", 0), ("1", 1), ("1", 2), ("2", 0)}
    with log.open("a") as f:
        f.write(event(1, session=2))
    run()
    assert spark.read.parquet(f"{base}/events").count() == 5


def test_batch_read(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.log").write_bytes(b"x\n\xff\n" + event(0).encode())
    lines = ingest.read_growing_log(spark, str(tmp_path), range_bytes=3)
    assert [r.line for r in lines.orderBy("position").collect()][:2] == ["x", "�"]
    assert ingest.tagged(lines).count() == 1
    assert ingest.read_growing_log(spark, str(tmp_path / "none")).collect() == []


def test_small_ranges_grow_with_the_batch(tmp_path):
    """A task a hundred bytes would make tasks, not bytes, the cost of a large batch."""
    for name in "ab":
        (tmp_path / name).write_text("".join(f"{name} line {n}\r\n" for n in range(20_000)))
    stream_ = growing._Stream({"path": str(tmp_path), "range_bytes": "100"})
    batch = growing._Batch({"path": str(tmp_path), "range_bytes": "100"})
    for reader, parts in ((batch, batch.partitions()), (stream_, stream_.partitions(stream_.initialOffset(), stream_.latestOffset()))):
        assert 100 < len(parts) <= growing.RANGES + 2
        got = [(line, at) for p in parts for b in reader.read(p) for line, at in zip(b["line"].to_pylist(), b["position"].to_pylist())]
        assert [line for line, _ in got] == [f"{name} line {n}" for name in "ab" for n in range(20_000)]
        whole = (tmp_path / "a").read_bytes()
        assert all(whole[at:].startswith(line.encode()) for line, at in got[:20_000:997])
