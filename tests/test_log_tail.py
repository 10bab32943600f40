import json
import os
import random

import pytest

from quarry.sources import log_tail
from quarry.streaming import rollups


def lines_of(folder):
    """All lines that aren't blank, newest first."""
    out = []
    for name in sorted(os.listdir(folder)):
        with open(f"{folder}/{name}", "rb") as source:
            out += [x.decode("utf-8", "replace") for x in source.read().split(b"\n") if x.strip()]
    return out[::-1]


@pytest.mark.parametrize("size", [7, 64, 65_536])
def test_last_lines_of_any_ranges(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(log_tail, "RANGE_BYTES", size)
    rng = random.Random(size)
    for k in range(3):
        parts = ["".join(rng.choice(["a", "é", "中", " "]) for _ in range(rng.choice([0, 1, 5, 90]))) for _ in range(30)]
        (tmp_path / f"log-{k}.txt").write_text("\n".join(parts) + ("\n" if k else ""), "utf-8")
    every = lines_of(tmp_path)
    for n in (1, 5, 40, 1_000):
        assert [r["line"] for r in log_tail.tail(spark, str(tmp_path), n).collect()] == every[:n]


def test_only_the_end_is_read(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"log-{k}").write_text("".join(json.dumps({"id": k * 100_000 + i}) + "\n" for i in range(100_000)))
    total = sum(f.stat().st_size for f in tmp_path.iterdir())
    found = log_tail.tail(spark, str(tmp_path), 3_000)
    assert [json.loads(r["line"])["id"] for r in found.collect()] == list(range(399_999, 396_999, -1))
    assert log_tail.tail_bytes(spark, str(tmp_path), 3_000) < 2 * log_tail.RANGE_BYTES < total / 30


def test_empty_log(spark, tmp_path):
    assert log_tail.tail(spark, str(tmp_path), 5).collect() == []


def test_rotated_log_keeps_five_files(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = lambda n: spark.createDataFrame([(f"r{n}", "mail me at a.b@c.org", "ok")], "id string, input string, output string")
    for n in [0, 1, 2, 3, 4, 5, 6, 6]:  # the last batch is tried again
        log_tail.appended(rows(n), folder, n)
    got = [json.loads(r["line"]) for r in log_tail.tail(spark, folder, 100).collect()]
    assert [r["id"] for r in got] == ["r6", "r5", "r4", "r3", "r2"]
    assert all(r["input"] == "mail me at [EMAIL]" for r in got)


def test_rollups_count_a_batch_once(spark, tmp_path):
    """Partial counts of a stream's batches, one of them written again, are the counts of all records."""
    (tmp_path / "in").mkdir()
    rng = random.Random(1)
    records = [{"id": str(i), "ts": f"2026-01-0{1 + i % 3}T0{i % 5}:00:00Z", "name": "x", "kind": "generation" if i % 7 else "tool", "status": "ok" if i % 4 else "error", "duration_ms": float(rng.randrange(30)), "model": "qwen-plus", "input_tokens": i, "output_tokens": 1} for i in range(200)]
    for k in range(4):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, records[k * 50 : k * 50 + 50])))
    from quarry.operators import usage
    from quarry.streaming.alerts import SCHEMA, trace_stream

    folder = str(tmp_path / "out")
    query = rollups.kept_up(trace_stream(spark, str(tmp_path / "in"), 1), folder, str(tmp_path / "state"), "1 second")
    query.processAllAvailable()
    query.stop()
    whole = spark.read.schema(SCHEMA).json(str(tmp_path / "in"))
    merged = rollups.merged(spark, folder)
    plain = lambda frame: sorted(map(tuple, frame.collect()))
    assert plain(rollups.usage(merged, ["day"])) == plain(usage.usage_by(whole, ["day"]))
    assert plain(rollups.sla(merged, ["day"])) == plain(usage.sla(whole.withColumn("day", usage.F.date_format("ts", "yyyy-MM-dd")), ["day"]))
    first = spark.read.parquet(folder).filter("batch_id = 0").agg({"calls": "sum"}).first()[0]
    rollups.written(whole.limit(0), 0, str(tmp_path / "empty"))
    assert first > 0 and rollups.merged(spark, str(tmp_path / "none")).collect() == []
