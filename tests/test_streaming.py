import json
import os
import random
from datetime import datetime, timedelta

import pytest

from quarry.operators.alerts import replayed
from quarry.streaming import alerts


def run(query):
    query.processAllAvailable()
    query.stop()


def test_windowed_errors_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"id": str(i), "ts": f"2026-01-01T00:{i:02d}:00Z", "kind": "generation", "status": "error" if i % 2 else "ok"} for i in range(10)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    stream = alerts.windowed_errors(alerts.trace_stream(spark, str(tmp_path / "in")), "1 hour", "1 hour", "1 hour")
    run(stream.writeStream.format("memory").queryName("windowed").outputMode("complete").start())
    assert [r["errors"] for r in spark.table("windowed").collect()] == [5]


def life(rows, expiry=None):
    """The changes of a log (key, id, minute, kind) taken in order."""
    alerts, out = {}, []
    for key, name, at, kind in sorted(rows, key=lambda r: (r[2], r[1])):
        own = alerts.get(key)
        if own and expiry and own[1] in ("open", "acked") and own[2] + expiry <= at:
            out.append((key, own[0], "expired", own[2] + expiry))
            own = None
        live = own and own[1] in ("open", "acked")
        if kind == "fire" and not live:
            own = (name, "open", at)
            out.append((key, name, "open", at))
        elif kind == "ack" and live and own[1] == "open":
            own = (own[0], "acked", own[2])
            out.append((key, own[0], "acked", at))
        elif kind == "resolve" and live:
            out.append((key, own[0], "resolved", at))
            own = None
        alerts[key] = own
    return sorted(out)


def streamed(spark, folder, batches, name, **options):
    """The changes that a stream of these batches gives, the last of which moves the watermark behind all others."""
    folder.mkdir()
    batches = [*batches, [("end", "end", 100_000, "ack")], [("end", "end2", 200_000, "ack")]]
    for i, rows in enumerate(batches):
        lines = [json.dumps({"dedupe_key": k, "id": n, "ts": f"{datetime(2026, 1, 1) + timedelta(minutes=at):%Y-%m-%dT%H:%M:%SZ}", "kind": kind}) for k, n, at, kind in rows]
        (folder / f"{i:03d}.json").write_text("\n".join(lines))
        os.utime(folder / f"{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken by their age
    stream = spark.readStream.schema(alerts.EVENTS).option("maxFilesPerTrigger", 1).json(str(folder))
    run(alerts.alert_changes(stream, **options).writeStream.format("memory").queryName(name).outputMode("append").start())
    return sorted((r["dedupe_key"], r["alert_id"], r["status"], int((r["at"] - datetime(2026, 1, 1)).total_seconds() // 60)) for r in spark.table(name).collect())


@pytest.fixture
def states(spark):
    for key, value in alerts.STATE_STORE.items():
        spark.conf.set(key, value)
    yield spark
    for key in alerts.STATE_STORE:
        spark.conf.unset(key)


def test_life_does_not_depend_on_batches(states, tmp_path):
    """Any division into batches, and disorder within the delay, gives the changes of the log in order."""
    rng = random.Random(1)
    log = [(rng.choice("jkl"), f"e{i:03d}", rng.randrange(120), rng.choice(["fire", "fire", "ack", "resolve"])) for i in range(60)]
    expected = life(log)
    assert streamed(states, tmp_path / "one", [log], "one_batch", late="3 hours") == expected
    mixed = rng.sample(log, len(log))
    assert streamed(states, tmp_path / "many", [mixed[i : i + 13] for i in range(0, 60, 13)], "many_batches", late="3 hours") == expected
    opened = {(k, n) for k, n, status, _ in expected if status == "open"}
    batch = states.createDataFrame([(k, n, at, kind) for k, n, at, kind in log if kind != "ack"], "dedupe_key string, id string, ts int, kind string")
    assert opened == {(r["dedupe_key"], r["id"]) for r in replayed(batch, order=("ts", "id")).collect()}


def test_alerts_expire(states, tmp_path):
    log = [("k", "1", 0, "fire"), ("k", "2", 10, "ack"), ("k", "3", 50, "fire"), ("k", "4", 70, "fire"), ("j", "5", 5, "fire"), ("j", "6", 6, "resolve")]
    found = streamed(states, tmp_path / "in", [log[:3], log[3:]], "expiring", late="2 hours", expiry=3_600)
    assert found == sorted([*life(log, 60), ("k", "4", "expired", 130)])


def test_rules_in_micro_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"id": "1", "ts": "2026-01-01T00:00:00Z", "status": "error"}))
    stream = alerts.trace_stream(spark, str(tmp_path / "in"))
    run(alerts.evaluated(stream, lambda rows: rows.selectExpr("id", "status = 'error' as fires"), str(tmp_path / "out"), str(tmp_path / "state"), "1 second"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
