"""The stateful log: replayed in batches, out of order, with repeats, and after a restart, against the finished log."""

import datetime
import json
import random

import pytest

from leafloom.streaming import queue

SCHEMA = "run string, file string, event_id long, ts timestamp, event string, outcome string, reason string"


def day(seconds):
    return (datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def made_up(n=120):
    rng = random.Random(4)
    events = []
    for i in range(n):
        kind = rng.choice(["file_start", "backend_finish", "page", "file_finish"])
        outcome = rng.choice(["processed", "triaged", "refused", None]) if kind == "file_finish" else None
        events.append({"run": f"r{i % 2}", "file": f"f{rng.randrange(9)}", "event_id": i, "ts": day(10 * i + rng.randrange(4) * 0.25), "event": kind, "outcome": outcome, "reason": outcome and f"why {i}"})
    return events


def write(folder, name, events):
    (folder / name).write_text("".join(json.dumps(e) + "\n" for e in events))


def run(spark, folder, out):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    query = queue.followed(stream, "5 minutes").writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "state"))
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination(240)
    return spark.read.parquet(str(out / "rows"))


def shown(rows):
    return sorted((r["run"], r["file"], r["event_id"], r["event"], r["status"], r["reason"], None if r["elapsed"] is None else round(r["elapsed"], 6)) for r in rows.collect())


def test_replayed_in_batches_and_after_a_restart(spark, tmp_path):
    folder, out = tmp_path / "log", tmp_path / "out"
    folder.mkdir()
    events = made_up()
    rng = random.Random(1)
    first, second, third = events[:50], events[50:90], events[90:]
    # Events cross batches within the delay, some come twice, in the same batch and in another.
    moved = first[-8:]
    write(folder, "1.json", rng.sample(first[:-8], len(first) - 8) + first[10:14])
    write(folder, "2.json", rng.sample(second + moved, len(second) + 8) + moved[:3])
    run(spark, folder, out)
    write(folder, "3.json", rng.sample(third, len(third)) + second[-5:])
    # Too late by far: the watermark has passed it.
    write(folder, "4.json", [{**events[3], "event_id": 9999}, {"run": "end", "file": "end", "event_id": 10_000, "ts": day(99_999), "event": "run_finish"}])
    got = run(spark, folder, out).where("run <> 'end'")
    log = spark.createDataFrame([], SCHEMA).union(spark.read.schema(SCHEMA).json([str(folder / f"{k}.json") for k in (1, 2, 3)]))
    want = queue.followed_in_batch(log)
    assert shown(got) == shown(want) and got.count() == len(events)
    ended = lambda rows: sorted((r["run"], r["file"], r["status"], r["reason"]) for r in queue.current(rows).collect())
    assert ended(got) == ended(want)
    held = {(r["run"], r["file"]) for r in queue.live_queue(got).collect()}
    last = {}
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        if e["event"] in ("file_start", "file_finish"):
            last[e["run"], e["file"]] = e["outcome"] if e["event"] == "file_finish" else None
    assert held == {k for k, v in last.items() if v in ("triaged", "refused")} != set()


def test_batch_rows_equal_the_window_of_the_log(spark, sf_dir):
    from leafloom.operators import log
    from leafloom.plans.views import read, telemetry

    events = telemetry(read(spark, sf_dir, "events")).selectExpr("*", "'backend_finish' AS event", "cast(null as string) AS reason")
    want = {r["event_id"]: r["elapsed"] for r in log.elapsed(events).collect()}
    rows = queue.followed_in_batch(events).collect()
    assert {r["event_id"]: r["elapsed"] for r in rows} == pytest.approx(want) and len(rows) == len(want)
    assert {r["status"] for r in rows} == {"open"}
