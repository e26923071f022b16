"""Streams: late rows, restarts, repeated ids, promotion with state and timers."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.streaming import promotion, query_log

LONG = "word " * 60


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("query_id", "ts", "query", "answer", "confidence"), r, strict=True))) for r in rows))


def at(hour, minute=0, day=1):
    return f"2024-01-{day:02d}T{hour:02d}:{minute:02d}:00"


def test_promotion_keeps_state_over_restarts(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")

    def work(handle=None):
        log = query_log.read_log(spark, str(folder), promotion.ANSWERED, 1)
        query_log.run_batches(promotion.promotions(log, "6 hours", "10 minutes"), handle or promotion.append_once(out), checkpoint).awaitTermination()

    put(folder, "a.json", [("q2", at(1, 5), "What is RRC?", LONG, 0.9), ("q1", at(1), "what is rrc", LONG, 0.8), ("q3", at(1), "short", "few words", 0.9), ("q4", at(1), "unsure", LONG, 0.2), ("q5", at(1), None, LONG, 0.9)])
    work()
    assert [(r.key, r.query_id) for r in promotion.promoted(spark, out).collect()] == [("what is rrc", "q1")]
    # The same question again after a restart, and a new one; the sink fails after it has written.
    put(folder, "b.json", [("q6", at(3), "WHAT IS RRC", LONG, 0.9), ("q7", at(3), "new one", LONG, 0.9)])
    sink = promotion.append_once(out)

    def failing(rows, batch):
        sink(rows, batch)
        raise RuntimeError("the driver dies here")

    with pytest.raises(Exception):
        work(failing)
    work()
    keys = lambda: sorted((r.key, r.query_id) for r in promotion.promoted(spark, out).collect())
    assert keys() == [("new one", "q7"), ("what is rrc", "q1")]
    # A late row is dropped; time passes, the timer ends and the question may be promoted once more.
    put(folder, "c.json", [("q8", at(0, 30), "too late", LONG, 0.9), ("q9", at(12), "clock", LONG, 0.9)])
    work()
    put(folder, "d.json", [("q10", at(12, 30), "what is RRC", LONG, 0.9)])
    work()
    assert keys() == [("clock", "q9"), ("new one", "q7"), ("what is rrc", "q1"), ("what is rrc", "q10")]
    assert {r.query_id for r in promotion.since(promotion.promoted(spark, out), datetime(2024, 1, 1, 12)).collect()} == {"q9", "q10"}


def test_first_of_each_and_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda i, ts: json.dumps({"query_id": i, "ts": ts, "query": "q", "answered_by": "cache", "confidence": 1.0, "latency_ms": 1.0})
    (folder / "a.json").write_text("\n".join([line("x", at(1)), line("y", at(1)), line("x", at(1, 1))]))
    seen = []

    def work():
        query_log.run_batches(query_log.first_of_each(query_log.read_log(spark, str(folder))), lambda rows, batch: seen.append((batch, sorted(r.query_id for r in rows.collect()))), str(tmp_path / "cp")).awaitTermination()

    work()
    (folder / "b.json").write_text("\n".join([line("x", at(1, 2)), line("z", at(1, 2))]))
    work()
    assert [ids for _, ids in seen if ids] == [["x", "y"], ["z"]] and len({b for b, _ in seen}) == len(seen)


def test_late_rows_do_not_reach_closed_windows(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    line = lambda ts: json.dumps({"query_id": "x", "ts": ts, "query": "q", "answered_by": "cache", "confidence": 1.0, "latency_ms": 4.0})

    def work(name, times):
        (folder / name).write_text("\n".join(map(line, times)))
        query_log.to_table(query_log.tiers_by_window(query_log.read_log(spark, str(folder))), out, checkpoint).awaitTermination()

    work("a.json", [at(1), at(1, 30), at(3)])
    work("b.json", [at(1, 40), at(5)])  # the first is behind the watermark
    got = sorted((r.hour.hour, r.n) for r in spark.read.parquet(out).select(F.col("hour"), "n").collect())
    assert got == [(1, 2), (3, 1)]
