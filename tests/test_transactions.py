"""One-shot transactions: batch, stream, restart, replay, and changed ledgers."""

import datetime as dt
import random

import pytest
from conftest import SMALL

from tallyframe.plans.stream_queries import attempts
from tallyframe.streaming import ledger, transactions

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "contract string, attempt string, ts timestamp, kind string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


EVENTS = [
    ("a", "1", at(0), "open"), ("a", "1", at(1), "open"), ("a", "2", at(2), "open"), ("a", "1", at(3), "done"), ("a", "1", at(4), "failed"), ("a", "1", at(5), "done"),
    ("b", "1", at(0), "done"), ("b", "1", at(1), "open"), ("b", "2", at(2), "failed"),
    ("c", "1", at(0), "open"), ("c", "1", at(61), "done"), ("c", None, at(1), "open"), ("c", "1", at(2), "what"),
    ("d", "1", at(200), "open"),
]
EXPECTED = [
    ("audit", "a", "1", at(4), "already_closed"), ("audit", "a", "2", at(2), "retry_not_permitted"), ("audit", "b", "1", at(0), "no_attempt"), ("audit", "b", "2", at(2), "not_the_attempt"),
    ("audit", "c", "1", at(2), "malformed"), ("audit", "c", "1", at(61), "already_closed"), ("audit", "c", None, at(1), "malformed"),
    ("ledger", "a", "1", at(0), "opened"), ("ledger", "a", "1", at(3), "done"), ("ledger", "b", "1", at(1), "opened"), ("ledger", "b", "1", at(61), "timed_out"),
    ("ledger", "c", "1", at(0), "opened"), ("ledger", "c", "1", at(60), "timed_out"), ("ledger", "d", "1", at(200), "opened"),
]


def rows(df):
    return sorted((tuple(r[c] for c in ("part", "contract", "attempt", "ts", "code")) for r in df.collect()), key=str)


def test_each_code_is_met(spark):
    assert rows(transactions.settle(spark.createDataFrame(EVENTS, SCHEMA), "1 hour")) == sorted(EXPECTED, key=str)
    assert rows(transactions.settle(spark.createDataFrame([], SCHEMA), "1 hour")) == []


def test_stream_restarts_replays_and_agrees_with_the_batch(spark, tmp_path):
    """Files in time order; the stream stops and starts again between them, and the last file repeats what held. A refused event that comes again is refused again."""
    events = sorted((e for e in EVENTS if e[1] and e[3] != "what"), key=lambda e: e[2])
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    last = [("z", "1", at(500), "open")]  # moves the watermark beyond all limits
    for part in (events[:4], events[4:9], events[9:], last, [e for e in events[:4] if e[3] == "open"]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        transactions.transact_stream(stream, 3600, out, checkpoint, delay="1000 minutes").awaitTermination()
    both = [r for p in ("ledger", "audit") for r in [(p, *x) for x in ledger.ledger(spark, out, p).select("contract", "attempt", "ts", "code").collect()]]
    # no watermark has passed the limit of b and d yet
    expected = [e for e in EXPECTED if e[4] != "malformed" and (e[1], e[4]) != ("b", "timed_out")] + [("ledger", "z", "1", at(500), "opened")]
    assert sorted(both, key=str) == sorted(expected, key=str)


def test_timers_close_what_nobody_closes(spark, tmp_path):
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for part in ([("b", "1", at(0), "open")], [("y", "1", at(100), "open")], [("z", "1", at(300), "open")]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        transactions.transact_stream(spark.readStream.schema(SCHEMA).parquet(source), 3600, out, checkpoint).awaitTermination()
    found = {(r.contract, r.code, r.ts) for r in ledger.ledger(spark, out, "ledger").collect()}
    assert {("b", "opened", at(0)), ("b", "timed_out", at(60)), ("y", "timed_out", at(160)), ("z", "opened", at(300))} <= found
    assert ledger.ledger(spark, out, "audit").count() == 0


def test_plain_machine_over_the_events_table(spark):
    """settle against a loop over each contract's events."""
    data = [tuple(r) for r in attempts(spark, SMALL).collect()]
    hours6, latest, out, by = dt.timedelta(hours=6), max(r[2] for r in data), [], {}
    for c, a, ts, kind in data:
        if a is None or kind not in transactions.KINDS:
            out.append(("audit", c, a, ts, "malformed"))
        else:
            by.setdefault(c, []).append((ts, transactions.KINDS.index(kind), a, kind))
    latest = max(e[0] for v in by.values() for e in v)
    for c, events in by.items():
        holder = opened = closed = None
        for ts, _, a, kind in sorted(events):
            if kind == "open":
                if holder is None:
                    holder, opened = a, ts
                    out.append(("ledger", c, a, ts, "opened"))
                elif a != holder:
                    out.append(("audit", c, a, ts, "retry_not_permitted"))
            elif holder is None:
                out.append(("audit", c, a, ts, "no_attempt"))
            elif a != holder:
                out.append(("audit", c, a, ts, "not_the_attempt"))
            elif closed is None and ts <= opened + hours6:
                closed = kind
                out.append(("ledger", c, a, ts, kind))
            elif closed != kind:
                closed = closed or "timed_out"
                out.append(("audit", c, a, ts, "already_closed"))
        if holder and closed in (None, "timed_out") and opened + hours6 < latest:
            out.append(("ledger", c, holder, opened + hours6, "timed_out"))
    assert rows(transactions.settle(attempts(spark, SMALL), "6 hours")) == sorted(out, key=str)


def test_a_changed_batch_is_named_when_read(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path / "l")
    for batch in range(3):
        ledger.publish_parts({"x": spark.createDataFrame([(rng.random(),) for _ in range(5)], "v double"), "y": spark.createDataFrame([], "v double")}, batch, path)
    assert ledger.ledger(spark, path, "x").count() == 15 and ledger.ledger(spark, path, "y").count() == 0
    spark.createDataFrame([(0.5,)], "v double").write.mode("overwrite").parquet(f"{path}/rows/part=x/batch=1")
    with pytest.raises(ValueError, match=r"batches \[1\]"):
        ledger.ledger(spark, path, "x")
