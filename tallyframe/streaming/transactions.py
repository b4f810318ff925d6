"""One-shot transactions: a contract runs once, and no retry is allowed within it.

Events are (contract, attempt, ts, kind) with kind `open`, `done` or `failed`. The first attempt that
opens a contract holds it; the attempt's id is its idempotency key, so an event that comes again
changes nothing. What the holder says first, `done` or `failed`, closes the contract; if
it says nothing within the limit, the contract is closed as `timed_out`. Whatever else comes is
refused and kept in the audit: `retry_not_permitted` (another attempt opens), `no_attempt`
(closed before it was opened), `not_the_attempt` (another attempt closes), `already_closed`.

`settle` does this over a batch of events, in the order of (ts, kind with open first,
attempt); `transact` over a stream, with state and a timer for each contract, in the order in
which batches bring them and in that order within a batch. Over events that come in order both
give the same rows (part, contract, attempt, ts, code).

An event without contract, attempt, ts or a known kind is refused as `malformed`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyframe.streaming.ledger import publish_parts

KINDS = ("open", "done", "failed")
ROWS = "part string, contract string, attempt string, ts timestamp, code string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sound() -> Column:
    return F.coalesce(F.col("contract").isNotNull() & F.col("attempt").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin(*KINDS), F.lit(False))


def _rows(events: DataFrame, part: str, code: Column | str, ts: str = "ts") -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return events.select(F.lit(part).alias("part"), "contract", "attempt", F.col(ts).alias("ts"), code.alias("code"))


def settle(events: DataFrame, limit: str, as_of: DataFrame | None = None) -> DataFrame:
    """Rows (part, contract, attempt, ts, code) of part `ledger` or `audit`.

    as_of: one row with one column, the time up to which events are known (by default the latest ts);
    a contract whose limit ends later isn't timed out yet. A contract is one row of
    sums before it meets its events, so no group is gathered.
    """
    events = events.select(F.col("contract").cast("string"), F.col("attempt").cast("string"), F.col("ts").cast("timestamp"), "kind")
    sound = events.where(_sound())
    until = (as_of.toDF("until") if as_of is not None else sound.agg(F.max("ts").alias("until"))).select(F.col("until").cast("timestamp"))
    held = sound.where("kind = 'open'").groupBy("contract").agg(F.min(F.struct("ts", "attempt")).alias("h")).select("contract", F.col("h.ts").alias("opened"), F.col("h.attempt").alias("holder"), (F.col("h.ts") + F.expr(f"interval {limit}")).alias("deadline"))
    with_holder = sound.join(held, "contract", "left")
    in_time = (F.col("kind") != "open") & (F.col("attempt") == F.col("holder")) & F.col("ts").between(F.col("opened"), F.col("deadline"))
    ends = with_holder.where(in_time).groupBy("contract").agg(F.min(F.struct("ts", "kind")).alias("end"))
    opened = _rows(held.withColumnRenamed("holder", "attempt"), "ledger", "opened", "opened")
    settled = held.withColumnRenamed("holder", "attempt").join(ends, "contract", "left")
    closed = _rows(settled.where("end is not null").withColumn("ts", F.col("end.ts")), "ledger", F.col("end.kind"))
    timed_out = _rows(settled.where("end is null").join(F.broadcast(until)).where("deadline < until"), "ledger", "timed_out", "deadline")
    refused = (
        F.when((F.col("kind") == "open") & (F.col("attempt") != F.col("holder")), "retry_not_permitted")
        .when(F.col("kind") == "open", None)
        .when(F.col("opened").isNull() | (F.col("ts") < F.col("opened")), "no_attempt")
        .when(F.col("attempt") != F.col("holder"), "not_the_attempt")
        .when(F.col("end").isNull() | (F.col("kind") != F.col("end.kind")), "already_closed")
    )
    audit = _rows(with_holder.join(ends, "contract", "left").withColumn("code", refused).where("code is not null"), "audit", F.col("code"))
    malformed = _rows(events.where(~_sound()), "audit", "malformed")
    return opened.unionByName(closed).unionByName(timed_out).unionByName(audit).unionByName(malformed)


class OneShot(StatefulProcessor):
    """State of a contract: its holder, when it was opened, and how it was closed."""

    def __init__(self, limit_us: int):
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("contract", "holder string, opened long, closed string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        holder, opened, closed = self.state.get() if self.state.exists() else (None, None, None)
        before = (holder, opened, closed)
        for r in sorted(rows, key=lambda r: (r["us"], KINDS.index(r["kind"]), r["attempt"])):
            said = lambda part, code, us=r["us"], attempt=r["attempt"]: Row(part=part, contract=key[0], attempt=attempt, us=us, code=code)
            if r["kind"] == "open":
                if holder is None:
                    holder, opened = r["attempt"], r["us"]
                    # timers count in milliseconds: the first one after the limit
                    self.handle.registerTimer((opened + self.limit_us) // 1000 + 1)
                    yield said("ledger", "opened")
                elif r["attempt"] != holder:
                    yield said("audit", "retry_not_permitted")
            elif holder is None or r["us"] < opened:
                yield said("audit", "no_attempt")
            elif r["attempt"] != holder:
                yield said("audit", "not_the_attempt")
            elif closed is None and r["us"] > opened + self.limit_us:
                closed = "timed_out"
                yield said("ledger", closed, opened + self.limit_us)
                yield said("audit", "already_closed")
            elif closed is None:
                closed = r["kind"]
                yield said("ledger", closed)
            elif closed != r["kind"]:
                yield said("audit", "already_closed")
        if (holder, opened, closed) != before:
            self.state.update((holder, opened, closed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        holder, opened, closed = self.state.get()
        if closed is None:
            self.state.update((holder, opened, "timed_out"))
            yield Row(part="ledger", contract=key[0], attempt=holder, us=opened + self.limit_us, code="timed_out")

    def close(self) -> None:
        pass


def transact(events: DataFrame, limit_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """The rows of `settle` from a stream of events. delay: how long the watermark waits for late events."""
    events = events.select(F.col("contract").cast("string"), F.col("attempt").cast("string"), F.col("ts").cast("timestamp"), "kind")
    sound = events.where(_sound()).withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay)
    processed = sound.groupBy("contract").transformWithState(OneShot(limit_seconds * 1_000_000), "part string, contract string, attempt string, us long, code string", "Append", "EventTime")
    return processed.select("part", "contract", "attempt", F.timestamp_micros("us").alias("ts"), "code")


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """What transformWithState needs; of the session, to be called before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def transact_stream(events: DataFrame, limit_seconds: int, path: str, checkpoint: str, delay: str = "0 seconds") -> StreamingQuery:
    """Publishes parts `ledger` and `audit` together, batch by batch, over all that is there now.

    A replayed event, batch or stream leaves both as they are.
    """
    keep_state_in_rocksdb(events.sparkSession)

    def split(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            publish_parts({p: batch.where(F.col("part") == p).drop("part") for p in ("ledger", "audit")}, batch_id, path)
        finally:
            batch.unpersist()

    writer = transact(events, limit_seconds, delay).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).foreachBatch(split).start()
