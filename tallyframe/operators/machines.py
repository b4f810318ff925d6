"""Ordered state machines over events by key.

A machine has a start state and transitions (state, symbol) -> state; a pair without one is
refused and leaves the state as it is. Folding events in order is a scan: a stretch of events is
a map from each state before it to the state after it, and such maps are combined like sums.
Events are sorted by range, so a key with very many of them lies in several partitions; only
the maps of each partition's first and last key (two rows a partition) are put together on the driver,
then each partition runs from the states that it really begins with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.lineage import cut


@dataclass(frozen=True)
class Machine:
    start: str
    transitions: dict[tuple[str, str], str]

    @property
    def states(self) -> list[str]:
        return list(dict.fromkeys([self.start, *(s for s, _ in self.transitions), *self.transitions.values()]))

    def after(self, state: str, symbol: str | None) -> str | None:
        """The next state, or null if the symbol is refused."""
        return self.transitions.get((state, symbol))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple, str | None]]:
    for batch in batches:
        yield from zip(batch.column("_part").to_pylist(), batch.column("_key").to_pylist(), batch.column("_symbol").to_pylist(), strict=True)


def fold(events: DataFrame, key: str, order: list[str], symbol: str, machine: Machine) -> DataFrame:
    """events with state_before, state_after and refused.

    The order within a key is that of `order`, then of the symbol (null first); it should be total.
    A null key is a key of its own, a null symbol is refused. Empty events give no rows. Events are written
    before they are sorted: the bounds of the ranges are sampled from them, and would make them a second time.
    """
    columns = events.columns
    named = cut(events).select("*", F.col(key).cast("string").alias("_key"), F.col(symbol).cast("string").alias("_symbol"))
    by = ["_key", *order, "_symbol"]
    ranged = cut(named.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The maps of a partition's first and last key."""
        first = last = None
        for part, name, sign in _runs(batches):
            if last is None or last[1] != name:
                first = first or last
                last = [part, name, {s: s for s in machine.states}]
            last[2] = {s: machine.after(now, sign) or now for s, now in last[2].items()}
        for p, name, maps in [x for x in (first, last) if x]:
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "key": pa.array([name], pa.string()), "maps": pa.array([list(maps.items())], pa.map_(pa.string(), pa.string()))})

    found = ranged.select("_part", "_key", "_symbol").mapInArrow(ends, "part int, key string, maps map<string,string>").collect()
    begins: dict[int, str] = {}
    name, state = object(), machine.start
    for r in sorted(found, key=lambda r: r["part"]):  # a partition's first key comes before its last one
        if r["key"] != name:
            name, state = r["key"], machine.start
        begins.setdefault(r["part"], state)
        state = r["maps"][state]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, fresh = None, machine.start, True
        for batch in batches:
            before, after, refused = [], [], []
            for part, this, sign in _runs([batch]):
                if fresh or this != name:
                    name, state = this, begins[part] if fresh else machine.start
                    fresh = False
                following = machine.after(state, sign)
                before.append(state)
                refused.append(following is None)
                state = following or state
                after.append(state)
            found = [pa.array(before, pa.string()), pa.array(after, pa.string()), pa.array(refused, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + found, [*columns, "state_before", "state_after", "refused"])

    schema = events.limit(0).select("*", F.lit("").alias("state_before"), F.lit("").alias("state_after"), F.lit(True).alias("refused")).schema
    return ranged.mapInArrow(run, schema)


def last_states(folded: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, state, events, refusals): where each key's machine stands."""
    return folded.groupBy(key).agg(F.max_by("state_after", F.struct(*order)).alias("state"), F.count("*").alias("events"), F.count_if("refused").alias("refusals"))
