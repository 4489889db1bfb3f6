"""Keyed state over streams: revisions of predictions and weights of experts, equal to their batch operators.

Rows wait in the state of their key until the watermark has passed their time, so rows that
come late, but within the watermark, are still handled in order. State lies in the checkpoint
of the query: a query that starts again goes on where it ended.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidemark.operators.control import revised
from tidemark.scratch import ensure_importable
from tidemark.streaming.incremental import timed

c = F.col
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """Holds rows until their time has passed, then hands them on in order of time."""

    names: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.answer = handle, Row(*self.names)
        self.waiting = handle.getMapState("waiting", "ms long", "rows string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new: dict[int, dict[str, dict]] = {}
        for r in rows:
            new.setdefault(r["__ms"], {})[r["__part"]] = json.loads(r["__row"])
        for ms, parts in new.items():
            if self.waiting.containsKey((ms,)):
                parts = json.loads(self.waiting.getValue((ms,))[0]) | parts
            else:
                self.handle.registerTimer(ms)
            self.waiting.updateValue((ms,), (json.dumps(parts),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.waiting.containsKey((expiredTimerInfo.getExpiryTimeInMs(),)):
            return  # an earlier timer of this batch has seen to all that is due
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        for ms in sorted(k[0] for k in self.waiting.keys() if k[0] <= passed):
            yield from self.session(key, ms, json.loads(self.waiting.getValue((ms,))[0]))
            self.waiting.removeKey((ms,))

    def session(self, key, ms: int, rows: dict[str, dict]) -> Iterator[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Revise(_InOrder):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "output double")

    def session(self, key, ms, rows):
        for r in rows.values():
            before = self.last.get()[0] if self.last.exists() else None
            action, out = revised(before, r["value"], r["asks"], r["on"])
            self.last.update((out,))
            yield self.answer(*key, ms, action, out)


class _Experts(_InOrder):
    def __init__(self, eta: float, delay: int):
        self.eta, self.delay = eta, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.lost = handle.getMapState("lost", "model string", "total double, held string")

    def session(self, key, ms, rows):
        known = {m: self.lost.getValue((m,)) if self.lost.containsKey((m,)) else (0.0, "[]") for m in rows}
        z = {m: -self.eta * known[m][0] for m in rows}
        top = max(z.values())
        e = {m: math.exp(v - top) for m, v in z.items()}
        for m in sorted(rows):
            yield self.answer(*key, ms, m, e[m] / sum(e.values()))
            held = [*json.loads(known[m][1]), rows[m]["loss"]]  # outcomes that are not released yet
            total = known[m][0]
            while len(held) > self.delay:
                total += held.pop(0)
            self.lost.updateValue((m,), (total, json.dumps(held)))


def _run(rows: DataFrame, keys: Sequence[str], time: str, late: str, part, row, processor: _InOrder, added: list[StructField]) -> DataFrame:
    spark = rows.sparkSession
    ensure_importable(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    given = timed(rows, time, late)
    ready = given.select(*keys, time, F.unix_millis(c(time)).alias("__ms"), part.alias("__part"), F.to_json(row).alias("__row"))
    schema = StructType([*[rows.schema[k] for k in keys], StructField("__ms", LongType()), *added])
    processor.names = tuple(schema.names)
    out = ready.groupBy(*keys).transformWithState(processor, schema, "Append", "EventTime")
    return out.select(*keys, F.timestamp_millis("__ms").alias(time), *[f.name for f in added])


def stream_revisions(rows: DataFrame, keys: Sequence[str], time: str, late: str, selected: str = "selected", need: str = "update_need", active: str = "active") -> DataFrame:
    """(keys, time, action, output): control.revisions over a stream with one row a key and time.

    The last output of a key is its state. A row is answered once the watermark, late behind
    the newest row, has passed it; rows that come later than that are dropped. Of rows that
    repeat a key and time the last counts.
    """
    row = F.struct(c(selected).alias("value"), c(need).alias("asks"), c(active).alias("on"))
    return _run(rows, keys, time, late, F.lit(""), row, _Revise(), [StructField("action", StringType()), StructField("output", DoubleType())])


def stream_experts(losses: DataFrame, keys: Sequence[str], time: str, late: str, eta: float, delay: int = 0, model: str = "model", loss: str = "loss") -> DataFrame:
    """(keys, time, model, weight): scores.expert_average over a stream with one row a key, time and model.

    A model's released losses are summed in the state; those of its last delay rows are held
    there until they are due.
    """
    row = F.struct(c(loss).alias("loss"))
    return _run(losses, keys, time, late, c(model), row, _Experts(eta, delay), [StructField(model, StringType()), StructField("weight", DoubleType())])
