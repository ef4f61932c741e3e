"""The whole live chain: every strike's full feature row, its score, and one decision an alert.

One operator keyed by site holds, in typed state, the strikes the watermark has not passed, a ring of
the last half hour of all strikes, and the open alerts; event-time timers wake it. A fitted pack scores
its rows in the stream, and a sink that can be replayed keeps the first crossing of every alert.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stormlift.functions.scalars import ALERT, MINUTE, micros
from stormlift.operators.features import CONTEXT, KEYS, RAW, V3, derived_columns
from stormlift.operators.learn import score_pack
from stormlift.operators.windows import ALL_MINUTES, HALO, IC_MINUTES
from stormlift.streaming.flows import DELAY, GAP_US, LIVE_FEATURES, INTEGERS, advance, late_bound, new_alert

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_STRIKE = "us bigint, lightning_id bigint, alert bigint, icloud boolean, last boolean, " + ", ".join(f"{c} double" for c in RAW)
_STRIKE_NAMES = [c.split()[0] for c in _STRIKE.split(", ")]
_OPEN = "rank bigint, start bigint, last_cg bigint, last bigint, dt array<double>, dist array<double>, amp array<double>, ema array<double>, times array<bigint>"
_OPEN_NAMES = [c.split()[0] for c in _OPEN.split(", ")]
_ROW = (
    "lightning_id bigint, us bigint, airport string, airport_alert_id bigint, is_last_lightning_cloud_ground boolean, "
    + ", ".join(f"{c} double" for c in RAW) + ", "
    + ", ".join(f"{c} {'bigint' if c in INTEGERS else 'double'}" for c in LIVE_FEATURES) + ", "
    + ", ".join(f"{c} bigint" for c in CONTEXT)
)
_WINDOWS = [(True, m) for m in IC_MINUTES] + [(False, m) for m in ALL_MINUTES]


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return None
    return v.item() if isinstance(v, np.generic) else v


def _strike(row: tuple) -> tuple:
    """A row as the state's types have it: a nullable integer column comes as floats."""
    us, lid, alert, *rest = map(_plain, row)
    return (int(us), None if lid is None else int(lid), None if alert is None else int(alert), *rest)


class SiteRows(StatefulProcessor):
    """Feature rows of one site's CG strikes in alerts, in time order, as the watermark passes them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wait = handle.getListState("wait", _STRIKE)
        self.ring = handle.getListState("ring", "us bigint, icloud boolean")
        self.open = handle.getMapState("open", "alert bigint", _OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = [_strike(r) for pdf in rows for r in pdf[_STRIKE_NAMES].itertuples(index=False, name=None)]
        yield from self._work_off(key[0], fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._work_off(key[0], [], timerValues)

    def close(self) -> None:
        pass

    def _work_off(self, airport: str, fresh: list[tuple], timers) -> Iterator[pd.DataFrame]:
        passed_ms = timers.getCurrentWatermarkInMs()
        passed = passed_ms * 1000
        waiting = sorted([*map(tuple, self.wait.get()), *fresh], key=lambda r: (r[0], r[1] is None, r[1] or 0))
        cut = sum(r[0] <= passed for r in waiting)
        ready, waiting = waiting[:cut], waiting[cut:]
        stored = {alert: v for (alert,), v in self.open.iterator()}  # one answer, not one for each alert
        held: dict[int, dict] = {}
        ring = [(r[0], r[1]) for r in self.ring.get()]
        if ready:
            ring += [(r[0], r[3]) for r in ready]
            yield from self._rows(airport, ready, ring, stored, held)
            ring = [r for r in ring if r[0] >= min(passed, ring[-1][0]) - HALO]
            self.ring.put(ring)
        if fresh or ready:
            if waiting:
                self.wait.put(waiting)
            else:
                self.wait.clear()
        ends, waited_for = [], {r[2] for r in waiting}
        for alert in [*stored, *(a for a in held if a not in stored)]:
            last = held[alert]["last"] if alert in held else stored[alert][_OPEN_NAMES.index("last")]
            if passed > last + GAP_US and alert not in waited_for:  # an alert is over half an hour after its last strike of any kind
                if alert in stored:
                    self.open.removeKey((alert,))
                continue
            ends.append(last + GAP_US)
            if alert in held:  # only alerts that stay open are written
                self.open.updateValue((alert,), tuple(held[alert][k] for k in _OPEN_NAMES))
        newest = max((r[0] for r in ring), default=None)
        if newest is not None and passed > newest + HALO:
            self.ring.clear()
            newest = None
        wake = min([*(r[0] for r in waiting[:1]), *ends, *([] if newest is None else [newest + HALO])], default=None)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if wake is not None:
            self.handle.registerTimer(max(wake // 1000 + 1, passed_ms + 1))

    def _rows(self, airport: str, ready: list[tuple], ring: list[tuple], stored: dict[int, tuple], held: dict[int, dict]) -> Iterator[pd.DataFrame]:
        """Rows of the ready strikes; alerts they touch are moved from ``stored`` values into ``held``."""
        times = np.array([us for us, _ in ring], dtype="int64")
        ic_times = np.array([us for us, icloud in ring if icloud], dtype="int64")
        at = np.array([r[0] for r in ready], dtype="int64")
        counts = []  # of all ready strikes at once, from both ends of every window
        for ic_only, m in _WINDOWS:
            line = ic_times if ic_only else times
            counts.append(np.searchsorted(line, at, "right") - np.searchsorted(line, at - m * MINUTE, "left"))
        counts = np.stack(counts, axis=1)
        out = []
        for n, (us, lid, alert, icloud, last, *raw) in enumerate(ready):
            if alert is None:
                continue
            if alert not in held:
                kept = stored.get(alert)
                held[alert] = new_alert() if kept is None else {k: list(v) if isinstance(v, (list, tuple, np.ndarray)) else v for k, v in zip(_OPEN_NAMES, kept, strict=True)}
            state = held[alert]
            state["last"] = us
            if not icloud:
                made = advance(state, us, raw[RAW.index("dist")], raw[RAW.index("amplitude")])
                out.append([lid, us, airport, alert, last, *raw, *made.values(), *counts[n].tolist()])
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _ROW.split(", ")])


def live_rows(strikes: DataFrame, delay: str = DELAY) -> DataFrame:
    """``features_v3`` of a stream: every CG strike in an alert with its 61 numeric model columns.

    State is per site: what waits for the watermark, half an hour of strikes, and open alerts. Needs the
    RocksDB state store, which this sets. Strikes later than the watermark are dropped (``late_strikes``
    keeps them); a strike without distance or amplitude has null trends, as in the batch form.
    """
    strikes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    slim = late_bound(strikes, delay).select(
        "date", micros("date").alias("us"), "lightning_id", "airport", F.col("airport_alert_id").alias("alert"), "icloud",
        F.col("is_last_lightning_cloud_ground").alias("last"), *RAW,
    )
    rows = slim.groupBy("airport").transformWithStateInPandas(SiteRows(), _ROW, "Append", "EventTime")
    return derived_columns(rows).withColumn("date", F.timestamp_micros("us")).select(*KEYS, *V3)


def live_scores(strikes: DataFrame, pack: dict, delay: str = DELAY) -> DataFrame:
    """``live_rows`` scored by a fitted pack, as ``confidence``."""
    return score_pack(live_rows(strikes, delay), pack)


# --- sinks that can be replayed ------------------------------------------------------------


class Ledger:
    """Tables under one folder, written once for every batch: a batch that comes again replaces what it wrote,
    and only batches that were completed are read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def done(self) -> set[int]:
        """Ids of completed batches, one small row each."""
        try:
            return {r["batch"] for r in self.spark.read.schema("batch bigint").parquet(f"{self.path}/ledger").collect()}
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return set()

    def write(self, table: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def complete(self, batch: int) -> None:
        self.spark.range(1).select(F.lit(batch).cast("bigint").alias("batch")).write.mode("overwrite").parquet(f"{self.path}/ledger/no={batch}")

    def read(self, table: str, schema: str, before: int | None = None) -> DataFrame:
        done = [b for b in sorted(self.done()) if before is None or b < before]
        paths = [f"{self.path}/{table}/batch={b}" for b in done]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


DECISION = "lightning_id bigint, us bigint, airport string, airport_alert_id bigint, confidence double"


def decide_once(ledger: Ledger, theta: float = 0.85) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the first strike of every alert with confidence of ``theta`` and more.

    Rows of an alert come in time order from batch to batch, so an alert that an earlier batch decided stays
    decided. A batch that is delivered again, after a failure at any point, is worked off again, as its state
    must be, and replaces what it wrote: one decision an alert is left.
    """

    def sink(rows: DataFrame, batch: int) -> None:
        rows = rows.filter(F.col("confidence") >= theta).withColumn("us", micros("date"))
        first = rows.groupBy(*ALERT).agg(F.min(F.struct("us", "lightning_id", "confidence")).alias("f"))
        first = first.select("f.lightning_id", "f.us", *ALERT, "f.confidence")
        earlier = ledger.read("decisions", DECISION, before=batch).select(*ALERT)
        ledger.write("decisions", batch, first.join(earlier, list(ALERT), "left_anti"))
        ledger.complete(batch)

    return sink


def late_strikes(ledger: Ledger, delay_us: int = 10 * MINUTE) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for the raw stream: strikes that the watermark had passed when they came, as a side table.

    The watermark of a batch is the newest strike of all batches before it less ``delay_us``, in whole
    milliseconds, as the engine counts it.
    """

    def sink(rows: DataFrame, batch: int) -> None:
        newest = ledger.read("newest", "us bigint", before=batch).agg(F.max("us")).first()[0]
        bound = -1 if newest is None else (newest // 1000) * 1000 - delay_us
        ledger.write("late", batch, rows.filter(micros("date") <= bound))
        ledger.write("newest", batch, rows.agg(F.max(micros("date")).alias("us")).filter(F.col("us").isNotNull()))
        ledger.complete(batch)

    return sink


def run_to_end(flow: DataFrame, sink: Callable[[DataFrame, int], None], progress: str):
    """Run a stream into ``sink`` to the end of its input, from where ``progress`` left off; returns the ended query."""
    query = flow.writeStream.foreachBatch(sink).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
