"""The live flow on Structured Streaming.

Strikes may come twice, late and out of order. A stateful step therefore holds what it gets
until the watermark has passed it, and then works it off in time order: what comes out equals
the batch result on the strikes that came in time.
"""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stormlift.functions.scalars import ALERT, HOUR, MINUTE, in_alert, is_cg, micros
from stormlift.operators.features import CONTEXT, ROLL
from stormlift.operators.windows import ALL_MINUTES, CG_MINUTES, HALO, IC_MINUTES

DELAY = "10 minutes"
GAP_US = 30 * MINUTE
#: Alerts of a site share this many keys of state: a call costs a millisecond or two whatever it brings, and alerts are many and short.
SITE_PARTS = 4
#: The hours of a site whose strikes share a key of the context's state; longer than HALO.
CONTEXT_SLOT = 6 * HOUR


def late_bound(strikes: DataFrame, delay: str = DELAY) -> DataFrame:
    return strikes.withWatermark("date", delay)


def dedupe(strikes: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each strike once, however often it is delivered within the watermark."""
    return late_bound(strikes, delay).dropDuplicatesWithinWatermark(["lightning_id"])


def live_sessions(strikes: DataFrame, by: list[str], delay: str = DELAY) -> DataFrame:
    """Sessions as they close: a gap longer than 30 minutes ends one."""
    return (
        late_bound(strikes, delay)
        .groupBy(*by, F.session_window("date", "30 minutes").alias("s"))
        .agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n"))
        .drop("s")
    )


def live_activity(strikes: DataFrame, minutes: int = 10, step: int = 1, delay: str = DELAY) -> DataFrame:
    """Strike counts per site in windows sliding by ``step`` minutes (tumbling if equal)."""
    return (
        late_bound(strikes, delay)
        .groupBy("airport", F.window("date", f"{minutes} minutes", f"{step} minutes").alias("w"))
        .agg(
            F.count_if("icloud").alias("n_ic"),
            F.count_if(is_cg()).alias("n_cg"),
            F.count("*").alias("n_all"),
        )
        .select("airport", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_ic", "n_cg", "n_all")
    )


# --- state shared by the stateful steps ----------------------------------------------------


def _open_state(state: GroupState, empty: dict) -> dict:
    return json.loads(state.get[0]) if state.exists else empty


def _close_state(state: GroupState, kept: dict, wake_us: int | None) -> None:
    """Keep the state until the watermark passes ``wake_us``; None drops it."""
    if wake_us is None:
        if state.exists:
            state.remove()
        return
    state.update((json.dumps(kept),))
    state.setTimeoutTimestamp(max(wake_us // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def _take_ready(state: GroupState, waiting: list, batches: Iterator[pd.DataFrame], columns: list[str]) -> tuple:
    """(rows the watermark has passed, in time order; rows still waiting). A row is [us, id, ...]."""
    if not state.hasTimedOut:
        for pdf in batches:
            # object columns may hold NumPy scalars, which JSON does not take
            plain = [[v.item() if isinstance(v, np.generic) else v for v in pdf[c].tolist()] for c in columns]
            waiting.extend(list(r) for r in zip(*plain, strict=True))
    passed = state.getCurrentWatermarkMs() * 1000
    for r in waiting:
        if isinstance(r[1], float):  # a column of ids with a null comes as floats
            r[1] = None if math.isnan(r[1]) else int(r[1])
    waiting.sort(key=lambda r: (r[0], r[1] is None, r[1] or 0))
    cut = bisect.bisect_right(waiting, passed, key=lambda r: r[0])
    return waiting[:cut], waiting[cut:], passed


# --- features of an alert, strike by strike ------------------------------------------------

LIVE_FEATURES = [
    "rank_cg", "t_since_start_s", "dt_prev_s",
    *[f"{s}_{n}" for n in ROLL for s in ("dt_mean", "dt_max", "dt_std", "dt_ema", "dist_mean", "dist_trend", "amp_mean", "amp_trend")],
    *[f"n_cg_{m}min" for m in CG_MINUTES],
]
INTEGERS = {"rank_cg", *[f"n_cg_{m}min" for m in CG_MINUTES]}
FEATURE_SCHEMA = "lightning_id bigint, us bigint, airport string, airport_alert_id bigint, " + ", ".join(
    f"{c} {'bigint' if c in INTEGERS else 'double'}" for c in LIVE_FEATURES
)
EMPTY_ALERT = {"rank": 0, "start": None, "last_cg": None, "last": 0, "dt": [], "dist": [], "amp": [],
               "ema": [], "times": [], "lifted": False}


def _mean(y: list[float]) -> float:
    return sum(y) / len(y)


def _sd(y: list[float]) -> float:
    if len(y) < 2:
        return 0.0
    m = _mean(y)
    return math.sqrt(sum((v - m) ** 2 for v in y) / (len(y) - 1))


def _slope(y: list[float]) -> float | None:
    k = len(y)
    if k < 2:
        return None
    mid = (k - 1) / 2
    return sum((x - mid) * v for x, v in enumerate(y)) * 12 / (k * (k * k - 1))


def advance(a: dict, us: int, dist: float, amplitude: float) -> dict:
    """Take one CG strike into the alert's state and return its features."""
    dt = 0.0 if a["last_cg"] is None else (us - a["last_cg"]) / 1e6
    a["start"] = us if a["start"] is None else a["start"]
    keep = max(ROLL)
    for name, v in (("dt", dt), ("dist", dist), ("amp", abs(amplitude))):
        a[name] = [*a[name][-(keep - 1) :], v]
    a["times"] = [x for x in a["times"] if x >= us - max(CG_MINUTES) * MINUTE] + [us]
    weights = [2 / (n + 1) for n in ROLL]
    a["ema"] = [dt] * len(ROLL) if a["rank"] == 0 else [(1 - w) * e + w * dt for w, e in zip(weights, a["ema"], strict=True)]
    out = {"rank_cg": a["rank"], "t_since_start_s": (us - a["start"]) / 1e6, "dt_prev_s": dt}
    for n, ema in zip(ROLL, a["ema"], strict=True):
        gaps, dists, amps = a["dt"][-n:], a["dist"][-n:], a["amp"][-n:]
        out |= {
            f"dt_mean_{n}": _mean(gaps),
            f"dt_max_{n}": max(gaps),
            f"dt_std_{n}": _sd(gaps),
            f"dt_ema_{n}": ema,
            f"dist_mean_{n}": _mean(dists),
            f"dist_trend_{n}": _slope(dists),
            f"amp_mean_{n}": _mean(amps),
            f"amp_trend_{n}": _slope(amps),
        }
    out |= {f"n_cg_{m}min": sum(1 for x in a["times"] if x >= us - m * MINUTE) for m in CG_MINUTES}
    a["last_cg"], a["rank"] = us, a["rank"] + 1
    return out


def new_alert() -> dict:
    """The state of an alert before its first strike."""
    return json.loads(json.dumps(EMPTY_ALERT))


def _per_alert(emit: Callable[[dict, list, dict], dict | None], columns: list[str]) -> Callable:
    """A state function that hands ``emit`` each CG strike of a key's alerts with its features, in order.

    The state holds the strikes that wait and the open alerts by id.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        airport, kept = key[0], _open_state(state, {"wait": [], "open": {}})
        ready, kept["wait"], passed = _take_ready(
            state, kept["wait"], batches, ["us", "lightning_id", "icloud", "dist", "amplitude", "airport_alert_id"]
        )
        opened = kept["open"]
        rows = []
        for us, lid, icloud, dist, amplitude, no in ready:
            alert = opened.get(str(no)) or opened.setdefault(str(no), new_alert())
            alert["last"] = us
            if not icloud and not alert["lifted"]:  # a lifted alert only waits for its end
                made = emit(alert, [lid, us, airport, no], advance(alert, us, dist, amplitude))
                if made is not None:
                    rows.append(made)
        # an alert is over 30 minutes after its last strike of any kind
        waited_for = {str(r[5]) for r in kept["wait"]}
        kept["open"] = {no: a for no, a in opened.items() if no in waited_for or passed <= a["last"] + GAP_US}
        ends = [a["last"] + GAP_US for no, a in kept["open"].items() if no not in waited_for]
        _close_state(state, kept, min([*(r[0] for r in kept["wait"][:1]), *ends], default=None))
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return step


def _by_alert(strikes: DataFrame, step: Callable, schema: str, delay: str) -> DataFrame:
    """All strikes of alerts, IC included: they keep an alert open. State is per site and part of its alerts."""
    slim = late_bound(strikes.filter(in_alert()), delay).select(
        "lightning_id", "date", micros("date").alias("us"), *ALERT, "icloud", "dist", "amplitude"
    )
    slim = slim.withColumn("part", F.pmod(F.xxhash64("airport_alert_id"), F.lit(SITE_PARTS)))
    return slim.groupBy("airport", "part").applyInPandasWithState(
        step, schema, "kept string", "append", GroupStateTimeout.EventTimeTimeout
    )


def live_features(strikes: DataFrame, delay: str = DELAY) -> DataFrame:
    """Context-free features of every CG strike in an alert, as the watermark passes it."""
    names = ["lightning_id", "us", *ALERT, *LIVE_FEATURES]

    def emit(_: dict, ids: list, features: dict) -> dict:
        return dict(zip(names, [*ids, *features.values()], strict=True))

    return _by_alert(strikes, _per_alert(emit, names), FEATURE_SCHEMA, delay)


def live_decisions(
    strikes: DataFrame, confidence: Callable[[dict], float], theta: float = 0.85, delay: str = DELAY
) -> DataFrame:
    """One row per alert, when a strike's confidence first reaches theta.

    ``confidence`` maps a strike's features to a score; it runs inside the state function.
    """
    names = ["lightning_id", "us", *ALERT, "confidence"]

    def emit(alert: dict, ids: list, features: dict) -> dict | None:
        c = float(confidence(features))
        if c < theta:
            return None
        alert["lifted"] = True
        return dict(zip(names, [*ids, c], strict=True))

    schema = "lightning_id bigint, us bigint, airport string, airport_alert_id bigint, confidence double"
    return _by_alert(strikes, _per_alert(emit, names), schema, delay)


# --- airport-wide context ------------------------------------------------------------------


def live_context(strikes: DataFrame, delay: str = DELAY) -> DataFrame:
    """Airport-wide counts of each CG strike in an alert.

    State is kept per airport and CONTEXT_SLOT, each strike of its last half hour also going to the
    next slot: catching up runs slots side by side, and state ends with its slot.
    """
    late = F.pmod(F.col("us"), F.lit(CONTEXT_SLOT)) >= CONTEXT_SLOT - HALO
    spread = (
        late_bound(strikes, delay)
        .withColumn("us", micros("date"))
        .select(
            "date",
            "us",
            "lightning_id",
            "airport",
            F.coalesce("airport_alert_id", F.lit(-1)).alias("alert"),
            "icloud",
            F.explode(F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .withColumn("slot", F.floor(F.col("us") / CONTEXT_SLOT) + F.col("copy"))
    )
    names = ["lightning_id", "us", "airport", *CONTEXT]
    windows = [(1, m) for m in IC_MINUTES] + [(0, m) for m in ALL_MINUTES]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        airport, slot = key[0], int(key[1])
        kept = _open_state(state, {"wait": [], "seen": []})
        ready, kept["wait"], passed = _take_ready(
            state, kept["wait"], batches, ["us", "lightning_id", "icloud", "alert", "copy"]
        )
        kept["seen"] += [[us, icloud] for us, _, icloud, _, _ in ready]
        times = np.array([us for us, _ in kept["seen"]], dtype="int64")
        ic_times = np.array([us for us, icloud in kept["seen"] if icloud], dtype="int64")
        asked = [(us, lid) for us, lid, icloud, alert, copy in ready if not (icloud or alert < 0 or copy)]
        at = np.array([us for us, _ in asked], dtype="int64")
        counts = []  # of all asked strikes at once, from both ends of every window
        for ic_only, m in windows:
            line = ic_times if ic_only else times
            counts.append(np.searchsorted(line, at, "right") - np.searchsorted(line, at - m * MINUTE, "left"))
        rows = [[lid, us, airport, *c] for (us, lid), c in zip(asked, np.stack(counts, axis=1).tolist(), strict=True)]
        kept["seen"] = [r for r in kept["seen"] if r[0] >= passed - HALO]
        end = (slot + 1) * CONTEXT_SLOT
        if kept["wait"]:
            wake = kept["wait"][0][0]
        else:
            wake = None if passed >= end else end
        _close_state(state, kept, wake)
        if rows:
            yield pd.DataFrame(rows, columns=names)

    schema = "lightning_id bigint, us bigint, airport string, " + ", ".join(f"{c} bigint" for c in CONTEXT)
    return spread.groupBy("airport", "slot").applyInPandasWithState(
        step, schema, "kept string", "append", GroupStateTimeout.EventTimeTimeout
    )
