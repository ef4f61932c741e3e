"""Window pieces of the feature table: time-window counts, row frames and exponential means.

Counts over a time window are differences of two counts from the start of the partition.
Spark fills a frame that starts at UNBOUNDED PRECEDING once per row, while it rebuilds a frame
that slides at both ends for every row; the difference keeps a dense storm linear.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stormlift.functions.scalars import ALERT, HOUR, MINUTE, SECOND
from stormlift.operators.ordered import probe_counts, running

CG_MINUTES = (2, 5, 10, 15, 30)
IC_MINUTES = (2, 5, 10, 30)
ALL_MINUTES = (2, 5, 10)
HALO = 30 * MINUTE

ROW = ["us", "lightning_id"]  # total order of strikes inside a group
NUMBER = "_no"  # a strike's number in a written table, where cut forms must join back on it
EMA_FAN = 8
EMA_LEAST = 1e-17  # exponential weights below this are dropped

# The largest group one task is asked to hold; a larger one is cut into blocks.
MAX_GROUP_ROWS = 2_000_000
# Distinct times in a second above which a range join takes the second by milliseconds.
DENSE_TIMES = 1000


def strike_key(df: DataFrame) -> str:
    """What names a strike: its number where the table has one, else ``lightning_id``, which must then be unique."""
    return NUMBER if NUMBER in df.columns else "lightning_id"


def row_order(df: DataFrame) -> list[str]:
    return [*ROW, NUMBER] if NUMBER in df.columns else ROW


def up_to(w: WindowSpec, back_us: int = 0) -> WindowSpec:
    """All rows of the partition at least ``back_us`` older than the current one, peers included."""
    return w.rangeBetween(Window.unboundedPreceding, -back_us)


def largest_groups(strikes: DataFrame, split_rows: int) -> tuple[bool, bool]:
    """Whether some alert, and some site-hour, exceeds ``split_rows`` strikes (one column-pruned scan)."""
    sized = (
        strikes.withColumn("_hour", F.floor(F.col("us") / HOUR))
        .groupingSets([ALERT, ["airport", "_hour"]], *ALERT, "_hour")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("_hour").alias("by_alert"))
        .filter("by_alert = 0 OR airport_alert_id IS NOT NULL")
        .agg(F.max(F.when(F.col("by_alert") == 1, F.col("n"))), F.max(F.when(F.col("by_alert") == 0, F.col("n"))))
        .first()
    )
    return (sized[0] or 0) > split_rows, (sized[1] or 0) > split_rows


def must_cut(strikes: DataFrame, split: str, split_rows: int) -> tuple[bool, bool]:
    """Whether alerts, and site-hours, are to be cut. ``auto`` measures, the other two say so."""
    if split not in ("auto", "never", "always"):
        raise ValueError(f"split must be auto, never or always, not {split}")
    if split == "auto":
        return largest_groups(strikes, split_rows)
    return split == "always", split == "always"


def context_counts(strikes: DataFrame, wanted: Column, dense: bool = False) -> DataFrame:
    """``wanted`` strikes with the airport-wide ``n_ic_*min`` and ``n_all_*min`` counts.

    Default: windows per airport and hour, each strike of the second half hour also copied into
    the next hour, so tasks are spread over airports x hours. ``dense`` is the form for hours
    too large for one task.
    """
    names = {f"n_ic_{m}min": ("ic", m) for m in IC_MINUTES} | {f"n_all_{m}min": ("all", m) for m in ALL_MINUTES}
    if dense:
        own = strike_key(strikes)
        events = strikes.withColumn("id", F.col(own))
        counted = probe_counts(
            events,
            events.filter(wanted),
            ["airport"],
            {"ic": F.col("icloud").cast("int"), "all": F.lit(1)},
            {f"{m}": m * MINUTE for m in IC_MINUTES},
        )
        counted = counted.select(
            "airport", F.col("id").alias(own), *[F.col(f"{s}_{m}").alias(n) for n, (s, m) in names.items()]
        )
        return strikes.filter(wanted).join(counted, ["airport", own])

    late = F.pmod(F.col("us"), F.lit(HOUR)) >= HOUR - HALO
    copies = F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = strikes.select("*", F.explode(copies).alias("_copy")).withColumn(
        "_hour", F.floor(F.col("us") / HOUR) + F.col("_copy")
    )
    w = Window.partitionBy("airport", "_hour").orderBy("us")
    what = {"ic": F.count(F.when(F.col("icloud"), 1)), "all": F.count(F.lit(1))}
    counted = spread.withColumns(
        {n: what[s].over(up_to(w)) - what[s].over(up_to(w, m * MINUTE + 1)) for n, (s, m) in names.items()}
    )
    return counted.filter((F.col("_copy") == 0) & wanted).drop("_copy", "_hour")


def context_counts_by_join(strikes: DataFrame, wanted: Column, dense_times: int = DENSE_TIMES) -> DataFrame:
    """The same counts as an explicit range join, in buckets as narrow as the density asks.

    A count over [t - w, t] is what lies up to t less what lies before t - w. Each of these ends is
    joined with the distinct times of its own bucket alone; whole buckets before it are sums of one
    row a bucket. A bucket is a second, or a millisecond where the second has more than
    ``dense_times`` distinct times, so none holds more times than that or a thousand, whatever storm
    a table holds: no task gets more for one key.
    """
    times = strikes.groupBy("airport", "us").agg(
        F.count_if("icloud").alias("ic"), F.count(F.lit(1)).alias("all"), F.count_if(wanted).alias("asked")
    )
    times = times.withColumn("_s", F.floor(F.col("us") / SECOND))
    dense = times.groupBy("airport", "_s").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > dense_times)
    fine = F.when(F.col("_n").isNotNull(), F.floor(F.col("at") / (SECOND // 1000))).otherwise(F.col("_s") * 1000)

    def bucketed(df: DataFrame) -> DataFrame:
        return df.join(dense, ["airport", "_s"], "left").withColumn("bucket", fine).drop("_s", "_n")

    ends = {"now": 0} | {f"{m}": m * MINUTE + 1 for m in IC_MINUTES}
    marks = F.array(*[F.struct(F.lit(n).alias("slot"), (F.col("us") - back).alias("at")) for n, back in ends.items()])
    points = times.filter("asked > 0").select("airport", "us", F.inline(marks))
    points = bucketed(points.withColumn("_s", F.floor(F.col("at") / SECOND)))
    seen = bucketed(times.withColumn("at", F.col("us"))).select("airport", "bucket", F.col("us").alias("seen_us"), "ic", "all")

    nothing = points.select("airport", "bucket", F.lit(0).alias("ic"), F.lit(0).alias("all"))
    totals = seen.drop("seen_us").unionByName(nothing).groupBy("airport", "bucket").agg(F.sum("ic").alias("own_ic"), F.sum("all").alias("own_all"))
    upto = running(totals, ["airport"], ["bucket"], {"upto_ic": F.col("own_ic"), "upto_all": F.col("own_all")})
    before = upto.select("airport", "bucket", *[(F.col(f"upto_{s}") - F.col(f"own_{s}")).alias(f"before_{s}") for s in ("ic", "all")])

    inside = points.join(seen, ["airport", "bucket"]).filter("seen_us <= at").groupBy("airport", "us", "slot").agg(F.sum("ic").alias("ic"), F.sum("all").alias("all"))
    counted = points.join(before, ["airport", "bucket"]).join(inside, ["airport", "us", "slot"], "left")

    def reached(s: str, slot: str) -> Column:
        return F.sum(F.when(F.col("slot") == slot, F.col(f"before_{s}") + F.coalesce(s, F.lit(0))))

    per_time = counted.groupBy("airport", "us").agg(
        *[(reached("ic", "now") - reached("ic", f"{m}")).alias(f"n_ic_{m}min") for m in IC_MINUTES],
        *[(reached("all", "now") - reached("all", f"{m}")).alias(f"n_all_{m}min") for m in ALL_MINUTES],
    )
    return strikes.filter(wanted).select("airport", "us", "lightning_id").join(per_time, ["airport", "us"]).drop("us")


def place(df: DataFrame, cut: bool, block_rows: int, reach: int) -> tuple[DataFrame, list[str]]:
    """``rank``, ``start_us``, ``prev_us`` and ``total`` of each strike in its alert, and how to partition.

    ``x`` counts strikes from a near origin, small enough to fit lines on. Returned next to the table are the columns that, with the alert key, bound a window partition.
    Uncut that is none. Cut, it is ``_block``: runs of ``block_rows`` strikes, the last ``reach``
    of which are repeated (``_halo`` true) at the head of the next run, for frames that look back.
    """
    if not cut:
        w = Window.partitionBy(*ALERT).orderBy(*row_order(df))
        cols = {
            "rank": (F.row_number().over(w) - 1).cast("bigint"),
            "start_us": F.min("us").over(w),
            "prev_us": F.lag("us").over(w),
            "x": F.row_number().over(w).cast("double"),
            "total": F.count(F.lit(1)).over(Window.partitionBy(*ALERT)),
            "_halo": F.lit(False),
        }
        return df.withColumns(cols), []
    if block_rows < reach:
        raise ValueError(f"a block must hold at least {reach} strikes")
    seen = running(df, ALERT, row_order(df), {"_seen": F.lit(1)}, {"start_us": "us"})
    seen = seen.withColumns({"rank": F.col("_seen") - 1, "total": F.col("_seen_total")}).drop("_seen", "_seen_total")
    tail = F.pmod(F.col("rank"), F.lit(block_rows)) >= block_rows - reach
    copies = F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = seen.select("*", F.explode(copies).alias("_copy"))
    spread = spread.withColumn("_block", F.floor(F.col("rank") / block_rows) + F.col("_copy"))
    w = Window.partitionBy(*ALERT, "_block").orderBy(*row_order(df))
    near = {
        "prev_us": F.lag("us").over(w),
        "x": (F.col("rank") - F.col("_block") * block_rows).cast("double"),
        "_halo": F.col("_copy") == 1,
    }
    return spread.withColumns(near).drop("_copy"), ["_block"]


def cg_density(cg: DataFrame, cut: bool) -> DataFrame:
    """``n_cg_*min``: CG strikes of the alert in [t - window, t], later peers of the same time left out.

    ``cg`` holds the CG strikes with ``rank_cg``. Position + 1 counts what lies at or before the
    row; taken off is what lies before the window.
    """
    if not cut:
        w = Window.partitionBy(*ALERT).orderBy("us")
        older = {m: F.count(F.lit(1)).over(up_to(w, m * MINUTE + 1)) for m in CG_MINUTES}
        return cg.withColumns({f"n_cg_{m}min": F.col("rank_cg") + 1 - older[m] for m in CG_MINUTES})
    own = strike_key(cg)
    events = cg.select(*ALERT, "us", F.col(own).alias("id"))
    inside = probe_counts(events, events, ALERT, {"n": F.lit(1)}, {f"{m}": m * MINUTE for m in CG_MINUTES})
    # the window count includes peers after the row
    peer = events.groupBy(*ALERT, "us").agg(F.count(F.lit(1)).alias("_n"))
    upto = running(peer, ALERT, ["us"], {"_upto": F.col("_n")}).select(*ALERT, "us", "_upto")
    counted = cg.join(inside.withColumnRenamed("id", own), [*ALERT, own]).join(upto, [*ALERT, "us"])
    after = F.col("_upto") - 1 - F.col("rank_cg")
    return counted.withColumns({f"n_cg_{m}min": F.col(f"n_{m}") - after for m in CG_MINUTES}).drop(
        "_upto", *[f"n_{m}" for m in CG_MINUTES]
    )


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def slope(value: Column, w: WindowSpec, n: int) -> Column:
    """Least-squares slope against the position, null on the group's first row.

    Positions step by one, so their variance over k rows is (k^2 - 1) / 12 and only the
    covariance is aggregated.
    """
    k = F.least(F.col("rank_cg") + 1, F.lit(n))
    return F.when(k > 1, F.covar_pop(value, F.col("x")).over(last_rows(w, n)) * 12 / (k * k - 1))


def ema_reach(spans: tuple[int, ...]) -> int:
    """Rows after which every exponential weight of these spans is below ``EMA_LEAST``."""
    return max(math.ceil(math.log(EMA_LEAST) / math.log(1 - 2 / (n + 1))) if n > 1 else 1 for n in spans)


def ema(df: DataFrame, value: str, spans: tuple[int, ...], w: WindowSpec, first: Column, name: str) -> DataFrame:
    """Exponential means y = (1-a) y' + a x with a = 2 / (span + 1), started at the first value.

    Weighted sums over the last m rows, each shrunk by (1-a)^m for every m rows further back,
    add up to the sum over the last 8 m rows; rounds go on until they pass ``ema_reach``.
    """
    keep = {n: 1 - 2 / (n + 1) for n in spans}
    out = df.withColumns(
        {f"{name}_{n}": F.when(first, F.col(value)).otherwise(F.col(value) * (1 - keep[n])) for n in spans}
    )
    m = 1
    while m < ema_reach(spans):
        grown = {}
        for n in spans:
            y = f"{name}_{n}"
            shrinks = {i * m: keep[n] ** (i * m) for i in range(1, EMA_FAN) if keep[n] ** (i * m) > EMA_LEAST}
            if shrinks:
                grown[y] = sum((k * F.lag(y, back, 0.0).over(w) for back, k in shrinks.items()), F.col(y))
        out = out.withColumns(grown)
        m *= EMA_FAN
    return out
