"""Exploration tables: overviews, histograms, crosstabs, correlations."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlift.functions.scalars import ALERT, MINUTE, clip, in_alert, is_cg, micros, utc_month
from stormlift.operators.ordered import running
from stormlift.operators.windows import MAX_GROUP_ROWS, must_cut, place
from stormlift.workspace import materialise


def _long(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """One row per (keys, column, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.inline(pairs))


def dataset_overview(strikes: DataFrame) -> DataFrame:
    us = micros("date")
    return strikes.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(strikes.columns)).cast("bigint").alias("n_columns"),
        F.min(us).alias("first_us"),
        F.max(us).alias("last_us"),
        F.countDistinct("airport").alias("n_airports"),
        F.countDistinct(F.when(in_alert(), F.struct(*ALERT))).alias("n_alerts"),
        F.count_if(F.col("dist") < 3).alias("n_danger"),
    )


def airport_overview(strikes: DataFrame) -> DataFrame:
    """Counts, means and alerts per airport; an airport without alerts keeps null there."""
    per_airport = strikes.groupBy("airport").agg(
        F.count("lightning_id").alias("n_strikes"),
        F.count_if(is_cg()).alias("n_cg"),
        F.count_if("icloud").alias("n_ic"),
        F.avg("dist").alias("dist_mean"),
        F.avg("amplitude").alias("amp_mean"),
        F.avg(F.abs("amplitude")).alias("amp_abs_mean"),
    )
    alerts = (
        strikes.filter(in_alert())
        .groupBy(*ALERT)
        .agg(F.count("*").alias("n"))
        .groupBy("airport")
        .agg(F.count("*").alias("n_alerts"), F.sum("n").alias("n_in_alerts"))
    )
    return per_airport.join(alerts, "airport", "left").withColumn(
        "ic_cg_ratio", F.round(F.col("n_ic") / F.nullif(F.col("n_cg"), F.lit(0)), 2)
    )


def alert_overview(strikes: DataFrame) -> DataFrame:
    """One row per alert. Times are epoch microseconds."""
    us = micros("date")
    return (
        strikes.filter(in_alert())
        .groupBy(*ALERT)
        .agg(
            F.count("lightning_id").alias("n_strikes"),
            F.count_if(is_cg()).alias("n_cg"),
            F.count_if("icloud").alias("n_ic"),
            F.min(us).alias("start_us"),
            F.max(us).alias("end_us"),
            F.min("dist").alias("dist_min"),
            F.max("dist").alias("dist_max"),
            F.max(F.abs("amplitude")).alias("amp_abs_max"),
        )
        .withColumns(
            {
                "duration_min": (F.col("end_us") - F.col("start_us")) / MINUTE,
                "start_month": utc_month("start_us").cast("bigint"),
            }
        )
    )


#: Accuracy of the sketch that brackets a quartile, and how far to either side a bracket may reach, in shares of all values.
SKETCH = 10_000
REACHES = (4 / SKETCH, 0.01, 0.1, 1.0)
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _brackets(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], tuple[float, float]]:
    """Values surely at or below, and at or above, each quartile of each column: two numbers each, from one pass.

    Of all reaches the shortest counts that covers twice the sketch's rank error and two values more.
    """
    offs = [(q, r, side) for q in QUARTILES for r in REACHES for side in (-1, 1)]
    probs = F.array(*[F.lit(min(1.0, max(0.0, QUARTILES[q] + side * r))) for q, r, side in offs])
    cols = [F.col(c).cast("double") for c in columns]
    sketch = df.agg(*[F.percentile_approx(c, probs, F.lit(SKETCH)).alias(f"_s{i}") for i, c in enumerate(cols)], *[F.count(c).alias(f"_n{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(columns):
        if n := sketch[f"_n{i}"]:
            reach = next(r for r in REACHES if r >= 2 / SKETCH + 2 / n or r == REACHES[-1])
            ends = dict(zip(offs, sketch[f"_s{i}"], strict=True))
            out |= {(c, q): (ends[q, reach, -1], ends[q, reach, 1]) for q in QUARTILES}
    return out


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sd, min, quartiles, max per column; quartiles are exact and interpolated.

    A mergeable sketch brackets every quartile; the pass of the plain aggregates also counts what lies
    below each bracket, and only the values inside brackets, a thousandth of a large table, are put in order.
    """
    facts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    brackets = _brackets(df, columns)
    below = [F.count_if(F.col(c).cast("double") < F.lit(lo)).alias(f"{c}|{q}|below") for (c, q), (lo, _) in brackets.items()]
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}|{n}") for c in columns for n, f in facts.items()], *below)
    cells = [F.struct(F.lit(c).alias("column"), *[F.col(f"{c}|{n}").alias(n) for n in facts]) for c in columns]
    basics = one.select(F.inline(F.array(*cells)))
    if not brackets:
        return basics.withColumns({q: F.lit(None).cast("double") for q in QUARTILES})
    starts = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(q).alias("q"), F.col(f"{c}|{q}|below").alias("below"), F.col(f"{c}|count").alias("n")) for c, q in brackets])))

    marks = [
        F.when(F.col(c).cast("double").between(lo, hi), F.struct(F.lit(c).alias("column"), F.lit(q).alias("q"), F.col(c).cast("double").alias("value")))
        for (c, q), (lo, hi) in brackets.items()
    ]
    inside = df.select(F.array_compact(F.array(*marks)).alias("m")).filter(F.size("m") > 0).select(F.inline("m"))
    tally = inside.groupBy("column", "q", "value").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(tally, ["column", "q"], ["value"], {"_upto": F.col("_n")}).join(starts, ["column", "q"])
    share = F.element_at(F.create_map(*[F.lit(x) for pair in QUARTILES.items() for x in pair]), F.col("q"))
    at = share * (F.col("n") - 1)
    upto = F.col("below") + F.col("_upto")

    def pick(pos: Column) -> Column:
        return F.max(F.when((pos >= upto - F.col("_n")) & (pos < upto), F.col("value")))

    found = ranked.groupBy("column", "q").agg(pick(F.floor(at)).alias("lo"), pick(F.ceil(at)).alias("hi"), F.max(at - F.floor(at)).alias("w"))
    exact = F.col("lo") + F.col("w") * (F.col("hi") - F.col("lo"))
    turned = found.groupBy("column").agg(*[F.max(F.when(F.col("q") == q, exact)).alias(q) for q in QUARTILES])
    return basics.join(turned, "column", "left")


def null_profile(df: DataFrame) -> DataFrame:
    """Null count per column, from one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _long(counts, df.columns).select("column", F.col("value").cast("bigint").alias("n_null"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str | Column, col: Column, values: list, prefix: str, row_name: str) -> DataFrame:
    """Counts of ``col``'s values as columns, 0 where absent. The values are given, so one shuffle."""
    return df.groupBy((F.col(row) if isinstance(row, str) else row).alias(row_name)).agg(
        *[F.count_if(col == F.lit(v)).alias(f"{prefix}{str(v).lower()}") for v in values]
    )


def long_crosstab(df: DataFrame, rows: Column, cols: str, name: str) -> DataFrame:
    """The same counts as (row, column, n), for columns with no fixed set of values."""
    return df.groupBy(rows.alias(name), cols).agg(F.count("*").alias("n"))


def class_balance(labelled: DataFrame, by: list[str] = ()) -> DataFrame:
    pos, n = F.sum("y"), F.count("*")
    return labelled.groupBy(*by).agg(
        n.alias("n"),
        pos.cast("bigint").alias("n_pos"),
        (pos / n).alias("pos_rate"),
        ((n - pos) / F.nullif(pos, F.lit(0))).alias("neg_per_pos"),
    )


def histogram(
    df: DataFrame, value: Column, bins: int, by: list[str] = (), limits: tuple[float, float] | None = None
) -> DataFrame:
    """Density histogram per group over its own range; the last bin includes its right edge.

    One pass finds the ranges, a second bins the rows where they lie, so that no more than groups x bins
    counts a task are shuffled. The ranges, a row per group, are written: Spark then knows their size and
    broadcasts them only if they are few. A group whose values are all equal gets the range +-0.5.
    """
    by = list(by)
    v = value if limits is None else clip(value, *limits)
    rows = df.select(*by, v.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    ranges = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_total"))
    flat = F.col("_lo") == F.col("_hi")
    ranges = ranges.select(
        *by,
        "_total",
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    if by:
        known = materialise(ranges, "ranges")
        same = F.lit(True)
        for c in by:
            same &= F.col(f"rows.{c}").eqNullSafe(F.col(f"known.{c}"))
        placed = rows.alias("rows").join(known.alias("known"), same).select("rows.*", "_total", "_lo", "_hi")
    else:  # one row of totals: a scalar subquery
        whole = ranges.select(F.struct("_total", "_lo", "_hi")).scalar()
        placed = rows.withColumn("_r", whole).select("*", "_r._total", "_r._lo", "_r._hi")
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_no = F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))
    counted = placed.groupBy(*by, bin_no.alias("bin"), "_total", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        *by,
        F.col("bin").cast("bigint").alias("bin"),
        (F.col("_lo") + F.col("bin") * width).alias("left"),
        "n",
        (F.col("n") / (F.col("_total") * width)).alias("density"),
    )


def alert_clock(strikes: DataFrame, split: str = "auto", split_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """In-alert strikes with position columns; ``total_in_alert`` and ``relative_pos`` know the future.

    Exploration only. ``split`` as in ``features_v3``.
    """
    inside = strikes.filter(in_alert()).withColumn("us", micros("date"))
    placed, _ = place(inside, must_cut(inside, split, split_rows)[0], split_rows, 1)
    return placed.filter(~F.col("_halo")).select(
        *strikes.columns,
        F.col("rank").alias("rank_in_alert"),
        ((F.col("us") - F.col("prev_us")) / 1e6).alias("time_prev"),
        ((F.col("us") - F.col("start_us")) / MINUTE).alias("time_since_start"),
        F.col("total").alias("total_in_alert"),
        (F.col("rank") / F.col("total")).alias("relative_pos"),
    )


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lower triangle of the Pearson matrix, each pair over the rows where both are present, in one pass."""
    pairs = [(a, b) for a, b in product(columns, columns) if columns.index(a) > columns.index(b)]

    def pair(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
        spread = F.stddev_pop(x) * F.stddev_pop(y)  # 0 for a constant column: no correlation
        return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))

    one = df.agg(*[pair(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = [
        F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs
    ]
    return one.select(F.inline(F.array(*cells)))


def last_vs_rest(features: DataFrame) -> DataFrame:
    """Mean signals of last and other CG strikes side by side, with the gap in percent."""
    signals = {
        "dt_prev_s": F.col("dt_prev_s"),
        "dist": F.col("dist"),
        "amp_abs": F.col("amp_abs"),
        "ic_share_5min": F.col("n_ic_5min") / F.col("n_all_5min"),
        "n_cg_10min": F.col("n_cg_10min").cast("double"),
    }
    last = F.col("is_last_lightning_cloud_ground")
    sides = {"mean_rest": ~last, "mean_last": last}
    one = features.agg(*[F.avg(F.when(side, c)).alias(f"{n}|{m}") for n, c in signals.items() for m, side in sides.items()])
    cells = [F.struct(F.lit(n).alias("signal"), *[F.col(f"{n}|{m}").alias(m) for m in sides]) for n in signals]
    both = one.select(F.inline(F.array(*cells)))
    return both.withColumn("gap_pct", 100 * (F.col("mean_last") / F.nullif(F.col("mean_rest"), F.lit(0.0)) - 1))


def mid_size_alerts(strikes: DataFrame, more_than: int = 20, less_than: int = 100) -> DataFrame:
    """Strikes of alerts whose size lies strictly between the bounds."""
    sizes = strikes.filter(in_alert()).groupBy(*ALERT).agg(F.count("*").alias("n"))
    fits = sizes.filter((F.col("n") > more_than) & (F.col("n") < less_than))
    return strikes.join(fits.select(*ALERT), ALERT, "left_semi")


def first_alerts(strikes: DataFrame) -> DataFrame:
    """The lowest alert id of each airport."""
    return strikes.filter(in_alert()).groupBy("airport").agg(F.min("airport_alert_id").alias("airport_alert_id"))


def trajectory(strikes: DataFrame, split: str = "auto") -> DataFrame:
    """Points of distance over minutes into the alert, by strike class."""
    kind = F.when(F.col("is_last_lightning_cloud_ground"), "last_cg").when(F.col("icloud"), "ic").otherwise("cg")
    return alert_clock(strikes, split).select(
        "lightning_id", *ALERT, F.col("time_since_start").alias("t_min"), "dist", "lon", "lat", kind.alias("kind")
    )


def alert_picker(strikes: DataFrame) -> DataFrame:
    """Every alert with its CG count, the label a user picks it by."""
    alerts = strikes.filter(in_alert()).groupBy(*ALERT).agg(F.count_if(is_cg()).alias("n_cg"))
    return alerts.withColumn("label", F.concat(F.lit("#"), "airport_alert_id", F.lit(" ("), "n_cg", F.lit(" strikes)")))


def random_alert(strikes: DataFrame, seed: int = 42) -> DataFrame:
    """One alert, drawn by the least MD5 of its key and the seed: the same on every run and in every engine."""
    alerts = strikes.filter(in_alert()).select(*ALERT).distinct()
    return alerts.orderBy(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ALERT], F.lit(str(seed))).cast("binary")), *ALERT).limit(1)


def numbered_per_airport(strikes: DataFrame) -> DataFrame:
    """``lightning_airport_id``: the strike's number within its airport, 1-based."""
    numbered = running(
        strikes.drop("lightning_airport_id").withColumn("us", micros("date")),
        ["airport"],
        ["us", "lightning_id"],
        {"lightning_airport_id": F.lit(1)},
    )
    return numbered.drop("us", "lightning_airport_id_total")


def temporal_split(strikes: DataFrame, last_train: Column) -> DataFrame:
    """``part``: train up to and including ``last_train`` (a year or a date), eval after it."""
    return strikes.withColumn("part", F.when(last_train, "train").otherwise("eval"))
