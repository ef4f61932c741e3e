"""Running sums, order statistics and time-window counts that no single task has to hold.

A plain window puts each partition key into one task. Where a key may hold a large share of
all rows (or where there is no key at all), the table is instead cut into range partitions
over (keys, order): every partition is about equally large however rows spread over keys.
Sums inside a partition are local windows; what came before it is one small row per
(key, partition). The cut points are sampled, so the cut table is written once and read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlift.workspace import materialise

PART_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def layout(df: DataFrame, keys: list[str], order: list[str], name: str = "layout") -> DataFrame:
    """``df`` in range partitions of (keys, order), with ``_part`` and the row order ``_row``."""
    cols = [*keys, *order]
    cut = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_row", F.monotonically_increasing_id())
    return materialise(cut, name).withColumn("_part", F.shiftright("_row", PART_BITS))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    firsts: dict[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums per key in ``order``.

    Each entry ``s`` of ``sums`` (integer columns) gives ``s`` and the key total ``s_total``.
    ``firsts`` maps a new column to a source column whose value on the key's first row is
    wanted; the source must not fall along ``order``.
    """
    firsts = firsts or {}
    laid = layout(df.withColumns({f"_v_{s}": c.cast("bigint") for s, c in sums.items()}), keys, order)
    near = Window.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    local = laid.withColumns({s: F.sum(f"_v_{s}").over(near) for s in sums})

    parts = laid.groupBy(*keys, "_part").agg(
        *[F.sum(f"_v_{s}").alias(f"_t_{s}") for s in sums], *[F.min(c).alias(f"_f_{n}") for n, c in firsts.items()]
    )
    over = Window.partitionBy(*keys)
    before = over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *keys,
        "_part",
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(over).alias(f"{s}_total") for s in sums],
        *[F.min(f"_f_{n}").over(over).alias(n) for n in firsts],
    )
    out = local.join(offsets, [*keys, "_part"])
    out = out.withColumns({s: F.col(s) + F.col(f"_o_{s}") for s in sums})
    return out.drop("_row", "_part", *[f"_{p}_{s}" for p in "vo" for s in sums])


def dense_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Zero-based position of every row in the total order of the table."""
    out = running(df, [], order, {name: F.lit(1)})
    return out.withColumn(name, F.col(name) - 1).drop(f"{name}_total")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key, over distinct values and their counts."""
    tally = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(tally, keys, [value], {"_upto": F.col("_n")})
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_upto_total") - 1)
        for tag, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (pos >= F.col("_upto") - F.col("_n")) & (pos < F.col("_upto"))
            picks.append(F.max(F.when(here, F.col(value))).alias(f"_{name}_{tag}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_{name}_w"))
    found = ranked.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (F.col(f"_{n}_lo") + F.col(f"_{n}_w") * (F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))).alias(n)
            for n in probs
        ],
    )


def probe_counts(
    events: DataFrame, probes: DataFrame, keys: list[str], sums: dict[str, Column], back: dict[str, int]
) -> DataFrame:
    """For each probe (keys, ``us``, ``id``): sums over its key's events in [us - back, us].

    Events and the two ends of each window are put into one order and summed along it, so the
    work per row does not depend on how many events a window holds. Result columns are
    ``{sum}_{window}``.
    """
    zero = {s: F.lit(0) for s in sums}
    marks = F.array(
        F.struct(F.col("us").alias("at"), F.lit(2).alias("kind"), F.lit("now").alias("slot")),
        *[
            F.struct((F.col("us") - w).alias("at"), F.lit(0).alias("kind"), F.lit(name).alias("slot"))
            for name, w in back.items()
        ],
    )
    asked = probes.select(*keys, "id", F.explode(marks).alias("m")).select(
        *keys, F.col("m.at").alias("at"), F.col("m.kind").alias("kind"), "id", F.col("m.slot").alias("slot"),
        *[c.cast("bigint").alias(f"_e_{s}") for s, c in zero.items()],
    )
    seen = events.select(
        *keys, F.col("us").alias("at"), F.lit(1).alias("kind"), "id", F.lit(None).cast("string").alias("slot"),
        *[c.cast("bigint").alias(f"_e_{s}") for s, c in sums.items()],
    )
    line = running(seen.unionByName(asked), keys, ["at", "kind", "id"], {s: F.col(f"_e_{s}") for s in sums})

    def at_slot(s: str, slot: str) -> Column:
        return F.max(F.when(F.col("slot") == slot, F.col(s)))

    return (
        line.filter(F.col("slot").isNotNull())
        .groupBy(*keys, "id")
        .agg(*[(at_slot(s, "now") - at_slot(s, w)).alias(f"{s}_{w}") for s in sums for w in back])
    )
