"""Exact nearest neighbours in Euclidean space, without comparing all pairs where that can be avoided.

Points are cut into strips of about equal count along their first principal axis, each strip into tiles of
about equal count along the second, and every tile keeps its bounds on the first few axes. The cuts come from
sketches, so no point is moved for them; only if a tile were too full are the points put in order. A point first
looks in its own tile; the k-th distance found bounds how far a nearer point can lie. The strips
within that reach are joined with their tiles' bounds, and the point visits the tiles whose box is
near enough: axes are orthonormal, so a box is never farther than its points. Results are exact for
any data; how many tiles are visited depends on how well these axes separate the points.

Equal points are settled beforehand. With ties going to the lower id, only the k lowest ids of
a group of copies can be anyone's neighbour, and a point with k copies needs no search. Points whose
hash no other point has are no copies and stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlift.operators.ordered import dense_index, running
from stormlift.workspace import materialise

TILE = 2048
AXES = 4  # principal axes a tile's bounds are kept on
TILES_PER_GROUP = 8  # query tiles that visit together
PARTY = 1 << 17  # visitors from which on a tile is visited in another task: it has that many and a group's more at most
CHUNK = 64  # queries compared with a tile at once: a megabyte of distances

SALTS = 256  # parts a group of copies is ranked in
SKETCH = 10_000  # accuracy of the quantiles that tiles are cut at
FEW_COPIES = 100_000  # hashes of copies that are looked up anew in every pass, which spares writing all points again

PAIRS = "id bigint, nid bigint, dist double"
HOME = "id bigint, v array<double>, tile bigint, nids array<bigint>, dists array<double>"


def _lowest_copies(points: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` lowest ids of each distinct vector with their ``place``, ranked in salted parts first."""
    salted = points.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("_salt"))
    part = Window.partitionBy("v", "_salt").orderBy("id")
    short = salted.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= keep)
    whole = Window.partitionBy("v").orderBy("id")
    return short.select("id", "v", F.row_number().over(whole).alias("place")).filter(F.col("place") <= keep)


def _split_copies(points: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(points that can be neighbours, with ``ask`` where they still need theirs; settled pairs)."""
    hashed = points.withColumn("_h", F.xxhash64("v"))
    same = materialise(hashed.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h"), "same")
    alone = hashed.join(same, "_h", "left_anti").select("id", "v", F.lit(True).alias("ask"))
    crowd = hashed.join(same, "_h", "left_semi").select("id", "v")
    counts = crowd.groupBy("v").agg(F.count("*").alias("m"))
    low = materialise(_lowest_copies(crowd, k + 1).join(counts, "v"), "copies")
    crowds = low.filter(F.col("m") > k).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("_low"))
    others = F.slice(F.filter("_low", lambda x: x != F.col("id")), 1, k)
    settled = crowd.join(crowds, "v").select("id", F.explode(others).alias("nid"), F.lit(0.0).alias("dist"))
    kept = alone.unionByName(low.filter(F.col("place") <= k).select("id", "v", (F.col("m") <= k).alias("ask")))
    return (kept if same.count() <= FEW_COPIES else materialise(kept, "points")), settled


def _best(ids, vecs, tile_ids, tile_vecs, k: int, limits=None) -> pd.DataFrame:
    """The k nearest tile points of each query, ties to the lower id; a point is not its own neighbour.

    The index of the result is the place of the query."""
    order = np.argsort(tile_ids, kind="stable")
    tile_ids, tile_vecs = tile_ids[order], tile_vecs[order]
    odd = not (np.isfinite(vecs).all() and np.isfinite(tile_vecs).all())
    repeats = bool((tile_ids[1:] == tile_ids[:-1]).any())
    axes = np.ascontiguousarray(tile_vecs.T)
    out = []
    for at in range(0, len(ids), CHUNK):
        q, qid = vecs[at : at + CHUNK], ids[at : at + CHUNK]
        d2 = np.zeros((len(q), len(tile_ids)))
        for j in range(q.shape[1]):
            apart = q[:, j, None] - axes[None, j]
            apart *= apart
            d2 += apart
        if odd:
            d2[np.isnan(d2)] = np.inf
        if repeats:
            d2[qid[:, None] == tile_ids[None, :]] = np.inf
        else:
            mine = np.minimum(np.searchsorted(tile_ids, qid), len(tile_ids) - 1)
            own = np.flatnonzero(tile_ids[mine] == qid)
            d2[own, mine[own]] = np.inf
        near, dist, each = np.empty((len(q), k), int), np.empty((len(q), k)), np.arange(len(q))
        for place in range(k):  # the first of the least is that of the lowest id
            near[:, place] = d2.argmin(axis=1)
            dist[:, place] = np.sqrt(d2[each, near[:, place]])
            d2[each, near[:, place]] = np.inf
        keep = np.isfinite(dist)
        if limits is not None:
            keep &= dist <= limits[at : at + CHUNK, None]
        rows, slots = np.nonzero(keep)
        out.append(pd.DataFrame({"id": qid[rows], "nid": tile_ids[near[rows, slots]], "dist": dist[rows, slots]}, index=at + rows))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "nid": [], "dist": []})


def _along(axis) -> Column:
    products = F.zip_with("v", F.array(*[F.lit(float(a)) for a in axis]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def _cut_by_sketch(seen: DataFrame, n: int, tile: int, both: bool) -> DataFrame:
    """``strip`` and ``tile`` of every point, from quantiles of sketches: an eighth of a tile is left for their error."""
    room = max(1, tile * 7 // 8)
    side = max(1, math.isqrt(n // room)) if both else 1
    strips = max(1, -(-n // (room * side)))

    def shares(parts: int) -> list[float]:
        return [i / parts for i in range(1, parts)]

    def bucket(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return np.searchsorted(edges, values, side="left")

    first = np.unique(seen.agg(F.percentile_approx("p0", shares(strips), SKETCH)).first()[0] or []) if strips > 1 else np.empty(0)
    kept = ", ".join(f"{c} {t}" for c, t in seen.dtypes)

    def in_strips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(strip=bucket(pdf["p0"].to_numpy(), first))

    second = {}
    if side > 1:
        narrow = seen.select("p0", "p1").mapInPandas(in_strips, "p0 double, p1 double, strip bigint")
        found = narrow.groupBy("strip").agg(F.percentile_approx("p1", shares(side), SKETCH).alias("edges")).collect()
        second = {r["strip"]: np.unique(r["edges"]) for r in found}

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            strip = bucket(pdf["p0"].to_numpy(), first)
            at = strip * side
            if second:
                p1 = pdf["p1"].to_numpy()
                for one in np.unique(strip):
                    here = strip == one
                    at[here] += bucket(p1[here], second[one])
            yield pdf.assign(strip=strip, tile=at)

    return seen.mapInPandas(placed, f"{kept}, strip bigint, tile bigint")


def _cut_in_order(seen: DataFrame, n: int, tile: int, both: bool) -> DataFrame:
    """``strip`` and ``tile`` of every point, by its place in the order along the axes: exact, at a few moves of all points."""
    side = max(1, math.isqrt(n // tile)) if both else 1  # as many strips as tiles in a strip
    placed = dense_index(seen, ["p0", "id"], "_g").withColumn("strip", F.floor(F.col("_g") / (tile * side))).drop("_g")
    if side == 1:
        return placed.withColumn("tile", F.col("strip"))
    placed = running(placed, ["strip"], ["p1", "id"], {"_g": F.lit(1)}).drop("_g_total")
    return placed.withColumn("tile", F.col("strip") * side + F.floor((F.col("_g") - 1) / tile)).drop("_g")


def axes_of(points: DataFrame) -> dict[str, Column]:
    """The place of a vector ``v`` on each of the first principal axes."""
    dims = len(points.select("v").first()["v"])
    fitted = PCA(k=min(AXES, dims), inputCol="_x", outputCol="_p").fit(points.select(array_to_vector("v").alias("_x")))
    return {f"p{j}": _along(a) for j, a in enumerate(np.linalg.qr(fitted.pc.toArray())[0].T)}


def tiles_of(points: DataFrame, tile: int = TILE, along: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """``points`` (id, v, ...) with ``strip``, ``tile`` and their place on each axis; the tiles' bounds; the axes' names."""
    along = along or axes_of(points)
    names, seen, n = list(along), points.withColumns(along), points.count()
    ends = [f(c).alias(f"{t}_{c}") for c in names for t, f in (("lo", F.min), ("hi", F.max))]
    for cut in (_cut_by_sketch, _cut_in_order):
        # the places are left out of the written table: they follow from the vectors
        tiled = materialise(cut(seen, n, tile, len(names) > 1).drop(*names), "tiles").withColumns(along)
        bounds = materialise(tiled.groupBy("strip", "tile").agg(*ends, F.count("*").alias("_n")), "bounds")
        if bounds.agg(F.max("_n")).first()[0] <= tile:
            break
    return tiled, bounds.drop("_n"), names


def tile_visits(asking: DataFrame, bounds: DataFrame, names: list[str]) -> DataFrame:
    """One row per point of ``asking`` (id, v, tile, axes, ``reach`` or null) and other tile in reach: id, v, reach, home, tile."""
    # the strips' edges on the first axis: as many as the root of the number of tiles
    edges = bounds.groupBy("strip").agg(F.min("lo_p0").alias("lo"), F.max("hi_p0").alias("hi")).orderBy("strip").collect()
    strips, lows, highs = (np.array([e[i] for e in edges]) for i in range(3))

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            r = pdf["reach"] + pdf["slack"]
            first = strips[np.minimum(np.searchsorted(highs, pdf["p0"] - r, side="left"), len(strips) - 1)]
            last = strips[np.maximum(np.searchsorted(lows, pdf["p0"] + r, side="right") - 1, 0)]
            yield pdf.assign(first=first, last=last)

    reach = F.coalesce("reach", F.lit(float("inf")))
    slack = 1e-9 * (1 + F.greatest(*[F.abs(n) for n in names], F.lit(0.0)))  # projections are rounded
    asked = asking.select("id", "v", *names, F.col("tile").alias("home"), reach.alias("reach"), slack.alias("slack"))
    asked = asked.mapInPandas(spans, ", ".join(f"{c} {t}" for c, t in asked.dtypes) + ", first bigint, last bigint")
    asked = asked.filter("first <= last").withColumn("strip", F.explode(F.sequence("first", "last"))).drop("first", "last")
    gap = [F.greatest(F.col(f"lo_{n}") - F.col(n), F.col(n) - F.col(f"hi_{n}"), F.col("slack")) - F.col("slack") for n in names]
    near = sum((g * g for g in gap), F.lit(0.0)) <= (F.col("reach") + F.col("slack")) * (F.col("reach") + F.col("slack"))
    return asked.join(bounds, "strip").filter(near & (F.col("tile") != F.col("home"))).select("id", "v", "reach", "home", "tile")


def nearest(points: DataFrame, k: int, tile: int = TILE) -> DataFrame:
    """(id, nid, dist, place) for the k nearest neighbours of every point. ``points``: id, v array<double>."""
    if points.isEmpty():
        return points.sparkSession.createDataFrame([], PAIRS + ", place bigint")
    points, settled = _split_copies(points, k)
    along = axes_of(points)
    tiled, bounds, names = tiles_of(points, tile, along)

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        vecs, ids, ask = np.stack(pdf["v"].to_numpy()), pdf["id"].to_numpy(), pdf["ask"].to_numpy(dtype=bool)
        if not ask.any():
            return pd.DataFrame({c: [] for c in ("id", "v", "tile", "nids", "dists")})
        found = _best(ids[ask], vecs[ask], ids, vecs, k)
        cuts = np.searchsorted(found.index.to_numpy(), np.arange(1, ask.sum()))
        nids, dists = np.split(found["nid"].to_numpy(np.int64), cuts), np.split(found["dist"].to_numpy(float), cuts)
        return pd.DataFrame({"id": ids[ask], "v": pdf["v"].to_numpy()[ask], "tile": pdf["tile"].to_numpy()[ask], "nids": nids, "dists": dists})

    # the points stay beside what they found, so that no join has to bring both together
    home = materialise(tiled.select("id", "v", "ask", "tile").groupBy("tile").applyInPandas(own, HOME), "near")
    at_home = home.select("id", F.explode(F.arrays_zip("nids", "dists")).alias("_z")).select("id", F.col("_z.nids").alias("nid"), F.col("_z.dists").alias("dist"))
    reach = F.when(F.size("dists") == k, F.col("dists")[k - 1])
    visits = tile_visits(home.select("id", "v", "tile", reach.alias("reach")).withColumns(along), bounds, names)
    visits = visits.withColumn("block", F.floor(F.col("home") / TILES_PER_GROUP))
    # a tile is sent to as few tasks as its visitors need
    before = F.sum("n").over(Window.partitionBy("tile").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    party = F.floor(F.coalesce(before, F.lit(0)) / PARTY).alias("party")
    shares = materialise(visits.groupBy("tile", "block").agg(F.count("*").alias("n")).select("tile", "block", party), "parties")
    asked = visits.join(shares, ["tile", "block"])
    parties = shares.select(F.col("party").alias("host_party"), F.col("tile").alias("host_tile")).distinct()
    residents_of = tiled.select("id", "v", F.col("tile").alias("host_tile")).join(parties, "host_tile")

    def host(key, visitors: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        if visitors.empty or residents.empty:
            return pd.DataFrame({"id": [], "nid": [], "dist": []})
        return _best(
            visitors["id"].to_numpy(),
            np.stack(visitors["v"].to_numpy()),
            residents["id"].to_numpy(),
            np.stack(residents["v"].to_numpy()),
            k,
            visitors["reach"].to_numpy(),
        )

    away = (
        asked.groupBy("party", "tile")
        .cogroup(residents_of.groupBy("host_party", "host_tile"))
        .applyInPandas(host, PAIRS)
    )
    ranked = at_home.unionByName(away).unionByName(settled).withColumn(
        "place", F.row_number().over(Window.partitionBy("id").orderBy("dist", "nid")).cast("bigint")
    )
    return ranked.filter(F.col("place") <= k)
