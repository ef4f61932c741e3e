"""Embedding whitening by a block Jacobi-Davidson method over distributed, matrix-free products.

The covariance is never formed. A product sends a block of vectors to the tasks, each multiplies its
centred rows with them and back, and the sums come home: as many numbers as the block has, whatever
the table's size. On the driver a search space of a few blocks gives Ritz pairs; those with a residual
of double precision are locked, the others are corrected by the Jacobi-Davidson equation, projected
away from locked and current vectors and solved roughly by MINRES, all columns in step, so that one
product serves the whole block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlift.llm.common import keep, query, table

#: Entries become floor(SCALE * c) + SHIFT; beyond MOST in size they count as MOST.
SCALE, SHIFT, MOST = 64.0, 1_000_000, 1 << 52
#: Components asked for, vectors that guard the last of them, blocks of the search space, inner steps, outer steps.
COMPONENTS, GUARD, SPACE, INNER, OUTER = 16, 4, 5, 8, 300
#: Rows of a packed block, and partial sums that one task or the driver adds up.
PACK, FAN_IN = 4096, 64


# --- the rows ------------------------------------------------------------------------------


def integer_rows(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, x) of the rows that take part."""
    fine = F.forall(F.col(vec_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))

    def entry(c):
        scaled = F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(MOST))), F.lit(float(-MOST))))
        return scaled.cast("long") + SHIFT

    return df.where(F.col(vec_col).isNotNull() & fine).select(F.col(id_col).alias("id"), F.transform(F.col(vec_col), entry).alias("x"))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dim)


def _pack(dim: int):
    """Rows as blocks of PACK, each one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["rows"])

        for batch in batches:
            if batch.num_rows:
                held.append(_matrix(batch.column("x"), dim))
                n += batch.num_rows
            if n >= PACK:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for raw in batch.column("sums").to_pylist():
            part = np.frombuffer(raw, np.longdouble)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def summed(blocks: DataFrame, of: Callable[[np.ndarray], np.ndarray], dim: int, shape: tuple) -> np.ndarray:
    """The sum of ``of(block)`` over all blocks, in extended precision; partial sums are added up in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("rows").to_pylist():
                part = of(np.frombuffer(raw, np.int64).reshape(-1, dim)).astype(np.longdouble)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts, n = blocks.mapInArrow(run, "sums binary"), blocks.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = parts.repartition(n).mapInArrow(_added, "sums binary")
    total = np.zeros(int(np.prod(shape)), np.longdouble)
    for row in parts.collect():  # FAN_IN rows at most
        total = total + np.frombuffer(row["sums"], np.longdouble)
    return total.reshape(shape)


class Cloud:
    """The fit list: each distinct vector once, packed, with its size and exact sums."""

    def __init__(self, rows: DataFrame, dim: int):
        distinct = rows.select("x").distinct()
        self.dim = dim
        self.blocks = keep(distinct.mapInArrow(_pack(dim), "rows binary"), "cloud")
        width = dim * 8
        sizes = self.blocks.agg(F.sum(F.octet_length("rows"))).first()[0]
        self.n = int(sizes or 0) // width
        self.sums = self._exact_sums()
        whole = [divmod(s, self.n) for s in self.sums] if self.n else []
        self.base = np.array([q for q, _ in whole], np.int64)  # x - S/n as (x - base) - rest/n: no digit is lost
        self.rest = np.array([r / self.n for _, r in whole])

    def _exact_sums(self) -> list[int]:
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [0] * dim
            for batch in batches:
                for raw in batch.column("rows").to_pylist():
                    x = np.frombuffer(raw, np.int64).reshape(-1, dim)  # PACK entries below 2^53 could pass a long
                    part = (x >> 20).sum(axis=0).astype(object) * (1 << 20) + (x & (1 << 20) - 1).sum(axis=0).astype(object)
                    total = [a + int(b) for a, b in zip(total, part, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["at", "s"])

        found = self.blocks.mapInArrow(run, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).collect()  # a row a dimension
        sums = [0] * dim
        for row in found:
            sums[row["at"]] = int(row["s"])
        return sums

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        base, rest = self.base, self.rest
        return lambda x: (x - base).astype(float) - rest

    def times(self, v: np.ndarray) -> np.ndarray:
        """The covariance times a block of vectors (dim, columns)."""
        centred = self.centred()

        def product(x: np.ndarray) -> np.ndarray:
            y = centred(x)
            return y.T @ (y @ v)

        return (summed(self.blocks, product, self.dim, v.shape) / self.n).astype(float)

    def trace(self) -> float:
        centred = self.centred()
        return float(summed(self.blocks, lambda x: (centred(x) ** 2).sum(axis=0), self.dim, (self.dim,)).sum() / self.n)

    def identity_error(self, v: np.ndarray, scale: np.ndarray) -> float:
        """The largest entry of the whitened rows' covariance less the identity; the mean is taken first."""
        centred, k = self.centred(), v.shape[1]

        def white(x: np.ndarray) -> np.ndarray:
            return centred(x) @ v / scale

        mean = (summed(self.blocks, lambda x: white(x).sum(axis=0), self.dim, (k,)) / self.n).astype(float)

        def spread(x: np.ndarray) -> np.ndarray:
            w = white(x) - mean
            return w.T @ w

        return float(np.abs(summed(self.blocks, spread, self.dim, (k, k)) / self.n - np.eye(k)).max(initial=0))


# --- the eigenvectors ----------------------------------------------------------------------


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """``new`` without what lies in ``against``, orthonormal; directions that vanish are left out."""
    new = new / np.maximum(np.linalg.norm(new, axis=0), np.finfo(float).tiny)
    for _ in range(3):
        for q in against:
            new = new - q @ (q.T @ new)
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-8 * max(1.0, s[0] if len(s) else 1.0)]
        if not new.shape[1]:
            break
    return new


def minres(times: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, b: np.ndarray, steps: int, cut: float = 0.05) -> np.ndarray:
    """Columns t with (A - shift) t near b, by Lanczos and Givens rotations; every column has its own recurrence.

    Ends after ``steps`` products, or when every residual has fallen to ``cut`` of its start. A column
    whose Krylov space is exhausted stays as it is.
    """
    beta = np.linalg.norm(b, axis=0)
    start = np.maximum(beta, np.finfo(float).tiny)
    v_old, v = np.zeros_like(b), b / start
    w_old, w, t = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    eta, c_old, c, s_old, s = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    live = beta > 0
    for _ in range(steps):
        if not live.any():
            break
        av = times(v) - v * shifts
        alpha = (v * av).sum(axis=0)
        nxt = av - v * alpha - v_old * beta
        beta_new = np.linalg.norm(nxt, axis=0)
        delta = c * alpha - c_old * s * beta
        rho1, rho2, rho3 = np.hypot(delta, beta_new), s * alpha + c_old * c * beta, s_old * beta
        ok = live & (rho1 > 1e-14 * np.abs(shifts).max(initial=1.0))
        safe = np.where(ok, rho1, 1.0)
        c_new, s_new = delta / safe, beta_new / safe
        w_new = (v - w_old * rho3 - w * rho2) / safe
        t = t + np.where(ok, c_new * eta, 0.0) * w_new
        eta = np.where(ok, -s_new * eta, eta)
        v_old, v = v, nxt / np.maximum(beta_new, np.finfo(float).tiny)
        w_old, w = w, np.where(ok, w_new, w)
        c_old, c, s_old, s, beta = c, c_new, s, s_new, beta_new
        live = ok & (beta_new > 1e-14 * np.abs(shifts).max(initial=1.0)) & (np.abs(eta) > cut * start)
    return t


def jacobi_davidson(times: Callable[[np.ndarray], np.ndarray], dim: int, k: int, inner: int = INNER, space: int = SPACE, outer: int = OUTER) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a positive semi-definite operator, falling, and their unit vectors, to double precision.

    Residuals of locked pairs, each measured with a product of its own, are at most 16 sqrt(dim) units of
    double precision of the largest eigenvalue. Signs are such that the entry of the largest size is positive.
    """
    k = min(k, dim)
    width = min(dim, k + GUARD)
    u = _orthonormal(np.random.default_rng(11).standard_normal((dim, width)))
    au = times(u)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    for _ in range(outer):
        h = u.T @ au
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        u, au = u @ s, au @ s
        top = max(values.max(initial=0.0), theta.max(initial=0.0))
        allowed = 8 * np.sqrt(dim) * np.finfo(float).eps * max(top, np.finfo(float).tiny)
        want = min(width, k - locked.shape[1] + GUARD, u.shape[1])
        x = u[:, :want]
        residual = au[:, :want] - x * theta[:want]
        residual -= locked @ (locked.T @ residual)
        small = np.linalg.norm(residual, axis=0) <= allowed
        ready = int(np.argmin(np.append(small, False)))  # locked in order, so that none is left out
        if ready:
            fresh = times(x[:, :ready])  # measured anew, not from the sums that restarts carry along
            theta_new = (x[:, :ready] * fresh).sum(axis=0)
            good = np.linalg.norm(fresh - x[:, :ready] * theta_new, axis=0) <= 2 * allowed
            ready = int(np.argmin(np.append(good, False)))
            au[:, : good.size] = fresh
            locked = np.concatenate([locked, x[:, :ready]], axis=1)
            values = np.concatenate([values, theta_new[:ready]])
            u, au, x, residual, theta = u[:, ready:], au[:, ready:], x[:, ready:], residual[:, ready:], theta[ready:]
        if locked.shape[1] >= k or not u.shape[1]:
            break
        if u.shape[1] + x.shape[1] > max(space * width, width + 1) and u.shape[1] < dim - locked.shape[1]:
            u = u[:, : 2 * width]  # restart with the best Ritz vectors
            u = _orthonormal(u, locked)
            au = times(u)
        q = np.concatenate([locked, x], axis=1)

        def projected(v: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            v = v - q @ (q.T @ v)
            v = times(v)
            return v - q @ (q.T @ v)

        if u.shape[1] + locked.shape[1] < dim:
            rest = residual - q @ (q.T @ residual)
            wanted = np.linalg.norm(rest, axis=0) > allowed / 4
            t = minres(projected, theta[: x.shape[1]][wanted], -rest[:, wanted], inner) if wanted.any() else np.zeros((dim, 0))
            t = np.concatenate([t, rest[:, wanted]], axis=1) if t.shape[1] and not np.isfinite(t).all() else t
            t = _orthonormal(np.nan_to_num(t), locked, u)[:, : dim - u.shape[1] - locked.shape[1]]
            if not t.shape[1]:
                t = _orthonormal(np.random.default_rng(u.shape[1]).standard_normal((dim, 1)), locked, u)
            u, au = np.concatenate([u, t], axis=1), np.concatenate([au, times(t)], axis=1)
        else:
            au = times(u)  # the space is whole: only rounding is left
    else:
        raise RuntimeError(f"{locked.shape[1]} of {k} eigenvectors after {outer} steps")
    order = np.argsort(-values, kind="stable")[:k]  # guards may have been locked too
    vectors = locked[:, order] / np.linalg.norm(locked[:, order], axis=0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if vectors.size else np.ones(0)
    return values[order], vectors * signs


# --- whitening -----------------------------------------------------------------------------


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The whitened coordinates of every row, one row for each component.

    Vectors become integers, floor(64 c) + 1000000. The covariance is over each distinct vector once, with
    divisor n, from centred rows; its leading unit eigenvectors are found to double precision.

    Defined cases: null vectors and such with null or non-finite entries are dropped; vectors of another
    length than the longest take no part; entries beyond 2^46 in size count as 2^46; repeated vectors
    count once in the fit, every row is returned; rows without an id, or that share one, keep their rows;
    components without variance (their eigenvalue is zero within rounding) have no rows, so neither has a
    table of fewer than two distinct vectors; other columns are ignored.

    Returns the id column, component (from 1), n, deviation (decimal: sum over dimensions of (n x - S)^2,
    exact), whitened, explained (share of the trace), identity_error.
    """
    rows = keep(integer_rows(df, id_col, vec_col), "integers")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.where(F.size("x") == dim)
    cloud = Cloud(rows, dim) if dim else None
    trace = cloud.trace() if cloud and cloud.n > 1 else 0.0
    if not trace > 0:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    values, vectors = jacobi_davidson(cloud.times, dim, components)
    real = values > 1e-12 * values[0]
    values, vectors = values[real], vectors[:, real]
    scale = np.sqrt(values)
    error, n, k = cloud.identity_error(vectors, scale), cloud.n, len(values)
    centred, base = cloud.centred(), cloud.base
    offset = [s - n * int(b) for s, b in zip(cloud.sums, base.tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        off = np.array(offset, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), dim)
            white = centred(x) @ vectors / scale
            near = x - base
            if dim * (n * (int(np.abs(near).max()) + 1)) ** 2 < 1 << 63:
                deviation = ((n * near - off) ** 2).sum(axis=1).tolist()
            else:
                deviation = [sum((n * a - b) ** 2 for a, b in zip(row, offset, strict=True)) for row in near.tolist()]
            at = np.repeat(np.arange(len(x)), k)
            deviation = pa.array([Decimal(d) if d < 10**38 else None for d in deviation], pa.decimal128(38, 0))
            cols = [
                batch.column("id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), n)),
                deviation.take(pa.array(at)), pa.array(white.ravel()), pa.array(np.tile(values / trace, len(x))), pa.array(np.full(len(at), error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


@query("op12_embedding_whitening")
def embedding_whitening(spark, sf_dir):
    """No SQL for eigenvectors; tested against a dense solver. A deviation beyond a long is null."""
    found = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
