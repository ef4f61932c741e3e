"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlift.llm.common import query, table

#: Queries in a block, rows in a tile, and per-query lists merged at once.
BLOCK, TILE, FAN_IN = 2048, 8192, 16

_TILE = "pid int, dim int, kind string, ids binary, vectors binary"


def _pack(group: str | None, most: int):
    """Pack rows (id, vec [, group]) into tiles of equal dimension; at most one open tile per dimension and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        open_tiles: dict[tuple[int, int], tuple[list, list]] = {}

        def close(key, ids, vecs):
            m = np.array(vecs, dtype=np.int64).reshape(len(ids), key[1])
            top = int(np.abs(m).max(initial=0))
            kind = "i2" if top < 1 << 15 else "i4" if top < 1 << 31 else "i8"
            cols = [[pid if group is None else key[0]], [key[1]], [kind], [np.array(ids, "i8").tobytes()], [m.astype(kind).tobytes()]]
            types = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["pid", "dim", "kind", "ids", "vectors"])

        for batch in batches:
            groups = batch.column(group).to_pylist() if group else [0] * batch.num_rows
            for g, i, v in zip(groups, batch.column("id").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                ids, vecs = open_tiles.setdefault((g, len(v)), ([], []))
                ids.append(i)
                vecs.append(v)
                if len(ids) == most:
                    yield close((g, len(v)), *open_tiles.pop((g, len(v))))
        for key, (ids, vecs) in open_tiles.items():
            yield close(key, ids, vecs)

    return run


def _unpack(kind: str, dim: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "i8")
    return ids, np.frombuffer(vectors, kind).reshape(len(ids), dim)


def tile_top(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """For every query its k best rows of one tile, as flat (query, id, score); ties go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    bound = max(1, q.shape[1]) * int(np.abs(q.astype("i8")).max(initial=0)) * int(np.abs(rows.astype("i8")).max(initial=0))
    exact = bound * 2 * len(ids) < 1 << 52
    kind = "f8" if exact else "i8"
    score = q.astype(kind) @ rows.astype(kind).T
    if exact:  # one sortable number: the score, then the smaller id
        key = score * len(ids) + np.arange(len(ids) - 1, -1, -1, dtype="f8")
        first, last = np.searchsorted(ids, qid, "left"), np.searchsorted(ids, qid, "right")
        for r in np.flatnonzero(last > first):
            key[r, first[r] : last[r]] = -np.inf
        n = min(k, len(ids))
        best = np.argpartition(-key, n - 1, axis=1)[:, :n]
        keep = np.isfinite(np.take_along_axis(key, best, 1))
        row = np.repeat(np.arange(len(qid)), n).reshape(best.shape)
        return qid[row[keep]], ids[best[keep]], score[row[keep], best[keep]].astype("i8")
    out = []
    for r, own in enumerate(qid):
        best = np.lexsort((ids, -score[r]))
        best = best[ids[best] != own][:k]
        out.append((np.full(len(best), own), ids[best], score[r, best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _products(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qid, q = _unpack(r["q_kind"], r["dim"], r["q_ids"], r["q_vectors"])
                found = tile_top(qid, q, *_unpack(r["kind"], r["dim"], r["ids"], r["vectors"]), k)
                cols = [np.full(len(found[0]), r["pid"], "i4"), *found]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["g", "query_id", "vec_id", "score"])

    return run


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, scale: float = 64.0) -> DataFrame:
    """The k rows of the greatest integer inner product for every query row, exactly.

    Components become floor(scale * x). Queries and rows are packed into blocks and tiles; each pair
    of a block and a tile is one matrix product that keeps the k best of that tile, and the per-query
    lists are merged in a tree of windows. A query's own id is no candidate; ties go to the smaller id.

    Defined cases: a null id, a null vector, or one with null or non-finite components takes no part;
    of rows that share an id the least vector counts; vectors of another length are not compared;
    fewer than k candidates give fewer rows, an empty table none; other columns are ignored.

    Returns query_id, rank (from 1), vec_id, score.
    """
    fine = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = (
        df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & fine)
        .select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"), is_query.alias("asks"))
        .groupBy("id")
        .agg(F.min("vec").alias("vec"), F.max("asks").alias("asks"))
    )
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    tiles, blocks = max(1, -(-n // TILE)), max(1, -(-asked // BLOCK))
    slots = max(1, tiles // FAN_IN)
    spread = F.xxhash64("id")
    asks = (
        rows.where("asks")
        .select("id", "vec", F.pmod(spread, F.lit(blocks)).cast("int").alias("block"))
        .repartition(blocks, "block")
        .mapInArrow(_pack("block", BLOCK), _TILE)
        .select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.col("pid").alias("block"), "dim", F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    )
    held = rows.select("id", "vec").repartition(tiles, "id").mapInArrow(_pack(None, TILE), _TILE).withColumn("slot", F.col("pid") % slots).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    lists = held.join(asks, ["block", "slot", "dim"]).select("pid", "dim", "kind", "ids", "vectors", "q_kind", "q_ids", "q_vectors").mapInArrow(_products(k), "g int, query_id long, vec_id long, score long")
    best = [F.desc("score"), F.asc("vec_id")]
    while tiles > FAN_IN:
        tiles = -(-tiles // FAN_IN)
        lists = lists.withColumn("g", F.floor(F.col("g") / FAN_IN).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "g").orderBy(*best))).where(F.col("rank") <= k).drop("rank")
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query(
    "op7_exact_top_k",
    """
    WITH v AS (
      SELECT vec_id, min([CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding]) AS e
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
      GROUP BY vec_id
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
    ), r AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def exact_top_k(spark, sf_dir):
    """Every row whose id is divisible by 20 against all other rows."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
