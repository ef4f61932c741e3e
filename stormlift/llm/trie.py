"""Conversation prefix trie over a table of nodes with minimal-perfect-hash slots.

A prefix is named by a 128-bit digest made of running sums along its conversation, so that even a
conversation of a third of all turns is cut over many tasks. Distinct digests are the nodes; one
aggregation gives what can be counted per node. What must be summed over subtrees is summed in
shards: a shard holds whole paths of some conversations (long ones in blocks of turns), gives every
distinct digest a slot by a minimal perfect hash, scatters the values of the nodes that its
conversations own (the smallest member owns a node) into flat arrays and accumulates them through
an array of parent slots, deepest first. Each node is owned once, so the shards' arrays add up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlift.llm.common import keep, query, table, text_of
from stormlift.operators.ordered import running

#: Turns of one conversation that stay together, path rows of a shard, conversation ids of one joined piece: 2 to this power.
BLOCK, SHARD_ROWS, PIECE_BITS = 1 << 16, 200_000, 10
#: Conversations of one family take up the turns of the family's first.
FAMILY, MOST_SHARED = 20, 3

_NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- slots ---------------------------------------------------------------------------------


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    h = keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(level * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Slots:
    """A minimal perfect hash of distinct 128-bit keys (n, 2): each gets its own slot from 0 to n - 1.

    Level by level the keys that fall alone on a place of a bit array take it, the others go on to the
    next. The keys themselves stand at their slots, so that a lookup is verified against all 128 bits.
    """

    def __init__(self, keys: np.ndarray, spread: float = 1.5, most_levels: int = 64):
        self.levels: list[np.ndarray] = []  # slot of every place, -1 where nobody stands alone
        self.keys = np.zeros_like(keys)
        left, used = keys, 0
        while len(left):
            if len(self.levels) == most_levels:
                raise ValueError("two keys are equal: a perfect hash needs distinct ones")
            at = (_mixed(left, len(self.levels)) % np.uint64(max(8, int(spread * len(left))))).astype(np.int64)
            count = np.bincount(at, minlength=max(8, int(spread * len(left))))
            slot = np.full(len(count), -1, np.int64)
            places = np.flatnonzero(count == 1)
            slot[places] = used + np.arange(len(places))
            alone = count[at] == 1
            self.keys[slot[at[alone]]] = left[alone]
            self.levels.append(slot)
            left, used = left[~alone], used + len(places)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys; -1 for keys that the table does not hold."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, slot in enumerate(self.levels):
            if not len(left):
                break
            found = slot[(_mixed(keys[left], level) % np.uint64(len(slot))).astype(np.int64)]
            out[left] = found
            left = left[found < 0]
        known = out >= 0
        out[known] = np.where((self.keys[out[known]] == keys[known]).all(axis=1), out[known], -1)
        return out


def accumulate(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of ``values`` (slots, columns): every depth, deepest first, is added to its parents' slots; -1 has none."""
    total = values.copy()
    order = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for at in reversed(np.split(order, cuts)):
        at = at[parent[at] >= 0]
        np.add.at(total, parent[at], total[at])
    return total


# --- digests -------------------------------------------------------------------------------


def _lanes(depth: Column, a: Column, b: Column) -> list[Column]:
    """Four 32-bit hashes of a turn at its depth; running sums of them stay within a long for two billion turns."""
    out = []
    for n in (1, 2):
        h = F.xxhash64(F.lit(n), depth, a, b)
        out += [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]
    return out


def _digest(n: int, depth: Column, sums: list[Column]) -> Column:
    return F.xxhash64(F.lit(n), depth.cast("long"), *(s.cast("long") for s in sums))


def turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, a, b, words) of every row with a conversation: two hashes of role and text, and the text's words. Texts travel no further."""
    role, text = text_of(role_col), text_of(text_col)
    return df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit("turn"), text, role).alias("b"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def rebuilt(said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first h turns of their family's first, then their own after the first h; h is crc32 of the id mod 4.

    Takes (conv, turn, a, b, words); returns (conv, depth from 1, a, b, words) and all ids (conv).
    """
    placed = running(said, ["conv"], ["turn", "a", "b"], {"pos": F.lit(1)})  # pos from 1
    placed = keep(placed.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % 4), "turns")
    first = F.col("conv") % FAMILY == 0
    family = F.col("conv") - F.col("conv") % FAMILY
    convs = placed.where(F.col("pos") == 1).select("conv", "h", "pos_total")
    lengths = convs.where(first).select(F.col("conv").alias("family"), F.least("pos_total", F.lit(MOST_SHARED)).alias("had"))
    young = convs.where(~first).withColumn("family", family).join(lengths, "family", "left")
    young = young.select("conv", "h", "family", F.least("h", F.coalesce("had", F.lit(0))).alias("taken"))
    heads = placed.where(first & (F.col("pos") <= MOST_SHARED)).select(F.col("conv").alias("family"), F.col("pos").alias("depth"), "a", "b", "words")
    copied = young.join(heads, "family").where(F.col("depth") <= F.col("h")).select("conv", "depth", "a", "b", "words")
    own = placed.where(~first & (F.col("pos") > F.col("h"))).join(young.select("conv", "taken"), "conv")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "a", "b", "words")
    whole = placed.where(first).select("conv", F.col("pos").alias("depth"), "a", "b", "words")
    return whole.unionByName(copied).unionByName(own), convs.select("conv")


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv, depth, d1, d2, e1, e2, words, turns, proof): the digest of every prefix and of the prefix before it.

    ``proof`` hashes the parent's digest with the last turn: prefixes of one digest must agree in it.
    """
    lanes = _lanes(F.col("depth"), F.col("a"), F.col("b"))
    names = [f"p{k}" for k in range(4)]
    summed = running(rows, ["conv"], ["depth"], {**dict(zip(names, lanes, strict=True)), "turns": F.lit(1)})
    here = [F.col(n) for n in names]
    before = [F.col(n) - x for n, x in zip(names, lanes, strict=True)]
    out = summed.select(
        "conv", "depth", "words", F.col("turns_total").alias("turns"), "a", "b",
        *(_digest(n, F.col("depth"), here).alias(f"d{n}") for n in (1, 2)),
        *(_digest(n, F.col("depth") - 1, before).alias(f"e{n}") for n in (1, 2)),
    )
    return out.select("conv", "depth", "d1", "d2", "e1", "e2", "words", "turns", F.xxhash64("depth", "e1", "e2", "a", "b").alias("proof"))


# --- subtree sums --------------------------------------------------------------------------

_SUMS = ("children", "leaves", "saved")


def _shard(block: int):
    """Sums over subtrees of what the shard's conversations own, for every digest of the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        col = {n: np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in held]) for n in held[0].schema.names if n != "shard"}
        held.clear()
        path = ~col["carry"].astype(bool)
        own = np.stack([col["d1"], col["d2"]], axis=1).view(np.uint64)[path]
        up = np.stack([col["e1"], col["e2"]], axis=1).view(np.uint64)[path]
        depth, owned = col["depth"][path], col["owned"][path].astype(bool)
        tops = depth == 1
        keys = np.concatenate([own, up[tops][:1]])  # the root of all paths, if any begins here
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys = keys[order[np.concatenate([[True], (keys[order][1:] != keys[order][:-1]).any(axis=1)])]] if len(keys) else keys
        slots = Slots(keys)
        at = slots.of(own)
        parent = np.full(len(keys), -1, np.int64)
        at_depth = np.zeros(len(keys), np.int64)
        at_depth[at] = depth
        inside = depth % block != 0  # a block's first turn hangs on another shard
        parent[at[inside]] = slots.of(up[inside])
        if (at < 0).any() or (parent[at[inside]] < 0).any():
            raise ValueError("a path of the shard is broken")
        values = np.zeros((len(keys), 2), np.int64)
        values[at[owned], 0], values[at[owned], 1] = col["leaf"][path][owned], col["saved"][path][owned]
        children = np.zeros(len(keys), np.int64)
        if (~path).any():  # what lies below the block's last turn
            last = depth % block == block - 1
            place = {(c, d): s for c, d, s in zip(col["conv"][path][last].tolist(), depth[last].tolist(), at[last].tolist(), strict=True)}
            for c, d, leaf, saved in zip(*(col[n][~path].tolist() for n in ("conv", "depth", "leaf", "saved")), strict=True):
                values[place[c, d]] += (leaf, saved)
        np.add.at(children, parent[at[owned & inside]], 1)
        total = accumulate(parent, at_depth, values)
        some = np.flatnonzero(total.any(axis=1) | (children > 0))
        over = up[owned & ~inside]  # parents in another shard learn of a child
        found = np.concatenate([slots.keys[some], over]).view(np.int64)
        none = np.zeros(len(over), np.int64)
        cols = [found[:, 0], found[:, 1], np.concatenate([children[some], none + 1]), np.concatenate([total[some, 0], none]), np.concatenate([total[some, 1], none])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["d1", "d2", *_SUMS])

    return run


def subtree_sums(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(d1, d2, children, leaves, saved) from nodes with their owners and the prefixes of all conversations."""
    zero, no = F.lit(0).cast("long"), F.lit(False)
    own = nodes.select("conv", "depth", "d1", "d2", "e1", "e2", F.lit(True).alias("owned"), F.col("leaf").cast("long").alias("leaf"), "saved", no.alias("carry"))
    since = nodes.groupBy("conv").agg(F.min("depth").alias("since"))
    shared = rows.join(since, "conv").where(F.col("depth") < F.col("since"))
    shared = shared.select("conv", "depth", "d1", "d2", "e1", "e2", no.alias("owned"), zero.alias("leaf"), zero.alias("saved"), no.alias("carry"))
    block = F.floor(F.col("depth") / BLOCK)
    below = own.where(F.col("depth") >= BLOCK).groupBy("conv", block.alias("block")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    down = Window.partitionBy("conv").orderBy(F.desc("block"))  # a row for each block of 65,536 turns
    starts = rows.where((F.col("depth") >= BLOCK) & (F.col("depth") % BLOCK == 0)).join(since, "conv").select("conv", F.floor(F.col("depth") / BLOCK).alias("block"))
    below = starts.join(below, ["conv", "block"], "left").na.fill(0, ["leaf", "saved"])
    carry = below.select("conv", (F.col("block") * BLOCK - 1).alias("depth"), *(zero.alias(c) for c in ("d1", "d2", "e1", "e2")), no.alias("owned"), F.sum("leaf").over(down).alias("leaf"), F.sum("saved").over(down).alias("saved"), F.lit(True).alias("carry"))
    paths = keep(own.unionByName(shared).unionByName(carry), "paths")
    shards = max(1, -(-paths.count() // SHARD_ROWS))
    dealt = paths.repartition(shards, "conv", F.floor(F.col("depth") / BLOCK))
    kinds = "d1 long, d2 long, " + ", ".join(f"{c} long" for c in _SUMS)
    return dealt.mapInArrow(_shard(BLOCK), kinds).groupBy("d1", "d2").agg(*(F.sum(c).alias(c) for c in _SUMS))


# --- ends ----------------------------------------------------------------------------------


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 a node over its pieces, which arrive in order; only the running hash is held."""
    node, hashed, out = None, None, []
    for batch in batches:
        for d1, d2, piece in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "piece")), strict=True):
            if (d1, d2) != node:
                if node is not None:
                    out.append((*node, hashed.hexdigest()))
                node, hashed = (d1, d2), hashlib.sha256(piece.encode())
            else:
                hashed.update(b"," + piece.encode())
        if len(out) >= 10_000:
            yield _as_batch(out)
            out = []
    if node is not None:
        out.append((*node, hashed.hexdigest()))
    yield _as_batch(out)


def _as_batch(found: list) -> pa.RecordBatch:
    cols = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string())]
    return pa.RecordBatch.from_arrays(cols, names=["d1", "d2", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of (d1, d2, conv): the ids ascending, comma-joined. Ids are joined in pieces of a
    thousand neighbours first, so that the task that must hash one node's list in order reads few rows."""
    pieces = ends.groupBy("d1", "d2", F.shiftright("conv", PIECE_BITS).alias("no")).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("piece"))
    return pieces.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "no").mapInArrow(_end_hashes, "d1 long, d2 long, ends_sha256 string")


# --- the trie ------------------------------------------------------------------------------


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, the empty one included.

    Turns stand in order of their number, those without one first; equal numbers in the order of a hash
    of role and text. A conversation starts with the first h turns of its family's first conversation
    (its id less its id mod 20; all turns if there are fewer, none without it), h being crc32 of
    its id mod 4, and goes on with its own turns after the first h.

    Defined cases: rows without a conversation id take no part; null roles and texts are empty ones, and
    no other column is read; repeated rows are turns of their own; a conversation without a turn left is
    a member of the root only; an empty table has no node, not even a root. Two different prefixes of one
    128-bit digest would stop the job (checked for every node and in every shard).

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rows, convs = rebuilt(turns(df, conv_col, turn_col, role_col, text_col))
    rows = keep(prefixes(rows), "prefixes")
    found = rows.groupBy("d1", "d2").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("e1").alias("e1"), F.min("e2").alias("e2"),
        F.min("words").alias("words"), (F.max("turns") == F.min("depth")).alias("leaf"), F.min("proof").alias("proof"), F.max("proof").alias("other"),
    )
    sound = F.when(F.col("proof") == F.col("other"), F.col("conv")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("long"))
    nodes = keep(found.select(sound.alias("conv"), "n_convs", "depth", "d1", "d2", "e1", "e2", "leaf", ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "nodes")
    top = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where(F.col("n_convs") > 0)
    zeros = [F.lit(0).cast("long")] * 4
    root = [_digest(n, F.lit(0), zeros).alias(f"d{n}") for n in (1, 2)]
    silent = convs.join(rows.where(F.col("depth") == 1).select("conv"), "conv", "left_anti").select(*root, "conv")
    ends = end_hashes(rows.where(F.col("depth") == F.col("turns")).select("d1", "d2", "conv").unionByName(silent))
    owners = nodes.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("conv").alias("parent"))
    least = convs.agg(F.min("conv")).scalar()
    deep = nodes.where(F.col("depth") > 1).join(owners, ["e1", "e2"], "left")
    shallow = nodes.where(F.col("depth") == 1).withColumn("parent", least)
    start = top.select("conv", "n_convs", F.lit(0).cast("long").alias("depth"), *root, F.lit(None).cast("long").alias("parent"))
    named = [n.select("conv", "n_convs", "depth", "d1", "d2", "parent") for n in (deep, shallow, start)]
    out = named[0].unionByName(named[1]).unionByName(named[2]).join(subtree_sums(nodes, rows), ["d1", "d2"], "left").join(ends, ["d1", "d2"], "left")
    children = F.coalesce("children", F.lit(0))
    return out.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        children.alias("n_children"),
        F.when(children == 0, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )


#: CRC-32 bit by bit: eight steps a character of the decimal id.
_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""

SQL = f"""
WITH said AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
         {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv_id, {_CRC} % 4 AS h, conv_id - conv_id % 20 AS family, list(said ORDER BY pos) AS own
  FROM said GROUP BY conv_id
), built AS (
  SELECT c.conv_id, list_concat(coalesce(f.own, [])[1:c.h], c.own[c.h + 1:]) AS path FROM conv c LEFT JOIN conv f ON f.conv_id = c.family
), member AS (
  SELECT conv_id, d AS depth, path[1:d] AS prefix, len(path) = d AS ends FROM built, unnest(range(0, len(path) + 1)) AS u(d)
), node AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
         CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(prefix[-1].text, '[^\\x20\\x09-\\x0D]+')) END AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM member GROUP BY depth, prefix
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM node k WHERE k.depth = n.depth + 1 AND k.prefix[1:n.depth] = n.prefix) AS n_children
  FROM node n LEFT JOIN node p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
), beneath AS (
  SELECT a.depth, a.prefix, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved
  FROM linked a JOIN linked b ON b.depth >= a.depth AND b.prefix[1:a.depth] = a.prefix GROUP BY a.depth, a.prefix
)
SELECT conv_id, CAST(l.depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM linked l JOIN beneath USING (depth, prefix)
"""


@query("op13_prefix_trie", SQL)
def trie(spark, sf_dir):
    """Every node of the trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
