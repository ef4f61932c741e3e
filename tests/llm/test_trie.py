"""The prefix trie against a plain one, its slots and its subtree sums."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from stormlift.llm import trie

KINDS = "conv_id long, turn long, role string, text string, words int, digest string"


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in convs.items()}
    built = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4
        family = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = said.get(family, [])[:h] + said[c][h:]
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(p))))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], KINDS)
    return sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=repr)


def some_rows(rng, n):
    texts = ["a b", "a  b", " ", "", None, "c d e", "f\n\tg", "h" * 300]
    rows = []
    for c in range(-30, n):
        if rng.random() < 0.15:
            continue
        for t in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, t if rng.random() < 0.95 else 100 + t, rng.choice(["user", "bot"]) if t else "user", rng.choice(texts[:3] if t < 2 else texts)))
    return rows


def test_equals_plain(spark):
    rows = some_rows(random.Random(3), 150)
    rows += [(1000, None, None, None), (1000, 0, "user", "a b"), (None, 0, "user", "a b"), (2**62, 5, "user", "late"), (1000, 7, "user", "same"), (1000, 7, "user", "same")]
    got = result(spark, rows)
    assert got == plain(rows)
    assert sum(r[3] for r in got if r[1] == 0) == len({r[0] for r in rows if r[0] is not None})
    assert any(r[4] > 3 for r in got) and any(r[6] > 0 for r in got)


def test_turnless_members_and_empty_table(spark):
    lone = next(c for c in range(21, 99) if zlib.crc32(str(c).encode()) % 4 == 2 and c % 20)
    rows = [(lone, 0, "user", "a"), (lone, 1, "user", "b")]
    assert result(spark, rows) == plain(rows)
    assert result(spark, rows)[0][1:6] == (0, None, 1, 0, 1)
    assert result(spark, []) == []


def test_long_conversations_go_in_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 8)
    monkeypatch.setattr(trie, "SHARD_ROWS", 40)
    monkeypatch.setattr(trie, "PIECE_BITS", 2)
    trunk = [(t, "user", f"turn {t} " * (t % 3)) for t in range(60)]
    rows = []
    for c, n in ((20, 60), (40, 60), (60, 41), (80, 8), (100, 7), (120, 9), (41, 25), (140, 16)):
        rows += [(c, *t) for t in trunk[:n]]
    rows += [(160, *t) for t in trunk[:33]] + [(160, 100 + t, "bot", "other") for t in range(20)]
    rows += [(c, 0, "user", "turn") for c in range(200, 400, 20)]
    assert result(spark, rows) == plain(rows)


def test_equal_digests_of_different_prefixes_stop_the_job(spark, monkeypatch):
    monkeypatch.setattr(trie, "_digest", lambda n, depth, sums: trie.F.xxhash64(trie.F.lit(n), depth.cast("long")))
    with pytest.raises(Exception, match="share a digest"):
        result(spark, [(20, 0, "user", "a"), (40, 0, "user", "b")])


def test_slots_are_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 20_000):
        keys = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
        if n > 2:
            keys[: n // 2, 0] = keys[0, 0]  # keys that differ in one half only
        slots = trie.Slots(keys)
        assert sorted(slots.of(keys).tolist()) == list(range(n))
        assert (slots.keys[slots.of(keys)] == keys).all()
        strange = rng.integers(0, 1 << 63, (100, 2), dtype=np.uint64)
        assert (slots.of(strange) == -1).all()
    with pytest.raises(ValueError):
        trie.Slots(np.ones((2, 2), np.uint64))


def test_accumulate_adds_up_subtrees():
    parent = np.array([-1, 0, 0, 1, 1, 3])
    depth = np.array([0, 1, 1, 2, 2, 3])
    got = trie.accumulate(parent, depth, np.array([[1], [2], [4], [8], [16], [32]]))
    assert got[:, 0].tolist() == [63, 58, 4, 40, 16, 32]
