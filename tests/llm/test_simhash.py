"""SimHash against brute force: every pair, and fingerprints placed at given distances."""

import random

import numpy as np
import xxhash

from stormlift.llm import simhash
from stormlift.llm.components import components


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, most=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_golay_decoding():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    numbers = simhash.decode(words)
    code = {}
    for n in range(1 << 12):  # a codeword decodes to itself; its distance to the word is three at most
        code.setdefault(int(simhash.decode(np.array([n << 11]))[0]), []).append(n)
    _, pattern = simhash._errors()
    assert max(int(p).bit_count() for p in pattern) == 3 and len(set(pattern.tolist())) == 1 << 11
    for a in range(23):
        for b in range(23):
            flipped = words ^ (1 << a) ^ (0 if a == b else 1 << b)
            shared = [set(x) & set(y) for x, y in zip(simhash.near_keys(words).tolist(), simhash.near_keys(flipped).tolist(), strict=True)]
            assert all(shared)
    assert ((numbers >= 0) & (numbers < 1 << 12)).all()


def test_keys_cover_every_error_pattern():
    rng = random.Random(3)
    base = np.array([rng.getrandbits(64) for _ in range(40)], dtype=np.uint64)
    for _ in range(400):
        flips = rng.sample(range(64), rng.randrange(5))
        other = base ^ np.uint64(sum(1 << f for f in flips))
        r1, k1 = simhash.keys(base.view(np.int64))
        r2, k2 = simhash.keys(other.view(np.int64))
        one, two = set(zip(r1.tolist(), k1.tolist(), strict=True)), set(zip(r2.tolist(), k2.tolist(), strict=True))
        assert {r for r, _ in one & two} == set(range(40))


def given(rng):
    words = ["the", "Of", "to", "ÉA", "and", "x", "tion", "er"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(60, 90))) for _ in range(15)]
    texts = [None, "", " \n", "one", "one two", "A b c", "a B c"] + base + base[:3]
    for b in base * 4:
        w = b.split(" ")
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(rng.choice([" ", "\t", "\n"]).join(w))
    return texts


def test_components_equal_brute_force(spark):
    texts = given(random.Random(11))
    df = spark.createDataFrame([(i * 3, t, "f", 0) for i, t in enumerate(texts)], "doc_id long, text string, fp string, key int")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    roots = plain_components(prints)
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, i), i)
    assert got == {i * 3: (f"{p:016x}", least[r] * 3) for i, (p, r) in enumerate(zip(prints, roots, strict=True))}


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(4)
    centre = [rng.getrandbits(64) for _ in range(3)]
    prints = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for c in centre for _ in range(120)})
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    rows = found.collect()
    assert all(((r["u"] ^ r["v"]) & (2**64 - 1)).bit_count() <= 4 for r in rows)
    root = {r["node"]: r["root"] for r in components(found).collect()}
    want = plain_components(prints)
    got = [root.get(x, x) for x in signed]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (5, "zz"), (5, "zz")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == [(5, 5), (5, 5), (None, None), (None, None)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
