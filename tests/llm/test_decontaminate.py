"""Greedy string tiling against a naive version, and contamination against all pairs."""

import random
import re

import numpy as np

from stormlift.llm import decontaminate as dc
from stormlift.llm.bloom import Bloom


def naive_tiles(item, doc, shortest):
    used_a, used_b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not used_a[i + n] and not used_b[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < shortest:
            return out
        for k in range(n):
            used_a[i + k] = used_b[d + k] = True
        out.append((i, d, n))


def test_tiles_equal_naive():
    rng = random.Random(1)
    for _ in range(300):
        item = [rng.choice("abc") for _ in range(rng.randrange(0, 15))]
        doc = [rng.choice("abcd") for _ in range(rng.randrange(0, 25))]
        k = rng.choice([1, 2, 3])
        assert dc.tiles(item, doc, k) == naive_tiles(item, doc, k)


def plain_words(text):
    folded = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", folded)


def plain_judge(text, items, least_words=5):
    doc, found = plain_words(text), {}
    least = {}
    for i, t in items:
        key = t or ""
        least[key] = i if key not in least or (i is not None and (least[key] is None or i < least[key])) else least[key]
    for t, i in least.items():
        w = plain_words(t)
        if len(w) < least_words:
            continue
        share = sum(x[2] for x in naive_tiles(w, doc, 3)) / len(w)
        if share >= 0.8:
            found[i] = share
    return len(found), sorted(i for i in found if i is not None), max(found.values(), default=0.0)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["the", "of", "and", "to", "tion", "ing", "er", "éa", "ßch", "12", "Wh", "on", "ly", "st"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", "!!"]) for _ in range(n)) + "."
    items = [(i, " ".join(sentence(rng.randrange(2, 9)) for _ in range(4))) for i in range(12)] + [(50, "too short"), (51, None), (52, ""), (None, sentence(9))]
    items += [(60, items[0][1]), (61, items[0][1] + " and more")]
    docs = [(100, None), (101, ""), (102, "!!! ..."), (103, sentence(400))]
    for n in range(60):
        _, passage = items[rng.randrange(len(items))]
        parts = re.findall(r"[^.]+\.", passage or "") or [""]
        how = rng.randrange(4)
        if how == 0:
            rng.shuffle(parts)
        elif how == 1:
            parts = parts[: len(parts) // 2]
        elif how == 2:
            parts = [p.upper() for p in parts]
        docs.append((n, sentence(rng.randrange(1, 30)) + "\n" + " ".join(parts) + " " + sentence(rng.randrange(1, 30))))
    docs += [(200, docs[10][1]), (200, docs[10][1]), (None, docs[11][1])]
    df = spark.createDataFrame([(i, t, 1, "d") for i, t in docs], "doc_id long, text string, item int, digest string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["contaminated"], r["n_items"], [x for x in r["item_ids"]], round(r["coverage"], 9)) for r in dc.contamination(df, bench).collect()), key=repr)
    want = []
    for i, t in docs:
        n, found, share = plain_judge(t, items)
        want.append((i, n > 0, n, found, round(share, 9)))
    assert sum(w[1] for w in want) > 15
    assert got == sorted(want, key=repr)
    clean = dc.without_benchmark(df, bench)
    assert clean.columns == df.columns
    bad = {g[0] for g in got if g[1]}
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted((i for i, _ in docs if i not in bad), key=repr)


def test_pairs_without_a_five_word_seed(spark):
    words = [f"w{i}" for i in range(15)]
    changed = [f"x{i}" if i in (3, 7, 11) else w for i, w in enumerate(words)]
    pieces = [words[k : k + 3] for k in (9, 3, 12, 0, 6)]
    half = [w if i % 5 < 3 else "x" for i, w in enumerate(words)]
    docs = [(1, " ".join(changed)), (2, " gap ".join(" ".join(p) for p in pieces)), (3, " ".join(half)), (4, "w0 w1 w2 y w4 w5 w6 w7")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words)), (8, "w0 w1 w2 w3")], "item_id long, text string")
    want = []
    for i, t in docs:
        share = sum(x[2] for x in naive_tiles(words, t.split(), 3)) / 15
        want.append((i, share >= 0.8, [7] if share >= 0.8 else []))
    assert [w[1] for w in want] == [True, True, False, False]
    assert sorted((r["doc_id"], r["contaminated"], r["item_ids"]) for r in dc.contamination(df, bench).collect()) == want


def test_contamination_equals_tiling_of_all_pairs(spark):
    rng = random.Random(4)
    sentence = lambda n: [rng.choice("abcdefghijkl") for _ in range(n)]
    items = [(i, sentence(rng.randrange(5, 20))) for i in range(8)]
    docs = []
    for n in range(80):
        own = items[n % 8][1]
        pieces = [own[k : k + 3 + n % 2] for k in range(0, len(own), 3 + n % 2)]
        rng.shuffle(pieces)
        docs.append((n, sentence(n % 7) + [w for p in pieces for w in [*p, *sentence(rng.randrange(2))]]))
    df = spark.createDataFrame([(n, " ".join(d)) for n, d in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    want = [(n, [i for i, w in items if sum(x[2] for x in naive_tiles(w, d, 3)) / len(w) >= 0.8]) for n, d in docs]
    assert 20 < sum(bool(w[1]) for w in want) < 80
    assert sorted((r["doc_id"], r["item_ids"]) for r in dc.contamination(df, bench).collect()) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert [tuple(r) for r in dc.contamination(docs, bench).collect()] == [(1, True, 1, [1], 1.0)]
    assert [r["contaminated"] for r in dc.contamination(docs, bench.limit(0)).collect()] == [False]
    assert dc.contamination(docs.limit(0), bench).count() == 0


def test_filter_has_no_false_denials(spark):
    rng = np.random.default_rng(2)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    bloom = Bloom.of(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k")
    assert bloom.holds(keys.view(np.uint64)).all()
    assert bloom.holds(rng.integers(0, 2**63, 100_000).astype(np.uint64)).mean() < 0.001


def test_short_items_and_seeds_that_stand_everywhere(spark):
    rng = random.Random(2)
    common = "one two three four five six"
    items = [(1, "a b c"), (2, "one two"), (3, common), (4, common + " seven eight nine ten eleven twelve"), (5, "x y z one two three four u v w")]
    docs = [(n, " ".join(rng.choice([common, "x y z", "u v w", "a b", "c", "a b c", "seven eight nine", "ten eleven twelve"]) for _ in range(6))) for n in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for least in (3, 5):
        got = sorted((r["doc_id"], list(r["item_ids"])) for r in dc.contamination(df, bench, item_words=least).collect())
        assert got == [(n, plain_judge(t, items, least)[1]) for n, t in docs] and any(x for _, x in got)
