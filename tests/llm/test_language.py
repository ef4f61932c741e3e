"""Language filters against plain sets of n-grams, and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from stormlift.llm import language as L
from stormlift.llm.common import QUERIES

KINDS = "doc_id long, text string, lang string, held_out int, score string"


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return [f" {w} "[k : k + 3] for w in words for k in range(len(w))]


def made(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    kinds = {"aa": ["ba", "lo", "mi", "é"], "bb": ["ba", "ru", "st", "ü"], "cc": ["ж", "да", "не", "lo"]}
    rows = [(i, made(rng, kinds[k], rng.choice([2, 5, 40])), k) for i, k in ((i, rng.choice(list(kinds))) for i in range(600))]
    rows += [(i, "BA lo, mi! 12 " * 5, "aa") for i in range(1000, 1300)]  # a third of all rows is one text
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], KINDS)
    return L.language_scores(df).collect()


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def plain_filter(rows):
    learned = [(set(plain_grams(t)), k) for i, t, k in rows if not held(i) and t is not None and k is not None]
    langs = sorted({k for _, k in learned})
    size = {k: sum(x == k for _, x in learned) for k in langs}
    share = {}
    for grams, k in learned:
        for g in grams:
            share.setdefault(g, dict.fromkeys(langs, 0))[k] += 1
    sets = {k: set() for k in langs}
    for g, by in share.items():
        by = {k: n / size[k] for k, n in by.items()}
        for k, v in by.items():
            if v >= L.LEAST_SHARE and v >= L.LEAST_RATIO * max(by.values()):
                sets[k].add(g)
    return langs, sets


def test_ngrams_equal_plain_ones():
    texts = ["Ab, c1d!", None, "", "éa-É 12", "  x\n\ny ", "ǅ İ ß 語 𝒳a", "9 8 7", "a" * 20]
    row, hashes, some = L.ngrams(texts)
    assert some.tolist() == [any(c.isalpha() for c in t or "") for t in texts]
    assert np.bincount(row, minlength=len(texts)).tolist() == [len(plain_grams(t)) for t in texts]
    names = {}
    for n, t in enumerate(texts):  # equal n-grams have equal hashes, others differ
        for g, h in zip(plain_grams(t), hashes[row == n].tolist(), strict=True):
            assert names.setdefault(g, h) == h
    assert len(set(names.values())) == len(names)
    assert not len(L.ngrams([])[0]) and not len(L.ngrams([None])[0])


def test_filter_equals_plain_sets(spark):
    rows = corpus()
    langs, sets = plain_filter(rows)
    model = L.learn(spark.createDataFrame([(t, k) for i, t, k in rows if not held(i)], "text string, lang string"))
    assert model.languages == langs and len(model.masks) & len(model.masks) - 1 == 0
    texts = [t for _, t, _ in rows]
    row, hashes, _ = L.ngrams(texts)
    found = model.containing(hashes)[:, 0]
    grams = [g for t in texts for g in plain_grams(t)]
    for g, mask in zip(grams, found.tolist(), strict=True):
        want = sum(1 << n for n, k in enumerate(langs) if g in sets[k])
        assert mask & want == want  # a filter forgets nothing
    strange = np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64)
    rate = np.array([(model.containing(strange)[:, 0] >> n & 1).mean() for n in range(len(langs))])
    assert np.abs(rate - model.false).max() < 0.005 and rate.max() < 0.03  # the correction's rate is the real one
    shares, _ = model.shares(texts)
    exact = np.array([[np.mean([g in sets[k] for g in plain_grams(t)]) for k in langs] for t in texts])
    assert np.abs(shares - exact)[:600].mean() < 0.04 and np.median(np.abs(shares - exact)) < 0.005
    got = {r["doc_id"]: r for r in run(spark, rows)}
    right = [got[i]["lang_pred"] == k for i, _, k in rows if held(i)]
    assert len(right) > 100 and np.mean(right) >= 0.97
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 for i, r in got.items())


def test_more_languages_than_a_byte_has_bits(spark):
    rng = random.Random(1)
    rows = [(i, made(rng, [chr(0x4E00 + 40 * (i % 19) + k) for k in range(12)], 12), f"l{i % 19:02d}") for i in range(760)]
    got = {r["doc_id"]: r["lang_pred"] for r in run(spark, rows)}
    assert np.mean([got[i] == k for i, _, k in rows if held(i)]) >= 0.97


def test_defined_cases(spark):
    rows = corpus()[:300]
    odd = [(5000, None, "aa"), (5001, "", "bb"), (5002, "12 345 !?", "aa"), (5003, "語語語", "aa"), (5004, "ba lo mi", None), (None, "ba lo mi lo ba", "aa"), (5005, "Ⅷ ²", "aa"), (rows[0][0], rows[1][1], "cc")]
    out = run(spark, rows + odd)
    assert len(out) == len(rows) + len(odd)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert got[5000] == got[5001] == got[5002] == got[5005] == ("und", 0.0)
    most = max(("aa", "bb", "cc"), key=lambda k: sum(x == k for i, t, x in rows + odd if not held(i) and t is not None))
    assert held(5003) or got[5003][0] in ("aa", "bb", "cc")
    assert got[None][0] == "aa" and got[5004][0] == "aa"
    lone = run(spark, [(i, "ba lo", "aa") for i in range(40)] + [(7000, "ξξξ", None)])
    assert {r["lang_pred"] for r in lone} == {"aa"} and {r["score"] for r in lone if r["doc_id"] == 7000} == {0.0}
    assert most in ("aa", "bb", "cc")
    assert {r["lang_pred"] for r in run(spark, [(i, "ba lo", None) for i in range(9)])} == {"und"}
    assert run(spark, []) == []


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    out = QUERIES["op11_language_id"](spark, f"/root/testdata/sf{sf}").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 40 and np.mean([r["lang"] == r["lang_pred"] for r in out]) >= 0.98
