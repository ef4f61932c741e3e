"""Quality and toxicity: held-out accuracy, the exact sums, and edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stormlift.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def held(i, n, r):
    return zlib.crc32(str(i).encode()) % n == r


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n1, n0 = y.sum(), (1 - y).sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    extra = docs.selectExpr("*", "'x' AS score", "0 AS stats", "1 AS id")
    out = quality.quality_scores(extra, labels).join(labels, "doc_id").toPandas()
    assert len(out) == labels.count()
    assert all(held(i, 4, 2) == h for i, h in zip(out.doc_id, out.held_out, strict=True))
    assert ((out.score >= 0) & (out.score <= 1)).all() and ((out.score >= 0.7) == (out.predicted == 1)).all()
    test = out[out.held_out]
    assert (test.predicted == test.quality).mean() > 0.95 and auc(test.score.values, test.quality.values) > 0.97


def test_quality_never_reads_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(200), spark.read.parquet(f"{SF}/labels.parquet")
    lied = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2, 1 - quality, quality) AS quality")
    one, two = ({r["doc_id"]: r["score"] for r in quality.quality_scores(docs, x).collect()} for x in (labels, lied))
    assert one == pytest.approx(two, abs=1e-9)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "x" * 200_000), (3, "x " * 50_000), (4, "été 12 !!")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == 6 and len({r["score"] for r in out}) == 1
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(4, 1), (4, None)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality.quality_scores(docs, labels).collect())
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_isotonic_is_the_least_squares_increasing_fit():
    rng = np.random.default_rng(3)
    x = np.sort(rng.random(60))
    n, p = rng.integers(1, 9, 60).astype(float), None
    p = np.floor(n * rng.random(60))
    knots, values = quality.isotonic(x, n, p)
    fitted = np.interp(x, knots, values)
    assert (np.diff(values) >= 0).all()
    share = p / n
    want = [max(min((p[i : j + 1].sum() / n[i : j + 1].sum()) for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    assert fitted == pytest.approx(want) and len(share) == 60


def test_statistics_are_the_same_alone_and_together():
    texts = ["The the the. END!!", "", "a | b | c\nd", "é" * 50, "one two one two one two one two"] * 3
    together = quality.statistics(*quality.text_buffer(pa.array(texts)))
    for k, t in enumerate(texts):
        assert np.allclose(together[k], quality.statistics(*quality.text_buffer(pa.array([t])))[0])


def made(rng, insults, n):
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of"]
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))]
        toxic = i % 4 == 0
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        texts.append(" ".join(words) + ".")
        labels.append(int(toxic))
    return texts, labels


def test_toxicity_held_out_and_gapped():
    rng = random.Random(5)
    insults = ["idiot", "moron", "worthless", "scum"]
    model = toxicity.train(*made(rng, insults, 600))
    texts, y = made(rng, insults, 300)
    score = model.text_scores(pa.array(texts))
    assert ((score >= 0.5) == np.array(y)).mean() > 0.98
    clean = [t for t, k in zip(texts, y, strict=True) if not k]
    for dressed in ("i.d.i.o.t", "w*orthless", "mor-on", "s c u m", "IDIOT!!", "worthlesss"):
        hidden = [f"{t} {dressed} and {dressed} {t}" for t in clean[:60]]
        low, high = (model.worst(pa.array(x))[:, 0] for x in (clean[:60], hidden))
        assert (high > low).mean() > 0.9, dressed


def test_kernel_features_agree_with_scores():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcxyzé.") for _ in range(rng.randrange(1, 12))).encode() for _ in range(200)]
    weights = np.random.default_rng(0).standard_normal(toxicity.CLASSES**3).astype(np.float32)
    who, feature, weight = toxicity.word_features(words)
    explicit = np.bincount(who, weights=weight * weights[feature], minlength=len(words))
    data = b" ".join(words)
    w = toxicity.split_words(np.frombuffer(b"\n".join(words), np.uint8), np.array([0, len(data)]))
    assert toxicity.word_scores(w, weights) == pytest.approx(explicit, abs=1e-3)


def test_toxicity_operator(spark):
    rng = random.Random(2)
    texts, y = made(rng, ["idiot", "moron"], 400)
    docs = spark.createDataFrame([(i, t, "f", 0.0) for i, t in enumerate(texts)] + [(None, "idiot moron", "f", 0.0), (900, None, "f", 0.0), (901, "", "f", 0.0), (902, "word " * 60_000, "f", 0.0), (903, "z" * 100_000, "f", 0.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(y)] + [(None, 1), (3, None), (5, y[5])], "doc_id long, toxic int")
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == 405
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["held_out"] == held(i, 5, 0) for i in range(400))
    test = [i for i in range(400) if held(i, 5, 0)]
    assert np.mean([by[i]["predicted"] == y[i] for i in test]) > 0.95
    assert by[None]["predicted"] == 1 and not any(by[i]["predicted"] for i in (900, 901, 902, 903))
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in by.items() if not r["predicted"]}
    none = toxicity.toxicity_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_nothing_to_learn_from_drops_nothing(spark):
    texts, y = made(random.Random(3), ["idiot", "moron"], 60)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(900, None), (901, "")], "doc_id long, text string")
    labelled = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    every = list(enumerate(y))
    one_toxic = [(i, k) for i, k in every if not k] + [next((i, 1) for i, k in every if k and not held(i, 5, 0))]
    for rows in ([], [(i, 0) for i, _ in every], [(i, 1) for i, _ in every], one_toxic, [(i + 5000, k) for i, k in every]):
        assert not any(r["predicted"] for r in toxicity.toxicity_scores(docs, labelled(rows)).collect())
        assert toxicity.without_toxic(docs, labelled(rows)).count() == docs.count()


def test_the_sample_is_of_usable_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 40)
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 80)
    texts, y = made(random.Random(9), ["idiot", "moron"], 400)
    long = [i for i in range(400) if i % 5]
    rows = [(i, texts[i] if i not in long else texts[i] + " the" * 2000) for i in range(400)]
    docs = spark.createDataFrame(rows + [(i, None) for i in range(400, 600)], "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(y)) + [(i, i % 2) for i in range(400, 1000)], "doc_id long, toxic int")
    seen = []
    task = toxicity._fit_task
    monkeypatch.setattr(toxicity, "_fit_task", lambda clean, toxic: seen.append((clean, toxic)) or task(clean, toxic))
    out = toxicity.toxicity_scores(docs, labels).where("doc_id < 400").collect()
    usable = [y[i] for i in range(400) if i not in long and not held(i, 5, 0)]
    assert seen == [(usable.count(0), usable.count(1))]
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in out]) > 0.95


def test_few_labels_raise_few_false_alarms():
    rng = random.Random(4)
    insults = ["idiot", "moron", "worthless", "scum"]
    test, y = made(rng, insults, 300)
    for n in (16, 40, 80):
        predicted = toxicity.train(*made(rng, insults, n)).text_scores(pa.array(test)) >= 0.5
        assert predicted[np.array(y) == 0].mean() < 0.05, n


def test_inserted_characters_of_any_kind_are_seen_through():
    rng = random.Random(5)
    insults = ["idiot", "moron", "worthless", "scum"]
    model = toxicity.train(*made(rng, insults, 600))
    texts, y = made(rng, insults, 300)
    clean = [t for t, k in zip(texts, y, strict=True) if not k]
    assert (model.text_scores(pa.array(clean)) >= 0.5).mean() < 0.02
    for mark in (".", "--", "..", "*_*", "·", "\u200b", "\u200d\u2060", "\u0301", "\U0001f600", "\u2026\u2026"):
        for insult in ("idiot", "worthless"):
            hidden = [f"{t} {mark.join(insult)} and {mark.join(insult)} {t}" for t in clean[:60]]
            assert (model.text_scores(pa.array(hidden)) >= 0.5).mean() > 0.95, (mark, insult)


def test_letters_of_all_scripts_keep_their_places():
    def classes(text):
        data = np.frombuffer(text.encode(), np.uint8)
        w = toxicity.split_words(data, np.array([0, len(data)]))
        return [w.classes[s:e].tolist() for s, e in zip(w.starts, w.ends, strict=True)]

    assert classes("a-b\u00b7\u200bc --- \u00e9\u4e2d\U00020000 d\u0301") == [[1, 2, 3], [], [29 + b % 3 for b in "\u00e9\u4e2d\U00020000".encode()], [4]]
