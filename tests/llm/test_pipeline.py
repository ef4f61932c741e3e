"""The pipeline against plain versions of its stages on a small corpus."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from stormlift.llm import toxicity
from test_bpe import expected
from test_classifiers import made
from test_decontaminate import plain_judge
from test_lines import plain as plain_lines
from test_simhash import plain_components, plain_fingerprint


def corpus():
    rng = random.Random(12)
    texts, toxic = made(rng, ["idiot", "moron"], 240)
    shared = "this very long line stands in many of the documents, so it goes"
    items = [(i, " ".join("".join(rng.choice(["ka", "lo", "mi", "su", "te"]) for _ in range(3)) for _ in range(30))) for i in range(5)]
    for i in range(0, 240, 7):
        texts[i] += "\n" + shared
    for i in range(0, 240, 11):
        texts[i] += " " + items[i % 5][1]
    for i in range(0, 240, 9):
        if not toxic[i]:
            texts.append(texts[i])
            texts.append(texts[i].replace("er", "re", 1))
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    docs += [(900, None, "en", None, None), (901, "", "en", "s", 0), (902, "", "en", "s", 0), (None, "no id here", None, None, 10)]
    return docs, [(i, 1, k) for i, k in enumerate(toxic)], items


def test_run_equals_plain_stages(spark, tmp_path):
    docs, labels, items = corpus()
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": (labels, "doc_id long, quality int, toxic int"),
        "benchmark": (items, "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scored = toxicity.toxicity_scores(read, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    rejected = {r["doc_id"] for r in scored if r["predicted"]}
    assert len(rejected) > 50 and not rejected & {900, 901, None}
    left = [(i, t) for i, t, *_ in docs if i not in rejected]
    left = [(i, t) for i, t, *_ in plain_lines(left)]
    roots = plain_components([plain_fingerprint(t) for _, t in left])
    least = {}
    for (i, _), r in zip(left, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    left = [(i, t) for (i, t), r in zip(left, roots, strict=True) if i is None or least[r] == i]
    left = [(i, t) for i, t in left if not plain_judge(t, items)[0]]
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(((i, *expected(reference, t)) for i, t in left), key=repr)
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)
    assert got == want
    assert 0 < len(got) < len(docs) - len(rejected)


def test_stages_keep_the_columns(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars long, fingerprint int")
    for some in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, some, str(tmp_path)).schema.simpleString() == rows.schema.simpleString()


def test_stages_drop_rows_not_ids(spark, tmp_path):
    rng = random.Random(3)
    passage = lambda: " ".join("".join(rng.choice(["ka", "lo", "mi", "su", "te"]) for _ in range(4)) for _ in range(40))
    item, clean, copied = passage(), [passage() for _ in range(6)], passage()
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, clean[0]), (None, clean[1]), (None, clean[1]), (4, item), (4, clean[2]), (5, clean[3])]
    rows += [(1, copied), (6, copied), (6, clean[4]), (7, clean[5]), (7, clean[5]), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    want = sorted([r for r in rows if r[1] != item], key=repr)
    assert left(corpus_pipeline.decontaminate(spark, docs, str(tmp_path))) == want
    want = [r for r in rows if r not in ((6, copied), (7, clean[5]), (4, item))] + [(7, clean[5]), (4, item)]
    assert left(corpus_pipeline.near_dedup(spark, docs, str(tmp_path))) == sorted(want, key=repr)
