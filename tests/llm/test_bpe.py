"""BPE against the tokenizers library, on texts built to break chunk joins."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stormlift.llm import bpe


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts():
    rng = random.Random(5)
    words = ["the", "tion", "ärger", "don't", "we'll", "x" * 70, "你好世界" * 20, "12345", "\U0001f600", "<|endoftext|>", "&&&", "é", " ", " ", "\x85", "\x1c", "ſ", "İ"]
    blanks = [" ", "  ", "\n", "\n\n ", "\t", "\r\n", "   \n", ""]
    shared = ["".join(rng.choice(words) + rng.choice(blanks) for _ in range(400)) for _ in range(3)]
    made = ["".join(rng.choice([*shared[i % 3 :], *words]) + rng.choice(blanks) for _ in range(rng.randrange(1, 6))) for i in range(60)]
    noise = ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x2000, 0x2070), 32, 32, 10])) for _ in range(1500)) for _ in range(4)]
    noise += ["x" + " " * 60_000 + end for end in ("", "y", "\n", "\nz", "<|endoftext|>")] + ["\n" * 60_000 + "q", "\x1c" * 60_000 + " a"]
    return [None, "", " ", "\n", " " * 5000, "a" * 100_000, "<|endoftext|>", " <|endoftext|> ", *shared, *shared, *made, *noise, noise[0] + noise[1], noise[1] + noise[0]]


def expected(reference, text):
    ids = reference.encode(text or "", add_special_tokens=False).ids
    decoded = reference.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_encode_equals_the_library(spark, reference):
    given = list(enumerate(texts())) + [(None, "a b"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in given], "doc_id long, text string, ids string, n_tokens int")
    got = bpe.bpe_encode(df).collect()
    want = sorted(((i, *expected(reference, t)) for i, t in given), key=repr)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got), key=repr) == want
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)


def test_chunks_are_shared_and_repaired(reference):
    c = bpe.codec(bpe.default_vocabulary())
    rng = random.Random(2)
    for text in texts()[1:]:
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        cuts = [(a, b) for _, a, b in bpe.chunks(data, np.array([0, len(raw)]))]
        assert b"".join(raw[a:b] for a, b in cuts) == raw
        known = {i: c.encode(raw[a:b].decode()) for i, (a, b) in enumerate(cuts) if rng.random() < 0.7}
        got = bpe.encode_chunked(raw, cuts, known, c)
        assert got.tolist() == reference.encode(text, add_special_tokens=False).ids


def test_round_trip_and_empty_table(spark):
    df = spark.createDataFrame([(1, "Grüße, don't panic\n 42"), (2, None)], "doc_id long, text string")
    back = bpe.bpe_decode(bpe.bpe_encode(df)).collect()
    assert {r["doc_id"]: r["decoded"] for r in back} == {1: "Grüße, don't panic\n 42", 2: ""}
    assert bpe.bpe_encode(df.limit(0)).count() == 0


def test_cuts_depend_on_the_text_alone():
    rng = random.Random(9)
    made = [" ".join(rng.choice(["the", "tion", "éa", "x"]) for _ in range(rng.randrange(0, 900))) for _ in range(60)]
    raw = "".join(made).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in made)])
    together = bpe.chunks(np.frombuffer(raw, np.uint8), offsets)
    for row, text in enumerate(made):
        alone = [(a, b) for _, a, b in bpe.chunks(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))]
        assert [(a - offsets[row], b - offsets[row]) for r, a, b in together if r == row] == alone
