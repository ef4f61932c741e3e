"""Secret scan: three patterns and a token-efficiency test."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlift.llm.bpe import Codec, codec, default_vocabulary
from stormlift.llm.common import query, table, text_of

KINDS = ("assign", "access", "hex", "random")

#: Fixed values of the base patterns; a greedy run that is long enough equals a run followed by a length test.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS = 6
#: What must stand in a text, in either case, before the assignment pattern is worth trying.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A candidate of the token test: a run of these characters with a letter.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Hex lengths of common digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512), and what identifiers made of words and numbers look like (no back-tracking).
DIGEST_CHARS = {32, 40, 56, 64, 96, 128}
DIGEST = re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
IDENTIFIER = re.compile(r"(?>[A-Za-z][a-z]++|[A-Z]{2,}+|[0-9]++|[+/_=-])++")
#: The words of an identifier: if they too take a token every few characters, it is none.
LETTERS = re.compile(r"[A-Z]?[a-z]++|[A-Z]++")
#: Random strings reach about 1.4 to 1.9 characters a token; words and names stand above 2.
MAX_CHARS_PER_TOKEN = 2.0


def is_random(s: str, c: Codec, most: float = MAX_CHARS_PER_TOKEN) -> bool:
    """Few characters a token, and neither a known digest nor an identifier."""
    if not any(x.isalpha() for x in s) or (len(s) in DIGEST_CHARS and DIGEST.fullmatch(s)) or UUID.fullmatch(s):
        return False
    if len(s) >= most * len(c.encode(s)):
        return False
    if not IDENTIFIER.fullmatch(s):
        return True
    runs = LETTERS.findall(s)
    return sum(map(len, runs)) < most * sum(len(c.encode(r)) for r in runs)


def scan(text: str, c: Codec, most: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span of one text, in order."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted(found)
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    for m in CANDIDATE.finditer(text):
        before = bisect_right(starts, m.start())  # base spans that start no later; the farthest end of them decides
        inside = before and m.end() <= reach[before - 1]
        if not inside and is_random(m[0], c, most):
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _scan_batches(path: str, most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans = scan(text, c, most)
                written = [(k, f"{KINDS[k]}:{a}:{b}") for a, k, b in spans]
                base = ",".join(s for k, s in written if k < 3)
                counts = [sum(k == n for k, _ in written) for n in range(4)]
                rows.append((*counts[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, s in written), counts[3], [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *cols], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random", "found"])

    return run


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """Secrets of every whole text, as code point spans, end exclusive.

    Base kinds are the three patterns, leftmost and not overlapping within a kind. Kind ``random``
    adds runs of 20 and more characters with a letter that the vocabulary spends a token on every two
    characters or less; known digest lengths, UUIDs and names of words and numbers, whose words alone
    take fewer tokens, are excluded, and so is what already lies inside a base span.

    Defined cases: null and empty texts hold nothing; ids that repeat or are null keep a row each; an
    empty table stays empty; other columns are ignored. A narrow scan: no shuffle.

    Returns the id column, n_assign, n_access, n_hex, base_sha256, spans, n_random, found (array of spans).
    """
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = f"id {docs.schema['id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long, found array<struct<kind: string, start: long, end: long>>"
    return docs.mapInArrow(_scan_batches(vocabulary or default_vocabulary(), max_chars_per_token), schema).withColumnRenamed("id", id_col)


@query("op1_secret_scan")
def secret_scan(spark, sf_dir):
    """No SQL for the token test; the tests compare the base patterns with a plain walk."""
    return find_secrets(table(spark, sf_dir, "documents")).drop("found")
