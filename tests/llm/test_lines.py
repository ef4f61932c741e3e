"""Line dedup against a plain version."""

import random
import time
from collections import defaultdict

from stormlift.llm import lines

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANKS))


def plain(rows, least=40, docs=5):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    keeper = {k: max((i for i in s if i is not None), default=None) for k, s in holders.items() if len(s) >= docs}
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (key(x) in keeper and keeper[key(x)] != i)]
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=repr)


def test_equals_plain(spark):
    rng = random.Random(4)
    shared = ["Common line number %d " % n + "ABC éÉ " * 6 for n in range(6)] + ["short", "", "x" * 40, "é" * 39, "é" * 40, "\u00a0" + "y" * 39, "\u3000" + "z" * 40]
    rows = []
    for i in range(80):
        picked = [rng.choice(shared) if rng.random() < 0.7 else f"own line {i} " * 5 for _ in range(rng.randrange(0, 9))]
        dressed = [rng.choice(["", " ", "\t", "\x0b"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", "\r", "  "]) for x in picked]
        rows.append((i, "\n".join(dressed)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, shared[0]), (None, shared[0]), (103, "\n".join([shared[0]] * 3000)), (5, rows[5][1]), (5, "another\n" + shared[1])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_lines int, h1 int")
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "h1", "_n_lines", "n_dropped"]
    got = sorted(((r["doc_id"], r["text"], r["_n_lines"], r["n_dropped"]) for r in out.collect()), key=repr)
    assert got == plain(rows)
    assert sum(r[3] for r in got) > 100
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_a_text_of_very_many_lines(spark):
    shared = [f"shared line {n} " + "x" * 40 for n in range(50)]
    long = "\n".join(shared[n % 50] if n % 4 == 0 else f"own {n}" for n in range(200_000))
    rows = [(1, long), (2, None), *((10 + k, "\n".join(shared)) for k in range(5))]
    began = time.time()
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert time.time() - began < 60
    want = plain([(i, t or "") for i, t in rows])
    assert got == sorted(want) and got[0][3] == 50_000 and got[0][2] == 200_000
