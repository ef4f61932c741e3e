"""Pseudonyms against a plain version of the networks, and by what must not change."""

import hashlib
import random
import re
from datetime import date, timedelta

from stormlift.llm import pii

KEY = "k1"


def hashed(tweak, i, x):
    return hashlib.sha256(f"{KEY}|{tweak}|{i}|{x}".encode()).hexdigest()


def plain_text(s, tweak):
    left, right = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(1, 9):
        h, out = hashed(tweak, i, right), ""
        for j, c in enumerate(left):
            by = int(h[j % 32 * 2 : j % 32 * 2 + 2], 16)
            for first, size in (("0", 10), ("a", 26), ("A", 26)):
                if c.isascii() and first <= c < chr(ord(first) + size):
                    c = chr((ord(c) - ord(first) + by) % size + ord(first))
                    break
            out += c
        left, right = right, out
    return left + right


def plain_pair(a, b, sides, tweak):
    for i in range(1, 9):
        if i % 2:
            a = (a + int(hashed(tweak, i, b)[:12], 16)) % sides[0]
        else:
            b = (b + int(hashed(tweak, i, a)[:12], 16)) % sides[1]
    return a, b


def luhn_ok(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def run(spark, texts):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_email int")
    rows = sorted(pii.pseudonymise(df, KEY).collect(), key=lambda r: r["doc_id"])
    assert rows[0].__fields__[:3] == ["doc_id", "text", "n_email"] and all(r["n_email"] == 7 for r in rows)
    return rows


def checked(body):
    return next(body + c for c in "0123456789" if luhn_ok(body + c))


def test_each_kind(spark):
    other = checked("980791576280449")
    given = ["und.34@mail7.example.com", "97.51.17.173", "4111111111111111", other, "4111 1111 1111 1111", "219-09-9999", "2024-02-29", "31/12/1999", "12/31/1999", "01.02.2003", "+1 (017) 555-7713", "(212) 555-0199", "212-555-0199"]
    left = [other[:-1] + str((int(other[-1]) + 1) % 10), "1700000000123", "20240101123456789", "4111 1111 1111 1112", "000-12-3456", "666-12-3456", "2023-02-29", "99/99/2000", "256.1.1.1", "1.2.3.4.5", "x4111111111111111", "12345", "a@b", "41111111111111111111111", "Version 2.0.", "04dbebab91ab85687d33eeaaf9ac699e1188f962"]
    rows = run(spark, given + left)
    got = [r["text"] for r in rows]
    for s, t in zip(given, got, strict=False):
        shape = lambda x: re.sub("[a-z]", "a", re.sub("[0-9]", "9", x))
        assert t != s
        assert shape(t) == shape(s) or re.fullmatch(r"[0-9.]+", s)
    assert got[len(given) :] == left
    assert got[0] == plain_text("und.34", "email") + "@mail7.example.com"
    a, b = plain_pair(97 * 256 + 51, 17 * 256 + 173, (65536, 65536), "ip")
    assert got[1] == f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    assert luhn_ok(got[2]) and got[2][:-1] == plain_text("4" + "1" * 14, "card")
    assert luhn_ok(got[3]) and got[3][:-1] == plain_text("980791576280449", "card")
    assert not any(luhn_ok(re.sub(" ", "", x)) for x in left[:4])
    assert got[4].replace(" ", "") == got[2]
    a, b = plain_pair(218 * 99 + 8, 9998, (898 * 99, 9999), "ssn")
    area = a // 99 + 1
    assert got[5] == f"{area + (area >= 666):03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    days = (date(2024, 2, 29) - date(2001, 1, 1)).days
    a, b = plain_pair(days // 773, days % 773, (189, 773), "date")
    assert got[6] == (date(2001, 1, 1) + timedelta(days=a * 773 + b)).isoformat()
    assert got[10].startswith("+1 (") and re.sub("[^0-9]", "", got[10])[1:] == plain_text("0175557713", "phone")
    sums = {c: sum(r[c] for r in rows) for c in rows[0].__fields__[3:]}
    assert sums == {"_n_email": 1, "n_ip": 1, "n_card": 3, "n_ssn": 1, "n_date": 4, "n_phone": 3}


def test_values_stay_linked_in_texts(spark):
    rng = random.Random(3)
    bodies = ["".join(rng.choice("0123456789") for _ in range(15)) for _ in range(40)]
    cards = [checked(b) for b in bodies]
    texts = [f"á {c}, then {c}!! and 10.0.0.{i}\n" for i, c in enumerate(cards)] + [f"{c}" for c in cards]
    got = [r["text"] for r in run(spark, texts)]
    made = {}
    for c, t, alone in zip(cards, got[:40], got[40:], strict=True):
        assert t.startswith(f"á {alone}, then {alone}!! and ") and t.endswith("\n")
        made[c] = alone
        assert luhn_ok(alone)
    assert len(set(made.values())) == len(set(cards))


def test_networks_are_permutations(spark):
    assert len({plain_pair(a, b, (9, 7), "t") for a in range(9) for b in range(7)}) == 63
    assert len({plain_text(f"{i:03d}", "t") for i in range(1000)}) == 1000


def test_edges(spark):
    long = "x" * 50_000 + " 4111111111111111 " + "1" * 50_000 + " a@" + "b." * 5000
    rows = run(spark, [None, "", long, "no numbers", long])
    assert rows[0]["text"] is None and rows[1]["text"] == "" and rows[3]["text"] == "no numbers"
    assert rows[2]["text"] == rows[4]["text"] != long and len(rows[2]["text"]) == len(long)
    assert pii.pseudonymise(spark.createDataFrame([], "text string, n_ip int"), KEY).count() == 0


def test_last_dates_come_back(spark):
    """Days of the years 9601 to 9999 go round in their cycle: never the year 10000, no two the same, as a plain walk says."""
    days = [date(9999, 12, 31) - timedelta(days=i) for i in range(1500)] + [date(9601, 1, 1) + timedelta(days=i) for i in range(300)]
    got = [r["text"] for r in run(spark, [d.isoformat() for d in days])]
    assert len(set(got)) == len(days) and all("9601" <= t[:4] <= "9999" for t in got)
    first, walked = date(9601, 1, 1), 0
    for d, t in zip(days, got, strict=True):
        n = (d - first).days
        while True:
            a, b = plain_pair(n // 773, n % 773, (189, 773), "date")
            n = a * 773 + b
            if n < (date(9999, 12, 31) - first).days + 1:
                break
            walked += 1
        assert t == (first + timedelta(days=n)).isoformat()
    assert walked > 0
