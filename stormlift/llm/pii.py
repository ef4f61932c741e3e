"""Personal data: numbers, dates and addresses become keyed pseudonyms of the same format.

A Feistel network permutes each value within its format: digit for digit and letter for letter for
e-mail names, phone and card numbers, and on exact integer domains for IPv4 addresses, social security
numbers and dates. Rounds add a keyed hash of one half to the other half, so every network is a
permutation: equal values get equal pseudonyms in all documents, different values different ones, and
the key's holder can go back. All of it is built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlift.llm.common import fresh, query, table, text_of

ROUNDS = 8
#: The setting that holds the key of the registered query, and the key it runs with where that is unset.
KEY_SETTING, TRIAL_KEY = "spark.stormlift.pii.key", "trial runs only"
KINDS = ("email", "ip", "card", "ssn", "date", "phone")

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: The shapes of candidates, tried in this order at each place; repeats are bounded.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
    "phone": r"(?<![0-9A-Za-z+(])(?:\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,5}\)?){2,4}|\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])",
}
PATTERN = "|".join(SHAPES.values())

#: Days of 400 Gregorian years, as the product of the two halves of the date network.
DATE_SIDES = (189, 773)
#: Days from 9601-01-01 to 9999-12-31.
DAYS_BEFORE_10000 = 189 * 773 - 366
#: Area and group of a social security number (001 to 899 but 666, 01 to 99), and its serial.
SSN_SIDES = (898 * 99, 9999)


def _hash(key: str, tweak: str, i: Column, x: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), x), 256)


def _shifted(c: Column, by: Column) -> Column:
    """A character moved within its class: digits, lower-case and upper-case letters; others stay."""
    code = F.ascii(c)

    def turn(first: int, size: int) -> Column:
        return F.char((F.pmod(code - first + by, F.lit(size)) + first).cast("long"))

    return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)


def permuted_text(s: Column, key: str, tweak: str) -> Column:
    """Feistel network over a string's halves; every character keeps its class."""
    half = F.floor(F.char_length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.char_length(s)).alias("r"))

    def step(acc: Column, i: Column) -> Column:
        stream = _hash(key, tweak, i, acc["r"])
        chars = F.filter(F.split(acc["l"], ""), lambda c: c != "")
        moved = F.transform(chars, lambda c, j: _shifted(c, F.conv(F.substring(stream, j % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")))
        return F.struct(acc["r"].alias("l"), F.array_join(moved, "").alias("r"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return F.concat(end["l"], end["r"])


def permuted_pair(a: Column, b: Column, sides: tuple[int, int], key: str, tweak: str) -> Column:
    """Feistel network over a pair of integers below ``sides``, as struct(l, r)."""

    def step(acc: Column, i: Column) -> Column:
        f = lambda x: F.conv(F.substring(_hash(key, tweak, i, x.cast("string")), 1, 12), 16, 10).cast("long")
        odd = i % 2 == 1
        left = F.when(odd, F.pmod(acc["l"] + f(acc["r"]), F.lit(sides[0]).cast("long"))).otherwise(acc["l"])
        right = F.when(odd, acc["r"]).otherwise(F.pmod(acc["r"] + f(acc["l"]), F.lit(sides[1]).cast("long")))
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(a.cast("long").alias("l"), b.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _with_digits(s: Column, digits: Column) -> Column:
    """``s`` with its digits replaced in order."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    before = lambda i: F.char_length(_digits(F.substring(s, F.lit(1), i + 1)))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.between("0", "9"), F.substring(digits, before(i), F.lit(1))).otherwise(c)), "")


def _luhn(payload: Column) -> Column:
    """The check digit of a string of digits."""
    places = F.filter(F.split(F.reverse(payload), ""), lambda c: c != "")
    doubled = F.transform(places, lambda c, i: F.when(i % 2 == 0, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda x, y: x + y), F.lit(10))


def _card_valid(s: Column) -> Column:
    d = _digits(s)
    n = F.char_length(d)
    return F.substring(d, n, F.lit(1)).cast("int") == _luhn(F.substring(d, F.lit(1), n - 1))


def _card(s: Column, key: str) -> Column:
    """All digits but the last are permuted; the last is the check digit of the others."""
    d = _digits(s)
    new = permuted_text(F.substring(d, F.lit(1), F.char_length(d) - 1), key, "card")
    return _with_digits(s, F.concat(new, _luhn(new).cast("string")))


def _phone(s: Column, key: str) -> Column:
    """The last ten digits are permuted, a country code before them stays."""
    d = _digits(s)
    head = F.when(s.startswith("+"), F.greatest(F.lit(1), F.char_length(d) - 10)).otherwise(F.lit(0))
    return _with_digits(s, F.concat(F.substring(d, F.lit(1), head), permuted_text(F.substring(d, head + 1, F.char_length(d)), key, "phone")))


def _ip(s: Column, key: str) -> Column:
    o = [F.split_part(s, F.lit("."), F.lit(k)).cast("long") for k in (1, 2, 3, 4)]
    p = permuted_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), key, "ip")
    parts = F.transform(F.array(p["l"], p["r"]), lambda x: F.concat_ws(".", F.floor(x / 256).cast("long").cast("string"), (x % 256).cast("string")))
    return F.array_join(parts, ".")


def _ssn(s: Column, key: str) -> Column:
    area, group, serial = (F.split_part(s, F.lit("-"), F.lit(k)).cast("long") for k in (1, 2, 3))
    index = area - 1 - F.when(area > 666, 1).otherwise(0)
    p = permuted_pair(index * 99 + group - 1, serial - 1, SSN_SIDES, key, "ssn")

    def written(x: Column) -> Column:
        i = F.floor(x["l"] / 99) + 1
        area = i + F.when(i >= 666, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((x["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((x["r"] + 1).cast("string"), 4, "0"))

    return F.get(F.transform(F.array(p), written), F.lit(0))


_FORMATS = (("^....-", "yyyy-MM-dd"), ("^../", "MM/dd/yyyy"), ("^../", "dd/MM/yyyy"), (r"^..\.", "dd.MM.yyyy"))


def _year(s: Column) -> Column:
    return F.when(s.rlike("^....-"), F.substring(s, 1, 4)).otherwise(F.substring(s, 7, 4)).cast("int")


def _parts(s: Column, fmt: str) -> Column:
    """The date a string stands for in one format, or null."""
    at = {p: fmt.index(p) + 1 for p in ("yyyy", "MM", "dd")}
    year, month, day = (F.substring(s, at[p], len(p)).cast("int") for p in ("yyyy", "MM", "dd"))
    iso = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when((year >= 1) & month.between(1, 12) & day.between(1, 31), iso.try_cast("date"))


def _date_read(s: Column) -> Column:
    """struct(format, date) of the first format in which the string is a real date, or null."""
    tries = [F.when(s.rlike(shape) & _parts(s, fmt).isNotNull(), F.struct(F.lit(fmt).alias("fmt"), _parts(s, fmt).alias("day"))) for shape, fmt in _FORMATS]
    return F.coalesce(*tries)


def _date(s: Column, key: str) -> Column:
    """Days are permuted within the 400 years that hold the date; a string that is no real date is null.

    The last 400 years end with the year 10000, which has five digits: a day in it is permuted on until
    one before it comes, at most once for each of its 366 days, so the map can still be undone.
    """

    def moved(x: Column) -> Column:
        first = F.make_date(F.floor((F.year(x["day"]) - 1) / 400).cast("int") * 400 + 1, F.lit(1), F.lit(1))
        ends = F.when(F.year(first) == 9601, DAYS_BEFORE_10000).otherwise(DATE_SIDES[0] * DATE_SIDES[1])

        def walk(days: Column, i: Column) -> Column:
            p = permuted_pair(F.floor(days / DATE_SIDES[1]), days % DATE_SIDES[1], DATE_SIDES, key, "date")
            return F.when((i > 0) & (days < ends), days).otherwise((p["l"] * DATE_SIDES[1] + p["r"]).cast("long"))

        turns = F.sequence(F.lit(0), F.when(F.year(first) == 9601, 366).otherwise(0))
        day = F.date_add(first, F.aggregate(turns, F.datediff(x["day"], first).cast("long"), walk).cast("int"))
        iso = [F.lpad(part.cast("string"), n, "0") for part, n in ((F.year(day), 4), (F.month(day), 2), (F.dayofmonth(day), 2))]
        y, m, d = iso
        fmt = x["fmt"]
        return F.when(fmt == "yyyy-MM-dd", F.concat_ws("-", y, m, d)).when(fmt == "MM/dd/yyyy", F.concat_ws("/", m, d, y)).when(fmt == "dd/MM/yyyy", F.concat_ws("/", d, m, y)).otherwise(F.concat_ws(".", d, m, y))

    return F.get(F.transform(F.filter(F.array(_date_read(s)), lambda x: x.isNotNull()), moved), F.lit(0))


def _email(s: Column, key: str) -> Column:
    name = F.split_part(s, F.lit("@"), F.lit(1))
    return F.concat(permuted_text(name, key, "email"), F.substring(s, F.char_length(name) + 1, F.char_length(s)))


def kind_of(s: Column) -> Column:
    """The kind of a candidate; null if it fails validation."""
    whole = {k: s.rlike(f"^(?:{p})$") for k, p in SHAPES.items()}
    date = whole["date"] & _date_read(s).isNotNull()
    return (
        F.when(whole["email"], "email").when(whole["ip"], "ip").when(whole["card"] & _card_valid(s), "card").when(whole["ssn"], "ssn").when(date, "date").when(whole["phone"] & ~whole["date"], "phone")
    )


def pseudonym(s: Column, kind: Column, key: str) -> Column:
    make = {"email": _email, "ip": _ip, "card": _card, "ssn": _ssn, "date": _date, "phone": _phone}
    out = s
    for k, f in make.items():
        out = F.when(kind == k, f(s, key)).otherwise(out)
    return out


def count_columns(df: DataFrame) -> list[str]:
    """The names of the counts that ``pseudonymise`` adds to ``df``."""
    return [fresh(df, f"n_{k}") for k in KINDS]


def pseudonymise(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``df`` with personal data in its texts replaced, and how much of each kind was found.

    Found are e-mail addresses (the name changes), IPv4 addresses, card numbers of 13 to 19 digits (only
    with a right check digit, and so are their pseudonyms), US social security numbers (only assignable ones), dates
    (only real ones; a slashed date is read month first if that is a real date, else day first), and phone
    numbers (the last ten digits change). Candidates that fail validation stay as they are. Who holds
    ``key`` can undo the pseudonyms, so there is none by default.

    Defined cases: null texts come back null with counts of zero, empty ones empty; very long texts are
    worked on whole; repeated rows get the same pseudonyms; an empty table stays empty; all other columns
    pass through, whatever their names. No shuffle, no Python.
    """
    text = text_of(text_col)
    names, found_c = count_columns(df), fresh(df, "found_pii")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    kinds = F.transform(found, lambda s: F.struct(s.alias("s"), kind_of(s).alias("kind")))
    out = df.withColumn(found_c, kinds)
    values = F.transform(F.col(found_c), lambda m: pseudonym(m["s"], m["kind"], key))
    pairs = F.zip_with(F.split(text, PATTERN, -1), F.concat(values, F.array(F.lit(""))), lambda p, v: F.concat(p, v))
    new = F.when(F.size(found_c) == 0, F.col(text_col)).otherwise(F.array_join(pairs, ""))

    def count(kind: str) -> Column:
        return F.size(F.filter(F.col(found_c), lambda m: m["kind"] == kind)).cast("long")

    counts = {n: count(k) for n, k in zip(names, KINDS, strict=True)}
    return out.withColumns(counts).withColumn(text_col, new).select(*(f"`{c}`" for c in df.columns), *names)


@query("op6_pii")
def pii(spark, sf_dir):
    """No SQL: DuckDB's patterns know no look-around; tested against a plain version of the networks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, spark.conf.get(KEY_SETTING, TRIAL_KEY)).select("doc_id", *count_columns(docs), "text")
