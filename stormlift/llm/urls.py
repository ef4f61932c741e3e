"""URL filters: host and path rules, and association rules mined from what they decide."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormlift.llm.common import ascii_lower, fresh, keep, query, table

#: Fixed values of the contract: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Copies of one token set that a task hands to FP-growth at a time.
CHUNK = 10_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    ]
    return F.coalesce(*fits)


def url_items(url: Column, host: Column, path: Column) -> Column:
    """The tokens of a url, each once: host labels by level, path parts by depth, query keys. Numbers in paths become #."""
    labels = F.reverse(F.split(host, r"\.", -1))
    parts = F.filter(F.split(path, "/", -1), lambda p: p != "")
    rest = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.regexp_extract_all(rest, F.lit(r"(?:^|&)([^=&]+)"), 1), lambda k: F.concat(F.lit("key="), k))
    items = F.concat(
        F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x)),
        F.transform(parts, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), F.regexp_replace(x, r"\d+", "#"))),
        keys,
    )
    return F.array_sort(F.array_distinct(F.coalesce(items, F.array().cast("array<string>"))))


def token_classes(sets: DataFrame, need: int, min_confidence: float) -> DataFrame:
    """(token, class, n, strong) of the tokens that ``need`` blocked urls hold, from (items, n, blocked).

    Tokens of exactly the same labelled urls say the same, so they are one class, named by its first
    token. A strong class implies "blocked" alone. No more than (tokens of an average url) / min_support
    rows, whatever the table.
    """
    held = sets.select(F.explode("items").alias("token"), "n", "blocked", F.xxhash64("items").alias("h"), F.xxhash64(F.lit(7), "items").alias("g"))
    counted = held.groupBy("token").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g")).where(F.col("blocked") >= need)
    same = counted.groupBy("n", "blocked", "h", "g").agg(F.collect_list("token").alias("tokens"))
    strong = F.col("blocked") / F.col("n") >= min_confidence
    return same.select(F.explode("tokens").alias("token"), F.array_min("tokens").alias("class"), "n", strong.alias("strong"))


def held_classes(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``sets`` (items, ...) that hold a class, with the classes ``held`` and those of them that are not strong, rarest first."""
    known = sets.select("items", F.explode("items").alias("token")).join(classes, "token")
    held = known.groupBy("items").agg(F.array_sort(F.collect_set(F.struct("n", "class", "strong"))).alias("c"))
    weak = F.filter("c", lambda x: ~x["strong"])
    held = held.select("items", F.transform("c", lambda x: x["class"]).alias("held"), F.transform(weak, lambda x: x["class"]).alias("weak"))
    return sets.join(held, "items")


def _combinations(held: DataFrame, need: int) -> DataFrame:
    """Combinations of two weak classes and more that ``need`` blocked urls hold: (antecedent, both), by FP-growth.

    Only blocked urls are transactions. A token set of many urls is dealt out before it is repeated.
    """
    sets = held.where((F.col("blocked") > 0) & (F.size("weak") > 1))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocked") - 1) / CHUNK)))
    dealt = sets.select("weak", "blocked", chunk.alias("chunk")).repartition("weak", "chunk")
    times = F.least(F.lit(CHUNK).cast("long"), F.col("blocked") - F.col("chunk") * CHUNK)
    shopped = dealt.select(F.col("weak").alias("items"), F.explode(F.sequence(F.lit(1).cast("long"), times))).select("items")
    n = sets.agg(F.sum("blocked")).first()[0] or 0
    if n < need:
        return held.sparkSession.createDataFrame([], "antecedent array<string>, both long")
    frequent = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / n).fit(shopped).freqItemsets
    return frequent.where(F.size("items") > 1).select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("both"))


def mine_block_rules(items: DataFrame, min_support: float = 0.002, min_confidence: float = 0.9) -> tuple[DataFrame, DataFrame] | None:
    """Association rules "these tokens, so blocked" from labelled urls (items, blocked).

    Support is the share of labelled urls that hold the antecedent and are blocked, confidence their
    share of those that hold it. Returns the rules (antecedent, anchor, confidence) over token classes,
    anchored at the class that fewest urls hold, and the classes; None if no token has the support.
    Pruning loses no verdict: tokens below the support are in no rule, a class that is strong alone
    makes any longer rule with it needless, and so does a shorter combination that is strong.
    """
    sets = keep(items.groupBy("items").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("blocked")), "url_sets")
    need = max(1, math.ceil(min_support * (sets.agg(F.sum("n")).first()[0] or 0)))
    classes = keep(token_classes(sets, need, min_confidence), "url_classes")
    if classes.isEmpty():
        return None
    held = keep(held_classes(sets, classes), "url_held")
    both = keep(_combinations(held, need), "url_combinations")
    sizes = classes.select(F.col("class").alias("item"), "n").distinct()
    ranked = both.select("antecedent", "both", F.explode("antecedent").alias("item")).join(sizes, "item")
    anchored = ranked.groupBy("antecedent", "both").agg(F.min(F.struct("n", "item"))["item"].alias("anchor"))
    places = held.select("weak", "n", F.explode("weak").alias("anchor"))
    seen = places.join(anchored, "anchor").where(F.size(F.array_except("antecedent", "weak")) == 0)
    strong = seen.groupBy("antecedent", "both", "anchor").agg(F.sum("n").alias("n")).select("antecedent", "anchor", (F.col("both") / F.col("n")).alias("confidence")).where(F.col("confidence") >= min_confidence)
    longer = strong.select(F.col("antecedent").alias("longer"), F.explode("antecedent").alias("anchor"))
    shorter = strong.select(F.col("antecedent").alias("shorter"), "anchor")
    implied = longer.join(shorter, "anchor").where((F.size("shorter") < F.size("longer")) & (F.size(F.array_except("shorter", "longer")) == 0)).select(F.col("longer").alias("antecedent")).distinct()
    alone = sets.select(F.explode("items").alias("token"), "n", "blocked").join(classes.where("strong AND token = class").select("token"), "token")
    alone = alone.groupBy("token").agg((F.sum("blocked") / F.sum("n")).alias("confidence")).select(F.array("token").alias("antecedent"), F.col("token").alias("anchor"), "confidence")
    return strong.join(implied, "antecedent", "left_anti").select("antecedent", "anchor", "confidence").unionByName(alone), classes


def filter_urls(df: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, min_support: float = 0.002, min_confidence: float = 0.9) -> DataFrame:
    """``df`` with host, path, rule and verdict of every url, in columns named by ``verdict_columns``.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins. Urls
    without a rule are judged by association rules over url tokens, mined from the urls that a rule
    decides, block against allow: blocked if the tokens hold all of an antecedent, found through an
    inverted index on its rarest token; otherwise allowed. Urls with the same tokens are judged once.

    Defined cases: a null url, or one without ``://``, has empty host and path and no tokens but an empty
    host label, so only the default applies; long urls keep all their tokens; where no rule decides a
    url, all are allowed; repeated rows are judged alike; an empty table stays empty.
    """
    host_c, path_c, rule_c, verdict_c = verdict_columns(df)
    items_c = fresh(df, "url_items")
    host, path = host_and_path(F.col(url_col))
    judged = df.withColumn(host_c, host).withColumn(path_c, path).withColumn(rule_c, rule_of(F.col(host_c), F.col(path_c), rules))
    decided = F.col(f"{rule_c}.verdict")
    judged = judged.withColumn(items_c, url_items(F.col(url_col), F.col(host_c), F.col(path_c)))
    mined = mine_block_rules(judged.where(F.col(rule_c).isNotNull()).select(F.col(items_c).alias("items"), (decided == "block").alias("blocked")), min_support, min_confidence)
    mined_c = fresh(judged, "mined")
    if mined is None:
        out = judged.withColumn(mined_c, F.lit(None).cast("string"))
    else:
        asked = held_classes(judged.where(F.col(rule_c).isNull()).select(F.col(items_c).alias("items")).distinct(), mined[1])
        index = asked.select("items", "held", F.explode("held").alias("anchor"))
        hits = index.join(mined[0], "anchor").where(F.size(F.array_except("antecedent", "held")) == 0).select(F.col("items").alias(items_c)).distinct()
        out = judged.join(hits.withColumn(mined_c, F.lit("block")), items_c, "left")
    verdict = F.coalesce(decided, F.col(mined_c), F.lit("allow"))
    return out.withColumn(verdict_c, verdict).withColumn(rule_c, F.col(f"{rule_c}.rule")).select(*(f"`{c}`" for c in df.columns), host_c, path_c, rule_c, verdict_c)


def verdict_columns(df: DataFrame) -> tuple[str, str, str, str]:
    return tuple(fresh(df, c) for c in ("host", "path", "rule", "verdict"))


def _rule_sql(what: str) -> str:
    """The longest fitting rule's text or verdict, as a chain of cases."""
    cases = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what == 'rule' else v}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    return f"CASE {' '.join(cases)} END"


#: The mined rules by counting every subset of every url's tokens that have the support.
SQL = f"""
WITH s AS (
  SELECT row_number() OVER () AS rid, page_id, url,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM s
), p AS (
  SELECT rid, page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), r AS (
  SELECT *, {_rule_sql("rule")} AS rule, {_rule_sql("verdict")} AS decided,
         list_reverse(string_split(host, '.')) AS labels, [x FOR x IN string_split(path, '/') IF x <> ''] AS parts,
         regexp_extract_all(regexp_extract(coalesce(url, ''), '\\?([^#]*)', 1), '(?:^|&)([^=&]+)', 1) AS keys FROM p
), i AS (
  SELECT rid, page_id, host, path, rule, decided, list_sort(list_distinct(list_concat(list_concat(
           ['host' || (n - 1) || '=' || labels[n] FOR n IN range(1, len(labels) + 1)],
           ['path' || (n - 1) || '=' || regexp_replace(parts[n], '\\d+', '#', 'g') FOR n IN range(1, len(parts) + 1)]),
           ['key=' || k FOR k IN keys]))) AS items FROM r
), need AS (
  SELECT ceil(0.002 * count(*)) AS least FROM i WHERE decided IS NOT NULL
), useful AS (
  SELECT coalesce(list(token), []) AS tokens FROM (
    SELECT token FROM i, unnest(items) AS t(token) WHERE decided = 'block' GROUP BY token HAVING count(*) >= (SELECT least FROM need))
), sets AS (
  SELECT [x FOR x IN items IF list_contains(tokens, x)] AS items, decided, count(*) AS n, list(rid) AS rids FROM i, useful GROUP BY 1, 2
), sub AS (
  SELECT rids, decided, n, [items[k] FOR k IN range(1, len(items) + 1) IF ((m >> (k - 1)) & 1) = 1] AS held
  FROM sets, unnest(range(1, CAST(pow(2, len(items)) AS BIGINT))) AS u(m)
), strong AS (
  SELECT held FROM sub WHERE decided IS NOT NULL GROUP BY held
  HAVING sum(CASE WHEN decided = 'block' THEN n ELSE 0 END) >= (SELECT least FROM need)
     AND sum(CASE WHEN decided = 'block' THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) >= 0.9
), hit AS (
  SELECT DISTINCT unnest(rids) AS rid FROM sub JOIN strong USING (held) WHERE decided IS NULL
)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN hit.rid IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM i LEFT JOIN hit ON i.rid = hit.rid
"""


@query("op4_url_filter", SQL)
def url_filter(spark, sf_dir):
    """Every page's url, by the contract's rules and the mined ones."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
