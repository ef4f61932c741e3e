"""URL filter against plain parsing, plain rules and itemsets counted one by one."""

import math
import random
from itertools import combinations

from stormlift.llm import urls


def plain_parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def given():
    rng = random.Random(7)
    hosts = ["a.example.com", "WWW.example.com", "www.example.com", "b.www.example.com", "example.com", "x.net", "net", "y.z.net", "q.org", "bad.org", "com", "notexample.com", "telecom", ""]
    made = [f"http://{rng.choice(hosts)}{rng.choice(['/en/', '/es/', '/fr/', '/EN/', '/', '', '/en'])}{rng.choice(['', '12', '7.html'])}{rng.choice(['', '?a=1&b', '#t', '?u=/x://y'])}" for _ in range(300)]
    made += [f"https://spam{i % 3}.net/{'es' if i % 20 else 'de'}/pills/{i}" for i in range(80)]
    return made + [None, "", "no scheme", "://", "x://h?q#f/", "http://é.com/en/", "http://a.example.com/en/1", "http://a.example.com/en/1"]


def test_equals_plain(spark):
    texts = given()
    df = spark.createDataFrame([(i, u, "p", 3) for i, u in enumerate(texts)], "page_id long, url string, host string, rule int")
    rows = urls.filter_urls(df, min_support=0.02).collect()
    assert rows[0].__fields__ == ["page_id", "url", "host", "rule", "_host", "path", "_rule", "verdict"]
    assert len(rows) == len(texts)
    items = {r["page_id"]: set(r["items"]) for r in df.select("page_id", urls.url_items(df["url"], *urls.host_and_path(df["url"])).alias("items")).collect()}
    verdict = {i: plain_rule(*plain_parse(u))[1] for i, u in enumerate(texts)}
    seen, blocked = {}, {}
    labelled = [i for i in items if verdict[i]]
    for i in labelled:
        for n in range(1, len(items[i]) + 1):
            for c in combinations(sorted(items[i]), n):
                seen[c] = seen.get(c, 0) + 1
                blocked[c] = blocked.get(c, 0) + (verdict[i] == "block")
    strong = [set(c) for c in seen if blocked[c] >= math.ceil(0.02 * len(labelled)) and blocked[c] / seen[c] >= 0.9]
    mined = 0
    for r in rows:
        host, path = plain_parse(texts[r["page_id"]])
        rule, decided = plain_rule(host, path)
        want = decided or ("block" if any(s <= items[r["page_id"]] for s in strong) else "allow")
        assert (r["_host"], r["path"], r["_rule"], r["verdict"]) == (host, path, rule, want), texts[r["page_id"]]
        mined += decided is None and want == "block"
    assert mined >= 4


def test_empty_and_undecided_tables(spark):
    df = spark.createDataFrame([(1, "http://q.org/a"), (2, None)], "page_id long, url string")
    assert [r["verdict"] for r in urls.filter_urls(df).collect()] == ["allow", "allow"]
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_long_urls_keep_all_tokens(spark):
    """The telling token is the fifteenth path part; sixty tokens that always come together are one class."""
    deep = "/".join(f"p{'x' * i}" for i in range(14))
    tail = "/".join(f"t{'y' * i}" for i in range(30)) + "?" + "&".join(f"k{i}=1" for i in range(30))
    made = [f"http://example.com/en/{deep}/bad/{tail}"] * 150 + [f"http://a.com/fr/{deep}/good/{tail}"] * 150
    made += [f"http://else.org/xx/{deep}/bad/", f"http://else.org/xx/{deep}/good/", f"http://else.org/{deep}/bad/"]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    rows = {r["page_id"]: r["verdict"] for r in urls.filter_urls(df, min_support=0.1).collect()}
    assert {rows[i] for i in range(150)} == {"block"} and {rows[i] for i in range(150, 300)} == {"allow"}
    assert [rows[i] for i in (300, 301, 302)] == ["block", "allow", "allow"]


def test_combination_and_a_common_set(spark):
    """Neither token alone is strong, both together are; one token set is held by most urls."""
    rules = (("block", "x.org", "/a/b/"), ("allow", "x.org", "/"), ("allow", "y.org", "/"))
    made = ["http://x.org/a/b/1"] * 25_000 + ["http://x.org/a/c/1"] * 9000 + ["http://y.org/z/b/1"] * 9000
    made += ["http://q.net/a/b/7", "http://q.net/a/c/7", "http://q.net/z/b/7"]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    rows = [r["verdict"] for r in urls.filter_urls(df, rules=rules).orderBy("page_id").collect()]
    assert rows[-3:] == ["block", "allow", "allow"]
    assert rows.count("block") == 25_001
