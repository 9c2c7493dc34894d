import random

from reelframe.llm import url_filter
from tests.llm import brute

PAGES = "page_id long, url string, html string"


def plain(url, rules):
    at = -1 if url is None else url.find("://")
    host = path = ""
    if at >= 0:
        rest, host = url[at + 3 :], ""
        while rest and rest[0] not in "/?#":
            host, rest = host + rest[0], rest[1:]
        host = brute.lower(host)
        while rest and rest[0] not in "?#":
            path, rest = path + rest[0], rest[1:]
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in reversed(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None, key=lambda x: x[:2])
    return host, path, best and best[2], best[3] if best else "allow" if host else "block"


def urls(seed=0):
    rng = random.Random(seed)
    out = [None, "", "no scheme/en/", "://", "http://", "HTTP://EXAMPLE.COM/en/7#a://b", "a://b://c/en/", "http://com/en/", "http://xcom/en/", "http://example.net", "http://a.net/de/8?x=/y", "http://ÉX.COM/en/é", "http://user@h.org:8/es/", "http://a..com//en/", "http://x.com/en"]
    for _ in range(300):
        host = ".".join(rng.choice(["a", "example", "EXAMPLE", "com", "net", "org", ""]) for _ in range(rng.randrange(1, 4)))
        out.append(f"http://{host}/" + "/".join(rng.choice(["en", "de", "es", "7", "77", "8", "", "e"]) for _ in range(rng.randrange(0, 4))) + rng.choice(["", "?q=/en/", "#t"]))
    return out


def test_fixed_rules(spark):
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls())], PAGES)
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages.withColumn("rule", pages.url), url_filter.RULES).collect()}
    assert rows == {k: plain(u, url_filter.RULES) for k, u in enumerate(urls())}


def test_join_and_trie_agree_on_many_rules(spark):
    rng = random.Random(3)
    made = {(".".join(rng.choice(["a", "example", "com", "net"]) for _ in range(rng.randrange(1, 3))), rng.choice(["", "/", "/en", "/en/", "/en/7", "/de/8/", "/en/7/d"])) for _ in range(40)}
    rules = [(rng.choice(["allow", "block"]), h, p) for h, p in sorted(made)]
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls(1))], PAGES)
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    want = {k: plain(u, rules) for k, u in enumerate(urls(1))}
    for most in (1000, 3):
        rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.verdicts(pages, table, most).collect()}
        assert rows == want, {k: (rows[k], want[k], urls(1)[k]) for k in want if rows[k] != want[k]}


def test_empty_table_and_repeats(spark):
    assert url_filter.judge(spark.createDataFrame([], PAGES), url_filter.RULES).collect() == []
    assert len(url_filter.judge(spark.createDataFrame([(None, "http://a.com/en/", None)] * 2, PAGES), url_filter.RULES).collect()) == 2


def test_equal_rules_and_nulls_give_the_same_on_both_paths(spark):
    rules = [("allow", "a.com", "/x"), ("block", "a.com", "/x"), ("block", "b.com", ""), ("allow", "b.com", ""), (None, "a.com", "/x/y"), ("block", None, "/x")]
    made = ["http://a.com/x/y", "http://w.b.com", "http://b.com/?q", "x", None, "://", "http:///x", "http://a.com//x"] * 3
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(made)], PAGES)
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    a, b = (sorted(map(tuple, url_filter.verdicts(pages, table, most).collect())) for most in (100, 1))
    assert a == b and [r[3:] for r in a[:4]] == [("a.com/x", "block"), ("b.com", "block"), ("b.com", "block"), (None, "block")] and a[7][3:] == (None, "allow")


def test_a_key_that_every_url_has_is_joined_by_broadcast(spark):
    pages = spark.createDataFrame([(k, f"http://h{k}.com/d/{k}", None) for k in range(400)], PAGES)
    table = spark.createDataFrame([("block", "com", "/d/1"), ("allow", "h10.com", "/d/10")], "verdict string, host string, path string")
    rows = {r.page_id: r.verdict for r in url_filter.judge_by_join(pages, table).collect()}
    assert rows == {k: "block" if str(k)[0] == "1" and k != 10 else "allow" for k in range(400)}
