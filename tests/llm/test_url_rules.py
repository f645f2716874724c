import random

from cuewright.llm import urlfilter


def test_many_rules_as_list_table_and_join(spark):
    made = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "org", "x.org", "", "co.uk"]
    part = lambda: "".join(made.choices(["/", "f", "fr", "x1", "%", "."], k=made.randrange(1, 6)))
    rules = [(made.choice(["allow", "block"]), made.choice(hosts), "/" + part()) for _ in range(150)] + [("block", "com", ""), ("allow", "com", ""), ("allow", "x.org", "/"), ("block", "x.org", "/")]
    urls = [None, "", "no scheme", "http://"] + [f"http://{made.choice(['', 'www.', 'A.'])}{made.choice(hosts)}/{part()}{made.choice(['', '?q', '#f'])}" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://com/"), (5, urls[5])], "page_id long, url string").selectExpr("*", "'h' as host", "1 as n", "2 as salt", "'r' as rule")

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]
        fits = [(len(h.split(".")), len(p), v == "block", h + p, v) for v, h, p in rules if path.startswith(p) and (host == h or host.endswith("." + h))]
        *_, rule, verdict = max(fits, default=(None, "allow"))
        return host, path, rule, verdict

    want = sorted(str((i, *brute(u))) for i, u in [*enumerate(urls), (None, "http://com/"), (5, urls[5])])
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    for given, limit in ((rules, 500_000), (table, 500_000), (rules, 0), (table, 10)):
        got = urlfilter.judge(pages, given, max_trie=limit).select("page_id", "host", "path", "rule", "verdict").collect()
        assert sorted(str(tuple(r)) for r in got) == want
