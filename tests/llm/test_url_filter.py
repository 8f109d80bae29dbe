from tracewright.llm.url_filter import RULES, url_filter

SCHEMA = "page_id long, url string, host string"
ROWS = [
    (1, "http://A.net/x?y#z", "old"), (2, "https://example.net/en/1", None), (3, "https://www.example.net/en", None), (4, "http://b.example.com/de/", None),
    (5, "http://x.org/fr/a", None), (6, None, None), (7, "no scheme", None), (8, "", None), (9, "http://net", None), (10, "http://net?a=/b", None),
    (11, "http://example.net/enx/", None), (12, "http://notnet/", None), (13, "x://y.net/a://b", None), (14, "http://sub.org/fr/", None), (14, "http://sub.org/fr/", None), (15, "://.net/" + "a/" * 5000, None),
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    for c in "?#":
        rest = rest.split(c, 1)[0]
    host, slash, path = rest.partition("/")
    host, path = host.lower(), slash + path
    fits = [(len(h), len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_both_ways_match_plain_rules(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = sorted([(r[0], *plain(r[1])) for r in ROWS], key=str)
    table = spark.createDataFrame(RULES, "h string, p string, v string")
    for rules, bound in ((RULES, 1 << 20), (table, 1 << 20), (table, 0)):
        got = url_filter(df, rules, broadcast_bytes=bound).select("page_id", "host", "path", "rule", "verdict").collect()
        assert sorted([tuple(r) for r in got], key=str) == want


def test_any_column_names(spark):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in ROWS], SCHEMA + ", v int, best int, c0 int, rule_host int")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("net", None, "block")], "h string, p string, v string")
    for bound in (1 << 20, 0):
        out = url_filter(df, rules, broadcast_bytes=bound)
        assert out.columns == ["page_id", "url", "v", "best", "c0", "rule_host", "host", "path", "rule", "verdict"]
        assert sorted([(r.page_id, r.v, r.rule, r.verdict) for r in out.collect()], key=str) == sorted([(i, 1, *plain(u)[2:]) for i, u, _ in ROWS], key=str)


def test_prefix_inside_a_segment_and_ties(spark):
    rules = [("a.com", "/x/fo", "allow"), ("a.com", "/x/fo", "block"), ("a.com", "/x/foo/b", "allow"), ("a.com", "", "block")]
    urls = ["http://a.com/x/foobar", "http://a.com/x/foo/bar", "http://a.com", "http://a.com/x/f"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], SCHEMA)
    want = ["a.com/x/fo block", "a.com/x/foo/b allow", "a.com block", "a.com block"]
    for bound in (1 << 20, 0):
        got = url_filter(df, spark.createDataFrame(rules, "h string, p string, v string"), broadcast_bytes=bound).orderBy("page_id").collect()
        assert [f"{r.rule} {r.verdict}" for r in got] == want


def test_empty_table(spark):
    assert url_filter(spark.createDataFrame([], SCHEMA), RULES).collect() == []
