from pointweave.llm.urls import judge


def test_rules_and_list(spark):
    cases = {
        "https://www.example.com/en/1?x": ("www.example.com/en/", "allow"),
        "https://a.example.com/en/1": ("example.com/en/", "block"),
        "https://a.example.com/de": ("com/", "allow"),
        "https://a.net/es/1": ("net/es/", "block"),
        "https://m.spam-farm.example.org/x#y": (None, "block"),
        "https://ok.example.org": (None, "allow"),
        "https://A.COM": (None, "allow"),
        "nothing": (None, "allow"),
        None: (None, "allow"),
        "": (None, "allow"),
    }
    rows = [(k, u, "h") for k, u in enumerate(cases)] * 2
    got = judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    urls = list(cases)
    for r in got:
        assert (r.rule, r.verdict) == cases[urls[r.page_id]], r
    assert judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_list_from_a_table_against_brute_force(spark):
    """A long list sizes the filter; what it lets pass wrongly the exact join removes; pages and sites are listed."""
    from pyspark.sql import functions as F

    from pointweave.llm import urls

    r = __import__("random").Random(2)
    listed = {f"s{k}.example.org/" for k in range(0, 4000, 3)} | {f"s{k}.example.org/a/b{k % 7}" for k in range(1, 4000, 3)}
    hosts = [f"{r.choice(['', 'www.', 'm.', 'x.'])}s{r.randrange(4100)}.example.org" for _ in range(3000)] + ["www.org", "m.org"]
    pages = [(k, f"http://{h}{r.choice(['', '/', f'/a/b{r.randrange(7)}', f'/a/b{r.randrange(7)}/', '/index.html', '/a/b1?x=1#y', '/' + 'long/' * 2000])}") for k, h in enumerate(hosts)]

    def canon(url):
        host, _, path = url.split("://")[1].split("#")[0].split("?")[0].partition("/")
        for w in ("www.", "m."):
            if host.startswith(w) and "." in host[len(w) :]:
                host = host[len(w) :]
                break
        path = "/" + path
        if path.endswith("/index.html"):
            path = path[:-10]
        return host, path.strip("/")

    frame = spark.createDataFrame([(x,) for x in [*listed, None, "dup.example.org/", "dup.example.org/"]], "key string")
    for blocks in (None, 1, 5):
        got = {x.page_id: x.verdict for x in judge(spark.createDataFrame(pages, "page_id long, url string"), rules=(), listed=frame, blocks=blocks).collect()}
        want = {k: "block" if (c := canon(u))[0] + "/" in listed or "/".join(c) in listed else "allow" for k, u in pages}
        assert got == want and 300 < sum(v == "block" for v in want.values()) < 2900
    many = spark.range(1 << 18).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".org/")).alias("key"))
    keys = spark.range(0, 1 << 19, 4).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".org/")).alias("key"))
    before, urls.BROADCAST_BLOCKS = urls.BROADCAST_BLOCKS, 1
    try:
        assert urls.listed_hits(keys, many, 1 << 16).count() == 1 << 16
    finally:
        urls.BROADCAST_BLOCKS = before
    assert urls.listed_hits(keys, many, 1 << 16).count() == 1 << 16


def test_ties_and_long_urls(spark):
    rules = (("a.org/", "block"), ("a.org/", "block"), ("org/x/", "allow"), ("b.org/", "block"))
    rows = [(1, "http://a.org/" + "y" * 100000), (2, "http://a.org/x/1"), (3, "http://c.org/x/"), (4, "HTTP://B.ORG"), (5, "http://b.org/")]
    got = {r.page_id: (r.rule, r.verdict, len(r.path)) for r in judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert got == {1: ("a.org/", "block", 100001), 2: ("org/x/", "allow", 4), 3: ("org/x/", "allow", 3), 4: (None, "allow", 0), 5: ("b.org/", "block", 1)}
