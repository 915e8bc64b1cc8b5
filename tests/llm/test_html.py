from pointweave.llm import html

PAGE = "<html><head><title>t</title></head><body><header>top</header><nav><ul><li>menu<li>x</ul></nav><div class='cookie-notice'>ok?</div><article><h1>Caf&eacute; &amp  more</h1><p><b>one<br>\n two</p><p>three<script>x='</p>'</script> four<div class=\"share\">share</div><p>five</article><section id=comments><p>nice</p></section><aside>side</aside><form>f</form><footer>end</footer>"


def test_article(spark):
    rows = [(1, "http://a/1", PAGE), (2, "http://a/2", None), (3, None, ""), (4, "http://a/1", "<p>just text &lt;b&gt;</p>tail <a"), (1, "http://a/1", PAGE), (5, "http://z/", "<article><p>" + "w " * 200000)]
    got = html.extract(spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, text string")).collect()
    want = {1: "Café & more\none two\nthree four\nfive", 2: "", 3: "", 4: "just text <b>\ntail", 5: ("w " * 200000).strip()}
    assert sorted(r.page_id for r in got) == [1, 1, 2, 3, 4, 5]
    for r in got:
        assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id]))
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_without_article(spark):
    page = lambda k: f"<body><div class=top>Daily</div><div class=story><p>Body {k} long text here</p><div class=x>Click me</div></div><div class=low>Extra {k}</div></body>"
    rows = [(k, f"http://h/{k}", page(k)) for k in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = [f"Body {k} long text here" for k in range(5)]
    assert [r.text for r in html.extract(df).orderBy("page_id").collect()] == want
    before, html.BROADCAST_HOSTS = html.BROADCAST_HOSTS, 0
    try:
        assert [r.text for r in html.extract(df).orderBy("page_id").collect()] == want
    finally:
        html.BROADCAST_HOSTS = before


def texts(spark, rows):
    df = spark.createDataFrame([(k, f"http://h.org/{k}", p) for k, p in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in html.extract(df).orderBy("page_id").collect()]


def test_wrapper_yields_the_story_alone(spark):
    page = lambda k: f"<html><head><title>T{k}</title></head><body><div class=wrap><div class=top>Daily {k}</div><div class=story><p>Body {k} and some more words</p><p>Second {k * 7}</p></div><div class=low>Extra {k}</div></div></body></html>"
    assert texts(spark, [page(k) for k in range(6)]) == [f"Body {k} and some more words\nSecond {k * 7}" for k in range(6)]


def test_order_that_changes_breaks_a_class(spark):
    """The story stands before or after the side box: no order, but the story encloses valid groups and stays a slot."""
    story = lambda k: f"<div class=story><div class=x><p>Body {k} and some more words</p></div><div class=y>more {k}</div></div>"
    side = lambda k: f"<div class=box>Side {k}</div>"
    page = lambda k: f"<title>T{k}</title><body>{story(k) + side(k) if k % 2 else side(k) + story(k)}</body>"
    assert texts(spark, [page(k) for k in range(6)]) == [f"Body {k} and some more words" for k in range(6)]


def test_roles_never_take_the_article(spark):
    inner = "<article><h1 class='entry-header'>Head</h1><div class='social-science'><p>One</p></div><div class='share'>tweet</div><section class='site-comments'><article class=comment><p>nice</p></article></section></article>"
    for wrap in ("<form action=x>{}</form>", "<div class='content-sidebar-wrap'>{}</div>", "<div id=page class='has-sidebar'>{}</div>", "<div class='sidebar'>{}</div>", "<body><header><p>top</p></header>{}<aside><article>teaser</article></aside></body>"):
        assert texts(spark, [wrap.format(inner)]) == ["Head\nOne"], wrap
    assert texts(spark, ["<form><p>all the text of a page</p></form><footer>x</footer>"]) == ["all the text of a page"]
    assert texts(spark, ["<nav>menu alone that is long</nav><p>x</p>"]) == ["x"]


def test_copies_are_no_template(spark):
    """Copies of a page, and near copies, keep all their text; shared prose within articles too."""
    same = "<title>A</title><article><h1>A</h1><p>one two</p><p>three</p></article>"
    other = "<title>B</title><article><h1>B</h1><p>four</p></article>"
    assert texts(spark, [same] * 4 + [other]) == ["A\none two\nthree"] * 4 + ["B\nfour"]
    note = lambda k: f"<title>{k}</title><article><p>Read our terms.</p><p>text {k}</p><div class=b>Click</div></article>"
    assert texts(spark, [note(k) for k in range(5)]) == [f"Read our terms.\ntext {k}" for k in range(5)]


def test_classes_against_brute_force(spark):
    r = __import__("random").Random(5)
    pages = []
    for k in range(60):
        host = f"h{r.randrange(4)}.org"
        body = "".join(r.choice(["<div class=a>fix</div>", f"<div class=a>{k}</div>", "<div><p>x</p></div>", "<ul><li>m<li>n</ul>", "<section><div class=q>deep</div></section>", ""]) for _ in range(r.randrange(1, 6)))
        pages.append((k, f"http://{host}/{k}", f"<title>{r.randrange(9)}</title><body>{body}</body>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(x.host, x.token, x.text): x for x in html.classes(df).collect()}
    want, by_host = {}, {}
    for _, url, page in pages:
        by_host.setdefault(html.host_key(url), []).append(html.Page(page))
    for host, many in by_host.items():
        vector, upper, titles = {}, {}, {}
        for n, p in enumerate(many):
            for token, up, text in [(p.token[k], p.token[p.up[k]], False) for k in range(1, len(p.tag))] + [(p.text_token(i), p.token[k], True) for i, (k, _) in enumerate(p.texts)]:
                vector.setdefault((token, text), []).append(n)
                upper[token, text] = up
                titles.setdefault((token, text), set()).add(p.title())
        for (token, text), v in vector.items():
            boxed = text and vector.get((upper[token, text], False)) == v
            if len(v) >= max(2, html.SUPPORT * len(many)) and len(set(v)) == len(v) and (not text or boxed):
                want[host, html._signed(token), text] = boxed and len(titles[token, text]) > 1 and len(v) >= max(3, len(many) / 2)
    assert {k: x.fixed for k, x in got.items()} == want and any(want.values())
    vectors = {}
    for (host, token, text), x in got.items():
        vectors.setdefault((host, x.vector), set()).add(x.pages)
    assert all(len(n) == 1 for n in vectors.values())
    before, html.BROADCAST_TOKENS = html.BROADCAST_TOKENS, 0
    try:
        joined = sorted((r.page_id, r.text) for r in html.extract(df).collect())
    finally:
        html.BROADCAST_TOKENS = before
    assert joined == sorted((r.page_id, r.text) for r in html.extract(df).collect())
