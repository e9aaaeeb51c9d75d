from tidelog.llm import pages as P


def text(page, gone=frozenset()):
    root = P._tree(page)
    list(P.hashed(root))
    return P.main_text(root, gone)


def test_furniture_and_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>m</ul></nav>
    <!-- ad --><div class="ad">buy</div><article><h1>Head&amp;line</h1><p><b>One  two.<br><p>Th<i>r</i>ee&nbsp;&lt;4&gt;
    &am x</p><aside>side</aside><form>f</form><div class="cookie-notice">n</div><script>var t="</p>";</script>
    <section id="comments"><p>me too</p></section><p>end</article><footer>&copy;</footer></body></html>"""
    assert text(page) == "Head&line One two. Three <4> &am x end"


def test_odd_pages():
    assert text("") == "" and text("plain & simple") == "plain & simple"
    assert text("<p>a<p>b</b></p>c") == "a b c"
    assert text("<article>a<script>x") == "a" and text("a < b <3 <") == "a < b <3 <"
    assert text("<main><div hidden>h</div>m</main><p>n") == "m"
    assert text("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert text("<p title='a>b'>q</p>") == "q"


def test_templates(spark):
    page = "<html><body><div>Welcome to our site</div><p>Text {0} of page.</p><div><p>Call us</p></div></body></html>"
    rows = [(i, f"https://a.example/{i}", page.format(i)) for i in range(20)] + [(99, "https://b.example/", page.format(99)), (100, None, None), (100, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for rule in (P.Rule(), P.Rule(most=0)):
        out = {(r.page_id, r.url): r.text for r in P.extract(pages, rule=rule).collect()}
        assert len(out) == 23 - 0
        assert out[3, "https://a.example/3"] == "Text 3 of page."
        assert out[99, "https://b.example/"] == "Welcome to our site Text 99 of page. Call us"
        assert out[100, None] == "" == out[100, ""]
    assert P.extract(pages.limit(0)).count() == 0


def test_article_text_that_recurs_stays(spark):
    page = "<body><article><h1>Same</h1><p>Is.</p><div><span>box</span></div></article></body>"
    pages = spark.createDataFrame([(i, "http://h/x", page) for i in range(30)], "page_id long, url string, html string")
    assert {(r.text, r.n_chars) for r in P.extract(pages).collect()} == {("Same Is.", 8)}


def test_templates_of_a_part_of_a_large_host(spark):
    section = lambda k: "<div>Part of the archive</div>" if k < 220 else "<div>Only here</div>" if k < 240 else ""
    rows = [(k, f"https://big.example/{k}", f"<body>{section(k)}<p>Text {k}.</p></body>") for k in range(5000)]
    rows += [(9000 + k, "https://big.example/copy", "<body><div>Copied box</div><p>Same text.</p></body>") for k in range(220)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in P.extract(pages).collect()}
    assert out[7] == "Text 7." and out[230] == "Only here Text 230." and out[4999] == "Text 4999."
    assert out[9007] == "Copied box Same text."


def test_text_outside_of_articles():
    assert text("<p>Lead</p><article>Teaser</article><p>Rest</p>") == "Lead Teaser Rest"
    assert text('<div role="main"><p>One</div><div>x</div><div role="main">Two</div>') == "One Two"
    assert text("<form action=x><h1>Head</h1><p>All the page.</p><input></form>") == "Head All the page."
    assert text("<p>Long text of the page that is no form.</p><form>Search <p>me</p></form>") == "Long text of the page that is no form."
    assert text('<article><p class="market-share">Kept</p><p class="share-buttons">Gone</p><p class="siteFooter">Gone</p></article>') == "Kept"
    assert text('<article><p>Text.</p><div class="x"><a href=1>One</a> <a href=2>Two</a> | <a href=3>Three</a></div></article>') == "Text."
    assert text('<article><p>See <a href=1>one</a>, <a>two</a> and <a>three</a> of a much longer text, with links in it.</p></article>').startswith("See one, two and three")
    assert text('<div class="sidebar widget"><article>In it</article></div>') == "In it"
    assert text("<aside><article>Related</article></aside><p>Page</p>") == "Page"


def test_hostile_pages_take_linear_time():
    import time

    n = 250_000
    for page in ('<a "' * n, "<a '" * n + ">", "<div>" * (n // 2) + "</section>" * (n // 2), "<p><b>" * (n // 3), "<" * 4 * n, "<!--" * n, '<a href="x>' * n, "<script>" * (n // 4), "&" * 4 * n):
        began = time.perf_counter()
        P.parse(page)
        assert time.perf_counter() - began < 6, page[:12]
    assert text('<p title="1>2">a</p><a "b>c</a><i>d</i>') == "a cd"


def counted(rows, rule):
    """Which subtrees recur, by brute force: {(host, hash, inside)}."""
    seen, contents, total, everywhere = {}, {}, {}, {}
    for _, url, page in rows:
        host, root = P.host_of(url), P._tree(page)
        words = P.main_text(root)
        total[host] = total.get(host, 0) + 1
        for s in P._found(root, rule.words):
            seen[host, *s] = seen.get((host, *s), 0) + 1
            contents.setdefault((host, *s), set()).add(words)
            everywhere[s] = everywhere.get(s, 0) + 1
    out = set()
    for (host, h, inside), n in seen.items():
        different = len(contents[host, h, inside])
        if n >= rule.least and (n >= rule.share * total[host] or different >= rule.enough):
            if not inside or different >= rule.least and everywhere[h, inside] - n <= rule.elsewhere * n:
                out.add((host, h, inside))
    return out


def test_templates_decide(spark):
    """Without the template step these pages keep their site's lines, in the article and out of it."""
    import random

    rng = random.Random(1)
    word = lambda: rng.choice(["sea", "stone", "river", "light", "wind", "ship", "gold", "salt"])
    prose = lambda k: " ".join(word() for _ in range(k))
    passage, rows, want = "A passage that many sites quote in full.", [], {}
    for k in range(120):
        host = f"h{k % 3}.example"
        body = [prose(9) for _ in range(3)] + ([passage] if k % 2 else [])
        paragraphs = "".join(f"<p>{b}</p>" for b in body)
        extra = f"<p>Read more from host number {k % 3} every day.</p>"
        page = f"<body><div>Welcome to site {k % 3}, the best</div><article><h1>{prose(3)} {k}</h1>{paragraphs}{extra}</article><p>Write to us at {host}</p></body>"
        want[k] = " ".join(page.split("<h1>")[1].split("</h1>")[0:1] + body)
        rows.append((k, f"http://{host}/{k}", page))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in P.extract(pages).collect()}
    assert got == want
    assert got == {r.page_id: r.text for r in P.extract(pages, rule=P.Rule(most=0)).collect()}
    plain = {k: text(page) for k, _, page in rows}
    assert all(plain[k] != want[k] for k in want)
    for rule in (P.Rule(), P.Rule(least=3, share=0.02, elsewhere=0.5)):
        found = {(r.host, r.subtree, r.inside) for r in P.recurring(pages, rule).collect()}
        assert found == counted(rows, rule) and found


def test_repeated_ids_clashing_columns_and_long_pages(spark):
    long = "<article>" + "<p>word word</p>" * 100_000 + "</article>"
    rows = [(1, "http://a/", "<p>x</p>", "c"), (1, "http://a/", "<p>x</p>", "c"), (1, None, "<p>y</p>", "c"), (None, None, None, None), (2, "http://b/", long, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.n_chars) for r in P.extract(pages).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (1, 1), (None, 0), (2, 10 * 100_000 - 1)], key=str)
