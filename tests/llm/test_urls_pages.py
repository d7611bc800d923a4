import math

import pytest

from noctua.llm import pages, urls

RULES = urls.RULES


def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    fit = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, key=lambda f: len(f[0]), default=None)
    listed = any(host == b or host.endswith("." + b) for b in urls.BLOCKED_HOSTS)
    return host, path, best and best[0], best[1] if best else ("block" if listed else "allow")


URLS = [None, "", "nothing", "http://", "https://A.Example.NET/en/1?x#y", "http://example.net", "http://example.net/EN/", "ftp://net/", "http://x.org/fr/a",
        "http://www.casino-win.example.com/de/1", "http://casino-win.example.com", "http://notcasino-win.example.com/", "a://b://c/d", "http://u:p@x.net:80/?q",
        "http://É.NET/é", "http://" + "a." * 3000 + "net/" + "p" * 9000, "http://x.net?//y", "http://x.com/de/://"]


@pytest.mark.parametrize("bound", [urls.BROADCAST_BOUND, 0])
def test_rules_and_list(spark, bound):
    df = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string")
    rows = urls.filter_urls(df, broadcast_bound=bound).collect()
    assert len(rows) == len(URLS) + 3
    for r in rows:
        u = (URLS + URLS[:3])[r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == judge(u), u
    assert urls.filter_urls(df.limit(0), broadcast_bound=bound).count() == 0


def test_equal_lengths_go_to_the_longer_host_in_both_forms(spark):
    rules = [("b.com", "/abc", "block"), ("x.b.com", "/a", "allow"), ("com", "/abcde", "block")]
    df = spark.createDataFrame([(1, "http://x.b.com/abcdef"), (2, "http://y.b.com/abc")], "page_id long, url string")
    for bound in (urls.BROADCAST_BOUND, 0):
        got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(df, rules=rules, blocked=[], broadcast_bound=bound).collect()}
        assert got == {1: ("x.b.com/a", "allow"), 2: ("b.com/abc", "block")}


def test_colliding_keys_are_told_apart():
    index = urls.Digests(urls.build_index([(f"h{i}.example", "", "block", 1) for i in range(500)]))
    keys = index.keys.copy()
    keys[:] = keys[0]                         # all keys collide: only the strings decide
    index.keys = keys
    real = urls.xxhash.xxh64_intdigest
    try:
        urls.xxhash.xxh64_intdigest = lambda s: int(keys[0])
        assert (index.probe([b"1:h7.example", b"1:h499.example"]) >= 0).all() and index.probe([b"1:other"])[0] == -1
    finally:
        urls.xxhash.xxh64_intdigest = real


ARTICLE = ('<html><body class="has-sidebar"><header><h1>Site</h1></header><nav>x</nav><div id="cookie-notice">we use</div><article class="post">'
           '<header><h1>T&eacute;st &amp</h1></header><p>a <b>b</b>\n c<p>d<div class=ad>buy</div><aside>zz</aside><ul><li>one<li>two</ul>'
           '<section class="comments"><p>bad</p></section><script>var p="</p>";</script><table><tr><td>x<td>y</table></article><footer>f')


def test_article_blocks():
    assert pages.extract(ARTICLE, frozenset()) == "Tést &\n\na b c\n\nd\n\none\n\ntwo\n\nx\n\ny"
    assert pages.extract("<p>" + "w " * 50000 + "</p>", frozenset()) == ("w " * 50000).strip()
    assert pages.extract("<div>a<!-- c -->b</div><form>q</form><p>t <a", frozenset()) == "ab\n\nt"


def test_template_of_a_host(spark):
    rows = [(i, f"http://h.x/a{i}", f"<body><div class=top>Welcome</div><div class=box><p>story {i}</p><p>same</p></div><div class=x>Bye</div></body>")
            for i in range(6)]
    rows += [(9, None, None), (10, "x", ""), (9, None, None), (11, "http://solo/", ARTICLE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in pages.main_text(df).collect()}
    assert [out[i].text for i in range(6)] == [f"story {i}\n\nsame" for i in range(6)]
    assert out[9].text == "" and out[9].n_chars == 0 and out[10].text == "" and out[11].text.startswith("Tést")
    assert pages.main_text(df).count() == len(rows)
    assert pages.main_text(df.limit(0)).count() == 0


def texts_of(spark, bodies, host="h.x"):
    df = spark.createDataFrame([(i, f"http://{host}/{i}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    return [r.text for r in pages.main_text(df).orderBy("page_id").collect()]


WRAPPERS = ['<div id="page" class="site has-sidebar"><article class="post category-social">%s</article></div>',
            '<div style="overflow:hidden" data-hidden=1 aria-hidden="false"><main>%s</main></div>',
            '<article><h2 id="search-methods">%s</h2></article>',
            '<div class="social" title="class=ad hidden"><div><div role="main">%s</div></div></div>']


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_do_not_swallow_the_article(spark, wrapper):
    assert pages.extract("<body>" + wrapper % "story", frozenset()) == "story"
    assert texts_of(spark, [wrapper % f"story {i}" for i in range(6)] if "search" not in wrapper else
                    [(wrapper % f"story {i}").replace("methods", f"m{i}") for i in range(6)]) == [f"story {i}" for i in range(6)]


def test_listed_words_need_the_template(spark):
    bodies = [f'<article><p>story {i}</p><div class="ad">buy {i}</div><div class="box-related">see {i}</div>'
              f'<section class="comments"><article>reply {i}</article></section><p hidden>no</p>'
              f'<div id="search-{i}">part {i}</div></article>' for i in range(6)]
    assert texts_of(spark, bodies) == [f"story {i}\n\npart {i}" for i in range(6)]


def test_repeated_notice_in_an_article_goes(spark):
    bodies = [f'<article><h1>t{i}</h1><div class="callout"><p>Support us with a coffee</p></div><p>story {i}</p>'
              f'<p class="legal">All prices without tax</p><div class="callout"><p>extra {i}</p></div></article>' for i in range(6)]
    assert texts_of(spark, bodies) == [f"t{i}\n\nstory {i}\n\nextra {i}" for i in range(6)]
    copies = ["<article><p>one</p><ul><li>two</ul></article>"] * 4        # copies keep their text
    assert texts_of(spark, copies) == ["one\n\ntwo"] * 4


def test_all_slots_remain_without_an_article(spark):
    bodies = [f'<div class=top>Welcome to all of you</div><div class=wrap><h1>head {i}</h1><p>lead {i}</p><ul>' + f"<li>a long entry of page {i}" * 30
              + f'</ul><table><tr><td>cell {i}</table><div class=x>Repeated line</div><p>end {i}</p></div><div class=y>Bye</div>' for i in range(6)]
    for i, text in enumerate(texts_of(spark, bodies)):
        parts = text.split("\n\n")
        assert parts[:2] == [f"head {i}", f"lead {i}"] and parts[-2:] == [f"cell {i}", f"end {i}"] and len(parts) == 34


def test_hot_host_is_shared_and_columns_may_clash(spark):
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i}'}.x/{i}", f"<div class=top>Welcome all</div><div class=box><p>story {i}</p></div><div class=x>Bye</div>", i, "t", "k")
            for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _host long, TEXT string, __share string")
    copies = {r.host: r.copies for r in pages.shares(df.select(pages.host_of(df.url).alias("host"))).collect()}
    assert copies["hot.x"] == math.ceil(200 * pages.HOT / 300) and copies["h3.x"] == math.ceil(pages.HOT / 300)
    out = pages.main_text(df)
    assert out.columns == ["page_id", "url", "_host", "__share", "text", "n_chars"]
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == 300 and all(got[i].text == f"story {i}" and got[i]["_host"] == i for i in range(300) if i % 3)
    assert pages.shares(df.limit(0).select(pages.host_of(df.url).alias("host"))).count() == 0
