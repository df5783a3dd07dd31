import re
from html import unescape

from cairn.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><div id="cookie-notice">We use cookies</div>
<header><h1>Site</h1></header><nav><ul><li>Menu<li>More</ul></nav><script>var t="</p><article>no</article>";</script>
<main><article class="post"><header><h1>Title &amp; more</h1></header><p>First <b>bo</b>ld<br>line &lt;x&gt;
<p>Second&nbsp;one <a href="x>y">link</a>.<div class="ad">Buy!</div><form><label>Mail</label><input></form>
<ul><li>one<li>two</ul><section class="comments"><article>nasty comment</article></section><!-- hidden --></article>
<aside>Side</aside></main><article class="comment">reader</article><footer>&copy; foot</footer></body></html>"""


def test_article():
    assert html.main_text(PAGE) == "Title & more First bold line <x> Second one link. one two"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("plain &amp text") == "plain & text"
    assert html.main_text("<body><div>a</div>b<span>c</span></body>") == "a bc"
    assert html.main_text("<article><p>cut of") == "cut of"
    assert html.main_text("<article><p>cut</p></arti") == "cut"
    assert html.main_text("<article>" + "<div>" * 5000 + "deep") == "deep"
    assert html.main_text('<article><p>a "quoted <p title="x\'>b') in ("a \"quoted b", "a \"quoted")


def test_templates(spark):
    shell = '<body><div class="x"><div class="brand">Our shop since 1900</div><div class="t">{}</div></div></body>'
    rows = [(i, f"http://h.example/{i}", shell.format(f"text number {i}"), "z") for i in range(6)]
    rows += [(10 + i, "http://copies.example/a", shell.format("equal"), None) for i in range(6)]
    rows += [(20, None, shell.format("nohost"), None), (21, "http://h.example/", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, hashes string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == {**{i: f"text number {i}" for i in range(6)}, **{10 + i: "Our shop since 1900 equal" for i in range(6)}, 20: "Our shop since 1900 nohost", 21: ""}
    assert html.extract(df.limit(0)).count() == 0


def test_synthetic_pages_keep_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html.extract(pages).collect():
        body = re.sub(r"</article>.*", "", source[r.page_id].partition("<article>")[2], flags=re.S)
        want = " ".join(unescape(re.sub(r"<[^>]*>?", lambda m: "" if m[0] in ("<b>", "</b>") else " ", body)).split())
        assert r.text == want and r.n_chars == len(want)


def test_near_copies_keep_their_article(spark):
    body = "<p>" + "</p><p>".join(f"paragraph {k} " + "of the whole article " * 6 for k in range(5)) + "</p>"
    short = '<article><h1>T</h1><div class="body"><p>the whole article body</p></div><div>Buy {}</div></article>'
    long = '<article><h1>T</h1><div class="lead">{0}</div><div class="rest">' + body + "</div><div>Buy {1}</div></article>"
    rows = [(i, "http://a.example/", short.format(f"item {i}")) for i in range(6)]
    rows += [(10 + i, "http://b.example/", long.format("<p>a longer lead of this article</p>", f"item {i}")) for i in range(6)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"T the whole article body Buy item {i}" for i in range(6))
    assert all(got[10 + i].startswith("T a longer lead") and got[10 + i].count("whole article") == 30 for i in range(6))


def brute_templates(rows):
    """(host, page) -> recurring subtrees, counted with plain sets."""
    seen = {}
    for _, url, text in rows:
        host = re.match(r"http://([^/]*)", url)[1]
        root = html.parse(text)
        seen.setdefault(host, []).append((text, html.article_key(root), set(html.subtree_hashes(root).values())))
    out = {}
    for host, pages in seen.items():
        articles = {}
        for _, key, hashes in pages:
            for h in {None, *hashes}:
                articles.setdefault(h, set()).add(key)
        for text, _, hashes in pages:
            found = {h for h in hashes if len(articles[h]) >= max(html.MIN_PAGES, html.MIN_SHARE * len(articles[None]))}
            if found:
                out[host, text] = found
    return out


def test_template_counts(spark):
    rng = __import__("random").Random(7)
    parts = [f'<div class="c{k}"><p>part {k}</p><ul><li>{k}</li></ul></div>' for k in range(30)]
    rows = [(i, f"http://h{i % 3}.example/x", "<body><article><p>story " + f"{rng.randrange(60)}</p>" + "".join(rng.sample(parts, 5)) + "</article></body>") for i in range(160)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    from pyspark.sql import functions as F

    named = {r.h: r.html for r in df.select(F.xxhash64("html").alias("h"), "html").collect()}
    got = {(r.host, named[r.page]): set(r.hashes) for r in html.templates(df).collect()}
    assert got == brute_templates(rows) and got


def test_odd_markup():
    assert html.main_text('<article><p>One <svg class="i"/> two</p><p>three</p></article>') == "One two three"
    assert html.main_text("<article><p>a<noscript>b</p><p>c</p></article>") == "ab c"
    assert html.main_text("<article><p>a<svg><text>x</text></svg>b</p></article>") == "ab"
    assert html.main_text("<article><p>a</p><script>if (x) {") == "a"
    teasers = "".join(f"<article><h2>Teaser {i}</h2></article>" for i in range(3))
    assert html.main_text(f"<main><p>{'The story itself goes on and on. ' * 20}</p>{teasers}</main>").startswith("The story itself")
    part = "<article><p>Intro</p><div class='{}'><p>" + "The main section of the paper. " * 5 + "</p></div></article>"
    assert all("main section" in html.main_text(part.format(n)) for n in ("discussion", "alert", "related", "widget", "share"))
    assert html.main_text("<article><p>" + "Story. " * 9 + "</p><div class='related'>More</div></article>") == ("Story. " * 9).strip()
    assert html.main_text("<article><p>" + "x" * 300_000 + " <a href='" + "y" * 300_000 + "'>z</a></p>") == "x" * 300_000 + " z"
    assert html.main_text("<object>" * 20_000 + "end") == "end"


ARTICLE = "<h1>Heading</h1>" + "".join(f"<p>Sentence {k} of the article that must stay, whatever the wrapper is called.</p>" for k in range(10))
WANT = "Heading " + " ".join(f"Sentence {k} of the article that must stay, whatever the wrapper is called." for k in range(10))
WRAPPERS = [
    '<div class="layout has-sidebar">{}</div>', '<div id="page" class="with-banner"><main>{}</main></div>', '<div class="nav-wrapper">{}</div>', '<div class="social-science">{}</div>',
    '<article class="post no-comments">{}</article>', '<article class="post promo-free">{}</article>', '<section id="reply-to-critics">{}</section>', '<form id="aspnetForm">{}</form>',
]
BESIDE = [
    '<nav class="x"><ul><li><a href="/">Menu entry</a></ul></nav>', '<header><p>Site header</p></header>', '<footer>Footer text</footer>', '<aside>Sidebar text</aside>', '<div class="sidebar">Sidebar words</div>', '<div id="cookie-notice">We use cookies</div>',
    '<div class="ad">Buy this</div>', '<div class="ad-slot-3"><p>Buy that</p></div>', '<form action="/mail"><p>Sign up here</p><input name="m"><button>Go</button></form>', '<script>track("x");</script>', '<style>p{}</style>',
    '<section class="comments"><article><p>Reader says no</p></article></section>', '<article class="comment">Another reader</article>', '<div id="disqus_thread">Thread</div>', '<ul class="social-icons"><li><a href="#">Like</a></ul>', '<div hidden>Not shown</div>', '<!-- remark -->',
]


def test_no_wrapper_loses_the_article():
    for wrapper in WRAPPERS:
        page = wrapper.format(ARTICLE)
        assert html.main_text(f"<body>{page}</body>") == WANT, wrapper
        assert html.main_text("<html><body>" + "".join(BESIDE) + page + "".join(BESIDE) + "</body></html>") == WANT, wrapper
        inner = f"<article>{ARTICLE}</article>"
        assert html.main_text("<html><body>" + "".join(BESIDE) + wrapper.replace("<article ", "<div ").replace("</article>", "</div>").format(inner) + "".join(BESIDE) + "</body></html>") == WANT, wrapper


def test_what_is_beside_the_article_goes():
    for part in BESIDE:
        assert html.main_text(f"<body><article>{ARTICLE}</article>{part}</body>") == WANT, part
        assert html.main_text(f"<body><main>{ARTICLE}{part}</main></body>".replace("<header>", "<header role='banner'>")) == WANT, part
    many = "<section class='comments'>" + "<article><p>A comment that is longer than the article by far, as threads are.</p></article>" * 40 + "</section>"
    assert html.main_text(f"<body><article>{ARTICLE}</article>{many}</body>") == WANT
    assert html.main_text(f"<body><div class='story'>{ARTICLE}</div>{many.replace('article', 'div')}</body>") == WANT


def test_headings_anchors_are_not_names():
    sections = "".join(f'<section id="{name}"><h2>{name}</h2><p>Some words about it.</p></section>' for name in ("social-networks", "banner-design", "comments-on-the-draft", "advertising-history"))
    text = html.main_text(f"<article>{sections}</article>")
    assert text.count("Some words about it.") == 4
