"""Web pages, archives, and the pipeline against a composition of brute-force stages."""

import hashlib
import random
import time
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievegrid.llm import html_text, queries, store, warc

SF = "/root/testdata/sf0.001"


def page(article, extra=""):
    return f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Side text that is rather long, to tempt a scorer.</p></div>{article}{extra}
<div class="comments"><p>Reader says something long and interesting about this.</p></div><form><p>Sign</p><input></form><footer>&copy; x</footer><script>var a="</p><p>no";</script></body></html>"""


CASES = [
    (page("<article><h1>Head &amp; line</h1><p>One <b>bold</b>\n word.<p>Two&nbsp;parts<br>here</article>"), "Head & line\n\nOne bold word.\n\nTwo parts here"),
    (page('<div class="post-12"><h1>Title</h1><p>' + "Some words of the text. " * 9 + '</p><div class="ad">Buy</div><p>End.</p></div>'), "Title\n\n" + "Some words of the text. " * 8 + "Some words of the text.\n\nEnd."),
    (page('<main><p>Just this &lt;b&gt; text.</p><aside>no</aside></main>'), "Just this <b> text."),
    ("<p>unclosed <i>tags<p>go on <!-- never closed", "unclosed tags\n\ngo on"),
    ("plain text < without tags & more", "plain text < without tags & more"),
    ("<script>x", ""),
    ("", ""),
    (None, ""),
    ("<nav><p>menu</p></nav>", ""),
    ("<article><header><h1>Own</h1></header><table><tr><td>a<td>b</table><ul><li>x<li>y</ul></article>", "Own\n\na\n\nb\n\nx\n\ny"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_main_text(html, text):
    assert html_text.main_text(html or "", None) == text


def test_doubtful_parts_and_fallbacks():
    article = '<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p><noscript>plain</noscript><object>other</object><p class="notice-of-award">Award</p><div class="related-work">Work</div>{}</article>'
    boxes = '<div class="ad-slot">Buy</div><ul class="comment-list"><li>Me too</li></ul><p>on <span class="ad">Buy</span> and off</p>'
    want = "Let x=1 be\n\nplain\n\nother\n\nAward\n\nWork"
    assert html_text.main_text(article.format(""), None) == want
    assert html_text.main_text(article.format(boxes), None) == want + "\n\non and off"
    # the host's pages have the box in the same place: no text of the article
    assert html_text.main_text(article.format(""), "article", ["article>div.related-work"]) == want.replace("\n\nWork", "")


def test_furniture_by_consensus(spark):
    body = lambda i, box: f'<body><article><p>{"words of the page. " * 9}{i}</p><div class="{box}">Box {i}</div></article></body>'
    rows = [(i, f"http://a.example/{i}", body(i, "related-stuff")) for i in range(4)] + [(10 + i, "http://b.example/x", body(i, "related-stuff" if i < 2 else "own")) for i in range(5)]
    got = {r["page_id"]: "Box" in r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: False for i in range(4)} | {10 + i: True for i in range(5)}


P = "The first sentence of it says something. A second one goes on with that. The third is longer than both of them. So ends the paragraph."
TITLES = [
    f'<article><div class="article-header"><h1>The Title</h1></div><p>{P}</p></article>',
    f'<article><header class="post-header"><h1>The Title</h1></header><p>{P}</p></article>',
    f'<main><div class="page-header"><h2>The Title</h2></div><p>{P}</p></main>',
    f'<body><h1>The Title</h1><article><p>{P}</p></article></body>',
    f'<body><h1><a href="/">Site</a></h1><div><h1>The Title</h1></div><main><p>{P}</p></main></body>',
    f'<article><h1>The Title</h1><div class="social">{P}</div><div class="social">Tweet</div></article>',
    f'<article><h1>The Title</h1><p>{P}</p><h3>3 Comments</h3><div class="c1"><p>{P}</p></div><div class="c1"><p>Me too, {P}</p></div></article>',
    f'<article><h1>The Title</h1><p>{P}</p><div class="x"><h4>Kommentare (2)</h4></div><div class="c1"><p>{P}</p></div></article>',
    f'<article><h1>The Title</h1><p>{P}</p><div class="newsletter"><h3>Subscribe</h3><p>Get it by mail.</p></div><div class="related"><h3>More</h3><ul><li><a href="/">{P}</a></li></ul></div></article>',
    f'<article><h1>The Title</h1><p>{P}</p><div class="ad"><p>{P}</p></div><ol class="comment-list"><li>{P}</li></ol></article>',
]


@pytest.mark.parametrize("html", TITLES)
def test_titles_and_boxes_of_an_article(html):
    for path in (None, html_text.vote(html)[0]):
        assert html_text.main_text(html, path) == f"The Title\n\n{P}"


def test_sections_that_are_named_like_boilerplate():
    html = f'<article><h1>T</h1><section id="copyright"><h2>On copyright</h2><p>{P}</p></section><section id="alerts"><p>{P}</p></section><section id="search"><h2>Search</h2><p>{P}</p></section></article>'
    want = f"T\n\nOn copyright\n\n{P}\n\n{P}\n\nSearch\n\n{P}"
    assert html_text.main_text(html, None) == html_text.main_text(html, "article") == want


def test_hosts_settle_doubtful_boxes(spark):
    """Titles stay although each page has their box; a notice goes where each page has its very words."""
    def made(i, notice):
        return f'<body><article><div class="entry-header"><h1>Title {i}</h1></div><p>{P} {i}</p><div class="notice"><p>{notice}</p></div><div class="promo"><p>Short {i}</p></div></article></body>'

    same, own = "This is the notice of the site, which is as long as any paragraph, and always the same in its words.", "Number {} of a box with words of its own, long enough for a block of prose, and different on every page."
    rows = [(i, f"http://a.example/{i}", made(i, same)) for i in range(4)] + [(10 + i, f"http://b.example/{i}", made(i, own.format(i))) for i in range(4)] + [(20, "http://c.example/", made(0, same))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert got[i] == f"Title {i}\n\n{P} {i}"
        assert got[10 + i] == f"Title {i}\n\n{P} {i}\n\n{own.format(i)}"
    assert got[20] == f"Title 0\n\n{P} 0\n\n{same}"  # nobody else to ask
    found = {r["host"]: list(r["furniture"]) for r in html_text.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(found["a.example"]) == 2 and len(found["b.example"]) == 1 and found["c.example"] == []


def test_deep_and_long_pages():
    deep = '<div class="c">' * 40_000 + "<p>" + "hello there " * 20 + "</p>" + "</div>" * 40_000
    started = time.perf_counter()
    path, good, parts = html_text.vote(deep)
    assert time.perf_counter() - started < 5  # a second or so; with the square of the depth it took minutes
    assert path.count(">") == 39_999 and html_text.main_text(deep, path) == ("hello there " * 20).strip()
    long = "<article>" + "<p>some words here</p>" * 30_000 + "</b>" * 30_000 + "</article>"
    assert html_text.main_text(long, None).count("\n\n") == 29_999


def test_tied_votes(spark):
    box = lambda name: f"<body><div class='{name}'><p>{'same words here. ' * 12}</p></div></body>"
    rows = [(i, "http://t.example/", box("ab"[i % 2])) for i in range(6)]
    got = html_text.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r["path"], r["votes"]) for r in got] == [("body>div.b", 3)]


class Plain(HTMLParser):
    """A brute-force extractor for well-formed pages: a tree, then a walk."""

    def __init__(self, page):
        super().__init__()
        self.root = self.at = ["", {}, [], None]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), [], self.at]
        self.at[2].append(node)
        self.at = node if tag not in ("br", "hr", "img", "input") else self.at

    def handle_endtag(self, tag):
        self.at = self.at[3] if self.at[0] == tag else self.at

    def handle_data(self, data):
        self.at[2].append(data)

    def text(self, wanted="article"):
        out, run = [], []

        def flush():
            if x := " ".join("".join(run).split()):
                out.append(x)
            run.clear()

        def walk(node, inside):
            if isinstance(node, str):
                run.append(node if inside else "")
                return
            tag, attrs, children, _ = node
            if tag in ("script", "style", "nav", "aside", "form", "footer", "header") or attrs.get("class") in ("ad", "comments", "cookie-notice", "share"):
                flush()
                return
            block = tag not in ("b", "i", "a", "span", "br")
            flush() if block else None
            run.append(" " if tag == "br" else "")
            for child in children:
                walk(child, inside or tag == wanted)
            flush() if block else None

        walk(self.root, False)
        return "\n\n".join(out)


def test_against_a_plain_walk():
    r = random.Random(11)
    word = lambda: r.choice(["alpha", "beta &amp; gamma", "d&eacute;lta", "&lt;tag&gt;", "x  y", "zeta\n"])
    words = lambda n: " ".join(word() for _ in range(n))

    def block(depth=0):
        kind = r.randrange(9)
        if kind < 3 or depth > 3:
            return f"<p>{words(4)} <b>{words(2)}</b><br>{words(3)} <a href='#'>{word()}</a> {words(6)}</p>"
        if kind == 3:
            return "<ul>" + "".join(f"<li>{words(3)}</li>" for _ in range(r.randrange(1, 4))) + "</ul>"
        if kind == 4:
            return f"<table><tr><td>{words(2)}</td><th>{word()}</th></tr></table>"
        if kind == 5:
            return f'<div class="{r.choice(["ad", "comments", "share"])}"><p>{words(5)}</p></div>'
        if kind == 6:
            return f"<script>var a='<p>{word()}</p>';</script><style>p{{}}</style><!-- <p>no</p> -->"
        return f'<div class="{r.choice(["part", "section-2", "x"])}">' + "".join(block(depth + 1) for _ in range(r.randrange(1, 4))) + "</div>"

    for _ in range(150):
        article = "<article><h1>" + words(3) + "</h1>" + "".join(block() for _ in range(r.randrange(1, 8))) + f"<p>{words(30)}</p></article>"
        html = f"<html><head><title>t</title></head><body><header>{words(3)}</header><nav><ul><li>{word()}</li></ul></nav><div class='cookie-notice'>{words(4)}</div><div>{article}</div><aside><p>{words(40)}</p></aside><form>{words(2)}</form><footer>{words(3)}</footer></body></html>"
        path = html_text.vote(html)[0]
        assert html_text.main_text(html, path) == html_text.main_text(html, None) == Plain(html).text()


def test_article_beside_the_hosts_path():
    half = lambda name: f"<p>{name} {'has words of the article in it. ' * 8}</p>"
    split = f"<body><div class='wrap'><div class='post'>{half('First')}</div><div class='more'>{half('Second')}</div></div><div class='box'><p>tail</p></div></body>"
    for path in ("body>div.wrap>div.post", None):
        got = html_text.main_text(split, path)
        assert "First" in got and "Second" in got and "tail" not in got
    # three quarters in one element: the rest is not lost either
    most = f"<body><div class='wrap'><div class='post'>{half('First') * 3}</div><div class='more'>{half('Second')}</div></div></body>"
    assert all("Second" in html_text.main_text(most, p) for p in ("body>div.wrap>div.post", None))


def test_host_votes(spark):
    body = "<div class='c{n}'><p>" + "words in the body of it. " * 12 + "</p></div>"
    rows = [(i, f"http://a.example/{i}", "<body>" + body.format(n=i) + "<div class='box'><p>tail</p></div></body>") for i in range(6)]
    rows += [(10, None, "<p>x</p>"), (11, "::bad::", "<article>y</article>"), (12, "http://A.example:80/z", None), (None, "http://b.example", "<p>z</p>"), rows[0]]
    pages = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, html string, host string, path string")
    paths = {r["host"]: (r["path"], r["votes"]) for r in html_text.host_paths(pages).collect()}
    assert paths["a.example"] == ("body>div.c#", 7)
    got = Counter((r["page_id"], r["text"][:9]) for r in html_text.extract(pages).collect())
    assert sum(got.values()) == len(rows)
    assert got[(0, "words in ")] == 2 and got[(10, "x")] == got[(11, "y")] == got[(12, "")] == got[(None, "z")] == 1
    assert html_text.extract(pages.where("false")).collect() == []


def test_archive(spark):
    big = "long text é " * 200
    rows = [(1, "http://x", big), (5, "http://y\r\nWARC-Type: revisit", big), (3, None, big), (7, "u", "small"), (8, "u", "small"), (9, "v", None), (10, "v", ""), (None, "w", big), (11, "z", "y" * 1000), (12, "z", "y" * 999), (12, "z", "y" * 999)]
    pages = spark.createDataFrame([(*r, "d", b"p") for r in rows], "page_id long, url string, html string, digest string, payload binary")
    headers, payloads = warc.write(pages)
    assert payloads.count() == len({(r[2] or "") for r in rows})
    got = Counter(tuple(r) for r in warc.fields(warc.read(headers, payloads)).collect())
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and i != max(j for j, _, g in rows if j is not None and g == h)
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None)] += 1
    assert got == want
    record = bytes(warc.read(headers, payloads).where("page_id = 7").first()["record"])
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record.endswith(b"\r\n\r\nsmall\r\n\r\n")
    broken = payloads.withColumn("payload", F.concat("payload", F.lit(b"!")))
    with pytest.raises(Exception, match="payload differs"):
        warc.read(headers, broken).collect()
    assert warc.fields(warc.read(*warc.write(pages.where("false")))).collect() == []


def test_store_reads_the_sessions_folder(spark):
    assert store.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert store.keep(spark.range(3), "t").count() == 3


def test_all_ten_are_registered():
    names = list(queries.QUERIES)
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


def test_pipeline(spark):
    """Every stage alone, on what the one before kept, against a plain version."""
    from .test_text_operators import brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(store.keep(stage(spark, kept[-1], SF), "stage"))
    assert all(x.columns == columns for x in kept[:-1]) and len(corpus_pipeline.STAGES) == 5
    rows = [{r["doc_id"]: r["text"] for r in x.select("doc_id", "text").collect()} for x in kept[:-1]]
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(i in rows[1]) == bool(q) for i, q in quality.items() if i in rows[0]]
    assert sum(judged) / len(judged) >= 0.95
    assert rows[2].keys() == rows[1].keys()
    for i, text in rows[2].items():
        left = iter(rows[1][i].split("\n"))
        assert text == "" or all(line in left for line in text.split("\n"))  # a subsequence of its lines
    components = brute_components(list(rows[2].items()))
    assert rows[3].keys() == {i for i, c in components.items() if i == c}
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {i for i, t in rows[3].items() if any(x in " ".join((t or "").lower().split()) for x in items)}
    assert exact and rows[4].keys() == rows[3].keys() - exact
    pieces = kept[-1].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"] for r in pieces} == rows[4].keys() and all(r["n"] == r["t"] for r in pieces)
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == kept[-1].count()


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component long, keys string, th string, region long"


def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, an id with two texts."""
    plain = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(12).collect()]
    rows = [(i, t) for i, t in enumerate(plain)] + [(None, plain[0]), (None, None), (100, None), (101, ""), (102, " \n\n "), (1, plain[1]), (1, plain[1]), (2, plain[3]), (103, " ".join(plain) * 40), (104, "x" * 300_000)]
    rows = [(i, t, None if k % 2 else "en", None if k % 3 else "s", None, None, None, "h", 1) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, ODD_SCHEMA), rows


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    docs, rows = odd_documents(spark)
    docs = store.keep(docs, "odd")
    got = stage(spark, docs, SF)
    if name == "packing":
        sizes = {}
        for r in got.collect():
            sizes.setdefault(r["doc_id"], []).append(r["length"])
        assert set(sizes) == {r[0] for r in rows} and min(map(min, sizes.values())) == 1
    else:
        assert got.columns == docs.columns
        kept = Counter((r["doc_id"], r["lang"], r["source"], r["th"]) for r in got.collect())
        given = Counter((r[0], r[2], r[3], r[7]) for r in rows)
        assert not kept - given
        if name == "line dedup":
            assert kept == given
            texts = {r["doc_id"]: r["text"] for r in got.collect()}
            assert texts[100] is None and texts[101] == "" and texts[102] == " \n\n "
        if name == "n-gram Jaccard join":
            ids = [r["doc_id"] for r in got.collect()]
            assert ids.count(None) == 2 and {100, 101, 102} <= set(ids) and ids.count(1) == 3
        if name == "benchmark decontamination":
            assert {100, 101, 102} <= {r["doc_id"] for r in got.collect()}
        if name == "quality classifier":
            assert not {100, 101} & {r["doc_id"] for r in got.collect()}
    assert stage(spark, store.keep(docs.where("false"), "odd"), SF).collect() == []


def test_very_long_payloads(spark):
    long = "<p>" + "long page " * 200_000 + "</p>"
    pages = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.fields(warc.read(*warc.write(pages))).collect()}
    assert got == {1: (len(long), "revisit", 2), 2: (len(long), "response", None), 3: (0, "response", None)}
