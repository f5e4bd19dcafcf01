import html as entities
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import html


def text(source):
    """A page whose host has no other: it is its own template."""
    page = html.parse(source)
    return html.own_text(page, {html._hash(e.token, 0): html.Known(i, 0, 0, 1, 1.0, 0.0) for i, e in enumerate(page.elements)} or {0: html.Known(0, 1, 0, 1, 1.0, 0.0)})


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><p>One <b>two</b>\n three<p>four<br>five</article>", "One two three four five"),
        ("<nav>menu</nav><article>a</article><footer>f</footer>", "a"),
        ("<header>site</header><article><header><h1>T</h1><span>by me</span></header>x</article>", "T x"),
        ('<body><div class="site-header">s</div><div>x</div></body>', "x"),
        ('<article><div class="article-header"><h1>T</h1></div><div class="notice">n</div>x</article>', "T x"),
        ("<article>a<script>var t='</p>';</script>b<style>p{}</style>c</article>", "a b c"),
        ("<article>a<!-- <p>no</p> -->b</article>", "ab"),
        ('<article><p>a</p><div class="ad-box">buy</div><div id="cookieNotice">c</div><p class="Sidebar">s</p></article>', "a"),
        ('<article>a<section id="comments"><article class="comment">nice</article></section></article>', "a"),
        ('<article>a<form><label>n</label><input value="v"></form></article>', "a"),
        ("<article>1 < 2 &lt;b&gt; &#8364; &nosuch; 3</article>", "1 < 2 <b> € &nosuch; 3"),
        ("<main><p>m</p><aside>no</aside></main><p>out</p>", "m"),
        ('<div role="main">m</div><div role="banner">b</div>', "m"),
        ('<article><p hidden>h</p><p style="display: none">d</p>v</article>', "v"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1 2 3 4"),
        ('<article><a title="a > b" href=x>link</a></article>', "link"),
        ('<article><p title="broken>x</p>y</article>', "x y"),
        ("<article>never closed <p>at all", "never closed at all"),
        ("<ARTICLE>Upper</ARTICLE>", "Upper"),
        ("<article>a b &nbsp; c</article>", "a b c"),
        ("<body><p>no article</p><nav>n</nav></body>", "no article"),
        ('<article>a<div class="related-work">b</div><section class="search-results">c</section><p class="comment-free">d</p><math><mi>e</mi></math></article>', "a b c d e"),
        ('<article>a<div class="related-posts">b</div><div id="search-box">c</div><p class="comment-list">d</p><span class="ads">e</span></article>', "a"),
        ("<article>shadow and headline <div class='shadow headline'>kept</div></article>", "shadow and headline kept"),
    ],
)
def test_text(source, expected):
    assert text(source) == expected


def test_deep_and_long_pages():
    assert text("<div>" * 20_000 + "x") == "x"
    assert text("<article>" + "<p>w</p>" * 20_000 + "</article>") == " ".join(["w"] * 20_000)
    assert text("<div>w " * 20_000) == " ".join(["w"] * 20_000)
    assert text("<" * 10_000) == "<" * 10_000


def plain(source):
    inner = source[source.index("<article>") + 9 :]
    inner = inner[: inner.find("</article>")] if "</article>" in inner else inner
    inner = re.sub(r"<(/?)(b|i|a|em|strong)>", "", inner).replace("<br>", " ")
    return " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


def test_query(spark, sf001):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf001}/pages.parquet").collect()}
    got = html.query(spark, sf001).collect()
    assert {r.page_id: r.text for r in got} == {k: plain(v) for k, v in source.items()}
    assert all(r.n_chars == len(r.text) for r in got)


def extract(spark, pages):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_template_text_goes_where_no_article_is_declared(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div><p>Same on every page</p></div><div><p>Own words {i} of page {i * 7}</p><p>and more {i}</p></div><div><span>All rights reserved</span></div></body>") for i in range(8)]
    pages += [(100 + i, f"http://few.example/{i}", f"<body><p>Same</p><p>own {i}</p></body>") for i in range(2)]
    got = extract(spark, pages)
    assert got[3] == "Own words 3 of page 21 and more 3"
    assert got[100] == "Same own 0"  # two pages are too few for text of a template


def test_a_line_of_the_template_inside_articles_goes_and_copies_stay(spark):
    line = "<p>Subscribe to us today</p>"
    pages = [(i, f"http://h/{i}", f"<article><p>own text number {i} and some more words</p>{line}</article>") for i in range(12)]
    pages += [(100 + i, f"http://copy/{i}", f"<article><p>one article on all pages</p><p>and its end</p>{f'<p>{i}</p>' if i % 2 else ''}</article>") for i in range(12)]
    got = extract(spark, pages)
    assert got[3] == "own text number 3 and some more words"
    assert got[100] == "one article on all pages and its end" and got[101] == "one article on all pages and its end 1"


def test_slots_of_links_go_and_names_count_for_elements_of_the_template(spark):
    links = "<div class='x'><a href=1>a{0}</a> <a href=2>b{0}</a></div>"
    pages = [(i, f"http://h/{i}", f"<body>{links.format(i)}<div><p>words of page {i} with <a>one {i}</a> link</p></div><div class='ads'>buy {i}</div>{'<div class=widget>once</div>' if i == 5 else ''}</body>") for i in range(8)]
    got = extract(spark, pages)
    assert got[3] == "words of page 3 with one 3 link"
    assert got[5] == "words of page 5 with one 5 link once"  # nothing else on the host is called so


def test_without_its_template_a_page_gives_other_text(spark, sf001):
    rows = spark.read.parquet(f"{sf001}/pages.parquet").limit(20).collect()
    for r in rows:
        page = html.parse(r.html)
        assert html.own_text(page, {}) != plain(r.html)


def deduced(pages):
    """Brute force: occurrence vectors as such, classes of equal vectors, the nesting and the slots, for one host."""
    n = len(pages)
    parsed = [html.parse(p) for p in pages]
    vector, place = {}, {}
    for k, page in enumerate(parsed):
        for at, (kind, i) in enumerate(page.places):
            t = (kind, page.elements[i].token if kind == 0 else page.blocks[i].text)
            v = vector.setdefault(t, [0] * n)
            if not v[k]:
                place.setdefault(t, []).append(at)
            v[k] += 1
    held = {t: sum(1 for x in v if x) for t, v in vector.items()}
    mean = {t: sum(p) / len(p) for t, p in place.items()}
    template = {t for t in vector if (t[0] == 0 and (n < 4 or held[t] >= 2)) or (t[0] == 1 and held[t] >= 4 and held[t] / n >= 0.6)}
    spans = {}
    for t in template:
        spans.setdefault(tuple(vector[t]), []).append(mean[t])
    spans = {v: (min(p), max(p)) for v, p in spans.items()}
    wide = [s for v, s in spans.items() if sum(map(bool, v)) / n >= 0.6 and s[0] < s[1]]
    for t in [t for t in template if t[0] == 1]:
        a, b = spans[tuple(vector[t])]
        if any(a < c < b < d or c < a < d < b for c, d in wide):
            template.remove(t)
    inside = {}
    for page in parsed:
        for e in page.elements:
            inside.setdefault((0, e.token), [0, 0])
        for b in page.blocks:
            at = b.at
            while at >= 0 and not b.skipped:
                x = inside[(0, page.elements[at].token)]
                x[0] += len(b.text.replace(" ", ""))
                x[1] += b.links
                at = page.elements[at].above
    order = sorted(template, key=lambda t: mean[t])
    out = []
    for page in parsed:
        slots = []
        for b in page.blocks:
            chain, at = [], b.at
            while at >= 0:
                chain.append(page.elements[at])
                at = page.elements[at].above
            chain = [e for e in chain if (0, e.token) in template]
            bare = any(held[0, e.token] >= 4 and held[0, e.token] / n >= 0.6 and inside[0, e.token][1] >= 0.9 * max(1, inside[0, e.token][0]) for e in chain)
            if not b.skipped and not any(e.named for e in chain) and not (bare and b.scope < 2):
                slots.append((b, max((e.scope for e in chain), default=0)))
        if not any(s for _, s in slots):
            slots = [(b, b.scope) for b, _ in slots]
        top = max((s for _, s in slots), default=0)
        main = [b for b, s in slots if s == top]
        latest, broken = {}, set()
        for b in main:
            t = (1, b.text)
            if t in template:
                c = tuple(vector[t])
                if order.index(t) < latest.get(c, -1):
                    broken.add(c)
                latest[c] = order.index(t)
        fixed = [b for b in main if (1, b.text) in template and tuple(vector[1, b.text]) not in broken and (top < 2 or (held[1, b.text] >= 8 and held[1, b.text] / n >= 0.9))]
        if top == 2 and 2 * sum(len(b.text) for b in fixed) >= sum(len(b.text) for b in main):
            fixed = []
        out.append(" ".join(b.text for b in main if not any(b is f for f in fixed)))
    return out


def _site(rng, n):
    """Pages of one made-up layout."""
    shell = rng.choice(["<article>{}</article>", "<div class=post>{}</div>", "<main>{}</main>", "<div>{}</div>"])
    extra = [f"<div class={rng.choice(['ads', 'related-work', 'menu', 'x', 'comment-list'])}>%s</div>" for _ in range(3)]
    line = "<p>" + " ".join(rng.choices("abcde", k=4)) + "</p>"
    words = lambda k: " ".join(str(rng.randint(0, 99)) for _ in range(k))
    pages = []
    for _ in range(n):
        body = "".join(f"<p>{words(rng.randint(2, 6))}</p>" for _ in range(rng.randint(0, 3))) + (line if rng.random() < 0.9 else "")
        parts = [shell.format(body)] + [e % (words(2) if rng.random() < 0.5 else "the same") for e in extra if rng.random() < 0.8]
        if rng.random() < 0.3:
            rng.shuffle(parts)
        pages.append(f"<body><div class=top><a href=/>{words(1)}</a></div>{''.join(parts)}<footer>f</footer></body>")
    return pages


def test_agrees_with_plain_deduction(spark):
    import random

    rng = random.Random(3)
    sites = [_site(rng, n) for n in (1, 2, 3, 4, 5, 6, 8, 9, 12, 20) for _ in range(3)]
    rows = [(1000 * h + i, f"http://h{h}.example/{i}", p) for h, site in enumerate(sites) for i, p in enumerate(site)]
    got = extract(spark, rows)
    want = {1000 * h + i: t for h, site in enumerate(sites) for i, t in enumerate(deduced(site))}
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_classes_group_tokens_of_equal_occurrence(spark):
    pages = [("h", f"u{i}", f"<body><h2>x</h2><p>fixed</p><ul>{'<li>i</li>' * (i % 3 + 1)}</ul><p>own {i}</p></body>") for i in range(9)]
    row = html.templates(spark.createDataFrame(pages, "host string, url string, html string")).first()
    by_class = {}
    for t in row.template:
        by_class.setdefault(t["class"], []).append(t)
    assert len(by_class) >= 3  # once a page, twice a page, and the list's items


def test_repeated_pages_without_url_and_long_equal_beginnings(spark):
    head = "<body><article>" + "<!-- same -->" * 40
    rows = [(i, None, f"{head}<p>{w} text</p></article><div class=ads>{w}</div></body>") for i, w in enumerate(["aa", "bb", "aa", "cc", "dd", "bb"])]
    assert extract(spark, rows) == {i: f"{w} text" for i, w in enumerate(["aa", "bb", "aa", "cc", "dd", "bb"])}


def test_trouble(spark):
    rows = [(1, None, None), (1, None, None), (2, "", ""), (3, "not a url", "<article>x</article>"), (None, "http://h/", "<article>y</article>"), (4, "http://u:p@H:80/?q", "<article>z</article>")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")
    got = html.extract(df).collect()
    assert sorted(str((r.page_id, r.text)) for r in got) == sorted(str((r[0], plain(r[2]) if r[2] else "")) for r in rows)
    assert html.extract(df.limit(0)).count() == 0
    assert html.extract(df.withColumn("template", F.lit(1))).count() == len(rows)
