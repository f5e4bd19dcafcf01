"""HTML extraction by equivalence classes of tokens across a host's pages.

Tokens are elements in their context (parent, name, class and what their
markup claims to be) and whole text blocks. Over all pages of a host each token
has an occurrence vector, how often it stands on each page; tokens with equal
vectors make a class. Vectors are never gathered: a token's vector is summed up
as hashes of (page, count), which combine on the map side, so a host with a
third of all pages costs a row a token and task. Classes that enough pages
share and that nest by place make the host's template, and what the template's
elements hold are the slots.

The text of a page is what stands in its main slots. Claims that markup makes
are hints for choosing among slots and count only for elements of the template:
the slot of an article, else of a main part, else of all that is left; less
slots that call themselves menus, adverts, comments and the like, and less
slots that hold links alone on most pages. Text of the template itself is none
of the page's. Only elements that HTML itself defines as something else (nav,
footer, form, script, hidden parts ...) need no second page to be left out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common as C

#: Pages that text must stand on to be of the template, and the least share of the host's pages.
MIN_PAGES = 4
MIN_SHARE = 0.6
#: The same for text inside an article, which copies of articles also repeat.
ARTICLE_PAGES = 8
ARTICLE_SHARE = 0.9
#: Of a host with at least MIN_PAGES, elements of the template stand on 2 pages, and on one page in so many.
ONE_IN = 1000
LINKS = 0.9
BROADCAST_TOKENS = 100_000
KNOWN_HOSTS = 1024

# Elements and names by their part in a page.
SKIPPED = frozenset("head title script style noscript template iframe object embed applet svg canvas audio video map nav footer aside form button input select option datalist textarea label fieldset dialog menu frameset noframes".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder mfenced semantics annotation".split())
NEVER_NAMED = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsors sponsored promo promotion banner nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar rail footer masthead topbar cookie cookies consent gdpr notice notices disclaimer notification alert popup modal overlay newsletter subscribe "
    "subscription signup login signin search searchbox share sharing social follow related recommended recommendations trending comments comment commentlist "
    "disqus replies reply respond reactions pagination pager toolbar widget widgets skiplink sitemap copyright".split()
)
#: Names of a page's head; within an article they may hold its title.
HEAD_NAMES = frozenset("header siteheader pageheader hero".split())
#: Words that may stand beside such a name in one class; with any other word the name means something else.
BESIDE = frozenset(
    "site page main global top bottom left right upper lower inner outer primary secondary first last js the c m is has wrap wrapper container content box bar block section area region zone slot unit panel column col "
    "list item items link links button buttons form field input icon icons text title heading head header inline sticky fixed mobile desktop post posts article articles story stories news thread tree count meta "
    "info message msg body row group set large small sm md lg xl level tabs tab drawer dropdown toggle policy bottombar lead sky skyscraper leaderboard rectangle mpu google dfp us on by up in".split()
)
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}

_MARKUP = re.compile(
    r"""<!--(?:>|->|(?s:.*?)(?:--!?>|\Z))|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*(?:>|\Z)"""
)
_LOOSE = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)>")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


@dataclass
class Block:
    """A run of text between block boundaries.

    ``scope``: 2 in an article, 1 in a main part, 0 elsewhere; ``skipped``: in
    an element that HTML defines as something else; ``at``: the number of the
    element around it; ``links``: how many of its characters
    other than spaces are in links.
    """

    text: str
    scope: int
    skipped: bool
    at: int = -1
    links: int = 0


@dataclass
class Element:
    """An element in its context; ``above``: the number of the one around it.

    ``scope``: 2 an article, 1 a main part; ``named``: it calls itself furniture.
    """

    token: str
    scope: int
    named: bool
    above: int


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)
    places: list[tuple[int, int]] = field(default_factory=list)  # (0, element) or (1, block), in page order


@dataclass
class _Open:
    name: str
    skipped: bool
    scope: int
    header: bool
    number: int = -1
    named: bool = False
    link: bool = False


def _attrs(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(raw)} if raw and not raw.isspace() else {}


def _defined(name: str, attrs: dict[str, str]) -> bool:
    """Whether an element is by HTML's own terms no main text."""
    if name in SKIPPED:
        return True
    if name in NEVER_NAMED or not attrs:
        return False
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in SKIPPED_ROLES or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))


def _named(name: str, attrs: dict[str, str], scope: int) -> bool:
    """Whether some class or the id, as a whole, names furniture; scope is that of what holds the element."""
    if name in NEVER_NAMED or not attrs:
        return False
    names = FURNITURE if scope == 2 else FURNITURE | HEAD_NAMES
    for one in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = {w.lower() for w in _NAME.findall(one)}
        if not words.isdisjoint(names) and words <= names | BESIDE:
            return True
    return False


def parse(source: str) -> Page:
    """Blocks and tags of a page in page order; broken markup is read as browsers do in the main."""
    page, stack, text = Page(), [], []
    linked = [0]

    def flush() -> None:
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if whole:
                top = stack[-1] if stack else None
                page.places.append((1, len(page.blocks)))
                page.blocks.append(Block(whole, top.scope if top else 0, bool(top and (top.skipped or top.header)), top.number if top else -1, min(linked[0], len(whole) - whole.count(" "))))
        linked[0] = 0

    def say(piece: str) -> None:
        text.append(piece)
        if stack and stack[-1].link:
            linked[0] += len("".join(piece.split()))

    at, n = 0, len(source)
    while at < n:
        start = source.find("<", at)
        if start < 0:
            say(source[at:])
            break
        if start > at:
            say(source[at:start])
        m = _MARKUP.match(source, start) or _LOOSE.match(source, start)
        if m is None:
            text.append("<")
            at = start + 1
            continue
        at = m.end()
        name = (m.groupdict().get("name") or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        inline = name in INLINE
        if not inline:
            flush()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    if inline and (stack[i].skipped or stack[i].named):
                        flush()
                    del stack[i:]
                    break
            continue
        attrs = _attrs(m["attrs"])
        while stack and name in CLOSED_BY.get(stack[-1].name, ()):
            stack.pop()
        if not inline and name in CLOSED_BY["p"]:  # also a paragraph with open inline elements
            i = len(stack) - 1
            while i >= 0 and stack[i].name in INLINE:
                i -= 1
            if i >= 0 and stack[i].name == "p":
                del stack[i:]
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
            at = end.start() if end else n
            if end:
                at = source.find(">", at) + 1 or n
            continue
        if name in VOID or (m["attrs"].endswith("/") and name in ("path", "circle", "rect")):
            continue
        above = stack[-1] if stack else _Open("", False, 0, False)
        own = 2 if name == "article" or attrs.get("itemprop") == "articleBody" else 1 if name == "main" or attrs.get("role") == "main" else 0
        skipped, named = above.skipped or _defined(name, attrs), _named(name, attrs, above.scope)
        if inline and ((skipped and not above.skipped) or named):
            flush()
        number = above.number
        if not inline or named:
            number = len(page.elements)
            page.places.append((0, number))
            page.elements.append(Element(f"{above.name}>{name}.{attrs.get('class', '')} {own}{named:d}", own, named, above.number))
        # Of a header only its headings are text, and they only within an article.
        header = (above.header or name == "header") and not (name in ("h1", "h2", "h3", "h4", "h5", "h6") and above.scope == 2)
        stack.append(_Open(name, skipped, max(above.scope, own), header, number, named, above.link or name == "a"))
    flush()
    return page


def _hash(text: str, kind: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 1 + kind) >> 1


def _tokens(page: Page) -> list[int]:
    """The hash of each place's token, in page order."""
    return [_hash(page.elements[i].token, 0) if kind == 0 else _hash(page.blocks[i].text, 1) for kind, i in page.places]


def _inside(page: Page) -> tuple[list[int], list[int]]:
    """The characters inside each element, all and those in links."""
    chars, links = [0] * len(page.elements), [0] * len(page.elements)
    for b in page.blocks:
        if not b.skipped and b.at >= 0:
            chars[b.at] += len(b.text) - b.text.count(" ")
            links[b.at] += b.links
    for i in range(len(page.elements) - 1, -1, -1):  # what is inside an element comes after it
        if (above := page.elements[i].above) >= 0:
            chars[above] += chars[i]
            links[above] += links[i]
    return chars, links


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        held: dict[tuple[str | None, int, int], list[int]] = {}
        for host, url, source in zip(b.column("host").to_pylist(), b.column("url").to_pylist(), b.column("html"), strict=True):
            source = source.as_py() or ""
            page = parse(source)
            tokens = _tokens(page)
            own = xxhash.xxh64_intdigest(f"{url}\n{source}".encode("utf-8", "surrogatepass"))
            chars, links = _inside(page)
            # Of each token: how often, its first place, and the characters inside of it, all and in links.
            count: dict[tuple[int, int], list[int]] = {}
            for place, (t, (kind, i)) in enumerate(zip(tokens, page.places, strict=True)):
                x = count.setdefault((t, kind), [0, place, 0, 0])
                x[0] += 1
                if kind == 0:
                    x[2] += chars[i]
                    x[3] += links[i]
            for (t, kind), (n, place, all_chars, in_links) in count.items():
                mark = xxhash.xxh64_intdigest(f"{own}:{n}")
                x = held.setdefault((host, t, kind), [0, 0, 0, 0, 0, 0])
                x[0] += mark & 0xFFFFFFFF
                x[1] += mark >> 32
                x[2] += 1
                x[3] += place
                x[4] += all_chars
                x[5] += in_links
        if held:
            hosts, tokens, kinds = zip(*held, strict=True)
            cols = [pa.array(c, pa.int64()) for c in zip(*held.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(tokens, pa.int64()), pa.array(kinds, pa.int32()), *cols], names=["host", "token", "kind", *_SUMS])


_SUMS = ("v1", "v2", "n", "places", "chars", "links")


def templates(pages: DataFrame) -> DataFrame:
    """``(host, template)`` from ``pages(host, url, html)``: the tokens of the host's valid classes by place.

    Elements are of the template if two pages of the host hold them, and one
    page in ``ONE_IN``; a host of fewer than ``MIN_PAGES`` pages is its own
    template. Text is of the template if at least ``MIN_PAGES`` pages and
    ``MIN_SHARE`` of the host's hold it, and if its class nests: it lies within
    others, beside them or around them, and overlaps none in part. ``template``:
    (token, kind 0 element or 1 text, class, n pages, share of the host's, part
    of the characters inside that are links).
    """
    seen = pages.mapInArrow(_occurrences, "host string, token long, kind int, " + ", ".join(f"{c} long" for c in _SUMS))
    tokens = seen.groupBy("host", "token", "kind").agg(*[F.sum(c).alias(c) for c in _SUMS])
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"))
    share = F.col("n") / F.col("pages")
    element = (F.col("pages") < MIN_PAGES) | ((F.col("n") >= 2) & (F.col("n") * ONE_IN >= F.col("pages")))
    often = tokens.join(sizes, tokens["host"].eqNullSafe(sizes["host"])).where(F.when(F.col("kind") == 0, element).otherwise((F.col("n") >= MIN_PAGES) & (share >= MIN_SHARE)))
    placed = often.select(tokens["host"].alias("host"), "token", "kind", "v1", "v2", (F.col("places") / F.col("n")).alias("place"), "n", share.alias("share"), (F.col("links") / F.greatest("chars", F.lit(1))).alias("linked"))
    classes = Window.partitionBy("host", "v1", "v2")
    spans = placed.select("host", "token", "kind", "place", "n", "share", "linked", F.struct("v1", "v2").alias("class"), F.min("place").over(classes).alias("first"), F.max("place").over(classes).alias("last"))
    span = F.struct("class", "first", "last")
    rows = spans.groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct("place", "token", "kind", "n", "share", "linked", "class", "first", "last"))).alias("t"),
        F.collect_set(F.when((F.col("share") >= MIN_SHARE) & (F.col("last") > F.col("first")), span)).alias("c"),
    )
    part = lambda x, y: (x["first"] < y["first"]) & (y["first"] < x["last"]) & (x["last"] < y["last"])
    crossed = lambda x, c: F.exists(c, lambda y: part(x, y) | part(y, x))
    token = lambda x: F.struct(x["token"].alias("token"), x["kind"].alias("kind"), F.xxhash64(x["class"]).alias("class"), x["n"].alias("n"), x["share"].alias("share"), x["linked"].alias("linked"))
    nested = F.filter("t", lambda x: (x["kind"] == 0) | ~crossed(x, F.col("c")))
    return rows.select("host", F.transform(nested, token).alias("template"))


@dataclass(frozen=True)
class Known:
    """A token of a template: where it stands there, and what is known of it over the host's pages."""

    place: int
    kind: int
    group: int
    n: int
    share: float
    linked: float


def own_text(page: Page, template: dict[int, Known]) -> str:
    """The text of the page's main slots.

    Without a template nothing is known of slots: all text that HTML doesn't
    define as something else counts.
    """
    left = [i for i, b in enumerate(page.blocks) if not b.skipped]
    if not template:
        return " ".join(page.blocks[i].text for i in left)
    scope, named, menu = [0], [False], [False]  # of each element with all around it; the last is of none
    for e in page.elements:
        k = template.get(_hash(e.token, 0))
        links = k is not None and k.n >= MIN_PAGES and k.share >= MIN_SHARE and k.linked >= LINKS
        scope.insert(-1, max(scope[e.above], e.scope if k else 0))
        named.insert(-1, named[e.above] or (e.named and k is not None))
        menu.insert(-1, menu[e.above] or links)
    left = [i for i in left if not named[page.blocks[i].at] and not (menu[page.blocks[i].at] and page.blocks[i].scope < 2)]
    scopes = {i: scope[page.blocks[i].at] for i in left}
    if left and not any(scopes.values()):  # a page of another layout than its host's
        scopes = {i: page.blocks[i].scope for i in left}
    most = max(scopes.values(), default=0)
    main = [i for i in left if scopes[i] == most]
    found = {i: k for i in main if (k := template.get(_hash(page.blocks[i].text, 1))) and k.kind == 1}
    latest: dict[int, int] = {}
    broken = set()
    for k in found.values():  # a class whose tokens stand in another order on this page is none here
        if k.place < latest.get(k.group, -1):
            broken.add(k.group)
        latest[k.group] = k.place
    fixed = {i for i, k in found.items() if k.group not in broken and (most < 2 or (k.n >= ARTICLE_PAGES and k.share >= ARTICLE_SHARE))}
    if most == 2 and 2 * sum(len(page.blocks[i].text) for i in fixed) >= sum(len(page.blocks[i].text) for i in main):
        fixed = set()  # not a line of the template in an article, but one article on many pages
    return " ".join(page.blocks[i].text for i in main if i not in fixed)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, dict[int, Known]] = {}
    for b in batches:
        texts = []
        hosts = b.column("host").to_pylist()
        for i, (host, source) in enumerate(zip(hosts, b.column("html"), strict=True)):
            if host not in known:
                if len(known) >= KNOWN_HOSTS:
                    known.clear()
                given = b.column("template")[i].as_py() or []
                known[host] = {x["token"]: Known(k, x["kind"], x["class"], x["n"], x["share"], x["linked"]) for k, x in enumerate(given)}
            texts.append(own_text(parse(source.as_py() or ""), known[host]))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` for every row of ``pages(page_id, url, html)``.

    Null or empty html gives empty text, and so does a page without main text.
    Pages without a readable host, or with a null url, make one host together.
    Repeated rows stay, and each counts as a page. Ties in the order of a
    template's tokens go by their hashes. Pages are read whole, however long
    they are; an empty table gives no rows, and other columns are not read.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    made = C.durable(templates(rows.select("host", "url", "html"))).withColumnRenamed("host", "h")
    tokens = made.agg(F.coalesce(F.sum(F.size("template")), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(made) if tokens <= BROADCAST_TOKENS else made, F.col("host") == F.col("h"), "left")
    return joined.select("page_id", "url", "host", "html", "template").mapInArrow(_extract, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the main text of every page."""
    return extract(C.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
