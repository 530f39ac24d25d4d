"""HTML extraction by removal of site templates.

A page is parsed into a tree.  Element subtrees are hashed (tag, class, id,
text, children); Spark counts on how many distinct pages of a host each hash
occurs (pages of the same main text are copies and count as one), and subtrees
on many of them are the host's template and are deleted.  In an article only containers (div, section, list, table ...) with
less than half of its text can be template, never its own paragraphs and
headings, which copies of an article share.  What scripts, navigation, adverts and the like
say of themselves (tag, role, a whole class token) goes as well, in or out of
the article, so that hosts with few pages lose their boilerplate too; a class
drops no wrapper of the only article or of nearly all text, except comments,
notices and adverts (see :func:`_spare`).  What remains of the
article (or main element; of the body where there is none) is cut into blocks.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import settled, whole

#: A subtree is template from this share of its host's distinct pages on, at
#: least ``LEAST`` of them; from ``RECURS`` on whatever the host's size.
SHARE, LEAST, RECURS = 0.2, 4, 100
#: A host is hot from this share (one in so many) of the pages.
HOT = 1000

#: Elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section
    summary table tbody td tfoot th thead tr ul""".split())
DROPPED = frozenset("""aside button canvas datalist dialog footer form frame frameset head iframe input menu nav noembed noframes
    noscript object script search select style svg template textarea title""".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
    cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo
    related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split())
CONTAINERS = frozenset("details div dl fieldset figure hgroup ol section table ul".split())
_FRAMEWORK = frozenset(("#root", "html", "body", "head"))
#: An open element that a start tag of the same group ends.
SIBLINGS = {t: g for g in (("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",), ("thead", "tbody", "tfoot")) for t in g}

#: Names that content is never wrapped in, whatever they hold.
NEVER = NAMES - frozenset("banner masthead modal nav navbar navigation sidebar signup toolbar widget".split())
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)

# a quote opens a value right after "=" alone, and only where it is closed
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>
    |<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)*+)>""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""([^\s=/>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


class Element:
    __slots__ = ("tag", "names", "role", "hidden", "spared", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.names, self.role, self.hidden = tag, "", "", False
        self.spared = False  # no class name drops it
        self.children: list[Element | str] = []
        if attributes and not attributes.isspace():
            for name, value in _ATTRIBUTE.findall(attributes):
                name = name.lower()
                if value[:1] in ("'", '"') and len(value) > 1 and value[-1] == value[0]:
                    value = value[1:-1]
                if name in ("class", "id"):
                    self.names += " " + entities.unescape(value).lower()
                elif name == "role":
                    self.role = value.strip().lower()
                elif name == "hidden" or name == "style" and _HIDDEN.search(value):
                    self.hidden = True


def parse(page: str) -> Element:
    """The element tree; missing end tags are supplied where the next start
    tag or an outer end tag implies them, stray end tags are ignored."""
    root = Element("#root")
    stack = [root]
    at = 0
    scan = _TAG.search
    while True:
        m = scan(page, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].children.append(page[at:m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in BLOCKS:
            _close(stack, "p", BLOCKS - {"p"})
        if tag in SIBLINGS:
            for s in SIBLINGS[tag]:
                _close(stack, s, frozenset(("ul", "ol", "dl", "table", "select", "menu")))
        e = Element(tag, m.group(3))
        stack[-1].children.append(e)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if stop > at:
                e.children.append(page[at:stop])
            close = page.find(">", stop)
            at = len(page) if close < 0 else close + 1
        elif not m.group(3).endswith("/") or tag in BLOCKS:
            stack.append(e)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def _close(stack: list[Element], tag: str, barriers: frozenset[str]) -> None:
    """End the innermost open ``tag`` unless a barrier stands before it."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in barriers:
            return


def is_boilerplate(e: Element, in_article: bool) -> bool:
    """By tag, role, a whole token of class or id; an article's own header is
    content, and nothing makes the page itself boilerplate."""
    if e.tag in _FRAMEWORK:
        return e.tag == "head"
    if e.tag in DROPPED or e.hidden or e.role in ROLES or e.tag == "header" and not in_article:
        return True
    return bool(e.names) and not e.spared and not NAMES.isdisjoint(e.names.split())


def containers(root: Element) -> list[Element]:
    """The outermost articles, else main elements, else the body or all."""
    for tags in (("article",), ("main",)):
        out: list[Element] = []
        todo = [root]
        while todo:
            e = todo.pop()
            if e.tag in tags:
                out.append(e)
            elif e is root or not is_boilerplate(e, False) or e.tag == "html":
                todo += [c for c in reversed(e.children) if isinstance(c, Element)]
        if out:
            return out
    return [root]


def _by_depth(root: Element) -> list[Element]:
    """All elements, a parent before its children; no recursion, any depth."""
    order = [root]
    for e in order:
        order += [c for c in e.children if isinstance(c, Element)]
    return order


def subtree_hashes(root: Element, found: list[Element]) -> dict[int, int]:
    """Hash (signed 64 bits) of every subtree that may be template, by identity
    of its element: any that is not in an element of ``found`` and does not hold
    one; in them containers of less than half of the text.  With ``found`` the
    root itself (a page without article) any subtree."""
    article = {id(e) for e in found} if found != [root] else set()
    order = _by_depth(root)
    around: dict[int, int] = {id(root): 0}  # size of the article an element is in
    for e in order:
        inside = max(1, _text_size(e)) if id(e) in article else around[id(e)]
        for c in e.children:
            if isinstance(c, Element):
                around[id(c)] = inside
    out: dict[int, int] = {}
    seen: dict[int, tuple[str, int, bool]] = {}  # hash, text size, whether an article is inside
    for e in reversed(order):
        parts, size, holds = [e.tag, e.names], 0, id(e) in article
        for c in e.children:
            if isinstance(c, Element):
                h, n, below = seen.pop(id(c))
                size, holds = size + n, holds or below
            else:
                h = " ".join(c.split())
                size += len(h)
            if h:
                parts.append(h)
        digest = xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
        seen[id(e)] = (f"{digest:x}", size, holds)
        inside = around[id(e)]
        if not holds and e.tag not in _FRAMEWORK and (not inside or e.tag in CONTAINERS and 2 * size < inside):
            out[id(e)] = digest - (digest >> 63 << 64)
    return out


def _text_size(e: Element) -> int:
    size, todo = 0, [e]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Element):
                todo.append(c)
            else:
                size += len(" ".join(c.split()))
    return size


def _spare(root: Element) -> Element:
    """Mark what no class or id drops: where every article and main element is
    in something so named, what holds them; where there is none, what holds
    three quarters of the text that is left without the named.  Comments,
    notices, adverts and the like (:data:`NEVER`) are never spared."""
    order = _by_depth(root)
    named: dict[int, bool] = {}
    for e in order:
        named[id(e)] = named.get(id(e), False) or is_boilerplate(e, False)
        for c in e.children:
            if isinstance(c, Element):
                named[id(c)] = named[id(e)]
    content = [e for e in order if e.tag in ("article", "main")]
    if any(not named[id(e)] for e in content):
        return root
    size: dict[int, int] = {}
    holds: dict[int, bool] = {}
    for e in reversed(order):
        lost = e.tag not in _FRAMEWORK and (e.tag in DROPPED or e.hidden or e.role in ROLES or not NEVER.isdisjoint(e.names.split()))
        n, inside = 0, e.tag in ("article", "main")
        for c in e.children:
            if isinstance(c, str):
                n += len(" ".join(c.split()))
            else:
                n += size[id(c)]
                inside = inside or holds[id(c)]
        size[id(e)], holds[id(e)] = (0, False) if lost else (n, inside)
    for e in order:
        if e.names and size[id(e)]:
            e.spared = holds[id(e)] or not holds[id(root)] and 4 * size[id(e)] > 3 * size[id(root)]
    return root


def tree(page: str) -> Element:
    return _spare(parse(page))


def page_hashes(page: str) -> tuple[int, list[int]]:
    """The hash of a page's main text before any template is deleted, which
    its copies share, and the distinct subtree hashes that may be template."""
    root = tree(page)
    found = containers(root)
    text = "\n".join(_blocks(root, found, {}, set()))
    main = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return main - (main >> 63 << 64), sorted(set(subtree_hashes(root, found).values()))


def blocks(page: str, template: set[int]) -> list[str]:
    """The main text's blocks in page order; ``template``: hashes of subtrees to delete."""
    root = tree(page)
    found = containers(root)
    return _blocks(root, found, subtree_hashes(root, found) if template else {}, template)


def _blocks(root: Element, found: list[Element], hashes: dict[int, int], template: set[int]) -> list[str]:
    article = found != [root]
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    for e in found:
        todo: list[Element | str | None] = list(reversed(e.children))  # None: a block ends
        while todo:
            c = todo.pop()
            if c is None:
                flush()
            elif isinstance(c, str):
                run.append(c)
            elif is_boilerplate(c, article) or hashes.get(id(c)) in template:
                if c.tag in BLOCKS:
                    flush()
            elif c.tag == "br":
                run.append(" ")
            else:
                if c.tag in BLOCKS:
                    flush()
                    todo.append(None)
                todo += reversed(c.children)
        flush()
    return out


# --- Spark ---------------------------------------------------------------------

def host(url: Column) -> Column:
    """Lower-case host of a url; empty for a null or odd one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _joined(rows: DataFrame, table: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` left-joined to ``table`` (a row per key, ``rows`` counting the
    key's rows among ``total``).  Hot keys (at most ``HOT`` of them for each
    row's keys, by arithmetic) are broadcast; the others meet in a join whose
    keys each hold less than one in ``HOT`` of the rows."""
    t = table.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in table.columns if c not in on])
    extra = [c for c in t.columns if c != "rows"]
    match = [F.col(c) == F.col(f"_{c}") for c in on]
    key = f"_{on[0]}"
    first = rows.join(F.broadcast(t.filter(F.col("rows") * HOT >= total).select(*extra)), match, "left")
    cold = t.filter(F.col("rows") * HOT < total).select(*extra)
    keys = [f"_{c}" for c in on]
    if cold.isEmpty():
        return first.drop(*keys)
    rest = first.filter(F.col(key).isNull()).drop(*extra).join(cold, match, "left")
    return first.filter(F.col(key).isNotNull()).drop(*keys).unionByName(rest.drop(*keys))


def read_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, key, main, hashes) per row, all 64-bit hashes: of the host, the
    page, its main text, and the subtrees that may be template."""
    @F.pandas_udf("struct<main:long,hashes:array<long>>")
    def hashes(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_hashes(b) for b in bodies], columns=["main", "hashes"])

    return settled(pages.select(F.xxhash64(host(F.col(url))).alias("host"), F.xxhash64(whole(html)).alias("key"), hashes(whole(html)).alias("p"))
                   .select("host", "key", "p.main", "p.hashes"))


def templates(each: DataFrame, share: float = SHARE, least: int = LEAST, recurs: int = RECURS) -> DataFrame:
    """(host, h, listed): the subtree hashes that occur on at least ``least``
    distinct pages of the host that are ``share`` of them (``listed``) or
    ``recurs``, of the table :func:`read_pages` makes.

    A page gives each hash once, and so do all its copies together, by host
    and main text; counts are partial sums before the shuffle."""
    # the page itself is one more row (null hash) that counts the host's pages
    own = each.select("host", "main", F.explode(F.array_append("hashes", F.lit(None).cast("long"))).alias("h")).distinct()
    n = own.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    often = settled(n.filter(F.col("h").isNull() | (F.col("n") >= least)))
    sums = often.groupBy("host").agg(F.count(F.lit(1)).alias("rows"), F.max(F.when(F.col("h").isNull(), F.col("n"))).alias("pages"))
    found = _joined(often.filter("h is not null"), settled(sums), ["host"], often.count())
    listed = F.col("n") >= F.col("pages") * share
    return found.select("host", "h", listed.alias("listed")).filter(listed | (F.col("n") >= recurs))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", **template_args) -> DataFrame:
    """(page id, url, text, n_chars) of every page: the main text's blocks,
    white space inside a block one space, joined by newlines.

    Null and empty pages give an empty text; pages of a null or odd url share
    the host ''; repeated rows are extracted one by one and, like all pages of one main
    text, counted once; an
    empty table gives no rows; other columns are ignored.

    What is on a share of a host's pages is a short list a host (on average S
    subtrees a page give S / share at most), which all its pages get.  What
    only recurs can be many subtrees of a large host: each page gets those it
    has.  Hot keys are broadcast, see :func:`_joined`."""
    each = read_pages(pages, url, html)
    total = each.count()
    found = settled(templates(each, **template_args))
    lists = found.groupBy("host").agg(F.sort_array(F.collect_list(F.when(F.col("listed"), F.col("h")))).alias("hashes"),
                                      F.max(~F.col("listed")).alias("more"))
    lists = settled(lists.join(each.groupBy("host").agg(F.count(F.lit(1)).alias("rows")), "host"))

    @F.pandas_udf("string")
    def text(bodies: pd.Series, lists: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(blocks(b, {x for part in (h, o) if part is not None for x in part}))
                          for b, h, o in zip(bodies, lists, own)], dtype=object)

    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), whole(html).alias("html"), F.xxhash64(host(F.col(url))).alias("host"))
    listed = _joined(rows, lists, ["host"], total)
    plain = listed.withColumn("own", F.lit(None).cast("array<long>"))
    if not lists.filter("more").isEmpty():
        wide = F.coalesce("more", F.lit(False))
        recurring = _recurring(each, found.filter(~F.col("listed")).select("host", "h"))
        own = _joined(listed.filter(wide).withColumn("key", F.xxhash64("html")), recurring, ["host", "key"], total)
        plain = plain.filter(~wide).unionByName(own.drop("key"))
    done = plain.select("id", "url", text("html", "hashes", "own").alias("text"))
    return done.select(F.col("id").alias(page_id), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))


def _recurring(each: DataFrame, found: DataFrame) -> DataFrame:
    """(host, key, own, rows): which of the hashes ``found`` (host, h) each
    distinct page has, and its rows."""
    has = settled(each.groupBy("host", "key").agg(F.count(F.lit(1)).alias("copies"), F.first("hashes").alias("hashes"))
                  .select("host", "key", "copies", F.explode("hashes").alias("h")))
    n = has.groupBy("host", "h").agg(F.count(F.lit(1)).alias("rows")).join(found, ["host", "h"])
    met = _joined(has, settled(n.withColumn("met", F.lit(True))), ["host", "h"], has.count()).filter("met")
    return settled(met.groupBy("host", "key").agg(F.collect_list("h").alias("own"), F.first("copies").alias("rows")))
