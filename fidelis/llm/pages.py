"""Main text of web pages by removing site templates.

A page becomes a tree of elements, read tolerantly: unclosed and stray tags, raw text elements, comments. Every element
is hashed with all that is below it, whatever it calls itself; Spark counts, per host, the pages with different main
text that have each hash, and subtrees that recur on several pages of their host are the site's template: they are
deleted from all its pages, inside articles and outside. Of the rest go the parts that say outright that they are
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments: by element, role, or a
name in class or id; inside a marked article only a whole class name counts, so ``market-share`` is no share button.
What is left of the article (of the body, where no article is marked) is the text. Paragraphs, headings, list items and
cells of a marked article are never counted: passages that an author repeats are content. Elsewhere they have to be on a
share of the host's pages too, since short ones (a cell with a number) recur by chance on a few pages of any large host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import written

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTENT = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody thead tfoot figcaption".split())
#: Elements that end an open one of the same set when they start.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
GONE = set(
    "nav footer aside form script style noscript template iframe button select option textarea input svg canvas object"
    " embed audio video dialog menu head title noembed noframes map".split()
)
GONE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Names of what the result leaves out. Anything that calls itself something else is left to recurrence.
GONE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsored banner menu menus nav navbar navigation breadcrumb breadcrumbs"
    " sidebar sidebars footer notice notices cookie cookies consent comment comments".split()
)
#: Raw text that has no part in a hash.
NOISE = RAW - {"textarea", "xmp", "title"}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    __slots__ = ("below", "gone", "kind", "root", "sign")

    def __init__(self, kind: str, gone: bool = False, root: bool = False) -> None:
        self.kind, self.gone, self.root, self.below, self.sign = kind, gone, root, [], 0


def _says(kind: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether a part calls itself something other than content; whether it calls itself the main content."""
    gone, root = kind in GONE or (kind == "header" and not inside), kind in ("article", "main")
    if attributes.strip():
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id") and kind not in ("body", "html", "main"):
                words = {w.lower() for w in (value.split() if inside else WORDS.findall(value))}
                gone = gone or bool(words & GONE_WORDS) or ("header" in words and not inside and kind not in ("article", "section"))
            elif name == "role":
                gone, root = gone or value.lower() in GONE_ROLES, root or value.lower() == "main"
            elif name == "itemprop":
                root = root or value == "articleBody"
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                gone = True
    return gone, root and not gone


def tree(source: str) -> Element:
    """The page as elements and strings."""
    top = Element("#page")
    stack, at, inside = [top], 0, 0
    while at < len(source):
        found = TOKEN.search(source, at)
        if found is None:
            stack[-1].below.append(source[at:])
            break
        if found.start() > at:
            stack[-1].below.append(source[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        kind = found[2].lower()
        if found[1]:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d].kind == kind), 0)
            if depth:
                inside -= sum(e.root for e in stack[depth:])
                del stack[depth:]
            continue
        ends = CLOSES.get(kind, set())
        if kind in BLOCKS and any(e.kind == "p" for e in stack):
            ends = ends | {"p"}
        while ends and (depth := next((d for d in range(len(stack) - 1, 0, -1) if stack[d].kind in ends), 0)):
            if "p" not in ends and any(e.kind in ("ul", "ol", "table", "dl") for e in stack[depth + 1 :]):
                break
            inside -= sum(e.root for e in stack[depth:])
            del stack[depth:]
        gone, root = _says(kind, found[3], inside > 0)
        element = Element(kind, gone, root)
        if root:  # a form around the whole page is no form to leave out
            for e in stack:
                e.gone = e.gone and e.kind != "form"
        stack[-1].below.append(element)
        if kind in RAW:
            end = re.compile(rf"</{re.escape(kind)}[\s/>]", re.I).search(source, at)
            element.below.append(source[at : end.start()] if end else source[at:])
            close = source.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else len(source)
        elif kind not in VOID and not found[3].rstrip().endswith("/"):
            stack.append(element)
            inside += root
    return top


def stays(e: Element, root: Element | None, template: frozenset[int] | set[int]) -> bool:
    """Whether an element is neither template nor says that it is no content; ``root``: the marked article it is in."""
    return not e.gone and (e.sign not in template or (root is not None and root.root and e.kind in CONTENT))


def roots(top: Element, template: frozenset[int] | set[int] = frozenset()) -> list[Element]:
    """The outermost marked articles, those inside a main part before the part itself; else the page."""
    found, queue = [], [(top, None)]
    while queue:
        e, within = queue.pop()
        if e.root:
            found.append(e)
            within = e
        queue += [(x, within) for x in reversed(e.below) if isinstance(x, Element) and not (e.root and e.kind == "article") and stays(x, within, template)]
    inner = [e for e in found if e.kind != "main"]
    return inner or found or [top]


def sign(e: Element) -> int:
    """Hashes every subtree by its elements and text; scripts and styles leave no trace."""
    order, stack = [], [e]
    while stack:
        order.append(x := stack.pop())
        stack += [y for y in x.below if isinstance(y, Element)]
    for x in reversed(order):
        parts = [x.kind]
        for y in x.below:
            if isinstance(y, str):
                parts.append(" ".join(entities.unescape(y).split()))
            elif y.kind not in NOISE:
                parts.append(str(y.sign))
        x.sign = xxhash.xxh3_64_intdigest("\0".join(p for p in parts if p)) - 2**63
    return e.sign


def containers(top: Element) -> tuple[set[int], set[int]]:
    """Hashes of what can be template on a page, containers and passages: all blocks but the content of marked articles.

    What is below a part that names itself goes with it, so only the part is counted.
    """
    out, passages, stack = set(), set(), [(top, False)]
    while stack:
        e, within = stack.pop()
        within = within or (e.root and e.kind != "main")
        content = e.kind in CONTENT
        if e is not top and e.kind in BLOCKS and not (within and content):
            (passages if content else out).add(e.sign)
        if not e.gone and not (within and content):
            stack += [(x, within) for x in e.below if isinstance(x, Element)]
    return out, passages


def blocks(root: Element, template: frozenset[int] | set[int]) -> list[str]:
    """Texts of the blocks in page order, without what is gone or template."""
    out, run, stack = [], [], [root]

    def flush() -> None:
        if text := " ".join(entities.unescape("".join(run)).split()):
            out.append(text)
        run.clear()

    while stack:
        e = stack.pop()
        if e is None:
            flush()
        elif isinstance(e, str):
            run.append(e)
        elif e.kind == "br":
            run.append(" ")
        elif e is root or stays(e, root, template):
            block = e.kind in BLOCKS or e.kind == "#page"
            stack += [None] * block + e.below[::-1] + [None] * block
    flush()
    return out


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, host, source in batch[["key", "host", "html"]].itertuples(index=False):
            top = tree(source)
            sign(top)
            text = xxhash.xxh3_64_intdigest("\0".join(b for r in roots(top) for b in blocks(r, frozenset()))) - 2**63
            rows.append((key, host, text, *map(sorted, containers(top))))
        yield pd.DataFrame(rows, columns=["key", "host", "page", "subtrees", "passages"])


def extract(pages: DataFrame, min_pages: int = 3, share: float = 0.3, broadcast_rows: int = 200_000) -> DataFrame:
    """``pages`` (``url``, ``html`` and any others) with ``text``, the main text, and ``n_chars``, its code points.

    An element is template if it is on ``min_pages`` pages of its host or more, counting pages with the same main text
    once; a passage outside marked articles (an element of CONTENT) has to be on ``share`` of them as well. Blocks are
    joined by a newline, white space inside a block is one space, character references are decoded, nothing else is
    dropped. Null and empty html give an empty text; a page without a host has no template but is read like any other.
    Pages may be of any length and nested to any depth. Rows repeat as in ``pages``; other columns stay, columns named ``text`` or ``n_chars`` are replaced; an empty table
    gives an empty table.
    """
    keyed = pages.withColumn("__key", F.xxhash64("url", "html"))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    known = keyed.filter("url is not null and html is not null").select(F.col("__key").alias("key"), host.alias("host"), "html").filter("host <> ''")
    seen = written(known.mapInPandas(_subtrees, "key long, host string, page long, subtrees array<long>, passages array<long>"), "subtrees")
    sizes = seen.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    parts = [
        F.transform("subtrees", lambda s: F.struct(s.alias("subtree"), F.lit(False).alias("passage"))),
        F.transform("passages", lambda s: F.struct(s.alias("subtree"), F.lit(True).alias("passage"))),
    ]
    each = seen.select("host", "page", F.explode(F.concat(*parts)).alias("part")).select("host", "page", "part.*").distinct()
    each = each.groupBy("host", "subtree", "passage").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    template = each.join(sizes, "host").filter(~F.col("passage") | (F.col("n") >= share * F.col("pages"))).select("host", "subtree")
    hits = seen.select("key", "host", F.explode(F.concat("subtrees", "passages")).alias("subtree")).join(template, ["host", "subtree"])
    hits = written(hits.groupBy("key").agg(F.collect_set("subtree").alias("__template")), "template").withColumnRenamed("key", "__key")
    small = hits.limit(broadcast_rows + 1).count() <= broadcast_rows
    joined = keyed.join(F.broadcast(hits) if small else hits, "__key", "left")

    @F.pandas_udf("string")
    def main_text(sources: pd.Series, templates: pd.Series) -> pd.Series:
        out = []
        for source, template in zip(sources, templates):
            top = tree(source or "")
            if template is not None and len(template):
                sign(top)
            gone = frozenset(int(t) for t in template) if template is not None else frozenset()
            out.append("\n".join(b for r in roots(top, gone) for b in blocks(r, gone)))
        return pd.Series(out, dtype=object)

    out = joined.withColumn("text", main_text.asNondeterministic()("html", "__template"))
    return out.withColumn("n_chars", F.length("text").cast("long")).drop("__key", "__template")
