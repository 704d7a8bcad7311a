"""Operator 6, HTML extraction: equivalence-class template deduction.

Pages of a host come from one template. Each page is read into elements; an element's token is the
path of tag names and classes from the root to it, kept as a hash of the parent's and its own name.
Tokens of a host that occur as often as each other on every page (equal occurrence vectors) form an
equivalence class. A class is valid if it has more than one token; its tokens nest as their paths do.
Classes that reach enough of the host's pages nest into the template; what lies in an element of the
template, and in none deeper, is a slot.

An occurrence vector is kept as the sum over pages of a hash of (page, count), so vectors of hosts of
any size are summed by partial aggregation and never gathered. A slot also has the characters it
holds over all pages, those of them in links, and its tag roles. The host's main slot is the
article-like element of the template with most text. Where the template has none, all its slots
count that hold no menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
comments by their names, and that aren't menus by their text: slots of which nearly all text on the
host lies in links, and around which no element has text of its own. Pages are read a second time and give the text of their slots; a page without the main
slot falls back to the same rules on itself.

Blocks of text are tokens too, by path and digest of the text, and so nest in their elements. Those of
classes that hold on every page with text are the template's own text and are dropped, wherever they
stand; what is left fills the slots. A host needs LEAST different pages with text for that, and for menus.

Text: character references are decoded, white space inside a block becomes one space, ends are
trimmed, and blocks are joined by two line feeds. Nothing else is dropped. A `<` that begins no whole tag
is text. Reading takes time in proportion to the page, however deep its elements nest.

Null or empty html gives an empty text; a null url is a host of its own; repeated rows are repeated
pages; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Collection, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table, written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe"))
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that never hold main text.
DROPPED = frozenset("nav header footer aside form script style noscript template iframe button select option textarea input label svg canvas object dialog menu head title figcaption".split()) - {"figcaption"}
#: Words of class, id or role that mark what isn't main text, alone or beside further such words and those of UI.
SIDE = frozenset("ad ads advert adverts advertisement advertising adslot banner promo promos promotion sponsor sponsored sponsors nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar sidebars side aside widget widgets related share sharing social notice notices cookie cookies consent alert alerts popup modal newsletter subscribe signup login form forms search comment comments reply replies disqus toolbar pagination pager skip complementary contentinfo".split())
UI = frozenset("site page main top bottom left right box bar list item items button buttons link links block blocks container wrapper wrap section area slot inner outer posts post icons icon results result global primary secondary mobile desktop content article entry story blog user reader to the of in js is has sticky fixed small large".split())
MAIN = re.compile(r"(?:^|[^a-z])(?:article\w*|main|content|post|entry|story|body-?text|maintext)(?=$|[^a-z])")

#: Hosts and blocks of their templates.
BROADCAST_HOSTS = 500_000
#: Different pages with text from which a host's template takes in blocks of text.
LEAST = 5
#: What a token is: an element's path, a block of text, or the page itself.
PATH, TEXT, PAGE = range(3)

#: Share of a slot's text in links from which it is a menu.
MENU = 0.8

# A quote opens a value only after an equals sign and if it is closed; a tag has no `<` outside of values.
_MARKUP = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>=]++|=(?:\s*+"[^"]*+"|\s*+'[^']*+')?+)*+)>""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PART = re.compile(r"[a-z]+|[^\W\d_a-z]+")
_SPACE = re.compile(r"\s+")


class Node(NamedTuple):
    path: int
    role: str  # "side" for what lies in side matter, "main" for article-like elements
    parent: int
    in_link: bool
    within: int  # the innermost structural element, itself included


def is_side(marks: str) -> bool:
    """Whether one of the names, in lower case, says side matter: search-box does, search-and-rescue doesn't."""
    for name in marks.split():
        parts = _PART.findall(name)
        if any(x in SIDE for x in parts) and all(x in SIDE or x in UI for x in parts):
            return True
    return False


def read(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements, and the text blocks in order as (innermost element, text). Element 0 is the page."""
    nodes, blocks = [Node(0, "", 0, False, 0)], []
    stack: list[tuple[str, int]] = [("", 0)]
    open_tags: Counter = Counter()
    text: list[str] = []
    held = 0

    def close_block() -> None:
        if text:
            said = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if said:
                blocks.append((held, said))
            text.clear()

    def pop_to(depth: int) -> None:
        if any(tag in BLOCK for tag, _ in stack[depth:]):
            close_block()
        open_tags.subtract(tag for tag, _ in stack[depth:])
        del stack[depth:]

    def say(plain: str) -> None:
        nonlocal held
        if not text:
            held = stack[-1][1]
        elif held != stack[-1][1] and (nodes[held].role == "side") != (nodes[stack[-1][1]].role == "side"):
            close_block()
            held = stack[-1][1]
        text.append(plain)

    at, size = 0, len(html)
    while at < size:
        m = _MARKUP.search(html, at)
        if plain := html[at : m.start() if m else size]:
            say(plain)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_tags[tag] > 0:
                pop_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            elif tag in BLOCK:
                close_block()
            continue
        if tag == "br":
            if text:
                text.append(" ")
            continue
        if tag in BLOCK:
            close_block()
            if open_tags["p"] > 0:  # a block ends the paragraph that it stands in
                inline = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in BLOCK)
                if stack[inline][0] == "p":
                    pop_to(inline)
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == tag:
                pop_to(len(stack) - 1)
        if tag in VOID:
            continue
        marks = _HUMP.sub("-", " ".join((a or b or c) for _, a, b, c in _NAMED.findall(m[3]))).lower() if m[3] else ""
        parent = nodes[stack[-1][1]]
        structural = tag not in ("p", "b", "i", "a", "em", "strong", "span", "li", "u", "s", "small", "sup", "sub", "code")
        name = tag + ("." + ".".join(sorted(marks.split())) if marks and structural else "")
        own = tag == "header" and open_tags["article"] > 0  # an article's own header holds its title
        side = parent.role == "side" or (tag in DROPPED and not own) or (tag not in ("html", "body", "article", "main") and is_side(marks))
        role = "side" if side else "main" if tag in ("article", "main") or (structural and MAIN.search(marks)) else parent.role
        nodes.append(Node(xxhash.xxh3_64_intdigest(name, parent.path) >> 1, role, stack[-1][1], parent.in_link or tag == "a", len(nodes) if structural else parent.within))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(html, at)
            at = size if end is None else (html.find(">", end.start()) + 1 or size)
            continue
        stack.append((tag, len(nodes) - 1))
        open_tags[tag] += 1
    close_block()
    return nodes, blocks


def block_digest(path: int, said: str) -> int:
    return xxhash.xxh3_64_intdigest(said, path) >> 1


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page and token: its count, hash for the occurrence vector, and its text."""
    for batch in slices(batches, "html"):
        out: list[tuple] = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            nodes, blocks = read(html)
            chars, linked, own = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
            for held, said in blocks:
                chars[held] += len(said)
                linked[held] += len(said) * nodes[held].in_link
                own[nodes[held].within] += len(said) * (not nodes[held].in_link)
            for i in range(len(nodes) - 1, 0, -1):  # children stand after their parents
                chars[nodes[i].parent] += chars[i]
                linked[nodes[i].parent] += linked[i]
            seen: dict[int, list] = {}
            among = [False] * len(nodes)
            for i, node in enumerate(nodes[1:], 1):
                # Links that stand among other text of an element around them are part of it.
                among[i] = among[node.parent] or own[nodes[node.parent].within] > 0
                at = seen.setdefault(node.path, [0, 0, 0, node.role])
                at[0], at[1], at[2] = at[0] + 1, at[1] + chars[i], at[2] + linked[i] * (not among[i])
            mark = xxhash.xxh3_64_intdigest(html)
            tokens = [(PATH, path, n, c, k, role) for path, (n, c, k, role) in seen.items()]
            tokens += [(TEXT, digest, n, 0, 0, "") for digest, n in Counter(block_digest(nodes[held].path, said) for held, said in blocks).items()]
            if blocks:
                tokens.append((PAGE, mark >> 1, 1, 0, 0, ""))
            out += [(host, kind, path, n, xxhash.xxh3_64_intdigest(n.to_bytes(8, "little"), mark) >> 20, c, k, role) for kind, path, n, c, k, role in tokens]
        if out:
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in TOKENS.split(", ")])


TOKENS = "host string, kind int, path long, n long, vector long, chars long, linked long, role string"


def templates(pages: DataFrame, reach: float = 0.2) -> DataFrame:
    """(host, main, template, menus): the path of each host's main slot, null where its template has no element
    that may hold main text, the digests of the template's blocks of text, and the paths of slots that hold
    links. pages: (host, html). A class of elements joins the template if it has several tokens and they reach
    the given share of the host's pages (of all with text, for menus), a class of blocks if they stand on
    every page with text; a page bounds how many do."""
    tokens = pages.mapInArrow(_occurrences, TOKENS)
    summed = written(tokens.groupBy("host", "kind", "path").agg(
        # Written, since two aggregations read it and pages are read only once for both.
        # The entries' halves are summed apart: 2^41 pages of a host fit 64 bits.
        F.struct(F.sum(F.col("vector").bitwiseAND(F.lit((1 << 22) - 1))).alias("low"), F.sum(F.shiftright("vector", 22)).alias("high")).alias("vector"), F.count("*").alias("on_pages"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("role").alias("role"), F.max("role").alias("role_high")
    ))
    is_page = F.col("kind") == PAGE
    sizes = summed.groupBy("host").agg(
        F.max(F.when(F.col("kind") == PATH, F.col("on_pages"))).alias("host_pages"), F.sum(F.when(is_page, F.col("on_pages"))).alias("with_text"), F.count_if(is_page).alias("different")
    )
    classes = summed.groupBy("host", "kind", "vector", "on_pages").agg(
        # The main element of the class that holds most text.
        F.max(F.when((F.col("kind") == PATH) & (F.col("role") == "main") & (F.col("role_high") == "main") & (F.col("n") == F.col("on_pages")), F.struct("chars", "path"))).alias("best"),
        F.collect_list(F.when(F.col("kind") == TEXT, F.col("path"))).alias("blocks"),
        F.collect_list(F.when((F.col("kind") == PATH) & (F.col("n") == F.col("on_pages")) & (F.col("linked") >= MENU * F.col("chars")) & (F.col("chars") > 0), F.col("path"))).alias("menus"),
        F.count("*").alias("tokens"),
    )
    sized = classes.join(sizes, "host")
    known = F.col("different") >= LEAST
    everywhere = (F.col("kind") == TEXT) & (F.col("on_pages") == F.col("with_text")) & known
    valid = (F.col("kind") == PATH) & (F.col("tokens") > 1)
    chosen = sized.groupBy("host").agg(
        F.max(F.when(valid & (F.col("on_pages") >= reach * F.col("host_pages")), F.col("best"))).alias("best"),
        F.flatten(F.collect_list(F.when(everywhere, F.col("blocks")))).alias("template"),
        F.flatten(F.collect_list(F.when(valid & known & (F.col("on_pages") >= F.col("with_text")), F.col("menus")))).alias("menus"),
    )
    return chosen.select("host", F.col("best.path").alias("main"), "template", "menus")


def main_text(html: str, slot: int | None, template: Collection[int] = (), menus: Collection[int] = ()) -> str:
    nodes, blocks = read(html)
    inside, menu = [False] * len(nodes), [False] * len(nodes)
    for i in range(1, len(nodes)):
        inside[i] = inside[nodes[i].parent] or nodes[i].path == slot
        menu[i] = menu[nodes[i].parent] or nodes[i].path in menus
    some = [x for x in blocks if inside[x[0]] and nodes[x[0]].role != "side"]
    some = some or [x for x in blocks if nodes[x[0]].role == "main"]
    some = some or [x for x in blocks if nodes[x[0]].role != "side" and not menu[x[0]]]
    return "\n\n".join(said for held, said in some if not template or block_digest(nodes[held].path, said) not in template)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        rows = zip(*(batch.column(c).to_pylist() for c in ("html", "main", "template", "menus")), strict=True)
        texts = [main_text(html, slot, frozenset(template or ()), frozenset(menus or ())) for html, slot, template, menus in rows]
        yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")).alias("host"),
    )
    # One short row a host. Up to BROADCAST_HOSTS of them and their blocks, counted first, go to the pages; beyond
    # that pages move to their hosts' rows, and Spark splits the side of a host of many pages.
    chosen = cut(templates(rows.select("host", "html")))
    if (chosen.agg(F.sum(1 + F.size("template") + F.size("menus"))).first()[0] or 0) <= BROADCAST_HOSTS:
        chosen = F.broadcast(chosen)
    return rows.join(chosen, "host", "left").select("page_id", "url", "html", "main", "template", "menus").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
