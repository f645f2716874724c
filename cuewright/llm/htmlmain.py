"""HTML extraction by site style trees.

Pages of a host are merged into one tree: a node is a path of elements with
their presentation (tag, class, id). Two entropies weigh it: of the sequences of
children it has over the host's pages (presentation), and of the texts at its
leaves over the pages (content); what looks the same everywhere has low
entropy and little importance. The importance of an element with children
combines its own presentation's with its children's, own text being a child, by
DECAY to the power of its presentations. A page's element is removed if it and
all that has text in it are of low importance; b, i, em, strong and br stay with
the line they are in. What is left gives the page's main text. Pages count once by
their text outside of boilerplate, so copies of a page don't make it boilerplate.

A host's tree is kept as counts of (host, node, feature), so that no task gets all
pages of a large host; its nodes meet in one task. Navigation, headers of a page,
footers, asides, forms, scripts, styles and what has the role of such a part are
removed for every host, and so is what a class or the id calls such a part, an advert,
a notice or comments: a name of PARTS alone or with words of PLACES around it, so
user-comments, commentlist or top-ad, but not has-sidebar or related-work. Such a name
decides alike on a host of any number of pages. A class or id that only has such a name
in it (NAMED) multiplies the importances that a tree gives to its branch by KEYWORD.
Where fewer than MIN_PAGES page texts of a host have an element its tree tells nothing
of it. A branch with over half of the page's text, or of that of its articles, isn't
judged by its name, but for comments, adverts and consent (SURE) that hold no h1, main
or article of another name. Where names would leave no text none count.

Cases: null or empty html, or no content: empty text. Null url or no host: one
host of its own, the empty name. Null page_id: kept. Repeated rows: one result
row each. Cut-off markup counts as closed at the end. Elements more than MAX_DEPTH
levels deep are one node of the tree with their siblings. Empty table: empty result.
Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import stored, table, trim
from .urlfilter import host_of

MIN_PAGES = 4
#: Branches of less importance are removed.
MIN_IMPORTANCE = 0.25
#: Weight of an element's own presentation against its children's importance.
DECAY = 0.9
#: Levels of elements that a tree tells apart.
MAX_DEPTH = 200
#: What a name of boilerplate leaves of the importance of an element and of what is in it.
KEYWORD = 0.5
#: HTML's void, block, raw text and boilerplate elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template iframe textarea svg canvas object head title select button".split())
BOILER = frozenset("nav footer aside form menu dialog".split())
#: Elements that stay with the line of text they are in.
FORMAT = frozenset("b i em strong br".split())
#: What a node counts: pages, sequences of children, pages with own text, texts.
SEEN, LOOKS, TEXTED, TEXTS = range(4)
#: Stands for an element's own text below its path.
OWN_TEXT = "/#text"
CLOSES_P = BLOCK - {"br", "html", "head", "body", "title", "option", "caption", "legend", "summary", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Names of parts that are no content: of those that can't hold a page's article, and of others.
SURE = "ad ads advert adverts advertisement advertisements adsense comment comments disqus replies cookie cookies consent gdpr".split()
PARTS = [*SURE, *"alert alerts aside banner breadcrumb breadcrumbs copyright disclaimer discussion foot footer legal login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos promotion promotions recommendation recommendations recommended related respond share sharing sidebar sidebars side signup skip social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split()]
#: Words that may stand beside such a name and leave its meaning.
PLACES = "area article articles bar block body bottom box button buttons center column container content form frame global group header holder icons inline inner item items left link links list lists main message outer page panel placeholder post posts primary right row secondary section site slot sticky stories story text thread tools top unit user users wrap wrapper zone".split()


def calling(parts: list[str]) -> re.Pattern[str]:
    """Matches classes with a name of ``parts`` among names and places, joined by
    hyphens, underscores or nothing. Groups don't give back, so that the time is linear."""
    words = lambda names: "|".join(sorted(names, key=lambda x: (-len(x), x)))
    others = words({*PARTS, *PLACES} - {*parts})
    return re.compile(rf"(?<!\S)(?:(?>(?:{others})[-_]*)*+(?>{words(parts)})(?>[-_]*(?:{words({*PARTS, *PLACES})}|[0-9]+))*+|(?:site|page)[-_]?header)[-_]*(?!\S)", re.I)


CALLED, SURELY = calling(PARTS), calling(SURE)
NAMED = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(PARTS)})(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


class Node:
    __slots__ = ("attrs", "children", "depth", "path", "tag")

    def __init__(self, tag: str, attrs: str, path: str, depth: int = 0) -> None:
        self.tag, self.attrs, self.path, self.depth = tag, attrs, path, depth
        self.children: list[Node | str] = []


def parse(html: str) -> Node:
    """The page's elements; unclosed ones end where their parent does."""
    root = Node("", "", "")
    stack, at = [root], 0
    open_: Counter = Counter()  # elements of the stack by tag

    def add(text: str) -> None:
        if text:
            stack[-1].children.append(text)

    def cut(at: int) -> None:
        open_.subtract(x.tag for x in stack[at:])
        del stack[at:]

    while m := TOKEN.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if open_[tag]:
                cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in CLOSES_P or tag in SCOPES:
            if any(open_[x] for x in SCOPES.get(tag, P_SCOPE)[0]) and (found := _close(stack, tag)):
                cut(found)
        attrs = m[3].rstrip("/") if m[3] else ""
        up = stack[-1]
        node = Node(tag, attrs, "", up.depth + 1)
        node.path = f"{up.path}/{look(node)}" if up.depth < MAX_DEPTH else f"{up.path}/*" if up.depth == MAX_DEPTH else up.path
        up.children.append(node)
        if tag in ("script", "style", "textarea", "title", "iframe", "noscript") and not (tag == "noscript"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            if end is None:
                end_at = len(html)
                at = end_at
            else:
                node.children.append(html[at : end.start()])
                at = end.end()
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            stack.append(node)
            open_[tag] += 1
    add(html[at:])
    return root


#: What an opening tag closes, and where the search for it ends.
SCOPES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


P_SCOPE = ({"p"}, {"table", "td", "th", "button"} | (BLOCK - {"p"}))


def _close(stack: list[Node], tag: str) -> int | None:
    """Place of the outermost element that an opening tag ends."""
    ends, until = SCOPES.get(tag, P_SCOPE)
    found = None
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in ends:
            found = i
            if tag != "tr":
                break
        elif stack[i].tag in until:
            break
    return found


def named(node: Node) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(node.attrs)} if node.attrs else {}


def look(node: Node) -> str:
    """Presentation of an element: its tag, class and id without numbers."""
    a = named(node)
    extra = " ".join(x for x in (a.get("class", ""), a.get("id", "")) if x)
    return f"{node.tag}.{re.sub(r'[0-9]+', '', extra).replace('/', '|')}" if extra else node.tag


def boilerplate(node: Node, inside: bool) -> bool:
    """Whether an element's meaning alone makes it no content. ``inside``:
    within an article, where a header may hold the headline."""
    if node.tag in RAW or node.tag in BOILER or node.tag == "header" and not inside:
        return True
    if not node.attrs or node.tag in ("html", "body"):
        return False
    a = named(node)
    return a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "") == "true" or "display:none" in a.get("style", "").replace(" ", "")


def suspect(node: Node) -> int:
    """3 and 2 if a class or the id is the name of a part that is no content, 3 for
    SURE ones, 1 if there is such a name in it, else 0."""
    if not node.attrs or node.tag in ("", "html", "body", "h1", "b", "i", "em", "strong"):
        return 0
    a = named(node)
    names = (a.get("class", ""), a.get("id", ""))
    if any(map(CALLED.search, names)):
        return 3 if any(map(SURELY.search, names)) else 2
    return int(node.tag not in ("article", "main", "p") and any(map(NAMED.search, names)))


def meaningless(node: Node, inside: bool) -> bool:
    """``boilerplate``, but an outermost article is taken as it is."""
    return (inside or node.tag not in ("article", "main")) and boilerplate(node, inside)


def clean(text: str) -> str:
    return re.sub(r"\s+", " ", unescape(text)).strip()


def code(text: str) -> int:
    """A 63-bit digest of a feature."""
    data = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) << 31) ^ zlib.adler32(data) ^ (len(data) << 8)


def own_text(node: Node) -> str:
    return clean(" ".join(x for x in node.children if isinstance(x, str)))


def features(root: Node) -> tuple[int, set[tuple[str, int, int]]]:
    """A digest of the page's text but for what names of boilerplate drop, and its features outside of boilerplate as
    (path, kind, feature): the children of every element, and the text of every
    element that has text of its own."""
    made: set = set()
    digest = blake2b(digest_size=8)
    gone, _ = removed(root, {})
    todo = [(root, False, True)]
    while todo:
        node, inside, counts = todo.pop()
        inside, counts = inside or node.tag in ("article", "main"), counts and id(node) not in gone
        inner = [x for x in node.children if isinstance(x, Node)]
        todo += [(x, inside, counts) for x in reversed(inner) if not meaningless(x, inside)]
        made.add((node.path, SEEN, 0))
        if inner:
            made.add((node.path, LOOKS, code(">".join(dict.fromkeys(x.path for x in inner)))))
        if text := own_text(node):
            made |= {(node.path, TEXTED, 0), (node.path, TEXTS, code(text))}
            if counts:
                digest.update(text.encode("utf-8", "surrogatepass") + b"\n")
    return int.from_bytes(digest.digest(), "big", signed=True), made


def removed(root: Node, importance: dict[str, float], names: bool = True) -> tuple[set[int], set[int]]:
    """ids of the page's elements that are removed, and of those that only lose
    their own text. Elements without any text don't matter. ``names``: whether
    names of boilerplate count."""
    gone: set[int] = set()
    bare: set[int] = set()
    nodes: list[tuple[Node, int, bool]] = []
    todo = [(root, -1, False)]
    while todo:
        node, up, inside = todo.pop()
        if meaningless(node, inside):
            gone.add(id(node))
            continue
        inside = inside or node.tag in ("article", "main")
        todo += [(x, len(nodes), inside) for x in reversed(node.children) if isinstance(x, Node)]
        nodes.append((node, up, inside))
    chars = [sum(len(x.strip()) for x in node.children if isinstance(x, str)) for node, _, _ in nodes]
    own, arts = [n > 0 for n in chars], [n if nodes[i][2] else 0 for i, n in enumerate(chars)]
    said = [suspect(node) if names else 0 for node, _, _ in nodes]
    heads = [node.tag in ("h1", "main") or node.tag == "article" and said[i] < 2 for i, (node, _, _) in enumerate(nodes)]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i][1]] += chars[i]
        arts[nodes[i][1]] += arts[i]
        heads[nodes[i][1]] |= heads[i]
    scale = [1.0] * len(nodes)  # 0: by its name alone
    for i, (_, up, _) in enumerate(nodes[1:], 1):
        scale[i] = scale[up]
        if said[i] and scale[i] and (said[i] == 3 and not heads[i] or 2 * chars[i] <= chars[0] and (not arts[0] or 2 * arts[i] <= arts[0])):
            scale[i] = KEYWORD if said[i] == 1 else 0.0
    text, telling, blocks = own[:], [False] * len(nodes), [False] * len(nodes)
    in_line: dict[int, list[int]] = {}
    low = lambda i, path: importance.get(path, 1.0) * scale[i] < MIN_IMPORTANCE
    for i in range(len(nodes) - 1, -1, -1):  # children before parents
        node, up, _ = nodes[i]
        if text[i] and not telling[i]:
            telling[i] = not low(i, node.path) or own[i] and not low(i, node.path + OWN_TEXT)
        if text[i] and not telling[i]:
            if node.tag in FORMAT and own[up]:
                in_line.setdefault(up, []).append(id(node))
            else:
                gone.add(id(node))
        elif own[i] and blocks[i] and low(i, node.path + OWN_TEXT):
            bare.add(id(node))  # beside blocks, not in a line with what is kept
            gone.update(in_line.get(i, ()))
        if up >= 0:
            text[up] |= text[i]
            telling[up] |= telling[i]
            blocks[up] |= telling[i] and node.tag in BLOCK
    return gone, bare


def main_text(html: str, importance: dict[str, float]) -> str:
    """Blocks of the branches that are kept; of the articles where there are any."""
    root = parse(html)
    return kept_text(root, *removed(root, importance)) or kept_text(root, *removed(root, importance, False))


def kept_text(root: Node, gone: set[int], bare: set[int]) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if text := clean("".join(line)):
            blocks.append(text)
        line.clear()

    def articles(node: Node) -> list[Node]:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if id(x) in gone:
                continue
            if x.tag in ("article", "main"):
                out.append(x)
            else:
                todo += [y for y in reversed(x.children) if isinstance(y, Node)]
        return out

    for top in articles(root) or [root]:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                line.append(x)
            elif id(x) not in gone:
                block = x.tag in BLOCK or not x.tag
                if block:
                    end()
                    todo.append(None)
                todo += [" " if isinstance(y, str) else y for y in reversed(x.children)] if id(x) in bare else reversed(x.children)
        end()
    return "\n".join(blocks)


def style_trees(pages: DataFrame) -> DataFrame:
    """(host, path, kind, feature, n): page texts of the host with the feature.
    Rows of a feature meet as sums."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("kind", pa.int32()), ("feature", pa.int64()), ("page", pa.int64())])

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows.clear()
            return made

        for batch in batches:
            for host, html in zip(batch["host"], batch["html"], strict=True):
                page, found = features(parse(html.as_py() or ""))
                name = host.as_py()
                rows.extend((name, path, kind, feature, page) for path, kind, feature in found)
                if len(rows) > 20_000:
                    yield out()
            if rows:
                yield out()
            trim()

    made = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(counted, "host string, path string, kind int, feature long, page long")
    return made.distinct().groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("n"))


def low_importance(trees: DataFrame, min_pages: int = MIN_PAGES, least: float = MIN_IMPORTANCE) -> DataFrame:
    """(host, path, importance) of nodes, and of the own texts of nodes, below
    ``least`` / KEYWORD. Those that fewer than min_pages page texts of the host have are important. Entropies are to the base of the number of pages with the node:
    one less the mean log of how many pages share a look or text."""
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0))
    n, nlogn = F.col("n"), F.col("n") * F.log("n")
    parent = F.regexp_replace("path", "/[^/]*$", "")
    nodes = trees.groupBy("host", "path").agg(of(SEEN, n).alias("pages"), of(LOOKS, F.lit(1)).alias("kinds"), of(LOOKS, n).alias("looks"), of(LOOKS, nlogn).alias("looks_log"), of(TEXTED, n).alias("texted"), of(TEXTS, n).alias("texts"), of(TEXTS, nlogn).alias("texts_log"))
    # of nodes that few pages have, their parents only get to know how many
    many = F.col("pages") >= min_pages
    known = nodes.select(F.when(many, F.col("path")).otherwise(parent).alias("path"), "host", many.alias("many"), *[F.when(many, F.col(c)).otherwise(F.lit(0)).alias(c) for c in nodes.columns[3:]], F.when(many, F.col("pages")).otherwise(0).alias("pages"), F.when(many | (F.col("kinds") + F.col("texted") == 0), 0).otherwise(F.col("pages")).alias("rare"))
    rows = known.groupBy("host", "path").agg(F.max("many").alias("many"), *[F.sum(c).alias(c) for c in ("pages", "rare", *nodes.columns[3:])]).where("many").drop("many")
    return rows.groupBy("host").applyInPandas(lambda frame: composed(frame, min_pages, least), "host string, path string, importance double")


def entropy(nlogn: float, total: int, pages: int) -> float:
    """Of ``total`` features of a node with sums n log n: 0 if all are the same
    on all of its pages, 1 if each is on one page only."""
    return max(0.0, 1.0 - nlogn / total / math.log(pages)) if pages > 1 and total else 1.0


def composed(frame: pd.DataFrame, min_pages: int, least: float) -> pd.DataFrame:
    """Importances of the nodes of one host's tree, deepest first."""
    out: list[tuple[str, str, float]] = []
    below: dict[str, list[float]] = {}  # by path: sums of weights and of weighted importances of its children
    for r in sorted(frame.itertuples(index=False), key=lambda r: -r.path.count("/")):
        weight, total = below.pop(r.path, (0.0, 0.0))
        weight, total = weight + r.rare, total + r.rare
        if r.texted:
            text = entropy(r.texts_log, r.texts, r.texted) if r.texted >= min_pages else 1.0
            weight, total = weight + r.texted, total + r.texted * text
            if text < least / KEYWORD:
                out.append((r.host, r.path + OWN_TEXT, text))
        if not weight:
            continue  # nothing with text below
        inner = total / weight
        if r.kinds:
            share = DECAY**r.kinds
            inner = (1 - share) * entropy(r.looks_log, r.looks, r.pages) + share * inner
        if inner < least / KEYWORD:
            out.append((r.host, r.path, inner))
        if r.path:
            up = below.setdefault(r.path.rpartition("/")[0], [0.0, 0.0])
            up[0] += r.pages
            up[1] += r.pages * inner
    return pd.DataFrame(out, columns=["host", "path", "importance"])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    low = stored(low_importance(style_trees(pages), min_pages), "style-trees")
    # only nodes of little importance travel: by host, a list that tasks join
    lists = low.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "importance"))).alias("low"))
    joined = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(lists, "host", "left")

    kinds = [pages.schema["page_id"], pages.schema["url"], StructField("text", StringType())]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                found = [main_text(h, dict(x.as_py() or ())) if (h := html.as_py()) else "" for html, x in zip(batch["html"], batch["low"], strict=True)]
                yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(found, pa.string())], names=["page_id", "url", "text"])
            trim()

    return joined.select("page_id", "url", "html", "low").mapInArrow(texts, StructType(kinds)).withColumn("n_chars", F.length("text").cast("long"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
