"""Main text of web pages through site style trees.

Pages of one host are merged into a style tree.  An element node is a path of tags (with class, id or role);
its presentations are the sequences of child elements seen under it.  A content node is the text that
stands directly in an element; its features are the phrases of that text.

* Presentation importance: the entropy of an element's presentations, to the base of the number of pages.
* Content importance: one less the mean entropy of the distinct phrases, where a phrase that stands on n of
  m pages has entropy log n / log m.  Copies of an article add no phrases and so lower nothing.
* Composite importance, bottom-up on each page: ``(1 - gamma ** l) * own + gamma ** l * mean(below)`` for an
  element with l presentations; for content nodes the content importance.
* A branch is noise if it and all that lies below it fall short of the threshold; the largest such branches
  are cut.  An element with one important part below it is never cut, but loses noise beside that part.

A host with few pages says little about phrases, so the same paths of all hosts are merged as well (the tree
of all sites): the smaller of the two content importances counts.  Few pages also lower the threshold.

The tree is a table of (host, node, feature) counts, all three as 64-bit hashes, over the distinct pages of the host: what moves is one
row of features for each (host, digest of the page), copies combined before the shuffle, and then counts; no
page's DOM and no host's pages are gathered in one task.  Only nodes that may be noise return to the pages of
their host.

Beside the tree stand the elements that HTML itself declares to be no article (navigation, header, footer, aside,
form, script, style, dialog) and class names made of such words only; they decide what no tree can (comments
differ on every page) and on hosts with few pages.  ``declared=False`` leaves them out.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed
and joined in page order by two line feeds.

Defined cases: a null or empty page has an empty text; a page without tags is one block; null urls form
one host; repeated rows are treated one by one, and copies of a page count once in the tree of
their host; an empty table gives an empty result; other columns are not carried, and names that clash with those used here do
not matter; very deep or unclosed markup is read without recursion.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: A node is noise below this importance; with m pages the bound is ``MIN_IMPORTANCE * (1 - 1 / log2(m))``.
MIN_IMPORTANCE = 0.9
#: Pages that must show a node before its host's tree says anything, and before the tree of all sites does.
MIN_PAGES, MIN_POOLED = 4, 64
#: Decay of a presentation's weight with the number of presentations (Yi, Liu and Li's gamma).
GAMMA = 0.9

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?=[\s=/]|$)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

#: Elements without content (fixed by HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup (fixed by HTML).
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template plaintext".split())
#: Elements that stand in a line of text; every other one begins and ends a block (fixed by HTML).
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
#: Elements that never hold text for readers, and those that never hold the article.
NO_TEXT = frozenset("script style noscript template iframe object embed canvas svg math select option textarea input head title noframes noembed audio video map applet datalist".split())
DROP = frozenset("nav header footer aside form button dialog menu".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id names that say the same, and words that say nothing beside them.
DROP_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promos promotion promoted banner nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars footer header masthead topbar toolbar cookie cookies consent gdpr notice notices newsletter subscribe signup login share sharing social related recommended recommendations comment comments disqus respond replies reply popup modal overlay widget widgets pagination pager skip".split())
PLAIN_WORDS = frozenset("a an area bar block body bottom box button buttons center col column container content form group head holder icon icons inner item items left link links list main module outer page panel posts primary right row secondary section side site slot text title to top unit widget wrap wrapper".split())
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
#: Ends of phrases.
_PHRASE = re.compile(r"[.!?;|\u00b7\u2022\u00bb\u203a\u2013\u2014:]+(?:\s+|$)|\s+[|\u00b7\u2022\u00bb\u203a\u2013\u2014-]\s+")
#: Elements that a new block of the same kind closes if they were left open (fixed by HTML).
_CLOSED_BY = {"p": frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl div article section table blockquote pre hr footer header nav aside form main figure address details fieldset".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_LI_STOP = frozenset("ul ol menu".split())
_CELL_STOP = frozenset(["table"])
_BUTTON_SCOPE = frozenset("table td th button object caption html".split())


class Node:
    """``raw``: holds no text for readers.  ``dropped``: declared to be no article."""

    __slots__ = ("tag", "names", "key", "children", "parent", "raw", "dropped", "safe")

    def __init__(self, tag: str, names: str, parent: Node | None, raw: bool, dropped: bool):
        self.tag, self.names, self.parent, self.raw, self.dropped = tag, names, parent, raw, dropped
        self.children: list[Node | str] = []
        self.key = 0
        self.safe = tag in ("article", "main") or parent is not None and parent.safe


def named_noise(value: str) -> bool:
    """Whether one of the names is made of words for what is no article, and at most plain words beside them."""
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if any(w in DROP_WORDS for w in words) and all(w in DROP_WORDS or w in PLAIN_WORDS for w in words):
            return True
    return False


def _drops(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether the markup declares the element as no article, and the names that tell its style."""
    names, dropped = "", tag in DROP
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name = m[1].lower()
            value = html.unescape(m[2] or m[3] or m[4] or "")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                dropped = True
            elif name == "role":
                dropped |= value.lower() in DROP_ROLES
                names += f"|{value.lower()}"
            elif name in ("class", "id"):
                if tag not in ("html", "body", "main", "article") and named_noise(value):
                    dropped = True
                names += f"|{name[0]}={' '.join(sorted(re.sub(r'[0-9]+', '0', value.lower()).split()))}"
    return dropped, names


def parse(page: str | None) -> Node:
    """The page's tree.  Markup that does not close is closed where HTML's rules put its end."""
    root = Node("#root", "", None, False, False)
    text = page or ""
    node, at, low = root, 0, None
    for_search = _TOKEN.search
    while at < len(text):
        m = for_search(text, at)
        if m is None:
            node.children.append(text[at:])
            break
        if m.start() > at:
            node.children.append(text[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                node.children.append(" ")
                continue
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
        elif m[2]:
            tag = m[2].lower()
            if tag == "br":
                node.children.append(" ")
                continue
            up = node
            while up is not root:
                closers = _CLOSED_BY.get(up.tag)
                if closers is not None and tag in closers:
                    node = up.parent
                    break
                if up.tag in _BUTTON_SCOPE or tag == "li" and up.tag in _LI_STOP or tag in ("td", "th", "tr") and up.tag in _CELL_STOP or up.tag not in INLINE and up.tag not in _CLOSED_BY and up.tag not in ("ul", "ol"):
                    break
                up = up.parent
            dropped, names = _drops(tag, m[3])
            child = Node(tag, names, node, tag in NO_TEXT or node.raw, dropped or node.dropped)
            node.children.append(child)
            if tag in VOID or m[3].endswith("/") and tag not in RAW:
                continue
            if tag in RAW:
                low = low or text.lower()
                end = low.find(f"</{tag}", at) if len(low) == len(text) else re.compile(f"</{re.escape(tag)}", re.I).search(text, at)
                end = end.start() if hasattr(end, "start") else -1 if end is None else end
                if end < 0:
                    break
                close = text.find(">", end)
                at = len(text) if close < 0 else close + 1
                continue
            node = child
    return root


def squeeze(text: str) -> str:
    return " ".join(text.split())


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def phrases(text: str) -> list[str]:
    """The distinct phrases of a text: what stands between the ends of sentences and separators."""
    return list(dict.fromkeys(p for x in _PHRASE.split(text) if (p := x.strip())))


def give_keys(root: Node) -> Iterator[tuple[Node, list[str], str]]:
    """Every block element with the labels of its child blocks (a run of equal ones counts once) and its own text; sets the nodes' keys.

    A node's key is its path of tags and names; places among siblings are not part of it.
    """
    root.key = _hash("#root")
    stack = [root]
    while stack:
        node = stack.pop()
        shape, own = [], []
        inner = list(reversed(node.children))
        while inner:
            child = inner.pop()
            if isinstance(child, str):
                if bare := squeeze(child):
                    own.append(bare)
            elif child.raw:
                continue
            elif child.tag in INLINE:  # part of the line it stands in, never a branch of its own
                child.key = node.key
                inner.extend(reversed(child.children))
            else:
                label = child.tag + child.names
                if not shape or shape[-1] != label:
                    shape.append(label)
                child.key = _hash(f"{node.key}/{label}")
                stack.append(child)
        yield node, shape, " ".join(own)


def element_node(key: int) -> int:
    return key & ~1


def content_node(key: int) -> int:
    return key | 1


def style_features(root: Node) -> set[tuple[int, int]]:
    """(node, feature) of a page, each once: presentations of element nodes, phrases of content nodes, and feature 0 says that the page shows the node."""
    out = set()
    for node, shape, own in give_keys(root):
        if shape:
            out.add((element_node(node.key), _hash("/".join(shape)) or 1))
            out.add((element_node(node.key), 0))
        if own:
            out.add((content_node(node.key), 0))
            out.update((content_node(node.key), _hash(p) or 1) for p in phrases(own))
    return out


#: What is known of a host's nodes: importance and gamma ** l.
Tree = dict[int, tuple[float, float]]


def noise(root: Node, tree: Tree, bound: float = MIN_IMPORTANCE) -> tuple[set[int], int]:
    """Keys of the nodes whose own text is noise, and the number of largest branches that are.

    ``tree`` holds the nodes that may be noise; all others are important.
    """
    order = [(node, bool(shape), bool(own)) for node, shape, own in give_keys(root)]
    total: dict[int, list[float]] = {}  # by node: composite importances of the parts, whether all are noise
    clean: dict[int, bool] = {}
    found, cut = set(), 0
    alone: dict[int, int] = {}
    for node, inner, own in reversed(order):  # children come after their parents in this order
        parts, low, inside = total.pop(id(node), []), clean.pop(id(node), True), alone.pop(id(node), 0)
        if own:
            value = 1.0 if node.safe else tree.get(content_node(node.key), (1.0, 0.0))[0]
            parts.append(value)
            if value < bound:
                found.add(node.key)
                inside += 1
            else:
                low = False
        if not parts:
            continue
        below = sum(parts) / len(parts)
        if inner:
            own_part, rest = tree.get(element_node(node.key), (1.0, 0.0))
            composite = (1 - rest) * own_part + rest * below
        else:
            composite = below
        low = low and composite < bound
        parent = node.parent
        while parent is not None and parent.tag in INLINE and parent.parent is not None:
            parent = parent.parent
        if parent is None:
            cut += 1 if low else inside
            continue
        total.setdefault(id(parent), []).append(composite)
        clean[id(parent)] = clean.get(id(parent), True) and low
        alone[id(parent)] = alone.get(id(parent), 0) + (1 if low else inside)
    return found, cut


def page_text(root: Node, found: set[int] | None = None, declared: bool = True) -> str:
    """The blocks of what is left without the text of noise (``found``) and of elements declared to be no article.

    What the markup itself declares as the article is kept whatever the tree says, and so is a page of which nothing else would be left.
    """
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            if block := squeeze(html.unescape("".join(line))):
                blocks.append(block)
            line.clear()

    stack: list[Node | str | None] = [root]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            line.append(item)
        elif not item.raw and not (declared and item.dropped):
            if item.tag not in INLINE:
                end()
                stack.append(None)
            # elements in a line have the key of the node they stand in
            bare = found and not item.safe and item.key in found
            stack.extend(c for c in reversed(item.children) if not (bare and isinstance(c, str)))
        elif item.tag not in INLINE:
            end()
    end()
    return "\n\n".join(blocks) if blocks or not found else page_text(root, None, declared)


def _scale(m: Column) -> Column:
    """What the threshold is divided by where ``m`` pages show a node: few pages have to be clearer."""
    return 1 - 1 / F.log2(F.greatest(m.cast("double"), F.lit(2.5)))


def importance(counts: DataFrame, gamma: float = GAMMA, min_pages: int = MIN_PAGES, min_pooled: int = MIN_POOLED) -> DataFrame:
    """(host, node, n_pages, importance, rest) from (host, node, feature, n).

    ``importance`` is divided by the scale of the number of pages, so that one bound holds for all; ``rest`` is gamma to the number of presentations.
    """
    text, shown = F.col("node").bitwiseAND(1) == 1, F.col("feature") == 0
    n = F.col("n").cast("double")
    sums = [F.max(F.when(shown, F.col("n"))).alias("m"), F.count(F.when(~shown, 1)).alias("l"), F.sum(F.when(~shown, F.log(n))).alias("logs"), F.sum(F.when(~shown, n)).alias("total"), F.sum(F.when(~shown, n * F.log(n))).alias("s")]
    base = F.log(F.col("m").cast("double"))
    content = 1 - F.col("logs") / F.col("l") / base
    shape = (F.log("total") - F.col("s") / F.col("total")) / base
    by_host = counts.groupBy("host", "node").agg(*sums)
    own = F.when(F.col("m") < F.when(text, min_pages).otherwise(2), 1.0).otherwise(F.when(text, content / _scale(F.col("m"))).otherwise(shape))
    every = counts.where(text).groupBy("node", "feature").agg(F.sum("n").alias("n")).groupBy("node").agg(*sums).where(F.col("m") >= min_pooled)
    pooled = every.select(F.col("node").alias("p_node"), (content / _scale(F.col("m"))).alias("pooled"))
    joined = by_host.select("host", "node", "m", own.alias("own"), F.pow(F.lit(gamma), F.col("l")).alias("rest")).join(pooled, F.col("node") == F.col("p_node"), "left")
    return joined.select("host", "node", F.col("m").alias("n_pages"), F.least("own", F.coalesce("pooled", F.lit(1.0))).alias("importance"), "rest")


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, node, feature, n): how many distinct pages of a host show each feature at each node."""
    plain = pages.select(F.xxhash64(host_of(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                seen: dict[tuple[int, bytes], None] = {}
                rows: list[tuple[int, int]] = []
                ends = [0]
                for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    one = (host, blake2b((page or "").encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    if one not in seen:
                        seen[one] = None
                        rows += sorted(style_features(parse(page)))
                        ends.append(len(rows))
                hosts, digests = zip(*seen, strict=True)
                node, feature = zip(*rows, strict=True) if rows else ((), ())
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int64())) for v in (node, feature)]
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(digests, pa.binary()), *lists], names=["host", "digest", "node", "feature"])

    found = plain.mapInArrow(run, "host bigint, digest binary, node array<bigint>, feature array<bigint>")
    distinct = found.dropDuplicates(["host", "digest"]).select("host", F.explode(F.arrays_zip("node", "feature")).alias("f"))
    return distinct.groupBy("host", F.col("f.node").alias("node"), F.col("f.feature").alias("feature")).agg(F.count(F.lit(1)).alias("n"))


def host_of(url_col: str):
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(host, F.lit(""))


def noise_nodes(pages: DataFrame, url_col: str = "url", html_col: str = "html", bound: float = MIN_IMPORTANCE, min_pages: int = MIN_PAGES, min_pooled: int = MIN_POOLED) -> DataFrame:
    """(host, nodes): the nodes of a host's style tree that may be noise, as (node, importance, rest)."""
    scored = importance(style_tree(pages, url_col, html_col), GAMMA, min_pages, min_pooled)
    text = F.col("node").bitwiseAND(1) == 1
    low = scored.where(F.when(text, F.col("importance") < bound).otherwise((1 - F.col("rest")) * F.col("importance") < bound))
    node = F.struct("node", F.col("importance").cast("float").alias("importance"), F.col("rest").cast("float").alias("rest"))
    return low.groupBy("host").agg(F.collect_list(node).alias("nodes"), F.count(F.when(text, 1)).alias("n_text")).where("n_text > 0").select("host", "nodes")


def extract(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", key_cols: tuple[str, ...] = ("page_id", "url"), bound: float = MIN_IMPORTANCE,
    min_pages: int = MIN_PAGES, min_pooled: int = MIN_POOLED, declared: bool = True,
) -> DataFrame:
    """Key columns, ``text`` and ``n_pruned`` (largest branches that the style tree cut) of every page."""
    # a host's list holds possible noise only; Spark broadcasts it where it is small and splits hot hosts where it is not
    low = staged(noise_nodes(pages, url_col, html_col, bound, min_pages, min_pooled), "style-tree")
    keys = [f"__k{i}" for i in range(len(key_cols))]
    plain = pages.select(*[F.col(c).alias(k) for c, k in zip(key_cols, keys, strict=True)], F.col(html_col).cast("string").alias("__html"), F.xxhash64(host_of(url_col)).alias("__host"))
    joined = plain.join(low.withColumnRenamed("host", "__h"), F.col("__host") == F.col("__h"), "left").select(*keys, "__html", "__host", "nodes")
    types = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    n = len(key_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, Tree] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts, pruned = [], []
                for i, (page, host) in enumerate(zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist(), strict=True)):
                    root, found, cut = parse(page), None, 0
                    if part.column(n + 2)[i].is_valid:
                        if host not in trees:
                            if len(trees) >= 64:
                                trees.clear()
                            trees[host] = {x["node"]: (x["importance"], x["rest"]) for x in part.column(n + 2)[i].as_py()}
                        found, cut = noise(root, trees[host], bound)
                    texts.append(page_text(root, found, declared))
                    pruned.append(cut)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n)] + [pa.array(texts, pa.string()), pa.array(pruned, pa.int64())], names=[*keys, "text", "n_pruned"])

    return joined.mapInArrow(run, ", ".join([f"`{k}` {types[k]}" for k in keys] + ["text string", "n_pruned bigint"])).toDF(*key_cols, "text", "n_pruned")
