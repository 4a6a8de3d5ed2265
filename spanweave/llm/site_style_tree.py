"""Main text of pages by a site style tree.

The pages of a host are merged into one tree whose nodes are element paths (tag and first class, digits dropped). A
node's presentation importance is the entropy of its child sequences over the host's pages: a template draws its menus
alike on every page, while articles differ. A node inherits it from the elements it lies in, weaker by the level. A
node's content importance is one minus the mean entropy of its texts: a text on every page tells nothing, a text on one
page much. Pages of equal main text are one page to the tree, as copies are no evidence of a template.

Branches of low content importance are cut, and those whose mean of both importances is low: furniture whose texts
differ from page to page but whose form never does. On a host whose articles are all of one form the second rule would
cut most of the text, and is not applied. What HTML itself names as furniture (``nav``, ``footer``, ``form`` ..) and the
class names of its most common kinds are a prior beside the tree. Where only headings of an article would be left, they
stay.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
#: Elements whose content is not text of a page: code, controls of forms, and what only shows where a player fails.
_RAW = {"script", "style", "noscript", "template", "title", "textarea", "select", "button", "iframe", "canvas", "video", "audio"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_BLOCK = set("html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary hgroup center dialog menu".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: The prior. Elements that are furniture by name, and words of a class, id or role that stand for menus, headers, footers,
#: sidebars, notices, adverts, forms and reader comments.
_FURNITURE_TAG = {"nav", "footer", "aside", "form", "dialog", "menu", "head"}
_FURNITURE_WORD = set("ad ads adv advert adverts advertisement advertising sponsored banner cookie cookies consent notice notices popup newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments respond disqus login signup".split())
_TOP = {"", "html", "body"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Words that inside an article stand for its own title.
_TITLE_WORD = {"header", "masthead"}
_MAIN_WORD = {"main", "content", "article", "post", "entry", "story"}
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_SPACE = re.compile(r"\s+")


class Unit:
    """A text block: its path's hash, its text, whether it lies in an article region, in what the prior calls furniture
    (1 by an element, 2 by a word) and in a heading."""

    __slots__ = ("furniture", "heading", "main", "node", "text")

    def __init__(self, node: int, text: str, main: bool, furniture: int, heading: bool = False):
        self.node, self.text, self.main, self.furniture, self.heading = node, text, main, furniture, heading


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parse(page: str, host: str) -> tuple[list[Unit], dict[int, list[str]], dict[int, int]]:
    """Text blocks in page order, the child tags of every node, and its parent where that is no root, html or body."""
    units: list[Unit] = []
    children: dict[int, list[str]] = {}
    parents: dict[int, int] = {}
    root = _hash(host)
    stack: list[tuple[str, str, int, bool, int]] = [("", host, root, False, 0)]  # tag, path, node, main, furniture
    parts: list[str] = []
    at, end = 0, len(page)

    def flush():
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            tag, _, node, main, furniture = stack[-1]
            units.append(Unit(node, text, main, furniture, tag in _HEADING))

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            parts.append(page[at:])
            break
        if lt > at:
            parts.append(page[at:lt])
        m = _TAG.match(page, lt)
        if m is None:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[1] or m[4])
        if tag in _RAW and not closing:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end if tag in ("script", "style") else at
        elif tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
        elif tag == "hr":
            flush()
        elif tag in _BLOCK:
            flush()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                continue
            if stack[-1][0] == "p":
                stack.pop()
            own = _CLOSES.get(tag)
            if own and stack[-1][0] in own:
                while len(stack) > 1 and stack[-1][0] in own:
                    stack.pop()
            values = {a.lower(): (b or c or d or "").lower() for a, b, c, d in _ATTR.findall(m[3] or m[6] or "")}
            _, path, parent, main, furniture = stack[-1]
            first = re.sub(r"\d+", "", values.get("class", "").split(" ")[0])
            path = f"{path}/{tag}.{first}"
            node = _hash(path)
            children.setdefault(parent, []).append(f"{tag}.{first}")
            if stack[-1][0] not in _TOP:
                parents[node] = parent
            names = {w for k in ("class", "id", "role") for w in _SPLIT.split(values.get(k, ""))}
            if tag in _FURNITURE_TAG or "hidden" in values or (tag == "header" and not main):
                furniture = 1
            elif not furniture and tag not in _TOP and names & (_FURNITURE_WORD - _TITLE_WORD if main else _FURNITURE_WORD):
                furniture = 2
            main = main or tag in ("article", "main") or values.get("role") == "main" or bool(names & _MAIN_WORD)
            stack.append((tag, path, node, main, furniture))
        elif tag not in _VOID and tag in ("td", "th"):
            parts.append(" ")
    flush()
    return units, children, parents


def _named(units: list[Unit], prior: int = 2) -> list[Unit]:
    """Blocks outside of what the prior calls furniture, only those of article regions where there are any.

    prior: 2 for elements and words, 1 for elements alone, 0 for neither.
    """
    kept = [u for u in units if not 0 < u.furniture <= prior]
    return ([u for u in kept if u.main] or kept) if prior else kept


def main_text(page: str, host: str, low: set[int], prior: int = 2) -> tuple[str, int]:
    """Blocks that stay, joined by blank lines, and how many of the page's the tree speaks against. The cut by importance
    is undone where it would leave nothing, or only headings of an article region that has other text."""
    units = parse(page, host)[0]
    kept = _named(units, prior)
    left = [u for u in kept if u.node not in low]
    if all(u.heading for u in left) and (not left or (left[0].main and not all(u.heading for u in kept))):
        left = kept
    return "\n\n".join(u.text for u in left), sum(u.node in low for u in units)


def _pages(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("html"))


_ROW = "struct<node: long, kind: int, feature: long, above: array<long>>"


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, pages, presentation, content, inherited, chars): the merged trees; importances are 0 to 1.

    Of a host's pages whose blocks outside the prior's furniture are equal, one (that of the smallest hash) is merged.
    chars: code points of the node's own texts over all pages.
    """

    def run(batches):
        for b in small(batches, 500):
            hosts = b.column(0).to_pylist()
            keys, sums, packed = [], [], []
            for host, page in zip(hosts, b.column(1).to_pylist()):
                units, children, parents = parse(page, host)
                texts: dict[int, int] = {}
                for u in units:
                    texts[u.node] = texts.get(u.node, 0) + len(u.text)
                above = {}
                for n in {*texts, *children}:
                    chain, at = [], n
                    while (at := parents.get(at)) is not None:
                        chain.append(at)
                    above[n] = chain
                rows = {(u.node, 0, _hash(u.text)) for u in units} | {(n, 2, size) for n, size in texts.items()}
                own = [{"node": n, "kind": 1, "feature": _hash(" ".join(children.get(n, ()))), "above": chain} for n, chain in sorted(above.items())]
                packed.append(own + [{"node": n, "kind": k, "feature": f, "above": None} for n, k, f in sorted(rows)])
                own_hash = _hash(page)
                named = "".join(f"{u.node} {u.text}\n" for u in _named(units))
                keys.append(_hash(named) if named else own_hash)
                sums.append(own_hash)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(sums, pa.int64()), pa.array(packed, pa.list_(kinds))], names=["host", "page", "own", "rows"])

    kinds = pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64()), ("above", pa.list_(pa.int64()))])
    found = _pages(pages).where("host <> ''").select("host", "html").mapInArrow(run, f"host string, page long, own long, rows array<{_ROW}>")
    once = found.groupBy("host", "page").agg(F.min_by("rows", "own").alias("rows"))
    rows = once.select("host", F.explode("rows").alias("r")).select("host", "r.node", "r.kind", "r.feature", "r.above")
    counts = rows.groupBy("host", "node", "kind", "feature").agg(F.count(F.lit(1)).alias("k"), F.any_value("above").alias("above"))
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    sums = counts.groupBy("host", "node").agg(
        of(1, F.col("k")).alias("pages"), of(1, F.col("k") * F.log("k")).alias("styles"), of(0, F.col("k")).alias("texts"),
        of(0, F.col("k") * F.log("k")).alias("shared"), F.coalesce(of(2, F.col("k") * F.col("feature")), F.lit(0)).alias("chars"), F.any_value("above", True).alias("above"),
    )
    span, many = F.log(F.col("pages")), F.col("pages") > 1
    nodes = sums.select(
        "host", "node", "pages", "above", "chars",
        F.when(many, (span - F.col("styles") / F.col("pages")) / span).otherwise(F.lit(1.0)).alias("presentation"),
        F.when(many & (F.col("texts") > 0), 1 - F.col("shared") / F.col("texts") / span).otherwise(F.lit(1.0)).alias("content"),
    )
    nodes = written(nodes, "style-nodes")
    up = nodes.select("host", F.col("node").alias("own"), F.posexplode("above").alias("level", "node")).join(nodes.select("host", "node", "presentation"), ["host", "node"])
    handed = up.groupBy("host", F.col("own").alias("node")).agg(F.max(F.col("presentation") * F.pow(F.lit(0.9), F.col("level"))).alias("handed"))
    inherited = F.greatest("presentation", F.coalesce("handed", F.lit(0.0)))
    return nodes.join(handed, ["host", "node"], "left").select("host", "node", "pages", "presentation", "content", inherited.alias("inherited"), "chars")


def low_nodes(tree: DataFrame, least_pages: int = 5, content: float = 0.5, mean: float = 0.6) -> DataFrame:
    """(host, low): the nodes of each host that are cut. A node needs ``least_pages`` distinct pages to be judged.

    Below ``content`` in content importance a node is cut; below ``mean`` in the mean of content and inherited
    presentation importance too, unless such nodes hold over half of the host's other text.
    """
    often = F.col("pages") >= least_pages
    flat = often & (F.col("content") < content)
    even = often & ~flat & ((F.col("content") + F.col("inherited")) / 2 < mean)
    marked = tree.select("host", "node", flat.alias("flat"), even.alias("even"), F.when(flat, 0).otherwise(F.col("chars")).alias("size"))
    of_host = marked.groupBy("host").agg(F.sum("size").alias("all"), F.sum(F.when(F.col("even"), F.col("size")).otherwise(0)).alias("cut"), F.collect_set(F.when(F.col("flat"), F.col("node"))).alias("flat"), F.collect_set(F.when(F.col("even"), F.col("node"))).alias("even"))
    low = F.when(2 * F.col("cut") <= F.col("all"), F.array_union("flat", "even")).otherwise(F.col("flat"))
    return of_host.select("host", low.alias("low")).where(F.size("low") > 0)


def extract(pages: DataFrame, least_pages: int = 5, content: float = 0.5, mean: float = 0.6, prior: int = 2) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), n_low (nodes of its host that are cut), n_cut (its
    blocks in such nodes).

    For the parameters see ``low_nodes``; ``prior`` 2 uses names of elements and words of classes beside the tree, 1
    only names of elements, 0 the tree alone. Null html is empty; a page without a host is only cleared by the prior;
    repeated pages and null ids are kept; an empty table gives an empty result. Other columns are ignored.
    """
    low = written(low_nodes(style_tree(pages), least_pages, content, mean), "style-tree")  # template paths of a host; Spark broadcasts it while its files are small

    def run(batches):
        for b in small(batches, 500):
            texts, counts, seen = [], [], {}
            for host, page, nodes in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if host not in seen:
                    seen[host] = set(nodes or ())
                text, n = main_text(page, host, seen[host], prior)
                texts.append(text)
                counts.append(n)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            cut = pa.array([len(seen[h]) for h in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), sizes, cut, pa.array(counts, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_low", "n_cut"])

    return _pages(pages).join(low, "host", "left").select("page_id", "url", "host", "html", "low").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_low long, n_cut long")
