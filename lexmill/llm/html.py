"""Main-text extraction with site style trees.

A page is parsed into blocks: runs of text under one chain of elements (tags
with class; inline markup and list positions do not count). All pages of
a host are merged into a style tree whose nodes are those chains (one tree for
pages that mark their main part, one for the others). An inner node has styles,
the sequences of children it shows on a page. The content importance of a node
with text that m pages of the host have is

    1 - average over its distinct texts of (ln k / ln m)

with k the number of pages that have the text: 0 if every text stands on every
page, 1 if each stands on one page. The composite importance of an inner node is

    (1 - d^l) * presentation + d^l * average over styles and their children

with presentation the entropy, base m, of its l styles, d the damping and the
children's composite importance, from the leaves up; own text counts as a child.
An element is one node in all styles of its parent, so that evidence is not split.
A branch is noise if it and all nodes in it are below the threshold; such branches
are cut from each page, whole. Only a branch that `least` pages have is judged. In a
node that stays, a text that MOST of its pages have is cut (a notice among the
paragraphs), except for entries of lists and tables in a marked main part.

Pages count once for each distinct main text of a host (what roles leave, see
below), so copies are no evidence. Where the distinct pages of a host share most
of their text, importance cuts nothing: they are near copies, not articles in one
frame. A heading or label goes only with all that it heads.

Entropy needs many pages of a host, and adverts that rotate are as varied as
articles. Branches whose element names their role (navigation, header, footer,
aside, form, advert, comment ...) are therefore cut in any case, by tag, by a whole
class name or by the end or start of a compound one; a main part inside a form or a
named element is not cut with it, and compounds never leave a page empty. If a page
marks its main part (article, main), text outside it is cut.

Hashes of chains and texts go through the shuffle, once a distinct main text,
then summed; a host's nodes, not its pages or rare texts, are judged in one task. The
cut chains of all hosts are broadcast while their measured size allows it, so that no page
is shuffled; beyond that pages and cut chains are joined on the host and a salt, which
spreads a host with a third of all pages.

Cases: null html counts as empty, null or broken urls share one host; equal
pages get equal texts; unclosed and stray tags are tolerated; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, thrifty

DAMPING, THRESHOLD, LEAST = 0.9, 0.3, 8
#: A text on this share of a node's pages is repeated; a host is judged if at least these shares of its text are not, inside a marked main part and on unmarked pages, the last for texts among the paragraphs of a main part, which have only their repetition against them.
MOST, OWN_MARKED, OWN, OWN_AMONG = 0.8, 0.25, 0.1, 0.6
TEXT, STYLE, EDGE = 1, 2, 3
SALTS = 64
BROADCAST_BYTES = 16 << 20  # of the cut lists of all hosts
RESULT = "page_id long, url string, text string, n_chars long, n_blocks_cut long"

#: Elements of HTML by role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "canvas", "object"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "meter", "output", "q", "ruby", "rb", "rp", "rt", "rtc", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ROLE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "head", "fieldset", "datalist", "input"}
ROLE_NAMES = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "widget", "ad", "ads", "advert", "advertisement", "adsense", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "search", "share", "sharing", "social", "related", "recommended", "comment", "comments", "disqus", "reply", "replies", "respond", "pagination", "pager", "copyright", "legal", "toolbar", "skip"}
#: Words that make a compound say something else (no-sidebar, layout-with-sidebar), and ends that keep what it begins with (nav-links).
NOT_ROLE = {"no", "non", "not", "with", "without", "has", "is", "hide", "layout", "main", "article", "content", "post", "entry", "story"}
CONTAINERS = {"area", "bar", "block", "bottom", "box", "buttons", "container", "inner", "item", "items", "left", "links", "list", "right", "section", "top", "widget", "wrap", "wrapper"}
STRONG_TAGS = {"nav", "footer", "aside", "dialog", "menu", "head"}
ROLE_ARIA = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
HEADS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6} | dict.fromkeys(("dt", "th", "caption", "legend", "summary"), 7)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A block element ends an open paragraph; these bound how far an implied end reaches.
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "p": {"article", "section", "div", "td", "th", "li", "blockquote", "main", "body", "button"}, "option": {"select"}}

#: The inside of a tag up to its ">", quoted values as one; nothing is tried twice.
INSIDE = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
MARKS = {"class", "id", "role", "hidden", "aria-hidden", "style"}
SPACE = re.compile(r"\s+")


def _next_tag(page: str, at: int, last: int, broken: bool) -> tuple[int, int, bool]:
    """(start, end, broken) of the next tag, comment or declaration from `at` on; start is the page's length if there is none.

    last: where the page's last ">" is. A tag that the page breaks off ends with it. Once a
    quotation has swallowed all the rest, quotes mean nothing any more (broken), so that no
    stretch of text is searched more than a few times.
    """
    n = len(page)
    while 0 <= (at := page.find("<", at)):
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return at, n if end < 0 else end + 3, broken
        second = page[at + 1 : at + 2]
        named = (second if second != "/" else page[at + 2 : at + 3]) or " "
        if second in ("!", "?") or (named.isascii() and named.isalpha()):
            if at > last:
                return at, n, broken
            if page.startswith("<![CDATA[", at) and (end := page.find("]]>", at)) >= 0:
                return at, end + 3, broken
            end = page.find(">", at)
            if second not in ("!", "?") and not broken:
                quoted = INSIDE.match(page, at + 1).end()
                broken = quoted == n
                end = end if broken else quoted
            return at, end + 1, broken
        at += 1
    return n, n, broken


def _marks(token: str, tag: str) -> dict[str, str]:
    """The attributes that say something about an element's role; of equal names the first."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(token, len(tag) + 1):
        if (name := name.lower()) in MARKS:
            out.setdefault(name, a or b or c)
    return out


class Node:
    __slots__ = ("tag", "chain", "off", "main", "inline")

    def __init__(self, tag: str, chain: str, off: int, main: bool, inline: bool):
        self.tag, self.chain, self.off, self.main, self.inline = tag, chain, off, main, inline


KEPT, PERHAPS, WEAK, STRONG = range(4)


def _named(name: str) -> int:
    """What one class name or id says: a role by itself, perhaps one as the end or start of a compound, or nothing."""
    plain = name.rstrip("0123456789")
    if plain in ROLE_NAMES:
        return WEAK
    pieces = re.split(r"[-_]+", plain)
    if len(pieces) < 2 or NOT_ROLE & set(pieces):
        return KEPT
    return PERHAPS if pieces[-1] in ROLE_NAMES or (pieces[0] in ROLE_NAMES and pieces[-1] in CONTAINERS) else KEPT


def _role(tag: str, marks: dict[str, str], inside_main: bool) -> int:
    """How surely an element's name or marks say that it is not main text.

    A marked main part inside ends what is WEAK, as a form or a class name around a whole page;
    what is PERHAPS also stays if nothing else does.
    """
    if tag in STRONG_TAGS or "hidden" in marks or marks.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", marks.get("style", ""), re.I):
        return STRONG
    if tag in ROLE_TAGS or (tag == "header" and not inside_main) or marks.get("role", "").lower() in ROLE_ARIA:
        return WEAK
    if tag in ("body", "html", "article", "main"):
        return KEPT
    return max((_named(n) for n in f"{marks.get('class', '')} {marks.get('id', '')}".lower().split()), default=KEPT)


def blocks(page: str, roles: bool = True) -> list[tuple[str, str, int, bool]]:
    """(chain of elements, text, how surely its role cuts it, inside a marked main part) of each block in page order."""
    out: list[list] = []
    parts: list[str] = []
    stack = [Node("", "", KEPT, False, False)]
    at, last, broken = 0, page.rfind(">"), False

    def flush(block_of: Node) -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append([block_of.chain, text, block_of.off, block_of.main])

    def top_block() -> Node:
        for n in reversed(stack):
            if not n.inline or n.off:
                return n
        return stack[0]

    def pop(k: int) -> None:
        if any(not n.inline or n.off != stack[k - 1].off for n in stack[k:]):
            flush(top_block())
        del stack[k:]

    while at < len(page):
        start, end, broken = _next_tag(page, at, last, broken)
        if start > at:
            parts.append(page[at:start])
        at, token = end, page[start:end]
        if not token or not token.endswith(">"):
            continue
        if token[1] in "!?":
            if token.startswith("<![CDATA["):
                parts.append(html.escape(token[9:-3]))
            continue
        tag = NAME.match(token)[1].lower()
        if token[1] == "/":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop(k)
                    break
            else:
                if tag == "p":
                    flush(top_block())
            continue
        if tag in RAW and not token.endswith("/>"):
            if tag in ("iframe", "object", "svg", "math", "canvas"):
                parts.append(" ")
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br" or tag in ("img", "wbr"):
            if tag != "wbr":
                parts.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            closes = CLOSES.get(tag, set()) | ({"p"} if tag not in ("option",) else set())
            bound = BOUNDS.get(tag, BOUNDS["p"])
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    pop(k)
                    break
                if stack[k].tag in bound:
                    break
            flush(top_block())
        if tag in VOID:
            continue
        top = stack[-1]
        marks = _marks(token, tag) if len(token) > len(tag) + 2 else {}
        begins = roles and (tag in ("article", "main") or marks.get("role", "").lower() == "main")
        main = top.main or begins
        above = KEPT if begins and top.off < STRONG else top.off
        off = max(above, _role(tag, marks, main and not begins) if roles and (not inline or marks) else KEPT)
        if inline and off != top.off:
            flush(top_block())
        name = tag + ("." + ".".join(sorted(marks["class"].split())) if marks.get("class") else "")
        stack.append(Node(tag, top.chain if inline else f"{top.chain}/{name}", off, main, inline))
    flush(top_block())
    return [tuple(x) for x in out]


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _key(chain: str, marked: bool) -> int:
    """A style node's key; pages that mark their main part and pages that do not have a tree each."""
    return _hash(f"{int(marked)}{chain}")


def _text_key(node: int, text: int) -> int:
    return _hash(f"{node} {text}")


def _candidates(page: str, roles: bool) -> tuple[bool, list[tuple[str, str, int, bool]], int]:
    """Whether the page marks its main part, the blocks that roles leave, and the number of all blocks."""
    found = blocks(page, roles)
    if all(off for _, _, off, _ in found):  # compounds of class names are not certain enough to leave nothing
        found = [(chain, text, off if off > PERHAPS else KEPT, main) for chain, text, off, main in found]
    marked = any(main for _, _, off, main in found if not off)
    return marked, [b for b in found if not b[2] and (b[3] or not marked)], len(found)


FEATURE = pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64()), ("weight", pa.float32())])
PAGE = "host string, marked boolean, main long, page long, features array<struct<node:long,kind:int,feature:long,weight:float>>"


def _page_features(left: list[tuple[str, str, int, bool]], marked: bool) -> list[dict]:
    """Distinct features of a page's tree: TEXT of a node (weight: its length, 0 for headings), STYLE and EDGE of an inner node.

    A style is the sequence of a node's children, its own text standing as the node itself; an edge's weight is
    the child's share of the style.
    """
    out: dict[tuple[int, int, int], float] = {}
    styles: dict[str, list[str]] = {}
    for chain, text, *_ in left:
        out[_key(chain, marked), TEXT, _hash(text)] = 0.0 if _head(chain) else float(len(text))
        child = chain
        styles.setdefault(chain, [])
        if not styles[chain] or styles[chain][-1] != chain:
            styles[chain].append(chain)
        while child:
            parent = child.rpartition("/")[0]
            tags = styles.setdefault(parent, [])
            if tags and tags[-1] == child:
                break
            tags.append(child)
            child = parent
    for parent, tags in styles.items():
        if tags == [parent]:
            continue
        node = _key(parent, marked)
        out[node, STYLE, _hash(" ".join(tags))] = 0.0
        for child in tags:
            at = (node, EDGE, _key(child, marked))
            out[at] = out.get(at, 0.0) + 1 / len(tags)
    return [{"node": n, "kind": k, "feature": f, "weight": w} for (n, k, f), w in out.items()]


def _features(roles: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Host, hash of the main text, hash of the page and features of each page; copies in a row of batches only once."""
        seen: set = set()
        for batch in batches:
            rows = []
            for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
                copy = (host, _hash(page or ""))
                if copy in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(copy)
                marked, left, _ = _candidates(page or "", roles)
                if left:
                    rows.append((host, marked, _hash("\n\n".join(b[1] for b in left)), copy[1], _page_features(left, marked)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(FEATURE))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "marked", "main", "page", "features"])

    return run


def style_tree(pages: DataFrame, least: int = LEAST, roles: bool = True) -> DataFrame:
    """(host, marked, node, kind, feature, k, n, weight, ln): the counts over distinct pages that a host is judged by.

    Pages of a host with one main text count once. Texts are named while they may
    stand on most pages of a node; the others of a node, and its styles, are summed (feature 0).
    """
    once = pages.select(host_of().alias("host"), "html").mapInArrow(thrifty(_features(roles)), PAGE).groupBy("host", "marked", "main").agg(F.min_by("features", "page").alias("features"))
    one = once.select("host", "marked", F.explode("features").alias("f")).select("host", "marked", "f.*")
    counted = one.groupBy("host", "marked", "node", "kind", "feature").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("weight").cast("double")).alias("weight"))
    k = F.col("k").cast("double")
    ln = F.when(F.col("kind") == STYLE, k * F.ln(k)).otherwise(F.ln(k))
    named = F.when((F.col("kind") == EDGE) | ((F.col("kind") == TEXT) & (F.col("k") >= MOST * least)), F.col("feature")).otherwise(F.lit(0).cast("long"))
    return counted.groupBy("host", "marked", "node", "kind", named.alias("feature")).agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.sum(ln).alias("ln"))


def _nodes(table: pa.Table) -> tuple[dict, dict, dict, dict]:
    """Texts {node: [(hash, k, length of all, number, sum of ln k)]}, styles {node: (pages, number, sum of k ln k)}, edges {parent: {child: weight}}, pages {node: pages}."""
    texts, styles, edges, pages = {}, {}, {}, {}
    for node, kind, feature, k, n, weight, ln in sorted(zip(*(table[c].to_pylist() for c in ("node", "kind", "feature", "k", "n", "weight", "ln")), strict=True)):
        if kind == TEXT:
            texts.setdefault(node, []).append((feature, k, weight, n, ln))
        elif kind == STYLE:
            styles[node] = (k, n, ln)
            pages[node] = max(k, pages.get(node, 0))
        else:
            edges.setdefault(node, {})[feature] = weight
            pages[feature] = max(k, pages.get(feature, 0))
    return texts, styles, edges, pages


def _entropy(n: int, n_ln_n: float, base: int) -> float:
    """Entropy, base `base`, of counts with the sum n and the sum of n ln n."""
    return 1.0 if base < 2 else min(1.0, (log(n) - n_ln_n / n) / log(base))


def _content(texts: list, pages: int) -> float:
    return 1.0 if pages < 2 else 1 - sum(t[4] for t in texts) / sum(t[3] for t in texts) / log(pages)


def _own(texts: dict, pages: dict, least: int) -> float:
    """Share of the text, without headings, that pages do not have in common."""
    whole = often = 0.0
    for node, ts in texts.items():
        for feature, k, weight, *_ in ts:
            whole += weight
            often += weight if feature and pages[node] >= least and k >= MOST * pages[node] else 0.0
    return (whole - often) / whole if whole else 0.0


def _cut(root: int, texts: dict, styles: dict, edges: dict, pages: dict, threshold: float, least: int, among: bool) -> list[int]:
    """Keys of the nodes, and if `among` of the texts in other nodes, that are cut."""
    order = [root]
    for node in order:
        order += [child for child in edges.get(node, ()) if child != node]
    content = {node: _content(ts, pages[node]) for node, ts in texts.items()}
    worth: dict[int, float] = {}
    noisy: dict[int, bool] = {}
    for node in reversed(order):
        own, children = content.get(node), edges.get(node, {})
        worth[node] = 1.0 if own is None else own
        if children:
            m, (n, number, n_ln_n) = pages[node], styles[node]
            # pages on which the node has text only show one more style, the text itself
            alone = m - n
            number, n_ln_n = number + (alone > 0), n_ln_n + (alone * log(alone) if alone else 0.0)
            inside = sum(w * (worth[child] if child != node else own) for child, w in children.items()) + (alone * own if alone else 0.0)
            worth[node] = (1 - DAMPING**number) * max(0.0, _entropy(m, n_ln_n, m)) + DAMPING**number * inside / m
        noisy[node] = worth[node] < threshold and (own is None or own < threshold) and all(noisy[child] for child in children if child != node)
    cut: list[int] = []
    inside_cut: set[int] = set()
    for node in order:
        judged = pages[node] >= least
        if node in inside_cut or (judged and noisy[node]):
            inside_cut.update(edges.get(node, ()))
            cut += [node] if node in texts else []
        elif judged and node in texts:
            cut += [node] if content[node] < threshold else [_text_key(node, t[0]) for t in texts[node] if among and t[0] and t[1] >= MOST * pages[node]]
    return cut


def _judge(threshold: float, least: int):
    def run(table: pa.Table) -> pa.Table:
        host, marked = table["host"][0].as_py(), table["marked"][0].as_py()
        texts, styles, edges, pages = _nodes(table)
        cut: list[int] = []
        own = _own(texts, pages, least)
        if own >= (OWN_MARKED if marked else OWN):
            cut = _cut(_key("", marked), texts, styles, edges, pages, threshold, least, not marked or own >= OWN_AMONG)
        return pa.table({"host": pa.array([host], pa.string()), "cut": pa.array([sorted(cut)], pa.list_(pa.int64()))})

    return run


def _head(chain: str) -> int:
    """The level of a heading or label (the least of all is 7), 0 for other blocks."""
    return HEADS.get(chain.rpartition("/")[2].split(".")[0], 0)


def _keep(left: list[tuple[str, str, int, bool]], marked: bool, cut: set[int]) -> list[str]:
    """The texts that stay: what is not cut, and headings of what stays (on unmarked pages, within their parent)."""
    stay = []
    for chain, text, *_ in left:
        node = _key(chain, marked)
        # an entry of a list or table in a main part is data however often it recurs
        entry = marked and chain.rpartition("/")[2].split(".")[0] in ("li", "td", "dd")
        stay.append(node not in cut and (entry or _text_key(node, _hash(text)) not in cut))
    for i in range(len(left) - 1, -1, -1):
        level = _head(left[i][0])
        if stay[i] or not level:
            continue
        parent = left[i][0].rpartition("/")[0] + "/"
        for j in range(i + 1, len(left)):
            other = _head(left[j][0])
            if 0 < other <= level or not (marked or left[j][0].startswith(parent)):
                break
            if stay[j]:
                stay[i] = True
                break
    return [b[1] for b, s in zip(left, stay, strict=True) if s]


def extract_main_text(pages: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, broadcast_bytes: int = BROADCAST_BYTES, roles: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks_cut of every page; without roles the style tree decides alone."""
    judged = style_tree(pages, least, roles).groupBy("host", "marked").applyInArrow(_judge(threshold, least), "host string, cut array<long>")
    low = cut(judged.filter(F.size("cut") > 0).groupBy("host").agg(F.flatten(F.collect_list("cut")).alias("cut")))  # a row for each of a host's two trees
    small = (low.agg(F.sum(F.size("cut") * 8 + F.octet_length("host") + 64)).first()[0] or 0) <= broadcast_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = [], []
            for page, cut in zip(batch["html"].to_pylist(), batch["cut"].to_pylist(), strict=True):
                marked, left, number = _candidates(page or "", roles)
                kept = _keep(left, marked, set(cut or ()))
                texts.append("\n\n".join(kept))
                gone.append(number - len(kept))
            yield pa.RecordBatch.from_arrays([batch["page_id"].cast(pa.int64()), batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(np.array(gone, np.int64))], names=[c.split()[0] for c in RESULT.split(", ")])

    found = pages.select("page_id", "url", "html", host_of().alias("host"))
    if small:
        joined = found.join(F.broadcast(low), "host", "left")  # no more than broadcast_bytes, as just measured
    else:
        # pages of a host are spread over SALTS tasks; what is cut on a host goes to each of them
        spread = low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = found.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).join(spread, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "cut").mapInArrow(thrifty(run), RESULT)
