"""Main text of web pages by tag-path ratios: text length and punctuation by path from the root tell content from the rest."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..ship import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and whether it is text to be read.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
#: A start of one of these closes an open one of those, up to the element that holds them.
CLOSES = {"li": ("li", "ul ol menu dir"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select optgroup"), "tbody": ("thead tbody tr td th", "table"), "tfoot": ("thead tbody tr td th", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
STAYS_IN_P = frozenset("button option optgroup legend caption".split())
#: Elements that hold no article text, whatever their ratios.
OUT = frozenset("aside button canvas dialog fieldset footer form head iframe menu nav noembed noframes noscript object optgroup option script search select style svg template textarea title xmp".split())
#: Words of a class, id or role that say the same of any element.
OUT_WORDS = frozenset(
    "ad ads adsense adsbygoogle advert advertisement adverts advertising alert aside banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies crumbs dialog discussion disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion recommended related replies reply respond search share sharebar sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Words of a header that belongs to an article.
OWN_HEADER = frozenset("article content entry main post story".split())
STATES = frozenset("has is no with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Nodes on either side that smoothing takes in, its width, and the share of the standard deviation that a path must reach.
REACH, WIDTH, LEAST = 2, 1.0, 0.5
#: A list of links is a menu if its path has so many nodes at least with so few characters each.
MENU_NODES, MENU_CHARS = 3, 25

#: A comment, a tag with its attributes (a quote counts after = alone, and only where it ends), or a declaration.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>|<[!?/][^>]*>""", re.S)
_RAW_END = {x: re.compile("</" + x, re.I) for x in RAW}
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_MARKS = re.compile(r"[.,;:!?…、。，！？¿¡]")
_TELLS = re.compile("class|id|role|style|hidden|itemprop", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of the page's tags and texts, in order; a tag without an end is no text."""
    at, over = 0, page.rfind(">") + 1
    unfinished = re.search("<[A-Za-z/!?]", page[over:])
    size = over + unfinished.start() if unfinished else len(page)
    while at < over:
        m = _TAG.search(page, at)
        if m is None:
            break
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        yield ("end", tag, "") if m[1] else ("start", tag, m[3])
        if tag in RAW and not m[1]:
            past = _RAW_END[tag].search(page, at)
            if past is None:
                return
            at = past.start()
    if at < size:
        yield "text", page[at:size], ""


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text.strip(" /\n\t") else {}


def is_out(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element holds what is no article by its name, or by what its class, id or role says."""
    if tag in OUT or "hidden" in attrs or _HIDDEN.search(attrs.get("style", "")):
        return True
    if tag in ("html", "body", "main"):
        return False
    header = tag == "header"
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words or words[0] in STATES or words[-1] in ("open", "closed", "enabled", "disabled"):
            continue
        if tag == "article" and not in_article and len(words) > 1:
            continue
        if OUT_WORDS.intersection(words):
            return True
        header = header or "header" in words and not OWN_HEADER.intersection(words)
    return header and not in_article


@lru_cache(maxsize=4096)
def element(tag: str, text: str) -> tuple[bool, bool, bool, str]:
    """Whether an element is out where it is in no article and where it is in one, whether it is one, and its label in a path."""
    a = attributes(text)
    article = tag in ("article", "main") or a.get("role") in ("main", "article") or "articlebody" in a.get("itemprop", "").lower()
    return is_out(tag, a, False), is_out(tag, a, True), article, " ".join([tag, *sorted(a.get("class", "").split())])


class Page:
    """A page's elements and text nodes: for each element its parent, name, path and whether it is out; for each text its element and block."""

    def __init__(self, page: str):
        self.parent, self.tag, self.path, self.out, self.article = [-1], [""], [0], [False], [False]
        self.text, self.at, self.block = [], [], []
        paths = {}
        stack, n_open = [0], defaultdict(int)
        block = 0

        def close(upto: int) -> None:
            for e in stack[upto:]:
                n_open[self.tag[e]] -= 1
            del stack[upto:]

        for kind, name, attrs in tokens(page):
            if kind == "text":
                self.text.append(name)
                self.at.append(stack[-1])
                self.block.append(block)
                continue
            own = name in BLOCKS
            block += own
            if kind == "end":
                if n_open[name]:
                    i = len(stack) - 1
                    while self.tag[stack[i]] != name and (own or self.tag[stack[i]] not in BLOCKS):
                        i -= 1
                    if self.tag[stack[i]] == name:
                        close(i)
                continue
            if name == "br":
                self.text.append(" ")
                self.at.append(stack[-1])
                self.block.append(block)
            if own and n_open["p"] and name not in STAYS_IN_P:
                i = len(stack) - 1
                while self.tag[stack[i]] != "p":
                    i -= 1
                close(i)
            if name in CLOSES:
                ends, holders = CLOSES[name]
                i = last = len(stack) - 1
                while i > 0 and self.tag[stack[i]] not in holders:
                    if self.tag[stack[i]] in ends:
                        last = i - 1
                    i -= 1
                close(last + 1)
            if name in VOID:
                continue
            above = stack[-1]
            out, out_inside, article, label = element(name, attrs if _TELLS.search(attrs) else "")
            path = paths.setdefault((self.path[above], label), len(paths) + 1) if own or name == "a" else self.path[above]
            self.parent.append(above)
            self.tag.append(name)
            self.path.append(path)
            self.out.append(self.out[above] or (out_inside if self.article[above] else out))
            self.article.append(self.article[above] or article)
            stack.append(len(self.tag) - 1)
            n_open[name] += 1
        self.begins = {e for e in range(1, len(self.tag)) if self.article[e] and not self.article[self.parent[e]]}


_KERNEL = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / WIDTH) ** 2)


def smooth(x: np.ndarray) -> np.ndarray:
    """Means by a Gaussian over nearby nodes; at the ends over those that there are."""
    return np.convolve(x, _KERNEL)[REACH:-REACH] / np.convolve(np.ones(len(x)), _KERNEL)[REACH:-REACH]


def path_scores(path: np.ndarray, chars: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Each text node's score: its path's characters a node and punctuation a node, smoothed over the page and fused, as the path's mean."""
    n, of = np.maximum(np.bincount(path), 1), path
    length, punctuation = (smooth((np.bincount(of, x) / n)[of]) for x in (chars, marks))
    return (np.bincount(of, length * (1 + punctuation)) / n)[of]


def main_text(page: str) -> str:
    """The page's article: blocks joined by two line ends, empty if there is none."""
    p = Page(page)
    text = [entities.unescape(t) for t in p.text]
    full = [i for i, t in enumerate(text) if t.strip()]
    if not full:
        return ""
    e = np.array([p.at[i] for i in full])
    chars = np.array([len(text[i].strip()) for i in full], dtype=float)
    marks = np.array([len(_MARKS.findall(text[i])) for i in full], dtype=float)
    path = np.array([p.path[x] for x in e])
    ok = ~np.array([p.out[x] for x in e])
    if not ok.any():
        return ""
    score = path_scores(path, chars, marks)
    chosen = score >= LEAST * score.std()
    for seeds in (ok & chosen, ok):
        weight = np.bincount(e, np.where(seeds, chars * score, 0), minlength=len(p.tag))
        for x in range(len(p.tag) - 1, 0, -1):
            weight[p.parent[x]] += weight[x]
        if weight[0]:
            break
    root = _root(p, weight)
    inside = np.zeros(len(p.tag), dtype=bool)
    for x in range(len(p.tag)):
        inside[x] = x == root or x > 0 and inside[p.parent[x]]
    taken = ok & inside[e] & ~_menus(p, e, path, chars, chosen)
    out, last = [], -1
    elements = set(e[taken].tolist())
    # white space between taken texts of a block parts words as well
    for i, t in enumerate(text):
        if p.at[i] in elements or not t.strip() and inside[p.at[i]]:
            if p.block[i] != last:
                out.append("")
                last = p.block[i]
            out[-1] += t
    return "\n\n".join(b for b in (" ".join(x.split()) for x in out) if b)


def _root(p: Page, weight: np.ndarray) -> int:
    """The outermost article of most weight, or the innermost article in it that has nearly all of that; without any, the innermost element with most of the page's weight, and what it shares headings with."""
    marked = [x for x in p.begins if weight[x] > 0]
    root = max(marked, key=lambda x: (weight[x], -x)) if marked else 0
    inner = [x for x in range(len(p.tag)) if p.tag[x] == "article" and weight[x] > 0 and _within(p, x, root)]
    if marked and p.tag[root] != "article" and inner:
        root = max(inner, key=lambda x: (weight[x], -x))
    if marked:
        return root
    children = defaultdict(list)
    for x in range(1, len(p.tag)):
        children[p.parent[x]].append(x)
    while True:
        best = max((x for x in children[root] if p.tag[x] in BLOCKS and not p.out[x]), key=lambda x: weight[x], default=None)
        if best is None or weight[best] <= weight[root] / 2 or p.tag[best] in HEADINGS | {"p"}:
            break
        rest = [x for x in children[root] if x != best and weight[x] > 0 and not p.out[x]]
        if p.tag[root] not in ("", "html", "body") and all(p.tag[x] in HEADINGS or p.path[x] == p.path[best] for x in rest) and rest:
            break
        root = best
    return root


def _within(p: Page, x: int, root: int) -> bool:
    while x > root:
        x = p.parent[x]
    return x == root


def _menus(p: Page, e: np.ndarray, path: np.ndarray, chars: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Text nodes of paths below the threshold that hold short links alone."""
    linked = np.array([p.tag[x] == "a" or p.tag[p.parent[x]] == "a" for x in e])
    n, of = np.maximum(np.bincount(path), 1), path
    mean, share = np.bincount(of, chars) / n, np.bincount(of, linked) / n
    return (~chosen) & ((share == 1) & (n >= MENU_NODES) & (mean < MENU_CHARS))[of]


def _extract(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            texts = [main_text(h or "") for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of the main text of every row's html.

    Each text of a page has a path of elements (with their classes) from the root. A path's characters and punctuation marks a node are
    smoothed over the page's nodes and fused, and paths from half a standard deviation on are content. The article is the marked element
    with most content, or the innermost element with most of the page's content; all its text is taken but for menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles and comments, which their names, classes or lists of short links tell.

    A null html is empty and has an empty text; ids and urls may be null or repeated, and every row gives one row; other columns are not
    read. An empty table gives no rows. A page of any length is read as a whole, in time by its length.
    """
    ship(pages.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
