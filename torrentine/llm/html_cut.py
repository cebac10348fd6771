"""Main text of web pages by minimum-cut labelling.

A page becomes blocks of text. A small classifier gives each block its log-odds of being content, which is
its capacity to the source or, below zero, to the sink; it sees the block and its nearest elements only. Blocks that
follow each other, and blocks that follow each other within one container, are joined by smoothness edges, stronger the
nearer they stand in the tree, and of the same order as the capacities, so neighbours outvote a block that looks
odd by itself. The minimum cut is the labelling of least cost; blocks on the source's side are the text.

The classifier is a logistic regression, fitted to ``html_samples.pages``: a bounded, seeded set of made-up pages whose labels are
known; its weights lie in ``html_weights.json``. No single element or word can empty a page: a block's odds are clipped, and words in
the class of an element that holds most of a page's text are features of their own. Where neither elements nor names say what a block is,
its length, its links and its share of the page's longest run of text are weighed by themselves.
"""

from __future__ import annotations

import functools
import html as html_lib
import json
import re
from collections import Counter, deque
from collections.abc import Container
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torrentine.llm import html_samples
from torrentine.llm.common import in_slices, sliced

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag. Quotes count as such only where a value starts; nothing is scanned twice.
REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)*+>""")
ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Words in names; a run of letters and digits is none. A name that holds one is made up by a tool, as are those with its marks in front.
WORD, MADE_UP = re.compile(r"[a-z]+"), re.compile(r"[a-z]\d|\d[a-z]|^(?:css|sc|jsx)-")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACES = re.compile(r"\s+")
#: Elements whose content is no markup, elements without content, and elements whose text is not shown.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = {"svg", "template", "canvas", "audio", "video", "datalist"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
INLINE |= set("math mi mo mn mrow msup msub mfrac msqrt mtext mroot mstyle msubsup munder mover semantics annotation".split())
HEADINGS = {f"h{i}" for i in range(1, 7)}
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An open paragraph ends where one of these begins; an open item is out of reach behind one of the lists.
BLOCK = set("address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre section summary table ul".split()) | HEADINGS | set(ITEMS)
LISTS = set("ul ol dl menu table select div section article aside main nav footer header form".split())

#: Elements that roles stand for.
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "form": "form", "dialog": "dialog", "alertdialog": "dialog", "alert": "dialog", "menu": "menu", "main": "main", "article": "article"}
#: Elements that say nothing of what stands two levels below.
PLAIN = {"", "html", "body", "div", "section", "form"}
#: Elements that say what stands in them.
TELLING = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "main", "article"}
#: On how many pages of the sample a word in a name must stand to be known, and the runs of text that make other lengths relative.
LEAST_PAGES, LONG_RUN = 10, 150
WEIGHTS = Path(__file__).with_name("html_weights.json")
CUES = {
    "cookie": r"\bcookies?\b",
    "rights": r"copyright|©|all rights reserved",
    "join": r"\b(?:subscribe|sign (?:up|in)|log ?in|newsletter|register)\b",
    "share": r"^\W*(?:share|tweet|follow|print|email)\b",
    "more": r"^\W*(?:related|read (?:more|also)|see also|recommended|trending|more from|you may also)\b",
    "advert": r"^\W*(?:advert|sponsored|promoted|ad\b)",
    "reply": r"^\W*(?:reply|(?:\d+ )?comments?\b|leave a)",
}
CUE = re.compile("|".join(f"(?P<{k}>{v})" for k, v in CUES.items()), re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Most that a block's own odds can say, with and without elements or names that tell; smoothness of neighbours of one name in one container (both links or neither), of others near by, and of the rest, and
#: along one container over a gap. An element with more than this share of a page's text is a wrapper.
CAP, PLAIN_CAP, NEAR, STEP, FAR, WITHIN, WRAPPER = 4.0, 2.0, 2.0, 0.6, 0.1, 1.2, 0.6


class Node:
    """An open element. ``p`` and ``item`` are the paragraph and the list item or cell that a new one would end."""

    __slots__ = ("tag", "names", "parent", "kind", "unseen", "hidden", "p", "item", "size")

    def __init__(self, tag: str, parent: "Node | None", attrs: str = ""):
        self.tag, self.kind, self.parent, self.names, self.size = tag, tag, parent, (), 0
        self.unseen, self.hidden, self.p, self.item = (parent.unseen, parent.hidden, parent.p, parent.item) if parent else (False, False, None, None)
        if attrs:
            for m in ATTR.finditer(attrs):
                name, value = m[1].lower(), (m[2] or "").strip("\"'")
                if name in ("class", "id"):
                    self.names += tuple(CAMEL.sub("-", value).lower().split())
                elif name == "role":
                    self.kind = ROLES.get(value.lower(), tag)
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
                    self.hidden = True
        self.unseen = self.unseen or tag in UNSEEN
        self.p = self if tag == "p" else None if tag in BLOCK else self.p
        self.item = self if tag in ITEMS else None if tag in LISTS else self.item


class Block:
    __slots__ = ("text", "node", "links")

    def __init__(self, text: str, node: Node, links: int):
        self.text, self.node, self.links = text, node, links


def blocks(page: str) -> list[Block]:
    """Blocks of a page, in order; one pass, whatever the markup."""
    root = Node("", None)
    node, nodes, parts, found, at, n = root, [root], [], [], 0, len(page)
    open_tags: dict[str, int] = {}
    links = anchor = 0

    def flush():
        nonlocal links
        if parts:
            text = SPACES.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                home = node
                while home.unseen:
                    home = home.parent
                found.append(Block(text, home, min(links, len(text))))
                home.size += len(text)
            parts.clear()
        links = 0

    def close(to: Node | None):
        nonlocal node
        while node is not to and node is not root:
            open_tags[node.tag] -= 1
            node = node.parent

    def add(text: str):
        nonlocal links
        if text and not node.unseen:
            parts.append(text)
            if anchor:
                links += len(text)

    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            add(page[at:])
            break
        add(page[at:mark])
        nxt = page[mark + 1 : mark + 2]
        if nxt in ("!", "?") or nxt == "/" and not page[mark + 2 : mark + 3].isalpha():
            if nxt == "/" and page[mark + 2 : mark + 3] != ">" and mark + 2 >= n:
                add(page[mark:])
            if page.startswith("<!--", mark) and not page.startswith((">", "->"), mark + 4):
                at = page.find("-->", mark + 4)
                at = n if at < 0 else at + 3
            else:
                at = page.find(">", mark)
                at = n if at < 0 else at + 1
            continue
        ends = nxt == "/"
        m = NAME.match(page, mark + 1 + ends)
        if not m or not m[0].isascii() and not m[0][0].isascii():
            add("<")
            at = mark + 1
            continue
        rest = REST.match(page, m.end())
        if not rest:  # the page ends within the tag
            break
        at, tag, attrs = rest.end(), m[0].lower(), page[m.end() : rest.end() - 1]
        if tag in INLINE:
            if tag == "a":
                anchor = 0 if ends else 1
            continue
        if tag == "br" or tag in VOID:
            if tag in ("br", "img", "wbr", "input", "embed"):
                add(" " if tag == "br" else "")
            elif tag == "hr":
                flush()
            continue
        if ends:
            if open_tags.get(tag):
                if tag not in UNSEEN:
                    flush()
                up = node
                while up.tag != tag:
                    up = up.parent
                close(up.parent)
                anchor = 0
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = n if not end else page.find(">", end.end())
            at = n if at < 0 else at + 1
            continue
        if tag in UNSEEN:
            open_tags[tag] = open_tags.get(tag, 0) + (not attrs.endswith("/"))
            if not attrs.endswith("/"):
                node = Node(tag, node, "")
                nodes.append(node)
            continue
        if node.unseen and tag not in BLOCK:
            continue
        flush()
        anchor = 0
        while node.unseen:  # a block of the page ends a drawing that was left open
            close(node.parent)
        if tag in BLOCK:
            if node.p is not None:
                close(node.p.parent)
            if node.item is not None and node.item.tag in ITEMS.get(tag, ()):
                close(node.item.parent)
                if tag == "tr" and node.item is not None and node.item.tag == "tr":
                    close(node.item.parent)
            if tag in HEADINGS and node.tag in HEADINGS:
                close(node.parent)
        node = Node(tag, node, attrs)
        nodes.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.size += x.size
    root.size = max(root.size, 1)
    return found


def features(found: list[Block], known: Container[str]) -> list[list[str]]:
    """What the classifier sees of each block: its text, its element and the nearest ones around it, with those of their names that are ``known``."""
    if not found:
        return []
    root = found[0].node
    while root.parent is not None:
        root = root.parent
    longest = max(len(b.text) - b.links for b in found)
    out = []
    homes = [id(_container(b.node)) for b in found]
    for i, b in enumerate(found):
        node, size = b.node, len(b.text)
        words = b.text.split()
        text = [f"size:{min(7, (size // 12).bit_length())}", f"links:{4 * b.links // size}", f"stops:{min(4, sum(map(b.text.count, ('. ', ', ', '? ', '! '))))}", f"end:{b.text[-1] in '.!?…”\"»:'}"]
        text.append(f"low:{4 * sum(w[0].islower() for w in words) // len(words)}")
        if longest >= LONG_RUN:
            text.append(f"run:{min(4, (8 * (size - b.links) // longest).bit_length())}")
        if size < 300:
            text += {f"cue:{m.lastgroup}" for m in CUE.finditer(b.text)}
        if node.tag in HEADINGS:  # what it heads in its container
            after = found[i + 1] if i + 1 < len(found) and homes[i + 1] == homes[i] else None
            text.append("heads:" + ("nothing" if after is None else "heading" if after.node.tag in HEADINGS else str(min(4, ((len(after.text) - after.links) // 24).bit_length()))))
        f = ["bias", f"tag:{node.tag}", *text]
        if node.kind != node.tag:
            f.append(f"role:{node.kind}")
        if node.hidden:
            f.append("hidden")
        up, told = node, False
        for _ in range(4):
            if up.parent is None:
                break
            if up.tag not in ("body", "html"):
                kind = "whole" if up.size > WRAPPER * root.size and up is not node else "word"
                names = {f"{kind}:{w}" for x in up.names if not MADE_UP.search(x) for w in WORD.findall(x)}
                f += {x for x in names if x in known}
                told = told or up.kind in TELLING or kind == "word" and any(x in known for x in names)
            up = up.parent
        if not told:
            f += [f"plain-{x}" for x in text]
        if node.parent is not None:
            f.append(f"up:{node.parent.kind}")
            if node.parent.parent is not None and node.parent.parent.kind not in PLAIN:
                f.append(f"up2:{node.parent.parent.kind}")
        out.append(f)
    return out


def known_names(pages: list[list[Block]]) -> set[str]:
    """Features of words in names that stand on ``LEAST_PAGES`` pages or more."""
    seen = Counter()
    for found in pages:
        nodes, words = {b.node for b in found}, set()
        while nodes:
            words |= {w for n in nodes for x in n.names if not MADE_UP.search(x) for w in WORD.findall(x)}
            nodes = {n.parent for n in nodes if n.parent is not None}
        seen.update(words)
    return {f"{kind}:{w}" for w, n in seen.items() if n >= LEAST_PAGES for kind in ("word", "whole")}


def fit(labelled, ridge: float = 0.2, rounds: int = 8) -> dict[str, float]:
    """Weights of a logistic regression, by Newton's method, from pages as (html, content: a set of block texts)."""
    labelled = [(blocks(page), content) for page, content in labelled]
    known = known_names([found for found, _ in labelled])
    rows, labels = [], []
    for found, content in labelled:
        rows += features(found, known)
        labels += [b.text in content for b in found]
    names = {x: i for i, x in enumerate(sorted({x for r in rows for x in r}))}
    x, y = np.zeros((len(rows), len(names))), np.array(labels, float)
    for i, r in enumerate(rows):
        x[i, [names[k] for k in r]] = 1
    w = np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return {k: round(float(w[i]), 4) for k, i in names.items()}


@functools.cache
def fitted() -> dict[str, float]:
    """The weights that :func:`fit` gives for ``html_samples.pages()``, as stored."""
    return json.loads(WEIGHTS.read_text())


def scores(found: list[Block], model: dict[str, float]) -> list[float]:
    """Log-odds of content, clipped; closer where nothing but its text tells of a block, so that its neighbours decide."""
    caps = ((f, PLAIN_CAP if any(x.startswith("plain-") for x in f) else CAP) for f in features(found, model))
    return [max(-cap, min(cap, sum(model.get(x, 0.0) for x in f))) for f, cap in caps]


def _container(n: Node) -> Node:
    return n.parent if n.parent is not None and (n.tag in HEADINGS or n.tag in ITEMS or n.tag in ("p", "pre", "blockquote", "figcaption", "figure")) else n


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in the page, next of kin within one container, and a new container with the one it stands in."""
    out, last = [], {}
    homes = [_container(b.node) for b in found]
    linked = [2 * b.links > len(b.text) for b in found]
    for i, home in enumerate(homes):
        if i:
            prev = homes[i - 1]
            alike = found[i - 1].node.names == found[i].node.names and linked[i - 1] == linked[i]
            w = NEAR if prev is home and alike else STEP if prev is home or prev.parent is home or home.parent is prev else FAR
            out.append((i - 1, i, w))
        if (j := last.get(id(home), i - 1)) < i - 1:
            out.append((j, i, WITHIN))
        elif id(home) not in last and (j := last.get(id(home.parent), i - 1)) < i - 1:
            out.append((j, i, STEP))
        last[id(home)] = i
    return out


def minimum_cut(scores: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source; a score is the capacity to the source, below zero to the sink.

    Augmenting paths go from one source at a time to the nearest sink. What a source reaches when no sink is left
    to it stays with the source for good, so it is never searched again.
    """
    excess, n = list(scores), len(scores)
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in links:
        room[a][b] = room[a].get(b, 0) + w
        room[b][a] = room[b].get(a, 0) + w
    kept = [False] * n
    for source in range(n):
        while excess[source] > 1e-9 and not kept[source]:
            came, queue, end = {source: source}, deque([source]), -1
            while queue and end < 0:
                a = queue.popleft()
                for b, w in room[a].items():
                    if w > 1e-9 and b not in came and not kept[b]:
                        came[b] = a
                        if excess[b] < -1e-9:
                            end = b
                            break
                        queue.append(b)
            if end < 0:
                for a in came:
                    kept[a] = True
                break
            path, b = [], end
            while b != source:
                path.append((came[b], b))
                b = came[b]
            flow = min(excess[source], -excess[end], *(room[x][y] for x, y in path))
            excess[source] -= flow
            excess[end] += flow
            for x, y in path:
                room[x][y] -= flow
                room[y][x] += flow
    return kept


def main_text(page: str | None, model: dict[str, float] | None = None) -> str:
    """The main text: its blocks joined by line feeds; empty for null and for pages without content."""
    if not page:
        return ""
    found = blocks(page)
    keep = minimum_cut(scores(found, fitted() if model is None else model), edges(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, model: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every row. ``model`` holds the weights of :func:`fit`, by default of :func:`fitted`.

    A null or empty html gives an empty text. Null identifiers and addresses and repeated rows are kept;
    an empty table gives no rows; other columns are not read.
    """
    model = fitted() if model is None else model  # a few hundred numbers

    def run(batches):
        def one():
            for batch in sliced(batches):
                for page_id, url, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    text = main_text(page, model)
                    yield page_id, url, text, len(text)

        yield from in_slices(one(), OUT, 1024)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
