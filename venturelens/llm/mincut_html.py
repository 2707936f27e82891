"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags.  A logistic classifier of
text statistics (words, links, punctuation, kind of tag, the neighbours' statistics) gives each block
a log-odds; that, and what the page itself says about the containers (tags, roles,
class and id words), become its capacity to the source (content) or to the sink (boilerplate).
Adjacent blocks are joined by edges that weaken with their distance in the
document tree, and every block by an edge to its container, containers to their
parents.  The blocks on the source side of a minimum cut (maximum flow) are the text.

The classifier is trained in numpy, without hand-made labels: blocks in containers that name
themselves (article, main; nav, footer, aside, ads, comments, ...) teach it, from the
text statistics alone.  ``PAGES`` pages of smallest key hash, and at most
``BLOCKS`` evenly spaced blocks of each, are its bounded sample; every page is labelled whole.

Before the flow, a node whose terminal capacity is at least the sum of its edges is
fixed, exactly, and its edges become capacity of its neighbours; this settles
nearly all nodes in linear time.  The rest is solved by blocking flows, component by component.

Scripts, styles, templates, form controls and comments of the markup never give
text.  An unclosed raw element reaches to the end of the page.  A null page has an empty text;
repeated rows are extracted alike; an empty table gives an empty result; extra
columns are ignored, whatever their names.  A block whose costs tie is no content.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venturelens.llm.textkit import bounded_sample, slices
from venturelens.session import written

#: Pages that the classifier learns from, and blocks of each.
PAGES, BLOCKS = 2000, 40

# --- fixed values: names of HTML elements, roles and customary class words ----
BLOCK_TAGS = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th
thead tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("iframe noembed noframes script style textarea title xmp".split())
SKIPPED_TAGS = frozenset("audio button canvas datalist noscript object optgroup option select svg math template video".split())
#: An opening tag that ends open elements of these names, up to the given container.
IMPLIED_END = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
               "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th"), "body": ("head",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",),
         "tbody": ("table",), "option": ("select", "datalist"), "p": ("td", "th", "button", "table")}
ENDS_P = BLOCK_TAGS - {"html", "body", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
GOOD_TAGS, BAD_TAGS = frozenset(["article", "main"]), frozenset("nav footer aside header form menu dialog search".split())
GOOD_ROLES = frozenset(["main", "article"])
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
GOOD_WORDS = frozenset("article main content post entry story body prose".split())
BAD_WORDS = frozenset("""
ad ads advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment comments commentlist consent
cookie cookies copyright disclaimer discussion disqus feedback footer form gdpr guestbook header login masthead menu menus modal
nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related replies
reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget""".split())
#: A word after one of these says what surrounds the element, not what it is.
ASIDE_WORDS = frozenset("has with no without is".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE = re.compile(r"=\s*([\"'])")
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/>\"']|$)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def word_hint(names: str) -> int:
    """+1, -1 or 0: what the words of class or id names say; of each name the last telling word counts."""
    good = bad = False
    for name in names.split():
        said, before = 0, ""
        for word in _WORD.findall(name):
            word = word.lower()
            if before not in ASIDE_WORDS:
                said = -1 if word in BAD_WORDS else 1 if word in GOOD_WORDS else said
            before = word
        good, bad = good or said > 0, bad or said < 0
    return -1 if bad else int(good)


def own_hint(tag: str, attributes: str) -> int:
    """What an element says about its content by its tag, role, class, id and visibility."""
    said = 1 if tag in GOOD_TAGS else -1 if tag in BAD_TAGS else 0
    if not attributes or tag in ("html", "body"):
        return said
    words = 0
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return -1
        if name == "role":
            role = value.lower()
            said = 1 if role in GOOD_ROLES else -1 if role in BAD_ROLES else said
        elif name in ("class", "id"):
            words = -1 if words < 0 else word_hint(value) or words
    return words if words < 0 or not said else said


class Page:
    """Blocks and containers of one page.

    Containers: parent, tag, own hint.  Blocks: container, text, characters inside links.
    """

    def __init__(self, source: str):
        self.parent, self.tags, self.hints = [-1], [""], [0]
        self.node, self.text, self.linked = [], [], []
        self._read(source)

    def _read(self, source: str) -> None:
        # open elements: tag, container before it, skipped before it, linked before it
        stack, open_count = [], {}
        at, size = 0, len(source)
        here, skip, link = 0, 0, 0
        pieces, links = [], 0
        missing = set()

        def flush():
            nonlocal pieces, links
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.node.append(here)
                    self.text.append(text)
                    self.linked.append(min(links, len(text)))
                pieces, links = [], 0

        def close(upto: int):
            """Close the open elements from place ``upto`` on."""
            nonlocal here, skip, link
            for tag, _, _, _ in stack[upto:]:
                open_count[tag] -= 1
                if tag in BLOCK_TAGS:
                    flush()
            _, here, skip, link = stack[upto]
            del stack[upto:]

        while at < size:
            lt = source.find("<", at)
            lt = size if lt < 0 else lt
            if lt > at:
                if not skip:
                    piece = source[at:lt]
                    if "&" in piece:
                        piece = html.unescape(piece)
                    pieces.append(piece)
                    links += len(piece) if link else 0
                at = lt
                continue
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                if source.startswith("<!-->", at) or source.startswith("<!--->", at):
                    at = source.find(">", at) + 1
                else:
                    at = size if end < 0 else end + 3
                continue
            closing = source.startswith("</", at)
            m = _NAME.match(source, at + 1 + closing)
            if not m:
                if source.startswith(("<!", "<?", "</"), at):
                    end = source.find(">", at)
                    at = size if end < 0 else end + 1
                else:
                    if not skip:
                        pieces.append("<")
                    at += 1
                continue
            tag, begin = m[0].lower(), m.end()
            end = source.find(">", begin)
            look = begin
            while end >= 0 and (q := _QUOTE.search(source, look, end)) and q[1] not in missing:
                look = source.find(q[1], q.end())
                if look < 0:                   # no such quote is left: the tag ends at the next >
                    missing.add(q[1])
                    break
                look += 1
                if look > end:
                    end = source.find(">", look)
            if end < 0:                        # an unclosed tag at the end of the page
                break
            attributes, at = source[begin:end], end + 1
            if closing:
                if tag == "p" and not open_count.get("p"):
                    flush()
                if open_count.get(tag):
                    place = len(stack) - 1
                    while stack[place][0] != tag:
                        place -= 1
                    close(place)
                elif tag in BLOCK_TAGS:
                    flush()
                continue
            if tag in RAW_TAGS:
                if not attributes.endswith("/") or tag in ("script", "style", "title", "textarea"):
                    stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                    if not stop:
                        break
                    end = source.find(">", stop.end())
                    at = size if end < 0 else end + 1
                continue
            ends = IMPLIED_END.get(tag, ())
            if tag in ENDS_P:
                ends = (*ends, "p")
            if ends and any(open_count.get(e) for e in ends):
                stops, upto = SCOPE.get(tag, SCOPE["p"]), None
                for place in range(len(stack) - 1, max(-1, len(stack) - 200), -1):
                    if stack[place][0] in ends:
                        upto = place
                    elif stack[place][0] in stops:
                        break
                if upto is not None:
                    close(upto)
            if tag == "br":
                pieces.append(" ")
                continue
            if tag in BLOCK_TAGS:
                flush()
            if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS and tag != "a":
                continue
            stack.append((tag, here, skip, link))
            open_count[tag] = open_count.get(tag, 0) + 1
            if tag in BLOCK_TAGS or attributes and tag != "a":
                hint = own_hint(tag, attributes)
                if tag in BLOCK_TAGS:
                    self.parent.append(here)
                    self.tags.append(tag)
                    self.hints.append(hint)
                    here = len(self.tags) - 1
                elif hint < 0:
                    skip = 1                   # an inline advert, share link or hidden run
            if tag in SKIPPED_TAGS:
                skip = 1
            if tag == "a":
                link = 1
        flush()

    def resolved(self) -> list[int]:
        """Per container +1, -1 or 0, with what the containers around it say.

        Below boilerplate all is boilerplate.  A boilerplate container that holds most of the
        page's text and a content container is a wrapper and says nothing; a header inside content is content.
        """
        n = len(self.tags)
        size, good = [0] * n, [False] * n
        for node, text in zip(self.node, self.text):
            size[node] += len(text)
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
            good[self.parent[i]] |= good[i] or self.hints[i] > 0
        out, wrapped = [0] * n, size[0] / 2
        for i in range(1, n):
            around, own = out[self.parent[i]], self.hints[i]
            if own < 0 and size[i] > wrapped and (good[i] or self.tags[i] == "form"):
                own = 0
            if own < 0 and around > 0 and self.tags[i] == "header":
                own = 0
            out[i] = -1 if around < 0 or own < 0 else own or around
        return out


N_FEATURES = 19
_ENDS = tuple(".!?…:;\"”»')")


def features(page: Page) -> np.ndarray:
    """Text statistics of every block and of its two neighbours."""
    n = len(page.text)
    x = np.zeros((n, N_FEATURES), np.float32)
    for i, (text, node) in enumerate(zip(page.text, page.node)):
        words = text.count(" ") + 1
        tag = page.tags[node]
        x[i, :14] = (1, np.log1p(words), page.linked[i] / len(text), text.endswith(_ENDS),
                     min(1.0, (text.count(".") + text.count(",") + text.count("!") + text.count("?")) / words),
                     "©" in text, "|" in text or "»" in text or "·" in text, text[0].isupper(), text[0].isdigit(),
                     tag == "p", tag[0:1] == "h" and tag[1:2].isdigit(), tag in ("li", "dd", "dt"), tag in ("td", "th"),
                     min(3.0, len(text) / words / 6))
    if n:
        x[1:, 14], x[:-1, 15] = x[:-1, 1], x[1:, 1]
        x[1:, 16], x[:-1, 17] = x[:-1, 2], x[1:, 2]
        x[:, 18] = x[:, 1] * x[:, 2]
    return x


@dataclass(frozen=True)
class Labeller:
    """Weights of the classifier and of the edges; capacities are integers, ``UNIT`` to a unit of log-odds."""

    weights: tuple[float, ...]
    limit: float = 4.0
    hint: float = 9.0
    adjacent: float = 3.0
    container: float = 2.0

    UNIT = 1000

    def capacities(self, page: Page) -> list[int]:
        """Per block: to the source where above 0, to the sink where below."""
        odds = np.clip(features(page) @ np.array(self.weights, np.float64), -self.limit, self.limit)
        hints = page.resolved()
        return [int(round(self.UNIT * (float(o) + self.hint * hints[node]))) for o, node in zip(odds, page.node)]

    def edges(self, page: Page) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of nodes (blocks, then containers that hold blocks), and (node, node, capacity)."""
        n, out, number = len(page.node), [], {}
        unit = self.UNIT
        depth = [0] * len(page.tags)
        for i in range(1, len(page.tags)):
            depth[i] = depth[page.parent[i]] + 1
        for i in range(n - 1):
            a, b, steps = page.node[i], page.node[i + 1], 0
            while a != b and steps < 12:       # twelve steps apart weigh as little as more
                if depth[a] >= depth[b]:
                    a = page.parent[a]
                else:
                    b = page.parent[b]
                steps += 1
            out.append((i, i + 1, int(unit * self.adjacent / (1 + steps))))
        for i, node in enumerate(page.node):
            if node not in number:
                number[node] = n + len(number)
            out.append((i, number[node], int(unit * self.container)))
        for node in list(number):
            while node > 0 and page.parent[node] not in number:
                up = page.parent[node]
                number[up] = n + len(number)
                out.append((number[node], number[up], int(unit * self.container / 2)))
                node = up
            if node > 0:
                out.append((number[node], number[page.parent[node]], int(unit * self.container / 2)))
        return n + len(number), out

    def text(self, source: str | None) -> str:
        page = Page(source or "")
        if not page.text:
            return ""
        count, edges = self.edges(page)
        caps = self.capacities(page) + [0] * (count - len(page.text))
        side = min_cut(caps, edges)
        return "\n".join(t for t, s in zip(page.text, side) if s)


def min_cut(caps: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut.

    ``caps``: capacity from the source (above 0) or to the sink (below 0) of every node;
    ``edges``: undirected, with capacities of at least 0.
    """
    n, caps = len(caps), list(caps)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    load = [sum(d.values()) for d in near]
    side: list[bool | None] = [None] * n
    work = list(range(n))
    while work:
        v = work.pop()
        if side[v] is not None or abs(caps[v]) < load[v]:
            continue
        side[v] = caps[v] > 0
        for u, c in near[v].items():
            if side[u] is None:
                caps[u] += c if side[v] else -c
                load[u] -= c
                if abs(caps[u]) >= load[u]:
                    work.append(u)
    for v in range(n):
        if side[v] is None:
            part, seen = [v], {v}
            for x in part:
                for u in near[x]:
                    if side[u] is None and u not in seen:
                        seen.add(u)
                        part.append(u)
            for x, s in zip(part, _flow(part, caps, near, side)):
                side[x] = s
    return side


def _flow(part: list[int], caps: list[int], near: list[dict[int, int]], side: list) -> list[bool]:
    """Source side of one component, by blocking flows on the layered residual graph."""
    if all(caps[v] <= 0 for v in part):
        return [False] * len(part)
    if all(caps[v] >= 0 for v in part):
        return [True] * len(part)
    place = {v: i for i, v in enumerate(part)}
    n = len(part)
    source, sink = n, n + 1
    out: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def add(a, b, forth, back):
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, v in enumerate(part):
        if caps[v] > 0:
            add(source, i, caps[v], 0)
        elif caps[v] < 0:
            add(i, sink, -caps[v], 0)
        for u, c in near[v].items():
            j = place.get(u)
            if j is not None and j > i:
                add(i, j, c, c)
    while True:
        layer = [-1] * (n + 2)
        layer[source] = 0
        queue = [source]
        for v in queue:
            for e in out[v]:
                if room[e] and layer[to[e]] < 0:
                    layer[to[e]] = layer[v] + 1
                    queue.append(to[e])
        if layer[sink] < 0:
            return [layer[i] >= 0 for i in range(n)]
        next_edge = [0] * (n + 2)
        path, v = [], source
        while True:
            if v == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if not room[e])
                v = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while next_edge[v] < len(out[v]):
                e = out[v][next_edge[v]]
                if room[e] and layer[to[e]] == layer[v] + 1:
                    break
                next_edge[v] += 1
            if next_edge[v] < len(out[v]):
                path.append(out[v][next_edge[v]])
                v = to[path[-1]]
            elif v == source:
                break
            else:
                layer[v] = -2
                v = to[path.pop() ^ 1]


# --- training and extraction --------------------------------------------------

#: What training starts from and shrinks towards, so that a sample of one layout does not unlearn that long,
#: punctuated, link-free blocks are content; used as it is where no block of the sample says what it is.
PLAIN = (-2.0, 1.0, -5.0, 0.5, 1.0, -2.0, -1.0) + (0.0,) * (N_FEATURES - 7)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 25, decay: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression around PLAIN, both classes of equal total weight, by Newton steps."""
    good = y > 0
    share = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum()))
    w = np.array(PLAIN)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - good)) + decay * (w - PLAIN)
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    return w


def fit(pages: DataFrame) -> Labeller:
    """Labeller trained on a bounded sample of the pages' self-describing blocks."""
    keys = written(bounded_sample(pages.where("page_id is not null").select("page_id"), None, PAGES, "page_id").distinct(), "pages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "html")):
            rows = []
            for source in batch.column("html").to_pylist():
                page = Page(source or "")
                hints, x = page.resolved(), features(page)
                said = np.array([hints[node] for node in page.node], np.float32)
                told = np.flatnonzero(said)
                told = told[np.unique(np.linspace(0, len(told) - 1, min(len(told), BLOCKS)).astype(int))] if len(told) else told
                rows.append(np.concatenate([said[told, None], x[told]], axis=1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(rows, pa.list_(pa.float32()))], names=["page_id", "x"])

    kind = dict(pages.dtypes)["page_id"]
    sample = (pages.select("page_id", "html").join(keys, "page_id", "left_semi")
              .mapInArrow(run, f"page_id {kind}, x array<float>").groupBy("page_id").agg(F.min("x").alias("x")))
    data = np.array([v for r in sample.orderBy("page_id").collect() for v in r["x"]], np.float64).reshape(-1, N_FEATURES + 1)
    if len(np.unique(data[:, 0])) < 2:
        return Labeller(PLAIN)
    return Labeller(tuple(logistic(data[:, 1:], data[:, 0])))


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """page_id, url, text and n_chars of every page; no shuffle."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "html")):
            texts = [labeller.text(s.as_py()) for s in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
