"""Operator 2, main text of HTML pages: a tree-structured graphical model over the DOM.

Every block element and every run of text is a node that is content or not.
A node's class words, size and share of links speak for its own state, and each
state depends on the parent's in a way that the node's tag decides. One sum-product pass up the tree and
one down give every run of text its marginal of being content. All tables are
counted on labelled pages: pages with their main text known.

Without labelled pages of one's own, :func:`labelled_pages` makes some of many
layouts from a small grammar.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the query's model is trained on.
TRAINING_PAGES = 400

# Element classes of HTML.
BLOCKS = frozenset(
    "html body div p article section main nav header footer aside h1 h2 h3 h4 h5 h6 ul ol li table thead tbody tfoot tr "
    "td th caption form fieldset blockquote pre dl dt dd figure figcaption details summary address hr menu center".split()
)
SKIPPED = frozenset("script style noscript template head title svg math iframe object select textarea button canvas".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What leaves <head> open; svg and math inside which other elements start again; skipped elements that may hold blocks and each other.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
FOREIGN, INSIDE = frozenset(("svg", "math")), frozenset("foreignobject desc annotation-xml".split())
NESTED = frozenset(("template", "object"))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|[^<]+|<", re.S
)
_HINT = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_STOP = re.compile(r"[.!?](?:\s|$)")


@dataclass
class Node:
    """An element, or with ``text`` a run of text."""

    parent: int
    tag: str
    hints: tuple[str, ...] = ()
    text: str | None = None
    linked: int = 0
    features: list[str] = field(default_factory=list)


def parse(source: str) -> list[Node]:
    """Block elements and runs of text in page order, parents first. Broken and cut markup is read as far as it goes."""
    nodes = [Node(-1, "#root")]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open tags and the node each belongs to
    run: list[str] = []
    linked, in_link, skip = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = "".join(run)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                nodes.append(Node(stack[-1][1], "#text", text=text, linked=linked))
            run.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal in_link, skip
        for tag, _ in stack[depth:]:
            in_link -= tag == "a"
            skip -= tag in SKIPPED
        del stack[depth:]

    at, size = 0, len(source)
    seen: dict[str, int] = {}

    def ahead(start: str) -> int:
        """Where the next such tag starts."""
        if seen.get(start, -1) < at:
            found = re.compile(rf"{start}(?=[\s/>])", re.I).search(source, at)
            seen[start] = size if found is None else found.start()
        return seen[start]

    def unclosed(tag: str) -> bool:
        """Whether a block ends an open skipped element: it has no end tag of its own ahead, or never holds blocks."""
        if tag == "head" or tag in FOREIGN:
            return True
        end = ahead(f"</{tag}")
        return end == size or tag not in NESTED and ahead(f"<{tag}") < end

    while at < size:
        m = _TOKEN.match(source, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            piece = m.group()
            if stack[-1][0] == "head" and piece[0] != "<" and piece.strip():
                close(len(stack) - 1)
            if not skip and not (piece[0] == "<" and len(piece) > 1):
                run.append(piece)
                if in_link:
                    linked += len(piece.strip())
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in BLOCKS:
                flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
                if tag not in BLOCKS and stack[depth][0] in BLOCKS:
                    break
            continue
        if stack[-1][0] == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag == "br":
            run.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
            cut = len(stack)
            for depth in range(len(stack) - 1, 0, -1) if skip else ():
                open_tag = stack[depth][0]
                if open_tag in SKIPPED and unclosed(open_tag):
                    cut = depth
                elif open_tag in SKIPPED or open_tag in BLOCKS or open_tag in INSIDE:
                    break
            close(cut)
            shut = CLOSES.get(tag, ())
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = stack[depth][0]
                if open_tag == "p" or open_tag in shut:
                    close(depth)
                    break
                if open_tag in BLOCKS:
                    break
        if tag in VOID or m.group(3).endswith("/") and not block:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(source, at)
            at = size if end is None else source.find(">", end.start()) + 1 or size
            continue
        if block:
            hints = [h for g in _HINT.findall(m.group(3)) for h in _PART.findall("".join(g).lower())]
            nodes.append(Node(stack[-1][1], tag, tuple(dict.fromkeys(hints))))
            stack.append((tag, len(nodes) - 1))
        else:
            stack.append((tag, stack[-1][1]))
            in_link += tag == "a"
            skip += tag in SKIPPED
    flush()
    return nodes


def describe(nodes: list[Node]) -> None:
    """Set the features of all nodes."""
    chars, links = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        n = nodes[i]
        if n.text is not None:
            chars[i], links[i] = len(n.text), n.linked
        chars[n.parent] += chars[i]
        links[n.parent] += links[i]
    for i, n in enumerate(nodes):
        share = links[i] / chars[i] if chars[i] else 0.0
        size = min(10, chars[i].bit_length())
        link = min(3, int(share * 4))
        if n.text is None:
            n.features = [f"links:{link}", f"size:{size // 3}", *(f"hint:{h}" for h in n.hints)]
        else:
            n.features = [f"link:{link}", f"chars:{size // 2}", f"stop:{bool(_STOP.search(n.text))}"]


TOP = ("#root", "html", "body")
#: Edges of a kind seen less often share one table.
SELDOM = 20


def edge(nodes: list[Node], node: Node) -> str:
    """The kind of a node's edge to its parent: from the page's frame or inside it, and the node's tag."""
    return f"top {node.tag}" if node.parent < 0 or nodes[node.parent].tag in TOP else node.tag


class Model:
    """Log tables of the tree model: features given the state, state given the parent's."""

    def __init__(self, features: dict[str, tuple[float, float]], moves: dict[str, tuple[tuple[float, float], ...]], weight: float) -> None:
        self.features = features  # log P(feature | state); unknown features say nothing
        self.moves = moves  # P(child state | parent state) by kind of edge
        self.weight = weight  # of sizes, links and stops, which say the same thing several times

    @classmethod
    def trained(cls, pages: Iterable[tuple[str, str]], smooth: float = 0.5) -> Model:
        """Count the tables on (html, main text) pages, then choose how much size features weigh on the same pages."""
        seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        totals: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        kinds: dict[str, set[str]] = defaultdict(set)
        moves: dict[str, list[list[float]]] = defaultdict(lambda: [[smooth, smooth], [smooth, smooth]])
        states = [0.0, 0.0]
        known = []
        for source, main in pages:
            nodes = parse(source)
            describe(nodes)
            state = truth(nodes, main)
            known.append((nodes, state))
            for n, s in zip(nodes, state):
                states[s] += 1
                if n.parent >= 0:
                    for kind in (edge(nodes, n), "element"):
                        moves[kind][state[n.parent]][s] += 1
                for f in n.features:
                    kind = f.split(":")[0]
                    seen[f][s] += 1
                    totals[kind][s] += 1
                    kinds[kind].add(f)
        features = {}
        for f, counts in seen.items():
            kind = f.split(":")[0]
            of, ways = (states, 2) if kind == "hint" else (totals[kind], len(kinds[kind]))
            features[f] = tuple(math.log((counts[s] + smooth) / (of[s] + smooth * ways)) for s in (0, 1))
        rows = {
            kind: tuple(tuple(x / sum(row) for x in row) for row in table)
            for kind, table in moves.items()
            if kind == "element" or sum(map(sum, table)) >= SELDOM
        }
        models = [cls(features, rows, weight) for weight in (0.0, 0.15, 0.3, 0.6, 1.0)]
        return max(models, key=lambda m: sum(m.right(nodes, state) for nodes, state in known))

    def right(self, nodes: list[Node], state: list[int]) -> int:
        """Runs of text whose state the model finds."""
        found = self.marginals(nodes)
        return sum((p >= 0.5) == s for n, p, s in zip(nodes, found, state) if n.text is not None)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of every node: messages to the parents, then to the children."""
        n = len(nodes)
        kinds = [self.moves.get(edge(nodes, node)) or self.moves["element"] for node in nodes]
        own0, own1 = [1.0] * n, [1.0] * n
        table = self.features
        for i, node in enumerate(nodes):
            gap = 0.0
            for f in node.features:
                known = table.get(f)
                if known:
                    gap += (known[1] - known[0]) * (1.0 if f.startswith("hint") else self.weight)
            gap = max(-50.0, min(50.0, gap))
            own1[i] = 1.0 / (1.0 + math.exp(-gap))
            own0[i] = 1.0 - own1[i]
        up0, up1 = [1.0] * n, [1.0] * n  # message of a node to its parent, by the parent's state
        for i in range(n - 1, 0, -1):
            (m00, m01), (m10, m11) = kinds[i]
            a, b = own0[i], own1[i]  # by now with the children's messages
            u0, u1 = m00 * a + m01 * b, m10 * a + m11 * b
            total = u0 + u1
            up0[i], up1[i] = u0 / total, u1 / total
            p = nodes[i].parent
            x, y = own0[p] * up0[i], own1[p] * up1[i]
            total = x + y
            own0[p], own1[p] = (x / total, y / total) if total > 0 else (0.5, 0.5)
        own0[0], own1[0] = 1.0, 0.0  # nothing outside the page is content
        for i in range(1, n):
            p = nodes[i].parent
            (m00, m01), (m10, m11) = kinds[i]
            # the parent's belief without this child's message
            x, y = own0[p] / max(up0[i], 1e-300), own1[p] / max(up1[i], 1e-300)
            d0, d1 = x * m00 + y * m10, x * m01 + y * m11
            a, b = own0[i] * d0, own1[i] * d1
            total = a + b
            own0[i], own1[i] = (a / total, b / total) if total > 0 else (0.5, 0.5)
        return own1


def truth(nodes: list[Node], main: str) -> list[int]:
    """States from the known main text: runs found in it are content, elements if most of their characters are; the page's frame is not."""
    wanted = Counter(main.split("\n"))
    good, all_chars = [0] * len(nodes), [0] * len(nodes)
    state = [0] * len(nodes)
    for i, n in enumerate(nodes):
        if n.text is not None:
            all_chars[i] = len(n.text)
            if wanted[n.text] > 0:
                wanted[n.text] -= 1
                good[i] = len(n.text)
    for i in range(len(nodes) - 1, 0, -1):
        good[nodes[i].parent] += good[i]
        all_chars[nodes[i].parent] += all_chars[i]
        state[i] = int(good[i] * 2 > all_chars[i] and nodes[i].tag not in TOP)
    return state


def main_text(source: str, model: Model) -> str:
    """Content blocks in page order, one per line; empty if there is none."""
    nodes = parse(source)
    describe(nodes)
    return "\n".join(n.text for n, p in zip(nodes, model.marginals(nodes)) if n.text is not None and p >= 0.5)


# -- labelled pages --------------------------------------------------------------------------------
_CONTENT_OPEN = (
    "<article>", "<main>", "<main><article>", '<div class="content">', '<div id="main">', '<div class="post">',
    '<div class="article-body">', '<section class="story">', '<div id="content"><div class="entry">', "<div>", "<section>",
)
_BAR = ("nav", "header", "footer", "aside", "form")
_BOX = (
    "ad", "ads", "advert", "banner", "sponsored", "promo", "sidebar", "menu", "navbar", "breadcrumb", "cookie", "notice",
    "consent", "popup", "comments", "comment", "reply", "related", "share", "social", "newsletter", "subscribe", "login",
    "search", "widget", "footer", "header", "topbar", "alert", "pagination", "tags", "disclaimer", "copyright",
)


class _Writer:
    """Writes random pages and keeps their main text."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.words = ["".join(self.rng.choice("aeioubdglmnrst") for _ in range(self.rng.randint(2, 9))) for _ in range(500)]

    def sentence(self, low: int, high: int) -> str:
        words = [self.rng.choice(self.words) for _ in range(self.rng.randint(low, high))]
        return " ".join(words).capitalize() + ("." if self.rng.random() < 0.85 else "")

    def prose(self) -> str:
        return " ".join(self.sentence(2, 18) for _ in range(self.rng.choice((1, 1, 1, 2, 3, 5, 8))))

    def dressed(self, text: str) -> str:
        """Inline markup that leaves the text as it is."""
        words = text.split(" ")
        if len(words) > 2 and self.rng.random() < 0.3:
            i = self.rng.randrange(len(words))
            tag = self.rng.choice(('<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "<span>{}</span>"))
            words[i] = tag.format(words[i])
        return " ".join(words)

    def links(self) -> str:
        count = self.rng.randint(2, 9)
        items = [f'<a href="/{self.rng.choice(self.words)}">{self.rng.choice(self.words)}</a>' for _ in range(count)]
        if self.rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " ".join(items)

    def extra(self) -> str:
        """A box that is no content."""
        rng = self.rng
        if rng.random() < 0.45:
            tag = rng.choice(_BAR)
            opened, closed = f"<{tag}>", f"</{tag}>"
        else:
            tag = rng.choice(("div", "div", "section", "ul"))
            name = rng.choice(("class", "class", "id"))
            hint = rng.choice(_BOX) + rng.choice(("", "", "-box", "-list", " wide"))
            opened, closed = f'<{tag} {name}="{hint}">', f"</{tag}>"
        inner = []
        for _ in range(rng.randint(1, 3)):
            inner.append(
                rng.choice(
                    (
                        self.links,
                        lambda: f"<p>{self.dressed(self.prose())}</p>",
                        lambda: self.sentence(1, 8),
                        lambda: f"<h3>{self.sentence(1, 4)}</h3>",
                        lambda: f"<div>{self.sentence(2, 14)}</div>",
                        lambda: f"&copy; {rng.choice(self.words)} &middot; {self.sentence(1, 6)}",
                        lambda: f"<label>{self.sentence(1, 3)}</label><input name=q><button>Go</button>",
                    )
                )()
            )
        return opened + "".join(inner) + closed

    def page(self) -> tuple[str, str]:
        rng, main = self.rng, []
        out = [f"<!DOCTYPE html><html><head><title>{self.sentence(2, 6)}</title><style>p{{margin:0}}</style></head><body>"]
        out += [self.extra() for _ in range(rng.randint(0, 4))]
        opened = rng.choice(_CONTENT_OPEN)
        out.append(opened)

        def keep(tag: str, text: str) -> None:
            main.append(text)
            out.append(f"<{tag}>{self.dressed(text)}" + ("" if tag in ("p", "li") and rng.random() < 0.2 else f"</{tag}>"))

        if rng.random() < 0.8:
            keep("h1", self.sentence(2, 10))
        if rng.random() < 0.1:  # verse, lists of names, transcripts: very many short blocks
            for _ in range(rng.randint(30, 150)):
                keep("p", self.sentence(1, 3))
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.75:
                keep("p", self.prose())
            elif kind < 0.83:
                keep("h2", self.sentence(1, 6))
            elif kind < 0.88:
                out.append("<ul>")
                for _ in range(rng.randint(1, 5)):
                    keep("li", self.sentence(1, 12))
                out.append("</ul>")
            elif kind < 0.92:
                out.append("<blockquote>")
                keep("p", self.prose())
                out.append("</blockquote>")
            elif kind < 0.95:
                out.append("<table><tr>")
                for _ in range(rng.randint(1, 4)):
                    keep("td", self.sentence(1, 4))
                out.append("</tr></table>")
            else:
                out.append(self.extra())
        if rng.random() < 0.2:
            out.append(self.extra())
        for tag in reversed(re.findall(r"<(\w+)", opened)):
            out.append(f"</{tag}>")
        out += [self.extra() for _ in range(rng.randint(0, 4))]
        out.append("</body></html>")
        return "".join(out), "\n".join(main)


def labelled_pages(count: int = TRAINING_PAGES, seed: int = 7) -> list[tuple[str, str]]:
    """Made pages of many layouts with their main text."""
    writer = _Writer(seed)
    return [writer.page() for _ in range(count)]


def extract(pages: DataFrame, model: Model, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Add the main text of every page as ``text_col``, which replaces a column of that name.

    Whole pages are read. Null and empty pages have an empty text; text without
    any markup is judged like other text. All other columns and rows stay as
    they are, repeated ones too; an empty table stays empty.
    """
    others = [c for c in pages.columns if c != text_col]
    source = pages.select(
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("__html"), *[F.col(f"`{c}`") for c in others if c != html_col]
    )
    kept = source.columns[1:]
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept] + [f"`{text_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, model) for page in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*kept, text_col])

    return source.mapInArrow(run, schema)
