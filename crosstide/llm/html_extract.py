"""Main text of web pages by a linear-chain conditional random field.

A page becomes a chain of leaf blocks: runs of text between block-level tags, in page order. A block's
features are its ancestors' tags and the words of their class, id and role, its own tag, and text features
(length, link share, sentence marks, control words). The field has the labels boilerplate and
main, a weight per feature and label, and a weight per pair of neighbouring labels. It is fitted by
stochastic gradient ascent on the likelihood (forward-backward sums) of labelled pages, of which a tenth of the steps leaves
the markup out; pages are decoded by Viterbi. An element's path features are weighed once, whatever stands in it.

Labelled pages are the hand-made layouts of ``examples`` and at most ``FIT_PAGES`` given pages of at most
``FIT_CHARS`` characters, chosen by hash, whose own markup names its article: their blocks are
labelled by ``labelled_by_markup``. Only the fit is bounded so; every page is decoded whole.

Inside a block, character references are decoded and white space becomes one space; main
blocks are joined by a line end. Scripts, styles, comments, templates and form controls never become blocks.

Defined cases: null or empty html, or a page without blocks, gives an empty text. Broken markup is
read as far as it goes. A head without an end tag ends at the body, at a tag or at a text that cannot stand in it. Repeated rows are read each. An empty table gives an empty result. Only page_id,
url and html of the input are used.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crosstide.session import stage


FIT_PAGES, FIT_CHARS = 120, 100_000
EPOCHS = 12
DROP = 0.1
RATE = 0.5
DECAY = 1e-4

# Fixed lists: tags of HTML by how they lay out text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select option textarea "
                   "button datalist".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot "
                  "th thead tr ul".split())
# What may stand in a head; any other tag ends it, as its end tag may be left out.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
FENCES = frozenset("ul ol dl table menu nav div body".split())
CLOSES_P = BLOCK - {"html", "body"}
# Fixed lists: words that name parts of a page in its markup.
MAIN_TAGS = frozenset(["article", "main"])
OTHER_TAGS = frozenset("nav footer aside form header menu dialog".split())
OTHER_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
                        "discussion disqus footer form gdpr header login menu modal nav navbar navigation newsletter notice notices pagination "
                        "popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor "
                        "sponsored subscribe subscription toolbar widget".split())
_NAMES = re.compile(r"[a-z0-9]+")
# A tag, comment or declaration that the page breaks off in.
_UNFINISHED = re.compile(r"<(?:!--(?:(?!-->).)*|[a-zA-Z/!?][^<>]*)$", re.DOTALL)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An open element: its parent, tag, names, the path features that it is the first to bring, and the nearest block tag."""
    __slots__ = ("parent", "tag", "words", "first", "inner", "score")

    def __init__(self, parent: Node | None, tag: str, words: tuple[str, ...], first: tuple[str, ...]):
        self.parent, self.tag, self.words, self.first, self.score = parent, tag, words, first, None
        self.inner = tag if tag in BLOCK else parent.inner if parent else "none"

    def path(self) -> Iterator[Node]:
        """The elements from the root to this one."""
        up, node = [], self
        while node:
            up.append(node)
            node = node.parent
        return reversed(up)


def _path_features(tag: str, words: tuple[str, ...]) -> set[str]:
    names = {f"in={tag}", *(f"in:{w}" for w in words)}
    if tag in MAIN_TAGS:
        names.add("inside main")
    if tag in OTHER_TAGS:
        names.add("inside other")
    for w in words:
        word = w.partition("=")[2]
        if word in OTHER_WORDS:
            names.add("inside named other")
        if word in ("article", "content", "main", "post", "entry", "story", "body", "text"):
            names.add("inside named main")
    return names


class _Blocks(HTMLParser):
    """Collects leaf blocks: (text, link characters, innermost open element or None).

    The places of open elements are kept per tag, so no tag scans the stack; a page's time grows with its
    length, however deep it nests.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Node] = []
        self.at: dict[str, list[int]] = {}          # tag -> places in the stack
        self.blocks_at: list[int] = []              # of block tags
        self.fences_at: list[int] = []              # of tags beyond which no sibling is closed
        self.active: Counter[str] = Counter()       # path features
        self.silent = 0
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[str, int, Node | None]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, self.linked, self.open[-1] if self.open else None))
        self.parts, self.linked = [], 0

    def _push(self, tag: str, words: tuple[str, ...]) -> None:
        names = _path_features(tag, words)
        first = tuple(sorted(n for n in names if not self.active[n]))
        self.active.update(names)
        place = len(self.open)
        self.open.append(Node(self.open[-1] if self.open else None, tag, words, first))
        self.at.setdefault(tag, []).append(place)
        if tag in BLOCK:
            self.blocks_at.append(place)
        if tag in FENCES:
            self.fences_at.append(place)
        self.silent += tag in SILENT
        self.links += tag == "a"

    def _pop(self) -> str:
        node = self.open.pop()
        tag, place = node.tag, len(self.open)
        self.active.subtract(_path_features(tag, node.words))
        self.at[tag].pop()
        for places in (self.blocks_at, self.fences_at):
            if places and places[-1] == place:
                places.pop()
        self.silent -= tag in SILENT
        self.links -= tag == "a"
        return tag

    def _last(self, tag: str) -> int:
        """The place of the innermost open element with this tag; -1 if there is none."""
        places = self.at.get(tag)
        return places[-1] if places else -1

    def _leaves_head(self, tag: str) -> bool:
        """Whether the tag ends an open head: not inside of what stands in the head, unless it is the body itself."""
        if tag in HEAD or self._last("head") < 0:
            return False
        return tag == "body" or self.open[-1].tag in ("head", "noscript")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self._leaves_head(tag):
            self._close("head")
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES_P:
                self._close("p")
            if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and self._last(tag) > (self.fences_at[-1] if self.fences_at else -1):
                self._close(tag)
        if tag in VOID:
            if tag in ("br", "hr"):
                self.parts.append("\n")
            return
        names: list[str] = []
        for k, v in attrs:
            if k in ("class", "id", "role", "aria-label", "itemprop") and v:
                names += [f"{'class' if k in ('class', 'id') else k}={w}" for w in _NAMES.findall(_CAMEL.sub(" ", v).lower())]
        self._push(tag, tuple(names))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        if self._last(tag) >= 0:
            while self._pop() != tag:
                pass

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        # an inline end tag does not close the block around it
        elif tag not in SILENT and self._last(tag) < (self.blocks_at[-1] if self.blocks_at else -1):
            return
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].tag == "head" and data.strip():
            self._close("head")
        if self.silent <= 0:
            self.parts.append(data)
            if self.links > 0:
                self.linked += len(data.strip())


def blocks(page: str | None) -> list[tuple[str, int, Node | None]]:
    parser = _Blocks()
    parser.feed(_UNFINISHED.sub("", page or ""))
    parser.close()
    parser.flush()
    return parser.blocks


def text_features(text: str, linked: int) -> list[str]:
    """Features of a block that its markup has no part in, but for its links."""
    names = ["bias", f"length={min(6, len(text).bit_length() // 2)}", f"links={int(4 * min(1.0, linked / max(1, len(text))))}",
             f"ends={text[-1] if text[-1] in '.!?:;,' else 'other'}", f"sentences={min(3, text.count('. '))}"]
    return [*names, "copyright"] if "©" in text or "copyright" in text.lower() else names


def features(found: list[tuple[str, int, Node | None]]) -> list[list[str]]:
    """Feature names of each block."""
    out = []
    for text, linked, node in found:
        names = {*text_features(text, linked), f"tag={node.inner if node else 'none'}"}
        for element in node.path() if node else ():
            names.update(element.first)
        out.append(sorted(names))
    return out


def labelled_by_markup(found: list[tuple[str, int, Node | None]]) -> list[int] | None:
    """1 for blocks in the page's article and in no part named as something else; None if no article is marked."""
    paths = [list(node.path()) if node else [] for _, _, node in found]
    if not any(n.tag in MAIN_TAGS or "role=main" in n.words for path in paths for n in path):
        return None
    out = []
    for path in paths:
        main = 0
        for n in path:
            if n.tag in MAIN_TAGS or "role=main" in n.words:
                main = 1
            elif n.tag in OTHER_TAGS or any(w.partition("=")[2] in OTHER_WORDS for w in n.words):
                main = 0
                break
        out.append(main)
    return out


# -- the field ----------------------------------------------------------------------------------

class Field:
    """Weights by feature name (two labels each), label pairs and start."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.pair = np.zeros((2, 2))
        self.start = np.zeros(2)

    def emissions(self, names: list[list[str]]) -> np.ndarray:
        zero = np.zeros(2)
        return np.array([np.sum([self.weights.get(f, zero) for f in fs], axis=0) for fs in names]).reshape(-1, 2)

    def path_score(self, node: Node | None) -> np.ndarray:
        """Weights of the path features, summed once per element."""
        todo = []
        while node and node.score is None:
            todo.append(node)
            node = node.parent
        score = node.score if node else np.zeros(2)
        for n in reversed(todo):
            own = [self.weights[f] for f in n.first if f in self.weights]
            score = n.score = score + np.sum(own, axis=0) if own else score
        return score

    def labels(self, found: list[tuple[str, int, Node | None]]) -> list[int]:
        """The most likely labels of a page's blocks."""
        own = self.emissions([[*text_features(text, linked), f"tag={node.inner if node else 'none'}"] for text, linked, node in found])
        return self.viterbi(own + np.array([self.path_score(node) for _, _, node in found]).reshape(-1, 2))

    def decode(self, names: list[list[str]]) -> list[int]:
        return self.viterbi(self.emissions(names))

    def viterbi(self, e: np.ndarray) -> list[int]:
        """The most likely labels."""
        if not len(e):
            return []
        best, back = self.start + e[0], []
        for row in e[1:]:
            step = best[:, None] + self.pair
            back.append(step.argmax(0))
            best = step.max(0) + row
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label and label-pair probabilities (forward-backward in logarithms)."""
        n = len(e)
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = self.start + e[0]
        for i in range(1, n):
            f[i] = np.logaddexp.reduce(f[i - 1][:, None] + self.pair, axis=0) + e[i]
        for i in range(n - 2, -1, -1):
            b[i] = np.logaddexp.reduce(self.pair + (e[i + 1] + b[i + 1])[None, :], axis=1)
        z = np.logaddexp.reduce(f[-1])
        pairs = np.zeros((2, 2))
        for i in range(1, n):
            pairs += np.exp(f[i - 1][:, None] + self.pair + (e[i] + b[i])[None, :] - z)
        return np.exp(f + b - z), pairs

    def learn(self, names: list[list[str]], gold: list[int], rate: float) -> None:
        e = self.emissions(names)
        p, pairs = self.marginals(e)
        hot = np.eye(2)[gold]
        step = rate * (hot - p)
        for fs, g in zip(names, step, strict=True):
            for f in fs:
                w = self.weights.get(f)
                self.weights[f] = g.copy() if w is None else w * (1 - rate * DECAY) + g
        seen = np.zeros((2, 2))
        np.add.at(seen, (gold[:-1], gold[1:]), 1)
        self.pair += rate * (seen - pairs)
        self.start += step[0]


def examples() -> list[tuple[str, list[int]]]:
    """Hand-made labelled layouts: markup with block labels in page order."""
    words = "The first part of a story runs over some lines. It says what was seen and by whom."
    body = f"<p>{words} Another part adds more to it.</p><p>{words}</p><p>It ends.</p>"
    out = []

    def page(*parts: tuple[str, list[int]]) -> None:
        out.append((f"<html><body>{''.join(p for p, _ in parts)}</body></html>", [y for _, ys in parts for y in ys]))

    menu = ("<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>", [0, 0])
    foot = ("<footer>&copy; site. All rights reserved.</footer>", [0])
    def inside(other: str) -> None:
        """A short part that is not the story, in the middle of it."""
        page(menu, ("<article><h1>A title</h1>" + body, [1] * 4), (other, [0]), (body + "</article>", [1] * 3), foot)
        page(("<main><p>One.</p>", [1]), (other, [0]), ("<p>Two more.</p></main>", [1]), foot)

    for name in sorted(OTHER_WORDS):
        inside(f'<div class="{name}">See this</div>')
        inside(f'<div id="{name}"><p>{words}</p></div>')
        for tag in ("div", "section"):
            other = (f'<{tag} class="{name}"><p>{words}</p><p>Some more words here.</p></{tag}>', [0, 0])
            page(menu, ("<article><h1>A title</h1>" + body, [1] * 4), other, ("</article>", []), foot)
            page(menu, other, ("<article><h1>A title</h1>" + body + "</article>", [1] * 4), foot)
            page(menu, ("<div class=content><h1>A title</h1>" + body + "</div>", [1] * 4), other, foot)
    for tag in sorted(OTHER_TAGS):
        inside(f"<{tag}><p>See this</p></{tag}>")
        inside(f"<{tag}><p>More.</p></{tag}>")
        inside(f"<{tag}>{words}</{tag}>")
        other = (f"<{tag}><p>{words}</p><ul><li><a href=/x>See more</a></li></ul></{tag}>", [0, 0])
        page(menu, other, ("<article><h1>A title</h1>" + body, [1] * 4), other, ("</article>", []), other, foot)
        page(other, ("<main><h1>A title</h1>" + body + "</main>", [1] * 4), other, foot)
        page(menu, ("<div id=main><h2>A title</h2>" + body + "<ul><li>One point of it</li><li>Another point</li></ul></div>", [1] * 6), other, foot)
    page(menu, ("<article><h1>A title</h1><p>Short.</p><blockquote>Said so.</blockquote><ul><li>One</li><li>Two</li></ul>"
                "<table><tr><td>1</td><td>2</td></tr></table><pre>x = 1</pre></article>", [1] * 8), foot)
    page(("<h1>A title</h1>" + body, [1] * 4))
    page(menu, ("<h1>A title</h1>" + body, [1] * 4), foot)
    return out


def train(pages: list[str]) -> Field:
    """The field fitted on the hand-made layouts and on pages whose markup labels them."""
    data = []
    for page, gold in examples():
        found = blocks(page)
        if len(found) != len(gold):
            raise ValueError(f"{len(found)} blocks but {len(gold)} labels in {page}")
        data.append((found, gold))
    for page in pages:
        found = blocks(page)
        gold = labelled_by_markup(found) if found else None
        if gold:
            data.append((found, gold))
    whole = [features(found) for found, _ in data]
    bare = [[[*text_features(text, linked), "in=div", "tag=div"] for text, linked, _ in found] for found, _ in data]
    field = Field()
    order = np.random.default_rng(7)
    for epoch in range(EPOCHS):
        for i in order.permutation(len(data)):
            # now and then as if every tag were a div without names, so that text, links and neighbours carry weight too
            field.learn((bare if order.random() < DROP else whole)[i], data[i][1], RATE / (1 + 0.5 * epoch))
    return field


def extract(field: Field, page: str | None) -> str:
    found = blocks(page)
    keep = field.labels(found)
    return "\n".join(b[0] for b, y in zip(found, keep, strict=True) if y)


def fit(pages: DataFrame, count: int = FIT_PAGES) -> Field:
    """Fitted on at most ``count`` pages, those whose ids have the smallest hashes.

    The ids are chosen without the pages and written, so that the pages are then fetched by a table of known size.
    """
    ids = pages.filter("page_id is not null").select("page_id", F.xxhash64("page_id").alias("h")).distinct()
    ids = stage(ids.orderBy("h", "page_id").limit(count).select(F.col("page_id").alias("chosen")))
    found = pages.filter(F.length("html") <= FIT_CHARS).join(ids, F.col("page_id") == F.col("chosen"), "left_semi")
    # an id's first page, should several have it
    return train(sorted(r["html"] for r in found.groupBy("page_id").agg(F.min("html").alias("html")).collect()))


def extracted(pages: DataFrame, field: Field) -> DataFrame:
    """(page_id, url, text) of every page, in one pass without a shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = pa.array([extract(model, h) for h in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    types = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {types['page_id']}, url string, text string")


def report(pages: DataFrame) -> DataFrame:
    return extracted(pages, fit(pages)).withColumn("n_chars", F.length("text").cast("long"))
