"""Main text of web pages as the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags.  Tags score negative; the words of a block score by
its features: the elements and the classes they stand in, the kind and length of the block,
how much of it is links, whether it stands in the element that directly holds most of the
page's prose, whether it comes before the first heading, and which words it holds: a long block
is judged by all of its words, as the mean of its stretches.  All weights are log-odds counted
on labelled pages, ``LABELLED`` unless others are given; no name of a class and no element is
given a meaning otherwise, and no single feature decides.
One linear scan finds the contiguous region with the greatest sum; blocks at its ends that
score well, but are too short to pay for their tags, are added.  Its words are the text,
block by block, without blocks that score below DROP: insets.

Defined results: null or empty html gives an empty text; a page whose best region has no
positive sum gives an empty text; unclosed and misnested elements are closed where their
parent ends; a tag without an end runs to the page's end; extra columns are ignored;
repeated rows give repeated results; long pages are read whole, and time is in proportion
to their length, however deep they nest.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import long_id, read_table

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)()[^>]*>?""", re.S)
_HINT = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
#: Elements whose content is not text; a page's words are never found there.
OPAQUE = frozenset("script style noscript template textarea select option iframe object svg math head title".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
#: Elements that a new one of the same kind ends.
SIBLINGS = frozenset("p li dt dd tr td th option".split())
#: Most that one feature of a kind tells; the score below which a block in the region is an inset.
LIMITS = {".": 2.0, "word": 1.0, "size": 0.5}
DROP, LIMIT = -0.5, 2.0
#: Most words of a stretch: any text that is long enough holds the common words of both sides.
STRETCH = 200
#: Most that a class tells for main text: authors name what stands around it more alike than the text itself.
LIKED = 0.5

#: Labelled pages: the main text stands between the two marks.
START, END = "⟦", "⟧"
LABELLED = (
    f"""<html><head><title>A walk</title><style>p{{}}</style></head><body><header><div class="logo">River News</div>
<nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li></ul></nav></header>
<div class="ad">Buy two lamps today</div><article>{START}<h1>A walk by the river</h1><p>We set out early and the path was wet after rain.</p>
<p>Nobody else was about, <b>not even</b> the dog.<br>It was quiet.</p><p>Yes.</p>{END}</article>
<aside class="sidebar"><p>Most read stories of this week</p></aside><footer>&copy; River News. All rights kept.</footer></body></html>""",
    f"""<html><body><div id="cookie" class="notice banner">This site uses cookies to work.</div><div class="breadcrumb"><a>Home</a> <a>Tips</a></div>
<main>{START}<h2>How to sharpen a knife</h2><p>Wet the stone first. Hold the blade at a low angle and draw it towards you.</p><ul><li>Coarse side</li><li>Fine side</li></ul>
<blockquote>Slow is smooth.</blockquote><p>Wipe it dry.</p>{END}</main><form class="newsletter"><label>Mail</label><button>Send me news</button></form>
<section id="comments" class="comments"><div class="comment"><p>Great tips, thank you, worked for me</p></div></section>
<div class="related"><a href="/x">More on kitchens</a></div><footer class="footer"><p>Imprint and contact</p></footer></body></html>""",
    f"""<body><div class="header"><span>Town Gazette</span></div><div class="nav"><a>News</a> <a>Local</a></div><div class="content">{START}<h1>Bridge opens</h1>
<p>The new bridge opened on Monday after two years of work by a local firm.</p><h3>Costs</h3><p>It cost less than planned, the mayor said, and <i>traffic</i> now flows.</p>
<table><tr><td>Length</td><td>120 metres</td></tr></table><p>A second one is planned.</p>{END}</div><div class="advert promo">Sale ends soon, hurry now</div>
<div class="share"><a>Share</a><a>Print</a></div><div class="sidebar widget"><ul><li><a>Weather</a></li><li><a>Jobs</a></li></ul></div></body>""",
    f"""<body><div id="top"><a>Log in</a> <a>Help</a></div><div role="navigation"><a>Start</a> <a>Plants</a> <a>Animals</a></div>
<article class="post">{START}<header><h1>On moss</h1></header><p>Moss grows where it is damp, on stone, bark and soil.</p><p>It has no roots and takes in water through its leaves.</p><p>Some kinds live for ten years.</p>{END}
<div class="share">Tell your friends</div><form class="signup"><p>Get our weekly letter by mail</p><button>Subscribe</button></form><section class="comments"><h3>Comments</h3><div><b>Ann</b><p>First! I love moss a lot.</p><a>Reply</a></div><div><b>Bo</b><p>Thanks for this article, great read.</p><a>Reply</a></div></section></article>
<div class="trending"><h4>Trending</h4><ul><li><a href="/1">Ten ferns you must see</a></li><li><a href="/2">Why bees matter</a></li></ul></div><div class="legal">© All rights reserved. Privacy. Imprint.</div></body>""",
    f"""<body><div class="a1"><a href="/">Harbour Times</a><a href="/n">News</a><a href="/m">Markets</a></div><div class="b7"><div class="c2">{START}<h1>Ferry line to close</h1><p>The ferry between the two towns will stop in spring, the owner said on Friday.</p>
<p>Fewer people use it each year, and the boat is old.</p><pre>2019 41000
2023 12500</pre><p>Buses will run instead. A ticket will cost the same as now.</p><ul><li>First bus at six</li><li>Last bus at eleven</li></ul><p>The town council meets next week to talk about the pier.</p>{END}</div></div>
<div class="d9"><h3>What readers say</h3><div><i>Kim, 2 hours ago</i><p>I will miss the ferry so much, sad news.</p></div><div><i>Lee, 3 hours ago</i><p>Agree with you, thank you for writing.</p></div></div><div class="e4"><p>© 2021 Harbour Times. All rights reserved. Terms. Privacy. Contact us.</p></div></body>""",
    f"""<body><nav><a>Home</a><a>Recipes</a></nav><main>{START}<article><h1>Bread in a pot</h1><p>Mix flour, water, salt and very little yeast, and leave the dough alone for a night.</p><p>Heat the pot before the dough goes in.</p></article><article><h2>What the crust tells</h2><p>A pale crust means the oven was too cool, or the lid stayed on for too long a time.</p><p>Knock on the base: it should sound hollow.</p></article>{END}</main>
<section class="more"><h2>More recipes</h2><article class="card"><h3><a href="/r">Rye rolls</a></h3><p>Ready in an hour</p></article><article class="card"><h3><a href="/s">Flat bread</a></h3><p>No yeast needed</p></article></section><footer><p>Write to us. All rights kept.</p></footer></body>""",
    f"""<body><header><h1>Hill Walkers' Club</h1><p>Walks for all since 1970</p></header><div class="content">{START}<h2>Route nine</h2><p>Start at the station and follow the stream up to the old mill, about two miles.</p><div class="box"><p>Take water with you: there is none on the ridge in summer.</p></div><p>From the ridge the sea is in sight on clear days.</p><table><tr><td>Climb</td><td>420 metres</td></tr></table>{END}<div class="newsletter"><p>Sign up now for our newsletter</p></div><aside>More walks near you this week</aside></div>
<div class="ad"><p>Boots on sale now, buy today</p></div><div class="related"><p>You may also like</p><a>Route ten</a><a>Route two</a></div><div class="cookie">We use cookies. <button>Accept</button></div><footer>Copyright Hill Walkers' Club</footer></body>""",
)


@dataclass
class Run:
    """Words of one stretch of text, or a tag (``words`` empty), in an element of the page."""

    words: list[str]
    tag: str
    node: int
    block: int
    marks: tuple[bool, bool] = (False, False)  # whether space stands before and after


@dataclass
class Page:
    """Runs in order, and elements: their parent, name and classes; element 0 holds all."""

    runs: list[Run] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [-1])
    names: list[str] = field(default_factory=lambda: [""])
    classes: list[tuple[str, ...]] = field(default_factory=lambda: [()])


class _Open:
    """Open elements as a stack that knows the last place of each name and of each block."""

    def __init__(self) -> None:
        self.nodes: list[int] = [0]
        self.names: list[str] = [""]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of elements that are not inline
        self.walls: list[int] = []  # of those that no list item or paragraph ends across
        self.hidden = 0

    def push(self, node: int, name: str) -> None:
        place = len(self.nodes)
        self.nodes.append(node)
        self.names.append(name)
        self.places.setdefault(name, []).append(place)
        if name not in INLINE:
            self.blocks.append(place)
            if name not in SIBLINGS:
                self.walls.append(place)
        self.hidden += name in OPAQUE

    def last(self, name: str) -> int:
        found = self.places.get(name)
        return found[-1] if found else -1

    def cut(self, place: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.nodes) > place:
            name = self.names.pop()
            self.nodes.pop()
            self.places[name].pop()
            for marks in (self.blocks, self.walls):
                if marks and marks[-1] == len(self.nodes):
                    marks.pop()
            self.hidden -= name in OPAQUE


def scan(html: str) -> Page:
    """A page's runs in order; text in opaque elements and comments is left out."""
    page, open_ = Page(), _Open()
    runs = page.runs
    block = at = 0

    def text(piece: str) -> None:
        words = entities.unescape(piece).split()
        if words and not open_.hidden:
            # a word cut by an inline tag goes on in the next run: spaces at the edges tell
            runs.append(Run(words, "", open_.nodes[-1], block, (piece[:1].isspace(), piece[-1:].isspace())))
        elif piece and runs and piece.isspace():
            runs.append(Run([], " ", open_.nodes[-1], block))

    end = len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        closing, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], "")
        if not name:
            continue
        name = name.lower()
        if name not in INLINE:
            block += 1
        if closing:
            runs.append(Run([], name, open_.nodes[-1], block))
            if (place := open_.last(name)) > 0:
                open_.cut(place)
            continue
        if name in SIBLINGS:
            if (place := open_.last(name)) > (open_.walls[-1] if open_.walls else -1):
                open_.cut(place)
        elif name not in INLINE and open_.blocks and open_.last("p") == open_.blocks[-1]:
            open_.cut(open_.blocks[-1])  # a block ends an open paragraph
        node = len(page.names)
        page.parents.append(open_.nodes[-1])
        page.names.append(name)
        page.classes.append(tuple(dict.fromkeys(w for h in _HINT.findall(attrs or "") for v in h if v for w in _NAME.findall(v.lower()))))
        runs.append(Run([], name, node, block))
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(f"</{name}\\s*>", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if not (attrs or "").rstrip().endswith("/"):
            open_.push(node, name)
    return page


@dataclass
class Block:
    """What one block of text is judged by."""

    node: int
    words: int = 0
    linked: int = 0
    text: list[str] = field(default_factory=list)
    headed: str = "no"  # after the first heading of the page, before it, or "none" on a page without
    place: str = "?"  # direct or deeper in the element that directly holds most prose, or outside it

    def features(self, kind: str) -> tuple[str, ...]:
        size = "1" if self.words < 4 else "2" if self.words < 10 else "3" if self.words < 25 else "4"
        links = "none" if not self.linked else "most" if 2 * self.linked >= self.words else "some"
        return f"kind {kind}", f"size {size}", f"links {links}", f"headed {self.headed}", f"place {self.place}"


_LETTERS = re.compile(r"[^\W\d_]+")


def blocks_of(page: Page) -> dict[int, Block]:
    """Blocks of text by number, with their figures but for their place; each element is looked at once."""
    linked = [False]
    for name, up in zip(page.names[1:], page.parents[1:], strict=True):
        linked.append(linked[up] or name == "a")
    found: dict[int, Block] = {}
    headed = "before" if any(n in ("h1", "h2") for n in page.names) else "none"
    for run in page.runs:
        headed = "after" if run.tag in ("h1", "h2") else headed
        if run.words:
            block = found.setdefault(run.block, Block(run.node, headed=headed))
            block.words += len(run.words)
            block.linked += len(run.words) if linked[run.node] else 0
            block.text += run.words
    return found


def set_places(page: Page, blocks: dict[int, Block], counted: Callable[[int], bool]) -> None:
    """Find the element that directly holds most words of the blocks that count, half for the element around it, and place all blocks by it."""
    container = [0]
    for name, up in zip(page.names[1:], page.parents[1:], strict=True):
        node = len(container)
        container.append(container[up] if name in INLINE or name in SIBLINGS or name in _HEADS else node)
    prose: dict[int, float] = {}
    for number, block in blocks.items():
        if counted(number):
            home = container[block.node]
            prose[home] = prose.get(home, 0.0) + block.words - block.linked
            if (up := page.parents[home]) > 0:
                prose[up] = prose.get(up, 0.0) + (block.words - block.linked) / 2
    centre = max(prose, key=lambda k: (prose[k], -k), default=-1)
    inside = [centre == 0]
    for node, up in enumerate(page.parents[1:], 1):
        inside.append(node == centre or inside[up])
    for block in blocks.values():
        block.place = "direct" if container[block.node] == centre else "deeper" if inside[block.node] else "outside"


_HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def around(page: Page) -> list[tuple[str, ...]]:
    """For each element the features of standing in it; of paragraphs and the like the kind of the block tells already.

    A header or footer is the page's or that of an article.
    """
    out: list[tuple[str, ...]] = [()]
    within = [False]
    for name, up, classes in zip(page.names[1:], page.parents[1:], page.classes[1:], strict=True):
        own = () if name in SIBLINGS or name in _HEADS else (f"in {name} of article",) if within[up] and name in ("header", "footer") else (f"in {name}",)
        out.append((*own, *(f".{c}" for c in classes)))
        within.append(within[up] or name in ("article", "main"))
    return out


def kind_of(page: Page, node: int) -> str:
    """The element a block is: its nearest one that is not inline."""
    while node > 0 and page.names[node] in INLINE:
        node = page.parents[node]
    name = page.names[node]
    return "title" if name in ("h1", "h2") else "heading" if name in _HEADS else name


@dataclass(frozen=True)
class Weights:
    features: dict[str, float]
    tags: dict[str, float]
    tag_default: float

    def nodes(self, page: Page) -> list[float]:
        """What an element and those around it tell, each name and class once."""
        out, seen = [0.0], [frozenset()]
        known = self.features
        for up, own in zip(page.parents[1:], around(page)[1:], strict=True):
            new = [f for f in own if f in known and f not in seen[up]]
            out.append(out[up] + sum(known[f] for f in new))
            seen.append(seen[up] | frozenset(new) if new else seen[up])  # shared: known features are few
        return out

    def words(self, text: list[str]) -> float:
        """What the words of a whole block tell: the mean over equal stretches, in each of which a word counts once."""
        n, total = -(-len(text) // STRETCH), 0.0
        for k in range(n):
            first, end = k * len(text) // n, (k + 1) * len(text) // n
            told = [self.features[w] for w in {f"word {x}" for t in text[first:end] for x in _LETTERS.findall(t.lower())} if w in self.features]
            total += (end - first) / len(text) * (sum(told) / math.sqrt(len(told)) if told else 0.0)
        return total

    def blocks(self, page: Page) -> tuple[dict[int, float], set[int]]:
        """The score of a word of each block, and the blocks that are insets of the element that holds most prose."""
        above, blocks, sums = self.nodes(page), blocks_of(page), {}
        for number, block in blocks.items():
            fixed = sum(self.features.get(f, 0.0) for f in block.features(kind_of(page, block.node)))
            sums[number] = above[block.node] + fixed + self.words(block.text)
        set_places(page, blocks, lambda number: sums[number] > 0)
        worth = {n: max(-LIMIT, min(LIMIT, x + self.features.get(f"place {blocks[n].place}", 0.0))) for n, x in sums.items()}
        return worth, {n for n, x in worth.items() if x < DROP and blocks[n].place != "outside"}


def learn(pages: tuple[str, ...] = LABELLED) -> Weights:
    """Log-odds of features, inside against outside the marked text, and of tags by the words and tags inside."""
    counts = [Counter(), Counter()]
    totals = [0, 0]
    tags = [Counter(), Counter()]
    for marked in pages:
        page = scan(marked.replace(START, "<i-start></i-start>").replace(END, "<i-end></i-end>"))
        real = [n for n in range(len(page.names)) if page.names[n].startswith("i-")]
        inside, labels = 0, {}
        for run in page.runs:
            if run.node in real or run.tag.startswith("i-"):
                inside = {"i-start": 1, "i-end": 0}.get(page.names[run.node], inside)
            elif run.words:
                labels[run.block] = inside
            elif run.tag != " ":
                tags[inside][run.tag] += 1
        blocks = blocks_of(page)
        set_places(page, blocks, lambda number: bool(labels[number]))  # noqa: B023
        standing = around(page)
        for number, block in blocks.items():
            side = labels[number]
            told = set(block.features(kind_of(page, block.node)))
            node = block.node
            while node > 0:
                told |= set(standing[node])
                node = page.parents[node]
            told |= {f"word {w}" for t in block.text for w in _LETTERS.findall(t.lower())}
            counts[side].update(told)
            totals[side] += 1
    odds = {}
    for f in {*counts[0], *counts[1]}:
        value = math.log((counts[1][f] + 0.1) / (totals[1] + 0.2)) - math.log((counts[0][f] + 0.1) / (totals[0] + 0.2))
        limit = LIMITS.get("." if f[0] == "." else f.split()[0], LIMIT)
        odds[f] = max(-limit, min(LIKED if f[0] == "." else limit, value))
    odds |= {f: v / 2 for f, v in odds.items() if f in ("in html", "in body", "in div")}
    # a tag costs more the less often it stands inside, an inline one that is no link little
    cost = {t: -min(0.25 if t in INLINE and t != "a" else 1.5, max(0.25, (tags[0][t] + 0.5) / (tags[1][t] + 0.5))) for t in {*tags[0], *tags[1]}}
    return Weights(odds, cost, -1.0)


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end index of the contiguous part with the greatest positive sum; empty if there is none."""
    best = total = 0.0
    first = 0
    found = (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += s
        if total > best:
            best, found = total, (first, i + 1)
    return found


def widened(runs: list[Run], worth: dict[int, float], insets: set[int], first: int, end: int) -> tuple[int, int]:
    """The region with the blocks next to it, insets aside, whose words score half the limit or more: too short to pay for their tags."""
    for k in range(end, len(runs)):
        r = runs[k]
        if r.words and r.block not in insets:
            if worth[r.block] < LIMIT / 2:
                break
            end = k + 1
    for k in range(first - 1, -1, -1):
        r = runs[k]
        if r.words and r.block not in insets:
            if worth[r.block] < LIMIT / 2:
                break
            first = k
    return first, end


def main_text(html: str | None, weights: Weights) -> str:
    if not html:
        return ""
    page = scan(html)
    worth, insets = weights.blocks(page)
    scores, skipped = [], False
    for r in page.runs:  # an inset is left out anyway: neither its words nor its tags part the text around it
        if r.words:
            skipped = r.block in insets
        cost = 0.0 if skipped or r.tag == " " else weights.tags.get(r.tag, weights.tag_default)
        scores.append(cost if not r.words else 0.0 if skipped else worth[r.block] * len(r.words))
    first, end = best_region(scores)
    if first < end:
        first, end = widened(page.runs, worth, insets, first, end)
    blocks: dict[int, list[str]] = {}
    gap = True
    last = -1
    for r in page.runs[first:end]:
        if not r.words:
            gap = gap or r.tag in (" ", "br")
            continue
        if worth[r.block] < DROP:
            gap = True
            continue
        parts = blocks.setdefault(r.block, [])
        words = list(r.words)
        if parts and last == r.block and not gap and not r.marks[0]:
            parts[-1] += words.pop(0)
        parts += words
        gap, last = r.marks[1], r.block
    return "\n\n".join(" ".join(p) for p in blocks.values() if p)


def extract(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: tuple[str, ...] = LABELLED) -> DataFrame:
    """``id_col``, ``url_col``, ``text`` of each page.  No shuffle; one page at a time."""
    weights = learn(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, url_col, "text"])

    rows = df.select(long_id(id_col), F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string").alias(html_col))
    return rows.mapInArrow(run, f"{id_col} long, {url_col} string, text string")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
