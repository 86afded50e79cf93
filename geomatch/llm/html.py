"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read once into leaf blocks: runs of text between block-level tags, in page order, each with the tags, classes and ids of its
ancestors. A block is article text or not; the field scores each block from its ancestors and its text, and each pair of
neighbours from their labels, and Viterbi decoding picks the best labelling of the whole page. Article blocks, joined by two line ends, are the text.

Training. The table has no labels, so pages are composed whose blocks are labelled by construction: ``training_pages`` lays text out in layouts of
many kinds (article, main, div or table cells; menus, headers, footers, sidebars, notices, adverts, forms, reader comments, inside
and outside the article). Their words come from a bounded sample of the table's own pages (``SAMPLE_PAGES``), so text features fit the corpus.
Weights maximise the penalised likelihood of the labels. Training takes a second on the driver, whatever the table's size.

What is read: comments, scripts, styles and other elements without text content are left out; character references are decoded; white space in a block becomes one space.
Tags inside a line, ``<br>`` too, do not end a block. Missing end tags are supplied as browsers do for paragraphs, list items, cells
and at the end of the page.

Defined cases. A null or empty page, or one without article blocks, has empty text and 0 characters. Ties between labellings go to "not article". Very
long pages are decoded whole; memory follows the page. Repeated rows are each extracted; an empty table gives an empty table. Only ``page_id``, ``url`` and
``html`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomatch.llm.common import arrow_map, hashed_sample

SAMPLE_PAGES = 200
TRAINING_PAGES = 600

# Element kinds of the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead title tr ul video audio canvas object".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXTLESS_TAGS = ("script", "style", "noscript", "template", "textarea", "iframe", "noembed", "noframes", "svg", "math", "title", "select", "object", "canvas", "audio", "video")
#: A start tag of the first kind ends an open element of the second kinds, up to the nearest of the third kinds.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_CLOSES_P = BLOCK_TAGS - {"button", "option", "optgroup", "object", "noscript", "video", "audio", "canvas", "iframe"}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+|[^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
_TEXT_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in TEXTLESS_TAGS}


@dataclass(frozen=True)
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int


def _element(tag: str, attributes: str) -> tuple[str, tuple[str, ...]]:
    names: list[str] = []
    if "=" in attributes:
        for _, a, b, c in _NAMES.findall(attributes):
            names += _PARTS.findall(unescape(a or b or c).lower())
    return tag, tuple(dict.fromkeys(names))


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page."""
    html = html or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, tuple(e for e in stack if e[0] in BLOCK_TAGS or e[1]), min(linked, len(text))))
            held.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal links
        links -= sum(1 for e in stack[upto:] if e[0] == "a")
        del stack[upto:]

    def find(kinds: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> int | None:
        lowest = None
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in stops:
                break
            if stack[at][0] in kinds:
                lowest = at
        return lowest

    def say(text: str) -> None:
        nonlocal linked
        if text:
            text = unescape(text)
            held.append(text)
            if links:
                linked += len(text.strip())

    at = 0
    while found := _MARKUP.search(html, at):
        say(html[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag in BLOCK_TAGS:
                flush()
            where = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            # An end tag of a line element does not end the blocks around it.
            if where is not None and (tag in BLOCK_TAGS or not any(e[0] in BLOCK_TAGS for e in stack[where:])):
                close(where)
            continue
        if tag == "br":
            held.append(" ")
        if tag in BLOCK_TAGS:
            flush()
            if tag in _CLOSES_P and (open_p := find({"p"}, BLOCK_TAGS - {"p"})) is not None:
                close(open_p)
            if tag in IMPLIED_ENDS and (open_item := find(*IMPLIED_ENDS[tag])) is not None:
                close(open_item)
        if tag in _TEXT_ENDS and not found[3].endswith("/"):
            end = _TEXT_ENDS[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag not in VOID_TAGS:
            stack.append(_element(tag, found[3]))
            links += tag == "a"
    say(html[at:])
    flush()
    return out


def _path_features(path: tuple[tuple[str, tuple[str, ...]], ...]) -> list[str]:
    tags = [tag for tag, _ in path]
    names = {n for _, own in path for n in own}
    return [f"in:{t}" for t in dict.fromkeys(tags)] + [f"named:{n}" for n in sorted(names)] + [f"leaf:{tags[-1] if tags else ''}"]


def _text_features(block: Block) -> list[str]:
    text, n = block.text, len(block.text)
    share = block.linked / n
    return [
        "bias",
        f"size:{min(int(math.log2(n)), 11)}",
        f"links:{0 if not share else 1 if share < 0.34 else 2 if share < 0.9 else 3}",
        f"ends:{text[-1] in '.!?…'}",
        f"stops:{min(text.count('. ') + text.count('! ') + text.count('? '), 4)}",
        f"commas:{min(text.count(','), 3)}",
        f"rights:{'©' in text or 'copyright' in text.lower()}",
        f"capital:{text[0].isupper()}",
    ]


class Field:
    """Weights of a trained field; positive means article."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray, start: np.ndarray):
        self.weights, self.moves, self.start = weights, moves.tolist(), start.tolist()
        self.paths: dict[tuple, float] = {}

    def _path(self, path: tuple) -> float:
        if path not in self.paths:
            if len(self.paths) > 50_000:
                self.paths.clear()
            self.paths[path] = sum(self.weights.get(f, 0.0) for f in _path_features(path))
        return self.paths[path]

    def label(self, page: list[Block]) -> list[bool]:
        """The best labelling, by Viterbi."""
        if not page:
            return []
        (stay_not, to_article), (to_not, stay_article) = self.moves
        no, yes, back = self.start[0], self.start[1], []
        for i, block in enumerate(page):
            gain = self._path(block.path) + sum(self.weights.get(f, 0.0) for f in _text_features(block))
            if i:
                from_no = (no + stay_not >= yes + to_not, no + to_article >= yes + stay_article)
                no, yes = max(no + stay_not, yes + to_not), max(no + to_article, yes + stay_article)
                back.append(from_no)
            yes += gain
        label = yes > no
        labels = [label]
        for from_no in reversed(back):
            label = not from_no[label]
            labels.append(label)
        return labels[::-1]

    def extract(self, html: str | None) -> str:
        page = blocks(html)
        return "\n\n".join(b.text for b, article in zip(page, self.label(page)) if article)


# Names that sites give to the parts of a page.
_PART_NAMES = {
    "menu": "nav navigation navbar menu mainmenu topnav breadcrumb breadcrumbs pagination toc tabs links".split(),
    "header": "header masthead banner site-header topbar logo branding".split(),
    "footer": "footer site-footer bottom copyright legal colophon".split(),
    "side": "sidebar side aside widget related related-posts recommended popular trending rail more-stories".split(),
    "notice": "cookie cookie-notice cookies consent notice alert banner gdpr privacy message popup modal newsletter".split(),
    "advert": "ad ads advert advertisement adsbox sponsored promo promotion banner-ad sponsor".split(),
    "form": "form search search-form login subscribe signup newsletter contact comment-form".split(),
    "comments": "comments comment comment-list discussion replies responses reader-comments disqus user-comments".split(),
    "article": "content article post entry entry-content post-content article-body story main main-content text body page-content".split(),
}
_PART_TAGS = {
    "menu": ["nav", "nav", "div", "ul"],
    "header": ["header", "header", "div"],
    "footer": ["footer", "footer", "div"],
    "side": ["aside", "aside", "div", "section"],
    "notice": ["div", "div", "section", "aside", "p"],
    "advert": ["div", "div", "aside", "section", "p"],
    "form": ["form", "form", "div"],
    "comments": ["section", "div", "div", "ul"],
    "article": ["article", "article", "main", "div", "section", "td"],
}
_FILLER = "the of and to in that is for on with by this from are was be at it an or der die das und ein eine le la les des et que el los las en un una por con".split()


class _Page:
    """Composes a page and keeps the label of each block."""

    def __init__(self, rng: random.Random, words: list[str]):
        self.rng, self.words = rng, words
        self.html: list[str] = []
        self.labels: list[bool] = []

    def sentence(self, least: int, most: int) -> str:
        said = [self.rng.choice(self.words) for _ in range(self.rng.randint(least, most))]
        for i in range(len(said) - 1):
            if self.rng.random() < 0.06:
                said[i] += ","
        return " ".join(said).capitalize() + self.rng.choice(["."] * 8 + ["!", "?"])

    def prose(self) -> str:
        return " ".join(self.sentence(1, 14) for _ in range(self.rng.choice([1, 1, 2, 3, 5, 9])))

    def title(self) -> str:
        return self.sentence(2, 8).rstrip(".") if self.rng.random() < 0.7 else self.sentence(2, 12)

    def put(self, tag: str, text: str, label: bool, link: bool = False) -> None:
        inner = escape(text)
        if link:
            inner = f'<a href="/{self.rng.randrange(99)}">{inner}</a>'
        elif self.rng.random() < 0.2:
            inner = f"<b>{inner}{'<br>' if self.rng.random() < 0.5 else '</b>'}"
        elif self.rng.random() < 0.1:
            inner = inner.replace(" ", f' <a href="#">{self.rng.choice(self.words)}</a> ', 1)
        self.html.append(f"<{tag}>{inner}" + ("" if tag in ("p", "li") and self.rng.random() < 0.3 else f"</{tag}>"))
        self.labels.append(label)

    def open(self, part: str) -> str:
        tag = self.rng.choice(_PART_TAGS[part])
        named = self.rng.random() < (0.5 if tag in ("nav", "header", "footer", "aside", "form", "article", "main") else 0.97)
        own = self.rng.choice(_PART_NAMES[part])
        self.html.append(f"<{tag}" + (f' {self.rng.choice(["class", "class", "id"])}="{own}"' if named else "") + ">")
        return tag

    def part(self, part: str) -> None:
        if part == "advert" and self.rng.random() < 0.3 or part == "notice" and self.rng.random() < 0.3:
            # Text of the element itself, without a paragraph.
            tag = self.open(part)
            self.html.append(escape(self.prose()) + f"</{tag}>")
            self.labels.append(False)
            return
        tag = self.open(part)
        if tag == "p":
            self.html.append(f"{escape(self.prose())}</p>")
            self.labels.append(False)
            return
        if part == "menu" or part in ("side", "header", "footer") and self.rng.random() < 0.5:
            if tag != "ul":
                self.html.append("<ul>")
            for _ in range(self.rng.randint(2, 7)):
                self.put("li", self.rng.choice(self.words).capitalize() if self.rng.random() < 0.6 else self.title(), False, link=self.rng.random() < 0.9)
            if tag != "ul":
                self.html.append("</ul>")
        elif part == "comments":
            if self.rng.random() < 0.6:
                self.put(self.rng.choice(["h2", "h3"]) if tag != "ul" else "li", self.title(), False)
            for _ in range(self.rng.randint(1, 5)):
                self.put("li" if tag == "ul" else self.rng.choice(["p", "p", "div"]), self.prose(), False)
        elif part == "form":
            for _ in range(self.rng.randint(1, 3)):
                self.put(self.rng.choice(["p", "div"]), self.title() if self.rng.random() < 0.7 else self.prose(), False)
            self.html.append('<input name="q"><select><option>a<option>b</select>')
            self.put("button", self.rng.choice(self.words), False)
        elif part == "footer":
            self.put("p", f"© {self.rng.choice(self.words)}.example · {self.prose()}", False)
        else:
            for _ in range(self.rng.randint(1, 3)):
                self.put(self.rng.choice(["p", "p", "div", "h3"]), self.prose() if part != "header" else self.title(), False, link=self.rng.random() < 0.3)
        self.html.append(f"</{tag}>")

    def compose(self) -> None:
        rng, odds = self.rng, self.rng.random()
        self.html.append("<!DOCTYPE html><html><head><title>x</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
        before = [p for p in ("header", "menu", "notice", "advert", "side", "form") if rng.random() < (0.3 if odds < 0.5 else 0.7)]
        rng.shuffle(before)
        for part in before:
            self.part(part)
        tag = self.open("article")
        if rng.random() < 0.85:
            self.put("h1", self.title(), True)
        for _ in range(rng.choice([1, 2, 4, 8, 14])):
            if rng.random() < 0.08:
                self.part(rng.choice(["advert", "notice", "side", "form", "menu"]))
            self.put(rng.choice(["p"] * 9 + ["h2", "h3", "blockquote", "li", "pre"]), self.title() if rng.random() < 0.1 else self.prose(), True)
        if rng.random() < 0.2:
            self.part(rng.choice(["comments", "side", "menu", "advert", "footer"]))
        self.html.append(f"</{tag}>")
        after = [p for p in ("comments", "side", "advert", "form", "notice", "menu", "footer") if rng.random() < (0.3 if odds < 0.5 else 0.6)]
        for part in after:
            self.part(part)
        self.html.append("</body></html>" if rng.random() < 0.9 else "")


def training_pages(words: list[str], n: int = TRAINING_PAGES, seed: int = 7) -> Iterator[tuple[str, list[bool]]]:
    """Pages and the labels of their blocks."""
    rng = random.Random(seed)
    words = words or _FILLER
    made = 0
    while made < n:
        page = _Page(rng, words)
        page.compose()
        html = "".join(page.html)
        made += 1
        if len(blocks(html)) == len(page.labels):
            yield html, page.labels


def fit(pages: list[tuple[str, list[bool]]], rounds: int = 250, penalty: float = 0.02) -> Field:
    """Maximum penalised likelihood by gradient steps with momentum (Adam), over all pages at once."""
    parsed = [(blocks(html), labels) for html, labels in pages]
    parsed = [(p, y) for p, y in parsed if p]
    names = sorted({f for page, _ in parsed for b in page for f in _path_features(b.path) + _text_features(b)})
    number = {f: i for i, f in enumerate(names)}
    longest = max(len(p) for p, _ in parsed)
    x = np.zeros((len(parsed), longest, len(names)), dtype=np.float32)
    y = np.zeros((len(parsed), longest), dtype=int)
    there = np.zeros((len(parsed), longest), dtype=bool)
    for i, (page, labels) in enumerate(parsed):
        for j, b in enumerate(page):
            x[i, j, [number[f] for f in _path_features(b.path) + _text_features(b)]] = 1
        y[i, : len(page)], there[i, : len(page)] = labels, True
    flat = x.reshape(-1, len(names))
    theta = np.zeros(len(names) + 6)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    rows = np.arange(len(parsed))
    both = there[:, 1:]
    true_moves = np.zeros((2, 2))
    np.add.at(true_moves, (y[:, :-1][both], y[:, 1:][both]), 1)
    for step in range(1, rounds + 1):
        weights, moves, start = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        score = np.zeros((len(parsed), longest, 2))
        score[:, :, 1] = (flat @ weights.astype(np.float32)).reshape(len(parsed), longest)
        forward = np.zeros_like(score)
        forward[:, 0] = start + score[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(forward[:, t - 1, :1] + moves[0], forward[:, t - 1, 1:] + moves[1]) + score[:, t]
            forward[:, t] = np.where(there[:, t, None], new, forward[:, t - 1])
        whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        backward = np.zeros_like(score)
        expected = np.zeros((2, 2))
        for t in range(longest - 1, 0, -1):
            ahead = score[:, t] + backward[:, t]
            joint = forward[:, t - 1, :, None] + moves + ahead[:, None, :] - whole[:, None, None]
            expected += np.exp(joint[there[:, t]]).sum(axis=0)
            new = np.stack([np.logaddexp(moves[a, 0] + ahead[:, 0], moves[a, 1] + ahead[:, 1]) for a in (0, 1)], axis=1)
            backward[:, t - 1] = np.where(there[:, t, None], new, backward[:, t])
        article = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole[:, None])
        miss = np.where(there, y - article, 0)
        first = np.exp(forward[:, 0] + backward[:, 0] - whole[:, None])
        true_first = np.stack([(y[rows, 0] == a) for a in (0, 1)], axis=1)
        gradient = np.concatenate([miss.ravel().astype(np.float32) @ flat, (true_moves - expected).ravel(), (true_first - first).sum(axis=0)])
        gradient = gradient / len(parsed) - penalty / 10 * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta = theta + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Field(dict(zip(names, theta[:-6].tolist())), theta[-6:-2].reshape(2, 2), theta[-2:])


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, n: int = TRAINING_PAGES) -> Field:
    """Fit a field on composed pages with words of at most ``sample_pages`` pages of the table, of each its first 20,000 characters."""
    ids = pages.select(F.col("page_id").cast("long").alias("doc_id")).filter("doc_id is not null")
    sample = F.broadcast(hashed_sample(ids, [], sample_pages).distinct())
    rows = pages.select(F.col("page_id").cast("long").alias("doc_id"), F.substring("html", 1, 20_000).alias("html")).join(sample, "doc_id", "left_semi")
    words = sorted({w for row in rows.select("html").limit(sample_pages).collect() for b in blocks(row.html) for w in b.text.split() if not w.startswith("©")})
    return fit(list(training_pages(random.Random(7).sample(words, min(len(words), 5000)), n)))


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    held = pages.sparkSession.sparkContext.broadcast(field or train(pages))

    def make():
        own = held.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [own.extract(h) for h in batch["html"].to_pylist()]
            return pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

        return work

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return arrow_map(rows, make, "page_id long, url string, text string, n_chars long")
