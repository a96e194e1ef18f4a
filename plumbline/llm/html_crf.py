"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A block is described by the tags around it, the words of their class, id and role,
and its text (length, links, marks, place on the page). A block's label - main text
or not - depends on its features and on the label before it; weights are trained
with numpy by forward and backward sums, labels are decoded by Viterbi.

Training pages are labelled pages made of a bounded sample of the supplied ones: an
article in a page's own layout labels its blocks, and the same blocks are set in
layouts with other names and with menus, notices, side columns, forms, adverts and
comments, whose labels are known by making.

Defined results: a null, empty or textless page has an empty text and n_chars 0;
every row is extracted, repeated or not; an empty table gives no rows; other columns
are not looked at. Pages longer than ``LEARNED_CHARS`` are extracted but not
learned from.
"""

from __future__ import annotations

import random
import re
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_batches
from plumbline.llm.html_blocks import Block, leaf_blocks

# Bounds of what is learned from.
LEARNED_PAGES, LEARNED_CHARS = 300, 200_000
# Made pages: three for each learned page, and no fewer in all than this.
MADE_PAGES = 900
STEPS = 200

# ---- features ---------------------------------------------------------------------------------

# Names under which layouts keep their parts, and phrases of those parts.
MAIN = "content article post entry story main body text page-content article-body post-content entry-content news-item".split()
ASIDE = {
    "menu": "menu navigation navbar nav main-menu topnav breadcrumb breadcrumbs site-nav tabs toc".split(),
    "header": "header masthead site-header topbar banner branding logo".split(),
    "footer": "footer site-footer bottom colophon copyright legal page-footer".split(),
    "sidebar": "sidebar side aside widget related recommended popular trending rail secondary more-stories tags".split(),
    "notice": "cookie cookie-notice consent notice alert gdpr privacy-banner popup modal overlay message paywall".split(),
    "advert": "ad ads advert advertisement sponsored promo banner-ad sponsor promotion adslot".split(),
    "form": "form search newsletter subscribe signup login contact-form search-box".split(),
    "comments": "comments comment comment-list discussion replies responses disqus reader-comments respond".split(),
    "share": "share social sharing share-buttons follow toolbar byline meta author-box".split(),
}
PHRASES = {
    "menu": "Home|News|About|Contact|Products|Sign in|Blog|Archive|Sport|Help|Next|Previous|Skip to content",
    "header": "Daily news|The site|Welcome|Your account|Menu|Search|Subscribe now",
    "footer": "© 2024 All rights reserved|Privacy policy|Terms of use|Imprint|Contact us|Powered by|Sitemap|Cookie settings",
    "sidebar": "Related articles|Most read|You may also like|Popular posts|Tags|Categories|Recent posts|More from this author|See also",
    "notice": "We use cookies to improve your experience.|Accept all|Reject|By using this site you agree to our policy.|"
    "You have read your free articles.|Please enable JavaScript.|This site uses cookies. Manage your settings.",
    "advert": "Advertisement|Buy now and save!|Sponsored content|Limited offer: order today.|Click here|Free shipping on all orders",
    "form": "Email address|Your name|Subscribe to our newsletter|Send|Search this site|Password|Leave a reply",
    "comments": "Comments (12)|Great article, thanks!|I do not agree with this.|Reply|Posted by|Report|Nice read, thank you for sharing.|"
    "Log in to comment|Anonymous wrote:",
    "share": "Share on social media|Tweet|Share this|Print|By the editors|5 min read|Follow us",
}
PHRASE_WORDS = frozenset(re.findall(r"[^\W\d_]+", " ".join(PHRASES.values()).lower()))

_BINS = (10, 25, 60, 120, 250)


def block_features(blocks: list[Block], k: int) -> list[str]:
    b = blocks[k]
    size = sum(len(b.text) >= x for x in _BINS)
    link = 0 if not b.linked else 1 if b.linked < 0.3 else 2 if b.linked < 0.8 else 3
    words = re.findall(r"[^\W\d_]+", b.text[:400].lower())
    out = ["always", f"tag {b.tag}", f"size {size}", f"link {link}", f"size {size} link {link}", f"tag {b.tag} link {link}"]
    out += [f"in {t}" for t in set(b.tags)]
    out.append(f"below {b.tags[-2] if len(b.tags) > 1 else ''} {b.tag}")
    out += [f"name {n}" for n in b.names]
    out.append("sentence" if b.text[-1] in ".!?\"”»" else "no sentence")
    out.append("comma" if "," in b.text else "no comma")
    if "©" in b.text:
        out.append("copyright")
    if size < 4:
        out += [f"word {w}" for w in PHRASE_WORDS.intersection(words)]
    out.append("first" if k == 0 else "last" if k == len(blocks) - 1 else "inside")
    return out


# ---- the field --------------------------------------------------------------------------------


class Field:
    """Two labels; weights per feature, per pair of neighbours, for the first and the last block."""

    def __init__(self, names: list[str]):
        self.number = {n: k for k, n in enumerate(names)}
        self.unary = np.zeros((len(names), 2))
        self.step = np.zeros((2, 2))
        self.ends = np.zeros((2, 2))  # first, last

    def indices(self, blocks: list[Block]) -> list[list[int]]:
        number = self.number
        return [[number[f] for f in block_features(blocks, k) if f in number] for k in range(len(blocks))]

    def _weights(self):
        return [self.unary, self.step, self.ends]

    def _scores(self, rows: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((i for r in rows for i in r), dtype=np.int64)
        starts = np.cumsum([0, *map(len, rows)])[:-1]
        return np.add.reduceat(self.unary[flat], starts, axis=0)

    def fit(self, pages: list[list[list[int]]], labels: list[np.ndarray], steps: int = STEPS, ridge: float = 0.05) -> None:
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        pages, labels = [pages[k] for k in order], [labels[k] for k in order]
        rows = [r for p in pages for r in p]
        y = np.concatenate(labels)
        flat = np.fromiter((i for r in rows for i in r), dtype=np.int64)
        owner = np.repeat(np.arange(len(rows)), list(map(len, rows)))
        sizes = list(map(len, pages))
        groups = _of_like_size(sizes)
        starts = np.cumsum([0, *sizes])
        observed = [np.zeros_like(w) for w in self._weights()]
        np.add.at(observed[0], (flat, y[owner]), 1)
        for k, label in enumerate(labels):
            np.add.at(observed[1], (label[:-1], label[1:]), 1)
            observed[2][0, label[0]] += 1
            observed[2][1, label[-1]] += 1
        mean, square = [np.zeros_like(w) for w in self._weights()], [np.zeros_like(w) for w in self._weights()]
        for t in range(1, steps + 1):
            scores = self._scores(rows)
            node, pair, ends = np.zeros_like(scores), np.zeros((2, 2)), np.zeros((2, 2))
            for group in groups:
                length = max(sizes[k] for k in group)
                padded = np.zeros((len(group), length, 2))
                at = np.array([sizes[k] for k in group])
                inside = np.arange(length) < at[:, None]
                index = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in group])
                padded[inside] = scores[index]
                of_node, of_pair = self._marginals(padded, at)
                node[index] = of_node[inside]
                pair += of_pair
                ends[0] += of_node[:, 0].sum(axis=0)
                ends[1] += of_node[np.arange(len(group)), at - 1].sum(axis=0)
            of_flat = node[owner]
            expected = np.stack([np.bincount(flat, of_flat[:, c], len(self.unary)) for c in (0, 1)], axis=1)
            for w, o, e, m, v in zip(self._weights(), observed, (expected, pair, ends), mean, square):
                g = (e - o) / len(pages) + ridge * w / len(pages)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)

    def _marginals(self, scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of labels and expected counts of neighbours, for pages padded to one length."""
        n, length, _ = scores.shape
        rows, last = np.arange(n), sizes - 1
        scores = scores.copy()
        scores[:, 0] += self.ends[0]
        scores[rows, last] += self.ends[1]
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, length):
            ahead[:, t] = scores[:, t] + _logsum(ahead[:, t - 1, :, None] + self.step, 1)
        for t in range(length - 2, -1, -1):
            on = _logsum(self.step + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where((t < last)[:, None], on, 0)
        total = _logsum(ahead[rows, last], 1)
        node = np.exp(ahead + behind - total[:, None, None])
        pair = np.exp(
            ahead[:, :-1, :, None] + self.step + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        )
        return node, pair[np.arange(length - 1) < last[:, None]].sum(axis=0)

    def decode(self, pages: list[list[list[int]]]) -> list[np.ndarray]:
        """Best labels of each page, by Viterbi, pages of like length together."""
        sizes = list(map(len, pages))
        out: list[np.ndarray] = [np.zeros(0, dtype=int)] * len(pages)
        some = sorted((k for k in range(len(pages)) if sizes[k]), key=sizes.__getitem__)
        for group in _of_like_size([sizes[k] for k in some]):
            group = [some[k] for k in group]
            at, length = np.array([sizes[k] for k in group]), max(sizes[k] for k in group)
            scores = np.zeros((len(group), length, 2))
            scores[np.arange(length) < at[:, None]] = self._scores([r for k in group for r in pages[k]])
            rows, last = np.arange(len(group)), at - 1
            scores[:, 0] += self.ends[0]
            scores[rows, last] += self.ends[1]
            best, came = scores[:, 0], np.zeros((len(group), length, 2), dtype=np.int8)
            ends = best.copy()
            for t in range(1, length):
                each = best[:, :, None] + self.step
                came[:, t] = each.argmax(axis=1)
                best = scores[:, t] + each.max(axis=1)
                ends = np.where((t == last)[:, None], best, ends)
            label = np.zeros((len(group), length), dtype=int)
            now = ends.argmax(axis=1)
            for t in range(length - 1, -1, -1):
                now = np.where(t == last, ends.argmax(axis=1), now)
                label[:, t] = now
                now = came[rows, t, now]
            for k, row, size in zip(group, label, at):
                out[k] = row[:size]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.squeeze(most, axis) + np.log(np.exp(x - most).sum(axis=axis))


def _of_like_size(sizes: list[int], cells: int = 200_000) -> list[list[int]]:
    """Runs of pages (given in order of size) that fill a bounded table."""
    groups, group = [], []
    for k, size in enumerate(sizes):
        if group and size * (len(group) + 1) > cells or group and size > 2 * sizes[group[0]] + 4:
            groups.append(group)
            group = []
        group.append(k)
    return groups + [group] if group else groups


# ---- labelled pages ---------------------------------------------------------------------------

ELEMENTS = {
    "menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"),
    "notice": ("div", "section", "dialog"), "advert": ("div", "aside", "section"), "form": ("form",),
    "comments": ("section", "div", "ol"), "share": ("div", "ul", "p"),
}


# Stands before main text while a made page is read; no page is expected to use it.
MARK = "\ue0ff"


def _attributes(name: str, draw: random.Random) -> str:
    return draw.choice((f' class="{name}"', f' id="{name}"', f' class="{name} box-{draw.randint(1, 9)}"', ""))


def part(kind: str, lines: list[str], draw: random.Random) -> str:
    """A part of a page that is not main text; comments, notices and adverts may quote any ``lines``."""
    element = draw.choice(ELEMENTS[kind])
    own = [draw.choice(PHRASES[kind].split("|")) for _ in range(draw.randint(1, 4))]
    if kind in ("comments", "sidebar", "notice", "advert", "footer") and lines:
        own += draw.choices(lines, k=draw.randint(0, 3))
    draw.shuffle(own)
    own = [escape(x, quote=False) for x in own]
    if kind in ("menu", "sidebar", "share") and draw.random() < 0.8:
        own = [f'<a href="/{k}">{x}</a>' for k, x in enumerate(own)]
    inner = draw.choice(("p", "div", "li", "")) if kind not in ("menu", "comments") else draw.choice(("li", "div", "p"))
    attributes = _attributes(draw.choice(ASIDE[kind]), draw)
    if not attributes and element in ("div", "section", "p", "ul", "ol"):
        attributes = f' class="{draw.choice(ASIDE[kind])}"'
    body = "".join(f"<{inner}>{x}</{inner}>" if inner else f" {x} " for x in own)
    if kind == "form":
        body += '<label>Name <input name="q"></label><button>OK</button>'
    return f"<{element}{attributes}>{body}</{element}>"


def layout(blocks: list[tuple[str, str]], seed: int) -> str:
    """A page that shows ``blocks`` (tag, text) as its main text, each marked by ``MARK``."""
    draw = random.Random(seed)
    lines = [t for _, t in blocks]
    wrapper = draw.choice(("article", "div", "main", "section", "div", "article", ""))
    name = f' class="{draw.choice(MAIN)}"' if wrapper == "div" or draw.random() < 0.5 else ""
    inside, k = [], 0
    while k < len(blocks):
        way = draw.random()
        run = blocks[k : k + (draw.randint(2, 4) if way < 0.15 else 1)]
        k += len(run)
        shown = [MARK + escape(text, quote=False) for _, text in run]
        if way < 0.1:
            holder = draw.choice(("ul", "ol"))
            inside.append(f"<{holder}>" + "".join(f"<li>{x}</li>" for x in shown) + f"</{holder}>")
        elif way < 0.15:
            inside.append("<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in shown) + "</table>")
        elif way < 0.2:
            inside.append(f"<blockquote><p>{shown[0]}</p></blockquote>")
        elif way < 0.3:
            inside.append(f"<section><{run[0][0]}>{shown[0]}</{run[0][0]}></section>")
        else:
            tag = draw.choice(("h2", "h3", "div")) if draw.random() < 0.15 else run[0][0]
            inside.append(f"<{tag}>{shown[0]}" + (f"</{tag}>" if draw.random() < 0.9 else ""))
        if draw.random() < 0.08:
            inside.append(part(draw.choice(("advert", "sidebar", "share", "form")), lines, draw))
    if draw.random() < 0.3:
        inside.append(part("comments", lines, draw))
    kinds = ("notice", "header", "menu", "advert")
    busy = draw.random() < 0.9
    before = [part(k, lines, draw) for k in kinds if busy and draw.random() < 0.6]
    after = [part(k, lines, draw) for k in ("share", "comments", "sidebar", "form", "advert", "footer") if busy and draw.random() < 0.5]
    draw.shuffle(before)
    draw.shuffle(after)
    main = f"<{wrapper}{name}>{''.join(inside)}</{wrapper}>" if wrapper else "".join(inside)
    if draw.random() < 0.4:
        main = f'<div class="{draw.choice(("wrapper", "container", "row", "layout", "page"))}">{main}</div>'
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"


_OUTSIDE = frozenset("nav header footer aside form".split())


def own_labels(blocks: list[Block]) -> np.ndarray | None:
    """Labels of a page that marks its article; None if it does not."""
    label = np.array([int("article" in b.tags and not _OUTSIDE & set(b.tags)) for b in blocks], dtype=int)
    return label if label.any() else None


def made_page(main: list[tuple[str, str]], seed: int) -> tuple[list[Block], np.ndarray]:
    """Blocks and labels of a made page."""
    blocks = leaf_blocks(layout(main, seed))
    label = np.array([int(b.text.startswith(MARK)) for b in blocks], dtype=int)
    for b in blocks:
        b.text = b.text.lstrip(MARK).strip() or "."
    return blocks, label


def train(pages: list[str], seed: int = 3) -> Field:
    """``pages``: a bounded list of pages to learn from; without any, a built-in one is used."""
    made: list[tuple[list[Block], np.ndarray]] = []
    each = max(3, -(-MADE_PAGES // max(1, len(pages))))
    for number, page in enumerate(pages or [""]):
        blocks = leaf_blocks(page)
        own = own_labels(blocks) if blocks else None
        if own is not None:
            made.append((blocks, own))
        main = [(b.tag if b.tag in ("h1", "h2", "h3", "p", "li", "blockquote", "pre") else "p", b.text)
                for b, y in zip(blocks, own if own is not None else np.ones(len(blocks))) if y]
        main = main or [("h1", "A title"), ("p", "Some text, that says what there is to say."), ("p", "And more of it.")]
        for k in range(each):
            draw = random.Random(seed + 1000 * number + k)
            made.append(made_page(main[: draw.randint(1, len(main))], seed + 1000 * number + k))
    counts: dict[str, int] = {}
    for blocks, _ in made:
        for name in {f for k in range(len(blocks)) for f in block_features(blocks, k)}:
            counts[name] = counts.get(name, 0) + 1
    field = Field(sorted(n for n, c in counts.items() if c >= 3))
    field.fit([field.indices(b) for b, _ in made], [y for _, y in made])
    return field


# ---- pages ------------------------------------------------------------------------------------


def main_text(pages: list[str | None], field: Field) -> list[str]:
    blocks = [leaf_blocks(p or "") for p in pages]
    labels = field.decode([field.indices(b) for b in blocks])
    return ["\n".join(b.text for b, y in zip(bs, ys) if y) for bs, ys in zip(blocks, labels)]


def learned_pages(pages: DataFrame, bound: int = LEARNED_PAGES) -> list[str]:
    """A sample fixed by a hash of page_id. Ids are picked first, so few pages travel."""
    some = pages.filter(F.col("html").isNotNull() & F.col("page_id").isNotNull() & (F.length("html") <= LEARNED_CHARS))
    order = F.xxhash64(F.col("page_id").cast("string"), F.lit("learn"))
    ids = [r[0] for r in some.select("page_id").orderBy(order, "page_id").limit(bound).collect()]
    picked = some.filter(F.col("page_id").isin(ids)).select("page_id", "html").limit(bound).collect()
    return [r[1] for r in sorted(picked)]


def extracted(pages: DataFrame) -> DataFrame:
    """op9: page_id, url, text, n_chars."""
    bounded_batches(pages.sparkSession)
    field = train(learned_pages(pages))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                texts = main_text(some.column("html").to_pylist(), field)
                yield pa.RecordBatch.from_arrays(
                    [some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
