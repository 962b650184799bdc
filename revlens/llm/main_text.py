"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its blocks: runs of text between tags that start or end a block. Each
block is described by its tag path (open elements with their class, id and role words), by hashed words and by a few
shares. A bidirectional LSTM in numpy reads the whole sequence and gives every block the probability of
belonging to the article, so a block is judged by all others of its page. The network is fitted on
a bounded sample of pages whose own ``article`` or ``main`` elements tell the labels, and on pages that
``compose_page`` lays out from the sample's words: menus, headers, notices, adverts, sidebars, forms,
reader comments and footers around an article, under usual, odd or no names.

Every block of every page is read, however many; pages are run together by similar length in
groups of at most ``CELLS`` blocks, padding included, unless a single page is longer.

Defined cases: null and empty pages, and pages without an article, have an empty text; unclosed and crossed tags are
read leniently; an unclosed comment, script or tag swallows the rest; repeated rows count each for
itself; columns named like new ones are replaced; equal scores need no order, as blocks stay in page order.
"""

from __future__ import annotations

import html as entities
import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import quoted, renamed

# The network is fitted on at most so many pages of the table, chosen by hash among those of at most
# FIT_CHARACTERS, and on so many composed ones.
FIT_PAGES = 200
FIT_CHARACTERS = 1 << 20
COMPOSED_PAGES = 900
CELLS = 8192
HIDDEN = 24
_TAGS, _NEAREST, _NAMES, _WORDS = 96, 48, 384, 64
_SHARES = 8

# Fixed values of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary "
    "table tbody td tfoot th thead tr ul button".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg math object".split())
# Open elements that a start tag ends, looked for up to an element of the second set.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
ENDS_PARAGRAPH = BLOCK_TAGS - {"option", "optgroup", "button", "html", "head", "body"}
BARRIERS = frozenset("ul ol dl table div article aside section main nav header footer form blockquote body".split())

# Elements nested deeper than this are taken for part of the one around them, as browsers do.
DEPTH = 512

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Leaf:
    """One block: text, open elements as (tag, names) and how many of its characters are in links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple, linked: int) -> None:
        self.text, self.path, self.linked = text, path, linked


@lru_cache(maxsize=4096)
def _names(attributes: str) -> tuple[str, ...]:
    found = [next(filter(None, match[1:]), "") for match in _ATTRIBUTE.findall(attributes)]
    return tuple(sorted({part.lower() for value in found for part in _NAME_PART.findall(value)}))


def page_leaves(page: str | None) -> list[Leaf]:
    """Blocks with text, in page order; scripts, styles, comments and the head are left out."""
    page = page or ""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked, place, links = 0, 0, 0
    block_path: tuple | None = None

    def close() -> None:
        nonlocal linked, block_path
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append(Leaf(text, block_path or (), linked))
            pieces.clear()
        linked, block_path = 0, None

    def add(text: str) -> None:
        nonlocal linked, block_path
        if block_path is None and not text.isspace():
            block_path = tuple(stack)
        if links:
            linked += len(text)
        pieces.append(text)

    while True:
        found = _TOKEN.search(page, place)
        if found is None:
            if place < len(page):
                add(page[place:])
            break
        if found.start() > place:
            add(page[place : found.start()])
        place = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), (found[1] or found[4]) == "/", found[3] or found[6] or ""
        if name in SKIPPED_TAGS:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(page, place)
                place = end.end() if end else len(page)
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in BLOCK_TAGS:
            close()
        if name in VOID_TAGS:
            continue
        if closing:
            if any(tag == name for tag, _ in stack):
                while stack.pop()[0] != name:
                    pass
        else:
            ended = ENDED_BY.get(name, ()) + (("p",) if name in ENDS_PARAGRAPH else ())
            for depth in range(len(stack) - 1, -1, -1):
                tag = stack[depth][0]
                if tag in ended:
                    del stack[depth:]
                elif tag in BARRIERS:
                    break
            if len(stack) < DEPTH:
                stack.append((name, _names(attributes)))
        links = sum(tag == "a" for tag, _ in stack)
    close()
    return out


@lru_cache(maxsize=200_000)
def _slot(kind: str, word: str, size: int) -> int:
    return zlib.crc32(f"{kind}:{word}".encode("utf-8", "replace")) % size


def _path_vector(path: tuple) -> np.ndarray:
    """Hashed tags of all open elements, the two nearest again, and hashed names."""
    out = np.zeros(_TAGS + _NEAREST + _NAMES, np.float32)
    for tag, names in path:
        out[_slot("tag", tag, _TAGS)] = 1
        for name in names:
            out[_TAGS + _NEAREST + _slot("name", name, _NAMES)] = 1
    for weight, (tag, _) in zip((1.0, 0.5), reversed(path)):
        out[_TAGS + _slot("near", tag, _NEAREST)] = weight
    return out


class _WordSlots(dict):
    """Slots of words, remembered for at most 200,000 of them."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = slot = zlib.crc32(word.encode("utf-8", "replace")) % _WORDS
        return slot


_word_slots = _WordSlots()


def _text_vector(leaf: Leaf) -> np.ndarray:
    out = np.zeros(_WORDS + _SHARES, np.float32)
    words = leaf.text.lower().split(" ")
    counts = np.bincount(list(map(_word_slots.__getitem__, words)), minlength=_WORDS)
    out[:_WORDS] = counts / np.sqrt(counts @ counts)
    size = len(leaf.text)
    out[_WORDS:] = (
        np.log1p(len(words)) / 4, np.log1p(size) / 6, min(1.0, leaf.linked / size), sum(map(leaf.text.count, ".,;:!?")) / size * 10,
        leaf.text[-1] in ".!?…", any(mark in leaf.text for mark in "©|»›"), sum(map(leaf.text.count, string.digits)) / size, size < 25)
    return out


class Labeller:
    """Bidirectional LSTM over the blocks of a page and a logistic output for each."""

    def __init__(self, hidden: int = HIDDEN) -> None:
        draw = np.random.default_rng(12)
        paths, texts, self.hidden = _TAGS + _NEAREST + _NAMES, _WORDS + _SHARES, hidden
        self.values = {"paths": draw.normal(0, 0.15, (paths, 8 * hidden)), "texts": draw.normal(0, 0.15, (texts, 8 * hidden)),
                       "start": np.zeros(8 * hidden), "forward": draw.normal(0, hidden**-0.5 / 2, (hidden, 4 * hidden)),
                       "backward": draw.normal(0, hidden**-0.5 / 2, (hidden, 4 * hidden)),
                       "out": draw.normal(0, hidden**-0.5, 2 * hidden), "bias": np.zeros(1)}
        for first in (hidden, 5 * hidden):
            self.values["start"][first : first + hidden] = 1.0
        self.values = {name: value.astype(np.float32) for name, value in self.values.items()}

    def _sweep(self, given: np.ndarray, weights: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after each step for a group of sequences, and what the gradient needs."""
        group, steps, hidden = given.shape[0], given.shape[1], self.hidden
        state, memory = np.zeros((group, hidden), np.float32), np.zeros((group, hidden), np.float32)
        states, saved = np.zeros((group, steps, hidden), np.float32), []
        for step in range(steps):
            gates = given[:, step] + state @ weights
            squashed = 1 / (1 + np.exp(-np.clip(gates[:, : 3 * hidden], -40, 40)))
            take, hold, show = squashed[:, :hidden], squashed[:, hidden : 2 * hidden], squashed[:, 2 * hidden :]
            fresh = np.tanh(gates[:, 3 * hidden :])
            before, memory = memory, hold * memory + take * fresh
            shown = np.tanh(memory)
            if keep:
                saved.append((state, before, take, hold, show, fresh, shown))
            state = show * shown
            states[:, step] = state
        return states, saved

    def _unsweep(self, slope: np.ndarray, saved: list, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the given inputs and of the recurrent weights; padded steps come last and have no slope."""
        group, steps, hidden = slope.shape
        inputs, recurrent = np.zeros((group, steps, 4 * hidden), np.float32), np.zeros_like(weights)
        d_state, d_memory = np.zeros((group, hidden), np.float32), np.zeros((group, hidden), np.float32)
        for step in range(steps - 1, -1, -1):
            state, before, take, hold, show, fresh, shown = saved[step]
            d_state = d_state + slope[:, step]
            d_memory = d_memory + d_state * show * (1 - shown**2)
            gates = np.concatenate([d_memory * fresh * take * (1 - take), d_memory * before * hold * (1 - hold),
                                    d_state * shown * show * (1 - show), d_memory * take * (1 - fresh**2)], axis=1)
            inputs[:, step] = gates
            recurrent += state.T @ gates
            d_state, d_memory = gates @ weights.T, d_memory * hold
        return inputs, recurrent

    @staticmethod
    def _turned(sizes: np.ndarray, steps: int) -> np.ndarray:
        """Places that turn each sequence round within its own length."""
        places = np.arange(steps)[None, :]
        return np.where(places < sizes[:, None], sizes[:, None] - 1 - places, places)

    def _scores(self, given: np.ndarray, sizes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        turned = self._turned(sizes, given.shape[1])[:, :, None]
        ahead, saved = self._sweep(given[:, :, : 4 * self.hidden], self.values["forward"], keep)
        back, saved_back = self._sweep(np.take_along_axis(given[:, :, 4 * self.hidden :], turned, axis=1), self.values["backward"], keep)
        both = np.concatenate([ahead, np.take_along_axis(back, turned, axis=1)], axis=2)
        return 1 / (1 + np.exp(-np.clip(both @ self.values["out"] + self.values["bias"], -40, 40))), (both, saved, saved_back, turned)

    def probabilities(self, pages: list[list[Leaf]]) -> list[np.ndarray]:
        """Probability of each block of each page to be part of the article."""
        found: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((place for place, leaves in enumerate(pages) if leaves), key=lambda place: len(pages[place]))
        known: dict[tuple, np.ndarray] = {}

        def of_path(path: tuple) -> np.ndarray:
            if path not in known:
                if len(known) > 20_000:
                    known.clear()
                known[path] = _path_vector(path) @ self.values["paths"]
            return known[path]

        begin = 0
        while begin < len(order):
            end = begin + 1
            while end < len(order) and len(pages[order[end]]) * (end - begin + 1) <= CELLS:
                end += 1
            group = order[begin:end]
            sizes = np.array([len(pages[place]) for place in group])
            given = np.zeros((len(group), int(sizes.max()), 8 * self.hidden), np.float32)
            for row, place in enumerate(group):
                texts = np.stack([_text_vector(leaf) for leaf in pages[place]])
                given[row, : sizes[row]] = texts @ self.values["texts"] + [of_path(leaf.path) for leaf in pages[place]] + self.values["start"]
            scores, _ = self._scores(given, sizes)
            for row, place in enumerate(group):
                found[place] = scores[row, : sizes[row]]
            begin = end
        return found

    def train(self, pages: list[list[Leaf]], labels: list[np.ndarray], epochs: int = 14, rate: float = 0.01, group: int = 32) -> None:
        """Adam on the mean logistic loss of all blocks."""
        draw = np.random.default_rng(7)
        known = {path: place for place, path in enumerate({leaf.path: None for leaves in pages for leaf in leaves})}
        paths = np.stack([_path_vector(path) for path in known])
        places = [np.array([known[leaf.path] for leaf in leaves]) for leaves in pages]
        texts = [np.stack([_text_vector(leaf) for leaf in leaves]) for leaves in pages]
        first, second = ({name: np.zeros_like(value) for name, value in self.values.items()} for _ in range(2))
        by_size = np.argsort([len(leaves) for leaves in pages], kind="stable")
        groups = [by_size[k : k + group] for k in range(0, len(by_size), group)]
        step, total, hidden = 0, epochs * len(groups), self.hidden
        for _ in range(epochs):
            for number in draw.permutation(len(groups)):
                rows = groups[number]
                sizes = np.array([len(pages[row]) for row in rows])
                filled = np.arange(int(sizes.max()))[None, :] < sizes[:, None]
                path, text = np.concatenate([places[row] for row in rows]), np.concatenate([texts[row] for row in rows])
                met, which = np.unique(path, return_inverse=True)
                given = np.zeros((*filled.shape, 8 * hidden), np.float32)
                given[filled] = (paths[met] @ self.values["paths"])[which] + text @ self.values["texts"] + self.values["start"]
                scores, (both, saved, saved_back, turned) = self._scores(given, sizes, True)
                error = np.zeros(filled.shape, np.float32)
                error[filled] = (scores[filled] - np.concatenate([labels[row] for row in rows])) / len(path)
                slope = error[:, :, None] * self.values["out"]
                ahead, d_forward = self._unsweep(slope[:, :, :hidden], saved, self.values["forward"])
                back, d_backward = self._unsweep(np.take_along_axis(slope[:, :, hidden:], turned, axis=1), saved_back, self.values["backward"])
                inputs = np.concatenate([ahead, np.take_along_axis(back, turned, axis=1)], axis=2)[filled]
                by_path = np.zeros((len(met), 8 * hidden), np.float32)
                np.add.at(by_path, which, inputs)
                slopes = {"paths": paths[met].T @ by_path, "texts": text.T @ inputs, "start": inputs.sum(axis=0), "forward": d_forward,
                          "backward": d_backward, "out": (error[:, :, None] * both).sum(axis=(0, 1)), "bias": np.array([error.sum()])}
                step += 1
                pace = rate * (1 - step / (total + 1))
                for name, gradient in slopes.items():
                    first[name] = 0.9 * first[name] + 0.1 * gradient
                    second[name] = 0.99 * second[name] + 0.01 * gradient**2
                    change = pace * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                    self.values[name] = (self.values[name] - change).astype(np.float32)


# Usual names of a page's parts, for composed pages: (tags, class and id names).
PARTS = {
    "header": (("header", "div"), ("header", "site-header", "masthead", "top", "branding", "page-header", "banner")),
    "menu": (("nav", "div", "ul"), ("nav", "menu", "main-nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "tabs")),
    "notice": (("div", "section", "p"), ("notice", "cookie-notice", "cookie", "consent", "alert", "gdpr", "warning", "paywall", "announcement", "popup", "modal")),
    "advert": (("div", "aside", "section"), ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "ad-slot", "banner-ad")),
    "sidebar": (("aside", "div", "section"), ("sidebar", "side", "widget", "related", "recommended", "most-read", "popular", "rail", "more", "tags", "share", "social")),
    "form": (("form",), ("form", "search", "search-form", "login", "signup", "newsletter", "subscribe", "contact-form")),
    "comments": (("section", "div", "ol"), ("comments", "comment-list", "reader-comments", "responses", "discussion", "disqus", "replies")),
    "footer": (("footer", "div"), ("footer", "site-footer", "page-footer", "bottom", "copyright", "colophon", "legal")),
    "article": (("article", "article", "article", "div", "section", "main"), ("article", "content", "post", "entry-content", "story", "article-body", "post-body", "text", "main-content", "prose")),
}
_MARK = "\ue000"


class _Composer:
    """Lays out pages from given words; text of the article carries a mark."""

    def __init__(self, words: list[list[str]], seed: int) -> None:
        self.draw, self.words = np.random.default_rng(seed), [found for found in words if found] or [["text"]]

    def chance(self, share: float) -> bool:
        return self.draw.random() < share

    def pick(self, values):
        return values[int(self.draw.integers(len(values)))]

    def some(self, least: int, most: int) -> str:
        words = self.pick(self.words)
        size = int(np.exp(self.draw.uniform(np.log(least), np.log(most + 1))))
        begin = int(self.draw.integers(max(1, len(words) - size)))
        return entities.escape(" ".join(words[begin : begin + size]), quote=False) + ("" if self.chance(0.3) else ".")

    def part(self, kind: str, inside: str) -> str:
        tags, names = PARTS[kind]
        tag = self.pick(tags)
        plain = self.style == "tags" and tags[0] not in ("div",) or kind == "form"
        if self.style == "odd" and tag in ("div", "section", "p", "ul", "ol") and tags[0] not in ("div", "section"):
            tag = self.pick((tag, tags[0]))
        attribute = ""
        if self.style == "odd":
            attribute = f' class="{"".join(self.draw.choice(list(string.ascii_lowercase), 6))}"' if self.chance(0.7) else ""
        elif not plain or self.chance(0.4) or tag in ("div", "section", "p", "ul", "ol"):
            attribute = f' {self.pick(("class", "class", "id"))}="{self.pick(names)}{self.pick(("", "", " box", " clearfix", "-1"))}"'
        return f"<{tag}{attribute}>{inside}</{tag}>"

    def links(self) -> str:
        items = [f'<a href="/{k}">{self.some(1, 4)}</a>' for k in range(int(self.draw.integers(2, 10)))]
        form = self.pick(("<ul><li>{}</ul>", "<ul><li>{}</li></ul>", "{}", "<p>{}</p>"))
        joint = {"<ul><li>{}</ul>": "<li>", "<ul><li>{}</li></ul>": "</li><li>"}.get(form, self.pick((" | ", " ", " &middot; ")))
        return form.format(joint.join(items))

    def aside(self, kind: str) -> str:
        if kind == "menu":
            inside = self.links()
        elif kind == "header":
            inside = self.pick((f"<h1>{self.some(1, 6)}</h1>", f'<a href="/">{self.some(1, 4)}</a>', f"<div>{self.some(1, 5)}</div><p>{self.some(2, 12)}</p>")) + (self.links() if self.chance(0.3) else "")
        elif kind == "form":
            inside = f"<label>{self.some(1, 4)}</label><input name=q><button>{self.some(1, 2)}</button>" + (f"<p>{self.some(3, 25)}</p>" if self.chance(0.4) else "") + (
                f"<select><option>{self.some(1, 2)}<option>{self.some(1, 2)}</select>" if self.chance(0.3) else "")
        elif kind == "comments":
            inside = f"<h3>{self.some(1, 3)}</h3>" if self.chance(0.7) else ""
            name = self.pick(("comment", "reply", "comment-body"))
            for _ in range(int(self.draw.integers(1, 6))):
                body = f"<p>{self.some(2, 60)}</p>" * (1 + self.chance(0.2))
                inside += self.pick((f'<div class="{name}"><b>{self.some(1, 2)}</b>{body}</div>', f"<li>{body}</li>", body, f"<article><cite>{self.some(1, 2)}</cite>{body}</article>"))
        elif kind == "footer":
            inside = self.pick((f"&copy; {self.some(1, 4)} &middot; {self.some(2, 20)}", f"<p>{self.some(3, 30)}</p>", self.links() + f"<p>&copy; {self.some(1, 8)}</p>"))
        elif kind == "sidebar":
            inside = (f"<h3>{self.some(1, 4)}</h3>" if self.chance(0.6) else "") + self.pick((self.links(), f"<p>{self.some(3, 40)}</p>", f"<p>{self.some(3, 25)}</p>" + self.links()))
        else:
            text = self.some(2, 35)
            inside = self.pick((text, f"<p>{text}</p>", f"<span>{text}</span> <a href=#>{self.some(1, 3)}</a>", f"<p>{text}</p><button>{self.some(1, 2)}</button>"))
        return self.part(kind, inside)

    def paragraph(self) -> str:
        text = _MARK + self.some(1, self.longest)
        if self.chance(0.15):
            text += f' <a href="/x">{self.some(1, 4)}</a> ' + self.some(1, 20)
        return self.pick((f"<p>{text}</p>",) * 8 + (
            f"<p>{text}", f"<p><b>{text}<br>", f"<h2>{_MARK}{self.some(1, 8)}</h2>", f"<blockquote>{text}</blockquote>", f"<ul><li>{text}</li><li>{_MARK}{self.some(1, 15)}</li></ul>",
            f"<pre>{text}</pre>", f"<div>{text}</div>", f"<table><tr><td>{_MARK}{self.some(1, 6)}<td>{_MARK}{self.some(1, 6)}</table>", f"<figure><figcaption>{text}</figcaption></figure>"))

    def page(self) -> str:
        self.style = self.pick(("tags", "tags", "names", "names", "odd"))
        title = f"<h1>{_MARK}{self.some(2, 14)}</h1>" if self.chance(0.8) else ""
        inside = []
        self.longest = 4 if self.chance(0.1) else 140
        repeated = self.paragraph() if self.chance(0.04) else ""
        for _ in range(int(np.exp(self.draw.uniform(0, 5.2 if self.chance(0.08) else 3)))):
            inside.append(repeated or self.paragraph())
            # Without names or telling tags nobody could say what doesn't belong to an article.
            if self.chance(0.1) and self.style != "odd":
                inside.append(self.aside(self.pick(("advert", "sidebar", "form", "notice"))))
        article = self.part("article", title + "".join(inside)) if self.chance(0.97) else ""
        if self.chance(0.25):
            article = self.pick(("<main>{}</main>", "<div>{}</div>", '<div class="container">{}</div>')).format(article)
        before = [self.aside(kind) for kind, share in (("header", 0.5), ("notice", 0.3), ("menu", 0.8), ("form", 0.2), ("advert", 0.5), ("sidebar", 0.2)) if self.chance(share)]
        after = [self.aside(kind) for kind, share in (("sidebar", 0.3), ("comments", 0.45), ("advert", 0.2), ("form", 0.25), ("notice", 0.15)) if self.chance(share)]
        if self.chance(0.3):
            before, after = list(self.draw.permutation(before)), list(self.draw.permutation(after))
        footer = self.aside("footer") if self.chance(0.85) else ""
        return f"<html><head><title>x</title></head><body>{''.join(before)}{article}{''.join(after)}{footer}</body></html>"


def compose_page(words: list[list[str]], seed: int) -> tuple[list[Leaf], np.ndarray]:
    """Blocks of a composed page, and which of them are the article's."""
    leaves = page_leaves(_Composer(words, seed).page())
    labels = np.array([_MARK in leaf.text for leaf in leaves], np.float64)
    for leaf in leaves:
        leaf.text = leaf.text.replace(_MARK, "").strip() or "."
    return leaves, labels


_WHOLE = frozenset(("article", "main"))
_BESIDE = frozenset(("nav", "aside", "header", "footer", "form", "button", "select"))
_BESIDE_NAMES = frozenset(part for kind in ("advert", "notice", "sidebar", "comments", "menu", "form") for name in PARTS[kind][1] for part in _NAME_PART.findall(name))


def own_labels(leaves: list[Leaf]) -> np.ndarray | None:
    """Labels that a page's own elements tell; None where it has no article of its own."""
    if not any(tag in _WHOLE for leaf in leaves for tag, _ in leaf.path):
        return None
    return np.array([any(tag in _WHOLE for tag, _ in leaf.path) and not any(tag in _BESIDE or _BESIDE_NAMES & set(names) for tag, names in leaf.path)
                     for leaf in leaves], np.float64)


def fit(pages: DataFrame, html: str = "html", fit_pages: int = FIT_PAGES, composed: int = COMPOSED_PAGES) -> Labeller:
    """Labeller fitted on at most ``fit_pages`` different pages with the least hashes, and on composed ones."""
    column = F.col(quoted(html))
    # Copies count once; the limit takes the least hashes without a sort of the whole table.
    hashed = pages.select(F.xxhash64(column).alias("_h"), column.alias("_page")).filter(F.length("_page") <= FIT_CHARACTERS)
    chosen = hashed.select("_h").distinct().orderBy("_h").limit(fit_pages)
    sample = hashed.join(F.broadcast(chosen), "_h").groupBy("_h").agg(F.min("_page").alias("_page")).orderBy("_h").collect()
    given = [leaves for leaves in (page_leaves(row["_page"]) for row in sample) if leaves]
    words = [leaf.text.split(" ") for leaves in given for leaf in leaves]
    told = [(leaves, labels) for leaves in given if (labels := own_labels(leaves)) is not None]
    made = [(leaves, labels) for leaves, labels in (compose_page(words, seed) for seed in range(composed)) if leaves]
    labeller = Labeller()
    labeller.train([leaves for leaves, _ in told + made], [labels for _, labels in told + made])
    return labeller


def extract(pages: DataFrame, labeller: Labeller, html: str = "html", keep_blocks: bool = False) -> DataFrame:
    """All other columns of ``pages`` with ``text`` and ``n_chars`` of the main text, and with ``keep_blocks``
    also ``blocks``: every block's text, tag path and probability."""
    new = {"text", "n_chars", *["blocks"] * keep_blocks}
    kept = [name for name in pages.columns if name != html and name.lower() not in new]
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    fields += T.StructType.fromDDL("blocks array<struct<text: string, path: string, score: double>>").fields * keep_blocks
    schema = T.StructType([pages.schema[name] for name in kept] + fields)
    kind = pa.list_(pa.struct([("text", pa.string()), ("path", pa.string()), ("score", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                leaves = [page_leaves(value.as_py()) for value in part.column(0)]
                scores = labeller.probabilities(leaves)
                texts = ["\n\n".join(leaf.text for leaf, score in zip(found, likely) if score >= 0.5) for found, likely in zip(leaves, scores)]
                columns = [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                if keep_blocks:
                    columns.append(pa.array([[{"text": leaf.text, "path": "/".join(tag for tag, _ in leaf.path), "score": float(score)}
                                              for leaf, score in zip(found, likely)] for found, likely in zip(leaves, scores)], kind))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names=schema.names)

    return renamed(pages, [html, *kept]).mapInArrow(work, schema)
