"""Main text of web pages from flat text blocks and a decision tree.

A page falls into flat blocks of text at its block-level tags. A block's features are its word count and
link density and those of its neighbours, and where it stands: in an article, in an element whose tag or
whose class words speak of page furniture, and how much of the page that element holds (a wrapper named
"has-sidebar" holds nearly all of it). A decision tree, grown in numpy on a small table of labelled pages
below, tells article blocks from the rest; no word or tag decides by itself.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags whose content is no text (the first ones hold code or form text even where they aren't
#: closed), tags that end a block, tags of page furniture, tags of the main part, and words of class, id and
#: role attributes: those that name furniture, and those that may name a part of an article too.
CODE = {"script", "style", "textarea", "title"}
RAW = CODE | {"noscript", "template", "svg", "iframe", "object", "select", "canvas", "audio", "video"}
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
APART = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "fieldset", "head", "dir", "label"}
MAIN = {"article", "main"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
STRONG = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|sponsor\w*|sidebar|menu|nav\w*|breadcrumbs?|footer|masthead|comments?|replies|respond|disqus|cookies?|consent|"
    r"popup|modal|newsletter|subscribe|subscription|share|sharing|social|login|signup|toolbar|pagination|pager|complementary|navigation|contentinfo)(?:$|[\s_-])",
    re.I,
)
WEAK = re.compile(r"(?:^|[\s_-])(?:banner|promo\w*|side|notice|related|recommended|widget|search|copyright|legal|alert)(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--(?:.*?--!?>|.*$)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|<[a-zA-Z/!?][^>]*$|[^<]+|<", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
WORD = re.compile(r"\S+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "apart_share", "hint", "hint_share", "in_main", "main_share", "heading")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    apart: int  # number of the outermost element of furniture that it is in, 0 for none
    hint: int  # number of the element whose class words hint at furniture, 0 for none
    kind: int  # 2: its words name furniture, 1: they may, 0: no hint
    main: bool
    heading: bool


class Open(NamedTuple):
    """An open element; apart and hint as in Block, the last two its own marks."""

    tag: str
    apart: int = 0
    hint: int = 0
    main: bool = False
    own_apart: int = 0
    own_hint: int = 0


def blocks_of(page: str) -> list[Block]:
    """The flat blocks of a page, in order, without empty ones."""
    out: list[Block] = []
    stack: list[Open] = []
    kinds = [0]  # of each numbered element: 2, 1 or, for furniture tags, 0
    parts: list[str] = []
    linked, anchors, top, heading = 0, 0, Open(""), False

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                words = text.count(" ") + 1
                out.append(Block(text, words, min(linked, words), top.apart, top.hint, kinds[top.hint], top.main, heading))
            parts.clear()
        linked = 0

    def push(tag: str, own_apart: int, own_hint: int) -> None:
        outer = stack[-1] if stack else Open("")
        hint = own_hint if kinds[own_hint] > kinds[outer.hint] else outer.hint
        stack.append(Open(tag, outer.apart or own_apart, hint, outer.main or tag in MAIN, own_apart, own_hint))

    def numbered(kind: int) -> int:
        kinds.append(kind)
        return len(kinds) - 1

    at, size = 0, len(page)
    while at < size:
        found = TOKEN.match(page, at)
        at = found.end()
        first = page[found.start()]
        if first != "<" or found.end() - found.start() == 1:
            text = found.group()
            parts.append(text)
            if anchors:
                linked += len(WORD.findall(text))
            continue
        tag = found[2] or found[5]
        if not tag:
            continue
        tag, ends, rest = tag.lower(), found[1] or found[4], found[3] or found[6] or ""
        if tag in RAW and not ends:
            if tag != "title" or not top.main:
                parts.append(" ")
                if tag in CODE or not rest.rstrip().endswith("/"):
                    stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                    at = stop.end() if stop else size if tag in CODE else at  # an element that is never closed loses its tag alone
            continue
        if tag == "a":
            anchors = 0 if ends else 1
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCK and tag not in APART and not (rest and tag not in VOID) and not any(x.tag == tag for x in stack):
            continue  # an inline tag that marks nothing; one whose name is open counts, so that each closing tag finds its own
        if tag in BLOCK:
            close()
            anchors = 0 if tag != "a" and ends else anchors
        if ends:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n].tag == tag:
                    above = stack[n + 1 :]
                    del stack[n:]
                    if tag not in BLOCK and tag not in APART and any(x.tag in BLOCK for x in above):
                        for x in above:  # blocks opened inside go on, without the inline tag's marks
                            push(x.tag, x.own_apart, x.own_hint)
                    break
        elif tag not in VOID:
            if tag == "p" and stack and stack[-1].tag == "p":
                stack.pop()
            apart = tag in APART or (tag == "header" and not (stack and stack[-1].main)) or bool(rest and HIDDEN.search(rest))
            names = [x.strip("\"'") for x in NAMES.findall(rest)] if rest and tag not in ("html", "body") else []
            kind = 2 if any(map(STRONG.search, names)) else 1 if any(map(WEAK.search, names)) else 0
            push(tag, numbered(0) if apart else 0, numbered(kind) if kind else 0)
        now = stack[-1] if stack else Open("")
        if tag not in BLOCK and (now.apart, now.hint) != (top.apart, top.hint):
            close()
        top = now
        heading = top.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    close()
    return out


def features_of(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; before the first and after the last stand blocks without words.

    Word counts go in as the floor of their logarithm to base 2 of one more, 6 at most, and shares and link
    densities in tenths, so that the tree can't learn single numbers. A share is that of the page's words in
    the element that a block is marked by, rounded up.
    """
    n = len(blocks)
    words, links = np.zeros(n + 2), np.zeros(n + 2)
    words[1:-1] = [b.words for b in blocks]
    links[1:-1] = np.round([b.linked / b.words for b in blocks], 1)
    size = np.minimum(np.floor(np.log2(words + 1)), 6)
    apart, hint, kind, main, heading = np.array([(b.apart, b.hint, b.kind, b.main, b.heading) for b in blocks], int).reshape(n, 5).T
    total = max(words.sum(), 1)
    within = lambda number: np.where(number > 0, np.ceil(np.bincount(number, words[1:-1], minlength=1)[number] / total * 10) / 10, 0.0)
    main_share = np.full(n, np.ceil(words[1:-1] @ main / total * 10) / 10)
    return np.column_stack([size[1:-1], links[1:-1], size[:-2], links[:-2], size[2:], links[2:], within(apart), kind, within(hint), main, main_share, heading])


class Tree:
    """A binary decision tree grown by the Gini index, held in arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 2):
        self.feature, self.cut, self.low, self.high, self.share = [], [], [], [], []
        self._grow(x, y.astype(float), depth, least)
        self.feature, self.cut, self.low, self.high, self.share = map(np.array, (self.feature, self.cut, self.low, self.high, self.share))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        node = len(self.feature)
        for values, value in ((self.feature, -1), (self.cut, 0.0), (self.low, 0), (self.high, 0), (self.share, y.mean())):
            values.append(value)
        if not depth or y.min() == y.max():
            return node
        best = (y.var() * len(y) - 1e-9, None, None)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            left, right = t[:-1], t[-1] - t[:-1]
            loss = left * (1 - left / n) + right * (1 - right / (len(y) - n))
            loss[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
            i = int(np.argmin(loss))
            if loss[i] < best[0]:
                best = (loss[i], f, (v[i] + v[i + 1]) / 2)
        if best[1] is None:
            return node
        low = x[:, best[1]] <= best[2]
        self.feature[node], self.cut[node] = best[1], best[2]
        self.low[node] = self._grow(x[low], y[low], depth - 1, least)
        self.high[node] = self._grow(x[~low], y[~low], depth - 1, least)
        return node

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The share of positive rows in each row's leaf."""
        node = np.zeros(len(x), int)
        while (inner := self.feature[node] >= 0).any():
            f = self.feature[node]
            low = x[np.arange(len(x)), np.maximum(f, 0)] <= self.cut[node]
            node = np.where(inner, np.where(low, self.low[node], self.high[node]), node)
        return self.share[node]


def labelled_pages(pages: int = 600, seed: int = 5) -> list[tuple[str, list[int]]]:
    """The small labelled table: pages put together from parts, and for each of their blocks whether it is article text.

    A part is (markup, labels). Sizes, links, class names and places vary: two thirds of the pages have an
    article element; wrappers may be named after furniture or be a form; furniture may have telling class
    words, neutral ones or none; articles hold short and long paragraphs, lists, tables, captions, link-rich
    passages and paragraphs whose class words might name furniture.
    """
    rng = np.random.default_rng(seed)
    some = lambda low, high: int(rng.integers(low, high + 1))
    one = lambda values: values[some(0, len(values) - 1)]
    say = lambda low, high=0: " ".join(["word"] * some(low, high or low)) + "."
    link = lambda low, high=0: f'<a href="/x">{say(low, high)}</a>'
    named = lambda names: (lambda c: f' class="{c}"' if c else "")(one(names))
    wrappers = ["layout has-sidebar", "page with-menu", "wrap", "", "has-comments"]
    neutral = ["", "", "c1", "row", "box-3", "content", "inner", "col-8", "text"]
    maybe = lambda part, chance: [part()] if rng.random() < chance else []
    wrap = lambda tag, parts, attributes="": (f"<{tag}{attributes}>" + "".join(p for p, _ in parts) + f"</{tag}>", [x for _, y in parts for x in y])

    def size() -> tuple[int, int]:  # of a paragraph: short, middling or long
        return one([(1, 6), (8, 40), (8, 40), (40, 120), (40, 120), (120, 300)])

    def listed(count: int, low: int, high: int) -> tuple[str, list[int]]:
        return "<ul>" + "".join(f"<li>{link(low, high)}</li>" for _ in range(count)) + "</ul>", [0] * count

    furniture = {
        "menu": lambda: wrap(one(["nav", "nav", "div"]), [listed(some(3, 9), 1, 3)], named([*neutral, "menu", "main-nav"])),
        "inline menu": lambda: (f"<div{named(neutral)}>" + " | ".join(link(1, 2) for _ in range(some(3, 8))) + "</div>", [0]),
        "advert": lambda: (f"<div{named(['ad', 'advert', 'sponsored-box', 'ad-slot'])}>{say(4, 45)}</div>", [0]),
        "aside": lambda: ("<aside" + named(neutral) + f"><h3>{say(1, 3)}</h3><p>{say(5, 60)}</p><p>{link(3, 8)}</p></aside>", [0, 0, 0]),
        "sidebar": lambda: (f'<div class="sidebar"><h3>{say(1, 3)}</h3><p>{say(5, 60)}</p>{listed(3, 2, 6)[0]}</div>', [0] * 5),
        "notice": lambda: (f'<div id="cookie-notice"><p>{say(8, 60)}</p></div>', [0]),
        "form": lambda: (f"<form><label>{say(1, 3)}</label><p>{say(3, 30)}</p><button>{say(1)}</button></form>", [0, 0, 0]),
        "top": lambda: (f"<header><h2>{say(1, 5)}</h2><p>{say(3, 12)}</p></header>", [0, 0]),
        "foot": lambda: (f"<footer>{say(3, 30)}</footer>", [0]),
        "bare foot": lambda: (f"<div{named(neutral)}>{say(2, 5)} {link(1, 3)} {link(1, 3)} {link(1, 2)}</div>", [0]),
        "related": lambda: (f"<div{named([*neutral, 'related'])}><h3>{say(1, 3)}</h3>{listed(4, 3, 9)[0]}</div>", [0] * 5),
        "share": lambda: (f"<div{named(['share', 'social', 'related'])}>{link(1, 2)} {link(1, 2)} {say(1)}</div>", [0]),
        "comments": lambda: (f'<section class="{one(["comments", "comment-list", "replies"])}"><h3>{say(1, 2)}</h3>' + (lambda n, t: "".join(f"<{t}>{say(2, 80)}</{t}>" for _ in range(n)) + "</section>")(3, one(["p", "div", "article"])), [0] * 4),
        "promo": lambda: (f"<div{named(['promo', 'widget', 'banner', 'notice'])}>{say(2, 8)} {link(3, 8)}</div>", [0]),
    }

    def prose(bare: bool) -> list[tuple[str, list[int]]]:
        kinds = {
            "plain": lambda: (f"<p>{say(*size())}</p>", [1]),
            "linked": lambda: (f"<p>{say(10, 60)} {link(1, 6)} {say(3, 30)}</p>", [1]),
            "legal": lambda: (f"<p{named(['legal', 'alert', 'notice', 'side-note'])}>{say(8, 50)}</p>", [1]),
            "quote": lambda: (f"<blockquote>{say(4, 40)}</blockquote>", [1]),
            "heading": lambda: (f"<h2>{say(1, 8)}</h2><p>{say(12, 90)}</p>", [1, 1]),
        }
        rare = {
            "items": lambda: (f"<ul><li>{say(2, 20)}</li><li>{say(2, 20)}</li><li>{say(2, 9)} {link(1, 3)}</li></ul>", [1, 1, 1]),
            "cells": lambda: (f"<table><tr><td>{say(1, 3)}</td><td>{say(1, 3)}</td></tr></table>", [1, 1]),
            "caption": lambda: (f"<figure><figcaption>{say(2, 15)}</figcaption></figure>", [1]),
            "whole link": lambda: (f"<p>{link(2, 9)}</p>", [1]),
        }
        out = [kinds[one(["plain", "plain", "plain", *kinds])]() for _ in range(some(1, 9))]
        if not bare:
            out += [rare[one(list(rare))]() for _ in range(some(0, 2))]
            out = [out[i] for i in rng.permutation(len(out))]
        return [(f"<h1>{say(2, 12)}</h1>", [1]), *out] if rng.random() < 0.8 else out

    def page(bare: bool) -> tuple[str, list[int]]:
        body = prose(bare)
        if bare:
            body = [(f"<p>{say(30, 120)}</p>", [1]) if not i else part for i, part in enumerate(body)]
        for name in ("advert", "aside", "share", "notice", "form", "promo"):
            for part in maybe(furniture[name], 0.2):
                body.insert(some(1, len(body)), part)
        tail = maybe(furniture["comments"], 0.3)
        inner = [wrap("div" if bare else one(["article", "article", "main"]), [*body, *(tail if rng.random() < 0.5 else [])], named(neutral))]
        tail = tail if len(inner[0][1]) == sum(len(y) for _, y in body) else []
        before = [p for name in ("top", "menu", "inline menu", "advert", "notice") for p in maybe(furniture[name], 0.5)]
        after = [p for name in ("related", "sidebar", "aside", "form", "bare foot", "foot") for p in maybe(furniture[name], 0.4)]
        parts = [*before, *inner, *tail, *after]
        if rng.random() < 0.3:
            parts = [wrap(one(["div", "div", "form"]), parts, named(wrappers))]
        return wrap("body", parts)

    def note() -> tuple[str, list[int]]:  # a few paragraphs and a bare list of links
        return wrap("div", [*maybe(lambda: (f"<h1>{say(2, 12)}</h1>", [1]), 0.6), *[(f"<p>{say(15, 150)}</p>", [1]) for _ in range(some(1, 4))], *maybe(lambda: listed(some(2, 6), 1, 4), 0.6)], named(wrappers))

    return [note() if n % 9 == 2 else page(n % 3 == 2) for n in range(pages)]


@lru_cache(maxsize=1)
def default_tree() -> Tree:
    x, y = [], []
    for page, labels in labelled_pages():
        found = blocks_of(page)
        if len(found) != len(labels):
            raise ValueError("the labelled table doesn't match its blocks")
        x.append(features_of(found))
        y += labels
    return Tree(np.concatenate(x), np.array(y))


def main_text(page: str | None, tree: Tree | None = None) -> str:
    """The article's blocks joined by line ends; empty for null and for pages without any."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    keep = (tree or default_tree())(features_of(blocks)) >= 0.5
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html).

    Null, empty and torn html give what text there is, maybe none; nulls in page_id and url are kept;
    repeated rows come out repeatedly; an empty table gives no rows; other columns are ignored. White
    space inside a block is one space and a line-break tag counts as white space.
    """

    tree = default_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page.as_py(), tree) for page in b["html"]]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
