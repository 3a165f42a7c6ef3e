"""Operator 2, main text of web pages by a linear-chain conditional random field.

A page is read into its DOM's leaf blocks in page order.  Each block has features of its ancestor tags
(with their classes, ids and roles) and of its text.  A two-label linear chain (main text or not),
trained on labelled pages, is decoded by Viterbi; the blocks labelled main text are joined.
"""

from __future__ import annotations

import html as htmllib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.llm.common import bounded, table, tidy

#: Elements whose content is no text, elements that stand within a block's text, and elements without an end tag.
SKIPPED = frozenset("script style noscript template iframe head title".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark math object q s samp small span strike strong sub sup svg time tt u var video wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key closes an open element of these, up to an element that holds them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot select body article section div main nav aside header footer form blockquote figure".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?[a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?[a-zA-Z][^\s/>]*+)[^>]*+>", re.S)
_HALF_TAG = re.compile(r"<[/!a-zA-Z][^>]*+\Z")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


#: Ancestors that say something; others are features as "other".
_TELLING = frozenset("article main section nav header footer aside form ul ol li table td th p div h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption button select option textarea fieldset label dl dt dd address details summary menu dialog body".split())


class Node:
    """An open element that stands around blocks, with what all its ancestors say, shared wherever it adds nothing."""

    __slots__ = ("names", "near", "parent", "seen")

    def __init__(self, above: Node | None, tag: str, names: frozenset[str]):
        shown = tag if tag in _TELLING else "other"
        seen, said = (above.seen, above.names) if above else (frozenset(), frozenset())
        self.parent = tag
        self.seen = seen if shown in seen else seen | {shown}
        self.names = said if names <= said else said | names
        self.near = names or (above.near if above else names)  # of the innermost element that has some


@dataclass
class Block:
    text: str
    node: Node | None
    link_chars: int = 0


def blocks_of(html: str | None, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page: text with references decoded and white space folded, and its ancestors.

    known: the names of elements that matter; None: all.  Time and memory are linear in the page, however deep it
    nests: no block copies or walks its ancestors, and no tag is sought twice in what follows.
    """
    if not html:
        return []
    out: list[Block] = []
    stack: list[tuple[str, Node | None]] = []  # tags, with the block node that is open from there on
    spots: dict[str, list[int]] = {}  # where in the stack each tag stands
    holders: list[int] = []
    parts: list[str] = []
    linked, missing = 0, set()

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1][1] if stack else None, linked))
            parts.clear()
            linked = 0

    def push(tag: str, node: Node | None) -> None:
        spots.setdefault(tag, []).append(len(stack))
        if tag in HOLDERS:
            holders.append(len(stack))
        stack.append((tag, node))

    def pop_to(at: int) -> None:
        if any(stack[k][0] not in INLINE for k in range(at, len(stack))):
            end_block()
        while len(stack) > at:
            tag, _ = stack.pop()
            spots[tag].pop()
            if tag in HOLDERS:
                holders.pop()

    def add(text: str) -> None:
        nonlocal linked
        text = htmllib.unescape(text)  # a reference does not go on behind a tag or a comment
        parts.append(text)
        if spots.get("a"):
            linked += len(text)

    # No tag ends after the last ">"; only a comment may run on to the end.
    pos, size = 0, html.rfind(">") + 1
    while True:
        m = _TAG.search(html, pos, size)
        if m is None:
            rest = html[pos:]
            open_comment = rest.find("<!--")
            rest = _HALF_TAG.sub("", rest if open_comment < 0 else rest[:open_comment])
            if rest:
                add(rest)
            break
        if m.start() > pos:
            add(html[pos : m.start()])
        pos = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            break  # it goes on to the end
        name = (m[1] or m[3] or "").lower()
        if not name:
            continue
        if name.startswith("/"):
            name = name[1:]
            if spots.get(name):
                pop_to(spots[name][-1])
            elif name not in INLINE:
                end_block()
            continue
        if name in SKIPPED:
            close = None if name in missing else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, pos)
            if close is not None:
                pos = close.end()
            elif name in ("script", "style", "noscript", "template"):
                break  # its content goes on to the end
            else:
                missing.add(name)
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name not in VOID:
                push(name, stack[-1][1] if stack else None)
            continue
        ends = max((spots[t][-1] for t in ("p", *CLOSES.get(name, ())) if spots.get(t)), default=-1)
        if ends > (holders[-1] if holders else -1):
            pop_to(ends)
        end_block()
        if name not in VOID:
            names = set()
            for a in _ATTRIBUTE.finditer(m[2] or ""):
                value, key = a[2] or a[3] or a[4] or "", a[1].lower()
                if key == "style":
                    names |= {"hidden"} if re.search(r"display\s*:\s*none", value, re.I) else set()
                else:
                    names |= {w.lower() for w in _NAME_WORD.findall(value)} | ({"hidden"} if key == "hidden" else set())
            push(name, Node(stack[-1][1] if stack else None, name, frozenset(names if known is None else names & known)))
    end_block()
    return out


def featured(blocks: list[Block]) -> list[list[str]]:
    """Features of a page's blocks: of ancestors, of text, and of place."""
    total = len(blocks)
    main = any(b.node and not b.node.seen.isdisjoint(("article", "main")) for b in blocks)
    above: dict[int, list[str]] = {}
    out = []
    for k, b in enumerate(blocks):
        own = above.get(id(b.node))
        if own is None:
            seen, names = (b.node.seen, b.node.names) if b.node else ((), ())
            own = ["bias", f"page_has_main={main}", *(f"under={t}" for t in sorted(seen)), f"parent={b.node.parent if b.node else '-'}"]
            if main:
                own.append(f"in_main={'article' in seen or 'main' in seen}")
            own += [f"name={n}" for n in sorted(names)]
            own += [f"near={n}" for n in sorted(b.node.near if b.node else ())]
            above[id(b.node)] = own
        f = list(own)
        words = b.text.count(" ") + 1
        f.append(f"words={min(7, words.bit_length())}")
        density = b.link_chars / max(1, len(b.text))
        f.append(f"links={min(4, math.ceil(density * 4))}")
        if b.text[-1] in ".!?…:\"”»":
            f.append("sentence_end")
        if "©" in b.text or "all rights reserved" in b.text.lower():
            f.append("copyright")
        if words <= 6 and b.text[-1] not in ".!?":
            f.append("label_like")
        if k == 0:
            f.append("first")
        if k == total - 1:
            f.append("last")
        out.append(f)
    return out


@dataclass(frozen=True)
class Crf:
    """Weights of label 1 against 0 by feature, and the scores of the four transitions."""

    weights: dict[str, float]
    trans: tuple[float, float, float, float]

    @property
    def names(self) -> frozenset[str]:
        return frozenset(f.partition("=")[2] for f in self.weights if f.startswith(("name=", "near=")))

    def scores(self, features: list[list[str]]) -> list[float]:
        w = self.weights.get
        return [sum(w(f, 0.0) for f in fs) for fs in features]

    def decode(self, features: list[list[str]]) -> list[int]:
        """Viterbi."""
        t00, t01, t10, t11 = self.trans
        a, b, back = 0.0, 0.0, []
        for k, s in enumerate(self.scores(features)):
            if k == 0:
                a, b = 0.0, s
                back.append((0, 1))
                continue
            p0, p1 = (0, a + t00) if a + t00 >= b + t10 else (1, b + t10)
            q0, q1 = (0, a + t01) if a + t01 > b + t11 else (1, b + t11)
            back.append((p0, q0))
            a, b = p1, q1 + s
        out, label = [], int(b > a)
        for p in reversed(back):
            out.append(label)
            label = p[label]
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], *, epochs: int = 12, rate: float = 0.3, l2: float = 1e-4, seed: int = 1) -> Crf:
    """Maximum likelihood by stochastic gradients (forward and backward sums over the chain), with decayed weights."""
    index: dict[str, int] = {}
    data = [([[index.setdefault(x, len(index)) for x in f] for f in fs], y) for fs, y in pages if y]
    w, t = np.zeros(len(index)), np.zeros((2, 2))
    gw, gt = np.full(len(index), 1e-6), np.full((2, 2), 1e-6)
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(data)
        for fs, y in data:
            n = len(y)
            s = np.array([w[f].sum() for f in fs])
            emit = np.stack([np.zeros(n), s], axis=1)
            alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
            alpha[0] = emit[0]
            for k in range(1, n):
                alpha[k] = emit[k] + np.logaddexp(alpha[k - 1, 0] + t[0], alpha[k - 1, 1] + t[1])
            for k in range(n - 2, -1, -1):
                nxt = emit[k + 1] + beta[k + 1]
                beta[k] = np.logaddexp(t[:, 0] + nxt[0], t[:, 1] + nxt[1])
            z = np.logaddexp(*alpha[-1])
            p = np.exp(alpha[:, 1] + beta[:, 1] - z)
            for k, f in enumerate(fs):
                g = y[k] - p[k]
                if abs(g) > 1e-3:
                    gw[f] += g * g
                    w[f] += rate * (g / np.sqrt(gw[f]) - l2 * w[f])
            if n > 1:
                pair = np.exp(alpha[:-1, :, None] + t[None] + (emit + beta)[1:, None, :] - z)
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:-1], y[1:]), 1)
                g = seen - pair.sum(0)
                gt += g * g
                t += rate * g / np.sqrt(gt)
    return Crf({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-4}, tuple(float(x) for x in t.ravel()))


# --- Labelled pages -------------------------------------------------------------------------------
#: Names that page authors give to what is and what isn't the article.
_MAIN_NAMES = ["content", "post", "entry", "article", "story", "main", "body", "text", "entry-content", "post-body", "article-body", "page-content"]
_SIDE_NAMES = {
    "nav": ["nav", "navbar", "menu", "navigation", "breadcrumb", "breadcrumbs", "topnav", "pagination", "tabs"],
    "header": ["header", "masthead", "banner", "top-bar", "site-header", "logo"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "colophon"],
    "aside": ["sidebar", "side", "widget", "related", "recommended", "popular", "rail", "tags", "teaser", "promo-box"],
    "notice": ["notice", "cookie", "cookie-banner", "consent", "gdpr", "alert", "message", "popup", "modal", "overlay", "newsletter", "disclaimer"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner-ad", "adslot"],
    "form": ["form", "search", "searchbox", "login", "subscribe", "signup", "contact-form"],
    "comments": ["comment", "comments", "comment-list", "discussion", "replies", "reply", "disqus", "respond"],
    "share": ["share", "social", "sharing", "follow"],
}


#: Share of training pages whose article has no container of its own.
BARE = 0.25


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page of invented words and the labels of its blocks."""
    syllables = "an ba cor del er fi gon hal in jo kel lo mun nor os pra qui ran sel tur ul ven wa xi yor ze".split()
    labels: list[int] = []
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def words(n: int) -> str:
        kind, out = rng.random(), [word() for _ in range(n)]
        if kind < 0.06:
            out = [x + rng.choice([" |", "***", "%%%", "!!"]) for x in out]
        elif kind < 0.1:
            out = [x.upper() for x in out]
        elif kind < 0.14:
            out = [out[0]] * n
        return " ".join(out)

    def sentence(n: int) -> str:
        return words(n).capitalize() + rng.choice([".", ".", ".", "!", "?", ""] if n > 3 else [".", "", "."])

    def block(tag: str, text: str, label: int, attrs: str = "") -> str:
        labels.append(label)
        return f"<{tag}{attrs}>{text}</{tag}>" if tag != "p" or rng.random() < 0.85 else f"<p{attrs}>{text}"

    def length() -> int:
        return rng.choice([1, 1, 2, 3, 5, 8, 12, 20, 30, 50, 80, 160])

    def attr(names: list[str]) -> str:
        if rng.random() < 0.25:
            return ""
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"'

    def links(n: int, label: int = 0) -> str:
        items = []
        for _ in range(n):
            labels.append(label)
            items.append(f'<li><a href="/{word()}">{words(rng.randint(1, 4))}</a></li>')
        return "<ul>" + "".join(items) + "</ul>"

    def side(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        named = tag == "div" or rng.random() < 0.4
        if named and rng.random() < 0.6:
            tag = rng.choice(["div", "section", tag])
        plain = tag in ("div", "section")
        names = _SIDE_NAMES[kind]
        head = f"<{tag}" + (f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"' if plain else attr(names)) + ">"
        if kind == "nav":
            body = links(rng.randint(2, 8))
        elif kind == "header":
            body = block(rng.choice(["h1", "div", "p", "div"]), words(rng.randint(1, 4)), 0) + (links(rng.randint(2, 6)) if rng.random() < 0.5 else "")
        elif kind == "footer":
            body = block(rng.choice(["p", "div"]), "&copy; " + words(rng.randint(2, 9)) + rng.choice([".", " All rights reserved.", ""]), 0) + (links(rng.randint(2, 6)) if rng.random() < 0.5 else "")
            if rng.random() < 0.3:
                labels.append(0)
                head += "&copy; " + words(rng.randint(2, 12))
        elif kind == "aside":
            body = block(rng.choice(["h2", "h3", "h4"]), words(rng.randint(1, 4)), 0) + "".join(block("p", sentence(rng.randint(3, 40)), 0) for _ in range(rng.randint(0, 3))) + (links(rng.randint(2, 6)) if rng.random() < 0.6 else "")
        elif kind == "form":
            body = block("div", words(rng.randint(1, 5)), 0)
            body += '<input type="text">' + block("button", words(1), 0)
        elif kind == "comments":
            body = block("h3", words(rng.randint(1, 3)), 0) + "".join(f'<div class="{rng.choice(names)}">' + block("p", sentence(rng.randint(2, 60)), 0) + "</div>" for _ in range(rng.randint(1, 4)))
        elif kind == "share":
            body = links(rng.randint(2, 5))
        else:
            one = rng.random() < 0.5
            body = block("p", sentence(rng.randint(2, 40)), 0) if one else ""
            if not one:
                labels.append(0)
                body = sentence(rng.randint(2, 40))
            if rng.random() < 0.3:
                body += block("button", words(1), 0)
        return head + body + f"</{tag}>"

    def article() -> str:
        tag = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
        plain = tag in ("div", "section")
        out = [f"<{tag}" + (f' class="{rng.choice(_MAIN_NAMES)}"' if plain and rng.random() < 0.85 else "") + ">"]
        inner = rng.random() < 0.25
        if inner:
            out.append(f'<div class="{rng.choice(_MAIN_NAMES)}">')
        if rng.random() < 0.8:
            title = block(rng.choice(["h1", "h1", "h2"]), words(rng.randint(1, 14)), 1)
            out.append(f"<header>{title}</header>" if rng.random() < 0.15 else title)
        for _ in range(rng.choice([0, 1, 2, 4, 7, 12])):
            kind = rng.random()
            text = sentence(length())
            if rng.random() < 0.15:
                text = f"<b>{text}<br>" if rng.random() < 0.5 else text + f' <a href="/{word()}">{words(2)}</a> ' + sentence(4)
            if kind < 0.73:
                out.append(block("p", text, 1))
            elif kind < 0.79:
                out.append(block(rng.choice(["h2", "h3"]), words(rng.randint(1, 6)), 1))
            elif kind < 0.85:
                out.append("<ul>" + "".join(block("li", sentence(rng.randint(2, 20)), 1) for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.88:
                out.append("<blockquote>" + block("p", text, 1) + "</blockquote>")
            elif kind < 0.9:
                out.append("<table><tr>" + "".join(block("td", words(rng.randint(1, 5)), 1) for _ in range(rng.randint(1, 4))) + "</tr></table>")
            elif kind < 0.92:
                out.append(block("pre", words(6), 1))
            else:
                out.append(side(rng.choice(["ad", "share", "aside", "notice", "form"])))
        if inner:
            out.append("</div>")
        if rng.random() < 0.12:
            out.append(side(rng.choice(["comments", "share", "ad"])))
        return "".join(out) + f"</{tag}>"

    def bare() -> str:
        """An article that nothing holds, or a nameless element: body-level blocks, one block, or text without tags."""
        out = []
        if rng.random() < 0.35:
            out.append(block(rng.choice(["h1", "h2"]), words(rng.randint(1, 14)), 1))
        for _ in range(rng.choice([1, 1, 1, 2, 3, 6])):
            kind = rng.random()
            if kind < 0.2 and (not out or out[-1].endswith(">")):
                labels.append(1)
                out.append(sentence(length()))
            else:
                out.append(block("div" if kind > 0.9 else "p", sentence(length()), 1))
        wrap = rng.random()
        return "".join(out) if wrap < 0.6 else f"<div>{''.join(out)}</div>" if wrap < 0.85 else f"<div><div>{''.join(out)}</div></div>"

    if rng.random() < BARE:
        sides = [side(k) if rng.random() < 0.15 else "" for k in ("nav", "header")]
        inner = "".join(sides) + bare() + "".join(side(k) if rng.random() < 0.15 else "" for k in ("comments", "ad", "footer"))
        return (inner if rng.random() < 0.4 else f"<html><head><title>{words(3)}</title></head><body>{inner}</body></html>"), labels
    page = ["<!DOCTYPE html><html><head><title>" + words(3) + "</title><script>var a = '<p>';</script></head><body>"]
    before = [k for k in ("header", "nav", "notice", "ad", "form", "aside") if rng.random() < 0.45]
    after = [k for k in ("aside", "comments", "share", "ad", "form", "notice", "nav", "footer") if rng.random() < 0.4]
    for k in before:
        page.append(side(k))
    page.append(article())
    for k in after:
        page.append(side(k))
    return "".join(page) + rng.choice(["</body></html>", ""]), labels


def labelled_pages(n: int, seed: int) -> list[tuple[list[list[str]], list[int]]]:
    rng, out = random.Random(seed), []
    while len(out) < n:
        html, labels = labelled_page(rng)
        blocks = blocks_of(html)
        if len(blocks) == len(labels):
            out.append((featured(blocks), labels))
    return out


@lru_cache(maxsize=4)
def default_model(pages: int = 1000, seed: int = 11) -> Crf:
    """The field trained on a bounded number of labelled pages, the same in every run."""
    return train(labelled_pages(pages, seed))


def extract(html: str | None, model: Crf, known: frozenset[str] | None = None) -> str:
    """The main text; known: the model's names, where they are at hand."""
    blocks = blocks_of(html, model.names if known is None else known)
    if not blocks:
        return ""
    return "\n".join(b.text for b, y in zip(blocks, model.decode(featured(blocks)), strict=True) if y)


def main_text(pages: DataFrame, *, html_col: str = "html", model: Crf | None = None) -> DataFrame:
    """The columns of pages without ``html_col``, with text and n_chars (its code points).

    Null and empty pages, and pages without main text, have an empty text.  Repeated rows are
    read each; an empty table gives an empty result; columns named text or n_chars are replaced.
    Each page is read whole, by one task, without a shuffle, in time linear in its size, however deep it nests.
    """
    shared = bounded(pages).sparkSession.sparkContext.broadcast(model or default_model())
    carry = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    at = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.names
        for batch in batches:
            texts = [extract(x.as_py(), shared.value, known) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*carry, "text", "n_chars"])

    schema = T.StructType([*(pages.schema[c] for c in carry), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*carry, F.col(html_col)).mapInArrow(tidy(run), schema)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
