"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A tolerant scan turns a page into blocks of text with their ancestors. Each block has binary features
of its ancestor tags, their class and id words and its text; the chain says whether it is content. The
field is trained by gradient ascent on its conditional likelihood over labelled pages, which a seeded
generator writes in many layouts (no labelled pages come with the tables), and decoded by Viterbi.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe head".split())
#: Of these, the ones whose tag alone is dropped if no end tag follows; the others then reach to the end of the page.
LOST_END = frozenset("noscript template svg head".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var label wbr img br input ruby rt rp object param".split()) | frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction semantics annotation annotation-xml".split())
#: What an opening tag closes when it is open within the same container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("article aside blockquote body button caption center details dialog div dl fieldset figure footer form header html li main menu nav ol section table td th ul".split())

#: Elements that name a part of a page which is not its main text.
NAMED_PARTS = frozenset("nav aside footer header form dialog menu".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$))", re.S)
_MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Block:
    text: str
    tags: tuple[str, ...]
    marks: frozenset[str]
    linked: int


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks of text in order: runs of text and inline elements between block boundaries, with white space folded and character references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    buffer: list[str] = []
    links = linked = 0
    skip, at = None, 0
    endless: set[str] = set()

    def close():
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                marks = frozenset().union(*[m for _, m in stack])
                out.append(Block(text, tuple(t for t, _ in stack if t not in INLINE), marks, min(linked, len(text))))
        linked = 0

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if not skip and m.start() > at:
            piece = page[at : m.start()]
            buffer.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if skip:
                if name == skip:
                    skip = None
                continue
            if name in VOID:
                if name == "br":
                    buffer.append(" ")
                continue
            if name not in INLINE:
                close()
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if place is not None and (name in CONTAINERS or all(stack[i][0] not in CONTAINERS for i in range(place + 1, len(stack)))):
                del stack[place:]
                if name == "a":
                    links = max(links - 1, 0)
            continue
        if skip:
            continue
        if name in RAW and not (m[3] or "").endswith("/"):
            if name in endless:
                continue
            if name in ("head", "noscript"):  # their content is scanned for its end only
                end = re.compile(rf"</{name}\s*>|<body", re.I).search(page, at)
            else:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end is None:
                if name in LOST_END:
                    endless.add(name)  # nor does one follow any later tag of this name
                else:
                    skip = name
            else:
                at = end.start() if end[0].lower() == "<body" else end.end()
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name not in INLINE:
            close()
            shut = CLOSES.get(name, ("p",))
            if name not in CLOSES or name in ("li", "dt", "dd", "tr"):
                shut = (*shut, "p")
            limit = 0 if name in ("tr", "td", "th") else None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    del stack[i:]
                    break
                if stack[i][0] in CONTAINERS and limit is None or stack[i][0] in ("table", "ul", "ol", "dl", "select"):
                    break
        if name in VOID or (m[3] or "").endswith("/"):
            continue
        if name == "a":
            links += 1
        attrs = m[3]
        words = frozenset(w for g in _MARKS.findall(attrs) for x in g if x for w in _WORD.findall(_CAMEL.sub(" ", x).lower())) if attrs and "=" in attrs else frozenset()
        stack.append((name, words))
    if not skip and at < len(page):
        buffer.append(page[at:])
    close()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of each block's binary features."""
    n, out = len(blocks), []
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        f = ["bias", f"own:{b.tags[-1] if b.tags else ''}", f"words:{min(words.bit_length(), 7)}", f"links:{4 * b.linked // max(len(b.text), 1)}", f"stop:{b.text[-1] in '.!?…:;,'}", f"place:{0 if i == 0 else 1 if i < n // 2 else 2 if i < n - 1 else 3}"]
        f += [f"in:{t}" for t in set(b.tags)]
        f.append(f"path:{'/'.join(b.tags[-2:])}")
        f.append(f"apart:{bool(NAMED_PARTS.intersection(b.tags))}:{'article' in b.tags or 'main' in b.tags}")
        f += [f"mark:{w}" for w in b.marks]
        f.append(f"deep:{min(len(b.tags), 8)}")
        if "©" in b.text or "(c)" in b.text.lower():
            f.append("copyright")
        out.append(f)
    return out


@dataclass(frozen=True)
class Field:
    """Weights of features for content, and of the steps between labels (other, content)."""

    weights: dict[str, float]
    steps: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi: the most probable labels."""
        if not blocks:
            return []
        w, s = self.weights, self.steps
        emit = [sum(w.get(x, 0.0) for x in f) for f in features(blocks)]
        other, content, back = 0.0, emit[0], []
        for e in emit[1:]:
            a, b = other + s[0][0] >= content + s[1][0], other + s[0][1] >= content + s[1][1]
            back.append((0 if a else 1, 0 if b else 1))
            other, content = (other + s[0][0] if a else content + s[1][0]), (other + s[0][1] if b else content + s[1][1]) + e
        state, path = (1 if content > other else 0), []
        for step in reversed(back):
            path.append(state)
            state = step[state]
        return [x == 1 for x in reversed([*path, state])]


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 250, ridge: float = 2e-3) -> Field:
    """Maximise the penalised conditional likelihood, with forward and backward sums over all pages at once."""
    pages = [p for p in pages if p[0]]
    feats = [features(b) for b, _ in pages]
    names = sorted({x for f in feats for own in f for x in own})
    index = {x: i for i, x in enumerate(names)}
    n, t = len(pages), max(len(f) for f in feats)
    cell, code = [], []
    gold, live = np.zeros((n, t), bool), np.zeros((n, t), bool)
    for i, (f, (_, y)) in enumerate(zip(feats, pages, strict=True)):
        live[i, : len(f)] = True
        gold[i, : len(f)] = y
        for j, own in enumerate(f):
            cell += [i * t + j] * len(own)
            code += [index[x] for x in own]
    cell, code = np.array(cell), np.array(code)
    theta = np.zeros(len(names) + 4)
    speed = np.full(len(theta), 1e-6)
    both = live[:, 1:]
    seen = np.stack([np.stack([(both & (gold[:, :-1] == a) & (gold[:, 1:] == b)).sum() for b in (0, 1)]) for a in (0, 1)]).astype(float)
    for _ in range(rounds):
        emit = np.zeros((n, t, 2))
        emit[:, :, 1] = np.bincount(cell, theta[code], n * t).reshape(n, t)
        step = theta[-4:].reshape(2, 2)
        ahead, behind = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        ahead[:, 0] = emit[:, 0]
        for j in range(1, t):
            new = np.logaddexp(ahead[:, j - 1, :1] + step[0], ahead[:, j - 1, 1:] + step[1]) + emit[:, j]
            ahead[:, j] = np.where(live[:, j, None], new, ahead[:, j - 1])
        for j in range(t - 2, -1, -1):
            x = emit[:, j + 1] + behind[:, j + 1]
            new = np.logaddexp(step[:, 0] + x[:, :1], step[:, 1] + x[:, 1:])
            behind[:, j] = np.where(live[:, j + 1, None], new, 0)
        z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        p = np.where(live, np.exp(np.clip(ahead[:, :, 1] + behind[:, :, 1] - z[:, None], -50, 0)), 0)
        grad = np.zeros(len(theta))
        grad[: len(names)] = np.bincount(code, (gold.astype(float) - p).ravel()[cell], len(names))
        pair = ahead[:, :-1, :, None] + step[None, None] + (emit + behind)[:, 1:, None, :] - z[:, None, None, None]
        grad[-4:] = (seen - np.where(both[:, :, None, None], np.exp(np.clip(pair, -50, 0)), 0).sum((0, 1))).ravel()
        grad = grad / n - ridge * theta
        speed += grad**2
        theta += 0.3 * grad / np.sqrt(speed)
    step = theta[-4:].reshape(2, 2).tolist()
    return Field({x: float(w) for x, w in zip(names, theta, strict=False) if abs(w) > 1e-4}, (tuple(step[0]), tuple(step[1])))


# --- labelled pages -------------------------------------------------------------------------------

# Class words that the generator uses, by the part they name: a choice of its own.
_MARK_WORDS = {
    "menu": "nav menu navbar navigation breadcrumb topbar links tabs pagination pager skip".split(),
    "header": "header masthead banner top site branding logo".split(),
    "footer": "footer bottom legal copyright colophon".split(),
    "sidebar": "sidebar aside widget rail related recommended popular trending tags author bio secondary".split(),
    "notice": "notice cookie consent gdpr alert popup modal overlay message subscribe paywall disclaimer".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense banner dfp".split(),
    "form": "form search newsletter signup login subscribe contact".split(),
    "comments": "comments comment reply responses discussion disqus thread respond".split(),
    "share": "share social sharing follow buttons toolbar".split(),
    "content": "content article post entry story body main text page single hentry prose".split(),
}


def training_pages(count: int = 500, seed: int = 7) -> list[tuple[list[Block], list[bool]]]:
    """Labelled pages: random layouts whose content blocks are known. Letters stand for words, so nothing is learnt from vocabulary."""
    r = random.Random(seed)
    parts = "an er on the in re th en ou la de ch ung ció mente que is ver ble st".split()

    def word():
        return "".join(r.choice(parts) for _ in range(r.choice((1, 1, 2, 2, 3))))

    def words(n):
        return " ".join(word() for _ in range(n))

    def sentence(n=None):
        return words(n or r.randint(3, 18)).capitalize() + r.choice(("." ,) * 8 + ("?", "!", "", "", ""))

    def paragraph():
        return sentence(r.randint(1, 2)) if r.random() < 0.15 else " ".join(sentence() for _ in range(r.choice((1, 1, 2, 4, 8))))

    def mark(kind, p=0.75):
        if r.random() > p:
            return ""
        own = r.sample(_MARK_WORDS[kind], r.choice((1, 1, 2)))
        return f' {r.choice(("class", "class", "id"))}="{r.choice(("-", " ", "_")).join(own)}"'

    def listing(n, linked=True):
        return "<ul>" + "".join(f"<li><a href='/x'>{words(r.randint(1, 4))}</a></li>" if linked else f"<li>{words(r.randint(1, 4))}</li>" for _ in range(n)) + "</ul>"

    def noise(kind):
        short = lambda: r.choice((words(r.randint(1, 6)), sentence(), sentence(), paragraph()))
        if kind == "menu":
            tag = r.choice(("nav", "nav", "div", "ul"))
            return f"<{tag}{mark('menu', 1 if tag != 'nav' else 0.5)}>{listing(r.randint(2, 8))}</{tag}>"
        if kind == "header":
            return f"<header{mark('header', 0.5)}><div>{words(2)}</div><p>{short()}</p></header>" if r.random() < 0.7 else f"<div{mark('header', 1)}>{words(3)}</div>"
        if kind == "footer":
            tag = r.choice(("footer", "footer", "div"))
            return f"<{tag}{mark('footer', 1 if tag == 'div' else 0.4)}>{r.choice(('&copy; ', '', '© 2020 '))}{short()}{r.choice(('', listing(3), '<p>' + short() + '</p>'))}</{tag}>"
        if kind == "sidebar":
            tag = r.choice(("aside", "aside", "div", "section"))
            return f"<{tag}{mark('sidebar', 1 if tag != 'aside' else 0.5)}><h3>{words(2)}</h3>{r.choice((listing(4), f'<p>{short()}</p>', f'<p>{paragraph()}</p>'))}</{tag}>"
        if kind == "advert":
            tag = r.choice(("div", "div", "aside", "section", "p"))
            return f"<!-- ad --><{tag}{mark('advert', 1)}>{short()}</{tag}>"
        if kind == "form":
            return f"<form{mark('form', 0.5)}><label>{words(2)}</label><input name=q><p>{short()}</p><button>{words(1)}</button></form>"
        if kind == "comments":
            tag = r.choice(("section", "div", "ol"))
            one = lambda: f"<{r.choice(('div', 'li', 'article'))}{mark('comments', 0.6)}><b>{word()}</b><p>{r.choice((sentence(), paragraph()))}</p></div>"
            return f"<{tag}{mark('comments', 1)}><h3>{words(1)}</h3>{''.join(one() for _ in range(r.randint(1, 4)))}</{tag}>"
        tag = r.choice(("div", "section", "p", "dialog"))
        return f"<{tag}{mark(kind, 1)}>{short()}{r.choice(('', '<button>' + words(1) + '</button>'))}</{tag}>"

    def article():
        mine = []

        def keep(t):
            mine.append(f"\x01{t}")
            return f"\x01{t}"

        body = []
        if r.random() < 0.85:
            body.append(f"<h1>{keep(words(r.randint(2, 12)))}</h1>")
        for _ in range(r.randint(1, 9)):
            x = r.random()
            if x < 0.7:
                t = keep(paragraph())
                body.append(r.choice((f"<p>{t}</p>", f"<p>{t}</p>", f"<p><b>{t}<br>", f"<p>{t}", f"<div>{t}</div>", f"<p>{t} <a href='/y'>{word()}</a>.</p>")))
            elif x < 0.8:
                body.append(f"<h2>{keep(words(3))}</h2>")
            elif x < 0.87:
                body.append("<ul>" + "".join(f"<li>{keep(sentence())}</li>" for _ in range(3)) + "</ul>")
            elif x < 0.92:
                body.append(f"<blockquote>{keep(paragraph())}</blockquote>")
            else:
                body.append(noise(r.choice(("advert", "share", "sidebar", "form", "notice"))))
        tag = r.choice(("article", "article", "article", "main", "div", "section"))
        if r.random() < 0.12:  # laid out as a table
            side = lambda: f"<td{mark(r.choice(('menu', 'sidebar', 'advert')), 1)}>{r.choice((listing(r.randint(2, 6)), '<p>' + sentence() + '</p>'))}</td>"
            cells = [f"<td{mark('content', 0.5)}>{''.join(body)}</td>", *[side() for _ in range(r.randint(1, 2))]]
            r.shuffle(cells)
            return f"<table{mark('content', 0.2)}>{r.choice(('', '<tbody>'))}<tr>{''.join(cells)}</tr></table>"
        inner = f"<{tag}{mark('content', 0.5 if tag in ('article', 'main') else 0.95)}>{''.join(body)}</{tag}>"
        return f"<main{mark('content', 0.3)}>{inner}</main>" if r.random() < 0.3 and tag != "main" else inner

    out = []
    for i in range(count):
        if i % 25 == 24:
            page = "".join(f"<p>\x01{paragraph()}</p>" for _ in range(r.randint(1, 4))) if i % 50 == 24 else "\x01" + paragraph()
        else:
            before = [noise(k) for k in r.sample(("menu", "header", "notice", "advert", "form", "share", "menu"), r.randint(0, 4))]
            after = [noise(k) for k in r.sample(("comments", "sidebar", "advert", "share", "menu", "notice", "form"), r.randint(0, 4))]
            page = f"<html><head><title>{words(4)}</title></head><body>{''.join(before)}{article()}{''.join(after)}{noise('footer') if r.random() < 0.8 else ''}</body></html>"
        blocks = leaf_blocks(page)
        labels = [b.text.startswith("\x01") for b in blocks]
        for b in blocks:
            b.text = b.text.lstrip("\x01")
        out.append((blocks, labels))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(training_pages())


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, keep in zip(blocks, field.decode(blocks), strict=True) if keep)


def _extractor(carried, id_name: str, url_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = carried.value
        for batch in batches:
            text = [main_text(h or "", field) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_name), batch.column(url_name), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [id_name, url_name, "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: Field | None = None) -> DataFrame:
    """One row per page row: id, url, text (content blocks joined by blank lines; empty if none), n_chars.

    A null page is empty; repeated rows each get their row; very long and deeply nested pages are read whole; an
    empty table has no rows; columns other than the three named are not read, whatever their names.
    """
    picked = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("html"))
    id_name, url_name = picked.columns[:2]
    carried = pages.sparkSession.sparkContext.broadcast(field or default_field())  # some thousand weights
    kinds = ", ".join(f"{c} {picked.schema[c].dataType.simpleString()}" for c in (id_name, url_name))
    return picked.mapInArrow(_extractor(carried, id_name, url_name), f"{kinds}, text string, n_chars long")
