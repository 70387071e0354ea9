"""Main text of web pages: gradient-boosted trees over DOM nodes and a decoding that keeps ancestors and descendants consistent.

A page becomes a tree of block elements; inline markup is transparent, so broken nesting of <b> or <a> does no harm. Each node has
features of its subtree (text density, link share, punctuation), attribute tokens, depth and siblings. Trees trained here
on generated pages (TRAIN_PAGES, a fixed seed) give each node log odds of holding article text. Decoding picks the labelling of
highest total in which nothing under a dropped node is kept and a kept node's ancestors are kept.

Text that stands loose in the body is a node of its own, so the trees label it like any other. Null, empty and tag-free pages: without text the
result is empty, else the text is one such node. A page with no article gives an empty text. Very long pages are read whole, in
linear time: an element that its end tag should close never takes the rest of the page with it, except an open script or style, whose rest is
no text. Repeated rows and null ids stay as they are, in any order; a node whose two labels tie is dropped. An empty table gives no
rows. Only page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm._shared import tune

TRAIN_PAGES = 700
TREES, DEPTH, RATE, BINS = 40, 4, 0.3, 32
#: Elements whose content is never markup or text of the page, elements without content, and elements that make a block.
RAW = frozenset("script style title textarea iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""html body div section article main header footer nav aside form fieldset ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 table thead
tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hgroup center menu dialog legend
select datalist optgroup option""".split())
#: Blocks that may stand inside a paragraph.
PHRASING = frozenset("select datalist optgroup option".split())
#: What a start tag closes if it is open above it: a paragraph ends at any block, list and table parts end at their like.
CLOSES = {"option": {"option"}, "optgroup": {"option", "optgroup"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
STOP = {"option": {"select", "datalist", "optgroup"}, "optgroup": {"select"}, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "thead": {"table"}, "tbody": {"table"}}
KINDS = ["nav", "footer", "header", "aside", "form", "article", "main", "section", "p", "li", "ul", "table", "div", "h", "body", "#text", "select"]
TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>|</?[a-zA-Z][^>]*\Z""",
    re.S,
)
#: The end tag of an element whose content is no markup.
SHUT = {tag: re.compile(rf"</{tag}(?![\w:-])[^>]*>", re.I) for tag in RAW}
ATTR = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PART = re.compile(r"[a-z]+")


class Page:
    """Block nodes in page order (parents before children) and text segments with their nodes."""

    __slots__ = ("attrs", "parents", "segments", "tags")

    def __init__(self, html: str):
        self.tags, self.parents, self.attrs = ["body"], [-1], [()]
        self.segments: list[tuple[int, str, int]] = []  # node, text, characters inside links
        tags, parents, attrs = self.tags, self.parents, self.attrs
        now, words, linked, in_link, at = 0, [], 0, False, 0
        open_ended: set[str] = set()  # raw elements that no end tag follows any more

        def flush() -> None:
            nonlocal words, linked
            if words:
                text = " ".join(unescape("".join(words)).split())
                if text:
                    node = now
                    if not now:  # loose in the body
                        node = len(tags)
                        tags.append("#text")
                        parents.append(0)
                        attrs.append(())
                    self.segments.append((node, text, min(linked, len(text))))
                words, linked = [], 0

        while m := TOKEN.search(html, at):
            lo = m.start()
            if lo > at:
                words.append(html[at:lo])
                if in_link:
                    linked += lo - at
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in RAW and not m["end"]:
                shut = None if tag in open_ended else SHUT[tag].search(html, at)
                if shut:
                    at = shut.end()
                elif tag in ("script", "style"):
                    at = len(html)
                else:
                    open_ended.add(tag)
                continue
            if tag not in BLOCK:
                if tag == "br":
                    words.append(" ")
                elif tag == "a":
                    in_link = not m["end"]
                elif tag == "hr":
                    flush()
                continue
            flush()
            in_link = False
            if tag in ("html", "body"):
                if tag == "body" and not m["end"] and m["attr"]:
                    attrs[0] = _tokens(m["attr"])
                continue
            if m["end"]:
                up = now
                while up > 0 and tags[up] != tag:
                    up = parents[up]
                if up > 0:
                    now = parents[up]
                continue
            if tag not in PHRASING and tags[now] == "p" or tags[now][0] == "h" and tags[now][1:].isdigit() and tag[0] == "h" and tag[1:].isdigit():
                now = parents[now]
            if tag in CLOSES:
                up, shut = now, STOP[tag]
                while up > 0 and tags[up] not in shut:
                    if tags[up] in CLOSES[tag]:
                        now = parents[up]
                    up = parents[up]
            tags.append(tag)
            parents.append(now)
            attrs.append(_tokens(m["attr"]) if m["attr"] else ())
            now = len(tags) - 1
        if at < len(html):
            words.append(html[at:])
        flush()


@lru_cache(maxsize=20_000)
def _tokens(attr: str) -> tuple[str, ...]:
    """Letters-only parts of class, id and role."""
    return tuple(dict.fromkeys(p for m in ATTR.finditer(attr) for p in PART.findall((m[1] or m[2] or m[3] or "").lower())))


N_FEATURES = 22 + len(KINDS)


def features(page: Page, odds: dict[str, float]) -> np.ndarray:
    """One row for each node."""
    n = len(page.tags)
    parent = page.parents
    own, link, segs, punct = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text, linked in page.segments:
        own[node] += len(text)
        link[node] += linked
        segs[node] += 1
        punct[node] += text.count(",") + text.count(". ") + text.endswith((".", "!", "?", "…"))
    chars, links, seg, pun, size, kids = own[:], link[:], segs[:], punct[:], [1] * n, [0] * n
    before, place = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        seg[p] += seg[i]
        pun[p] += pun[i]
        size[p] += size[i]
    total, seen = max(1, chars[0]), 0
    depth, bad, good, up_kind, alike = [0] * n, [0.0] * n, [0.0] * n, [0] * n, [0] * n
    same: dict[tuple[int, str], int] = defaultdict(int)
    ends = [0] * n
    for i in range(n):
        p, tag = parent[i], page.tags[i]
        score = [odds.get(t, 0.0) for t in page.attrs[i]]
        low, high = min(score, default=0.0), max(score, default=0.0)
        kind = -1 if tag in ("nav", "footer", "header", "aside", "form") else 1 if tag in ("article", "main") else 0
        if i:
            depth[i] = depth[p] + 1
            place[i] = kids[p]
            kids[p] += 1
            same[p, tag] += 1
            before[i] = ends[p]
            ends[i] = ends[p]
            bad[i], good[i] = min(bad[p], low), max(good[p], high)
            up_kind[i] = kind or up_kind[p]
            ends[p] += chars[i]
        else:
            bad[i], good[i], up_kind[i] = low, high, kind
        alike[i] = low if -low > high else high
    out = np.zeros((n, N_FEATURES))
    for i in range(n):
        p = max(parent[i], 0)
        c = chars[i]
        out[i, :22] = (
            c, links[i] / (c + 1), c / size[i], depth[i], kids[i], place[i], kids[p] if i else 0, c / total, pun[i] / (c + 1), own[i] / (c + 1), c / (seg[i] + 1e-9) if seg[i] else 0,
            alike[i], bad[i], good[i], up_kind[i], before[i] / total, same[p, page.tags[i]], links[p] / (chars[p] + 1), c / (chars[p] + 1), seg[i], pun[p] / (chars[p] + 1), len(page.attrs[i]),
        )
        tag = page.tags[i]
        k = "h" if tag[0] == "h" and tag[1:].isdigit() else "li" if tag in ("dd", "dt") else "ul" if tag in ("ol", "dl", "menu") else "table" if tag in ("tr", "td", "th", "tbody") else "select" if tag in PHRASING else tag
        if k in KINDS:
            out[i, 22 + KINDS.index(k)] = 1
    return out


class Boosted:
    """Logistic gradient boosting with complete binary trees over binned features."""

    def __init__(self):
        self.split, self.cut, self.leaf, self.bias = [], [], [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        flat = binned + np.arange(d) * BINS
        rate = y.mean()
        self.bias = float(np.log(rate / (1 - rate)))
        f = np.full(n, self.bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            split, cut, node = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf), np.zeros(n, np.int64)
            for level in range(DEPTH):
                base = 2**level - 1
                for k in range(base, 2 * base + 1):
                    rows = np.flatnonzero(node == k)
                    if len(rows) < 20:
                        continue
                    cells = flat[rows].ravel()
                    gs = np.bincount(cells, np.repeat(g[rows], d), d * BINS).reshape(d, BINS).cumsum(1)
                    hs = np.bincount(cells, np.repeat(h[rows], d), d * BINS).reshape(d, BINS).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, b] > 1e-6 and b < len(edges[j]):
                        split[k], cut[k] = j, edges[j][b]
                node = 2 * node + 1 + (x[np.arange(n), split[node]] > cut[node])
            at = node - (2**DEPTH - 1)
            leaf = -RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + 1)
            f += leaf[at]
            self.split.append(split)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.bias), np.arange(len(x))
        for split, cut, leaf in zip(self.split, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, split[node]] > cut[node])
            f += leaf[node - (2**DEPTH - 1)]
        return f


def decode(parents: list[int], odds: list[float]) -> list[bool]:
    """The labelling of highest total of +-odds in which the children of a dropped node are dropped. The root, which has no text, is kept."""
    n = len(parents)
    keep, drop = list(odds), [-x for x in odds]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    out = [True] * n
    for i in range(1, n):
        out[i] = out[parents[i]] and keep[i] > drop[i]
    return out


class Extractor:
    def __init__(self, trees: Boosted, token_odds: dict[str, float]):
        self.trees, self.token_odds = trees, token_odds

    def texts(self, pages: list[str | None]) -> list[str]:
        trees = [Page(h or "") for h in pages]
        if not trees:
            return []
        x = [features(t, self.token_odds) for t in trees]
        odds, at, out = self.trees.odds(np.concatenate(x)).tolist(), 0, []
        for t in trees:
            n = len(t.tags)
            kept = decode(t.parents, odds[at : at + n])
            at += n
            out.append("\n".join(text for node, text, _ in t.segments if kept[node]))
        return out


#: Words of class and id attributes in generated pages, by what they mark.
GOOD_NAMES = "article content main post entry story body text page single news blog".split()
BAD_NAMES = {
    "nav": "nav menu navigation breadcrumb topbar links navbar", "footer": "footer foot copyright bottom legal site-info", "header": "header masthead banner top logo branding", "aside": "sidebar aside related widget rail more popular trending",
    "ad": "ad ads advert sponsor promo adsense banner-ad sponsored", "notice": "cookie notice alert consent gdpr popup modal newsletter", "form": "form search subscribe login signup contact", "comments": "comments comment discussion replies respond disqus reader-comments", "share": "share social follow tags meta",
}


def generated_page(rng: random.Random) -> str:
    """A page whose article blocks carry the mark \\x01 in each text segment."""
    made = ["".join(rng.choice("aeiou" if k % 2 else "bcdfglmnprstv") for k in range(rng.randint(2, 9))) for _ in range(80)]
    word = lambda: rng.choice(made)

    def sentence(lo: int = 1, hi: int = 24) -> str:
        w = [word() for _ in range(rng.randint(lo, hi))]
        return (" ".join(w).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])).replace(" ", ", ", rng.random() < 0.4)

    def prose(k: int) -> str:
        return " ".join(sentence() for _ in range(k))

    def named(names: str | list[str]) -> str:
        names = names.split() if isinstance(names, str) else names
        r = rng.random()
        return "" if r < 0.2 else f' class="{rng.choice(names)}{rng.choice(["", "-wrap", " box", "-1"])}"' if r < 0.75 else f' id="{rng.choice(names)}"'

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{" ".join(word() for _ in range(rng.randint(1, 4)))}</a></li>' for _ in range(k)) + "</ul>"

    def choice() -> str:
        tag = rng.choice(["select", "select", "datalist"])
        return f"<{tag}>" + "".join(f"<option>{word()}" + rng.choice(["</option>", ""]) for _ in range(rng.randint(1, 6))) + f"</{tag}>"

    def extra(kind: str) -> str:
        names = BAD_NAMES[kind]
        tag = {"nav": "nav", "footer": "footer", "header": "header", "aside": "aside", "form": "form"}.get(kind, "div")
        tag = tag if rng.random() < 0.65 else rng.choice(["div", "section"])
        attr = named(names) if tag not in ("div", "section") else f' class="{rng.choice(names.split())}"' if rng.random() < 0.7 else f' id="{rng.choice(names.split())}"'
        inner = {
            "nav": lambda: links(rng.randint(3, 12)) if rng.random() < 0.8 else " | ".join(f"<a href='#'>{word()}</a>" for _ in range(6)), "footer": lambda: f"&copy; {word()}.example &middot; {sentence(2, 12)}" + (links(3) if rng.random() < 0.4 else ""),
            "header": lambda: f"<{(h := rng.choice(['h1', 'h2', 'div', 'p']))}><a href='/'>{word()} {word()}</a></{h}>" + (f"<p>{sentence(2, 8)}</p>" if rng.random() < 0.5 else ""), "aside": lambda: f"<h3>{word()}</h3>" + (links(rng.randint(3, 8)) if rng.random() < 0.6 else f"<p>{prose(rng.randint(1, 2))}</p>"),
            "ad": lambda: sentence(2, 20) if rng.random() < 0.6 else f"<p>{sentence(2, 20)}</p><a href='#'>{word()}</a>", "notice": lambda: f"<p>{prose(rng.randint(1, 2))}</p><a href='#'>{word()}</a>" if rng.random() < 0.7 else sentence(3, 20), "form": lambda: f"<label>{sentence(1, 4)}</label><input name='q'><p>{sentence(2, 8)}</p>" + (choice() if rng.random() < 0.4 else ""),
            "comments": lambda: f"<h3>{word()}</h3>" + "".join(f"<div class='{rng.choice(['comment', 'reply', 'c'])}'><b>{word()}</b><p>{prose(rng.randint(1, 3))}</p></div>" for _ in range(rng.randint(1, 5))) if rng.random() < 0.8 else "<ol>" + "".join(f"<li><p>{prose(rng.randint(1, 3))}</p></li>" for _ in range(3)) + "</ol>",
            "share": lambda: " ".join(f"<a href='#'>{word()}</a>" for _ in range(4)),
        }[kind]()
        return f"<{tag}{attr}>{inner}</{tag}>"

    def block() -> str:
        r = rng.random()
        m = "\x01"
        if r < 0.68:
            return f"<p>{m}{prose(rng.choice([1, 1, 2, 3, 5, 9]))}" + rng.choice(["</p>", "</p>", ""])
        if r < 0.76:
            return f"<{(h := rng.choice(['h2', 'h3', 'h4']))}>{m}{sentence(1, 9)}</{h}>"
        if r < 0.82:
            return "<ul>" + "".join(f"<li>{m}{sentence(1, 16)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        if r < 0.87:
            return f"<blockquote><p>{m}{prose(2)}</p></blockquote>"
        if r < 0.91:
            return "<table>" + "".join(f"<tr><td>{m}{word()}</td><td>{m}{sentence(1, 5)}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>"
        if r < 0.95:
            return f"<p><b>{m}{sentence(1, 9)}<br><p>{m}{prose(2)}</p>"
        return f"<div>{m}{prose(rng.randint(1, 4))}</div>"

    body = [block() for _ in range(rng.choice([1, 2, 3, 5, 8, 14]))]
    for kind in ("ad", "share", "aside", "notice", "comments", "form"):
        if rng.random() < 0.15:
            body.insert(rng.randint(0, len(body)), extra(kind))
    title = f"<h1>\x01{sentence(2, 12)}</h1>" if rng.random() < 0.85 else ""
    if title and rng.random() < 0.15:
        title = f"<header>{title}</header>"
    tag = rng.choice(["article", "article", "main", "div", "section"])
    attr = named(GOOD_NAMES) if tag in ("article", "main") else f' class="{rng.choice(GOOD_NAMES)}"' if rng.random() < 0.75 else ""
    core = f"<{tag}{attr}>{title}{''.join(body)}</{tag}>"
    if rng.random() < 0.35:
        core = f"<div{named(GOOD_NAMES)}>{core}{extra(rng.choice(['comments', 'share', 'aside'])) if rng.random() < 0.4 else ''}</div>"
    r = rng.random()
    if r < 0.06:  # an article that stands loose in the body
        core = f"{title}{''.join(body)}"
    elif r < 0.16:
        core = title + "<hr>".join("\x01" + "<br><br>".join(prose(rng.randint(2, 6)) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3)))

    def loose() -> str:
        """What is no article and stands loose in the body."""
        kind = rng.random()
        if kind < 0.4:
            return rng.choice([" | ", " &middot; ", " &raquo; ", " "]).join(word().capitalize() for _ in range(rng.randint(2, 7))) + (f"<br>{sentence(1, 5)}" if rng.random() < 0.4 else "")
        if kind < 0.7:
            return rng.choice([" | ", " - ", " "]).join(f"<a href='/{word()}'>{word()}</a>" for _ in range(rng.randint(1, 7)))
        return f"&copy; {rng.randint(1995, 2030)} {word()} {sentence(1, 6)}" if kind < 0.85 else sentence(2, 9)

    core = (choice() if rng.random() < 0.06 else "") + (loose() if rng.random() < 0.12 else "") + core + (f"<hr>{loose()}" if rng.random() < 0.12 else "")
    top = "".join(extra(k) for k in ("notice", "header", "nav", "ad", "form") if rng.random() < 0.5)
    end = "".join(extra(k) for k in ("aside", "comments", "ad", "form", "nav", "footer") if rng.random() < 0.45)
    return f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>{top}{core}{end}" + rng.choice(["</body></html>", ""])


def train(pages: int = TRAIN_PAGES, seed: int = 11) -> Extractor:
    rng = random.Random(seed)
    parsed, labels = [], []
    count: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for _ in range(pages):
        p = Page(generated_page(rng))
        y = [0] * len(p.tags)
        for node, text, _ in p.segments:
            if "\x01" in text:
                while node >= 0 and not y[node]:
                    y[node] = 1
                    node = p.parents[node]
        p.segments = [(a, t.replace("\x01", ""), c) for a, t, c in p.segments]
        parsed.append(p)
        labels.append(y)
        for tokens, v in zip(p.attrs, y, strict=True):
            for t in tokens:
                count[t][v] += 1
    odds = {t: float(np.log((b + 0.5) / (a + 0.5))) for t, (a, b) in count.items() if a + b >= 5}
    x = np.concatenate([features(p, odds) for p in parsed])
    return Extractor(Boosted().fit(x, np.concatenate([np.array(y, float) for y in labels])), odds)


@lru_cache(maxsize=1)
def trained() -> Extractor:
    return train()


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; repeated rows and null ids stay, other columns are not read."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html = b.column(2)
            for lo in range(0, len(b), 200):
                text = model.texts(html.slice(lo, 200).to_pylist())
                part = b.slice(lo, 200)
                yield pa.RecordBatch.from_pydict({"page_id": part.column(0), "url": part.column(1), "text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64())})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tune(spark)
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
