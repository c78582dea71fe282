"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page becomes its leaf blocks: runs of text between block-level tags (and line breaks). Scripts,
styles, comments and other text that a page does not show are no blocks. Each block has features
of its ancestors (tag names and words of their class, id and role) and of its text (length, share
of links, sentence ends, notices). A linear chain of two states, article or not, is trained by
maximum likelihood on labelled pages and decoded by Viterbi; the text is the article blocks in
page order, white space made one space, joined by one space.

The labelled pages are ``labelled_pages``: layouts of common kinds of sites, with and without
semantic tags, filled with random words; every block's label is known. Training takes ``PAGES`` of
them whatever the input, on the driver; the weights (a few thousand numbers) are sent to the
workers, and extraction is one narrow pass over the rows.

Defined results: null or empty html gives an empty text; so does a page without article blocks;
tags that never end, end twice or cross are mended as browsers do, roughly, but what follows a player, a
picture, a form field or the like that never ends is text; repeated rows each get a row.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.common import table

PAGES, STEPS, RATE, RIDGE, SEED = 600, 150, 0.1, 1e-3, 11
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""(?:^|[\s"'])(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style noscript template title textarea iframe svg math object select datalist canvas audio video xmp noembed noframes".split())
#: What these hold is never text of the page, even if they do not end; the others of _UNSEEN are passed over where they do not.
_CODE = frozenset("script style".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_BARS = frozenset("ul ol dl table tbody thead".split())
#: Words of class, id and role that a feature may carry; others are left out, so the features stay few.
HINTS = frozenset(
    "ad ads advert advertisement sponsored sponsor promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot bottom "
    "sidebar side aside widget related recommended popular trending share social cookie cookies consent notice notification alert popup modal gdpr newsletter subscribe "
    "signup login search form comment comments reply replies disqus discussion respond article post entry content main body story text page tags tag meta author byline "
    "pagination pager toc copyright legal skip logo complementary contentinfo".split()
)
_WORD = re.compile(r"[a-z]+")
_NOTICE = re.compile(r"©|\(c\)|copyright|all rights reserved|cookie|subscribe|sign up|newsletter|log ?in|privacy|terms of|advert|sponsor", re.I)


def _ancestor(tag: str, attrs: str) -> tuple[str, ...]:
    out = [f"in:{tag}"]
    if "=" in attrs:
        for m in _ATTR.finditer(attrs):
            value = (m[1] or m[2] or m[3] or "").lower()
            out += [f"hint:{w}" for w in _WORD.findall(value) if w in HINTS]
    return tuple(out)


class Tags:
    """The tags of a page from left to right: (start, end, name in lower case, whether it closes, attributes); a comment has no name.

    A tag ends at the first > outside of quotation marks, or, if such a mark never closes, at the first > at all. Time is in
    proportion to the page, whatever it holds: where no mark or > follows, and which marks led nowhere, is remembered.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.dead: set[int] = set()
        self.gone: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        """Like str.find; once nothing is found, nothing is searched again behind that place."""
        if at >= self.gone.get(what, len(self.page) + 1):
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.gone[what] = min(at, self.gone.get(what, at))
        return k

    def _end(self, at: int) -> int:
        seen, pos = [], at
        while (m := _STOP.search(self.page, pos)) is not None:
            k = m.start()
            if m[0] == ">":
                return k + 1
            if k in self.dead:
                break
            seen.append(k)
            close = self.find(m[0], k + 1)
            if close < 0:
                break
            pos = close + 1
        self.dead.update(seen)
        return self.find(">", at) + 1

    def after(self, at: int) -> tuple[int, int, str, bool, str] | None:
        page = self.page
        while (i := page.find("<", at)) >= 0:
            if page.startswith("<!--", i) or page.startswith("<![CDATA[", i):
                mark = "-->" if page[i + 2] == "-" else "]]>"
                end = self.find(mark, i + 4)
                return i, end + 3 if end >= 0 else len(page), "", False, ""
            if (first := self.find(">", i + 1)) >= 0:
                if page[i + 1] in "!?":
                    return i, first + 1, "", False, ""
                if m := _NAME.match(page, i + 1, first + 1):
                    end = self._end(m.end())
                    return i, end, m[2].lower(), bool(m[1]), page[m.end() : end - 1]
            at = i + 1
        return None


def blocks(page: str) -> list[tuple[str, list[str]]]:
    """(text, features) of each leaf block in page order."""
    found: list[tuple[str, list[str]]] = []
    open_tags: list[tuple[str, tuple[str, ...]]] = []
    places: dict[str, list[int]] = {}  # of each tag name, where it is in open_tags
    inside: dict[str, int] = {}
    parts: list[str] = []
    linked, total, links = 0, 0, 0
    nearest: list[str] = []

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                found.append((text, [*inside, *_features(text, linked / max(1, total), nearest)]))
            parts.clear()
        linked = total = 0

    def pop(upto: int) -> None:
        while len(open_tags) > upto:
            tag, own = open_tags.pop()
            places[tag].pop()
            for f in own:
                if inside[f] == 1:
                    del inside[f]
                else:
                    inside[f] -= 1

    at, end = 0, len(page)
    tags, unclosed = Tags(page), set()
    while at < end:
        found_tag = tags.after(at)
        stop = found_tag[0] if found_tag else end
        if stop > at:
            parts.append(page[at:stop])
            total += stop - at
            linked += (stop - at) if links else 0
        if not found_tag:
            break
        _, at, tag, closing, attrs = found_tag
        if not tag:
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        flush()
        if tag in _VOID:
            continue
        if tag in _UNSEEN:
            if not closing and not attrs.endswith("/") and tag not in unclosed:
                last = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                over = tags.find(">", last.end()) + 1 if last else 0
                if over or tag in _CODE:
                    at = over or end
                else:
                    unclosed.add(tag)  # none ends behind this place: what follows is the page's own text
            continue
        if closing:
            if places.get(tag):
                pop(places[tag][-1])
            links = 0
        else:
            if open_tags and open_tags[-1][0] == "p":
                pop(len(open_tags) - 1)
            if tag in _CLOSES:
                # what the tag ends, from the outermost inside the nearest bar
                bar = max((places[x][-1] for x in _BARS - _CLOSES[tag] if places.get(x)), default=-1)
                ended = [found_at[k] for x in _CLOSES[tag] if (found_at := places.get(x)) and (k := bisect_right(found_at, bar)) < len(found_at)]
                if ended:
                    pop(min(ended))
            own = _ancestor(tag, attrs)
            places.setdefault(tag, []).append(len(open_tags))
            open_tags.append((tag, own))
            for f in own:
                inside[f] = inside.get(f, 0) + 1
        nearest[:] = [f"at:{open_tags[-1][0]}"] if open_tags else ["at:"]
    flush()
    return found


def _features(text: str, linked: float, nearest: list[str]) -> list[str]:
    n = len(text)
    size = 0 if n < 15 else 1 if n < 40 else 2 if n < 80 else 3 if n < 160 else 4 if n < 400 else 5
    link = 0 if linked < 0.05 else 1 if linked < 0.4 else 2 if linked < 0.9 else 3
    out = ["one", f"size:{size}", f"link:{link}", f"size:{size} link:{link}", f"end:{text[-1] in '.!?:;…。！？'}", *nearest]
    if n < 400 and _NOTICE.search(text):
        out.append("notice")
    return out


class Chain:
    """Weights by feature for the two states, and of the four transitions and two starts."""

    def __init__(self, weights: dict[str, tuple[float, float]], step: list[list[float]], first: list[float]) -> None:
        self.weights, self.step, self.first = weights, step, first

    def decode(self, features: list[list[str]]) -> list[int]:
        """The likeliest states, by Viterbi."""
        if not features:
            return []
        (a, b), (c, d) = self.step
        back: list[tuple[int, int]] = []
        x = y = 0.0
        none = (0.0, 0.0)
        for i, own in enumerate(features):
            e0 = e1 = 0.0
            for f in own:
                w = self.weights.get(f, none)
                e0 += w[0]
                e1 += w[1]
            if i == 0:
                x, y = self.first[0] + e0, self.first[1] + e1
                continue
            from0, from1 = (0 if x + a >= y + c else 1), (0 if x + b > y + d else 1)
            x, y = max(x + a, y + c) + e0, max(x + b, y + d) + e1
            back.append((from0, from1))
        state = int(y > x)
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS) -> Chain:
    """Maximum likelihood with a ridge, by Adam on exact gradients (forward-backward over all pages at once)."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    n, most = len(pages), max(len(f) for f, _ in pages)
    rows, cols = [], []
    y, mask = np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    for i, (features, labels) in enumerate(pages):
        for j, own in enumerate(features):
            for f in own:
                rows.append(i * most + j)
                cols.append(names.setdefault(f, len(names)))
        y[i, : len(labels)], mask[i, : len(labels)] = labels, True
    rows, cols = np.array(rows), np.array(cols)
    k = len(names)
    theta = np.zeros(2 * k + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    real = np.zeros_like(theta)
    for s in (0, 1):
        real[s * k : (s + 1) * k] = np.bincount(cols, weights=(y.ravel()[rows] == s).astype(float), minlength=k)
        real[2 * k + 4 + s] = (y[:, 0] == s).sum()
        for t in (0, 1):
            real[2 * k + 2 * s + t] = (mask[:, 1:] & (y[:, :-1] == s) & (y[:, 1:] == t)).sum()
    for it in range(1, steps + 1):
        step, first = theta[2 * k : 2 * k + 4].reshape(2, 2), theta[2 * k + 4 :]
        e = np.stack([np.bincount(rows, weights=theta[s * k + cols], minlength=n * most).reshape(n, most) for s in (0, 1)], axis=2)
        fwd, bwd = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        fwd[:, 0] = first + e[:, 0]
        for j in range(1, most):
            fwd[:, j] = np.logaddexp(fwd[:, j - 1, 0:1] + step[0], fwd[:, j - 1, 1:2] + step[1]) + e[:, j]
            fwd[:, j] = np.where(mask[:, j, None], fwd[:, j], fwd[:, j - 1])
        for j in range(most - 2, -1, -1):
            nxt = e[:, j + 1] + bwd[:, j + 1]
            back = np.stack([np.logaddexp(step[s, 0] + nxt[:, 0], step[s, 1] + nxt[:, 1]) for s in (0, 1)], axis=1)
            bwd[:, j] = np.where(mask[:, j + 1, None], back, 0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        node = np.exp(fwd + bwd - z[:, None, None]) * mask[:, :, None]
        want = np.zeros_like(theta)
        for s in (0, 1):
            want[s * k : (s + 1) * k] = np.bincount(cols, weights=node[:, :, s].ravel()[rows], minlength=k)
            want[2 * k + 4 + s] = node[:, 0, s].sum()
            for t in (0, 1):
                edge = np.exp(fwd[:, :-1, s] + step[s, t] + e[:, 1:, t] + bwd[:, 1:, t] - z[:, None]) * mask[:, 1:]
                want[2 * k + 2 * s + t] = edge.sum()
        grad = (want - real) / n + RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= RATE * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.999**it)) + 1e-8)
    weights = {f: (float(theta[i]), float(theta[k + i])) for f, i in names.items()}
    return Chain(weights, theta[2 * k : 2 * k + 4].reshape(2, 2).tolist(), theta[2 * k + 4 :].tolist())


class _Site:
    """Writes one labelled page: html, and the label of each text."""

    def __init__(self, rng: random.Random) -> None:
        self.rng, self.labels, self.count = rng, {}, 0

    def words(self, low: int, high: int, end: str = "") -> str:
        self.count += 1
        made = ["".join(self.rng.choice("bcdfglmnprst") + self.rng.choice("aeiouéü") for _ in range(self.rng.randint(1, 4))) for _ in range(self.rng.randint(low, high))]
        return (" ".join([f"w{self.count}x", *made]) + end).capitalize()

    def leaf(self, tag: str, text: str, label: int, attrs: str = "") -> str:
        self.labels[text] = label
        return f"<{tag}{attrs}>{text}</{tag}>"

    def box(self, names: tuple[str, ...], inner: str) -> str:
        """The inner html in a tag of that name, or a div with such a class, or a div without."""
        rng, name = self.rng, self.rng.choice(names)
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "article": "article", "main": "main", "form": "form", "comments": "section", "cookie": "div", "ad": "div"}
        how = rng.random()
        if how < 0.45:
            return f'<{semantic.get(name, "div")}{f" class={chr(34)}{name}{chr(34)}" if rng.random() < 0.4 else ""}>{inner}</{semantic.get(name, "div")}>'
        if how < 0.9:
            return f'<div {rng.choice(["class", "id"])}="{rng.choice(["", "site-", "c-", "x "])}{name}">{inner}</div>'
        return f"<div>{inner}</div>"

    def links(self, low: int, high: int, label: int = 0) -> str:
        rows = []
        for _ in range(self.rng.randint(low, high)):
            text = self.words(0, 2)
            self.labels[text] = label
            rows.append(f'<li><a href="/{self.count}">{text}</a></li>' if self.rng.random() < 0.85 else f"<li>{text}</li>")
        return f"<ul>{''.join(rows)}</ul>"

    def paragraph(self) -> str:
        rng = self.rng
        text = self.words(*rng.choice([(0, 3), (3, 12), (12, 40), (40, 160)]), rng.choice([".", ".", ".", "!", "?", "", ":"]))
        kind = rng.random()
        if kind < 0.12:
            more = self.words(2, 9, ".")
            self.labels[text] = self.labels[more] = 1
            return f"<p><b>{text}<br>{more}"
        if kind < 0.22:
            return self.leaf("h2", text[:60].strip(), 1)
        if kind < 0.3:
            return f"<ul>{self.leaf('li', text, 1)}{self.leaf('li', self.words(1, 14, '.'), 1)}</ul>"
        if kind < 0.36:
            return f"<blockquote>{self.leaf('p', text, 1)}</blockquote>"
        if kind < 0.42:
            return f"<table><tr>{self.leaf('td', text, 1)}{self.leaf('td', self.words(0, 3), 1)}</tr></table>"
        return self.leaf("div" if kind < 0.47 else "p", text, 1)

    def page(self) -> str:
        rng, say = self.rng, self.words
        chance = lambda p: rng.random() < p
        ad = lambda: self.box(("ad", "ads", "advert", "sponsored", "banner", "promo"), self.leaf(rng.choice(["p", "div", "span"]), say(*rng.choice([(2, 8), (8, 30)]), rng.choice(["", "."])), 0))
        def side() -> str:
            rows = [self.leaf(rng.choice(["h3", "h4"]), say(0, 2), 0), self.links(2, 6) if chance(0.6) else self.leaf("p", say(6, 50, "."), 0)]
            return self.box(("sidebar", "related", "widget", "share", "popular", "tags"), "".join(rows))
        def form() -> str:
            return f"<form>{self.leaf('label', say(0, 3), 0)}<input name=q>{self.leaf('button', say(0, 1), 0)}{self.leaf('p', say(4, 20, '.'), 0) if chance(0.4) else ''}</form>"
        def cookie() -> str:
            text = f"{say(0, 2)} {rng.choice(['cookies', 'privacy', 'subscribe', 'newsletter', 'notice'])} {say(3, 20, '.')}"
            return self.box(("cookie", "consent", "notice", "newsletter", "alert", "popup"), self.leaf(rng.choice(["p", "div"]), text, 0))
        def comments() -> str:
            rows = [self.leaf("h3", say(0, 2), 0)]
            for _ in range(rng.randint(1, 5)):
                rows.append(self.box(("comment", "reply"), self.leaf("p", say(*rng.choice([(2, 10), (10, 60)]), "."), 0)) if chance(0.7) else self.leaf("p", say(3, 60, "."), 0))
            inner = "".join(rows)
            return f'<section class="{rng.choice(["comments", "discussion", "replies"])}">{inner}</section>' if chance(0.6) else f'<div id="comments">{inner}</div>'
        top = []
        if chance(0.3):
            top.append(cookie())
        if chance(0.5):
            top.append(self.box(("header", "masthead", "topbar"), self.leaf(rng.choice(["h1", "div", "p"]), say(0, 4), 0) + (self.leaf("p", say(2, 9), 0) if chance(0.4) else "")))
        if chance(0.85):
            top.append(self.box(("nav", "menu", "navigation", "breadcrumb"), self.links(3, 9)))
        if chance(0.4):
            top.append(ad())
        if chance(0.2):
            top.append(form())
        body = [self.leaf(rng.choice(["h1", "h1", "h2"]), say(1, 9), 1)] if chance(0.85) else []
        if chance(0.25):
            body.append(f'<div class="{rng.choice(["byline", "meta", "author"])}">{say(1, 5)}</div>')
            self.labels[body[-1][body[-1].index(">") + 1 : -6]] = 0
        for _ in range(rng.choice([1, 2, 4, 8, 14])):
            body.append(self.paragraph())
            if chance(0.05):
                body.append(ad())
            if chance(0.03):
                body.append(f"<aside>{self.leaf('p', say(4, 30, '.'), 0)}</aside>")
        if chance(0.15):
            body.append(comments())
        inner = "".join(body)
        main = self.box(("article", "article", "main", "content", "post", "entry", "story"), inner) if chance(0.9) else inner
        rest = [f() for f, p in ((side, 0.4), (ad, 0.25), (comments, 0.25), (form, 0.15), (cookie, 0.1)) if chance(p)]
        first = [side()] if chance(0.2) else []
        text = f"&copy; {say(0, 3)} &middot; {say(1, 14, rng.choice(['', '.']))}"
        self.labels[entities.unescape(text)] = 0
        foot = self.box(("footer", "foot", "bottom"), (self.links(1, 5) if chance(0.3) else "") + text) if chance(0.85) else ""
        return f"<!DOCTYPE html><html><head><title>{say(1, 6)}</title><script>var a='<p>';</script></head><body>{''.join(top)}{''.join(first)}{main}{''.join(rest)}{foot}" + ("</body></html>" if chance(0.8) else "")


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, dict[str, int]]]:
    """n pages with the label (1: article) of every text in them."""
    out = []
    for i in range(n):
        site = _Site(random.Random(f"{seed} {i}"))
        out.append((site.page(), site.labels))
    return out


def model() -> Chain:
    """The chain trained on the labelled pages; trained once for each driver."""
    if not _trained:
        rows = []
        for page, labels in labelled_pages():
            found = [(labels[t], f) for t, f in blocks(page) if t in labels]
            rows.append(([f for _, f in found], [y for y, _ in found]))
        _trained.append(train(rows))
    return _trained[0]


_trained: list[Chain] = []


def extract(page: str | None, chain: Chain) -> str:
    """The main text of one page."""
    found = blocks(page) if page else []
    return " ".join(t for (t, _), s in zip(found, chain.decode([f for _, f in found]), strict=True) if s)


def main_text(pages: DataFrame, html_col: str = "html", text_col: str = "main_text", chain: Chain | None = None) -> DataFrame:
    """``pages`` with the main text of each whole html in ``text_col``."""
    sent = pages.sparkSession.sparkContext.broadcast(chain or model())
    pages = pages.select(*[c for c in pages.columns if c != text_col])
    where = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [extract(x.as_py(), own) for x in batch.column(where)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return pages.mapInArrow(run, pages.withColumn(text_col, F.lit(None).cast("string")).schema)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
