"""Main-text extraction by a linear-chain conditional random field.

A page becomes a sequence of leaf blocks: stretches of text between block-level
tags, each with its ancestors.  Features are the ancestors' tags, words in
their class and id names, and properties of the text.  The field has two
labels, article and other; it is trained on labelled pages and decoded by
Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A well-formed tag; reaches over no other ``<``.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*)([^<>"']*(?:"[^"<>]*"[^<>"']*|'[^'<>]*'[^<>"']*)*)>""")
NAME_END, MARK = re.compile(r"[\s/>]|\Z"), re.compile("""[>"']""")
ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
SPACE = re.compile(r"[\x20\x09-\x0D]+")
SKIP = frozenset("script style noscript template svg iframe select textarea head title object canvas".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
 fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre
 section summary table tbody td tfoot th thead tr ul""".split())
RAW, SIBLINGS = frozenset("script style textarea title".split()), frozenset("li td th tr dd dt".split())
#: Words of class, id and role names that say what an element is for.
HINTS = {
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion banner",
    "nav": "nav navigation menu breadcrumb breadcrumbs pagination pager toc",
    "head": "header masthead topbar branding logo", "foot": "footer foot copyright colophon legal",
    "side": "sidebar aside widget widgets rail related recommended trending popular",
    "note": "cookie cookies consent notice alert gdpr popup modal overlay subscribe newsletter paywall",
    "form": "form search login signup contact", "talk": "comment comments reply replies discussion disqus respondents",
    "share": "share social follow",
    "body": "content article post entry story main text body hentry prose",
}
HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}
NAME = re.compile(r"[a-z]+")
#: A decimal reference of so many digits that ``int`` refuses it.
LONG_REF = re.compile(r"&#([0-9]{1000,});?")
#: Open elements; one more takes the place of the innermost, as in browsers.
MAX_DEPTH = 512


def unescape(text: str) -> str:
    """Text with its character references decoded, however long they are."""
    return html.unescape(LONG_REF.sub(lambda m: f"&#{m[1].lstrip('0')[:8] or '0'};", text))


class Tags:
    """The tags of a page, in time linear in it whatever is unclosed.

    Outside a well-formed tag, where an attribute part ends depends only on the
    next ``>`` or quote, so it is found once per such mark; positions asked for
    only grow."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "<>\"'"}
        self.ends: dict[int, int] = {}
        self.mark = self.name_end = -1

    def end_of(self, start: int) -> int:
        """Position of the ``>`` outside quotes at or after ``start``, or -1."""
        if self.mark < start:
            m = MARK.search(self.page, start)
            self.mark = m.start() if m else len(self.page)
        at, seen = self.mark, []
        while True:
            if at in self.ends:
                end = self.ends[at]
                break
            if at == len(self.page):
                end = -1
                break
            c = self.page[at]
            if c == ">":
                end = at
                break
            seen.append(at)
            if at == self.last[c]:
                end = -1
                break
            m = MARK.search(self.page, self.page.index(c, at + 1) + 1)
            at = m.start() if m else len(self.page)
        self.ends.update(dict.fromkeys(seen, end))
        return end

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """``(start, end, closing, name, attributes)``; comments and
        declarations have no name.  The caller may ``send`` where to go on."""
        page, at = self.page, 0
        while (start := page.find("<", at) if at <= self.last["<"] else -1) >= 0:
            found = None
            m = TAG.match(page, start)
            after = page[start + 1:start + 3]
            if m:
                found = start, m.end(), bool(m[1]), m[2].lower(), m[3]
            elif page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                found = start, end + 3 if end >= 0 else len(page), False, "", ""
            elif after[:1] in ("!", "?") and after:
                if self.last[">"] > start + 1:
                    found = start, page.index(">", start + 2) + 1, False, "", ""
            elif (first := after[1:] if after[:1] == "/" else after[:1]).isascii() and first.isalpha():
                begin = start + (2 if after[0] == "/" else 1)
                if self.name_end < begin:
                    self.name_end = NAME_END.search(page, begin).start()
                end = self.end_of(self.name_end)
                if end >= 0:
                    found = start, end + 1, after[0] == "/", page[begin:self.name_end].lower(), page[self.name_end:end]
            at = start + 1
            if found:
                to = yield found
                at = found[1]
                if to is not None:
                    at = to
                    yield found


def leaf_blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """``(ancestors, text, linked)`` per block with text, in page order.

    Ancestors are tags and ``@hint`` marks, outermost first.  Character
    references are decoded, white space runs become one space, ends are
    trimmed.  ``linked`` is the share of characters inside links."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    chars = linked = 0
    in_link, at, unclosed, opened = False, 0, set(), Counter()

    def close() -> None:
        nonlocal text, chars, linked
        if text:
            whole = SPACE.sub(" ", unescape("".join(text))).strip(" ")
            if whole:
                out.append((stack[-1][1] if stack else (), whole, linked / max(chars, 1)))
        text, chars, linked = [], 0, 0

    def say(s: str) -> None:
        nonlocal chars, linked
        if s:
            text.append(s)
            n = len(s.strip())
            chars += n
            linked += n if in_link else 0

    def shut(name: str) -> None:
        """Close the innermost open ``name`` and what it holds, if there is one."""
        if opened[name]:
            while True:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == name:
                    return

    tags = iter(Tags(page))
    for start, end, closing, name, attributes in tags:
        say(page[at:start])
        at = end
        if not name:
            continue
        if closing:
            if name in BLOCK:
                close()
                shut(name)
            if name in BLOCK or name == "a":
                in_link = False
        elif name in SKIP:
            if name not in unclosed:
                over = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if over:
                    at = over.end()
                elif name in RAW:
                    at = len(page)
                else:
                    unclosed.add(name)
                tags.send(at)
        elif name in BLOCK:
            close()
            in_link = False
            if stack and stack[-1][0] == "p":
                shut("p")
            if name in SIBLINGS and opened[name]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        shut(name)
                        break
                    if stack[k][0] in ("ul", "ol", "table", "dl", "div"):
                        break
            if name != "hr":
                if len(stack) == MAX_DEPTH:
                    opened[stack.pop()[0]] -= 1
                own = [name]
                for _, value in ATTR.findall(attributes):
                    own += ["@" + HINT_OF[w] for w in dict.fromkeys(NAME.findall(value.lower())) if w in HINT_OF]
                stack.append((name, short((stack[-1][1] if stack else ()) + tuple(own))))
                opened[name] += 1
        elif name == "br":
            say(" ")
        elif name == "a":
            in_link = True
    say(page[at:])
    close()
    return out


def is_mark(p: str) -> bool:
    return p[0] == "@" or p in ("article", "main", "nav", "aside", "footer", "header", "form")


def short(path: tuple[str, ...]) -> tuple[str, ...]:
    """A long path without repeats, its nearest mark and innermost element last:
    the features stay the same."""
    if len(path) <= 64:
        return path
    inner = [p for p in path if p not in ("html", "body")]
    return (*dict.fromkeys(path), *[p for p in inner if is_mark(p)][-1:], *inner[-1:])


def path_features(path: tuple[str, ...]) -> list[str]:
    """Features of a block's ancestors: each tag and mark, the innermost ones,
    and which of two marks is nearer."""
    inner = [p for p in path if p not in ("html", "body")]
    out = [f"in:{p}" for p in dict.fromkeys(inner)]
    marks = [p for p in inner if is_mark(p)]
    out.append(f"own:{inner[-1] if inner else '-'}")
    out.append(f"near:{marks[-1] if marks else '-'}")
    out.append("deep" if len(inner) > 3 else "shallow")
    return out


def text_features(text: str, linked: float) -> list[str]:
    words = text.count(" ") + 1
    out = ["bias", "len:" + str(min(6, words.bit_length())), "link:" + str(int(linked * 3.999))]
    if text[-1] in ".!?”\"":
        out.append("stop")
    if "©" in text or text[:9].lower() == "copyright":
        out.append("rights")
    if "," in text:
        out.append("comma")
    return out


class Field:
    """Weights: ``w[feature] -> (other, article)``, transitions and start."""

    def __init__(self):
        self.w: dict[str, np.ndarray] = {}
        self.trans, self.start = np.zeros((2, 2)), np.zeros(2)

    def emissions(self, blocks) -> np.ndarray:
        out = np.zeros((len(blocks), 2))
        for i, (path, text, linked) in enumerate(blocks):
            for f in path_features(path) + text_features(text, linked):
                w = self.w.get(f)
                if w is not None:
                    out[i] += w
        return out

    def marginals(self, e: np.ndarray):
        """Label and transition marginals by forward-backward."""
        n = len(e)
        a, b = np.empty((n, 2)), np.zeros((n, 2))
        a[0] = self.start + e[0]
        for i in range(1, n):
            a[i] = np.logaddexp(a[i - 1, 0] + self.trans[0], a[i - 1, 1] + self.trans[1]) + e[i]
        for i in range(n - 2, -1, -1):
            nxt = e[i + 1] + b[i + 1]
            b[i] = np.logaddexp(self.trans[:, 0] + nxt[0], self.trans[:, 1] + nxt[1])
        z = np.logaddexp(a[-1, 0], a[-1, 1])
        pair = np.exp(a[:-1, :, None] + self.trans + (e[1:] + b[1:])[:, None, :] - z)
        return np.exp(a + b - z), pair

    def train(self, pages, epochs: int, seed: int, rate: float = 0.5, l2: float = 1e-4) -> Field:
        """Gradient ascent on the conditional likelihood with per-weight steps
        (AdaGrad); ``pages`` are (blocks, labels)."""
        rng, seen = random.Random(seed), {}
        feats = [([path_features(p) + text_features(t, l) for p, t, l in blocks], labels)
                 for blocks, labels in pages if blocks]
        for fs, _ in feats:
            for f in (f for row in fs for f in row):
                self.w.setdefault(f, np.zeros(2))
                seen.setdefault(f, np.full(2, 1e-6))
        gt, gs = np.full((2, 2), 1e-6), np.full(2, 1e-6)
        for _ in range(epochs):
            rng.shuffle(feats)
            for fs, labels in feats:
                e = np.array([sum((self.w[f] for f in row), np.zeros(2)) for row in fs])
                node, pair = self.marginals(e)
                g = -node
                g[np.arange(len(labels)), labels] += 1
                step: dict[str, np.ndarray] = {}
                for row, d in zip(fs, g):
                    for f in row:
                        step[f] = step[f] + d if f in step else d.copy()
                for f, d in step.items():
                    d -= l2 * self.w[f]
                    seen[f] += d * d
                    self.w[f] += rate * d / np.sqrt(seen[f])
                t = -pair.sum(axis=0)
                for x, y in zip(labels, labels[1:]):
                    t[x, y] += 1
                gt += t * t
                self.trans += rate * t / np.sqrt(gt)
                s = -node[0].copy()
                s[labels[0]] += 1
                gs += s * s
                self.start += rate * s / np.sqrt(gs)
        return self

    def viterbi(self, e: np.ndarray) -> list[int]:
        (t00, t01), (t10, t11) = self.trans.tolist()
        rows = e.tolist()
        s0, s1 = self.start[0] + rows[0][0], self.start[1] + rows[0][1]
        back = []
        for e0, e1 in rows[1:]:
            b0, b1 = int(s1 + t10 > s0 + t00), int(s1 + t11 > s0 + t01)
            s0, s1 = (s1 + t10 if b0 else s0 + t00) + e0, (s1 + t11 if b1 else s0 + t01) + e1
            back.append((b0, b1))
        label = int(s1 > s0)
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]


class Extractor:
    """A trained field with the emissions of ancestor paths remembered."""

    def __init__(self, field: Field):
        self.field, self.paths = field, {}

    def __call__(self, page: str) -> str:
        blocks = leaf_blocks(page)
        if not blocks:
            return ""
        w, rows = self.field.w, []
        zero = np.zeros(2)
        for path, text, linked in blocks:
            e = self.paths.get(path)
            if e is None:
                if len(self.paths) > 50_000:
                    self.paths.clear()
                e = self.paths[path] = sum((w.get(f, zero) for f in path_features(path)), zero)
            rows.append(sum((w[f] for f in text_features(text, linked) if f in w), e))
        keep = self.field.viterbi(np.array(rows))
        return " ".join(t for (_, t, _), k in zip(blocks, keep) if k)


@dataclass(frozen=True)
class ExtractionRules:
    """The field is trained on at most ``fit_pages`` different pages of under
    ``fit_chars`` characters, taken by hash, and ``variants`` labelled layouts
    made of each one's texts.  Where all pages are longer, or none marks its
    article, only layouts of fixed lines are left to train on, and menus without
    a mark may stay.  Extraction reads pages of any length whole."""

    fit_pages: int = 60
    fit_chars: int = 100_000
    variants: int = 3
    epochs: int = 6
    seed: int = 5


OTHER = ("nav aside footer header form @ad @nav @head @foot @side @note @form @talk @share button menu").split()
FILLER = ["Home", "About us", "Sign in", "Read more", "Subscribe to our newsletter today.",
          "We use cookies to improve this site. Accept all", "© 2020 All rights reserved.",
          "Great post, thanks for sharing this with all of us!", "Posted by guest on Monday", "Related stories"]


def structural_labels(blocks) -> list[int] | None:
    """Labels of a page that marks its article: blocks inside ``article`` or
    ``main`` and inside no element of another kind; None without such a mark."""
    if not any("article" in p or "main" in p for p, _, _ in blocks):
        return None
    bad = set(OTHER)
    return [int(("article" in p or "main" in p) and not bad & set(p)) for p, _, _ in blocks]


def layout(rng: random.Random, paragraphs: list[str], other: list[str]) -> tuple[str, list[int]]:
    """A labelled page: the paragraphs as article in one of several layouts,
    with menus, notices, adverts, forms, sidebars, comments around and inside."""
    labels: list[int] = []
    esc = lambda s: html.escape(s, quote=False)

    def junk(kind: str) -> str:
        texts = [rng.choice(other + FILLER) for _ in range(rng.randint(1, 5))]
        if kind in ("talk", "ad", "side") and rng.random() < 0.6:
            texts = [rng.choice(paragraphs + other) for _ in texts]
        open_, close = {
            "nav": ("<nav><ul>", "</ul></nav>"), "menu": ('<div class="menu"><ul>', "</ul></div>"),
            "head": ("<header>", "</header>"), "foot": ("<footer>", "</footer>"),
            "foot2": ('<div id="footer">', "</div>"), "head2": ('<div class="site-header">', "</div>"),
            "side": ("<aside>", "</aside>"), "side2": ('<div class="sidebar">', "</div>"),
            "ad": ('<div class="ad">', "</div>"), "ad2": ('<div class="advert banner">', "</div>"),
            "note": ('<div class="cookie-notice">', "</div>"), "form": ("<form>", "</form>"),
            "talk": ('<div class="comments">', "</div>"), "talk2": ('<section id="comments">', "</section>"),
            "share": ('<div class="share">', "</div>")}[kind]
        out = [open_]
        for t in texts:
            labels.append(0)
            e = esc(t)
            out.append({"nav": f'<li><a href="/x">{e}</a></li>', "menu": f'<li><a href="/x">{e}</a></li>',
                        "form": f"<p>{e}</p><input>", "talk": f"<p>{e}</p>", "talk2": f'<div class="comment">{e}</div>',
                        }.get(kind, rng.choice([f"<p>{e}</p>", f"<div>{e}</div>"])))
        return "".join(out) + close

    page = ["<html><head><title>x</title></head><body>"]
    for kind in ("head", "head2", "nav", "menu", "note", "ad", "ad2"):
        if rng.random() < 0.4:
            page.append(junk(kind))
    open_, close = rng.choice([("<article>", "</article>")] * 4 + [
        ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"),
        ('<div id="main-content">', "</div>"), ('<div class="post-body">', "</div>"),
        ('<section class="story">', "</section>"), ('<div class="entry">', "</div>"), ("<div>", "</div>"), ("", "")])
    page.append(open_)
    for i, t in enumerate(paragraphs):
        labels.append(1)
        tag = "h1" if i == 0 and rng.random() < 0.7 else rng.choice(["p"] * 8 + ["h2", "li", "blockquote", "div"])
        body = f"<{tag}>{esc(t)}</{tag}>"
        page.append(f"<ul>{body}</ul>" if tag == "li" else body)
        if rng.random() < 0.08:
            page.append(junk(rng.choice(["ad", "side", "share", "form", "talk"])))
    page.append(close)
    for kind in ("talk", "talk2", "side", "side2", "share", "ad", "form", "foot", "foot2"):
        if rng.random() < 0.4:
            page.append(junk(kind))
    return "".join(page) + "</body></html>", labels


def labelled_pages(pages: list[str], rules: ExtractionRules):
    """Training pages ``(blocks, labels)``: each sampled page that marks its
    article, and labelled layouts made of its texts."""
    rng, out = random.Random(rules.seed), []
    spare = ["A first paragraph, of some length, that says what happened.", "Then a second one follows it.",
             "The last paragraph ends the story, as last paragraphs do."]
    for page in [*pages, ""]:
        blocks = leaf_blocks(page)
        marked = structural_labels(blocks) if blocks else None
        if marked:
            out.append((blocks, marked))
        own = [t for (_, t, _), k in zip(blocks, marked or []) if k] or spare
        other = [t for (_, t, _), k in zip(blocks, marked or []) if not k] or FILLER
        for _ in range(rules.variants):
            some = [" ".join(x.split(" ")[:rng.choice([4, 12, 40, 200])]) for x in rng.sample(own, min(len(own), 12))]
            made, labels = layout(rng, some, other)
            got = leaf_blocks(made)
            if len(got) == len(labels):
                out.append((got, labels))
    return out


def fit(pages: DataFrame, rules: ExtractionRules = ExtractionRules(), html_col: str = "html") -> Field:
    """A field trained on a bounded sample of ``pages`` (NULLs left out)."""
    rows = pages.select(F.col(html_col).alias("h")).filter(F.col("h").isNotNull() & (F.length("h") < rules.fit_chars)) \
        .withColumn("k", F.xxhash64(F.lit(rules.seed), "h"))
    # hashes alone say which pages are taken; equal pages are one
    taken = [r["k"] for r in rows.select("k").distinct().orderBy("k").limit(rules.fit_pages).collect()]
    some = rows.filter(F.col("k") <= taken[-1]).groupBy("k").agg(F.min("h").alias("h")).orderBy("k").collect() if taken else []
    return Field().train(labelled_pages([r["h"] for r in some], rules), rules.epochs, rules.seed)


def main_text(pages: DataFrame, field: Field, html_col: str = "html",
              keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars`` per row of ``pages``.

    NULL or empty html gives an empty text; repeated rows are treated alike;
    pages are read whole.  No shuffle."""
    schema = ", ".join(f"`{c}` {t}" for c, t in pages.select(*keep).dtypes) + ", text string, n_chars long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = Extractor(field)
        for frame in batches:
            texts = [extract(h) if h else "" for h in frame["_html"]]
            yield frame.drop(columns="_html").assign(text=texts, n_chars=[len(t) for t in texts])

    return pages.select(*keep, F.col(html_col).alias("_html")).mapInPandas(run, schema)
