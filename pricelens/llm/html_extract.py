"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

Each leaf block has features of its ancestors' tags and names (words of class, id, role), of its nearest block, and of
its text (words, links, sentence ends); states are main and other, with weights for neighbouring states. Weights are fitted to
labelled pages by maximum likelihood (forward-backward) with a quadratic penalty; pages are decoded by Viterbi. The
labelled pages are made by `labelled_pages`, from a fixed seed and TRAIN_PAGES in number: layouts with menus, headers,
sidebars, notices, adverts, forms, footers, bylines and reader comments around or inside an article, and pages laid out by
a table without names.

Defined results: null, empty and text-free html gives the empty string; repeated rows and null ids give a row each;
malformed html is read as `dom` says; columns beside page_id, url and html aren't read. Lines of date and author count
as no text of the article.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .dom import Leaf, Node, walk
from .packing import slices

TRAIN_PAGES, PENALTY, ROUNDS = 1000, 0.005, 300
BYTES = 4 << 20


def own_features(leaf: Leaf) -> set[str]:
    """Names of the features that the leaf has beside its ancestors'."""
    out = {"bias"}
    block = leaf.node and leaf.node.block
    if block:
        out.add("o:" + block.element.tag)
        out.update("n:" + n for n in block.element.names)
        if block.parent and block.parent.block:
            out.update("n:" + n for n in block.parent.block.element.names)
    words = leaf.text.count(" ") + 1
    out.add("w:" + ("1" if words < 2 else "4" if words < 5 else "12" if words < 13 else "30" if words < 31 else "more"))
    share = leaf.link / len(leaf.text)
    out.add("l:" + ("0" if share == 0 else "half" if share < 0.5 else "full"))
    if leaf.text[-1] in ".!?…。":
        out.add("end")
    if leaf.text[0] == "©" or leaf.text[:9].lower() == "copyright":
        out.add("copyright")
    return out


def features(leaf: Leaf) -> tuple[str, ...]:
    """Names of the block's features."""
    out, node = own_features(leaf), leaf.node
    while node is not None:
        out.update(node.new)
        node = node.parent
    return tuple(sorted(out))


# ---- labelled pages ----

_TOPS = ("nav", "header", "div.header", "div.topbar", "div.menu", "ul.menu", "div.navigation", "div.breadcrumb", "div.navbar")
_SIDES = ("aside", "div.sidebar", "div.widget", "div.related", "section.related", "div.recommended", "div.share", "div.social", "div.tags", "div.toc")
_NOTES = ("div.notice", "div.cookie", "div.banner", "div.consent", "div.alert", "div.popup", "div.modal", "p.notice", "div.disclaimer", "div.newsletter", "div.subscribe", "div.paywall")
_ADS = ("div.ad", "div.ads", "div.advert", "div.advertisement", "aside.ad", "div.sponsored", "div.promo", "ins.ad", "div.sponsor", "section.promo")
_METAS = ("div.meta", "p.byline", "div.byline", "time", "p.date", "div.author", "span.timestamp", "div.entry-meta", "p.post-info", "div.subtitle", "div.tagline", "div#siteSub")
_FORMS = ("form", "form.search", "div.search", "form.login", "form.newsletter")
_COMMENTS = ("section.comments", "div.comments", "div.comment", "ol.commentlist", "ul.comments", "div.discussion", "div.replies", "section.comment")
_FEET = ("footer", "div.footer", "div.copyright", "div.bottom", "footer.footer")
_BODIES = ("article", "main", "main article", "div.content", "div.article", "div.post", "div.entry", "div.main", "section.content", "div.story", "article.post", "div.text", "div.content article", "section", "div", "")


def _open(kind: str) -> tuple[str, str]:
    start, end = "", ""
    for one in kind.split():
        tag, mark, name = re.match(r"(\w+)([.#]?)(.*)", one).groups()
        start += f'<{tag} {"id" if mark == "#" else "class"}="{name}">' if name else f"<{tag}>"
        end = f"</{tag}>" + end
    return start, end


def _prose(rng: random.Random, low: int, high: int, stop: str = ".") -> str:
    letters = "abcdefghijklmnopqrstuvwxyzéüñ"
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high))).capitalize() + stop


def labelled_pages(n: int, seed: int = 17) -> Iterator[tuple[list[Leaf], list[int]]]:
    """Pages as leaf blocks with 1 for main text; labels come from a mark in the text that the page is made with."""
    rng = random.Random(seed)
    mark = "\x02"

    def other(kinds: tuple[str, ...], inner: str = "") -> str:
        kind = rng.choice(kinds)
        a, b = _open(kind + rng.choice(("-box", "-wrap", "-list", "-inner")) if "." in kind and rng.random() < 0.3 else kind)
        shape = rng.random()
        if inner:
            body = inner
        elif shape < 0.35:
            body = "<ul>" + "".join(f'<li><a href="/x">{_prose(rng, 1, 4, "")}</a></li>' for _ in range(rng.randint(2, 7))) + "</ul>"
        elif shape < 0.5:
            body = "".join(f"<p>{_prose(rng, 3, 30)}</p>" for _ in range(rng.randint(1, 3)))
        elif shape < 0.6:
            body = f"<h3>{_prose(rng, 1, 5, '')}</h3>" + _prose(rng, 3, 20)
        else:
            body = _prose(rng, 2, 25, rng.choice((".", "", "!")))
        return a + body + b

    def form() -> str:
        a, b = _open(rng.choice(_FORMS))
        return a + f"<label>{_prose(rng, 1, 3, '')}</label><input name=q><button>{_prose(rng, 1, 2, '')}</button>" + b

    def comments() -> str:
        said = "".join(rng.choice((f"<p>{_prose(rng, 3, 40)}</p>", f'<div class="comment"><span class="author">{_prose(rng, 1, 2, "")}</span><p>{_prose(rng, 4, 40)}</p></div>', f"<li>{_prose(rng, 4, 30)}</li>")) for _ in range(rng.randint(1, 5)))
        return other(_COMMENTS, (f"<h3>{_prose(rng, 1, 3, '')}</h3>" if rng.random() < 0.5 else "") + said)

    def meta() -> str:
        a, b = _open(rng.choice(_METAS))
        return a + rng.choice((_prose(rng, 1, 5, ""), f"{rng.randint(1, 28)} {_prose(rng, 1, 1, '')} {rng.randint(1990, 2030)}", f'<a href="/u">{_prose(rng, 1, 2, "")}</a>, {rng.randint(1, 28)}.{rng.randint(1, 12)}.')) + b

    def bare_table() -> str:
        """A page laid out by a table without names: links beside the text, and a line at the end."""
        links = "".join(f'<a href="/x">{_prose(rng, 1, 3, "")}</a>{rng.choice(("<br>", " | ", "<p>"))}' for _ in range(rng.randint(2, 9)))
        side = f"<td>{links}</td>"
        text = "".join(f"<p>{mark}{_prose(rng, 8, 90)}" + rng.choice(("</p>", "")) for _ in range(rng.randint(1, 8)))
        title = rng.choice((f"<h1>{mark}{_prose(rng, 2, 9, '')}</h1>", f"<h2>{mark}{_prose(rng, 2, 9, '')}</h2>", ""))
        row = rng.choice((side, "")) + f"<td>{title}{text}</td>" + rng.choice((side, ""))
        last = rng.choice(("", f"<tr><td>{rng.choice(('&copy; ', 'Copyright '))}{rng.randint(1995, 2030)} {_prose(rng, 1, 5, '')}</td></tr>"))
        return f"<table>{rng.choice((f'<tr>{side}</tr>', ''))}<tr>{row}</tr>{last}</table>"

    def main() -> str:
        out = []
        title = f"<h1>{mark}{_prose(rng, 2, 10, rng.choice(('', '.')))}</h1>"
        out.append(rng.choice((title, title, f"<header>{title}</header>")))
        if rng.random() < 0.15:
            out.insert(rng.randint(0, 1), meta())
        for _ in range(rng.randint(0, 12)):
            kind = rng.random()
            if kind < 0.6:
                p = mark + _prose(rng, 1, 90, rng.choice((".", ".", ".", "!", "?", "")))
                if rng.random() < 0.2:
                    p = f'{p} <a href="/l">{_prose(rng, 1, 5, "")}</a> {_prose(rng, 1, 9)}'
                if rng.random() < 0.2:
                    p = f"<b>{p}</b>"
                out.append(f"<p>{p}" + rng.choice(("</p>", "</p>", "")))
            elif kind < 0.68:
                out.append(f"<h2>{mark}{_prose(rng, 1, 7, '')}</h2>")
            elif kind < 0.76:
                a, b = rng.choice((("<ul>", "</ul>"), ("<ol>", "</ol>")))
                out.append(a + "".join(f"<li>{mark}{_prose(rng, 1, 20, rng.choice(('', '.')))}</li>" for _ in range(rng.randint(1, 5))) + b)
            elif kind < 0.81:
                out.append(f"<blockquote>{mark}{_prose(rng, 4, 40)}</blockquote>")
            elif kind < 0.85:
                out.append(f"<pre>{mark}{_prose(rng, 2, 20, '')}</pre>")
            elif kind < 0.89:
                out.append(f"<table><tr><td>{mark}{_prose(rng, 1, 5, '')}</td><td>{mark}{_prose(rng, 1, 5, '')}</td></tr></table>")
            elif kind < 0.91:
                out.append(f'<figure><img src="a.png"><figcaption>{mark}{_prose(rng, 2, 12)}</figcaption></figure>')
            elif kind < 0.94:
                out.append(f"<div>{mark}{_prose(rng, 2, 60)}</div>")
            else:
                out.append(other(rng.choice((_ADS, _SIDES, _NOTES))))
        if out and rng.random() < 0.4:
            out.insert(rng.randint(1, len(out)), other(rng.choice((_ADS, _SIDES, _NOTES))))
        if rng.random() < 0.25:
            out.append(comments())
        if rng.random() < 0.15:
            out.insert(rng.randint(1, len(out)), form())
        return "".join(out)

    for _ in range(n):
        if rng.random() < 0.08:
            page = "<html><body>" + rng.choice((bare_table(), other(_TOPS) + bare_table()))
            yield _labelled(page, mark)
            continue
        parts = [other(_TOPS) for _ in range(rng.randint(0, 2))]
        parts += [other(rng.choice((_ADS, _NOTES, _SIDES))) for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.3:
            parts.append(form())
        a, b = _open(rng.choice(_BODIES))
        parts.append(a + main() + b)
        if rng.random() < 0.35:
            parts.append(comments())
        parts += [other(rng.choice((_ADS, _SIDES, _NOTES))) for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.85:
            parts.append(other(_FEET, rng.choice(("&copy; ", "")) + _prose(rng, 1, 12)) if rng.random() < 0.7 else other(_FEET))
        page = "<html><head><title>x</title></head><body>" + rng.choice(("", '<div class="wrapper">', '<div id="page">')) + "".join(parts)
        yield _labelled(page, mark)


def _labelled(page: str, mark: str) -> tuple[list[Leaf], list[int]]:
    leaves = [x for x in walk(page) if x.ref is None]
    labels = [int(mark in x.text) for x in leaves]
    for x in leaves:
        x.text = x.text.replace(mark, "")
    return [x for x in leaves if x.text], [y for x, y in zip(leaves, labels, strict=True) if x.text]


# ---- the field ----


@dataclass(frozen=True)
class Field:
    """weights: feature to the two states' scores; step: scores of neighbouring states."""

    weights: dict[str, tuple[float, float]]
    step: tuple[tuple[float, float], tuple[float, float]]

    def score(self, names: Iterable[str]) -> tuple[float, float]:
        x = y = 0.0
        for f in names:
            u, v = self.weights.get(f, (0.0, 0.0))
            x += u
            y += v
        return x, y

    def decode(self, leaves: list[Leaf]) -> list[int]:
        """The most likely states, by Viterbi; of equally likely states of the last block other, of those before it main stays main. An
        ancestor's score is added up once for all its leaves."""
        above: dict[Node | None, tuple[float, float]] = {None: (0.0, 0.0)}
        (s00, s01), (s10, s11) = self.step
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for k, leaf in enumerate(leaves):
            chain, node = [], leaf.node
            while node not in above:
                chain.append(node)
                node = node.parent
            for node in reversed(chain):
                x, y = self.score(node.new)
                u, v = above[node.parent]
                above[node] = (x + u, y + v)
            x, y = self.score(sorted(own_features(leaf)))
            u, v = above[leaf.node]
            x, y = x + u, y + v
            if not k:
                a, b = x, y
                continue
            back.append((int(b + s10 > a + s00), int(b + s11 >= a + s01)))
            a, b = x + max(a + s00, b + s10), y + max(a + s01, b + s11)
        state = int(b > a)
        out = [state]
        for pair in reversed(back):
            state = pair[state]
            out.append(state)
        return out[::-1] if leaves else []


def fit(pages: list[tuple[list[Leaf], list[int]]], penalty: float = PENALTY, rounds: int = ROUNDS) -> Field:
    """Maximum likelihood with a quadratic penalty, by gradient steps with a step size for each weight. All pages'
    chains advance together, longest first, so a round is a few passes over arrays."""
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
    names: dict[str, int] = {}
    rows, columns, truth, place = [], [], [], []
    n = 0
    for leaves, labels in pages:
        place.append(np.arange(n, n + len(leaves)))
        for leaf, y in zip(leaves, labels, strict=True):
            for f in features(leaf):
                rows.append(n)
                columns.append(names.setdefault(f, len(names)))
            truth.append(y)
            n += 1
    row, column, y = np.array(rows), np.array(columns), np.array(truth)
    long = max(len(p) for p in place)
    at = np.full((long, len(place)), -1)
    for j, p in enumerate(place):
        at[: len(p), j] = p
    live = [(at[k] >= 0).sum() for k in range(long)]  # chains still there; they are sorted, so these are the first
    w, step = np.zeros((len(names), 2)), np.zeros((2, 2))
    gw, gs = np.full_like(w, 1e-8), np.full_like(step, 1e-8)
    real_w, real_s = np.zeros_like(w), np.zeros_like(step)
    np.add.at(real_w, (column, y[row]), 1)
    for p in place:
        np.add.at(real_s, (y[p[:-1]], y[p[1:]]), 1)
    for _ in range(rounds):
        score = np.stack([np.bincount(row, w[column, s], n) for s in (0, 1)], axis=1)
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        alpha[at[0]] = score[at[0]]
        for k in range(1, long):
            now, before = at[k, : live[k]], at[k - 1, : live[k]]
            alpha[now] = score[now] + np.logaddexp(alpha[before, 0, None] + step[0], alpha[before, 1, None] + step[1])
        for k in range(long - 1, 0, -1):
            now, before = at[k, : live[k]], at[k - 1, : live[k]]
            nxt = score[now] + beta[now]
            beta[before] = np.logaddexp(step[:, 0] + nxt[:, 0, None], step[:, 1] + nxt[:, 1, None])
        total = np.zeros(n)
        for p in place:
            total[p] = np.logaddexp(*alpha[p[-1]])
        chance = np.exp(alpha + beta - total[:, None])
        want_s = np.zeros((2, 2))
        for k in range(1, long):
            now, before = at[k, : live[k]], at[k - 1, : live[k]]
            want_s += np.exp(alpha[before][:, :, None] + step + (score[now] + beta[now])[:, None, :] - total[now][:, None, None]).sum(axis=0)
        want_w = np.stack([np.bincount(column, chance[row, s], len(names)) for s in (0, 1)], axis=1)
        for value, real, want, g in ((w, real_w, want_w, gw), (step, real_s, want_s, gs)):
            slope = (real - want) / len(place) - penalty * value / 10
            g += slope * slope
            value += 0.5 * slope / np.sqrt(g)
    return Field({f: (float(w[k, 0]), float(w[k, 1])) for f, k in names.items()}, ((float(step[0, 0]), float(step[0, 1])), (float(step[1, 0]), float(step[1, 1]))))


@cache
def default_field() -> Field:
    return fit(list(labelled_pages(TRAIN_PAGES)))


def main_text(html: str | None, field: Field) -> str:
    leaves = [x for x in walk(html or "") if x.ref is None]
    return " ".join(x.text for x, y in zip(leaves, field.decode(leaves), strict=True) if y)


def extract(spark: SparkSession, pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of (page_id, url, html)."""
    shared = spark.sparkContext.broadcast(field or default_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(2), BYTES):
                text = [main_text(h, shared.value) for h in b.column(2).slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, table(spark, sf_dir, "pages"))
