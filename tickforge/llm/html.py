"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element that matters is a binary variable, content or not. Unary potentials come
from its tag, the words of its class, id and role, and figures of its text (length, share
in links, sentences); potentials join parents and children, by kind of child. Sum-product
messages pass from the leaves to the root and back; an element's own text is kept when its
marginal says content.

The model is trained on labelled pages: (html, text) pairs. Labelled content are those
elements whose text occurs in the page's text; unary weights and pairwise potentials are
fitted together, to the likelihood of all labels, whose gradient the marginals give. ``labelled_pages`` makes such
pages; any DataFrame of (html, text) may take their place, of which at most ``TRAIN_PAGES``
are used, in order of their hash.

Scale: pages are read once and never shuffled; a page is the unit of work and the model a
few thousand numbers.

Defined results: null and empty html, and html without content, give an empty text. Whole
pages are parsed, unclosed and truncated markup included, in time that grows with their
length: where ``UNFINISHED`` tags of a page never end, quotes hide no ``>`` from there on.
Repeated rows repeat; extra columns are not looked at.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


TRAIN_PAGES = 2000
MADE_PAGES = 700

# Fixed values of HTML: kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Text inside is neither markup nor content.
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = RAW | set("head template svg math canvas object select button option datalist audio video map".split())
BLOCK = set(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul legend".split()
)
#: An opening tag ends an open p, unless a boundary stands between.
CLOSES_P = BLOCK - set("html body caption tbody td tfoot th thead tr legend".split())
BOUNDARY = set("html table td th caption button object template".split())
#: tag -> (open tags that it ends, tags beyond which it doesn't look)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "body": ({"head"}, {"html"}),
}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*'|["'])*+)>""", re.S)
#: The same without regard to quotes.
_PLAIN_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>""", re.S)
_TAG = re.compile("</?[a-zA-Z]")
#: Tags with quotes that hide every ``>`` to the page's end, after which quotes hide none: each costs a look at all the rest.
UNFINISHED = 8
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?…。][\s\"'»”)]|[.!?…。]$")


class Page:
    """The elements of a page in order, and runs of text.

    parents, tags, marks: per element; runs: (element, block, text) with consecutive block
    numbers; inline elements without class, id or role belong to the element around them.
    """

    def __init__(self, source: str):
        self.parents, self.tags, self.marks = [-1], ["html"], [()]
        self.runs: list[tuple[int, int, str, bool]] = []
        self._parse(source)

    def _node(self, tag: str, attributes: str, parent: int, block: bool) -> int:
        marks: tuple[str, ...] = ()
        if attributes:
            marks = tuple({p for m in _ATTRIBUTE.finditer(attributes) for p in _PART.findall((m[2] or m[3] or m[4] or "").lower())})
        if not block and not marks:
            return parent
        self.parents.append(parent)
        self.tags.append(tag)
        self.marks.append(marks)
        return len(self.tags) - 1

    def _parse(self, source: str) -> None:
        stack = [("html", 0, False, False)]  # tag, element, dropped, in a link
        places: dict[str, list[int]] = {"html": [0]}  # of each tag's open elements in the stack
        block, at, end, last, unfinished = 0, 0, len(source), source.rfind(">"), 0
        token, unescape = _TOKEN, entities.unescape

        def text(upto: int) -> None:
            if at < upto:
                _, node, dropped, link = stack[-1]
                if not dropped:
                    piece = source[at:upto]
                    self.runs.append((node, block, unescape(piece) if "&" in piece else piece, link))

        def pop(i: int) -> None:
            for open_tag, *_ in stack[i:]:
                places[open_tag].pop()
            del stack[i:]

        def close(wanted: set[str], stops: set[str]) -> None:
            """Closes the innermost open element of ``wanted``, unless one of ``stops`` is open inside it."""
            i = max([places[t][-1] for t in wanted if places.get(t)], default=0)
            if i > 0 and i >= max([places[t][-1] for t in stops if places.get(t)], default=0):
                pop(i)

        while at < end:
            start = source.find("<", at)
            m = None
            # no tag ends beyond the last >, but a comment or declaration goes on to the page's end
            while start >= 0 and (start > last and source[start + 1 : start + 2] not in ("!", "?") or (m := token.match(source, start)) is None):
                if start < last and unfinished < UNFINISHED and _TAG.match(source, start):
                    unfinished += 1
                    token = _TOKEN if unfinished < UNFINISHED else _PLAIN_TOKEN
                start = source.find("<", start + 1)
            if m is None:
                text(end)
                break
            text(start)
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag in BLOCK:
                block += 1
            if m[1]:
                if tag == "br":
                    self.runs.append((stack[-1][1], block, " ", False))
                elif tag not in VOID:
                    stops = BOUNDARY - {tag} if tag not in ("body", "html", "table", "tr", "tbody", "thead", "tfoot") else {"table"} - {tag}
                    close({tag}, stops)
                continue
            if tag == "br":
                _, node, dropped, link = stack[-1]
                if not dropped:
                    self.runs.append((node, block, " ", link))
                continue
            if tag in VOID:
                continue
            if tag == "html" or tag == "body" and places.get("body"):
                continue
            if tag in CLOSES_P:
                close({"p"}, BOUNDARY)
            if tag in ENDS:
                close(*ENDS[tag])
            if tag != "head" and stack[-1][0] == "head" and tag in BLOCK:
                pop(len(stack) - 1)
            _, parent, dropped, link = stack[-1]
            if tag in RAW:
                closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = closing.end() if closing else end
                continue
            node = parent if dropped else self._node(tag, m[3], parent, tag in BLOCK)
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, node, dropped or tag in DROPPED, link or tag == "a"))


def page_features(page: Page) -> list[list[str]]:
    """Binary features per element."""
    n = len(page.tags)
    own, linked, below, links, sentences = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for node, _, text, link in page.runs:
        size = len(text.strip())
        own[node] += size
        if link:
            linked[node] += size
        else:
            sentences[node] += len(_SENTENCE.findall(text.strip()))
    children = [0] * n
    total, in_links = own[:], linked[:]
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        children[p] += 1
        total[p] += total[i]
        in_links[p] += in_links[i]
    out = []
    for i in range(n):
        tag = page.tags[i]
        f = ["t:" + tag]
        f += ["m:" + x for x in page.marks[i]]
        f.append(f"own:{min(9, own[i].bit_length())}")
        f.append(f"all:{min(12, total[i].bit_length())}")
        f.append("none" if not total[i] else f"link:{4 * in_links[i] // total[i]}")
        if own[i]:
            f.append(f"sentences:{min(3, sentences[i])}")
        f.append(f"children:{min(3, children[i])}")
        out.append(f)
    return out


def _kind(tag: str) -> int:
    """Kinds of child that pairwise potentials tell apart."""
    return 0 if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre") else 1 if tag in ("div", "section", "article", "main", "body") else 2


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    pair: list[list[list[float]]]  # [kind][parent][child], logarithms

    def marginals(self, page: Page) -> list[float]:
        """P(content) of every element by sum-product over the tree."""
        n, weight = len(page.tags), self.weights.get
        unary = [self.bias + sum([weight(x, 0.0) for x in f]) for f in page_features(page)]
        # messages as log-odds; up[i] is what i's subtree tells about i, sent[i] what it tells i's parent
        up, sent = unary[:], [0.0] * n
        kinds = [_kind(t) for t in page.tags]
        for i in range(n - 1, 0, -1):
            (a, b), (c, d) = self.pair[kinds[i]]
            u = up[i]
            sent[i] = _log_add(c, d + u) - _log_add(a, b + u)
            up[page.parents[i]] += sent[i]
        belief = up[:]
        for i in range(1, n):
            p = page.parents[i]
            (a, b), (c, d) = self.pair[kinds[i]]
            rest = belief[p] - sent[i]
            belief[i] = up[i] + _log_add(b, d + rest) - _log_add(a, c + rest)
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in belief]


def _log_add(x: float, y: float) -> float:
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


def _blocks(page: Page, keep: list[bool] | None = None) -> Iterator[tuple[str, set[int]]]:
    """Texts of blocks, white space made one space, and the elements they come from."""
    at, pieces, nodes = -1, [], set()
    for node, block, text, _ in [*page.runs, (-1, -2, "", False)]:
        if block != at:
            if pieces and (joined := " ".join("".join(pieces).split())):
                yield joined, nodes
            at, pieces, nodes = block, [], set()
        if node >= 0 and (keep is None or keep[node]):
            pieces.append(text)
            nodes.add(node)


def main_text(source: str | None, model: Model) -> str:
    if not source:
        return ""
    page = Page(source)
    keep = [x > 0.5 for x in model.marginals(page)]
    return "\n".join(text for text, _ in _blocks(page, keep))


# --- training


def labels(page: Page, text: str) -> list[int]:
    """1 for elements that hold a block of ``text`` somewhere below."""
    blocks = Counter(text.split("\n"))
    out = [0] * len(page.tags)
    for block, nodes in _blocks(page):
        if blocks[block] > 0:
            for i in nodes:
                out[i] = 1
    for i in range(len(out) - 1, 0, -1):
        out[page.parents[i]] |= out[i]
    return out


def fit(pages: list[tuple[str, str]], rounds: int = 300, ridge: float = 0.3) -> Model:
    """Weights and pairwise potentials of greatest likelihood, by gradient steps.

    All pages form one forest; messages pass through it level by level.
    """
    names: dict[str, int] = {}
    rows, columns, truth, parents, kinds, depths = [], [], [], [], [], []
    for source, text in pages:
        page = Page(source)
        start = len(truth)
        truth += labels(page, text)
        for i, f in enumerate(page_features(page)):
            rows += [start + i] * len(f)
            columns += [names.setdefault(x, len(names)) for x in f]
            parents.append(start + page.parents[i] if i else -1)
            depths.append(depths[parents[-1]] + 1 if i else 0)
            kinds.append(_kind(page.tags[i]))
    r, c, y, up_to, kind, depth = (np.array(x, np.int64) for x in (rows, columns, truth, parents, kinds, depths))
    n = len(y)
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max(initial=0) + 1)]
    edges = np.flatnonzero(depth > 0)
    cell = lambda a, b, w: np.bincount(kind[edges] * 4 + 2 * a + b, w, 12).reshape(3, 2, 2)
    seen = cell(y[up_to[edges]], y[edges], np.ones(len(edges)))
    w, b, pair = np.zeros(len(names)), 0.0, np.zeros((3, 2, 2))
    v, vb, vp = np.zeros(len(names)), 0.0, np.zeros((3, 2, 2))
    scale = np.bincount(c, minlength=len(names)) + ridge + 2.0
    for step in range(rounds):
        unary = np.bincount(r, w[c], n) + b
        up, sent = unary.copy(), np.zeros(n)
        for at in reversed(levels):
            k, u = kind[at], up[at]
            sent[at] = np.logaddexp(pair[k, 1, 0], pair[k, 1, 1] + u) - np.logaddexp(pair[k, 0, 0], pair[k, 0, 1] + u)
            up += np.bincount(up_to[at], sent[at], n)
        belief, rest = up.copy(), np.zeros(n)
        for at in levels:
            k = kind[at]
            rest[at] = q = belief[up_to[at]] - sent[at]
            belief[at] = up[at] + np.logaddexp(pair[k, 0, 1], pair[k, 1, 1] + q) - np.logaddexp(pair[k, 0, 0], pair[k, 1, 0] + q)
        off = 1 / (1 + np.exp(-np.clip(belief, -500, 500))) - y
        k, q, u = kind[edges], rest[edges], up[edges]
        joint = np.stack([pair[k, 0, 0], pair[k, 0, 1] + u, pair[k, 1, 0] + q, pair[k, 1, 1] + q + u], 1)
        joint = np.exp(joint - joint.max(1, keepdims=True))
        joint /= joint.sum(1, keepdims=True)
        expected = np.stack([np.bincount(k, joint[:, x], 3) for x in range(4)], 1).reshape(3, 2, 2)
        rate = 0.3 if step < rounds * 0.8 else 0.1
        v = 0.9 * v - rate * (np.bincount(c, off[r], len(names)) + ridge * w) / scale
        vb = 0.9 * vb - rate * off.mean()
        vp = 0.9 * vp - rate * (expected - seen + ridge * pair) / (seen.sum((1, 2), keepdims=True) + 1)
        w, b, pair = w + v, b + vb, pair + vp
    return Model({x: float(w[i]) for x, i in names.items()}, float(b), pair.tolist())


# Fixed words that pages use in class, id and role attributes.
_AROUND = {
    "nav": "nav navbar menu navigation topnav breadcrumbs breadcrumb mainmenu toolbar tabs skip links",
    "header": "header masthead topbar logo branding site banner",
    "footer": "footer colophon copyright legal bottom imprint credits",
    "aside": "sidebar aside widget related recommended trending popular rail secondary complementary teaser more",
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion banner adsense ad-slot ad-container commercial",
    "notice": "cookie consent notice gdpr alert popup modal overlay newsletter subscribe signup message paywall privacy banner disclaimer",
    "comments": "comments comment replies reply discussion disqus respond commentlist reactions feedback user-comments thread",
    "share": "share social sharing follow buttons pagination pager tags meta toolbar author-box",
    "form": "form search login searchform contact-form signup",
}
_INSIDE = "content article post entry main story text body page prose section post-content entry-content article-body maincontent article-content blog single"


def labelled_pages(n: int = MADE_PAGES, seed: int = 7) -> list[tuple[str, str]]:
    """Made pages in many layouts with the text that an extractor should give."""
    rng = random.Random(seed)
    letters = "aeioustrnlmdéüñß"

    def words(k: int) -> str:
        return " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(k))

    def sentences(k: int) -> str:
        return " ".join(words(rng.randint(3, 16)).capitalize() + rng.choice([".", ".", "!", "?", ""]) for _ in range(k))

    def esc(x: str) -> str:
        return entities.escape(x)

    def attribute(kind: str) -> str:
        name = rng.choice(_AROUND[kind].split())
        if rng.random() < 0.3:
            name += rng.choice(["-", "_", " "]) + rng.choice(["box", "wrapper", "area", "block", "top", "list", "x"])
        return rng.choice([f' class="{name}"', f' id="{name}"', f" class='{name}'", f' class={name.split()[0]}'])

    def plain() -> str:
        return rng.choice([f"<p>{esc(sentences(rng.randint(1, 4)))}</p>", esc(sentences(rng.randint(1, 3)))])

    def link_list(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{esc(words(rng.randint(1, 4)))}</a>' + rng.choice(["</li>", "</li>", ""]) for i in range(k)) + "</ul>"

    def around(kind: str) -> str:
        named = kind in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6
        tag = kind if named else rng.choice(["div", "div", "section", "aside" if kind != "comments" else "div"])
        mark = "" if named and rng.random() < 0.6 else attribute(kind)
        if kind == "nav":
            inside = rng.choice([link_list(rng.randint(2, 9)), "".join(f"<a href=/{i}>{esc(words(1))}</a> " for i in range(5))])
        elif kind == "header":
            inside = rng.choice([f"<h1>{esc(words(3))}</h1>", f"<a href=/>{esc(words(2))}</a>", plain()]) + rng.choice(["", link_list(3), plain()])
        elif kind == "comments":
            inside = rng.choice(["", f"<h3>{esc(words(2))}</h3>"]) + "".join(
                rng.choice(["<div{}>{}</div>", "<li{}>{}</li>", "<article{}>{}</article>", "<p{}>{}</p>"]).format(attribute("comments"), plain()) for _ in range(rng.randint(1, 5))
            )
            if rng.random() < 0.3:
                inside = f"<ol>{inside}</ol>"
        elif kind == "form":
            inside = f"<label>{esc(words(2))}</label><input type=text><button>{words(1)}</button>" + rng.choice(["", plain()])
            if tag != "form":
                inside = f"<form action=/x>{inside}</form>"
        elif kind == "aside":
            inside = f"<h3>{esc(words(2))}</h3>" + rng.choice([link_list(rng.randint(2, 6)), plain() + plain(), plain()])
        else:
            inside = rng.choice([plain(), plain() + plain(), f"{esc(words(4))} <a href=/q>{esc(words(2))}</a>", f"<p>&copy; {esc(words(3))}</p>", f"<b>{esc(words(5))}</b>"])
        return f"<{tag}{mark}>{inside}</{tag}>"

    def paragraph(gold: list[str], terse: float) -> str:
        length = rng.random()
        if length < terse:
            text = words(rng.randint(1, 3)).capitalize() + rng.choice([".", ".", ""])
        elif length < 0.9:
            text = sentences(rng.choice([1, 1, 2, 3, 4, 6, 10, 40]))
        else:
            text = words(rng.choice([1, 3, 8, 20, 60, 200, 800]))
        kind = rng.random()
        gold.append(" ".join(text.split()))
        body = esc(text)
        if kind < 0.1 and " " in text:
            a, b = text.split(" ", 1)
            body = rng.choice(["<b>{}</b> {}", '<a href="/r">{}</a> {}', "<em>{}</em><br>{}", "<span>{}</span> {}"]).format(esc(a), esc(b))
        elif kind < 0.14:
            body = f"<b>{body}<br>"
        return rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p>{}</p>\n", "<p class=text>{}</p>"]).format(body)

    def article() -> tuple[str, list[str]]:
        gold: list[str] = []
        out = []
        terse = rng.choice([0.0, 0.1, 0.1, 0.3, 0.8])
        if rng.random() < 0.8:
            title = words(rng.randint(2, 9)).capitalize()
            gold.append(title)
            out.append(f"<h1>{esc(title)}</h1>")
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14, 30])):
            kind = rng.random()
            if kind < 0.78:
                out.append(paragraph(gold, terse))
            elif kind < 0.86:
                items = [words(rng.randint(2, 12)) for _ in range(rng.randint(1, 5))]
                gold += items
                tag = rng.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{esc(x)}</li>" for x in items) + f"</{tag}>")
            elif kind < 0.91:
                title = words(rng.randint(1, 5))
                gold.append(title)
                out.append(f"<h{(k := rng.randint(2, 4))}>{esc(title)}</h{k}>")
            elif kind < 0.95:
                quote = sentences(2)
                gold.append(" ".join(quote.split()))
                out.append(f"<blockquote>{esc(quote)}</blockquote>")
            elif kind < 0.97:
                cells = [words(1) for _ in range(4)]
                gold += cells
                out.append("<table><tr>" + "".join(f"<td>{c}</td>" for c in cells[:2]) + "</tr><tr>" + "".join(f"<td>{c}</td>" for c in cells[2:]) + "</tr></table>")
            else:
                out.append(around(rng.choice(["ad", "aside", "share", "notice"])))
        return "".join(out), gold

    pages = []
    for _ in range(n):
        body, gold = article()
        wrap = rng.random()
        name = rng.choice(_INSIDE.split())
        if wrap < 0.5:
            body = f"<article>{body}</article>"
        elif wrap < 0.65:
            body = f"<main>{body}</main>"
        elif wrap < 0.75:
            body = f'<main><article class="{name}">{body}</article></main>'
        else:
            body = rng.choice([f'<div class="{name}">{body}</div>', f'<div id="{name}"><div class="{rng.choice(_INSIDE.split())}">{body}</div></div>', f"<div>{body}</div>"])
        before = [around(k) for k in ("header", "nav", "ad", "notice", "form", "aside") if rng.random() < 0.5]
        after = [around(k) for k in ("comments", "aside", "share", "ad", "form", "notice", "footer") if rng.random() < 0.5]
        inner = "".join([*before, body, *after])
        if rng.random() < 0.3:
            inner = f"<div{rng.choice(['', ' class=wrapper', ' id=page', ' class=container'])}>{inner}</div>"
        closing = rng.choice(["</body></html>", "</body></html>", ""])
        pages.append((f"<!DOCTYPE html><html><head><title>{esc(words(4))}</title><style>p{{}}</style></head><body>{inner}{closing}", "\n".join(gold)))
    return pages


_made: dict[int, Model] = {}


def default_model() -> Model:
    """Trained once a process on ``MADE_PAGES`` made pages."""
    if 0 not in _made:
        _made[0] = fit(labelled_pages())
    return _made[0]


def train(labelled: DataFrame) -> Model:
    """A model from rows (html, text), at most ``TRAIN_PAGES`` of them in order of their hash."""
    rows = labelled.select("html", "text").dropna().orderBy(F.xxhash64("html"), "text").limit(TRAIN_PAGES).collect()
    return fit([(r["html"], r["text"]) for r in rows])


def text_column(html: Column, model: Model | None = None) -> Column:
    model = model or default_model()

    @pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(x, model) for x in pages], dtype=object)

    return extract(html)


def main_texts(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    out = pages.select("page_id", "url", text_column(pages["html"], model).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


__all__ = ["Model", "Page", "default_model", "fit", "labelled_pages", "main_text", "main_texts", "text_column", "train"]
