"""Main-text extraction with a tree-structured graphical model of the DOM.

Nodes are block elements and the text blocks between them; each is content or not. A node's evidence (kind of element, words
of its class, id and role, length, share of link text, copyright sign) has a potential per label, and a parent and
child have a joint potential by kind of child and by the region that it is in: that of the nearest ancestor whose element or class words tell one (menu, side,
comment, content, ...), where a region of no content holds for all below it, and ``plain`` where no ancestor tells. So articles without any marks are
found by their texts, and the same texts in a sidebar are not. Sum-product messages go up from the leaves and back down, which gives every
node's exact marginal; text blocks with a content marginal of one half or more are the main text.

All potentials are smoothed counts over labelled pages (``html_pages.labelled_pages``), frozen before extraction.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by one line
feed in page order. Inline elements and ``br`` do not end a block. A link ends at its end tag, at the next link, or at the first edge of a block after text
in it; an anchor without an address is none.

Results for special input: a null or empty page gives the empty text; text without any element is one block under
the document; unclosed elements end where the next block of their kind or their parent ends; nesting has no limit, as
no step recurses; nothing is cut or capped.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.textkit import annotate, strings

# Elements that make blocks, those whose content is no text, void ones, and what a start tag closes.
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 header footer nav aside ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset blockquote pre figure figcaption address details summary center hr dialog menu label button select option legend".split())
DROPPED = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = BLOCKS - {"label", "button", "select", "option", "legend"}
SAME_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "tfoot"}}
REGIONS = {"nav": "menu", "menu": "menu", "aside": "side", "footer": "foot", "header": "head", "form": "form", "dialog": "notice", "article": "content", "main": "content"}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words of class, id and role by what they tell.
CUES = {
    "content": "article content post entry story main body text prose markdown",
    "menu": "nav navbar menu breadcrumb breadcrumbs navigation toc pagination pager tabs",
    "head": "header masthead banner topbar logo branding",
    "foot": "footer copyright colophon legal bottom contentinfo",
    "side": "sidebar side aside related widget widgets recommended recommend trending popular complementary teaser",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion",
    "notice": "cookie cookies consent notice notices gdpr newsletter subscribe subscription popup modal alert paywall signup overlay dialog",
    "comment": "comment comments reply replies discussion disqus respond thread",
    "form": "form search login contact",
    "share": "share sharing social meta byline tags tag author",
    "caption": "caption figure gallery image",
}
_CUE_OF = {w: cue for cue, words in CUES.items() for w in words.split()}
_CUE_ORDER = ["comment", "advert", "notice", "menu", "side", "foot", "head", "form", "share", "caption", "content"]
_OPEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?]")
_STOP = re.compile(r">|=\s*(?=([\"'])|)")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_EMPTY_COMMENT = re.compile(r"-?>")
_HREF = re.compile(r"\bhref\b", re.I)
CONTENT, LABELS = 1, (0, 1)
#: Texts of all regions that count as seen in each one.
REGION_WEIGHT = 50


def cue(attributes: str) -> str:
    """What class, id and role say of an element; the most telling word wins."""
    if "=" not in attributes:
        return ""
    found = {_CUE_OF.get(w) for m in _ATTRIBUTE.finditer(attributes) for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", next(g for g in m.groups() if g is not None)).lower())}
    return next((c for c in _CUE_ORDER if c in found), "")


class Tags:
    """The tags of a page in order. A quote counts only as the first character of a value, and one that is never closed is a
    character like any other; what was looked for in vain is not looked for again, so time is linear in the page."""

    def __init__(self, page: str):
        self.page, self.absent = page, set()

    def _find(self, what: str, at: int) -> int:
        found = -1 if what in self.absent else self.page.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def _end(self, at: int) -> int:
        """Place after the tag whose attributes begin at ``at``, or -1."""
        if self._find(">", at) < 0:
            return -1
        while m := _STOP.search(self.page, at):
            at = m.end()
            if m[0] == ">":
                return at
            if m[1]:
                close = self._find(m[1], at + 1)
                at = close + 1 if close >= 0 else at + 1
        self.absent.add(">")
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """(start, end, whether it closes, name or None for what is no element, attributes) of the next tag."""
        while m := _OPEN.search(self.page, at):
            name = m[2]
            if name is None:
                empty = m[0] == "<!--" and _EMPTY_COMMENT.match(self.page, m.end())
                end = empty.end() - 1 if empty else self._find("-->" if m[0] == "<!--" else ">", m.end())
                end = len(self.page) if end < 0 and m[0] == "<!--" else end + (1 if empty or m[0] != "<!--" else 3)
            else:
                end = self._end(m.end())
            if end > 0:
                return m.start(), end, bool(m[1]), name and name.lower(), self.page[m.end() : end - 1] if name else ""
            at = m.end()
        return None


class Dom:
    """Block elements and text blocks in page order: parent, kind and evidence of each, and the texts of blocks."""

    def __init__(self, page: str):
        self.parent, self.kind, self.texts = [-1], ["#document"], [None]
        self.linked: list[int] = [0]
        self.mark: list[str | None] = [None]
        stack, tags, reader = [0], ["#document"], Tags(page)
        places: dict[str, list[int]] = {}  # depths of the open elements of each name
        pieces: list[str] = []
        links = in_link = at = 0

        def end_block():
            nonlocal links, in_link
            if links:
                in_link = 0
            if pieces:
                text = " ".join("".join(pieces).split())
                pieces.clear()
                if text:
                    self.parent.append(stack[-1])
                    self.kind.append("#text")
                    self.texts.append(text)
                    self.linked.append(links)
                    self.mark.append(None)
            links = 0

        def close_to(depth: int):
            end_block()
            for name in tags[depth:]:
                places[name].pop()
            del stack[depth:], tags[depth:]

        def close_last(name: str):
            close_to(places[name][-1])

        def add_text(raw: str):
            nonlocal links
            if raw:
                text = _html.unescape(raw) if "&" in raw else raw
                pieces.append(text)
                if in_link:
                    links += len(text.strip())

        size = len(page)
        while at < size:
            tag = reader.next(at)
            if tag is None:
                add_text(page[at:])
                break
            start, end, closes, name, attributes = tag
            add_text(page[at:start])
            at = end
            if name is None:
                continue
            if closes:
                if name == "a":
                    in_link = 0
                elif places.get(name):
                    close_last(name)
                elif name == "p":
                    end_block()
                continue
            if name in DROPPED and not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                if name == "head" and close is None:
                    continue
                at = close.end() if close else size
                if name == "head":
                    end_block()
                continue
            if name == "a":
                in_link = int(_HREF.search(attributes) is not None)
            if name not in BLOCKS:
                continue
            if name in CLOSES_P and places.get("p"):
                close_last("p")
            end_block()
            if name in SAME_KIND:
                nearest = lambda names: max((places[k][-1] for k in names if places.get(k)), default=0)
                same = nearest(SAME_KIND[name])
                if same and same >= (nearest(SCOPES[name]) if name in SCOPES else len(tags) - 1):
                    close_to(same)
            if name in VOID or attributes.endswith("/"):
                continue
            self.parent.append(stack[-1])
            self.kind.append(name)
            self.texts.append(None)
            self.linked.append(0)
            self.mark.append(cue(attributes))
            stack.append(len(self.kind) - 1)
            places.setdefault(name, []).append(len(tags))
            tags.append(name)
        end_block()

    def evidence(self) -> list[tuple[str, tuple[str, ...]]]:
        """For every node the kind that its tie to the parent depends on, ``element mark@region``, and its features."""
        out = []
        regions = ["plain"] * len(self.kind)
        for i, kind in enumerate(self.kind):
            around = regions[self.parent[i]] if i else "plain"
            if kind == "#text":
                text = self.texts[i]
                words = text.count(" ") + 1
                length = "1" if words < 3 else "2" if words < 8 else "3" if words < 25 else "4"
                share = self.linked[i] / max(1, len(text))
                link = "none" if share == 0 else "some" if share < 0.6 else "most"
                sign = "sign" if "©" in text else "plain"
                out.append((f"#text@{around}", (f"shape@{around} {length} {link}", f"copyright {sign}")))
            else:
                mark = self.mark[i]
                regions[i] = around if around not in ("plain", "content") else mark or REGIONS.get(kind, around)
                out.append((f"{kind} {mark}@{around}" if mark else f"{kind}@{around}", (f"cue {mark}",) if mark else ()))
        return out


def _anywhere(feature: str) -> str:
    """A feature without the region that it is counted for."""
    head, _, rest = feature.partition(" ")
    return f"{head.split('@')[0]} {rest}"


class TreeModel:
    """Potentials of nodes and of parent-child ties."""

    def __init__(self):
        self.tie: dict[str, list[float]] = {}
        self.feature: dict[str, list[float]] = {}
        self.tie_counts: dict[str, list[float]] = {}
        self.feature_counts: dict[str, list[float]] = {}
        self.label_counts = [0.0, 0.0]

    def learn(self, dom: Dom, labels: list[int]) -> None:
        for i, (kind, features) in enumerate(dom.evidence()):
            if i:
                for k in {*self._keys(kind)}:
                    self.tie_counts.setdefault(k, [0.0] * 4)[2 * labels[dom.parent[i]] + labels[i]] += 1
            self.label_counts[labels[i]] += dom.kind[i] == "#text"
            for f in features:
                for k in {f, _anywhere(f)}:
                    self.feature_counts.setdefault(k, [0.0] * 2)[labels[i]] += 1

    def freeze(self) -> None:
        """Smoothed counts: P(child | parent) per kind of child, and P(feature | label) ratios."""
        for k, c in self.tie_counts.items():
            self.tie[k] = [(c[2 * p + x] + 0.5) / (c[2 * p] + c[2 * p + 1] + 1) for p in LABELS for x in LABELS]
        totals: dict[str, list[float]] = {}
        for f, c in self.feature_counts.items():
            t = totals.setdefault(f.split(" ")[0], [0.0, 0.0])
            t[0], t[1] = t[0] + c[0], t[1] + c[1]
        share = lambda f, x, prior, weight: (self.feature_counts[f][x] + weight * prior) / (totals[f.split(" ")[0]][x] + weight)
        for f in self.feature_counts:
            # a region's shapes are smoothed by those of all regions
            own = _anywhere(f)
            wide = [share(own, x, 0.5, 1) for x in LABELS]
            self.feature[f] = wide if own == f else [share(f, x, wide[x], REGION_WEIGHT) for x in LABELS]

    @staticmethod
    def _keys(kind: str) -> tuple[str, ...]:
        """A kind and what stands for it where it was never seen: its mark and region, its region."""
        return kind, kind.split(" ")[-1], kind[kind.index("@") :], "*"

    def _tie(self, kind: str) -> list[float]:
        return next(t for k in self._keys(kind) if (t := self.tie.get(k)))

    def marginals(self, dom: Dom) -> list[float]:
        """P(content) of every node by sum-product: messages to parents, then to children. Parents stand before children."""
        n, evidence = len(dom.kind), dom.evidence()
        local = []
        for _, features in evidence:
            a = b = 1.0
            for f in features:
                p = self.feature.get(f)
                if p:
                    a, b = a * p[0], b * p[1]
            s = a + b
            local.append([a / s, b / s])
        ties = [self._tie(k) for k, _ in evidence]
        below = [x[:] for x in local]  # local evidence times the messages of all children
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            t, (b0, b1) = ties[i], below[i]
            m0, m1 = t[0] * b0 + t[1] * b1, t[2] * b0 + t[3] * b1
            s = m0 + m1
            up[i] = (m0 / s, m1 / s)
            p = below[dom.parent[i]]
            p[0] *= up[i][0]
            p[1] *= up[i][1]
            s = p[0] + p[1]
            if s < 1e-200:
                p[0], p[1] = (p[0] / s, p[1] / s) if s else (0.5, 0.5)
        belief: list[tuple[float, float]] = [(0.5, 0.5)] * n
        root = [below[0][0], 0.0]  # the document itself is no content
        belief[0] = (root[0] / (root[0] + root[1]) if root[0] else 1.0, 0.0)
        for i in range(1, n):
            q0, q1 = belief[dom.parent[i]]
            # the parent's belief without this child's message
            q0, q1 = q0 / max(up[i][0], 1e-300), q1 / max(up[i][1], 1e-300)
            t, (b0, b1) = ties[i], below[i]
            r0, r1 = b0 * (q0 * t[0] + q1 * t[2]), b1 * (q0 * t[1] + q1 * t[3])
            s = r0 + r1
            belief[i] = (r0 / s, r1 / s) if s > 0 and math.isfinite(s) else (0.5, 0.5)
        return [b for _, b in belief]

    def extract(self, page: str) -> str:
        if not page:
            return ""
        dom = Dom(page)
        content = self.marginals(dom)
        return "\n".join(t for t, p in zip(dom.texts, content, strict=True) if t is not None and p >= 0.5)


def train(pages) -> TreeModel:
    """``pages``: (html, function from a Dom to the label of every node)."""
    model = TreeModel()
    for page, labels_of in pages:
        dom = Dom(page)
        model.learn(dom, labels_of(dom))
    model.freeze()
    return model


def extract_pages(df: DataFrame, model: TreeModel | None = None, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``df`` with the main text of every whole page."""
    if model is None:
        from ledgerloom.llm.html_pages import labelled_pages

        model = train(labelled_pages())
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few hundred counts

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([shared.value.extract(x) for x in strings(part, html_col)], pa.string())]

    return annotate(df.withColumn(html_col, F.col(html_col).cast("string")), compute, [T.StructField(text_col, T.StringType())], html_col)
