"""Labelled training pages: layouts composed at random, every text marked as content or not when it is written."""

from __future__ import annotations

import random

SEED, PAGES = 11, 900
#: Marks around content while a page is composed: private-use characters.
_OPEN, _CLOSE = "\ue000", "\ue001"
_letters = random.Random(5)
_WORDS = ["".join(_letters.choices("abcdefghilmnoprstuv", k=_letters.randint(2, 9))) for _ in range(3000)]


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, a: int, b: int) -> str:
        r = self.rng
        return " ".join(r.choices(_WORDS, k=r.randint(a, b)))

    def content(self, text: str) -> str:
        return _OPEN + text + _CLOSE

    def link(self, text: str) -> str:
        return f'<a href="/{self.rng.randint(1, 99)}">{text}</a>'

    def sentence(self, long: bool = True) -> str:
        body = self.words(8, 60) if long else self.words(1, 8)
        text = body.capitalize() + (self.rng.choice([".", ".", ".", "!", "?"]) if long or self.rng.random() < 0.7 else "")
        if self.rng.random() < 0.25:
            parts = text.split(" ")
            k = self.rng.randrange(len(parts))
            parts[k] = self.rng.choice([f"<b>{parts[k]}</b>", f"<em>{parts[k]}</em>", self.link(parts[k]), f"<span>{parts[k]}</span>"])
            text = " ".join(parts)
        return text

    def menu(self) -> str:
        r, items = self.rng, [self.link(self.words(1, 3)) for _ in range(self.rng.randint(2, 9))]
        inner = r.choice(["<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " | ".join(items), "".join(f"<div>{i}</div>" for i in items)])
        return r.choice([f"<nav>{inner}</nav>", f'<div class="{r.choice(["menu", "nav", "navbar", "main-menu", "breadcrumb"])}">{inner}</div>', f'<nav class="menu">{inner}</nav>', f'<div role="navigation">{inner}</div>', inner if r.random() < 0.3 else f"<nav>{inner}</nav>"])

    def head(self) -> str:
        inner = self.rng.choice([f"<h1>{self.words(1, 5)}</h1>", self.words(1, 8), f"<p>{self.words(1, 12)}.</p>", self.link(self.words(1, 3))])
        return self.rng.choice([f"<header>{inner}{self.menu() if self.rng.random() < 0.5 else ''}</header>", f'<div class="{self.rng.choice(["header", "site-header", "masthead", "banner", "topbar"])}">{inner}</div>'])

    def foot(self) -> str:
        inner = self.rng.choice([f"&copy; {self.words(1, 3)} &middot; {self.sentence()}", f"<p>{self.words(2, 20)}</p>", f"© 2024 {self.words(1, 4)}", "".join(f"<p>{self.link(self.words(1, 3))}</p>" for _ in range(4)), f"<div>{self.sentence()}</div>"])
        return self.rng.choice([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f'<div class="{self.rng.choice(["footer", "site-footer", "copyright", "legal"])}">{inner}</div>', f'<div id="footer">{inner}</div>'])

    def lines(self) -> str:
        return self.rng.choice([self.sentence(), f"<p>{self.sentence()}</p>", f"<h3>{self.words(1, 4)}</h3><p>{self.sentence()}</p>", f"<p>{self.sentence()}</p><p>{self.sentence()}</p>", f"<div>{self.sentence()}</div>", "<ul>" + "".join(f"<li>{self.link(self.words(2, 8))}</li>" for _ in range(4)) + "</ul>"])

    def side(self) -> str:
        return self.rng.choice([f"<aside>{self.lines()}</aside>", f'<div class="{self.rng.choice(["sidebar", "side", "widget", "related", "recommended", "trending"])}">{self.lines()}</div>', f'<aside class="sidebar">{self.lines()}</aside>', f'<section class="related">{self.lines()}</section>'])

    def advert(self) -> str:
        return f'<{(t := self.rng.choice(["div", "div", "section", "aside", "p"]))} {self.rng.choice(["class", "id"])}="{self.rng.choice(["ad", "ads", "advert", "ad-banner", "sponsored", "promo", "advertisement"])}">{self.lines() if t != "p" else self.sentence()}</{t}>'

    def notice(self) -> str:
        return f'<{(t := self.rng.choice(["div", "div", "section", "dialog", "p"]))} {self.rng.choice(["class", "id"])}="{self.rng.choice(["cookie", "cookie-banner", "consent", "notice", "newsletter", "popup", "subscribe", "alert", "gdpr"])}">{self.lines() if t != "p" else self.sentence()}</{t}>'

    def form(self) -> str:
        return self.rng.choice([f'<form action="/s"><label>{self.words(1, 3)}</label><input name="q"><button>{self.words(1, 2)}</button></form>', f"<form><p>{self.sentence()}</p><select><option>{self.words(1, 2)}</option><option>{self.words(1, 2)}</option></select></form>", f'<form class="search">{self.words(1, 6)}</form>'])

    def comments(self) -> str:
        r = self.rng
        one = lambda: r.choice([f"<p>{self.sentence()}</p>", f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.sentence()}</p></div>', f"<li>{self.sentence()}</li>"])
        inner = f"<h3>{self.words(1, 2)}</h3>" * (r.random() < 0.5) + "".join(one() for _ in range(r.randint(1, 5)))
        return r.choice([f'<section class="comments">{inner}</section>', f'<div id="comments">{inner}</div>', f'<ul class="comment-list">{inner}</ul>', f'<div class="{r.choice(["comments", "replies", "discussion", "comment-thread"])}">{inner}</div>'])

    def junk(self) -> str:
        return self.rng.choice([self.advert, self.notice, self.side, self.form, self.menu, self.comments])()

    def block(self) -> str:
        r, c = self.rng, self.content
        kind = r.random()
        if kind < 0.62:
            return f"<p>{c(self.sentence(r.random() < 0.8))}</p>"
        if kind < 0.68:
            return f"<p><b>{c(self.sentence(False))}<br>"
        if kind < 0.74:
            return f"<{(h := r.choice(['h2', 'h3', 'h4']))}>{c(self.words(1, 8))}</{h}>"
        if kind < 0.79:
            return f"<{(u := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{c(self.sentence(r.random() < 0.5))}</li>" for _ in range(r.randint(1, 6))) + f"</{u}>"
        if kind < 0.83:
            return f"<blockquote>{r.choice([c(self.sentence()), '<p>' + c(self.sentence()) + '</p>'])}</blockquote>"
        if kind < 0.86:
            return f"<pre>{c(self.words(3, 20))}</pre>"
        if kind < 0.89:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{c(self.words(1, 4))}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if kind < 0.92:
            return f"<figure><img src='x'><figcaption>{c(self.sentence(False))}</figcaption></figure>"
        if kind < 0.96:
            return f"<div>{c(self.sentence())}</div>"
        return f"<section><h2>{c(self.words(1, 6))}</h2><p>{c(self.sentence())}</p></section>"

    def article(self) -> str:
        r = self.rng
        title = f"<h1>{self.content(self.words(2, 12))}</h1>" if r.random() < 0.85 else ""
        parts = [self.block() for _ in range(r.randint(1, 14))]
        for _ in range(r.choice([0, 0, 1, 2])):
            parts.insert(r.randint(0, len(parts)), r.choice([self.advert, self.notice, self.form, self.side])())
        if r.random() < 0.3:
            parts.append(self.comments())
        body = title + "".join(parts)
        kind = r.random()
        if r.random() < 0.45:
            return self.unmarked(body)
        if kind < 0.55:
            return f"<article>{body}</article>"
        if kind < 0.65:
            return f"<main><article>{body}</article>{self.comments() if r.random() < 0.3 else ''}</main>"
        if kind < 0.75:
            return f"<main>{body}</main>"
        return f'<div {r.choice(["class", "id"])}="{r.choice(["content", "post", "entry-content", "article-body", "story", "main-content", "post-body"])}">{body}</div>'

    def unmarked(self, body: str) -> str:
        """An article that nothing names: bare blocks, or in elements with any words or none for a class."""
        r = self.rng
        if r.random() < 0.1:
            body = "<br><br>".join(self.content(self.sentence()) for _ in range(r.randint(1, 6)))
        attribute = lambda: r.choice(["", "", f' class="{self.words(1, 2)}"', f' id="{self.words(1, 1)}"', f' class="{r.choice("abcxyz")}-{r.randint(1, 12)}"', f' class="{self.words(1, 1)}-{r.choice(["left", "right", "inner", "box", "more", "row"])}"'])
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            kind = r.choice(["div", "div", "div", "section", "center", "td"])
            body = f"<table><tr><td{attribute()}>{body}</td></tr></table>" if kind == "td" else f"<{kind}{attribute()}>{body}</{kind}>"
        return body

    def page(self) -> str:
        r = self.rng
        if r.random() < 0.03:  # no page at all but a text
            return self.content(self.sentence(r.random() < 0.5))
        before = [self.menu()] if r.random() < 0.8 else []
        before += [self.head()] * (r.random() < 0.5) + [self.advert()] * (r.random() < 0.5) + [self.notice()] * (r.random() < 0.3) + [self.side()] * (r.random() < 0.2)
        after = [self.junk() for _ in range(r.randint(0, 3))] + [self.foot()] * (r.random() < 0.9)
        r.shuffle(before)
        inner = "".join(before) + self.article() + "".join(after)
        if r.random() < 0.35:
            inner = f'<div class="{r.choice(["page", "wrapper", "container", "layout"])}">{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{inner}</body></html>"


def _labels(dom) -> list[int]:
    """A text block is content if it carries the mark, an element if most text under it does. The marks are removed."""
    n = len(dom.kind)
    good, every, labels = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if dom.texts[i] is not None:
            labels[i] = int(_OPEN in dom.texts[i])
            dom.texts[i] = " ".join(dom.texts[i].replace(_OPEN, "").replace(_CLOSE, "").split())
            good[i], every[i] = labels[i] * len(dom.texts[i]), len(dom.texts[i])
        else:
            # a container of the article is content whatever else was put into it, a wrapper of the whole page is not
            own = dom.kind[i] in ("article", "main") or dom.mark[i] == "content"
            wrapper = dom.kind[i] in ("html", "body") or (not dom.mark[i] and not own and dom.kind[dom.parent[i]] == "body" and good[i] < every[i] and dom.kind[i] in ("div", "table"))
            labels[i] = int(good[i] > 0 and not wrapper and (own or 2 * good[i] >= every[i]))
        good[dom.parent[i]] += good[i]
        every[dom.parent[i]] += every[i]
    return labels


def labelled_pages(pages: int = PAGES, seed: int = SEED):
    """(html, function that labels its Dom) of ``pages`` composed pages."""
    rng = random.Random(seed)
    for _ in range(pages):
        yield _Page(rng).page(), _labels


def held_out(pages: int = 200, seed: int = SEED + 1):
    """(html without marks, true main text) of pages from the same grammar with another seed."""
    from ledgerloom.llm.html_extract import Dom

    for page, labels_of in labelled_pages(pages, seed):
        dom = Dom(page)
        labels = labels_of(dom)
        yield page.replace(_OPEN, "").replace(_CLOSE, ""), "\n".join(t for t, x in zip(dom.texts, labels, strict=True) if t is not None and x)
