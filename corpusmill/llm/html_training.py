"""Made pages with known main text: varied layouts, with and without telling tags and attributes.

No labelled pages exist, so the extractor is fitted on these. Elements that are not main text carry data-off; the
reader of training pages turns the marks into labels and drops them from the features.
"""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ren tos pal ven dor is an ter mo sil que bra un ell or tin ess va ry chu".split()

#: Attribute words that pages use for parts that are not main text, and for those that are.
OFF_NAMES = {
    "menu": ["nav", "navbar", "main-menu", "menu", "site-navigation", "breadcrumb", "breadcrumbs", "topnav", "pagination", "pager", "toc"],
    "header": ["header", "site-header", "masthead", "top-bar", "branding", "logo"],
    "footer": ["footer", "site-footer", "page-footer", "bottom", "copyright", "colophon", "legal"],
    "side": ["sidebar", "aside", "widget", "related", "related-posts", "recommended", "tags", "archive-list", "see-also", "author-box", "trending"],
    "notice": ["cookie-notice", "cookie-banner", "notice", "alert", "gdpr", "consent", "announcement", "warning-box", "banner", "paywall", "message"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "adsbox", "partner-offer", "promotion"],
    "form": ["search", "newsletter", "subscribe", "login", "signup", "contact-form", "poll"],
    "comments": ["comments", "comment-list", "commentlist", "comment", "respond", "discussion", "replies", "user-comments", "disqus_thread", "reviews"],
    "share": ["share", "social", "share-buttons", "follow-us", "sharing", "meta", "byline"],
}
ON_NAMES = ["content", "article", "post", "entry-content", "main", "article-body", "story", "text", "post-body", "page-content"]
PLAIN_NAMES = ["wrap", "container", "row", "col", "inner", "block", "box", "section", "page", "layout", "c1", "x7"]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice([1, 1, 2, 2, 3])))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentences(self, a: int, b: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.r.choice([".", ".", ".", "!", "?"]) for _ in range(self.r.randint(a, b)))

    def attribute(self, names: list[str], telling: bool) -> str:
        name = self.r.choice(names) if telling else self.r.choice(PLAIN_NAMES + [""])
        if not name:
            return ""
        extra = f" {self.r.choice(PLAIN_NAMES)}" if self.r.random() < 0.25 else ""
        return f' {self.r.choice(["class", "class", "id"])}="{name}{extra}"'

    def links(self, a: int, b: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{self.word()}">{self.words(1, 3)}</a></{tag}>' for _ in range(self.r.randint(a, b)))

    def off(self, kind: str, telling: bool) -> str:
        r = self.r
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "notice": "div", "ad": "div", "form": "form", "comments": "section", "share": "div"}[kind]
        if r.random() < 0.45:
            tag = r.choice(["div", "section", "ul" if kind in ("menu", "share") else "div"])
        known = telling or tag in ("div", "section", "ul") and r.random() < 0.7
        a = self.attribute(OFF_NAMES[kind], known)
        if kind == "menu":
            body = self.links(1, 10) if tag == "ul" else f"<ul>{self.links(1, 10)}</ul>" if r.random() < 0.7 else "".join(f'<a href="#">{self.words(1, 2)}</a> ' for _ in range(r.randint(1, 8)))
        elif kind == "header":
            body = r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<div>{self.words(1, 4)}</div>", f'<a href="/">{self.words(1, 2)}</a>', f"<p>{self.sentences(1, 1)}</p>"]) + (f"<ul>{self.links(2, 6)}</ul>" if r.random() < 0.4 else "")
        elif kind == "footer":
            body = r.choice([f"&copy; {self.word()}.example &middot; {self.sentences(1, 2)}", f"<p>&copy; 2024 {self.words(1, 3)}. {self.sentences(1, 1)}</p><ul>{self.links(2, 6)}</ul>", f"<p>{self.sentences(1, 3)}</p>", f"{self.sentences(1, 2)}"])
        elif kind == "side":
            body = f"<h{r.choice('234')}>{self.words(1, 3)}</h3>" * (r.random() < 0.7) + r.choice([f"<ul>{self.links(2, 8)}</ul>", f"<p>{self.sentences(1, 2)}</p>", f"<div>{self.sentences(1, 2)}</div>", f"<p>{self.sentences(1, 2)}</p><ul>{self.links(1, 5)}</ul>"])
        elif kind == "notice":
            body = r.choice([self.sentences(1, 2), f"<p>{self.sentences(1, 3)}</p>", f"<p>{self.sentences(1, 2)}</p><button>{self.word()}</button>", f"<span>{self.sentences(1, 1)}</span> <a href='#'>{self.words(1, 2)}</a>"])
        elif kind == "ad":
            body = r.choice([self.sentences(1, 2), f"<p>{self.sentences(1, 2)}</p>", f"<a href='http://ad'>{self.sentences(1, 1)}</a>", f"<h4>{self.words(1, 4)}</h4><p>{self.sentences(1, 2)}</p>"])
        elif kind == "form":
            body = f"<label>{self.words(1, 3)}</label><input name=q><button>{self.word()}</button>" + f"<p>{self.sentences(1, 2)}</p>" * (r.random() < 0.6)
        elif kind == "comments":
            one = lambda: f'<div{self.attribute(["comment", "comment-body", "reply"], r.random() < 0.7)}>' + r.choice([f"<b>{self.word()}</b>: ", f"<p>{self.words(1, 2)}</p>", ""]) + f"<p>{self.sentences(1, 4)}</p></div>"
            item = lambda: f"<li>{self.words(1, 2)}: {self.sentences(1, 3)}</li>"
            body = f"<h3>{self.words(1, 3)}</h3>" * (r.random() < 0.7) + ("".join(one() for _ in range(r.randint(1, 6))) if r.random() < 0.6 else "<ol>" + "".join(item() for _ in range(r.randint(1, 6))) + "</ol>" if r.random() < 0.6 else "".join(f"<p>{self.sentences(1, 4)}</p>" for _ in range(r.randint(1, 4))))
        else:
            body = f"<ul>{self.links(2, 5)}</ul>" if tag != "ul" and r.random() < 0.6 else self.links(2, 5) if tag == "ul" else f"{self.words(2, 6)} <a href='#'>{self.word()}</a>"
        return f"<{tag}{a} data-off>{body}</{tag}>"

    def block(self) -> str:
        r, k = self.r, self.r.random()
        if k < 0.68:
            text = self.sentences(1, 7) if r.random() < 0.85 else self.words(1, 4) + r.choice([".", ""])
            if r.random() < 0.25:
                w = text.split(" ")
                i = r.randrange(len(w))
                w[i] = f'<a href="/x">{w[i]}</a>' if r.random() < 0.6 else f"<b>{w[i]}</b>"
                text = " ".join(w)
            return r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<p><b>{}<br></p>"]).format(text)
        if k < 0.78:
            return f"<h{r.choice('234')}>{self.words(1, 7)}</h{r.choice('234')}>"
        if k < 0.86:
            t = r.choice(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{self.sentences(1, 2) if r.random() < 0.6 else self.words(1, 6)}</li>" for _ in range(r.randint(2, 7))) + f"</{t}>"
        if k < 0.9:
            return f"<blockquote>{self.sentences(1, 3)}</blockquote>"
        if k < 0.94:
            return f"<pre>{self.words(3, 20)}</pre>"
        if k < 0.97:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        return f"<figure><img src=x><figcaption>{self.sentences(1, 1)}</figcaption></figure>"

    def page(self) -> str:
        r = self.r
        telling = r.random() < 0.75
        inside = [f"<h1>{self.words(1, 12)}</h1>"] * (r.random() < 0.9) + [self.block() for _ in range(r.choice([0, 1, 1, 2, 2, 3, 3, 4, 5, 8, 14]))]
        if len(inside) > 1 and inside[0].startswith("<h1") and r.random() < 0.15:
            inside[0] = f"<header>{inside[0]}</header>"
        if not inside:
            inside = [f"<p>{self.sentences(1, 3)}</p>"]
        marked = list(inside)
        for kind in ("ad", "side", "share", "notice", "form"):
            if r.random() < 0.22:
                marked.insert(r.randint(1, len(marked)), self.off(kind, telling or r.random() < 0.6))
        if r.random() < 0.15:
            marked.append(self.off("comments", telling or r.random() < 0.6))
        body = "".join(marked)
        shape = r.random()
        if shape < 0.55:
            body = f"<article{self.attribute(ON_NAMES, telling)}>{body}</article>"
        elif shape < 0.68:
            body = f"<main{self.attribute(ON_NAMES, telling)}>{body}</main>"
        elif shape < 0.87:
            body = f"<div{self.attribute(ON_NAMES, telling)}>{body}</div>"
        before = [self.off(k, telling or r.random() < 0.6) for k, p in (("notice", 0.25), ("header", 0.55), ("menu", 0.7), ("ad", 0.4), ("form", 0.2)) if r.random() < p]
        after = [self.off(k, telling or r.random() < 0.6) for k, p in (("share", 0.2), ("side", 0.45), ("comments", 0.4), ("ad", 0.2), ("form", 0.2), ("menu", 0.15), ("notice", 0.1), ("footer", 0.75)) if r.random() < p]
        if r.random() < 0.2:
            before = []
        if r.random() < 0.25:
            after = []
        if r.random() < 0.2 and after:
            before.append(after.pop(0))
        if r.random() < 0.3:
            r.shuffle(before)
        middle = "".join(before) + body + "".join(after)
        if r.random() < 0.4:
            middle = f"<div{self.attribute([], False)}>{middle}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title></head><body>{middle}</body></html>"
