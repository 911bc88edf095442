"""Made-up labelled pages: (html, main text) of pages in many layouts, for training where no labelled pages are at hand.

A page is an article in one of several wrappers, amid menus, headers, footers, sidebars, notices, adverts, forms and reader
comments. Names of classes are drawn from what such elements are usually called; a share of the elements has none or
meaningless ones, so that the model has to weigh tags, links, lengths and neighbours as well. Words are made up.
"""

from __future__ import annotations

import html
import random
import re

#: What page authors call things, by kind.
NAMES = {
    "menu": "nav menu navbar navigation main-nav topnav breadcrumb breadcrumbs nav-links mega-menu tabs toc-menu site-nav pagination pager skip-links",
    "header": "header masthead topbar site-header page-header banner-top brand logo-bar hero-bar head",
    "footer": "footer site-footer page-footer foot colophon copyright legal bottom credits footer-links imprint",
    "sidebar": "sidebar side aside widget widget-area right-col rail secondary related related-posts recommended most-read trending popular more-stories teaser tags tag-cloud archive",
    "notice": "notice cookie cookie-notice cookie-banner consent gdpr-consent privacy-notice alert warning popup modal overlay toast paywall disclaimer announcement age-gate",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored sponsored-content promo promotion promoted ad-slot ad-box banner banner-ad adsbygoogle partner affiliate commercial deal",
    "form": "form login signup sign-in register search searchbox search-form newsletter subscribe subscription contact-form mailing-list feedback",
    "comments": "comments comment-list commentlist comment-section discussion responses replies user-comments reader-comments disqus thread reviews reactions",
    "comment": "comment comment-body reply response comment-text review message user-post",
    "share": "share sharing social social-links share-buttons toolbar actions print-tools follow",
    "content": "content article article-body main main-content post post-body post-content entry entry-content story story-body text body page-content body-text single copy prose",
}
_NAMES = {k: v.split() for k, v in NAMES.items()}
_TAGS = {
    "menu": ["nav", "nav", "div", "ul", "menu"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"],
    "sidebar": ["aside", "aside", "div", "section"], "notice": ["div", "div", "section", "dialog", "p"], "ad": ["div", "div", "aside", "section", "p"],
    "form": ["form", "form", "div", "section"], "comments": ["section", "div", "div", "ol"], "share": ["div", "ul"],
}
_SYLLABLES = "an er to lin ka ve mo ri sen tu del par qui os ble ent ing ta lo mi né ür ña sch".split()


class _Author:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        text = self.words(3, 22).capitalize()
        return text + self.r.choice([".", ".", ".", ".", "!", "?", ' & more.', '."'])

    def prose(self, most: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def name(self, kind: str) -> str:
        """Half the time one of the commonest, which come first."""
        return self.r.choice(_NAMES[kind][: 4 if self.r.random() < 0.5 else None])

    def attributes(self, kind: str) -> str:
        """Usually a telling class or id, at times among others, at times none."""
        draw = self.r.random()
        if draw < 0.2:
            return "" if draw < 0.12 else f' class="{self.word()}-{self.r.randint(1, 99)}"'
        name = self.name(kind)
        more = f" {self.word()}" if self.r.random() < 0.2 else ""
        return f' {self.r.choice(["class", "class", "id"])}="{name}{more}"'

    def element(self, kind: str, inside: str, tags: list[str] | None = None) -> str:
        tag = self.r.choice(tags or _TAGS[kind])
        # A plain tag without a telling name says nothing; such boxes keep their name.
        names = self.attributes(kind)
        while tag in ("div", "section", "ul", "ol", "p", "article", "li") and "=" not in names and self.r.random() < 0.9:
            names = self.attributes(kind)
        tag = "div" if tag == "p" and re.search(r"<(p|h\d|div|ul|form|fieldset)\b", inside) else tag  # a paragraph can't hold them
        return f"<{tag}{names}>{inside}</{tag}>"

    def junk(self) -> str:
        """Articles hold lists of words, shouting and repeated words, too."""
        text = self.r.choice([self.words(4, 60), " ".join([self.word()] * self.r.randint(2, 12)) + " " + self.words(1, 40), self.words(3, 30).upper(), self.prose(5)])
        return text.replace(" ", self.r.choice([" ", "!! ", " | ", "&&& ", "%%% "]))

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.words(low, high)}</a>'

    def links(self) -> str:
        n = self.r.randint(2, 9)
        return "<ul>" + "".join(f"<li>{self.link(1, 6)}</li>" for _ in range(n)) + "</ul>" if self.r.random() < 0.6 else self.r.choice([" ", " | ", ""]).join(self.link() for _ in range(n))

    # What is no content

    def menu(self) -> str:
        return self.element("menu", self.links())

    def header(self) -> str:
        r = self.r
        inside = r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<div>{self.words(1, 3)}</div>", f"<p>{self.words(2, 8)}</p>", self.link()])
        return self.element("header", inside + (self.menu() if r.random() < 0.5 else "") + (f"<p>{self.words(2, 9)}</p>" if r.random() < 0.4 else ""))

    def footer(self) -> str:
        r = self.r
        text = f"&copy; {r.randint(1999, 2026)} {self.words(1, 4)} &middot; {self.prose(1)}"
        return self.element("footer", r.choice([text, f"<p>{text}</p>", f"<div>{text}</div>{self.links()}", f"<p>{self.prose(2)}</p>{self.links()}<p>{text}</p>"]))

    def sidebar(self) -> str:
        parts = [f"<h{self.r.randint(2, 4)}>{self.words(1, 4)}</h3>" + self.r.choice([self.links(), f"<p>{self.prose(3)}</p>", f"<div>{self.prose(2)} {self.link()}</div>"]) for _ in range(self.r.randint(1, 3))]
        return self.element("sidebar", "".join(parts))

    def notice(self) -> str:
        text = self.prose(4)
        return self.element("notice", self.r.choice([text, f"<p>{text}</p>", f"<p>{text}</p><button>{self.word()}</button>", f"<h3>{self.words(1, 4)}</h3><p>{text} {self.link()}</p>"]))

    def ad(self) -> str:
        text = self.prose(5)
        return self.element("ad", self.r.choice([text, text, f"<p>{text}</p>", f"<span>{self.words(1, 2)}</span><p>{text}</p>{self.link()}", f"<h4>{self.words(2, 6)}</h4><p>{text}</p>", self.link(2, 9)]))

    def form(self) -> str:
        field = f"<label>{self.words(1, 3)}</label><input><select><option>{self.word()}</select>"
        return self.element("form", self.r.choice([field, f"<p>{self.prose(3)}</p>{field}", f"<h3>{self.words(1, 5)}</h3><p>{self.prose(2)}</p>{field}<button>{self.word()}</button>", f"<fieldset><legend>{self.words(1, 3)}</legend>{field}</fieldset>"]))

    def share(self) -> str:
        return self.element("share", self.links())

    def comments(self) -> str:
        r = self.r
        one = lambda: self.element("comment", r.choice([f"<p>{self.prose(5)}</p>", f"<div>{self.words(1, 2)}</div><p>{self.prose(4)}</p>", self.prose(5), f"<h4>{self.words(1, 2)}</h4><p>{self.prose(3)}</p><p>{self.prose(3)}</p>{self.link()}"]), ["div", "li", "article", "section"])
        inside = (f"<h3>{r.randint(1, 99)} {self.words(1, 2)}</h3>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 6)))
        name = f' {r.choice(["class", "id"])}="{self.name("comments")}"'
        tag = r.choice(_TAGS["comments"])
        return f"<{tag}{name}>{inside}</{tag}>" + (self.form() if r.random() < 0.3 else "")

    # What is

    def block(self, out: list[str]) -> str:
        """One block of content; its text goes to out."""
        r = self.r
        kind = r.random()

        def said(text: str) -> str:
            out.append(" ".join(text.split()))
            return html.escape(text, quote=r.random() < 0.5)

        length = 1 if r.random() < 0.12 else 0  # some paragraphs are a word or two
        prose = lambda: self.words(1, 2).capitalize() + "." if length else self.junk() if r.random() < 0.15 else self.prose(9)
        if kind < 0.55:
            text = prose()
            return f"<p>{said(text)}" + ("</p>" if r.random() < 0.85 else "")
        if kind < 0.63:
            return f"<p><b>{said(prose())}<br>"
        if kind < 0.69:
            head, tail, link = self.prose(3), self.prose(2), self.words(1, 4)
            out.append(f"{head} {link} {tail}")
            return f'<p>{html.escape(head)} <a href="/{self.word()}">{link}</a> {html.escape(tail)}</p>'
        if kind < 0.77:
            tag = r.choice(["h2", "h2", "h3", "h4"])
            return f"<{tag}>{said(self.words(1, 8))}</{tag}>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{said(self.words(2, 25))}" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.89:
            return f"<blockquote>{said(self.prose(4))}</blockquote>"
        if kind < 0.93:
            return "<table>" + "".join(f"<tr><td>{said(self.words(1, 4))}</td><td>{said(self.words(1, 6))}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>"
        if kind < 0.96:
            return f"<figure><img><figcaption>{said(self.words(3, 15))}</figcaption></figure>"
        return f"<div>{said(self.prose(6))}</div>"

    def page(self) -> tuple[str, str]:
        r = self.r
        out: list[str] = []
        title = self.words(2, 9).capitalize()
        before = [f for f, p in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.7), (self.ad, 0.5), (self.form, 0.2), (self.sidebar, 0.15)) if r.random() < p]
        after = [f for f, p in ((self.share, 0.2), (self.comments, 0.35), (self.sidebar, 0.4), (self.ad, 0.3), (self.form, 0.25), (self.menu, 0.2), (self.footer, 0.85), (self.notice, 0.15)) if r.random() < p]
        r.shuffle(before)
        top = "".join(f() for f in before)
        body: list[str] = []
        if r.random() < 0.8:
            out.append(title)
            body.append(f"<h1>{title}</h1>")
        short = r.random() < 0.2  # hardly longer than what surrounds it
        for _ in range(r.randint(1, 2) if short else r.randint(1, 16)):
            if short:
                text = r.choice([self.words(1, 9).capitalize() + ".", self.prose(5), self.junk()])
                out.append(" ".join(text.split()))
                body.append(r.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>"]).format(html.escape(text)))
                continue
            body.append(self.block(out))
            if r.random() < 0.06:
                body.append(r.choice([self.ad, self.ad, self.sidebar, self.share, self.form, self.notice])())
        if r.random() < 0.2:
            body.append(r.choice([self.comments, self.share, self.sidebar])())
        inside = "".join(body)
        wrapped = r.random()
        if wrapped < 0.4:
            inside = f"<article{self.attributes('content') if r.random() < 0.4 else ''}>{inside}</article>"
        elif wrapped < 0.5:
            inside = f"<main>{inside}</main>"
        elif wrapped < 0.58:
            inside = f"<main><article>{inside}</article></main>"
        elif wrapped < 0.9:
            tag = r.choice(["div", "div", "div", "section", "td"])
            inside = f"<{tag}{self.attributes('content')}>{inside}</{tag}>"
            inside = f"<table><tr>{inside}</table>" if tag == "td" else inside
        bottom = "".join(f() for f in after)
        whole = top + inside + bottom
        if r.random() < 0.3:
            whole = f'<div class="{r.choice(["wrapper", "container", "page", "site", self.word()])}">{whole}</div>'
        end = "</body></html>" if r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>x='</p>'</script></head><body>{whole}{end}", "\n\n".join(out)


def labelled_pages(n: int, seed: int = 0) -> list[tuple[str, str]]:
    """n pages with their main texts."""
    author = _Author(seed)
    return [author.page() for _ in range(n)]
