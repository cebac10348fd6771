"""Made-up web pages with known labels, for the classifier of :mod:`torrentine.llm.html_cut`.

Layouts, names and texts are drawn with a fixed seed. Names mislead on purpose now and then: a wrapper may be called
``no-sidebar``, a page may be one form, an article may bear a word of advertising. Half of the pages have no names that say
anything: none at all, or those that tools make up. Such pages may be laid out in a table, have ``div`` for every element,
or an article of bare text with line breaks.
"""

from __future__ import annotations

import random

#: Pages in the sample.
PAGES = 3000

# Words that pages name their parts with.
CONTENT = "content post entry article story post-content entry-content article-body main-content body-text text page-content richtext main".split()
WRAP = "wrapper container page site row layout inner no-sidebar has-sidebar comments-open with-ads tag-ads related-work col-8 l-main app root category-notice".split()
BESIDE = {
    "menu": "menu nav navbar navigation main-nav site-nav topbar breadcrumb breadcrumbs pagination pager toolbar dropdown".split(),
    "head": "header site-header masthead page-header banner top".split(),
    "foot": "footer site-footer page-footer copyright colophon".split(),
    "side": "sidebar widget widgets aside side-column related recommended trending tagcloud sidebar-widget".split(),
    "ad": "ad ads advert advertisement banner-ad sponsored sponsor promo promoted adsbox".split(),
    "notice": "cookie-notice cookie consent gdpr notice alert-bar overlay modal popup paywall warning".split(),
    "comments": "comments comment-list commentlist disqus discussion replies comment reply-list".split(),
    "form": "newsletter signup subscribe search-box login contact-form".split(),
    "share": "share sharing social share-buttons toolbar byline-share".split(),
}
NOTICES = ["We use cookies to make this site better. Accept all of them, please.", "This website uses cookies; read our policy.", "Please subscribe to our newsletter, it is free.", "You have read all free articles, sign in to go on.", "By going on you accept our cookie policy and our terms."]
RIGHTS = ["Copyright 2024 Example", "© 2023 example.com", "All rights reserved.", "© example.org · Terms and privacy"]
SHARES = ["Share", "Share this article", "Tweet", "Print", "Follow us", "Email this"]
MORES = ["Related articles", "Read more", "See also", "Recommended for you", "Trending now", "You may also like"]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.content: set[str] = set()
        #: What names the page has: those of the lists, made-up ones, or none; and whether it has ``div`` for all elements of its layout.
        self.named = self.r.choices(["lists", "made up", "none"], [50, 30, 20])[0]
        self.divs = self.named != "lists" and self.r.random() < 0.5

    def attr(self, names: list[str], keys: tuple[str, ...] = ("class", "class", "id")) -> str:
        """An attribute that names an element, drawn from ``names`` where the page's names say anything."""
        if self.named == "none":
            return ""
        if self.named == "lists":
            return f' {self.r.choice(keys)}="{self.r.choice(names)}"'
        made = lambda n: "".join(self.r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
        return f' class="{self.r.choice(["css-", "sc-", "_", "jsx-", ""])}{self.r.choice("abcdefghijklmnopqrstuvwxyz")}{made(self.r.randint(3, 6))}"'

    def word(self) -> str:
        return "".join(self.r.choice("aeiou") if i % 2 else self.r.choice("bcdfghlmnprstvw") for i in range(self.r.randint(2, 9)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def label(self, low: int, high: int) -> str:
        """Words of a menu, mostly with capitals."""
        text = self.words(low, high)
        return text if self.r.random() < 0.1 else text.title() if self.r.random() < 0.5 else text.capitalize()

    def item(self, low: int, high: int) -> str:
        text = self.words(low, high)
        return text if self.r.random() < 0.5 else text.capitalize()

    def aside(self, most: int) -> str:
        """Prose beside the article; without a name to tell it, a short piece."""
        return self.prose(most) if self.named == "lists" else self.words(2, 9).capitalize() + self.r.choice([".", "", "!"])

    def prose(self, most: int = 6) -> str:
        return " ".join(self.words(3, 18).replace(" ", ", ", self.r.random() < 0.4).capitalize() + self.r.choice("...?!") for _ in range(self.r.randint(1, most)))

    def keep(self, text: str) -> str:
        self.content.add(text)
        return text

    def called(self, kind: str) -> str:
        return self.attr(BESIDE[kind]) if self.r.random() < 0.85 else ""

    def box(self, kind: str, inner: str, tags: list[str]) -> str:
        tag = "div" if self.divs and tags != ["ul"] else self.r.choice(tags)
        return f"<{tag}{self.called(kind) if tag in ('div', 'ul', 'section', 'p') or self.r.random() < 0.5 else ''}>{inner}</{tag}>"

    def links(self, most: int) -> str:
        items = [f'<a href="/{self.word()}">{self.label(1, 4)}</a>' for _ in range(self.r.randint(2, most))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.7 else " ".join(items)

    def menu(self) -> str:
        if self.r.random() < 0.1:  # without links
            return self.box("menu", self.r.choice([self.label, self.words])(1, 3), ["nav"] if self.named != "lists" else ["nav", "div"])
        if self.r.random() < 0.25:
            return self.box("menu", "".join(f"<li>{self.label(1, 2)}</li>" for _ in range(self.r.randint(1, 6))), ["ul"])
        return self.box("menu", self.links(8), ["nav", "nav", "div"])

    def head(self) -> str:
        inner = f"<h1>{self.label(1, 3)}</h1>" * (self.r.random() < 0.6) + f"<p>{self.aside(2)}</p>" * (self.r.random() < 0.5) + self.links(5) * (self.r.random() < 0.5)
        return self.box("head", inner or self.label(1, 3), ["header", "header", "div"])

    def foot(self) -> str:
        inner = self.r.choice([self.links(5), "", f"<p>{self.aside(2)}</p>"]) + self.r.choice(["<p>{}</p>", "{}"]).format(self.r.choice(RIGHTS) + self.r.choice(["", " " + self.aside(1)]))
        return self.box("foot", inner, ["footer", "footer", "div"])

    def side(self) -> str:
        inner = self.r.choice(["", f"<h3>{self.r.choice(MORES)}</h3>"]) + self.r.choice([self.links(6), f"<p>{self.aside(4)}</p>", f"<h4>{self.label(1, 4)}</h4><p>{self.aside(2)}</p>"])
        return self.box("side", inner, ["aside", "aside", "div"])

    def ad(self) -> str:
        inner = self.aside(2) if self.named == "lists" else self.r.choice(["Advertisement", "Sponsored", "Promoted"]) + self.r.choice(["", " " + self.words(1, 6)])
        return f'<{(t := self.r.choice(["div", "div", "p", "section"]))}{self.attr(BESIDE["ad"], ("class",))}>{self.r.choice([inner, f"<p>{inner}</p>"]) if t != "p" else inner}</{t}>'

    def notice(self) -> str:
        text = self.r.choice(NOTICES) if self.r.random() < 0.8 else self.aside(2)
        role = ' role="alert"' if self.r.random() < 0.2 else self.called("notice")
        text = text if self.r.random() < 0.3 else f"<p>{text}</p>"
        return f"<div{role}>{text}{'<button>OK</button>' * (self.r.random() < 0.5)}</div>"

    def comments(self) -> str:
        def one() -> str:
            return f"<p>{self.r.choice([self.words(1, 2), ''])} {self.prose(5) if self.named == "lists" else self.aside(1)}</p>" + "<a href='#'>Reply</a>" * (self.r.random() < 0.4)

        inner = self.r.choice(["", "<h3>Comments</h3>", f"<h2>{self.r.randint(2, 90)} comments</h2>"]) + "".join(f"<div{self.attr(['comment'], ('class',))}>{one()}</div>" if self.r.random() < 0.5 else one() for _ in range(self.r.choice([1, 2, 4, 12])))
        return f"<{(t := self.r.choice(['section', 'div', 'div', 'ol']))}{self.attr(BESIDE['comments'], ('class', 'id'))}>{inner}</{t}>"

    def form(self) -> str:
        return f"<form{self.called('form')}><p>{self.r.choice([self.aside(1), self.r.choice(NOTICES)])}</p><label>{self.words(1, 2)}</label><input><button>{self.words(1, 2)}</button></form>"

    def share(self) -> str:
        return f"<div{self.called('share')}>{self.r.choice(SHARES)} " + "".join(f"<a href='#'>{self.word()}</a> " for _ in range(self.r.randint(0, 4))) + "</div>"

    def part(self) -> str:
        """One part of an article."""
        kind = self.r.random()
        if kind < 0.62:
            name = self.r.choice(["", "", "", self.attr(["lead"], ("class",)), self.attr(["story-teaser"], ("class",)), self.attr(["intro"], ("class",))])
            text = self.prose() if self.r.random() < 0.97 else self.r.choice(NOTICES + RIGHTS + MORES)  # an article may speak of such things
            if self.divs and self.r.random() < 0.5:
                return f"<div{name}>{self.keep(text)}</div>"
            return f"<p{name}>{self.keep(text)}{self.r.choice(['</p>', '</p>', ''])}"
        if kind < 0.68:
            return f"<p>{self.keep(self.words(1, 4).capitalize() + self.r.choice(['.', '', ':']))}</p>"
        if kind < 0.78:
            return f"<h{(h := self.r.randint(2, 4))}>{self.keep(self.label(1, 6))}</h{h}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{self.keep(self.item(1, 9))}</li>" for _ in range(self.r.randint(1, 5))) + "</ul>"
        if kind < 0.90:
            return f"<blockquote><p>{self.keep(self.prose(3))}</p></blockquote>"
        if kind < 0.94:
            return f"<figure><img src='x'><figcaption>{self.keep(self.words(2, 9))}</figcaption></figure>"
        if kind < 0.97:
            return "<table>" + "".join(f"<tr><td>{self.keep(self.item(1, 3))}</td><td>{self.keep(self.item(1, 3))}</td></tr>" for _ in range(2)) + "</table>"
        return f"<pre>{self.keep(self.words(4, 20))}</pre>"

    def bare(self) -> str:
        """An article of text with line breaks: one block up to the next heading."""
        runs = []
        for _ in range(self.r.randint(1, 3)):
            text = [self.prose() for _ in range(self.r.randint(1, 4))]
            self.keep(" ".join(text))
            runs.append("<br><br>".join(text))
        return "".join(f"<h{(h := self.r.randint(1, 3))}>{self.keep(self.label(1, 6))}</h{h}>{run}" for run in runs)

    def article(self) -> str:
        if self.named != "lists" and self.r.random() < 0.2:
            return self.r.choice(["{}", "<div>{}</div>"]).format(self.bare())
        title = f"<h1>{self.keep(self.label(1, 9))}</h1>"
        title = self.r.choice([title, title, f"<header>{title}</header>" if not self.divs else title, f'<div{self.attr(["post-header"], ("class",))}>{title}</div>'])
        parts = [self.part() for _ in range(self.r.choice([1, 1, 2, 4, 8, 14]))]
        told = self.named == "lists"  # in pages without names nothing tells these from parts of the article
        for kind, chance in ((self.ad, 0.3), (self.share, 0.2), (self.form, 0.05), (self.side, 0.1 * told), (self.comments, 0.1 * told)):
            if self.r.random() < chance:
                parts.insert(self.r.randint(0, len(parts)), kind())
        inner = title * (self.r.random() < 0.9) + "".join(parts)
        odd = self.attr(CONTENT + WRAP, ("class",)) if self.r.random() < 0.4 else ""
        look = self.r.uniform(0.6, 1) if self.divs else self.r.random()
        if look < 0.45:
            return f"<article{odd}>{inner}</article>"
        if look < 0.6:
            return f"<main{odd}>{inner}</main>"
        if look < 0.88:
            return f'<div{self.attr(CONTENT, ("class", "id"))}>{inner}</div>'
        return f"<div>{inner}</div>" if look < 0.95 else inner

    def page(self) -> tuple[str, set[str]]:
        some = lambda f, chance: [f()] if self.r.random() < chance else []
        if self.r.random() < 0.1:  # nothing but the text
            return f"{self.r.choice(['<html><body>', ''])}{self.article()}", self.content
        before = [*some(self.notice, 0.3), *some(self.head, 0.6), *some(self.menu, 0.8), *some(self.ad, 0.4)]
        self.r.shuffle(before)
        middle = [self.article(), *some(self.comments, 0.4 * (self.named == "lists"))]
        middle[len(middle) * (self.r.random() < 0.5) : 0] = some(self.side, 0.5)
        if self.named != "lists" and self.r.random() < 0.3:  # a table lays the page out
            menu = self.r.choice([self.links(6), "<br>".join(f"<a href='/'>{self.label(1, 2)}</a>" for _ in range(self.r.randint(2, 6)))])
            cells = "".join(f"<td>{x}</td>" for x in [menu, *middle][:: self.r.choice([1, 1, -1])])
            rows = [f"<tr><td colspan='{1 + len(middle)}'>{x}</td></tr>" for x in ("".join(before) or self.label(1, 3), self.r.choice([self.foot(), self.r.choice(RIGHTS)]))]
            return f"<html><head><title>{self.words(1, 5)}</title></head><body><table>{rows[0]}<tr>{cells}</tr>{rows[1]}</table></body></html>", self.content
        inner = "".join(middle)
        for _ in range(self.r.randint(0, 3)):
            inner = f'<div{self.attr(WRAP, ("class",))}>{inner}</div>'
        after = [*some(self.side, 0.2), *some(self.form, 0.3), *some(self.ad, 0.2), *some(self.notice, 0.2), self.foot()]
        body = "".join(before) + inner + "".join(after)
        if self.r.random() < 0.12:
            body = f"<form action='x'>{body}</form>"
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{body}</body></html>", self.content


def pages(n: int = PAGES, seed: int = 1) -> list[tuple[str, set[str]]]:
    """(html, texts of the blocks that are content) of ``n`` pages."""
    return [Maker(seed * 1_000_003 + i).page() for i in range(n)]
