"""Pages of many layouts, written from given paragraphs, whose main text is known.

They are what the node classifier is fitted on: real tables do not say which node is the article.
In each page the nodes that hold the article carry `data-main="1"`, those inside it that are not
part of it `data-main="0"`; the reader of features does not look at that attribute.
"""

from __future__ import annotations

import html
import random

# Names that pages commonly give to their parts.
MAIN = "article content post entry story article-body post-content entry-content main-content blog-post article__body story-text page-content text-body".split()
ADS = "ad ads advert ad-slot advertisement sponsored promo banner-ad adsbygoogle sponsor-box".split()
MENUS = "nav menu navbar main-nav top-menu breadcrumbs pagination site-navigation toc".split()
COMMENTS = "comments comment-list reader-comments discussion responses replies disqus_thread".split()
SIDES = "sidebar widget related related-posts right-rail recommended popular trending more-stories".split()
NOTICES = "cookie-notice cookie-banner notice consent alert gdpr popup modal-overlay warning-message privacy-notice".split()
FOOTERS = "footer site-footer copyright legal bottom credits".split()
HEADERS = "header site-header masthead topbar logo branding".split()
FORMS = "form search-form newsletter signup login-form subscribe contact-form poll".split()
SHARES = "share social share-buttons tags meta byline author-box".split()
NEUTRAL = "wrap row col c1 inner box container x7 grid block s-12".split()


class Writer:
    def __init__(self, paragraphs: list[str], draw: random.Random):
        self.paragraphs, self.draw = paragraphs, draw

    def text(self, most: int | None = None) -> str:
        words = self.draw.choice(self.paragraphs).split()
        if most:
            at = self.draw.randrange(max(1, len(words) - most + 1))
            words = words[at : at + self.draw.randint(1, most)]
        return html.escape(" ".join(words) or "x", quote=False)

    def named(self, names: list[str]) -> str:
        name = self.draw.choice(names)
        form = self.draw.randrange(5)
        if form == 0:
            return f' id="{name}"'
        if form == 1:
            return f' class="{self.draw.choice(NEUTRAL)} {name}"'
        if form == 2:
            return f' class="{name}" data-x="1"'
        return f' class="{name}"' if form == 3 else f" class='{name} {self.draw.choice(NEUTRAL)}'"

    def link(self) -> str:
        return f'<a href="/{self.draw.randrange(999)}">{self.text(4)}</a>'

    def links(self) -> str:
        n = self.draw.randint(2, 9)
        if self.draw.random() < 0.7:
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"
        return self.draw.choice([" | ", " ", " &middot; "]).join(self.link() for _ in range(n))

    def prose(self, n: int) -> str:
        return "".join(f"<p>{self.text()}</p>" for _ in range(n))

    def aside(self, kind: str) -> str:
        """A part of a page that is not its main text."""
        d = self.draw
        if kind == "menu":
            return d.choice([f"<nav>{self.links()}</nav>", f"<div{self.named(MENUS)}>{self.links()}</div>", f'<div role="navigation">{self.links()}</div>', f"<ul{self.named(MENUS)}>" + "".join(f"<li>{self.link()}</li>" for _ in range(5)) + "</ul>"])
        if kind == "header":
            inside = f"<div>{self.text(4)}</div>" + (self.aside("menu") if d.random() < 0.4 else f"<p>{self.text(12)}</p>")
            return d.choice([f"<header>{inside}</header>", f"<div{self.named(HEADERS)}>{inside}</div>"])
        if kind == "footer":
            inside = d.choice([f"&copy; {self.text(6)}", f"<p>&copy; {self.text(8)}</p>{self.links()}", f"<p>{self.text()}</p>"])
            return d.choice([f"<footer>{inside}</footer>", f"<div{self.named(FOOTERS)}>{inside}</div>"])
        if kind == "side":
            inside = "".join(d.choice([f"<h3>{self.text(5)}</h3>", self.links(), self.prose(1), f"<p>{self.text(15)}</p>"]) for _ in range(d.randint(1, 3)))
            return d.choice([f"<aside>{inside}</aside>", f"<div{self.named(SIDES)}>{inside}</div>", f"<section{self.named(SIDES)}>{inside}</section>"])
        if kind == "notice":
            inside = d.choice([self.text(25), f"<p>{self.text()}</p><button>{self.text(2)}</button>", f"<p>{self.text(20)}</p>"])
            return d.choice([f"<div{self.named(NOTICES)}>{inside}</div>", f'<div role="{d.choice(["alert", "dialog", "alertdialog"])}">{inside}</div>', f"<section{self.named(NOTICES)}>{inside}</section>", f"<p{self.named(NOTICES)}>{self.text(30)}</p>"])
        if kind == "ad":
            inside = d.choice([self.text(20), f"<p>{self.text(30)}</p>", f"<a href='/x'>{self.text(8)}</a>", self.prose(1)])
            return d.choice([f"<div{self.named(ADS)}>{inside}</div>", f"<aside{self.named(ADS)}>{inside}</aside>", f"<section{self.named(ADS)}>{inside}</section>"])
        if kind == "form":
            inside = f"<label>{self.text(3)}</label><input name=q>" + d.choice(["", f"<p>{self.text(15)}</p>"]) + f"<button>{self.text(2)}</button>"
            return d.choice([f"<form>{inside}</form>", f"<div{self.named(FORMS)}><form action='/s'>{inside}</form></div>", f"<form{self.named(FORMS)}>{inside}</form>"])
        if kind == "share":
            return f"<div{self.named(SHARES)}>{d.choice([self.links(), self.text(6)])}</div>"
        one = lambda: d.choice([f'<div class="comment"><b>{self.text(2)}</b><p>{self.text()}</p></div>', f"<li><p>{self.text()}</p></li>", f'<article class="comment"><p>{self.text()}</p></article>', f"<div><span class=author>{self.text(2)}</span><p>{self.text(40)}</p></div>", f"<p>{self.text()}</p>"])
        inside = d.choice(["", f"<h2>{self.text(3)}</h2>"]) + "".join(one() for _ in range(d.randint(1, 6)))
        return d.choice([f"<section{self.named(COMMENTS)}>{inside}</section>", f"<div{self.named(COMMENTS)}>{inside}</div>", f"<ol{self.named(COMMENTS)}>{inside}</ol>", f"<aside{self.named(COMMENTS)}>{inside}</aside>"])

    def body(self) -> str:
        """The main text's blocks, with intruders among them."""
        d = self.draw
        out = [] if d.random() < 0.1 else [f"<h1>{self.text(10)}</h1>"]
        for _ in range(d.choice([1, 2, 3, 5, 8, 14])):
            kind = d.random()
            if kind < 0.62:
                out.append(f"<p>{self.text() if d.random() < 0.8 else self.text(6)}</p>")
            elif kind < 0.7:
                out.append(f"<p><b>{self.text(6)}<br><p>{self.text()}</p>")
            elif kind < 0.76:
                out.append(f"<h2>{self.text(6)}</h2>")
            elif kind < 0.81:
                out.append(f"<ul>{''.join(f'<li>{self.text(25)}</li>' for _ in range(d.randint(2, 5)))}</ul>")
            elif kind < 0.85:
                out.append(f"<blockquote>{d.choice([self.text(), f'<p>{self.text()}</p>'])}</blockquote>")
            elif kind < 0.88:
                out.append(f"<p>{self.text(20)} {self.link()} {self.text(20)}</p>")
            elif kind < 0.9:
                out.append(f"<pre>{self.text(30)}</pre>")
            elif kind < 0.92:
                out.append("<table>" + "".join(f"<tr><td>{self.text(5)}</td><td>{self.text(5)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.94:
                out.append(f"<figure><img src=x><figcaption>{self.text(12)}</figcaption></figure>")
            elif kind < 0.96:
                out.append(f"<div>{self.text(40)}</div>")
            else:
                out.append(self.aside(d.choice(["ad", "ad", "side", "share", "form", "notice", "menu"])).replace(">", ' data-main="0">', 1))
        if d.random() < 0.2:
            out.append(self.aside("comment").replace(">", ' data-main="0">', 1))
        if d.random() < 0.15:
            out = [f"<div{self.named(NEUTRAL)}>{''.join(out)}</div>"]
        return "".join(out)

    def main(self) -> str:
        d, inside = self.draw, self.body()
        mark = ' data-main="1"'
        form = d.randrange(7)
        if form in (0, 1):
            return f"<article{mark}{d.choice(['', self.named(MAIN)])}>{inside}</article>"
        if form == 2:
            return f"<main{mark}>{inside}</main>"
        if form == 3:
            return f'<main><div class="{d.choice(NEUTRAL)}"><article{mark}>{inside}</article></div></main>'
        if form == 4:
            return f"<section{mark}{self.named(MAIN)}>{inside}</section>"
        return f"<div{mark}{self.named(MAIN) if d.random() < 0.75 else d.choice(['', self.named(NEUTRAL)])}>{inside}</div>"

    def page(self) -> str:
        d = self.draw
        before = [self.aside(k) for k in ("notice", "header", "menu", "menu", "ad", "form") if d.random() < 0.45]
        after = [self.aside(k) for k in ("share", "ad", "side", "comment", "form", "side", "footer", "notice") if d.random() < 0.45]
        if d.random() < 0.12:  # the article stands in the body itself
            keep = lambda parts: "".join(p.replace(">", ' data-main="0">', 1) for p in parts)
            return f'<html><body data-main="1">{keep(before)}{self.body()}{keep(after)}</body></html>'
        main = self.main()
        if d.random() < 0.35:
            at = d.randrange(len(after) + 1)
            main, after = f"<div{self.named(NEUTRAL)}>{main}{''.join(after[:at])}</div>", after[at:]
        return f"<html><head><title>{self.text(6)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"
