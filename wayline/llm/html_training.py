"""Labelled training pages: articles of invented words inside many usual page layouts."""

from __future__ import annotations

import html
import random

#: Pages that the extractor is trained on.
TRAINING_PAGES = 700

_ALPHABETS = ("etaoinshrdlucmfwyp", "enisratdhulcgmobwfkzäöüß", "esaitnrulodcmpéèvqfbàçê", "eaosrnidlctumpbgvyqhíóñá", "оеаинтсрвлкмдпуяы", "αειοντσρκλπμηυω")
_SAYINGS = {
    "notice": ["We use cookies to improve this site.", "This site uses cookies. Accept all", "Wir verwenden Cookies.", "Subscribe to our newsletter!", "Please sign in to continue.", "Accept", "OK"],
    "footer": ["© 2024 {w}", "Copyright {w}. All rights reserved.", "Alle Rechte vorbehalten", "Terms of use", "Impressum", "Tous droits réservés"],
    "ad": ["Advertisement", "Sponsored", "Buy now: {w}", "Anzeige", "50% off {w}"],
    "comment": ["Reply", "3 comments", "Leave a comment", "Antworten", "Posted by {w}"],
    "share": ["Share", "Tweet", "Follow us", "Teilen"],
    "aside": ["Related", "Most read", "See also", "Read more", "Trending"],
    "form": ["Search", "Log in", "Your name", "Email", "Send"],
}


_TELLING = "also more read cookies privacy rights terms subscribe email comment reply sponsored buy off share follow related".split()


class _Writer:
    """One page at a time; ``main`` gathers the texts of its article, ``junk`` adds symbols to its words."""

    junk = False

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.letters = self.r.choice(_ALPHABETS)
        self.vocabulary = ["".join(self.r.choices(self.letters, k=self.r.randint(1, 9))) for _ in range(300)]
        self.main: list[str] = []

    def words(self, low: int, high: int) -> str:
        n = round(low * (high / low) ** self.r.random())
        noise = lambda: self.r.choice("*#%$&=~^|§+") * self.r.randint(1, 4) if self.junk and self.r.random() < 0.4 else ""
        text = [w + ("," if self.r.random() < 0.06 else ". " if self.r.random() < 0.02 else "") + noise() for w in self.r.choices(self.vocabulary, k=n)]
        out = " ".join(text)
        return (out[0].upper() + out[1:] if self.r.random() < 0.85 else out) + self.r.choice([".", ".", ".", "", "!", "?"])

    def say(self, kind: str) -> str:
        return self.r.choice(_SAYINGS[kind]).format(w=self.words(1, 5)) if kind in _SAYINGS and self.r.random() < 0.45 else self.words(1, 40)

    def keep(self, text: str) -> str:
        """Writes ``text`` as a part of the article: escaped, with inline marks, some of them left open; telling words occur in articles too."""
        if text.count(" ") > 11 and self.r.random() < 0.2:
            text = text.replace(" ", f" {self.r.choice(_TELLING)} ", 1)
        self.main.append(" ".join(text.split()))
        out = html.escape(text, quote=False)
        if self.r.random() < 0.15:
            cut = out.split(" ")
            k = self.r.randrange(len(cut))
            cut[k] = self.r.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<i>{}", "<span>{}</span>", "<strong>{}", "<code>{}</code>"]).format(cut[k])
            out = " ".join(cut)
        return out

    def links(self, n: int) -> str:
        if (joint := self.r.choice(["li", "li", "li", " | ", "<br>", " "])) != "li":
            return joint.join(f'<a href="/{i}">{html.escape(self.words(1, 4))}</a>' for i in range(n))
        return "".join(f'<li><a href="/{i}">{html.escape(self.words(1, 4))}</a></li>' for i in range(n))

    def boilerplate(self, kind: str) -> str:
        r = self.r
        wrap = {
            "nav": ["<nav>{}</nav>", '<div class="menu">{}</div>', '<ul id="nav">{}</ul>', '<div class="breadcrumb">{}</div>', '<div role="navigation">{}</div>', "<div>{}</div>", "<table><tr><td><font size=1>{}</font></td></tr></table>"],
            "header": ["<header>{}</header>", '<div id="header">{}</div>', '<div class="masthead">{}</div>', '<div class="site-header">{}</div>'],
            "footer": ["<center>{}</center>", "<footer>{}</footer>", "<footer>{}</footer>", '<div id="footer">{}</div>', '<div class="footer">{}</div>', '<div class="copyright">{}</div>'],
            "aside": ["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="sidebar-right">{}</div>', '<div class="widget">{}</div>', '<section class="related">{}</section>'],
            "ad": ['<div class="ad">{}</div>', '<div id="ads">{}</div>', '<div class="advertisement">{}</div>', '<aside class="sponsored">{}</aside>', '<p class="advert">{}</p>', '<div class="ad-banner">{}</div>'],
            "comment": ['<section class="comments">{}</section>', '<div id="comments">{}</div>', '<ol class="commentlist">{}</ol>', '<div id="disqus_thread">{}</div>', '<section id="comments">{}</section>'],
            "notice": ['<div class="cookie-notice">{}</div>', '<div id="cookie-banner">{}</div>', '<div class="notice">{}</div>', '<div class="newsletter">{}</div>', '<div role="alert">{}</div>', '<div class="popup">{}</div>', '<dialog open>{}</dialog>'],
            "form": ["<form>{}</form>", '<form class="search" action="/s">{}</form>', '<div class="login"><form>{}</form></div>'],
            "share": ['<div class="share">{}</div>', '<ul class="social">{}</ul>'],
        }[kind]
        texts = [html.escape(self.say(kind)) for _ in range(r.choice([1, 1, 2, 4]))]
        if kind in ("nav", "header", "footer", "share") and r.random() < 0.6:
            inside = r.choice(["<ul>{}</ul>", "<ul>{}</ul>", "{}"]).format(self.links(r.randint(2, 8)))
        elif kind == "form":
            inside = "".join(f"<label>{t}</label><input name=q>" for t in texts) + r.choice(["<button>Go</button>", "<p>" + html.escape(self.words(3, 20)) + "</p>", "<textarea>x</textarea>"])
        elif kind == "comment":
            one = r.choice(["<article class=\"comment\"><p>{}</p></article>", "<li><p>{}</p></li>", '<div class="comment"><b>x</b><p>{}</p></div>', "<p>{}</p>"])
            inside = r.choice(["<h2>Comments</h2>", "<h3>3 comments</h3>", "<h3>4 replies</h3>", "<h4>Kommentare</h4>", ""]) + "".join(one.format(html.escape(self.words(2, 80))) for _ in range(r.randint(1, 6)))
        else:
            inside = "".join(r.choice(["{}", "<p>{}</p>", "<div>{}</div>", "<h4>{}</h4>"]).format(t) for t in texts)
        return r.choice(wrap).format(inside)

    def article(self) -> str:
        r = self.r
        self.junk = r.random() < 0.12
        parts = []
        if r.random() < 0.9:
            parts.append(r.choice(["<h1>{}</h1>"] * 4 + ["<h2>{}</h2>"]).format(self.keep(self.words(1, 12))))
        for _ in range(r.choice([1, 2, 3, 5, 8, 13, 20])):
            style = r.random()
            if style < 0.68:
                parts.append(r.choice(["<p>", "<p>", "<p>", '<p class="x1">']) + self.keep(self.words(1, 160)) + r.choice(["</p>", "</p>", "</p>", "", "<br>"]))
            elif style < 0.74:  # an inline element is left open, or the paragraph is a division
                parts.append(r.choice(["<p><{0}>{1}", "<div><{0}>{1}</div>", "<p><{0}>{1}</p>", "<div>{1}</div>", "<section><p>{1}</p></section>"]).format(r.choice(["strong", "b", "i", "font", "u", "small"]), self.keep(self.words(1, 60))))
            elif style < 0.78:
                parts.append(r.choice(["<pre>{}</pre>", "<dl><dt>{}</dl>", "<details open><summary>{}</summary></details>", "<h4>{}</h4>"]).format(self.keep(self.words(2, 40))))
            elif style < 0.84:
                parts.append("<h2>" + self.keep(self.words(1, 8)) + "</h2>")
            elif style < 0.9:
                parts.append(r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join("<li>" + self.keep(self.words(1, 20)) + r.choice(["</li>", ""]) for _ in range(r.randint(1, 6)))))
            elif style < 0.94:
                parts.append("<blockquote>" + self.keep(self.words(3, 50)) + "</blockquote>")
            elif style < 0.97:
                parts.append("<table>" + "".join("<tr>" + "".join("<td>" + self.keep(self.words(1, 4)) + "</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                parts.append("<figure><img src=x><figcaption>" + self.keep(self.words(2, 20)) + "</figcaption></figure>")
            if r.random() < 0.07:
                parts.append(self.boilerplate(r.choice(["ad", "ad", "share", "aside", "notice", "form"])))
        if r.random() < 0.12:
            parts.append(self.boilerplate(r.choice(["share", "comment", "nav"])))
        wrap = r.choice(["<article>{}</article>"] * 6 + ["<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main"><div class="post">{}</div></div>', '<div class="article-body">{}</div>', '<div class="entry-content">{}</div>', '<article class="post"><header>{}</article>', "<div>{}</div>", "<div><div>{}</div></div>", "<table><tr><td>{}</td></tr></table>", '<div class="css-1x9k2"><div class="sc-a">{}</div></div>', '<div itemprop="articleBody">{}</div>', '<section class="page">{}</section>', "{}"])
        self.junk = False
        return wrap.replace("{}", "".join(parts), 1)

    def wrapped(self, body: str) -> str:
        """``body`` inside an element whose names tell of the page's state, or of more than one thing."""
        r = self.r
        odd = r.choice("nav sidebar ad ads comments cookie notice menu search promo widget header footer share related recent newsletter dialog".split())
        name = r.choice(["has-{}", "with-{}", "no-{}", "{}-open", "{}-enabled", "sticky-{}", "{}-fixed", "layout has-{}", "page-template {}-active", "{}-content", "{}-page", "{}-post single", "{}-results"]).format(odd)
        return r.choice(['<div class="{}">', '<div id="app" class="{}">', '<section class="{}">', '<div class="x {} y"><div>']).format(name) + body + "</div>"

    def head(self) -> str:
        r = self.r
        some = ['<meta name="viewport" content="width=device-width">', '<link rel="stylesheet" href="/a.css">', "<script src='/x.js' async></script>", '<script>window.q=[];if(1<2&&a>b){q.push("<div>x</div>")}</script>', '<script type="application/ld+json">{"@type":"Article","headline":"<h1>"}</script>', "<style>.a > .b::after{content:'<nav>'}</style>", "<!-- <body> old -->", '<base href="/">']
        lines = [f"<title>{html.escape(self.words(1, 9))}</title>", *r.sample(some, r.randint(0, 4))]
        r.shuffle(lines)
        start = r.choice(["<!DOCTYPE html>\n<html>", "<html lang=en>", "<!doctype html>", '<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml">'])
        return start + "<head>" + r.choice(["", "\n"]).join(lines) + r.choice(["</head><body>", "</head>\n<body class='home'>", "<body>", "</head><body class='single has-sidebar comments-open header-fixed'>"])

    def page(self) -> tuple[str, str]:
        r = self.r
        few = lambda kinds, chance: "".join(self.boilerplate(k) for k in kinds if r.random() < chance)
        before = few(["notice", "ad"], 0.2) + few(["header"], 0.4) + few(["nav"], 0.7) + few(["form", "aside", "notice"], 0.2) + few(["ad"], 0.4)
        article = self.article()
        inner = r.random()
        article = self.wrapped(article) if inner < 0.15 else article
        if r.random() < 0.04:  # remarks of readers that only their heading gives away
            article += "<div>" + r.choice(["<h3>4 replies</h3>", "<h3>2 comments</h3>", "<p>Comments (5)</p>", "<h4>3 Kommentare</h4>"]) + "".join(f"<div><p>{html.escape(self.words(3, 30))}</p></div>" for _ in range(r.randint(1, 4))) + "</div>"
        body = before + article + few(["share", "ad"], 0.25) + few(["comment"], 0.35) + few(["aside", "nav", "form", "notice"], 0.25) + few(["footer"], 0.8)
        body = self.wrapped(body) if inner > 0.92 else body
        return self.head() + body + r.choice(["</body></html>", "</body></html>", ""]), "\n\n".join(self.main)


def training_pages(n: int = TRAINING_PAGES, seed: int = 11) -> list[tuple[str, str]]:
    """``n`` pairs (html, main text), the same for the same arguments."""
    return [_Writer(seed * 1_000_003 + i).page() for i in range(n)]
