"""Made-up pages for the block labeller of ``html_extract``, and its training: ``python -m moiety.llm.html_training`` writes the weights.

A page is an article in a container of some kind among menus, headers, footers, sidebars, notices, adverts, forms and
comments.  On three pages of five classes, ids and element names tell what is what; on the others they are taken away or
replaced by meaningless ones, and many elements become plain div: there only links, words, lengths, order and neighbours tell.
Text is of made-up syllables or of common words, in the article and around it alike."""

from __future__ import annotations

import random
import re

import numpy as np

from moiety.llm.html_extract import HIDDEN, INPUT, WEIGHTS, Labeller, block_vectors, blocks  # noqa: F401

MAIN = ["<article>", '<article class="post">', "<main>", '<div class="content">', '<div id="main-content">', '<div class="article-body">',
    '<div class="entry-content">', '<section class="post-body">', '<div class="story">', '<div itemprop="articleBody">',
    '<div class="text">', "<main><article>", '<div id="main"><article class="entry">', '<main role="main"><div class="post">',
    "<article><section>"]
ASIDE = {
    "menu": ["<nav>", '<div class="menu">', '<ul class="nav">', '<div id="navigation">', '<div class="navbar">', '<nav class="breadcrumb">',
        '<div class="breadcrumbs">', '<nav role="navigation">', '<div class="pagination">', '<ul class="menu">', '<div class="toc">'],
    "header": ["<header>", '<div id="header">', '<div class="masthead">', '<div class="site-header">', '<div class="topbar">',
        '<header class="banner">', '<div id="branding">'],
    "footer": ["<footer>", '<div id="footer">', '<div class="site-footer">', '<footer class="bottom">', '<div class="copyright">', '<div class="legal">'],
    "sidebar": ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="related">', '<aside class="widget">',
        '<div class="recommended">', '<div class="rail">', '<section class="related-posts">', '<div class="share">',
        '<div class="social">'],
    "notice": ['<div class="cookie-notice">', '<div class="notice">', '<div id="gdpr">', '<div class="consent">', '<div class="alert">',
        '<div role="alert">', '<div class="cookies banner">', '<div class="modal">', '<div class="popup">', '<p class="notice">',
        '<div class="paywall">', '<div role="dialog">'],
    "advert": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">',
        '<div class="promo">', '<aside class="ad">', '<p class="ad">', '<div id="ad-top">', '<section class="promotion">',
        '<ins class="adsbygoogle"><div>', '<div class="banner-ad">'],
    "form": ["<form>", '<form class="search">', '<div class="newsletter"><form>', '<form id="subscribe">', '<form class="login">',
        '<div class="signup">', "<form><fieldset>", '<div class="contact-form"><form>'],
    "comments": ['<div class="comments">', '<div id="comments">', '<section class="comments">', '<ol class="comment-list">',
        '<div class="comment">', '<ul class="replies">', '<section id="discussion">', '<div class="responses">',
        '<div class="user-comments">', '<div class="disqus thread">', '<aside class="comments">', '<div id="respond">'],
}
SAYING = {
    "menu": "home about contact news menu archive products services blog shop help search world sport business",
    "header": "welcome site log in sign up daily official account",
    "footer": "copyright all rights reserved privacy policy terms of use imprint sitemap company powered by",
    "sidebar": "related read more popular share follow latest posts recent tags see also trending",
    "notice": "we use cookies accept consent privacy this site uses agree preferences by continuing you settings",
    "advert": "buy now sale offer sponsored advertisement click here off free shipping today only best price deal",
    "form": "email address subscribe search submit your name password send newsletter message log in sign up",
    "comments": "reply says said comment posted ago likes great post thanks i agree report writes on at",
}
COMMON = "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know years under last food life between city old country school story night children world house river early light against often music paper small white".split()
DATES = ["12 May 2021", "3 hours ago", "2 days ago", "June 4, 2019 at 10:22", "2020-01-17", "yesterday", "Posted on March 2, 2018"]
MARK = "\x01"


def _close(opened: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z0-9]+)", opened)))


def _untold(page: str, r: random.Random) -> str:
    """The page without telling names: attributes gone or meaningless, some or all structural elements plain div."""
    names: dict = {}
    hashed, keep = r.random() < 0.5, r.random()

    def attribute(m):
        if not hashed:
            return ""
        if m[0] not in names:
            names[m[0]] = r.choice([' class="%s"', ' class="css-%s"', ' id="%s"',
                ' class="%s box"']) % "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(3, 8)))
        return names[m[0]]

    page = re.sub(r' (?:class|id|role|itemprop)="[^"]*"', attribute, page)
    gone = {t for t in ("article", "main", "nav", "header", "footer", "aside", "section", "form", "fieldset") if r.random() > keep}
    return re.sub(r"<(/?)([a-z]+)(?=[ >])", lambda m: f"<{m[1]}{'div' if m[2] in gone else m[2]}", page)


def made_up(r: random.Random) -> str:
    """A page; blocks of its main text carry MARK."""
    told = r.random() < 0.6
    syllables = [r.choice("bcdfghklmnprstvwz") + r.choice(["a", "e", "i", "o", "u", "ä", "é", "ou", "th", "ie", "an"]) for _ in range(40)]
    real = r.random()
    figures = r.choice([0.0, 0.0, 0.03, 0.1])

    def word():
        if r.random() < figures:
            return r.choice([str(r.randrange(10 ** r.randint(1, 16))), ".".join(str(r.randrange(256)) for _ in range(4)),
                f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}",
                f"{r.choice(syllables)}{r.randrange(99)}@{r.choice(syllables)}.org"])
        return r.choice(COMMON) if r.random() < real else "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def sentence(n, mark=""):
        odd = r.random()
        if odd < 0.04:
            return mark + " ".join([word()] * n)
        if odd < 0.08:
            return mark + " ".join(word().upper() + "!!" for _ in range(n))
        if odd < 0.12:
            return mark + " ".join(word() + r.choice(["&amp;&amp;", "***", "###", " |"]) for _ in range(n))
        return mark + " ".join(w + r.choice(["", "", "", ",", "&amp;"]) if k % 7 == 3 else w for k,
            w in enumerate(word() for _ in range(n))).capitalize() + r.choice([".", ".", ".", "!", "?", ""])

    def saying(kind, n):
        words = SAYING[kind].split()
        a = r.randrange(len(words))
        out = words[a:a + n] if r.random() < 0.5 else []
        out += [r.choice(words) if r.random() < 0.4 else word() for _ in range(n - len(out))]
        return " ".join(out).capitalize() + r.choice(["", "."])

    def comments(opened):
        out = [opened] + ([f"<{(t := r.choice(['h2', 'h3', 'h4', 'p']))}>{r.choice(['Comments', 'Comments (%d)' % r.randint(1, 99), '%d comments' % r.randint(1, 99), 'Leave a reply', 'Responses', 'Discussion', 'What readers say'])}</{t}>"] if r.random() < 0.7 else [])
        for _ in range(r.choice([1, 1, 2, 3, 6])):
            name = word().capitalize()
            head = r.choice([f"<b>{name}</b> {r.choice(DATES)}", f"<span>{name}</span> says:", f"{name} wrote:",
                f"<a href='/u'>{name}</a> <time>{r.choice(DATES)}</time>", ""])
            text = sentence(r.choice([2, 8, 20, 60])) if r.random() < 0.6 else saying("comments", r.choice([2, 5, 12]))
            outer, inner = r.choice(["<li>", "<div>", '<div class="comment">', "<p>", ""]), r.choice(["<p>", "<p>", "<div>", ""])
            out.append(outer + (f"<div>{head}</div>" if r.random() < 0.6 else head + " ") + inner + text + _close(inner) + ("<a href='#r'>Reply</a>" if r.random() < 0.3 else "") + _close(outer))
        return "".join(out) + _close(opened)

    def aside(kind):
        opened = r.choice(ASIDE[kind])
        if not told and opened.startswith("<p"):
            opened = "<div>"  # without its class nothing would tell it from a paragraph
        if kind == "comments" and r.random() < 0.7:
            return comments(opened)
        items = []
        for _ in range(r.choice([1, 1, 2, 3, 6]) if kind != "menu" else r.randint(2, 8)):
            text = saying(kind, r.choice([1, 2, 4, 9, 25]) if kind in ("menu",
                "form") else r.choice([2, 6, 12, 40])) if r.random() < 0.6 else sentence(r.choice([2, 8, 20,
                60]) if kind != "menu" else r.choice([1, 1, 2, 4]))
            if kind == "menu" or kind == "sidebar" and r.random() < 0.6 or kind == "footer" and r.random() < 0.4:
                text = f'<a href="/{word()}">{text}</a>'
            form = {"menu": ["<li>", "", "<li>"], "form": ["<label>", "<p>", "", "<button>", "<div>"]}.get(kind,
                ["<p>", "<p>", "", "<div>", "<li>", "<h3>", "<h4>"])
            tag = r.choice(form)
            items.append(tag + text + _close(tag))
        if kind == "menu" and r.random() < 0.7 and not opened.startswith("<ul"):
            items = ["<ul>", *items, "</ul>"]
        if kind == "footer" and r.random() < 0.6:
            items.insert(0, r.choice(["&copy; ", "© ", "&copy; 2020 ", "Copyright © 2019 "]) + saying(kind, 4) + r.choice([" &middot; ", ". ", ""]))
        return opened + "".join(items) + _close(opened)

    def prose():
        kind = r.random()
        text = sentence(r.choice([1, 4, 10, 25, 60, 120]), MARK)
        if kind < 0.65:
            if r.random() < 0.2:
                text = r.choice(["<b>", "<i>", "<strong>", '<a href="/x">', "<em>"]) + text
                text += "<br>" if r.random() < 0.6 else ""
            return "<p>" + text + ("</p>" if r.random() < 0.85 else "")
        if kind < 0.75:
            return f"<h2>{text}</h2>"
        if kind < 0.83:
            return "<ul>" + "".join(f"<li>{sentence(r.randint(1, 12), MARK)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.92:
            return "<table><tr>" + "".join(f"<td>{sentence(3, MARK)}</td>" for _ in range(3)) + "</tr></table>"
        if kind < 0.95:
            return f"<pre>{text}</pre>"
        return f"<div>{text}</div>" if kind < 0.98 else text

    opened = r.choice(MAIN) if r.random() < 0.75 else "<article>"
    inner = [f"<h1>{sentence(r.randint(2, 12), MARK)}</h1>"] if r.random() < 0.8 else []
    inner += [prose() for _ in range(r.choice([0, 1, 2, 4, 8, 20, 40]))] or [f"<p>{sentence(20, MARK)}</p>"]
    for kind in ("advert", "sidebar", "form", "comments", "notice"):
        if r.random() < (0.15 if told else 0.08):
            inner.insert(r.randint(1, len(inner)) if kind != "comments" else len(inner), aside(kind))
    main = opened + "".join(inner) + _close(opened)
    before = [aside(k) for k in ("header", "menu", "notice", "advert", "form") if r.random() < 0.5]
    after = [aside(k) for k in ("comments", "sidebar", "advert", "form", "notice", "menu", "footer") if r.random() < 0.45]
    if r.random() < 0.15:
        before.append(aside("sidebar"))
    r.shuffle(before)
    wrap = r.choice(["", "", '<div class="page">', '<div id="wrapper"><div class="container">', '<div class="layout row">'])
    body = f"{wrap}{''.join(before)}<!-- x -->{main}{''.join(after)}{_close(wrap)}"
    return f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{body if told else _untold(body, r)}" + r.choice(["", "</body></html>"])


def examples(pages: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Block vectors and labels of made-up pages."""
    r, tags, paths, xs, ys = random.Random(seed), {}, {}, [], []
    for _ in range(pages):
        found = blocks(made_up(r), tags)
        ys.append(np.array([MARK in t for _, t, _ in found], np.float32))
        xs.append(block_vectors([(p, t.replace(MARK, "").strip() or ".", k) for p, t, k in found], paths))
    return xs, ys


def train(pages: int = 6000, rounds: int = 1600, batch: int = 64, seed: int = 3, rate: float = 0.01) -> Labeller:
    """A labeller fitted to made-up pages by Adam; the same for the same arguments."""
    xs, ys = examples(pages, seed)
    r, own = random.Random(seed + 1), Labeller()
    order = sorted(range(pages), key=lambda k: len(xs[k]))
    m, v = ({k: np.zeros_like(w) for k, w in own.p.items()} for _ in range(2))
    lots = [order[i:i + batch] for i in range(0, pages, batch)]
    for step in range(1, rounds + 1):
        some = r.choice(lots)
        steps = max(len(xs[k]) for k in some)
        x, mask, y = np.zeros((steps, len(some), INPUT), np.float32), np.zeros((steps, len(some)), bool), np.zeros((steps, len(some)), np.float32)
        for j, k in enumerate(some):
            x[:len(xs[k]), j], mask[:len(xs[k]), j], y[:len(xs[k]), j] = xs[k], True, ys[k]
        g = own.gradients(x, mask, y)
        size = np.sqrt(sum(float((w ** 2).sum()) for w in g.values()))
        lr = rate * min(1.0, 2 * (1 - step / (rounds + 1))) * min(1.0, 1 / max(size, 1e-9))
        for k in own.p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            own.p[k] = (own.p[k] - lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return own


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{k: w.astype(np.float16) for k, w in train().p.items()})
