"""Labelled pages that train the HTML model: every block element carries its
label in a data-label attribute ("1" belongs to the article, "0" does not).
The pages vary what sites vary: the element and the class of each part, what
there is of it, its place, and the length of its texts."""

from __future__ import annotations

import random

#: Names that sites give to each part, as elements with a class or an id.
PARTS = {
    "header": ("header", "div id=header", "div class=site-header", "div class=masthead", "div class=top-bar", "header class=page-header"),
    "menu": ("nav", "div class=menu", "div class=navbar", "div id=nav", "ul class=nav", "nav class=breadcrumb", "div class=breadcrumbs", "div role=navigation"),
    "notice": ("div class=cookie-notice", "div class=notice", "div class=alert role=alert", "div class=banner", "p class=notice", "section class=consent", "div id=cookie-banner", "div class=popup", "aside class=notice"),
    "advert": ("div class=ad", "div class=advert", "div class=ads", "aside class=ad", "div class=sponsored", "section class=promo", "div id=advertisement", "p class=ad", "div class=ad-box"),
    "sidebar": ("aside", "div class=sidebar", "div id=sidebar", "aside class=widget", "section class=related", "div class=related-posts", "div class=widget-area", "div class=share", "div class=newsletter", "div class=social"),
    "form": ("form", "form class=search", "form class=login", "form id=subscribe", "div class=form"),
    "comments": ("section class=comments", "div id=comments", "ol class=commentlist", "div class=comment-list", "div class=responses", "section id=discussion", "ul class=comments"),
    "footer": ("footer", "div id=footer", "div class=footer", "footer class=site-footer", "div class=copyright", "div class=bottom", "p class=copyright"),
    "article": ("article", "main", "div class=content", "div id=content", "div class=post", "div class=entry-content", "section class=article-body", "div class=story", "div class=text", "article class=post", "div class=article", "div id=main", "main id=main-content", "div class=page-body"),
}


def _element(name: str, label: int, inner: str) -> str:
    tag, *attributes = name.split(" ")
    text = "".join(f' {a.split("=")[0]}="{a.split("=")[1]}"' for a in attributes)
    return f'<{tag}{text} data-label="{label}">{inner}</{tag}>'


def _words(r: random.Random, low: int, high: int) -> str:
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(1, 9))) for _ in range(r.randint(low, high)))


def _sentences(r: random.Random, most: int) -> str:
    return " ".join(_words(r, 1, 18).capitalize() + r.choice(".....!?") for _ in range(r.randint(1, most)))


def _text(r: random.Random) -> str:
    """The text of a paragraph, of any part: some are a word, some are long."""
    return r.choice((lambda: _words(r, 1, 3), lambda: _sentences(r, 1), lambda: _sentences(r, 2), lambda: _sentences(r, 8)))()


def _links(r: random.Random, label: int, low: int = 2) -> str:
    items = [f'<li data-label="{label}"><a href="/x">{_words(r, 1, 4)}</a></li>' for _ in range(r.randint(low, 8))]
    return f'<ul data-label="{label}">{"".join(items)}</ul>'


def _body(r: random.Random, label: int) -> str:
    """Paragraphs and other blocks of running text."""
    out = []
    for _ in range(r.choice((1, 1, 2, 3, 5, 8, 12, 20, 40, 80) if label else (1, 1, 2, 3, 5))):
        kind = r.random()
        if kind < 0.72:
            text = _text(r)
            if r.random() < 0.15:
                text += f' <a href="/y">{_words(r, 1, 3)}</a> {_words(r, 1, 6)}.'
            if r.random() < 0.1:
                text = f"<b>{text}<br>"
            out.append(f'<p data-label="{label}">{text}</p>')
        elif kind < 0.8:
            out.append(f'<h{(h := r.randint(2, 4))} data-label="{label}">{_words(r, 1, 8)}</h{h}>')
        elif kind < 0.86:
            items = "".join(f'<li data-label="{label}">{_text(r)}</li>' for _ in range(r.randint(2, 5)))
            out.append(f'<{(t := r.choice(["ul", "ol"]))} data-label="{label}">{items}</{t}>')
        elif kind < 0.9:
            out.append(f'<blockquote data-label="{label}"><p data-label="{label}">{_text(r)}</p></blockquote>')
        elif kind < 0.93:
            rows = "".join(f'<tr data-label="{label}"><td data-label="{label}">{_words(r, 1, 4)}</td><td data-label="{label}">{_words(r, 1, 4)}</td></tr>' for _ in range(3))
            out.append(f'<table data-label="{label}"><tbody data-label="{label}">{rows}</tbody></table>')
        elif kind < 0.96:
            out.append(f'<div data-label="{label}">{_text(r)}</div>')
        else:
            out.append(f'<pre data-label="{label}">{_words(r, 3, 20)}</pre>')
    return "".join(out)


def _part(r: random.Random, part: str) -> str:
    name = r.choice(PARTS[part])
    if name.startswith("p "):
        return _element(name, 0, _text(r))
    inner = {
        "header": lambda: r.choice([f'<p data-label="0">{_words(r, 1, 8)}</p>', f'<h1 data-label="0">{_words(r, 1, 4)}</h1>', _words(r, 1, 5), _links(r, 0)]),
        "menu": lambda: "".join(f'<li data-label="0"><a href="/m">{_words(r, 1, 3)}</a></li>' for _ in range(r.randint(2, 7))) if name.startswith("ul") else _links(r, 0),
        "notice": lambda: r.choice([_text(r), f'<p data-label="0">{_text(r)}</p>', f'<p data-label="0">{_text(r)} <a href="/p">{_words(r, 1, 2)}</a></p>']),
        "advert": lambda: r.choice([_text(r), _text(r), f'<p data-label="0">{_text(r)}</p>', f'<a href="/b">{_words(r, 2, 8)}</a>']),
        "sidebar": lambda: r.choice([_links(r, 0), f'<h3 data-label="0">{_words(r, 1, 3)}</h3>' + _links(r, 0), f'<p data-label="0">{_text(r)}</p>', _body(r, 0)]),
        "form": lambda: r.choice([f'<p data-label="0">{_words(r, 1, 6)}</p><input name="q">', f"<label>{_words(r, 1, 3)}</label><input>", f'<div data-label="0">{_text(r)}</div>']),
        "footer": lambda: r.choice([f"&copy; {_words(r, 1, 3)} &middot; {_text(r)}", f'<p data-label="0">&copy; {_text(r)}</p>', _links(r, 0) + f'<p data-label="0">{_words(r, 2, 9)}</p>', _text(r)]),
        "comments": lambda: _comments(r, name),
    }[part]()
    return _element(name, 0, inner)


def _comments(r: random.Random, name: str) -> str:
    one = "li class=comment" if name[0] in "ou" else r.choice(("div class=comment", "article class=comment", "div class=reply", "li"))
    many = "".join(_element(one, 0, r.choice([_text(r), f'<p data-label="0">{_text(r)}</p>', f'<p data-label="0">{_words(r, 1, 2)}</p><p data-label="0">{_text(r)}</p>'])) for _ in range(r.randint(1, 5)))
    title = f'<h2 data-label="0">{_words(r, 1, 2)}</h2>' if name[0] not in "ou" and r.random() < 0.7 else ""
    return title + many


def _article(r: random.Random) -> str:
    title = f'<h1 data-label="1">{_words(r, 1, 14)}</h1>' if r.random() < 0.8 else ""
    inside = [_body(r, 1)]
    for part, chance in (("advert", 0.25), ("sidebar", 0.12), ("form", 0.1), ("notice", 0.05), ("comments", 0.08), ("footer", 0.05)):
        if r.random() < chance:
            inside.append(_part(r, part))
            if r.random() < 0.7:
                inside.append(_body(r, 1))
    if r.random() < 0.08:  # no element of its own
        return title + "".join(inside)
    out = _element(r.choice(PARTS["article"]), 1, title + "".join(inside))
    if r.random() < 0.2:
        out = _element(r.choice(("main", "div class=container", "div class=wrapper", "div id=page")), 1, out)
    return out


def labelled_pages(n: int, seed: int = 0) -> list[str]:
    r, out = random.Random(seed), []
    for _ in range(n):
        before = [p for p, chance in (("header", 0.5), ("menu", 0.75), ("notice", 0.25), ("advert", 0.45), ("form", 0.15), ("sidebar", 0.15)) if r.random() < chance]
        after = [p for p, chance in (("comments", 0.4), ("sidebar", 0.4), ("advert", 0.25), ("form", 0.15), ("menu", 0.1), ("footer", 0.85), ("notice", 0.1)) if r.random() < chance]
        if r.random() < 0.5:
            r.shuffle(before)
        parts = [_part(r, p) for p in before] + [_article(r)] + [_part(r, p) for p in after]
        out.append(f'<!DOCTYPE html><html><head><title>{_words(r, 1, 6)}</title></head><body data-label="0">{"".join(parts)}</body></html>')
    return out
