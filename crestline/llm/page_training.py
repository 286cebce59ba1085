"""Labelled pages to train the extractor: seeded pages of several layouts, with a label on each text.

The texts are random letters in any of several scripts, so that only structure
and shape can be learned, not words.
"""

from __future__ import annotations

import numpy as np

from .page_blocks import Block, blocks

CONTENT, OTHER = "\ue000", "\ue001"
_LETTERS = ("abcdefghijklmnoprstuvwy", "aeinorstlcdmupéèàçùêäöüßñóí", "авегиклмнопрстуя")


class _Writer:
    def __init__(self, seed: int):
        self.random = np.random.default_rng(seed)
        self.extra = np.random.default_rng([seed, 1])
        self.letters = _LETTERS[self.random.integers(len(_LETTERS))]

    def chance(self, p: float) -> bool:
        return bool(self.random.random() < p)

    def pick(self, *options: str) -> str:
        return options[self.random.integers(len(options))]

    def word(self) -> str:
        return "".join(self.letters[i] for i in self.random.integers(len(self.letters), size=self.random.integers(1, 12)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.random.integers(low, high)))

    def sentences(self, n: int) -> str:
        return " ".join(self.words(2, 16).capitalize() + self.pick(".", ".", ".", "!", "?", "") for _ in range(n))

    def prose(self) -> str:
        odd = self.random.random()
        text = self.sentences(int(self.random.integers(1, 12)))
        if odd < 0.06:
            return text.upper()
        if odd < 0.12:
            return " | ".join(text.split())
        if odd < 0.18:
            return " ".join(w + self.pick("***", "%%%", "&amp;&amp;", "!!", "") for w in text.split())
        return text if odd < 0.85 else self.words(1, 6)

    def menu(self, n: int) -> str:
        items = "".join(f'<li><a href="/{self.word()}">{OTHER}{self.words(1, 3)}</a></li>' for _ in range(n))
        return f"<ul>{items}</ul>"

    def embedded(self) -> str:
        """Controls and formulas within an article, some never closed; drawn apart from the rest."""
        self.random, self.extra = self.extra, self.random
        kind, out = self.random.random(), ""
        if kind < 0.06:
            out = f"<button>{OTHER}{self.words(1, 4)}" + ("</button>" if self.chance(0.7) else "")
        elif kind < 0.08:
            out = "<select>" + "".join(f"<option>{OTHER}{self.words(1, 3)}" for _ in range(3)) + ("</select>" if self.chance(0.7) else "")
        elif kind < 0.12:
            tag = self.pick("noscript", "object")
            out = f"<{tag}><p>{CONTENT}{self.sentences(2)}</p>" + (f"</{tag}>" if self.chance(0.7) else "")
        self.random, self.extra = self.extra, self.random
        return out

    def article(self) -> str:
        out = f"<h1>{CONTENT}{self.words(2, 12)}</h1>" if self.chance(0.9) else ""
        if self.chance(0.2):
            out = f"<header>{out}</header>"
        for _ in range(self.random.integers(1, 9)):
            out += self.embedded()
            kind = self.random.random()
            if kind < 0.75:
                inner = f"{CONTENT}{self.prose()}"
                inner = f"<b>{inner}<br>" if self.chance(0.2) else f'{inner} <a href="/x">{self.words(1, 4)}</a> {self.words(1, 5)}.' if self.chance(0.15) else inner
                out += f"<p>{inner}" + ("</p>" if self.chance(0.9) else "")
            elif kind < 0.82:
                out += f"<h2>{CONTENT}{self.words(1, 8)}</h2>"
            elif kind < 0.9:
                out += "<ul>" + "".join(f"<li>{CONTENT}{self.words(1, 14)}</li>" for _ in range(self.random.integers(1, 5))) + "</ul>"
            elif kind < 0.95:
                out += f"<blockquote>{CONTENT}{self.prose()}</blockquote>"
            else:
                out += f"<table><tr><td>{CONTENT}{self.words(1, 4)}</td><td>{CONTENT}{self.words(1, 4)}</td></tr></table>"
            if self.chance(0.06):
                out += f'<div class="{self.pick("ad", "advert-slot", "share-bar", "newsletter-signup", "related-links")}">{OTHER}{self.prose()}</div>'
        return out

    def clutter(self, place: str) -> str:
        text = lambda: f"{OTHER}{self.sentences(int(self.random.integers(1, 4)))}"
        kinds = {
            "top": [
                lambda: f"<nav>{self.menu(self.random.integers(2, 9))}</nav>",
                lambda: f'<div class="{self.pick("menu", "navbar", "breadcrumbs")}">{self.menu(self.random.integers(2, 9))}</div>',
                lambda: f"<header><h1>{OTHER}{self.words(1, 4)}</h1><p>{text()}</p></header>",
                lambda: f'<div id="{self.pick("masthead", "site-header", "topbar")}"><span>{OTHER}{self.words(1, 5)}</span></div>',
                lambda: f'<div class="{self.pick("ad", "ads", "advert", "sponsored", "banner")}">{text()}</div>',
                lambda: f'<div class="{self.pick("cookie-notice", "consent", "alert")}"><p>{text()}</p></div>',
                lambda: f"<form><label>{OTHER}{self.words(1, 4)}</label><input name=q></form>",
            ],
            "end": [
                lambda: f"<footer>&copy; {self.word()}.example &middot; {text()}</footer>",
                lambda: f"<footer><p>{text()}</p>{self.menu(self.random.integers(1, 6))}</footer>",
                lambda: f'<div class="{self.pick("footer", "site-footer", "legal")}"><p>{text()}</p></div>',
                lambda: f"<aside><h3>{OTHER}{self.words(1, 4)}</h3><p>{text()}</p></aside>",
                lambda: f'<div class="{self.pick("sidebar", "widget", "related", "trending")}"><h3>{OTHER}{self.words(1, 4)}</h3>{self.menu(self.random.integers(1, 6))}</div>',
                lambda: f'<{self.pick("section", "div")} class="{self.pick("comments", "comment-list", "replies")}"><h3>{OTHER}{self.words(1, 3)}</h3>' + "".join(f'<div class="comment"><p>{OTHER}{self.prose()}</p></div>' for _ in range(self.random.integers(1, 5))) + "</section></div>",
                lambda: f'<div id="comments"><ol><li><p>{OTHER}{self.prose()}</p></li></ol></div>',
                lambda: f'<form class="subscribe"><p>{text()}</p></form>',
            ],
        }[place]
        return "".join(kinds[i]() for i in sorted(self.random.permutation(len(kinds))[: self.random.integers(0, 5)]))

    def page(self) -> str:
        body = self.article()
        if self.chance(0.15):
            body += f'<section class="comments"><p>{OTHER}{self.prose()}</p><p>{OTHER}{self.prose()}</p></section>'
        shape = self.random.random()
        if shape < 0.45:
            body = f"<article>{body}</article>"
        elif shape < 0.65:
            body = f"<main><article>{body}</article></main>"
        elif shape < 0.75:
            body = f"<main>{body}</main>"
        elif shape < 0.95:
            body = f'<div class="{self.pick("content", "post-body", "entry", "article-text", "story")}">{body}</div>'
        else:
            body = f"<div>{body}</div>"
        text = self.clutter("top") + body + self.clutter("end")
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{text}" + ("</body></html>" if self.chance(0.9) else "")


def labelled_pages(n: int, seed: int = 1) -> list[tuple[list[Block], list[int]]]:
    """n pages as (blocks, labels); label 1 is main text."""
    pages = []
    for i in range(n):
        found = blocks(_Writer(seed * 100_003 + i).page())
        labels = [0 if OTHER in b.text or CONTENT not in b.text else 1 for b in found]
        for b in found:
            b.text = b.text.replace(CONTENT, "").replace(OTHER, "")
        kept = [(b, y) for b, y in zip(found, labels, strict=True) if b.text]
        if kept:
            pages.append(([b for b, _ in kept], [y for _, y in kept]))
    return pages
