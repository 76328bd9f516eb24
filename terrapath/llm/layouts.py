"""Pages with known main text, to learn from: a page's own words, laid out anew at random.

No table says which parts of a page are its article. So the words of a bounded sample of pages are put into random layouts,
in which main text carries a mark, and boilerplate of every kind stands around and inside the article. Layouts differ in elements, class names and
lengths, and now and then leave out what would give a part away.
"""

from __future__ import annotations

import html as references
from random import Random

#: Begins each run of main text in a layout; taken from the words before.
MARK = ""


class Layout:
    def __init__(self, words: list[str], seed: int) -> None:
        self.pick = Random(seed)
        self.words_of = [w for w in words if MARK not in w] or ["text"]

    def words(self, least: int, most: int) -> str:
        n, at = self.pick.randint(least, most), self.pick.randrange(len(self.words_of))
        got = self.words_of[at : at + n]
        while len(got) < n:
            got = (got + self.words_of)[:n]
        return references.escape(" ".join(got))

    def main(self) -> str:
        """Main text of any length, one word to a long passage."""
        return MARK + self.words(*self.pick.choice(((1, 1), (1, 4), (4, 15), (15, 60), (40, 150), (80, 250))))

    def chance(self, p: float) -> bool:
        return self.pick.random() < p

    def named(self, *names: str) -> str:
        """A class or id attribute, at times with words that say nothing, at times none."""
        if self.chance(0.15):
            return self.pick.choice(("", ' class="wrap"', ' class="c1 x"', ' style="margin:0"'))
        name = self.pick.choice(names)
        name += self.pick.choice(("", "", "-1", "-wrap", "-box", " clearfix", "__inner"))
        return f' {self.pick.choice(("class", "class", "id"))}="{name}"'

    def links(self, least: int, most: int, prefix: str = "") -> str:
        return prefix.join(f'<a href="/{k}">{self.words(1, self.pick.choice((1, 2, 8)))}</a>' for k in range(self.pick.randint(least, most)))

    def menu(self) -> str:
        items = "".join(f"<li>{self.links(1, 1)}</li>" for _ in range(self.pick.randint(2, 9)))
        listed = f"<ul>{items}</ul>" if self.chance(0.7) else self.links(2, 8, " | ")
        return self.pick.choice((f"<nav>{listed}</nav>", f"<nav>{listed}</nav>", f"<div{self.named('menu', 'nav', 'main-navigation', 'navbar')}>{listed}</div>", f"<ul{self.named('menu', 'breadcrumb', 'pagination')}>{items}</ul>"))

    def head(self) -> str:
        inner = f"<a href='/'>{self.words(1, 3)}</a>" + (f"<p>{self.words(2, 9)}</p>" if self.chance(0.5) else "") + (self.menu() if self.chance(0.4) else "")
        return self.pick.choice((f"<header>{inner}</header>", f"<div{self.named('header', 'site-header', 'banner', 'masthead', 'topbar')}>{inner}</div>"))

    def foot(self) -> str:
        inner = f"&copy; {self.words(1, 4)} &middot; {self.words(1, 20)}" + (self.links(1, 5, " ") if self.chance(0.4) else "") + (f"<p>{self.words(4, 25)}</p>" if self.chance(0.3) else "")
        return self.pick.choice((f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{self.named('footer', 'site-footer', 'copyright', 'colophon')}>{inner}</div>"))

    def advert(self) -> str:
        inner = self.words(1, self.pick.choice((5, 15, 60)))
        inner = self.pick.choice((inner, f"<p>{inner}</p>", f"<a href='#'>{inner}</a>"))
        return f"<div class=\"{self.pick.choice(('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo', 'advertisement top'))}\">{inner}</div>"

    def notice(self) -> str:
        button = f"<button>{self.words(1, 2)}</button>" if self.chance(0.5) else ""
        return f"<div{self.named('cookie-notice', 'notice', 'alert', 'gdpr-consent', 'newsletter', 'popup')}><p>{self.words(4, 40)}</p>{button}</div>"

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 3)}</label><input name=q>" for _ in range(self.pick.randint(1, 3)))
        choice = f"<select>{''.join(f'<option>{self.words(1, 2)}' for _ in range(3))}</select>" if self.chance(0.3) else ""
        return f"<form action='/'{self.named('search-form', 'login', 'signup')}>{self.words(1, 8) if self.chance(0.4) else ''}{fields}{choice}<button>{self.words(1, 2)}</button></form>"

    def side(self) -> str:
        parts = [f"<h3>{self.words(1, 3)}</h3>", f"<ul>{''.join(f'<li>{self.links(1, 1)}</li>' for _ in range(self.pick.randint(2, 8)))}</ul>", f"<p>{self.words(3, 50)}</p>", self.advert(), self.form()]
        inner = "".join(x for x in parts if self.chance(0.6))
        return self.pick.choice((f"<aside>{inner}</aside>", f"<div{self.named('sidebar', 'widget', 'right-rail', 'side')}>{inner}</div>"))

    def comments(self) -> str:
        def one() -> str:
            by = f"<span class=author>{self.words(1, 2)}</span>" if self.chance(0.5) else ""
            said = self.words(1, self.pick.choice((6, 30, 120)))
            return f"<{tag}{self.pick.choice((' class=comment', ' class=\"reply\"', ' class=\"comment-body\"'))}>{by}{self.pick.choice((said, f'<p>{said}</p>'))}</{tag}>"

        tag = self.pick.choice(("li", "div", "article"))
        inner = (f"<h3>{self.words(1, 3)}</h3>" if self.chance(0.6) else "") + "".join(one() for _ in range(self.pick.randint(1, 6))) + (self.form() if self.chance(0.3) else "")
        return self.pick.choice((f'<section id="comments">{inner}</section>', f'<div class="comments">{inner}</div>', f'<ol class="commentlist">{inner}</ol>', f'<div id="disqus_thread" class="discussion">{inner}</div>'))

    def related(self) -> str:
        inner = f"<h4>{self.words(1, 3)}</h4><ul>{''.join(f'<li>{self.links(1, 1)}</li>' for _ in range(self.pick.randint(2, 6)))}</ul>"
        return f"<div{self.named('related', 'share', 'social', 'tags', 'recommended')}>{inner if self.chance(0.6) else self.links(2, 5, ' ')}</div>"

    def article(self) -> str:
        parts = [f"<h{self.pick.choice('1112')}>{MARK}{self.words(2, 14)}</h1>"] if self.chance(0.85) else []
        style = self.pick.choice(("p", "p", "p", "mixed", "div", "br"))
        for _ in range(self.pick.choice((1, 1, 2, 4, 8, 14))):
            said = self.main()
            kind = self.pick.random()
            if style == "div":
                parts.append(f"<div>{said}</div>")
            elif style == "br":
                parts.append(f"{said}<br><br>")
            elif kind < 0.12:
                parts.append(f"<p><b>{said}<br><p>{self.main()}</p>")
            elif kind < 0.2:
                parts.append(f"<p>{said}")
            elif style == "mixed" and kind < 0.32:
                parts.append(f"<ul>{''.join(f'<li>{self.main()}</li>' for _ in range(self.pick.randint(1, 5)))}</ul>")
            elif style == "mixed" and kind < 0.4:
                parts.append(f"<blockquote><p>{said}</p></blockquote>")
            elif style == "mixed" and kind < 0.46:
                parts.append(f"<table><tr><td>{said}</td><td>{self.main()}</td></tr></table>")
            elif style == "mixed" and kind < 0.54:
                parts.append(f"<h2>{MARK}{self.words(1, 6)}</h2><p>{said}</p>")
            else:
                parts.append(f"<p>{said} <a href='/x'>{self.words(1, 3)}</a></p>" if self.chance(0.12) else f"<p>{said}</p>")
            if self.chance(0.06):
                parts.append(self.pick.choice((self.advert, self.related, self.notice))())
        if self.chance(0.2):
            parts.append(self.pick.choice((self.related, self.comments))())
        inner = "".join(parts)
        return self.pick.choice((
            f"<article>{inner}</article>", f"<article>{inner}</article>", f"<article{self.named('post', 'entry', 'story')}>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>",
            f"<div{self.named('content', 'post', 'entry-content', 'article-body', 'story', 'main-text', 'post-body')}>{inner}</div>", f"<section{self.named('article', 'content', 'body')}>{inner}</section>",
            f"<div{self.named('main', 'page-content')}><div{self.named('post', 'text')}>{inner}</div></div>", f"<table><tr><td>{inner}</td></tr></table>",
        ))

    def page(self) -> str:
        before = [x() for x, p in ((self.notice, 0.2), (self.head, 0.5), (self.menu, 0.65), (self.advert, 0.5), (self.form, 0.15), (self.side, 0.2)) if self.chance(p)]
        after = [x() for x, p in ((self.related, 0.25), (self.comments, 0.4), (self.side, 0.3), (self.advert, 0.2), (self.notice, 0.12), (self.form, 0.1)) if self.chance(p)]
        body = "".join((*before, self.article(), *after))
        body = self.pick.choice((body, body, f"<div{self.named('page', 'container', 'wrapper', 'row')}>{body}</div>"))
        return f"<html><head><title>{self.words(1, 9)}</title></head><body>{body}{self.foot() if self.chance(0.8) else ''}</body></html>"
