"""Small labelled table: pages drawn from layouts by a fixed seed, and which of their blocks are main text.

Words do not matter to the classifier, only their number, their links and their place. The first word of a main block carries
`MARK`, which adds no word and no block; it is taken off before anything is counted.
"""

from __future__ import annotations

import random

MARK = "\ue000"
_WORDS = "the old harbour plan was agreed on by a small board after two long hours of talk and people asked for new walls near quay".split()
_MENU = "Home News World Sport Weather Business Culture Travel Contact About Video Science".split()


class Layout:
    """Pieces of one page. Every number of words, link and element is drawn, so that no count is typical of a class."""

    def __init__(self, seed: int):
        self.draw = random.Random(seed)

    def text(self, low: int, high: int) -> str:
        return " ".join(self.draw.choices(_WORDS, k=self.draw.randint(low, high)))

    def either(self, *options: str) -> str:
        return self.draw.choice(options)

    def paragraph(self) -> str:
        """Main text of any length: plain, with a link in it, or all of it a link."""
        kind, own = self.draw.random(), self.either(self.text(1, 5), self.text(6, 25), self.text(20, 60), self.text(30, 120))
        words = (MARK + own).split()
        if kind < 0.12:
            a, z = sorted(self.draw.sample(range(len(words) + 1), 2)) if len(words) > 1 else (0, 1)
            words.insert(z, "</a>")
            words.insert(a, "<a href='/x'>")
        elif kind < 0.2:
            words = ["<a href='/x'>", *(MARK + self.either(self.text(2, 6), self.text(5, 14))).split(), "</a>"]
        return f"<p>{' '.join(words)}</p>"

    def body(self, title: bool = True) -> str:
        """Paragraphs with a heading, now and then a list, a quotation or a second heading."""
        out = [f"<h1>{MARK}{self.text(2, 12)}</h1>"] if title else []
        for _ in range(self.draw.randint(2, 9)):
            out.append(self.paragraph())
            if self.draw.random() < 0.12:
                out.append(self.either(f"<h2>{MARK}{self.text(1, 7)}</h2>", f"<blockquote>{MARK}{self.text(5, 40)}</blockquote>",
                                       "<ul>" + "".join(f"<li>{MARK}{self.text(1, 15)}</li>" for _ in range(3)) + "</ul>"))
        return "".join(out)

    def menu(self) -> str:
        """A list, one line of links with or without marks between them, or links with longer names."""
        names = self.draw.sample(_MENU, self.draw.randint(3, 9))
        if self.draw.random() < 0.3:
            names = [f"{n} {self.text(1, 3)}" for n in names]
        links = [f'<a href="/{n}">{n}</a>' for n in names]
        return self.either("<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>", " | ".join(links), " ".join(links), "".join(f"<div>{x}</div>" for x in links))

    def related(self) -> str:
        """Linked titles of other stories, short or long, some with a heading or a line on each."""
        titles = [f'<a href="/story/{i}">{self.either(self.text(3, 8), self.text(7, 18))}</a>' for i in range(self.draw.randint(3, 6))]
        head = self.either("", f"<h3>{self.text(1, 4)}</h3>")
        return head + self.either("<ul>" + "".join(f"<li>{x}</li>" for x in titles) + "</ul>", "".join(f"<p>{x}</p>" for x in titles), "".join(f"<div>{x}</div>" for x in titles))

    def legal(self) -> str:
        links = " ".join(f'<a href="/{n}">{n}</a>' for n in self.draw.sample(_MENU, 3))
        return self.either(f"<p>Copyright {self.text(3, 14)}</p>", f"<p>{self.text(2, 10)}</p><p>{links}</p>", links, f"{self.text(2, 6)} {links}", f"<p>{self.text(10, 30)}</p>")

    def advert(self) -> str:
        return self.either(self.text(1, 6), f"<p>{self.text(5, 40)}</p>", f'<a href="/buy">{self.text(2, 12)}</a>', f'<p>{self.text(2, 8)}</p><p><a href="/buy">{self.text(2, 5)}</a></p>')

    def comments(self) -> str:
        return f"<h3>{self.text(1, 3)}</h3>" + "".join(f"<div><p>{self.text(1, 4)}</p><p>{self.either(self.text(1, 8), self.text(10, 60))}</p></div>" for _ in range(self.draw.randint(1, 4)))

    def side(self) -> str:
        return self.either(f"<p>{self.text(5, 50)}</p>", f"<p>{self.text(1, 6)}</p>") + self.either("", self.related())

    def notice(self) -> str:
        return self.either(f"<p>{self.text(8, 40)}</p>", self.text(3, 20)) + self.either("", f'<a href="/ok">{self.text(1, 3)}</a>')

    def framed(self, what: str) -> str:
        """A piece of the frame in an element, or with a class, that tells what it is."""
        tag, names = {
            "menu": ("nav", "menu navbar main-navigation"), "related": ("aside", "related sidebar related-stories"), "legal": ("footer", "footer site-footer copyright"),
            "advert": ("aside", "advert ad-box sponsored"), "comments": ("aside", "comments comment-list replies"), "side": ("aside", "sidebar widget side-column"),
            "notice": ("dialog", "cookie-notice newsletter popup")}[what]
        own = getattr(self, what)()
        if self.draw.random() < 0.45:
            return f"<{tag}>{own}</{tag}>"
        name = self.draw.choice(names.split())
        return self.either(f"<div class='{name}'>{own}</div>", f"<section id='{name}'>{own}</section>", f"<div class='x {name}'><div>{own}</div></div>")

    def some(self, *kinds: str, most: int = 2) -> str:
        return "".join(self.framed(self.draw.choice(kinds)) for _ in range(self.draw.randint(0, most)))

    def page(self) -> str:
        kind, before, after = self.draw.random(), self.some("menu", "notice", "advert", most=3), self.some("related", "legal", "side", "comments", "advert", "menu", most=4)
        if kind < 0.55:  # an article element; the frame stands round it and inside it, with and without names
            tag = self.either("article", "main", "article")
            inside = self.body().split("</p>")
            at = self.draw.randint(1, len(inside))
            inside.insert(at, self.some("advert", "related", "side", "notice") if at < len(inside) else self.some("related", "comments", "legal"))
            own = "".join(p + "</p>" if p.count("<p>") > p.count("</p>") and p.rsplit("<p>", 1)[1].count("</p>") == 0 and k != at else p for k, p in enumerate(inside))
            loose = self.either("", "", f"<div>{self.legal()}</div>", f"<div>{self.comments()}</div>", f"<div>{self.related()}</div>", f"<div>{self.side()}</div>")
            opening = self.either("", "", f"<div>{self.menu()}</div>", f"<div>{self.notice()}</div>")
            foot = self.either("", "", f"<ul>{''.join(f'<li><a href=/s{i}>{self.text(3, 10)}</a></li>' for i in range(4))}</ul>")  # other stories in a list of links
            return f"{opening}{before}<{tag}>{own}{foot}</{tag}>{loose}{after}"
        if kind < 0.7:  # containers with names only
            return f"{before}<div class='{self.either('content', 'post-body', 'entry', 'story-text')}'>{self.body()}</div>{after}"
        if kind < 0.8:  # end tags left out, a form round the page
            return self.either(f"<!doctype html><head><title>t</title>{before}<article>{self.body()}</article>{after}", f"<html><head><meta charset=utf-8><title>t</title>{self.body().replace('</p>', '')}",
                               f"<form action='page.aspx'>{before}<article>{self.body()}</article>{after}</form>", f"<form><div>{self.menu()}</div>{self.body()}<div>{self.related()}</div></form>")
        # no element or name tells: words and links of a block and its neighbours have to
        return f"{self.either('', f'<div>{self.menu()}</div>')}<div>{self.body(self.draw.random() < 0.6)}</div>{self.either('', f'<div>{self.related()}</div>', f'<div>{self.menu()}</div>')}{self.either('', after)}"


def drawn(pages: int, seed: int) -> list[str]:
    return [Layout(seed * 100_003 + k).page() for k in range(pages)]


LABELLED = drawn(400, 1)
