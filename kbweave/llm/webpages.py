"""Made-up web pages with a label per block: training data for the block labeller.

No labelled page exists, so pages are put together from the parts that web pages
have: an article among menus, headers, sidebars, notices, adverts, forms, reader
comments and footers, in many mark-up habits (semantic tags, classes, ids, bare
divisions, unclosed tags), in random order and nesting, with invented words in
the text and a few stock words in the surroundings. The generator is seeded; its
size is the documented bound of what the labeller is trained on.
"""

from __future__ import annotations

import random

SYLLABLES = ("the an er on th re nd ing ion at en or le que ou eau ai tion ment der die und sch ein ung keit lich ción ar os "
             "ado que el ra mo ka li su no ta ve").split()
STOCK = {
    "menu": "home news about contact sport blog products services archive help shop accueil inicio startseite login".split(),
    "header": "welcome to our site official portal daily times logo".split(),
    "footer": "© copyright all rights reserved privacy policy terms imprint impressum 2024 · contact".split(),
    "side": "related popular trending recent posts tags categories follow us newsletter archive more most read".split(),
    "notice": "we use cookies accept consent this site subscribe notice warning please note maintenance alert".split(),
    "ad": "buy now sale advertisement sponsored offer discount free only today click here save best deal".split(),
    "form": "search your email name password send submit login sign up register message subscribe".split(),
    "comment": "reply great article thanks i agree disagree posted by says comment user ago like nice first".split(),
}
# Names by which each part goes in class and id attributes.
NAMES = {
    "menu": "nav menu navbar navigation topnav main-menu site-nav breadcrumb breadcrumbs nav-links menu-bar tabs toc pagination pager".split(),
    "header": "header site-header page-header masthead top topbar top-bar banner-top branding logo site-title head hero-bar".split(),
    "footer": "footer site-footer page-footer bottom colophon copyright legal foot footer-links credits bottom-bar".split(),
    "side": "sidebar side side-bar widget widgets related related-posts rail right-rail aside recommended trending popular tags "
            "share social social-links newsletter archive secondary more-stories column-right teaser teasers".split(),
    "notice": "notice cookie cookies cookie-banner cookie-notice consent gdpr alert popup modal overlay message announcement toast "
              "warning info-bar paywall disclaimer banner notification notices site-notice".split(),
    "ad": "ad ads advert adverts advertisement sponsored sponsor promo promotion ad-slot ad-box adsbygoogle banner-ad commercial "
          "ad-container advertising".split(),
    "form": "form search search-box search-form login login-form signup sign-up contact-form subscribe subscribe-form newsletter-form".split(),
    "comment": "comments comment comment-list commentlist comments-area discussion replies responses reader-comments user-comments "
               "disqus comment-section comment-body feedback reactions".split(),
}
TAGS = {"menu": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"],
        "side": ["aside", "aside", "div", "section"], "notice": ["div", "div", "p", "section", "aside"], "ad": ["div", "div", "aside", "section", "p"],
        "form": ["form", "form", "div"], "comment": ["section", "div", "div", "ol", "ul", "aside"]}
MAIN = [("article", None), ("article", None), ("article", "post"), ("main", None), ("div", "content"), ("div", "article"),
        ("div", "post-content"), ("div", "entry-content"), ("div", "article-body"), ("div", "story"), ("section", "main-content"),
        ("div", "main"), ("div", "text"), ("div", "body"), ("div", "post"), ("div", "entry"), ("article", "article"), ("main", "content")]


class PageMaker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int, stock: str | None = None) -> str:
        r = self.r
        out = [r.choice(STOCK[stock]) if stock and r.random() < 0.4 else "".join(r.choices(SYLLABLES, k=r.randint(1, 3)))
               for _ in range(max(1, n))]
        return " ".join(out).capitalize() + r.choice([".", "", "!"])

    def _name(self, kind: str) -> str:
        r = self.r
        x = r.random()
        name = r.choice(NAMES[kind])
        if x < 0.75:
            return f' class="{name}"' if r.random() < 0.8 else f" class='{name} {self.words(1).strip('.!').lower()}'"
        return f' id="{name}"' if x < 0.9 else f' id="{name}" class="{r.choice(["box", "wrap", "block", "row"])}"'

    def part(self, kind: str) -> list[tuple[str, int]]:
        """Pieces of mark-up; those with label 0 or 1 are one text block each, -1 is mark-up only."""
        r, own = self.r, []
        tag = r.choice(TAGS[kind])
        semantic = tag in ("nav", "header", "footer", "aside", "form")
        attr = "" if semantic and r.random() < 0.5 else self._name(kind)
        own.append((f"<{tag}{attr}>", -1))
        if kind == "menu":
            if tag != "ul":
                own.append(("<ul>", -1))
            for _ in range(r.randint(2, 9)):
                own.append((f'<li><a href="/{r.randint(1, 99)}">{self.words(r.randint(1, 3), r.choice(["menu", None]))}</a></li>', 0))
            if tag != "ul":
                own.append(("</ul>", -1))
        elif kind == "comment":
            if r.random() < 0.5:
                own.append((f"<h3>{r.randint(1, 50)} {self.words(1, 'comment')}</h3>", 0))
            inner = "li" if tag in ("ol", "ul") else "div"
            for _ in range(r.randint(1, 6)):
                if r.random() < 0.6:
                    own.append((f"<{inner}{self._name('comment') if r.random() < 0.7 else ''}>", -1))
                    for _ in range(r.randint(1, 2)):
                        own.append((f"<p>{self.words(r.randint(3, 60), r.choice(['comment', None, None]))}</p>", 0))
                    own.append((f"</{inner}>", -1))
                else:
                    t = "li" if inner == "li" else "p"
                    own.append((f"<{t}>{self.words(r.randint(3, 60), r.choice(['comment', None, None]))}</{t}>", 0))
        elif kind == "form":
            for _ in range(r.randint(1, 4)):
                own.append((r.choice(["<label>{}</label><br><input type='text'><p></p>", "<p>{}</p>", "<div>{}</div>"]).format(
                    self.words(r.randint(1, 5), "form")), 0))
        elif tag == "p":
            own.append((self.words(r.randint(3, 30), kind if r.random() < 0.5 else None), 0))
        else:
            shapes = ["<p>{}</p>", "<div>{}</div>", "{}<hr>", "<p>{}</p>"]
            if kind in ("side", "footer", "header"):
                shapes += ['<p><a href="/x">{}</a></p>', "<h3>{}</h3>", "<li>{}</li>"]
            for _ in range(r.randint(1, 2 if kind in ("ad", "notice", "header") else 4)):
                own.append((r.choice(shapes).format(self.words(r.choice([2, 6, 12, 30, 50]), kind if r.random() < 0.5 else None)), 0))
        own.append((f"</{tag}>", -1))
        return own

    def article(self) -> list[tuple[str, int]]:
        r = self.r
        tag, cls = r.choice(MAIN)
        out = [(f'<{tag}{f" class={chr(34)}{cls}{chr(34)}" if cls else ""}>', -1)]
        head = self.words(r.randint(3, 12))
        x = r.random()
        if x < 0.75:
            out.append((f"<h1>{head}</h1>", 1))
        elif x < 0.85:
            out += [("<header>", -1), (f"<h1>{head}</h1>", 1), ("</header>", -1)]
        if r.random() < 0.4:
            out.append((f"<p><b>{head}<br>", 1))
        wrap = r.random() < 0.2
        if wrap:
            out.append(("<div>" if r.random() < 0.5 else "<section>", -1))
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            x = r.random()
            text = self.words(r.choice([3, 8, 25, 60, 120]))
            if x < 0.07:
                out.append((f"<h2>{self.words(r.randint(2, 6))}</h2>", 1))
            elif x < 0.13:
                out.append((f"<p><b>{text}<br>", 1))
            elif x < 0.18:
                out += [("<ul>", -1), *((f"<li>{self.words(r.randint(2, 15))}</li>", 1) for _ in range(r.randint(2, 4))), ("</ul>", -1)]
            elif x < 0.22:
                out.append((f"<blockquote>{text}</blockquote>", 1))
            elif x < 0.28:
                out.append((f'<p>{text} <a href="/q">{self.words(2)}</a> {self.words(5)}</p>', 1))
            elif x < 0.36:
                out += self.part(r.choice(["ad", "ad", "side", "notice", "form"]))
            else:
                out.append((f"<p>{text}" + ("</p>" if r.random() < 0.9 else ""), 1))
        if wrap:
            out.append(("</div></section>", -1))
        if r.random() < 0.12:
            out += self.part("comment")
        out.append((f"</{tag}>", -1))
        return out

    def page(self) -> tuple[str, list[int]]:
        """``(html, label of every text block in order)``."""
        r = self.r
        before = [k for k in ("notice", "header", "menu", "ad", "form", "side") if r.random() < (0.6 if k in ("menu", "header") else 0.3)]
        after = [k for k in ("comment", "side", "ad", "form", "notice", "menu", "footer") if r.random() < (0.7 if k == "footer" else 0.35)]
        r.shuffle(before)
        if r.random() < 0.5:
            r.shuffle(after)
        pieces = [("<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>", -1)]
        outer = r.random() < 0.3
        if outer:
            pieces.append((f'<div class="{r.choice(["page", "container", "wrapper", "site", "layout"])}">', -1))
        for k in before:
            pieces += self.part(k)
        pieces += self.article()
        for k in after:
            pieces += self.part(k)
        pieces.append(("</div></body></html>" if outer else "</body></html>", -1))
        return "".join(p for p, _ in pieces), [x for _, x in pieces if x >= 0]
