"""One pass over a page's tags: text, markdown, title, main content and links.

A page is read once from left to right. Attribute values may hold ``>``, comments
and the content of ``script`` and ``style`` are no markup, ``<`` not followed by a
tag name is text, nested elements of one name are counted, and what a page leaves
unclosed is closed by its parent's end (or the page's).
"""

from __future__ import annotations

import html.entities
import re
from collections import Counter

_TAG = re.compile(
    r"""<(?:(?P<comment>!--)|(?P<other>[!?])|/(?P<end>[a-zA-Z][^\s/<>]*)[^<>]*>"""
    r"""|(?P<start>[a-zA-Z][^\s/<>]*)(?P<attrs>(?:[^"'<>]++|"[^"]*"|'[^']*')*+)>|(?P<broken>[a-zA-Z][^\s/<>]*)(?P<rest>[^<>]*)>)""")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_CLOSE = {name: re.compile(f"</{name}[^<>]*>", re.I) for name in ("script", "style", "title")}
_ENTITY = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);")
_BLANKS, _LINES, _WHITE = re.compile(r"[ \t\r\f]+"), re.compile(r" *\n[ \n]*"), re.compile(r"[ \t\r\f\n]+")

BLOCKS = frozenset("""p div h1 h2 h3 h4 h5 h6 li ul ol tr table thead tbody article nav section header footer main
    body html title blockquote pre""".split())
# Elements that a sibling of the same name closes.
_SIBLINGS = frozenset(("p", "li", "tr", "td", "th"))
_STACKED = BLOCKS | {"td", "th"}


def decode_entities(s: str) -> str:
    """Named and numeric character references that end in ``;``; what names no
    character stays. A no-break space becomes a space."""
    def one(m):
        name = m.group(1)
        if name[0] != "#":
            return html.entities.html5.get(name + ";", m.group())
        code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        if not 0 < code <= 0x10FFFF or 0xD800 <= code <= 0xDFFF:
            return m.group()
        return html.unescape(m.group())
    return _ENTITY.sub(one, s).replace("\xa0", " ") if "&" in s else s.replace("\xa0", " ")


def tidy(s: str) -> str:
    """Blanks run together, lines trimmed, empty lines dropped."""
    return _LINES.sub("\n", _BLANKS.sub(" ", s)).strip(" \n")


def one_line(s: str) -> str:
    return _WHITE.sub(" ", s).strip(" ")


def attributes(s: str) -> dict[str, str]:
    """Attribute values by lower-case name; of repeated names the first counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(s):
        out.setdefault(name.lower(), decode_entities(a or b or c).strip())
    return out


class Page:
    """What one pass over a page finds; null counts as an empty page."""

    def __init__(self, source: str | None):
        self.text_parts: list[str] = []
        self.md_parts: list[str] = []
        self.links: list[tuple[str, str, bool]] = []          # text, url, inside navigation
        self._title = self._h1 = None
        self._articles: list[tuple[int, int]] = []            # spans of parts (both lists grow together)
        self._body: list[int] = []
        self._read(source or "")

    # -- what is asked for

    def text(self) -> str:
        return tidy("".join(self.text_parts))

    def markdown(self) -> str:
        return tidy("".join(self.md_parts))

    def title(self) -> str:
        return self._title or self._h1 or ""

    def main_text(self) -> str:
        return self._main(self.text_parts)

    def main_markdown(self) -> str:
        return self._main(self.md_parts)

    def _main(self, parts: list[str]) -> str:
        """All outermost articles if they hold anything, else the body, else all."""
        found = tidy("\n".join("".join(parts[a:b]) for a, b in self._articles))
        if not found and self._body:
            found = tidy("".join(parts[self._body[0]:self._body[1]]))
        return found or tidy("".join(parts))

    # -- the pass

    def _put(self, text: str, md: str | None = None) -> None:
        self.text_parts.append(text)
        self.md_parts.append(text if md is None else md)

    def _read(self, s: str) -> None:
        put, at, n = self._put, 0, len(s)
        head, titles = False, True
        stack: list[str] = []
        opened: Counter[str] = Counter()
        depth = {"article": 0, "nav": 0}
        article = h1 = link = body = None

        def close_link():
            nonlocal link
            if link:
                first, url, nav, _ = link
                self.links.append((one_line("".join(self.text_parts[first:])), url, nav))
                put("", f"]({url})")
                link = None

        def close_h1():
            nonlocal h1
            if h1 is not None and self._h1 is None:
                self._h1 = one_line("".join(self.text_parts[h1:]))
            h1 = None

        def pop(to: int):
            if link and to < link[3]:
                close_link()
            opened.subtract(stack[to:])
            del stack[to:]

        while at < n:
            m = _TAG.search(s, at)
            begin = m.start() if m else n
            if begin > at and not head:
                put(decode_entities(s[at:begin]))
            if not m:
                break
            at = m.end()
            kind = m.lastgroup
            if kind == "comment":
                short = s.startswith((">", "->"), at)
                end = s.find(">" if short else "-->", at)
                at = n if end < 0 else end + (1 if short else 3)
                continue
            if kind == "other":
                end = s.find(">", at)
                at = n if end < 0 else end + 1
                continue
            if kind == "end":
                name = m["end"].lower()
                if name == "head":
                    head = False
                elif head:
                    continue
                elif name == "a":
                    close_link()
                elif name in _STACKED:
                    if opened[name]:
                        to = len(stack) - 1
                        while stack[to] != name:
                            to -= 1
                        pop(to)
                    if name == "h1":
                        close_h1()
                    if depth.get(name):
                        depth[name] -= 1
                        if name == "article" and not depth[name]:
                            self._articles.append((article, len(self.text_parts)))
                    elif name == "body" and body is not None and not self._body:
                        self._body = [body, len(self.text_parts)]
                    put(" ", "") if name in ("td", "th") else put("\n")
                continue
            name, attrs = (m["start"] or m["broken"]).lower(), m["attrs"] or m["rest"] or ""
            if name in ("script", "style"):
                end = _CLOSE[name].search(s, at)
                at = end.end() if end else n
                continue
            if name == "title":
                end = _CLOSE[name].search(s, at) if titles else None
                titles = end is not None                       # without an end tag, a title ends at the next tag
                stop = end.start() if end else s.find("<", at) % (n + 1)
                inner = decode_entities(s[at:stop])
                if self._title is None:
                    self._title = one_line(inner)
                if not head:
                    put(f"\n{inner}\n")
                at = end.end() if end else stop
                continue
            if name == "head":
                head = True
                continue
            if name == "body":
                head = False
            if head:
                continue
            if name == "br":
                put("\n")
            elif name == "img":
                a = attributes(attrs)
                if a.get("src"):
                    put("", f"![{a.get('alt', '')}]({a['src']})")
            elif name == "a":
                close_link()
                a = attributes(attrs)
                if "href" in a:
                    link = (len(self.text_parts), a["href"], depth["nav"] > 0, len(stack))
                    put("", "[")
            elif name in _STACKED:
                if stack and name == stack[-1] and name in _SIBLINGS:
                    pop(len(stack) - 1)
                stack.append(name)
                opened[name] += 1
                if len(name) == 2 and name[0] == "h" and name[1].isdigit():
                    close_h1()
                    put("\n", "\n" + "#" * int(name[1]) + " ")
                    if name == "h1" and self._h1 is None:
                        h1 = len(self.text_parts)
                elif name == "li":
                    put("\n", "\n* ")
                elif name in ("td", "th"):
                    put("", "| ")
                else:
                    put("\n")
                if name in depth:
                    if name == "article" and not depth[name]:
                        article = len(self.text_parts)
                    depth[name] += 1
                elif name == "body" and body is None:
                    body = len(self.text_parts)
        close_link()
        close_h1()
        if depth["article"]:
            self._articles.append((article, len(self.text_parts)))
        if body is not None and not self._body:
            self._body = [body, len(self.text_parts)]
