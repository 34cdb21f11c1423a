"""A small element tree over the standard parser. End tags close their element and all open ones in it; nothing closes itself."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@lru_cache(maxsize=65_536)
def _matches(pattern: str, names: str) -> bool:
    """Documents share few class attributes, which are asked for the same patterns again and again."""
    return bool(re.search(pattern, names))


@lru_cache(maxsize=1_024)
def _names(tags: str) -> frozenset[str]:
    return frozenset(tags.split())


class Element:
    __slots__ = ("tag", "attrs", "kids", "parent", "_below")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attrs, self.kids, self.parent, self._below = tag, attrs, [], parent, None

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name) or default

    def has(self, pattern: str) -> bool:
        """Whether a class name contains the pattern."""
        return _matches(pattern, self.attrs.get("class") or "")

    def walk(self) -> Iterator[Element]:
        """Elements below in document order."""
        todo = [k for k in reversed(self.kids) if k.__class__ is Element]
        while todo:
            x = todo.pop()
            yield x
            todo += [k for k in reversed(x.kids) if k.__class__ is Element]

    def all(self, tags: str | None = None, cls: str | None = None) -> Iterator[Element]:
        names = _names(tags) if tags else None
        # a tree that is asked doesn't change any more
        if self._below is None:
            self._below = list(self.walk())
        return (x for x in self._below if (names is None or x.tag in names) and (cls is None or _matches(cls, x.attrs.get("class") or "")))

    def first(self, tags: str | None = None, cls: str | None = None) -> Element | None:
        return next(self.all(tags, cls), None)

    def up(self) -> Iterator[Element]:
        x = self.parent
        while x is not None:
            yield x
            x = x.parent

    def text(self, drop: str | None = None) -> str:
        """Text below, without elements of a dropped class or superscripts if `drop` is given."""
        out, todo = [], list(reversed(self.kids))
        while todo:
            x = todo.pop()
            if x.__class__ is str:
                out.append(x)
            elif x.tag not in ("script", "style") and not (drop and (x.tag == "sup" or x.has(drop))):
                todo += reversed(x.kids)
        return "".join(out)


def markup(e: Element) -> str:
    """An element written out again, with all its attributes and what is in it."""
    out, todo = [], [e]
    while todo:
        x = todo.pop()
        if x.__class__ is tuple:
            out.append(x[0])
        elif x.__class__ is str:
            out.append(html.escape(x, quote=False))
        else:
            out.append(f"<{x.tag}{''.join(f' {k}="{html.escape(v)}"' for k, v in x.attrs.items())}>")
            if x.tag not in VOID:
                todo.append((f"</{x.tag}>",))
                todo += reversed(x.kids)
    return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", {}, None)
        self.open = self.root

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = Element(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.kids.append(e)
        if tag not in VOID:
            self.open = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open.kids.append(Element(tag, {k: v or "" for k, v in attrs}, self.open))

    def handle_endtag(self, tag: str) -> None:
        x = self.open
        while x.parent is not None and x.tag != tag:
            x = x.parent
        if x.parent is not None:
            self.open = x.parent

    def handle_data(self, data: str) -> None:
        self.open.kids.append(data)


#: Text, a start tag whose attributes are all in double quotes, or an end tag.
_PLAIN = re.compile(r'([^<]+)|<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][-a-zA-Z0-9_:.]*="[^"]*")*)[ \t\n]*(/?)>|</([a-zA-Z][a-zA-Z0-9]*)>')
_ATTRIBUTE = re.compile(r'([a-zA-Z][-a-zA-Z0-9_:.]*)="([^"]*)"')
#: Elements in which the standard parser reads markup as text.
_RAW = frozenset([*HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()), "plaintext", "noscript"])


def _plain_tree(text: str) -> Element | None:
    """The standard parser's tree of markup that has nothing but plain tags and text, in one scan; None where anything else turns up."""
    root = x = Element("#root", {}, None)
    at = 0
    for m in _PLAIN.finditer(text):
        if m.start() != at:
            return None
        at = m.end()
        data, tag, attrs, alone, end = m.groups()
        if data is not None:
            x.kids.append(html.unescape(data) if "&" in data else data)
        elif tag is not None:
            tag = tag.lower()
            if tag in _RAW:
                return None
            found = {k.lower(): html.unescape(v) if "&" in v else v for k, v in _ATTRIBUTE.findall(attrs)} if attrs else {}
            e = Element(tag, found, x)
            x.kids.append(e)
            if not alone and tag not in VOID:
                x = e
        else:
            end, y = end.lower(), x
            while y.parent is not None and y.tag != end:
                y = y.parent
            if y.parent is not None:
                x = y.parent
    return root if at == len(text) else None


def parse(markup: str | bytes | None) -> Element:
    if not markup:
        return Element("#root", {}, None)
    text = markup.decode("utf-8", "replace") if isinstance(markup, bytes) else markup
    if (root := _plain_tree(text)) is not None:
        return root
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


def flat(text: str) -> str:
    return " ".join(text.split())
