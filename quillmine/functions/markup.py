"""A small HTML tree: open tags nest until their end tag, as a lenient parser without repair rules builds it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

#: Elements without content.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())

#: An ampersand that opens no reference with a semicolon.
_BARE = re.compile(r"&(?!#?\w+;)")


class Node:
    __slots__ = ("name", "attributes", "parent", "children")

    def __init__(self, name: str, attributes: dict | None = None, parent: Node | None = None):
        self.name, self.attributes, self.parent, self.children = name, attributes or {}, parent, []

    def walk(self) -> Iterator[Node | str]:
        """Everything inside, in document order."""
        stack = [iter(self.children)]
        while stack:
            item = next(stack[-1], None)
            if item is None:
                stack.pop()
                continue
            yield item
            if isinstance(item, Node):
                stack.append(iter(item.children))

    def all(self, *names: str) -> Iterator[Node]:
        return (x for x in self.walk() if isinstance(x, Node) and x.name in names)

    def first(self, name: str) -> Node | None:
        return next(self.all(name), None)

    def inside(self, *names: str) -> bool:
        up = self.parent
        while up is not None:
            if up.name in names:
                return True
            up = up.parent
        return False

    def text(self, separator: str = " ") -> str:
        """The strings inside, each stripped, without empty ones."""
        return separator.join(filter(None, (x.strip() for x in self.walk() if isinstance(x, str))))

    def classes(self) -> set[str]:
        return set((self.attributes.get("class") or "").split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.at = self.root
        self.open: dict[str, int] = {}
        self.raw: list[str] = []

    def flush(self) -> None:
        if self.raw:
            self.at.children.append("".join(self.raw))
            self.raw = []

    def handle_starttag(self, tag, attrs):
        self.flush()
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        while self.open.get(tag, 0):
            done = self.at
            self.at = done.parent
            self.open[done.name] -= 1
            if done.name == tag:
                break

    def handle_data(self, data):
        self.raw.append(data)

    def handle_comment(self, data):
        self.flush()


def parse(html: str, terminated: bool = False) -> Node:
    """The tree of a page. terminated: a reference without its semicolon, as at the end of a text that was cut, stays as it is; what script and style hold isn't kept then."""
    builder = _Builder()
    builder.feed(_BARE.sub("&amp;", html) if terminated else html)
    builder.close()
    builder.flush()
    return builder.root


def drop(root: Node, names: frozenset[str]) -> None:
    """Remove elements with these names and all inside them."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if not (isinstance(c, Node) and c.name in names)]
        stack += [c for c in node.children if isinstance(c, Node)]
