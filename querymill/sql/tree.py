"""The syntax tree: nodes of a kind, with named parts, that know the SELECT they belong to."""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    """kind: what it is. value: its name, operator or text. parts: named children, nodes or lists of them.

    scope: the nearest enclosing Select. text: its tokens, joined in one canonical way. flags: a
    column's table, an alias of a source, a join's side and the like.
    """

    __slots__ = ("kind", "value", "parts", "parent", "scope", "span", "flags", "below")

    def __init__(self, kind: str, value: str = "", **parts) -> None:
        self.kind, self.value = kind, value
        self.parts = {k: v for k, v in parts.items() if v is not None and v != []}
        self.parent = self.scope = None
        self.below: list[Node] | None = None  # the children, once the tree is linked and changes no more
        self.span: tuple | None = None
        self.flags: frozenset[str] = frozenset()

    def __getitem__(self, name: str):
        return self.parts.get(name)

    @property
    def text(self) -> str:
        if self.span is None:
            return self.value
        tokens, start, end = self.span
        # a function's name says the same in any letter case
        return " ".join(f"'{t.text}'" if t.kind == "string" else t.upper if t.kind == "word" and tokens[i + 1].text == "(" else t.text for i, t in enumerate(tokens[start:end], start))

    def children(self) -> list[Node]:
        if self.below is not None:
            return self.below
        out = []
        for part in self.parts.values():
            if isinstance(part, list):
                out += part
            else:
                out.append(part)
        return out

    def walk(self) -> Iterator[Node]:
        """This node and all below it, breadth first."""
        queue = [self]
        for node in queue:  # grows while it is read
            yield node
            queue += node.children()

    def find(self, *kinds: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.kind in kinds)

    def link(self) -> Node:
        """Sets parent and scope of everything below."""
        stack = [(self, None, None)]
        while stack:
            node, parent, scope = stack.pop()
            node.parent, node.scope = parent, scope
            inner = node if node.kind == "Select" else scope
            node.below = node.children()
            stack += [(c, node, inner) for c in node.below]
        return self

    def above(self, *kinds: str) -> Node | None:
        """The nearest node of those kinds around this one."""
        node = self.parent
        while node is not None and node.kind not in kinds:
            node = node.parent
        return node

    def __repr__(self) -> str:
        return f"{self.kind}({self.value!r}, {', '.join(self.parts)})"
