"""Adaptive radix tree over keys of fixed-width turn ids.

A node branches on one byte and holds its children in the smallest of four layouts: 4 or 16 sorted bytes beside the
children, a table of 256 one-byte places for up to 48 children, or 256 children outright; it grows into the next one when
full. Bytes that do not branch are kept as the node's prefix (path compression). A key may end at any node.
"""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    """Prefix, children and the value of the key that ends here, if any."""

    __slots__ = ("prefix", "size", "keys", "kids", "value")

    def __init__(self, prefix: bytes, value=None):
        self.prefix, self.value = prefix, value
        self.size, self.keys, self.kids = 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.size <= 16:
            at = self.keys.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.size == 48:
            at = self.keys[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, node: Node) -> None:
        """Add a child, or take the place of the one under this byte."""
        if self.size <= 16:
            at = self.keys.find(byte)
            if at >= 0:
                self.kids[at] = node
                return
            if len(self.kids) == self.size:
                self.grow()
                self.put(byte, node)
                return
            at = sum(k < byte for k in self.keys)
            self.keys.insert(at, byte)
            self.kids.insert(at, node)
        elif self.size == 48:
            if self.keys[byte]:
                self.kids[self.keys[byte] - 1] = node
                return
            if len(self.kids) == 48:
                self.grow()
                self.kids[byte] = node
                return
            self.kids.append(node)
            self.keys[byte] = len(self.kids)
        else:
            self.kids[byte] = node

    def grow(self) -> None:
        if self.size == 4:
            self.size = 16
        elif self.size == 16:
            places = bytearray(256)
            for at, byte in enumerate(self.keys):
                places[byte] = at + 1
            self.size, self.keys = 48, places
        else:
            kids: list[Node | None] = [None] * 256
            for byte, at in enumerate(self.keys):
                if at:
                    kids[byte] = self.kids[at - 1]
            self.size, self.keys, self.kids = 256, bytearray(), kids

    def children(self) -> list[Node]:
        return [k for k in self.kids if k is not None] if self.size == 256 else self.kids


class Tree:
    """Keys with values; the value of a key put twice is ``merge`` of both."""

    def __init__(self, merge):
        self.root, self.merge = Node(b""), merge

    def put(self, key: bytes, value) -> None:
        node, at, parent = self.root, 0, None
        while True:
            prefix = node.prefix
            if not key.startswith(prefix, at):
                rest = key[at:at + len(prefix)]
                same = next((i for i, (a, b) in enumerate(zip(prefix, rest)) if a != b), len(rest))
                fork = Node(prefix[:same])
                node.prefix = prefix[same + 1:]
                fork.put(prefix[same], node)
                if parent is None:
                    self.root = fork
                else:
                    parent.put(key[at - 1], fork)
                node = fork
                at += same
            else:
                at += len(prefix)
            if at == len(key):
                node.value = value if node.value is None else self.merge(node.value, value)
                return
            byte = key[at]
            below = node.child(byte)
            at += 1
            if below is None:
                node.put(byte, Node(key[at:], value))
                return
            parent, node = node, below

    def edges(self) -> Iterator[tuple[int, int, object]]:
        """(begin, finish, value) of every node: bytes of key above it (-1 for the root), at its end, values of its subtree merged."""
        order = [(self.root, -1, -1)]
        for up, (node, begin, _) in enumerate(order):
            finish = begin + 1 + len(node.prefix)
            order.extend((kid, finish, up) for kid in node.children())
        merged = [node.value for node, _, _ in order]
        for at in range(len(order) - 1, -1, -1):
            node, begin, up = order[at]
            if up >= 0:
                merged[up] = merged[at] if merged[up] is None else self.merge(merged[up], merged[at])
            yield begin, begin + 1 + len(node.prefix), merged[at]
