"""A balanced search tree for best-fit packing: remaining room, tightest first.

Nodes are tuples (left, key, right, height) that never change; every step rebuilds one path.
"""

from __future__ import annotations


def _height(t) -> int:
    return t[3] if t else 0


def _node(left, key, right):
    return left, key, right, 1 + max(_height(left), _height(right))


def _join(left, key, right):
    """A balanced tree of two balanced sides whose heights differ by at most two."""
    if _height(left) > _height(right) + 1:
        a, k, b, _ = left
        if _height(a) >= _height(b):
            return _node(a, k, _node(b, key, right))
        return _node(_node(a, k, b[0]), b[1], _node(b[2], key, right))
    if _height(right) > _height(left) + 1:
        a, k, b, _ = right
        if _height(b) >= _height(a):
            return _node(_node(left, key, a), k, b)
        return _node(_node(left, key, a[0]), a[1], _node(a[2], k, b))
    return _node(left, key, right)


def insert(t, key):
    if not t:
        return None, key, None, 1
    left, own, right, _ = t
    return _join(insert(left, key), own, right) if key < own else _join(left, own, insert(right, key))


def pop_first(t):
    """(the least key, the tree without it)."""
    left, own, right, _ = t
    if not left:
        return own, right
    key, left = pop_first(left)
    return key, _join(left, own, right)


def pop_at_least(t, key):
    """(the least key not under ``key``, the tree without it), or None if all are under it."""
    if not t:
        return None
    left, own, right, _ = t
    if own < key:
        found = pop_at_least(right, key)
        return found and (found[0], _join(left, own, found[1]))
    if found := pop_at_least(left, key):
        return found[0], _join(found[1], own, right)
    if not right:
        return own, left
    after, rest = pop_first(right)
    return own, _join(left, after, rest)


class Rooms:
    """Bins by remaining room: (room, bin) keys in a balanced tree."""

    def __init__(self, keys=()):
        self.tree = None
        for key in keys:
            self.add(key)

    def add(self, key: tuple[int, int]) -> None:
        self.tree = insert(self.tree, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the bin of least room that still holds ``size``."""
        found = pop_at_least(self.tree, (size, -1))
        if found is None:
            return None
        self.tree = found[1]
        return found[0]
