"""Rules that rewrite algebra before it is compiled. A rule is given an operator and gives one with the same solutions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields, is_dataclass, replace
from typing import Any

from . import algebra as A


def bottom_up(n: Any, rule: Callable[[Any], Any]) -> Any:
    """The tree with a rule applied to every operator, inputs first."""
    if is_dataclass(n):
        changes = {f.name: bottom_up(getattr(n, f.name), rule) for f in fields(n) if is_dataclass(getattr(n, f.name)) and f.name in ("input", "left", "right", "pattern")}
        n = replace(n, **changes) if changes else n
    return rule(n)


def simplify(n: Any) -> Any:
    """Joins with the unit table, slices of slices, distincts of distincts, projections to what is there, and joins with an empty table."""
    if isinstance(n, A.Join):
        for a, b in ((n.left, n.right), (n.right, n.left)):
            if isinstance(a, A.Unit):
                return b
            if isinstance(a, A.Table) and not a.rows and isinstance(b, A.Table):
                return A.Table(tuple(dict.fromkeys((*a.names, *b.names))), ())
    if isinstance(n, A.Slice) and isinstance(n.input, A.Slice):
        inner = n.input
        room = None if inner.limit is None else max(inner.limit - n.offset, 0)
        return A.Slice(inner.input, inner.offset + n.offset, n.limit if room is None else room if n.limit is None else min(n.limit, room))
    if isinstance(n, (A.Distinct, A.Reduced)) and isinstance(n.input, A.Distinct):
        return n.input
    if isinstance(n, A.Project) and isinstance(n.input, A.Project) and n.names == n.input.names:
        return n.input
    return n


def rewrite(n: Any, rules: list[Callable[[Any], Any]], passes: int = 4) -> Any:
    """Rules applied until nothing changes, four passes at most."""
    for _ in range(passes):
        before = n
        for rule in rules:
            n = bottom_up(n, rule)
        if n == before:
            break
    return n
