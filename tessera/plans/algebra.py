"""SPARQL queries as a tree of operators and expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    """An encoded term."""

    term: str


@dataclass(frozen=True)
class Triple:
    s: Any
    p: Any
    o: Any


@dataclass(frozen=True)
class TripleTerm:
    """A triple as an object, with variables in it or blank nodes of a template."""

    s: Any
    p: Any
    o: Any


# property paths
@dataclass(frozen=True)
class Link:
    iri: str


@dataclass(frozen=True)
class Inverse:
    path: Any


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Closure:
    """low is 0 or 1; high is 1 (for ?) or None."""

    path: Any
    low: int
    high: int | None


@dataclass(frozen=True)
class Negated:
    forward: tuple
    backward: tuple


# expressions
@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    separator: str | None = None


@dataclass(frozen=True)
class Exists:
    pattern: Any
    negated: bool


# operators
@dataclass(frozen=True)
class Unit:
    pass


@dataclass(frozen=True)
class Bgp:
    triples: tuple


@dataclass(frozen=True)
class Path:
    s: Any
    path: Any
    o: Any


@dataclass(frozen=True)
class Join:
    left: Any
    right: Any


@dataclass(frozen=True)
class LeftJoin:
    left: Any
    right: Any
    condition: Any = None


@dataclass(frozen=True)
class Union:
    left: Any
    right: Any


@dataclass(frozen=True)
class Minus:
    left: Any
    right: Any


@dataclass(frozen=True)
class Filter:
    input: Any
    condition: Any


@dataclass(frozen=True)
class Extend:
    """certain: the expression has a value in every solution."""

    input: Any
    var: str
    expression: Any
    certain: bool = False


@dataclass(frozen=True)
class Graph:
    graph: Any
    input: Any


@dataclass(frozen=True)
class Service:
    endpoint: Any
    silent: bool
    input: Any


@dataclass(frozen=True)
class Table:
    names: tuple
    rows: tuple


@dataclass(frozen=True)
class Group:
    """keys are (name, expression or None); aggregates are (name, Call); an empty key list with aggregates is one group."""

    input: Any
    keys: tuple
    aggregates: tuple


@dataclass(frozen=True)
class OrderBy:
    input: Any
    keys: tuple


@dataclass(frozen=True)
class Project:
    input: Any
    names: tuple


@dataclass(frozen=True)
class Distinct:
    input: Any


@dataclass(frozen=True)
class Reduced:
    input: Any


@dataclass(frozen=True)
class Slice:
    input: Any
    offset: int
    limit: int | None


@dataclass
class Query:
    form: str
    pattern: Any
    template: tuple = ()
    resources: tuple = ()
    default_graphs: tuple = ()
    named_graphs: tuple = ()


@dataclass
class Update:
    """One update operation: kind, quads to delete and insert (templates), a pattern, and graph arguments."""

    kind: str
    delete: tuple = ()
    insert: tuple = ()
    pattern: Any = None
    source: Any = None
    target: Any = None
    silent: bool = False
    using: tuple = field(default_factory=tuple)
