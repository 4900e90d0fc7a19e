"""SPARQL algebra to DataFrames. All planning happens here; running is left to Catalyst."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import builtins as B
from ..functions import terms as t
from ..functions.terms import Val
from ..operators import paths
from ..sources.mapping import TYPE, RelationalMap
from . import algebra as A


@dataclass
class Solutions:
    """A bag of mappings: a column for each variable (null is unbound), its kind, and which are always bound."""

    df: DataFrame
    kinds: dict[str, str]
    certain: frozenset[str]

    def val(self, name: str) -> Val:
        return Val(self.kinds[name], F.col(f"`{name}`"))


@dataclass
class Context:
    """What a query runs over, and what it may call."""

    spark: SparkSession
    quads: DataFrame | None = None
    mapping: RelationalMap | None = None
    registry: B.Registry = field(default_factory=B.Registry)
    services: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    types_of: Callable[[str], list[str]] | None = None
    rewrites: list[Callable] = field(default_factory=list)
    base: str = ""
    graph: object = None  # None: default graph; a term: that graph; a Var: any named graph
    default_graphs: tuple = ()
    named_graphs: tuple = ()
    now: str = field(default_factory=lambda: datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S"))
    counter: itertools.count = field(default_factory=itertools.count)

    def active(self, predicate: str | None = None) -> DataFrame:
        """The quads (s, p, o, g) that patterns are matched on, in the active graph; of mapped tables only those of a predicate."""
        quads = self.quads if self.quads is not None else self.mapping.quads(predicate)
        if self.graph is None:
            if self.default_graphs:
                return quads.where(F.col("g").isin([t.iri(g) for g in self.default_graphs])).select("s", "p", "o").distinct().withColumn("g", F.lit(None).cast("string"))
            if self.named_graphs:
                return quads.where(F.lit(False))
            return quads.where("g IS NULL")
        named = quads.where("g IS NOT NULL")
        if self.named_graphs:
            named = named.where(F.col("g").isin([t.iri(g) for g in self.named_graphs]))
        elif self.default_graphs:
            named = named.where(F.lit(False))
        return named.where(F.col("g") == self.graph.term) if isinstance(self.graph, A.Const) else named


def compile_pattern(node, ctx: Context) -> Solutions:
    return _COMPILERS[type(node)](node, ctx)


def one_row(ctx: Context) -> DataFrame:
    return ctx.spark.range(1).select(F.lit(1).alias("__unit"))


def _unit(node: A.Unit, ctx: Context) -> Solutions:
    return Solutions(one_row(ctx), {}, frozenset())


# basic graph patterns
def _bgp(node: A.Bgp, ctx: Context) -> Solutions:
    stars: dict = {}
    for triple in node.triples:
        stars.setdefault(triple.s, []).append(triple)
    out = None
    waiting = [_star(s, triples, ctx) for s, triples in stars.items()]
    waiting = [x for group in waiting for x in group]
    while waiting:  # next one that shares a variable, so that only patterns that aren't connected give a product
        k = next((k for k, s in enumerate(waiting) if out is None or set(s.kinds) & set(out.kinds)), 0)
        out = waiting[k] if out is None else _join_solutions(out, waiting[k])
        waiting.pop(k)
    return out


def _star(subject, triples: list, ctx: Context) -> list[Solutions]:
    """Patterns on one subject: one scan of a mapped table where it can be told which, else one solution table each."""
    if ctx.mapping is not None and ctx.quads is None and ctx.graph is None:
        constant = all(isinstance(x.p, A.Const) for x in triples)
        table = None
        if constant:
            classes = [x.o.term[1:] for x in triples if x.p.term == t.iri(TYPE) and isinstance(x.o, A.Const)]
            plain = [x.p.term[1:] for x in triples if x.p.term != t.iri(TYPE)]
            if classes:
                table = ctx.mapping.of_class(classes[0])
            elif plain:
                owners = ctx.mapping.of_predicate(plain[0])
                table = owners[0] if len(owners) == 1 else None
            if table is not None and not (all(c == table.cls for c in classes) and all(p in table.columns or p in table.links for p in plain)):
                table = None
        if table is not None and all(x.p.term != t.iri(TYPE) or isinstance(x.o, A.Const) for x in triples):
            return [_table_scan(subject, triples, table, ctx)]
    return [_triple(x, ctx) for x in triples]


def _table_scan(subject, triples: list, table, ctx: Context) -> Solutions:
    df = ctx.mapping.load(table.name)
    bound: dict[str, Val] = {}
    conditions: list[Column] = []

    def bind(x, v: Val) -> None:
        if isinstance(x, A.Const):
            conditions.append(_is_constant(v, x.term, df))
        elif x.name in bound:
            conditions.append(t.equal(bound[x.name], v))
        else:
            bound[x.name] = v
            conditions.append(v.col.isNotNull())

    bind(subject, table.subject_value())
    for x in triples:
        if x.p.term != t.iri(TYPE):
            bind(x.o, ctx.mapping.value(table, df, x.p.term[1:]))
    for c in conditions:
        df = df.where(c)
    out = df.select(*[v.col.alias(n) for n, v in bound.items()]) if bound else df.select(F.lit(1).alias("__unit"))
    return Solutions(out, {n: v.kind for n, v in bound.items()}, frozenset(bound))


def _is_constant(v: Val, term: str, df: DataFrame) -> Column:
    """A mapped value equals a constant; for keys a comparison with the key column, which can be pushed down."""
    if v.kind.startswith("key:"):
        key = term[1:].removeprefix(v.kind[4:])
        return v.col == F.lit(int(key)) if term.startswith("I" + v.kind[4:]) and key.isdigit() else F.lit(False)
    return v.col == F.lit(term[1:]) if v.kind == "iri" else t.equal(v, B.constant(term))


def _triple(x: A.Triple, ctx: Context) -> Solutions:
    df = ctx.active(x.p.term[1:] if isinstance(x.p, A.Const) else None)
    names: dict[str, str] = {}
    places = [("s", x.s), ("p", x.p), ("o", x.o)]
    if isinstance(ctx.graph, A.Var):
        places.append(("g", ctx.graph))
    for column, part in places:
        if isinstance(part, A.Const):
            if column == "o" and ctx.types_of is not None and isinstance(x.p, A.Const) and x.p.term == t.iri(TYPE):
                df = df.where(F.col("o").isin(ctx.types_of(part.term)))
            else:
                df = df.where(F.col(column) == F.lit(part.term))
        elif part.name in names:
            df = df.where(F.col(column) == F.col(names[part.name]))
        else:
            names[part.name] = column
    if ctx.types_of is not None and isinstance(x.p, A.Const) and x.p.term == t.iri(TYPE):
        df = df.select("s", "p", F.lit(x.o.term).alias("o") if isinstance(x.o, A.Const) else F.col("o"), "g").distinct()
    out = df.select(*[F.col(c).alias(n) for n, c in names.items()]) if names else df.select(F.lit(1).alias("__unit"))
    return Solutions(out, {n: "term" for n in names}, frozenset(names))


def _path(node: A.Path, ctx: Context, seeds: DataFrame | None = None) -> Solutions:
    """The ends of a path; seeds (column src) are nodes of the graph that its subject is joined with."""
    if isinstance(node.path, A.Seq):
        middle = [A.Var(f"__m{next(ctx.counter)}") for _ in node.path.parts[1:]]
        ends, out = [node.s, *middle, node.o], None
        for part, a, b in zip(node.path.parts, ends, ends[1:]):
            one = compile_pattern(A.Bgp((A.Triple(a, A.Const(t.iri(part.iri)), b),)) if isinstance(part, A.Link) else A.Path(a, part, b), ctx)
            out = one if out is None else _join_solutions(out, one)
        hidden = {m.name for m in middle}
        return _only(out, [n for n in out.kinds if n not in hidden])
    if isinstance(node.path, A.Alt):
        parts = [compile_pattern(A.Bgp((A.Triple(node.s, A.Const(t.iri(p.iri)), node.o),)) if isinstance(p, A.Link) else A.Path(node.s, p, node.o), ctx) for p in node.path.parts]
        out = parts[0]
        for p in parts[1:]:
            out = _union_solutions(out, p)
        return out
    if isinstance(node.path, A.Inverse):
        inner = node.path.path
        return compile_pattern(A.Bgp((A.Triple(node.o, A.Const(t.iri(inner.iri)), node.s),)) if isinstance(inner, A.Link) else A.Path(node.o, inner, node.s), ctx)
    pairs = paths.pairs(node.path, ctx, node.s.term if isinstance(node.s, A.Const) else None, node.o.term if isinstance(node.o, A.Const) else None, seeds)
    names: dict[str, str] = {}
    places = [("src", node.s), ("dst", node.o)]
    for column, part in places:
        if isinstance(part, A.Const):
            pairs = pairs.where(F.col(column) == F.lit(part.term))
        elif part.name in names:
            pairs = pairs.where(F.col(column) == F.col(names[part.name]))
        else:
            names[part.name] = column
    out = pairs.select(*[F.col(c).alias(n) for n, c in names.items()]) if names else pairs.select(F.lit(1).alias("__unit"))
    return Solutions(out, {n: "term" for n in names}, frozenset(names))


# joins
def _aligned(left: Solutions, right: Solutions, names: list[str]) -> tuple[Solutions, Solutions]:
    """Both sides with the named variables in one kind each."""
    sides = []
    for side, other in ((left, right), (right, left)):
        df, kinds = side.df, dict(side.kinds)
        for n in names:
            if side.kinds[n] != other.kinds[n]:
                a, _ = B.unify([side.val(n), other.val(n)])
                df, kinds[n] = df.withColumn(n, a.col), a.kind
        sides.append(Solutions(df, kinds, side.certain))
    return sides[0], sides[1]


def _renamed(side: Solutions, names: list[str], mark: str) -> DataFrame:
    return side.df.drop("__unit").withColumnsRenamed({n: mark + n for n in names})


def _merged(df: DataFrame, left: Solutions, right: Solutions, shared: list[str], mark: str) -> Solutions:
    columns = [F.coalesce(F.col(f"`{n}`"), F.col(f"`{mark}{n}`")).alias(n) if n in shared and n not in left.certain else F.col(f"`{n}`") for n in left.kinds]
    columns += [F.col(f"`{n}`") for n in right.kinds if n not in left.kinds]
    out = df.select(*columns) if columns else df.select(F.lit(1).alias("__unit"))
    return Solutions(out, {**right.kinds, **left.kinds}, left.certain | right.certain)


def _join_solutions(left: Solutions, right: Solutions) -> Solutions:
    """Compatible mappings. Variables that may be unbound are split by whether they are, so that every part is an equi-join."""
    shared = [n for n in left.kinds if n in right.kinds]
    left, right = _aligned(left, right, shared)
    loose = [n for n in shared if n not in left.certain or n not in right.certain]
    if loose:
        n = loose[0]
        out = None
        for l_bound, r_bound in ((True, True), (True, False), (False, True), (False, False)):
            if (not l_bound and n in left.certain) or (not r_bound and n in right.certain):
                continue
            parts = []
            for side, bound in ((left, l_bound), (right, r_bound)):
                df = side.df if n in side.certain else side.df.where(F.col(f"`{n}`").isNotNull() if bound else F.col(f"`{n}`").isNull())
                kinds = side.kinds if bound else {k: v for k, v in side.kinds.items() if k != n}
                parts.append(Solutions(df if bound else df.drop(n), kinds, side.certain | {n} if bound else side.certain))
            for k, part in enumerate(parts):
                if not part.kinds:
                    parts[k] = Solutions(part.df.withColumn("__unit", F.lit(1)) if "__unit" not in part.df.columns else part.df, {}, part.certain)
            one = _join_solutions(*parts)
            out = one if out is None else _union_solutions(out, one)
        return Solutions(out.df, out.kinds, left.certain | right.certain)
    r = _renamed(right, shared, "__r_")
    l = left.df.drop("__unit") if left.kinds else left.df
    if not shared:
        return _merged(l.crossJoin(r if right.kinds else right.df.drop("__unit").select(F.lit(1).alias("__r_unit"))), left, right, [], "__r_")
    condition = None
    for n in shared:
        one = F.col(f"`{n}`") == F.col(f"`__r_{n}`")
        condition = one if condition is None else condition & one
    return _merged(l.join(r, condition), left, right, shared, "__r_")


def _by_bound(s: Solutions, names: list[str]) -> Iterator[tuple[Solutions, frozenset[str]]]:
    """The solutions parted by which of those variables are bound; each part has only the bound ones, and they are certain."""
    loose = [n for n in names if n not in s.certain]
    for mask in product((True, False), repeat=len(loose)):
        df, bound = s.df, frozenset(n for n in names if n in s.certain) | {n for n, yes in zip(loose, mask) if yes}
        for n, yes in zip(loose, mask):
            df = df.where(F.col(f"`{n}`").isNotNull() if yes else F.col(f"`{n}`").isNull())
        kinds = {n: k for n, k in s.kinds.items() if n not in loose or n in bound}
        df = df.drop(*[n for n in loose if n not in bound])
        if not kinds and "__unit" not in df.columns:
            df = df.withColumn("__unit", F.lit(1))
        yield Solutions(df, kinds, s.certain | bound), bound


def _equal(names: Iterable[str], mark: str) -> Column:
    out = F.lit(True)
    for n in sorted(names):
        out = out & (F.col(f"`{n}`") == F.col(f"`{mark}{n}`"))
    return out


def _join(node: A.Join, ctx: Context) -> Solutions:
    path = node.right
    if isinstance(node.left, A.Bgp) and isinstance(path, A.Path) and isinstance(path.path, A.Closure) and isinstance(path.s, A.Var) and not isinstance(path.o, A.Const) and not isinstance(ctx.graph, A.Var):
        # nodes that a pattern on the same graph binds: the closure starts from them alone
        left = compile_pattern(node.left, ctx)
        if left.kinds.get(path.s.name) == "term" and any(path.s in (x.s, x.o) for x in node.left.triples):
            return _join_solutions(left, _path(path, ctx, left.df.select(F.col(f"`{path.s.name}`").alias("src")).distinct()))
        return _join_solutions(left, compile_pattern(path, ctx))
    return _join_solutions(compile_pattern(node.left, ctx), compile_pattern(node.right, ctx))


def _left_join(node: A.LeftJoin, ctx: Context) -> Solutions:
    """OPTIONAL. Rows are parted by which shared variables the left side binds, so that every part is an equi-join; where the
    right side may leave one unbound, a row can match in several parts, and the rows without a match come back at the end."""
    left, right = compile_pattern(node.left, ctx), compile_pattern(node.right, ctx)
    shared = [n for n in left.kinds if n in right.kinds]
    left, right = _aligned(left, right, shared)
    if node.condition is not None and _has_exists(node.condition) or any(n not in right.certain for n in shared):
        return _left_join_by_rows(node, left, right, shared, ctx)
    parts = [_left_join_part(node, part, right, ctx) for part, _ in _by_bound(left, shared)]
    out = reduce(_union_solutions, parts)
    return Solutions(out.df, out.kinds, left.certain)


def _left_join_part(node: A.LeftJoin, left: Solutions, right: Solutions, ctx: Context) -> Solutions:
    """OPTIONAL of sides that bind all variables that they share."""
    shared = [n for n in left.kinds if n in right.kinds]
    r = _renamed(right, shared, "__r_").withColumn("__hit", F.lit(True))
    condition = _equal(shared, "__r_")
    if node.condition is not None:

        def lookup(name: str) -> Val | None:
            if name in left.kinds:
                return left.val(name)
            return right.val(name) if name in right.kinds else None

        condition = condition & F.coalesce(t.boolean(evaluate(node.condition, lookup, ctx)), F.lit(False))
    l = left.df if not left.kinds else left.df.drop("__unit")
    return _merged(l.join(r, condition, "left"), left, right, shared, "__r_")


def _left_join_by_rows(node: A.LeftJoin, left: Solutions, right: Solutions, shared: list[str], ctx: Context) -> Solutions:
    """OPTIONAL by numbered rows: they are joined and filtered, and those without a match come back."""
    from ..shared import settle

    numbered = Solutions(settle(left.df.withColumn("__n", F.monotonically_increasing_id())), {**left.kinds, "__n": "int"}, left.certain | {"__n"})
    hits = _join_solutions(numbered, right)
    if node.condition is not None:
        hits = _filtered(hits, node.condition, ctx)
    rest = numbered.df.join(hits.df.select("__n").distinct(), "__n", "left_anti")
    out = _union_solutions(hits, Solutions(rest, numbered.kinds, numbered.certain))
    return Solutions(_only(out, [n for n in out.kinds if n != "__n"]).df, {n: k for n, k in out.kinds.items() if n != "__n"}, left.certain)


def _union_solutions(left: Solutions, right: Solutions) -> Solutions:
    left, right = _aligned(left, right, [n for n in left.kinds if n in right.kinds])
    kinds = {**left.kinds, **right.kinds}
    if not kinds:
        return Solutions(left.df.select(F.lit(1).alias("__unit")).unionAll(right.df.select(F.lit(1).alias("__unit"))), {}, frozenset())
    types = {f.name: f.dataType for s in (right, left) for f in s.df.schema.fields}
    sides = [s.df.select(*[F.col(f"`{n}`") if n in s.kinds else F.lit(None).cast(types[n]).alias(n) for n in kinds]) for s in (left, right)]
    return Solutions(sides[0].unionByName(sides[1]), kinds, left.certain & right.certain)


def _union(node: A.Union, ctx: Context) -> Solutions:
    return _union_solutions(compile_pattern(node.left, ctx), compile_pattern(node.right, ctx))


def _minus(node: A.Minus, ctx: Context) -> Solutions:
    left, right = compile_pattern(node.left, ctx), compile_pattern(node.right, ctx)
    shared = [n for n in left.kinds if n in right.kinds]
    if not shared:
        return left
    left, right = _aligned(left, right, shared)
    parts, others = [], list(_by_bound(_only(right, shared), shared))
    for part, bound in _by_bound(left, shared):
        df = part.df
        for other, of_other in others:
            if on := bound & of_other:
                df = df.join(other.df.select(*[F.col(f"`{n}`").alias(f"__r_{n}") for n in sorted(on)]), _equal(on, "__r_"), "left_anti")
        parts.append(Solutions(df, part.kinds, part.certain))
    out = reduce(_union_solutions, parts)
    return Solutions(out.df, out.kinds, left.certain)


# expressions
def _has_exists(e) -> bool:
    return isinstance(e, A.Exists) or isinstance(e, A.Call) and any(map(_has_exists, e.args))


def evaluate(e, lookup: Callable[[str], Val | None], ctx: Context) -> Val:
    """An expression as a value over the columns that lookup gives for variables."""
    if isinstance(e, A.Var):
        return t.as_iri(lookup(e.name) or B.null("term"))
    if isinstance(e, A.Const):
        return B.constant(e.term)
    if e.name == "BOUND":
        v = lookup(e.args[0].name)
        return Val("bool", F.lit(False) if v is None else v.col.isNotNull())
    if e.name == "in":
        x, out = evaluate(e.args[0], lookup, ctx), F.lit(False)
        for a in e.args[1:]:
            out = out | t.equal(x, evaluate(a, lookup, ctx))
        return Val("bool", out)
    if e.name == "NOW":
        return Val("time", F.lit(ctx.now).cast("timestamp_ntz"))
    if e.name == "BNODE":
        key = F.uuid() if not e.args else t.string(evaluate(e.args[0], lookup, ctx))
        return Val("term", F.concat(F.lit("Bf"), key if not e.args else F.concat(F.monotonically_increasing_id().cast("string"), F.lit("_"), key)))
    args = [evaluate(a, lookup, ctx) for a in e.args]
    if e.name in ("IRI", "URI"):
        return B._iri(args[0], ctx.base)
    function = B.BUILTINS.get(e.name) or ctx.registry.functions.get(e.name)
    if function is None:
        raise ValueError(f"no such function: {e.name}")
    return function(*args)


def _marked(s: Solutions, e, ctx: Context) -> tuple[Solutions, object]:
    """EXISTS inside an expression as boolean columns: rows are numbered and marked by a join, never looped over."""
    from ..shared import settle

    found: list = []

    def swap(x):
        if isinstance(x, A.Exists):
            name = f"__e{next(ctx.counter)}"
            found.append((name, x))
            return A.Var(name)
        return A.Call(x.name, tuple(map(swap, x.args)), x.distinct, x.separator) if isinstance(x, A.Call) else x

    e = swap(e)
    s = Solutions(settle(s.df.withColumn("__row", F.monotonically_increasing_id())), {**s.kinds, "__row": "int"}, s.certain | {"__row"})
    for name, x in found:
        hits = semi(s, x.pattern, ctx).df.select("__row").distinct().withColumn(name, F.lit(True))
        df = s.df.join(hits, "__row", "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)) != F.lit(x.negated))
        s = Solutions(df, {**s.kinds, name: "bool"}, s.certain | {name})
    return s, e


def semi(s: Solutions, pattern, ctx: Context, how: str = "left_semi") -> Solutions:
    """The rows for which the pattern has (or, left_anti, hasn't) a compatible solution; filters in it see the row's variables."""
    conditions = []
    while isinstance(pattern, A.Filter):
        if _has_exists(pattern.condition):
            break
        conditions.append(pattern.condition)
        pattern = pattern.input
    right = compile_pattern(pattern, ctx)
    shared = [n for n in s.kinds if n in right.kinds]
    left, right = _aligned(s, right, shared)
    others = list(_by_bound(right, shared))
    if how == "left_semi" and len(others) > 1:
        # a row may match in several parts of the right side, so what matches in none of them is taken away by number
        from ..shared import settle

        numbered = Solutions(settle(left.df.withColumn("__n", F.monotonically_increasing_id())), {**left.kinds, "__n": "int"}, left.certain | {"__n"})
        rest = _semi_parts(numbered, others, shared, conditions, ctx, "left_anti")
        return Solutions(numbered.df.join(rest.df.select("__n"), "__n", "left_anti").drop("__n"), left.kinds, left.certain)
    return _semi_parts(left, others, shared, conditions, ctx, how)


def _semi_parts(left: Solutions, others: list[tuple[Solutions, frozenset[str]]], shared: list[str], conditions: list, ctx: Context, how: str) -> Solutions:
    """The rows of each part of the left side with (in none) a match in the parts of the right side."""
    parts = []
    for part, bound in _by_bound(left, shared):
        df = part.df
        for other, of_other in others:
            on = bound & of_other
            r = _renamed(other, sorted(of_other & set(part.kinds)), "__r_").withColumn("__hit", F.lit(True))
            condition = _equal(on, "__r_")

            def lookup(name: str) -> Val | None:
                return part.val(name) if name in part.kinds else other.val(name) if name in other.kinds else None

            for c in conditions:
                condition = condition & F.coalesce(t.boolean(evaluate(c, lookup, ctx)), F.lit(False))
            df = df.join(r, condition, how)
        parts.append(Solutions(df, part.kinds, part.certain))
    out = reduce(_union_solutions, parts)
    return Solutions(out.df, left.kinds, left.certain)


def _filtered(s: Solutions, condition, ctx: Context) -> Solutions:
    if isinstance(condition, A.Call) and condition.name == "and":
        return _filtered(_filtered(s, condition.args[0], ctx), condition.args[1], ctx)
    if isinstance(condition, A.Exists):
        return semi(s, condition.pattern, ctx, "left_anti" if condition.negated else "left_semi")
    if _has_exists(condition):
        marked, e = _marked(s, condition, ctx)
        out = marked.df.where(t.boolean(evaluate(e, lambda n: marked.val(n) if n in marked.kinds else None, ctx)))
        return Solutions(out.select(*[F.col(f"`{n}`") for n in s.kinds]) if s.kinds else out, s.kinds, s.certain)
    return Solutions(s.df.where(t.boolean(evaluate(condition, lambda n: s.val(n) if n in s.kinds else None, ctx))), s.kinds, s.certain)


def _filter(node: A.Filter, ctx: Context) -> Solutions:
    return _filtered(compile_pattern(node.input, ctx), node.condition, ctx)


def _extend(node: A.Extend, ctx: Context) -> Solutions:
    s, e, before = compile_pattern(node.input, ctx), node.expression, None
    if _has_exists(e):
        before = list(s.kinds)
        s, e = _marked(s, e, ctx)
    v = evaluate(e, lambda n: s.val(n) if n in s.kinds else None, ctx)
    if v.lang is not None:
        v = Val("term", t.to_term(v))
    sure = node.certain or isinstance(e, A.Const) or isinstance(e, A.Var) and e.name in s.certain
    out = Solutions(s.df.withColumn(node.var, v.col), {**s.kinds, node.var: v.kind}, s.certain | {node.var} if sure else s.certain)
    return out if before is None else _only(out, [*before, node.var])


def _has_path(n) -> bool:
    return isinstance(n, A.Path) or any(_has_path(getattr(n, f)) for f in ("input", "left", "right") if hasattr(n, f))


def _graph(node: A.Graph, ctx: Context) -> Solutions:
    if isinstance(node.graph, A.Var) and _has_path(node.input):
        # a path stays in one graph: one plan for each name in the graph directory, which is read on the driver
        names = [r["g"] for r in replace(ctx, graph=node.graph).active().select("g").distinct().collect()]
        out = None
        for name in names:
            one = compile_pattern(node.input, replace(ctx, graph=A.Const(name)))
            if node.graph.name in one.kinds:
                one = Solutions(one.df.where(t.to_term(one.val(node.graph.name)) == F.lit(name)), one.kinds, one.certain)
            else:
                one = Solutions(one.df.withColumn(node.graph.name, F.lit(name)), {**one.kinds, node.graph.name: "term"}, one.certain | {node.graph.name})
            out = one if out is None else _union_solutions(out, one)
        return out if out is not None else Solutions(one_row(ctx).where(F.lit(False)).withColumn(node.graph.name, F.lit(None).cast("string")), {node.graph.name: "term"}, frozenset({node.graph.name}))
    inner = compile_pattern(node.input, replace(ctx, graph=node.graph))
    if isinstance(node.graph, A.Var) and node.graph.name not in inner.kinds:
        graphs = replace(ctx, graph=node.graph).active().select(F.col("g").alias(node.graph.name)).distinct()
        return _join_solutions(inner, Solutions(graphs, {node.graph.name: "term"}, frozenset({node.graph.name})))
    return inner


def _service(node: A.Service, ctx: Context) -> Solutions:
    try:
        endpoint = node.endpoint.term[1:]
        name, _, parameters = endpoint.partition("?")
        if name not in ctx.services:
            raise ValueError(f"no service {name}")
        options = dict(p.split("=", 1) for p in parameters.split("&") if "=" in p)
        df = ctx.services[name](ctx, node.input, **options)
    except Exception:
        if node.silent:
            return _unit(A.Unit(), ctx)
        raise
    return Solutions(df, {f.name: t.native(f.dataType.simpleString()) if f.dataType.simpleString() != "string" else "term" for f in df.schema.fields}, frozenset())


def _table(node: A.Table, ctx: Context) -> Solutions:
    kinds, columns = {}, {}
    for k, n in enumerate(node.names):
        vals = [B.constant(r[k]) for r in node.rows if r[k] is not None]
        kinds[n] = vals[0].kind if vals and len({v.kind for v in vals}) == 1 else "term"
        if kinds[n] not in ("int", "str", "iri", "term", "dbl", "bool"):
            kinds[n] = "term"
        columns[n] = k

    def cell(term: str | None, kind: str):
        if term is None or kind == "term":
            return term
        _, lex, _, _ = t.parse_term(term)
        return {"int": int, "dbl": float, "bool": lambda x: x in ("true", "1")}.get(kind, str)(lex)

    if not node.names:
        return Solutions(ctx.spark.range(len(node.rows)).select(F.lit(1).alias("__unit")), {}, frozenset())
    rows = [tuple(cell(r[k], kinds[n]) for n, k in columns.items()) for r in node.rows]
    schema = ", ".join(f"`{n}` {B._NULL[kinds[n]]}" for n in node.names)
    return Solutions(ctx.spark.createDataFrame(rows, schema), kinds, frozenset(n for n, k in columns.items() if all(r[k] is not None for r in node.rows)))


def _group(node: A.Group, ctx: Context) -> Solutions:
    s = compile_pattern(node.input, ctx)
    for name, e in node.keys:
        if e is not None:
            v = evaluate(e, lambda n: s.val(n) if n in s.kinds else None, ctx)
            s = Solutions(s.df.withColumn(name, v.col), {**s.kinds, name: v.kind}, s.certain)
    names = [n for n, _ in node.keys]
    for n in names:
        if n not in s.kinds:
            s = Solutions(s.df.withColumn(n, F.lit(None).cast("string")), {**s.kinds, n: "term"}, s.certain)
    columns, kinds = [], {n: s.kinds[n] for n in names}
    for name, call in node.aggregates:
        function = call.name.removeprefix("agg:")
        args = [evaluate(a, lambda n: s.val(n) if n in s.kinds else None, ctx) for a in call.args]
        if function in ctx.registry.aggregates:
            v = ctx.registry.aggregates[function](*args, distinct=call.distinct)
        elif function == "COUNT" and not args and call.distinct:
            v = Val("int", F.count_distinct(F.struct(*[F.col(f"`{n}`") for n in s.kinds])) if s.kinds else F.count(F.lit(1)))
        else:
            v = B.aggregate(function, args[0] if args else None, call.distinct, call.separator)
        columns.append(v.col.alias(name))
        kinds[name] = v.kind
    df = s.df.groupBy(*[F.col(f"`{n}`") for n in names]).agg(*columns) if columns else s.df.select(*[F.col(f"`{n}`") for n in names]).distinct()
    return Solutions(df, kinds, (s.certain & frozenset(names)) | frozenset(n for n, c in node.aggregates if c.name == "agg:COUNT"))


def _order(node: A.OrderBy, ctx: Context) -> Solutions:
    s = compile_pattern(node.input, ctx)
    keys = []
    for e, up in node.keys:
        for c in t.sort_key(evaluate(e, lambda n: s.val(n) if n in s.kinds else None, ctx)):
            keys.append(c.asc_nulls_first() if up else c.desc_nulls_last())
    return Solutions(s.df.orderBy(*keys), s.kinds, s.certain)


def _only(s: Solutions, names: list[str]) -> Solutions:
    columns = [F.col(f"`{n}`") if n in s.kinds else F.lit(None).cast("string").alias(n) for n in names]
    return Solutions(s.df.select(*columns) if columns else s.df.select(F.lit(1).alias("__unit")), {n: s.kinds.get(n, "term") for n in names}, s.certain & frozenset(names))


def _project(node: A.Project, ctx: Context) -> Solutions:
    s = compile_pattern(node.input, ctx)
    return _only(s, list(node.names) if node.names is not None else [n for n in s.kinds if not n.startswith("__")])


def _distinct(node: A.Distinct, ctx: Context) -> Solutions:
    s = compile_pattern(node.input, ctx)
    return Solutions(s.df.distinct(), s.kinds, s.certain)


def _slice(node: A.Slice, ctx: Context) -> Solutions:
    s = compile_pattern(node.input, ctx)
    df = s.df.offset(node.offset) if node.offset else s.df
    return Solutions(df.limit(node.limit) if node.limit is not None else df, s.kinds, s.certain)


_COMPILERS = {
    A.Unit: _unit, A.Bgp: _bgp, A.Path: _path, A.Join: _join, A.LeftJoin: _left_join, A.Union: _union, A.Minus: _minus, A.Filter: _filter,
    A.Extend: _extend, A.Graph: _graph, A.Service: _service, A.Table: _table, A.Group: _group, A.OrderBy: _order, A.Project: _project,
    A.Distinct: _distinct, A.Reduced: lambda n, c: compile_pattern(n.input, c), A.Slice: _slice,
}
