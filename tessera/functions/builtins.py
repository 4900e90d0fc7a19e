"""SPARQL operators, built-in functions, casts and aggregates as column expressions. An expression error is null."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms as t
from .terms import NUMERIC, RDF, XSD, Val

_RANK = {"int": 0, "dec": 1, "flt": 2, "dbl": 3}
_ZONE = r"(Z|[+-]\d\d:\d\d)$"
_NULL = {"str": "string", "bool": "boolean", "int": "bigint", "dec": "decimal(38,12)", "dbl": "double", "iri": "string", "term": "string", "time": "timestamp_ntz"}


def null(kind: str) -> Val:
    return Val(kind, F.lit(None).cast(_NULL[kind]))


def constant(term: str) -> Val:
    """An encoded constant, as a native value where its kind has one."""
    kind, lex, dt, lang = t.parse_term(term)
    if kind == "I":
        return Val("iri", F.lit(lex))
    if kind != "L" or lang:
        return Val("term", F.lit(term))
    short = dt.removeprefix(XSD) if dt.startswith(XSD) else None
    try:
        if short in t.INTEGERS:
            return Val("int", F.lit(int(lex)))
        if short == "decimal":
            return Val("dec", F.lit(lex).cast("decimal(38,12)"))
        if short in ("double", "float"):
            return Val("dbl", F.lit(float(lex)))
    except ValueError:
        return Val("term", F.lit(term))
    if short == "boolean" and lex in ("true", "false", "1", "0"):
        return Val("bool", F.lit(lex in ("true", "1")))
    if short == "string":
        return Val("str", F.lit(lex))
    if short in ("dateTime", "date") and not re.search(_ZONE, lex):
        return Val("time" if short == "dateTime" else "date", F.lit(lex).try_cast("timestamp_ntz" if short == "dateTime" else "date"))
    return Val("term", F.lit(term))


def _numbers(a: Val, b: Val) -> tuple[str, Column, Column]:
    """The common kind of two numeric operands, values of encoded terms being doubles."""
    kinds = [v.kind if v.kind in NUMERIC else "dbl" for v in (a, b)]
    kind = max(kinds, key=_RANK.__getitem__)
    return kind, t.number(a), t.number(b)


def _arithmetic(name: str) -> Callable[..., Val]:
    function = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[name]

    def run(a: Val, b: Val) -> Val:
        kind, x, y = _numbers(a, b)
        if name == "/" and kind == "int":
            return Val("dec", F.try_divide(x.cast("decimal(38,12)"), y.cast("decimal(38,12)")))
        if name == "/" and kind in ("dbl", "flt"):
            x, y = x.cast("double"), y.cast("double")
            signed = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
            return Val("dbl", F.when(y == 0, signed).otherwise(F.try_divide(x, y)))
        if kind == "int":
            x, y = x.cast("bigint"), y.cast("bigint")
        return Val(kind, function(x, y))

    return run


def _same_shape(a: Val, col: Column) -> Val:
    """A string with the language of the argument it came from."""
    if a.kind == "term":
        return Val("term", t.make_literal(col, XSD + "string", t.lang_of(a)))
    return Val("str", col, a.lang)


def _strings(a: Val, b: Val) -> tuple[Column, Column]:
    """Two compatible string arguments, null if they are not (the second has another language)."""
    x, y = t.text(a), t.text(b)
    la, lb = t.lang_of(a), t.lang_of(b)
    if lb is not None:
        y = F.when((lb == "") | (lb == (la if la is not None else F.lit(""))), y)
    return x, y


def _round_like(a: Val, function: Callable[[Column], Column]) -> Val:
    if a.kind == "int":
        return a
    x = t.number(a)
    return Val("dbl" if a.kind in ("term", "dbl", "flt") else "dec", function(x).cast("double" if a.kind in ("term", "dbl", "flt") else "decimal(38,0)"))


def _before(a: Val, b: Val) -> Val:
    x, y = _strings(a, b)
    at = F.instr(x, y)
    return _same_shape(a, F.when(at > 0, F.substr(x, F.lit(1), at - 1)).when(x.isNotNull() & y.isNotNull(), F.lit("")))


def _after(a: Val, b: Val) -> Val:
    x, y = _strings(a, b)
    at = F.instr(x, y)
    return _same_shape(a, F.when(at > 0, F.substr(x, at + F.length(y))).when(x.isNotNull() & y.isNotNull(), F.lit("")))


def _substr(a: Val, start: Val, n: Val | None = None) -> Val:
    x, s = t.text(a), F.round(t.number(start)).cast("int")
    first = F.greatest(s, F.lit(1))
    if n is None:
        return _same_shape(a, F.substr(x, first))
    end = s + F.round(t.number(n)).cast("int")
    return _same_shape(a, F.substr(x, first, F.greatest(end - first, F.lit(0))))


def _flags(pattern: Val, flags: Val | None) -> Column:
    """The pattern with its XPath flags in Java's form; q quotes it."""
    p = t.text(pattern)
    if flags is None:
        return p
    f = t.text(flags)
    quoted = F.concat(F.lit("\\Q"), p, F.lit("\\E"))
    body = F.when(f.contains("q"), quoted).otherwise(p)
    letters = F.regexp_replace(f, "[^smix]", "")
    return F.when(letters == "", body).otherwise(F.concat(F.lit("(?"), letters, F.lit(")"), body))


def _regex(a: Val, pattern: Val, flags: Val | None = None) -> Val:
    return Val("bool", F.rlike(t.text(a), _flags(pattern, flags)))


def _replace(a: Val, pattern: Val, replacement: Val, flags: Val | None = None) -> Val:
    return _same_shape(a, F.regexp_replace(t.text(a), _flags(pattern, flags), t.text(replacement)))


def _encode_uri(a: Val) -> Val:
    out = F.url_encode(t.text(a))
    for x, y in (("\\+", "%20"), ("\\*", "%2A"), ("%7E", "~")):
        out = F.regexp_replace(out, x, y)
    return Val("str", out)


def _concat(*args: Val) -> Val:
    texts = [t.text(a) for a in args]
    if not texts:
        return Val("str", F.lit(""))
    if any(a.kind == "term" for a in args):
        tags = [t.lang_of(a) if t.lang_of(a) is not None else F.lit("") for a in args]
        same = F.lit(True)
        for x in tags[1:]:
            same = same & (x == tags[0])
        return Val("term", t.make_literal(F.concat(*texts), XSD + "string", F.when(same, tags[0]).otherwise(F.lit(""))))
    return Val("str", F.concat(*texts))


def _part(field_name: str, kind: str = "int") -> Callable[[Val], Val]:
    def run(a: Val) -> Val:
        at = t.instant(a)
        if field_name == "SECOND":
            return Val("dec", F.extract(F.lit("SECOND"), at).cast("decimal(38,6)"))
        return Val(kind, F.extract(F.lit(field_name), at).cast("bigint"))

    return run


def _tz(a: Val) -> Val:
    return Val("str", F.regexp_extract(t.string(a), _ZONE, 1) if a.kind == "term" else F.when(a.col.isNotNull(), F.lit("")))


def _timezone(a: Val) -> Val:
    z = _tz(a).col
    text = F.when(z == "Z", F.lit("PT0S")).when(
        z != "",
        F.concat(
            F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), F.substring(z, 2, 2).cast("int").cast("string"), F.lit("H"),
            F.when(F.substring(z, 5, 2) != "00", F.concat(F.substring(z, 5, 2).cast("int").cast("string"), F.lit("M"))).otherwise(""),
        ),
    )
    return Val("term", t.make_literal(text, XSD + "dayTimeDuration"))


def _lang(a: Val) -> Val:
    tag = t.lang_of(a)
    if tag is None:
        return null("str") if a.kind == "iri" else Val("str", F.when(a.col.isNotNull(), F.lit("")))
    return Val("str", F.when(t.to_term(a).startswith("L"), F.regexp_replace(tag, "--.*$", "")))


def _langdir(a: Val) -> Val:
    tag = t.lang_of(a)
    return Val("str", F.when(F.lit(tag is None), F.lit("")).otherwise(F.regexp_extract(tag if tag is not None else F.lit(""), "--(.*)$", 1)))


def _langmatches(a: Val, b: Val) -> Val:
    tag, want = F.lower(t.text(a)), F.lower(t.text(b))
    return Val("bool", F.when(want == "*", tag != "").otherwise((tag == want) | tag.startswith(F.concat(want, F.lit("-")))))


def _datatype(a: Val) -> Val:
    return Val("iri", t.datatype(t.to_term(a)))


def _kind(letter: str) -> Callable[[Val], Val]:
    def run(a: Val) -> Val:
        if a.kind != "term":
            is_it = letter == ("I" if a.kind == "iri" else "L")
            return Val("bool", F.when(a.col.isNotNull(), F.lit(is_it)))
        return Val("bool", a.col.startswith(letter))

    return run


def _is_numeric(a: Val) -> Val:
    if a.kind != "term":
        return Val("bool", F.when(a.col.isNotNull(), F.lit(a.kind in NUMERIC)))
    return Val("bool", F.when(a.col.isNotNull(), t.term_number(a.col).isNotNull()))


def _digest(function: Callable[[Column], Column]) -> Callable[[Val], Val]:
    return lambda a: Val("str", function(t.text(a)))


def _iri(a: Val, base: str = "") -> Val:
    x = t.string(a)
    if base:
        root = base.rsplit("/", 1)[0] + "/"
        x = F.when(x.rlike(r"^[A-Za-z][\w+.\-]*:"), x).when(x.startswith("/"), F.concat(F.lit("/".join(base.split("/")[:3])), x)).otherwise(F.concat(F.lit(root), x))
    return Val("iri", x)


def _strdt(a: Val, dt: Val) -> Val:
    return Val("term", t.make_literal(t.text(a), t.string(dt)))


def _strlang(a: Val, tag: Val, way: Val | None = None) -> Val:
    lang = t.text(tag) if way is None else F.concat(t.text(tag), F.lit("--"), t.text(way))
    return Val("term", t.make_literal(t.text(a), XSD + "string", lang))


def _same_term(a: Val, b: Val) -> Val:
    if a.kind == b.kind and a.kind != "term" and a.lang is None and b.lang is None:
        return Val("bool", a.col == b.col)
    return Val("bool", t.to_term(a) == t.to_term(b))


def _same_value(a: Val, b: Val) -> Val:
    return Val("bool", F.coalesce(t.equal(a, b), t.to_term(a) == t.to_term(b)))


def _component(k: int) -> Callable[[Val], Val]:
    return lambda a: Val("term", F.when(t.to_term(a).startswith("T"), F.get(F.split(F.substring(t.to_term(a), 2, 1 << 30), "\x02", 3), F.lit(k))))


def _triple(s: Val, p: Val, o: Val) -> Val:
    return Val("term", F.concat(F.lit("T"), F.concat_ws("\x02", t.to_term(s), t.to_term(p), t.to_term(o))))


def unify(values: list[Val]) -> list[Val]:
    """The same values in one kind."""
    kinds = {v.kind for v in values}
    if len(kinds) == 1 and all(v.lang is None for v in values):
        return values
    if kinds <= set(NUMERIC):
        kind = max(kinds, key=_RANK.__getitem__)
        kind = "dbl" if kind == "flt" else kind
        to = {"int": "bigint", "dec": "decimal(38,12)", "dbl": "double"}[kind]
        return [Val(kind, v.col.cast(to)) for v in values]
    return [Val("term", t.to_term(v)) for v in values]


def _if(c: Val, a: Val, b: Val) -> Val:
    a, b = unify([a, b])
    test = t.boolean(c)
    return Val(a.kind, F.when(test, a.col).when(~test, b.col))


def _coalesce(*args: Val) -> Val:
    same = unify(list(args))
    return Val(same[0].kind, F.coalesce(*[v.col for v in same]))


def _cast(kind: str) -> Callable[[Val], Val]:
    def run(a: Val) -> Val:
        text = t.string(a)
        if kind == "bool":
            n = t.number(a).cast("double")
            return Val("bool", a.col if a.kind == "bool" else F.when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False)))
        if kind == "int":
            n = t.number(a).cast("double")
            whole = F.when(F.abs(n) < 9.2e18, F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("bigint"))
            if a.kind == "bool":
                return Val("int", a.col.cast("bigint"))
            exact = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
            return Val("int", a.col.cast("bigint") if a.kind == "int" else whole if a.kind in NUMERIC else F.coalesce(exact, whole))
        if kind == "dec":
            if a.kind in ("int", "dec", "dbl", "flt", "bool"):
                return Val("dec", (a.col.cast("int") if a.kind == "bool" else a.col).try_cast("decimal(38,12)"))
            return Val("dec", F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$") | t.number(a).isNotNull(), text.try_cast("decimal(38,12)")))
        if kind in ("dbl", "flt"):
            if a.kind == "bool":
                return Val("dbl", a.col.cast("int").cast("double"))
            return Val("dbl", a.col.cast("double") if a.kind in NUMERIC else F.when(~text.rlike(r"[dDfF]$|^\s|\s$"), text.try_cast("double")))
        if kind == "time":
            return Val("time", F.coalesce(t.instant(a), F.when(text.rlike(r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d"), text.try_cast("timestamp_ntz"))))
        return Val("str", text)

    return run


CASTS = {XSD + n: _cast(k) for n, k in (("boolean", "bool"), ("integer", "int"), ("decimal", "dec"), ("double", "dbl"), ("float", "flt"), ("dateTime", "time"), ("string", "str"))}

BUILTINS: dict[str, Callable[..., Val]] = {
    "+": _arithmetic("+"), "-": _arithmetic("-"), "*": _arithmetic("*"), "/": _arithmetic("/"),
    "neg": lambda a: Val(a.kind if a.kind in NUMERIC else "dbl", -t.number(a)),
    "=": lambda a, b: Val("bool", t.equal(a, b)), "!=": lambda a, b: Val("bool", ~t.equal(a, b)),
    "<": lambda a, b: Val("bool", t.less(a, b, False)), "<=": lambda a, b: Val("bool", t.less(a, b, True)),
    ">": lambda a, b: Val("bool", t.less(b, a, False)), ">=": lambda a, b: Val("bool", t.less(b, a, True)),
    "and": lambda a, b: Val("bool", t.boolean(a) & t.boolean(b)), "or": lambda a, b: Val("bool", t.boolean(a) | t.boolean(b)),
    "not": lambda a: Val("bool", ~t.boolean(a)),
    "STR": lambda a: Val("str", t.string(a)), "LANG": _lang, "LANGDIR": _langdir, "LANGMATCHES": _langmatches, "DATATYPE": _datatype,
    "IRI": _iri, "URI": _iri, "RAND": lambda: Val("dbl", F.rand()),
    "ABS": lambda a: Val(a.kind if a.kind in NUMERIC else "dbl", F.abs(t.number(a))),
    "CEIL": lambda a: _round_like(a, F.ceil), "FLOOR": lambda a: _round_like(a, F.floor),
    "ROUND": lambda a: _round_like(a, lambda x: F.floor(x + F.lit(0.5).cast("double" if a.kind in ("term", "dbl", "flt") else "decimal(2,1)"))),
    "CONCAT": _concat, "STRLEN": lambda a: Val("int", F.char_length(t.text(a)).cast("bigint")),
    "UCASE": lambda a: _same_shape(a, F.upper(t.text(a))), "LCASE": lambda a: _same_shape(a, F.lower(t.text(a))),
    "ENCODE_FOR_URI": _encode_uri,
    "CONTAINS": lambda a, b: Val("bool", F.contains(*_strings(a, b))), "STRSTARTS": lambda a, b: Val("bool", F.startswith(*_strings(a, b))),
    "STRENDS": lambda a, b: Val("bool", F.endswith(*_strings(a, b))), "STRBEFORE": _before, "STRAFTER": _after,
    "YEAR": _part("YEAR"), "MONTH": _part("MONTH"), "DAY": _part("DAY"), "HOURS": _part("HOUR"), "MINUTES": _part("MINUTE"), "SECONDS": _part("SECOND"),
    "TIMEZONE": _timezone, "TZ": _tz, "UUID": lambda: Val("iri", F.concat(F.lit("urn:uuid:"), F.uuid())), "STRUUID": lambda: Val("str", F.uuid()),
    "MD5": _digest(F.md5), "SHA1": _digest(F.sha1), "SHA256": _digest(lambda x: F.sha2(x, 256)), "SHA384": _digest(lambda x: F.sha2(x, 384)), "SHA512": _digest(lambda x: F.sha2(x, 512)),
    "STRLANG": _strlang, "STRLANGDIR": _strlang, "STRDT": _strdt, "SAMETERM": _same_term, "SAMEVALUE": _same_value,
    "ISIRI": _kind("I"), "ISURI": _kind("I"), "ISBLANK": _kind("B"), "ISLITERAL": _kind("L"), "ISTRIPLE": _kind("T"), "ISNUMERIC": _is_numeric,
    "HASLANG": lambda a: Val("bool", _lang(a).col != ""), "HASLANGDIR": lambda a: Val("bool", _langdir(a).col != ""),
    "SUBSTR": _substr, "REPLACE": _replace, "REGEX": _regex, "TRIPLE": _triple, "SUBJECT": _component(0), "PREDICATE": _component(1), "OBJECT": _component(2),
    "IF": _if, "COALESCE": _coalesce, **CASTS,
}


@dataclass
class Registry:
    """Functions and aggregates by IRI. A function takes and gives values; an aggregate gives a Column over a group."""

    functions: dict[str, Callable[..., Val]] = field(default_factory=dict)
    aggregates: dict[str, Callable[..., Val]] = field(default_factory=dict)

    def add(self, iri: str, function: Callable[..., Val], aggregate: bool = False) -> "Registry":
        if not iri or iri in CASTS or iri.startswith((XSD, RDF)):
            raise ValueError(f"{iri!r} cannot be registered")
        if iri in self.functions or iri in self.aggregates:
            raise ValueError(f"{iri} is registered already")
        (self.aggregates if aggregate else self.functions)[iri] = function
        return self


def aggregate(name: str, arg: Val | None, distinct: bool, separator: str | None) -> Val:
    """A set function over a group. SUM and AVG are unbound if a bound value isn't a number, or the argument has an error."""
    if name == "COUNT":
        if arg is None:
            return Val("int", F.count(F.lit(1)))
        return Val("int", F.count_distinct(arg.col) if distinct else F.count(arg.col))
    if name in ("SUM", "AVG"):
        n = t.number(arg)
        bad = F.count_if(n.isNull())
        if arg.kind in ("int",):
            n = n.cast("decimal(38,0)") if name == "AVG" else n
        total = (F.sum_distinct(n) if distinct else F.sum(n)) if name == "SUM" else (F.avg(n) if not distinct else F.try_divide(F.sum_distinct(n), F.count_distinct(n)))
        kind = arg.kind if arg.kind in NUMERIC else "dbl"
        if kind == "int" and name == "AVG":
            kind = "dec"
        zero = F.lit(0)
        return Val(kind, F.when(bad == 0, F.coalesce(total, zero.cast("double") if kind == "dbl" else zero)))
    if name in ("MIN", "MAX"):
        if arg.kind != "term":
            return Val(arg.kind, F.min(arg.col) if name == "MIN" else F.max(arg.col), arg.lang)
        key = F.struct(*t.sort_key(arg))
        return Val("term", F.min_by(arg.col, F.when(arg.col.isNotNull(), key)) if name == "MIN" else F.max_by(arg.col, F.when(arg.col.isNotNull(), key)))
    if name == "SAMPLE":
        return Val(arg.kind, F.any_value(arg.col, F.lit(True)))
    text = t.string(arg)
    items = F.collect_set(text) if distinct else F.collect_list(text)
    joined = F.array_join(F.array_sort(items), " " if separator is None else separator)
    return Val("str", F.when(F.count_if(text.isNull()) == 0, joined))
