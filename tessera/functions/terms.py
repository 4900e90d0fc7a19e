"""RDF terms as columns.

A term of unknown kind is one string: its first letter tells the kind (I an IRI, B a blank node, L a literal, T a triple
term). A literal goes on with its datatype, language (with direction, as in ``ar--rtl``) and lexical form, parted by
U+0001. So term identity is string equality, joins need one plain key, and no dictionary is needed. Where the kind is
known when a query is compiled (columns of mapped tables, results of functions), values stay native columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\x01"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
# fixed values: the datatypes derived from xsd:integer, and the other numeric ones
INTEGERS = [
    "integer", "nonPositiveInteger", "negativeInteger", "long", "int", "short", "byte", "nonNegativeInteger", "unsignedLong",
    "unsignedInt", "unsignedShort", "unsignedByte", "positiveInteger",
]
NUMERICS = [*INTEGERS, "decimal", "float", "double"]

#: Kinds of values: native ones, and `term` for encoded terms.
NUMERIC = ("int", "dec", "flt", "dbl")
DATATYPES = {"int": "integer", "dec": "decimal", "flt": "float", "dbl": "double", "bool": "boolean", "str": "string", "time": "dateTime", "date": "date"}


@dataclass(frozen=True)
class Val:
    """A compiled expression: its kind and its column; lang is the column of a string's language tag, if it may have one."""

    kind: str
    col: Column
    lang: Column | None = None


def as_iri(v: Val) -> Val:
    """A mapped table's key (kind ``key:`` and the IRI's prefix, held as the key column so that joins are on it) as its IRI."""
    return Val("iri", F.concat(F.lit(v.kind[4:]), v.col.cast("string"))) if v.kind.startswith("key:") else v


def iri(text: str) -> str:
    return "I" + text


def literal(lexical: str, datatype: str = XSD + "string", lang: str = "") -> str:
    return f"L{RDF + ('dirLangString' if '--' in lang else 'langString') if lang else datatype}{SEP}{lang}{SEP}{lexical}"


def triple(s: str, p: str, o: str) -> str:
    return "T" + "\x02".join((s, p, o))


def parse_term(text: str) -> tuple[str, str, str, str]:
    """(kind, lexical form, datatype, language) of an encoded term."""
    if text[0] == "L":
        datatype, lang, lexical = text[1:].split(SEP, 2)
        return "L", lexical, datatype, lang
    return text[0], text[1:], "", ""


def lexical(term: Column) -> Column:
    return F.when(term.startswith("L"), F.get(F.split(term, SEP, 3), F.lit(2))).otherwise(F.substring(term, 2, 1 << 30))


def datatype(term: Column) -> Column:
    return F.when(term.startswith("L"), F.substring(F.get(F.split(term, SEP, 3), F.lit(0)), 2, 1 << 30))


def language(term: Column) -> Column:
    return F.when(term.startswith("L"), F.get(F.split(term, SEP, 3), F.lit(1)))


def make_literal(lex: Column, dt: str | Column, lang: Column | None = None) -> Column:
    dt = F.lit(dt) if isinstance(dt, str) else dt
    if lang is None:
        return F.concat(F.lit("L"), dt, F.lit(SEP + SEP), lex)
    tagged = F.when(lang.contains("--"), F.lit(RDF + "dirLangString")).when(lang != "", F.lit(RDF + "langString")).otherwise(dt)
    return F.concat(F.lit("L"), tagged, F.lit(SEP), lang, F.lit(SEP), lex)


def to_term(v: Val) -> Column:
    """Any value as an encoded term."""
    if v.kind == "term":
        return v.col
    if v.kind == "iri" or v.kind.startswith("key:"):
        return F.concat(F.lit("I"), as_iri(v).col)
    if v.kind == "str":
        return make_literal(v.col, XSD + "string", v.lang)
    if v.kind == "bool":
        return make_literal(v.col.cast("string"), XSD + "boolean")
    if v.kind == "time":
        return make_literal(F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss"), XSD + "dateTime")
    if v.kind == "dec":
        text = F.regexp_replace(F.regexp_replace(v.col.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return make_literal(text, XSD + "decimal")
    return make_literal(v.col.cast("string"), XSD + DATATYPES[v.kind])


def term_number(term: Column) -> Column:
    """The double value of an encoded numeric literal, else null."""
    dt = datatype(term)
    return F.when(dt.isin([XSD + n for n in NUMERICS]), lexical(term).try_cast("double"))


def number(v: Val) -> Column:
    """The numeric value, or null (an expression error)."""
    if v.kind in NUMERIC:
        return v.col
    return term_number(v.col) if v.kind == "term" else F.lit(None).cast("double")


def string(v: Val) -> Column:
    """STR(): the lexical form or the IRI; null for a blank node."""
    if v.kind in ("str", "iri"):
        return v.col
    if v.kind == "term":
        return F.when(~v.col.startswith("B"), lexical(v.col))
    return lexical(to_term(v))


def text(v: Val) -> Column:
    """A string literal's lexical form, null for anything else."""
    if v.kind == "str":
        return v.col
    if v.kind == "term":
        return F.when(datatype(v.col).isin(XSD + "string", RDF + "langString", RDF + "dirLangString"), lexical(v.col))
    return F.lit(None).cast("string")


def lang_of(v: Val) -> Column | None:
    if v.kind == "str":
        return v.lang
    return F.coalesce(language(v.col), F.lit("")) if v.kind == "term" else None


def instant(v: Val) -> Column:
    if v.kind in ("time", "date"):
        return v.col.cast("timestamp_ntz")
    if v.kind == "term":
        return F.when(datatype(v.col).isin(XSD + "dateTime", XSD + "date", XSD + "dateTimeStamp"), lexical(v.col).try_cast("timestamp_ntz"))
    return F.lit(None).cast("timestamp_ntz")


def boolean(v: Val) -> Column:
    """The effective boolean value; null is an error."""
    if v.kind == "bool":
        return v.col
    if v.kind in NUMERIC:
        return (v.col != 0) & ~F.isnan(v.col.cast("double"))
    if v.kind == "str":
        return v.col != ""
    if v.kind == "term":
        dt, lex = datatype(v.col), lexical(v.col)
        n = term_number(v.col)
        return (
            F.when(dt == XSD + "boolean", F.coalesce(lex.isin("true", "1"), F.lit(False)))
            .when(dt.isin([XSD + k for k in NUMERICS]), F.coalesce((n != 0) & ~F.isnan(n), F.lit(False)))
            .when(dt.isin(XSD + "string", RDF + "langString", RDF + "dirLangString"), lex != "")
        )
    return F.lit(None).cast("boolean")


def equal(a: Val, b: Val) -> Column:
    """RDF value equality in three values: null where the values can't be compared."""
    if a.kind in NUMERIC and b.kind in NUMERIC:
        return F.when(F.isnan(a.col.cast("double")) | F.isnan(b.col.cast("double")), F.lit(False)).otherwise(a.col == b.col) if "dbl" in (a.kind, b.kind) else a.col == b.col
    if a.kind == b.kind and a.kind in ("iri", "bool", "time", "date"):
        return a.col == b.col
    if a.kind == b.kind == "str" and a.lang is None and b.lang is None:
        return a.col == b.col
    if "term" not in (a.kind, b.kind) and not (a.kind == b.kind == "str"):
        if "iri" in (a.kind, b.kind):
            return F.lit(False)
        return F.lit(None).cast("boolean")
    x, y = to_term(a), to_term(b)
    nx, ny = number(a).cast("double"), number(b).cast("double")
    tx, ty = text(a), text(b)
    ix, iy = instant(a), instant(b)
    return (
        F.when(nx.isNotNull() & ny.isNotNull(), (nx == ny) & ~F.isnan(nx))
        .when(ix.isNotNull() & iy.isNotNull(), ix == iy)
        .when(x == y, F.lit(True))
        .when(~x.startswith("L") | ~y.startswith("L"), F.lit(False))
        .when(tx.isNotNull() & ty.isNotNull(), F.lit(False))
    )


def less(a: Val, b: Val, or_equal: bool) -> Column:
    """a < b (or <=) within one value space, null across spaces."""

    def op(x: Column, y: Column) -> Column:
        return x <= y if or_equal else x < y

    if a.kind in NUMERIC and b.kind in NUMERIC:
        return _ordered(op, a, b)
    if a.kind == b.kind and a.kind in ("str", "bool", "time", "date"):
        return op(a.col, b.col)
    if "term" not in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    n, t, i = (number(a).cast("double"), number(b).cast("double")), (text(a), text(b)), (instant(a), instant(b))
    return (
        F.when(n[0].isNotNull() & n[1].isNotNull(), op(*n) & ~F.isnan(n[0]) & ~F.isnan(n[1]))
        .when(t[0].isNotNull() & t[1].isNotNull(), op(*t))
        .when(i[0].isNotNull() & i[1].isNotNull(), op(*i))
    )


def _ordered(op, a: Val, b: Val) -> Column:
    if "dbl" in (a.kind, b.kind):
        return op(a.col, b.col) & ~F.isnan(a.col.cast("double")) & ~F.isnan(b.col.cast("double"))
    return op(a.col, b.col)


def sort_key(v: Val) -> list[Column]:
    """ORDER BY columns: unbound, then blank nodes, IRIs, numbers by value, other literals by form."""
    if v.kind != "term":
        return [v.col]
    n = term_number(v.col)
    rank = F.when(v.col.isNull(), 0).when(v.col.startswith("B"), 1).when(v.col.startswith("I"), 2).when(n.isNotNull(), 3).when(v.col.startswith("L"), 4).otherwise(5)
    return [rank, n, lexical(v.col), v.col]


def native(data_type: str) -> str:
    """The kind of a mapped column of a Spark type."""
    if data_type in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if data_type.startswith("decimal"):
        return "dec"
    return {"double": "dbl", "float": "flt", "boolean": "bool", "timestamp_ntz": "time", "timestamp": "time", "date": "date"}.get(data_type, "str")
