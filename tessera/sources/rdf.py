"""Reading and writing RDF and SPARQL results."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as t
from ..plans import algebra as A
from ..plans.parser import Parser, SparqlSyntaxError

QUADS = "s string, p string, o string, g string"

# a term of N-Triples as three groups: IRI; blank node; literal with language or datatype
_TERM = r'(?:<([^>]*)>|_:([^\s<"]+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?|<<\((.*)\)>>)'


class TurtleParser(Parser):
    """Turtle and TriG; blank node labels get a scope, so that documents don't share them."""

    def __init__(self, source: str, base: str = "", scope: str = ""):
        super().__init__(source, base=base)
        self.in_template, self.scope, self.out = True, scope, []

    def blank(self):
        self.fresh += 1
        return A.Const(f"B{self.scope}g{self.fresh}")

    def scoped(self, x):
        if isinstance(x, A.TripleTerm):
            return A.Const(t.triple(*(self.scoped(p).term for p in (x.s, x.p, x.o))))
        return A.Const(f"B{self.scope}{x.term[1:]}") if isinstance(x, A.Const) and x.term[0] == "B" and not x.term.startswith(f"B{self.scope}g") else x

    def document(self) -> list[tuple]:
        graph: str | None = None
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if kind == "lang" and text in ("@prefix", "@base") or self.is_word("PREFIX", "BASE", "VERSION"):
                word = self.take()[1].lstrip("@").upper()
                if word == "PREFIX":
                    name = self.take()[1]
                    self.prefixes[name.rstrip(":")] = self.resolve(self.take()[1][1:-1])
                elif word == "BASE":
                    self.base = self.resolve(self.take()[1][1:-1])
                else:
                    self.take()
                self.op(".")
                continue
            if self.word("GRAPH") or self.peek(1) == ("op", "{") or text == "{":
                name = None if text == "{" else self.scoped(self.term([]))
                self.need("{")
                self.add(self.triples(("}",)), None if name is None else name.term)
                self.need("}")
                continue
            found: list = []
            boxed = text in ("[", "(", "<<")
            subject = self.term(found)
            if not (boxed and self.peek()[1] == "."):
                self.properties(subject, found)
            self.need(".")
            self.add(found, graph)
        return self.out

    def add(self, triples: list, graph: str | None) -> None:
        for x in triples:
            if not isinstance(x.p, A.Link) or x.s.term[0] == "L":
                raise SparqlSyntaxError("not a triple")
            self.out.append((self.scoped(x.s).term, t.iri(x.p.iri), self.scoped(x.o).term, graph))


def parse_turtle(text: str, base: str = "", scope: str = "") -> list[tuple]:
    """Quads of a Turtle or TriG document."""
    return TurtleParser(text, base, scope).document()


def read_turtle(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Quads of Turtle and TriG files, a file at a time on the executors (the syntax cannot be split)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = parse_turtle(content.decode(), base or name, hashlib.md5(name.encode()).hexdigest()[:8])
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["s", "p", "o", "g"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, QUADS)


def _unescaped(c: Column) -> Column:
    """N-Triples escapes undone; JSON has the same ones, but for the long form of code points."""
    long = F.regexp_replace(c, r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    return F.when(c.contains("\\"), F.get_json_object(F.concat(F.lit('{"a":"'), F.regexp_replace(long, r"\\'", "'"), F.lit('"}')), "$.a")).otherwise(c)


def _term_column(c: Column) -> Column:
    """A column of N-Triples terms as encoded terms."""

    def part(k: int) -> Column:
        return F.regexp_extract(c, f"^{_TERM}$", k)

    lex, lang = _unescaped(part(3)), part(4)
    dt = F.when(part(5) == "", F.lit(t.XSD + "string")).otherwise(part(5))
    return F.when(c.startswith("<<("), F.concat(F.lit("T"), part(6))).when(c.startswith("<"), F.concat(F.lit("I"), _unescaped(part(1)))).when(c.startswith("_:"), F.concat(F.lit("B"), part(2))).when(
        c.startswith('"'), t.make_literal(lex, dt, lang)
    )


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    """Quads of N-Triples and N-Quads files, line by line in column expressions; other lines than quads fail the read."""
    return nquads(spark.read.text(path))


def nquads(lines: DataFrame) -> DataFrame:
    """The same of a table of lines (column value)."""
    term = r'(?:<<\(.*\)>>|<[^>]*>|_:[^\s<"]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
    line = rf"^\s*({term})\s*({term})\s*({term})\s*({term})?\s*\.\s*(?:#.*)?$"
    rows = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    parts = rows.select(*[F.regexp_extract("value", line, k + 1).alias(c) for k, c in enumerate("spog")], "value")
    sound = F.when(F.col("s") == "", F.raise_error(F.concat(F.lit("not a quad: "), F.col("value")))).otherwise(_term_column(F.col("s")))
    return parts.select(sound.alias("s"), _term_column(F.col("p")).alias("p"), _term_column(F.col("o")).alias("o"), F.when(F.col("g") != "", _term_column(F.col("g"))).alias("g"))


def to_ntriples(c: Column) -> Column:
    """Encoded terms in N-Triples syntax."""
    lex = t.lexical(c)
    for a, b in (("\\\\", "\\\\\\\\"), ('"', '\\\\"'), ("\n", "\\\\n"), ("\r", "\\\\r"), ("\t", "\\\\t")):
        lex = F.regexp_replace(lex, a, b)
    dt, lang = t.datatype(c), t.language(c)
    tail = F.when(lang != "", F.concat(F.lit("@"), lang)).when(dt == t.XSD + "string", F.lit("")).otherwise(F.concat(F.lit("^^<"), dt, F.lit(">")))
    return (
        F.when(c.startswith("I"), F.concat(F.lit("<"), t.lexical(c), F.lit(">")))
        .when(c.startswith("B"), F.concat(F.lit("_:"), t.lexical(c)))
        .when(c.startswith("L"), F.concat(F.lit('"'), lex, F.lit('"'), tail))
    )


def nquad_lines(quads: DataFrame) -> DataFrame:
    parts = [to_ntriples(F.col(c)) for c in "spo"]
    return quads.select(F.concat_ws(" ", *parts, to_ntriples(F.col("g")), F.lit(".")).alias("value"))


def write_nquads(quads: DataFrame, path: str) -> None:
    nquad_lines(quads).write.text(path)


def canonical_nquads(quads: DataFrame) -> DataFrame:
    """Sorted distinct lines; for quads without blank nodes their canonical form."""
    return nquad_lines(quads).distinct().orderBy("value")


def ntriples_term(term: str) -> str:
    """One encoded term in N-Triples syntax, on the driver."""
    kind, lex, dt, lang = t.parse_term(term)
    if kind == "I":
        return f"<{lex}>"
    if kind == "B":
        return f"_:{lex}"
    if kind == "T":
        return "<<( " + " ".join(map(ntriples_term, lex.split("\x02", 2))) + " )>>"
    quoted = '"' + lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
    return quoted + (f"@{lang}" if lang else "" if dt == t.XSD + "string" else f"^^<{dt}>")


def turtle_blocks(quads: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(value): a Turtle block for each subject of the default graph, its predicates in order. Subjects are bounded groups."""
    names = sorted((prefixes or {}).items(), key=lambda x: -len(x[1]))

    def short(term: str) -> str:
        if term[0] == "I":
            for name, ns in names:
                if term[1:].startswith(ns) and re.fullmatch(r"[A-Za-z_][\w-]*", term[1 + len(ns) :]):
                    return f"{name}:{term[1 + len(ns) :]}"
        return ntriples_term(term)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by: dict[str, list[str]] = {}
                for x in pairs:
                    by.setdefault(x["p"], []).append(short(x["o"]))
                out.append(short(s) + " " + " ;\n    ".join(f"{'a' if p == 'I' + t.RDF + 'type' else short(p)} {', '.join(o)}" for p, o in by.items()) + " .")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    grouped = quads.where("g IS NULL").groupBy("s").agg(F.sort_array(F.collect_set(F.struct("p", "o"))).alias("_pairs"))
    return grouped.mapInArrow(run, "value string")


# SPARQL results
def result_lines(terms: DataFrame, form: str) -> DataFrame:
    """A row of text for each solution: ``json`` bindings, ``csv`` or ``tsv``."""
    names = terms.columns
    if form == "tsv":
        return terms.select(F.concat_ws("\t", *[F.coalesce(to_ntriples(F.col(f"`{n}`")), F.lit("")) for n in names]).alias("value"))
    if form == "csv":

        def cell(c: Column) -> Column:
            text = F.when(c.startswith("B"), F.concat(F.lit("_:"), t.lexical(c))).otherwise(t.lexical(c))
            return F.coalesce(F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text), F.lit(""))

        return terms.select(F.concat_ws(",", *[cell(F.col(f"`{n}`")) for n in names]).alias("value"))
    cells = []
    for n in names:
        c = F.col(f"`{n}`")
        kind = F.when(c.startswith("I"), "uri").when(c.startswith("B"), "bnode").when(c.startswith("L"), "literal")
        lang = F.when(t.language(c) != "", t.language(c))
        dt = F.when(lang.isNull() & (t.datatype(c) != t.XSD + "string"), t.datatype(c))
        cells.append(F.when(c.isNotNull(), F.struct(kind.alias("type"), t.lexical(c).alias("value"), lang.alias("xml:lang"), dt.alias("datatype"))).alias(n))
    return terms.select(F.to_json(F.struct(*cells)).alias("value"))


def results_json(terms: DataFrame) -> str:
    """The whole document, for results that fit the driver."""
    rows = [r["value"] for r in result_lines(terms, "json").toLocalIterator()]
    return f'{{"head":{{"vars":{json.dumps(terms.columns)}}},"results":{{"bindings":[{",".join(rows)}]}}}}'


def results_xml(terms: DataFrame) -> str:
    out = ['<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>', *[f"<variable name={quoteattr(n)}/>" for n in terms.columns], "</head><results>"]
    for r in terms.toLocalIterator():
        out.append("<result>")
        for n in terms.columns:
            if r[n] is None:
                continue
            kind, lex, dt, lang = t.parse_term(r[n])
            if kind == "L":
                more = f" xml:lang={quoteattr(lang)}" if lang else "" if dt == t.XSD + "string" else f" datatype={quoteattr(dt)}"
                out.append(f"<binding name={quoteattr(n)}><literal{more}>{escape(lex)}</literal></binding>")
            else:
                tag = {"I": "uri", "B": "bnode"}[kind]
                out.append(f"<binding name={quoteattr(n)}><{tag}>{escape(lex)}</{tag}></binding>")
        out.append("</result>")
    return "".join(out) + "</results></sparql>"


def parse_results_json(text: str) -> tuple[list[str], list[dict[str, str]]] | bool:
    """(variables, rows of encoded terms), or the boolean of an ASK."""
    data = json.loads(text)
    if "boolean" in data:
        return data["boolean"]

    def term(x: dict) -> str:
        if x["type"] == "uri":
            return t.iri(x["value"])
        if x["type"] == "bnode":
            return "B" + x["value"]
        if x["type"] == "triple":
            return t.triple(*(term(x["value"][k]) for k in ("subject", "predicate", "object")))
        lang = x.get("xml:lang", "")
        if x.get("its:dir"):
            lang += "--" + x["its:dir"]
        return t.literal(x["value"], x.get("datatype", t.XSD + "string"), lang)

    return data["head"].get("vars", []), [{k: term(v) for k, v in row.items()} for row in data["results"]["bindings"]]


def parse_results_xml(text: str) -> tuple[list[str], list[dict[str, str]]] | bool:
    import xml.etree.ElementTree as E

    ns = "{http://www.w3.org/2005/sparql-results#}"
    root = E.fromstring(text)
    if (b := root.find(f"{ns}boolean")) is not None:
        return b.text.strip() == "true"

    def term(x) -> str:
        tag, value = x.tag.removeprefix(ns), x.text or ""
        if tag == "uri":
            return t.iri(value)
        if tag == "bnode":
            return "B" + value
        if tag == "triple":
            return t.triple(*(term(x.find(ns + k)[0]) for k in ("subject", "predicate", "object")))
        return t.literal(value, x.get("datatype", t.XSD + "string"), x.get("{http://www.w3.org/XML/1998/namespace}lang", ""))

    names = [v.get("name") for v in root.iter(f"{ns}variable")]
    return names, [{b.get("name"): term(b[0]) for b in r.findall(f"{ns}binding")} for r in root.iter(f"{ns}result")]


def parse_results_tsv(text: str) -> tuple[list[str], list[dict[str, str]]]:
    lines = text.rstrip("\n").split("\n")
    names = [n.lstrip("?").strip() for n in lines[0].split("\t")]
    rows = []
    for line in lines[1:]:
        row = {}
        for n, cell in zip(names, line.split("\t")):
            if cell.strip():
                row[n] = TurtleParser(cell.strip()).term([]).term
        rows.append(row)
    return names, rows


def write_edges(edges: DataFrame, path: str) -> None:
    """An edge list, tab-separated."""
    edges.write.option("sep", "\t").csv(path)
