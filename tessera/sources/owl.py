"""OWL ontologies in functional and XML syntax, as triples by the structural mapping to RDF."""

from __future__ import annotations

import re
import xml.etree.ElementTree as E

from ..functions import terms as t
from ..functions.terms import OWL, RDF, RDFS, XSD, iri

_TOKEN = re.compile(r'\s+|#[^\n]*|(<[^>]*>|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^(?:<[^>]*>|[\w.-]*:[\w.-]*))?|[()=]|_:[\w.-]+|[\w.-]*:[\w.-]*|[^\s()"<=]+)')
TYPE = iri(RDF + "type")
# fixed values: axioms of the form subject, predicate, object, and the predicate
_BINARY = {
    "SubClassOf": RDFS + "subClassOf", "SubObjectPropertyOf": RDFS + "subPropertyOf", "SubDataPropertyOf": RDFS + "subPropertyOf", "SubAnnotationPropertyOf": RDFS + "subPropertyOf",
    "ObjectPropertyDomain": RDFS + "domain", "DataPropertyDomain": RDFS + "domain", "AnnotationPropertyDomain": RDFS + "domain", "ObjectPropertyRange": RDFS + "range", "DataPropertyRange": RDFS + "range",
    "AnnotationPropertyRange": RDFS + "range", "InverseObjectProperties": OWL + "inverseOf", "DatatypeDefinition": OWL + "equivalentClass",
}
_CHAINED = {"EquivalentClasses": "equivalentClass", "EquivalentObjectProperties": "equivalentProperty", "EquivalentDataProperties": "equivalentProperty", "SameIndividual": "sameAs"}
_PAIRWISE = {"DisjointClasses": ("disjointWith", "AllDisjointClasses", "members"), "DisjointObjectProperties": ("propertyDisjointWith", "AllDisjointProperties", "members"), "DisjointDataProperties": ("propertyDisjointWith", "AllDisjointProperties", "members"), "DifferentIndividuals": ("differentFrom", "AllDifferent", "distinctMembers")}
_KINDS = {f"{k}ObjectProperty": f"{k}Property" for k in ("Functional", "InverseFunctional", "Reflexive", "Irreflexive", "Symmetric", "Asymmetric", "Transitive")} | {"FunctionalDataProperty": "FunctionalProperty"}
_DECLARED = {"Class": OWL + "Class", "ObjectProperty": OWL + "ObjectProperty", "DataProperty": OWL + "DatatypeProperty", "AnnotationProperty": OWL + "AnnotationProperty", "NamedIndividual": OWL + "NamedIndividual", "Datatype": RDFS + "Datatype"}


class _Mapper:
    """Trees (a name and its arguments; leaves are encoded terms) to triples."""

    def __init__(self, scope: str):
        self.out: list[tuple] = []
        self.scope, self.n = scope, 0

    def blank(self) -> str:
        self.n += 1
        return f"B{self.scope}o{self.n}"

    def add(self, s: str, p: str, o: str) -> None:
        self.out.append((s, iri(p), o, None))

    def list(self, items: list[str]) -> str:
        head = iri(RDF + "nil")
        for x in reversed(items):
            cell = self.blank()
            self.add(cell, RDF + "first", x)
            self.add(cell, RDF + "rest", head)
            head = cell
        return head

    def node(self, x) -> str:
        """An expression's node."""
        if isinstance(x, str):
            return x
        name, *args = x
        b = self.blank()
        if name == "ObjectInverseOf":
            self.add(b, OWL + "inverseOf", self.node(args[0]))
            return b
        data = name.startswith("Data")
        short = re.sub(r"^(Object|Data)", "", name)
        if short in ("IntersectionOf", "UnionOf", "OneOf"):
            self.add(b, RDF + "type", iri(RDFS + "Datatype" if data else OWL + "Class"))
            self.add(b, OWL + short[0].lower() + short[1:], self.list([self.node(a) for a in args]))
        elif short == "ComplementOf":
            self.add(b, RDF + "type", iri(RDFS + "Datatype" if data else OWL + "Class"))
            self.add(b, OWL + ("datatypeComplementOf" if data else "complementOf"), self.node(args[0]))
        elif short in ("SomeValuesFrom", "AllValuesFrom", "HasValue", "HasSelf"):
            self.add(b, RDF + "type", iri(OWL + "Restriction"))
            self.add(b, OWL + "onProperty", self.node(args[0]))
            self.add(b, OWL + short[0].lower() + short[1:], self.node(args[1]) if len(args) > 1 else t.literal("true", XSD + "boolean"))
        elif short in ("MinCardinality", "MaxCardinality", "ExactCardinality"):
            word = "cardinality" if short == "ExactCardinality" else short[0].lower() + short[1:]
            qualified = len(args) > 2
            if qualified:
                word = "qualified" + word[0].upper() + word[1:] if word == "cardinality" else word.replace("Cardinality", "QualifiedCardinality")
            self.add(b, RDF + "type", iri(OWL + "Restriction"))
            self.add(b, OWL + "onProperty", self.node(args[1]))
            self.add(b, OWL + word, t.literal(t.parse_term(args[0])[1], XSD + "nonNegativeInteger"))
            if qualified:
                self.add(b, OWL + ("onDataRange" if data else "onClass"), self.node(args[2]))
        elif name == "DatatypeRestriction":
            self.add(b, RDF + "type", iri(RDFS + "Datatype"))
            self.add(b, OWL + "onDatatype", self.node(args[0]))
            facets = []
            for facet, value in zip(args[1::2], args[2::2]):
                f = self.blank()
                self.add(f, self.node(facet)[1:], self.node(value))
                facets.append(f)
            self.add(b, OWL + "withRestrictions", self.list(facets))
        else:
            raise ValueError(f"no such expression: {name}")
        return b

    def axiom(self, x) -> None:
        name, *args = x
        args = [a for a in args if not (isinstance(a, tuple) and a[0] == "Annotation")]
        if name == "Declaration":
            kind, entity = args[0]
            self.add(entity, RDF + "type", iri(_DECLARED[kind]))
        elif name == "SubObjectPropertyOf" and isinstance(args[0], tuple) and args[0][0] == "ObjectPropertyChain":
            self.add(self.node(args[1]), OWL + "propertyChainAxiom", self.list([self.node(a) for a in args[0][1:]]))
        elif name in _BINARY:
            self.add(self.node(args[0]), _BINARY[name], self.node(args[1]))
        elif name in _CHAINED:
            nodes = [self.node(a) for a in args]
            for a, b in zip(nodes, nodes[1:]):
                self.add(a, OWL + _CHAINED[name], b)
        elif name in _PAIRWISE:
            two, kind, word = _PAIRWISE[name]
            nodes = [self.node(a) for a in args]
            if len(nodes) == 2:
                self.add(nodes[0], OWL + two, nodes[1])
            else:
                b = self.blank()
                self.add(b, RDF + "type", iri(OWL + kind))
                self.add(b, OWL + word, self.list(nodes))
        elif name == "DisjointUnion":
            self.add(self.node(args[0]), OWL + "disjointUnionOf", self.list([self.node(a) for a in args[1:]]))
        elif name in _KINDS:
            self.add(self.node(args[0]), RDF + "type", iri(OWL + _KINDS[name]))
        elif name == "ClassAssertion":
            self.add(self.node(args[1]), RDF + "type", self.node(args[0]))
        elif name in ("ObjectPropertyAssertion", "DataPropertyAssertion", "AnnotationAssertion"):
            p, s, o = args
            if isinstance(p, tuple):
                p, s, o = p[1], o, s
            self.add(self.node(s), self.node(p)[1:], self.node(o))
        elif name in ("NegativeObjectPropertyAssertion", "NegativeDataPropertyAssertion"):
            b = self.blank()
            self.add(b, RDF + "type", iri(OWL + "NegativePropertyAssertion"))
            for word, a in zip(("assertionProperty", "sourceIndividual", "targetValue" if "Data" in name else "targetIndividual"), args):
                self.add(b, OWL + word, self.node(a))
        elif name == "HasKey":
            groups = [g for a in args[1:] for g in (a if isinstance(a, tuple) and a[0] == "()" else ("()", a))[1:]]
            self.add(self.node(args[0]), OWL + "hasKey", self.list([self.node(g) for g in groups]))
        else:
            raise ValueError(f"no such axiom: {name}")


def parse_functional(text: str, scope: str = "") -> list[tuple]:
    """Quads of a document in functional-style syntax."""
    tokens = [m[1] for m in _TOKEN.finditer(text) if m[1]]
    prefixes = {"owl": OWL, "rdf": RDF, "rdfs": RDFS, "xsd": XSD}
    m, at = _Mapper(scope), 0

    def leaf(x: str) -> str:
        if x[0] == "<":
            return iri(x[1:-1])
        if x.startswith("_:"):
            return f"B{scope}n{x[2:]}"
        if x[0] == '"':
            end = x.rindex('"')
            lex, tail = x[1:end].replace('\\"', '"').replace("\\\\", "\\"), x[end + 1 :]
            return t.literal(lex, lang=tail[1:]) if tail[:1] == "@" else t.literal(lex, leaf(tail[2:])[1:]) if tail else t.literal(lex)
        if x.isdigit():
            return t.literal(x, XSD + "integer")
        prefix, local = x.split(":", 1)
        return iri(prefixes[prefix] + local)

    def tree():
        nonlocal at
        name = tokens[at]
        if name == "(":
            name = "()"
        elif name.isalpha() and at + 1 < len(tokens) and tokens[at + 1] == "(":
            at += 1
        else:
            at += 1
            return leaf(name)
        at += 1
        args = []
        while tokens[at] != ")":
            args.append(tree())
        at += 1
        return (name, *args)

    while at < len(tokens):
        if tokens[at] == "Prefix":
            prefixes[tokens[at + 2].rstrip(":")] = tokens[at + 4][1:-1]
            at += 6
        elif tokens[at] == "Ontology":
            at += 2
            if tokens[at][0] == "<":
                m.add(iri(tokens[at][1:-1]), RDF + "type", iri(OWL + "Ontology"))
                while tokens[at][0] == "<":
                    at += 1
            while tokens[at] != ")":
                x = tree()
                if x[0] not in ("Import", "Annotation"):
                    m.axiom(x)
            at += 1
        else:
            raise ValueError(f"unexpected {tokens[at]}")
    return m.out


def parse_owlxml(text: str, scope: str = "") -> list[tuple]:
    """Quads of a document in OWL/XML, whose elements are the names of the functional syntax."""
    root, m = E.fromstring(text), _Mapper(scope)
    ns = "{" + OWL + "}"
    prefixes = {"owl": OWL, "rdf": RDF, "rdfs": RDFS, "xsd": XSD} | {p.get("name"): p.get("IRI") for p in root.iter(ns + "Prefix")}
    base = root.get("{http://www.w3.org/XML/1998/namespace}base", root.get("ontologyIRI", ""))

    def full(x: str) -> str:
        return x if re.match(r"[A-Za-z][\w+.-]*:", x) else base + x

    def named(e: E.Element) -> str | None:
        if e.get("abbreviatedIRI"):
            prefix, local = e.get("abbreviatedIRI").split(":", 1)
            return iri(prefixes[prefix] + local)
        return iri(full(e.get("IRI"))) if e.get("IRI") is not None else f"B{scope}n{e.get('nodeID').removeprefix('_:')}" if e.get("nodeID") else None

    def tree(e: E.Element):
        name, known = e.tag.removeprefix(ns), named(e)
        if known is not None and name != "FacetRestriction":
            return known
        if name == "Literal":
            lang = e.get("{http://www.w3.org/XML/1998/namespace}lang", "")
            return t.literal(e.text or "", full(e.get("datatypeIRI", XSD + "string")), lang)
        if name in ("IRI", "AbbreviatedIRI"):
            return iri(full(e.text))
        args: list = []
        if e.get("cardinality"):
            args.append(t.literal(e.get("cardinality"), XSD + "integer"))
        for c in e:
            if c.tag == ns + "FacetRestriction":
                args += [iri(full(c.get("facet"))), tree(c[0])]
            elif c.tag != ns + "Annotation":
                args.append(tree(c))
        return (name, *args)

    if root.get("ontologyIRI"):
        m.add(iri(root.get("ontologyIRI")), RDF + "type", iri(OWL + "Ontology"))
    for e in root:
        name = e.tag.removeprefix(ns)
        if name == "Declaration":
            m.add(named(e[0]), RDF + "type", iri(_DECLARED[e[0].tag.removeprefix(ns)]))
        elif name not in ("Prefix", "Import", "Annotation"):
            m.axiom(tree(e))
    return m.out
