"""SPARQL text to algebra."""

from __future__ import annotations

import itertools
import re
from typing import Any
from urllib.parse import urljoin

from ..functions.terms import RDF, XSD, iri, literal, triple
from . import algebra as A

_TOKENS = re.compile(
    r"""(?P<ws>(?:\s|\#[^\n\r]*)+)
  |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  |(?P<var>[?$][A-Za-z0-9_\u00b7-\uffff]+)
  |(?P<string>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--(?:ltr|rtl))?)
  |(?P<number>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
  |(?P<blank>_:[A-Za-z0-9_](?:[\w.\-]*[\w\-])?)
  |(?P<pname>(?:[A-Za-z\u00c0-\uffff](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  |(?P<word>[A-Za-z_][A-Za-z0-9_\-]*)
  |(?P<op>\^\^|\|\||&&|!=|<=|>=|<<\(|\)>>|<<|>>|\{\||\|\}|[{}()\[\];,.=<>!+\-*/|^?&~])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
AGGREGATES = frozenset("COUNT SUM MIN MAX AVG SAMPLE GROUP_CONCAT".split())


class SparqlSyntaxError(ValueError):
    """The text is not SPARQL."""


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        return chr(int(c[1:], 16)) if c[0] in "uU" and len(c) > 1 else _ESCAPES[c]

    try:
        return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.DOTALL)
    except KeyError as e:
        raise SparqlSyntaxError(f"no such escape: {e}") from None


class Parser:
    """Recursive descent over the token list; `base` resolves relative IRIs."""

    def __init__(self, source: str, prefixes: dict[str, str] | None = None, base: str = "", aggregates: frozenset[str] = frozenset()):
        self.tokens, at = [], 0
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise SparqlSyntaxError(f"cannot read {source[at : at + 20]!r}")
            if m.lastgroup != "ws":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at, self.prefixes, self.base, self.fresh = 0, dict(prefixes or {}), base, 0
        self.custom_aggregates = aggregates
        self.in_template, self.counter = False, itertools.count()

    # tokens
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def take(self) -> tuple[str, str]:
        token = self.tokens[self.at]
        self.at += 1
        return token

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        kind, text = self.peek(ahead)
        return kind == "word" and text.upper() in words

    def word(self, *words: str) -> str | None:
        return self.take()[1].upper() if self.is_word(*words) else None

    def op(self, *ops: str) -> str | None:
        kind, text = self.peek()
        return self.take()[1] if kind == "op" and text in ops else None

    def need(self, *texts: str) -> str:
        kind, text = self.take()
        if (text.upper() if kind == "word" else text) not in texts:
            raise SparqlSyntaxError(f"expected {' or '.join(texts)}, found {text or 'the end'}")
        return text

    def new_var(self) -> A.Var:
        self.fresh += 1
        return A.Var(f"__{self.fresh}")

    # prologue
    def prologue(self) -> None:
        while True:
            if self.word("PREFIX"):
                name = self.take()[1]
                self.prefixes[name.rstrip(":")] = self.resolve(self.take()[1][1:-1])
            elif self.word("BASE"):
                self.base = self.resolve(self.take()[1][1:-1])
            elif self.word("VERSION"):
                self.take()
            else:
                return

    def resolve(self, text: str) -> str:
        text = unescape(text)
        return urljoin(self.base, text) if self.base and not re.match(r"[A-Za-z][\w+.\-]*:", text) else text

    def iri(self) -> str:
        kind, text = self.take()
        if kind == "iri":
            return self.resolve(text[1:-1])
        if kind == "pname":
            prefix, local = text.split(":", 1)
            if prefix not in self.prefixes:
                raise SparqlSyntaxError(f"no prefix {prefix}:")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise SparqlSyntaxError(f"expected an IRI, found {text or 'the end'}")

    # terms
    def literal(self) -> str:
        kind, text = self.take()
        if kind == "string":
            quote = 3 if text[:3] in ('"""', "'''") else 1
            lex = unescape(text[quote:-quote])
            if self.peek()[0] == "lang":
                return literal(lex, lang=self.take()[1][1:])
            if self.op("^^"):
                return literal(lex, self.iri())
            return literal(lex)
        if kind == "number":
            return literal(text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if kind == "word" and text.lower() in ("true", "false"):
            return literal(text.lower(), XSD + "boolean")
        raise SparqlSyntaxError(f"expected a literal, found {text or 'the end'}")

    def term(self, triples: list) -> Any:
        """A subject or object; what blank nodes and collections stand for is added to triples."""
        kind, text = self.peek()
        if kind == "var":
            self.take()
            return A.Var(text[1:])
        if kind in ("iri", "pname"):
            return A.Const(iri(self.iri()))
        if kind == "blank":
            self.take()
            return A.Const("B" + text[2:]) if self.in_template else A.Var("__b_" + text[2:])
        if self.op("["):
            node = self.blank()
            if not self.op("]"):
                self.properties(node, triples)
                self.need("]")
            return node
        if self.op("("):
            items = []
            while not self.op(")"):
                items.append(self.term(triples))
            nodes = [self.blank() for _ in items]
            for k, (node, item) in enumerate(zip(nodes, items)):
                triples.append(A.Triple(node, A.Link(RDF + "first"), item))
                triples.append(A.Triple(node, A.Link(RDF + "rest"), nodes[k + 1] if k + 1 < len(nodes) else A.Const(iri(RDF + "nil"))))
            return nodes[0] if nodes else A.Const(iri(RDF + "nil"))
        if self.op("<<("):
            parts = self.term(triples), self.plain_verb(), self.term(triples)
            self.need(")>>")
            return self.triple_term(*parts)
        if self.op("<<"):
            parts = self.term(triples), self.plain_verb(), self.term(triples)
            node = self.reifier() if self.op("~") else self.blank()
            self.need(">>")
            triples.append(A.Triple(node, A.Link(RDF + "reifies"), self.triple_term(*parts)))
            return node
        if self.op("-"):
            return A.Const(self.literal().replace("\x01\x01", "\x01\x01-"))
        self.op("+")
        return A.Const(self.literal())

    def a(self) -> bool:
        if self.peek() == ("word", "a"):
            self.take()
            return True
        return False

    def plain_verb(self) -> Any:
        """A predicate that is a variable or an IRI."""
        if self.peek()[0] == "var":
            return A.Var(self.take()[1][1:])
        return A.Const(iri(RDF + "type" if self.a() else self.iri()))

    def triple_term(self, s: Any, p: Any, o: Any) -> Any:
        """A constant, unless there are variables or blank nodes in it."""
        ground = all(isinstance(x, A.Const) and x.term[0] != "B" for x in (s, p, o))
        return A.Const(triple(s.term, p.term, o.term)) if ground else A.TripleTerm(s, p, o)

    def reifier(self) -> Any:
        """What stands behind a tilde; without a name a blank node."""
        return self.term([]) if self.peek()[0] in ("var", "iri", "pname", "blank") else self.blank()

    def annotations(self, subject: Any, verb: Any, obj: Any, triples: list) -> None:
        """Reifiers of the triple just read, and what is said of them."""
        named = None
        while self.peek() in (("op", "~"), ("op", "{|")):
            if not isinstance(verb, (A.Var, A.Link)):
                raise SparqlSyntaxError("a path cannot be annotated")
            block = self.take()[1] == "{|"
            if not block or named is None:
                named = self.blank() if block else self.reifier()
                p = verb if isinstance(verb, A.Var) else A.Const(iri(verb.iri))
                triples.append(A.Triple(named, A.Link(RDF + "reifies"), self.triple_term(subject, p, obj)))
            if block:
                self.properties(named, triples)
                self.need("|}")
                named = None

    def blank(self) -> Any:
        if self.in_template:
            self.fresh += 1
            return A.Const(f"B_t{self.fresh}")
        return self.new_var()

    def properties(self, subject: Any, triples: list) -> None:
        while True:
            kind, text = self.peek()
            if kind == "var":
                self.take()
                verb = A.Var(text[1:])
            else:
                verb = self.path()
            while True:
                obj = self.term(triples)
                triples.append(A.Triple(subject, verb, obj))
                self.annotations(subject, verb, obj, triples)
                if not self.op(","):
                    break
            again = False
            while self.op(";"):
                again = True
            if not again or self.peek()[1] in ("}", "]", ".", "|}", ""):
                return

    def triples(self, until: tuple[str, ...]) -> list:
        out: list = []
        while self.peek()[1] not in until:
            boxed = self.peek()[1] in ("[", "(", "<<")
            subject = self.term(out)
            if not (boxed and self.peek()[1] in (".", "}")):
                self.properties(subject, out)
            if not self.op("."):
                break
        return out

    # paths
    def path(self) -> Any:
        parts = [self.path_sequence()]
        while self.op("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else A.Alt(tuple(parts))

    def path_sequence(self) -> Any:
        parts = [self.path_step()]
        while self.op("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else A.Seq(tuple(parts))

    def path_step(self) -> Any:
        if self.op("^"):
            return A.Inverse(self.path_step())
        if self.op("!"):
            forward, backward = [], []
            if self.op("("):
                while not self.op(")"):
                    (backward if self.op("^") else forward).append(RDF + "type" if self.a() else self.iri())
                    self.op("|")
            else:
                (backward if self.op("^") else forward).append(RDF + "type" if self.a() else self.iri())
            return A.Negated(tuple(forward), tuple(backward))
        if self.op("("):
            inner = self.path()
            self.need(")")
        else:
            inner = A.Link(RDF + "type" if self.a() else self.iri())
        if self.peek() == ("op", "*"):
            self.take()
            return A.Closure(inner, 0, None)
        if self.peek() == ("op", "+"):
            self.take()
            return A.Closure(inner, 1, None)
        if self.peek() == ("op", "?"):
            self.take()
            return A.Closure(inner, 0, 1)
        return inner

    # patterns
    def group(self) -> Any:
        self.need("{")
        if self.is_word("SELECT"):
            out = self.subselect()
            self.need("}")
            return out
        now: Any = A.Unit()
        filters: list = []
        while not self.op("}"):
            if self.word("FILTER"):
                filters.append(self.constraint())
            elif self.word("OPTIONAL"):
                inner = self.group()
                condition = None
                while isinstance(inner, A.Filter):
                    condition = inner.condition if condition is None else A.Call("and", (inner.condition, condition))
                    inner = inner.input
                now = A.LeftJoin(now, inner, condition)
            elif self.word("MINUS"):
                now = A.Minus(now, self.group())
            elif self.word("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                now = A.Extend(now, self.take()[1][1:], e)
                self.need(")")
            elif self.word("VALUES"):
                now = join(now, self.values())
            elif self.word("GRAPH"):
                g = self.term([])
                now = join(now, A.Graph(g, self.group()))
            elif self.word("SERVICE"):
                silent = bool(self.word("SILENT"))
                now = join(now, A.Service(self.term([]), silent, self.group()))
            elif self.peek() == ("op", "{"):
                inner = self.group()
                while self.word("UNION"):
                    inner = A.Union(inner, self.group())
                now = join(now, inner)
            else:
                now = join(now, patterns(self.triples(("}", "{", *_STOP)), self.counter))
            self.op(".")
        for f in filters:
            now = A.Filter(now, f)
        return now

    def constraint(self) -> Any:
        if self.peek() == ("op", "("):
            self.take()
            e = self.expression()
            self.need(")")
            return e
        return self.primary()

    def values(self) -> A.Table:
        names: list[str] = []
        many = bool(self.op("("))
        while self.peek()[0] == "var":
            names.append(self.take()[1][1:])
            if not many:
                break
        if many:
            self.need(")")
        self.need("{")
        rows = []
        while not self.op("}"):
            row = []
            if many:
                self.need("(")
            while (not row) if not many else not self.op(")"):
                row.append(None if self.word("UNDEF") else self.term([]).term)
            rows.append(tuple(row))
        return A.Table(tuple(names), tuple(rows))

    # queries
    def select_clause(self) -> tuple[bool, bool, list | None]:
        distinct, reduced = bool(self.word("DISTINCT")), bool(self.word("REDUCED"))
        if self.op("*"):
            return distinct, reduced, None
        items: list = []
        while True:
            if self.peek()[0] == "var":
                items.append((self.take()[1][1:], None))
            elif self.op("("):
                e = self.expression()
                self.need("AS")
                items.append((self.take()[1][1:], e))
                self.need(")")
            else:
                break
        if not items:
            raise SparqlSyntaxError("SELECT needs variables")
        return distinct, reduced, items

    def subselect(self) -> Any:
        self.need("SELECT")
        clause = self.select_clause()
        self.word("WHERE")
        return self.modifiers(clause, self.group())

    def modifiers(self, clause: tuple, pattern: Any) -> Any:
        distinct, reduced, items = clause
        keys, having, order, limit, offset = [], [], [], None, 0
        if self.word("GROUP"):
            self.need("BY")
            while True:
                if self.peek()[0] == "var":
                    keys.append((self.take()[1][1:], None))
                elif self.op("("):
                    e = self.expression()
                    name = self.take()[1][1:] if self.word("AS") else self.new_var().name
                    self.need(")")
                    keys.append((name, e))
                elif self.peek()[0] in ("iri", "pname") or self.peek()[0] == "word" and not self.is_word("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES"):
                    keys.append((self.new_var().name, self.primary()))
                else:
                    break
        if self.word("HAVING"):
            while self.peek() == ("op", "(") or self.peek()[0] in ("iri", "pname") or self.peek()[0] == "word" and not self.is_word("ORDER", "LIMIT", "OFFSET", "VALUES"):
                having.append(self.constraint())
        if self.word("ORDER"):
            self.need("BY")
            while True:
                if way := self.word("ASC", "DESC"):
                    self.need("(")
                    order.append((self.expression(), way == "ASC"))
                    self.need(")")
                elif self.peek()[0] == "var":
                    order.append((A.Var(self.take()[1][1:]), True))
                elif self.peek() == ("op", "(") or self.peek()[0] in ("iri", "pname") or self.peek()[0] == "word" and not self.is_word("LIMIT", "OFFSET", "VALUES"):
                    order.append((self.constraint(), True))
                else:
                    break
        while way := self.word("LIMIT", "OFFSET"):
            n = int(self.take()[1])
            limit, offset = (n, offset) if way == "LIMIT" else (limit, n)
        if self.word("VALUES"):
            pattern = join(pattern, self.values())
        aggregates: list = []

        def lift(e: Any) -> Any:
            if isinstance(e, A.Call) and e.name.startswith("agg:"):
                for name, known in aggregates:
                    if known == e:
                        return A.Var(name)
                aggregates.append((self.new_var().name, e))
                return A.Var(aggregates[-1][0])
            return A.Call(e.name, tuple(map(lift, e.args)), e.distinct, e.separator) if isinstance(e, A.Call) else e

        lifted = None if items is None else [(n, None if e is None else lift(e)) for n, e in items]
        having, order = [lift(e) for e in having], [(lift(e), up) for e, up in order]
        if keys or aggregates:
            pattern = A.Group(pattern, tuple(keys), tuple(aggregates))
            for e in having:
                pattern = A.Filter(pattern, e)
        for name, e in lifted or ():
            if e is not None:
                pattern = A.Extend(pattern, name, e)
        if order:
            pattern = A.OrderBy(pattern, tuple(order))
        pattern = A.Project(pattern, None if lifted is None else tuple(n for n, _ in lifted))
        if distinct or reduced:
            pattern = A.Distinct(pattern) if distinct else A.Reduced(pattern)
        return A.Slice(pattern, offset, limit) if limit is not None or offset else pattern

    def query(self) -> A.Query:
        self.prologue()
        form = self.need("SELECT", "ASK", "CONSTRUCT", "DESCRIBE").upper()
        clause, template, resources = (False, False, None), (), []
        if form == "SELECT":
            clause = self.select_clause()
        elif form == "CONSTRUCT" and self.peek() == ("op", "{"):
            template = self.template()
        elif form == "DESCRIBE":
            while not self.op("*") and self.peek()[0] in ("var", "iri", "pname"):
                resources.append(self.term([]))
        defaults, named = [], []
        while self.word("FROM"):
            (named if self.word("NAMED") else defaults).append(self.iri())
        where = self.word("WHERE")
        if form == "CONSTRUCT" and not template:
            start = self.at
            template = self.template()
            self.at = start
        if where or self.peek() == ("op", "{"):
            pattern = self.group()
        else:
            pattern = A.Unit()
        pattern = self.modifiers(clause, pattern)
        if self.peek()[0] != "end":
            raise SparqlSyntaxError(f"unexpected {self.peek()[1]}")
        return A.Query(form, pattern, template, tuple(resources), tuple(defaults), tuple(named))

    def template(self) -> tuple:
        self.need("{")
        self.in_template = True
        out = self.triples(("}",))
        self.in_template = False
        self.need("}")
        return tuple(A.Triple(t.s, A.Const(iri(t.p.iri)) if isinstance(t.p, A.Link) else t.p, t.o) for t in out)

    # expressions
    def expression(self) -> Any:
        e = self.conjunction()
        while self.op("||"):
            e = A.Call("or", (e, self.conjunction()))
        return e

    def conjunction(self) -> Any:
        e = self.relation()
        while self.op("&&"):
            e = A.Call("and", (e, self.relation()))
        return e

    def relation(self) -> Any:
        e = self.sum()
        if o := self.op("=", "!=", "<", ">", "<=", ">="):
            return A.Call(o, (e, self.sum()))
        if self.is_word("IN") or self.is_word("NOT") and self.is_word("IN", ahead=1):
            negated = bool(self.word("NOT"))
            self.need("IN")
            found = A.Call("in", (e, *self.arguments()))
            return A.Call("not", (found,)) if negated else found
        return e

    def sum(self) -> Any:
        e = self.product()
        while True:
            if o := self.op("+", "-"):
                e = A.Call(o, (e, self.product()))
            else:
                return e

    def product(self) -> Any:
        e = self.unary()
        while o := self.op("*", "/"):
            e = A.Call(o, (e, self.unary()))
        return e

    def unary(self) -> Any:
        if self.op("!"):
            return A.Call("not", (self.unary(),))
        if self.op("-"):
            return A.Call("neg", (self.unary(),))
        self.op("+")
        return self.primary()

    def arguments(self) -> tuple:
        self.need("(")
        out = []
        while not self.op(")"):
            out.append(self.expression())
            self.op(",")
        return tuple(out)

    def primary(self) -> Any:
        kind, text = self.peek()
        if kind == "op" and text == "(":
            self.take()
            e = self.expression()
            self.need(")")
            return e
        if kind == "var":
            self.take()
            return A.Var(text[1:])
        if kind in ("iri", "pname"):
            name = self.iri()
            if self.peek() == ("op", "("):
                self.take()
                distinct, args = bool(self.word("DISTINCT")), []
                while not self.op(")"):
                    args.append(self.expression())
                    self.op(",")
                return A.Call(("agg:" if name in self.custom_aggregates else "") + name, tuple(args), distinct)
            return A.Const(iri(name))
        if kind == "word" and text.lower() not in ("true", "false"):
            self.take()
            name = text.upper()
            if name == "EXISTS":
                return A.Exists(self.group(), False)
            if name == "NOT":
                self.need("EXISTS")
                return A.Exists(self.group(), True)
            if name in AGGREGATES:
                self.need("(")
                distinct, separator = bool(self.word("DISTINCT")), None
                args = () if self.op("*") else (self.expression(),)
                if self.op(";"):
                    self.need("SEPARATOR")
                    self.need("=")
                    separator = self.literal().split("\x01", 2)[2]
                self.need(")")
                return A.Call("agg:" + name, args, distinct, separator)
            return A.Call(name, self.arguments())
        if kind == "op" and text == "<<(":
            return as_expression(self.term([]))
        return A.Const(self.literal())

    # updates
    def updates(self) -> list[A.Update]:
        out = []
        while True:
            self.prologue()
            if self.peek()[0] == "end":
                return out
            out.append(self.update())
            self.op(";")

    def graph_ref(self) -> Any:
        if w := self.word("DEFAULT", "NAMED", "ALL"):
            return w
        self.word("GRAPH")
        return iri(self.iri())

    def quads(self) -> tuple:
        """(s, p, o, graph) templates; graph None is the default one."""
        self.need("{")
        self.in_template, out = True, []

        def add(triples: list, g: Any) -> None:
            out.extend((t.s, A.Const(iri(t.p.iri)) if isinstance(t.p, A.Link) else t.p, t.o, g) for t in triples)

        while not self.op("}"):
            if self.word("GRAPH"):
                g = self.term([])
                self.need("{")
                add(self.triples(("}",)), g)
                self.need("}")
            else:
                add(self.triples(("}", "GRAPH")), None)
            self.op(".")
        self.in_template = False
        return tuple(out)

    def update(self) -> A.Update:
        name = self.need("INSERT", "DELETE", "WITH", "LOAD", "CLEAR", "DROP", "CREATE", "ADD", "MOVE", "COPY").upper()
        if name in ("ADD", "MOVE", "COPY"):
            silent = bool(self.word("SILENT"))
            source = self.graph_ref()
            self.need("TO")
            return A.Update(name, source=source, target=self.graph_ref(), silent=silent)
        if name in ("CLEAR", "DROP", "CREATE"):
            silent = bool(self.word("SILENT"))
            return A.Update(name, target=self.graph_ref(), silent=silent)
        if name == "LOAD":
            silent, source = bool(self.word("SILENT")), self.iri()
            return A.Update(name, source=source, target=self.graph_ref() if self.word("INTO") else None, silent=silent)
        if name in ("INSERT", "DELETE") and self.word("DATA"):
            quads = self.quads()
            return A.Update(name, **{name.lower(): quads})
        if name == "DELETE" and self.is_word("WHERE"):
            self.take()
            start = self.at
            quads = tuple(tuple(A.Var("__b_" + x.term[1:]) if isinstance(x, A.Const) and x.term[0] == "B" else x for x in q) for q in self.quads())
            self.at = start
            return A.Update("MODIFY", delete=quads, pattern=self.group())
        with_graph = None
        if name == "WITH":
            with_graph = A.Const(iri(self.iri()))
            name = self.need("INSERT", "DELETE").upper()
        delete: tuple = ()
        insert: tuple = ()
        if name == "DELETE":
            delete = self.quads()
            if self.word("INSERT"):
                insert = self.quads()
        else:
            insert = self.quads()
        using = []
        while self.word("USING"):
            named = bool(self.word("NAMED"))
            using.append((named, self.iri()))
        self.need("WHERE")
        pattern = self.group()
        if with_graph is not None:
            delete, insert = (tuple((s, p, o, with_graph if g is None else g) for s, p, o, g in q) for q in (delete, insert))
            if not using:
                using = [(False, with_graph.term[1:])]
        return A.Update("MODIFY", delete=delete, insert=insert, pattern=pattern, using=tuple(using))


_STOP = ("FILTER", "OPTIONAL", "MINUS", "BIND", "VALUES", "GRAPH", "SERVICE", "UNION")


def join(left: Any, right: Any) -> Any:
    if isinstance(left, A.Unit):
        return right
    if isinstance(right, A.Unit):
        return left
    if isinstance(left, A.Bgp) and isinstance(right, A.Bgp):
        return A.Bgp(left.triples + right.triples)
    return A.Join(left, right)


def as_expression(x: Any) -> Any:
    return A.Call("TRIPLE", tuple(map(as_expression, (x.s, x.p, x.o)))) if isinstance(x, A.TripleTerm) else x


def taken_apart(t: A.Triple, count: itertools.count) -> Any:
    """A pattern whose object is a triple term: any object there, which must be a triple whose parts agree.

    Variables of the term that the pattern doesn't have yet are bound to the parts, so joins with other patterns are on them.
    """
    whole = A.Var(f"__tt{next(count)}")
    out: Any = A.Bgp((A.Triple(t.s, t.p, whole),))
    known, waiting = {x.name for x in (t.s, t.p) if isinstance(x, A.Var)}, [(whole, t.o)]
    while waiting:
        held, term = waiting.pop()
        out = A.Filter(out, A.Call("ISTRIPLE", (held,)))
        for name, part in (("SUBJECT", term.s), ("PREDICATE", term.p), ("OBJECT", term.o)):
            found = A.Call(name, (held,))
            if isinstance(part, A.TripleTerm):
                inner = A.Var(f"__tt{next(count)}")
                out = A.Extend(out, inner.name, found, True)
                waiting.append((inner, part))
            elif isinstance(part, A.Var) and part.name not in known:
                out = A.Extend(out, part.name, found, True)
                known.add(part.name)
            else:
                out = A.Filter(out, A.Call("SAMETERM", (found, part)))
    return out


def patterns(triples: list, count: itertools.count) -> Any:
    """Triples as one BGP, those with variables in a triple term, and the paths that aren't single links."""
    simple, apart, out = [], [], A.Unit()
    for t in triples:
        p = A.Const(iri(t.p.iri)) if isinstance(t.p, A.Link) else t.p
        if isinstance(t.s, A.TripleTerm) or isinstance(t.o, A.TripleTerm) and not isinstance(p, (A.Const, A.Var)):
            raise SparqlSyntaxError("a triple term can only be the object of a predicate")
        if isinstance(p, (A.Const, A.Var)):
            (apart if isinstance(t.o, A.TripleTerm) else simple).append(A.Triple(t.s, p, t.o))
    if simple:
        out = A.Bgp(tuple(simple))
    for t in apart:
        out = join(out, taken_apart(t, count))
    for t in triples:
        if not isinstance(t.p, (A.Link, A.Var)):
            out = join(out, A.Path(t.s, t.p, t.o))
    return out


def parse_query(text: str, prefixes: dict[str, str] | None = None, base: str = "", aggregates: frozenset[str] = frozenset()) -> A.Query:
    try:
        return Parser(text, prefixes, base, aggregates).query()
    except (IndexError, AttributeError) as e:
        raise SparqlSyntaxError(str(e)) from e


def parse_update(text: str, prefixes: dict[str, str] | None = None, base: str = "") -> list[A.Update]:
    try:
        return Parser(text, prefixes, base).updates()
    except (IndexError, AttributeError) as e:
        raise SparqlSyntaxError(str(e)) from e
