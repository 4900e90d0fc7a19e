"""SHACL validation: each constraint of a shape is one plan over all its focus nodes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Dataset
from ..functions import terms as t
from ..functions.terms import RDF, RDFS, SH, XSD, Val, iri
from ..plans import algebra as A
from ..plans.compiler import Context, Solutions, semi
from ..plans.parser import parse_query
from ..shared import settle
from ..sources.rdf import ntriples_term
from . import paths

TYPE = iri(RDF + "type")


@dataclass
class Shape:
    """A node or property shape; parameters are lists of encoded terms by local name."""

    node: str
    path: object = None
    path_text: str | None = None
    parameters: dict[str, list[str]] = field(default_factory=dict)
    severity: str = iri(SH + "Violation")
    deactivated: bool = False


class Shapes:
    """A shapes graph, which is schema-sized and so held on the driver."""

    def __init__(self, triples: list[tuple]):
        self.by: dict[str, dict[str, list[str]]] = {}
        for s, p, o, *_ in triples:
            self.by.setdefault(s, {}).setdefault(p, []).append(o)
        parameters = {iri(SH + p) for p in ("path", "property", "node", "targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf", "and", "or", "not", "xone", "class", "datatype", "closed", "in", "nodeKind", "minCount", "maxCount", "hasValue", "pattern", "sparql", "qualifiedValueShape")}
        self.roots = sorted(n for n, ps in self.by.items() if iri(SH + "NodeShape") in ps.get(TYPE, ()) or iri(SH + "PropertyShape") in ps.get(TYPE, ()) or any(p.startswith(iri(SH + "target")) for p in ps))
        self.parameters = parameters

    def get(self, node: str, name: str) -> list[str]:
        return self.by.get(node, {}).get(iri(SH + name), [])

    def list_of(self, head: str) -> list[str]:
        out, seen = [], set()
        while head != iri(RDF + "nil"):
            if head in seen or iri(RDF + "first") not in self.by.get(head, {}):
                raise ValueError("not a well-formed list")
            seen.add(head)
            out.append(self.by[head][iri(RDF + "first")][0])
            head = self.by[head][iri(RDF + "rest")][0]
        return out

    def path(self, node: str):
        if node[0] == "I":
            return A.Link(node[1:])
        ps = self.by.get(node, {})
        if iri(RDF + "first") in ps:
            return A.Seq(tuple(map(self.path, self.list_of(node))))
        for name, make in (
            ("inversePath", A.Inverse), ("zeroOrMorePath", lambda p: A.Closure(p, 0, None)), ("oneOrMorePath", lambda p: A.Closure(p, 1, None)), ("zeroOrOnePath", lambda p: A.Closure(p, 0, 1)),
        ):
            if self.get(node, name):
                return make(self.path(self.get(node, name)[0]))
        if self.get(node, "alternativePath"):
            return A.Alt(tuple(map(self.path, self.list_of(self.get(node, "alternativePath")[0]))))
        raise ValueError("not a path")

    def shape(self, node: str) -> Shape:
        out = Shape(node, parameters={p[len(iri(SH)) :]: o for p, o in self.by.get(node, {}).items() if p.startswith(iri(SH))})
        if out.parameters.get("path"):
            out.path, out.path_text = self.path(out.parameters["path"][0]), out.parameters["path"][0]
        out.severity = out.parameters.get("severity", [out.severity])[0]
        out.deactivated = out.parameters.get("deactivated", [""])[0].endswith("\x01true")
        return out


COLUMNS = ("focus", "path", "value", "component", "severity", "shape")
Evaluator = Callable[["Validator", Shape, DataFrame, DataFrame, str], DataFrame]


class Validator:
    """Validates a data graph. Evaluators by parameter name; more may be added."""

    def __init__(self, data: Dataset, shapes: Shapes, evaluators: dict[str, Evaluator] | None = None):
        self.data, self.shapes = data, shapes
        self.ctx: Context = data.context()
        self.triples = self.ctx.active()
        self.evaluators = EVALUATORS | (evaluators or {})
        self.spark = data.spark
        self._classes: DataFrame | None = None

    # parts that evaluators use
    def instances(self) -> DataFrame:
        """(node, class), superclasses included."""
        if self._classes is None:
            types = self.triples.where(F.col("p") == TYPE).select(F.col("s").alias("node"), F.col("o").alias("class"))
            up = paths.closure(self.triples.where(F.col("p") == iri(RDFS + "subClassOf")).select(F.col("s").alias("src"), F.col("o").alias("dst")))
            self._classes = settle(types.unionByName(types.join(up, F.col("class") == F.col("src")).select("node", F.col("dst").alias("class"))).distinct(), "classes")
        return self._classes

    def targets(self, shape: Shape) -> DataFrame:
        out = self.spark.createDataFrame([(n,) for n in shape.parameters.get("targetNode", [])], "focus string")
        classes = list(shape.parameters.get("targetClass", []))
        if iri(RDFS + "Class") in self.shapes.by.get(shape.node, {}).get(TYPE, ()):
            classes.append(shape.node)
        if classes:
            out = out.unionByName(self.instances().where(F.col("class").isin(classes)).select(F.col("node").alias("focus")))
        for name, column in (("targetSubjectsOf", "s"), ("targetObjectsOf", "o")):
            for p in shape.parameters.get(name, []):
                out = out.unionByName(self.triples.where(F.col("p") == p).select(F.col(column).alias("focus")))
        for w in shape.parameters.get("targetWhere", []):
            nodes = self.triples.select(F.col("s").alias("focus")).union(self.triples.select("o")).distinct()
            out = out.unionByName(self.conforming(self.shapes.shape(w), nodes, True))
        return out.distinct()

    def values(self, shape: Shape, focus: DataFrame) -> DataFrame:
        """(focus, value): the value nodes, a set; of a node shape the focus nodes themselves."""
        if shape.path is None:
            return focus.select("focus", F.col("focus").alias("value"))
        pairs = paths.pairs(shape.path, self.ctx).distinct()
        return focus.join(pairs, F.col("focus") == F.col("src")).select("focus", F.col("dst").alias("value")).distinct()

    def conforming(self, shape: Shape, nodes: DataFrame, yes: bool) -> DataFrame:
        """The nodes (column focus) that conform to a shape, or those that don't."""
        bad = self.violations(shape, nodes, nested=True).select("focus").distinct()
        return nodes.join(bad, "focus", "left_anti" if yes else "left_semi")

    def violations(self, shape: Shape, focus: DataFrame, nested: bool = False) -> DataFrame:
        out = self.spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS))
        if shape.deactivated:
            return out
        values = settle(self.values(shape, focus), "values")
        for name, args in shape.parameters.items():
            if name in self.evaluators:
                for arg in args:
                    found = self.evaluators[name](self, shape, focus, values, arg)
                    if "component" not in found.columns:
                        found = found.select(
                            "focus", F.lit(shape.path_text).cast("string").alias("path"), "value" if "value" in found.columns else F.lit(None).cast("string").alias("value"),
                            F.lit(SH + name[0].upper() + name[1:] + "ConstraintComponent").alias("component"), F.lit(shape.severity).alias("severity"), F.lit(shape.node).alias("shape"),
                        )
                    out = out.unionByName(found.select(*COLUMNS))
        own = _custom(self, shape, values)
        return out if own is None else out.unionByName(own)

    def report(self) -> DataFrame:
        """All results, as (focus, path, value, component, severity, shape); none if the data conform."""
        out = None
        for node in self.shapes.roots:
            shape = self.shapes.shape(node)
            if any(p.startswith("target") for p in shape.parameters) or iri(RDFS + "Class") in self.shapes.by.get(node, {}).get(TYPE, ()):
                found = self.violations(shape, settle(self.targets(shape), "targets"))
                out = found if out is None else out.unionByName(found)
        return out if out is not None else self.spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS))

    def conforms(self) -> bool:
        return self.report().isEmpty()


def report_quads(report: DataFrame) -> DataFrame:
    """A report as RDF."""
    node = F.concat(F.lit("Br"), F.substring(F.sha1(F.to_json(F.struct(*COLUMNS))), 1, 16))
    pairs = [(TYPE, F.lit(iri(SH + "ValidationResult"))), (iri(SH + "focusNode"), F.col("focus")), (iri(SH + "resultPath"), F.col("path")), (iri(SH + "value"), F.col("value")), (iri(SH + "sourceConstraintComponent"), F.concat(F.lit("I"), F.col("component"))), (iri(SH + "resultSeverity"), F.col("severity")), (iri(SH + "sourceShape"), F.col("shape"))]
    rows = report.select(node.alias("s"), F.explode(F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in pairs])).alias("x"))
    return rows.select("s", "x.p", "x.o", F.lit(None).cast("string").alias("g")).where("o IS NOT NULL")


# evaluators
def _int(arg: str) -> int:
    return int(t.parse_term(arg)[1])


def _value_test(test: Callable[[Validator, Shape, str], F]) -> Evaluator:
    """A constraint on each value node by itself: those for which the test isn't true."""

    def run(v: Validator, shape: Shape, focus: DataFrame, values: DataFrame, arg: str) -> DataFrame:
        return values.where(~F.coalesce(test(v, shape, arg), F.lit(False)))

    return run


def _compared(name: str) -> Evaluator:
    def test(v: Validator, shape: Shape, arg: str):
        x, bound = Val("term", F.col("value")), Val("term", F.lit(arg))
        return {"minInclusive": t.less(bound, x, True), "minExclusive": t.less(bound, x, False), "maxInclusive": t.less(x, bound, True), "maxExclusive": t.less(x, bound, False)}[name]

    return _value_test(test)


def _length() -> F:
    return F.when(~F.col("value").startswith("B"), F.char_length(t.lexical(F.col("value"))))


_KINDS = {"BlankNode": "B", "IRI": "I", "Literal": "L", "BlankNodeOrIRI": "BI", "BlankNodeOrLiteral": "BL", "IRIOrLiteral": "IL"}
# fixed values: patterns of the lexical forms of the datatypes that are checked
_FORMS = {
    **{n: r"^[+-]?\d+$" for n in t.INTEGERS}, "decimal": r"^[+-]?(\d+(\.\d*)?|\.\d+)$", "boolean": "^(true|false|1|0)$", "date": r"^-?\d{4,}-\d\d-\d\d(Z|[+-]\d\d:\d\d)?$",
    "double": r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$", "float": r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$",
    "dateTime": r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$", "time": r"^\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$",
}


def _datatype(v: Validator, shape: Shape, arg: str):
    c = F.col("value")
    ok = t.datatype(c) == arg[1:]
    form = _FORMS.get(arg[1:].removeprefix(XSD)) if arg[1:].startswith(XSD) else None
    return ok & t.lexical(c).rlike(form) if form else ok


def _pattern(v: Validator, shape: Shape, arg: str):
    flags = t.parse_term(shape.parameters["flags"][0])[1] if shape.parameters.get("flags") else ""
    return F.when(~F.col("value").startswith("B"), t.lexical(F.col("value")).rlike((f"(?{flags})" if flags else "") + t.parse_term(arg)[1]))


def _language_in(v: Validator, shape: Shape, arg: str):
    lang = F.lower(t.language(F.col("value")))
    out = F.lit(False)
    for item in v.shapes.list_of(arg):
        tag = t.parse_term(item)[1].lower()
        out = out | (lang == tag) | lang.startswith(tag + "-")
    return out


def _counted(v: Validator, focus: DataFrame, values: DataFrame) -> DataFrame:
    n = values.groupBy("focus").agg(F.count(F.lit(1)).alias("n"))
    return focus.select("focus").distinct().join(n, "focus", "left").select("focus", F.coalesce("n", F.lit(0)).alias("n"))


def _class(v, shape, focus, values, arg):
    members = v.instances().where(F.col("class") == arg).select(F.col("node").alias("value"))
    return values.join(members, "value", "left_anti")


def _has_value(v, shape, focus, values, arg):
    return focus.select("focus").distinct().join(values.where(F.col("value") == arg), "focus", "left_anti")


def _others(v: Validator, values: DataFrame, predicate: str) -> DataFrame:
    return v.triples.where(F.col("p") == predicate).select(F.col("s").alias("focus"), F.col("o").alias("other")).distinct()


def _equals(v, shape, focus, values, arg):
    other = focus.select("focus").distinct().join(_others(v, values, arg), "focus").select("focus", F.col("other").alias("value"))
    return values.join(other, ["focus", "value"], "left_anti").unionByName(other.join(values, ["focus", "value"], "left_anti"))


def _disjoint(v, shape, focus, values, arg):
    return values.join(_others(v, values, arg).withColumnRenamed("other", "value"), ["focus", "value"], "left_semi")


def _subset(v, shape, focus, values, arg):
    return values.join(_others(v, values, arg).withColumnRenamed("other", "value"), ["focus", "value"], "left_anti")


def _less(or_equal: bool) -> Evaluator:
    def run(v, shape, focus, values, arg):
        pairs = values.join(_others(v, values, arg), "focus")
        return pairs.where(~F.coalesce(t.less(Val("term", F.col("value")), Val("term", F.col("other")), or_equal), F.lit(False))).select("focus", "value")

    return run


def _unique_lang(v, shape, focus, values, arg):
    if not arg.endswith("\x01true"):
        return values.where(F.lit(False))
    lang = F.lower(t.language(F.col("value")))
    return values.where(F.coalesce(lang, F.lit("")) != "").groupBy("focus", lang.alias("l")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("focus")


def _closed(v, shape, focus, values, arg):
    if not arg.endswith("\x01true"):
        return values.where(F.lit(False))
    allowed = [v.shapes.get(p, "path")[0] for p in shape.parameters.get("property", []) if v.shapes.get(p, "path")]
    for head in shape.parameters.get("ignoredProperties", []):
        allowed += v.shapes.list_of(head)
    rows = v.triples.join(focus.select(F.col("focus").alias("s")).distinct(), "s", "left_semi").where(~F.col("p").isin(allowed) if allowed else F.lit(True))
    return rows.select(F.col("s").alias("focus"), F.col("p").alias("path"), F.col("o").alias("value"), F.lit(SH + "ClosedConstraintComponent").alias("component"), F.lit(shape.severity).alias("severity"), F.lit(shape.node).alias("shape"))


def _failing(v: Validator, values: DataFrame, shape_node: str) -> DataFrame:
    """(value) of the distinct value nodes that don't conform to a shape."""
    nodes = settle(values.select(F.col("value").alias("focus")).distinct(), "nodes")
    return v.conforming(v.shapes.shape(shape_node), nodes, False).select(F.col("focus").alias("value"))


def _node(v, shape, focus, values, arg):
    return values.join(_failing(v, values, arg), "value", "left_semi")


def _not(v, shape, focus, values, arg):
    return values.join(_failing(v, values, arg), "value", "left_anti")


def _property(v, shape, focus, values, arg):
    inner = v.shapes.shape(arg)
    return v.violations(inner, settle(values.select(F.col("value").alias("focus")).distinct(), "nodes"))


def _logical(name: str) -> Evaluator:
    def run(v, shape, focus, values, arg):
        members = v.shapes.list_of(arg)
        failed = None
        for m in members:
            one = _failing(v, values, m).withColumn("n", F.lit(1))
            failed = one if failed is None else failed.unionByName(one)
        if failed is None:
            return values.where(F.lit(name in ("or", "xone")))
        n = values.join(failed.groupBy("value").agg(F.sum("n").alias("n")), "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        bad = {"and": F.col("n") > 0, "or": F.col("n") == len(members), "xone": F.col("n") != len(members) - 1}[name]
        return n.where(bad).select("focus", "value")

    return run


def _qualified(v, shape, focus, values, arg):
    """Both counts of a qualified value shape; siblings' values are left out where they are to be disjoint."""
    good = values.join(_failing(v, values, arg), "value", "left_anti")
    if shape.parameters.get("qualifiedValueShapesDisjoint", [""])[0].endswith("\x01true"):
        parents = [n for n, ps in v.shapes.by.items() if shape.node in ps.get(iri(SH + "property"), ())]
        siblings = {q for n in parents for p in v.shapes.get(n, "property") if p != shape.node for q in v.shapes.get(p, "qualifiedValueShape")} - {arg}
        for q in sorted(siblings):
            good = good.join(_failing(v, values, q), "value", "left_semi")
    n = _counted(v, focus, good)
    out = None
    for name, bad in (("qualifiedMinCount", lambda k: F.col("n") < k), ("qualifiedMaxCount", lambda k: F.col("n") > k)):
        for k in shape.parameters.get(name, []):
            component = F.lit(SH + "Q" + name[1:] + "ConstraintComponent")
            one = n.where(bad(_int(k))).select("focus", F.lit(shape.path_text).cast("string").alias("path"), F.lit(None).cast("string").alias("value"), component.alias("component"), F.lit(shape.severity).alias("severity"), F.lit(shape.node).alias("shape"))
            out = one if out is None else out.unionByName(one)
    return out if out is not None else values.where(F.lit(False)).select("focus", "value")


def _sparql(v, shape, focus, values, arg):
    """A SELECT whose $this is joined to all focus nodes at once."""
    text = t.parse_term(v.shapes.get(arg, "select")[0])[1].replace("$this", "?this").replace("$PATH", f"<{(shape.path_text or 'I')[1:]}>")
    prefixes = dict(v.data.prefixes)
    for head in v.shapes.get(arg, "prefixes"):
        for d in v.shapes.get(head, "declare"):
            prefixes[t.parse_term(v.shapes.get(d, "prefix")[0])[1]] = t.parse_term(v.shapes.get(d, "namespace")[0])[1]
    found = replace(v.data, prefixes=prefixes).query(text).terms()
    value = F.col("value") if "value" in found.columns else F.col("this")
    rows = found.select(F.col("this").alias("focus"), value.alias("value")).join(focus.select("focus").distinct(), "focus", "left_semi")
    return rows.select("focus", F.lit(shape.path_text).cast("string").alias("path"), "value", F.lit(SH + "SPARQLConstraintComponent").alias("component"), F.lit(shape.severity).alias("severity"), F.lit(shape.node).alias("shape"))


def _list_members(v: Validator, values: DataFrame) -> DataFrame:
    """(focus, value, members) of value nodes that are heads of well-formed lists."""
    nil = iri(RDF + "nil")
    cells = v.triples.where(F.col("p") == iri(RDF + "first")).select(F.col("s").alias("cell"), F.col("o").alias("item"))
    links = v.triples.where(F.col("p") == iri(RDF + "rest")).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    walk = paths.closure(links, values.select(F.col("value").alias("src")), reflexive=True)
    ended = walk.where(F.col("dst") == nil).select("src").distinct()
    items = walk.join(cells, F.col("dst") == F.col("cell")).join(ended, "src", "left_semi").groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("hops", "item"))), lambda x: x["item"]).alias("members"))
    empty = values.where(F.col("value") == nil).select(F.col("value").alias("src"), F.array().cast("array<string>").alias("members"))
    return values.join(items.unionByName(empty.distinct()), F.col("value") == F.col("src")).select("focus", "value", "members")


def _list_test(test) -> Evaluator:
    def run(v, shape, focus, values, arg):
        lists = _list_members(v, values)
        bad = lists.where(test(arg)).select("focus", "value")
        return bad.unionByName(values.join(lists.select("focus", "value"), ["focus", "value"], "left_anti"))

    return run


def _member_shape(v, shape, focus, values, arg):
    items = _list_members(v, values).select("focus", F.explode("members").alias("value"))
    return items.join(_failing(v, items, arg), "value", "left_semi")


def _unique_values(v, shape, focus, values, arg):
    """Focus nodes that share their values of all the listed properties with another one."""
    row, names = focus.select("focus").distinct(), []
    for k, p in enumerate(v.shapes.list_of(arg)):
        row = row.join(v.triples.where(F.col("p") == p).select(F.col("s").alias("focus"), F.col("o").alias(f"k{k}")), "focus")
        names.append(f"k{k}")
    shared = row.groupBy(*names).agg(F.count_distinct("focus").alias("n")).where("n > 1").drop("n")
    return row.join(shared, names, "left_semi").select("focus").distinct()


def _reifier(v, shape, focus, values, arg):
    """Reifiers of the triples from focus to value must conform."""
    term = F.concat(F.lit("T"), F.concat_ws("\x02", "focus", F.lit(shape.path_text), "value"))
    reified = v.triples.where(F.col("p") == iri(RDF + "reifies")).select(F.col("s").alias("r"), F.col("o").alias("_t"))
    met = settle(values.withColumn("_t", term).join(reified, "_t").select("focus", F.col("r").alias("value")), "reifiers")
    return met.join(_failing(v, met, arg), "value", "left_semi")


def _custom(v: Validator, shape: Shape, values: DataFrame) -> DataFrame | None:
    """Results of the shapes graph's own components that the shape has all parameters of."""
    out = None
    for node, ps in v.shapes.by.items():
        if iri(SH + "ConstraintComponent") not in ps.get(TYPE, ()):
            continue
        given = {}
        for p in v.shapes.get(node, "parameter"):
            name = v.shapes.get(p, "path")[0]
            value = v.shapes.by.get(shape.node, {}).get(name)
            optional = v.shapes.get(p, "optional")[:1] and v.shapes.get(p, "optional")[0].endswith("\x01true")
            if value:
                given[name.rsplit("/", 1)[-1].rsplit("#", 1)[-1]] = value[0]
            elif not optional:
                given = None
                break
        if not given:
            continue
        for role in ("validator", "nodeValidator", "propertyValidator"):
            for validator in v.shapes.get(node, role):
                kind = "ask" if v.shapes.get(validator, "ask") else "select"
                text = t.parse_term(v.shapes.get(validator, kind)[0])[1]
                for name, term in given.items():
                    text = text.replace(f"${name}", ntriples_term(term)).replace(f"?{name}", ntriples_term(term))
                pattern = parse_query(text.replace("$", "?"), v.data.prefixes).pattern
                while isinstance(pattern, (A.Project, A.Distinct, A.Slice, A.OrderBy)):
                    pattern = pattern.input
                rows = Solutions(values.select(F.col("focus").alias("this"), "value"), {"this": "term", "value": "term"}, frozenset({"this", "value"}))
                bad = semi(rows, pattern, v.ctx, "left_anti" if kind == "ask" else "left_semi").df
                one = bad.select(F.col("this").alias("focus"), F.lit(shape.path_text).cast("string").alias("path"), "value", F.lit(node[1:]).alias("component"), F.lit(shape.severity).alias("severity"), F.lit(shape.node).alias("shape"))
                out = one if out is None else out.unionByName(one)
    return out


def _root_class(v, shape, focus, values, arg):
    up = paths.closure(v.triples.where(F.col("p") == iri(RDFS + "subClassOf")).select(F.col("s").alias("src"), F.col("o").alias("dst")))
    return values.where(F.col("value") != arg).join(up.where(F.col("dst") == arg).select(F.col("src").alias("value")), "value", "left_anti")


EVALUATORS: dict[str, Evaluator] = {
    "class": _class, "datatype": _value_test(_datatype), "nodeKind": _value_test(lambda v, s, a: F.substring("value", 1, 1).isin(list(_KINDS[a[1 + len(SH) :]]))),
    "minCount": lambda v, s, f, x, a: _counted(v, f, x).where(F.col("n") < _int(a)).select("focus"), "maxCount": lambda v, s, f, x, a: _counted(v, f, x).where(F.col("n") > _int(a)).select("focus"),
    **{n: _compared(n) for n in ("minInclusive", "minExclusive", "maxInclusive", "maxExclusive")},
    "minLength": _value_test(lambda v, s, a: _length() >= _int(a)), "maxLength": _value_test(lambda v, s, a: _length() <= _int(a)), "pattern": _value_test(_pattern),
    "singleLine": _value_test(lambda v, s, a: F.lit(not a.endswith("\x01true")) | ~t.lexical(F.col("value")).rlike("[\\n\\r]")),
    "languageIn": _value_test(_language_in), "uniqueLang": _unique_lang, "equals": _equals, "disjoint": _disjoint, "subsetOf": _subset, "lessThan": _less(False), "lessThanOrEquals": _less(True),
    "hasValue": _has_value, "in": _value_test(lambda v, s, a: F.col("value").isin(v.shapes.list_of(a))), "closed": _closed, "node": _node, "not": _not, "property": _property,
    "and": _logical("and"), "or": _logical("or"), "xone": _logical("xone"), "qualifiedValueShape": _qualified, "sparql": _sparql,
    "minListLength": _list_test(lambda a: F.size("members") < _int(a)), "maxListLength": _list_test(lambda a: F.size("members") > _int(a)),
    "uniqueMembers": _list_test(lambda a: F.lit(a.endswith("\x01true")) & (F.size(F.array_distinct("members")) < F.size("members"))), "memberShape": _member_shape, "rootClass": _root_class, "uniqueValuesFor": _unique_values, "reifierShape": _reifier,
}
