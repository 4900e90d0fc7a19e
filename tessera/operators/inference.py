"""RDFS and OWL 2 RL entailment over quads, as rounds of joins to a fixpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import OWL, RDF, RDFS, iri
from ..shared import settle
from .graph import components
from .paths import closure, lists

TYPE, FIRST, REST, NIL = iri(RDF + "type"), iri(RDF + "first"), iri(RDF + "rest"), iri(RDF + "nil")
SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = (iri(RDFS + x) for x in ("subClassOf", "subPropertyOf", "domain", "range"))
SAME = iri(OWL + "sameAs")


def _o(name: str) -> str:
    return iri(OWL + name)


def _edges(triples: DataFrame, predicate: str) -> DataFrame:
    return triples.where(F.col("p") == predicate).select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()


def _resource(c: str) -> F:
    return ~F.col(c).startswith("L")


#: Rows up to which a schema is held against the data by each task; larger ones are joined with a shuffle.
SCHEMA = 20_000


def _schema(df: DataFrame, most: int = SCHEMA) -> tuple[DataFrame, list | None]:
    """A relation (src, dst) of axioms, and its distinct src for a condition on the data (None if there are too many)."""
    held = settle(df, "schema")
    if held.count() > most:
        return held, None
    found = [r["src"] for r in held.select("src").distinct().limit(201).collect()]
    return F.broadcast(held), found if len(found) <= 200 else None


def _among(c: str, values: list | None) -> Column:
    return F.lit(True) if values is None else F.col(c).isin(values) if values else F.lit(False)


def rdfs(triples: DataFrame, provenance: bool = False) -> DataFrame:
    """Triples (s, p, o) that rdfs2, 3, 5, 7, 9 and 11 add; with provenance the rule of each (the first by name).

    The closures of subClassOf and subPropertyOf come first; then superproperties are derived before domains, ranges and
    superclasses, so one pass over the data is enough unless the schema speaks about its own vocabulary. The data are read
    where a rule's axioms name the predicate or class, and are not shuffled; repeats in the data make none in the result.
    """
    given = triples.select("s", "p", "o")
    derived = None
    base = given
    while True:
        closed = closure(_edges(base, SUBCLASS)), closure(_edges(base, SUBPROPERTY))
        (classes, subs), (properties, lower) = (_schema(x.select("src", "dst")) for x in closed)
        (domains, with_domain), (ranges, with_range) = (_schema(_edges(base, x)) for x in (DOMAIN, RANGE))

        def rows(df: DataFrame, rule: str) -> DataFrame:
            return df.select("s", "p", "o", F.lit(rule).alias("rule"))

        out = [
            rows(classes.select(F.col("src").alias("s"), F.lit(SUBCLASS).alias("p"), F.col("dst").alias("o")), "rdfs11"),
            rows(properties.select(F.col("src").alias("s"), F.lit(SUBPROPERTY).alias("p"), F.col("dst").alias("o")), "rdfs5"),
        ]
        inherited = rows(base.where(_among("p", lower)).join(properties.where(F.col("dst").startswith("I")), F.col("p") == F.col("src")).select("s", F.col("dst").alias("p"), "o"), "rdfs7")
        out.append(inherited)
        every = base.unionByName(inherited.select("s", "p", "o"))
        typed = [
            rows(every.where(_among("p", with_domain)).join(domains, F.col("p") == F.col("src")).select("s", F.lit(TYPE).alias("p"), F.col("dst").alias("o")), "rdfs2"),
            rows(every.where(_among("p", with_range)).join(ranges, F.col("p") == F.col("src")).where(_resource("o")).select(F.col("o").alias("s"), F.lit(TYPE).alias("p"), F.col("dst").alias("o")), "rdfs3"),
        ]
        out += typed
        types = every.where(F.col("p") == TYPE).select("s", "o")
        for x in typed:
            types = types.unionByName(x.select("s", "o"))
        out.append(rows(types.where(_among("o", subs)).join(classes, F.col("o") == F.col("src")).select("s", F.lit(TYPE).alias("p"), F.col("dst").alias("o")), "rdfs9"))
        found = out[0]
        for x in out[1:]:
            found = found.unionByName(x)
        # only what has a predicate, and with types a class, that a rule gives can be known already
        classes_given = _targets(classes, domains, ranges)
        gives = _targets(properties)
        known = base if gives is None else base.where(F.col("p").isin(TYPE, SUBCLASS, SUBPROPERTY, *gives))
        if classes_given is not None and gives is not None and TYPE not in gives:
            known = known.where((F.col("p") != TYPE) | _among("o", classes_given))
        new = found.groupBy("s", "p", "o").agg(F.min("rule").alias("rule")).join(known, ["s", "p", "o"], "left_anti")
        new = settle(new, "rdfs")
        derived = new if derived is None else derived.unionByName(new)
        if new.where(F.col("p").isin(SUBCLASS, SUBPROPERTY, DOMAIN, RANGE) & ~F.col("rule").isin("rdfs5", "rdfs11")).isEmpty():
            return derived if provenance else derived.drop("rule")
        base = base.unionByName(new.select("s", "p", "o"))


def _targets(*relations: DataFrame) -> list | None:
    """The distinct dst of relations of axioms, or None if there are too many."""
    out = None
    for x in relations:
        out = x.select("dst") if out is None else out.union(x.select("dst"))
    found = [r["dst"] for r in out.distinct().limit(201).collect()]
    return found if len(found) <= 200 else None


def types_of(triples: DataFrame) -> Callable[[str], list[str]]:
    """For query-time expansion: the classes (schema-sized, so on the driver) whose members also belong to a class."""
    below: dict[str, set[str]] = {}
    for r in closure(_edges(triples, SUBCLASS)).select("src", "dst").toLocalIterator():
        below.setdefault(r["dst"], set()).add(r["src"])
    return lambda cls: [cls, *sorted(below.get(cls, ()))]


#: Predicates and classes of axioms that a rule needs at least one of.
_AXIOMS = frozenset((SUBCLASS, SUBPROPERTY, DOMAIN, RANGE, SAME, *map(_o, """equivalentProperty inverseOf equivalentClass oneOf unionOf intersectionOf hasValue onProperty someValuesFrom
    allValuesFrom maxCardinality propertyChainAxiom hasKey disjointWith complementOf members differentFrom propertyDisjointWith sourceIndividual assertionProperty targetIndividual targetValue""".split())))  # fmt: skip
_KINDS = frozenset(map(_o, "SymmetricProperty TransitiveProperty FunctionalProperty InverseFunctionalProperty AllDisjointClasses IrreflexiveProperty AsymmetricProperty".split()))


def _axiom() -> Column:
    return F.col("p").isin(*sorted(_AXIOMS - {SAME})) | (F.col("p") == TYPE) & F.col("o").isin(*sorted(_KINDS))


class _Rules:
    """The OWL 2 RL rules over one state of the triples; each gives derived triples (s, p, o).

    A rule without its axioms is left out; the others read only the predicates and classes of the data that their axioms
    name (as long as those are few), with the axioms held by each task.
    """

    def __init__(self, t: DataFrame, members: DataFrame):
        self.t = t
        axioms = settle(t.where(_axiom()).distinct(), "axioms")
        self.present = {r["x"] for r in axioms.select(F.when(F.col("p") == TYPE, F.col("o")).otherwise(F.col("p")).alias("x")).distinct().collect()}
        few = axioms.count() <= SCHEMA
        self.axioms, self.known = (F.broadcast(axioms), axioms.collect()) if few else (axioms, None)
        few = members.count() <= SCHEMA
        self.members = F.broadcast(members) if few else members  # (head, at, member) of every RDF list
        self.listed = [(r["head"], r["member"]) for r in members.collect()] if few else None

    def names(self) -> list | None:
        """The terms that the axioms and their lists name, or None if they are too many to list: no rule reads other predicates or classes."""
        if self.known is None or self.listed is None:
            return None
        found = {r[c] for r in self.known for c in "so"}
        found |= {m for h, m in self.listed if h in found}
        return sorted(found) if len(found) <= 1000 else None

    def has(self, *axioms: str) -> bool:
        return all(x in self.present for x in axioms)

    def of(self, predicate: str, s: str, o: str) -> DataFrame:
        rows = self.axioms if predicate in _AXIOMS and predicate != SAME else self.t
        return rows.where(F.col("p") == predicate).select(F.col("s").alias(s), F.col("o").alias(o))

    def named(self, axiom: str, end: str = "s") -> list | None:
        """What the axioms of a kind name at that end, or None if it is too much to list."""
        if self.known is None:
            return None
        found = {r[end] for r in self.known if axiom in (r["p"], r["o"] if r["p"] == TYPE else None)}
        return sorted(found) if len(found) <= 200 else None

    def parts(self, axiom: str) -> list | None:
        """The members of the lists that the axioms of a kind name."""
        heads = self.named(axiom, "o")
        if heads is None or self.listed is None:
            return None
        found = {m for h, m in self.listed if h in heads}
        return sorted(found) if len(found) <= 200 else None

    def facts(self, s: str, p: str, o: str, among: list | None = None) -> DataFrame:
        return self.t.where(_among("p", among)).select(F.col("s").alias(s), F.col("p").alias(p), F.col("o").alias(o))

    def types(self, among: list | None = None) -> DataFrame:
        """(x, c): the members of these classes, of all if None."""
        return self.t.where((F.col("p") == TYPE) & _among("o", among)).select(F.col("s").alias("x"), F.col("o").alias("c"))

    def typed(self, cls: str, name: str) -> DataFrame:
        rows = self.axioms if cls in _KINDS else self.t
        return rows.where((F.col("p") == TYPE) & (F.col("o") == cls)).select(F.col("s").alias(name))

    @staticmethod
    def out(df: DataFrame, s, p, o) -> DataFrame:
        column = lambda x: x if not isinstance(x, str) else F.lit(x) if x[0] in "IL" and len(x) > 3 else F.col(x)
        return df.select(column(s).alias("s"), column(p).alias("p"), column(o).alias("o"))

    def all(self) -> list[DataFrame]:
        """One relation for each rule whose axioms there are."""
        out, of, facts, types, typed, named, parts = self.out, self.of, self.facts, self.types, self.typed, self.named, self.parts
        symmetric, transitive, functional, inverse_functional = map(_o, ("SymmetricProperty", "TransitiveProperty", "FunctionalProperty", "InverseFunctionalProperty"))
        same_property, inverse, same_class, one, union, both = map(_o, ("equivalentProperty", "inverseOf", "equivalentClass", "oneOf", "unionOf", "intersectionOf"))
        value, on, some, every, most = map(_o, ("hasValue", "onProperty", "someValuesFrom", "allValuesFrom", "maxCardinality"))
        links = lambda axiom, end="s": facts("x", "q", "y", named(axiom, end))
        rules = [
            # property axioms
            (DOMAIN, lambda: out(links(DOMAIN).join(of(DOMAIN, "q", "c"), "q"), "x", TYPE, "c")),
            (RANGE, lambda: out(links(RANGE).join(of(RANGE, "q", "c"), "q").where(_resource("y")), "y", TYPE, "c")),
            (symmetric, lambda: out(links(symmetric).join(typed(symmetric, "q"), "q").where(_resource("y")), "y", F.col("q"), "x")),
            (transitive, lambda: out(links(transitive).join(typed(transitive, "q"), "q").join(facts("y", "q", "z", named(transitive)), ["q", "y"]), "x", F.col("q"), "z")),
            (SUBPROPERTY, lambda: out(links(SUBPROPERTY).join(of(SUBPROPERTY, "q", "q2"), "q"), "x", F.col("q2"), "y")),
            (same_property, lambda: out(links(same_property).join(of(same_property, "q", "q2"), "q"), "x", F.col("q2"), "y")),
            (same_property, lambda: out(links(same_property, "o").join(of(same_property, "q2", "q"), "q"), "x", F.col("q2"), "y")),
            (inverse, lambda: out(links(inverse).join(of(inverse, "q", "q2"), "q").where(_resource("y")), "y", F.col("q2"), "x")),
            (inverse, lambda: out(links(inverse, "o").join(of(inverse, "q2", "q"), "q").where(_resource("y")), "y", F.col("q2"), "x")),
            (functional, lambda: out(_to_least(links(functional).join(typed(functional, "q"), "q"), ["x", "q"], "y"), "y", SAME, "least")),
            (inverse_functional, lambda: out(_to_least(links(inverse_functional).join(typed(inverse_functional, "q"), "q"), ["y", "q"], "x"), "x", SAME, "least")),
            # classes
            (SUBCLASS, lambda: out(types(named(SUBCLASS)).join(of(SUBCLASS, "c", "d"), "c"), "x", TYPE, "d")),
            (same_class, lambda: out(types(named(same_class)).join(of(same_class, "c", "d"), "c"), "x", TYPE, "d")),
            (same_class, lambda: out(types(named(same_class, "o")).join(of(same_class, "d", "c"), "c"), "x", TYPE, "d")),
            (one, lambda: out(of(one, "c", "head").join(self.members, "head"), "member", TYPE, "c")),
            (union, lambda: out(types(parts(union)).join(of(union, "d", "head").join(self.members.withColumnRenamed("member", "c"), "head"), "c"), "x", TYPE, "d")),
            (both, lambda: out(types(named(both)).withColumnRenamed("c", "d").join(of(both, "d", "head").join(self.members, "head"), "d"), "x", TYPE, "member")),
            (both, lambda: out(self.intersections(), "x", TYPE, "d")),
            # restrictions
            ((value, on), lambda: out(types(named(value)).join(of(value, "c", "v").join(of(on, "c", "q"), "c"), "c"), "x", F.col("q"), "v")),
            ((value, on), lambda: out(facts("x", "q", "v", named(on, "o")).join(of(value, "c", "v").join(of(on, "c", "q"), "c"), ["q", "v"]), "x", TYPE, "c")),
            ((some, on), lambda: out(facts("x", "q", "y", named(on, "o")).join(of(some, "d", "c").join(of(on, "d", "q"), "d"), "q").join(types(named(some, "o")).select(F.col("x").alias("y"), "c"), ["y", "c"]), "x", TYPE, "d")),
            ((some, on), lambda: out(facts("x", "q", "y", named(on, "o")).join(of(some, "d", "c").where(F.col("c") == _o("Thing")).join(of(on, "d", "q"), "d"), "q"), "x", TYPE, "d")),
            ((every, on), lambda: out(types(named(every)).join(of(every, "c", "d").join(of(on, "c", "q"), "c"), "c").join(facts("x", "q", "y", named(on, "o")), ["x", "q"]).where(_resource("y")), "y", TYPE, "d")),
            ((most, on), lambda: out(self.at_most_one(), "y", SAME, "least")),
            # schema
            (SUBCLASS, lambda: out(of(SUBCLASS, "c", "d").join(of(SUBCLASS, "d", "e"), "d"), "c", SUBCLASS, "e")),
            (SUBPROPERTY, lambda: out(of(SUBPROPERTY, "c", "d").join(of(SUBPROPERTY, "d", "e"), "d"), "c", SUBPROPERTY, "e")),
            (same_class, lambda: out(of(same_class, "c", "d"), "c", SUBCLASS, "d")), (same_class, lambda: out(of(same_class, "c", "d"), "d", SUBCLASS, "c")),
            (same_property, lambda: out(of(same_property, "c", "d"), "c", SUBPROPERTY, "d")), (same_property, lambda: out(of(same_property, "c", "d"), "d", SUBPROPERTY, "c")),
            ((DOMAIN, SUBCLASS), lambda: out(of(DOMAIN, "q", "c").join(of(SUBCLASS, "c", "d"), "c"), "q", DOMAIN, "d")), ((RANGE, SUBCLASS), lambda: out(of(RANGE, "q", "c").join(of(SUBCLASS, "c", "d"), "c"), "q", RANGE, "d")),
            ((DOMAIN, SUBPROPERTY), lambda: out(of(DOMAIN, "q", "c").join(of(SUBPROPERTY, "r", "q"), "q"), "r", DOMAIN, "c")), ((RANGE, SUBPROPERTY), lambda: out(of(RANGE, "q", "c").join(of(SUBPROPERTY, "r", "q"), "q"), "r", RANGE, "c")),
            (both, lambda: out(of(both, "c", "head").join(self.members, "head"), "c", SUBCLASS, "member")),
            (union, lambda: out(of(union, "c", "head").join(self.members, "head"), "member", SUBCLASS, "c")),
        ]
        return [f() for needs, f in rules if self.has(*([needs] if isinstance(needs, str) else needs))] + self.chains() + self.keys()

    def intersections(self) -> DataFrame:
        parts = self.of(_o("intersectionOf"), "d", "head").join(self.members.withColumnRenamed("member", "c"), "head")
        size = parts.groupBy("d").agg(F.count_distinct("c").alias("n"))
        held = self.types(self.parts(_o("intersectionOf"))).join(parts, "c").groupBy("x", "d").agg(F.count_distinct("c").alias("m"))
        return held.join(size, "d").where("m = n")

    def at_most_one(self) -> DataFrame:
        axioms = self.of(_o("maxCardinality"), "c", "k").where("k LIKE '%\x011'").join(self.of(_o("onProperty"), "c", "q"), "c")
        one = self.types(self.named(_o("maxCardinality"))).join(axioms, "c")
        return _to_least(one.join(self.facts("x", "q", "y", self.named(_o("onProperty"), "o")), ["x", "q"]), ["x", "q"], "y")

    def chains(self) -> list[DataFrame]:
        """One join for each link of each property chain; axioms are schema-sized, so their lists are read on the driver."""
        rows = self.of(_o("propertyChainAxiom"), "q", "head").collect() if self.has(_o("propertyChainAxiom")) else []
        out = []
        for r in rows:
            parts = [x["member"] for x in self.members.where(F.col("head") == r["head"]).orderBy("at").collect()]
            walk = None
            for k, p in enumerate(parts):
                step = self.t.where(F.col("p") == p).select(F.col("s").alias(f"n{k}"), F.col("o").alias(f"n{k + 1}"))
                walk = step if walk is None else walk.join(step, f"n{k}").select("n0", f"n{k + 1}")
            if walk is not None:
                out.append(walk.select(F.col("n0").alias("s"), F.lit(r["q"]).alias("p"), F.col(f"n{len(parts)}").alias("o")))
        return out

    def keys(self) -> list[DataFrame]:
        out = []
        for r in self.of(_o("hasKey"), "c", "head").collect() if self.has(_o("hasKey")) else ():
            parts = [x["member"] for x in self.members.where(F.col("head") == r["head"]).collect()]
            row = self.t.where((F.col("p") == TYPE) & (F.col("o") == r["c"])).select(F.col("s").alias("x"))
            for k, p in enumerate(parts):
                row = row.join(self.t.where(F.col("p") == p).select(F.col("s").alias("x"), F.col("o").alias(f"k{k}")), "x")
            names = [f"k{k}" for k in range(len(parts))]
            if names:
                first = row.groupBy(*names).agg(F.min("x").alias("y"))
                out.append(row.join(first, names).where("x <> y").select(F.col("x").alias("s"), F.lit(SAME).alias("p"), F.col("y").alias("o")))
        return out

    def clashes(self) -> list[DataFrame]:
        """(rule, node) of what makes the triples inconsistent."""
        of, facts, typed = self.of, self.facts, self.typed
        types = self.types()

        def found(df: DataFrame, rule: str) -> DataFrame:
            return df.select(F.lit(rule).alias("rule"), F.col("x").alias("node")).distinct()

        pairs = types.join(types.withColumnRenamed("c", "d"), "x")
        everyone = self.members.select("head", F.col("member").alias("c")).join(self.members.select("head", F.col("member").alias("d")), "head").where("c < d")
        disjoint = everyone.join(of(_o("members"), "a", "head").join(typed(_o("AllDisjointClasses"), "a"), "a"), "head")
        links = facts("x", "q", "y")
        return [
            found(types.where(F.col("c") == _o("Nothing")), "cls-nothing2"),
            found(pairs.join(of(_o("disjointWith"), "c", "d"), ["c", "d"]), "cax-dw"), found(pairs.join(disjoint, ["c", "d"]), "cax-adc"),
            found(pairs.join(of(_o("complementOf"), "c", "d"), ["c", "d"]), "cls-com"),
            found(links.join(typed(_o("IrreflexiveProperty"), "q"), "q").where("x = y"), "prp-irp"),
            found(links.join(typed(_o("AsymmetricProperty"), "q"), "q").join(facts("y", "q", "x"), ["q", "x", "y"], "left_semi"), "prp-asyp"),
            found(links.join(of(_o("propertyDisjointWith"), "q", "r"), "q").join(facts("x", "r", "y"), ["x", "r", "y"]), "prp-pdw"),
            found(of(SAME, "x", "y").join(of(_o("differentFrom"), "x", "y"), ["x", "y"]), "eq-diff1"),
            found(of(_o("sourceIndividual"), "a", "x").join(of(_o("assertionProperty"), "a", "q"), "a").join(of(_o("targetIndividual"), "a", "y"), "a").join(links, ["x", "q", "y"]), "prp-npa1"),
            found(of(_o("sourceIndividual"), "a", "x").join(of(_o("assertionProperty"), "a", "q"), "a").join(of(_o("targetValue"), "a", "y"), "a").join(links, ["x", "q", "y"]), "prp-npa2"),
            found(types.join(of(_o("maxCardinality"), "c", "k").where("k LIKE '%\x010'"), "c").join(of(_o("onProperty"), "c", "q"), "c").join(links, ["x", "q"]), "cls-maxc1"),
        ]


def _to_least(rows: DataFrame, group: list[str], node: str) -> DataFrame:
    """Every resource of a group with the least one: as many links as connect the group, not all its pairs."""
    nodes = rows.where(_resource(node)).select(*group, node).distinct()
    return nodes.join(nodes.groupBy(*group).agg(F.min(node).alias("least")), group).where(F.col(node) != F.col("least"))


def _list_members(triples: DataFrame) -> DataFrame:
    cells = settle(triples.where(F.col("p").isin(FIRST, REST)).select("s", "p", "o"), "cells")
    quads = cells.withColumn("g", F.lit(None).cast("string"))
    return settle(lists(quads, FIRST, REST, NIL).select("head", F.posexplode("members").alias("at", "member")), "lists")


def canonical(triples: DataFrame) -> DataFrame:
    """(node, component) of the owl:sameAs cliques, named by their smallest member."""
    return components(_edges(triples, SAME))


def replaced(triples: DataFrame, cliques: DataFrame) -> DataFrame:
    """Triples over the cliques' representatives; sameAs itself is left to the cliques."""
    return _over(triples, cliques).distinct()


def _over(triples: DataFrame, cliques: DataFrame) -> DataFrame:
    out = triples.where(F.col("p") != SAME)
    for c in ("s", "p", "o"):
        names = cliques.select(F.col("node").alias(c), F.col("component").alias("_to"))
        out = out.join(names, c, "left").withColumn(c, F.coalesce("_to", c)).select("s", "p", "o")
    return out


def _represented(triples: DataFrame, cliques: DataFrame) -> DataFrame:
    """Triples over the cliques' representatives, with all sameAs; written only if there are too many cliques for a task."""
    n = cliques.count()
    if not n:
        return triples
    out = _over(triples, F.broadcast(cliques) if n <= SCHEMA else cliques).unionByName(triples.where(F.col("p") == SAME))
    return out if n <= SCHEMA else settle(out.distinct(), "owl")


def _like(triples: DataFrame, found: DataFrame) -> DataFrame:
    """The triples that have a predicate of found, and as types one of its classes: no others can be in it."""
    predicates = _targets(found.select(F.col("p").alias("dst")))
    if predicates is None:
        return triples
    classes = _targets(found.where(F.col("p") == TYPE).select(F.col("o").alias("dst")))
    return triples.where(F.col("p").isin(predicates) & ((F.col("p") != TYPE) | _among("o", classes)))


def owl_rl(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(closure over representatives, sameAs cliques). Rounds stop when neither a triple nor a clique is new.

    The given triples, in which repeats do no harm, stay where they are. Those with a predicate or class that an axiom
    names are written once for the rules, which read no others; rounds write only what they derive.
    """
    members = _list_members(triples)
    every = triples.select("s", "p", "o")
    same = settle(every.where(F.col("p") == SAME), "owl")
    cliques = settle(canonical(same), "owl")
    now, data, names = _represented(every, cliques), None, None
    while True:
        if data is None:
            names = _Rules(settle(now.where(_axiom()), "owl"), members).names()
            data = settle(now.where(_axiom() | _among("p", names) | (F.col("p") == TYPE) & _among("o", names)), "owl")
        rules = _Rules(data, members)
        more = rules.names()
        if names is not None and (more is None or not set(more) <= set(names)):
            data = None  # axioms were derived that name more
            continue
        derived = None
        for d in rules.all():
            derived = d if derived is None else derived.unionByName(d)
        if derived is None:
            return now.where(F.col("p") != SAME).distinct(), cliques
        derived = derived.where(F.col("s").isNotNull() & ~F.col("s").startswith("L") & ~((F.col("p") == SAME) & (F.col("s") == F.col("o"))))
        found = settle(derived.distinct(), "owl")
        new = settle(found.join(_like(now, found), ["s", "p", "o"], "left_anti"), "owl")
        if new.isEmpty():
            return now.where(F.col("p") != SAME).distinct(), cliques
        every, now, data = every.unionByName(new), now.unionByName(new), data.unionByName(new)
        added = settle(new.where(F.col("p") == SAME), "owl")
        if not added.isEmpty():
            same = same.unionByName(added)
            known = cliques.select(F.col("node").alias("s"), F.lit(SAME).alias("p"), F.col("component").alias("o"))
            cliques = settle(canonical(same.unionByName(known)), "owl")
            now, data = _represented(every, cliques), None


def expand(closed: DataFrame, cliques: DataFrame) -> DataFrame:
    """The closure with every member of a clique in its representative's place, and sameAs between all pairs of members."""
    out = closed
    for c in ("s", "o"):
        names = cliques.select(F.col("component").alias(c), F.col("node").alias("_to"))
        out = out.join(names, c, "left").withColumn(c, F.coalesce("_to", c)).select("s", "p", "o")
    a, b = cliques.select(F.col("node").alias("s"), "component"), cliques.select(F.col("node").alias("o"), "component")
    return out.unionByName(a.join(b, "component").select("s", F.lit(SAME).alias("p"), "o")).distinct()


def inconsistencies(closed: DataFrame, cliques: DataFrame | None = None) -> DataFrame:
    """(rule, node) for each inconsistency of a closure."""
    t = closed if cliques is None else closed.unionByName(cliques.select(F.col("node").alias("s"), F.lit(SAME).alias("p"), F.col("component").alias("o")))
    out = None
    for c in _Rules(settle(t, "owl"), _list_members(closed)).clashes():
        out = c if out is None else out.unionByName(c)
    return out.distinct()


def maintain(closed: DataFrame, added: DataFrame) -> DataFrame:
    """A closure kept up with added triples; what is known takes part in the joins but is not derived anew."""
    return owl_rl(closed.unionByName(added.select("s", "p", "o")))[0]


# SKOS
SKOS = "http://www.w3.org/2004/02/skos/core#"


def skos_transitive(triples: DataFrame, relation: str = "broader") -> DataFrame:
    """(concept, ancestor, hops) over skos:broader and the inverse of skos:narrower, or the other way round."""
    other = "narrower" if relation == "broader" else "broader"
    edges = _edges(triples, iri(SKOS + relation)).unionByName(_edges(triples, iri(SKOS + other)).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return closure(edges.distinct()).select(F.col("src").alias("concept"), F.col("dst").alias("ancestor"), "hops")


def skos_labels(triples: DataFrame, lang: str) -> DataFrame:
    """(concept, label): the preferred label in a language, else in none, else any."""
    from ..functions.terms import language, lexical

    labels = triples.where(F.col("p") == iri(SKOS + "prefLabel"))
    rank = F.when(language(F.col("o")) == lang, 0).when(language(F.col("o")) == "", 1).otherwise(2)
    return labels.groupBy(F.col("s").alias("concept")).agg(F.min_by(lexical(F.col("o")), F.struct(rank, "o")).alias("label"))
