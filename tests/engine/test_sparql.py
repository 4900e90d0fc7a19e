import pytest

from tessera.engine import Dataset
from tessera.functions import terms as t
from tessera.functions.terms import Val
from tessera.operators.update import ConflictError, GraphStore
from tessera.plans.parser import SparqlSyntaxError, parse_query
from tessera.sources import rdf

X = "http://x/"
DATA = """@prefix : <http://x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a :p :b ; :n 1 ; :label "one"@en, "eins"@de . :b :p :c ; :n 2.5 . :c :p :a ; :n "x" . :d a :T ; :list (1 2 3) ; :q [ :r "deep" ] .
:e :n 1.0e0 ; :when "2020-02-03T04:05:06"^^xsd:dateTime .
"""
GRAPHS = "GRAPH <http://x/g1> { <http://x/a> <http://x/p> 1 } <http://x/g2> { <http://x/a> <http://x/p> 2 . <http://x/b> <http://x/p> 1 }"


@pytest.fixture(scope="module")
def ds(spark):
    return Dataset(spark, spark.createDataFrame(rdf.parse_turtle(DATA + GRAPHS), rdf.QUADS), prefixes={"": X, "xsd": t.XSD})


def rows(ds, text):
    s = ds.query(text)
    return sorted(tuple(None if v is None else t.parse_term(v)[1] for v in r) for r in s.terms().collect())


CASES = [
    ("SELECT ?o { :a :p ?o }", [("http://x/b",)]),
    ("SELECT ?s { ?s :n ?v FILTER(?v = 1) }", [("http://x/a",), ("http://x/e",)]),
    ("SELECT ?s { ?s :n ?v FILTER(?v < 2) }", [("http://x/a",), ("http://x/e",)]),
    ("SELECT ?l { :a :label ?l FILTER(LANG(?l) = 'de') }", [("eins",)]),
    ("SELECT ?l { :a :label ?l FILTER LANGMATCHES(LANG(?l), 'EN') }", [("one",)]),
    ("SELECT ?x { :a :p+ ?x }", [("http://x/a",), ("http://x/b",), ("http://x/c",)]),
    ("SELECT ?x { :a :p* ?x }", [("http://x/a",), ("http://x/b",), ("http://x/c",)]),
    ("SELECT ?x { ?x :p+ :c }", [("http://x/a",), ("http://x/b",), ("http://x/c",)]),
    ("SELECT ?x { :zz :p* ?x }", [("http://x/zz",)]),
    ("SELECT ?x { :a :p? ?x }", [("http://x/a",), ("http://x/b",)]),
    ("SELECT ?x { :a !:p ?x }", [("1",), ("eins",), ("one",)]),
    ("SELECT ?x { ?x ^:p :c }", [("http://x/a",)]),
    ("SELECT ?x { :c ^:p/^:p ?x }", [("http://x/a",)]),
    ("SELECT ?v { :d :q/:r ?v }", [("deep",)]),
    ("SELECT ?m { :d :list/<http://www.w3.org/1999/02/22-rdf-syntax-ns#rest>*/<http://www.w3.org/1999/02/22-rdf-syntax-ns#first> ?m }", [("1",), ("2",), ("3",)]),
    ("SELECT ?s ?n { ?s :p ?o OPTIONAL { ?s :label ?n FILTER(LANG(?n) = 'en') } }", [("http://x/a", "one"), ("http://x/b", None), ("http://x/c", None)]),
    ("SELECT ?g ?o { GRAPH ?g { :a :p ?o } }", [("http://x/g1", "1"), ("http://x/g2", "2")]),
    ("SELECT ?s { GRAPH :g2 { ?s :p 1 } }", [("http://x/b",)]),
    ("SELECT ?g ?o { GRAPH ?g { :a :p+ ?o } }", [("http://x/g1", "1"), ("http://x/g2", "2")]),
    ("SELECT ?o { GRAPH :g2 { :b :p* ?o } }", [("1",), ("http://x/b",)]),
    ("SELECT ?o FROM :g1 { :a :p ?o }", [("1",)]),
    ("SELECT ?g FROM NAMED :g2 { GRAPH ?g { :b :p 1 } }", [("http://x/g2",)]),
    ("SELECT (SUM(?v) AS ?t) { VALUES ?v { 1 2 3 } }", [("6",)]),
    ("SELECT (SUM(?v) AS ?t) { ?s :n ?v }", [(None,)]),
    ("SELECT (COUNT(?v) AS ?n) (MIN(?v) AS ?lo) { ?s :n ?v }", [("4", "1")]),
    ("SELECT (COUNT(*) AS ?n) { ?s :none ?v }", [("0",)]),
    ("SELECT ?s (COUNT(*) AS ?n) { ?s :none ?v } GROUP BY ?s", []),
    ("SELECT ?x { BIND(1/0 AS ?x) }", [(None,)]),
    ("SELECT ?x { BIND(IF(1/0, 1, 2) AS ?x) }", [(None,)]),
    ("SELECT ?x { BIND(COALESCE(1/0, 'y') AS ?x) }", [("y",)]),
    ("SELECT ?s { ?s :n ?v FILTER(?v = 'x' || ?v > 2) }", [("http://x/b",), ("http://x/c",)]),
    ("SELECT ?s { ?s :p ?o MINUS { ?s :n 1 } }", [("http://x/b",), ("http://x/c",)]),
    ("SELECT ?s { ?s :p ?o FILTER NOT EXISTS { ?o :n 1 } }", [("http://x/a",), ("http://x/b",)]),
    ("SELECT ?s (EXISTS { ?s :label ?l } AS ?e) { ?s :p ?o }", [("http://x/a", "true"), ("http://x/b", "false"), ("http://x/c", "false")]),
    ("SELECT ?y { :e :when ?d BIND(YEAR(?d) + MONTH(?d) AS ?y) }", [("2022",)]),
    ("SELECT ?d { :a :label ?l BIND(STR(DATATYPE(?l)) AS ?d) FILTER(LANG(?l) = 'en') }", [("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString",)]),
    ("SELECT ?u { :a :label ?l FILTER(LANG(?l) = 'en') BIND(LANG(UCASE(?l)) AS ?u) }", [("en",)]),
    ("SELECT ?a ?b { VALUES (?a ?b) { (1 UNDEF) (UNDEF 2) } VALUES (?a ?b) { (1 2) } }", [("1", "2"), ("1", "2")]),
    ("SELECT ?x { BIND(TRIPLE(:a, :p, :b) AS ?t) BIND(OBJECT(?t) AS ?x) }", [("http://x/b",)]),
    ("SELECT ?x { BIND(ROUND(-2.5) AS ?x) }", [("-2",)]),
    ("SELECT ?x { BIND(xsd:integer('7') + xsd:integer(xsd:double('1e1')) AS ?x) }", [("17",)]),
    ("SELECT ?x { BIND(REPLACE('abab', 'B', 'z', 'i') AS ?x) }", [("azaz",)]),
    ("SELECT ?x { BIND(SUBSTR('foobar', 4) AS ?x) }", [("bar",)]),
    ("SELECT ?x { BIND(TZ('2020-01-01T00:00:00-05:00'^^xsd:dateTime) AS ?x) }", [("-05:00",)]),
    ("SELECT DISTINCT ?p { ?s ?p ?o . ?s a :T FILTER(?p IN (:q, :zz)) }", [("http://x/q",)]),
    ("SELECT ?s { SERVICE SILENT <http://nowhere/> { ?s ?p ?o } :a :p ?s }", [("http://x/b",)]),
    ("SELECT ?s ?n { { SELECT ?s (COUNT(*) AS ?n) { ?s ?p ?o } GROUP BY ?s } FILTER(?n > 3) }", [("http://x/a", "4")]),
]


@pytest.mark.parametrize("text,want", CASES, ids=range(len(CASES)))
def test_query(ds, text, want):
    assert rows(ds, text) == want


def test_forms(ds):
    assert ds.query("ASK { :a :p :b }").boolean is True
    assert ds.query("ASK { :a :p :zz }").boolean is False
    made = ds.query("CONSTRUCT { ?o :from ?s . _:x :of ?s } WHERE { ?s :p ?o }").quads.collect()
    assert sum(r.p == "Ihttp://x/from" for r in made) == 3 and len({r.s for r in made if r.s[0] == "B"}) == 3
    assert ds.query("CONSTRUCT WHERE { :a :p ?o }").quads.count() == 1
    told = ds.query("DESCRIBE :d").quads.collect()
    assert any(r.o.endswith("deep") for r in told)
    ordered = ds.query("SELECT ?v { ?s :n ?v } ORDER BY DESC(?v) LIMIT 2").terms().collect()
    assert [t.parse_term(r.v)[1] for r in ordered] == ["x", "2.5"]


@pytest.mark.parametrize("text", ["SELECT", "SELECT ?x { ?x }", "SELECT ?x { ?x :p }", "ASK { 1 2", "SELECT ?x { ?x un:known 1 }", "SELECT ?x { FILTER( }", "SELECT * { ?x :p ?y } LIMIT ?z"])
def test_syntax_errors(text):
    with pytest.raises((SparqlSyntaxError, ValueError)):
        parse_query(text, {"": X})


def test_extension_functions_and_aggregates(ds):
    from pyspark.sql import functions as F

    ds.registry.functions.clear()
    ds.registry.aggregates.clear()
    ds.registry.add(X + "twice", lambda a: Val("dbl", t.number(a) * 2))
    ds.registry.add(X + "product", lambda a, distinct: Val("dbl", F.product(t.number(a))), aggregate=True)
    assert rows(ds, "SELECT (:twice(4) AS ?x) {}") == [("8",)]
    assert rows(ds, "SELECT (:product(?v) AS ?x) { VALUES ?v { 2 3 4 } }") == [("24.0",)]
    for bad in ("", X + "twice", t.XSD + "integer"):
        with pytest.raises(ValueError):
            ds.registry.add(bad, None)


def test_serialisations(spark, ds):
    lines = [r.value for r in rdf.nquad_lines(ds.quads).collect()]
    back = rdf.nquads(spark.createDataFrame([(x,) for x in lines] + [("# note",), ("",)], "value string"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, ds.quads.collect()), key=str)
    odd = 'L' + t.XSD + 'string\x01\x01a"b\\c\nd\té'
    line = rdf.nquad_lines(spark.createDataFrame([("Ihttp://s", "Ihttp://p", odd, None)], rdf.QUADS)).first().value
    assert rdf.nquads(spark.createDataFrame([(line,)], "value string")).first().o == odd
    blocks = "\n".join(r.value for r in rdf.turtle_blocks(ds.quads, {"": X}).collect())
    again = rdf.parse_turtle("@prefix : <http://x/> .\n" + blocks)
    assert len(again) == ds.quads.where("g IS NULL").count()
    terms = ds.query("SELECT ?s ?v { ?s :n ?v }").terms()
    names, found = rdf.parse_results_json(rdf.results_json(terms))
    assert names == ["s", "v"] and sorted((r["s"], r["v"]) for r in found) == sorted(map(tuple, terms.collect()))
    assert sorted((r["s"], r["v"]) for r in rdf.parse_results_xml(rdf.results_xml(terms))[1]) == sorted(map(tuple, terms.collect()))
    tsv = "?s\t?v\n" + "\n".join(r.value for r in rdf.result_lines(terms, "tsv").collect())
    assert sorted((r["s"], r["v"]) for r in rdf.parse_results_tsv(tsv)[1]) == sorted(map(tuple, terms.collect()))
    assert "http://x/c,x" in [r.value for r in rdf.result_lines(terms, "csv").collect()]


def test_files(spark, ds, tmp_path):
    (tmp_path / "a.ttl").write_text(DATA)
    (tmp_path / "b.ttl").write_text("<u> <p> _:b1 .")
    assert rdf.read_turtle(spark, f"file://{tmp_path}/*.ttl").count() == ds.quads.where("g IS NULL").count() + 1
    rdf.write_nquads(ds.quads, f"file://{tmp_path}/out")
    assert rdf.read_nquads(spark, f"file://{tmp_path}/out").count() == ds.quads.count()


UPDATES = [
    ("INSERT DATA { :a :p :b . GRAPH :g { :a :p :c } }", {(":a :p :b", None), (":a :p :c", ":g")}),
    ("INSERT DATA { :a :p :b } ; DELETE DATA { :a :p :b }", set()),
    ("INSERT DATA { :a :p :b, :c } ; DELETE WHERE { :a :p :c }", {(":a :p :b", None)}),
    ("INSERT DATA { :a :p :b } ; DELETE { ?s :p ?o } INSERT { ?o :q ?s } WHERE { ?s :p ?o }", {(":b :q :a", None)}),
    ("INSERT DATA { :a :p :b } ; WITH :g INSERT { ?s :p ?o } WHERE { } ; INSERT { GRAPH :g { ?s :p ?o } } WHERE { ?s :p ?o }", {(":a :p :b", None), (":a :p :b", ":g")}),
    ("INSERT DATA { :a :p :b } ; ADD DEFAULT TO :g", {(":a :p :b", None), (":a :p :b", ":g")}),
    ("INSERT DATA { :a :p :b . GRAPH :g { :z :p :z } } ; MOVE DEFAULT TO :g", {(":a :p :b", ":g")}),
    ("INSERT DATA { :a :p :b . GRAPH :g { :z :p :z } } ; COPY :g TO DEFAULT", {(":z :p :z", None), (":z :p :z", ":g")}),
    ("INSERT DATA { :a :p :b . GRAPH :g { :z :p :z } } ; CLEAR NAMED", {(":a :p :b", None)}),
    ("INSERT DATA { :a :p :b . GRAPH :g { :z :p :z } } ; DROP GRAPH :g ; CLEAR SILENT GRAPH :nope", {(":a :p :b", None)}),
    ("CREATE GRAPH :g ; CREATE SILENT GRAPH :g ; LOAD SILENT <http://no/> ; DROP ALL", set()),
    ("INSERT DATA { GRAPH :g { :a :p :b } GRAPH :h { :a :p :c } } ; INSERT { :r :s ?o } USING :g WHERE { :a :p ?o }", {(":a :p :b", ":g"), (":a :p :c", ":h"), (":r :s :b", None)}),
]


@pytest.mark.parametrize("text,want", UPDATES, ids=range(len(UPDATES)))
def test_update(spark, text, want):
    store = GraphStore(spark)
    store.update(text, prefixes={"": X})
    short = lambda x: None if x is None else x.replace("Ihttp://x/", ":")
    assert {(" ".join(map(short, (r.s, r.p, r.o))), short(r.g)) for r in store.quads().collect()} == want


def test_versions_worlds_and_feeds(spark):
    seen = []
    store = GraphStore(spark, loader=lambda source: [("Ihttp://x/l", "Ihttp://x/p", "Ihttp://x/m", None)], observers=[lambda v, delta: seen.append((v, delta.count()))])
    first = store.insert([("Ia", "Ip", "Ib", None)])
    store.insert([("Ia", "Ip", "Ib", None), ("Ia", "Ip", "Ic", None)])
    assert [n for _, n in seen] == [1, 1]
    with pytest.raises(ConflictError):
        store.commit(store._none(), store._none(), expected=first)
    store.fork("what-if")
    store.update("DELETE WHERE { ?s ?p <c> } ; LOAD <http://x/doc>".replace("<c>", "?o"), "what-if")
    assert {(r.o, r.change) for r in store.diff("main", "what-if").collect()} == {("Ib", -1), ("Ic", -1), ("Ihttp://x/m", 1)}
    with pytest.raises(ValueError):
        store.fork("what-if")
    store.drop("what-if")
    assert len(store.history()) == 3
    store.contextual = True
    store.update("LOAD <http://x/doc>")
    assert store.quads().where("g IS NOT NULL").count() == 1


@pytest.mark.parametrize(
    "body",
    [
        "?s :p ?o OPTIONAL { ?s :q ?z } OPTIONAL { ?z :q ?w }",
        "?s :p ?o OPTIONAL { ?s :q ?z } MINUS { ?z :q ?w }",
        "?s :p ?o OPTIONAL { ?s :q ?z } FILTER NOT EXISTS { ?s :q ?z . ?z :p ?v }",
        "?s :p ?o OPTIONAL { ?s :q ?z } MINUS { ?s :p ?k OPTIONAL { ?s :q ?z } }",
    ],
)
def test_joins_on_variables_that_may_be_unbound_have_keys(spark, body):
    """Parts in which nothing is shared have no key to join on; all others are equi-joins."""
    rows = [("I:a", "I:p", "I:b", None), ("I:a", "I:q", "I:c", None), ("I:c", "I:q", "I:d", None), ("I:e", "I:p", "I:b", None)]
    ds = Dataset(spark, spark.createDataFrame(rows, "s string, p string, o string, g string"), prefixes={"": ":"})
    found = ds.select(f"SELECT * WHERE {{ {body} }}")
    found.collect()
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull" not in text.lower() or " OR " not in "".join(line for line in text.splitlines() if "Join" in line)
    assert not any("Join" in line and " OR " in line for line in text.splitlines())
