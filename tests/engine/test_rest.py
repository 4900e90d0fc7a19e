import json
import time

import pytest
from pyspark.sql import functions as F

from tessera.engine import Dataset
from tessera.functions import geo, jsonata, jsonschema
from tessera.functions import terms as t
from tessera.operators import graph, inference, paths, shacl, temporal
from tessera.operators.update import GraphStore
from tessera.shared import fresh_path
from tessera.sources import rdf
from tessera.streaming import feeds

PRE = "@prefix : <http://x/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"


def triples(spark, text):
    return spark.createDataFrame(rdf.parse_turtle(PRE + text), rdf.QUADS)


def short(x):
    return x.replace("Ihttp://x/", ":").replace(t.iri(t.RDF + "type"), "a")


def got(df):
    return {" ".join(short(r[c]) for c in "spo") for r in df.collect()}


def test_rdfs(spark):
    d = triples(spark, ":A rdfs:subClassOf :B . :B rdfs:subClassOf :C . :p rdfs:subPropertyOf :q ; rdfs:domain :A . :q rdfs:range :R . :x :p :y . :x :p 5 .")
    new = got(inference.rdfs(d))
    assert {":x a :A", ":x a :B", ":x a :C", ":x :q :y", ":y a :R"} <= new
    assert not any(x.startswith("L") for x in new)
    rules = {r.rule for r in inference.rdfs(d, provenance=True).collect()}
    assert rules == {"rdfs2", "rdfs3", "rdfs7", "rdfs9", "rdfs11"}
    types = inference.types_of(d)
    ds = Dataset(spark, d, prefixes={"": "http://x/"}, types_of=types)
    spark_rows = triples(spark, ":i a :A .")
    ds2 = Dataset(spark, d.unionByName(spark_rows), prefixes={"": "http://x/"}, types_of=types)
    assert ds2.select("SELECT ?s { ?s a :C }").count() == 1 and ds.select("SELECT ?s { ?s a :C }").count() == 0


def test_owl_rl(spark):
    d = triples(
        spark,
        """:anc a owl:TransitiveProperty . :knows a owl:SymmetricProperty . :par owl:inverseOf :child . :mail a owl:InverseFunctionalProperty . :mother a owl:FunctionalProperty .
        :a :anc :b . :b :anc :c . :a :knows :z . :a :par :b . :m1 :mail :box . :m2 :mail :box . :m1 :age 5 . :k :mother :u . :k :mother :v .
        :D owl:equivalentClass [ a owl:Restriction ; owl:onProperty :has ; owl:someValuesFrom :E ] . :h :has :e . :e a :E .
        :F owl:onProperty :col ; owl:hasValue :red . :w :col :red . :G owl:unionOf (:E :H) . :I owl:intersectionOf (:E :J) . :e a :J .
        :uncle owl:propertyChainAxiom (:par2 :bro) . :n :par2 :o . :o :bro :q . :P owl:disjointWith :Q . :bad a :P, :Q .""",
    )
    closed, cliques = inference.owl_rl(d)
    all_ = got(inference.expand(closed, cliques))
    assert {":a :anc :c", ":z :knows :a", ":b :child :a", ":m2 :age L" + t.XSD + "integer\x01\x015", ":h a :D", ":w a :F", ":e a :G", ":e a :I", ":n :uncle :q"} <= all_
    same = {frozenset((r.node, r.component)) for r in cliques.collect() if r.node != r.component}
    assert frozenset(("Ihttp://x/m1", "Ihttp://x/m2")) in same and frozenset(("Ihttp://x/u", "Ihttp://x/v")) in same
    assert [(r.rule, short(r.node)) for r in inference.inconsistencies(closed, cliques).collect()] == [("cax-dw", ":bad")]


SHAPES = """:S a sh:NodeShape ; sh:targetClass :P ; sh:property :s1, :s2, :s3, :s4, :s5 ; sh:closed true ; sh:ignoredProperties (<http://www.w3.org/1999/02/22-rdf-syntax-ns#type> :extra) .
:s1 sh:path :name ; sh:minCount 1 ; sh:maxCount 2 ; sh:datatype xsd:string ; sh:minLength 2 ; sh:pattern "^[A-Z]" ; sh:uniqueLang true .
:s2 sh:path :age ; sh:minInclusive 0 ; sh:maxExclusive 150 ; sh:lessThan :limit .
:s3 sh:path :friend ; sh:class :P ; sh:nodeKind sh:IRI ; sh:qualifiedValueShape [ sh:nodeKind sh:IRI ] ; sh:qualifiedMinCount 1 .
:s4 sh:path :limit ; sh:in (100 200) .
:s5 sh:path :tag ; sh:or ([ sh:datatype xsd:integer ] [ sh:minLength 3 ]) ; sh:not [ sh:hasValue "bad" ] .
:T a sh:NodeShape ; sh:targetNode :q ; sh:sparql [ sh:select "SELECT $this ?value WHERE { $this <http://x/age> ?value FILTER(?value > 50) }" ] ."""


def test_shacl(spark):
    d = triples(
        spark,
        """:K rdfs:subClassOf :P . :a a :P ; :name "Ann" ; :age 30 ; :limit 100 ; :friend :b ; :tag 5, "long" . :b a :K ; :name "Bo" ; :age 20 ; :friend :a ; :limit 200 .
        :q a :P ; :name "x", "yy", "Z"@en ; :age 200 ; :limit 7 ; :friend "str", :zz ; :tag "ab", "bad" ; :foo 1 .""",
    )
    v = shacl.Validator(Dataset(spark, d), shacl.Shapes(rdf.parse_turtle(PRE + SHAPES)))
    report = v.report()
    found = {(short(r.focus), r.component.removeprefix(t.SH).removesuffix("ConstraintComponent")) for r in report.collect()}
    assert {f for f, _ in found} == {":q"}
    assert {c for _, c in found} == {"MaxCount", "Datatype", "MinLength", "Pattern", "MaxExclusive", "LessThan", "Class", "NodeKind", "In", "Or", "Not", "Closed", "SPARQL"}
    assert not v.conforms() and shacl.report_quads(report).where("p LIKE '%focusNode'").count() > 10
    assert shacl.Validator(Dataset(spark, d.where("s <> 'Ihttp://x/q'")), v.shapes).conforms()


def test_shacl_lists_and_more(spark):
    d = triples(spark, """:a :l (1 2 2) ; :p "x"@en, "y"@EN ; :e1 1 ; :e2 2 . :b :l () ; :p "x"@de ; :e1 1 ; :e2 1 .""")
    shapes = """:S sh:targetSubjectsOf :l ; sh:property [ sh:path :l ; sh:uniqueMembers true ; sh:minListLength 1 ; sh:maxListLength 2 ] , [ sh:path :p ; sh:uniqueLang true ; sh:languageIn ("en" "de") ] ,
       [ sh:path :e1 ; sh:equals :e2 ] , [ sh:path :e1 ; sh:disjoint :e2 ] , [ sh:path :e1 ; sh:lessThanOrEquals :e2 ; sh:hasValue 1 ] , [ sh:path [ sh:inversePath :zz ] ; sh:maxCount 0 ] ; sh:xone ([ sh:property [ sh:path :e2 ; sh:hasValue 1 ] ] [ sh:property [ sh:path :e2 ; sh:hasValue 2 ] ]) ."""
    found = {(short(r.focus), r.component.removeprefix(t.SH).removesuffix("ConstraintComponent")) for r in shacl.Validator(Dataset(spark, d), shacl.Shapes(rdf.parse_turtle(PRE + shapes))).report().collect()}
    assert found == {(":a", "UniqueMembers"), (":a", "MaxListLength"), (":b", "MinListLength"), (":a", "UniqueLang"), (":a", "Equals"), (":b", "Disjoint")}


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def by(df, a, b):
    return {r[a]: round(r[b], 6) for r in df.collect()}


def test_graph_values(spark):
    path, star, tri = edges(spark, [(1, 2), (2, 3)]), edges(spark, [(1, 2), (1, 3), (1, 4)]), edges(spark, [(1, 2), (2, 3), (1, 3)])
    assert by(graph.closeness(path), "node", "closeness") == {1: round(2 / 3, 6), 2: 1.0, 3: round(2 / 3, 6)}
    assert by(graph.closeness(star), "node", "closeness") == {1: 1.0, 2: 0.6, 3: 0.6, 4: 0.6}
    assert by(graph.betweenness(path), "node", "betweenness") == {1: 0, 2: 1, 3: 0}
    assert by(graph.betweenness(star), "node", "betweenness") == {1: 3, 2: 0, 3: 0, 4: 0}
    assert set(by(graph.betweenness(tri), "node", "betweenness").values()) == {0}
    e = by(graph.eigenvector(path, 60), "node", "centrality")
    assert e[2] / e[1] == pytest.approx(2**0.5, abs=1e-4)
    assert sum(by(graph.pagerank(path), "node", "rank").values()) == pytest.approx(1, abs=1e-5)
    for n, k, want in ((4, 3, 4), (5, 3, 10), (5, 4, 5), (5, 5, 1)):
        assert graph.cliques(graph.complete_graph(spark, n), k).count() == want
    assert graph.global_clustering(tri).first().clustering == 1.0
    assert by(graph.core_numbers(edges(spark, [(1, 2), (2, 3), (1, 3), (3, 4)])), "node", "core") == {1: 2, 2: 2, 3: 2, 4: 1}
    scc = by(graph.strong_components(edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6)])), "node", "component")
    assert scc == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert by(graph.components(edges(spark, [(1, 2), (3, 4), (2, 5)])), "node", "component") == {1: 1, 2: 1, 5: 1, 3: 3, 4: 3}
    assert by(graph.shortest_lengths(path, 9), "node", "length") == {9: 0}
    assert graph.shortest_path(edges(spark, [(1, 2), (2, 4), (1, 3), (3, 4)]), 1, 4) == [1, 2, 4]
    assert graph.shortest_path(path, 3, 1) is None
    assert paths.reachable(path, 1, 3) and not paths.reachable(path, 3, 1)
    assert graph.path_graph(spark, 5).count() == 4 and graph.cycle_graph(spark, 5).count() == 5 and graph.grid_graph(spark, 3, 2).count() == 7 and graph.tree_graph(spark, 7).count() == 6
    assert graph.complete_graph(spark, 5).count() == 10 and graph.preferential(spark, 20, 2).count() == 36 and graph.random_graph(spark, 20, 1.0).count() == 190
    assert graph.small_world(spark, 20, 4, 0.0).count() == 40
    with pytest.raises(ValueError):
        graph.fold(edges(spark, [(1, 2), (2, 1)]), spark.createDataFrame([(1, 1), (2, 1)], "node long, value long"))
    for bad in (lambda: graph.pagerank(path, 1.5), lambda: graph.cliques(path, 1), lambda: graph.degree_distribution(path, "undirected")):
        with pytest.raises(ValueError):
            bad()


def test_lists(spark):
    d = triples(spark, ":a :l (1 2 3) . :b :l (4) .")
    got_ = sorted([len(r.members) for r in paths.lists(d, t.iri(t.RDF + "first"), t.iri(t.RDF + "rest"), t.iri(t.RDF + "nil")).collect()])
    assert got_ == [1, 3]


def test_bitemporal_and_hash(spark):
    d = spark.createDataFrame([("k", 1, 5, 1, None), ("k", 1, 9, 3, None), ("k", 6, None, 1, 3)], "key string, v0 int, v1 int, k0 int, k1 int")
    assert temporal.bitemporal(d, ["key"], ("v0", "v1"), ("k0", "k1"), 7, 2).count() == 1
    q = triples(spark, ":a :b :c . :d :e :f .")
    assert temporal.state_hash(q).collect() == temporal.state_hash(q.orderBy("o")).collect() != temporal.state_hash(q.limit(1)).collect()


JSONATA = [
    ("Account.Order.Product.{'n':n,'o':%.id}", [{"n": "a", "o": 1}, {"n": "b", "o": 1}]), ("a.b", 1), ("a.b + 1", 2), ("$exists(zz)", False), ("l[$ > 1]", [2, 3]), ("$filter(l, function($x){ $x > 2 })", 3), ("l ^ (>$)", [3, 2, 1]),
    ("$join($map(l, $string), '-')", "1-2-3"), ("$match('ab12', /[a-z]+(\\d+)/).groups", "12"), ("a ~> |$|{'c': 2}|", {"b": 1, "c": 2}), ("$pad('x', -3)", "  x"), ("$formatBase(255, 16)", "ff"), ("$eval('1+2')", 3), ("(1; 2)", 2),
    ("l[0] in l", True), ("$spread(a)", {"b": 1}), ("$zip(l, l)", [[1, 1], [2, 2], [3, 3]]), ("$number('0x1F')", 31), ("$formatInteger(14, 'I')", "XIV"), ("$substringAfter('a-b', '-')", "b"), ("$sift(a, function($v){ $v = 1 })", {"b": 1}),
    ("($add := function($x, $y){ $x + $y }; $inc := $add(1, ?); $inc(4))", 5), ("$type(null)", "null"), ("$single(l, function($x){ $x = 2 })", 2), ("$reverse(l)", [3, 2, 1]), ("zz ?? 'd'", "d"), ("$lookup(a, 'b')", 1),
]


@pytest.mark.parametrize("text,want", JSONATA, ids=range(len(JSONATA)))
def test_jsonata(text, want):
    data = {"a": {"b": 1}, "l": [1, 2, 3], "Account": {"Order": [{"id": 1, "Product": [{"n": "a"}, {"n": "b"}]}]}}
    assert jsonata.evaluate(text, data) == want


def test_jsonata_joins_errors_and_columns(spark):
    library = {"loans": [{"isbn": 1, "c": 10}, {"isbn": 2, "c": 11}], "books": [{"isbn": 1, "t": "A"}, {"isbn": 2, "t": "B"}]}
    assert jsonata.evaluate("loans@$l.books@$b[$l.isbn=$b.isbn].{'t': $b.t, 'c': $l.c}", library) == [{"t": "A", "c": 10}, {"t": "B", "c": 11}]
    for bad in ("1 +", "'a' + 1", "$sum('x')", "$error('no')", "-'a'", "1/0", "($f := function(){ $f() }; $f())", "[1..99999999]"):
        with pytest.raises((jsonata.JsonataError, RecursionError)):
            jsonata.evaluate(bad, {})
    df = spark.createDataFrame([('{"a":[1,2]}',), ("{}",), (None,)], "j string")
    assert [r.x for r in df.select(jsonata.column("$sum(a)", "j").alias("x")).collect()] == ["3", None, None]
    assert [r.x for r in spark.createDataFrame([('{"a":{"b":[7]}}',), ("bad",)], "j string").select(jsonata.path_column("a.b[0]", "j", "int").alias("x")).collect()] == [7, None]


SCHEMAS = [
    ({"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}}, "additionalProperties": False}, {"a": 1}, {"a": 0}, {"b": 1}),
    ({"prefixItems": [{"type": "string"}], "items": {"type": "number"}, "minItems": 2, "uniqueItems": True}, ["a", 1], ["a"], ["a", 1, 1.0]),
    ({"oneOf": [{"type": "string"}, {"maxLength": 2}]}, "abc", "ab", "a"),
    ({"if": {"const": 1}, "then": {"type": "integer"}, "else": {"type": "string"}}, 1, 2, None),
    ({"$ref": "#/$defs/x", "$defs": {"x": {"enum": [1, "a"]}}}, 1.0, True, "b"),
    ({"contains": {"const": 3}, "minContains": 2}, [3, 3], [3], []),
    ({"dependentRequired": {"a": ["b"]}, "patternProperties": {"^x": {"type": "null"}}, "propertyNames": {"maxLength": 2}}, {"a": 1, "b": 2}, {"a": 1}, {"xyz": None}),
    ({"allOf": [{"properties": {"a": True}}], "unevaluatedProperties": False}, {"a": 1}, {"b": 1}, {"a": 1, "c": 2}),
    ({"anyOf": [{"type": "number", "multipleOf": 0.1}, {"pattern": "^a"}], "not": {"const": "ax"}}, 0.3, "b", "ax"),
]


@pytest.mark.parametrize("schema,good,bad,worse", SCHEMAS, ids=range(len(SCHEMAS)))
def test_json_schema(schema, good, bad, worse):
    s = jsonschema.Schema(schema)
    assert s.valid(good) and not s.valid(bad) and not s.valid(worse)


def test_pointers_and_schema_columns(spark):
    doc = {"a/b": [1, {"~": 2}], "": 3}
    assert jsonschema.pointer(doc, "/a~1b/1/~0") == 2 and jsonschema.pointer(doc, "/") == 3 and jsonschema.pointer(doc, "") is doc
    for bad in ("a", "/a~1b/01", "/zz", "/a~1b/9"):
        with pytest.raises(KeyError):
            jsonschema.pointer(doc, bad)
    assert all(jsonschema.pointer(doc, p) is v for p, v in jsonschema.walk(doc))
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(json.dumps({"a": [5]}),), ("nope",), (None,)], "j string")
    assert [r.x for r in df.select(jsonschema.pointer_column(F.col("j"), "/a/0", "int").alias("x")).collect()] == [5, None, None]
    assert [r.x if r.x is None else len(r.x) for r in df.select(jsonschema.validate(F.col("j"), {"required": ["b"]}).alias("x")).collect()] == [1, 1, None]
    assert [r.x for r in df.select(jsonschema.required(F.col("j"), {"a": "array<int>"}).alias("x")).collect()] == [True, False, False]


SQUARE = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"
RELATED = [
    ("sfContains", SQUARE, "POINT(1 1)", True), ("sfWithin", "POINT(1 1)", SQUARE, True), ("sfTouches", SQUARE, "POINT(0 2)", True), ("sfDisjoint", SQUARE, "POINT(9 9)", True), ("sfIntersects", SQUARE, "LINESTRING(-1 2, 5 2)", True),
    ("sfCrosses", "LINESTRING(-1 2, 5 2)", SQUARE, True), ("sfCrosses", "LINESTRING(0 0, 2 2)", "LINESTRING(0 2, 2 0)", True), ("sfOverlaps", SQUARE, "POLYGON((2 2, 6 2, 6 6, 2 6, 2 2))", True),
    ("sfEquals", SQUARE, "POLYGON((4 4, 0 4, 0 0, 4 0, 4 4))", True), ("sfTouches", SQUARE, "POLYGON((4 0, 8 0, 8 4, 4 4, 4 0))", True), ("sfContains", SQUARE, "POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))", True),
    ("sfContains", "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))", "POINT(2 2)", False), ("rcc8ntpp", "POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))", SQUARE, True), ("rcc8tpp", "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", SQUARE, True),
    ("rcc8ec", SQUARE, "POLYGON((4 0, 8 0, 8 4, 4 4, 4 0))", True), ("rcc8po", SQUARE, "POLYGON((2 2, 6 2, 6 6, 2 6, 2 2))", True), ("rcc8eq", SQUARE, SQUARE, True), ("rcc8dc", SQUARE, "POLYGON((8 8, 9 8, 9 9, 8 9, 8 8))", True),
    ("ehInside", "POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))", SQUARE, True), ("ehCovers", SQUARE, "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))", True), ("ehMeet", SQUARE, "POLYGON((4 0, 8 0, 8 4, 4 4, 4 0))", True), ("sfOverlaps", "LINESTRING(0 0, 2 0)", "LINESTRING(1 0, 3 0)", True),
]


@pytest.mark.parametrize("name,a,b,want", RELATED, ids=range(len(RELATED)))
def test_relations(name, a, b, want):
    assert geo.holds(name, geo.parse_wkt(a), geo.parse_wkt(b)) is want


def test_geometry(spark):
    g = geo.parse_wkt
    assert geo.area(g(SQUARE)) == 16 and geo.length(g("LINESTRING(0 0, 3 4)")) == 5 and geo.distance(g(SQUARE), g("POINT(7 8)")) == 5 and geo.distance(g(SQUARE), g("POINT(1 1)")) == 0
    assert geo.to_wkt(geo.centroid(g(SQUARE))) == "POINT(2 2)" and geo.to_wkt(geo.envelope(g("MULTIPOINT(1 2, 3 0)"))) == "POLYGON((1 0, 3 0, 3 2, 1 2, 1 0))"
    assert geo.area(geo.convex_hull(g("MULTIPOINT((0 0), (4 0), (4 4), (0 4), (2 2))"))) == 16
    assert geo.bounding_circle(g("MULTIPOINT(0 0, 2 0, 1 1)")) == ((1.0, 0.0), 1.0)
    for text in ("POINT(1 2)", "GEOMETRYCOLLECTION(POINT(1 2), LINESTRING(0 0, 1 1))", "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)))", "POINT EMPTY"):
        assert geo.to_wkt(g(text)) == text
    ds = Dataset(spark, triples(spark, ':a :w "POINT(1 1)" . :b :w "POINT(9 9)" . :c :w "oops" .'), prefixes={"": "http://x/", "geof": geo.GEOF})
    for name, f in geo.functions().items():
        ds.registry.add(name, f)
    assert [r.s for r in ds.query(f"SELECT ?s {{ ?s :w ?w FILTER(geof:sfWithin(?w, '{SQUARE}')) }}").df.collect()] == ["Ihttp://x/a"]
    a = spark.createDataFrame([(k, f"POINT({k} {k})") for k in range(10)], "i int, w string")
    b = spark.createDataFrame([(1, SQUARE), (2, "POLYGON((2 2, 30 2, 30 30, 2 30, 2 2))")], "j int, v string")
    pairs = {(r.i, r.j) for r in geo.spatial_join(a, b, "w", "v", 3.0).collect()}
    assert pairs == {(i, 1) for i in range(5)} | {(i, 2) for i in range(2, 10)}


def test_feeds(spark, tmp_path):
    store, folder, target = GraphStore(spark), f"file://{tmp_path}/deltas", f"file://{tmp_path}/closure"
    feeds.publish(store, folder)
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([("Ia", "Ip", "Ib", None), ("Ib", "Ip", "Ic", None)], rdf.QUADS).write.parquet(src)
    feeds.ingest(spark.readStream.schema(rdf.QUADS).parquet(src), store).awaitTermination()
    assert store.quads().count() == 2
    checkpoint = fresh_path(spark, "test-cp")
    feeds.maintained_closure(feeds.delta_feed(spark, folder), "Ip", target, checkpoint).awaitTermination()
    assert spark.read.parquet(f"{target}/0").count() == 3


def test_repeated_geometries_are_worked_out_once(monkeypatch):
    calls = []
    monkeypatch.setattr(geo, "_KEPT", {})
    monkeypatch.setattr(geo, "KEPT", 2)
    f = lambda x: calls.append(x) or geo.area(geo.parse_wkt(x))
    assert [geo.kept("area", f, (x,)) for x in (SQUARE, SQUARE, "oops", "oops")] == [16, 16, None, None] and calls == [SQUARE, "oops"]
    long = SQUARE + " " * geo.SHORT
    assert [geo.kept("area", f, (long,)) for _ in "ab"] == [16, 16] and calls[2:] == [long, long] and len(geo._KEPT) == 2
    assert geo.kept("other", f, (SQUARE,)) == 16 and calls[4:] == [SQUARE] and len(geo._KEPT) == 1


def test_relations_keep_the_answers_for_equal_pairs(spark):
    df = spark.createDataFrame([(SQUARE, "POINT(1 1)")] * 3000 + [(SQUARE, "oops"), (None, SQUARE)], "a string, b string").coalesce(1)
    r = df.select(geo.relations(["sfContains", "sfDisjoint"], F.col("a"), F.col("b")).alias("r"))
    started = time.monotonic()
    got = [x.r for x in r.collect()]
    assert got == [[True, False]] * 3000 + [None, None] and time.monotonic() - started < 15
    answer = geo.relations(["sfEquals"], F.col("a"), F.col("b"))
    assert [x.r for x in df.limit(1).select(answer.alias("r")).collect()] == [[False]]  # other names, another answer


def _by_brute_force(pairs):
    """Closeness and betweenness of every node by breadth-first walks over all pairs."""
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    lengths, ways = {}, {}
    for r in near:
        lengths[r], ways[r], row = {r: 0}, {r: 1}, [r]
        while row:
            after = []
            for x in row:
                for y in near[x]:
                    if y not in lengths[r]:
                        lengths[r][y], ways[r][y] = lengths[r][x] + 1, 0
                        after.append(y)
                    if lengths[r][y] == lengths[r][x] + 1:
                        ways[r][y] += ways[r][x]
            row = after
    close = {r: (len(x) - 1) / sum(x.values()) for r, x in lengths.items()}
    between = {v: sum(ways[a][v] * ways[v][b] / ways[a][b] for a in near for b in near if a < b and v not in (a, b) and v in lengths[a] and b in lengths[a] and lengths[a][v] + lengths[v][b] == lengths[a][b]) for v in near}
    return close, between


def test_leaves_are_folded(spark, monkeypatch):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 1), (4, 5), (5, 6), (5, 7), (1, 8), (1, 9), (1, 10), (9, 1), (20, 21), (30, 31), (30, 32), (40, 40), (3, 11), (11, 12), (12, 13)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    close, between = _by_brute_force(pairs)
    got = {r.node: r.closeness for r in graph.closeness(e).collect()}
    assert got == pytest.approx(close) and set(got) == set(close)
    got = {r.node: r.betweenness for r in graph.betweenness(e).collect()}
    assert got == pytest.approx(between) and set(got) == set(between)
    walked, closure = [], graph.closure
    monkeypatch.setattr(graph, "closure", lambda x, *a, **k: walked.append(x.count()) or closure(x, *a, **k))
    star = spark.range(1, 3000).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    assert {r.betweenness for r in graph.betweenness(star).collect()} == {0.0, 2999 * 2998 / 2} and walked == [0]
