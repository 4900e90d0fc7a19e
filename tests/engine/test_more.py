import random

import pytest

from tessera.engine import Dataset
from tessera.functions import terms as t
from tessera.operators import graph, multiway, regions, scans
from tessera.plans import algebra as A
from tessera.plans import rewrites, writer
from tessera.plans.parser import parse_query
from tessera.sources import canonical, formats, rdf

X = "http://x/"


def quads(spark, rows):
    return spark.createDataFrame(rows, rdf.QUADS)


def test_scans(spark, tmp_path):
    q = quads(spark, rdf.parse_turtle("@prefix : <http://x/> . :a :p :b, :c . :b :q :c . GRAPH :g { :a :p :d }"))
    assert scans.match(q, p=f"I{X}p").count() == 3 and scans.match(q, s=f"I{X}a", o=f"I{X}d").count() == 1
    assert scans.match_many(q, spark.createDataFrame([(f"I{X}b",), (f"I{X}zz",)], "x string"), "s").count() == 1
    from pyspark.sql import functions as F

    assert scans.View(q).where(lambda: F.col("p") == f"I{X}p").where(lambda: F.col("g").isNull()).scan().count() == 2
    rules = spark.createDataFrame([("u", None, f"I{X}p", True), ("u", f"I{X}g", None, False)], "context string, g string, p string, allow boolean")
    assert scans.allowed(q, rules, "u").count() == 2 and scans.allowed(q, rules, "v").count() == 0
    scans.store(q, f"file://{tmp_path}/s")
    assert sorted(map(str, scans.load(spark, f"file://{tmp_path}/s").collect())) == sorted(map(str, q.collect()))


def test_multiway(spark):
    assert multiway.join_tree([{"a", "b"}, {"b", "c"}, {"c", "a"}]) is None
    assert multiway.join_tree([{"a", "b"}, {"b", "c"}, {"c", "d"}]) is not None
    r = spark.createDataFrame([(1, 2), (5, 6), (1, 9)], "a int, b int")
    s = spark.createDataFrame([(2, 3), (9, 4)], "b int, c int")
    u = spark.createDataFrame([(3, 7)], "c int, d int")
    assert [x.count() for x in multiway.reduced([r, s, u])] == [1, 1, 1]
    assert multiway.star_count([r, spark.createDataFrame([(1, "x"), (1, "y"), (5, "z"), (None, "n")], "a int, y string")], "a").first()["count"] == 5
    assert multiway.star_keys([r, spark.createDataFrame([(1,)], "a int")], "a").count() == 1
    e = graph.random_graph(spark, 30, 0.3, 4)
    both = graph.both_ways(e)
    a, b, c = (both.select(both["src"].alias(x), both["dst"].alias(y)) for x, y in (("a", "b"), ("b", "c"), ("c", "a")))
    assert multiway.hypercube_triangles(a, b, c, 3).count() == 6 * graph.triangle_count(e).first()["count"]


def test_rdfxml(spark, tmp_path):
    text = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://x/" xml:base="http://x/doc">
      <e:T rdf:about="a" e:attr="v"><e:p rdf:resource="#b"/><e:q xml:lang="en">hi</e:q><e:r rdf:datatype="http://x/d">1</e:r><e:s rdf:parseType="Collection"><rdf:Description rdf:about="m"/></e:s>
      <e:u rdf:parseType="Resource"><e:v>w</e:v></e:u><e:k rdf:nodeID="z"/></e:T><rdf:Bag rdf:nodeID="z"><rdf:li>1</rdf:li></rdf:Bag></rdf:RDF>"""
    got = {(s, p, o) for s, p, o, _ in formats.parse_rdfxml(text)}
    a = f"I{X}a"
    assert {(a, t.iri(t.RDF + "type"), f"I{X}T"), (a, f"I{X}attr", t.literal("v")), (a, f"I{X}p", f"I{X}doc#b"), (a, f"I{X}q", t.literal("hi", lang="en")), (a, f"I{X}r", t.literal("1", f"{X}d"))} <= got
    assert any(p == t.iri(t.RDF + "first") and o == f"I{X}m" for _, p, o in got) and any(p == t.iri(t.RDF + "_1") for _, p, _ in got) and len(got) == 13
    (tmp_path / "a.rdf").write_text(text)
    assert formats.read_rdfxml(spark, f"file://{tmp_path}/*.rdf").count() == 13


def test_jsonld():
    doc = """{"@context": {"@vocab": "http://x/", "name": "http://s/name", "knows": {"@type": "@id"}, "tags": {"@container": "@list"}, "when": {"@type": "http://x/date"}, "l": {"@container": "@language"}},
      "@id": "http://x/a", "@type": "P", "name": "Ann", "knows": ["http://x/b", "_:c"], "tags": [1, true, 2.5], "when": "2020", "l": {"en": "hi", "de": ["ho"]}, "in": {"@graph": [{"@id": "http://x/g", "name": "G"}]}}"""
    got = {(s, p, o, g) for s, p, o, g in formats.parse_jsonld(doc)}
    a = f"I{X}a"
    assert {(a, t.iri(t.RDF + "type"), f"I{X}P", None), (a, "Ihttp://s/name", t.literal("Ann"), None), (a, f"I{X}knows", f"I{X}b", None), (a, f"I{X}when", t.literal("2020", f"{X}date"), None), (a, f"I{X}l", t.literal("hi", lang="en"), None)} <= got
    assert any(o == t.literal("2.5E0", t.XSD + "double") for _, _, o, _ in got) and any(g for *_, g in got)
    plain = [q for q in rdf.parse_turtle('@prefix : <http://x/> . :a a :T ; :p "x"@en, 5 ; :q :b . GRAPH :g { :c :p :d }')]
    import json

    back = formats.parse_jsonld(json.dumps(formats.to_jsonld(plain)))
    assert set(back) == set(plain)
    with pytest.raises(ValueError):
        formats.jsonld_expand({"@context": "http://remote/", "a": 1})


def test_binary_formats():
    value = {"b": [1, -5, 2**40, None, True, "é", b"\x00"], "a": {"c": 1.5}, "link": formats.Cid.of(b"x")}
    data = formats.cbor_encode(value)
    assert formats.cbor_decode(data) == value and formats.cbor_encode(formats.cbor_decode(data)) == data
    for bad in (b"\x18\x01", b"\xa2\x61b\x01\x61a\x02", b"\x01\x01", b"\x82\x01", b"\xf9\x00\x00"):
        with pytest.raises(ValueError):
            formats.cbor_decode(bad)
    c = formats.Cid.of(b"hello")
    assert formats.Cid.parse(str(c)) == c and c.verify(b"hello") and not c.verify(b"hullo")
    block = formats.cbor_encode({"x": 1})
    car = formats.write_car([formats.Cid.of(block)], {formats.Cid.of(block): block})
    assert formats.read_car(car) == ([formats.Cid.of(block)], {formats.Cid.of(block): block})
    with pytest.raises(ValueError):
        formats.read_car(car[:-1] + b"\x02")
    for term in ("Ihttp://x/a", "Bb", t.literal("x", lang="en"), t.triple("Ia", "Ip", t.literal("1", t.XSD + "integer"))):
        assert formats.term_from_json(formats.term_to_json(term)) == term


def test_canonical_labels(spark):
    r = random.Random(4)
    rows = [("Bx", f"I{X}p", "By", None), ("By", f"I{X}p", "Bz", None), ("Bz", f"I{X}p", "Bx", None), ("Bx", f"I{X}q", t.literal("1"), None), ("Bq", f"I{X}p", f"I{X}o", "Ihttp://g")]
    ring = [(f"B{k}", f"I{X}n", f"B{(k + 1) % 5}", None) for k in range(5)]
    for graph_ in (rows, ring):
        base = canonical.canonical_lines(graph_)
        for _ in range(5):
            names = sorted({x for q in graph_ for x in q if x and x[0] == "B"})
            new = dict(zip(names, r.sample([f"Bn{k}" for k in range(50)], len(names))))
            other = [tuple(new.get(x, x) for x in q) for q in graph_]
            r.shuffle(other)
            assert canonical.canonical_lines(other) == base
    one = sorted(map(str, canonical.labelled(quads(spark, rows)).collect()))
    other = [tuple({"Bx": "Bm", "By": "Bk", "Bz": "Ba"}.get(x, x) for x in q) for q in rows]
    assert sorted(map(str, canonical.labelled(quads(spark, other)).collect())) == one
    inner = t.triple("Ia", "Ip", "Ib")
    encoded = canonical.basic_encode(quads(spark, [("Is", "Ip", inner, None)])).collect()
    assert len(encoded) == 4 and not any(x.o.startswith("T") for x in encoded)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT ?s ?n { ?s :p ?o OPTIONAL { ?s :n ?n FILTER(?n > 1 && ?n != 3) } MINUS { ?s :q ?z } } ORDER BY DESC(?s) LIMIT 5", "SELECT DISTINCT ?x { { ?x :p+/^:q ?y } UNION { ?x !(:a|^:b) ?y } VALUES (?x) { (:a) (UNDEF) } }",
        "SELECT ?s (COUNT(*) AS ?n) { ?s :p ?o FILTER EXISTS { ?o :p? ?z } } GROUP BY ?s", "SELECT ?x { GRAPH ?g { ?x :p 'a'@en } BIND(IF(?x IN (:a, :b), STRLEN('q'), -1) AS ?y) }",
    ],
)
def test_text_round_trip(spark, text):
    ds = Dataset(spark, quads(spark, rdf.parse_turtle('@prefix : <http://x/> . :a :p :b ; :n 2, 3, 4 . :b :p :c ; :q :a . :c :q :b . GRAPH :g { :a :p "a"@en }')), prefixes={"": X})
    again = writer.select(parse_query(text, ds.prefixes).pattern)
    assert sorted(map(str, ds.query(again).terms().collect())) == sorted(map(str, ds.query(text).terms().collect()))


def test_rewrites():
    b = A.Bgp((A.Triple(A.Var("s"), A.Var("p"), A.Var("o")),))
    tree = A.Slice(A.Slice(A.Distinct(A.Distinct(A.Join(A.Unit(), b))), 2, 10), 3, None)
    assert rewrites.rewrite(tree, [rewrites.simplify]) == A.Slice(A.Distinct(b), 5, 7)
    assert rewrites.simplify(A.Join(A.Table(("a",), ()), A.Table(("b",), (("I1",),)))) == A.Table(("a", "b"), ())


def test_rcc8_el_and_profiles(spark):
    m = regions.mask
    assert regions.compose(m("ntpp"), m("ntpp")) == m("ntpp") and regions.compose(m("eq"), m("po")) == m("po") and regions.inverse(m("tpp po")) == m("tppi po")
    for a in range(8):
        for b in range(8):
            assert regions.inverse(regions.COMPOSITION[a][b]) == regions.compose(regions.inverse(1 << b), regions.inverse(1 << a))
    facts = spark.createDataFrame([("x", "y", m("ntpp")), ("y", "z", m("dc")), ("x", "w", m("tpp")), ("w", "x", m("tpp"))], "a string, b string, relations int")
    got = {(r.a, r.b): r.relations for r in regions.rcc8_closure(facts).collect()}
    assert got["x", "z"] == m("dc") and got["z", "x"] == m("dc") and got["x", "w"] == 0
    up = regions.el_classify([("sub", "A", "B"), ("sub-some", "B", "r", "C"), ("sub", "C", "D"), ("some", "r", "D", "E"), ("and", ("A", "E"), "F"), ("sub-some", "G", "r", "H"), ("sub", "H", "⊥")])
    assert {"B", "E", "F"} <= up["A"] and "⊥" in up["G"] and "E" not in up["C"]
    d = quads(spark, rdf.parse_turtle("@prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix : <http://x/> . :p a owl:TransitiveProperty . :q owl:inverseOf :p ."))
    assert {(r.profile, r.construct) for r in regions.profile_violations(d).collect()} == {("EL", "inverseOf"), ("QL", "TransitiveProperty")}
    assert regions.strategy(d) == "rl" and regions.strategy(d.limit(0)) == "none"


GEO_DATA = """@prefix : <http://x/> . @prefix geo: <http://www.opengis.net/ont/geosparql#> .
:a geo:hasDefaultGeometry :ga . :ga geo:asWKT "POINT(1 1)" . :b geo:hasDefaultGeometry [ geo:asWKT "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))" ] . :c geo:sfWithin :b . :d geo:hasDefaultGeometry [ geo:asWKT "POINT(9 9)" ] ."""


def test_geo_rewrite_and_aggregates(spark):
    from tessera.functions import geo

    ds = Dataset(spark, quads(spark, rdf.parse_turtle(GEO_DATA)), prefixes={"": X, "geo": geo.GEO, "geof": geo.GEOF}, rewrites=[geo.rewrite_relations, rewrites.simplify])
    for name, f in geo.functions().items():
        ds.registry.add(name, f)
    for name, f in geo.aggregates().items():
        ds.registry.add(name, f, aggregate=True)
    got = {t.parse_term(r.s)[1] for r in ds.query("SELECT ?s { ?s geo:sfWithin :b FILTER(ISIRI(?s)) }").terms().collect()}
    assert got == {X + "a", X + "c", X + "ga", X + "b"}
    row = ds.query("SELECT (geof:aggBoundingBox(?w) AS ?b) (geof:aggCentroid(?w) AS ?c) { VALUES ?w { 'POINT(1 1)' 'POINT(9 9)' } }").df.first()
    assert row.b == "POLYGON((1 1, 9 1, 9 9, 1 9, 1 1))" and row.c == "POINT(5 5)"
    assert geo.is_simple(geo.parse_wkt("LINESTRING(0 0, 1 1, 2 0)")) and not geo.is_simple(geo.parse_wkt("LINESTRING(0 0, 2 2, 2 0, 0 2)")) and geo.is_simple(geo.parse_wkt("LINESTRING(0 0, 1 0, 1 1, 0 0)"))
    assert "<gml:pos>1 2</gml:pos>" in geo.to_gml(geo.parse_wkt("POINT(1 2)")) and "<coordinates>1,2</coordinates>" in geo.to_kml(geo.parse_wkt("POINT(1 2)"))


def test_shacl_extensions(spark):
    from tessera.operators import shacl

    pre = "@prefix : <http://x/> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .\n"
    data = rdf.parse_turtle(pre + ":a :k 1 ; :m 5 . :b :k 1 ; :m 50 . :c :k 2 ; :m 7 .")
    data += [("Br", t.iri(t.RDF + "reifies"), t.triple(f"I{X}a", f"I{X}m", t.literal("5", t.XSD + "integer")), None)]
    shapes = """:MaxC a sh:ConstraintComponent ; sh:parameter [ sh:path :most ] ; sh:validator [ a sh:SPARQLAskValidator ; sh:ask "ASK { FILTER($value <= $most) }" ] .
      :S a sh:NodeShape ; sh:targetSubjectsOf :k ; sh:uniqueValuesFor (:k) ; sh:property [ sh:path :m ; :most 10 ; sh:reifierShape [ sh:property [ sh:path :source ; sh:minCount 1 ] ] ] ."""
    v = shacl.Validator(Dataset(spark, quads(spark, data)), shacl.Shapes(rdf.parse_turtle(pre + shapes)))
    got = {(r.focus.replace("I" + X, ":"), r.component.rsplit("#")[-1].rsplit("/")[-1]) for r in v.report().collect()}
    assert got == {(":a", "UniqueValuesForConstraintComponent"), (":b", "UniqueValuesForConstraintComponent"), (":b", "MaxC"), (":a", "ReifierShapeConstraintComponent")}


def test_store_recovers(spark, tmp_path):
    from tessera.operators.update import GraphStore

    where = f"file://{tmp_path}/store"
    store = GraphStore(spark, manifest=where)
    store.insert([("Ia", "Ip", "Ib", None)])
    store.update("CREATE GRAPH <http://g>")
    store.fork("other")
    store.insert([("Ia", "Ip", "Ic", None)], "other")
    again = GraphStore.open(spark, where)
    assert again.quads().count() == 1 and again.quads("other").count() == 2 and again.heads["main"].graphs == {"Ihttp://g"}
    again.insert([("Ix", "Ip", "Iy", None)])
    assert GraphStore.open(spark, where).quads().count() == 2


def test_owl_syntaxes(spark):
    from tessera.operators import inference
    from tessera.sources import owl

    text = """Prefix(:=<http://x/>) Ontology(<http://x/o> Declaration(Class(:A)) SubClassOf(:A ObjectSomeValuesFrom(:r :B)) EquivalentClasses(:C ObjectSomeValuesFrom(:r :B)) TransitiveObjectProperty(:t)
      SubObjectPropertyOf(ObjectPropertyChain(:p :q) :u) ClassAssertion(:B :b) ObjectPropertyAssertion(:r :a :b) DataPropertyAssertion(:d :a "5"^^xsd:integer) DisjointClasses(:A :B :E) SameIndividual(:a :a2)
      SubClassOf(:F ObjectMaxCardinality(1 :r :B)) HasKey(:A () (:d)) NegativeObjectPropertyAssertion(:t :a :b) ObjectPropertyAssertion(ObjectInverseOf(:t) :m :n))"""
    rows = owl.parse_functional(text)
    got = {(s, p, o) for s, p, o, _ in rows}
    x = lambda n: f"I{X}{n}"
    assert {(x("A"), t.iri(t.RDF + "type"), t.iri(t.OWL + "Class")), (x("t"), t.iri(t.RDF + "type"), t.iri(t.OWL + "TransitiveProperty")), (x("a"), x("d"), t.literal("5", t.XSD + "integer")), (x("n"), x("t"), x("m")), (x("a"), t.iri(t.OWL + "sameAs"), x("a2"))} <= got
    assert any(p == t.iri(t.OWL + "maxQualifiedCardinality") for _, p, _ in got) and any(p == t.iri(t.OWL + "propertyChainAxiom") for _, p, _ in got)
    closed, cliques = inference.owl_rl(quads(spark, rows))
    assert (x("a"), t.iri(t.RDF + "type"), x("C")) in {(r.s, r.p, r.o) for r in inference.expand(closed, cliques).collect()}
    xml = f"""<Ontology xmlns="{t.OWL}" ontologyIRI="http://x/o"><Prefix name="" IRI="{X}"/><Declaration><Class abbreviatedIRI=":A"/></Declaration>
      <SubClassOf><Class abbreviatedIRI=":A"/><ObjectMinCardinality cardinality="2"><ObjectProperty IRI="{X}r"/></ObjectMinCardinality></SubClassOf>
      <DataPropertyAssertion><DataProperty IRI="{X}d"/><NamedIndividual IRI="{X}a"/><Literal datatypeIRI="{t.XSD}integer">5</Literal></DataPropertyAssertion></Ontology>"""
    more = {(s, p, o) for s, p, o, _ in owl.parse_owlxml(xml)}
    assert (x("a"), x("d"), t.literal("5", t.XSD + "integer")) in more and any(p == t.iri(t.OWL + "minCardinality") for _, p, _ in more)
    for bad in ("Ontology(Nonsense(:a))", "Prefix(:=<http://x/>) Ontology(SubClassOf(:a Wrong(:b)))"):
        with pytest.raises((ValueError, KeyError)):
            owl.parse_functional(bad)


def test_hypercube_packs_integers_and_keeps_multiplicity(spark):
    r = random.Random(5)
    for kind, value in (("int", lambda k: k), ("bigint", lambda k: (-1) ** k * k * 2**58 if k else None), ("string", lambda k: f"v{k}" if k else None)):
        rows = [[(value(r.randrange(9)), value(r.randrange(9))) for _ in range(60)] for _ in range(3)]
        frames = [spark.createDataFrame(x, f"{m} {kind}, {n} {kind}") for x, (m, n) in zip(rows, ("ab", "bc", "ca"))]
        want = sorted((a, b, c) for a, b in rows[0] for b2, c in rows[1] if None not in (a, b, c) and b == b2 for c2, a2 in rows[2] if (c, a) == (c2, a2))
        for side in (None, 3):
            found = multiway.hypercube_triangles(*frames, side)
            assert sorted(map(tuple, found.collect())) == want and want and [x[1] for x in found.dtypes] == [kind] * 3
        # pairs of two relations are not sorted: integers are looked up in the cells, others hashed
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("ShuffledHashJoin" in plan) if kind == "string" else ("Join" not in plan)
    empty = spark.createDataFrame([], "a int, b int")
    assert multiway.hypercube_triangles(empty, empty.toDF("b", "c"), empty.toDF("c", "a")).count() == 0


def test_hypercube_slices_what_it_extends(spark, monkeypatch):
    import pyarrow as pa

    e = [(r.src, r.dst) for r in graph.both_ways(graph.random_graph(spark, 30, 0.3, 4)).collect()]
    monkeypatch.setattr(multiway, "SLICE", 7)
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in e], pa.int64()), pa.array([y for _, y in e], pa.int64())], names=["x", "y"])
    cells = [x for k in range(3) for x in multiway._packer(k, 2)(iter([batch]))]
    whole = pa.Table.from_batches(cells).sort_by("cell").to_batches()
    got = [t for b in multiway._joined_cells(iter(whole)) for t in zip(*b.to_pydict().values())]
    edges = set(e)
    assert sorted(got) == sorted((a, b, c) for a, b in edges for b2, c in edges if b == b2 and (c, a) in edges) and len(got) > 100


def test_nodes_that_nothing_connects_are_labelled_by_hashes(spark, monkeypatch):
    one, two = t.literal("1"), t.literal("2")
    rows = [("Ba", f"I{X}p", one, None), ("Ba", f"I{X}p", two, None), ("Bb", f"I{X}p", one, None), ("Bc", f"I{X}p", "Bc", None), (f"I{X}i", f"I{X}p", "Bb", f"I{X}g"), (f"I{X}i", f"I{X}q", one, "Bg"), ("Bx", f"I{X}p", "By", None), (f"I{X}i", f"I{X}p", f"I{X}j", None)]
    new = {"Ba": "Bn7", "Bb": "Bn3", "Bc": "Bn1", "Bg": "Bn9", "Bx": "Bn2", "By": "Bn8"}
    other = [tuple(new.get(x, x) for x in q) for q in rows]
    found = lambda *x: sorted({tuple(map(str, r)) for r in canonical.labelled(*x).collect()})
    want = found(quads(spark, rows))
    assert len(want) == len(rows) and len({x for q in want for x in (q[0], q[2], q[3]) if x[0] == "B"}) == 6 and not {x for q in want for x in q} & set(new)
    assert found(quads(spark, other + other[:3])) == want
    # the same from rows that hold a part of a subject's quads each, some of them twice
    parts: dict = {}
    for s, p, o, g in other:
        parts.setdefault(s, []).append((p, o, g))
    stars = [(s, part) for s, x in parts.items() for part in (x[:1], x)]
    assert found(quads(spark, other), spark.createDataFrame(stars, "s string, quads array<struct<p string, o string, g string>>")) == want
    # no Python, and no quads as text, for nodes that nothing connects
    monkeypatch.setattr(canonical, "Canonicalizer", None)
    plan = canonical.labelled(quads(spark, rows[:6]))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct" not in plan and "MapInArrow" not in plan
