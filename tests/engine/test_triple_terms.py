import pytest

from tessera.engine import Dataset
from tessera.plans.parser import SparqlSyntaxError, parse_query
from tessera.sources.rdf import parse_turtle

HEAD = "@prefix : <http://e/> . "
DATA = HEAD + """
:a :knows :b ~ :r1 {| :since 2001 ; :by :x |} .
:a :knows :c {| :since 2005 |} , :d .
<< :b :knows :c ~ :r2 >> :since 2009 .
<< :b :knows :a >> .
:s :says <<( :a :knows <<( :b :knows _:k )>> )>> .
:t :says "no triple" .
"""


@pytest.fixture(scope="module")
def data(spark):
    return Dataset(spark, Dataset.of(spark, parse_turtle(DATA)).quads, prefixes={"": "http://e/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"})


def rows(data, text):
    found = data.query(text)
    return sorted(tuple(str(x).rsplit("/", 1)[-1].rsplit("\x01", 1)[-1] for x in r) for r in found.df.collect())


CASES = {
    "SELECT ?o ?y { :a :knows ?o {| :since ?y |} }": [("b", "2001"), ("c", "2005")],
    "SELECT ?o ?r { :a :knows ?o ~ ?r {| :by :x |} }": [("b", "r1")],
    "SELECT ?s ?o ?y { << ?s :knows ?o >> :since ?y }": [("a", "b", "2001"), ("a", "c", "2005"), ("b", "c", "2009")],
    "SELECT ?s ?o { ?r rdf:reifies <<( ?s :knows ?o )>> }": [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c")],
    "SELECT ?p { :r2 rdf:reifies <<( :b ?p :c )>> }": [("knows",)],
    "SELECT ?x { << ?x :knows ?y >> :since ?a . << ?y :knows ?z >> :since ?b }": [("a",)],
    "SELECT ?x { :s :says <<( ?x :knows <<( ?y ?p ?z )>> )>> . ?x ?p ?y }": [("a",)],
    "SELECT ?s { ?s :says ?o OPTIONAL { ?s :says <<( ?a :knows ?b )>> } FILTER(!BOUND(?a)) }": [("t",)],
    "SELECT ?x { ?r rdf:reifies <<( ?x :knows ?x )>> }": [],
    "SELECT ?o { << :a :knows ?o ~ :r1 >> . }": [("b",)],
    "SELECT ?o { :a :knows ?o . FILTER NOT EXISTS { << :a :knows ?o >> :since ?y } }": [("d",)],
}


@pytest.mark.parametrize("text", CASES)
def test_patterns(data, text):
    assert rows(data, text) == CASES[text]


def test_expression_and_construct(data):
    assert rows(data, "SELECT ?n { :a :knows ?o . BIND(OBJECT(<<( :a :knows ?o )>>) AS ?n) }") == [("b",), ("c",), ("d",)]
    made = data.query("CONSTRUCT { ?s :met ?o {| :in ?y |} } WHERE { << ?s :knows ?o >> :since ?y }").quads.collect()
    told = {x.s: x.o for x in made if x.p.endswith("/in")}
    terms = {x.s: x.o for x in made if x.p.endswith("reifies")}
    assert len(made) == 9 and len(told) == 3 and set(told) == set(terms) and all(s[0] == "B" for s in told)
    assert {x.split("\x02")[1] for x in terms.values()} == {"Ihttp://e/met"}


def test_blank_nodes_of_turtle_are_one_inside_and_outside():
    quads = parse_turtle(HEAD + "_:b :p :o ~ _:r {| :q _:b |} .", scope="z")
    (term,) = [o for _, p, o, _ in quads if p.endswith("reifies")]
    (subject,) = [s for s, p, _, _ in quads if p.endswith("/p")]
    assert term.split("\x02")[0] == "T" + subject and subject[0] == "B"


@pytest.mark.parametrize("text", ["SELECT * { ?s :p/:q ?o {| :r ?x |} }", "SELECT * { <<( ?s ?p ?o )>> ?q ?x }", "SELECT * { << ?s :p/:q ?o >> ?q ?x }"])
def test_what_is_no_pattern(text):
    with pytest.raises(SparqlSyntaxError):
        parse_query(text, {"": "http://e/"})


def test_parts_of_a_triple_term_are_bound(data):
    """So that joins on them are one equi-join each, not a product for every part that might be unbound."""
    found = data.query("SELECT ?s ?o ?y { ?s :knows ?o {| :since ?y |} }").solutions
    assert {"s", "o", "y"} <= found.certain
    assert "Union" not in found.df._jdf.queryExecution().optimizedPlan().toString()
