import duckdb
import pytest

from tessera import queries
from tessera.engine import Dataset
from tessera.operators import inference, paths
from tessera.operators.update import GraphStore
from tessera.sources import rdf
from tessera.sources.mapping import tpch

FOLDER = "/root/testdata/sf0.001"


def test_statistics_and_state_are_of_the_whole_graph(spark):
    m, triples = tpch(spark, FOLDER), set()
    for name, x in m.tables.items():
        for row in m.load(name).collect():
            s = (name, *(row[k] for k in x.keys))
            said = [("type", name), *((p, row[c]) for p, c in x.columns.items()), *((p, (to, *(row[c] for c in cs))) for p, (cs, to) in x.links.items())]
            triples |= {(s, p, o) for p, o in said if o is not None}
    got = queries.QUERIES["graph_statistics_all"](spark, FOLDER).first()
    assert (got.triples, got.subjects, got.predicates) == (len(triples), *(len({x[k] for x in triples}) for k in (0, 1)))
    # the nations' triples stand once more in the graphs of their regions
    named = sum(s[0] == "nation" for s, _, _ in triples)
    assert queries.QUERIES["state_hash"](spark, FOLDER).first().n == len(triples) + named


@pytest.mark.parametrize("name", ["graph_named_all", "construct_all", "update_modify_all", "rdfs_types_all", "shacl_range_all"])
def test_rows_are_those_of_the_sql(spark, name):
    db = duckdb.connect()
    for x in tpch(spark, FOLDER).tables:
        db.sql(f"CREATE VIEW {x} AS SELECT * FROM '{FOLDER}/{x}.parquet'")
    want = sorted(map(tuple, db.sql(queries.SQL[name]).fetchall()))
    got = sorted(map(tuple, queries.QUERIES[name](spark, FOLDER).collect()))
    assert got == want and got


def test_a_predicate_leaves_the_columns_that_have_it(spark):
    found = tpch(spark, FOLDER).quads().distinct().where("p = 'Ihttp://example.org/n_name'")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "n_name" in plan and found.count() == 25


def test_rdfs_takes_repeats_and_known_triples(spark):
    text = "@prefix : <http://x/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . :A rdfs:subClassOf :B . :B rdfs:subClassOf :C . :p rdfs:domain :A ; rdfs:subPropertyOf :q . :x :p :y . :x a :B . :x :q :y . :z a :A ."
    d = spark.createDataFrame(rdf.parse_turtle(text), rdf.QUADS)
    got = sorted(tuple(x.rsplit("/", 1)[-1].rsplit("#", 1)[-1] for x in r) for r in inference.rdfs(d.unionByName(d)).collect())
    assert got == sorted([("A", "subClassOf", "C"), ("x", "type", "A"), ("x", "type", "C"), ("z", "type", "B"), ("z", "type", "C")])


def test_a_store_over_quads_writes_its_changes_only(spark):
    text = "@prefix : <http://x/> . :a :p 1 , 2 ; :q 3 . :b :p 1 ."
    d = spark.createDataFrame(rdf.parse_turtle(text), rdf.QUADS)
    lazy, full = GraphStore.over(spark, d), GraphStore(spark)
    full.insert(d)
    rows = lambda df: sorted(map(repr, df.collect()))
    for store in (lazy, full):
        store.fork("w")
    for text in ("DELETE DATA { :a :p 1 }", "DELETE { ?s :p ?o } INSERT { ?o :was ?s . ?s :p 1 } WHERE { ?s :p ?o }"):
        for store in (lazy, full):
            store.update(text, "w", {"": "http://x/"})
    assert rows(lazy.quads("w")) == rows(full.quads("w")) and rows(lazy.diff("main", "w")) == rows(full.diff("main", "w"))
    assert lazy.heads["w"].path is None and rows(lazy.quads()) == rows(d)


def test_a_path_starts_from_the_nodes_it_is_joined_with(spark, monkeypatch):
    text = "@prefix : <http://x/> . :a :n 1 ; :next :b . :b :next :c . :c :next :a . :d :next :a ; :n 2 . :e :n 3 ."
    d = Dataset(spark, spark.createDataFrame(rdf.parse_turtle(text), rdf.QUADS), prefixes={"": "http://x/"})
    seen, closure = [], paths.closure
    monkeypatch.setattr(paths, "closure", lambda edges, seeds=None, **k: seen.append(seeds) or closure(edges, seeds, **k))
    got = sorted((r.s[-1], r.y[-1]) for r in d.select("SELECT ?s ?y { ?s :n ?x . ?s :next* ?y }").collect())
    assert got == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "a"), ("d", "b"), ("d", "c"), ("d", "d"), ("e", "e")]
    assert len(seen) == 1 and seen[0].count() == 3


def test_owl_rl_writes_what_its_axioms_name(spark, monkeypatch):
    written = []
    monkeypatch.setattr(inference, "settle", lambda df, what="step", settle=inference.settle: (written.append((out := settle(df, what)).count()), out)[1])
    got = sorted(map(tuple, queries.QUERIES["owl_rl_inverse"](spark, FOLDER).collect()))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW nation AS SELECT * FROM '{FOLDER}/nation.parquet'")
    assert got == sorted(map(tuple, db.sql(queries.SQL["owl_rl_inverse"]).fetchall())) and got
    assert sum(written) < 2000 < tpch(spark, FOLDER).quads().count()


def test_owl_rl_takes_repeats_derived_axioms_and_late_cliques(spark):
    text = """@prefix : <http://x/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
      :p rdfs:subPropertyOf rdfs:subClassOf . :A :p :B . :u a :A . :q owl:inverseOf :r . :a :q :b . :r a owl:FunctionalProperty . :c :q :b . :a :n 1 . :c :n 2 ."""
    d = spark.createDataFrame(rdf.parse_turtle(text), rdf.QUADS)
    closed, cliques = inference.owl_rl(d.unionByName(d))
    short = lambda x: x.rsplit("/", 1)[-1].rsplit("#", 1)[-1].rsplit("\x01", 1)[-1]
    got = [tuple(map(short, r)) for r in closed.collect()]
    assert len(got) == len(set(got)) and {("u", "type", "B"), ("A", "subClassOf", "B"), ("b", "r", "a"), ("a", "n", "1"), ("a", "n", "2")} <= set(got)
    assert not any(r[0] == "c" for r in got) and ("c", "a") in {(short(r.node), short(r.component)) for r in cliques.collect()}
