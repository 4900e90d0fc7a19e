"""The engine's queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .engine import Dataset
from .functions import geo, jsonata, jsonschema
from .functions import terms as t
from .operators import graph, inference, multiway, paths, regions, scans, shacl, temporal
from .operators.update import GraphStore
from .shared import settle
from .sources import canonical, rdf
from .sources.mapping import BASE, tpch

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
SQL: dict[str, str] = {}


def dataset(spark: SparkSession, folder: str) -> Dataset:
    return Dataset(spark, mapping=tpch(spark, folder), prefixes={"": BASE, "xsd": "http://www.w3.org/2001/XMLSchema#"})


def sparql(name: str, text: str, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: dataset(spark, folder).select(text)
    if sql:
        SQL[name] = sql


def plan(name: str, sql: str | None = None):
    def add(function: Q) -> Q:
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# SPARQL algebra
sparql(
    "flagship",
    """SELECT ?nation (COUNT(*) AS ?orders) (SUM(?price) AS ?total) WHERE {
         ?o a :Orders ; :o_totalprice ?price ; :orderedBy ?c . ?c :ofNation ?n . ?n :n_name ?nation FILTER(?price > 1000) }
       GROUP BY ?nation ORDER BY DESC(?total) ?nation LIMIT 10""",
    """SELECT n_name AS nation, count(*) AS orders, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       WHERE o_totalprice > 1000 GROUP BY 1 ORDER BY total DESC, nation LIMIT 10""",
)
sparql("bgp_star", "SELECT ?key ?price ?status WHERE { ?o a :Orders ; :o_orderkey ?key ; :o_totalprice ?price ; :o_orderstatus ?status }", "SELECT o_orderkey AS key, o_totalprice AS price, o_orderstatus AS status FROM orders")
sparql("bgp_constant", "SELECT ?key WHERE { ?o :o_orderkey ?key ; :o_orderstatus 'F' ; :orderedBy :customer\\/1 }", "SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 1")
sparql(
    "bgp_chain_join",
    "SELECT ?key ?name ?region WHERE { ?o :o_orderkey ?key ; :orderedBy ?c . ?c :c_name ?name ; :ofNation ?n . ?n :inRegion ?r . ?r :r_name ?region }",
    "SELECT o_orderkey AS key, c_name AS name, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
sparql("bgp_cartesian", "SELECT ?a ?b WHERE { ?x :r_name ?a . ?y :n_name ?b }", "SELECT r_name AS a, n_name AS b FROM region, nation")
sparql("bgp_any_predicate", "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p HAVING(COUNT(*) < 30)", """
  SELECT 'I' || p AS p, n FROM (SELECT 'http://example.org/n_nationkey' AS p, count(*) AS n FROM nation UNION ALL SELECT 'http://example.org/n_name', count(*) FROM nation
  UNION ALL SELECT 'http://example.org/inRegion', count(*) FROM nation UNION ALL SELECT 'http://example.org/r_regionkey', count(*) FROM region UNION ALL SELECT 'http://example.org/r_name', count(*) FROM region) WHERE n < 30""")
sparql(
    "optional_left_join",
    "SELECT ?name ?key WHERE { ?c :c_name ?name OPTIONAL { ?o :orderedBy ?c ; :o_orderkey ?key } }",
    "SELECT c_name AS name, o_orderkey AS key FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
)
sparql(
    "optional_with_condition",
    "SELECT ?name ?key WHERE { ?c :c_name ?name ; :c_acctbal ?b OPTIONAL { ?o :orderedBy ?c ; :o_orderkey ?key ; :o_totalprice ?p FILTER(?p > 40 * ?b) } }",
    "SELECT c_name AS name, o_orderkey AS key FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 40 * c_acctbal",
)
sparql(
    "optional_then_join",
    "SELECT ?name ?n ?k WHERE { ?c :c_custkey ?k ; :c_name ?name OPTIONAL { ?c :c_acctbal ?b ; :ofNation ?n FILTER(?b > 5000) } ?s :s_suppkey ?k ; :supplierNation ?n }",
    """SELECT c_name AS name, 'http://example.org/nation/' || s_nationkey AS n, c_custkey AS k FROM customer JOIN supplier ON s_suppkey = c_custkey
       WHERE NOT (c_acctbal > 5000) OR c_nationkey = s_nationkey""",
)
sparql("union", "SELECT ?name WHERE { { ?c :c_name ?name } UNION { ?s :s_name ?name } UNION { ?s :s_name ?name } }", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT s_name FROM supplier")
sparql("union_of_other_variables", "SELECT ?c ?s WHERE { { ?x :c_name ?c } UNION { ?y :s_name ?s } }", "SELECT c_name AS c, NULL::VARCHAR AS s FROM customer UNION ALL SELECT NULL, s_name FROM supplier")
sparql(
    "minus_anti",
    "SELECT ?name WHERE { ?c :c_name ?name MINUS { ?o :orderedBy ?c ; :o_totalprice ?p FILTER(?p > 300000) } }",
    "SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
)
sparql("minus_disjoint", "SELECT ?name WHERE { ?c :r_name ?name MINUS { ?x :n_name ?y } }", "SELECT r_name AS name FROM region")
sparql("exists_semi", "SELECT ?name WHERE { ?c :c_name ?name FILTER EXISTS { ?o :orderedBy ?c ; :o_orderstatus 'P' } }", "SELECT c_name AS name FROM customer WHERE EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
sparql("not_exists_anti", "SELECT ?name WHERE { ?c :c_name ?name FILTER NOT EXISTS { ?o :orderedBy ?c ; :o_orderstatus 'P' } }", "SELECT c_name AS name FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
sparql(
    "exists_correlated_filter",
    "SELECT ?name WHERE { ?c :c_name ?name ; :c_acctbal ?b FILTER EXISTS { ?o :orderedBy ?c ; :o_totalprice ?p FILTER(?p < ?b) } }",
    "SELECT c_name AS name FROM customer WHERE EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_totalprice < c_acctbal)",
)
sparql(
    "exists_inside_or",
    "SELECT ?name WHERE { ?c :c_name ?name ; :c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?o :orderedBy ?c ; :o_orderstatus 'P' }) }",
    "SELECT c_name AS name FROM customer WHERE c_acctbal > 9000 OR EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
)
sparql("filter_range", "SELECT ?key WHERE { ?o :o_orderkey ?key ; :o_totalprice ?p FILTER(?p >= 1000 && ?p < 90000.5) }", "SELECT o_orderkey AS key FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 90000.5")
sparql("filter_in", "SELECT ?name WHERE { ?p :p_name ?name ; :p_size ?s FILTER(?s IN (1, 5, 9.0) && ?s NOT IN (5)) }", "SELECT p_name AS name FROM part WHERE p_size IN (1, 9)")
sparql("filter_date", "SELECT ?key WHERE { ?o :o_orderkey ?key ; :o_orderdate ?d FILTER(?d >= '1996-01-01T00:00:00'^^xsd:dateTime) }", "SELECT o_orderkey AS key FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
sparql("filter_error_is_false", "SELECT ?name WHERE { ?c :c_name ?name ; :c_acctbal ?b FILTER(?name + 1 > 2 || ?b > 5000) }", "SELECT c_name AS name FROM customer WHERE c_acctbal > 5000")
sparql("bind_extend", "SELECT ?key ?net WHERE { ?l :l_orderkey ?key ; :l_extendedprice ?p ; :l_discount ?d BIND(?p * (1 - ?d) AS ?net) }", "SELECT l_orderkey AS key, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
sparql("values_join", "SELECT ?name ?k WHERE { VALUES (?k ?x) { (1 'a') (3 UNDEF) (3 'b') (UNDEF 'c') } ?n :n_nationkey ?k ; :n_name ?name }", """
  SELECT n_name AS name, n_nationkey::BIGINT AS k FROM nation, (VALUES (1), (3), (3), (NULL)) v(x) WHERE x IS NULL OR x = n_nationkey""")
sparql(
    "subselect",
    "SELECT ?name ?n WHERE { ?c :c_name ?name { SELECT ?c (COUNT(*) AS ?n) WHERE { ?o :orderedBy ?c } GROUP BY ?c } FILTER(?n > 5) }",
    "SELECT c_name AS name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE n > 5",
)
sparql("distinct", "SELECT DISTINCT ?s ?p WHERE { ?o :o_orderstatus ?s ; :o_orderpriority ?p }", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
sparql("reduced", "SELECT REDUCED ?s WHERE { ?o :o_orderstatus ?s }", "SELECT o_orderstatus AS s FROM orders")
sparql("order_limit_topk", "SELECT ?key ?p WHERE { ?o :o_orderkey ?key ; :o_totalprice ?p } ORDER BY DESC(?p) ?key LIMIT 20", "SELECT o_orderkey AS key, o_totalprice AS p FROM orders ORDER BY p DESC, key LIMIT 20")
sparql("offset_slice", "SELECT ?key WHERE { ?o :o_orderkey ?key } ORDER BY ?key OFFSET 30 LIMIT 12", "SELECT o_orderkey AS key FROM orders ORDER BY key LIMIT 12 OFFSET 30")
sparql(
    "group_aggregates",
    """SELECT ?st (COUNT(?p) AS ?n) (SUM(?q) AS ?s) (AVG(?q) AS ?a) (MIN(?p) AS ?lo) (MAX(?p) AS ?hi) (COUNT(DISTINCT ?f) AS ?d)
       WHERE { ?l :l_linestatus ?st ; :l_extendedprice ?p ; :l_quantity ?q ; :l_returnflag ?f } GROUP BY ?st""",
    "SELECT l_linestatus AS st, count(*) AS n, sum(l_quantity) AS s, avg(l_quantity) AS a, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(DISTINCT l_returnflag) AS d FROM lineitem GROUP BY 1",
)
sparql("group_expression", "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o :o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")
sparql("group_concat", "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR='|') AS ?names) WHERE { ?x :n_name ?n ; :inRegion ?g . ?g :r_name ?r } GROUP BY ?r", "SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
sparql("group_sample", "SELECT ?r (SAMPLE(?r) AS ?x) WHERE { ?g :r_name ?r } GROUP BY ?r", "SELECT r_name AS r, r_name AS x FROM region")
sparql("count_distinct_rows", "SELECT (COUNT(DISTINCT *) AS ?n) WHERE { ?o :o_orderstatus ?s ; :o_orderpriority ?p }", "SELECT count(*) AS n FROM orders")
sparql("aggregate_of_nothing", "SELECT (COUNT(*) AS ?n) (SUM(?p) AS ?s) WHERE { ?o :o_totalprice ?p FILTER(?p < -1) }", "SELECT 0::BIGINT AS n, 0::DOUBLE AS s")
sparql("aggregate_error", "SELECT ?s (SUM(?k) AS ?t) WHERE { { ?c :c_mktsegment ?s ; :c_acctbal ?k } UNION { ?c :c_mktsegment ?s ; :c_name ?k FILTER(?s = 'BUILDING') } } GROUP BY ?s", """
  SELECT c_mktsegment AS s, CASE WHEN c_mktsegment <> 'BUILDING' THEN sum(c_acctbal) END AS t FROM customer GROUP BY 1""")
sparql("having", "SELECT ?c (SUM(?p) AS ?t) WHERE { ?o :orderedBy ?x ; :o_totalprice ?p . ?x :c_custkey ?c } GROUP BY ?c HAVING(COUNT(*) > 12) (SUM(?p) > 1000)", "SELECT o_custkey AS c, sum(o_totalprice) AS t FROM orders GROUP BY 1 HAVING count(*) > 12 AND sum(o_totalprice) > 1000")

# built-ins
sparql(
    "fn_strings",
    """SELECT ?k (STRLEN(?n) AS ?len) (UCASE(?n) AS ?up) (LCASE(?n) AS ?low) (SUBSTR(?n, 3, 4) AS ?sub) (STRBEFORE(?n, '#') AS ?bef) (STRAFTER(?n, 'r') AS ?aft)
         (CONCAT(?n, '-', ?s) AS ?cat) (REPLACE(?n, '[0-9]+', 'N') AS ?rep) (ENCODE_FOR_URI(CONCAT(?n, ' ~*é')) AS ?enc) (CONTAINS(?n, '1') AS ?con) (STRSTARTS(?n, 'CUST') AS ?st)
         (STRENDS(?n, '7') AS ?en) (REGEX(?n, '^cust.*9$', 'i') AS ?rx) (STR(?k) AS ?str) WHERE { ?c :c_custkey ?k ; :c_name ?n ; :c_mktsegment ?s }""",
    """SELECT c_custkey AS k, length(c_name) AS len, upper(c_name) AS up, lower(c_name) AS low, substr(c_name, 3, 4) AS sub,
         CASE WHEN contains(c_name, '#') THEN split_part(c_name, '#', 1) ELSE '' END AS bef, CASE WHEN contains(c_name, 'r') THEN substr(c_name, strpos(c_name, 'r') + 1) ELSE '' END AS aft,
         c_name || '-' || c_mktsegment AS cat, regexp_replace(c_name, '[0-9]+', 'N', 'g') AS rep, url_encode(c_name || ' ~*é') AS enc, contains(c_name, '1') AS con,
         starts_with(c_name, 'CUST') AS st, ends_with(c_name, '7') AS en, regexp_matches(c_name, '^cust.*9$', 'i') AS rx, c_custkey::VARCHAR AS str FROM customer""",
)
sparql(
    "fn_numbers",
    """SELECT ?k (ABS(-?b) AS ?abs) (CEIL(?b) AS ?up) (FLOOR(?b) AS ?down) (ROUND(-?b) AS ?near) (?b / 3 AS ?third) (-?k AS ?neg) (xsd:double(?k / 4) AS ?quarter) (?k + 1 AS ?next) (?k * 2 - 1 AS ?odd)
       (xsd:integer(?b) AS ?int) (xsd:boolean(?k) AS ?yes) WHERE { ?c :c_custkey ?k ; :c_acctbal ?b }""",
    """SELECT c_custkey AS k, abs(-c_acctbal) AS abs, ceil(c_acctbal) AS up, floor(c_acctbal) AS down, floor(-c_acctbal + 0.5) AS near, c_acctbal / 3 AS third, -c_custkey AS neg, c_custkey / 4 AS quarter,
       c_custkey + 1 AS next, c_custkey * 2 - 1 AS odd, trunc(c_acctbal)::BIGINT AS int, c_custkey <> 0 AS yes FROM customer""",
)
sparql(
    "fn_dates",
    "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?mi) (xsd:double(SECONDS(?d)) AS ?s) (TZ(?d) AS ?tz) WHERE { ?e :event_id ?k ; :ts ?d }",
    "SELECT event_id AS k, year(ts) AS y, month(ts) AS m, day(ts) AS dd, hour(ts) AS h, minute(ts) AS mi, extract('microsecond' FROM ts) / 1e6 AS s, '' AS tz FROM events",
)
sparql(
    "fn_hashes",
    "SELECT ?k (MD5(?n) AS ?md5) (SHA1(?n) AS ?sha1) (SHA256(?n) AS ?sha256) WHERE { ?p :p_partkey ?k ; :p_name ?n }",
    "SELECT p_partkey AS k, md5(p_name) AS md5, sha1(p_name) AS sha1, sha256(p_name) AS sha256 FROM part",
)
sparql(
    "fn_terms",
    """SELECT ?k (ISIRI(?c) AS ?iri) (ISLITERAL(?n) AS ?lit) (ISNUMERIC(?k) AS ?num) (ISBLANK(?c) AS ?bl) (LANG(?n) AS ?la) (STR(DATATYPE(?k)) AS ?dt) (STR(?c) AS ?str) (SAMETERM(?k, ?k) AS ?same)
         (LANG(STRLANG(?n, 'en')) AS ?en) (LANGMATCHES('en-GB', 'en') AS ?lm) (STR(IRI(CONCAT('http://x/', ?n))) AS ?made) (HASLANG(?n) AS ?hl) (BOUND(?zz) AS ?bo) (IF(?k > 5, 'big', 'small') AS ?size)
         (COALESCE(?zz, ?n) AS ?co) (STR(STRDT(?n, :t)) AS ?sd) WHERE { ?c :c_custkey ?k ; :c_name ?n }""",
    """SELECT c_custkey AS k, true AS iri, true AS lit, true AS num, false AS bl, '' AS la, 'http://www.w3.org/2001/XMLSchema#integer' AS dt, 'http://example.org/customer/' || c_custkey AS str, true AS same,
         'en' AS en, true AS lm, 'http://x/' || c_name AS made, false AS hl, false AS bo, CASE WHEN c_custkey > 5 THEN 'big' ELSE 'small' END AS size, 'L' || 'http://www.w3.org/2001/XMLSchema#string' || chr(1) || chr(1) || c_name AS co, c_name AS sd FROM customer""",
)
sparql("fn_now_rand_uuid", "SELECT ?k (RAND() >= 0 AS ?r) (STRLEN(STRUUID()) AS ?u) (ISIRI(UUID()) AS ?i) (YEAR(NOW()) > 2000 AS ?n) (ISBLANK(BNODE()) AS ?b) WHERE { ?x :r_regionkey ?k }", "SELECT r_regionkey::BIGINT AS k, true AS r, 36 AS u, true AS i, true AS n, true AS b FROM region".replace("36 AS u", "36::BIGINT AS u").replace("r_regionkey::BIGINT", "r_regionkey"))

# paths
sparql("path_sequence", "SELECT ?key ?region WHERE { ?o :o_orderkey ?key ; :orderedBy/:ofNation/:inRegion/:r_name ?region }", "SELECT o_orderkey AS key, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
sparql("path_alternative", "SELECT ?k ?v WHERE { ?n :n_nationkey ?k . ?x :ofNation|:supplierNation ?n ; :c_name|:s_name ?v }", "SELECT n_nationkey AS k, c_name AS v FROM nation JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT n_nationkey, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey")
sparql("path_inverse", "SELECT ?r ?name WHERE { ?g :r_name ?r ; ^:inRegion/:n_name ?name }", "SELECT r_name AS r, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey")
sparql("path_negated", "SELECT (COUNT(*) AS ?n) WHERE { ?s !(:n_name|:n_nationkey) ?r . ?r :r_name ?x }", "SELECT count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey")
sparql("path_plus", "SELECT ?name (COUNT(?c) AS ?n) WHERE { ?c (:supplierNation|:inRegion)+ ?r . ?r :r_name ?name } GROUP BY ?name", """
  WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
  c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT r_name AS name, count(*) AS n FROM c JOIN region ON b = 'r' || r_regionkey GROUP BY 1""")
sparql("path_star", "SELECT (COUNT(*) AS ?n) WHERE { ?c :n_name ?name . ?c :inRegion* ?x }", "SELECT 2 * count(*) AS n FROM nation")
sparql("path_optional", "SELECT ?k (COUNT(*) AS ?n) WHERE { ?c :n_nationkey ?k . ?c :inRegion? ?x } GROUP BY ?k", "SELECT n_nationkey AS k, 2::BIGINT AS n FROM nation")


def part_steps(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst) of the parts of successive lines of an order, as often as they come."""
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(after).alias("dst")).where("dst IS NOT NULL AND src <> dst")


def part_links(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between the parts of successive lines of an order."""
    return part_steps(spark, folder).distinct()


_LINKS = """e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst),
u AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e), b AS (SELECT src, dst FROM u UNION ALL SELECT dst, src FROM u)"""


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """Edges from suppliers to nations to regions."""
    s = read(spark, folder, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    return s.unionByName(read(spark, folder, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst")))


_TREE = "e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"

# analytics
plan("degree", f"WITH {_LINKS} SELECT src AS node, count(*) AS degree FROM e GROUP BY 1")(lambda s, f: graph.degree(part_links(s, f)))
plan("degree_distribution", f"WITH {_LINKS} SELECT degree, count(*) AS count FROM (SELECT src, count(*) AS degree FROM e GROUP BY 1) GROUP BY 1")(lambda s, f: graph.degree_distribution(part_links(s, f)))
plan("triangle_count", f"WITH {_LINKS} SELECT count(*) AS count FROM u x JOIN u y ON x.dst = y.src JOIN u z ON z.src = x.src AND z.dst = y.dst")(lambda s, f: graph.triangle_count(part_links(s, f)))
plan("global_clustering", f"WITH {_LINKS}, t AS (SELECT count(*) AS n FROM u x JOIN u y ON x.dst = y.src JOIN u z ON z.src = x.src AND z.dst = y.dst), w AS (SELECT sum(d * (d - 1) / 2) AS w FROM (SELECT src, count(*) AS d FROM b GROUP BY 1)) SELECT round(3 * n / w, 9) AS clustering FROM t, w")(
    lambda s, f: graph.global_clustering(part_links(s, f)).select(F.round("clustering", 9).alias("clustering"))
)
plan("local_clustering", f"""WITH {_LINKS}, t AS (SELECT unnest([x.src, x.dst, y.dst]) AS node FROM u x JOIN u y ON x.dst = y.src JOIN u z ON z.src = x.src AND z.dst = y.dst), c AS (SELECT node, count(*) AS n FROM t GROUP BY 1),
d AS (SELECT src AS node, count(*) AS d FROM b GROUP BY 1) SELECT node, coalesce(n, 0)::BIGINT AS triangles, round(CASE WHEN d > 1 THEN coalesce(n, 0) / (d * (d - 1) / 2) ELSE 0.0 END, 9)::DOUBLE AS clustering FROM d LEFT JOIN c USING (node)""")(
    lambda s, f: graph.local_clustering(part_links(s, f)).select("node", F.col("triangles").cast("long").alias("triangles"), F.round("clustering", 9).alias("clustering"))
)
_ONE = "SELECT node, {d} * coalesce(s, 0) + (1 - {d}) / (SELECT count(*) FROM v) + {d} * (SELECT coalesce(sum(rank), 0) FROM {r} WHERE node NOT IN (SELECT src FROM e)) / (SELECT count(*) FROM v) AS rank FROM v LEFT JOIN (SELECT dst AS node, sum(rank / n) AS s FROM e JOIN {r} ON {r}.node = src JOIN o ON o.node = src GROUP BY 1) USING (node)"
_STEPS = ", ".join(f"r{k + 1} AS ({_ONE.format(d=0.85, r=f'r{k}')})" for k in range(5))
plan("pagerank", f"WITH {_LINKS}, v AS (SELECT DISTINCT src AS node FROM b), o AS (SELECT src AS node, count(*) AS n FROM e GROUP BY 1), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v), {_STEPS} SELECT node, round(rank, 9) AS rank FROM r5")(
    lambda s, f: graph.pagerank(part_links(s, f), iterations=5).select("node", F.round("rank", 9).alias("rank"))
)
plan("components", f"WITH RECURSIVE {_TREE}, c AS (SELECT src, src AS dst FROM b UNION SELECT c.src, b.dst FROM c JOIN b ON c.dst = b.src) SELECT src AS node, min(dst) AS component FROM c GROUP BY 1")(lambda s, f: graph.components(tree(s, f)))
plan("strong_components", f"WITH {_TREE} SELECT DISTINCT src AS node, src AS component FROM b")(lambda s, f: graph.strong_components(tree(s, f)))
plan("core_numbers", f"WITH {_TREE} SELECT DISTINCT src AS node, 1::BIGINT AS core FROM b")(lambda s, f: graph.core_numbers(tree(s, f)))
plan("core_numbers_links")(lambda s, f: graph.core_numbers(part_links(s, f)))
plan("shortest_lengths", f"""WITH RECURSIVE {_TREE}, w AS (SELECT 'r0' AS node, 0 AS length UNION SELECT b.dst, length + 1 FROM w JOIN b ON b.src = w.node WHERE length < 6) SELECT node, min(length) AS length FROM w GROUP BY 1""")(
    lambda s, f: graph.shortest_lengths(graph.both_ways(tree(s, f)), "r0")
)
plan("closeness", f"""WITH RECURSIVE {_TREE}, w AS (SELECT src AS root, src AS node, 0 AS length FROM b UNION SELECT root, b.dst, length + 1 FROM w JOIN b ON b.src = w.node WHERE length < 4), m AS (SELECT root, node, min(length) AS l FROM w WHERE root <> node GROUP BY 1, 2)
SELECT root AS node, round(count(*) / sum(l), 9) AS closeness FROM m GROUP BY 1""")(lambda s, f: graph.closeness(tree(s, f)).select("node", F.round("closeness", 9).alias("closeness")))
plan("betweenness")(lambda s, f: graph.betweenness(tree(s, f)))
plan("eigenvector")(lambda s, f: graph.eigenvector(tree(s, f), 12))
plan("cliques_4", f"""WITH {_LINKS} SELECT count(*) AS count FROM u a JOIN u b2 ON a.dst = b2.src JOIN u c ON c.src = a.src AND c.dst = b2.dst JOIN u d ON d.src = b2.dst JOIN u e1 ON e1.src = a.src AND e1.dst = d.dst JOIN u e2 ON e2.src = a.dst AND e2.dst = d.dst""")(
    lambda s, f: graph.cliques(part_links(s, f), 4).agg(F.count(F.lit(1)).alias("count"))
)
plan("transitive_closure", f"WITH RECURSIVE {_TREE}, c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src, dst FROM c")(lambda s, f: paths.closure(tree(s, f)).select("src", "dst"))
plan("tree_fold", """SELECT 'r' || n_regionkey AS node, count(*) AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")(
    lambda s, f: graph.fold(
        tree(s, f).select(F.col("dst").alias("src"), F.col("src").alias("dst")), graph.nodes(tree(s, f)).select("node", F.col("node").startswith("s").cast("long").alias("value"))
    ).where("node LIKE 'r%' AND value > 0")
)


@plan("analytics_service", "WITH d AS (SELECT 'Ihttp://example.org/nation/' || n_nationkey AS node, 1::BIGINT AS degree FROM nation) SELECT node, degree FROM d")
def _service(spark: SparkSession, folder: str) -> DataFrame:
    d = dataset(spark, folder)
    d.services.update(graph.services())
    return d.select(f"SELECT ?node ?degree WHERE {{ SERVICE <{graph.ENDPOINT}degree?predicate={BASE}inRegion> {{ }} }}")


# value-index probes
plan("range_window", "SELECT event_id, value FROM events WHERE value >= 10 AND value < 50")(lambda s, f: temporal.value_range(read(s, f, "events"), "value", 10, 50).select("event_id", "value"))
plan("as_of_join", """SELECT e.event_id, p.event_id AS purchase FROM events e ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'purchase') WHERE r = 1) p
ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'view'""")(
    lambda s, f: temporal.as_of(
        read(s, f, "events").where("event_type = 'view'").select("event_id", "user_id", "ts"), read(s, f, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", "ts"), ["user_id"], "ts", ["purchase"]
    ).select("event_id", "purchase")
)
plan("last_per_series", "SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY 1")(lambda s, f: temporal.last_per(read(s, f, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id"))
plan("interval_overlap", """WITH i AS (SELECT user_id, event_id, ts AS a, ts + INTERVAL 1 HOUR AS b FROM events WHERE event_type = 'signup'), j AS (SELECT event_id AS other, ts AS c, ts + INTERVAL 10 MINUTE AS d FROM events WHERE event_type = 'error')
SELECT event_id, other FROM i JOIN j ON a < d AND c < b""")(
    lambda s, f: temporal.overlaps(
        read(s, f, "events").where("event_type = 'signup'").select("event_id", F.col("ts").alias("a"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("b")),
        read(s, f, "events").where("event_type = 'error'").select(F.col("event_id").alias("other"), F.col("ts").alias("c"), (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("d")),
        ("a", "b"), ("c", "d"), 3600,
    ).select("event_id", "other")
)
def _all_terms() -> str:
    """SQL for the triples of all mapped tables, values with their kinds, as the mapping has them."""
    m, out = tpch(None, ""), []
    for x in m.tables.values():
        said = [("type", f"'{x.name}'"), *((p, f"typeof({c}) || ' ' || {c}::VARCHAR") for p, c in x.columns.items())]
        said += [(p, f"'{to} ' || " + " || '-' || ".join(f"{c}::VARCHAR" for c in cs)) for p, (cs, to) in x.links.items()]
        subject = f"'{x.name} ' || " + " || '-' || ".join(f"{k}::VARCHAR" for k in x.keys)
        out += [f"SELECT {subject} AS s, '{p}' AS p, {o} AS o FROM {x.name}" for p, o in said]
    return "SELECT * FROM (" + " UNION ".join(out) + ") WHERE o IS NOT NULL"


plan("graph_statistics", f"SELECT count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates FROM ({_all_terms()})")(
    lambda s, f: temporal.statistics(dataset(s, f).mapping.quads().distinct()).select("triples", "subjects", "predicates")
)
plan("graph_statistics_all")(lambda s, f: temporal.statistics(dataset(s, f).mapping.quads().distinct()))
plan("key_statistics", "SELECT avg(n) AS mean, max(n) AS most, sum(n * n) / sum(n) AS weighted FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")(lambda s, f: temporal.key_statistics(read(s, f, "orders"), "o_custkey"))


# quads: graphs, construction, updates, entailment, validation
def nation_quads(spark: SparkSession, folder: str) -> DataFrame:
    """Nations and regions as quads, each nation's triples also in a graph named after its region."""
    quads = tpch(spark, folder)
    quads.tables = {k: v for k, v in quads.tables.items() if k in ("nation", "region")}
    base = quads.quads()
    region = base.where(F.col("p") == t.iri(BASE + "inRegion")).select("s", F.col("o").alias("_g"))
    return base.unionByName(base.join(region, "s").select("s", "p", "o", F.col("_g").alias("g")))


def all_quads(spark: SparkSession, folder: str) -> DataFrame:
    """Every mapped table as a set of quads (lines of one key share a subject), with the named graphs of nation_quads."""
    return tpch(spark, folder).quads().distinct().unionByName(nation_quads(spark, folder).where("g IS NOT NULL"))


def all_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The default graph's quads as the tables' rows give them: for operators whose results are sets, whatever repeats."""
    return tpch(spark, folder).quads()


def quad_dataset(spark: SparkSession, folder: str, quads: Q = all_quads) -> Dataset:
    return Dataset(spark, quads(spark, folder), prefixes={"": BASE, "rdfs": t.RDFS})


def on_quads(name: str, text: str, sql: str, quads: Q = all_quads) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = quad_dataset(spark, folder, quads).query(text)
        if found.quads is not None:
            return found.quads.select(*[t.lexical(F.col(c)).alias(c) for c in "spo"])
        s = found.solutions
        return s.df.select(*[(t.string(s.val(n)) if s.kinds[n] in ("term", "iri") else F.col(n)).alias(n) for n in s.kinds])

    plan(name, sql)(run)


on_quads("graph_named", "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s :n_name ?name } } GROUP BY ?g", "SELECT 'http://example.org/region/' || n_regionkey AS g, count(*) AS n FROM nation GROUP BY 1")
on_quads("graph_constant", "SELECT ?name WHERE { GRAPH <http://example.org/region/2> { ?s :n_name ?name } }", "SELECT n_name AS name FROM nation WHERE n_regionkey = 2")
on_quads("graph_join", "SELECT ?name ?r WHERE { GRAPH ?g { ?s :n_name ?name } ?g :r_name ?r }", "SELECT n_name AS name, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
on_quads("from_graph", "SELECT (COUNT(*) AS ?n) FROM <http://example.org/region/1> FROM <http://example.org/region/3> WHERE { ?s :n_name ?x }", "SELECT count(*) AS n FROM nation WHERE n_regionkey IN (1, 3)")
on_quads("construct", "CONSTRUCT { ?r :hasNation ?s ; :label ?name } WHERE { ?s :inRegion ?r ; :n_name ?name }", """
  SELECT 'http://example.org/region/' || n_regionkey AS s, 'http://example.org/hasNation' AS p, 'http://example.org/nation/' || n_nationkey AS o FROM nation UNION
  SELECT 'http://example.org/region/' || n_regionkey, 'http://example.org/label', n_name FROM nation""")
on_quads("describe", "DESCRIBE <http://example.org/region/2>", """
  SELECT 'http://example.org/region/2' AS s, unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://example.org/r_regionkey', 'http://example.org/r_name']) AS p, unnest(['http://example.org/Region', r_regionkey::VARCHAR, r_name]) AS o FROM region WHERE r_regionkey = 2""")
on_quads("path_star_quads", "SELECT (COUNT(*) AS ?n) WHERE { ?s :n_name ?x . ?s :inRegion* ?y }", "SELECT 2 * count(*) AS n FROM nation")
on_quads("graph_named_all", "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s :n_name ?name } . ?c :ofNation ?s } GROUP BY ?g", "SELECT 'http://example.org/region/' || n_regionkey AS g, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
on_quads("construct_all", "CONSTRUCT { ?c :bought ?p } WHERE { ?l :ofOrder ?o ; :ofPart ?p . ?o :orderedBy ?c }", """
  SELECT DISTINCT 'http://example.org/customer/' || o_custkey AS s, 'http://example.org/bought' AS p, 'http://example.org/part/' || l_partkey AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
plan("ask", "SELECT true AS answer")(lambda s, f: s.createDataFrame([(quad_dataset(s, f).query("ASK { ?s :n_name 'NATION_2' }").boolean,)], "answer boolean"))


def _store(spark: SparkSession, folder: str, quads: Q = all_quads) -> GraphStore:
    return GraphStore.over(spark, quads(spark, folder))


@plan("update_modify", "SELECT 'http://example.org/nation/' || n_nationkey AS s, lower(n_name) AS o FROM nation")
def _update(spark: SparkSession, folder: str) -> DataFrame:
    store = _store(spark, folder)
    store.update("DELETE { ?s :n_name ?n } INSERT { ?s :n_name ?l } WHERE { ?s :n_name ?n BIND(LCASE(?n) AS ?l) }", prefixes={"": BASE})
    return store.quads().where(F.col("g").isNull() & (F.col("p") == t.iri(BASE + "n_name"))).select(t.lexical(F.col("s")).alias("s"), t.lexical(F.col("o")).alias("o"))


@plan("update_modify_all", "SELECT 'http://example.org/orders/' || o_orderkey AS s, lower(o_orderpriority) AS o FROM orders")
def _update_all(spark: SparkSession, folder: str) -> DataFrame:
    store = _store(spark, folder)
    store.update("DELETE { ?s :o_orderpriority ?n } INSERT { ?s :o_orderpriority ?l } WHERE { ?s :o_orderpriority ?n BIND(LCASE(?n) AS ?l) }", prefixes={"": BASE})
    return store.quads().where(F.col("p") == t.iri(BASE + "o_orderpriority")).select(t.lexical(F.col("s")).alias("s"), t.lexical(F.col("o")).alias("o"))


@plan("world_diff", "SELECT change, count(*) AS n FROM (SELECT unnest([-1, 1]) AS change FROM nation WHERE n_regionkey = 1) GROUP BY 1")
def _worlds(spark: SparkSession, folder: str) -> DataFrame:
    store = _store(spark, folder)
    store.fork("moved")
    store.update("DELETE { ?s :inRegion :region\\/1 } INSERT { ?s :inRegion :region\\/9 } WHERE { ?s :inRegion :region\\/1 }", "moved", {"": BASE})
    return store.diff("main", "moved").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


plan("state_hash")(lambda s, f: temporal.state_hash(all_quads(s, f)))
plan("canonical_nquads", f"""SELECT CASE WHEN p = 'type' THEN '<{t.RDF}type>' ELSE '<' || p || '>' END AS predicate, count(*) AS n FROM ({_all_terms()}) GROUP BY 1""")(
    lambda s, f: rdf.canonical_nquads(dataset(s, f).mapping.quads()).groupBy(F.split_part(F.col("value"), F.lit(" "), F.lit(2)).alias("predicate")).agg(F.count(F.lit(1)).alias("n"))
)
plan("result_json", "SELECT '{\"s\":{\"type\":\"uri\",\"value\":\"http://example.org/region/' || r_regionkey || '\"},\"n\":{\"type\":\"literal\",\"value\":\"' || r_name || '\"}}' AS value FROM region")(
    lambda s, f: rdf.result_lines(quad_dataset(s, f).query("SELECT ?s ?n WHERE { ?s :r_name ?n }").terms(), "json")
)

_SCHEMA = f"""@prefix : <{BASE}> . @prefix rdfs: <{t.RDFS}> . @prefix owl: <{t.OWL}> .
:Nation rdfs:subClassOf :Place . :Place rdfs:subClassOf :Thing . :inRegion rdfs:subPropertyOf :within ; rdfs:range :Area . :within rdfs:domain :Located ; owl:inverseOf :holds . :within a owl:TransitiveProperty ."""


def _triples(spark: SparkSession, folder: str, rows: Q = all_quads) -> DataFrame:
    return rows(spark, folder).where("g IS NULL").unionByName(spark.createDataFrame(rdf.parse_turtle(_SCHEMA), rdf.QUADS))


plan("rdfs_types", """SELECT 'http://example.org/nation/' || n_nationkey AS s, 'http://example.org/' || unnest(['Place', 'Thing', 'Located']) AS o FROM nation
UNION ALL SELECT 'http://example.org/region/' || n_regionkey, 'http://example.org/Area' FROM (SELECT DISTINCT n_regionkey FROM nation)""")(
    lambda s, f: inference.rdfs(_triples(s, f, all_rows)).where(F.col("p") == inference.TYPE).select(t.lexical(F.col("s")).alias("s"), t.lexical(F.col("o")).alias("o"))
)
_SCHEMA_ALL = f"@prefix : <{BASE}> . @prefix rdfs: <{t.RDFS}> . :Orders rdfs:subClassOf :Document . :orderedBy rdfs:range :Buyer . :ofOrder rdfs:domain :Position ."
plan("rdfs_types_all", """SELECT 'http://example.org/orders/' || o_orderkey AS s, 'http://example.org/Document' AS o FROM orders UNION ALL
SELECT DISTINCT 'http://example.org/customer/' || o_custkey, 'http://example.org/Buyer' FROM orders UNION ALL SELECT DISTINCT 'http://example.org/lineitem/' || l_orderkey || '-' || l_linenumber, 'http://example.org/Position' FROM lineitem""")(
    lambda s, f: inference.rdfs(all_rows(s, f).unionByName(s.createDataFrame(rdf.parse_turtle(_SCHEMA_ALL), rdf.QUADS))).where(F.col("p") == inference.TYPE).select(t.lexical(F.col("s")).alias("s"), t.lexical(F.col("o")).alias("o"))
)
plan("owl_rl_inverse", "SELECT 'http://example.org/region/' || n_regionkey AS s, 'http://example.org/nation/' || n_nationkey AS o FROM nation")(
    lambda s, f: inference.owl_rl(_triples(s, f, all_rows))[0].where(F.col("p") == t.iri(BASE + "holds")).select(t.lexical(F.col("s")).alias("s"), t.lexical(F.col("o")).alias("o"))
)
plan("type_expansion", "SELECT count(*) AS n FROM nation")(
    lambda s, f: Dataset(s, _triples(s, f), prefixes={"": BASE}, types_of=inference.types_of(_triples(s, f))).select("SELECT (COUNT(*) AS ?n) WHERE { ?s a :Thing }")
)


def shapes(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        data = Dataset(spark, tpch(spark, folder).quads(), prefixes={"": BASE})
        head = f"@prefix : <{BASE}> . @prefix sh: <{t.SH}> . @prefix xsd: <{t.XSD}> .\n"
        return shacl.Validator(data, shacl.Shapes(rdf.parse_turtle(head + text))).report().select(t.lexical(F.col("focus")).alias("focus"), F.col("component").substr(F.lit(len(t.SH) + 1), F.lit(99)).alias("component"))

    plan(name, sql)(run)


_S = "'http://example.org/supplier/' || s_suppkey AS focus, '{0}ConstraintComponent' AS component FROM supplier"
shapes("shacl_range", ":S a sh:NodeShape ; sh:targetClass :Supplier ; sh:property [ sh:path :s_acctbal ; sh:minInclusive 0 ; sh:maxExclusive 9000.0 ] .", f"SELECT {_S.format('MinInclusive')} WHERE s_acctbal < 0 UNION ALL SELECT {_S.format('MaxExclusive')} WHERE s_acctbal >= 9000")
shapes("shacl_count", ":S a sh:NodeShape ; sh:targetClass :Supplier ; sh:property [ sh:path :phone ; sh:minCount 1 ] , [ sh:path :s_name ; sh:maxCount 0 ] .", f"SELECT {_S.format('MinCount')} UNION ALL SELECT {_S.format('MaxCount')}")
shapes("shacl_pattern_datatype", ":S a sh:NodeShape ; sh:targetClass :Supplier ; sh:property [ sh:path :s_name ; sh:pattern '[05]$' ; sh:datatype xsd:string ] , [ sh:path :s_suppkey ; sh:datatype xsd:string ] .", f"SELECT {_S.format('Pattern')} WHERE NOT regexp_matches(s_name, '[05]$') UNION ALL SELECT {_S.format('Datatype')}")
shapes("shacl_path_class", ":S a sh:NodeShape ; sh:targetClass :Supplier ; sh:property [ sh:path (:supplierNation :inRegion) ; sh:class :Nation ] , [ sh:path (:supplierNation :inRegion :r_name) ; sh:in ('ASIA' 'EUROPE') ] .", f"SELECT {_S.format('Class')} UNION ALL SELECT {_S.format('In')} JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('ASIA', 'EUROPE')")
shapes("shacl_logic_closed", ":S a sh:NodeShape ; sh:targetClass :Supplier ; sh:closed true ; sh:ignoredProperties (<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>) ; sh:property [ sh:path :s_suppkey ] , [ sh:path :s_name ] , [ sh:path :supplierNation ] ; sh:or ([ sh:property [ sh:path :s_acctbal ; sh:minInclusive 5000 ] ] [ sh:property [ sh:path :s_suppkey ; sh:maxInclusive 20 ] ]) .", f"SELECT {_S.format('Closed')} UNION ALL SELECT {_S.format('Or')} WHERE s_acctbal < 5000 AND s_suppkey > 20")
shapes("shacl_range_all", ":S a sh:NodeShape ; sh:targetClass :Lineitem ; sh:property [ sh:path :l_quantity ; sh:maxInclusive 45 ] .", "SELECT focus, component FROM (SELECT DISTINCT 'http://example.org/lineitem/' || l_orderkey || '-' || l_linenumber AS focus, 'MaxInclusiveConstraintComponent' AS component, l_quantity FROM lineitem WHERE l_quantity > 45)")

# JSON and geometry
plan("jsonata_path", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")(lambda s, f: read(s, f, "events").select("event_id", jsonata.path_column("k", "props", "bigint").alias("k")))
plan("jsonata_expression", "SELECT event_id, CASE WHEN json_extract(props, '$.k')::BIGINT > 50 THEN '\"big\"' ELSE (json_extract(props, '$.k')::BIGINT * 2)::VARCHAR END AS x FROM events")(
    lambda s, f: read(s, f, "events").select("event_id", jsonata.column("k > 50 ? 'big' : k * 2", "props").alias("x"))
)
plan("json_schema", "SELECT event_id, json_extract(props, '$.k')::BIGINT <= 60 AS ok FROM events")(
    lambda s, f: read(s, f, "events").select("event_id", (F.size(jsonschema.validate(F.col("props"), {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 60}}})) == 0).alias("ok"))
)
plan("json_required", "SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS ok FROM events")(lambda s, f: read(s, f, "events").select("event_id", jsonschema.required(F.col("props"), {"k": "bigint"}).alias("ok")))


def _places(spark: SparkSession, folder: str) -> DataFrame:
    x, y = F.col("s_suppkey") % 17, F.col("s_suppkey") % 23
    return read(spark, folder, "supplier").select("s_suppkey", F.format_string("POINT(%d %d)", x, y).alias("place"))


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("n_nationkey") % 9, F.col("n_nationkey") % 11
    c, d = a + 4, b + 5
    return read(spark, folder, "nation").select("n_nationkey", F.format_string("POLYGON((%d %d, %d %d, %d %d, %d %d, %d %d))", a, b, c, b, c, d, a, d, a, b).alias("box"))


plan("geo_join", """SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_suppkey % 17 > n_nationkey % 9 AND s_suppkey % 17 < n_nationkey % 9 + 4 AND s_suppkey % 23 > n_nationkey % 11 AND s_suppkey % 23 < n_nationkey % 11 + 5""")(
    lambda s, f: geo.spatial_join(_places(s, f), _boxes(s, f), "place", "box", 4.0, "sfWithin").select("s_suppkey", "n_nationkey")
)
plan("geo_bounds", "SELECT n_nationkey, (n_nationkey % 9)::DOUBLE AS x0, (n_nationkey % 11 + 5)::DOUBLE AS y1 FROM nation")(lambda s, f: _boxes(s, f).select("n_nationkey", geo.bounds(F.col("box"))["x0"].alias("x0"), geo.bounds(F.col("box"))["y1"].alias("y1")))


# scans and joins of many patterns
plan("match_scan", "SELECT 'http://example.org/nation/' || n_nationkey AS s FROM nation WHERE n_regionkey = 3")(
    lambda s, f: scans.match(dataset(s, f).mapping.quads(), p=t.iri(BASE + "inRegion"), o=t.iri(BASE + "region/3")).select(t.lexical(F.col("s")).alias("s"))
)
plan("match_many_subjects", "SELECT count(*) AS n FROM nation WHERE n_regionkey < 2")(
    lambda s, f: scans.match_many(all_quads(s, f).where("g IS NULL"), read(s, f, "nation").where("n_regionkey < 2").select(F.concat(F.lit(f"I{BASE}nation/"), "n_nationkey").alias("x")), "s", p=t.iri(BASE + "n_name")).agg(F.count(F.lit(1)).alias("n"))
)
plan("visibility_view", "SELECT count(*) AS n FROM nation WHERE n_regionkey = 1")(
    lambda s, f: scans.View(all_quads(s, f)).where(lambda: F.col("g") == t.iri(BASE + "region/1")).where(lambda: F.col("p") == t.iri(BASE + "n_name")).scan().agg(F.count(F.lit(1)).alias("n"))
)


def _named(df: DataFrame, *names: str) -> DataFrame:
    return df.toDF(*names)


plan("semijoin_reduction", """SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))""")(
    lambda s, f: multiway.reduced([
        _named(read(s, f, "orders").select("o_orderkey", "o_custkey"), "o", "c"), _named(read(s, f, "customer").select("c_custkey", "c_nationkey"), "c", "n"),
        _named(read(s, f, "nation").where("n_regionkey = 1").select("n_nationkey", "n_regionkey"), "n", "r"),
    ])[0].agg(F.count(F.lit(1)).alias("n"))
)
plan("star_count", "SELECT count(*) AS count FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey")(
    lambda s, f: multiway.star_count([read(s, f, "lineitem").select(F.col("l_partkey").alias("k"))] * 2, "k")
)
plan("star_keys", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier)")(
    lambda s, f: multiway.star_keys([read(s, f, "orders").select(F.col("o_custkey").alias("k")), read(s, f, "supplier").select(F.col("s_suppkey").alias("k"))], "k")
)


@plan("hypercube_triangles", f"WITH {_LINKS} SELECT 6 * count(*) AS n FROM u x JOIN u y ON x.dst = y.src JOIN u z ON z.src = x.src AND z.dst = y.dst")
def _hypercube(spark: SparkSession, folder: str) -> DataFrame:
    # a triangle stands six times in the edges both ways, once in those from the smaller part to the larger
    edges = settle(graph.undirected(part_steps(spark, folder)), "hypercube")
    ab, bc, ac = (edges.toDF(*names) for names in (("a", "b"), ("b", "c"), ("a", "c")))
    return multiway.hypercube_triangles(ab, bc, ac).agg((F.lit(6) * F.count(F.lit(1))).alias("n"))


plan("canonical_labels", f"SELECT '{BASE}' || upper(o[1]) || o[2:] AS cls, count(DISTINCT s) AS labels FROM ({_all_terms()}) WHERE p = 'type' GROUP BY 1")(
    lambda s, f: canonical.labelled(*[df.withColumn("s", F.concat(F.lit("B"), F.xxhash64("s").cast("string"))) for df in (tpch(s, f).quads(), tpch(s, f).stars())])
    .where(F.col("p") == inference.TYPE).groupBy(t.lexical(F.col("o")).alias("cls")).agg(F.count_distinct("s").alias("labels"))
)
plan("rcc8_closure", "SELECT 'http://example.org/nation/' || a.n_nationkey AS a, 'http://example.org/nation/' || b.n_nationkey AS b FROM nation a, nation b WHERE a.n_regionkey <> b.n_regionkey")(
    lambda s, f: regions.rcc8_closure(
        read(s, f, "nation").select(F.concat(F.lit(BASE + "nation/"), "n_nationkey").alias("a"), F.concat(F.lit(BASE + "region/"), "n_regionkey").alias("b"), F.lit(regions.mask("ntpp")).alias("relations"))
        .unionByName(_named(read(s, f, "region").alias("x").join(read(s, f, "region").alias("y"), F.col("x.r_regionkey") < F.col("y.r_regionkey")).select(F.concat(F.lit(BASE + "region/"), "x.r_regionkey"), F.concat(F.lit(BASE + "region/"), "y.r_regionkey"), F.lit(regions.mask("dc"))), "a", "b", "relations"))
    ).where((F.col("relations") == regions.mask("dc")) & F.col("a").contains("nation") & F.col("b").contains("nation")).select("a", "b")
)
plan("owl_profile", "SELECT 'EL' AS profile, 'inverseOf' AS construct, 1::BIGINT AS n UNION ALL SELECT 'QL', 'TransitiveProperty', 1")(lambda s, f: regions.profile_violations(_triples(s, f)))
