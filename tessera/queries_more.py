"""Queries of operator families over whole tables: JSONata, SHACL, updates, readers and writers, geometry, built-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, jsonata
from .functions import terms as t
from .operators import graph, scans, shacl
from .operators.update import GraphStore
from .queries import BASE, QUERIES, SQL, Q, dataset, on_quads, plan, read, sparql
from .shared import fresh_path, settle
from .sources import formats, rdf
from .sources.mapping import tpch

__all__ = ["QUERIES", "SQL"]


# JSONata over every part as a JSON document
def _parts_json(spark: SparkSession, folder: str) -> DataFrame:
    """{k, n, b, s, a: [s, k mod 7, 3], o: [{x: s, y: "u"}, {x: k mod 5, y: "v"}]} of each part."""
    items = F.array(F.struct(F.col("p_size").alias("x"), F.lit("u").alias("y")), F.struct((F.col("p_partkey") % 5).cast("int").alias("x"), F.lit("v").alias("y")))
    numbers = F.array(F.col("p_size"), (F.col("p_partkey") % 7).cast("int"), F.lit(3))
    doc = F.to_json(F.struct(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"), F.col("p_brand").alias("b"), F.col("p_size").alias("s"), numbers.alias("a"), items.alias("o")))
    return read(spark, folder, "part").select(F.col("p_partkey").alias("k"), doc.alias("doc"))


def json_query(name: str, **columns: tuple[str, str]) -> None:
    """One query with a column for each (expression, SQL of its JSON text) over the parts."""
    sql = ", ".join(f"({s})::VARCHAR AS {c}" for c, (_, s) in columns.items())
    plan(name, f"SELECT p_partkey AS k, {sql} FROM (SELECT *, p_partkey % 7 AS m, p_partkey % 5 AS v, p_size::BIGINT AS s, p_partkey AS k FROM part)")(
        lambda spark, folder: _parts_json(spark, folder).select("k", *[jsonata.column(e, "doc").alias(c) for c, (e, _) in columns.items()])
    )


_QUOTED = "'\"' || {} || '\"'".format
json_query(
    "jsonata_aggregates",
    sum=("$sum(a)", "s + m + 3"), max=("$max(a)", "greatest(s, m, 3)"), min=("$min(a)", "least(s, m, 3)"), average=("$average([s, s + 2])", "s + 1"), count=("$count(a)", "3"),
    reduce=("$reduce(a, function($x, $y) { $x * 2 + $y })", "(s * 2 + m) * 2 + 3"),
)
json_query(
    "jsonata_arrays",
    reversed=("$reverse(a)", "'[3,' || m || ',' || s || ']'"), appended=("$append(a, k)", "'[' || s || ',' || m || ',3,' || k || ']'"),
    different=("$distinct([s, s, k, k])", "CASE WHEN s = k THEN '[' || s || ']' ELSE '[' || s || ',' || k || ']' END"), zipped=("$zip([1, 2], [s, k])", "'[[1,' || s || '],[2,' || k || ']]'"),
    shuffled=("$sum($shuffle(a))", "s + m + 3"), sorted=("$sort([s, 100, -1])", "'[-1,' || s || ',100]'"), by=("$sort([s, k], function($x, $y) { $x < $y })", "'[' || greatest(s, k) || ',' || least(s, k) || ']'"),
    first=("a[0]", "s"), last=("a[-1]", "3"), kept=("a[0][]", "'[' || s || ']'"), built=("[k, [s]]", "'[' || k || ',[' || s || ']]'"), span=("[1..3]", "'[1,2,3]'"),
)
json_query(
    "jsonata_booleans",
    truth=("$boolean(m)", "NULL"), odd=("$boolean(k % 2)", "CASE WHEN k % 2 = 1 THEN 'true' ELSE 'false' END"), inverse=("$not(k % 2)", "CASE WHEN k % 2 = 1 THEN 'false' ELSE 'true' END"),
    there=("$exists(n) and $not($exists(zz))", "'true'"), kind=("$type(a) & $type(n) & $type(k) & $type(o[0])", "'\"arraystringnumberobject\"'"), empty=("$boolean([]) or $boolean('') or $boolean({})", "'false'"),
    either=("s > 25 or k < 10", "CASE WHEN s > 25 OR k < 10 THEN 'true' ELSE 'false' END"), member=("3 in a", "'true'"), compared=("n = n and s != s + 1", "'true'"),
)
json_query(
    "jsonata_numbers",
    number=("$number($string(s) & '.0')", "s"), absolute=("$abs(-s)", "s"), floor=("$floor(s / 2)", "s // 2"), ceil=("$ceil(s / 2)", "(s + 1) // 2"), round=("$round(s + 0.4)", "s"), power=("$power(s, 2)", "s * s"), root=("$sqrt(s * s)", "s"),
    formatted=("$formatNumber(k, '#,##0.00')", "'\"' || format('{:,}', k) || '.00\"'"), base=("$formatBase(s, 2)", _QUOTED("bin(s)")), digits=("$formatInteger(k, '00000')", _QUOTED("lpad(k::VARCHAR, greatest(5, length(k::VARCHAR))::INT, '0')")),
    parsed=("$parseInteger($formatInteger(k, '00000'), '00000')", "k"), remainder=("k % 7 + s * 2 - 1", "m + s * 2 - 1"),
)
json_query(
    "jsonata_strings",
    string=("$string(a)", "'\"[' || s || ',' || m || ',3]\"'"), length=("$length(n)", "length(p_name)"), part=("$substring(n, 1, 3)", _QUOTED("substr(p_name, 2, 3)")),
    before=("$substringBefore(b, '#')", _QUOTED("split_part(p_brand, '#', 1)")), after=("$substringAfter('x#' & b, '#')", _QUOTED("p_brand")),
    upper=("$uppercase(n)", _QUOTED("upper(p_name)")), lower=("$lowercase(n)", _QUOTED("lower(p_name)")), trimmed=("$trim('  ' & b & ' ')", _QUOTED("p_brand")), padded=("$pad($string(s), -5, '.')", _QUOTED("lpad(s::VARCHAR, 5, '.')")),
    holds=("$contains(n, '1')", "CASE WHEN contains(p_name, '1') THEN 'true' ELSE 'false' END"), pieces=("$count($split(n, '1'))", "len(string_split(p_name, '1'))"), joined=("$join(['a', $string(s), 'z'], '-')", "'\"a-' || s || '-z\"'"),
    matched=("$count($match(n, /[0-9]/))", "len(regexp_extract_all(p_name, '[0-9]'))"), replaced=("$replace(n, /[0-9]+/, '_')", _QUOTED("regexp_replace(p_name, '[0-9]+', '_', 'g')")), both=("b & '/' & s", "'\"' || p_brand || '/' || s || '\"'"),
)
json_query(
    "jsonata_dates_and_codes",
    date=("$fromMillis(k * 86400000)", "'\"' || strftime(TIMESTAMP '1970-01-01' + to_days(k::INT), '%Y-%m-%dT00:00:00.000Z') || '\"'"), millis=("$toMillis($fromMillis(k * 86400000))", "k * 86400000"),
    now=("$now() = $now() and $millis() > 0", "'true'"), coded=("$base64encode(n)", _QUOTED("base64(p_name::BLOB)")), decoded=("$base64decode($base64encode(n))", _QUOTED("p_name")),
    url=("$decodeUrlComponent($encodeUrlComponent(b & ' &?'))", _QUOTED("p_brand || ' &?'")), component=("$encodeUrlComponent('a b#' & s)", _QUOTED("'a%20b%23' || s")), whole=("$decodeUrl($encodeUrl('http://h/x y?q=' & s))", _QUOTED("'http://h/x y?q=' || s")), safe=("$encodeUrl('http://h/x y?q=' & s)", _QUOTED("'http://h/x%20y?q=' || s")),
    evaluated=("$eval('s + 1')", "s + 1"), asserted=("($assert(s > 0, 'no'); s)", "s"),
)
json_query(
    "jsonata_objects",
    keys=("$keys(o[0])", "'[\"x\",\"y\"]'"), found=("$lookup(o[0], 'x')", "s"), merged=("$merge([o[0], {'z': k}])", "'{\"x\":' || s || ',\"y\":\"u\",\"z\":' || k || '}'"), spread=("$spread(o[1])", "'[{\"x\":' || v || '},{\"y\":\"v\"}]'"),
    sifted=("$sift(o[0], function($x, $y) { $y = 'x' })", "'{\"x\":' || s || '}'"), each=("$each(o[0], function($x, $y) { $y & $x })", "'[\"x' || s || '\",\"yu\"]'"), mapped=("$map(a, function($x) { $x + 1 })", "'[' || (s + 1) || ',' || (m + 1) || ',4]'"),
    filtered=("$filter([s, 1000, k], function($x) { $x >= 1000 })", "CASE WHEN k >= 1000 THEN '[1000,' || k || ']' ELSE '1000' END"), single=("$single([s, 1000], function($x) { $x = 1000 })", "1000"),
    built=("{'id': k, 'b': b}", "'{\"id\":' || k || ',\"b\":\"' || p_brand || '\"}'"), grouped=("o{y: x}", "'{\"u\":' || s || ',\"v\":' || v || '}'"),
)
json_query(
    "jsonata_steps",
    path=("o.x", "'[' || s || ',' || v || ']'"), chosen=("o[y = 'v'].x", "v"), wild=("$sum(o.*[$type($) = 'number'])", "s + v"), deep=("$count(**.x)", "2"), ordered=("o^(>x).x", "'[' || greatest(s, v) || ',' || least(s, v) || ']'"),
    indexed=("o#$i.{'i': $i, 'x': x}", "'[{\"i\":0,\"x\":' || s || '},{\"i\":1,\"x\":' || v || '}]'"), bound=("o@$p.$p.y", "'[\"u\",\"v\"]'"), parent=("o.{'x': x, 'k': %.k}.k", "'[' || k || ',' || k || ']'"),
    changed=("$ ~> |o|{'x': 0}| ~> $lookup('o') ~> $map(function($x) { $x.x })", "'[0,0]'"), partial=("($f := function($x, $y) { $x - $y }; $g := $f(?, 1); $g(s))", "s - 1"), closure=("($c := s; $h := function($x) { $x + $c }; $h(k))", "s + k"),
    block=("($x := k; $y := s; $x * $y)", "k * s"), chain=("s ~> $string ~> $length", "length(s::VARCHAR)"), either=("k % 2 = 0 ? 'even' : 'odd'", "CASE WHEN k % 2 = 0 THEN '\"even\"' ELSE '\"odd\"' END"), regex=("$contains(n, /[a-z]+/i)", "CASE WHEN regexp_matches(p_name, '[A-Za-z]+') THEN 'true' ELSE 'false' END"),
)


# SHACL over every customer
_CUSTOMERS = ("customer", "nation", "region")


def shapes(name: str, text: str, *failures: tuple[str, str], extra: Q | None = None) -> None:
    """A shape on customers; failures are (component, SQL condition on customer JOIN nation)."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        m = tpch(spark, folder)
        m.tables = {k: v for k, v in m.tables.items() if k in _CUSTOMERS}
        quads = m.quads() if extra is None else m.quads().unionByName(extra(spark, folder))
        head = f"@prefix : <{BASE}> . @prefix sh: <{t.SH}> . @prefix xsd: <{t.XSD}> .\n:S a sh:NodeShape ; sh:targetClass :Customer ; "
        data = dataset(spark, folder)
        data.mapping, data.quads = None, quads
        return shacl.Validator(data, shacl.Shapes(rdf.parse_turtle(head + text))).report().select(t.lexical(F.col("focus")).alias("focus"), F.col("component").substr(F.lit(len(t.SH) + 1), F.lit(99)).alias("component"))

    rows = [f"SELECT 'http://example.org/customer/' || c_custkey AS focus, '{c}ConstraintComponent' AS component FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE {w}" for c, w in failures]
    plan(name, " UNION ALL ".join(rows))(run)


def _extra(spark: SparkSession, folder: str) -> DataFrame:
    """For each customer :low and :high balances, :twin (its name), :label in two languages, and :member of a list of two keys."""
    c = read(spark, folder, "customer").select(F.concat(F.lit(f"I{BASE}customer/"), "c_custkey").alias("s"), F.col("c_custkey").alias("k"), "c_name")
    integer, plain = lambda x: t.to_term(t.Val("int", x)), lambda x: t.to_term(t.Val("str", x))
    rows = [(F.lit(t.iri(BASE + "low")), integer(F.col("k") % 10)), (F.lit(t.iri(BASE + "high")), integer(F.col("k") % 7 + 4)), (F.lit(t.iri(BASE + "twin")), plain(F.when(F.col("k") % 3 == 0, F.lit("other")).otherwise(F.col("c_name"))))]
    for tag, n in (("en", 1), ("de", 2), ("en", 5)):
        label = _tagged(tag, F.concat(F.lit(f"label {n} "), F.col("k").cast("string")))
        rows.append((F.lit(t.iri(BASE + "label")), F.when(F.col("k") % n == 0, label)))
    return c.select("s", F.explode(F.array(*[F.struct(p.alias("p"), o.alias("o")) for p, o in rows])).alias("x")).select("s", "x.p", "x.o", F.lit(None).cast("string").alias("g")).where("o IS NOT NULL")


def _tagged(tag: str, text):
    """An encoded literal with a language tag: that of an empty one, with the text behind it."""
    empty = rdf.parse_turtle(f'<a:a> <a:b> ""@{tag} .')[0][2]
    return F.concat(F.lit(empty), text)


shapes("shacl_lengths", "sh:property [ sh:path :c_name ; sh:minLength 12 ; sh:maxLength 12 ] , [ sh:path :c_acctbal ; sh:minExclusive 0 ; sh:maxInclusive 9000 ] .",
    ("MinLength", "length(c_name) < 12"), ("MaxLength", "length(c_name) > 12"), ("MinExclusive", "c_acctbal <= 0"), ("MaxInclusive", "c_acctbal > 9000"))
shapes("shacl_kinds_and_values", "sh:property [ sh:path :ofNation ; sh:nodeKind sh:IRI ; sh:class :Nation ; sh:hasValue :nation\\/3 ] , [ sh:path :c_mktsegment ; sh:nodeKind sh:IRI ; sh:singleLine true ] .",
    ("HasValue", "c_nationkey <> 3"), ("NodeKind", "true"))
shapes("shacl_logic", "sh:and ( [ sh:path :c_acctbal ; sh:minInclusive 0 ] [ sh:path :c_acctbal ; sh:maxInclusive 8000 ] ) ; sh:not [ sh:path :c_mktsegment ; sh:hasValue 'BUILDING' ] ; sh:xone ( [ sh:path :c_acctbal ; sh:maxInclusive 100 ] [ sh:path :c_mktsegment ; sh:in ('MACHINERY') ] ) .",
    ("And", "c_acctbal < 0 OR c_acctbal > 8000"), ("Not", "c_mktsegment = 'BUILDING'"), ("Xone", "(c_acctbal <= 100) = (c_mktsegment = 'MACHINERY')"))
shapes("shacl_nodes", "sh:property [ sh:path :ofNation ; sh:node [ sh:property [ sh:path :inRegion ; sh:hasValue :region\\/1 ] ] ] , [ sh:path (:ofNation :inRegion) ; sh:qualifiedValueShape [ sh:property [ sh:path :r_regionkey ; sh:minInclusive 2 ] ] ; sh:qualifiedMinCount 1 ] , [ sh:path :ofNation ; sh:qualifiedValueShape [ sh:property [ sh:path :n_nationkey ; sh:maxInclusive 4 ] ] ; sh:qualifiedMaxCount 0 ] .",
    ("Node", "n_regionkey <> 1"), ("QualifiedMinCount", "n_regionkey < 2"), ("QualifiedMaxCount", "n_nationkey <= 4"))
shapes("shacl_pairs", "sh:property [ sh:path :low ; sh:lessThan :high ] , [ sh:path :low ; sh:lessThanOrEquals :high ] , [ sh:path :c_name ; sh:disjoint :twin ] .",
    ("LessThan", "c_custkey % 10 >= c_custkey % 7 + 4"), ("LessThanOrEquals", "c_custkey % 10 > c_custkey % 7 + 4"), ("Disjoint", "c_custkey % 3 <> 0"), extra=_extra)
shapes("shacl_languages", "sh:property [ sh:path :label ; sh:uniqueLang true ] , [ sh:path :label ; sh:languageIn ('en') ] .",
    ("UniqueLang", "c_custkey % 5 = 0"), ("LanguageIn", "c_custkey % 2 = 0"), extra=_extra)
shapes("shacl_sparql", "sh:sparql [ sh:select 'SELECT $this WHERE { $this <http://example.org/c_acctbal> ?b . $this <http://example.org/ofNation> ?n . ?n <http://example.org/n_nationkey> ?k FILTER(?b < 100 * ?k) }' ] .",
    ("SPARQL", "c_acctbal < 100 * n_nationkey"))


# updates over customers, nations and regions
def _customers(spark: SparkSession, folder: str) -> GraphStore:
    m = tpch(spark, folder)
    m.tables = {k: v for k, v in m.tables.items() if k in _CUSTOMERS}
    store = GraphStore(spark)
    store.insert(m.quads())
    return store


def updates(name: str, text: str, sql: str) -> None:
    """The number of triples of each predicate and graph after an update."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        store = _customers(spark, folder)
        store.update(text, prefixes={"": BASE})
        return store.quads().groupBy(F.coalesce(t.lexical(F.col("g")), F.lit("-")).alias("g"), t.lexical(F.col("p")).alias("p")).agg(F.count(F.lit(1)).alias("n"))

    plan(name, sql)(run)


_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_COUNTS = f"""SELECT '-' AS g, p, sum(n)::BIGINT AS n FROM (
  SELECT '{_TYPE}' AS p, count(*) AS n FROM customer UNION ALL SELECT '{_TYPE}', count(*) FROM nation UNION ALL SELECT '{_TYPE}', count(*) FROM region
  UNION ALL SELECT '{BASE}' || unnest(['c_custkey', 'c_name', 'c_acctbal', 'c_mktsegment', 'ofNation']), count(*) FROM customer UNION ALL SELECT '{BASE}' || unnest(['n_nationkey', 'n_name', 'inRegion']), count(*) FROM nation
  UNION ALL SELECT '{BASE}' || unnest(['r_regionkey', 'r_name']), count(*) FROM region) GROUP BY p"""
updates("update_insert_data", "INSERT DATA { :x :c_name 'new' , 'newer' ; :more 1 . GRAPH :g { :x :more 2 } }", f"""
  SELECT g, p, sum(n)::BIGINT AS n FROM (SELECT * FROM ({_COUNTS}) UNION ALL SELECT '-', '{BASE}c_name', 2 UNION ALL SELECT '-', '{BASE}more', 1 UNION ALL SELECT '{BASE}g', '{BASE}more', 1) GROUP BY g, p""")
updates("update_delete_data", "DELETE DATA { :region\\/1 :r_regionkey 1 . :nosuch :r_name 'x' }", f"SELECT g, p, n - (p = '{BASE}r_regionkey')::INT AS n FROM ({_COUNTS})")
updates("update_delete_where", "DELETE WHERE { ?c :c_mktsegment 'BUILDING' ; :c_acctbal ?b }", f"""
  SELECT g, p, n - CASE WHEN p IN ('{BASE}c_mktsegment', '{BASE}c_acctbal') THEN (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') ELSE 0 END AS n FROM ({_COUNTS})""")
updates("update_insert_where", "INSERT { GRAPH ?n { ?c :rich ?b } } WHERE { ?c :ofNation ?n ; :c_acctbal ?b FILTER(?b > 5000) }", f"""
  SELECT * FROM ({_COUNTS}) UNION ALL SELECT '{BASE}nation/' || c_nationkey, '{BASE}rich', count(*) FROM customer WHERE c_acctbal > 5000 GROUP BY 1""")
_RICH = f"SELECT '{BASE}rich' AS p, count(*) AS n FROM customer WHERE c_acctbal > 5000"
_MAKE = "INSERT { GRAPH :g1 { ?c :rich ?b } } WHERE { ?c :c_acctbal ?b FILTER(?b > 5000) } ; "
updates("update_copy", _MAKE + "CREATE GRAPH :g2 ; COPY :g1 TO :g2", f"SELECT * FROM ({_COUNTS}) UNION ALL SELECT unnest(['{BASE}g1', '{BASE}g2']), p, n FROM ({_RICH})")
updates("update_move", _MAKE + "MOVE :g1 TO :g2", f"SELECT * FROM ({_COUNTS}) UNION ALL SELECT '{BASE}g2', p, n FROM ({_RICH})")
updates("update_add", _MAKE + "ADD :g1 TO DEFAULT", f"SELECT * FROM ({_COUNTS}) UNION ALL SELECT unnest(['{BASE}g1', '-']), p, n FROM ({_RICH})")
updates("update_clear", _MAKE + "CLEAR DEFAULT", f"SELECT '{BASE}g1' AS g, p, n FROM ({_RICH})")
updates("update_drop", _MAKE + "DROP GRAPH :g1 ; DROP SILENT GRAPH :nosuch", _COUNTS)


# readers and writers: every customer written and read back
def _customer_quads(spark: SparkSession, folder: str) -> DataFrame:
    m = tpch(spark, folder)
    m.tables = {"customer": m.tables["customer"]}
    m.tables["customer"].links.clear()
    return m.quads()


_CUSTOMER_TRIPLES = """SELECT '{0}customer/' || c_custkey AS s, '{0}' || unnest(['c_custkey', 'c_name', 'c_mktsegment']) AS p, unnest([c_custkey::VARCHAR, c_name, c_mktsegment]) AS o FROM customer""".format(BASE)


def round_trip(name: str):
    def add(function) -> None:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            found = function(spark, _customer_quads(spark, folder), fresh_path(spark, name))
            return found.where(t.lexical(F.col("p")).isin([BASE + x for x in ("c_custkey", "c_name", "c_mktsegment")])).select(*[t.lexical(F.col(x)).alias(x) for x in "spo"])

        plan(name, _CUSTOMER_TRIPLES)(run)

    return add


@round_trip("nquads_round_trip")
def _nquads(spark, quads, path):
    rdf.write_nquads(quads, path)
    return rdf.read_nquads(spark, path)


@round_trip("turtle_round_trip")
def _turtle(spark, quads, path):
    rdf.turtle_blocks(quads).write.text(path)
    return rdf.read_turtle(spark, path)


@round_trip("columnar_round_trip")
def _columnar(spark, quads, path):
    scans.store(quads, path)
    return scans.load(spark, path)


@round_trip("basic_encoding_round_trip")
def _basic(spark, quads, path):
    rdf.nquad_lines(quads).write.text(path)
    return rdf.nquads(spark.read.text(path))


@round_trip("term_json_round_trip")
def _term_json(spark, quads, path):
    import json

    there, back = F.udf(lambda x: json.dumps(formats.term_to_json(x)), "string", useArrow=True), F.udf(lambda x: formats.term_from_json(json.loads(x)), "string", useArrow=True)
    quads.select(*[there(c).alias(c) for c in "spo"]).write.parquet(path)
    return spark.read.parquet(path).select(*[back(c).alias(c) for c in "spo"])


def _results(form: str, parse):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = dataset(spark, folder).query("SELECT ?c ?name WHERE { ?c :c_name ?name }").terms()
        return parse(rdf.result_lines(found, form))

    return run


plan("result_csv", "SELECT '{0}customer/' || c_custkey || ',' || c_name AS value FROM customer".format(BASE))(_results("csv", lambda lines: lines))
plan("result_tsv", "SELECT '<{0}customer/' || c_custkey || '>' || chr(9) || '\"' || c_name || '\"' AS value FROM customer".format(BASE))(_results("tsv", lambda lines: lines))


# geometry: unit-aligned boxes of every customer against one another box, decided by SQL on the corners
def _box(x, y, w, h):
    return F.format_string("POLYGON((%d %d, %d %d, %d %d, %d %d, %d %d))", x, y, x + w, y, x + w, y + h, x, y + h, x, y)


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, folder, "customer").select(k.alias("k"), _box(k % 9, k % 7, k % 4 + 1, k % 3 + 1).alias("a"), _box(F.lit(3), F.lit(2), F.lit(3), F.lit(3)).alias("b")).repartition(spark.sparkContext.defaultParallelism)


_AXIS = """WITH c AS (SELECT c_custkey AS k, c_custkey % 9 AS x0, c_custkey % 9 + c_custkey % 4 + 1 AS x1, c_custkey % 7 AS y0, c_custkey % 7 + c_custkey % 3 + 1 AS y1 FROM customer),
r AS (SELECT *, x0 < 6 AND 3 < x1 AND y0 < 5 AND 2 < y1 AS inner_, x0 <= 6 AND 3 <= x1 AND y0 <= 5 AND 2 <= y1 AS meet, x0 >= 3 AND x1 <= 6 AND y0 >= 2 AND y1 <= 5 AS inside, x0 > 3 AND x1 < 6 AND y0 > 2 AND y1 < 5 AS deep,
  x0 <= 3 AND x1 >= 6 AND y0 <= 2 AND y1 >= 5 AS around, x0 < 3 AND x1 > 6 AND y0 < 2 AND y1 > 5 AS wide, x0 = 3 AND x1 = 6 AND y0 = 2 AND y1 = 5 AS same FROM c)
"""
_RELATIONS = {
    "sfEquals": "same", "sfDisjoint": "NOT meet", "sfIntersects": "meet", "sfTouches": "meet AND NOT inner_", "sfWithin": "inside", "sfContains": "around", "sfOverlaps": "inner_ AND NOT inside AND NOT around", "sfCrosses": "false",
    "ehEquals": "same", "ehDisjoint": "NOT meet", "ehMeet": "meet AND NOT inner_", "ehOverlap": "inner_ AND NOT inside AND NOT around", "ehCovers": "around AND NOT wide AND NOT same", "ehCoveredBy": "inside AND NOT deep AND NOT same", "ehInside": "deep", "ehContains": "wide",
    "rcc8eq": "same", "rcc8dc": "NOT meet", "rcc8ec": "meet AND NOT inner_", "rcc8po": "inner_ AND NOT inside AND NOT around", "rcc8tppi": "around AND NOT wide AND NOT same", "rcc8tpp": "inside AND NOT deep AND NOT same", "rcc8ntpp": "deep", "rcc8ntppi": "wide",
}
for _family in ("sf", "eh", "rcc8"):
    _mine = {n: w for n, w in _RELATIONS.items() if n.startswith(_family)}
    plan(f"geo_relations_{_family}", _AXIS + "SELECT k, " + ", ".join(f"{w} AS {n}" for n, w in _mine.items()) + " FROM r")(
        lambda s, f, names=tuple(_mine): _boxes(s, f).select("k", geo.relations(list(names), F.col("a"), F.col("b")).alias("r")).select("k", *[F.col("r")[i].alias(n) for i, n in enumerate(names)])
    )


def _geof(name: str, *arguments):
    return t.string(geo.functions()[geo.GEOF + name](*[t.Val("str", F.col(a) if isinstance(a, str) else a) for a in arguments]))


_NUMBERS = {"area": "(x1 - x0) * (y1 - y0)", "length": "2 * (x1 - x0 + y1 - y0)", "dimension": "2", "numGeometries": "1", "coordinateDimension": "2"}
plan("geo_measures", _AXIS + "SELECT k, " + ", ".join(f"({w})::DOUBLE AS {n}" for n, w in _NUMBERS.items()) + ", sqrt(pow(greatest(x0 - 6, 3 - x1, 0), 2) + pow(greatest(y0 - 5, 2 - y1, 0), 2)) AS distance, false AS empty, true AS simple, 'Polygon' AS kind FROM r")(
    lambda s, f: _boxes(s, f).select(
        "k", *[_geof(n, "a").cast("double").alias(n) for n in _NUMBERS], _geof("distance", "a", "b").cast("double").alias("distance"), _geof("isEmpty", "a").cast("boolean").alias("empty"), _geof("isSimple", "a").cast("boolean").alias("simple"), F.initcap(_geof("geometryType", "a")).alias("kind")
    )
)


# graphs and paths over the links of customers and parts
_BOUGHT = "SELECT DISTINCT o_custkey AS src, l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _bought(spark: SparkSession, folder: str) -> DataFrame:
    lines, orders = read(spark, folder, "lineitem"), read(spark, folder, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


plan("degree_distribution", f"SELECT degree, count(*) AS n FROM (SELECT src, count(*) AS degree FROM ({_BOUGHT}) GROUP BY src) GROUP BY degree")(
    lambda s, f: graph.degree(_bought(s, f)).where("degree > 0").groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
)
plan("edge_list_round_trip", f"SELECT count(*) AS n, sum(src)::BIGINT AS a, sum(dst)::BIGINT AS b FROM ({_BOUGHT})")(lambda s, f: _edges_back(s, _bought(s, f)))


def _edges_back(spark: SparkSession, edges: DataFrame) -> DataFrame:
    path = fresh_path(spark, "edge-list")
    rdf.write_edges(edges, path)
    found = spark.read.text(path).select(F.split("value", r"\s+").alias("x"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x")[0].cast("long")).alias("a"), F.sum(F.col("x")[1].cast("long")).alias("b"))


plan("graph_generators", "SELECT * FROM (VALUES ('path', 999), ('cycle', 1000), ('tree', 999), ('complete', 780), ('grid', 1740)) v(kind, n)")(
    lambda s, f: s.createDataFrame([("path",), ("cycle",), ("tree",), ("complete",), ("grid",)], "kind string").join(_generated(s), "kind")
)


def _generated(spark: SparkSession) -> DataFrame:
    made = {"path": graph.path_graph(spark, 1000), "cycle": graph.cycle_graph(spark, 1000), "tree": graph.tree_graph(spark, 1000), "complete": graph.complete_graph(spark, 40), "grid": graph.grid_graph(spark, 30, 30)}
    out = None
    for kind, edges in made.items():
        part = graph.undirected(edges).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.col("n").cast("int").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


# built-ins that no other query calls
sparql(
    "fn_more_hashes",
    "SELECT ?k (SHA384(?n) AS ?a) (SHA512(?n) AS ?b) WHERE { ?c :c_custkey ?k ; :c_name ?n }",
)
sparql(
    "fn_more_terms",
    """SELECT ?k (ISURI(?c) AS ?u) (STR(URI(CONCAT("http://h/", ?n))) AS ?i) (sameValue(?k, ?k + 0.0) AS ?v) (ISTRIPLE(?c) AS ?t) (hasLANGDIR(?n) AS ?d) (LANGDIR(STRLANGDIR(?n, "en", "ltr")) AS ?l)
       WHERE { ?c :c_custkey ?k ; :c_name ?n }""",
    "SELECT c_custkey AS k, true AS u, 'http://h/' || c_name AS i, true AS v, false AS t, false AS d, 'ltr' AS l FROM customer",
)
sparql(
    "fn_triples",
    """SELECT ?k (STR(SUBJECT(?t)) AS ?s) (STR(PREDICATE(?t)) AS ?p) (STR(OBJECT(?t)) AS ?o) (ISTRIPLE(?t) AS ?is) WHERE { ?c :c_custkey ?k ; :c_name ?n BIND(TRIPLE(?c, :called, ?n) AS ?t) }""",
    "SELECT c_custkey AS k, 'http://example.org/customer/' || c_custkey AS s, 'http://example.org/called' AS p, c_name AS o, true AS \"is\" FROM customer",
)
sparql(
    "optional_chain",
    "SELECT ?name ?b ?r WHERE { ?c :c_name ?name OPTIONAL { ?c :c_acctbal ?b ; :ofNation ?n FILTER(?b > 5000) } OPTIONAL { ?n :inRegion ?r } }",
    """SELECT c_name AS name, CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS b, 'http://example.org/region/' || n_regionkey AS r FROM customer JOIN nation ON c_acctbal <= 5000 OR c_nationkey = n_nationkey""",
)
sparql(
    "minus_loose",
    "SELECT ?name WHERE { ?c :c_name ?name OPTIONAL { ?c :ofNation ?n ; :c_acctbal ?b FILTER(?b > 5000) } MINUS { ?n :inRegion :region\\/1 } }",
    "SELECT c_name AS name FROM customer WHERE NOT (c_acctbal > 5000 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))",
)


# annotations: every order's link to its customer is reified, and the order's status said of it
def _annotated(spark: SparkSession, folder: str) -> DataFrame:
    said = dataset(spark, folder).query("CONSTRUCT { ?o :orderedBy ?c {| :status ?st ; :priority ?p |} } WHERE { ?o :orderedBy ?c ; :o_orderstatus ?st ; :o_orderpriority ?p }")
    return settle(said.quads, "annotated")


on_quads("annotated_triples", "SELECT ?c ?st (COUNT(*) AS ?n) WHERE { ?o :orderedBy ?c {| :status ?st |} } GROUP BY ?c ?st",
         "SELECT 'http://example.org/customer/' || o_custkey AS c, o_orderstatus AS st, count(*) AS n FROM orders GROUP BY 1, 2", _annotated)
on_quads("reified_triples", "SELECT ?o ?st WHERE { << ?o :orderedBy ?c >> :status ?st ; :priority '1-URGENT' }",
         "SELECT 'http://example.org/orders/' || o_orderkey AS o, o_orderstatus AS st FROM orders WHERE o_orderpriority = '1-URGENT'", _annotated)
on_quads("triple_terms", "SELECT ?p (COUNT(DISTINCT ?o) AS ?n) (COUNT(DISTINCT ?c) AS ?m) WHERE { ?r <http://www.w3.org/1999/02/22-rdf-syntax-ns#reifies> <<( ?o ?p ?c )>> . ?o ?p ?c } GROUP BY ?p",
         "SELECT 'http://example.org/orderedBy' AS p, count(*) AS n, count(DISTINCT o_custkey) AS m FROM orders", _annotated)
