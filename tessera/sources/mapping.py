"""Tables as virtual triples.

A mapped table gives a class, a subject IRI template over its key, and a predicate for each column; a foreign key is an
object property whose values are subjects of another table. Patterns on one subject become one scan of its table with the
columns that are asked for, so pushdown and pruning work as on any DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF, Val, iri, native, to_term

TYPE = RDF + "type"


@dataclass(frozen=True)
class TableMap:
    """keys: columns of the subject's key; links: predicate to (columns here, table there)."""

    name: str
    cls: str
    keys: tuple[str, ...]
    columns: dict[str, str] = field(default_factory=dict)
    links: dict[str, tuple[tuple[str, ...], str]] = field(default_factory=dict)
    prefix: str = ""

    def subject(self, columns: tuple[str, ...] | None = None) -> Column:
        parts = [F.col(f"`{c}`").cast("string") for c in columns or self.keys]
        out = [F.lit(self.prefix)]
        for k, p in enumerate(parts):
            out += [F.lit("-"), p] if k else [p]
        return F.concat(*out)


    def subject_value(self, columns: tuple[str, ...] | None = None) -> Val:
        """The subject; with a key of one column that column itself, as long as no IRI is asked for."""
        columns = columns or self.keys
        return Val(f"key:{self.prefix}", F.col(f"`{columns[0]}`").cast("bigint")) if len(columns) == 1 else Val("iri", self.subject(columns))


@dataclass
class RelationalMap:
    """Tables by name, loaded through `load`; predicates and classes are looked up by IRI."""

    load: Callable[[str], DataFrame]
    tables: dict[str, TableMap]

    def of_class(self, cls: str) -> TableMap | None:
        return next((t for t in self.tables.values() if t.cls == cls), None)

    def of_predicate(self, predicate: str) -> list[TableMap]:
        return [t for t in self.tables.values() if predicate in t.columns or predicate in t.links]

    def value(self, t: TableMap, df: DataFrame, predicate: str) -> Val:
        """The object of a predicate as a value over the table's columns."""
        if predicate in t.links:
            columns, other = t.links[predicate]
            return self.tables[other].subject_value(columns)
        column = t.columns[predicate]
        return Val(native(df.schema[column].dataType.simpleString()), F.col(f"`{column}`"))

    def quads(self, predicate: str | None = None) -> DataFrame:
        """All virtual triples as encoded quads; with a predicate those of the tables that have it.

        Each predicate of a table is a branch of its own with the predicate as a literal, so that a condition on p (or on
        the class) leaves only the branches and columns that it needs.
        """
        out = None
        for t in self.tables.values():
            known = [TYPE, *t.columns, *t.links]
            wanted = known if predicate is None else [p for p in known if p == predicate]
            if not wanted:
                continue
            df = self.load(t.name)
            terms = [(p, F.lit(iri(t.cls)) if p == TYPE else to_term(self.value(t, df, p))) for p in wanted]
            subject = F.concat(F.lit("I"), t.subject()).alias("s")
            for p, o in terms:
                rows = df.select(subject, F.lit(iri(p)).alias("p"), o.alias("o"), F.lit(None).cast("string").alias("g")).where("o IS NOT NULL")
                out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.quads().where(F.lit(False))

    def stars(self) -> DataFrame:
        """(s, quads: array of (p, o, g)): each row's triples together, from one scan of each table."""
        out = None
        for t in self.tables.values():
            df = self.load(t.name)
            terms = [(TYPE, F.lit(iri(t.cls))), *((p, to_term(self.value(t, df, p))) for p in (*t.columns, *t.links))]
            said = F.array(*[F.struct(F.lit(iri(p)).alias("p"), o.alias("o"), F.lit(None).cast("string").alias("g")) for p, o in terms])
            rows = df.select(F.concat(F.lit("I"), t.subject()).alias("s"), F.filter(said, lambda q: q["o"].isNotNull()).alias("quads"))
            out = rows if out is None else out.unionByName(rows)
        return out


BASE = "http://example.org/"


def tpch(spark: SparkSession, folder: str) -> RelationalMap:
    """The star schema of the test tables, with `events` and `documents`."""
    shapes: dict[str, tuple[tuple[str, ...], dict[str, tuple[tuple[str, ...], str]]]] = {
        "region": (("r_regionkey",), {}),
        "nation": (("n_nationkey",), {"inRegion": (("n_regionkey",), "region")}),
        "customer": (("c_custkey",), {"ofNation": (("c_nationkey",), "nation")}),
        "supplier": (("s_suppkey",), {"supplierNation": (("s_nationkey",), "nation")}),
        "part": (("p_partkey",), {}),
        "orders": (("o_orderkey",), {"orderedBy": (("o_custkey",), "customer")}),
        "lineitem": (("l_orderkey", "l_linenumber"), {"ofOrder": (("l_orderkey",), "orders"), "ofPart": (("l_partkey",), "part"), "bySupplier": (("l_suppkey",), "supplier")}),
        "events": (("event_id",), {}),
    }
    columns = {
        "region": "r_regionkey r_name", "nation": "n_nationkey n_name", "customer": "c_custkey c_name c_acctbal c_mktsegment",
        "supplier": "s_suppkey s_name s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
        "orders": "o_orderkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
        "lineitem": "l_orderkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
        "events": "event_id ts user_id event_type value props",
    }
    tables = {
        name: TableMap(name, BASE + name.capitalize(), keys, {BASE + c: c for c in columns[name].split()}, {BASE + k: v for k, v in links.items()}, f"{BASE}{name}/")
        for name, (keys, links) in shapes.items()
    }
    return RelationalMap(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"), tables)
