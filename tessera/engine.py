"""The query engine's entry: a dataset, queries and their results."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import terms as t
from .functions.builtins import Registry
from .plans import algebra as A
from .plans.compiler import Context, Solutions, compile_pattern
from .plans.parser import parse_query
from .plans.rewrites import rewrite
from .shared import settle
from .sources.mapping import RelationalMap

QUADS = "s string, p string, o string, g string"


@dataclass
class Result:
    """SELECT: solutions. ASK: boolean. CONSTRUCT and DESCRIBE: quads."""

    form: str
    solutions: Solutions | None = None
    boolean: bool | None = None
    quads: DataFrame | None = None

    @property
    def df(self) -> DataFrame:
        return self.quads if self.quads is not None else self.solutions.df

    def terms(self) -> DataFrame:
        """The solutions with every variable as an encoded term."""
        s = self.solutions
        return s.df.select(*[t.to_term(s.val(n)).alias(n) for n in s.kinds])


@dataclass
class Dataset:
    """Quads of encoded terms (g null: the default graph), or tables mapped to triples."""

    spark: SparkSession
    quads: DataFrame | None = None
    mapping: RelationalMap | None = None
    prefixes: dict[str, str] = field(default_factory=dict)
    registry: Registry = field(default_factory=Registry)
    services: dict = field(default_factory=dict)
    types_of: object = None
    rewrites: list = field(default_factory=list)

    @staticmethod
    def of(spark: SparkSession, rows: list[tuple]) -> "Dataset":
        return Dataset(spark, spark.createDataFrame(rows, QUADS))

    def context(self) -> Context:
        return Context(self.spark, self.quads, self.mapping, self.registry, self.services, self.types_of, self.rewrites)

    def query(self, text: str, base: str = "") -> Result:
        q = parse_query(text, self.prefixes, base, frozenset(self.registry.aggregates))
        ctx = replace(self.context(), base=base, default_graphs=q.default_graphs, named_graphs=q.named_graphs)
        pattern = rewrite(q.pattern, self.rewrites) if self.rewrites else q.pattern
        s = compile_pattern(pattern, ctx)
        if q.form == "SELECT":
            columns = [t.as_iri(s.val(n)).col.alias(n) for n in s.kinds]
            return Result(q.form, Solutions(s.df.select(*columns) if columns else s.df, {n: "iri" if k.startswith("key:") else k for n, k in s.kinds.items()}, s.certain))
        if q.form == "ASK":
            return Result(q.form, boolean=not s.df.limit(1).isEmpty())
        if q.form == "CONSTRUCT":
            quads = instantiate(s, tuple((x.s, x.p, x.o, None) for x in q.template))
            return Result(q.form, quads=quads.distinct())
        return Result(q.form, quads=self.describe(s, q.resources, ctx))

    def select(self, text: str) -> DataFrame:
        return self.query(text).df

    def describe(self, s: Solutions, resources: tuple, ctx: Context) -> DataFrame:
        """Concise bounded descriptions: the resources' triples, and those of blank nodes that they lead to."""
        data = ctx.active()
        start = self.spark.createDataFrame([(r.term,) for r in resources if isinstance(r, A.Const)], "s string")
        names = [r.name for r in resources if isinstance(r, A.Var)] if resources else list(s.kinds)
        for n in names:
            if n in s.kinds:
                start = start.unionByName(s.df.select(t.to_term(s.val(n)).alias("s")))
        frontier = settle(start.where("s IS NOT NULL").distinct(), "describe")
        out, seen = None, frontier
        while not frontier.isEmpty():
            found = settle(data.join(frontier, "s", "left_semi"), "describe")
            out = found if out is None else out.unionByName(found)
            nodes = found.where(F.col("o").startswith("B")).select(F.col("o").alias("s")).distinct()
            frontier = settle(nodes.join(seen, "s", "left_anti"), "describe")
            seen = seen.unionByName(frontier)
        return (out if out is not None else data.where(F.lit(False))).select("s", "p", "o", "g")


def instantiate(s: Solutions, template: tuple) -> DataFrame:
    """Quads of a template for every solution; ill-formed ones and those with an unbound part are left out."""
    numbered = s.df.withColumn("__row", F.monotonically_increasing_id())
    def made(x) -> bool:
        return any(map(made, (x.s, x.p, x.o))) if isinstance(x, A.TripleTerm) else isinstance(x, A.Const) and x.term[0] == "B"

    if any(made(x) for q in template for x in q):
        numbered = settle(numbered, "construct")

    def part(x):
        if x is None:
            return F.lit(None).cast("string")
        if isinstance(x, str):
            return F.lit(x)
        if isinstance(x, A.Const):
            return F.concat(F.lit(x.term + "_"), F.col("__row").cast("string")) if x.term[0] == "B" else F.lit(x.term)
        if isinstance(x, A.TripleTerm):
            a, b, c = map(part, (x.s, x.p, x.o))
            return F.when(a.rlike("^[IB]") & b.startswith("I"), F.concat(F.lit("T"), a, F.lit("\x02"), b, F.lit("\x02"), c))
        return t.to_term(s.val(x.name)) if x.name in s.kinds else F.lit(None).cast("string")

    structs = [F.struct(part(a).alias("s"), part(b).alias("p"), part(c).alias("o"), part(g).alias("g"), F.lit(g is not None).alias("_named")) for a, b, c, g in template]
    if not structs:
        return s.df.sparkSession.createDataFrame([], QUADS)
    rows = numbered.select(F.explode(F.array(*structs)).alias("_x")).select("_x.*")
    fine = F.col("s").rlike("^[IB]") & F.col("p").startswith("I") & F.col("o").isNotNull() & (~F.col("_named") | F.col("g").isNotNull())
    return rows.where(fine).select("s", "p", "o", "g")
