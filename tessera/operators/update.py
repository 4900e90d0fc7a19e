"""SPARQL updates over versions of a dataset: snapshots, deltas, worlds."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import QUADS, Dataset, instantiate
from ..functions import terms as t
from ..plans import algebra as A
from ..plans.compiler import compile_pattern
from ..plans.parser import parse_update
from ..shared import fresh_path, settle


class ConflictError(RuntimeError):
    """The head moved since the session began."""


@dataclass(frozen=True)
class Version:
    """A snapshot in the shared folder, with what it added to and took from its parent.

    Without a path it is the quads of `base` (a frame over data that don't change, such as mapped tables) and the deltas
    since, none of which are written again.
    """

    number: int
    path: str | None
    parent: "Version | None"
    graphs: frozenset[str]
    delta: str | None = None
    base: DataFrame | None = field(default=None, compare=False, repr=False)


@dataclass
class GraphStore:
    """Named worlds over immutable versions. A commit writes a delta and a snapshot, then swaps the head in one step."""

    spark: SparkSession
    loader: Callable[[str], list[tuple]] | None = None
    heads: dict[str, Version] = field(default_factory=dict)
    observers: list[Callable[[int, DataFrame], None]] = field(default_factory=list)
    contextual: bool = False
    manifest: str | None = None
    _count: int = 0
    _generation: int = 0

    def __post_init__(self):
        if not self.heads:
            self.heads["main"] = self._write(self.spark.createDataFrame([], QUADS), None, frozenset())

    def _write(self, quads: DataFrame, parent: Version | None, graphs: frozenset[str], delta: str | None = None) -> Version:
        path = fresh_path(self.spark, "version")
        quads.write.parquet(path)
        self._count += 1
        return Version(self._count, path, parent, graphs, delta)

    @staticmethod
    def over(spark: SparkSession, quads: DataFrame) -> "GraphStore":
        """A store whose first version is a set of quads that stays where it is; commits write their deltas only."""
        return GraphStore(spark, heads={"main": Version(1, None, None, frozenset(), base=quads)}, _count=1)

    def _publish(self) -> None:
        """The heads as the next generation of the manifest, if there is one; a reader takes the last that is complete."""
        if self.manifest is not None:
            for w, v in self.heads.items():
                if v.path is None:  # a manifest names folders
                    self.heads[w] = self._write(self._read(v), v.parent, v.graphs, v.delta)
            self._generation += 1
            heads = {w: {"number": v.number, "path": v.path, "graphs": sorted(v.graphs), "delta": v.delta} for w, v in self.heads.items()}
            text = json.dumps({"generation": self._generation, "count": self._count, "heads": heads})
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(self.manifest)

    @staticmethod
    def open(spark: SparkSession, manifest: str) -> "GraphStore":
        """The store as its manifest's last generation has it; versions before the heads are no longer linked."""
        found = max((json.loads(r["value"]) for r in spark.read.text(manifest).toLocalIterator()), key=lambda x: x["generation"])
        heads = {w: Version(v["number"], v["path"], None, frozenset(v["graphs"]), v["delta"]) for w, v in found["heads"].items()}
        return GraphStore(spark, heads=heads, manifest=manifest, _count=found["count"], _generation=found["generation"])

    def quads(self, world: str = "main") -> DataFrame:
        return self._read(self.heads[world])

    def _read(self, version: Version) -> DataFrame:
        if version.path is not None:
            return self.spark.read.schema(QUADS).parquet(version.path)
        if version.delta is None:
            return version.base
        # the last change of a quad since the base says whether it is there
        changes, at = None, version
        while at.delta is not None:
            one = self.spark.read.parquet(at.delta)
            changes = one if changes is None else changes.unionByName(one)
            at = at.parent
        last = changes.groupBy("s", "p", "o", "g").agg(F.max_by("change", "version").alias("change"))
        return absent(version.base, last, self._predicates(last)).unionByName(last.where("change = 1").select("s", "p", "o", "g"))

    @staticmethod
    def _predicates(quads: DataFrame) -> list[str] | None:
        """The distinct predicates, or None if there are too many for a condition."""
        found = [r["p"] for r in quads.select("p").distinct().limit(201).collect()]
        return found if len(found) <= 200 else None

    def dataset(self, world: str = "main", **options) -> Dataset:
        return Dataset(self.spark, self.quads(world), **options)

    def commit(self, deletes: DataFrame, inserts: DataFrame, world: str = "main", expected: Version | None = None, graphs: frozenset[str] | None = None) -> Version:
        """The next version: what is deleted goes first, then what is inserted comes. Only real changes are in the delta."""
        head = self.heads[world]
        if expected is not None and expected != head:
            raise ConflictError(f"{world} is at version {head.number}, not {expected.number}")
        old = self.quads(world)
        if head.path is None:  # what is deleted and inserted is written, and the data are read where they have its predicates
            inserts, deletes = settle(inserts.select("s", "p", "o", "g").distinct(), "inserts"), settle(deletes.select("s", "p", "o", "g").distinct(), "deletes")
            into, out_of = self._predicates(inserts), self._predicates(deletes)
            adds = absent(inserts, old if into is None else old.where(F.col("p").isin(into) if into else F.lit(False)))
            removes = absent(_common(old if out_of is None else old.where(F.col("p").isin(out_of) if out_of else F.lit(False)), deletes), inserts)
        else:
            adds = absent(inserts.select("s", "p", "o", "g").distinct(), old)
            removes = absent(_common(old, deletes), inserts)
        path = fresh_path(self.spark, "delta")
        adds.withColumn("change", F.lit(1)).unionByName(removes.withColumn("change", F.lit(-1))).withColumn("version", F.lit(self._count + 1)).write.parquet(path)
        delta = self.spark.read.parquet(path)
        graphs = head.graphs if graphs is None else graphs
        if head.path is None:
            self._count += 1
            version = Version(self._count, None, head, graphs, path, head.base)
        else:
            new = absent(old, delta.where("change = -1")).unionByName(delta.where("change = 1").select("s", "p", "o", "g"))
            version = self._write(new, head, graphs, path)
        if self.heads[world] is not head:
            raise ConflictError(f"{world} moved during the commit")
        self.heads[world] = version
        self._publish()
        for observe in self.observers:
            observe(version.number, delta)
        return version

    def insert(self, rows: list[tuple] | DataFrame, world: str = "main") -> Version:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, QUADS)
        return self.commit(self._none(), df, world)

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], QUADS)

    def update(self, text: str, world: str = "main", prefixes: dict[str, str] | None = None) -> Version:
        """Runs the operations one after another; each sees what the one before has left."""
        for op in parse_update(text, prefixes):
            try:
                self._apply(op, world)
            except (KeyError, FileNotFoundError, ValueError, OSError):
                if not op.silent:
                    raise
        return self.heads[world]

    def _apply(self, op: A.Update, world: str) -> None:
        head, quads = self.heads[world], self.quads(world)
        if op.kind in ("INSERT", "DELETE", "MODIFY"):
            if op.pattern is None:
                s = compile_pattern(A.Unit(), self.dataset(world).context())
            else:
                ctx = self.dataset(world).context()
                if op.using:
                    ctx = replace(ctx, default_graphs=tuple(g for named, g in op.using if not named), named_graphs=tuple(g for named, g in op.using if named))
                s = compile_pattern(op.pattern, ctx)
            self.commit(instantiate(s, op.delete), instantiate(s, op.insert), world)
        elif op.kind in ("CLEAR", "DROP"):
            graphs = head.graphs - {op.target} if op.kind == "DROP" and op.target not in ("DEFAULT", "NAMED", "ALL") else frozenset() if op.kind == "DROP" and op.target in ("NAMED", "ALL") else head.graphs
            if op.target not in ("DEFAULT", "NAMED", "ALL") and not op.silent and not self._known(op.target, world):
                raise KeyError(f"no graph {op.target[1:]}")
            self.commit(_of(quads, op.target), self._none(), world, graphs=graphs)
        elif op.kind == "CREATE":
            if self._known(op.target, world) and not op.silent:
                raise ValueError(f"there is a graph {op.target[1:]}")
            self.commit(self._none(), self._none(), world, graphs=head.graphs | {op.target})
        elif op.kind == "LOAD":
            if self.loader is None:
                raise FileNotFoundError(op.source)
            target = op.target
            rows = self.loader(op.source)
            if self.contextual and target is None:
                target = t.iri(f"urn:tessera:load:{self._count + 1}")
                rows = [(s, p, o, None) for s, p, o, _ in rows]
                self.insert([(target, t.iri("http://www.w3.org/ns/prov#wasDerivedFrom"), t.iri(op.source), None)], world)
            self.insert([(s, p, o, target) for s, p, o, _ in rows], world)
        else:
            if not self._known(op.source, world):
                raise KeyError(f"no graph {op.source[1:]}")
            if op.source == op.target:
                return
            moved = _of(quads, op.source).withColumn("g", F.lit(None if op.target == "DEFAULT" else op.target).cast("string"))
            if op.kind == "ADD":
                self.commit(self._none(), moved, world)
            else:
                gone = _of(quads, op.target)
                self.commit(gone if op.kind == "COPY" else gone.unionByName(_of(quads, op.source)), moved, world)

    def _known(self, graph: str, world: str) -> bool:
        return graph in ("DEFAULT", "NAMED", "ALL") or graph in self.heads[world].graphs or not _of(self.quads(world), graph).isEmpty()

    # worlds
    def fork(self, name: str, source: str = "main") -> Version:
        if name in self.heads:
            raise ValueError(f"there is a world {name}")
        self.heads[name] = self.heads[source]
        self._publish()
        return self.heads[name]

    def drop(self, name: str) -> None:
        if name == "main":
            raise ValueError("the main world stays")
        del self.heads[name]
        self._publish()

    def diff(self, a: str, b: str) -> DataFrame:
        """(s, p, o, g, change): 1 for what b has and a has not, -1 for the reverse."""
        x, y = self.heads[a], self.heads[b]
        if x.path is None and y.path is None and x.base is y.base:  # quads that no delta names are in both
            named = None
            for v in (*self.history(a), *self.history(b)):
                if v.delta is not None:
                    one = self.spark.read.parquet(v.delta).select("p")
                    named = one if named is None else named.unionByName(one)
            touched = [] if named is None else self._predicates(named)
            x, y = (self._read(v) if touched is None else self._read(v).where(F.col("p").isin(touched) if touched else F.lit(False)) for v in (x, y))
        else:
            x, y = self._read(x), self._read(y)
        return absent(y, x).withColumn("change", F.lit(1)).unionByName(absent(x, y).withColumn("change", F.lit(-1)))

    def history(self, world: str = "main") -> list[Version]:
        out, at = [], self.heads[world]
        while at is not None:
            out.append(at)
            at = at.parent
        return out


def _of(quads: DataFrame, graph: str) -> DataFrame:
    if graph == "ALL":
        return quads
    if graph in ("DEFAULT", "NAMED"):
        return quads.where(F.col("g").isNull() if graph == "DEFAULT" else F.col("g").isNotNull())
    return quads.where(F.col("g") == F.lit(graph))


def _keyed(df: DataFrame, mark: str) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(mark + c) for c in "spog"])


def absent(left: DataFrame, right: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """The rows of left that right has not; with the predicates of right, the others are not compared."""
    if predicates is None:
        return _match(left, right, "left_anti")
    if not predicates:
        return left
    mine = F.col("p").isin(predicates)
    return left.where(~mine).unionByName(_match(left.where(mine), right, "left_anti"))


def _common(left: DataFrame, right: DataFrame) -> DataFrame:
    return _match(left, right, "left_semi")


def _match(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    r = _keyed(right, "_")
    condition = (F.col("s") == F.col("_s")) & (F.col("p") == F.col("_p")) & (F.col("o") == F.col("_o")) & (F.coalesce(F.col("g"), F.lit("")) == F.col("_g"))
    return left.join(r, condition, how)
