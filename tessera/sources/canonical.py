"""Canonical labels for blank nodes (RDFC-1.0) and the basic encoding of triple terms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from ..operators.graph import components
from ..shared import settle
from .rdf import ntriples_term

Quad = tuple


class Issuer:
    def __init__(self, prefix: str, known: dict[str, str] | None = None):
        self.prefix, self.known = prefix, dict(known or {})

    def of(self, node: str) -> str:
        return self.known.setdefault(node, f"{self.prefix}{len(self.known)}")

    def copy(self) -> "Issuer":
        return Issuer(self.prefix, self.known)


def _line(q: Quad, name) -> str:
    return " ".join([f"_:{name(x)}" if x[0] == "B" else ntriples_term(x) for x in q if x is not None] + [".\n"])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Canonicalizer:
    """The labelling of one set of quads. `limit` bounds the work on symmetric groups."""

    def __init__(self, quads: list[Quad], limit: int = 50_000):
        self.quads, self.limit = sorted(set(quads), key=str), limit
        self.of: dict[str, list[Quad]] = {}
        for q in self.quads:
            for x in {x for x in (q[0], q[2], q[3]) if x and x[0] == "B"}:
                self.of.setdefault(x, []).append(q)
        self.first = {n: _sha("".join(sorted(_line(q, lambda x, n=n: "a" if x == n else "z") for q in qs))) for n, qs in self.of.items()}
        self.canonical = Issuer("c14n")

    def labels(self) -> dict[str, str]:
        groups: dict[str, list[str]] = {}
        for n, h in self.first.items():
            groups.setdefault(h, []).append(n)
        rest = []
        for h in sorted(groups):
            if len(groups[h]) == 1:
                self.canonical.of(groups[h][0])
            else:
                rest.append(groups[h])
        for group in rest:
            found = []
            for n in group:
                if n not in self.canonical.known:
                    issuer = Issuer("b")
                    issuer.of(n)
                    found.append(self.paths(n, issuer))
            for _, issuer in sorted(found, key=lambda x: x[0]):
                for n in issuer.known:
                    self.canonical.of(n)
        return self.canonical.known

    def related(self, node: str, q: Quad, issuer: Issuer, place: str) -> str:
        name = self.canonical.known.get(node) or issuer.known.get(node)
        text = place + ("" if place == "g" else f"<{q[1][1:]}>") + (f"_:{name}" if name else self.first[node])
        return _sha(text)

    def paths(self, node: str, issuer: Issuer) -> tuple[str, Issuer]:
        near: dict[str, list[str]] = {}
        for q in self.of[node]:
            for place, x in (("s", q[0]), ("o", q[2]), ("g", q[3])):
                if x and x[0] == "B" and x != node:
                    near.setdefault(self.related(x, q, issuer, place), []).append(x)
        text = ""
        for h in sorted(near):
            text += h
            best, best_issuer = "", None
            for order in permutations(near[h]):
                self.limit -= 1
                if self.limit < 0:
                    raise ValueError("the graph is too symmetric for the limit")
                mine, path, again, worse = issuer.copy(), "", [], False
                for x in order:
                    if x in self.canonical.known:
                        path += f"_:{self.canonical.known[x]}"
                    else:
                        if x not in mine.known:
                            again.append(x)
                        path += f"_:{mine.of(x)}"
                    if best and len(path) >= len(best) and path > best:
                        worse = True
                        break
                for x in again if not worse else ():
                    found, mine2 = self.paths(x, mine)
                    path += f"_:{mine.of(x)}<{found}>"
                    mine = mine2
                    if best and len(path) >= len(best) and path > best:
                        worse = True
                        break
                if not worse and (not best or path < best):
                    best, best_issuer = path, mine
            text += best
            issuer = best_issuer
        return _sha(text), issuer


def canonical_lines(quads: list[Quad]) -> list[str]:
    """The canonical N-Quads lines of a document's quads."""
    names = Canonicalizer(quads).labels()
    return sorted({_line(q, names.__getitem__) for q in quads})


def _blank(c: Column) -> Column:
    return c.startswith("B")


def labelled(quads: DataFrame, stars: DataFrame | None = None) -> DataFrame:
    """Quads whose blank nodes have labels that depend on their surroundings alone, so equal graphs get equal quads.

    Blank nodes that quads connect with others are grouped; each group is labelled by itself (its own canonical form, named by
    that form's hash), so the work is spread. A node that no quad connects with another is a group whose form is the set of
    its quads, each told by a 64-bit hash, so that only hashes are gathered. Groups with the same form get the same labels.
    Quads that repeat stand in the result as often. stars, if given, are the quads again as (s, quads: array of (p, o, g)),
    any number of rows for a subject, so that what has been read together is hashed together.
    """
    s, o, g = map(F.col, "sog")
    pairs = [quads.where(_blank(y) & _blank(x) & (x != y)).select(x.alias("src"), y.alias("dst")) for x, y in ((s, o), (s, g), (o, g))]
    links = settle(reduce(DataFrame.unionByName, pairs).distinct(), "blank-links")
    group = None if links.isEmpty() else settle(components(links), "blank-groups")
    held = quads.withColumn("_k", F.when(_blank(s), s).when(_blank(o), o).when(_blank(g), g))

    def mark(node: Column, *terms: Column) -> Column:
        return F.xxhash64(*[F.when(x == node, F.lit("B")).otherwise(F.coalesce(x, F.lit(""))) for x in terms])

    k, rest = F.col("_k"), held.where("_k IS NOT NULL")
    if stars is None:
        marks = rest.select("_k", F.array(mark(k, s, F.col("p"), o, g)).alias("marks"))
    else:
        marks = stars.where(_blank(s)).select(s.alias("_k"), F.transform("quads", lambda q: mark(s, s, q["p"], q["o"], q["g"])).alias("marks"))
        marks = marks.unionByName(rest.where(~_blank(s)).select("_k", F.array(mark(k, s, F.col("p"), o, g)).alias("marks")))
    if group is not None:
        marks = marks.join(group.select(F.col("node").alias("_k")), "_k", "left_anti")
    form = F.xxhash64(F.array_sort(F.array_distinct(F.flatten(F.collect_list("marks")))))
    alone = marks.groupBy("_k").agg(F.concat(F.lit("B"), F.lower(F.lpad(F.hex(form), 16, "0")), F.lit("_c14n0")).alias("_label"))
    named = rest.join(alone, "_k").select(*[F.col(c) if c == "p" else F.when(F.col(c) == k, F.col("_label")).otherwise(F.col(c)).alias(c) for c in "spog"])
    out = held.where("_k IS NULL").drop("_k").unionByName(named)
    if group is None:
        return out
    grouped = rest.join(group.withColumnRenamed("node", "_k"), "_k").groupBy("component").agg(F.collect_list(F.struct("s", "p", "o", "g")).alias("qs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for qs in batch.column(0).to_pylist():
                qs = [(q["s"], q["p"], q["o"], q["g"]) for q in qs]
                names = Canonicalizer(qs).labels()
                form = _sha("".join(sorted({_line(q, names.__getitem__) for q in qs})))[:16]
                rows += [tuple(f"B{form}_{names[x]}" if x and x[0] == "B" and x in names else x for x in q) for q in qs]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["s", "p", "o", "g"])

    return out.unionByName(grouped.select("qs").mapInArrow(run, "s string, p string, o string, g string"))


def basic_encode(quads: DataFrame) -> DataFrame:
    """RDF 1.2 quads without triple terms: each is named by its hash and described by three triples."""
    named = lambda c: F.concat(F.lit("Btt"), F.substring(F.sha1(c), 1, 20))
    nested = quads.where(F.col("o").startswith("T")).select(F.col("o").alias("term")).distinct()
    while True:
        parts = F.split(F.substring("term", 2, 1 << 30), "\x02", 3)
        deeper = nested.select(parts[2].alias("term")).where(F.col("term").startswith("T")).join(nested, "term", "left_anti")
        if deeper.isEmpty():
            break
        nested = nested.unionByName(deeper.distinct())
    swap = lambda c: F.when(c.startswith("T"), named(c)).otherwise(c)
    told = nested.select(named(F.col("term")).alias("s"), F.explode(F.arrays_zip(F.array(*[F.lit(t.iri(t.RDF + x)) for x in ("ttSubject", "ttPredicate", "ttObject")]).alias("p"), parts.alias("o"))).alias("x"))
    return quads.withColumn("o", swap(F.col("o"))).unionByName(told.select("s", "x.p", swap(F.col("x.o")).alias("o"), F.lit(None).cast("string").alias("g")))
