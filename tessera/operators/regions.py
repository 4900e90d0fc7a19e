"""Qualitative reasoning: RCC8 composition, EL classification, OWL profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import OWL, RDF, RDFS, iri
from ..shared import settle

# fixed values: the eight relations, and their composition table (row, then column, in this order; * is any relation)
RCC8 = ["dc", "ec", "po", "tpp", "ntpp", "tppi", "ntppi", "eq"]
_TABLE = """
*|dc ec po tpp ntpp|dc ec po tpp ntpp|dc ec po tpp ntpp|dc ec po tpp ntpp|dc|dc|dc
dc ec po tppi ntppi|dc ec po tpp tppi eq|dc ec po tpp ntpp|ec po tpp ntpp|po tpp ntpp|dc ec|dc|ec
dc ec po tppi ntppi|dc ec po tppi ntppi|*|po tpp ntpp|po tpp ntpp|dc ec po tppi ntppi|dc ec po tppi ntppi|po
dc|dc ec|dc ec po tpp ntpp|tpp ntpp|ntpp|dc ec po tpp tppi eq|dc ec po tppi ntppi|tpp
dc|dc|dc ec po tpp ntpp|ntpp|ntpp|dc ec po tpp ntpp|*|ntpp
dc ec po tppi ntppi|ec po tppi ntppi|po tppi ntppi|po tpp tppi eq|po tpp ntpp|tppi ntppi|ntppi|tppi
dc ec po tppi ntppi|po tppi ntppi|po tppi ntppi|po tppi ntppi|po tpp ntpp tppi ntppi eq|ntppi|ntppi|ntppi
dc|ec|po|tpp|ntpp|tppi|ntppi|eq
"""
_INVERSE = {"dc": "dc", "ec": "ec", "po": "po", "tpp": "tppi", "ntpp": "ntppi", "tppi": "tpp", "ntppi": "ntpp", "eq": "eq"}
ALL = (1 << 8) - 1


def mask(names: str) -> int:
    return ALL if names == "*" else reduce(lambda m, n: m | 1 << RCC8.index(n), names.split(), 0)


COMPOSITION = [[mask(cell) for cell in line.split("|")] for line in _TABLE.strip().split("\n")]


def compose(a: int, b: int) -> int:
    """The relations that may hold between x and z if one of a holds between x and y, and one of b between y and z."""
    return reduce(lambda m, x: m | x, (COMPOSITION[i][j] for i in range(8) if a >> i & 1 for j in range(8) if b >> j & 1), 0)


def inverse(a: int) -> int:
    return reduce(lambda m, i: m | (1 << RCC8.index(_INVERSE[RCC8[i]]) if a >> i & 1 else 0), range(8), 0)


def rcc8_closure(facts: DataFrame) -> DataFrame:
    """(a, b, relations) from such facts (relations as a bit mask): path consistency by joins; a mask of 0 is a contradiction."""
    spark = facts.sparkSession
    pairs = spark.createDataFrame([(a, b, compose(a, b)) for a in range(1, 256) for b in range(1, 256)], "m1 int, m2 int, m3 int")
    back = spark.createDataFrame([(a, inverse(a)) for a in range(256)], "relations int, i int")
    now = facts.select("a", "b", F.col("relations").cast("int").alias("relations"))
    flipped = now.join(F.broadcast(back), "relations").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("i").alias("relations"))
    now = settle(now.unionByName(flipped).where("a <> b").groupBy("a", "b").agg(F.bit_and("relations").alias("relations")), "rcc8")
    while True:
        x, y = now.select("a", F.col("b").alias("m"), F.col("relations").alias("m1")), now.select(F.col("a").alias("m"), "b", F.col("relations").alias("m2"))
        derived = x.join(y, "m").where("a <> b").join(F.broadcast(pairs), ["m1", "m2"]).select("a", "b", F.col("m3").alias("relations"))
        tight = now.unionByName(derived.where(f"relations <> {ALL}")).groupBy("a", "b").agg(F.bit_and("relations").alias("relations"))
        old = now.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("relations").alias("_r"))
        new = settle(tight.join(old, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left").select("a", "b", "relations", (F.col("_r").isNull() | (F.col("_r") != F.col("relations"))).alias("new")), "rcc8")
        now = new.select("a", "b", "relations")
        if new.where("new").isEmpty():
            return now


# EL: axioms over names, normalised to four shapes
def el_classify(axioms: list[tuple]) -> dict[str, set[str]]:
    """Superclasses of every named class, by saturation (ontologies are schema-sized, so this runs on the driver).

    Axioms: ("sub", C, D), ("and", (C1, C2), D), ("some", r, C, D): r some C below D, ("sub-some", C, r, D): C below
    r some D, ("role", r, s), ("chain", r, s, u). `⊥` below anything makes a class unsatisfiable.
    """
    names = {n for a in axioms for x in a[1:] for n in (x if isinstance(x, tuple) else (x,)) if a[0] not in ("role", "chain")}
    roles = {a[1] for a in axioms if a[0] in ("some", "role", "chain")} | {a[2] for a in axioms if a[0] == "sub-some"}
    names -= roles
    up = {n: {n, "⊤"} for n in names | {"⊤"}}
    links: set[tuple[str, str, str]] = set()
    changed = True
    while changed:
        changed = False
        for n in list(up):
            add = set()
            for a in axioms:
                if a[0] == "sub" and a[1] in up[n]:
                    add.add(a[2])
                elif a[0] == "and" and set(a[1]) <= up[n]:
                    add.add(a[2])
                elif a[0] == "sub-some" and a[1] in up[n] and (n, a[2], a[3]) not in links:
                    links.add((n, a[2], a[3]))
                    up.setdefault(a[3], {a[3], "⊤"})
                    changed = True
            if not add <= up[n]:
                up[n] |= add
                changed = True
        for x, r, y in list(links):
            for a in axioms:
                if a[0] == "role" and a[1] == r and (x, a[2], y) not in links:
                    links.add((x, a[2], y))
                    changed = True
                elif a[0] == "some" and a[1] == r and a[2] in up[y] and a[3] not in up[x]:
                    up[x].add(a[3])
                    changed = True
                elif a[0] == "chain" and a[1] == r:
                    for y2, s, z in list(links):
                        if y2 == y and s == a[2] and (x, a[3], z) not in links:
                            links.add((x, a[3], z))
                            changed = True
            if "⊥" in up[y] and "⊥" not in up[x]:
                up[x].add("⊥")
                changed = True
    return up


# fixed values: constructs that a profile has no place for, by local name
_OUTSIDE = {
    "EL": ["unionOf", "complementOf", "allValuesFrom", "maxCardinality", "minCardinality", "cardinality", "inverseOf", "FunctionalProperty", "InverseFunctionalProperty", "SymmetricProperty", "AsymmetricProperty", "IrreflexiveProperty"],
    "QL": ["oneOf", "hasValue", "allValuesFrom", "unionOf", "maxCardinality", "minCardinality", "cardinality", "TransitiveProperty", "FunctionalProperty", "InverseFunctionalProperty", "propertyChainAxiom", "hasKey", "sameAs"],
    "RL": ["minCardinality", "ReflexiveProperty", "disjointUnionOf"],
}


def profile_violations(triples: DataFrame) -> DataFrame:
    """(profile, construct, n): uses of constructs outside the OWL 2 profiles; a profile without a row holds."""
    rows = triples.select(F.explode(F.array("p", "o")).alias("x"), "p", "o").where((F.col("x") == F.col("p")) | (F.col("p") == iri(RDF + "type"))).where(F.col("x").startswith(iri(OWL)))
    counts = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    table = triples.sparkSession.createDataFrame([(p, iri(OWL + c)) for p, cs in _OUTSIDE.items() for c in cs], "profile string, x string")
    return counts.join(table, "x").select("profile", F.substring("x", len(iri(OWL)) + 1, 99).alias("construct"), "n")


def strategy(triples: DataFrame) -> str:
    """The least rule set that the constructs in use need: none, rdfs, rl, or dl for what RL has no rules for."""
    used = {r["x"] for r in triples.select(F.explode(F.array("p", "o")).alias("x")).where(F.col("x").startswith(iri(OWL)) | F.col("x").startswith(iri(RDFS))).distinct().limit(10_000).collect()}
    if any(x.startswith(iri(OWL)) for x in used):
        return "dl" if used & {iri(OWL + c) for c in _OUTSIDE["RL"]} else "rl"
    return "rdfs" if used & {iri(RDFS + x) for x in ("subClassOf", "subPropertyOf", "domain", "range")} else "none"
