"""Property paths and closures as joins and semi-naive loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import iri
from ..plans import algebra as A
from ..shared import settle


def closure(edges: DataFrame, seeds: DataFrame | None = None, reflexive: bool = False, most: int | None = None) -> DataFrame:
    """(src, dst[, hops]) pairs joined by one or more edges (src, dst), from the nodes in seeds (column src) or from all.

    Each round joins only what was new in the last one and drops what is known, so cycles end. Rounds are written to the
    shared folder. With reflexive, each seed (or node) also reaches itself. hops is the fewest edges.
    """
    start = edges if seeds is None else edges.join(seeds.select("src").distinct(), "src", "left_semi")
    hops = 1
    new = settle(start.select("src", "dst").distinct().withColumn("hops", F.lit(1)), "closure")
    known = new
    steps = edges.select(F.col("src").alias("_mid"), F.col("dst").alias("_next"))
    while (most is None or hops < most) and not new.isEmpty():
        hops += 1
        reached = new.join(steps, F.col("dst") == F.col("_mid")).select("src", F.col("_next").alias("dst")).distinct()
        new = settle(reached.join(known, ["src", "dst"], "left_anti").withColumn("hops", F.lit(hops)), "closure")
        known = known.unionByName(new)
        if hops % 8 == 0:
            known = settle(known, "closure")
    if reflexive:
        nodes = seeds.select("src").distinct() if seeds is not None else edges.select("src").union(edges.select(F.col("dst").alias("src"))).distinct()
        own = nodes.select("src", F.col("src").alias("dst"), F.lit(0).alias("hops"))
        known = own.unionByName(known.where("src <> dst"))
    return known


def pairs(path, ctx, source: str | None = None, target: str | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """(src, dst) of a path in the active graph: a bag for steps, sequences and alternatives, a set for closures.

    A constant end seeds a closure: from the source forwards, or from the target backwards.
    """
    if isinstance(path, A.Link):
        return ctx.active(path.iri).where(F.col("p") == iri(path.iri)).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    if isinstance(path, A.Inverse):
        return pairs(path.path, ctx, target, source).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if isinstance(path, A.Alt):
        out = pairs(path.parts[0], ctx)
        for p in path.parts[1:]:
            out = out.unionByName(pairs(p, ctx))
        return out
    if isinstance(path, A.Seq):
        out = pairs(path.parts[0], ctx)
        for p in path.parts[1:]:
            step = pairs(p, ctx).select(F.col("src").alias("_mid"), F.col("dst").alias("_next"))
            out = out.join(step, F.col("dst") == F.col("_mid")).select("src", F.col("_next").alias("dst"))
        return out
    quads = ctx.active()
    if isinstance(path, A.Negated):
        out = None
        if path.forward or not path.backward:
            out = quads.where(~F.col("p").isin([iri(x) for x in path.forward])).select(F.col("s").alias("src"), F.col("o").alias("dst"))
        if path.backward:
            back = quads.where(~F.col("p").isin([iri(x) for x in path.backward])).select(F.col("o").alias("src"), F.col("s").alias("dst"))
            out = back if out is None else out.unionByName(back)
        return out
    edges = pairs(path.path, ctx).distinct()
    if source is None and target is not None:
        back = closure_of(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), path, target, quads, ctx)
        return back.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure_of(edges, path, source, quads, ctx, seeds)


def closure_of(edges: DataFrame, path: A.Closure, source: str | None, quads: DataFrame, ctx, seeds: DataFrame | None = None) -> DataFrame:
    seeds = seeds if source is None else ctx.spark.createDataFrame([(source,)], "src string")
    out = closure(edges, seeds, most=path.high).select("src", "dst")
    if path.low == 0:
        nodes = seeds if seeds is not None else quads.select(F.col("s").alias("src")).union(quads.select(F.col("o").alias("src"))).distinct()
        out = out.where("src <> dst").unionByName(nodes.select("src", F.col("src").alias("dst")))
    return out


def reachable(edges: DataFrame, source, target) -> bool:
    """Whether target is reached from source; stops in the round that finds it."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    new = spark.createDataFrame([(source,)], f"src {kind}")
    known = new
    while not new.isEmpty():
        new = settle(edges.join(new, "src").select(F.col("dst").alias("src")).distinct().join(known, "src", "left_anti"), "reach")
        if not new.where(F.col("src") == F.lit(target)).isEmpty():
            return True
        known = settle(known.unionByName(new), "reach")
    return source == target


def lists(quads: DataFrame, first: str, rest: str, nil: str) -> DataFrame:
    """(head, members) of every RDF list that ends in nil; heads are those that no other cell's rest names."""
    cells = quads.where(F.col("p") == first).select(F.col("s").alias("cell"), F.col("o").alias("item"))
    links = quads.where(F.col("p") == rest).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    heads = cells.join(links.select(F.col("dst").alias("cell")), "cell", "left_anti").select(F.col("cell").alias("src"))
    walk = closure(links, heads, reflexive=True)
    ended = walk.where(F.col("dst") == nil).select("src").distinct()
    items = walk.join(cells, F.col("dst") == F.col("cell")).join(ended, "src", "left_semi")
    return items.groupBy(F.col("src").alias("head")).agg(F.transform(F.sort_array(F.collect_list(F.struct("hops", "item"))), lambda x: x["item"]).alias("members"))
