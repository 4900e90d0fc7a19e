"""Graph analytics over edge tables (src, dst), as DataFrame loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import iri
from ..shared import settle
from .paths import closure


def project(quads: DataFrame, predicates: list[str] | None = None, direction: str = "forward") -> DataFrame:
    """Edges of the triples with these predicates (all if None): forward, reverse or undirected (both ways, once each)."""
    rows = quads if predicates is None else quads.where(F.col("p").isin([iri(p) for p in predicates]))
    forward = rows.select(F.col("s").alias("src"), F.col("o").alias("dst"))
    if direction == "forward":
        return forward
    back = forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return back if direction == "reverse" else forward.unionByName(back).where("src <> dst").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, smaller end first, without loops and repeats."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degree(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(node, degree): out, in, or undirected (an edge counts at both ends); nodes without edges of that kind are not listed."""
    if direction == "undirected":
        ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    else:
        ends = edges.select(F.col("src" if direction == "out" else "dst").alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_distribution(edges: DataFrame, direction: str = "out") -> DataFrame:
    if direction == "undirected":
        raise ValueError("a distribution of undirected degrees is not defined")
    return degree(edges, direction).groupBy("degree").agg(F.count(F.lit(1)).alias("count"))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """(node, rank) by power iteration; ranks sum to 1, that of nodes without out-edges is shared by all."""
    if not 0 < damping < 1 or iterations < 1:
        raise ValueError("damping lies between 0 and 1, and there is an iteration at least")
    edges = settle(edges.select("src", "dst").distinct(), "pagerank")
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    all_nodes = settle(nodes(edges).join(out.withColumnRenamed("src", "node"), "node", "left"), "pagerank")
    total = all_nodes.count()
    if not total:
        return all_nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = all_nodes.select("node", "n", F.lit(1.0 / total).alias("rank"))
    for k in range(iterations):
        lost = ranks.where("n IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        shares = edges.join(ranks.select(F.col("node").alias("src"), (F.col("rank") / F.col("n")).alias("share")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("in"))
        ranks = settle(all_nodes.join(shares, "node", "left").select("node", "n", (F.lit((1 - damping) / total + damping * lost / total) + F.lit(damping) * F.coalesce("in", F.lit(0.0))).alias("rank")), "pagerank")
    return ranks.select("node", "rank")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reached over edges in either direction, by label and pointer jumps."""
    both = settle(both_ways(edges).distinct(), "components")
    labels = settle(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component"), F.lit(True).alias("changed")), "components")
    while not labels.where("changed").isEmpty():
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.select("node", F.col("component").alias("old")).join(near, "node").select("node", "old", F.least("old", "near").alias("via"))
        jumped = hooked.join(labels.select(F.col("node").alias("via"), F.col("component").alias("far")), "via")
        labels = settle(jumped.select("node", F.least("via", "far").alias("component"), (F.least("via", "far") != F.col("old")).alias("changed")), "components")
    return labels.select("node", "component")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that reaches it and is reached from it.

    Colours spread forwards to a fixpoint; what reaches a colour's own node backwards within the colour is its component,
    which then leaves the graph.
    """
    left = settle(edges.select("src", "dst").distinct(), "scc")
    everyone = settle(nodes(left), "scc")
    done = everyone.select("node", F.col("node").alias("component")).where(F.lit(False))
    remaining = everyone
    while not remaining.isEmpty():
        colour = settle(remaining.select("node", F.col("node").alias("c")), "scc")
        while True:
            better = left.join(colour.select(F.col("node").alias("src"), "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("b"))
            new = settle(colour.join(better, "node", "left").select("node", F.least("c", F.coalesce("b", "c")).alias("c"), (F.coalesce("b", "c") < F.col("c")).alias("moved")), "scc")
            moved = not new.where("moved").isEmpty()
            colour = new.select("node", "c")
            if not moved:
                break
        inner = left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("c2")), "dst").where("c1 = c2")
        back = settle(inner.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.col("c1").alias("c")), "scc")
        found = settle(colour.where("node = c"), "scc")
        frontier = found
        while not frontier.isEmpty():
            reached = back.join(frontier.select(F.col("node").alias("from")), "from").select(F.col("to").alias("node"), "c").distinct()
            frontier = settle(reached.join(found, "node", "left_anti"), "scc")
            found = settle(found.unionByName(frontier), "scc")
        done = done.unionByName(found.select("node", F.col("c").alias("component")))
        remaining = settle(remaining.join(found, "node", "left_anti"), "scc")
        left = settle(left.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti"), "scc")
    return done


def core_numbers(edges: DataFrame) -> DataFrame:
    """(node, core): the largest k such that the node is in a subgraph of degree k, by repeated h-indices of neighbours."""
    both = settle(both_ways(undirected(edges)), "core")
    cores = settle(both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("core")), "core")
    while True:
        near = both.join(cores.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "core").agg(F.count(F.lit(1)).alias("n"))
        from pyspark.sql import Window

        at_least = near.withColumn("at_least", F.sum("n").over(Window.partitionBy("node").orderBy(F.desc("core"))))
        h = at_least.groupBy("node").agg(F.max(F.least("core", "at_least")).alias("h"))
        new = settle(cores.join(h, "node").select("node", F.least("core", "h").alias("core"), (F.col("h") < F.col("core")).alias("moved")), "core")
        if new.where("moved").isEmpty():
            return new.select("node", "core")
        cores = new.select("node", "core")


def shortest_lengths(edges: DataFrame, source) -> DataFrame:
    """(node, length) of everything reached from source; a source that isn't in the graph reaches itself alone."""
    seeds = edges.sparkSession.createDataFrame([(source,)], f"src {edges.schema['src'].dataType.simpleString()}")
    return closure(edges, seeds, reflexive=True).select(F.col("dst").alias("node"), F.col("hops").alias("length"))


def shortest_path(edges: DataFrame, source, target) -> list | None:
    """The nodes of a shortest path (of several, the one with the smallest parents), or None."""
    kind = edges.schema["src"].dataType.simpleString()
    spark = edges.sparkSession
    seen = settle(spark.createDataFrame([(source, None)], f"node {kind}, parent {kind}"), "bfs")
    frontier = seen
    while not frontier.isEmpty():
        if not frontier.where(F.col("node") == F.lit(target)).isEmpty():
            path, at = [target], target
            while at != source:
                at = seen.where(F.col("node") == F.lit(at)).first()["parent"]
                path.append(at)
            return path[::-1]
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        frontier = settle(step.join(seen, "node", "left_anti"), "bfs")
        seen = settle(seen.unionByName(frontier), "bfs")
    return None


def _oriented(edges: DataFrame) -> DataFrame:
    """Undirected edges from the end of smaller degree to the other, which bounds the work of triangles and cliques."""
    once = settle(undirected(edges), "oriented")
    d = degree(once, "undirected")
    joined = once.join(d.select(F.col("node").alias("src"), F.col("degree").alias("d1")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("d2")), "dst")
    first = (F.col("d1") < F.col("d2")) | ((F.col("d1") == F.col("d2")) & (F.col("src") < F.col("dst")))
    return settle(joined.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("dst")), "oriented")


def cliques(edges: DataFrame, size: int) -> DataFrame:
    """(v0 … vk) of every clique of that size once, in degree order."""
    if size < 2:
        raise ValueError("a clique has two nodes at least")
    e = _oriented(edges)
    out = e.select(F.col("src").alias("v0"), F.col("dst").alias("v1"))
    for k in range(2, size):
        out = out.join(e.select(F.col("src").alias(f"v{k - 1}"), F.col("dst").alias(f"v{k}")), f"v{k - 1}")
        for j in range(k - 1):
            out = out.join(e.select(F.col("src").alias(f"v{j}"), F.col("dst").alias(f"v{k}")), [f"v{j}", f"v{k}"], "left_semi")
    return out.select(*[f"v{k}" for k in range(size)])


def triangle_count(edges: DataFrame) -> DataFrame:
    return cliques(edges, 3).agg(F.count(F.lit(1)).alias("count"))


def local_clustering(edges: DataFrame) -> DataFrame:
    """(node, triangles, clustering): closed pairs of neighbours over all pairs; 0 where there are none."""
    corners = cliques(edges, 3).select(F.explode(F.array("v0", "v1", "v2")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    d = degree(undirected(edges), "undirected")
    wedges = F.col("degree") * (F.col("degree") - 1) / 2
    t = F.coalesce("triangles", F.lit(0))
    return d.join(corners, "node", "left").select("node", t.alias("triangles"), F.when(wedges > 0, t / wedges).otherwise(F.lit(0.0)).alias("clustering"))


def global_clustering(edges: DataFrame) -> DataFrame:
    """(clustering): three times the triangles over the wedges."""
    wedges = degree(undirected(edges), "undirected").agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("w"))
    return triangle_count(edges).crossJoin(F.broadcast(wedges)).select(F.when(F.col("w") > 0, 3 * F.col("count") / F.col("w")).otherwise(F.lit(0.0)).alias("clustering"))


def _folded(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges both ways of the rest, rest with its weights, leaves): nodes of one neighbour hang on it.

    The rest are (node, leaves, weight): a node stands for itself and its leaves. Leaves are (node, at). Of two nodes that
    are each other's only neighbour the smaller one stays.
    """
    both = settle(both_ways(undirected(edges)), "folded")
    single = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("at"), F.count(F.lit(1)).alias("n")).where("n = 1").select("node", "at")
    pairs = single.join(single.select(F.col("node").alias("at"), F.lit(True).alias("twin")), "at", "left")
    leaves = settle(pairs.where("twin IS NULL OR node > at").select("node", "at"), "folded")
    inner = both.join(leaves.select(F.col("node").alias("src")), "src", "left_anti")
    counts = leaves.groupBy(F.col("at").alias("node")).agg(F.count(F.lit(1)).alias("leaves"))
    rest = inner.select(F.col("src").alias("node")).distinct().join(counts, "node", "left").select("node", F.coalesce("leaves", F.lit(0)).alias("leaves"))
    core = inner.join(leaves.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    return settle(core, "folded"), settle(rest.withColumn("weight", F.col("leaves") + 1), "folded"), leaves


def _walks(core: DataFrame, rest: DataFrame) -> DataFrame:
    """(src, dst, hops) of all pairs of the rest, each node with itself too."""
    own = rest.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("hops"))
    return settle(own.unionByName(closure(core).where("src <> dst").select("src", "dst", "hops")), "walks")


def closeness(edges: DataFrame) -> DataFrame:
    """(node, closeness): nodes reached over the sum of their distances.

    Pairs are walked between nodes that are no leaves; a leaf is one step from its node, and all it reaches one step further.
    """
    core, rest, leaves = _folded(edges)
    far = _walks(core, rest).join(rest.select(F.col("node").alias("dst"), "leaves", "weight"), "dst")
    sums = far.groupBy(F.col("src").alias("node")).agg((F.sum("weight") - 1).alias("n"), F.sum(F.col("hops") * F.col("weight") + F.col("leaves")).alias("d"))
    sums = settle(sums, "closeness")
    hung = leaves.join(sums.withColumnRenamed("node", "at"), "at").select("node", "n", (F.col("d") + F.col("n") - 1).alias("d"))
    return sums.unionByName(hung).where("d > 0").select("node", (F.col("n") / F.col("d")).alias("closeness"))


def betweenness(edges: DataFrame) -> DataFrame:
    """(node, betweenness), unnormalised, each pair of ends once: counted paths outwards, dependencies added back level by level.

    Leaves are no one's way; they count at their node as ends of paths, which all pass through it.
    """
    both, rest, leaves = _folded(edges)
    walk = _walks(both, rest).select(F.col("src").alias("root"), F.col("dst").alias("node"), "hops")
    deepest = walk.agg(F.max("hops")).first()[0] or 0
    weights = rest.select("node", "weight")
    steps = both.select(F.col("src").alias("node"), F.col("dst").alias("next")).join(weights.withColumnRenamed("node", "next"), "next")
    ahead = walk.select("root", F.col("node").alias("next"), (F.col("hops") - 1).alias("hops"))
    dag = settle(walk.join(steps, "node").join(ahead, ["root", "next", "hops"]).select("root", "node", "next", "hops", "weight"), "between")
    sigma = settle(walk.where("hops = 0").select("root", "node", F.lit(1.0).alias("sigma")), "between")
    levels = [sigma]
    for k in range(deepest):
        sigma = settle(dag.where(F.col("hops") == k).join(sigma, ["root", "node"]).groupBy("root", F.col("next").alias("node")).agg(F.sum("sigma").alias("sigma")), "between")
        levels.append(sigma)
    delta = levels[deepest].select("root", "node", "sigma", F.lit(0.0).alias("delta"))
    total = None
    for k in range(deepest - 1, -1, -1):
        below = delta.select("root", F.col("node").alias("next"), "sigma", "delta")
        share = (F.col("weight") + F.col("delta")) / F.col("sigma")
        gained = dag.where(F.col("hops") == k).join(below, ["root", "next"]).groupBy("root", "node").agg(F.sum(share).alias("g"))
        delta = settle(levels[k].join(gained, ["root", "node"], "left").select("root", "node", "sigma", (F.col("sigma") * F.coalesce("g", F.lit(0.0))).alias("delta")), "between")
        if k:
            total = delta if total is None else total.unionByName(delta)
    # pairs of a node's own leaves, and of a leaf and a node beyond
    size = walk.join(weights, "node").groupBy(F.col("root").alias("node")).agg(F.sum("weight").alias("all"))
    own = rest.join(size, "node").select("node", (F.col("leaves") * (F.col("all") - F.col("weight")) + F.col("leaves") * (F.col("leaves") - 1) / 2).alias("own"))
    if total is not None:
        weighed = total.join(rest.select(F.col("node").alias("root"), "weight"), "root")
        sums = weighed.groupBy("node").agg((F.sum(F.col("delta") * F.col("weight")) / 2).alias("b"))
        own = own.join(sums, "node", "left").select("node", (F.col("own") + F.coalesce("b", F.lit(0.0))).alias("own"))
    found = own.select("node", F.col("own").alias("betweenness"))
    return found.unionByName(leaves.select("node", F.lit(0.0).alias("betweenness")))


def eigenvector(edges: DataFrame, iterations: int = 50) -> DataFrame:
    """(node, centrality) of unit length, by power iteration on the undirected graph shifted by one, so that it settles."""
    both = settle(both_ways(undirected(edges)), "eigen")
    at = settle(nodes(both).withColumn("x", F.lit(1.0)), "eigen")
    for _ in range(iterations):
        pulled = both.join(at.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("x").alias("y"))
        new = settle(at.join(pulled, "node").select("node", (F.col("x") + F.col("y")).alias("x")), "eigen")
        norm = new.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        at = new.select("node", (F.col("x") / F.lit(norm)).alias("x"))
    return at.withColumnRenamed("x", "centrality")


def fold(edges: DataFrame, values: DataFrame, combine=F.sum) -> DataFrame:
    """(node, value) of a DAG folded from the leaves: a node's own value and the combined values of its children."""
    left = settle(edges.select("src", "dst").distinct(), "fold")
    done = settle(values.join(left.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("node", "value"), "fold")
    pending = settle(values.join(done, "node", "left_anti"), "fold")
    while not pending.isEmpty():
        blocked = left.join(pending.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        ready = pending.join(blocked, "node", "left_anti")
        children = left.join(done.select(F.col("node").alias("dst"), F.col("value").alias("v")), "dst").groupBy(F.col("src").alias("node")).agg(combine("v").alias("v"))
        new = settle(ready.join(children, "node", "left").select("node", (F.col("value") + F.coalesce("v", F.lit(0))).alias("value")), "fold")
        if new.isEmpty():
            raise ValueError("the graph has a cycle")
        done = settle(done.unionByName(new), "fold")
        pending = settle(pending.join(new, "node", "left_anti"), "fold")
    return done


# generators
def path_graph(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(max(n - 1, 0)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def cycle_graph(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))


def tree_graph(spark: SparkSession, n: int, arity: int = 2) -> DataFrame:
    return spark.range(1, n).select(F.floor((F.col("id") - 1) / arity).alias("src"), F.col("id").alias("dst"))


def complete_graph(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n))).alias("dst")).where(F.col("dst") < n).where("dst > src")


def grid_graph(spark: SparkSession, width: int, height: int) -> DataFrame:
    cells = spark.range(width * height)
    right = cells.where((F.col("id") + 1) % width != 0).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return right.unionByName(cells.where(F.col("id") < width * (height - 1)).select(F.col("id").alias("src"), (F.col("id") + width).alias("dst")))


def random_graph(spark: SparkSession, n: int, p: float, seed: int = 0) -> DataFrame:
    """Erdős–Rényi: each pair is an edge with probability p, decided by a hash of the pair, so the graph is the same every time."""
    cut = int(p * (1 << 30))
    return complete_graph(spark, n).where(F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1 << 30)) < cut)


def small_world(spark: SparkSession, n: int, k: int, p: float, seed: int = 0) -> DataFrame:
    """Watts–Strogatz: a ring joined to k/2 neighbours on each side, where an edge moves its far end with probability p."""
    ring = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("j"))
    h = F.pmod(F.xxhash64("src", "j", F.lit(seed)), F.lit(1 << 30))
    moved = F.pmod(F.xxhash64("src", "j", F.lit(seed + 1)), F.lit(n))
    return ring.select("src", F.when(h < int(p * (1 << 30)), moved).otherwise((F.col("src") + F.col("j")) % n).alias("dst")).where("src <> dst").distinct()


def preferential(spark: SparkSession, n: int, m: int, seed: int = 0) -> DataFrame:
    """Barabási–Albert: each new node links to m ends drawn from the ends so far; inherently sequential, so on the driver."""
    import random

    r, ends, out = random.Random(seed), list(range(m)), []
    for v in range(m, n):
        chosen = set()
        while len(chosen) < m:
            chosen.add(r.choice(ends))
        out += [(v, u) for u in chosen]
        ends += [*chosen, *[v] * m]
    return spark.createDataFrame(out, "src long, dst long")


# as SERVICE endpoints
ENDPOINT = "urn:tessera:analytics:"


def services() -> dict:
    """Endpoints for SERVICE: ``urn:tessera:analytics:pagerank?damping=0.85&predicate=…``; rows come back under their names."""

    def edges(ctx, options: dict, direction: str = "forward") -> DataFrame:
        predicates = options.get("predicate")
        return project(ctx.active(), predicates.split(",") if predicates else None, options.get("direction", direction))

    def run(function):
        return lambda ctx, pattern, **options: function(edges(ctx, options), options)

    found = {
        "degree": lambda e, o: degree(e, o.get("kind", "out")), "degree-distribution": lambda e, o: degree_distribution(e, o.get("kind", "out")),
        "pagerank": lambda e, o: pagerank(e, float(o.get("damping", 0.85)), int(o.get("iterations", 20))), "components": lambda e, o: components(e),
        "strong-components": lambda e, o: strong_components(e), "k-core": lambda e, o: core_numbers(e), "triangle-count": lambda e, o: triangle_count(e),
        "global-clustering": lambda e, o: global_clustering(e), "local-clustering": lambda e, o: local_clustering(e), "cliques": lambda e, o: cliques(e, int(o.get("size", 3))),
        "closeness": lambda e, o: closeness(e), "betweenness": lambda e, o: betweenness(e), "eigenvector": lambda e, o: eigenvector(e, int(o.get("iterations", 50))),
        "shortest-paths": lambda e, o: shortest_lengths(e, iri(o["source"])),
    }
    return {ENDPOINT + name: run(f) for name, f in found.items()}
