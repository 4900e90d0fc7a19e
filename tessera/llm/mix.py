"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Weights that the sources, in order of their names, take in turn.
WEIGHTS = (1, 2, 3)
#: A source's target, and a document's taken words, are at most so many times their size.
CAP = 3
#: How a source's weight changes while training goes from 0 to 1, as (time, factor) knots; sources take them in turn.
#: Only the shape counts: each is scaled to an integral of 1, so the weights above are what a source gets overall.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.7, 1.0), (1.0, 1.9)))
#: Hash ranges that split each source for prefix sums, so that no task sees a whole source.
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size); n numbers the sources by code point, null last.

    Shares of the total by weight, where none exceeds cap times its source: with the sources ordered by cap / weight,
    those before the first that its level doesn't fill are capped, and that level holds for the rest. The table has a
    row for each source, so one task orders it.
    """
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int")).cast("long")
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("most") / F.col("weight"), F.col("n")).rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * cap)
    )
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(ordered), F.lit(0))).cast("double") / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ordered), F.lit(0))
    ).cast("double")
    leveled = numbered.withColumn("level", level).withColumn("full", F.col("level") > F.col("most") / F.col("weight"))
    first_open = F.max(F.when(~F.col("full"), F.struct(-F.col("most") / F.col("weight"), -F.col("n"), F.col("level")))).over(everything)["level"]
    return leveled.withColumn("open_level", first_open).select(
        "source",
        "source_size",
        "n",
        F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("open_level") * F.col("weight"))).alias("target"),
    )


def demand_inverse(knots: Sequence[tuple[float, float]], share: Column) -> Column:
    """The time at which a source has got that share of its words: the inverse of the integral of its weight."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    total, done, out = sum(areas), 0.0, None
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
        rest = (share - F.lit(done / total)) * F.lit(total)
        slope = (w1 - w0) / (t1 - t0)
        if slope:
            time = F.lit(t0) + (F.sqrt(F.greatest(F.lit(w0 * w0) + rest * F.lit(2 * slope), F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
        else:
            time = F.lit(t0) + rest / F.lit(w0)
        done += area
        out = F.when(share < F.lit(done / total), time) if out is None else out.when(share < F.lit(done / total), time)
    return F.least(F.greatest(out.otherwise(F.lit(knots[-1][0])), F.lit(knots[0][0])), F.lit(knots[-1][0]))


def plan_mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    whole: bool = False,
    id_col: str = "doc_id",
    keep: Sequence[Column] = (),
) -> DataFrame:
    """What the mix takes of every row, range-sorted by the training position of its first copy.

    Returns id, source, size, source_size, target, taken, positions (of each copy, from 0 to 1) and the columns `keep`.
    A source's documents stand in hash order on a line as long as its words; the mix reads along that line until it has
    the target, again from the start when it comes to the end. So each document is taken floor(target / source_size)
    times, and once more, or in part, before the point where the target is met. With `whole`, that last document is
    taken wholly if at least half of it lies before that point, else not; otherwise the words up to there are taken.

    Null text has size 0, a null source is a source of its own (the last), a null id is hashed as the empty string.
    Documents of size 0 are never taken and have no position; rows without a position come last. Repeated rows count
    and are taken each on their own. An empty table gives an empty result.
    """
    order = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    sized = cut(docs.select(F.col(id_col).alias("_id"), F.col("source"), word_count(F.col("text")).alias("size"), order.alias("_order"), *keep), "mix-sizes")
    sized = sized.withColumn("_range", F.shiftright("_order", 48))
    ranges = cut(sized.groupBy("source", "_range").agg(F.sum("size").alias("_range_size")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("_range_size").alias("source_size")), weights, cap)
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("_offset", F.coalesce(F.sum("_range_size").over(before), F.lit(0))).drop("_range_size")
    offsets, targets = offsets.withColumnRenamed("source", "_s").withColumnRenamed("_range", "_r"), targets.withColumnRenamed("source", "_s")
    inner = Window.partitionBy("source", "_range").orderBy("_order", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    line = (
        sized.withColumn("_inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .join(_with_targets(offsets, targets), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
        .drop("_s", "_r")
        .withColumn("_start", F.col("_offset") + F.col("_inner"))
    )
    goal = F.round(F.col("target")).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    passes = F.when(passes * F.col("source_size") > goal, passes - 1).otherwise(passes)
    line = line.withColumn("_goal", goal).withColumn("_passes", passes)
    rest = F.col("_goal") - F.col("_passes") * F.col("source_size") - F.col("_start")
    part = F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    if whole:
        part = F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    line = line.withColumn("_part", part).withColumn("taken", F.col("_passes") * F.col("size") + F.col("_part"))
    copies = F.when(F.col("size") > 0, F.col("_passes") + (F.col("_part") > 0).cast("long")).otherwise(F.lit(0))

    def position(copy: Column) -> Column:
        share = (copy * F.col("source_size") + F.col("_start") + F.col("size") / 2) / F.greatest(F.col("_goal"), F.lit(1))
        out = None
        for k, knots in enumerate(schedules):
            this = F.col("n") % len(schedules) == k
            out = F.when(this, demand_inverse(knots, share)) if out is None else out.when(this, demand_inverse(knots, share))
        return out

    line = line.withColumn("positions", F.when(copies > 0, F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), position)).otherwise(F.array().cast("array<double>")))
    kept = [c for c in sized.columns if c not in ("_id", "source", "size", "_order", "_range")]
    return line.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "taken", "positions", *kept).orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), id_col)


def _with_targets(offsets: DataFrame, targets: DataFrame) -> DataFrame:
    t = targets.withColumnRenamed("_s", "_t")
    return offsets.join(t, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The training stream: the rows of docs, each as often as the mix takes it, range-sorted by position.

    Takes whole documents only (see plan_mix). Rows that agree in id, source and text count each on their own in the
    plan; the stream then holds, for all of them together, as many copies of the first. Columns as in docs, whatever
    their names.
    """
    text_key = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    plan = plan_mix(docs, whole=True, id_col=id_col, keep=[text_key.alias("_text_key")], **options)
    positions = plan.groupBy(F.col(id_col).alias("_p1"), F.col("source").alias("_p2"), F.col("_text_key").alias("_p3")).agg(
        F.flatten(F.collect_list("positions")).alias("_positions")
    )
    positions = positions.where(F.size("_positions") > 0)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_k1"), F.col("source").alias("_k2"), text_key.alias("_k3"))
    same = F.col("_k1").eqNullSafe(F.col("_p1")) & F.col("_k2").eqNullSafe(F.col("_p2")) & (F.col("_k3") == F.col("_p3"))
    met = rows.join(positions, same)
    once = met.withColumn("_nth", F.row_number().over(Window.partitionBy("_k1", "_k2", "_k3").orderBy(F.lit(1)))).where("_nth = 1")
    stream = once.select("_row", F.explode("_positions").alias("_position"))
    return stream.repartitionByRange("_position").sortWithinPartitions("_position").selectExpr("_row.*")
