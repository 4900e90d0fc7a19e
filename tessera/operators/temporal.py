"""Value-index shapes (range, as-of, last per series, interval overlap) and statistics, as plans over typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_range(df: DataFrame, column: str, low=None, high=None, low_included: bool = True, high_included: bool = False) -> DataFrame:
    """Rows in a window of values; plain comparisons, so they reach the scan and its row-group statistics."""
    c = F.col(column)
    if low is not None:
        df = df.where(c >= F.lit(low) if low_included else c > F.lit(low))
    if high is not None:
        df = df.where(c <= F.lit(high) if high_included else c < F.lit(high))
    return df


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, take: list[str]) -> DataFrame:
    """left with the columns `take` of the latest row of right of the same keys at or before its instant, null if there is none.

    Both sides meet in one window over keys and instant, so nothing is joined pair by pair. Of right rows at one instant
    the largest by `take` counts.
    """
    a = left.select(*[F.col(f"`{c}`") for c in left.columns], F.lit(1).alias("_side"), F.lit(None).alias("_v"))
    packed = F.struct(*[F.col(f"`{c}`") for c in take])
    b = right.select(*[F.col(f"`{c}`") for c in [*keys, at]], F.lit(0).alias("_side"), packed.alias("_v"))
    w = Window.partitionBy(*keys).orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_found", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"_found.`{c}`").alias(c) for c in take])


def last_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each series, by aggregation: one row for each key and task is shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def bitemporal(df: DataFrame, keys: list[str], valid: tuple[str, str], known: tuple[str, str], valid_at, known_at) -> DataFrame:
    """Rows valid at one instant as known at another; open ends are null."""
    for (start, end), instant in ((valid, valid_at), (known, known_at)):
        df = df.where((F.col(start) <= F.lit(instant)) & (F.col(end).isNull() | (F.col(end) > F.lit(instant))))
    return df


def overlaps(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], bin_seconds: int) -> DataFrame:
    """Pairs of half-open intervals that overlap: an equi-join on time bins, each pair kept in the first bin that both touch."""

    def binned(df: DataFrame, ends: tuple[str, str], name: str) -> DataFrame:
        first, last = (F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (bin_seconds * 1_000_000)) for c in ends)
        return df.withColumn(f"_{name}0", first).withColumn("_bin", F.explode(F.sequence(first, last)))

    met = binned(left, a, "l").join(binned(right, b, "r"), "_bin")
    return met.where((F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])) & (F.col("_bin") == F.greatest("_l0", "_r0"))).drop("_bin", "_l0", "_r0")


def statistics(quads: DataFrame) -> DataFrame:
    return quads.agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("p").alias("predicates"), F.count_distinct("o").alias("objects"))


def key_statistics(df: DataFrame, key: str) -> DataFrame:
    """Mean, largest and degree-weighted mean number of rows of a key."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.avg("n").alias("mean"), F.max("n").alias("most"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("weighted"))


def state_hash(quads: DataFrame) -> DataFrame:
    """An order-free digest of a set of quads: count, xor and sum of their hashes."""
    h = F.xxhash64("s", "p", "o", F.coalesce("g", F.lit("")))
    return quads.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"))
