"""Scans of quads: by pattern, by many subjects or objects, through visibility filters; and the stored layout."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import QUADS


def match(quads: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Quads with the given terms; None matches anything."""
    for name, term in (("s", s), ("p", p), ("o", o)):
        if term is not None:
            quads = quads.where(F.col(name) == F.lit(term))
    return quads


def match_many(quads: DataFrame, terms: DataFrame, place: str, **bound: str) -> DataFrame:
    """Quads whose subject, predicate or object (`place`) is in a table of terms (its first column). The plan's own
    statistics decide whether that table is broadcast."""
    wanted = terms.select(F.col(terms.columns[0]).alias(place)).distinct()
    return match(quads, **bound).join(wanted, place, "left_semi")


@dataclass(frozen=True)
class View:
    """Quads seen through filters, such as the decisions for one access context; filters are conditions, so they are pushed down."""

    quads: DataFrame
    filters: tuple[Callable[[], Column], ...] = ()

    def where(self, condition: Callable[[], Column]) -> "View":
        return View(self.quads, (*self.filters, condition))

    def scan(self) -> DataFrame:
        out = self.quads
        for f in self.filters:
            out = out.where(F.coalesce(f(), F.lit(False)))
        return out


def allowed(quads: DataFrame, rules: DataFrame, context: str) -> DataFrame:
    """Quads that a context may see: rules are (context, g, p, allow), null being any; a denial wins, without a rule nothing is seen."""
    mine = rules.where(F.col("context") == context).select(F.col("g").alias("_g"), F.col("p").alias("_p"), "allow")
    keys = quads.select(F.coalesce("g", F.lit("")).alias("_kg"), F.col("p").alias("_kp")).distinct()
    met = keys.join(mine, (F.col("_g").isNull() | (F.col("_g") == F.col("_kg"))) & (F.col("_p").isNull() | (F.col("_p") == F.col("_kp"))))
    seen = met.groupBy("_kg", "_kp").agg(F.min("allow").alias("ok")).where("ok")
    return quads.join(seen, (F.coalesce("g", F.lit("")) == F.col("_kg")) & (F.col("p") == F.col("_kp")), "left_semi")


def store(quads: DataFrame, path: str) -> None:
    """The stored layout: a folder for each predicate, rows sorted by subject within files, so that patterns prune files and row groups."""
    quads.repartition("p", F.pmod(F.xxhash64("s"), F.lit(16))).sortWithinPartitions("p", "s", "o").write.partitionBy("p").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUADS).parquet(path).select("s", "p", "o", "g")
