"""Changes as streams: ingest, delta feeds and views kept up by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import QUADS
from ..operators.paths import closure
from ..operators.update import GraphStore, absent
from ..shared import fresh_path, settle

DELTA = QUADS + ", change int, version int"


def ingest(stream: DataFrame, store: GraphStore, world: str = "main", checkpoint: str | None = None) -> StreamingQuery:
    """Commits what each micro-batch of a stream of quads has that the store has not, as one version.

    A batch without news, such as one that is sent again after a restart, makes no version.
    """

    def commit(batch: DataFrame, number: int) -> None:
        news = settle(absent(batch.select("s", "p", "o", "g").distinct(), store.quads(world)), "ingest")
        if not news.isEmpty():
            store.insert(news, world)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint or fresh_path(store.spark, "ingest-checkpoint")).trigger(availableNow=True).start()


def publish(store: GraphStore, folder: str) -> None:
    """From now on each commit's delta is also written to a folder that delta_feed reads."""
    store.observers.append(lambda version, delta: delta.write.mode("append").parquet(folder))


def delta_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of changes (s, p, o, g, change, version) in commit order of files."""
    return spark.readStream.schema(DELTA).parquet(folder)


def maintained_closure(feed: DataFrame, predicate: str, target: str, checkpoint: str | None = None) -> StreamingQuery:
    """Keeps the transitive closure of a predicate's edges in a folder of versions, `target`/n, and the edges in `target`-edges/n.

    A batch of additions joins only what is new: paths that end or start in it. A batch with removals computes anew from
    the edges, as what is left cannot be told from the closure alone. A batch starts from the folders of the one before,
    so after a restart from the checkpoint, or when a batch is sent again, the result is the same.
    """
    spark, pairs = feed.sparkSession, "src string, dst string"

    def before(folder: str, number: int) -> DataFrame:
        return spark.read.schema(pairs).parquet(f"{folder}/{number - 1}") if number else spark.createDataFrame([], pairs)

    def apply(batch: DataFrame, number: int) -> None:
        changes = settle(batch.where(F.col("p") == predicate).select(F.col("s").alias("src"), F.col("o").alias("dst"), "change"), "feed")
        added, gone = changes.where("change = 1").select("src", "dst"), changes.where("change = -1").select("src", "dst")
        before(f"{target}-edges", number).join(gone, ["src", "dst"], "left_anti").unionByName(added).distinct().write.mode("overwrite").parquet(f"{target}-edges/{number}")
        edges, known = spark.read.schema(pairs).parquet(f"{target}-edges/{number}"), before(target, number)
        if not number or not gone.isEmpty():
            new = closure(edges).select("src", "dst")
        else:
            into = added.unionByName(known.join(added.select(F.col("src").alias("dst"), F.col("dst").alias("_n")), "dst").select("src", F.col("_n").alias("dst"))).distinct()
            both = settle(into.unionByName(added).distinct(), "feed")
            through = closure(known.unionByName(both).distinct(), both.select("src")).select("src", "dst")
            new = known.unionByName(through).distinct()
        new.write.mode("overwrite").parquet(f"{target}/{number}")

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint or fresh_path(spark, "closure-checkpoint")).trigger(availableNow=True).start()
