from tessera.operators.update import GraphStore
from tessera.sources import rdf
from tessera.streaming import feeds

SCHEMA = "s string, p string, o string, g string, change int, version int"


def test_a_closure_goes_on_after_a_restart(spark, tmp_path):
    folder, target, checkpoint = (f"file://{tmp_path}/{x}" for x in ("deltas", "closure", "checkpoint"))
    edges, number = set(), 0
    for added, gone in ([("a", "b"), ("b", "c")], []), ([("c", "d")], []), ([("x", "a")], [("b", "c")]), ([("d", "x")], []):
        rows = [(f"I{s}", "Ip", f"I{o}", None, change, number) for change, part in ((1, added), (-1, gone)) for s, o in part]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        # a query of its own each time: nothing is left in memory of the one before
        feeds.maintained_closure(feeds.delta_feed(spark, folder), "Ip", target, checkpoint).awaitTermination()
        edges = edges - set(gone) | set(added)
        want = set(edges)
        while more := {(a, d) for a, b in want for c, d in want if b == c} - want:
            want |= more
        got = {(x.src[1:], x.dst[1:]) for x in spark.read.parquet(f"{target}/{number}").collect()}
        assert got == want, number
        number += 1


def test_a_batch_without_news_makes_no_version(spark, tmp_path):
    source = f"file://{tmp_path}/quads"
    spark.createDataFrame([("Ia", "Ip", "Ib", None), ("Ia", "Ip", "Ib", None)], rdf.QUADS).write.parquet(source)
    store = GraphStore(spark)
    for _ in range(2):  # two checkpoints: the same rows come twice
        feeds.ingest(spark.readStream.schema(rdf.QUADS).parquet(source), store).awaitTermination()
    assert store.quads().count() == 1 and store.heads["main"].number == 2
