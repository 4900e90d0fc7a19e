"""Substring deduplication over a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KEY, KEY_TYPES, blocks, cut, delete_path, flat, fresh_path, mix, renamed_key, row_key, same_row, thrifty, word_hashes, word_spans

#: Words of a window; every window whose words stand earlier too is removed.
WINDOW = 20
#: Words of the short sequences of which the one with the smallest hash anchors a window.
GRAM = 6
#: Batches that a table is dealt into by id for op3, each of which adds a run to the index.
BATCHES = 3
#: Runs of an index from which on they are compacted to one.
FAN_IN = 2

#: Seeds of the two hashes of a word, and steps that bind a word to its place.
_SEEDS = (0x9E6C63D0676A9A99, 0xC2B2AE3D27D4EB4F)
_STEPS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))


def _rolled(hashes: np.ndarray, n: int, step: np.uint64) -> np.ndarray:
    """The hash of the n words from each word on."""
    size = max(len(hashes) - n + 1, 0)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * step + hashes[k : k + size]
    return mix(out)


def _smallest(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of the n values from each place on, and the first place where it stands."""
    place, width = np.arange(len(x)), 1
    while width < n:
        step = min(width, n - width)
        later = x[step:] < x[:-step]
        x, place = np.where(later, x[step:], x[:-step]), np.where(later, place[step:], place[:-step])
        width += step
    return x, place


def _settled(what: tuple[np.ndarray, ...], row: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(order, sure): the entries by `what` and `row`, and which are equal in `what` to an earlier one of another row.

    Entries equal in both come from repeated rows, which count as one document: only the first of them is in `order`.
    """
    order = np.lexsort((*row[::-1], *what[::-1]))

    def as_before(columns: tuple[np.ndarray, ...]) -> np.ndarray:
        same = np.zeros(len(order), bool)
        same[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in columns])
        return same

    sure = as_before(what)
    again = sure & as_before(row)
    return order[~again], sure[~again]


class _Block:
    """The words of some texts, and where their windows start."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data = data
        self.starts, self.ends, self.first = word_spans(data, at)

    def hashes(self, which: int) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends, _SEEDS[which])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, first word) of all windows, the word counted over the block."""
        n = np.maximum(np.diff(self.first) - WINDOW + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        return text, np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + self.first[:-1][text]


_POSTING = f"a long, c long, {KEY_TYPES}, start int, n int, sure boolean"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows with a common anchor: its hash a, hash c of all their words, the row, first word and number.

    The windows of a run have the anchor at different distances, and equal windows at the same one, so no two of a run
    are equal.

    Equal runs within a block but the first (by row and word) are `sure` to be repeats. They get an anchor of their own,
    so that what is very common goes to a reducer once for each block. Repeated rows bring each of theirs once.
    """
    for batch in batches:
        for part in blocks(batch, "_text"):
            row = [part.column(k).to_numpy(zero_copy_only=False) for k in range(len(KEY))]
            block = _Block(*flat(part.column(len(KEY))))
            text, word = block.windows()
            if not len(word):
                continue
            one = block.hashes(0)
            anchor, place = _smallest(_rolled(one, GRAM, _STEPS[0]), WINDOW - GRAM + 1)
            anchor, place = anchor[word], place[word]
            new = np.ones(len(word), bool)
            new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(word)))
            a, doc, at = anchor[head], text[head], word[head]
            two = block.hashes(1)
            # words are bound to their places by powers of a step; the sum over a run's words, moved to its start, is its hash
            power = np.full(len(two) + 1, _STEPS[1], np.uint64)
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            inverse = np.full(len(two) + 1, pow(int(_STEPS[1]), -1, 1 << 64), np.uint64)
            inverse[0] = 1
            np.multiply.accumulate(inverse, out=inverse)
            sums = np.zeros(len(two) + 1, np.uint64)
            np.cumsum(two * power[: len(two)], out=sums[1:])
            c = mix((sums[at + n + WINDOW - 1] - sums[at]) * inverse[at] + n.astype(np.uint64))
            start = at - block.first[:-1][doc]
            order, sure = _settled((a, c), (*[k[doc] for k in row], start))
            a, c, doc, start, n = a[order], c[order], doc[order], start[order], n[order]
            a[sure] = _own_hash(a[sure], row, doc[sure], start[sure])
            columns = (a.view(np.int64), c.view(np.int64), *[k[doc] for k in row], start.astype(np.int32), n.astype(np.int32), sure)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "c", *KEY, "start", "n", "sure"])


def _own_hash(of: np.ndarray, row: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash that repeats of one thing don't share, so that they are dealt evenly."""
    return mix(of + row[0][doc].astype(np.uint64) * np.uint64(31) + row[1][doc].astype(np.uint64) + start.astype(np.uint64))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit hashes (w, v) of the windows in the ranges given for each row; repeats within a block are `sure`.

    Rows of the batch that is being added are `fresh`; all others stand before them.
    """
    for batch in batches:
        for part in blocks(batch, "_text"):
            row = [part.column(k).to_numpy(zero_copy_only=False) for k in range(len(KEY))]
            block = _Block(*flat(part.column(len(KEY))))
            spans, at = part.column(len(KEY) + 1), part.column(len(KEY) + 1).offsets.to_numpy()
            fields = spans.values
            start, n = fields.field(0).to_numpy(zero_copy_only=False)[at[0] : at[-1]], fields.field(1).to_numpy(zero_copy_only=False)[at[0] : at[-1]]
            if not len(n):
                continue
            doc = np.repeat(np.arange(part.num_rows), np.diff(at))
            doc, first, n = np.repeat(doc, n), np.repeat(start, n), n.astype(np.int64)
            start = first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
            word, fresh = block.first[:-1][doc] + start, part.column(len(KEY) + 2).to_numpy(zero_copy_only=False)
            w, v = _rolled(block.hashes(0), WINDOW, _STEPS[1])[word], _rolled(block.hashes(1), WINDOW, _STEPS[0])[word]
            order, sure = _settled((w, v), (fresh[doc], *[k[doc] for k in row], start))
            w, v, doc, start = w[order], v[order], doc[order], start[order]
            w[sure] = _own_hash(w[sure], row, doc[sure], start[sure])
            columns = (w.view(np.int64), v.view(np.int64), *[k[doc] for k in row], start.astype(np.int32), sure, fresh[doc])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["w", "v", *KEY, "start", "sure", "fresh"])


class WindowIndex:
    """Immutable runs of window fingerprints, each sorted by anchor within buckets that all runs share.

    The runs are the partitions of one bucketed table in the shared folder. Adding a batch writes its run, merges it with
    the runs before it bucket by bucket, and answers at once which windows of the batch stand earlier; the history never
    moves and is not answered again. Rows are postings: consecutive windows of a document with the same anchor (the first
    of their GRAM-word sequences with the smallest hash, which depends on a window's words alone, so equal windows have
    equal anchors). A second table, bucketed by row, logs the texts that were added, so that open windows of the history
    can be verified without its source.

    Whatever an earlier batch holds is earlier; within a batch the smaller id is, and within a document the smaller place.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs = 0
        self.answers: list[DataFrame] = []
        self.log, self.log_path = f"tessera_texts_{uuid.uuid4().hex}", fresh_path(spark, "window-texts")
        self._new_table()

    def _new_table(self) -> None:
        self.name, self.path = f"tessera_windows_{uuid.uuid4().hex}", fresh_path(self.spark, "window-index")

    def _save(self, df: DataFrame, name: str, path: str, part: str, by: tuple[str, ...], sort: bool) -> None:
        writer = df.write.mode("append").partitionBy(part).bucketBy(self.buckets, *by)
        writer = writer.sortBy(*by) if sort else writer
        writer.option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)

    def _write(self, postings: DataFrame) -> None:
        """A run of postings that are already dealt by bucket."""
        self._save(postings.withColumn("run", F.lit(self.runs)), self.name, self.path, "run", ("a",), True)
        self.runs += 1

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", compact: bool = True) -> DataFrame:
        """(key columns, spans) of the rows of this batch: their windows that occur earlier, here or in what was added before.

        The batch becomes a run; when there are fan_in of them, they are compacted (not with compact=False, for a
        last batch). A row added again repeats itself.
        """
        keyed, batch = _keyed(docs, id_col, text_col), len(self.answers)
        self._rest = keyed.schema["_rest"].dataType
        plain = F.struct(*[F.col("_rest").getField(f.name).alias(f"_{k}") for k, f in enumerate(self._rest.fields)])
        logged = keyed.withColumn("_rest", plain).repartition(self.buckets, *KEY).withColumn("batch", F.lit(batch))
        self._save(logged, self.log, self.log_path, "batch", KEY, False)
        postings = keyed.select(*KEY, "_text").mapInArrow(thrifty(_postings), _POSTING)
        self._write(postings.repartition(self.buckets, "a"))
        self.answers.append(self._answer(batch))
        if compact and self.runs >= self.fan_in:
            self.compact()
        return self.answers[-1]

    def compact(self) -> None:
        """Merges all runs into one that has the first posting of each kind; later ones are answered and can't be first again.

        The runs share their buckets, so that nothing is shuffled.
        """
        here = Window.partitionBy("a", "c").orderBy("run", *KEY, "start")
        merged = self.spark.table(self.name).where("NOT sure").withColumn("_nth", F.row_number().over(here)).where("_nth = 1").drop("run", "_nth")
        name, path = self.name, self.path
        self._new_table()
        self.runs = 0
        self._write(merged)
        self._drop(name, path)

    def close(self) -> None:
        """Drops the postings; answers that were given, and the texts they rest on, stay."""
        self._drop(self.name, self.path)

    def drop(self) -> None:
        self.close()
        self._drop(self.log, self.log_path)

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(self.spark, path)

    def texts(self) -> DataFrame:
        """(key columns, _rest, _text) of all rows that were added, dealt by key."""
        return self.spark.table(self.log).select(*KEY, F.col("_rest").cast(self._rest).alias("_rest"), "_text")

    def _suspects(self) -> DataFrame:
        """From one merge of the newest run with those before it: its postings that are repeats, and what is open.

        Open are first postings of the newest run whose anchor has other postings too, with those others.
        """
        fresh = F.col("run") == self.runs - 1
        merged = self.spark.table(self.name).where(fresh | ~F.col("sure")).withColumn("fresh", fresh)
        nth = F.rank().over(Window.partitionBy("a", "c", "sure").orderBy("run", *KEY, "start"))
        merged = merged.withColumn("repeat", F.col("sure") | (nth > 1)).where("fresh OR NOT repeat")
        all_of = Window.partitionBy("a")
        merged = merged.withColumn("_low", F.min("c").over(all_of)).withColumn("_high", F.max("c").over(all_of)).withColumn("_open", F.max(F.col("fresh") & ~F.col("repeat")).over(all_of))
        return merged.where("repeat OR (_open AND _low != _high)").select(*KEY, "start", "n", "repeat", "fresh")

    def _answer(self, batch: int) -> DataFrame:
        """The repeats of the newest batch.

        Whole postings that repeat an earlier one are settled by the merge. The others are verified window by window:
        their texts are taken from the log and 128-bit hashes of the windows compared.
        """
        suspects = cut(self._suspects(), "suspects")
        open_ = suspects.where("NOT repeat").groupBy(*KEY).agg(F.collect_set(F.struct("start", "n")).alias("spans"))
        logged = self.spark.table(self.log).where(F.col("batch") <= batch)
        wanted = logged.join(open_.select(*renamed_key("_o"), "spans"), same_row("_o")).select(*KEY, "_text", "spans", (F.col("batch") == batch).alias("fresh"))
        windows = wanted.mapInArrow(thrifty(_window_rows), f"w long, v long, {KEY_TYPES}, start int, sure boolean, fresh boolean")
        nth = F.rank().over(Window.partitionBy("w", "v", "sure").orderBy("fresh", *KEY, "start"))
        again = windows.withColumn("_nth", nth).where("fresh AND (sure OR _nth > 1)").select(*KEY, "start", F.lit(1).alias("n"))
        found = suspects.where("repeat").select(*KEY, "start", "n").unionByName(again)
        return found.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def repeats(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(key columns, spans): the answers that were given for rows of docs."""
        rows = docs.select(*row_key(id_col, text_col))
        return reduce(DataFrame.unionByName, self.answers).join(rows, list(KEY), "left_semi")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*row_key(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_rest"), F.col(text_col).alias("_text"))


def removed_words(n_words: int, spans: list | None) -> np.ndarray:
    """Which words the windows in those (start, n) spans cover."""
    edge = np.zeros(n_words + 1, np.int64)
    for s in spans or ():
        edge[s["start"]] += 1
        edge[s["start"] + s["n"] + WINDOW - 1] -= 1
    return np.cumsum(edge)[:n_words] > 0


def _cleaned(text: str, spans: list | None) -> tuple[int, int, str, str]:
    """(words, removed words, SHA-256 of the kept words, the text without the removed ones)."""
    raw = text.encode()
    words = raw.split()
    if not spans:
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), text
    gone = removed_words(len(words), spans)
    kept = hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist()) if not g])).hexdigest()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    cut_, keep = np.zeros(len(data) + 1, np.int64), np.flatnonzero(gone)
    follow = np.append(starts[1:], len(data))  # a removed word goes with the white space behind it
    np.add.at(cut_, starts[keep], 1)
    np.add.at(cut_, follow[keep], -1)
    return len(words), int(gone.sum()), kept, data[np.cumsum(cut_)[:-1] == 0].tobytes().decode()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(_rest, n_words, n_removed, kept_sha256, text) of every row; _rest holds its other columns.

    Every word that a window of WINDOW words covers whose sequence starts earlier (in a document with a smaller id, or
    in the same one before) is removed with the white space behind it. Windows are those of the given texts, not of what
    is left of them. Null text has no words, and stays null. A null id counts as the largest; rows with one id but other
    texts are told apart and ordered by a hash of their text; rows that agree in id and text count as one document and
    all get its result. Columns may have any names; an empty table gives an empty result.

    The rows are added in `batches` by id to a WindowIndex, each as a run that is merged with those before it and answered
    then. The index's log of texts stays in the shared folder, since the result is read from it.
    """
    spark = docs.sparkSession
    index = WindowIndex(spark)
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    at = docs.agg(F.percentile_approx(id_, [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    bounds = [None, *(at or []), None]
    for low, high in zip(bounds, bounds[1:]):
        part = docs if low is None else docs.where(id_ > low)
        index.add(part if high is None else part.where(id_ <= high), id_col, text_col, compact=high is not None)
    index.close()
    spans = reduce(DataFrame.unionByName, index.answers).select(*renamed_key("_s"), "spans")
    joined = index.texts().join(spans, same_row("_s"), "left").select("_rest", "_text", "spans")

    def clean(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in blocks(batch, "_text"):
                texts, found = part.column(1).to_pylist(), []
                for text, s in zip(texts, part.column(2).to_pylist()):
                    found.append(_cleaned(text or "", s))
                columns = [pa.array([f[k] for f in found], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))]
                text = pa.array([None if t is None else f[3] for t, f in zip(texts, found)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, text], names=["_rest", "n_words", "n_removed", "kept_sha256", "text"])

    return joined.mapInArrow(thrifty(clean), _schema(joined.schema["_rest"].dataType))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", batches: int = 1) -> DataFrame:
    """docs with the repeated words cut from their texts; all rows and columns stay, length_col (if any) is the new length.

    A table that is there as a whole is one batch: more batches give the same rows, but write (and compact) a run for each.
    """

    def column(name: str):
        if name == text_col:
            return F.col("text").alias(name)
        if name == length_col:
            return F.char_length("text").cast(docs.schema[name].dataType).alias(name)
        return F.col(f"_rest.`{name}`")

    return dedup(docs, id_col, text_col, batches).select(*map(column, docs.columns))


def _schema(rest):
    from pyspark.sql import types as T

    return T.StructType([T.StructField("_rest", rest), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("text", T.StringType())])
