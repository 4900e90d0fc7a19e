"""SimHash near-duplicates, found by Golay-code fuzzy hashing of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, thrifty

SHINGLE_WORDS = 3
SEED = 42
#: Fingerprints that differ in at most so many bits are linked. The key scheme below is complete for 3, not for more.
MOST_BITS = 3
#: (first bit, bits) of the three segments of a fingerprint; each is a word of the code, the last one with five zeros.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the perfect binary Golay code [23, 12, 7]: a fixed value.
GENERATOR = 0b101011100011

_U = np.uint64


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = min(SHINGLE_WORDS, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - n + 1].tolist()
    ends = ends[n - 1 :].tolist()
    of = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 16):
        h = np.array([of(joined[s:e], SEED) for s, e in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)])], np.dtype("<u8"))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the SimHash of every row as a signed long. Null text has no words, and fingerprint zero. No shuffle."""
    return _marked(docs, [F.col(id_col)], text_col)


def _marked(docs: DataFrame, keys: list[Column], text_col: str) -> DataFrame:
    """The key columns and the SimHash fp of every row."""
    keyed = docs.select(*keys, F.col(text_col).alias("_text"))
    names = keyed.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(len(names)).to_pylist()], _U)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*names, "fp"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields[:-1])
    return keyed.mapInArrow(thrifty(run), f"{kinds}, fp long")


class Golay:
    """Nearest-codeword decoding by syndromes: each of the 2048 belongs to exactly one error of at most three bits."""

    def __init__(self):
        def remainder(word: int) -> int:
            for shift in range(11, -1, -1):
                if word >> (shift + 11) & 1:
                    word ^= GENERATOR << shift
            return word

        single = [remainder(1 << k) for k in range(23)]
        self.syndromes = [np.zeros(1 << 12, np.uint32), np.zeros(1 << 11, np.uint32)]
        for part, first, n in ((0, 0, 12), (1, 12, 11)):
            for k in range(n):
                self.syndromes[part][1 << k : 2 << k] = self.syndromes[part][: 1 << k] ^ np.uint32(single[first + k])
        self.errors = np.zeros(1 << 11, np.uint32)
        for weight in (1, 2, 3):
            for bits in combinations(range(23), weight):
                syndrome = 0
                for k in bits:
                    syndrome ^= single[k]
                self.errors[syndrome] = sum(1 << k for k in bits)

    def index(self, words: np.ndarray) -> np.ndarray:
        """The 12-bit index of the codeword nearest to each 23-bit word."""
        syndrome = self.syndromes[0][words & np.uint32(0xFFF)] ^ self.syndromes[1][words >> np.uint32(12)]
        return (words ^ self.errors[syndrome]) >> np.uint32(11)

    def near(self, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) of the codewords nearest to each word or to a word one bit (of the low `bits`) away.

        Two words one bit apart share the index of either. A word within two bits of its codeword has one index, any
        other at most six.
        """
        flips = np.concatenate([np.zeros(1, np.uint32), np.uint32(1) << np.arange(bits, dtype=np.uint32)])
        found = np.sort(self.index(words[:, None] ^ flips[None, :]), axis=1)
        first = np.ones(found.shape, bool)
        first[:, 1:] = found[:, 1:] != found[:, :-1]
        row, column = np.nonzero(first)
        return row, found[row, column]


_CODE: list[Golay] = []


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows such that any two fingerprints at most 3 bits apart meet under a key.

    With at most 3 errors over three segments either each segment has exactly one, or one segment has none and another
    at most one. For the second case a key is a segment's exact bits with an index near another segment. For the first
    it is an index of each segment: as a query a fingerprint brings all indices near its first two segments and the
    nearest of the third, as an entry the nearest of the first two and all near the third.
    """
    if not _CODE:
        _CODE.append(Golay())
    code = _CODE[0]
    parts = [(fps >> _U(first) & _U((1 << n) - 1)).astype(np.uint32) for first, n in SEGMENTS]
    nearest = [code.index(p).astype(_U) for p in parts]
    near = [code.near(p, n) for p, (_, n) in zip(parts, SEGMENTS)]
    out_keys, out_rows = [], []
    for a in range(3):
        for b in range(3):
            if a != b:
                row, index = near[b]
                out_keys.append(_U(a * 3 + b) << _U(40) | parts[a][row].astype(_U) << _U(12) | index.astype(_U))
                out_rows.append(row)
    (row0, index0), (row1, index1), (row2, index2) = near
    n1 = np.bincount(row1, minlength=len(fps))
    first1 = np.cumsum(n1) - n1
    row = np.repeat(row0, n1[row0])
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n1[row0]) - n1[row0], n1[row0])
    query = _U(9) << _U(40) | np.repeat(index0, n1[row0]).astype(_U) << _U(24) | index1[first1[row] + nth].astype(_U) << _U(12) | nearest[2][row]
    entry = _U(9) << _U(40) | nearest[0][row2] << _U(24) | nearest[1][row2] << _U(12) | index2.astype(_U)
    both_keys, both_rows = np.concatenate([query, entry]), np.concatenate([row, row2])
    out_keys.append(both_keys)
    out_rows.append(both_rows)
    return np.concatenate(out_keys), fps[np.concatenate(out_rows)]


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of at most MOST_BITS bits that connect what is connected among these distinct fingerprints, one less than members.

    Each reached fingerprint is compared with those not reached yet, so a tight group takes one pass, not all pairs.
    """
    links, left = [], fps
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            close = np.bitwise_count(left ^ at) <= MOST_BITS
            if close.any():
                links.extend((int(at), int(x)) for x in left[close])
                frontier.extend(left[close])
                left = left[~close]
    return links


def _links_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, fp) rows sorted by both: links within each key's group. A group may go on in the next batch."""
    kept_keys, kept_fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])  # a fingerprint once under a key
        k, f = k[new], f[new].view(_U)
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(k)))
        two = starts[sizes == 2]
        close = two[np.bitwise_count(f[two] ^ f[two + 1]) <= MOST_BITS] if len(two) else two
        found = [np.stack([f[close], f[close + 1]], 1)] if len(close) else []
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            more = spanning_links(f[s : s + n])
            if more:
                found.append(np.array(more, _U))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), _U)
        pairs = np.unique(np.sort(pairs.view(np.int64), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        k = np.concatenate([kept_keys, batch.column(0).to_numpy(zero_copy_only=False)])
        f = np.concatenate([kept_fps, batch.column(1).to_numpy(zero_copy_only=False)])
        last = int(np.searchsorted(k, k[-1])) if len(k) else 0
        kept_keys, kept_fps = k[last:], f[last:]
        if last:
            yield links(k[:last], f[:last])
    if len(kept_keys):
        yield links(kept_keys, kept_fps)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect exactly what links of 3 bits or fewer connect."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(_U)
            for k in range(0, len(fps), 2048):
                found, of = keys(fps[k : k + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(of.view(np.int64))], names=["key", "fp"])

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.select("fp").mapInArrow(thrifty(expand), "key long, fp long").repartition(n, "key").sortWithinPartitions("key", "fp")
    return keyed.mapInArrow(thrifty(_links_of_sorted), "a long, b long").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): the label of a component is its smallest node; nodes without a link have no row.

    Each round takes the smallest label among a node's neighbours and then that label's label, so distances halve. Each
    round is written to the shared folder; only the number of changes reaches the driver.
    """
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label"), F.lit(True).alias("changed")), "labels")
    while labels.where("changed").limit(1).count():
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.select("node", F.col("label").alias("old")).join(near, "node").select("node", "old", F.least("old", "near").alias("via"))
        jumped = hooked.join(labels.select(F.col("node").alias("via"), F.col("label").alias("far")), "via")
        labels = cut(jumped.select("node", F.least("via", "far").alias("label"), (F.least("via", "far") != F.col("old")).alias("changed")), "labels")
    return labels.select("node", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    Rows with equal fingerprints form a class; only classes are linked, so copies cost nothing but a count. The component
    id is the smallest id reachable. A text without words, or null, has fingerprint zero and is linked like any other; a
    null id is never a component's id unless the component has no other. Repeated rows give a row each; other columns
    are not looked at; an empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    rooted = cut(_rooted(marked, F.col(id_col)), "classes")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = rooted.select(F.col("fp").alias("_fp"), "root").join(least, "root").select("_fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(of_class, F.col("fp") == F.col("_fp")).select(id_col, digits.alias("fingerprint"), "component_id")


def _rooted(marked: DataFrame, key: Column) -> DataFrame:
    """(fp, first, root): each class of equal fingerprints, its smallest key and its component's smallest fingerprint."""
    classes = marked.groupBy("fp").agg(F.min(key).alias("first"))
    found = components(links(classes))
    return classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("root"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near-duplicates: of each component the row with the smallest id stays, of repeats of it one.

    Ids need not tell rows apart: rows with one id are ordered by a hash of their text, and null ids count as the largest.
    The texts are dealt once, by id and that hash; the semi-join and the choice among repeats use that.
    """
    keys = [F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("_key"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_tie")]
    rooted = _rooted(cut(_marked(docs, keys, text_col), "fingerprints"), F.struct("_key", "_tie"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *keys)
    first = F.row_number().over(Window.partitionBy("_key", "_tie").orderBy("_tie"))
    return rows.join(kept, ["_key", "_tie"], "left_semi").withColumn("_nth", first).where("_nth = 1").select("_row.*")
