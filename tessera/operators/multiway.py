"""Joins of many patterns: acyclicity, semi-join reduction, factorised counts, and a hypercube for cyclic cores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_tree(edges: list[set[str]]) -> list[tuple[int, int]] | None:
    """(ear, parent) in removal order of the relations with these variables, or None if they form a cycle.

    A relation is an ear if some other one holds all its variables that any other relation has; ears go one by one.
    """
    left, out = dict(enumerate(map(set, edges))), []
    while len(left) > 1:
        for k, e in left.items():
            shared = e & set().union(*(x for j, x in left.items() if j != k))
            parent = next((j for j, x in left.items() if j != k and shared <= x), None)
            if parent is not None:
                out.append((k, parent))
                del left[k]
                break
        else:
            return None
    return out


def reduced(relations: list[DataFrame]) -> list[DataFrame]:
    """The relations (joined on columns of equal names) without rows that no full answer has, by semi-joins along the join tree."""
    tree = join_tree([set(r.columns) for r in relations])
    if tree is None:
        raise ValueError("the relations form a cycle")
    out = list(relations)

    def keep(target: int, by: int) -> None:
        shared = [c for c in out[target].columns if c in out[by].columns]
        if shared:
            out[target] = out[target].join(out[by].select(*shared).distinct(), shared, "left_semi")

    for ear, parent in tree:
        keep(parent, ear)
    for ear, parent in reversed(tree):
        keep(ear, parent)
    return out


def star_count(relations: list[DataFrame], key: str) -> DataFrame:
    """(count) of the join of relations on one key, from each key's counts alone: the product is never made."""
    counts = [r.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(f"n{k}")) for k, r in enumerate(relations)]
    joined = reduce(lambda a, b: a.join(b, key), counts)
    product = reduce(lambda a, b: a * b, [F.col(f"n{k}").cast("decimal(38,0)") for k in range(len(relations))])
    return joined.agg(F.coalesce(F.sum(product), F.lit(0)).cast("bigint").alias("count"))


def star_keys(relations: list[DataFrame], key: str) -> DataFrame:
    """The distinct keys that all relations have: semi-joins, not a join and a distinct."""
    out = relations[0].select(key).where(F.col(key).isNotNull()).distinct()
    for r in relations[1:]:
        out = out.join(r.select(key), key, "left_semi")
    return out


#: Rows of one relation that a cell of a hypercube is to have at most, rows that are packed together, pairs that are looked up together.
CELL, CHUNK, SLICE = 4 << 20, 1 << 20, 1 << 20


def hypercube_triangles(r: DataFrame, s: DataFrame, t: DataFrame, side: int | None = None) -> DataFrame:
    """(a, b, c) of r(a, b), s(b, c), t(c, a) in one round: each row goes to the cells of a side³ cube that its two values
    fix and all values of the third axis, and each cell joins what it gets. A hot value spreads over side² cells.

    Without a side it is fitted so that a cell gets about CELL rows of each relation; the relations are counted for that.
    Rows of integers travel packed, a few bytes for each, and a cell extends the pairs of r and s and looks them up in t
    slice by slice, so that what two relations give is neither sorted nor written.
    """
    relations = [x.dropna() for x in (r.select("a", "b"), s.select("b", "c"), t.select("c", "a"))]
    side = side or max(2, math.ceil(math.sqrt(max(x.count() for x in relations) / CELL)))
    kinds = {c: kind for x in relations for c, kind in x.dtypes}
    if not all(kind in ("tinyint", "smallint", "int", "bigint") for x in relations for _, kind in x.dtypes):
        return _cells_of_rows(relations, side)
    packed = reduce(DataFrame.unionByName, [x.mapInArrow(_packer(k, side), "cell int, relation int, rows binary") for k, x in enumerate(relations)])
    cells = packed.repartition(side**3, "cell").sortWithinPartitions("cell")
    return cells.mapInArrow(_joined_cells, "a long, b long, c long").select(*[F.col(c).cast(kinds[c]).alias(c) for c in "abc"])


def _cells_of_rows(relations: list[DataFrame], side: int) -> DataFrame:
    """The same for values of any type: one row for each cell; the last relation is hashed, so that pairs are not sorted."""
    place = {c: F.pmod(F.xxhash64(c), F.lit(side)) for c in "abc"}

    def spread(df: DataFrame, other: str) -> DataFrame:
        axis = F.explode(F.sequence(*[F.lit(k).cast("bigint") for k in (0, side - 1)]))
        return df.select("*", *[(axis if c == other else place[c]).alias(f"_{c}") for c in "abc"]).repartition("_a", "_b", "_c")

    x, y, z = (spread(df, other) for df, other in zip(relations, "cab"))
    at = ["_a", "_b", "_c"]
    return x.join(y, [*at, "b"]).join(z.hint("shuffle_hash"), [*at, "a", "c"]).select("a", "b", "c")


def _planes(x: np.ndarray) -> bytes:
    """64-bit words by their bytes: all lowest bytes first, so that unused ones vanish when they are compressed."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _pack(x: np.ndarray, y: np.ndarray) -> bytes:
    """Pairs sorted by x: the steps of x, and y - x with its sign in the lowest bit, compressed."""
    step, off = np.diff(x, prepend=0), y - x
    return len(x).to_bytes(8, "little") + pa.compress(_planes(step) + _planes((off << 1) ^ (off >> 63)), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], 16 * n, codec="zstd", asbytes=True), np.uint8).reshape(2, 8, n)
    step, off = (np.ascontiguousarray(part.T).view(np.int64).ravel() for part in raw)
    x = np.cumsum(step)
    return x, x + ((off >> 1 & np.int64((1 << 63) - 1)) ^ -(off & 1))


def _packer(relation: int, side: int):
    """Packs rows of r (0), s (1) or t (2) by the two axes that they fix, and gives each pack to the cells of the third."""
    weight = (side * side, side, 1)
    first, second, other = weight[relation], weight[(relation + 1) % 3], weight[(relation + 2) % 3]

    def axis(x: np.ndarray) -> np.ndarray:
        h = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return ((h >> np.uint64(32)) % np.uint64(side)).astype(np.int64)

    def packs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        at = axis(x) * first + axis(y) * second
        order = np.lexsort((y, x, at))
        at, x, y = at[order], x[order], y[order]
        edge = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
        cells, rows = [], []
        for low, high in zip(edge[:-1], edge[1:]):
            cells += [int(at[low]) + k * other for k in range(side)]
            rows += [_pack(x[low:high], y[low:high])] * side
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([relation] * len(cells), pa.int32()), pa.array(rows, pa.binary())], names=["cell", "relation", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns))
            n += batch.num_rows
            if n >= CHUNK:
                yield packs(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield packs(*map(np.concatenate, zip(*held)))

    return run


def _joined_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The triangles of each cell; the packs of a cell come together."""
    now, packs = None, ([], [], [])
    for batch in batches:
        for cell, relation, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if cell != now:
                yield from _triangles(packs)
                now, packs = cell, ([], [], [])
            packs[relation].append(rows.as_py())
    yield from _triangles(packs)


def _triangles(packs: tuple[list[bytes], ...]) -> Iterator[pa.RecordBatch]:
    if not all(packs):
        return
    (a, b), (sb, sc), (tc, ta) = (map(np.concatenate, zip(*map(_unpack, x))) for x in packs)
    as_, cs = np.unique(ta), np.unique(tc)
    wanted = np.sort(np.searchsorted(as_, ta) * len(cs) + np.searchsorted(cs, tc))

    def place(values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(values, x), len(values) - 1)
        return at, values[at] == x

    order = np.lexsort((sc, sb))
    at, known = place(cs, sc[order])
    sb, sc, at = sb[order][known], sc[order][known], at[known]
    low = np.searchsorted(sb, b)
    n, (row, known) = np.searchsorted(sb, b, "right") - low, place(as_, a)
    use = np.flatnonzero(known & (n > 0))
    use = use[np.lexsort((b[use], a[use]))]
    a, b, low, n, row = a[use], b[use], low[use], n[use], row[use] * len(cs)
    ends, first = np.cumsum(n), 0
    while first < len(a):
        done = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, done + SLICE, "right")), first + 1)
        part = slice(first, last)
        of = np.repeat(np.arange(first, last), n[part])
        pair = np.arange(len(of)) - (ends - n)[of] + done + low[of]
        key = row[of] + at[pair]
        found = np.searchsorted(wanted, key)
        hit = np.flatnonzero(wanted[np.minimum(found, len(wanted) - 1)] == key)
        hit = np.repeat(hit, np.searchsorted(wanted, key[hit], "right") - found[hit])
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[of[hit]], b[of[hit]], sc[pair[hit]])], names=["a", "b", "c"])
        first = last
