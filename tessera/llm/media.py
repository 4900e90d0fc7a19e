"""Media columns with content-defined payload chunking."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, KEY_TYPES, blocks, delete_path, flat, fresh_path, mix, renamed_key, row_key, same_row, thrifty

UNIT = 576
SIDE = 24
#: Chunk sizes in bytes. A cut is possible where the last AVERAGE_BITS bits of the rolling hash are zero.
SMALLEST, LARGEST, AVERAGE_BITS = 512, 16_384, 11
#: Level of the compression of chunks, and of texts that are shuffled.
LEVEL = 15
#: Bits of the filter of marked rows: so many for each of them, but no more in all than FILTER_MOST (8 MB).
FILTER_BITS, FILTER_MOST = 16, 1 << 26

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def to_media(text: bytes) -> bytes:
    """The text's bytes, padded with 255 to a positive multiple of 576, as samples of a grey picture (PGM) 24 wide."""
    payload = text + b"\xff" * (-len(text) % UNIT if text else UNIT)
    return b"P5\n%d %d\n255\n" % (SIDE, len(payload) // SIDE) + payload


def from_media(media: bytes) -> bytes:
    """The samples of such a picture; the header's size must agree."""
    kind, size, most, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or most != b"255" or width * height != len(samples):
        raise ValueError("not a whole 8-bit picture")
    return samples


def gear(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash at every byte: the sum over the last 32 bytes of gear[byte] << age, built by doubling."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cut_points(media: bytes, candidates: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks. A cut depends on the 32 bytes before it and on where its chunk began."""
    n, start, ends = len(media), 0, []
    if n > SMALLEST and candidates is None:
        candidates = np.flatnonzero(gear(np.frombuffer(media, np.uint8)) & np.uint32((1 << AVERAGE_BITS) - 1) == 0) + 1
    while n - start > SMALLEST:
        k = int(np.searchsorted(candidates, start + SMALLEST))
        end = int(candidates[k]) if k < len(candidates) else n
        start = min(end, start + LARGEST, n)
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks(text: bytes) -> tuple[bytes, list[bytes]]:
    media = to_media(text)
    ends = cut_points(media)
    return media, [media[a:b] for a, b in zip([0, *ends], ends)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def framed(cs: list[bytes], owned: set[int], named: set[int], squeeze) -> list[bytes | None]:
    """What a row stores for each chunk: none if it only names it, a frame of its own if others name it, else the frame of
    this and all following chunks of its kind, or nothing if such a frame has it already."""
    out: list[bytes | None] = []
    while len(out) < len(cs):
        k = len(out)
        end = k + 1
        if k in named:
            out.append(None)
            continue
        while k not in owned and end < len(cs) and end not in owned and end not in named:
            end += 1
        out += [squeeze(b"".join(cs[k:end])), *[b""] * (end - k - 1)]
    return out


def unframed(sizes: list[int], blobs: list[bytes], expand) -> list[bytes]:
    """The chunks out of the frames."""
    out, frame, at = [], b"", 0
    for size, blob in zip(sizes, blobs):
        if blob:
            frame, at = expand(blob), 0
        out.append(frame[at : at + size])
        at += size
    return out


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for part in blocks(batch, column):
        data, at = flat(part.column(part.schema.get_field_index(column)))
        raw = data.tobytes()
        yield part, [raw[a:b] for a, b in zip(at, at[1:])]


_STORED = [("n_bytes", pa.int64()), ("media_sha256", pa.binary()), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("blobs", pa.list_(pa.binary())), ("shared", pa.list_(pa.int32())), ("whole", pa.bool_())]


def _stored(front: list[pa.Array], texts: Iterable[bytes], owned: Iterable, named: Iterable, squeeze) -> pa.RecordBatch:
    """The rows of a store: behind (_n, doc) what _STORED names."""
    rows = []
    for text, owns, names in zip(texts, owned, named):
        media, cs = chunks(text)
        names, owns = set(names or ()), set(owns or ())
        rows.append(
            {
                "n_bytes": len(text),
                "media_sha256": hashlib.sha256(media).digest(),
                "digests": [digest(c) for c in cs],
                "sizes": [len(c) for c in cs],
                "blobs": framed(cs, owns, names, squeeze),
                "shared": sorted(owns),
                "whole": not names,
            }
        )
    return pa.RecordBatch.from_arrays([*front, *[pa.array([r[n] for r in rows], t) for n, t in _STORED]], names=["_n", "doc", *[n for n, _ in _STORED]])


def _row_filter(marks: DataFrame) -> np.ndarray:
    """Bits, at places told by the hash of a row's text: 1 where a marked row may be, 0 where surely none is."""
    n = FILTER_BITS * marks.count()
    bits = min(1 << max(n - 1, 63).bit_length(), FILTER_MOST)
    at = F.col("_mtie").bitwiseAND(F.lit(bits - 1).cast("long"))
    words = marks.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_mtie & 63L as int))")).alias("word")).toArrow()
    found = np.zeros(bits // 64, np.int64)
    found[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return found


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the media of all rows to `path`: for each row the ordered chunk list, and the chunks that it owns.

    Digests of all chunks meet in joins first: of the places of a chunk that occurs more than once the first (smallest
    id) owns it, the others only name it. These marks are written, and a filter of bounded size tells for each row whether
    it may have some. Rows that surely have none are stored where they are read; for the others the marks are joined to the
    texts by row, which for this are shuffled once, compressed. A full filter lets more rows through, and loses none.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch, "_text"):
                found = [[digest(c) for c in chunks(t)[1]] for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(KEY)], pa.array(found, pa.list_(pa.binary()))], names=[*KEY, "digests"])

    keys, text = row_key(id_col, text_col), F.col(text_col).alias("_text")
    listed = docs.select(*keys, text).mapInArrow(thrifty(digests), f"{KEY_TYPES}, digests array<binary>")
    places = listed.select(*KEY, F.posexplode("digests").alias("seq", "digest"))
    place = F.struct(*KEY, "seq")
    shared = places.groupBy("digest").agg(F.min(place).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("_d"), "owner")
    marks = places.join(shared, F.col("digest") == F.col("_d")).groupBy(*renamed_key("_m"))
    marks = marks.agg(F.collect_set(F.when(place == F.col("owner"), F.col("seq"))).alias("owned"), F.collect_set(F.when(place != F.col("owner"), F.col("seq"))).alias("named"))
    marks_path = fresh_path(docs.sparkSession, "media-marks")
    marks.write.option("compression", "zstd").parquet(marks_path)
    marks = docs.sparkSession.read.schema(marks.schema).parquet(marks_path)
    maybe = _row_filter(marks)

    def chosen(batch: pa.RecordBatch, marked: bool) -> pa.RecordBatch:
        tie = batch.column(batch.schema.get_field_index("_tie")).to_numpy(zero_copy_only=False)
        at = tie & (64 * len(maybe) - 1)
        return batch.filter(pa.array((maybe[at >> 6] >> (at & 63) & 1 == 1) == marked))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for part, texts in _texts(chosen(batch, False), "_text"):
                yield _stored(part.columns[:2], texts, repeat(()), repeat(()), squeeze)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for part, texts in _texts(chosen(batch, True), "_text"):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([squeeze(t) for t in texts], pa.binary())], names=[*part.schema.names[:-1], "_packed"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze, expand = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in blocks(batch, "_packed"):
                yield _stored(part.columns[:2], map(expand, part.column(4).to_pylist()), part.column(2).to_pylist(), part.column(3).to_pylist(), squeeze)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_n long, doc {kind}, n_bytes long, media_sha256 binary, digests array<binary>, sizes array<int>, blobs array<binary>, shared array<int>, whole boolean"
    rows = docs.select(F.monotonically_increasing_id().alias("_n"), F.col(id_col).alias("_doc"), *keys, text)
    met = rows.mapInArrow(thrifty(packed), f"_n long, _doc {kind}, {KEY_TYPES}, _packed binary").join(marks.hint("merge"), same_row("_m"), "left").select("_n", "_doc", "owned", "named", "_packed")
    rows.mapInArrow(thrifty(alone), schema).unionByName(met.mapInArrow(thrifty(write), schema)).write.option("compression", "zstd").parquet(path)
    delete_path(docs.sparkSession, marks_path)


def feature(payload: bytes) -> str:
    """Mean and variance of the samples in thousandths, and how many fall in each of eight equal ranges."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    n, level = len(x), np.arange(256)
    total, squares = int(counts @ level), int(counts @ (level * level))
    ranges = counts.reshape(8, 32).sum(1)
    return f"{total * 1000 // n}/{(squares * n - total * total) * 1000 // (n * n)}/" + ".".join(map(str, ranges.tolist()))


def read(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Puts the media of a store together again, verifies every chunk and the whole, and measures the payloads.

    (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) for each row written.
    Rows that own all their chunks are done where they are read; for the others the chunks that they name are joined
    by digest and grouped by row, in order. A chunk that is missing is an error, not a missing row.
    """

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for names, sizes, blobs, whole in zip(*[batch.column(k).to_pylist() for k in (3, 4, 5, 2)]):
                parts = unframed(sizes, blobs, expand)
                if [digest(p) for p in parts] != names:
                    raise ValueError("a chunk in the store is not what its digest says")
                media = b"".join(parts)
                if hashlib.sha256(media).digest() != whole:
                    raise ValueError("the chunks do not make up the media")
                payload = from_media(media)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), whole.hex(), feature(payload)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = stored.schema["doc"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    columns = ("doc", "n_bytes", "media_sha256", "digests", "sizes", "blobs")
    sources = (
        stored.where(F.size("shared") > 0)
        .select(F.explode(F.transform("shared", lambda k: F.struct(F.get("digests", k).alias("_d"), F.get("blobs", k).alias("_blob")))).alias("_c"))
        .select("_c.*")
        .groupBy("_d")
        .agg(F.first("_blob").alias("_blob"))
    )
    places = stored.where("NOT whole").select("_n", "doc", "n_bytes", "media_sha256", F.posexplode(F.arrays_zip("digests", "sizes", "blobs")).alias("seq", "c"))
    places = places.select("_n", "doc", "n_bytes", "media_sha256", "seq", "c.digests", "c.sizes", "c.blobs")
    named = places.where("blobs IS NULL").drop("blobs").join(sources, F.col("digests") == F.col("_d"), "left")
    found = F.coalesce("_blob", F.raise_error(F.lit("a chunk that a row names is not in the store")).cast("binary"))
    named = named.select("_n", "doc", "n_bytes", "media_sha256", "seq", "digests", "sizes", found.alias("blobs"))
    gathered = (
        places.where("blobs IS NOT NULL")
        .unionByName(named)
        .groupBy("_n", "doc", "n_bytes", "media_sha256")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "digests", "sizes", "blobs"))).alias("c"))
        .select("doc", "n_bytes", "media_sha256", *[F.col(f"c.{k}").alias(k) for k in ("digests", "sizes", "blobs")])
    )
    return stored.where("whole").select(*columns).mapInArrow(thrifty(rebuild), schema).unionByName(gathered.select(*columns).mapInArrow(thrifty(rebuild), schema))


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as media and measures what is read back.

    Null text is an empty text (576 bytes of 255). A null id stays null; repeated rows give a row each and share their
    chunks; other columns are not looked at. Texts are stored whole; an empty table gives an empty result.
    """
    path = fresh_path(docs.sparkSession, "media-store")
    store(docs, path, id_col, text_col)
    return read(docs.sparkSession.read.parquet(path), id_col)
