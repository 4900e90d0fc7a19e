"""Language identification by the nearest of several centroids for each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import thrifty
from pyspark.sql import types as T

#: Dimensions that the hashes of byte n-grams are folded to.
DIMENSIONS = 1 << 14
GRAMS = (1, 2, 3)
#: Labelled rows for each language that the model is fitted on, in expectation; they are chosen by a hash of the id.
SAMPLE = 400
CENTROIDS = 4
ROUNDS = 8
#: A text is rejected if its cosine is under this part of what the most distant hundredth of the fitted rows reach.
REJECT = 0.4
#: N-grams from which on the full limit holds; shorter texts, whose vectors say less, get a lower one.
FULL_GRAMS = 2000
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def counts(text: str) -> np.ndarray:
    """How often each folded n-gram occurs in the lower-cased text; whatever isn't a letter counts as one space."""
    data = _FOLD[np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)]
    gap = data == 32
    gap[1:] &= gap[:-1]
    gap[0] = False
    data = data[~gap].astype(np.uint32)
    total = np.zeros(DIMENSIONS, np.int64)
    h = np.zeros(len(data), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if n > len(data):
            break
        h = h[: len(data) - n + 1] * np.uint32(0x9E3779B1) + (data[n - 1 :] + np.uint32(1)) * np.uint32(0x85EBCA77)
        if n in GRAMS:
            total += np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    of_centroid: np.ndarray
    idf: np.ndarray
    centroids: np.ndarray
    limits: np.ndarray

    def vectors(self, rows: list[np.ndarray]) -> np.ndarray:
        v = np.log1p(np.asarray(rows, np.float32)) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def predict(self, rows: list[np.ndarray]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each row of counts."""
        cosines = self.vectors(rows) @ self.centroids.T
        best = cosines.argmax(1)
        n_grams = np.array([r.sum() for r in rows])
        limits = self.limits[best] * np.minimum(1, np.sqrt(n_grams / FULL_GRAMS))
        found = cosines[np.arange(len(rows)), best]
        return [(self.languages[self.of_centroid[b]], float(min(1, max(0, c))), bool(c < m)) for b, c, m in zip(best, found, limits)]


def _clusters(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from evenly spread starts; a cluster that loses all its rows is left out."""
    centres = v[np.linspace(0, len(v) - 1, min(k, len(v))).astype(int)]
    for _ in range(ROUNDS):
        near = (v @ centres.T).argmax(1)
        centres = np.stack([v[near == j].mean(0) for j in range(len(centres)) if (near == j).any()])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model of the rows that have an id, a text, a language and aren't held out; None if there are none.

    The only part that reaches the driver is the bounded sample's counts: about `sample` rows of each language.
    """
    usable = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where(F.col("_id").isNotNull() & F.col("_lang").isNotNull() & ~held_out("_id"))
    totals = {r["_lang"]: r["n"] for r in usable.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return None
    share = F.create_map(*[x for lang, n in totals.items() for x in (F.lit(lang), F.lit(min(1.0, sample / n)))])
    chosen = usable.where(F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 30)) < F.element_at(share, F.col("_lang")) * (1 << 30)).where(F.col("_text").isNotNull())

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [(lang, counts(t)) for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if has_letter(t)]
            at = [np.flatnonzero(c) for _, c in keep]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.string()), pa.array([a.astype(np.int32).tobytes() for a in at], pa.binary()), pa.array([c[a].astype(np.int32).tobytes() for (_, c), a in zip(keep, at)], pa.binary())], names=["lang", "at", "n"])

    rows = chosen.select("_text", "_lang").mapInArrow(thrifty(sparse), "lang string, at binary, n binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["at"], r["n"]))
    if not rows:
        return None
    seen = np.zeros(DIMENSIONS)
    for r in rows:
        seen[np.frombuffer(r["at"], np.int32)] += 1
    model = Model(sorted({r["lang"] for r in rows}), np.zeros(0, int), (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0))
    for k, lang in enumerate(model.languages):
        dense = []
        for r in rows:
            if r["lang"] == lang:
                c = np.zeros(DIMENSIONS, np.int32)
                c[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.int32)
                dense.append(c)
        v = model.vectors(dense)
        centres = _clusters(v, CENTROIDS)
        long = np.array([c.sum() for c in dense]) >= FULL_GRAMS
        reach = (v[long] if long.any() else v) @ centres.T
        model.centroids = np.concatenate([model.centroids, centres])
        model.of_centroid = np.concatenate([model.of_centroid, np.full(len(centres), k)])
        model.limits = np.concatenate([model.limits, np.full(len(centres), REJECT * np.quantile(reach.max(1), 0.01))])
    return model


def _predicted(taken: DataFrame, model: Model | None) -> DataFrame:
    """taken, whose first column is the text, with lang_pred, score and rejected in front."""
    given = taken.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            out = [(UNKNOWN, 0.0, True)] * len(texts)
            known = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
            for k in range(0, len(known), 128):
                some = known[k : k + 128]
                for i, found in zip(some, m.predict([counts(texts[i]) for i in some])):
                    out[i] = found
            new = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*new, *batch.columns], names=["lang_pred", "score", "rejected", *batch.schema.names])

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return taken.mapInArrow(thrifty(run), T.StructType(new + taken.schema.fields))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row; nothing but the text is looked at.

    lang_pred is the language of the centroid with the largest cosine, score that cosine. A text that is null or has no
    letter, and every text if there is no model, gets `und` with score 0 and is rejected. A text is also rejected if its
    cosine is under the centroid's limit. Texts are read whole; repeated rows give a row each. No shuffle.
    """
    found = _predicted(docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_id")), model)
    return found.select(F.col("_id").alias(id_col), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't rejected, with the same columns, whatever their names."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    found = _predicted(docs.select(F.col(text_col).alias("_text"), rest.alias("_rest")), model)
    return found.where("NOT rejected").select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_rest.`{c}`") for c in docs.columns])
