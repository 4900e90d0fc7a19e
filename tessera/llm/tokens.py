"""Token counts of whole texts, huge ones by overlap resynchronisation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import thrifty

#: Bytes of a text that are encoded in one call; longer texts are encoded by overlapping chunks.
CHUNK_BYTES = 32_768
OVERLAP_BYTES = 256
OVER_LIMIT = 4096

_MARK = "▁"
_MARK_BYTES = _MARK.encode()
_LOADED: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Counts the pieces a sentencepiece model gives.

    A cut between a character that isn't a space and a space is *stable* if no piece of the vocabulary holds a space
    mark behind another character: then no merge can cross it, whatever stands on either side. This is proven from the
    vocabulary when the model is loaded; a model with such a piece has no stable cuts, and its texts are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        plain = "".join(self.model.encode("a  b", out_type=str)) == f"{_MARK}a{_MARK}{_MARK}b"
        self.stable = plain and not any(b == _MARK and a != _MARK for p in pieces for a, b in zip(p, p[1:]))

    def boundaries(self, data: bytes) -> list[int]:
        """Offsets, in bytes of the UTF-8 text, at which its tokens begin."""
        return [p.begin for p in self.model.encode(data.decode(), return_type="proto").pieces]

    def count(self, text: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> int:
        data = text.encode()
        if len(data) <= chunk or not self.stable:
            return len(self.model.encode(text, num_threads=1))
        total, start, end = 0, 0, self._character(data, chunk)
        # `start` is 0 or the space at a stable cut. Encoding leaves that space out, as the model puts one in front itself.
        left = self._chunk(data, start, end)
        while end < len(data):
            wide, right_end = overlap, self._character(data, end + chunk)
            while True:
                begin = max(start, end - wide)
                lead, cut = self._lead(data, begin, end), None
                if lead is not None:
                    right = self._chunk(data, lead, right_end)
                    cut = self._common(data, left, right, lead, end)
                if cut is not None:
                    total += sum(1 for b in left if b < cut)
                    left = [b for b in right if b >= cut]
                    start, end = cut, right_end
                    break
                if begin == start:
                    # the overlap is the whole chunk and has no common stable cut: take twice the text into it
                    end = self._character(data, start + 2 * (end - start))
                    left = self._chunk(data, start, end)
                    break
                wide *= 2
        return total + len(left)

    @staticmethod
    def _character(data: bytes, at: int) -> int:
        """The end of the character that `at` lies in, at most the end of the text."""
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        return min(at, len(data))

    @staticmethod
    def _stable(data: bytes, at: int) -> bool:
        """A single space, with no space or space mark beside it, inside the text."""
        return 0 < at < len(data) - 1 and data[at] == 32 and data[at - 1] != 32 and data[at + 1] != 32 and data[max(0, at - 3) : at] != _MARK_BYTES and data[at + 1 : at + 4] != _MARK_BYTES

    def _chunk(self, data: bytes, start: int, end: int) -> list[int]:
        """Token offsets, in the whole text, of the chunk that starts at 0 or at the space `start`."""
        if start == 0:
            return self.boundaries(data[:end])
        return [start + 1 + b if i else start for i, b in enumerate(self.boundaries(data[start + 1 : end]))]

    def _lead(self, data: bytes, begin: int, end: int) -> int | None:
        """The first stable cut from `begin` on, at whose space the next chunk may start."""
        at = data.find(b" ", begin, end)
        while at >= 0:
            if self._stable(data, at):
                return at
            at = data.find(b" ", at + 1, end)
        return None

    def _common(self, data: bytes, left: list[int], right: list[int], low: int, end: int) -> int | None:
        """The last stable cut in the overlap at which both encodings begin a token.

        The tokens of the left chunk before the cut and those of the right chunk behind it are those of the whole text.
        """
        both = {b for b in left if low <= b < end}
        return next((b for b in reversed(right) if low <= b < end and b in both and self._stable(data, b)), None)


def _counter(path: str) -> PieceCounter:
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(path)
    return _LOADED[path]


def count_tokens(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = OVER_LIMIT,
    chunk: int = CHUNK_BYTES,
    overlap: int = OVERLAP_BYTES,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, by the sentencepiece model at model_path.

    Null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows give a row each; other columns
    are not looked at. A text of any length is encoded whole: up to `chunk` bytes in one call, beyond that by
    chunks that overlap. One task holds one batch of texts and the offsets of one chunk. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_tokens = [0] * len(texts)
            n_bytes = batch.column(2).to_pylist()
            short = [i for i, n in enumerate(n_bytes) if n <= chunk]
            for k in range(0, len(short), 256):
                some = short[k : k + 256]
                for i, ids in zip(some, counter.model.encode([texts[i] for i in some], num_threads=1)):
                    n_tokens[i] = len(ids)
            for i, n in enumerate(n_bytes):
                if n > chunk:
                    n_tokens[i] = counter.count(texts[i], chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), batch.column(2)], names=[id_col, "n_tokens", "n_bytes"])

    taken = docs.select(F.col(id_col), F.col(text_col).alias("_text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = taken.mapInArrow(thrifty(run), f"`{id_col}` {kind}, n_tokens long, n_bytes long")
    return found.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
