"""Byte-level BPE in linear time: longest matches from an automaton, backtracking over compatible neighbours."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import thrifty

#: Pieces whose ids a worker remembers in each of two generations.
CACHE_WORDS = 100_000
#: Longer pieces are encoded one by one and without being remembered.
CACHE_WORD_CHARS = 64
#: Neighbours whose fit a worker remembers.
CACHE_FITS = 1_000_000
#: Characters of text whose new pieces are encoded together.
BLOCK_CHARS = 1 << 20
#: Longest piece in bytes that is encoded together with others: as many positions can be marked as dead in a word.
MASK_BITS = 63
#: Pieces that are encoded together at most; with fewer than FEW left, the rest of them is encoded one by one.
MOST, FEW = 1 << 16, 32

#: Fixed value: the one pattern that is also compiled by `re` with its classes spelled out, as that takes a third of the
#: time. Texts under any other pattern are split by the pattern as it is.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict[tuple[str, str], "ByteBpe"] = {}
#: No UTF-8 text has this byte, so it parts pieces that are looked at together.
_PART, _PART_LETTER, _PART_BYTE = "\udcff", "\xff", b"\xff"
_BITS = 24
_START = (1 << _BITS) - 1
_SLOT_BITS = 19


class _Fits(dict):
    """(last token, token) -> the longest token that begins like the second and is compatible with the first; -1 if there is none."""

    def __init__(self, compatible, shorter):
        super().__init__()
        self.compatible, self.shorter = compatible, shorter

    def __missing__(self, key: int) -> int:
        last, token = key >> _BITS, key & _START
        while token >= 0 and last != _START and not self.compatible(last, token):
            token = self.shorter(token, -1)
        if len(self) >= CACHE_FITS:
            self.clear()
        self[key] = token
        return token


class _FitTable:
    """The same for arrays of keys: each key has one slot, and what isn't in its slot is asked of `fits` and put there."""

    def __init__(self, fits: _Fits):
        self.fits = fits
        self.keys, self.values = np.full(1 << _SLOT_BITS, -1, np.int64), np.zeros(1 << _SLOT_BITS, np.int64)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        slots = (keys.view(np.uint64) * np.uint64(0x9FB21C651E98DF25) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)
        out = self.values[slots]
        missed = np.flatnonzero(self.keys[slots] != keys)
        if len(missed):
            asked = keys[missed]
            out[missed] = found = np.fromiter(map(self.fits.__getitem__, asked.tolist()), np.int64, len(asked))
            # one by one in effect: of keys that share a slot the last is kept, with its own value
            last = dict(zip(slots[missed].tolist(), range(len(missed))))
            kept, where = np.fromiter(last.values(), np.int64, len(last)), np.fromiter(last, np.int64, len(last))
            self.keys[where], self.values[where] = asked[kept], found[kept]
        return out


def _spelled_out(regex) -> re.Pattern:
    """KNOWN_PATTERN for `re`, with the characters of the basic plane that `regex` has in its classes."""
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)

    def inside(name: str) -> str:
        codes = np.array([ord(c) for c in regex.findall(name, every)])
        firsts, lasts = codes[np.diff(codes, prepend=-2) != 1].tolist(), codes[np.diff(codes, append=1 << 20) != 1].tolist()
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(firsts, lasts))

    letter, number, space = map(inside, (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class ByteBpe:
    """Encodes and decodes by merge ranks.

    Bytes stand as Latin-1 characters in the automaton. A sequence of tokens is the result of the merges exactly if
    every two neighbours are compatible: merging the bytes of both gives these two tokens again. So the automaton runs
    over a piece once and gives its longest matches from the left; where one doesn't fit its neighbour, the next shorter
    token is taken and the automaton goes on behind it, and if none is left, the position is marked as dead and the
    last token taken back. New pieces of a block go through that together in rounds, up to the first that is dead.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.text_of = {rank: f" {rank}" for rank in ranks.values()}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        reachable = {}
        for token, rank in ranks.items():
            if self.merge(token) == [rank]:
                reachable[token] = rank
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.whole = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.size_of = {rank: len(token) for token, rank in reachable.items()}
        self.shorter: dict[int, int] = {}
        for token, rank in reachable.items():
            for n in range(len(token) - 1, 0, -1):
                if token[:n] in reachable:
                    self.shorter[rank] = reachable[token[:n]]
                    break
        self.history = lru_cache(1 << 13)(self._history)
        self.fits = _Fits(self.compatible, self.shorter.get)
        self.fit_table = _FitTable(self.fits)
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.text_sizes, self.byte_sizes = self.sizes.copy(), self.sizes.copy()
        for token, rank in ranks.items():
            self.text_sizes[rank], self.byte_sizes[rank] = len(self.text_of[rank]), len(token)
        self.sizes[list(self.size_of)] = list(self.size_of.values())
        self.less = np.full(len(self.sizes), -1)
        self.less[list(self.shorter)] = list(self.shorter.values())
        #: tokens that merging never gives; they stand only for a piece that is equal to them
        self.unreachable = {token.decode("latin-1") for token in ranks if token not in reachable}
        #: whether no match reaches over what parts pieces
        self.parted = _PART_BYTE in reachable and not any(_PART_BYTE in token[:-1] or token.endswith(_PART_BYTE) and len(token) > 1 for token in ranks)
        #: piece -> (ids as text, decoded bytes)
        self.memo: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}
        self.spelled_out = _spelled_out(regex).findall if pattern == KNOWN_PATTERN else None

    @staticmethod
    def load(path: str, pattern: str) -> "ByteBpe":
        """The encoder of a rank file (base64 token and rank on each line), one for each worker process."""
        if (path, pattern) not in _LOADED:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            _LOADED[path, pattern] = ByteBpe(ranks, pattern)
        return _LOADED[path, pattern]

    def merge(self, data: bytes) -> list[int]:
        """Merges by rank, lowest and then leftmost first; only for the short strings of one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _history(self, rank: int) -> list[tuple[int, bytes, bytes]]:
        """How the merges form a token: for each step its rank, and the first and last part after it."""
        data = self.bytes_of[rank]
        parts = [data[i : i + 1] for i in range(len(data))]
        out = [(-1, parts[0], parts[-1])]
        while len(parts) > 1:
            r, i = min((self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            out.append((r, parts[0], parts[-1]))
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both gives the two again.

        The merges inside each go on as they would alone, lowest rank first, unless the parts that meet at the seam are
        next in that order (of equal ranks the leftmost).
        """
        left, right, rank_of, none = self.history(a), self.history(b), self.ranks.get, 1 << 60
        i = j = 0
        while True:
            seam = rank_of(left[i][2] + right[j][1], none)
            next_left = left[i + 1][0] if i + 1 < len(left) else none
            next_right = right[j + 1][0] if j + 1 < len(right) else none
            if seam < next_left and seam <= next_right and seam != none:
                return False
            if next_left == none and next_right == none:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def encode_letters(self, letters: str) -> list[int]:
        """The ids of one match of the pattern, given as the Latin-1 characters of its bytes."""
        rank = self.whole.get(letters)
        if rank is not None:
            return [rank]
        longest, fits, shorter, size_of = self.automaton.iter_long, self.fits, self.shorter.get, self.size_of
        dead: set[int] = set()
        taken: list[int] = []
        at, last, best = 0, _START, -1
        while True:
            for end, token in longest(letters, at):
                best = fits[last << _BITS | token]
                if best != token or end + 1 in dead:
                    break
                taken.append(token)
                at, last = end + 1, token
            else:
                if at == len(letters):
                    return taken
                best = -1
            while True:
                while best >= 0 and at + size_of[best] in dead:
                    less = shorter(best, -1)
                    best = fits[last << _BITS | less] if less >= 0 else -1
                if best >= 0:
                    taken.append(best)
                    at, last = at + size_of[best], best
                    break
                if not taken:
                    raise ValueError("a byte of the text is not in the vocabulary")
                dead.add(at)
                back = taken.pop()
                at, last = at - size_of[back], taken[-1] if taken else _START
                less = shorter(back, -1)
                best = fits[last << _BITS | less] if less >= 0 else -1

    def encode_piece(self, piece: bytes) -> list[int]:
        return self.encode_letters(piece.decode("latin-1"))

    def forget(self) -> None:
        """Lets go of the older generation, for tasks of other kinds that may come next."""
        self.older = {}

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pieces(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _next(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The longest token shorter than each that begins like it and fits behind the last; -1 if there is none."""
        less = self.less[token]
        out = np.full(len(less), -1)
        some = np.flatnonzero(less >= 0)
        out[some] = self.fit_table.look_up(last[some] << _BITS | less[some])
        return out

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, in the order of the pieces; how many of them each piece has) of matches of the pattern.

        What encode_letters does, for all pieces at once. Each round is one pass of the automaton over what is left of
        them: tokens are taken up to the first that doesn't fit, then the next shorter one is, or tokens are taken back.
        """
        n, part = len(pieces), self.ranks.get(_PART_BYTE)
        letters = _PART.join(pieces).encode("utf-8", "surrogateescape").decode("latin-1").split(_PART_LETTER)
        length = np.fromiter(map(len, letters), np.int64, n)
        alone = length > MASK_BITS
        if not self.parted:
            alone[:] = True
        elif self.unreachable:
            alone |= np.fromiter(map(self.unreachable.__contains__, letters), bool, n)
        taken = np.empty((n, MASK_BITS), np.int32)
        depth, at, last, dead = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, _START), np.zeros(n, np.uint64)
        which = np.flatnonzero(~alone & (length > 0))
        while len(which) >= FEW:
            text = "".join([letters[i][a:] + _PART_LETTER for i, a in zip(which.tolist(), at[which].tolist())])
            tokens = np.fromiter(map(itemgetter(1), self.automaton.iter_long(text)), np.int64)
            behind, parts = np.cumsum(self.sizes[tokens]), np.flatnonzero(tokens == part)
            if behind[-1] != len(text) or len(parts) != len(which):
                raise ValueError("a byte of the text is not in the vocabulary")
            found = np.diff(parts, prepend=-1)
            row, starts = np.repeat(np.arange(len(which)), found), parts - found + 1
            behind += np.repeat(length[which] + 1 - behind[parts], found)  # now counted from the start of the piece
            before = np.empty_like(tokens)
            before[1:] = tokens[:-1]
            before[starts] = last[which]
            tokens[parts] = before[parts] = _START  # fits behind itself
            best = self.fit_table.look_up(before << _BITS | tokens)
            wrong = best != tokens
            barred = dead[which]
            if barred.any():
                wrong |= (barred[row] >> np.minimum(behind, MASK_BITS).astype(np.uint64) & np.uint64(1)).astype(bool) & (tokens != _START)
            misfits = np.flatnonzero(wrong)
            misfits = misfits[np.diff(row[misfits], prepend=-1) != 0]
            until = parts.copy()
            until[row[misfits]] = misfits
            nth = np.arange(len(tokens))
            kept = np.flatnonzero(nth < until[row])
            taken[which[row[kept]], depth[which[row[kept]]] + kept - starts[row[kept]]] = tokens[kept]
            depth[which] += until - starts
            which, best, last_of = which[row[misfits]], best[misfits], before[misfits]
            at[which], last[which] = np.where(misfits > starts[row[misfits]], behind[misfits - 1], at[which]), last_of
            which = self._settled(which, best, taken, depth, at, last, dead)
            which = which[at[which] < length[which]]
        alone[which] = True
        single = np.flatnonzero(alone)
        by_one = [self.encode_letters(letters[i]) for i in single.tolist()]
        depth[single] = 0
        owner = np.repeat(np.arange(n), depth)
        ids = taken[np.arange(MASK_BITS) < depth[:, None]].astype(np.int64)
        if by_one:
            owner = np.concatenate([owner, np.repeat(single, [len(found) for found in by_one])])
            ids = np.concatenate([ids, np.fromiter(chain.from_iterable(by_one), np.int64)])
            ids = ids[np.argsort(owner, kind="stable")]
        return ids, np.bincount(owner, minlength=n)

    def _settled(self, rows: np.ndarray, best: np.ndarray, taken: np.ndarray, depth: np.ndarray, at: np.ndarray, last: np.ndarray, dead: np.ndarray) -> np.ndarray:
        """The rows again, each with one more token taken: `best`, a shorter one, or one behind tokens that are taken back."""
        settled = []
        while len(rows):
            while True:
                barred = np.flatnonzero(best >= 0)
                to = (at[rows[barred]] + self.sizes[best[barred]]).astype(np.uint64)
                barred = barred[(dead[rows[barred]] >> to & np.uint64(1)).astype(bool)]
                if not len(barred):
                    break
                best[barred] = self._next(last[rows[barred]], best[barred])
            good = best >= 0
            done, token = rows[good], best[good]
            taken[done, depth[done]] = token
            depth[done] += 1
            at[done] += self.sizes[token]
            last[done] = token
            settled.append(done)
            rows = rows[~good]
            if not depth[rows].all():
                raise ValueError("a byte of the text is not in the vocabulary")
            dead[rows] |= np.uint64(1) << at[rows].astype(np.uint64)
            depth[rows] -= 1
            back = taken[rows, depth[rows]].astype(np.int64)
            at[rows] -= self.sizes[back]
            last[rows] = np.where(depth[rows] > 0, taken[rows, depth[rows] - 1], _START)
            best = self._next(last[rows], back)
        return np.concatenate(settled) if settled else rows

    def _entries(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """(ids as text, each behind a space; decoded bytes) of matches of the pattern."""
        ids, counts = self._together(pieces)
        ends = np.cumsum(counts)
        listed = ids.tolist()
        parts = []
        for values, sizes, nothing in ((self.text_of, self.text_sizes, ""), (self.bytes_of, self.byte_sizes, b"")):
            joined = nothing.join(map(values.__getitem__, listed))
            at = np.concatenate([[0], np.cumsum(sizes[ids])])[np.concatenate([[0], ends])].tolist()
            parts.append([joined[a:b] for a, b in zip(at, at[1:])])
        return zip(*parts)

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern."""
        if self.spelled_out and (text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)):
            return self.spelled_out(text)
        return self.split(text)

    def _block(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        cut = [self.pieces(text) for text in texts]
        if len(self.memo) >= CACHE_WORDS:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        new = []
        for piece in set().union(*cut).difference(memo):
            if (found := older.get(piece)) is not None:
                memo[piece] = found
            else:
                new.append(piece)
        for first in range(0, len(new), MOST):
            memo.update(zip(new[first : first + MOST], self._entries(new[first : first + MOST])))
        if long := {piece: memo.pop(piece) for piece in new if len(piece) > CACHE_WORD_CHARS}:
            memo = memo | long
        for found in cut:
            ids_hash, bytes_hash, n = hashlib.sha256(), hashlib.sha256(), 0
            for first in range(0, len(found), 4096):
                entries = list(map(memo.__getitem__, found[first : first + 4096]))
                line = "".join(map(itemgetter(0), entries))
                ids_hash.update((line if n else line[1:]).encode())
                bytes_hash.update(b"".join(map(itemgetter(1), entries)))
                n += line.count(" ")
            yield n, ids_hash.hexdigest(), bytes_hash.hexdigest()

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids in decimal, SHA-256 of the decoded bytes) of each text."""
        some, chars = [], 0
        for text in texts:
            some.append(text)
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield from self._block(some)
                some, chars = [], 0
        yield from self._block(some)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row.

    Null text counts as empty: no ids, and both digests are those of the empty string. A null id stays null, repeated
    rows give a row each, other columns are not looked at. Texts are encoded whole. No shuffle; a worker holds one
    batch of texts, the automaton and the bounded memos.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(ranks_path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = list(bpe.digests([t or "" for t in texts]))
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found]), pa.array([f[2] for f in found])]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([bpe.encode(t or "") for t in texts], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        bpe.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(thrifty(run), schema)
