import hashlib
import random

import public_tokenizers
import pytest

from tessera.llm import bpe, tokens

SP = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "hello  world", "tabs\t\tand\n\n lines \n", "été überall ñandú", "日本語のテキスト", "🙂🙂 emoji",
    "don't we'll I'M", "x" * 500, " " * 300, "a b   c", "<|endoftext|> <s> </s>", "▁ a▁b", "#### $$$ 123456789 1.5e10", "\n \n \t x   y",
]


def _random(seed):
    r = random.Random(seed)
    return "".join(r.choice(["the", " ", "  ", "qu", "ing", "\n", "ß", "zz", "12", "!", "…", "é", " a", "\t"]) for _ in range(r.randrange(1, 400)))


def test_counts_match_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=SP)
    texts = TEXTS + [_random(i) for i in range(60)]
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = {r.doc_id: r for r in tokens.count_tokens(df, SP, chunk=64, overlap=8).collect()}
    for i, t in enumerate(texts):
        r = rows[i if i else None]
        assert r.n_tokens == len(model.encode(t or "")), t
        assert r.n_bytes == len((t or "").encode())
        assert r.over_limit == (r.n_tokens > 4096)


@pytest.mark.parametrize("chunk,overlap", [(50, 1), (50, 20), (200, 8), (1000, 64)])
def test_resynchronisation(chunk, overlap):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=SP)
    counter = tokens.PieceCounter(SP)
    assert counter.stable
    for seed in range(40):
        text = " ".join(_random(seed * 50 + k) for k in range(6))
        assert counter.count(text, chunk, overlap) == len(model.encode(text))
    for text in ("y" * 3000, " " * 3000, "a  b" * 700, "word " * 900, "▁x" * 600):
        assert counter.count(text, chunk, overlap) == len(model.encode(text))


def _encoding():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_match_the_library(spark):
    lib = _encoding()
    texts = TEXTS + [_random(i) for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN, with_ids=True).collect():
        text = texts[r.doc_id] or ""
        ids = lib.encode_ordinary(text)
        assert r.ids == ids, text
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pieces_of_one_kind_of_character():
    lib, own = _encoding(), bpe.ByteBpe.load(RANKS, public_tokenizers.PATTERN)
    r = random.Random(7)
    for _ in range(400):
        piece = "".join(r.choice("abcdeinorstüé") for _ in range(r.randrange(1, 120)))
        assert own.encode(piece) == lib.encode_ordinary(piece)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.count_tokens(df, SP).count() == 0
    assert bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN).count() == 0


def test_compatibility_is_what_merging_gives():
    own = bpe.ByteBpe.load(RANKS, public_tokenizers.PATTERN)
    r = random.Random(9)
    tokens_ = list(own.size_of)
    for _ in range(30_000):
        a, b = r.choice(tokens_), r.choice(tokens_)
        assert own.compatible(a, b) == (own.merge(own.bytes_of[a] + own.bytes_of[b]) == [a, b])


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, r"\p{L}+|\s+|[^\s\p{L}]+", r"[a-c]+|[^a-c]+"])
def test_any_pattern_gives_what_the_library_gives(pattern):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    lib, own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), bpe.ByteBpe.load(RANKS, pattern)
    r = random.Random(3)
    texts = [t or "" for t in TEXTS] + [_random(i) for i in range(300)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x3000), r.randrange(0x10000, 0x1FFFF)])) for _ in range(60)) for _ in range(60)]
    for text, found in zip(texts, own.digests(texts), strict=True):
        ids = lib.encode_ordinary(text)
        assert found == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), text


def test_memos_that_overflow_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    monkeypatch.setattr(bpe, "CACHE_WORD_CHARS", 4)
    monkeypatch.setattr(bpe, "CACHE_FITS", 10)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 100)
    lib, own = _encoding(), bpe.ByteBpe({**bpe.ByteBpe.load(RANKS, public_tokenizers.PATTERN).ranks}, public_tokenizers.PATTERN)
    texts = [_random(i) + " strengthening, the. words! a" for i in range(120)]
    assert [f[0] for f in own.digests(texts)] == [len(lib.encode_ordinary(t)) for t in texts]


@pytest.mark.parametrize("few", [1, bpe.FEW])
def test_new_pieces_are_encoded_together(monkeypatch, few):
    monkeypatch.setattr(bpe, "FEW", few)
    lib, own = _encoding(), bpe.ByteBpe(bpe.ByteBpe.load(RANKS, public_tokenizers.PATTERN).ranks, public_tokenizers.PATTERN)
    r, alone = random.Random(5), []
    one_by_one = own.encode_letters
    monkeypatch.setattr(own, "encode_letters", lambda letters: alone.append(letters) or one_by_one(letters))
    bits = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "tion", "ing", "ble", "é", "ß", "日本"]
    words = {"".join(r.choice(bits) for _ in range(r.randrange(1, 14))) for _ in range(6000)} | {"abc" * n for n in range(1, 40)}
    text = " ".join(sorted(words))
    ids = lib.encode_ordinary(text)
    assert list(own.digests([text])) == [(len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())]
    assert len([letters for letters in alone if len(letters) <= bpe.MASK_BITS]) < bpe.FEW
    assert any(len(letters) > bpe.MASK_BITS for letters in alone)


def test_small_vocabularies_take_tokens_back():
    import tiktoken

    r = random.Random(11)
    for _ in range(60):
        every = [bytes([b]) for b in range(256)]
        while len(every) < 300:
            a, b = r.choice(every[97:101] + every[256:]), r.choice(every[97:101] + every[256:])
            if len(a + b) < 12 and a + b not in every:
                every.append(a + b)
        if r.random() < 0.5:
            every += [b"dcbadcba"] * (b"dcbadcba" not in every)  # merging may never give it
        ranks = {token: rank for rank, token in enumerate(every)}
        lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        own = bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
        pieces = sorted({"".join(r.choice("abcd") for _ in range(r.randrange(1, 70))) for _ in range(300)} | {"dcbadcba", ""})
        ids, counts = own._together(pieces)
        expected = [lib.encode_ordinary(piece) for piece in pieces]
        assert counts.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [i for e in expected for i in e]


def test_bytes_outside_the_vocabulary_are_an_error():
    ranks = {token: rank for token, rank in bpe.ByteBpe.load(RANKS, public_tokenizers.PATTERN).ranks.items() if b"q" not in token}
    own = bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    for pieces in (["q"], [f"a{c}q" for c in "bcdefghijklmnop"] * 4, [f"{c}s" for c in "qbcdefghijklmnop"] * 4):
        with pytest.raises(ValueError):
            own._together(pieces)


def test_the_spelled_out_pattern_splits_as_the_pattern_does():
    own = bpe.ByteBpe.load(RANKS, public_tokenizers.PATTERN)
    assert own.spelled_out is not None
    for low in range(0, 0x11000, 64):
        some = [chr(c) for c in range(low, low + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}{c} {c}\n{c}' {c} {c}s  {c}" for c in some) + "".join(some)
        assert own.pieces(text) == own.split(text)
    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice("ab1² '\n\t\x1c\x85\u00a0é.stre🙂") for _ in range(r.randrange(30)))
        assert own.pieces(text) == own.split(text)
