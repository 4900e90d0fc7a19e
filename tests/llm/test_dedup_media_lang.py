import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import langid, media, simhash, substring

r = random.Random(3)
WORDS = ["w%d" % i for i in range(60)]


def corpus():
    passage = [r.choice(WORDS) for _ in range(70)]
    docs = []
    for i in range(60):
        words = [r.choice(WORDS) for _ in range(r.randrange(0, 80))]
        if i % 3 == 0:
            k = r.randrange(len(words) + 1)
            words[k:k] = passage[r.randrange(30) : 30 + r.randrange(40)]
        docs.append("  \n".join(words))
    docs[7] = docs[5]
    docs[9] = " ".join(["a", "b", "c"] * 30)
    docs[11] = " ".join(["x"] * 45)
    docs[13], docs[14], docs[15] = None, "", " \t\n"
    docs[17] = " ".join("é%d" % k for k in range(40)) * 2
    return docs


def brute(rows):
    seen, out = set(), {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_substrings_against_all_windows(spark, batches):
    docs = corpus()
    rows = [(i if i < 59 else None, t, "n_words") for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string")
    want = brute([(x[0], x[1]) for x in rows])
    got = substring.dedup(df, batches=batches).collect()
    assert len(got) == len(rows)
    for x in got:
        i = x._rest.doc_id
        assert (x.n_words, x.n_removed, x.kept_sha256) == want[i], i
        text = docs[59 if i is None else i]
        assert (x.text is None) == (text is None)
        if text is not None:
            assert hashlib.sha256(b" ".join(x.text.encode().split())).hexdigest() == x.kept_sha256
            if not x.n_removed:
                assert x.text == text


def test_rows_with_one_id(spark):
    long = " ".join("q%d" % i for i in range(30))
    df = spark.createDataFrame([(1, long), (1, long), (1, "other " + long), (2, long)], "doc_id long, text string")
    got = sorted((x._rest.doc_id, x.n_removed, x.n_words) for x in substring.dedup(df).collect())
    assert got[3] == (2, 30, 30) and got[0][1] == got[1][1] if got[0][2] == got[1][2] else True
    assert sum(x[1] > 0 for x in got if x[0] == 1) in (1, 2)
    assert substring.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_repeated_rows_count_as_one_document(spark, parts):
    long, other = (" ".join(c + "%d" % i for i in range(30)) for c in "qz")
    rows = [(1, long), (1, long), (1, long), (2, "head " + long), (None, other), (None, other), (None, other + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    df = df if parts == 1 else df.repartition(parts)
    got = sorted((x._rest.doc_id or 9, x.n_words, x.n_removed) for x in substring.dedup(df, batches=1).collect())
    assert got[:4] == [(1, 30, 0)] * 3 + [(2, 31, 30)]
    # of two texts under one id either may be the earlier one; the copies of one text have one result
    assert got[4:] in ([(9, 30, 0)] * 2 + [(9, 31, 30)], [(9, 30, 30)] * 2 + [(9, 31, 0)])


def test_repeated_rows_in_windows_that_are_verified(spark):
    # the anchor's run differs between the texts, so that their common windows are settled one by one
    long = " ".join("q%d" % i for i in range(30))
    rows = [(1, "a b " + long + " c d")] * 2 + [(2, "e f " + long + " g h")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((x._rest.doc_id, x.n_words, x.n_removed, x.text) for x in substring.dedup(df, batches=1).collect())
    assert got == [(1, 34, 0, "a b " + long + " c d")] * 2 + [(2, 34, 30, "e f g h")] * 2


def test_index_is_incremental_and_compacts(spark):
    docs = corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    index = substring.WindowIndex(spark, buckets=3, fan_in=3)
    plain = {(x._id, s["start"] + k) for x in _repeats(spark, df, 10) for s in x.spans for k in range(s["n"])}
    for k in range(5):
        index.add(df.where(f"doc_id >= {k * 12} AND doc_id < {k * 12 + 12}"))
    assert index.runs < 3
    got = {(x._id, s["start"] + k) for x in index.repeats(df).collect() for s in x.spans for k in range(s["n"])}
    assert got == plain and got
    index.drop()


def test_a_batch_is_answered_without_the_source_of_the_history(spark, tmp_path):
    import shutil

    long = " ".join("q%d" % i for i in range(30))
    other = " ".join("z%d" % i for i in range(25))
    index = substring.WindowIndex(spark, buckets=3, fan_in=2)

    def add(rows, name):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
        found = {x._id: sorted({s["start"] + k for s in x.spans for k in range(s["n"])}) for x in index.add(spark.read.parquet(path)).collect()}
        shutil.rmtree(path)
        return found

    assert add([(5, "a b " + long + " c d"), (6, None), (7, "")], "one") == {}
    # the words around differ, so that windows are verified against the texts of the batch before; its rows are not answered again
    assert add([(8, "e f " + long + " g h"), (9, other)], "two") == {8: list(range(2, 13))}
    assert index.runs == 1
    # what an earlier batch holds is earlier, whatever its id, also after compaction
    assert add([(1, "x " + long), (2, "y " + other + " y"), (3, "s t u " + other)], "three") == {1: list(range(1, 12)), 2: list(range(1, 7)), 3: list(range(3, 9))}
    assert index.runs == 1
    index.drop()


def _repeats(spark, df, fan_in):
    index = substring.WindowIndex(spark, fan_in=fan_in)
    index.add(df)
    return index.repeats(df).collect()


def test_fingerprints_and_components_against_all_pairs(spark):
    import xxhash

    base = [r.choice(WORDS) for _ in range(300)]
    texts = [None, "", "one", "Two Words", "É É É"]
    for i in range(90):
        w = list(base if i % 2 else [r.choice(WORDS) for _ in range(r.randrange(1, 12))])
        for _ in range(i % 5):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append(" ".join(w))

    def of(t):
        w = (t or "").encode().lower().split()
        g = [b" ".join(w[k : k + 3]) for k in range(max(len(w) - 2, min(len(w), 1)))]
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [of(t) for t in texts]
    assert fps == [simhash.fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(texts)
    for x in got:
        assert x.fingerprint == "%016x" % fps[x.doc_id] and x.component_id == find(x.doc_id)
    kept = simhash.one_of_each(df).collect()
    assert sorted(x.doc_id for x in kept) == sorted({find(i) for i in range(len(texts))})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_keys_meet_within_three_bits():
    g = np.random.default_rng(5)
    a = g.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    b = a.copy()
    for k in range(3):
        b ^= np.where(g.random(len(a)) < 0.9, np.uint64(1) << g.integers(0, 64, len(a)).astype(np.uint64), np.uint64(0))
    for x, y in zip(a, b):
        kx, ky = (set(simhash.keys(np.array([v], np.uint64))[0].tolist()) for v in (x, y))
        assert kx & ky
        if len(kx) > 200:
            raise AssertionError("more keys than the scheme gives")


def test_golay_code_is_perfect():
    code = simhash.Golay()
    assert len(np.unique(code.errors)) == 2048 and np.bitwise_count(code.errors).max() == 3
    words = np.arange(1 << 23, step=997, dtype=np.uint32)
    back = code.index(words)
    again = code.index(words ^ code.errors[5])
    assert back.max() < 4096 and again.max() < 4096


def test_components_of_long_chains(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(0, 90)] + [(200, 201), (203, 201)], "a long, b long")
    got = {x.node: x.label for x in simhash.components(df).collect()}
    assert all(got[i] == 0 for i in range(91)) and got[203] == got[201] == got[200] == 200


def test_media_round_trip(spark):
    texts = [None, "", "a", "x" * 576, "é" * 300, "".join(r.choice("abc \n") for _ in range(50_000)), "y" * 40_000]
    texts += [texts[5], texts[5][:30_000] + "!" + texts[5][30_000:], texts[6], "a"]
    df = spark.createDataFrame([(i if i else None, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, media_sha256 binary")
    rows = {x.doc_id: x for x in media.media_features(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((576 - len(raw)) if len(raw) < 576 else -len(raw) % 576)
        x = rows[i if i else None]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert x.tail_crc32 == zlib.crc32(payload[-32:])
        assert x.media_sha256 == hashlib.sha256(media.to_media(raw)).hexdigest() and x.media_bytes == len(media.to_media(raw))
    assert rows[5].feature == rows[7].feature
    assert media.media_features(df.limit(0)).count() == 0


def test_chunks_are_shared_and_cuts_follow_content(spark):
    raw = "".join(r.choice("abcdefg \n") for _ in range(60_000)).encode()
    _, one = media.chunks(raw)
    _, two = media.chunks(raw[:20_000] + b"inserted" + raw[20_000:])
    assert b"".join(one) == media.to_media(raw)
    assert all(len(c) <= media.LARGEST for c in one) and all(len(c) >= media.SMALLEST for c in one[:-1])
    assert len({media.digest(c) for c in one} & {media.digest(c) for c in two}) >= len(one) - 6
    path = str(spark.conf.get("spark.checkpoint.dir", None) or "") or None
    from tessera.llm.common import fresh_path

    path = fresh_path(spark, "test-store")
    media.store(spark.createDataFrame([(i, raw.decode()) for i in range(4)], "doc_id long, text string"), path)
    rows = spark.read.parquet(path).collect()
    owned = sum(b is not None for x in rows for b in x.blobs)
    assert owned == len({media.digest(c) for c in one})


def test_languages(spark):
    speech = {"aa": ["kala", "mika", "lomi", "sato"], "bb": ["schtz", "grund", "wohl", "pfer"], "cc": ["ñado", "quel", "cione", "llar"]}
    rows = []
    for i in range(600):
        lang = "abc"[i % 3] * 2
        rows.append((i, " ".join(r.choice(speech[lang]) for _ in range(r.randrange(5, 60))).upper() if i % 50 == 0 else " ".join(r.choice(speech[lang]) for _ in range(r.randrange(5, 60))), lang if i % 7 else None, "x"))
    rows += [(700, None, "aa", "x"), (701, "", None, "x"), (702, "123 !?", "bb", "x"), (None, "kala mika", "aa", "x"), (703, "東京都 大阪府 " * 500, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(df, sample=50)
    assert model.languages == ["aa", "bb", "cc"]
    got = {x.doc_id: x for x in langid.identify(df, model).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == "abc"[i % 3] * 2 and not got[i].rejected and 0 <= got[i].score <= 1 for i in range(600))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (700, 701, 702))
    assert got[703].rejected and got[None].lang_pred == "aa"
    flags = {x.doc_id: x.h for x in df.select("doc_id", langid.held_out().alias("h")).collect()}
    assert all(flags[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(600)) and flags[None] is False
    assert langid.identify(df.limit(0), langid.fit(df.limit(0))).count() == 0
    assert {x.lang_pred for x in langid.identify(df, None).collect()} == {"und"}


def test_predictions_do_not_depend_on_held_out_labels(spark):
    rows = [(i, ("kala mika " if i % 2 else "schtz grund ") * 9, "ab"[i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    changed = spark.createDataFrame([(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, t, x in rows], df.schema)
    a, b = langid.fit(df), langid.fit(changed)
    assert a.languages == b.languages and np.array_equal(a.centroids, b.centroids)


def _equal_32_bit_hashes(spark):
    """Two texts of 26 different words whose 32-bit row hashes agree."""
    from pyspark.sql import functions as F

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(25)), lambda k: F.concat(F.lit("w"), F.hash(F.col("id"), k).cast("string"))), " ")
    texts = spark.range(400_000).select(text.alias("text")).withColumn("h", F.hash("text"))
    pair = texts.groupBy("h").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").orderBy("h").first()
    assert pair is not None
    return pair.a, pair.b


def test_texts_without_ids_whose_short_hashes_agree(spark):
    a, b = _equal_32_bit_hashes(spark)
    rows = [(1, "x y " + b.split(" ", 1)[1]), (None, a), (None, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.text: x.n_removed for x in substring.dedup(df).collect() if x._rest.doc_id is None}
    assert got == {a: 0, b.split(" ", 1)[0] + " ": 25}
    found = sorted(x.payload_sha256 for x in media.media_features(df).collect())
    pad = [(t.encode() + b"\xff" * (-len(t.encode()) % 576)) for _, t in rows]
    assert found == sorted(hashlib.sha256(p).hexdigest() for p in pad)


def test_a_missing_chunk_is_an_error(spark, tmp_path):
    big = " ".join("q%d" % i for i in range(4000))
    path = f"file://{tmp_path}/store"
    media.store(spark.createDataFrame([(1, big), (2, big + " end")], "doc_id long, text string"), path)
    stored = spark.read.parquet(path)
    assert media.read(stored).count() == 2
    with pytest.raises(Exception, match="not in the store"):
        media.read(stored.where("doc = 2")).collect()


def test_word_hashes_tell_mirrored_letters_apart():
    """Thue-Morse words and their mirror images hash alike under any polynomial modulo a power of two."""
    from tessera.llm.common import word_hashes

    bits = np.array([bin(i).count("1") & 1 for i in range(4096)], np.uint8)
    words = np.concatenate([bits + 97, 98 - bits])
    for seed in substring._SEEDS:
        one, two = word_hashes(words, np.array([0, 4096]), np.array([4096, 8192]), seed)
        assert one != two
    r_ = random.Random(1)
    raw = [bytes(r_.randrange(97, 100) for _ in range(r_.randrange(1, 30))) for _ in range(3000)]
    joined = np.frombuffer(b" ".join(raw), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in raw]) - 1
    found = word_hashes(joined, ends - [len(w) for w in raw], ends, 7).tolist()
    assert len(set(found)) == len(set(raw)) == len(set(zip(raw, found)))


def test_texts_without_shared_chunks_are_stored_where_they_are_read(spark, tmp_path):
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    say = lambda n: " ".join(r.choice("abcdefgh") + str(r.randrange(10**9)) for _ in range(n))
    texts = [say(2000) for _ in range(40)]
    texts += [texts[3], texts[3][:15_000] + say(500), "", None]
    before = shuffled()
    media.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f"{tmp_path}/store")
    assert shuffled() - before < 0.25 * sum(len(t or "") for t in texts) / 2  # compressed they are about half as long
    got = {x.doc_id: x.media_sha256 for x in media.read(spark.read.parquet(f"{tmp_path}/store")).collect()}
    assert got == {k: hashlib.sha256(media.to_media((t or "").encode())).hexdigest() for k, t in enumerate(texts)}


@pytest.mark.parametrize("most", [1, 64])
def test_a_full_filter_loses_no_mark(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(media, "FILTER_MOST", 64 * most)
    say = lambda n: " ".join(r.choice("abcdefgh") + str(r.randrange(10**9)) for _ in range(n))
    one = say(3000)
    texts = [one[: 1000 * k] for k in range(20)] * 2 + [say(50) for _ in range(100)]
    media.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f"{tmp_path}/store")
    stored = spark.read.parquet(f"{tmp_path}/store")
    digests = [[media.digest(c) for c in media.chunks(t.encode())[1]] for t in texts]
    assert stored.select("_n").distinct().count() == len(texts)
    assert sum(len(x.shared) for x in stored.collect()) == sum(n > 1 for n in Counter(d for ds in digests for d in ds).values())
    got = {x.doc_id: x.media_sha256 for x in media.read(stored).collect()}
    assert got == {k: hashlib.sha256(media.to_media(t.encode())).hexdigest() for k, t in enumerate(texts)}


def test_a_whole_table_is_one_run_of_the_index(spark, monkeypatch):
    saved, save = [], substring.WindowIndex._save
    monkeypatch.setattr(substring.WindowIndex, "_save", lambda self, df, name, *a: (saved.append(name), save(self, df, name, *a))[1])
    words = [str(k) for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(words[k : k + 30])) for k in range(9)], "doc_id long, text string")
    got = {x.doc_id: x.text for x in substring.without_repeats(docs).collect()}
    assert len(saved) == 2  # the log of texts and one run, nothing to compact
    assert got == {k: " ".join(words[k : k + 30]) if k == 0 else words[k + 29] for k in range(9)}
