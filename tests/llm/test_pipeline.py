import hashlib
import random
from collections import Counter

import public_tokenizers

from tests.llm.test_dedup_media_lang import brute as without
from tests.llm.test_mix_quality import WORD, fill

r = random.Random(21)


def table(n=140):
    speech = {"en": "the of and thing ation".split(), "fr": "le la eau çou mentre".split(), "de": "der ung schtz keit für".split()}
    say = lambda lang, k: [r.choice(speech[lang]) + r.choice("abcdefgh") for _ in range(k)]
    passage, rows = say("en", 60), []
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        words = say(lang, r.randrange(30, 120))
        if lang == "en" and i % 4 == 0:
            words[10:10] = passage
        rows.append([i, " ".join(words), lang, "s%d" % (i % 5 if i % 2 else 0), 0])
    rows[9][1] = rows[3][1]
    rows[12][1] = rows[3][1]
    rows[20][1], rows[21][1], rows[22][1] = None, "", "12 34 !!"
    rows[30][3] = None
    for x in rows:
        x[4] = len(x[1] or "")
    return [tuple(x) for x in rows]


def test_against_brute_force(spark, tmp_path):
    import base64

    import tiktoken

    import corpus_pipeline
    from tessera.llm import langid, mix, simhash

    rows = table()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    bad = {x.doc_id for x in langid.identify(docs, langid.fit(docs)).collect() if x.rejected}
    assert bad == {20, 21, 22}
    kept = [x for x in rows if x[0] not in bad]
    fps = [simhash.fingerprint(x[1]) for x in kept]
    first = {}
    for i, x in enumerate(kept):
        near = [j for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
        first[i] = first[near[0]] if near else i
    kept = [x for i, x in enumerate(kept) if first[i] == i]
    assert {9, 12}.isdisjoint({x[0] for x in kept}) and len(kept) == len(rows) - 5
    sums = without([(x[0], x[1]) for x in kept])
    clean = {x.doc_id: x for x in corpus_pipeline.substrings(spark, spark.createDataFrame(kept, schema), "").collect()}
    for x in kept:
        c = clean[x[0]]
        assert (c.lang, c.source, c.n_chars) == (x[2], x[3], len(c.text))
        assert hashlib.sha256(b" ".join(c.text.encode().split())).hexdigest() == sums[x[0]][2]
    sizes = Counter()
    for c in clean.values():
        sizes[c.source] += len(WORD.findall(c.text))
    want = fill(sizes)
    order = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in clean}
    copies = Counter()
    for s in sizes:
        goal, at = int(want[s] + 0.5), 0
        for c in sorted((c for c in clean.values() if c.source == s), key=lambda c: order[c.doc_id]):
            size = len(WORD.findall(c.text))
            part = min(max(goal - goal // sizes[s] * sizes[s] - at, 0), size)
            copies[c.doc_id] = (goal // sizes[s] + (part * 2 >= size)) if size else 0
            at += size
    assert Counter(x.doc_id for x in got) == +copies
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for x in got:
        ids = lib.encode_ordinary(clean[x.doc_id].text)
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_null_and_shared_ids_in_near_duplicates(spark):
    import corpus_pipeline
    from tessera.llm import simhash

    say = lambda k: " ".join(r.choice("abcdefgh") + str(r.randrange(10**6)) for _ in range(k))
    one, two, three, four, five, six = (say(200) for _ in range(6))
    near, sixth = one.upper(), six.upper()
    assert simhash.fingerprint(one) == simhash.fingerprint(near) and simhash.fingerprint(six) == simhash.fingerprint(sixth)
    rows = [(1, one), (None, near), (None, two), (None, two), (None, three), (7, four), (7, five), (7, four), (8, five), (9, six), (9, sixth)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len(got) == 6 and {t for _, t in got} - {six, sixth} == {one, two, three, four, five}
    assert sorted((i for i, _ in got), key=lambda i: i or 99) == [1, 7, 7, 9, None, None]


def test_stages_of_nothing(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
