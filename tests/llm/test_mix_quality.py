import re

import pytest

from tessera.llm import mix, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights=(1, 2, 3), cap=3):
    """Targets by the rule as it is told: share, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over


def test_targets_and_taken_words(spark):
    rows = [(i, "w " * (1 + i % 7), ["a", "b", None, "c", "tiny"][0 if i % 3 == 0 else i % 5], "extra") for i in range(400)]
    rows += [(400, None, "empty", ""), (401, "", "a", ""), (None, "x y", "a", ""), (5, "w w", "a", ""), (5, "w w", "a", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mix.plan_mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(WORD.findall(r[1] or ""))
    want = fill(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 0.5
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
    first = [r.positions[0] for r in got if r.positions]
    assert first == sorted(first) and all(0 <= p <= 1 for p in first)


def test_stream_has_whole_copies(spark):
    rows = [(i, f"text {i} " * 4, "s%d" % (i % 4 if i > 50 else 0), "p") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, positions string")
    stream = mix.mixed(df).collect()
    assert {tuple(r) for r in stream} <= set(rows)
    plan = {r.doc_id: r for r in mix.plan_mix(df, whole=True).collect()}
    for i, row in enumerate(rows):
        assert sum(r.doc_id == row[0] for r in stream) == len(plan[row[0]].positions)


def test_curriculum_is_followed(spark):
    from pyspark.sql import functions as F

    knots = ((0.0, 2.0), (0.5, 1.0), (1.0, 0.0))
    total = 0.75 + 0.25
    at = spark.range(101).select((F.col("id") / 100).alias("x")).withColumn("t", mix.demand_inverse(knots, F.col("x"))).collect()
    for r in at:
        t = r.t
        area = 2 * t - t * t if t <= 0.5 else 0.75 + (t - 0.5) - (t - 0.5) ** 2
        assert area / total == pytest.approx(r.x, abs=1e-6)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix.plan_mix(df).count() == 0 and mix.mixed(df).count() == 0
    nothing = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mix.plan_mix(nothing).collect()] == [0, 0]


def brute(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " ", "one", "a b c a b c", "a a a a a", "x y z\nx y z\n\n \nq", "é ü 🙂 #*$%&|<>", "a b c d " * 40, "A B " * 60, "w " * 2000 + "\n" * 50, "\x1c \x85 a\x0bb"]


def test_measurements(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    for r in quality.ledger(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(TEXTS[r.doc_id])
        assert bool(r.failed & 1) == (r.n_words < 50)
        assert bool(r.failed & 2) == (100 * r.n_repeat_words > 50 * r.n_words)


def test_policies_and_ablations(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    entries = quality.ledger(df)
    for mask in quality.POLICIES.values():
        rows = quality.apply_policy(entries, mask).collect()
        assert all(r.kept == (r.failed & mask == 0) for r in rows)
        for a in quality.ablations(entries, mask).collect():
            bit = next(1 << x.bit for x in quality.RULES if x.name == a.rule)
            assert a.n_failed == sum(bool(r.failed & mask & bit) for r in rows)
            assert a.n_only == sum(r.failed & mask == bit for r in rows)
    empty = quality.ablations(quality.ledger(df.limit(0)), 63).collect()
    assert all(r.n_failed == 0 and r.n_only == 0 for r in empty)
