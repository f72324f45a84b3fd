from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarryline.llm import mixing
from quarryline.llm.mixing import budgets, encoder, mixture, shares, token_counts

DDL = "doc_id bigint, text string, source string, tokens string, copies string"


def corpus(spark, n=400):
    rnd = random.Random(3)
    rows = [(i, None if i % 61 == 0 else "" if i % 67 == 0 else " ".join(rnd.choice(["alpha", "12", "Straße", "don't"]) for _ in range(rnd.randrange(1, 60))), rnd.choice(["big", "big", "big", "mid", "small" if i % 9 == 0 else "big", None, "untargeted"]), "x", "y") for i in range(n)]
    return rows, spark.createDataFrame(rows + rows[:5], DDL)


TARGETS = [("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("absent", 0.1, 5)]


def test_budgets():
    b = budgets({"a": 100, "b": 100}, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert b == {"a": 100, "b": 100}
    b = budgets({"a": 1000, "b": 10}, [("a", 0.5, 1), ("b", 0.5, 3), ("none", 0.2, 1)])
    assert b == {"a": 980, "b": 30}
    b = budgets({"a": 1000, "b": 500}, [("a", 0.25, 1), ("b", 0.75, 2)], 800)
    assert b == {"a": 200, "b": 600}
    assert budgets({}, [("a", 1.0, 1)]) == {}


def test_budgets_that_meet_all_shares():
    b = budgets({"a": 1000, "b": 10, "c": 50}, [("a", 0.6, 1), ("b", 0.1, 3), ("c", 0.2, 2), ("none", 0.1, 1)], mixing.SHARES)
    assert b == pytest.approx({"a": 180, "b": 30, "c": 60})
    assert budgets({}, [("a", 1.0, 1)], mixing.SHARES) == {}


@pytest.mark.parametrize("weight", [1e-6, 0.05, 0.3, 1.0, 1000.0])
def test_no_bin_holds_a_hundredth_of_a_source(spark, weight):
    """Whatever the scale of the weights, so that the bin a budget ends in stays small."""
    u = (F.pmod(F.xxhash64(F.lit(1), "id", F.lit(7)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    at = F.floor(F.log2(-F.log(u) / weight) * mixing.BINS)
    sizes = spark.range(200_000).groupBy(at.alias("b")).count().collect()
    assert max(r["count"] for r in sizes) < 0.006 * 200_000 and len(sizes) < 64 * mixing.BINS


def test_quality_weight(spark):
    prose = " ".join(f"Sentence {'abcdefgh'[i % 8]} tells of quarries near rivers.\n" for i in range(30))
    texts = [prose, "line again\n" * 60, "1234 5678 !!! " * 40, "short text", "", None, "x" * 400]
    got = [r.w for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", mixing.quality_weight().alias("w")).orderBy("i").collect()]
    assert got[0] > 0.2 and all(g <= got[0] / 3 for g in got[1:]) and got[4] == got[5] == 0.05 and all(0.05 <= g <= 1 for g in got)


def test_mixture_that_meets_all_shares(spark):
    rows, df = corpus(spark, 3000)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    said = {r.source: r for r in shares(mixture(df, targets, mixing.SHARES), targets).collect()}
    whole = sum(share for s, share, _ in TARGETS if s != "absent")
    for s, share, most in TARGETS[:3]:
        assert said[s].actual_share == pytest.approx(share / whole, rel=0.02) and said[s].most_copies <= most


def test_tokens_of_long_texts_are_exact():
    enc = encoder(mixing.TOKENIZER)
    rnd = random.Random(1)
    for text in (" ".join(rnd.choice(["word", "a", "12", "  ", "\n\n"]) for _ in range(3000)), "x" * 500, "a  b   c " * 300):
        assert sum(len(enc.encode_ordinary(p)) for p in mixing._pieces(text, 100)) == len(enc.encode_ordinary(text))
        assert "".join(mixing._pieces(text, 100)) == text


def test_mixture(spark):
    rows, df = corpus(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    counts = {(r.doc_id, r.source): r.tokens for r in token_counts(df).collect()}
    total = Counter()
    for (_, s), n in counts.items():
        total[s] += n * (2 if (_ < 5) else 1)
    out = mixture(df, targets).collect()
    caps = {s: r for s, _, r in TARGETS}
    assert all(1 <= r.copies <= caps[r.source] for r in out)
    want = budgets(total, TARGETS)
    used = Counter()
    per = defaultdict(list)
    for r in out:
        used[r.source] += r.tokens * r.copies
        per[r.source].append(r.copies)
    longest = max(counts.values())
    for s, b in want.items():
        assert abs(used[s] - b) <= longest / 2 + 1, s
        assert max(per[s]) - min(per[s]) <= 1
    assert set(used) == {"big", "mid", "small"}
    again = {(r.doc_id, r.copies) for r in mixture(df, targets).collect()}
    assert again == {(r.doc_id, r.copies) for r in out}
    said = {r.source: r for r in shares(mixture(df, targets), targets).collect()}
    assert said["absent"].tokens == 0 and abs(sum(r.actual_share for r in said.values()) - 1) < 1e-9
    assert said["big"].tokens == used["big"] and said["big"].actual_share == pytest.approx(used["big"] / sum(used.values()))


def test_weights_decide_who_is_drawn(spark):
    rows = [(i, "one two three four", "s", "x", "y") for i in range(2000)]
    df = spark.createDataFrame(rows, DDL)
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    size = sum(r.tokens for r in token_counts(df).collect()) // 4
    heavy = F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.1)
    picked = [r.doc_id for r in mixture(df, targets, size=size, weight=heavy).collect()]
    assert abs(len(picked) - 500) <= 1
    # Drawn one by one with odds of nine to one, some 85 % of 500 are even.
    assert 0.8 < sum(i % 2 == 0 for i in picked) / len(picked) < 0.92
    even = [r.doc_id for r in mixture(df, targets, size=size, weight=F.lit(1.0)).collect()]
    assert 0.43 < sum(i % 2 == 0 for i in even) / len(even) < 0.57


def test_two_level_sums_equal_one_sort(spark, monkeypatch):
    _, df = corpus(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    fine = {(r.doc_id, r.copies) for r in mixture(df, targets, size=3000).collect()}
    monkeypatch.setattr(mixing, "BINS", 1)
    assert fine == {(r.doc_id, r.copies) for r in mixture(df, targets, size=3000).collect()}
    monkeypatch.setattr(mixing, "PARTS", 1)
    assert fine == {(r.doc_id, r.copies) for r in mixture(df, targets, size=3000).collect()}


def test_nothing_to_mix(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    none = spark.createDataFrame([], DDL)
    assert mixture(none, targets).collect() == []
    assert {r.actual_share for r in shares(mixture(none, targets), targets).collect()} == {0.0}
    _, df = corpus(spark, 50)
    assert mixture(df, targets.limit(0)).collect() == []
