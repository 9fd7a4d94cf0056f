"""Byte-pair merges and the coverage curve against plain computations."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import nodes_of
from verdictflow.operators import stats, subwords

TEXTS = [("1", "low lower lowest low"), ("2", "newer newest wide"), ("3", ""), ("4", None), ("5", "aaaa aaa aa ab ab")]


def plain_merges(texts, n, least=2):
    words = Counter(w for _, t in texts for w in (t or "").split())
    split = {w: list(w) for w in words}
    merges = []
    for _ in range(n):
        pairs = Counter()
        for w, s in split.items():
            for pair in zip(s, s[1:]):
                pairs[pair] += words[w]
        best = min(pairs, key=lambda p: (-pairs[p], p), default=None)
        if best is None or pairs[best] < least:
            break
        merges.append((*best, pairs[best]))
        for w, s in split.items():
            out = []
            while s:
                take = 2 if tuple(s[:2]) == best else 1
                out.append("".join(s[:take]))
                s = s[take:]
            split[w] = out
    return merges, split


@pytest.mark.parametrize("n", [0, 1, 5, 100])
def test_merges_equal_the_plain_computation(spark, n, monkeypatch):
    monkeypatch.setattr(subwords, "STAGE_EVERY", 3)
    posts = spark.createDataFrame(TEXTS, "submission_id string, combined_text string")
    merges, table = subwords.learn(subwords.word_table(posts), n)
    expected, split = plain_merges(TEXTS, n)
    assert merges == expected
    assert {r.word: r.symbols for r in table.collect()} == {w: "".join(f"<{x}>" for x in s) for w, s in split.items()}
    counts = {r.submission_id: (r.n_tokens, r.n_used) for r in subwords.subword_counts(posts, table, limit=6).collect()}
    for name, text in TEXTS:
        total = None if text is None else sum(len(split[w]) for w in text.split())
        assert counts[name] == (total, None if total is None else min(total, 6))
    tokens = posts.select("submission_id", subwords.subwords("combined_text", merges).alias("t")).collect()
    for name, t in tokens:
        text = dict(TEXTS)[name]
        assert t == (None if text is None else [x for w in text.split() for x in split[w]])


@pytest.mark.parametrize("share", [1, 4, 1000])
def test_counts_by_join_and_in_texts(spark, share, monkeypatch):
    """Every share of frequent words gives the counts of the plain computation, and so do the merges in texts."""
    monkeypatch.setattr(subwords, "FREQUENT_SHARE", share)
    texts = [*TEXTS, ("6", "The the, THE lower; \u00e9t\u00e9 \U00020000\U00020000 it's"), ("6", "low 12 low"), (None, "low")]
    posts = spark.createDataFrame(texts, "submission_id string, combined_text string")
    plain = [(name, None if t is None else re.sub(r"[^a-z\u00e9\U00020000]+", " ", t.lower())) for name, t in texts]
    expected, split = plain_merges(plain, 7)
    merges, table = subwords.learn(subwords.word_table(posts), 7)
    assert merges == expected
    sums = Counter()
    for name, text in plain:
        if name is not None:
            sums[name] += sum(len(split[w]) for w in (text or "").split())
    counted = sorted((n or "", None if t is None else sums[n]) for n, t in texts)
    for given in (None, merges):
        rows = subwords.subword_counts(posts, table, merges=given).collect()
        assert sorted((r.submission_id or "", r.n_tokens) for r in rows) == counted


@pytest.mark.parametrize("text", ["aaaaa baaab aa", "abab ababab bab", "aabaa aab", "abcabc cabc"])
def test_pairs_recounted_equal_those_counted_anew(spark, text):
    table = subwords.word_table(spark.createDataFrame([("1", text)], "submission_id string, combined_text string"))
    counts = subwords.pair_counts(table)
    for left, right in [("a", "a"), ("a", "b"), ("b", "a")]:
        again = table.withColumn("symbols", subwords.merged(F.col("symbols"), left, right))
        assert {*subwords.recounted(counts, table, left, right).collect()} == {*subwords.pair_counts(again).collect()}


def test_a_round_counts_only_words_that_hold_its_pair(spark, monkeypatch):
    """The pairs of all words are counted once, whatever the number of rounds."""
    calls, whole = [], subwords.pair_counts
    monkeypatch.setattr(subwords, "pair_counts", lambda table: calls.append(1) or whole(table))
    posts = spark.createDataFrame(TEXTS, "submission_id string, combined_text string")
    merges, _ = subwords.learn(subwords.word_table(posts), 5)
    assert len(merges) == 5 and len(calls) == 1


def test_coverage_curve(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([-2.0, 0.5, 1.5, rng.uniform(-3, 3)]), rng.choice([0.0, 1.0, 2.0, None])) for i in range(500)]
    rows += [(501, None, 1.0), (502, float("nan"), 1.0)]
    frame = spark.createDataFrame(rows, "submission_id int, logits double, outcome double")
    frame = frame.withColumn("accurate", (F.col("logits") > 0.5).cast("double").eqNullSafe(F.col("outcome")).cast("int"))
    usable = [(abs(x - 0.5), int((x > 0.5) == (y == 1))) for _, x, y in rows if x is not None and x == x and y in (0, 1)]
    for partitions in (None, 1, 7):
        curve = stats.coverage_curve(frame, partitions=partitions)
        got = {r.confidence: (r.n_covered, r.success, r.coverage, r.accuracy) for r in curve.collect()}
        for level in {c for c, _ in usable}:
            part = [hit for c, hit in usable if c >= level]
            assert got.pop(level) == (len(part), sum(part), len(part) / len(usable), sum(part) / len(part))
        assert not got
    assert stats.coverage_curve(frame.limit(0)).collect() == []


def test_coverage_has_no_window_over_all_levels(spark):
    frame = spark.range(1000).selectExpr("id / 100.0D as logits", "1.0D as outcome", "1 as accurate")
    curve = stats.coverage_curve(frame)
    curve.collect()
    plan = curve._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    over_levels = [line for line in windows if "confidence" in line]
    assert over_levels and all("[part#" in line for line in over_levels)
    assert "BroadcastHashJoin" in nodes_of(curve)
