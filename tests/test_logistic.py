"""Logistic training, setting selection and the naive-Bayes pipeline against plain computations."""

import math
import re
import time
import zlib
from collections import Counter

import pytest

from tests.conftest import nodes_of
from verdictflow.operators import learning, logistic

POSTS = [
    ("1", "you were rude rude to them", 1),
    ("2", "kind words help", 0),
    ("3", "rude again", 1),
    ("4", "", 0),
    ("5", "help was kind kind", 0),
    ("6", None, 1),
]
SCHEMA = "submission_id string, combined_text string, label int"


def ids(text):
    return [zlib.crc32(w.encode()) % logistic.VOCABULARY for w in re.findall(r"[^\W\d_]+", (text or "").lower())]


def half_up(x):
    return math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)


def plain_features(text):
    counts = Counter(ids(text))
    length = math.sqrt(sum(n * n for n in counts.values()))
    return {**{i: half_up(n * 1000 / length) for i, n in sorted(counts.items())}, logistic.BIAS: 1000}


def plain_fit(rows, settings, epochs, rate):
    weights = [{} for _ in settings]
    for _ in range(epochs):
        for k, (reg, mixing) in enumerate(settings.values()):
            gradient = Counter()
            for _, text, label in rows:
                own = plain_features(text)
                margin = sum(v * weights[k].get(i, 0) for i, v in own.items()) / 1e9
                residual = half_up((label - 1 / (1 + math.exp(-margin))) * 1e6)
                for i, v in own.items():
                    gradient[i] += v * residual
            after = {}
            for i, g in gradient.items():
                bias = i == logistic.BIAS
                shrunk = weights[k].get(i, 0) * (1.0 if bias else 1 - rate * reg * (1 - mixing))
                moved = shrunk + g / (len(rows) * 1000.0) * rate
                cut = 0.0 if bias else rate * reg * mixing * 1e6
                after[i] = half_up(math.copysign(max(abs(moved) - cut, 0.0), moved))
            weights[k] = after
    return weights


def test_features_count_each_id_once(spark):
    posts = spark.createDataFrame(POSTS, SCHEMA)
    rows = logistic.with_features(posts).collect()
    assert rows[0].asDict().keys() == {"submission_id", "label", "features"}
    for row, (_, text, _) in zip(sorted(rows), POSTS):
        assert [tuple(f) for f in row.features] == list(plain_features(text).items())


def test_features_of_a_long_text_take_linear_time(spark):
    text = " ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(60_000))
    posts = spark.createDataFrame([("1", text, 1)], SCHEMA)
    logistic.with_features(posts.limit(0)).collect()
    began = time.monotonic()
    (row,) = logistic.with_features(posts).collect()
    assert time.monotonic() - began < 15
    assert [tuple(f) for f in row.features] == list(plain_features(text).items())


def test_training_equals_the_plain_computation(spark):
    settings = {"none": (0.0, 0.0), "ridge": (0.05, 0.0), "lasso": (0.02, 1.0), "both": (0.05, 0.5)}
    rows = logistic.with_features(spark.createDataFrame(POSTS, SCHEMA))
    got = logistic.fit(rows, settings, epochs=4, rate=1.5).collect()
    expected = plain_fit(POSTS, settings, 4, 1.5)
    for k in range(len(settings)):
        assert {r.feature: r.weights[k] for r in got} == expected[k]


def test_training_separates(spark):
    rows = [(str(i), "rude shout" if i % 2 else "kind help", i % 2) for i in range(40)]
    features = logistic.with_features(spark.createDataFrame(rows, SCHEMA))
    scored = logistic.score(features, logistic.fit(features, epochs=10))
    assert scored.filter("(logits > 0) <> (label = 1)").count() == 0
    assert scored.columns == ["submission_id", "label", "logits"]


def test_margins_are_a_projection(spark):
    features = logistic.with_features(spark.createDataFrame(POSTS, SCHEMA))
    judged = logistic.with_margins(features, logistic.fit(features, epochs=1), 1)
    judged.collect()
    assert not [n for n in nodes_of(judged) if "Exchange" in n or "Join" in n or "Python" in n]


def test_settings_are_judged_together_and_ties_go_by_name(spark):
    rows = [(str(i), "rude shout" if i % 2 else "kind help", i % 2) for i in range(40)]
    features = logistic.with_features(spark.createDataFrame(rows, SCHEMA))
    settings = {"b": (0.0, 0.0), "a": (0.0, 0.0), "all_cut": (9.0, 1.0)}
    got = {r.setting: r for r in logistic.select_setting(features, features, settings, threshold=0.0).collect()}
    assert got["a"].accuracy == got["b"].accuracy == 1.0 and got["all_cut"].accuracy == 0.5
    assert [r.setting for r in got.values() if r.best] == ["a"]
    nothing = logistic.select_setting(features, features.limit(0), settings).collect()
    assert {r.accuracy for r in nothing} == {None} and [r.setting for r in nothing if r.best] == ["a"]


def test_no_rows_give_no_weights(spark):
    features = logistic.with_features(spark.createDataFrame(POSTS, SCHEMA).limit(0))
    assert logistic.fit(features, epochs=2).collect() == []


def test_bayes_pipeline_equals_the_closed_form(spark):
    posts = spark.createDataFrame(POSTS, SCHEMA).fillna("")
    scored = learning.margin_of(learning.bayes_pipeline().fit(posts), posts).collect()
    side = {1: Counter(), 0: Counter()}
    for _, text, label in POSTS:
        side[label].update(i for i in ids(text))
    size = {c: sum(side[c].values()) + learning.VOCABULARY for c in side}
    labels = Counter(label for *_, label in POSTS)
    prior = math.log(labels[1] + 1) - math.log(labels[0] + 1)
    for row, (_, text, _) in zip(sorted(scored), POSTS):
        odds = sum(
            math.log((side[1][i] + 1) / size[1]) - math.log((side[0][i] + 1) / size[0]) for i in ids(text)
        )
        assert row.logits == pytest.approx(prior + odds, abs=1e-9)
        assert row.pred == int(row.logits > 0.5)
