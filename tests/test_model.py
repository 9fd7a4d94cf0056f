import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import nodes_of, plan_of
from verdictflow.functions.text import VOCABULARY
from verdictflow.operators import learning, model, scorer

TRAINING = [
    ("1", "you were rude rude to them", 1),
    ("2", "kind words help", 0),
    ("3", "rude again", 1),
    ("4", "", 0),
    ("5", "help was kind kind", 0),
]
TEXTS = [("a", "Rude! kind of rude"), ("b", ""), ("c", None), ("d", "never seen before"), ("e", "kind " * 5000)]


def word_ids(text):
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    return [zlib.crc32(w.encode()) % VOCABULARY for w in found]


def plain_model():
    pos, neg = {}, {}
    for _, text, label in TRAINING:
        side = pos if label else neg
        for i in word_ids(text):
            side[i] = side.get(i, 0) + 1
    n_pos, n_neg = sum(pos.values()) + VOCABULARY, sum(neg.values()) + VOCABULARY
    micro = lambda x: math.floor(abs(x) * 1e6 + 0.5) * (1 if x >= 0 else -1)
    weights = {
        i: micro(math.log((pos.get(i, 0) + 1) / n_pos) - math.log((neg.get(i, 0) + 1) / n_neg))
        for i in {*pos, *neg}
    }
    labels = [label for *_, label in TRAINING]
    bias = micro(math.log((sum(labels) + 1) / (len(labels) - sum(labels) + 1)))
    return weights, bias, micro(math.log(n_neg / n_pos))


def frames(spark):
    training = spark.createDataFrame(TRAINING, "submission_id string, combined_text string, label int")
    posts = spark.createDataFrame(TEXTS, "submission_id string, combined_text string")
    return training, posts


def test_weights_and_scores_equal_the_plain_computation(spark):
    training, posts = frames(spark)
    weights, bias, unseen = plain_model()
    trained = model.train_weights(training)
    rows = trained.collect()
    assert {r.feature: r.weight_micro for r in rows} == weights
    assert {r.bias_micro for r in rows} == {bias} and {r.unseen_micro for r in rows} == {unseen}
    got = {r.submission_id: r.logits for r in model.score(posts, trained).collect()}
    for name, text in TEXTS:
        want = (bias + sum(weights.get(i, unseen) for i in word_ids(text))) / 1e6
        assert got[name] == (want if text is not None else None)


def test_scoring_is_a_projection(spark):
    training, posts = frames(spark)
    scored = model.score(posts, model.train_weights(training))
    scored.collect()
    nodes = nodes_of(scored)
    assert not [n for n in nodes if "Exchange" in n or "Join" in n or "Python" in n], nodes
    plan = plan_of(scored)
    assert "_weights" not in plan, "no row may carry the weights"
    assert "ReusedSubquery" in plan


def test_python_scorer_equals_the_projection(spark):
    training, posts = frames(spark)
    trained = model.train_weights(training)
    fixed = model.dense_model(trained).first()
    weights, bias = np.array(fixed["weights"], dtype=np.int64), fixed["bias_micro"]
    assert len(weights) == VOCABULARY
    posts = posts.fillna("")
    load = lambda: scorer.linear_scorer(bias, weights, model.UNIT)
    got = scorer.score_with(scorer.encode(posts), load)
    assert got.columns == ["submission_id", "combined_text", "logits"]
    native = model.score(posts, trained)
    assert sorted(got.select("submission_id", "logits").collect()) == sorted(
        native.select("submission_id", "logits").collect()
    )


def test_empty_model_and_empty_input(spark):
    training, posts = frames(spark)
    nothing = model.train_weights(training.limit(0))
    assert {r.logits for r in model.score(posts.fillna(""), nothing).collect()} == {0.0}
    assert model.score(posts.limit(0), model.train_weights(training)).count() == 0


def test_token_counts(spark):
    _, posts = frames(spark)
    rows = {r.submission_id: r for r in model.token_counts(posts.fillna("")).collect()}
    assert (rows["e"].n_tokens, rows["e"].n_used) == (5000, 4096)
    assert (rows["b"].n_tokens, rows["a"].n_tokens) == (0, 4)
    lengths = model.token_length_stats(model.token_counts(posts.fillna(""))).first()
    assert (lengths.max_tokens, lengths.min_tokens) == (5000, 0)


def test_pipeline_learns_a_separable_set(spark):
    rows = [(str(i), "rude shout" if i % 2 else "kind help", i % 2) for i in range(40)]
    training = spark.createDataFrame(rows, "submission_id string, combined_text string, label int")
    fitted = learning.train_pipeline(training, reg=0.01)
    scored = learning.predict_logits(fitted, training)
    assert scored.filter("pred = label").count() == 40
    assert scored.filter("(logits > 0) <> (label = 1)").count() == 0


def test_one_setting_per_run():
    assert learning.setting(0)[0] in learning.SETTINGS and len(learning.SETTINGS) == 9
