"""Stored models, scorer steps, and the model that stays partitioned."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import nodes_of
from verdictflow.operators import model, scorer
from verdictflow.plans import monitor, predict, training
from verdictflow.schemas import POSTS
from verdictflow.sources import tables
from verdictflow.sources.models import ModelStore
from verdictflow.streaming import scoring

RUN = "2024-03-01"


@pytest.fixture
def posts(make_posts):
    rows = [
        (i, f"title {i}", ("rude words " if i % 4 < 2 else "kind words ") * (i + 1), [None, "YTA", "nta"][i % 3], i)
        for i in range(30)
    ]
    return make_posts(rows)


def logits(df):
    return sorted((r.submission_id, r.logits) for r in df.collect())


@pytest.mark.parametrize("vocabulary", [1, 7, 5000, 1 << 20])
def test_save_and_load(spark, posts, tmp_path, vocabulary):
    rows = model.train_weights(training.training_posts(posts), vocabulary=vocabulary)
    store = ModelStore(spark, str(tmp_path))
    assert store.save(rows, vocabulary, name="first") == 0
    assert store.save(rows.limit(0), vocabulary) == 1
    stored = store.load(0)
    assert (stored.version, stored.vocabulary, stored.settings) == (0, vocabulary, {"name": "first"})
    assert store.load().version == 1 and store.load().settings == {}
    texts = posts.select("submission_id", F.col("selftext").alias("combined_text"))
    expected = logits(model.score(texts, rows, vocabulary=vocabulary))
    assert logits(stored.step()(texts)) == logits(stored.python_step()(texts)) == expected
    assert {x for _, x in logits(store.load().step()(texts))} == {0.0}
    by_join = model.score_by_join(texts, rows, vocabulary=vocabulary)
    assert logits(by_join) == expected


def test_a_missing_model_is_an_error(spark, tmp_path):
    with pytest.raises(LookupError):
        ModelStore(spark, str(tmp_path)).load()


def test_joined_scores_of_odd_texts_and_hot_words(spark, monkeypatch):
    monkeypatch.setattr(model, "HOT_SHARE", 3)
    training_rows = spark.createDataFrame(
        [("the the the the rude", 1), ("the kind", 0), ("the the", 0)], "combined_text string, label int"
    )
    rows = model.train_weights(training_rows)
    texts = spark.createDataFrame(
        [("a", "the the rude new"), ("b", ""), ("c", None), ("d", "the " * 300)], "submission_id string, combined_text string"
    )
    hot = model.hot_ids(rows, 3).collect()
    assert len(hot) == 1 and hot[0].pieces == 3
    got, want = (dict(map(tuple, s.select("submission_id", "logits").collect())) for s in (model.score_by_join(texts, rows), model.score(texts, rows)))
    assert got == want and got["c"] is None


def test_the_partitioned_model_is_not_broadcast(spark, posts, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = model.train_weights(training.training_posts(posts))
    texts = posts.select("submission_id", F.col("selftext").alias("combined_text"))
    scored = model.score_by_join(texts, rows)
    scored.collect()
    assert "ShuffledHashJoin" in nodes_of(scored)
    # What is broadcast are the hot ids, on both sides.
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2


def test_jobs_take_a_store_and_a_step(spark, posts, tmp_path):
    store = ModelStore(spark, f"{tmp_path}/models")
    rows = training.weights_for(posts)
    store.save(rows)
    by_rows = predict.predict(posts, tables.pending_table(spark, "none").read(), rows, RUN)
    for given in (store, store.load().python_step()):
        result = predict.predict(posts, tables.pending_table(spark, "none").read(), given, RUN)
        assert logits(result.scored) == logits(by_rows.scored)
        log = monitor.log_rows(monitor.decided_batch(posts), given)
        assert logits(log) == logits(monitor.log_rows(monitor.decided_batch(posts), rows))


def test_a_stream_takes_the_newer_model(spark, posts, tmp_path):
    path, checkpoint = f"{tmp_path}/scores", f"{tmp_path}/checkpoint"
    store = ModelStore(spark, f"{tmp_path}/models")
    rows = training.weights_for(posts)
    store.save(rows.limit(0))
    number = F.col("submission_id").cast("int")
    feed = f"{tmp_path}/posts"
    posts.filter(number < 10).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(POSTS).parquet(feed)
    scoring.score_stream(stream, store, path, checkpoint).awaitTermination()
    store.save(rows)
    posts.filter(number >= 10).write.mode("append").parquet(feed)
    scoring.score_stream(stream, store, path, checkpoint).awaitTermination()
    got = {int(r.submission_id): r.logits for r in spark.read.parquet(path).collect()}
    assert len(got) == 30 and {got[i] for i in range(10)} == {0.0}
    newer = predict.score_posts(posts, rows, RUN).collect()
    assert all(got[int(r.submission_id)] == r.logits for r in newer if int(r.submission_id) >= 10)


def test_a_step_of_ones_own(posts):
    step = lambda rows: rows.withColumn("logits", F.lit(2.0))
    assert scorer.as_step(step) is step
    assert {r.pred for r in predict.score_posts(posts, step, RUN).collect()} == {1}
