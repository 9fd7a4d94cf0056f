from datetime import date

import pytest
from pyspark.sql import functions as F

from verdictflow.operators import model
from verdictflow.plans import assess, monitor, predict, training
from verdictflow.schemas import PENDING
from verdictflow.sources import tables

RUN = "2024-03-01"


@pytest.fixture
def posts(make_posts):
    rows = []
    for i in range(60):
        flair = [None, "YTA", "nta", None, "ESH", ""][i % 6]
        word = "rude" if i % 4 < 2 else "kind"
        body = f"{word} words " * (i + 1)
        rows.append((i, f"title {i}", body, flair, i))
    return make_posts(rows)


@pytest.fixture
def weights(posts):
    return training.weights_for(posts)


@pytest.fixture
def stores(spark, tmp_path):
    root = str(tmp_path)
    return tables.pending_table(spark, root), tables.outbox(spark, root)


def test_predict_publishes_and_remembers(posts, weights, stores):
    state, box = stores
    result = predict.run_predict(posts, state, box, weights, RUN)
    assert result.scored.count() == 20
    assert state.read().count() == 2 and box.read().count() == 2
    published = {r.title for r in result.published.collect()}
    assert {r.title for r in state.read().collect()} == published
    again = predict.run_predict(posts, state, box, weights, RUN)
    assert again.scored.count() == 18
    assert not published & {r.title for r in again.published.collect()}
    assert state.read().count() == 4 and box.read().count() == 4


def test_predict_sends_what_a_stopped_run_left(posts, weights, stores):
    state, box = stores
    result = predict.predict(posts, state.read(), weights, RUN)
    state.write(result.pending)
    assert box.read().count() == 0
    predict.run_predict(posts, state, box, weights, RUN)
    assert box.read().count() == state.read().count() == 4


def test_predict_dry_run_and_options(posts, weights, stores):
    state, box = stores
    result = predict.run_predict(posts, state, box, weights, RUN, dry_run=True, n_posts=30, n_publish=1)
    assert result.published.count() == 1 and result.scored.count() == 10
    assert state.version() == -1 and box.read().count() == 0


def test_predict_without_new_posts(posts, weights, stores):
    state, box = stores
    result = predict.run_predict(posts.filter("link_flair_text = 'YTA'"), state, box, weights, RUN)
    assert (result.scored.count(), result.published.count()) == (0, 0)
    assert state.read().count() == 0


def pending_of(spark, titles):
    day = date(2024, 2, 1)
    return spark.createDataFrame(
        [(t, day, f"u{i}", day, 1.0, 1, i) for i, t in enumerate(titles)], PENDING
    )


def test_assess_moves_resolved_rows(spark, posts, stores, tmp_path):
    state, box = stores
    archive = tables.resolved_archive(spark, str(tmp_path))
    state.write(pending_of(spark, ["title 0", "title 1", "title 2", "title 4", "gone"]))
    result = assess.run_assess(state, posts, archive, box, "2024-03-01-06-00")
    graded = {r.title: r.grade for r in result.resolved.collect()}
    assert graded == {"title 1": "correct", "title 2": "incorrect", "title 4": "mistrial"}
    assert {r.title for r in state.read().collect()} == {"title 0", "gone"}
    assert archive.read().count() == 3 and box.read().filter("kind = 'update'").count() == 3
    later = assess.run_assess(state, posts, archive, box, "2024-03-02-06-00")
    assert not later.any_resolved and state.version() == 1 and archive.read().count() == 3


def test_assess_dry_run_and_repeat(spark, posts, stores, tmp_path):
    state, box = stores
    archive = tables.resolved_archive(spark, str(tmp_path))
    state.write(pending_of(spark, ["title 1"]))
    assess.run_assess(state, posts, archive, box, "r", dry_run=True)
    assert state.version() == 0 and archive.read().count() == 0 and box.read().count() == 0
    result = assess.assess(state.read(), posts)
    box.append(result.resolved, "update")
    archive.append(result.resolved, "r")
    assess.run_assess(state, posts, archive, box, "r")
    assert archive.read().count() == 1 and box.read().count() == 1 and state.read().count() == 0


def test_a_sent_prediction_still_gets_its_update(posts, weights, stores, spark, tmp_path):
    state, box = stores
    predict.run_predict(posts, state, box, weights, RUN)
    decided = posts.withColumn("link_flair_text", F.lit("YTA"))
    archive = tables.resolved_archive(spark, str(tmp_path))
    assess.run_assess(state, decided, archive, box, "r")
    kinds = sorted(r.kind for r in box.read().collect())
    assert kinds == ["ruling", "ruling", "update", "update"]


def test_monitor_logs_each_decided_post_once(spark, posts, weights, tmp_path):
    log = tables.daily_log(spark, str(tmp_path))
    rows, counts = monitor.run_monitor(posts.limit(60), log, weights, n_posts=20)
    assert rows.count() == 10 and counts.first().n_scanned == 20
    rows, counts = monitor.run_monitor(posts, log, weights)
    assert tuple(counts.first()) == (60, 10, 10)
    assert log.read().count() == 30 and log.read().select("submission_id").distinct().count() == 30
    rows, _ = monitor.run_monitor(posts, log, weights)
    assert rows.count() == 0 and log.read().count() == 30
    assert log.read().filter("outcome > 1 and accurate = 1").count() == 0


def test_a_changed_flair_does_not_change_the_log(spark, posts, weights, tmp_path):
    log = tables.daily_log(spark, str(tmp_path))
    monitor.run_monitor(posts, log, weights)
    changed = posts.withColumn(
        "link_flair_text", F.when(F.col("link_flair_text") == "YTA", "NTA").otherwise(F.col("link_flair_text"))
    )
    rows, _ = monitor.run_monitor(changed, log, weights)
    assert rows.count() == 0 and log.read().filter("outcome_str = 'YTA'").count() == 10


def test_report_upserts_the_day(spark, posts, weights, tmp_path):
    history = tables.history_table(spark, str(tmp_path))
    archive = tables.history_archive(spark, str(tmp_path))
    result = monitor.run_report(posts, weights, history, archive, RUN)
    summary = {r.outcome_type: r.n for r in result.summary.collect()}
    assert summary == {"Total": 20, "YTA": 10, "NTA": 10}
    assert history.read().count() == 3 and archive.read().count() == 3
    monitor.run_report(posts, weights, history, archive, RUN)
    assert history.read().count() == 3 and history.version() == 1
    monitor.run_report(posts, weights, history, archive, RUN, overwrite_day=False)
    assert history.version() == 1
    later = monitor.run_report(posts, weights, history, archive, "2024-03-02")
    assert history.read().count() == 6 and later.chart.count() == 2
    monitor.run_report(posts, weights, history, archive, "2024-03-03", dry_run=True)
    assert history.read().count() == 6


def test_training_beats_guessing_on_a_separable_set(make_posts):
    rows = [
        (i, "t", ("rude loud " if i % 2 else "kind quiet ") * 3, "YTA" if i % 2 else "NTA", i)
        for i in range(200)
    ]
    result = training.train(training.training_posts(make_posts(rows)))
    accuracy = {r.split: (r.n, r.accuracy) for r in result.accuracy.collect()}
    assert accuracy["test"] == (14, 1.0) and accuracy["val"] == (14, 1.0)
    smaller = training.train(training.training_posts(make_posts(rows)), drop_share=0.5)
    assert sum(r.n for r in smaller.accuracy.collect()) == 14


def test_the_anti_join_comes_before_the_scoring(posts, weights):
    """Only new undecided posts are tokenised."""
    scored = predict.score_posts(posts.filter("link_flair_text is null"), weights, RUN)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("aggregate(") < plan.index("isnull(link_flair_text")
    assert model.UNIT == 1_000_000


def test_a_report_keeps_what_another_writer_added(spark, posts, weights, tmp_path, monkeypatch):
    from verdictflow.schemas import HISTORY

    history = tables.history_table(spark, str(tmp_path))
    archive = tables.history_archive(spark, str(tmp_path))
    other = spark.createDataFrame([(date(2024, 1, 2), "Total", 1, 2, 0.5, 0.1, None, None)], HISTORY)
    plain = monitor.report

    def slow_report(*args, **options):
        result = plain(*args, **options)
        history.update(lambda table: table.unionByName(other))
        return result

    monkeypatch.setattr(monitor, "report", slow_report)
    result = monitor.run_report(posts, weights, history, archive, RUN)
    days = {str(r.date) for r in history.read().collect()}
    assert days == {"2024-01-02", RUN}
    assert {str(r.date) for r in archive.read().collect()} == days
    assert result.chart.count() == 2


def test_a_sample_reads_its_input_once(spark, tmp_path):
    from verdictflow.operators import sampling

    spark.range(1000).selectExpr("id as submission_id", "id % 3 as label").write.parquet(f"{tmp_path}/rows")
    cutoffs = sampling.hash_cutoffs(
        spark.read.parquet(f"{tmp_path}/rows"), "label", "submission_id", 1, {"_cut": lambda total: total / 2}
    )
    assert f"{tmp_path}/rows" not in cutoffs._jdf.queryExecution().executedPlan().toString()
