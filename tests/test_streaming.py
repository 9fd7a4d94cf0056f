import pytest
from pyspark.sql import functions as F

from verdictflow.functions.scores import accuracy_flag
from verdictflow.operators import joins, stats
from verdictflow.plans import assess, monitor, training
from verdictflow.schemas import HISTORY, PENDING, POSTS
from verdictflow.sources import feeds, tables
from verdictflow.streaming import accuracy, ingest, resolve, scoring

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def posts(spark):
    return feeds.posts(spark, DATA)


@pytest.fixture
def source(spark, posts, tmp_path):
    """Three files of posts; ids 0-49 come in two of them, and every file spans all dates."""
    number = F.col("submission_id").cast("int")
    path = str(tmp_path / "posts")
    for part in range(3):
        chosen = posts.filter((number % 3 == part) | ((number < 50) & (number % 3 == (part + 1) % 3)))
        chosen.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(POSTS).option("maxFilesPerTrigger", 1).parquet(path)
    return stream


def rows(df):
    return sorted(map(str, df.collect()))


def test_ingest_equals_the_batch_job_and_a_rerun_adds_nothing(spark, posts, source, tmp_path):
    log = tables.daily_log(spark, str(tmp_path))
    checkpoint = str(tmp_path / "checkpoint")
    query = ingest.ingest(source, log, checkpoint)
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 2
    batch = ingest.unscored(monitor.decided_batch(posts), log.schema)
    assert rows(log.read()) == rows(batch.select(*log.schema.fieldNames()))
    ingest.ingest(source, log, checkpoint).awaitTermination()
    ingest.ingest(source, log, str(tmp_path / "other")).awaitTermination()
    assert log.read().count() == batch.count()


def test_scored_ingest(spark, posts, source, tmp_path):
    log = tables.daily_log(spark, str(tmp_path))
    weights = training.weights_for(posts)
    ingest.ingest(source, log, str(tmp_path / "checkpoint"), scorer=weights).awaitTermination()
    expected = monitor.log_rows(monitor.decided_batch(posts), weights)
    assert rows(log.read()) == rows(expected)


def test_stream_scores_equal_the_batch(spark, posts, source, tmp_path):
    weights = training.weights_for(posts)
    path = str(tmp_path / "scores")
    scoring.score_stream(source, weights, path, str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(path).select("submission_id", "logits", "pred").distinct()
    from verdictflow.plans.predict import score_posts

    expected = score_posts(posts, weights, "2024-03-01").select("submission_id", "logits", "pred")
    assert rows(got) == rows(expected)


def test_daily_accuracy_equals_the_batch(spark, tmp_path):
    scored = feeds.scored(spark, DATA).withColumn(
        "accurate", accuracy_flag(F.col("pred"), F.col("outcome"))
    )
    path = str(tmp_path / "scored")
    for part in range(3):
        scored.filter(F.col("submission_id") % 3 == part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(scored.schema).option("maxFilesPerTrigger", 1).parquet(path)
    history = tables.VersionedTable(spark, str(tmp_path / "history"), HISTORY)
    history.write(spark.createDataFrame([], HISTORY))
    checkpoint = str(tmp_path / "checkpoint")
    accuracy.monitor_accuracy(stream, history, checkpoint).awaitTermination()
    assert rows(history.read()) == rows(stats.daily_history(scored))
    version = history.version()
    accuracy.monitor_accuracy(stream, history, checkpoint).awaitTermination()
    assert rows(history.read()) == rows(stats.daily_history(scored))
    assert history.version() >= version


def test_days_do_not_depend_on_the_session_zone(spark, tmp_path, setting):
    setting("spark.sql.session.timeZone", "America/New_York")
    test_daily_accuracy_equals_the_batch(spark, tmp_path)


def pending_of(spark, posts):
    columns = posts.select(
        "title",
        F.lit("2024-01-01").cast("date").alias("post_date"),
        "url",
        F.lit("2024-01-02").cast("date").alias("date_created"),
        F.lit(0.0).alias("logits"),
        F.lit(1).alias("pred"),
        F.xxhash64("url").alias("message_id"),
    )
    return columns.select(*PENDING.fieldNames())


def test_resolution_in_one_batch_equals_the_batch_job(spark, posts, source, tmp_path):
    state = tables.pending_table(spark, str(tmp_path))
    archive = tables.resolved_archive(spark, str(tmp_path))
    state.write(pending_of(spark, posts))
    merged = joins.resolve(state.read(0), assess.coded_lookup(state.read(0), posts))
    path = str(tmp_path / "one")
    posts.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(POSTS).parquet(path)
    resolve.resolve_stream(stream, state, archive, str(tmp_path / "c")).awaitTermination()
    assert rows(archive.read().drop("run_ts")) == rows(joins.resolved(merged))
    assert rows(state.read()) == rows(joins.still_unresolved(merged).select(*PENDING.fieldNames()))


def test_resolution_in_several_batches_loses_and_repeats_nothing(spark, posts, source, tmp_path):
    state = tables.pending_table(spark, str(tmp_path))
    archive = tables.resolved_archive(spark, str(tmp_path))
    state.write(pending_of(spark, posts))
    checkpoint = str(tmp_path / "c")
    resolve.resolve_stream(source, state, archive, checkpoint).awaitTermination()
    done = [r.message_id for r in archive.read().collect()]
    waiting = [r.message_id for r in state.read().collect()]
    assert done and sorted(done + waiting) == sorted(r.message_id for r in state.read(0).collect())
    version = state.version()
    resolve.resolve_stream(source, state, archive, checkpoint).awaitTermination()
    assert state.version() == version and len(done) == archive.read().count()


def test_a_prediction_between_two_batches_keeps_all_verdicts(spark, posts, source, tmp_path):
    state = tables.pending_table(spark, str(tmp_path))
    archive = tables.resolved_archive(spark, str(tmp_path))
    waiting = pending_of(spark, posts)
    state.write(waiting)

    def meddling(batch):
        extra = waiting.limit(1).withColumn("title", F.lit("new")).withColumn("message_id", F.rand().cast("long"))
        state.update(lambda rows: rows.union(extra.select(*rows.columns)))
        return batch

    resolve.resolve_stream(source, state, archive, str(tmp_path / "c"), meddling).awaitTermination()
    ids = sorted(r.message_id for r in waiting.collect())
    done = [r.message_id for r in archive.read().collect()]
    left = [r.message_id for r in state.read().filter("title <> 'new'").collect()]
    assert done and sorted(done + left) == ids
    assert state.read().filter("title = 'new'").count() >= 3
    decided = posts.filter("link_flair_text is not null").select("title")
    open_rows = state.read().filter("title <> 'new'").join(decided, "title", "left_semi")
    assert open_rows.count() == 0 or set(r.title for r in open_rows.collect()) <= set(
        r.title for r in posts.filter("link_flair_text is null or link_flair_text = 'META'").collect()
    )


def scored_stream(spark, tmp_path, days):
    path = str(tmp_path / "days")
    schema = "post_date date, outcome double, accurate int"
    for day in days:
        row = [(day, 1.0, 1)]
        frame = spark.createDataFrame(row, "d string, outcome double, accurate int")
        frame.selectExpr("cast(d as date) post_date", "outcome", "accurate").coalesce(1).write.mode(
            "append"
        ).parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_rows_of_an_old_day_are_never_too_late(spark, tmp_path):
    stream = scored_stream(spark, tmp_path, ["2024-03-01", "2024-01-01", "2024-01-01"])
    history = tables.VersionedTable(spark, str(tmp_path / "history"), HISTORY)
    accuracy.monitor_accuracy(stream, history, str(tmp_path / "c")).awaitTermination()
    totals = history.read().filter("outcome_type = 'Total'").collect()
    assert sorted((str(r.date), r.n) for r in totals) == [("2024-01-01", 2), ("2024-03-01", 1)]


def test_a_report_between_two_batches_of_accuracy(spark, tmp_path):
    history = tables.VersionedTable(spark, str(tmp_path / "history"), HISTORY)
    checkpoint = str(tmp_path / "c")
    for days in (["2024-01-01"], ["2024-01-02"]):
        stream = scored_stream(spark, tmp_path, days)
        accuracy.monitor_accuracy(stream, history, checkpoint).awaitTermination()
        history.write(history.read())
    totals = history.read().filter("outcome_type = 'Total'").collect()
    assert sorted((str(r.date), r.n) for r in totals) == [("2024-01-01", 1), ("2024-01-02", 1)]


def test_bounded_dedupe(spark, source, tmp_path):
    timed = source.withColumn("ts", F.timestamp_seconds("created_utc"))
    path = str(tmp_path / "out")
    query = (
        ingest.dedupe_within(timed, "400 days")
        .writeStream.option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start(path, format="parquet")
    )
    query.awaitTermination()
    got = spark.read.parquet(path)
    assert got.count() == got.select("submission_id").distinct().count() == 200
