"""The queries by name, each over the whole tables of a data folder.

State of earlier runs (pending predictions, the daily log, the accuracy history) is
derived from the same tables. Where a job subtracts what an earlier run covered, that run is
taken to have covered the posts in English.
"""

import numpy as np
from pyspark.sql import functions as F

from verdictflow.functions.labels import binary_label, code_outcome
from verdictflow.functions.messages import message_id
from verdictflow.functions.scores import accuracy_flag, grade, over_threshold
from verdictflow.functions.text import combine_text, truncate_words, utc_date
from verdictflow.operators import (
    filters,
    joins,
    learning,
    logistic,
    model,
    quantiles,
    sampling,
    scorer,
    sets,
    stats,
    subwords,
)
from verdictflow.plans import assess, monitor, predict, training
from verdictflow.schemas import DAILY_LOG, HISTORY, PENDING
from verdictflow.session import even_out, run_dir, stage
from verdictflow.sources import feeds, models, scans, tables
from verdictflow.streaming import accuracy as stream_accuracy
from verdictflow.streaming import ingest as stream_ingest
from verdictflow.streaming import resolve as stream_resolving
from verdictflow.streaming import scoring as stream_scoring

RUN_DATE = "2024-03-01"
REPORT_DATE = "2024-02-01"
SEED = 7
N_MERGES = 16


# Inputs


def english_posts(spark, d):
    feed = feeds.posts(spark, d, extra=["lang"])
    return feed.filter(F.col("lang") == "en").drop("lang")


def weights(spark, d):
    return training.weights_for(feeds.posts(spark, d))


def graded_scores(spark, d):
    scored = feeds.scored(spark, d)
    return scored.withColumn("accurate", accuracy_flag(F.col("pred"), F.col("outcome")))


def pending(spark, d):
    """Predictions of an earlier run, as a table."""
    rows = predict.score_posts(feeds.posts(spark, d), weights(spark, d), RUN_DATE)
    sent = message_id(F.col("title"), F.col("url"), F.lit(RUN_DATE))
    state = rows.withColumn("message_id", sent).select(*PENDING.fieldNames())
    return stage(state, "pending")


def unscored_log(spark, posts, indexed=False):
    """A daily log of the decided posts among `posts`, in a folder of this run."""
    log = tables.DailyLog(spark, run_dir(spark, "daily-log"), indexed=indexed)
    log.append(stream_ingest.unscored(monitor.decided_batch(posts), DAILY_LOG))
    return log


LOG_VIEW = ["submission_id", "title", "outcome_str", "post_date"]


def training_rows(spark, d):
    return training.training_posts(feeds.posts(spark, d))


def merged(spark, d):
    waiting = pending(spark, d)
    return joins.resolve(waiting, assess.coded_lookup(waiting, feeds.posts(spark, d)))


# Sources and sinks


def newest_posts(spark, d):
    return filters.newest(feeds.posts(spark, d), 500).select(
        "submission_id", "title", "link_flair_text", "created_utc", "url"
    )


def csv_training(spark, d):
    """Posts of the two classes through a CSV file and back."""
    path = run_dir(spark, "training-csv")
    rows = filters.two_class(feeds.posts(spark, d))
    scans.write_training_csv(
        rows.select("submission_id", "title", "selftext", "link_flair_text"), path
    )
    return scans.training_csv(spark, path)


def training_posts(spark, d):
    rows = training.labelled(csv_training(spark, d), positive="Asshole")
    return rows.select("submission_id", "title", "selftext", "label")


def log_for_batch_dates(spark, d):
    posts = feeds.posts(spark, d)
    batch = monitor.decided_batch(posts, n_posts=500)
    return unscored_log(spark, posts).read_dates_of(batch).select(*LOG_VIEW)


def log_last_n_days(spark, d):
    log = unscored_log(spark, feeds.posts(spark, d))
    return scans.last_days(log.read(), REPORT_DATE, 14).select(*LOG_VIEW)


def append_daily_log(spark, d):
    posts = feeds.posts(spark, d, extra=["lang"])
    log = unscored_log(spark, posts.filter(F.col("lang") == "en"))
    rest = monitor.decided_batch(posts.filter(~F.col("lang").eqNullSafe("en")))
    log.append(stream_ingest.unscored(rest, DAILY_LOG))
    return log.read().select(*LOG_VIEW)


def write_state(spark, d):
    state = tables.pending_table(spark, run_dir(spark, "state"))
    state.write(pending(spark, d))
    state.write(state.read().filter(F.col("pred") == 1))
    return state.read()


def archive_resolved(spark, d):
    archive = tables.resolved_archive(spark, run_dir(spark, "archive"))
    archive.append(joins.resolved(merged(spark, d)), "2024-03-02-06-00")
    return archive.read()


# Projections and filters


def undecided_posts(spark, d):
    return filters.undecided(feeds.posts(spark, d)).select("submission_id", "title", "url")


def decided_posts(spark, d):
    return filters.decided(feeds.posts(spark, d)).select("submission_id", "link_flair_text")


def binary_verdict_posts(spark, d):
    return filters.two_class(feeds.posts(spark, d)).select("submission_id", "link_flair_text")


def length_filtered_posts(spark, d):
    return filters.length_filter(feeds.posts(spark, d)).select(
        "submission_id", F.length("selftext").alias("n_chars")
    )


def post_dates(spark, d):
    return feeds.posts(spark, d).select(
        "submission_id", utc_date(F.col("created_utc")).alias("post_date")
    )


def combined_text(spark, d):
    text = combine_text(F.col("title"), F.col("selftext"))
    return feeds.posts(spark, d).select("submission_id", text.alias("combined_text"))


def coded_outcomes(spark, d):
    return feeds.posts(spark, d).select(
        "submission_id", "link_flair_text", code_outcome(F.col("link_flair_text")).alias("outcome")
    )


def binary_labels(spark, d):
    return feeds.posts(spark, d).select(
        "submission_id",
        binary_label(F.col("link_flair_text")).alias("label"),
        binary_label(F.col("link_flair_text"), "Asshole").alias("long_name_label"),
    )


def thresholded(spark, d):
    return feeds.scored(spark, d).select(
        "submission_id", "logits", over_threshold(F.col("logits")).alias("pred")
    )


def truncated_titles(spark, d):
    return feeds.posts(spark, d).select(
        "submission_id", truncate_words(F.col("title")).alias("short_title")
    )


def accuracy_flags(spark, d):
    return graded_scores(spark, d).select("submission_id", "pred", "outcome", "accurate")


def ruling_messages(spark, d):
    waiting = filters.undecided(feeds.posts(spark, d))
    scored = predict.score_posts(waiting, weights(spark, d), RUN_DATE)
    return predict.with_messages(scored, RUN_DATE, SEED).select(
        "submission_id", "pred", "message_id", "message"
    )


def update_messages(spark, d):
    return assess.with_updates(joins.resolved(merged(spark, d)), SEED).select(
        "message_id", "grade", "message"
    )


def grade_counts(spark, d):
    rows = feeds.scored(spark, d).filter(F.col("outcome").isNotNull())
    return stats.grade_counts(rows.withColumn("grade", grade(F.col("pred"), F.col("outcome"))))


# Joins


def unseen_posts_by_title(spark, d):
    posts = filters.undecided(feeds.posts(spark, d))
    known = english_posts(spark, d).select("title")
    return joins.unseen_by_title(posts.select("submission_id", "title", "url"), known)


def new_posts_by_id(spark, d):
    log = unscored_log(spark, english_posts(spark, d))
    batch = monitor.decided_batch(feeds.posts(spark, d))
    new = joins.new_by_id(batch, log.read_dates_of(batch))
    return new.select("submission_id", "title", "link_flair_text", "post_date")


def new_posts_by_index(spark, d):
    """The same over a log with an index of its ids."""
    log = unscored_log(spark, english_posts(spark, d), indexed=True)
    new = monitor.unlogged(monitor.decided_batch(feeds.posts(spark, d)), log)
    return new.select("submission_id", "title", "link_flair_text", "post_date")


def title_lookup(spark, d):
    waiting = english_posts(spark, d).select("title")
    return joins.title_lookup(waiting, feeds.posts(spark, d))


def resolve_predictions(spark, d):
    return merged(spark, d)


def resolved_predictions(spark, d):
    return joins.resolved(merged(spark, d))


def still_unresolved(spark, d):
    return joins.still_unresolved(merged(spark, d))


# Aggregations


def verdict_counts(spark, d):
    return stats.verdict_counts(feeds.posts(spark, d))


def outcome_distribution(spark, d):
    return stats.count_table(feeds.scored(spark, d), "outcome")


def post_date_range(spark, d):
    return stats.date_range(feeds.scored(spark, d))


def confusion_matrix(spark, d):
    return stats.confusion_matrix(feeds.scored(spark, d))


def binomial_stats(spark, d):
    return stats.binomial_stats(graded_scores(spark, d), "accurate")


def accuracy_summary(spark, d):
    rows = graded_scores(spark, d)
    two = rows.filter(F.col("outcome").isin(0, 1))
    return stats.accuracy_summary(two, rows, RUN_DATE)


def confidence_thresholds(spark, d):
    return quantiles.class_thresholds(feeds.scored(spark, d))


def _rounded(df, *names):
    """Averages of doubles to ten digits: their last bits depend on the order of the sum."""
    return df.withColumns({name: F.round(name, 10) for name in names})


def control_limits(spark, d):
    limits = stats.control_limits(stats.daily_history(graded_scores(spark, d)))
    return _rounded(limits, "mean_rate", "sd_rate", "ucl", "lcl")


def eval_accuracy(spark, d):
    return training.train(training_rows(spark, d)).accuracy


def selective_accuracy(spark, d):
    rows = graded_scores(spark, d).filter(F.col("outcome").isin(0, 1))
    return stats.binomial_stats(sampling.confident_extremes(rows), "accurate")


def coverage_curve(spark, d):
    return stats.coverage_curve(graded_scores(spark, d))


def token_length_stats(spark, d):
    return model.token_length_stats(token_counts(spark, d))


def split_sizes(spark, d):
    split = sampling.stratified_split(training_rows(spark, d), "label")
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# Selection


def confident_extremes(spark, d):
    return sampling.confident_extremes(feeds.scored(spark, d))


def ranked_extremes(spark, d):
    return sampling.ranked(confident_extremes(spark, d))


def sample_n(spark, d):
    return sampling.sample_n(confident_extremes(spark, d), 20, seed=SEED)


def balanced_sample(spark, d):
    rows = feeds.scored(spark, d)
    n_yta = rows.agg(F.count_if(F.col("outcome") == 1)).scalar()
    return sampling.balanced_sample(rows, "outcome", n_yta, seed=SEED)


def stratified_split(spark, d):
    split = sampling.stratified_split(training_rows(spark, d), "label")
    return split.select("submission_id", "label", "split")


def stratified_subsample(spark, d):
    rows = sampling.stratified_subsample(training_rows(spark, d), "label", 0.5)
    return rows.select("submission_id", "label")


# Set operations


def union_distinct(spark, d):
    rows = feeds.scored(spark, d).select("post_date", "pred", "outcome")
    again = rows.filter(F.col("outcome").isNotNull()).select("outcome", "pred", "post_date")
    return sets.union_distinct(rows, again)


def union_all_log(spark, d):
    posts = feeds.posts(spark, d, extra=["lang"])
    view = ["submission_id", "link_flair_text", "post_date"]
    earlier = monitor.decided_batch(posts.filter(F.col("lang") == "en")).select(*view)
    return sets.union_all(earlier, monitor.decided_batch(posts).select(*view))


def history_upsert(spark, d):
    rows = graded_scores(spark, d)
    new = stats.accuracy_summary(rows, rows, "2024-01-15")
    return sets.history_upsert(stats.daily_history(rows), new)


# Text model


def token_counts(spark, d):
    return model.token_counts(even_out(combined_text(spark, d)))


def train_weights(spark, d):
    return weights(spark, d)


def score_posts(spark, d):
    return model.score(even_out(combined_text(spark, d)), weights(spark, d)).select(
        "submission_id", "logits"
    )


def score_with_udf(spark, d):
    # The model has a fixed number of weights, so it fits the driver at any data size.
    fixed = model.dense_model(weights(spark, d)).first()
    shared = spark.sparkContext.broadcast(np.array(fixed["weights"], dtype=np.int64))
    bias = fixed["bias_micro"]

    def load():
        return scorer.linear_scorer(bias, shared.value, model.UNIT)

    encoded = scorer.encode(even_out(combined_text(spark, d)))
    return scorer.score_with(encoded.select("submission_id", "input_ids"), load)


def train_ml_pipeline(spark, d):
    parts = stage(sampling.stratified_split(training_rows(spark, d), "label"), "split")
    fitted = learning.bayes_pipeline().fit(parts.filter("split = 'train'"))
    held_out = parts.filter("split <> 'train'")
    return learning.margin_of(fitted, held_out).select(
        "submission_id", "label", "split", F.round("logits", 6).alias("logits"), "pred"
    )


def _logistic_parts(spark, d):
    """The training posts with their features and split, as a table."""
    rows = sampling.stratified_split(training_rows(spark, d), "label")
    rows = rows.select("submission_id", "label", "split", "combined_text")
    return stage(logistic.with_features(rows), "features")


def train_logistic(spark, d):
    parts = _logistic_parts(spark, d)
    return logistic.weight_rows(logistic.fit(parts.filter("split = 'train'")))


def logistic_scores(spark, d):
    """Held-out posts scored by the trained weights."""
    parts = _logistic_parts(spark, d)
    weights = logistic.fit(parts.filter("split = 'train'"))
    scored = logistic.score(parts.filter("split <> 'train'"), weights)
    return scored.withColumn("pred", over_threshold(F.col("logits")))


def tune_ml_pipeline(spark, d):
    parts = _logistic_parts(spark, d)
    train, val = parts.filter("split = 'train'"), parts.filter("split = 'val'")
    return logistic.select_setting(train, val, learning.SETTINGS, threshold=0.0)


def score_by_join(spark, d):
    trained = stage(weights(spark, d), "weights")
    return model.score_by_join(even_out(combined_text(spark, d)), trained)


def subword_counts(spark, d):
    """Tokens of each post after a fixed number of merges learned from all posts."""
    texts = even_out(combined_text(spark, d))
    merges, table = subwords.learn(subwords.word_table(texts), N_MERGES)
    return subwords.subword_counts(texts, table, merges=merges)


def subword_merges(spark, d):
    merges, _ = subwords.learn(subwords.word_table(even_out(combined_text(spark, d))), N_MERGES)
    rows = [(k + 1, *merge) for k, merge in enumerate(merges)]
    return spark.createDataFrame(rows, "step int, left string, right string, n long")


def _stored(spark, d):
    store = models.ModelStore(spark, run_dir(spark, "models"))
    store.save(weights(spark, d), trained_on="decided posts")
    return store


def score_stored_model(spark, d):
    scorer_step = _stored(spark, d).load().step()
    return scorer_step(even_out(combined_text(spark, d))).select("submission_id", "logits")


# Streams


def _finish(query):
    query.awaitTermination()
    return query


def _to_posts(spark, d):
    labels = feeds.table(spark, d, "labels")
    return lambda batch: feeds.posts_from(batch, labels)


def stream_dedup_ingest(spark, d):
    log = unscored_log(spark, english_posts(spark, d))
    documents = feeds.stream(spark, d, "documents", feeds.DOCUMENTS)
    _finish(
        stream_ingest.ingest(documents, log, run_dir(spark, "checkpoint"), _to_posts(spark, d))
    )
    return log.read().select(*LOG_VIEW)


def stream_daily_accuracy(spark, d):
    root = run_dir(spark, "history")
    history = tables.VersionedTable(spark, root, HISTORY)
    events = feeds.stream(spark, d, "events", feeds.EVENTS)
    ready = feeds.scored_from(events).withColumn(
        "accurate", accuracy_flag(F.col("pred"), F.col("outcome"))
    )
    _finish(stream_accuracy.monitor_accuracy(ready, history, run_dir(spark, "checkpoint")))
    return history.read()


def stream_resolve(spark, d):
    root = run_dir(spark, "resolve")
    state, archive = tables.pending_table(spark, root), tables.resolved_archive(spark, root)
    state.write(pending(spark, d))
    documents = feeds.stream(spark, d, "documents", feeds.DOCUMENTS)
    _finish(
        stream_resolving.resolve_stream(
            documents, state, archive, run_dir(spark, "checkpoint"), _to_posts(spark, d)
        )
    )
    return archive.read().drop("run_ts")


def stream_score(spark, d):
    path = run_dir(spark, "stream-scores")
    trained = stage(weights(spark, d), "weights")
    documents = feeds.stream(spark, d, "documents", feeds.DOCUMENTS)
    _finish(
        stream_scoring.score_stream(
            documents, trained, path, run_dir(spark, "checkpoint"), _to_posts(spark, d)
        )
    )
    return spark.read.parquet(path).select("submission_id", "logits", "pred")


def stream_score_stored(spark, d):
    """Scores of a stream that takes the newest stored model."""
    path = run_dir(spark, "stream-scores")
    documents = feeds.stream(spark, d, "documents", feeds.DOCUMENTS)
    _finish(
        stream_scoring.score_stream(
            documents, _stored(spark, d), path, run_dir(spark, "checkpoint"), _to_posts(spark, d)
        )
    )
    return spark.read.parquet(path).select("submission_id", "logits", "pred")


# Jobs


def predict_cycle(spark, d):
    return _predicted(spark, d, stage(weights(spark, d), "weights")).pending


def predict_cycle_python(spark, d):
    """The prediction job with a stored model and the scorer of Arrow batches."""
    return _predicted(spark, d, _stored(spark, d).load().python_step()).pending


def _predicted(spark, d, trained):
    earlier = predict.score_posts(english_posts(spark, d), trained, "2024-02-28")
    sent = message_id(F.col("title"), F.col("url"), F.lit("2024-02-28"))
    state = earlier.withColumn("message_id", sent).select(*PENDING.fieldNames())
    return predict.predict(
        feeds.posts(spark, d), stage(state, "pending"), trained, RUN_DATE, seed=SEED
    )


def outbox_messages(spark, d):
    """The messages of a prediction run that publishes twenty posts."""
    root = run_dir(spark, "outbox")
    box = tables.outbox(spark, root)
    state = tables.pending_table(spark, root)
    options = {"seed": SEED, "n_publish": 20}
    predict.run_predict(feeds.posts(spark, d), state, box, _stored(spark, d), RUN_DATE, **options)
    return box.read()


def assess_cycle(spark, d):
    return assess.assess(pending(spark, d), feeds.posts(spark, d), SEED).resolved


def _assessed(spark, d):
    root = run_dir(spark, "assess")
    state, box = tables.pending_table(spark, root), tables.outbox(spark, root)
    state.write(pending(spark, d))
    archive = tables.resolved_archive(spark, root)
    assess.run_assess(state, feeds.posts(spark, d), archive, box, "2024-03-02-06-00", seed=SEED)
    return state, box


def assess_state(spark, d):
    """What an assessment leaves pending."""
    return _assessed(spark, d)[0].read()


def outbox_updates(spark, d):
    """The messages of an assessment."""
    return _assessed(spark, d)[1].read()


def state_or_empty(spark, d):
    """A state table that is not there is empty; then what was added to it."""
    state = tables.pending_table(spark, run_dir(spark, "state"))
    missing = scans.read_if_exists(spark, run_dir(spark, "missing"), PENDING)
    state.write(sets.union_all(missing, pending(spark, d)))
    return scans.read_required(spark, f"{state.path}/v={0:012d}", PENDING)


def monitor_cycle(spark, d):
    trained = stage(weights(spark, d), "weights")
    log = unscored_log(spark, english_posts(spark, d))
    return monitor.monitor(feeds.posts(spark, d), log, trained)


def monitor_report(spark, d):
    history = stats.daily_history(graded_scores(spark, d))
    trained = stage(weights(spark, d), "weights")
    result = monitor.report(feeds.posts(spark, d), trained, history, RUN_DATE, seed=SEED)
    limits = stats.control_limits(result.history).select(
        F.struct("mean_rate", "ucl", "lcl").alias("limits")
    )
    with_limits = result.history.withColumn("_limits", limits.scalar())
    return _rounded(
        with_limits.select(*HISTORY.fieldNames(), "_limits.*"), "mean_rate", "ucl", "lcl"
    )


def _reported(spark, d, run_date=RUN_DATE, **options):
    root = run_dir(spark, "report")
    history = tables.history_table(spark, root)
    archive = tables.history_archive(spark, root)
    history.write(stats.daily_history(graded_scores(spark, d)))
    trained = stage(weights(spark, d), "weights")
    posts = feeds.posts(spark, d)
    return monitor.run_report(posts, trained, history, archive, run_date, seed=SEED, **options), archive


def history_snapshot(spark, d):
    """The dated copy of the history that a report leaves."""
    return _reported(spark, d)[1].read()


def history_keep_day(spark, d):
    """A report of a day that is there and is not to be overwritten."""
    return _reported(spark, d, "2024-01-15", overwrite_day=False)[0].history


def report_confusion(spark, d):
    return _reported(spark, d)[0].confusion


def report_distribution(spark, d):
    return _reported(spark, d)[0].distribution


def report_dates(spark, d):
    return _reported(spark, d)[0].dates


def train_eval(spark, d):
    rows = training.labelled(csv_training(spark, d), positive="Asshole")
    evaluated = training.train(stage(rows, "training")).evaluated
    return evaluated.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("right")
    )


QUERIES = {
    query.__name__: query
    for query in (
        newest_posts,
        training_posts,
        log_for_batch_dates,
        log_last_n_days,
        append_daily_log,
        write_state,
        archive_resolved,
        undecided_posts,
        decided_posts,
        binary_verdict_posts,
        length_filtered_posts,
        post_dates,
        combined_text,
        coded_outcomes,
        binary_labels,
        thresholded,
        truncated_titles,
        accuracy_flags,
        ruling_messages,
        update_messages,
        grade_counts,
        unseen_posts_by_title,
        new_posts_by_id,
        new_posts_by_index,
        title_lookup,
        resolve_predictions,
        resolved_predictions,
        still_unresolved,
        verdict_counts,
        outcome_distribution,
        post_date_range,
        confusion_matrix,
        binomial_stats,
        accuracy_summary,
        confidence_thresholds,
        control_limits,
        eval_accuracy,
        selective_accuracy,
        coverage_curve,
        token_length_stats,
        split_sizes,
        confident_extremes,
        ranked_extremes,
        sample_n,
        balanced_sample,
        stratified_split,
        stratified_subsample,
        union_distinct,
        union_all_log,
        history_upsert,
        token_counts,
        train_weights,
        score_posts,
        score_with_udf,
        score_by_join,
        score_stored_model,
        subword_merges,
        subword_counts,
        train_ml_pipeline,
        train_logistic,
        logistic_scores,
        tune_ml_pipeline,
        stream_dedup_ingest,
        stream_daily_accuracy,
        stream_resolve,
        stream_score,
        stream_score_stored,
        predict_cycle,
        predict_cycle_python,
        outbox_messages,
        assess_cycle,
        assess_state,
        outbox_updates,
        state_or_empty,
        monitor_cycle,
        monitor_report,
        history_snapshot,
        history_keep_day,
        report_confusion,
        report_distribution,
        report_dates,
        train_eval,
    )
}
