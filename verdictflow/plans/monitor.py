"""Add newly decided posts, scored, to the daily log; report accuracy over time."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictflow.functions.labels import code_outcome, is_class
from verdictflow.functions.scores import accuracy_flag, over_threshold
from verdictflow.functions.text import combine_text, utc_date
from verdictflow.operators import filters, joins, sampling, sets, stats
from verdictflow.operators.scorer import as_step
from verdictflow.schemas import DAILY_LOG
from verdictflow.session import even_out, stage


def decided_batch(posts, length_mode="as_written", n_posts=None):
    """Decided posts with post_date; rows keep the columns of the feed."""
    feed = posts if n_posts is None else filters.newest(posts, n_posts)
    batch = filters.length_filter(filters.decided(feed), length_mode)
    return batch.withColumn("post_date", utc_date(F.col("created_utc")))


def log_rows(batch, scorer, threshold=0.5):
    """Decided posts as rows of the daily log: coded, scored and flagged.

    `scorer` is a step, rows of weights or a store of models, here and in the jobs below.
    """
    prepared = even_out(
        batch.select(
            "submission_id",
            "title",
            "selftext",
            F.col("link_flair_text").alias("outcome_str"),
            combine_text(F.col("title"), F.col("selftext")).alias("combined_text"),
            code_outcome(F.col("link_flair_text")).alias("outcome"),
            "post_date",
        )
    )
    scored = as_step(scorer)(prepared).withColumn(
        "pred", over_threshold(F.col("logits"), threshold)
    )
    flagged = scored.withColumn("accurate", accuracy_flag(F.col("pred"), F.col("outcome")))
    return flagged.select(*DAILY_LOG.fieldNames())


def unlogged(batch, log):
    """Posts of a batch, each once, that are not logged under their date.

    A log with an index is opened for the dates of ids that may be known, and not at all when
    there are none.
    """
    maybe = log.may_be_known(batch)
    if maybe is None:
        return joins.new_by_id(batch, log.read_dates_of(batch))
    maybe = stage(maybe, "maybe-known")
    if maybe.isEmpty():
        return joins.first_by_id(batch)
    ids = maybe.select("submission_id").distinct()
    return joins.new_by_id(batch, log.read_dates_of(maybe).join(ids, "submission_id", "left_semi"))


def monitor(posts, log, scorer, length_mode="as_written", n_posts=None):
    """New rows of the log: decided posts, each once, that are not logged under their date.

    A post is logged once; a flair that changes later does not change its row.
    """
    batch = decided_batch(posts, length_mode, n_posts)
    return log_rows(unlogged(batch, log), scorer)


def run_monitor(posts, log, scorer, dry_run=False, n_posts=None, **options):
    """`monitor`, then the append; returns the new rows and the scan counts.

    The combined text is not staged: it follows from title and body. The counts read one column.
    """
    feed = posts if n_posts is None else filters.newest(posts, n_posts)
    rows = stage(monitor(feed, log, scorer, **options).drop("combined_text"), "log-rows")
    rows = rows.withColumn("combined_text", combine_text(F.col("title"), F.col("selftext")))
    rows = rows.select(*DAILY_LOG.fieldNames())
    if not rows.isEmpty():
        log.append(rows, dry_run=dry_run)
    return rows, stats.verdict_counts(feed)


@dataclass
class ReportResult:
    distribution: DataFrame
    dates: DataFrame
    confusion: DataFrame
    summary: DataFrame
    history: DataFrame
    chart: DataFrame


def report(posts, scorer, history, run_date, overwrite_day=True, seed=0):
    """Accuracy on a class-balanced sample, added to the history, with control limits.

    What the statistics need of the batch is staged, so the texts are read once, for the sample.
    """
    batch = decided_batch(filters.two_class(posts)).withColumn(
        "outcome", code_outcome(F.col("link_flair_text"))
    )
    facts = stage(batch.select("submission_id", "link_flair_text", "outcome", "post_date"), "report-batch")
    n_yta = facts.agg(F.count_if(is_class(F.col("link_flair_text"), 1.0))).scalar()
    balanced = sampling.balanced_sample(batch, "outcome", n_yta, seed=seed, keys=facts)
    scored = stage(
        log_rows(balanced, scorer).drop("title", "selftext", "combined_text"), "report"
    )
    summary = stage(stats.accuracy_summary(scored, facts, str(run_date)), "report-summary")
    updated = sets.history_upsert(history, summary, overwrite_day)
    return ReportResult(
        stats.count_table(facts, "outcome"),
        stats.date_range(facts),
        stats.confusion_matrix(scored),
        summary,
        updated,
        stats.control_chart(updated),
    )


def run_report(posts, scorer, history, archive, run_date, dry_run=False, **options):
    """`report`, then the writes: current history and a dated copy.

    A day that is present and not to be overwritten leaves both as they are. When another
    writer changes the history meanwhile, the summary is added to what it wrote.
    """
    overwrite = options.get("overwrite_day", True)
    of_day = F.col("date") == F.lit(str(run_date)).cast("date")
    version = history.version()
    result = report(posts, scorer, history.read(version), run_date, **options)
    while not dry_run:
        before = history.read(version)
        if not overwrite and not before.filter(of_day).isEmpty():
            break
        written = history.write_after(sets.history_upsert(before, result.summary, overwrite), version)
        if written is not None:
            result.history = written
            result.chart = stats.control_chart(written)
            archive.append(written, str(run_date))
            break
        version = history.version()
    return result
