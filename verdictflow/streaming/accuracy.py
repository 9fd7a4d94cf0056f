"""Daily accuracy of a stream of scored rows."""

from pyspark.sql import functions as F

from verdictflow.operators.sets import history_upsert
from verdictflow.operators.stats import accuracy_by_type, binomial_columns
from verdictflow.session import stage
from verdictflow.streaming.common import start, stream_id


def daily_counts(scored, day_col="post_date"):
    """Running successes and rows per day and outcome type.

    The state is one row of counters per day and type, some thousands in all, so no
    watermark is needed and no row is ever too late.
    """
    return accuracy_by_type(scored.withColumn("date", F.col(day_col)), by=["date"]).select(
        "date", "outcome_type", "success", "n"
    )


def history_rows(counts):
    columns = binomial_columns(F.col("success"), F.col("n"))
    return counts.select(
        "date",
        "outcome_type",
        "success",
        "n",
        columns["rate"].alias("rate"),
        columns["se"].alias("se"),
        F.col("date").alias("min_post_date"),
        F.col("date").alias("max_post_date"),
    )


def monitor_accuracy(scored, history, checkpoint, day_col="post_date", **trigger):
    """Keep the history table at the latest counts of every day.

    In update mode a batch delivers the days it changed with their full counts, which
    replace those days. A batch marks the version it writes; a repeated one writes nothing, but
    reads its rows, as the state store wants every batch to be used.
    """
    stream = stream_id(history.spark, checkpoint)

    def upsert(batch, batch_id):
        mark = f"{stream}.{batch_id}"
        rows = stage(history_rows(batch), "daily-accuracy")
        if not history.has(mark):
            history.update(lambda table: history_upsert(table, rows), mark)

    return start(daily_counts(scored, day_col), upsert, checkpoint, trigger, mode="update")
