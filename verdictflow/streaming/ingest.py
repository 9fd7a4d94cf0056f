"""Deduplicated ingest of a post stream into the daily log."""

from pyspark.sql import functions as F

from verdictflow.plans.monitor import decided_batch, log_rows, unlogged
from verdictflow.streaming.common import start


def ingest(posts, log, checkpoint, to_batch=None, scorer=None, **trigger):
    """Append decided posts, each id once, to the partition of their date.

    Ids are checked against the logged rows of the batch's dates, so a post may come
    at any time after its date, and a repeated batch adds nothing. `to_batch` turns a
    micro-batch into posts. Without `scorer` the scores stay NULL; it is a step, rows of
    weights (a stored table, since every batch reads them), or a store of models.
    """

    def add(batch, _batch_id):
        # Its dates, its repeated ids and its rows are read: the batch is evaluated once.
        rows = decided_batch(to_batch(batch) if to_batch else batch).persist()
        new = unlogged(rows, log)
        log.append(log_rows(new, scorer) if scorer is not None else unscored(new, log.schema))
        rows.unpersist()

    return start(posts, add, checkpoint, trigger)


def unscored(batch, schema):
    """Decided posts as log rows without scores."""
    named = batch.withColumnRenamed("link_flair_text", "outcome_str")
    return named.select(
        *[
            F.col(field.name)
            if field.name in named.columns
            else F.lit(None).cast(field.dataType).alias(field.name)
            for field in schema.fields
        ]
    )


def dedupe_within(posts, delay, time_col="ts", id_col="submission_id"):
    """Bounded-state alternative: drops repeats within `delay`, and later posts with them.

    A post older than the watermark is lost without notice; `ingest` keeps every post.
    """
    return posts.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])
