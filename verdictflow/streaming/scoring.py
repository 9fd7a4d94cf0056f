"""Scores for posts on arrival."""

from pyspark.sql import functions as F

from verdictflow.functions.scores import over_threshold
from verdictflow.functions.text import combine_text
from verdictflow.operators.scorer import as_step
from verdictflow.streaming.common import start


def score_stream(posts, scorer, path, checkpoint, to_batch=None, threshold=0.5, **trigger):
    """Write (submission_id, logits, pred) of every post below `path`.

    Each batch has its own partition, which a repeated batch replaces. `scorer` is a step,
    rows of weights (a stored table, since every batch reads them), or a store of models, whose
    newest model each batch takes.
    """

    def score_batch(batch, batch_id):
        feed = to_batch(batch) if to_batch else batch
        prepared = feed.select(
            "submission_id",
            combine_text(F.col("title"), F.col("selftext")).alias("combined_text"),
        )
        scored = as_step(scorer)(prepared).select(
            "submission_id", "logits", over_threshold(F.col("logits"), threshold).alias("pred")
        )
        scored.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return start(posts, score_batch, checkpoint, trigger)
