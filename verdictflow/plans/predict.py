"""Score undecided posts, publish a sample of the most confident, remember them as pending."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictflow.functions.messages import message_id, ruling_message
from verdictflow.functions.scores import over_threshold
from verdictflow.functions.text import combine_text, utc_date
from verdictflow.operators import filters, joins, sampling, sets
from verdictflow.operators.scorer import as_step
from verdictflow.session import even_out, stage


def score_posts(posts, scorer, run_date, sep=" ", null_text="", threshold=0.5):
    """Posts as prediction rows, with submission_id in front.

    `scorer` is a step, rows of weights or a store of models, here and in the jobs below.
    """
    prepared = even_out(
        posts.select(
            "submission_id",
            "title",
            utc_date(F.col("created_utc")).alias("post_date"),
            "url",
            F.lit(str(run_date)).cast("date").alias("date_created"),
            combine_text(F.col("title"), F.col("selftext"), sep, null_text).alias("combined_text"),
        )
    )
    scored = as_step(scorer)(prepared).drop("combined_text")
    return scored.withColumn("pred", over_threshold(F.col("logits"), threshold))


def with_messages(selected, run_date, seed=0):
    """Prediction rows with message and message_id."""
    run = F.lit(str(run_date))
    return selected.withColumn(
        "message", ruling_message(F.col("title"), F.col("pred"), F.col("url"), seed)
    ).withColumn("message_id", message_id(F.col("title"), F.col("url"), run))


@dataclass
class PredictResult:
    scored: DataFrame  # every new undecided post with its score
    published: DataFrame  # the selected rows with message and message_id
    pending: DataFrame  # the new state


def predict(posts, pending, scorer, run_date, n_posts=None, n_publish=2, share=0.1, seed=0):
    """One prediction run over the post feed.

    `n_posts` limits it to the newest posts, as a poll would. Filter and anti join
    come before the scoring, so only new undecided posts are scored; the scores are
    staged once for the thresholds and the selection.
    """
    feed = posts if n_posts is None else filters.newest(posts, n_posts)
    unseen = joins.unseen_by_title(filters.undecided(feed), pending)
    scored = stage(score_posts(unseen, scorer, run_date), "scored")
    confident = sampling.confident_extremes(scored, share)
    chosen = sampling.sample_n(confident, n_publish, seed=seed)
    published = with_messages(chosen, run_date, seed)
    state = sets.union_distinct(pending, published.select(*pending.columns))
    return PredictResult(scored, published, state)


def run_predict(posts, state, outbox, scorer, run_date, dry_run=False, seed=0, **options):
    """`predict`, then the writes: the new state, then the messages rendered from it.

    A run that stopped between the two finds its predictions in the state, so the
    next run of the day still sends their messages, each once.
    """
    result = predict(posts, state.read(), scorer, run_date, seed=seed, **options)
    if dry_run:
        return result
    result.published = stage(result.published, "published")
    chosen = result.published.select(*result.pending.columns)
    result.pending = state.update(lambda rows: sets.union_distinct(rows, chosen))
    of_today = F.col("date_created") == F.lit(str(run_date)).cast("date")
    messages = with_messages(result.pending.filter(of_today), run_date, seed)
    outbox.append(messages, "ruling")
    return result
