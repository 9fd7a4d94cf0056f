"""Train the classifier on decided posts and measure it on held-out ones."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictflow.functions.labels import binary_label, code_outcome
from verdictflow.functions.scores import over_threshold
from verdictflow.functions.text import combine_text
from verdictflow.operators import filters, model, sampling, stats
from verdictflow.session import even_out, stage


def training_posts(posts):
    """Posts of the two trained classes with label and combined_text."""
    rows = filters.two_class(posts).select(
        "submission_id",
        "title",
        "selftext",
        code_outcome(F.col("link_flair_text")).cast("int").alias("label"),
    )
    return even_out(
        rows.withColumn("combined_text", combine_text(F.col("title"), F.col("selftext")))
    )


def labelled(rows, positive="YTA"):
    """Training file rows with the exact-match label and combined_text."""
    return rows.select(
        "submission_id",
        "title",
        "selftext",
        binary_label(F.col("link_flair_text"), positive).alias("label"),
        combine_text(F.col("title"), F.col("selftext")).alias("combined_text"),
    )


def weights_for(posts):
    """Weights trained on all posts of the two classes."""
    return model.train_weights(training_posts(posts))


@dataclass
class TrainResult:
    weights: DataFrame
    evaluated: DataFrame  # held-out rows: submission_id, label, split, logits, pred
    accuracy: DataFrame  # n and accuracy per held-out split


def train(training, hold_share=0.132865, seed=42, threshold=0.5, drop_share=0.0):
    """Split, train on the train part, score and grade val and test."""
    if drop_share:
        training = sampling.stratified_subsample(training, "label", drop_share, seed=seed)
    parts = sampling.stratified_split(training, "label", hold_share=hold_share, seed=seed)
    weights = stage(model.train_weights(parts.filter("split = 'train'")), "weights")
    held_out = parts.filter("split <> 'train'").select(
        "submission_id", "label", "split", "combined_text"
    )
    evaluated = (
        model.score(held_out, weights)
        .drop("combined_text")
        .withColumn("pred", over_threshold(F.col("logits"), threshold))
    )
    return TrainResult(weights, evaluated, stats.mean_accuracy(evaluated, by=["split"]))
