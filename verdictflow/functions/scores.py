"""Scores, predictions and grades."""

from pyspark.sql import functions as F


def without_nan(score):
    """NaN as NULL, so that comparisons and aggregates skip it."""
    return F.when(~F.isnan(score), score)


def over_threshold(logits, threshold=0.5):
    """Predicted class: 1 where the raw logit is above the threshold, else 0 (missing too)."""
    return F.when(without_nan(logits) > threshold, F.lit(1)).otherwise(F.lit(0))


def accuracy_flag(pred, outcome):
    """1 where prediction and outcome agree; 0 otherwise, also without an outcome."""
    return F.coalesce((pred == outcome).cast("int"), F.lit(0))


def grade(pred, outcome):
    """mistrial for outcomes outside the two trained classes, else correct or incorrect."""
    return (
        F.when(outcome > 1, F.lit("mistrial"))
        .when(pred == outcome, F.lit("correct"))
        .otherwise(F.lit("incorrect"))
    )
