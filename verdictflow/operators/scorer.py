"""Scorer steps: functions from posts to posts with `logits`, native or in Arrow batches."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictflow.functions.text import VOCABULARY, word_id, words
from verdictflow.operators import model as linear


def encode(posts, text_col="combined_text", max_words=None, vocabulary=VOCABULARY):
    """`posts` with `input_ids`, the word ids of the text in order."""
    ids = F.transform(words(F.col(text_col), max_words), lambda word: word_id(word, vocabulary))
    return posts.withColumn("input_ids", ids)


def score_with(posts, load, input_col="input_ids"):
    """`posts` without the input column, plus `logits` from a user-supplied model.

    `load()` runs once per task and returns a function from a pandas Series of inputs
    to one score per row. Filters belong before this step: Spark cannot move them
    through it.
    """
    kept = [field for field in posts.schema.fields if field.name != input_col]
    schema = T.StructType(kept + [T.StructField("logits", T.DoubleType(), True)])
    names = [field.name for field in kept]

    def score_batches(batches):
        model = load()
        for batch in batches:
            scored = batch[names].copy()
            scored["logits"] = model(batch[input_col])
            yield scored

    return posts.mapInPandas(score_batches, schema)


def linear_scorer(bias, weights, unit):
    """A model for `score_with`: whole-number weights per word id, summed per text."""

    def model(inputs):
        sizes = np.fromiter((len(ids) for ids in inputs), dtype=np.int64, count=len(inputs))
        totals = np.zeros(len(inputs), dtype=np.int64)
        if sizes.sum():
            values = weights[np.concatenate([np.asarray(ids, dtype=np.int64) for ids in inputs])]
            np.add.at(totals, np.repeat(np.arange(len(inputs)), sizes), values)
        return (totals + bias) / unit

    return model


def native_step(model: DataFrame, vocabulary=VOCABULARY):
    """A step that applies a one-row model as a projection."""
    return lambda posts: linear.score_dense(posts, model, vocabulary)


def python_step(model: DataFrame, vocabulary=VOCABULARY):
    """A step that applies a one-row model in Arrow batches.

    The model has `vocabulary` weights at any data size; it is collected once and broadcast.
    """
    row = model.select("bias_micro", "weights").first()
    bias = row["bias_micro"]
    shared = model.sparkSession.sparkContext.broadcast(np.array(row["weights"], dtype=np.int64))

    def load():
        return linear_scorer(bias, shared.value, linear.UNIT)

    return lambda posts: score_with(encode(posts, vocabulary=vocabulary), load)


def as_step(scorer):
    """The step of what a job was given: a step, rows of weights, or a store of models.

    A store is asked for its newest model each time, so a job or a micro-batch uses the one
    that is current when it starts.
    """
    if isinstance(scorer, DataFrame):
        return lambda posts: linear.score(posts, scorer)
    if hasattr(scorer, "load"):
        return scorer.load().step()
    return scorer
