"""Logistic training over hashed words, for many settings at once.

Each epoch of the full-batch descent is a DataFrame step: the margins of a post are sums over its
own features, the gradient is summed per word id. All settings share the scan: margins,
residuals and weights are arrays with an entry per setting. Weights are whole millionths and
feature values whole thousandths, so every sum is exact and the same in any order of rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictflow.functions.scores import over_threshold
from verdictflow.functions.text import word_id, words
from verdictflow.operators.model import filled
from verdictflow.session import stage

UNIT, VALUE = 1_000_000, 1_000
EPOCHS, RATE = 5, 2.0
#: Word ids. The next number is the feature that all posts have: its weight is the bias.
VOCABULARY = 1 << 16
BIAS = VOCABULARY

# Settings by name: (regularisation, share of it on absolute weights).
PLAIN = {"none": (0.0, 0.0)}


def with_features(posts: DataFrame, text_col="combined_text", max_words=None) -> DataFrame:
    """`posts` without the text, plus `features`: (id, v) of each word id of the text, once.

    `v` is the id's count by the length of the vector of counts, in thousandths; the bias
    comes last. Ids are sorted and counted within the row, so no row is shuffled. A NULL or empty
    text has the bias alone.
    """
    kept = [c for c in posts.columns if c != text_col]
    ids = F.coalesce(F.transform(words(F.col(text_col), max_words), lambda w: word_id(w, VOCABULARY)), F.array().cast("array<int>"))
    rows = posts.select(*kept, F.sort_array(ids).alias("_ids"))
    # Where a new id starts; the last start is behind the end.
    new = lambda i: (i == 0) | (i == F.size("_ids")) | (F.get("_ids", i) != F.get("_ids", i - 1))
    rows = rows.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size("_ids")), new))
    ends = F.slice("_starts", 2, F.greatest(F.size("_starts") - 1, F.lit(0)))
    rows = rows.withColumn("_counts", F.zip_with(F.slice("_starts", 1, F.size("_starts") - 1), ends, _count))
    squares = F.aggregate("_counts", F.lit(0).cast("long"), lambda s, c: s + c["n"].cast("long") * c["n"])

    def feature(c, length):
        value = F.round(c["n"] * VALUE / length).cast("int")
        return F.struct(F.get("_ids", c["start"]).alias("id"), value.alias("v"))

    bias = F.struct(F.lit(BIAS).alias("id"), F.lit(VALUE).alias("v"))
    # As a column, the length would be folded into the step over the ids and summed anew for each.
    lengths = F.array_repeat(F.sqrt(squares.cast("double")), F.size("_counts"))
    features = F.concat(F.zip_with("_counts", lengths, feature), F.array(bias))
    return rows.select(*kept, features.alias("features"))


def _count(start, end):
    return F.struct(start.alias("start"), (end - start).alias("n"))


def dense_weights(weights: DataFrame, n_settings: int) -> DataFrame:
    """The weights as one array: those of id i from place i * n_settings on; 0 where none is given."""
    none = lambda n: F.array_repeat(F.lit(0).cast("long"), n * n_settings)
    # VOCABULARY + 1 entries at most.
    packed = weights.agg(F.sort_array(F.collect_list(F.struct("feature", "weights"))).alias("entries"))
    dense = filled(F.col("entries"), "feature", lambda e: e["weights"], none, F.lit(VOCABULARY + 1))
    return packed.select(dense.alias("weights"))


def with_margins(rows: DataFrame, weights: DataFrame, n_settings: int) -> DataFrame:
    """`rows` with `margins`, a sum per setting in units of 1 / (UNIT * VALUE).

    The model has a fixed size and reaches the rows as a scalar subquery. It is named once, so
    Spark folds it into the expression and no row carries the weights.
    """
    model = dense_weights(weights, n_settings).scalar()

    def margin(k):
        add = lambda total, f: total + f["v"] * F.get(F.col("_weights"), f["id"] * n_settings + k)
        return F.aggregate("features", F.lit(0).cast("long"), add)

    margins = F.transform(F.sequence(F.lit(0), F.lit(n_settings - 1)), margin)
    return rows.withColumn("_weights", model).withColumn("margins", margins).drop("_weights")


def probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-(margin / float(UNIT * VALUE))))


def fit(rows: DataFrame, settings=PLAIN, epochs=EPOCHS, rate=RATE, label_col="label") -> DataFrame:
    """`feature, weights` after some epochs over `rows` (label 0 or 1, features), one weight per setting.

    `rows` is read once per epoch, so it should be a stored table. Weights move along the mean
    gradient of the log loss, are shrunk by the squared part of the regularisation and cut by its
    absolute part; the bias is not regularised. Rows with a NULL label are left out. What is shuffled
    per epoch is one row per task and word id.
    """
    settings = list(settings.values())
    rows = rows.filter(F.col(label_col).isNotNull())
    total = max(1, rows.count())
    weights = rows.sparkSession.createDataFrame([], "feature int, weights array<bigint>")
    for _ in range(epochs):
        residual = lambda m: F.round((F.col(label_col) - probability(m)) * UNIT).cast("long")
        judged = with_margins(rows, weights, len(settings))
        judged = judged.select(F.transform("margins", residual).alias("residuals"), "features")
        each = judged.select("residuals", F.explode("features").alias("f"))
        sums = [F.sum(F.col("f.v") * F.col("residuals")[k]).alias(f"g{k}") for k in range(len(settings))]
        gradient = each.groupBy(F.col("f.id").alias("feature")).agg(*sums)
        joined = gradient.join(F.broadcast(weights), "feature", "left")
        moved = [
            _moved(F.coalesce(F.col("weights")[k], F.lit(0)), F.col(f"g{k}"), total, rate, *setting)
            for k, setting in enumerate(settings)
        ]
        weights = stage(joined.select("feature", F.array(*moved).alias("weights")), "epoch")
    return weights


def _moved(weight, gradient, total, rate, reg, mixing):
    """The weight after a step, in whole millionths."""
    free = F.col("feature") == BIAS
    step = gradient / F.lit(total * float(VALUE)) * F.lit(rate)
    shrunk = weight.cast("double") * F.when(free, F.lit(1.0)).otherwise(F.lit(1 - rate * reg * (1 - mixing)))
    cut = F.when(free, F.lit(0.0)).otherwise(F.lit(rate * reg * mixing * UNIT))
    after = shrunk + step
    return F.round(F.signum(after) * F.greatest(F.abs(after) - cut, F.lit(0.0))).cast("long")


def score(rows: DataFrame, weights: DataFrame, place=0, n_settings=1) -> DataFrame:
    """`rows` with `logits` of the setting at `place`, without the features."""
    scored = with_margins(rows, weights, n_settings)
    return scored.withColumn("logits", F.col("margins")[place] / float(UNIT * VALUE)).drop("features", "margins")


def weight_rows(weights: DataFrame, place=0) -> DataFrame:
    """`feature, weight_micro` of one setting; the bias is the feature `BIAS`."""
    return weights.select("feature", F.col("weights")[place].alias("weight_micro"))


def select_setting(train: DataFrame, held_out: DataFrame, settings, threshold=0.5, **options) -> DataFrame:
    """Accuracy of each setting on held-out rows: setting, reg, mixing, n, right, accuracy, best.

    All settings are trained together and judged in one scan of `held_out`. The best has the
    highest accuracy; of equal ones the first by name. Without held-out rows accuracy is NULL.
    """
    weights = fit(train, settings, **options)
    judged = with_margins(held_out, weights, len(settings))
    hit = lambda m: (over_threshold(m / float(UNIT * VALUE), threshold) == F.col("label")).cast("long")
    judged = judged.select(F.transform("margins", hit).alias("hits"))
    counts = judged.agg(
        F.count("*").alias("n"),
        *[F.coalesce(F.sum(F.col("hits")[k]), F.lit(0)).alias(f"right{k}") for k in range(len(settings))],
    )
    entries = [
        F.struct(
            F.lit(name).alias("setting"),
            F.lit(float(reg)).alias("reg"),
            F.lit(float(mixing)).alias("mixing"),
            F.col(f"right{k}").alias("right"),
        )
        for k, (name, (reg, mixing)) in enumerate(settings.items())
    ]
    rows = counts.select("n", F.explode(F.array(*entries)).alias("s")).select("s.*", "n")
    rows = rows.withColumn("accuracy", F.try_divide(F.col("right").cast("double"), F.col("n").cast("double")))
    # One row per setting.
    first = F.row_number().over(Window.orderBy(F.col("accuracy").desc_nulls_last(), "setting"))
    return rows.select("setting", "reg", "mixing", "n", "right", "accuracy", (first == 1).alias("best"))
