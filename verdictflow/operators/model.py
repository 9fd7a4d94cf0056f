"""A linear text classifier over hashed words, trained and applied as DataFrame steps.

Weights are whole numbers of millionths, so a score is an exact integer sum: the
same in any order of rows, partitions and attempts.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictflow.functions.text import VOCABULARY, word_id, words

UNIT = 1_000_000
# Ids put together at once are 2 ** BLOCK_BITS.
BLOCK_BITS = 10
# An id is hot when it holds more than 1 / HOT_SHARE of the words.
HOT_SHARE = 1000


def _millionths(value):
    return F.round(value * UNIT).cast("bigint")


def token_counts(posts, text_col="combined_text", max_words=4096):
    """Words of each whole text, and how many a model limited to `max_words` would see."""
    counted = posts.select("submission_id", F.size(words(F.col(text_col))).alias("n_tokens"))
    return counted.withColumn("n_used", F.least(F.col("n_tokens"), F.lit(max_words)))


def token_length_stats(counts):
    return counts.agg(
        F.max("n_tokens").alias("max_tokens"), F.min("n_tokens").alias("min_tokens")
    )


def train_weights(
    training: DataFrame,
    text_col="combined_text",
    label_col="label",
    max_words=None,
    vocabulary=VOCABULARY,
):
    """Naive-Bayes log-odds weight of every word id seen, with add-one smoothing.

    One row per word id (`vocabulary` rows at most): feature, n_pos, n_neg,
    weight_micro, and on every row bias_micro and unseen_micro, the weight of an id
    that was never seen. Word counts are summed in each task before the shuffle, so
    frequent words cost no more than rare ones.
    """
    counts = (
        training.select(
            F.col(label_col).alias("label"),
            F.explode(words(F.col(text_col), max_words)).alias("word"),
        )
        .groupBy(word_id(F.col("word"), vocabulary).alias("feature"))
        .agg(
            F.count_if(F.col("label") == 1).alias("n_pos"),
            F.count_if(F.col("label") == 0).alias("n_neg"),
        )
    )
    priors = training.agg(
        F.ln(
            (F.count_if(F.col(label_col) == 1) + 1) / (F.count_if(F.col(label_col) == 0) + 1)
        ).alias("bias")
    )
    # Spark reads the texts once: both use the same shuffle of counts.
    sums = counts.agg(
        F.struct(
            (F.coalesce(F.sum("n_pos"), F.lit(0)) + vocabulary).alias("pos"),
            (F.coalesce(F.sum("n_neg"), F.lit(0)) + vocabulary).alias("neg"),
        )
    ).scalar()
    pos_total, neg_total = sums.getField("pos"), sums.getField("neg")
    return counts.select(
        "feature",
        "n_pos",
        "n_neg",
        _millionths(
            F.ln((F.col("n_pos") + 1) / pos_total) - F.ln((F.col("n_neg") + 1) / neg_total)
        ).alias("weight_micro"),
        _millionths(priors.scalar()).alias("bias_micro"),
        _millionths(F.ln(neg_total / pos_total)).alias("unseen_micro"),
    )


def filled(entries, place, values, fill, length):
    """An array of `length` with the values of each entry from its place on, and `fill` in between.

    `entries` is a sorted array column with an entry per place; `values(entry)` gives an array of
    one element, or of a whole block if `fill(n)` fills n blocks.
    """
    before = lambda i: F.coalesce(F.get(entries, i - 1)[place], F.lit(-1))
    pieces = F.transform(
        entries, lambda e, i: F.concat(fill((e[place] - before(i) - 1).cast("int")), values(e))
    )
    last = F.coalesce(F.get(entries, F.size(entries) - 1)[place], F.lit(-1))
    return F.concat(F.flatten(pieces), fill((length - last - 1).cast("int")))


def dense_model(weights: DataFrame, vocabulary=VOCABULARY) -> DataFrame:
    """The weights as one row: bias_micro, unseen_micro and an array with a weight for every word id.

    Blocks of ids are put together in parallel, and then joined. It has `vocabulary` entries,
    whatever the weights were trained on.
    """
    size = 1 << BLOCK_BITS
    unseen = F.coalesce("unseen", F.lit(0)).cast("long")
    blocks = weights.groupBy(F.shiftright("feature", BLOCK_BITS).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("feature") % size).alias("at"), "weight_micro"))).alias("entries"),
        F.max("bias_micro").alias("bias"),
        F.max("unseen_micro").alias("unseen"),
    )
    repeat = lambda n: F.array_repeat(unseen, n)
    values = filled(F.col("entries"), "at", lambda e: F.array(e["weight_micro"]), repeat, F.lit(size))
    blocks = blocks.select("block", "bias", "unseen", values.alias("values"))
    packed = blocks.agg(
        F.sort_array(F.collect_list(F.struct("block", "values"))).alias("blocks"),
        F.max("bias").alias("bias"),
        F.max("unseen").alias("unseen"),
    )
    number = -(-vocabulary // size)
    flat = filled(F.col("blocks"), "block", lambda b: b["values"], lambda n: repeat(n * size), F.lit(number))
    return packed.select(
        F.coalesce("bias", F.lit(0)).cast("long").alias("bias_micro"),
        unseen.alias("unseen_micro"),
        F.slice(flat, 1, vocabulary).alias("weights"),
    )


def score(posts: DataFrame, weights: DataFrame, text_col="combined_text", max_words=None, vocabulary=VOCABULARY):
    """`posts` with a `logits` column, from rows of weights."""
    return score_dense(posts, dense_model(weights, vocabulary), vocabulary, text_col, max_words)


def score_dense(posts: DataFrame, model: DataFrame, vocabulary=VOCABULARY, text_col="combined_text", max_words=None):
    """`posts` with a `logits` column, from a model of one row.

    The fixed-size model reaches the rows as a scalar subquery, so scoring is a
    projection: no shuffle, no exploded words, and all other columns ride along.
    """
    model = model.select(F.struct("bias_micro", "weights").alias("model"))
    # Each helper column is used once, so Spark folds it into the expression below and
    # no row carries the weights. Both name the same subquery, which runs once.
    with_model = posts.withColumns(
        {
            "_bias": model.scalar().getField("bias_micro"),
            "_weights": model.scalar().getField("weights"),
        }
    )
    total = F.aggregate(
        words(F.col(text_col), max_words),
        F.col("_bias"),
        lambda acc, word: acc + F.get(F.col("_weights"), word_id(word, vocabulary)),
    )
    return with_model.withColumn("logits", total / F.lit(float(UNIT))).drop("_bias", "_weights")


def hot_ids(weights: DataFrame, share=HOT_SHARE) -> DataFrame:
    """Ids that hold over 1 / `share` of the trained words, and the pieces to spread each over."""
    seen = F.col("n_pos") + F.col("n_neg")
    total = weights.agg(F.coalesce(F.sum(seen), F.lit(0))).scalar()
    pieces = F.ceil(seen / total * share).cast("int")
    return weights.filter(seen * share > total).select(F.col("feature").alias("hot"), pieces.alias("pieces"))


def score_by_join(
    posts: DataFrame, weights: DataFrame, id_col="submission_id", text_col="combined_text", vocabulary=VOCABULARY
):
    """(id_col, logits) of each post, with weights that stay partitioned by word id.

    For vocabularies whose model does not fit one array. A post's words are counted per id
    before they are shuffled; ids that hold much of the text are spread over tasks, with
    their weights repeated. `id_col` is a key. A NULL text has no score.
    """
    rows = posts.select(id_col, text_col)
    each = rows.select(id_col, F.explode(words(F.col(text_col))).alias("word"))
    counts = each.groupBy(id_col, word_id(F.col("word"), vocabulary).alias("feature")).agg(F.count("*").alias("n"))
    # Fewer than HOT_SHARE rows.
    hot = F.broadcast(hot_ids(weights))
    pieces = F.coalesce("pieces", F.lit(1))
    counts = counts.join(hot, F.col("feature") == F.col("hot"), "left").select(
        id_col, "feature", "n", F.pmod(F.xxhash64(id_col), pieces).cast("int").alias("piece")
    )
    repeated = weights.join(hot, F.col("feature") == F.col("hot"), "left").select(
        F.col("feature").alias("of"), "weight_micro", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("of_piece")
    )
    common = weights.agg(
        F.struct(
            F.coalesce(F.max("bias_micro"), F.lit(0)).alias("bias"),
            F.coalesce(F.max("unseen_micro"), F.lit(0)).alias("unseen"),
        )
    ).scalar()
    same = (F.col("feature") == F.col("of")) & (F.col("piece") == F.col("of_piece"))
    found = counts.join(repeated.hint("shuffle_hash"), same, "left")
    weight = F.coalesce("weight_micro", common.getField("unseen"))
    sums = found.groupBy(F.col(id_col).alias("_id")).agg(F.sum(F.col("n") * weight).alias("micro"))
    total = common.getField("bias") + F.coalesce("micro", F.lit(0))
    scored = rows.select(id_col, F.col(text_col).isNotNull().alias("_has_text")).join(
        sums, F.col(id_col) == F.col("_id"), "left"
    )
    logits = F.when(F.col("_has_text"), total / F.lit(float(UNIT)))
    return scored.select(id_col, logits.alias("logits"))
