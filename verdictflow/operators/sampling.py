"""Selection of confident rows, samples and stratified splits.

Random choices follow the order of md5(id, seed): repeatable, and independent of
partitioning. `id_col` must be a key of the input, and a class column has few values.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictflow.functions.hashing import shuffle_key
from verdictflow.functions.scores import without_nan
from verdictflow.operators.quantiles import class_thresholds
from verdictflow.session import stage

# Lengths of the two hash prefixes that narrow a rank: 4,096 and 16 million of them.
PREFIX_DIGITS = (3, 6)
# A table with a row per stratum and cut is broadcast up to so many rows.
BROADCAST_ROWS = 10_000


def confident_extremes(df, share=0.1, class_col="pred", score_col="logits", thresholds=None):
    """Rows scored below the low threshold of class 0 or above the high one of class 1.

    The comparison is strict and ignores the row's own class. A class without rows
    has no threshold and selects nothing.
    """
    if thresholds is None:
        thresholds = class_thresholds(df, share, class_col, score_col)
    limits = thresholds.select(F.struct("t0", "t1").alias("limits")).scalar()
    score = without_nan(F.col(score_col))
    return df.filter((score < limits.getField("t0")) | (score > limits.getField("t1")))


def ranked(df, score_col="logits", id_col="submission_id"):
    """Ascending by score; the id breaks ties and splits a hot score over several tasks."""
    return df.orderBy(score_col, id_col)


def sample_n(df, n, id_col="submission_id", seed=0):
    """n random rows, or all when there are fewer."""
    return df.orderBy(shuffle_key(F.col(id_col), seed), id_col).limit(n)


def hash_cutoffs(df: DataFrame, stratum: str, id_col: str, seed, cuts: dict) -> DataFrame:
    """For each stratum the hash at the wanted ranks of its random order.

    `cuts` maps a name to a function from the stratum's size to a rank. The result
    has one row per stratum: stratum, and a hash per name; the rows up to that rank
    are those with `shuffle_key <= hash`.

    Counts per hash prefix say which prefix a rank falls into, counts per longer
    prefix narrow that one, and only the rows under it are ranked: about a
    16-millionth of a stratum. The input is read once: its strata and hashes are staged,
    and the passes read those.
    """
    keyed = stage(
        df.select(F.col(stratum).alias("stratum"), shuffle_key(F.col(id_col), seed).alias("key")), "sample-keys"
    )
    short, long = (F.substring("key", 1, digits) for digits in PREFIX_DIGITS)
    whole = Window.partitionBy("stratum")
    # At most 4,096 prefixes per stratum.
    edges = stage(
        keyed.groupBy("stratum", short.alias("prefix"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "stratum",
            "prefix",
            "n",
            (F.sum("n").over(whole.orderBy("prefix")) - F.col("n")).alias("before"),
            F.sum("n").over(whole).alias("total"),
        ),
        "sample-edges",
    )
    small = _broadcast_if(edges.select("stratum").distinct().count() * len(cuts) <= BROADCAST_ROWS)
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("cut"), rank(F.col("total")).cast("bigint").alias("rank"))
            for name, rank in cuts.items()
        ]
    )
    around = edges.select("*", F.explode(wanted).alias("_cut")).select("*", "_cut.*")
    first = _holding_rank(around)

    per_cut = Window.partitionBy("stratum", "cut")
    finer = (
        _rows_under(keyed, first, short, small)
        .groupBy("stratum", "cut", "rank", "before", long.alias("prefix"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn(
            "before", F.col("before") + F.sum("n").over(per_cut.orderBy("prefix")) - F.col("n")
        )
    )
    ranked = _rows_under(keyed, _holding_rank(finer), long, small).withColumn(
        "place", F.col("before") + F.row_number().over(per_cut.orderBy("key"))
    )
    at_rank = ranked.filter(F.col("place") == F.col("rank")).select(
        F.col("stratum").alias("_stratum"), "cut", "key"
    )

    totals = edges.groupBy("stratum").agg(F.max("total").alias("total"))
    found = totals.join(
        small(at_rank), F.col("stratum").eqNullSafe(F.col("_stratum")), "left"
    ).groupBy("stratum", "total")
    hashes = found.agg(
        *[F.max(F.when(F.col("cut") == name, F.col("key"))).alias(f"_{name}") for name in cuts]
    )
    # "" lies below every hash and "g" above.
    return hashes.select(
        "stratum",
        *[
            F.when(rank(F.col("total")) <= 0, F.lit(""))
            .when(rank(F.col("total")) >= F.col("total"), F.lit("g"))
            .otherwise(F.col(f"_{name}"))
            .alias(name)
            for name, rank in cuts.items()
        ],
    )


def _holding_rank(prefixes):
    """The one prefix per stratum and cut that holds the wanted rank."""
    return prefixes.filter(
        (F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("n"))
    ).select("stratum", "cut", "rank", "prefix", "before")


def _broadcast_if(fits):
    return F.broadcast if fits else lambda df: df


def _rows_under(keyed, prefixes, prefix, small):
    """Rows of `keyed` under one of the prefixes, of which there is one per stratum and cut."""
    named = prefixes.withColumnsRenamed({"stratum": "_stratum", "prefix": "_prefix"})
    return keyed.join(
        small(named),
        F.col("stratum").eqNullSafe(F.col("_stratum")) & (prefix == F.col("_prefix")),
    ).drop("_stratum", "_prefix")


def _with_cutoffs(df, stratum, id_col, seed, cuts, keys=None):
    """`df` with the row's hash `_key` and its stratum's cutoffs; with few strata no row is shuffled."""
    cutoffs = stage(hash_cutoffs(df if keys is None else keys, stratum, id_col, seed, cuts), "sample-cutoffs").withColumnRenamed(
        "stratum", "_stratum"
    )
    small = _broadcast_if(cutoffs.count() <= BROADCAST_ROWS)
    return df.join(
        small(cutoffs), F.col(stratum).eqNullSafe(F.col("_stratum"))
    ).withColumn("_key", shuffle_key(F.col(id_col), seed))


def balanced_sample(df, class_col, n, id_col="submission_id", seed=0, keys=None):
    """n random rows of each class, all of a class with fewer; NULL is no class.

    `n` is a number or a column, such as a scalar subquery with a class count. `keys`, if
    given, holds class and id of the same rows, for the ranks.
    """
    wanted = n if not isinstance(n, int) else F.lit(n)
    rows = df.filter(F.col(class_col).isNotNull())
    keys = None if keys is None else keys.filter(F.col(class_col).isNotNull())
    cut = _with_cutoffs(rows, class_col, id_col, seed, {"_upto": lambda total: wanted}, keys)
    return cut.filter(F.col("_key") <= F.col("_upto")).select(*df.columns)


def stratified_split(df, label_col, id_col="submission_id", hold_share=0.132865, seed=42):
    """A `split` column: a held-out share of each class, half of it val, half test; else train."""

    def hold(total):
        return F.ceil(total * F.lit(hold_share))

    cut = _with_cutoffs(
        df,
        label_col,
        id_col,
        seed,
        {"_val": lambda total: F.floor(hold(total) / 2), "_hold": hold},
    )
    split = (
        F.when(F.col("_key") <= F.col("_val"), F.lit("val"))
        .when(F.col("_key") <= F.col("_hold"), F.lit("test"))
        .otherwise(F.lit("train"))
    )
    return cut.select(*df.columns, split.alias("split"))


def stratified_subsample(df, label_col, drop_share, id_col="submission_id", seed=42):
    """Without a share of each class, for quick runs."""
    cut = _with_cutoffs(
        df,
        label_col,
        id_col,
        seed,
        {"_drop": lambda total: F.ceil(total * F.lit(drop_share))},
    )
    return cut.filter(F.col("_key") > F.col("_drop")).select(*df.columns)
