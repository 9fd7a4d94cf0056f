"""Counts, distributions and binomial accuracy statistics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from verdictflow.functions.labels import is_class, is_decided
from verdictflow.functions.scores import without_nan
from verdictflow.session import stage


def verdict_counts(posts):
    """Posts scanned, and how many of them are decided YTA and NTA, in one pass."""
    flair = F.col("link_flair_text")
    return posts.agg(
        F.count(F.lit(1)).alias("n_scanned"),
        F.count_if(is_decided(flair) & is_class(flair, 1.0)).alias("n_yta"),
        F.count_if(is_decided(flair) & is_class(flair, 0.0)).alias("n_nta"),
    )


def count_table(df, column, digits=1):
    """Count and percentage of each non-NULL value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("n")
    )
    share = F.col("n") * 100.0 / counts.agg(F.sum("n")).scalar()
    return counts.select(
        column, "n", F.concat(F.round(share, digits).cast("string"), F.lit("%")).alias("share")
    )


def date_range(df, column="post_date"):
    return df.agg(
        F.min(column).alias("min_post_date"), F.max(column).alias("max_post_date")
    )


def confusion_matrix(df, actual="outcome", predicted="pred"):
    """Counts of predicted classes (columns) per actual class (rows), NULLs left out."""
    both = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return both.groupBy(actual).agg(
        F.count_if(F.col(predicted) == 0).alias("predicted_0"),
        F.count_if(F.col(predicted) == 1).alias("predicted_1"),
    )


def binomial_columns(success, n):
    """rate, sd_prop, sd_n and se of `success` out of `n`; NULL where n is 0."""
    rate = F.try_divide(success.cast("double"), n.cast("double"))
    variance = rate * (1 - rate)
    return {
        "rate": rate,
        "sd_prop": F.sqrt(variance),
        "sd_n": F.sqrt(variance * n),
        "se": F.sqrt(F.try_divide(variance, n.cast("double"))),
    }


def binomial_stats(df, column):
    """Success count and spread of a 0/1 column; NULLs count as trials."""
    totals = df.agg(
        F.coalesce(F.sum(F.col(column).cast("bigint")), F.lit(0)).alias("success"),
        F.count(F.lit(1)).alias("n"),
    )
    columns = binomial_columns(F.col("success"), F.col("n"))
    return totals.select("success", "n", *[c.alias(name) for name, c in columns.items()])


def accuracy_by_type(scored, by=(), flag="accurate", outcome="outcome"):
    """Binomial accuracy for all rows (Total) and for the two classes (YTA, NTA).

    One pass: each row counts for Total and for its class, partly summed before the
    shuffle. A class without rows has n = 0 and NULL rates.
    """
    per_type = [("Total", F.lit(True)), ("YTA", F.col(outcome) == 1), ("NTA", F.col(outcome) == 0)]
    sums = scored.groupBy(*by).agg(
        *[
            F.struct(
                F.lit(name).alias("outcome_type"),
                F.coalesce(
                    F.sum(F.when(member, F.col(flag).cast("bigint"))), F.lit(0)
                ).alias("success"),
                F.count_if(member).alias("n"),
            ).alias(name)
            for name, member in per_type
        ]
    )
    rows = sums.select(*by, F.explode(F.array("Total", "YTA", "NTA")).alias("_row"))
    return rows.select(*by, "_row.*")


def accuracy_summary(scored, unsampled, run_date, flag="accurate"):
    """History rows of one run: accuracy per type, and the dates of the unsampled batch."""
    dates = date_range(unsampled).select(
        F.struct("min_post_date", "max_post_date").alias("dates")
    )
    columns = binomial_columns(F.col("success"), F.col("n"))
    return (
        accuracy_by_type(scored, flag=flag)
        .withColumn("_dates", dates.scalar())
        .select(
            F.lit(run_date).cast("date").alias("date"),
            "outcome_type",
            "success",
            "n",
            columns["rate"].alias("rate"),
            columns["se"].alias("se"),
            "_dates.min_post_date",
            "_dates.max_post_date",
        )
    )


def daily_history(scored, flag="accurate"):
    """History rows with one run per post date."""
    columns = binomial_columns(F.col("success"), F.col("n"))
    return accuracy_by_type(scored, by=["post_date"], flag=flag).select(
        F.col("post_date").alias("date"),
        "outcome_type",
        "success",
        "n",
        columns["rate"].alias("rate"),
        columns["se"].alias("se"),
        F.col("post_date").alias("min_post_date"),
        F.col("post_date").alias("max_post_date"),
    )


def control_limits(history):
    """Mean rate and three-sigma limits over the Total rows (one row)."""
    total = history.filter(F.col("outcome_type") == "Total")
    spread = total.agg(
        F.avg("rate").alias("mean_rate"), F.stddev_samp("rate").alias("sd_rate")
    )
    return spread.select(
        "mean_rate",
        "sd_rate",
        (F.col("mean_rate") + 3 * F.col("sd_rate")).alias("ucl"),
        (F.col("mean_rate") - 3 * F.col("sd_rate")).alias("lcl"),
    )


def control_chart(history):
    """The Total rows with the limits beside them: the data of the control chart."""
    limits = control_limits(history).select(F.struct("mean_rate", "ucl", "lcl").alias("limits"))
    return (
        history.filter(F.col("outcome_type") == "Total")
        .withColumn("_limits", limits.scalar())
        .select("*", "_limits.mean_rate", "_limits.ucl", "_limits.lcl")
        .drop("_limits")
    )


def mean_accuracy(df, pred="pred", label="label", by=()):
    """Rows and share of predictions equal to the label."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(pred) == F.col(label)).cast("int")).alias("accuracy"),
    )


def grade_counts(graded):
    return graded.groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


def coverage_curve(scored, threshold=0.5, partitions=None):
    """Accuracy among the rows at least as confident as each level: the risk-coverage curve.

    One row per distinct confidence, the distance of the score from the threshold: `confidence,
    n_covered, coverage, success, accuracy`. Rows without a score or an outcome of the two classes
    are left out. Rows of one level are added up in each task first. Levels are then dealt by
    range; the totals of each range, a row per partition, give the sums before it, so no window
    runs over all rows.
    """
    rows = scored.filter(without_nan(F.col("logits")).isNotNull() & F.col("outcome").isin(0, 1))
    levels = rows.groupBy(F.abs(F.col("logits") - threshold).alias("confidence")).agg(
        F.count("*").alias("n"), F.sum(F.col("accurate").cast("long")).alias("right")
    )
    order = F.col("confidence").desc()
    dealt = levels.repartitionByRange(partitions, order) if partitions else levels.repartitionByRange(order)
    dealt = stage(dealt.withColumn("part", F.spark_partition_id()), "levels")
    # One row per partition.
    totals = dealt.groupBy("part").agg(F.sum("n").alias("part_n"), F.sum("right").alias("part_right"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("part").alias("of_part"),
        F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("part_right").over(before), F.lit(0)).alias("right_before"),
    )
    total = dealt.agg(F.sum("n")).scalar()
    upto = Window.partitionBy("part").orderBy(order)
    summed = dealt.join(F.broadcast(offsets), F.col("part") == F.col("of_part")).select(
        "confidence",
        (F.col("n_before") + F.sum("n").over(upto)).alias("n_covered"),
        (F.col("right_before") + F.sum("right").over(upto)).alias("success"),
    )
    return summed.select(
        "confidence",
        "n_covered",
        (F.col("n_covered") / total).alias("coverage"),
        "success",
        (F.col("success") / F.col("n_covered")).alias("accuracy"),
    )
