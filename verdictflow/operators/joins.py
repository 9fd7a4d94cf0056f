"""Joins between posts, pending predictions and logs."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictflow.session import stage

# A key is hot when it holds more than 1 / HOT_KEYS of the rows, so there are fewer
# than HOT_KEYS of them. A hot key is spread over tasks by its share of SPREAD pieces.
HOT_KEYS = 1000
SPREAD = 4096
SKETCH_GROUPS = 64


def fits_broadcast(df: DataFrame) -> bool:
    """True when Spark's own size estimate lets it broadcast the frame."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return 0 <= int(str(size)) <= limit


def hot_keys(df: DataFrame, key: str, min_rows=100_000) -> DataFrame:
    """Hashes of keys that hold many rows, with the number of pieces to spread each over.

    Sketches of bounded size per task, merged in two steps, find them without a
    shuffle of rows. They only choose how a join is spread, never its result. There
    are fewer than HOT_KEYS rows, and their `pieces` add up to at most SPREAD + HOT_KEYS.
    """
    tracked = HOT_KEYS * 10
    group = F.spark_partition_id() % SKETCH_GROUPS
    sketches = (
        df.select(F.xxhash64(key).alias("_key"))
        .groupBy(group.alias("_group"))
        .agg(
            F.expr(f"approx_top_k_accumulate(_key, {tracked})").alias("sketch"),
            F.count(F.lit(1)).alias("rows"),
        )
    )
    # Grouped, so that an empty input gives no row.
    top = sketches.groupBy(F.lit("all")).agg(
        F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"),
        F.sum("rows").alias("rows"),
    ).select("rows", F.expr(f"inline(approx_top_k_estimate(sketch, {HOT_KEYS}))"))
    return top.filter(
        (F.col("count") >= min_rows) & (F.col("count") * HOT_KEYS > F.col("rows"))
    ).select(
        F.col("item").alias("hot"),
        F.ceil(F.col("count") / F.col("rows") * SPREAD).cast("int").alias("pieces"),
    )


def spread_join(left, right, key, how, spread_by, min_rows=100_000):
    """Join `left` with `right` (one row per key) on a string key, NULL matching NULL.

    A right side that Spark can broadcast is joined as it is. Beyond that size both
    sides are shuffled: rows of hot keys in `left` are spread by the hash of the
    `spread_by` columns, and `right` repeats its few hot rows once per piece.
    """
    right = right.withColumnRenamed(key, "_key")
    same_key = F.col(key).eqNullSafe(F.col("_key"))
    if fits_broadcast(right):
        return left.join(right, same_key, how).drop("_key")
    # Read once to the driver (under HOT_KEYS rows): both sides must see the same pieces.
    found = hot_keys(left, key, min_rows).collect()
    if not found:
        return left.join(right, same_key, how).drop("_key")
    hot = F.broadcast(left.sparkSession.createDataFrame(found, "hot bigint, pieces int"))
    piece = F.pmod(F.xxhash64(*spread_by), F.coalesce("pieces", F.lit(1))).cast("int")
    pieced = left.join(hot, F.xxhash64(key) == F.col("hot"), "left").select(
        *left.columns, piece.alias("_piece")
    )
    every = F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)
    repeated = right.join(hot, F.xxhash64("_key") == F.col("hot"), "left").select(
        *right.columns, F.explode(every).alias("_of")
    )
    joined = pieced.join(repeated, same_key & (F.col("_piece") == F.col("_of")), how)
    return joined.drop("_piece", "_key", "_of")


def unseen_by_title(posts, state, min_rows=100_000):
    """Posts whose title is not in the state table; a NULL title matches a NULL one."""
    titles = state.select("title").distinct()
    return spread_join(posts, titles, "title", "left_anti", ["submission_id"], min_rows)


def first_by_id(batch):
    """One row per submission_id, the newest.

    Repeated ids are found on the id column alone. Only their rows are sorted, and Spark
    cuts each task's rows to one per id before that shuffle, so even an id that
    holds a third of the rows stays small; all other rows pass as they are.
    """
    ids = batch.groupBy("submission_id").agg(F.count(F.lit(1)).alias("_n"))
    repeated = stage(ids.filter("_n > 1").select("submission_id"), "repeated-ids")
    if repeated.isEmpty():
        return batch
    same = batch["submission_id"].eqNullSafe(repeated["submission_id"])
    once = batch.join(repeated, same, "left_anti")
    return once.unionByName(newest_of_each(batch.join(repeated, same, "left_semi")))


def newest_of_each(rows):
    """The newest row of every submission_id; rows of one time are told apart by all columns."""
    order = [F.desc("created_utc"), "title", "url", "link_flair_text"]
    order += [F.xxhash64(c) for c in ("selftext",) if c in rows.columns]
    ranked = rows.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("submission_id").orderBy(*order))
    )
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def new_by_id(batch, logged):
    """Batch posts, each once, whose id is not in the logged rows.

    Logged posts are dropped first. A short list of ids is broadcast; a long one costs the
    batch its only shuffle.
    """
    known = logged.select("submission_id").distinct()
    return first_by_id(batch.join(known, "submission_id", "left_anti"))


def latest_by_title(posts):
    """The newest post of every title, as (title, outcome_str)."""
    order = [F.desc("created_utc"), "submission_id"]
    ranked = posts.select(
        "title", "created_utc", "submission_id", F.col("link_flair_text").alias("outcome_str")
    ).withColumn("_rank", F.row_number().over(Window.partitionBy("title").orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).select("title", "outcome_str")


def title_lookup(pending, posts):
    """(title, outcome_str) of each distinct pending title found among the posts.

    A short list of titles is broadcast and narrows the posts before they are ranked.
    A long one is joined after it, with one row per title on both sides.
    """
    titles = pending.filter(F.col("title").isNotNull()).select("title").distinct()
    if fits_broadcast(titles):
        return latest_by_title(posts.join(titles, "title", "left_semi"))
    return latest_by_title(posts).join(titles, "title", "left_semi")


def resolve(pending, lookup, min_rows=100_000):
    """Pending predictions with their outcome where one was found: one row per prediction.

    `lookup` has one row per title with outcome_str and outcome.
    """
    return spread_join(pending, lookup, "title", "left", ["url", "message_id"], min_rows)


def resolved(merged):
    return merged.filter(F.col("outcome").isNotNull())


def still_unresolved(merged):
    return merged.filter(F.col("outcome").isNull()).drop("outcome", "outcome_str")
