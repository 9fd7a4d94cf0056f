"""Row filters and derived columns of the post feed."""

from pyspark.sql import functions as F

from verdictflow.functions.labels import is_decided, is_two_class


def newest(posts, n):
    """The n newest posts; a top-n per task, then one merge of the winners."""
    return posts.orderBy(F.desc("created_utc"), "submission_id").limit(n)


def undecided(posts):
    """Posts without any flair; an empty flair counts as one."""
    return posts.filter(F.col("link_flair_text").isNull())


def decided(posts):
    return posts.filter(is_decided(F.col("link_flair_text")))


def two_class(posts):
    return posts.filter(is_two_class(F.col("link_flair_text")))


def length_filter(posts, mode="intended", shorter=200, longer=6500):
    """Drop very short and very long bodies.

    The condition as the original jobs wrote it (`shorter >= length >= longer`) never
    holds, so mode `as_written` keeps every row and reads no body; `intended` keeps the
    lengths between.
    """
    if mode == "as_written" and shorter < longer:
        return posts
    if mode != "intended":
        raise ValueError(f"no length filter {mode!r} for {shorter} and {longer}")
    length = F.length("selftext")
    return posts.filter((length > shorter) & (length < longer))
