"""Post feed and scored feed bound to the tables of a data folder."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictflow.functions.scores import over_threshold
from verdictflow.schemas import POSTS

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def table(spark, data_dir, name):
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def posts_from(documents, labels, extra=()):
    """Posts from documents (first line = title, rest = body) and their labels.

    The text is cut before the join, so queries that need no body do not carry it.
    """
    head = F.substring_index("text", "\n", 1)
    parts = documents.select(
        F.col("doc_id"),
        head.alias("title"),
        F.col("text").substr(F.length(head) + 2, F.length("text")).alias("selftext"),
        *extra,
    )
    marks = labels.select(F.col("doc_id").alias("label_id"), "quality", "toxic")
    two_sided = F.when(F.col("doc_id") % 2 == 0, "Asshole").otherwise("Not the A-hole")
    flair = (
        F.when(F.col("label_id").isNull(), F.lit(None))
        .when(F.col("doc_id") % 23 == 0, "META")
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), two_sided)
        .when(F.col("quality") == 1, "Everyone Sucks")
        .when(F.col("toxic") == 0, "Not enough info")
        .otherwise("No A-holes here")
    )
    number = F.col("doc_id").cast("string")
    return parts.join(marks, F.col("doc_id") == F.col("label_id"), "left").select(
        number.alias("submission_id"),
        "title",
        "selftext",
        flair.alias("link_flair_text"),
        (F.lit(1704067200) + F.col("doc_id") * 3600).cast("double").alias("created_utc"),
        F.concat(F.lit("https://example.org/post/"), number).alias("url"),
        *extra,
    )


def posts(spark, data_dir, extra=()):
    feed = posts_from(table(spark, data_dir, "documents"), table(spark, data_dir, "labels"), extra)
    assert feed.schema.fieldNames()[: len(POSTS)] == POSTS.fieldNames()
    return feed


def scored_from(events):
    """Scored rows with an outcome, from events."""
    logits = F.col("value") / 50 - 1
    outcome = (
        F.when(F.col("event_type") == "click", 1)
        .when(F.col("event_type") == "view", 0)
        .when(F.col("event_type") == "purchase", 2)
        .when(F.col("event_type") == "signup", 3)
        .when(F.col("user_id") % 2 == 0, 4)
    )
    return events.select(
        F.col("event_id").alias("submission_id"),
        F.col("ts").cast("date").alias("post_date"),
        logits.alias("logits"),
        over_threshold(logits).alias("pred"),
        outcome.cast("double").alias("outcome"),
    )


def scored(spark, data_dir):
    return scored_from(table(spark, data_dir, "events"))


def stream(spark, data_dir, name, schema, files_per_batch=None):
    """A file stream over a table of the data folder, which may be one file or a folder of files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # Written as a glob, since a stream's plain path has to be a folder.
    return reader.parquet(f"{data_dir}/{name}.parque[t]")
