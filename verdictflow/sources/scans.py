"""Readers: state tables, training files and files chosen by the date in their name."""

from datetime import timedelta

from pyspark.sql import functions as F

from verdictflow.schemas import TRAINING_CSV
from verdictflow.sources.files import exists


def empty(spark, schema):
    """A table without rows, which Spark knows to be empty when it plans a join."""
    nothing = [F.lit(None).cast(field.dataType).alias(field.name) for field in schema.fields]
    return spark.range(0).select(*nothing)


def read_if_exists(spark, path, schema, fmt="parquet", **options):
    """The table at a path, or an empty one of the same schema."""
    if not exists(spark, path):
        return empty(spark, schema)
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def read_required(spark, path, schema, fmt="parquet", **options):
    """The table at a path; a job that cannot start without it stops here."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return read_if_exists(spark, path, schema, fmt, **options)


def training_csv(spark, path, schema=TRAINING_CSV):
    """CSV with quoted multi-line text, quotes doubled.

    A file with line breaks in fields is read by one task, so large training sets
    should come as many files, or be converted to Parquet once.
    """
    return spark.read.schema(schema).csv(
        path,
        header=True,
        multiLine=True,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        nullValue="\\N",
        emptyValue="",
    )


def write_training_csv(df, path):
    """The counterpart of `training_csv`."""
    df.write.csv(
        path,
        header=True,
        quoteAll=True,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        nullValue="\\N",
        emptyValue="",
    )


def last_days(df, run_date, n, exclude_today=False, column="post_date"):
    """Rows of the last n days up to `run_date`; without today it is n - 1 days.

    On a table partitioned by the column only those partitions are read.
    """
    day = F.lit(str(run_date)).cast("date")
    newest = F.date_sub(day, 1) if exclude_today else day
    return df.filter(
        (F.col(column) >= F.date_sub(day, n - 1)) & (F.col(column) <= newest)
    )


def files_last_days(df, run_date, n, date_format="%Y-%m-%d", exclude_today=False):
    """Rows of those files whose name contains one of the last n days.

    `df` is a file scan; the condition is on the file's name alone, so Spark drops the
    other files before it opens them.
    """
    days = [run_date - timedelta(days=back) for back in range(int(exclude_today), n)]
    matches = F.lit(False)
    for day in days:
        matches |= F.col("_metadata.file_name").contains(day.strftime(date_format))
    return df.filter(matches)
