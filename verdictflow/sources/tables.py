"""Tables that jobs keep between runs: versioned state, a log by date, an archive, an outbox."""

import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictflow.schemas import DAILY_LOG, HISTORY, OUTBOX, PENDING, RESOLVED
from verdictflow.session import stage
from verdictflow.sources.files import child_names, create, exists, make_folder, modified, move, remove
from verdictflow.sources.id_index import MONTH, IdIndex, month_of
from verdictflow.sources.scans import empty, read_if_exists


@dataclass(frozen=True)
class _Version:
    number: int
    mark: str | None
    name: str


class VersionedTable:
    """A table replaced as a whole: each write is a new folder, the newest complete one counts.

    The version in use is never overwritten, so a job may read it while it writes the
    next, and a failed write leaves the table as it was. A writer claims the next number with
    a file that only one can create, so two writers never share a folder. A write may carry a
    `mark` (a stream and its batch): the table tells whether a mark was written, whatever
    other writers did in between. The newest `keep` versions stay, and the newest of each
    stream.
    """

    # A claim without a version for so long was left by a writer that died.
    CLAIM_SECONDS = 60

    def __init__(self, spark: SparkSession, path: str, schema, keep=20):
        self.spark, self.path, self.schema, self.keep = spark, path, schema, keep

    def _versions(self) -> list[_Version]:
        """Complete versions, the newest first."""
        found = []
        for name in child_names(self.spark, self.path):
            match = re.fullmatch(r"v=(\d+)(?:--(.+))?", name)
            if match and exists(self.spark, f"{self.path}/{name}/_SUCCESS"):
                found.append(_Version(int(match[1]), match[2], name))
        return sorted(found, key=lambda v: -v.number)

    def version(self) -> int:
        """Number of the newest complete version, -1 when there is none."""
        return next((v.number for v in self._versions()), -1)

    def has(self, mark: str) -> bool:
        """Whether the mark's write, or a later one of its stream, is complete."""
        stream, batch = _stream_and_batch(mark)
        return any(
            of == stream and done >= batch
            for of, done in (_stream_and_batch(v.mark) for v in self._versions() if v.mark)
        )

    def read(self, version: int | None = None) -> DataFrame:
        for found in self._versions():
            if version is None or found.number == version:
                return self.spark.read.schema(self.schema).parquet(f"{self.path}/{found.name}")
        return empty(self.spark, self.schema)

    def write(self, df: DataFrame, mark: str | None = None, dry_run=False) -> DataFrame:
        """Make `df` the current version, after whatever others write meanwhile."""
        df = df.select(*self.schema.fieldNames())
        if dry_run:
            return df
        staged = self._stage(df)
        number = self._claim(self.version() + 1)
        while number is None:
            number = self._claim(max(self._claimed(), self.version()) + 1)
        return self._commit(staged, number, mark)

    def write_after(self, df: DataFrame, version: int, mark: str | None = None) -> DataFrame | None:
        """Make `df`, computed from `version`, the current one; None if another came first."""
        staged = self._stage(df.select(*self.schema.fieldNames()))
        while (claimed := max(self._claimed(), self.version())) > version:
            if self.version() > version:
                remove(self.spark, staged)
                return None
            # Claimed and not there: on its way, or left behind.
            age = time.time() - modified(self.spark, self._claim_path(claimed))
            if age > self.CLAIM_SECONDS:
                break
            time.sleep(0.5)
        number = self._claim(claimed + 1)
        if number is None:
            remove(self.spark, staged)
            return None
        return self._commit(staged, number, mark)

    def update(self, change, mark: str | None = None, attempts=10) -> DataFrame:
        """Replace the table by `change(table)`, again if another writer came first."""
        for _ in range(attempts):
            version = self.version()
            written = self.write_after(change(self.read(version)), version, mark)
            if written is not None:
                return written
        raise RuntimeError(f"{self.path}: other writers came first {attempts} times")

    def _claim_path(self, number):
        return f"{self.path}/_claims/{number:012d}"

    def _claim(self, number) -> int | None:
        return number if create(self.spark, self._claim_path(number)) else None

    def _claimed(self) -> int:
        return max((int(n) for n in child_names(self.spark, f"{self.path}/_claims")), default=-1)

    def _stage(self, df) -> str:
        staged = f"{self.path}/_staged/{uuid.uuid4().hex}"
        df.write.parquet(staged)
        return staged

    def _commit(self, staged, number, mark) -> DataFrame:
        name = f"v={number:012d}" + (f"--{mark}" if mark else "")
        if not move(self.spark, staged, f"{self.path}/{name}"):
            raise RuntimeError(f"{self.path}: version {number} could not be put in place")
        self._prune()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")

    def _prune(self):
        versions, streams = self._versions(), set()
        for place, version in enumerate(versions):
            stream = _stream_and_batch(version.mark)[0] if version.mark else None
            if place >= self.keep and (stream is None or stream in streams):
                remove(self.spark, f"{self.path}/{version.name}")
            streams.add(stream)
        for number in child_names(self.spark, f"{self.path}/_claims"):
            if versions and int(number) < versions[0].number - self.keep:
                remove(self.spark, f"{self.path}/_claims/{number}")


def _stream_and_batch(mark: str) -> tuple[str, int]:
    stream, batch = mark.rsplit(".", 1)
    return stream, int(batch)


def rows_of_days(table: DataFrame, batch: DataFrame, column: str) -> DataFrame:
    """Rows of a table partitioned by `column`, a date, whose date occurs in the batch.

    Spark prunes partitions by equality only, so rows without a date, in the default
    partition, are found apart. The broadcast is one row per calendar day.
    """
    days = batch.select(column).filter(F.col(column).isNotNull()).distinct()
    dated = table.join(F.broadcast(days), column, "left_semi")
    undated = batch.filter(F.col(column).isNull()).select(F.lit(0).alias("_undated")).limit(1)
    others = table.filter(F.col(column).isNull()).withColumn("_key", F.lit(0))
    others = others.join(F.broadcast(undated), F.col("_key") == F.col("_undated"), "left_semi").drop("_key")
    return dated.select(*table.columns).unionByName(others)


class DailyLog:
    """Scored posts partitioned by post date.

    A batch of more than MANY_DATES dates is laid down by month beside them, its rows in the order
    of their dates: a folder per date would cost more than what is in it. Readers see both as one.
    With an index, kept beside it, the log is read only for ids that may be in it.
    """

    MANY_DATES = 100

    def __init__(self, spark: SparkSession, path: str, schema=DAILY_LOG, column="post_date", indexed=False):
        self.spark, self.path, self.schema, self.column = spark, path, schema, column
        self.months_path = f"{path}_months"
        self.index = IdIndex(spark, f"{path}_ids/months", column) if indexed else None

    def _months(self) -> DataFrame | None:
        if not exists(self.spark, self.months_path):
            return None
        schema = T.StructType([*self.schema.fields, T.StructField(MONTH, T.DateType())])
        return self.spark.read.schema(schema).parquet(self.months_path)

    def _is_there(self) -> bool:
        return exists(self.spark, self.path) or exists(self.spark, self.months_path)

    def read(self) -> DataFrame:
        names, months = self.schema.fieldNames(), self._months()
        dated = read_if_exists(self.spark, self.path, self.schema)
        return dated if months is None else dated.select(*names).unionByName(months.select(*names))

    def read_dates_of(self, batch: DataFrame) -> DataFrame:
        """Log rows of the dates in the batch, whatever their number; NULL is a date too.

        Partitions are chosen when the query runs, from the batch's dates; nothing is
        evaluated before.
        """
        names, months = self.schema.fieldNames(), self._months()
        found = rows_of_days(read_if_exists(self.spark, self.path, self.schema), batch, self.column).select(*names)
        if months is None:
            return found
        days = batch.select(self.column).distinct()
        months = rows_of_days(months, days.select(month_of(self.column)), MONTH)
        return found.unionByName(rows_of_days(months, days, self.column).select(*names))

    def _index_older(self):
        """A log older than its index gets one."""
        if not self.index.is_there() and self._is_there():
            self.index.add(self.read())

    def may_be_known(self, batch: DataFrame) -> DataFrame | None:
        """Id and date of the batch's rows that may be logged; None if the log has no index."""
        if self.index is None:
            return None
        self._index_older()
        return self.index.may_be_known(batch, rows_of_days)

    def append(self, df: DataFrame, dry_run=False) -> DataFrame:
        """Add rows to their dates, or to their months when the dates are many.

        Rebalancing gives each of them few files, and splits one that holds much of
        the batch over several tasks. The rows are staged, so they are computed once.
        """
        df = df.select(*self.schema.fieldNames())
        if not dry_run:
            rows = stage(df, "log-batch")
            if self.index is not None:
                self._index_older()
                self.index.add(rows)
            dates = rows.select(self.column).distinct().limit(self.MANY_DATES + 1).count()
            if dates > self.MANY_DATES:
                rows = rows.withColumn(MONTH, month_of(self.column)).hint("rebalance", MONTH)
                rows = rows.sortWithinPartitions(MONTH, self.column)
                rows.write.mode("append").partitionBy(MONTH).parquet(self.months_path)
            else:
                rows = rows.hint("rebalance", self.column)
                rows.write.mode("append").partitionBy(self.column).parquet(self.path)
        return df


class Archive:
    """Immutable snapshots, one partition per run; a repeated run replaces its own."""

    def __init__(self, spark, path, schema=RESOLVED, column="run_ts"):
        self.spark, self.path, self.schema, self.column = spark, path, schema, column

    def read(self) -> DataFrame:
        fields = [*self.schema.fields, T.StructField(self.column, T.StringType(), True)]
        return read_if_exists(self.spark, self.path, T.StructType(fields))

    def append(self, df: DataFrame, run: str, dry_run=False) -> DataFrame:
        df = df.select(*self.schema.fieldNames())
        if not dry_run:
            df.write.mode("overwrite").parquet(f"{self.path}/{self.column}={run}")
        return df


class Outbox:
    """Messages to be sent, one row per prediction and kind, each added once.

    Messages lie by kind, write and the day of the prediction. A message has one day, so an
    append compares with the known messages of its own days only. Writers of a kind take
    turns: a claim is a file that only one can create, and one older than CLAIM_SECONDS was
    left by a writer that died. What a writer adds shows up as a whole, by a rename.
    """

    CLAIM_SECONDS = 600

    def __init__(self, spark, path):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        return read_if_exists(self.spark, self.path, OUTBOX).select(*OUTBOX.fieldNames())

    def append(self, messages: DataFrame, kind: str, dry_run=False, day_col="date_created") -> DataFrame:
        """Add the messages that are not there yet; returns them. Without `day_col` the day is NULL."""
        day = F.col(day_col) if day_col in messages.columns else F.lit(None).cast("date")
        # A prediction that stands in the state twice still makes one message.
        rows = messages.groupBy("message_id").agg(F.min("message").alias("message"), F.min(day).alias("day"))
        rows = rows.withColumn("kind", F.lit(kind)).select(*OUTBOX.fieldNames())
        if dry_run:
            return self._unknown(rows, kind)
        claim = f"{self.path}/_claims/{kind}"
        self._wait_for(claim)
        try:
            staged = f"{self.path}/_staged/{uuid.uuid4().hex}"
            self._unknown(rows, kind).drop("kind").write.partitionBy("day").parquet(staged)
            added = self.spark.read.schema(OUTBOX).parquet(staged)
            if added.isEmpty():
                remove(self.spark, staged)
                return empty(self.spark, OUTBOX)
            target = f"{self.path}/kind={kind}/write={uuid.uuid4().hex}"
            make_folder(self.spark, f"{self.path}/kind={kind}")
            if not move(self.spark, staged, target):
                raise RuntimeError(f"{self.path}: messages could not be put in place")
        finally:
            remove(self.spark, claim)
        added = self.spark.read.schema(OUTBOX).parquet(target)
        return added.withColumn("kind", F.lit(kind)).select(*OUTBOX.fieldNames())

    def _unknown(self, rows, kind):
        of_kind = self.read().filter(F.col("kind") == kind)
        known = rows_of_days(of_kind, rows, "day").select("message_id")
        return rows.join(known, "message_id", "left_anti").select(*OUTBOX.fieldNames())

    def _wait_for(self, claim):
        while not create(self.spark, claim):
            time.sleep(0.2)
            held = exists(self.spark, claim)
            if held and time.time() - modified(self.spark, claim) > self.CLAIM_SECONDS:
                remove(self.spark, claim)


def pending_table(spark, root):
    return VersionedTable(spark, f"{root}/pending", PENDING)


def history_table(spark, root):
    return VersionedTable(spark, f"{root}/history", HISTORY)


def history_archive(spark, root):
    return Archive(spark, f"{root}/history_archive", HISTORY, "run_date")


def resolved_archive(spark, root):
    return Archive(spark, f"{root}/resolved")


def daily_log(spark, root, indexed=False):
    return DailyLog(spark, f"{root}/daily_log", indexed=indexed)


def outbox(spark, root):
    return Outbox(spark, f"{root}/outbox")
