"""A Bloom filter of ids for each date of a log, kept as a table beside it.

An id sets a few bits of one 64-bit word of its date's filter. Each append adds the words that its
ids set; words of one slot are put together by OR when they are read. An id is looked up by an
equality join on date and slot, so the filters stay distributed and only those of a batch's
months are read. Files lie by month: a folder per date would cost more than what is in it.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictflow.sources.files import exists
from verdictflow.sources.scans import read_if_exists

MONTH = "log_month"

# Words of a filter: up to some 250,000 ids a date are told apart with one error in fifty. With
# more ids the answer is "may be known" more often, never wrongly "new".
SLOTS = 1 << 16
BITS = 4


def month_of(column: str) -> Column:
    """The first day of a date's month; NULL without a date."""
    return F.trunc(column, "month").alias(MONTH)


def slot_of(id_hash: Column, slots: int) -> Column:
    return F.pmod(F.shiftrightunsigned(id_hash, 6 * BITS), F.lit(slots)).cast("int")


def mask_of(id_hash: Column) -> Column:
    """The bits of an id: BITS times six bits of its hash name one."""
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        place = F.shiftrightunsigned(id_hash, 6 * k).bitwiseAND(F.lit(63).cast("long"))
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int")))
    return mask


class IdIndex:
    """The filters of a log with a date `column`."""

    def __init__(self, spark: SparkSession, path: str, column="post_date", id_col="submission_id", slots=SLOTS):
        self.spark, self.path, self.column, self.id_col, self.slots = spark, path, column, id_col, slots
        self.schema = T.StructType(
            [
                T.StructField("slot", T.IntegerType()),
                T.StructField("bits", T.LongType()),
                T.StructField(column, T.DateType()),
                T.StructField(MONTH, T.DateType()),
            ]
        )

    def is_there(self) -> bool:
        return exists(self.spark, self.path)

    def read(self) -> DataFrame:
        return read_if_exists(self.spark, self.path, self.schema)

    def _bits(self, rows: DataFrame) -> DataFrame:
        id_hash = F.xxhash64(self.id_col)
        return rows.select(
            F.col(self.column), slot_of(id_hash, self.slots).alias("slot"), mask_of(id_hash).alias("bits")
        )

    def add(self, rows: DataFrame):
        """Add the ids of `rows`. Comes before the rows are logged: an id that is not logged does no harm."""
        words = self._bits(rows).groupBy(self.column, "slot").agg(F.bit_or("bits").alias("bits"))
        words = words.select("slot", "bits", self.column, month_of(self.column))
        # A month has SLOTS words a day at most. Few bytes would else be written by one task, file after file.
        words = words.repartition(self.spark.sparkContext.defaultParallelism, MONTH)
        words.write.mode("append").partitionBy(MONTH).parquet(self.path)

    def may_be_known(self, batch: DataFrame, rows_of_days) -> DataFrame:
        """Id and date of the rows of `batch` whose id may be in the log under its date.

        `rows_of_days(table, batch, column)` restricts the filters to the batch's months.
        """
        words = rows_of_days(self.read(), batch.select(month_of(self.column)), MONTH)
        words = words.groupBy(F.col(self.column).alias("_day"), F.col("slot").alias("_slot")).agg(
            F.bit_or("bits").alias("_bits")
        )
        ids = batch.select(self.id_col, self.column, F.xxhash64(self.id_col).alias("_hash"))
        same = F.col(self.column).eqNullSafe(F.col("_day")) & (slot_of(F.col("_hash"), self.slots) == F.col("_slot"))
        mask = mask_of(F.col("_hash"))
        return ids.join(words, same).filter(F.col("_bits").bitwiseAND(mask) == mask).select(self.id_col, self.column)
