"""Exact duplicates of texts, found by counting quotient filters and verified byte by byte.

Each task puts the fingerprints of its texts into counting quotient filters: the upper bits of a
fingerprint name its home, the lower bits are stored in sorted order, with a count where one
occurs several times. Filters are cut by the uppermost bits, and those of one slice are merged
without loss, since quotient and remainder give the fingerprint back. What counts above one
goes to verification: only texts whose quotient is marked in a bitmap of the merged filters are
dealt, equal ones added up in each task before, and compared as a whole.

What is dealt of other texts is their place in a filter.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from verdictflow.session import stage

BITS = 64
#: Fingerprints of a filter before it is sent, rows that a merging task should get, and the
#: fewest slices.
FILTER_ROWS, SLICE_ROWS, LEAST_SLICE_BITS = 1 << 20, 1 << 20, 8
#: Bits of the bitmap of marked quotients: 32 for each repeated fingerprint, within these.
#: Beyond the larger one more texts are dealt than are repeated; the result is the same.
LEAST_MARKS, MOST_MARKS = 1 << 12, 1 << 26
MARKS_EACH = 32
#: A group with more than a thousandth of the rows is hot; there are fewer than a thousand.
HOT_SHARE = 1000


class QuotientFilter:
    """A counting quotient filter over the fingerprints of one slice.

    `occupied` has a bit per quotient, `run_end` a bit per slot that is set on the last
    remainder of a quotient, `remainders` the lower bits in sorted order, `counted` a bit per
    slot whose count follows in `counts`; the others occur once.
    """

    def __init__(self, skip: int, bits: int, slots: int, occupied, run_end, remainders, counted, counts):
        self.skip, self.bits, self.slots = skip, bits, slots
        self.occupied, self.run_end, self.remainders = occupied, run_end, remainders
        self.counted, self.counts = counted, counts

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray, skip: int):
        """From sorted distinct fingerprints that share their upper `skip` bits."""
        bits = min(BITS - skip, max(6, int(len(prints)).bit_length() + 1))
        rest = np.uint64(BITS - skip - bits)
        inner = prints & np.uint64((1 << (BITS - skip)) - 1)
        quotient = inner >> rest
        occupied = np.zeros(1 << bits, dtype=bool)
        occupied[quotient] = True
        run_end = np.append(quotient[1:] != quotient[:-1], True)[: len(prints)]
        width = -(-int(rest) // 8)
        remainders = (inner & np.uint64((1 << int(rest)) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)
        many = counts > 1
        return cls(
            skip,
            bits,
            len(prints),
            np.packbits(occupied).tobytes(),
            np.packbits(run_end).tobytes(),
            remainders[:, :width].tobytes(),
            np.packbits(many).tobytes(),
            counts[many].astype("<i8").tobytes(),
        )

    def entries(self, prefix: int) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints, sorted, and their counts; `prefix` is the slice's upper bits."""
        unpack = lambda packed, n: np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
        quotients = np.flatnonzero(unpack(self.occupied, 1 << self.bits)).astype(np.uint64)
        run_end = unpack(self.run_end, self.slots)
        quotient = quotients[np.cumsum(run_end) - run_end]
        rest = BITS - self.skip - self.bits
        width = -(-rest // 8)
        remainders = np.zeros((self.slots, 8), dtype=np.uint8)
        remainders[:, :width] = np.frombuffer(self.remainders, np.uint8).reshape(self.slots, width)
        prints = (quotient << np.uint64(rest)) | remainders.view("<u8").ravel()
        if self.skip:
            prints |= np.uint64(prefix << (BITS - self.skip))
        counts = np.ones(self.slots, dtype=np.int64)
        counts[unpack(self.counted, self.slots)] = np.frombuffer(self.counts, "<i8")
        return prints, counts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The entries of several filters of a slice as one, counts added."""
    prints = np.concatenate([p for p, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    new = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])[: len(prints)])
    return prints[new], np.add.reduceat(counts, new) if len(new) else counts


_FILTER = "slice long, bits int, slots long, occupied binary, run_end binary, remainders binary, counted binary, counts binary"
_FILTER_ARROW = pa.schema(
    [("slice", pa.int64()), ("bits", pa.int32()), ("slots", pa.int64())]
    + [(name, pa.binary()) for name in ("occupied", "run_end", "remainders", "counted", "counts")]
)


def _filters(slice_bits: int):
    """Filters of each task's fingerprints, a row per slice."""

    def cut(prints: np.ndarray) -> pa.RecordBatch:
        prints, counts = np.unique(prints, return_counts=True)
        of = prints >> np.uint64(BITS - slice_bits)
        edges = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        rows = []
        for begin, end in zip(edges, [*edges[1:], len(prints)]):
            f = QuotientFilter.build(prints[begin:end], counts[begin:end], slice_bits)
            rows.append(
                (int(of[begin]), f.bits, f.slots, f.occupied, f.run_end, f.remainders, f.counted, f.counts)
            )
        return pa.RecordBatch.from_arrays(
            [pa.array(values, field.type) for values, field in zip(zip(*rows), _FILTER_ARROW)], schema=_FILTER_ARROW
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
            if n >= FILTER_ROWS:
                yield cut(np.concatenate(waiting))
                waiting, n = [], 0
        if n:
            yield cut(np.concatenate(waiting))

    return build


def _merge(slice_bits: int):
    """The fingerprints of a slice that count above one."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [
            QuotientFilter(slice_bits, *values).entries(key[0])
            for values in zip(*(rows[name] for name in _FILTER_ARROW.names[1:]))
        ]
        prints, counts = merged(parts)
        many = counts > 1
        return pd.DataFrame({"print": prints[many].view(np.int64), "n": counts[many]})

    return merge


def repeated_prints(prints: DataFrame, n_rows: int) -> DataFrame:
    """`print, n` of the fingerprints that occur several times in the one column of `prints`."""
    slice_bits = max(LEAST_SLICE_BITS, (n_rows // SLICE_ROWS).bit_length())
    filters = prints.mapInArrow(_filters(slice_bits), _FILTER)
    return filters.groupBy("slice").applyInPandas(_merge(slice_bits), "print long, n long")


def fingerprint(text):
    """64 bits that equal texts share."""
    return F.xxhash64(text)


def _marked(print_, repeated: DataFrame, n_repeated: int):
    """False for fingerprints whose quotient no repeated fingerprint has."""
    marks = LEAST_MARKS
    while marks < min(MOST_MARKS, MARKS_EACH * n_repeated):
        marks *= 2
    quotient = lambda p: F.shiftrightunsigned(p, BITS - marks.bit_length() + 1)
    words = repeated.select(quotient(F.col("print")).alias("at")).groupBy(F.shiftright("at", 6).alias("id"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("word"))
    everything = repeated.sparkSession.range(marks // 64).join(F.broadcast(words), "id", "left")
    pair = F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    # At most MOST_MARKS bits.
    bitmap = everything.agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["word"])).scalar()
    at = quotient(print_)
    return F.bit_get(F.get(bitmap, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1


def find_copies(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """`doc_id, keep_id, group_size, kept, text_sha256` of every row of `docs`.

    Rows whose texts are equal byte for byte are a group; NULL counts as empty, and all
    empty texts are a group. The row with the largest id of a group stays, and `keep_id` is its
    id. A NULL id is smaller than any other. Of rows that repeat the largest id one stays. Other
    columns are not looked at; an empty table has an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("print", fingerprint(F.col("text")))
    narrow = stage(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "print",
            F.unhex(F.sha2("text", 256)).alias("digest"),
        ),
        "fingerprints",
    )
    n_rows = narrow.count()
    repeated = stage(repeated_prints(narrow.select("print"), n_rows), "repeated")
    routed = _marked(F.col("print"), repeated, repeated.count())

    # The bytes of each routed text are the key: equal texts of a task are added up before.
    same = rows.filter(routed).groupBy("print", "text").agg(F.count("*").alias("group_size"))
    same = same.filter(F.col("group_size") > 1)
    verified = same.select(F.unhex(F.sha2("text", 256)).alias("digest"), "group_size")
    # Rows of a struct are compared field by field, a NULL id below others.
    last = F.max(F.struct("doc_id", F.negate("row").alias("row"))).alias("last")
    candidates = narrow.filter(routed)
    groups = candidates.groupBy("digest").agg(last).join(verified, "digest")
    groups = stage(
        groups.select(
            F.col("digest").alias("of"),
            F.col("last.doc_id").alias("keep_id"),
            F.negate("last.row").alias("keep_row"),
            "group_size",
        ),
        "groups",
    )

    def result(found, keep_id, kept, group_size):
        return found.select(
            "doc_id",
            keep_id.alias("keep_id"),
            group_size.cast("long").alias("group_size"),
            kept.alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    in_group = F.col("of").isNotNull()
    joined = lambda found: result(
        found,
        F.when(in_group, F.col("keep_id")).otherwise(F.col("doc_id")),
        ~in_group | (F.col("row") == F.col("keep_row")),
        F.coalesce("group_size", F.lit(1)),
    )
    key = F.col("digest") == F.col("of")
    hot = groups.filter(F.col("group_size") * HOT_SHARE > n_rows)
    alone = result(narrow.filter(~routed), F.col("doc_id"), F.lit(True), F.lit(1))
    # Fewer than HOT_SHARE groups, so their rows stay where they are.
    of_hot = joined(candidates.join(F.broadcast(hot), key))
    others = candidates.join(F.broadcast(hot), key, "left_anti")
    return alone.unionByName(of_hot).unionByName(joined(others.join(groups.filter(F.col("group_size") * HOT_SHARE <= n_rows), key, "left")))
