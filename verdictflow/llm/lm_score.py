"""Language-model scoring with stupid backoff, as count tables joined to the n-grams of texts.

The model is the counts of all word sequences up to an order, over all texts. A word after a context
scores the count of both by that of the context, if they are known together; otherwise the
context is cut by a word, at a penalty, down to the word's count by the number of words. Sequences
seen less often than `min_count` are not known, so that a text does not vouch for itself.
Logarithms are kept as whole millionths, so that sums do not depend on the order of rows.

Texts are tokenised once, into chunks of word numbers. The distinct sequences of a chunk, as sorted
64-bit hashes with their counts in it, are dealt by the upper bits of the hash: each bucket is
a part of the count tables, added up over the chunks. What occurs more than once comes back to the
chunks that hold it, in the order they sent it, so a known sequence costs a bit and its count. The
chunk joins the counts to its words and sums them per document.

A sequence is sent once per chunk however often it occurs there, and a bucket gets at most one
entry per sequence and chunk, so frequent ones weigh no more than others.
"""

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from verdictflow.llm import common
from verdictflow.session import stage

#: The longest sequence, the penalty of cutting a context, and the fewest occurrences of a known one.
ORDER = 3
BACKOFF = 0.4
MIN_COUNT = 2
#: Words of a chunk (one text may be longer), and entries that a bucket should get.
CHUNK_WORDS, BUCKET_ENTRIES = 1_500_000, 1_000_000
#: Buckets are a power of two, this at least.
LEAST_BUCKETS = 64
#: Bytes of text that make a word, to guess the number of entries.
WORD_BYTES = 6
MICRO = 1_000_000


def micro_log(x) -> np.ndarray:
    return np.round(np.log(np.asarray(x, dtype=np.float64)) * MICRO).astype(np.int64)


def _mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _planes(values: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte: the upper bytes, mostly 0, compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


_HEAD = struct.Struct("<BQII")


def _packed(prints: np.ndarray) -> bytes:
    """Sorted numbers as steps, each in as many bytes as the largest needs.

    The upper byte of a step is of few values and is packed by their frequency; the others are
    as good as random.
    """
    steps = np.diff(prints)
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    rest = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    upper = coder.compress(rest[:, -1].tobytes()) + coder.flush()
    return _HEAD.pack(width, int(prints[0]), len(steps), len(upper)) + upper + rest[:, :-1].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width, first, n, packed = _HEAD.unpack_from(data)
    at = _HEAD.size + packed
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, width - 1] = np.frombuffer(zlib.decompress(data[_HEAD.size : at], -15), np.uint8)
    steps[:, : width - 1] = np.frombuffer(data, np.uint8, offset=at).reshape(n, width - 1)
    return np.cumsum(np.append(np.uint64(first), steps.view("<u8").ravel()), dtype=np.uint64)


def _counts(counts: np.ndarray) -> bytes:
    """Counts in a byte each; 255 stands for one that follows behind."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[small == 255].astype("<i8").tobytes()


def _from_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, count=n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=n)
    return counts


def sequences(words: np.ndarray, sizes: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length up to `order` the hash of the sequence that ends at each word; places in the texts.

    `words` are word hashes of texts one after the other, `sizes` their numbers. A hash is only
    of use where the place is not below its length less one.
    """
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(words)) - np.repeat(starts, sizes)
    hashes = [_mix(words)]
    for k in range(2, order + 1):
        before = np.append(np.uint64(0), hashes[-1])[:-1]
        hashes.append(_mix(before * np.uint64(0x9E3779B97F4A7C15) + words + np.uint64(k)))
    return hashes, place


def _chunked(kind: pa.DataType):
    """Rows of a partition as chunks: ids, sizes, word numbers and the hashes of the words."""
    schema = pa.schema(
        [("chunk", pa.int64()), ("check", pa.int64()), ("doc_ids", pa.list_(kind))]
        + [(name, pa.binary()) for name in ("sizes", "words", "hashes")]
    )

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = (TaskContext.get().partitionId() << 32) - 1
        number = defaultdict(count().__next__)
        ids, sizes, words, total = [], [], [], 0

        def row():
            spelled = [
                np.array(sizes, dtype="<i8").tobytes(),
                _planes(np.concatenate(words)),
                np.fromiter(map(xxhash.xxh64_intdigest, number), "<u8", len(number)).tobytes(),
            ]
            check = xxhash.xxh32_intdigest(b"".join(spelled))
            values = [[chunk], [check], [pa.concat_arrays(ids).to_pylist()], *([part] for part in spelled)]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema
            )

        for batch in batches:
            doc_ids = batch.column("doc_id")
            for at, text in enumerate(batch.column("text")):
                found = common.byte_words(text.as_py())
                ids.append(doc_ids.slice(at, 1))
                sizes.append(len(found))
                words.append(np.fromiter(map(number.__getitem__, found), np.uint32, len(found)))
                total += len(found)
                if total >= CHUNK_WORDS:
                    chunk += 1
                    yield row()
                    number = defaultdict(count().__next__)
                    ids, sizes, words, total = [], [], [], 0
        if ids:
            chunk += 1
            yield row()

    return chunked


def _of_chunk(row, order):
    """The hashes of a chunk's sequences, where they are of use, and the places of its words."""
    sizes = np.frombuffer(row["sizes"], "<i8")
    hashes = np.frombuffer(row["hashes"], "<u8")
    words = hashes[_from_planes(row["words"])] if len(hashes) else np.zeros(0, dtype=np.uint64)
    found, place = sequences(words, sizes, order)
    return [(h[place >= k], place >= k) for k, h in enumerate(found)], place, sizes


_MESSAGE = pa.schema(
    [("bucket", pa.int64()), ("chunk", pa.int64()), ("check", pa.int64()), ("prints", pa.binary()), ("counts", pa.binary())]
)


def _messages(order: int, bits: int):
    """The distinct sequences of each chunk with their counts in it, a row per bucket."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                found, _, _ = _of_chunk(row, order)
                prints, counts = np.unique(np.concatenate([h for h, _ in found]), return_counts=True)
                edges = np.searchsorted(prints, _edges(bits))
                edges = np.append(edges, len(prints))
                rows = [
                    (b, row["chunk"], row["check"], _packed(prints[x:y]), _counts(counts[x:y]))
                    for b, (x, y) in enumerate(zip(edges[:-1], edges[1:]))
                    if y > x
                ]
                columns = zip(*rows) if rows else [[]] * len(_MESSAGE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(columns, _MESSAGE)], schema=_MESSAGE
                )

    return deal


def _edges(bits: int) -> np.ndarray:
    return np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)


_REPLY = pa.schema(
    [("chunk", pa.int64()), ("check", pa.int64()), ("bucket", pa.int64()), ("known", pa.binary()), ("counts", pa.binary())]
)


def _added_up(table: pa.Table) -> pa.Table:
    """The counts of a bucket over all chunks, to each chunk for what it sent: those above one."""
    rows = table.to_pylist()
    parts = [_unpacked(row["prints"]) for row in rows]
    sizes = [len(p) for p in parts]
    counts = np.concatenate([_from_counts(row["counts"], n) for row, n in zip(rows, sizes)])
    prints = np.concatenate(parts)
    order = np.argsort(prints, kind="stable")
    ordered = prints[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    total = np.empty(len(prints), dtype=np.int64)
    total[order] = np.add.reduceat(counts[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    replies = []
    for row, part in zip(rows, np.split(total, np.cumsum(sizes)[:-1])):
        known = part > 1
        counts = _counts(part[known])
        replies.append((row["chunk"], row["check"], row["bucket"], np.packbits(known).tobytes(), counts))
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*replies), _REPLY)], schema=_REPLY)


def _totals(prints: np.ndarray, replies: pa.Table, bits: int) -> np.ndarray:
    """The counts over all chunks of a chunk's sorted distinct sequences."""
    total = np.ones(len(prints), dtype=np.int64)
    edges = np.append(np.searchsorted(prints, _edges(bits)), len(prints))
    for reply in replies.to_pylist():
        begin, end = edges[reply["bucket"]], edges[reply["bucket"] + 1]
        known = np.unpackbits(np.frombuffer(reply["known"], np.uint8), count=end - begin).astype(bool)
        total[begin:end][known] = _from_counts(reply["counts"], int(known.sum()))
    return total


def _scored(order: int, bits: int, backoff: float, min_count: int, kind: pa.DataType):
    """Scores of the documents of a chunk, from its words and the counts that came back.

    The number of all words is not known yet: `by_count` words still lack it.
    """
    penalty = int(micro_log(backoff))

    def score(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        (row,) = chunk.to_pylist()
        if set(replies["check"].to_pylist()) - {row["check"]}:
            # Its rows came in another order when a lost task ran again.
            raise RuntimeError("a chunk changed while its counts were added up: give a stored table")
        found, place, sizes = _of_chunk(row, order)
        prints, back = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
        total = _totals(prints, replies, bits)
        # For each length the counts of the sequences that end at each word, 0 where there is none.
        counts, at = [], 0
        for hashes, of_use in found:
            own = np.zeros(len(place), dtype=np.int64)
            own[of_use] = total[back[at : at + len(hashes)]]
            counts.append(own)
            at += len(hashes)
        longest = np.minimum(place + 1, order)
        micro = micro_log(np.maximum(counts[0], 1)) + penalty * (longest - 1)
        by_count = np.ones(len(place), dtype=np.int64)
        for k in range(2, order + 1):
            known = np.flatnonzero((counts[k - 1] >= min_count) & (place >= k - 1))
            value = micro_log(counts[k - 1][known]) - micro_log(counts[k - 2][known - 1])
            micro[known] = value + penalty * (longest[known] - k)
            by_count[known] = 0
        ends = np.cumsum(sizes)

        def per_text(values):
            sums = np.append(0, np.cumsum(values))
            return pa.array(sums[ends] - sums[ends - sizes], pa.int64())

        return pa.table(
            [pa.array(row["doc_ids"], kind), pa.array(sizes, pa.int64()), per_text(micro), per_text(by_count)],
            ["doc_id", "n_words", "micro", "by_count"],
        )

    return score


def bucket_bits(entries: int) -> int:
    """The number of upper bits of a hash that name its bucket, for so many entries in all."""
    return max(LEAST_BUCKETS, -(-entries // BUCKET_ENTRIES) - 1).bit_length()


def score_texts(
    docs: DataFrame, text="text", doc_id="doc_id", order=ORDER, backoff=BACKOFF, min_count=MIN_COUNT
) -> DataFrame:
    """`doc_id, n_words, micro_score, score` of each row of `docs`.

    `order` is the length of the longest sequence, 1 at least. `micro_score` is the sum of the words'
    log scores in millionths, `score` its mean per word in units. A NULL text, and one without
    words, has no words, a sum of 0 and a NULL mean. Repeated rows count as texts and have
    equal scores; ids may repeat or be NULL. Words and sequences are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind, arrow_kind = dict(rows.dtypes)["doc_id"], to_arrow_type(rows.schema["doc_id"].dataType)
    (size,) = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bits = bucket_bits(size // WORD_BYTES * order)
    # Dealt once: the messages and the scores read the same shuffle, so both take all columns.
    chunks = rows.mapInArrow(
        _chunked(arrow_kind),
        f"chunk long, check long, doc_ids array<{kind}>, sizes binary, words binary, hashes binary",
    ).repartition("chunk")
    messages = chunks.mapInArrow(
        _messages(order, bits), "bucket long, chunk long, check long, prints binary, counts binary"
    )
    replies = messages.groupBy("bucket").applyInArrow(
        _added_up, "chunk long, check long, bucket long, known binary, counts binary"
    )
    score = _scored(order, bits, backoff, min_count, arrow_kind)
    scored = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        score, f"doc_id {kind}, n_words long, micro long, by_count long"
    )
    scored = stage(scored, "scores")
    (all_words,) = scored.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()
    micro = F.col("micro") - F.col("by_count") * int(micro_log(max(1, all_words)))
    return scored.select(
        "doc_id",
        "n_words",
        micro.alias("micro_score"),
        F.when(F.col("n_words") > 0, micro / F.col("n_words") / MICRO).alias("score"),
    )
