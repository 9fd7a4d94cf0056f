"""N-gram Jaccard self-join with Bayesian pruning of candidates.

A text stands for its set of runs of five words. MinHash values put texts into buckets;
within a bucket the values of two texts are compared a few at a time, and the pair is
dropped as soon as the posterior probability that its similarity reaches the threshold is
below the tolerance. Pairs that are left are verified exactly, on whole sets.

Texts that are equal are one thing with copies, so copies never make pairs.
"""

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from verdictflow.llm import common, near
from verdictflow.session import stage

RUN_WORDS = 5
THRESHOLD = 0.8
#: Buckets: a pair at the threshold shares none with a probability of 5e-7.
BANDS, BAND_VALUES = 48, 6
#: Values compared one by one, of which 8 bits are kept, so many at a time.
COMPARED, STEP = 128, 16
TOLERANCE = 1e-6
SEED = 17

_rng = np.random.default_rng(SEED)
_HASHES = BANDS * BAND_VALUES
_MULTIPLY = _rng.integers(1, 1 << 63, (_HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, (_HASHES, 1), dtype=np.uint64)
_WORD_CACHE = 100_000
_CHUNK = 1_024
#: Characters of the texts that are Python strings at a time, or one text.
_PIECE_CHARS = 1_000_000
_NO_KEYS = np.zeros(0, dtype=np.int64)


def _mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def run_set(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """The hashes of a text's runs of words, sorted and each once.

    A text of fewer words is one run; one without words has none. `known` keeps word hashes.
    """
    words = common.byte_words(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(RUN_WORDS, len(h))
    runs = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for k in range(size):
        runs = _mix(runs * np.uint64(31) + h[k : len(h) - size + 1 + k])
    if len(known) > _WORD_CACHE:
        known.clear()
    return np.unique(runs)


def min_hashes(runs: np.ndarray) -> np.ndarray:
    least = np.full(_HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(runs), _CHUNK):  # bounded memory for long texts
        values = runs[at : at + _CHUNK] * _MULTIPLY + _ADD
        np.minimum(least, values.min(axis=1), out=least)
    return _mix(least)


def _signed(runs: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The bucket keys and the sketch of a set of runs."""
    values = min_hashes(runs).reshape(BANDS, BAND_VALUES)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_VALUES):
        keys = _mix(keys * np.uint64(31) + values[:, k])
    return keys.view(np.int64), values.ravel()[:COMPARED].astype(np.uint8).tobytes()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    done: dict[int, tuple] = {}
    for batch in batches:
        # Of a batch only the texts of a piece are Python strings at a time.
        for begin, end in common.ranges(pc.utf8_length(batch["text"]).to_pylist(), _PIECE_CHARS):
            part = batch.slice(begin, end - begin)
            rows = []
            for gid, text in zip(part["gid"].to_pylist(), part["text"].to_pylist()):
                if gid not in done:
                    runs = run_set(text, known)
                    done[gid] = (*_signed(runs), len(runs)) if len(runs) else (_NO_KEYS, b"", 0)
                rows.append(done[gid])
                if len(done) > 2_000:
                    done.clear()
            keys, sketches, runs = zip(*rows)
            offsets = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
            own = [part["doc_id"], part["gid"], part["bytes"], bands]
            columns = [*own, pa.array(sketches, pa.binary()), pa.array(runs, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "gid", "bytes", "bands", "sketch", "n_runs"])


@cache
def least_matches(threshold=THRESHOLD, tolerance=TOLERANCE) -> np.ndarray:
    """For each number of values compared, the fewest matches with which a pair goes on.

    Before any value the share of matches is taken as uniform. Two different values share
    their 8 bits in one of 256 cases, which raises the threshold a little.
    """
    grid = np.linspace(0, 1, 20_001)[1:-1]
    line = threshold + (1 - threshold) / 256
    fewest = []
    for n in range(STEP, COMPARED + 1, STEP):
        m = np.arange(n + 1)[:, None]
        density = m * np.log(grid) + (n - m) * np.log(1 - grid)
        density = np.exp(density - density.max(axis=1, keepdims=True))
        reached = density[:, grid >= line].sum(axis=1) / density.sum(axis=1)
        fewest.append(int(np.argmax(reached >= tolerance)))
    return np.array(fewest)


def may_reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of sketches (rows of a and b) are not dropped, comparing step by step."""
    fewest = least_matches()
    alive = np.arange(max(len(a), len(b)))
    matches = np.zeros(len(alive), dtype=np.int64)
    for k, at in enumerate(range(0, COMPARED, STEP)):
        left = a[alive, at : at + STEP] if len(a) > 1 else a[:, at : at + STEP]
        matches = matches + (left == b[alive, at : at + STEP]).sum(axis=1)
        going = matches >= fewest[k]
        alive, matches = alive[going], matches[going]
        if not len(alive):
            break
    return alive


def _sketch_rows(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), COMPARED)


def _passing():
    def group(sketches):
        rows = _sketch_rows(sketches)
        return lambda i, others: may_reach(rows[i : i + 1], rows[others])

    return group


#: Rows of a tile of pairs, and runs counted at once in it.
_TILE, _COLUMNS = 256, 4_096


def _pairs_of_tile(rows, a, b):
    """The pairs (one row of each tile) that Bayesian pruning leaves."""
    i, j = np.repeat(a, len(b)), np.tile(b, len(a))
    order = i != j
    if len(a) == len(b) and (a == b).all():
        order = i < j
    i, j = i[order], j[order]
    if not len(i):
        return i, j
    left = may_reach(rows[i], rows[j]) if len(i) > 1 else may_reach(rows[i[:1]], rows[j])
    return i[left], j[left]


def _shared_runs(sets, i, j):
    """The number of runs that the sets of each pair share."""
    own = np.unique(np.concatenate([i, j]))
    if len(i) <= 4 * len(own):
        return np.array([np.intersect1d(sets[a], sets[b], assume_unique=True).size for a, b in zip(i, j)])
    # Many pairs of few sets: count with products of incidence matrices, some runs at a time.
    place = {int(r): k for k, r in enumerate(own)}
    runs = np.concatenate([sets[r] for r in own])
    row = np.repeat(np.arange(len(own)), [len(sets[r]) for r in own])
    values, column, times = np.unique(runs, return_inverse=True, return_counts=True)
    common_runs = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[common_runs], number[column[common_runs]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(own), len(own)), dtype=np.float32)
    columns = int(number[-1]) + 1 if len(number) else 0
    for at in range(0, columns, _COLUMNS):
        a, b = np.searchsorted(column, [at, at + _COLUMNS])
        part = np.zeros((len(own), min(_COLUMNS, columns - at)), dtype=np.float32)
        part[row[a:b], column[a:b] - at] = 1
        total += part @ part.T
    pi = np.array([place[int(r)] for r in i])
    pj = np.array([place[int(r)] for r in j])
    return total[pi, pj].astype(np.int64)


def _linked(threshold):
    def start():
        known: dict[bytes, int] = {}

        def group(rows, own, cross):
            sets = [run_set(t, known) for t in rows["text"]]
            size = np.array([len(s) for s in sets])
            sketches = _sketch_rows(rows["sketch"].to_numpy())
            sides = [np.flatnonzero(own == s) for s in np.unique(own)]
            left, right = (sides[0], sides[-1]) if cross and len(sides) > 1 else (np.arange(len(own)),) * 2
            if cross and len(sides) < 2:
                return
            for x in range(0, len(left), _TILE):
                for y in range(0 if cross else x, len(right), _TILE):
                    i, j = _pairs_of_tile(sketches, left[x : x + _TILE], right[y : y + _TILE])
                    near_size = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
                    i, j = i[near_size], j[near_size]
                    if not len(i):
                        continue
                    shared = _shared_runs(sets, i, j)
                    # In whole numbers where the threshold allows, without rounding errors.
                    enough = shared >= threshold * (size[i] + size[j] - shared) - 1e-9
                    if enough.any():
                        yield i[enough], j[enough]

        return group

    return start


#: Bits of the bitmap of candidates, 512 kB in all. When it fills up it lets more texts pass.
_BITMAP_BITS = 1 << 22


def _may_be_in(key: list[str], candidates: DataFrame):
    """False for rows whose `key` columns are surely not among those of the candidates."""
    place = F.pmod(F.xxhash64(*key), F.lit(_BITMAP_BITS))
    bits = candidates.select(place.alias("place")).groupBy(
        F.shiftright("place", 6).alias("id")
    )
    bits = bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    words = candidates.sparkSession.range(_BITMAP_BITS // 64).join(bits, "id", "left")
    pair = F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    bitmap = words.agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["bits"])).scalar()
    word = F.get(bitmap, F.shiftright(place, 6).cast("int"))
    return F.bit_get(word, (place % 64).cast("int")) == 1


def text_gid(text):
    """The id of a text: equal texts share it; NULL for NULL."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def join_similar(docs: DataFrame, text="text", doc_id="doc_id", threshold=THRESHOLD) -> DataFrame:
    """`doc_id, gid, class_root, class_id, n_links` of every row of `docs`.

    Two rows are linked if the Jaccard similarity of their sets of word runs is at least
    `threshold`; a text of fewer than five words is one run. `n_links` counts the other rows
    that a row is linked to, copies included. `class_id` is the smallest `doc_id` that is
    reachable by links, itself included. `gid` tells texts apart and `class_root` classes, by 64-bit
    hashes of whole texts. A row whose text is NULL or has no words has no links, and its class
    is its own id; its `gid` and `class_root` may be NULL. Repeated rows
    are rows of their own; a NULL id counts as a row and is no class id unless there is no
    other.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), text_gid(F.col(text)).alias("gid"), F.col(text).alias("text")
    )
    kind = dict(rows.dtypes)["doc_id"]
    signed = stage(
        rows.filter(F.col("gid").isNotNull())
        .withColumn("bytes", F.octet_length("text").cast("long"))
        .mapInArrow(
            _signatures,
            f"doc_id {kind}, gid long, bytes long, bands array<long>, sketch binary, n_runs int",
        ),
        "signatures",
    ).filter(F.col("n_runs") > 0)
    copies = signed.groupBy("gid").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.max("bytes").alias("bytes")
    )
    copies = stage(copies, "text-copies")
    things = signed.select("gid", "bands", "sketch").dropDuplicates(["gid"])
    candidates = stage(near.candidate_groups(things, _passing), "candidates")

    # What is known of a candidate without its text: `first` picks the row that brings it.
    chosen = candidates.join(copies, "gid").join(things.select("gid", "sketch"), "gid")
    chosen = stage(near.dealt_groups(chosen), "chosen")

    # Of copies only the first row's text is sent. Rows that are surely none of these are
    # left out before the shuffle, by a bitmap of fixed size.
    named = rows.withColumnRenamed("doc_id", "first").filter(F.col("gid").isNotNull())
    likely = named.filter(_may_be_in(["gid", "first"], chosen))
    texts = likely.groupBy("gid").agg(F.first("text").alias("text"))
    groups = chosen.drop("first").join(texts, "gid")
    found = stage(near.links_and_classes(groups, _linked(threshold)), "classes")

    own = copies.join(found, "gid", "left")
    roots = own.filter(F.col("class_root").isNotNull()).groupBy("class_root").agg(
        F.min("first").alias("least")
    )
    own = own.join(roots, "class_root", "left").select(
        F.col("gid").alias("own_gid"),
        F.coalesce("class_root", "gid").alias("class_root"),
        F.coalesce("least", "first").alias("least"),
        (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    keyed = rows.select("doc_id", "gid").join(own, F.col("gid") == F.col("own_gid"), "left")
    return keyed.select(
        "doc_id",
        "gid",
        "class_root",
        F.coalesce("least", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one_of_each(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """One row of each class, the one with the smallest id; columns and other rows stay.

    Of several texts with this id one stays, told by its hash. Rows equal in id and text are one: of
    these any one stays. Rows whose text is NULL or has no words are in no class and stay.
    """
    joined = join_similar(docs, text, doc_id)
    key = lambda name: F.col(name).eqNullSafe
    first = joined.filter(key("doc_id")(F.col("class_id"))).groupBy("doc_id", "gid", "class_root").agg(
        F.count("*").alias("n")
    )
    first = stage(first, "firsts")
    # Few texts of a class have its smallest id.
    others = first.filter(F.col("class_root").isNull()).drop("class_root")
    least = F.min(F.struct("gid", "doc_id", "n")).alias("least")
    kept = first.filter(F.col("class_root").isNotNull()).groupBy("class_root").agg(least).select("least.*")
    kept = others.unionByName(kept)
    # A NULL id is never a class id next to others; rows with several of one key are rare.
    kept = stage(kept.toDF("kept_id", "kept_gid", "kept_n"), "kept")
    same = docs[doc_id].eqNullSafe(F.col("kept_id")) & text_gid(docs[text]).eqNullSafe(F.col("kept_gid"))
    once = docs.join(kept.filter("kept_n = 1"), same, "left_semi")
    if kept.filter("kept_n > 1").isEmpty():  # else the texts would be shuffled for nothing
        return once
    repeated = docs.join(kept.filter("kept_n > 1"), same, "left_semi")
    return once.unionByName(repeated.dropDuplicates([doc_id, text]))
