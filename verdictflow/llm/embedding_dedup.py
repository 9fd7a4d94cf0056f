"""Near-duplicate vectors by binary codes under random rotations.

A vector, scaled to length 1, is turned by seeded random rotations; the signs are its code.
With the code a correction factor is stored, the inner product of the turned vector and its
code. Code and factor give an unbiased estimate of the inner product with any other vector,
and a bound on the estimate's error. Pairs whose upper bound is below the threshold are
dropped; the others are computed again in double precision.

Bits of further rotations make bucket keys: similar vectors agree in one whole group of bits
with a probability near 1, so that not all pairs have to be looked at. Equal vectors are one
thing with copies.
"""

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from verdictflow.llm import near
from verdictflow.session import stage

THRESHOLD = 0.93
#: Buckets: a pair at the threshold agrees in one sign with a probability of 0.88, in a whole
#: band with 0.13, and in none of the bands with 2e-6.
BANDS, BAND_BITS = 96, 16
#: Signs of the estimate, and how many standard errors its bound is wide.
ESTIMATE_SIGNS = 256
ERRORS = 5.0
SEED = 23


@cache
def rotations(dim: int, signs: int, seed: int) -> np.ndarray:
    """Columns of random rotations side by side, at least `signs` of them."""
    rng = np.random.default_rng([seed, dim])
    turned = []
    while sum(t.shape[1] for t in turned) < signs:
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        turned.append(q * np.sign(np.diag(r)))
    return np.concatenate(turned, axis=1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)  # keeps squares in range
    scaled = vectors / largest
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes (bytes) and correction factors of vectors of one dimension."""
    turn = rotations(vectors.shape[1], ESTIMATE_SIGNS, SEED)
    turned = _unit(vectors) @ turn
    dim, count = turn.shape
    factor = np.abs(turned).sum(axis=1) * np.sqrt(dim) / count
    return np.packbits(turned > 0, axis=1), factor


def bands_of(vectors: np.ndarray) -> np.ndarray:
    """The band values (vector, band) that make bucket keys."""
    count = BANDS * BAND_BITS
    turned = _unit(vectors) @ rotations(vectors.shape[1], count, SEED + 1)[:, :count]
    packed = np.packbits(turned > 0, axis=1).reshape(len(vectors), BANDS, BAND_BITS // 8)
    value = np.zeros(packed.shape[:2], dtype=np.int64)
    for k in range(packed.shape[2]):
        value = value * 256 + packed[:, :, k]
    return value


def upper_bounds(codes, factors, queries, dim) -> np.ndarray:
    """Upper bounds (coded vector, query) of inner products of unit vectors.

    The code of a vector, divided by its factor, estimates it without bias in each
    direction. What the code adds across the vector is spread evenly over the other
    directions, which gives the standard error.
    """
    turn = rotations(dim, ESTIMATE_SIGNS, SEED)
    count = turn.shape[1]
    signs = np.unpackbits(codes, axis=1, count=count).astype(np.float32) * 2 - 1
    along = np.sqrt(dim) / count / factors[:, None]
    estimate = (signs @ (queries @ turn).T.astype(np.float32)) * along
    error = np.sqrt(np.maximum(1 - factors**2, 0)) / factors / np.sqrt(max(1, dim - 1))
    error /= np.sqrt(count / dim)
    return estimate + ERRORS * error[:, None]


def _things(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for dim, rows in batch.groupby(batch["vector"].map(len)):
            vectors = np.stack(rows["vector"].to_numpy()).astype(np.float64)
            codes, factors = encode(vectors)
            keys = bands_of(vectors)
            sketch = [
                np.int32(dim).tobytes() + np.float64(f).tobytes() + c.tobytes() + v.tobytes()
                for c, f, v in zip(codes, factors, vectors)
            ]
            out.append(
                pd.DataFrame({"gid": rows["gid"], "values": list(keys), "sketch": sketch})
            )
        if out:
            yield pd.concat(out)


def _read(sketches):
    """Codes, factors and unit vectors of the sketches of one dimension."""
    dim = int(np.frombuffer(sketches[0][:4], dtype=np.int32)[0])
    flat = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), -1)
    factors = flat[:, 4:12].copy().view(np.float64)[:, 0]
    vectors = flat[:, -8 * dim :].copy().view(np.float64)
    return flat[:, 12 : -8 * dim], factors, _unit(vectors), dim


def _passing(threshold):
    def start():
        def group(sketches):
            codes, factors, units, dim = _read(sketches)

            def look(i, others):
                bound = upper_bounds(codes[others], factors[others], units[i : i + 1], dim)
                return bound[:, 0] >= threshold

            return look

        return group

    return start


_TILE = 512


def _linked(threshold):
    def start():
        def group(rows, own, cross):
            codes, factors, units, dim = _read(rows["sketch"].to_numpy())
            if cross:
                sides = [np.flatnonzero(own == s) for s in np.unique(own)]
                if len(sides) < 2:
                    return
                left, right = sides
            else:
                left = right = np.arange(len(own))
            for x in range(0, len(left), _TILE):
                for y in range(0 if cross else x, len(right), _TILE):
                    a, b = left[x : x + _TILE], right[y : y + _TILE]
                    bound = upper_bounds(codes[a], factors[a], units[b], dim)
                    i, j = np.nonzero(bound >= threshold)
                    i, j = a[i], b[j]
                    if not cross:
                        i, j = i[i < j], j[i < j]
                    exact = np.einsum("ij,ij->i", units[i], units[j]) >= threshold
                    if exact.any():
                        yield i[exact], j[exact]

        return group

    return start


def near_duplicates(
    vectors: DataFrame, vector="embedding", vec_id="vec_id", label="label", threshold=THRESHOLD
) -> DataFrame:
    """`vec_id, n_links, component_id, kept` of every row of `vectors`.

    Rows of one label, not NULL, are linked if the cosine of their vectors is at least
    `threshold`. `n_links` counts the other rows that a row is linked to, equal vectors
    included; `component_id` is the smallest id that is reachable by links, itself included.
    A vector that is NULL, empty, zero or has NULL or non-finite parts has no links, nor have
    vectors of different lengths with each other. Repeated rows are rows of their own. A
    NULL id counts as a row and is no component's id unless there is no other; such a row
    is kept if it is alone.
    """
    value = F.col(vector).cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(
        finite & F.exists(value, lambda x: x != 0) & F.col(label).isNotNull(), F.lit(False)
    )
    plain = F.transform(value, lambda x: x + F.lit(0.0))  # no negative zero
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"),
        F.when(usable, F.xxhash64(F.col(label), F.size(vector), plain)).alias("gid"),
        F.when(usable, plain).alias("vector"),
        F.when(usable, F.col(label)).alias("label"),
    )
    rows = stage(rows, "vectors")
    usable_rows = rows.filter(F.col("gid").isNotNull())
    copies = usable_rows.groupBy("gid").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("first")
    )
    distinct = usable_rows.select("gid", "label", "vector").dropDuplicates(["gid"])
    coded = distinct.select("gid", "vector").mapInPandas(
        _things, "gid long, values array<long>, sketch binary"
    )
    # A bucket is a label, a length, a band and the band's bits.
    coded = coded.join(distinct.select("gid", "label", F.size("vector").alias("dim")), "gid")
    band = F.transform("values", lambda v, k: F.xxhash64(F.col("label"), F.col("dim"), k, v))
    things = stage(coded.select("gid", band.alias("bands"), "sketch"), "codes")
    candidates = near.candidate_groups(things, _passing(threshold))
    groups = things.select("gid", "sketch").join(candidates, "gid").join(copies, "gid")
    groups = groups.select("gid", "root", "copies", "sketch", F.length("sketch").alias("bytes"))
    found = stage(near.links_and_classes(near.dealt_groups(groups), _linked(threshold)), "vector-classes")

    own = copies.join(found, "gid", "left")
    roots = own.filter(F.col("class_root").isNotNull()).groupBy("class_root").agg(
        F.min("first").alias("least")
    )
    own = own.join(roots, "class_root", "left").select(
        F.col("gid").alias("own_gid"),
        F.coalesce("least", "first").alias("least"),
        (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    keyed = rows.select("vec_id", "gid").join(own, F.col("gid") == F.col("own_gid"), "left")
    component = F.coalesce("least", "vec_id")
    return keyed.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
