"""Integer k-means in which n-simplex projections filter the centroids of a vector.

A few of the first centroids serve as pivots. The distances of a vector to them fix a point
over the simplex of the pivots: its coordinates in their span, and its height over it.
For two such points the distance of the vectors lies between that of the points and that of
one point and the other's mirror image below the span. The points are computed once and kept;
in each round a centroid is compared exactly, in whole numbers, only if its lower bound does not
exceed the least upper bound.

A round reads the kept table once and shuffles one row of sums per task and cluster.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from verdictflow.session import stage

DIM, SCALE = 64, 256
CLUSTERS, ROUNDS, PIVOTS = 40, 5, 12
SEED = 2
#: Components beyond this have distances that a long does not hold.
LARGEST = 1 << 27
#: Vectors compared at once.
ROWS = 4_096


def whole(vector: Column, scale=SCALE) -> Column:
    """The components times `scale`, rounded down to whole numbers."""
    def component(x):
        x = x.cast("double") * scale
        return F.when(F.abs(x) < LARGEST, F.floor(x)).otherwise(
            F.raise_error(F.lit("a component is too large for whole-number distances"))
        )

    return F.transform(vector, component)


def usable(vector: Column, dim=DIM) -> Column:
    """Whether a vector has `dim` components, none NULL, NaN or infinite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine, F.lit(False))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of `a` (one axis) and `b` (the other)."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


class Simplex:
    """The simplex over pivots: rows of whole numbers, of which those in the span of others go."""

    def __init__(self, vectors: np.ndarray, pivots=PIVOTS):
        chosen = [vectors[0]] if len(vectors) else []
        points = [[]]
        while chosen and len(chosen) < min(pivots, len(vectors)):
            self._set(chosen, points)
            height = self.points(vectors)[:, -1]
            far = int(np.argmax(height))
            if height[far] < 1e-3:
                break
            chosen.append(vectors[far])
            points.append(self.points(vectors[far : far + 1])[0].tolist())
        self._set(chosen, points)

    def _set(self, chosen, points):
        self.pivots = np.array(chosen, dtype=np.int64)
        size = len(chosen)
        self.base = np.array([row + [0.0] * (size - len(row)) for row in points])[:, : max(0, size - 1)]

    def points(self, vectors: np.ndarray) -> np.ndarray:
        """The apex over each vector, from its distances to the pivots: coordinates, then height."""
        squared = squares(vectors, self.pivots).astype(np.float64)
        place = np.zeros((len(vectors), len(self.pivots)))
        for k in range(1, len(self.pivots)):
            own = self.base[k]
            product = (squared[:, 0] - squared[:, k] + own @ own) / 2
            place[:, k - 1] = (product - place[:, : k - 1] @ own[: k - 1]) / own[k - 1]
        inside = (place[:, :-1] ** 2).sum(axis=1)
        place[:, -1] = np.sqrt(np.maximum(squared[:, 0] - inside, 0))
        return place


class Nearest:
    """The nearest of some centroids, with the bounds of the simplex."""

    def __init__(self, simplex: Simplex, centroids: np.ndarray):
        self.centroids = centroids
        self.apex = simplex.points(centroids)

    def __call__(self, vectors: np.ndarray, apex: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid; of equal ones the smallest number."""
        numbers, distances = [], []
        for at in range(0, len(vectors), ROWS):
            rows, over = vectors[at : at + ROWS], apex[at : at + ROWS]
            flat, height = over[:, :-1], over[:, -1:]
            inside = (flat**2).sum(axis=1)[:, None] + (self.apex[:, :-1] ** 2).sum(axis=1)
            inside = np.maximum(inside - 2 * flat @ self.apex[:, :-1].T, 0)
            lower = inside + (height - self.apex[:, -1]) ** 2
            upper = inside + (height + self.apex[:, -1]) ** 2
            # Room for the rounding of the bounds, which are sums of numbers of this size.
            room = 1e-6 * (1 + upper.max(axis=1, keepdims=True) + (over**2).sum(axis=1, keepdims=True))
            i, j = np.nonzero(lower <= upper.min(axis=1, keepdims=True) + room)
            exact = np.full(lower.shape, np.iinfo(np.int64).max)
            for k in range(0, len(i), 16 * ROWS):
                a, b = i[k : k + 16 * ROWS], j[k : k + 16 * ROWS]
                exact[a, b] = ((rows[a] - self.centroids[b]) ** 2).sum(axis=1)
            number = exact.argmin(axis=1)
            numbers.append(number)
            distances.append(exact[np.arange(len(rows)), number])
        return np.concatenate(numbers), np.concatenate(distances)


def _matrix(column, width) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(matrix) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(matrix).ravel())
    return pa.ListArray.from_arrays(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32), flat)


def _projected(simplex):
    """The rows with the apex of each vector."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = simplex.pivots.shape[1]
        for batch in batches:
            if batch.num_rows:
                apex = simplex.points(_matrix(batch.column("whole"), dim))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("whole"), _lists(apex)], ["vec_id", "whole", "apex"]
                )

    return project


def _read(batch, dim, pivots):
    return _matrix(batch.column("whole"), dim), _matrix(batch.column("apex"), pivots)


def _summed(nearest, dim, pivots):
    """Per task the number of vectors of each cluster and the sum of them."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.zeros(len(nearest.centroids), dtype=np.int64)
        total = np.zeros(nearest.centroids.shape, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors, apex = _read(batch, dim, pivots)
                cluster, _ = nearest(vectors, apex)
                number += np.bincount(cluster, minlength=len(number))
                np.add.at(total, cluster, vectors)
        some = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(number[some]), _lists(total[some])], ["cluster", "n", "total"]
        )

    return add_up


def _assigned(nearest, dim, pivots):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = nearest(*_read(batch, dim, pivots))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                    ["vec_id", "cluster", "distance"],
                )

    return assign


def first_centroids(rows: DataFrame, clusters=CLUSTERS, seed=SEED) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id; at most `clusters` rows are collected."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.select("whole", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "whole")
    return np.array([r["whole"] for r in chosen.limit(clusters).collect()], dtype=np.int64)


def moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The centroids after a round, from `cluster, n, total` of each task."""
    dim = centroids.shape[1]
    exact = lambda c: F.sum(c.cast("decimal(19,0)"))
    totals = [exact(F.col("total")[k]).alias(f"t{k}") for k in range(dim)]
    after = centroids.copy()
    # One row per cluster.
    for row in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():
        after[row["cluster"]] = [int(row[f"t{k}"]) // row["n"] for k in range(dim)]
    return after


def centroid_text(centroids: np.ndarray) -> list[str]:
    return [",".join(map(str, row)) for row in centroids.tolist()]


def cluster(
    vectors: DataFrame,
    vector="embedding",
    vec_id="vec_id",
    dim=DIM,
    scale=SCALE,
    clusters=CLUSTERS,
    rounds=ROUNDS,
    pivots=PIVOTS,
    seed=SEED,
) -> DataFrame:
    """`vec_id, cluster, distance, cluster_inertia, inertia, centroid` of every usable vector.

    Vectors that are NULL, have not `dim` components, or have a NULL or non-finite one are left
    out. Repeated rows are vectors of their own, also as first centroids (then the one with
    the larger number stays empty); a NULL id has the largest hash. With fewer vectors than
    `clusters` each is a first centroid; an empty table gives an empty result. Components whose
    whole number is beyond 2^27 raise an error, since distances would not fit a long.
    `centroid` is the final centroid's components, comma-separated.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    rows = rows.filter(usable(F.col("vector"), dim)).select("vec_id", whole(F.col("vector"), scale).alias("whole"))
    kind = dict(rows.dtypes)["vec_id"]
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        empty = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid string"
        return vectors.sparkSession.createDataFrame([], empty)
    simplex = Simplex(centroids, pivots)
    width = len(simplex.pivots)
    kept = stage(
        rows.mapInArrow(_projected(simplex), f"vec_id {kind}, whole array<long>, apex array<double>"), "projected"
    )
    for _ in range(rounds):
        found = _summed(Nearest(simplex, centroids), dim, width)
        sums = kept.select("whole", "apex").mapInArrow(found, "cluster long, n long, total array<long>")
        centroids = moved(centroids, sums)
    found = _assigned(Nearest(simplex, centroids), dim, width)
    placed = stage(kept.mapInArrow(found, f"vec_id {kind}, cluster int, distance long"), "assigned")

    spread = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("own"))
    # One row per cluster.
    sums = {row["cluster"]: int(row["own"]) for row in spread.collect()}
    texts = centroid_text(centroids)
    facts = [(k, own, sum(sums.values()), texts[k]) for k, own in sums.items()]
    facts = vectors.sparkSession.createDataFrame(
        facts, "of_cluster int, cluster_inertia long, inertia long, centroid string"
    )
    return placed.join(F.broadcast(facts), F.col("cluster") == F.col("of_cluster")).drop("of_cluster")
