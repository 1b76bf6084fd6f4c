"""k-means over integer vectors, exact, with Shallot search.

Every vector carries its centroid, the runner-up of its last search and two bounded distances: to its centroid from above,
to all others from below.  Centroids move, bounds give way by as much, and a vector whose bounds still part keeps its
centroid unseen.  For the rest the exact distances to the old centroid and the old runner-up come first.  The search then
starts from the closer of the two and walks the other centroids in order of their distance to it.  None outside the ball
of radius (distance of the vector to the start + distance to the second best so far) can come among the best two, so the
walk ends there, and the ball shrinks whenever the second best improves.

Bounds are floating-point numbers with a margin; whatever they do not settle is compared by squared distances in exact
integers, ties going to the smaller number.  A round is one pass over the vectors; per task only sums per centroid leave
it.  The state goes to the shared folder after each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Components beyond this are refused: squared distances of up to 2 ** 13 components then fit a long.
LARGEST = 1 << 24
#: Bounds are widened by this share, far above what rounding can do to them.
MARGIN = 1e-9
_STATE = "id long, vector array<int>, cluster int, second int, above double, below double, distance long, members long, sums array<long>"


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """(id, vector): rows with exactly ``width`` components, none null or non-finite, as floor(scale * x)."""
    vector = F.col(vector_col)
    numbers = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = table.where((F.size(vector) == width) & finite)
    checked = F.when(F.forall(vector, lambda x: F.abs(x.cast("double")) * scale <= LARGEST), numbers.cast("array<int>"))
    refused = F.raise_error(F.lit(f"a component beyond {LARGEST} after scaling")).cast("array<int>")
    return kept.select(F.col(id_col).cast("long").alias("id"), F.coalesce(checked, refused).alias("vector"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the least SHA-256 of ``seed`` and id, in that order; rows without an id come last."""
    key = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "vector").orderBy(F.col("key").asc_nulls_last(), "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], np.int64)


def _squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points - centre
    return np.einsum("ij,ij->i", gap, gap)


class Search:
    """Nearest centroids of a batch, from ``centroids`` and from how far each ``moved`` since the state was written."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray | None) -> None:
        self.centroids, self.moved = centroids, moved
        gaps = np.sqrt(np.array([_squared(centroids, c) for c in centroids], np.float64))
        self.ranked = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = gaps * (1 - MARGIN)
        self.seen = 0

    def _first(self, points: np.ndarray):
        """Nearest and second nearest among all, without any bounds to go by."""
        k = len(self.centroids)
        every = np.empty((k, len(points)), np.int64)
        for c in range(k):
            every[c] = _squared(points, self.centroids[c])
        best = every.argmin(axis=0)
        at = np.arange(len(points))
        near = every[best, at]
        if k == 1:
            return best, best, near, np.full(len(points), np.inf)
        every[best, at] = np.iinfo(np.int64).max
        second = every.argmin(axis=0)
        return best, second, near, np.sqrt(every[second, at].astype(np.float64))

    def _shallot(self, points: np.ndarray, best: np.ndarray, second: np.ndarray):
        """The same from an old centroid and an old runner-up (both valid and different)."""
        near = np.empty(len(points), np.int64)
        far = np.empty(len(points), np.int64)
        for c in range(len(self.centroids)):
            for now, out in ((best, near), (second, far)):
                mine = np.flatnonzero(now == c)
                out[mine] = _squared(points[mine], self.centroids[c])
        swap = (far < near) | (far == near) & (second < best)
        best, second = np.where(swap, second, best), np.where(swap, best, second)
        near, far = np.where(swap, far, near), np.where(swap, near, far)
        start, passed = best.copy(), second.copy()
        reach = np.sqrt(near.astype(np.float64))
        for c in range(len(self.centroids)):
            alive = np.flatnonzero(start == c)
            for other in self.ranked[c]:
                if other == c or not len(alive):
                    continue
                ball = (reach[alive] + np.sqrt(far[alive].astype(np.float64))) * (1 + MARGIN)
                alive = alive[ball >= self.gaps[c, other]]
                look = alive[passed[alive] != other]
                self.seen += len(look)
                found = _squared(points[look], self.centroids[other])
                first = (found < near[look]) | (found == near[look]) & (other < best[look])
                third = ~first & ((found < far[look]) | (found == far[look]) & (other < second[look]))
                to, sub = look[first], look[third]
                second[to], far[to] = best[to], near[to]
                best[to], near[to] = other, found[first]
                second[sub], far[sub] = other, found[third]
        return best, second, near, np.sqrt(far.astype(np.float64))

    def assign(self, points: np.ndarray, state: tuple[np.ndarray, ...] | None):
        """(cluster, second, above, below, distance); ``distance`` is exact, whether the vector was searched or not."""
        if state is None or len(self.centroids) == 1:
            best, second, near, below = self._first(points)
            return best, second, np.sqrt(near.astype(np.float64)) * (1 + MARGIN), below * (1 - MARGIN), near
        best, second, above, below = (x.copy() for x in state)
        moved = self.moved * (1 + MARGIN)
        most = np.array([np.delete(moved, c).max() for c in range(len(moved))])
        above, below = (above + moved[best]) * (1 + MARGIN), below - most[best]
        near = np.empty(len(points), np.int64)
        open_ = above >= below
        for c in range(len(self.centroids)):  # of those that keep their centroid only the distance is new
            mine = np.flatnonzero(~open_ & (best == c))
            near[mine] = _squared(points[mine], self.centroids[c])
        todo = np.flatnonzero(open_)
        best[todo], second[todo], near[todo], low = self._shallot(points[todo], best[todo], second[todo])
        below[todo] = low * (1 - MARGIN)
        return best, second, np.sqrt(near.astype(np.float64)) * (1 + MARGIN), below, near


def _pass(table: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, label: str) -> DataFrame:
    """Assigns every vector and writes the state; rows with ``members`` hold a batch's sums of one centroid."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids, moved)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            points = np.asarray(batch.column(1).flatten()).astype(np.int64).reshape(n, width)
            old = None if moved is None else tuple(np.asarray(batch.column(c)) for c in range(2, 6))
            best, second, above, below, near = search.assign(points, old)
            yield states(batch, n, best, second, above, below, near, points)

    def states(batch, n, best, second, above, below, near, points) -> pa.RecordBatch:
        count = np.bincount(best, minlength=k)
        some = np.flatnonzero(count)
        turn = np.argsort(best, kind="stable")
        sums = np.add.reduceat(points[turn], np.concatenate(([0], np.cumsum(count[some])[:-1])), axis=0)
        m = len(some)
        flat = pa.array(sums.reshape(-1))
        bounds = np.concatenate((np.zeros(n, np.int64), np.arange(m + 1) * width))
        vectors = pa.ListArray.from_arrays(pa.array(np.concatenate((np.arange(n + 1) * width, np.full(m, n * width))), pa.int32()), batch.column(1).flatten())
        columns = [
            pa.concat_arrays([batch.column(0), pa.nulls(m, pa.int64())]),
            vectors,
            pa.array(np.concatenate((best, some)), pa.int32()),
            pa.array(np.concatenate((second, some)), pa.int32()),
            pa.array(np.concatenate((above, np.zeros(m)))),
            pa.array(np.concatenate((below, np.zeros(m)))),
            pa.array(np.concatenate((near, np.add.reduceat(near[turn], np.concatenate(([0], np.cumsum(count[some])[:-1])))))),
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(count[some], pa.int64())]),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[part.split()[0] for part in _STATE.split(", ")])

    return materialise(table.mapInArrow(run, _STATE), label)


def _new_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count); at most one row per centroid and component reaches the driver."""
    sums = state.where("members IS NOT NULL").select("cluster", "members", F.posexplode("sums").alias("at", "x"))
    rows = sums.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("members").alias("n")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
    return out


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1:") -> tuple[DataFrame, np.ndarray]:
    """(id, vector, cluster, distance) of every row of ``vectors``, and the final centroids.

    ``vectors`` has columns id and vector (whole numbers, all of one length).  Centroids start as the ``k`` vectors with
    the least SHA-256 of ``seed`` and id (fewer where there are fewer); each round assigns all vectors and moves every
    centroid that has any to their mean, rounded down; then all are assigned once more.  Equal vectors share a cluster.
    Repeated rows count each; rows without an id count too but start no centroid while there are others.  Without vectors
    the result is empty.
    """
    vectors = materialise(vectors, "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select("id", "vector", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    state, moved = vectors, None
    for n in range(rounds + 1):
        state = _pass(state.where("members IS NULL") if n else state, centroids, moved, f"clusters-{n}")
        if n < rounds:
            now = _new_centroids(state, centroids)
            moved, centroids = np.sqrt(np.array([_squared(now[c : c + 1], centroids[c])[0] for c in range(len(now))], np.float64)), now
    return state.where("members IS NULL").select("id", "vector", "cluster", "distance"), centroids


def with_inertia(found: DataFrame) -> DataFrame:
    """``found`` with cluster_inertia and inertia, the sums of distance; the sums are one row per cluster."""
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = each.agg(F.sum("cluster_inertia").alias("inertia"))
    return found.join(F.broadcast(each.crossJoin(F.broadcast(total))), "cluster")


def digests(centroids: np.ndarray, cluster: str = "cluster") -> Column:
    """SHA-256 of a row's centroid, written as decimal numbers joined by commas."""
    spelled = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return F.element_at(F.array(*map(F.lit, spelled)) if spelled else F.array(F.lit("")), F.col(cluster) + 1)
