"""Centroid clustering: Lloyd's rounds whose assignment step is an Exponion search, in exact integers.

Each vector carries its cluster, an upper bound on the distance to its centroid and a lower bound on the
distance to any other; after centroids moved, both are loosened by how far they moved. A vector whose
upper bound is under the lower one, or under half the way from its centroid to the nearest other, stays
without a distance being computed. Of the others the upper bound is made exact, and what is still
undecided scans only the centroids inside a ball around its own: radius two upper bounds plus the distance
to the nearest other centroid, in the sorted list of distances between centroids. The ball is closed
and comparisons are strict by a margin over rounding, so that equally near centroids are always seen and
the smaller number wins.

A round is one pass over the vectors, written as the next one's state, and sums per cluster; only
centroids (k vectors) are sent to tasks and come to the driver. A cluster of any size is summed in parts.

Defined results. Vectors without exactly `dim` components, or with a null or non-finite one, are left
out; so are vectors with a component over 2^27 after scaling, whose squared distances don't fit a
long. Repeated rows are vectors of their own. A null vec_id is assigned but starts no centroid; repeated
vec_ids start in order of their components. Fewer kept vectors than k give as many centroids; no kept
vectors give no rows. Only vec_id and embedding are read, other columns are dropped.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import bound_batches, discard, staged

# Fixed values of the query: components, centroids, rounds, scale of components, and the salt of the starting order.
DIM, K, ROUNDS, SCALE, SALT = 64, 40, 5, 256, 2
#: Largest component that is kept; 64 squares of twice this fit a long.
LARGEST = 2**27
#: Distances between bounds closer than this share count as equal, far over the rounding of square roots and sums.
MARGIN = 1e-9

STATE_SQL = "vec_id long, x array<int>, cluster int, upper double, lower double, distance long"


def kept_vectors(embeddings: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and x: the integer components of vectors that are whole."""
    e = F.col("embedding")
    whole = (F.size(e) == dim) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = F.transform(e, lambda c: F.floor(c.cast("double") * scale))
    x = F.when(whole, scaled)
    rows = embeddings.select("vec_id", x.alias("x")).where(F.col("x").isNotNull())
    return rows.where(F.forall("x", lambda c: F.abs(c) <= LARGEST)).select("vec_id", F.col("x").cast("array<int>").alias("x"))


def first_centroids(vectors: DataFrame, k: int = K, salt: int = SALT) -> np.ndarray:
    """The vectors with the least hashes of their ids: k rows, kept by each task and merged."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where(F.col("vec_id").isNotNull()).select(order.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x from c (one centroid, or one a row)."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Search:
    """One round's assignment. moved: how far each centroid went since the vectors' bounds were set."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray | None) -> None:
        self.c = centroids
        k = len(centroids)
        between = np.sqrt(np.array([squared(centroids, c) for c in centroids], dtype=np.float64).reshape(k, k))
        self.order = np.argsort(between, axis=1, kind="stable")  # the centroid itself, or an equal one, comes first
        self.near = np.take_along_axis(between, self.order, axis=1)
        away = between + np.diag(np.full(k, np.inf))
        self.nearest_other = away.min(axis=1)
        self.moved = moved
        if moved is not None:
            most = np.argsort(-moved, kind="stable")
            self.others_moved = np.full(k, moved[most[0]])
            self.others_moved[most[0]] = moved[most[1]] if k > 1 else 0.0
        self.scanned = 0  # distances computed, for tests

    def _scan(self, x: np.ndarray, lists: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid (least number of equal ones), its and the second's squared distance; of row i among the first counts[i] of lists[i]."""
        n = len(x)
        best, best_d, second = np.full(n, len(self.c)), np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
        for p in range(int(counts.max(initial=0))):
            on = np.flatnonzero(counts > p)
            j = lists[on, p]
            d = squared(x[on], self.c[j])
            self.scanned += len(on)
            wins = (d < best_d[on]) | ((d == best_d[on]) & (j < best[on]))
            second[on] = np.where(wins, best_d[on], np.minimum(second[on], d))
            best_d[on], best[on] = np.where(wins, d, best_d[on]), np.where(wins, j, best[on])
        return best, best_d, second

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All centroids for all rows: cluster, upper, lower."""
        k, n = len(self.c), len(x)
        best, d, second = self._scan(x, np.broadcast_to(np.arange(k), (n, k)), np.full(n, k))
        return best, np.sqrt(d), np.sqrt(second) if k > 1 else np.full(n, np.inf)

    def again(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cluster = cluster.copy()
        upper, lower = upper + self.moved[cluster], lower - self.others_moved[cluster]
        half = self.nearest_other[cluster] / 2

        def open_rows(rows: np.ndarray) -> np.ndarray:
            return rows[upper[rows] * (1 + MARGIN) + MARGIN >= np.maximum(lower[rows], half[rows])]

        rows = open_rows(np.arange(len(x)))
        upper[rows] = np.sqrt(squared(x[rows], self.c[cluster[rows]]))
        self.scanned += len(rows)
        rows = open_rows(rows)
        if len(rows) and len(self.c) > 1:
            own = cluster[rows]
            radius = (2 * upper[rows] + self.nearest_other[own]) * (1 + MARGIN) + MARGIN
            counts = np.zeros(len(rows), np.int64)
            for a in np.unique(own):
                of = own == a
                counts[of] = np.searchsorted(self.near[a], radius[of], side="right")
            best, d, second = self._scan(x[rows], self.order[own], counts)
            cluster[rows], upper[rows] = best, np.sqrt(d)
            # centroids outside the ball are farther than this from the row, and two inside it are nearer
            lower[rows] = np.sqrt(second)
        return cluster, upper, lower


def _assign(centroids: np.ndarray, moved: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    search = Search(centroids, moved)
    dim = centroids.shape[1]
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("x")
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
        if moved is None:
            cluster, upper, lower = search.first(x)
        else:
            cluster, upper, lower = search.again(x, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower")))
        distance = squared(x, centroids[cluster])
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), lists, pa.array(cluster, pa.int32()), pa.array(upper, pa.float64()), pa.array(lower, pa.float64()), pa.array(distance, pa.int64())],
            ["vec_id", "x", "cluster", "upper", "lower", "distance"],
        )


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each component and cluster, in longs; empty clusters keep theirs. k rows come back."""
    sums = [F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Staged state (vec_id, x, cluster, distance ...) after `rounds` rounds and a last assignment, and the centroids it used."""
    bound_batches(vectors.sparkSession)
    state, moved = vectors, None
    for left in range(rounds, -1, -1):
        new = staged(state.mapInArrow(functools.partial(_assign, centroids, moved), STATE_SQL), "clusters")
        if moved is not None:
            discard(state)
        state = new
        if left:
            target = moved_centroids(state, centroids)
            moved, centroids = np.sqrt(squared(target, centroids).astype(np.float64)), target
    return state, centroids


def _hash(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster_vectors(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector."""
    spark = embeddings.sparkSession
    vectors = kept_vectors(embeddings, dim)
    start = first_centroids(vectors, k)
    if not len(start):
        return spark.createDataFrame([], RESULT)
    state, centroids = cluster(vectors, start, rounds)
    sums = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    every = [(i, sums.get(i, 0), sum(sums.values()), _hash(c)) for i, c in enumerate(centroids)]
    # k rows
    per_cluster = F.broadcast(spark.createDataFrame(every, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return state.select("vec_id", "cluster", "distance").join(per_cluster, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def cluster_sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> str:
    """The same with every distance computed, a step for each round."""
    steps = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)) AS x FROM embeddings"
        f" WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id)) - 1 AS cluster, x AS c FROM v ORDER BY sha256('{SALT}:' || vec_id) LIMIT {k})",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT v.r, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min(struct_pack(d := list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.c) + list_inner_product(c.c, c.c), cluster := c.cluster)) AS best"
            f" FROM v CROSS JOIN c{n} c GROUP BY v.r)"
        )
        if n < rounds:
            steps.append(
                f"m{n} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM (SELECT best.cluster AS cluster, i, sum(x[i]::HUGEINT)::HUGEINT AS s, count(*)::HUGEINT AS n"
                f" FROM a{n}, (SELECT unnest(range(1, {dim} + 1)) AS i) GROUP BY 1, 2) GROUP BY cluster)"
            )
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN m{n} m USING (cluster))")
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(list_aggregate(list_transform(c.c, lambda e: e::BIGINT::VARCHAR), 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = best.cluster
"""
    )
