"""Centroid clustering of integer vectors in column expressions: distances, nearest centroid and means stay in the JVM."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.session import drop_written, materialise

SCALE = 256
WIDEST = 1 << 27  # a component's largest magnitude: squared distances of 64 such components fit in a long


def whole_vectors(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(key, v): vectors of exactly ``width`` finite components, each as floor(256 x), for the rest of the module."""
    inf = float("inf")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(inf)))
    parts = F.transform(vector, lambda x: F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.floor(x.cast("double") * F.lit(float(SCALE))))).cast("int"))
    return df.filter((F.size(vector) == width) & good).select(F.col(key).cast("long").alias(key), parts.alias("v"))


def nearest(vector: Column, centroids: Sequence[Sequence[int]]) -> Column:
    """(distance, cluster) of the nearest centroid by squared distance; the smaller number wins a tie."""
    def distance(c: Column) -> Column:
        return F.aggregate(F.zip_with(vector, c, lambda x, y: (x - y).cast("long")), F.lit(0).cast("long"), lambda s, d: s + d * d)

    # constant text that the optimiser folds into one literal array each: far fewer plan nodes than one for every number
    literal = F.array(*[F.split(F.lit(",".join(map(str, c))), ",").cast("array<int>") for c in centroids])
    return F.array_min(F.transform(literal, lambda c, k: F.struct(distance(c).alias("distance"), k.alias("cluster"))))


def first_centroids(vectors: DataFrame, key: str, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``salt`` and key; equal keys are ordered by their components."""
    mark = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = vectors.select(mark.alias("_mark"), "v").orderBy("_mark", "v").limit(k).collect()
    return [list(r["v"]) for r in rows]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: the floor of every component's exact mean; a cluster without vectors keeps its own.

    The sums are one column each, added up in the scan's tasks; k rows reach the driver.
    """
    width = len(centroids[0])
    assigned = vectors.select("v", nearest(F.col("v"), centroids)["cluster"].alias("cluster"))
    sums = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(width)]).collect()
    out = list(centroids)
    for r in sums:
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def cluster_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5,
                    width: int = 64, salt: str = "2:") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector after ``rounds`` rounds.

    A vector is usable with exactly ``width`` components, none null or non-finite; others have no row.  Components are
    floor(256 x), held to 2^27 either way (values beyond half a million), so that distances are exact longs.  Every round
    is one scan of a written table with k rows of sums as its result; only k centroids are held as literals.  Fewer than
    k usable vectors give as many clusters; an empty table gives no rows.  Null keys take part (as an empty key in the
    starting order); repeated rows repeat.  Sums of distances that pass 64 bits are null.
    """
    vectors = materialise(whole_vectors(df, key, vector, width), "vectors")
    centroids = first_centroids(vectors, key, k, salt)
    if not centroids:
        return vectors.select(key, F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in (
            "distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    at = vectors.select(key, nearest(F.col("v"), centroids).alias("_at")).select(key, "_at.cluster", "_at.distance")
    found = materialise(at, "vector-clusters")
    drop_written(vectors)
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    by_cluster = F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in range(len(centroids))])
    total = None if None in sums.values() or sum(sums.values()) >= 1 << 63 else sum(sums.values())
    prints = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids])
    return found.select(key, F.col("cluster").cast("int").alias("cluster"), "distance", F.get(by_cluster, "cluster").alias("cluster_inertia"),
                        F.lit(total).cast("long").alias("inertia"), F.get(prints, "cluster").alias("centroid_sha256"))
