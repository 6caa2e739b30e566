"""Centroid clustering of integer vectors in JVM expressions.

The centroids are literal arrays in the plan, their number and length given by parameters.  ``zip_with`` and ``aggregate`` give a vector's
squared distance to each of them, the least of an array of (distance, number) structs is its cluster, and one sum for each
component, with partial sums before the shuffle, gives the next centroids.  A round moves one row of sums for each cluster and task;
only the centroids reach the driver.  All arithmetic is on 64-bit integers, so rows may come in any order.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.sources.tables import spread

from .common import staged

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1


def whole(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: the vectors of exactly ``dimensions`` finite components, each as the integer floor(scale * x)."""
    x = F.col(vector).cast("array<double>")
    # NaN is above infinity in Spark's order
    sound = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(vec_id).alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def starts(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id, in that order; equal ids by their components, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in kept.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(clusters).collect()]


def literal(centroids: list[list[int]]) -> Column:
    """The centroids as an array of arrays, which Spark folds to a constant."""
    return F.expr(f"array({', '.join('array(' + ', '.join(f'{x}L' for x in c) + ')' for c in centroids)})")


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """Struct of the squared distance to the nearest centroid and its number; of equal ones the smallest number."""
    def distance(centroid: Column) -> Column:
        return F.aggregate(F.zip_with(v, centroid, lambda a, b: a - b), F.lit(0).cast("bigint"), lambda s, d: s + d * d)

    return F.array_min(F.transform(literal(centroids), lambda c, k: F.struct(distance(c).alias("distance"), k.alias("cluster"))))


def moved(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: each component the floor of sum over count; a cluster without vectors keeps its own."""
    n = F.count("*")
    sums = [F.sum(F.col("v")[k]).alias(f"s{k}") for k in range(len(centroids[0]))]
    by = kept.select(nearest(F.col("v"), centroids)["cluster"].alias("cluster"), "v").groupBy("cluster").agg(n.alias("n"), *sums)
    out = list(centroids)
    for r in by.collect():  # a row for each centroid at most
        out[r.cluster] = [s // r.n for s in r[2:]]
    return out


def clustered(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector that has ``dimensions`` finite components.

    Null vectors, those of another length and those with a null, NaN or infinite component are left out.  Null ids are ids and
    never start a centroid while others are left; repeated rows count each, and may start a centroid each; ties go to the smaller
    number.  With fewer vectors than ``clusters`` each starts one; an empty table gives an empty table.  Sums of squares beyond 64
    bits, from components of 2**27 and more after scaling, raise an arithmetic error and never give a wrong distance (ANSI mode, Spark's
    default).  Only the two named columns are read, so others can't clash.
    """
    kept = staged(whole(vectors, vec_id, vector, dimensions, scale), "vectors")
    centroids = starts(kept, clusters, seed)
    if not centroids:
        return kept.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))))
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    near = nearest(F.col("v"), centroids)
    placed = staged(kept.select("vec_id", near.alias("near")).select("vec_id", "near.cluster", "near.distance"), "placed")
    within = dict(placed.groupBy("cluster").agg(F.sum("distance")).collect())  # a row for each centroid at most
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values: F.element_at(F.lit(values), F.col("cluster") + 1)
    return placed.select(
        "vec_id", "cluster", "distance",
        of([within.get(k, 0) for k in range(len(centroids))]).cast("bigint").alias("cluster_inertia"),
        F.lit(sum(within.values())).cast("bigint").alias("inertia"),
        of(prints).alias("centroid_sha256"),
    )


def op11_clustering(spark, sf_dir):
    return clustered(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _sql() -> str:
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "parts AS MATERIALIZED (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM kept)",
        "first_ones AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept QUALIFY c < 16)",
        "c0 AS MATERIALIZED (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS k FROM first_ones)",
    ]
    for r in range(4):
        steps.append(f"a{r} AS MATERIALIZED (SELECT id, min((d, c)) AS near FROM (SELECT id, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM parts JOIN c{r} USING (k) GROUP BY id, c) GROUP BY id)")
        if r < 3:
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, o.k, coalesce(m.y, o.y) AS y FROM c{r} o LEFT JOIN (SELECT near[2] AS c, k, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS y FROM a{r} JOIN parts USING (id) GROUP BY near[2], k) m ON m.c = o.c AND m.k = o.k)")
    return "WITH " + ", ".join(steps) + """, prints AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY k)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT vec_id, CAST(near[2] AS INTEGER) AS cluster, near[1] AS distance, CAST(sum(near[1]) OVER (PARTITION BY near[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(near[1]) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN kept USING (id) JOIN prints ON prints.c = near[2]"""


OP11_SQL = _sql()
