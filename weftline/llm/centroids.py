"""Clustering by centroids with exact integer results.

Vectors become integers. Each round assigns every vector to its nearest centroid and replaces each centroid by the floor of its vectors'
mean. Tasks hold the centroids (a number times components: parameters) and read a batch of vectors at a time. Float32 matrix products
give 2 v.c of all centroids, and with |c|^2 an interval that holds the true |v - c|^2 - |v|^2: a product of n terms in any order of sums differs
from the true one by at most gamma(n) |v| |c|, gamma(n) = n u / (1 - n u), u = 2^-24, and rounding the integers to float32 adds two
to n. Centroids whose interval begins above the least end of all intervals can't be nearest. Where one is left it is the
nearest; where several are, their distances are counted again in whole numbers and the lowest number among equals wins. So the
result is that of exact arithmetic, whatever the order of the machine's sums.

Vectors aren't shuffled: every task sums its vectors by centroid and sends a row for each, with sums split into limbs of 40 bits so that they
stay exact at any size; Spark adds the rows. Every round reads the table again, so a lost executor costs its tasks only.

Defined results: vectors that are null, of another length, or with a null, NaN or infinite component are left out; vectors that
repeat count each; a null id hashes as an empty one; rows with one hash start in the order of their components; with fewer vectors than centroids
there are as many centroids as vectors, so equal vectors may start several, of which the lowest number gets all; components
beyond EXACT are compared as unbounded integers, and a distance or sum beyond a long comes out as null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import cut, table

CENTROIDS, COMPONENTS, ROUNDS, SCALE = 40, 64, 5, 256
#: Below it squares of differences of 64 components fit into 64 bits.
EXACT = 1 << 27
LIMB = 40
#: Bounds of the arrays of a step: numbers of a matrix of vectors, and of one of pairs that are compared again.
BLOCK = 1 << 20
UNIT = 2.0**-24


def kept(column: pa.Array, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that hold a vector, and their values."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == components)
    values = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64())
    found = pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False).reshape(-1, components)
    whole = np.isfinite(found).all(axis=1)
    return rows[whole], found[whole]


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64, or as Python's integers where a value needs them."""
    scaled = np.floor(values * scale)
    if not len(scaled) or np.abs(scaled).max() < EXACT:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled.tolist()], dtype=object).reshape(scaled.shape)


def screened(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """May the centroid be the vector's nearest? A row a vector, a column a centroid; int64 below EXACT."""
    n = vectors.shape[1] + 2
    gamma = n * UNIT / (1 - n * UNIT)
    products = (vectors.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    norms = (centroids * centroids).sum(axis=1).astype(np.float64)
    lengths = np.sqrt((vectors * vectors).sum(axis=1).astype(np.float64))
    # 2 gamma |v| |c|, and 2^-50 of each term for what float64 rounds here.
    error = lengths[:, None] * np.sqrt(norms)[None, :] * (2 * gamma * (1 + 2.0**-40) + 2.0**-48) + norms * 2.0**-50
    middle = norms[None, :] - 2 * products
    return middle - error <= (middle + error).min(axis=1)[:, None]


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors and centroids, row by row."""
    difference = vectors - centroids
    return (difference * difference).sum(axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector, the lowest of equals, and the exact squared distance."""
    clusters, distances = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), object)
    wide = np.abs(centroids).max(initial=0) >= EXACT
    if vectors.dtype != object and not wide:
        distances = distances.astype(np.int64)
    step = max(1, BLOCK // max(centroids.shape))
    for start in range(0, len(vectors), step):
        block = vectors[start : start + step]
        plain = block.dtype != object and not wide
        maybe = screened(block, centroids) if plain else np.ones((len(block), len(centroids)), bool)
        clusters[start : start + step] = maybe.argmax(axis=1)
        several = np.flatnonzero(maybe.sum(axis=1) > 1)
        for at in range(0, len(several), most := max(1, BLOCK // centroids.size)):
            rows = several[at : at + most]
            best = np.full(len(rows), -1)
            least = np.zeros(len(rows), np.int64 if plain else object)
            for c in np.flatnonzero(maybe[rows].any(axis=0)):  # in order, so that the lowest number keeps a tie
                asked = np.flatnonzero(maybe[rows, c])
                found = squared(block[rows[asked]], centroids[c])
                better = (best[asked] < 0) | (found < least[asked])
                best[asked[better]], least[asked[better]] = c, found[better]
            clusters[start + rows] = best
        distances[start : start + step] = squared(block, centroids[clusters[start : start + step]])
    return clusters, distances


def limbs(total: int) -> list[int]:
    """total in limbs of LIMB bits that all carry its sign, the lowest first."""
    sign, rest, found = (-1 if total < 0 else 1), abs(total), []
    while rest:
        found.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return found


def vector_batches(batches: Iterator[pa.RecordBatch], components: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batch, rows and whole numbers; wide rows come apart from the others."""
    for batch in batches:
        rows, values = kept(batch.column(batch.num_columns - 1), components)
        wide = (np.abs(values) * scale).max(axis=1, initial=0) >= EXACT - 1
        for part in (~wide, wide):
            if part.any():
                yield batch, rows[part], whole_numbers(values[part], scale)


def summed(centroids: np.ndarray, components: int, scale: int):
    """Rows of a task: cluster, limb, count (in limb 0), and that limb of the sum of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(centroids), components), object)
        counts = np.zeros(len(centroids), np.int64)
        for _, _, vectors in vector_batches(batches, components, scale):
            clusters, _ = nearest(vectors, centroids)
            for c in np.unique(clusters):
                mine = vectors[clusters == c]
                totals[c] += mine.sum(axis=0).astype(object)
                counts[c] += len(mine)
        rows = []
        for c in np.flatnonzero(counts):
            parts = [limbs(int(x)) for x in totals[c]]
            for k in range(max(1, max(map(len, parts)))):
                rows.append([int(c), k, int(counts[c]) if k == 0 else 0, *[p[k] if k < len(p) else 0 for p in parts]])
        if rows:
            names = ["cluster", "limb", "count", *[f"s{i}" for i in range(components)]]
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*rows, strict=True)], names=names)

    return run


def assigned(centroids: np.ndarray, components: int, scale: int):
    """cluster and distance of each vector; distance is null beyond a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, vectors in vector_batches(batches, components, scale):
            clusters, distances = nearest(vectors, centroids)
            out = pa.array([int(d) if d < 1 << 63 else None for d in distances] if distances.dtype == object else distances, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(clusters.astype(np.int32)), out], names=["id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, key, number: int, components: int, scale: int) -> np.ndarray:
    """The `number` vectors with the smallest key, in order. vectors: id, vector."""
    fits = (F.size("vector") == components) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.coalesce(fits, F.lit(False))).orderBy(key, F.col("vector").cast("array<double>")).limit(number).select("vector").collect()
    values = np.array([r["vector"] for r in rows], np.float64).reshape(-1, components)
    return whole_numbers(values, scale)


def next_centroids(vectors: DataFrame, centroids: np.ndarray, components: int, scale: int) -> np.ndarray:
    """Floors of the means; an empty centroid stays. The driver gets a row for each centroid and limb."""
    schema = "cluster long, limb long, count long, " + ", ".join(f"s{i} long" for i in range(components))
    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(components)]
    rows = vectors.select("vector").mapInArrow(summed(centroids, components, scale), schema).groupBy("cluster", "limb").agg(F.sum("count").alias("count"), *sums).collect()
    found = centroids.astype(object)
    totals, counts = {}, {}
    for r in rows:
        c = r["cluster"]
        total = np.array([r[f"s{i}"] << (LIMB * r["limb"]) for i in range(components)], object)
        totals[c], counts[c] = totals.get(c, 0) + total, counts.get(c, 0) + r["count"]
    for c, total in totals.items():
        found[c] = total // counts[c]
    return found.astype(np.int64) if not found.size or max(abs(x) for x in found.ravel()) < EXACT else found


def cluster(rows: DataFrame, key, number: int = CENTROIDS, components: int = COMPONENTS, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """id, cluster, distance of every vector, and the last centroids. rows: id (any type), vector (array of numbers); key: orders the starts."""
    vectors = rows.select("id", "vector")
    centroids = first_centroids(vectors, key, number, components, scale)
    if len(centroids):  # else no row holds a vector, and none comes out
        for _ in range(rounds):
            centroids = next_centroids(vectors, centroids, components, scale)
    found = vectors.mapInArrow(assigned(centroids, components, scale), f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long")
    return cut(found), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add cluster_inertia, inertia and centroid_sha256. The joined table has a row for each centroid."""
    spark = found.sparkSession
    long = lambda x: F.when(F.count("distance") == F.count(F.lit(1)), F.try_sum(x))
    sums = found.groupBy("cluster").agg(long(F.col("distance").cast("decimal(20,0)")).alias("whole")).collect()
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    whole = {r["cluster"]: None if r["whole"] is None else int(r["whole"]) for r in sums}
    total = None if None in whole.values() else sum(whole.values())
    digest = lambda c: hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()
    about = spark.createDataFrame([(k, fits(whole[k]), fits(total), digest(c)) for k, c in enumerate(centroids) if k in whole], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster")


def op12_cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    key = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = with_inertia(*cluster(rows, key))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"""n{r} as (select id, arg_min(cluster, (d, cluster)) as cluster, min(d) as distance from (
  select id, cluster, sum((v - c) * (v - c)) as d from kept join c{r} using (i) group by all) group by id)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""c{r + 1} as (select o.cluster, o.i, coalesce(m.c, o.c) as c from c{r} o left join (
  select cluster, i, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::bigint as c from kept join n{r} using (id) group by cluster, i) m using (cluster, i))"""
            )
    return f"""
with whole as (
  select row_number() over () as id, vec_id, embedding from embeddings
  where len(embedding) = {COMPONENTS} and len([x for x in embedding if x is not null and isfinite(x)]) = {COMPONENTS}),
kept as materialized (
  select id, unnest(range({COMPONENTS})) as i, floor({SCALE} * unnest(embedding)::double)::bigint as v from whole),
starts as (
  select id, row_number() over (order by sha256('2:' || coalesce(vec_id::varchar, '')), embedding) - 1 as cluster from whole qualify cluster < {CENTROIDS}),
c0 as (select cluster, i, v as c from kept join starts using (id)),
{", ".join(s.replace("as (select", "as materialized (select", 1) for s in steps)},
hashes as (select cluster, sha256(string_agg(c::varchar, ',' order by i)) as centroid_sha256 from c{ROUNDS} group by cluster)
select vec_id, cluster::int as cluster, distance::bigint as distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
  (sum(distance) over ())::bigint as inertia, centroid_sha256
from n{ROUNDS} join whole using (id) join hashes using (cluster)
"""


ORACLE_SQL = _sql()
