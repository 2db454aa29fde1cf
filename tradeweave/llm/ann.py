"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are grouped round centroids (fitted on a bounded sample). A vector's residual to
its centroid is turned by a random rotation and kept as one sign bit per dimension, with
two correction scalars: the residual's length and the inner product of the residual's
direction with its code. A query's inner product with the code, divided by the latter,
is an unbiased estimate of its inner product with the vector, with a known error bound.
So each block of an index cluster gives, per query, an upper and a lower bound of every
distance; only vectors whose lower bound is not above the k-th upper bound are measured
exactly, in double precision on the original vectors. A first step searches one block of each
query's nearest cluster; the k-th distance there bounds what all other blocks measure and return.

Every valid row is indexed. Queries are routed to their nearest clusters (``probe_share`` of
them, at least ``MIN_PROBES``, and as many as hold k candidates). Clusters are cut into blocks of rows
and blocks of queries, so neither a full cluster nor its queries meet in one task. The
driver sees the sample, the centroids and a count per cluster (at most ``MAX_CENTROIDS``).

Defined results: vectors that are null, all zero, of another than the commonest length, or
that hold null or non-finite components take no part; a null id is a candidate
but no query; of several rows with one query id, one vector (smallest hash) is the query
and all rows of that id are left out of its candidates; equal distances go to the smaller
id; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import python_ready, staged

SAMPLE_ROWS = 16_384
MAX_CENTROIDS = 4096
MIN_PROBES = 16
PROBE_SHARE = 0.75  # embeddings without strong clusters need most of them for a recall over 0.9
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
ERROR_FACTOR = 2.5
ROUNDING = 1e-9  # the same distance may come out differently in its last bits in another block
SEED = 20_240


def valid(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """k-means on a bounded sample; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), size=min(k, len(sample)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each vector, nearest first."""
    squares = (centres**2).sum(1)[None, :] - 2 * vectors @ centres.T
    if n == 1:
        return squares.argmin(1)[:, None]
    return np.argsort(squares, axis=1, kind="stable")[:, :n]


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, residual lengths, <code, direction>) relative to each row's centre."""
    turned = (vectors - centre) @ turn
    length = np.linalg.norm(turned, axis=1)
    bits = turned > 0
    dot = np.abs(turned).sum(1) / np.sqrt(turned.shape[1]) / np.where(length > 0, length, 1)
    return np.packbits(bits, axis=1), length, np.where(length > 0, dot, 1.0)


def bounds(codes: np.ndarray, length: np.ndarray, dot: np.ndarray, query: np.ndarray, centre: np.ndarray, turn: np.ndarray, factor: float = ERROR_FACTOR) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of squared distances, queries by rows of the index."""
    dims = query.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dims).astype(np.float32) * 2 - 1
    turned = (query - centre) @ turn
    far = np.linalg.norm(turned, axis=1)
    unit = (turned / np.where(far > 0, far, 1)[:, None]).astype(np.float32)
    cosine = (unit @ signs.T) / np.sqrt(dims) / dot[None, :]
    error = factor * np.sqrt(np.maximum(0, 1 - dot**2)) / dot / np.sqrt(max(1, dims - 1))
    sides, scale = far[:, None] ** 2 + length[None, :] ** 2, 2 * far[:, None] * length[None, :]
    slack = 1e-6 * (1 + sides)  # single precision
    return sides - scale * np.minimum(1, cosine + error) - slack, sides - scale * np.maximum(-1, cosine - error) + slack


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def search_block(ids: np.ndarray, known: np.ndarray, vectors: np.ndarray, codes, length, dot, q_ids: np.ndarray, queries: np.ndarray, most: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query id, id, distance): the k nearest of this block for each query, none farther than its ``most``; ``known`` is False where an id is null."""
    out: list[tuple[int, int, float]] = []
    lower, upper = bounds(codes, length, dot, queries, centre, turn)
    for i, q in enumerate(q_ids):
        others = ~((ids == q) & known)
        low, up = lower[i][others], upper[i][others]
        if not len(low):
            continue
        limit = min(np.partition(up, k - 1)[k - 1] if len(up) > k else np.inf, most[i] ** 2 * (1 + 2 * ROUNDING))
        chosen = np.flatnonzero(others)[low <= limit]
        distance = np.sqrt(((vectors[chosen] - queries[i]) ** 2).sum(1))
        order = np.lexsort((ids[chosen], ~known[chosen], distance))[:k]
        order = order[distance[order] <= most[i] * (1 + ROUNDING)]
        out += [(int(q), int(ids[chosen[j]]) if known[chosen[j]] else None, float(distance[j])) for j in order]
    return out


def one_bit_search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, probe_share: float = PROBE_SHARE) -> DataFrame:
    """query_id, rank, <key>, score: the k nearest rows of ``vectors`` by Euclidean distance for every row of ``queries``."""
    spark = vectors.sparkSession
    python_ready(spark)
    empty = spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).filter(valid("vector"))
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    if lengths is None:
        return empty
    dims, n_rows = lengths["n"], lengths["rows"]
    rows = rows.filter(F.size("vector") == dims)
    wanted = queries.select(F.col(key).cast("long").alias("q_id"), F.col(vector).alias("q_vector")).filter(valid("q_vector") & F.col("q_id").isNotNull() & (F.size("q_vector") == dims))
    wanted = wanted.groupBy("q_id").agg(F.min_by("q_vector", F.xxhash64("q_vector")).alias("q_vector"))

    # bounded: SAMPLE_ROWS vectors, chosen by hash
    sample = rows.orderBy(F.xxhash64("id", "vector")).limit(SAMPLE_ROWS).select("vector").toArrow()
    sample = _matrix(sample.column(0), dims)
    n_centres = int(min(MAX_CENTROIDS, max(1, round(n_rows**0.5 / 4)), len(sample)))
    centres, turn = fit_centroids(sample, n_centres), rotation(dims)

    def index(batches):
        for batch in batches:
            v = _matrix(batch.column(1), dims)
            at = nearest(v, centres, 1)[:, 0] if len(v) else np.zeros(0, np.int64)
            codes, length, dot = encode(v, centres[at], turn)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(dot)],
                                             names=["id", "vector", "cluster", "code", "length", "dot"])

    kept = T.StructType([*rows.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("length", T.DoubleType()), T.StructField("dot", T.DoubleType())])
    indexed = staged(rows.mapInArrow(index, kept), "index")
    held = np.zeros(n_centres, dtype=np.int64)
    for r in indexed.groupBy("cluster").agg(F.count("*").alias("n")).collect():  # MAX_CENTROIDS rows
        held[r["cluster"]] = r["n"]
    least = min(n_centres, max(MIN_PROBES, round(probe_share * n_centres)))

    def route(batches):
        for batch in batches:
            v = _matrix(batch.column(1), dims)
            order = nearest(v, centres, n_centres) if n_centres > 1 else np.zeros((len(v), 1), np.int64)
            enough = np.cumsum(held[order], axis=1) >= k + 1
            probes = np.maximum(least, np.where(enough.any(1), enough.argmax(1) + 1, n_centres))
            which = np.repeat(np.arange(len(v)), probes)
            clusters = np.concatenate([order[i, :p] for i, p in enumerate(probes)]) if len(v) else np.zeros(0, np.int64)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(probes) - probes, probes)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), batch.column(1).take(pa.array(which)), pa.array(clusters, pa.int32()), pa.array(nth, pa.int32())], names=["q_id", "q_vector", "cluster", "nth"])

    routed = staged(wanted.mapInArrow(route, T.StructType([*wanted.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("nth", T.IntegerType())])), "routed")
    asked = {r["cluster"]: r["n"] for r in routed.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # MAX_CENTROIDS rows
    cuts = spark.createDataFrame([(c, int(max(1, -(-held[c] // BLOCK_ROWS))), int(-(-asked.get(c, 0) // BLOCK_QUERIES))) for c in range(n_centres)], "cluster int, blocks int, q_blocks int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cuts = cuts.filter("q_blocks > 0")
    left = indexed.join(F.broadcast(cuts), "cluster").withColumn("block", F.pmod(F.xxhash64("id", "code", F.lit(3)), "blocks").cast("int")).withColumn("q_block", numbers("q_blocks"))
    right = routed.join(F.broadcast(cuts), "cluster").withColumn("q_block", F.pmod(F.xxhash64("q_id", F.lit(5)), "q_blocks").cast("int")).withColumn("block", numbers("blocks"))

    def search(key_: tuple, here: pa.Table, there: pa.Table) -> pa.Table:
        found = []
        if here.num_rows and there.num_rows:
            c = key_[0].as_py()
            known = ~here.column("id").combine_chunks().is_null().to_numpy(zero_copy_only=False)
            ids = here.column("id").fill_null(0).to_numpy()
            codes = np.frombuffer(b"".join(here.column("code").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            found = search_block(ids, known, _matrix(here.column("vector"), dims), codes, here.column("length").to_numpy(), here.column("dot").to_numpy(),
                                 there.column("q_id").to_numpy(), _matrix(there.column("q_vector"), dims), there.column("most").to_numpy(), centres[c], turn, k)
        return pa.table([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.float64())], names=["query_id", "id", "score"])

    by = ["cluster", "block", "q_block"]

    def searched(here: DataFrame, there: DataFrame) -> DataFrame:
        pairs = here.select(*by, "id", "vector", "code", "length", "dot").groupBy(*by).cogroup(there.select(*by, "q_id", "q_vector", "most").groupBy(*by))
        return pairs.applyInArrow(search, "query_id long, id long, score double")

    # first one block of each query's nearest cluster: its k-th distance there bounds what any other block may return
    early = (F.col("nth") == 0) & (F.col("block") == 0)
    some = staged(searched(left.filter("block = 0"), right.filter(early).withColumn("most", F.lit(float("inf")))), "early")
    most = staged(some.groupBy("query_id").agg(F.max("score").alias("most"), F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("q_id"), "most"), "bounds")
    rest = right.filter(~early).join(most, "q_id", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
    found = some.unionByName(searched(left, rest))
    best = Window.partitionBy("query_id").orderBy("score", F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
