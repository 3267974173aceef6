"""Centroid clustering of integer vectors by bit-plane popcounts.

A vector of 64 components becomes integers floor(scale * x) in two's
complement, and each of their bits a plane: one 64-bit word that holds this
bit of all 64 components.  A dot product is then exact and needs no
multiplication of components:

    a . c = sum over planes j, k of  w(j) w(k) popcount(A_j & C_k)

with w(j) = 2**j and minus that for the sign plane.  With the squared norm of
the vector, packed once, this gives exact squared distances.  A vector keeps
as many planes as its own largest component needs.

Vectors are packed once into a written table.  A round is one pass over it:
tasks assign their rows and add up components per cluster (one row per
cluster and batch), Spark adds those rows, and ``k`` rows reach the driver,
where exact floors give the next centroids.  Only centroids travel.

Defined results: a vector that is null, has another number of components, a
null or a non-finite one takes no part; neither does one with a component
beyond 2**27 after scaling, whose distances a long could not hold.  A null
vec_id is never preferred as a start; rows that repeat a vec_id are vectors of
their own and as starts stand in the order of their components; fewer vectors
than centroids give fewer centroids; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import save, ship

DIM, LARGEST = 64, 1 << 27
ROWS = 4096  # rows of a block of popcounts


def planes_of(whole):
    """Bit planes of an integer matrix (rows x 64): (rows x planes) words, the
    last plane the sign."""
    import numpy as np

    reach = max(int(whole.max(initial=0)), -1 - int(whole.min(initial=0)))
    bits = (whole[:, None, :] >> np.arange(reach.bit_length() + 1)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights_of(planes: int):
    import numpy as np

    w = np.int64(1) << np.arange(planes)
    w[-1] = -w[-1]
    return w


def components_of(planes):
    """The integer matrix of bit planes."""
    import numpy as np

    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")
    return np.einsum("npc,p->nc", bits.astype(np.int64), weights_of(planes.shape[1]))


def dots(a, c):
    """Exact dot products (rows x centroids) of two plane matrices."""
    import numpy as np

    out = np.zeros((len(a), len(c)), np.int64)
    wa, wc = weights_of(a.shape[1]), weights_of(c.shape[1])
    for j in range(a.shape[1]):
        for k in range(c.shape[1]):
            out += wa[j] * wc[k] * np.bitwise_count(a[:, j, None] & c[None, :, k]).astype(np.int64)
    return out


def same_width(column):
    """An array<long> column of planes as one matrix: sign planes repeat."""
    import numpy as np

    n = len(column)
    at = np.asarray(column.offsets, np.int64)
    words = np.asarray(column.values).view(np.uint64)
    width = np.diff(at)
    place = np.minimum(np.arange(width.max(initial=1))[None, :], width[:, None] - 1) + at[:n, None]
    return words[place]


def packed(vectors: DataFrame, id_col: str, column: str, scale: int) -> DataFrame:
    """(vec_id, norm, planes) of the vectors that take part."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(-1, DIM)
            fits = np.isfinite(x).all(axis=1) & (np.abs(x) < LARGEST / scale).all(axis=1)
            whole = np.floor(scale * x[fits]).astype(np.int64)
            ids = b.column(0).filter(pa.array(fits))
            reach = np.where(whole >= 0, whole, -1 - whole).max(axis=1, initial=0)
            width = np.array([int(r).bit_length() + 1 for r in reach], np.int64)
            p = planes_of(whole)
            used = np.arange(p.shape[1])[None, :] < width[:, None]
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(width)]).astype(np.int32), pa.array(p[used].view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array((whole * whole).sum(axis=1)), lists], ["vec_id", "norm", "planes"])

    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).where(
        f"size(v) = {DIM} and not exists(v, x -> x is null)")
    return whole.mapInArrow(run, "vec_id long, norm long, planes array<long>")


def starts(rows: DataFrame, k: int, seed: str):
    """The components of the k vectors first in hash order (k rows on the driver)."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = components_of(same_width(b.column(1))) if b.num_rows else np.zeros((0, DIM), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(got), pa.list_(pa.int64()))], ["turn", "v"])

    turn = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    turns = rows.select(turn.alias("turn"), "planes")
    last = turns.select("turn").where("turn is not null").orderBy("turn").limit(k).collect()
    if len(last) == k:  # else null ids are needed, too
        turns = turns.where(F.col("turn") <= last[-1].turn)
    first = turns.mapInArrow(run, "turn string, v array<long>")
    got = first.orderBy(F.col("turn").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in got], np.int64).reshape(len(got), DIM)


def assigned(rows: DataFrame, middle) -> DataFrame:
    """(vec_id, cluster, distance) of every row."""

    def run(batches):
        import pyarrow as pa

        for b, near, least, _ in nearest(batches, middle):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near, pa.int32()), pa.array(least, pa.int64())],
                                             ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def nearest(batches, middle):
    """For blocks of rows: the block, the nearest centroid of each row (the
    smaller number of equally near ones), its squared distance, the planes."""
    import numpy as np

    c, c_norm = planes_of(middle), (middle * middle).sum(axis=1)
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            p = same_width(b.column(2).take(list(range(b.num_rows))))
            d = np.asarray(b.column(1))[:, None] - 2 * dots(p, c) + c_norm[None, :]
            near = d.argmin(axis=1)
            yield b, near, d[np.arange(len(d)), near], p


def moved(rows: DataFrame, middle):
    """The next centroids: floors of the means, an empty cluster's unchanged."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        k = len(middle)
        for b, near, _, p in nearest(batches, middle):
            total = np.zeros((k, DIM), np.int64)
            np.add.at(total, near, components_of(p))
            n = np.bincount(near, minlength=k)
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(n, pa.int64()),
                                              *[pa.array(total[:, i]) for i in range(DIM)]], ["cluster", "n", *names])

    names = [f"s{i}" for i in range(DIM)]
    parts = rows.mapInArrow(run, "cluster int, n long, " + ", ".join(f"{s} long" for s in names))
    got = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col(s).cast("decimal(28,0)")).alias(s) for s in names]).collect()
    out = middle.copy()
    for r in got:  # a row per centroid
        if r.n:
            out[r.cluster] = [int(r[s]) // r.n for s in names]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, id_col: str = "vec_id",
            column: str = "embedding", seed: str = "1:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the final
    centroid (array of long) of every vector that takes part."""
    spark = vectors.sparkSession
    rows = save(packed(vectors, id_col, column, scale), "planes")
    middle = starts(rows, k, seed)
    for _ in range(rounds if len(middle) else 0):
        middle = moved(rows, middle)
    if not len(middle):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    got = save(assigned(rows, middle), "clusters")
    sums = {r.cluster: int(r.d) for r in got.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("d")).collect()}
    table = spark.createDataFrame(  # a row per centroid
        [(i, sums[i], sum(sums.values()), [int(x) for x in middle[i]]) for i in sorted(sums)],
        T.StructType.fromDDL("cluster int, cluster_inertia long, inertia long, centroid array<long>"))
    return got.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def written(centroid) -> str:
    """sha256 of a centroid's components joined by commas, as a column."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)


ship(__name__)
