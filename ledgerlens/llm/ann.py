"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Vectors are dealt by hash of their id into strips of about ``STRIP`` rows, the
queries are sent to every strip, and a task holds one strip at a time.  There
each vector, less the strip's mean, is rotated at random and kept as one bit a
dimension plus two scalars (its length, and the inner product of its direction
with its code).  A query's inner product with a vector is estimated from the
packed bits and the scalars, with the error bound of random rotations,
``EPSILON`` / sqrt(dim - 1) deviations wide.  The k-th largest lower bound is
a threshold; every vector whose upper bound reaches it is reranked with the
original components in double precision, so none is lost to a cap.  The best k
of each strip are merged by rank.

Defined results: a vector that is null, empty, zero or holds a null or
non-finite component takes no part, nor does a null id; vectors are compared
with vectors of their own length; a repeated id counts once, as the largest
of its vectors; no query meets its own id; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import partitions, ship

STRIP, MIN_STRIPS, EPSILON, SEED = 1 << 16, 8, 3.0, 7
ROWS, QUERIES = 8192, 64  # block of codes unpacked at once, queries estimated at once


class Strip:
    """The codes of one strip, with its original vectors."""

    def __init__(self, ids, x):
        import numpy as np

        fresh = np.r_[True, ids[1:] != ids[:-1]]
        self.ids, self.x = ids[fresh], np.ascontiguousarray(x[fresh])
        d = self.x.shape[1]
        with np.errstate(all="ignore"):
            self.mean = self.x.mean(axis=0)
            rest = self.x - self.mean
            self.rotation = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))[0]
            self.length = np.sqrt((rest * rest).sum(axis=1))
            unit = (rest / np.where(self.length > 0, self.length, 1)[:, None]) @ self.rotation
            self.codes = np.packbits(unit > 0, axis=1)
            self.fit = np.abs(unit).sum(axis=1) / np.sqrt(d)
            fit = np.where(self.fit > 0, self.fit, 1)
            self.scale = self.length / fit / np.sqrt(d)
            self.slack = self.length * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit * EPSILON / np.sqrt(max(1, d - 1))

    def bounds(self, q):
        """Lower and upper bounds of the inner products with queries ``q``."""
        import numpy as np

        d = q.shape[1]
        with np.errstate(all="ignore"):
            turned = (q @ self.rotation).astype(np.float32)
            dots = np.empty((len(self.ids), len(q)), np.float32)
            for i in range(0, len(dots), ROWS):
                bits = np.unpackbits(self.codes[i:i + ROWS], axis=1, count=d).astype(np.float32)
                dots[i:i + ROWS] = 2 * (bits @ turned.T)
            est = self.scale[:, None] * (dots - turned.sum(axis=1)[None, :]) + (q @ self.mean)[None, :]
            size = np.sqrt((q * q).sum(axis=1))
            err = (self.slack[:, None] + 1e-5 * (self.length + np.sqrt((self.mean ** 2).sum()))[:, None]) * size[None, :]
            low, high = est - err, est + err
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)

    def search(self, qids, q, k: int):
        """(query ids, vector ids, scores) of each query's k best here."""
        import numpy as np

        out = []
        for i in range(0, len(qids), QUERIES):
            low, high = self.bounds(q[i:i + QUERIES])
            for j, qid in enumerate(qids[i:i + QUERIES]):
                a, b, own = low[:, j], high[:, j], self.ids == qid
                a = np.where(own, -np.inf, a)
                n = len(a)
                bar = np.partition(a, n - k)[n - k] if n > k else -np.inf
                near = np.flatnonzero((b >= bar) & ~own)
                # row by row, so that equal vectors score alike wherever they stand
                score = (self.x[near] * q[i + j]).sum(axis=1)
                best = np.lexsort((self.ids[near], -score))[:k]
                out.append((np.full(len(best), qid), self.ids[near][best], score[best]))
        return [np.concatenate(c) for c in zip(*out)]


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, strip: int = STRIP) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``vectors`` and ``queries``, both
    (vec_id, embedding)."""

    def ready(df: DataFrame) -> DataFrame:
        v = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return v.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("dim", F.size("embedding"))

    data, asked = ready(vectors), ready(queries)
    strips = max(MIN_STRIPS, -(-data.count() // strip))
    asked = asked.groupBy("vec_id", "dim").agg(F.max("embedding").alias("embedding"))
    cols = ["dim", "strip", "asks", "vec_id", "embedding"]
    dealt = data.withColumn("strip", F.pmod(F.xxhash64("vec_id"), F.lit(strips)).cast("int")).withColumn("asks", F.lit(False)).select(*cols)
    sent = asked.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))).withColumn("asks", F.lit(True)).select(*cols)
    both = (dealt.union(sent).repartition(max(strips, partitions(vectors.sparkSession)), "dim", "strip")
            .sortWithinPartitions("dim", "strip", "asks", "vec_id", F.col("embedding").desc()))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at, ids, rows, held = None, [], [], None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            dim, part, asks, vec = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            flat = b.column(4).flatten().to_numpy(zero_copy_only=False)
            off = np.r_[0, np.cumsum(dim, dtype=np.int64)]
            cut = np.flatnonzero(np.r_[True, (dim[1:] != dim[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])])
            for x, y in zip(cut, np.r_[cut[1:], n]):
                key = (dim[x], part[x])
                if key != at:
                    at, ids, rows, held = key, [], [], None
                m = flat[off[x]:off[y]].reshape(-1, dim[x])
                if not asks[x]:
                    ids.append(vec[x:y].copy())
                    rows.append(m.copy())
                    continue
                if held is None and ids:
                    held = Strip(np.concatenate(ids), np.concatenate(rows))
                    ids, rows = [], []
                if held is not None:
                    q, v, s = held.search(vec[x:y], m, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())],
                                                     ["query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ship(__name__)
