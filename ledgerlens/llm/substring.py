"""Repeated passages across documents: windows grouped by prefix, in place of
prefix-partitioned suffix trees.

Every word position starts a suffix.  The tree is needed down to depth
``WINDOW`` words: suffixes that meet in one node of that depth share a
passage of that length, so that one level alone is built: equal paths of whole
windows, found by sorting, without suffix order, inner nodes or depths.  Suffixes
are dealt out by a prefix of ``PREFIX`` words, the smallest (by hash) of the
prefixes that start inside the window, so that neighbouring windows travel
together under one prefix and equal windows always meet.  The number of
partitions follows the bytes of text.  Within a partition
the prefixes are sorted and cut, between different prefixes, into groups of
about ``GROUP`` suffixes; a prefix is never lengthened, so one hot prefix stays
one group however large.  Each group is sorted by the path of its suffixes, and
the nodes of depth ``WINDOW`` with two documents or more are the repeats.
Paths are 64-bit word-sequence hashes (prefix) and 48 further bits (window).

Before the shuffle each task collapses a chunk of documents: of equal windows
only the one in the smallest doc_id travels, the others are marked at once.
A passage in a third of all documents so reaches a subtree once per chunk.

Defined results: null text and fewer than ``WINDOW`` words: nothing removed;
rows that repeat a doc_id are judged alike, none against another; a null
doc_id counts as the largest; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import partitions, ship

WINDOW, PREFIX = 13, 5
CHUNK = 1 << 20   # words that a task holds at a time
GROUP = 1 << 19   # suffixes of one subtree
BUCKETS, MOST_BUCKETS = 64, 100_000  # parts of the suffixes, whatever the session's partitions
BUCKET_TEXT = 4 << 20  # bytes of text whose suffixes make one part
SEED = 13
LAST = 2**63 - 1  # stands for a null doc_id


def mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words):
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h, k: int, seed: int):
    """Hash of the k words from every position of ``h`` (len(h) - k + 1)."""
    import numpy as np

    mult = np.random.default_rng(seed).integers(1, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1)
    n = max(0, len(h) - k + 1)
    g = np.zeros(n, np.uint64)
    for i in range(k):
        g += h[i:i + n] * mult[i]
    return mixed(g)


def window_paths(h, window: int):
    """48-bit paths of the windows of a word-hash sequence."""
    import numpy as np

    return gram_hashes(h, window, SEED) >> np.uint64(16)


def six(x):
    """48-bit numbers as six bytes each."""
    import numpy as np

    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(b: bytes):
    import numpy as np

    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def by_doc(doc, path):
    """(doc_id, paths as bytes) of marks, one row per document."""
    import numpy as np

    order = np.argsort(doc, kind="stable")
    doc, path = doc[order], path[order]
    cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, int)
    end = np.r_[cut[1:], len(doc)]
    return doc[cut], [six(path[a:b]) for a, b in zip(cut, end)]


def suffixes(docs: DataFrame, buckets: int, window: int, prefix: int) -> DataFrame:
    """Rows (bucket, doc_id, blob): bucket >= 0: packed suffixes for a subtree
    partition; bucket null: marks of a document settled inside the chunk."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def flush(ids, hashes):
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            ids = np.array(ids, np.int64)[order]
            sizes = np.array([len(hashes[i]) for i in order])
            h = np.concatenate([hashes[i] for i in order])
            start = np.repeat(np.cumsum(sizes) - sizes, sizes)
            own = np.repeat(np.arange(len(ids)), sizes)
            end = start + np.repeat(sizes, sizes)
            full = gram_hashes(h, window, SEED)
            fits = np.arange(len(full)) + window <= end[:len(full)]
            g = gram_hashes(h, prefix, SEED + 1)
            low = g[:len(full)].copy()
            for i in range(1, window - prefix + 1):
                np.minimum(low, g[i:i + len(full)], out=low)
            at = np.flatnonzero(fits)
            path, low, own = full[at], low[at], own[at]
            _, first, back = np.unique(path, return_index=True, return_inverse=True)
            settled = ids[own] > ids[own[first]][back]
            path = path >> np.uint64(16)
            if settled.any():
                d, blobs = by_doc(ids[own[settled]], path[settled])
                yield from rows([None] * len(d), d, blobs)
            first.sort()
            path, low, own = path[first], low[first], own[first]
            cut = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (own[1:] != own[:-1])]) if len(low) else []
            if not len(cut):
                return
            runs = np.diff(np.r_[cut, len(low)])
            low, doc = low[cut], ids[own[cut]]
            to = (mixed(low) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            to, blobs, b = to[order], [], []
            borders = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            for x, y in zip(borders, np.r_[borders[1:], len(to)]):
                i = order[x:y]
                b.append(int(to[x]))
                n = runs[i]
                pos = np.repeat(cut[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                blobs.append(np.array([len(i)], "<u8").tobytes() + low[i].tobytes() + doc[i].tobytes()
                             + n.astype("<u4").tobytes() + six(path[pos]))
            yield from rows(b, [None] * len(b), blobs)

        def rows(bucket, doc, blobs):
            for i in range(0, len(blobs), 4096):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[i:i + 4096], pa.int32()), pa.array(doc[i:i + 4096], pa.int64()),
                     pa.array(blobs[i:i + 4096], pa.binary())], ["bucket", "doc_id", "blob"])

        ids, hashes, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                w = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                if len(w) < window:
                    continue
                ids.append(LAST if i.as_py() is None else i.as_py())
                hashes.append(word_hashes(w))
                held += len(w)
                if held >= CHUNK:
                    yield from flush(ids, hashes)
                    ids, hashes, held = [], [], 0
        if ids:
            yield from flush(ids, hashes)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "bucket int, doc_id long, blob binary")


def subtrees(dealt: DataFrame) -> DataFrame:
    """Marks (doc_id, blob) of the windows that a smaller document holds, from
    packed suffixes sorted by bucket; settled marks pass through."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def grown(blobs):
            low, doc, n, path = [], [], [], []
            for x in blobs:
                m = int(np.frombuffer(x, "<u8", 1)[0])
                low.append(np.frombuffer(x, "<u8", m, 8))
                doc.append(np.frombuffer(x, "<i8", m, 8 + 8 * m))
                n.append(np.frombuffer(x, "<u4", m, 8 + 16 * m))
                path.append(np.frombuffer(x, np.uint8, offset=8 + 20 * m))
            low, doc, n, path = (np.concatenate(v) for v in (low, doc, n, path))
            begin = np.cumsum(n, dtype=np.int64) - n
            order = np.argsort(low, kind="stable")  # prefixes in order; cut where a group is full
            total = np.cumsum(n[order], dtype=np.int64)
            new = np.flatnonzero(np.r_[True, low[order][1:] != low[order][:-1]])
            before = np.r_[0, total][new]
            group, cuts, base = 0, [0], 0
            for i, at in zip(new, before):
                if at - base >= GROUP:
                    cuts.append(i)
                    base = at
            six_rows = path.reshape(-1, 6)
            for x, y in zip(cuts, [*cuts[1:], len(order)]):
                i = order[x:y]
                k = n[i]
                pos = np.repeat(begin[i] - (np.cumsum(k, dtype=np.int64) - k), k) + np.arange(int(k.sum()))
                p = unsix(six_rows[pos].tobytes())
                d = np.repeat(doc[i], k)
                node = mixed(np.repeat(low[i], k)) + p * np.uint64(0x9E3779B97F4A7C15)
                leaf = np.lexsort((d, node))
                node, d, p = node[leaf], d[leaf], p[leaf]
                top = np.r_[True, node[1:] != node[:-1]]
                least = d[np.flatnonzero(top)][np.cumsum(top) - 1]
                hit = d > least
                if hit.any():
                    yield d[hit], p[hit]

        def marks(blobs):
            found = list(grown(blobs))
            if found:
                d, b = by_doc(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
                for i in range(0, len(d), 16384):
                    yield pa.RecordBatch.from_arrays([pa.array(d[i:i + 16384]), pa.array(b[i:i + 16384], pa.binary())],
                                                     ["doc_id", "blob"])

        bucket, blobs = None, []
        for b in batches:
            here = b.column(0).to_pylist()
            done = [i for i, x in enumerate(here) if x is None]
            if done:
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(done)), b.column(2).take(pa.array(done))],
                                                 ["doc_id", "blob"])
            for x, blob in zip(here, b.column(2)):
                if x is None:
                    continue
                if x != bucket and blobs:
                    yield from marks(blobs)
                    blobs = []
                bucket = x
                blobs.append(blob.as_py())
        if blobs:
            yield from marks(blobs)

    return dealt.mapInArrow(run, "doc_id long, blob binary")


def repeated_windows(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, buckets: int | None = None) -> DataFrame:
    """Marks (doc_id, blobs): per document the paths of its windows that also
    start in a document with a smaller doc_id."""
    text = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = buckets or max(BUCKETS, partitions(docs.sparkSession), min(MOST_BUCKETS, -(-text // BUCKET_TEXT)))
    dealt = suffixes(docs, n, window, prefix)
    spread = F.coalesce("bucket", (F.xxhash64("doc_id") % 1009).cast("int"))
    return (subtrees(dealt.repartition(n, spread).sortWithinPartitions("bucket"))
            .groupBy("doc_id").agg(F.collect_list("blob").alias("blobs")))


def drop_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words as ``text``, one space
    between, for every row of ``docs``."""
    found = repeated_windows(docs, window, prefix).withColumnRenamed("doc_id", "at")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            total, gone, text = [], [], []
            for t, blobs in zip(b.column(1), b.column(2)):
                w = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
                n, blobs = len(w), blobs.as_py()
                if blobs and n >= window:
                    hit = np.isin(window_paths(word_hashes(w), window), unsix(b"".join(blobs)))
                    edge = np.zeros(n + 1, np.int64)
                    at = np.flatnonzero(hit)
                    edge[at] += 1
                    np.subtract.at(edge, at + window, 1)
                    keep = np.cumsum(edge)[:n] == 0
                    w = [x for x, k in zip(w, keep) if k]
                total.append(n)
                gone.append(n - len(w))
                text.append(b" ".join(w).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(text, pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (d.join(found, F.coalesce("doc_id", F.lit(LAST)) == F.col("at"), "left").select("doc_id", "text", "blobs")
            .mapInArrow(run, "doc_id long, n_words long, n_removed long, text string"))


ship(__name__)
