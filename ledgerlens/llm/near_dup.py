"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every text becomes the set of its distinct five-word shingles and a signature
of ``MINIMA`` minima.  Texts with equal word sequences collapse to one
representative first.  Tree t sorts the representatives by their signature
read from its minimum ``t * STRIDE`` on, round to its begin.  How much of that
order is sorted differs by region: a first round sorts all rows by ``DEPTHS[1]``
minima, the next one only the rows of regions that are still crowded, by more
minima, and so on; what equals in all minima is left at the end.  Candidates:
all rows of a region (rows that share ``DEPTHS[0]`` minima) of at most
``WINDOW`` rows, all rows of a small region inside a crowded one, and in a
crowded region every two neighbours, which have the longest common prefix.
Candidates are confirmed on their full sets.

What a crowded region misses by that, a join finds exactly: its rows, if they
are still in several components, meet wherever the prefixes of their sets
share a shingle (``meetings``), and are confirmed on their full sets.  The
forest only makes that join small; no pair of a region is lost.

Defined results: null text and text without words have no shingles and link
with nothing; fewer words than a shingle count as one shingle; rows that
repeat a doc_id are nodes of their own by content; a null doc_id is never
the smallest; of a group without any doc_id, component_id is null and the rows
of one text are kept; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import components, partitions, save, ship

TREES, STRIDE, MINIMA, WINDOW = 20, 5, 100, 4
DEPTHS = (3, 5, 10, 20, 40, 80, 100)  # minima in common, round by round
SLOTS = 20  # bits of the shingle hash by which shingles are counted
SEED = 20240229


def shingle_set(words: list[bytes], k: int):
    """Sorted distinct 64-bit shingle hashes of a word list."""
    import numpy as np
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = max(1, len(words) - k + 1)
    mult = np.random.default_rng(SEED).integers(1, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1)
    s = np.full(n, len(words) if len(words) < k else k, np.uint64)
    for i in range(min(k, len(words))):
        s += h[i:i + n] * mult[i]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0x9E3779B97F4A7C15)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def signature(s, mult):
    """Minima of the hash family over a set, as big-endian 32-bit numbers."""
    import numpy as np

    low = np.full(len(mult), 2**64 - 1, np.uint64)
    for at in range(0, len(s), 512):
        low = np.minimum(low, (s[at:at + 512, None] * mult[None, :]).min(axis=0))
    return (low >> np.uint64(32)).astype(">u4").tobytes()


def features(docs: DataFrame, k: int = 5) -> DataFrame:
    """One row per document: doc_id, tx (hash of its text), n_shingles, fp
    (128-bit key of its word sequence) and signature; fp and signature are
    null for a text without words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        mult = np.random.default_rng(SEED + 1).integers(1, 2**63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
        for b in batches:
            n, fp, sig = [], [], []
            for t in b.column(2):
                w = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                s = shingle_set(w, k)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(b" ".join(w)) if w else None)
                sig.append(signature(s, mult) if w else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())],
                ["doc_id", "tx", "n_shingles", "fp", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(
        run, "doc_id long, tx long, n_shingles long, fp binary, sig binary")


def neighbours(rows: DataFrame, depth: int, width: int, border: bool = False) -> DataFrame:
    """Candidate pairs of rows (part, tree, key, fp) that follow each other in
    the sorted order of a tree; ``key`` holds ``width`` minima.  Output: kind
    0: pairs (fp, other); kind 1: a crowded region (tree, its ``depth``
    minima as key); kind 2: a crowded region that shares the whole key; kind
    3: the first and last rows of a partition, for the pairs that a partition
    border separates.  ``border``: only pairs of different partitions."""
    last = width == MINIMA

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("tree", pa.int32()), ("key", pa.binary()),
                            ("fp", pa.binary()), ("other", pa.binary())])

        def out(kind, part=None, tree=None, key=None, fp=None, other=None):
            n = len(fp if key is None else key)
            cols = [np.full(n, kind, np.int32), part, tree, key, fp, other]
            return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        def ends(t):
            return out(3, *[t.column(c).to_pylist() for c in ("part", "tree", "key", "fp")])

        tail, first = None, True
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            fresh = 0
            if tail is not None:
                fresh = tail.num_rows
                t = pa.concat_tables([tail, t])
            n = t.num_rows
            key = np.frombuffer(b"".join(t.column("key").to_pylist()), ">u4").reshape(n, width)
            tree, part = t.column("tree").to_numpy(), t.column("part").to_numpy()
            fp = np.array(t.column("fp").to_pylist(), object)
            differ = key[1:] != key[:-1]
            new_tree = tree[1:] != tree[:-1]
            region = np.concatenate([[0], np.cumsum(new_tree | differ[:, :depth].any(axis=1))])
            equal = np.concatenate([[0], np.cumsum(new_tree | differ.any(axis=1))])

            def crowded(ids):
                flag = np.zeros(n, bool)
                for i in np.flatnonzero(ids[WINDOW:] == ids[:-WINDOW]) if n > WINDOW else ():
                    flag[i:i + WINDOW + 1] = True
                return flag

            wide, same = crowded(region), crowded(equal)
            for w in range(1, min(WINDOW, n)):
                x, y = slice(0, n - w), slice(w, n)
                take = (region[x] == region[y]) & ~wide[x] | (equal[x] == equal[y]) & ~same[x]
                if w == 1:
                    take |= (region[x] == region[y]) & (equal[x] != equal[y])
                    if last:  # equal in all minima, so equal in every tree
                        take |= same[x] & (equal[x] == equal[y]) & (tree[x] == 0)
                take &= fp[x] != fp[y]
                take[:max(0, fresh - w)] = False  # done with the batch before
                if border:
                    take &= part[x] != part[y]
                at = np.flatnonzero(take)
                if len(at):
                    yield out(0, fp=np.minimum(fp[at], fp[at + w]), other=np.maximum(fp[at], fp[at + w]))
            for kind, flag, ids, size in ((1, wide, region, depth), (2, same, equal, width)):
                at = np.flatnonzero(flag)
                at = at[np.unique(ids[at], return_index=True)[1]]
                if len(at) and (kind == 1 or not last):
                    yield out(kind, tree=tree[at], key=[key[i, :size].tobytes() for i in at])
            if first:
                yield ends(t.slice(0, WINDOW))
                first = False
            tail = t.slice(max(0, n - WINDOW))
        if tail is not None:
            yield ends(tail)

    return rows.select("part", "tree", "key", "fp").mapInArrow(
        run, "kind int, part int, tree int, key binary, fp binary, other binary")


def read_from(sig, tree, minima: int):
    """``minima`` minima of a signature as a tree reads them."""
    return F.substring(F.concat(sig, sig), tree * (4 * STRIDE) + 1, F.lit(4 * minima))


def forest(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidate pairs (a, b) of all trees, and the crowded regions (tree,
    region) of the first round.  ``reps``: (fp, sig)."""
    n = partitions(reps.sparkSession)
    order = ["tree", "key", "fp"]
    trees = reps.select("fp", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    pairs = regions = None
    for depth, width in zip(DEPTHS, DEPTHS[1:]):
        rows = trees
        if pairs is not None:
            rows = trees.withColumn("key", read_from(F.col("sig"), F.col("tree"), depth)).join(deeper, ["tree", "key"], "left_semi")
        rows = rows.select("tree", read_from(F.col("sig"), F.col("tree"), width).alias("key"), "fp")
        rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
        found = save(neighbours(rows, depth, width), "neighbours")
        # first and last rows of every partition: a bounded number of rows each,
        # in the order of all, so that two rows of different partitions that are
        # close here are as close there
        edge = found.where("kind = 3").select("tree", "key", "fp", "part").distinct()
        found = found.union(save(neighbours(edge.coalesce(1).sortWithinPartitions(*order), depth, width, True), "edges"))
        here = found.where("kind = 0").select("fp", "other").toDF("a", "b")
        pairs = here if pairs is None else pairs.union(here)
        if regions is None:
            regions = save(found.where("kind = 1").select("tree", F.col("key").alias("region")).distinct(), "regions", 8)
        deeper = save(found.where("kind = 2").select("tree", "key").distinct(), "deeper", 8)
        if deeper.isEmpty():
            break
    return pairs.distinct(), regions


def full_sets(wanted: DataFrame, docs: DataFrame, feats: DataFrame, k: int) -> DataFrame:
    """(fp, s): the shingle sets (arrays of long) of the texts ``wanted`` (fp); only these are read."""
    ids = feats.where("fp is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "tx")).alias("rep")).join(wanted, "fp")
    ids = ids.select("fp", F.col("rep.doc_id").alias("rep_id"), F.col("rep.tx").alias("rep_tx"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            fp, sets = [], []
            for t, want in zip(b.column(0), b.column(1)):
                w = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                f = xxhash.xxh3_128_digest(b" ".join(w)) if w else None
                if f == want.as_py():  # unless two texts share a hash
                    fp.append(f)
                    sets.append(shingle_set(w, k).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["fp", "s"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tx"), "text").join(
        ids, F.expr("tx = rep_tx and doc_id <=> rep_id"))
    return save(texts.select("text", "fp").mapInArrow(run, "fp binary, s array<long>").groupBy("fp")
                .agg(F.first("s").alias("s")), "sets")


def checked(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ok) with ok: 100 * intersection >= percent * union, on
    the full sets ``held``.  Row by row in the JVM: sets of long texts never
    meet in one Arrow batch."""
    both = (pairs.join(held.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a")
            .join(held.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b"))
    n = F.size("sa") + F.size("sb")
    return both.select("a", "b", n.alias("n"), F.size(F.array_intersect("sa", "sb")).alias("m")).select(
        "a", "b", F.expr(f"100L * m >= {percent}L * (n - m)").alias("ok"))


def confirmed(pairs: DataFrame, docs: DataFrame, feats: DataFrame, k: int, percent: int) -> DataFrame:
    """``checked`` of the pairs on the texts that stand in one."""
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    return checked(pairs, full_sets(wanted, docs, feats, k), percent)


def slot_counts(held: DataFrame):
    """How many shingles of ``held`` fall into each of 2**SLOTS slots of the
    shingle hash: one array of fixed size, whatever the number of rows."""
    import numpy as np

    blocks, width = 16, (1 << SLOTS) // 16

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(1 << SLOTS, np.int64)
        for b in batches:
            s = np.asarray(b.column(0).flatten()).view(np.uint64)
            total += np.bincount((s >> np.uint64(64 - SLOTS)).astype(np.int64), minlength=1 << SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array(
            [total[i * width:(i + 1) * width].tobytes() for i in range(blocks)], pa.binary())], ["block", "n"])

    def add(x):
        import pandas as pd

        n = sum(np.frombuffer(v, np.int64) for v in x["n"])
        return pd.DataFrame({"block": [x["block"].iloc[0]], "n": [n.tobytes()]})

    parts = held.select("s").coalesce(max(8, partitions(held.sparkSession) // 4)).mapInArrow(run, "block int, n binary")
    got = parts.groupBy("block").applyInPandas(add, "block int, n binary").collect()  # 16 rows of 512 KB
    out = np.zeros(1 << SLOTS, np.int64)
    for r in got:
        out[r.block * width:(r.block + 1) * width] = np.frombuffer(r.n, np.int64)
    return out


def meetings(held: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of rows (fp, s, comp): all pairs of different
    components whose sets reach ``percent``, and few others.

    All sets stand in one order of shingles, rare slots first.  A pair that
    reaches ``percent`` has its first common shingle within the first
    n - ceil(percent n / 100) + 1 of the larger set and the first
    m - ceil(2 percent m / (100 + percent)) + 1 of the smaller one, and behind
    it enough shingles for the rest.  Any order keeps that true; by this one a
    passage that many rows share stands behind their own shingles."""
    counts = slot_counts(held)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows, tokens, places, sizes = [], [], [], []
                for i, x in enumerate(part.column(1)):
                    s = np.asarray(x.values).view(np.uint64)
                    n = len(s)
                    m = n + percent * n // -100 + 1
                    first = np.lexsort((s, counts[s >> np.uint64(64 - SLOTS)]))[:m]
                    tokens.append(s[first].view(np.int64))
                    places.append(np.arange(m, dtype=np.int32))
                    rows.append(np.full(m, i))
                    sizes.append(np.full(m, n, np.int32))
                if not rows:
                    continue
                at_row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), part.column(0).take(at_row), part.column(2).take(at_row),
                     pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], ["token", "fp", "comp", "n", "at"])

    marks = save(held.select("fp", "s", "comp").mapInArrow(run, "token long, fp binary, comp binary, n int, at int"), "marks")
    # components meet first, so that the rows of a large one never meet each
    # other; then the rows of the smaller one of two meet those of the other
    of = marks.groupBy("token", "comp").agg(F.struct(F.count(F.lit(1)).alias("rows"), F.col("comp")).alias("size"), F.min("n").alias("low"),
                                            F.max("n").alias("high"), F.max(F.expr("n - at")).alias("left"))
    c, d = of.alias("c"), of.alias("d")
    met = save(c.join(d, F.expr(
        f"c.token = d.token and c.size < d.size and 100L * c.high >= {percent}L * d.low and 100L * d.high >= {percent}L * c.low"
        f" and {100 + percent}L * least(c.left, d.left) >= {percent}L * (c.low + d.low)")).select(
        "c.token", F.col("c.comp").alias("c"), F.col("d.comp").alias("d")), "met", 4)
    row = F.struct("n", "fp", "at", F.expr(f"at <= n - (2L * {percent} * n + {99 + percent}) div {100 + percent}").alias("short"))
    x = marks.select("token", F.col("comp").alias("c"), row.alias("x")).join(met, ["token", "c"])
    y = marks.select("token", F.col("comp").alias("d"), row.alias("y"))
    return x.join(y, (x.token == y.token) & (x.d == y.d) & F.expr(
        f"100L * least(x.n, y.n) >= {percent}L * greatest(x.n, y.n) and if(struct(x.n, x.fp) < struct(y.n, y.fp), x.short, y.short)"
        f" and {100 + percent}L * least(x.n - x.at, y.n - y.at) >= {percent}L * (x.n + y.n)")).select(
        F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, tx, n_shingles, component_id, kept for every row of ``docs``;
    (doc_id, tx) names the row by content."""
    feats = save(features(docs, k), "features")
    some = feats.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("root"), F.min("tx").alias("tx"), F.first("sig").alias("sig"))
    reps = save(some, "representatives")
    pairs, regions = forest(reps.select("fp", "sig"))
    tested = save(confirmed(save(pairs, "pairs", 4), docs, feats, k, percent), "tested")
    labels = components(tested.where("ok").select("a", "b"))
    # what the forest did not compare: rows of crowded regions with several components
    now = (reps.select("fp", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
           .select("fp", "tree", read_from(F.col("sig"), F.col("tree"), DEPTHS[0]).alias("region"))
           .join(regions, ["tree", "region"], "left_semi")
           .join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("tree", "region", "fp", F.coalesce("comp", "fp").alias("comp")))
    now = save(now, "crowded", 4)
    mixed = now.groupBy("tree", "region").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    open_rows = save(now.join(mixed, ["tree", "region"], "left_semi").select("fp", "comp").distinct(), "open", 4)
    if not open_rows.isEmpty():
        held = full_sets(open_rows.select("fp"), docs, feats, k)
        more = save(meetings(held.join(open_rows, "fp"), percent).join(tested.select("a", "b"), ["a", "b"], "left_anti"), "more", 8)
        new = save(checked(more, held, percent), "tested", 4)
        labels = components(labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))
                            .union(new.where("ok").select("a", "b")))
    linked = reps.select("fp", "root", "tx").join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    # a group without any doc_id is held by the rows of its least text
    least = linked.groupBy("comp").agg(F.min("root").alias("component_id"), F.min("tx").alias("holder"))
    of_fp = linked.select("fp", "comp").join(least, "comp").drop("comp")
    return (feats.join(of_fp, "fp", "left")
            .withColumn("kept", F.when(F.col("fp").isNull(), True).when(F.col("component_id").isNull(), F.col("tx") == F.col("holder"))
                        .otherwise(F.col("doc_id").eqNullSafe(F.col("component_id"))))
            .select("doc_id", "tx", "n_shingles", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "kept"))


ship(__name__)
