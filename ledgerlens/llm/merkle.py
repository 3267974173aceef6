"""Merkle manifest of a dataset: a leaf per row, a tree per group, a root over
the groups, and a proof for every row.

Coordinates come from bitmaps, not from a sort of the rows.  The ids of a
group set bits in 64-bit words; only words with a bit are stored, every task
makes its own and Spark merges them by OR.  A directory of popcounts lies over
the words: nodes of ``FAN`` words, of ``FAN`` such nodes and so on, each with
the number of rows below it; sums within a node (at most ``FAN`` rows each)
give every word the number of rows before it.  The rank of an id is that
number plus the popcount of the word's lower bits.

With its rank a row knows its slot.  ``WIDTH ** DEEP`` consecutive slots are
one chunk: a task puts the digests into a slot array by their keys and reduces
``DEEP`` levels, one node per chunk is left, and the nodes are reduced in the
same way until one per group remains.  Proofs go the other way: chunks of
nodes hand the siblings above them down to their rows.

Defined results: a null group (lang) is a group of its own, the first; a null
doc_id counts as 2**63 - 1; rows of one group that share a doc_id stand in
the order of their leaves, and rows that repeat are leaves of their own; a
null field is ``-`` in the leaf; rows without a doc_id are not tampered with;
an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import LAST, lower_ascii, save, ship
from ledgerlens.operators.ordering import rank_within
from ledgerlens.session import checked_broadcast

WIDTH, DEEP = 8, 4
CHUNK = WIDTH ** DEEP
FAN_BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A value as its UTF-8 length, a colon and itself; null: a hyphen."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256))


def directory(nodes: DataFrame, group: list[str]) -> DataFrame:
    """``nodes`` (group..., key, total) with ``before``: the sum of the totals
    of smaller keys of the group.  ``key`` is a long, unique in its group.  A
    node has at most 2**FAN_BITS children, so no window grows with the data."""
    nodes = save(nodes, "directory")
    first = nodes.agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
    levels = [nodes]
    low, high = first.low or 0, first.high or 0
    while high - low >= 1 << FAN_BITS:
        low, high = low >> FAN_BITS, high >> FAN_BITS
        up = levels[-1].groupBy(*group, F.shiftright("key", FAN_BITS).alias("key")).agg(F.sum("total").alias("total"))
        levels.append(save(up, "directory"))

    def within(level: DataFrame, parent: Column) -> DataFrame:
        w = Window.partitionBy(*group, "parent").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        return level.withColumn("parent", parent).withColumn("before", F.coalesce(F.sum("total").over(w), F.lit(0)))

    out = within(levels.pop(), F.lit(0).cast("long")).drop("parent")
    while levels:
        above = out.select(*group, F.col("key").alias("parent"), F.col("before").alias("above"))
        here = within(levels.pop(), F.shiftright("key", FAN_BITS))
        out = here.join(above, [*group, "parent"]).withColumn("before", F.col("before") + F.col("above")).drop("parent", "above")
    return out


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (g, doc, leaf, ...) with ``pos``, the place of the row among
    the rows of its group by doc and leaf."""
    counts = leaves.groupBy("g", "doc").agg(F.count(F.lit(1)).alias("n"))
    low = F.col("doc").bitwiseAND(F.lit(63)).cast("int")
    words = save(counts.groupBy("g", F.shiftright("doc", 6).alias("key")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), low)).alias("bits"), F.sum("n").alias("total"),
        F.collect_list(F.when(F.col("n") > 1, F.struct(low.alias("at"), (F.col("n") - 1).alias("more")))).alias("repeats")), "bitmap")
    words = words.join(directory(words.select("g", "key", "total"), ["g"]).drop("total"), ["g", "key"])
    rows = leaves.withColumn("key", F.shiftright("doc", 6)).withColumn("at", low)
    rank = (F.col("before") + F.bit_count(F.expr("bits & ~shiftleft(-1L, at)"))
            + F.aggregate(F.filter("repeats", lambda r: r["at"] < F.col("at")), F.lit(0).cast("long"), lambda s, r: s + r["more"]))
    many = F.exists("repeats", lambda r: r["at"] == F.col("at"))
    found = save(rows.join(words.drop("total"), ["g", "key"]).select(*leaves.columns, rank.alias("pos"), many.alias("many")), "placed")
    ties = found.where("many")
    if ties.isEmpty():
        return found.drop("many")
    return found.where("not many").drop("many").union(untied(ties.drop("many")).select(*leaves.columns, "pos"))


def untied(ties: DataFrame) -> DataFrame:
    """Rows that share group, doc and ``pos``, in the order of their leaves."""
    columns = [c for c in ties.columns if c not in ("g", "doc", "leaf", "pos")]
    # equal leaves are equal rows: counted here, expanded at the end
    same = save(ties.groupBy("g", "doc", "leaf", "pos").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in columns]), "ties")
    key = F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long")
    same = same.withColumn("key", key)
    nodes = same.groupBy("g", "doc", "key").agg(F.sum("n").alias("total"))
    of_key = directory(nodes, ["g", "doc"]).drop("total")
    # leaves that share 60 bits, hardly ever more than one
    w = Window.partitionBy("g", "doc", "key").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    first = same.withColumn("here", F.coalesce(F.sum("n").over(w), F.lit(0))).join(of_key, ["g", "doc", "key"]).withColumn(
        "pos", F.col("pos") + F.col("before") + F.col("here"))
    blocks = first.withColumn("block", F.explode(F.expr("sequence(0L, (n - 1) div 65536)")))
    return blocks.withColumn("turn", F.explode(F.expr("sequence(block * 65536, least(n, (block + 1) * 65536) - 1)"))).withColumn(
        "pos", F.col("pos") + F.col("turn"))


def parent_digest(slots: list[bytes]) -> bytes:
    """The digest of a run of nodes: their hex digests, joined and hashed."""
    import hashlib

    return hashlib.sha256(b"".join(s.hex().encode() for s in slots)).digest()


def levels_of(slots: list[bytes], whole: bool) -> list[list[bytes]]:
    """The levels of a chunk, from its slots up.  A chunk that is ``whole`` (a
    whole group) ends with its one node, any other after DEEP levels."""
    levels = [slots]
    while len(levels[-1]) > 1 if whole else len(levels) <= DEEP:
        last = levels[-1]
        levels.append([parent_digest(last[i:i + WIDTH]) for i in range(0, len(last), WIDTH)])
    return levels


def slot_array(pos, digest) -> list[bytes]:
    """The digests by their keys: a chunk's positions are consecutive."""
    slots: list = [None] * len(pos)
    first = min(pos)
    for p, d in zip(pos, digest):
        slots[p - first] = d
    return slots


def siblings(levels: list[list[bytes]], at: int) -> tuple[list[bytes], list[bytes]]:
    """The hex digests left and right of slot ``at`` and of its parents."""
    left, right = [], []
    for level in levels[:-1]:
        run = at // WIDTH * WIDTH
        left.append(b"".join(s.hex().encode() for s in level[run:at]))
        right.append(b"".join(s.hex().encode() for s in level[at + 1:run + WIDTH]))
        at //= WIDTH
    return left, right


def reduced(nodes: DataFrame) -> DataFrame:
    """Chunks of ``nodes`` (g, pos, digest, n: nodes of the group) to one
    node each."""

    def run(key, t):
        import pyarrow as pa

        g, pos, n = key[0], t.column("pos").to_pylist(), t.column("n")[0].as_py()
        top = levels_of(slot_array(pos, t.column("digest").to_pylist()), n <= CHUNK)[-1][0]
        return pa.table({"g": [g.as_py()], "pos": [min(pos) // CHUNK], "digest": pa.array([top], pa.binary()), "n": [-(-n // CHUNK)]})

    return nodes.select("g", "pos", "digest", "n", F.expr(f"pos div {CHUNK}").alias("chunk")).groupBy("g", "chunk").applyInArrow(
        run, "g string, pos long, digest binary, n long")


def handed_down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Every node (g, pos) with the siblings left and right of it and of its
    parents, level by level up to the root.  ``above``: the same of the node
    of every chunk (g, pos)."""

    def run(key, t, up):
        import pyarrow as pa

        pos, n = t.column("pos").to_pylist(), t.column("n")[0].as_py()
        levels = levels_of(slot_array(pos, t.column("digest").to_pylist()), n <= CHUNK)
        more = [up.column(c)[0].as_py() for c in ("left", "right")]
        own = [siblings(levels, p % CHUNK) for p in pos]
        return pa.table({"g": [key[0].as_py()] * len(pos), "pos": pos, **{
            c: pa.array([o[i] + more[i] for o in own], pa.list_(pa.binary())) for i, c in enumerate(("left", "right"))}})

    rows = nodes.select("g", "pos", "digest", "n", F.expr(f"pos div {CHUNK}").alias("chunk")).groupBy("g", "chunk")
    return rows.cogroup(above.withColumnRenamed("pos", "chunk").groupBy("g", "chunk")).applyInArrow(
        run, "g string, pos long, left array<binary>, right array<binary>")


def proved(leaves: DataFrame, above: DataFrame, root: bytes) -> DataFrame:
    """doc_id, leaf, subroot, root, proof digest and the root folded from the
    row's present content (``now``, null: unchanged) of every leaf."""

    def run(key, t, up):
        import hashlib

        import pyarrow as pa

        pos, n, leaf, now = (t.column(c).to_pylist() for c in ("pos", "n", "leaf", "now"))
        levels = levels_of(slot_array(pos, leaf), n[0] <= CHUNK)
        left_up, right_up, subroot = (up.column(c)[0].as_py() for c in ("left", "right", "subroot"))
        proof, fold = [], []
        for p, own, changed in zip(pos, leaf, now):
            left, right = siblings(levels, p % CHUNK)
            seen, node = hashlib.sha256(), changed or own
            for x, y in zip(left + left_up, right + right_up):
                seen.update(x)
                seen.update(y)
                node = hashlib.sha256(x + node.hex().encode() + y).digest()
            proof.append(seen.hexdigest())
            fold.append(node.hex())
        m = len(pos)
        return pa.table({"doc_id": t.column("doc_id"), "leaf": [x.hex() for x in leaf], "subroot": [subroot.hex()] * m,
                         "root": [root.hex()] * m, "proof_sha256": proof, "folded_root": fold})

    rows = leaves.select("g", "pos", "doc_id", "leaf", "now", "n", F.expr(f"pos div {CHUNK}").alias("chunk")).groupBy("g", "chunk")
    return rows.cogroup(above.withColumnRenamed("pos", "chunk").groupBy("g", "chunk")).applyInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The steps from ``nodes`` (g, pos, digest, n) to one node per group, and
    these nodes.  A step shortens every group by the factor CHUNK."""
    steps = [nodes]
    while True:
        top = save(reduced(steps[-1]), "nodes", 8)
        if top.where("n > 1").isEmpty():
            return steps, top
        steps.append(top)


def manifest(docs: DataFrame, tampered: Column | None = None, now: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of
    every row of ``docs``.  ``now``: the text found at a later check, of the
    rows where ``tampered`` holds; their leaf is folded anew."""
    spark = docs.sparkSession
    present = F.lit(None).cast("binary") if now is None else F.when(tampered, leaf_of(text=now))
    lang = F.col("lang").cast("string")
    leaves = save(docs.select(*FIELDS).select(
        F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang)).alias("g"), F.col("doc_id").cast("long"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), leaf_of().alias("leaf"), present.alias("now")), "leaves")
    sizes = checked_broadcast(leaves.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "sizes")
    leaves = save(placed(leaves).join(sizes, "g"), "slots")
    steps, tops = tree(leaves.select("g", "pos", F.col("leaf").alias("digest"), "n"))
    # the tree over the groups: its leaves are the subroots, in one group
    ranked = save(rank_within(tops.select("g", "digest"), [], [F.col("g")]), "subroots")
    groups = ranked.select(F.lit("").alias("g"), (F.col("rank") - 1).alias("pos"), "digest", F.lit(ranked.count()).cast("long").alias("n"))
    over, top = tree(groups)
    root = top.first()
    if root is None:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    none = F.array().cast("array<binary>")
    above = top.select("g", F.lit(0).cast("long").alias("pos"), none.alias("left"), none.alias("right"))
    for step in reversed(over):
        above = save(handed_down(step, above), "above", 8)
    above = above.withColumnRenamed("pos", "rank0").drop("g").join(
        ranked.select("g", (F.col("rank") - 1).alias("rank0"), F.col("digest").alias("subroot")), "rank0").drop("rank0")
    subroots = save(above, "subroots")
    above = subroots.select("g", F.lit(0).cast("long").alias("pos"), "left", "right")
    for step in reversed(steps[1:]):
        above = save(handed_down(step, above), "above", 8)
    above = above.join(subroots.select("g", "subroot"), "g")
    return proved(leaves, above, bytes(root.digest)).withColumn("verified", F.col("folded_root") == F.col("root"))


def sampled(doc_id: Column, every: int = 3) -> Column:
    """Whether ``every`` divides the crc32 of the id in decimal."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % every == 0, F.lit(False))


def lowered(docs: DataFrame, every: int = 3) -> DataFrame:
    """``manifest`` of documents checked after the texts of one in ``every``
    have had their A-Z lower-cased."""
    return manifest(docs, sampled(F.col("doc_id"), every), lower_ascii(F.col("text")))


ship(__name__)
