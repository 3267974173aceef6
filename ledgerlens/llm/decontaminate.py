"""Benchmark decontamination by a generalised suffix automaton of test items.

Test items become sequences of normalised words.  Their suffix automaton
knows every substring of every item; a document's words are streamed through
it, and the automaton keeps the length of the longest suffix read so far that
stands in some item.  Where this length reaches ``n`` words, the last ``n``
words are a window of an item; an item of fewer words is one window, found
along the suffix links.  Windows that overlap merge into spans.

Size: items are cut into pieces of ``PIECE`` words that overlap by n - 1, so
every window lies whole in a piece, and equal pieces are one.  Pieces are
numbered by a distributed rank and dealt to groups of at most ``SHARD`` words
of at most ``LONG`` bytes.  Tasks that stream documents build the automaton of
one group; the documents pass one group after the other, so a larger benchmark
means more passes and no larger tasks.

Defined results: words are maximal runs of ASCII letters, digits and
characters beyond ASCII, A-Z lower-cased; a null or empty text has no words;
an item without words has no window; a null item_id hits, but is no item in
``items``; rows that repeat an item_id are one item; rows that repeat a
document each have the full result; empty tables are fine; extra columns are
ignored by ``matched`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import LAST, identity, save, ship, with_text
from ledgerlens.operators.ordering import rank_within

PIECE, SHARD = 4096, 1 << 17
LONG = 64  # bytes of a word; a longer one is known by its digest
#: Bytes that belong to words, lower-cased; every other byte becomes a blank.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def shortened(word: bytes) -> bytes:
    """The word, or a digest that no word equals."""
    return word if len(word) <= LONG else b"*" + hashlib.sha256(word).hexdigest().encode()[:48]


def suffix_automaton(sequences):
    """(next, link, length) of the automaton of all substrings of the
    sequences: state 0 is the empty string."""
    follow, link, length = [{}], [-1], [0]

    def split(p, c):
        """The state of p's longest string plus c, cut out of the state there."""
        q = follow[p][c]
        if length[q] == length[p] + 1:
            return q
        new = len(follow)
        follow.append(dict(follow[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and follow[p].get(c) == q:
            follow[p][c] = new
            p = link[p]
        return new

    for seq in sequences:
        last = 0
        for c in seq:
            if c in follow[last]:
                last = split(last, c)
                continue
            new = len(follow)
            follow.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in follow[p]:
                follow[p][c] = new
                p = link[p]
            if p >= 0:
                link[new] = split(p, c)
            last = new
    return follow, link, length


class Matcher:
    """The automaton of some pieces, ready for streaming.

    ``need[v]``: the match length from which a window ends in state v.
    ``short[v]``: the nearest state from v up the links that is a whole short
    item, or -1.  ``full[v]``: the state from v up that holds the last n
    words.  ``holders``: state -> the pieces with that window."""

    def __init__(self, pieces, n: int):
        self.n = n
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        seqs = [(pid, [number(w, len(self.vocabulary)) for w in ws]) for pid, ws in pieces]
        self.digests = any(w[:1] == b"*" for w in self.vocabulary)
        self.follow, self.link, self.length = suffix_automaton([s for _, s in seqs])
        follow, link, length = self.follow, self.link, self.length
        states = len(follow)
        self.holders: dict[int, set] = {}
        item_of: set[int] = set()
        order = sorted(range(1, states), key=length.__getitem__)
        self.full = [-1] * states
        for v in order:  # a link is always shorter
            if length[v] >= n:
                self.full[v] = v if length[link[v]] < n else self.full[link[v]]
        for pid, s in seqs:
            v = 0
            for i, c in enumerate(s):
                v = follow[v][c]
                if i + 1 >= n:
                    self.holders.setdefault(self.full[v], set()).add(pid)
            if 0 < len(s) < n:
                item_of.add(v)
                self.holders.setdefault(v, set()).add(pid)
        self.short, self.need = [-1] * states, [1 << 60] * states
        for v in order:
            self.short[v] = v if v in item_of else self.short[link[v]]
            if self.short[link[v]] >= 0 or length[link[v]] >= n:
                self.need[v] = 0
            elif v in item_of:
                self.need[v] = length[v]
            elif length[v] >= n:
                self.need[v] = n

    def spans(self, doc: list[bytes]):
        """(starts, ends, pieces): the merged spans of hit words, end
        exclusive, and the pieces whose windows occur."""
        follow, link, length, need, n = self.follow, self.link, self.length, self.need, self.n
        root = follow[0]
        v = at = 0
        ends, sizes, seen = [], [], set()
        for i, c in enumerate(map(self.vocabulary.get, map(shortened, doc) if self.digests else doc)):
            here = follow[v]
            if c in here:
                v = here[c]
                at += 1
            elif c not in root:
                v = at = 0
                continue
            else:
                while c not in here:
                    v = link[v]
                    here = follow[v]
                at = length[v] + 1
                v = here[c]
            if at >= need[v]:
                exact = at == length[v]
                seen.add((v, at >= n, exact))
                ends.append(i + 1)
                sizes.append(n if at >= n else length[self.short[v if exact else link[v]]])
        found: set[int] = set()
        for v, whole, exact in seen:
            if whole:
                found |= self.holders[self.full[v]]
            u = self.short[v if exact else link[v]]
            while u >= 0:
                found |= self.holders[u]
                u = self.short[link[u]]
        return *joined((e - k, e) for e, k in zip(ends, sizes)), sorted(found)


def joined(spans):
    """(starts, ends) of spans ordered by their ends, overlaps joined."""
    starts, ends = [], []
    for a, e in spans:
        while starts and starts[-1] >= a:
            starts.pop()
            ends.pop()
        if starts and ends[-1] >= a:
            ends[-1] = e
        else:
            starts.append(a)
            ends.append(e)
    return starts, ends


def pieces_of(items: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(piece, shard, words), and (piece, item_id): the distinct pieces
    of the items and who has them."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, out, size = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = [shortened(x) for x in words(t)]
                for at in range(0, max(1, len(w) - n + 1) if w else 0, PIECE):
                    ids.append(i)
                    part = w[at:at + PIECE + n - 1]
                    out.append(b" ".join(part))
                    size.append(len(part))
            for at in range(0, len(ids), 256):
                part = slice(at, at + 256)
                yield pa.RecordBatch.from_arrays([pa.array(ids[part], pa.string()), pa.array(out[part], pa.binary()),
                                                  pa.array(size[part], pa.int32())], ["item_id", "words", "size"])

    cut = items.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "item_id string, words binary, size int")
    cut = save(cut.withColumn("name", F.sha2("words", 256)), "pieces")
    distinct = cut.groupBy("name").agg(F.first("words").alias("words"), F.max("size").alias("size"))
    if (cut.agg(F.sum("size")).first()[0] or 0) <= SHARD:
        distinct = distinct.withColumn("kind", F.lit(0))
        room = F.lit(SHARD)
    else:  # pieces of a kind have less than twice the words of each other
        distinct = distinct.withColumn("kind", F.ceil(F.log2("size")).cast("int"))
        room = F.floor(SHARD / F.pow(F.lit(2), "kind")).cast("long")
    held = rank_within(distinct, ["kind"], [F.col("name")], "turn")
    held = held.withColumn("shard", F.concat_ws("-", "kind", F.floor((F.col("turn") - 1) / room)))
    held = save(held.withColumn("piece", F.monotonically_increasing_id()), "numbered")
    owners = cut.where("item_id is not null").join(held.select("name", "piece"), "name").select("piece", "item_id").distinct()
    return held.select("piece", "shard", "words"), owners


def matched(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """A row per row of ``docs``: doc_id, tx (hash of the text; both name the
    row by content), n_words, starts, ends (the spans of words inside windows
    of items) and items, the sorted ids of the items whose windows occur."""
    held, owners = pieces_of(items, n)
    shards = [r.shard for r in held.select("shard").distinct().orderBy("shard").collect()]  # one row per pass
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tx"), "text")
    base = found = None
    for shard in shards or [None]:
        # at most SHARD words of at most LONG bytes
        group = [bytes(r.words).split(b" ") for r in held.where(F.col("shard") == shard).orderBy("piece").select("words").collect()]
        names = [r.piece for r in held.where(F.col("shard") == shard).orderBy("piece").select("piece").collect()]

        def run(batches, group=group, names=names, every=base is None):
            import pyarrow as pa

            m = Matcher(list(zip(names, group)), n)
            for b in batches:
                got = [(len(w), *m.spans(w)) for w in (words(t.as_py()) for t in b.column(2))]
                cols = [b.column(0), b.column(1), pa.array([g[0] for g in got], pa.int64()),
                        *[pa.array([g[i] for g in got], pa.list_(pa.int32())) for i in (1, 2)],
                        pa.array([g[3] for g in got], pa.list_(pa.int64()))]
                if not every:
                    hit = pa.array([bool(g[1]) for g in got], pa.bool_())
                    cols = [c.filter(hit) for c in cols]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tx", "n_words", "starts", "ends", "pieces"])

        part = save(rows.mapInArrow(run, "doc_id long, tx long, n_words long, starts array<int>, ends array<int>, pieces array<long>"), "hits")
        base = part if base is None else base
        # rows that repeat are alike
        part = part.where("size(starts) > 0").groupBy("doc_id", "tx").agg(*[F.first(c).alias(c) for c in ("starts", "ends", "pieces")])
        found = part if found is None else found.union(part)
    base = base.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "doc_id", "tx", "n_words")
    found = found.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "tx", "starts", "ends", "pieces")
    if len(shards) > 1:
        found = whole_spans(found.groupBy("doc", "tx").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "pieces")]))
    found = save(found, "spans", 4)
    named = (found.select("doc", "tx", F.explode("pieces").alias("piece")).join(owners, "piece")
             .groupBy("doc", "tx").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    spans = save(found.drop("pieces").join(named, ["doc", "tx"], "left"), "found", 4)
    none = F.array().cast("array<int>")
    return base.join(spans, ["doc", "tx"], "left").select(
        "doc_id", "tx", "n_words", F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def whole_spans(found: DataFrame) -> DataFrame:
    """``found`` with the spans of several automata joined."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [joined(sorted(zip(x, y), key=lambda s: (s[1], -s[0]))) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            lists = [pa.array([g[i] for g in got], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists, b.column(4)], ["doc", "tx", "starts", "ends", "pieces"])

    return found.mapInArrow(run, "doc long, tx long, starts array<int>, ends array<int>, pieces array<long>")


def n_hit():
    """Number of words in the spans of ``matched``."""
    return F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, max_span: int | None = None, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without the text of the spans: every span of more than
    ``max_span`` words (default: all spans) goes, and so does a document whose
    spans cover more than ``max_coverage`` of its words.  Text between the
    remaining words stays as it is; a span goes with the separators behind its
    first word up to its last word."""

    def run(batches):
        import re

        import pyarrow as pa

        word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
        for b in batches:
            out = []
            for t, starts, ends in zip(*(c.to_pylist() for c in b.columns[1:])):
                cut = [(x, y) for x, y in zip(starts, ends) if max_span is None or y - x > max_span]
                if cut:
                    at = [m.span() for m in word.finditer(t)]
                    keep, last = [], 0
                    for x, y in cut:
                        keep.append(t[last:at[x][0]])
                        last = at[y - 1][1]
                    t = "".join(keep) + t[last:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["d", "text"])

    hit = (matched(docs, items, n).where("size(starts) > 0").dropDuplicates(["doc_id", "tx"])
           .select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "tx", "n_words", "starts", "ends"))
    own = identity(docs).join(hit, ["doc", "tx"], "left")
    clean = own.where("starts is null").select("d", F.col("d.text").alias("text"))
    left = own.where("starts is not null").where(n_hit() <= F.lit(max_coverage) * F.col("n_words"))
    cut = left.select("d", "d.text", "starts", "ends").mapInArrow(run, T.StructType([left.schema["d"], T.StructField("text", T.StringType())]))
    return clean.union(cut).select(*with_text("d", F.col("text"), docs.columns))


ship(__name__)
