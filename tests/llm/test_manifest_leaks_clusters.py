"""Merkle manifest, decontamination and centroid clustering against plain
Python, with nulls, empty and long texts, ties, repeated rows, empty tables
and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlens.llm import centroids, decontaminate, merkle

LAST = 2**63 - 1


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- manifest ---------------------------------------------------------------

DOCS = "doc_id long, source string, lang string, n_chars long, text string, g string, leaf string, pos long, n long, key string, at string"


def leaf(row, text):
    cells = (row[0], row[1], row[2], row[3], text)
    return h(*("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))


def up(nodes):
    return [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]


def path(nodes, at):
    """[(left, right)] from a leaf to the one node that remains."""
    out = []
    while len(nodes) > 1:
        run = at // 8 * 8
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + 8])))
        nodes, at = up(nodes), at // 8
    return out, nodes[0]


def manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((LAST if r[0] is None else r[0], leaf(r, r[4]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: x[:2])
    subs = [path([x[1] for x in groups[g]], 0)[1] for g in order]
    out = []
    for i, g in enumerate(order):
        for j, (_, own, r) in enumerate(groups[g]):
            below, sub = path([x[1] for x in groups[g]], j)
            above, root = path(subs, i)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            fold = leaf(r, None if r[4] is None else re.sub("[A-Z]", lambda m: m.group().lower(), r[4])) if bad else own
            for x, y in below + above:
                fold = h(x, fold, y)
            out.append((r[0], own, sub, root, h(*(x + y for x, y in below + above)), fold, fold == root))
    return out


def rows_of(n, seed=1):
    rnd = random.Random(seed)
    langs = [None, "", "en", "de", "é", "z", "\U0001f600", "￿"] + [f"l{i}" for i in range(60)]
    rows = []
    for _ in range(n):
        doc = rnd.choice([rnd.randrange(200), rnd.randrange(-10**12, 10**12), LAST, -LAST - 1, None] + [rnd.randrange(10**6)] * 6)
        text = rnd.choice([None, "", "Some Text é", "lower", "X" * 5000, f"T{rnd.random()}"])
        rows.append((doc, rnd.choice(["a", "b", None]), "en" if rnd.random() < .6 else rnd.choice(langs), rnd.choice([None, 3, 77]), text))
    return rows + rows[:40] + [rows[0]] * 30


def framed(spark, rows):
    return spark.createDataFrame([(*r, "c", "c", 1, 1, "c", "c") for r in rows], DOCS).repartition(3)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("rows", [rows_of(700), rows_of(1), [(5, "a", "en", 1, "Aa")], [(i, None, None, None, None) for i in range(9)],
                                  [(None, "s", "en", 1, "Same")] * 20])
def test_manifest(spark, rows):
    got = merkle.lowered(framed(spark, rows)).select(*COLUMNS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, manifest(rows)))


def test_manifest_of_more_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEEP", 2)
    monkeypatch.setattr(merkle, "CHUNK", 64)
    monkeypatch.setattr(merkle, "FAN_BITS", 2)
    rows = [(i * 7 - 900, "s", "en" if i % 9 else f"k{i}", i, f"Text {i}") for i in range(1300)]
    got = merkle.lowered(framed(spark, rows)).select(*COLUMNS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, manifest(rows)))
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_nothing(spark):
    assert merkle.lowered(framed(spark, [(1, "a", "b", 1, "c")]).limit(0)).select(*COLUMNS).collect() == []


# --- decontamination --------------------------------------------------------

def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def leaks(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = plain_words(t)
        for g in [tuple(w[j:j + n]) for j in range(max(len(w) - n + 1, min(len(w), 1)))]:
            windows.setdefault(g, set()).add(i)
    sizes, out = {len(g) for g in windows}, []
    for d, t in docs:
        w, hit, found = plain_words(t), set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                got = windows.get(tuple(w[j:j + k]))
                if got:
                    hit.update(range(j, j + k))
                    found |= got
        out.append((d, len(w), len(hit), sorted(str(i) for i in found - {None})))
    return out


def leaky(seed=2, n=150):
    rnd = random.Random(seed)
    vocab = ["a", "B", "cc", "dé", "Ee7", "ÄÖ", "y" * 90, "z" * 90] + [f"w{i}" for i in range(20)]
    say = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    items = [(i, say(rnd.choice([1, 2, 3, 5, 9, 10, 11, 30, 80]) if i % 3 else 40)) for i in range(30)]
    items = [(i, t) for i, t in items if len(t.split()) != 1] + [(50, None), (51, " ,.-"), (52, "rareword"), (None, items[3][1]), (7, say(12)), (60, items[4][1])]
    docs = []
    for i in range(n):
        parts = [say(rnd.randrange(30))]
        for _ in range(i % 3):
            w = rnd.choice(items)[1] or ""
            cut = w.split()
            a = rnd.randrange(len(cut) + 1) if i % 2 else 0
            parts += [(" ; ".join if i % 5 else " ".join)(cut[a:]).upper() if i % 4 else w, say(rnd.randrange(6))]
        docs.append((i % 140, " ".join(parts)))
    return docs + docs[:5] + [(900, None), (901, ""), (None, items[0][1]), (None, "RareWord"), (902, say(3000))], items


def doc_frame(spark, docs):
    return spark.createDataFrame([(i, t, "k", "k", "k", "k", "k") for i, t in docs],
                                 "doc_id long, text string, tx string, words string, starts string, n_words string, doc string").repartition(3)


def item_frame(spark, items):
    return spark.createDataFrame([(i, t, "k", "k") for i, t in items], "item_id long, text string, name string, size string").repartition(2)


@pytest.mark.parametrize("piece,shard", [(None, None), (16, None), (16, 200)])
def test_leaks(spark, monkeypatch, piece, shard):
    if piece:
        monkeypatch.setattr(decontaminate, "PIECE", piece)
    if shard:
        monkeypatch.setattr(decontaminate, "SHARD", shard)
    docs, items = leaky()
    got = decontaminate.matched(doc_frame(spark, docs), item_frame(spark, items)).select("doc_id", "n_words", decontaminate.n_hit(), "items")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, leaks(docs, items)))


def test_spans_go_and_covered_documents_with_them(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Clean text, before: {passage.upper()}! And (clean) text after it, more of it than the passage has, so that it stays."),
            (2, passage), (3, None), (4, "nothing"), (5, "")]
    got = decontaminate.decontaminate(doc_frame(spark, docs), item_frame(spark, [(1, passage)]))
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id != 3) == [
        (1, "Clean text, before: ! And (clean) text after it, more of it than the passage has, so that it stays."), (4, "nothing"), (5, "")]
    kept = decontaminate.decontaminate(doc_frame(spark, docs), item_frame(spark, [(1, passage)]), max_span=20, max_coverage=1.0)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(docs)
    assert got.columns == doc_frame(spark, docs).columns


def test_leaks_of_nothing(spark):
    docs, items = doc_frame(spark, [(1, "a b"), (2, None)]), item_frame(spark, [(1, "a b")])
    assert decontaminate.matched(docs.limit(0), items).collect() == []
    assert [(r.doc_id, r.n_words, r.starts) for r in decontaminate.matched(docs, items.limit(0)).orderBy("doc_id").collect()] == [(1, 2, []), (2, 0, [])]


# --- clustering -------------------------------------------------------------

def clusters(rows, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    middle = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, h(f"1:{r[0]}"), r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda v: min((dist(v, c), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        got = [pick(v)[1] for _, v in kept]
        for j in set(got):
            own = [v for (_, v), g in zip(kept, got) if g == j]
            middle[j] = [sum(c) // len(own) for c in zip(*own)]
    last = [(i, *pick(v)) for i, v in kept]
    total = {}
    for _, d, j in last:
        total[j] = total.get(j, 0) + d
    return [(i, j, d, total[j], sum(total.values()), middle[j]) for i, d, j in last]


@pytest.mark.parametrize("n,scale", [(120, 1.0), (10, 30.0), (1, 0.0)])
def test_clusters(spark, n, scale):
    rnd = np.random.default_rng(n)
    rows = [(i, (rnd.standard_normal(64) * scale * 10.0 ** (i % 3)).tolist()) for i in range(n)]
    rows += rows[:3] + [(3, rows[0][1]), (None, rows[-1][1]), (9, [0.0] * 64), (10, None), (11, [1.0]), (12, [1.0] * 63 + [None]),
                        (13, [1.0] * 63 + [math.nan]), (14, [1.0] * 63 + [math.inf]), (15, [])]
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, n int").repartition(3)
    got = centroids.cluster(df, k=16, rounds=3).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, clusters(rows, 16, 3)))
    assert centroids.cluster(df.limit(0)).collect() == []


def test_planes_are_exact():
    rnd = np.random.default_rng(5)
    a, c = rnd.integers(-2**20, 2**20, (50, 64)), rnd.integers(-300, 300, (7, 64))
    assert (centroids.dots(centroids.planes_of(a), centroids.planes_of(c)) == a @ c.T).all()
    assert (centroids.components_of(centroids.planes_of(a)) == a).all()
