"""SentencePiece encoding and decoding; giant documents by a parallel scan.

The result is the library's own encoding of the whole text, token for token.
A text of at most ``CHUNK`` characters is encoded by the library as it is.
A longer one is cut into chunks at arbitrary characters.  Its encoding is the
only path of vocabulary pieces over the text in which every two neighbours
are an encoding of their own joined string; so with weight 0 for such a pair
and minus infinity for any other it is the best path of a max-plus automaton,
whose state at a chunk border is the piece over the character before it.
Each chunk yields its transfer matrix between the states of its two borders
(the finite entries only).  The matrices of ``FAN`` neighbours are multiplied
into one, round by round, until a document is one matrix; its border states are
then pushed back down the same rounds, each row solving the inner borders of
its ``FAN`` parts, so that no row holds more than ``FAN`` matrices however long
the document, and every chunk is traced back alone.  Between places that no piece crosses (a blank after a
non-blank) the library encodes directly, so the automaton runs only around the
borders; a chunk without blanks is walked as a whole.

The model file is read on the driver (its size is that of a vocabulary) and
travels with the task.

Defined results: null and empty texts have no tokens; decoding returns the
text (U+2581, the library's own blank mark, comes back as a blank); rows that
repeat are encoded alike; extra columns pass through untouched.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import identity, save, ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 14
FAN = 32  # matrices multiplied in one row of a round
MARK = "▁"
OPEN = 0  # the state before the first and after the last piece


class Pieces:
    """A model with the lookups of the automaton."""

    def __init__(self, blob: bytes):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=blob)
        n = self.lib.get_piece_size()
        names = self.lib.id_to_piece(list(range(n)))
        plain = [not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i)) for i in range(n)]
        self.known = {p.replace(MARK, " ") for p, ok in zip(names, plain) if ok}
        self.longest = max(map(len, self.known))
        #: a blank after a non-blank always starts a piece, if no piece holds both
        self.blanks = not any(" " in p.lstrip(" ") for p in self.known)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.lib.is_byte(i) else b"" if self.lib.is_control(i) else p.replace(MARK, " ").encode()
                      for i, p in enumerate(names)]
        self.ids, self.pairs = {}, {}
        #: a character of no piece, behind which the library's leading blank is apart
        self.guard = next(c for c in "\n\t\ue000" if not any(c in p for p in self.known))
        self.lead = len(self.lib.encode(self.guard))

    def raw(self, text: str) -> list[int]:
        """The encoding without the library's leading blank."""
        return self.lib.encode(self.guard + text)[self.lead:]

    def of(self, piece: str) -> list[int]:
        got = self.ids.get(piece)
        if got is None:
            got = self.ids[piece] = self.raw(piece)
        return got

    def joins(self, a: str, b: str) -> bool:
        """Whether a and b stay apart when their joined string is encoded."""
        got = self.pairs.get((a, b))
        if got is None:
            got = self.pairs[(a, b)] = self.raw(a + b) == self.of(a) + self.of(b)
        return got

    def starting(self, text: str, at: int) -> list[str]:
        """The pieces that may start at a place: known ones that encode to
        themselves, or the character alone."""
        out = [text[at]]
        for n in range(2, min(self.longest, len(text) - at) + 1):
            p = text[at:at + n]
            if p in self.known and len(self.of(p)) == 1:
                out.append(p)
        return out

    def cuts(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """First and last place in [low, high] that no piece crosses."""
        if not self.blanks:
            return None
        first = last = None
        for step, places in ((0, range(max(low, 1), high + 1)), (1, range(min(high, len(text) - 1), max(low, 1) - 1, -1))):
            for i in places:
                if i < len(text) and text[i] == " " and text[i - 1] != " ":
                    if step == 0:
                        first = i
                    else:
                        last = i
                    break
        return None if first is None else (first, last)

    def walk(self, text: str, entries: dict, goal: int, over: bool):
        """Paths from the entries {(place, last piece or None): mask} to
        ``goal``: the pieces that cover the character before it (``over``) or
        that end there.  Returns ends[place] = [(piece, mask, previous)]."""
        ends: dict = {}
        for (place, piece), mask in entries.items():
            ends.setdefault(place, []).append((piece, mask, None))
        for at in range(min(ends), goal):
            here = ends.get(at)
            if not here:
                continue
            for p in self.starting(text, at):
                if at + len(p) > goal and not over:
                    continue
                for k, (q, mask, _) in enumerate(here):
                    if q is None or self.joins(q, p):
                        row = ends.setdefault(at + len(p), [])
                        for j, (r, m, back) in enumerate(row):
                            if r == p and back is not None and back[0] == at:
                                row[j] = (r, m | mask, back + ((k, mask),))
                                break
                        else:
                            row.append((p, mask, (at, (k, mask))))
        return ends

    def trace(self, ends, place: int, index: int, bit: int) -> list[str]:
        """The pieces of the path with ``bit`` that ends in an entry of ends."""
        out = []
        while True:
            piece, _, back = ends[place][index]
            if back is None:
                return out[::-1]
            out.append(piece)
            place, steps = back[0], back[1:]
            index = next(k for k, mask in steps if mask & bit)


def state(before: int, after: int) -> int:
    return before * 64 + after


def states(p: Pieces, text: str, border: int) -> dict[int, str]:
    """The pieces over the character before a border, by state."""
    out = {}
    for start in range(max(0, border - p.longest), border):
        for piece in p.starting(text, start):
            if start + len(piece) >= border:
                out[state(border - start, start + len(piece) - border)] = piece
    return out


def transfer(p: Pieces, left: str, body: str, right: str, first: bool, final: bool):
    """(ends of the head, ends of the tail, cut, entries, exits): everything
    between the states of a chunk's two borders.  Entries: [(state, bit)];
    exits: {state: (place, index, mask in the tail)}."""
    text, low, high = left + body + right, len(left), len(left) + len(body)
    entry = {OPEN: None} if first else states(p, text, low)
    codes = sorted(entry)
    start = {(low + (0 if c == OPEN else c % 64), entry[c]): 0 for c in codes}
    for bit, c in enumerate(codes):
        start[(low + (0 if c == OPEN else c % 64), entry[c])] |= 1 << bit
    furthest = max(place for place, _ in start)
    cut = p.cuts(text, furthest, high - 1 if not final else high)
    head = p.walk(text, start, cut[0] if cut else high, over=not cut and not final)
    tail = p.walk(text, {(cut[1], None): 1}, high, over=not final) if cut else head
    exits = {}
    for place, row in tail.items():
        for k, (piece, mask, back) in enumerate(row):
            if back is None and not (final and place == high):
                continue
            if final and place == high:
                exits.setdefault(OPEN, []).append((place, k, mask))
            elif not final and place >= high and back[0] < high:
                exits.setdefault(state(high - back[0], place - high), []).append((place, k, mask))
    return text, head, tail, cut, codes, exits


def matrix(p: Pieces, left, body, right, first, final) -> list[tuple[int, int]]:
    """The finite entries (state in, state out) of a chunk's matrix."""
    _, head, _, cut, codes, exits = transfer(p, left, body, right, first, final)
    cells = []
    for bit, c in enumerate(codes):
        reach = not cut or any(mask >> bit & 1 for _, mask, _ in head.get(cut[0], []))
        for out, ways in exits.items():
            if reach and any(mask & (1 if cut else 1 << bit) for _, _, mask in ways):
                cells.append((c, out))
    return cells


def traced(p: Pieces, left, body, right, first, final, into: int, out: int) -> list[int]:
    """The ids of the pieces that start in a chunk, given its border states."""
    text, head, tail, cut, codes, exits = transfer(p, left, body, right, first, final)
    bit = 1 << codes.index(into)
    ids = []
    if cut:
        k = next(k for k, (_, mask, _) in enumerate(head[cut[0]]) if mask & bit)
        for piece in p.trace(head, cut[0], k, bit):
            ids += p.of(piece)
        ids += p.raw(text[cut[0]:cut[1]])
        bit = 1
    place, k, _ = next(w for w in exits[out] if w[2] & bit)
    for piece in p.trace(tail, place, k, bit):
        ids += p.of(piece)
    return ids


def product(a: dict, b: dict) -> dict:
    """Max-plus product of sparse matrices of finite (zero) entries; a maps
    state in to {state out}."""
    return {s: set().union(*(b.get(m, set()) for m in mids)) for s, mids in a.items()}


def sparse(cells: list[tuple[int, int]]) -> dict:
    """A matrix {state in: {state out}} from its finite entries."""
    out: dict = {}
    for a, b in cells:
        out.setdefault(a, set()).add(b)
    return out


def folded(chain: list[dict]) -> dict:
    """The product of neighbouring matrices, in order; rows without an entry go."""
    total = chain[0]
    for m in chain[1:]:
        total = {s: to for s, to in product(total, m).items() if to}
    return total


def solved(chain: list[dict], into: int = OPEN, out: int = OPEN) -> list[int]:
    """The states at all borders of neighbouring matrices, given the outer two."""
    reach = [{into}]
    for m in chain:
        reach.append(product({into: reach[-1]}, m)[into])
    path, at = [out], out
    for m, seen in zip(reversed(chain), reversed(reach[:-1])):
        at = min(s for s in seen if at in m.get(s, ()))
        path.append(at)
    return path[::-1]


def border_states(cells: DataFrame, longest: int) -> DataFrame:
    """(doc, tx, i, into, out): the states at the borders of every chunk, from
    the chunks' matrices (doc, tx, i, a, b) of documents of at most
    ``longest`` chunks; one round for every power of ``FAN``."""

    def matrices(chain) -> list[dict]:
        return [sparse(list(zip(c["a"], c["b"]))) for c in chain]

    def up(batches):
        import pyarrow as pa

        for b in batches:
            got = [[(x, y) for x, to in folded(matrices(chain)).items() for y in to] for chain in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([[x for x, _ in g] for g in got], pa.list_(pa.int32())),
                 pa.array([[y for _, y in g] for g in got], pa.list_(pa.int32()))], ["doc", "tx", "i", "a", "b"])

    def down(batches):
        import pyarrow as pa

        for b in batches:
            for doc, tx, chain, into, out in zip(*(c.to_pylist() for c in b.columns)):
                path, n = solved(matrices(chain), into, out), len(chain)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * n, pa.int64()), pa.array([tx] * n, pa.int64()), pa.array([c["i"] for c in chain], pa.int32()),
                     pa.array(path[:-1], pa.int32()), pa.array(path[1:], pa.int32())], ["doc", "tx", "i", "into", "out"])

    rounds: list[DataFrame] = []
    while True:
        chains = cells.groupBy("doc", "tx", F.expr(f"int(i div {FAN})").alias("g")).agg(
            F.sort_array(F.collect_list(F.struct("i", "a", "b"))).alias("chain"))
        longest = -(-longest // FAN)
        if longest <= 1:
            break
        rounds.append(save(chains, "matrices"))  # read on the way up and on the way down
        cells = rounds[-1].mapInArrow(up, "doc long, tx long, i int, a array<int>, b array<int>")
    ends = chains.select("doc", "tx", "chain", F.lit(OPEN).alias("into"), F.lit(OPEN).alias("out"))
    while True:
        borders = ends.mapInArrow(down, "doc long, tx long, i int, into int, out int")
        if not rounds:
            return borders
        ends = rounds.pop().join(borders.withColumnRenamed("i", "g"), ["doc", "tx", "g"]).select("doc", "tx", "chain", "into", "out")


def slices(batch, rows: int = 64):
    """A batch in parts: token lists are large as Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(d, n_chunks, ids): each row of ``docs`` as a struct with its tokens."""
    blob = Path(model).read_bytes()
    rows = identity(docs)
    long = F.length("d.text") > chunk

    def whole(batches):
        import pyarrow as pa

        p = Pieces(blob)
        for whole_batch in batches:
            for b in slices(whole_batch):
                texts = [t or "" for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([1] * len(texts), pa.int32()),
                                                  pa.array(p.lib.encode(texts, num_threads=1), pa.list_(pa.int32()))], ["d", "n_chunks", "ids"])

    def cut(batches):
        import pyarrow as pa

        reach = Pieces(blob).longest
        for b in batches:
            for doc, tx, t in zip(*(c.to_pylist() for c in b.columns)):
                t = " " + t.replace(MARK, " ")  # the library's own leading blank and blank mark
                n = -(-len(t) // chunk)
                at = [i * len(t) // n for i in range(n + 1)]
                for k in range(0, n, 64):
                    i = range(k, min(n, k + 64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * len(i), pa.int64()), pa.array([tx] * len(i), pa.int64()), pa.array([n] * len(i), pa.int32()),
                         pa.array(list(i), pa.int32()), pa.array([t[max(0, at[x] - reach):at[x]] for x in i]),
                         pa.array([t[at[x]:at[x + 1]] for x in i]), pa.array([t[at[x + 1]:at[x + 1] + reach] for x in i])],
                        ["doc", "tx", "n", "i", "left", "body", "right"])

    def cells(batches):
        import pyarrow as pa

        p = Pieces(blob)
        for b in batches:
            got = [matrix(p, left, body, right, i == 0, i == n - 1) for n, i, left, body, right in zip(*(c.to_pylist() for c in b.columns[2:]))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array([[x for x, _ in g] for g in got], pa.list_(pa.int32())),
                 pa.array([[x for _, x in g] for g in got], pa.list_(pa.int32()))], ["doc", "tx", "n", "i", "a", "b"])

    def back(batches):
        import pyarrow as pa

        p = Pieces(blob)
        for b in (s for x in batches for s in slices(x)):
            ids = [traced(p, left, body, right, i == 0, i == n - 1, into, out)
                   for n, i, left, body, right, into, out in zip(*(c.to_pylist() for c in b.columns[2:]))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.list_(pa.int32()))], ["doc", "tx", "n", "i", "ids"])

    kind = rows.schema["d"].dataType.simpleString()
    short = rows.where(~F.coalesce(long, F.lit(False))).select("d", F.col("d.text").alias("text")).mapInArrow(
        whole, f"d {kind}, n_chunks int, ids array<int>")
    giant = rows.where(long)
    chunks = save(giant.select("doc", "tx", F.col("d.text").alias("text")).dropDuplicates(["doc", "tx"])
                  .mapInArrow(cut, "doc long, tx long, n int, i int, left string, body string, right string"), "chunks")
    wide = chunks.repartition("doc", "tx", "i")  # the chunks of a document go to many tasks
    most = chunks.agg(F.max("n")).first()[0] or 1
    borders = border_states(wide.mapInArrow(cells, "doc long, tx long, n int, i int, a array<int>, b array<int>").drop("n"), most)
    parts = (chunks.join(borders, ["doc", "tx", "i"]).select("doc", "tx", "n", "i", "left", "body", "right", "into", "out")
             .mapInArrow(back, "doc long, tx long, n int, i int, ids array<int>"))
    whole_ids = parts.groupBy("doc", "tx").agg(F.max("n").alias("n_chunks"), F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("p")).select(
        "doc", "tx", "n_chunks", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
    joined = giant.join(whole_ids, ["doc", "tx"]).select("d", "n_chunks", "ids")
    return short.union(joined)


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """``tokens`` (..., ids) with ``decoded``, the text of the tokens."""
    blob = Path(model).read_bytes()

    def run(batches):
        import pyarrow as pa

        table = Pieces(blob).bytes
        for b in (s for x in batches for s in slices(x)):
            ids = b.column(b.schema.get_field_index("ids")).to_pylist()
            text = [b"".join([table[i] for i in x or []])[1:].decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(run, f"{fields}, decoded string")


ship(__name__)
