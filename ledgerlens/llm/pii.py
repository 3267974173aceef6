"""Personal data by weak supervision, with Spark expressions only.

Base spans follow fixed patterns (email, ip, card, phone).  Wider patterns
propose further candidates.  Four labelers vote on every candidate (yes, no,
abstain): the strict pattern, a gazetteer (top-level domains, card issuers,
country codes, public address ranges), cue words in the 40 characters before
it, and its shape.  Expectation-maximisation over the counts of equal vote
patterns estimates each labeler's reliability per kind and the probability of
every pattern; a logistic span classifier over context, gazetteer, shape and
layout features is fitted to those probabilities and decides about the wider
candidates.  Base spans always stay; wider candidates are sought in the text
with the base spans of their kind blanked, so that none overlaps one and lists
are walked once.

What the driver sees is the table of vote and feature patterns with counts,
at most ``CELLS`` rows however many documents there are.

Spans are in code points, end exclusive.  Patterns use possessive repeats and
look-behinds, so that a match costs time linear in the text and no stack.
Defined results: null text has no spans; every row is judged by itself, so
repeated ids do not matter; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import lower_ascii, save

KINDS = ("email", "ip", "card", "phone")
CONTEXT, ROUNDS, STEPS = 40, 40, 300
BLOCK = 256      # matches whose places are summed together
FILL = "\x00"    # stands for the characters of base spans; part of no pattern
CELLS = 4 * 2 * 3 * 3 * 3 * 2 * 3

#: Fixed patterns of the base spans: leftmost matches, as the plain patterns give them.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider candidates.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:00[0-9]{1,3}[\x20-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
}
#: What a text must contain before a pattern is tried: implied by a match of the base and of the wide pattern.
NEEDS = {"email": "@|[({\\[]at[)}\\]]", "ip": "[0-9A-Fa-f][.:][0-9A-Fa-f]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]|[0-9][\\x20().-][0-9(]"}
#: Fixed word lists of the gazetteer and context labelers.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "it", "uk", "us", "ch", "at", "be", "nl")
CUES = {
    "email": r"(?:e-?mail|mail|contact|contacto|kontakt|correo|courriel|write|schreib|reply)",
    "ip": r"(?:\bip\b|address|host|server|adresse|direcci|node|client)",
    "card": r"(?:card|visa|mastercard|amex|karte|carte|tarjeta|credit|debit|pay)",
    "phone": r"(?:phone|call|tel\b|tel\.|mobile|fax|telefon|t[eé]l[eé]fono|t[eé]l[eé]phone|handy|whatsapp)",
}
AGAINST = r"(?:version|isbn|issn|order|invoice|serial|article|ref\b|no\.|id\b|page|fig|table|sku|code)"


def given(value: Column, use) -> Column:
    """``use(value)`` with the value made once."""
    return F.get(F.transform(F.array(value), use), 0)


def matched(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<m, gap>>: the leftmost matches, each with the gap before
    it, and a last one without a match for the rest of the text."""
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.when(F.rlike(text, F.lit(needs)), F.arrays_zip(hits.alias("m"), F.split(text, pattern, -1).alias("gap"))).otherwise(
        F.array(F.struct(F.lit(None).cast("string").alias("m"), text.alias("gap"))))


SPANS = "array<struct<s:bigint,e:bigint,m:string,left:string>>"


def placed(pairs: Column) -> Column:
    """array<struct<s, e, m, left>> of matches with gaps: where each starts and
    ends, the match, and up to CONTEXT characters of the gap before it.  Places
    are summed inside blocks of ``BLOCK`` matches first and then shifted by the
    blocks before, so that no list of all matches is copied for every match."""
    kind = f"struct<pos:bigint,out:{SPANS}>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), F.right(x["gap"], F.lit(CONTEXT)).alias("left"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out")).cast(kind)

    def summed(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).cast("long").alias("pos"), F.array().alias("out")).cast(kind), step)

    def shifted(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["pos"])))
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda x, at: F.transform(x["out"], lambda y: F.struct(
            (y["s"] + at).alias("s"), (y["e"] + at).alias("e"), y["m"].alias("m"), y["left"].alias("left")))))

    def all_of(p: Column) -> Column:
        n = F.size(p)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")),
                             lambda k: summed(F.slice(p, k * BLOCK + 1, F.lit(BLOCK))))
        return F.when(n == 0, F.array().cast(SPANS)).when(n <= BLOCK, summed(p)["out"]).otherwise(given(blocks, shifted))

    return given(F.filter(pairs, lambda x: x["m"].isNotNull()), all_of)


def without(pairs: Column, drop) -> Column:
    """The text of matches and gaps, every match that ``drop`` holds for
    replaced by as many ``FILL`` characters."""
    return F.array_join(F.transform(pairs, lambda x: F.concat(x["gap"], F.when(x["m"].isNull(), "").when(
        drop(x["m"]), F.repeat(F.lit(FILL), F.length(x["m"]))).otherwise(x["m"]))), "")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = digits(m)
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.struct(
        F.substr(d, i, F.lit(1)).cast("int").alias("v"), ((F.length(d) - i) % 2 == 1).alias("twice")))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(~x["twice"], x["v"]).when(x["v"] > 4, x["v"] * 2 - 9).otherwise(x["v"] * 2))
    return total % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a base match holds."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3)
                        & (F.coalesce(F.regexp_replace(p, "^0+", "").substr(1, 3).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(digits(m))
    if kind == "card":
        return n.between(16, 19) & luhn(m)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def labelled(kind: str, x: Column, base: bool) -> Column:
    """A candidate with its votes and features."""
    m, left, d = x["m"], lower_ascii(x["left"]), digits(x["m"])
    n = F.length(d)
    cue = vote(F.rlike(left, F.lit(CUES[kind])), F.rlike(left, F.lit(AGAINST)))
    if kind == "email":
        last = lower_ascii(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
        gazetteer = vote(last.isin(*DOMAINS), F.rlike(last, F.lit("^[0-9-]+$")))
        shape = vote(F.rlike(m, F.lit("^[A-Za-z0-9]")), F.rlike(m, F.lit(r"^[.%+-]")))
    elif kind == "ip":
        head = F.regexp_extract(m, "^([0-9]{1,3})", 1).try_cast("int")
        six = F.contains(m, F.lit(":"))  # of the longer addresses 2000::/3 is given out
        gazetteer = vote(F.when(six, F.rlike(m, F.lit("^[23][0-9A-Fa-f]{3}:"))).otherwise(head.between(1, 223)),
                         F.when(six, F.rlike(m, F.lit("^0{1,4}:"))).otherwise((head == 0) | (head > 239)))
        shape = vote(~F.rlike(m, F.lit(r"(?:^|[.:])0[0-9A-Fa-f]")), F.rlike(m, F.lit(r"^[0-9]\.[0-9]\.[0-9]\.[0-9]$")))
    elif kind == "card":
        gazetteer = vote(F.rlike(d, F.lit("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|62)")), F.rlike(d, F.lit("^[0179]")))
        shape = vote(luhn(m), ~luhn(m))
    else:
        gazetteer = vote(F.rlike(m, F.lit(r"^(?:\+|00)[1-9]")), F.rlike(m, F.lit(r"^(?:19|20)[0-9]{2}[.-]")))
        shape = vote(n.between(9, 13), (n < 8) | (n > 15))
    layout = F.when(F.rlike(m, F.lit(r"[\x20().-]")), 1).otherwise(0)
    size = F.when(F.length(m) < 12, 0).when(F.length(m) < 17, 1).otherwise(2)
    return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(base).alias("base"),
                    F.lit(int(base)).alias("v_pattern"), gazetteer.alias("v_gazetteer"), cue.alias("v_context"),
                    shape.alias("v_shape"), layout.alias("layout"), size.alias("size"))


VOTES = ("v_pattern", "v_gazetteer", "v_context", "v_shape")
PATTERN = ("kind", *VOTES, "layout", "size")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every row with its labelled candidates, base ones first
    within a kind."""
    t = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def base(k: str) -> Column:
        return F.filter(placed(F.col(f"p_{k}")), lambda x: valid(k, x["m"])).alias(f"b_{k}")

    def wide(k: str) -> Column:
        # a wider candidate lies in what the base spans of its kind leave of the text
        rest = F.when(F.size(f"b_{k}") == 0, F.col("text")).otherwise(without(F.col(f"p_{k}"), lambda m: valid(k, m)))
        return placed(given(rest, lambda r: matched(r, WIDE[k], NEEDS[k]))).alias(f"w_{k}")

    def both(k: str) -> Column:
        return F.concat(F.transform(f"b_{k}", lambda x: labelled(k, x, True)), F.transform(f"w_{k}", lambda x: labelled(k, x, False)))

    got = t.select("*", *[matched(F.col("text"), BASE[k], NEEDS[k]).alias(f"p_{k}") for k in KINDS])
    got = got.select("*", *[base(k) for k in KINDS])
    got = got.select("doc_id", *[f"b_{k}" for k in KINDS], *[wide(k) for k in KINDS])
    return got.select("doc_id", F.concat(*[both(k) for k in KINDS]).alias("spans"))


def reliabilities(cells: list[dict], rounds: int = ROUNDS) -> None:
    """Expectation-maximisation per kind over vote patterns with counts ``n``;
    sets each pattern's probability ``p``."""
    for kind in KINDS:
        own = [c for c in cells if c["kind"] == kind]
        for c in own:
            cast = [c[v] for v in VOTES if c[v] >= 0]
            c["p"] = (sum(cast) + 0.5) / (len(cast) + 1)
        for _ in range(rounds):
            total = sum(c["n"] for c in own) or 1
            prior = (sum(c["n"] * c["p"] for c in own) + 1) / (total + 2)
            rate: dict = {}
            for v in VOTES:
                for y in (0, 1):
                    weight = {s: 1.0 for s in (-1, 0, 1)}
                    for c in own:
                        weight[c[v]] += c["n"] * (c["p"] if y else 1 - c["p"])
                    whole = sum(weight.values())
                    rate |= {(v, y, s): w / whole for s, w in weight.items()}
            for c in own:
                a, b = math.log(prior), math.log(1 - prior)
                for v in VOTES:
                    a, b = a + math.log(rate[v, 1, c[v]]), b + math.log(rate[v, 0, c[v]])
                c["p"] = 1 / (1 + math.exp(min(700, b - a)))


def inputs(kind, gazetteer, context, shape, layout, size) -> list:
    """Features of the span classifier, of numbers as of columns."""
    return ([kind(k) for k in KINDS] + [kind(k, gazetteer, s) for k in KINDS for s in (0, 1)]
            + [kind(k, context, s) for k in KINDS for s in (0, 1)] + [kind(k, shape, s) for k in KINDS for s in (0, 1)]
            + [kind(k, layout, 1) for k in KINDS] + [kind(k, size, s) for k in KINDS for s in (1, 2)])


def fitted(cells: list[dict], steps: int = STEPS) -> list[float]:
    """Weights of a logistic regression on the patterns' probabilities."""
    x = [[i for i, v in enumerate(inputs(
        lambda k, got=None, s=None, c=c: float(c["kind"] == k and got == s), c["v_gazetteer"], c["v_context"],
        c["v_shape"], c["layout"], c["size"])) if v] for c in cells]
    w = [0.0] * len(inputs(lambda *a: 0.0, 0, 0, 0, 0, 0))
    total = {k: sum(c["n"] for c in cells if c["kind"] == k) or 1 for k in KINDS}
    for _ in range(steps):
        slope = [0.01 * v for v in w]
        for c, on in zip(cells, x):
            z = sum(w[i] for i in on)
            off = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - c["p"]) * c["n"] / total[c["kind"]]
            for i in on:
                slope[i] += off
        w = [v - s for v, s in zip(w, slope)]
    return w


def detect(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, spans): every row with array<struct<kind, s, e, base>>, by kind
    and start."""
    held = save(candidates(docs), "pii-candidates")
    counts = held.select(F.explode("spans").alias("x")).select("x.*").groupBy(*PATTERN).agg(F.count(F.lit(1)).alias("n"))
    cells = sorted((r.asDict() for r in counts.collect()), key=lambda c: [str(c[p]) for p in PATTERN])  # at most CELLS
    reliabilities(cells)
    w = fitted(cells)

    def chance(x: Column) -> Column:
        def on(k, got=None, s=None):
            fits = x["kind"] == k
            return fits if got is None else fits & (got == s)
        terms = inputs(on, x["v_gazetteer"], x["v_context"], x["v_shape"], x["layout"], x["size"])
        z = sum([F.when(t, F.lit(v)).otherwise(0.0) for t, v in zip(terms, w)], F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    chosen = F.filter("spans", lambda x: x["base"] | (chance(x) >= threshold))
    order = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.array_sort(F.transform(chosen, lambda x: F.struct(
        F.array_position(order, x["kind"]).alias("at"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["base"].alias("base"))))
    return held.select("doc_id", F.transform(ranked, lambda x: F.struct(x["kind"], x["s"], x["e"], x["base"])).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
