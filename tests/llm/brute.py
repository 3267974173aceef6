"""Plain Python versions of the operators' contracts, for small tables.
Documents are (doc_id, text, source) tuples."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"
LAST = 2**63 - 1


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def num(i):
    return LAST if i is None else i


def line_dedup(docs, min_chars=10):
    """[(kept text, n_lines, n_dropped)] in the order of docs."""
    first = {}
    for i, text, _ in docs:
        for x in (text or "").split("\n"):
            k = lower(x.strip(SPACES))
            if len(k) >= min_chars:
                first[k] = min(first.get(k, LAST), num(i))
    out = []
    for i, text, _ in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(lower(x.strip(SPACES)), LAST) >= num(i)]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def passages(docs, n=13):
    """[(kept text, n_words, n_removed)]."""
    first = {}
    for i, text, _ in docs:
        w = WORD.findall(text or "")
        for j in range(len(w) - n + 1):
            g = tuple(w[j:j + n])
            first[g] = min(first.get(g, LAST), num(i))
    out = []
    for i, text, _ in docs:
        w = WORD.findall(text or "")
        gone = set()
        for j in range(len(w) - n + 1):
            if first[tuple(w[j:j + n])] < num(i):
                gone.update(range(j, j + n))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((" ".join(kept), len(w), len(w) - len(kept)))
    return out


def shingles(text, k=5):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def near(docs):
    """[(n_shingles, component)]; rows are nodes."""
    sets = [shingles(t) for _, t, _ in docs]
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                up[top(a)] = top(b)
    least = {}
    for a, (i, _, _) in enumerate(docs):
        if i is not None:
            least[top(a)] = min(least.get(top(a), LAST), i)
    return [(len(s), least.get(top(a))) for a, s in enumerate(sets)]


def quality(docs, min_docs=20, share=0.005, depleted=0.7):
    """[(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_cut, gone places)]."""
    def norm(x):
        return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", lower(x.strip(SPACES))))
    holders, host_docs = defaultdict(set), defaultdict(set)
    for i, text, source in docs:
        host_docs[source].add(num(i))
        for x in (text or "").split("\n"):
            if WORD.search(x):
                holders[source, norm(x)].add(num(i))
    out = []
    for i, text, source in docs:
        t = text or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4))
        rep = set()
        for j in range(len(w) - 4):
            if grams[tuple(w[j:j + 5])] > 1:
                rep.update(range(j, j + 5))
        lines = t.split("\n")
        full = [x for x in lines if WORD.search(x)]
        gone = [p for p, x in enumerate(lines) if WORD.search(x)
                and len(holders[source, norm(x)]) > max(min_docs, share * len(host_docs[source]))
                and num(i) > min(holders[source, norm(x)])]
        cut = sum(len(WORD.findall(lines[p])) for p in gone)
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        out.append((len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(rep),
                    failed, not failed and cut <= depleted * len(w), cut, gone))
    return out


def mix(docs, weights=(3, 1, 2), total=1.5, cap=2.0):
    """[(size, source_size, target, taken)]."""
    size = [len(WORD.findall(t or "")) for _, t, _ in docs]
    of = defaultdict(int)
    for (_, _, s), n in zip(docs, size):
        of[s] += n
    order = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, target = set(), {}
    while True:
        left = total * sum(of.values()) - sum(cap * of[s] for s in full)
        level = left / (sum(w[s] for s in order if s not in full) or 1)
        target = {s: cap * of[s] if s in full else level * w[s] for s in order}
        over = {s for s in order if s not in full and target[s] >= cap * of[s]}
        if not over:
            break
        full |= over
    h = [int(hashlib.md5(f"0:{'' if i is None else i}".encode()).hexdigest()[:15], 16) for i, _, _ in docs]
    out = []
    bound = {}
    for s in order:
        copies = math.floor(target[s] / of[s]) if of[s] else 0
        rest = target[s] - copies * of[s]
        sums = defaultdict(int)
        for (_, _, t), n, x in zip(docs, size, h):
            if t == s:
                sums[x] += n
        run, cut = 0, 0
        if rest > 0:
            for x in sorted(sums):
                if run + sums[x] >= rest:
                    cut = x if rest - run <= run + sums[x] - rest else x + 1
                    break
                run += sums[x]
        bound[s] = copies, cut
    for (_, _, s), n, x in zip(docs, size, h):
        out.append((n, of[s], target[s], n * (bound[s][0] + (x < bound[s][1]))))
    return out
