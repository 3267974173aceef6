"""DuckDB SQL of the queries that SQL can express, written from their
contracts."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.first < l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE f.first IS NULL OR f.first >= l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN f ON f.key = l.key GROUP BY l.doc_id
"""

SUBSTRING = r"""
WITH w AS (SELECT doc_id, __WORDS__ AS w FROM documents),
s AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 12, 0))) AS i FROM w)),
f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g),
hit AS (SELECT DISTINCT s.doc_id, s.i + k AS p FROM s JOIN f USING (g), generate_series(0, 12) AS t(k) WHERE f.first < s.doc_id),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
k AS (SELECT p.doc_id, count(*) AS n, count(hit.p) AS gone,
             coalesce(string_agg(p.word, ' ' ORDER BY p.p) FILTER (WHERE hit.p IS NULL), '') AS kept
      FROM p LEFT JOIN hit ON hit.doc_id = p.doc_id AND hit.p = p.p GROUP BY p.doc_id)
SELECT w.doc_id, coalesce(k.n, 0) AS n_words, coalesce(k.gone, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
""".replace("__WORDS__", WORDS)

QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text, __WORDS__ AS w,
                  string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 0))) AS i FROM d)),
dup AS (SELECT doc_id, unnest(list(i)) AS i FROM g GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM dup, generate_series(0, 4) AS t(k) GROUP BY doc_id),
l AS (SELECT doc_id, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
             regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS n
      FROM (SELECT doc_id, host, unnest(lines) AS line FROM d)),
full_lines AS (SELECT * FROM l WHERE words > 0),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT doc_id) AS host_docs FROM d GROUP BY host),
freq AS (SELECT f.host, f.n, min(f.doc_id) AS first FROM full_lines f GROUP BY f.host, f.n
         HAVING count(DISTINCT f.doc_id) > greatest(20, 0.005 * (SELECT host_docs FROM hosts h WHERE h.host = f.host))),
cut AS (SELECT x.doc_id, sum(x.words) AS n_cut FROM full_lines x JOIN freq ON freq.host = x.host AND freq.n = x.n
        WHERE x.doc_id > freq.first GROUP BY x.doc_id),
m AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_words,
             length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(d.text) - length(translate(d.text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             coalesce(dups.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rep.n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(cut.n_cut, 0)::BIGINT AS n_cut_words
      FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN cut USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_cut_words <= 0.7 * n_words AS kept, n_cut_words
FROM m
""".replace("__WORDS__", WORDS)

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
o AS (SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS before,
             length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS n
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n + CASE WHEN rn > 1 AND role = before THEN 10 ELSE 12 + length(role) + 1 + 11 END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""

MIX = r"""
WITH b AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, len(__WORDS__)::BIGINT AS size,
                  ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT k, sum(size)::DOUBLE AS n, 2 * sum(size)::DOUBLE AS cap,
             (CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w FROM b GROUP BY k),
r AS (SELECT *, (1.5 * sum(n) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
lv AS (SELECT arg_min(level, cap / w) AS level FROM r WHERE cap > level * w),
t AS (SELECT k, n, least(cap, coalesce((SELECT level FROM lv), 0) * w) AS target FROM s),
g AS (SELECT k, n, target, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS copies FROM t),
c AS (SELECT b.k, b.h, sum(b.size) AS v, sum(sum(b.size)) OVER (PARTITION BY b.k ORDER BY b.h) AS upto FROM b GROUP BY b.k, b.h),
e AS (SELECT c.k, arg_min(CASE WHEN (g.target - g.copies * g.n) - (c.upto - c.v) <= c.upto - (g.target - g.copies * g.n) THEN c.h ELSE c.h + 1 END, c.h) AS bound
      FROM c JOIN g USING (k) WHERE g.target - g.copies * g.n > 0 AND c.upto >= g.target - g.copies * g.n GROUP BY c.k)
SELECT b.doc_id, b.size, g.n::BIGINT AS source_size, g.target,
       (b.size * (g.copies + CASE WHEN b.h < coalesce(e.bound, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM b JOIN g USING (k) LEFT JOIN e USING (k)
""".replace("__WORDS__", WORDS)

URLS = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
x AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM u),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM x),
k AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
      WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain,
             string_split(host, '.')[-1] AS suffix FROM p LEFT JOIN k USING (page_id) GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT sum(bad) / sum(n) FROM d) AS prior FROM d GROUP BY suffix),
sr AS (SELECT 1 / least(greatest(coalesce((sum(n * (bad / n - prior) * (bad / n - prior)) - sum(prior * (1 - prior))) / nullif(sum((n - 1) * prior * (1 - prior)), 0), 0), 0.001::DOUBLE), 0.5::DOUBLE) - 1 AS k FROM s WHERE n > 0),
s2 AS (SELECT suffix, (k * prior + bad) / (k + n) AS mean FROM s, sr),
d2 AS (SELECT d.domain, d.n, d.bad, s2.mean AS prior FROM d JOIN s2 USING (suffix)),
dr AS (SELECT 1 / least(greatest(coalesce((sum(n * (bad / n - prior) * (bad / n - prior)) - sum(prior * (1 - prior))) / nullif(sum((n - 1) * prior * (1 - prior)), 0), 0), 0.001::DOUBLE), 0.5::DOUBLE) - 1 AS k FROM d2 WHERE n > 0),
d3 AS (SELECT domain, (k * prior + bad) / (k + n) AS mean FROM d2, dr),
h2 AS (SELECT h.host, h.n, h.bad, d3.mean AS prior FROM h JOIN d3 USING (domain)),
hr AS (SELECT 1 / least(greatest(coalesce((sum(n * (bad / n - prior) * (bad / n - prior)) - sum(prior * (1 - prior))) / nullif(sum((n - 1) * prior * (1 - prior)), 0), 0), 0.001::DOUBLE), 0.5::DOUBLE) - 1 AS k FROM h2 WHERE n > 0),
h3 AS (SELECT host, (k * prior + bad) / (k + n) AS mean, k + n AS weight FROM h2, hr),
r(action, rule, rh, rp) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
f AS (SELECT p.page_id, p.host, p.path, (SELECT arg_max(rule, length(rule)) FROM r
             WHERE (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)) AS rule FROM p)
SELECT f.page_id, f.host, f.path, f.rule,
       coalesce((SELECT action FROM r WHERE r.rule = f.rule),
                CASE WHEN mean - sqrt(mean * (1 - mean) / (weight + 1)) > 0.2 THEN 'block' ELSE 'allow' END) AS verdict
FROM f JOIN h3 USING (host)
"""


def _merkle(lang_levels: int = 8, top_levels: int = 3) -> str:
    """Trees of up to 8**lang_levels leaves a group and 8**top_levels groups,
    a level per pair of subqueries; a tree of one node stays as it is."""
    def field(c, text="text"):
        v = text if c == "text" else c
        return f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')"

    def leaf(text):
        return "sha256(" + " || ".join(field(c, text) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = ("list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),"
           " lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, o: xor(x >> 1, 3988292384 * (x & 1))))")
    parts = [f"""
d AS MATERIALIZED (SELECT *, {leaf('text')} AS leaf, coalesce(xor({crc}, 4294967295) % 3 = 0, false) AS bad,
  {leaf(lowered)} AS changed FROM documents),
n0 AS MATERIALIZED (SELECT lang AS g, row_number() OVER (PARTITION BY lang ORDER BY coalesce(doc_id, 9223372036854775807), leaf) - 1 AS pos,
  leaf AS h, count(*) OVER (PARTITION BY lang) AS n, doc_id, bad, changed FROM d),
p0 AS MATERIALIZED (SELECT doc_id, g, pos AS leaf_pos, pos, h AS leaf, '' AS proof, CASE WHEN bad THEN changed ELSE h END AS fold FROM n0)"""]

    def level(i, j, group):
        """Nodes n(i) to n(j) and paths p(i) to p(j)."""
        runs = f"r{i}"
        keep = f"""
{runs} AS MATERIALIZED (SELECT g, pos // 8 AS up, max(n) AS n, list(h ORDER BY pos) AS hs FROM n{i} WHERE n > 1 GROUP BY g, pos // 8),
n{j} AS MATERIALIZED (SELECT g, up AS pos, sha256(array_to_string(hs, '')) AS h, (n + 7) // 8 AS n FROM {runs}
  UNION ALL SELECT g, pos, h, n FROM n{i} WHERE n = 1),
p{j} AS MATERIALIZED (SELECT p.* REPLACE (p.pos // 8 AS pos,
    CASE WHEN hs IS NULL THEN proof ELSE proof || array_to_string(hs[:p.pos % 8], '') || array_to_string(hs[p.pos % 8 + 2:], '') END AS proof,
    CASE WHEN hs IS NULL THEN fold ELSE sha256(array_to_string(hs[:p.pos % 8], '') || fold || array_to_string(hs[p.pos % 8 + 2:], '')) END AS fold)
  FROM p{i} p LEFT JOIN {runs} r ON r.{group} IS NOT DISTINCT FROM p.{group} AND r.up = p.pos // 8)"""
        parts.append(keep)

    for i in range(lang_levels):
        level(i, i + 1, "g")
    a, b = lang_levels, lang_levels + 1
    parts.append(f"""
s AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY g IS NOT NULL, encode(g)) - 1 AS pos, count(*) OVER () AS n FROM n{a}),
n{b} AS MATERIALIZED (SELECT 0 AS g, pos, h, n FROM s),
p{b} AS MATERIALIZED (SELECT p.* REPLACE (s.pos AS pos, 0 AS g), s.h AS subroot FROM p{a} p JOIN s ON s.g IS NOT DISTINCT FROM p.g)""")
    for i in range(b, b + top_levels):
        level(i, i + 1, "g")
    end = b + top_levels
    return "WITH" + ",".join(parts) + f"""
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.h AS verified
FROM p{end} p CROSS JOIN n{end} t"""


MERKLE = _merkle()

LEAKS = r"""
WITH iw AS (SELECT item_id, __W__ AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS g
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, least(len(w), 1)))) AS i FROM iw)),
dw AS (SELECT row_number() OVER () AS r, doc_id, __W__ AS w FROM documents),
s AS (SELECT r, i, k, list_slice(w, i, i + k - 1) AS g
      FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, (SELECT DISTINCT len(g) AS k FROM win))),
hit AS MATERIALIZED (SELECT r, i, k, item_id FROM s JOIN win USING (g)),
n AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT r, i, unnest(generate_series(0, k - 1)) AS j FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h
       FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (r) LEFT JOIN it USING (r)
""".replace("__W__", r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


def _centroids(rounds: int = 3) -> str:
    parts = [r"""
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS a FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), a) - 1 AS k, a FROM v QUALIFY k < 16)"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (SELECT r, vec_id, v.a, k, list_sum(list_transform(list_zip(v.a, c.a), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM v, c{i} c QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if i < rounds:
            parts.append(f"""
m{i} AS (SELECT k, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(a) AS x, generate_subscripts(a, 1) AS j FROM a{i}) GROUP BY k, j),
c{i + 1} AS MATERIALIZED (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS a FROM m{i} GROUP BY k
  UNION ALL SELECT k, a FROM c{i} WHERE k NOT IN (SELECT k FROM m{i}))""")
    return "WITH" + ",".join(parts) + f"""
SELECT vec_id, x.k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY x.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.a, ',')) AS centroid_sha256
FROM a{rounds} x JOIN c{rounds} c USING (k)"""


CENTROIDS = _centroids()

NEAREST = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

NEAR = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
r AS MATERIALIZED (SELECT w, min(doc_id) AS root, row_number() OVER () AS r FROM w WHERE len(w) > 0 GROUP BY w),
s AS MATERIALIZED (SELECT DISTINCT r, list_slice(w, i, i + 4) AS g
  FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM r)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
e AS MATERIALIZED (SELECT x, y FROM (SELECT a.r AS x, b.r AS y, count(*) AS m FROM s a JOIN s b USING (g) WHERE a.r <> b.r GROUP BY ALL)
  JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * m >= 75 * (p.n + q.n - m)),
reach AS (SELECT r AS x, r AS y FROM r UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
c AS (SELECT x AS r, min(root) AS component_id FROM reach JOIN r ON r.r = y GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id,
       w.doc_id = coalesce(c.component_id, w.doc_id) AS kept
FROM w LEFT JOIN r ON r.w = w.w LEFT JOIN n ON n.r = r.r LEFT JOIN c ON c.r = r.r
"""
