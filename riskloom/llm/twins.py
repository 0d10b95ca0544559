"""DuckDB twins of the queries that SQL can express on whole tables."""

from __future__ import annotations

from riskloom.llm.manifest import SMALL, UPPER

#: CRC-32 of a decimal number, bit by bit (reflected polynomial 0xEDB88320).
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, strlen({x}) + 1), lambda i:
 list_transform(range(8), lambda b: (ascii(substr({x}, i, 1))::BIGINT >> b) & 1)))), lambda c, b: CASE WHEN (xor(c, b) & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""


def crc32(x: str) -> str:
    return CRC.format(x=f"({x})::VARCHAR")


def field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"


def leaf(text: str) -> str:
    return "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MANIFEST = f"""
WITH RECURSIVE tampered AS (SELECT *, CASE WHEN {crc32('doc_id')} % 5 = 0 THEN translate(text, '{UPPER}', '{SMALL}') ELSE text END AS other FROM documents),
leaves AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('other')} AS altered FROM tampered),
sources AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves GROUP BY source),
placed AS (SELECT l.*, s.n, s.tree, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS rid
 FROM leaves l JOIN sources s ON s.source IS NOT DISTINCT FROM l.source),
nodes AS (SELECT tree, 0 AS level, pos, leaf AS hash, n FROM placed
 UNION ALL SELECT * FROM (SELECT tree, level + 1, pos // 16, sha256(string_agg(hash, '' ORDER BY pos)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 16, n)),
subroots AS (SELECT tree, hash FROM nodes WHERE n = 1),
upper AS (SELECT 0 AS level, tree AS pos, hash, (SELECT count(*) FROM sources) AS n FROM subroots
 UNION ALL SELECT * FROM (SELECT level + 1, pos // 16, sha256(string_agg(hash, '' ORDER BY pos)), (n + 15) // 16 FROM upper WHERE n > 1 GROUP BY level, pos // 16, n)),
runs AS (SELECT tree, level, pos // 16 AS run, list(hash ORDER BY pos) AS h FROM nodes WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT level, pos // 16 AS run, list(hash ORDER BY pos) AS h FROM upper WHERE n > 1 GROUP BY ALL),
way AS (SELECT rid, level AS step, (pos >> (4 * level)) % 16 AS i, h FROM placed p JOIN runs r ON r.tree = p.tree AND r.run = p.pos >> (4 * level + 4)
 UNION ALL SELECT rid, 100 + level, (tree >> (4 * level)) % 16, h FROM placed p JOIN upper_runs r ON r.run = p.tree >> (4 * level + 4)),
steps AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY step) AS s, array_to_string(h[1:i], '') AS before, array_to_string(h[i+2:], '') AS after FROM way),
proofs AS (SELECT rid, string_agg(before || after, '' ORDER BY s) AS proof FROM steps GROUP BY rid),
fold AS (SELECT rid, 0::BIGINT AS s, altered AS acc FROM placed UNION ALL SELECT f.rid, x.s, sha256(before || acc || after) FROM fold f JOIN steps x ON x.rid = f.rid AND x.s = f.s + 1),
folded AS (SELECT rid, arg_max(acc, s) AS folded_root FROM fold GROUP BY rid)
SELECT doc_id, leaf, u.hash AS subroot, r.hash AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = r.hash AS verified
FROM placed p JOIN subroots u ON u.tree = p.tree CROSS JOIN (SELECT hash FROM upper WHERE n = 1) r JOIN folded f ON f.rid = p.rid LEFT JOIN proofs x ON x.rid = p.rid
"""

RUNS = f"""
WITH split AS (SELECT doc_id, row_number() OVER () AS rid, {crc32('doc_id')} AS h, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
drawn AS (SELECT *, len(w) AS n, h // 10 AS g FROM split),
bounds AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM drawn),
planted AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM bounds),
words AS (SELECT rid, n, unnest(w) AS word, unnest(range(n)) AS i FROM planted),
same AS (SELECT a.rid, b.i - a.i AS period, a.i, a.i - row_number() OVER (PARTITION BY a.rid, b.i - a.i ORDER BY a.i) AS island
 FROM words a JOIN words b ON b.rid = a.rid AND b.word = a.word AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
stretches AS (SELECT rid, period, min(i) AS start, count(*) + period AS length FROM same GROUP BY rid, period, island HAVING count(*) + period >= greatest(24, 3 * period)),
runs AS (SELECT * FROM stretches s WHERE NOT EXISTS (SELECT 1 FROM stretches t WHERE t.rid = s.rid AND t.period < s.period AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
 first(start ORDER BY length / period::DOUBLE DESC, start, period) AS start, first(length ORDER BY length / period::DOUBLE DESC, start, period) AS length,
 first(period ORDER BY length / period::DOUBLE DESC, start, period) AS period FROM runs GROUP BY rid),
dropped AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN dropped USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM planted LEFT JOIN listed USING (rid) LEFT JOIN kept USING (rid)
"""

REPEATS = """
WITH raw AS (SELECT doc_id, row_number() OVER () AS rid, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT rid, i, md5(array_slice(b, i, i + 399)) AS h FROM (SELECT rid, b, unnest(range(1, octet_length(b) - 398)) AS i FROM raw)),
starts AS (SELECT rid, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM starts),
numbered AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS span FROM marked),
spans AS (SELECT rid, min(i) AS start, max(i) + 400 AS stop FROM numbered GROUP BY rid, span),
gaps AS (SELECT rid, coalesce(lag(stop) OVER w, 1) AS a, start AS b FROM spans WINDOW w AS (PARTITION BY rid ORDER BY start)
 UNION ALL SELECT rid, max(stop), NULL FROM spans GROUP BY rid),
kept AS (SELECT rid, string_agg(hex(array_slice(raw.b, g.a, coalesce(g.b - 1, octet_length(raw.b)))), '' ORDER BY g.a) AS k FROM gaps g JOIN raw USING (rid) GROUP BY rid),
sums AS (SELECT rid, sum(stop - start)::BIGINT AS removed, count(*) AS n FROM spans GROUP BY rid)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(coalesce(unhex(k), b)) AS kept_sha256
FROM raw LEFT JOIN sums USING (rid) LEFT JOIN kept USING (rid)
"""

WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
LEAKS = f"""
WITH items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, row_number() OVER () AS rid, {WORDS} AS w FROM documents),
places AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM docs, (SELECT DISTINCT size FROM windows)),
found AS (SELECT rid, s, p.size, item_id FROM (SELECT rid, s, size, array_to_string(w[s:s + size - 1], ' ') AS win FROM places) p JOIN windows USING (size, win)),
hit AS (SELECT rid, count(DISTINCT word) AS n_hit FROM (SELECT rid, unnest(range(s, s + size)) AS word FROM found) GROUP BY rid),
listed AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM found) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN listed USING (rid)
"""

ORACLES = {"op1_decontamination": LEAKS, "op13_repeated_bytes": REPEATS, "op11_periodic_runs": RUNS, "op12_merkle_manifest": MANIFEST}
