"""SQL over the same tables for the queries whose whole result SQL can express."""

from __future__ import annotations

_FOLD = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = "regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACE = "regexp_extract_all(" + _FOLD + r", '[^\x20\x09-\x0D]+')"

# texts as two hex digits a byte, so that strings of bytes can be cut
_OP1 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, k, md5(substr(h, 2 * k + 1, 200)) AS s
  FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 AS BIGINT) - 99)) AS k FROM d)
), c AS (
  SELECT doc_id, k FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, k) > 1
), i AS (
  SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 100 THEN 0 ELSE 1 END AS new FROM c
), g AS (
  SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS n FROM i
), spans AS (
  SELECT doc_id, n, min(k) AS a, max(k) + 100 AS b FROM g GROUP BY doc_id, n
), cuts AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM spans
), kept AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(d.h, CAST(2 * z + 1 AS BIGINT), CAST(2 * (a - z) AS BIGINT)), '' ORDER BY a) AS front
  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP4 = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum([q.e[k] * c.e[k] FOR k IN range(1, len(q.e) + 1)]), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP9 = f"""
WITH b AS (
  SELECT item_id, {_ALNUM.format("text")} AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, {_ALNUM.format("text")} AS w FROM documents
), hits AS (
  SELECT x.doc_id, x.k, x.n, bw.item_id
  FROM (
    SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS phrase
    FROM (
      SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
      FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n
    )
  ) x JOIN bw ON bw.n = x.n AND bw.phrase = x.phrase
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP10 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_SPACE.format("text")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN array_to_string(w, ' ') ELSE w[k] || ' ' || w[k + 1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS k FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach(u, v) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v
), c AS (
  SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

def _matches(kind: str, rank: int, pattern: str, ok: str) -> str:
    """Places of a pattern's matches that are valid: what is split off before each match tells where it begins."""
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS o, s, s + length(m) AS e FROM (
      SELECT doc_id, hits[i] AS m, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
      FROM (SELECT doc_id, hits, parts, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS parts FROM d))) WHERE {ok}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST({_DIGITS}[-j] AS INTEGER) WHEN CAST({_DIGITS}[-j] AS INTEGER) > 4 THEN CAST({_DIGITS}[-j] AS INTEGER) * 2 - 9 ELSE CAST({_DIGITS}[-j] AS INTEGER) * 2 END)) % 10 = 0"
_BYTE = "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(nullif(ltrim(x, '0'), '') AS INTEGER), 0) > 255)) = 0"
_PII = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  {_matches("email", 1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")}
  UNION ALL {_matches("ip", 2, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", _BYTE)}
  UNION ALL {_matches("card", 3, r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}")}
  UNION ALL {_matches("phone", 4, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15")}
)
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s), '')) AS base_sha256
FROM d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id
"""

_LICENCE = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format("text")} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS k FROM d),
q AS (SELECT doc_id, k, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
h AS (SELECT doc_id, k, CASE WHEN x = 'mit' AND y = 'license' THEN 'mit' WHEN x = 'apache' AND y = 'license' THEN 'apache' WHEN x = 'general' AND y = 'public' AND z = 'license' THEN 'gpl' END AS label FROM q)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, count(label) AS n_base, min(k) FILTER (label IS NOT NULL) AS first_word, max(k) FILTER (label IS NOT NULL) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN h ON h.doc_id = d.doc_id AND label IS NOT NULL GROUP BY d.doc_id, d.w
"""

#: The checksum of a text, bit by bit: its bytes, each with eight steps after it.
_CRC = "xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [ord(x), -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
_LM = f"""
WITH d AS (SELECT doc_id, {_CRC} % 5 = 1 AS held_out, {_SPACE.format("text")} || [''] AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS x FROM d),
c AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY x),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 4) AS base_score
FROM t LEFT JOIN c USING (x), n GROUP BY doc_id, held_out
"""

# the schedule slot by slot: of the released blocks the one with the earliest deadline; a source that ends begins a phase
_OP3 = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS s,
         row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY substr(md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(source, ''))), 1, 16)) - 1 AS r FROM documents
), b AS (
  SELECT s, (max(r) + 16) // 16 AS n, CAST(CASE s WHEN 'src0' THEN 4 WHEN 'src1' THEN 2 WHEN 'src2' THEN 2 ELSE 1 END AS BIGINT) AS w FROM d GROUP BY s
), run AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS start, list({'s': s, 'w': w, 'n': n, 'k': CAST(0 AS BIGINT), 'done': CAST(0 AS BIGINT)} ORDER BY s) AS st, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS BIGINT) AS block, CAST(NULL AS BIGINT) AS rel, CAST(NULL AS BIGINT) AS due FROM b
  UNION ALL
  SELECT t, CASE WHEN p.n = 1 THEN t + 1 ELSE start END,
         CASE WHEN p.n = 1 THEN list_transform(list_filter(st, lambda x: x.s <> p.s), lambda x: {'s': x.s, 'w': x.w, 'n': x.n, 'k': CAST(0 AS BIGINT), 'done': x.done})
              ELSE list_transform(st, lambda x: CASE WHEN x.s = p.s THEN {'s': x.s, 'w': x.w, 'n': x.n - 1, 'k': x.k + 1, 'done': x.done + 1} ELSE x END) END,
         p.s, p.done, start + p.k * total // p.w, start + ((p.k + 1) * total + p.w - 1) // p.w
  FROM (
    SELECT t, start, st, total, list_filter(st, lambda x: x.s = best.s)[1] AS p
    FROM (
      SELECT t + 1 AS t, start, st, total,
             list_sort(list_transform(list_filter(st, lambda x: x.k * total // x.w <= t + 1 - start), lambda x: {'d': ((x.k + 1) * total + x.w - 1) // x.w, 's': x.s}))[1] AS best
      FROM (SELECT t, start, st, CAST(list_sum(list_transform(st, lambda x: x.w)) AS BIGINT) AS total FROM run WHERE len(st) > 0)
    )
  )
)
SELECT d.doc_id, d.source, r // 16 AS mix_block, t AS mix_slot, rel AS mix_release, due AS mix_due FROM d JOIN run ON run.s = d.s AND run.block = r // 16
"""

# 64-bit counts times each other need 128 bits
_OP11 = r"""
WITH p AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, regexp_extract_all(s, '[^\x20\x09]+') AS w
  FROM (SELECT doc_id, lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents)
), t AS (
  SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang
), o AS (
  SELECT lang, size, array_to_string(w[k : k + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size)
), f AS (
  SELECT lang, size, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM o GROUP BY lang, size, phrase HAVING count(*) >= 100
), c AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1 : k], ' ') AS lp, array_to_string(w[k + 1 :], ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1)
), s AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST(t.n AS BIGINT) AS n,
         CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = lp JOIN f y ON y.lang = c.lang AND y.phrase = rp JOIN t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1
), h AS (
  SELECT lang, phrase, max(f) AS longer
  FROM (SELECT lang, f, array_to_string(w[i : i + m - 1], ' ') AS phrase
        FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM f WHERE size > 2)))
  GROUP BY lang, phrase
), k AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(s.phrase)) AS rank
  FROM s LEFT JOIN h ON h.lang = s.lang AND h.phrase = s.phrase WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM k WHERE rank <= 2000
"""

# crc32 of bytes, eight shifts each: a half byte at a time with a table of the sixteen remainders
_GRAM_CRC = """xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda b: CAST('0x' || b AS BIGINT)),
  lambda c, e: xor(xor(xor(c, e) >> 4, tab[1 + (xor(c, e) & 15)]) >> 4, tab[1 + (xor(xor(c, e) >> 4, tab[1 + (xor(c, e) & 15)]) & 15)])), 4294967295)"""
_OP13 = f"""
WITH r AS (
  SELECT list(CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END ORDER BY i) AS tab FROM (
    SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM (
      SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM (
        SELECT i, CASE WHEN i & 1 = 1 THEN xor(i >> 1, 3988292384) ELSE i >> 1 END AS v FROM range(16) g(i))))
), d AS (
  SELECT row_number() OVER () AS num, doc_id, 'd' AS side, {_ALNUM.format("text")} AS w FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, 'b', {_ALNUM.format("text")} FROM benchmark
), g AS (
  SELECT num, side, array_to_string(w[k : k + size - 1], ' ') AS x
  FROM (SELECT num, side, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size)
), c AS (
  SELECT num, side, x, count(*) AS n FROM g GROUP BY num, side, x
), x AS (
  SELECT x, CAST({_GRAM_CRC} % 10000 AS BIGINT) AS bucket, s, t
  FROM (SELECT x, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM c GROUP BY x), r
), b AS (
  SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM x GROUP BY bucket
), z AS (
  SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM b
), e AS (
  SELECT bucket, CAST(floor(1000 * ln((b.t + 1) * (z.s + 10000) / ((b.s + 1) * (z.t + 10000)))) AS BIGINT) AS gain FROM b, z
), m AS (
  SELECT num, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM c JOIN x USING (x) JOIN e USING (bucket) WHERE side = 'd' GROUP BY num
), o AS (
  SELECT num, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         CAST('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h
  FROM d LEFT JOIN m USING (num) WHERE side = 'd'
), q AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM o
), k AS (
  SELECT num, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM q WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM k) * 5 // 100 THEN rank END AS rank FROM q LEFT JOIN k USING (num)
"""

SQL = {
    "op11_collocations": _OP11,
    "op13_resample": _OP13,
    "op1_repeated_substrings": _OP1,
    "op3_mix": _OP3,
    "op4_top_k": _OP4,
    "op9_decontaminate": _OP9,
    "op10_near_duplicates": _OP10,
    "pii_base": _PII,
    "licence_base": _LICENCE,
    "lm_base": _LM,
}
