"""DuckDB statements for the corpus queries that SQL can express."""

from __future__ import annotations

from orderpulse.llm import imatch, license_scan

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, shared.k IS NOT NULL AND doc_id <> holder AS gone
  FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


TOP_K = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


FILL_MIDDLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM documents),
drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (len(u) + 1) AS h1,
         CAST('0x' || substr(d, 9, 8) AS BIGINT) % (len(u) + 1) AS h2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
              WHEN CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
cut AS (
  SELECT *, array_to_string(u[1:least(h1, h2)], '') AS p, array_to_string(u[least(h1, h2) + 1:greatest(h1, h2)], '') AS m,
         array_to_string(u[greatest(h1, h2) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""


# crc32() is the CRC-32 of a decimal number, bit by bit over its digits
PREFIX_TRIE = r"""
WITH own AS (
  SELECT conv_id, list({'u': md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')),
                        'l': length(coalesce(text, ''))}
                       ORDER BY turn NULLS FIRST,
                                md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')))
         AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT conv_id, ts, xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])),
                                    lambda x, i: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))),
         CAST(4294967295 AS BIGINT)) % 6 AS h
  FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.ts, [])[1:c.h], c.ts[c.h + 1:]) AS ts
  FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
prefixes AS (
  SELECT conv_id AS c, d, len(ts) AS n, ts[d]['l'] AS l, md5(array_to_string(list_transform(ts[1:d], lambda t: t['u']), '')) AS k,
         CASE WHEN d > 0 THEN md5(array_to_string(list_transform(ts[1:d - 1], lambda t: t['u']), '')) END AS pk
  FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT k, d, any_value(pk) AS pk, min(c) AS conv_id, count(*) AS n_convs, any_value(coalesce(l, 0)) AS l,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY k, d),
counted AS (
  SELECT x.*, coalesce(y.n, 0) AS n_children FROM nodes x LEFT JOIN (SELECT pk, count(*) AS n FROM nodes GROUP BY pk) y ON x.k = y.pk),
below AS (
  SELECT a.k, sum(CAST(x.n_children = 0 AS INTEGER)) AS n_leaves, sum((x.n_convs - 1) * x.l) AS saved
  FROM counted x JOIN prefixes a ON a.c = x.conv_id AND a.d <= x.d GROUP BY a.k)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM counted x JOIN below b ON x.k = b.k LEFT JOIN nodes p ON x.pk = p.k
"""


def license_sql(threshold: float = license_scan.THRESHOLD) -> str:
    known = ",\n".join(
        "({}, '{}', [{}])".format(i, name, ", ".join(f"'{g}'" for g in license_scan.template_bigrams(text)))
        for i, (name, text) in enumerate(license_scan.TEMPLATES))
    return rf"""
WITH templates(tid, license, grams) AS (VALUES {known}),
docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_split_to_array(coalesce(text, ''), '\n[ \t\r]*\n') AS ps
         FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS u FROM docs),
cut AS (SELECT doc_id, string_split(regexp_replace(u, '([.!?:;])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)) AS s FROM lines),
units AS (
  SELECT row_number() OVER () AS uid, doc_id, u FROM (
    SELECT doc_id, u FROM lines
    UNION ALL
    SELECT doc_id, unnest(s) FROM cut WHERE len(s) > 1
    UNION ALL
    SELECT doc_id, p FROM (SELECT doc_id, unnest(ps) AS p FROM docs) WHERE contains(p, chr(10))
    UNION ALL
    SELECT doc_id, text FROM docs WHERE len(ps) > 1)),
words AS (
  SELECT uid, doc_id, string_split(trim(regexp_replace(lower(u), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units),
grams AS (
  SELECT uid, doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM words WHERE len(w) > 1),
near AS (
  SELECT uid, doc_id, license, 2 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
  FROM grams JOIN templates ON 2 * least(len(g), len(grams)) >= {threshold} * (len(g) + len(grams)) - 0.001),
hits AS (
  SELECT uid, doc_id, max(dice) AS dice, arg_min(license, struct_pack(d := -dice, l := license)) AS license
  FROM near WHERE dice >= {threshold} GROUP BY uid, doc_id),
best AS (
  SELECT doc_id, count(*) AS n_hits, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
         max(dice) AS best_dice, arg_min(license, struct_pack(d := -dice, l := license)) AS best_license
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_hits, 0) AS n_hits, coalesce(licenses, '') AS licenses, best_license,
       coalesce(best_dice, 0.0) AS best_dice
FROM documents d LEFT JOIN best USING (doc_id)
"""


def fingerprint_sql(low: float = imatch.LOW, high: float = imatch.HIGH) -> str:
    draws, shifts = imatch.DRAWS, imatch.SHIFTS
    return rf"""
WITH ring AS (
  SELECT doc_id, coalesce(text, '') AS t,
         coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS nx
  FROM documents WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
texts AS (
  SELECT doc_id, 0 AS kind, t FROM ring
  UNION ALL
  SELECT doc_id, 1, left(t, length(t) - length(t) // 2) || left(nx, length(t) // 2) FROM ring),
words AS (
  SELECT doc_id, kind, t, unnest(list_distinct(string_split(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')))
         AS term FROM texts),
lexicon AS (
  SELECT term FROM words WHERE kind = 0 AND term <> '' GROUP BY term
  HAVING count(*) >= {low} * (SELECT count(*) FROM documents)
     AND count(*) <= greatest(1.0, {high} * (SELECT count(*) FROM documents))),
coded AS (
  SELECT term, r
  FROM (SELECT term, r, CAST('0x' || substr(md5((r // 10) || ' ' || term), 3 * (r % 10) + 1, 3) AS INTEGER) AS v
        FROM lexicon, (SELECT unnest(range(0, {draws})) AS r))
  WHERE v < 4096 >> list_extract({shifts}, CAST(r + 1 AS BIGINT))),
hashed AS (
  SELECT doc_id, kind, r, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 6) AS h
  FROM words JOIN coded USING (term) GROUP BY doc_id, kind, r),
drawn AS (SELECT DISTINCT doc_id, kind FROM hashed),
prints AS (
  SELECT x.doc_id, x.kind, x.t,
         list(CASE WHEN drawn.doc_id IS NULL THEN '=' || substr(sha256(x.t), 1, 6) ELSE coalesce(h, '-') END ORDER BY x.r) AS hs
  FROM (SELECT doc_id, kind, t, unnest(range(0, {draws})) AS r FROM texts) x
  LEFT JOIN hashed ON x.doc_id = hashed.doc_id AND x.kind = hashed.kind AND x.r = hashed.r
  LEFT JOIN drawn ON x.doc_id = drawn.doc_id AND x.kind = drawn.kind
  GROUP BY x.doc_id, x.kind, x.t),
beside AS (
  SELECT a.doc_id, length(a.t) AS n_chars, sha256(b.t) AS edited_sha256, array_to_string(a.hs, ',') AS fingerprint,
         array_to_string(b.hs, ',') AS edited_fingerprint,
         a.hs AS ha, b.hs AS hb, coalesce(lead(a.hs) OVER w, first_value(a.hs) OVER w) AS hn
  FROM prints a JOIN prints b ON a.doc_id = b.doc_id AND a.kind = 0 AND b.kind = 1
  WINDOW w AS (ORDER BY a.doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       len(list_filter(range(1, {draws} + 1), lambda i: ha[i] = hb[i] AND ha[i] <> '-'))
         / CAST(len(list_filter(range(1, {draws} + 1), lambda i: ha[i] <> '-' OR hb[i] <> '-')) AS DOUBLE) AS near_edited,
       len(list_filter(range(1, {draws} + 1), lambda i: ha[i] = hn[i] AND ha[i] <> '-'))
         / CAST(len(list_filter(range(1, {draws} + 1), lambda i: ha[i] <> '-' OR hn[i] <> '-')) AS DOUBLE) AS near_next
FROM beside
"""


def all_sql() -> dict[str, str]:
    return {
        "op4_fingerprints": fingerprint_sql(),
        "op5_top_k": TOP_K,
        "op6_license_scan": license_sql(),
        "op10_line_dedup": LINE_DEDUP,
        "op12_prefix_trie": PREFIX_TRIE,
        "op13_fill_middle": FILL_MIDDLE,
    }
