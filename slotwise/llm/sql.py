"""SQL twins of the queries that SQL can express; they run on DuckDB."""

from __future__ import annotations

OP1 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept,
       text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ASC NULLS LAST)
"""


def _spans(kind: str, rank: int, pattern: str, group: int, keep: str) -> str:
    """Matches of one pattern with their starts: pieces between matches and matches, summed up."""
    return f"""
  SELECT id, text_key, owner, '{kind}' AS kind, {rank} AS rank, value,
         list_sum(list_transform(pieces[:i], lambda x: length(x)))::BIGINT
           + coalesce(list_sum(list_transform(founds[:i - 1], lambda x: length(x))), 0)::BIGINT AS s,
         length(founds[i]) AS n
  FROM (SELECT *, unnest(range(1, len(founds) + 1)) AS i, unnest(vals) AS value
        FROM (SELECT id, text_key, owner,
                     regexp_split_to_array(t, {pattern}) AS pieces,
                     regexp_extract_all(t, {pattern}, 0) AS founds,
                     regexp_extract_all(t, {pattern}, {group}) AS vals
              FROM d WHERE regexp_matches(t, {pattern})))
  WHERE {keep}"""


_ASSIGN = (
    r"""'(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
)

OP2 = rf"""
WITH d AS (
  SELECT doc_id AS id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS text_key, coalesce(source, '') AS owner
  FROM documents),
c AS ({_spans("assign", 1, _ASSIGN, 1, "length(value) >= 12")}
  UNION ALL {_spans("access", 2, "'AKIA[A-Z0-9]+'", 0, "length(value) >= 18")}
  UNION ALL {_spans("hex", 3, "'[0-9a-f]+'", 0, "length(value) >= 16")}
  UNION ALL {_spans("bare", 4, "'[A-Za-z0-9+/_-]{20,}'", 0,
    "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND NOT starts_with(value, 'AKIA')")}),
o AS (SELECT value, count(DISTINCT owner) AS owners FROM c GROUP BY value),
j AS (SELECT DISTINCT id, text_key, kind, rank, s, s + n AS e, owners < 3 AS live
      FROM c JOIN o USING (value) WHERE kind <> 'bare' OR owners < 3),
g AS (SELECT id, text_key,
             count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'bare') AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans,
             count(*) FILTER (live) AS n_live
      FROM j GROUP BY id, text_key)
SELECT d.id AS doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g ON g.id IS NOT DISTINCT FROM d.id AND g.text_key = d.text_key
"""

OP5 = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[position('://' IN url) + 3:] ELSE '' END AS rest
           FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
        list_filter(string_split(path, '/'), lambda x: x <> '') AS raw FROM h),
g AS (SELECT page_id, host, path, rule,
             CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled,
             list_transform(raw, lambda x: CASE
               WHEN regexp_full_match(x, '[0-9]+') THEN '{n}'
               WHEN regexp_full_match(x, '[0-9]+[.][A-Za-z0-9]+') THEN '{n}.' || regexp_extract(x, '[.]([A-Za-z0-9]+)$', 1)
               WHEN regexp_full_match(x, '[0-9a-fA-F-]{16,}') THEN '{hash}' ELSE x END) AS segments FROM r),
v AS (SELECT host, place, count(*) AS n, count(DISTINCT value) AS many
      FROM (SELECT host, unnest(segments) AS value, unnest(range(1, len(segments) + 1)) AS place
            FROM (SELECT DISTINCT host, path, segments FROM g))
      GROUP BY host, place),
w AS (SELECT host, list(place) AS wide FROM v WHERE many > 20 AND many * 2 > n GROUP BY host),
p AS (SELECT page_id, g.host, path, rule, ruled,
             CASE WHEN wide IS NULL THEN segments ELSE list_transform(segments, lambda x, i:
               CASE WHEN list_contains(wide, i) THEN '*' ELSE x END) END AS parts
      FROM g LEFT JOIN w ON w.host = g.host),
t AS (SELECT host, parts, count(*) FILTER (ruled = 'block') AS blocked, count(ruled) AS labelled FROM p GROUP BY host, parts),
c AS (SELECT host, parts, blocked, labelled, unnest(range(0, len(parts) + 1)) AS depth FROM t),
n AS (SELECT host, depth, parts[:depth] AS node, CASE WHEN depth > 0 THEN parts[:depth - 1] END AS parent,
             sum(blocked) AS blocked, sum(labelled) AS labelled FROM c GROUP BY ALL),
f AS (SELECT *, sum(blocked) OVER s / greatest(sum(labelled) OVER s, 1) AS share
      FROM n WINDOW s AS (PARTITION BY host, depth, parent)),
a AS (SELECT *, abs(blocked - labelled * share) <= 2.0 * sqrt(labelled * share * (1 - share)) + 0.5 AS alike FROM f),
m AS (SELECT *, CASE WHEN alike THEN sum(blocked) OVER s ELSE blocked END::DOUBLE AS b,
             CASE WHEN alike THEN sum(labelled) OVER s ELSE labelled END::DOUBLE AS k
      FROM a WINDOW s AS (PARTITION BY host, depth, parent, alike)),
o AS (SELECT coalesce(sum(blocked), 0) / greatest(coalesce(sum(labelled), 0), 1) AS overall FROM t),
q AS (SELECT parts, (sum(blocked) + 4.0 * any_value(overall)) / (sum(labelled) + 4.0) AS prior FROM t, o GROUP BY parts),
z AS (SELECT c.host, c.parts, list(struct_pack(b := m.b, k := m.k) ORDER BY c.depth) AS steps
      FROM c JOIN m ON m.host = c.host AND m.depth = c.depth AND m.node = c.parts[:c.depth] GROUP BY c.host, c.parts),
y AS (SELECT host, z.parts, round(list_reduce(list_prepend(struct_pack(b := prior::DOUBLE, k := 0.0::DOUBLE), steps),
             lambda x, s: struct_pack(b := (s.b + 4.0::DOUBLE * x.b) / (s.k + 4.0::DOUBLE), k := 0.0::DOUBLE)).b, 9) AS purity
      FROM z JOIN q ON q.parts = z.parts)
SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       array_to_string(p.parts, '/') AS template, purity
FROM p JOIN y ON y.host = p.host AND y.parts = p.parts
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '~') AS lang, coalesce(source, '~') AS source,
                  coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
e AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS place FROM w),
g AS (SELECT r, place, count(*) OVER (PARTITION BY r, five) AS times
      FROM (SELECT r, place, concat_ws(' ', word, lead(word) OVER s, lead(word, 2) OVER s, lead(word, 3) OVER s, lead(word, 4) OVER s) AS five,
                   lead(word, 4) OVER s IS NOT NULL AS whole FROM e WINDOW s AS (PARTITION BY r ORDER BY place)) WHERE whole),
c AS (SELECT r, count(DISTINCT place + k)::BIGINT AS n FROM g, range(5) AS s(k) WHERE times > 1 GROUP BY r),
b AS (SELECT w.r, doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM w LEFT JOIN c ON c.r = w.r),
m AS (SELECT *, unnest([{'s': 'word_length', 'v': word_chars * 1000 // n_words}, {'s': 'symbols', 'v': n_symbols * 1000 // n_words},
                        {'s': 'dup_lines', 'v': n_dup_lines * 1000 // n_lines}, {'s': 'repeats', 'v': n_repeat_words * 1000 // n_words}]) AS x
      FROM b WHERE n_words > 0),
k AS (SELECT lang, source, x.s AS signal, x.v AS v, greatest(length(bin(x.v)) - 7, 0) AS shift FROM m),
-- A value stands for its bucket: the middle of those that share its highest seven bits.
q AS (SELECT *, ((v >> shift) << shift) + ((1 << shift) >> 1) AS mid FROM k),
l AS (SELECT 'source' AS scope, lang, source, signal, mid FROM q
      UNION ALL SELECT 'language', lang, NULL, signal, mid FROM q
      UNION ALL SELECT 'corpus', NULL, NULL, signal, mid FROM q),
f AS (SELECT scope, lang, source, signal, count(*) AS n, quantile_disc(mid, 0.25) AS q1, quantile_disc(mid, 0.75) AS q3
      FROM l GROUP BY ALL),
h AS (SELECT *, greatest(3 * (q3 - q1), CASE signal WHEN 'word_length' THEN 3000 WHEN 'symbols' THEN 100
                                                    WHEN 'dup_lines' THEN 400 ELSE 200 END) AS reach FROM f),
z AS (SELECT scope, lang, source, any_value(n) AS n,
             max(q3 + reach) FILTER (signal = 'word_length') AS high_word, max(q1 - reach) FILTER (signal = 'word_length') AS low_word,
             max(q3 + reach) FILTER (signal = 'symbols') AS high_symbols, max(q3 + reach) FILTER (signal = 'dup_lines') AS high_dup,
             max(q3 + reach) FILTER (signal = 'repeats') AS high_repeats
      FROM h GROUP BY ALL),
o AS (SELECT a.lang, a.source, CASE WHEN a.n >= 200 THEN 'source' WHEN y.n >= 200 THEN 'language' ELSE 'corpus' END AS scope
      FROM z a JOIN z y ON y.scope = 'language' AND y.lang = a.lang WHERE a.scope = 'source'),
v AS (SELECT b.*, o.scope, concat_ws(',',
               CASE WHEN word_chars * 1000 // n_words NOT BETWEEN low_word AND high_word THEN 'word_length' END,
               CASE WHEN n_symbols * 1000 // n_words > high_symbols THEN 'symbols' END,
               CASE WHEN n_dup_lines * 1000 // n_lines > high_dup THEN 'dup_lines' END,
               CASE WHEN n_repeat_words * 1000 // n_words > high_repeats THEN 'repeats' END) AS reasons,
             n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
      FROM b LEFT JOIN o ON o.lang = b.lang AND o.source = b.source
      LEFT JOIN z ON z.scope = o.scope AND (z.lang = b.lang OR o.scope = 'corpus') AND (z.source = b.source OR o.scope <> 'source'))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND reasons = '' AS kept, reasons, scope
FROM v
"""

# crc32 of a short ASCII text, byte by byte and bit by bit.
_CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)),
    lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, b: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""

OP12 = rf"""
WITH RECURSIVE o AS (SELECT coalesce('=' || conv_id, '') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS t,
                            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
k AS (SELECT *, xor({_CRC32.format("name")}, 4294967295) % 20 AS kind FROM o),
d AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(t, '.!?', '') ELSE t END AS t,
             unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER w AS i,
             coalesce(lag(role[1]) OVER w || role[1] NOT IN ('su', 'ua', 'au'), false) AS odd,
             regexp_extract(t, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail
      FROM d WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(t))),
f AS (SELECT *, CASE WHEN tail = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, t ORDER BY i) > 1 THEN 'd' WHEN tail NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM n),
c AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
             count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (odd) AS illegal, count(*) AS n
      FROM f GROUP BY conv),
-- Rows inserted before a row: from a state (0 none, 1 system, 2 user, 3 assistant) to a state.
p(q, p, ins, added) AS (VALUES (0, 0, '', []), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']),
  (2, 3, 'I', ['assistant:']), (3, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])),
m AS (SELECT f.conv, f.i, p.q, 2 * len(ins) + cost AS cost, ins || edit AS edits, list_concat(added, line) AS lines, after
      FROM f, p, LATERAL (
        SELECT 'D' AS edit, 3 AS cost, p.p AS after, []::VARCHAR[] AS line
        UNION ALL SELECT 'K', (fault = 't')::INT, CASE role[1] WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, [role || ':' || t]
          WHERE fault NOT IN ('b', 'd') AND (role[1] = 's' AND p.p = 0 OR role[1] = 'u' AND p.p <> 2 OR role[1] = 'a' AND p.p = 2)
        UNION ALL SELECT 'R', 2 + (fault = 't')::INT, CASE WHEN p.p = 2 THEN 3 ELSE 2 END,
          [CASE WHEN p.p = 2 THEN 'assistant:' ELSE 'user:' END || t]
          WHERE fault NOT IN ('b', 'd'))),
r AS (SELECT conv, 0::BIGINT AS i, 0 AS q, {{'c': 0::BIGINT, 's': '', 'l': []::VARCHAR[]}} AS best FROM c
      UNION ALL
      SELECT conv, i, q, best FROM (
        SELECT m.conv, m.i, m.after AS q, min({{'c': best.c + m.cost, 's': best.s || m.edits, 'l': list_concat(best.l, m.lines)}}) AS best
        FROM r JOIN m ON m.conv = r.conv AND m.i = r.i + 1 AND m.q = r.q GROUP BY m.conv, m.i, m.after)),
z AS (SELECT r.conv, min(CASE q WHEN 1 THEN {{'c': best.c + 4, 's': best.s || 'II', 'l': list_concat(best.l, ['user:', 'assistant:'])}}
                                WHEN 2 THEN {{'c': best.c + 2, 's': best.s || 'I', 'l': list_concat(best.l, ['assistant:'])}}
                                ELSE best END) AS best
      FROM r JOIN c ON c.conv = r.conv AND c.n = r.i GROUP BY r.conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.s, '') AS audit,
       sha256(coalesce(array_to_string(best.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM o) o LEFT JOIN c ON c.conv = o.conv LEFT JOIN z ON z.conv = o.conv
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || h[1:8])::UINTEGER AS h1,
             ('0x' || h[9:16])::UINTEGER AS h2, ('0x' || h[17:24])::UINTEGER AS h3, ('0x' || h[25:32])::UINTEGER AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high FROM u),
p AS (SELECT *, array_to_string(units[:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
             array_to_string(units[high + 1:], '') AS suffix,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

SQL: dict[str, str] = {
    "op1_exact_dedup": OP1, "op2_secret_scan": OP2, "op5_url_templates": OP5, "op11_quality_rules": OP11,
    "op12_conversation_repair": OP12,
    "op13_fill_in_middle": OP13,
}
