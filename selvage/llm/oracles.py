"""DuckDB twins of the training-data queries, where SQL can express them."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words: anything but a space, tab, line feed, vertical tab, form feed, carriage return.
_WORD = r"[^\x20\x09-\x0D]+"
_WORDS = f"regexp_extract_all(coalesce(text, ''), '{_WORD}')"
_LOWER_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}')"

ORACLES: dict[str, str] = {}

ORACLES["op2_ngram_jaccard"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
           FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM common WHERE 100 * c >= 80 * (nx + ny - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT min(y) FROM reach WHERE reach.x = s.doc_id) AS component_id FROM s
"""

ORACLES["op7_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 18, 1))) AS i, w FROM w),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM win),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM h) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM again) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN p IS NULL THEN w.w
              ELSE list_filter(w.w, lambda x, i: NOT list_contains(p, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""

ORACLES["op3_mixing"] = f"""
WITH q AS (SELECT doc_id, CASE WHEN min((coalesce(quality, 0) >= 1 AND coalesce(toxic, 0) < 1)::INT) = 1 THEN 2.0 ELSE 0.5 END AS quality
           FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, coalesce(quality, 1.0)::DOUBLE AS quality FROM documents LEFT JOIN q USING (doc_id)),
k AS (SELECT *, -ln((('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, 'mix')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / quality AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::DOUBLE AS cap,
             [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT *, least(cap, coalesce((SELECT min_by(level, cap / weight) FROM l WHERE level * weight <= cap), 0) * weight)::DOUBLE AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, epochs + (size > 0 AND 2 * before + size <= 2 * rest)::BIGINT AS repeats,
       (epochs + (size > 0 AND 2 * before + size <= 2 * rest)::BIGINT) * size AS taken FROM r
"""

ORACLES["op6_url_filter"] = f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
                  coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT page_id, max_by(struct_pack(rule := h || r.p, verdict := verdict), length(h || r.p)) AS m
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY page_id)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
"""

_CONTROL = r"<\|(?:turn|sep|end|im_start|im_end|endoftext)\|>|</?s>|<</?SYS>>|\[/?INST\]"
_ESCAPED = r"length({0}) + length({0}) - length(replace({0}, '\', '')) + 2 * len(regexp_extract_all({0}, '" + _CONTROL + "'))"

# the turns themselves, not what the template made of them; of the template only its size: 22 characters a turn, and the escapes
ORACLES["op8_chat_format"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(22 + {_ESCAPED.format('role')} + {_ESCAPED.format('text')})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
