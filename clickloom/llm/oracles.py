"""DuckDB SQL for the queries that SQL can express over whole tables."""

_WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages
), g AS (
  SELECT page_id, octet_length(encode(h)) AS n, d,
         min(page_id) OVER (PARTITION BY d) AS first,
         array_to_string(list_transform(string_split(d, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT)
                  + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT)
                  + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM g
"""

_MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('6:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM d GROUP BY source
), w AS (
  SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS lim, 2.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM w
), c AS (
  SELECT *, ratio * (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            + coalesce(sum(lim) OVER (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= budget AS stops
  FROM r
), t AS (
  SELECT source, source_size, rnk, weight, budget,
         CASE WHEN stops THEN lim ELSE (budget - sum(CASE WHEN stops THEN lim ELSE 0 END) OVER ()) / sum(CASE WHEN stops THEN 0 ELSE weight END) OVER () * weight END AS target
  FROM c
), q AS (
  SELECT d.doc_id, d.h, d.size, t.source_size, t.target, t.rnk, t.weight, t.budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached,
         row_number() OVER () AS id
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT id, size, rnk, budget, CAST(reached + lap * source_size AS DOUBLE) / weight AS finish
  FROM q, (VALUES (0), (1)) AS laps(lap) WHERE size > 0
), o AS (
  SELECT id, size, sum(size) OVER (ORDER BY finish, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size < budget AS takes FROM u
), k AS (
  SELECT id, CAST(sum(CASE WHEN takes THEN size ELSE 0 END) AS BIGINT) AS taken FROM o GROUP BY id
)
SELECT q.doc_id, q.size, q.source_size, CAST(q.target AS DOUBLE) AS target, coalesce(k.taken, 0) AS taken FROM q LEFT JOIN k USING (id)
"""

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = r"regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LEAKS = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce({_TOKENS.format('text')}, []) AS w FROM documents
), i AS (
  SELECT item_id, w, least(10, len(w)) AS l FROM (SELECT item_id, {_TOKENS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item_id, l, array_to_string(w[p:p + l - 1], ' ') AS g FROM (SELECT item_id, l, w, unnest(range(1, len(w) - l + 2)) AS p FROM i)
), dw AS (
  SELECT id, l, p, array_to_string(w[p:p + l - 1], ' ') AS g
  FROM (SELECT id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM i) WHERE len(w) >= l)
), hits AS (
  SELECT id, p, l, item_id FROM dw JOIN iw USING (l, g)
), words AS (
  SELECT id, count(DISTINCT x) AS n_hit FROM (SELECT id, unnest(range(p, p + l)) AS x FROM hits) GROUP BY id
), items AS (
  SELECT id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (id) LEFT JOIN items USING (id)
"""

_ESCAPE = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"
_CHAT = f"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), r AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM c
), f AS (
  SELECT *, length({_ESCAPE.format('role')}) + length({_ESCAPE.format('text')}) + 14 AS n,
         row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id, alone) AS last
  FROM r
), e AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id, alone ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM f
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR k = last THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id, alone
"""



def _repair() -> str:
    """Each state of the pass is a string, its cost in eight digits before its audit, so that the least string is the best."""
    table = "range(256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda x: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    add = lambda e, cost, letter: f"(lpad(CAST(CAST(left({e}, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({e}, 9) || '{letter}')"
    kept = lambda e, of: f"CASE WHEN f IN ('-', 't') AND r = '{of}' THEN {add(e, 'm', 'K')} END"
    given = lambda e: f"CASE WHEN f IN ('-', 't') THEN {add(e, '3 + m', 'R')} END"
    u = ", ".join([add("v.u", 4, "D"), *(given(f"v.{x}") for x in "zsa"), *(kept(f"v.{x}", "u") for x in "zsa")])
    return f"""
WITH RECURSIVE tab AS (SELECT {table} AS t), base AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: ord(c)::BIGINT)),
           lambda a, b: xor(t[CAST((xor(a, b) & 255) + 1 AS INT)], a >> 8)), 4294967295) % 20 AS k
  FROM conversations, tab
), dmg AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM base WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, {white}) AS bare,
         CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS r
  FROM dmg
), rows AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) IN ('.', '!', '?') THEN '-' ELSE 't' END AS f,
         lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair
  FROM placed
), v AS (
  SELECT conv_id, 0::BIGINT AS i, '00000000' AS z, CAST(NULL AS VARCHAR) AS s, '00000003I' AS u, '00000006II' AS a FROM (SELECT DISTINCT conv_id FROM rows)
  UNION ALL
  SELECT conv_id, i, z, s, least(u, {add('a', 3, 'I')}) AS u, a FROM (
    SELECT conv_id, i, z, s, u, least(a, {add('u', 3, 'I')}) AS a FROM (
      SELECT conv_id, i, z, s, least(u, {add('z', 3, 'I')}, {add('s', 3, 'I')}) AS u, a FROM (
        SELECT v.conv_id, w.i, {add('v.z', 4, 'D')} AS z, least({add('v.s', 4, 'D')}, {kept('v.z', 's')}) AS s, least({u}) AS u,
               least({add('v.a', 4, 'D')}, {given('v.u')}, {kept('v.u', 'a')}) AS a
        FROM v JOIN (SELECT *, CASE WHEN f = 't' THEN 3 ELSE 0 END AS m FROM rows) w ON w.conv_id IS NOT DISTINCT FROM v.conv_id AND w.i = v.i + 1)))
), best AS (
  SELECT conv_id, arg_max(least(z, a), i) AS x FROM v GROUP BY conv_id
), edits AS (
  SELECT conv_id, p, substr(x, 8 + p, 1) AS e, length(replace(substr(x, 9, p), 'I', '')) AS i, length(replace(substr(x, 9, p), 'D', '')) AS place
  FROM (SELECT conv_id, x, unnest(range(1, length(x) - 7)) AS p FROM best)
), turns AS (
  SELECT edits.conv_id, p, place, e, rows.role, rows.r, CASE WHEN e = 'I' THEN '' ELSE rows.text END AS text
  FROM edits LEFT JOIN rows ON rows.conv_id IS NOT DISTINCT FROM edits.conv_id AND rows.i = edits.i WHERE e <> 'D'
), told AS (
  SELECT *, max(CASE WHEN place = 1 AND e = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led FROM turns
), shas AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS h FROM told GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(left(x, 8) AS BIGINT), 0) AS cost, coalesce(substr(x, 9), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id FROM conversations) o
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN shas ON shas.conv_id IS NOT DISTINCT FROM o.conv_id
"""


_JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all({_LOW.format('text')}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT id, count(*) AS n FROM s GROUP BY id
), met AS (
  SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM met JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
  SELECT id, id AS r FROM d UNION SELECT reach.id, b FROM reach JOIN links ON links.a = reach.r
), component AS (
  SELECT reach.id, min(doc_id) AS component_id FROM reach JOIN d ON d.id = reach.r GROUP BY reach.id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (id) JOIN component USING (id)
"""

ORACLES = {
    "op4_warc_zip": _WARC,
    "op6_mix_fair_queue": _MIX,
    "op7_decontaminate_winnowing": _LEAKS,
    "op8_chat_prefix_target": _CHAT,
    "op11_turn_repair_viterbi": _repair(),
    "op13_jaccard_parity_join": _JACCARD,
}
