"""DuckDB SQL for the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Every pair that shares a shingle, then all that is reachable over links.
NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::varchar[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT doc_id, n::bigint AS n_shingles, component_id FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""

_BASE32 = " || ".join(f"substr('{LOWER.upper()}234567', 1 + ((('0x' || substr(h, {5 * i + 1}, 5))::int >> {shift}) & 31), 1)" for i in range(8) for shift in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, payload_bytes, max(page_id) AS last FROM p GROUP BY h, payload_bytes)
SELECT page_id, payload_bytes::bigint AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN page_id < last THEN last END AS refers_to FROM p JOIN m USING (h, payload_bytes)
"""

#: Every window of 50 bytes with the smallest document that holds it; islands of covered windows.
SUBSTRINGS = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
ws AS (SELECT doc_id, list_transform(range(0, greatest(length(h) // 2 - 49, 0)), lambda i: substr(h, 2 * i + 1, 100)) AS ws FROM h),
w AS (SELECT doc_id, unnest(ws) AS s, generate_subscripts(ws, 1) - 1 AS i FROM ws),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT w.doc_id, w.i FROM w JOIN m USING (s) WHERE w.doc_id > least),
f AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh FROM c),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f),
v AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, k),
q AS (SELECT v.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY v.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY v.doc_id ORDER BY a), 0))) AS piece FROM v JOIN h ON h.doc_id = v.doc_id),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY a) AS pieces, max(b) AS b FROM q GROUP BY doc_id)
SELECT h.doc_id, (length(h) // 2)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
sha256(unhex(coalesce(pieces || substr(h, 2 * t.b + 1), h))) AS kept_sha256 FROM h LEFT JOIN t ON t.doc_id = h.doc_id
"""

# ---- the parts of trained or random queries that SQL can express


def _crc32(numbers: str) -> str:
    """CRC-32 of a list of byte values, bit by bit."""
    step = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::bigint) ELSE a >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {numbers}), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, z: {step})), 4294967295::bigint)"


LANGID_SPLIT = f"""
SELECT doc_id, {_crc32("list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)")} % 5 = 0 AS held_out,
NOT regexp_matches(coalesce(text, ''), '\\p{{L}}') AS unknown FROM documents
"""

#: The base patterns as the contract has them, by kind.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_HITS = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{name}' AS kind, regexp_extract_all(t, '{p}') AS hits, regexp_split_to_array(t, '{p}') AS pieces FROM d" for k, (name, p) in enumerate(PATTERNS.items()))

#: A match begins behind all pieces and matches before it.
PII_BASE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_HITS}),
e AS (SELECT doc_id, k, kind, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{'hit': hits[i], 'at': list_sum(list_transform(pieces[1:i], lambda p: length(p)))
  + coalesce(list_sum(list_transform(hits[1:i - 1], lambda p: length(p))), 0)}})) AS h FROM m),
g AS (SELECT doc_id, k, kind, h.hit AS hit, h.at::bigint AS a, h.at::bigint + length(h.hit) AS b, regexp_replace(h.hit, '[^0-9]', '', 'g') AS g FROM e),
v AS (SELECT * FROM g WHERE CASE kind WHEN 'email' THEN true WHEN 'phone' THEN length(g) BETWEEN 10 AND 15
  WHEN 'ip' THEN list_bool_and(list_transform(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) < 4 AND coalesce(try_cast(x AS hugeint) <= 255, false)))
  ELSE length(g) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse(g)[i]::int ELSE 2 * reverse(g)[i]::int - CASE WHEN reverse(g)[i]::int > 4 THEN 9 ELSE 0 END END)) % 10 = 0 END)
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{name}') AS n_{name}" for name in PATTERNS)},
sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k), '')) AS base_sha256 FROM d LEFT JOIN v USING (doc_id) GROUP BY doc_id
"""

#: With the sources in the order in which they fill up, the share of a unit of weight is largest where just those are full that it passes.
MIXING_TARGETS = """
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
b AS (SELECT source, sum(size)::bigint AS source_size FROM s GROUP BY source),
w AS (SELECT source, source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::double AS w FROM b),
o AS (SELECT *, 1.5::double * sum(source_size) OVER () - coalesce(sum(2.0::double * source_size) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM w),
t AS (SELECT source, source_size, least(2.0::double * source_size, w * max(rest / ws) OVER ()) AS target FROM o)
SELECT doc_id, size::bigint AS size, source_size, round(target, 3) AS target FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
"""

MEDIA_PAYLOAD = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, length(h) // 2 AS n, h || repeat('FF', CASE WHEN h = '' THEN 576 ELSE (576 - length(h) // 2 % 576) % 576 END) AS p FROM h)
SELECT doc_id, n::bigint AS n_bytes, (length(p) // 2)::bigint AS payload_bytes, sha256(unhex(p)) AS payload_sha256,
{_crc32("list_transform(range(0, 32), lambda i: ('0x' || substr(right(p, 64), 2 * i + 1, 2))::bigint)")} AS tail_crc32 FROM p
"""

BPE_ROUND_TRIP = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"


def queries() -> dict[str, str]:
    whole = {"op3_ngram_join": NGRAM_JOIN, "op5_warc": WARC, "op8_substrings": SUBSTRINGS}
    return whole | {"langid_split": LANGID_SPLIT, "pii_base": PII_BASE, "mixing_targets": MIXING_TARGETS, "media_payload": MEDIA_PAYLOAD, "bpe_round_trip": BPE_ROUND_TRIP}
