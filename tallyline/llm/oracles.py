"""SQL twins of the queries that SQL can express over whole tables."""

from __future__ import annotations

from tallyline.llm.vector_codes import ENTRIES, PARTS, ROUNDS
from tallyline.llm.warc import BREAKING, DROPPED, ENTITIES as REFERENCES

_VECTORS = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
    SELECT * FROM v
    WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
          AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93
), reach AS (
    SELECT vec_id, vec_id AS other FROM v
    UNION
    SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), named AS (
    SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, n.component_id, v.vec_id = n.component_id AS kept
FROM v JOIN named n ON v.vec_id = n.vec_id
"""


def _escaped(column: str) -> str:
    """The template's escapes as plain replacements."""
    out = f"replace({column}, '\\', '\\\\')"
    for control in ("<|", "<s>", "</s>", "<SYS>>", "</SYS>>", "[INST]", "[/INST]"):
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


_CHAT = f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length({_escaped('role')}) + length({_escaped('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def _text_sql() -> str:
    """The text of a page by RE2's means: end tags that a head must not pass are marked instead of looked ahead for."""
    own_end = "|".join(rf"<{name}\b[^>]*>.*?(?:</{name}\b[^>]*>|\z)" for name in DROPPED.split("|"))
    kept = "|".join(rf"<{name}\b[^>]*>.*?</{name}\b[^>]*>" for name in ("title", "textarea"))
    rest = r"""(?:(?:[^>"'']|"[^"]*"|''[^'']*'')*>|[^>]*>)"""
    head = (
        rf"(?is)<head(?:>|[\s\x0B/]{rest})(?:[\s\x0B]+|<title\b[^>]*>.*?</title\b[^>]*>|<(?:meta|link|base|basefont|bgsound)\b{rest}"
        r"|<[!?][^>]*>|</[a-z][^>]*>)*(?:\x01head[^>]*>)?"
    )
    out = rf"regexp_replace(html, '(?is)({kept})|<!--(?:-?>|.*?(?:--!?>|\z))|{own_end}', '\1 ', 'g')"
    out = rf"regexp_replace({out}, '(?i)</(head|body|html|br)\b', chr(1) || '\1', 'g')"
    out = rf"replace(regexp_replace({out}, '{head}', ' ', 'g'), chr(1), '</')"
    out = rf"regexp_replace({out}, '[\r\n]+', ' ', 'g')"
    out = rf"regexp_replace({out}, '(?i)</?(?:{BREAKING})\b[^>]*>', chr(10), 'g')"
    out = rf"regexp_replace({out}, '<[A-Za-z/!?][^>]*>', '', 'g')"
    for name, ch in REFERENCES:
        quoted = ch.replace("'", "''")
        out = f"replace({out}, '{name}', '{quoted}')"
    out = rf"regexp_replace({out}, '[ \t\x0B\f\r]+', ' ', 'g')"
    out = rf"regexp_replace({out}, ' ?\n[ \n]*', chr(10), 'g')"
    return rf"regexp_replace({out}, '^[ \n]+|[ \n]+\z', '', 'g')"


def _uuid(text: str) -> str:
    d = f"sha256({text})"
    return f"'<urn:uuid:' || substr({d}, 1, 8) || '-' || substr({d}, 9, 4) || '-8' || substr({d}, 14, 3) || '-a' || substr({d}, 18, 3) || '-' || substr({d}, 21, 12) || '>'"


_WARC = f"""
WITH p AS (
    SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, chr(13) || chr(10) AS nl FROM pages
), r AS (
    SELECT *, {_uuid("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || url || '|' || html")} AS response_id,
           'sha256:' || sha256(html) AS source_digest, {_text_sql()} AS text,
           trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '[ \\t\\x0B\\f\\r\\n]+', ' ', 'g'), ' ') AS title,
           len(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref=')) AS outlinks
    FROM p
), d AS (
    SELECT *, {_uuid("'conversion|' || response_id")} AS conversion_id, {_uuid("'metadata|' || response_id")} AS metadata_id FROM r
), records AS (
    SELECT page_id, 'conversion' AS record_type, conversion_id AS record_id, response_id AS refers_to, url AS target_uri, source_digest, nl,
           'text/plain; charset=utf-8' AS content_type, text AS content
    FROM d
    UNION ALL
    SELECT page_id, 'metadata', metadata_id, response_id, url, source_digest, nl, 'application/warc-fields',
           'via: ' || response_id || nl || 'conversion: ' || conversion_id || nl || 'title: ' || title || nl || 'outlinks: ' || outlinks || nl
           || 'source-header: HTTP/1.1 200 OK' || nl || 'source-header: Content-Type: text/html; charset=utf-8' || nl
           || 'source-header: Content-Length: ' || strlen(html) || nl
    FROM d
)
SELECT page_id, record_type, record_id, refers_to, target_uri, source_digest,
       'sha256:' || sha256(content) AS block_digest, CAST(strlen(content) AS BIGINT) AS content_length,
       'WARC/1.1' || nl || 'WARC-Type: ' || record_type || nl || 'WARC-Record-ID: ' || record_id || nl || 'WARC-Refers-To: ' || refers_to || nl
       || 'WARC-Target-URI: ' || target_uri || nl || 'WARC-Date: 2024-01-01T00:00:00Z' || nl || 'WARC-Source-Payload-Digest: ' || source_digest || nl
       || 'WARC-Block-Digest: ' || 'sha256:' || sha256(content) || nl || 'Content-Type: ' || content_type || nl
       || 'Content-Length: ' || strlen(content) || nl || nl AS header,
       content
FROM records
"""

_EXACT = r"""
WITH t AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
    SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""


def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    """Lloyd's rounds with every part against every entry; distances are whole numbers below 2^53."""
    steps = [f"""
WITH v AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS MATERIALIZED (
    SELECT vec_id, part, list_slice(q, part * (len(q) // {parts}) + 1, (part + 1) * (len(q) // {parts})) AS c FROM v, range({parts}) t(part)
), book0 AS MATERIALIZED (
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, c FROM p
    QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries}
)"""]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
    SELECT p.vec_id, p.part, any_value(p.c) AS c,
           min({{'away': list_inner_product(p.c, p.c) - 2 * list_inner_product(p.c, b.c) + list_inner_product(b.c, b.c), 'entry': b.entry}}) AS best
    FROM p JOIN book{k} b USING (part) GROUP BY p.vec_id, p.part
)""")
        if k < rounds:
            steps.append(f"""moved{k} AS (
    SELECT part, entry, list(x ORDER BY i) AS c FROM (
        SELECT part, best.entry AS entry, i, floor(sum(c[i]) / count(*)) AS x FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM near{k}) GROUP BY ALL
    ) GROUP BY part, entry
), book{k + 1} AS MATERIALIZED (
    SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN moved{k} m USING (part, entry)
)""")
    return ",\n".join(steps) + f"""
, coded AS (
    SELECT vec_id, string_agg(printf('%02x', CAST(best.entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best.away) AS BIGINT) AS error
    FROM near{rounds} GROUP BY vec_id
), books AS (
    SELECT sha256(coalesce(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i), '')) AS codebooks_sha256
    FROM (SELECT part, entry, unnest(c) AS x, unnest(range(1, len(c) + 1)) AS i FROM book{rounds})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (vec_id), books
"""


# Conversations row by row: for every state the least (cost, audit) of what lies behind it.
_REPAIR = r"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), n)) AS t
), named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
    FROM conversations
), fated AS (
    SELECT named.*, xor(list_reduce(list_transform(range(1, len(name) + 1), lambda i: ord(name[i])),
        lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS BIGINT) + 1]), 4294967295), 4294967295) % 20 AS fate
    FROM named, crc
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM fated, range(2) c(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n FROM damaged
), met AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS seen FROM placed
), faults AS MATERIALIZED (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault,
           CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair
    FROM met
), step(role, p, q) AS (
    VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('a', 2, 3), ('u', 3, 2)
), inserted(p, q, cost, audit) AS (
    VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (2, 3, 5, 'I'), (3, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')
), kind AS (
    SELECT DISTINCT initial, fault FROM faults
), edit AS (
    SELECT initial, fault, p, q, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS cost, 'K' AS audit
    FROM kind JOIN step ON role = initial WHERE coalesce(fault, '') NOT IN ('blank', 'duplicate')
    UNION ALL
    SELECT initial, fault, p, q, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R'
    FROM kind, step WHERE role <> 's' AND coalesce(fault, '') NOT IN ('blank', 'duplicate')
    UNION ALL
    SELECT initial, fault, p, p, 2, 'D' FROM kind, range(4) s(p)
), move AS MATERIALIZED (
    SELECT initial, fault, i.p, e.q, min({'cost': i.cost + e.cost, 'audit': i.audit || e.audit}) AS best
    FROM inserted i JOIN edit e ON i.q = e.p GROUP BY ALL
), parsed AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS q, {'cost': 0, 'audit': ''} AS best FROM (SELECT DISTINCT conv_id FROM faults)
    UNION ALL
    SELECT r.conv_id, r.n, m.q, min({'cost': p.best.cost + m.best.cost, 'audit': p.best.audit || m.best.audit})
    FROM parsed p JOIN faults r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = p.n + 1
    JOIN move m ON m.initial = r.initial AND m.fault IS NOT DISTINCT FROM r.fault AND m.p = p.q
    GROUP BY r.conv_id, r.n, m.q
), told AS (
    SELECT conv_id, max(n) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (n > 1 AND coalesce(pair, '') NOT IN ('su', 'ua', 'au')) AS illegal,
           coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
    FROM faults GROUP BY conv_id
), ended AS MATERIALIZED (
    SELECT t.*, (SELECT min({'cost': p.best.cost + i.cost, 'audit': p.best.audit || i.audit}) FROM parsed p JOIN inserted i ON i.p = p.q
                 WHERE p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.n = t.n AND i.q IN (0, 3)) AS best
    FROM told t
), letters AS (
    SELECT conv_id, best.audit AS audit, i, best.audit[i] AS letter FROM ended, range(1, len(best.audit) + 1) s(i)
), counted AS (
    SELECT *, count(*) FILTER (letter <> 'I') OVER w AS n, count(*) FILTER (letter <> 'D') OVER w - len(replace(audit, 'D', '')) % 2 AS turns
    FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), lines AS (
    SELECT c.conv_id, c.i, CASE WHEN c.letter = 'K' THEN r.role WHEN c.turns % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
           || CASE WHEN c.letter = 'I' THEN '' ELSE r.text END AS line
    FROM counted c LEFT JOIN faults r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.n = c.n WHERE c.letter <> 'D'
), digests AS (
    SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY i)) AS digest FROM lines GROUP BY conv_id
)
SELECT k.conv_id, coalesce(e.gaps, 0) AS gaps, coalesce(e.blank, 0) AS blank, coalesce(e.duplicate, 0) AS duplicate, coalesce(e.truncated, 0) AS truncated,
       coalesce(e.illegal, 0) AS illegal, CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit,
       coalesce(d.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM k.conv_id
"""

LLM_ORACLES = {
    "op2_vector_dedup": _VECTORS,
    "op3_chat_format": _CHAT,
    "op10_warc_derivatives": _WARC,
    "op11_exact_dedup": _EXACT,
    "op12_conversation_repair": _REPAIR,
    "op13_vector_codes": _codes_sql(PARTS, ENTRIES, ROUNDS),
}
