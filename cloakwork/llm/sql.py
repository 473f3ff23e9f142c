"""What the queries return, as DuckDB SQL over whole tables, where SQL can say it.

Not here: learnt models (2, 8, 9), the tokenizer (4), linked parts (6) and templates (10);
tests/llm holds those against plain versions.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"
_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE r > 1),
kept AS (SELECT doc_id, p, word FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) ANTI JOIN gone USING (doc_id, p)),
t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ITEM_WORD}') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_ITEM_WORD}') AS ws FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT DISTINCT item, n, array_to_string(ws[j:j + n - 1], ' ') AS x FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS j FROM b WHERE len(ws) > 0)),
k AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(ws) >= n)),
h AS (SELECT k.doc_id, k.i, k.n, v.item FROM k JOIN v ON k.x = v.x AND k.n = v.n),
p AS (SELECT doc_id, count(DISTINCT q) AS c FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS ni, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(c, 0) AS n_hit, coalesce(ni, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(c, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, label) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, r.label FROM r JOIN e ON e.x = r.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(label, doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(label) AS label FROM r GROUP BY doc_id) USING (doc_id)"""


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in ("<|", "</s>", "<s>", "[INST]", "[/INST]"):
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


CHAT_FORMAT = f"""
WITH c AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, NULL, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length('<|im_start|>') + length(replace({_escaped("role")}, chr(10), '<\\;>')) + 1 + length({_escaped("text")}) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id, alone"""
