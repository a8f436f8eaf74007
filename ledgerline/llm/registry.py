"""The queries of this subpackage and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

from ledgerline.llm.ann import op7_ann
from ledgerline.llm.chat import op3_chat_format
from ledgerline.llm.exact_copies import op13_exact_copies
from ledgerline.llm.html_text import op5_html_text
from ledgerline.llm.manifest import op11_manifest
from ledgerline.llm.mixing import op6_mixing
from ledgerline.llm.ngram_join import op10_ngram_join
from ledgerline.llm.packing import op4_packing
from ledgerline.llm.periodic import op12_periodic_runs
from ledgerline.llm.quality import op2_quality
from ledgerline.llm.token_counts import op9_token_counts
from ledgerline.llm.topk import op1_topk
from ledgerline.llm.warc import op8_warc

QUERIES = {f.__name__: f for f in (op1_topk, op2_quality, op3_chat_format, op4_packing, op5_html_text, op6_mixing, op7_ann, op8_warc, op9_token_counts, op10_ngram_join, op11_manifest, op12_periodic_runs, op13_exact_copies)}

#: crc32 of a column's decimal text, bit by bit, and the bytes of a manifest's leaf.
CRC32 = "xor(list_reduce(list_transform(string_split('~' || {0}::VARCHAR, ''), lambda x: CASE WHEN x = '~' THEN 4294967295::BIGINT ELSE ascii(x)::BIGINT END), lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: xor(a >> 1, (a & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


SQL = {
    "op1_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS t_chars,
    length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) AS r_chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(t_chars + r_chars + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
w AS (SELECT page_id, h, CAST(strlen(h) AS BIGINT) AS n, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM w""",
    "op11_manifest": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS t, {leaf('text')} AS leaf, CASE WHEN {CRC32.format('doc_id')} % 3 = 0 THEN {leaf(LOWERED)} ELSE {leaf('text')} END AS given FROM documents
), n AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
), lv AS (
  SELECT t, 0 AS l, pos AS p, leaf AS h, count(*) OVER (PARTITION BY t) AS n FROM n
  UNION ALL SELECT t, any_value(l) + 1, p >> 3, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 7) // 8 FROM lv WHERE n > 1 GROUP BY t, p >> 3
), sub AS (SELECT t, l AS height, h AS subroot, row_number() OVER (ORDER BY t) - 1 AS pos FROM lv WHERE n = 1
), top AS (
  SELECT 0 AS l, pos AS p, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL SELECT any_value(l) + 1, p >> 3, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY p >> 3
), runs AS (SELECT t, l, p >> 3 AS q, list(h ORDER BY p) AS run FROM lv WHERE n > 1 GROUP BY ALL
), toprun AS (SELECT l, p >> 3 AS q, list(h ORDER BY p) AS run FROM top WHERE n > 1 GROUP BY ALL
), steps AS (
  SELECT n.t, n.pos, r.l, (n.pos >> (3 * r.l)) & 7 AS i, run FROM n JOIN runs r ON r.t = n.t AND r.q = n.pos >> (3 * r.l + 3)
  UNION ALL SELECT n.t, n.pos, height + r.l, (sub.pos >> (3 * r.l)) & 7, run FROM n JOIN sub ON n.t = sub.t JOIN toprun r ON r.q = sub.pos >> (3 * r.l + 3)
), sides AS (SELECT t, pos, l, array_to_string(run[:i], '') AS before, array_to_string(run[i + 2:], '') AS after FROM steps
), proofs AS (SELECT t, pos, sha256(string_agg(before || after, '' ORDER BY l)) AS proof, count(*) AS m FROM sides GROUP BY t, pos
), fold AS (
  SELECT t, pos, 0 AS l, given AS h FROM n
  UNION ALL SELECT f.t, f.pos, f.l + 1, sha256(before || h || after) FROM fold f JOIN sides s ON s.t = f.t AND s.pos = f.pos AND s.l = f.l
), root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT n.doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
FROM n JOIN sub ON n.t = sub.t CROSS JOIN root LEFT JOIN proofs p ON p.t = n.t AND p.pos = n.pos JOIN fold ON fold.t = n.t AND fold.pos = n.pos AND fold.l = coalesce(m, 0)""",
    "op12_periodic_runs": rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w0, {CRC32.format('doc_id')} AS h FROM documents
), e AS (SELECT *, len(w0) AS n, CASE WHEN len(w0) > 0 AND h % 10 = 0 THEN (h // 10) % len(w0) END AS a, h // 10 % 8 AS g8 FROM d
), f AS (SELECT *, 1 + (n - a) // (3 + g8) AS p FROM e
), t AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w0 ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w0[i + 1] ELSE w0[a + (i - a) % p + 1] END) END AS w FROM f
), x AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM t
), g AS (SELECT doc_id, n, i, hash([word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o]) AS k FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), pairs AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.k = b.k AND a.i < b.i AND 4 * (b.i - a.i) <= a.n WHERE b.i + 5 <= b.n
), isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM pairs
), stretch AS (SELECT doc_id, min(i) AS s, max(i) + 5 + q AS e, min(q) AS q FROM isle GROUP BY doc_id, q, z
), runs AS (SELECT doc_id, s, e - s AS l, min(q) AS q FROM stretch GROUP BY doc_id, s, e HAVING e - s >= greatest(6, 4 * min(q))
), best AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, min(ROW(-(l::DECIMAL(38, 18) / q), s, q, l)) AS b FROM runs GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs
), text AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i GROUP BY x.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b[2] AS start, b[4] AS length, b[3] AS period, 1000 * b[4] // b[3] AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (doc_id) LEFT JOIN text USING (doc_id)""",
    "op13_exact_copies": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
