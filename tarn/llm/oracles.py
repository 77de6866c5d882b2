"""SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
           FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# CRC-32 by its rule: one step for each byte, with a table of 256 entries made from the polynomial.
OP2 = """
WITH RECURSIVE t(i, c, k) AS (SELECT range::UINTEGER, range::UINTEGER, 0 FROM range(256) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS l FROM t WHERE k = 8),
bytes AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, hex(coalesce(text, '')) AS h FROM documents),
crc AS (SELECT doc_id, size,
  xor(4294967295::UINTEGER, list_reduce(list_prepend(4294967295::UINTEGER, list_transform(range(size - 1), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::UINTEGER)),
      lambda a, b: xor(a >> 8, l[(xor(a, b) & 255) + 1])))::BIGINT AS text_crc32 FROM bytes, tab),
cut AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM crc),
placed AS (SELECT *, least(15, ((2 * before + size) * 16) // (2 * total))::INTEGER AS shard FROM cut)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, NULL::INTEGER AS grown_shard FROM placed
"""

OP5 = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

ORACLE = {"op1_exact_topk": OP1, "op2_sharding": OP2, "op5_exact_dedup": OP5}
