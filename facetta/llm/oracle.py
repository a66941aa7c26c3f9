"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP3 = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)
), grams AS (
  SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT rid, s, grams.n, item FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g
), covered AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""

OP8 = """
WITH t AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, CASE WHEN conv_id % 2 = 1 THEN 'rejected' ELSE 'chosen' END AS side,
         turn, role, text, count(*) AS copies
  FROM conversations GROUP BY ALL
), alike AS (
  SELECT pair_id, turn,
         coalesce(list(row(role, text, copies) ORDER BY role, text) FILTER (side = 'chosen'), [])
           = coalesce(list(row(role, text, copies) ORDER BY role, text) FILTER (side = 'rejected'), []) AS same
  FROM t GROUP BY ALL
), ends AS (
  SELECT pair_id, min(turn) FILTER (NOT same) AS first FROM alike GROUP BY ALL
), counted AS (
  SELECT e.pair_id, e.first, count(*) FILTER (e.first IS NULL OR a.turn < e.first) AS prompt_turns
  FROM ends e JOIN alike a ON a.pair_id = e.pair_id GROUP BY ALL
), rows_ AS (
  SELECT t.pair_id, CASE WHEN first IS NULL OR turn < first THEN 'prompt' ELSE side END AS part, CAST(floor(coalesce(turn, 0) / 1000) AS BIGINT) AS stretch, turn, role, text,
         '<|im_start|>' || translate(replace(coalesce(role, ''), '<|im_', '<| im_'), chr(10) || chr(13), '  ') || chr(10) AS header,
         replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS body
  FROM t JOIN counted c ON c.pair_id = t.pair_id
  WHERE NOT (first IS NULL OR turn < first) OR side = 'chosen'
), placed AS (
  SELECT *, sum(length(header || body)) OVER (PARTITION BY pair_id, stretch, part ORDER BY turn, role, header || body) AS upto, part <> 'prompt' AND coalesce(role, '') = 'assistant' AS trained
  FROM rows_
), parts AS (
  SELECT pair_id, stretch, part, string_agg(header || body, '' ORDER BY turn, role, header || body) AS whole,
         string_agg(CAST(upto - length(body) AS VARCHAR) || ':' || CAST(upto AS VARCHAR), ',' ORDER BY upto) FILTER (trained) AS mask
  FROM placed GROUP BY ALL
)
SELECT pair_id, stretch, coalesce(max(whole) FILTER (part = 'prompt'), '') AS prompt, coalesce(max(whole) FILTER (part = 'chosen'), '') AS chosen,
       coalesce(max(whole) FILTER (part = 'rejected'), '') AS rejected, coalesce(max(mask) FILTER (part = 'chosen'), '') AS chosen_mask,
       coalesce(max(mask) FILTER (part = 'rejected'), '') AS rejected_mask
FROM parts GROUP BY pair_id, stretch
"""

def _whole(piece: str) -> str:
    """Bytes as hex digits without the parts of characters at either end."""
    open_ = r"^((?:..)*?)(?:[CD].|E.(?:..)?|F.(?:..){0,2})$"
    return f"regexp_replace(regexp_replace({piece}, '^(?:[89AB].)+', ''), '{open_}', '\\1')"


# A document's windows of 400 bytes as MD5s of their hex digits; a start counts if its window's MD5 comes twice. Starts at
# most 400 apart are in one removed run; what lies between the runs is kept.
OP2 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT rid, p, md5(substr(h, 2 * p + 1, 800)) AS g FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - 399)) AS p FROM d WHERE len(h) >= 800)
), s AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY g) AS n FROM w) WHERE n > 1
), r AS (
  SELECT rid, p, sum(CASE WHEN p <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY p) AS k
  FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS before FROM s)
), runs AS (
  SELECT rid, k, min(p) AS a, max(p) + 400 AS b FROM r GROUP BY rid, k
), kept AS (
  SELECT rid, string_agg(piece, '' ORDER BY k) AS pieces, string_agg({_whole("piece")}, '' ORDER BY k) AS clean, max(b) AS tail, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM (
    SELECT rid, k, a, b, substr(h, 2 * coalesce(last, 0) + 1, 2 * (a - coalesce(last, 0))) AS piece
    FROM (SELECT rid, k, a, b, lag(b) OVER (PARTITION BY rid ORDER BY k) AS last FROM runs) JOIN d USING (rid)
  ) GROUP BY rid
), e AS (
  SELECT doc_id, h, n_removed, n_spans, coalesce(pieces, '') || substr(h, 2 * coalesce(tail, 0) + 1) AS bytes,
         decode(unhex(coalesce(clean, '') || {_whole("substr(h, 2 * coalesce(tail, 0) + 1)")})) AS kept
  FROM d LEFT JOIN kept USING (rid)
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(bytes)) AS kept_sha256, kept, CAST(length(kept) AS BIGINT) AS n_kept
FROM e
"""

#: Rounds in which excess is shared again: enough for as many sources.
ROUNDS = 24


def _shared(k: int) -> str:
    left = "(SELECT total FROM totals) - coalesce(sum(2 * s) FILTER (full_) OVER (), 0)"
    share = f"({left}) * w / sum(w) FILTER (NOT full_) OVER ()"
    return f"f{k + 1} AS (SELECT source, s, w, full_ OR coalesce({share} > 2 * s, false) AS full_, CASE WHEN full_ THEN 2.0 * s ELSE {share} END AS t FROM f{k})"


# Documents in order of their hash: those are taken once more whose sizes together stay in what the target leaves over
# whole copies, and the next if that brings the sum nearer.
OP9 = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat_ws('|', '9001', CAST(doc_id AS VARCHAR), source, md5(text))), 1, 15) AS BIGINT) AS h
  FROM documents
), totals AS (
  SELECT 1.5::DOUBLE * sum(size) AS total FROM d
), f0 AS (
  SELECT source, s, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, false AS full_, 0.0::DOUBLE AS t
  FROM (SELECT source, sum(size) AS s FROM d GROUP BY source)
), {", ".join(_shared(k) for k in range(ROUNDS))},
goal AS (
  SELECT source, CAST(s AS BIGINT) AS source_size, CAST(t AS DOUBLE) AS target, CASE WHEN s = 0 THEN 0 ELSE least(CAST(floor(t / s) AS BIGINT), 2) END AS base FROM f{ROUNDS}
), c AS (
  SELECT d.*, source_size, target, base, target - base * source_size AS want, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto
  FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * CASE WHEN base >= 2 THEN 2 WHEN want <= 0 THEN base
         WHEN upto <= want OR (upto - size <= want AND upto - want < want - (upto - size)) THEN base + 1 ELSE base END AS BIGINT) AS taken
FROM c
"""
