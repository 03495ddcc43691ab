"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = f"""
WITH d AS (SELECT doc_id, {NORM} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

OP9 = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, line, pos,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d)),
hot AS (
  SELECT key, max(doc_id) AS owner FROM l WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.line, l.pos, hot.key IS NOT NULL AND l.doc_id <> hot.owner AS goes
  FROM l LEFT JOIN hot ON l.key = hot.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

WORDS2 = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2 = f"""
WITH d AS (SELECT doc_id, {WORDS2.format("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS2.format("text")} AS w FROM benchmark),
bw AS (SELECT item, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM b),
windows AS (
  SELECT DISTINCT item, least(n, 10) AS k, array_to_string(list_slice(w, i, i + least(n, 10) - 1), ' ') AS win
  FROM (SELECT b.item, b.w, bw.i, bw.n FROM b JOIN bw ON b.item = bw.item)
  WHERE i <= greatest(n - 9, 1)),
sizes AS (SELECT DISTINCT k FROM windows),
dw AS (SELECT doc_id, w, generate_subscripts(w, 1) AS i FROM d),
hits AS (
  SELECT dw.doc_id, dw.i, windows.k, windows.item
  FROM dw CROSS JOIN sizes JOIN windows
    ON windows.k = sizes.k AND array_to_string(list_slice(dw.w, dw.i, dw.i + sizes.k - 1), ' ') = windows.win
  WHERE dw.i + sizes.k - 1 <= len(dw.w)),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (
  SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""

OP13 = """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op2_decontamination": OP2,
    "op5_exact_dedup": OP5,
    "op9_line_dedup": OP9,
    "op13_inner_products": OP13,
}
