"""SQL with the same rows as the queries of this folder, where SQL can express them."""

OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents
), docs AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source NULLS FIRST, size, body) AS nth FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM docs GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source) AS pos FROM sources
), levels AS (
  SELECT *, coalesce(((SELECT CAST(sum(source_size) AS BIGINT) FROM sources)
         - coalesce(sum(3 * source_size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level
  FROM ranked
), level AS (
  SELECT level FROM levels WHERE 3 * source_size >= level * weight ORDER BY pos LIMIT 1
), shares AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level.level * weight) AS target
  FROM sources, level
), queue AS (
  SELECT d.doc_id, d.nth, d.source, d.size, d.h, turn,
         (turn * s.source_size + sum(d.size) OVER (PARTITION BY d.source, turn
            ORDER BY d.h, d.doc_id, d.nth ROWS UNBOUNDED PRECEDING)) / s.target AS finish
  FROM docs d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source,
       (SELECT unnest([0, 1, 2]) AS turn)
  WHERE s.target > 0
), served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, h, doc_id, nth, turn ROWS UNBOUNDED PRECEDING) AS total
  FROM queue
), times AS (
  SELECT doc_id, nth, sum(size) AS taken FROM served
  WHERE total <= (SELECT sum(size) FROM docs) GROUP BY doc_id, nth
)
SELECT d.doc_id, d.size, s.source_size, s.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken
FROM docs d
JOIN shares s ON d.source IS NOT DISTINCT FROM s.source
LEFT JOIN times t ON d.doc_id IS NOT DISTINCT FROM t.doc_id AND d.nth = t.nth
"""

OP5 = """
WITH usable AS (
  SELECT vec_id, min(embedding) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
  GROUP BY vec_id
), vectors AS (SELECT vec_id, CAST(v AS DOUBLE[]) AS v FROM usable
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP10 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP13 = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), lined AS (
  SELECT *, regexp_extract_all(body, '[^\n]*\n|[^\n]+') AS lines,
         [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS d
  FROM drawn
), counted AS (
  SELECT *, len(lines) AS n, d[1] % (len(lines) + 1) AS one, d[2] % (len(lines) + 1) AS other,
         CASE WHEN body = '' OR regexp_matches(body, '<[PSM]>') OR d[3] % 100 >= 100 THEN 'plain'
              WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM lined
), parts AS (
  SELECT *, coalesce(array_to_string(lines[1:least(one, other)], ''), '') AS prefix,
         coalesce(array_to_string(lines[least(one, other) + 1:greatest(one, other)], ''), '') AS middle,
         coalesce(array_to_string(lines[greatest(one, other) + 1:], ''), '') AS suffix
  FROM counted
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts
"""

SQL = {"op2_mixing": OP2, "op5_nearest": OP5, "op10_exact_dedup": OP10, "op13_fill_middle": OP13}
