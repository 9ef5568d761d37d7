"""DuckDB SQL of the queries that SQL can express."""

OP4 = r"""
WITH d AS (
  SELECT doc_id, text, source, coalesce(source, '') AS src,
         coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0)::BIGINT AS n,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS turn
  FROM documents),
s AS (SELECT src, sum(n)::BIGINT AS supply FROM d GROUP BY src HAVING sum(n) > 0),
r AS (SELECT src, supply, floor(sqrt(supply::DOUBLE))::BIGINT AS root FROM s),
w AS (
  SELECT src, supply, sum(supply) OVER ()::BIGINT AS total, supply::DOUBLE AS w0, root::DOUBLE AS w1
  FROM r),
p AS (SELECT src, supply, total::DOUBLE AS budget, w0 / sum(w0) OVER () AS a, w1 / sum(w1) OVER () AS nxt FROM w),
q AS (SELECT *, (nxt - a) / 2.0::DOUBLE AS b, (a + nxt) / 2.0::DOUBLE AS share FROM p),
f AS (
  SELECT d.*, q.* EXCLUDE (src), (sum(n) OVER (PARTITION BY d.src ORDER BY turn, doc_id NULLS FIRST, text ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS first
  FROM d JOIN q ON d.src = q.src WHERE n > 0),
e AS (
  SELECT *, unnest(range(0, greatest(0, ceil((share * budget - first) / supply)::BIGINT - 1) + 1)) AS epoch
  FROM f WHERE first < share * budget),
t AS (SELECT *, (first + epoch * supply)::DOUBLE / budget AS due FROM e)
SELECT doc_id, source, n AS n_tokens, epoch::INTEGER AS epoch,
       round(least(CASE WHEN due <= 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * due / (a + sqrt(greatest(a * a + 4.0::DOUBLE * b * due, 0.0::DOUBLE))) END, 1.0::DOUBLE), 9) AS position,
       text
FROM t WHERE share > due
"""
