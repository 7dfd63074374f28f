"""SQL for queries whose rows depend on all before them: recursive walks, a row of every statement at each step."""

# Legs of a statement: c, the checks in order (k from 1), and r, the register.
_SIDES = """c AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY ord) AS k FROM legs WHERE source <> 'register'),
    r AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY ord) AS k FROM legs WHERE source = 'register')"""

#: Each check takes the first free register row of its number, else of its amount.
MATCHES = f"""{_SIDES},
wishes AS (
  SELECT c.statement_id, c.k, any_value(c.ord) AS crop_ord,
    coalesce(list(r.ord ORDER BY r.ord) FILTER (WHERE c.check_no <> '' AND c.check_no = r.check_no), []) AS numbers,
    coalesce(list(r.ord ORDER BY r.ord) FILTER (WHERE abs(abs(c.amount) - abs(r.amount)) < 0.011), []) AS amounts
  FROM c LEFT JOIN r ON c.statement_id = r.statement_id GROUP BY c.statement_id, c.k),
walk AS (
  SELECT DISTINCT statement_id, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS crop_ord, NULL::BIGINT AS a, NULL::BIGINT AS b FROM c
  UNION ALL
  SELECT statement_id, k, CASE WHEN coalesce(a, b) IS NULL THEN used ELSE list_append(used, coalesce(a, b)) END, crop_ord, a, b FROM (
    SELECT w.statement_id, n.k, w.used, n.crop_ord, list_filter(n.numbers, lambda x: NOT list_contains(w.used, x))[1] AS a,
      list_filter(n.amounts, lambda x: NOT list_contains(w.used, x))[1] AS b
    FROM walk w JOIN wishes n ON n.statement_id = w.statement_id AND n.k = w.k + 1))
SELECT statement_id, crop_ord, coalesce(a, b) AS ord, CASE WHEN a IS NULL THEN 'amount' ELSE 'check_number' END AS tier, NULL::DOUBLE AS alike
FROM walk WHERE coalesce(a, b) IS NOT NULL
"""

#: Each check is covered by the first register row of its number, or by a debit of its amount that is left, whichever begins first.
SUPPLEMENTS = f"""{_SIDES},
numbers AS (SELECT statement_id, check_no, min(ord) AS number_ord FROM r WHERE check_no <> '' GROUP BY ALL),
pools AS (SELECT statement_id, amount, min(ord) AS pool_ord, count(*) AS size FROM r WHERE amount < 0 GROUP BY ALL),
wishes AS (
  SELECT c.statement_id, c.k, c.ord, c.amount, number_ord, pool_ord, size
  FROM c LEFT JOIN numbers USING (statement_id, check_no) LEFT JOIN pools USING (statement_id, amount)),
walk AS (
  SELECT DISTINCT statement_id, 0::BIGINT AS k, []::DOUBLE[] AS used, NULL::BIGINT AS ord, NULL::VARCHAR AS decision, NULL::BIGINT AS register_ord FROM c
  UNION ALL
  SELECT statement_id, k, CASE WHEN sum THEN list_append(used, amount) ELSE used END, ord,
    CASE WHEN sum THEN 'amount' WHEN number_ord IS NOT NULL THEN 'check_number' ELSE 'supplemental' END, CASE WHEN sum THEN pool_ord ELSE number_ord END
  FROM (SELECT w.statement_id, n.k, w.used, n.ord, n.amount, n.number_ord, n.pool_ord,
      coalesce(n.size > len(list_filter(w.used, lambda x: x = n.amount)) AND (n.number_ord IS NULL OR n.pool_ord < n.number_ord), false) AS sum
    FROM walk w JOIN wishes n ON n.statement_id = w.statement_id AND n.k = w.k + 1))
SELECT statement_id, ord, decision, coalesce(register_ord, -1) AS register_ord FROM walk WHERE k > 0
"""

#: Each register row is filled from the last check of its number, or from the first unused one of its amount.
PAYEES = f"""{_SIDES},
numbers AS (SELECT statement_id, check_no, max(ord) AS last FROM c WHERE check_no <> '' GROUP BY ALL),
wishes AS (
  SELECT r.statement_id, r.k, any_value(r.ord) AS ord, any_value(n.last) AS last,
    coalesce(list(c.ord ORDER BY c.ord) FILTER (WHERE c.amount = r.amount AND c.amount <> 0), []) AS amounts
  FROM r LEFT JOIN c ON c.statement_id = r.statement_id LEFT JOIN numbers n ON n.statement_id = r.statement_id AND n.check_no = r.check_no
  GROUP BY r.statement_id, r.k),
walk AS (
  SELECT DISTINCT statement_id, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS ord, NULL::BIGINT AS hit FROM r
  UNION ALL
  SELECT statement_id, k, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, ord, hit FROM (
    SELECT w.statement_id, n.k, w.used, n.ord, CASE WHEN n.last IS NULL THEN list_filter(n.amounts, lambda x: NOT list_contains(w.used, x))[1]
        WHEN NOT list_contains(w.used, n.last) THEN n.last END AS hit
    FROM walk w JOIN wishes n ON n.statement_id = w.statement_id AND n.k = w.k + 1))
SELECT statement_id, ord, CASE WHEN hit IS NULL THEN '' ELSE 'Payee ' || hit END AS payee, CASE WHEN hit IS NULL THEN 'register' ELSE 'check_image_crop' END AS source
FROM walk WHERE k > 0
"""

#: Checks that fit six tenths of their sum: numbered ones first, nearest the median first; all if that leaves too much.
TRIMMED = """c AS (SELECT * FROM legs WHERE source = 'check_image_crop'),
known AS (
  SELECT statement_id, sum(abs(amount)) AS total, sum(abs(amount)) * 0.6 AS budget, coalesce(median(abs(amount)) FILTER (WHERE amount <> 0), 0) AS middle
  FROM c GROUP BY statement_id),
ranked AS (
  SELECT c.statement_id, c.ord, abs(amount) AS size, budget,
    row_number() OVER (PARTITION BY c.statement_id ORDER BY check_no = '', abs(abs(amount) - middle), ord) AS k
  FROM c JOIN known USING (statement_id) WHERE budget > 0 AND total > budget + 100),
walk AS (
  SELECT DISTINCT statement_id, 0::BIGINT AS k, 0::DOUBLE AS spent, NULL::BIGINT AS ord, false AS taken, budget FROM ranked
  UNION ALL
  SELECT w.statement_id, n.k, CASE WHEN w.spent + n.size <= n.budget + 100 THEN w.spent + n.size ELSE w.spent END, n.ord, w.spent + n.size <= n.budget + 100, n.budget
  FROM walk w JOIN ranked n ON n.statement_id = w.statement_id AND n.k = w.k + 1),
short AS (SELECT statement_id FROM walk GROUP BY statement_id HAVING max(spent) < max(budget) - 100),
part AS (SELECT statement_id, ord FROM walk WHERE taken)
SELECT statement_id, ord, amount FROM c
WHERE statement_id NOT IN (SELECT statement_id FROM ranked) OR statement_id IN (SELECT statement_id FROM short) OR (statement_id, ord) IN (SELECT statement_id, ord FROM part)
"""
