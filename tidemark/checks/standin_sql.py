"""SQL text of the stand-in source tables, in the dialect of the DuckDB check.

The source tables of the original problem (objects, rounds, acquisitions, ...)
are not available, so each is derived from the given tables.  The same
derivation is written with the DataFrame API in ``tidemark.sources.standin``;
the two texts are independent so that one checks the other.
"""

SOURCES = """
WITH activity AS (
  SELECT user_id,
         MIN(CASE WHEN event_type = 'signup' AND value > 100 THEN CAST(ts AS DATE) END) AS founded_at,
         MAX(CAST(ts AS DATE)) AS last_seen,
         COUNT(CASE WHEN event_type = 'purchase' THEN 1 END) AS funding_rounds,
         COUNT(CASE WHEN event_type = 'view' THEN 1 END) AS investment_rounds,
         COUNT(CASE WHEN event_type = 'error' THEN 1 END) AS invested_companies,
         SUM(CASE WHEN event_type = 'purchase' THEN value * 1000 END) AS funding_total_usd,
         MAX(CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END) AS last_funding_at,
         COUNT(CASE WHEN event_type = 'error' AND value > 150 THEN 1 END) AS n_sold,
         COUNT(CASE WHEN event_type = 'view' AND value > 250 THEN 1 END) AS n_listed
  FROM events GROUP BY user_id
),
objects AS (
  SELECT 'c:' || c.c_custkey AS id, c.c_name AS name, '/company/' || c.c_name AS permalink,
         NULLIF(c.c_mktsegment, 'FURNITURE') AS category_code,
         CASE WHEN c.c_acctbal < 0 THEN 'closed' WHEN a.n_sold > 0 THEN 'acquired'
              WHEN a.n_listed > 0 THEN 'ipo' ELSE 'operating' END AS status,
         a.founded_at, 'company' AS entity_type,
         CASE WHEN c.c_acctbal < 0 THEN a.last_seen END AS closed_at,
         CAST(NULL AS VARCHAR) AS parent_id,
         a.funding_rounds, a.investment_rounds, a.invested_companies,
         a.funding_total_usd, a.last_funding_at
  FROM customer c LEFT JOIN activity a ON a.user_id = c.c_custkey
  UNION ALL
  SELECT 'r:' || o_orderkey, 'Product ' || o_orderkey, NULL, NULL, 'live', NULL, 'Product', NULL,
         'c:' || o_custkey, NULL, NULL, NULL, NULL, NULL
  FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT 'f:' || s_suppkey, s_name, NULL, NULL, 'operating', NULL, 'FinancialOrg', NULL,
         NULL, NULL, NULL, NULL, NULL, NULL
  FROM supplier
  UNION ALL
  SELECT 'p:' || p_partkey, p_name || ' ' || p_partkey, NULL, NULL, 'live', NULL, 'Person', NULL,
         NULL, NULL, NULL, NULL, NULL, NULL
  FROM part
),
funding_rounds AS (
  SELECT event_id AS funding_round_id, 'c:' || user_id AS object_id,
         CASE WHEN value < 20 THEN 'angel' ELSE 'venture' END AS funding_round_type,
         CASE WHEN value < 20 THEN 'seed' WHEN value < 60 THEN 'a' WHEN value < 120 THEN 'b' END AS funding_round_code,
         CAST(ts AS DATE) AS funded_at,
         CASE WHEN value >= 5 THEN value * 1000 END AS raised_amount_usd,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS participants
  FROM events WHERE event_type = 'purchase'
),
investments AS (
  SELECT l_orderkey AS funding_round_id, 'f:' || l_suppkey AS investor_object_id FROM lineitem
  UNION ALL
  SELECT o_orderkey, 'c:' || o_custkey FROM orders
),
acquisitions AS (
  SELECT e.event_id AS acquisition_id, 'c:' || o.o_custkey AS acquiring_object_id,
         'c:' || e.user_id AS acquired_object_id, CAST(e.ts AS DATE) AS acquired_at,
         o.o_orderstatus AS term_code,
         CASE WHEN e.value > 200 THEN e.value * 1000 END AS price_amount
  FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id
  WHERE e.event_type = 'error' AND e.value > 150
),
ipos AS (
  SELECT event_id AS ipo_id, 'c:' || user_id AS object_id, CAST(ts AS DATE) AS public_at
  FROM events WHERE event_type = 'view' AND value > 250
),
milestones AS (
  SELECT event_id AS milestone_id, 'c:' || user_id AS object_id, CAST(ts AS DATE) AS milestone_at
  FROM events WHERE event_type = 'click'
),
offices AS (
  SELECT o_orderkey AS office_id, 'c:' || o_custkey AS object_id,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice / 10000 END AS latitude,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 5000 END AS longitude,
         o_orderpriority AS description
  FROM orders
),
relationships AS (
  SELECT 'p:' || l.l_partkey AS person_object_id, 'c:' || o.o_custkey AS relationship_object_id,
         CAST(l.l_shipdate + INTERVAL 300 MONTH AS DATE) AS start_at, o.o_orderpriority AS title
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
)
"""

# ids of companies with a founding date
COMPANIES = """,
companies AS (
  SELECT id, name, permalink, category_code, status, founded_at FROM objects
  WHERE entity_type = 'company' AND founded_at IS NOT NULL
)"""

# per (company, person): the person's earliest start anywhere
EXPERIENCE = """,
first_start AS (
  SELECT person_object_id, MIN(start_at) AS earliest_start FROM relationships GROUP BY person_object_id
),
leaders AS (
  SELECT DISTINCT relationship_object_id AS id, person_object_id FROM relationships
  WHERE regexp_matches(title, 'urgent|high', 'i')
),
experience AS (
  SELECT c.id,
         SUM(CASE WHEN date_diff('day', f.earliest_start, c.founded_at) >= 0
                  THEN date_diff('day', f.earliest_start, c.founded_at) END) AS experience
  FROM companies c JOIN leaders l ON l.id = c.id JOIN first_start f USING (person_object_id)
  GROUP BY c.id
)"""

ENTITY = """,
place AS (
  SELECT object_id AS id,
         arg_min(latitude, office_id) FILTER (WHERE latitude IS NOT NULL) AS latitude,
         arg_min(longitude, office_id) FILTER (WHERE longitude IS NOT NULL) AS longitude,
         COUNT(*) AS offices
  FROM offices GROUP BY object_id
),
children AS (
  SELECT parent_id AS id, COUNT(*) AS products FROM objects WHERE parent_id IS NOT NULL GROUP BY parent_id
),
entity AS (
  SELECT c.id, c.name, c.category_code, c.status, c.founded_at AS dates,
         p.latitude, p.longitude, p.offices, k.products, COALESCE(e.experience, 0) AS experience
  FROM companies c JOIN experience e USING (id) LEFT JOIN place p USING (id) LEFT JOIN children k USING (id)
)"""

TIMELINE = """,
funded AS (
  SELECT object_id AS id, funded_at AS dates, 'funded' AS event_id, funding_round_id AS seq,
         raised_amount_usd AS famt, participants AS investors
  FROM funding_rounds WHERE funded_at IS NOT NULL
),
founded AS (
  SELECT id, dates FROM entity WHERE id IN (SELECT id FROM funded)
),
raw_events AS (
  SELECT id, dates, 'founded' AS event_id, 0 AS seq, NULL AS famt, NULL AS investors, NULL AS iamt, NULL AS iparts, NULL AS aamt
  FROM founded
  UNION ALL
  SELECT id, dates, event_id, seq, famt, investors, NULL, NULL, NULL FROM funded
  UNION ALL
  SELECT acquired_object_id, MIN(acquired_at), 'acquired', 0, NULL, NULL, NULL, NULL, NULL
  FROM acquisitions GROUP BY acquired_object_id
  UNION ALL
  SELECT object_id, public_at, 'public', ipo_id, NULL, NULL, NULL, NULL, NULL FROM ipos
  UNION ALL
  SELECT id, closed_at, 'closed', 0, NULL, NULL, NULL, NULL, NULL FROM objects WHERE entity_type = 'company'
  UNION ALL
  SELECT object_id, milestone_at, 'milestone', milestone_id, NULL, NULL, NULL, NULL, NULL FROM milestones
  UNION ALL
  SELECT i.investor_object_id, f.funded_at, 'investment', f.funding_round_id, NULL, NULL, f.raised_amount_usd, f.participants, NULL
  FROM investments i JOIN funding_rounds f USING (funding_round_id)
  WHERE i.investor_object_id LIKE 'c:%'
  UNION ALL
  SELECT acquiring_object_id, acquired_at, 'acquisition', acquisition_id, NULL, NULL, NULL, NULL, price_amount
  FROM acquisitions
),
timed AS (
  SELECT r.*, date_diff('day', f.dates, r.dates) AS time_to_event
  FROM raw_events r JOIN founded f USING (id) WHERE r.dates IS NOT NULL
),
numbered AS (
  SELECT *,
         CASE WHEN famt IS NOT NULL THEN SUM(famt) OVER w END AS famt_cumsum,
         ROW_NUMBER() OVER w AS event_count,
         COALESCE(time_to_event - LAG(time_to_event) OVER w, time_to_event) AS time_diff
  FROM timed
  WINDOW w AS (PARTITION BY id, event_id ORDER BY dates, seq ROWS UNBOUNDED PRECEDING)
),
timeline AS (
  SELECT id, dates, event_id, seq, famt, investors, famt_cumsum, iamt, iparts, aamt,
         time_to_event, event_count, time_diff
  FROM numbered WHERE time_diff >= 0 AND time_to_event >= 0
)"""

LABELS = """,
live AS (SELECT * FROM entity WHERE status <> 'closed' AND id IN (SELECT id FROM timeline)),
live_tl AS (SELECT * FROM timeline WHERE id IN (SELECT id FROM live)),
exits AS (
  SELECT t.id, t.time_to_event, l.category_code FROM live_tl t JOIN live l USING (id)
  WHERE t.event_id IN ('public', 'acquired')
),
threshold AS (
  SELECT category_code, median(time_to_event) AS threshold FROM exits
  WHERE category_code IS NOT NULL GROUP BY category_code
),
outcome AS (
  SELECT l.id,
         CASE WHEN bool_or(x.time_to_event >= h.threshold) THEN 1
              WHEN bool_or(x.time_to_event < h.threshold) THEN 0
              WHEN COUNT(x.id) = 0 AND MAX(t.age) >= MAX(h.threshold) THEN 2
              ELSE 3 END AS label
  FROM live l LEFT JOIN exits x USING (id)
       LEFT JOIN threshold h ON h.category_code = l.category_code
       LEFT JOIN (SELECT id, MAX(time_to_event) AS age FROM live_tl GROUP BY id) t ON t.id = l.id
  GROUP BY l.id
)"""

BASE = SOURCES + COMPANIES + EXPERIENCE + ENTITY
EVENTS = BASE + TIMELINE
OUTCOMES = EVENTS + LABELS
