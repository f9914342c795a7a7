"""The catalog queries as plain SQL over the same tables, for checking."""

from __future__ import annotations

from riskweave.plans import order_oracles

MEMBERS = """
members AS (
  SELECT DISTINCT matcher, value, payload_number FROM (
    SELECT 'customer.id' AS matcher, CAST(o_custkey AS VARCHAR) AS value,
           CAST(o_orderkey AS VARCHAR) AS payload_number FROM orders
    UNION ALL
    SELECT 'item.part_supplier', CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR),
           CAST(l_orderkey AS VARCHAR) FROM lineitem)),
nodes AS (
  SELECT matcher, value, count(*) AS size,
         CASE matcher WHEN 'customer.id' THEN 100 ELSE 70 END AS confidence,
         CASE matcher WHEN 'customer.id' THEN 90 ELSE 60 END AS importance
  FROM members GROUP BY matcher, value),
shared AS (
  SELECT m.matcher, m.value, m.payload_number, n.size, n.confidence, n.importance
  FROM members m JOIN nodes n ON m.matcher = n.matcher AND m.value = n.value WHERE n.size > 1)
"""

PAIRS = MEMBERS + """,
links AS (
  SELECT a.payload_number AS a_id, b.payload_number AS b_id, a.matcher,
         max(a.confidence) AS confidence, max(a.importance) AS importance
  FROM shared a JOIN shared b ON a.matcher = b.matcher AND a.value = b.value
   AND a.payload_number < b.payload_number
  GROUP BY 1, 2, 3),
edges AS (
  SELECT a_id, b_id, string_agg(matcher, ',' ORDER BY matcher) AS attributes,
         first(matcher ORDER BY confidence DESC, matcher) AS best_attribute,
         max(confidence) AS best_confidence,
         string_agg(matcher || ':' || CAST(confidence AS VARCHAR), ','
                    ORDER BY confidence DESC, matcher) AS connection_types
  FROM links GROUP BY a_id, b_id),
both_ways AS (
  SELECT a_id AS src_id, b_id AS dst_id, best_attribute, best_confidence FROM edges
  UNION ALL
  SELECT b_id, a_id, best_attribute, best_confidence FROM edges)
"""

EDGES = f"WITH {PAIRS} SELECT * FROM edges"

DIRECT = MEMBERS + """,
partners AS (
  SELECT DISTINCT a.payload_number, b.payload_number AS other, a.matcher
  FROM shared a JOIN shared b ON a.matcher = b.matcher AND a.value = b.value
   AND a.payload_number <> b.payload_number),
direct AS (
  SELECT payload_number, count(*) AS direct_connection_count FROM partners GROUP BY 1)
"""


#: Hops of the path search.
DEPTH = 10


def _hops(depth: int, limit: int = 200) -> str:
    """Best confidence, then fewest hops, per pair; hop by hop from what the last hop improved.

    What is weaker than the ``limit`` best of a root so far can neither enter
    its list nor lead to what does, as confidence never rises along a path.
    """
    steps = ["""at1 AS (
  SELECT payload_number AS root, matcher, value, confidence FROM shared)"""]
    for k in range(1, depth + 1):
        if k > 1:
            steps.append(f"""at{k} AS MATERIALIZED (
  SELECT h.root, s.matcher, s.value, max(h.score // 100 * s.confidence // 100) AS confidence
  FROM best{k - 1} h JOIN shared s ON s.payload_number = h.target WHERE 99 - h.score % 100 = {k - 1}
  GROUP BY 1, 2, 3)""")
        before = f"SELECT root, target, score FROM best{k - 1} UNION ALL " if k > 1 else ""
        steps.append(f"""found{k} AS (
  {before}SELECT a.root, s.payload_number, max(a.confidence) * 100 + 99 - {k}
  FROM at{k} a JOIN shared s ON s.matcher = a.matcher AND s.value = a.value
  WHERE s.payload_number <> a.root GROUP BY 1, 2),
all{k}(root, target, score) AS MATERIALIZED (
  SELECT f.root, f.{'target' if k > 1 else 'payload_number'}, max(f.{'score' if k > 1 else 'm'}) FROM found{k} f{'' if k > 1 else '(root, payload_number, m)'} GROUP BY 1, 2),
floor{k} AS (
  SELECT root, score // 100 AS least FROM (
    SELECT root, score, row_number() OVER (PARTITION BY root ORDER BY score DESC) AS rn FROM all{k}) WHERE rn = {limit}),
best{k} AS MATERIALIZED (
  SELECT a.root, a.target, a.score FROM all{k} a LEFT JOIN floor{k} f ON f.root = a.root
  WHERE a.score // 100 >= coalesce(f.least, 0))""")
    steps.append(f"""best AS MATERIALIZED (
  SELECT root, target, (score // 100)::INTEGER AS confidence, (99 - score % 100)::INTEGER AS hops FROM best{depth}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY root ORDER BY confidence DESC, target) AS rn FROM best)""")
    return ",\n".join(steps)


CONNECTED = MEMBERS + ",\n" + _hops(DEPTH)


def _reach(depth: int, limit: int) -> str:
    """Reached partners per root; a root with ``limit`` of them is finished."""
    steps = ["""reach1 AS MATERIALIZED (
  SELECT DISTINCT a.payload_number AS root, b.payload_number AS target
  FROM shared a JOIN shared b ON a.matcher = b.matcher AND a.value = b.value
   AND a.payload_number <> b.payload_number)"""]
    for k in range(2, depth + 1):
        steps.append(f"""open{k} AS MATERIALIZED (
  SELECT root FROM reach{k - 1} GROUP BY root HAVING count(*) < {limit}),
nodes{k} AS MATERIALIZED (
  SELECT DISTINCT r.root, s.matcher, s.value FROM reach{k - 1} r JOIN open{k} o ON o.root = r.root
  JOIN shared s ON s.payload_number = r.target),
reach{k} AS MATERIALIZED (
  SELECT root, target FROM reach{k - 1}
  UNION
  SELECT n.root, s.payload_number FROM nodes{k} n
  JOIN shared s ON s.matcher = n.matcher AND s.value = n.value
  WHERE s.payload_number <> n.root)""")
    steps.append(f"""connected AS (
  SELECT root AS payload_number, least(count(*), {limit}) AS connected_transaction_count
  FROM reach{depth} GROUP BY root)""")
    return ",\n".join(steps)


SIMPLE = """
accounts AS (SELECT o_custkey, min(o_orderdate) AS account_created FROM orders GROUP BY 1),
baskets AS (
  SELECT l_orderkey, count(*) AS item_count,
         sum(CAST(l_extendedprice * greatest(l_quantity, 0) AS DECIMAL(18,2))) AS amount
  FROM lineitem GROUP BY 1),
simple AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS payload_number, coalesce(item_count, 0) AS item_count,
         CAST(coalesce(amount, 0) AS DECIMAL(18,2)) AS amount, o_orderdate AS created_at,
         o_orderstatus AS state, date_diff('day', account_created, o_orderdate) < 30 AS is_new_customer,
         coalesce(amount, 0) > 1000 AS is_high_value
  FROM orders JOIN accounts USING (o_custkey) LEFT JOIN baskets ON l_orderkey = o_orderkey)
"""

RULE_FLAGS = """
flags AS (
  SELECT payload_number,
    amount > 3000000 AS r1,
    item_count >= 6 AND is_high_value AS r2,
    is_new_customer AND state <> 'P' AS r3,
    epoch_ms(created_at) > 946684800000
      OR (item_count > 0 AND CAST(amount AS DOUBLE) / item_count > 900000) AS r4
  FROM simple),
scored AS (
  SELECT payload_number,
    CAST(r1 AS INT) * 40 + CAST(r2 AS INT) * 25 + CAST(r3 AS INT) * 20 + CAST(r4 AS INT) * 10 AS total_score,
    concat_ws(',', CASE WHEN r1 THEN 'large_amount' END, CASE WHEN r2 THEN 'many_items' END,
              CASE WHEN r3 THEN 'first_orders' END, CASE WHEN r4 THEN 'late' END) AS triggered,
    CAST(r1 AS INT) + CAST(r2 AS INT) + CAST(r3 AS INT) + CAST(r4 AS INT) AS triggered_count
  FROM flags)
"""


def _channels(source: str) -> str:
    """Events of both active channels over (simple features + counts)."""
    return f"""
SELECT payload_number, 'payments' AS channel,
  CAST(a AS INT) * 40 + CAST(b AS INT) * 30 + CAST(c AS INT) * 20 AS total_score,
  concat_ws(',', CASE WHEN a THEN 'large_amount' END, CASE WHEN b THEN 'well_connected' END,
            CASE WHEN c THEN 'direct' END) AS triggered
FROM (SELECT payload_number, amount > 3000000 AS a, cc >= 200 AS b,
             dc > 15 AND NOT is_new_customer AS c FROM {source})
UNION ALL
SELECT payload_number, 'accounts',
  CAST(a AS INT) * 25 + CAST(b AS INT) * 15,
  concat_ws(',', CASE WHEN a THEN 'first_orders' END, CASE WHEN b THEN 'isolated' END)
FROM (SELECT payload_number, is_new_customer AS a, dc = 0 AS b FROM {source})
"""


RECENT = """
recent AS (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01')
"""

AFFECTED = """
affected AS (
  SELECT DISTINCT target AS payload_number FROM ranked
  WHERE rn <= 200
    AND root IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01')
    AND target NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'))
"""

DOCUMENTS = """
docs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderdate, o_orderstatus, o_orderpriority,
         c_custkey, c_name, c_acctbal > 0 AS good_account, c_mktsegment, n_name, n_nationkey,
         ['DE', 'AT', 'CH', 'FR', 'XX'][n_regionkey + 1] AS country,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN 'malformed record'
              WHEN o_orderpriority = '5-LOW' THEN 'missing order.date'
              WHEN n_regionkey = 4 THEN 'unknown country in billingIdentity'
              WHEN c_mktsegment = 'MACHINERY' THEN 'unknown address type in billingIdentity'
              ELSE 'imported' END AS reason
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""

ORACLES = {
    "import_versions": """
WITH e AS (
  SELECT CAST(user_id AS VARCHAR) AS payload_number, event_id, ts, value, event_type,
         ts < TIMESTAMP '2024-01-16' AS old FROM events),
v AS (
  SELECT *, row_number() OVER (PARTITION BY payload_number ORDER BY ts, event_id) AS n,
         row_number() OVER (PARTITION BY payload_number ORDER BY ts DESC, event_id DESC) AS back,
         row_number() OVER (PARTITION BY payload_number, old ORDER BY ts DESC, event_id DESC) AS old_back
  FROM e),
last_old AS (SELECT payload_number, value, event_type FROM v WHERE old AND old_back = 1)
SELECT v.payload_number, v.event_id, CAST(v.n AS INT) AS transaction_version, v.back = 1 AS is_latest,
       CASE WHEN v.old AND v.old_back > 1 THEN NULL WHEN l.value > 50 THEN 'Fraud' END AS fraud_level,
       CASE WHEN v.old THEN v.event_type ELSE l.event_type END AS comment
FROM v LEFT JOIN last_old l ON v.payload_number = l.payload_number""",
    "latest_view": """
SELECT payload_number, event_id, event_type, value FROM (
  SELECT CAST(user_id AS VARCHAR) AS payload_number, event_id, event_type,
         CAST(value AS DECIMAL(18,2)) AS value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""",
    "label_bulk": """
WITH o AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS payload_number, 1 AS transaction_version,
         o_orderpriority = '1-URGENT' AND o_totalprice > 400000 AS hit FROM orders)
SELECT payload_number, transaction_version, NOT hit AS is_latest,
       CAST(NULL AS VARCHAR) AS fraud_level, CAST(NULL AS VARCHAR) AS label_source FROM o
UNION ALL
SELECT payload_number, transaction_version, true, 'Fraud', 'Manual' FROM o WHERE hit""",
    "fetch_by_ids": """
SELECT o_orderkey AS id, true AS found FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL
SELECT o_orderkey, false FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "mark_processed": """
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus = 'F' AS processing_complete,
       CASE WHEN o_orderstatus = 'F' THEN '2024-02-01' END AS scored_on,
       CASE WHEN o_orderstatus = 'F' THEN '2024-02-01'
            ELSE strftime(o_orderdate, '%Y-%m-%d') END AS updated_on FROM orders""",
    "filter_scalar": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
       CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND o_totalprice > 20000
  AND o_totalprice <= 450000 AND o_custkey >= 10 AND o_custkey < 1400""",
    "filter_sets": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag,
       CAST(l_quantity AS DECIMAL(18,2)) AS quantity FROM lineitem
WHERE l_quantity BETWEEN 5 AND 40 AND l_returnflag IN ('A', 'R')
  AND l_linenumber IN (1, 2, 3, 5) AND l_suppkey NOT IN (1, 2, 3)""",
    "filter_text_null": """
WITH r AS (
  SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN l_quantity >= 49 THEN l_orderkey END AS l_orderkey
  FROM part LEFT JOIN lineitem ON p_partkey = l_partkey)
SELECT p_partkey, CAST(-1 AS BIGINT) AS orderkey, p_name, p_brand FROM r
WHERE contains(p_name, 'ring') AND l_orderkey IS NULL
UNION ALL
SELECT p_partkey, l_orderkey, p_name, p_brand FROM r
WHERE contains(p_brand, '#2') AND l_orderkey IS NOT NULL AND p_type <> 'PROMO'""",
    "filter_groups": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
       CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM orders
WHERE (o_orderstatus = 'O' AND o_totalprice > 300000)
   OR (o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-06-30'
       AND (o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_totalprice < 5000))""",
    "search_page": """
SELECT o_orderkey, c_name, o_orderpriority, CAST(o_totalprice AS DECIMAL(18,2)) AS total
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE (contains(lower(CAST(o_orderkey AS VARCHAR)), lower('R#00000001'))
       OR contains(lower(c_name), lower('R#00000001'))) AND o_orderstatus = 'F'
ORDER BY o_orderpriority, total DESC, o_orderkey LIMIT 100 OFFSET 20""",
    "match_nodes": f"WITH {MEMBERS} SELECT matcher, value, size, confidence, importance FROM nodes WHERE size > 1",
    "value_dictionary": f"WITH {MEMBERS} SELECT DISTINCT matcher, value FROM members",
    "match_timespace": """
SELECT 'customer.id' AS matcher, CAST(o_custkey AS VARCHAR) AS value, count(*) AS size,
       strftime(min(o_orderdate), '%Y-%m-%d') AS first_seen,
       strftime(max(o_orderdate), '%Y-%m-%d') AS last_seen
FROM orders GROUP BY o_custkey""",
    "match_merge": f"""
WITH {MEMBERS}
SELECT n.matcher, n.value, n.size,
       CASE WHEN n.matcher = 'customer.id' AND o.value IS NOT NULL THEN 95 ELSE n.confidence END AS confidence,
       CASE WHEN n.matcher = 'customer.id' AND o.value IS NOT NULL THEN 85 ELSE n.importance END AS importance
FROM nodes n LEFT JOIN (
  SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS value FROM orders
  WHERE o_orderdate < TIMESTAMP '1998-01-01') o ON o.value = n.value
WHERE n.size > 1""",
    "pair_edges": EDGES,
    "edge_refresh": EDGES,
    "edge_summary": f"""
WITH {PAIRS},
best AS (
  SELECT payload_number, matcher, max(confidence) AS confidence FROM shared GROUP BY 1, 2)
SELECT payload_number, string_agg(matcher, ',' ORDER BY matcher) AS attributes,
       first(matcher ORDER BY confidence DESC, matcher) AS best_attribute,
       max(confidence) AS best_confidence
FROM best GROUP BY payload_number""",
    "adjacency": f"WITH {PAIRS} SELECT * FROM both_ways",
    "neighbours": f"""
WITH {PAIRS}
SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY best_confidence DESC, dst_id) AS position
FROM both_ways""",
    "direct_connections": f"""
WITH {DIRECT}
SELECT d.payload_number, d.direct_connection_count, s.max_confidence, s.max_importance
FROM direct d JOIN (
  SELECT payload_number, max(confidence) AS max_confidence, max(importance) AS max_importance
  FROM shared GROUP BY 1) s ON s.payload_number = d.payload_number""",
    "direct_rows": f"""
WITH {MEMBERS}, {RECENT}
SELECT a.payload_number AS root, b.payload_number, a.matcher,
       max(a.confidence) AS confidence, max(a.importance) AS importance
FROM shared a JOIN recent r ON r.id = a.payload_number
JOIN shared b ON a.matcher = b.matcher AND a.value = b.value AND a.payload_number <> b.payload_number
GROUP BY 1, 2, 3""",
    "batch_links": f"""
WITH {PAIRS}, {RECENT}
SELECT * FROM links WHERE a_id IN (SELECT id FROM recent) OR b_id IN (SELECT id FROM recent)""",
    "batch_neighbours": f"""
WITH {PAIRS}, {RECENT}
SELECT id AS src_id, CASE WHEN a_id = id THEN b_id ELSE a_id END AS dst_id,
       attributes, best_attribute, best_confidence, connection_types
FROM recent JOIN edges ON id = a_id OR id = b_id""",
    "domain_nodes": f"""
WITH {DOCUMENTS},
fields AS (
  SELECT 'customer.email' AS matcher, lower(replace(c_name, '#', '.')) || '@example.com' AS value,
         100 AS confidence, 90 AS importance FROM docs WHERE reason = 'imported' AND good_account
  UNION ALL
  SELECT 'customer.name', CASE WHEN good_account THEN c_name || ' ' || c_mktsegment ELSE c_name END, 80, 50
  FROM docs WHERE reason = 'imported')
SELECT matcher, value, count(*) AS size, confidence, importance FROM fields
GROUP BY matcher, value, confidence, importance""",
    "order_source": f"""
WITH {DOCUMENTS}
SELECT CASE WHEN reason = 'malformed record' THEN '' ELSE id END AS id, reason FROM docs""",
    "channel_events": f"""
WITH {SIMPLE}, {RULE_FLAGS}
SELECT payload_number, 'orders' AS channel, total_score, triggered, CAST(1 AS BIGINT) AS run
FROM scored WHERE payload_number IN (
  SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F')""",
    "connected": f"""
WITH {CONNECTED}
SELECT root, confidence, hops, count(*) AS partners, min(target) AS first_partner,
       max(target) AS last_partner
FROM ranked WHERE rn <= 200 GROUP BY root, confidence, hops""",
    "connected_topk": f"""
WITH {CONNECTED}
SELECT root, target AS payload_number, confidence, hops FROM ranked WHERE rn <= 10""",
    "graph_tree": f"""
WITH RECURSIVE {PAIRS},
walk(node, depth) AS (
  SELECT '0', 0
  UNION
  SELECT b.dst_id, w.depth + 1 FROM walk w JOIN both_ways b ON b.src_id = w.node WHERE w.depth < 40),
level AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
parents AS (
  SELECT c.node, min(p.node) AS parent, c.depth
  FROM level c JOIN both_ways b ON b.dst_id = c.node
  JOIN level p ON p.node = b.src_id AND p.depth = c.depth - 1 GROUP BY c.node, c.depth),
tree AS (
  SELECT p.node, p.parent, b.best_attribute, p.depth FROM parents p
  JOIN both_ways b ON b.src_id = p.parent AND b.dst_id = p.node),
named(node, parent, edge_attribute, depth, path_nodes, path_attributes) AS (
  SELECT '0', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0, '0', ''
  UNION ALL
  SELECT t.node, t.parent, t.best_attribute, t.depth, n.path_nodes || '>' || t.node,
         CASE WHEN n.depth = 0 THEN t.best_attribute ELSE n.path_attributes || '>' || t.best_attribute END
  FROM named n JOIN tree t ON t.parent = n.node)
SELECT node AS payload_number, parent, edge_attribute, depth, path_nodes, path_attributes FROM named""",
    "simple_features": f"""
WITH {SIMPLE},
lists AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS payload_number,
         string_agg(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), ','
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS amounts,
         string_agg(p_type, ','
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS categories
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT payload_number, item_count, amount, coalesce(amounts, '') AS amounts,
       coalesce(categories, '') AS categories, strftime(created_at, '%Y-%m-%d') AS created_at,
       is_new_customer, is_high_value
FROM simple LEFT JOIN lists USING (payload_number)""",
    "time_feature": "SELECT event_id, strftime(ts, '%H:%M:%S') AS order_time FROM events",
    "graph_features": f"""
WITH {DIRECT}, {_reach(10, 200)}
SELECT CAST(o_orderkey AS VARCHAR) AS payload_number,
       coalesce(connected_transaction_count, 0) AS connected_transaction_count,
       coalesce(direct_connection_count, 0) AS direct_connection_count
FROM orders LEFT JOIN connected c ON c.payload_number = CAST(o_orderkey AS VARCHAR)
LEFT JOIN direct d ON d.payload_number = CAST(o_orderkey AS VARCHAR)""",
    "feature_pack": f"""
WITH {SIMPLE}
SELECT payload_number, 'item_count' AS name, 'integer' AS type, CAST(item_count AS VARCHAR) AS value FROM simple
UNION ALL SELECT payload_number, 'amount', 'double', CAST(amount AS VARCHAR) FROM simple
UNION ALL SELECT payload_number, 'created_at', 'datetime',
  strftime(created_at, '"%Y-%m-%dT%H:%M:%S+00:00"') FROM simple
UNION ALL SELECT payload_number, 'state', 'string', '"' || state || '"' FROM simple
UNION ALL SELECT payload_number, 'is_new_customer', 'boolean', CAST(is_new_customer AS VARCHAR) FROM simple
UNION ALL SELECT payload_number, 'is_high_value', 'boolean', CAST(is_high_value AS VARCHAR) FROM simple""",
    "feature_unpack": f"""
WITH {SIMPLE} SELECT payload_number, item_count, state, is_new_customer, amount FROM simple""",
    "feature_violations": """
SELECT o_orderkey AS orderkey, 'state' AS name, 'integer' AS type, 'value does not fit type' AS reason
FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'tags', 'string_array', 'value does not fit type' FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, 'created_at', 'datetime', 'value does not fit type' FROM orders WHERE o_orderpriority = '5-LOW'
UNION ALL SELECT o_orderkey, '', 'boolean', 'missing name' FROM orders WHERE o_orderpriority = '3-MEDIUM'
UNION ALL SELECT o_orderkey, 'level', CASE WHEN o_orderpriority = '2-HIGH' THEN 'money' ELSE 'integer' END,
  CASE WHEN o_orderstatus = 'F' THEN 'missing value' ELSE 'unknown type' END
FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '2-HIGH'""",
    "feature_save": """
SELECT CAST(o_orderkey AS VARCHAR) AS payload_number,
  CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderstatus = 'F'
         THEN 'new ' || CAST(o_custkey AS VARCHAR)
       WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'old ' || CAST(o_custkey AS VARCHAR)
       ELSE 'none' END AS simple,
  CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 'new graph' ELSE 'old graph' END AS graph
FROM orders""",
    "score_rules": f"WITH {SIMPLE}, {RULE_FLAGS} SELECT payload_number, total_score, triggered FROM scored",
    "triggered_long": f"""
WITH {SIMPLE}, {RULE_FLAGS}
SELECT payload_number, total_score, unnest(string_split(triggered, ',')) AS rule, triggered_count
FROM scored WHERE triggered <> ''""",
    "score_channels": f"""
WITH {DIRECT}, {_reach(10, 200)}, {SIMPLE},
rows_ AS MATERIALIZED (
  SELECT s.*, coalesce(c.connected_transaction_count, 0) AS cc, coalesce(d.direct_connection_count, 0) AS dc
  FROM simple s LEFT JOIN direct d ON d.payload_number = s.payload_number
  LEFT JOIN connected c ON c.payload_number = s.payload_number)
{_channels("rows_")}""",
    "process_orders": f"""
WITH {DIRECT}, {_reach(10, 200)}, {SIMPLE},
rows_ AS MATERIALIZED (
  SELECT s.*, coalesce(c.connected_transaction_count, 0) AS cc, coalesce(d.direct_connection_count, 0) AS dc
  FROM simple s LEFT JOIN direct d ON d.payload_number = s.payload_number
  LEFT JOIN connected c ON c.payload_number = s.payload_number)
{_channels("rows_")}""",
    "affected": f"WITH {CONNECTED}, {AFFECTED} SELECT payload_number FROM affected",
    "recalculate": f"""
WITH {DIRECT}, {_hops(DEPTH)}, {AFFECTED}, {SIMPLE},
counted AS (SELECT root AS payload_number, least(count(*), 200) AS n FROM best GROUP BY root),
rows_ AS MATERIALIZED (
  SELECT s.*, coalesce(c.n, 0) AS cc, coalesce(d.direct_connection_count, 0) AS dc
  FROM simple s JOIN affected a ON a.payload_number = s.payload_number
  LEFT JOIN direct d ON d.payload_number = s.payload_number
  LEFT JOIN counted c ON c.payload_number = s.payload_number)
{_channels("rows_")}""",
    "pending_depth": "SELECT count(*) AS pending FROM orders WHERE o_orderstatus <> 'F'",
    "run_totals": "SELECT event_type AS status, count(*) AS runs FROM events GROUP BY event_type",
    "run_rate": """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS status,
       count(*) AS runs, count(*) / 3600 AS per_second FROM events GROUP BY 1, 2""",
    "run_percentiles": """
SELECT event_type AS stage, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95,
       round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""",
    "run_histogram": """
SELECT event_type AS stage,
  count(*) FILTER (value <= 0.01) AS le_0_01, count(*) FILTER (value <= 0.025) AS le_0_025,
  count(*) FILTER (value <= 0.05) AS le_0_05, count(*) FILTER (value <= 0.1) AS le_0_1,
  count(*) FILTER (value <= 0.25) AS le_0_25, count(*) FILTER (value <= 0.5) AS le_0_5,
  count(*) FILTER (value <= 1) AS le_1, count(*) FILTER (value <= 2.5) AS le_2_5,
  count(*) FILTER (value <= 5) AS le_5, count(*) FILTER (value <= 10) AS le_10,
  count(*) AS le_inf, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS sum_seconds
FROM events GROUP BY event_type""",
    "reject_split": f"""
WITH {DOCUMENTS}
SELECT CASE WHEN reason = 'malformed record' THEN '' ELSE id END AS id, reason FROM docs""",
    "payload_columns": f"""
WITH {DOCUMENTS}
SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS created, id AS order_number,
  CASE o_orderstatus WHEN 'F' THEN 'shipped' WHEN 'O' THEN 'unknown' END AS state,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'phone' WHEN '2-HIGH' THEN 'internet'
       WHEN '3-MEDIUM' THEN 'other' END AS origin,
  90 AS checkout_time,
  strftime(o_orderdate + INTERVAL 90 SECONDS, '%Y-%m-%dT%H:%M:%S+00:00') AS report_date,
  c_name AS billing_first_name,
  CASE WHEN good_account THEN c_mktsegment END AS billing_last_name,
  CASE WHEN good_account THEN lower(replace(c_name, '#', '.')) || '@example.com' END AS billing_email,
  CAST(c_custkey AS VARCHAR) AS customer_number,
  ' ' || c_mktsegment || ' St' AS billing_address_street,
  CAST(n_nationkey AS VARCHAR) AS billing_address_house_number,
  n_name AS billing_address_city, country AS billing_address_country,
  CAST(NULL AS VARCHAR) AS shipment_address_city
FROM docs WHERE reason = 'imported'""",
    "payload_features": f"""
WITH {DOCUMENTS},
baskets AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS id, count(*) AS item_count,
    CAST(sum(CAST(l_extendedprice * l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount,
    string_agg(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), ','
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS amounts,
    string_agg(p_type, ','
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS categories,
    string_agg(CAST(l_partkey AS VARCHAR), ','
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS item_names
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT d.id AS payload_number, coalesce(item_count, 0) AS item_count,
  coalesce(amount, CAST(0 AS DECIMAL(18,2))) AS amount, coalesce(amounts, '') AS amounts,
  coalesce(categories, '') AS categories, '00:00:00' AS order_time, true AS is_new_customer,
  coalesce(amount, 0) > 1000 AS is_high_value,
  CASE WHEN good_account THEN c_name || ' ' || c_mktsegment ELSE c_name END AS full_name,
  c_mktsegment || ' St ' || CAST(n_nationkey AS VARCHAR) || ', ' || n_name || ', ' || country AS single_line,
  coalesce(item_names, '') AS item_names
FROM docs d LEFT JOIN baskets b ON b.id = d.id WHERE reason = 'imported'""",
} | order_oracles.ORACLES
