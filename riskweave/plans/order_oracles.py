"""SQL of the queries over full order documents, for checking."""

from __future__ import annotations

RICH = """
keys AS (
  SELECT o_orderkey AS o, c_custkey AS c, n_nationkey AS n, c_name, c_mktsegment, c_acctbal, n_name,
         o_orderstatus, o_orderdate + to_seconds(o_orderkey % 86400) AS ordered,
         o_orderkey * 7 % 4000 - 30 AS waited
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderkey % 3 = 0 OR o_orderkey % 19 <> 0),
docs AS (
  SELECT o, c, 'o' || o AS id, c_name,
    strftime(ordered, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o % 5 = 0 THEN '.250' ELSE '' END || '+00:00' AS created,
    CASE WHEN o % 6 <> 2 THEN 'n' || o ELSE 'o' || o END AS order_number,
    CASE o_orderstatus WHEN 'F' THEN 'shipped' WHEN 'O' THEN 'unknown' END AS state,
    CASE WHEN o % 7 <> 6 THEN ['normal', 'express', '12h', 'desiredDate', 'mobileVoucher', 'onSite',
      'printVoucher', 'singlePackage', 'other'][o % 9 + 1] END AS shipment_type,
    ['internet', 'phone', 'mail', 'partnerWebsite', 'shop', 'other'][o % 6 + 1] AS origin,
    CASE WHEN o % 17 = 0 OR waited < 0 THEN NULL
         WHEN o % 5 = 0 AND waited > 0 THEN waited - 1 ELSE waited END AS checkout_time,
    CASE WHEN o % 12 <> 5 THEN 'ref' || (o % 12) END AS referrer,
    CASE WHEN o % 17 <> 0 THEN strftime(ordered + to_seconds(waited), '%Y-%m-%dT%H:%M:%S+00:00') END AS report_date,
    CASE WHEN o % 5 <> 4 THEN 's' || (c % 100) END AS device_ident_site,
    CASE WHEN o % 5 <> 4 AND o % 9 <> 1 THEN 'd' || (o % 997) END AS device_ident_token,
    c_name AS billing_first_name,
    CASE WHEN o % 4 <> 0 THEN c_mktsegment END AS billing_last_name,
    CASE WHEN c % 7 <> 0 THEN strftime(DATE '1950-01-01' + CAST(c * 37 % 18000 AS INTEGER), '%Y-%m-%d') END
      AS billing_date_of_birth,
    CASE WHEN c % 5 <> 0 THEN 'c' || c || '@example.com' END AS billing_email,
    CASE WHEN c % 6 > 1 THEN '+49-' || c || ',+43-' || (c % 10) END AS billing_phone_numbers,
    CASE WHEN c % 8 <> 0 AND c % 10 <> 3 THEN 'a' || c WHEN c % 3 <> 0 THEN 'b' || c ELSE '' END AS customer_number,
    CASE WHEN c % 8 <> 0 THEN strftime(TIMESTAMP '1992-01-01' + to_hours(c % 5000), '%Y-%m-%dT%H:%M:%S+00:00') END
      AS customer_account_created,
    CASE WHEN c % 8 <> 0 THEN ['new', 'existing'][c % 2 + 1] END AS customer_type,
    CASE WHEN c % 8 <> 0 AND c % 9 <> 8 THEN c % 9 END AS customer_number_of_orders,
    CASE WHEN c % 8 <> 0 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS customer_open_balance,
    CASE WHEN o % 11 <> 0 THEN ['invoice', 'creditCard', 'directDebit', 'payPal', 'other'][o % 5 + 1] END
      AS payment_method,
    CASE WHEN o % 11 <> 0 AND o % 13 <> 0 THEN ['activePayment', 'other'][o % 2 + 1] END AS payment_detail_type,
    'St ' || (c % 50) AS billing_address_street,
    CASE WHEN c % 4 <> 1 THEN CAST(n AS VARCHAR) END AS billing_address_house_number,
    n_name AS billing_address_city,
    lpad(CAST(c % 100000 AS VARCHAR), 5, '0') AS billing_address_postal_code,
    ['DE', 'AT', 'CH', 'FR', 'IT'][n % 5 + 1] AS billing_address_country,
    CASE WHEN o % 3 <> 0 THEN 'Dock ' || (o % 20) END AS shipment_address_street,
    CASE WHEN o % 3 <> 0 AND o % 4 <> 2 THEN CAST(o % 9 AS VARCHAR) END AS shipment_address_house_number,
    CASE WHEN o % 3 <> 0 THEN 'Port ' || n END AS shipment_address_city,
    CASE WHEN o % 3 <> 0 AND n % 2 <> 0 THEN 'P' || n END AS shipment_address_postal_code,
    CASE WHEN o % 3 <> 0 THEN ['FR', 'IT'][o % 2 + 1] END AS shipment_address_country,
    CASE WHEN o % 7 <> 3 THEN o % 2 = 0 END AS parcel_shop,
    CASE WHEN o % 4 = 1 THEN ['x' || (o % 3), 'y' || (o % 5)] END AS custom_ids,
    CASE WHEN c % 6 > 1 THEN ['+49-' || c, '+43-' || (c % 10)] ELSE [] END AS phones
  FROM keys)
"""

# The tests of ``order_documents.PAYLOAD_TESTS``, in the same order.
_TESTS = [
    ("created contains", "contains(created, '-07-')"),
    ("order_number in", "order_number IN ('n1', 'n3', 'o2', 'o8', 'n1000')"),
    ("state not_eq", "state <> 'shipped'"),
    ("shipment_type not_in", "shipment_type NOT IN ('express', '12h', 'other')"),
    ("origin eq", "origin = 'other'"),
    ("checkout_time between", "checkout_time BETWEEN 60 AND 1800"),
    ("checkout_time is_null", "checkout_time IS NULL"),
    ("referrer is_null", "referrer IS NULL"),
    ("report_date is_not_null", "report_date IS NOT NULL"),
    ("device_ident_site eq", "device_ident_site = 's7'"),
    ("device_ident_token contains", "contains(device_ident_token, 'd99')"),
    ("billing_first_name contains", "contains(billing_first_name, '#00000001')"),
    ("billing_last_name is_null", "billing_last_name IS NULL"),
    ("billing_date_of_birth contains", "contains(billing_date_of_birth, '1970-')"),
    ("billing_email eq", "billing_email = 'c11@example.com'"),
    ("customer_number eq", "customer_number = ''"),
    ("customer_account_created contains", "contains(customer_account_created, '1992-01-0')"),
    ("customer_type in", "customer_type IN ('new')"),
    ("customer_number_of_orders gte", "customer_number_of_orders >= 3"),
    ("customer_number_of_orders lt", "customer_number_of_orders < 2"),
    ("customer_number_of_orders not_in", "customer_number_of_orders NOT IN (0, 5)"),
    ("customer_open_balance contains", "contains(customer_open_balance, '-')"),
    ("payment_method eq", "payment_method = 'other'"),
    ("payment_detail_type not_eq", "payment_detail_type <> 'other'"),
    ("billing_address_street eq", "billing_address_street = 'St 7'"),
    ("billing_address_house_number is_null", "billing_address_house_number IS NULL"),
    ("billing_address_city in", "billing_address_city IN ('NATION_3', 'NATION_4')"),
    ("billing_address_postal_code contains", "contains(billing_address_postal_code, '0001')"),
    ("billing_address_country not_in", "billing_address_country NOT IN ('DE', 'AT')"),
    ("shipment_address_street eq", "shipment_address_street = 'Dock 5'"),
    ("shipment_address_house_number is_not_null", "shipment_address_house_number IS NOT NULL"),
    ("shipment_address_city contains", "contains(shipment_address_city, 'Port 1')"),
    ("shipment_address_postal_code eq", "shipment_address_postal_code = 'P7'"),
    ("shipment_address_country not_eq", "shipment_address_country <> 'FR'"),
    ("parcel_shop eq", "parcel_shop"),
    ("parcel_shop not_eq", "NOT parcel_shop"),
    ("parcel_shop is_null", "parcel_shop IS NULL"),
    ("custom_ids eq", "list_contains(custom_ids, 'x1')"),
    ("custom_ids not_in", "NOT (list_contains(custom_ids, 'x1') OR list_contains(custom_ids, 'y0'))"),
    ("custom_ids is_null", "custom_ids IS NULL"),
    ("phones contains", "len(list_filter(phones, lambda p: contains(p, '-1'))) > 0"),
    ("phones not_eq", "NOT list_contains(phones, '+43-5')"),
]

_PLACES = ",\n    ".join(
    f"CASE WHEN l_partkey % {i + 2} <> 0 THEN CAST(l_partkey % {10 + i} + {sign * i} AS DOUBLE)"
    f" + l_linenumber * CAST({step} AS DOUBLE) END AS {axis}_{name}"
    for i, name in enumerate(("alpha", "beta", "gamma", "delta"))
    for axis, sign, step in (("long", 1, 0.5), ("lat", -1, 0.25)))
_ATTRIBUTES = ["datetime_alpha", "datetime_beta", *[
    f"{axis}_{name}" for name in ("alpha", "beta", "gamma", "delta") for axis in ("long", "lat")]]

ORACLES = {
    "payload_all": f"""
WITH {RICH}
SELECT * EXCLUDE (o, c, c_name, parcel_shop, custom_ids, phones) FROM docs""",
    "payload_identity": f"""
WITH {RICH}
SELECT id, payment_method AS payment_identifier, coalesce(billing_phone_numbers, '') AS phones,
  CAST(len(phones) AS INTEGER) AS n_phones,
  CASE WHEN o % 3 <> 0 THEN c_name END AS delivery_name,
  CASE WHEN o % 3 <> 0 THEN concat_ws(', ', concat_ws(' ', shipment_address_street, shipment_address_house_number),
    shipment_address_postal_code, shipment_address_city, shipment_address_country) ELSE '' END AS delivery_line
FROM docs""",
    "transaction_projection": f"""
WITH {RICH}
SELECT referrer, id AS payload_number, o % 10 <> 0 AS first_row,
  1 AS schema_version_major, 1 AS schema_version_minor,
  CASE WHEN o % 10 = 0 THEN 'Fraud' END AS fraud_level, CASE WHEN o % 4 = 0 THEN 'checked' END AS comment,
  CASE WHEN o % 3 = 0 THEN '2024-02-01' END AS scored_on, o % 3 = 0 AS processing_complete,
  '2024-01-01' AS created_on
FROM docs""",
    "filter_payload": f"WITH {RICH}\n" + "\nUNION ALL\n".join(
        f"SELECT '{name} {i}' AS test, count(*) AS kept, min(id) AS first_id, max(id) AS last_id "
        f"FROM docs WHERE {test} HAVING count(*) > 0" for i, (name, test) in enumerate(_TESTS)),
    "filter_payload_group": f"""
WITH {RICH}
SELECT order_number, payment_method, customer_number_of_orders, billing_address_country FROM docs
WHERE state = 'shipped' AND billing_address_country IN ('DE', 'AT')
  AND (payment_method = 'invoice' OR customer_number_of_orders > 5)""",
    "document_nodes": f"""
WITH {RICH},
fields AS (
  SELECT 'customer.email' AS matcher, billing_email AS value, 100 AS confidence, 90 AS importance FROM docs
  UNION ALL
  SELECT 'customer.name', concat_ws(' ', billing_first_name, billing_last_name), 80, 50 FROM docs
  UNION ALL
  SELECT 'deviceIdent.token', device_ident_token, 80, 50 FROM docs)
SELECT matcher, value, count(*) AS size, confidence, importance FROM fields WHERE value IS NOT NULL
GROUP BY matcher, value, confidence, importance""",
    "match_attributes": f"""
WITH lines AS (
  SELECT 'item.supplier' AS matcher, CAST(l_suppkey AS VARCHAR) AS value,
    CAST(l_orderkey AS VARCHAR) AS payload_number,
    CASE WHEN l_linenumber % 3 <> 0 THEN o_orderdate + to_seconds(l_partkey % 5) END AS datetime_alpha,
    CASE WHEN l_linenumber % 2 <> 0 THEN o_orderdate + to_seconds(l_partkey % 7) END AS datetime_beta,
    {_PLACES}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY value, payload_number
    ORDER BY {", ".join(f"{c} NULLS LAST" for c in _ATTRIBUTES)}) AS rn FROM lines)
SELECT * EXCLUDE (rn) REPLACE (
  strftime(datetime_alpha, '%Y-%m-%d %H:%M:%S') AS datetime_alpha,
  strftime(datetime_beta, '%Y-%m-%d %H:%M:%S') AS datetime_beta) FROM ranked WHERE rn = 1""",
    "node_lookup": """
SELECT CAST(o_orderkey AS VARCHAR) AS payload_number FROM orders WHERE o_custkey = 1""",
}
