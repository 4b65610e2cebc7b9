"""Domain views over the driver's tables, as SQL that Spark and DuckDB both run.

Each view is a template whose ``{table}`` names are DataFrames in Spark and table names in the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from plinth.sources.tables import table

VIEWS = {
    "v_source": """
        SELECT n_name AS jurisdiction,
               CASE n_nationkey % 4 WHEN 0 THEN 'direct_pdf' WHEN 1 THEN 'granicus_dom' WHEN 2 THEN 'civicplus_dom' ELSE 'api' END AS source_type,
               concat('https://portal.example/', lower(n_name), '/agendas') AS listing_url
        FROM {nation}""",
    "v_document": """
        SELECT o_orderkey AS document_id, n_name AS city_name,
               CASE o_orderkey % 3 WHEN 0 THEN 'CITY_COUNCIL_AGENDA' WHEN 1 THEN 'STAFF_REPORT' ELSE 'OTHER' END AS document_type,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS meeting_date,
               concat('https://portal.example/', n_name, '/', CAST(o_orderkey AS STRING), '.pdf') AS file_url,
               CASE o_orderstatus WHEN 'P' THEN 'PROCESSED' WHEN 'F' THEN 'FAILED' ELSE 'PENDING' END AS processed_status
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "v_parcel": """
        SELECT p_partkey AS parcel_id,
               concat(substr(CAST(100000000 + p_partkey AS STRING), 1, 3), '-', substr(CAST(100000000 + p_partkey AS STRING), 4, 3), '-', substr(CAST(100000000 + p_partkey AS STRING), 7, 3)) AS apn,
               concat(CAST(p_partkey + 1 AS STRING), ' ', p_name, ' St') AS address, n_name AS city,
               CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE concat('R-', CAST(p_size % 5 + 1 AS STRING)) END AS current_zoning,
               CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat('RM-', CAST(p_size AS STRING)) END AS proposed_zoning,
               CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS max_units,
               CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE concat(p_brand, ', "LLC"') END AS owner_name,
               CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat(CAST(p_size AS STRING), ' Market St, ', n_name) END AS owner_address, 'San Mateo' AS county
        FROM {part} JOIN {nation} ON p_partkey % 25 = n_nationkey""",
    "v_lead": """
        SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS lead_id, l_orderkey AS document_id,
               CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN 'POLICY_AMENDMENT' ELSE 'SITE_SPECIFIC' END AS lead_type,
               CASE (l_orderkey * 7 + l_linenumber) % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MED' WHEN 2 THEN 'LOW' ELSE 'EXCLUDED' END AS signal_strength,
               CASE WHEN l_orderkey % 6 = 0 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'Rezone' ELSE 'Density Bonus' END AS entitlement_type,
               CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN NULL ELSE CAST(min(l_shipdate) AS DATE) END AS meeting_date,
               min(l_shipdate) AS created_at, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE CAST(min(l_quantity) AS INT) END AS page_number,
               CASE WHEN l_linenumber % 2 = 0 THEN 'rezone' ELSE 'density bonus' END AS keyword,
               CASE l_orderkey % 3 WHEN 0 THEN split('District 1;District 4', ';') WHEN 1 THEN split('Downtown', ';') END AS affected_districts
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "v_lead_parcel": """
        SELECT DISTINCT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS lead_id, l_partkey AS parcel_id
        FROM {lineitem} WHERE (l_orderkey + l_linenumber) % 5 <> 0""",
    "v_signal": """
        SELECT l_orderkey AS document_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS seq,
               CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE concat('100-000-00', CAST(l_partkey % 3 AS STRING)) END AS apn,
               CAST((l_partkey + l_linenumber) % 4 + 1 AS INT) AS strength_rank,
               CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE concat('R-', CAST(l_suppkey % 9 AS STRING)) END AS current_zoning,
               CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(l_quantity AS INT) END AS unit_count,
               CASE (l_partkey + l_linenumber) % 4 + 1 WHEN 4 THEN 'EXCLUDED' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MED' ELSE 'LOW' END AS signal_strength,
               CASE l_partkey % 3 WHEN 0 THEN 'rezone' WHEN 1 THEN 'variance' ELSE 'density bonus' END AS keyword, l_linenumber AS page_number,
               CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE concat(CAST(p_partkey + 1 AS STRING), ' ', p_name, ' St') END AS address,
               CASE WHEN l_suppkey % 4 = 0 THEN 'Elsewhere' END AS city, 'RM-9' AS proposed_zoning, 'excerpt' AS snippet, 'Rezone' AS entitlement_type,
               CASE WHEN l_partkey % 11 = 0 THEN 'POLICY_AMENDMENT' ELSE 'SITE_SPECIFIC' END AS lead_type,
               CASE WHEN l_partkey % 22 = 0 THEN split('District 1;District 2', ';') END AS affected_districts,
               CASE WHEN l_suppkey % 5 = 0 THEN CAST(l_shipdate AS DATE) END AS meeting_date
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "v_agenda_page": """
        SELECT l_orderkey AS document_id, l_linenumber AS page_number,
               concat(CASE l_linenumber % 4 WHEN 0 THEN 'CONSENT CALENDAR' WHEN 1 THEN 'PUBLIC HEARINGS' WHEN 2 THEN 'Exhibit A' ELSE '' END, chr(10),
                      'Item ', CAST(l_linenumber AS STRING), ': ', CASE l_orderkey % 4 WHEN 0 THEN 'Rezone' WHEN 1 THEN 'Density Bonus' WHEN 2 THEN 'Variance' ELSE 'Study' END,
                      ' for ', CAST(min(l_partkey) + 1 AS STRING), ' Oak St', chr(10),
                      CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE concat('APN 100-000-', lpad(CAST(min(l_partkey) % 1000 AS STRING), 3, '0'), ' from R-1 to R-3. ') END,
                      CASE WHEN l_orderkey % 8 = 0 THEN 'The request was denied. ' ELSE '' END,
                      'Clerk 650-555-', lpad(CAST(l_orderkey % 10000 AS STRING), 4, '0')) AS page_text
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "v_ordinance_page": """
        SELECT l_orderkey AS document_id, l_linenumber AS page_number,
               concat(CASE WHEN l_orderkey % 6 = 1 THEN concat('Item ', CAST(l_linenumber AS STRING), ': density bonus')
                           WHEN l_linenumber % 3 = 2 AND l_orderkey % 5 <> 0
                           THEN concat(CASE WHEN l_orderkey % 2 = 0 THEN 'Exhibit B' ELSE 'Attachment C' END, CASE l_orderkey % 3 WHEN 0 THEN ' Sites removed from the program' WHEN 1 THEN ' SB 79 sites' ELSE ' Listed sites' END)
                           ELSE 'Findings' END, chr(10),
                      CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN '' ELSE concat('APN 100-000-', lpad(CAST(min(l_partkey) % 1000 AS STRING), 3, '0'), ' at ', CAST(min(l_partkey) + 1 AS STRING), ' Oak St', chr(10)) END,
                      CASE WHEN l_orderkey % 7 = 0 THEN 'historic site' ELSE 'adopted' END, chr(10), 'Ordinance No. ', CAST(l_orderkey AS STRING), ', call 650-555-', lpad(CAST(l_orderkey % 10000 AS STRING), 4, '0')) AS page_text
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "v_staff_page": """
        SELECT l_orderkey AS document_id, l_linenumber AS page_number,
               concat('PUBLIC HEARINGS', chr(10), 'Item ', CAST(l_linenumber AS STRING), ': Rezone for ',
                      CASE l_orderkey % 3 WHEN 0 THEN '1017 Middlefield Rd' WHEN 1 THEN concat(CAST(min(l_partkey) + 1 AS STRING), ' Oak St') ELSE 'the corner lot' END, chr(10),
                      CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE concat('APN 100-000-', lpad(CAST(min(l_partkey) % 1000 AS STRING), 3, '0'), '. ') END,
                      CASE WHEN l_orderkey % 2 = 0 THEN 'Location' ELSE 'Address' END, ': Parcel ', CAST(l_orderkey AS STRING), ' of the Plan', chr(10), 'End') AS page_text
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "v_job_event": """
        SELECT user_id AS job_id, event_id AS seq,
               CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' ELSE 'processing' END AS status
        FROM {events}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view as a DataFrame."""
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that ``sql`` mentions in front."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    ctes = [f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in used]
    body = sql.strip()
    if ctes and body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body if ctes else body
