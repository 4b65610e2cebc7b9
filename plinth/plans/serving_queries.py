"""Queries of the read path, the stored tables and the signals, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators import discovery, resolve, serving, signals, store, stored
from plinth.plans.views import oracle, view
from plinth.sources import clustered, shared
from plinth.streaming import jobs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the oracle over the views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add


def _stored(spark: SparkSession, d: str) -> list[DataFrame]:
    return [view(spark, d, v) for v in ("v_lead", "v_document", "v_lead_parcel", "v_parcel")]


def detail(spark: SparkSession, d: str) -> DataFrame:
    return serving.leads_detail(*_stored(spark, d))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return serving.leads_facts(*_stored(spark, d))


NESTED = """
nested AS (
  SELECT lead_id, count(*) AS n, string_agg(apn, '; ' ORDER BY apn) AS apns, min(first) AS first_apn,
         max(CASE WHEN apn = first THEN max_units END) AS first_units, max(CASE WHEN apn = first THEN address END) AS first_address, max(CASE WHEN apn = first THEN city END) AS first_city,
         string_agg(address, ', ' ORDER BY apn) FILTER (WHERE apn <> first) AS others,
         string_agg(address, '; ' ORDER BY apn) AS addresses, string_agg(coalesce(current_zoning, ''), '; ' ORDER BY apn) AS cur, string_agg(coalesce(proposed_zoning, ''), '; ' ORDER BY apn) AS prop
  FROM (SELECT lp.lead_id, p.*, min(apn) OVER (PARTITION BY lp.lead_id) AS first FROM v_lead_parcel lp JOIN v_parcel p ON lp.parcel_id = p.parcel_id) GROUP BY lead_id
), detail AS (
  SELECT l.*, d.file_url, d.city_name AS jurisdiction, coalesce(n, 0) AS n, coalesce(apns, '') AS apns, first_units, first_address, first_city, first_apn, coalesce(addresses, '') AS addresses, coalesce(others, '') AS others, coalesce(cur, '') AS cur, coalesce(prop, '') AS prop
  FROM v_lead l JOIN v_document d ON l.document_id = d.document_id LEFT JOIN nested ON l.lead_id = nested.lead_id
)
"""
#: names the views, so that ``oracle`` adds them
_USES = "-- v_lead v_document v_lead_parcel v_parcel\n"


def _with(select: str) -> str:
    return "WITH " + NESTED.strip() + "\n" + _USES + select


@query(_with("SELECT lead_id, file_url AS agenda_source_url, jurisdiction, CAST(n AS BIGINT) AS n_parcels, apns, CAST(coalesce(first_units, 0) AS BIGINT) AS first_units FROM detail"))
def j1_leads_detail(spark, d):
    return detail(spark, d).select("lead_id", "agenda_source_url", "jurisdiction", F.size("parcels").cast("long").alias("n_parcels"), F.array_join(F.transform("parcels", lambda p: p["apn"]), "; ").alias("apns"), serving.first_units().cast("long").alias("first_units"))


_SLICE = "signal_strength IN ('HIGH', 'MED') AND jurisdiction IN ('NATION_1', 'NATION_4', 'NATION_9', 'NATION_16', 'NATION_20') AND (meeting_date IS NULL OR (meeting_date >= DATE '1996-01-01' AND meeting_date <= DATE '2000-12-31'))"
_CHOSEN = {"cities": ["NATION_1", "NATION_4", "NATION_9", "NATION_16", "NATION_20"], "scores": ["HIGH", "MED"], "start": "1996-01-01", "end": "2000-12-31"}


@query(_with(f"SELECT lead_id, jurisdiction, signal_strength, meeting_date, CAST(n AS BIGINT) AS n_parcels FROM detail WHERE {_SLICE} ORDER BY meeting_date DESC NULLS LAST, created_at DESC, lead_id"))
def leads_minimum_slice(spark, d):
    """All leads that the facets keep, newest first."""
    kept = serving.leads_facts(*_stored(spark, d), serving.facets(**_CHOSEN))
    return kept.orderBy(*serving.sort_keys("recent", F.col("units"))).select("lead_id", "jurisdiction", "signal_strength", "meeting_date", "n_parcels")


@query(_with(f"SELECT lead_id, lead_type, meeting_date FROM detail WHERE {_SLICE}"))
def f3_facet_filter(spark, d):
    leads, documents, _, _ = _stored(spark, d)
    return serving.apply_filters(serving.sourced(leads, documents), **_CHOSEN).select("lead_id", "lead_type", "meeting_date")


@query(_with("SELECT lead_id, CAST(coalesce(first_units, 0) AS BIGINT) AS units FROM detail ORDER BY coalesce(first_units, 0) DESC, created_at DESC, lead_id"))
def r6_top_yield(spark, d):
    """All leads by yield."""
    return facts(spark, d).orderBy(*serving.sort_keys("yield", F.col("units"))).select("lead_id", F.col("units").cast("long").alias("units"))


@query("SELECT lead_id, signal_strength, created_at FROM v_lead WHERE signal_strength = 'HIGH' ORDER BY created_at DESC, lead_id")
def r1_recent_high_leads(spark, d):
    return view(spark, d, "v_lead").where("signal_strength = 'HIGH'").orderBy(F.col("created_at").desc(), "lead_id").select("lead_id", "signal_strength", "created_at")


@query(_with(f"SELECT CAST(coalesce(sum(CASE WHEN signal_strength <> 'EXCLUDED' THEN coalesce(first_units, 0) END), 0) AS BIGINT) AS regional_pipeline, count(*) FILTER (WHERE signal_strength IN ('HIGH', 'MED')) AS high_yield_signals, count(*) FILTER (WHERE signal_strength <> 'EXCLUDED') AS active_leads, count(*) FILTER (WHERE {_SLICE}) AS visible_leads, count(*) AS total_leads, (SELECT count(*) FROM v_source) AS coverage_area FROM detail"))
def a1_kpis(spark, d):
    return serving.kpis(facts(spark, d), view(spark, d, "v_source"), serving.facets(**_CHOSEN))


@query("SELECT DISTINCT city_name AS jurisdiction FROM v_document ORDER BY jurisdiction")
def a5_jurisdictions(spark, d):
    return view(spark, d, "v_document").select(F.col("city_name").alias("jurisdiction")).distinct().orderBy("jurisdiction")


@query("SELECT apn, address, city, max_units FROM v_parcel WHERE city = 'NATION_1'")
def s2_parcels_of_city(spark, d):
    return view(spark, d, "v_parcel").where("city = 'NATION_1'").select("apn", "address", "city", "max_units")


@query("SELECT apn, address, city FROM v_parcel WHERE apn = '100-000-042'")
def s3_parcel_lookup(spark, d):
    return view(spark, d, "v_parcel").where("apn = '100-000-042'").select("apn", "address", "city").limit(1)


_ASKED = ["100-000-042", "100-000-007", "100-000-150", "100-001-999", "555-000-001"]


@query(f"SELECT apn, address, city FROM v_parcel WHERE apn IN ({', '.join(repr(a) for a in _ASKED)})")
def s3_clustered_lookup(spark, d):
    """Several parcels from a table that is clustered by APN; some of those asked for aren't there."""
    path = shared.new_path(spark)
    clustered.write_clustered(view(spark, d, "v_parcel"), "apn", path)
    return clustered.lookup(spark, path, "apn", _ASKED).select("apn", "address", "city")


@query("SELECT 'elsewhere' AS stored, 0 AS n_leads UNION ALL SELECT 'here', count(*) FROM v_lead")
def s5_no_leads(spark, d):
    """Without stored tables no leads are served; with them, all are."""
    count = lambda kept, name: serving.served(view(spark, d, "v_lead"), kept).agg(F.lit(name).alias("stored"), F.count("*").alias("n_leads"))
    return count(True, "elsewhere").unionByName(count(False, "here"))


@query("SELECT concat(jurisdiction, CASE WHEN jurisdiction LIKE '%County' THEN ' Board of Supervisors' ELSE ' City Council' END) AS name, jurisdiction AS city, listing_url, source_type FROM (SELECT CASE WHEN jurisdiction = 'NATION_7' THEN 'NATION_7 County' ELSE jurisdiction END AS jurisdiction, listing_url, source_type FROM v_source)")
def s6_sources(spark, d):
    """One of the sources is a county."""
    s = view(spark, d, "v_source").withColumn("jurisdiction", F.when(F.col("jurisdiction") == "NATION_7", "NATION_7 County").otherwise(F.col("jurisdiction")))
    return s.select(serving.source_name(F.col("jurisdiction")).alias("name"), F.col("jurisdiction").alias("city"), "listing_url", "source_type")


_Q = "CASE WHEN regexp_matches({0}, '[\",\\n]') THEN concat('\"', replace({0}, '\"', '\"\"'), '\"') ELSE {0} END"
_FIELDS = ["coalesce(CAST(meeting_date AS VARCHAR), '')", "jurisdiction", "lead_type", "addresses", "apns", "coalesce(entitlement_type, '')", "cur", "prop", "coalesce(CAST(first_units AS VARCHAR), '')", "signal_strength"]


@query(_with(f"SELECT lead_id, concat_ws(',', {', '.join(_Q.format(f) for f in _FIELDS)}) AS line FROM detail UNION ALL SELECT NULL, 'Meeting Date,Jurisdiction,Lead Type,Site Address,APN,Entitlement Type,Current Zoning,Proposed Zoning,Max Unit Yield,Signal Score'"))
def k1_lead_csv(spark, d):
    return serving.lead_csv(detail(spark, d))


_OWNED = "FROM v_lead_parcel lp JOIN v_parcel p ON lp.parcel_id = p.parcel_id JOIN v_lead l ON lp.lead_id = l.lead_id"


@query(
    f"""SELECT lp.lead_id, row_number() OVER (PARTITION BY lp.lead_id ORDER BY apn) AS "row", concat('"', apn, '","', address, '","', coalesce(owner_name, ''), '","', coalesce(owner_address, ''), '"') AS line {_OWNED}
UNION ALL SELECT DISTINCT lp.lead_id, 0, '"APN","Address","Owner Name","Owner Address"' {_OWNED}"""
)
def k2_owner_csv(spark, d):
    return serving.owner_csv(detail(spark, d))


_DISTRICTS = "CASE WHEN affected_districts IS NULL THEN 'Citywide' ELSE array_to_string(affected_districts, ', ') END"


@query(
    _with(
        f"""SELECT lead_id, coalesce(CAST(meeting_date AS VARCHAR), '—') AS date, CASE WHEN n = 0 THEN 'Policy Amendment' ELSE first_address END AS title, CASE WHEN n = 0 THEN {_DISTRICTS} ELSE first_apn END AS subtitle,
CASE WHEN n = 0 THEN {_DISTRICTS} ELSE concat(first_city, ', San Mateo County') END AS place, CASE WHEN n > 1 THEN concat('+', CAST(n - 1 AS VARCHAR), ' more') ELSE '' END AS more, others,
coalesce(entitlement_type, '—') AS entitlement, coalesce('+' || CAST(first_units AS VARCHAR), '—') AS units, CASE WHEN coalesce(page_number, 0) = 0 THEN 'View Agenda PDF' ELSE concat('View Agenda PDF (Page ', CAST(page_number AS VARCHAR), ')') END AS page, strftime(created_at, '%m/%d %H:%M:%S') AS stamp FROM detail"""
    )
)
def p8_display(spark, d):
    return serving.display(detail(spark, d))


@query(
    _with(
        """SELECT lead_id, CASE WHEN lead_type = 'POLICY_AMENDMENT' AND affected_districts IS NOT NULL THEN concat('Policy amendment affecting ', array_to_string(affected_districts, ', ')) WHEN lead_type = 'POLICY_AMENDMENT' THEN concat('Policy amendment: ', keyword)
WHEN n = 1 THEN concat('Matched ''', keyword, ''' near APN ', first_apn) WHEN n > 1 THEN concat('Matched ''', keyword, ''' spanning ', CAST(n AS VARCHAR), ' parcels (', replace(apns, '; ', ', '), ')') END AS summary FROM detail"""
    )
)
def p6_summary(spark, d):
    text = serving.summary(F.col("lead_type"), F.col("keyword"), F.col("affected_districts"), F.transform("parcels", lambda p: p["apn"]))
    return detail(spark, d).select("lead_id", text.alias("summary"))


@query("SELECT jurisdiction, CASE jurisdiction WHEN 'NATION_1' THEN 'NATION_16' WHEN 'NATION_16' THEN 'NATION_1' ELSE concat('NATION_1,NATION_16,', jurisdiction) END AS selected FROM v_source")
def u8_toggle(spark, d):
    chosen = serving.toggle(F.array(F.lit("NATION_1"), F.lit("NATION_16")), F.col("jurisdiction"))
    return view(spark, d, "v_source").select("jurisdiction", F.array_join(chosen, ",").alias("selected"))


_FOLD = """
WITH w AS (SELECT *, max(strength_rank) OVER (PARTITION BY document_id, apn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM v_signal WHERE apn IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id, apn ORDER BY CASE WHEN best IS NULL OR strength_rank > best THEN 0 ELSE 1 END, CASE WHEN best IS NULL OR strength_rank > best THEN -strength_rank ELSE seq END) AS o FROM w),
deduped AS (
SELECT document_id, apn, arg_min(seq, o) AS seq, arg_min(strength_rank, o) AS strength_rank, arg_min(current_zoning, o) FILTER (WHERE current_zoning IS NOT NULL) AS current_zoning, arg_min(unit_count, o) FILTER (WHERE unit_count IS NOT NULL) AS unit_count, min(seq) AS first_seq
FROM r GROUP BY document_id, apn
UNION ALL SELECT document_id, apn, seq, strength_rank, current_zoning, unit_count, seq FROM v_signal WHERE apn IS NULL)
"""


def _deduped(spark, d):
    return signals.dedupe_by_apn(view(spark, d, "v_signal").select("document_id", "seq", "apn", "strength_rank", "current_zoning", "unit_count"), ["current_zoning", "unit_count"])


@query(_FOLD + "SELECT document_id, apn, seq, strength_rank, current_zoning, unit_count, first_seq FROM deduped")
def a7_dedupe_by_apn(spark, d):
    return _deduped(spark, d)


_CLASS = "classes AS (SELECT p.document_id, CASE WHEN coalesce(max(n), 0) > 1 OR bool_or(lower(page_text) LIKE '%denied%') THEN 'POLICY_ORDINANCE' ELSE 'SINGLE_SITE_APPLICATION' END AS classification FROM v_agenda_page p LEFT JOIN (SELECT document_id, count(DISTINCT apn) AS n FROM v_signal GROUP BY document_id) s ON p.document_id = s.document_id GROUP BY p.document_id)\n"


def _classes(spark, d):
    return signals.classify(view(spark, d, "v_signal"), view(spark, d, "v_agenda_page"), ["denied"])


@query("WITH " + _CLASS + "SELECT * FROM classes")
def x18_classify_document(spark, d):
    return _classes(spark, d)


@query(_FOLD + ", " + _CLASS + "SELECT dd.document_id, dd.seq, dd.apn, dd.strength_rank, classification FROM deduped dd JOIN classes c ON dd.document_id = c.document_id WHERE classification <> 'POLICY_ORDINANCE' OR strength_rank <> 4")
def f6_suppress_excluded(spark, d):
    return signals.suppress_excluded(_deduped(spark, d), _classes(spark, d)).select("document_id", "seq", "apn", "strength_rank", "classification")


@query("SELECT document_id, bool_or(apn IS NOT NULL) AS has_apn, arg_min(unit_count, seq) FILTER (WHERE unit_count IS NOT NULL) AS first_units, arg_min(meeting_date, seq) FILTER (WHERE meeting_date IS NOT NULL) AS first_date, count(*) FILTER (WHERE strength_rank = 4) AS n_excluded, count(DISTINCT apn) AS n_apns FROM v_signal GROUP BY document_id")
def a9_document_facts(spark, d):
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return view(spark, d, "v_signal").groupBy("document_id").agg(F.bool_or(F.col("apn").isNotNull()).alias("has_apn"), first("unit_count").alias("first_units"), first("meeting_date").alias("first_date"), F.count_if(F.col("strength_rank") == 4).alias("n_excluded"), F.count_distinct("apn").alias("n_apns"))


@query("SELECT city_name, max(document_id) AS document_id, arg_max(CASE WHEN meeting_date IS NULL THEN 'undated' ELSE CAST(meeting_date AS VARCHAR) END, document_id) AS meeting_date FROM v_document GROUP BY city_name")
def w1_upsert_documents(spark, d):
    last = store.upsert_last(view(spark, d, "v_document").withColumn("seq", F.col("document_id")), "city_name", "seq")
    return last.select("city_name", "document_id", F.coalesce(F.col("meeting_date").cast("string"), F.lit("undated")).alias("meeting_date"))


@query("SELECT lead_id, document_id FROM v_lead WHERE document_id NOT IN (SELECT document_id FROM v_document WHERE processed_status = 'PROCESSED')")
def w2_purge_leads(spark, d):
    return store.purge(view(spark, d, "v_lead"), view(spark, d, "v_document").where("processed_status = 'PROCESSED'"), "document_id").select("lead_id", "document_id")


@query("SELECT lead_id, parcel_id FROM v_lead_parcel WHERE lead_id NOT IN (SELECT lead_id FROM v_lead WHERE signal_strength = 'EXCLUDED')")
def w2_cascade_junction(spark, d):
    return store.purge(view(spark, d, "v_lead_parcel"), view(spark, d, "v_lead").where("signal_strength = 'EXCLUDED'"), "lead_id").select("lead_id", "parcel_id")


@query("SELECT apn, min(parcel_id) AS parcel_id FROM (SELECT apn, parcel_id FROM v_parcel WHERE current_zoning IS NOT NULL UNION ALL SELECT apn, parcel_id + 1000000 FROM v_parcel) GROUP BY apn")
def w3_insert_parcels(spark, d):
    """Parcels with a zoning are stored; all come again under new ids, which only the others take."""
    p = view(spark, d, "v_parcel").select("apn", "parcel_id", "current_zoning")
    new = p.withColumn("parcel_id", F.col("parcel_id") + 1000000).withColumn("seq", F.col("parcel_id"))
    return store.insert_absent(p.where("current_zoning IS NOT NULL").withColumn("seq", F.lit(0).cast("long")), new, "apn", "seq").select("apn", "parcel_id")


_VIEWS_OF_INGEST = "-- v_signal v_document v_parcel v_lead v_lead_parcel\n"
_INGEST = """
WITH doc AS (SELECT * FROM v_document WHERE processed_status = 'PENDING'),
hit AS (SELECT s.document_id, seq, p.apn, upper(p.city) = upper(d.city_name) AS here FROM v_signal s JOIN doc d ON s.document_id = d.document_id JOIN v_parcel p ON upper(p.address) LIKE concat('%', upper(s.address), '%') WHERE s.apn IS NULL AND s.address IS NOT NULL AND lead_type <> 'POLICY_AMENDMENT'),
any_here AS (SELECT *, bool_or(here) OVER (PARTITION BY document_id, seq) AS is_local FROM hit),
found AS (SELECT document_id, seq, list(DISTINCT apn ORDER BY apn) AS apns FROM any_here WHERE here OR NOT is_local GROUP BY document_id, seq),
dated AS (SELECT document_id, arg_min(meeting_date, seq) FILTER (WHERE meeting_date IS NOT NULL) AS document_date FROM v_signal GROUP BY document_id),
s AS (SELECT v.*, d.city_name, document_date, CASE WHEN lead_type = 'POLICY_AMENDMENT' THEN [] WHEN apn IS NOT NULL THEN [apn] ELSE coalesce(apns, []) END AS own FROM v_signal v JOIN doc d ON v.document_id = d.document_id JOIN dated ON v.document_id = dated.document_id LEFT JOIN found f ON v.document_id = f.document_id AND v.seq = f.seq),
new AS (SELECT concat(CAST(document_id AS VARCHAR), '-s', CAST(seq AS VARCHAR)) AS lead_id, * FROM s WHERE lead_type = 'POLICY_AMENDMENT' OR len(own) > 0)
"""


def _ingested(spark, d, times: int = 1) -> store.Tables:
    """The stored tables after the pending documents have been ingested."""
    leads, docs, links, parcels = _stored(spark, d)
    tables = store.Tables(docs, parcels, leads, links)
    pending, found = docs.where("processed_status = 'PENDING'").select("document_id", "city_name", "file_url"), view(spark, d, "v_signal")
    # Only what the ingest takes, written once: each table that it gives asks for the signals and the APNs more than once.
    found = shared.materialize(found.join(pending, "document_id", "left_semi"))
    asked = found.where("apn IS NULL AND address IS NOT NULL").join(pending, "document_id").select(F.struct("document_id", "seq").alias("ask_id"), "address", F.col("city_name").alias("city"))
    resolved = shared.materialize(resolve.by_address(asked, parcels).select("ask_id.*", "apns"))
    for _ in range(times):
        tables = store.persist(tables, pending, found, resolved)
    return tables


_LEAD_ROWS = """SELECT lead_id, document_id, lead_type, CASE WHEN lead_type = 'POLICY_AMENDMENT' AND affected_districts IS NOT NULL THEN concat('Policy amendment affecting ', array_to_string(affected_districts, ', ')) WHEN lead_type = 'POLICY_AMENDMENT' THEN concat('Policy amendment: ', keyword)
WHEN len(own) = 1 THEN concat('Matched ''', keyword, ''' near APN ', own[1]) ELSE concat('Matched ''', keyword, ''' spanning ', CAST(len(own) AS VARCHAR), ' parcels (', array_to_string(own, ', '), ')') END AS summary, coalesce(meeting_date, document_date) AS meeting_date, page_number FROM new
UNION ALL SELECT lead_id, document_id, lead_type, NULL, meeting_date, page_number FROM v_lead WHERE document_id NOT IN (SELECT document_id FROM doc)"""
_LEADS = _INGEST + _VIEWS_OF_INGEST + _LEAD_ROWS
_LINK_ROWS = "SELECT lead_id, unnest(own) AS apn FROM new UNION ALL SELECT lp.lead_id, p.apn FROM v_lead_parcel lp JOIN v_parcel p ON lp.parcel_id = p.parcel_id WHERE lp.lead_id NOT IN (SELECT lead_id FROM v_lead WHERE document_id IN (SELECT document_id FROM doc))"
_DOCUMENT_ROWS = """SELECT v.document_id, v.file_url, CASE WHEN doc.document_id IS NOT NULL THEN 'PROCESSED' ELSE v.processed_status END AS processed_status, CASE WHEN doc.document_id IS NOT NULL THEN document_date ELSE v.meeting_date END AS meeting_date, CASE WHEN doc.document_id IS NOT NULL THEN coalesce(n, 0) END AS leads_found
FROM v_document v LEFT JOIN doc ON v.document_id = doc.document_id LEFT JOIN dated ON v.document_id = dated.document_id LEFT JOIN per ON v.document_id = per.document_id"""
_FIRST_SITES = """sites AS (SELECT unnest(own) AS apn, document_id, seq, coalesce(address, concat('Unmatched — parsed from page ', CAST(page_number AS VARCHAR))) AS address, coalesce(city, city_name) AS city, unit_count FROM new),
first AS (SELECT *, row_number() OVER (PARTITION BY apn ORDER BY document_id, seq) AS i FROM sites WHERE apn NOT IN (SELECT apn FROM v_parcel))"""
_PARCEL_ROWS = "SELECT apn, address, city, unit_count AS max_units FROM first WHERE i = 1 UNION ALL SELECT apn, address, city, max_units FROM v_parcel"


@query(_LEADS)
def w4_insert_leads(spark, d):
    return _ingested(spark, d).leads.select("lead_id", "document_id", "lead_type", "summary", "meeting_date", "page_number")


@query(_INGEST + _VIEWS_OF_INGEST + _LINK_ROWS)
def w5_insert_junction(spark, d):
    t = _ingested(spark, d)
    return t.lead_parcels.join(t.parcels.select("parcel_id", "apn"), "parcel_id").select("lead_id", "apn")


@query(_INGEST + ", per AS (SELECT document_id, count(*) AS n FROM new GROUP BY document_id)\n" + _VIEWS_OF_INGEST + _DOCUMENT_ROWS)
def w6_mark_processed(spark, d):
    return _ingested(spark, d).documents.select("document_id", "file_url", "processed_status", "meeting_date", "leads_found")


@query(_INGEST + ", " + _FIRST_SITES + "\n" + _VIEWS_OF_INGEST + _PARCEL_ROWS)
def w10_persist_parcels(spark, d):
    """Stored parcels stay as they are; those that only signals name come as the first of these describes them."""
    return _ingested(spark, d).parcels.select("apn", "address", "city", "max_units")


@query(_LEADS)
def z7_reingest(spark, d):
    """Two ingests of the same documents leave what one does."""
    return _ingested(spark, d, 2).leads.select("lead_id", "document_id", "lead_type", "summary", "meeting_date", "page_number")


_TEXT = "concat_ws('|', {})"


def _cells(*columns: str, cast: str = "VARCHAR") -> str:
    return _TEXT.format(", ".join(f"coalesce(CAST({c} AS {cast}), '-')" for c in columns))


_STORED = {
    "documents": ("file_url", ["document_id", "processed_status", "meeting_date", "leads_found"]),
    "parcels": ("apn", ["address", "city", "max_units"]),
    "leads": ("lead_id", ["document_id", "lead_type", "summary", "meeting_date", "page_number"]),
    "lead_parcels": ("lead_id", ["apn"]),
}


def _stored_sql(name: str, select: str) -> str:
    key, columns = _STORED[name]
    return f"SELECT '{name}' AS stored, {key} AS row_key, {_cells(*columns)} AS content FROM ({select})"


@query(
    _INGEST
    + f""", per AS (SELECT document_id, count(*) AS n FROM new GROUP BY document_id), {_FIRST_SITES}, rows AS (
{_stored_sql("documents", _DOCUMENT_ROWS)} UNION ALL {_stored_sql("parcels", _PARCEL_ROWS)} UNION ALL {_stored_sql("leads", _LEAD_ROWS)} UNION ALL {_stored_sql("lead_parcels", _LINK_ROWS)})
{_VIEWS_OF_INGEST}SELECT * FROM rows"""
)
def k3_stored_tables(spark, d):
    """All rows of the stored tables after a stream has brought the pending documents in two batches."""
    leads, docs, links, parcels = _stored(spark, d)
    pending, found = docs.where("processed_status = 'PENDING'").select("document_id", "city_name", "file_url"), view(spark, d, "v_signal")
    found = shared.materialize(found.join(pending, "document_id", "left_semi"))  # else each batch numbers all signals again
    root, feed = shared.new_path(spark), shared.new_path(spark)
    like = stored.Batch(pending, found, spark.createDataFrame([], "document_id long, seq long, apns array<string>"))
    held = stored.Stored(spark, root, 8).create(store.Tables(docs, parcels, leads, links), like)
    pending.withColumn("seq", F.col("document_id")).repartition(2, "document_id").write.parquet(feed)
    rows = spark.readStream.schema(spark.read.parquet(feed).schema).option("maxFilesPerTrigger", 1).parquet(feed)
    stored.ingest_stream(held, rows, lambda batch: found.join(batch.select("document_id"), "document_id", "left_semi"), "pending").awaitTermination()
    tables = {name: held.read(name) for name in _STORED}
    tables["lead_parcels"] = tables["lead_parcels"].join(tables["parcels"].select("parcel_id", "apn"), "parcel_id")
    out = [t.select(F.lit(name).alias("stored"), F.col(_STORED[name][0]).alias("row_key"), F.expr(_cells(*_STORED[name][1], cast="STRING")).alias("content")) for name, t in tables.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT document_id, seq, parcel_id FROM v_signal s JOIN v_parcel p ON s.apn = p.apn")
def j3_resolve_apns(spark, d):
    return view(spark, d, "v_signal").join(view(spark, d, "v_parcel").select("apn", "parcel_id"), "apn").select("document_id", "seq", "parcel_id")


@query("SELECT lead_id FROM (SELECT *, max(created_at) OVER (PARTITION BY document_id, meeting_date) AS newest FROM v_lead) WHERE meeting_date IS NULL OR created_at >= newest")
def w7_drop_older_siblings(spark, d):
    return store.drop_older_siblings(view(spark, d, "v_lead"), ["document_id", "meeting_date"], "created_at").select("lead_id")


@query("SELECT lead_id, parcel_id FROM v_lead_parcel WHERE parcel_id IS NOT NULL")
def w8_backfill_junction(spark, d):
    return view(spark, d, "v_lead_parcel").where("parcel_id IS NOT NULL").select("lead_id", "parcel_id")


@query("SELECT document_id, file_url FROM v_document WHERE file_url NOT IN (SELECT file_url FROM v_document WHERE processed_status = 'PROCESSED')")
def j4_new_documents(spark, d):
    docs = view(spark, d, "v_document")
    return jobs.unseen(docs.select("document_id", "file_url"), docs.where("processed_status = 'PROCESSED'"))


@query("SELECT document_id, meeting_date FROM v_document WHERE meeting_date IS NULL OR (meeting_date >= DATE '1995-01-01' AND meeting_date <= DATE '1995-01-31')")
def f13_date_window(spark, d):
    date = F.col("meeting_date")
    return view(spark, d, "v_document").where(date.isNull() | date.between(F.lit("1995-01-01").cast("date"), F.lit("1995-01-31").cast("date"))).select("document_id", "meeting_date")


def _swept(spark, d) -> tuple[DataFrame, DataFrame]:
    """The staff reports that were found, and those of them that a sweep starts jobs for; downloads of failed ones fail."""
    docs = view(spark, d, "v_document").where("document_type = 'STAFF_REPORT'")
    found = docs.select(F.col("document_id").alias("place"), F.col("file_url").alias("pdf_url"), F.lit(None).cast("string").alias("title"))
    return found, discovery.sweep(found, docs.where("processed_status = 'FAILED'").select(F.col("file_url").alias("pdf_url")), 50)


@query("SELECT document_id AS place, file_url AS pdf_url, file_url AS title FROM v_document WHERE document_type = 'STAFF_REPORT' AND processed_status <> 'FAILED' ORDER BY document_id LIMIT 50")
def r8_sweep_cap(spark, d):
    """The cap counts downloads that succeed."""
    return _swept(spark, d)[1]


@query("""WITH e AS (SELECT *, min(CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN seq END) OVER (PARTITION BY job_id) AS first_end, max(CASE WHEN status IN ('completed', 'failed') THEN seq END) OVER (PARTITION BY job_id) AS last_hard FROM v_job_event)
SELECT job_id, CASE WHEN max(last_hard) IS NOT NULL THEN max(CASE WHEN seq = last_hard THEN status END) WHEN max(first_end) IS NOT NULL THEN 'cancelled' ELSE 'processing' END AS status, count(*) AS n_events FROM e GROUP BY job_id""")
def z3_job_states(spark, d):
    return store.job_states(view(spark, d, "v_job_event"))


@query("SELECT jurisdiction, CAST(y AS INTEGER) AS year, concat(listing_url, '?year=', CAST(y AS VARCHAR)) AS url FROM v_source, (SELECT unnest([2025, 2026]) AS y) WHERE source_type = 'api'")
def u4_years_spanning(spark, d):
    years = F.explode(F.sequence(F.year(F.lit("2025-12-15").cast("date")), F.year(F.lit("2026-01-15").cast("date"))))
    return view(spark, d, "v_source").where("source_type = 'api'").withColumn("year", years).select("jurisdiction", "year", F.concat("listing_url", F.lit("?year="), F.col("year").cast("string")).alias("url"))


@query("SELECT jurisdiction, source_type, CASE WHEN jurisdiction IN ('NATION_1', 'NATION_8') THEN 2 ELSE 1 END AS n FROM v_source")
def f17_targeted_sources(spark, d):
    """Each source counts once for a sweep of all, and once more if it is named."""
    s = view(spark, d, "v_source").withColumn("name", serving.source_name(F.col("jurisdiction")))
    both = discovery.targeted(s, None).unionByName(discovery.targeted(s, ["NATION_1 City Council", "NATION_8 City Council", "no such source"]))
    return both.groupBy("jurisdiction", "source_type").agg(F.count("*").alias("n"))


@query("SELECT s.document_id, seq, apn, coalesce(address, concat('Unmatched — parsed from page ', CAST(page_number AS VARCHAR))) AS address, coalesce(city, city_name) AS city, current_zoning, proposed_zoning, unit_count AS max_units FROM v_signal s JOIN v_document d ON s.document_id = d.document_id WHERE apn IS NOT NULL")
def p4_fallback_parcels(spark, d):
    return serving.fallback_parcels(view(spark, d, "v_signal"), view(spark, d, "v_document"))


@query("SELECT d.document_id, count(l.lead_id) AS n_leads, CASE WHEN count(l.lead_id) = 0 THEN 'Scan complete. No actionable development leads found in recent agendas.' END AS message FROM v_document d LEFT JOIN v_lead l ON d.document_id = l.document_id AND l.signal_strength = 'HIGH' GROUP BY d.document_id")
def w11_zero_lead_messages(spark, d):
    return serving.zero_lead_messages(view(spark, d, "v_document"), view(spark, d, "v_lead").where("signal_strength = 'HIGH'"))


@query("""WITH f AS (SELECT document_id, file_url, processed_status FROM v_document WHERE document_type = 'STAFF_REPORT'), j AS (SELECT * FROM f WHERE processed_status <> 'FAILED' ORDER BY document_id LIMIT 50)
SELECT (SELECT count(*) FROM f) AS documents_found, count(*) AS jobs_started, string_agg(file_url, ' ' ORDER BY document_id) AS jobs FROM j""")
def a12_run_summary(spark, d):
    return discovery.run_summary(*_swept(spark, d)).withColumn("jobs", F.array_join("jobs", " "))
