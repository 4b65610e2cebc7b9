"""Queries of the text extraction over the agenda pages, each with its DuckDB oracle where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from plinth.functions import text as t
from plinth.operators import extraction, keywords, tiers
from plinth.plans.views import oracle, view
from plinth.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add


def pages(spark, d):
    return view(spark, d, "v_agenda_page")


_KIND = """
WITH kinds AS (SELECT *, CASE page_number % 4 WHEN 0 THEN 'boilerplate' WHEN 1 THEN 'hearing' WHEN 2 THEN 'exhibit' END AS own FROM v_agenda_page),
k AS (SELECT *, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'unknown') AS kind FROM kinds)
"""


@query("SELECT document_id, page_number, CAST(coalesce(sum(length(page_text) + 1) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_start FROM v_agenda_page")
def n1_page_offsets(spark, d):
    return extraction.page_offsets(pages(spark, d)).select("document_id", "page_number", "page_start")


@query("""WITH s AS (SELECT document_id, page_number, coalesce(sum(length(page_text) + 1) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page_start FROM v_agenda_page),
o AS (SELECT DISTINCT l_orderkey AS document_id, CAST(l_partkey % 400 AS BIGINT) AS "offset" FROM lineitem)
SELECT o.document_id, o."offset", coalesce(arg_max(page_number, page_start) FILTER (WHERE page_start <= o."offset"), arg_min(page_number, page_start)) AS page_number FROM o JOIN s ON o.document_id = s.document_id GROUP BY o.document_id, o."offset" """)
def j8_page_of_offset(spark, d):
    offsets = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_partkey") % 400).alias("offset")).distinct()
    return extraction.page_of_offset(pages(spark, d), offsets)


@query(_KIND + "SELECT document_id, page_number, 0 AS span_start, length(page_text) AS span_end, kind FROM k")
def n2_sections(spark, d):
    return extraction.sections(pages(spark, d)).select("document_id", "page_number", F.explode("spans").alias("s")).select("document_id", "page_number", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.kind").alias("kind"))


@query(_KIND + "SELECT document_id, page_number FROM k WHERE kind IN ('hearing', 'unknown')")
def n5_eligible_pages(spark, d):
    return extraction.sections(pages(spark, d)).where(F.size(extraction.eligible(F.col("spans"))) > 0).select("document_id", "page_number")


@query("SELECT document_id, page_number, instr(page_text, 'Item ') - 1 AS item_start, concat('Item ', CAST(page_number AS VARCHAR)) AS item FROM v_agenda_page")
def x11_item_markers(spark, d):
    return pages(spark, d).select("document_id", "page_number", F.explode(t.matches(F.col("page_text"), t.ITEM)).alias("m")).select("document_id", "page_number", F.col("m.start").cast("long").alias("item_start"), F.col("m.text").alias("item"))


@query("SELECT document_id, page_number, regexp_extract(page_text, '\\d{3}-\\d{3}-\\d{3}\\b', 0) AS apn FROM v_agenda_page WHERE regexp_matches(page_text, '\\b\\d{3}-\\d{3}-\\d{3}\\b')")
def x1_strict_apns(spark, d):
    return pages(spark, d).select("document_id", "page_number", F.explode(F.regexp_extract_all("page_text", F.lit(t.APN), F.lit(1))).alias("apn"))


@query("SELECT document_id, page_number, unnest(regexp_extract_all(page_text, '\\b\\d{3}-\\d{2,3}-\\d{3,4}\\b')) AS number FROM v_agenda_page")
def x3_broad_numbers(spark, d):
    """Broad numbers take telephone numbers for APNs, as the audit of the stored rows found."""
    return pages(spark, d).select("document_id", "page_number", F.explode(F.regexp_extract_all("page_text", F.lit(t.BROAD_APN), F.lit(1))).alias("number"))


@query("SELECT document_id, page_number, 'R-1' AS current_zoning, 'R-3' AS proposed_zoning FROM v_agenda_page WHERE page_text LIKE '% from R-1 to R-3%'")
def x5_zoning_transitions(spark, d):
    return pages(spark, d).where(F.col("page_text").rlike(t.ZONING)).select("document_id", "page_number", F.regexp_extract("page_text", t.ZONING, 1).alias("current_zoning"), F.regexp_extract("page_text", t.ZONING, 2).alias("proposed_zoning"))


@query("SELECT document_id, page_number, regexp_extract(page_text, ' for (\\d+ Oak St)', 1) AS address FROM v_agenda_page")
def x6_addresses(spark, d):
    return pages(spark, d).select("document_id", "page_number", F.explode(F.regexp_extract_all("page_text", F.lit(t.ADDRESS), F.lit(1))).alias("address"))


_SIGNALS = _KIND + """, g AS (
SELECT document_id, page_number, document_id % 4 AS w, document_id % 3 = 0 AS bare, document_id % 8 = 0 AS denied, regexp_extract(page_text, ' for (\\d+ Oak St)', 1) AS addr, regexp_extract(page_text, '100-000-\\d{3}', 0) AS apn0 FROM k WHERE kind IN ('hearing', 'unknown') AND document_id % 4 <> 3)
SELECT document_id, page_number, CASE w WHEN 0 THEN 'rezone' WHEN 1 THEN 'density bonus' ELSE 'variance' END AS keyword,
  CASE WHEN NOT bare THEN apn0 WHEN w IN (0, 1) THEN concat('ADDR: ', addr) END AS apn,
  CASE WHEN denied THEN 'EXCLUDED' WHEN w = 0 THEN 'HIGH' WHEN w = 1 THEN 'MED' ELSE 'LOW' END AS signal_strength,
  CASE WHEN NOT bare OR w IN (0, 1) THEN addr END AS address,
  CASE WHEN NOT bare THEN 'R-1' END AS current_zoning, CASE WHEN NOT bare THEN 'R-3' END AS proposed_zoning FROM g"""


@query(_SIGNALS)
def x17_page_signals(spark, d):
    return extraction.page_signals(pages(spark, d)).select("document_id", "page_number", "keyword", "apn", "signal_strength", "address", "current_zoning", "proposed_zoning")


_PLACED = """
WITH p AS (SELECT *, coalesce(sum(length(page_text) + 1) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page_start FROM {view}),
full_text AS (SELECT document_id, string_agg(page_text, chr(10) ORDER BY page_number) AS txt FROM {view} GROUP BY document_id)
"""


def _around(start: str, end: str) -> str:
    """SQL of a snippet of ``txt`` around [start, end)."""
    return f"trim(replace(substr(txt, CAST(greatest(0, {start} - 160) + 1 AS BIGINT), CAST(least(length(txt), {end} + 160) - greatest(0, {start} - 160) AS BIGINT)), chr(10), ' '))"


@query(
    _PLACED.format(view="v_agenda_page")
    + f""", h AS (SELECT *, lead(page_start) OVER (PARTITION BY document_id ORDER BY page_number) AS next_start FROM p WHERE page_text LIKE 'Exhibit A%'),
e AS (SELECT h.document_id, h.page_start AS s, coalesce(next_start, length(txt)) AS e, txt, substr(txt, CAST(h.page_start + 10 AS BIGINT), CAST(least(h.page_start + 129, coalesce(next_start, length(txt))) - h.page_start - 9 AS BIGINT)) AS ctx FROM h JOIN full_text f ON h.document_id = f.document_id),
x AS (SELECT e.*, p.page_number, page_start + instr(page_text, '100-000-') - 1 AS a, regexp_extract(page_text, '100-000-\\d{{3}}', 0) AS apn, regexp_extract(page_text, ' for (\\d+ Oak St)', 1) AS address, regexp_matches(lower(ctx), 'exclud|denied|withdrawn|removed|ineligible') AS gone
  FROM e JOIN p ON e.document_id = p.document_id AND p.page_start >= e.s AND p.page_start < e.e WHERE page_text LIKE '%APN 100-000-%')
SELECT document_id, CAST(a AS BIGINT) AS "offset", apn, 'Exhibit A listing' AS keyword, CASE WHEN gone THEN 'EXCLUDED' ELSE 'MED' END AS signal_strength, page_number, CASE WHEN gone THEN 'Current Zoning' ELSE 'Baseline Zoning' END AS current_zoning,
  CASE WHEN gone THEN 'Excluded/Unchanged' ELSE substr(string_split(trim(ctx, chr(10) || ' '), chr(10))[1], 1, 80) END AS proposed_zoning, address, {_around("a", "(a + 11)")} AS snippet FROM x"""
)
def x22_exhibit_apns(spark, d):
    return extraction.exhibit_apns(pages(spark, d))


@query(
    _PLACED.format(view="v_agenda_page")
    + f""", m AS (SELECT p.document_id, page_number, page_start, page_text, txt, 0 AS o, regexp_extract(page_text, '100-000-\\d{{3}}', 0) AS apn FROM p JOIN full_text f ON p.document_id = f.document_id WHERE page_text LIKE '%APN 100-000-%'
  UNION ALL SELECT p.document_id, page_number, page_start, page_text, txt, 1, regexp_extract(page_text, '650-555-\\d{{4}}', 0) FROM p JOIN full_text f ON p.document_id = f.document_id),
x AS (SELECT *, page_start + instr(page_text, apn) - 1 AS a, page_text LIKE '%denied%' AS gone FROM m)
SELECT document_id, CAST(a AS BIGINT) AS "offset", apn, 'global APN sweep' AS keyword, CASE WHEN gone THEN 'EXCLUDED' ELSE 'MED' END AS signal_strength, page_number, CASE WHEN gone THEN 'Current Zoning' ELSE 'Baseline Zoning' END AS current_zoning, CASE WHEN gone THEN 'Excluded/Unchanged' ELSE 'Policy Rezoning' END AS proposed_zoning,
  regexp_extract(page_text, ' for (\\d+ Oak St)', 1) AS address, {_around("a", "(a + length(apn))")} AS snippet FROM x"""
)
def x23_apn_sweep(spark, d):
    return extraction.apn_sweep(pages(spark, d)).drop("kw_ord")


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number) - 1 AS i FROM v_agenda_page)
SELECT document_id, CAST((i - 1) // 3 AS BIGINT) AS chunk, concat('=== Pages ', CAST(min(page_number) AS VARCHAR), '-', CAST(max(page_number) AS VARCHAR), ' of the document ===') AS label, count(*) AS n_pages, sha256(string_agg(page_text, chr(10) ORDER BY page_number)) AS body_sha256 FROM i WHERE i >= 1 GROUP BY document_id, (i - 1) // 3""")
def x26_chunk_pages(spark, d):
    return extraction.chunk_pages(pages(spark, d), 1, 3).select("document_id", "chunk", "label", "n_pages", F.sha2("body", 256).alias("body_sha256"))


@query("SELECT document_id, page_number, CASE WHEN regexp_matches(lower(page_text), 'density bonus|rezone') THEN regexp_extract(page_text, ' for (\\d+ Oak St)', 1) END AS header_address FROM v_agenda_page")
def x12_item_headers(spark, d):
    """The address that each page's item would stand for."""
    item = F.substr("page_text", F.instr("page_text", "Item "))
    return pages(spark, d).select("document_id", "page_number", extraction.header_address(extraction.item_header(item)).alias("header_address"))


@query("SELECT document_id, count(*) AS n_valid FROM (SELECT document_id, unnest(regexp_extract_all(page_text, '\\b\\d{3}-\\d{2,4}-\\d{3,4}\\b')) AS n FROM v_agenda_page) WHERE regexp_matches(n, '^\\d{3}-\\d{3,4}-\\d{3}$') GROUP BY document_id")
def f8_valid_apns(spark, d):
    """Of all numbers that look like one, those that are APNs by their shape: no telephone number is."""
    numbers = pages(spark, d).select("document_id", F.explode(F.regexp_extract_all("page_text", F.lit(r"\b\d{3}-\d{2,4}-\d{3,4}\b"), F.lit(0))).alias("n"))
    return numbers.where(t.valid_apn(F.col("n")).isNotNull()).groupBy("document_id").agg(F.count("*").alias("n_valid"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\(\\d{3}\\) \\d{3}-\\d{4}')) AS n_phones FROM documents WHERE regexp_matches(text, '\\(\\d{3}\\) \\d{3}-\\d{4}')")
def x23_phone_audit(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").rlike(r"\(\d{3}\) \d{3}-\d{4}"))
    return docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\(\d{3}\) \d{3}-\d{4}"), F.lit(0))).cast("long").alias("n_phones"))


_TIERS = """, n AS (SELECT p.*, document_id % 6 = 1 AS listed, document_id % 7 = 0 AS old, page_number % 3 = 2 AND document_id % 5 <> 0 AND document_id % 6 <> 1 AS head, (document_id + page_number) % 4 <> 0 AS has_apn,
  regexp_extract(page_text, '100-000-\\d{3}', 0) AS apn, regexp_extract(page_text, '(\\d+ Oak St)', 1) AS address, regexp_extract(page_text, '650-555-\\d{4}', 0) AS phone FROM p),
k AS (SELECT *, bool_or(listed AND has_apn) OVER d AS on_pages, max(CASE WHEN head THEN page_number END) OVER (PARTITION BY document_id ORDER BY page_number) IS NOT NULL AS inside, bool_or(head AND document_id % 3 = 1) OVER d AS sb FROM n WINDOW d AS (PARTITION BY document_id)),
j AS (SELECT *, bool_or(inside AND has_apn) OVER (PARTITION BY document_id) AS on_exhibits FROM k),
tier1 AS (SELECT document_id, CASE WHEN has_apn THEN apn END AS apn, page_number, CASE WHEN old THEN 4 ELSE 2 END AS strength_rank, 'density bonus' AS keyword, CASE WHEN has_apn THEN address END AS address, NULL AS current_zoning, NULL AS proposed_zoning, 'pages' AS tier, page_number * 10 AS o FROM j WHERE on_pages),
tier2 AS (SELECT document_id, apn, page_number, CASE WHEN document_id % 3 = 0 THEN 4 ELSE 2 END AS strength_rank, concat(CASE WHEN document_id % 2 = 0 THEN 'Exhibit B' ELSE 'Attachment C' END, ' listing') AS keyword, address,
  CASE WHEN document_id % 3 = 0 THEN 'Current Zoning' ELSE 'Baseline Zoning' END AS current_zoning, CASE document_id % 3 WHEN 0 THEN 'Excluded/Unchanged' WHEN 1 THEN 'SB 79 TOD' ELSE 'Listed sites' END AS proposed_zoning, 'exhibits' AS tier, page_number * 10 AS o FROM j WHERE NOT on_pages AND inside AND has_apn),
tier3 AS (SELECT document_id, apn, page_number, o, address, old, sb FROM (SELECT *, page_number * 10 AS o FROM j WHERE has_apn UNION ALL SELECT * REPLACE (phone AS apn, CASE WHEN has_apn THEN address END AS address), page_number * 10 + 1000 FROM j) WHERE NOT on_pages AND NOT on_exhibits),
every AS (SELECT * FROM tier1 UNION ALL SELECT * FROM tier2 UNION ALL SELECT document_id, apn, page_number, CASE WHEN old THEN 4 ELSE 2 END, 'global APN sweep', address, CASE WHEN old THEN 'Current Zoning' ELSE 'Baseline Zoning' END, CASE WHEN old THEN 'Excluded/Unchanged' WHEN sb THEN 'SB 79 TOD' ELSE 'Policy Rezoning' END, 'sweep', o FROM tier3)
SELECT document_id, apn, arg_min(page_number, o) AS page_number, min(strength_rank) AS strength_rank, min(keyword) AS keyword, arg_min(address, o) FILTER (WHERE address IS NOT NULL) AS address, min(current_zoning) AS current_zoning, min(proposed_zoning) AS proposed_zoning, min(tier) AS tier, 'POLICY_ORDINANCE' AS classification
FROM every GROUP BY document_id, apn, CASE WHEN apn IS NULL THEN page_number END"""


@query(_PLACED.format(view="v_ordinance_page") + _TIERS)
def x24_regex_tier(spark, d):
    """All three tiers: some ordinances name parcels under their items, some in exhibits, others anywhere or only telephones."""
    return tiers.regex_tier(view(spark, d, "v_ordinance_page")).select("document_id", "apn", "page_number", "strength_rank", "keyword", "address", "current_zoning", "proposed_zoning", "tier", "classification")


@query("SELECT document_id, page_number, CASE WHEN page_text LIKE '%denied%' THEN 'EXCLUDED' ELSE 'MED' END AS disposition, CASE WHEN page_text LIKE '%denied%' THEN 'Current Zoning' ELSE 'Baseline Zoning' END AS current_zoning, CASE WHEN page_text LIKE '%denied%' THEN 'Excluded/Unchanged' ELSE 'Exhibit A' END AS proposed_zoning FROM v_agenda_page WHERE page_text LIKE 'Exhibit A%'")
def x20_policy_zoning(spark, d):
    p = pages(spark, d).where(F.col("page_text").startswith("Exhibit A"))
    p = p.withColumn("disposition", F.when(t.contains_any(F.col("page_text"), t.EXHIBIT_EXCLUSIONS), "EXCLUDED").otherwise("MED"))
    z = t.infer_policy_zoning(F.lit("Exhibit A"), F.col("page_text"), F.col("disposition"))
    return p.withColumn("z", z).select("document_id", "page_number", "disposition", F.col("z.current").alias("current_zoning"), F.col("z.proposed").alias("proposed_zoning"))


@query(
    _KIND
    + f""", g AS (SELECT document_id, page_number, page_text AS txt, CASE document_id % 4 WHEN 0 THEN 'rezone' WHEN 1 THEN 'density bonus' ELSE 'variance' END AS keyword FROM k WHERE kind IN ('hearing', 'unknown') AND document_id % 4 <> 3),
a AS (SELECT *, instr(lower(txt), keyword) - 1 AS a FROM g)
SELECT document_id, page_number, keyword, {_around("a", "(a + length(keyword))")} AS snippet FROM a"""
)
def x16_snippets(spark, d):
    return extraction.page_signals(pages(spark, d)).select("document_id", "page_number", "keyword", "snippet")


_LIST_ROWS = ", ".join(f"('{name}', {i}, '{word}')" for name, words in keywords.LISTS.items() for i, word in enumerate(words))


@query(
    f"""WITH lists(list, ord, word) AS (VALUES {_LIST_ROWS}),
parts AS (SELECT document_id, page_number, list, ord, word, string_split(lower(page_text), word) AS parts FROM v_agenda_page, lists WHERE contains(lower(page_text), word)),
places AS (SELECT *, unnest(range(1, len(parts))) AS i FROM parts)
SELECT document_id, page_number, list, CAST(ord AS INTEGER) AS ord, word, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(word) AS INTEGER) AS pos FROM places"""
)
def x8_word_hits(spark, d):
    """Each place of each word of all lists, from one pass over the texts."""
    return keywords.with_hits(pages(spark, d), "page_text").select("document_id", "page_number", F.inline("hits"))


@query("""WITH p AS (SELECT *, document_id % 3 AS w, page_number % 2 = 1 AS named, regexp_extract(page_text, '\\d+ Oak St', 0) AS oak, regexp_extract(page_text, '100-000-\\d{3}', 0) AS apn0 FROM v_staff_page)
SELECT document_id, page_number, CASE WHEN named THEN apn0 WHEN w = 1 THEN concat('ADDR: ', oak) END AS apn,
  CASE WHEN w = 1 THEN oak WHEN NOT named THEN NULL WHEN w = 0 THEN '1017 Middlefield Rd' ELSE concat('Parcel ', CAST(document_id AS VARCHAR), ' of the Plan') END AS address FROM p""")
def x7_labelled_addresses(spark, d):
    """Items with a labelled address, or whose header names the excluded office's own address."""
    return extraction.page_signals(view(spark, d, "v_staff_page")).select("document_id", "page_number", "apn", "address")
