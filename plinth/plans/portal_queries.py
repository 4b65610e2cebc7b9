"""Queries of discovery, resolution and the recorded language-model tier, with DuckDB oracles where SQL has one."""

from __future__ import annotations

from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from plinth.functions import portal
from plinth.operators import discovery, extraction, resolve, tiers
from plinth.plans.views import oracle, view
from plinth.sources import html, pdf
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


@query("SELECT page_id, count(*) AS n_links, min(href) AS least, max(href) AS greatest FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id")
def t1_anchors(spark, d):
    a = html.anchors(table(spark, d, "pages"))
    return a.groupBy("page_id").agg(F.count("*").alias("n_links"), F.min("href").alias("least"), F.max("href").alias("greatest"))


#: One listing page per document, as each kind of source would have it: its address is its city's, its date in July.
_ROOT = "https://portal.example"
_DATED = "make_date(2026, 7, CAST(document_id % 28 + 1 AS INTEGER)) AS meeting_date"
_IN_WINDOW = "document_id % 28 + 1 <= 20"


def _paged(spark, d, body):
    """(page_id, jurisdiction, url, html) with ``body`` (of the id as text, and its day) as HTML.

    Rows are dealt before they become pages, which are many times as large, so that parsing doesn't hang on the layout of files.
    """
    docs = view(spark, d, "v_document").select("document_id", "city_name").repartition("document_id").withColumn("n", F.col("document_id").cast("string")).withColumn("day", (F.col("document_id") % 28 + 1).cast("string"))
    return docs.select(F.col("document_id").alias("page_id"), F.col("city_name").alias("jurisdiction"), F.concat(F.lit(_ROOT + "/"), "city_name", F.lit("/list")).alias("url"), body.alias("html"))


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _made() -> SimpleNamespace:
    """The pages' parts as columns over a document's id (as number and as text n) and day."""
    n, day, number = F.col("n"), F.col("day"), F.col("document_id")
    direct = _text('<a href="/files/city-council-agenda-202607', F.lpad(day, 2, "0"), "-", n, '.pdf">City Council Agenda</a><a href="/files/library-agenda-', n, '.pdf">Library agenda</a><a href="mailto:a.pdf">city council agenda</a><a href="/files/city-council-agenda-202607', F.lpad(day, 2, "0"), "-", n, '.pdf">again</a>')
    viewed = _text('<table><tr><th>Date</th></tr><tr><td headers="Date">07/', F.lpad(day, 2, "0"), '/26</td><td><a href="mailto:x">Agenda by mail</a><a href="/AgendaViewer.php?id=', n, '"><b>Agenda</b></a><a href="/second">agenda two</a></td></tr></table>')
    kind = F.when(number % 4 == 0, "catAgendaRow").when(number % 4 == 1, "MeetingRow").when(number % 4 == 2, "listtable").otherwise("fallback")
    links = _text('<a href="/ViewFile/min?id=', n, '">Minutes</a><a href="/x?html=true&agenda">HTML</a><a href="/ViewFile/', F.when(number % 5 == 0, F.concat(F.lit("Agenda/"), n)).otherwise(F.concat(n, F.lit(".pdf"))), '">Agenda</a>')
    cells = _text("<td>7/", day, "/2026</td><td>", links, "</td>")
    rows = (
        F.when(kind == "catAgendaRow", _text('<div class="x catAgendaRow">7/', day, "/2026 ", links, '</div><div class="catAgendaRow">', links, "</div><table><tr>", cells, "</tr></table>"))
        .when(kind == "MeetingRow", _text('<div class="Row MeetingRow">7/', day, "/2026 ", links, "</div>"))
        .when(kind == "listtable", _text('<table class="notlisttable"><tr><td><a href="/agenda/0.pdf">old</a></td></tr></table><table class="x listtable"><tr>', cells, '</tr></table><table class="listtable"><tr><td><a href="/agenda/9.pdf">later</a></td></tr></table>'))
        .otherwise(_text('<div><table><tr><td><a href="/agenda/1.pdf">undated</a></td></tr></table></div><div><table><tr>', cells, "</tr></table></div>"))
    )


    files = F.element_at(F.array(*[F.lit(x) for x in discovery.FILE_LISTS]), (F.floor(number / 2) % 6 + 1).cast("int"))
    date_name = F.element_at(F.array(*[F.lit(x) for x in discovery.DATE_NAMES]), (F.floor(number / 2) % 4 + 1).cast("int"))
    agenda_file = F.when(number % 10 != 0, _text(',{"fileId":', (number + 2).cast("string"), ',"type":"Agenda Packet"}')).otherwise("")
    other_files = F.when(number % 14 != 0, _text(',{"fileId":0,"id":', n, ',"name":"Other"}', agenda_file)).otherwise("")
    streamed = _text('{"value":[{', F.when(number % 22 != 0, _text('"', date_name, '":', F.when(number % 26 == 0, "null").otherwise(_text('"2026-07-', F.lpad(day, 2, "0"), 'T18:00:00"')), ",")).otherwise(""), '"Minutes":[],"', files, '":[{"fileId":', (number + 1).cast("string"), ',"type":"Minutes"}', other_files, "]}]}")
    compiled_item = _text('[{"dateTime":', F.when(number % 3 == 0, '""').otherwise(_text('"2026-07-', F.lpad(day, 2, "0"), 'T18:00:00"')), ',"date":"Jul ', day, ', 2026","documentList":[{"id":7,"templateName":"Agenda","compileOutputType":3},{"id":', (number + 1).cast("string"), ',"templateName":"Packet","compileOutputType":1},{"id":', n, ',"templateName":"', F.when(number % 5 == 0, "Notes").otherwise("Agenda"), '","compileOutputType":1}]}]')
    compiled = F.when(number % 9 == 0, "not json").when(number % 15 == 1, _text('{"data":', compiled_item, "}")).when(number % 21 == 0, '{"other":[]}').otherwise(compiled_item)
    api_host = F.when(number % 13 == 1, "https://other.example/api/list").when(number % 2 == 0, "https://a.api.civicclerk.com/v1/Events/").otherwise("https://b.primegov.com/api/v2/PublicPortal/ListArchivedMeetings")
    start, end = F.lit("2026-07-01").cast("date"), F.lit("2026-07-20").cast("date")
    return SimpleNamespace(window=(start, end), direct=direct, viewed=viewed, rows=rows, api=F.when(number % 2 == 0, streamed).otherwise(compiled), api_host=api_host)


def _probes(spark, d):
    """Recorded looks at the links that don't end in .pdf: of some HEAD isn't supported, some aren't PDFs."""
    docs = view(spark, d, "v_document").where(F.col("document_id") % 5 == 0)
    kind = F.when(F.col("document_id") % 2 == 0, "Application/PDF; x").otherwise("text/html")
    return docs.select(F.concat(F.lit(_ROOT + "/ViewFile/Agenda/"), F.col("document_id").cast("string")).alias("url"), F.when(F.col("document_id") % 20 == 0, 404).otherwise(200).alias("head_status"), F.when(F.col("document_id") % 20 == 0, "text/plain").otherwise(kind).alias("head_type"), kind.alias("get_type"))


_S9 = f"SELECT document_id AS page_id, concat('{_ROOT}/files/city-council-agenda-202607', lpad(CAST(document_id % 28 + 1 AS VARCHAR), 2, '0'), '-', CAST(document_id AS VARCHAR), '.pdf') AS pdf_url, 'City Council Agenda' AS title, {_DATED} FROM v_document WHERE {_IN_WINDOW}"


@query(_S9)
def s9_direct_listing(spark, d):
    return discovery.direct_listing(_paged(spark, d, _made().direct), *_made().window)


@query(f"SELECT document_id AS page_id, 1 AS row, concat('{_ROOT}/AgendaViewer.php?id=', CAST(document_id AS VARCHAR)) AS url, 'Agenda' AS title, {_DATED} FROM v_document WHERE {_IN_WINDOW}")
def s10_agenda_rows(spark, d):
    return discovery.agenda_rows(_paged(spark, d, _made().viewed), *_made().window)


_S11 = f"SELECT document_id AS page_id, concat('{_ROOT}/ViewFile/', CASE WHEN document_id % 5 = 0 THEN 'Agenda/' ELSE '' END, CAST(document_id AS VARCHAR), CASE WHEN document_id % 5 = 0 THEN '' ELSE '.pdf' END) AS pdf_url, 'Agenda' AS title, {_DATED} FROM v_document WHERE {_IN_WINDOW} AND document_id % 10 <> 5"


@query(_S11)
def s11_row_listing(spark, d):
    return discovery.row_listing(_paged(spark, d, _made().rows), _probes(spark, d), *_made().window)


@query("SELECT document_id AS page_id, CASE document_id % 4 WHEN 0 THEN 'catAgendaRow' WHEN 1 THEN 'MeetingRow' WHEN 2 THEN 'listtable' ELSE 'fallback' END AS kind, CASE document_id % 4 WHEN 0 THEN 2 WHEN 3 THEN 4 ELSE 1 END AS n_rows FROM v_document")
def t3_row_kinds(spark, d):
    return html.listing_rows(_paged(spark, d, _made().rows)).groupBy("page_id", "kind").agg(F.count("*").alias("n_rows"))


_AGENDA_LINKS = "SELECT page_id, row, tag, kind, size(links) AS n_links, element_at(links, -1).href AS last_href FROM {pages}, LATERAL page_rows(html)"


@query("""WITH p AS (SELECT document_id AS page_id, CAST(document_id AS VARCHAR) AS n, document_id % 4 AS k, concat('/ViewFile/', CASE WHEN document_id % 5 = 0 THEN 'Agenda/' ELSE '' END, CAST(document_id AS VARCHAR), CASE WHEN document_id % 5 = 0 THEN '' ELSE '.pdf' END) AS href FROM v_document),
r(k, row, tag, kind, n_links, own) AS (VALUES (0, 0, 'div', 'catAgendaRow', 3, NULL), (0, 1, 'div', 'catAgendaRow', 3, NULL), (0, 2, 'tr', NULL, 3, NULL), (1, 0, 'div', 'MeetingRow', 3, NULL), (2, 0, 'tr', NULL, 1, '/agenda/0.pdf'), (2, 1, 'tr', 'listtable', 3, NULL), (2, 2, 'tr', NULL, 1, '/agenda/9.pdf'),
  (3, 0, 'div', 'fallback', 1, '/agenda/1.pdf'), (3, 1, 'tr', 'fallback', 1, '/agenda/1.pdf'), (3, 2, 'div', 'fallback', 3, NULL), (3, 3, 'tr', 'fallback', 3, NULL))
SELECT page_id, row, tag, kind, n_links, coalesce(own, href) AS last_href FROM p JOIN r ON p.k = r.k""")
def t2_lateral_rows(spark, d):
    """A page's rows and their links by the table function, from SQL."""
    made = _paged(spark, d, _made().rows)
    html.register(spark)
    return spark.sql(_AGENDA_LINKS, pages=made)


def _fetched(spark, d):
    """(links, fetches, downloads): an agenda page per document, and what was recorded of where it leads."""
    docs = view(spark, d, "v_document").withColumn("n", F.col("document_id").cast("string")).withColumn("case", F.col("document_id") % 7)
    url = F.when(F.col("case") == 6, F.concat(F.lit("https://x.example/page/"), F.col("n"))).otherwise(F.concat(F.lit(_ROOT + "/AgendaViewer.php?id="), F.col("n")))
    docs = docs.withColumn("url", url)
    meeting = F.concat(F.lit("/AgendaOnline/ViewMeeting?id="), F.col("n"))
    location = F.when(F.col("case") == 0, F.concat(F.lit("https://docs.google.com/gview?embedded=true&url=https%3A%2F%2Fa_b.s3.amazonaws.com%2F"), F.col("n"), F.lit(".pdf"))).when(F.col("case") == 1, meeting).when(F.col("case") == 5, F.concat(F.lit("https://store.example/blob/"), F.col("n")))
    status = F.when(F.col("case").isin(0, 1, 4, 5), 302).otherwise(200)
    page = F.when(F.col("case") == 3, _text('<a href="mailto:a.pdf">x</a><a href="/about">y</a><a href="/f/', F.col("n"), '.pdf">Agenda</a>'))
    kind = F.when(F.col("case") == 2, "application/pdf").otherwise("text/html")
    first = docs.select("url", status.alias("status"), location.alias("location"), kind.alias("content_type"), page.alias("html"))
    stepped = docs.where("case = 1")
    packet = _text("/AgendaOnline/Documents/Downloadfile/Packet%20", F.col("n"), ".pdf?documentType=1&meetingId=", F.col("n"), "&isAttachment=True")
    second = stepped.select(F.concat(F.lit(_ROOT), meeting).alias("url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("location"), F.lit("text/html").alias("content_type"), _text('<a href="', packet, '">Packet</a>').alias("html"))
    payload = _text('{"DocumentName":"Packet ', F.col("n"), '.pdf","DocumentType":"AgendaPacket","MeetingId":', F.col("n"), ',"ItemId":3,"IsSection":', F.when(F.col("document_id") % 2 == 0, "true").otherwise("false"), "}")
    downloads = stepped.select(F.concat(F.lit(_ROOT), packet).alias("url"), payload.alias("payload"))
    return docs.select("document_id", "url"), first.unionByName(second), downloads


_VIEW_DOCUMENT = f"concat('{_ROOT}/AgendaOnline/Documents/ViewDocument/Packet%20', CAST(document_id AS VARCHAR), '.pdf?meetingId=', CAST(document_id AS VARCHAR), '&documentType=AgendaPacket&itemId=3&publishId=0&isSection=', CASE WHEN document_id % 2 = 0 THEN 'true' ELSE 'false' END)"
_TARGET = f"""CASE document_id % 7 WHEN 0 THEN concat('https://s3.amazonaws.com/a_b/', CAST(document_id AS VARCHAR), '.pdf') WHEN 1 THEN {_VIEW_DOCUMENT} WHEN 2 THEN concat('{_ROOT}/AgendaViewer.php?id=', CAST(document_id AS VARCHAR))
WHEN 3 THEN concat('{_ROOT}/f/', CAST(document_id AS VARCHAR), '.pdf') WHEN 5 THEN concat('https://store.example/blob/', CAST(document_id AS VARCHAR)) END"""


@query(f"SELECT document_id, {_TARGET} AS target FROM v_document")
def s14_resolve_hops(spark, d):
    links, fetches, downloads = _fetched(spark, d)
    return discovery.resolve_links(links, fetches, downloads).join(links, "url").select("document_id", "target")


@query(f"SELECT document_id, {_VIEW_DOCUMENT} AS view_url FROM v_document WHERE document_id % 7 = 1")
def s15_view_documents(spark, d):
    _, _, downloads = _fetched(spark, d)
    return downloads.select(F.regexp_extract("url", r"meetingId=(\d+)", 1).cast("long").alias("document_id"), portal.view_document_url(F.col("url"), F.col("payload")).alias("view_url"))


_S12 = f"""SELECT page_id, pdf_url, title, meeting_date FROM (SELECT document_id AS page_id, document_id, CAST(NULL AS VARCHAR) AS title,
CASE WHEN document_id % 2 = 0 THEN concat('https://a.api.civicclerk.com/v1/Meetings/GetMeetingFileStream(fileId=', CAST(CASE WHEN document_id % 10 = 0 THEN document_id ELSE document_id + 2 END AS VARCHAR), ',plainText=false)') ELSE concat('https://b.primegov.com/Public/CompiledDocument/', CAST(CASE WHEN document_id % 5 = 0 THEN document_id + 1 ELSE document_id END AS VARCHAR)) END AS pdf_url,
CASE WHEN document_id % 26 <> 0 THEN make_date(2026, 7, CAST(document_id % 28 + 1 AS INTEGER)) END AS meeting_date FROM v_document
WHERE document_id % 13 <> 1 AND CASE WHEN document_id % 2 = 0 THEN document_id % 14 <> 0 AND document_id % 22 <> 0 ELSE document_id % 9 <> 0 AND (document_id % 15 = 1 OR document_id % 21 <> 0) END) WHERE meeting_date IS NULL OR {_IN_WINDOW}"""


def _api_pages(spark, d):
    docs = view(spark, d, "v_document").withColumn("n", F.col("document_id").cast("string")).withColumn("day", (F.col("document_id") % 28 + 1).cast("string"))
    return docs.select(F.col("document_id").alias("page_id"), F.col("city_name").alias("jurisdiction"), _made().api_host.alias("url"), _made().api.alias("html"))


@query(_S12)
def s12_api_listing(spark, d):
    return discovery.api_listing(_api_pages(spark, d).withColumnRenamed("html", "payload"), *_made().window)


@query(
    f"""WITH own AS (SELECT d.*, s.source_type FROM v_document d JOIN v_source s ON d.city_name = s.jurisdiction), listed AS ({_S9} UNION ALL {_S11} UNION ALL {_S12} UNION ALL SELECT document_id, {_TARGET}, 'Agenda', {_DATED.replace(" AS meeting_date", "")} FROM v_document WHERE {_IN_WINDOW} AND document_id % 7 NOT IN (4, 6)),
kinds AS (SELECT page_id, pdf_url, title, meeting_date, CASE WHEN pdf_url LIKE '%/files/city%' THEN 'direct_pdf' WHEN pdf_url LIKE '%/ViewFile/%' THEN 'civicplus_dom' WHEN pdf_url LIKE '%GetMeetingFileStream%' OR pdf_url LIKE '%CompiledDocument%' THEN 'api' ELSE 'granicus_dom' END AS kind FROM listed)
SELECT city_name AS jurisdiction, pdf_url, title, k.meeting_date, source_type FROM kinds k JOIN own ON k.page_id = own.document_id AND k.kind = own.source_type"""
)
def u3_discover(spark, d):
    """All kinds of sources at once."""
    sources = view(spark, d, "v_source")
    kind = lambda body, k: _paged(spark, d, body).join(sources.where(F.col("source_type") == k).select("jurisdiction"), "jurisdiction", "left_semi")
    pages = kind(_made().direct, "direct_pdf").unionByName(kind(_made().viewed, "granicus_dom")).unionByName(kind(_made().rows, "civicplus_dom")).unionByName(_api_pages(spark, d).join(sources.where("source_type = 'api'").select("jurisdiction"), "jurisdiction", "left_semi"))
    _, fetches, downloads = _fetched(spark, d)
    return discovery.discover(sources, pages, fetches, downloads, _probes(spark, d), *_made().window)


@query("SELECT document_id, meeting_date AS parsed FROM v_document WHERE meeting_date IS NOT NULL")
def c10_meeting_dates(spark, d):
    """Dates in three spellings come back as they were."""
    docs = view(spark, d, "v_document").where("meeting_date IS NOT NULL")
    spelt = F.when(F.col("document_id") % 3 == 0, F.date_format("meeting_date", "yyyyMMdd")).when(F.col("document_id") % 3 == 1, F.date_format("meeting_date", "M/d/yyyy")).otherwise(F.date_format("meeting_date", "MMMM d, yyyy"))
    in_20s = F.year("meeting_date") >= 2000
    parsed = F.when(in_20s, portal.meeting_date(F.concat(F.lit("/agendas/"), spelt, F.lit(" Minutes Agenda Packet")))).otherwise(portal.short_year_date(F.date_format("meeting_date", "M/d/yy")))
    return docs.select("document_id", parsed.alias("parsed"))


@query("SELECT page_id, NOT regexp_matches(lower(trim(url)), '^(mailto:|tel:|javascript:)') AS navigable, regexp_replace(url, '[?#].*$', '') AS base FROM pages")
def f11_navigable_links(spark, d):
    return table(spark, d, "pages").select("page_id", portal.is_navigable(F.col("url")).alias("navigable"), portal.without_query(F.col("url")).alias("base"))


@query("SELECT document_id, meeting_date FROM v_document WHERE meeting_date IS NULL OR meeting_date BETWEEN DATE '2000-03-02' AND DATE '2000-04-01'")
def f12_default_window(spark, d):
    docs = view(spark, d, "v_document")
    keep = portal.in_window(F.col("meeting_date"), F.lit(None).cast("date"), F.lit("2000-04-01").cast("date"))
    return docs.where(keep).select("document_id", "meeting_date")


@query("""WITH a AS (SELECT parcel_id AS ask_id, CASE WHEN parcel_id % 97 = 0 THEN replace(upper(address), ' ', '_') WHEN parcel_id % 97 = 1 THEN concat(split_part(upper(address), ' ', 1), ' %', split_part(upper(address), ' ', 3)) ELSE upper(address) END AS line, city FROM v_parcel)
SELECT ask_id, string_agg(DISTINCT apn, ';' ORDER BY apn) AS apns FROM (SELECT ask_id, apn, upper(p.city) = upper(a.city) AS here, bool_or(upper(p.city) = upper(a.city)) OVER (PARTITION BY ask_id) AS any_here FROM a JOIN v_parcel p ON upper(p.address) LIKE concat('%', a.line, '%')) WHERE here OR NOT any_here GROUP BY ask_id""")
def j5_resolve_by_address(spark, d):
    """Every parcel's address is asked for, some with a pattern's wildcards in it."""
    p = view(spark, d, "v_parcel")
    word = lambda i: F.split("address", " ", -1)[i]
    line = F.when(F.col("parcel_id") % 97 == 0, F.replace("address", F.lit(" "), F.lit("_"))).when(F.col("parcel_id") % 97 == 1, F.concat(word(0), F.lit(" %"), word(2))).otherwise(F.concat("address", F.lit(" and 12 Elm Rd")))
    return resolve.by_address(p.select(F.col("parcel_id").alias("ask_id"), line.alias("address"), "city"), p).select("ask_id", F.array_join("apns", ";").alias("apns"))


@query("SELECT parcel_id AS ask_id, apn FROM v_parcel WHERE parcel_id % 5 <> 0")
def j6_resolve_by_point(spark, d):
    """Square parcels on a grid; one point in five lies between parcels."""
    p = view(spark, d, "v_parcel")
    x, y = (F.col("parcel_id") % 100) * 0.02, F.floor(F.col("parcel_id") / 100) * 0.02
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    polygons = p.select("apn", F.array(corner(0, 0), corner(0.01, 0), corner(0.01, 0.01), corner(0, 0.01)).alias("ring"))
    off = F.when(F.col("parcel_id") % 5 == 0, 0.015).otherwise(0.005)
    return resolve.by_point(p.select(F.col("parcel_id").alias("ask_id"), (x + off).alias("x"), (y + off).alias("y")), polygons).select("ask_id", "apn")


def _intents(spark, d):
    """Recorded intents: policies and single sites."""
    docs = view(spark, d, "v_document").where(F.col("document_id").isNotNull())
    return docs.select("document_id", F.when(F.col("document_id") % 8 == 0, "POLICY_ORDINANCE").otherwise("SINGLE_SITE_APPLICATION").alias("doc_type"), F.concat(F.lit("about "), "city_name").alias("executive_summary"))


_ITEMS_OF = """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number) - 1 AS chunk, concat(regexp_extract(page_text, ' for (\\d+) Oak St', 1), ' Oak St') AS address FROM v_agenda_page),
i AS (SELECT *, (document_id + page_number) % 5 = 0 AS blank, (document_id + page_number) % 4 < 2 AS undated, CASE (document_id + page_number) % 3 WHEN 1 THEN '042-311-090' WHEN 2 THEN '042-3110-090' END AS apn FROM p WHERE document_id % 9 <> 1 AND (chunk = 0 OR (document_id % 8 = 0 AND NOT (document_id % 9 = 2 AND chunk = 1)))),
kept AS (SELECT i.*, (SELECT min(q.page_number) FROM p q WHERE q.document_id = i.document_id AND contains(q.page_text, i.address)) AS at_page FROM i WHERE NOT blank AND NOT undated),
leads AS (SELECT document_id, apn, arg_min(at_page, chunk) AS page_number, arg_min(chunk + 1, chunk) AS unit_count, arg_min(address, chunk) AS address, CASE WHEN document_id % 8 = 0 THEN 'POLICY_ORDINANCE' ELSE 'SINGLE_SITE_APPLICATION' END AS classification FROM kept GROUP BY document_id, apn, CASE WHEN apn IS NULL THEN chunk END)
-- v_agenda_page
"""


def _responses(spark, d):
    """Recorded responses: one chunk a page, with one item each; some can't be read."""
    pages = view(spark, d, "v_agenda_page")
    place = F.col("document_id") + F.col("page_number")
    chunk = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number")) - 1
    rows = pages.withColumn("chunk", chunk.cast("long")).withColumn("address", F.regexp_extract("page_text", r" for (\d+ Oak St)", 1))
    apn = F.when(place % 3 == 0, "650-555-1234").when(place % 3 == 1, " 042-311-090 ").otherwise("042-3110-090")
    date = F.when(place % 4 == 0, "2026-7-4").when(place % 4 == 1, "2026-02-30").otherwise("2026-07-14")
    item = F.struct(F.lit("SITE_SPECIFIC").alias("lead_type"), "address", apn.alias("apn"), (F.col("chunk") + 1).alias("unit_count"), F.when(place % 5 == 0, "  ").otherwise("Rezone").alias("entitlement_type"), date.alias("meeting_date"), F.lit("MEDIUM").alias("signal"), F.lit("why").alias("reasoning"))
    broken = ((F.col("document_id") % 9 == 1) & (F.col("chunk") == 0)) | ((F.col("document_id") % 9 == 2) & (F.col("chunk") == 1))
    return rows.select("document_id", "chunk", F.when(broken, "no answer").otherwise(F.to_json(F.struct(F.array(item).alias("leads")))).alias("payload"))


@query(_ITEMS_OF + "SELECT document_id, apn, page_number, unit_count, address, 2 AS strength_rank, 'Rezone' AS keyword, '2026-07-14' AS meeting_date, classification FROM leads")
def x28_recorded_responses(spark, d):
    """Recorded model responses: united by chunk, validated, gated, placed on their pages and deduplicated."""
    found = tiers.model_tier(view(spark, d, "v_agenda_page"), _intents(spark, d), _responses(spark, d))
    return found.select("document_id", "apn", "page_number", "unit_count", "address", "strength_rank", "keyword", "meeting_date", "classification")


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number) - 1 AS i FROM v_agenda_page),
c AS (SELECT document_id, CASE WHEN i < 2 THEN 0 ELSE 1 + (i - 2) // 2 END AS chunk, min(page_number) AS a, max(page_number) AS z, string_agg(page_text, chr(10) ORDER BY page_number) AS body FROM i WHERE i < 2 OR document_id % 8 = 0 GROUP BY ALL)
SELECT document_id, CAST(chunk AS BIGINT) AS chunk, sha256(concat(CASE WHEN chunk > 0 THEN concat('=== Pages ', CAST(a AS VARCHAR), '-', CAST(z AS VARCHAR), ' of the document ===', chr(10)) ELSE '' END, body)) AS contents_sha256 FROM c""")
def x28_model_calls(spark, d):
    calls = tiers.model_calls(view(spark, d, "v_agenda_page"), _intents(spark, d), 2, 2)
    return calls.select("document_id", "chunk", F.sha2("contents", 256).alias("contents_sha256"))


@query("SELECT document_id, concat('Intent: ', CASE WHEN document_id % 8 = 0 THEN 'POLICY_ORDINANCE (take the change itself)' ELSE 'SINGLE_SITE_APPLICATION (take the one site)' END, ' about ', city_name, '.') AS prompt FROM v_document")
def x27_prompts(spark, d):
    """Prompts by document type, from a template of the caller's."""
    return tiers.extraction_prompts(_intents(spark, d), "Intent: {doc_type} ({instruction}) {summary}.", {"POLICY_ORDINANCE": "take the change itself", "SINGLE_SITE_APPLICATION": "take the one site"})


@query(
    _ITEMS_OF.replace("-- v_agenda_page\n", "")
    + """, v AS (SELECT *, CASE page_number % 4 WHEN 0 THEN 'boilerplate' WHEN 1 THEN 'hearing' WHEN 2 THEN 'exhibit' END AS own FROM v_agenda_page WHERE document_id % 9 = 1),
k AS (SELECT *, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'unknown') AS kind FROM v),
s AS (SELECT document_id, page_number, document_id % 8 = 0 AS denied, CASE WHEN document_id % 3 <> 0 THEN regexp_extract(page_text, '100-000-\\d{3}', 0) WHEN document_id % 4 IN (0, 1) THEN concat('ADDR: ', regexp_extract(page_text, ' for (\\d+ Oak St)', 1)) END AS apn FROM k WHERE kind IN ('hearing', 'unknown') AND document_id % 4 <> 3),
c AS (SELECT document_id, count(DISTINCT apn) > 1 AS policy FROM s GROUP BY document_id),
x AS (SELECT s.document_id, apn, denied, policy, CASE WHEN apn IS NULL THEN page_number END AS p FROM s JOIN c ON s.document_id = c.document_id GROUP BY ALL),
n AS (SELECT document_id, CASE WHEN bool_or(policy) THEN 'POLICY_ORDINANCE' ELSE 'SINGLE_SITE_APPLICATION' END AS classification, count(*) FILTER (WHERE denied AND policy) AS excluded_count, count(*) FILTER (WHERE NOT (denied AND policy)) AS n_leads FROM x GROUP BY document_id
  UNION ALL SELECT document_id, min(classification), 0, count(*) FROM leads GROUP BY document_id)
-- v_agenda_page
SELECT a.document_id, classification, coalesce(excluded_count, 0) AS excluded_count, coalesce(n_leads, 0) AS n_leads FROM (SELECT DISTINCT document_id FROM v_agenda_page) a LEFT JOIN n ON a.document_id = n.document_id"""
)
def x29_extract(spark, d):
    """Model answers where there are any, patterns elsewhere; excluded signals of policies are only counted."""
    found, documents = tiers.extract(view(spark, d, "v_agenda_page"), _intents(spark, d), _responses(spark, d))
    n = found.groupBy("document_id").agg(F.count("*").alias("n_leads"))
    return documents.join(n, "document_id", "left").select("document_id", "classification", "excluded_count", F.coalesce("n_leads", F.lit(0)).alias("n_leads"))


@query("""WITH p AS (SELECT *, concat(regexp_extract(page_text, ' for (\\d+) Oak St', 1), ' Oak St') AS address FROM v_agenda_page)
SELECT document_id, address AS needle, (SELECT min(q.page_number) FROM p q WHERE q.document_id = p.document_id AND contains(q.page_text, p.address)) AS page_number FROM p
UNION ALL SELECT document_id, n, min(page_number) FROM p, (SELECT unnest(['nowhere', NULL]) AS n) GROUP BY ALL""")
def x25_locate_page(spark, d):
    """Each page's address, and two needles that no text has."""
    pages = view(spark, d, "v_agenda_page")
    asked = pages.select("document_id", F.regexp_extract("page_text", r" for (\d+ Oak St)", 1).alias("needle"))
    none = pages.select("document_id").distinct().withColumn("needle", F.explode(F.array(F.lit("nowhere"), F.lit(None).cast("string"))))
    return extraction.locate_pages(pages, asked.unionByName(none))


@query("SELECT page_id, page_id % 3 = 0 OR page_id % 7 = 0 AS is_pdf FROM pages")
def s17_content_types(spark, d):
    """A request's type counts, or a second one's where the first isn't supported."""
    p = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("url"))
    kind = F.when(F.col("page_id") % 3 == 0, "Application/PDF; x").when(F.col("page_id") % 3 == 1, "text/html")
    probes = p.select("url", F.when(F.col("page_id") % 7 == 0, 405).otherwise(200).alias("head_status"), kind.alias("head_type"), F.lit("application/pdf").alias("get_type"))
    return p.join(discovery.pdf_probes(probes), "url").select("page_id", "is_pdf")


def _packets(spark, d):
    """(path, content): each document's text as a file, a thousand characters a page in two lines, a blank page after each."""
    flat = F.translate("text", "\n", " ")
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / 1000).cast("int"), F.lit(1)) - 1)
    part = lambda i, at: F.substr(F.col("flat"), i * 1000 + at + 1, F.lit(500))
    lines = F.flatten(F.transform(numbers, lambda i: F.array(F.filter(F.array(part(i, 0), part(i, 500)), lambda x: x != ""), F.array().cast("array<string>"))))
    docs = table(spark, d, "documents").where("text IS NOT NULL").withColumn("flat", flat).select(F.concat(F.lit("/packets/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), lines.alias("pages"))

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pdf.write(x) for x in part.column(1).to_pylist()], pa.binary())], names=["path", "content"])

    return docs.mapInArrow(work, "path string, content binary")


@query("""WITH p AS (SELECT doc_id, unnest(range(0, greatest(CAST(ceil(length(text) / 1000.0) AS BIGINT), 1))) AS i, replace(text, chr(10), ' ') AS flat FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, CAST(2 * i + 1 AS INTEGER) AS page_number, concat(substr(flat, i * 1000 + 1, 500), CASE WHEN length(flat) > i * 1000 + 500 THEN chr(10) ELSE '' END, substr(flat, i * 1000 + 501, 500)) AS page_text FROM p)
SELECT doc_id, page_number, CAST(coalesce(sum(length(page_text) + 1) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_start, sha256(page_text) AS text_sha256 FROM t WHERE regexp_matches(page_text, '\\S')""")
def s7_file_pages(spark, d):
    """The pages of files, blank ones dropped, and where they begin in what is left."""
    found = pdf.pages(_packets(spark, d)).withColumn("document_id", F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long"))
    return extraction.page_offsets(found).select(F.col("document_id").alias("doc_id"), "page_number", "page_start", F.sha2("page_text", 256).alias("text_sha256"))
