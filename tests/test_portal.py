"""Hand vectors for the portal functions and listings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plinth.functions import portal
from plinth.operators import discovery, resolve, serving
from plinth.sources import html


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "date"),
    [
        (".../20260714-city-council-special-and-regular-agenda.pdf", dt.date(2026, 7, 14)),
        ("June 23, 2026 Minutes Agenda Packet Addendum", dt.date(2026, 6, 23)),
        ("2026-07-13T18:00:00", dt.date(2026, 7, 13)),
        ("Jul 13, 2026", dt.date(2026, 7, 13)),
        ("Sept. 3rd 2026", dt.date(2026, 9, 3)),
        ("20261399 then 7/4/2026", dt.date(2026, 7, 4)),
        ("no date", None),
        (None, None),
    ],
)
def test_meeting_date(spark, text, date):
    assert one(spark, text, portal.meeting_date) == date


def test_short_year_dates(spark):
    got = spark.createDataFrame([("07/06/26",), ("07/06/70",), ("on 07/06/26",), ("13/40/26",)], "x string").select(portal.short_year_date(F.col("x"))).collect()
    assert [r[0] for r in got] == [dt.date(2026, 7, 6), dt.date(1970, 7, 6), None, None]


def test_urls(spark):
    assert one(spark, "https://docs.google.com/gview?url=https%3A%2F%2Fx.y%2Fa.pdf&embedded=true", portal.unwrap_viewer) == "https://x.y/a.pdf"
    assert one(spark, "https://granicus_production_attachments.s3.amazonaws.com/k.pdf", portal.fix_bucket_host) == "https://s3.amazonaws.com/granicus_production_attachments/k.pdf"
    assert one(spark, "https://plain.s3.amazonaws.com/k.pdf", portal.fix_bucket_host) == "https://plain.s3.amazonaws.com/k.pdf"
    assert one(spark, "https://brisbaneca.api.civicclerk.com/v1/Events", portal.parent_url) == "https://brisbaneca.api.civicclerk.com/v1"
    assert one(spark, " MAILTO:clerk@x?subject=City Council Agenda", portal.is_navigable) is False
    row = spark.createDataFrame([("https://x.y/p/q", "../a.pdf")], "b string, h string").select(portal.normalize_url("b", "h")).first()
    assert row[0] == "https://x.y/a.pdf"


def test_agenda_links(spark):
    link = "https://x.gov/agendas-and-minutes/city-council/20260714-city-council-special-and-regular-agenda.pdf"
    got = spark.createDataFrame([(link, ""), (link.replace("agenda.pdf", "minutes.pdf"), ""), (link + "?x=1", "Agenda"), ("mailto:a.pdf", "city council agenda")], "h string, t string").select(portal.looks_like_agenda_pdf(F.col("h"), F.col("t"))).collect()
    assert [r[0] for r in got] == [True, False, True, False]


def july():
    return F.lit("2026-07-01").cast("date"), F.lit("2026-07-31").cast("date")


PAGES = "page_id long, url string, html string"


def test_listings(spark):
    page = '<nav><a href="mailto:x">City Council Agenda</a></nav><p><a href="/f/20260714-city-council-agenda.pdf">City Council <b>Agenda</b></a><a href="/f/20260714-city-council-agenda.pdf">again</a><a href="/f/20260814-city-council-agenda.pdf">City Council Agenda</a>'
    got = discovery.direct_listing(spark.createDataFrame([(1, "https://x.gov/list", page), (2, None, None)], PAGES), *july()).collect()
    assert [(r.page_id, r.pdf_url, r.title, r.meeting_date) for r in got] == [(1, "https://x.gov/f/20260714-city-council-agenda.pdf", "City CouncilAgenda", dt.date(2026, 7, 14))]
    row = '<table><tr><th>x</th></tr><tr><td>7/6/2026</td><td><a href="/ViewFile/1?html=true">HTML</a><a href="/ViewFile/min.pdf">Minutes</a><a href="/ViewFile/2.pdf">PDF</a></td></tr><tr><td>undated<td><a href="/ViewFile/3.pdf">PDF</a></tr><tr><td>7/7/2026<td><a href="/agenda/4">Agenda</a></tr><tr><td>7/8/2026<td><a href="/agenda/5">Agenda</a></tr></table>'
    probes = spark.createDataFrame([("https://x.gov/agenda/4", 405, None, "application/pdf"), ("https://x.gov/agenda/5", 200, "text/html", None)], "url string, head_status int, head_type string, get_type string")
    got = discovery.row_listing(spark.createDataFrame([(1, "https://x.gov/list", row)], PAGES), probes, *july()).collect()
    assert sorted((r.pdf_url, r.title, r.meeting_date) for r in got) == [("https://x.gov/ViewFile/2.pdf", "PDF", dt.date(2026, 7, 6)), ("https://x.gov/agenda/4", "Agenda", dt.date(2026, 7, 7))]
    assert html.anchors(spark.createDataFrame([(1, '<a href="x">a&amp;b<br>c')], "page_id long, html string")).first().text == "a&bc"


def test_listing_kinds(spark):
    pages = ['<table class="listtable2"><tr><td>a</table>', '<table class="x listtable"><tr><td>a</tr><tr><td>b</table><table class="listtable"><tr><td>c</table>', '<table class="listtable"><tr><td>a</table><div class="MeetingRow">m</div>', '<div class="MeetingRow">m</div><li class="y catAgendaRow">c</li>', '<div><p><a href="x">l</a></div><div>none</div>']
    got = html.listing_rows(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).orderBy("page_id", "row").collect()
    assert [(r.page_id, r.kind, r.text) for r in got] == [(1, "listtable", "a"), (1, "listtable", "b"), (2, "MeetingRow", "m"), (3, "catAgendaRow", "c"), (4, "fallback", "l")]


def test_links_resolve_as_recorded(spark):
    root = "https://x.gov"
    fetches = [
        (f"{root}/AgendaViewer.php?1", 302, "https://docs.google.com/gview?url=https%3A%2F%2Fa_b.s3.amazonaws.com%2Fk.pdf", None, None),
        (f"{root}/AgendaViewer.php?2", 302, "/AgendaOnline/ViewMeeting?2", None, None),
        (f"{root}/AgendaOnline/ViewMeeting?2", 200, None, "text/html", '<a href="mailto:a.pdf">m</a><a href="/AgendaOnline/Documents/Downloadfile/A%20b.pdf?documentType=1&meetingId=5">Packet</a>'),
        (f"{root}/AgendaViewer.php?3", 302, None, None, None),
        (f"{root}/AgendaViewer.php?4", 500, None, "application/pdf", None),
        *[(f"{root}/ViewMeeting?{i}", 302, f"/ViewMeeting?{i + 1}", None, None) for i in range(10, 16)],
        (f"{root}/ViewMeeting?16", 200, None, "application/pdf;x", None),
    ]
    downloads = [(f"{root}/AgendaOnline/Documents/Downloadfile/A%20b.pdf?documentType=1&meetingId=5", '{"DocumentName":"A b.pdf","DocumentType":"AgendaPacket","MeetingId":5,"IsSection":true}')]
    links = {f"{root}/AgendaViewer.php?1": "https://s3.amazonaws.com/a_b/k.pdf", f"{root}/AgendaViewer.php?2": f"{root}/AgendaOnline/Documents/ViewDocument/A%20b.pdf?meetingId=5&documentType=AgendaPacket&itemId=0&publishId=0&isSection=true", f"{root}/AgendaViewer.php?3": None, f"{root}/AgendaViewer.php?4": None, f"{root}/x.PDF": f"{root}/x.PDF", f"{root}/View.ashx?M=A": f"{root}/View.ashx?M=A", f"{root}/about": None, f"{root}/ViewMeeting?12": f"{root}/ViewMeeting?16", f"{root}/ViewMeeting?11": None}
    got = discovery.resolve_links(spark.createDataFrame([(x,) for x in links], "url string"), spark.createDataFrame(fetches, "url string, status int, location string, content_type string, html string"), spark.createDataFrame(downloads, "url string, payload string"))
    assert {r.url: r.target for r in got.collect()} == links


def test_vendor_payloads(spark):
    civic, prime = "https://a.api.civicclerk.com/v1/Events", "https://b.primegov.com/api/list?year=2026"
    rows = [
        (1, civic, '{"value":[{"startDateTime":null,"eventDate":"2026-07-03","Files":[],"Documents":[{"id":4,"name":"Minutes"},{"fileId":0,"id":5,"name":"x"},{"fileId":"6","type":"AGENDA"}]},{"files":[{"id":9}]}]}'),
        (2, prime, '{"value":null,"data":[{"date":"2026-07-03","documentList":[]}]}'),
        (3, prime, '{"data":[{"dateTime":"","date":"Jul 3, 2026","documentList":[{"id":1,"templateName":"Agenda","compileOutputType":3},{"id":2,"templateName":"Packet","compileOutputType":1}]}]}'),
        (4, "https://x.gov/api", "[]"),
        (5, civic, "<html>"),
        (6, civic, '[{"date":"2026-09-03","files":[{"id":9}]}]'),
    ]
    got = discovery.api_listing(spark.createDataFrame(rows, "page_id long, url string, payload string"), *july()).orderBy("page_id").collect()
    assert [(r.page_id, r.pdf_url, r.meeting_date) for r in got] == [(1, "https://a.api.civicclerk.com/v1/Meetings/GetMeetingFileStream(fileId=6,plainText=false)", None), (3, "https://b.primegov.com/Public/CompiledDocument/2", dt.date(2026, 7, 3))]


def test_sources_and_sweeps(spark):
    s = spark.createDataFrame([("A",), ("B County",)], "jurisdiction string").withColumn("name", serving.source_name(F.col("jurisdiction")))
    assert {r.name for r in s.collect()} == {"A City Council", "B County Board of Supervisors"}
    assert discovery.targeted(s, None).count() == 2 and discovery.targeted(s, ["A City Council"]).count() == 1
    for names in ([], ["C"]):
        with pytest.raises(ValueError):
            discovery.targeted(s, names)
    found = spark.createDataFrame([(i, f"u{i}", None) for i in range(6)], "place long, pdf_url string, title string")
    started = discovery.sweep(found, found.where("place in (0, 2)").select("pdf_url"), 3)
    assert [r.place for r in started.collect()] == [1, 3, 4]
    assert tuple(discovery.run_summary(found, started).first()) == (6, 3, ["u1", "u3", "u4"])


def test_point_in_polygon_and_cascade(spark):
    parcels = spark.createDataFrame([("042-1", "1540 EL CAMINO REAL", "A"), ("042-0", "1540 El Camino Real #2", "A"), ("9", "1540 El Camino Real", "B")], "apn string, address string, city string")
    asked = spark.createDataFrame([(1, "1540 El Camino Real", "a"), (2, "1540 El Camino Real", "Z"), (3, "7 Nowhere Ln; 8 There St", "A"), (4, " ", None), (5, None, None)], "ask_id long, address string, city string")
    geocodes = spark.createDataFrame([("7 Nowhere Ln", 2, 5.0, 5.0), ("7 Nowhere Ln", 1, 0.5, 0.5)], "address string, hit int, x double, y double")
    ring = lambda a: [(a, 0.0), (1.0, 0.0), (1.0, 1.0), (a, 1.0)]
    polygons = spark.createDataFrame([("p", 2, ring(0.0)), ("q", 1, ring(0.25)), ("p", 3, ring(0.4999)), ("far", 4, [(4.0, 4.0), (9.0, 4.0), (9.0, 9.0)])], "apn string, place int, ring array<struct<x:double,y:double>>")
    got = {r.ask_id: r.apns for r in resolve.cascade(asked, parcels, geocodes, polygons).collect()}
    assert got == {1: ["042-0", "042-1"], 2: ["042-0", "042-1", "9"], 3: ["q", "p"], 4: [], 5: []}


def test_vendor_payloads_in_odd_shapes(spark):
    """Members that are there but null, arrays in either wrapper, texts that aren't JSON, and lists in the vendor's order."""
    stream, compiled = "https://a.civicclerk.com/v1/Events/", "https://b.primegov.com/api/list"
    rows = [
        (1, stream, '{"value":null,"data":[{"date":"2026-07-01","files":[{"fileId":1}]}]}'),  # value is there, so data doesn't count
        (2, stream, '{"data":[{"date":"2026-07-01","files":[{"fileId":0,"id":"2","name":"Minutes"},{"id":"7","name":"x"},{"id":8,"type":"AGENDA"}],"Documents":[]}]}'),
        (3, stream, '[{"startDateTime":null,"date":"2026-07-01","Files":[],"documents":[{"fileId":9,"type":null,"name":"agenda"}]}]'),
        (4, stream, '[{"files":[{"fileId":1}]}]'),  # no date's name at all
        (5, stream, "not json"), (6, stream, None), (7, stream, '{"value":[3,null,"x"]}'), (8, "https://c.example/api", '[{"date":"2026-07-01","files":[{"fileId":1}]}]'),
        (9, compiled, '[{"dateTime":"","date":"2026-07-02","documentList":[{"id":1,"templateName":"Packet","compileOutputType":1},{"id":2,"templateName":"The Agenda","compileOutputType":1},{"id":3,"templateName":"Agenda","compileOutputType":3}]}]'),
        (10, compiled, '{"value":[{"date":"2026-07-02","documentList":[{"id":5,"templateName":null,"compileOutputType":1},{"id":"6","templateName":"PACKET","compileOutputType":"1"}]},{"documentList":null},{}]}'),
    ]
    date = lambda x: F.lit(x).cast("date")
    got = discovery.api_listing(spark.createDataFrame(rows, "page_id int, url string, payload string"), date("2026-07-01"), date("2026-07-31"))
    file = lambda n: f"https://a.civicclerk.com/v1/Meetings/GetMeetingFileStream(fileId={n},plainText=false)"
    assert sorted((r.page_id, r.pdf_url, str(r.meeting_date)) for r in got.collect()) == [(2, file(8), "2026-07-01"), (3, file(9), "None"), (9, "https://b.primegov.com/Public/CompiledDocument/2", "2026-07-02"), (10, "https://b.primegov.com/Public/CompiledDocument/6", "2026-07-02")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_hops_in_chains_and_cycles(spark):
    """Five hops lead on, six don't; cycles end; a file by its shape needs no look."""
    page = lambda n: f"https://h.example/AgendaViewer.php?id={n}"
    row = lambda url, to=None, kind="text/html", status=None: (url, status or (302 if to else 200), to, kind, None)
    fetches = [row(page(i), page(i + 1)) for i in range(1, 8)] + [row(page(8), kind="application/pdf")]
    fetches += [row(page(20), page(21)), row(page(21), page(20)), row(page(30), page(30)), row(page(40), "https://store.example/blob"), row(page(50), "/f/50.pdf")]
    fetches = spark.createDataFrame(fetches, "url string, status int, location string, content_type string, html string")
    asked = [page(i) for i in (1, 3, 4, 5, 8, 20, 30, 40, 50, 99)] + ["https://h.example/a.pdf", "https://h.example/else", None]
    links = spark.createDataFrame([(u,) for u in asked], "url string")
    got = {r.url: r.target for r in discovery.resolve_links(links, fetches, spark.createDataFrame([], "url string, payload string")).collect()}
    file = page(8)
    want = {page(1): None, page(3): None, page(4): file, page(5): file, page(8): file, page(20): None, page(30): None, page(40): "https://store.example/blob", page(50): "https://h.example/f/50.pdf", page(99): None, "https://h.example/a.pdf": "https://h.example/a.pdf", "https://h.example/else": None, None: None}
    assert got == want
    plan = lambda depth: discovery.resolve_links(links, fetches, spark.createDataFrame([], "url string, payload string"), depth)._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert plan(2) == plan(40)
