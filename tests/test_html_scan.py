"""Pages in one pass against the tolerant parser, and the table function over whole batches."""

import random

import pytest

from plinth.sources import html

PARTS = [
    "<div>", "</div>", '<div class="x MeetingRow">', "<tr>", "</tr>", "<td>", '<td headers="Date">', "</td>", "<table>", '<table class="a listtable">', "</table>", "<br>", "text", " two words ", "a&amp;b", "&amp", "&", "7/1/26", "é ",
    '<a href="/x?a=1&b=2">', '<a href="/x?html=true&agenda">', "</a>", '<A HREF="/y" aria-label="Agenda">', "<a name=\"z\">", "<a href=plain>", "<a href='q'>", '<a href="/v"class="w">', '<a href="">', "<br/>", "<!-- c -->", "<!doctype html>", "<script>", "</script>", "<style>", "<", ">", "</", "<1", "</ div>", "<p a>", '<li class="catAgendaRow">', "\n", '<i a="<b>">', "<b\n>", '<a href="1" href="2">', "</p >", "\x00",
]


def slow(text):
    page = html._Page()
    page.feed(text)
    page.close()
    return page


def of(page):
    return page.links, page.rows, page.listing(), [t for t, _, _ in page.open]


@pytest.mark.parametrize("plain", [True, False])
def test_one_pass_equals_the_tolerant_parser(plain):
    r = random.Random(5)
    parts, fast = [x for x in PARTS if html._scan(x + "<br>") is not None] if plain else PARTS, 0
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        fast += html._scan(text) is not None
        assert of(html._parse(text)) == of(slow(text)), text
    assert fast > (5000 if plain else 300)


def test_table_function_takes_whole_batches(spark):
    """One call to Python takes many pages: Spark hands a function of a table one row at a time, a function of a column a batch."""
    html.register(spark)
    pages = spark.createDataFrame([(1, "u", '<tr><td headers="Date">7/1/26</td><a href="x">A</a></tr>'), (2, "u", None), (None, "u", "<tr>"), (4, "u", "<p>")], "page_id long, url string, html string")
    out = spark.sql("SELECT page_id, r.* FROM {pages}, LATERAL page_rows(html) AS r", pages=pages)
    assert [tuple(x) for x in out.where("page_id IS NOT NULL").collect()] == [(1, 0, "tr", "fallback", "7/1/26 A", "7/1/26", [(0, "x", "A", "")])]
    assert [tuple(x) for x in html.page_rows(pages).drop("url").collect()] == [(1, 0, "tr", "fallback", "7/1/26 A", "7/1/26", [(0, "x", "A", "")])]
    for rows in (out, html.page_rows(pages)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython " in plan and "UDTF" not in plan


def test_row_listing_parses_pages_once(spark):
    """Links that end in .pdf and links that need a probe come from one pass over the pages."""
    from pyspark.sql import functions as F

    from plinth.operators import discovery

    row = '<table><tr><td>7/6/2026</td><td><a href="/ViewFile/2.pdf">PDF</a></td></tr><tr><td>7/7/2026<td><a href="/agenda/4">Agenda</a></tr></table>'
    probes = spark.createDataFrame([("https://x.gov/agenda/4", 200, "application/pdf", None)], "url string, head_status int, head_type string, get_type string")
    date = lambda x: F.lit(x).cast("date")
    got = discovery.row_listing(spark.createDataFrame([(1, "https://x.gov/list", row), (2, None, row)], "page_id long, url string, html string"), probes, date("2026-07-01"), date("2026-07-31"))
    assert sorted(r.pdf_url for r in got.collect()) == ["https://x.gov/ViewFile/2.pdf", "https://x.gov/agenda/4"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rows_of(") == 1 and plan.count("normalize_url(") == 1
