"""From portal listings to new documents.

Each kind of source has its listing: direct links, rows that lead to a file over pages between, rows with document
links, or a vendor's JSON. All give (page_id, pdf_url, title, meeting_date) of what lies in a date window, undated
documents included; ``discover`` unites them by the kind of their source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import portal
from plinth.sources import html
from plinth.sources.shared import materialize

LISTED = ["page_id", "pdf_url", "title", "meeting_date"]
#: Further looks that an address may take until its file; and statuses of redirects, and of unsupported requests.
DEPTH, REDIRECTS, UNSUPPORTED = 4, [301, 302, 303, 307, 308], [404, 405]
#: Names under which vendors give files and dates.
FILE_LISTS = ["publishedFiles", "Files", "MeetingFiles", "Documents", "files", "documents"]
DATE_NAMES = ["startDateTime", "eventDate", "meetingDate", "date"]
TEMPLATES = ["agenda", "packet"]
STREAM, COMPILED = "/Meetings/GetMeetingFileStream(fileId=", "/Public/CompiledDocument/"


def _within(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    return rows.where(portal.in_window(F.col("meeting_date"), start, end))


def direct_listing(pages: DataFrame, start: Column, end: Column) -> DataFrame:
    """Agenda links of pages (page_id, url, html), each address once."""
    a = html.anchors(pages).where(portal.looks_like_agenda_pdf(F.col("href"), F.col("text")))
    a = a.join(pages.select("page_id", "url"), "page_id").withColumn("pdf_url", portal.normalize_url("url", "href"))
    first = a.groupBy("page_id", "pdf_url").agg(F.min_by(F.struct("href", "text"), "idx").alias("a"))
    title = F.when(F.col("a.text") != "", F.col("a.text")).otherwise(F.col("a.href"))
    return _within(first.select("page_id", "pdf_url", title.alias("title"), portal.meeting_date(F.concat_ws(" ", "a.href", "a.text")).alias("meeting_date")), start, end)


def agenda_rows(pages: DataFrame, start: Column, end: Column) -> DataFrame:
    """(page_id, row, url, title, meeting_date): the first agenda link of each table row in the window, not yet resolved.

    A row without a date in its text may have one in its date cell.
    """
    agenda = F.get(F.filter("links", lambda a: portal.is_navigable(a["href"]) & F.contains(F.lower(a["text"]), F.lit("agenda"))), 0)
    rows = html.page_rows(pages).where("tag = 'tr'").select("page_id", "row", F.col("url").alias("base"), agenda.alias("a"), F.coalesce(portal.meeting_date(F.col("text")), portal.short_year_date(F.col("date_cell"))).alias("meeting_date"))
    rows = _within(rows.where("a IS NOT NULL"), start, end)
    return rows.select("page_id", "row", portal.normalize_url("base", "a.href").alias("url"), F.nullif(F.col("a.text"), F.lit("")).alias("title"), "meeting_date")


def row_listing(pages: DataFrame, probes: DataFrame, start: Column, end: Column) -> DataFrame:
    """The best link of each row of a page's listing, by tier and place, each address once.

    Rows without a listing's marks need a date. Links that don't end in .pdf need a recorded probe that finds a PDF.
    """
    tiers = F.transform("links", lambda a: F.struct(portal.link_tier(a["href"], F.concat_ws(" ", a["text"], a["label"])).alias("tier"), a["idx"].alias("idx"), a["href"].alias("href"), a["text"].alias("text")))
    best = F.struct(portal.meeting_date(F.col("text")).alias("meeting_date"), F.array_min(F.filter(tiers, lambda a: a["tier"].isNotNull())).alias("a"))
    # The generator keeps what filters ask for from being made again for them.
    rows = html.page_rows(pages).where("kind IS NOT NULL").select("page_id", "row", "kind", F.col("url").alias("base"), F.inline(F.array(best)))
    found = rows.where((F.col("kind") != html.FALLBACK) | F.col("meeting_date").isNotNull()).where("a IS NOT NULL").withColumn("pdf_url", portal.normalize_url("base", "a.href"))
    once = found.groupBy("page_id", "pdf_url").agg(F.min_by(F.struct(F.nullif(F.col("a.text"), F.lit("")).alias("title"), "meeting_date"), "row").alias("r"))
    once = _within(once.select("page_id", "pdf_url", "r.title", "r.meeting_date"), start, end)
    good = pdf_probes(probes).where("is_pdf").select(F.col("url").alias("pdf_url")).distinct().withColumn("good", F.lit(True))
    named = F.endswith(F.lower("pdf_url"), F.lit(".pdf"))  # one join for both, so that pages aren't parsed for either
    return once.join(good, "pdf_url", "left").where(named | F.col("good")).select(*LISTED)


def pdf_probes(probes: DataFrame) -> DataFrame:
    """(url, is_pdf) from recorded probes (url, head_status, head_type, get_type); a GET counts where HEAD isn't supported."""
    kind = F.when(F.col("head_status").isin(*UNSUPPORTED), F.col("get_type")).otherwise(F.col("head_type"))
    return probes.select("url", portal.is_pdf(kind).alias("is_pdf"))


def _field(of: str, name: str, kind: str = "string") -> Column:
    """A member of a VARIANT column as a type; null where it is missing, null or another type."""
    return F.try_variant_get(F.col(of), f"$.{name}", kind)


def has_member(of: str, name: str) -> Column:
    """Whether an object has a member, even if it is null there."""
    return F.variant_get(F.col(of), f"$.{name}", "variant").isNotNull()


def _elements(parsed: str) -> Column:
    """The elements of a vendor's payload: of itself, or of the array in ``value`` if that is there, or else in ``data``."""
    inner = F.when(has_member(parsed, "value"), _field(parsed, "value", "array<variant>")).otherwise(_field(parsed, "data", "array<variant>"))
    return F.coalesce(F.try_variant_get(F.col(parsed), "$", "array<variant>"), inner)


def first_present(of: str, names: list[str]) -> Column:
    """The text of the first name that an object has, even if it is null there."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(has_member(of, name), _field(of, name)).otherwise(out)
    return out


def any_present(of: str, names: list[str]) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | has_member(of, name)
    return out


def _first_true(*values: Column) -> Column:
    return F.coalesce(*[F.when(portal.truthy(v), v) for v in values])


def _stream_file(of: str) -> Column:
    """The id of a file in the first of the lists that has any but minutes: the first agenda, else the first."""
    listed = []
    for order, name in enumerate(FILE_LISTS):
        files = _field(of, name, "array<struct<fileId:string,id:string,type:string,name:string>>")
        rows = F.transform(files, lambda f, i: F.struct(F.lit(order).alias("order"), i.alias("i"), F.lower(F.coalesce(_first_true(f["type"], f["name"]), F.lit(""))).alias("label"), _first_true(f["fileId"], f["id"]).alias("number")))
        listed.append(F.coalesce(rows, F.array().cast("array<struct<order:int,i:int,label:string,number:string>>")))
    usable = F.filter(F.concat(*listed), lambda f: f["number"].isNotNull() & ~F.contains(f["label"], F.lit("minutes")))
    return F.array_min(F.transform(usable, lambda f: F.struct(f["order"], ~F.contains(f["label"], F.lit("agenda")), f["i"], f["number"].alias("number"))))["number"]


def _compiled_file(of: str) -> Column:
    """The id of the first compiled document of output type 1 that is named after the best template."""
    files = _field(of, "documentList", "array<struct<id:string,templateName:string,compileOutputType:string>>")
    best = lambda f: F.coalesce(*[F.when(F.contains(F.lower(f["templateName"]), F.lit(w)), F.lit(i)) for i, w in enumerate(TEMPLATES)])
    rows = F.transform(F.filter(files, lambda f: f["id"].isNotNull() & (f["compileOutputType"] == "1")), lambda f, i: F.struct(best(f).alias("best"), i.alias("i"), f["id"].alias("id")))
    return F.array_min(F.filter(rows, lambda f: f["best"].isNotNull()))["id"]


def api_listing(payloads: DataFrame, start: Column, end: Column) -> DataFrame:
    """Agenda files of vendor payloads (page_id, url, payload); the vendor shows in the address, others give no rows.

    One vendor lists files that its stream serves beside the listing, and needs a date's name; the other lists compiled
    documents under its own root. A payload is parsed once, as VARIANT; generators keep what filters ask for from being
    made again for them. Payloads that aren't JSON, or repeat a name in an object, give no rows.
    """
    address = F.lower("url")
    vendor = F.when(F.contains(address, F.lit("civicclerk")), "stream").when(F.contains(address, F.lit("primegov")), "compiled")
    parsed = payloads.withColumn("vendor", vendor).where("vendor IS NOT NULL").select("page_id", "url", "vendor", F.try_parse_json("payload").alias("parsed"))
    items = parsed.select("page_id", "url", "vendor", F.explode_outer(_elements("parsed")).alias("item"))
    stream = F.col("vendor") == "stream"
    date = F.when(stream, first_present("item", DATE_NAMES)).otherwise(_first_true(_field("item", "dateTime"), _field("item", "date")))
    path = F.when(stream, F.concat(portal.parent_url(F.col("url")), F.lit(STREAM), _stream_file("item"), F.lit(",plainText=false)"))).otherwise(F.concat(F.lit(COMPILED), _compiled_file("item")))
    rows = items.where(F.col("item").isNotNull() & (~stream | any_present("item", DATE_NAMES))).select("page_id", "url", F.inline_outer(F.array(F.struct(path.alias("path"), date.alias("date")))))
    rows = rows.where("path IS NOT NULL").select("page_id", "url", "path", F.explode_outer(F.array(portal.meeting_date(F.col("date")))).alias("meeting_date"))
    rows = _within(rows, start, end)
    return rows.select("page_id", portal.normalize_url("url", "path").alias("pdf_url"), F.lit(None).cast("string").alias("title"), "meeting_date")


def _hops(fetches: DataFrame, downloads: DataFrame) -> DataFrame:
    """(seen, onward, ends): where a recorded answer leads on to, and whether that is the file.

    ``fetches`` has url, status, location, content_type and html; ``downloads`` has url and the payload of the first step.
    """
    redirect = fetches.where(F.col("status").isin(*REDIRECTS) & (F.length("location") > 0)).withColumn("to", portal.normalize_url("url", portal.unwrap_viewer(F.col("location"))))
    lower = F.lower("to")
    known = F.endswith(lower, F.lit(".pdf")) | portal.any_of(lower, portal.SERVED_FILES) | portal.any_of(F.col("to"), portal.VIEWERS)
    redirects = redirect.select(F.col("url").alias("seen"), F.when(known, F.col("to")).otherwise(portal.fix_bucket_host(F.col("to"))).alias("onward"), (~known).alias("ends"))
    answers = fetches.where((F.col("status") < 400) & ~F.col("status").isin(*REDIRECTS))
    is_file = (F.col("status") == 200) & portal.is_pdf(F.col("content_type"))
    served = answers.where(is_file).select(F.col("url").alias("seen"), portal.fix_bucket_host(F.col("url")).alias("onward"), F.lit(True).alias("ends"))
    between = answers.where(~is_file).withColumn("page_id", F.xxhash64("url"))
    first = html.anchors(between).where(portal.names_a_file(F.col("href"))).groupBy("page_id").agg(F.min_by("href", "idx").alias("href"))
    linked = first.join(between.select("page_id", "url"), "page_id").select(F.col("url").alias("seen"), portal.normalize_url("url", portal.unwrap_viewer(F.col("href"))).alias("onward"), F.lit(False).alias("ends"))
    stepped = downloads.select(F.col("url").alias("seen"), portal.view_document_url(F.col("url"), F.col("payload")).alias("onward"), F.lit(True).alias("ends"))
    return redirects.unionByName(served).unionByName(linked).unionByName(stepped).where("onward IS NOT NULL").dropDuplicates(["seen"])


def _looked_at(address: Column, ends: Column) -> list[Column]:
    """(target, ask): the file that an address is, as a hop's end or by its shape; else what has to be looked at next."""
    at = portal.unwrap_viewer(address)
    shape = portal.link_shape(at)
    target = F.when(ends, address).when(shape == "file", portal.fix_bucket_host(at))
    return [target.alias("target"), F.when(~ends & shape.isin("page", "download"), at).alias("ask")]


_WALK = """
WITH RECURSIVE walk(url, ask, target, hop, path) AS (
  SELECT url, ask, target, 0, array(ask) FROM {start}
  UNION ALL
  SELECT walk.url, step.ask, CASE WHEN step.ends OR walk.hop < {depth} THEN step.target END, walk.hop + 1, array_append(walk.path, step.ask)
  FROM walk JOIN {steps} AS step ON walk.ask = step.seen
  WHERE walk.target IS NULL AND walk.hop <= {depth} AND NOT coalesce(array_contains(walk.path, step.ask), false)
)
SELECT url, max(target) AS target FROM walk GROUP BY url
"""


def resolve_links(links: DataFrame, fetches: DataFrame, downloads: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(url, target): each link's file as recorded answers lead to it, in ``depth`` further looks at most; else null.

    A recursive query over the table of hops: what is left to look at joins it again, a way that comes back to an
    address ends there, and the plan is the same for any depth.
    """
    spark = links.sparkSession
    hops = _hops(fetches, downloads)
    steps = materialize(hops.select("seen", "ends", *_looked_at(F.col("onward"), F.col("ends"))))
    start = materialize(links.select("url").where("url IS NOT NULL").distinct().select("url", *_looked_at(F.col("url"), F.lit(False))))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the hops bound the recursion, not the number of links
    walked = spark.sql(_WALK, start=start, steps=steps, depth=depth)
    return links.select("url").distinct().join(walked, "url", "left")


def resolved_rows(pages: DataFrame, fetches: DataFrame, downloads: DataFrame, start: Column, end: Column) -> DataFrame:
    """The files that ``agenda_rows`` lead to; rows whose link can't be resolved are left out."""
    rows = materialize(agenda_rows(pages, start, end))
    targets = resolve_links(rows, fetches, downloads).where("target IS NOT NULL")
    return rows.join(targets, "url").select("page_id", F.col("target").alias("pdf_url"), "title", "meeting_date")


def targeted(sources: DataFrame, names: list[str] | None) -> DataFrame:
    """The sources of the given names, all for None; no names, and names that no source has, are errors."""
    if names is None:
        return sources
    if not names:
        raise ValueError("select at least one market")
    chosen = sources.where(F.col("name").isin(*names))
    if not chosen.take(1):
        raise ValueError("no selected market is a configured source")
    return chosen


def discover(sources: DataFrame, pages: DataFrame, fetches: DataFrame, downloads: DataFrame, probes: DataFrame, start: Column, end: Column) -> DataFrame:
    """(jurisdiction, pdf_url, title, meeting_date, source_type): what all sources list in the window.

    ``pages`` has page_id, jurisdiction, url and html (a payload for JSON sources). Sources of an unknown kind give none.
    """
    own = pages.join(sources.select("jurisdiction", "source_type"), "jurisdiction")
    kind = lambda k: own.where(F.col("source_type") == k)
    listed = direct_listing(kind("direct_pdf"), start, end).select(*LISTED)
    for more in (resolved_rows(kind("granicus_dom"), fetches, downloads, start, end), row_listing(kind("civicplus_dom"), probes, start, end), api_listing(kind("api").withColumnRenamed("html", "payload"), start, end)):
        listed = listed.unionByName(more.select(*LISTED))
    return listed.join(own.select("page_id", "jurisdiction", "source_type"), "page_id").select("jurisdiction", "pdf_url", "title", "meeting_date", "source_type")


def sweep(found: DataFrame, failed: DataFrame, cap: int) -> DataFrame:
    """(place, pdf_url, title): the first ``cap`` documents (place, pdf_url, title) whose download succeeds, in order."""
    return found.join(failed.select("pdf_url").distinct(), "pdf_url", "left_anti").orderBy("place").limit(cap).select("place", "pdf_url", F.coalesce("title", "pdf_url").alias("title"))


def run_summary(found: DataFrame, started: DataFrame) -> DataFrame:
    """One row: documents found, jobs started, and the addresses of those jobs in order (as many as the sweep's cap)."""
    jobs = F.transform(F.array_sort(F.collect_list(F.struct("place", "pdf_url"))), lambda x: x["pdf_url"])
    return found.agg(F.count("*").alias("documents_found")).crossJoin(started.agg(F.count("*").alias("jobs_started"), jobs.alias("jobs")))  # one row each
