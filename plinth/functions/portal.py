"""Functions over portal listings: links, addresses and dates, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word lists and patterns of the discovery.
BODIES = ["city council", "planning commission", "zoning", "board of supervisors"]
AGENDAS = ["agenda", "packet", "staff report"]
UNWANTED = ["parks", "recreation", "aquatics", "library", "picnic", "senior", "arts", "heritage", "minutes"]
LINK_MARKERS = ["viewfile", "agenda", ".pdf", "showpublisheddocument", "fileopen.aspx"]
REJECTED_HREFS = ["notification", "subscribe", "signup"]
DEPRIORITIZED = ["minutes", "addendum", "amendment"]
VIEWERS = ["AgendaViewer.php", "AgendaOnline", "ViewMeeting", "Calendar.aspx"]
SERVED_FILES = ["view.ashx", "showpublisheddocument"]
DOWNLOAD = "documents/downloadfile"
FILE_LINKS = [".pdf", "documenttype=5", "downloadfile"]
VIEW_DOCUMENT = "/AgendaOnline/Documents/ViewDocument/"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|sept|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
MONTH_DATE = rf"(?iU)\b((?:{MONTHS})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+20\d{{2}})\b"
LOOK_BACK_DAYS = 30


def any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def is_navigable(href: Column) -> Column:
    """False for mailto:, tel: and javascript: pseudo-links."""
    return ~F.lower(F.trim(href)).rlike("^(mailto:|tel:|javascript:)")


def looks_like_agenda_pdf(href: Column, text: Column) -> Column:
    """A PDF whose file name or text names a relevant body and an agenda, and nothing unwanted."""
    path = F.split(href, r"\?", -1)[0]
    name = F.element_at(F.split(path, "/", -1), -1)
    hay = F.replace(F.lower(F.concat(name, F.lit(" "), text)), F.lit("-"), F.lit(" "))
    return is_navigable(href) & F.endswith(F.lower(path), F.lit(".pdf")) & ~any_of(hay, UNWANTED) & any_of(hay, BODIES) & any_of(hay, AGENDAS)


@F.pandas_udf(T.StringType())
def normalize_url(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A link resolved against its page's address."""
    for base, href in parts:
        yield pd.Series([None if b is None or h is None else urljoin(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def unwrap_viewer(url: Column) -> Column:
    """The target of a document-viewer link, decoded twice as its portals encode it; other addresses unchanged."""
    target = F.url_decode(F.url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("url"))))
    return F.when(F.contains(F.lower(url), F.lit("docs.google.com/gview")), F.coalesce(target, url)).otherwise(url)


def fix_bucket_host(url: Column) -> Column:
    """Buckets with an underscore in path style, for no certificate covers them as a host."""
    pattern = r"^https://([^/]*_[^/]*)\.s3\.amazonaws\.com/(.+)$"
    return F.regexp_replace(url, pattern, "https://s3.amazonaws.com/$1/$2")


def parent_url(url: Column) -> Column:
    """Without trailing slashes and the last segment."""
    return F.regexp_replace(F.regexp_replace(url, "/+$", ""), "/[^/]*$", "")


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "")


def link_shape(url: Column) -> Column:
    """What an address needs before its file is reached: a download in two steps, nothing, or a page between; null: no way."""
    u = F.lower(url)
    return F.when(F.contains(u, F.lit(DOWNLOAD)), "download").when(F.endswith(u, F.lit(".pdf")) | any_of(u, SERVED_FILES), "file").when(any_of(url, VIEWERS), "page")


def names_a_file(href: Column) -> Column:
    """Whether a link on a page between leads on to the file."""
    return is_navigable(href) & any_of(F.lower(unwrap_viewer(href)), FILE_LINKS)


def is_pdf(content_type: Column) -> Column:
    """Whether a content type is that of a PDF; a missing one isn't."""
    return F.startswith(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("application/pdf"))


def quote(text: Column) -> Column:
    """Percent-encoded for a path: letters, digits, ``_.-~`` and ``/`` stay."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def view_document_url(url: Column, payload: Column) -> Column:
    """Where a two-step download serves its file, from its link and the JSON that the first step gives; else null."""
    asked = [F.try_parse_url(url, F.lit("QUERY"), F.lit(k)) for k in ("documentType", "meetingId")]
    field = lambda name: F.get_json_object(payload, f"$.{name}")
    usable = (F.length(asked[0]) > 0) & (F.length(asked[1]) > 0) & (F.length(field("DocumentName")) > 0) & (F.length(field("DocumentType")) > 0) & field("MeetingId").isNotNull()
    section = F.when(truthy(field("IsSection")), "true").otherwise("false")
    base = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    number = lambda name: F.coalesce(field(name), F.lit("0"))
    made = F.concat(base, F.lit(VIEW_DOCUMENT), quote(field("DocumentName")), F.lit("?meetingId="), field("MeetingId"), F.lit("&documentType="), field("DocumentType"), F.lit("&itemId="), number("ItemId"), F.lit("&publishId="), number("PublishId"), F.lit("&isSection="), section)
    return F.when(usable, made)


def truthy(text: Column) -> Column:
    """Whether a JSON value, as text, is more than null, false, zero or empty."""
    return F.coalesce(~F.trim(text).isin("", "0", "0.0", "false", "null", "[]", "{}"), F.lit(False))


def _valid(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d")


def meeting_date(text: Column) -> Column:
    """The first real date in a text: YYYYMMDD, YYYY-MM-DD or M/D/YYYY in this order, else a "Month D, YYYY" phrase."""

    def first(pattern: str, order: tuple[int, int, int]) -> Column:
        groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in order]
        dates = F.transform(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "ymd", strict=True)]), lambda x: _valid(x["y"], x["m"], x["d"]))
        return F.get(F.filter(dates, lambda x: x.isNotNull()), 0)

    phrase = F.regexp_replace(F.regexp_extract(text, MONTH_DATE, 1), r"(?i)(\d)(st|nd|rd|th)|[.,]", "$1")
    phrase = F.initcap(F.regexp_replace(F.regexp_replace(phrase, r"\s+", " "), r"(?i)^sept ", "Sep "))
    named = F.coalesce(F.try_to_date(phrase, "MMM d yyyy"), F.try_to_date(phrase, "MMMM d yyyy"))
    return F.coalesce(first(r"(20\d{2})(\d{2})(\d{2})", (1, 2, 3)), first(r"(20\d{2})-(\d{2})-(\d{2})", (1, 2, 3)), first(r"(\d{1,2})/(\d{1,2})/(20\d{2})", (3, 1, 2)), named)


def short_year_date(text: Column) -> Column:
    """A date that is all of M/D/YY; years from 69 on are in the last century."""
    x = F.trim(text)
    parsed = F.try_to_date(F.when(x.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), x), "M/d/yy")
    return F.when(F.substring(x, -2, 2).try_cast("int") >= 69, F.add_months(parsed, -1200)).otherwise(parsed)


def link_tier(href: Column, label: Column) -> Column:
    """0 to 3, the lower the better, for a document link of a row; null for links that never are one."""
    h, x = F.lower(href), F.lower(label)
    candidate = is_navigable(href) & ~any_of(h, REJECTED_HREFS) & any_of(h, LINK_MARKERS) & ~F.contains(F.concat(h, F.lit(" "), x), F.lit("html"))
    late = any_of(x, DEPRIORITIZED)
    return F.when(candidate, F.when(~late & F.contains(x, F.lit("agenda")), 0).when(~late & any_of(F.concat(h, F.lit(" "), x), ["pdf", "packet"]), 1).when(~late, 2).otherwise(3))


def in_window(date: Column, start: Column, end: Column) -> Column:
    """Inside the bounds, or undated; by default the 30 days up to ``end``, and ``end`` is today."""
    end = F.coalesce(end, F.current_date())
    return date.isNull() | date.between(F.coalesce(start, F.date_sub(end, LOOK_BACK_DAYS)), end)
