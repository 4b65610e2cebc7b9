"""From page texts to signals: sections, items, keywords, and what stands nearest to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plinth.functions import text as t
from plinth.operators import keywords, sweeps
from plinth.sources.shared import materialize


def _by_page() -> WindowSpec:
    return Window.partitionBy("document_id").orderBy("page_number")


def _tagged(found: Column, **tags: Column) -> Column:
    """Structs (pos, tags) of matches."""
    return F.transform(found, lambda m: F.struct(m["start"].alias("pos"), *[v.alias(k) for k, v in tags.items()]))


def page_offsets(pages: DataFrame) -> DataFrame:
    """Add ``page_start``: where each page begins in its document's text, pages being joined by one line end."""
    before = F.sum(F.length("page_text") + 1).over(_by_page().rowsBetween(Window.unboundedPreceding, -1))
    return pages.withColumn("page_start", F.coalesce(before, F.lit(0)).cast("long"))


def _page_marks(pages: DataFrame) -> DataFrame:
    """(document_id, kind, start, end, text): pages as matches for a sweep; ``text`` is the page's number.

    Pages with an exclusion word come once more, as ``out``.
    """
    placed = page_offsets(pages).withColumn("kind", F.explode(F.when(t.contains_any(F.col("page_text"), t.EXCLUSIONS), F.array(F.lit("page"), F.lit("out"))).otherwise(F.array(F.lit("page")))))
    return placed.select("document_id", "kind", F.col("page_start").alias("start"), (F.col("page_start") + F.length("page_text")).alias("end"), F.col("page_number").cast("string").alias("text"))


def _page_number() -> Column:
    """Of the page that a sweep found at or before a place, else the first one; 1 in a document without pages."""
    return F.coalesce(F.col("page_at.text"), F.col("page_next.text"), F.lit("1")).cast("int")


def page_of_offset(pages: DataFrame, offsets: DataFrame) -> DataFrame:
    """(document_id, offset, page_number): the page that holds an offset, the first for what is before all."""
    swept = sweeps.sweep(offsets.select("document_id", "offset"), _page_marks(pages), ["document_id"], "offset", ["page"])
    return swept.select("document_id", "offset", _page_number().alias("page_number"))


def sections(pages: DataFrame) -> DataFrame:
    """Add ``spans`` (start, end, kind) per page; a page begins in the section that the page before ended in."""
    marks = F.concat(*[_tagged(t.matches(F.col("page_text"), p), o=F.lit(i), kind=F.lit(k)) for i, (k, p) in enumerate(t.SECTIONS)])
    marked = pages.withColumn("marks", F.array_sort(marks))
    last = F.when(F.size("marks") > 0, F.element_at("marks", -1)["kind"])
    carried = F.coalesce(F.last(last, ignorenulls=True).over(_by_page().rowsBetween(Window.unboundedPreceding, -1)), F.lit("unknown"))
    marked = marked.withColumn("carry", carried)
    points = F.concat(F.array(F.struct(F.lit(0).alias("pos"), F.lit(-1).alias("o"), F.col("carry").alias("kind"))), F.col("marks"))
    marked = marked.withColumn("points", points)
    ends = F.concat(F.transform(F.slice("points", F.lit(2), F.size("points")), lambda x: x["pos"]), F.array(F.length("page_text")))
    spans = F.zip_with("points", ends, lambda p, e: F.struct(p["pos"].alias("start"), e.alias("end"), p["kind"].alias("kind")))
    return marked.withColumn("spans", F.filter(spans, lambda s: (s["end"] > s["start"]) | (F.size("points") == 1))).drop("marks", "carry", "points")


def eligible(spans: Column) -> Column:
    """Hearing spans if a page has any, else all but boilerplate and exhibits."""
    hearing = F.exists(spans, lambda s: s["kind"] == "hearing")
    return F.filter(spans, lambda s: F.when(hearing, s["kind"] == "hearing").otherwise(~s["kind"].isin("boilerplate", "exhibit")))


def item_header(item: Column) -> Column:
    """What names an item: the rest of its marker's line, and its subject line."""
    marker = t.ITEM.replace("(?iU)", "")
    title = F.when(item.rlike("^" + t.ITEM), F.trim(F.split(F.regexp_replace(item, "^(?iU)" + marker, ""), "\n", -1)[0])).otherwise("")
    subject = F.trim(F.regexp_extract(item, t.SUBJECT, 1))
    return F.array_join(F.filter(F.array(title, subject), lambda x: x != ""), "\n")


def header_address(header: Column) -> Column:
    """The address that an item without an APN stands for: in its header, not blacklisted, beside an entitlement; else null."""
    named = F.trim(F.regexp_extract(header, t.ADDRESS, 1))
    return F.when((named != "") & ~t.contains_any(named, t.BLACKLIST) & t.contains_any(header, t.ENTITLEMENTS), named)


_PAGE = ["document_id", "page_number"]


def page_signals(pages: DataFrame) -> DataFrame:
    """A row per keyword and place in an eligible span of a page, with what stands nearest to it in its item.

    The anchor for exclusions, zoning and addresses is the APN where there is one, else the keyword; an item without
    an APN may stand for an address of its header. ``kw_ord`` and ``pos`` order a page's signals. Pages without a
    keyword in an eligible span go before anything else is matched. A match that an item's or a search window's end
    would cut is left out, though a scan of the window alone might find a shorter one there: half an address or number
    names another place than the page does.
    """
    p = sections(pages).select(*_PAGE, "page_text", eligible(F.col("spans")).alias("ok"))
    p = keywords.with_hits(p, "page_text", {"keyword": keywords.LISTS["keyword"]})
    eligible_hits = F.filter("hits", lambda h: F.exists("ok", lambda s: (s["start"] <= h["pos"]) & (h["pos"] < s["end"])))
    p = materialize(p.select(*_PAGE, "page_text", eligible_hits.alias("hits")).where(F.size("hits") > 0).repartition(*_PAGE))
    hits = p.select(*_PAGE, F.length("page_text").alias("size"), F.inline("hits")).select(*_PAGE, "size", F.col("ord").alias("kw_ord"), F.col("word").alias("keyword"), "pos")
    found = materialize(sweeps.match_rows(p, _PAGE, "page_text", {"item": t.ITEM, "apn": t.APN, "zoning": t.ZONING, "street": t.ADDRESS, "label": t.LABELED_ADDRESS}))
    k = sweeps.sweep(hits, found, _PAGE, "pos", ["item", "apn"])
    k = k.withColumns({"low": F.coalesce("item_at.start", F.lit(0)), "high": F.coalesce("item_next.start", "size")})
    k = k.withColumn("near", sweeps.nearest("apn", F.col("pos"), F.col("low"), F.col("high"))).withColumn("anchor", F.coalesce("near.start", "pos"))
    k = k.select(*_PAGE, "kw_ord", "keyword", "pos", "low", "high", "anchor", F.col("near.text").alias("near"))
    k = sweeps.sweep(k, found, _PAGE, "anchor", ["zoning", "street", "label"])
    bounds = F.col("anchor"), F.col("low"), F.col("high")
    k = k.withColumns({"zoning": sweeps.nearest("zoning", *bounds)["text"], "found_address": sweeps.find_address(*bounds)}).select(*_PAGE, "kw_ord", "keyword", "pos", "low", "high", "anchor", "near", "zoning", "found_address")
    k = k.join(p.drop("hits"), _PAGE)
    text = F.col("page_text")
    stands = F.when(F.col("near").isNull(), header_address(item_header(t.within(text, F.col("low"), F.col("high")))))
    around = t.within(text, F.greatest(F.col("low"), F.col("anchor") - t.EXCLUSION_REACH), F.least(F.col("high"), F.col("anchor") + t.EXCLUSION_REACH))
    k = k.withColumns({"stands": stands, "excluded": t.contains_any(around, t.EXCLUSIONS)})
    return k.select(
        *_PAGE,
        "kw_ord",
        "pos",
        "keyword",
        F.coalesce("near", F.concat(F.lit("ADDR: "), "stands")).alias("apn"),
        F.when(F.col("excluded"), "EXCLUDED").otherwise(F.element_at(F.array(*[F.lit(s) for _, s in t.KEYWORDS]), F.col("kw_ord") + 1)).alias("signal_strength"),
        F.when(F.col("near").isNotNull(), F.col("found_address")).otherwise(F.col("stands")).alias("address"),
        F.regexp_extract("zoning", t.ZONING, 1).alias("current_zoning"),
        F.regexp_extract("zoning", t.ZONING, 2).alias("proposed_zoning"),
        t.snippet(text, F.col("pos"), F.col("pos") + F.length("keyword")).alias("snippet"),
    )


def _joined(pages: DataFrame) -> DataFrame:
    """(document_id, full, starts): each document's text, and where its pages begin in it."""
    one = F.array_sort(F.collect_list(F.struct("page_number", "page_text", "page_start")))
    docs = page_offsets(pages).groupBy("document_id").agg(one.alias("p"))
    return docs.select("document_id", F.array_join(F.transform("p", lambda x: x["page_text"]), "\n").alias("full"), F.transform("p", lambda x: F.struct(x["page_start"].alias("start"), x["page_number"].alias("page_number"))).alias("starts"))


def _page_at(starts: Column, offset: Column) -> Column:
    """The last page that begins at an offset or before it, else the first."""
    at = F.filter(starts, lambda x: x["start"] <= offset)
    return F.coalesce(F.get(at, F.size(at) - 1)["page_number"], F.get(starts, 0)["page_number"], F.lit(1))


def _texts(pages: DataFrame) -> DataFrame:
    """(document_id, full, sb79): each document's text, and whether it names the state's density law."""
    return materialize(_joined(pages).select("document_id", "full", F.col("full").rlike(t.SB79).alias("sb79")))


def _numbered(found: DataFrame, title: Column, *more: str) -> DataFrame:
    """The rows of a sweep over a document's numbers as signals, once their document's text is beside them."""
    zoning = t.policy_zoning(title, F.col("sb79"), F.col("signal_strength"))
    return found.select(
        "document_id",
        F.col("start").cast("long").alias("offset"),
        F.col("text").alias("apn"),
        "keyword",
        "signal_strength",
        _page_number().alias("page_number"),
        zoning["current"].alias("current_zoning"),
        zoning["proposed"].alias("proposed_zoning"),
        "address",
        t.snippet(F.col("full"), F.col("start"), F.col("apn_end")).alias("snippet"),
        *more,
    )


def exhibit_apns(pages: DataFrame) -> DataFrame:
    """A signal for each strict APN in an exhibit, with the zoning that the exhibit implies and the nearest address in it.

    An exhibit goes from its header to the next one. The words up to ``HEADER_REACH`` characters past the header decide
    on its parcels; their first line is its title.
    """
    docs = _texts(pages)
    found = sweeps.match_rows(docs, ["document_id"], "full", {"head": t.SECTIONS[2][1], "apn": t.APN, "street": t.ADDRESS, "label": t.LABELED_ADDRESS})
    found = materialize(found.unionByName(_page_marks(pages).withColumns({"start": F.col("start").cast("int"), "end": F.col("end").cast("int")})))
    apns = found.where("kind = 'apn'").select("document_id", "start", F.col("end").alias("apn_end"), "text")
    e = sweeps.sweep(apns, found, ["document_id"], "start", ["head", "street", "label", "page"]).where("head_at IS NOT NULL").join(docs, "document_id")
    e = e.withColumn("high", F.coalesce("head_next.start", F.length("full"))).where(F.col("apn_end") <= F.col("high"))
    e = e.withColumn("address", sweeps.find_address(F.col("start"), F.col("head_at.start"), F.col("high")))
    reach = F.least(F.col("head_at.end") + t.HEADER_REACH, F.col("high"))
    line = F.translate(t.within(F.col("full"), F.col("head_at.start"), reach), "\n", " ")
    title = F.trim(F.split(F.regexp_replace(t.within(F.col("full"), F.col("head_at.end"), reach), r"^(?U)\s+|\s+$", ""), "\n", -1)[0])
    e = e.withColumns({"keyword": F.concat("head_at.text", F.lit(" listing")), "signal_strength": F.when(t.contains_any(line, t.EXHIBIT_EXCLUSIONS), "EXCLUDED").otherwise("MED")})
    return _numbered(e, title)


def apn_sweep(pages: DataFrame) -> DataFrame:
    """Strict, then broad numbers of each document, one row per place; EXCLUDED where the page has an exclusion word."""
    docs = _texts(pages)
    found = sweeps.match_rows(docs, ["document_id"], "full", {"0": t.APN, "1": t.BROAD_APN, "street": t.ADDRESS, "label": t.LABELED_ADDRESS})
    found = materialize(found.unionByName(_page_marks(pages).withColumns({"start": F.col("start").cast("int"), "end": F.col("end").cast("int")})))
    numbers = found.where("kind IN ('0', '1')").groupBy("document_id", "start", F.col("end").alias("apn_end"), "text").agg(F.min("kind").cast("int").alias("kw_ord"))
    x = sweeps.sweep(numbers, found, ["document_id"], "start", ["page", "out", "street", "label"]).join(docs, "document_id")
    low, high = F.col("page_at.start"), F.coalesce("page_next.start", F.length("full"))
    out = F.coalesce(F.col("out_at.start") == low, F.lit(False))
    x = x.withColumns({"address": sweeps.find_address(F.col("start"), low, high), "keyword": F.lit(t.SWEEP_KEYWORD), "signal_strength": F.when(out, "EXCLUDED").otherwise("MED")})
    return _numbered(x, F.lit(""), "kw_ord")


def locate_pages(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (document_id, needle and more) with the ``page_number`` where its needle first stands in the joined text.

    Without a needle, or where it isn't in the text, that is the document's first page.
    """
    at = asked.join(_joined(pages), "document_id", "left")
    place = F.when(F.length("needle") > 0, F.instr("full", F.col("needle")))
    found = F.when(place > 0, _page_at(F.col("starts"), place - 1)).otherwise(F.coalesce(F.get("starts", 0)["page_number"], F.lit(1)))
    return at.withColumn("page_number", found).drop("full", "starts")


def chunk_pages(pages: DataFrame, first: int, size: int) -> DataFrame:
    """(document_id, chunk, label, n_pages, body): pages from index ``first`` on, ``size`` at a time, as one text."""
    i = F.row_number().over(_by_page()) - 1
    c = pages.withColumn("i", i).where(F.col("i") >= first).withColumn("chunk", F.floor((F.col("i") - first) / size))
    rows = c.groupBy("document_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("page_number", "page_text"))).alias("p"))
    label = F.concat(F.lit("=== Pages "), F.col("p")[0]["page_number"].cast("string"), F.lit("-"), F.element_at("p", -1)["page_number"].cast("string"), F.lit(" of the document ==="))
    return rows.select("document_id", "chunk", label.alias("label"), F.size("p").cast("long").alias("n_pages"), F.array_join(F.transform("p", lambda x: x["page_text"]), "\n").alias("body"))
