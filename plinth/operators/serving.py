"""Serving queries: lead details with their parcels, facets, orders, figures and CSV lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of the exports, and what stands for missing values.
LEAD_COLUMNS = ["Meeting Date", "Jurisdiction", "Lead Type", "Site Address", "APN", "Entitlement Type", "Current Zoning", "Proposed Zoning", "Max Unit Yield", "Signal Score"]
OWNER_COLUMNS = ["APN", "Address", "Owner Name", "Owner Address"]
NOTHING, NO_PARCEL, ALL_DISTRICTS, PAGE_LABEL = "—", "Policy Amendment", "Citywide", "View Agenda PDF"
NO_LEADS = "Scan complete. No actionable development leads found in recent agendas."
PARCEL_FIELDS = ["apn", "parcel_id", "address", "city", "county", "current_zoning", "proposed_zoning", "max_units", "owner_name", "owner_address"]


def sourced(leads: DataFrame, documents: DataFrame) -> DataFrame:
    """Leads with their source's address and jurisdiction."""
    return leads.join(documents.select("document_id", F.col("file_url").alias("agenda_source_url"), F.col("city_name").alias("jurisdiction")), "document_id")


def leads_detail(leads: DataFrame, documents: DataFrame, lead_parcels: DataFrame, parcels: DataFrame) -> DataFrame:
    """Leads with their source's address and jurisdiction and an array of their parcels, by APN (empty without any)."""
    linked = lead_parcels.join(parcels, "parcel_id")
    nested = linked.groupBy("lead_id").agg(F.array_sort(F.collect_list(F.struct(*PARCEL_FIELDS))).alias("parcels"))
    empty = F.array().cast(nested.schema["parcels"].dataType)
    return sourced(leads, documents).join(nested, "lead_id", "left").withColumn("parcels", F.coalesce("parcels", empty))


def leads_facts(leads: DataFrame, documents: DataFrame, lead_parcels: DataFrame, parcels: DataFrame, keep: Column | None = None) -> DataFrame:
    """As ``leads_detail`` with ``n_parcels`` and the first parcel's ``units`` (0 if unknown) in place of the parcels.

    Both are partial aggregates, so figures and orders move no parcel's details. With ``keep`` (as from ``facets``) only
    the leads that it keeps, and only their links are aggregated.
    """
    own = sourced(leads, documents)
    if keep is not None:
        own = own.where(keep)
        lead_parcels = lead_parcels.join(own.select("lead_id"), "lead_id", "left_semi")
    linked = lead_parcels.join(parcels.select("parcel_id", "apn", "max_units"), "parcel_id")
    facts = linked.groupBy("lead_id").agg(F.count("*").alias("n_parcels"), F.min_by("max_units", F.struct("apn", "parcel_id")).alias("units"))
    return own.join(facts, "lead_id", "left").withColumns({"n_parcels": F.coalesce("n_parcels", F.lit(0)), "units": F.coalesce("units", F.lit(0))})


def facets(cities: list[str] = (), lead_types: list[str] = (), scores: list[str] = (), start: str | None = None, end: str | None = None) -> Column:
    """Facets joined by AND; an empty list is no filter; bounds are inclusive and undated leads pass them."""
    keep = F.lit(True)
    for name, values in (("jurisdiction", cities), ("lead_type", lead_types), ("signal_strength", scores)):
        if values:
            keep = keep & F.col(name).isin(*values)
    date = F.col("meeting_date")
    for bound, inside in ((start, lambda x: date >= x), (end, lambda x: date <= x)):
        if bound:
            keep = keep & (date.isNull() | inside(F.lit(bound).cast("date")))
    return keep


def apply_filters(detail: DataFrame, **chosen) -> DataFrame:
    """The leads that ``facets`` keep."""
    return detail.where(facets(**chosen))


def first_units(parcels: str = "parcels") -> Column:
    """Units of a lead's first parcel, 0 if unknown."""
    return F.coalesce(F.try_element_at(F.col(parcels), F.lit(1))["max_units"], F.lit(0))


def sort_keys(by: str, units: Column) -> list[Column]:
    """A total order: ``recent`` or ``yield``, then the serving order (newest first) and the id."""
    first = F.col("meeting_date").desc_nulls_last() if by == "recent" else units.desc()
    return [first, F.col("created_at").desc(), F.col("lead_id")]


def kpis(facts: DataFrame, sources: DataFrame, visible: Column) -> DataFrame:
    """One row: units in the pipeline, high-yield leads, leads in all and visible ones, and covered sources."""
    active = F.col("signal_strength") != "EXCLUDED"
    figures = facts.agg(
        F.coalesce(F.sum(F.when(active, F.col("units"))), F.lit(0)).cast("long").alias("regional_pipeline"),
        F.count_if(F.col("signal_strength").isin("HIGH", "MED")).alias("high_yield_signals"),
        F.count_if(active).alias("active_leads"),
        F.count_if(visible).alias("visible_leads"),
        F.count("*").alias("total_leads"),
    )
    return figures.crossJoin(sources.agg(F.count("*").alias("coverage_area")))  # one row each


def csv_field(x: Column) -> Column:
    """A CSV field: quoted only where it holds a comma, a quote or a line end."""
    x = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(x.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def _each(name: str, by: str) -> Column:
    return F.array_join(F.transform("parcels", lambda p: F.coalesce(p[name], F.lit(""))), by)


def _first(name: str) -> Column:
    return F.try_element_at(F.col("parcels"), F.lit(1))[name]


def lead_csv(detail: DataFrame) -> DataFrame:
    """(lead_id, line): the export's lines, its header under a null id; several parcels' values are joined with "; "."""
    fields = [F.col("meeting_date"), F.col("jurisdiction"), F.col("lead_type"), _each("address", "; "), _each("apn", "; "), F.col("entitlement_type"), _each("current_zoning", "; "), _each("proposed_zoning", "; "), _first("max_units"), F.col("signal_strength")]
    header = detail.sparkSession.range(1).select(F.lit(None).cast("string").alias("lead_id"), F.lit(",".join(LEAD_COLUMNS)).alias("line"))
    return header.unionByName(detail.select("lead_id", F.concat_ws(",", *[csv_field(f) for f in fields]).alias("line")))


def owner_csv(detail: DataFrame) -> DataFrame:
    """(lead_id, row, line): each lead's own file: a header, then a line per linked parcel; every cell quoted, none escaped.

    Leads without parcels have no file.
    """
    line = lambda cells: F.concat_ws(",", *[F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"')) for c in cells])
    lines = F.transform("parcels", lambda p: line([p["apn"], p["address"], p["owner_name"], p["owner_address"]]))
    rows = detail.where(F.size("parcels") > 0).select("lead_id", F.posexplode(F.concat(F.array(line([F.lit(c) for c in OWNER_COLUMNS])), lines)).alias("row", "line"))
    return rows.withColumn("row", F.col("row").cast("long"))


def districts() -> Column:
    """The districts that a policy touches."""
    return F.when(F.size("affected_districts") > 0, F.array_join("affected_districts", ", ")).otherwise(ALL_DISTRICTS)


def display(detail: DataFrame) -> DataFrame:
    """What a table row and the lead's own sheet show."""
    n, some = F.size("parcels"), F.size("parcels") > 0
    return detail.select(
        "lead_id",
        F.coalesce(F.col("meeting_date").cast("string"), F.lit(NOTHING)).alias("date"),
        F.when(some, _first("address")).otherwise(NO_PARCEL).alias("title"),
        F.when(some, _first("apn")).otherwise(districts()).alias("subtitle"),
        F.when(some, F.concat(_first("city"), F.lit(", "), _first("county"), F.lit(" County"))).otherwise(districts()).alias("place"),
        F.when(n > 1, F.concat(F.lit("+"), (n - 1).cast("string"), F.lit(" more"))).otherwise("").alias("more"),
        F.array_join(F.transform(F.slice("parcels", 2, F.greatest(n, F.lit(1))), lambda p: p["address"]), ", ").alias("others"),
        F.coalesce("entitlement_type", F.lit(NOTHING)).alias("entitlement"),
        F.coalesce(F.concat(F.lit("+"), _first("max_units").cast("string")), F.lit(NOTHING)).alias("units"),
        F.when(F.coalesce("page_number", F.lit(0)) != 0, F.concat(F.lit(f"{PAGE_LABEL} (Page "), F.col("page_number").cast("string"), F.lit(")"))).otherwise(PAGE_LABEL).alias("page"),
        F.date_format("created_at", "MM/dd HH:mm:ss").alias("stamp"),
    )


def summary(lead_type: Column, keyword: Column, touched: Column, apns: Column) -> Column:
    """A lead's one-line summary: what a policy touches, or where the keyword was matched."""
    policy = F.when(F.size(touched) > 0, F.concat(F.lit("Policy amendment affecting "), F.array_join(touched, ", "))).otherwise(F.concat(F.lit("Policy amendment: "), keyword))
    matched = F.concat(F.lit("Matched '"), keyword, F.lit("'"))
    one = F.concat(matched, F.lit(" near APN "), F.try_element_at(apns, F.lit(1)))
    many = F.concat(matched, F.lit(" spanning "), F.size(apns).cast("string"), F.lit(" parcels ("), F.array_join(apns, ", "), F.lit(")"))
    return F.when(lead_type == "POLICY_AMENDMENT", policy).when(F.size(apns) == 1, one).when(F.size(apns) > 1, many)


def source_name(jurisdiction: Column) -> Column:
    """A source's default name, after the body that meets there."""
    return F.concat(jurisdiction, F.when(F.endswith(jurisdiction, F.lit("County")), " Board of Supervisors").otherwise(" City Council"))


def fallback_parcels(signals: DataFrame, documents: DataFrame) -> DataFrame:
    """Parcel records straight from signals that have an APN, for serving without stored tables."""
    s = signals.where("apn IS NOT NULL").join(documents.select("document_id", "city_name"), "document_id")
    return s.select("document_id", "seq", "apn", unmatched_address().alias("address"), F.coalesce("city", "city_name").alias("city"), "current_zoning", "proposed_zoning", F.col("unit_count").alias("max_units"))


def unmatched_address() -> Column:
    """A signal's address, or the page that it comes from."""
    return F.when(F.length("address") > 0, F.col("address")).otherwise(F.concat(F.lit("Unmatched — parsed from page "), F.col("page_number").cast("string")))


def served(rows: DataFrame, kept_elsewhere: bool) -> DataFrame:
    """Stored rows, or none where nothing is stored (parcels then come from ``fallback_parcels``)."""
    return rows.where(F.lit(not kept_elsewhere))


def toggle(values: Column, value: Column) -> Column:
    """``values`` with ``value`` removed if it is there, else added at the end."""
    return F.when(F.array_contains(values, value), F.array_remove(values, value)).otherwise(F.array_append(values, value))


def zero_lead_messages(documents: DataFrame, leads: DataFrame) -> DataFrame:
    """(document_id, n_leads, message): each document's leads, and what is said where it has none."""
    n = F.coalesce("n", F.lit(0))
    counted = documents.select("document_id").join(leads.groupBy("document_id").agg(F.count("*").alias("n")), "document_id", "left")
    return counted.select("document_id", n.alias("n_leads"), F.when(n == 0, NO_LEADS).alias("message"))
