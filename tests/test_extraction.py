"""Hand vectors for the text functions and page signals."""

import random
import re

import pytest
from pyspark.sql import functions as F

from plinth.functions import text as t
from plinth.operators import extraction, serving, signals, store, tiers


@pytest.mark.parametrize("pattern", [r"a+", r"b[a-z]", r"(?i)Item \d"])
def test_matches_equal_finditer(spark, pattern):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "b", "Item 3", "é", "😀", " ", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", t.matches(F.col("x"), pattern).alias("m")).collect()
    for r in got:
        assert [(m.start, m.end, m.text) for m in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, texts[r.i])]


def test_vectors(spark):
    x = spark.createDataFrame([(" 042-311-090 ",), ("042-3110-090",), ("650-555-1234",), ("ADDR: 320 Sheridan Dr.",), (None,)], "x string").select(t.valid_apn(F.col("x"))).collect()
    assert [r[0] for r in x] == ["042-311-090", "042-3110-090", None, None, None]
    x = spark.createDataFrame([("2026-07-14",), ("2026-7-4",), ("2026-02-30",), ("next Tuesday",)], "x string").select(t.valid_date(F.col("x"))).collect()
    assert [r[0] for r in x] == ["2026-07-14", None, None, None]
    x = spark.createDataFrame([("R-1 to R-3",), ("R1 to R3",), ("Low-Density to High-Density",), ("Low-Density Residential (R-1) to High-Density Mixed-Use (R-3)",)], "x string").select(F.regexp_extract("x", t.ZONING, 1), F.regexp_extract("x", t.ZONING, 2)).collect()
    assert [tuple(r) for r in x] == [("R-1", "R-3"), ("R1", "R3"), ("Low-Density", "High-Density"), ("Low-Density Residential (R-1)", "High-Density Mixed-Use (R-3)")]
    x = spark.createDataFrame([("at 1017 Middlefield Rd",), ("500 El Camino Real",), ("042-311-090 Oak St",)], "x string").select(F.regexp_extract("x", t.ADDRESS, 1)).collect()
    assert [r[0] for r in x] == ["1017 Middlefield Rd", "500 El Camino Real", ""]
    x = spark.createDataFrame([("Sites Temporarily Excluded", "", "EXCLUDED"), ("Map", "under SB-79", "MED"), ("", "", "MED")], "a string, b string, c string").select(t.infer_policy_zoning(F.col("a"), F.col("b"), F.col("c")).alias("z")).select("z.*").collect()
    assert [tuple(r) for r in x] == [("Current Zoning", "Excluded/Unchanged"), ("Baseline Zoning", "SB 79 TOD"), ("Baseline Zoning", "Policy Rezoning")]


def test_page_signals(spark):
    pages = [
        (1, 1, "CALL TO ORDER\nrezone 042-311-001\nPUBLIC HEARINGS\nItem 4: Variance, APN 042-311-090 at 12 Oak St. The request was denied.\nItem 5: Planned Community Permit for 333 Main St\nwords"),
        (1, 2, "Item 6: rezone of 042-311-091 from R-1 to R-3"),
        (1, 3, "ADJOURNMENT\nrezone 042-311-092"),
        (2, 1, "a public hearing in prose on a variance"),
    ]
    got = extraction.page_signals(spark.createDataFrame(pages, "document_id long, page_number int, page_text string")).orderBy("document_id", "page_number", "pos").collect()
    assert [(r.document_id, r.page_number, r.keyword, r.apn, r.signal_strength, r.address, r.proposed_zoning) for r in got] == [
        (1, 1, "variance", "042-311-090", "EXCLUDED", "12 Oak St", None),
        (1, 1, "planned community permit", "ADDR: 333 Main St", "HIGH", "333 Main St", None),
        (1, 2, "rezone", "042-311-091", "HIGH", None, "R-3"),
        (2, 1, "variance", None, "LOW", None, None),
    ]


def test_dedupe_equals_the_fold(spark):
    rng = random.Random(2)
    rows = [(d, s, rng.choice(["a", "b", None]), rng.randint(1, 4), rng.choice([None, "x", "y", "z"])) for d in range(60) for s in range(rng.randint(1, 8))]
    got = {(r.document_id, r.apn, r.seq): r.zone for r in signals.dedupe_by_apn(spark.createDataFrame(rows, "document_id long, seq long, apn string, strength_rank int, zone string"), ["zone"]).collect()}
    want = {}
    for d in {r[0] for r in rows}:
        best = {}
        for _, s, a, k, z in [r for r in rows if r[0] == d]:
            if a is None:
                want[(d, None, s)] = z
            elif a not in best:
                best[a] = [s, k, z]
            else:
                held = best[a]
                best[a] = [s, k, z if z is not None else held[2]] if k > held[1] else [held[0], held[1], held[2] if held[2] is not None else z]
        want.update({(d, a, s): z for a, (s, _, z) in best.items()})
    assert got == want


def test_store_and_csv(spark):
    rows = spark.createDataFrame([(1, "k", 1, None), (1, "k", 2, "new")], "id int, key string, seq int, v string")
    assert store.upsert_last(rows, "key", "seq").first().v == "new"
    old = rows.where("seq = 1")
    assert store.insert_absent(old, rows, "key", "seq").count() == 1
    x = spark.createDataFrame([("a,b",), ('say "x"',), ("plain",), (None,)], "x string").select(serving.csv_field(F.col("x"))).collect()
    assert [r[0] for r in x] == ['"a,b"', '"say ""x"""', "plain", ""]
    siblings = spark.createDataFrame([(1, "p", "d", 1), (2, "p", "d", 2), (3, "p", None, 1), (4, "p", None, 2)], "id int, p string, d string, at int")
    assert {r.id for r in store.drop_older_siblings(siblings, ["p", "d"], "at").collect()} == {2, 3, 4}


def test_tiers(spark):
    pages = [
        (1, 1, "Item 1: Rezone 042-311-001 citywide"),  # policy, with an APN: its page signals stay
        (2, 1, "Item 1: Rezone citywide"),
        (2, 2, "Exhibit B sites removed\n042-311-002\n042-311-003"),  # none on pages: the exhibit's
        (3, 1, "Municipal code study. Call 650-555-1234"),  # neither: the sweep takes a telephone number
        (4, 1, "Item 1: Variance"),  # a single site keeps what has no APN
        (5, 1, "Item 1: Rezone citywide"),  # nothing anywhere: nothing stays
    ]
    got = tiers.regex_tier(spark.createDataFrame(pages, "document_id long, page_number int, page_text string")).orderBy("document_id", "apn").collect()
    assert [(r.document_id, r.apn, r.strength_rank, r.tier, r.classification[:6]) for r in got] == [
        (1, "042-311-001", 3, "pages", "POLICY"),
        (2, "042-311-002", 4, "exhibits", "POLICY"),
        (2, "042-311-003", 4, "exhibits", "POLICY"),
        (3, "650-555-1234", 2, "sweep", "POLICY"),
        (4, None, 1, "pages", "SINGLE"),
    ]
    exhibit, sweep = (next(r for r in got if r.document_id == d) for d in (2, 3))
    assert (exhibit.keyword, exhibit.current_zoning, exhibit.proposed_zoning, exhibit.page_number) == ("Exhibit B listing", "Current Zoning", "Excluded/Unchanged", 2)
    assert (sweep.keyword, sweep.current_zoning, sweep.proposed_zoning, sweep.snippet) == ("global APN sweep", "Baseline Zoning", "Policy Rezoning", "Municipal code study. Call 650-555-1234")


def test_exhibit_headers_end_at_the_next_one(spark):
    """What decides is up to 120 characters past a header's end, and never the next exhibit's."""
    far = "x" * 113
    pages = [(1, 1, "Exhibit A sites\n042-311-001 at 5 Oak St\nExhibit B denied\n042-311-002"), (2, 1, f"Exhibit A {far} denied 042-311-003"), (3, 1, f"Exhibit A {far[:-6]} denied 042-311-004 under SB 79"), (4, 1, f"Exhibit A\n\n{'Long title ' * 10}\n042-311-005 SB-79")]
    got = extraction.exhibit_apns(spark.createDataFrame(pages, "document_id long, page_number int, page_text string")).orderBy("apn").collect()
    assert [(r.apn[-1], r.keyword, r.signal_strength, r.current_zoning, r.proposed_zoning[:10], r.address) for r in got] == [
        ("1", "Exhibit A listing", "MED", "Baseline Zoning", "sites", "5 Oak St"),
        ("2", "Exhibit B listing", "EXCLUDED", "Current Zoning", "Excluded/U", None),
        ("3", "Exhibit A listing", "MED", "Baseline Zoning", "xxxxxxxxxx", None),
        ("4", "Exhibit A listing", "EXCLUDED", "Current Zoning", "Excluded/U", None),
        ("5", "Exhibit A listing", "MED", "Baseline Zoning", "SB 79 TOD", None),
    ]


def test_exports_and_summaries(spark):
    parcel = "parcels array<struct<apn:string,address:string,city:string,county:string,current_zoning:string,proposed_zoning:string,max_units:int,owner_name:string,owner_address:string>>"
    rows = [
        ("a", "2026-07-14", "X", "SITE_SPECIFIC", "Rezone, big", "HIGH", "rezone", None, 3, [("1", "5 Oak", "X", "Y", "R-1", None, 8, 'A "B"', None), ("2", "6 Oak", "X", "Y", None, "R-3", None, None, "z")]),
        ("b", None, "X", "POLICY_AMENDMENT", None, "MED", "citywide", ["North", "South"], None, []),
    ]
    d = spark.createDataFrame(rows, f"lead_id string, meeting_date string, jurisdiction string, lead_type string, entitlement_type string, signal_strength string, keyword string, affected_districts array<string>, page_number int, {parcel}").withColumn("created_at", F.lit("2026-07-27 14:32:07").cast("timestamp"))
    assert [r.line for r in serving.lead_csv(d).orderBy("lead_id").collect()] == ["Meeting Date,Jurisdiction,Lead Type,Site Address,APN,Entitlement Type,Current Zoning,Proposed Zoning,Max Unit Yield,Signal Score", '2026-07-14,X,SITE_SPECIFIC,5 Oak; 6 Oak,1; 2,"Rezone, big",R-1; ,; R-3,8,HIGH', ",X,POLICY_AMENDMENT,,,,,,,MED"]
    assert [r.line for r in serving.owner_csv(d).orderBy("row").collect()] == ['"APN","Address","Owner Name","Owner Address"', '"1","5 Oak","A "B"",""', '"2","6 Oak","","z"']
    text = serving.summary(F.col("lead_type"), F.col("keyword"), F.col("affected_districts"), F.transform("parcels", lambda p: p["apn"]))
    assert [r[0] for r in d.orderBy("lead_id").select(text).collect()] == ["Matched 'rezone' spanning 2 parcels (1, 2)", "Policy amendment affecting North, South"]
    shown = [r.asDict() for r in serving.display(d).orderBy("lead_id").collect()]
    assert shown[0] == {"lead_id": "a", "date": "2026-07-14", "title": "5 Oak", "subtitle": "1", "place": "X, Y County", "more": "+1 more", "others": "6 Oak", "entitlement": "Rezone, big", "units": "+8", "page": "View Agenda PDF (Page 3)", "stamp": "07/27 14:32:07"}
    assert [shown[1][k] for k in ("date", "title", "subtitle", "place", "units", "page")] == ["—", "Policy Amendment", "North, South", "North, South", "—", "View Agenda PDF"]


def test_streams_go_on_after_a_restart(spark, tmp_path):
    from plinth.streaming import jobs

    source, folder, schema = str(tmp_path / "in"), str(tmp_path / "state"), "job_id long, seq long, status string"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: {r.job_id: (r.status, r.n_events) for r in jobs.fold_jobs(spark.readStream.schema(schema).parquet(source), folder).collect()}
    add([(1, 1, "processing"), (2, 1, "cancelled"), (2, 2, "processing")])
    assert run() == {1: ("processing", 1), 2: ("cancelled", 2)}
    add([(1, 2, "completed"), (2, 3, "failed"), (3, 1, "processing")])
    assert run() == run() == {1: ("completed", 2), 2: ("failed", 3), 3: ("processing", 1)}
    docs, known = str(tmp_path / "docs"), spark.createDataFrame([("u0",)], "file_url string")
    found = lambda: sorted((r.file_url, r.n) for r in jobs.stream_unseen(spark.readStream.schema("file_url string, n int").parquet(docs), known, str(tmp_path / "seen")).collect())
    spark.createDataFrame([("u0", 1), ("u1", 2), ("u1", 1)], "file_url string, n int").write.parquet(docs)
    assert found() == [("u1", 1)]
    spark.createDataFrame([("u1", 3), ("u2", 4)], "file_url string, n int").write.mode("append").parquet(docs)
    assert found() == found() == [("u1", 1), ("u2", 4)]
