"""Search, privacy, licences, validation and sources on small hand-made tables."""

from __future__ import annotations

import itertools
import json
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lumenfield.functions import geo, sky
from lumenfield.functions.licences import LICENCES
from lumenfield.functions.privacy import with_published_location
from lumenfield.operators import crossmatch, jobs, records, search
from lumenfield.operators.search import Near, PhotoSearch
from lumenfield.sources import files, manifest, tables


@pytest.mark.parametrize(
    "bad",
    [
        dict(ra=1.0), dict(ra=1.0, dec=2.0), dict(min_focal=100.0, max_focal=50.0),
        dict(date_from=date(2024, 2, 1), date_to=date(2024, 1, 1)), dict(sort="nearest"), dict(sort="odd"),
    ],
)
def test_incoherent_search_is_refused(bad):
    with pytest.raises(ValueError):
        PhotoSearch(**bad).validate()


def test_cursor_round_trip_and_rejection():
    assert search.decode_cursor(search.encode_cursor(0.5, 12)) == (0.5, 12)
    with pytest.raises(ValueError):
        search.decode_cursor("not a cursor")


@pytest.mark.parametrize("sort", ["quality", "recent", "nearest"])
def test_pages_cover_every_row_once(cat, sort):
    q = PhotoSearch(sort=sort, near=Near(0.0, 0.0, 9000.0), limit=70)
    want = [r.photo_id for r in search.apply_filters(cat.photos, q).select("photo_id").collect()]
    seen, cursor = [], None
    for _ in range(40):
        page = PhotoSearch(sort=sort, near=q.near, limit=q.limit, cursor=cursor)
        items, cursor = search.page_items(search.search(cat.photos, page), page)
        seen += [r.photo_id for r in items]
        if cursor is None:
            break
    assert len(seen) == len(set(seen)) and sorted(seen) == sorted(want)


CONES = [(180, 0, 10), (0.01, 5, 2), (359.99, -5, 2), (10, 89.9, 1), (200, -89.5, 3), (40, 60, 45), (300, -20, 90)]


@pytest.mark.parametrize("ra,dec,r", CONES)
def test_cone_ranges_never_drop_a_match(spark, ra, dec, r):
    """Points at 0.1, 0.5, 0.95 and 1.5 radii in four directions around each cone."""
    import numpy as np

    pts = []
    for f, ang in itertools.product((0.1, 0.5, 0.95, 1.5), (0, 90, 180, 270)):
        d, a = np.radians(r * f), np.radians(ang)
        d0 = np.radians(dec)
        sd = np.sin(d0) * np.cos(d) + np.cos(d0) * np.sin(d) * np.cos(a)
        dra = np.arctan2(np.sin(a) * np.sin(d) * np.cos(d0), np.cos(d) - np.sin(d0) * sd)
        pts.append((float((ra + np.degrees(dra)) % 360), float(np.degrees(np.arcsin(sd))), bool(f < 1)))
    df = spark.createDataFrame(pts, "ra_deg double, dec_deg double, inside boolean")
    got = df.select("inside", search.in_cone(ra, dec, r).alias("hit")).collect()
    assert all(g.inside == g.hit for g in got)
    targets = spark.createDataFrame([(1, float(ra), float(dec), float(r))], "target_id int, t_ra double, t_dec double, radius_deg double")
    photos = df.withColumn("photo_id", F.monotonically_increasing_id())
    n = crossmatch.cone_match(targets, photos).count()
    assert n == sum(p[2] for p in pts)


def test_cone_reaches_the_parquet_scan(cat, folder):
    tables.write_photos(cat.photos, folder + "/photos")
    stored = tables.read_table(cat.spark, "photos", folder + "/photos")
    cat.spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = search.apply_filters(stored, PhotoSearch(ra=10.0, dec=20.0, radius=2.0)).select("photo_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(dec_deg,17." in text and "EqualTo(status,ready)" in text
    assert "quality_score" not in text


def test_geodesic_known_distances(spark):
    rows = [(0.0, 0.0, 0.0, 1.0, 111319.491), (0.0, 0.0, 1.0, 0.0, 110574.389), (40.0, -3.0, 40.0, -3.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, want double")
    for r in df.select("want", geo.geodesic_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m")).collect():
        assert abs(r.m - r.want) < 1.0


def test_moon_phase_reference_instants(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 4, 8, 18, 21), 0.0), (datetime(2024, 4, 23, 23, 49), 1.0)], "captured_at_utc timestamp, want double"
    )
    for r in sky.with_moon(df).select("want", "moon.illumination").collect():
        assert abs(r.illumination - r.want) < 0.02


def test_airmass_zenith_and_horizon(spark):
    df = spark.createDataFrame([(90.0,), (30.0,), (0.0,)], "h double")
    z, mid, hor = [r.x for r in df.select(sky.airmass(F.col("h")).alias("x")).collect()]
    assert abs(z - 1) < 1e-5 and abs(mid - 1.993) < 0.01 and hor == float("inf")


def _expected(codes):
    flags = {r[0]: r for r in LICENCES}
    if any(not flags[c][2] for c in codes):
        return None
    nc, sa = any(not flags[c][1] for c in codes), any(flags[c][4] for c in codes)
    if nc or sa:
        return {(1, 1): "CC-BY-NC-SA-4.0", (1, 0): "CC-BY-NC-4.0", (0, 1): "CC-BY-SA-4.0"}[(int(nc), int(sa))]
    return max(codes, key=lambda c: flags[c][5])


def test_every_ordered_pair_and_triple_of_licences(spark):
    codes = [r[0] for r in LICENCES]
    groups = [*itertools.product(codes, repeat=2), *itertools.product(codes, repeat=3)]
    rows = [(j, p, c, True) for j, g in enumerate(groups) for p, c in enumerate(g)]
    df = spark.createDataFrame(rows, "job_id int, photo_id int, license string, allow_derivatives_in_stacks boolean")
    got = {r.job_id: r.resulting_license for r in jobs.resolve_licence(df).collect()}
    assert got == {j: _expected(g) for j, g in enumerate(groups)}


def test_precision_never_leaks_position(spark):
    rows = [(p, 40.4168, -3.7038, "ES", 12.0, 667.0) for p in ("exact", "city", "country", "hidden")]
    rows.append(("country", 1.0, 1.0, "ZZ", 1.0, 1.0))
    df = spark.createDataFrame(rows, "location_precision string, lat_deg double, lon_deg double, country_code string, location_accuracy_m double, elevation_m double")
    exact, city, nation, hidden, unknown = [r.location for r in with_published_location(df).collect()]
    assert exact.lat == 40.4168 and (city.lat, city.lon, city.elevation_m) == (40.4, -3.7, 700.0)
    assert city.accuracy_m >= 5566 and nation.lat == 40.24 and nation.accuracy_m is None
    assert hidden is None and unknown is None


@pytest.mark.parametrize(
    "bad",
    [
        dict(pipeline="drizzle-v1"), dict(pipeline="drizzle-v1", photo_ids=[1]), dict(pipeline="drizzle-v1", photo_ids=[1, 1]),
        dict(pipeline="x", photo_ids=[1, 2]), dict(pipeline="drizzle-v1", has_selector=True),
        dict(pipeline="drizzle-v1", photo_ids=[1, 2], has_selector=True, object_id=3),
    ],
)
def test_bad_job_requests_are_refused(bad):
    with pytest.raises(ValueError):
        jobs.JobRequest(**bad).validate()
    jobs.JobRequest("drizzle-v1", photo_ids=[1, 2]).validate()


def test_folder_scan_and_uploads(spark, folder):
    for name in ("b.FITS", "a.cr2", "sub/c.tif", ".hidden.jpg", "note.txt"):
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as fh:
            fh.write(b"x")
    got = [(r.photo_key, r.format) for r in files.scan_folder(spark, folder).collect()]
    assert got == [("a", "raw"), ("b", "fits"), ("c", "tiff")]
    heads = [(b"", "staging/u/p"), (b"\xff\xd8\xff1234", "staging/u/p"), (b"\xff\xd8\xff", "other/p"), (b"zz", "staging/u/p"), (b"\x00" * 4 + b"ftypcrx 1234", "staging/u/p")]
    df = spark.createDataFrame(heads, "content binary, key string")
    out = [(r.reason, r.mime) for r in files.verify_uploads(df).collect()]
    assert out == [("empty", None), (None, "image/jpeg"), ("bad_key", None), ("unknown_format", None), (None, "image/x-canon-cr3")]


def test_manifest_forms(spark, folder):
    entries = [{"path": "x/f2.fits", "license": "CC-BY-4.0"}, {"file": "x/f1.fits", "license": "CC-BY-ND-4.0"}, {"s3_key_original": "k/f0.fits", "photo_id": "z", "allow_derivatives_in_stacks": False}]
    bare, wrapped = folder + "/bare.json", folder + "/wrapped.json"
    with open(bare, "w") as fh:
        json.dump(entries, fh)
    with open(wrapped, "w") as fh:
        json.dump({"inputs": entries, "output_license": "CC-BY-4.0"}, fh, indent=1)
    kept, rejected = manifest.split_manifest(manifest.read_manifest(spark, bare), strict=False)
    assert [r.photo_id for r in kept.collect()] == ["f2"]
    assert sorted(r.photo_id for r in rejected.collect()) == ["f1", "z"]
    m = manifest.read_manifest(spark, wrapped)
    assert {r.output_license for r in m.collect()} == {"CC-BY-4.0"}
    with pytest.raises(Exception, match="stack_opt_out|no_derivatives"):
        manifest.split_manifest(m)[0].collect()
    assert manifest.duplicate_ids(m.unionByName(m)).count() == 3


def test_result_sink(cat, folder):
    coadd = cat.pixels.groupBy("stack_id", "x", "y").agg(F.avg("value").alias("image"), F.count("*").cast("double").alias("weight"), F.lit(1.0).alias("sigma"))
    psf = cat.spark.createDataFrame([(0, 0, 0, 1.0)], "stack_id long, dx int, dy int, w double")
    cards = tables.header_cards(cat.frames.select("stack_id").distinct(), "stack_id", {"methodname": F.lit("σ-clip — ok"), "n": F.lit(7)})
    planes = tables.result_planes(coadd, psf)
    sums = tables.write_result(planes, cards, folder + "/result").collect()
    back = cat.spark.read.parquet(folder + "/result/planes")
    assert sorted(sums) == sorted(tables.plane_checksums(back).collect())
    assert {r.plane for r in sums} == {"SCI", "WEIGHT", "UNCERT", "PSF"}
    head = {r.card: r.value for r in cat.spark.read.parquet(folder + "/result/header").collect()}
    assert head == {"METHODNA": "sigma-clip -- ok", "N": "7"}


def test_provenance_is_appended(cat, folder):
    rows = jobs.plan_stacks(cat.jobs, cat.photos)
    n = rows.count()
    tables.append_inputs(rows, folder + "/inputs")
    tables.append_inputs(rows, folder + "/inputs")
    stored = tables.read_table(cat.spark, "inputs", folder + "/inputs")
    assert stored.count() == 2 * n
    share = stored.where("not was_rejected").groupBy("job_id").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r.w - 2) < 1e-9 for r in share)


def test_record_sinks(cat, folder):
    rows = records.attribution_rows(cat.job_inputs, cat.photos.select("photo_id", "attribution_name"))
    j = cat.jobs.withColumn("resulting_license", F.lit("CC-BY-4.0"))
    records.write_attribution(rows, j, folder + "/attribution")
    lines = cat.spark.read.text(folder + "/attribution")
    assert lines.where("value = '# Attribution'").count() == cat.jobs.count()
    records.write_snapshot(cat.photos, "all", folder + "/snap")
    kept = cat.photos.where("allow_ai_training").count()
    assert cat.spark.read.parquet(folder + "/snap/members").count() == kept
    a = records.snapshot(cat.photos, "all").collect()
    b = records.snapshot(cat.photos.repartition(7).orderBy(F.desc("photo_id")), "all").collect()
    assert a == b
    audit = records.audit_rows(cat.activity.withColumn("ip", F.lit("10.0.0.1")), "salt")
    records.append(audit, folder + "/audit")
    records.append(audit, folder + "/audit")
    stored = cat.spark.read.parquet(folder + "/audit")
    assert stored.count() == 2 * audit.count() and stored.where("ip_hash like '%10.0%'").count() == 0


def test_checksum_has_one_row_per_job_for_any_id(spark):
    rows = [(j, p, False, "CC0-1.0") for j in (1, 2) for p in (5, 3_000_000_000, 2_000_000_000_000_123, 9_223_372_036_854_775_807)]
    inputs = spark.createDataFrame(rows, "job_id long, photo_id long, was_rejected boolean, snapshot_license string")
    j = spark.createDataFrame([(1, "drizzle-v1", 3), (2, "drizzle-v1", 3)], "job_id long, pipeline string, object_id long")
    got = records.run_checksums(j, inputs).collect()
    assert sorted(r.job_id for r in got) == [1, 2]
    again = records.run_checksums(j, inputs.orderBy(F.desc("photo_id"))).collect()
    assert {r.job_id: r.run_checksum for r in got} == {r.job_id: r.run_checksum for r in again}


def test_listed_jobs_take_all_or_nothing(cat):
    ready = [r.photo_id for r in cat.photos.where("status = 'ready' and deleted_at is null").orderBy("photo_id").limit(3).collect()]
    failed = cat.photos.where("status = 'failed'").first().photo_id
    wanted = cat.spark.createDataFrame([(1, p) for p in ready] + [(2, ready[0]), (2, failed), (3, ready[1]), (3, -1)], "job_id long, photo_id long")
    got = jobs.explicit_candidates(wanted, cat.photos).select("job_id", "photo_id", "target_count").collect()
    assert sorted(map(tuple, got)) == [(1, p, 3) for p in ready]


def test_refused_jobs_write_no_provenance(cat):
    from lumenfield.operators import selection

    cand = selection.job_candidates(cat.jobs, cat.photos)
    status = {r.job_id: r.status for r in jobs.plan_status(cat.jobs, cand).collect()}
    planned = {r.job_id for r in jobs.plan_stacks(cat.jobs, cat.photos).select("job_id").distinct().collect()}
    assert planned == {j for j, s in status.items() if s == "planned"}
    assert {"planned", "licence_blocked"} <= set(status.values())
    assert jobs.preview(cand).count() == cand.count()


def test_top_rows_of_a_hot_group_are_exact(spark):
    from lumenfield.operators.selection import rank_within

    df = spark.range(20_000).selectExpr("1 as g", "id", "(id * 7919) % 20011 as v")
    got = [(r["rank"], r.id) for r in rank_within(df, ["g"], [F.desc("v"), F.asc("id")], 50, "id").orderBy("rank").collect()]
    want = sorted(range(20_000), key=lambda i: (-((i * 7919) % 20011), i))[:50]
    assert got == list(enumerate(want, 1))
