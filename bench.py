"""Headline queries on ``$BENCH_SF_DIR``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lumenfield.operators import search  # noqa: E402
from lumenfield.operators.search import PhotoSearch  # noqa: E402
from lumenfield.plans import load_all  # noqa: E402
from lumenfield.plans.registry import Catalogue  # noqa: E402
from lumenfield.session import local_session, work_folder  # noqa: E402

HEADLINES = (
    "coverage_histogram published_sites public_totals derived_metrics resolved_licences plan_stacks"
    " cone_crossmatch similar_photos rolling_job_count running_storage photo_validation frame_statistics"
    " sigma_clip coadd_mean coadd_sigma_clip drizzle optimal_coadd hdr_composite detected_sources"
    " background_subtracted injection_recovery"
).split()
CONE = PhotoSearch(ra=180.0, dec=10.0, radius=5.0)


def seconds(action, repeat: int = 1) -> float:
    """Best of ``repeat`` runs."""
    best = float("inf")
    for _ in range(repeat):
        t = time.perf_counter()
        action()
        best = min(best, time.perf_counter() - t)
    return round(best, 4)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    t = Catalogue(spark, folder)
    out: dict[str, float] = {}

    # a stored photo table, sorted by declination so that row groups prune a cone
    path = work_folder(spark, "photos")
    t.photos.repartitionByRange(8, "dec_deg").sortWithinPartitions("dec_deg").write.parquet(path)
    photos = spark.read.parquet(path)
    full = photos.where(search.visible()).where(
        search.sky.separation(search.F.col("ra_deg"), search.F.col("dec_deg"), search.F.lit(CONE.ra), search.F.lit(CONE.dec)) <= CONE.radius
    )
    full, pruned = full.select("photo_id"), search.apply_filters(photos, CONE).select("photo_id")
    out["cone_full_scan"] = seconds(lambda: full.collect(), 7)
    out["cone_pruned"] = seconds(lambda: pruned.collect(), 7)
    out["search_page"] = seconds(lambda: search.search(photos, PhotoSearch(usable_for="stacking")).collect(), 3)

    queries = load_all()
    t0 = time.perf_counter()
    n_frames = t.frames.count()
    t.pixels.count()
    out["derive_pixel_tables"] = round(time.perf_counter() - t0, 4)
    for name in HEADLINES:
        out[name] = seconds(lambda: run(queries[name](spark, folder)))
    out["coadd_sigma_clip_per_frame"] = round(out["coadd_sigma_clip"] / max(n_frames, 1), 5)
    out["drizzle_per_frame"] = round(out["drizzle"] / max(n_frames, 1), 5)
    total = round(sum(v for k, v in out.items() if not k.endswith("_per_frame")), 3)
    print(
        json.dumps(
            {"metric": "headline_total_seconds", "value": total, "unit": "sec", "queries": out, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
