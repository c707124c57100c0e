"""Combinable photo search: visibility, object, cone, place, time, optics, licence, paging."""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.functions import geo, sky
from lumenfield.functions.licences import LICENCES

SORTS = ("quality", "recent", "nearest")
USES = (None, "commercial", "derivatives", "stacking")


@dataclass(frozen=True)
class Near:
    lat: float
    lon: float
    km: float = 50.0


@dataclass(frozen=True)
class PhotoSearch:
    """Arguments of one search; ``validate`` rejects incoherent combinations."""

    object_id: int | None = None
    object_alias: str | None = None
    owner_id: int | None = None
    ra: float | None = None
    dec: float | None = None
    radius: float | None = None
    near: Near | None = None
    date_from: date | None = None
    date_to: date | None = None
    min_focal: float | None = None
    max_focal: float | None = None
    filter_name: str | None = None
    min_quality: float | None = None
    tracked: bool | None = None
    plate_solved: bool = False
    licenses: tuple[str, ...] | None = None
    usable_for: str | None = None
    exclude_hidden_near: bool = False
    sort: str = "quality"
    limit: int = 24
    cursor: str | None = None

    def validate(self) -> PhotoSearch:
        broken = [text for text, holds in SEARCH_RULES if not holds(self)]
        if broken:
            raise ValueError("; ".join(broken))
        return self

    def allowed_licences(self) -> list[str] | None:
        """Codes to filter by, from the asked codes and the flag the use needs; None means no filter."""
        if self.usable_for is None:
            return sorted(set(self.licenses)) if self.licenses else None
        fitting = [row[0] for row in LICENCES if row[LICENCE_FLAG[self.usable_for]]]
        return sorted(code for code in fitting if not self.licenses or code in self.licenses)


def _in_order(low, high) -> bool:
    return not low or not high or low <= high


#: position in a licence row of the flag that a use needs
LICENCE_FLAG = {"commercial": 1, "derivatives": 2, "stacking": 2}
#: what must hold for the arguments of a search
SEARCH_RULES = (
    ("ra, dec and radius make a sky cone only together", lambda q: len({v is None for v in (q.ra, q.dec, q.radius)}) == 1),
    ("the focal range is empty", lambda q: _in_order(q.min_focal, q.max_focal)),
    ("the date range is empty", lambda q: _in_order(q.date_from, q.date_to)),
    ("unknown sort order", lambda q: q.sort in SORTS),
    ("unknown use", lambda q: q.usable_for in USES),
    ("nearest needs a place", lambda q: q.near is not None or q.sort != "nearest"),
)


def visible() -> Column:
    """Public visibility: ready and not deleted."""
    return F.col("deleted_at").isNull() & (F.col("status") == "ready")


def visible_to(photos: DataFrame, viewer_id: int | None) -> DataFrame:
    """Detail view: the owner also sees photos that are not ready yet."""
    own = F.lit(False) if viewer_id is None else F.col("owner_id") == viewer_id
    return photos.where(F.col("deleted_at").isNull() & ((F.col("status") == "ready") | own))


def by_id(photos: DataFrame, photo_id: int, include_deleted: bool = False) -> DataFrame:
    found = photos.where(F.col("photo_id") == photo_id)
    return found if include_deleted else found.where(F.col("deleted_at").isNull())


def in_cone(ra: float, dec: float, radius: float) -> Column:
    """Separation test with redundant declination and right-ascension ranges.

    The ranges are plain comparisons on stored columns, so they reach the Parquet scan and prune
    row groups; the separation test settles the remaining rows exactly.
    """
    slack = 1e-9 + radius * 1e-9
    near = F.col("dec_deg").between(dec - radius - slack, dec + radius + slack)
    if abs(dec) + radius < 89.9:
        half = math.degrees(
            math.asin(min(1.0, math.sin(math.radians(radius)) / math.cos(math.radians(dec))))
        )
        half += 1e-6
        lo, hi = ra - half, ra + half
        if half < 180:
            if lo < 0:
                near &= (F.col("ra_deg") <= hi) | (F.col("ra_deg") >= lo + 360)
            elif hi >= 360:
                near &= (F.col("ra_deg") >= lo) | (F.col("ra_deg") <= hi - 360)
            else:
                near &= F.col("ra_deg").between(lo, hi)
    exact = (
        sky.separation(F.col("ra_deg"), F.col("dec_deg"), F.lit(ra), F.lit(dec)) <= radius
    )
    return F.col("ra_deg").isNotNull() & F.col("dec_deg").isNotNull() & near & exact


def distance_to(near: Near) -> Column:
    return geo.geodesic_m(F.col("lat_deg"), F.col("lon_deg"), F.lit(near.lat), F.lit(near.lon))


def near_place(near: Near) -> Column:
    """Geodesic distance test behind a latitude band that Parquet can prune."""
    band = near.km / 110.0 + 1e-6
    return (
        F.col("lat_deg").isNotNull()
        & F.col("lat_deg").between(near.lat - band, near.lat + band)
        & (distance_to(near) <= near.km * 1000.0)
    )


def apply_filters(photos: DataFrame, q: PhotoSearch, objects: DataFrame | None = None) -> DataFrame:
    q.validate()
    c = F.col
    terms: list[Column] = [visible()]
    if q.object_id is not None:
        terms.append(c("object_id") == q.object_id)
    if q.owner_id is not None:
        terms.append(c("owner_id") == q.owner_id)
    if q.ra is not None:
        terms.append(in_cone(q.ra, q.dec, q.radius))
    if q.near is not None:
        terms.append(near_place(q.near))
        if q.exclude_hidden_near:
            terms.append(c("location_precision") != "hidden")
    if q.date_from is not None:
        terms.append(c("captured_at_utc") >= F.lit(str(q.date_from)).cast("timestamp"))
    if q.date_to is not None:
        end = str(q.date_to + timedelta(days=1))
        terms.append(c("captured_at_utc") < F.lit(end).cast("timestamp"))
    if q.min_focal is not None:
        terms.append(c("focal_length_mm") >= q.min_focal)
    if q.max_focal is not None:
        terms.append(c("focal_length_mm") <= q.max_focal)
    if q.filter_name:
        terms.append(c("filter_name") == q.filter_name)
    if q.min_quality is not None:
        terms.append(c("quality_score") >= q.min_quality)
    if q.tracked is not None:
        terms.append(c("is_tracked") == q.tracked)
    if q.plate_solved:
        terms.append(c("is_plate_solved"))
    allowed = q.allowed_licences()
    if allowed:
        terms.append(c("license").isin(allowed))
    if q.usable_for == "stacking":
        terms.append(c("allow_derivatives_in_stacks"))
    found = photos.where(reduce(lambda a, b: a & b, terms))
    if q.object_id is None and q.object_alias:
        if objects is None:
            raise ValueError("an object alias needs the objects table")
        found = found.join(matching_objects(objects, q.object_alias), "object_id", "left_semi")
    return found


def matching_objects(objects: DataFrame, alias: str) -> DataFrame:
    """Objects named by ``alias``: aliases match exactly, names ignore case."""
    a = alias.strip()
    return objects.where(
        F.array_contains("aliases", a)
        | (F.lower("common_name") == a.lower())
        | (F.lower("common_name_es") == a.lower())
        | (F.concat("catalog", "catalog_number") == a.replace(" ", ""))
    ).select("object_id")


# --- paging ------------------------------------------------------------------------------------


def encode_cursor(value, last_id) -> str:
    raw = json.dumps({"v": value, "id": str(last_id)}, separators=(",", ":"))
    return base64.b64encode(raw.encode()).decode()


def decode_cursor(cursor: str) -> tuple[object, int]:
    try:
        data = json.loads(base64.b64decode(cursor, validate=True))
        return data["v"], int(data["id"])
    except (ValueError, KeyError, TypeError) as exc:
        raise ValueError("unreadable cursor") from exc


def cursor_column(value: Column, last_id: Column) -> Column:
    """The cursor that continues after each row."""
    body = F.struct(value.alias("v"), last_id.cast("string").alias("id"))
    return F.base64(F.encode(F.to_json(body, {"ignoreNullFields": "false"}), "utf-8"))


def cursor_fields(cursor: Column) -> Column:
    """Struct (v, id) read back from a cursor column."""
    return F.from_json(F.decode(F.unbase64(cursor), "utf-8"), "v string, id string")


def after(key: Column, ident: Column, value, last_id, ascending: bool = False) -> Column:
    """Rows strictly after ``(value, last_id)`` in the page order, null keys last."""
    if value is None:
        return key.isNull() & ((ident > last_id) if ascending else (ident < last_id))
    v = F.lit(value)
    if ascending:
        return (key > v) | ((key == v) & (ident > last_id)) | key.isNull()
    return (key < v) | ((key == v) & (ident < last_id)) | key.isNull()


def search(photos: DataFrame, q: PhotoSearch, objects: DataFrame | None = None) -> DataFrame:
    """One page plus one row: the extra row tells that another page follows."""
    found = apply_filters(photos, q, objects)
    ascending = q.sort == "nearest"
    if ascending:
        found = found.withColumn("sort_key", distance_to(q.near))
    else:
        name = "captured_at_utc" if q.sort == "recent" else "quality_score"
        found = found.withColumn("sort_key", F.col(name))
    key, ident = F.col("sort_key"), F.col("photo_id")
    if q.cursor:
        value, last_id = decode_cursor(q.cursor)
        if q.sort == "recent" and value is not None:
            found = found.where(
                after(key, ident, value, last_id)
                if not isinstance(value, str)
                else (key < F.lit(value).cast("timestamp"))
                | ((key == F.lit(value).cast("timestamp")) & (ident < last_id))
                | key.isNull()
            )
        else:
            found = found.where(after(key, ident, value, last_id, ascending))
    order = (
        [key.asc_nulls_last(), ident.asc()] if ascending else [key.desc_nulls_last(), ident.desc()]
    )
    return found.orderBy(*order).limit(q.limit + 1)


def page_items(page: DataFrame, q: PhotoSearch) -> tuple[list, str | None]:
    """Collect one bounded page and the cursor of the next."""
    rows = page.collect()
    items = rows[: q.limit]
    if len(rows) <= q.limit or not items:
        return items, None
    last = items[-1]
    value = last["sort_key"]
    return items, encode_cursor(str(value) if q.sort == "recent" and value else value, last["photo_id"])


# --- lists -------------------------------------------------------------------------------------


def get_many(photos: DataFrame, wanted: DataFrame, order: Sequence[str] = ("position",)) -> DataFrame:
    """Live photos for lists of ids (one row per id), in the order the lists give."""
    live = photos.where(F.col("deleted_at").isNull())
    return wanted.select("photo_id", *order).join(live, "photo_id").orderBy(*order, "photo_id")


def stack_candidates(
    photos: DataFrame, limit: int, min_quality: float = 0.0, partition: str = "object_id"
) -> DataFrame:
    """Best ``limit`` solved photos per object; consent and licence are judged later."""
    from lumenfield.operators.selection import rank_within

    ok = (
        visible()
        & F.col("is_plate_solved")
        & F.col(partition).isNotNull()
        & (F.col("quality_score").isNull() | (F.col("quality_score") >= min_quality))
    )
    order = [F.desc_nulls_last("quality_score"), F.asc("photo_id")]
    return rank_within(photos.where(ok), [partition], order, limit, "photo_id")


def unavailable(wanted: DataFrame, photos: DataFrame) -> DataFrame:
    """Requested ids that do not exist or are not ready, with the reason."""
    state = photos.where(F.col("deleted_at").isNull()).select("photo_id", "status")
    joined = wanted.join(state, "photo_id", "left")
    reason = F.when(F.col("status").isNull(), "not_found").when(
        F.col("status") != "ready", "not_ready"
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull())


def public_projection(photos: DataFrame, viewer_id: int | None = None) -> DataFrame:
    """Public shape of a photo with nested blocks and the publishable location."""
    from lumenfield.functions.optics import diffraction_limit
    from lumenfield.functions.privacy import with_published_location

    own = F.lit(False) if viewer_id is None else F.col("owner_id") == viewer_id
    d = with_published_location(photos, owner_view=own)
    d = d.withColumn(
        "aperture_mm",
        F.try_divide(F.col("focal_length_mm"), F.col("focal_ratio")),
    )

    def block(names: Sequence[str], *more: Column) -> Column:
        return F.struct(*names, *more)

    return d.select(
        "photo_id", "owner_id", "status", "title", "object_id", "captured_at_utc", "location",
        block(
            ["focal_length_mm", "focal_ratio", "aperture_mm", "pixel_pitch_um",
             "exposure_seconds", "is_tracked", "filter_name"],
            diffraction_limit(F.col("aperture_mm")).alias("diffraction_limit_arcsec"),
        ).alias("optics"),
        block(["is_plate_solved", "ra_deg", "dec_deg", "pixel_scale_arcsec"]).alias("astrometry"),
        block(["fwhm_arcsec", "star_count", "eccentricity", "snr_estimate", "bortle_estimate",
               "quality_score"]).alias("quality"),
        block(["license", "attribution_name", "allow_ai_training", "allow_derivatives_in_stacks"])
        .alias("licence"),
    )
