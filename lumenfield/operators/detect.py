"""Connected pixels, source detection, trails and shape maps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.functions import photometry as P
from lumenfield.operators.pixels import FRAME
from lumenfield.operators.quantile import exact_quantiles, median_mad
from lumenfield.operators.selection import rank_within
from lumenfield.operators.skew import spread
from lumenfield.session import reliable_checkpoint

TILE = 256
STRIDE = 1 << 31
MAX_ROUNDS = 64


def _tile_roots(x: np.ndarray, y: np.ndarray, part: np.ndarray, tile: int) -> np.ndarray:
    """Smallest pixel code of the 8-connected group of each pixel; ``part`` numbers the tiles, which do not touch."""
    wide = tile + 2
    code = (part * wide + y % tile + 1) * wide + x % tile + 1
    order = np.argsort(code)
    code = code[order]
    pairs = []
    for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1)):
        pos = np.searchsorted(code, code + dy * wide + dx)
        hit = pos < len(code)
        hit[hit] = code[pos[hit]] == (code + dy * wide + dx)[hit]
        pairs.append(np.stack([np.flatnonzero(hit), pos[hit]]))
    i, j = np.concatenate(pairs, axis=1)
    root = np.arange(len(code))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    out = np.empty(len(code), dtype=np.int64)
    out[order] = (y.astype(np.int64) * STRIDE + x)[order][root]
    return out


#: rows of whole tiles that are labelled at once
ROWS = 50_000


def label(flagged: DataFrame, tile: int = TILE) -> DataFrame:
    """Add ``label``: one value per 8-connected group of flagged pixels within a frame.

    Pixels are grouped inside tiles of bounded size, many small tiles at a time; groups that touch across tile borders
    are then joined by minimum-label rounds over the border pairs alone.
    """
    d = flagged.withColumns(
        {"_tx": F.floor(F.col("x") / tile), "_ty": F.floor(F.col("y") / tile)}
    )
    names = ", ".join(f"{n} {t}" for n, t in d.dtypes if n not in ("_tx", "_ty"))
    slots = [*FRAME, "_tx", "_ty"]

    def part(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        for n in slots:
            none, v = rows.column(n).is_null().to_numpy(), rows.column(n).fill_null(0).to_numpy()
            new[1:] |= (v[1:] != v[:-1]) | (none[1:] != none[:-1])
        return np.cumsum(new)

    def roots(rows: pa.Table):
        found = _tile_roots(rows.column("x").to_numpy(), rows.column("y").to_numpy(), part(rows), tile)
        yield from rows.drop_columns(["_tx", "_ty"]).append_column("label", pa.array(found)).to_batches()

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held, n = [*held, pa.Table.from_batches([batch])], n + batch.num_rows
            if n < ROWS:
                continue
            rows = pa.concat_tables(held)
            at = part(rows)
            last = int(np.searchsorted(at, at[-1]))  # the last tile may go on
            if last:
                yield from roots(rows.slice(0, last))
            held, n = [rows.slice(last)], n - last
        if n:
            yield from roots(pa.concat_tables(held))

    local = spread(d, *slots).sortWithinPartitions(*slots).mapInArrow(run, f"{names}, label bigint")
    return _merge_tiles(reliable_checkpoint(local), tile)


def _merge_tiles(local: DataFrame, tile: int) -> DataFrame:
    edge = (F.col("x") % tile).isin(0, tile - 1) | (F.col("y") % tile).isin(0, tile - 1)
    rim = local.where(edge).select(*FRAME, "x", "y", "label")
    around = F.array(
        *[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in ((1, 0), (-1, 1), (0, 1), (1, 1))]
    )
    sent = rim.select(*FRAME, F.col("label").alias("a"), F.explode(around).alias("n"))
    sent = sent.select(*FRAME, "a", F.col("n.x").alias("x"), F.col("n.y").alias("y"))
    links = sent.join(rim, [*FRAME, "x", "y"]).where("a <> label").select(*FRAME, "a", F.col("label").alias("b")).distinct()
    links = reliable_checkpoint(links)
    if links.isEmpty():
        return local
    both = links.unionByName(links.select(*FRAME, F.col("a").alias("b"), F.col("b").alias("a")))
    roots = both.groupBy(*FRAME, "a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    for _ in range(MAX_ROUNDS):
        step = both.join(roots.withColumnRenamed("a", "b"), [*FRAME, "b"]).groupBy(*FRAME, "a").agg(F.min("root").alias("_m"))
        new = roots.join(step, [*FRAME, "a"]).withColumn("_new", F.least("root", "_m"))
        jump = roots.select(*FRAME, F.col("a").alias("_new"), F.col("root").alias("_far"))
        new = new.join(jump, [*FRAME, "_new"], "left")
        new = reliable_checkpoint(new.select(*FRAME, "a", F.col("root").alias("_old"), F.least("_new", F.coalesce("_far", "_new")).alias("root")))
        moved = not new.where("_old <> root").isEmpty()
        roots = new.drop("_old")
        if not moved:
            break
    else:
        raise RuntimeError("component labels did not settle")
    d = local.join(roots.withColumnRenamed("a", "label"), [*FRAME, "label"], "left")
    return d.withColumn("label", F.coalesce("root", "label")).drop("root")


def _axes(cxx: Column, cyy: Column, cxy: Column) -> tuple[Column, Column]:
    """Eigenvalues of a 2 x 2 covariance, large and small."""
    half = (cxx + cyy) / 2.0
    gap = F.sqrt(F.pow((cxx - cyy) / 2.0, F.lit(2.0)) + cxy * cxy)
    return half + gap, F.greatest(half - gap, F.lit(0.0))


def detect_sources(pixels: DataFrame, threshold: float = 5.0, min_area: int = 5, tile: int = TILE) -> DataFrame:
    """Sources above the frame background with flux, peak and weighted second moments."""
    good = pixels.where(P.good_pixel())
    stats = median_mad(good, FRAME, "value").select(
        *FRAME, F.col("med").alias("background"), (P.MAD_TO_SIGMA * F.col("mad")).alias("background_rms")
    )
    d = good.join(stats, FRAME).withColumn("v", F.col("value") - F.col("background"))
    d = d.where(F.col("v") > threshold * F.col("background_rms"))
    d = label(d.select(*FRAME, "x", "y", "v", "background_rms"), tile)
    x, y, v = F.col("x").cast("double"), F.col("y").cast("double"), F.col("v")
    g = d.groupBy(*FRAME, "label").agg(
        F.count("*").alias("npix"), F.sum(v).alias("flux"), F.max(v).alias("peak"),
        F.sum(v * x).alias("sx"), F.sum(v * y).alias("sy"), F.sum(v * x * x).alias("sxx"),
        F.sum(v * y * y).alias("syy"), F.sum(v * x * y).alias("sxy"),
        F.first("background_rms").alias("background_rms"),
    ).where(F.col("npix") >= min_area)
    cx, cy = F.col("sx") / F.col("flux"), F.col("sy") / F.col("flux")
    g = g.withColumns({"cx": cx, "cy": cy})
    g = g.withColumns(
        {
            "cxx": F.col("sxx") / F.col("flux") - F.col("cx") * F.col("cx"),
            "cyy": F.col("syy") / F.col("flux") - F.col("cy") * F.col("cy"),
            "cxy": F.col("sxy") / F.col("flux") - F.col("cx") * F.col("cy"),
        }
    )
    big, small = _axes(F.col("cxx"), F.col("cyy"), F.col("cxy"))
    return g.select(
        *FRAME, "label", F.col("cx").alias("x"), F.col("cy").alias("y"), "flux", "peak", "npix",
        F.sqrt(big).alias("a"), F.sqrt(small).alias("b"),
        (F.atan2(2.0 * F.col("cxy"), F.col("cxx") - F.col("cyy")) / 2.0).alias("theta"), "background_rms",
    )


def trail_pixels(
    outliers: DataFrame, min_length: float = 12.0, min_elongation: float = 4.0, min_pixels: int = 10,
    dilation: int = 2, tile: int = TILE,
) -> DataFrame:
    """Pixels of long thin groups of positive outliers, grown by ``dilation`` 4-neighbour steps."""
    d = label(outliers.select(*FRAME, "x", "y"), tile)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    n = F.col("npix")
    g = d.groupBy(*FRAME, "label").agg(
        F.count("*").alias("npix"), F.var_samp(x).alias("cxx"), F.var_samp(y).alias("cyy"),
        F.covar_samp(x, y).alias("cxy"),
    )
    big, small = _axes(F.col("cxx"), F.col("cyy"), F.col("cxy"))
    big, small = F.greatest(big, F.lit(1e-9)), F.greatest(small, F.lit(1e-9))
    g = g.where(
        (n >= min_pixels) & (F.sqrt(big / small) >= min_elongation) & (4.0 * F.sqrt(big) >= min_length)
    ).select(*FRAME, "label")
    hit = d.join(g, [*FRAME, "label"], "left_semi")
    reach = [
        (i, j) for i in range(-dilation, dilation + 1) for j in range(-dilation, dilation + 1) if abs(i) + abs(j) <= dilation
    ]
    grown = F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in reach])
    return hit.select(*FRAME, F.explode(grown).alias("p")).select(*FRAME, "p.x", "p.y").distinct()


def brightest(sources: DataFrame, n: int, ident: str = "source_id") -> DataFrame:
    return rank_within(sources, FRAME, [F.desc("flux"), F.asc(ident)], n, ident)


def with_shape(sources: DataFrame) -> DataFrame:
    return sources.withColumns(
        {
            "fwhm": P.source_fwhm(F.col("a"), F.col("b")),
            "eccentricity": P.source_eccentricity(F.col("a"), F.col("b")),
        }
    )


def _quantile(d: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """A median per group, written out: a task that ran the sorts of many medians at once would hold them all."""
    return reliable_checkpoint(exact_quantiles(d, keys, value, {name: 0.5}))


def _median_angle(d: DataFrame, keys: list[str]) -> DataFrame:
    """Orientation is defined modulo pi, so medians are taken on the doubled angle."""
    d = d.withColumns({"_s2": F.sin(2.0 * F.col("theta")), "_c2": F.cos(2.0 * F.col("theta"))})
    s = _quantile(d, keys, "_s2", "_ms").join(_quantile(d, keys, "_c2", "_mc"), keys)
    return s.select(*keys, (F.atan2("_ms", "_mc") / 2.0).alias("theta"))


def field_maps(sources: DataFrame, frames: DataFrame, grid: int = 3, min_per_cell: int = 3) -> DataFrame:
    """Median width, eccentricity and orientation per grid cell with enough sources."""
    d = with_shape(sources).join(frames.select(*FRAME, "width", "height"), FRAME)
    cell = lambda v, size: F.least(F.lit(grid - 1), F.floor(F.col(v) / F.col(size) * grid)).cast("int")
    d = d.withColumns({"cell_x": cell("x", "width"), "cell_y": cell("y", "height")})
    keys = [*FRAME, "cell_x", "cell_y"]
    n = d.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= min_per_cell)
    d = d.join(n, keys)
    out = n.join(_quantile(d, keys, "fwhm", "fwhm"), keys)
    out = out.join(_quantile(d, keys, "eccentricity", "eccentricity"), keys)
    return out.join(_median_angle(d, keys), keys)


def characterise(sources: DataFrame, frames: DataFrame, grid: int = 3) -> DataFrame:
    """Star count, median shape and whether the point-spread function varies over the field."""
    d = with_shape(sources).join(frames.select(*FRAME, "width", "height"), FRAME)
    ok = (F.col("fwhm") > 0.5) & (F.col("fwhm") < 0.25 * F.least("width", "height"))
    d = d.withColumn("_ok", ok)
    n = d.groupBy(*FRAME).agg(F.count("*").alias("star_count"))
    good = d.where("_ok")
    fw = _quantile(good, FRAME, "fwhm", "fwhm").join(_quantile(good, FRAME, "eccentricity", "eccentricity"), FRAME)
    any_fw = _quantile(d, FRAME, "fwhm", "_all")
    vary = is_field_varying(field_maps(sources, frames, grid))
    d = n.join(any_fw, FRAME, "left").join(fw, FRAME, "left").join(_median_angle(good, FRAME), FRAME, "left").join(vary, FRAME, "left")
    return d.select(
        *FRAME, "star_count", F.coalesce("fwhm", "_all").alias("fwhm"),
        F.coalesce("eccentricity", F.lit(0.0)).alias("eccentricity"), F.coalesce("theta", F.lit(0.0)).alias("theta"),
        F.coalesce("is_field_varying", F.lit(False)).alias("is_field_varying"),
    )


def is_field_varying(maps: DataFrame, min_cells: int = 4, ratio: float = 0.15) -> DataFrame:
    g = maps.groupBy(*FRAME).agg(
        F.count("fwhm").alias("_n"), F.stddev_pop("fwhm").alias("_s"), F.avg("fwhm").alias("_m")
    )
    wide = F.col("_s") / F.greatest("_m", F.lit(1e-9)) > ratio
    return g.select(*FRAME, ((F.col("_n") >= min_cells) & wide).alias("is_field_varying"))


def mixed_psf_sources(frames: DataFrame, column: str = "psf_source") -> DataFrame:
    """Stacks whose frames got their kernels from different kinds of models."""
    return frames.groupBy("stack_id").agg((F.count_distinct(column) > 1).alias("is_mixed"))


def local_maxima(image: DataFrame, keys: list[str], value: str, radius: int = 2) -> DataFrame:
    """Mark pixels equal to the maximum of their (2r+1)-square, found along rows, then columns.

    Frame gaps are respected: windows run over coordinates, not over row positions.
    """
    wx = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-radius, radius)
    wy = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-radius, radius)
    d = image.withColumn("_mx", F.max(value).over(wx)).withColumn("_my", F.max("_mx").over(wy))
    return d.withColumn("is_peak", F.col(value) == F.col("_my")).drop("_mx", "_my")
