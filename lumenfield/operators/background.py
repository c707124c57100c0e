"""Sky background of a frame as a mesh of robust cell levels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfield.functions import arrays
from lumenfield.functions import photometry as P
from lumenfield.operators.pixels import FRAME
from lumenfield.operators.quantile import exact_quantiles, median_mad

SMALLEST = 24
NEIGHBOURS = 10


def sizes(pixels: DataFrame) -> DataFrame:
    """Width and height of every frame, from its outermost pixels."""
    return pixels.groupBy(*FRAME).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def box_size(width: Column, height: Column, requested: int | None = None) -> Column:
    """Cell side for an image; small images get at least three cells per side."""
    longest, shortest = F.greatest(width, height), F.least(width, height)
    box = F.lit(max(8, requested)) if requested else F.least(F.lit(256), F.greatest(F.lit(16), F.floor(longest / 8)))
    return F.when(shortest < 3 * box, F.greatest(F.lit(8), F.floor(shortest / 3))).otherwise(box).cast("int")


LEVEL = T.StructType([T.StructField("level", T.DoubleType()), T.StructField("rms", T.DoubleType())])


@F.pandas_udf(LEVEL)
def clipped_level(values: pd.Series, sigma: pd.Series) -> pd.DataFrame:
    """Median and MAD sigma of each cell after at most five three-sigma clips."""
    out = np.full((len(values), 2), np.nan)
    for i, raw in enumerate(values):
        v = np.asarray(raw, dtype=float)
        for _ in range(5):
            m, s = np.median(v), v.std()
            kept = v[np.abs(v - m) <= sigma.iloc[i] * s]
            if len(kept) == len(v):
                break
            v = kept
        m = np.median(v)
        out[i] = m, P.MAD_TO_SIGMA * np.median(np.abs(v - m))
    return pd.DataFrame(out, columns=["level", "rms"])


def mesh(pixels: DataFrame, box: int | Column, sigma: float = 3.0, min_fill: float = 0.1) -> DataFrame:
    """Level and rms per cell; ``box`` may differ between frames. A cell holds at most ``box * box`` pixels."""
    side = F.lit(box) if isinstance(box, int) else box
    good = pixels.where(P.good_pixel()).select(*FRAME, "x", "y", "value", side.alias("_box"))
    cells = good.groupBy(
        *FRAME, F.floor(F.col("x") / F.col("_box")).alias("cx"), F.floor(F.col("y") / F.col("_box")).alias("cy")
    ).agg(F.collect_list("value").alias("v"), F.count("*").alias("n"), F.max("_box").alias("_box"))
    d = cells.where(F.col("n") >= min_fill * F.col("_box") * F.col("_box"))
    d = d.withColumn("b", clipped_level(F.sort_array("v"), F.lit(sigma)))
    return d.select(*FRAME, "cx", "cy", F.col("b.level").alias("level"), F.col("b.rms").alias("rms"))


def smooth_mesh(m: DataFrame, size: int = 3) -> DataFrame:
    """Median of each cell's ``size``-square neighbourhood, using the cells that exist."""
    r = size // 2
    around = F.array(
        *[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in range(-r, r + 1) for j in range(-r, r + 1)]
    )
    sent = m.select(*FRAME, "level", "rms", F.explode(around).alias("c"))
    g = sent.groupBy(*FRAME, F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy")).agg(
        F.collect_list("level").alias("_l"), F.collect_list("rms").alias("_r")
    )
    g = g.select(*FRAME, "cx", "cy", arrays.median(F.col("_l")).alias("level"), arrays.median(F.col("_r")).alias("rms"))
    return g.join(m.select(*FRAME, "cx", "cy"), [*FRAME, "cx", "cy"], "left_semi")


def fill_mesh(m: DataFrame, shapes: DataFrame) -> DataFrame:
    """All cells of the frames in ``shapes`` (columns ``nx``, ``ny``); those without a level get one from others.

    A missing cell takes the mean of the ten nearest known cells, weighted by the inverse of their distance (equally
    near ones by row and column). A frame without any known cell has no mesh. One frame's mesh is one group: at most
    the cells of one image.
    """

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        nx, ny = int(g["nx"].iloc[0]), int(g["ny"].iloc[0])
        out = np.full((2, ny, nx), np.nan)
        out[:, g["cy"], g["cx"]] = g[["level", "rms"]].to_numpy().T
        known = np.argwhere(~np.isnan(out[0]))
        for y, x in np.argwhere(np.isnan(out[0])):
            far = np.hypot(*(known - (y, x)).T)
            near = np.argsort(far, kind="stable")[:NEIGHBOURS]
            out[:, y, x] = np.average(out[:, known[near, 0], known[near, 1]], axis=1, weights=1 / far[near])
        y, x = np.indices((ny, nx))
        made = pd.DataFrame({"cx": x.ravel(), "cy": y.ravel(), "level": out[0].ravel(), "rms": out[1].ravel()})
        return made.assign(**{k: g[k].iloc[0] for k in FRAME})[[*FRAME, "cx", "cy", "level", "rms"]]

    kinds = ", ".join(f"{k} {m.schema[k].dataType.simpleString()}" for k in FRAME)
    return m.join(shapes, FRAME).groupBy(*FRAME).applyInPandas(whole, f"{kinds}, cx long, cy long, level double, rms double")


def coefficients(a: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients of a grid whose values are mirrored at the outer cell edges."""
    for _ in range(2):
        n = a.shape[0]
        system = 4 * np.eye(n) + np.eye(n, k=1) + np.eye(n, k=-1)
        system[0, 0] += 1
        system[-1, -1] += 1
        a = np.linalg.solve(system / 6, a).T
    return a


def squares(m: DataFrame) -> DataFrame:
    """Per mesh square between four cell centres: the 16 coefficients around it, and the range of the frame's mesh."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        nx, ny = int(g["cx"].max()) + 1, int(g["cy"].max()) + 1
        qy, qx = np.indices((ny + 1, nx + 1)).reshape(2, -1) - 1
        made = {"qx": qx, "qy": qy}
        for p, name in (("l", "level"), ("r", "rms")):
            grid = np.empty((ny, nx))
            grid[g["cy"], g["cx"]] = g[name]
            wide = np.pad(coefficients(grid), 2, mode="symmetric")
            made[p] = list(np.lib.stride_tricks.sliding_window_view(wide, (4, 4)).reshape(-1, 16))
            made[f"{p}_low"], made[f"{p}_high"] = grid.min(), grid.max()
        return pd.DataFrame(made).assign(**{k: g[k].iloc[0] for k in FRAME})[[*FRAME, *made]]

    kinds = ", ".join(f"{k} {m.schema[k].dataType.simpleString()}" for k in FRAME)
    values = ", ".join(f"{p} array<double>, {p}_low double, {p}_high double" for p in "lr")
    return m.groupBy(*FRAME).applyInPandas(fit, f"{kinds}, qx long, qy long, {values}")


def with_background(pixels: DataFrame, m: DataFrame, box: int | Column) -> DataFrame:
    """Cubic spline through the cells of a whole mesh, mirrored at its edges and kept within the range of its levels.

    Each pixel joins one row with the 16 coefficients of its mesh square.
    """
    side = F.lit(box) if isinstance(box, int) else box
    d = pixels.withColumns({"_u": (F.col("x") + 0.5) / side - 0.5, "_v": (F.col("y") + 0.5) / side - 0.5})
    d = d.withColumns({"qx": F.floor("_u"), "qy": F.floor("_v")})
    weights = {}
    for c, q in (("_u", "qx"), ("_v", "qy")):
        f = F.col(c) - F.col(q)
        g = 1 - f
        cubic = (g * g * g / 6, (4 - 6 * f * f + 3 * f * f * f) / 6, (4 - 6 * g * g + 3 * g * g * g) / 6, f * f * f / 6)
        weights |= {f"{c}{k}": w for k, w in enumerate(cubic)}
    d = d.withColumns(weights).join(squares(m), [*FRAME, "qx", "qy"], "left")

    def mix(p: str) -> Column:
        rows = [sum((F.col(f"_u{i}") * F.col(p)[4 * j + i] for i in range(1, 4)), F.col("_u0") * F.col(p)[4 * j]) for j in range(4)]
        value = sum((F.col(f"_v{j}") * rows[j] for j in range(1, 4)), F.col("_v0") * rows[0])
        return F.least(F.greatest(value, F.col(f"{p}_low")), F.col(f"{p}_high"))

    # ``greatest`` skips nulls, and a frame without a mesh has no background
    floor = F.when(F.col("r_low").isNotNull(), F.greatest(mix("r"), F.lit(1e-6)))
    return d.withColumns({"background": F.when(F.col("l_low").isNotNull(), mix("l")), "background_rms": floor}).drop(
        "_u", "_v", "qx", "qy", *weights, *[f"{p}{s}" for p in "lr" for s in ("", "_low", "_high")]
    )


def subtract(
    pixels: DataFrame, width: int | None = None, height: int | None = None, box: int | None = None, keep_pedestal: bool = False
) -> DataFrame:
    """Remove the sky, with the mesh of each frame's own size. Frames too small for a mesh lose their robust constant.

    Images of any sizes may be mixed; a common ``width`` and ``height`` saves the pass that finds the sizes.
    """
    shape = sizes(pixels)
    if width and height:
        shape = pixels.select(*FRAME).distinct().withColumns({"width": F.lit(width), "height": F.lit(height)})
        sized = pixels.withColumns({"_width": F.lit(width), "_height": F.lit(height)})
    else:
        sized = pixels.join(shape.withColumnsRenamed({"width": "_width", "height": "_height"}), FRAME)
    sized = sized.withColumn("_side", box_size(F.col("_width"), F.col("_height"), box))
    big = F.least("_width", "_height") >= SMALLEST
    own = ["_width", "_height", "_side"]
    small = sized.where(~big)
    flat = median_mad(small.where(P.good_pixel()), FRAME, "value")
    level = {"background": F.col("med"), "background_rms": F.greatest(P.MAD_TO_SIGMA * F.col("mad"), F.lit(1e-6))}
    constant = small.join(flat, FRAME, "left").withColumns(level).drop("med", "mad", *own)
    side = box_size(F.col("width"), F.col("height"), box)
    cells = shape.select(*FRAME, F.ceil(F.col("width") / side).alias("nx"), F.ceil(F.col("height") / side).alias("ny"))
    large = sized.where(big)
    m = smooth_mesh(fill_mesh(mesh(large, F.col("_side")), cells))
    curved = with_background(large, m, F.col("_side")).drop(*own)
    if width and height:
        d = curved if min(width, height) >= SMALLEST else constant
    else:
        d = curved.unionByName(constant)
    if keep_pedestal:
        level = exact_quantiles(d, FRAME, "background", {"_level": 0.5})
        d = d.join(level, FRAME)
        return d.withColumn("value", F.col("value") - F.col("background") + F.col("_level")).drop("_level")
    return d.withColumn("value", F.col("value") - F.col("background"))


def background_report(pixels: DataFrame) -> DataFrame:
    """Level, rms and gradient amplitude per frame from pixels with ``background`` attached."""
    q = exact_quantiles(pixels, FRAME, "background", {"level": 0.5})
    r = exact_quantiles(pixels, FRAME, "background_rms", {"rms": 0.5})
    g = pixels.groupBy(*FRAME).agg((F.max("background") - F.min("background")).alias("gradient"))
    return q.join(r, FRAME).join(g, FRAME)
