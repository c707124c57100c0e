"""Images cut into tiles with a margin of their neighbours' pixels.

An axis of length W has ``max(1, W div tile)`` tiles that start at ``floor(t * W / n)``, so that no tile is narrower than
``tile`` and a margin never reaches over a whole neighbour. A pixel goes to its own tile and to those whose margin it
lies in, with its place there: ``px`` runs from ``-margin`` to ``core + margin - 1``. Where an axis has one tile, there is no
margin; whoever works in the tile closes or pads the axis itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 128


def _layout(d: DataFrame, axis: str, at: str, size: str, tile: Column) -> DataFrame:
    """Columns for one axis: number of tiles, own tile, its start, and the borders of the tiles next to it."""
    names = {k: f"_{axis}{k}" for k in ("n", "t", "a", "b", "c", "d")}
    x, w, n, t = (F.col(v).cast("bigint") for v in (at, size, names["n"], names["t"]))
    start = lambda k: F.floor(k * w / n).cast("bigint")
    d = d.withColumn(names["n"], F.greatest(F.lit(1).cast("bigint"), F.floor(w / tile).cast("bigint")))
    d = d.withColumn(names["t"], F.floor(((x + 1) * n - 1) / w).cast("bigint"))
    # start of the tile before (from the far end where it closes), own start and end, end of the tile after
    before = F.when(t > 0, start(t - 1)).otherwise(start(n - 1) - w)
    after = F.when(t < n - 1, start(t + 2)).otherwise(start(F.lit(1).cast("bigint")) + w)
    return d.withColumns({names["a"]: before, names["b"]: start(t), names["c"]: start(t + 1), names["d"]: after})


def _axis(axis: str, at: str, margin: Column, wrap: bool) -> Column:
    """Array of (tile, place, core length, number of tiles) for one coordinate."""
    x, n, t, a, b, c, d = (F.col(v) for v in (at, *[f"_{axis}{k}" for k in ("n", "t", "a", "b", "c", "d")]))
    target = lambda k, p, length: F.struct(k.alias("t"), p.cast("int").alias("p"), length.cast("int").alias("core"), n.cast("int").alias("n"))
    low = (n > 1) & (x - b < margin) & (F.lit(wrap) | (t > 0))
    high = (n > 1) & (c - x <= margin) & (F.lit(wrap) | (t < n - 1))
    own = target(t, x - b, c - b)
    left, right = target(F.pmod(t - 1, n), x - a, b - a), target(F.pmod(t + 1, n), x - c, d - c)
    return F.when(~low & ~high, F.array(own)).when(~high, F.array(own, left)).when(~low, F.array(own, right)).otherwise(F.array(own, left, right))


def deal(pixels: DataFrame, margin: Column | int, tile: Column | int = TILE, wrap: bool = False) -> DataFrame:
    """Rows of ``pixels`` (with ``x, y, width, height``) once for each tile they belong to.

    Added are ``tx, ty`` (tile), ``px, py`` (place in it), ``cx, cy`` (core size) and ``nx, ny`` (tiles of the image). With ``wrap``
    the image is closed at its edges. ``tile`` must not be smaller than ``margin``.
    """
    names = pixels.columns
    t = tile if isinstance(tile, Column) else F.lit(tile)
    d = pixels.withColumns({"_tile": t, "_m": margin if isinstance(margin, Column) else F.lit(margin)})
    d = _layout(_layout(d, "x", "x", "width", F.col("_tile")), "y", "y", "height", F.col("_tile"))
    d = d.select(*names, F.explode(_axis("x", "x", F.col("_m"), wrap)).alias("_u"), "_m", *[f"_y{k}" for k in "ntabcd"])
    d = d.select(*names, "_u", F.explode(_axis("y", "y", F.col("_m"), wrap)).alias("_v"))
    parts = {"tx": "_u.t", "ty": "_v.t", "px": "_u.p", "py": "_v.p", "cx": "_u.core", "cy": "_v.core", "nx": "_u.n", "ny": "_v.n"}
    return d.select(*names, *[F.col(p).alias(n) for n, p in parts.items()])
