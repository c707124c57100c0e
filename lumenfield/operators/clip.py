"""Sigma clipping of stacks on tiles: every round of a tile runs on arrays, without a shuffle between.

A round compares a sample with the median of its pixel and allows for the slope of the medians to the four
neighbours, so each round needs one more pixel around. A tile therefore carries a margin of as many pixels as
there are rounds, and what is wrong at its rim never reaches its core. Images are closed at their edges.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.operators import tiles
from lumenfield.operators.skew import spread

#: samples of one tile, margin included
SAMPLES = 1 << 22
NARROWEST = 16
CLIPPED = "stack_id bigint, frame_id bigint, x bigint, y bigint, above boolean"


def middle(v: np.ndarray) -> np.ndarray:
    """Median over the first axis without the NaN; NaN where there is nothing else."""
    s = np.sort(v, axis=0)  # NaN goes last
    n = (~np.isnan(v)).sum(axis=0)
    take = lambda at: np.take_along_axis(s, np.maximum(at, 0)[None], axis=0)[0]
    return (take((n - 1) // 2) + take(np.minimum(n // 2, len(v) - 1))) / 2.0


def slope(centre: np.ndarray) -> np.ndarray:
    """Largest absolute step to a 4-neighbour, closed at the edges."""
    down, right = np.abs(centre - np.roll(centre, 1, 0)), np.abs(centre - np.roll(centre, 1, 1))
    return np.maximum(np.maximum(down, np.roll(down, -1, 0)), np.maximum(right, np.roll(right, -1, 1)))


def clip_block(
    value: np.ndarray, sigma: np.ndarray, keep: np.ndarray, depth: int, low: float, high: float, rounds: int, min_keep: int, structure_factor: float
) -> np.ndarray:
    """What stays of a block (frames, rows, columns) after the rounds; ``depth`` is the number of frames of the stack."""
    inflation = 1.0 if depth < 2 else math.sqrt(1.0 + math.pi / (2.0 * depth))
    for _ in range(rounds):
        centre = np.nan_to_num(middle(np.where(keep, value, np.nan)))
        room = structure_factor * slope(centre)
        off = value - centre
        with np.errstate(invalid="ignore"):
            trial = keep & (off <= high * sigma * inflation + room) & (off >= -(low * sigma * inflation + room))
        trial = np.where(trial.sum(axis=0) < min(min_keep, depth), keep, trial)
        if np.array_equal(trial, keep):
            break
        keep = trial
    return keep


def clipped(
    samples: DataFrame, low: float = 5.0, high: float = 3.0, rounds: int = 3, min_keep: int = 2, structure_factor: float = 1.2, samples_per_tile: int = SAMPLES
) -> DataFrame:
    """The samples that do not stay: (stack_id, frame_id, x, y, above), ``above`` the median of all values of the pixel.

    ``samples`` has stack_id, frame_id, x, y, value, sigma, keep, depth, width, height. Null values are never kept. Only
    what is clipped leaves the tiles, so what follows is small.
    """
    rounds = max(1, int(rounds))
    side = F.floor(F.sqrt(F.lit(float(samples_per_tile)) / F.col("depth"))) - 2 * rounds
    tile = F.least(F.lit(tiles.TILE), F.greatest(F.lit(max(NARROWEST, rounds)), side)).cast("bigint")
    dealt = tiles.deal(samples, rounds, tile, wrap=True)
    columns = ["stack_id", "frame_id", "x", "y", "value", "sigma", "keep", "depth", "tx", "ty", "px", "py", "cx", "cy", "nx", "ny"]

    def run(rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(),) * 4 + (pa.bool_(),)], ["stack_id", "frame_id", "x", "y", "above"])
        first = {n: rows.column(n)[0].as_py() for n in ("depth", "cx", "cy", "nx", "ny")}
        mx, my = (rounds if first[n] > 1 else 0 for n in ("nx", "ny"))
        frames, f = np.unique(rows.column("frame_id").to_numpy(), return_inverse=True)
        px, py = rows.column("px").to_numpy(), rows.column("py").to_numpy()
        at = (f, py + my, px + mx)
        shape = (len(frames), first["cy"] + 2 * my, first["cx"] + 2 * mx)
        value, sigma, keep = np.full(shape, np.nan), np.zeros(shape), np.zeros(shape, bool)
        value[at] = rows.column("value").to_numpy()
        sigma[at] = rows.column("sigma").to_numpy()
        keep[at] = rows.column("keep").to_numpy()
        keep &= ~np.isnan(value)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            stays = clip_block(value, sigma, keep, first["depth"], low, high, rounds, min_keep, structure_factor)
            over = value > middle(value)
        core = (px >= 0) & (px < first["cx"]) & (py >= 0) & (py < first["cy"])
        out = np.flatnonzero(core & keep[at] & ~stays[at])
        part = rows.select(["stack_id", "frame_id", "x", "y"]).take(pa.array(out))
        return part.append_column("above", pa.array(over[tuple(a[out] for a in at)]))

    keys = ["stack_id", "tx", "ty"]
    typed = dealt.select(*[F.col(c).cast("bigint").alias(c) if c in ("stack_id", "frame_id", "x", "y", "depth") else F.col(c) for c in columns])
    return spread(typed, *keys).groupBy(*keys).applyInArrow(run, CLIPPED)
