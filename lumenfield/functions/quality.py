"""Explainable quality score of a frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfield.functions.sky import clamp

# Component weights.
WEIGHTS = {
    "fwhm": 0.30,
    "snr": 0.22,
    "airmass": 0.12,
    "eccentricity": 0.10,
    "moon": 0.10,
    "star_count": 0.08,
    "bortle": 0.08,
}
# Thresholds of the sub-scores.
FWHM_EXCELLENT, FWHM_POOR = 1.5, 8.0
ECCENTRICITY_POOR = 0.6
SNR_FLOOR, SNR_FULL = 3.0, 100.0
STARS_FULL = 2000
EXTINCTION, AIRMASS_CUTOFF = 0.35, 5.0
MOON_SAFE, MOON_BAD = 90.0, 15.0
BORTLE_BEST, BORTLE_WORST = 1, 9
UNKNOWN = 0.5


def fwhm_score(x: Column) -> Column:
    return F.when(x.isNotNull(), clamp((FWHM_POOR - x) / (FWHM_POOR - FWHM_EXCELLENT)))


def eccentricity_score(x: Column) -> Column:
    return F.when(x.isNotNull(), clamp(1.0 - x / ECCENTRICITY_POOR))


def snr_score(x: Column) -> Column:
    gain = F.log10(F.greatest(x, F.lit(SNR_FLOOR)) / SNR_FLOOR)
    return F.when(x.isNotNull(), clamp(gain / F.log10(F.lit(SNR_FULL / SNR_FLOOR))))


def star_score(n: Column) -> Column:
    gain = F.log10(1.0 + F.greatest(n, F.lit(0)))
    return F.when(n.isNotNull(), clamp(gain / F.log10(F.lit(1.0 + STARS_FULL))))


def airmass_score(x: Column) -> Column:
    decay = clamp(F.exp(-EXTINCTION * (F.greatest(F.lit(1.0), x) - 1.0)))
    return F.when(x.isNotNull(), F.when(x >= AIRMASS_CUTOFF, 0.0).otherwise(decay))


def moon_score(illumination: Column, separation_deg: Column) -> Column:
    near = F.coalesce(clamp((MOON_SAFE - separation_deg) / (MOON_SAFE - MOON_BAD)), F.lit(1.0))
    near = F.when(separation_deg.isNull(), 1.0).otherwise(near)
    return F.when(illumination.isNotNull(), clamp(1.0 - clamp(illumination) * near))


def bortle_score(x: Column) -> Column:
    return F.when(
        x.isNotNull(), clamp((BORTLE_WORST - x) / F.lit(float(BORTLE_WORST - BORTLE_BEST)))
    )


def sub_scores(c: dict[str, Column]) -> dict[str, Column]:
    """Sub-score per component; null where the measurement is missing."""
    return {
        "fwhm": fwhm_score(c["fwhm_arcsec"]),
        "eccentricity": eccentricity_score(c["eccentricity"]),
        "snr": snr_score(c["snr_estimate"]),
        "star_count": star_score(c["star_count"]),
        "airmass": airmass_score(c["airmass"]),
        "moon": moon_score(c["moon_illumination"], c["moon_separation_deg"]),
        "bortle": bortle_score(c["bortle_estimate"]),
    }


def with_quality(df, columns: dict[str, str] | None = None, prefix: str = "q_"):
    """Add sub-scores ``q_*``, ``quality``, ``components`` (map) and ``missing`` (array)."""
    names = {
        n: n
        for n in (
            "fwhm_arcsec eccentricity snr_estimate star_count airmass moon_illumination"
            " moon_separation_deg bortle_estimate"
        ).split()
    } | (columns or {})
    scores = sub_scores({k: F.col(v) for k, v in names.items()})
    df = df.select("*", *[s.alias(prefix + k) for k, s in scores.items()])
    zero = F.lit(0.0)
    num, den = zero, zero
    for k, w in WEIGHTS.items():
        q = F.col(prefix + k)
        num = num + F.coalesce(q * w, zero)
        den = den + F.when(q.isNotNull(), w).otherwise(zero)
    pairs = F.array(
        *[F.struct(F.lit(k).alias("k"), F.col(prefix + k).alias("v")) for k in WEIGHTS]
    )
    return df.select(
        "*",
        F.when(den <= 0, UNKNOWN).otherwise(clamp(F.try_divide(num, den))).alias("quality"),
        F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("components"),
        F.filter(
            F.array(*[F.when(F.col(prefix + k).isNull(), F.lit(k)) for k in WEIGHTS]),
            lambda m: m.isNotNull(),
        ).alias("missing"),
    )
