"""Text forms: coordinates, exposure, quality tier, credits and header-safe strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Transliterations for header cards.
ASCII_SUBSTITUTES = (
    ("—", "--"), ("–", "-"), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("…", "..."),
    ("×", "x"), ("±", "+/-"), ("σ", "sigma"), ("λ", "lambda"), ("µ", "u"),
)


def _pad2(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def format_ra(deg: Column) -> Column:
    """``10h 42m 44.51s``; hundredths are counted as whole numbers, so rounding carries over."""
    wrapped = F.pmod(deg, F.lit(360.0))
    n = F.floor(wrapped / 15.0 * 360000.0 + 0.5) % F.lit(24 * 360000)
    sec = n % 6000
    return F.concat(
        _pad2(F.floor(n / 360000)), F.lit("h "), _pad2(F.floor(n / 6000) % 60), F.lit("m "),
        _pad2(F.floor(sec / 100)), F.lit("."), _pad2(sec % 100), F.lit("s"),
    )


def format_dec(deg: Column) -> Column:
    """``+41° 16′ 09.4″`` with a true minus sign."""
    n = F.floor(F.abs(deg) * 36000.0 + 0.5)
    sec = n % 600
    return F.concat(
        F.when(deg < 0, "−").otherwise("+"), _pad2(F.floor(n / 36000)), F.lit("° "),
        _pad2(F.floor(n / 600) % 60), F.lit("′ "), _pad2(F.floor(sec / 10)), F.lit("."),
        (sec % 10).cast("string"), F.lit("″"),
    )


def format_exposure(s: Column) -> Column:
    whole_minutes = F.floor(s / 60.0)
    rest = F.floor(s - whole_minutes * 60 + 0.5)
    short = F.regexp_replace(F.format_string("%.2f", F.floor(s * 100 + 0.5) / 100.0), r"\.?0+$", "")
    fraction = F.floor(F.try_divide(F.lit(1.0), s) + 0.5).cast("string")
    return (
        F.when(s.isNull(), "—")
        .when(s <= 0, "0 s")
        .when(s < 1, F.concat(F.lit("1/"), fraction, F.lit(" s")))
        .when(s < 60, F.concat(short, F.lit(" s")))
        .when(
            whole_minutes < 60,
            F.concat(whole_minutes.cast("string"), F.lit(" min "), _pad2(rest), F.lit(" s")),
        )
        .otherwise(
            F.concat(
                F.floor(whole_minutes / 60).cast("string"), F.lit(" h "),
                _pad2(whole_minutes % 60), F.lit(" min"),
            )
        )
    )


def quality_tier(score: Column) -> Column:
    return (
        F.when(score.isNull(), "unrated")
        .when(score < 0.35, "low")
        .when(score < 0.6, "fair")
        .when(score < 0.82, "good")
        .otherwise("excellent")
    )


def attribution_line(title: Column, photo_id: Column, name: Column, author: Column, licence: Column) -> Column:
    shown = F.coalesce(title, F.concat(F.lit("Foto "), photo_id.cast("string")))
    return F.concat(F.lit('"'), shown, F.lit('" — '), F.coalesce(name, author), F.lit(" ("), licence, F.lit(")"))


def ascii_safe(text: Column, limit: int = 72) -> Column:
    """Printable 7-bit text of at most ``limit`` characters, the width of a header card."""
    out = text
    for a, b in ASCII_SUBSTITUTES:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"[^\x00-\x7F]", "?")
    return F.left(F.regexp_replace(out, r"[^\x20-\x7E]", " "), F.lit(limit))


def hash_ip(ip: Column, salt: str) -> Column:
    """Salted digest; the address itself is never kept."""
    return F.when(F.coalesce(ip, F.lit("")) != "", F.sha2(F.concat_ws(":", F.lit(salt), ip), 256))


def sub_seed(root: int, *labels: Column) -> Column:
    """Deterministic seed from a root seed and labels."""
    return F.xxhash64(F.lit(root), *labels)
