"""Quality rules: base statistics of whole texts, and robust multivariate outliers per language and source.

Five statistics of a text are transformed, and each group (language, source) gets a minimum-covariance-
determinant estimate of their centre and covariance: from a start at the medians, concentration steps
take mean and covariance of the ``COVER`` share of rows nearest to the last estimate. The covariance is
scaled so that the median distance is that of a normal vector, and rows beyond a cut are rejected.

All of it is aggregation. Distances are counted in logarithmic bins, so a step needs one grouped sum with
at most a few hundred rows a group, whatever the group's size; sums are over integers (ten-thousandths),
so the estimates do not depend on the order of rows. A group that holds a third of all rows is summed up
where its rows are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.llm.rows import stored, text_hash

SEPARATORS = r"[ \t-\r]+"
WINDOW = 8
#: dimension names, and the least spread that each may be given
FLOOR = {"words": 0.5, "length": 0.1, "symbols": 0.025, "lines": 0.5, "repeats": 0.1}
DIMS = tuple(FLOOR)
UNIT = 10_000
#: share of rows an estimate rests on, steps, rows a group needs, median and cut of squared distances
COVER, STEPS, MIN_GROUP = 0.75, 5, 200
MEDIAN_CHI2_5 = 4.351460191095526
#: The cut is a tenth above the largest distance, 77.2, that a text without symbols and repeated lines has at scale 0.1
#: (10 000 rows). The chi-square quantile does not fit: floors and scale stretch distances, and prose has long tails.
CUT = 85.0
#: groups of prose have scales of 4 to 6; without a bound few rows, or copies, would have a median distance of nothing
MAX_SCALE = 8.0
BINS = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _staged(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in columns.items()])


def base_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text but with the base statistics; all as array work inside the row.

    Columns called like a statistic are replaced, all others stay: they travel under numbers, so no name can clash.
    """
    names = {f"c{i}": c for i, c in enumerate(c for c in df.columns if c != text and c.lower() not in BASE)}
    keep = list(names)
    one = df.select(*[F.col(f"`{c}`").alias(k) for k, c in names.items()], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    word = "[^ \t-\r]"
    one = _staged(
        one,
        _w=F.array_remove(F.split("_t", SEPARATORS), ""),
        _l=F.filter(F.split("_t", "\n"), lambda x: x.rlike(word)),
        _s=F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")),
    )
    one = one.select(
        *keep,
        F.size("_w").alias("_n"),
        F.length(F.array_join("_w", "")).alias("_c"),
        "_s",
        (F.size("_l") - F.size(F.array_distinct("_l"))).alias("_d"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h1"),
    )
    # hash of 8 consecutive words by doubling: 1, 2, 4, 8
    for size in (1, 2, 4):
        a = f"_h{size}"
        rest = F.slice(a, size + 1, F.greatest(F.size(a), F.lit(1)))
        one = one.withColumn(f"_h{2 * size}", F.zip_with(a, rest, lambda x, y: F.xxhash64(x, y))).drop(a)
    one = one.withColumn("_h8", F.slice("_h8", 1, F.greatest(F.col("_n") - (WINDOW - 1), F.lit(0))))
    again = F.size(F.array_distinct("_h8")) < F.size("_h8")
    listed = F.array_sort(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    one = one.withColumn("_p", F.when(again, listed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("_h8")
    near = lambda i, step: F.get("_p", i + step)["h"]
    same = lambda x, i: F.coalesce(x["h"] == near(i, -1), F.lit(False)) | F.coalesce(x["h"] == near(i, 1), F.lit(False))
    one = one.withColumn("_r", F.array_sort(F.transform(F.filter("_p", same), lambda x: x["i"]))).drop("_p")
    gaps = F.transform("_r", lambda x, i: F.least(F.coalesce(F.get("_r", i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)
    long = {"n_words": F.col("_n"), "word_chars": F.col("_c"), "n_symbols": F.col("_s"), "n_dup_lines": F.col("_d"), "n_repeat_words": covered}
    return one.select(*[F.col(k).alias(c) for k, c in names.items()], *[v.cast("long").alias(k) for k, v in long.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vector() -> dict[str, Column]:
    """Transformed statistics in ten-thousandths; only for rows with words."""
    w = F.col("n_words").cast("double")
    x = {
        "words": F.log1p(w),
        "length": F.log(F.col("word_chars") / w),
        "symbols": F.col("n_symbols") / F.col("word_chars"),
        "lines": F.log1p(F.col("n_dup_lines").cast("double")),
        "repeats": F.asin(F.sqrt(F.col("n_repeat_words") / w)),
    }
    return {k: F.round(v * UNIT).cast("long") for k, v in x.items()}


def _sums() -> dict[str, Column]:
    out = {"n": F.count(F.lit(1))}
    for i, a in enumerate(DIMS):
        out[f"s_{a}"] = F.sum(a)
        for b in DIMS[i:]:
            out[f"q_{a}_{b}"] = F.sum((F.col(a) * F.col(b)).cast("decimal(20,0)"))
    return out


def _estimate(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Centre and inverse Cholesky factor of the floored covariance, from grouped sums."""
    n = F.col("n").cast("double")
    mean = {a: F.col(f"s_{a}") / n / UNIT for a in DIMS}
    df = sums.select(*keys, *[mean[a].alias(f"m_{a}") for a in DIMS], *[f"q_{a}_{b}" for i, a in enumerate(DIMS) for b in DIMS[i:]], "n")
    cov = {}
    for i, a in enumerate(DIMS):
        for b in DIMS[i:]:
            c = F.col(f"q_{a}_{b}").cast("double") / n / UNIT / UNIT - F.col(f"m_{a}") * F.col(f"m_{b}")
            cov[f"c_{a}_{b}"] = c + F.lit(FLOOR[a] ** 2) if a == b else c
    df = df.select(*keys, *[f"m_{a}" for a in DIMS], *[c.alias(k) for k, c in cov.items()])
    for i, a in enumerate(DIMS):  # factor row by row
        for j, b in enumerate(DIMS[: i + 1]):
            rest = F.col(f"c_{b}_{a}")
            for k in DIMS[:j]:
                rest = rest - F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}")
            df = df.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if a == b else rest / F.col(f"l_{b}_{b}"))
    for i, a in enumerate(DIMS):  # invert the factor
        for j, b in enumerate(DIMS[: i + 1]):
            if a == b:
                df = df.withColumn(f"v_{a}_{a}", 1.0 / F.col(f"l_{a}_{a}"))
            else:
                total = reduce(lambda x, y: x + y, [F.col(f"l_{a}_{k}") * F.col(f"v_{k}_{b}") for k in DIMS[j:i]])
                df = df.withColumn(f"v_{a}_{b}", -total / F.col(f"l_{a}_{a}"))
    return df.select(*keys, *[f"m_{a}" for a in DIMS], *[f"v_{a}_{b}" for i, a in enumerate(DIMS) for b in DIMS[: i + 1]])


def _distance() -> Column:
    """Squared Mahalanobis distance of a row to the estimate it is joined with."""
    off = {a: F.col(a) / UNIT - F.col(f"m_{a}") for a in DIMS}
    rows = [reduce(lambda x, y: x + y, [F.col(f"v_{a}_{b}") * off[b] for b in DIMS[: i + 1]]) for i, a in enumerate(DIMS)]
    return reduce(lambda x, y: x + y, [r * r for r in rows])


def _bin(d2: Column) -> Column:
    return F.floor(BINS * F.log2(d2 + 1e-9)).cast("int")


KEYS = ["g_lang", "g_source"]
#: whose estimate judges a row: its language and source, its language, or all rows
OWN, LANGUAGE, ALL = 0, 1, 2


def _on(a: DataFrame, b: DataFrame) -> DataFrame:
    """Null-safe join to the estimates: a few numbers a group, so the rows stay where they are."""
    other = b.select(*[F.col(k).alias(f"o{k}") for k in KEYS], *[c for c in b.columns if c not in KEYS])
    return a.join(other, [F.col(k).eqNullSafe(F.col(f"o{k}")) for k in KEYS]).drop(*[f"o{k}" for k in KEYS])


def _below(cum: str, share: float) -> Column:
    return F.col(cum) < share * F.col("total")


def _binned(vectors: DataFrame, estimate: DataFrame) -> DataFrame:
    bins = _on(vectors, estimate).withColumn("bin", _bin(_distance())).groupBy(*KEYS, "bin").agg(*[c.alias(k) for k, c in _sums().items()])
    group = Window.partitionBy(*KEYS)
    order = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return bins.withColumn("below", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn("total", F.sum("n").over(group))


def estimates(vectors: DataFrame, steps: int = STEPS, cover: float = COVER) -> DataFrame:
    """Per group: centre, inverse factor, and ``scale``, the factor that makes squared distances comparable to chi-square."""
    coarse = [F.percentile((F.col(a) / (UNIT // 20)).cast("int"), F.lit(0.5)).alias(f"m_{a}") for a in DIMS]
    start = vectors.groupBy(*KEYS).agg(*coarse).select(
        *KEYS,
        *[(F.col(f"m_{a}") / 20).alias(f"m_{a}") for a in DIMS],
        *[F.lit(1.0 / FLOOR[a] if a == b else 0.0).alias(f"v_{a}_{b}") for i, a in enumerate(DIMS) for b in DIMS[: i + 1]],
    )
    now = stored(start, "mcd")
    total = [F.sum(k).alias(k) for k in _sums()]
    for _ in range(steps):
        near = _binned(vectors, now).where(_below("below", cover)).groupBy(*KEYS).agg(*total)
        now = stored(_estimate(near, KEYS), "mcd")
    middle = _binned(vectors, now).where(_below("below", 0.5)).groupBy(*KEYS).agg(F.max("bin").alias("bin"))
    ratio = F.lit(MEDIAN_CHI2_5) / F.pow(F.lit(2.0), (F.col("bin") + 1) / F.lit(float(BINS)))
    scale = middle.select(*KEYS, F.least(ratio, F.lit(MAX_SCALE)).alias("scale"))
    return stored(_on(now, scale), "mcd")


def judge(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    cut: float = CUT,
    min_group: int = MIN_GROUP,
    steps: int = STEPS,
    cover: float = COVER,
) -> DataFrame:
    """One row per row of ``df``: key, base statistics, ``base_failed``, ``distance`` (squared, scaled), ``kept``, ``text_hash``.

    ``kept`` is false for rows that fail the base rule and for rows farther than ``cut`` from the estimate
    of their group. A group of fewer than ``min_group`` rows with words is judged by the estimate over all rows
    of its language, and where these are too few, by the estimate over all rows. Null languages and sources are groups of their own. A null or empty
    text has no words: it fails the base rule, takes no part in estimates, and its distance is null.
    Repeated rows count as often as they stand there. An empty table gives no rows. Other columns are not
    read, so their names cannot clash.
    """
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in ((key, "_key"), (lang, "_lang"), (source, "_source"), (text, "_text"))], text_hash(text).alias("_hash"))
    facts = stored(base_statistics(rows, "_text").withColumn("base_failed", base_failed()), "quality-facts")
    worded = facts.where("n_words > 0")
    sizes = worded.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"))
    language = Window.partitionBy("_lang")
    enough = F.sum("n").over(language) >= min_group
    sizes = sizes.withColumn("g_level", F.when(F.col("n") >= min_group, OWN).when(enough, LANGUAGE).otherwise(ALL))
    sizes = sizes.withColumn("g_language", F.max(F.col("g_level") == LANGUAGE).over(language))
    sizes = stored(sizes.select(F.col("_lang").alias("g_lang"), F.col("_source").alias("g_source"), "g_level", "g_language"), "quality-groups")
    groups = sizes.crossJoin(F.broadcast(sizes.agg(F.max(F.col("g_level") == ALL).alias("g_all"))))
    named = _on(worded.select("*", F.col("_lang").alias("g_lang"), F.col("_source").alias("g_source")), groups)
    # names are marked, so that a null language or source cannot be taken for a wider group, whose names are null
    marked = lambda c: F.concat(F.lit("="), F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull().cast("string"))
    nothing = F.lit(None).cast("string")
    levels = {OWN: (marked("g_lang"), marked("g_source")), LANGUAGE: (marked("g_lang"), nothing), ALL: (nothing, nothing)}
    group = {k: F.struct(*[c.alias(n) for n, c in zip(KEYS, v, strict=True)]) for k, v in levels.items()}
    wanted = {OWN: F.col("g_level") == OWN, LANGUAGE: F.col("g_language"), ALL: F.col("g_all")}
    part = F.filter(F.array(*[F.when(wanted[k], group[k]) for k in levels]), lambda x: x.isNotNull())
    numbers = [c.alias(k) for k, c in _vector().items()]
    vectors = named.select(F.inline(part), *numbers)
    named = named.withColumn("g", F.when(F.col("g_level") == OWN, group[OWN]).when(F.col("g_level") == LANGUAGE, group[LANGUAGE]).otherwise(group[ALL]))
    final = estimates(vectors, steps, cover)
    judged = named.select("_key", "_hash", *BASE, "base_failed", *[F.col(f"g.{k}").alias(k) for k in KEYS], *numbers)
    judged = _on(judged, final).withColumn("distance", _distance() * F.col("scale"))
    kept = ~F.col("base_failed") & (F.col("distance") <= cut)
    columns = [F.col("_key").alias(key), *BASE, "base_failed", F.col("_hash").alias("text_hash")]
    judged = judged.select(*columns, "distance", kept.alias("kept"))
    wordless = facts.where("n_words = 0").select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return judged.unionByName(wordless)
