"""URL filters: rules by host and path, and exact membership of listed keys in a cascade of Bloom filters.

The first filter holds the listed keys. Keys of the corpus that are not listed but pass it go into the
second, listed keys that pass the second go into the third, and so on until nothing passes wrongly. The
corpus's whole key set is known when the cascade is built, so for these keys the level at which a key
first fails tells exactly whether it is listed. A page walks the levels with bit tests inside its row:
no join, and a few bits a listed key instead of the keys.

A filter is one array value of at most ``SHARD_KEYS`` keys' bits, whatever the number of listed keys: larger
lists are split by hash into shards with a cascade each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.llm.rows import stored

BITS, PROBES = 10, 5
#: keys of a shard: a filter of 1.25 megabytes
SHARD_KEYS = 1_000_000
MAX_LEVELS = 60
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(rules: list[tuple[str, str, str]], host_name: str, path_name: str) -> tuple[Column, Column]:
    """The longest rule (action, host, path) that fits, as text, and its action; null where none does."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col(host_name) == h) | F.col(host_name).endswith("." + h)) & F.col(path_name).startswith(p)
        text, action = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(act)).otherwise(action)
    return text, action


def _places(level: int, words: int) -> list[Column]:
    """Bits of a key on one level, from its two hashes ``a`` and ``b``."""
    seed = F.xxhash64("a", F.lit(level))
    return [F.pmod(F.xxhash64(seed, "b", F.lit(i)), F.lit(64 * words)) for i in range(PROBES)]


def _filter(keys: DataFrame, level: int, words: int) -> DataFrame:
    """One row: the filter's words in order."""
    bits = keys.select(F.explode(F.array(*_places(level, words))).alias("p"))
    bit = F.expr("shiftleft(1L, cast(p % 64 as int))")
    made = bits.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(bit).alias("x"))
    every = keys.sparkSession.range(words).withColumnRenamed("id", "w").join(made, "w", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("x", F.lit(0)).alias("x")))).alias("s")).select(F.col("s.x").alias("words"))


def _passes(filter_row: DataFrame, level: int, words: int) -> Column:
    value = filter_row.select("words").scalar()
    tests = [F.getbit(F.get(value, (p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in _places(level, words)]
    return reduce(lambda x, y: x & y, tests)


class Cascade:
    """Filters of one shard; ``member`` is exact for every key of the universe it was built over."""

    def __init__(self, listed: DataFrame, others: DataFrame):
        self.levels: list[tuple[DataFrame, int]] = []
        mine, rest = listed, others
        n = mine.count()
        while n:
            level = len(self.levels)
            if level == MAX_LEVELS:
                raise ValueError("two keys share both hashes")
            words = max(1, -(-n * BITS // 64))
            made = stored(_filter(mine, level, words), "cascade-filter")
            self.levels.append((made, words))
            wrong = stored(rest.where(_passes(made, level, words)), "cascade-keys")
            mine, rest = wrong, mine
            n = mine.count()

    def member(self) -> Column:
        """Whether the key with hashes ``a`` and ``b`` is listed."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            # failing an odd level (from one) means not listed, failing an even one means listed
            verdict = F.when(_passes(self.levels[i][0], i, self.levels[i][1]), verdict).otherwise(F.lit(i % 2 == 1))
        return verdict


def key_hashes(key: str) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b")


def members(rows: DataFrame, key: str, listed: DataFrame, listed_key: str, out: str = "listed", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``rows`` with the boolean ``out``: whether the row's key is among the listed keys; exact for all rows.

    The universe is the set of distinct keys of ``rows``; listed keys outside it need no bits. Null keys are
    not listed. An existing column ``out`` is replaced; other columns pass through.
    """
    hidden = [c for c in ("a", "b") if c in rows.columns]
    named = rows.select("*").drop(out)
    for c in hidden:
        named = named.withColumnRenamed(c, f"_cascade_{c}")
    key = f"_cascade_{key}" if key in hidden else key
    universe = stored(named.select(F.col(key).alias("k")).where("k is not null").distinct().select("k", *key_hashes("k")), "cascade-universe")
    mark = listed.select(F.col(listed_key).alias("k")).where("k is not null").distinct()
    inside = stored(universe.join(mark, "k", "left_semi").select("a", "b"), "cascade-listed")
    outside = universe.join(mark, "k", "left_anti").select("a", "b")
    shards = max(1, -(-inside.count() // shard_keys))
    shard = F.pmod(F.col("b"), F.lit(shards))
    verdict = F.lit(False)
    for s in range(shards):
        one = Cascade(inside.where(shard == s), outside.where(shard == s)).member()
        verdict = one if shards == 1 else F.when(shard == s, one).otherwise(verdict)
    done = named.select("*", *key_hashes(key)).withColumn(out, F.when(F.col(key).isNull(), F.lit(False)).otherwise(verdict)).drop("a", "b")
    for c in hidden:
        done = done.withColumnRenamed(f"_cascade_{c}", c)
    return done


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]], listed_terms: tuple[str, ...], key: str = "page_id", url: str = "url"
) -> DataFrame:
    """One row per page: key, ``host``, ``path``, ``rule``, ``verdict``.

    A fitting rule decides; otherwise the page is blocked if its host and path are a listed key. Listed are the
    keys whose host holds one of ``listed_terms``. A null url, or one without ``://``, has an empty host and
    path: no rule fits and it is allowed. Repeated pages are judged alike. An empty table gives no rows.
    Other columns are not read.
    """
    rows = pages.select(F.col(f"`{key}`").alias("page"), F.col(f"`{url}`").alias("url"))
    rows = rows.select("page", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("key", F.concat("host", "path"))
    listed = rows.where(reduce(lambda x, y: x | y, [F.col("host").contains(t) for t in listed_terms])).select("key")
    rows = members(rows, "key", listed, "key")
    rule, action = rule_columns(rules, "host", "path")
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(F.col("page").alias(key), "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"))
