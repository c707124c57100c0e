"""Secrets in texts: pattern spans, and how widely each candidate value is owned over the whole corpus.

Every candidate value is counted by the distinct repositories and owners that hold it. A value that many
owners share is a copied example; a value of one or a few owners looks like a live credential. The base
kinds are always spans. The wider kinds (long opaque strings, bearer tokens, passwords in addresses, private
keys) are spans only where ownership says live. A private key is its header, body and footer, and its value is the
body without line breaks, escapes and quotes; a header without a body holds no secret.

Positions come from cutting a text at the matches: gaps and matches alternate, so running lengths within a
text give starts and ends. Only texts with candidates leave their row. Values travel as hashes; a value
that a third of all rows hold is reduced to one row per owner and repository before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.llm.rows import free, stored, text_hash

BASE = ("assign", "access", "hex")
# a private key: header, body and footer; where no footer follows before the next dashes, the lines of the key that
# are there. Loops are possessive, so that long bodies need no stack; the body is the group.
_FOOTED = r"[^-]++(?:-(?!----)[^-]*+)*+(?=-----END [A-Z0-9 ]*PRIVATE KEY-----)"
_LINES = r"""(?:\s*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:(?:[\s"',+>#*]|\\[nr])*+[A-Za-z0-9+/=]{16,}+)++(?:(?:[\s"',+>#*]|\\[nr])*+[A-Za-z0-9+/]+={1,2})?+"""
_KEY = rf"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----({_FOOTED}|{_LINES}|)(?:-----END [A-Z0-9 ]*PRIVATE KEY-----)?+"
#: kind -> pattern, group that holds the value, least length of that value; in the order of equal starts
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "bearer": (r"(?i:bearer)\x20+([A-Za-z0-9._~+/=-]{16,})", 1, 16),
    "address": (r"://[^\s:/@]+:([^\s:/@]{6,})@", 1, 6),
    "header": (_KEY, 1, 16),
    "opaque": (r"(?<![A-Za-z0-9_-])(?=[a-z0-9_-]*[A-Z])(?=[A-Z0-9_-]*[a-z])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{32,}", 0, 32),
}
ORDER = {k: i for i, k in enumerate(KINDS)}
#: owners beyond which a value counts as a copied example
MAX_OWNERS = 2


def _pieces(text: str) -> Column:
    """Candidates of a text: kind, number, length of the gap before, the match and its value."""
    parts = []
    for kind, (pattern, group, _) in KINDS.items():
        whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        zipped = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"), whole.alias("match"), value.alias("value"))
        number = F.lit(ORDER[kind])
        plain = (lambda x: F.when(x.rlike("[A-Za-z0-9+/=]{16}"), F.regexp_replace(x, r"\\[nr]|[^A-Za-z0-9+/=]+", "")).otherwise("")) if kind == "header" else (lambda x: x)
        rows = F.transform(
            F.filter(zipped, lambda x: x["match"].isNotNull()),
            lambda x, i: F.struct(number.alias("kind"), i.alias("i"), x["gap"].alias("gap"), F.length(x["match"]).alias("size"), F.length(plain(x["value"])).alias("value_size"), F.xxhash64(plain(x["value"])).alias("value")),
        )
        parts.append(F.when(F.col(text).rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,value_size:int,value:bigint>>")))
    return F.concat(*parts)


def scan(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    repository: tuple[str, ...] = ("source", "lang"),
    owner: tuple[str, ...] = ("source",),
    max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """One row per row of ``df``: ``id``, ``hash`` (of the text) and ``spans``, sorted by start and kind.

    A span has ``start``, ``end`` (code points, end exclusive), ``kind``, ``owners``, ``repositories``, and
    ``live`` (no more than ``max_owners`` owners; repositories are told but do not judge, because a key in every
    repository of one owner is still that owner's). A null or empty text has no spans; a null owner or
    repository counts as one of its own. Repeated rows are scanned each. An empty table gives no rows.
    Other columns are not read, so their names cannot clash.
    """
    named = df.select(
        F.col(f"`{key}`").alias("id"),
        text_hash(text).alias("hash"),
        F.xxhash64(*[x for c in owner for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]).alias("owner"),
        F.xxhash64(*[x for c in repository for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]).alias("repository"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"),
    )
    rows = stored(named.withColumn("found", _pieces("t")).drop("t").withColumn("row", F.monotonically_increasing_id()), "secret-rows")
    each = rows.where(F.size("found") > 0).select("row", "owner", "repository", F.inline("found"))
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least, names = F.array(*[F.lit(KINDS[k][2]) for k in KINDS]), F.array(*[F.lit(k) for k in KINDS])
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("end") - F.col("size"))
    each = stored(each.where(F.col("value_size") >= F.get(least, F.col("kind"))).select("row", "owner", "repository", "kind", "start", "end", "value"), "secret-candidates")
    owners = each.select("value", "owner").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("owners"))
    repositories = each.select("value", "repository").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("repositories"))
    spread = owners.join(repositories, "value")
    live = F.col("owners") <= max_owners
    judged = each.join(spread, "value").withColumn("live", live).where((F.col("kind") < len(BASE)) | F.col("live"))
    span = F.struct("start", "kind", "end", "owners", "repositories", "live")
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("s"))
    named_span = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(names, x["kind"]).alias("kind"), x["owners"].alias("owners"), x["repositories"].alias("repositories"), x["live"].alias("live"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string,owners:bigint,repositories:bigint,live:boolean>>")
    result = rows.select("row", "id", "hash").join(spans, "row", "left")
    return result.select("id", "hash", F.coalesce(F.transform("s", named_span), empty).alias("spans"))


def labels(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def base(spans: Column) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*BASE))


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[secret]", **scan_options) -> DataFrame:
    """``df`` with every found span replaced by ``mark``; overlapping spans become one mark.

    All rows and columns stay, whatever their names; rows without spans are untouched, among them null and empty
    texts. Rows with a null key and repeated rows are redacted like others. An empty table gives no rows.
    """
    own = free("_spans", df.columns)
    found = scan(df, key, text, **scan_options).where(F.size("spans") > 0).select("id", "hash", "spans").dropDuplicates(["id", "hash"])
    match = df[key].eqNullSafe(found["id"]) & (text_hash(text) == found["hash"])
    joined = df.join(found.select("id", "hash", F.col("spans").alias(own)), match, "left")
    # keep the text between the running ends of the spans before, and write a mark where a new stretch begins
    state = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))
    body = F.col(f"`{text}`")

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        kept = F.concat(acc["done"], body.substr(acc["at"].cast("int") + F.lit(1), (x["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.when(fresh, kept).otherwise(acc["done"]).alias("done"), F.greatest(acc["at"], x["end"]).alias("at"))

    tail = lambda acc: F.concat(acc["done"], body.substr(acc["at"].cast("int") + F.lit(1), F.length(body)))
    cleaned = F.when(F.col(own).isNull(), body).otherwise(F.aggregate(own, state, step, tail))
    return joined.select(*[cleaned.alias(text) if c == text else df[c] for c in df.columns])
