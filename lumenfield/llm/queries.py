"""The registered queries of this folder, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.llm import ann, bpe, contamination, conversations, licences, lm, near, quality, secret_spans, substrings, token_files, url_filter, whitening
from lumenfield.session import configure, work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query
def op9_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level BPE of every whole text and back; digests of ids and of the decoded text."""
    done = bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), carry=["doc_id"])
    return done.select(
        "doc_id",
        F.size("bpe.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("bpe.ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole text written to indexed shards in key order and read back through the index."""
    docs, place = table(spark, folder, "documents"), work_folder(spark, "token-files")
    token_files.write(docs, public_tokenizers.path("word_bpe_49k.json"), place)
    return token_files.read(spark, place).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("raw").alias("ids_crc32"))


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in a 13-word window of a benchmark item."""
    found = contamination.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"), carry=["doc_id"])
    return found.select(
        "doc_id",
        F.col("contamination.n_words").alias("n_words"),
        contamination.n_hit(F.col("contamination.hits")).alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ",").cast("binary"), 256).alias("items_sha256"),
        contamination.contaminated().alias("contaminated"),
    )


SQL["op5_decontamination"] = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (
  select distinct item_id, n, array_to_string(w[i + 1 : i + n], ' ') as g
  from (select item_id, w, least(len(w), 13) as n, unnest(range(0, greatest(len(w) - 12, 1))) as i from b where len(w) > 0)),
dw as (
  select doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') as g
  from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as i from d, (select distinct n from bw) where len(w) >= n)),
hit as (select doc_id, i, n, item_id from dw join bw using (n, g)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from hit group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join words using (doc_id) left join found using (doc_id)
"""


@query
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Base statistics of every document and the verdict of the robust outlier rule."""
    return quality.judge(table(spark, folder, "documents")).drop("text_hash")


@query
def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near.find(table(spark, folder, "documents"))


@query
def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secret spans of every whole text, with the ownership of their values over all documents."""
    found = secret_spans.scan(table(spark, folder, "documents"))
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(kind).alias(f"n_{kind}") for kind in secret_spans.BASE],
        F.sha2(secret_spans.labels(secret_spans.base(spans)).cast("binary"), 256).alias("base_sha256"),
        secret_spans.labels(spans).alias("spans"),
        F.size(F.filter(spans, lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda x: ~x["live"])).cast("long").alias("n_example"),
    )


@query
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the words that a 50-word window shares with an earlier document."""
    done = substrings.remove_repeats(table(spark, folder, "documents"))
    return done.select(F.col("id").alias("doc_id"), "n_words", substrings.n_removed(F.col("removed")).alias("n_removed"), "kept_sha256")


@query
def op10_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Stupid-backoff score of every document by the trigram counts of all others."""
    scored = lm.score(table(spark, folder, "documents"))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.withColumnRenamed("id", "doc_id").withColumn("mean_log_score", mean)


@query
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page by rules, else by exact membership of its host and path in the listed keys."""
    return url_filter.judge(table(spark, folder, "pages"), URL_RULES, LISTED_TERMS)


#: fixed values of the query: rules (action, host, path) and words of listed hosts
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
LISTED_TERMS = ("spam", "pills", "casino", "cheap", "adult")

SQL["op8_url_filter"] = """
with p as (
  select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(act, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit as (
  select host, path, arg_max(h || p, length(h || p)) as rule, arg_max(act, length(h || p)) as act
  from (select distinct host, path from p) u, rules r
  where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by host, path)
select page_id, p.host, p.path, rule,
  coalesce(act, case when regexp_matches(p.host, 'spam|pills|casino|cheap|adult') then 'block' else 'allow' end) as verdict
from p left join fit using (host, path)
"""


@query
def op2_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of every document by known sentences and ordered rules."""
    return licences.scan(table(spark, folder, "documents"))


@query
def op11_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of all vectors for every vector whose id is divisible by 20."""
    vectors = table(spark, folder, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings in the first 32 whitened components of their exact covariance."""
    return whitening.whiten(table(spark, folder, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


@query
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return conversations.repair(conversations.damage(table(spark, folder, "conversations")))


SQL["op3_substring_dedup"] = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') as g from (select doc_id, w, unnest(range(0, len(w) - 49)) as i from d where len(w) >= 50)),
f as (select g, min(doc_id) as earliest from g group by g),
gone as (select distinct doc_id, p, true as is_gone from (select doc_id, unnest(range(i, i + 50)) as p from g join f using (g) where earliest < doc_id)),
words as (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as p from d),
kept as (select doc_id, count(is_gone) as n, string_agg(word, ' ' order by p) filter (is_gone is null) as rest from words left join gone using (doc_id, p) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(rest, '')) as kept_sha256 from d left join kept using (doc_id)
"""

SQL["op7_near_duplicates"] = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') as w from documents),
g as (select distinct doc_id, array_to_string(w[i + 1 : i + 5], ' ') as g from (select doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
link as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as same from g x join g y on x.g = y.g and x.doc_id < y.doc_id group by all)
  join n p on p.doc_id = a join n q on q.doc_id = b where 100 * same >= 75 * (p.n + q.n - same)),
edges as (select a, b from link union all select b, a from link),
reach as (select doc_id as a, doc_id as b from n union select r.a, e.b from reach r join edges e on e.a = r.b)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component, d.doc_id) as component_id, coalesce(component, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join (select a as doc_id, min(b) as component from reach group by a) using (doc_id)
"""
