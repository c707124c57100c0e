"""Queries over the streams, drained to a folder, and over their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.session import work_folder
from lumenfield.sources import files, manifest
from lumenfield.sources.derive import TABLES
from lumenfield.sources.dialect import SparkText
from lumenfield.streaming import flows, twins
from lumenfield.plans.checks import s6
from lumenfield.plans.sky import _HA, _METRICS, _QD
from lumenfield.plans.registry import check, query, r6

c = F.col
#: the batch forms look at a whole history, so the streams they are compared with remember as long
MONTHS = 90 * flows.DAY_MS


def _live(t, name, order="event_id"):
    """A derived table over the event table, replayed in several micro-batches in event order."""
    build, needs = TABLES[name]
    source = t.given(needs[0])
    stream = flows.replay(source, order if order in source.columns else source.columns[0], work_folder(t.spark, f"replay-{name}"))
    return t.spark.sql(build(SparkText()), **{needs[0]: stream})


def _drained(t, stream, name, mode="append", part="rows", split=None):
    folder = work_folder(t.spark, name)
    # a stream without rows has no batch, and its result is an empty table
    t.spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/{part}/batch_id=-1")
    flows.run_to_folder(stream, folder, mode, split)
    return t.spark.read.parquet(f"{folder}/{part}")


def _stamp(x):
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")


_PROG = """ends as (select job_id, min(ts) as first, min(ts) + interval 2 day as cap, arg_min(status, (ts, poll_id)) filter (status in ('succeeded', 'failed', 'cancelled')) as est,
   min(ts) filter (status in ('succeeded', 'failed', 'cancelled')) as ets from progress group by 1),
 live as (select p.job_id, ts, poll_id, status, progress, lag(status || round(progress, 4)) over (partition by p.job_id order by ts, poll_id) as was
   from progress p join ends e on e.job_id = p.job_id where ts <= cap and (ets is null or ts <= ets))"""
_PROG_SQL = check("progress", """select job_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as at, 'progress' as event, status, round(progress, 4) as progress from live where was is null or was <> status || round(progress, 4)
 union all select job_id, strftime(case when ets <= cap then ets else cap end, '%Y-%m-%d %H:%M:%S.%f'), case when ets <= cap then 'done' else 'timeout' end, case when ets <= cap then est end, null from ends""", _PROG)


@query("progress_changes", "T3", _PROG_SQL)
def progress_changes(t):
    d = twins.progress_changes(t.progress, 2 * 86400)
    return d.select("job_id", _stamp("ts").alias("at"), "event", "status", "progress")


@query("progress_feed_stream", "T3", _PROG_SQL)
def progress_feed_stream(t):
    d = _drained(t, flows.progress_stream(_live(t, "progress"), 2 * 86400, MONTHS), "progress")
    return d.select("job_id", _stamp("ts").alias("at"), "event", "status", "progress")


_STATS = check("activity", f"""select strftime(time_bucket(interval 5 minute, ts), '%Y-%m-%d %H:%M') as start, count(*) as n, count(*) filter (event_type = 'view') as views, {s6('sum(value)')} as value from activity group by 1""")


@query("stats_windows", "T4", _STATS)
def stats_windows(t):
    d = twins.window_stats(t.activity)
    return d.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "views", r6("value").alias("value"))


@query("stats_windows_stream", "T4", check("activity", f"""select strftime(time_bucket(interval 5 minute, ts), '%Y-%m-%d %H:%M') as start, count(*) as n, count(*) filter (event_type = 'view') as views, {s6('sum(value)')} as value
 from activity group by time_bucket(interval 5 minute, ts) having time_bucket(interval 5 minute, ts) + interval 15 minute <= (select max(ts) from activity)"""))
def stats_windows_stream(t):
    d = _drained(t, flows.window_stream(_live(t, "activity")), "stats")
    return d.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "views", r6("value").alias("value"))


_RATE = check("activity jobs", """select event_id, user_id, case when act >= 5 then 'active_limit' when not ok then 'daily_limit' else 'ok' end as decision,
 case when act >= 5 then 60 when not ok then 3600 end::bigint as retry_after from walk""", """req as materialized (select event_id, user_id, epoch_us(ts) as t, coalesce(act, 0) as act, row_number() over (partition by user_id order by ts, event_id) as n
  from (select *, user_id as u from activity where event_type in ('purchase', 'signup', 'view')) left join (select requested_by as u, count(*) as act from jobs where status in ('queued', 'running') group by 1) using (u)),
 walk as (select event_id, user_id, act, n, true as ok, [t] as kept from req where n = 1
  union all select event_id, user_id, act, n, len(recent) < 20, case when len(recent) < 20 then list_append(recent, t) else recent end
   from (select q.*, list_filter(w.kept, lambda k: k > q.t - 86400000000) as recent from walk w join req q on q.user_id = w.user_id and q.n = w.n + 1))""")
_ASKED = "event_type in ('purchase', 'signup', 'view')"


@query("rate_limit_decisions", "T5", _RATE)
def rate_limit_decisions(t):
    d = twins.rate_decisions(t.activity.where(_ASKED), t.jobs)
    return d.withColumn("retry_after", c("retry_after").cast("bigint"))


@query("rate_limit_stream", "T5", _RATE)
def rate_limit_stream(t):
    asked = _live(t, "activity").where(_ASKED).select("event_id", "user_id", "ts")
    d = _drained(t, flows.rate_limit_stream(asked, t.jobs), "rate")
    return d.select("event_id", "user_id", "decision", c("retry_after").cast("bigint").alias("retry_after"))


_COUNT = check("activity", "select photo_id, count(*) filter (event_type = 'view') as views, count(*) filter (event_type = 'click') as downloads from activity group by 1")


@query("view_download_counters", "T6", _COUNT)
def view_download_counters(t):
    return twins.counters(t.activity)


@query("view_download_counters_stream", "T6", _COUNT)
def view_download_counters_stream(t):
    d = _drained(t, flows.counter_stream(_live(t, "activity")), "counters", "update")
    last = F.max_by(F.struct("views", "downloads"), "batch_id")
    return d.groupBy("photo_id").agg(last.alias("v")).select("photo_id", "v.views", "v.downloads")


@query("licence_locks", "T7", check("photos activity", """select photo_id, strftime(coalesce(case when photo_id % 2 = 0 then created_at end, ts), '%Y-%m-%d %H:%M:%S.%f') as locked_at
 from photos left join (select a.photo_id, min(ts) as ts from activity a join photos p using (photo_id) where event_type = 'click' and user_id <> owner_id group by 1) using (photo_id)"""))
def licence_locks(t):
    locked = F.when(c("photo_id") % 2 == 0, c("created_at"))
    d = twins.licence_locks(t.photos, t.activity.where("event_type = 'click'"), locked)
    return d.select("photo_id", _stamp("license_locked_at").alias("locked_at"))


@query("idempotent_requests", "T8 J20", check("activity", """select event_id, effective_id, event_id <> effective_id as is_replay from (select event_id, first_value(event_id) over (partition by user_id, k order by ts, event_id) as effective_id from activity where event_type = 'purchase')"""))
def idempotent_requests(t):
    d = twins.idempotent(t.activity.where("event_type = 'purchase'"))
    return d.select("event_id", "effective_id", "is_replay")


@query("first_requests_stream", "T8", check("activity", "select distinct user_id, k from activity where event_type = 'purchase'"))
def first_requests_stream(t):
    d = flows.first_request_stream(_live(t, "activity").where("event_type = 'purchase'"))
    return _drained(t, d, "requests").select("user_id", "k")


_STORE = check("storage_changes", """select change_id, owner_id, (p - least(0, min(p) over (partition by owner_id order by ts, change_id)))::bigint as used_bytes from (select *, sum(d) over (partition by owner_id order by ts, change_id) as p from (select *,
 case when change = 'insert' and not was_deleted then coalesce(bytes, 0) when change in ('delete', 'soft_delete') and not was_deleted then -coalesce(bytes, 0) when change = 'restore' and was_deleted then coalesce(bytes, 0) else 0 end as d from storage_changes))""")


@query("running_storage", "T9", _STORE)
def running_storage(t):
    return twins.running_storage(t.storage_changes)


@query("running_storage_stream", "T9", _STORE)
def running_storage_stream(t):
    return _drained(t, flows.storage_stream(_live(t, "storage_changes")), "storage").select("change_id", "owner_id", "used_bytes")


_DEAD = check("activity", """select photo_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as dead_at from (select *, row_number() over (partition by photo_id order by ts, event_id) as n from activity where event_type in ('error', 'view')) where n = 5""")


@query("dead_letters", "T10", _DEAD)
def dead_letters(t):
    d = twins.dead_letters(t.activity.where("event_type in ('error', 'view')"))
    return d.select("photo_id", _stamp("dead_at").alias("dead_at"))


@query("dead_letters_stream", "T10", _DEAD)
def dead_letters_stream(t):
    a = _live(t, "activity").where("event_type in ('error', 'view')").select("photo_id", "event_id", "ts")
    return _drained(t, flows.dead_letter_stream(a, MONTHS), "dead").select("photo_id", _stamp("dead_at").alias("dead_at"))


_STATE = "case when status = 'running' and poll_id % 6 = 0 then 'cancelled' else status end as status"


@query("job_states", "T11", check("progress", f"""select job_id, coalesce(arg_min(status, (ts, poll_id)) filter (status in ('succeeded', 'failed', 'cancelled')), case when bool_or(status = 'running') then 'running' else 'queued' end) as status, count(*) as n
 from (select job_id, ts, poll_id, {_STATE} from progress) group by 1"""))
def job_states(t):
    return twins.job_states(t.progress.selectExpr("job_id", "ts", "poll_id", _STATE)).select("job_id", "status", "n")


@query("job_states_stream", "T11", check("progress", f"""select job_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as at, status from (select *, row_number() over (partition by job_id, status = 'running' order by ts, poll_id) as n,
  min((ts, poll_id)) filter (status in ('succeeded', 'failed', 'cancelled')) over (partition by job_id) as e from (select job_id, ts, poll_id, {_STATE} from progress) where status <> 'queued')
 where n = 1 and (e is null or (ts, poll_id) <= e)"""))
def job_states_stream(t):
    p = _live(t, "progress").selectExpr("job_id", "ts", "poll_id", _STATE)
    return _drained(t, flows.job_state_stream(p, MONTHS, MONTHS), "states").select("job_id", _stamp("ts").alias("at"), "status")


@query("ingest_stream", "T1", check("photos analysis activity", f"""select joined.photo_id, case when a.photo_id is not null then 'ready' else 'failed' end as status, {s6(_QD[0])} as quality
 from joined left join (select photo_id as aid, photo_id from analysis) a on a.aid = joined.photo_id where status <> 'ready' and joined.photo_id in (select photo_id from activity)""", _HA + ", " + _METRICS))
def ingest_stream(t):
    m = _live(t, "activity").select("photo_id", c("ts").alias("enqueued_at"))
    d = flows.ingest_stream(m, t.photos.drop("created_at"), t.analysis)
    return _drained(t, d, "ingest").select("photo_id", "status", r6("d_quality_score").alias("quality"))


# --- uploads, folders, manifests ---------------------------------------------------------------------
_MAGIC = [m for m, _ in files.MAGIC] + ["000000186674797063723320", "00"]


def _uploads(pages):
    i = (c("page_id") % (len(_MAGIC) + 1)).cast("int")
    head = F.get(F.array(*[F.lit(m) for m in _MAGIC]), i)
    body = F.concat(F.unhex(F.coalesce(head, F.lit(""))), F.encode("html", "utf-8"))
    key = F.when(c("page_id") % 5 == 0, c("url")).otherwise(F.concat(F.lit("staging/u/"), c("page_id").cast("string")))
    return pages.select("page_id", key.alias("key"), F.when(c("page_id") % 17 == 0, F.lit(b"")).otherwise(body).alias("content"))


_MIME = "case " + " ".join(f"when head like '{m}%' then '{mime}'" for m, mime in files.MAGIC) + " when head[9:16] = '66747970' and length(head) >= 24 then 'image/x-canon-cr3' end"
_UP = f"""up as (select page_id, case when page_id % 5 = 0 then url else 'staging/u/' || page_id end as key,
   case when page_id % 17 = 0 then '' else coalesce([{', '.join(f"'{m}'" for m in _MAGIC)}][page_id % {len(_MAGIC) + 1} + 1], '') || hex(html) end as body from pages),
 ver as (select *, {_MIME} as mime0, case when body = '' then 'empty' when length(body) // 2 > 6000 then 'too_large' when key not like 'staging/%/%' then 'bad_key' when ({_MIME}) is null then 'unknown_format' end as reason from (select *, left(body, 60) as head from up))"""
_UPSQL = check("", "select page_id, reason, case when reason is null then mime0 end as mime, length(body) // 2 as size_bytes from ver", _UP)


@query("upload_verification", "S5", _UPSQL)
def upload_verification(t):
    d = files.verify_uploads(_uploads(t.given("pages")), 6000)
    return d.select("page_id", "reason", "mime", c("size_bytes").cast("bigint").alias("size_bytes"))


@query("upload_quarantine_stream", "T2", check("", "select page_id, reason from ver where reason is not null", _UP))
def upload_quarantine_stream(t):
    s = flows.upload_stream(_uploads(flows.file_stream(t.spark, t.folder, "pages")), 6000)
    return _drained(t, s, "uploads", part="quarantine", split=flows.route_uploads).select("page_id", "reason")


_EXT = ("CR2", "nef", "fits", "FZ", "tif", "jpg", "png", "txt", "xisf", "dng")
_EXTSQL = "[" + ", ".join(f"'{e}'" for e in _EXT) + f"][photo_id % {len(_EXT)} + 1]"
_CLASS = "case " + " ".join("when lower(ext) in (" + ", ".join(f"'{e}'" for e in exts) + f") then '{n}'" for n, exts in files.FORMATS.items()) + " end"


@query("folder_scan", "S4", check("photos", f"""select path, fmt as format, photo_key from (select *, {_CLASS} as fmt from (select *, 'frames/' || owner_id || '/' || case when photo_id % 11 = 0 then '.' else '' end || 'p' || photo_id || '.' || ext as path,
 case when photo_id % 11 = 0 then '.' else '' end || 'p' || photo_id as photo_key from (select *, {_EXTSQL} as ext from photos))) where fmt is not null and photo_id % 11 <> 0"""))
def folder_scan(t):
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (c("photo_id") % len(_EXT) + 1).cast("int"))
    hidden = F.when(c("photo_id") % 11 == 0, ".").otherwise("")
    path = F.concat(F.lit("frames/"), c("owner_id"), F.lit("/"), hidden, F.lit("p"), c("photo_id"), F.lit("."), ext)
    return files.supported(t.photos.select(path.alias("path")))


@query("manifest_entries", "S3", check("photos", """select case when photo_id % 3 = 0 then 'p' || photo_id else photo_id::varchar end as photo_id, license from photos
 where allow_derivatives_in_stacks and license not in ('ARR', 'CC-BY-ND-4.0', 'CC-BY-NC-ND-4.0')"""))
def manifest_entries(t):
    """Manifests of up to a thousand entries are written as JSON files, read back and split."""
    k = c("photo_id")
    raw = t.photos.select(F.concat(F.lit("frames/p"), k, F.lit(".fits")).alias("path"), F.when(k % 3 != 0, k.cast("string")).alias("photo_id"), "license", "allow_derivatives_in_stacks", F.floor(k / 1000).alias("part"))
    text = raw.groupBy("part").agg(F.to_json(F.collect_list(F.struct("path", "photo_id", "license", "allow_derivatives_in_stacks"))).alias("value"))
    folder = work_folder(t.spark, "manifests")
    text.write.partitionBy("part").text(folder)
    kept, _ = manifest.split_manifest(manifest.read_manifest(t.spark, folder), strict=False)
    return kept.select("photo_id", "license")
