"""Batch forms of the streams: the same results over a finished table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.operators import scan
from lumenfield.operators.jobs import MAX_ACTIVE, MAX_PER_DAY, TERMINAL
from lumenfield.operators.skew import salted_lookup
from lumenfield.operators.validate import keepers

MAX_RECEIVES = 5


def progress_changes(polls: DataFrame, cap_seconds: int) -> DataFrame:
    """Change feed per job: ``progress`` on a new (status, progress), then ``done`` or ``timeout``.

    A job is followed from its first poll until its first terminal state or the time cap.
    """
    ends = polls.groupBy("job_id").agg(
        F.min("ts").alias("_first"),
        F.min(F.when(F.col("status").isin(*TERMINAL), F.struct("ts", "poll_id", "status"))).alias("_end"),
    )
    cap = F.col("_first") + F.make_dt_interval(secs=F.lit(cap_seconds))
    ends = ends.withColumn("_cap", cap)
    ends = ends.withColumn("_end", F.when(F.col("_end.ts") <= F.col("_cap"), F.col("_end")))
    here = F.struct("ts", "poll_id")
    live = polls.join(ends, "job_id").where(
        (F.col("ts") <= F.col("_cap"))
        & (F.col("_end").isNull() | (here <= F.struct("_end.ts", "_end.poll_id")))
    )
    signature = F.struct("status", F.round("progress", 4).alias("progress"))
    live = scan.previous(live, ["job_id"], ["ts", "poll_id"], scan.time_chunk("ts"), signature, "_was")
    changed = F.col("_was").isNull() | (F.col("_was") != signature)
    feed = live.where(changed).select(
        "job_id", "ts", F.lit("progress").alias("event"), "status", F.round("progress", 4).alias("progress")
    )
    tail = ends.select(
        "job_id",
        F.coalesce("_end.ts", "_cap").alias("ts"),
        F.when(F.col("_end").isNotNull(), "done").otherwise("timeout").alias("event"),
        F.col("_end.status").alias("status"),
        F.lit(None).cast("double").alias("progress"),
    )
    return feed.unionByName(tail)


def window_stats(activity: DataFrame, every: str = "5 minutes") -> DataFrame:
    return activity.groupBy(F.window("ts", every).alias("w")).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("views"),
        F.sum("value").alias("value"),
    )


DAY_US = 86_400_000_000


def admissions(times: np.ndarray, kept: list[int]) -> np.ndarray:
    """Which requests of one user, in time order, are admitted; ``kept`` holds the admitted times of the last day.

    Only admitted requests count against the limit. ``kept`` never grows beyond the limit; a full day jumps
    straight to the request at which its oldest entry has expired.
    """
    ok, i = np.zeros(len(times), bool), 0
    while i < len(times):
        while kept and kept[0] <= times[i] - DAY_US:
            kept.pop(0)
        if len(kept) < MAX_PER_DAY:
            ok[i] = True
            kept.append(int(times[i]))
            i += 1
        else:
            i = int(np.searchsorted(times, kept[0] + DAY_US))
    return ok


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("queued", "running")).groupBy(
        F.col("requested_by").alias("user_id")
    ).agg(F.count("*").alias("n_active"))


def with_reasons(d: DataFrame) -> DataFrame:
    """Decision and seconds to wait, from ``n_active`` and ``admitted``; the active limit is named first."""
    why = F.when(F.col("n_active") >= MAX_ACTIVE, "active_limit").when(~F.col("admitted"), "daily_limit")
    wait = F.when(why == "active_limit", 60).when(why == "daily_limit", 3600)
    return d.select("event_id", "user_id", F.coalesce(why, F.lit("ok")).alias("decision"), wait.alias("retry_after"))


def rate_decisions(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Admit or refuse each request by the user's active jobs and admitted requests in the last 24 hours.

    Each decision depends on earlier ones, so a user's requests pass in order through one task; what is held
    is one Arrow batch and the admitted times of a day, however many requests the user sends. Users at the
    active limit are settled without that.
    """
    d = salted_lookup(requests.select("event_id", "user_id", "ts"), active_jobs(jobs), ["user_id"], "event_id").fillna(0, ["n_active"])
    full = d.where(F.col("n_active") >= MAX_ACTIVE).withColumn("admitted", F.lit(False)).drop("ts")

    def run(batches):
        user, kept = None, []
        for batch in batches:
            who, t = batch.column("user_id").to_numpy(zero_copy_only=False), batch.column("t").to_numpy(zero_copy_only=False)
            ok = np.zeros(len(who), bool)
            cuts = [0, *(np.flatnonzero(who[1:] != who[:-1]) + 1).tolist(), len(who)] if len(who) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if who[a] != user:
                    user, kept = who[a], []
                ok[a:b] = admissions(t[a:b], kept)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("event_id", "user_id", "n_active")], pa.array(ok)], ["event_id", "user_id", "n_active", "admitted"])

    rest = d.where(F.col("n_active") < MAX_ACTIVE).select("event_id", "user_id", "n_active", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    rest = rest.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id")
    open_ = rest.mapInArrow(run, "event_id bigint, user_id bigint, n_active bigint, admitted boolean")
    return with_reasons(full.select(*open_.columns).unionByName(open_))


def counters(activity: DataFrame) -> DataFrame:
    return activity.groupBy("photo_id").agg(
        F.count_if(F.col("event_type") == "view").alias("views"),
        F.count_if(F.col("event_type") == "click").alias("downloads"),
    )


def licence_locks(photos: DataFrame, downloads: DataFrame, locked: Column) -> DataFrame:
    """Lock time per photo: the existing one, else the first download by someone else."""
    owners = photos.select("photo_id", "owner_id", locked.alias("locked_at"))
    # first download per (photo, viewer) is found before the join, so a popular photo stays small
    first = downloads.groupBy("photo_id", "user_id").agg(F.min("ts").alias("ts"))
    third = first.join(owners, "photo_id").where(F.col("user_id") != F.col("owner_id"))
    third = third.groupBy("photo_id").agg(F.min("ts").alias("first_download"))
    d = owners.join(third, "photo_id", "left")
    return d.select("photo_id", F.coalesce("locked_at", "first_download").alias("license_locked_at"))


def idempotent(requests: DataFrame, user: str = "user_id", key: str = "k") -> DataFrame:
    """First request per (user, key) wins; every replay is mapped to it."""
    first = keepers(requests, [user, key], ["ts"], "event_id").drop("copies")
    d = salted_lookup(requests, first, [user, key], "event_id")
    return d.withColumnRenamed("keeper_id", "effective_id").withColumn(
        "is_replay", F.col("event_id") != F.col("effective_id")
    )


def signed_bytes() -> Column:
    """Storage change of one row-level event."""
    b, c = F.coalesce("bytes", F.lit(0)), F.col("change")
    live = ~F.col("was_deleted")
    return (
        F.when((c == "insert") & live, b)
        .when(c.isin("delete", "soft_delete") & live, -b)
        .when((c == "restore") & ~live, b)
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def running_storage(changes: DataFrame) -> DataFrame:
    """Storage of the owner after each change, never below zero.

    A total floored at zero equals the prefix sum minus its lowest value so far (when negative).
    """
    d = changes.withColumn("_d", signed_bytes())
    d = scan.running(d, ["owner_id"], ["ts", "change_id"], scan.time_chunk("ts"), "_d")
    used = F.col("running") - F.least(F.lit(0), F.col("running_low"))
    return d.select("change_id", "owner_id", used.alias("used_bytes"))


def dead_letters(receives: DataFrame, message: str = "photo_id") -> DataFrame:
    """Messages received at least five times without success, with the time of the fifth receive."""
    from lumenfield.operators.selection import rank_within

    fifth = rank_within(receives, [message], [F.asc("ts"), F.asc("event_id")], MAX_RECEIVES, "event_id")
    return fifth.where(F.col("rank") == MAX_RECEIVES).select(message, F.col("ts").alias("dead_at"))


def job_states(events: DataFrame) -> DataFrame:
    """Final state per job when terminal states absorb: the first terminal event decides."""
    end = F.min(F.when(F.col("status").isin(*TERMINAL), F.struct("ts", "poll_id", "status")))
    g = events.groupBy("job_id").agg(
        end.alias("e"), F.bool_or(F.col("status") == "running").alias("ran"), F.count("*").alias("n")
    )
    state = F.coalesce(F.col("e.status"), F.when(F.col("ran"), "running").otherwise("queued"))
    return g.select("job_id", state.alias("status"), F.col("e.ts").alias("finished_at"), "n")
