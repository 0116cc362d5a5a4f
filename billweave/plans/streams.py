"""Streaming queries: each runs the landed files once and returns the table it wrote."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import relevance as rel
from ..session import run_dir
from ..streaming import incremental as inc
from . import views as v
from .messages import _FLAGS
from .registry import query

_EVENTS_SQL = v.AUDIT_SQL


def event_stream(spark, folder, pattern="events.parquet", files_per_batch=1000):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    stream = inc.landed_stream(spark, folder, pattern, schema, files_per_batch)
    action = F.element_at(
        F.create_map(*[F.lit(x) for kv in v.ACTIONS.items() for x in kv]), F.col("event_type")
    )
    return stream.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("t"), F.col("user_id") % 10).alias("tenant_id"),
        action.alias("action"),
        F.col("user_id").cast("string").alias("entity_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


@query(
    "stream_action_counts",
    f"with {_EVENTS_SQL} select date_trunc('hour', created_at) as window_start, action, count(*) as events from audit group by 1, 2",
)
def stream_action_counts(spark, folder):
    out = run_dir(spark, "action-counts")
    counts = inc.action_counts(event_stream(spark, folder))
    keys = ("window_start", "action")
    run = inc.run_available(counts, inc.write_latest(f"{out}/t", keys), f"{out}/c", "update")
    return inc.latest_rows(spark, f"{out}/t", run, keys, "window_start timestamp, action string, events long")


@query(
    "stream_latest_actions",
    f"""with {_EVENTS_SQL}, r as (select *, row_number() over (partition by tenant_id, entity_id order by created_at desc, id desc) as rn from audit)
    select tenant_id, entity_id, action from r where rn = 1""",
)
def stream_latest_actions(spark, folder):
    """The events land in ten files, a batch each."""
    out = run_dir(spark, "latest-actions")
    events = v.table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    events.repartitionByRange(10, "ts", "event_id").write.parquet(f"{out}/landed")
    latest = inc.latest_actions(event_stream(spark, f"{out}/landed", "*.parquet", 1))
    keys = ("tenant_id", "entity_id")
    run = inc.run_available(latest, inc.write_latest(f"{out}/t", keys), f"{out}/c", "update")
    return inc.latest_rows(spark, f"{out}/t", run, keys, "tenant_id string, entity_id string, action string")


@query(
    "stream_job_intervals",
    f"""with {_EVENTS_SQL}, f as (select * from audit where action in ('collection.succeeded', 'collection.failed')),
      r as (select s.tenant_id, s.entity_id, s.id as started_id, f.id as finished_id, f.action, epoch_us(f.created_at) - epoch_us(s.created_at) as micros,
        row_number() over (partition by s.id order by f.created_at, f.id) as rn
      from audit s left join f on s.tenant_id = f.tenant_id and s.entity_id = f.entity_id and f.created_at >= s.created_at and f.created_at <= s.created_at + interval 1 hour
      where s.action = 'collection.started')
    select tenant_id, entity_id, started_id, finished_id, action, micros from r where rn = 1""",
)
def stream_job_intervals(spark, folder):
    """All starts, also those of the last day: a tick of a later day closes the books."""
    out = run_dir(spark, "job-intervals")
    newest = v.table(spark, folder, "events").agg(F.max("ts")).head()[0]
    if newest is not None:
        inc.land_tick(spark, f"{out}/ticks", newest + datetime.timedelta(days=3))
    else:
        inc.land_tick(spark, f"{out}/ticks", datetime.datetime(2000, 1, 1))
    events = inc.with_ticks(event_stream(spark, folder), inc.tick_stream(spark, f"{out}/ticks"), "created_at")
    found = inc.nearest_finish(events, "collection.started", ("collection.succeeded", "collection.failed"))
    inc.run_available(found, inc.write_batches(f"{out}/t"), f"{out}/c")
    schema = "tenant_id string, entity_id string, started_id string, finished_id string, action string, micros long"
    return inc.whole_table(spark, f"{out}/t", schema)


@query(
    "stream_consolidation",
    f"with {v.DOCS_SQL} select sha256(content) as digest, min(path) as path from docs group by 1",
)
def stream_consolidation(spark, folder):
    out = run_dir(spark, "consolidation")
    schema = v.table(spark, folder, "documents").schema
    docs = v.document_columns(inc.landed_stream(spark, folder, "documents.parquet", schema))
    hashed = docs.select("path", tx.content_hash(F.col("content")).alias("digest"))
    inc.consolidate_stream(hashed, f"{out}/t", f"{out}/c")
    return inc.whole_table(spark, f"{out}/t", "digest string, path string")


@query(
    "stream_message_poll",
    f"""with {_FLAGS}, first as (select message_id, 1 as attempt, case when not (has_attachments or (not neg and (pos or muni))) then 'skipped' when neg and not (pos or muni) then 'negative_context'
      when contains(attachment_name, 'scan') then 'attach_download_fail' else 'accepted' end as reason from f)
    select * from first union all select message_id, 2, 'accepted' from first where reason = 'attach_download_fail'""",
)
def stream_message_poll(spark, folder):
    """Two runs; in the second, without new mail, the downloads that failed come up again."""
    out = run_dir(spark, "message-poll")
    schema = v.table(spark, folder, "conversations").schema

    def decide(rows):
        gated = rel.gate_messages(rows, v.TERMS)
        failed = (F.col("gate") == "accepted") & tx.has(F.col("attachment_name"), "scan") & (F.col("attempt") == 1)
        reason = F.when(failed, "attach_download_fail").otherwise(F.col("gate"))
        return gated.select("message_id", "attempt", reason.alias("reason"))

    start = datetime.datetime(2025, 1, 1, tzinfo=datetime.timezone.utc)
    for hours in (0, 2):
        stream = v.message_columns(inc.landed_stream(spark, folder, "conversations.parquet", schema))
        inc.poll_messages(
            stream, decide, f"{out}/p", f"{out}/t", f"{out}/c", "received",
            now=start + datetime.timedelta(hours=hours), wait=datetime.timedelta(hours=1),
        )
    return inc.whole_table(spark, f"{out}/t", "message_id string, attempt int, reason string")
