"""Control-plane tables: tenant lists, audit timelines, change logs, job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import checkpoint
from .dedup import join_hot


def tenant_list(table: DataFrame, tenant: str, newest: str = "updated_at") -> DataFrame:
    return table.where(F.col("tenant_id") == tenant).orderBy(F.desc(newest))


def tenant_get(table: DataFrame, tenant: str, entity_id: str) -> DataFrame:
    """The row of a tenant; empty when it belongs to another tenant or does not exist."""
    return table.where((F.col("tenant_id") == tenant) & (F.col("id") == entity_id))


def audit_filter(
    events: DataFrame, tenant: str, entity_type: str = "", entity_id: str = ""
) -> DataFrame:
    """Audit events of a tenant; an empty filter value means any.  Plain predicates, so they
    reach the scan."""
    kept = events.where(F.col("tenant_id") == tenant)
    if entity_type:
        kept = kept.where(F.col("entity_type") == entity_type)
    if entity_id:
        kept = kept.where(F.col("entity_id") == entity_id)
    return kept


def audit_timeline(
    events: DataFrame, tenant: str, entity_type: str = "", entity_id: str = ""
) -> DataFrame:
    return audit_filter(events, tenant, entity_type, entity_id).orderBy(F.desc("created_at"))


def latest_rows(changes: DataFrame, keys=("tenant_id", "id"), version: str = "updated_at") -> DataFrame:
    """Current state of a change log: the newest row per key, by max() with map-side combine."""
    rest = [c for c in changes.columns if c not in keys and c != version]
    return (
        changes.groupBy(*keys)
        .agg(F.max(F.struct(version, *rest)).alias("r"))
        .select(*keys, "r.*")
        .select(*changes.columns)
    )


def apply_updates(current: DataFrame, updates: DataFrame, keys=("tenant_id", "id")) -> DataFrame:
    """Replace rows by key; updates without a current row are left out (see not_found)."""
    keys = list(keys)
    hit = updates.join(current.select(*keys), keys, "left_semi")
    untouched = current.join(updates.select(*keys), keys, "left_anti")
    return untouched.unionByName(hit.select(*current.columns))


def not_found(current: DataFrame, updates: DataFrame, keys=("tenant_id", "id")) -> DataFrame:
    keys = list(keys)
    return updates.join(current.select(*keys), keys, "left_anti").select(*keys)


def job_outcome(summary_status: Column) -> Column:
    """struct<status, error> of a finished run from its manifest status."""
    s = strip(F.coalesce(summary_status, F.lit("")))
    return F.struct(
        F.when(s == "success", "succeeded").otherwise("failed").alias("status"),
        F.when(s == "success", "")
        .otherwise(F.concat(F.lit("collection summary status="), s))
        .alias("error"),
    )


def retry_jobs(jobs: DataFrame, new_id: Column, now: Column) -> DataFrame:
    """Queued copies of jobs with cleared run fields and a link to the original."""
    cleared = {
        "id": new_id,
        "status": F.lit("queued"),
        "retry_of": F.col("id"),
        "run_summary_path": F.lit(""),
        "invoices_dir": F.lit(""),
        "error_text": F.lit(""),
        "started_at": F.lit(None).cast("timestamp"),
        "finished_at": F.lit(None).cast("timestamp"),
        "created_at": now,
        "updated_at": now,
    }
    return jobs.select(*[cleared.get(c, F.col(c)).alias(c) for c in jobs.columns])


def retry_origin(jobs: DataFrame) -> DataFrame:
    """id, root_id, depth of retry chains, by pointer doubling.

    Each round halves the remaining chain length, so as many rounds as the job count has
    binary digits reach every root; jobs that still move are on a cycle and get a NULL root
    and depth.  A job retried very often is a hot key.
    """
    rounds = jobs.count().bit_length() + 1
    hops = jobs.select(
        "id",
        F.coalesce(F.nullif("retry_of", F.lit("")), "id").alias("root"),
        F.when(F.coalesce("retry_of", F.lit("")) == "", 0).otherwise(1).alias("depth"),
    )
    for _ in range(rounds):
        above = hops.select(
            F.col("id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more")
        )
        sizes = hops.groupBy("root").agg(F.count(F.lit(1)).alias("n_rows"))
        longer = join_hot(hops, above.join(sizes, "root"), "root", "left").select(
            "id",
            F.coalesce("next", "root").alias("next_root"),
            (F.col("depth").cast("long") + F.coalesce("more", F.lit(0))).alias("depth"),
            (F.coalesce("next", "root") != F.col("root")).alias("moved"),
        )
        longer = checkpoint(longer)
        hops = longer.select("id", F.col("next_root").alias("root"), "depth")
        if longer.where("moved").isEmpty():
            return hops.select("id", F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))
    settled = ~F.col("moved")
    return longer.select(
        "id",
        F.when(settled, F.col("next_root")).alias("root_id"),
        F.when(settled, F.col("depth")).cast("int").alias("depth"),
    )


def json_lists(table: DataFrame, *columns: str) -> DataFrame:
    """JSON text columns to arrays of text."""
    out = table
    for c in columns:
        out = out.withColumn(c, F.from_json(F.col(c), "array<string>"))
    return out


def job_durations(events: DataFrame, started: str, finished: tuple) -> DataFrame:
    """First start, last finish and seconds per entity, in one aggregation."""
    begin = F.min(F.when(F.col("action") == started, F.col("created_at")))
    end = F.max(F.when(F.col("action").isin(*finished), F.col("created_at")))
    return (
        events.groupBy("tenant_id", "entity_id")
        .agg(begin.alias("started_at"), end.alias("finished_at"))
        .withColumn(
            "seconds", epoch("finished_at") - epoch("started_at")
        )
    )


def epoch(name: str) -> Column:
    return F.unix_seconds(F.col(name).cast("timestamp"))


def latest_action(events: DataFrame) -> DataFrame:
    """Newest action per entity."""
    return events.groupBy("tenant_id", "entity_type", "entity_id").agg(
        F.max_by("action", F.struct("created_at", "id")).alias("action"),
        F.max("created_at").alias("created_at"),
        F.count(F.lit(1)).alias("events"),
    )
