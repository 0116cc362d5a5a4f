"""Billing and control-plane queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import billing, control
from . import views as v
from .registry import query

_CHARGE = "event_type = 'purchase'"


def charges(spark, folder):
    return billing.charges_of(v.charge_events(spark, folder), "purchase")


@query(
    "charge_window",
    "select event_id, cast(floor(epoch(ts)) as bigint) as event_epoch from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20'",
)
def charge_window(spark, folder):
    events = v.charge_events(spark, folder)
    return billing.events_between(events, "2024-01-05", "2024-01-20").select("event_id", "event_epoch")


@query(
    "charges_enriched",
    f"""select event_id, ts as event_time, cast(json_extract(props, '$.k') as double) as amount_minor, cast(round(cast(json_extract(props, '$.k') as decimal(18,4)) / 100, 2) as double) as amount,
      json_extract_string(props, '$.k') as transaction_id, 'Transaction #' || json_extract_string(props, '$.k') || '.pdf' as suggested_filename from events where {_CHARGE}""",
)
def charges_enriched(spark, folder):
    enriched = billing.enrich_charges(charges(spark, folder), "$.k", "$.k", "$.currency")
    return billing.receipt_candidates(enriched).select(
        "event_id", "event_time", "amount_minor", "amount", "transaction_id", "suggested_filename"
    )


@query(
    "charge_odd_payloads",
    f"""select event_id, case event_id % 4 when 0 then cast(round(cast(json_extract(props, '$.k') as decimal(18,4)) / 100, 2) as double) end as amount,
      case when event_id % 4 in (0, 1) then 'EUR' end as currency from events where {_CHARGE}""",
)
def charge_odd_payloads(spark, folder):
    """Numeric text is not an amount; broken or bare text is not an object."""
    kind = F.col("event_id") % 4
    k = F.regexp_extract("extra_data", r"(\d+)", 1)
    odd = (
        F.when(kind == 0, F.concat(F.lit('  {"new_value": '), k, F.lit(', "currency": "EUR"} ')))
        .when(kind == 1, F.concat(F.lit('{"new_value": "'), k, F.lit('", "currency": "EUR"}')))
        .when(kind == 2, F.concat(F.lit('{"new_value": '), k, F.lit(', "currency": }')))
        .otherwise(k)
    )
    rows = charges(spark, folder).withColumn("extra_data", odd)
    return billing.enrich_charges(rows).select("event_id", "amount", "currency")


@query(
    "charge_receipt_count",
    f"select count(*) as charges, count(*) filter (where cast(json_extract(props, '$.k') as bigint) % 2 = 0) as with_transaction from events where {_CHARGE}",
)
def charge_receipt_count(spark, folder):
    k = F.regexp_extract("extra_data", r"(\d+)", 1)
    tagged = F.when(
        k.cast("bigint") % 2 == 0, F.concat(F.lit('{"transaction_id":"'), k, F.lit('"}'))
    ).otherwise('{"transaction_id":""}')
    rows = charges(spark, folder).withColumn("extra_data", tagged)
    return billing.receipt_count(billing.enrich_charges(rows))


@query(
    "charge_csv_rows",
    f"""select strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as event_time, 'purchase' as event_type, cast(user_id as varchar) as actor_name,
      case when event_id % 2 = 0 then replace(props, ' ', '') else '"k=' || event_id || '"' end as extra_data_json, null::varchar as object_name from events where {_CHARGE}""",
)
def charge_csv_rows(spark, folder):
    rows = charges(spark, folder).withColumn(
        "extra_data",
        F.when(F.col("event_id") % 2 == 0, F.col("extra_data")).otherwise(
            F.concat(F.lit("k="), F.col("event_id").cast("string"))
        ),
    ).withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return billing.charge_cells(rows).select(
        "event_time", "event_type", "actor_name", "extra_data_json", "object_name"
    )


@query(
    "business_invoices",
    """select cast(o_orderkey as varchar) as id, strftime(o_orderdate, '%Y-%m-%d') as invoice_date, o_totalprice as amount_due, 'USD' as currency, o_orderpriority as type
    from orders where o_orderdate >= date '1996-01-01' and o_orderdate < date '1997-01-01'""",
)
def business_invoices(spark, folder):
    """Listing pages of business invoices, unrolled and cut to a half-open window."""
    o = v.table(spark, folder, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    item = F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderkey").cast("string").alias("invoice_id"),
        day.alias("invoice_date"),
        day.alias("billing_period_start"),
        day.alias("billing_period_end"),
        F.col("o_totalprice").alias("amount_due"),
        F.lit("USD").alias("currency"),
        F.col("o_orderstatus").alias("advertiser_name"),
        F.col("o_orderpriority").alias("type"),
        F.lit(None).cast("string").alias("download_uri"),
    )
    pages = o.select(F.array(item).alias("data"))
    listed = billing.business_invoices(billing.union_pages(pages), "1996-01-01", "1997-01-01")
    return listed.select("id", "invoice_date", "amount_due", "currency", "type")


@query(
    "account_ids",
    "select c_custkey, case when c_custkey % 2 = 0 then 'act_' || c_custkey else 'act_x' || c_custkey end as account from customer",
)
def account_ids(spark, folder):
    raw = F.when(
        F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.col("c_custkey").cast("string"))
    ).otherwise(F.concat(F.lit("act_x"), F.col("c_custkey").cast("string"), F.lit(" ")))
    return v.table(spark, folder, "customer").select(
        "c_custkey", billing.ad_account(raw).alias("account")
    )


@query(
    "lenient_timestamps",
    """select event_id, case event_id % 4 when 0 then cast(cast(ts as date) as timestamp) when 1 then date_trunc('second', ts)
      when 2 then date_trunc('second', ts) - interval 3 hour end as parsed, event_id % 4 <> 3 as valid from events""",
)
def lenient_timestamps(spark, folder):
    e = v.table(spark, folder, "events")
    kind = F.col("event_id") % 4
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    written = (
        F.when(kind == 0, F.date_format("ts", " yyyy-MM-dd "))
        .when(kind == 1, F.concat(stamp, F.lit("Z")))
        .when(kind == 2, F.concat(stamp, F.lit("+03:00")))
        .otherwise("soon")
    )
    parsed = dates.lenient_timestamp(written)
    return e.select("event_id", parsed.cast("timestamp_ntz").alias("parsed"), parsed.isNotNull().alias("valid"))


# --- control plane ----------------------------------------------------------------------


@query(
    "audit_timeline",
    f"with {v.AUDIT_SQL} select id, action, entity_id, created_at from audit where tenant_id = 't3'",
)
def audit_timeline(spark, folder):
    return control.audit_timeline(v.audit_events(spark, folder), "t3", "collection_job").select(
        "id", "action", "entity_id", "created_at"
    )


@query(
    "audit_entity_timeline",
    f"with {v.AUDIT_SQL} select id, action, created_at from audit where tenant_id = 't3' and entity_id = '23'",
)
def audit_entity_timeline(spark, folder):
    events = v.audit_events(spark, folder)
    return control.audit_timeline(events, "t3", entity_id="23").select("id", "action", "created_at")


@query(
    "latest_state",
    f"""with {v.AUDIT_SQL}, r as (select *, row_number() over (partition by tenant_id, entity_id order by created_at desc, id desc) as rn, count(*) over (partition by tenant_id, entity_id) as events from audit)
    select tenant_id, entity_type, entity_id, action, created_at, events from r where rn = 1""",
)
def latest_state(spark, folder):
    return control.latest_action(v.audit_events(spark, folder))


@query(
    "job_durations",
    f"""with {v.AUDIT_SQL} select tenant_id, entity_id, min(created_at) filter (where action = 'collection.started') as started_at,
      max(created_at) filter (where action in ('collection.succeeded', 'collection.failed')) as finished_at,
      cast(floor(epoch(max(created_at) filter (where action in ('collection.succeeded', 'collection.failed')))) - floor(epoch(min(created_at) filter (where action = 'collection.started'))) as bigint) as seconds
    from audit group by 1, 2""",
)
def job_durations(spark, folder):
    return control.job_durations(
        v.audit_events(spark, folder), "collection.started", ("collection.succeeded", "collection.failed")
    )


def job_changes(spark, folder):
    """Change log of jobs: each event is a version of the job of its user."""
    return v.audit_events(spark, folder).select(
        "tenant_id",
        F.col("entity_id").alias("id"),
        F.struct("created_at", F.col("id").alias("seq")).alias("version"),
        F.col("action").alias("status"),
        F.col("value").alias("amount"),
    )


_LATEST = "latest as (select * from (select tenant_id, entity_id as id, action as status, value as amount, created_at, row_number() over (partition by tenant_id, entity_id order by created_at desc, id desc) as rn from audit) where rn = 1)"


@query("current_jobs", f"with {v.AUDIT_SQL}, {_LATEST} select tenant_id, id, status, amount from latest")
def current_jobs(spark, folder):
    latest = control.latest_rows(job_changes(spark, folder), version="version")
    return latest.select("tenant_id", "id", "status", "amount")


_UPDATES = "u as (select 't' || (c_custkey % 10) as tenant_id, cast(c_custkey as varchar) as id, 'edited' as status, c_acctbal as amount from customer where c_acctbal >= 0)"


def updates(spark, folder):
    c = v.table(spark, folder, "customer").where("c_acctbal >= 0")
    return c.select(
        F.concat(F.lit("t"), F.col("c_custkey") % 10).alias("tenant_id"),
        F.col("c_custkey").cast("string").alias("id"),
        F.lit("edited").alias("status"),
        F.col("c_acctbal").alias("amount"),
    )


@query(
    "updated_jobs",
    f"""with {v.AUDIT_SQL}, {_LATEST}, {_UPDATES} select l.tenant_id, l.id, coalesce(u.status, l.status) as status, case when u.id is null then l.amount else u.amount end as amount
    from latest l left join u on l.tenant_id = u.tenant_id and l.id = u.id""",
)
def updated_jobs(spark, folder):
    return control.apply_updates(current_jobs(spark, folder), updates(spark, folder))


@query(
    "updates_not_found",
    f"with {v.AUDIT_SQL}, {_LATEST}, {_UPDATES} select tenant_id, id from u where (tenant_id, id) not in (select tenant_id, id from latest)",
)
def updates_not_found(spark, folder):
    return control.not_found(current_jobs(spark, folder), updates(spark, folder))


@query(
    "tenant_jobs",
    f"with {v.AUDIT_SQL}, {_LATEST} select id, status from latest where tenant_id = 't1'",
)
def tenant_jobs(spark, folder):
    jobs = control.latest_rows(job_changes(spark, folder), version="version")
    return control.tenant_list(jobs, "t1", "version").select("id", "status")


@query(
    "tenant_job",
    f"with {v.AUDIT_SQL}, {_LATEST} select id, status, amount from latest where tenant_id = 't1' and id = '21'",
)
def tenant_job(spark, folder):
    return control.tenant_get(current_jobs(spark, folder), "t1", "21").select("id", "status", "amount")


@query(
    "job_outcomes",
    """select event_id, case when event_type = 'purchase' then 'succeeded' else 'failed' end as status,
      case when event_type = 'purchase' then '' else 'collection summary status=' || event_type end as error from events""",
)
def job_outcomes(spark, folder):
    e = v.table(spark, folder, "events")
    status = F.when(F.col("event_type") == "purchase", " success ").otherwise(F.col("event_type"))
    return e.select("event_id", control.job_outcome(status).alias("o")).select("event_id", "o.*")


def retried_orders(spark, folder):
    """Orders as jobs; every third one retries the order a seventh of its number."""
    key = F.col("o_orderkey")
    return v.table(spark, folder, "orders").select(
        key.cast("string").alias("id"),
        F.when((key % 3 == 0) & (key > 0), F.floor(key / 7).cast("string")).otherwise("").alias("retry_of"),
    )


@query(
    "retry_chains",
    """with recursive j as (select cast(o_orderkey as varchar) as id, case when o_orderkey % 3 = 0 and o_orderkey > 0 then cast(o_orderkey // 7 as varchar) else '' end as retry_of from orders),
      c as (select id, id as root_id, 0 as depth, retry_of from j union all select c.id, j.id, c.depth + 1, j.retry_of from c join j on c.retry_of = j.id)
    select id, arg_max(root_id, depth) as root_id, max(depth) as depth from c group by id""",
)
def retry_chains(spark, folder):
    return control.retry_origin(retried_orders(spark, folder))


@query(
    "retry_jobs",
    """select 'job-' || o_orderkey as id, 'queued' as status, cast(o_orderkey as varchar) as retry_of, '' as error_text, o_orderpriority as providers_json from orders where o_orderstatus = 'F'""",
)
def retry_jobs(spark, folder):
    failed = v.table(spark, folder, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.lit("failed").alias("status"),
        F.lit("").alias("retry_of"),
        F.lit("boom").alias("error_text"),
        F.col("o_orderpriority").alias("providers_json"),
    )
    return control.retry_jobs(failed, F.concat(F.lit("job-"), "id"), F.current_timestamp())


@query(
    "json_lists",
    """select event_id, 'gmail,' || event_type as providers from events""",
)
def json_lists(spark, folder):
    e = v.table(spark, folder, "events")
    rows = e.select(
        "event_id",
        F.concat(F.lit('["gmail","'), "event_type", F.lit('"]')).alias("providers"),
    )
    return control.json_lists(rows, "providers").select(
        "event_id", F.array_join("providers", ",").alias("providers")
    )
