"""Billing charge events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.dates import checked_window, utc_epoch
from ..functions.money import to_major_units
from ..functions.text import strip

CHARGE_FIELDS = (
    "event_time",
    "date_time_in_timezone",
    "event_type",
    "translated_event_type",
    "object_type",
    "object_name",
    "actor_name",
    "application_name",
)
INVOICE_FIELDS = (
    "id",
    "invoice_id",
    "invoice_date",
    "billing_period_start",
    "billing_period_end",
    "amount_due",
    "currency",
    "advertiser_name",
    "type",
    "download_uri",
)


def events_between(events: DataFrame, start: str, end: str, ts: str = "event_time") -> DataFrame:
    """Events from UTC midnight of start up to UTC midnight of end."""
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    # the plain timestamp bounds reach the scan; the epoch form is what the service takes
    lower, upper = checked_window(start, end)
    return events.where((F.col(ts) >= lower) & (F.col(ts) < upper)).withColumn("event_epoch", at)


def window_epochs(start: str, end: str) -> tuple[Column, Column]:
    return utc_epoch(F.lit(start)), utc_epoch(F.lit(end))


def charges_of(events: DataFrame, event_type: str = R.CHARGE_EVENT_TYPE) -> DataFrame:
    return events.where(F.col("event_type") == event_type)


def business_invoices(landed: DataFrame, start: str, end: str) -> DataFrame:
    """Ten columns of the invoices dated in [start, end)."""
    day = F.col("invoice_date").cast("date")
    return landed.where(
        (day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date"))
    ).select(*INVOICE_FIELDS)


def union_pages(pages: DataFrame) -> DataFrame:
    """Listing pages(data array<struct>) to rows."""
    return pages.select(F.inline("data"))


def parse_extra(extra: Column) -> Column:
    """VARIANT of an object written as JSON text; NULL when it is not one."""
    text = strip(extra)
    wrapped = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))
    return F.when(wrapped, F.try_parse_json(text))


def enrich_charges(
    charges: DataFrame,
    transaction_path: str = "$.transaction_id",
    amount_path: str = "$.new_value",
    currency_path: str = "$.currency",
) -> DataFrame:
    """Adds transaction_id, amount_minor, amount and currency from extra_data.

    Only JSON numbers are amounts; numeric text is not.
    """
    parsed = charges.withColumn("_v", parse_extra(F.col("extra_data")))
    value = F.try_variant_get("_v", amount_path, "variant")
    kind = F.schema_of_variant(value)
    number = F.when(
        F.regexp_like(kind, F.lit("^(?:BIGINT|DOUBLE|DECIMAL|FLOAT|INT)")),
        F.try_variant_get("_v", amount_path, "double"),
    )
    return parsed.select(
        *charges.columns,
        F.try_variant_get("_v", transaction_path, "string").alias("transaction_id"),
        number.alias("amount_minor"),
        to_major_units(number).alias("amount"),
        F.try_variant_get("_v", currency_path, "string").alias("currency"),
    )


def receipt_candidates(enriched: DataFrame) -> DataFrame:
    tx = F.coalesce("transaction_id", F.lit(""))
    return enriched.withColumn(
        "suggested_filename",
        F.when(tx != "", F.concat(F.lit("Transaction #"), tx, F.lit(".pdf"))).otherwise(""),
    )


def receipt_count(enriched: DataFrame) -> DataFrame:
    has_tx = F.coalesce("transaction_id", F.lit("")) != ""
    return enriched.agg(
        F.count(F.lit(1)).alias("charges"), F.count_if(has_tx).alias("with_transaction")
    )


def charge_cells(charges: DataFrame) -> DataFrame:
    """CSV shape: eight plain columns, and extra_data as JSON text.

    Objects are written as they parse; other text becomes a JSON string.
    """
    parsed = parse_extra(F.col("extra_data"))
    cell = F.coalesce(
        F.to_json(parsed),
        F.get(
            F.split(F.to_json(F.struct(F.col("extra_data").alias("v"))), r'^\{"v":|\}$'), F.lit(1)
        ),
        F.lit("null"),
    )
    have = set(charges.columns)
    plain = [
        (F.col(f) if f in have else F.lit(None)).cast("string").alias(f) for f in CHARGE_FIELDS
    ]
    return charges.select(*plain, cell.alias("extra_data_json"))


def ad_account(raw: Column) -> Column:
    trimmed = strip(raw)
    return F.when(
        F.regexp_like(trimmed, F.lit(r"\A\d+\z")), F.concat(F.lit("act_"), trimmed)
    ).otherwise(trimmed)
