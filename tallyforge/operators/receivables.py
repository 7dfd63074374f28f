"""Receivables: filters, overdue enrichment, totals by client and month. The present is always an argument."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses that are open, and those that count towards an amount due.
OPEN = ("Pending", "Received")
DUE = ("Pending", "Received", "Invoiced")


@dataclass(frozen=True)
class Filters:
    """preset: overdue, month or missing excludes the fields below; None uses them. An empty list is no filter."""

    preset: str | None = None
    start: str | None = None
    end: str | None = None
    statuses: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)


def add_overdue(requests: DataFrame, as_of: Column) -> DataFrame:
    """overdue: open and due before the time as_of, so an item due that day is; days_overdue counts whole days, whatever the status."""
    overdue = requests["status"].isin(*OPEN) & (F.col("due_date").cast("timestamp") < as_of)
    days = F.when(F.col("due_date").isNotNull(), F.greatest(F.datediff(as_of.cast("date"), "due_date"), F.lit(0)))
    return requests.withColumn("overdue", F.coalesce(overdue, F.lit(False))).withColumn("days_overdue", days)


def missing_document() -> Column:
    return ~F.coalesce("bank_statement_received", F.lit(False)) | ~F.coalesce("sales_report_received", F.lit(False))


def apply_filters(requests: DataFrame, filters: Filters, as_of: Column) -> DataFrame:
    """Rows that pass; a null due date passes no test of dates."""
    due = F.col("due_date").cast("date")
    if filters.preset == "overdue":
        return requests.filter(F.col("status").isin(*OPEN) & (F.col("due_date").cast("timestamp") < as_of))
    if filters.preset == "month":
        first = F.trunc(as_of.cast("date"), "month")
        return requests.filter((due >= first) & (due < F.add_months(first, 1)))
    if filters.preset == "missing":
        return requests.filter(F.col("status").isin(*OPEN) & missing_document())
    if filters.start:
        requests = requests.filter(due >= F.lit(filters.start).cast("date"))
    if filters.end:
        requests = requests.filter(due <= F.lit(filters.end).cast("date"))
    if filters.statuses:
        requests = requests.filter(F.col("status").isin(filters.statuses))
    if filters.types:
        requests = requests.filter(F.col("request_type").isin(filters.types))
    return requests


# Statuses of requests, types that are always offered, and industries.
STATUSES, MORE_TYPES, ANY_INDUSTRY = ("Pending", "Received", "Invoiced", "Paid"), ("Payroll", "Tax prep"), "All"
# Bounds of due dates where no request has one.
FIRST_DUE, LAST_DUE = "2025-10-01", "2026-06-10"


def is_default(filters: Filters, requests: DataFrame, industry: str | None = None) -> bool:
    """Whether the filters show all: no preset or industry, all statuses and types, and the whole range of due dates.

    Types are those of the requests and MORE_TYPES; requests are looked at once.
    """
    if filters.preset or industry not in (None, ANY_INDUSTRY) or set(filters.statuses) != set(STATUSES):
        return False
    due = F.col("due_date").cast("date")
    seen = requests.agg(F.min(due).cast("string").alias("first"), F.max(due).cast("string").alias("last"), F.collect_set("request_type").alias("types")).first()
    return set(filters.types) == {*seen["types"], *MORE_TYPES} and (filters.start, filters.end) == (seen["first"] or FIRST_DUE, seen["last"] or LAST_DUE)


def open_for(requests: DataFrame, client: str, flag: str) -> DataFrame:
    """Open requests of a client whose flag is not set."""
    return requests.filter((F.col("business_name") == client) & F.col("status").isin(*OPEN) & ~F.coalesce(flag, F.lit(False)))


def search(rows: DataFrame, term: str, *columns: str, literal: bool = False) -> DataFrame:
    """Rows in which any column holds the term, in either case; a regular expression unless literal."""
    pattern = "(?i)" + (rf"\Q{term}\E" if literal else term)
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.col(c), F.lit("")).rlike(pattern)
    return rows.filter(test)


def roster(clients: DataFrame, requests: DataFrame) -> DataFrame:
    """Every client with its amount due, number of requests and status of the last request in order of `ord`."""
    sums = requests.groupBy("client_id").agg(
        F.sum(F.when(F.col("status").isin(*DUE), F.col("amount_due")).otherwise(0.0)).alias("total_due"),
        F.count("request_id").alias("n_requests"),
        F.max_by("status", "ord").alias("last_status"),
    )
    return clients.join(sums, "client_id", "left").na.fill({"total_due": 0.0, "n_requests": 0, "last_status": ""})


def of_industries(requests: DataFrame, clients: DataFrame, industries: list[str]) -> DataFrame:
    return requests.join(clients.filter(F.col("industry").isin(industries)), "client_id", "left_semi")


def unknown_clients(requests: DataFrame, clients: DataFrame) -> DataFrame:
    return requests.join(clients, "client_id", "left_anti")


def monthly(requests: DataFrame) -> DataFrame:
    """Count and sum by month of the due date and status; no date: month NaT; null statuses drop out."""
    month = F.coalesce(F.date_format("due_date", "yyyy-MM"), F.lit("NaT"))
    return requests.filter(F.col("status").isNotNull()).groupBy(month.alias("month"), "status").agg(F.count("*").alias("n"), F.sum("amount_due").alias("amount"))


def kpis(clients: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """One row: clients, pending amount, overdue count, share paid in percent."""
    flagged = add_overdue(requests, as_of)
    sums = flagged.agg(
        F.coalesce(F.sum(F.when(F.col("status").isin(*OPEN), F.col("amount_due"))), F.lit(0.0)).alias("pending_amount"),
        F.count_if("overdue").alias("overdue"),
        F.bround(100.0 * F.count_if(F.col("status") == "Paid") / F.greatest(F.count("*"), F.lit(1)), 1).alias("paid_pct"),
    )
    return clients.agg(F.count("*").alias("clients")).crossJoin(sums)  # one row each


def missing_counts(requests: DataFrame) -> DataFrame:
    bank, sales = ~F.coalesce("bank_statement_received", F.lit(False)), ~F.coalesce("sales_report_received", F.lit(False))
    return requests.filter(F.col("status").isin(*OPEN)).agg(
        F.count_if(bank).alias("bank"), F.count_if(sales).alias("sales"), F.count_if(bank | sales).alias("either"), F.count_if(bank & sales).alias("both")
    )


def priority(requests: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    """The overdue by due date, then days overdue, then id; the first `limit`."""
    late = add_overdue(requests, as_of).filter("overdue")
    return late.orderBy("due_date", F.desc("days_overdue"), "request_id").limit(limit)


def recent(requests: DataFrame, limit: int = 8) -> DataFrame:
    return requests.orderBy(F.col("due_date").cast("string").desc_nulls_last(), "request_id").limit(limit)


def priority_header(requests: DataFrame, as_of: Column) -> DataFrame:
    late = add_overdue(requests, as_of).filter("overdue")
    return late.agg(F.count("*").alias("overdue"), F.sum("amount_due").alias("amount"), F.max("days_overdue").alias("max_days"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of after that before lacks, cell by cell as text, with null as the empty text."""
    text = lambda df: df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in before.columns])
    return text(after).exceptAll(text(before))
