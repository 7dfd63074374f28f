"""Metrics, pivots, reconciliation and comparisons of finished ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import blank


def metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, deposits, withdrawals, checks and rows to review of rows with amount, check_no, confidence, needs_review."""
    unsure = F.count_if(~F.coalesce(F.col("confidence"), F.lit("")).isin("High", ""))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.when(F.col("amount") > 0, F.col("amount"))), F.lit(0.0)).alias("deposits"),
        F.coalesce(-F.sum(F.when(F.col("amount") < 0, F.col("amount"))), F.lit(0.0)).alias("withdrawals"),
        F.count_if(blank(F.col("check_no")) != "").alias("checks"),
        F.greatest(unsure, F.count_if(F.lower("needs_review") == "yes")).alias("to_review"),
    )


def section_totals(rows: DataFrame) -> DataFrame:
    """credit, debit and check sums; a check row counts as a check alone."""
    check = blank(F.col("check_no")) != ""
    kind = F.when(check, "check").when(F.col("amount") > 0, "credit").when(F.col("amount") < 0, "debit").otherwise("other")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.abs("amount")).alias("total"))


def pivot_long(rows: DataFrame, key: str, value: str = "sum", only_uncategorized: bool = False) -> DataFrame:
    """key, year_month, value, total of the key: the pivot's cells, one a row, without those that are empty."""
    names = {"category": "Uncategorized", "payee": "(no payee)"}
    label = lambda c, d: F.coalesce(F.nullif(blank(F.col(c)), F.lit("")), F.lit(d))
    if only_uncategorized:
        rows = rows.filter(F.lower(blank(F.col("category"))).isin("", "uncategorized"))
    cell = F.sum("amount") if value == "sum" else F.count("*")
    cells = rows.groupBy(label(key, names.get(key, "")).alias(key), label("year_month", "(no date)").alias("year_month")).agg(cell.alias("value"))
    return cells.join(cells.groupBy(key).agg(F.sum("value").alias("total")), key)


def pivot_wide(rows: DataFrame, key: str, months: list[str], value: str = "sum") -> DataFrame:
    """key, a column for each month, Total; the largest totals first. The months are given, so the plan has one pass."""
    cells = pivot_long(rows, key, value)
    wide = cells.groupBy(key).pivot("year_month", months).agg(F.first("value")).na.fill(0)
    totals = cells.groupBy(key).agg(F.first("total").alias("Total"))
    return wide.join(totals, key).orderBy(F.desc(F.abs("Total")), key)


def totals(rows: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """deposits, withdrawals, checks, transactions by statement; a summary overrides money, never counts."""
    found = metrics(rows, ["statement_id"]).select("statement_id", "deposits", "withdrawals", "checks", F.col("n").alias("transactions"))
    if summary is None:
        return found
    s = summary.select("statement_id", F.col("deposits").alias("__d"), F.col("withdrawals").alias("__w"))
    return found.join(s, "statement_id", "left").select("statement_id", F.coalesce("__d", "deposits").alias("deposits"), F.coalesce("__w", "withdrawals").alias("withdrawals"), "checks", "transactions")


def reconcile(computed: DataFrame, reported: DataFrame, key: str = "statement_id") -> DataFrame:
    """status (match, mismatch, no_reference) and the fields that differ. Money may differ by a cent, counts by nothing.

    Only reported fields are compared, money as whole cents, so a gap of one cent never depends on a double's last bit.
    """
    fields = ["deposits", "withdrawals", "checks", "transactions"]
    r = reported.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    both = computed.join(r, key, "left")

    def differs(f: str) -> Column:
        gap = F.abs(F.round(F.col(f) * 100) - F.round(F.col(f"__{f}") * 100)) > (1 if f in fields[:2] else 0)
        return F.when(F.coalesce(gap, F.lit(False)), f)

    out = both.withColumn("differences", F.array_compact(F.array(*map(differs, fields))))
    none = F.coalesce(*[F.col(f"__{f}").cast("string") for f in fields]).isNull()
    status = F.when(none, "no_reference").when(F.size("differences") > 0, "mismatch").otherwise("match")
    return out.select(key, status.alias("status"), F.array_join("differences", ",").alias("differences"))


def top_payees(rows: DataFrame, limit: int) -> DataFrame:
    sums = rows.groupBy("payee").agg(F.sum("amount").alias("total"), F.count("*").alias("n"))
    return sums.orderBy(F.desc(F.abs("total")), "payee").limit(limit)


def golden_difference(found: DataFrame, golden: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with `side`."""
    a, b = found.select(keys), golden.select(keys)
    return a.subtract(b).withColumn("side", F.lit("extra")).union(b.subtract(a).withColumn("side", F.lit("missing")))


def payee_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row: shared keys, changed payees, and payees filled where there was none or an uncategorised one."""
    joined = before.select(*keys, F.col("payee").alias("__old")).join(after.select(*keys, F.col("payee").alias("__new")), keys)
    old, new = blank(F.col("__old")), blank(F.col("__new"))
    return joined.agg(F.count("*").alias("shared"), F.count_if(old != new).alias("changed"), F.count_if(F.lower(old).isin("", "uncategorized") & (new != "")).alias("filled"))


def run_difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of either run whose payee or reason is not the same on both, nulls being equal."""
    a = before.select(key, F.col("payee").alias("old_payee"), F.col("reason").alias("old_reason"))
    b = after.select(key, F.col("payee").alias("new_payee"), F.col("reason").alias("new_reason"))
    same = F.col("old_payee").eqNullSafe(F.col("new_payee")) & F.col("old_reason").eqNullSafe(F.col("new_reason"))
    return a.join(b, key, "full").filter(~same)


def quality(rows: DataFrame, clean: Column) -> DataFrame:
    """n, clean and its percentage, blank."""
    return rows.agg(F.count("*").alias("n"), F.count_if(clean).alias("clean"), F.count_if(blank(F.col("payee")) == "").alias("blank"), F.bround(100.0 * F.count_if(clean) / F.greatest(F.count("*"), F.lit(1)), 1).alias("clean_pct"))


def imaging_pages(crops: DataFrame, least: int) -> DataFrame:
    """first and last of the pages on which at least so many crops survive."""
    return crops.groupBy("page").agg(F.count("*").alias("n")).filter(F.col("n") >= least).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("pages"))


def review_sample(rows: DataFrame, forced: list[str], limit: int) -> DataFrame:
    """Forced ids first, then the highest priority of the others, ids breaking ties; blank payees do not take part."""
    named = rows.filter(blank(F.col("payee")) != "")
    return named.orderBy((~F.col("crop_id").isin(forced)).cast("int"), F.desc("priority"), "crop_id").limit(limit)


def by_confidence(rows: DataFrame, level: str = "High") -> DataFrame:
    """All rows for High, Show All or a blank level; for others, those whose confidence is neither High nor blank."""
    return rows if level in ("High", "Show All", "") else rows.filter(~blank(F.col("confidence")).isin("High", ""))


def reference_totals(reported: DataFrame, summary: DataFrame, key: str = "statement_id") -> DataFrame:
    """Totals to reconcile with: the reported line where there is one, else the statement's summary.

    A summary's count of withdrawals stands for checks, and it has no count of transactions. Statements with neither have no row.
    """
    fields = ["deposits", "withdrawals", "checks", "transactions"]
    r = reported.select(key, F.struct(*fields).alias("r")).filter(F.coalesce(*[F.col(f"r.{f}").cast("string") for f in fields]).isNotNull())
    given = summary.select(key, F.struct("deposits", "withdrawals", F.col("withdrawals_count").cast("int").alias("checks"), F.lit(None).cast("int").alias("transactions")).alias("s"))
    given = given.filter(F.coalesce(*[F.col(f"s.{f}").cast("string") for f in fields[:3]]).isNotNull())
    both = r.join(given, key, "full")
    return both.select(key, *[F.when(F.col("r").isNotNull(), F.col(f"r.{f}")).otherwise(F.col(f"s.{f}")).alias(f) for f in fields])


def kinds(rows: DataFrame) -> DataFrame:
    """kind (check, deposit, ach_credit, debit, other) and n: a row with a number is a check, a regular deposit a deposit."""
    kind = (
        F.when(blank(F.col("check_no")) != "", "check")
        .when(F.lower(F.coalesce("description", F.lit(""))).startswith("regular deposit"), "deposit")
        .when(F.col("amount") > 0, "ach_credit")
        .when(F.col("amount") < 0, "debit")
        .otherwise("other")
    )
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def run_summary(rows: DataFrame, crops: DataFrame) -> DataFrame:
    """One row: transactions, check_rows, linked_check_rows and cropped_checks of a run."""
    check = blank(F.col("check_no")) != ""
    found = rows.agg(F.count("*").alias("transactions"), F.count_if(check).alias("check_rows"), F.count_if(check & F.col("linked_check_id").isNotNull()).alias("linked_check_rows"))
    return found.crossJoin(crops.agg(F.count("*").alias("cropped_checks")))  # one row each


def row_counts(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each table, for a health report."""
    return {name: df.count() for name, df in tables.items()}
