"""Readers of clients, requests, rules, pasted ledgers, service responses and logs. Schemas are fixed, never inferred."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce
from ..functions.coerce import blank
from ..functions.predicates import in_bucket

# Columns of ledgers, rules and requests.
LEDGER = ["Date", "Description", "Payee", "Amount", "SignedAmount", "Check#", "Category", "SubCategory", "YearMonth", "Confidence", "NeedsReview", "ReviewReason", "Source"]
RULES = ["pattern", "clean_payee", "suggested_category", "client_override", "notes", "last_used"]
REQUESTS = ["request_id", "business_name", "request_type", "period", "status", "amount_due", "due_date", "received_date", "notes", "bank_statement_received", "sales_report_received"]


def _with(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with absent columns as empty texts; unknown ones stay at the end."""
    for c in columns:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    return df.select(*[F.col(f"`{c}`") for c in columns], *[F.col(f"`{c}`") for c in df.columns if c not in columns])


def _text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV as texts, by the names of its own header."""
    return _with(spark.read.option("header", True).option("multiLine", False).csv(path), columns)


def clients_csv(spark: SparkSession, path: str) -> DataFrame:
    """Clients with a name, and the industry that their name tells."""
    raw = _text_csv(spark, path, ["business_name", "ein", "entity_type", "city_state_zip"])
    named = raw.filter(blank(F.col("business_name")) != "")
    return named.select("business_name", "ein", "entity_type", "city_state_zip", in_bucket(F.col("business_name")).alias("industry_category"))


def requests_csv(spark: SparkSession, path: str) -> DataFrame:
    return coerce_requests(_text_csv(spark, path, REQUESTS))


def coerce_requests(raw: DataFrame) -> DataFrame:
    typed = {"amount_due": coerce.money(F.col("amount_due")), "due_date": coerce.parse_date(F.col("due_date")), "received_date": coerce.parse_date(F.col("received_date")), "bank_statement_received": coerce.flag(F.col("bank_statement_received")), "sales_report_received": coerce.flag(F.col("sales_report_received")), "request_id": coerce.request_id(F.col("request_id")).cast("string")}
    return raw.withColumns(typed)


def live(df: DataFrame) -> DataFrame:
    """Rows that are not softly deleted; the condition reaches the scan."""
    return df.filter(~F.coalesce("is_deleted", F.lit(False)))


def requests_of_clients(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """Live requests with their client's name; requests of deleted clients stay."""
    return live(requests).join(clients.select("client_id", "business_name"), "client_id")


def rules_csv(spark: SparkSession, path: str) -> DataFrame:
    return _text_csv(spark, path, RULES).filter(blank(F.col("pattern")) != "")


def check_rules_csv(spark: SparkSession, path: str) -> DataFrame:
    """Check rules, without comments; a blank scope is check."""
    raw = _text_csv(spark, path, ["pattern", "payee", "client_override", "bank", "scope"])
    scope = F.coalesce(F.nullif(F.lower(blank(F.col("scope"))), F.lit("")), F.lit("check"))
    return raw.filter((blank(F.col("pattern")) != "") & ~F.col("pattern").startswith("#")).withColumn("scope", scope).filter(F.col("scope").isin("check", "both"))


def pasted_ledger(lines: DataFrame, header: list[str] | None = None) -> DataFrame:
    """Ledger rows from pasted lines (line_no, value): no fences or TOTALS lines, no quoting; longer lines are dropped,
    shorter ones filled, and the values normalised."""
    header = header or LEDGER[:12]
    body = lines.filter(~F.trim("value").rlike(r"^```|(?i)^TOTALS:") & (F.trim("value") != ""))
    cells = body.withColumn("cells", F.split("value", ",", -1)).filter(F.size("cells") <= len(header))
    raw = cells.select("line_no", *[F.trim(F.coalesce(F.try_element_at("cells", F.lit(i + 1)), F.lit(""))).alias(c) for i, c in enumerate(header)])
    return normalise_ledger(_with(raw.filter(F.lower("Date") != "date"), LEDGER))


def normalise_ledger(raw: DataFrame, blank_confidence: str = "High", review_from_confidence: bool = True) -> DataFrame:
    """Ledger texts in their forms: defaults, money, the month of the date, who needs review; empty rows go."""
    amount = coerce.money(F.col("Amount"))
    signed = F.when(blank(F.col("SignedAmount")) == "", amount).otherwise(coerce.money(F.col("SignedAmount")))
    sure = F.coalesce(F.nullif(F.initcap(blank(F.col("Confidence"))), F.lit("")), F.lit(blank_confidence))
    month = F.coalesce(F.nullif(blank(F.col("YearMonth")), F.lit("")), F.date_format(coerce.parse_date(F.col("Date")), "yyyy-MM"), F.lit(""))
    given = coerce.yes_no(F.col("NeedsReview"))
    review = F.when(blank(F.col("NeedsReview")) != "", given).when(sure.isin("Medium", "Low"), "Yes").otherwise("No") if review_from_confidence else given
    text = {c: blank(F.col(f"`{c}`")) for c in ("Date", "Description", "Payee", "Check#", "SubCategory", "ReviewReason", "Source")}
    out = raw.withColumns(text | {"Amount": amount, "SignedAmount": signed, "Category": F.coalesce(F.nullif(blank(F.col("Category")), F.lit("")), F.lit("Uncategorized")), "YearMonth": month, "Confidence": sure, "NeedsReview": review})
    return out.filter((F.col("Date") != "") | (F.col("Description") != "") | (F.col("Amount") != 0))


def service_ledger(raw: DataFrame) -> DataFrame:
    """As normalise_ledger, for service rows: a blank confidence is Medium and tells nothing about review."""
    return normalise_ledger(_with(raw, LEDGER), "Medium", False)


def pasted_totals(lines: DataFrame) -> DataFrame:
    """deposits, withdrawals, checks and transactions of the last TOTALS line; no row without any."""
    last = lines.filter(F.trim("value").rlike("(?i)^TOTALS:")).agg(F.max_by("value", "line_no").alias("v"))
    number = lambda k, t: F.translate(F.regexp_extract("v", rf"(?i)\b{k}\s*=\s*\$?([\d,.]+)", 1), ",", "").try_cast(t).alias(k)
    out = last.select(number("deposits", "double"), number("withdrawals", "double"), number("checks", "int"), number("transactions", "int"))
    return out.filter(F.coalesce(*[F.col(c).cast("string") for c in out.columns]).isNotNull())


_LEAF = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("valueString", "valueDate", "valueTime", "content")], T.StructField("valueNumber", T.DoubleType()), T.StructField("valueInteger", T.LongType()),
    T.StructField("valueCurrency", T.StructType([T.StructField("amount", T.DoubleType())])), T.StructField("confidence", T.DoubleType()),
])
_TRANSACTION = T.StructType([T.StructField(n, _LEAF) for n in ("Date", "Description", "DepositAmount", "WithdrawalAmount", "Amount", "CheckNumber")])


def _list_of(fields: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("valueArray", T.ArrayType(T.StructType([T.StructField("valueObject", fields)])))])


RESPONSE = T.StructType([T.StructField("documents", T.ArrayType(T.StructType([T.StructField("fields", T.StructType([
    T.StructField("Accounts", _list_of(T.StructType([T.StructField("Transactions", _list_of(_TRANSACTION))]))),
    *[T.StructField(n, _LEAF) for n in ("CheckNumber", "PayTo", "PayerName", "NumberAmount")],
]))])))])


def leaf(column: str):
    """A field's text, from whichever typed value it has, else its content. Dates are their first ten characters."""
    number = lambda kind: F.col(f"{column}.{kind}").cast("string")
    day = F.substring(F.col(f"{column}.valueDate"), 1, 10)
    return F.coalesce(f"{column}.valueString", number("valueNumber"), number("valueInteger"), day, f"{column}.valueTime", number("valueCurrency.amount"), f"{column}.content", F.lit(""))


def leaf_number(column: str):
    """A field's number, from a typed value or from its text."""
    typed = F.coalesce(f"{column}.valueNumber", F.col(f"{column}.valueInteger").cast("double"), f"{column}.valueCurrency.amount")
    return F.coalesce(typed, F.translate(leaf(column), "$,", "").try_cast("double"))


def statement_response(responses: DataFrame) -> DataFrame:
    """Transactions (statement_id, ord, date, description, amount, check_no, confidence) of responses (statement_id, json).

    A deposit is positive and a withdrawal negative; of both, the larger counts, and equal ones are a deposit.
    Confidence is the mean of the fields that carry one.
    """
    docs = responses.select("statement_id", F.explode(F.from_json("json", RESPONSE)["documents"]).alias("d"))
    accounts = docs.select("statement_id", F.posexplode("d.fields.Accounts.valueArray").alias("account", "a"))
    t = accounts.select("statement_id", "account", F.posexplode("a.valueObject.Transactions.valueArray").alias("place", "x")).select("statement_id", "account", "place", "x.valueObject.*")
    deposit, withdrawal = F.abs(leaf_number("DepositAmount")), F.abs(leaf_number("WithdrawalAmount"))
    amount = F.when(deposit.isNotNull() & (withdrawal.isNull() | (deposit >= withdrawal)), deposit).when(withdrawal.isNotNull(), -withdrawal).otherwise(leaf_number("Amount"))
    sures = F.filter(F.array(*[F.col(f"{c}.confidence") for c in ("Date", "Description", "DepositAmount", "WithdrawalAmount", "Amount")]), lambda c: c.isNotNull())
    mean = F.when(F.size(sures) > 0, F.aggregate(sures, F.lit(0.0), lambda a, c: a + c) / F.size(sures))
    return t.select("statement_id", (F.col("account") * 1_000_000 + F.col("place")).alias("ord"), F.try_to_date(coerce.service_date(leaf("Date")), "yyyy-MM-dd").alias("date"), leaf("Description").alias("description"), amount.alias("amount"), coerce.check_number(leaf("CheckNumber")).alias("check_no"), coerce.confidence_label(mean).alias("confidence"))


def check_response(responses: DataFrame, amount_suffices: bool = False) -> DataFrame:
    """Checks (statement_id, ord, check_no, pay_to, payer_name, amount) with a number or payee, or an amount if that suffices."""
    docs = responses.select("statement_id", F.posexplode(F.from_json("json", RESPONSE)["documents"]).alias("ord", "d")).select("statement_id", "ord", "d.fields.*")
    amount = leaf_number("NumberAmount")
    out = docs.select("statement_id", "ord", coerce.check_number(leaf("CheckNumber")).alias("check_no"), F.trim(leaf("PayTo")).alias("pay_to"), F.trim(leaf("PayerName")).alias("payer_name"), amount.alias("amount"))
    usable = (F.col("check_no") != "") | (F.col("pay_to") != "")
    return out.filter(usable | F.col("amount").isNotNull() if amount_suffices else usable)


def checks_to_rows(checks: DataFrame) -> DataFrame:
    """Withdrawals of checks: minus the amount; described by payee, number or as an image. Without an amount: none."""
    name = F.when(F.col("pay_to") != "", F.col("pay_to")).when(F.col("check_no") != "", F.concat(F.lit("Check "), "check_no")).otherwise("Check (image)")
    return checks.filter(F.coalesce("amount", F.lit(0.0)) != 0).select("statement_id", "ord", name.alias("description"), F.col("pay_to").alias("payee"), (-F.abs("amount")).alias("amount"), "check_no", F.lit("check_image_crop").alias("source"))


EVIDENCE = "smoke_key string, deposits double, withdrawals double, rows int, status string"


def evidence(lines: DataFrame) -> DataFrame:
    """line_no, pdf and fields of log lines that carry `SMOKE_EVIDENCE pdf="…" json={…}`; bad JSON is skipped."""
    found = lines.filter(F.col("value").contains("SMOKE_EVIDENCE")).select("line_no", F.regexp_extract("value", r'pdf="([^"]*)"', 1).alias("pdf"), F.from_json(F.regexp_extract("value", r"json=(\{.*\})", 1), EVIDENCE).alias("e"))
    return found.select("line_no", "pdf", "e.*").filter("smoke_key is not null")


def latest_evidence(lines: DataFrame) -> DataFrame:
    found = evidence(lines)
    last = found.groupBy("smoke_key").agg(F.max_by(F.struct(*[c for c in found.columns if c != "smoke_key"]), "line_no").alias("e"))
    return last.select("smoke_key", "e.*")


def feedback_counts(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total"), F.count_if(~F.lower(blank(F.col("status"))).isin("closed", "resolved", "done")).alias("open"))


def first_pair(folders: list[str], names: tuple[str, ...] = ("Clients.csv", "RevenueRequests.csv"), variable: str = "TALLYFORGE_DATA") -> Path | None:
    """The first folder that has all files: the one that the environment names, then the given ones, each once."""
    for f in dict.fromkeys([*filter(None, [os.environ.get(variable)]), *folders]):
        if all((Path(f) / n).exists() for n in names):
            return Path(f)
    return None


def requests_sample(clients: DataFrame, seed: int = 42) -> DataFrame:
    """One or two invented requests for each client, the same for the same seed."""
    pick = lambda salt, n: F.pmod(F.xxhash64("business_name", F.lit(seed), F.lit(salt)), F.lit(n))
    states = F.array(*map(F.lit, ("Pending", "Received", "Invoiced", "Paid")))
    rows = clients.select("business_name", F.explode(F.sequence(F.lit(1), pick("n", 2).cast("int") + 1)).alias("k"))
    return rows.select("business_name", F.element_at(states, pick("s", 4).cast("int") + 1).alias("status"), (pick("a", 500000) / 100).alias("amount_due"), F.date_add(F.lit("2026-01-01").cast("date"), pick("d", 180).cast("int")).alias("due_date"), "k")


def canonical(rows: DataFrame) -> DataFrame:
    """The twelve columns of a ledger, absent ones as empty texts, and nothing else."""
    return _with(rows, LEDGER[:-1]).select([F.col(f"`{c}`") for c in LEDGER[:-1]])


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """A ledger that export_run() wrote, all texts, with the linked check where the file has it."""
    raw = _text_csv(spark, path, LEDGER[:-1])
    links = ["linked_check_id"] if "linked_check_id" in raw.columns else []
    return raw.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in [*LEDGER[:-1], *links]])


def rescored(spark: SparkSession, responses: str, scored: str) -> DataFrame:
    """Cached responses (a folder of JSON) with the payee and reason that an earlier CSV gave their crop, if any."""
    raw = spark.read.json(responses)
    before = spark.read.option("header", True).csv(scored).select("crop_id", F.col("payee").alias("old_payee"), F.col("reason").alias("old_reason"))
    return raw.join(before, "crop_id", "left")


def latest_file(folder: str, pattern: str = "*") -> Path | None:
    """The file of a folder that was changed last."""
    found = [f for f in Path(folder).glob(pattern) if f.is_file()] if Path(folder).is_dir() else []
    return max(found, key=lambda f: f.stat().st_mtime, default=None)
