"""Writers: snapshots with undo, CSV exports, appended logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import redact_digits
from .tables import LEDGER, RULES

#: Versions that a table keeps.
VERSIONS = 5


def _folders(spark: SparkSession, root: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if s.getPath().getName()[:1] == "v" and s.getPath().getName()[1:].isdigit())


def save_version(df: DataFrame, root: str) -> int:
    """Write a new version of the table and drop the oldest beyond VERSIONS; earlier ones stay as they are."""
    spark = df.sparkSession
    number = (_folders(spark, root) or [0])[-1] + 1
    df.write.parquet(f"{root}/v{number}")
    for old in _folders(spark, root)[:-VERSIONS]:
        drop_version(spark, root, old)
    return number


def drop_version(spark: SparkSession, root: str, number: int) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/v{number}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/v{_folders(spark, root)[-1]}")


def undo(spark: SparkSession, root: str) -> DataFrame:
    """The version before the last, which is dropped; a single version stays."""
    have = _folders(spark, root)
    if len(have) > 1:
        drop_version(spark, root, have[-1])
    return current(spark, root)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_ledger(rows: DataFrame, path: str) -> None:
    export_csv(rows.select([F.col(f"`{c}`") for c in LEDGER]), path)


def export_rules(rules: DataFrame, path: str) -> None:
    export_csv(rules.select(RULES), path)


def append_feedback(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def evidence_lines(records: DataFrame) -> DataFrame:
    """Log lines of records (pdf and fields), with runs of nine digits and more masked."""
    fields = F.to_json(F.struct(*[c for c in records.columns if c != "pdf"]))
    return records.select(redact_digits(F.concat(F.lit('SMOKE_EVIDENCE pdf="'), "pdf", F.lit('" json='), fields)).alias("value"))


def write_evidence(records: DataFrame, path: str) -> None:
    """The fields of records (with pdf) as JSON beside the log, masked as the log's lines are."""
    masked = [redact_digits(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in records.dtypes]
    records.select(masked).write.mode("append").json(path)


def export_run(rows: DataFrame, path: str) -> None:
    """A run's ledger, and its rows with a check number alone, as two CSVs with the linked check."""
    columns = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in [*LEDGER[:-1], "linked_check_id"]]
    out = rows.select(columns)
    export_csv(out, f"{path}/transactions_all")
    export_csv(out.filter(F.trim("`Check#`") != ""), f"{path}/transactions_checks")


def export_deposits(crops: DataFrame, path: str) -> None:
    """Deposit slips (crop_id, page, class, text) as JSON, beside a run's ledger."""
    slips = crops.filter(F.col("class") == "deposit_slip")
    slips.select("crop_id", "page", F.col("class").alias("predicted_class"), F.col("text").alias("raw_text"), F.lit(None).cast("long").alias("matched_transaction_index")).write.mode("overwrite").option("ignoreNullFields", False).json(path)
