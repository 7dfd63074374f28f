"""CSV ledgers into versioned tables: several tables become current together, by one manifest, or not at all."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merging
from .sinks import VERSIONS
from .tables import clients_csv, requests_csv

# The files of a folder, and who is named for their rows.
CLIENTS, REQUESTS, ACTOR = "Clients.csv", "RevenueRequests.csv", "migration"
#: Reasons that a report names.
REASONS = 10
_CLIENT = "client_id long, business_name string, ein string, entity_type string, city_state_zip string, industry_category string, is_deleted boolean, updated_by string, updated_at timestamp"
_REQUEST = (
    "request_id string, client_id long, request_type string, period string, status string, amount_due double, due_date date, received_date date, notes string, "
    "bank_statement_received boolean, sales_report_received boolean, is_deleted boolean, updated_by string, updated_at timestamp"
)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, root: str) -> list[int]:
    fs, path = _fs(spark, f"{root}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "m" and n[1:].isdigit())


def manifest(spark: SparkSession, root: str, number: int | None = None) -> dict[str, str]:
    """Names of tables and their folders, of a version or the current one; none before the first."""
    have = _manifests(spark, root)
    if not have:
        return {}
    return json.loads("".join(r[0] for r in spark.read.text(f"{root}/manifests/m{number or have[-1]}").collect()))  # one line


def current(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame:
    """A table's current version; empty, with the schema, before the first."""
    path = manifest(spark, root).get(name)
    return spark.createDataFrame([], schema) if path is None else spark.read.parquet(path)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Write new versions of the tables, then make them current together; returns the version's number.

    All tables are written to folders that nothing names yet. The manifest, which names them and the tables that stay,
    comes last: it is written aside and renamed, which happens whole or not at all and to one writer only. A writer that
    dies before leaves the old versions current. Manifests beyond VERSIONS go, with the folders that they alone name.
    """
    number = (_manifests(spark, root) or [0])[-1] + 1
    paths = manifest(spark, root) | {name: f"{root}/data/{name}-{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(paths[name])
    aside = f"{root}/aside/{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(paths),)], "value string").coalesce(1).write.text(aside)
    fs, source = _fs(spark, aside)
    _, target = _fs(spark, f"{root}/manifests/m{number}")
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(source, target):
        raise RuntimeError(f"version {number} of {root} was published by another writer")
    have = _manifests(spark, root)
    kept = {p for n in have[-VERSIONS:] for p in manifest(spark, root, n).values()}
    for old in have[:-VERSIONS]:
        for path in set(manifest(spark, root, old).values()) - kept:
            fs.delete(_fs(spark, path)[1], True)
        fs.delete(_fs(spark, f"{root}/manifests/m{old}")[1], True)
    return number


@dataclass(frozen=True)
class Report:
    """Rows read; with a dry run, no more. Else clients created and updated, requests upserted and skipped (with the first
    REASONS by id), rows of both tables afterwards, and the version."""

    clients: int
    requests: int
    created: int = 0
    updated: int = 0
    upserted: int = 0
    skipped: int = 0
    reasons: list[str] = field(default_factory=list)
    clients_after: int = 0
    requests_after: int = 0
    version: int | None = None


def migrate(spark: SparkSession, folder: str, root: str, at: Column, dry_run: bool = False) -> Report:
    """Clients and requests of a folder's CSVs, upserted into the tables below root and published together.

    Clients meet by name, requests by id; requests of unknown clients or with a bad id are skipped. Of rows of one name
    or id the last by all their columns counts. A second run of the same files changes no ids.
    """
    names = clients_csv(spark, f"{folder}/{CLIENTS}")
    rows = requests_csv(spark, f"{folder}/{REQUESTS}")
    n_clients, n_requests = names.count(), rows.count()
    if dry_run:
        return Report(n_clients, n_requests)
    have, had = current(spark, root, "clients", _CLIENT), current(spark, root, "requests", _REQUEST)
    merged, counted, ids = merging.upsert_clients(have, merging.stamped(_one(names, "business_name"), ACTOR, at))
    wanted = [c for c in had.columns if c not in ("client_id", "is_deleted", "updated_by", "updated_at")]
    known = ids.select("business_name", "client_id")
    judged = rows.select(*wanted, "business_name")
    fit = _one(judged.filter("request_id is not null"), "request_id").unionByName(judged.filter("request_id is null"))
    upserts, skipped = merging.upsert_requests(had, merging.stamped(fit, ACTOR, at), known)
    version = publish(spark, root, {"clients": merged.drop("change"), "requests": upserts.drop("change").withColumn("is_deleted", F.coalesce("is_deleted", F.lit(False)))})
    # The report reads what was published, or works out what was not.
    created, updated = counted.first()
    after, total = current(spark, root, "clients").count(), current(spark, root, "requests").count()
    lost = skipped.orderBy(F.asc_nulls_first("request_id"), "business_name").limit(REASONS).collect()
    n_skipped = skipped.count()
    return Report(n_clients, n_requests, created, updated, fit.count() - n_skipped, n_skipped, [f"{r['request_id']}: {r['reason']} ({r['business_name']})" for r in lost], after, total, version)


def _one(rows: DataFrame, key: str) -> DataFrame:
    """One row a key: the greatest by all other columns."""
    other = [c for c in rows.columns if c != key]
    best = F.max(F.struct(*[F.col(c) for c in other])).alias("best")
    return rows.groupBy(key).agg(best).select(key, "best.*").select(rows.columns)
