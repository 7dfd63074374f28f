"""Updates as joins: edits, upserts and flags on tables that are rewritten whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def update(master: DataFrame, edits: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """master with the non-null cells of edits, and the edits of null or unknown keys, with `reason`. One edit a key."""
    names = [c for c in edits.columns if c != key]
    joined = master.join(edits.select(key, *[F.col(c).alias(f"__{c}") for c in names]), key, "left")
    merged = joined.select([F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in master.columns])
    lost = edits.join(master, key, "left_anti")
    return merged, lost.withColumn("reason", F.when(F.col(key).isNull(), "invalid id").otherwise("unknown id"))


def upsert(master: DataFrame, rows: DataFrame, keys: list[str], revive: str | None = None) -> DataFrame:
    """master with rows merged by key, and `change` (kept, created, updated). Non-blank cells of rows win.

    revive: a flag of soft deletion that rows clear. Keys of rows are unique.
    """
    names = [c for c in master.columns if c not in keys]
    have = master.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in names], F.lit(True).alias("__old"))
    new = rows.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in names if c in rows.columns], F.lit(True).alias("__new"))
    both = have.join(new, keys, "full")

    def cell(c: str):
        if c == revive:
            return F.when(F.col("__new"), F.lit(False)).otherwise(F.col(f"__old_{c}"))
        if c not in rows.columns:
            return F.col(f"__old_{c}")
        given = F.col(f"__new_{c}")
        return F.coalesce(F.when(F.trim(given.cast("string")) != "", given), F.col(f"__old_{c}"))

    change = F.when(F.col("__old").isNull(), "created").when(F.col("__new").isNotNull(), "updated").otherwise("kept")
    return both.select(*keys, *[cell(c).alias(c) for c in names], change.alias("change"))


def set_where(master: DataFrame, ids: DataFrame, key: str, column: str, value) -> tuple[DataFrame, DataFrame]:
    """master with `column` set on the ids, and the ids that it lacks."""
    marked = master.join(ids.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    out = marked.withColumn(column, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(column))).select(master.columns)
    return out, ids.join(master, key, "left_anti")


def upsert_rules(rules: DataFrame, rows: DataFrame, day: str) -> DataFrame:
    """Rules by pattern and lower-case client; non-blank cells of rows win, and touched rules carry the day."""
    keyed = lambda df: df.withColumn("__client", F.lower(F.coalesce("client_override", F.lit(""))))
    merged = upsert(keyed(rules), keyed(rows), ["pattern", "__client"])
    stamp = F.when(F.col("change") == "kept", F.col("last_used")).otherwise(F.lit(day))
    return merged.withColumn("last_used", stamp).drop("__client")


def counts(merged: DataFrame) -> DataFrame:
    """One row: created and updated rows of an upsert()."""
    return merged.agg(F.count_if(F.col("change") == "created").alias("created"), F.count_if(F.col("change") == "updated").alias("updated"))


def upsert_clients(clients: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clients, counts, business_name to client_id): clients by name, revived if they were deleted; new ones take the next ids.

    New ids follow the largest one, in order of names: only the new rows are numbered.
    """
    merged = upsert(clients, rows, ["business_name"], revive="is_deleted")
    top = merged.agg(F.coalesce(F.max("client_id"), F.lit(0)).alias("top")).first()["top"]
    order = F.row_number().over(Window.orderBy("business_name"))
    new = merged.filter("client_id is null").withColumn("client_id", (order + F.lit(top)).cast(clients.schema["client_id"].dataType)).withColumn("is_deleted", F.lit(False))
    out = merged.filter("client_id is not null").unionByName(new)
    return out, counts(out), out.select("business_name", "client_id")


def upsert_requests(requests: DataFrame, rows: DataFrame, clients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, skipped): rows by request_id for known clients; others are skipped with a reason: invalid id or unknown client."""
    known = rows.join(clients.select("business_name", "client_id"), "business_name", "left")
    reason = F.when(F.col("request_id").isNull(), "invalid request id").when(F.col("client_id").isNull(), "unknown client")
    judged = known.withColumn("reason", reason)
    merged = upsert(requests, judged.filter("reason is null").drop("reason", "business_name"), ["request_id"])
    return merged, judged.filter("reason is not null").select("request_id", "business_name", "reason")


def stamped(rows: DataFrame, actor: str, at) -> DataFrame:
    """rows with updated_by and updated_at; who and when are arguments, as the present is everywhere."""
    return rows.withColumn("updated_by", F.lit(actor.strip() or "system")).withColumn("updated_at", at)
