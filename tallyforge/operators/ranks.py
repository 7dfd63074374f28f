"""Values at ranks of a group, exactly and for groups of any size: different values are counted, counts are added up in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import Ordered, _meet


def at_ranks(rows: DataFrame, by: list[str], value: Column, ranks: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """by, n (values that are not null) and, for each rank (from 1, made of n), the value that has it; null beyond n.

    Equal values are counted in tasks before they are shuffled, so neither a group nor a value is one task's rows.
    """
    counts = rows.select(*by, value.alias("__v")).filter("__v is not null").groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    sizes = counts.groupBy(*by).agg(F.sum("__c").alias("n"))
    wanted = ranks(F.col("n"))
    sizes = sizes.select(*by, "n", *[r.alias(f"__rank_{name}") for name, r in wanted.items()])
    summed = Ordered.of(counts, by, "__v").carried(total={"__upto": F.col("__c")})
    found = _meet(summed.rows, sizes, by)
    return found.groupBy(*by).agg(F.first("n").alias("n"), *[F.min(F.when(F.col("__upto") >= F.col(f"__rank_{name}"), F.col("__v"))).alias(name) for name in wanted])


def medians(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """by and the median of the values that are not null; groups without any have no row."""
    half = at_ranks(rows, by, value, lambda n: {"__low": F.floor((n + 1) / 2), "__high": F.floor(n / 2) + 1})
    return half.select(*by, ((F.col("__low") + F.col("__high")) / 2).alias(name))
